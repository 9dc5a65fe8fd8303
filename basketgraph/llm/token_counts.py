"""Operator 10: token counts of a unigram tokenizer without building tokens.

For every word an Aho-Corasick automaton over the vocabulary lists all pieces by the
position they end at; dynamic programming keeps, per position, the best score and the number
of pieces on that best path, and nothing else. Ties and unknown characters follow the
tokenizers library's Unigram model:

* a later path replaces an earlier one only if its score is greater; for one end position,
  starts are tried from left to right, so among equals the longest piece wins;
* a character that no piece covers alone may be unknown, at the smallest score less 10; with
  byte fallback it counts one piece a UTF-8 byte, else a run of unknowns counts one;
* words are runs without Unicode white space, each with the marker before it.

Counting needs no shuffle. Each worker remembers counts of words (bounded, WORDS_KEPT), since
texts repeat words far more often than they bring new ones.

Defined cases: a null or empty text has 0 tokens; repeated rows and null ids are counted like
any other; words are never cut, so very long ones are exact; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 1_000_000
LONGEST_KEPT = 64
# Unicode White_Space; str.split() would also split at 0x1C-0x1F.
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_OTHER = re.compile("[\x1c-\x1f]")
_counters: dict = {}


class UnigramCounter:
    """Counts pieces under ``vocabulary``: (piece, score) in id order."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        named = {piece for piece, _ in vocabulary}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in named for b in range(256))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the marker and ``word``."""
        got = self.known.get(word)
        if got is None:
            chunks = word.split(MARK)  # a marker in the text starts a chunk of its own
            got = sum([self.count(MARK + c) for c in (chunks if chunks[0] else chunks[1:])])
            if len(word) <= LONGEST_KEPT:
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[word] = got
        return got

    def count(self, text: str) -> int:
        size = len(text)
        best: list = [None] * (size + 1)
        pieces = [0] * (size + 1)
        best[0] = 0.0
        alone = [c not in self.single for c in text]
        run = [False] * (size + 1)  # does the best path end in an unknown character
        done = 0
        for end, (length, score) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # ends that no piece reaches, and unknowns before this end
                done += 1
                self._unknown(text, done, best, pieces, run, alone)
            start = end - length
            before = best[start]
            if before is not None:
                total = before + score
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], run[end] = total, pieces[start] + 1, False
        while done < size:
            done += 1
            self._unknown(text, done, best, pieces, run, alone)
        return pieces[size]

    def _unknown(self, text, end, best, pieces, run, alone) -> None:
        """The last candidate for ``end``: its character as unknown."""
        before = best[end - 1]
        if alone[end - 1] and before is not None:
            total = before + self.unknown
            if best[end] is None or total > best[end]:
                if self.byte_fallback:
                    more = len(text[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    more = 0 if run[end - 1] else 1
                best[end], pieces[end], run[end] = total, pieces[end - 1] + more, True

    def text(self, text: str) -> int:
        words = _WORDS.findall(text) if _OTHER.search(text) else text.split()
        known, word = self.known, self.word
        return sum([known[w] if w in known else word(w) for w in words])


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, under the vocabulary and scores of ``path``
    (a file that every worker has)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = UnigramCounter(piece_vocabulary(path))
        counter = _counters[path]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts = [counter.text(t) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        public_tokenizers.path("piece_bpe_32k.model"))
