"""Operator 13: cross-tokenizer alignment by diagonal run skipping.

A text is encoded by a byte-level BPE (A) and by a sentencepiece model (B). Both token lists cut
the same bytes, so aligning them means comparing two ascending arrays of token ends. Most tokens
of a stretch end together, one to one: along such a diagonal the index shift between the arrays
stays the same. ``aligned_groups`` probes the diagonal with blocks of 1, 2, 4, 8 ... tokens and
jumps whole blocks that agree. At the first difference the group is irregular; two pointers
resolve it up to the next common end, which gives the new shift.

A link is a pair of overlapping tokens. Links never leave a group, and a group of n and m tokens
has n + m - 1 of them. How many documents hold an id pair linked is counted corpus-wide: every
task sums its own documents first (bounded, PAIRS_HELD, flushed when full), Spark adds the sums.
Each document's distinct pairs are kept in the shared folder and meet the counts afterwards: by a
broadcast if the counted pairs are few enough, by a shuffle join otherwise.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte for byte
(B turns U+2581 into a space), have no tokens: zeros and an empty digest. Repeated rows and null
ids are documents of their own, each counted. Special tokens' strings are plain text. Very long
texts are aligned whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _stable
from .tables import kept, small, small_batches

PAIRS_HELD = 1_000_000
MARK = "▁"
_pairs: dict = {}


def aligned_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs of groups (i, j, n, m) in order, from A's token i and B's j: m = 0: n groups of one
    token each; otherwise one group of n and m tokens."""
    out = []
    i = j = 0
    size = len(ends_a)
    while i < size:
        width, start = 1, i
        shift = j - i
        while i < size and ends_a[i] == ends_b[i + shift]:
            i += 1
            # the diagonal holds: probe blocks that double, and halve at the first difference
            while i < size and ends_a[i: i + width] == ends_b[i + shift: i + shift + width]:
                i = min(size, i + width)
                width *= 2
            while width > 1:
                width //= 2
                if ends_a[i: i + width] == ends_b[i + shift: i + shift + width]:
                    i = min(size, i + width)
        if i > start:
            out.append((start, start + shift, i - start, 0))
        if i == size:
            break
        j = i + shift
        a, b = i, j
        x, y = ends_a[a], ends_b[b]
        while x != y:
            if x < y:
                a += 1
                x = ends_a[a]
            else:
                b += 1
                y = ends_b[b]
        out.append((i, j, a + 1 - i, b + 1 - j))
        i, j = a + 1, b + 1
    return out


def byte_level(token: str) -> bytes:
    """Bytes of a byte-level token: printable bytes stand for themselves, the others for the
    code points from 256 on, in order."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_alphabet() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_BYTE_OF = _byte_alphabet()


class TokenizerPair:
    """Ids and token lengths of a text under both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path_a)
        self.exact.encode_special_tokens = True
        with open(path_a.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = {i: t.content for i, t in self.exact.get_added_tokens_decoder().items()}
        entries = {i: t for t, i in self.exact.get_vocab().items()}
        self.bytes_a = [special[i].encode() if i in special else byte_level(entries[i]) if i in entries else b""
                        for i in range(max(entries) + 1)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(MARK, " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # every id as text before each separator, in rows of one width
        ids = [f"{i}{sep}" for seps, side in ((",|", self.bytes_a), (",;", self.bytes_b)) for sep in seps for i in range(len(side))]
        width = max(map(len, ids))
        self.shown = np.frombuffer("".join(x.ljust(width, "\0") for x in ids).encode(), np.uint8).reshape(-1, width)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of space+text and of text; None where either doesn't give back the bytes."""
        some = [t for t in texts if t]
        ids_b = iter(self.pieces.encode(some, num_threads=1) if some else [])
        for text in texts:
            if not text:
                yield None
                continue
            whole, b = " " + text, next(ids_b)
            a = self.fast.encode_ordinary(whole) if _stable(text) else self.exact.encode(whole, add_special_tokens=False).ids
            data = whole.encode()
            same = b"".join([self.bytes_a[k] for k in a]) == data and b"".join([self.bytes_b[k] for k in b]) == data
            yield (a, b) if same else None


def links_and_groups(pair: TokenizerPair, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """(index in A, index in B) of every link in order, the number of groups, and the groups as
    ``a1,a2|b1;a3|b2,b3``."""
    ends_a, ends_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    runs = np.array(aligned_groups(ends_a.tolist(), ends_b.tolist()), np.int64)
    i, j, n, m = runs.T
    single, odd = m == 0, m > 0
    # tokens that don't end their group: all but the last of an irregular one
    inner_a, inner_b = _spans(i[odd], n[odd] - 1), _spans(j[odd], m[odd] - 1)
    last_a, last_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
    last_a[inner_a], last_b[inner_b] = 0, 0
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_groups = int(last_a.sum())
    # the groups in order, A's side before B's
    size_a, size_b = len(pair.bytes_a), len(pair.bytes_b)
    before_b = np.cumsum(np.bincount(group_b, minlength=n_groups)) - np.bincount(group_b, minlength=n_groups)
    upto_a = np.cumsum(np.bincount(group_a, minlength=n_groups))
    rows = np.empty(len(ids_a) + len(ids_b), np.int64)
    rows[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + size_a * last_a
    rows[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * size_a + ids_b + size_b * last_b
    text = pair.shown[rows].ravel()
    # links: one to one in a run; in an irregular group every end of either side closes one
    at_a, at_b = [_spans(i[single], n[single])], [_spans(j[single], n[single])]
    closing = np.sort(np.concatenate([ends_a[inner_a], ends_b[inner_b], ends_a[i[odd] + n[odd] - 1]]))
    at_a.append(np.searchsorted(ends_a, closing))
    at_b.append(np.searchsorted(ends_b, closing))
    return np.concatenate(at_a), np.concatenate(at_b), n_groups, text[text != 0][:-1].tobytes()


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, end to end."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)


class PairCounts:
    """Documents by id pair, of one task; arrays of sorted pairs and counts when full."""

    def __init__(self, most: int = PAIRS_HELD):
        self.most, self.held, self.rows = most, [], 0
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.held.append(distinct)
        self.rows += len(distinct)
        if self.rows < self.most:
            return None
        self._merge()
        return self.flush() if len(self.pairs) >= self.most else None

    def _merge(self) -> None:
        every = np.concatenate([self.pairs, *self.held])
        weight = np.concatenate([self.counts, np.ones(len(every) - len(self.pairs), np.int64)])
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.pairs, self.counts = every[first], np.add.reduceat(weight, first) if len(first) else weight
        self.held, self.rows = [], 0

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self._merge()
        out = self.pairs, self.counts
        self.pairs, self.counts = self.pairs[:0], self.counts[:0]
        return out


_COLUMNS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
            ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())),
            ("times", pa.list_(pa.int64())), ("counted", pa.bool_())]
_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<long>, counted boolean")


def aligned(docs: DataFrame, path_a: str, path_b: str, bits_b: int) -> DataFrame:
    """One row a document with its distinct linked pairs (a << bits_b | b) and how often each is
    linked there; and rows with ``counted``: pairs and in how many of a task's documents."""
    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS, strict=True)],
                                          names=[n for n, _ in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _pairs:
            _pairs[path_a, path_b] = TokenizerPair(path_a, path_b)
        pair = _pairs[path_a, path_b]
        counts = PairCounts()
        rows: list[tuple] = []
        waiting = 0

        def partial(full):
            return (None,) * 6 + (full[0], full[1], True)

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                encoded = pair.encode(part.column(1).to_pylist())
                for doc_id, got in zip(part.column(0).to_pylist(), encoded, strict=True):
                    if got is None:
                        rows.append((doc_id, 0, 0, 0, 0, "", [], [], False))
                        continue
                    ids_a, ids_b = (np.array(x, np.int64) for x in got)
                    at_a, at_b, n, shown = links_and_groups(pair, ids_a, ids_b)
                    distinct, times = np.unique(ids_a[at_a] << bits_b | ids_b[at_b], return_counts=True)
                    rows.append((doc_id, len(ids_a), len(ids_b), n, len(at_a), hashlib.sha256(shown).hexdigest(),
                                 distinct, times, False))
                    waiting += len(distinct)
                    if (full := counts.add(distinct)) is not None:
                        rows.append(partial(full))
                        waiting += len(full[0])
                    if waiting > 300_000:
                        yield rows_of(rows)
                        rows, waiting = [], 0
        full = counts.flush()
        if len(full[0]):
            rows.append(partial(full))
        if rows:
            yield rows_of(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def pair_counts(table: DataFrame, bits_b: int) -> DataFrame:
    """(pair, count, best): documents that hold an id pair linked, and whether no pair of its A id
    has more. ``table``: as ``aligned`` gives it."""
    total, _ = kept(table.where("counted").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
                    .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")), "pair-counts")
    a = F.shiftright("pair", bits_b)
    top = total.groupBy(a.alias("a")).agg(F.max("count").alias("top"))
    return total.join(top, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    ``path_a``: a byte-level BPE (.json, its .tiktoken beside it), ``path_b``: a sentencepiece
    model; files that the driver and every worker have."""
    import sentencepiece

    small_batches(docs.sparkSession)
    bits_b = max(1, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size() - 1).bit_length()
    table, _ = kept(aligned(docs, path_a, path_b, bits_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts, seen = kept(pair_counts(table, bits_b), "pairs")
    links = (table.where("not counted").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
             .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")))
    sums = (links.join(small(counts, seen["rows"], 40), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("count")).alias("count_sum"))
            .select(F.col("row").alias("r"), "n_best", "count_sum"))
    out = table.where("not counted").drop("pairs", "times", "counted").join(sums, F.col("row") == F.col("r"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                      F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
