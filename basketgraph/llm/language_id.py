"""Operator 11: language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text becomes a suffix automaton, which accepts every
substring of the sample. A text is parsed against each automaton: every phrase is the longest
match from where the last one ended, and a character the sample lacks is a phrase alone. The
better a sample predicts a text, the fewer phrases it needs; phrases * log2(sample length) / text
length estimates the cross entropy in bits a character (Ziv and Merhav, 1993), which makes samples
of different lengths comparable. The language that needs the fewest bits wins.

Texts are compared as their words (runs of letters and marks, lower-cased one by one) joined by
single spaces. Long texts are parsed in runs of RUN characters, each from the automaton's root,
so that many runs of many texts advance one character at a time together in all automata; a run
costs at most one phrase more in every language.

The sample: per language at most SAMPLE_DOCS documents by the hash of their id, in that order up to
SAMPLE_CHARS characters (less if all languages would exceed TOTAL_CHARS). An automaton has at
most three edges a character, so the broadcast table has a bound. Scoring is a map over whole
texts, without a shuffle.

Defined cases: null texts and texts without letters are ``und`` with score 0, as is every text if
no language was learned; with one language its score is 1; rows with a null id or a null lang are
predicted, never learned, and a null id is not held out; ties go to the smaller language by code
point; repeated rows are each predicted, and learned once; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches
from .text import slices

RUN = 1024
SAMPLE_CHARS = 1 << 15
SAMPLE_DOCS = 256
TOTAL_CHARS = 1 << 20
UNDETERMINED = "und"
BOUNDARY = 0  # between the documents of a sample; no text holds it
SPACE = 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_codes = np.full(0x110000, -1, np.int32)  # lower-cased letter or mark, 0: anything else
_letters = np.zeros(0x110000, bool)


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts' words end to end, first of each text, has the text a letter)."""
    first = np.concatenate([[0], np.cumsum([len(t) if t else 0 for t in texts])]).astype(np.int64)
    points = np.frombuffer("".join([t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    for p in np.flatnonzero(seen & (_codes < 0)):
        c = chr(p)
        _letters[p] = c.isalpha()
        lower = c.lower() if len(c.lower()) == 1 else c
        _codes[p] = ord(lower) if _letters[p] or unicodedata.category(c).startswith("M") else 0
    codes = _codes[points]
    inside = codes > 0
    before = np.concatenate([[0], np.cumsum(inside)])
    begun = before[:-1] > np.repeat(before[first[:-1]], np.diff(first))  # a word of this text came before
    follows = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = first[1:][np.diff(first) > 0] - 1
    follows[ends] = False
    space = ~inside & follows & begun
    codes = np.where(space, SPACE, codes)[inside | space]
    kept = np.concatenate([[0], np.cumsum(inside | space)])
    n_letters = np.concatenate([[0], np.cumsum(_letters[points])])
    return codes, kept[first], np.diff(n_letters[first]) > 0


def automaton(sample: list[int]) -> list[dict[int, int]]:
    """Edges of the suffix automaton of ``sample`` by state; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in sample:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # split q: the shorter of its substrings also end here
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        last = new
    return edges


class CrossParser:
    """The automata of all languages in one open-addressing table: (state, character) -> state."""

    def __init__(self, samples: dict[str, list[int]]):
        self.languages = sorted(samples)
        self.bits = np.array([np.log2(max(2, len(samples[k]))) for k in self.languages])
        roots, keys, targets = [], [], []
        states = 0
        for name in self.languages:
            edges = automaton(samples[name])
            roots.append(states)
            for state, out in enumerate(edges):
                for c, target in out.items():
                    keys.append((states + state) << 21 | c)
                    targets.append(states + target)
            states += len(edges)
        self.roots = np.array(roots, np.int64)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.targets = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        key, target = np.array(keys, np.int64), np.array(targets, np.int32)
        at = self._slot(key)
        while len(key):  # linear probing: of keys that meet in a free slot one stays
            free = self.keys[at] < 0
            place, one = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[one]
            self.keys[place], self.targets[place] = key[took], target[took]
            rest = np.ones(len(key), bool)
            rest[took] = False
            key, target, at = key[rest], target[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after a character; -1 where no substring goes on with it."""
        key = state << 21 | c
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.targets[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        at = at[left]
        while len(left):  # the places after a collision
            at = (at + 1) & (len(self.keys) - 1)
            found, wanted = self.keys[at], key[left]
            hit = found == wanted
            out[left[hit]] = self.targets[at[hit]]
            more = ~hit & (found >= 0)
            left, at = left[more], at[more]
        return out

    def phrases(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language: (text, language)."""
        size = np.diff(first)
        n_runs = -(-size // RUN)
        owner = np.repeat(np.arange(len(size)), n_runs)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        start = first[:-1][owner] + number * RUN
        length = np.minimum(RUN, first[1:][owner] - start)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        k, runs = len(self.languages), len(owner)
        root = self.roots[:, None]
        state = np.repeat(root, runs, axis=1)
        count = np.zeros((k, runs), np.int64)
        active = np.searchsorted(-length, -np.arange(RUN), "left")  # runs longer than each position
        for t in range(int(length[0]) if runs else 0):
            n = active[t]
            c = np.broadcast_to(codes[start[:n] + t].astype(np.int64), (k, n)).ravel()
            now = state[:, :n].ravel()
            after = self.step(now, c)
            missed = np.flatnonzero(after < 0)
            if len(missed):
                base = self.roots[missed // n]
                again = self.step(base, c[missed])
                unknown = again < 0
                at = count[:, :n].ravel()
                at[missed] += (now[missed] != base).astype(np.int64) + unknown
                count[:, :n] = at.reshape(k, n)
                after[missed] = np.where(unknown, base, again)
            state[:, :n] = after.reshape(k, n)
        count += state != root  # the phrase still open
        return np.stack([np.bincount(owner, count[j], len(size)) for j in range(k)], axis=1) if k else np.zeros((len(size), 0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, first, lettered = normalised(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = self.phrases(codes, first) * self.bits / np.maximum(1, np.diff(first))[:, None]
        best = np.argmin(bits, axis=1)
        least = np.take_along_axis(bits, best[:, None], 1)[:, 0]
        if len(self.languages) > 1:
            second = np.partition(bits, 1, axis=1)[:, 1]
            score = second / np.maximum(least + second, 1e-300)
        else:
            score = np.ones(len(texts))
        return ([self.languages[b] if some else UNDETERMINED for b, some in zip(best, lettered, strict=True)],
                np.where(lettered, score, 0.0))


def training_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
                     total_chars: int = TOTAL_CHARS) -> dict[str, list[int]]:
    """Normalised labelled text by language. ``docs``: doc_id, text, lang."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    chars = max(256, min(sample_chars, total_chars // len(sizes)))
    hashed = F.xxhash64("doc_id")
    # about twice as many documents as wanted, from one row a language
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 2 * sample_docs / n)) for k, n in sizes.items()],
                                              "l_lang string, share double")
    drawn = (usable.join(F.broadcast(share), F.col("lang") == F.col("l_lang"))
             .where(F.pmod(hashed, F.lit(1 << 30)) < F.col("share") * (1 << 30))
             .groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, chars)).alias("text")))
    order = Window.partitionBy("lang").orderBy(F.pmod(hashed, F.lit(1 << 30)), "doc_id")
    rows = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs).orderBy("lang", "k").collect()
    samples: dict[str, list[int]] = {}
    for row in rows:
        sample = samples.setdefault(row["lang"], [])
        if len(sample) < chars:
            codes, _, lettered = normalised([row["text"]])
            if lettered[0]:
                sample += ([BOUNDARY] if sample else []) + codes.tolist()
                del sample[chars:]
    return {k: v for k, v in samples.items() if v}


def identify(docs: DataFrame, samples: dict[str, list[int]]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                names, score = parser.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double")


def predict_languages(docs: DataFrame, **bounds: int) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Rows whose id's checksum leaves 2
    when divided by 4 are held out of learning. ``bounds``: of the sample."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = identify(narrow, training_samples(narrow.where(~held), **bounds))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_language_id(spark, sf_dir):
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
