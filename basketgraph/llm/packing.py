"""Operator 3: hierarchical multi-length packing into training sequences.

Each document's ids (byte-level BPE, then an end id) are cut into windows of the longest
context size; what is left over is routed to the smallest tier that holds it. Every tier is
packed best-fit-decreasing into windows of its own size. Gaps of long windows are filled
from the shorter tiers, the last piece of a window being cut to fit, so windows are full.
What is left at a partition's end is cut at powers of two, which need no padding either.
Full windows are dealt to step groups of equal token counts per tier.

Packing needs no shuffle: a partition of documents becomes a partition of sequences, and a
retried task gives the same pieces, because partition, order and rule are the same.
Sequence ids hold the partition number in the high bits. Open windows and waiting pieces are
bounded (POOL pieces), so memory does not grow with the partition; ids of a document live
only while it is cut.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each on
their own; a null doc_id is kept as null; very long texts become many windows; an empty table
gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

TIERS = (128, 256, 512, 1024)
END_ID = 0
POOL = 4096  # pieces that wait for a window, per tier
STEP_TOKENS = 32768  # tokens of a step group
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in
                    ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                     "tier", "step_group")])
_tokenizers: dict = {}


# Code points on which the two libraries' letter, number and space classes agree for good:
# Latin, Greek, Cyrillic, general punctuation, currency, kana, common Han, Hangul.
_STABLE = re.compile("[^\u0000-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u205e\u20a0-\u20ac"
                     "\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


class ByteBpe:
    """Ids as the tokenizers library gives them for ``<path>.json`` (add_special_tokens=False).

    Texts of common scripts go through the same vocabulary's rank file ``<path>.tiktoken``,
    which gives the same ids at several times the speed; any other text goes through the
    tokenizers library itself."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        ranks = {}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            for token, rank in map(bytes.split, lines):
                ranks[base64.b64decode(token)] = int(rank)
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.special = tuple(special)
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or not _stable(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _stable(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return _STABLE.search(text) is None


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text followed by END_ID; one tokenizer per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    ids = _tokenizers[path].ids(text)
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


class Packer:
    """Packs the documents of one partition; ``rows`` holds finished pieces."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, pool: int = POOL,
                 step_tokens: int = STEP_TOKENS):
        self.tiers, self.pool, self.step_tokens = sorted(tiers), pool, step_tokens
        self.top = self.tiers[-1]
        self.base = partition << 40
        self.made = 0
        self.filled = dict.fromkeys(self.tiers, 0)  # tokens dealt to step groups, by tier
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}  # (length, order, piece)
        self.order = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.top:
            self._close([(doc_id, at, ids[at: at + self.top], n)], self.top)
            at += self.top
        if at < n:
            self._wait((doc_id, at, ids[at:].copy(), n))

    def _wait(self, piece) -> None:
        tier = next(t for t in self.tiers if len(piece[2]) <= t)
        self.order += 1
        insort(self.waiting[tier], (len(piece[2]), self.order, piece))
        if len(self.waiting[tier]) >= self.pool:
            self._pack(self.pool // 2)

    def _take(self, gap: int, below: int):
        """The longest waiting piece of at most ``gap`` tokens, tiers up to ``below``."""
        for tier in [t for t in reversed(self.tiers) if t <= below]:
            queue = self.waiting[tier]
            k = bisect_right(queue, (gap, 1 << 62))
            if k:
                return queue.pop(k - 1)[2]
        return None

    def _pack(self, leave: int) -> None:
        """Fills windows, longest tier first, until at most ``leave`` pieces wait in each."""
        for tier in reversed(self.tiers):
            queue = self.waiting[tier]
            while len(queue) > leave:
                window, gap = [queue.pop()[2]], tier
                gap -= len(window[0][2])
                while gap and (piece := self._take(gap, tier)):
                    window.append(piece)
                    gap -= len(piece[2])
                if gap and (piece := self._shortest()):
                    doc_id, start, ids, n = piece
                    window.append((doc_id, start, ids[:gap], n))
                    self._wait_quietly((doc_id, start + gap, ids[gap:], n))
                    gap = 0
                if gap:  # nothing left to cut: this is the end of the partition
                    self._finish(window)
                else:
                    self._close(window, tier)

    def _shortest(self):
        for tier in self.tiers:
            if self.waiting[tier]:
                return self.waiting[tier].pop(0)[2]
        return None

    def _wait_quietly(self, piece) -> None:
        tier = next(t for t in self.tiers if len(piece[2]) <= t)
        self.order += 1
        insort(self.waiting[tier], (len(piece[2]), self.order, piece))

    def _finish(self, window) -> None:
        """Cuts a last, partly filled window at powers of two."""
        left = sum(len(p[2]) for p in window)
        while left:
            size = 1 << (left.bit_length() - 1)
            part, need = [], size
            while need:
                doc_id, start, ids, n = window[0]
                part.append((doc_id, start, ids[:need], n))
                got = min(need, len(ids))
                need -= got
                if got == len(ids):
                    window.pop(0)
                else:
                    window[0] = (doc_id, start + got, ids[got:], n)
            self._close(part, size)
            left -= size

    def _close(self, window, size: int) -> None:
        tier = next(t for t in self.tiers if size <= t)
        group = self.filled[tier] // self.step_tokens
        self.filled[tier] += size
        step = self.base + (group * len(self.tiers) + self.tiers.index(tier))
        at, seq = 0, self.base + self.made
        self.made += 1
        for doc_id, start, ids, n in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), n, seq, at, tier, step))
            at += len(ids)

    def end(self) -> None:
        self._pack(0)

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ARROW, strict=True)], schema=_ARROW)
            self.rows = []


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS,
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (window size class) and step_group. ``path``: the tokenizer's file, on every worker."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers, POOL, step_tokens)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                names = part.column(0).to_pylist()
                texts = part.column(1).fill_null("").to_pylist()
                for doc_id, text in zip(names, texts, strict=True):
                    packer.add(doc_id, token_ids(text, path))
                yield from packer.batches(20_000)
        packer.end()
        yield from packer.batches(1)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe())
