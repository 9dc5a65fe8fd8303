"""Operator 2: n-gram Jaccard join by a partition of the hash universe.

A document's set holds the 64-bit hashes of its distinct n-word shingles. Sets of a size band
cut the hash universe into the same m segments. Two sets of sizes s <= l with similarity p/q
differ in at most H(s, l) hashes, so of segments whose allocations (1, or 2 with one-deletion
neighbourhoods) add up to H + 1, at least one has fewer differences than its allocation: the
two sets share that segment's signature, or a signature with one hash left out. A set indexes
only the first segments its own sizes need, a prefix that both sides agree on.

Segments that are empty say nothing and are not indexed. ``slack`` extra units make up for
them; a set that loses more units than that indexes its empty segments as well, and of two
such sets both do, so no link is lost. The slack follows the band: larger sets have more empty
segments, and the mean loss with a few deviations covers nearly all of them. Per band the number
of two-unit segments and the slack are chosen by cost: signatures written, against candidates
expected from sets that lose more than the slack (from the number of documents in the band).

Candidates are verified exactly on the sets. In a bucket every member is first compared with
the smallest one only; links make components; a bucket whose members then lie in one component
is settled. Of the other buckets a spanning forest of the pairs that sketches let pass is
verified next, at most one pair less than a bucket has components. Only pairs of a bucket
still in different components are all compared after that. So a group of n near copies costs
about n comparisons, exact copies are one set from the start, and no link between different
components goes unseen.

Defined cases: null or empty text: no shingles, linked with nothing; rows with a null doc_id
take no part and have a null component; repeated rows are equal sets and so one component;
documents of fewer than n words are one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import document_key
from .source_mix import n_words
from .tables import components, dropped, kept, small, small_batches, tucked
from .text import mix, set_fingerprint, shingles, slices, text_buffer, word_hashes
from .vectors import grouped

BAND_RATIO = 1.4
HOT_ROWS = 100_000
BLOCK = 512
SKETCH = 1024  # bits
WEAK_COST = 4  # of a signature of one hash, in signatures


def differences(s, l, p: int, q: int):
    """Sets of sizes s and l with similarity at least p/q differ in no more elements; grows
    with both sizes."""
    return (q - p) * (s + l) // (p + q)


def _poisson_above(mean: float, limit: int) -> float:
    """Chance of more than ``limit`` events where ``mean`` are expected."""
    if mean > 50:
        return 0.5 * math.erfc((limit + 0.5 - mean) / math.sqrt(2 * mean))
    return max(0.0, 1 - sum(math.exp(-mean) * mean ** i / math.factorial(i) for i in range(limit + 1)))


class Bands:
    """Size bands and each band's allocation: m segments, the first k of two units."""

    def __init__(self, p: int, q: int, counts: dict[int, int], longest: int):
        self.p, self.q = p, q
        self.low, self.high = [1], []
        while True:
            self.high.append(max(self.low[-1], int(self.low[-1] * BAND_RATIO)))
            if self.high[-1] * p >= longest * q:
                break
            self.low.append(self.high[-1] + 1)
        self.low, self.high = np.array(self.low), np.array(self.high)
        plan = [self._allocate(g, counts) for g in range(len(self.low))]
        self.m, self.k, self.slack = (np.array(x) for x in zip(*plan, strict=True))

    def band(self, size):
        return np.searchsorted(self.high, size)

    def _allocate(self, g: int, counts: dict[int, int]) -> tuple[int, int, int]:
        low, high = int(self.low[g]), int(self.high[g])
        units = differences(high, high, self.p, self.q) + 1
        n = sum(c for size, c in counts.items() if size == g)
        # sizes that index this band: its own, and partners of the band below
        sizes = np.unique(np.linspace(max(1, -(-low * self.p // self.q)), high, 9).astype(np.int64))
        most = np.minimum(sizes * self.q // self.p, high)
        wanted = np.where(most >= low, differences(sizes, most, self.p, self.q) + 1, 1)
        best = None
        for k in range(0, min(units, 3) + 1):
            slacks, spread = set(range(7)), 0
            for deviations in (1, 2, 3, 4, 5):  # slack that covers the mean loss and so many deviations
                for _ in range(8):
                    mean = self._lost(sizes, wanted + spread, units + spread - k, k)
                    spread = math.ceil(mean + deviations * math.sqrt(mean))
                slacks.add(spread)
            for slack in sorted(slacks):
                m = units + slack - k
                if m < max(1, k):  # the two-unit segments are among the m
                    continue
                lost = _poisson_above(self._lost(sizes, wanted + slack, m, k), slack)
                weak = low * math.exp(-low / m)  # segments of one hash, which many sets may share
                cost = (m - k) + k * (1 + high / m) + WEAK_COST * weak + (4 + high / 16) * n * lost * lost
                if best is None or cost < best[0]:
                    best = (cost, m, k, slack)
        return best[1:]

    @staticmethod
    def _lost(sizes: np.ndarray, units: np.ndarray, m: int, k: int) -> float:
        """Units that a set loses to empty segments (and lone hashes of two-unit ones) on
        average, at the size of the band that loses most."""
        fill = sizes / max(1, m)
        two = np.minimum(k, units / 2)
        one = np.minimum(m, units - two) - two
        return float(np.max(np.exp(-fill) * (np.maximum(one, 0) + two * (2 + fill))))

    def needed(self, size, g):
        """Units a set must index in band g (0: it can link with none but equal sets)."""
        most = np.minimum(size * self.q // self.p, self.high[g])
        h = differences(size, most, self.p, self.q)
        return np.where((h > 0) & (most >= self.low[g]), h + 1 + self.slack[g], 0)


def signatures(hashes: np.ndarray, pointer: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of every indexed segment and neighbour."""
    size = np.diff(pointer)
    owners, out = [], []
    own = bands.band(np.maximum(size, 1))
    for step in (0, 1):
        g = np.minimum(own + step, len(bands.low) - 1)
        units = np.where((size > 0) & (own + step < len(bands.low)), bands.needed(size, g), 0)
        m, k = bands.m[g], np.minimum(bands.k[g], -(-units // 2))
        # the first k segments count two units each
        prefix = np.where(units <= 2 * k, -(-units // 2), k + units - 2 * k)
        prefix = np.minimum(prefix, m) * (units > 0)
        owner = np.repeat(np.arange(len(size)), size)
        segment = ((hashes >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        keep = segment < prefix[owner]
        h, owner, segment = hashes[keep], owner[keep], segment[keep]
        first = np.concatenate([[0], np.cumsum(prefix)])
        place = first[owner] + segment
        if len(place) == 0:
            continue
        mixed = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        run = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
        ends = np.append(starts[1:], len(place))
        total, count = run[ends] - run[starts], ends - starts
        so, ss = owner[starts], segment[starts]

        def sign(total, band, segment):
            return mix(total ^ mix(band.astype(np.uint64) * np.uint64(1 << 32) + segment.astype(np.uint64)))

        owners.append(so)
        out.append(sign(total, g[so], ss))
        # units lost to empty segments and to lone hashes of two-unit segments
        two = np.minimum(k, prefix)
        filled = np.bincount(so, minlength=len(size))
        filled_two = np.bincount(so[ss < two[so]], minlength=len(size))
        lone_two = np.bincount(so[(ss < two[so]) & (count == 1)], minlength=len(size))
        lost = (prefix - two) - (filled - filled_two) + 2 * (two - filled_two) + lone_two
        over = lost > bands.slack[g]
        # one-deletion neighbours: the segment's sum without one hash
        group = np.repeat(np.arange(len(starts)), count)
        left_out = (segment < two[owner]) & ((count[group] > 1) | over[owner])
        owners.append(owner[left_out])
        out.append(sign(total[group[left_out]] - mixed[left_out], g[owner[left_out]], segment[left_out]))
        for d in np.flatnonzero(over):
            gaps = np.setdiff1d(np.arange(prefix[d]), ss[so == d])
            owners.append(np.full(len(gaps), d))
            out.append(sign(np.zeros(len(gaps), np.uint64), np.full(len(gaps), g[d]), gaps))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(out)


def _sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    words, pointer, _, _ = word_hashes(*text_buffer(part.column(part.schema.get_field_index("text"))))
    return shingles(words, pointer, n)


def indexed(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(doc_id, key, n_shingles, cid, sigs): each document's set size, fingerprint (null: no set)
    and signatures. Of equal sets of a partition only the first carries signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, pointer = _sets(part, n)
                size = np.diff(pointer)
                cid = set_fingerprint(hashes, pointer).view(np.int64)
                known = np.asarray(part.column(0).is_valid()) & (size > 0)
                new = np.zeros(len(size), bool)
                for i in np.flatnonzero(known):
                    if int(cid[i]) not in seen:
                        seen.add(int(cid[i]))
                        new[i] = True
                # sets to sign, end to end
                takes = np.repeat(new, size)
                counts = size[new]
                owner, sig = signatures(hashes[takes], np.concatenate([[0], np.cumsum(counts)]), bands)
                numbers = np.flatnonzero(new)[owner]
                order = np.argsort(numbers, kind="stable")
                ends = np.searchsorted(numbers[order], np.arange(len(size) + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(cid, pa.int64(), mask=~known),
                     pa.ListArray.from_arrays(ends.astype(np.int32), sig[order].view(np.int64))],
                    names=["doc_id", "key", "n_shingles", "cid", "sigs"])

    return docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key long, n_shingles long, cid long, sigs array<long>")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(cid, size, bits, hashes) of each document. bits: parities of the hashes by their value
    modulo a power of two (SKETCH, or the set's size if that is more), so two sets differ in
    at least as many hashes as their sketches in bits, a longer one folded to the shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, pointer = _sets(part, n)
                size = np.diff(pointer)
                width = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
                first = np.concatenate([[0], np.cumsum(width)])
                owner = np.repeat(np.arange(len(size)), size)
                at = first[owner] + (mix(hashes).view(np.int64) & (width[owner] - 1))
                parity = (np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8)
                words = np.packbits(parity, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_fingerprint(hashes, pointer).view(np.int64)), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays((first // 64).astype(np.int32), words),
                     pa.ListArray.from_arrays(pointer.astype(np.int32), hashes.view(np.int64))],
                    names=["cid", "size", "bits", "hashes"])

    return docs.mapInArrow(run, "cid long, size long, bits array<long>, hashes array<long>")


def buckets(rows: DataFrame, n_sets: int, hot_rows: int) -> DataFrame:
    """(sig, cid, center) of signatures that several sets share; center is a member of the
    bucket that this one is compared with first (its smallest, or in a hot bucket the
    smallest of a salt, and those with the smallest of all)."""
    def star(part: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("cid")
        return part.withColumn("center", F.first("cid").over(w)).withColumn("next", F.lead("cid").over(w))

    shared = (F.col("cid") != F.col("center")) | (F.col("next") != F.col("cid"))
    if n_sets <= hot_rows:
        return star(rows, "sig").where(shared).select("sig", "cid", "center")
    fraction = min(1.0, 1000 / hot_rows)
    counted = rows.sample(fraction=fraction, seed=11).groupBy("sig").count().where(F.col("count") > 500)
    hot, seen = kept(counted.select("sig"), "hot-signatures")
    if not seen["rows"]:
        return star(rows, "sig").where(shared).select("sig", "cid", "center")
    hot = small(hot, seen["rows"], 16)
    cold = star(rows.join(hot, "sig", "left_anti"), "sig").where(shared).select("sig", "cid", "center")
    salted = star(rows.join(hot, "sig", "left_semi").withColumn("salt", F.pmod("cid", F.lit(64))), "sig", "salt")
    tops = star(salted.where("cid = center").select("sig", "cid").distinct(), "sig")
    return cold.union(salted.select("sig", "cid", "center")).union(tops.select("sig", "cid", "center")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, seen: dict, p: int, q: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have similarity at least p/q. Sizes and sketches
    rule most others out before the sets themselves are joined."""
    def side(x: str, *columns: str) -> DataFrame:
        return sets.select(F.col("cid").alias(x), *[F.col(c).alias(c + x) for c in columns])

    fold = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (x, y) -> x ^ y)"
    fit = "if(size({0}) > size({1}), " + fold + ", {0})"
    differ = F.expr(f"aggregate(zip_with({fit.format('bitsa', 'bitsb')}, {fit.format('bitsb', 'bitsa')}, "
                    "(x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    most = F.expr(f"sizea + sizeb - 2 * (({p} * (sizea + sizeb) + {p + q - 1}) div {p + q})")
    likely = (pairs.join(small(side("a", "size", "bits"), seen["sketch_bytes"] or 0, 1), "a")
              .join(small(side("b", "size", "bits"), seen["sketch_bytes"] or 0, 1), "b")
              .where(f"least(sizea, sizeb) * {q} >= greatest(sizea, sizeb) * {p}").where(differ <= most)
              .select("a", "b", F.expr("sizea + sizeb").alias("sizes")))
    both = F.size(F.array_intersect("hashesa", "hashesb"))
    return (likely.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b")
            .where(both * (p + q) >= F.col("sizes") * p).select("a", "b"))


def likely_pairs(size: np.ndarray, bits: np.ndarray, root: np.ndarray, side: np.ndarray, cross: np.ndarray,
                 starts: np.ndarray, ends: np.ndarray, p: int, q: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one group, of different components (in a cross group also of different
    sides), that sizes and sketches do not rule out. forest: of these only as many as join
    the components of each group that any of them join."""
    label = root.copy() if forest else root

    def alike(a, b):
        ok = label[a] != label[b]
        ok &= np.minimum(size[a], size[b]) * q >= np.maximum(size[a], size[b]) * p
        ok &= ~cross[a] | (side[a] != side[b])
        a, b = a[ok], b[ok]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        ok = differ <= differences(size[a], size[b], p, q)
        return a[ok], b[ok]

    found = []
    length = ends - starts
    group = np.repeat(np.arange(len(starts)), length)
    few = np.flatnonzero((length <= 64)[group])
    for d in range(1, int(min(64, length.max(initial=1)))):
        a = few[few + d < len(size)]
        a = a[group[a] == group[a + d]]
        if not len(a):
            break
        a, b = alike(a, a + d)
        if forest:
            needed = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                if label[x] != label[y]:
                    needed[k] = True
                    own = label[starts[group[x]]: ends[group[x]]]
                    own[own == label[y]] = label[x]
            a, b = a[needed], b[needed]
        found.append((a, b))
    for r in np.flatnonzero(length > 64):
        for i in range(starts[r], ends[r] - 1):
            b = np.arange(i + 1, ends[r])
            a, b = alike(np.full(len(b), i), b)
            if forest and len(b):
                joined, one = np.unique(label[b], return_index=True)
                a, b = a[one], b[one]
                own = label[starts[r]: ends[r]]
                own[np.isin(own, joined)] = label[i]
            found.append((a, b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cross_pairs(rows: DataFrame, sets: DataFrame, seen: dict, p: int, q: int, forest: bool) -> DataFrame:
    """Distinct (a, b), a < b, of sets that share a signature but no component, less those
    that sizes and sketches rule out; with ``forest`` a spanning forest of them. ``rows``: sig, cid, root, n (rows of the signature). A
    large bucket is compared in pairs of blocks, each within one task; pairs ruled out are
    never written."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    sketch = sets.select(F.col("cid").alias("c"), "size", "bits")
    dealt = (rows.join(small(sketch, seen["sketch_bytes"] or 0, 1), F.col("cid") == F.col("c"))
             .withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "root", "size", "bits"))
    keys = ["sig", "i", "j"]

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        size, root, side, cid = (table.column(c).to_numpy() for c in ("size", "root", "side", "cid"))
        cross = table.column("i").to_numpy() != table.column("j").to_numpy()
        lists = table.column("bits").combine_chunks()
        flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        at = at - at[0]
        ends = np.append(starts[1:], table.num_rows)
        width = np.minimum.reduceat(np.diff(at), starts)  # of a group, longer sketches folded to it
        found = []
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            at_row = np.concatenate([np.arange(starts[g], ends[g]) for g in of])
            bits = np.stack([np.bitwise_xor.reduce(flat[at[r]: at[r + 1]].reshape(-1, w), axis=0) for r in at_row])
            length = (ends - starts)[of]
            last = np.cumsum(length)
            a, b = likely_pairs(size[at_row], bits, root[at_row], side[at_row], cross[at_row], last - length, last, p, q, forest)
            found.append((cid[at_row[a]], cid[at_row[b]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(a):
            return None
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "side")
            .mapInArrow(lambda batches: grouped(batches, keys, work, BLOCK * 8), "a long, b long").distinct())


def near_groups(docs: DataFrame, n: int, p: int, q: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id; links join documents whose sets
    of n-word shingles have similarity at least p/q. ``docs``: doc_id, text."""
    rooted = rooted_documents(docs, n, p, q, hot_rows).drop("key")
    least, seen = kept(
        rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("root").alias("r"), "least"), "least")
    return (rooted.join(small(least, seen["rows"], 16), F.col("root") == F.col("r"), "left")
            .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")))


def distinct_documents(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """``docs`` with one document of each group: the smallest doc_id, of repeated ids the
    smallest text hash, of repeated rows one. Documents without words or id all stay."""
    plain, restored = tucked(docs, "doc_id", "text")
    rooted, _ = kept(rooted_documents(plain, n, p, q).where("root is not null").select("doc_id", "key", "root"), "rooted")
    best, n_best = kept(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select(F.col("root").alias("r"), F.col("best.key").alias("best")), "best")
    inside = rooted.join(small(best, n_best["rows"], 24), F.col("root") == F.col("r"))
    gone, n_gone = kept(inside.where("key <> best").select(F.col("key").alias("k")).distinct(), "gone")
    twice, n_twice = kept(inside.where("key = best").groupBy("key").count().where("count > 1")
                          .select(F.col("key").alias("k")), "twice")
    own = plain.withColumn("own_key", document_key())
    out = own.join(small(gone, n_gone["rows"], 16), F.col("own_key") == F.col("k"), "left_anti")
    if n_twice["rows"]:
        again = small(twice, n_twice["rows"], 16)
        same = F.col("own_key") == F.col("k")
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["own_key"]))
    return restored(out)


def rooted_documents(docs: DataFrame, n: int, p: int, q: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, key, n_shingles, root): rows of one component have one root (null: no set)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", document_key())
    size = F.greatest(n_words() - (n - 1), F.least(n_words(), F.lit(1)))
    reach = Bands(p, q, {}, 1 << 40)
    by_size = F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1.05)).alias("step")
    histogram = docs.groupBy(by_size).agg(F.count(F.lit(1)).alias("c"), F.max(size).alias("most")).collect()
    counts: dict[int, int] = {}
    for row in histogram:
        g = int(reach.band(max(1, row["most"])))
        counts[g] = counts.get(g, 0) + row["c"]
    bands = Bands(p, q, counts, max([row["most"] for row in histogram], default=1))

    signed, seen = kept(indexed(docs, n, bands), "signatures")
    rows = signed.where("size(sigs) > 0").select(F.explode("sigs").alias("sig"), "cid")
    shared, n_shared = kept(buckets(rows, seen["rows"], hot_rows), "buckets")
    table, _ = kept(signed.select("doc_id", "key", "n_shingles", "cid"), "documents")
    dropped(signed)
    members = shared.select("cid").union(shared.select(F.col("center").alias("cid"))).distinct()
    one = (table.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
           .join(members, "cid", "left_semi"))
    one, n_one = kept(one, "candidates")
    texts = docs.join(small(one.select("doc_id").distinct(), n_one["rows"], 16), "doc_id", "left_semi")
    sketch_bytes = F.sum(F.size("bits") * 8 + 40)
    sets, n_sets = kept(shingle_sets(texts, n).join(small(one.select("cid"), n_one["rows"], 16), "cid", "left_semi"),
                        "sets", sketch_bytes=sketch_bytes)
    if n_sets["rows"] > n_one["rows"]:  # one doc_id a set, so only repeated rows give a set twice
        sets, n_sets = kept(sets.dropDuplicates(["cid"]), "distinct-sets", sketch_bytes=sketch_bytes)

    star = shared.where("cid <> center").select(F.col("center").alias("a"), F.col("cid").alias("b")).distinct()
    links, n_links = kept(verified(star, sets, n_sets, p, q), "links")
    roots, n_roots = kept(components(links), "roots")
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for forest in (True, False):
        named = (shared.select("sig", "cid").join(small(roots, n_roots["rows"], 24), F.col("cid") == F.col("node"), "left")
                 .select("sig", "cid", F.coalesce("root", "cid").alias("root")).distinct())
        open_sigs = (named.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
                     .where("n > 2 and r0 <> r1").select("sig", "n"))
        rest, n_rest = kept(named.join(open_sigs, "sig"), "unsettled")
        if not n_rest["rows"]:
            break
        new = cross_pairs(rest, sets, n_sets, p, q, forest).join(tried, ["a", "b"], "left_anti")
        more, n_more = kept(verified(new, sets, n_sets, p, q), "more-links")
        if n_more["rows"]:
            links = links.union(more)
            roots, n_roots = kept(components(links), "roots")

    dropped(sets, shared, one)
    r = small(roots, n_roots["rows"], 24)
    return (table.select("doc_id", "key", "n_shingles", "cid").join(r, F.col("cid") == F.col("node"), "left")
            .select("doc_id", "key", "n_shingles", F.coalesce("root", "cid").alias("root")))


def op2_jaccard_join(spark, sf_dir):
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)
