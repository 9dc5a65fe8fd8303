"""Operator 9: mix sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / quality`` with u drawn from its id and text,
so reruns agree and better documents tend to come first. A source whose target is k times its
size is taken k times whole (complete epochs); the rest of its budget goes to documents in
key order until their words fill it, and the document that crosses the budget gives only
the words still missing.

Sorting a source whole would put a hot source into one task. Instead words are summed by
(source, key bucket), the bucket in which the budget ends is found from those sums, and
only that bucket is sorted. What remains per source is one row: its epochs, the key at the
cut and the words due there. Documents are never shuffled by source.

Defined cases: a null source is a source of its own, sorted last; a null or empty text has
size 0 and nothing taken; null ids are drawn by their text; documents with the same key (repeated
rows) are filled one after the other at the cut, so the last of them is the one cut; a source
without words has target 0; an empty table gives an empty result. Sources' totals (one row a
source) are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, small, tucked

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
MOST_EPOCHS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(quality: Column) -> Column:
    """Exponential key of rate ``quality``; u in (0, 1) from 52 bits of the md5 of id and text."""
    drawn = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    bits = F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10)
    return -F.log((bits.cast("long") + F.lit(0.5)) / F.lit(2.0 ** 52)) / quality


def repeating_weights(totals: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights by the sources' code point order, null last, repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return totals.select("source", F.element_at(table, rank % len(weights) + 1).alias("weight"))


def source_targets(totals: DataFrame, weights: DataFrame | None = None,
                   most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) for ``totals`` (source, source_size).

    Targets share the sum of all sizes by weight; none exceeds ``most`` times its source,
    and the excess is shared again by weight. In the order of cap/weight the capped sources
    come first, so two running sums give the level of the others without a loop.
    """
    weights = repeating_weights(totals) if weights is None else weights
    cap = F.col("source_size") * F.lit(most)
    by_room = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = weights.select(F.col("source").alias("w_source"), "weight")
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / F.sum("weight").over(after))
    joined = totals.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    full = joined.withColumn("level", level).withColumn("capped", cap <= F.col("weight") * F.col("level"))
    top = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * top)
    return full.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights: DataFrame | None = None,
             most: int = MOST_EPOCHS) -> tuple[DataFrame, int]:
    """One row a source: what of its documents the mix takes, and the number of sources.

    ``sized`` has source, size and key and is read three times: pass a written table.
    Result: source, source_size, target, epochs, cut_key, rest. A document is taken ``epochs``
    times, once more if its key is below cut_key; those with the cut_key itself share the
    ``rest`` words (``shared_out``).
    """
    totals, seen = kept(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(totals, weights, most)
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets, _ = kept(targets.withColumn("epochs", epochs).withColumn(
        "budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    per_source = small(targets, seen["rows"], 64)

    bucket = F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)
    sums = (sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
            .withColumn("below", F.col("upto") - F.col("words")).withColumnRenamed("source", "s"))
    # a bucket without words ends where the one before it ends, so the strict test finds one
    edge = (sums.join(per_source, F.col("s").eqNullSafe(F.col("source")))
            .where("below < budget and upto >= budget")
            .select("s", "bucket", "below", "budget"))
    edge, _ = kept(edge, "cut-buckets")
    at = (sized.withColumn("b", bucket)
          .join(small(edge, seen["rows"], 40), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bucket")))
          .groupBy("s", "below", "budget", "key").agg(F.sum("size").alias("words"))
          .withColumn("upto", F.col("below") + F.sum("words").over(Window.partitionBy("s").orderBy("key")))
          .where("upto - words < budget and upto >= budget")
          .select("s", F.col("key").alias("cut_key"), (F.col("budget") - (F.col("upto") - F.col("words"))).alias("rest")))
    plan = (targets.join(at, F.col("source").eqNullSafe(F.col("s")), "left")
            .select("source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit(-1.0)).alias("cut_key"),
                    F.coalesce("rest", F.lit(0)).cast("long").alias("rest")))
    return plan, seen["rows"]


def shared_out(ties: DataFrame) -> DataFrame:
    """(c_row, cut_words): the documents at a cut, filled one after the other. ``ties``: source,
    row (a number of its own), size, rest; a written table.

    Copies of one document are numbered within each stretch of rows and shifted by the words of
    the stretches before, so that copies by the million are not one task's either."""
    rows = ties.select(F.col("source").alias("s"), "row", F.shiftright("row", 33).alias("slot"), "size", "rest")
    here = Window.partitionBy("s", "slot").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("b_s").orderBy("b_slot").rowsBetween(Window.unboundedPreceding, -1)
    stretches = (rows.groupBy(F.col("s").alias("b_s"), F.col("slot").alias("b_slot")).agg(F.sum("size").alias("words"))
                 .withColumn("earlier", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words"))
    left = F.col("rest") - F.col("earlier") - F.coalesce(F.sum("size").over(here), F.lit(0))
    return (rows.join(stretches, F.col("s").eqNullSafe(F.col("b_s")) & (F.col("slot") == F.col("b_slot")))
            .select(F.col("row").alias("c_row"), F.greatest(F.lit(0), F.least("size", left)).cast("long").alias("cut_words")))


def taken_words() -> Column:
    """Words the mix takes of a document, from its size, key and cut and its source's plan."""
    return (F.col("epochs") * F.col("size") + F.when(F.col("key") < F.col("cut_key"), F.col("size"))
            .otherwise(F.coalesce("cut_words", F.lit(0)))).cast("long")


def measured_quality(quality: DataFrame | None) -> tuple[DataFrame | None, int]:
    """``quality`` written and counted: few enough rows are broadcast, so that texts stay put."""
    if quality is None:
        return None, 0
    table, seen = kept(quality.select("doc_id", "weight"), "quality")
    return table, seen["rows"]


def drawn(docs: DataFrame, quality: DataFrame | None, n_quality: int) -> DataFrame:
    """``docs`` with row, a number of its own, and key. ``quality`` (doc_id, weight > 0; n_quality
    rows) has at most one row a document; documents without one weigh 1."""
    out = docs.withColumn("row", F.monotonically_increasing_id())
    if quality is None:
        return out.withColumn("key", draw_key(F.lit(1.0)))
    weights = quality.select(F.col("doc_id").alias("q_id"), F.col("weight").alias("q_weight"))
    out = out.join(small(weights, n_quality, 24),
                   F.col("doc_id") == F.col("q_id"), "left")
    return out.withColumn("key", draw_key(F.coalesce("q_weight", F.lit(1.0)))).drop("q_id", "q_weight")


def sized_documents(docs: DataFrame, quality: DataFrame | None = None, n_quality: int = 0) -> DataFrame:
    """(doc_id, source, size, key, row) of ``docs`` (doc_id, text, source)."""
    return drawn(docs, quality, n_quality).select("doc_id", "source", n_words().alias("size"), "key", "row")


def label_quality(labels: DataFrame) -> DataFrame:
    """Weights from page labels: good 2, bad 0.5 (the best label, where there are several)."""
    return (labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
            .select("doc_id", F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("weight")))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: DataFrame | None = None,
                most: int = MOST_EPOCHS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    sized, _ = kept(sized_documents(docs.select("doc_id", "text", "source"), *measured_quality(quality)), "sized")
    plan, n = mix_plan(sized, weights, most)
    p = small(plan.withColumnRenamed("source", "p_source"), n, 64)
    planned = sized.join(p, F.col("source").eqNullSafe(F.col("p_source")))
    ties, n_ties = kept(planned.where("key = cut_key").select("source", "row", "size", "rest"), "cut-rows")
    return (planned.join(small(shared_out(ties), n_ties["rows"], 24), F.col("row") == F.col("c_row"), "left")
            .select("doc_id", "size", "source_size", "target", taken_words().alias("taken")))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None,
                    weights: DataFrame | None = None, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: ``docs`` rows (needs doc_id, text, source, n_chars) once for every
    time they are taken; the document at a cut ends after the last word due. Documents
    without words add nothing to a budget and go through once. Other columns, whatever their
    names, come along."""
    plain, restored = tucked(docs, "doc_id", "text", "source", "n_chars")
    quality, n_quality = measured_quality(quality)
    sized, _ = kept(sized_documents(plain, quality, n_quality), "sized")
    plan, n = mix_plan(sized, weights, most)
    p = small(plan.select(F.col("source").alias("p_source"), "epochs", "cut_key", "rest"), n, 64)
    planned = drawn(plain, quality, n_quality).join(p, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    some = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    copies = (F.col("epochs") + F.when(F.col("key") < F.col("cut_key"), 1).otherwise(0)).cast("int")
    whole = F.array_repeat("text", F.when(some, copies).otherwise(1))
    # the documents at the cuts, one a source and its copies, are written: their numbers stay
    ties, n_ties = kept(planned.where("key = cut_key").withColumn("size", n_words()), "cut-documents")
    at_cut = ties.join(small(shared_out(ties), n_ties["rows"], 24), F.col("row") == F.col("c_row"))
    # each piece is one word with the white space before it
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    at_cut = at_cut.withColumn("pieces", pieces)
    cut = F.array_join(F.expr("slice(pieces, 1, cast(cut_words as int))"), "")
    texts = F.when(some & (F.col("cut_words") > 0), F.concat(whole, F.array(cut))).otherwise(whole)
    changed = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("long")}
    columns = [changed.get(c, F.col(c)).alias(c) for c in plain.columns]
    return restored(planned.where("key <> cut_key").withColumn("mixed_text", F.explode(whole)).select(*columns)
                    .unionByName(at_cut.withColumn("mixed_text", F.explode(texts)).select(*columns)))


def op9_source_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_sources(docs, label_quality(labels))


OP9_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT t.doc_id, t.source,
         CAST(len(regexp_extract_all(coalesce(t.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(t.doc_id AS VARCHAR), '') || ':' || md5(coalesce(t.text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE)
             / 4503599627370496::DOUBLE)
           / (CASE q.q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM documents t LEFT JOIN q ON t.doc_id = q.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
             ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= w * lev THEN cap::DOUBLE
              ELSE w * max(CASE WHEN cap > w * lev THEN lev END) OVER () END AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CAST(floor(target - epochs * source_size) AS BIGINT) AS budget FROM e),
r AS (
  SELECT d.*, b.source_size, b.target, b.epochs, b.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.k) AS grp,
         sum(d.size) OVER (PARTITION BY d.source, d.k ORDER BY d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN budget = 0 THEN 0
                                 WHEN upto < budget THEN size
                                 WHEN upto - grp < budget THEN greatest(0, least(size, budget - (upto - grp) - ahead))
                                 ELSE 0 END AS BIGINT) AS taken
FROM r
"""
