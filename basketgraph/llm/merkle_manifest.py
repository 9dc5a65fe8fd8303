"""Operator 12: a Merkle manifest of a dataset, proofs by descent of a content-addressed DAG.

Every row is a leaf: the digest of its length-prefixed columns. Per group (language) leaves ascend
by id; runs of FANOUT consecutive nodes become their digest until one node, the group's subroot,
remains. The subroots, in group order, form the top tree and its root.

Ranks come without sorting a group in one task: rows are range-partitioned by (group, id, leaf,
input position), numbered within their partition, and shifted by the counts of the partitions
before, one small row a (group, partition). The trees are stored as records digest -> children,
one per distinct run. Proofs are read from that store by descent: requests start at the root;
at each level a node meets its record by digest, the digit of its rank selects one child, and the
children not selected are collected, left and right of it. All leaves below a node share the
walk down to it, so a level costs as many rows as it has nodes, and the last level one join with
the leaves. A path collected on the way down is reversed to fold a leaf up to the root.

Levels are tables in the shared folder. Only row counts and the root are collected.

Defined cases: a null column is ``-`` in the leaf; rows with a null id come first and are leaves
as well; of equal ids the smaller leaf comes first; repeated rows are leaves each; a null group is
a group of its own, before the others; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, small

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts end to end."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A value behind its UTF-8 length; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ranked(rows: DataFrame, label: str, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with rank (from 0) within ``part`` in the given order, and n, the rows of the
    part; and the number of parts. Rows are ranked by ranges, so no task holds a part whole."""
    numbered = rows.withColumn("position", F.monotonically_increasing_id())
    dealt = (numbered.repartitionByRange(F.col("part"), *[F.col(c) for c in order], F.col("position"))
             .sortWithinPartitions("part", *order, "position").drop("position")
             .withColumn("at", F.monotonically_increasing_id()))
    table, _ = kept(dealt, f"{label}-sorted")
    slot = F.shiftright("at", 33)
    counts, seen = kept(table.groupBy("part", slot.alias("slot")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")),
                        f"{label}-counts")
    before = Window.partitionBy("part").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("part").alias("s_part"), F.col("slot").alias("s_slot"),
                          (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    sizes, n_parts = kept(counts.groupBy("part").agg(F.sum("c").alias("n")).select(F.col("part").alias("n_part"), "n"),
                          f"{label}-sizes")
    out = (table.join(small(shift, seen["rows"], 128), (F.col("part") == F.col("s_part")) & (slot == F.col("s_slot")))
           .join(small(sizes, n_parts["rows"], 128), F.col("part") == F.col("n_part"))
           .withColumn("rank", F.col("at") + F.col("shift")).drop("at", "s_part", "s_slot", "shift", "n_part"))
    return out, n_parts["rows"]


def tree(leaves: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """(part, subroot) of each part, and the records digest -> children of every level, leaves'
    parents first. ``leaves``: part, n, rank, node."""
    nodes, levels, roots = leaves.select("part", "n", "rank", "node"), [], None
    while True:
        single = nodes.where("n = 1").select("part", F.col("node").alias("subroot"))
        roots = single if roots is None else roots.unionByName(single)
        inner = (nodes.where("n > 1")
                 .groupBy("part", "n", F.expr(f"rank div {FANOUT}").alias("rank"))
                 .agg(F.sort_array(F.collect_list(F.struct((F.col("rank") % FANOUT).alias("digit"), "node"))).alias("run"))
                 .select("part", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "rank", F.col("run.node").alias("children")))
        nodes, seen = kept(inner.withColumn("node", digest(F.array_join("children", ""))), f"{label}-level")
        if not seen["rows"]:
            return roots, levels
        levels.append(nodes.select("node", "children"))


def left_right(digit: Column, children: Column) -> Column:
    """What the digit doesn't select of a run, joined on either side."""
    after = F.slice(children, digit + 2, F.size(children))
    return F.struct(F.array_join(F.slice(children, 1, digit), "").alias("left"), F.array_join(after, "").alias("right"))


def read(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Requested nodes with their children; the store holds one record a digest."""
    store = records.dropDuplicates(["node"]).withColumnRenamed("node", "digest")
    return nodes.join(store, F.col("node") == F.col("digest"))


def stepped(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """The children of requested nodes (part, node, rank, path), each with the path to it."""
    return (read(nodes, records)
            .select("part", "rank", "path", "children", F.posexplode("children").alias("digit", "child"))
            .select("part", F.col("child").alias("node"), (F.col("rank") * FANOUT + F.col("digit")).alias("rank"),
                    F.concat("path", F.array(left_right(F.col("digit"), F.col("children")))).alias("path")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with a path whose segments run from the leaf up."""
    return F.aggregate(path, leaf, lambda node, run: digest(run["left"], node, run["right"]))


def depth_of(n: Column) -> Column:
    """Levels above n nodes."""
    powers = [FANOUT ** k for k in range(21)]  # up to 2**60
    return sum([F.when(n > p, 1).otherwise(0) for p in powers[1:]], F.when(n > 1, 1).otherwise(0))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The audit tampers where 3 divides the checksum of an id: there the leaf that is folded is the
    one of the text with A-Z lower-cased."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    fields = [field(F.col(c)) for c in FIELDS]
    leaf = digest(*fields)
    # null groups first: the empty string sorts before every marked one
    part = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    leaves, _ = kept(docs.select(*FIELDS).select(
        part.alias("part"), F.col("doc_id"), leaf.alias("node"),
        F.when(tampered, digest(*fields[:-1], field(lowered(F.col("text"))))).alias("claimed")), "leaves")
    rows, _ = ranked(leaves, "leaves", "doc_id", "node")
    rows, _ = kept(rows, "ranked")
    subroots, levels = tree(rows, "tree")
    subroots, n_subroots = kept(subroots, "subroots")

    tops, _ = ranked(subroots.select(F.lit("").alias("part"), F.col("part").alias("lang_part"), F.col("subroot").alias("node")),
                     "tops", "lang_part")
    tops, _ = kept(tops, "top-ranked")
    root, top_levels = tree(tops, "top")
    at = root.select("part", F.col("subroot").alias("node"), F.lit(0).cast("long").alias("rank"), F.expr(NO_PATH).alias("path"))

    # the top tree down to every subroot, then every group's tree down to its leaves' parents
    for records in reversed(top_levels):
        at, _ = kept(stepped(at, records), "descent")
    heights = rows.where("rank = 0").select(F.col("part").alias("n_part"), depth_of(F.col("n")).alias("height"))
    requests, _ = kept(tops.select("rank", "lang_part").join(at.select("rank", "node", "path"), "rank")
                       .join(heights, F.col("lang_part") == F.col("n_part"))
                       .select(F.col("lang_part").alias("part"), "node", F.lit(0).cast("long").alias("rank"), "path", "height"),
                       "requests")
    none = F.expr("cast(array() as array<string>)")
    runs = requests.where("height = 0").select("part", "rank", "path", none.alias("children"))  # a lone leaf
    below = requests.where("false").drop("height")
    for height in range(len(levels), 0, -1):
        below = below.unionByName(requests.where(F.col("height") == height).drop("height"))
        if height > 1:
            below, _ = kept(stepped(below, levels[height - 1]), "descent")
        else:
            runs = runs.unionByName(read(below, levels[0]).select("part", "rank", "path", "children"))
    runs = runs.select(F.col("part").alias("r_part"), F.col("rank").alias("r_rank"), "path", "children")

    own = F.when(F.size("children") > 0, F.array(left_right((F.col("rank") % FANOUT).cast("int"), F.col("children")))
                 ).otherwise(F.expr(NO_PATH))
    names = small(subroots.withColumnRenamed("part", "s_part"), n_subroots["rows"], 256)
    top = root.first()  # one digest
    out = (rows.join(runs, (F.col("part") == F.col("r_part")) & (F.expr(f"rank div {FANOUT}") == F.col("r_rank")))
           .join(names, F.col("part") == F.col("s_part"))
           .select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(top["subroot"] if top else None).cast("string").alias("root"),
                   F.coalesce("claimed", "node").alias("claimed"), F.reverse(F.concat("path", own)).alias("up")))
    proof = digest(F.array_join(F.transform("up", lambda run: F.concat(run["left"], run["right"])), ""))
    return (out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"),
                       folded(F.col("claimed"), F.col("up")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(levels: int = 12) -> str:
    """The same manifest in SQL (DuckDB). Levels are written out, as many as 8**12 leaves need."""
    def nodes(name: str, source: str) -> list[str]:
        out = [f"{name}0 AS (SELECT part, rank, n, node FROM {source})"]
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (
  SELECT part, rank // 8 AS rank, (n + 7) // 8 AS n, sha256(string_agg(node, '' ORDER BY rank)) AS node
  FROM {name}{k} WHERE n > 1 GROUP BY part, n, rank // 8
  UNION ALL SELECT part, rank, n, node FROM {name}{k} WHERE n = 1)""")
        return out

    def paths(name: str) -> list[str]:
        """What stands left and right of each node in its run, '' above a root."""
        return [f"""{name}s{k} AS (
  SELECT part, rank, n, node,
         CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(node, '') OVER (PARTITION BY part, rank // 8 ORDER BY rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lft,
         CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(node, '') OVER (PARTITION BY part, rank // 8 ORDER BY rank
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rgt
  FROM {name}{k})""" for k in range(levels)]

    def climb(name: str, before: str, part: str, rank: str) -> list[str]:
        out = []
        for k in range(levels):
            divisor = 8 ** k
            src = before if k == 0 else f"{name}c{k - 1}"
            out.append(f"""{name}c{k} AS (
  SELECT w.* REPLACE (w.proof || s.lft || s.rgt AS proof,
                      CASE WHEN s.n = 1 THEN w.fold ELSE sha256(s.lft || w.fold || s.rgt) END AS fold)
  FROM {src} w JOIN {name}s{k} s ON s.part = w.{part}
   AND s.rank = CASE WHEN s.n = 1 THEN 0 ELSE w.{rank} // {divisor} END)""")
        return out

    length = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    head = " || ".join(length.format(c) for c in FIELDS[:-1])
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL),
crc AS (
  SELECT doc_id, t, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT doc_id, t, k + 1,
         CASE WHEN k % 9 = 0 THEN xor(c, CAST(ascii(substr(t, CAST(k // 9 + 1 AS BIGINT), 1)) AS BIGINT))
              ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END
  FROM crc WHERE k < 9 * length(t)),
hit AS (SELECT doc_id AS hit_id FROM crc WHERE k = 9 * length(t) AND xor(c, CAST(4294967295 AS BIGINT)) % 3 = 0),
l AS (
  SELECT coalesce('+' || lang, '') AS part, doc_id, sha256({head} || {length.format('text')}) AS node,
         sha256({head} || {length.format(f"CASE WHEN hit_id IS NULL THEN text ELSE translate(text, '{upper}', '{lower}') END")}) AS claimed
  FROM documents LEFT JOIN hit ON hit_id = doc_id),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, node) - 1 AS rank,
         count(*) OVER (PARTITION BY part) AS n FROM l),
{(',' + chr(10)).join(nodes('t', 'leaves'))},
sub AS (
  SELECT '' AS part, part AS lang_part, node, row_number() OVER (ORDER BY part) - 1 AS rank, count(*) OVER () AS n
  FROM t{levels}),
{(',' + chr(10)).join(nodes('u', 'sub'))},
{(',' + chr(10)).join(paths('t'))},
{(',' + chr(10)).join(paths('u'))},
w AS (
  SELECT l.doc_id, l.node AS leaf, s.node AS subroot, r.node AS root, l.part, l.rank, s.part AS top, s.rank AS top_rank,
         '' AS proof, l.claimed AS fold
  FROM leaves l JOIN sub s ON s.lang_part = l.part JOIN u{levels} r ON r.part = s.part),
{(',' + chr(10)).join(climb('t', 'w', 'part', 'rank'))},
{(',' + chr(10)).join(climb('u', f'tc{levels - 1}', 'top', 'top_rank'))}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM uc{levels - 1}"""


OP12_SQL = _sql()
