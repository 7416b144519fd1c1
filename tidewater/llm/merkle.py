"""Merkle manifest of a dataset: a root over all rows, and a proof for each row.

Leaves are hashed where the text is read, so no text travels. They are sorted by source and id over
all tasks, and numbered within their source from the counts of the tasks before. ``BUCKET`` leaves in
a row (a power of three, so that no run of three crosses a bucket) go to an executor as one Arrow
table, where DuckDB reduces them level by level: ``string_agg`` in order joins a run's digests and
``sha256`` makes their parent. Each leaf leaves a bucket with the bucket's root, the siblings it met,
and its own refolded value. Spark reduces the buckets' roots to each source's root and these to the
whole root, and joins the siblings met there to the rows of each bucket.

Defined results: a null column is encoded as ``-``; rows of a source without an id come first; rows
that are equal in all five columns are interchangeable, and each gets the proof of its own place; a
null id, or a null text, is never tampered with; an empty table gives an empty result; extra columns
are neither hashed nor returned.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm.shared import stage

ARITY = 3
LEVELS = 7
#: Leaves of a bucket: about 0.4 MB of digests.
BUCKET = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def encoded(c: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the second leaf is null where tampering changes nothing."""
    fields = [docs[c] for c in FIELDS]
    hit = (F.crc32(docs["doc_id"].cast("string")) % 2 == 0) & F.contains(docs["text"], F.lit("\n"))
    return docs.select("doc_id", "source", leaf_of(fields).alias("leaf"), F.when(hit, leaf_of([*fields[:-1], F.translate(docs["text"], "\n", "")])).alias("tampered"))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place in the group from 0 (a 64-bit number), and ``n``, the group's rows.

    Tasks hold ranges of (group, order), so a large group lies in many tasks; only one row for each
    task and group is counted up.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumns({"_task": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    whole, before = W.partitionBy(group), W.partitionBy(group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("_task", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    counts = stage(counts.select(F.col("_task").alias("_t"), F.col(group).alias("_g"), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")), "counts")
    out = ranged.join(counts, (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_t", "_g", "_first", "_shift")


#: One level of a bucket: runs of three are joined in order, each row meets its run, and runs become nodes.
LEVEL = f"""
CREATE OR REPLACE TEMP TABLE runs AS SELECT pos // {ARITY} AS pos, string_agg(h, '' ORDER BY pos) AS run FROM nodes GROUP BY ALL;
CREATE OR REPLACE TEMP TABLE met AS SELECT met.* REPLACE (met.pos // {ARITY} AS pos, sha256(run[:{HEX} * (met.pos % {ARITY})] || folded || run[{HEX} * (met.pos % {ARITY} + 1) + 1:]) AS folded,
  siblings || run[:{HEX} * (met.pos % {ARITY})] || run[{HEX} * (met.pos % {ARITY} + 1) + 1:] AS siblings) FROM met JOIN runs ON runs.pos = met.pos // {ARITY};
CREATE OR REPLACE TEMP TABLE nodes AS SELECT pos, sha256(run) AS h FROM runs;
"""
REDUCED = "doc_id long, source string, leaf string, bucket long, buckets long, bucket_root string, siblings string, folded string"


def _engine():
    """A worker's DuckDB: one thread, bounded memory, nothing on disk."""
    import duckdb

    if not hasattr(_engine, "kept"):
        _engine.kept = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    return _engine.kept


def reduce_bucket(bucket: pa.Table) -> pa.Table:
    """Whole levels of one bucket; the only bucket of a source ends at its last node."""
    con = _engine()
    con.register("given", bucket)
    con.execute(f"CREATE OR REPLACE TEMP TABLE met AS SELECT doc_id, source, leaf, bucket, buckets, (pos % {BUCKET}) AS pos, coalesce(tampered, leaf) AS folded, '' AS siblings FROM given")
    con.execute(f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT pos % {BUCKET} AS pos, leaf AS h FROM given")
    con.unregister("given")
    left, alone = len(bucket), bucket.column("buckets")[0].as_py() == 1
    for _ in range(LEVELS):
        if alone and left == 1:
            break
        con.execute(LEVEL)
        left = -(-left // ARITY)
    found = con.execute("SELECT doc_id, source, leaf, bucket, buckets, h AS bucket_root, siblings, folded FROM met, nodes").to_arrow_table()
    return found.cast(pa.schema([(c, pa.int64() if kind == "long" else pa.string()) for c, kind in (x.split() for x in REDUCED.split(", "))]))


def reduced(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"bucket": F.floor(F.col("pos") / BUCKET), "buckets": F.ceil(F.col("n") / BUCKET)}).drop("n")
    return rows.groupBy("source", "bucket").applyInArrow(reduce_bucket, REDUCED)


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reduce (grp, pos, n, h) to one node a group: (level, grp, pos, run) of every run met, and (grp, h) of the last nodes.

    Levels are counted on one number, the largest group's nodes; each level is a small staged table.
    """
    spark = nodes.sparkSession
    most = nodes.agg(F.max("n")).first()[0] or 1
    done, level = nodes.filter("n = 1").select("grp", "h"), 0
    runs = spark.createDataFrame([], "level int, grp string, pos bigint, run string")
    while most > 1:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "")
        made = nodes.filter("n > 1").groupBy("grp", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n")).agg(joined.alias("run"))
        made = stage(made, f"level-{level}")
        runs = runs.unionByName(made.select(F.lit(level).alias("level"), "grp", "pos", "run"))
        nodes = made.select("grp", "pos", "n", F.sha2("run", 256).alias("h"))
        done = done.unionByName(nodes.filter("n = 1").select("grp", "h"))
        most, level = -(-most // ARITY), level + 1
    return runs, done


def paths(places: DataFrame, runs: DataFrame) -> DataFrame:
    """(grp, pos, met): what stands left and right of a place's node at each level, from the lowest."""
    power = F.pow(F.lit(float(ARITY)), F.col("level")).cast("bigint")
    levels = runs.agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("levels"))
    wanted = places.crossJoin(F.broadcast(levels)).select("grp", "pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("levels") - 1, F.lit(0)))).alias("level")).withColumn("node", F.floor(F.col("pos") / power))
    r = runs.select("level", F.col("grp").alias("_g"), F.col("pos").alias("_p"), "run")
    met = wanted.join(r, (wanted["level"] == r["level"]) & wanted["grp"].eqNullSafe(r["_g"]) & (F.floor(wanted["node"] / ARITY) == r["_p"]), "left")
    cut = (F.col("node") % ARITY * HEX).cast("int")
    step = F.when(F.col("run").isNotNull(), F.struct(wanted["level"], F.substring("run", F.lit(1), cut).alias("left"), F.substring("run", cut + HEX + 1, F.lit(ARITY * HEX)).alias("right")))
    return met.groupBy("grp", "pos").agg(F.sort_array(F.collect_list(step)).alias("met"))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, proof and refolded root of every row."""
    hashed = stage(leaves(docs), "leaves")
    rows = stage(reduced(numbered(hashed, "source", ["doc_id", "leaf"])), "reduced")
    buckets = stage(rows.groupBy(F.col("source").alias("grp"), F.col("bucket").alias("pos"), F.col("buckets").alias("n")).agg(F.first("bucket_root").alias("h")), "buckets")
    runs, subroots = tree(buckets)
    subroots = stage(subroots.withColumn("_all", F.lit("all")), "subroots")
    ranked = stage(numbered(subroots, "_all", ["grp"]).withColumnRenamed("grp", "source"), "ranked")
    top, root = tree(ranked.select(F.col("_all").alias("grp"), "pos", "n", "h"))
    above = paths(ranked.select(F.col("_all").alias("grp"), "pos"), top).select(F.col("pos").alias("_rank"), F.col("met").alias("above"))
    by_source = ranked.join(above, ranked["pos"] == above["_rank"]).select(F.col("source").alias("_s"), F.col("h").alias("subroot"), "above")
    within = paths(buckets.select("grp", "pos"), runs)
    outer = within.join(by_source, within["grp"].eqNullSafe(by_source["_s"])).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))
    outer = stage(outer.select(F.col("grp").alias("_g"), F.col("pos").alias("_p"), "subroot", "root", F.concat("met", "above").alias("outer")), "outer")
    out = rows.join(outer, rows["source"].eqNullSafe(outer["_g"]) & (rows["bucket"] == outer["_p"]))
    siblings = F.concat("siblings", F.array_join(F.transform("outer", lambda x: F.concat(x["left"], x["right"])), ""))
    folded = F.aggregate("outer", F.col("folded"), lambda own, x: F.sha2(F.concat(x["left"], own, x["right"]), 256))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """WITH RECURSIVE d AS (
  SELECT doc_id, source, text, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
nodes AS (
  SELECT 0 AS level, source, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, source, pos // 3, n),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS (SELECT level, source, pos // 3 AS run, string_agg(h, '' ORDER BY pos) AS t FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 3 AS run, string_agg(h, '' ORDER BY pos) AS t FROM tops WHERE n > 1 GROUP BY ALL),
fold AS (
  SELECT doc_id, source, leaf, pos AS own, 0 AS level, pos, n, coalesce(tampered, leaf) AS folded, '' AS proof FROM p
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, f.own, f.level + 1, f.pos // 3, (f.n + 2) // 3, sha256(t[:64 * (f.pos % 3)] || folded || t[64 * (f.pos % 3) + 65:]), proof || t[:64 * (f.pos % 3)] || t[64 * (f.pos % 3) + 65:]
  FROM fold f JOIN runs r ON r.level = f.level AND r.source IS NOT DISTINCT FROM f.source AND r.run = f.pos // 3 WHERE f.n > 1),
whole AS (
  SELECT f.doc_id, f.leaf, s.subroot, 0 AS level, s.pos, s.n, f.folded, f.proof FROM fold f JOIN sub s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.pos // 3, (f.n + 2) // 3, sha256(t[:64 * (f.pos % 3)] || folded || t[64 * (f.pos % 3) + 65:]), proof || t[:64 * (f.pos % 3)] || t[64 * (f.pos % 3) + 65:]
  FROM whole f JOIN top_runs r ON r.level = f.level AND r.run = f.pos // 3 WHERE f.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM whole, (SELECT h AS root FROM tops WHERE n = 1) WHERE n = 1"""
