"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Sources share the total size by weight. A source whose share exceeds ``max_epochs`` times its own
size stops there; the excess is shared again by weight among the others, until no share is above
its cap. A document is then taken floor(target / size of the source) times whole, and a seeded
part of each source once more: documents in order of a hash, up to the words still missing, the
last one in part. So each source's taken words equal its rounded target.

Only DataFrame functions run here. The driver sees two sums and the level. A hot source is
never one group of rows: its documents fall into ``BUCKETS`` hash buckets, whole buckets are
decided from their sums, and only the one bucket at the boundary is ordered row by row.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
ordered last; a null id hashes like the empty string; rows of equal hash are ordered by size and by
their text's hash and are otherwise interchangeable; a text of any length is taken whole or counted by
its words; sources of equal cap by weight are filled in order of their names; an empty table gives an
empty mix; extra columns are kept by :func:`mixed_documents` and ignored by :func:`mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm.shared import stage

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """Equal for equal sources, null included; sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _ranged(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add to each row, by name, the sums over all rows before it in ``order``: ranges are summed apart and offset by those before them."""
    parts = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    upto = lambda window: window.rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = totals.select("part", *(F.coalesce(F.sum(k).over(upto(W.orderBy("part"))), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = upto(W.partitionBy("part").orderBy(*order))
    return parts.join(before, "part").withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).drop("part", *(f"_{k}" for k in sums))


def fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to (key, weight, source_size): capped water-filling.

    In order of cap a unit of weight, sources are capped as long as the level that shares the rest among the
    others lies above; the first source that it does not reach sets the level.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    all_of = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    ranked = _ranged(sources.withColumn("ratio", cap / F.col("weight")), ["ratio", "key"], {"capped": F.col("source_size"), "used": F.col("weight")})
    level = (F.lit(all_of["size"] or 0) - F.col("capped") * F.lit(float(max_epochs))) / (F.lit(all_of["weight"] or 0.0) - F.col("used"))
    found = ranked.withColumn("level", level).filter(F.col("level") * F.col("weight") <= cap).agg(F.min(F.struct("ratio", "key", "level"))["level"]).first()[0]
    return sources.withColumn("target", cap if found is None else F.least(cap.cast("double"), F.lit(found) * F.col("weight")))


def rank_sources(sources: DataFrame) -> DataFrame:
    """Add ``place``, the rank of the key, counted from 0."""
    return _ranged(sources, ["key"], {"place": F.lit(1)})


def _taken(rows: DataFrame, weights: Sequence[float], max_epochs: float, seed: int) -> DataFrame:
    """Add source_size, target and taken to rows that have _key, _id, _size and _tie."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_hash", digest).withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    sums = stage(rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("bucket_size")), "buckets")
    sources = rank_sources(sums.groupBy(F.col("_key").alias("key")).agg(F.sum("bucket_size").alias("source_size")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    sources = stage(fill(sources, max_epochs), "targets")
    want = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select(F.col("key").alias("_key"), "source_size", "target", whole.alias("_whole"), (want - whole * F.col("source_size")).alias("_rest"))
    # One row a source: the bucket in which the words still missing run out, and how many are missing there.
    upto = F.sum("bucket_size").over(W.partitionBy("_key").orderBy("_bucket"))
    reached = sums.withColumn("_upto", upto).join(sources.select("_key", "_rest"), "_key").filter("_rest > 0 and _upto >= _rest")
    cuts = reached.groupBy("_key").agg(F.min(F.struct("_bucket", (F.col("_rest") - F.col("_upto") + F.col("bucket_size")).alias("room"))).alias("_cut"))
    plan = sources.drop("_rest").join(cuts, "_key", "left")
    plan = stage(plan.select("_key", "source_size", "target", "_whole", F.coalesce("_cut._bucket", F.lit(-1)).alias("_at"), F.coalesce("_cut.room", F.lit(0)).alias("_room")), "plan")
    out = rows.join(plan, "_key")
    # Only in the bucket that the boundary cuts are rows put in order.
    order = W.partitionBy("_key").orderBy("_hash", "_size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    clear = out.filter("_bucket <> _at").withColumn("_more", F.when(F.col("_bucket") < F.col("_at"), F.col("_size")).otherwise(F.lit(0)).cast("long"))
    edge = out.filter("_bucket = _at").withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_room") - F.coalesce(F.sum("_size").over(order), F.lit(0)))).cast("long"))
    return clear.unionByName(edge).withColumn("taken", F.col("_whole") * F.col("_size") + F.col("_more"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: its id, size, source_size, target and taken words."""
    slim = docs.select(docs[id_col].alias("_id"), _key(docs[source_col]).alias("_key"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), F.crc32(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_tie"))
    out = _taken(stage(slim, "sizes"), weights, max_epochs, seed)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row for each repetition, with the document's columns as they are.

    Texts are never cut: of a source's one document that the mix takes in part, there is a whole row more if
    that comes nearer to the target than none.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[id_col].alias("_id"), _key(docs[source_col]).alias("_key"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), F.crc32(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_tie"))
    out = _taken(packed, weights, max_epochs, seed).filter("taken > 0")
    times = F.round(F.col("taken") / F.greatest("_size", F.lit(1))).cast("int")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


#: DuckDB SQL for :func:`mix` over ``documents`` with its defaults: the level in closed form over sources sorted by cap.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT k, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY k),
r AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER w, 0) AS cap_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
         sum(source_size) OVER () AS whole
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (whole - cap_before)::DOUBLE / weight_left AS level FROM r
  WHERE (whole - cap_before)::DOUBLE / weight_left * weight <= cap ORDER BY 3 * source_size / weight, k LIMIT 1),
t AS (SELECT k, source_size, least(cap::DOUBLE, level * weight) AS target FROM r, l),
o AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(round(target)::BIGINT / source_size)::BIGINT ELSE 0 END AS full_times,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target,
       (full_times * size + greatest(0, least(size, round(target)::BIGINT - full_times * source_size - before)))::BIGINT AS taken
FROM o
"""
