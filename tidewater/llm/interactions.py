"""Audit of how filters interact: every order of five filters is replayed over every document.

A document's failures are five bits. Each document meets the 120 orders (a broadcast table of fixed
size), the first failure of each order follows from the bits, and its five steps are summed by part,
order and step, in the map tasks before anything is shuffled: what travels is at most 600 rows a part
and task.

Defined results: a null text is empty, and equal to an empty one; a null ``lang`` is the part ''; a
null id is neither smaller than another nor has a smaller one; of rows that repeat an id and text
none is a copy of the other, as no id is smaller; a document is good (or toxic) if any row of
``labels`` with its id says so; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm.shared import drop_staged, stage

FILTERS = "ABCDE"
COPY = FILTERS[-1]


def _spaced(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\f\r", "     ")


def failures(text: Column) -> dict[str, Column]:
    """The conditions that one text decides alone."""
    words = F.array_remove(F.split(_spaced(text), " "), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, bits): bit i is set where the text fails filter i; a text's copies are found by their sha256."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(text).values())), F.lit(0))
    rows = stage(docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest")), "flags")
    first = stage(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-copies")
    out = rows.join(first, "digest", "left").withColumn("bits", F.col("bits").bitwiseOR(F.when(F.col("id") > F.col("first"), 1 << FILTERS.index(COPY)).otherwise(0)))
    out = stage(out.select("id", "part", "bits"), "copy-flags")
    drop_staged(rows, first)
    return out


def orders(spark) -> DataFrame:
    """120 rows: an order's letters and the bit of each of its steps."""
    rows = [("".join(p), *(1 << FILTERS.index(c) for c in p)) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{k} int" for k in range(1, len(FILTERS) + 1)))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order and step."""
    steps = range(1, len(FILTERS) + 1)
    known = labels.groupBy(labels["doc_id"].alias("id")).agg(F.bool_or(labels["quality"] == 1).alias("good"), F.bool_or(labels["toxic"] == 1).alias("toxic"))
    rows = flagged(docs, id_col, text_col, part_col).join(known, "id", "left").drop("id")
    met = rows.crossJoin(F.broadcast(orders(docs.sparkSession)))
    hits = lambda bit: F.col("bits").bitwiseAND(bit) != 0
    first = F.coalesce(*(F.when(hits(F.col(f"b{k}")), k) for k in steps), F.lit(len(FILTERS) + 1))
    met = met.select("part", "filter_order", "bits", "good", "toxic", first.alias("first"), F.inline(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in steps))))
    here = F.col("first") == F.col("step")
    counts = met.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < F.col("step")) & hits(F.col("bit"))).alias("redundant"),
        F.count_if(F.col("bits") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", letter)))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN k USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS c, fails, n, good, toxic, len(translate(substr(filter_order, 1, s.step - 1), fails, '')) < s.step - 1 AS gone FROM g, o, (SELECT unnest(range(1, 6))::INT AS step) s),
r AS (SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT contains(fails, c)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND contains(fails, c)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND contains(fails, c)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = c), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE NOT gone AND contains(fails, c)), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND contains(fails, c)), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (c), sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM r"""
