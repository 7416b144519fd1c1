"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, components.

A vector's code in a table is the signs of its products with seeded random directions. Vectors that
share a code in some table are compared exactly, in double precision. Two vectors at an angle a
share a sign with probability 1 - a / pi, so with b bits a pair at the threshold is missed by t tables
with probability (1 - (1 - a / pi)**b)**t. Bits grow with the logarithm of the number of vectors,
so that a code holds some 32 of them, and tables are as many as hold that below ``MISS``. What meets in
a table is a sketch of ``SKETCH`` more signs, not the vector: pairs whose sketches differ in more signs than
a pair at the threshold does but once in a million are dropped, and only vectors with a partner left are sent
to be compared. Links found this way are joined into components; then every pair inside a component is
compared once, so links that no table showed are found too.

Equal vectors are compared once, with their number of copies.

Defined results: a vector that is null, empty, all zero, or has a null or non-finite component links
with nothing; vectors of different lengths never link; a cosine equal to the threshold links; a vector of any
length is one row; repeated rows are copies; ties of the smallest id keep each row of it; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidewater.llm import graphs
from tidewater.llm.shared import stage

THRESHOLD, MISS, BLOCK, SKETCH = 0.9, 1e-3, 1024, 256


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(40, max(8, round(math.log2(max(n, 1) / 32))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-share))


def codes(matrix: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.Generator(np.random.PCG64([seed, matrix.shape[1]])).standard_normal((matrix.shape[1], bits * tables))
    signs = (matrix @ planes > 0).reshape(len(matrix), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def sketches(matrix: np.ndarray, seed: int) -> np.ndarray:
    """SKETCH signs of each row, packed."""
    planes = np.random.Generator(np.random.PCG64([seed, 1, matrix.shape[1]])).standard_normal((matrix.shape[1], SKETCH))
    return np.packbits(matrix @ planes > 0, axis=1)


def most_apart(threshold: float) -> int:
    """The most signs in which sketches may differ: above it lies one in a million of the pairs at the threshold."""
    p = math.acos(threshold) / math.pi
    log, total = SKETCH * math.log1p(-p), 0.0
    for k in range(SKETCH + 1):
        total += math.exp(log)
        if total >= 1 - 1e-6:
            return k
        log += math.log((SKETCH - k) / (k + 1)) + math.log(p) - math.log1p(-p)
    return SKETCH


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    scaled = m / np.abs(m).max(1, keepdims=True)  # no overflow or underflow in the norm
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def kind_of(embeddings: DataFrame, vec_col: str) -> str:
    """The components' type in bytes: single precision where the column has it, else double."""
    return "<f4" if embeddings.schema[vec_col].dataType.elementType == FloatType() else "<f8"


def pack(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, vec): the components in bytes; null for a vector that links with nothing."""
    kind = kind_of(embeddings, vec_col)
    slim = embeddings.select(embeddings[id_col].alias("_id"), embeddings[vec_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                v = x.values.to_numpy(zero_copy_only=False).astype(kind) if x.is_valid else np.zeros(0, kind)
                good = len(v) and not x.values.null_count and np.isfinite(v).all() and v.any()
                out.append((v + v.dtype.type(0)).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["_id", "vec"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, vec binary")


def linked_pairs(vectors: np.ndarray, own: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with cosine >= threshold, a stripe at a time; with ``own``, only of different blocks."""
    n = len(vectors)
    for at in range(0, n, 512):
        a, b = np.nonzero(vectors[at : at + 512] @ vectors.T >= threshold)
        a = a + at
        keep = a < b
        if own is not None:
            keep &= own[a] != own[b]
        yield a[keep], b[keep]


def partnered(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """Of cells of (group, lo, hi, own, key, sketch), the rows whose sketch has a partner at most ``apart`` signs away."""
    for table, edges in graphs.by_cell(batches):
        own, lo, hi = (table[c].to_numpy() for c in ("own", "lo", "hi"))
        bits = np.unpackbits(np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH // 8), axis=1)
        signs = bits.astype(np.float32) * 2 - 1
        kept = np.zeros(len(own), bool)
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            for a, b in linked_pairs(signs[at:end], own[at:end] if lo[at] != hi[at] else None, SKETCH - 2 * apart):
                kept[at + a] = kept[at + b] = True
        yield from table.select(["bucket", "lo", "hi", "own", "key"]).filter(pa.array(kept)).to_batches()


def cell_links(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Cells of (group, lo, hi, own, key, copies, vec) to (key, root, links): what each vector links with in the cell."""
    for table, edges in graphs.by_cell(batches):
        keys, vecs = np.array(table["key"].to_pylist(), object), table["vec"].to_pylist()
        own, copies, lo, hi = (table[c].to_numpy() for c in ("own", "copies", "lo", "hi"))
        out: list[list[np.ndarray]] = [[], [], []]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            n = end - at
            if n < 2:
                continue
            links = np.zeros(n, np.int64)
            pairs = list(linked_pairs(_unit(vecs[at:end], kind), own[at:end] if lo[at] != hi[at] else None, threshold))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            np.add.at(links, a, copies[at:end][b])
            np.add.at(links, b, copies[at:end][a])
            has = np.flatnonzero(links)
            root = graphs.forest(n, a, b)
            for kept, x in zip(out, (keys[at:end][has], keys[at:end][root[has]], links[has]), strict=True):
                kept.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["key", "root", "links"])


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a vector: id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept."""
    rows = stage(pack(embeddings, id_col, vec_col).withColumn("key", F.unhex(F.md5("vec"))), "packed")
    distinct = stage(rows.filter("vec is not null").groupBy("key").agg(F.count("*").alias("copies"), F.first("vec").alias("vec")), "vectors")
    bits, tables = plan(distinct.count(), threshold)
    kind, apart = kind_of(embeddings, vec_col), most_apart(threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec").to_pylist()
            size = np.array([len(v) for v in vecs])
            for width in np.unique(size):
                rows_ = np.flatnonzero(size == width)
                unit = _unit([vecs[i] for i in rows_], kind)
                signs = [x.tobytes() for x in sketches(unit, seed)]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows_)), pa.array(signs, pa.binary()), pa.array(np.full(len(rows_), width, np.int64)), pa.array(codes(unit, bits, tables, seed).tolist(), pa.list_(pa.int64()))], ["key", "sketch", "width", "codes"])

    coded = distinct.select("key", "vec").mapInArrow(code, "key binary, sketch binary, width long, codes array<long>")
    members = coded.select("key", "sketch", "width", F.posexplode("codes").alias("table", "code")).select("key", "sketch", F.xxhash64("table", "width", "code").alias("bucket"))
    shape, vectors = "key binary, root binary, links long", distinct.select("key", "copies", "vec")
    dealt = graphs.cells(members, "bucket", "key", BLOCK).select("bucket", "lo", "hi", "own", "key", "sketch")
    left = dealt.mapInArrow(lambda it: partnered(it, apart), "bucket long, lo int, hi int, own int, key binary").join(vectors, "key")
    left = left.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "own", "key", "copies", "vec")
    found = left.mapInArrow(lambda it: cell_links(it, threshold, kind), shape)
    groups = graphs.components(found.filter("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    members = groups.select(F.col("node").alias("key"), F.xxhash64("component").alias("component")).join(vectors, "key")
    dealt = graphs.cells(members, "component", "key", BLOCK).select("component", "lo", "hi", "own", "key", "copies", "vec")
    links = dealt.mapInArrow(lambda it: cell_links(it, threshold, kind), shape).groupBy("key").agg(F.sum("links").alias("links"))
    # Rows without a vector get keys of their own, so that no task holds them all.
    key = F.when(F.col("vec").isNotNull(), F.col("key")).otherwise(F.encode(F.concat(F.lit("-"), F.xxhash64("_id").cast("string")), "UTF-8"))
    joined = rows.select("_id", key.alias("key")).join(distinct.select("key", "copies"), "key", "left")
    joined = joined.join(groups.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    joined = stage(joined.withColumn("group", F.coalesce("component", "key")), "joined")
    smallest = joined.filter("copies > 1 or component is not null").groupBy("group").agg(F.min("_id").alias("smallest"))
    out = joined.join(smallest, "group", "left").withColumn("component_id", F.coalesce("smallest", "_id"))
    n_links = F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    return out.select(F.col("_id").alias(id_col), n_links.cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: DuckDB SQL for :func:`near_duplicates` over ``embeddings``: all pairs, and reachability by recursion.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x,
         len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0 AS good
  FROM embeddings),
l AS (SELECT a.r, b.r AS o FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.good AND b.good AND list_cosine_similarity(a.x, b.x) >= 0.9),
c AS (
  SELECT r, r AS root FROM v
  UNION
  SELECT l.o, c.root FROM c JOIN l ON l.r = c.r),
k AS (SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.root GROUP BY c.r),
m AS (SELECT r, count(*) AS n_links FROM l GROUP BY r)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN k USING (r) LEFT JOIN m USING (r)
"""
