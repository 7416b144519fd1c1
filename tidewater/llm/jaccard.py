"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of hashed five-word windows. Texts with the same words in the same order form one
class and are compared once. Classes that agree on all four MinHash values of some band become
candidates. A pair's MinHash values are compared 32 at a time; with a uniform prior, after m
matches of n the similarity is at least t with probability P(Binomial(n + 1, t) <= m), and the pair
is dropped once that is below ``TOLERANCE``. What is left is verified exactly.

Candidates that survive are joined into components, in which every pair is compared once, in
cells of bounded size, pruned again, and verified on the full window sets. A pair exactly at 0.8
escapes all bands with a probability below 1e-7, and pruning drops it with one of a few 1e-6.

Defined results: words are runs without ASCII white space, compared as they are; a text of one to
four words is one window; a null text, or one of no words, links with nothing; rows that repeat
are copies of each other; an empty table gives an empty result; ties of the smallest id keep
one row; extra columns are kept by :func:`one_of_each` and ignored by :func:`join`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import graphs, textkit
from tidewater.llm.shared import stage

WIDTH = 5
THRESHOLD = 0.8
HASHES, STEP, BAND = 128, 32, 4
TOLERANCE = 1e-6
#: Rows of a block: signatures are compared in larger blocks than whole texts.
SIGNATURE_BLOCK, TEXT_BLOCK = 1024, 512
_rng = np.random.Generator(np.random.PCG64(5))
_MUL = (_rng.integers(0, 2**31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_ORDER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def least_matches(threshold: float) -> dict[int, int]:
    """For n compared values, the fewest matches that keep a pair."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
        out[n] = m
    return out


def shingles(texts: textkit.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hashes, first of each row, word hashes); a text of one to four words is one window."""
    words = texts.word_hash() if len(texts.start) else np.zeros(0, np.uint64)
    windows, first = texts.windows(words, WIDTH)
    n = texts.n_words
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        extra = np.array([textkit.mix(np.array([sum(int(words[texts.first[i] + k]) * int(textkit._ODD[k]) for k in range(n[i])) + int(n[i]) & 2**64 - 1], np.uint64))[0] for i in short], np.uint64)
        windows = np.insert(windows, first[short], extra)
        first = np.concatenate([[0], np.cumsum(np.diff(first) + np.isin(np.arange(len(n)), short))])
    return windows, first, words


def signatures(windows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each row that has windows."""
    has = np.diff(first) > 0
    out = np.empty((int(has.sum()), HASHES), np.uint32)
    if len(out):
        low, starts = (windows >> np.uint64(32)).astype(np.uint32), first[:-1][has]
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(low * _MUL[k] + _ADD[k], starts)
    return out


def _class_ids(texts: textkit.Texts, words: np.ndarray) -> np.ndarray:
    """16 bytes from the words in order, for each row that has words."""
    n = texts.n_words
    has = n > 0
    if not has.any():
        return np.zeros(0, "V16")
    place = np.arange(len(words)) - np.repeat(texts.first[:-1][has], n[has])
    sums = [np.add.reduceat(words * textkit.powers(q, int(n.max()))[place], texts.first[:-1][has]) for q in _ORDER]
    return np.ascontiguousarray(np.stack([textkit.mix(s + n[has].astype(np.uint64)) for s in sums], 1)).view("V16").ravel()


def _fixed(values: np.ndarray, has: np.ndarray, width: int) -> pa.Array:
    """Binary values for the rows that have one, null for the others."""
    ends = np.concatenate([[0], np.cumsum(has)]).astype(np.int32) * width
    mask = pa.py_buffer(np.packbits(has, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(has), [mask, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text_hash, cid, sig) of each row; cid and sig are null without words."""
    slim = docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[text_col].cast("string")).alias("_text_hash"), docs[text_col].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, at in textkit.slices(b.column(2)):
                texts = textkit.Texts(data, at)
                windows, starts, words = shingles(texts)
                has = texts.n_words > 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), b.column(1).slice(first, end - first), _fixed(_class_ids(texts, words), has, 16), _fixed(signatures(windows, starts), has, 4 * HASHES)], ["_id", "_text_hash", "cid", "sig"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _text_hash long, cid binary, sig binary")


def surviving(sig: np.ndarray, own: np.ndarray | None, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pruning leaves; with ``own``, only pairs of different blocks."""
    n, left, right = len(sig), [], []
    stripe = max(1, (1 << 22) // (STEP * max(n, 1)))
    for at in range(0, n, stripe):
        end = min(n, at + stripe)
        hits = (sig[at:end, None, :STEP] == sig[None, :, :STEP]).sum(2, dtype=np.int32)
        a, b = np.nonzero(hits >= least[STEP])
        m, a = hits[a, b], a + at
        keep = a < b
        if own is not None:
            keep &= own[a] != own[b]
        a, b, m = a[keep], b[keep], m[keep]
        for done in range(STEP, HASHES, STEP):
            m = m + (sig[a, done : done + STEP] == sig[b, done : done + STEP]).sum(1, dtype=np.int32)
            keep = m >= least[done + STEP]
            a, b, m = a[keep], b[keep], m[keep]
        left.append(a)
        right.append(b)
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def candidate_edges(batches: Iterator[pa.RecordBatch], least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Cells of (bucket, lo, hi, own, cid, sig) to edges that join what pruning leaves: one a class at most."""
    for table, edges in graphs.by_cell(batches):
        sig, own, cid = _matrix(table["sig"]), table["own"].to_numpy(), np.array(table["cid"].to_pylist(), object)
        lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
        sizes, starts = np.diff(edges), edges[:-1]
        two = starts[(sizes == 2) & (lo[starts] == hi[starts])]  # most cells are pairs: all at once
        matches = (sig[two] == sig[two + 1]).sum(1)
        two = two[matches >= least[HASHES]]
        u, v = [two], [two + 1]
        for at, size in zip(starts, sizes, strict=True):
            across = lo[at] != hi[at]
            if size < 2 or size == 2 and not across:
                continue
            # In order of class ids, so that a group is joined to the same root whatever the band.
            part = at + np.argsort(cid[at : at + size], kind="stable")
            root = graphs.forest(size, *surviving(sig[part], own[part] if across else None, least))
            moved = np.flatnonzero(root != np.arange(size))
            u.append(part[root[moved]])
            v.append(part[moved])
        u, v = np.concatenate(u), np.concatenate(v)
        yield pa.RecordBatch.from_arrays([pa.array(cid[u], pa.binary()), pa.array(cid[v], pa.binary())], ["u", "v"])


def verified_links(batches: Iterator[pa.RecordBatch], threshold: float, least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Cells of (component, lo, hi, own, cid, copies, text) to (cid, root, links, texts): exact links of each class in the cell."""
    for table, edges in graphs.by_cell(batches):
        out: list[list] = [[], [], [], []]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            part = table.slice(int(at), int(end - at))
            cid = np.array(part["cid"].to_pylist(), object)
            _, firsts = np.unique(cid, return_index=True)  # repeated rows bring a class more than once
            part, cid, n = part.take(firsts), cid[firsts], len(firsts)
            own, copies = part["own"].to_numpy(), part["copies"].to_numpy()
            sets: list[np.ndarray] = []
            sig = []
            for _, _, data, offsets in textkit.slices(part["text"]):
                windows, starts, _ = shingles(textkit.Texts(data, offsets))
                sets += [np.unique(windows[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                sig.append(signatures(windows, starts))
            across = own if part["lo"][0].as_py() != part["hi"][0].as_py() else None
            a, b = surviving(np.concatenate(sig), across, least)
            linked = np.zeros(len(a), bool)
            for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                x, y = sets[i], sets[j]
                if len(x) > len(y):
                    x, y = y, x
                if len(x) >= threshold * len(y):
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    linked[k] = both >= threshold * (len(x) + len(y) - both)
            a, b = a[linked], b[linked]
            links, texts = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j in ((a, b), (b, a)):
                np.add.at(links, i, copies[j])
                np.add.at(texts, i, 1)
            root, has = graphs.forest(n, a, b), np.flatnonzero(texts)
            for kept, x in zip(out, (cid[has], cid[root[has]], links[has], texts[has]), strict=True):
                kept += x.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["cid", "root", "links", "texts"])


def linked_classes(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, component, copies, links, texts) of each class with words; component is null without links."""
    least = least_matches(threshold)
    classes = stage(signed.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_text_hash")).alias("first"), F.first("sig").alias("sig")), "classes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * BAND * k, 4 * BAND)) for k in range(HASHES // BAND)])
    buckets = classes.select("cid", F.explode(bands).alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = buckets.join(full, "bucket").join(classes.select("cid", "sig"), "cid")
    dealt = graphs.cells(members, "bucket", "cid", SIGNATURE_BLOCK).select("bucket", "lo", "hi", "own", "cid", "sig")
    candidates = graphs.components(dealt.mapInArrow(lambda it: candidate_edges(it, least), "u binary, v binary"))
    joined = candidates.select(F.col("node").alias("cid"), "component").join(classes.select("cid", "copies", "first"), "cid")
    joined = joined.select("cid", F.xxhash64("component").alias("component"), "copies", F.col("first._id").alias("_id"), F.col("first._text_hash").alias("_text_hash"))
    texts = docs.select(docs[id_col].alias("_doc"), F.xxhash64(docs[text_col].cast("string")).alias("_hash"), docs[text_col].cast("string").alias("text"))
    members = joined.join(texts, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))).withColumn("_size", F.octet_length("text"))
    dealt = graphs.cells(members, "component", "cid", TEXT_BLOCK, "_size").select("component", "lo", "hi", "own", "cid", "copies", "text")
    links = stage(dealt.mapInArrow(lambda it: verified_links(it, threshold, least), "cid binary, root binary, links long, texts long"), "links")
    groups = graphs.components(links.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    return classes.select("cid", "copies").join(groups.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, class_id (smallest id of its group), n_links (documents linked, copies included) and n_text_links (different texts linked)."""
    signed = stage(sign(docs, id_col, text_col), "signed")
    classes = linked_classes(docs, signed, id_col, text_col, threshold)
    rows = stage(signed.select("_id", "cid").join(classes, "cid", "left").withColumn("group", F.coalesce("component", "cid")), "rows")
    smallest = rows.filter("copies > 1 or component is not null").groupBy("group").agg(F.min("_id").alias("smallest"))
    out = rows.join(smallest, "group", "left")
    alone = F.when(F.col("cid").isNull() | F.col("smallest").isNull(), F.col("_id")).otherwise(F.col("smallest"))
    return out.select(F.col("_id").alias(id_col), alone.alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id, with all its columns."""
    signed = stage(sign(docs, id_col, text_col), "signed")
    classes = linked_classes(docs, signed, id_col, text_col, threshold)
    rows = signed.select("_id", "_text_hash", "cid").join(classes, "cid").filter("copies > 1 or component is not null")
    rows = stage(rows.select("_id", "_text_hash", F.coalesce("component", "cid").alias("group")), "rows")
    order = F.struct(F.col("_id").isNull(), "_id", "_text_hash")
    kept = rows.groupBy("group").agg(F.min(order).alias("kept")).select(F.col("kept._id").alias("_kept"), F.col("kept._text_hash").alias("_kept_hash"), F.lit(True).alias("_is_kept"))
    # Joined by document and not by group, so that a group of any size is spread.
    fate = rows.groupBy("_id", "_text_hash").count().join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_text_hash") == F.col("_kept_hash")), "left")
    fate = fate.select(F.col("_id").alias("_fate_id"), F.col("_text_hash").alias("_fate_hash"), F.coalesce("_is_kept", F.lit(False)).alias("_stays"), (F.col("count") > 1).alias("_repeated"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), F.xxhash64(docs[text_col].cast("string")).alias("_text_hash"))
    told = packed.join(fate, F.col("_id").eqNullSafe(F.col("_fate_id")) & (F.col("_text_hash") == F.col("_fate_hash")), "left")
    single = told.filter("_stays is null or (_stays and not _repeated)").select("_row")
    repeated = told.filter("_stays and _repeated").groupBy("_id", "_text_hash").agg(F.first("_row").alias("_row")).select("_row")
    return single.union(repeated).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL for :func:`join` over ``documents``: all pairs that share a window, and reachability by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
n AS (SELECT r, doc_id, words, len(words) AS n FROM w WHERE len(words) > 0),
g AS (
  SELECT DISTINCT r, CASE WHEN n < 5 THEN concat_ws(' ', n, words[1], words[2], words[3], words[4]) ELSE concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) END AS gram
  FROM n, range(1, greatest(n - 4, 1) + 1) AS t(i)),
s AS (SELECT r, count(*) AS size FROM g GROUP BY r),
p AS (SELECT a.r, b.r AS o, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT p.r, p.o FROM p JOIN s x ON x.r = p.r JOIN s y ON y.r = p.o WHERE shared >= 0.8 * (x.size + y.size - shared)),
c AS (
  SELECT r, r AS root FROM w
  UNION
  SELECT l.o, c.root FROM c JOIN l ON l.r = c.r),
k AS (SELECT c.r, min(w.doc_id) AS class_id FROM c JOIN w ON w.r = c.root GROUP BY c.r),
m AS (SELECT l.r, count(*) AS n_links, count(DISTINCT b.words) FILTER (WHERE a.words <> b.words) AS n_text_links FROM l JOIN w a ON a.r = l.r JOIN w b ON b.r = l.o GROUP BY l.r)
SELECT w.doc_id, k.class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links
FROM w JOIN k USING (r) LEFT JOIN m USING (r)
"""
