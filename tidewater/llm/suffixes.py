"""Repeated byte strings by a distributed suffix array.

Every string of ``SPAN`` bytes has one anchor, the least of its ``GRAM``-byte grams by hash (the leftmost
of equals), so equal strings have their anchors at the same place, wherever they stand. Only suffixes at
anchors are sorted, about one in 93 bytes; a suffix comes with the bytes before it that the strings of
its anchor may begin with.

1. Suffixes are range-partitioned by Spark's sampled splitters on (leading tokens, whole context, place)
   as digests, so that even a token in a third of all texts lies in many buckets. In a bucket, suffixes
   that share their whole context are decided, and those whose leading tokens occur once go. What a
   bucket's edge may have cut goes on to be compared.
2. The bytes of the others are range-partitioned by leading tokens and sorted in both directions by
   multikey quicksort, eight bytes a character. With the lengths that neighbours share, strings that
   begin d bytes before their anchors are equal if they are in one class of both orders, at depth
   ``SPAN - d`` and d; all texts of a bucket are compared by one pass a d.
3. Leading tokens of more than ``MOST`` open suffixes would fill a bucket. Their strings are halved by
   their distance to the anchor, and each half is dealt by all the bytes that its strings share, until
   a group is small enough to be sorted, or its members agree as a whole (128-bit digests).

Defined results: a null text is empty; a text shorter than ``SPAN`` bytes keeps all; rows that repeat an
id and text are copies of each other like any; an empty table gives an empty result; null ids are
returned as null; extra columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import textkit
from tidewater.llm.shared import drop_staged, new_path, stage

SPAN = 200
GRAM = 16
#: Grams of a string, and so the number of places an anchor can have in it.
WIDTH = SPAN - GRAM + 1
#: Open suffixes of one group that a bucket may hold.
MOST = 1000
#: Suffixes of a bucket, about 300 bytes each.
BUCKET_ROWS = 40_000
LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``gram`` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(textkit._BYTE[data] * textkit.powers(textkit._BASE, n)[:n], out=sums[1:])
    return textkit.mix((sums[gram:] - sums[:-gram]) * textkit.powers(textkit._INVERSE, n)[: n - gram + 1])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def anchors(data: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, first start, last start, lead) for each run of strings that share an anchor, within rows; places count from the slice's start."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none, none
    hashes = gram_hashes(data, gram)
    anchor = (least((hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64), span - gram + 1) & LOW).astype(np.int64)
    last = at[1:] - span + 1
    edge = np.zeros(len(anchor) + 1, np.int64)
    has = last > at[:-1]
    np.add.at(edge, at[:-1][has], 1)
    np.add.at(edge, last[has], -1)
    start = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    if not len(start):
        return none, none, none, none, none
    own = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    first, end = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    return np.searchsorted(at, first, "right") - 1, own[new], first, end, hashes[own[new]].view(np.int64)


def pack(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An anchor's place in its text, and how far before it its strings begin: ``high`` to ``low`` bytes."""
    return (anchor << 16) | (low << 8) | high


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 255, place & 255


KEYS = "id long, hash long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two hashes name a row: rows that share them share id and text, and so their results."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("doc"), F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    textkit.keep_heap()
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, end, data, at in textkit.slices(batch.column(2)):
            row, anchor, low, high, lead = anchors(data, at)
            whole = memoryview(data)
            digest = b"".join(hashlib.blake2b(whole[s : e + SPAN], digest_size=8).digest() for s, e in zip(low.tolist(), high.tolist(), strict=True))
            place = pack(anchor - at[row], anchor - low, anchor - high)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lead, np.frombuffer(digest, np.int64), ids[first:end][row], hashes[first:end][row], place)], names=["lead", "context", "id", "hash", "place"])


def _bucket(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All of a task's rows: a bucket of the range partition."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each entry, length of each run) from the flags of first entries."""
    run = np.cumsum(new) - 1
    return run, np.bincount(run)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which suffixes of a sorted bucket are repeated with their whole context, and which have to be compared."""
    t = _bucket(batches)
    if t is None:
        return
    lead, context = t.column("lead").to_numpy(), t.column("context").to_numpy()
    new_lead = np.concatenate([[True], lead[1:] != lead[:-1]])
    new_context = new_lead | np.concatenate([[True], context[1:] != context[:-1]])
    by_lead, lead_rows = _runs(new_lead)
    by_context, context_rows = _runs(new_context)
    repeated = context_rows[by_context] > 1
    lone = np.bincount(by_lead, weights=~repeated)
    cut = (lead == lead[0]) | (lead == lead[-1])
    asks = np.where(repeated, new_context & ((lone[by_lead] > 0) | cut), (lead_rows[by_lead] > 1) | cut)
    keep = repeated | asks
    yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(keep)) for c in ("id", "hash", "place")] + [pa.array(repeated[keep]), pa.array(asks[keep])], names=["id", "hash", "place", "repeated", "asks"])


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the intervals cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    on = np.concatenate([[0], (np.cumsum(edge)[:n] > 0).view(np.int8), [0]])
    turn = np.diff(on)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"


def removal(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    start, end = cover(len(text), starts, ends)
    kept, last = hashlib.sha256(), 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept.update(text[last:s])
        last = e
    kept.update(text[last:])
    return len(text), int((end - start).sum()), len(start), kept.hexdigest(), [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)]


#: A row is a document's result (0), a document that waits for comparisons (1), or a suffix to be compared (2).
PARTS = f"kind int, doc long, {KEYS}, text binary, repeated array<long>, place long, tokens binary, context binary, asks boolean, " + RESULT
_PARTS = ["kind", "doc", "id", "hash", "text", "repeated", "place", "tokens", "context", "asks", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS]
#: Bytes of rows made before they are handed on.
FLUSH = 8 << 20


def _intervals(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    anchor, low, high = unpack(places)
    return anchor - low, anchor - high + SPAN


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def flush():
        columns = list(zip(*rows, strict=True))
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_PARTS)
        rows.clear()
        return out

    for batch in batches:
        for doc, key, own, text, repeated, asks in zip(*(batch.column(k) for k in range(6)), strict=True):
            doc, key, own = doc.as_py(), key.as_py(), own.as_py()
            text = text.as_py().encode()
            found = np.array(repeated.as_py() or [], np.int64)
            asked = np.array(asks.as_py() or [], np.int64)
            open_ = asked[~np.isin(asked, found)]
            if len(open_):
                rows.append((1, doc, key, own, text, found.tolist(), *[None] * 9))
                held += len(text)
            else:
                rows.append((0, doc, key, own, *[None] * 6, *removal(text, *_intervals(found))))
            waits = set(open_.tolist())
            for place, anchor, low, high in zip(asked.tolist(), *(x.tolist() for x in unpack(asked)), strict=True):
                context = text[anchor - low : anchor - high + SPAN]
                rows.append((2, None, key, own, None, None, place, text[anchor : anchor + GRAM], context, place in waits, *[None] * 5))
                held += len(context) + 100
            if held > FLUSH:
                held = 0
                yield flush()
    if rows:
        yield flush()


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of 8-byte characters, filled up with zeros; ``width`` is rounded up to whole characters."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows in byte order, and how many leading bytes each shares with the one before it.

    Groups that are equal so far are sorted by their next character alone; groups of one are done.
    """
    n, depth = words.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    shared = np.full(n, depth * 8, np.int64)
    shared[:1] = 0
    for k in range(depth):
        size = np.bincount(group)
        live = np.flatnonzero(size[group] > 1)
        if not len(live):
            break
        key = words[order[live], k]
        by = np.lexsort((key, group[live]))
        order[live], key = order[live][by], key[by]
        new = np.flatnonzero((key[1:] != key[:-1]) & (group[live][1:] == group[live][:-1])) + 1
        differ = key[new] ^ key[new - 1]
        shared[live[new]] = k * 8 + np.searchsorted(-(np.uint64(1) << np.arange(56, 0, -8, dtype=np.uint64)).astype(np.float64), -differ.astype(np.float64), "left")
        parts = np.zeros(n, np.int64)
        parts[live[new]] = 1
        group = np.cumsum(parts | np.concatenate([[0], (group[1:] != group[:-1])]))
    return order, shared


def matched(contexts: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``out[i, d]``: the string that begins d bytes before anchor i equals one at another anchor."""
    n = len(contexts)
    out = np.zeros((n, WIDTH), bool)
    right, shared_right = multikey_sort(padded([c[k:] for c, k in zip(contexts, low.tolist(), strict=True)], SPAN))
    left, shared_left = multikey_sort(padded([c[:k][::-1] for c, k in zip(contexts, low.tolist(), strict=True)], WIDTH - 1))
    # a string reaches at least SPAN - low bytes past its anchor: suffixes whose neighbours share less have none
    best = np.zeros(n, np.int64)
    best[right] = np.maximum(shared_right, np.append(shared_right[1:], 0))
    alive = best >= SPAN - low
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(WIDTH):
        at = np.flatnonzero(alive & (low >= d) & (high <= d))
        if len(at) < 2:
            continue
        by_right[right] = np.cumsum(shared_right < SPAN - d)
        by_left[left] = np.cumsum(shared_left < d)
        pair = by_right[at] * (n + 1) + by_left[at]
        order = np.argsort(pair)
        same = pair[order[1:]] == pair[order[:-1]]
        hit = np.zeros(len(at), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out[at[hit], d] = True
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated strings of a bucket, as runs of bytes."""
    t = _bucket(batches)
    if t is None:
        return
    anchor, reach, _ = unpack(t.column("place").to_numpy())
    near, far = t.column("near").to_numpy(), t.column("far").to_numpy()
    contexts = [c[r - f : r + SPAN - n] for c, r, n, f in zip(t.column("context").to_pylist(), reach.tolist(), near.tolist(), far.tolist(), strict=True)]
    hit = matched(contexts, far, near) & t.column("asks").to_numpy()[:, None]
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(row), t.column("hash").combine_chunks().take(row), pa.array(anchor[row] - last), pa.array(anchor[row] - first + SPAN)], names=["id", "hash", "start", "end"])


FOUND = f"{KEYS}, start long, end long"
#: A suffix with the strings that begin ``far`` to ``near`` bytes before its anchor, and the bytes that its group shares.
OPEN = f"core binary, {KEYS}, place long, near long, far long, context binary, asks boolean"
#: A found run (0), or a suffix whose strings are still open (1).
REFINED = f"kind int, {OPEN}, start long, end long"
#: Halvings of the 256 distances before an anchor.
HALVINGS = 8


def _refined(level: int):
    """Decide the suffixes of a crowded group that repeat as a whole, and deal the others anew, in halves by distance and by the bytes that each half shares."""
    width = 1 << (HALVINGS - level - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _bucket(batches)
        if t is None:
            return
        core, whole = (t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("core", "whole"))
        new_core = np.concatenate([[True], core[1:] != core[:-1]])
        new_whole = new_core | np.concatenate([[True], whole[1:] != whole[:-1]])
        by_core, _ = _runs(new_core)
        by_whole, rows_whole = _runs(new_whole)
        repeated = rows_whole[by_whole] > 1
        lone = np.bincount(by_core, weights=~repeated)
        cut = (core == core[0]) | (core == core[-1])
        goes_on = ~repeated | (new_whole & ((lone[by_core] > 0) | cut))
        asks = t.column("asks").to_numpy()
        place, near, far = (t.column(c).to_numpy() for c in ("place", "near", "far"))
        anchor, reach, _ = unpack(place)
        hit = np.flatnonzero(repeated & asks)
        none = pa.nulls(len(hit), pa.int64())
        take = lambda c, at: t.column(c).combine_chunks().take(pa.array(at))
        names = [x.split()[0] for x in REFINED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(hit), np.int32)), pa.nulls(len(hit), pa.binary()), take("id", hit), take("hash", hit), none, none, none, pa.nulls(len(hit), pa.binary()), pa.nulls(len(hit), pa.bool_()), pa.array(anchor[hit] - far[hit]), pa.array(anchor[hit] - near[hit] + SPAN)], names=names)
        on = np.flatnonzero(goes_on)
        contexts = take("context", on).to_pylist()
        at, cores, nears, fars = [], [], [], []
        for k, (i, r, n, f) in enumerate(zip(on.tolist(), reach[on].tolist(), near[on].tolist(), far[on].tolist(), strict=True)):
            for cell in range(n // width, f // width + 1):
                first, last = cell * width, min(cell * width + width, WIDTH) - 1
                cores.append(hashlib.blake2b(contexts[k][r - first : r + SPAN - last], digest_size=16, salt=cell.to_bytes(2, "big")).digest())
                at.append(i)
                nears.append(max(n, first))
                fars.append(min(f, last))
        at = np.array(at, np.int64)
        gone = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(cores, pa.binary()), take("id", at), take("hash", at), take("place", at), pa.array(nears, pa.int64()), pa.array(fars, pa.int64()), take("context", at), pa.array((asks & ~repeated)[at]), gone, gone], names=names)

    return run


def compare(asked: DataFrame, most: int = MOST) -> DataFrame:
    """(id, hash, start, end): the repeated strings of the suffixes that ask.

    Each round takes the groups of more than ``most`` suffixes that share a core; after ``HALVINGS``
    rounds a core is a string, and all of a group are equal.
    """
    spark = asked.sparkSession
    columns = [x.split()[0] for x in OPEN.split(", ")]
    high = F.col("place").bitwiseAND(F.lit(255))
    low = F.shiftright("place", 8).bitwiseAND(F.lit(255))
    rows, alone, found = asked.withColumnsRenamed({"tokens": "core"}).withColumns({"near": high, "far": low}).select(*columns), [], []
    for level in range(HALVINGS + 1):
        crowded = stage(rows.groupBy("core").count().filter(F.col("count") > most).select("core", F.lit(True).alias("crowded")), "crowded")
        marked = rows.join(crowded, "core", "left")
        alone.append(marked.filter("crowded is null").drop("crowded"))
        if crowded.isEmpty():
            break
        busy = marked.filter("crowded").drop("crowded")
        anchor = F.shiftright("place", 16)
        if level == HALVINGS:
            found.append(busy.filter("asks").select(*KEYS_, (anchor - F.col("far")).alias("start"), (anchor - F.col("near") + SPAN).alias("end")))
            break
        begins = (low - F.col("far") + 1).cast("int")
        whole = F.unhex(F.md5(F.concat(F.col("near").cast("string").cast("binary"), F.substring("context", begins, (F.col("far") - F.col("near") + SPAN).cast("int")))))
        order = ["core", "whole", "id", "hash", "place"]
        path = new_path(spark, f"halved-{level}")
        busy.withColumn("whole", whole).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_refined(level), REFINED).write.partitionBy("kind").parquet(path)
        refined = spark.read.schema(REFINED).parquet(path)
        found.append(refined.filter("kind = 0").select(*KEYS_, "start", "end"))
        rows = refined.filter("kind = 1").select(*columns)
    rest = reduce(DataFrame.unionByName, alone)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rest.count() // BUCKET_ROWS))
    compared = rest.repartitionByRange(tasks, "core").mapInArrow(_compared, FOUND)
    return reduce(DataFrame.unionByName, found, compared)


KEYS_ = ["id", "hash"]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, repeated, starts, ends in zip(*(batch.column(k) for k in range(5)), strict=True):
            first, last = _intervals(np.array(repeated.as_py() or [], np.int64))
            starts = np.concatenate([first, np.array(starts.as_py() or [], np.int64)])
            rows.append((doc.as_py(), *removal(text.as_py(), starts, np.concatenate([last, np.array(ends.as_py() or [], np.int64)]))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *_KINDS[10:]], strict=True)], names=["doc", *_PARTS[10:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) of each row; ``removed`` holds the byte spans."""
    spark, rows = docs.sparkSession, keyed(docs, id_col, text_col)
    order = ["lead", "context", "id", "hash", "place"]
    suffixes = rows.select("id", "hash", "text").filter(F.octet_length("text") >= SPAN).mapInArrow(_suffixes, "lead long, context long, id long, hash long, place long")
    screened = stage(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_screen, f"{KEYS}, place long, repeated boolean, asks boolean"), "screened")
    known = screened.groupBy("id", "hash").agg(F.collect_set(F.when(F.col("repeated"), F.col("place"))).alias("repeated"), F.collect_set(F.when(F.col("asks"), F.col("place"))).alias("asks"))
    path = new_path(spark, "parts")
    rows.join(known, KEYS_, "left").select("doc", "id", "hash", "text", "repeated", "asks").mapInArrow(_parts, PARTS).write.partitionBy("kind").parquet(path)
    parts = spark.read.schema(PARTS).parquet(path)
    done = parts.filter("kind = 0").select("doc", *_PARTS[10:])
    found = stage(compare(parts.filter("kind = 2").select(*KEYS_, "place", "tokens", "context", "asks"), most), "found")
    found = found.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select("id", "hash", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    waiting = parts.filter("kind = 1").select("doc", "id", "hash", "text", "repeated").join(found, KEYS_, "left")
    late = waiting.select("doc", "text", "repeated", "starts", "ends").mapInArrow(_finish, f"doc long, {RESULT}")
    drop_staged(screened)
    return done.unionByName(late).withColumnRenamed("doc", id_col)


#: DuckDB SQL for :func:`remove_repeats` over ``documents``, without the spans: every string of 200 bytes by its 128-bit digest, on hexadecimal text cut into overlapping parts.
ORACLE = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
c AS (SELECT r, k, b[400 * k + 1:400 * k + 798] AS part FROM (SELECT r, b, unnest(range(0, len(b) // 400 + 1)) AS k FROM d WHERE len(b) >= 400)),
w AS (SELECT r, 200 * k + unnest(range(0, least(200, len(part) // 2 - 199))) AS p0, unnest(list_transform(range(0, least(200, len(part) // 2 - 199)), lambda q: md5_number(part[2 * q + 1:2 * q + 400]))) AS h FROM c WHERE len(part) >= 400),
m AS (SELECT r, p0 FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, p0, coalesce(p0 > lag(p0) OVER (PARTITION BY r ORDER BY p0) + 200, true) AS new FROM m),
i AS (SELECT r, p0, sum(new::INT) OVER (PARTITION BY r ORDER BY p0) AS k FROM g),
x AS (SELECT r, k, min(p0) AS a, max(p0) + 200 AS z FROM i GROUP BY r, k),
y AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS was FROM x),
t AS (SELECT r, string_agg(b[2 * was + 1:2 * a], '' ORDER BY a) AS kept, max(z) AS last, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM y JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(b) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || b[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""
