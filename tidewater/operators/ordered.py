"""Stateful scans of readings in time order: pairs, segments, crossings, stretches, windows, verdicts.

What a neighbour decides is a window function. What depends on the scan's own past (a carry that is
thrown away, a reference that follows accepted values) is a fold: rows stream through a task in
order, a key after another, with the state of one key in memory and never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.functions.values import FIVE_HOURS, MINUTE, SECOND, same_reset
from tidewater.operators.cut import dealt

Step = Callable[[tuple], Iterable[tuple]]


def _scalars(column: pd.Series) -> list:
    """A column as plain Python values, None where one is missing."""
    values = column.tolist()
    if column.dtype.kind in "iub" or not (missing := column.isna().to_numpy()).any():
        return values
    return [None if gone else v for v, gone in zip(values, missing, strict=True)]


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], make: Callable[[], tuple[Step, Callable[[], Iterable[tuple]]]], schema: str, spread: bool = False) -> DataFrame:
    """Stream the rows of each key in order through a state machine.

    ``make`` returns (row function, end function) with fresh state for a key; both yield output rows
    without the key columns, which ``schema`` must start with. With ``spread``, keys are dealt over a
    number of tasks that stays: no shuffle where they are dealt so already.
    """
    by, n = list(by), len(by)
    names = [x.strip().split()[0] for x in schema.split(",")]
    columns = [*by, *[c for c in df.columns if c not in by]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        step, end = make()
        for frame in frames:
            out: list[tuple] = []
            for row in zip(*map(_scalars, (frame[c] for c in frame.columns)), strict=True):
                if row[:n] != key:
                    if key is not None:
                        out += [(*key, *x) for x in end()]
                    key = row[:n]
                    step, end = make()
                out += [(*key, *x) for x in step(row[n:])]
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None and (rest := [(*key, *x) for x in end()]):
            yield pd.DataFrame(rest, columns=names)

    slim = df.select(*columns)
    return (dealt(slim, *by) if spread else slim.repartition(*by)).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


# --- pairs -----------------------------------------------------------------------------------


def pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row after the first of its key, with the row before it as ``prev_*``."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns}).withColumn("_n", F.row_number().over(w)).filter("_n > 1").drop("_n")


def is_reset(value: str = "five_hour", reset: str = "resets_us", ts: str = "ts_us", length: int = FIVE_HOURS) -> Column:
    """Does a window reset lie between a pair's readings, also where one of them names none."""
    a, b, ar, br, at, bt = (F.col(c) for c in (f"prev_{value}", value, f"prev_{reset}", reset, f"prev_{ts}", ts))
    past_end = br.isNull() & ar.isNotNull() & (bt > ar + 5 * SECOND)
    before_start = ar.isNull() & (a > 0) & br.isNotNull() & (at < br - length - 60 * SECOND)
    return ~same_reset(ar, br) | past_end | before_start | (b < a)


def reading_pairs(readings: DataFrame, max_gap: int, by: Sequence[str] = ("account",), order: Sequence[str] = ("ts_us", "seq")) -> DataFrame:
    """Neighbouring readings with ``delta``, ``is_reset`` and ``broken`` (a reset, or a gap longer than ``max_gap``)."""
    out = pairs(readings, by, order, ["ts_us", "seq", "five_hour", "seven_day", "resets_us", "seven_resets_us"])
    out = out.withColumn("is_reset", is_reset()).withColumn("delta", F.col("five_hour") - F.col("prev_five_hour"))
    return out.withColumn("broken", F.col("is_reset") | (F.col("ts_us") - F.col("prev_ts_us") > max_gap))


# --- gaps and islands ----------------------------------------------------------------------------


def segment_ids(df: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, name: str = "segment") -> DataFrame:
    """Number the runs between rows where ``breaks`` holds (such a row starts a run)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("bigint")).over(w))


def bursts(events: DataFrame, by: Sequence[str], ts: str, order: Sequence[str], idle: int) -> DataFrame:
    """Session number of each event: a silence of ``idle`` or more starts a session."""
    gap = F.col(ts) - F.lag(ts).over(W.partitionBy(*by).orderBy(ts, *order)) >= idle
    marked = events.withColumn("_new", F.coalesce(gap, F.lit(False)))
    return segment_ids(marked, by, [ts, *order], F.col("_new"), "burst").drop("_new")


def runs_of(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Number the runs of equal neighbouring values."""
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(W.partitionBy(*by).orderBy(*order)))
    return segment_ids(df.withColumn("_new", changed), by, order, F.col("_new"), name).drop("_new")


def meter_segments(readings: DataFrame, max_gap: int, by: Sequence[str] = ("account",)) -> DataFrame:
    """Readings with the number of their unbroken segment: a reset, a fall or a gap starts one."""
    order = ["ts_us", "seq"]
    w = W.partitionBy(*by).orderBy(*order)
    out = readings.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("ts_us", "five_hour", "resets_us")})
    broken = F.col("prev_ts_us").isNotNull() & (is_reset() | (F.col("ts_us") - F.col("prev_ts_us") > max_gap))
    return segment_ids(out.withColumn("_new", broken), by, order, F.col("_new")).drop("_new", "prev_ts_us", "prev_five_hour", "prev_resets_us")


def reset_brackets(readings: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """(lower, upper) around each fall of the meter."""
    fell = pairs(readings, by, ["ts_us", "seq"], ["ts_us", "five_hour"]).filter("five_hour < prev_five_hour")
    return fell.select(*by, F.col("prev_ts_us").alias("lower_us"), F.col("ts_us").alias("upper_us"))


# --- pooled movement -------------------------------------------------------------------------------


def pooled(pair_rows: DataFrame, threshold: float, survives: bool, by: Sequence[str] = ("account",), spread: bool = False) -> DataFrame:
    """Pairs that count, with the ordinal of the movement they pool into and whether they start a piece.

    A movement closes once it reaches ``threshold``; what overshoots is thrown away. With ``survives``, it
    goes on over broken pairs in a new piece; without, a broken pair drops it. ``closed`` tells whether
    the movement reached the threshold by this pair.
    """

    def make() -> tuple[Step, Callable[[], Iterable[tuple]]]:
        state = {"sum": 0.0, "open": False, "piece": True, "ordinal": 0}

        def step(row: tuple) -> Iterable[tuple]:
            ts, seq, prev_ts, delta, broken = row
            if broken:
                state["piece"] = True
                if not survives:
                    state["open"], state["sum"] = False, 0.0
                return ()
            if not state["open"]:
                state["open"], state["sum"] = True, 0.0
                state["ordinal"] += 1
                starts = True
            else:
                starts = state["piece"]
            state["piece"] = False
            state["sum"] += delta
            closed = state["sum"] >= threshold
            if closed:
                state["open"] = False
            return ((ts, seq, prev_ts, float(delta), state["ordinal"], starts, closed),)

        return step, tuple

    types = {f.name: f.dataType.simpleString() for f in pair_rows.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "ts_us bigint", "seq bigint", "prev_ts_us bigint", "delta double", "ordinal bigint", "starts_piece boolean", "closed boolean"])
    slim = pair_rows.select(*by, "ts_us", "seq", "prev_ts_us", F.col("delta").cast("double").alias("delta"), "broken")
    return fold(slim, by, ["ts_us", "seq"], make, schema, spread)


def stretches(pair_rows: DataFrame, threshold: float = 10, by: Sequence[str] = ("account",), survives: bool = True) -> tuple[DataFrame, DataFrame]:
    """(closed movements, their pairs): start, end, delta and windows of each, and the pairs to join events to."""
    marked = pooled(pair_rows, threshold, survives, by)
    return closed_movements(marked, by), marked


def closed_movements(marked: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Start, end, delta and windows of each movement of pooled pairs that closed."""
    keys = [*by, "ordinal"]
    whole = marked.groupBy(*keys).agg(F.min("prev_ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.sum("delta").alias("delta_pct"), F.count_if("starts_piece").alias("windows"), F.bool_or("closed").alias("closed"))
    return whole.filter("closed").drop("closed")


# --- crossings ----------------------------------------------------------------------------------------


def crossings(readings: DataFrame, meter: str, reset: str, max_gap: int, by: Sequence[str] = ("account",)) -> DataFrame:
    """A row for each whole point passed between neighbouring readings: bracket, value, window and segment.

    A reset, a fall or a null ends the window; a longer gap ends the segment alone, and nothing is emitted
    across either. A window is named by the reset (else the time) of its first usable pair.
    """
    order = ["ts_us", "seq"]
    out = pairs(readings, by, order, ["ts_us", meter, reset])
    a, b, ar, br = F.col(f"prev_{meter}"), F.col(meter), F.col(f"prev_{reset}"), F.col(reset)
    ends = a.isNull() | b.isNull() | ~same_reset(ar, br) | (b < a)
    out = out.withColumn("_ends", F.coalesce(ends, F.lit(True))).withColumn("_gap", F.col("ts_us") - F.col("prev_ts_us") > max_gap)
    out = segment_ids(out, by, order, F.col("_ends"), "window")
    out = segment_ids(out, by, order, F.col("_ends") | F.col("_gap"), "segment")
    named = F.first(F.when(~F.col("_ends") & ~F.col("_gap"), F.coalesce(ar, F.col("prev_ts_us"))), True).over(W.partitionBy(*by, "window").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = out.withColumn("window_us", named).filter(~F.col("_ends") & ~F.col("_gap"))
    lo, hi = F.floor(a).cast("bigint"), F.floor(b).cast("bigint")
    out = out.filter(hi > lo).withColumn("value", F.explode(F.sequence(lo + 1, hi)))
    return out.select(*by, F.col("prev_ts_us").alias("lower_us"), F.col("ts_us").alias("upper_us"), "value", "window_us", "segment")


def unit_steps(crossed: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Neighbouring crossings one point apart tile a segment: [start, end) and the value reached."""
    w = W.partitionBy(*by, "segment").orderBy("value", "upper_us")
    out = crossed.withColumn("end_us", F.lead("upper_us").over(w)).withColumn("_next", F.lead("value").over(w))
    return out.filter(F.col("_next") - F.col("value") == 1).select(*by, "segment", F.col("upper_us").alias("start_us"), "end_us", F.col("_next").alias("value"))


# --- windows of a meter ---------------------------------------------------------------------------------


def window_points(readings: DataFrame, max_gap: int, cap: float = 100, by: Sequence[str] = ("account",)) -> DataFrame:
    """Movement of both meters per five-hour window, in pieces between gaps.

    A chain of pairs after a break joins the last window only if that window's first reset and the
    chain's agree, so the scan is a fold. Windows that did not move, or reached the cap, are left out.
    """

    def close(a: int | None, b: int | None) -> bool:
        return a is None or b is None or abs(a - b) <= MINUTE

    def make() -> tuple[Step, Callable[[], Iterable[tuple]]]:
        state: dict = {"last": None, "window": None, "chain": False}

        def emit() -> Iterable[tuple]:
            w, state["window"] = state["window"], None
            if w and (w["d5"] > 0 or w["d7"] > 0) and w["top"] < cap:
                yield (w["reset"] if w["reset"] is not None else w["end"], w["d5"], w["d7"], w["pieces"], w["reset"] is not None)

        def step(row: tuple) -> Iterable[tuple]:
            ts, _, five, seven, reset, seven_reset = row
            a, state["last"] = state["last"], (ts, five, seven, reset, seven_reset)
            if a is None:
                return
            reset_between = not close(a[3], reset) or reset is None and a[3] is not None and ts > a[3] + 5 * SECOND or a[3] is None and a[1] > 0 and reset is not None and a[0] < reset - FIVE_HOURS - MINUTE or five < a[1]
            if reset_between or ts - a[0] >= FIVE_HOURS or ts - a[0] > max_gap or a[2] is None or seven is None or not close(a[4], seven_reset) or seven < a[2]:
                state["chain"] = False
                return
            w = state["window"]
            if not state["chain"]:
                if w and a[3] is not None and w["reset"] is not None and close(w["reset"], a[3]) and close(w["seven_reset"], a[4]):
                    w["pieces"] += 1
                else:
                    yield from emit()
                    w = state["window"] = {"reset": a[3], "seven_reset": a[4], "d5": 0.0, "d7": 0.0, "pieces": 1, "top": seven}
                state["chain"] = True
            w["d5"] += five - a[1]
            w["d7"] += seven - a[2]
            w["end"], w["top"] = ts, max(w["top"], seven)

        return step, lambda: list(emit())

    types = {f.name: f.dataType.simpleString() for f in readings.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "window_us bigint", "d5 double", "d7 double", "pieces bigint", "reset_verified boolean"])
    return fold(readings.select(*by, "ts_us", "seq", "five_hour", "seven_day", "resets_us", "seven_resets_us"), by, ["ts_us", "seq"], make, schema)


def five_hour_windows(readings: DataFrame, max_gap: int, by: Sequence[str] = ("account",)) -> DataFrame:
    """The windows a log shows: first reset, first and last reading, peak, readings, gaps and seven-day range.

    A reading is compared with the window's first reset, not with its neighbour's, so jitter cannot drift.
    """

    def make() -> tuple[Step, Callable[[], Iterable[tuple]]]:
        state: dict = {"w": None}

        def out() -> Iterable[tuple]:
            if w := state["w"]:
                yield (w["reset"], w["first"], w["last"], w["peak"], w["n"], w["gaps"], w["low"], w["high"])

        def step(row: tuple) -> Iterable[tuple]:
            ts, _, five, seven, reset = row
            if five is None:
                return
            w = state["w"]
            if w is None or w["reset"] is not None and reset is not None and abs(reset - w["reset"]) > MINUTE or five < w["value"]:
                yield from out()
                state["w"] = {"reset": reset, "first": ts, "last": ts, "peak": five, "value": five, "n": 1, "gaps": 0, "low": seven, "high": seven}
                return
            w["gaps"] += ts - w["last"] > max_gap
            w["last"], w["value"], w["peak"], w["n"] = ts, five, max(w["peak"], five), w["n"] + 1
            if seven is not None:
                w["low"] = seven if w["low"] is None else min(w["low"], seven)
                w["high"] = seven if w["high"] is None else max(w["high"], seven)

        return step, lambda: list(out())

    types = {f.name: f.dataType.simpleString() for f in readings.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "reset_us bigint", "first_us bigint", "last_us bigint", "peak double", "readings bigint", "gaps bigint", "seven_low double", "seven_high double"])
    return fold(readings.select(*by, "ts_us", "seq", "five_hour", "seven_day", "resets_us"), by, ["ts_us", "seq"], make, schema)


# --- verdicts and armed detectors ---------------------------------------------------------------------------


def _median(values: Sequence[float]) -> float:
    x, n = sorted(values), len(values)
    return x[n // 2] if n % 2 else (x[n // 2 - 1] + x[n // 2]) / 2


def judge(rates: DataFrame, tolerance: float = 0.15, bootstrap: int = 5, least: int = 4, lookback: int = 8, by: Sequence[str] = ("account",)) -> DataFrame:
    """Accept or withhold each rate against the rolling median of the last accepted ones.

    ``rates`` has start_us, end_us, rate, lo, hi, unpriced (tokens) and segment (0 until the first restart, one
    more after each). While fewer than ``least`` rates are accepted, the reference is the median of the next
    ``bootstrap`` positive rates, and rates wait until there are so many; those left waiting stay unjudged. Verdicts: accepted, unaccounted, surplus, unpriced, unjudged.
    """

    def make() -> tuple[Step, Callable[[], Iterable[tuple]]]:
        pool: list[float] = []
        batch: list[tuple] = []

        def verdict(row: tuple, reference: float) -> tuple:
            start, end, rate, lo, hi = row
            status = "unaccounted" if hi is not None and hi < reference * (1 - tolerance) else "surplus" if lo > reference * (1 + tolerance) else "accepted"
            if status == "accepted":
                pool.append(rate)
                del pool[:-lookback]
            return (start, end, rate, status, reference)

        def step(row: tuple) -> Iterable[tuple]:
            end, start, rate, lo, hi, unpriced = row
            if unpriced and unpriced > 0:
                return [(start, end, rate, "unpriced", None)]
            if batch or len(pool) < least:
                batch.append((start, end, rate, lo, hi))
                spent = [x[2] for x in batch if x[2] > 0]
                if len(spent) < bootstrap:
                    return []
                reference = _median(spent)
                rows = list(batch)
                batch.clear()
                return [verdict(x, reference) for x in rows]
            return [verdict((start, end, rate, lo, hi), _median(pool))]

        return step, lambda: [(*x[:3], "unjudged", None) for x in batch]

    types = {f.name: f.dataType.simpleString() for f in rates.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "segment bigint", "start_us bigint", "end_us bigint", "rate double", "status string", "reference double"])
    slim = rates.select(*by, F.col("segment").cast("bigint").alias("segment"), "end_us", "start_us", "rate", "lo", "hi", "unpriced")
    return fold(slim, [*by, "segment"], ["end_us", "start_us"], make, schema)


def withheld_runs(verdicts: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """Runs of withheld verdicts of one direction; accepted ones end a run, unpriced and unjudged ones are not seen."""
    seen = verdicts.filter(F.col("status").isin("accepted", "unaccounted", "surplus"))
    numbered = runs_of(seen, by, ["end_us", "start_us"], "status").filter("status <> 'accepted'")
    out = numbered.groupBy(*by, "run", "status").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"), F.median("rate").alias("rate"), F.median("reference").alias("reference"), F.median(F.try_divide(F.col("rate"), F.col("reference"))).alias("capture"))
    return out.withColumn("step", F.try_divide(F.col("rate"), F.col("reference")) - 1)


def armed_steps(values: DataFrame, threshold: float = 0.15, window: int = 4, least: int = 3, by: Sequence[str] = ("series",), order: Sequence[str] = ("ts_us",)) -> DataFrame:
    """Changes against the median of the last values, confirmed by the next one; armed again once within the threshold."""

    def make() -> tuple[Step, Callable[[], Iterable[tuple]]]:
        state: dict = {"past": [], "armed": True}

        def step(row: tuple) -> Iterable[tuple]:
            ts, value = row
            past, out = state["past"], []
            if waiting := state.pop("pending", None):
                at, change, level = waiting
                held = value / level - 1
                if abs(held) > threshold and (held > 0) == (change > 0):
                    out.append((at, ts, change))
                    state["armed"] = False
            level = _median(past) if len(past) >= least else 0
            if level:
                change = value / level - 1
                if abs(change) > threshold and state["armed"]:
                    state["pending"] = (ts, change, level)
                elif abs(change) <= threshold:
                    state["armed"] = True
            past.append(value)
            del past[:-window]
            return out

        return step, tuple

    types = {f.name: f.dataType.simpleString() for f in values.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "at_us bigint", "confirmed_us bigint", "change double"])
    return fold(values.select(*by, *order, "value"), by, order, make, schema)


def inferred_resets(readings: DataFrame, by: Sequence[str] = ("account",), value: str = "five_hour", reset: str = "resets_us", ts: str = "ts_us", order: Sequence[str] = ("ts_us", "seq"), length: int = FIVE_HOURS) -> DataFrame:
    """Fill missing resets from falls of the meter.

    A fall within ``length`` of the first reading at the level before it tells one reset, and its row opens a
    window that ends ``length`` later. Readings from there up to the next fall, to a gap above ``length`` or to
    the window's end get that end, once one of them is above zero. Stated resets stay.
    """
    w = W.partitionBy(*by).orderBy(*order)
    before, before_ts = F.lag(value).over(w), F.lag(ts).over(w)
    falls = F.coalesce(F.col(value) < before, F.lit(False))
    rows = segment_ids(readings, by, order, F.coalesce(F.col(value) != before, F.lit(False)), "_level")
    rows = rows.withColumn("_level_from", F.min(ts).over(W.partitionBy(*by, "_level")))
    known = F.col(reset).isNull() & falls & (F.col(ts) - F.lag("_level_from").over(w) <= length)
    rows = rows.withColumns({"_opens": F.when(known, F.col(ts)), "_breaks": falls | F.coalesce(F.col(ts) - before_ts > length, F.lit(False))})
    rows = segment_ids(rows, by, order, F.col("_breaks"), "_part")
    part = W.partitionBy(*by, "_part")
    end = F.max("_opens").over(part) + length
    rows = rows.withColumn("_end", F.when(F.col(ts) < end, end))
    used = F.max(F.when(F.col("_end").isNotNull(), F.col(value))).over(part) > 0
    return rows.withColumn(reset, F.coalesce(F.col(reset), F.when(used, F.col("_end")))).drop("_level", "_level_from", "_opens", "_breaks", "_part", "_end")


def in_log_order(readings: DataFrame, by: Sequence[str] = ("log_id",), order: str = "line_no", ts: str = "ts_us") -> DataFrame:
    """The longest run of a log's lines whose stamps do not fall; lines without a log id stay."""
    import bisect

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        tails: list = []
        at: list[int] = []
        prev: list[int] = []
        for i, t in enumerate(frame[ts].tolist()):
            k = bisect.bisect_right(tails, t)
            if k == len(tails):
                tails.append(t)
                at.append(i)
            else:
                tails[k], at[k] = t, i
            prev.append(at[k - 1] if k else -1)
        kept, i = [], at[-1] if at else -1
        while i >= 0:
            kept.append(i)
            i = prev[i]
        return frame.iloc[kept[::-1]]

    free = readings.filter(F.col(by[0]).isNull())
    logs = readings.filter(F.col(by[0]).isNotNull()).groupBy(*by).applyInPandas(keep, readings.schema)
    return free.unionByName(logs)
