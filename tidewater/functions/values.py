"""Column functions: token bundles and prices, instants and weeks, intervals, bins and rounding.

All are plain Spark expressions, so they stay inside generated code and fold into any plan.
Instants are microseconds since 1970 (``BIGINT``) unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
FIVE_HOURS, WEEK = 5 * HOUR, 7 * DAY
CLASSES = ("input", "output", "cache_read", "cache_write")


# --- token bundles -------------------------------------------------------------------------


def cache_write_total(total: Column, five_minutes: Column, one_hour: Column) -> Column:
    """The aggregate counter, or the sum of its parts where the aggregate is 0 or null."""
    total = F.coalesce(total, F.lit(0))
    return F.when(total == 0, F.coalesce(five_minutes, F.lit(0)) + F.coalesce(one_hour, F.lit(0))).otherwise(total)


def bundle_value(tokens: Mapping[str, Column], price: Mapping[str, Column], weight: Mapping[str, Column] | None = None, meter_weight: Column | None = None) -> Column:
    """Sum of class tokens x price (x class weight), with the one-hour premium, x meter weight.

    ``cache_write_1h`` is a part of ``cache_write``: only the difference of its price is added.
    Null when any class has no price.
    """
    one = F.lit(1)
    weight = weight or {}
    total = sum((tokens[c] * price[c] * weight.get(c, one) for c in CLASSES), F.lit(0))
    if "cache_write_1h" in tokens:
        hour = price["cache_write_1h"] * weight.get("cache_write_1h", weight.get("cache_write", one))
        total = total + tokens["cache_write_1h"] * (hour - price["cache_write"] * weight.get("cache_write", one))
    return total if meter_weight is None else total * meter_weight


def class_weight(weights: Column, name: str) -> Column:
    """Weight of a class in a map, 1 by default; the one-hour class falls back to cache_write's."""
    found = F.element_at(weights, F.lit(name))
    if name == "cache_write_1h":
        found = F.coalesce(found, F.element_at(weights, F.lit("cache_write")))
    return F.coalesce(found, F.lit(1.0))


def input_side(input_: Column, cache_write: Column, cache_read: Column, weight: Column) -> Column:
    return input_ + cache_write + weight * cache_read


def blended_price(shares: Mapping[str, Column], price: Mapping[str, Column], weight: Mapping[str, Column] | None = None) -> Column:
    """Price of an average token of a mix."""
    weight = weight or {}
    return sum((shares[c] * price[c] * weight.get(c, F.lit(1)) for c in shares), F.lit(0))


def class_totals(bundles: Column) -> Column:
    """Map of class to tokens, summed over a map of model to class map."""
    flat = F.flatten(F.transform(F.map_values(bundles), F.map_entries))
    keys = F.array_sort(F.array_distinct(F.transform(flat, lambda e: e["key"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(flat, lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"])))


def bundles_with_work(bundles: Column) -> Column:
    """The models of a map that hold any token."""
    return F.map_filter(bundles, lambda k, v: F.aggregate(F.map_values(v), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))) > 0)


# --- model names ---------------------------------------------------------------------------


def stripped_model(model: Column) -> Column:
    """Without a context suffix in brackets and a date suffix."""
    return F.regexp_replace(F.regexp_replace(model, r"\[1m\]$", ""), r"-\d{8}$", "")


def normalize_model(model: Column, known: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """The canonical id of a known model, else null."""
    bare = _aliased(stripped_model(model), aliases)
    return F.when(bare.isin(*known), bare)


def raw_model(model: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """The canonical id where there is an alias, the bare id otherwise, ``unknown`` for null."""
    return F.coalesce(_aliased(stripped_model(model), aliases), F.lit("unknown"))


def _aliased(model: Column, aliases: Mapping[str, str] | None) -> Column:
    for old, new in (aliases or {}).items():
        model = F.when(model == old, new).otherwise(model)
    return model


def family(model: Column, needles: Mapping[str, str]) -> Column:
    """The family of the longest needle that the id contains, else null."""
    out = F.lit(None).cast("string")
    for needle, name in sorted(needles.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(F.contains(model, F.lit(needle)), F.lit(name)).otherwise(out)
    return out


def session_of_path(path: Column) -> Column:
    """The directory before the nearest ``subagents`` directory, else the file's stem."""
    nested = F.regexp_extract(path, r"([^/]+)/subagents/(?!.*/subagents/)", 1)
    return F.when(nested != "", nested).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


# --- instants, resets and weeks ------------------------------------------------------------


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, a naive one being UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_instant(stamp: Column) -> Column:
    """Microseconds of an ISO stamp; null where it is not one. The session's zone must be UTC."""
    return F.unix_micros(F.try_to_timestamp(stamp))


def same_reset(a: Column, b: Column, tolerance: int = MINUTE) -> Column:
    """True unless both are known and further apart than the tolerance. Not transitive: compare neighbours only."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= tolerance)


def week_key(reset: Column) -> Column:
    """Day number of the week a reset closes, steady under jitter of seconds."""
    return F.floor((reset + 30 * SECOND) / DAY).cast("bigint")


def iso_week_ending(us: Column) -> Column:
    """Day number of the Sunday that ends the ISO week."""
    day = F.floor(us / DAY).cast("bigint")
    return day + 6 - F.pmod(day + 3, F.lit(7))


def utc_day(us: Column) -> Column:
    return F.floor(us / DAY).cast("bigint")


def window_start(reset: Column, length: int = FIVE_HOURS) -> Column:
    return reset - length


def iso_z(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def finite_number(text: Column) -> Column:
    """A JSON scalar as a double; null for words, quoted text, NaN and infinities."""
    number = text.try_cast("double")
    return F.when(text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$") & (F.abs(number) < float("inf")), number)


# --- intervals, variances and rounding -----------------------------------------------------


def rounding_error(pieces: Column, dispersion: float = 1.0) -> Column:
    """Two standard errors of a difference of whole percents over so many pieces."""
    return 2 * F.sqrt(F.lit(dispersion) * pieces / 6)


def ratio_interval(d5: Column, d7: Column, pieces: Column, dispersion: float = 1.0) -> Column:
    """Struct (lo, hi) of d5 / d7 within rounding; hi is null where the divisor may be 0."""
    e = rounding_error(pieces, dispersion)
    return F.struct((F.greatest(F.lit(0.0), d5 - e) / (d7 + e)).alias("lo"), F.when(d7 > e, (d5 + e) / (d7 - e)).alias("hi"))


def rate_bounds(value: Column, delta: Column, windows: Column) -> Column:
    """Struct (lo, hi) of value / delta when every window adds up to one point of rounding."""
    return F.struct((value / (delta + windows)).alias("lo"), F.when(delta > windows, value / (delta - windows)).alias("hi"))


def rounding_variance(windows: Column, delta: Column) -> Column:
    return windows / (6 * delta * delta)


def log_bin(x: Column, ratio: float = 1.02) -> Column:
    return F.floor(F.log(x) / F.log(F.lit(ratio))).cast("bigint")


def half_up(x: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x + 0.5)


def significant(x: Column, figures: int = 4) -> Column:
    """Rounded to so many significant figures; 0 and null stay."""
    scale = F.pow(F.lit(10.0), figures - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def t975(df: Column) -> Column:
    """The 97.5 % quantile of Student's t: exact for one and two degrees, a Cornish-Fisher series beyond."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    series = F.lit(z) + g[0] / df + g[1] / (df * df) + g[2] / (df * df * df) + g[3] / (df * df * df * df)
    return F.when(df < 1, F.lit(None)).when(df == 1, F.lit(12.706204736432095)).when(df == 2, F.lit(4.302652729911275)).otherwise(series)


def scaled_interval(value: Column, lo: Column, hi: Column, ratio: Column, ratio_lo: Column, ratio_hi: Column) -> Column:
    """Struct (value, lo, hi) scaled by a ratio with an interval of its own."""
    return F.struct((value * ratio).alias("value"), (lo * ratio_lo).alias("lo"), (hi * ratio_hi).alias("hi"))


def change_state(lo: Column, hi: Column, narrow: float, wide: float) -> Column:
    """measured, provisional or measuring, by the width of an interval in percent."""
    width = hi - lo
    return F.when(width.isNull(), "measuring").when(width <= narrow, "measured").when(width <= wide, "provisional").otherwise("measuring")


def measurable(lo: Column, hi: Column, floor: float, limit: float) -> Column:
    """A finite interval above a floor whose ends are within a ratio of each other."""
    return F.coalesce((lo > floor) & (hi / lo <= limit), F.lit(False))


_MODEL_USAGE = "struct<inputTokens:double,outputTokens:double,cacheReadInputTokens:double,cacheCreationInputTokens:double,costUSD:double>"
_RESULT = f"is_error boolean, result string, subtype string, modelUsage map<string,{_MODEL_USAGE}>, usage struct<input_tokens:double,output_tokens:double,cache_read_input_tokens:double,cache_creation_input_tokens:double>, total_cost_usd double, duration_ms double"


def run_result(text: Column, asked: Column) -> Column:
    """The usage of a command-line run's JSON result: a struct of model, four counters, cost, seconds, and the problem that voids them.

    Every key that is the asked model up to its suffixes counts, summed; without a map of models the run's own usage counts. The cost is the
    keys' sum if all have one, the run's if none has, else unknown.
    """
    d = F.from_json(text, _RESULT)
    used, plain = d["modelUsage"], d["usage"]
    has = F.coalesce(F.size(used), F.lit(0)) > 0
    own = F.map_filter(used, lambda k, _: stripped_model(k) == stripped_model(asked))
    values, keys = F.map_values(own), F.map_keys(own)
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v[f], F.lit(0.0)))
    of = lambda many, one: F.when(has, total(many)).otherwise(F.coalesce(plain[one], F.lit(0.0))).cast("bigint")
    priced = F.size(F.filter(values, lambda v: v["costUSD"].isNotNull()))
    cost = F.when(~has | (priced == 0), d["total_cost_usd"]).when(priced == F.size(values), total("costUSD"))
    problem = (
        F.when(d.isNull() | ~F.startswith(F.ltrim(text), F.lit("{")), "not a result").when(F.coalesce(d["is_error"], F.lit(False)), F.concat(F.lit("error result: "), F.coalesce(d["result"], d["subtype"], F.lit(""))))
        .when(has & (F.size(keys) == 0), F.concat(F.lit("no usage for "), asked))
    )
    model = F.when(~has | F.array_contains(keys, asked), asked).otherwise(F.get(keys, F.lit(0)))
    good = lambda c: F.when(problem.isNull(), c)
    return F.struct(
        good(model).alias("model"), good(of("inputTokens", "input_tokens")).alias("input"), good(of("outputTokens", "output_tokens")).alias("output"), good(of("cacheReadInputTokens", "cache_read_input_tokens")).alias("cache_read"),
        good(of("cacheCreationInputTokens", "cache_creation_input_tokens")).alias("cache_write"), good(cost).alias("cost_usd"), good(F.coalesce(d["duration_ms"], F.lit(0.0)) / 1000).alias("seconds"), problem.alias("problem"),
    )
