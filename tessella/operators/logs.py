"""Time-series operators for training logs and event tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"[-+0-9.eE]+"
_WHEN = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) .*: "
POINT = _WHEN + rf"step=(\d+) loss=({_NUMBER}) ppl=({_NUMBER}) lr=({_NUMBER}) grad_norm=({_NUMBER}) tokens=(\d+) tok/s=({_NUMBER})(?:\s.*)?$"
VALIDATION = _WHEN + rf"validation step=(\d+) loss=({_NUMBER}) ppl=({_NUMBER})(?: per_category=(.*))?$"
#: The step right after the resume mark, never a later ``final_step=``.
RESUME = _WHEN + r"resumed(?:=\S*| .*? at) step=(\d+) tokens=\d+(?:\s.*)?$"


def parse(lines: DataFrame) -> DataFrame:
    """Lines (run, line_no, value) to typed points: kind is point, validation or resume; other lines drop out."""
    v = F.col("value")
    is_point, is_val, is_resume = v.rlike(POINT), v.rlike(VALIDATION), v.rlike(RESUME)
    pick = lambda p, k: F.regexp_extract(v, p, k)
    number = lambda p, k: F.expr(f"try_cast(nullif(regexp_extract(value, r'{p}', {k}), '') as double)")
    kind = F.when(is_val, "validation").when(is_resume, "resume").when(is_point, "point")
    step = F.when(is_val, pick(VALIDATION, 2)).when(is_resume, pick(RESUME, 2)).when(is_point, pick(POINT, 2)).cast("long")
    per = F.transform(F.filter(F.split(pick(VALIDATION, 5), r"[,\s]+"), lambda x: x.contains("=")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).try_cast("double").alias("v")))
    return lines.select(
        "run", "line_no", kind.alias("kind"), step.alias("step"),
        F.try_to_timestamp(F.regexp_replace(pick(r"^(\S+ \S+)", 1), ",", ".")).alias("ts"),
        F.when(is_val, number(VALIDATION, 3)).otherwise(number(POINT, 3)).alias("loss"), number(POINT, 5).alias("lr"), number(POINT, 6).alias("grad_norm"),
        number(POINT, 7).cast("long").alias("tokens"), number(POINT, 8).alias("tok_s"), F.when(is_val, F.map_from_entries(per)).alias("per_category")).where("kind is not null")


def rollback(points: DataFrame, keys: list[str], order: str, step: str, is_resume: Column) -> DataFrame:
    """Points that no later resume at a lower step supersedes."""
    # From the last row on, so that the frame grows by a row instead of being summed anew for each.
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.min(F.when(is_resume, F.col(step))).over(w)
    return points.withColumn("_later", later).where(~is_resume & (F.col("_later").isNull() | (F.col(step) <= F.col("_later")))).drop("_later")


def _asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, forward: bool) -> tuple[DataFrame, Window]:
    firsts = right.groupBy(key, ts).agg((F.min if forward else F.max)(value).alias("_v"))
    rows = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0)).unionByName(firsts.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # A right row at the same time counts, so it comes first in the direction that is gone through.
    order = [F.desc(ts), F.desc("_side")] if forward else [F.asc(ts), F.desc("_side")]
    return rows, Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def asof_forward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, else_last: bool = False) -> DataFrame:
    """Adds the value of the first right row of the key at or after each left row (ties: the least value).

    With ``else_last`` rows after the key's last right row get that one's
    value. One shuffle by key, no pairs.
    """
    rows, w = _asof(left, right, key, ts, value, out, True)
    found = F.last("_v", ignorenulls=True).over(w)
    if else_last:
        found = F.coalesce(found, F.first("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn(out, found).where("_side = 0").drop("_v", "_side")


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str) -> DataFrame:
    """Adds the value of the last right row of the key at or before each left row (ties: the greatest value)."""
    rows, w = _asof(left, right, key, ts, value, out, False)
    return rows.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 0").drop("_v", "_side")


def after_boundary(step: Column, edges: list[int], window: int) -> Column:
    """The boundary, the last one excluded, that the step follows by at most ``window``; else null."""
    return F.coalesce(*[F.when((step >= b) & (step <= b + window), F.lit(b)) for b in edges[:-1]], F.lit(None).cast("int"))


def minmax_downsample(points: DataFrame, keys: list[str], x: str, y: str, buckets: int) -> DataFrame:
    """The ends, and the least and greatest point of each of ``buckets`` equal stretches between."""
    w = Window.partitionBy(*keys)
    n = points.withColumn("rn", F.row_number().over(w.orderBy(x))).withColumn("n", F.count(F.lit(1)).over(w))
    inner = n.where("rn > 1 and rn < n").withColumn("b", F.expr(f"cast(floor((rn - 2) * {buckets}L / (n - 2)) as long)"))
    ends = n.where("rn = 1 or rn = n").select(*keys, x, y)
    low = inner.groupBy(*keys, "b").agg(F.min_by(x, F.struct(y, x)).alias("lo"), F.max_by(x, F.struct(y, -F.col("rn"))).alias("hi"))
    kept = inner.join(low, [*keys, "b"]).where((F.col(x) == F.col("lo")) | (F.col(x) == F.col("hi"))).select(*keys, x, y)
    return ends.unionByName(kept)


def cycle_edges(start: int, end: int, cycles: int) -> list[int]:
    """Cycle boundaries; the earliest cycles are one update longer where the updates don't divide evenly."""
    width, longer = divmod(end - start, cycles)
    return [start + k * width + min(k, longer) for k in range(cycles + 1)]


def learning_rate(step: Column, edges: list[int], warmup: int, old: float, peak: float, least: float) -> Column:
    """Cosine cycles from ``peak`` to ``least`` between the edges; the first begins with a straight line from the old rate."""
    rate = F.lit(least)
    for k, (low, high) in reversed(list(enumerate(zip(edges, edges[1:])))):
        warm = warmup if k == 0 else 0
        at = F.greatest(step, F.lit(edges[0])) - low
        value = F.lit(least) + F.lit((peak - least) / 2) * (1 + F.cos(F.lit(math.pi) * (at - warm) / F.lit(float(high - low - warm - 1))))
        if warm > 1:
            value = F.when(at < warm, F.lit(old) + F.lit(peak - old) * at / F.lit(float(warm - 1))).otherwise(value)
        rate = F.when(step < high, value).otherwise(rate)
    return rate


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, floor: float = 0.0) -> Column:
    """A line to ``peak`` over the warm-up, then half a cosine to ``floor``."""
    share = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(F.lit(floor) + F.lit((peak - floor) / 2) * (1 + F.cos(F.lit(math.pi) * share)))


def cycle_id(step: Column, edges: list[int]) -> Column:
    """How many inner boundaries the step has reached."""
    out = F.lit(0)
    for b in edges[1:-1]:
        out = out + F.when(step >= b, 1).otherwise(0)
    return out


def phase(step: Column, edges: list[int], warmup: int) -> Column:
    """``warmup``, ``cosine k/n`` or ``final``; null before the first boundary."""
    n = len(edges) - 1
    out = F.when(step >= edges[-1], F.lit("final")).when((step >= edges[0]) & (step < edges[0] + warmup), F.lit("warmup"))
    for k in range(n):
        out = out.when((step >= edges[k]) & (step < edges[k + 1]), F.lit(f"cosine {k + 1}/{n}"))
    return out


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted values, null if there are none."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1))


def high_quantile(values: Column, q: float = 0.9) -> Column:
    """Element min(n - 1, int(q n) - 1) of the sorted values (the last for an index of -1), null if there are none."""
    s = F.array_sort(values)
    at = F.least(F.size(s) - 1, F.floor(F.lit(q) * F.size(s)).cast("int") - 1)
    return F.when(F.size(s) > 0, F.when(at < 0, F.element_at(s, -1)).otherwise(F.element_at(s, F.greatest(at, F.lit(0)) + 1)))


def recent_windows(points: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Per key: mean, upper median and high quantile of the last ``width`` values, how many of them are over 5, and the mean of the ``width`` before."""
    r = points.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= 2 * width)
    last, before = F.col("_r") <= width, F.col("_r") > width
    held = F.collect_list(F.when(last, F.col(value)))
    return r.groupBy(key).agg(F.avg(F.when(last, F.col(value))).alias("mean_last"), F.avg(F.when(before, F.col(value))).alias("mean_before"), F.count_if(last & (F.col(value) > 5)).alias("spikes"), held.alias("_h")).select(
        key, "mean_last", "mean_before", "spikes", upper_median(F.col("_h")).alias("median"), high_quantile(F.col("_h")).alias("p90"))


def last_segment(points: DataFrame, keys: list[str], order: str, is_start: Column) -> DataFrame:
    """Rows from the last start mark of the keys on (all rows where there is none)."""
    starts = points.where(is_start).groupBy(*keys).agg(F.max(order).alias("_start"))
    return points.join(starts, keys, "left").where(F.col("_start").isNull() | (F.col(order) >= F.col("_start"))).drop("_start")


def overflow_events(retries: DataFrame, steps: DataFrame, key: str, ts: str, step: str, attempt: str) -> DataFrame:
    """Retries (key, ts, attempt) grouped by the step they belong to: key, step, retries, worst attempt, last time."""
    at = asof_forward(retries, steps, key, ts, step, "at_step", else_last=True)
    return at.groupBy(key, "at_step").agg(F.count(F.lit(1)).alias("retries"), F.max(attempt).alias("worst"), F.max(ts).alias("last_ts"))


def progress(points: DataFrame, key: str, ts: str, step: str, tokens: str, target: int) -> DataFrame:
    """Per key: steps and tokens a second between first and last point, share of the target, and hours left."""
    first, last = F.min(F.struct(ts, step, tokens)), F.max(F.struct(ts, step, tokens))
    g = points.groupBy(key).agg(first.alias("a"), last.alias("b"))
    sec = (F.unix_micros(F.col("b." + ts)) - F.unix_micros(F.col("a." + ts))) / 1e6
    rate = F.when(sec > 0, (F.col("b." + step) - F.col("a." + step)) / sec)
    return g.select(key, rate.alias("steps_s"), F.when(sec > 0, (F.col("b." + tokens) - F.col("a." + tokens)) / sec).alias("tokens_s"), (F.col("b." + step) / F.lit(float(target))).alias("share"),
                    F.when(rate > 0, F.greatest(F.lit(target) - F.col("b." + step), F.lit(0)) / rate / 3600).alias("hours_left"))


#: Name, condition of each rule over a summary row. ``now_s`` is a column, so results don't depend on the clock.
RULES = (
    ("alert:no_log", "last_s is null"),
    ("alert:stale", "not completed and now_s - last_s > 900"),
    ("warn:stale", "not completed and now_s - last_s > 300 and now_s - last_s <= 900"),
    ("alert:fatal", "size(fatal_lines) > 0"),
    ("alert:overflow", "overflows >= 3 or worst_attempt >= 4"),
    ("warn:overflow", "not (overflows >= 3 or worst_attempt >= 4) and (overflows = 2 or worst_attempt between 2 and 3)"),
    ("info:overflow", "overflows = 1 and worst_attempt < 2"),
    ("warn:scale", "scale_drops > overflows"),
    ("warn:grad_median", "grad_median > 2.5"),
    ("warn:grad_spikes", "not grad_median > 2.5 and grad_spikes >= 3"),
    ("warn:val_rise", "val_rise > 0.05 and restart is null"),
    ("info:val_rise", "val_rise > 0.05 and restart is not null"),
    ("warn:checkpoint", "not completed and save_interval > 0 and (checkpoint_s is null or now_s - checkpoint_s > 2.5 * save_interval * sec_per_step)"),
    ("warn:eta", "eta_own > 0 and eta_said > 0 and abs(eta_own - eta_said) / eta_said > 0.15"),
    ("warn:disk", "free_gib < 15"),
)


def alerts(summary: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``alerts``, the names of the rules that fire in rule order, and ``ok``: no alert among them."""
    named = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in rules]))
    return summary.withColumn("alerts", named).withColumn("ok", ~F.exists("alerts", lambda a: a.startswith("alert:")))
