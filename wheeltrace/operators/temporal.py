"""As-of joins, gaps and islands, greedy gaps and grids: plan shapes for time series keyed by route.

As-of joins are a union and one running window, so they cost one shuffle on the key and never compare rows pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def _stacked(probe: DataFrame, stream: DataFrame, keys: Sequence[str], t: str, seq: str, cols: Sequence[str]) -> DataFrame:
    payload = F.struct(F.col(t).alias("at"), *cols)
    left = probe.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_seq"), F.struct(*probe.columns).alias("_probe"), F.lit(None).cast(stream.select(payload).schema[0].dataType).alias("_row"))
    right = stream.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_kind"), F.col(seq).cast("long").alias("_seq"), F.lit(None).cast(probe.select(F.struct(*probe.columns)).schema[0].dataType).alias("_probe"), payload.alias("_row"))
    return left.union(right)


def _around(both: DataFrame, keys: Sequence[str], bucket: float | None, *, least_seq: bool = False, last: bool = False) -> DataFrame:
    """both with the stream rows last before (_before) and first after (_after) each row's time, that time included, and the key's last one
    (_last). Of equal times _before takes the largest seq, or the least.

    bucket: None for one window on the key. Else windows run within spans of time of that length, so that a key with a large part of all rows is
    dealt over many tasks; a row for each span and key then carries over the spans' bounds what was found before and after."""
    own = [*keys] if bucket is None else [*keys, "_bucket"]
    if bucket is not None:
        both = both.withColumn("_bucket", F.floor(F.col("_t") / bucket))
    upto = (W.unboundedPreceding, 0)
    up = W.partitionBy(*own).orderBy("_t", "_kind", F.desc("_seq") if least_seq else "_seq").rowsBetween(*upto)
    down = W.partitionBy(*own).orderBy(F.desc("_t"), "_kind", F.desc("_seq")).rowsBetween(*upto)
    both = both.withColumn("_before", F.last("_row", ignorenulls=True).over(up)).withColumn("_after", F.last("_row", ignorenulls=True).over(down))
    place = F.when(F.col("_kind") == 0, F.struct("_t", "_seq"))
    if bucket is None:
        return both.withColumn("_last", F.max_by("_row", place).over(W.partitionBy(*keys))) if last else both
    latest = F.when(F.col("_kind") == 0, F.struct("_t", -F.col("_seq"))) if least_seq else place
    spans = both.groupBy(*own).agg(F.max_by("_row", latest).alias("_l"), F.min_by("_row", place).alias("_f"), F.max_by("_row", place).alias("_z"))
    rise, fall = W.partitionBy(*keys).orderBy("_bucket"), W.partitionBy(*keys).orderBy(F.desc("_bucket"))
    past, whole = (W.unboundedPreceding, -1), (W.unboundedPreceding, W.unboundedFollowing)
    spans = spans.select(*(F.col(c).alias(f"_of_{c}") for c in own), F.last("_l", ignorenulls=True).over(rise.rowsBetween(*past)).alias("_lead_in"), F.last("_f", ignorenulls=True).over(fall.rowsBetween(*past)).alias("_lead_out"), F.last("_z", ignorenulls=True).over(rise.rowsBetween(*whole)).alias("_last"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in own))
    return both.join(spans, same).withColumn("_before", F.coalesce("_before", "_lead_in")).withColumn("_after", F.coalesce("_after", "_lead_out"))


def asof_forward(probe: DataFrame, stream: DataFrame, keys: Sequence[str], *, t: str = "time_s", seq: str = "i", cols: Sequence[str], clamp: bool = True, at: str | None = None, bucket: float | None = None) -> DataFrame:
    """Each probe row with `cols` of the first stream row at or after its time (the earliest of equal times); where there
    is none, of the stream's last row if `clamp`. `at` names a column for the time that was found; for `bucket` see _around."""
    both = _around(_stacked(probe, stream, keys, t, seq, cols), keys, bucket, last=clamp)
    return _unstack(both.withColumn("_found", F.coalesce("_after", "_last") if clamp else F.col("_after")), cols, at)


def asof_backward(probe: DataFrame, stream: DataFrame, keys: Sequence[str], *, t: str = "time_s", seq: str = "i", cols: Sequence[str], at: str | None = None, bucket: float | None = None) -> DataFrame:
    """Each probe row with `cols` of the last stream row at or before its time; null where there is none."""
    return _unstack(_around(_stacked(probe, stream, keys, t, seq, cols), keys, bucket).withColumn("_found", F.col("_before")), cols, at)


def asof_nearest(probe: DataFrame, stream: DataFrame, keys: Sequence[str], *, t: str = "time_s", seq: str = "i", cols: Sequence[str], at: str | None = None, bucket: float | None = None) -> DataFrame:
    """Each probe row with `cols` of the stream row nearest in time; on a tie the earlier row."""
    both = _around(_stacked(probe, stream, keys, t, seq, cols), keys, bucket, least_seq=True)
    nearer = (F.col("_after.at") - F.col("_t")) < (F.col("_t") - F.col("_before.at"))
    found = F.when(F.col("_before").isNull() | nearer, F.col("_after")).otherwise(F.col("_before"))
    found = F.when(F.col("_after").isNull(), F.col("_before")).otherwise(found)
    return _unstack(both.withColumn("_found", found), cols, at)


def _unstack(both: DataFrame, cols: Sequence[str], at: str | None) -> DataFrame:
    extra = [F.col("_found.at").alias(at)] if at else []
    return both.filter("_kind = 1").select("_probe.*", *extra, *(F.col(f"_found.{c}").alias(c) for c in cols))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, run: str = "run") -> DataFrame:
    """df with a running number of the maximal runs of equal `value`."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(run, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def debounced_runs(samples: DataFrame, keys: Sequence[str], *, min_samples: int, t: str = "time_s", seq: str = "i", state: str = "state") -> DataFrame:
    """Runs of equal state (run, start_s, end_s, n) with the raw state and the debounced one: an inner run of fewer than
    min_samples takes the state before it; the first and the last run keep theirs."""
    runs = islands(samples, keys, [t, seq], state).groupBy(*keys, "run").agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count("*").cast("int").alias("n"), F.min(state).alias("raw_state"))
    w, whole = W.partitionBy(*keys).orderBy("run"), W.partitionBy(*keys)
    steady = (F.col("n") >= min_samples) | (F.col("run") == 1) | (F.col("run") == F.max("run").over(whole))
    return runs.withColumn("state", F.last(F.when(steady, F.col("raw_state")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))


def merged_runs(runs: DataFrame, keys: Sequence[str], order: str = "start_s", state: str = "state") -> DataFrame:
    """Neighbouring runs of equal state as one: start_s, end_s, n."""
    return islands(runs, keys, [order], state, "_run").groupBy(*keys, "_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n").cast("int").alias("n"), F.min(state).alias(state)).drop("_run")


def greedy_gap(df: DataFrame, keys: Sequence[str], t: str, min_gap: float) -> DataFrame:
    """The times that stay when each must lie min_gap or more after the last one kept (null times never stay). Rows are sorted by key and time and
    read as a stream that remembers one key and one time, so a key of any size takes constant memory and time in proportion."""
    rows = df.select(*keys, F.col(t).cast("double").alias(t)).filter(F.col(t).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, t)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, -np.inf
        for pdf in batches:
            if not len(pdf):
                continue
            own, times = pdf[list(keys)], pdf[t].to_numpy()
            changed = ((own != own.shift()) & ~(own.isna() & own.shift().isna())).any(axis=1).to_numpy(copy=True)
            changed[0] = True
            first = np.flatnonzero(changed)
            kept = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(pdf)], strict=True):
                now = tuple(None if pd.isna(v) else v for v in own.iloc[i])
                if now != key:
                    key, last = now, -np.inf
                while i < j:
                    i += int(np.searchsorted(times[i:j], last + min_gap - 1e-6)) if last > -np.inf else 0
                    while i < j and times[i] - last < min_gap:
                        i += 1
                    if i < j:
                        kept.append(i)
                        last = times[i]
                        i += 1
            yield pdf.iloc[kept]

    return rows.mapInPandas(fold, rows.schema)


def greedy_gap_dealt(df: DataFrame, keys: Sequence[str], t: str, min_gap: float, *, bucket: float | None = None) -> DataFrame:
    """The rows of greedy_gap for keys that one task should not read alone: the times that stay when each must lie at or after the last one kept and
    min_gap.

    Each time's successor is found by an as-of join over spans of `bucket` (some gaps, unless given), and the kept times are those that the first one
    reaches: at each round all that are reached jump once, and jumps double, so rounds grow with the logarithm of the longest chain.
    Keys are columns of data: a literal in the plan as key is refused by Spark's optimizer, which loses its place in a union of checkpoints."""
    times = cut(df.select(*keys, F.col(t).cast("double").alias("time_s")).filter(F.col("time_s").isNotNull()).distinct())
    probes = times.select(*keys, F.col("time_s").alias("own"), (F.col("time_s") + min_gap).alias("time_s"))
    jumps = asof_forward(probes, times.withColumn("i", F.lit(0)), keys, cols=["time_s"], clamp=False, bucket=bucket or 64 * min_gap, at="to").select(*keys, F.col("own").alias("time_s"), "to")
    jumps = cut(jumps.filter("to is not null"))
    kept = fresh = cut(times.groupBy(*keys).agg(F.min("time_s").alias("time_s")))
    same = lambda x, y, on: reduce(lambda p, q: p & q, (F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys), on)
    while True:
        a, b = kept.alias("a"), jumps.alias("b")
        fresh = cut(a.join(b, same("a", "b", F.col("a.time_s") == F.col("b.time_s"))).select(*(F.col(f"a.{k}") for k in keys), F.col("b.to").alias("time_s")))
        if fresh.isEmpty():
            return kept.withColumnRenamed("time_s", t)
        kept = cut(kept.union(fresh))
        jumps = cut(b.join(jumps.alias("c"), same("b", "c", F.col("b.to") == F.col("c.time_s"))).select(*(F.col(f"b.{k}") for k in keys), "b.time_s", "c.to"))


def grid(bounds: DataFrame, *, start: Column, n: Column, step: float, name: str = "time_s", index: str = "s") -> DataFrame:
    """Rows start + s * step for s in 0..n-1 of each row of bounds; none where n < 1."""
    return bounds.filter(n >= 1).withColumn(index, F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))).withColumn(name, start + F.col(index) * step)


def interpolate(probe: DataFrame, stream: DataFrame, keys: Sequence[str], *, t: str = "time_s", seq: str = "i", value: str) -> DataFrame:
    """Each probe row with `value` interpolated linearly between the stream rows around it, clamped at both ends."""
    both = _stacked(probe, stream, keys, t, seq, [value])
    up = W.partitionBy(*keys).orderBy("_t", "_kind", "_seq").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.desc("_t"), "_kind", F.desc("_seq")).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last("_row", ignorenulls=True).over(up)).withColumn("_b", F.last("_row", ignorenulls=True).over(down)).filter("_kind = 1")
    a, b = F.col("_a"), F.col("_b")
    share = (F.col("_t") - a["at"]) / (b["at"] - a["at"])
    y = F.when(a.isNull(), b[value]).when(b.isNull() | (a["at"] == b["at"]), a[value]).otherwise(a[value] + (b[value] - a[value]) * share)
    return both.select("_probe.*", y.alias(value))


def sequential_ids(df: DataFrame, key: str, order: Sequence[Column | str], *, prefix: str, width: int, name: str) -> DataFrame:
    """Ids PREFIX_00001... in the order of key and `order`: numbers within a key plus the rows of all keys before it. The
    only window without a partition runs over one row for each key."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    before = counts.select(key, F.coalesce(F.sum("_n").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy(key).orderBy(*order)) + F.col("_before")
    return df.join(before, key).withColumn(name, F.format_string(f"{prefix}_%0{width}d", number)).drop("_before")
