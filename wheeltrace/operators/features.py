"""Resampling, window slices and statistics, normalisation, weights, projections and model stand-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SIGNAL_DEFAULTS, columns_of
from ..functions.numeric import number
from . import temporal


def resample(samples: DataFrame, *, step: float, value: str) -> DataFrame:
    """(route_id, s, time_s, value): linear interpolation on a regular grid from the first to the last sample; missing
    values count as 0. For many channels at once see `pack`."""
    rows = samples.withColumn(value, F.when(F.col(value).isNull() | F.isnan(value), 0.0).otherwise(F.col(value)))
    b = rows.groupBy("route_id").agg(F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    n = F.ceil((F.col("t1") - F.col("t0")) / step + 0.5)
    grid = temporal.grid(b, start=F.col("t0"), n=n, step=step).select("route_id", "s", "time_s")
    return temporal.interpolate(grid, rows.select("route_id", "i", "time_s", value), ["route_id"], value=value)


CHUNK = 3_000  #: grid rows in a row of a packed table: a minute at 50 Hz


def pack(samples: DataFrame, channels: Sequence[str], *, step: float, keys: Sequence[str] = ("route_id",), chunk: int = CHUNK) -> DataFrame:
    """(keys, chunk, t_start, step, n, data): all channels of a stream on one regular grid, packed. n: the grid rows of the chunk;
    data: their values, row after row, one float for each channel. Missing values count as 0; a stream of fewer than two samples has no grid.

    A sample stands for the grid places from its time to the next sample's, so one window on the key gives all that interpolation needs, for
    any number of channels, and chunks are gathered where their rows are: one shuffle in all."""
    order = W.partitionBy(*keys).orderBy("time_s", "i")
    whole = W.partitionBy(*keys)
    own = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in channels))
    rows = samples.select(*keys, "time_s", "i", own.alias("_v")).filter("time_s is not null")
    rows = rows.select(*keys, "time_s", "_v", F.lead("time_s").over(order).alias("_t"), F.lead("_v").over(order).alias("_w"), F.min("time_s").over(whole).alias("t_start"), F.max("time_s").over(whole).alias("_end"), F.count("*").over(whole).alias("_n")).filter("_n >= 2")
    place = lambda t: F.ceil((t - F.col("t_start")) / step)
    size = F.ceil((F.col("_end") - F.col("t_start")) / step + 0.5)
    upto = F.coalesce(place(F.col("_t")), size)
    held = rows.filter(upto > place(F.col("time_s"))).select("*", F.explode(F.sequence(place(F.col("time_s")), upto - 1)).alias("s"))
    share = (F.col("t_start") + F.col("s") * step - F.col("time_s")) / (F.col("_t") - F.col("time_s"))
    value = F.when(F.col("_w").isNull(), F.col("_v")).otherwise(F.zip_with("_v", "_w", lambda a, b: a + (b - a) * F.col("_x")))
    held = held.withColumn("_x", share).select(*keys, "t_start", "s", F.transform(value, lambda x: x.cast("float")).alias("v"))
    packed = held.groupBy(*keys, F.floor(F.col("s") / chunk).alias("chunk")).agg(F.min("t_start").alias("t_start"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("s", "v"))).alias("_rows"))
    return packed.select(*keys, "chunk", "t_start", F.lit(float(step)).alias("step"), "n", F.flatten(F.transform("_rows", lambda r: r["v"])).alias("data"))


def unpack(packed: DataFrame, channels: Sequence[str], *, keys: Sequence[str] = ("route_id",), chunk: int = CHUNK) -> DataFrame:
    """(keys, s, time_s, channels): the grid rows of a packed table."""
    d = len(channels)
    each = packed.select(*keys, "chunk", "t_start", "step", "data", F.explode(F.expr("sequence(0L, n - 1)")).alias("_j")).withColumn("s", F.col("chunk") * chunk + F.col("_j"))
    at = lambda k: F.get("data", (F.col("_j") * d + k).cast("int")).alias(channels[k])
    return each.select(*keys, "s", (F.col("t_start") + F.col("s") * F.col("step")).alias("time_s"), *(at(k) for k in range(d)))


def packed_slices(windows: DataFrame, packed: DataFrame, d: int, *, length: int, keys: Sequence[str] = ("route_id",), chunk: int = CHUNK) -> DataFrame:
    """(keys, start_s, data): `length` grid rows of d channels from each window's start, as one array; zeros beyond the ends, and where the key
    has no grid. Windows meet the one or few chunks that they touch by an equal join on (key, chunk)."""
    heads = packed.filter("chunk = 0").select(*keys, "t_start", "step")
    first = F.greatest(F.lit(0), F.rint((F.col("start_s") - F.col("t_start")) / F.col("step")).cast("long"))
    w = windows.select(*keys, "start_s").distinct().join(heads, list(keys), "left").withColumn("_a", first)
    touched = F.coalesce(F.sequence(F.floor(F.col("_a") / chunk), F.floor((F.col("_a") + (length - 1)) / chunk)), F.array(F.lit(None).cast("long")))
    met = w.select(*keys, "start_s", "_a", F.explode(touched).alias("chunk")).join(packed.select(*keys, "chunk", "n", "data"), [*keys, "chunk"], "left")
    lo = F.greatest(F.col("_a") - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(F.col("_a") + length - F.col("chunk") * chunk, F.col("n"))
    part = F.when(hi > lo, F.slice("data", (lo * d + 1).cast("int"), ((hi - lo) * d).cast("int")))
    whole = met.withColumn("_part", part).groupBy(*keys, "start_s").agg(F.sort_array(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("chunk", "_part")))).alias("_parts"))
    data = F.flatten(F.transform("_parts", lambda x: x["_part"]))
    return whole.withColumn("data", data).select(*keys, "start_s", F.concat("data", F.array_repeat(F.lit(0.0).cast("float"), F.lit(length * d) - F.size("data"))).alias("data"))


def window_slices(windows: DataFrame, gridded: DataFrame, channels: Sequence[str], *, step: float, length: int, t0: Column) -> DataFrame:
    """(route_id, start_s, j, channels): `length` grid rows from each window's start, zeros beyond the ends. Positions on
    the grid are whole numbers, so this is an equal join on (route, index)."""
    first = F.greatest(F.lit(0), F.rint((F.col("start_s") - t0) / step).cast("int"))
    frame = windows.withColumn("_first", first).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("i", F.col("_first") + F.col("j"))
    return frame.join(gridded.select("route_id", "i", *channels), ["route_id", "i"], "left").select("route_id", "start_s", "j", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in channels))


def window_stats(slices: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum, maximum and last value of each channel in each window."""
    aggs = [f(c).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)) for c in channels]
    return slices.groupBy("route_id", "start_s").agg(*aggs, *(F.max_by(c, "j").alias(f"{c}_last") for c in channels))


def norm_stats(vectors: DataFrame, vec: str) -> DataFrame:
    """(dim, mean, std) of the components: std = sqrt(max(E[x^2] - E[x]^2, 0))."""
    x = vectors.select(F.posexplode(vec).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    s = x.groupBy("dim").agg(F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("_sq"))
    return s.select("dim", "mean", F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def zscore(vectors: DataFrame, stats: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, z): each vector as an array of (x - mean) / (std + 1e-8). stats has one row for each component; they travel as
    one row of arrays, and vectors are never taken apart."""
    whole = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    scaled = F.zip_with(vec, "_s", lambda x, s: (x.cast("double") - s["mean"]) / (s["std"] + 1e-8))
    return vectors.crossJoin(F.broadcast(whole)).select(key, scaled.alias("z"))


def select_configuration(df: DataFrame, keys: Sequence[str], configuration: str) -> DataFrame:
    """The keys and the columns of a named configuration, in its order; missing columns and unreadable values take their default."""
    columns, have = columns_of(configuration), set(df.columns)
    value = lambda c: number(F.col(c), SIGNAL_DEFAULTS.get(c, 0.0)) if c in have else F.lit(SIGNAL_DEFAULTS.get(c, 0.0))
    return df.select(*keys, *(value(c).alias(c) for c in columns))


def class_weights(df: DataFrame, label: str, classes: Sequence[str], cap: float) -> DataFrame:
    """Inverse frequency over the least, at most `cap`; a class without rows counts as one row."""
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    counts = F.broadcast(every).join(df.groupBy(label).agg(F.count("*").alias("_n")), label, "left").withColumn("n", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
    most = counts.agg(F.max("n").alias("_most"))
    return counts.crossJoin(F.broadcast(most)).select(label, "n", F.greatest(F.lit(1.0), F.least(F.lit(cap), F.col("_most") / F.col("n"))).alias("weight"))


def pos_weight(df: DataFrame, label: str, cap: float) -> DataFrame:
    """Negatives over positives, at most cap, 1 without positives; and uncapped over at least one positive, as tree learners
    take it."""
    s = df.agg(F.count("*").alias("_n"), F.coalesce(F.sum(label), F.lit(0)).alias("n_pos"))
    negative = F.col("_n") - F.col("n_pos")
    return s.select("n_pos", negative.alias("n_neg"), F.when(F.col("n_pos") == 0, 1.0).otherwise(F.least(F.try_divide(negative, F.col("n_pos")), F.lit(cap))).alias("pos_weight"), (negative / F.greatest(F.col("n_pos"), F.lit(1))).alias("tree_weight"))


def null_groups(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose columns are all null in every row: groups to be processed again."""
    return df.groupBy(key).agg(*(F.count(c).alias(f"_{c}") for c in columns)).filter(" and ".join(f"_{c} = 0" for c in columns)).select(key)


def coverage(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows, rows with a value, and whether there is any, for each key."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count(column).alias("n_values"), F.bool_or(F.col(column).isNotNull()).alias("covered"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the groups of `new` in the place of its own; to be written to another path than it is read from."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pca_fit(train: DataFrame, vec: str, k: int):
    """(scaler, components): centred principal components, by the library's own fit, on the rows of `train` only. The model's
    `explainedVariance` has each component's share of the variance."""
    from pyspark.ml.feature import PCA, StandardScaler

    rows = _as_vectors(train, vec)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_x").fit(rows)
    return scaler, PCA(k=k, inputCol="_x", outputCol="_pc").fit(scaler.transform(rows))


def _as_vectors(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_raw", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def pca(vectors: DataFrame, key: str, vec: str, k: int, train: DataFrame | None = None) -> DataFrame:
    """(key, pc) of all rows, from components that were fitted on `train` (or on all rows)."""
    from pyspark.ml.functions import vector_to_array

    scaler, components = pca_fit(vectors if train is None else train, vec, k)
    return components.transform(scaler.transform(_as_vectors(vectors, vec))).select(key, vector_to_array("_pc").alias("pc"))


def explained_variance(train: DataFrame, vec: str, k: int) -> DataFrame:
    """(component, share): the share of the variance that each component explains."""
    shares = pca_fit(train, vec, k)[1].explainedVariance.toArray().tolist()  # k numbers
    return train.sparkSession.createDataFrame(list(enumerate(shares)), "component int, share double")


def logistic(df: DataFrame, key: str, features: Sequence[str], label: str, *, c: float = 1.0, rounds: int = 100) -> DataFrame:
    """(key, probability): balanced logistic regression, by the library's own fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(df.withColumn("_y", F.col(label).cast("double")))
    share = rows.groupBy("_y").agg(F.count("*").alias("_n")).collect()  # two rows
    total = sum(r._n for r in share)
    weight = F.lit(1.0)
    for r in share:
        weight = F.when(F.col("_y") == r._y, total / (len(share) * r._n)).otherwise(weight)
    model = LogisticRegression(featuresCol="x", labelCol="_y", weightCol="_w", regParam=1 / (c * max(total, 1)), maxIter=rounds).fit(rows.withColumn("_w", weight))
    return model.transform(rows).select(key, vector_to_array("probability")[1].alias("probability"))
