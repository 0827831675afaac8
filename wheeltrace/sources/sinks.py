"""Sinks: partitioned tables, text formats rounded at the write, split and result files, upserts and small reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even


def rounded(df: DataFrame, decimals: Mapping[str, int]) -> DataFrame:
    """Columns as text with fixed decimals, ties to even, as the files have them."""
    return df.withColumns({c: F.format_string(f"%.{d}f", half_even(F.col(c), d)) for c, d in decimals.items()})


def write_csv(df: DataFrame, path: str, decimals: Mapping[str, int] | None = None, mode: str = "errorifexists") -> None:
    rounded(df, decimals or {}).write.mode(mode).option("header", True).csv(path)


def write_samples(df: DataFrame, path: str, by: Sequence[str] = ("task", "horizon_sec")) -> None:
    """One table for all tasks and horizons, partitioned by them."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_routes(df: DataFrame, path: str) -> None:
    """Append routes to a table; what is there stays."""
    df.write.mode("append").parquet(path)


def replace_routes(old_path: str, new: DataFrame, path: str, key: str = "route_id") -> None:
    """The old table with these routes in place of its own, written to another path."""
    if old_path.rstrip("/") == path.rstrip("/"):
        raise ValueError("a table cannot be read and overwritten at one path")
    from ..operators.features import upsert

    upsert(new.sparkSession.read.parquet(old_path), new, key).write.mode("overwrite").parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str = "route_id") -> None:
    """A table with a folder for each route, in which routes can be replaced in place."""
    df.repartition(key).sortWithinPartitions(key).write.partitionBy(key).mode("error").parquet(path)


def replace_partitions(new: DataFrame, path: str, key: str = "route_id") -> None:
    """Write these routes over their own in a table of write_partitioned; other routes' files are not touched. New files
    are staged beside the table and moved when all tasks have ended, so a failed write leaves the table as it was."""
    new.repartition(key).sortWithinPartitions(key).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def split_documents(parts: DataFrame, counters: DataFrame, split_type: str) -> DataFrame:
    """One JSON text for a split: sorted routes and counters of each part. A split's routes are one row's lists."""
    lists = parts.groupBy("part").agg(F.array_sort(F.collect_list("route_id")).alias("routes")).join(counters, "part")
    cells = F.map_from_entries(F.collect_list(F.struct("part", F.struct("routes", "n_routes", "n_activations", "n_takeovers"))))
    return lists.agg(cells.alias("parts")).select(F.to_json(F.struct(F.lit(split_type).alias("split_type"), "parts")).alias("value"))


def write_results(runs: DataFrame, path: str) -> None:
    """Runs with their maps of metrics, a JSON row for each."""
    runs.write.mode("append").json(path)


def markdown(df: DataFrame, limit: int = 10_000) -> str:
    """An aggregate as a table for a report, all its rows; one of more than `limit` rows is no report and is refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table of more than {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
