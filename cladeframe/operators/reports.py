"""Reports on annotation runs: contingency matrices, differences, shares, imports of another classifier's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOVEL = "novel"


def matrix_long(runs: DataFrame, query: str = "query", label: str = "label") -> DataFrame:
    """(query, label, bases): summed lengths of runs (query, start, end, label)."""
    return runs.groupBy(F.col(query).alias("query"), F.col(label).alias("label")).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))


def merge_labels(long: DataFrame, into: dict[str, str], column: str = "label", value: str = "bases") -> DataFrame:
    """A long matrix with some labels counted as others."""
    if not into:
        return long
    name = F.coalesce(F.create_map(*(F.lit(x) for pair in into.items() for x in pair))[F.col(column)], F.col(column))
    return long.withColumn(column, name).groupBy("query", column).agg(F.sum(value).cast("long").alias(value))


def pivot(long: DataFrame, labels: list[str] | None = None, row: str = "query", column: str = "label", value: str = "bases") -> DataFrame:
    """A row for each query in order of its name, a column for each label (sorted as strings), zeros for what is missing.

    The labels are a report's columns: those of the tree, or the distinct ones found.
    """
    labels = sorted(labels if labels is not None else [r[0] for r in long.select(column).distinct().collect()])
    return long.groupBy(row).pivot(column, labels).agg(F.sum(value)).na.fill(0).orderBy(row)


def unpivot(matrix: DataFrame, row: str = "query", column: str = "label", value: str = "bases") -> DataFrame:
    return matrix.unpivot([row], [c for c in matrix.columns if c != row], column, value)


def translate(label: Column, name: Column) -> Column:
    """Name of a label id; `-` is novel; an id without a name keeps itself."""
    return F.when(label == "-", F.lit(NOVEL)).otherwise(F.coalesce(name, label))


def translate_foreign(taxid: Column, name: Column) -> Column:
    """Another classifier's ids: 0 and - are novel, A (ambiguous) is the root."""
    return F.when(taxid.isin("0", "-"), F.lit(NOVEL)).when(taxid == "A", F.lit("root")).otherwise(F.coalesce(name, taxid))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log10(F.abs(x) + 1)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, label, a, b, diff, signed_log) of two long matrices; what only one has counts as zero in the other."""
    both = a.withColumnRenamed("bases", "a").join(b.withColumnRenamed("bases", "b"), ["query", "label"], "full").na.fill(0, ["a", "b"])
    diff = (F.col("a") - F.col("b")).cast("long")
    return both.select("query", "label", "a", "b", diff.alias("diff"), signed_log(diff).alias("signed_log"))


def shares(stats: DataFrame, key: str = "k", value: str = "count") -> DataFrame:
    """stats with total and percent of each row among those of its key; percent of an empty total is null."""
    total = F.sum(value).over(Window.partitionBy(key)).cast("long")
    return stats.withColumn("total", total).withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col(value) / F.col("total")))


def short_query(name: Column) -> Column:
    """chr1_MATERNAL becomes 1-M, chrX_PATERNAL X-P, chrM Mito; other names stay."""
    parent = F.regexp_extract(name, r"^chr([^_]+)_([MP])ATERNAL$", 2)
    short = F.concat(F.regexp_extract(name, r"^chr([^_]+)_([MP])ATERNAL$", 1), F.lit("-"), parent)
    return F.when(name == "chrM", F.lit("Mito")).when(parent != "", short).otherwise(name)


def display_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a fixed order of a column's values; values that it lacks follow, sorted."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column)) if order else F.lit(0)
    return df.orderBy(F.when(place > 0, place).otherwise(F.lit(len(order) + 1)), column)


def bench_summary(logs: DataFrame) -> DataFrame:
    """(name, threads, ns_per_bp, wall_s, rss_gib, speedup) of log records (name, threads, ns_per_bp, wall, rss_kib);
    speedup is against one thread of the same name."""
    parts = F.transform(F.split("wall", ":"), lambda x: x.cast("double"))
    wall = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    one = logs.where("threads = 1").select("name", F.col("ns_per_bp").alias("one"))
    rows = logs.join(one, "name", "left")
    return rows.select("name", "threads", "ns_per_bp", wall.alias("wall_s"), (F.col("rss_kib") / 1048576.0).alias("rss_gib"), (F.col("one") / F.col("ns_per_bp")).alias("speedup"))
