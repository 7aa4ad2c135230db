"""Annotation of query sequences with the labels of their windows, as run-length intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kmers, packed, tree
from .hierarchy import LabelTree
from .index import Index

#: Windows of all queries up to which the index is read for their strings only.
ASKED = 1_000_000


def run_lengths(df: DataFrame, keys: list[str], order: str, value: str, length: str | None = None) -> DataFrame:
    """keys, start, end (half open) and value of each run of rows with equal value (null equals null) in order.

    Rows are intervals [order, length) if length names a column of their ends, else single places. Runs break where
    the value changes, not where places are missing.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(True), 1, False).over(w)
    flagged = df.withColumn("__new", (~same).cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(length) if length else F.max(order) + 1
    return flagged.groupBy(*keys, "__run").agg(F.min(order).alias("start"), end.alias("end"), F.first(value).alias(value)).drop("__run")


def labelled_windows(queries: DataFrame, labels: DataFrame, k: int, seen: Observation | None = None, pairs: bool = False, tasks: int | None = None) -> DataFrame:
    """(query_rank, piece, start, end, label) of the windows of queries (query_rank, seq); neighbouring windows with
    other characters than A, C, G, T are one row. labels: (w0, ..., label) or (kmer, label) with each string once; pairs:
    an index's paired_labels(). tasks: how many make the windows, all if it is not given."""
    if "kmer" in labels.columns:
        labels = labels.select(*(c.alias(name) for name, c in packed.pack(F.col("kmer"), k).items()), "label")
    names = packed.columns(k)
    asked = packed.asked_windows(queries, k, pairs, tasks)
    if seen is not None:
        asked = asked.observe(seen, F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n_kmers"))
    return asked.join(labels, names, "left").drop(*names)


def annotate(queries: DataFrame, labels: DataFrame, k: int, seen: Observation | None = None, pairs: bool = False, tasks: int | None = None) -> DataFrame:
    """(query_rank, from_kmer, to_kmer, label) of queries (query_rank, seq), misses (label null) included.

    Runs are found within the pieces of a sequence first, then across pieces, so that a chromosome is not one task.
    """
    found = labelled_windows(queries.select("query_rank", "seq", *packed.cut_columns(queries)), labels, k, seen, pairs, tasks)
    first = run_lengths(found, ["query_rank", "piece"], "start", "label", "end")
    whole = run_lengths(first.drop("piece"), ["query_rank"], "start", "label", "end")
    return whole.select("query_rank", F.col("start").alias("from_kmer"), F.col("end").alias("to_kmer"), "label")


def lookup(queries: DataFrame, index: Index, k: int | None = None, misses: bool = False, labels: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """(query_rank, query_name, from_kmer, to_kmer, label, label_name) of queries (query_rank, query_name, seq).

    labels: the index's packed_labels(k), if many lookups share them. Without, the index is read for the queries' own
    strings if these are few, so nothing else of it is moved. seen: tells n_kmers, the windows looked up, once the result
    has been read, without a scan of its own. As many tasks make the windows as their number is worth. Queries may be
    pieces (readers.read_pieces with k - 1 letters after).
    """
    k = kmers.check_k(k or index.s, index.s)
    pairs = tasks = None
    if labels is None:
        asked, size = None, counted(queries, k).first()
        tasks = packed.tasks_for(queries, size["n_kmers"] + size["n_queries"] * k)
        if size["n_kmers"] <= ASKED:
            asked = packed.asked_windows(queries, k, tasks=tasks).where("w0 is not null").select(*packed.columns(k)).distinct()
        else:
            pairs = index.paired_labels(k)
        labels = pairs if pairs is not None else index.packed_labels(k, asked)
    runs = annotate(queries, labels, k, seen, pairs is not None, tasks)
    if not misses:
        runs = runs.where("label is not null")
    runs = tree.with_name(runs, index.labels)
    names = queries.select("query_rank", "query_name")
    if packed.cut_columns(queries):
        names = queries.where("offset = 0").select("query_rank", "query_name")
    return runs.join(names, "query_rank").select("query_rank", "query_name", "from_kmer", "to_kmer", "label", "label_name")


def counted(queries: DataFrame, k: int, seconds: float | None = None) -> DataFrame:
    """One row: n_queries, n_kmers (windows looked up) of queries (seq), and nanoseconds for each if a time is given."""
    whole = F.greatest(F.length("seq") - (kmers.check_k(k) - 1), F.lit(0))
    windows = F.sum(F.least(whole, F.col("own")) if packed.cut_columns(queries) else whole).cast("long")
    row = queries.agg(F.count("*").alias("n_queries"), F.coalesce(windows, F.lit(0)).alias("n_kmers"))
    return row if seconds is None else row.withColumn("ns_per_kmer", F.when(F.col("n_kmers") > 0, seconds * 1e9 / F.col("n_kmers")))


def hits(queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The distinct windows of queries (seq) that are in labels (kmer)."""
    return kmers.windows(queries.select(kmers.upper(F.col("seq")).alias("seq")), "seq", k).select("kmer").distinct().join(labels, "kmer", "left_semi")


def misses(queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    return kmers.windows(queries.select(kmers.upper(F.col("seq")).alias("seq")), "seq", k).select("kmer").distinct().join(labels, "kmer", "left_anti")


def render(runs: DataFrame, query_names: bool = False, label_ids: bool = False) -> DataFrame:
    """The columns of the text output in order of query and place; misses are `none` by name and `-` by id."""
    query = F.col("query_name") if query_names else F.col("query_rank")
    label = F.coalesce(F.col("label").cast("string"), F.lit("-")) if label_ids else F.coalesce("label_name", F.lit("none"))
    return runs.orderBy("query_rank", "from_kmer").select(query.alias("query_name" if query_names else "query_rank"), "from_kmer", "to_kmer", label.alias("label" if label_ids else "label_name"))


def render_debug(runs: DataFrame, labels: LabelTree) -> DataFrame:
    """Hits only, by ids, the root as `*`."""
    label = F.when(F.col("label") == labels.root, F.lit("*")).otherwise(F.col("label").cast("string"))
    return runs.where("label is not null").orderBy("query_rank", "from_kmer").select(F.col("query_rank").alias("seq_rank"), "from_kmer", "to_kmer", label.alias("label"))
