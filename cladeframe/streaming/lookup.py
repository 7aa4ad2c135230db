"""Annotation of query files as they arrive in a folder, and of records that arrive piece by piece."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.index import Index
from ..operators.lookup import annotate, lookup, run_lengths
from ..functions import kmers, tree
from ..sources.readers import read_sequences

STATE = "query string, tail string, next long, start long, end long, label int"


def watch(spark: SparkSession, folder: str, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int | None = None, misses: bool = False, files_per_batch: int = 16) -> StreamingQuery:
    """Each new file of folder (FASTA or FASTQ) is looked up and handed to sink(runs, batch id).

    The stream carries the files' names; their records are read by the batch reader, so large files are split. The labels
    of the index's strings of k letters are kept by the executors from the first batch on, and rolled up anew only where
    an executor is lost. Files that are there at the start count as new; the query ends when it has read what is there.
    """
    k = k or index.s
    labels = index.packed_labels(k).persist()
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def batch(df: DataFrame, number: int) -> None:
        paths = [r["path"] for r in df.collect()]  # files_per_batch at most
        if paths:
            records = read_sequences(spark, paths)
            sink(lookup(records.select(F.xxhash64("file", "seq_rank").alias("query_rank"), F.col("name").alias("query_name"), "seq"), index, k, misses, labels), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(pieces: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int | None = None, misses: bool = False) -> StreamingQuery:
    """Records that arrive in pieces: pieces (query, no, seq, last) is a stream whose batches bring the pieces of a record
    in the order of no, any number of them in a batch; last marks the final one. sink(runs, batch id) gets (query,
    from_kmer, to_kmer, label, label_name) of the runs that are closed: a run stays open across batches for as long as
    its label goes on, and the runs of a record are those of a lookup of the whole.

    What is kept of an open record are its last k - 1 letters, how many letters it had, and its last run. This state is a
    table in the checkpoint folder for each batch; a batch reads the one before it and writes its own, so one that is run
    again after a failure or a restart does the same again. sink should replace what it wrote for the same batch id.
    Pieces without a query's name belong to no record and are left out; an empty piece, or a null one, adds no letters.
    """
    spark = pieces.sparkSession
    k = kmers.check_k(k or index.s, index.s)
    labels = index.packed_labels(k).persist()
    path = lambda name, number: f"{checkpoint}/{name}/{number}"

    def batch(df: DataFrame, number: int) -> None:
        held = spark.read.schema(STATE).parquet(path("runs", number - 1)) if number else spark.createDataFrame([], STATE)
        new = df.where("query is not null").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("no", F.coalesce("seq", F.lit("")).alias("seq")))).alias("parts"), F.max(F.coalesce("last", F.lit(False))).alias("ended"))
        met = new.join(held, "query", "left").select(
            F.monotonically_increasing_id().alias("query_rank"), "query", F.concat(F.coalesce("tail", F.lit("")), F.array_join("parts.seq", "")).alias("seq"),
            (F.coalesce("next", F.lit(0)) - F.length(F.coalesce("tail", F.lit("")))).alias("offset"), "ended", "start", "end", "label",
        )
        met.write.mode("overwrite").parquet(path("arrived", number))
        met = spark.read.parquet(path("arrived", number))
        found = annotate(met.select("query_rank", "seq"), labels, k).join(met.select("query_rank", "query", "offset"), "query_rank")
        runs = found.select("query", (F.col("from_kmer") + F.col("offset")).alias("start"), (F.col("to_kmer") + F.col("offset")).alias("end"), "label")
        runs = run_lengths(runs.unionByName(met.where("start is not null").select("query", "start", "end", "label")), ["query"], "start", "label", "end")
        runs = runs.join(met.select("query", "ended"), "query").withColumn("open", ~F.col("ended") & (F.col("start") == F.max("start").over(Window.partitionBy("query"))))
        tails = met.where("not ended").select("query", F.right("seq", F.lit(k - 1)).alias("tail"), (F.col("offset") + F.length("seq")).alias("next"))
        kept = tails.join(runs.where("open").select("query", "start", "end", "label"), "query", "left").unionByName(held.join(new.select("query"), "query", "left_anti"))
        kept.write.mode("overwrite").parquet(path("runs", number))
        closed = runs.where("not open" if misses else "not open and label is not null").select("query", F.col("start").alias("from_kmer"), F.col("end").alias("to_kmer"), "label")
        sink(tree.with_name(closed, index.labels), number)
        _drop(spark, path("runs", number - 2), path("arrived", number - 1))

    return pieces.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _drop(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
