"""Statistics of an index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import packed, tree
from ..plans.ship import ship
from .index import Index

#: What stands for no label in a task.
NO_LABEL = -1


def _with_empty(index: Index) -> DataFrame:
    """Labels of the positions and of the empty string, the unlabelled root of the prefixes."""
    spark = index.positions.sparkSession
    return tree.with_lca(index.positions.select("lo", "hi"), index.labels).unionByName(spark.range(1).select(F.lit(None).cast("int").alias("label")))


def histogram(index: Index) -> DataFrame:
    """(label, label_name, count): positions of each label of the tree, zeros included, and of none (null)."""
    counts = _with_empty(index).groupBy("label").agg(F.count("*").alias("n"))
    spark = index.positions.sparkSession
    nodes = index.labels.nodes(spark).select(F.col("id").alias("label"), F.col("name").alias("label_name")).unionByName(spark.createDataFrame([(None, "none")], "label int, label_name string"))
    return nodes.join(counts, nodes["label"].eqNullSafe(counts["label"]), "left").select(nodes["label"], "label_name", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def sizes(index: Index) -> DataFrame:
    """One row: n_mers, strings of s letters; n_positions, all strings of the index and the empty one."""
    return index.positions.agg(F.count_if(F.col("n") == index.s).alias("n_mers"), (F.count("*") + 1).alias("n_positions"))


def run_sizes(rows: DataFrame, value: str = "label", sums: tuple[str, ...] = ()) -> DataFrame:
    """One row: run_min, run_max, run_mean of the lengths of the runs of equal value (an int column; null is a value), of
    rows that stand in order, in parts (part) that do so too; the sums of the columns in sums.

    Each task walks over its own part, whatever its size. What it tells is one row: its first and last run, and the
    number, least, greatest and total length of those between. Only these rows, one for each part, meet to be joined.
    """
    spark = rows.sparkSession
    ship(spark)
    names = ["first", "n_first", "last", "n_last", "runs", "least", "greatest", "total"]

    def walk(batches):
        part, ends, told, added = None, [], np.zeros(4, np.int64), [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            labels = batch.column(1).fill_null(NO_LABEL).to_numpy()
            added = [a + int(np.nansum(batch.column(2 + i).to_numpy(zero_copy_only=False))) for i, a in enumerate(added)]
            cut = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1))
            runs = [[int(v), int(n)] for v, n in zip(labels[cut[[0, -1]]], np.diff(np.append(cut, len(labels)))[[0, -1]], strict=True)]
            size = np.diff(np.append(cut, len(labels)))[1:-1]
            # the run that is open goes on, or is one of those between
            first, closed = runs[0], list(size)
            if ends and ends[-1][0] == first[0]:
                ends[-1][1] += first[1]
            else:
                ends.append(first)
            if len(cut) > 1:
                ends.append(runs[1])
            closed += [n for _, n in ends[1:-1]]
            ends = [ends[0], ends[-1]] if len(ends) > 1 else ends
            if closed:
                told = np.array([told[0] + len(closed), min(closed) if not told[0] else min(told[1], *closed), max(told[2], *closed), told[3] + sum(closed)])
        if ends:
            last = ends[1] if len(ends) > 1 else [None, 0]
            row = [part, *ends[0], *last, *map(int, told), *added]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["part", *names, *sums])

    walked = rows.select("part", F.col(value).cast("int").alias("value"), *(F.col(c).cast("long").alias(c) for c in sums)).mapInArrow(walk, ", ".join(f"{c} long" for c in ("part", *names, *sums)))
    walked = walked.persist()
    edges = walked.select("part", F.posexplode(F.array(F.struct(F.col("first").alias("value"), F.col("n_first").alias("n")), F.struct(F.col("last").alias("value"), F.col("n_last").alias("n")))).alias("side", "run"))
    edges = edges.where("run.n > 0").select("part", "side", "run.value", "run.n")
    inside = walked.select("part", "runs").where("runs > 0").select(F.col("part"), F.lit(True).alias("parted"))
    # between a part's two edges stand its other runs, so these are never joined
    order = Window.orderBy("part", "side")  # two rows for each part
    joins = (F.lag("value").over(order) == F.col("value")) & ((F.col("side") == 0) | ~F.coalesce("parted", F.lit(False)))
    edges = edges.join(inside, "part", "left").withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    edges = edges.withColumn("id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id").agg(F.sum("n").alias("n"))
    every = edges.select(F.lit(1).alias("runs"), F.col("n").alias("least"), F.col("n").alias("greatest"), F.col("n").alias("total"), *(F.lit(0).alias(c) for c in sums))
    every = every.unionByName(walked.select("runs", F.when(F.col("runs") > 0, F.col("least")).alias("least"), "greatest", "total", *sums))
    return every.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.coalesce(F.min("least"), F.lit(0)).alias("run_min"), F.coalesce(F.max("greatest"), F.lit(0)).alias("run_max"),
        F.coalesce(F.sum("total") / F.nullif(F.sum("runs"), F.lit(0)), F.lit(0.0)).alias("run_mean"), F.coalesce(F.sum("total"), F.lit(0)).alias("n"),
    )


def run_stats(index: Index, parts: int | None = None) -> DataFrame:
    """One row: n_mers (of s letters), labelled and unlabelled positions; least, greatest, mean length of the runs of
    equal labels when positions (and the empty string) are sorted from their right ends."""
    rows = tree.with_lca(index.sorted(parts).select("part", "n", "lo", "hi"), index.labels)
    counted = rows.select("part", "label", (F.col("n") == index.s).cast("long").alias("n_mers"), F.col("label").isNotNull().cast("long").alias("labelled"))
    spark = index.positions.sparkSession
    # the empty string is the first of all, in a part of its own
    empty = spark.range(1).select(F.lit(-1).alias("part"), F.lit(None).cast("int").alias("label"), F.lit(0).cast("long").alias("n_mers"), F.lit(0).cast("long").alias("labelled"))
    found = run_sizes(counted.unionByName(empty), sums=("n_mers", "labelled"))
    return found.select("n_mers", "labelled", (F.col("n") - F.col("labelled")).alias("unlabelled"), "run_min", "run_max", "run_mean")


def node_stats(index: Index, parts: int | None = None) -> DataFrame:
    """(k, label, label_name, count): distinct strings of k letters by label, for all k up to s, zeros included.

    Positions are sorted once, from their right ends, so the strings of k letters are the runs of neighbours that have
    the last k letters in common. A task tells these by the length that neighbours share, for each k, on the rows that
    it has: the runs within a batch are whole, and are counted by label at once; the first and the last run of a batch,
    which may go on beside it, are handed on with their span and merged by Spark. What is moved are the positions, once,
    whatever s is.
    """
    spark = index.positions.sparkSession
    ship(spark)
    names, s = packed.columns(index.s), index.s
    shared = spark.sparkContext.broadcast(tree.Ancestors(index.labels))  # some ten numbers for each node of the tree
    fields = [("k", pa.int32()), *((c, pa.int64()) for c in names), ("lo", pa.int32()), ("hi", pa.int32()), ("label", pa.int32()), ("n", pa.int64())]
    schema = pa.schema(fields)

    def walk(batches):
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [batch.column(i).to_numpy().view(np.uint64) for i in range(len(names))]
            n, lo, hi = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1), batch.column(len(names) + 2)
            lo, hi = lo.fill_null(1 << 30).to_numpy(), hi.fill_null(-1).to_numpy()
            same = packed.alike(words, n)
            rows = []
            for k in range(1, s + 1):
                there = np.flatnonzero(n >= k)
                if not len(there):
                    break
                # a shorter string between two neighbours parts them, as it ends otherwise or comes first
                new = np.ones(len(there), bool)
                if len(there) == len(n):
                    new[1:] = same < k
                else:
                    least = np.minimum.reduceat(same[: there[-1]], there[:-1]) if len(there) > 1 else same[:0]
                    new[1:] = least < k
                head = np.flatnonzero(new)
                low, high = np.minimum.reduceat(lo[there], head), np.maximum.reduceat(hi[there], head)
                for at in {0, len(head) - 1}:
                    key = [int(w[there[head[at]]] & packed.MASKS[min(max(k - packed.LETTERS * i, 0), packed.LETTERS)]) for i, w in enumerate(words)]
                    key = [x - (1 << 64) if x >> 63 else x for x in key]
                    rows.append((k, *key, *((int(low[at]), int(high[at])) if high[at] >= 0 else (None, None)), None, None))
                inner = slice(1, len(head) - 1)
                known = high[inner] >= 0
                found, times = np.unique(shared.value.of(low[inner][known], high[inner][known]), return_counts=True)
                for label, number in zip(found.tolist(), times.tolist(), strict=True):
                    counts[k, label] = counts.get((k, label), 0) + number
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            if len(counts) > 100_000:
                yield told(counts)
                counts = {}
        if counts:
            yield told(counts)

    def told(counts):
        rows = [(k, *([0] * len(names)), None, None, label, number) for (k, label), number in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    walked = index.sorted(parts).select(*names, "n", "lo", "hi").mapInArrow(walk, ", ".join(["k int", *(f"{c} long" for c in names), "lo int, hi int, label int, n long"])).persist()
    spans = walked.where("n is null").groupBy("k", *names).agg(*tree.merge_spans())
    across = tree.with_lca(spans, index.labels).where("label is not null").select("k", "label", F.lit(1).cast("long").alias("n"))
    counts = across.unionByName(walked.where("n is not null").select("k", "label", "n")).groupBy("k", "label").agg(F.sum("n").alias("n"))
    nodes = index.labels.nodes(spark).select(F.col("id").alias("label"), F.col("name").alias("label_name"))
    grid = nodes.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(s))))
    return grid.join(counts, ["k", "label"], "left").select("k", "label", "label_name", F.coalesce("n", F.lit(0)).cast("long").alias("count"))
