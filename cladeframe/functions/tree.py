"""Lowest common ancestors as columns.

The ancestor of a set of nodes is that of its first and last member in depth-first order, so a set aggregates to the
least and the greatest place (tin), with partial sums on the map side. The ancestor of two places is the parent of the
shallowest node behind the first and up to the second, which two entries of a sparse table of minima tell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hierarchy import LabelTree
from ..plans.ship import ship

#: Nodes up to which the tree's table is a constant of the expression; larger trees are sent to the tasks as arrays.
INLINE = 512
#: Nodes of a tree whose names go to each executor; beyond it the join is left to the planner.
BROADCAST_NODES = 1_000_000
#: Places of a block of the table of large trees.
BLOCK = 32


def span(tin: Column) -> list[Column]:
    """Aggregates lo and hi of a set of places."""
    return [F.min(tin).alias("lo"), F.max(tin).alias("hi")]


def merge_spans() -> list[Column]:
    return [F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def ranks(tree: LabelTree) -> tuple[np.ndarray, np.ndarray]:
    """For each place the rank of its node from the shallowest on; for each rank the id of the parent."""
    depth, tin = np.asarray(tree.depth), np.asarray(tree.tin)
    order = np.lexsort((tin, depth))
    rank = np.empty(len(tin), np.int32)
    rank[tin[order]] = np.arange(len(tin), dtype=np.int32)
    return rank, np.asarray(tree.parents, np.int32)[order]


def sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... values from each place on; places too near the end repeat what is there."""
    out, size = [values], 1
    while 2 * size <= len(values):
        last = out[-1]
        longer = last.copy()
        longer[:-size] = np.minimum(last[:-size], last[size:])
        out, size = [*out, longer], 2 * size
    return out


class Minima:
    """The least of any stretch of numbers, many stretches at once. Within a block minima run from its beginning and from
    its end; a sparse table holds the blocks' own, so all take some three times the numbers."""

    def __init__(self, values: np.ndarray):
        blocks = max(-(-len(values) // BLOCK), 1)
        self.values = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        grid = self.values.reshape(blocks, BLOCK)
        self.before = np.minimum.accumulate(grid, axis=1).ravel()
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = np.stack(sparse(grid.min(axis=1)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of the values from place a up to place b, both included."""
        x, y = a // BLOCK, b // BLOCK
        best = np.minimum(self.after[a], self.before[b])
        near = np.flatnonzero(x == y)
        best[near] = self.values[a[near]]
        for step in range(1, BLOCK if len(near) else 0):
            best[near] = np.minimum(best[near], self.values[np.minimum(a[near] + step, b[near])])
        far = np.flatnonzero(y - x > 1)
        first, last = x[far] + 1, y[far] - 1
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        best[far] = np.minimum(best[far], np.minimum(self.table[level, first], self.table[level, last - (1 << level) + 1]))
        return best


class Ancestors:
    """The ancestor of many pairs of places at once, however deep the tree is."""

    def __init__(self, tree: LabelTree):
        rank, self.parent = ranks(tree)
        self.id = np.empty(len(rank), np.int32)
        self.id[np.asarray(tree.tin)] = np.arange(len(rank), dtype=np.int32)
        self.shallowest = Minima(rank)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Ids of the ancestors of the places lo <= hi."""
        if not len(lo):
            return np.zeros(0, np.int32)
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        out = self.id[lo].copy()
        part = np.flatnonzero(lo < hi)
        out[part] = self.parent[self.shallowest.of(lo[part] + 1, hi[part])]
        return out


def _numbers(values) -> Column:
    """A constant array; the planner reads the text once."""
    return F.split(F.lit(",".join(map(str, np.asarray(values).tolist()))), ",").cast("array<int>")


def with_lca(df: DataFrame, tree: LabelTree, out: str = "label") -> DataFrame:
    """df with the id of the ancestor of the places lo and hi (null: null), without these two columns."""
    n = len(tree)
    if n <= INLINE:
        rank, parent = ranks(tree)
        table = _numbers(np.concatenate(sparse(rank)))
        ids = _numbers(np.argsort(np.asarray(tree.tin)))
        level = F.get(_numbers([max(x, 1).bit_length() - 1 for x in range(n + 1)]), F.col("hi") - F.col("lo"))
        at = lambda place: F.get(table, level * n + place)
        best = F.least(at(F.col("lo") + 1), at(F.col("hi") + 1 - F.get(_numbers([1 << j for j in range(n.bit_length())]), level)))
        label = F.when(F.col("lo") == F.col("hi"), F.get(ids, F.col("lo"))).when(F.col("lo").isNotNull(), F.get(_numbers(parent), best))
        return df.withColumn(out, label.cast("int")).drop("lo", "hi")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Ancestors(tree))  # some ten numbers for each node of the tree

    @F.pandas_udf("int")
    def ancestor(lo: pd.Series, hi: pd.Series) -> pd.Series:
        known = (lo.notna() & hi.notna()).to_numpy()
        found = pd.Series(pd.array([pd.NA] * len(lo), "Int32"))
        found[known] = shared.value.of(lo[known].to_numpy(), hi[known].to_numpy())
        return found

    return df.withColumn(out, ancestor("lo", "hi")).drop("lo", "hi")


def place(tree: LabelTree, label: Column) -> Column:
    """tin of a label id, for trees that are a constant of the expression."""
    return F.get(_numbers(tree.tin), label)


def name(tree: LabelTree, label: Column) -> Column:
    return F.get(F.array(*map(F.lit, tree.names)), label)


def with_tin(df: DataFrame, tree: LabelTree, label: str = "label") -> DataFrame:
    """df with tin in place of the label id."""
    if len(tree) <= INLINE:
        return df.withColumn("tin", place(tree, F.col(label))).drop(label)
    nodes = tree.nodes(df.sparkSession).select(F.col("id").alias(label), "tin")
    return df.join(F.broadcast(nodes) if len(tree) <= BROADCAST_NODES else nodes, label, "left").drop(label)


def with_name(df: DataFrame, tree: LabelTree, label: str = "label", out: str = "label_name") -> DataFrame:
    if len(tree) <= INLINE:
        return df.withColumn(out, name(tree, F.col(label)))
    nodes = tree.nodes(df.sparkSession).select(F.col("id").alias(label), F.col("name").alias(out))
    return df.join(F.broadcast(nodes) if len(tree) <= BROADCAST_NODES else nodes, label, "left")
