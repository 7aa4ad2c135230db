"""The longest indexed string that ends at each letter of a query, with its label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed, tree
from ..plans.session import scratch
from .index import Index, load

#: Rows of the strings at the edges of parts that are sent to every executor at most.
EDGES = 2_000_000


def longest(queries: DataFrame, index: Index) -> DataFrame:
    """(query_rank, pos, length, label) of each letter of queries (query_rank, seq): the longest indexed string, of up to
    s letters, that ends there (length 0 and no label if there is none), for all lengths in one pass.

    Strings with an indexed ending stand beside it in the order of the index from the right ends. Each letter's string is
    dealt to the part of the saved index that it falls into; there a binary search finds its two neighbours, which tell
    the longest match, and two more the range of the positions that end with it, whose least and greatest label a table
    of minima tells. A range that reaches a part's first or last position may go on beside it: such strings, two at most
    for each length and part, are merged over all parts and joined. A task holds the positions of one part.

    An index that is not a saved one is written to the session's shared folder first.
    """
    spark = queries.sparkSession
    if index.parts is None:
        path = scratch(spark, "longest")
        index.save(path)
        index = load(spark, path)
    s, names = index.s, packed.columns(index.s)
    asked = packed.asked_ends(queries, s)
    if not len(index.parts.numbers):
        return asked.select("query_rank", "pos", F.lit(0).alias("length"), F.lit(None).cast("int").alias("label"))
    firsts, numbers = index.parts.first, index.parts.numbers  # a key for each part
    shared = spark.sparkContext.broadcast((firsts, tree.Ancestors(index.labels)))

    def deal(batches):
        for batch in batches:
            words = [batch.column(2 + i).to_numpy() for i in range(len(names))]
            at = np.searchsorted(shared.value[0], packed.keys(words, batch.column(2 + len(names)).to_numpy()), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers[np.maximum(at, 0)].astype(np.int32)), *batch.columns], names=["part", *batch.schema.names])

    kinds = ", ".join(["query_rank long", "pos long", *(f"{c} long" for c in names), "n int"])
    dealt = asked.where("n > 0").mapInArrow(deal, f"part int, {kinds}")
    held = index.positions.select("part", F.lit(None).cast("long").alias("query_rank"), F.lit(None).cast("long").alias("pos"), *names, "n", "lo", "hi")
    both = held.unionByName(dealt.select("part", "query_rank", "pos", *names, "n", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi")))
    both = both.repartition("part").sortWithinPartitions("part", F.col("query_rank").isNotNull(), *names, "n")
    fields = [("query_rank", pa.int64()), ("pos", pa.int64()), ("length", pa.int32()), *((c, pa.int64()) for c in names), ("lo", pa.int32()), ("hi", pa.int32()), ("label", pa.int32()), ("edge", pa.bool_())]
    schema = pa.schema(fields)

    def match(batches):
        now, parts, held = None, [], None
        for batch in batches:
            part = batch.column(0).to_numpy()
            query = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    if held is None and parts:
                        yield _Held(parts, names, shared.value).edges(s, schema)
                    now, parts, held = part[a], [], None
                rows = batch.slice(a, b - a)
                if not query[a]:
                    parts.append(rows)
                    continue
                if held is None:
                    held = _Held(parts, names, shared.value)
                    yield held.edges(s, schema)
                yield held.found(rows, schema)
        if held is None and parts:
            yield _Held(parts, names, shared.value).edges(s, schema)

    met = both.mapInArrow(match, ", ".join(["query_rank long", "pos long", "length int", *(f"{c} long" for c in names), "lo int, hi int, label int, edge boolean"])).persist()
    keys = ["length", *names]
    edges = tree.with_lca(met.where("query_rank is null").groupBy(*keys).agg(*tree.merge_spans()), index.labels, "joined")
    small = len(numbers) * 2 * s <= EDGES
    inside, across = met.where("query_rank is not null and not edge"), met.where("query_rank is not null and edge")
    across = across.drop("label").join(F.broadcast(edges) if small else edges, keys, "left").withColumnRenamed("joined", "label")
    out = ["query_rank", "pos", "length", "label"]
    broken = asked.where("n = 0").select("query_rank", "pos", F.lit(0).alias("length"), F.lit(None).cast("int").alias("label"))
    return inside.select(*out).unionByName(across.select(*out)).unionByName(broken)


class _Held:
    """The positions of one part, in order."""

    def __init__(self, parts: list[pa.RecordBatch], names: list[str], shared):
        table = pa.Table.from_batches(parts).combine_chunks()
        firsts, self.ancestors = shared
        self.names = names
        self.words = [table[c].to_numpy().view(np.uint64) for c in names]
        self.n = table["n"].to_numpy()
        self.lo, self.hi = table["lo"].fill_null(1 << 30).to_numpy(), table["hi"].fill_null(-1).to_numpy()
        self.least, self.most = tree.Minima(self.lo), tree.Minima(-self.hi)
        self.keys = packed.keys(self.words, self.n)
        at = int(np.searchsorted(firsts, self.keys[0], "right"))
        self.last_part, self.first_part = at == len(firsts), at <= 1
        self.next = firsts[at : at + 1]

    def _spans(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position, and the one after the last, of those that end with the last length letters of the strings
        whose numbers are at."""
        words = [w.view(np.int64) for w in at]
        low = packed.endings(words, length)
        most = [(w.view(np.uint64) | ~packed.MASKS[np.clip(length - packed.LETTERS * i, 0, packed.LETTERS)]) for i, w in enumerate(words)]
        # what lies behind the letters is all ones at most; the turned bit is one too
        high = []
        for i, w in enumerate(most):
            none = length <= packed.LETTERS * i
            high.append(np.where(none, np.uint64(0x7FFFFFFFFFFFFFFF), w).view(np.int64))
        first = np.searchsorted(self.keys, packed.keys(low, length), "left")
        return first, np.searchsorted(self.keys, packed.keys(high, np.full(len(length), 1 << 15)), "right")

    def _labels(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        known = hi >= 0
        out = np.zeros(len(lo), np.int32)
        out[known] = self.ancestors.of(lo[known], hi[known])
        return pa.array(out, mask=~known)

    def found(self, rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        words, n = [rows.column(3 + i).to_numpy().view(np.uint64) for i in range(len(self.names))], rows.column(3 + len(self.names)).to_numpy()
        at = np.searchsorted(self.keys, packed.keys(words, n), "right")
        length = np.zeros(len(n), np.int64)
        for side in (at - 1, at):
            there = np.flatnonzero((side >= 0) & (side < len(self.keys)))
            beside = side[there]
            length[there] = np.maximum(length[there], packed.common([w[there] for w in words], n[there], [w[beside] for w in self.words], self.n[beside]))
        beyond = np.flatnonzero(at == len(self.keys))
        if len(beyond) and len(self.next):  # the first string of the next part
            raw = np.frombuffer(self.next[0].ljust(self.keys.dtype.itemsize, b"\0"), np.uint8)
            following = [np.full(len(beyond), int.from_bytes(raw[8 * i : 8 * i + 8].tobytes(), "big") ^ (1 << 63), np.uint64) for i in range(len(words))]
            n_next = np.full(len(beyond), int.from_bytes(raw[-2:].tobytes(), "big"))
            length[beyond] = np.maximum(length[beyond], packed.common([w[beyond] for w in words], n[beyond], following, n_next))
        some = np.flatnonzero(length > 0)
        ends = packed.endings([w.view(np.int64) for w in words], length)
        first, last = self._spans([w[some] for w in words], length[some])
        edge = np.zeros(len(n), bool)
        edge[some] = ((first == 0) & (not self.first_part)) | ((last == len(self.keys)) & (not self.last_part))
        lo, hi = np.full(len(n), 1 << 30), np.full(len(n), -1)
        full = last > first
        lo[some[full]], hi[some[full]] = self.least.of(first[full], last[full] - 1), -self.most.of(first[full], last[full] - 1)
        none = pa.nulls(len(n), pa.int32())
        return pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(length.astype(np.int32)), *map(pa.array, ends), none, none, self._labels(lo, hi), pa.array(edge)], schema=schema)

    def edges(self, s: int, schema: pa.Schema) -> pa.RecordBatch:
        """Span of the positions of this part that end like its first and like its last one, for each length."""
        rows = []
        for at in {0, len(self.n) - 1}:
            length = np.arange(1, min(s, int(self.n[at])) + 1)
            words = [np.repeat(w[at], len(length)) for w in self.words]
            first, last = self._spans(words, length)
            lo, hi = self.least.of(first, last - 1), -self.most.of(first, last - 1)
            ends = packed.endings([w.view(np.int64) for w in words], length)
            rows.append([length.astype(np.int32), *ends, np.where(hi >= 0, lo, -1).astype(np.int32), hi.astype(np.int32)])
        length, *ends, lo, hi = (np.concatenate(x) for x in zip(*rows, strict=True))
        gone = hi < 0
        none = pa.nulls(len(length), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(length), *map(pa.array, ends), pa.array(lo, mask=gone), pa.array(hi, mask=gone), pa.nulls(len(length), pa.int32()), pa.array(np.ones(len(length), bool))], schema=schema)
