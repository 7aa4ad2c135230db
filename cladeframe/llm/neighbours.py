"""Approximate nearest neighbours by balanced posting lists.

fit() cuts a bounded sample (SAMPLE rows that a hash of the id draws) into lists of equal size, by halving it again and
again along the line between two centres, then moves the centroids in a few rounds in which large lists cost more. The
centroids and the graph that links each to its nearest ones go to every executor: SAMPLE / 4 of them at most.

Every vector goes to the list of its nearest centroid; vectors near a boundary, with other centroids within SHARE of
that distance, are replicated to up to COPIES lists. Centroids are found by walking the graph from fixed entries. A
query reads the lists whose centroids are within a ratio of the distance of its nearest one. The ratio is measured: it
is the smallest of RATIOS by which queries out of the sample find TARGET of their true neighbours within the sample;
without one all lists are read. A query that so reaches fewer than k + 1 vectors takes further lists, nearest first, so
that k are found wherever there are k.

Lists and queries meet by list, in blocks of up to BLOCK vectors and BLOCK queries, so neither a list with a third of all
vectors nor one with a third of all queries is one task. Of equal vectors the k + 1 smallest ids are searched: no other
can be among the k nearest of any query. Distances are Euclidean, in double precision, on the vectors as they are; ties
go to the smaller id.

Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those of another length than the most frequent one (the smaller of equally frequent ones). Rows of one id are one row,
that with the least vector. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from . import bytewise as B
from .common import prepare, stored

#: Rows that the centroids are fitted on, about, and vectors of a list that the number of lists aims at.
SAMPLE, LIST_ROWS = 32_768, 256
#: Lists that hold one vector at most, and how much further than its nearest centroid the others may be.
COPIES, SHARE = 3, 1.1
#: Ratios of distances tried by the measurement, and the recall that it asks for.
RATIOS = (1.02, 1.04, 1.06, 1.08, 1.1, 1.13, 1.16, 1.2, 1.25, 1.3, 1.4, 1.5, 1.75, 2.0, 3.0)
TARGET = 0.97
#: Vectors and queries of a list that meet in one group.
BLOCK = 4096
#: Links of a centroid, and centroids that the walk keeps following whatever their distance.
LINKS, BEAM = 24, 8


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and of b, by their products; exact enough to choose by."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


@dataclass
class Lists:
    """Centroids, their links, the entries of the walk, and the ratio that queries read lists by."""

    centroids: np.ndarray
    links: np.ndarray = field(init=False)
    entries: np.ndarray = field(init=False)
    ratio: float = np.inf

    def __post_init__(self):
        n = len(self.centroids)
        most = min(LINKS, n - 1)
        nearest = np.empty((n, most), np.int64)
        for i in range(0, n, 512):
            d = squares(self.centroids[i : i + 512], self.centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            nearest[i : i + 512] = np.argpartition(d, most - 1, axis=1)[:, :most] if most else 0
        # along the order of the halving, so that every centroid is reached, and back where a centroid has few links
        linked = [{int(j) for j in nearest[i]} | {j for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)]
        for i in range(n):
            for j in nearest[i]:
                if len(linked[j]) < 2 * LINKS:
                    linked[j].add(i)
        self.links = np.full((n, max(map(len, linked), default=1) or 1), -1, np.int32)
        for i, x in enumerate(linked):
            self.links[i, : len(x)] = sorted(x)
        self.entries = np.unique(np.linspace(0, n - 1, int(np.ceil(np.sqrt(n)))).astype(np.int64))

    def walk(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Squared distances of the rows of x to the centroids that the walk came to, infinite for the others."""
        c = self.centroids
        seen = np.full((len(x), len(c)), np.inf)
        seen[:, self.entries] = squares(x, c[self.entries])
        done = np.zeros(seen.shape, bool)
        beam = min(BEAM, seen.shape[1]) - 1
        while True:
            bound = np.maximum(seen.min(1) * ratio**2, np.partition(seen, beam, axis=1)[:, beam])
            row, at = np.nonzero((seen <= bound[:, None]) & np.isfinite(seen) & ~done)
            if not len(row):
                return seen
            done[row, at] = True
            to = self.links[at]
            new = np.zeros(seen.shape, bool)
            new[np.repeat(row, to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]] = True
            row, at = np.nonzero(new & ~np.isfinite(seen))
            seen[row, at] = ((x[row] - c[at]) ** 2).sum(1)

    def holding(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, list and whether it is the row's first one, for each list that a row of x goes to."""
        seen = self.walk(x, SHARE)
        most = min(COPIES, seen.shape[1])
        at = np.argsort(seen, axis=1, kind="stable")[:, :most]
        near = np.take_along_axis(seen, at, 1)
        row, j = np.nonzero((near <= near[:, :1] * SHARE**2) & np.isfinite(near))
        return row, at[row, j], j == 0

    def reading(self, x: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each list that a query of x reads; sizes: vectors that have a list as their first one."""
        seen = self.walk(x, self.ratio) if np.isfinite(self.ratio) else squares(x, self.centroids)
        read = np.isfinite(seen) & (seen <= seen.min(1, keepdims=True) * self.ratio**2)
        for i in np.flatnonzero(read @ sizes < least):
            order = np.argsort(squares(x[i : i + 1], self.centroids)[0], kind="stable")
            read[i, order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1]] = True
        return np.nonzero(read)


def _halves(x: np.ndarray, rows: np.ndarray, n: int, rnd: np.random.Generator) -> list[np.ndarray]:
    """rows cut into n groups of sizes that differ by one or so, neighbours in space together."""
    if n <= 1 or len(rows) <= 1:
        return [rows]
    own = x[rows]
    a, b = own[rnd.choice(len(own), 2, replace=False)]
    for _ in range(4):
        side = ((own - a) ** 2).sum(1) > ((own - b) ** 2).sum(1)
        if side.all() or not side.any():
            break
        a, b = own[~side].mean(0), own[side].mean(0)
    order = np.argsort(own @ (b - a), kind="stable")
    at = len(rows) * (n // 2) // n
    return _halves(x, rows[order[:at]], n // 2, rnd) + _halves(x, rows[order[at:]], n - n // 2, rnd)


def train(x: np.ndarray, n_lists: int, k: int) -> Lists:
    """Lists of a sample; the same sample in the same order gives the same ones."""
    rnd = np.random.default_rng(13)
    groups = [g for g in _halves(x, np.arange(len(x)), min(n_lists, len(x)), rnd) if len(g)]
    centroids = np.stack([x[g].mean(0) for g in groups])
    sizes = np.array([len(g) for g in groups], float)
    for _ in range(3 if len(groups) > 1 else 0):
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids))
        for i in range(0, len(x), 1024):
            d = squares(x[i : i + 1024], centroids)
            near = (d * (0.9 + 0.1 * sizes / sizes.mean())).argmin(1)  # large lists cost more
            np.add.at(sums, near, x[i : i + 1024])
            counts += np.bincount(near, minlength=len(centroids))
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        sizes = counts
    lists = Lists(centroids)
    # the ratio, by queries out of the sample against all of it
    asked = rnd.choice(len(x), min(256, len(x)), replace=False)
    row, of, _ = (np.concatenate(p) for p in zip(*((r + i, o, f) for i in range(0, len(x), 512) for r, o, f in [lists.holding(x[i : i + 512])]), strict=True))
    held = np.zeros((len(x), len(centroids)), bool)
    held[row, of] = True
    d = squares(x[asked], x)
    d[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    for ratio in RATIOS:
        seen = lists.walk(x[asked], ratio)
        read = np.isfinite(seen) & (seen <= seen.min(1, keepdims=True) * ratio**2)
        if all(t.size for t in true) and np.mean([held[t] @ r > 0 for t, r in zip(true, read, strict=True)]) >= TARGET:
            lists.ratio = ratio
            break
    return lists


def _values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The vectors of a batch, which are all of one length, as rows of doubles."""
    at = B.column(batch, name)
    return at.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, each id once."""
    kind = vectors.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # one row at most
    rows = rows.where(F.size("v") == (lengths["n"] if lengths else 0))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def _differing(rows: DataFrame, most: int) -> DataFrame:
    """rows (id, v) with only the most smallest ids of equal vectors."""
    told = rows.withColumn("h", F.xxhash64("v"))
    # digests are counted first, so that only vectors that occur too often are sorted
    often = told.groupBy("h").count().where(F.col("count") > most).select("h").checkpoint()
    if often.isEmpty():
        return rows
    least = Window.partitionBy("v").orderBy("id")
    hot = told.join(often, "h", "left_semi").select("id", "v").withColumn("place", F.row_number().over(least)).where(F.col("place") <= most)
    return told.join(often, "h", "left_anti").select("id", "v").unionByName(hot.select("id", "v"))


def fit(rows: DataFrame, n: int, k: int) -> Lists:
    """Lists for the n rows (id, v), of a sample of about SAMPLE of them, in one task."""
    draw = F.xxhash64(F.lit(13), "id")
    share = min(1.0, SAMPLE / n)
    drawn = rows if share == 1 else rows.where(draw <= F.lit(int(share * 2.0**64) - (1 << 63)))
    n_lists = max(1, min(-(-n // LIST_ROWS), SAMPLE // 4))

    def learn(batches):
        parts = [(B.column(b, "id").to_numpy(), _values(b, "v")) for b in batches if b.num_rows]
        if parts:
            ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(x[np.argsort(ids)], n_lists, k))])], names=["model"])

    return pickle.loads(drawn.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def _pairs(rows: DataFrame, find, extra: str, kind: str) -> DataFrame:
    """(list, extra, id, v): rows (id, v) once for each list that find(v) gives."""
    schema = f"list int, {extra} boolean, id long, v {kind}"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, of, told = find(_values(batch, "v"))
                took = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(told), B.column(took, "id"), B.column(took, "v")], names=["list", extra, "id", "v"])

    return rows.mapInArrow(run, schema)


def _scan(k: int):
    """Of rows sorted by group, queries before vectors: the k nearest of each query among the group's vectors."""

    def nearest(ids, q, found):
        for at in range(len(ids)):
            held = found[at]
            held.sort()
            for score, other in held[:k]:
                yield int(ids[at]), int(other), float(score)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    def look(ids, q, found, vids, v):
        for lo in range(0, len(ids), 256):
            own, mine = q[lo : lo + 256], ids[lo : lo + 256]
            d = squares(own, v)
            slack = 1e-9 * ((own * own).sum(1) + (v * v).sum(1).max())
            d[mine[:, None] == vids[None, :]] = np.inf
            cut = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(own), np.inf)
            for i in range(len(own)):
                took = np.flatnonzero((d[i] <= cut[i] + slack[i]) & np.isfinite(d[i]))
                exact = np.sqrt(((v[took] - own[i]) ** 2).sum(1))
                held = found[lo + i]
                held += zip(exact.tolist(), vids[took].tolist(), strict=True)
                if len(held) > 8 * k:
                    held.sort()
                    del held[k:]

    def run(batches):
        now, ids, q, found, rows = None, None, None, None, []
        for batch in batches:
            keys = np.stack([B.column(batch, c).to_numpy() for c in ("list", "vb", "qb")], 1)
            kind, number, v = B.column(batch, "vectors").to_numpy(zero_copy_only=False), B.column(batch, "id").to_numpy(), _values(batch, "v")
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (kind[1:] != kind[:-1])) + 1, [len(keys)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a])
                if key != now:
                    if now is not None:
                        rows += nearest(ids, q, found)
                        if len(rows) > 10_000:
                            yield out(rows)
                            rows = []
                    now, ids, q, found = key, np.zeros(0, np.int64), np.zeros((0, v.shape[1])), []
                if not kind[a]:
                    ids, q = np.concatenate((ids, number[a:b])), np.concatenate((q, v[a:b]))
                    found += [[] for _ in range(b - a)]
                elif len(ids):
                    look(ids, q, found, number[a:b], v[a:b])
        if now is not None:
            rows += nearest(ids, q, found)
        if rows:
            yield out(rows)

    return run


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose key every divides, among all other rows."""
    spark = prepare(vectors.sparkSession)
    rows = stored(usable(vectors, key, vector), "vectors")
    asked, differing = rows.where(F.pmod("id", F.lit(every)) == 0), stored(_differing(rows, k + 1), "differing")
    n, kind = differing.count(), rows.schema["v"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = fit(differing, n, k)
    shared = spark.sparkContext.broadcast(lists)  # SAMPLE / 4 centroids at most
    posted = stored(_pairs(differing, lambda x: shared.value.holding(x), "first", kind), "postings")
    size = len(lists.centroids)
    counts = {r["list"]: (r["n"], r["firsts"]) for r in posted.groupBy("list").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts")).collect()}  # a row for each list
    firsts = np.array([counts.get(i, (0, 0))[1] for i in range(size)])
    least = min(k + 1, n)

    def reads(x):
        row, of = shared.value.reading(x, firsts, least)
        return row, of, np.zeros(len(row), bool)

    reading = stored(_pairs(asked, reads, "first", kind), "reading")
    queries = {r["list"]: r["count"] for r in reading.groupBy("list").count().collect()}  # a row for each list
    blocks = spark.createDataFrame([(i, -(-counts[i][0] // BLOCK), -(-queries[i] // BLOCK)) for i in range(size) if i in counts and i in queries], "list int, nv int, nq int")
    own = F.xxhash64("id")
    columns = "list", "vb", "qb", "vectors", "id", "v"
    # each block of a list's vectors meets each block of its queries
    held = posted.join(F.broadcast(blocks), "list").select("list", F.pmod(own, "nv").cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.lit(True).alias("vectors"), "id", "v")
    ask = reading.join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("vb"), F.pmod(own, "nq").cast("int").alias("qb"), F.lit(False).alias("vectors"), "id", "v")
    dealt = held.select(*columns).unionByName(ask.select(*columns)).repartition("list", "vb", "qb").sortWithinPartitions("list", "vb", "qb", "vectors")
    found = dealt.mapInArrow(_scan(k), "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
