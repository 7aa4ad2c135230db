"""Set similarity join of word n-grams, with count vectors in a tree.

A document's set holds the hashes of its distinct runs of K words (with fewer words, of all of them). The hashes are
dealt to GROUPS groups; the counts in the groups are the document's point, and the sum of the lesser coordinates of
two points bounds their sets' overlap from above. Pairs that the bound lets pass are verified on the sets.

Count vectors of unlike texts of one length lie too close for a tree over the whole corpus to part them (all their
counts are near the mean), so points are indexed block by block: a block has the documents that share one of the
rarest hashes of their prefix, which any two similar sets do. Steps:

1. equal sets become one class, its smallest id its representative (copies are never paired);
2. blocks of two or more representatives have leaders; a document is first compared with only one of its blocks'
   leaders: groups of copies fall together without their pairs being listed;
3. where a document and a block's leader are still apart they are compared, and blocks of more than two that
   hold several components are joined through a tree of count vectors; what the tree lets pass
   between different components is verified. Large blocks are cut to pieces that meet two by two.

No link is lost: a pair is left out only if the bound excludes it, if it has been verified, or if links connect it
already. Null or empty texts and texts without words have empty sets and no links; null ids have no component; rows
with one id are told apart by their texts, and rows equal in id and text are one document, whose answer all of them get
(one_of_each keeps one); an empty table gives no rows; other columns are ignored, and kept by one_of_each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import connected_components, free, ids_repeat, keep_ids, keyed, prepare

K, LEAST, OF = 5, 75, 100  # links: OF * overlap >= LEAST * union
#: Least number of groups of a count vector (a tree's), and the greatest that goes with each row of a block.
GROUPS, FINE = 64, 2048
#: Prefix hashes that a task holds before it passes them on, and about so many in a bucket.
HELD = 1 << 18
#: Counters of hashes by their leading bits, by which frequent hashes come last in the order of prefixes; they are
#: summed in PARTS parts.
CELLS, PARTS = 1 << 20, 64
#: Points in a tree, and in its leaves.
PIECE, LEAF = 4096, 32


def sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes."""
    words = B.Words(buf, off, B.SOLID)
    at, h = words.grams(K)
    bounds = np.searchsorted(words.doc[at], np.arange(len(off)))
    short = words.run_hash(words.first[:-1], np.minimum(words.first[1:], words.first[:-1] + K))
    return [np.unique(h[bounds[i] : bounds[i + 1]]) if n >= K else short[i : i + 1] if n else h[:0] for i, n in enumerate(words.count.tolist())]


def prefix(tokens: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rarest hashes, so many that a similar set must share one, rarest first."""
    n = len(tokens)
    keep = n - -(-LEAST * n // OF) + 1
    return tokens[np.lexsort((tokens, weight[tokens >> B.U(44)]))[:keep]]


def vector(tokens: np.ndarray) -> np.ndarray:
    """Counts in a power of two of groups, two for each hash at least, so the bound is close; a vector folds to fewer."""
    groups = max(GROUPS, 1 << (2 * len(tokens) - 1).bit_length())
    while True:
        out = np.bincount((tokens >> B.U(8)).astype(np.int64) % groups, minlength=groups)
        if out.max() < 256:
            return out.astype(np.uint8)
        groups *= 2


def fold(vec: np.ndarray, groups: int) -> np.ndarray:
    return vec.reshape(-1, groups).sum(0, dtype=np.int64)


def squeeze(vec: np.ndarray) -> bytes:
    return zstandard.compress(vec.tobytes(), 1)


def stretch(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8)


def bound(a: bytes, b: bytes) -> tuple[int, int, int]:
    """The most that two sets can overlap by their vectors, and the sets' sizes."""
    x, y = stretch(a), stretch(b)
    groups = min(len(x), len(y))
    x, y = fold(x, groups), fold(y, groups)
    return int(np.minimum(x, y).sum()), int(x.sum()), int(y.sum())


def _each(batches, names=("doc_id",)) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        ids = B.column(batch, "doc_id").to_pylist()
        for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
            yield ids[lo:hi], sets(buf, off)


def _classes(docs: DataFrame) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n, digest d1 d2 of the set) and of a task's counters (kind 1: part, counts)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts, seen, held = np.zeros(CELLS, np.int64), set(), []
        for ids, group in _each(batches):
            digests = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in group]
            new = [t for t, d in zip(group, digests, strict=True) if d not in seen and not seen.add(d)]
            held += new
            if sum(map(len, held)) >= HELD:
                counts += np.bincount((np.concatenate(held) >> B.U(44)).astype(np.int64), minlength=CELLS)
                held = []
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), pa.array([len(t) for t in group], pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if held:
            counts += np.bincount((np.concatenate(held) >> B.U(44)).astype(np.int64), minlength=CELLS)
        parts = [_pack(x) for x in counts.reshape(PARTS, -1)]
        none = pa.nulls(PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(PARTS, np.int32)), none, none, none, none, pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(parts, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, d1 long, d2 long, part int, counts binary").checkpoint()


def _weights(told: DataFrame) -> np.ndarray:
    """The counters' sums; PARTS rows reach the driver, CELLS numbers in all."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(B.column(batch, "part").to_pylist(), B.column(batch, "counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + _unpack(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(x) for x in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((PARTS, CELLS // PARTS), np.uint32)
    for row in told.where("kind = 1").select("part", "counts").repartition(PARTS, "part").mapInArrow(run, "part int, counts binary").collect():
        out[row["part"]] = np.minimum(_unpack(bytes(row["counts"])), (1 << 32) - 1)
    return out.ravel()


def _pack(x: np.ndarray) -> bytes:
    """int64 numbers, bytes of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _prefixes(docs: DataFrame, weight, buckets: int) -> DataFrame:
    """Prefix hashes of each document, a row (bucket, tokens, docs) for each bucket of hashes and HELD hashes of a task.

    Documents that share a hash within a row are told at once as rows (token, doc_id, pos); only the smallest of them
    stands in tokens and docs, with its place in flags set: a hash counts once for each row, however frequent.
    """
    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("flags", pa.binary()), ("token", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])

    def told(tokens, ids, pos):
        by = np.lexsort((ids, tokens))
        tokens, ids, pos = tokens[by], ids[by], pos[by]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        group = np.cumsum(new) - 1
        lead = ids[new][group]
        more = ~new & (ids != lead)
        if more.any():
            n, none = int(more.sum()), pa.nulls(int(more.sum()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), none, none, none, none, pa.array(B.signed(tokens[more])), pa.array(ids[more]), pa.array(pos[more])], schema=schema)
        flag = np.bincount(group[more], minlength=group[-1] + 1) > 0
        tokens, ids, pos = tokens[new], ids[new], pos[new]
        place = (tokens % B.U(buckets)).astype(np.int64)
        by = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by], np.arange(buckets + 1))
        rows = [(k, tokens[x].tobytes(), _pack(ids[x]), _pack(pos[x]), np.packbits(flag[x]).tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist() for x in (by[cuts[k] : cuts[k + 1]],)]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in rows], schema.field(j).type) for j in range(5)), none, none, none], schema=schema)

    def run(batches):
        rank, tokens, owners, places, size = weight.value, [], [], [], 0
        for ids, group in _each(batches):
            parts = [prefix(t, rank) if len(t) else t for t in group]
            tokens += parts
            owners.append(np.repeat(np.array(ids, np.int64), [len(p) for p in parts]))
            places += [np.arange(len(p)) for p in parts]
            size += len(owners[-1])
            if size >= HELD:
                yield from told(*map(np.concatenate, (tokens, owners, places)))
                tokens, owners, places, size = [], [], [], 0
        if size:
            yield from told(*map(np.concatenate, (tokens, owners, places)))

    return docs.where("doc_id is not null").mapInArrow(run, "bucket long, tokens binary, docs binary, places binary, flags binary, token long, doc_id long, pos long").checkpoint()


def _members(told: DataFrame) -> DataFrame:
    """(token, doc_id, pos) of the hashes of two or more documents; pos: place of the hash in the document's prefix."""
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64())])

    def shared(rows):
        tokens = np.frombuffer(b"".join(r[0] for r in rows), B.U)
        ids, pos = (np.concatenate([_unpack(r[j]) for r in rows]) for j in (1, 2))
        flag = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(r[0]) // 8) for r in rows]).astype(bool)
        by = np.lexsort((ids, tokens))
        tokens, ids, pos, flag = tokens[by], ids[by], pos[by], flag[by]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        group = np.cumsum(new) - 1
        keep = (np.bincount(group) > 1)[group] | flag
        return pa.RecordBatch.from_arrays([pa.array(B.signed(tokens[keep])), pa.array(ids[keep]), pa.array(pos[keep])], schema=schema)

    def run(batches):
        held, key = [], None
        for batch in batches:
            for k, *row in zip(*(B.column(batch, c).to_pylist() for c in ("bucket", "tokens", "docs", "places", "flags")), strict=True):
                if k != key and held:
                    yield shared(held)
                    held = []
                key = k
                held.append(row)
        if held:
            yield shared(held)

    dealt = told.where("bucket is not null").select("bucket", "tokens", "docs", "places", "flags").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "token long, doc_id long, pos long").unionByName(told.where("bucket is null").select("token", "doc_id", "pos"))


def _points(docs: DataFrame) -> DataFrame:
    """(doc_id, n, vec, small): small is the vector folded to FINE groups at most, 255 for that or more."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("small", pa.binary())])

    def run(batches):
        for ids, group in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in group], pa.int64()), *_vectors([vector(t) for t in group])], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, vec binary, small binary").checkpoint()


def _vectors(vecs: list[np.ndarray]) -> list[pa.Array]:
    small = [v if len(v) <= FINE else np.minimum(fold(v, FINE), 255).astype(np.uint8) for v in vecs]
    return [pa.array(map(squeeze, vecs), pa.binary()), pa.array(map(squeeze, small), pa.binary())]


def _tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens)"""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for ids, group in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.tobytes() for t in group], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, tokens binary")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.distinct()
    return keep_ids(docs, ids, "doc_id", ids.count())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def enough(overlap, n_a, n_b):
    return (OF + LEAST) * overlap >= LEAST * (n_a + n_b)


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sizes and the count vectors' bound let pass."""

    def run(batches):
        for batch in batches:
            keep = [bool(enough(*bound(x, y))) for x, y in zip(B.column(batch, "va").to_pylist(), B.column(batch, "vb").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sizes = [points.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab"]
    near = pairs.join(sizes[0], "a").join(sizes[1], "b").where(F.expr(f"least(na, nb) * {OF} >= greatest(na, nb) * {LEAST}")).select("a", "b")
    side = [points.select(F.col("doc_id").alias(x), F.col("vec").alias(f"v{x}")) for x in "ab"]
    return near.join(side[0], "a").join(side[1], "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches):
        for batch in batches:
            ta, tb = (B.column(batch, x).to_pylist() for x in ("ta", "tb"))
            keep = []
            for x, y in zip(ta, tb, strict=True):
                x, y = np.frombuffer(x, B.U), np.frombuffer(y, B.U)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                keep.append(bool(enough(int(np.count_nonzero(both[1:] == both[:-1])), len(x), len(y))))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    sets_ = _tokens(_only(docs, _ends(pairs))).checkpoint()
    side = [sets_.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab"]
    return pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").checkpoint()


class Tree:
    """Points packed into leaves by halving along the widest coordinate; nodes hold maxima and the sizes' range."""

    def __init__(self, vecs: np.ndarray, sizes: np.ndarray, comps: np.ndarray, pos: np.ndarray | None = None):
        self.vecs, self.sizes, self.comps = vecs, sizes, comps
        # a pair's sets share no hash before the first that they share: what is left bounds the overlap, too
        self.left = sizes - (pos if pos is not None else 0)
        self.nodes: list[tuple] = []  # rows or None, children, maxima, least and greatest size, component if only one
        if len(vecs):
            self.root = self._build(np.arange(len(vecs)))

    def _build(self, rows: np.ndarray) -> int:
        sizes, vecs, comps = self.sizes[rows], self.vecs[rows], self.comps[rows]
        own = int(comps[0]) if (comps == comps[0]).all() else None
        children = ()
        if len(rows) > LEAF:
            spread = vecs.std(0)
            key = sizes if sizes.std() > spread.max() else vecs[:, int(spread.argmax())]
            order = rows[np.argsort(key, kind="stable")]
            children = self._build(order[: len(rows) // 2]), self._build(order[len(rows) // 2 :])
        self.nodes.append((rows if not children else None, children, vecs.max(0), int(sizes.min()), int(sizes.max()), own))
        return len(self.nodes) - 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the pairs of different components that the bound lets pass, each once."""
        todo = [(self.root, self.root)] if self.nodes else []
        while todo:
            i, j = todo.pop()
            rows_a, kids_a, max_a, lo_a, hi_a, own_a = self.nodes[i]
            rows_b, kids_b, max_b, lo_b, hi_b, own_b = self.nodes[j]
            if own_a is not None and own_a == own_b:
                continue
            if OF * hi_a < LEAST * lo_b or OF * hi_b < LEAST * lo_a or not enough(int(np.minimum(max_a, max_b).sum()), lo_a, lo_b):
                continue
            if i == j and kids_a:
                x, y = kids_a
                todo += [(x, x), (x, y), (y, y)]
            elif kids_a and (not kids_b or hi_a - lo_a >= hi_b - lo_b):
                todo += [(k, j) for k in kids_a]
            elif kids_b:
                todo += [(i, k) for k in kids_b]
            else:
                over = np.minimum(self.vecs[rows_a][:, None], self.vecs[rows_b][None]).sum(2)
                ok = enough(over.astype(np.int64), self.sizes[rows_a][:, None], self.sizes[rows_b][None]) & (self.comps[rows_a][:, None] != self.comps[rows_b][None])
                ok &= enough(np.minimum(self.left[rows_a][:, None], self.left[rows_b][None]), self.sizes[rows_a][:, None], self.sizes[rows_b][None])
                if i == j:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if len(x):
                    yield rows_a[x], rows_b[y]


def _tree_join(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each block of rows (block, piece, side, doc_id, comp, pos, n, small); side: 0 or 1, or null if all meet all."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block).combine_chunks()
        col = {c: table[c].to_numpy() for c in ("doc_id", "comp", "n", "pos")}
        raw = [stretch(x) for x in table["small"].to_pylist()]
        width = np.array([len(x) for x in raw])
        fine = {w: np.stack([raw[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width).tolist()}
        row = np.zeros(len(raw), np.int64)
        for w in fine:
            row[width == w] = np.arange(len(fine[w]))
        vecs = np.stack([fold(np.where(x == 255, 1 << 40, x), GROUPS) for x in raw])
        side = table["side"].to_numpy(zero_copy_only=False)
        out = [np.zeros((0, 2), np.int64)]
        for x, y in Tree(vecs, col["n"], col["comp"], col["pos"]).pairs():
            ok = ~(side[x] == side[y])  # null (nan) is unequal to all
            x, y = x[ok], y[ok]
            for w in np.unique(np.stack((width[x], width[y]), 1), axis=0).tolist():  # the bound in all groups
                at = np.flatnonzero((width[x] == w[0]) & (width[y] == w[1]))
                va, vb = fine[w[0]][row[x[at]]], fine[w[1]][row[y[at]]]
                if w[0] != w[1]:
                    va, vb = (v.reshape(len(v), -1, min(w)).astype(np.int64) for v in (va, vb))
                    va, vb = (np.where(v == 255, 1 << 40, v).sum(1) for v in (va, vb))
                least = np.minimum(va, vb)
                over = least.sum(1, dtype=np.int64) + np.where((least == 255).any(1), 1 << 40, 0)
                at = at[enough(over, col["n"][x[at]], col["n"][y[at]])]
                out.append(np.sort(np.stack((col["doc_id"][x[at]], col["doc_id"][y[at]]), 1), 1))
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([B.column(batch, c).to_numpy() for c in ("block", "piece")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if tuple(keys[lo]) != key and held:
                    yield join(held)
                    held = []
                key = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield join(held)

    return rows.repartition("block", "piece").sortWithinPartitions("block", "piece").mapInArrow(run, "a long, b long")


def _led(members: DataFrame) -> DataFrame:
    """(token, doc_id, pos, leader): the leader of a hash is the document whose hashes are in the largest blocks, so in
    a group of copies the one that the others were made from; of several the smallest."""
    sizes = members.groupBy("token").agg(F.count("*").alias("cnt"))
    scores = members.select("token", "doc_id").join(sizes, "token").groupBy("doc_id").agg(F.sum("cnt").alias("score"))
    scored = members.select("token", "doc_id", "pos").join(scores, "doc_id")
    leaders = scored.groupBy("token").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("leader"))
    return scored.select("token", "doc_id", "pos").join(leaders, "token")


def _held(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with comp and led, the components of document and leader."""
    for doc, out in (("doc_id", "comp"), ("leader", "led")):
        members = members.join(comps.select(F.col("node").alias(doc), F.col("component").alias(out)), doc, "left").withColumn(out, F.coalesce(out, doc))
    return members.select("token", "doc_id", "leader", "pos", "comp", "led")


def _residual(held: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of the blocks that hold several components, ready for _tree_join. Of blocks with equal members only that
    of the hash which comes first counts: there the members' places are least."""
    h = F.xxhash64("doc_id")
    mixed = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("cnt"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.sum("pos").alias("p")).where("lo < hi and cnt > 2")  # of two, one leads
    blocks = mixed.groupBy("cnt", "x", "s").agg(F.min_by("token", F.struct("p", "token")).alias("token")).select("token", "cnt")
    rows = held.select("token", "doc_id", "pos", "comp").join(blocks, "token").withColumn("cuts", F.ceil(F.col("cnt") / F.lit(PIECE)).cast("int"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("cuts")).cast("int")
    # piece i * cuts + j (i <= j) has the rows of cuts i and j; those of one cut meet each other in piece i * cuts + i
    place = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct((F.least(F.col("own"), j) * F.col("cuts") + F.greatest(F.col("own"), j)).cast("long").alias("piece"), F.when(j != F.col("own"), (F.col("own") > j).cast("int")).alias("side")))
    rows = rows.withColumn("own", own).withColumn("at", F.explode(place))
    return rows.join(points.select("doc_id", "n", "small"), "doc_id").select(F.col("token").alias("block"), "at.piece", F.col("at.side").cast("double").alias("side"), "doc_id", "comp", "pos", "n", "small")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not ids_repeat(docs):
        return _components(docs)
    rows, key, known = keyed(docs)
    found = _components(known).withColumnRenamed("doc_id", key).checkpoint()
    names = rows.select(F.col(key).alias("component_id"), "doc_id").where("component_id is not null").distinct().withColumnRenamed("doc_id", "name")
    own = rows.where(F.col(key).isNotNull()).join(found, key).join(names, "component_id").select("doc_id", "n_shingles", F.col("name").alias("component_id"))
    return own.unionByName(_components(rows.where(F.col(key).isNull()).select("doc_id", "text")))


def _components(docs: DataFrame) -> DataFrame:
    """components() of rows whose ids are null or differ."""
    spark = docs.sparkSession
    told = _classes(docs)
    weight = spark.sparkContext.broadcast(_weights(told))
    rows = told.where("kind = 0").select("doc_id", "n", "d1", "d2")
    # only digests that repeat; written down, they stand as a shuffle of their own beside the rows, which Spark can split
    reps = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("d1", "d2", "rep").checkpoint()
    member = rows.join(reps, ["d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    copies = member.where("doc_id <> rep").select("doc_id").distinct()
    unlike = keep_ids(docs, copies, "doc_id", copies.count(), anti=True)
    total = rows.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    members = _led(_members(_prefixes(unlike, weight, int(total // HELD) + 1)).checkpoint()).checkpoint()
    points = _points(_only(unlike, members.select("doc_id")))
    # each document is first compared with the leader that leads most of its hashes
    led = members.where("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    pair = F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")
    first = _bounded(led.select(*pair).distinct(), points).checkpoint()
    comps = connected_components(_verified(first, unlike)).checkpoint()
    held = _held(members, comps).checkpoint()
    stars = held.where("comp <> led").select(*pair)
    more = _bounded(stars.unionByName(_tree_join(_residual(held, points))).distinct().join(first, ["a", "b"], "left_anti"), points).checkpoint()
    more = _verified(more, unlike)
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    out = member.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component. Rows without an id stay."""
    prepare(docs.sparkSession)
    rows, key = docs.withColumn(free(docs.columns, "__document"), F.col("doc_id").cast("long")), free(docs.columns, "__document")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if ids_repeat(docs):
        rows, key, known = keyed(docs)
        rows = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
    rest = _components(known).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct().checkpoint()
    return keep_ids(rows, rest, key, rest.count(), anti=True).select(*docs.columns)
