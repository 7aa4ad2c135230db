"""Removal of repeated strings of LENGTH bytes by suffix arrays over shards.

A byte goes if some string of LENGTH bytes around it also starts earlier: in a document of smaller id, or earlier in
the same document. Strings are those of the UTF-8 bytes of the input; they never cross documents.

1. Documents of equal bytes are one class; all but the first lose every byte (if they have LENGTH bytes), and only the
   first goes on.
2. Every string of LENGTH bytes has an anchor: the least hash among its grams of GRAM bytes. Equal strings have the
   same anchor at the same place, so only strings whose anchor occurs again can be repeated. A piece is an anchor with
   all strings it is the anchor of.
3. Pieces go to shards by their anchor. A shard keeps the first piece of equal ones; the suffixes of unlike pieces are
   sorted by Larsson and Sadakane's refinement, common prefixes come from Kasai's walk, and each run of suffixes with
   LENGTH bytes in common has its first occurrence.
4. The strings of an anchor that occurs more than HOT times get a second, longer one (LONG bytes) and go by that: what
   surrounds a frequent short line tells its strings apart. A second anchor that occurs more than SPREAD times is
   spread over several shards; each sorts its pieces and keeps its first occurrences. The shards' sorted lists are dealt
   out in ranges of strings, and in each range every list is looked up by binary search in those merged before it.

Null and empty texts have no bytes; rows without an id are answered by nothing else than their own length and are
never removed; rows with one id are told apart by their texts, in the order of a hash of them, and rows equal in id and
text are one document, whose answer all of them get; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import BROADCAST_IDS, keep_ids, keyed, prepare

LENGTH, GRAM, LONG = 100, 32, 90
#: Occurrences of an anchor beyond which its strings get a longer one, and of that beyond which its pieces are spread.
HOT, SPREAD = 2_000, 8_000
#: Strings in a range of the shards' lists, about.
RANGE = 200_000
#: Bytes of pieces in one suffix array, at most (one piece if it is longer), and bytes of pieces a task remembers.
SHARD_BYTES, SEEN_BYTES = 1 << 20, 24 << 20
#: Repeated anchors that are sent out; more of them are joined to the pieces instead.
SENT = BROADCAST_IDS
_AT = B.U((1 << 30) - 1)

PIECE = "anchor long, doc_id long, at long, starts int, piece binary, salt int"
SCHEMA = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("starts", pa.int32()), ("piece", pa.binary()), ("salt", pa.int32())])


def anchors(buf: np.ndarray, off: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash of the anchor, first string's start and number of strings of each piece."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.view(B.U), none, none
    sums = B.prefix_sums(buf)
    m, grams = n - gram + 1, LENGTH - gram + 1
    h = B.mix((sums[gram:] - sums[:m]) * B.powers(n + 1)[1][:m])
    least = (h & ~_AT) | np.arange(m, dtype=B.U)  # equal up to 34 bits: the leftmost, wherever the text stands
    width = 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
    at = (least & _AT).view(np.int64)
    # a text's last strings start LENGTH bytes before its end
    ok, new = np.zeros(len(at) + 1, np.int8), np.ones(len(at), bool)
    starts, stops = off[:-1], off[1:] - LENGTH + 1
    whole = np.flatnonzero(stops > starts)
    np.add.at(ok, starts[whole], 1)
    np.add.at(ok, stops[whole], -1)
    ok = np.cumsum(ok[:-1], dtype=np.int8).astype(bool)
    new[1:] = at[1:] != at[:-1]
    new[starts[whole]] = True
    first = np.flatnonzero(new & ok)
    count = np.add.reduceat(ok.astype(np.int64), first) if len(first) else none
    return np.searchsorted(off, first, "right") - 1, h[at[first]], first, count


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order. Larsson and Sadakane: groups of suffixes that agree so far are refined by the rank of
    what follows, and the length that is known to agree doubles each time. (Kasai's walk needs the whole order.)"""
    n = len(text)
    packed = np.zeros(n, B.U)
    wide = np.concatenate((text.astype(B.U), np.zeros(8, B.U)))
    for j in range(8):
        packed = (packed << B.U(8)) | wide[j : j + n]
    # behind a last NUL the padding is like text: there the shorter of two suffixes is told by its length
    left = np.minimum(np.arange(n, 0, -1), 8) if n and text[-1] == 0 else None
    order = np.argsort(packed) if left is None else np.lexsort((left, packed))
    head = np.ones(n, bool)
    head[1:] = packed[order[1:]] != packed[order[:-1]]
    if left is not None:
        head[1:] |= left[order[1:]] != left[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    known = 8
    while True:
        open_at = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_at):
            break
        sub = order[open_at]
        follow = np.where(sub + known < n, rank[np.minimum(sub + known, n - 1)] + 1, 0)
        key = rank[sub] * (n + 1) + follow
        inner = np.argsort(key)
        sub, key = sub[inner], key[inner]
        order[open_at] = sub
        fresh = np.ones(len(sub), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[open_at] = fresh
        rank[sub] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For each place in order the length (up to limit) that its suffix has in common with the one before it.

    Kasai's walk goes through a piece's suffixes in text order and keeps all but one symbol of the last length; the
    pieces (which begin at starts) are walked side by side.
    """
    n = len(text)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    ends = np.append(starts[1:], n)
    at, h = starts.copy(), np.zeros(len(starts), np.int64)
    live = np.flatnonzero(at < ends)
    while len(live):
        place = where[at[live]]
        before = order[np.maximum(place - 1, 0)]
        going = np.flatnonzero(place > 0)
        h[live[place == 0]] = 0
        while len(going):
            lane = live[going]
            i, j = at[lane] + h[lane], before[going] + h[lane]
            same = (h[lane] < limit) & (i < n) & (j < n)
            same[same] = text[i[same]] == text[j[same]]
            h[lane[same]] += 1
            going = going[same]
        out[place] = h[live]
        h[live] = np.maximum(h[live] - 1, 0)
        at[live] += 1
        live = live[at[live] < ends[live]]
    return out


def again(pieces: list[tuple[int, int, int, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pieces (doc_id, at, starts, bytes) with unlike bytes: of each string whether it has an earlier equal, and
    the number of its run of equal strings."""
    text = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    size = np.array([len(p[3]) for p in pieces])
    starts = np.cumsum(size) - size  # no string crosses a piece's end, so nothing need stand between pieces
    order = suffix_array(text)
    lcp = common_prefixes(text, order, starts, LENGTH)
    count = np.array([p[2] for p in pieces])
    own = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    run_of = np.cumsum(lcp < LENGTH)
    where = np.empty(len(text), np.int64)
    where[order] = np.arange(len(text))
    run = run_of[where[starts[own] + offset]]
    doc, at = np.array([p[0] for p in pieces])[own], np.array([p[1] for p in pieces])[own] + offset
    by = np.lexsort((at, doc, run))
    later = np.zeros(len(own), bool)
    later[by[1:]] = run[by[1:]] == run[by[:-1]]
    cuts = np.cumsum(count)[:-1]
    return list(zip(np.split(later, cuts), np.split(run, cuts), strict=True))


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


class Spans:
    """Rows (doc_id, at, starts) of strings that have an earlier equal; there is no piece, and the id is the anchor."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []

    def add(self, doc: int, at: int, starts: int) -> None:
        self.rows.append((doc, at, starts))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([cols[0], *cols, pa.nulls(len(rows), pa.binary()), pa.array([-1] * len(rows), pa.int32())], schema=SCHEMA)


def _documents(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches):
        for batch in batches:
            sizes, digests = [], []
            for lo, hi, buf, off in B.chunks(B.column(batch, "text"), 1 << 24):
                sizes += np.diff(off).tolist()
                digests += [hashlib.blake2b(buf[off[i] : off[i + 1]], digest_size=16).digest() for i in range(hi - lo)]
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long").checkpoint()


def longer(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As anchors(), for the strings of some pieces and with the longer anchors."""
    size = count + LENGTH - 1
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)
    piece, h, first, n = anchors(buf[where], np.concatenate(([0], ends)), LONG)
    return doc[piece], h, where[first] if len(first) else first, n


def _counts(docs: DataFrame, hot=None) -> DataFrame:
    """(anchor, n): occurrences, counted in each task first; with a broadcast of hot anchors, of their strings' longer ones."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, buf, off in B.chunks(B.column(batch, "text")):
                doc, h, at, count = anchors(buf, off)
                if hot is not None:
                    keep = np.flatnonzero(_member(h, hot.value))
                    h = longer(buf, off, doc[keep], at[keep], count[keep])[1]
                held.append(h)
                size += len(h)
                if size > 4_000_000:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    def counted(held):
        h, n = np.unique(np.concatenate(held) if held else np.zeros(0, B.U), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(B.signed(h)), pa.array(n.astype(np.int64))], schema=schema)

    return docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").checkpoint()


def _sorted(counts: DataFrame) -> np.ndarray:
    """The anchors of counts, many in a row on their way to the driver."""

    def run(batches):
        parts = [B.column(b, "anchor").to_numpy().tobytes() for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["packed"])

    got = counts.select("anchor").mapInArrow(run, "packed binary").collect()  # 8 bytes for each of SENT anchors at most
    return np.sort(np.frombuffer(b"".join(r["packed"] for r in got), B.U))


def _pieces(docs: DataFrame, known) -> DataFrame:
    """Pieces with a repeated anchor. Equal pieces of a task are one, the first; the others are told as spans.

    known: broadcast of the repeated anchors, the hot ones, the repeated longer ones (null: all), and those to spread.
    """

    def run(batches):
        spans, seen, size = Spans(), {}, 0
        repeated, hot, second, wide = known.value
        wide = set(B.signed(wide).tolist())

        def flush():
            nonlocal seen, size
            rows = [(a, d, at, n, p, zlib.crc32(p) % 64 if a in wide else -1) for (a, p), (d, at, n) in seen.items()]
            seen, size = {}, 0
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], SCHEMA.field(j).type) for j in range(6)], schema=SCHEMA)

        for batch in batches:
            ids = B.column(batch, "doc_id").to_numpy()
            for lo, _, buf, off in B.chunks(B.column(batch, "text")):
                doc, h, at, count = anchors(buf, off)
                often = _member(h, hot)
                keep = np.flatnonzero(_member(h, repeated) & ~often)
                found = [x[keep] for x in (doc, h, at, count)]
                if often.any():
                    more = longer(buf, off, doc[often], at[often], count[often])
                    if second is not None:
                        more = [x[_member(more[1], second)] for x in more]
                    found = [np.concatenate(x) for x in zip(found, more, strict=True)]
                doc, h, at, count = found
                data = buf.tobytes()
                for a, d, p, n, base in zip(B.signed(h).tolist(), ids[lo + doc].tolist(), at.tolist(), count.tolist(), off[doc].tolist(), strict=True):
                    key = a, data[p : p + n + LENGTH - 1]
                    mine = d, p - base, n
                    old = seen.setdefault(key, mine)
                    if old is mine:
                        size += n + LENGTH
                        continue
                    if mine < old:
                        seen[key], mine = mine, old
                    spans.add(*mine)
            if spans.rows:
                yield spans.batch()
            if size > SEEN_BYTES:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, PIECE)


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _sort_shards(pieces: DataFrame) -> DataFrame:
    """Spans of the pieces' strings that have an earlier equal in the same shard; spans among the rows pass through.
    Spread pieces (salt 0 or above) also come out as single strings, the first of each shard, for merging."""

    def run(batches):
        spans, held, size = Spans(), [], 0
        group: dict[bytes, tuple[int, int, int]] = {}
        key, salted, out = None, False, []

        def close():
            """Ends an anchor's group: unlike pieces wait for the next suffix array."""
            nonlocal size
            if len(group) > 1 or salted:
                held.extend((d, at, n, p, key) for p, (d, at, n) in group.items())
                size += sum(map(len, group))
            group.clear()

        def sort():
            nonlocal size
            size = 0
            if not held:
                return
            for (d, at, _, p, (anchor, salt)), (later, _) in zip(held, again([x[:4] for x in held]), strict=True):
                for lo, hi in _runs(later):
                    spans.add(d, at + lo, hi - lo)
                if salt >= 0:  # the first of the shard's equal strings; its list is named by its salt
                    out.extend((d, at + i, p[i : i + LENGTH], salt) for i in np.flatnonzero(~later).tolist())
            held.clear()

        for batch in batches:
            told = B.column(batch, "piece").is_null()
            yield batch.filter(told)
            batch = batch.filter(pc.invert(told))
            cols = [B.column(batch, c).to_pylist() for c in ("anchor", "salt", "doc_id", "at", "starts", "piece")]
            for a, s, d, at, n, p in zip(*cols, strict=True):
                if (a, s) != key:
                    close()
                    if size >= SHARD_BYTES:
                        sort()
                    key, salted = (a, s), s >= 0
                mine = d, at, n
                old = group.setdefault(p, mine)
                if old is not mine:
                    if mine < old:
                        group[p], mine = mine, old
                    spans.add(*mine)
            if spans.rows:
                yield spans.batch()
            if out:
                yield first(out)
        close()
        sort()
        yield spans.batch()
        yield first(out)

    def first(out):
        batch = pa.RecordBatch.from_arrays([pa.array([r[3] for r in out], pa.int64()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([1] * len(out), pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.nulls(len(out), pa.int32())], schema=SCHEMA)
        out.clear()
        return batch

    return pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(run, PIECE)


def merge(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of sorted lists of strings with their places (strings, doc_id, at), no string twice in a list: doc_id and at of
    the strings that stand in several lists, but for the earliest of each. Each list is looked up by binary search in
    those merged so far."""
    again = [np.zeros((2, 0), np.int64)]
    text, doc, at = lists[0]
    for more, d, a in lists[1:]:
        place = np.searchsorted(text, more)
        same = np.flatnonzero(text[np.minimum(place, len(text) - 1)] == more) if len(text) else np.zeros(0, np.int64)
        mine = place[same]
        later = (d[same] > doc[mine]) | ((d[same] == doc[mine]) & (a[same] > at[mine]))
        again.append(np.where(later, (d[same], a[same]), (doc[mine], at[mine])))
        doc[mine], at[mine] = np.where(later, doc[mine], d[same]), np.where(later, at[mine], a[same])
        fresh = np.ones(len(more), bool)
        fresh[same] = False
        text, doc, at = (np.insert(x, place[fresh], y[fresh]) for x, y in ((text, more), (doc, d), (at, a)))
    return np.concatenate(again, axis=1)


def _merge(strings: DataFrame, n: int) -> DataFrame:
    """Spans of the n single strings of the shards' sorted lists that have an earlier equal in another list."""

    def run(batches):
        lists: dict[int, list] = {}
        for batch in batches:
            # a byte behind each string keeps numpy from dropping NULs
            p = np.array([x + b"\1" for x in B.column(batch, "piece").to_pylist()], f"S{LENGTH + 1}")
            shard, d, at = (B.column(batch, c).to_numpy() for c in ("anchor", "doc_id", "at"))
            for s in np.unique(shard).tolist():
                lists.setdefault(s, []).append((p[shard == s], d[shard == s], at[shard == s]))
        if lists:
            doc, at = merge([tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in lists.values()])
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(doc), pa.array(at), pa.array(np.ones(len(doc), np.int32)), pa.nulls(len(doc), pa.binary()), none.cast(pa.int32())], schema=SCHEMA)

    # a string is in a list once and in as many lists as there are shards at most, so ranges are even
    return strings.repartitionByRange(n // RANGE + 1, "piece").sortWithinPartitions("anchor", "piece").mapInArrow(run, PIECE)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text and removed array<struct<start, end>> of each row: the maximal runs of bytes that go, in order."""
    spark = prepare(docs.sparkSession)
    docs, name, known = keyed(docs.select("doc_id", "text"))
    known = known.where("text is not null")
    told = _documents(known)
    # only digests that repeat; written down, they stand as a shuffle of their own beside the rows, which Spark can split
    firsts = told.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c").checkpoint()
    copies = told.where(F.col("n") >= LENGTH).join(firsts, ["d1", "d2"]).where("doc_id <> first").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    unlike = keep_ids(known, copies, "doc_id", copies.count(), anti=True)
    counts = _counts(unlike)
    spread = 0
    if counts.count() <= SENT:
        share = spark.sparkContext.broadcast
        hot = _sorted(counts.where(F.col("n") > HOT))
        second, wide = np.zeros(0, B.U), np.zeros(0, B.U)
        if len(hot):
            more = _counts(unlike, share(hot))
            second = _sorted(more) if more.count() <= SENT else None
            wide = _sorted(more.where(F.col("n") > SPREAD))
        spread = len(wide)
        pieces = _pieces(unlike, share((_sorted(counts), hot, second, wide)))
    else:
        spread = counts.where(F.col("n") > SPREAD).count()
        pieces = _joined_pieces(unlike, counts)
    shards = _sort_shards(pieces)
    if spread:
        shards = shards.checkpoint()
        single = shards.where("piece is not null")
        shards = shards.where("piece is null").unionByName(_merge(single, single.count()))
    spans = shards.select("doc_id", "at", "starts")
    ranges = spans.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("starts") + (LENGTH - 1)).alias("end"))
    per_doc = ranges.unionByName(copies).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    return docs.join(per_doc.withColumnRenamed("doc_id", name), name, "left").select("doc_id", "text", "removed")


def _joined_pieces(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """_pieces for more repeated anchors than are sent out: places of anchors are joined with them, then with the texts."""
    places = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("starts", pa.int32())])

    def find(batches):
        for batch in batches:
            ids = B.column(batch, "doc_id").to_numpy()
            for lo, _, buf, off in B.chunks(B.column(batch, "text")):
                doc, h, at, count = anchors(buf, off)
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(h)), pa.array(ids[lo + doc]), pa.array(at - off[doc]), pa.array(count.astype(np.int32))], schema=places)

    def cut(batches):
        for batch in batches:
            out = []
            for text, own in zip(B.column(batch, "text").to_pylist(), B.column(batch, "own").to_pylist(), strict=True):
                data = text.encode()
                out += [(x["anchor"], x["doc_id"], x["at"], x["starts"], data[x["at"] : x["at"] + x["starts"] + LENGTH - 1], x["salt"]) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], SCHEMA.field(j).type) for j in range(6)], schema=SCHEMA)

    salt = F.when(F.col("n") > SPREAD, F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(-1).cast("int")
    found = docs.mapInArrow(find, "anchor long, doc_id long, at long, starts int").join(counts, "anchor").withColumn("salt", salt).drop("n")
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "doc_id", "at", "starts", "salt")).alias("own"))
    return docs.join(own, "doc_id").select("text", "own").mapInArrow(cut, PIECE)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of repeated()."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            rows, removed = [], B.column(batch, "removed").to_pylist()
            for lo, hi, buf, off in B.chunks(B.column(batch, "text"), 1 << 24):
                for i in range(hi - lo):
                    data, sha, at, gone, n = memoryview(buf[off[i] : off[i + 1]]), hashlib.sha256(), 0, 0, 0
                    for start, end in merged(removed[lo + i] or ()):
                        sha.update(data[at:start])
                        at, gone, n = end, gone + end - start, n + 1
                    sha.update(data[at:])
                    rows.append((len(data), gone, n, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), *(pa.array([r[j] for r in rows], schema.field(j + 1).type) for j in range(4))], schema=schema)

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def merged(ranges) -> Iterator[tuple[int, int]]:
    """Maximal runs of sorted ranges {start, end} that overlap or touch."""
    last = None
    for x in ranges:
        if last and x["start"] <= last[1]:
            last = last[0], max(last[1], x["end"])
        else:
            if last:
                yield last
            last = x["start"], x["end"]
    if last:
        yield last
