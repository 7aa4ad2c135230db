"""Benchmark decontamination by winnowing.

Runs of K words (grams) are hashed. A window of WINDOW words has W grams, the least of which is its fingerprint: windows
with equal words have equal fingerprints, and neighbouring windows mostly share one. Fingerprints of both sides are
joined; what they hit is extended to all windows of the document that have the fingerprint, whose words are compared
by digests of 128 bits. Items of fewer words are one window, and the gram of their length is its fingerprint.

The fingerprints of the benchmark go to each executor as sorted numbers if they are few (SENT, counted); more of them
are joined with the documents' by a shuffle. Windows of both sides are always joined by Spark, so no text of the
benchmark goes through the driver. Both ways give the same rows.

Items without words match nothing, nulls have no words, items with equal words all count, a document may be empty or
of any length; an empty benchmark hits nothing, an empty table gives no rows. Ids of documents may be null or repeat:
each row is answered by its own text. Items of one id are one item that has the windows of all its texts; items without
an id are none. Other columns of either table are ignored, and those of documents kept by clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import BROADCAST_IDS, free, prepare

WINDOW, K = 10, 6
W = WINDOW - K + 1
#: Fingerprints of the benchmark that are sent to each executor at most, windows, and ids of documents to remove.
SENT, SENT_WINDOWS, SENT_ROWS = BROADCAST_IDS, 200_000, 1_000_000

#: Windows that start one after the other and have one fingerprint: print, first word, number, size in words.
FOUND = pa.schema([("print", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("size", pa.int32())])


def fingerprints(words: B.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of each group of neighbouring windows of WINDOW words with one and the same least gram, the first
    word of the group's first window, and the number of its windows."""
    at, h = words.grams(K)
    n = len(h) - W + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(B.U), none, none
    least, place = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, W):
        less = h[j : j + n] < least
        least[less], place[less] = h[j : j + n][less], j
    whole = np.flatnonzero((at[W - 1 :] - at[:n] == W - 1) & (words.doc[at[:n]] == words.doc[at[W - 1 :]]))
    if not len(whole):
        return none.view(B.U), none, none
    least, gram, start = least[whole], at[whole] + place[whole], at[whole]
    new = np.ones(len(start), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return least[first], start[first], np.diff(np.append(first, len(start)))


def short_prints(words: B.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each run of size words; runs of unlike sizes are told apart."""
    at, h = words.grams(size)
    return at, B.mix(h + B.U(size))


def _low(words: B.Words, buf: np.ndarray) -> bytes:
    return B.LOWER[buf].tobytes()


def window_digest(low: bytes, words: B.Words, start: int, size: int) -> bytes:
    return hashlib.blake2b(b" ".join([low[words.start[j] : words.end[j]] for j in range(start, start + size)]), digest_size=16).digest()


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(print, d1, d2, size, k1, k2, n), the distinct windows of the items, with their fingerprint, digest and kind: that
    of the set of the n items which have it, by 128 bits; and (k1, k2, n, item_id), the items of each kind.

    No list of items is ever one row: a window that all items have is as many rows here, and its kind is a sum.
    """
    schema = pa.schema([("item_id", pa.string()), ("print", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("size", pa.int32())])

    def run(batches):
        for batch in batches:
            ids = B.column(batch, "item_id").to_pylist()
            for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
                words = B.Words(buf, off, B.ALNUM)
                low, out = _low(words, buf), []
                for p, start, count in zip(*fingerprints(words), strict=True):
                    out += [(int(words.doc[start]), p, s, WINDOW) for s in range(start, start + count)]
                for size in range(1, WINDOW):
                    mine = set(np.flatnonzero(words.count == size).tolist())
                    if mine:
                        out += [(int(words.doc[s]), p, s, size) for s, p in zip(*short_prints(words, size), strict=True) if int(words.doc[s]) in mine]
                digests = np.frombuffer(b"".join(window_digest(low, words, s, n) for _, _, s, n in out), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo + i] for i, *_ in out], pa.string()), pa.array(np.array([x[1] for x in out], B.U).view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([x[3] for x in out], pa.int32())], schema=schema
                )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null and item_id is not null")
    each = items.mapInArrow(run, "item_id string, print long, d1 long, d2 long, size int").distinct().checkpoint()
    kind = [F.bit_xor(F.xxhash64(F.lit(salt), "item_id")).alias(f"k{salt}") for salt in (1, 2)]
    known = each.groupBy("print", "d1", "d2", "size").agg(*kind, F.count("*").alias("n")).checkpoint()
    # one window stands for all of its kind
    one = known.groupBy("k1", "k2", "n").agg(F.min(F.struct("print", "d1", "d2", "size")).alias("w")).select("k1", "k2", "n", "w.*")
    return known, one.join(each, ["print", "d1", "d2", "size"]).select("k1", "k2", "n", "item_id")


def _prints(known: DataFrame) -> dict[int, np.ndarray]:
    """Sorted fingerprints of each size of windows: SENT numbers at most, packed on their way to the driver."""

    def run(batches):
        for batch in batches:
            sizes, prints = B.column(batch, "size").to_numpy(), B.column(batch, "print").to_numpy()
            for size in np.unique(sizes):
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([prints[sizes == size].tobytes()], pa.binary())], names=["size", "prints"])

    out: dict[int, list[bytes]] = {}
    for row in known.select("size", "print").distinct().mapInArrow(run, "size int, prints binary").collect():
        out.setdefault(row["size"], []).append(bytes(row["prints"]))
    return {size: np.sort(np.frombuffer(b"".join(parts), B.U)) for size, parts in out.items()}


def candidates(words: B.Words, sizes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of windows: size, fingerprints, first words of the first window, numbers of windows."""
    for size in sizes:
        if size == WINDOW:
            yield size, *fingerprints(words)
        else:
            at, h = short_prints(words, size)
            yield size, h, at, np.ones(len(at), np.int64)


ROWS = "doc_id long, digest long, n_words long"
WINDOWS = "array<struct<start:int,size:int,d1:long,d2:long>>"


def _windows(words: B.Words, buf: np.ndarray, rows: int, found: list[tuple[int, int, int]]) -> list[list[dict]]:
    """For each text its windows (start, count, size) of found, one by one, with starts within the text."""
    out: list[list[dict]] = [[] for _ in range(rows)]
    low = _low(words, buf) if found else b""
    for start, count, size in found:
        doc = int(words.doc[start])
        for s in range(start, start + count):
            d1, d2 = np.frombuffer(window_digest(low, words, s, size), np.int64).tolist()
            out[doc].append({"start": s - int(words.first[doc]), "size": size, "d1": d1, "d2": d2})
    return out


def _scan(docs: DataFrame, prints: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, digest, n_words and the windows whose fingerprint is among prints, of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(prints)
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("windows", kinds)])

    def run(batches):
        known = shared.value
        for batch in batches:
            ids, digests = B.column(batch, "doc_id"), B.column(batch, "digest")
            for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
                words = B.Words(buf, off, B.ALNUM)
                found = []
                for size, h, start, count in candidates(words, known):
                    keep = member(h, known[size])
                    found += [(int(s), int(c), size) for s, c in zip(start[keep], count[keep], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), digests.slice(lo, hi - lo), pa.array(words.count), pa.array(_windows(words, buf, hi - lo, found), kinds)], schema=schema)

    return docs.mapInArrow(run, f"{ROWS}, windows {WINDOWS}")


def _joined(docs: DataFrame, known: DataFrame) -> DataFrame:
    """_scan for more fingerprints than are sent out: the documents' are joined with them, then with their texts."""
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # WINDOW rows at most
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), *FOUND])

    def find(batches):
        for batch in batches:
            ids, digests = B.column(batch, "doc_id"), B.column(batch, "digest")
            for lo, _, buf, off in B.chunks(B.column(batch, "text")):
                words = B.Words(buf, off, B.ALNUM)
                for size, h, start, count in candidates(words, sizes):
                    doc = words.doc[start]
                    rows = pa.array(lo + doc)
                    yield pa.RecordBatch.from_arrays([ids.take(rows), digests.take(rows), pa.array(B.signed(h)), *(pa.array(x.astype(np.int32)) for x in (start - words.first[doc], count, np.full(len(doc), size)))], schema=schema)

    def cut(batches):
        for batch in batches:
            places = B.column(batch, "places").to_pylist()
            out = []
            counts = []
            for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
                words = B.Words(buf, off, B.ALNUM)
                found = [(int(words.first[i]) + x["start"], x["count"], x["size"]) for i in range(hi - lo) for x in places[lo + i] or ()]
                out += _windows(words, buf, hi - lo, found)
                counts.append(words.count)
            ids = [B.column(batch, c) for c in ("doc_id", "digest")]
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)), pa.array(out, kinds)], names=["doc_id", "digest", "n_words", "windows"])

    found = docs.mapInArrow(find, "doc_id long, digest long, print long, start int, count int, size int")
    met = found.join(known.select("print", "size").distinct(), ["print", "size"], "left_semi")
    places = met.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "count", "size")).alias("places"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    return docs.alias("a").join(places.alias("b"), same, "left").select("a.doc_id", "a.digest", "a.text", "b.places").mapInArrow(cut, f"{ROWS}, windows {WINDOWS}")


def runs_of(windows) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of words that the windows (start, size) cover; runs that touch are one."""
    starts, ends = [], []
    for start, size in sorted(windows):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], start + size)
        else:
            starts.append(start)
            ends.append(start + size)
    return starts, ends


def member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array known."""
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _met(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs (doc_id, digest of the text, n_words, windows with the fingerprint of one of the benchmark's);
    the windows (doc_id, digest, start, size, k1, k2, n) that are the benchmark's; the items of each kind of windows."""
    prepare(docs.sparkSession)
    known, kinds = benchmark_windows(benchmark)
    prints, windows = known.agg(F.count_distinct("size", "print"), F.count("*")).first()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    told = (_scan(docs, _prints(known)) if prints <= SENT else _joined(docs, known)).checkpoint()
    each = told.where("size(windows) > 0").select("doc_id", "digest", F.explode("windows").alias("w")).select("doc_id", "digest", "w.*").distinct()
    known = known.drop("print")
    return told, each.join(F.broadcast(known) if windows <= SENT_WINDOWS else known, ["d1", "d2", "size"]), kinds


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_words, hit_start, hit_end, items of each row of docs.

    A document's kinds of windows are made distinct before their items are looked up, and its items before they are
    listed, so that a passage which many items share costs each document its items once.
    """
    told, met, kinds = _met(docs, benchmark)
    items = met.select("doc_id", "digest", "k1", "k2", "n").distinct().join(kinds, ["k1", "k2", "n"]).select("doc_id", "digest", "item_id").distinct()
    both = met.select("doc_id", "digest", F.struct("start", "size").alias("window"), F.lit(None).cast("string").alias("item_id"))
    both = both.unionByName(items.withColumn("window", F.lit(None).cast("struct<start:int,size:int>")))
    own = both.groupBy("doc_id", "digest").agg(F.collect_list("window").alias("windows"), F.array_sort(F.collect_list("item_id")).alias("items"))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("hit_start", pa.list_(pa.int64())), ("hit_end", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            spans = [runs_of([(w["start"], w["size"]) for w in x]) for x in B.column(batch, "windows").to_pylist()]
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), B.column(batch, "digest"), *(pa.array([s[j] for s in spans], schema.field(2 + j).type) for j in (0, 1)), B.column(batch, "items").cast(pa.list_(pa.string()))], schema=schema)

    own = own.mapInArrow(run, "doc_id long, digest long, hit_start array<long>, hit_end array<long>, items array<string>")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    hit = told.where("size(windows) > 0").alias("a").join(own.alias("b"), same, "left").select("a.doc_id", "a.digest", "n_words", *(F.coalesce(f"b.{c}", F.array().cast(t)).alias(c) for c, t in (("hit_start", "array<long>"), ("hit_end", "array<long>"), ("items", "array<string>"))))
    rest = told.where("size(windows) = 0").select("doc_id", "digest", "n_words", F.array().cast("array<long>").alias("hit_start"), F.array().cast("array<long>").alias("hit_end"), F.array().cast("array<string>").alias("items"))
    return hit.unionByName(rest)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, maximal runs of hit words [hit_start, hit_end), ids of the items."""
    return _hits(docs, benchmark).select("doc_id", "n_words", "hit_start", "hit_end", "items")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of hits()."""
    n_hit = F.aggregate(F.zip_with("hit_start", "hit_end", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item; each row by its own text."""
    bad = _met(docs, benchmark)[1].select("doc_id", "digest").distinct().checkpoint()
    bad = F.broadcast(bad) if bad.count() <= SENT_ROWS else bad
    digest = free(docs.columns, "__digest")
    told = docs.withColumn(digest, F.xxhash64("text")).alias("a")
    same = F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{digest}") == F.col("b.digest"))
    return told.join(bad.alias("b"), same, "left_anti").drop(digest)
