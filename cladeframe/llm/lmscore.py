"""Cross-entropy difference of two n-gram models of one vocabulary.

The vocabulary has all words of all documents, the end of a text, and one unknown word. Both models, of the target
documents and of all others, are bigram models of the same form: exact counts of words and of pairs from every document,
each pair's estimate drawn to that of the word alone by PRIOR counts, and that to the even spread by one count for each
word; as every word is followed by another one or by the end, the estimates behind each word sum to 1. The model that a
document is part of scores it without the document's own counts. A document's score is the mean over its words and its
end of the target model's loss less the background model's: the lower, the more like the target. The first word stands
alone.

Words and pairs (grams) are told by hashes of 63 bits. Documents are dealt to parts. A part sends each of its distinct
grams once, with its counts, to the bucket of the gram's hash; a bucket sums the counts over all parts and answers each
part in the part's own order, and the part scores its documents. So no table of counts is gathered or broadcast, and
parts and buckets grow in number, not in size; what is sent grows with the grams. How many there are does not change
results. A first pass counts the distinct words and the sides' sizes.

Null texts and texts without words have no loss and a null score; unlabelled documents and ids without a document do
no harm; ids that repeat are scored row by row, and all rows of a target id are target documents; rows without an id
are background; without target documents that model is the even spread. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import BROADCAST_IDS, prepare

PRIOR = 20.0
#: What stands for the end of a text among the hashes of words.
END = B.U(0x3C6EF372FE94F82B)
#: Bytes of text in a part, and of text for which there is a bucket, about.
PART_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: Distinct words that a task holds before it passes them on, about.
HELD = 500_000

SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def packed(counts: np.ndarray) -> bytes:
    """Counts (2 x n) as planes of bytes, lowest first: small numbers leave planes of zeros, which compress well."""
    return np.ascontiguousarray(counts, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(2, -1)


class Grams:
    """The words of a part's rows in order, and its distinct grams; keys of words are odd, those of pairs even."""

    def __init__(self, table: pa.Table):
        held, rows = [], []
        self.count = np.zeros(len(table), np.int64)
        texts = table.column("text").combine_chunks()
        for lo, hi, buf, off in B.chunks(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts):
            words = B.Words(buf, off, B.ALNUM)
            full = np.flatnonzero(words.count)
            held.append(np.insert(words.hash, words.first[full + 1], END))
            rows.append(np.insert(words.doc, words.first[full + 1], full) + lo)
            self.count[lo:hi] = words.count
        own = np.concatenate(held) if held else np.zeros(0, B.U)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.at = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1  # words that follow another one in their text
        pairs = B.mix(own[self.at - 1] * B.U(0xD6E8FEB86659FD93) + own[self.at])
        self.keys, place = np.unique(np.concatenate((own | B.U(1), pairs & ~B.U(1))), return_inverse=True)
        self.word, self.pair = place[: len(own)], place[len(own) :]

    def own(self, place: np.ndarray, row: np.ndarray) -> np.ndarray:
        """For each of some grams, how often it stands among those of its own row."""
        _, at, n = np.unique(row * np.int64(len(self.keys)) + place, return_inverse=True, return_counts=True)
        return n[at]

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin; buckets are ranges of hashes."""
        bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], B.U)
        return np.concatenate(([0], np.searchsorted(self.keys, bounds), [len(self.keys)]))


def alone(ones, total, vocabulary):
    """Estimate of a word by its count, the count of all, and the number of unlike words (one more is unknown)."""
    return (ones + 1.0) / (total + vocabulary + 1)


def behind(pairs, before, p):
    """Estimate of a word behind another one by the counts of the pair and of the other, and its estimate alone."""
    return (pairs + PRIOR * p) / (before + PRIOR)


def _send(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        g = Grams(table)
        target = table.column("target").to_numpy().astype(np.int64)[g.row]
        n = len(g.keys)
        both = np.bincount(target * n + g.word, minlength=2 * n) + np.bincount(target[g.at] * n + g.pair, minlength=2 * n)
        both, cuts, part = both.reshape(2, -1), g.cuts(buckets), table.column("part")[0].as_py()
        spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        return pa.Table.from_arrays([pa.array([i for i, *_ in spans], pa.int32()), pa.array([part] * len(spans), pa.int32()), pa.array([g.keys[a:b].tobytes() for _, a, b in spans], pa.binary()), pa.array([packed(both[:, a:b]) for _, a, b in spans], pa.binary())], schema=SENT)

    return run


def _sum(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, B.U) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()], axis=1)
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((2, len(every)), np.int64)
    for side in (0, 1):
        np.add.at(sums[side], place, counts[side])
    ends = np.cumsum([len(k) for k in keys])
    back = [packed(sums[:, place[e - len(k) : e]]) for k, e in zip(keys, ends.tolist(), strict=True)]
    return pa.Table.from_arrays([table.column("part"), table.column("bucket"), pa.array(back, pa.binary())], schema=ANSWER)


def _totals(docs: DataFrame) -> tuple[int, int, int]:
    """Number of distinct words (the end among them), and of words and ends in the background and in the target."""
    schema = pa.schema([("word", pa.int64()), ("background", pa.int64()), ("target", pa.int64())])

    def told(held: list[np.ndarray], sides: np.ndarray) -> pa.RecordBatch:
        words = pa.array(B.signed(np.unique(np.concatenate(held)))) if held else pa.nulls(0, pa.int64())
        none = pa.nulls(len(words), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(1, pa.int64())]), *(pa.concat_arrays([none, pa.array([n], pa.int64())]) for n in sides.tolist())], schema=schema)

    def run(batches):
        held, size, sides = [], 0, np.zeros(2, np.int64)
        for batch in batches:
            target = B.column(batch, "target").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
                words = B.Words(buf, off, B.ALNUM)
                if len(words.hash):
                    held.append(np.unique(np.append(words.hash, END) | B.U(1)))
                    size += len(held[-1])
                    sides += np.bincount(target[lo:hi], words.count + (words.count > 0), 2).astype(np.int64)
            if size > HELD:
                yield told(held, sides)
                held, size, sides = [], 0, np.zeros(2, np.int64)
        yield told(held, sides)

    rows = docs.select("text", "target").mapInArrow(run, "word long, background long, target long")
    return tuple(x or 0 for x in rows.agg(F.count_distinct("word"), F.sum("background"), F.sum("target")).first())


def _score(table: pa.Table, answers: pa.Table, vocabulary: int, totals: tuple[int, int]) -> pa.Table:
    g, n = Grams(table), len(table)
    if not n:
        return SCORES.empty_table()
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    counts = np.concatenate([np.zeros((2, 0), np.int64), *(unpacked(r[1]) for r in rows)], axis=1)
    none, losses = g.count == 0, []
    target = table.column("target").to_numpy().astype(np.int64)[g.row]
    own, own_pairs, length = g.own(g.word, g.row), g.own(g.pair, g.row[g.at]), np.bincount(g.row, minlength=n)
    for side in (1, 0):
        mine = (target == side).astype(np.int64)  # a document is not scored by its own counts
        ones, pairs = counts[side][g.word] - own * mine, counts[side][g.pair] - own_pairs * mine[g.at]
        p = alone(ones, totals[side] - length[g.row] * mine, vocabulary)
        p[g.at] = behind(pairs, ones[g.at - 1], p[g.at])
        losses.append(np.bincount(g.row, -np.log(p), n) / np.maximum(length, 1))
    t, b = losses
    return pa.Table.from_arrays([table.column("doc_id"), pa.array(g.count), *(pa.array(x, mask=none) for x in (t, b, t - b))], schema=SCORES)


def scores(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score of each row; target_ids (doc_id) names the target documents."""
    prepare(docs.sparkSession)
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts, buckets = (int(size // b) + 1 for b in (PART_BYTES, BUCKET_BYTES))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    docs = docs.join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"), part.alias("part"))
    vocabulary, *totals = _totals(docs)
    # the part is told by the row alone, so both readings of the texts make the same parts
    dealt = docs.repartition(parts, "part")
    sent = dealt.groupBy("part").applyInArrow(_send(buckets), "bucket int, part int, keys binary, counts binary").repartition(buckets, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_sum, "part int, bucket int, counts binary").repartition(parts, "part")
    score = lambda table, found: _score(table, found, vocabulary, totals)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, score double")
