"""Substring dedup by hashing lines and sentences.

A text falls into units: a unit ends behind a line feed, or behind the blank that follows a full stop, exclamation or
question mark. A unit is normalised to its lower-cased words (runs of ASCII letters and digits and of characters beyond
ASCII), whose digests of 128 bits are grouped over all documents. Of the units with one digest the earliest by
(doc_id, offset) stays; the others are repeats. Repeats go in runs: neighbouring repeats (units without words between
them do not count) that have LEAST_WORDS words or more together are removed, whatever the length of each. So a short
unit that a text has in common with others by chance stays, and one inside a repeated passage goes. Offsets are those
of the original text in UTF-8 bytes.

Units without words always stay. Null texts have no units; a text may lose all of them and is empty then; rows without
an id lose nothing; rows with one id are told apart by their texts, in the order of a hash of them, and rows equal in id
and text are one document, whose answer all of them get; an empty table gives no rows; other columns, whatever their
names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytewise as B
from .common import free, keyed, prepare

#: Words that a run of neighbouring repeated units has at least if it is removed.
LEAST_WORDS = 20


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, start and end of each unit in the buffer."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    stop = (buf == 46) | (buf == 33) | (buf == 63)
    cut = buf == 10
    cut[1:] |= (buf[1:] == 32) & stop[:-1]
    # the blank and the mark must be of one text
    first = off[:-1][off[1:] > off[:-1]]
    cut[first] = buf[first] == 10
    ends = np.union1d(np.flatnonzero(cut) + 1, off[1:][off[1:] > 0])
    starts = np.concatenate(([0], ends[:-1]))
    return np.searchsorted(off, starts, "right") - 1, starts, ends


def _units(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, start, size, place, words) of each unit with words; place counts those of a document."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int32()) for c in ("start", "size", "place", "words"))])

    def run(batches):
        for batch in batches:
            ids = B.column(batch, "doc_id").to_numpy()
            for lo, _, buf, off in B.chunks(B.column(batch, "text")):
                words = B.Words(buf, off, B.ALNUM)
                doc, start, end = spans(buf, off)
                a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
                keep = b > a
                doc, start, end, a, b = doc[keep], start[keep], end[keep], a[keep], b[keep]
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                ints = (x.astype(np.int32) for x in (start - off[doc], end - start, place, b - a))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (B.signed(words.run_hash(a, b)), B.signed(words.run_hash(a, b, 0x5851F42D4C957F2D)), ids[lo + doc], *ints))], schema=schema)

    return docs.where("text is not null").mapInArrow(run, "h1 long, h2 long, doc_id long, start int, size int, place int, words int")


def repeated(docs: DataFrame, name: str = "removed") -> DataFrame:
    """docs with all its columns and removed array<struct<start, end>>: the units that go, in order; null without any.
    A column of that name is replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(name)
    rows, key, known = keyed(docs)
    units = _units(known)
    many = units.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "kept")
    # written down, it stands as a shuffle of its own beside the units, whose frequent digests Spark can split then
    many = many.checkpoint()
    gone = units.join(many, ["h1", "h2"]).where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("start") != F.col("kept.start")))
    # neighbours have one difference of place and rank; all of it in the order of one shuffle by document
    gone = gone.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    gone = gone.withColumn("together", F.sum("words").over(Window.partitionBy("doc_id", "run"))).where(F.col("together") >= LEAST_WORDS)
    gone = gone.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end")))).alias(name))
    return rows.join(gone, key, "left").select(*docs.columns, name)


def _kept(batch: pa.RecordBatch, name: str = "removed") -> Iterator[tuple[int, int, int, str]]:
    """Count of units, units removed, bytes removed, text that stays, of each row."""
    removed = B.column(batch, name).to_pylist()
    for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
        doc, _, _ = spans(buf, off)
        count = np.bincount(doc, minlength=hi - lo)
        for i in range(hi - lo):
            data, out, at, n = bytes(buf[off[i] : off[i + 1]]), [], 0, 0
            for x in removed[lo + i] or ():
                out.append(data[at : x["start"]])
                at = x["end"]
                n += x["end"] - x["start"]
            yield int(count[i]), len(removed[lo + i] or ()), n, (b"".join(out) + data[at:]).decode()


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_units, n_removed_units, n_removed (bytes) and kept_text of each row of repeated(); null text: empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed_units", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            rows = list(_kept(batch))
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), *(pa.array([r[j] for r in rows], schema.field(j + 1).type) for j in range(4))], schema=schema)

    return found.select("doc_id", "text", "removed").mapInArrow(run, "doc_id long, n_units long, n_removed_units long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated units cut from text, n_chars (if there is one) counted anew; texts cut to nothing go."""
    name = free(docs.columns, "__removed")
    found = repeated(docs, name)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else r[3] for t, r in zip(B.column(batch, "text").to_pylist(), _kept(batch, name), strict=True)]
            keep = pa.array([bool(t) or not r for t, r in zip(texts, B.column(batch, name).to_pylist(), strict=True)])
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(keep)

    out = found.mapInArrow(run, found.schema).drop(name)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
