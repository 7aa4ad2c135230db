"""Groups of spelling variants by anagram hashing.

Words are maximal runs of the letters A to Z, a to z and U+00C0 to U+00FF, with A to Z in lower case. A word's key is the
sum of a power of each of its letters, whatever their order, so keys of words that differ by one letter added, removed
or exchanged differ by one letter's value, or by two letters' values. Such words meet in the key that is left when the
letter's value is taken away: each word is listed under its own key, and under its key less the value of each of its
letters. What meets is verified by the order of the letters that are left, which is part of what Spark groups by, so
anagrams of each other never make pairs: a word and a place have as many partners as there are letters, at most.
Near words are counted, and the most frequent one is found, by window functions over these groups.

The letters left are compared as they are in words of up to EXACT letters, and by two sums of 31 bits each (beside the
key of 64 bits) in longer ones, so that a very long word makes rows of fixed size, one for each of its letters.

Null texts and texts without letters have no words; a null id counts as an empty one; repeated rows count each time; an
empty table gives no rows; other columns are not looked at. A text is read in slices, whatever its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytewise as B
from .common import prepare, stored

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Letters of a word up to which what is left of it is compared letter by letter.
EXACT = 64
#: Bytes of a text read at once, and words that a task counts before it hands its counts on.
SLICE, HELD = 1 << 20, 200_000
#: The power of a letter's code that its value is.
POWER = 5

# U+00C0 to U+00FF are C3 80 to C3 BF in UTF-8
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
_LOWER = bytes(B.LOWER)
_VALUES = np.array([pow(c, POWER) for c in range(256)], np.uint64)
_PRIMES = ((2147483647, 48271), (2147483629, 40692))


def runs(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the runs of letters of a text, slice by slice; no run is cut."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + SLICE, n)
        if end < n:
            end += text[end] & 0xC0 == 0x80
            if m := _LETTERS.match(text, end):
                end = m.end()
        yield _LETTERS.findall(text, at, end)
        at = end


def damaged(run: bytes, told: int) -> bytes:
    """run without its letter at told modulo its length."""
    letters = run.decode()
    at = told % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, damage: int | None = None) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) of so many letters at least, and how often they occur. damage: runs
    whose CRC-32, of id, colon and run, it divides lose the letter at that number modulo their length first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            texts = B.column(batch, "text")
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for doc, text in zip(B.column(batch, "doc_id").to_pylist(), texts, strict=True):
                began = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found in runs((text.as_py() or b"").translate(_LOWER)):
                    for word, n in Counter(found).items():
                        if len(word) < least_letters:
                            continue
                        if damage and (told := zlib.crc32(word, began)) % damage == 0:
                            word = damaged(word, told)
                        if len(word) >= least_letters and (word.isascii() or len(word.decode()) >= least_letters):
                            held[word] += n
                    if len(held) > HELD:
                        yield out(held)
                        held.clear()
        if held:
            yield out(held)

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _left(word: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """The sum of the values of a word (Latin-1), and for no letter taken away and for each: the key and what is left."""
    codes = np.frombuffer(word, np.uint8)
    key = _VALUES[codes].sum()
    keys = np.concatenate(([key], key - _VALUES[codes])).view(np.int64).tolist()
    if len(word) <= EXACT:
        return list(zip(keys, [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))], strict=True))
    parts = []
    for prime, base in _PRIMES:
        # base ** i by doubling; sums of numbers below 2 ** 31 stay exact for 2 ** 32 letters
        powers = np.ones(len(word) + 1, np.uint64)
        size, step = 1, base
        while size <= len(word):
            powers[size : 2 * size] = powers[:size][: len(powers) - size] * np.uint64(step) % np.uint64(prime)
            size, step = 2 * size, step * step % prime
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(prime)))) % np.uint64(prime)
        after = (sums[-1] + np.uint64(prime) - sums[1:]) % np.uint64(prime) * np.uint64(pow(base, -1, prime)) % np.uint64(prime)
        parts.append(np.concatenate((sums[-1:], (sums[:-1] + after) % np.uint64(prime))))
    size = np.full(len(word) + 1, len(word) - 1, np.uint64)
    size[0] += np.uint64(1)
    told = np.stack([*parts, size], 1)
    return list(zip(keys, (b"\0" + x.tobytes() for x in told), strict=True))


def _listed(words: DataFrame) -> DataFrame:
    """(key, rest, place, first, id, n): each word under its own key (place -1) and less each letter; first: the letter
    is the first of equal neighbours, so that what is left without it is listed once."""
    schema = pa.schema([("key", pa.int64()), ("rest", pa.binary()), ("place", pa.int32()), ("first", pa.bool_()), ("id", pa.int64()), ("n", pa.int64())])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        rows = []
        for batch in batches:
            for number, word, n in zip(*(B.column(batch, c).to_pylist() for c in ("id", "word", "n")), strict=True):
                word = word.encode("latin-1")
                for place, (key, rest) in enumerate(_left(word), -1):
                    rows.append((key, rest, place, place < 1 or word[place] != word[place - 1], number, n))
                    if len(rows) >= 50_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return words.select("id", "word", "n").mapInArrow(run, "key long, rest binary, place int, first boolean, id long, n long")


def near(words: DataFrame) -> DataFrame:
    """(id, n_near, best struct<n, id>) of words (id, word, n), each word once, with ids in the order of the words: how
    many others differ by one letter, and the most frequent of these, the first one of equally frequent ones. Words
    without near ones are left out."""
    listed = _listed(words).withColumn("own", F.struct("n", (-F.col("id")).alias("back")))
    group, order = Window.partitionBy("key", "rest"), Window.partitionBy("key", "rest", "place").orderBy(F.desc("n"), "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = (F.col("place") >= 0) & F.col("first")
    met = listed.withColumns(
        {
            "exchanged": F.count("*").over(whole) - 1, "most": F.first("own").over(whole), "second": F.nth_value("own", 2).over(whole),
            "shorter": F.max(F.when(F.col("place") < 0, F.col("own"))).over(group), "longer": F.max(F.when(taken, F.col("own"))).over(group), "n_longer": F.count_if(taken).over(group),
        }
    )
    other = F.when(F.col("most.back") == -F.col("id"), F.col("second")).otherwise(F.col("most"))
    by_removal = F.when(F.col("first"), F.col("shorter"))
    found = met.select(
        "id",
        F.when(F.col("place") < 0, F.col("n_longer")).otherwise(F.col("exchanged") + by_removal.isNotNull().cast("long")).alias("n_near"),
        F.when(F.col("place") < 0, F.col("longer")).otherwise(F.greatest(other, by_removal)).alias("best"),
    )
    found = found.where("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", F.struct(F.col("best.n").alias("n"), (-F.col("best.back")).alias("id")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, up), which hold no circle: where the links end. Each round doubles what is followed."""
    now = stored(links.select("id", F.col("up").alias("root")), "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.select("id", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int | None = None, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs (doc_id, text) with so many letters and occurrences.

    form is the most frequent near word if it occurs ratio times as often as the word at least, root the word where the
    forms end, as each is more frequent than the one before (ratio above 1); form and form_n are null without one.
    """
    prepare(docs.sparkSession)
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could run in circles")
    counts = word_counts(docs, least_letters, damage).where(F.col("n") >= least_count)
    words = stored(counts.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    told = stored(words.join(near(words), "id", "left").withColumn("up", F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best.id"))), "near")
    ends = roots(told.where("up is not null").select("id", "up"))
    name = lambda key, out: words.select(F.col("id").alias(key), F.col("word").alias(out))
    rows = told.join(ends, "id", "left").join(name("up", "form"), "up", "left").join(name("root", "last"), "root", "left")
    return rows.select("word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("up").isNotNull(), F.col("best.n")).alias("form_n"))
