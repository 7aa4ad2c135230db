"""Strings of A, C, G, T as numbers: two bits a letter, 32 letters a long, counted from the right end.

A string is the columns w0, w1, ... and n, its length. w0 holds its last 32 letters, the very last in the highest bits,
w1 those before, and so on; what a string lacks is zero. The highest bit is turned, so that Spark's signed order of
(w0, w1, ..., n) is the order of the strings read from their right ends, a shorter one before those that go on. All
strings that end with the same k letters so stand in one range, and share w0, w1, ... under a mask.

The numbers are made by numpy in tasks that Spark deals pieces of the sequences to; masks, joins, groups and sorts are
Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ship import ship

LETTERS = 32
#: Letters of the pieces that sequences are dealt out by, and letters that a task works on at once.
PIECE, CHUNK = 1 << 15, 1 << 18
LOW = -(1 << 63)
#: Letters up to which a string, its length and a place below 2^PLACE_BITS are one number; rows that a task merges at once.
SHORT, PLACE_BITS, MERGED = 14, 30, 1 << 21
#: Letters up to which a task has a table with a place for each string.
TABLED = 10
#: Letters up to which a window and a place are one number.
MERGED_PAIRS = (64 - PLACE_BITS) // 2

CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    CODES[_c] = CODES[_c + 32] = _i
_UPPER = np.frombuffer(b"ACGT", np.uint8)
#: The highest 2 * m bits.
MASKS = np.array([0, *((1 << 64) - (1 << (64 - 2 * m)) for m in range(1, LETTERS + 1))], np.uint64)
_TURN = np.uint64(1 << 63)


def columns(s: int) -> list[str]:
    return [f"w{i}" for i in range(-(-s // LETTERS))]


def shortened(k: int) -> dict[str, Column]:
    """The columns of the last k letters of a string that has so many."""
    out = {c: F.col(c) for c in columns(k)}
    if k % LETTERS:
        last = columns(k)[-1]
        out[last] = F.col(last).bitwiseAND(F.lit(int(MASKS[k % LETTERS].astype(np.int64))))
    return out


def pack(mer: Column, s: int) -> dict[str, Column]:
    """The columns of a string of up to s letters."""
    digits = F.translate(F.reverse(mer), "ACGT", "0123")
    part = lambda i: F.rpad(F.substring(digits, LETTERS * i + 1, LETTERS), LETTERS, "0")
    return {c: (F.conv(part(i), 4, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long") for i, c in enumerate(columns(s))}


def _digits(half: Column) -> Column:
    """The 16 letters of the low 32 bits of a number as digits: each is moved to four bits of its own, which hex prints."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        half = half.bitwiseOR(F.shiftleft(half, by)).bitwiseAND(F.lit(mask))
    return F.lpad(F.hex(half), 16, "0")


def unpack(s: int, n: Column | int) -> Column:
    """The string of the columns of up to s letters and its length."""
    halves = []
    for i, c in enumerate(columns(s)):
        word = F.col(c).bitwiseXOR(F.lit(LOW))
        halves.append(_digits(F.shiftrightunsigned(word, 32)))
        if s - LETTERS * i > LETTERS // 2:
            halves.append(_digits(word.bitwiseAND(F.lit(0xFFFFFFFF))))
    whole = F.concat(*halves)
    return F.translate(F.reverse(F.substring(whole, F.lit(1), n if isinstance(n, Column) else F.lit(n))), "0123", "ACGT")


def cut_columns(df: DataFrame) -> list[str]:
    """The columns that make sequences pieces, if df has them."""
    return [c for c in ("offset", "lead", "own") if "lead" in df.columns]


def tasks_of(df: DataFrame) -> int:
    """To how many tasks what is made of df is dealt."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pieces(df: DataFrame, seq: str, before: int, after: int, tasks: int | None = None) -> DataFrame:
    """df with seq cut to pieces, dealt to all tasks, or to as many as are given: offset of the letters that are a piece's
    own, lead (letters before them, up to before), own (their number); up to after letters follow. Other characters count
    as one letter each. Sequences that have these columns are pieces already, and stay as they are."""
    ship(df.sparkSession)
    if "lead" in df.columns:
        return df.withColumn(seq, F.col(seq).cast("binary"))
    plain = F.when(F.octet_length(seq) == F.length(seq), F.col(seq)).otherwise(F.regexp_replace(seq, r"[^\x00-\x7F]", "N"))
    told = df.withColumn(seq, plain.cast("binary"))
    # no filter: one on the length would be worked out once more, below, by the planner
    cut = told.withColumn("offset", F.explode(F.when(F.length(seq) > 0, F.sequence(F.lit(0), F.length(seq) - 1, F.lit(PIECE)))))
    cut = cut.withColumns({"lead": F.least("offset", F.lit(before)), "own": F.least(F.lit(PIECE), F.length(seq) - F.col("offset"))})
    return cut.withColumn(seq, F.substring(seq, F.col("offset") - F.col("lead") + 1, F.col("lead") + F.col("own") + after)).repartition(tasks or tasks_of(df))


def _chunks(batch: pa.RecordBatch, seq: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, letters as codes, and offsets, of groups of rows of about CHUNK letters."""
    at = batch.column(batch.schema.get_field_index(seq))
    wide = pa.types.is_large_binary(at.type)
    _, where, data = at.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[at.offset : at.offset + len(at) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        yield slice(lo, hi), CODES[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
        lo = hi


def letters(df: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """df with seq in place of a text: its letters A, C, G and T in upper case, as kmers.bases() has them, taken out by
    numpy in the tasks that read the rows, so that no more than these letters is dealt out. Null stays null."""
    ship(df.sparkSession)
    others = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(seq, T.StringType())])

    def run(batches):
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(text))
            found, ends = [], [np.zeros(1, np.int64)]
            for _, codes, off in _chunks(batch, text):
                kept = np.flatnonzero(codes < 4)
                ends.append(ends[-1][-1] + np.searchsorted(kept, off[1:]))
                found.append(_UPPER[codes[kept]])
            taken = np.concatenate(found) if found else np.zeros(0, np.uint8)
            out = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(ends).astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())
            if at.null_count:
                out = pc.if_else(at.is_valid(), out, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), out], names=[*others, seq])

    return df.mapInArrow(run, schema)


def _rolled(codes: np.ndarray, s: int) -> np.ndarray:
    """For each place of codes, the last s letters at least (a power of two) as a number, the very last in its highest
    bits: 1, 2, 4, ... letters in the smallest numbers that hold them."""
    p, size = codes, 1
    while size < s:
        kind = (np.uint8, np.uint16, np.uint32, np.uint64)[max(4 * size // 8, 1).bit_length() - 1]
        longer = p.astype(kind)
        longer <<= kind(2 * size)
        longer[size:] |= p[: max(len(p) - size, 0)]
        p, size = longer, 2 * size
    return p


def ending(codes: np.ndarray, off: np.ndarray, s: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each place of texts that stand one after the other: the string that ends there, of s letters or as many as
    there are behind the last other character, as numbers without the mask of its length, and that length."""
    at = np.arange(len(codes), dtype=np.int32)
    last = np.repeat((off[:-1] - 1).astype(np.int32), np.diff(off))
    broken = np.flatnonzero(codes > 3)
    if len(broken):
        last[broken] = broken
        np.maximum.accumulate(last, out=last)
        codes = codes.copy()
        codes[broken] = 0
    n = np.minimum(at - last, s)
    p = _rolled(codes, LETTERS)
    words = []
    for i in range(len(columns(s))):
        word = np.zeros_like(p)
        word[LETTERS * i :] = p[: max(len(p) - LETTERS * i, 0)]
        words.append(word)
    return words, n


def common(one: list[np.ndarray], n_one: np.ndarray, two: list[np.ndarray], n_two: np.ndarray) -> np.ndarray:
    """How many last letters the strings of one and of two, as numbers, have in common, each with its own."""
    out, open_ = np.zeros(len(n_one), np.int64), np.ones(len(n_one), bool)
    for a, b in zip(one, two, strict=True):
        x = a ^ b
        # the place of the highest bit that differs, by halves, as doubles cannot tell all 64
        high, low = np.frexp((x >> np.uint64(32)).astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        zeros = np.where(high > 0, 32 - high, 64 - low)
        out += np.where(open_, zeros // 2, 0)
        open_ &= x == 0
    return np.minimum(out, np.minimum(n_one, n_two))


def alike(words: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """How many last letters each string and the one after it, as numbers, have in common."""
    return common([w[1:] for w in words], n[1:], [w[:-1] for w in words], n[:-1])


def keys(words: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Strings as bytes that are in their order, for searches in sorted ones."""
    table = np.empty((len(n), 8 * len(words) + 2), np.uint8)
    for i, w in enumerate(words):
        table[:, 8 * i : 8 * i + 8] = (w.view(np.uint64) ^ _TURN).astype(">u8").view(np.uint8).reshape(-1, 8)
    table[:, -2:] = n.astype(">u2").view(np.uint8).reshape(-1, 2)
    return table.view(f"S{table.shape[1]}").ravel()


def endings(words: list[np.ndarray], k: np.ndarray) -> list[np.ndarray]:
    """The last k letters of each string, as numbers; k one for each."""
    out = []
    for i, w in enumerate(words):
        mask = MASKS[np.clip(k - LETTERS * i, 0, LETTERS)]
        w = w.view(np.uint64)
        out.append(((w & mask) | (_TURN & ~mask)).view(np.int64))
    return out


def _masked(words: list[np.ndarray], n: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    n = n[rows]
    out = []
    for i, w in enumerate(words):
        w = w[rows]
        short = np.flatnonzero(n < LETTERS * (i + 1))
        w[short] &= MASKS[np.maximum(n[short] - LETTERS * i, 0)]
        w ^= _TURN
        out.append(pa.array(w.view(np.int64)))
    return out


def strings(sequences: DataFrame, s: int, forward_only: bool = False, whole: bool = False, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """(w0, ..., n, and tin if sequences have it): the string of s letters that ends at each letter of the runs of
    A, C, G, T of sequences (seq), or, nearer to the run's beginning, the shorter one from there; on both strands unless
    forward_only. whole: those of s letters only. then: what a task makes of its batches, by schema, before they leave it."""
    carried = [c for c in ("tin",) if c in sequences.columns]
    cut = pieces(sequences.select(*carried, "seq", *cut_columns(sequences)), "seq", s - 1, 0 if forward_only else s - 1)
    names = [*columns(s), "n", *carried]

    def run(batches):
        for batch in batches:
            lead, own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lead", "own"))
            tin = batch.column(batch.schema.get_field_index("tin")) if carried else None
            for rows, codes, off in _chunks(batch, "seq"):
                row = np.repeat(np.arange(rows.start, rows.stop), np.diff(off))
                place = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off))
                mine = (place >= lead[row]) & (place < lead[row] + own[row])
                for back in (False,) if forward_only else (False, True):
                    if back:
                        codes = np.where(codes > 3, codes, 3 - codes)[::-1]
                        off, mine, row = off[-1] - off[::-1], mine[::-1], row[::-1]
                    words, n = ending(codes, off, s)
                    took = np.flatnonzero(mine & (n >= (s if whole else 1)))
                    more = [tin.take(pa.array(row[took]))] if carried else []
                    yield pa.RecordBatch.from_arrays([*_masked(words, n, took), pa.array(n[took].astype(np.int32)), *more], names=names)

    if then is not None:
        return cut.mapInArrow(lambda batches: then(run(batches)), schema)
    return cut.mapInArrow(run, ", ".join([*(f"{c} long" for c in columns(s)), "n int", *(f"{c} int" for c in carried)]))


class _Table:
    """The least and greatest place of each string of up to s letters. A string is told by its number, the last letter in
    the highest bits, behind those of all shorter ones."""

    def __init__(self, s: int):
        self.base = [(4**n - 4) // 3 for n in range(s + 2)]  # of strings of n letters
        self.lo = np.full(self.base[s + 1], np.iinfo(np.int32).max, np.int32)
        self.hi = np.full(self.base[s + 1], -1, np.int32)

    def add(self, n: int, number: np.ndarray, place: np.ndarray) -> None:
        at = number.astype(np.int64) + self.base[n]
        for held, other, merge in ((self.lo, np.greater, np.minimum), (self.hi, np.less, np.maximum)):
            new = np.flatnonzero(other(held[at], place))  # few, after the first letters
            merge.at(held, at[new], place[new])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the strings of n letters that were added, with their places."""
        found = np.flatnonzero(self.hi[self.base[n] : self.base[n + 1]] >= 0)
        return found, self.lo[found + self.base[n]], self.hi[found + self.base[n]]

    def turn(self, n: int, other: _Table) -> None:
        """Add the reverse complements of the other's strings of n letters; it may be this table."""
        found, lo, hi = other.of(n)
        by = np.uint64(64 - 2 * n)
        at = (opposite([found.astype(np.uint64) << by], n)[0] >> by).astype(np.int64) + self.base[n]
        self.lo[at], self.hi[at] = np.minimum(self.lo[at], lo), np.maximum(self.hi[at], hi)


def _tabled(batches: Iterator[pa.RecordBatch], s: int, forward_only: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """(w0, n, lo, hi) of the strings() of a task's pieces (tin, seq, lead, own), each once; s is up to TABLED.

    Letters are read on one strand only. What the other one has is the reverse complement of all windows of s letters, and
    of the shorter strings before the end of a run."""
    tables: dict[bool, tuple[_Table, _Table]] = {}  # by whether there is a label: strings, and those of the other strand

    def add(other: bool, n: int, number: np.ndarray, tin: np.ndarray) -> None:
        for bare, some in ((False, tin >= 0), (True, tin < 0)) if unknown else ((False, slice(None)),):
            if bare not in tables:
                tables[bare] = _Table(s), _Table(s - 1)
            tables[bare][other].add(n, number[some], np.maximum(tin[some], 0) if bare else tin[some])

    for batch in batches:
        lead, own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lead", "own"))
        tins = batch.column(batch.schema.get_field_index("tin"))
        unknown, places = tins.null_count > 0, pc.fill_null(tins, -1).to_numpy()
        for rows, codes, off in _chunks(batch, "seq"):
            known = codes < 4
            begins, stops = known.copy(), known.copy()  # places with a letter behind which, or before which, there is none
            begins[1:] &= ~known[:-1]
            stops[:-1] &= ~known[1:]
            filled = np.diff(off) > 0
            for flags, ends in ((begins, off[:-1][filled]), (stops, off[1:][filled] - 1)):
                flags[ends] = known[ends]
            first, last = np.flatnonzero(begins), np.flatnonzero(stops)
            size = last - first + 1
            row = np.searchsorted(off, first, "right") - 1
            tin = places[rows][row]
            low = off[row] + lead[rows][row]  # the letters that are a piece's own
            high = low + own[rows][row]
            p = _rolled(codes & np.uint8(3), s)
            p = p >> p.dtype.type(2 * ((1 << (s - 1).bit_length()) - s))
            there = known
            for j in range(s - 1):
                there[first[size > j] + j] = False
            add(False, s, p[there], np.repeat(tin, np.maximum(size - (s - 1), 0)))
            for n in range(1, 1 if whole else s):
                cut, at = p.dtype.type(2 * (s - n)), first + n - 1
                some = (size >= n) & (at >= low) & (at < high)
                add(False, n, p[at[some]] >> cut, tin[some])
                if not forward_only:
                    at = last - (n - 1)
                    some = (size >= n) & (at >= low) & (at < high)
                    add(True, n, p[last[some]] >> cut, tin[some])
    for bare, (strings_, others) in tables.items():
        for n in range(s if whole else 1, s + 1):
            if not forward_only:
                strings_.turn(n, strings_ if n == s else others)
            found, lo, hi = strings_.of(n)
            for i in range(0, len(found), CHUNK):
                w = (found[i : i + CHUNK].astype(np.uint64) << np.uint64(64 - 2 * n)) ^ _TURN
                span = [pa.nulls(len(w), pa.int32())] * 2 if bare else [pa.array(x[i : i + CHUNK]) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), n, np.int32)), *span], names=["w0", "n", "lo", "hi"])


def _merged(batches: Iterator[pa.RecordBatch], most: int, lengths: bool) -> Iterator[pa.RecordBatch]:
    """(w0, n, lo, hi) of batches (w0, n, tin), each string once in a table of MERGED rows, sorted. Strings have up to most
    letters, so that they and a place are one number; lengths: and n, which is not part of the rows otherwise."""
    low, at = np.uint64((1 << PLACE_BITS) - 1), np.uint64(PLACE_BITS)
    names = ["w0", "n", "lo", "hi"] if lengths else ["w0", "lo", "hi"]

    def rows(held):
        """Batches of the strings of sorted keys."""
        key = held >> at
        first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key))[: len(first)] - 1
        for i in range(0, len(first), CHUNK):
            a, b = held[first[i : i + CHUNK]], held[last[i : i + CHUNK]]
            w = (a & MASKS[most]) ^ _TURN
            told = ((a >> at) & np.uint64(15),) if lengths else ()
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (*told, a & low, b & low))], names=names)

    def ends(held):
        """The keys of the least and greatest place of each string, sorted."""
        held = np.sort(held)
        key = held >> at
        other = key[1:] != key[:-1]
        return held[np.append(True, other) | np.append(other, True)] if len(held) else held

    held, size = [], 0
    for batch in batches:
        if batch.column(2).null_count:  # of a label that is not in the tree
            bare = batch.filter(batch.column(2).is_null())
            yield pa.RecordBatch.from_arrays([bare.column(0), *([bare.column(1)] if lengths else []), bare.column(2), bare.column(2)], names=names)
            batch = batch.filter(batch.column(2).is_valid())
        w, n, tin = (batch.column(i).to_numpy() for i in range(3))
        held.append((w.view(np.uint64) ^ _TURN) | (n.astype(np.uint64) << at if lengths else np.uint64(0)) | tin.astype(np.uint64))
        held[-1] = ends(held[-1])
        size += len(held[-1])
        if size > MERGED:
            held = [ends(np.concatenate(held))]
            size = len(held[0])
            if size > MERGED // 2:
                yield from rows(held[0])
                held, size = [], 0
    if held:
        yield from rows(ends(np.concatenate(held)))


def spans(sequences: DataFrame, s: int, forward_only: bool = False, whole: bool = False) -> DataFrame:
    """strings() of sequences (tin, seq) with the least and greatest tin (lo, hi) of each. Strings of up to SHORT letters
    recur so often that a task merges its own before they leave it: in a table of all strings there are of up to TABLED
    letters, in one of MERGED rows beyond."""
    if s > SHORT:
        return strings(sequences, s, forward_only, whole).withColumns({"lo": F.col("tin"), "hi": F.col("tin")}).drop("tin")
    if s <= TABLED:
        cut = pieces(sequences.select("tin", "seq", *cut_columns(sequences)), "seq", s - 1, 0 if forward_only else s - 1)
        return cut.mapInArrow(lambda batches: _tabled(batches, s, forward_only, whole), "w0 long, n int, lo int, hi int")
    return strings(sequences, s, forward_only, whole, lambda batches: _merged(batches, SHORT, True), "w0 long, n int, lo int, hi int")


def _plain(arrays: list[pa.Array]) -> list[np.ndarray]:
    return [a.to_numpy().view(np.uint64) ^ _TURN for a in arrays]


def _signed(words: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array((w ^ _TURN).view(np.int64)) for w in words]


def opposite(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The reverse complements of strings of k letters, as numbers whose highest bit is not turned."""
    out = []
    for w in words[::-1]:
        w = (~w).byteswap()
        for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
            w = ((w >> np.uint64(by)) & np.uint64(mask)) | ((w & np.uint64(mask)) << np.uint64(by))
        out.append(w)
    if by := 2 * (LETTERS * len(words) - k):
        after = [*out[1:], np.zeros_like(out[0])]
        out = [(w << np.uint64(by)) | (x >> np.uint64(64 - by)) for w, x in zip(out, after, strict=True)]
    return out


def _lesser(words: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Where other comes before words."""
    less, same = np.zeros(len(words[0]), bool), np.ones(len(words[0]), bool)
    for a, b in zip(words, other, strict=True):
        less |= same & (b < a)
        same &= a == b
    return less


def _pair(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The lesser of each string of k letters and its reverse complement."""
    back = opposite(words, k)
    turned = _lesser(words, back)
    return [np.where(turned, b, w) for w, b in zip(words, back, strict=True)]


def paired(sequences: DataFrame, k: int) -> DataFrame:
    """(w0, ..., lo, hi): the windows of k letters of one strand of sequences (tin, seq), for an index of both strands: the
    lesser of each and its reverse complement. These have the same labels on both strands together, so one of them stands
    for both (both() gives the other). Of up to MERGED_PAIRS letters, a task merges its own before they leave it."""
    names = columns(k)

    def lesser(batches):
        for batch in batches:
            words = _signed(_pair(_plain(batch.columns[: len(names)]), k))
            yield pa.RecordBatch.from_arrays([*words, batch.column(len(names)), batch.column(len(names) + 1)], names=[*names, "n", "tin"])

    def spans_of(batches):
        if k <= MERGED_PAIRS:
            yield from _merged(lesser(batches), k, False)
        else:
            for batch in lesser(batches):
                tin = batch.column(len(names) + 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], tin, tin], names=[*names, "lo", "hi"])

    return strings(sequences, k, True, True, spans_of, ", ".join([*(f"{c} long" for c in names), "lo int, hi int"]))


_FOUR = np.frombuffer("".join("ACGT"[b >> 6] + "ACGT"[b >> 4 & 3] + "ACGT"[b >> 2 & 3] + "ACGT"[b & 3] for b in range(256)).encode(), np.uint32)


def _text(words: list[np.ndarray], k: int) -> pa.Array:
    """Strings of k letters, of numbers that have their first letter in the highest bits."""
    table = np.stack(words, axis=1).astype(">u8").view(np.uint8)
    letters = np.ascontiguousarray(_FOUR[table].view(np.uint8)[:, :k])
    return pa.StringArray.from_buffers(len(table), pa.py_buffer(np.arange(len(table) + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(letters))


def both(labels: DataFrame, k: int, text: bool = False) -> DataFrame:
    """(w0, ..., label) with a row for each string of k letters and one for its reverse complement, if that is another;
    text: (kmer, label)."""
    names = columns(k)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _plain(batch.columns[:-1])
            back = opposite(words, k)
            two = np.flatnonzero(np.logical_or.reduce([a != b for a, b in zip(words, back, strict=True)]))
            label = pa.concat_arrays([batch.column(len(names)), batch.column(len(names)).take(pa.array(two))])
            if text:  # what follows the last letter of a reverse complement is not printed
                yield pa.RecordBatch.from_arrays([_text([np.concatenate([~b, ~w[two]]) for w, b in zip(words, back, strict=True)], k), label], names=["kmer", "label"])
            else:
                yield pa.RecordBatch.from_arrays([*_signed([np.concatenate([w, b[two]]) for w, b in zip(words, back, strict=True)]), label], names=[*names, "label"])

    return labels.select(*names, "label").mapInArrow(run, "kmer string, label int" if text else ", ".join([*(f"{c} long" for c in names), "label int"]))


def tasks_for(df: DataFrame, letters: int) -> int:
    """How many tasks so many letters are worth, of those that pieces() deals to."""
    return min(max(-(-letters // CHUNK), 1), tasks_of(df))


def asked_windows(queries: DataFrame, k: int, pairs: bool = False, tasks: int | None = None) -> DataFrame:
    """(query_rank, piece, start, end, w0, ...) of each window of k letters of queries (query_rank, seq); neighbouring
    windows with other characters are one row, without numbers. pairs: the numbers are those of the lesser of the window
    and its reverse complement. tasks: how many make them, all if it is not given."""
    cut = pieces(queries.select(F.col("query_rank").cast("long").alias("query_rank"), "seq", *cut_columns(queries)), "seq", 0, k - 1, tasks)
    names = ["query_rank", "piece", "start", "end", *columns(k)]

    def run(batches):
        for batch in batches:
            rank, offset, lead, own = (batch.column(batch.schema.get_field_index(c)) for c in ("query_rank", "offset", "lead", "own"))
            first, lead, own = (x.to_numpy().astype(np.int64) for x in (offset, lead, own))
            for rows, codes, off in _chunks(batch, "seq"):
                row = np.repeat(np.arange(rows.start, rows.stop), np.diff(off))
                place = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off)) - (k - 1)
                words, n = ending(codes, off, k)
                there = np.flatnonzero((place >= 0) & (place >= lead[row]) & (place < lead[row] + own[row]))
                place -= lead[row]
                known = n[there] >= k
                # a row begins at each known window, and where others follow a known one or begin a piece
                new = known.copy()
                if len(there):
                    new[0] = True
                    new[1:] |= known[:-1] | (row[there][1:] != row[there][:-1])
                head = np.flatnonzero(new)
                size = np.diff(np.append(head, len(there)))
                took, known = there[head], known[head]
                start = first[row[took]] + place[took]
                numbers = _masked(words, n, took)
                if pairs:
                    numbers = _signed(_pair(_plain(numbers), k))
                numbers = [pa.array(x.to_numpy(), mask=~known) for x in numbers]
                yield pa.RecordBatch.from_arrays([rank.take(pa.array(row[took])), pa.array(first[row[took]] // PIECE), pa.array(start), pa.array(start + size), *numbers], names=names)

    return cut.mapInArrow(run, ", ".join(["query_rank long", "piece long", "start long", "end long", *(f"{c} long" for c in columns(k))]))


def asked_ends(queries: DataFrame, s: int) -> DataFrame:
    """(query_rank, pos, w0, ..., n) of each letter of queries (query_rank, seq): the string of up to s letters that ends
    there; n is 0 at other characters than A, C, G, T."""
    cut = pieces(queries.select(F.col("query_rank").cast("long").alias("query_rank"), "seq", *cut_columns(queries)), "seq", s - 1, 0)
    names = ["query_rank", "pos", *columns(s), "n"]

    def run(batches):
        for batch in batches:
            rank, offset, lead, own = (batch.column(batch.schema.get_field_index(c)) for c in ("query_rank", "offset", "lead", "own"))
            first, lead, own = (x.to_numpy().astype(np.int64) for x in (offset, lead, own))
            for rows, codes, off in _chunks(batch, "seq"):
                row = np.repeat(np.arange(rows.start, rows.stop), np.diff(off))
                place = np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off)) - lead[row]
                words, n = ending(codes, off, s)
                took = np.flatnonzero((place >= 0) & (place < own[row]))
                yield pa.RecordBatch.from_arrays([rank.take(pa.array(row[took])), pa.array(first[row[took]] + place[took]), *_masked(words, n, took), pa.array(n[took].astype(np.int32))], names=names)

    return cut.mapInArrow(run, ", ".join(["query_rank long", "pos long", *(f"{c} long" for c in columns(s)), "n int"]))
