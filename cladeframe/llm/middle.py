"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which change places between sentinels.

A text becomes a rope: a balanced tree whose leaves are slices of up to LEAF code points, and whose nodes cache how many
units (lines) and code points stand below. A tree is split at a rank of units to cut the text, and the subtrees are
concatenated with the sentinels; neither copies more than a leaf on each level. To invert it, the output's own rope is
split at the ranks of code points where the sentinels stand, and put together in the old order.

Null texts count as empty ones; these, and texts that hold a sentinel, stay plain. Rows that repeat are answered each
for itself, a null id counts as an empty one, an empty table gives no rows; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import prepare

LEAF = 4096
# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of output that a batch holds, about.
BATCH = 1 << 23


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or a node (left, right); units are the line feeds below, chars the code points."""

    text: str | None
    left: Rope | None
    right: Rope | None
    units: int
    chars: int
    height: int


EMPTY = Rope("", None, None, 0, 0, 0)


def leaf(text: str) -> Rope:
    return Rope(text, None, None, text.count("\n"), len(text), 0)


def node(a: Rope, b: Rope) -> Rope:
    return Rope(None, a, b, a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height))


def rope(text: str, size: int = LEAF) -> Rope:
    """The balanced tree of a text."""
    level = [leaf(text[i : i + size]) for i in range(0, len(text), size)]
    while len(level) > 1:
        level = [node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def _join(a: Rope, b: Rope) -> Rope:
    """A node of two trees whose heights differ by two at most, turned where that is one too many."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return node(a.left, node(a.right, b))
        return node(node(a.left, a.right.left), node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return node(node(a, b.left), b.right)
        return node(node(a, b.left.left), node(b.left.right, b.right))
    return node(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """Both trees as one, as balanced as they are."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.text is not None and b.text is not None and a.chars + b.chars <= LEAF:
        return leaf(a.text + b.text)
    if a.height > b.height + 1:
        return _join(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _join(concat(a, b.left), b.right)
    return node(a, b)


def split(tree: Rope, rank: int, by: str = "chars") -> tuple[Rope, Rope]:
    """The first rank code points, or lines (by units, each with its line feed), and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if tree.text is not None:
        at = rank
        if by == "units":
            at = 0
            for _ in range(rank):
                at = tree.text.find("\n", at) + 1
                if not at:
                    return tree, EMPTY
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    here = getattr(tree.left, by)
    if rank <= here:
        a, b = split(tree.left, rank, by)
        return a, concat(b, tree.right)
    a, b = split(tree.right, rank - here, by)
    return concat(tree.left, a), b


def leaves(tree: Rope) -> Iterator[str]:
    todo = [tree]
    while todo:
        at = todo.pop()
        if at.text is None:
            todo += (at.right, at.left)
        else:
            yield at.text


def lines(tree: Rope) -> int:
    """Lines of a text, the last one with or without a line feed."""
    last = tree
    while last.text is None:
        last = last.right
    return tree.units + (last.chars > 0 and not last.text.endswith("\n"))


def numbers(doc_id, seed: int) -> list[int]:
    """The first four groups of eight digits of the SHA-256 of seed, colon and id, as numbers."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearrange(text: str | None, draws: list[int], percent: int, percent_spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    tree = rope(text or "")
    n = lines(tree)
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= percent:
        return n, "plain", None, None, text or ""
    a, b = sorted(x % (n + 1) for x in draws[:2])
    head, suffix = split(tree, b, "units") if b < n else (tree, EMPTY)
    prefix, middle = split(head, a, "units") if a < n else (head, EMPTY)
    first, second = (PREFIX, prefix), (SUFFIX, suffix)
    form = "spm" if draws[3] % 100 < percent_spm else "psm"
    out = EMPTY
    for mark, part in (*((second, first) if form == "spm" else (first, second)), (MIDDLE, middle)):
        out = concat(concat(out, leaf(mark)), part)
    return n, form, prefix.chars, middle.chars, "".join(leaves(out))


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    tree = rope(output)
    # no part holds a sentinel, and none can come about where a part meets one
    b, c = output.index(second), output.index(MIDDLE)
    head, middle = split(tree, c)
    one, two = split(head, b)
    (_, one), (_, two), (_, middle) = split(one, len(first)), split(two, len(second)), split(middle, len(MIDDLE))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return "".join(leaves(concat(concat(prefix, middle), suffix)))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end where the texts in their last column add up to BATCH."""
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, full = [], 0
    for row in rows:
        held.append(row)
        full += len(row[-1])
        if full >= BATCH or len(held) >= 512:
            yield made(held)
            held, full = [], 0
    if held:
        yield made(held)


def rearranged(docs: DataFrame, seed: int = 7, percent: int = 100, percent_spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs (doc_id, text): of percent of the texts the parts
    change places, in percent_spm of these the suffix comes first. n counts lines."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def rows(batches):
        for batch in batches:
            for doc, text in zip(B.column(batch, "doc_id").to_pylist(), B.column(batch, "text"), strict=True):
                yield doc, *rearrange(text.as_py(), numbers(doc, seed), percent, percent_spm)

    def run(batches):
        yield from _batches(rows(batches), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, name: str = "restored") -> DataFrame:
    """made (form, output and other columns) with the text that each output was made of; a column of that name is
    replaced."""
    prepare(made.sparkSession)
    made = made.drop(name)
    schema = made.withColumn(name, F.lit("")).schema

    def run(batches):
        for batch in batches:
            texts = [restore(o.as_py(), f) for o, f in zip(B.column(batch, "output"), B.column(batch, "form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return made.mapInArrow(run, schema)


def digest(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
