"""Byte-level BPE encoding and decoding in linear time.

Texts are cut by the vocabulary's pattern; a piece that is itself a token is that token, every other piece is encoded
by backtracking: an Aho-Corasick automaton over the piece's bytes (as Latin-1) gives the longest token at each place,
a token is appended if its place's end is not known to be a dead end and if it stands beside the last token in a
merged text (memoised for pairs), else the next shorter token is tried, and without one the last token is taken back.
As each place is marked dead once at most, the work is linear in the length of the piece; the result is that of the
merges in the order of their ranks.

Null and empty texts have no ids. Texts may be of any length; special tokens are ordinary text; ids and other columns
may repeat or be null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import bytewise as B
from .common import prepare

#: Pairs that are remembered; beyond it the memory starts anew, so it stays bounded.
REMEMBERED = 150_000
#: Pieces that are remembered as new ones; beyond it they become the old ones, which those that come again leave.
YOUNG = 120_000
#: Code points from which a text's pieces are worked on in groups.
LONG = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Told(dict):
    """Decimal ids (commas between) and what they decode to, of each piece. Frequent pieces stay when others go."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def age(self) -> None:
        """What is held becomes old; what was old and has not come again goes."""
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        if (out := self.old.get(piece)) is None:
            ids = self.codec.piece(piece, remember=False)
            out = ",".join(map(str, ids)), self.codec.decode(ids)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.told = Told(self)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        # only tokens that merging can make may stand in an encoded text
        self.halves: dict[int, tuple[int, int] | None] = {}
        made = {t: r for t, r in ranks.items() if len(t) == 1 or self.merge(t) == [r]}
        self.automaton = ahocorasick.Automaton()
        for t, r in made.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.shorter = {r: next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), None) for t, r in made.items()}

    def merge(self, data: bytes) -> list[int]:
        """The merges one by one: joins the leftmost pair of least rank until none is left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            if len(parts) == 2:
                self.halves[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens apart."""
        key = left, right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Takes back the merges of both tokens, latest first, and looks whether the inner ends would have merged then.

        Among equal ranks the leftmost merges first: what stands left of the border is made before, right of it after.
        """
        ranks, data, halves = self.ranks, self.bytes_of, self.halves
        before = 1 << 60  # a merge across the border must have come before this one was made
        while True:
            rank = ranks.get(data[left] + data[right])
            if rank is not None and rank < before:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def backtrack(self, data: bytes) -> list[int]:
        longest: list[tuple[int, int]] = [(0, 0)] * len(data)
        for end, found in self.automaton.iter(data.decode("latin-1")):
            if found[0] > longest[start := end - found[0] + 1][0]:
                longest[start] = found
        alive, out, at = bytearray(b"\1") * (len(data) + 1), [], 0
        token: int | None = longest[0][1] if data else None
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + len(self.bytes_of[token])
                if alive[end] and (last is None or self.beside(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at][1] if at < len(data) else None
                    break
                token = self.shorter[token]
                if token is None:
                    alive[at] = 0
                    token = out.pop()
                    at -= len(self.bytes_of[token])
                    break
        return out

    def piece(self, text: str, remember: bool = True) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.backtrack(data))
        if remember and len(text) <= 64:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def groups(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.split.findall(text)
            return
        group: list[str] = []
        for m in self.split.finditer(text):
            group.append(m[0])
            if len(group) == LONG:
                yield group
                group = []
        yield group

    def encode_groups(self, text: str) -> Iterator[list[int]]:
        known, piece = self.pieces.get, self.piece
        for group in self.groups(text):
            yield list(chain.from_iterable([known(p) or piece(p) for p in group]))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_groups(text or "")))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids (decimal, commas between), SHA-256 of what they decode to."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for group in self.groups(text or ""):
            if group:
                if len(self.told) >= YOUNG:
                    self.told.age()
                told = [*map(self.told.__getitem__, group)]
                ids = ",".join([x[0] for x in told])
                ids_hash.update(("," * (n > 0) + ids).encode())
                text_hash.update(b"".join([x[1] for x in told]))
                n += ids.count(",") + 1
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


#: Codecs that a worker keeps, the latest ones.
KEPT = 2
_codecs: dict[tuple[str, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec for each worker, vocabulary (told by the digest of all its tokens and ranks) and pattern."""
    digest, ranks = shared.value
    key = digest, pattern
    if key not in _codecs:
        while len(_codecs) >= KEPT:
            del _codecs[next(iter(_codecs))]
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _vocabulary(path: str) -> tuple[str, dict[bytes, int]]:
    ranks = read_ranks(path)
    return hashlib.sha256(b"".join(b"%d:%d:%b" % (r, len(t), t) for t, r in sorted(ranks.items()))).hexdigest(), ranks


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers as P

        path, pattern = path or P.path("byte_bpe_multi_50k.tiktoken"), pattern or P.PATTERN
    return path, pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with all its columns and ids array<int>, the text's token ids. path: the vocabulary file."""
    path, pattern = _defaults(path, pattern)
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_vocabulary(path))  # of fixed size
    docs = docs.drop("ids")

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            ids = pa.array((codec.encode(t) for t in B.column(batch, "text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df with decoded binary, the bytes of its column ids (null: empty)."""
    path, pattern = _defaults(path, None)
    shared = prepare(df.sparkSession).sparkContext.broadcast(read_ranks(path))
    df = df.drop("decoded")

    def run(batches):
        tokens = {r: t for t, r in shared.value.items()}
        for batch in batches:
            out = pa.array((b"".join(map(tokens.__getitem__, x or ())) for x in B.column(batch, "ids").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType())]))


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text."""
    path, pattern = _defaults(path, pattern)
    shared = prepare(docs.sparkSession).sparkContext.broadcast(_vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            rows = [codec.digest(t.as_py()) for t in B.column(batch, "text")]
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), *(pa.array([r[j] for r in rows], schema.field(j + 1).type) for j in range(3))], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
