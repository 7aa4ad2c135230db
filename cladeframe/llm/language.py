"""Language identification in two steps: the family first, then the language within it.

Features are hashed counts of one to three neighbouring bytes of the lower-cased text, where all that is neither an
ASCII letter nor beyond ASCII counts as one blank. Linear support vector machines (squared hinge loss, dual coordinate
descent) tell families one against the rest, and within a family every two languages apart; votes, then margins,
decide. All weights are learned, in one task, from a sample of labelled rows, of at most PER_LANGUAGE rows of each
language, that a hash of id and text chooses.

Texts that are null or have no letter are `und` with score 0; without any labelled row every text is `und`. Each row is
answered by its own text alone, so ids may be null or repeat. Rows that are equal in id and text are drawn for the
sample together, up to the bound. Empty tables give no rows; other columns are ignored, and kept by accepted().
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytewise as B
from .common import prepare

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv".split(),
    "romance": "ca es fr gl it pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
}
DIM = 4096
#: Labelled rows of each language that the classifiers are fitted on, at most.
PER_LANGUAGE = 500
#: Score below which the filter rejects a text.
MIN_SCORE = 0.2

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
CODE = np.where(LETTER, B.LOWER, 32).astype(np.uint32)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of unit length for each text."""
    rows, n = len(off) - 1, len(buf)
    out = np.zeros(rows * DIM)
    if n:
        codes = CODE[buf]
        doc = np.repeat(np.arange(rows), np.diff(off))
        gram = np.zeros(n, np.uint32)
        for k in (1, 2, 3):
            m = n - k + 1
            if m <= 0:
                break
            gram = gram[:m] * np.uint32(256) + codes[k - 1 :]
            slot = ((gram + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(20)
            same = doc[:m] == doc[k - 1 :]
            out += np.bincount((doc[:m] * DIM + slot)[same], minlength=rows * DIM)
    out = np.sqrt(out.reshape(rows, DIM)).astype(np.float32)
    out[:, ((32 + 1) * 2654435761 % 2**32) >> 20] = 0  # blanks tell nothing
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine for labels -1 and 1; both classes weigh alike."""
    c = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w, bias, alpha, diag = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x)), 0.5 / c
    norms, rng = np.einsum("ij,ij->i", x, x) + 1.0 + diag, np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = (y[i] * (float(x[i] @ w) + bias) - 1 + diag[i] * alpha[i]) / norms[i]
            new = max(alpha[i] - step, 0.0)
            if new != alpha[i]:
                by = float((new - alpha[i]) * y[i])
                w += np.float32(by) * x[i]
                bias += by
                alpha[i] = new
    return np.append(w, bias).astype(np.float32)


@dataclass
class Model:
    families: dict[str, list[str]]  # family -> its learned languages
    family_w: dict[str, np.ndarray]
    pair_w: dict[tuple[str, str], np.ndarray]

    @classmethod
    def train(cls, x: np.ndarray, langs: list[str]) -> Model:
        of = {lang: f for f, ls in FAMILIES.items() for lang in ls}
        families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            families.setdefault(of.get(lang, lang), []).append(lang)
        labels, fam = np.array(langs, object), np.array([of.get(a, a) for a in langs], object)
        family_w = {f: fit(x, np.where(fam == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
        pair_w = {}
        for own in families.values():
            for a, b in combinations(own, 2):
                rows = (labels == a) | (labels == b)
                pair_w[a, b] = fit(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
        return cls(families, family_w, pair_w)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        odds = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        if len(names) > 1:
            margins = np.stack([x @ w[:-1] + w[-1] for w in (self.family_w[f] for f in names)], 1)
            best = margins.argmax(1)
            score = odds(margins[np.arange(len(x)), best])
        else:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        out = np.empty(len(x), object)
        for i, f in enumerate(names):
            rows, own = np.flatnonzero(best == i), self.families[f]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(own)))
            least = np.ones((len(rows), len(own)))
            for a, b in combinations(range(len(own)), 2):
                w = self.pair_w[own[a], own[b]]
                p = odds(x[rows] @ w[:-1] + w[-1])
                votes[:, a] += (p >= 0.5) + 1e-3 * p
                votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
                least[:, a] = np.minimum(least[:, a], p)
                least[:, b] = np.minimum(least[:, b], 1 - p)
            won = votes.argmax(1)
            out[rows] = np.array(own, object)[won]
            score[rows] *= least[np.arange(len(rows)), won]
        return out.tolist(), score


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum(LETTER[buf] & (buf < 128))))
    out = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in bytes(buf[off[i] : off[i + 1]]).decode(errors="replace"))
    return out


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model fitted on rows of docs (doc_id, text, lang) that are not held out; null without such rows."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("draw"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    # a first cut by the hash leaves some times the rows that are needed, so that ranking them moves little
    shares = {lang: min(1.0, 4 * (per_language + 50) / n) for lang, n in counts.items()}
    model, drawn = _fitted(rows, shares, per_language)
    short = {lang for lang, n in counts.items() if drawn.get(lang, 0) < min(n, per_language)}
    # many equal rows have one draw, and may all be cut: then all rows of their language are ranked
    return _fitted(rows, shares | dict.fromkeys(short, 1.0), per_language)[0] if short else model


def _fitted(rows: DataFrame, shares: dict[str, float], per_language: int) -> tuple[Model | None, dict[str, int]]:
    """A model from the least draws of each language among its share of all draws, and the rows drawn for each."""
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(lang, min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))) for lang, share in shares.items()], "lang string, cut long")
    near = rows.join(F.broadcast(cuts), "lang").where("draw <= cut")
    sample = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("rank") <= per_language)

    def run(batches):
        for batch in batches:
            langs = B.column(batch, "lang")
            for lo, hi, buf, off in B.chunks(B.column(batch, "text")):
                x = features(buf, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([langs.slice(lo, hi - lo), pa.array([r.tobytes() for r in x])], names=["lang", "x"])

    def learn(batches):
        pairs = sorted((lang, x) for batch in batches for lang, x in zip(B.column(batch, "lang").to_pylist(), B.column(batch, "x").to_pylist(), strict=True))
        if pairs:
            x = np.frombuffer(b"".join(x for _, x in pairs), np.float16).reshape(-1, DIM).astype(np.float32)
            langs = [lang for lang, _ in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((Model.train(x, langs), dict(Counter(langs))))])], names=["model"])

    # per_language rows of each language are all that meets in one task
    found = sample.select("lang", "text").mapInArrow(run, "lang string, x binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else (None, {})


def judged(batches, shared):
    """Of each batch: language and score of its rows' texts."""
    m = shared.value
    for batch in batches:
        langs, scores = [], []
        for _, _, buf, off in B.chunks(B.column(batch, "text")):
            known = has_letter(buf, off)
            own, score = m.predict(features(buf, off)) if m else (["und"] * len(known), np.zeros(len(known)))
            langs += [a if k else "und" for a, k in zip(own, known, strict=True)]
            scores.append(np.where(known, score, 0.0).astype(np.float64))
        yield batch, langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weight vectors of DIM numbers
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch, langs, score in judged(batches, shared):
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), B.column(batch, "held_out"), pa.array(langs, pa.string()), pa.array(score)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on docs and predict each of its rows."""
    prepare(docs.sparkSession)
    return predict(docs, train(docs, per_language))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language; one pass, each row by itself."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        for batch, langs, score in judged(batches, shared):
            yield batch.filter(pa.array([a != "und" and s >= min_score for a, s in zip(langs, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
