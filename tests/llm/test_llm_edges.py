"""Rows that ids do not tell apart, nulls in any column, columns with clashing names and odd types."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import bpe, decontaminate, jaccard, language, licenses, lmscore, sharding, spotsigs, suffixes, units
from test_llm_operators import prose

CLASH = "removed string, __removed long, __document string, __cell long, __bucket int, __at long, __heads string, __digest string, m map<string,int>, n_chars long"


@pytest.fixture(scope="module")
def twins(spark):
    """One id with two texts, equal rows, null ids, null texts; columns named like the operators' own ones; a map."""
    rnd = random.Random(3)
    passage = prose(rnd, 60)
    a, b = prose(rnd, 30) + " " + passage, "other words here. " + passage + " " + prose(rnd, 20)
    texts = [(5, a), (5, b), (5, b), (6, b), (6, None), (6, None), (7, ""), (None, a), (None, a), (None, None), (8, "short")]
    rows = [(d, t, "en" if i % 2 else None, None, "x", 1, "y", 2, 3, 4, "z", "w", {"k": i}, len(t or "")) for i, (d, t) in enumerate(texts)]
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


def documents(rows):
    """The distinct (id, text) with an id, in the order of the operators: of id, then of a hash of the text."""
    return sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})


def orders(spark, rows):
    texts = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id", "h").collect()]


def test_suffixes_tell_rows_apart(spark, twins):
    rows, docs = twins
    seen, expected = set(), {}
    for d, t in orders(spark, rows):
        data, gone = t.encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(data[i : i + 100])
        expected[d, t] = (len(gone), hashlib.sha256(bytes(x for i, x in enumerate(data) if i not in gone)).hexdigest())
    found = suffixes.repeated(docs)
    got = [(r["doc_id"], r["text"] or "", sum(e - s for s, e in suffixes.merged(r["removed"] or []))) for r in found.collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[1] or "", expected[r[0], r[1] or ""][0] if r[0] is not None else 0) for r in rows), key=str)
    digests = sorted((str(r["doc_id"]), r["kept_sha256"]) for r in suffixes.digest(found).collect())
    assert digests == sorted((str(r[0]), expected[r[0], r[1] or ""][1] if r[0] is not None else hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def test_units_tell_rows_apart(spark, twins):
    rows, docs = twins
    out = units.without_repeats(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sum(r["doc_id"] is None for r in got) == 3 and {r["text"] for r in got if r["doc_id"] is None} == {rows[0][1], None}
    first, second = orders(spark, rows)[:2]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["text"])
        assert r["removed"] == "x" and r["__document"] == "y" and r["n_chars"] == len(r["text"] or "")
    assert first[1] in by[5] and second[1] not in by[5] and len(by[5]) == 2  # the later text lost the passage
    assert rows[3][1] not in by[6] and None in by[6] and by[7] == {""} and by[8] == {"short"}


def test_language_without_ids(spark):
    """Rows whose ids are null or equal are drawn by their texts; each is answered by its own."""
    words = {"en": "the house and water is with they which ring", "de": "das haus und wasser ist mit sie welche schön"}
    rnd = random.Random(1)
    texts = [(" ".join(rnd.choice(words[x].split()) for _ in range(20)), x) for x in ("en", "de") * 1500]
    for ident in (None, 3):
        docs = spark.createDataFrame([(ident, t, lang, {"k": 1}) for t, lang in texts] + [(ident, None, "en", None), (ident, "1", None, None)], "doc_id long, text string, lang string, m map<string,int>")
        got = language.identify(docs, 50).collect()
        assert len(got) == 3002 and sorted({r["lang_pred"] for r in got}) == ["de", "en", "und"] and all(0 <= r["score"] <= 1 for r in got)
        kept = language.accepted(docs)
        assert kept.columns == docs.columns and {r["text"] for r in kept.collect()} == {t for t, _ in texts}
    # equal rows have one draw; the bound holds for them, too
    same = spark.createDataFrame([(1, texts[0][0], "en")] * 300 + [(2, texts[1][0], "de")] * 3, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(same, 5).collect()} == {1: "en", 2: "de"}


def test_language_predicts_as_its_weights_say(spark):
    """The vectorised answer against a plain one by the same weights: family first, then every two languages of it."""
    import numpy as np

    words = {"en": "the house and water is with", "de": "das haus und wasser ist mit", "fr": "la maison et eau est avec", "es": "la casa y agua con"}
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(words[x].split()) for _ in range(rnd.randint(1, 12))), x) for i, x in enumerate(list(words) * 40)]
    docs = spark.createDataFrame([*rows, (999, "???", "en")], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    odds = lambda m: 1 / (1 + np.exp(-3 * m))
    assert set(model.families) == {"germanic", "romance"}
    for d, t, _ in rows:
        x = language.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].astype(float)
        margin = {f: x @ w[:-1] + w[-1] for f, w in model.family_w.items()}
        family = max(margin, key=margin.get)
        a, b = model.families[family]
        w = model.pair_w[a, b]
        p = odds(x @ w[:-1] + w[-1])
        assert got[d]["lang_pred"] == (a if p >= 0.5 else b) and got[d]["score"] == pytest.approx(odds(margin[family]) * max(p, 1 - p), abs=1e-4)
    assert (got[999]["lang_pred"], got[999]["score"]) == ("und", 0)
    # a tie between two languages goes to the first by name
    x = np.zeros((1, language.DIM), np.float32)
    flat = language.Model({"germanic": ["de", "en"]}, {}, {("de", "en"): np.zeros(language.DIM + 1, np.float32)})
    assert flat.predict(x)[0] == ["de"]


def test_sharding_of_twins(spark, twins):
    rows, docs = twins
    got = sharding.shard(docs, 3, bucket_bytes=300)
    assert set(got.columns) == {*docs.columns, "shard", "slot"}
    got = got.collect()
    assert sorted(((r["doc_id"], r["text"], r["m"]["k"]) for r in got), key=str) == sorted(((r[0], r[1], r[-2]["k"]) for r in rows), key=str)
    assert all(r["__cell"] == 2 and r["__bucket"] == 3 and r["__at"] == 4 and r["__heads"] == "z" for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [3, 4, 4] and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_sharding_spreads_a_record_that_repeats(spark):
    """A third and more of the rows are one record: its copies fill many buckets, none of them much more than others."""
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), "id")).otherwise(F.lit("the same")).alias("text"))
    _, counts, buckets, n, _ = sharding.scattered(docs, 1, 2000)
    assert n == 3000 and buckets > 20 and counts.agg(F.max("b")).first()[0] < 5000
    rows = sharding.shard(docs, 4, bucket_bytes=2000).collect()
    assert len(rows) == 3000 and sum(r["doc_id"] is None for r in rows) == 1500
    assert sorted(r["slot"] for r in rows if r["shard"] == 2) == list(range(750))
    copies = [r["shard"] for r in rows if r["doc_id"] is None]
    assert all(300 < copies.count(i) < 450 for i in range(4))


def test_decontamination_of_twins(spark, twins):
    """Each row by its own text; what goes and what stays has all its columns."""
    rows, docs = twins
    a = rows[0][1].split(" ")
    bench = spark.createDataFrame([("x", " ".join(a[2:14])), ("x", "short"), (None, rows[1][1]), ("y", None)], "item_id string, text string")
    got = sorted(((r["doc_id"], r["n_words"], len(r["hit_start"]), r["items"]) for r in decontaminate.hits(docs, bench).collect()), key=str)
    hit = {rows[0][1], "short"}
    assert [bool(x[2]) for x in got].count(True) == sum(r[1] in hit for r in rows) and len(got) == len(rows)
    assert all(x[3] == (["x"] if x[2] else []) for x in got)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["m"]["k"]) for r in kept.collect()), key=str) == sorted(((r[0], r[1], r[-2]["k"]) for r in rows if r[1] not in hit), key=str)


def test_vocabularies_that_differ_in_two_ranks(spark, tmp_path):
    """The same tokens in another order are another vocabulary: a worker doesn't take one codec for the other."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bc", b"abc"]
    swapped = [*tokens[:256], b"bc", b"ab", b"abc"]
    docs = spark.createDataFrame([(1, "abc abcd"), (1, None), (None, "bc")], "doc_id long, text string")
    for name, own in (("one", tokens), ("two", swapped)):
        (tmp_path / name).write_bytes(b"".join(b"%b %d\n" % (base64.b64encode(t), i) for i, t in enumerate(own)))
    got = [{r["text"]: r["ids"] for r in bpe.encode(docs, str(tmp_path / x), r"\w+| ").collect()} for x in ("one", "two")]
    ab, bc = tokens.index(b"ab"), tokens.index(b"bc")
    assert got[0]["bc"] == [bc] and got[1]["bc"] == [swapped.index(b"bc")] and got[0][None] == []
    assert got[0]["abc abcd"] == [258, 32, 258, 100] and got[1]["abc abcd"] == [258, 32, 258, 100] and ab != bc


def test_jaccard_of_twins(spark, twins):
    rows, docs = twins
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).collect()), key=str)
    n = {t: len({tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} - {()}) for _, t, *_ in rows}
    # texts a and b are unlike; b stands under 5 and 6, so the smaller id is its component
    expected = [(d, n[t], None if d is None else 5 if t == rows[1][1] else d) for d, t, *_ in rows]
    assert got == sorted(expected, key=str)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [5, 5, 6, 7, 8, None, None, None]))


def test_fingerprints_of_twins(spark, twins):
    """Rows in the order of id (null first) and text; each is the successor of the one before it."""
    rows, docs = twins
    got = spotsigs.compare_neighbours(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=str) == sorted(((r[0], len(r[1] or "")) for r in rows), key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault((r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    kept = spotsigs.with_signatures(docs, "text", "sigs")
    assert kept.columns == [*docs.columns, "sigs"] and {r["__heads"] for r in kept.collect()} == {"z"}
    b = rows[1][1]
    assert {r["doc_id"]: r["representative"] for r in spotsigs.members(docs.where(F.col("text") == b)).collect()} == {5: 5, 6: 5}


def test_scores_of_twins(spark, twins):
    """Each row has a score of its own; equal texts on one side of the target have equal ones."""
    rows, docs = twins
    got = lmscore.scores(docs, spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")).collect()
    assert len(got) == len(rows) and sum(r["score"] is None for r in got) == sum(not r[1] for r in rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_words"]), set()).add(r["score"])
    assert all(len(x) == 1 for x in by.values())


def test_licences_of_twins(spark):
    """Rows of one path or id are each answered; of two licence files of one path the more similar one counts."""
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (1, "a/LICENSE", "Licensed under CC BY 4.0. Words beside it."), (2, "a/x", None), (2, "a/x", None), (None, "a/b/y", ""), (None, None, "All rights reserved.")]
    files = spark.createDataFrame([(*r, "x", {"k": 1}) for r in rows], "doc_id long, path string, text string, similarity string, m map<string,int>")
    got = sorted(((r["doc_id"], r["licence"], r["origin"]) for r in licenses.scan(files).collect()), key=str)
    assert got == sorted([(1, "MIT", "own"), (1, "CC-BY-4.0", "own"), (2, "MIT", "inherited"), (2, "MIT", "inherited"), (None, "MIT", "inherited"), (None, "proprietary", "own")], key=str)


def test_tokens_of_twins(spark, twins):
    pytest.importorskip("public_tokenizers")
    rows, docs = twins
    got = bpe.digest(docs).collect()
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in got), key=str) == sorted(((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str)
    assert bpe.encode(docs).columns == [*docs.columns, "ids"]


def test_lists_merged_by_binary_search():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(50):
        lists, every = [], {}
        for _ in range(rnd.randint(1, 6)):
            own = sorted({bytes(rnd.choice(b"ab\0") for _ in range(3)) + b"\1" for _ in range(rnd.randint(1, 12))})
            places = [(rnd.randint(-5, 5), rnd.randint(0, 99)) for _ in own]
            lists.append((np.array(own, "S4"), np.array([p[0] for p in places]), np.array([p[1] for p in places])))
            for x, p in zip(own, places, strict=True):
                every.setdefault(x, []).append(p)
        got = sorted(map(tuple, suffixes.merge(lists).T.tolist()))
        assert got == sorted(p for x in every.values() for p in sorted(x)[1:])
