"""The operators against plain versions of what they promise, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import bpe, decontaminate, jaccard, language, licenses, lmscore, sharding, spotsigs, suffixes, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string"


def prose(rnd, n, words=None):
    words = words or ["the", "of", "and", "a", "is", "to", "in", "alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "Übung", "naïve"]
    out = []
    for _ in range(n):
        out.append(rnd.choice(words) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))))
        if rnd.random() < 0.08:
            out[-1] += "."
        if rnd.random() < 0.03:
            out[-1] += "\n"
    return " ".join(out)


def corpus():
    """Copies, near copies, shared passages, nulls, blanks, very short and long texts; columns with clashing names."""
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.randint(1, 200)) for _ in range(40)]
    passage = prose(rnd, 60)
    texts += [texts[3]] * 5 + [None, "", "   ", "\n", "a", "A", "no", "12 34", "é", "!!!"]
    for i in (5, 6, 7, 8):
        w = texts[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rnd.randrange(len(w))] = "changed"
        texts += [" ".join(w), " ".join(w[:-1]), texts[i] + " and more"]
    texts += [prose(rnd, 30) + " " + passage + " " + prose(rnd, 20) for _ in range(6)]
    texts += ["ab" * 400, "x" * 350, "word " * 300, prose(rnd, 6000)]
    return [(i * 7 % 1009, t, ["en", "de", None][i % 3], "s", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


# op2


def naive_suffixes(rows):
    seen, out = {}, {}
    for doc, text in sorted((r[0], r[1]) for r in rows):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            else:
                seen[data[i : i + 100]] = doc
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out[doc] = (len(data), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(docs, none, spark, monkeypatch):
    expected = naive_suffixes(ROWS)
    run = lambda d: {r[0]: tuple(r)[1:] for r in suffixes.digest(suffixes.repeated(d)).collect()}
    assert run(docs) == expected
    monkeypatch.setattr(suffixes, "SENT", 0)  # repeated anchors are joined
    assert run(docs) == expected
    assert run(none) == {}


def test_suffix_array_of_nuls():
    import numpy as np

    rnd = random.Random(5)
    for data in (b"\0\0", b"a\0\0", b"\0" * 40, b"ab\0\0ab\0\0", b"a\0\0\0\0\0\0\0b a", *(bytes(rnd.choice(b"\0\0\0a") for _ in range(rnd.randint(1, 60))) for _ in range(200))):
        assert suffixes.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffixes_hot(docs, monkeypatch):

    monkeypatch.setattr(suffixes, "HOT", 2)  # longer anchors
    assert {r[0]: tuple(r)[1:] for r in suffixes.digest(suffixes.repeated(docs)).collect()} == naive_suffixes(ROWS)
    monkeypatch.setattr(suffixes, "SPREAD", 2)  # that are spread, shards merged
    assert {r[0]: tuple(r)[1:] for r in suffixes.digest(suffixes.repeated(docs)).collect()} == naive_suffixes(ROWS)


# op7


def naive_components(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = SOLID.findall(lower(text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard(docs, none, spark, monkeypatch):
    run = lambda d: {r[0]: tuple(r)[1:] for r in jaccard.components(d).collect()}
    assert run(docs) == naive_components(ROWS)
    assert run(none) == {}
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {d for d, (_, c) in naive_components(ROWS).items() if d == c}
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_jaccard_chains(spark):
    """Groups whose members are not all similar to each other or to their smallest."""
    rnd = random.Random(5)
    rows = []
    for g in range(4):
        words = [f"w{g}_{i}" for i in range(80)]
        for _ in range(25):
            rows.append(" ".join(words))
            words = list(words)
            words[rnd.randrange(80)] = f"n{rnd.random()}"
    rnd.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = {r[0]: tuple(r)[1:] for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == naive_components(rows)


def test_tree_finds_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, (12, 64))
    vecs = np.concatenate([np.maximum(b + rng.integers(-1, 2, (25, 64)), 0) for b in base]).astype(np.int64)
    sizes, comps = vecs.sum(1), rng.integers(0, 200, len(vecs))
    found = {tuple(sorted(p)) for x, y in jaccard.Tree(vecs, sizes, comps).pairs() for p in zip(x.tolist(), y.tolist(), strict=True)}
    expected = {
        (i, j) for i in range(len(vecs)) for j in range(i + 1, len(vecs))
        if comps[i] != comps[j] and jaccard.enough(int(np.minimum(vecs[i], vecs[j]).sum()), int(sizes[i]), int(sizes[j]))
    }
    assert found == expected and expected


# op9


def naive_hits(rows, items):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for doc, text, *_ in rows:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate(docs, none, spark, monkeypatch):
    rnd = random.Random(2)
    items = [(1, " ".join(ROWS[2][1].split(" ")[3:30])), (2, None), (3, ""), (4, "Alpha BRAVO"), (5, prose(rnd, 40)), (6, ROWS[60][1]), (10, " ".join(ROWS[2][1].split(" ")[10:40])), (7, "a"), (8, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    run = lambda d: {r[0]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.hits(d, bench)).collect()}
    expected = naive_hits(ROWS, items)
    assert run(docs) == expected
    assert run(none) == {}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {d for d, x in expected.items() if not x[-1]}
    monkeypatch.setattr(decontaminate, "SENT", 0)  # fingerprints are joined
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", 0)
    assert run(docs) == expected
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {d for d, x in expected.items() if not x[-1]}
    empty = {r[0]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.hits(docs, bench.limit(0))).collect()}
    assert empty == naive_hits(ROWS, [])


def test_decontaminate_answers_each_row(spark, monkeypatch):
    items = [(i, prose(random.Random(100 + i), 30)) for i in range(6)]
    texts = [items[0][1], "filler text " * 20, items[1][1] + " " + items[4][1], None]
    docs = spark.createDataFrame([(d, t) for d in (None, 7, 8) for t in texts] + [(7, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted((str(tuple(r)) for r in decontaminate.hits(docs, bench).collect()))
    whole = run()
    monkeypatch.setattr(decontaminate, "SENT", 0)  # fingerprints are joined
    assert run() == whole and len(whole) == 13


# op4


def naive_units(rows):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        parts = re.findall(r"[^\n]*?(?:[.!?] |\n)|[^\n]+$", text or "")
        words = [tuple(ALNUM.findall(lower(p))) for p in parts]
        again = []
        for w in words:
            again.append(w in seen if w else None)
            seen.add(w)
        told, gone, run = [i for i, x in enumerate(again) if x is not None], set(), []
        for i in [*told, -1]:
            if i >= 0 and again[i]:
                run.append(i)
                continue
            if sum(len(words[j]) for j in run) >= units.LEAST_WORDS:
                gone.update(run)
            run = []
        kept = "".join(p for i, p in enumerate(parts) if i not in gone)
        out[doc] = (len(parts), len(gone), len((text or "").encode()) - len(kept.encode()), kept)
    return out


def test_units(docs, none):
    run = lambda d: {r[0]: tuple(r)[1:] for r in units.digest(units.repeated(d)).collect()}
    expected = naive_units(ROWS)
    assert run(docs) == expected and sum(x[1] for x in expected.values()) > 20 and any(x[1] == 0 < x[0] for x in expected.values())
    assert run(none) == {}
    out = units.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert texts == {d: (None if t is None else expected[d][3], len(expected[d][3])) for d, t in ((r[0], r[1]) for r in ROWS) if t is None or expected[d][3] or not expected[d][1]}


# op6


@pytest.fixture(scope="module")
def codec():
    P = pytest.importorskip("public_tokenizers")
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


def test_bpe(codec, docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("own", pat_str=codec.split.pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(4)
    texts = [r[1] or "" for r in ROWS] + ["".join(rnd.choice("abcde thinor\n\t’éß中😀1,.! ") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    texts += ["".join(rnd.choice("abcdehtinors") for _ in range(2000)), "a" * 3000, "<|endoftext|>", " " * 1000]
    for t in texts:
        assert codec.encode(t) == plain.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    expected = {}
    for d, t, *_ in ROWS:
        ids = plain.encode_ordinary(t or "")
        expected[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bpe.digest(docs).collect()} == expected
    assert bpe.digest(none).count() == 0
    back = bpe.decode(bpe.encode(docs)).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["lang"] == r["lang"] for r in back) and len(back) == len(ROWS)


def test_bpe_long_texts_in_groups(codec, monkeypatch):
    text = ROWS[-1][1]
    whole = codec.digest(text)
    monkeypatch.setattr(bpe, "LONG", 50)
    assert codec.digest(text) == whole


# op8


def test_sharding(docs, none, spark):
    rows = sharding.digest(sharding.shard(docs, 7, bucket_bytes=4000)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {d: (len(t) + 16, zlib.crc32(t), "rows", None) for d, t in texts.items()}
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    again = sharding.shard(docs.repartition(3), 7, bucket_bytes=4000).select("doc_id", "shard", "slot")
    assert {tuple(r) for r in again.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    other = sharding.shard(docs, 7, seed=1, bucket_bytes=4000).select("doc_id", "shard", "slot")
    assert {tuple(r) for r in other.collect()} != {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert sharding.shard(none, 40).count() == 0
    twins = spark.createDataFrame([(None, "x"), (None, "x"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r["slot"] for r in sharding.shard(twins, 1).collect()) == [0, 1, 2, 3]


def test_shuffle_is_even(spark):
    n = 4000
    rows = sharding.shard(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 4, bucket_bytes=5000).collect()
    first = [r["doc_id"] for r in rows if r["shard"] == 0]
    assert abs(sum(first) / len(first) - n / 2) < 5 * n / (12 * len(first)) ** 0.5


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, f"{tmp_path}/s", 3)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/s").collect()) == sorted(r[0] for r in ROWS)


# op10


def naive_chains(text):
    common = set(spotsigs.ANCHORS.split())
    words = [w for w in re.split(spotsigs.BETWEEN, (text or "").lower())]
    out = set()
    for i, w in enumerate(words):
        if w in common:
            chain, passed = [w], 0
            for x in words[i + 1 :]:
                if x in common:
                    passed += 1
                    if passed > spotsigs.REACH:
                        break
                elif x:
                    chain.append(x)
                if len(chain) > spotsigs.CHAIN:
                    out.add(" ".join(chain))
                    break
    return out


def test_spotsigs(docs, none, spark):
    got = {r["doc_id"]: r for r in spotsigs.compare_neighbours(docs).collect()}
    ids = sorted(r[0] for r in ROWS)
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert set(got) == set(ids)
    for i, d in enumerate(ids):
        nxt = texts[ids[(i + 1) % len(ids)]]
        t, r = texts[d], got[d]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = naive_chains(t), naive_chains(edited), naive_chains(nxt)
        if a:
            assert len(r["fingerprint"].split(" ")) == len(a)
        for x, near in ((b, "near_edited"), (c, "near_next")):
            if a and x:
                assert r[near] == pytest.approx(len(a & x) / len(a | x))
            elif bool(a) != bool(x):
                assert r[near] == 0
    same = {}
    for d in ids:
        same.setdefault(texts[d], set()).add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert spotsigs.compare_neighbours(none).count() == 0
    one = spotsigs.compare_neighbours(docs.where(F.col("doc_id") == ROWS[0][0])).first()
    assert one["near_next"] == 1


def test_spotsigs_parts_do_not_change_results(docs, monkeypatch):
    whole = {r["doc_id"]: tuple(r) for r in spotsigs.compare_neighbours(docs).collect()}
    monkeypatch.setattr(spotsigs, "PART_BYTES", 3000)
    assert {r["doc_id"]: tuple(r) for r in spotsigs.compare_neighbours(docs).collect()} == whole


def test_spotsigs_similar(docs):
    got = {(r["a"], r["b"]) for r in spotsigs.similar(docs).collect()}
    reps = {}
    for d, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        chains = frozenset(naive_chains(t))
        if chains:
            reps.setdefault(chains, d)
    expected = {frozenset((a, b)) for x, a in reps.items() for y, b in reps.items() if a < b and len(x & y) >= 0.75 * len(x | y)}
    rep_ids = set(reps.values())
    assert {frozenset(p) for p in got if set(p) <= rep_ids} == expected and expected


def test_spotsigs_without_chains(spark):
    # no anchor words: every word counts, not the first ones only
    words = [f"слово{i}" for i in range(400)]
    texts = [" ".join(words[:200]), " ".join(words[:3] + words[200:400]), " ".join(words[:200]), " ".join([*words[:100], "другое", *words[101:200]]), "x", "x y"]
    got = {r["doc_id"]: r for r in spotsigs.compare_neighbours(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({got[i]["fingerprint"] for i in range(6)}) == 5 and got[0]["fingerprint"] == got[2]["fingerprint"]
    assert got[0]["near_next"] == pytest.approx(2 / (199 + 202 - 2))
    assert got[2]["near_next"] == pytest.approx(197 / 201)
    assert got[0]["near_edited"] < 0.7 and got[4]["near_next"] == 0


# op1


def test_language(spark):
    words = {"en": "the house and water is with they which ring", "de": "das haus und wasser ist mit sie welche schön", "fr": "la maison et eau est avec ils quelle très", "es": "la casa y agua está con ellos cuál niño"}
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(words[lang].split()) for _ in range(rnd.randint(8, 40))), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 40)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "é", None), (1004, "x " * 50_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows)
    for d, t, lang in rows[:160]:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["lang_pred"] == lang and 0 <= got[d]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[1003]["lang_pred"] in words
    assert {r["doc_id"] for r in language.accepted(docs).collect()} >= {r[0] for r in rows[:160]}
    # lang of held-out rows is never looked at, nor that of a row by its prediction
    hidden = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(hidden).collect()} == {d: r["lang_pred"] for d, r in got.items()}
    unknown = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


# op3


def counted(texts):
    ones, pairs = {}, {}
    for t in texts:
        for i, w in enumerate(t):
            ones[w] = ones.get(w, 0) + 1
            if i:
                pairs[t[i - 1], w] = pairs.get((t[i - 1], w), 0) + 1
    return ones, pairs


def test_lm_scores(docs, none, spark):
    target = spark.createDataFrame([(r[0],) for r in ROWS[:10]] + [(99999,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in lmscore.scores(docs, target).collect()}
    tokens = {r[0]: ALNUM.findall(lower(r[1])) for r in ROWS}
    tokens = {d: [*t, "</>"] if t else [] for d, t in tokens.items()}
    chosen = {r[0] for r in ROWS[:10]}
    vocabulary = {w for t in tokens.values() for w in t}
    for d, t in tokens.items():
        r = got[d]
        assert r["n_words"] == max(0, len(t) - 1)
        if not t:
            assert r["score"] is None
            continue
        losses = []
        for side in (True, False):
            ones, pairs = counted(x for e, x in tokens.items() if (e in chosen) == side and e != d)
            total, loss = sum(ones.values()), 0.0
            for i, w in enumerate(t):
                p = (ones.get(w, 0) + 1) / (total + len(vocabulary) + 1)
                if i:
                    p = (pairs.get((t[i - 1], w), 0) + lmscore.PRIOR * p) / (ones.get(t[i - 1], 0) + lmscore.PRIOR)
                loss -= math.log(p)
            losses.append(loss / len(t))
        assert (r["target_loss"], r["background_loss"], r["score"]) == pytest.approx((*losses, losses[0] - losses[1]), rel=1e-9, abs=1e-9)
    assert lmscore.scores(none, target).count() == 0
    assert lmscore.scores(docs, target.limit(0)).count() == len(ROWS)


def test_lm_estimates_sum_to_one():
    texts = [[*t, "</>"] for r in ROWS if (t := ALNUM.findall(lower(r[1])))]
    ones, pairs = counted(texts)
    total, words = sum(ones.values()), [*ones, "unknown"]
    p = {w: lmscore.alone(ones.get(w, 0), total, len(ones)) for w in words}
    assert sum(p.values()) == pytest.approx(1)
    for before in [w for w in ones if w != "</>"][:50]:
        assert sum(lmscore.behind(pairs.get((before, w), 0), ones[before], p[w]) for w in words) == pytest.approx(1)


def test_lm_scores_are_exact(spark, monkeypatch):
    # more words and pairs than any table of a fixed size holds; parts and buckets do not change results
    words = [f"w{i}" for i in range(40_000)]
    rows = [(i, " ".join(words[100 * i : 100 * i + 100])) for i in range(400)] + [(400, "w0 w1"), (None, None), (401, ""), (None, "w5"), (402, "w5"), (402, "w5")]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0,)], "doc_id long")
    run = lambda: {(r["doc_id"], r["n_words"]): r for r in lmscore.scores(docs, target).collect()}
    got = run()
    assert len(got) == len(rows) - 1 and got[None, 0]["score"] is None and got[401, 0]["n_words"] == 0
    V = 40_001
    alone = lambda n, total: (n + 1) / (total + V + 1)
    t = [alone(1, 101), (1 + lmscore.PRIOR * alone(1, 101)) / (1 + lmscore.PRIOR), lmscore.PRIOR * alone(1, 101) / (1 + lmscore.PRIOR)]
    b = [alone(0, 399 * 101 + 6), alone(0, 399 * 101 + 6), alone(399 + 3, 399 * 101 + 6)]
    assert got[400, 2]["target_loss"] == pytest.approx(-sum(map(math.log, t)) / 3)
    assert got[400, 2]["background_loss"] == pytest.approx(-sum(map(math.log, b)) / 3)
    monkeypatch.setattr(lmscore, "PART_BYTES", 30_000)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 70_000)
    again = run()
    assert set(again) == set(got) and all(again[d][1:] == pytest.approx(got[d][1:]) for d in got if got[d]["score"] is not None)


# op5


def test_licences(spark):
    filler = prose(random.Random(3), 80)
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", filler), (3, "a/b/c/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3.\n"),
        (4, "a/b/c/y.py", filler), (5, "a/b/c/z.py", f"# Licensed under the Apache License, Version 2.0.\n{filler}"), (6, "other/x.py", filler), (7, "a/w.py", None), (8, None, filler), (9, "top.py", ""),
        (10, "a/b/cc/v.py", filler), (11, "d/COPYING", filler),
    ]
    files = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, path string, text string, licence string")
    got = {r["doc_id"]: (r["licence"], r["origin"], r["source_path"]) for r in licenses.scan(files).collect()}
    assert got == {
        1: ("MIT", "own", "a/LICENSE"), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("GPL-3.0", "own", "a/b/c/LICENSE.txt"), 4: ("GPL-3.0", "inherited", "a/b/c/LICENSE.txt"), 5: ("Apache-2.0", "own", "a/b/c/z.py"),
        6: (None, "none", None), 7: ("MIT", "inherited", "a/LICENSE"), 8: (None, "none", None), 9: (None, "none", None), 10: ("MIT", "inherited", "a/LICENSE"), 11: (None, "none", None),
    }
    assert licenses.scan(files.limit(0)).count() == 0


def test_licences_in_every_file(spark):
    header = "# Licensed under the Apache License, Version 2.0.\n"
    schema = "doc_id long, path string, text string"
    hot = [(i, f"r/{i}/x.py", header + prose(random.Random(i), 30)) for i in range(20)] + [(20, "m/LICENSE", "Released under the MIT License."), (21, "m/a/x.py", None), (22, "p/x", "All rights reserved.")]
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licenses.scan(spark.createDataFrame(hot, schema)).collect()}
    assert got == {**{i: ("Apache-2.0", "own") for i in range(20)}, 20: ("MIT", "own"), 21: ("MIT", "inherited"), 22: ("proprietary", "own")}
    few = spark.createDataFrame([(1, "a/x", "Released under the MIT License."), (2, "b/x", "Released under the MIT License.")], schema)
    assert [r["licence"] for r in licenses.scan(few).collect()] == ["MIT", "MIT"]
    assert all(licenses.TELLING & set(licenses.words_of(t)) for _, t in licenses.TEMPLATES)


def test_licences_by_text_and_version(spark):
    gpl = licenses.GNU.format("", "{}")
    lines = lambda t: "\n".join("# " + t[i : i + 70] for i in range(0, len(t), 70))
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 900)
    body = "\n\nimport os\n\n" + prose(random.Random(1), 60)
    texts = {
        "GPL-2.0": lines(gpl.format("2")) + body, "GPL-3.0": lines(gpl.format("3")) + body, "GPL-1.0": gpl.format("1"), "LGPL-2.1": licenses.GNU.format("Lesser", "2.1"), "BSD-2-Clause": licenses.BSD.replace("1.", "\n\n1.").replace("2.", "\n\n2.") + "\n\n" + licenses.BSD_AS_IS,
        "BSD-3-Clause": licenses.BSD + "\n" + licenses.BSD_3 + "\n" + licenses.BSD_AS_IS, "MIT": mit.replace("Copyright.", "\n\nCopyright (c) 2020 Some Body\n\n") + body, "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.", "AGPL-3.0": licenses.GNU.format("Affero", "3"),
    }
    files = spark.createDataFrame([(i, f"f{i}/x", t) for i, t in enumerate(texts.values())], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(files).collect()}
    assert [got[i]["licence"] for i in range(len(texts))] == list(texts)
    assert all(0 <= r["margin"] <= r["similarity"] <= 1 for r in got.values())


def naive_licences(rows):
    """Plain words, TF-IDF and cosine of every line, paragraph and run; then a walk up the directories."""
    held = [r for r in rows if r[2] is not None]
    words = lambda t: WORDS.findall(lower(t))
    df = {t: sum(t in set(words(r[2])) for r in held) for t in licenses.TERMS}
    n = len(held)

    def vector(t):
        out = {}
        for w in words(t):
            out[w] = out.get(w, 0) + 1
        return {w: (1 + math.log(c)) * (math.log((n + 1) / (df.get(w, 0) + 1)) + 1) for w, c in out.items()}

    templates = [(name, vector(t)) for name, t in licenses.TEMPLATES]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    own = {}
    for i, (_, _, text) in enumerate(rows):
        blocks = [b for b in re.split(r"(?<=\n)(?:[ \t\r\x0b\x0c]*\n)+", text or "") if b.strip()]
        parts, run = [], []
        for b in [*blocks, ""]:
            if licenses.TELLING & set(words(b)):
                run.append(b)
                parts += [b, *(x for x in b.split("\n") if licenses.TELLING & set(words(x)))]
            else:
                parts += ["\n".join(run)] if run else []
                run = []
        best = (0.0, None)
        for p in parts:
            v = vector(p)
            score, _, name = max((round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 9), -j, name) for j, (name, t) in enumerate(templates))
            if score >= licenses.LEAST and score > best[0]:
                best = score, licenses.told_version(name, p)
        own[i] = best
    out = {}
    for i, (d, path, _) in enumerate(rows):
        score, name = own[i]
        folder = None if name or path is None else path.rpartition("/")[0]
        while folder is not None:
            given = sorted((-own[j][0], r[1]) for j, r in enumerate(rows) if r[1] is not None and own[j][1] and r[1].rpartition("/")[0] == folder and re.search(licenses.FILE, r[1]))
            if given:
                name = next(own[j][1] for j, r in enumerate(rows) if r[1] == given[0][1] and own[j][0] == -given[0][0])
                break
            folder = folder.rpartition("/")[0] if folder else None
        out[d] = name
    return out


WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


def test_licences_against_plain_search(spark):
    rnd = random.Random(21)
    pieces = [t for _, t in licenses.TEMPLATES]
    names = ["LICENSE", "x.py", "y.c", "COPYING.txt", "notice.md", "z"]
    rows = []
    for i in range(60):
        text = "\n\n".join(rnd.choice(["", prose(rnd, 12) + "\n" + rnd.choice(pieces), rnd.choice(pieces), prose(rnd, 25), "the license of " + prose(rnd, 4)]) for _ in range(rnd.randint(0, 3)))
        rows.append((i, "/".join([*(rnd.choice("abc") for _ in range(rnd.randint(0, 3))), rnd.choice(names)]), rnd.choice([text, text, text, None])))
    rows += [(100, None, pieces[0]), (101, "a/b/x", ""), (102, "a/b/x", pieces[5])]
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)).collect()}
    expected = naive_licences(rows)
    assert got == expected and len(set(expected.values())) > 8


def test_connected_components(spark, monkeypatch):
    from cladeframe.llm import common

    rnd = random.Random(9)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 501 + i) for i in range(40)] + [(7, 7), (-5, 3)]
    expected = {x: x for e in edges for x in e}
    for _ in expected:
        for a, b in edges:
            expected[a] = expected[b] = min(expected[a], expected[b])
    df = common.prepare(spark).createDataFrame(edges, "a long, b long").repartition(3)
    for most in (common.TASK_EDGES, 0):
        monkeypatch.setattr(common, "TASK_EDGES", most)
        got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
        assert {n: got.get(n, n) for n in expected} == expected
        assert common.connected_components(df.limit(0)).count() == 0
