"""Spelling variants, fill-in-the-middle and neighbours against plain versions, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import middle, neighbours, spelling

SCHEMA = "doc_id long, text string, word string, n long, id long, output string, form string"


def table(spark, texts):
    """Texts with ids, and columns named like the operators' own."""
    return spark.createDataFrame([(d, t, "x", 1, 2, "y", "z") for d, t in texts], SCHEMA).repartition(3)


# spelling


def naive_variants(texts, damage=97, least=3):
    count = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        found = [x for x in words if x != w and near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = (form[w], n, len(found), words[form[w]] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def misspelled(seed=5):
    rnd = random.Random(seed)
    base = ["language", "straße", "aaaaaa", "aaaaa", "übermäßig", "naïveté", "listen", "silent", "enlist", "banana", "bananas", "anagram", "nagaram", "x" * 70, "ab" * 50, "a×b÷cdé"]
    texts = []
    for i in range(150):
        words = []
        for _ in range(30):
            w = rnd.choice(base)
            if rnd.random() < 0.4:
                at, c = rnd.randrange(len(w) + 1), rnd.choice("abcdé")
                w = rnd.choice((w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]))
            words.append(w.upper() if rnd.random() < 0.1 else w)
        texts.append((i, " ".join(words) + rnd.choice((".", "1", "\n", "日本", ""))))
    return [*texts, (None, "language " * 9), (3, None), (4, ""), (5, "日本 12"), texts[0], texts[0]]


@pytest.mark.parametrize("exact, slice_", [(64, 1 << 20), (4, 64)])
def test_variants(spark, monkeypatch, exact, slice_):
    # the second time by digests of what is left, and texts in slices
    monkeypatch.setattr(spelling, "SLICE", slice_)
    texts = misspelled()
    if exact == 64:
        got = spelling.variants(table(spark, texts), damage=97)
        rows = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()}
        assert rows == naive_variants(texts) and len(rows) > 100 and sum(r[0] is not None for r in rows.values()) > 50
        undamaged = spelling.variants(table(spark, texts), damage=None, least_count=2)
        assert {r["word"]: r["n_near"] for r in undamaged.collect()} == {w: r[3] for w, r in naive_variants(texts, damage=1 << 40, least=2).items()}
    text = " ".join(t for _, t in texts if t).encode()
    assert [r for part in spelling.runs(text) for r in part] == [m.encode() for m in re.findall("[A-Za-zÀ-ÿ]+", text.decode())]


def test_rest_of_long_words(monkeypatch):
    """Letters left over are told apart by digests as they are by themselves."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(4, 7))).encode() for _ in range(150)]
    for exact in (64, 3):
        monkeypatch.setattr(spelling, "EXACT", exact)
        seen = [(key, rest, place, w if place < 0 else w[:place] + w[place + 1 :]) for w in words for place, (key, rest) in enumerate(spelling._left(w), -1)]
        assert len({(k, r) for k, r, _, _ in seen}) == len({p for *_, p in seen}) == len({(k, r, p) for k, r, _, p in seen})


def test_variants_of_nothing(spark):
    assert spelling.variants(table(spark, [(1, "one two")]).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, "1 2 3")])).count() == 0
    long = "q" * 3000
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.variants(table(spark, [(1, f"{long} {long} {long} {long}q " + f"{long}q " * 8)])).collect()}
    assert got == {long: (long + "q", 1), long + "q": (None, 1)}
    with pytest.raises(ValueError):
        spelling.variants(table(spark, [(1, "a")]), ratio=1)


def test_chains_of_forms(spark):
    """Each form twice as frequent: the root is at the end of a long chain."""
    chain = ["a" * (5 + i) + "zz" for i in range(9)]
    texts = [(i, f"{w} " * (3 << i)) for i, w in enumerate(chain)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(table(spark, texts)).collect()}
    assert got == {w: (chain[i + 1] if i < 8 else None, chain[-1]) for i, w in enumerate(chain)}


# fill in the middle


def naive_middle(d, t):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    a, b, _, c = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    a, b = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if c % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def lined(seed=3):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(("a", "é", "日", "😀", "\n", "\r\n", "<", "S>", " ")) for _ in range(rnd.randint(1, 300))) for _ in range(150)]
    texts += [None, "", "\n", "\n\n\n", "one line", "a <S> b", "x<M>", "<P", "<", "\n".join(map(str, range(30_000)))]
    return [(i * 13, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (5, "twice\nover"), (5, "twice\nover")]


@pytest.mark.parametrize("size", [4096, 3])
def test_middle(spark, monkeypatch, size):
    monkeypatch.setattr(middle, "LEAF", size)
    monkeypatch.setattr(middle.rope, "__defaults__", (size,))
    texts = lined() if size == 4096 else [x for x in lined() if len(x[1] or "") < 1000]
    for d, t in texts:
        made = middle.rearrange(t, middle.numbers(d, 7), 100, 50)
        assert made == naive_middle(d, t) and middle.restore(made[-1], made[1]) == (t or "")


def test_middle_in_tasks(spark):
    texts = lined()
    made = middle.rearranged(table(spark, texts))
    back = middle.restored(made.withColumn("restored", F.lit(1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = sorted(((d, *naive_middle(d, t)[:4], sha(naive_middle(d, t)[4]), sha(t or "")) for d, t in texts), key=str)
    assert sorted((tuple(r) for r in middle.digest(made).collect()), key=str) == expected
    assert {r["restored"] for r in back.collect()} == {t or "" for _, t in texts}
    assert middle.digest(middle.rearranged(table(spark, texts).limit(0))).count() == 0
    assert {r["form"] for r in middle.rearranged(table(spark, texts), percent=0).collect()} == {"plain"}


def test_rope_stays_balanced():
    text = "".join(f"{i}\n" for i in range(5000))
    tree, rnd = middle.rope(text, 16), random.Random(1)
    for _ in range(40):
        a, b = middle.split(tree, rnd.randrange(5001), rnd.choice(("units", "chars")))
        tree = middle.concat(a, b)
        assert "".join(middle.leaves(tree)) == text and (tree.units, tree.chars) == (5000, len(text))
    assert tree.height <= 2 * len(text).bit_length()


# neighbours


def naive_neighbours(rows, every=100, k=10):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows.items() if i != q)[:k]
            out[q] = [i for _, i in near], [d for d, _ in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        ids, scores = out.setdefault(r["query_id"], ([], []))
        ids.append(r["vec_id"])
        scores.append(r["score"])
        assert r["rank"] == len(ids)
    return out


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, list string, rank int, v double").repartition(4)


def test_neighbours_recall(spark, monkeypatch):
    """Clusters, a vector that a third of the rows have, and noise; lists and blocks small."""
    for name, value in (("LIST_ROWS", 64), ("BLOCK", 32), ("SAMPLE", 1024)):
        monkeypatch.setattr(neighbours, name, value)
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 16)) * 0.4 + rnd.normal(size=(12, 16))[rnd.integers(0, 12, 3000)]
    x[::3] = x[0]
    rows = {i: v for i, v in enumerate(x.tolist())}
    exact, got = naive_neighbours(rows), found(neighbours.search(vectors(spark, rows.items())))
    assert set(got) == set(exact) and all(len(got[q][0]) == 10 for q in got)
    hits = [len(set(got[q][0]) & set(exact[q][0])) for q in got]
    assert sum(hits) >= 0.9 * 10 * len(hits)
    for q, (ids, scores) in got.items():
        assert q not in ids and np.allclose(scores, [np.sqrt(((x[i] - x[q]) ** 2).sum()) for i in ids], rtol=1e-12, atol=0)
        assert list(zip(scores, ids)) == sorted(zip(scores, ids))
    assert got[300] == exact[300] and got[300][0] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]


def test_neighbours_of_few(spark):
    for n in (0, 1, 2, 7, 25):
        rows = {i * 50: [float(i % 4), 1.0, float(i)] for i in range(n)}
        assert found(neighbours.search(vectors(spark, rows.items()))) == {q: x for q, x in naive_neighbours(rows).items() if x[0]}


def test_neighbours_that_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [3.5, 1.0]), (200, [7.0, 1.0])]
    bad = [(None, [1.0, 1.0]), (300, None), (400, [0.0, 0.0]), (500, [1.0, None]), (600, [float("nan"), 1.0]), (700, [float("inf"), 1.0]), (800, []), (900, [1.0, 2.0, 3.0])]
    again = [(100, [3.5, 1.0]), (200, [9.0, 1.0]), (200, [7.0, 5.0])]  # the least vector of an id stands
    assert found(neighbours.search(vectors(spark, good + bad + again))) == naive_neighbours(dict(good))
    assert found(neighbours.search(vectors(spark, good + bad, "float"))) == naive_neighbours(dict(good))
    assert neighbours.search(vectors(spark, bad)).count() == 0


def test_short_lists_are_made_up(spark):
    """Where the lists within the ratio hold too few vectors, further ones are read."""
    lists = neighbours.Lists(np.array([[0.0, 0.0], [1.0, 0.0], [9.0, 0.0]]))
    lists.ratio = 1.1
    row, of = lists.reading(np.array([[0.1, 0.0], [8.0, 0.0]]), np.array([2, 3, 50]), 5)
    assert sorted(zip(row.tolist(), of.tolist())) == [(0, 0), (0, 1), (1, 2)]


def test_walk_reaches_what_is_near():
    rnd = np.random.default_rng(4)
    c, x = rnd.normal(size=(900, 8)), rnd.normal(size=(64, 8))
    lists, exact = neighbours.Lists(c), neighbours.squares(x, c)
    seen = lists.walk(x, 1.3)
    assert np.allclose(seen.min(1), exact.min(1)) and np.isfinite(seen).mean() < 0.9
    within = exact <= exact.min(1, keepdims=True) * 1.3**2
    assert (np.isfinite(seen) & within).sum() >= 0.98 * within.sum()
