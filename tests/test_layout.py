"""Packed strings, the layout of a saved index, ancestors of deep and large trees, statistics over parts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import packed
from cladeframe.functions import tree as tr
from cladeframe.operators import index as ix
from cladeframe.operators import lookup as lk
from cladeframe.operators import stats
from cladeframe.operators.hierarchy import LabelTree
from test_engine import naive, naive_runs, random_tree


def sequences(rnd, labels, n=12, size=300, letters="ACGT" * 20 + "Nacgté"):
    base = "".join(rnd.choice("ACGT") for _ in range(size))
    out = []
    for _ in range(n):
        a = rnd.randrange(size)
        out.append((rnd.randrange(labels), base[a : a + rnd.randint(1, size // 2)] + "".join(rnd.choice(letters) for _ in range(rnd.randint(0, size // 3)))))
    return out


def frame(spark, seqs):
    return spark.createDataFrame(seqs, "label int, seq string").repartition(3)


@pytest.mark.parametrize("s", [1, 5, 31, 32, 33, 63, 64, 65, 200, 256])
def test_packing_keeps_strings_and_order(spark, s):
    rnd = random.Random(s)
    mers = sorted({"".join(rnd.choice("ACGT"[: rnd.randint(1, 4)]) for _ in range(rnd.choice((1, s, rnd.randint(1, s))))) for _ in range(300)}, key=lambda x: x[::-1])
    df = spark.createDataFrame([(m,) for m in mers], "mer string").select("mer", *(c.alias(n) for n, c in packed.pack(F.col("mer"), s).items()), F.length("mer").alias("n"))
    rows = df.repartition(3).orderBy(*packed.columns(s), "n").withColumn("again", packed.unpack(s, F.col("n"))).collect()
    assert [r["mer"] for r in rows] == mers == [r["again"] for r in rows]
    # what neighbours have in common, and the numbers of shorter endings
    words = [np.array([r[c] for r in rows]).view(np.uint64) for c in packed.columns(s)]
    common = [next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b))) for a, b in zip(mers, mers[1:])]
    assert packed.alike(words, np.array([r["n"] for r in rows])).tolist() == common
    k = max(1, s - 3)
    long = df.where(F.col("n") >= k)
    short = long.select(*(c.alias(n) for n, c in packed.shortened(k).items()), F.right("mer", F.lit(k)).alias("end"))
    assert all(r["end"] == r["again"] for r in short.withColumn("again", packed.unpack(k, k)).collect())


@pytest.mark.parametrize("s, piece", [(7, 16), (40, 64), (70, 32)])
def test_strings_of_pieces(spark, monkeypatch, s, piece):
    """Sequences cut to short pieces, on both strands: the same strings, each as often."""
    rnd = random.Random(s)
    seqs = sequences(rnd, 3) + [(0, ""), (1, "A"), (2, "NNN"), (0, "éACGTé😀ACG")]
    expected = {}
    for label, seq in seqs:
        for run in "".join(c if c in "ACGT" else " " for c in seq.replace("a", "A").replace("c", "C").replace("g", "G").replace("t", "T")).split():
            for r in (run, run[::-1].translate(str.maketrans("ACGT", "TGCA"))):
                for e in range(1, len(r) + 1):
                    key = label, r[max(0, e - s) : e]
                    expected[key] = expected.get(key, 0) + 1
    monkeypatch.setattr(packed, "PIECE", piece)
    monkeypatch.setattr(packed, "CHUNK", 100)
    got = packed.strings(frame(spark, seqs).withColumnRenamed("label", "tin"), s).select("tin", packed.unpack(s, F.col("n")).alias("mer")).groupBy("tin", "mer").count().collect()
    assert {(r["tin"], r["mer"]): r["count"] for r in got} == expected


def scanned(df):
    """Files and rows that the scans of a collected result read."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(plan.plan())
        else:
            yield plan
            children = plan.children()
            for i in range(children.size()):
                yield from walk(children.apply(i))

    files = rows = 0
    for plan in walk(df._jdf.queryExecution().executedPlan()):
        if plan.getClass().getSimpleName() == "FileSourceScanExec":
            files += plan.metrics().apply("numFiles").value()
            rows += plan.metrics().apply("numOutputRows").value()
    return files, rows


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """An index of 63 letters in 16 parts, with small pages."""
    path = str(tmp_path_factory.mktemp("saved") / "ix")
    rnd = random.Random(9)
    seqs = [(i % 3, "".join(rnd.choice("ACGT") for _ in range(8000))) for i in range(6)]
    index = ix.build(frame(spark, seqs), LabelTree.star(["a", "b", "c"]), 63)
    before, ix.PAGE_ROWS = ix.PAGE_ROWS, 128
    index.save(path, parts=16)
    ix.PAGE_ROWS = before
    return path, seqs, index.cache()


@pytest.mark.parametrize("k", [12, 31, 40, 63])
def test_lookup_reads_what_it_asks_for(spark, saved, k):
    path, seqs, index = saved
    held = ix.load(spark, path)
    n = held.positions.count()
    assert n == index.positions.count() and len(held.parts.numbers) == 16
    for count in (1, 40):
        asked = spark.createDataFrame([(seqs[i % 6][1][i * 100 : i * 100 + k],) for i in range(count)], "kmer string").distinct()
        numbers = asked.select(*(c.alias(x) for x, c in packed.pack(F.col("kmer"), k).items()))
        found = held.packed_labels(k, numbers)
        rows = found.collect()
        files, read = scanned(found)
        assert len(rows) == asked.count() and read <= 300 * count
        assert files <= min(count + 1, 16)
        plain = {r["kmer"]: r["label"] for r in index.kmer_labels(k).join(F.broadcast(asked), "kmer").collect()}
        assert {r["kmer"]: r["label"] for r in held.kmer_labels(k, numbers).collect()} == plain


def test_lookup_of_a_saved_index_at_every_length(spark, saved, monkeypatch):
    path, seqs, index = saved
    held = ix.load(spark, path)
    rnd = random.Random(3)
    queries = [(i, seqs[i][1][j : j + 120] + "N" + "".join(rnd.choice("ACGT") for _ in range(80))) for i, j in enumerate((0, 500, 7000))]
    qf = spark.createDataFrame([(i, f"q{i}", s) for i, s in queries], "query_rank long, query_name string, seq string")
    for k in (1, 6, 31, 33, 63):
        expected = naive_runs(queries, naive(seqs, index.labels, k), k)
        for pushed in (ix.PUSHED, 5):
            monkeypatch.setattr(ix, "PUSHED", pushed)
            got = lk.lookup(qf, held, k, misses=True).collect()
            assert sorted(((r["query_rank"], r["from_kmer"], r["to_kmer"], r["label"]) for r in got), key=str) == expected
        monkeypatch.undo()


def test_save_of_nothing(spark, tmp_path):
    index = ix.build(frame(spark, [(0, "NNN")]), LabelTree.star(["a"]), 5)
    index.save(f"{tmp_path}/ix")
    held = ix.load(spark, f"{tmp_path}/ix")
    q = spark.createDataFrame([(0, "q", "ACGTAC")], "query_rank long, query_name string, seq string")
    assert [tuple(r) for r in lk.lookup(q, held, 3, misses=True).collect()] == [(0, "q", 0, 4, None, None)]
    assert stats.run_stats(held).first()["run_max"] == 1 and stats.node_stats(held).selectExpr("sum(count)").first()[0] == 0


# trees


def deep(n):
    return LabelTree.from_ids(n, [(i, i - 1) for i in range(1, n)])


def test_ancestors_equal_plain_ones(spark, monkeypatch):
    rnd = random.Random(1)
    for tree in (random_tree(rnd, 1), random_tree(rnd, 2), random_tree(rnd, 90), deep(200), LabelTree.star([str(i) for i in range(70)])):
        n = len(tree)
        pairs = [(a, b) for a in range(0, n, 1 + n // 40) for b in range(n)]
        lo, hi = (np.array([f(tree.tin[a], tree.tin[b]) for a, b in pairs]) for f in (min, max))
        expected = [tree.lca(a, b) for a, b in pairs]
        assert tr.Ancestors(tree).of(lo, hi).tolist() == expected
        if n < 100:
            df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(lo, hi))] + [(-1, None, None)], "i long, lo int, hi int")
            for inline in (512, 0):
                monkeypatch.setattr(tr, "INLINE", inline)
                got = {r["i"]: r["label"] for r in tr.with_lca(df, tree).collect()}
                assert got == dict(enumerate(expected)) | {-1: None}
            monkeypatch.undo()


def test_ancestors_of_large_trees(spark):
    chain, rnd = deep(100_000), np.random.default_rng(1)
    pairs = np.sort(rnd.integers(0, 100_000, (20_000, 2)), axis=1)
    df = spark.createDataFrame(pairs.tolist(), "lo int, hi int")
    began = time.time()
    assert tr.with_lca(df.withColumn("low", F.col("lo")), chain).where("label = low").count() == len(pairs)  # of a chain, the upper one
    n = 2_000_000
    parents = (np.arange(n) - 1) // 2
    parents[0] = 0
    tree = LabelTree(tuple(map(str, range(n))), tuple(parents.tolist()))
    a, b = rnd.integers(0, n, (2, 20_000))
    tin = np.array(tree.tin)
    x, y = a.copy(), b.copy()
    while (x != y).any():  # the larger number of a heap is never the ancestor
        x, y = np.where(x > y, (x - 1) // 2, x), np.where(y > x, (y - 1) // 2, y)
    assert tr.Ancestors(tree).of(np.minimum(tin[a], tin[b]), np.maximum(tin[a], tin[b])).tolist() == x.tolist()
    assert time.time() - began < 60


def test_names_of_large_trees_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tr, "INLINE", 0)
    tree = LabelTree.star(["a", "b"])
    index = ix.build(frame(spark, [(0, "ACGTT"), (1, "TTACG")]), tree, 3)
    q = spark.createDataFrame([(0, "q", "ACGTTA")], "query_rank long, query_name string, seq string")
    assert [tuple(r)[2:] for r in lk.lookup(q, index, 3).orderBy("from_kmer").collect()] == [(0, 2, 2, "root"), (2, 3, 0, "a"), (3, 4, 1, "b")]


# statistics


@pytest.mark.parametrize("s, parts, batch", [(6, 1, 10_000), (6, 5, 3), (40, 7, 16), (70, 3, 64)])
def test_statistics_over_parts_and_batches(spark, s, parts, batch):
    rnd = random.Random(s + parts)
    tree = random_tree(rnd, 9)
    seqs = sequences(rnd, 9, size=120)
    index = ix.build(frame(spark, seqs), tree, s).cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r["k"], r["label"]): r["count"] for r in stats.node_stats(index, parts).collect()}
        row = stats.run_stats(index, parts).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in range(1, s + 1):
        expected = naive([(a, "".join(c if c in "ACGTacgt" else "N" for c in x)) for a, x in seqs], tree, k)
        assert [found[k, i] for i in range(9)] == [sum(v == i for v in expected.values()) for i in range(9)]
    order = [None] + [x for _, x in sorted((r["mer"][::-1], r["label"]) for r in index.position_labels().collect())]
    cuts = [0] + [i for i in range(1, len(order)) if order[i] != order[i - 1]] + [len(order)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    assert (row["run_min"], row["run_max"], row["run_mean"]) == (min(sizes), max(sizes), pytest.approx(sum(sizes) / len(sizes)))
    assert row["labelled"] == len(order) - 1 and row["unlabelled"] == 1


def test_node_stats_move_positions_once(spark):
    """What is shuffled does not grow with s, and strings of one ending are dealt out."""
    rnd = random.Random(2)
    seqs = [(0, "".join(rnd.choice("ACGT") for _ in range(3000)))] + [(1, "".join(rnd.choice("AC") for _ in range(30)) + "ACGTACGTACGT") for _ in range(400)]
    index = ix.build(frame(spark, seqs), LabelTree.star(["a", "b"]), 40).cache()
    n = index.positions.count()
    plan = stats.node_stats(index)._jdf.queryExecution().toString()
    assert "Generate explode(sequence(1, n" not in plan
    sizes = index.sorted(8).groupBy("part").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 0.3 * n
