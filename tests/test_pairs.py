"""Strings of one strand for both, positions dealt by their endings, short strings merged by the tasks that make them."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cladeframe import queries as core
from cladeframe.functions import kmers, packed
from cladeframe.operators import index as ix
from cladeframe.operators import lookup as lk
from cladeframe.operators.hierarchy import LabelTree
from test_engine import naive, naive_runs, random_tree
from test_layout import frame, sequences


def seqs_of(seed, labels):
    rnd = random.Random(seed)
    more = [(0, "A" * 90), (1, "AT" * 60), (2, "ACGT" * 30), (0, ""), (1, "NNN"), (2, "A"), (0, "acgtéACGTACGTTGCA😀ACGATCGATTTACGCG" * 3)]
    return sequences(rnd, labels, 8, 250) + more


def plans(df):
    """The operators of a result's plan, of all its stages."""

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

    return list(walk(df._jdf.queryExecution().executedPlan()))


def dealt_by_key(df):
    return sum(p.getClass().getSimpleName() == "ShuffleExchangeExec" and "hashpartitioning" in p.simpleString(1000) for p in plans(df))


@pytest.mark.parametrize("k", [12, 15, 31, 32, 33, 64, 65])
def test_direct_by_pairs(spark, k):
    """each string and its reverse complement once, palindromes too, with the labels of both strands."""
    seqs, tree = seqs_of(k, 3), random_tree(random.Random(k), 3)
    got = [tuple(r) for r in ix.direct(frame(spark, seqs), tree, k).select("kmer", "label").collect()]
    assert len(got) == len(dict(got)) and dict(got) == naive(seqs, tree, k)


def test_direct_moves_one_strand(spark):
    """no more rows are dealt than one strand has windows."""
    seqs = seqs_of(5, 3)
    df = ix.direct(frame(spark, seqs), LabelTree.star(["a", "b", "c"]), 31)
    rows = len(df.collect())
    moved = max(p.metrics().apply("shuffleRecordsWritten").value() for p in plans(df) if p.getClass().getSimpleName() == "ShuffleExchangeExec")
    assert rows == len(naive(seqs, LabelTree.star(["a", "b", "c"]), 31)) and moved <= sum(max(len(s) - 30, 0) for _, s in seqs)


@pytest.mark.parametrize("s, k", [(12, 12), (31, 12), (31, 15), (40, 31), (63, 31), (70, 33), (70, 64), (96, 32), (20, 5)])
def test_lookup_and_roll_up_by_pairs(spark, monkeypatch, s, k):
    """as the definition has them, in many pieces, whichever strand a query's window is of."""
    monkeypatch.setattr(lk, "ASKED", 0)
    monkeypatch.setattr(packed, "PIECE", 128)
    rnd = random.Random(s * 100 + k)
    seqs, tree = seqs_of(s + k, 4), random_tree(rnd, 4)
    labels, index = naive(seqs, tree, k), ix.build(frame(spark, seqs), tree, s)
    assert sorted(map(tuple, index.kmer_labels(k).select("kmer", "label").collect())) == sorted(labels.items())
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    queries = [(0, seqs[0][1] + "N" + turned(seqs[1][1].replace("é", "N"))), (1, "ACGT" * 40), (2, "T" * 99), (3, "AC")]
    qf = spark.createDataFrame([(i, f"q{i}", q) for i, q in queries], "query_rank long, query_name string, seq string")
    got = lk.lookup(qf, index, k, misses=True).collect()
    assert sorted(((r["query_rank"], r["from_kmer"], r["to_kmer"], r["label"]) for r in got), key=str) == naive_runs(queries, labels, k)


def test_roll_up_moves_positions_once(spark):
    """positions are dealt by the endings that they are rolled up to, so a roll-up moves nothing again."""
    index = ix.build(frame(spark, seqs_of(1, 3)), LabelTree.star(["a", "b", "c"]), 63)
    for k in (15, 31, 40):
        df = index.kmer_labels(k)
        df.collect()
        assert dealt_by_key(df) == 1


def test_pairs_only_of_whole_indexes(spark, tmp_path):
    """What is read, cached, of one strand or of a universe has no sequences to go back to."""
    seqs = frame(spark, seqs_of(2, 3))
    tree = LabelTree.star(["a", "b", "c"])
    index = ix.build(seqs, tree, 20)
    index.save(f"{tmp_path}/ix")
    others = [ix.load(spark, f"{tmp_path}/ix"), index.cache(), index.none_to_root(), ix.build(seqs, tree, 20, forward_only=True), ix.build(seqs, tree, 20, within=ix.universe(seqs, 20))]
    assert index.paired_labels(15) is not None and all(i.paired_labels(15) is None for i in others)


@pytest.mark.parametrize("merged", [64, 1 << 21])
@pytest.mark.parametrize("s", [1, 6, 8, 14])
def test_short_strings_leave_a_task_once(spark, monkeypatch, s, merged):
    """F3 to F6, F8: a task of the index hands on each of its short strings once, not each window."""
    monkeypatch.setattr(packed, "MERGED", merged)
    monkeypatch.setattr(packed, "CHUNK", 100)
    seqs, tree = seqs_of(s, 3) * 5, random_tree(random.Random(s), 3)
    index = ix.build(frame(spark, seqs), tree, s)
    assert {r["mer"]: r["label"] for r in index.position_labels().where(F.length("mer") == s).collect()} == naive(seqs, tree, s)
    known = frame(spark, seqs).withColumnRenamed("label", "tin")
    found = packed.spans(known, s)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    if merged > len(rows):
        assert len(rows) == len({(r["task"], r["w0"], r["n"]) for r in rows}) < packed.strings(known, s).count()


def test_lookup_of_short_strings_counts_its_windows(spark):
    """what the lookup saw, when the index hands on merged strings."""
    seqs = seqs_of(3, 3)
    seen = Observation("w")
    qf = spark.createDataFrame([(0, "q", seqs[0][1])], "query_rank long, query_name string, seq string")
    lk.lookup(qf, ix.build(frame(spark, seqs), LabelTree.star(["a", "b", "c"]), 8), 8, seen=seen).collect()
    assert seen.get["n_kmers"] == len(seqs[0][1]) - 7


def test_spans_without_a_place(spark):
    """Strings of labels that the tree lacks stay, without a span of their own."""
    known = spark.createDataFrame([(None, "ACGT"), (4, "ACG"), (2, "ACG")], "tin int, seq string").coalesce(1)
    rows = packed.spans(known, 3, forward_only=True).groupBy("w0", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(packed.unpack(3, F.col("n")).alias("mer"), "lo", "hi").collect()
    assert {r["mer"]: (r["lo"], r["hi"]) for r in rows} == {"A": (2, 4), "AC": (2, 4), "ACG": (2, 4), "CGT": (None, None)}


def documents(spark, path):
    """A table of documents whose texts are mostly other characters, some null, and a table of items."""
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("acgtACGT....  xyzé😀\n") for _ in range(rnd.randrange(400))), rnd.choice(["de", "en", "es", "fr", "xx"])) for i in range(60)]
    spark.createDataFrame([*rows, (60, None, "fr"), (61, "", "de"), (62, "xyz é", "en")], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t, _ in rows[:9]], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_letters_of_texts(spark, tmp_path, monkeypatch, chunk):
    """what numpy takes out of texts is what the expression does, null and empty texts too, in small groups of rows."""
    monkeypatch.setattr(packed, "CHUNK", chunk)
    texts = spark.read.parquet(f"{documents(spark, tmp_path)}/documents.parquet")
    expected = texts.select("doc_id", "lang", kmers.bases(F.col("text")).alias("seq"))
    got = packed.letters(texts)
    assert got.columns == expected.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert packed.letters(texts.where("false")).collect() == []


def test_texts_are_not_dealt(spark, tmp_path):
    """F4 to F8: only the letters of texts are dealt, in pieces, not the texts before."""
    path = documents(spark, tmp_path)
    for df in (core.labelled(spark, path), core.asking(spark, path)):
        df.collect()
        assert not any(p.getClass().getSimpleName() == "ShuffleExchangeExec" for p in plans(df))


def test_difference_reads_documents_once(spark, tmp_path):
    """both lengths are looked up in one index, whose dealt pieces are used again."""
    df = core.matrix_diff(spark, documents(spark, tmp_path))
    assert df.collect()
    names = [p.getClass().getSimpleName() for p in plans(df)]
    pieces = [p for p in plans(df) if p.getClass().getSimpleName() == "ShuffleExchangeExec" and "RoundRobin" in p.simpleString(1000)]
    assert "ReusedExchangeExec" in names and sum("tin" in p.output().mkString(" ") for p in pieces) == 1


@pytest.mark.parametrize("forward_only", [False, True])
@pytest.mark.parametrize("s, whole", [(1, False), (2, False), (5, True), (8, False), (9, False), (10, True)])
def test_tables_of_short_strings(spark, monkeypatch, s, whole, forward_only):
    """the table of a task has what strings() has, each string once however small the merged rows are, of sequences in
    many pieces, of ones cut by the caller, and of labels that the tree lacks."""
    monkeypatch.setattr(packed, "MERGED", 64)
    monkeypatch.setattr(packed, "CHUNK", 100)
    monkeypatch.setattr(packed, "PIECE", 16)
    rnd = random.Random(s)
    seqs = [*seqs_of(s, 3), (None, "ACGTTTGNACCA"), (None, "GATTACA" * 9), (1, "ACNNGT"), (2, "GT" * 9)]
    whole_rows = spark.createDataFrame([(rnd.randrange(9) if t is not None else t, x) for t, x in seqs], "tin int, seq string")
    cut = packed.pieces(whole_rows, "seq", s + 2, s + 1)
    for known in (whole_rows, cut):
        each = packed.strings(known, s, forward_only, whole).groupBy("w0", "n").agg(F.min("tin").alias("lo"), F.max("tin").alias("hi"))
        rows = packed.spans(known, s, forward_only, whole)
        spans = rows.groupBy("w0", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        assert sorted(map(tuple, spans.collect()), key=str) == sorted(map(tuple, each.collect()), key=str)
        told = rows.where("lo is not null").withColumn("task", F.spark_partition_id()).collect()
        assert len(told) == len({(r["task"], r["w0"], r["n"]) for r in told})


def dealt_evenly(df):
    """Numbers of tasks that pieces without a label, which are those of queries, are dealt to."""
    found = [p for p in plans(df) if p.getClass().getSimpleName() == "ShuffleExchangeExec" and "query_rank" in p.output().mkString(" ") and "lead" in p.output().mkString(" ")]
    return [p.outputPartitioning().numPartitions() for p in found]


def test_few_windows_are_one_task(spark):
    """as many tasks make a lookup's windows as these are worth, not all of them."""
    seqs = seqs_of(6, 3)
    qf = spark.createDataFrame([(i, f"q{i}", seqs[i][1]) for i in range(5)], "query_rank long, query_name string, seq string")
    df = lk.lookup(qf, ix.build(frame(spark, seqs), LabelTree.star(["a", "b", "c"]), 8), 8, misses=True)
    assert df.collect()
    assert dealt_evenly(df) and set(dealt_evenly(df)) == {1}
    assert packed.tasks_for(qf, 10**12) == packed.tasks_of(qf) == 4 and packed.tasks_for(qf, 0) == 1 and packed.tasks_for(qf, packed.CHUNK + 1) == 2


@pytest.mark.parametrize("k", [12, 15, 17])
def test_roll_up_hands_on_endings_once(spark, monkeypatch, k):
    """a task rolls up its own positions, and few large tasks do not take what many were to have."""
    seqs, tree = seqs_of(k, 3) * 5, LabelTree.star(["a", "b", "c"])
    df = ix.build(frame(spark, seqs), tree, 31).kmer_labels(k)
    assert {r["kmer"]: r["label"] for r in df.collect()} == naive(seqs, tree, k)
    dealt = [p for p in plans(df) if p.getClass().getSimpleName() == "ShuffleExchangeExec" and "hashpartitioning" in p.simpleString(1000)]
    moved, windows = dealt[0].metrics().apply("shuffleRecordsWritten").value(), sum(max(len(s) - k + 1, 0) for _, s in seqs)
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0].simpleString(1000) and moved <= 0.8 * windows
    monkeypatch.setattr(packed, "MERGED", 64)
    bare = frame(spark, seqs).union(spark.createDataFrame([(None, "T" * 40), (None, "GCA" * 20)], "label int, seq string"))
    assert {r["kmer"]: r["label"] for r in ix.build(bare, tree, 31).kmer_labels(k).collect()} == naive(seqs, tree, k) | {x: naive(seqs, tree, k).get(x) for x in naive([(0, "T" * 40), (0, "GCA" * 20)], tree, k)}


def test_debug_lookup_of_few_items(spark, tmp_path):
    """F8: the items are dealt to one task."""
    df = core.lookup_debug(spark, documents(spark, tmp_path))
    assert df.collect()
    assert dealt_evenly(df) and set(dealt_evenly(df)) == {1}
