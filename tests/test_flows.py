"""Longest matches, records in pieces, ordered output, SQL functions, streams."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cladeframe import cli
from cladeframe.functions import packed, sqlfunctions
from cladeframe.operators import index as ix
from cladeframe.operators import lookup as lk
from cladeframe.operators import matching
from cladeframe.operators.hierarchy import HierarchyError, LabelTree
from cladeframe.sources import readers, writers
from cladeframe.streaming.lookup import follow, watch
from test_engine import naive, naive_runs, random_tree
from test_layout import frame, sequences


def ascii_only(seqs):
    return [(a, "".join(c if c in "ACGTacgt" else "N" for c in x)) for a, x in seqs]


@pytest.mark.parametrize("s, parts, batch", [(5, 6, 7), (12, 1, 10_000), (40, 9, 16), (70, 4, 50)])
def test_longest_matches(spark, tmp_path, s, parts, batch):
    """Against a search of every length at every letter; parts so small that ranges of short strings span several."""
    rnd = random.Random(s)
    tree, seqs = random_tree(rnd, 7), ascii_only(sequences(rnd, 7, 8, 150))
    ix.build(frame(spark, seqs), tree, s).save(f"{tmp_path}/ix", parts=parts)
    queries = [(i, x[:90] + "".join(rnd.choice("ACGTN") for _ in range(40))) for i, (_, x) in enumerate(seqs[:4])] + [(9, ""), (10, "NN"), (11, "T" * 100), (12, "a")]
    labels = {k: naive(seqs, tree, k) for k in range(1, s + 1)}
    expected = {}
    for i, q in queries:
        for e in range(len(q)):
            m = next((m for m in range(min(s, e + 1), 0, -1) if q[e + 1 - m : e + 1].upper() in labels[m]), 0)
            expected[i, e] = (m, labels[m][q[e + 1 - m : e + 1].upper()] if m else None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = matching.longest(spark.createDataFrame(queries, "query_rank long, seq string"), ix.load(spark, f"{tmp_path}/ix")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["query_rank"], r["pos"]): (r["length"], r["label"]) for r in rows} == expected and len(rows) == len(expected)


def test_longest_matches_of_little(spark):
    tree, q = LabelTree.star(["a"]), spark.createDataFrame([(0, "ACN")], "query_rank long, seq string")
    for seqs, lengths in (([(0, "NNN")], [0, 0, 0]), ([(0, "A")], [1, 0, 0])):
        rows = matching.longest(q, ix.build(frame(spark, seqs), tree, 4, forward_only=True)).orderBy("pos").collect()
        assert [r["length"] for r in rows] == lengths
    within = ix.universe(spark.createDataFrame([("ACG",)], "seq string"), 3, forward_only=True)  # strings without labels count
    rows = matching.longest(q, ix.build(frame(spark, [(0, "TT")]), tree, 3, True, within)).orderBy("pos").collect()
    assert [(r["length"], r["label"]) for r in rows] == [(1, None), (2, None), (0, None)]


def test_pieces_of_long_records(spark, tmp_path):
    """Lines as rows, over many splits: index and lookup are those of whole records, none of which is ever a row."""
    rnd = random.Random(7)
    records = [(f"r{i}", "".join(rnd.choice("ACGTACGTACGTNacgt") for _ in range(n))) for i, n in enumerate((0, 1, 59, 60, 61, 700, 2500, 10))]
    (tmp_path / "a.fa").write_text("\n" + "\n".join(f">{n} x\r\n" + "\r\n".join(s[j : j + 60] for j in range(0, len(s), 60)) for n, s in records))
    (tmp_path / "b.fa").write_text(f">one long line\n{records[6][1]}\n>two\nACGT\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        size, s = 128, 21
        cut = readers.read_pieces(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"], s - 1, s - 1, size).persist()
        rows = cut.collect()
        assert len(rows) > 40 and max(len(r["seq"]) for r in rows) <= size + 2 * (s - 1)
        own = {}
        for r in sorted(rows, key=lambda r: r["offset"]):
            own.setdefault((r["file"][-4:], r["seq_rank"]), []).append(r["seq"][r["lead"] : r["lead"] + r["own"]])
        whole = {("a.fa", i): x for i, (_, x) in enumerate(records)} | {("b.fa", 0): records[6][1], ("b.fa", 1): "ACGT"}
        assert {k: "".join(v) for k, v in own.items()} == {k: v for k, v in whole.items() if v}
        tree = LabelTree.star([str(i) for i in range(8)])
        label = F.col("seq_rank").cast("int").alias("label")
        index = ix.build(cut.select(label, "seq", "offset", "lead", "own"), tree, s)
        plain = ix.build(frame(spark, [(k[1], v) for k, v in whole.items()]), tree, s)
        assert sorted(map(tuple, index.positions.collect())) == sorted(map(tuple, plain.positions.collect()))
        asked = readers.read_pieces(spark, f"{tmp_path}/a.fa", 0, 14, size).select(F.col("seq_rank").alias("query_rank"), F.col("name").alias("query_name"), "seq", "offset", "lead", "own")
        got = lk.lookup(asked, plain.cache(), 15, misses=True)
        reads = lk.lookup(readers.read_queries(spark, f"{tmp_path}/a.fa"), plain, 15, misses=True)
        assert sorted(map(str, got.collect())) == sorted(map(str, reads.collect())) and lk.counted(asked, 15).first()["n_kmers"] == sum(max(len(x) - 14, 0) for _, x in records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_kinds_of_files_by_their_first_letters(spark, tmp_path):
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/x").write_text("@a\nACG\n+\nIII\n")
    (tmp_path / "odd/y").write_text("@b\nTTT\n+\n@@@\n")
    (tmp_path / "plain").write_text(">c\nGG\n")
    (tmp_path / "zero").write_text("")
    assert readers._fastq(spark, [f"{tmp_path}/odd", f"{tmp_path}/plain", f"{tmp_path}/zero", "x.fq.gz", "y.FA"]) == {"x.fq.gz": True, "y.FA": False, f"{tmp_path}/odd": True, f"{tmp_path}/plain": False, f"{tmp_path}/zero": False}
    rows = readers.read_sequences(spark, [f"{tmp_path}/odd", f"{tmp_path}/plain", f"{tmp_path}/zero"]).collect()
    assert sorted((r["name"], r["seq"]) for r in rows) == [("a", "ACG"), ("b", "TTT"), ("c", "GG")]


def test_intervals_and_hits(spark, tmp_path):
    (tmp_path / "r.bed").write_text("q\t0\t5\t a \nq\t5\t6\t\nq\t6\t9\t  \nq\t9\t11\tb\r\n")
    assert sorted(map(tuple, readers.read_intervals(spark, f"{tmp_path}/r.bed").collect())) == [("q", 0, 5, "a"), ("q", 9, 11, "b")]
    n = 20_000
    lines = spark.createDataFrame([("C\tq\t7\t9\t" + " ".join(f"{i % 5}:{i % 3}" for i in range(n)),), ("C\tq\t7\t9\t8:2",)], "value string")
    runs = readers.hits_to_runs(lines)
    rows = runs.where("taxid <> '8'").orderBy("start", "end").collect()
    assert len(rows) == n and rows[-1]["end"] == sum(i % 3 for i in range(n)) and all(a["end"] == b["start"] or a["end"] == a["start"] for a, b in zip(rows, rows[1:]))


def test_ordered_output_by_all_tasks(spark, tmp_path, request):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("query_rank"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é "), "id")).alias("label")).repartition(6)
    rows = sorted(map(tuple, df.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay files of their own
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert df.orderBy("query_rank").rdd.getNumPartitions() > 1
    for header in (True, False):
        writers.write(df.orderBy("query_rank"), f"{tmp_path}/out.tsv", header)
        text = ("query_rank\tlabel\n" if header else "") + "".join(f"{a}\t{b or ''}\n" for a, b in rows)
        assert (tmp_path / "out.tsv").read_bytes() == text.encode()
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("out.tsv.parts")]
    writers.write(df.where("false").orderBy("query_rank"), f"{tmp_path}/none.tsv")
    assert (tmp_path / "none.tsv").read_text() == "query_rank\tlabel\n"


def test_sql_windows_and_ancestors(spark):
    sqlfunctions.register(spark)
    spark.createDataFrame([(1, "ACGT"), (2, "AC"), (3, None)], "id int, seq string").createOrReplaceTempView("reads")
    rows = spark.sql("SELECT id, w.pos, w.kmer FROM reads, LATERAL kmer_windows(seq, 3) w").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "ACG"), (1, 1, "CGT")]
    for tree in (random_tree(random.Random(3), 40), LabelTree.from_ids(1, []), LabelTree.star(["it's", "b\\c"])):
        sqlfunctions.register_tree(spark, "own", tree)
        n, rnd = len(tree), random.Random(5)
        groups = {g: [rnd.randrange(n) for _ in range(rnd.randint(1, 4))] for g in range(60)}
        spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [(99, None)], "g int, id int").createOrReplaceTempView("members")
        plan = spark.sql("SELECT g, own_lca(min(own_place(id)), max(own_place(id))) AS id FROM members GROUP BY g")
        expected = {99: None}
        for g, xs in groups.items():
            expected[g] = xs[0]
            for x in xs:
                expected[g] = tree.lca(expected[g], x)
        assert {r["g"]: r["id"] for r in plan.collect()} == expected
        assert "partial_min" in plan._jdf.queryExecution().executedPlan().toString()
        assert [r[0] for r in spark.sql(f"SELECT own_name(id) FROM range({n})").collect()] == list(tree.names)
    with pytest.raises(ValueError):
        sqlfunctions.register_tree(spark, "own", LabelTree.star([str(i) for i in range(600)]))


def test_counts_come_with_the_lookup(spark, tmp_path, capsys):
    index = ix.build(frame(spark, [(0, "ACGTACGTTT")]), LabelTree.star(["a"]), 4)
    seqs = ["ACGTNACC", "AC", "TTTTTTT"]
    queries = spark.createDataFrame([(i, f"q{i}", x) for i, x in enumerate(seqs)], "query_rank long, query_name string, seq string")
    seen = Observation("own")
    lk.lookup(queries, index, 3, seen=seen).collect()
    assert seen.get["n_kmers"] == lk.counted(queries, 3).first()["n_kmers"] == 11
    index.save(f"{tmp_path}/ix")
    (tmp_path / "q.fa").write_text("".join(f">{i}\n{x}\n" for i, x in enumerate(seqs)))
    assert cli.main(["lookup", "-i", f"{tmp_path}/ix", "-k", "3", "-q", f"{tmp_path}/q.fa", "-o", f"{tmp_path}/out"], spark) == 0
    assert capsys.readouterr().err.splitlines()[-1].startswith("11 k-mers, ")


# streams


def test_files_as_they_arrive(spark, tmp_path):
    index = ix.build(frame(spark, [(0, "ACGTACGT")]), LabelTree.star(["a"]), 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.fq").write_text("@q1 x\nACGTAC\n+\n>>>>>>\n@q2\nGGGGG\n+\n@@@@@\n")
    (tmp_path / "in/two.fa").write_text(">q3\nTA\nCG\n")
    got = []
    watch(spark, f"{tmp_path}/in", index, lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in/three.fa").write_text(">q4\nCGTA\n")
    watch(spark, f"{tmp_path}/in", index, lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["query_name"], r["from_kmer"], r["to_kmer"]) for r in got) == [("q1", 0, 3), ("q3", 0, 1), ("q4", 0, 1)]


def test_runs_stay_open_across_batches(spark, tmp_path):
    """Records in ten pieces and more give the runs of the whole, also where a batch fails and the stream starts anew."""
    rnd = random.Random(11)
    seqs = ascii_only(sequences(rnd, 3, 8, 200))
    tree = LabelTree.star(["a", "b", "c"])
    index = ix.build(frame(spark, seqs), tree, 9).cache()
    whole = {f"q{i}": x[:120] + "".join(rnd.choice("ACGTN") for _ in range(40)) for i, (_, x) in enumerate(seqs[:4])} | {"short": "ACG", "empty": "", "same": "A" * 90}
    whole["hit"] = seqs[0][1]
    cuts = {q: sorted({0, len(x), *(rnd.randrange(len(x) + 1) for _ in range(9))}) for q, x in whole.items()}
    pieces = {q: [x[a:b] for a, b in zip(c, c[1:])] or [""] for (q, x), c in zip(whole.items(), cuts.values())}
    (tmp_path / "in").mkdir()
    most = max(map(len, pieces.values()))
    got, failed = {}, []

    def run(stop=None):
        def sink(df, number):
            if number == stop and not failed:
                failed.append(number)
                raise RuntimeError("lost")
            got[number] = df.collect()

        stream = spark.readStream.schema("query string, no long, seq string, last boolean").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        follow(stream, index, sink, f"{tmp_path}/cp", 6, misses=True).awaitTermination()

    for i in range(0, most, 2):  # two pieces of each record in a batch
        rows = [(q, j, p[j], j == len(p) - 1) for q, p in pieces.items() for j in (i + 1, i) if j < len(p)]
        spark.createDataFrame(rows, "query string, no long, seq string, last boolean").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if i == 4:
            with pytest.raises(Exception, match="lost"):
                run(stop=max(got) + 1)
        run()
    names = list(whole)
    expected = naive_runs(list(enumerate(whole.values())), naive(seqs, tree, 6), 6)
    runs = sorted(((names.index(r["query"]), r["from_kmer"], r["to_kmer"], r["label"]) for rows in got.values() for r in rows), key=str)
    assert runs == expected and failed and len(got) >= 5
    assert {r["label_name"] for rows in got.values() for r in rows} <= {"a", "b", "c", "root", None}


def test_printed_statistics(spark, tmp_path, capsys):
    """What stats, node-stats, print-hierarchy and lookup-debug print, letter by letter."""
    (tmp_path / "a.fa").write_text(">x\nACA\n>y\nCAC\n")
    (tmp_path / "tree").write_text("x all\ny all\n")
    (tmp_path / "q.fa").write_text(">q\nACACA\n")
    run = lambda *a: cli.main(list(map(str, a)), spark)
    assert run("build", "-s", 2, "--label-by-seq", tmp_path / "a.fa", "--hierarchy", tmp_path / "tree", "--forward-only", "-o", tmp_path / "ix") == 0
    capsys.readouterr()
    printed = []
    for command in (("stats", "-i"), ("node-stats", "--index"), ("node-stats", "--report-label-ids", "--index"), ("print-hierarchy", "-i"), ("lookup-debug", "-q", tmp_path / "q.fa", "-i")):
        assert run(*command, tmp_path / "ix") == 0
        printed.append(capsys.readouterr().out)
    # the prefixes A (of x) and C (of y), and AC and CA of both; in order of their right ends: the empty one, A, CA, C, AC
    assert printed == [
        "s: 2\nstrings of s letters: 2\nlabelled positions: 4\nunlabelled positions: 1\nlabel runs: min 1, max 1, mean 1.00\n-\tnone\t1\n0\tx\t1\n1\ty\t1\n2\tall\t2\n",
        "k\tlabel\tcount\n2\tx\t0\n2\ty\t0\n2\tall\t2\n1\tx\t0\n1\ty\t0\n1\tall\t2\n",
        "k\tlabel\tcount\n2\t0\t0\n2\t1\t0\n2\t2\t2\n1\t0\t0\n1\t1\t0\n1\t2\t2\n",
        "3\nx\ny\nall\n0 2\n1 2\n",
        "seq_rank\tfrom_kmer\tto_kmer\tlabel\n0\t0\t4\t*\n",
    ]


@pytest.mark.parametrize("lines, said", [("a\n", "no parent"), ("a b\nb a\n", "edges"), ("a b\na c\n", "two parents"), ("a a\nb c\n", "its own parent"), ("x none\ny none\n", None)])
def test_messages_about_trees(lines, said):
    labels, edges = ["a"], None
    try:
        from cladeframe.operators.hierarchy import parse_edges

        edges = parse_edges(lines.splitlines())
        tree = LabelTree.from_edges(labels if said else ["x", "y"], edges)
    except HierarchyError as error:
        assert said and said in str(error)
    else:
        assert said is None and tree.names[tree.root] == "none"
