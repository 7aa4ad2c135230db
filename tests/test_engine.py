"""The engine against plain definitions: every label is the lowest common ancestor of the sequences that hold a string."""

import random

import pytest

from cladeframe import cli
from cladeframe.functions import kmers
from cladeframe.operators import index as ix
from cladeframe.operators import lookup as lk
from cladeframe.operators import reports, stats
from cladeframe.operators.hierarchy import HierarchyError, LabelTree, parse_edges
from cladeframe.sources import readers, writers
from pyspark.sql import functions as F

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def runs_of(seq):
    out, run = [], ""
    for c in seq.upper() + "$":
        if c in "ACGT":
            run += c
        else:
            out += [run] if run else []
            run = ""
    return out


def naive(sequences, tree, k, forward=False):
    occ = {}
    for label, seq in sequences:
        for run in runs_of(seq):
            for r in [run] if forward else [run, run[::-1].translate(COMPLEMENT)]:
                for i in range(len(r) - k + 1):
                    occ.setdefault(r[i : i + k], set()).add(label)
    out = {}
    for mer, labels in occ.items():
        paths = [set(tree.path(x)) for x in labels]
        out[mer] = max(set.intersection(*paths), key=lambda n: tree.depth[n])
    return out


def naive_runs(queries, labels, k):
    out = []
    for rank, seq in queries:
        last = None
        for i in range(len(seq) - k + 1):
            label = labels.get(seq[i : i + k].upper())
            if last and last[3] == label:
                last[2] = i + 1
            else:
                last = [rank, i, i + 1, label]
                out.append(last)
    return sorted((tuple(x) for x in out), key=str)


def random_tree(rnd, n):
    order = list(range(n))
    rnd.shuffle(order)
    edges = [(order[i], order[rnd.randrange(i)]) for i in range(1, n)]
    return LabelTree.from_ids(n, edges)


@pytest.mark.parametrize("seed", range(3))
def test_index_and_lookup_random(spark, seed):
    rnd = random.Random(seed)
    tree = random_tree(rnd, rnd.randint(1, 9))
    base = "".join(rnd.choice("ACGT") for _ in range(60))
    sequences = []
    for _ in range(8):
        a = rnd.randrange(50)
        seq = base[a : a + rnd.randint(1, 30)] + rnd.choice(["", "N", "-", "acgt"]) + "".join(rnd.choice("ACGTacgtN") for _ in range(rnd.randint(0, 12)))
        sequences.append((rnd.randrange(len(tree)), seq))
    queries = [(i, "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 9))) + base[j : j + rnd.randint(0, 25)]) for i, j in enumerate([0, 5, 20, 40])]
    df = spark.createDataFrame(sequences, "label int, seq string")
    qf = spark.createDataFrame([(i, f"q{i}", s) for i, s in queries], "query_rank long, query_name string, seq string")
    index = ix.build(df, tree, 6).cache()
    for k in (1, 2, 4, 6):
        expected = naive(sequences, tree, k)
        assert {r["kmer"]: r["label"] for r in index.kmer_labels(k).collect()} == expected
        assert {r["kmer"]: r["label"] for r in ix.direct(df, tree, k).collect()} == expected
        got = lk.lookup(qf, index, k, misses=True).collect()
        assert sorted(((r["query_rank"], r["from_kmer"], r["to_kmer"], r["label"]) for r in got), key=str) == naive_runs(queries, expected, k)
    found = {(r["k"], r["label"]): r["count"] for r in stats.node_stats(index).collect()}
    for k in range(1, 7):
        expected = naive(sequences, tree, k)
        assert [found[k, i] for i in range(len(tree))] == [sum(v == i for v in expected.values()) for i in range(len(tree))]
    # run lengths over the order from the right end
    positions = sorted(((r["mer"][::-1], r["label"]) for r in index.position_labels().collect()))
    order = [None] + [x[1] for x in positions]
    lengths, last = [], object()
    for x in order:
        if x == last:
            lengths[-1] += 1
        else:
            lengths.append(1)
        last = x
    row = stats.run_stats(index).first()
    assert (row["run_min"], row["run_max"]) == (min(lengths), max(lengths))
    assert row["run_mean"] == pytest.approx(sum(lengths) / len(lengths))


def test_breaks_lower_case_short_and_empty(spark):
    seqs = [(0, "ACGTNACCA"), (1, "acgtt"), (2, "GG")]
    tree = LabelTree.star(["a", "b", "c"])
    index = ix.build(spark.createDataFrame(seqs, "label int, seq string"), tree, 4)
    queries = spark.createDataFrame([(0, "q1", "ACGTT"), (1, "q2", "AC"), (2, "q3", "ACGNACCa"), (3, "q4", "")], "query_rank long, query_name string, seq string")
    got = lk.render(lk.lookup(queries, index, 2, misses=True), label_ids=True).collect()
    assert [tuple(r) for r in got] == [(0, 0, 3, "3"), (0, 3, 4, "1"), (1, 0, 1, "3"), (2, 0, 2, "3"), (2, 2, 4, "-"), (2, 4, 6, "3"), (2, 6, 7, "0")]
    with pytest.raises(ValueError):
        index.kmer_labels(5)
    with pytest.raises(ValueError):
        kmers.check_k(0)


def test_pieces_do_not_change_results(spark):
    seq = "".join(random.Random(5).choice("ACGT") for _ in range(500))
    df = spark.createDataFrame([(0, seq)], "query_rank long, seq string")
    rows = kmers.windows(df, "seq", 7, size=32).collect()
    assert sorted((r["pos"], r["kmer"]) for r in rows) == [(i, seq[i : i + 7]) for i in range(494)]


def test_universe_none_to_root_and_forward_only(spark):
    df = spark.createDataFrame([(0, "ACGTAC")], "label int, seq string")
    tree = LabelTree.star(["a"])
    within = ix.universe(spark.createDataFrame([("ACGGG",)], "seq string"), 3, forward_only=True)
    index = ix.build(df, tree, 3, forward_only=True, within=within)
    assert {r["mer"]: r["label"] for r in index.position_labels().collect()} == {"A": 0, "AC": 0, "ACG": 0, "CGG": None, "GGG": None}
    assert {r["mer"]: r["label"] for r in index.none_to_root().position_labels().collect()}["GGG"] == tree.root


@pytest.mark.parametrize(
    ("n", "edges"),
    [(0, []), (4, [(3, 1), (0, 1)]), (3, [(1, 0), (2, 7)]), (4, [(1, 3), (2, 2), (0, 3)]), (4, [(3, 0), (3, 1), (2, 0)]), (5, [(2, 4), (4, 3), (3, 2), (1, 0)])],
    ids=["no node", "edges", "range", "loop", "two parents", "cycle"],
)
def test_invalid_trees(n, edges):
    with pytest.raises(HierarchyError):
        LabelTree.from_ids(n, edges)


def test_trees():
    single = LabelTree.from_ids(1, [])
    assert (single.root, single.lca(0, 0)) == (0, 0)
    comb = LabelTree.from_ids(9, [(2, 8), (8, 5), (5, 1), (0, 8), (3, 5), (7, 1), (4, 7), (6, 7)])
    broad = LabelTree.from_ids(6, [(i, 3) for i in (0, 1, 2, 4, 5)])
    for tree in (comb, broad, random_tree(random.Random(8), 30)):
        up = [set(tree.path(i)) for i in range(len(tree))]
        for a in range(len(tree)):
            for b in range(len(tree)):
                assert tree.lca(a, b) == max(up[a] & up[b], key=lambda n: len(up[n]))
    for tree in (comb, broad, random_tree(random.Random(1), 20)):
        for a in range(len(tree)):
            for b in range(len(tree)):
                assert tree.lca(a, b) == tree.lca(b, a)
                assert (tree.tin[a] <= tree.tin[b] <= tree.tout[a]) == (a in tree.path(b))
    with pytest.raises(HierarchyError):
        LabelTree.star(["a", "root"])
    with pytest.raises(HierarchyError):
        LabelTree.from_edges(["a", "a"], [("a", "r")])
    with pytest.raises(HierarchyError):
        LabelTree.from_edges(["a", "none"], [("a", "r"), ("none", "r")])
    assert LabelTree.from_dump(comb.dump()) == comb
    assert parse_edges(["a b ignored", "", "  c\td "]) == [("a", "b"), ("c", "d")]


def test_joined_trees_equal_inline_ones(spark, monkeypatch):
    from cladeframe.functions import tree as tr

    tree = random_tree(random.Random(2), 12)
    df = spark.createDataFrame([(i, "ACGTACG"[i % 3 :]) for i in range(12)], "label int, seq string")
    inline = {r["kmer"]: r["label"] for r in ix.build(df, tree, 4).kmer_labels(3).collect()}
    monkeypatch.setattr(tr, "INLINE", 0)
    assert {r["kmer"]: r["label"] for r in ix.build(df, tree, 4).kmer_labels(3).collect()} == inline


def test_files_save_load_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">x one\nACGTAC\nGT\n>y\nGGGTTT\n")
    (tmp_path / "b.fq").write_text("@r1 z\nACGTTT\n+\nIIIIII\n@r2\nCCCAC\n+\n@@@@@\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fq\n")
    (tmp_path / "names").write_text("A\nB\n")
    (tmp_path / "tree").write_text("A top\nB top\n")
    (tmp_path / "q.fa").write_text(">q1 text\nACGTTT\n>q2\nAC\n>q3\nNNNNNNN\n")
    rows = readers.read_sequences(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fq"]).orderBy("file", "seq_rank").collect()
    assert [(r["seq_rank"], r["name"], r["seq"]) for r in rows] == [(0, "x", "ACGTACGT"), (1, "y", "GGGTTT"), (0, "r1", "ACGTTT"), (1, "r2", "CCCAC")]
    run = lambda *a: cli.main(list(map(str, a)), spark)
    assert run("build", "-s", 4, "--label-by-file", tmp_path / "list", "--labels", tmp_path / "names", "--hierarchy", tmp_path / "tree", "-o", tmp_path / "ix", "--save-universe", tmp_path / "u") == 0
    assert run("build", "-s", 4, "--label-by-seq", tmp_path / "a.fa", "-o", tmp_path / "ix2", "--load-universe", tmp_path / "u") == 0
    index = ix.load(spark, str(tmp_path / "ix"))
    sequences = [(0, "ACGTACGT"), (0, "GGGTTT"), (1, "ACGTTT"), (1, "CCCAC")]
    tree = LabelTree.from_edges(["A", "B"], [("A", "top"), ("B", "top")])
    for k in (3, 4):
        assert {r["kmer"]: r["label"] for r in index.kmer_labels(k).collect()} == naive(sequences, tree, k)
    capsys.readouterr()
    assert run("lookup", "-i", tmp_path / "ix", "-k", 3, "-q", tmp_path / "q.fa", "--report-misses", "--report-query-names") == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "query_name\tfrom_kmer\tto_kmer\tlabel_name" and out[-1] == "q3\t0\t5\tnone"
    assert run("lookup", "-i", tmp_path / "ix", "-k", 3, "-q", tmp_path / "q.fa", "--report-label-ids", "--no-header", "-o", tmp_path / "out.tsv") == 0
    assert (tmp_path / "out.tsv").read_text().splitlines()[0].split("\t")[:2] == ["0", "0"]
    (tmp_path / "new").write_text("0\tAlpha\n2\tall\tof them\n")
    assert run("rename-labels", "-i", tmp_path / "ix", "--new-names", tmp_path / "new", "-o", tmp_path / "ix3") == 0
    capsys.readouterr()
    assert run("print-hierarchy", "-i", tmp_path / "ix3") == 0
    assert capsys.readouterr().out.splitlines() == ["3", "Alpha", "B", "all\tof them", "0 2", "1 2"]
    for command in (("stats", "-i", tmp_path / "ix"), ("node-stats", "--index", tmp_path / "ix"), ("lookup-debug", "-i", tmp_path / "ix", "-q", tmp_path / "q.fa")):
        assert run(*command) == 0
        assert capsys.readouterr().out
    assert run("lookup", "-i", tmp_path / "ix", "-k", 9, "-q", tmp_path / "q.fa") == 2
    cli.prompt(spark, cli.parser().parse_args(["prompt", "-i", str(tmp_path / "ix"), "-k", "3"]), ["", "-q /nowhere", f"-q {tmp_path}/q.fa", "quit", "-q x"])
    assert "from_kmer" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("build", "-o", tmp_path / "x")
    (tmp_path / "names").write_text("A\n")
    assert run("build", "-s", 4, "--label-by-file", tmp_path / "list", "--labels", tmp_path / "names", "-o", tmp_path / "ix4") == 2


def test_reports(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("q1\t0\t5\tx\nq1\t5\tbad\t-\nno tab\nq2\t1\t2\textra\ty\n")
    rows = readers.read_intervals(spark, f"{tmp_path}/r.tsv").collect()
    assert sorted(tuple(r) for r in rows) == [("q1", 0, 5, "x"), ("q1", 5, 0, "-"), ("q2", 1, 2, "y")]
    a = spark.createDataFrame([("q1", "10", 5), ("q1", "2", 1), ("q2", "2", 7)], "query string, label string, bases long")
    b = spark.createDataFrame([("q1", "10", 2), ("q3", "z", 4)], "query string, label string, bases long")
    wide = reports.pivot(a)
    assert wide.columns == ["query", "10", "2"] and [tuple(r) for r in wide.collect()] == [("q1", 5, 1), ("q2", 0, 7)]
    assert sorted(tuple(r) for r in reports.unpivot(wide).collect()) == [("q1", "10", 5), ("q1", "2", 1), ("q2", "10", 0), ("q2", "2", 7)]
    diff = {(r["query"], r["label"]): (r["diff"], round(r["signed_log"], 4)) for r in reports.difference(a, b).collect()}
    assert diff == {("q1", "10"): (3, 0.6021), ("q1", "2"): (1, 0.301), ("q2", "2"): (7, 0.9031), ("q3", "z"): (-4, -0.699)}
    writers.write_tsv(wide, f"{tmp_path}/m", files=1)
    assert sorted(tuple(r) for r in readers.read_matrix(spark, f"{tmp_path}/m").collect()) == [("q1", "10", 5.0), ("q1", "2", 1.0), ("q2", "10", 0.0), ("q2", "2", 7.0)]
    lines = spark.createDataFrame([("C\tq\t7\t9\t7:3 0:2 A:1",), ("U\tq\t0\t9\t0:4",), ("C\tshort",)], "value string")
    runs = sorted(tuple(r) for r in readers.hits_to_runs(lines).collect())
    assert runs == [("q", 0, 3, "7"), ("q", 3, 5, "0"), ("q", 5, 6, "A")]
    names = spark.createDataFrame([("chr1_MATERNAL",), ("chrX_PATERNAL",), ("chrM",), ("x",)], "n string").select(reports.short_query(F.col("n"))).collect()
    assert [r[0] for r in names] == ["1-M", "X-P", "Mito", "x"]
    ids = spark.createDataFrame([("-", None), ("5", "five"), ("6", None), ("A", None), ("0", None)], "l string, n string")
    assert [tuple(r) for r in ids.select(reports.translate(F.col("l"), F.col("n")), reports.translate_foreign(F.col("l"), F.col("n"))).collect()] == [("novel", "novel"), ("five", "five"), ("6", "6"), ("A", "root"), ("0", "novel")]
    assert [r[0] for r in reports.display_order(spark.createDataFrame([("b",), ("z",), ("a",), ("c",)], "x string"), "x", ["c", "b"]).collect()] == ["c", "b", "a", "z"]
    (tmp_path / "run-t1.log").write_text("Elapsed (wall clock) time (h:mm:ss or m:ss): 1:01:01\nMaximum resident set size (kbytes): 1048576\n100.0 ns/bp\n")
    (tmp_path / "run-t8.log").write_text("Elapsed (wall clock) time (h:mm:ss or m:ss): 2:30.5\nMaximum resident set size (kbytes): 524288\n20.0 ns/bp\n")
    got = reports.bench_summary(readers.read_bench_logs(spark, [f"{tmp_path}/run-t1.log", f"{tmp_path}/run-t8.log"])).orderBy("threads").collect()
    assert [tuple(r) for r in got] == [("run", 1, 100.0, 3661.0, 1.0, 1.0), ("run", 8, 20.0, 150.5, 0.5, 5.0)]
    tree = LabelTree.from_edges(["a"], [("a", "top")])
    assert tree.taxonomy()[1][0].startswith("1\t|\t1\t|")


def test_streaming(spark, tmp_path):
    from cladeframe.streaming.lookup import watch

    index = ix.build(spark.createDataFrame([(0, "ACGTACGT")], "label int, seq string"), LabelTree.star(["a"]), 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.fa").write_text(">q1\nACGTAC\n>q2\nGGGGG\n")
    (tmp_path / "in/two.fa").write_text(">q3\nTACG\n")
    got = []
    watch(spark, f"{tmp_path}/in", index, lambda df, _: got.extend(df.collect()), f"{tmp_path}/cp", files_per_batch=1).awaitTermination()
    assert sorted((r["query_name"], r["from_kmer"], r["to_kmer"], r["label_name"]) for r in got) == [("q1", 0, 3, "a"), ("q3", 0, 1, "a")]


# The documented example, four files of two sequences, and the runs that it prints.
EXAMPLE = {
    "A.fna": ("ACGTACGTGTCGTA", "ACGTACGTGTCGTA"), "B.fna": ("ACGTGCTGAGCA", "TTACGACGTAGCA"), "C.fna": ("ACAGCTACGACT", "CTTATCATGTAGCTAGC"), "D.fna": ("GCTAGCTAGCTAGCTA", "TAGCTAGCTAGCTAGC"),
}
EXAMPLE_TREE = (("A.fna", "clade1"), ("B.fna", "clade1"), ("clade1", "clade2"), ("C.fna", "clade2"), ("clade2", "root"), ("D.fna", "root"))
EXAMPLE_QUERIES = ("ACGTACGTCATGTAGCTAG", "ACGTGCTGAGCAGTGTCGTTTATCAT")
EXAMPLE_RUNS = (
    "Q1 0 1 clade1", "Q1 1 3 A.fna", "Q1 3 4 clade1", "Q1 4 5 B.fna", "Q1 5 7 none", "Q1 7 11 C.fna", "Q1 11 12 clade2", "Q1 12 15 root",
    "Q2 0 1 clade1", "Q2 1 8 B.fna", "Q2 8 12 none", "Q2 12 14 A.fna", "Q2 14 15 clade2", "Q2 15 19 none", "Q2 19 22 C.fna",
)


def test_documented_example(spark, tmp_path, capsys):
    for name, seqs in EXAMPLE.items():
        (tmp_path / name).write_text("".join(f">{name[0]}{i}\n{x}\n" for i, x in enumerate(seqs, 1)))
    (tmp_path / "list").write_text("".join(f"{tmp_path}/{x}\n" for x in EXAMPLE))
    (tmp_path / "tree").write_text("".join(" ".join(f"{tmp_path}/{x}" if x in EXAMPLE else x for x in edge) + "\n" for edge in EXAMPLE_TREE))
    (tmp_path / "q.fasta").write_text("".join(f">Q{i}\n{x}\n" for i, x in enumerate(EXAMPLE_QUERIES, 1)))
    run = lambda *a: cli.main(list(map(str, a)), spark)
    assert run("build", "-s", 10, "--label-by-file", tmp_path / "list", "--hierarchy", tmp_path / "tree", "-o", tmp_path / "ix") == 0
    capsys.readouterr()
    assert run("lookup", "-i", tmp_path / "ix", "-k", 5, "-q", tmp_path / "q.fasta", "--report-query-names", "--report-misses") == 0
    out = capsys.readouterr().out.splitlines()
    assert [x.replace(f"{tmp_path}/", "").replace("\t", " ") for x in out[1:]] == list(EXAMPLE_RUNS)


def test_readers_of_split_files(spark, tmp_path):
    """Records and lines keep their numbers where files are cut to many blocks; blank lines, CR, '>' in headers, no end."""
    rnd = random.Random(4)
    records = [(f"n{i}", "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 300)))) for i in range(200)]
    (tmp_path / "x.fa").write_text("\n".join(f">{n} a > b\r\n" + "\r\n".join(s[j : j + 60] for j in range(0, len(s), 60)) for n, s in records))
    fastq = [(n, s) for n, s in records if s]
    (tmp_path / "y.reads").write_text("".join(f"@{n} z\n{s}\n+\n{'@' * len(s)}\n" for n, s in fastq))
    (tmp_path / "empty.fa").write_text("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = readers.read_sequences(spark, [f"{tmp_path}/{x}" for x in ("x.fa", "y.reads", "empty.fa")])
        assert spark.read.text(f"{tmp_path}/x.fa").rdd.getNumPartitions() > 10
        got = {}
        for r in rows.collect():
            got.setdefault(r["file"].rpartition("/")[2], []).append((r["seq_rank"], r["name"], r["seq"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {f: sorted(x) for f, x in got.items()} == {f: [(i, *r) for i, r in enumerate(x)] for f, x in (("x.fa", records), ("y.reads", fastq))}


def test_sql_functions(spark):
    from cladeframe.functions import sqlfunctions

    sqlfunctions.register(spark)
    row = spark.sql("SELECT revcomp('AACg'), acgt_runs('acNGT'), kmers('ACGT', 3), kmers('AC', 3), signed_log(-9.0D), path_lca(array(0, 1, 2), array(0, 1, 5, 6))").first()
    assert tuple(row) == ("CGTT", ["AC", "GT"], ["ACG", "CGT"], [], -1.0, 1)


def test_lookup_paths_agree(spark, monkeypatch):
    """Labels of the queries' own strings only, of all strings, and shared ones."""
    rnd = random.Random(6)
    seqs = spark.createDataFrame([(i % 3, "".join(rnd.choice("ACGT") for _ in range(80))) for i in range(9)], "label int, seq string")
    index = ix.build(seqs, LabelTree.star(["a", "b", "c"]), 6)
    queries = spark.createDataFrame([(i, f"q{i}", "".join(rnd.choice("ACGT") for _ in range(60))) for i in range(4)], "query_rank long, query_name string, seq string")
    for k in (4, 6):
        few = sorted(map(tuple, lk.lookup(queries, index, k, True).collect()), key=str)
        shared = sorted(map(tuple, lk.lookup(queries, index, k, True, index.kmer_labels(k)).collect()), key=str)
        monkeypatch.setattr(lk, "ASKED", 0)
        assert few == shared == sorted(map(tuple, lk.lookup(queries, index, k, True).collect()), key=str)
        monkeypatch.undo()
