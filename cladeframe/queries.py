"""Queries over the star schema and text tables, and the SQL that gives the same rows.

Sequences are the letters A, C, G, T of a text column. The SQL finds ancestors another way than the queries do: it
counts, for each ancestor, the labels below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import kmers, packed, sqlfunctions, tree
from .operators import index as ix
from .operators import lookup as lk
from .operators import matching, reports, stats
from .operators.hierarchy import LabelTree
from .plans.session import scratch
from .sources import readers, writers
from .sources.readers import hits_to_runs
from .streaming.lookup import follow

LANGS = LabelTree.from_edges(["de", "en", "es", "fr"], [("de", "germanic"), ("en", "germanic"), ("es", "romance"), ("fr", "romance"), ("germanic", "root"), ("romance", "root")])
K, S = 8, 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, seq) of the documents whose language has a label."""
    of = F.create_map(*(x for i in range(4) for x in (F.lit(LANGS.names[i]), F.lit(i))))
    docs = _table(spark, sf_dir, "documents").select(of[F.col("lang")].alias("label"), "text").where("label is not null and text is not null")
    return packed.letters(docs)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_rank, query_name, seq) of the benchmark's items."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_rank"), F.concat(F.lit("item"), "item_id").alias("query_name"), kmers.bases(F.col("text")).alias("seq"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where("text is not null").select(kmers.bases(F.col("text")).alias("seq"))


def nations(spark: SparkSession, sf_dir: str) -> LabelTree:
    """Nations below regions below the world; a nation's id is its key (a table of some tens of rows)."""
    n = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    r = {x["r_regionkey"]: x["r_name"] for x in _table(spark, sf_dir, "region").collect()}
    edges = [(x["n_name"], r[x["n_regionkey"]]) for x in n] + [(r[k], "world") for k in sorted(r)]
    return LabelTree.from_edges([x["n_name"] for x in n], edges)


def build(spark: SparkSession, sf_dir: str, s: int = S, **more) -> ix.Index:
    return ix.build(labelled(spark, sf_dir), LANGS, s, **more)


def _named(runs: DataFrame) -> DataFrame:
    return runs.select("query_rank", "query_name", "from_kmer", "to_kmer", "label", "label_name")


def revcomp(spark, d):
    return _table(spark, d, "documents").select("doc_id", kmers.revcomp(kmers.bases(F.col("text"))).alias("rc"))


def acgt_runs(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.posexplode(kmers.acgt_runs(F.col("text"))).alias("run_no", "run"))


def kmer_windows(spark, d):
    return kmers.windows(questions(spark, d).select("query_rank", "seq"), "seq", K).drop("piece")


def kmer_pieces(spark, d):
    return kmers.pieces(questions(spark, d).select("query_rank", "seq"), "seq", 5, 9).select("query_rank", F.col("offset").cast("long").alias("offset"), F.col("piece"), "seq")


def kmer_distinct(spark, d):
    return kmers.windows(labelled(spark, d).repartition(_tasks(spark)), "seq", K).groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


def index_build_k(spark, d):
    return ix.direct(labelled(spark, d), LANGS, K)


def index_positions(spark, d):
    return build(spark, d).position_labels()


def rollup_s_to_k(spark, d):
    return build(spark, d, 10).kmer_labels(6)


def lookup_runs(spark, d):
    return lk.lookup(questions(spark, d), build(spark, d), K)


def lookup_runs_with_misses(spark, d):
    return lk.lookup(questions(spark, d), build(spark, d, 12), 12, misses=True)


def lookup_rolled_up(spark, d):
    return lk.lookup(questions(spark, d), build(spark, d, 12), 7, misses=True)


def lookup_forward_only(spark, d):
    return lk.lookup(questions(spark, d), build(spark, d, forward_only=True), K, misses=True)


def lookup_star(spark, d):
    return lk.lookup(questions(spark, d), ix.build(labelled(spark, d), LabelTree.star(LANGS.names[:4]), S), K, misses=True)


def lookup_with_breaks(spark, d):
    """Raw texts: letters other than A, C, G, T break the runs of index and queries."""
    of = F.create_map(*(x for i in range(4) for x in (F.lit(LANGS.names[i]), F.lit(i))))
    docs = _table(spark, d, "documents").select(of[F.col("lang")].alias("label"), F.col("text").alias("seq")).where("label is not null and seq is not null")
    items = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_rank"), F.concat(F.lit("item"), "item_id").alias("query_name"), F.col("text").alias("seq"))
    return lk.lookup(items, ix.build(docs, LANGS, 3), 3, misses=True)


def lookup_debug(spark, d):
    return lk.render_debug(lk.lookup(questions(spark, d), build(spark, d), S), LANGS)


def lookup_rendered(spark, d):
    return lk.render(lk.lookup(questions(spark, d), build(spark, d), K, misses=True), query_names=True)


def lookup_hits_semi(spark, d):
    return lk.hits(turns(spark, d), ix.direct(questions(spark, d).select(F.lit(0).alias("label"), "seq"), LabelTree.star(["items"]), 12), 12)


def lookup_misses_anti(spark, d):
    return lk.misses(turns(spark, d), ix.direct(questions(spark, d).select(F.lit(0).alias("label"), "seq"), LabelTree.star(["items"]), 12), 12)


def node_stats(spark, d):
    return stats.node_stats(build(spark, d))


def node_stats_pct(spark, d):
    return reports.shares(node_stats(spark, d)).select("k", "label_name", "count", "total", "percent")


def label_histogram(spark, d):
    return stats.histogram(build(spark, d, within=ix.universe(turns(spark, d), S)))


def index_sizes(spark, d):
    return stats.sizes(build(spark, d))


def lookup_counts(spark, d):
    return lk.counted(questions(spark, d), K)


def matrix_merged(spark, d):
    """The families of languages count as the root."""
    return reports.merge_labels(matrix_long(spark, d), {"germanic": "root", "romance": "root"})


def label_run_stats(spark, d):
    return stats.run_stats(build(spark, d))


def none_to_root(spark, d):
    return stats.histogram(build(spark, d, within=ix.universe(turns(spark, d), S), none_to_root=True))


def universe_left_join(spark, d):
    return build(spark, d, within=ix.universe(turns(spark, d), S)).position_labels()


def rename_labels(spark, d):
    index = build(spark, d).rename_by_name({"de": "German", "root": "any language"}).rename({5: "Romance"})
    return stats.histogram(index)


def label_by_seq(spark, d):
    """Each benchmark item is a label of its own, named by its id."""
    items = _table(spark, d, "benchmark").orderBy("item_id").select("item_id").collect()  # the labels
    labels = LabelTree.star([f"item{r['item_id']}" for r in items])
    ids = {r["item_id"]: i for i, r in enumerate(items)}
    known = spark.createDataFrame(list(ids.items()), "item_id long, label int")
    seqs = _table(spark, d, "benchmark").join(F.broadcast(known), "item_id").select("label", kmers.bases(F.col("text")).alias("seq"))
    return tree.with_name(ix.direct(seqs, labels, 12), labels).select("kmer", "label_name")


def hierarchy_paths(spark, d):
    return nations(spark, d).nodes(spark, paths=True).select("id", "name", "parent", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def print_hierarchy(spark, d):
    return spark.createDataFrame(list(enumerate(nations(spark, d).dump())), "line_no long, line string")


def pairwise_lca(spark, d):
    """The ancestor of every two nodes of the tree of nations: a table of the tree's own size squared."""
    t = nations(spark, d)
    nodes = t.nodes(spark)
    a, b = nodes.select(F.col("id").alias("a"), F.col("tin").alias("ta")), nodes.select(F.col("id").alias("b"), F.col("tin").alias("tb"))
    pairs = a.join(F.broadcast(b), a["a"] <= b["b"]).select("a", "b", F.least("ta", "tb").alias("lo"), F.greatest("ta", "tb").alias("hi"))
    return tree.with_lca(pairs, t, "lca")


def set_lca_by_part(spark, d):
    """Where the suppliers of each part are at home, as one node: nation, region or the world."""
    t = nations(spark, d)
    supplier = tree.with_tin(_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("label")), t)
    spans = _table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(*tree.span(F.col("tin")))
    return tree.with_name(tree.with_lca(spans, t), t).select("l_partkey", "label_name")


def set_lca_by_customer(spark, d):
    """Where the suppliers of each customer's orders are at home."""
    t = nations(spark, d)
    supplier = tree.with_tin(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("label")), t)
    line = _table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(supplier, "l_suppkey").groupBy("l_orderkey").agg(*tree.span(F.col("tin")))
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"))
    return tree.with_name(tree.with_lca(line.join(orders, "l_orderkey").groupBy("custkey").agg(*tree.merge_spans()), t), t).select("custkey", "label_name")


def _runs(spark, d, k, index=None):
    named = lk.lookup(questions(spark, d), index or build(spark, d, k), k, misses=True)
    return named.select(F.col("query_name").alias("query"), F.col("from_kmer").alias("start"), F.col("to_kmer").alias("end"), F.coalesce("label_name", F.lit("none")).alias("label"))


def matrix_long(spark, d):
    return reports.matrix_long(_runs(spark, d, K))


def matrix_pivot(spark, d):
    return reports.pivot(matrix_long(spark, d), [*LANGS.names, "none"])


def matrix_diff(spark, d):
    """One index answers both lengths, so the documents are read and dealt once."""
    index = build(spark, d, K)
    a, b = (reports.matrix_long(_runs(spark, d, k, index)) for k in (K, 6))
    return reports.difference(a, b).select("query", "label", "a", "b", "diff", F.round("signed_log", 9).alias("signed_log"))


def foreign_hits_to_runs(spark, d):
    """The runs written as another classifier's lines, and read back."""
    hits = _runs(spark, d, K).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("start", F.concat_ws(":", "label", F.col("end") - F.col("start")).alias("hit")))).alias("h"), F.max("end").alias("n"))
    lines = hits.select(F.concat_ws("\t", F.lit("C"), "query", F.lit("0"), "n", F.array_join("h.hit", " ")).alias("value"))
    return hits_to_runs(lines)


def event_runs(spark, d):
    """Runs of equal event types of each user, in order of time."""
    from pyspark.sql.window import Window

    placed = _table(spark, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))
    return lk.run_lengths(placed, ["user_id"], "place", "event_type")


# files


def _lines(df: DataFrame, path: str) -> str:
    """One column of text written as the lines of a folder's files."""
    df.write.text(path)
    return path


def _fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60) -> str:
    """Records with sequences in lines of width letters."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return _lines(rows.select(F.concat(F.lit(">"), name, F.lit(" of benchmark\n"), body)), path)


def fasta_records(spark, d):
    """Benchmark items written as FASTA and read again."""
    path = _fasta(questions(spark, d).withColumnRenamed("query_name", "name").where("length(seq) > 0"), scratch(spark, "fasta"))
    return readers.read_sequences(spark, path).select("name", "seq")


def fastq_records(spark, d):
    """Benchmark items written as FASTQ, whose qualities may look like headers, and read again with their numbers."""
    items = questions(spark, d).where("length(seq) > 0").repartitionByRange(1, "query_rank").sortWithinPartitions("query_rank")
    path = _lines(items.select(F.concat_ws("\n", F.concat(F.lit("@"), "query_name", F.lit(" read")), "seq", F.lit("+"), F.expr("repeat('@', length(seq))"))), scratch(spark, "fastq"))
    return readers.read_sequences(spark, path).select("seq_rank", "name", "seq")


def label_by_file(spark, d):
    """The documents of each language written to files of their own, one label for each file."""
    top, paths = scratch(spark, "languages"), []
    docs = labelled(spark, d).where("length(seq) > 0").select("label", F.concat(F.lit(">x\n"), "seq").alias("value"))
    docs.write.partitionBy("label").text(top)
    paths = [f"{top}/label={i}" for i in range(4)]
    files, names = [], []
    for i, path in enumerate(paths):
        found = spark.read.text(path).inputFiles()  # the files that the list names
        files, names = files + found, names + [LANGS.names[i]] * len(found)
    listed = _lines(spark.createDataFrame([("\n".join(files),)], "value string").coalesce(1), scratch(spark, "list"))
    sequences, paths = readers.label_by_file(spark, listed)
    places = {p: LANGS.names.index(n) for p, n in zip(files, names, strict=True)}
    label = F.array(*(F.lit(places[p]) for p in paths))[F.col("label")]
    return ix.direct(sequences.withColumn("label", label), LANGS, K)


def lookup_saved_index(spark, d):
    """An index that is written down, read again and asked for a shorter k."""
    path = scratch(spark, "index")
    build(spark, d, 10).save(path)
    return lk.lookup(questions(spark, d), ix.load(spark, path), 9, misses=True)


def saved_universe(spark, d):
    """The strings of the conversations, written down and read as the universe of the documents' labels."""
    path = scratch(spark, "universe")
    ix.universe(turns(spark, d), S).write.parquet(path)
    return build(spark, d, within=spark.read.parquet(path)).position_labels()


def intervals_read(spark, d):
    """Annotation runs written as tab-separated lines and read as intervals."""
    path = scratch(spark, "runs")
    runs = lk.render(lk.lookup(questions(spark, d), build(spark, d), K, misses=True), query_names=True)
    # labels with blanks around them, and lines without one beside each run of a language
    blank = F.when(F.col("label_name").isin(*LANGS.names[:4]), F.array(F.concat(F.lit(" "), "label_name", F.lit("  ")), F.lit(" "))).otherwise(F.array("label_name"))
    lines = runs.withColumn("label_name", F.explode(blank)).select(F.concat_ws("\t", "query_name", "from_kmer", "to_kmer", "label_name"))
    return readers.read_intervals(spark, _lines(lines, path))


def matrix_read(spark, d):
    """The matrix of runs written as a wide table and read again."""
    path = scratch(spark, "matrix")
    writers.write_tsv(matrix_pivot(spark, d), path)
    return readers.read_matrix(spark, path)


def hierarchy_read(spark, d):
    """The tree of nations written as an edge list and read again, and that tree dumped and read."""
    t = nations(spark, d)
    plain = [n.replace(" ", "~") for n in t.names]  # blanks part the columns
    edges = [(f"{plain[i]} {plain[p]}",) for i, p in enumerate(t.parents) if i != p]
    path = _lines(spark.createDataFrame(edges, "value string").coalesce(1), scratch(spark, "edges"))
    read = readers.read_hierarchy(spark, path, plain[: len(set(range(len(t))) - set(t.parents))])
    again = LabelTree.from_dump(read.dump())
    return again.nodes(spark).select(F.translate("name", "~", " ").alias("name"), "depth", (F.col("tout") - F.col("tin") + 1).alias("n_below"))


def taxonomy_export(spark, d):
    """The tree of nations written as the two tables of a taxonomy, ids from 1 at the root, and read again."""
    names, nodes = nations(spark, d).taxonomy()
    paths = [_lines(spark.createDataFrame([("\n".join(x),)], "value string").coalesce(1), scratch(spark, "taxonomy")) for x in (names, nodes)]
    c = F.split("value", r"\t\|\t?")
    rows = spark.read.text(paths[1]).select(c[0].alias("taxid"), c[1].cast("long").alias("parent_taxid"), c[2].alias("rank"))
    return rows.join(readers.read_names(spark, paths[0]), "taxid").select(F.col("taxid").cast("long").alias("taxid"), "parent_taxid", "name", "rank")


def labels_translated(spark, d):
    """Label ids of runs as names; what has no label is novel."""
    runs = lk.lookup(questions(spark, d), build(spark, d), K, misses=True)
    ids = F.coalesce(F.col("label").cast("string"), F.lit("-"))
    return runs.select("query_name", "from_kmer", reports.translate(ids, F.col("label_name")).alias("label"))


def queries_ordered(spark, d):
    """The queries' places when some go first in a given order."""
    shown = reports.display_order(questions(spark, d).select("query_name"), "query_name", ["item7", "item3", "item9"])
    return shown.coalesce(1).select("query_name", (F.monotonically_increasing_id() + 1).alias("place"))  # a report's rows


def bench_logs(spark, d):
    """Run logs of the line items, one for each return flag and line number, told by their names: seconds, memory, speedup
    against one thread."""
    n = F.col("n")
    rows = _table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    wall = F.format_string("%d:%02d:%02d.50", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)
    text = F.concat_ws("\n", F.lit("k-mers"), F.format_string("%d.25 ns/bp", n), F.concat(F.lit("Elapsed (wall clock) time (h:mm:ss or m:ss): "), wall), F.format_string("Maximum resident set size (kbytes): %d", n * 512))
    top = scratch(spark, "logs")
    rows.select(F.format_string("%s-t%d", "l_returnflag", F.col("l_linenumber").cast("int")).alias("log"), text.alias("value")).coalesce(1).write.partitionBy("log").text(top)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for log in fs.globStatus(Path(f"{top}/log=*/part-*")):  # a file for each log takes its name
        fs.rename(log.getPath(), Path(f"{top}/{log.getPath().getParent().getName().removeprefix('log=')}.log"))
    return reports.bench_summary(readers.read_bench_logs(spark, f"{top}/*.log"))


# matches, pieces, streams, SQL


def longest_matches(spark, d):
    """The longest indexed string that ends at each letter of the items."""
    return matching.longest(questions(spark, d).select("query_rank", "seq"), build(spark, d, 10))


def index_of_pieces(spark, d):
    """Documents written as FASTA in lines, of which no record is ever one row again."""
    rows = labelled(spark, d).where("length(seq) > 0").select(F.col("label").cast("string").alias("name"), "seq")
    cut = readers.read_pieces(spark, _fasta(rows, scratch(spark, "records")), S - 1, S - 1)
    return ix.build(cut.select(F.col("name").cast("int").alias("label"), "seq", "offset", "lead", "own"), LANGS, S).position_labels()


def lookup_written(spark, d):
    """Runs written in order, by all tasks, to one file, and read again."""
    path = f"{scratch(spark, 'written')}.tsv"
    writers.write(lk.render(lk.lookup(questions(spark, d), build(spark, d), K, misses=True)), path, header=False)
    return spark.read.csv(path, sep="\t", schema="query_rank long, from_kmer long, to_kmer long, label_name string")


def lookup_observed(spark, d):
    """The windows that a lookup saw, told by its own run."""
    seen = Observation("windows")
    lk.lookup(questions(spark, d), build(spark, d), K, seen=seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n_kmers"],)], "n_kmers long")


def stream_runs(spark, d):
    """Items that arrive in thirds, one in a batch, looked up while their runs stay open."""
    top, n = scratch(spark, "stream"), F.length("seq")
    third = F.ceil(n / 3).cast("int")
    for no in range(3):
        part = F.substring("seq", no * third + 1, third)
        questions(spark, d).select(F.col("query_name").alias("query"), F.lit(no).cast("long").alias("no"), part.alias("seq"), F.lit(no == 2).alias("last")).coalesce(1).write.mode("append").json(f"{top}/in")
    stream = spark.readStream.schema("query string, no long, seq string, last boolean").option("maxFilesPerTrigger", 1).json(f"{top}/in")
    follow(stream, build(spark, d), lambda df, number: df.write.mode("overwrite").parquet(f"{top}/out/batch={number}"), f"{top}/state", K, misses=True).awaitTermination()
    return spark.read.parquet(f"{top}/out").select("query", "from_kmer", "to_kmer", "label", "label_name")


def kmer_windows_sql(spark, d):
    sqlfunctions.register(spark)
    return spark.sql(f"SELECT query_rank, w.kmer, CAST(w.pos AS BIGINT) AS pos FROM {{items}}, LATERAL kmer_windows(seq, {K}) w", items=questions(spark, d))


def set_lca_sql(spark, d):
    """Where the suppliers of each part are at home, in SQL."""
    sqlfunctions.register_tree(spark, "nations", nations(spark, d))
    home = "nations_name(nations_lca(min(nations_place(s_nationkey)), max(nations_place(s_nationkey))))"
    return spark.sql(f"SELECT l_partkey, {home} AS label_name FROM {{line}} JOIN {{supplier}} ON l_suppkey = s_suppkey GROUP BY l_partkey", line=_table(spark, d, "lineitem"), supplier=_table(spark, d, "supplier"))


# the reference's own lengths


def index_k31(spark, d):
    return ix.direct(labelled(spark, d), LANGS, 31)


def rollup_s31_to_k15(spark, d):
    return build(spark, d, 31).kmer_labels(15)


def asking(spark: SparkSession, sf_dir: str, where: str = "text is not null") -> DataFrame:
    """(query_rank, query_name, seq) of documents, all of those with a text if no other condition is given."""
    asked = _table(spark, sf_dir, "documents").where(where)
    return packed.letters(asked.select(F.col("doc_id").alias("query_rank"), F.concat(F.lit("doc"), "doc_id").alias("query_name"), "text"))


def lookup_k31(spark, d):
    """French documents looked up among those of all languages."""
    return lk.lookup(asking(spark, d, "lang = 'fr' and text is not null"), build(spark, d, 63), 31, misses=True)


FUNCTIONS = (
    longest_matches, index_of_pieces, lookup_written, lookup_observed, stream_runs, kmer_windows_sql, set_lca_sql,
    fasta_records, fastq_records, label_by_file, lookup_saved_index, saved_universe, intervals_read, matrix_read, hierarchy_read, taxonomy_export, labels_translated, queries_ordered, bench_logs, index_k31, rollup_s31_to_k15, lookup_k31,
    revcomp, acgt_runs, kmer_windows, kmer_pieces, kmer_distinct, index_build_k, index_positions, rollup_s_to_k, lookup_runs, lookup_runs_with_misses, lookup_rolled_up, lookup_forward_only, lookup_star,
    lookup_with_breaks, lookup_debug, lookup_rendered, lookup_hits_semi, lookup_misses_anti, node_stats, node_stats_pct, label_histogram, index_sizes, lookup_counts, matrix_merged, label_run_stats, none_to_root, universe_left_join, rename_labels,
    label_by_seq, hierarchy_paths, print_hierarchy, pairwise_lca, set_lca_by_part, set_lca_by_customer, matrix_long, matrix_pivot, matrix_diff, foreign_hits_to_runs, event_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FUNCTIONS}


# SQL


def _bases(col: str) -> str:
    return f"regexp_replace(upper({col}), '[^ACGT]', '', 'g')"


def _tree(t: LabelTree) -> str:
    anc = ", ".join(f"({i}, {up}, {d})" for i in range(len(t)) for d, up in enumerate(t.path(i)))
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(t.names))
    return f"anc(node, up, depth) AS (VALUES {anc}), names(id, name) AS (VALUES {names})"


DOCS = f"docs AS (SELECT CASE lang {' '.join(f"WHEN '{LANGS.names[i]}' THEN {i}" for i in range(4))} END AS label, {_bases('text')} AS seq FROM documents WHERE text IS NOT NULL AND lang IN ('de', 'en', 'es', 'fr'))"
ITEMS = f"items AS (SELECT item_id AS query_rank, 'item' || item_id AS query_name, {_bases('text')} AS seq FROM benchmark)"
TURNS = f"turns AS (SELECT {_bases('text')} AS seq FROM conversations WHERE text IS NOT NULL)"


def _windows(k: int, src: str, cols: str) -> str:
    return f"SELECT {cols}, p - 1 AS pos, substr(seq, p, {k}) AS kmer FROM (SELECT {cols}, seq, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) AS p FROM {src})"


def _strands(src: str, cols: str) -> str:
    return f"SELECT {cols}, seq FROM {src} UNION ALL SELECT {cols}, translate(reverse(seq), 'ACGT', 'TGCA') FROM {src}"


def _occ(k: int, src: str = "docs", both: bool = True) -> str:
    of = f"({_strands(src, 'label')})" if both else src
    return f"occ AS (SELECT DISTINCT kmer, label FROM ({_windows(k, of, 'label')}))"


def _mers(s: int, src: str, cols: str) -> str:
    """Positions: windows of s letters, and shorter prefixes (each sequence is one run)."""
    full = _windows(s, f"({_strands(src, cols)})", cols)
    return f"SELECT DISTINCT {cols}, kmer AS mer FROM ({full}) UNION SELECT {cols}, substr(seq, 1, j) FROM (SELECT {cols}, seq, unnest(range(1, least(length(seq), {s - 1}) + 1)) AS j FROM ({_strands(src, cols)}))"


def _lab(name: str = "lab", occ: str = "occ", key: str = "kmer") -> str:
    return (
        f"{name} AS (SELECT {key}, up AS label FROM (SELECT o.{key}, a.up, a.depth, count(*) AS c, any_value(m.m) AS m FROM {occ} o JOIN anc a ON a.node = o.label "
        f"JOIN (SELECT {key}, count(*) AS m FROM {occ} GROUP BY {key}) m ON m.{key} = o.{key} GROUP BY o.{key}, a.up, a.depth) WHERE c = m QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY depth DESC) = 1)"
    )


def _rle(k: int, lab: str = "lab", items: str = "items") -> str:
    return (
        f"w AS (SELECT w.query_rank, w.query_name, w.pos, l.label FROM ({_windows(k, items, 'query_rank, query_name')}) w LEFT JOIN {lab} l ON l.kmer = w.kmer), "
        "f AS (SELECT *, CASE WHEN pos > 0 AND label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY query_rank ORDER BY pos) THEN 0 ELSE 1 END AS new FROM w), "
        "g AS (SELECT *, sum(new) OVER (PARTITION BY query_rank ORDER BY pos) AS run FROM f), "
        "runs AS (SELECT query_rank, query_name, CAST(min(pos) AS BIGINT) AS from_kmer, CAST(max(pos) + 1 AS BIGINT) AS to_kmer, CAST(any_value(label) AS INTEGER) AS label FROM g GROUP BY query_rank, query_name, run)"
    )


def _named_runs(where: str = "") -> str:
    return f"SELECT query_rank, query_name, from_kmer, to_kmer, label, name AS label_name FROM runs LEFT JOIN names ON id = label {where}"


def _lookup(k: int, where: str = "", both: bool = True, t: LabelTree = LANGS, select: str = "") -> str:
    return f"WITH {_tree(t)}, {DOCS}, {ITEMS}, {_occ(k, both=both)}, {_lab()}, {_rle(k)} {select or _named_runs(where)}"


def _positions(s: int) -> str:
    return f"{_tree(LANGS)}, {DOCS}, occ AS ({_mers(s, 'docs', 'label')}), {_lab(key='mer')}"


RUNS_K = f"SELECT query_name AS query, from_kmer AS start, to_kmer AS \"end\", coalesce(name, 'none') AS label FROM runs LEFT JOIN names ON id = label"
NATION = """
t AS (SELECT n_nationkey AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
reg AS (SELECT region, 24 + row_number() OVER (ORDER BY min(id)) AS id FROM t GROUP BY region),
reg2 AS (SELECT region, CASE WHEN id = 25 THEN 25 ELSE id END AS id FROM reg)
"""


def _within(s: int, root: bool) -> str:
    label = f"coalesce(l.label, {LANGS.root})" if root else "l.label"
    return f"WITH {_positions(s)}, {TURNS}, u AS (SELECT DISTINCT mer FROM ({_mers(s, '(SELECT 0 AS z, seq FROM turns)', 'z')})), p AS (SELECT u.mer, CAST({label} AS INTEGER) AS label FROM u LEFT JOIN lab l ON l.mer = u.mer)"


def _hist(ctes: str, p: str, rename: str = "name") -> str:
    return (
        f"{ctes}, q AS (SELECT label FROM {p} UNION ALL SELECT NULL), e AS (SELECT id, {rename} AS name FROM names UNION ALL SELECT NULL, 'none') "
        "SELECT CAST(e.id AS INTEGER) AS label, e.name AS label_name, (SELECT count(*) FROM q WHERE q.label IS NOT DISTINCT FROM e.id) AS count FROM e"
    )


def _node_stats(s: int) -> str:
    each = " UNION ALL ".join(f"SELECT {k} AS k, kmer, label FROM (SELECT DISTINCT kmer, label FROM ({_windows(k, '(' + _strands('docs', 'label') + ')', 'label')}))" for k in range(1, s + 1))
    return (
        f"WITH {_tree(LANGS)}, {DOCS}, occ AS (SELECT kmer, label FROM ({each})), {_lab()}, c AS (SELECT length(kmer) AS k, label, count(*) AS n FROM lab GROUP BY ALL), "
        f"ns AS (SELECT CAST(k.k AS INTEGER) AS k, CAST(id AS INTEGER) AS label, name AS label_name, CAST(coalesce(n, 0) AS BIGINT) AS count FROM names CROSS JOIN (SELECT unnest(range(1, {s + 1})) AS k) k LEFT JOIN c ON c.k = k.k AND c.label = id)"
    )


def oracle_sql() -> dict[str, str]:
    star = LabelTree.star(LANGS.names[:4])
    known = f"known AS (SELECT DISTINCT kmer FROM ({_windows(12, '(' + _strands('items', 'query_rank') + ')', 'query_rank')}))"
    asked = f"asked AS (SELECT DISTINCT kmer FROM ({_windows(12, '(SELECT 0 AS z, seq FROM turns)', 'z')}))"
    raw = "(SELECT label, unnest(regexp_extract_all(seq, '[ACGT]+')) AS seq FROM rawdocs)"
    langs = " ".join(f"WHEN '{LANGS.names[i]}' THEN {i}" for i in range(4))
    mlong = "SELECT query, label, CAST(sum(\"end\" - start) AS BIGINT) AS bases FROM r GROUP BY query, label"
    cols = ", ".join(f"CAST(coalesce(sum(bases) FILTER (label = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in [*LANGS.names, "none"])
    tree_sql = f"WITH {NATION}, nodes AS (SELECT id, name, (SELECT r.id FROM reg2 r WHERE r.region = t.region) AS parent, 2 AS depth FROM t UNION ALL SELECT id, region, (SELECT 25 + count(*) FROM reg2), 1 FROM reg2 UNION ALL SELECT 25 + count(*), 'world', 25 + count(*), 0 FROM reg2)"
    home = "anc AS (SELECT n.id AS node, n.id AS up, 2 AS depth FROM nodes n WHERE depth = 2 UNION ALL SELECT id, parent, 1 FROM nodes WHERE depth = 2 UNION ALL SELECT id, (SELECT id FROM nodes WHERE depth = 0), 0 FROM nodes WHERE depth = 2)"
    placed = "lab2 AS (SELECT key, name AS label_name FROM lab JOIN nodes ON nodes.id = lab.label)"
    known31 = f"asked AS (SELECT doc_id AS query_rank, 'doc' || doc_id AS query_name, {_bases('text')} AS seq FROM documents WHERE lang = 'fr' AND text IS NOT NULL)"
    below = "SELECT name, CAST(depth AS INTEGER) AS depth, CAST(CASE depth WHEN 2 THEN 1 WHEN 1 THEN 1 + (SELECT count(*) FROM nodes c WHERE c.parent = nodes.id) ELSE (SELECT count(*) FROM nodes) END AS INTEGER) AS n_below FROM nodes"
    taxa = "tax AS (SELECT id, name, parent, depth, CASE depth WHEN 0 THEN 1 ELSE id + 2 END AS taxid FROM nodes)"
    return {
        "fasta_records": f"WITH {ITEMS} SELECT query_name AS name, seq FROM items WHERE length(seq) > 0",
        "fastq_records": f"WITH {ITEMS} SELECT row_number() OVER (ORDER BY query_rank) - 1 AS seq_rank, query_name AS name, seq FROM items WHERE length(seq) > 0",
        "label_by_file": f"WITH {_tree(LANGS)}, {DOCS}, {_occ(K)}, {_lab()} SELECT kmer, CAST(label AS INTEGER) AS label FROM lab",
        "lookup_saved_index": _lookup(9),
        "saved_universe": f"{_within(S, False)} SELECT mer, label FROM p",
        "intervals_read": _lookup(K, select="SELECT query_name AS query, from_kmer AS start, to_kmer AS \"end\", coalesce(name, 'none') AS label FROM runs LEFT JOIN names ON id = label"),
        "matrix_read": _lookup(K, select=f", r AS ({RUNS_K}), m AS ({mlong}), q AS (SELECT DISTINCT query FROM m), c AS (SELECT name AS label FROM names UNION ALL SELECT 'none') SELECT q.query, c.label, CAST(coalesce(m.bases, 0) AS DOUBLE) AS bases FROM q CROSS JOIN c LEFT JOIN m ON m.query = q.query AND m.label = c.label"),
        "hierarchy_read": f"{tree_sql} {below}",
        "taxonomy_export": f"{tree_sql}, {taxa} SELECT a.taxid, b.taxid AS parent_taxid, a.name, CASE a.depth WHEN 0 THEN 'no rank' ELSE 'clade' END AS rank FROM tax a JOIN tax b ON b.id = a.parent",
        "labels_translated": _lookup(K, select="SELECT query_name, from_kmer, coalesce(name, 'novel') AS label FROM runs LEFT JOIN names ON id = label"),
        "queries_ordered": f"WITH {ITEMS} SELECT query_name, row_number() OVER (ORDER BY CASE query_name WHEN 'item7' THEN 1 WHEN 'item3' THEN 2 WHEN 'item9' THEN 3 ELSE 4 END, query_name) AS place FROM items",
        "bench_logs": "WITH t AS (SELECT l_returnflag AS name, CAST(l_linenumber AS INTEGER) AS threads, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT name, n FROM t WHERE threads = 1) SELECT t.name, threads, t.n + 0.25::DOUBLE AS ns_per_bp, t.n + 0.5::DOUBLE AS wall_s, t.n / 2048.0::DOUBLE AS rss_gib, (o.n + 0.25::DOUBLE) / (t.n + 0.25::DOUBLE) AS speedup FROM t LEFT JOIN o USING (name)",
        "longest_matches": f"{_node_stats(10)}, {ITEMS}, e AS (SELECT query_rank, seq, unnest(range(1, length(seq) + 1)) AS e FROM items), m AS (SELECT query_rank, seq, e, unnest(range(0, least(e, 10) + 1)) AS m FROM e), "
        "f AS (SELECT query_rank, e, m, label FROM m LEFT JOIN lab ON kmer = substr(seq, CAST(e - m + 1 AS INTEGER), CAST(m AS INTEGER)) WHERE m = 0 OR kmer IS NOT NULL) "
        "SELECT query_rank, e - 1 AS pos, CAST(max(m) AS INTEGER) AS length, CAST(arg_max(label, m) FILTER (m > 0) AS INTEGER) AS label FROM f GROUP BY query_rank, e",
        "index_of_pieces": f"WITH {_positions(S)} SELECT mer, CAST(label AS INTEGER) AS label FROM lab",
        "lookup_written": _lookup(K, select="SELECT query_rank, from_kmer, to_kmer, coalesce(name, 'none') AS label_name FROM runs LEFT JOIN names ON id = label"),
        "lookup_observed": f"WITH {ITEMS} SELECT CAST(coalesce(sum(greatest(length(seq) - {K - 1}, 0)), 0) AS BIGINT) AS n_kmers FROM items",
        "stream_runs": _lookup(K, select="SELECT query_name AS query, from_kmer, to_kmer, label, name AS label_name FROM runs LEFT JOIN names ON id = label"),
        "kmer_windows_sql": f"WITH {ITEMS} {_windows(K, 'items', 'query_rank')}",
        "set_lca_sql": f"{tree_sql}, {home}, occ AS (SELECT DISTINCT l_partkey AS key, s_nationkey AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), {_lab(key='key')}, {placed} SELECT key AS l_partkey, label_name FROM lab2",
        "index_k31": f"WITH {_tree(LANGS)}, {DOCS}, {_occ(31)}, {_lab()} SELECT kmer, CAST(label AS INTEGER) AS label FROM lab",
        "rollup_s31_to_k15": f"WITH {_tree(LANGS)}, {DOCS}, {_occ(15)}, {_lab()} SELECT kmer, CAST(label AS INTEGER) AS label FROM lab",
        "lookup_k31": f"WITH {_tree(LANGS)}, {DOCS}, {known31}, {_occ(31)}, {_lab()}, {_rle(31, items='asked')} {_named_runs()}",
        "revcomp": f"SELECT doc_id, translate(reverse({_bases('text')}), 'ACGT', 'TGCA') AS rc FROM documents",
        "acgt_runs": "SELECT doc_id, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS run_no, unnest(r) AS run FROM (SELECT doc_id, regexp_extract_all(upper(text), '[ACGT]+') AS r FROM documents)",
        "kmer_windows": f"WITH {ITEMS} {_windows(K, 'items', 'query_rank')}",
        "kmer_pieces": f"WITH {ITEMS} SELECT query_rank, CAST(o AS BIGINT) AS \"offset\", CAST(o // 9 AS BIGINT) AS piece, substr(seq, CAST(o + 1 AS INTEGER), 13) AS seq FROM (SELECT query_rank, seq, unnest(range(0, greatest(length(seq) - 4, 0), 9)) AS o FROM items)",
        "kmer_distinct": f"WITH {DOCS} SELECT kmer, count(*) AS n, count(DISTINCT label) AS n_labels FROM ({_windows(K, 'docs', 'label')}) GROUP BY kmer",
        "index_build_k": f"WITH {_tree(LANGS)}, {DOCS}, {_occ(K)}, {_lab()} SELECT kmer, CAST(label AS INTEGER) AS label FROM lab",
        "index_positions": f"WITH {_positions(S)} SELECT mer, CAST(label AS INTEGER) AS label FROM lab",
        "rollup_s_to_k": f"WITH {_tree(LANGS)}, {DOCS}, {_occ(6)}, {_lab()} SELECT kmer, CAST(label AS INTEGER) AS label FROM lab",
        "lookup_runs": _lookup(K, "WHERE label IS NOT NULL"),
        "lookup_runs_with_misses": _lookup(12),
        "lookup_rolled_up": _lookup(7),
        "lookup_forward_only": _lookup(K, both=False),
        "lookup_star": _lookup(K, t=star),
        "lookup_with_breaks": f"WITH {_tree(LANGS)}, rawdocs AS (SELECT CASE lang {langs} END AS label, upper(text) AS seq FROM documents WHERE text IS NOT NULL AND lang IN ('de', 'en', 'es', 'fr')), items AS (SELECT item_id AS query_rank, 'item' || item_id AS query_name, upper(text) AS seq FROM benchmark), parts AS {raw}, {_occ(3, 'parts')}, {_lab()}, {_rle(3)} {_named_runs()}",
        "lookup_debug": _lookup(K, select=f"SELECT query_rank AS seq_rank, from_kmer, to_kmer, CASE WHEN label = {LANGS.root} THEN '*' ELSE CAST(label AS VARCHAR) END AS label FROM runs WHERE label IS NOT NULL"),
        "lookup_rendered": _lookup(K, select="SELECT query_name, from_kmer, to_kmer, coalesce(name, 'none') AS label_name FROM runs LEFT JOIN names ON id = label"),
        "lookup_hits_semi": f"WITH {ITEMS}, {TURNS}, {known}, {asked} SELECT kmer FROM asked WHERE kmer IN (SELECT kmer FROM known)",
        "lookup_misses_anti": f"WITH {ITEMS}, {TURNS}, {known}, {asked} SELECT kmer FROM asked WHERE kmer NOT IN (SELECT kmer FROM known)",
        "node_stats": f"{_node_stats(S)} SELECT * FROM ns",
        "node_stats_pct": f"{_node_stats(S)} SELECT k, label_name, count, CAST(sum(count) OVER (PARTITION BY k) AS BIGINT) AS total, CASE WHEN sum(count) OVER (PARTITION BY k) > 0 THEN 100.0::DOUBLE * count / CAST(sum(count) OVER (PARTITION BY k) AS BIGINT) END AS percent FROM ns",
        "label_histogram": _hist(_within(S, False), "p"),
        "label_run_stats": f"WITH {_positions(S)}, o AS (SELECT reverse(mer) AS rev, label FROM lab UNION ALL SELECT '', NULL), f AS (SELECT rev, CASE WHEN rev <> '' AND label IS NOT DISTINCT FROM lag(label) OVER (ORDER BY rev) THEN 0 ELSE 1 END AS new FROM o), g AS (SELECT sum(new) OVER (ORDER BY rev) AS run FROM f), r AS (SELECT run, count(*) AS n FROM g GROUP BY run) SELECT (SELECT count(*) FROM lab WHERE length(mer) = {S}) AS n_mers, (SELECT count(*) FROM lab) AS labelled, CAST(1 AS BIGINT) AS unlabelled, min(n) AS run_min, max(n) AS run_max, CAST(sum(n) AS DOUBLE) / count(*) AS run_mean FROM r",
        "index_sizes": f"WITH {_positions(S)} SELECT count(*) FILTER (length(mer) = {S}) AS n_mers, count(*) + 1 AS n_positions FROM lab",
        "lookup_counts": f"WITH {ITEMS} SELECT count(*) AS n_queries, CAST(coalesce(sum(greatest(length(seq) - {K - 1}, 0)), 0) AS BIGINT) AS n_kmers FROM items",
        "matrix_merged": _lookup(K, select=f", r AS ({RUNS_K}), m AS ({mlong}) SELECT query, CASE WHEN label IN ('germanic', 'romance') THEN 'root' ELSE label END AS label, CAST(sum(bases) AS BIGINT) AS bases FROM m GROUP BY ALL"),
        "none_to_root": _hist(_within(S, True), "p"),
        "universe_left_join": f"{_within(S, False)} SELECT mer, label FROM p",
        "rename_labels": _hist(f"WITH {_positions(S)}", "lab", "CASE name WHEN 'de' THEN 'German' WHEN 'root' THEN 'any language' WHEN 'romance' THEN 'Romance' ELSE name END"),
        "label_by_seq": f"WITH {ITEMS}, o AS (SELECT DISTINCT kmer, query_name FROM ({_windows(12, '(' + _strands('items', 'query_name') + ')', 'query_name')})) SELECT kmer, CASE WHEN count(*) = 1 THEN min(query_name) ELSE 'root' END AS label_name FROM o GROUP BY kmer",
        "hierarchy_paths": f"{tree_sql} SELECT CAST(a.id AS INTEGER) AS id, a.name, CAST(a.parent AS INTEGER) AS parent, CAST(a.depth AS INTEGER) AS depth, CASE a.depth WHEN 0 THEN '' || a.id WHEN 1 THEN a.parent || '/' || a.id ELSE b.parent || '/' || b.id || '/' || a.id END AS path FROM nodes a JOIN nodes b ON b.id = a.parent",
        "print_hierarchy": f"{tree_sql}, n AS (SELECT count(*) AS n FROM nodes) SELECT CAST(0 AS BIGINT) AS line_no, CAST(n AS VARCHAR) AS line FROM n UNION ALL SELECT id + 1, name FROM nodes UNION ALL SELECT CAST(n + row_number() OVER (ORDER BY id) AS BIGINT), id || ' ' || parent FROM nodes, n WHERE id <> parent",
        "pairwise_lca": f"{tree_sql}, up AS (SELECT a.id AS node, a.id AS up, a.depth FROM nodes a UNION SELECT a.id, b.id, b.depth FROM nodes a JOIN nodes b ON b.id = a.parent UNION SELECT a.id, r.id, 0 FROM nodes a, nodes r WHERE r.depth = 0) SELECT CAST(a.node AS INTEGER) AS a, CAST(b.node AS INTEGER) AS b, CAST(arg_max(a.up, a.depth) AS INTEGER) AS lca FROM up a JOIN up b ON a.up = b.up AND a.node <= b.node GROUP BY a.node, b.node",
        "set_lca_by_part": f"{tree_sql}, {home}, occ AS (SELECT DISTINCT l_partkey AS key, s_nationkey AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), {_lab(key='key')}, {placed} SELECT key AS l_partkey, label_name FROM lab2",
        "set_lca_by_customer": f"{tree_sql}, {home}, occ AS (SELECT DISTINCT o_custkey AS key, s_nationkey AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey), {_lab(key='key')}, {placed} SELECT key AS custkey, label_name FROM lab2",
        "matrix_long": _lookup(K, select=f", r AS ({RUNS_K}) {mlong}"),
        "matrix_pivot": _lookup(K, select=f", r AS ({RUNS_K}), m AS ({mlong}) SELECT query, {cols} FROM m GROUP BY query"),
        "matrix_diff": f"WITH a AS ({_lookup(K, select=f', r AS ({RUNS_K}) {mlong}')}), b AS ({_lookup(6, select=f', r AS ({RUNS_K}) {mlong}')}), j AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.label, b.label) AS label, coalesce(a.bases, 0) AS a, coalesce(b.bases, 0) AS b FROM a FULL JOIN b ON a.query = b.query AND a.label = b.label) SELECT query, label, a, b, a - b AS diff, round(sign(a - b) * log10(abs(a - b) + 1), 9) AS signed_log FROM j",
        "foreign_hits_to_runs": _lookup(K, select=f", r AS ({RUNS_K}) SELECT query, start, \"end\", label AS taxid FROM r"),
        "event_runs": "WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), f AS (SELECT *, CASE WHEN place > 1 AND event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY place) THEN 0 ELSE 1 END AS new FROM p), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY place) AS run FROM f) SELECT user_id, min(place) AS start, max(place) + 1 AS \"end\", any_value(event_type) AS event_type FROM g GROUP BY user_id, run",
    }
