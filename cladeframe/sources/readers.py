"""Readers of sequence files, lists and reports; each is a plan over Spark's text reader."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import packed
from ..operators.hierarchy import LabelTree, parse_edges


#: Endings of file names that tell FASTQ and FASTA; files with others are told by their first letter.
FASTQ, FASTA = (".fastq", ".fq"), (".fasta", ".fa", ".fna", ".ffn", ".fas")
#: Splits of files whose table is sent to every executor at most.
BROADCAST_BLOCKS = 1_000_000


def _fastq(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Which of the paths hold FASTQ; one scan reads the first letters of all whose names do not tell."""
    ends = {p: p.lower().removesuffix(".gz") for p in paths}
    kinds = {p: e.endswith(FASTQ) for p, e in ends.items() if e.endswith(FASTQ) or e.endswith(FASTA)}
    if rest := [p for p in paths if p not in kinds]:
        tops = {p: _plain(_qualified(spark, p)) for p in rest}
        place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("block")
        heads = spark.read.text(rest).select(*place, "value").where("block = 0 and value <> ''").groupBy("file").agg(F.first("value").alias("head"))
        marks = heads.where(F.col("head").startswith("@")).select("file").collect()  # a row for each file without a known ending
        # of a folder, all files must be of one kind
        kinds |= {p: any(r["file"] == top or r["file"].startswith(top.rstrip("/") + "/") for r in marks) for p, top in tops.items()}
    return kinds


def _plain(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def _placed(spark: SparkSession, rows: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """rows (file, block, at, ...) with rank, the number of a row in its file from 0; at rises within a block. sums: for
    each of these columns, before_<column>, the sum over all earlier blocks of the file.

    Blocks are the splits of the files; only their counts are gathered and summed up, the rows stay where they are. The
    blocks' table is counted, and joined by a shuffle where it is large.
    """
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), *(F.sum(c).alias(f"n_{c}") for c in sums)).persist()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), *(F.coalesce(F.sum(f"n_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums))
    told = F.broadcast(told) if blocks.count() <= BROADCAST_BLOCKS else told
    placed = rows.join(told, ["file", "block"]).withColumn("rank", F.col("base") + F.col("at") - F.col("first"))
    return placed.drop("base", "first") if sums else placed.drop("base", "first", "block", "at")


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, seq_rank, name, seq) of FASTA or FASTQ files, gzipped or not; seq_rank counts the records of a file from 0.

    Files that are not named like either are FASTQ (four lines a record) if they begin with @, else FASTA. A name is a
    header up to white space. Files are split: a row holds one record (2 GB at most), whatever the size of its file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = _fastq(spark, paths)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    empty = spark.createDataFrame([], "file string, seq_rank long, name string, seq string")
    out = []
    if fasta := [p for p in paths if not kinds[p]]:
        records = spark.read.text(fasta, lineSep="\n>").select(*place, F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("rec")).where(F.trim(F.regexp_replace("rec", r"\s+", " ")) != "")
        records = _placed(spark, records.withColumn("at", F.monotonically_increasing_id()))
        body = F.regexp_replace(F.when(F.col("rec").contains("\n"), F.regexp_replace("rec", r"^[^\n]*\n", "")).otherwise(""), r"\s", "")
        out.append(records.select("file", F.col("rank").alias("seq_rank"), F.regexp_extract("rec", r"^(\S*)", 1).alias("name"), body.alias("seq")))
    if fastq := [p for p in paths if kinds[p]]:
        lines = _placed(spark, spark.read.text(fastq).select(*place, F.regexp_replace("value", "\r", "").alias("value"), F.monotonically_increasing_id().alias("at")))
        lines = lines.where("rank % 4 < 2").groupBy("file", F.floor(F.col("rank") / 4).alias("seq_rank"))
        lines = lines.agg(F.max(F.when(F.expr("rank % 4 = 0"), F.col("value"))).alias("head"), F.max(F.when(F.expr("rank % 4 = 1"), F.col("value"))).alias("seq")).where("seq is not null")
        out.append(lines.select("file", F.col("seq_rank").cast("long").alias("seq_rank"), F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.trim("seq").alias("seq")))
    return reduce(DataFrame.unionByName, out, empty) if len(out) != 1 else out[0]


def read_pieces(spark: SparkSession, paths: str | list[str], before: int, after: int, size: int = packed.PIECE) -> DataFrame:
    """(file, seq_rank, name, offset, seq, lead, own) of FASTA files, a row for each piece of size letters of a record, as
    packed.pieces() cuts them: own letters from offset on, with at least before letters ahead of them (lead) and after
    behind, as far as the record has them. No record is ever one row: chromosomes of any length may be read.

    Lines are rows. Their record, and where in it they begin, are running counts: of the splits first, whose sums are
    small, then within each split. Lines that a piece needs meet in it, so a line is moved once, or twice at a seam.
    """
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(paths).select(*place, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\s+$", "").alias("line")).where("line <> ''")
    head = F.col("line").startswith(">")
    lines = lines.withColumns({"heads": head.cast("long"), "letters": F.when(head, 0).otherwise(F.length("line")).cast("long")})
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = _placed(spark, lines, ("heads", "letters"))
    lines = lines.withColumn("seq_rank", F.col("before_heads") + F.sum("heads").over(within) - 1).withColumn("end", F.col("before_letters") + F.sum("letters").over(within))
    # a record begins where the letters ahead of its header end
    heads = lines.where("heads = 1").select("file", "seq_rank", F.regexp_extract("line", r"^>(\S*)", 1).alias("name"), F.col("end").alias("begin"))
    body = lines.where("heads = 0 and seq_rank >= 0").select("file", "seq_rank", "line", "letters", "end").join(heads, ["file", "seq_rank"])
    start, stop = F.col("end") - F.col("letters") - F.col("begin"), F.col("end") - F.col("begin")
    first, last = F.greatest(F.floor((start - after) / size), F.lit(0)), F.floor((stop - 1 + before) / size)
    each = body.select("file", "seq_rank", "name", start.alias("start"), "line", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("piece"))
    # a long line gives each piece the letters that it needs of it
    low, high = F.greatest(F.col("piece") * size - before, F.lit(0)), (F.col("piece") + 1) * size + after
    skip = F.greatest(low - F.col("start"), F.lit(0))
    part = F.substring("line", (skip + 1).cast("int"), (high - F.greatest("start", low)).cast("int"))
    met = each.select("file", "seq_rank", "name", "piece", (F.col("start") + skip).alias("start"), part.alias("part")).where("part <> ''")
    met = met.groupBy("file", "seq_rank", "name", "piece").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    joined = met.select("file", "seq_rank", "name", (F.col("piece") * size).alias("offset"), F.col("parts")[0]["start"].alias("from"), F.array_join("parts.part", "").alias("seq"))
    sized = joined.withColumn("lead", (F.col("offset") - F.col("from")).cast("int")).withColumn("own", F.least(F.lit(size), F.length("seq") - F.col("lead")).cast("int"))
    return sized.where("own > 0").select("file", "seq_rank", "name", "offset", "seq", "lead", "own")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_rank, query_name, seq) of one file."""
    return read_sequences(spark, path).select(F.col("seq_rank").alias("query_rank"), F.col("name").alias("query_name"), "seq")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small list (files, names, edges), in order, as they stand."""
    text = spark.read.text(path, wholetext=True).first()
    lines = text["value"].replace("\r\n", "\n").split("\n") if text else []
    return lines[:-1] if lines and lines[-1] == "" else lines


def read_hierarchy(spark: SparkSession, path: str | None, labels: list[str]) -> LabelTree:
    """The tree of an edge list; without one all labels are below one root."""
    return LabelTree.from_edges(labels, parse_edges(read_lines(spark, path))) if path else LabelTree.star(labels)


def label_by_file(spark: SparkSession, list_path: str, labels_path: str | None = None) -> tuple[DataFrame, list[str]]:
    """(label, seq) and label names: each listed file is a label, named by itself or by the line of labels_path."""
    files = read_lines(spark, list_path)
    names = read_lines(spark, labels_path) if labels_path else files
    if len(names) != len(files):
        raise ValueError(f"{len(names)} labels for {len(files)} files")
    rows = read_sequences(spark, list(dict.fromkeys(files)))  # one scan for all files, whose labels are joined
    labels = spark.createDataFrame([(_qualified(spark, f), i) for i, f in enumerate(files)], "file string, label int")
    labels = labels.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    return rows.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")).join(F.broadcast(labels), "file").select("label", "seq"), names


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers name it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def label_by_seq(spark: SparkSession, path: str, labels_path: str | None = None) -> tuple[DataFrame, list[str]]:
    """(label, seq) and label names: the i-th record of a file is label i, named by its header or the i-th line."""
    rows = read_sequences(spark, path)
    found = [r["name"] for r in rows.orderBy("seq_rank").select("name").collect()]  # a row for each label
    names = read_lines(spark, labels_path) if labels_path else found
    if len(names) != len(found):
        raise ValueError(f"{len(names)} labels for {len(found)} records")
    return rows.select(F.col("seq_rank").cast("int").alias("label"), "seq"), names


def read_renames(spark: SparkSession, path: str) -> dict[str, str]:
    """First and second column (which may hold tabs) of each line; of repeated keys the last counts."""
    out = {}
    for line in read_lines(spark, path):
        if line.strip():
            key, tab, name = line.partition("\t")
            if not tab:
                raise ValueError(f"no tab in line {line!r}")
            out[key] = name
    return out


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(query, start, end, label) of tab-separated lines, gzipped or not: the label is the last column without blanks
    around it, numbers that cannot be read are 0, lines without a tab or with an empty label are skipped."""
    cols = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").contains("\t")).select(cols.alias("c"))
    number = lambda i: F.coalesce(F.get("c", F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    return rows.select(F.get("c", F.lit(0)).alias("query"), number(1).alias("start"), number(2).alias("end"), F.regexp_replace(F.element_at("c", -1), r"^\s+|\s+$", "").alias("label")).where("label <> ''")


def hits_to_runs(lines: DataFrame) -> DataFrame:
    """(query, start, end, taxid) of another classifier's lines (value): status, query, taxid, length, hits `taxid:count`.

    Unclassified lines and lines of fewer than five columns give nothing; a run starts where the counts before it end,
    which is a running sum over each line's hits.
    """
    c = F.split("value", "\t", 5)
    rows = lines.select(c.alias("c")).where((F.size("c") == 5) & (F.get("c", F.lit(0)) != "U"))
    hits = F.filter(F.split(F.trim(F.get("c", F.lit(4))), r"\s+"), lambda x: x.contains(":") & (x != "|:|"))
    each = rows.select(F.get("c", F.lit(1)).alias("query"), hits.alias("hits"), F.monotonically_increasing_id().alias("line")).select("query", "line", F.posexplode("hits").alias("i", "hit"))
    each = each.select("query", "line", "i", F.split("hit", ":", 2)[0].alias("taxid"), F.coalesce(F.split("hit", ":", 2)[1].try_cast("long"), F.lit(0).cast("long")).alias("count"))
    end = F.sum("count").over(Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", end).select("query", (F.col("end") - F.col("count")).alias("start"), "end", "taxid")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, name) of a names table with columns between bars."""
    c = F.split("value", r"\t?\|\t?")
    return spark.read.text(path).where(F.col("value").contains("|")).select(F.trim(F.get(c, F.lit(0))).alias("taxid"), F.trim(F.get(c, F.lit(1))).alias("name"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(query, label, bases) of a wide tab-separated matrix whose first column holds the queries."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, labels = wide.columns[0], wide.columns[1:]
    return wide.select(F.col(f"`{first}`").alias("query"), *(F.col(f"`{c}`").cast("double").alias(c) for c in labels)).unpivot(["query"], labels, "label", "bases")


def read_bench_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, threads, ns_per_bp, wall, rss_kib) of run logs with the figures of time -v; name and threads are of the
    file name, as in `name-t8.log`."""
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.log$", 1).alias("f"), "value")
    figure = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return files.select(
        F.regexp_extract("f", r"^(.*)-t\d+$", 1).alias("name"), F.regexp_extract("f", r"-t(\d+)$", 1).try_cast("int").alias("threads"),
        figure(r"([0-9.]+) ?(?:ns/bp|nanoseconds/base ?pair)").cast("double").alias("ns_per_bp"), figure(r"Elapsed \(wall clock\) time[^\n]*: ([0-9:.]+)").alias("wall"), figure(r"Maximum resident set size \(kbytes\): (\d+)").cast("long").alias("rss_kib"),
    )
