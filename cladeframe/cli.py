"""Command line: build, lookup, prompt, stats, node-stats, print-hierarchy, lookup-debug, rename-labels."""

from __future__ import annotations

import argparse
import shlex
import sys
import time
from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession

from .operators import index as ix
from .operators import lookup as lk
from .operators import stats
from .plans.session import session
from .sources import readers, writers


def _size(text: str) -> int:
    value = int(text)
    if not 1 <= value <= 256:
        raise argparse.ArgumentTypeError("must be from 1 to 256")
    return value


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def _lookup_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-q", "--query", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("--report-query-names", action="store_true")
    p.add_argument("--report-label-ids", action="store_true")
    p.add_argument("--report-misses", action="store_true")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--batch-size", type=_positive, default=1_000_000, help="accepted for scripts; pieces are cut by the engine")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeframe")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build", help="index labelled sequences")
    p.add_argument("-s", type=_size, default=31)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--label-by-file", metavar="LIST")
    source.add_argument("--label-by-seq", metavar="FASTA")
    p.add_argument("-u", "--unitigs", help="sequences whose strings are the index's, whatever is labelled")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--labels")
    p.add_argument("--hierarchy")
    p.add_argument("--forward-only", action="store_true")
    p.add_argument("--none-to-multiple", action="store_true", help=argparse.SUPPRESS)
    p.add_argument("--load-universe", help="folder of a saved universe")
    p.add_argument("--save-universe", help="folder for the index's strings without labels")
    p.add_argument("--external-memory", help="accepted for scripts; shuffles spill by themselves")
    p.add_argument("-t", "--threads", type=_positive)
    p = sub.add_parser("lookup", help="annotate queries")
    _lookup_options(p)
    q = sub.add_parser("prompt")
    for x in (p, q):
        x.add_argument("-i", "--index", required=True)
        x.add_argument("-k", type=_size)
        x.add_argument("-t", "--threads", type=_positive)
    p = sub.add_parser("lookup-debug")
    p.add_argument("-q", "--query", required=True)
    p.add_argument("-i", "--index", required=True)
    for name in ("stats", "print-hierarchy"):
        sub.add_parser(name).add_argument("-i", "--index", required=True)
    p = sub.add_parser("node-stats")
    p.add_argument("--index", required=True)
    p.add_argument("--report-label-ids", action="store_true")
    p.add_argument("-t", "--threads", type=_positive)
    p = sub.add_parser("rename-labels")
    p.add_argument("-i", "--index", required=True)
    p.add_argument("--new-names", required=True)
    p.add_argument("--names-to-names", action="store_true")
    p.add_argument("-o", "--output", required=True)
    return top


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.label_by_file:
        sequences, names = readers.label_by_file(spark, a.label_by_file, a.labels)
    else:
        sequences, names = readers.label_by_seq(spark, a.label_by_seq, a.labels)
    labels = readers.read_hierarchy(spark, a.hierarchy, names)
    within = None
    if a.load_universe:
        meta = spark.read.parquet(a.load_universe)
        longest = meta.selectExpr("max(n)").first()[0]
        if longest is not None and longest != a.s:
            raise ValueError(f"the universe in {a.load_universe} has strings of {longest} letters, not {a.s}")
        within = meta
    elif a.unitigs:
        within = ix.universe(readers.read_sequences(spark, a.unitigs), a.s, a.forward_only)
    index = ix.build(sequences, labels, a.s, a.forward_only, within, a.none_to_multiple)
    if a.save_universe:
        index = index.cache()
        index.positions.drop("lo", "hi").write.parquet(a.save_universe)
    index.save(a.output)


def lookup(spark: SparkSession, index: ix.Index, a: argparse.Namespace, k: int | None, labels=None) -> None:
    # a result that is streamed to standard output tells no counts
    seen, began = Observation("lookup") if a.output else None, time.time()
    runs = lk.lookup(readers.read_queries(spark, a.query), index, k, a.report_misses, labels, seen)
    writers.write(lk.render(runs, a.report_query_names, a.report_label_ids), a.output, not a.no_header)
    if seen:
        n, spent = seen.get["n_kmers"], time.time() - began
        print(f"{n} k-mers, {1e9 * spent / n:.1f} ns each" if n else "no k-mers", file=sys.stderr)


def prompt(spark: SparkSession, a: argparse.Namespace, lines=None) -> None:
    """One lookup for each line of options; the labels of the strings of k letters are rolled up once and kept, and what
    goes wrong does not end the session."""
    index = ix.load(spark, a.index)
    labels = index.packed_labels(a.k).persist()
    options = argparse.ArgumentParser(prog="", add_help=False, exit_on_error=False)
    _lookup_options(options)
    for line in lines if lines is not None else sys.stdin:
        words = shlex.split(line)
        if words[:1] and words[0] in ("quit", "exit", "q"):
            return
        if not words:
            print(options.format_help())
            continue
        try:
            lookup(spark, index, options.parse_args(words), a.k, labels)
        except (Exception, SystemExit) as error:  # noqa: BLE001
            print(f"error: {error}", file=sys.stderr)


def print_stats(index: ix.Index) -> None:
    row = stats.run_stats(index).first()
    print(f"s: {index.s}\nstrings of s letters: {row['n_mers']}\nlabelled positions: {row['labelled']}\nunlabelled positions: {row['unlabelled']}")
    print(f"label runs: min {row['run_min']}, max {row['run_max']}, mean {row['run_mean']:.2f}")
    for r in stats.histogram(index).orderBy("label").collect():  # a row for each label
        print(f"{'-' if r['label'] is None else r['label']}\t{r['label_name']}\t{r['count']}")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    threads = getattr(a, "threads", None)
    spark = spark or session(threads=threads)
    try:
        if a.command == "build":
            build(spark, a)
            return 0
        index = ix.load(spark, a.index)
        if a.command == "lookup":
            lookup(spark, index, a, a.k)
        elif a.command == "prompt":
            prompt(spark, a)
        elif a.command == "stats":
            print_stats(index)
        elif a.command == "print-hierarchy":
            print("\n".join(index.labels.dump()))
        elif a.command == "lookup-debug":
            writers.write(lk.render_debug(lk.lookup(readers.read_queries(spark, a.query), index), index.labels))
        elif a.command == "node-stats":
            found = stats.node_stats(index).sort("k", "label", ascending=[False, True])
            writers.write(found.select("k", ("label" if a.report_label_ids else "label_name"), "count").toDF("k", "label", "count"))
        elif a.command == "rename-labels":
            names = readers.read_renames(spark, a.new_names)
            index = index.rename_by_name(names) if a.names_to_names else index.rename({int(i): n for i, n in names.items()})
            index.save(a.output)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
