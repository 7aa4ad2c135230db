"""Functions of this library in SQL: revcomp(seq), acgt_runs(seq), kmers(seq, k), signed_log(x), the table function
kmer_windows(seq, k), and those of a tree."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.hierarchy import LabelTree
from . import tree

# Temporary SQL functions: their bodies are expressions, so queries with them are planned like any other.
FUNCTIONS = (
    ("revcomp", "seq STRING", "STRING", "translate(reverse(seq), 'ACGTacgt', 'TGCATGCA')"),
    ("acgt_runs", "seq STRING", "ARRAY<STRING>", "regexp_extract_all(translate(seq, 'acgt', 'ACGT'), '[ACGT]+', 0)"),
    ("kmers", "seq STRING, k INT", "ARRAY<STRING>", "CASE WHEN length(seq) >= k THEN transform(sequence(1, length(seq) - k + 1), i -> substring(seq, i, k)) ELSE array() END"),
    ("signed_log", "x DOUBLE", "DOUBLE", "signum(x) * log10(abs(x) + 1)"),
    # the ancestor of two nodes by their paths from the root (columns path of a tree's table)
    ("path_lca", "a ARRAY<INT>, b ARRAY<INT>", "INT", "element_at(array_intersect(a, b), size(array_intersect(a, b)))"),
)


# Table functions: a row for each window of k letters, for LATERAL joins.
TABLES = (("kmer_windows", "seq STRING, k INT", "pos INT, kmer STRING", "SELECT pos, kmer FROM (SELECT posexplode(CASE WHEN length(seq) >= k THEN transform(sequence(1, length(seq) - k + 1), i -> substring(seq, i, k)) END) AS (pos, kmer))"),)


def register(spark: SparkSession) -> None:
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, arguments, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def register_tree(spark: SparkSession, prefix: str, labels: LabelTree) -> None:
    """For a tree of up to tree.INLINE nodes: <prefix>_place(id), its place in depth-first order; <prefix>_lca(lo, hi), the
    id of the ancestor of all places between two; <prefix>_name(id).

    The ancestor of a group is prefix_lca(min(prefix_place(id)), max(prefix_place(id))) in any GROUP BY, rollup or window:
    the aggregates are Spark's own, so they are summed up on the map side.
    """
    if len(labels) > tree.INLINE:
        raise ValueError(f"the tree has {len(labels)} nodes; {tree.INLINE} can be constants of SQL functions")
    rank, parent = tree.ranks(labels)
    numbers = lambda x: f"cast(split('{','.join(map(str, list(x)))}', ',') AS ARRAY<INT>)"
    n, by_tin = len(labels), sorted(range(len(labels)), key=labels.tin.__getitem__)
    minima = numbers(x for row in tree.sparse(rank) for x in row.tolist())
    level = "length(bin(greatest(hi - lo, 1))) - 1"
    lca = f"CASE WHEN lo = hi THEN get({numbers(by_tin)}, lo) WHEN lo IS NOT NULL THEN get({numbers(parent.tolist())}, least(get({minima}, ({level}) * {n} + lo + 1), get({minima}, ({level}) * {n} + hi + 1 - shiftleft(1, {level})))) END"
    names = "array(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in labels.names) + ")"
    for name, arguments, kind, body in (("place", "id INT", "INT", f"get({numbers(labels.tin)}, id)"), ("lca", "lo INT, hi INT", "INT", lca), ("name", "id INT", "STRING", f"get({names}, id)")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({arguments}) RETURNS {kind} RETURN {body}")
