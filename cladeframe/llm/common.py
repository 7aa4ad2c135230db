"""What the operators share on the Spark side: shared storage, id filters and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids (or hashes) of eight bytes that may be broadcast at most; larger sets are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Rows that an Arrow batch holds at most: long texts must not make a batch too large for a worker.
ARROW_ROWS = 512
#: Edges of a graph that one task joins, at most (some 150 MB of its memory).
TASK_EDGES = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Make sure that a checkpoint folder is set, and that Arrow batches of whole texts stay small.

    The folder named in spark.checkpoint.dir is used where there is one. Without one a temporary folder is set in
    local mode only; a cluster must name a shared folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    _ship(sc)
    return spark


def _ship(sc) -> None:
    """Send this package to the executors, once for each context: their Python need not have it."""
    if getattr(sc, "_cladeframe_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._cladeframe_shipped = True


def free(columns, name: str) -> str:
    """name, with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ids_repeat(docs: DataFrame) -> bool:
    """Whether several rows have one id that is not null; counted."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def keyed(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """docs with a further column, its name, and the documents (doc_id, text) that it names, it standing for doc_id.

    Where no id repeats, which is counted, the column is the id. Else rows of one id are told apart by their texts:
    documents are then numbered in the order of id and of a hash of the text (null texts count as empty ones), and rows
    equal in both are one document. Rows without an id have null there and are no document.
    """
    key, digest = free(docs.columns, "__document"), free(docs.columns, "__digest")
    if not ids_repeat(docs):
        docs = docs.withColumn(key, F.col("doc_id").cast("long"))
        return docs, key, docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text")
    told = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    # numbers rise over the ranges of a sort and within them; written down, they stay what they are
    order = told.where("doc_id is not null").select("doc_id", digest).distinct().orderBy("doc_id", digest)
    order = stored(order.withColumn(key, F.monotonically_increasing_id()), "keys")
    docs = told.join(order, ["doc_id", digest], "left").select(*docs.columns, key)
    return docs, key, docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text").dropDuplicates(["doc_id"])


def keep_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int, anti: bool = False) -> DataFrame:
    """Rows of df whose key is (anti: is not) in ids, which has n_ids rows. A counted small set goes to each executor."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_anti" if anti else "left_semi")


def _join_edges(batches):
    least: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := least.setdefault(root, root)) != root:
            root = up
        while x != root:
            least[x], x = root, least[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    nodes = list(least)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): component is the smallest node that links reach.

    Up to TASK_EDGES edges, which are counted, are joined in one task. More of them go through alternating large and small
    stars: each round is two grouped minima and two joins on single edges, so no neighbourhood is ever gathered in one
    place. An empty input gives no rows; loops and repeated edges do no harm.
    """
    edges = edges.select("a", "b").checkpoint()
    if edges.count() <= TASK_EDGES:
        return edges.coalesce(1).mapInArrow(_join_edges, "node long, component long")
    both = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    now, before = both.checkpoint(), None
    while True:
        sides = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("m").alias("v"), "u").unionByName(small.select(F.col("m").alias("v"), F.col("v").alias("u")))
        now = small.where("u <> v").distinct().checkpoint()
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the checkpoint folder, under a new name, and read again."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
