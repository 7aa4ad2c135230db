"""Sharding by a two-pass external shuffle, in DataFrame functions only.

First pass: a seeded hash of id and text scatters the records uniformly into as many buckets as keep each at about
bucket_bytes; rows and bytes of the buckets are counted. Records that repeat so often that they would fill a bucket by
themselves are numbered, and their copies scattered, too. Second pass: each bucket goes to a task of its own, is put
into a seeded order that does not depend on how its rows arrived, and is then shuffled by Fisher and Yates. The buckets
one after the other are the shuffled corpus, whose position p goes to shard p * n_shards // n: counts differ by one at
most (law `rows`), slots have no gaps.

Null ids and texts are hashed like others, null texts have no bytes; empty tables give no rows; rows that are equal
throughout are kept, each with a slot of its own; further columns, of any type and name, are carried along (shard and
slot are replaced). Rows equal in all columns that can be hashed are dealt among their places as they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType
from pyspark.sql.window import Window

from .common import free, prepare, stored

#: Bytes of records in a bucket: the least; the most; and the number of buckets from which they grow from least to most.
LEAST_BYTES, MOST_BYTES, BUCKETS = 2 << 20, 256 << 20, 4096
#: Buckets whose counts go to each executor; those of more are joined.
SENT_BUCKETS = 1 << 20
SEED = 2029


def record_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(16)


def hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(hashable(f.dataType) for f in kind)
    return not isinstance(kind, MapType | VariantType)


def scattered(docs: DataFrame, seed: int, bucket_bytes: int | None) -> tuple[DataFrame, DataFrame, int, int, str]:
    """docs with a bucket, the buckets' counts (bucket, n, b), number of buckets and of rows, name of the column."""
    bucket, key, number = free(docs.columns, "__bucket"), free(docs.columns, "__key"), free(docs.columns, "__number")
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(record_bytes()), F.lit(0))).first()
    most = bucket_bytes or min(MOST_BYTES, max(LEAST_BYTES, size // BUCKETS))
    buckets = int(-(-size // most)) or 1

    def dealt(df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        df = df.withColumn(bucket, F.pmod(key, F.lit(buckets)).cast("int"))
        return df, df.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(record_bytes()).alias("b")).checkpoint()

    same = F.xxhash64(F.lit(seed), "doc_id", "text")
    out, counts = dealt(docs, same)
    if not counts.where(F.col("b") > 4 * most).isEmpty():
        # a record repeats, or is as long: copies of the former get numbers, which are written down to stay as they are
        numbered = stored(docs.withColumn(key, same).withColumn(number, F.monotonically_increasing_id()), "numbered")
        often = numbered.groupBy(key).agg(F.sum(record_bytes()).alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") > most)).select(key)  # at most one for each bucket
        told = numbered.join(F.broadcast(often.withColumn("__often", F.lit(True))), key, "left")
        out, counts = dealt(told, F.when(F.col("__often"), F.xxhash64(F.lit(seed), key, number)).otherwise(F.col(key)))
        out = out.select(*docs.columns, bucket)
    return out, counts, buckets, rows, bucket


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int | None = None) -> tuple[DataFrame, int, str]:
    """The records of docs with their place in the shuffled corpus, their count, and the name of the place's column."""
    prepare(docs.sparkSession)
    dealt, counts, buckets, rows, bucket = scattered(docs, seed, bucket_bytes)
    place = free([*docs.columns, bucket], "__place")
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    bases = counts.select(F.col(bucket), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    record, order = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(F.lit(seed + 1), "doc_id", "text")
    rest = F.xxhash64(F.lit(seed + 1), *(F.col(f"`{f.name}`") for f in docs.schema if hashable(f.dataType)))
    held = (
        dealt.select(bucket, order.alias("order"), rest.alias("rest"), record.alias("record"))
        .repartitionById(buckets, bucket)  # bucket i is task i, whose number seeds Fisher and Yates
        .sortWithinPartitions(bucket, "order", "rest")
        .groupBy(bucket)
        .agg(F.collect_list("record").alias("records"))  # a bucket's bytes
    )
    held = held.join(F.broadcast(bases) if buckets <= SENT_BUCKETS else bases, bucket)
    each = held.select("base", F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    return each.select("record.*", (F.col("base") + F.col("at")).alias(place)), rows, place


def shard(docs: DataFrame, n_shards: int = 40, seed: int = SEED, bucket_bytes: int | None = None) -> DataFrame:
    """The records of docs with shard (0 to n_shards - 1) and slot (0, 1, ... in each shard). Law `rows`."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows, n, place = shuffled(docs, seed, bucket_bytes)
    to = F.expr(f"cast(cast({place} as decimal(38,0)) * {n_shards} div {max(n, 1)} as int)")
    first = F.expr(f"cast((cast(shard as decimal(38,0)) * {max(n, 1)} + {n_shards - 1}) div {n_shards} as bigint)")
    return rows.withColumn("shard", to).withColumn("slot", F.col(place) - first).drop(place)


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = SEED) -> None:
    """Write the shards to path, a folder for each, rows in slot order in files that hold whole ranges of slots."""
    shard(docs, n_shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the records that shard() returns."""
    return rows.select("doc_id", record_bytes().alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
