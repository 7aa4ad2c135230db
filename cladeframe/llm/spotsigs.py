"""Document fingerprints from spot signatures, in DataFrame functions only.

Text is lower-cased and cut to words: ASCII letters and digits, and all characters from U+00C0 on. Every common word
(an anchor) starts a chain: the anchor and the CHAIN content words, that is words that are no anchors, which follow it,
unless more than REACH further anchors stand among them. The set of the chains' hashes is the fingerprint, written as
sorted hexadecimal numbers. Likeness is the Jaccard resemblance of two sets.

A text without any chain (null, empty, very short, no anchor) has as signatures all its runs of CHAIN words, anchors
too, or its fewer words as one; so equal texts have equal fingerprints, unlike ones differ wherever their words do, and
two texts without words have likeness 1. Ids may be null (first) or repeat (ordered by text);
the only document of a table is its own successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free

# Common words of English, German, French and Spanish that start a chain.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it not of on or she that the their there they this to was were which will with you "
    "als auf aus bei das dem den der des die ein eine für ich im ist mit nach nicht sich sie sind und von war wie zu "
    "au ce dans de du elle en est et il la le les mais ne par pas plus pour que qui se sont sur un une "
    "como con del el entre era esta este lo los más no o para pero por se su sus una y"
)
CHAIN, REACH = 2, 2
BETWEEN, MARK = r"[\x00-/:-@\[-`{-\u00bf]+", "\x01"
#: Documents in id order are cut to parts of about this many bytes, and to MAX_PARTS at most.
PART_BYTES, MAX_PARTS = 8 << 20, 1 << 15


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column of that name: the sorted distinct hashes of the chains of the column text.

    Step by step, so that nothing is computed twice: words; anchors marked; segments (an anchor and the content words
    up to the next one), of which the first CHAIN words count; the chain of each segment and the REACH next ones; for
    texts without chains the words again, for their runs.
    """
    common = sorted(set(ANCHORS.split()))
    c_heads, c_tails, c_chains, c_hashes, c_words = (free([*df.columns, name], x) for x in ("__heads", "__tails", "__chains", "__hashes", "__words"))
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN)
    marked = F.concat(F.array_join(F.transform(words, lambda w: F.when(w.isin(common), F.concat(F.lit(MARK), w)).otherwise(w)), " "), F.lit(" "))
    heads = F.transform(F.split(marked, MARK), lambda s: F.concat(F.rtrim(F.substring_index(s, " ", CHAIN + 1)), F.lit(" ")))
    tails = F.transform(c_heads, lambda h: F.substr(h, F.instr(h, F.lit(" ")) + 1))
    chains = F.transform(
        F.slice(c_heads, F.lit(2), F.greatest(F.size(c_heads) - 1, F.lit(0))),
        lambda h, i: F.substring_index(F.concat(h, *(F.coalesce(F.get(c_tails, i + 2 + j), F.lit("")) for j in range(REACH))), " ", CHAIN + 1),
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size(c_words) - CHAIN + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.xxhash64(F.lit("run"), F.array_join(F.slice(c_words, i, F.lit(CHAIN)), " ")))
    hashes = F.transform(F.filter(c_chains, lambda c: ~c.endswith(" ")), lambda c: F.xxhash64(c))
    df = df.withColumn(c_heads, heads).withColumn(c_tails, tails).withColumn(c_chains, chains).withColumn(c_hashes, F.sort_array(F.array_distinct(hashes)))
    df = df.withColumn(c_words, F.when(F.size(c_hashes) == 0, F.filter(words, lambda w: w != "")))
    return df.withColumn(name, F.when(F.size(c_hashes) > 0, F.col(c_hashes)).otherwise(F.sort_array(F.array_distinct(runs)))).drop(c_heads, c_tails, c_chains, c_hashes, c_words)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 16, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _part(bounds: list[int]) -> Column:
    """Number of bounds (sorted) at or below doc_id, found in two steps of about the square root each; null: 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    outer = F.size(F.filter(F.lit([g[0] for g in groups]), lambda x: x <= F.col("doc_id")))
    flat = F.lit(bounds)
    inner = F.size(F.filter(F.slice(flat, (F.greatest(outer, F.lit(1)) - 1) * step + 1, F.lit(step)), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull() | (outer == 0), F.lit(0)).otherwise((outer - 1) * step + inner)


def with_successor(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, and next: a struct of the same of the next document in id order (cyclic).

    The text is shuffled once, to parts that are ranges of ids; the first row of each part also goes, as a guard, to
    the end of the part before it, so that no row has to look beyond its part.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    parts = int(min(MAX_PARTS, max(1, size // PART_BYTES)))
    bounds: list[int] = []
    if parts > 1:
        points = [i / parts for i in range(1, parts)]
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", points, 20 * parts)).first()[0] or []))
    docs = docs.withColumn("part", _part(bounds))
    firsts = docs.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f")).orderBy("part").collect()  # a row for each part
    guards = [(firsts[(i + 1) % len(firsts)]["f"]["doc_id"], row["part"]) for i, row in enumerate(firsts)]
    guard = spark.createDataFrame(guards, "first_id long, to_part int")
    guarded = docs.join(F.broadcast(guard), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", F.col("to_part").alias("part"), F.lit(1).alias("guard"))
    rows = docs.select("doc_id", "text", "part", F.lit(0).alias("guard")).unionByName(guarded)
    rows = with_signatures(rows.repartition(max(1, len(firsts)), "part"), "text", "sigs")
    order = Window.partitionBy("part").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next", F.lead(F.struct("doc_id", "text", "sigs")).over(order)).where("guard = 0").drop("guard", "part")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and how like it is to that and to its successor.

    The edited text has the last half of the code points replaced by as many (or all) from the start of the next
    document's text.
    """
    rows = with_successor(docs)
    half = F.col("n_chars") - F.expr("n_chars div 2")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "sigs", F.coalesce("next.text", F.lit("")).alias("other"), F.col("next.sigs").alias("other_sigs"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), half.cast("int")), F.substring("other", F.lit(1), F.expr("cast(n_chars div 2 as int)"))))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("other_sigs")).alias("near_next"),
    )


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, representative): of the documents with one fingerprint the smallest id represents all."""
    sets = with_signatures(docs.select("doc_id", "text").where("doc_id is not null"), "text", "sigs")
    first = sets.groupBy("sigs").agg(F.min("doc_id").alias("representative"))
    return sets.select("doc_id", "sigs").join(first, "sigs").select("doc_id", "representative").distinct()


def similar(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of representatives of unlike fingerprints with likeness of threshold or more.

    Equal fingerprints are one class, represented by its smallest id; members() tells who is in it. Sets are parted by length so that sets in parts
    that are not neighbours cannot be similar enough; within a part, sets meet that share one of the rarest signatures
    of their prefix, and lengths that differ too much are pruned before the sets are compared.
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs").groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs"))
    freq = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranked = sets.select("doc_id", "n", F.explode("sigs").alias("sig")).join(freq, "sig", "left").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("order"))
    keep = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int")
    part = F.floor(F.log("n") / F.lit(-math.log(threshold))).cast("int")
    prefix = ranked.select("doc_id", "n", part.alias("part"), F.explode(F.filter(F.slice("order", F.lit(1), keep), lambda x: x["df"] > 1)).alias("x")).select("doc_id", "n", "part", F.col("x.sig").alias("sig"))
    left = prefix.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    near = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "part"]).where(near & (F.col("na") >= F.col("nb") * threshold)).select("a", "b").distinct()
    a, b = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
