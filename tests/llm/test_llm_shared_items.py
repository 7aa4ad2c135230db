"""Benchmark passages that many items share."""

from __future__ import annotations

import random

from cladeframe.llm import decontaminate

from test_llm_operators import naive_hits, prose


def test_passages_of_all_items(spark):
    rnd = random.Random(31)
    line = prose(rnd, 24)
    items = [(i, f"{line} {prose(rnd, 12)}") for i in range(60)] + [(60 + i, f"{prose(rnd, 12)} {line}") for i in range(5)] + [(70, line), (70, prose(rnd, 15)), (71, f"{line} {line}"), (None, line)]
    rows = [(1, line), (2, f"{prose(rnd, 5)} {items[3][1]}"), (3, prose(rnd, 60)), (4, f"{items[70 - 8][1]} {line} {line}"), (5, None), (6, " ".join(line.split(" ")[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.hits(docs, bench)).collect()}
    assert got == naive_hits(rows, [x for x in items if x[0] is not None])
    assert got[1][2] == 67 and not got[3][-1]
    known, kinds = decontaminate.benchmark_windows(bench)
    # windows of the shared line are of few kinds, and each kind lists its items once
    assert kinds.count() == kinds.distinct().count() and kinds.groupBy("k1", "k2").count().agg({"count": "max"}).first()[0] == 67
    assert known.count() > 10 * kinds.where("n > 60").select("k1", "k2").distinct().count() > 0
