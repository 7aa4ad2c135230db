"""The pipeline's stages on null and repeated ids, null and empty texts, repeated rows and clashing columns."""

from __future__ import annotations

import random

import pytest
from test_llm_operators import ROWS, prose


def test_pipeline_edges(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(51)
    fresh = [prose(rnd, 60) for _ in range(4)]
    odd = [(None, fresh[0]), (None, fresh[1]), (9001, fresh[2]), (9001, fresh[3]), (9002, None), (9003, ""), (9004, fresh[0]), (9005, prose(rnd, 40) + ".\n" + fresh[2])]
    rows = [(*r[:5], 1, "x", "y") for r in ROWS] + [(d, t, "en", "s", len(t or ""), 1, "x", "y") for d, t in odd + odd[:1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, digest string, windows string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, fresh[3]), (None, fresh[1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = set(docs.columns)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert set(docs.columns) == columns, name
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert (9001, fresh[2]) in kept and (9001, fresh[3]) not in kept and not {9002, 9003} & {d for d, _ in kept}
    tokens = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in tokens) == sorted(str(d) for d, _ in kept)
    assert sorted(t for d, t in kept if d is None) == sorted([fresh[0], fresh[0], fresh[1]]) and (9004, fresh[0]) in kept
