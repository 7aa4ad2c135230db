"""The registered queries against their SQL on the smallest tables, and the pipeline against a plain version."""

import glob
import hashlib
import os

import duckdb
import pytest

from cladeframe.llm import language
from cladeframe.llm.queries import oracle_sql, queries
from test_llm_operators import ROWS, naive_components, naive_hits, naive_units, prose

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    got = queries()[name](spark, TABLES)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    if "doc_id" in got.columns:
        assert len(rows) == db.execute("SELECT count(*) FROM documents").fetchone()[0]
    if name in oracle_sql():
        sql = db.execute(oracle_sql()[name])
        columns = [c[0] for c in sql.description]
        assert sorted(rows, key=str) == sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in sql.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 100


def test_pipeline(spark, tmp_path):
    import random

    pipeline = pytest.importorskip("corpus_pipeline")
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from cladeframe.llm import bpe

    docs = spark.createDataFrame([r[:5] for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, " ".join(ROWS[2][1].split(" ")[3:30])), (2, prose(random.Random(8), 30))]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r[0]: tuple(r)[1:] for r in pipeline.run(spark, str(tmp_path)).collect()}
    kept = {r["doc_id"] for r in language.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= language.MIN_SCORE}
    rows = [r for r in ROWS if r[0] in kept]
    comps = naive_components(rows)
    rows = [r for r in rows if comps[r[0]][1] == r[0]]
    cut = naive_units(rows)
    rows = [(r[0], cut[r[0]][3]) for r in rows if cut[r[0]][3] or not cut[r[0]][1]]
    hit = naive_hits(rows, items)
    rows = [r for r in rows if not hit[r[0]][-1]]
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = {}
    for d, t in rows:
        ids = plain.encode_ordinary(t)
        expected[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == expected and len(got) > 20
    before = set(docs.columns)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) == before
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0
