"""The queries of this subpackage: name -> function of a session and a folder of tables; SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, jaccard, language, licenses, lmscore, middle, neighbours, sharding, spelling, spotsigs, suffixes, units
from .common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeated(_table(spark, sf_dir, "documents")))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.digest(units.repeated(_table(spark, sf_dir, "documents")))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(_table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(_table(spark, sf_dir, "documents"), 40))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), damage=97)


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.rearranged(_table(spark, sf_dir, "documents")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_suffix_arrays, op3_cross_entropy, op4_units, op5_licences, op6_byte_bpe, op7_ngram_jaccard, op8_external_shuffle, op9_winnowing, op10_spotsigs, op11_spelling, op12_middle, op13_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_arrays": OP2, "op4_units": OP4, "op7_ngram_jaccard": OP7, "op9_winnowing": OP9, "op11_spelling": OP11, "op12_middle": OP12}


OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p, w FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM bs),
dp AS (SELECT doc_id, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS p, w FROM d, ks),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM dp),
h AS (SELECT dw.doc_id, dw.k, dw.p, bs.item_id FROM dw JOIN bs ON dw.k = bs.k AND dw.s = bs.s),
pos AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
b AS (SELECT doc_id, n, x, unnest(range(0, n - 99, 256)) AS c FROM d WHERE n >= 100),
y AS (SELECT doc_id, c, least(256, n - 99 - c) AS m, substr(x, 2 * c + 1, 710) AS z FROM b),
w AS (SELECT doc_id, c, unnest(range(0, m)) AS q, z FROM y),
h AS (SELECT doc_id, c + q AS p, hash(substr(z, 2 * q + 1, 200)) AS h FROM w),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS again FROM h),
g AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS new FROM k WHERE again),
r AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run),
t AS (SELECT doc_id, 0 AS a, a AS b, run FROM s WHERE run = 1 UNION ALL
      SELECT s.doc_id, s.b, coalesce(z.a, d.n), s.run + 1 FROM s JOIN d USING (doc_id) LEFT JOIN s z ON z.doc_id = s.doc_id AND z.run = s.run + 1),
u AS (SELECT t.doc_id, string_agg(substr(d.x, 2 * t.a + 1, 2 * (t.b - t.a)), '' ORDER BY t.run) AS kept FROM t JOIN d USING (doc_id) GROUP BY t.doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(u.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id)
"""

OP4 = r"""
WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*?(?:[.!?] |\n)|[^\n]+$')) AS s, generate_subscripts(regexp_extract_all(text, '[^\n]*?(?:[.!?] |\n)|[^\n]+$'), 1) AS i FROM documents),
w AS (SELECT *, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM u),
e AS (SELECT doc_id, i, len(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o, row_number() OVER (PARTITION BY array_to_string(x, ' ') ORDER BY doc_id, i) > 1 AS again FROM w WHERE len(x) > 0),
k AS (SELECT *, o - row_number() OVER (PARTITION BY doc_id ORDER BY o) AS run FROM e WHERE again),
t AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id, run) >= 20 AS gone FROM k),
r AS (SELECT u.*, coalesce(t.gone, false) AS gone FROM u LEFT JOIN t ON t.doc_id = u.doc_id AND t.i = u.i),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed_units, sum(strlen(s)) FILTER (gone) AS n_removed, string_agg(s, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed_units, 0) AS BIGINT) AS n_removed_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept, '') AS kept_text
FROM documents d LEFT JOIN g USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS x FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v AND r.c < l.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""

#: CRC-32 by its table, which the rule gives: each byte eight times halved, odd ones crossed with the polynomial.
_HALVED = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
OP11 = rf"""
WITH RECURSIVE bit(i, x, step) AS (SELECT r, r, 0 FROM (SELECT unnest(range(256)) AS r) UNION ALL SELECT i, {_HALVED.format(x="x")}, step + 1 FROM bit WHERE step < 8),
tab AS (SELECT list(x ORDER BY i) AS t FROM bit WHERE step = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS x FROM c),
y AS (SELECT doc_id, run, n, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS bytes FROM b),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, v: xor(acc // 256, t[xor(acc % 256, v) + 1])), 4294967295) AS h FROM y, tab),
d AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM g),
pair AS (SELECT a.word, b.word AS other, b.n AS m FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, w.word, w.n FROM e JOIN w ON w.word = e.rest UNION SELECT w.word, e.word, e.n FROM e JOIN w ON w.word = e.rest),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM pair QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS far FROM w UNION ALL SELECT walk.word, f.form, far + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(here, far) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, root.root, f.n, f.n_near, f.form_n FROM f JOIN root USING (word)
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE form WHEN 'plain' THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE form WHEN 'plain' THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
