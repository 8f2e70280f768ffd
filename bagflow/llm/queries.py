"""The queries of this subpackage's operators over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exponion, html_text, lm_score, ngram_join, packing, pii, quality, simhash, tiers, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_fingerprints: for ids divisible by 20, how many other distinct fingerprints lie within 20 bits; else null."""
    prints = simhash.with_edits(_table(spark, sf_dir, "documents"))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = simhash.count_near(prints, prints.filter(asked))
    counted = simhash.with_counts(prints.filter(asked), found)
    return counted.unionByName(prints.filter(~asked).withColumn("near_fingerprints", F.lit(None).cast("long")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(_table(spark, sf_dir, "embeddings"))


def op12_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.pack_tiers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_decontaminate": op2_decontaminate,
    "op3_ngram_join": op3_ngram_join,
    "op4_lm_score": op4_lm_score,
    "op5_html": op5_html,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_exponion": op11_exponion,
    "op12_tiers": op12_tiers,
    "op13_divergence": op13_divergence,
}


def _rounds_in_sql(rounds: int = 10) -> str:
    """Clustering in SQL, a round after the other; a row of a centroid's or vector's components is (id, i, x)."""

    def nearest(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT v, arg_min(k, (d, k)) AS k, min(d) AS d FROM
 (SELECT e.v, c.k, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY v)"""

    def moved(r: int) -> str:
        return f"""m{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN e USING (v) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - (s % n + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN m{r} USING (k, i))"""

    steps = ",\n".join(f"{nearest(r)},\n{moved(r)}" for r in range(rounds))
    return f"""WITH g AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, embedding::double[] AS embedding FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
e AS MATERIALIZED (SELECT v, unnest(range(64)) AS i, floor(1024 * unnest(embedding))::bigint::hugeint AS x FROM g),
s AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k FROM g),
c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN e USING (v) WHERE k < 8),
{steps},
{nearest(rounds)},
t AS (SELECT k, sum(d) AS d FROM a{rounds} GROUP BY k),
h AS (SELECT k, sha256(string_agg(x::varchar, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, k::int AS cluster, a.d::bigint AS distance, t.d::bigint AS cluster_inertia, (SELECT sum(d) FROM t)::bigint AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN g USING (v) JOIN t USING (k) JOIN h USING (k)"""


#: Where SQL can express a whole result. The others' results (token ids, hashed sketches, compressed sizes, models) are
#: beyond it; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b
 ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id, component_id FROM s JOIN c USING (doc_id)""",
    "op8_warc": """WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first, array_to_string(list_transform(range(8),
 lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha, i * 5 + 1, 5))::bigint >> k & 31)::int, 1)), '')), '') AS digest FROM h)
SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op11_exponion": _rounds_in_sql(),
    "op13_divergence": r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM (SELECT i, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS terms, sum(n) AS n FROM k GROUP BY 1),
o AS (SELECT * FROM c SEMI JOIN k USING (lang, term)),
t AS (SELECT lang, source, sum(n) AS n FROM o GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(t.n, 0)::hugeint AS n, coalesce(v.terms, 0)::hugeint AS terms FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000::hugeint * (coalesce(o.n, 0) + 1) // (g.n + g.terms) AS p
 FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
 UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.terms = 0),
q AS (SELECT lang, term, 1 + 1000000000::hugeint * (k.n + 1) // (v.n + v.terms) AS q FROM k JOIN v USING (lang)),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
r AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms)
SELECT lang, source, part, item, value::bigint AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200""",
}
