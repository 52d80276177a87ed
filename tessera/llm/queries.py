"""The registered queries of the training-data operators (production parameters, whole tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, divergence, fingerprints, langid, licenses, mixing, packing, pii, pq, sentencepieces, simhash, toxicity, warc
from .common import documents, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@query("op2_simhash_components")
def op2(spark, sf_dir):
    return simhash.simhash_components(documents(spark, sf_dir))


@query("op5_pack_documents")
def op5(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


@query("op7_language_id")
def op7(spark, sf_dir):
    out = langid.identify(documents(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op6_embedding_near_duplicates", oracle="""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
          ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN low ON v.vec_id = low.a LEFT JOIN deg ON v.vec_id = deg.a
""")
def op6(spark, sf_dir):
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_mix_sources", oracle=r"""
WITH d AS (SELECT doc_id, text, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS wt FROM s),
t AS (SELECT *, 2 * n / wt::DOUBLE AS full_at FROM w),
f AS (SELECT *, sum(2 * n) OVER o - 2 * n AS spent, sum(wt) OVER () - sum(wt) OVER o + wt AS left_wt, 1.5 * sum(n) OVER () AS total
      FROM t WINDOW o AS (ORDER BY full_at, sid ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, spent + full_at * left_wt <= total AS capped FROM f),
g AS (SELECT *, CASE WHEN capped THEN 2.0 * n ELSE
      (total - coalesce(sum(2 * n) FILTER (WHERE capped) OVER (), 0))::DOUBLE / sum(wt) FILTER (WHERE NOT capped) OVER () * wt END::DOUBLE AS target FROM c),
p AS (SELECT d.doc_id, d.size, g.n, g.target, floor(g.target) AS whole,
             sum(d.size) OVER (PARTITION BY g.sid ORDER BY d.h, d.doc_id, d.size, d.text ROWS UNBOUNDED PRECEDING) - d.size AS a
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, n AS source_size, target,
       (greatest(0, least(a + size, whole) - a) + greatest(0, least(n + a + size, whole) - n - a))::BIGINT AS taken
FROM p
""")
def op4(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@query("op3_document_fingerprints", oracle=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC), '') AS following FROM documents),
e AS (SELECT *, length(text) AS n, substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edit FROM d),
w AS (SELECT *, [list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') FOR x IN [text, edit, following]] AS words FROM e),
s AS (SELECT *, list_transform(words, lambda v: list_sort(list_distinct([substr(md5(array_to_string(v[i:i + 4], ' ')), 1, 12)
                FOR i IN range(1, CASE WHEN len(v) = 0 THEN 1 ELSE greatest(len(v) - 3, 2) END)]))[:128]) AS k FROM w),
u AS (SELECT *, list_transform(k, lambda b: list_sort(list_distinct(list_concat(k[1], b)))[:128]) AS un FROM s),
r AS (SELECT *, [CASE WHEN len(un[j]) = 0 THEN 1.0 ELSE len(list_intersect(un[j], list_intersect(k[1], k[j]))) / len(un[j]) END FOR j IN [1, 2, 3]] AS near,
      [CASE WHEN len(x) < 128 THEN len(x)::DOUBLE ELSE 127 * (16.0::DOUBLE ** 12 / (('0x' || x[128])::BIGINT::DOUBLE + 1)) END FOR x IN [k[1], un[2]]] AS size FROM u)
SELECT doc_id, n AS n_chars, sha256(edit) AS edited_sha256, array_to_string(k[1], '') AS fingerprint, array_to_string(k[2], '') AS edited_fingerprint,
       near[2]::DOUBLE AS near_edited, near[3]::DOUBLE AS near_next,
       CASE WHEN len(k[1]) = 0 THEN 1.0 ELSE least(near[2] * size[2] / size[1], 1.0) END::DOUBLE AS contained_edited, size[1] AS distinct_shingles
FROM r
""")
def op3(spark, sf_dir):
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


@query("op8_personal_data")
def op8(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


@query("op10_warc_round_trip", oracle="""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages),
v AS (SELECT *, [('0x' || substr(h, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] AS words FROM p),
s AS (SELECT *, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> b) & 31)::INT + 1, 1) FOR b IN [15, 10, 5, 0]], '') FOR w IN words], '') AS d FROM v)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to FROM s
""")
def op10(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_toxicity")
def op1(spark, sf_dir):
    out = toxicity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op9_license_scan")
def op9(spark, sf_dir):
    out = licenses.scan(documents(spark, sf_dir))
    hits = F.transform("notices", lambda n: F.concat_ws(":", n["family"], n["start"], n["end"]))
    return out.select("doc_id", "licence", F.array_join("families", ",").alias("families"), F.array_join(hits, ",").alias("notices"))


@query("op13_sentencepiece_digests")
def op13(spark, sf_dir):
    return sentencepieces.digests(documents(spark, sf_dir))


def _lloyd_sql(rounds: int = 5) -> str:
    """The rounds of operator 12 as one query, a pair of tables a round."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k, q FROM v ORDER BY k LIMIT 40)"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min(list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) FOR i IN range(1, 65)]) * 100 + k)::BIGINT AS m
FROM v, c{r} c GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT m % 100 AS k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY m % 100, i),
u{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.q, c.q) AS q FROM c{r} c LEFT JOIN u{r} u ON u.k = c.k)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, (m % 100)::INT AS cluster, m // 100 AS distance, sum(m // 100) OVER (PARTITION BY m % 100)::BIGINT AS cluster_inertia,
       sum(m // 100) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = m % 100"""


@query("op12_centroid_clustering", oracle=_lloyd_sql())
def op12(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


@query("op11_source_divergence_audit", oracle=r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 10),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(sum(t.n), 0) AS n FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n, (1 + (1000000000::HUGEINT * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * v.v))::BIGINT AS p,
  (1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v))::BIGINT AS q FROM c JOIN v USING (lang) JOIN k USING (lang, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 10
""")
def op11(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))
