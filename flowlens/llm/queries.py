"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embed_dedup, langid, lm_score, mixing, pii, preferences, probminhash, quality, toxicity, warc, whitening
from .common import saved, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("matches").alias("n_matches"))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), target)


def op4_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(preferences.ordered(table(spark, sf_dir, "conversations")), "turns")
    same = saved(preferences.pair_by_opening(turns), "pairs")
    out = preferences.format_pairs(turns, same.union(preferences.pair_neighbours(turns, same)))
    spans = {c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["start"], m["end"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return out.withColumns(spans)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ipf_mixing,
        op2_toxicity_lexicon,
        op3_cross_entropy_difference,
        op4_multi_index_dedup,
        op5_pii,
        op6_qgram_decontamination,
        op7_language_id,
        op8_preference_formatting,
        op9_warc_index,
        op10_probminhash_dedup,
        op11_quality_classifier,
        op12_source_divergence,
        op13_embedding_whitening,
    )
}

PREFERENCES_SQL = """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS r FROM conversations WHERE conv_id IS NOT NULL),
 size AS (SELECT conv_id, sum(coalesce(length(text), 0)) AS chars, count(*) AS turns FROM t GROUP BY 1),
 opening AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY role, text ORDER BY chars DESC, conv_id) AS k FROM t JOIN size USING (conv_id) WHERE pos = 0),
 same AS (SELECT b.conv_id AS chosen, f.conv_id AS rejected FROM opening f JOIN opening b ON b.k = 1 AND f.k > 1 AND f.role IS NOT DISTINCT FROM b.role AND f.text IS NOT DISTINCT FROM b.text),
 rest AS (SELECT conv_id, conv_id // 2 AS g, row_number() OVER (PARTITION BY conv_id // 2 ORDER BY chars DESC, conv_id) AS k FROM size WHERE conv_id NOT IN (SELECT chosen FROM same UNION SELECT rejected FROM same)),
 pairs AS (SELECT * FROM same UNION ALL SELECT a.conv_id, b.conv_id FROM rest a JOIN rest b ON a.g = b.g AND a.k = 1 AND b.k = 2),
 cut AS (SELECT p.chosen AS cid, p.rejected AS rid, x.turns AS na, y.turns AS nb, coalesce(min(a.pos) FILTER (a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text), least(x.turns, y.turns)) AS n
  FROM pairs p JOIN size x ON x.conv_id = chosen JOIN size y ON y.conv_id = rejected JOIN t a ON a.conv_id = chosen JOIN t b ON b.conv_id = rejected AND a.pos = b.pos GROUP BY p.chosen, p.rejected, x.turns, y.turns),
 rows AS (SELECT c.*, 'a' AS side, t.pos, t.role, t.r FROM cut c JOIN t ON t.conv_id = cid UNION ALL SELECT c.*, 'b', t.pos, t.role, t.r FROM cut c JOIN t ON t.conv_id = rid),
 placed AS (SELECT *, sum(length(r)) OVER (PARTITION BY cid, rid, side, pos >= n ORDER BY pos) AS stop FROM rows)
SELECT cid AS chosen_id, rid AS rejected_id, CAST(n AS INTEGER) AS n_common,
 coalesce(string_agg(r, '' ORDER BY pos) FILTER (side = 'a' AND pos < n), '') AS prompt,
 coalesce(string_agg(r, '' ORDER BY pos) FILTER (side = 'a' AND pos >= n), '') AS chosen,
 coalesce(string_agg(r, '' ORDER BY pos) FILTER (side = 'b' AND pos >= n), '') AS rejected,
 coalesce(string_agg((stop - length(r) + 5 + length(role)) || ':' || stop, ',' ORDER BY pos) FILTER (side = 'a' AND pos >= n AND role = 'assistant'), '') AS chosen_mask,
 coalesce(string_agg((stop - length(r) + 5 + length(role)) || ':' || stop, ',' ORDER BY pos) FILTER (side = 'b' AND pos >= n AND role = 'assistant'), '') AS rejected_mask,
 n = na AND n = nb AS identical
FROM placed GROUP BY cid, rid, n, na, nb"""

DIVERGENCE_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
 g AS (SELECT DISTINCT lang, source FROM d),
 langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
 sizes AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
 p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (coalesce(s.total, 0) + 2 * l.v)::HUGEINT AS p,
   1 + 1000000000 * (k.n + 2)::HUGEINT // (l.total + 2 * l.v)::HUGEINT AS q
   FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op8_preference_formatting": PREFERENCES_SQL, "op12_source_divergence": DIVERGENCE_SQL}
