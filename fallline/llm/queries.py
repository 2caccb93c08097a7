"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallline.llm import byte_bpe, decontaminate, importance, jaccard_join, license_scan, lm_score, quality_rules, token_store, warc, wrapper
from fallline.llm.license_texts import BASE_PHRASES, NOTICES
from fallline.runtime import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_store.checksums(token_store.read_tokens(spark, path))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"), size=3, percent=90)
    return classes.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    records = warc.read_archive(spark, path, with_payload=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    target, background = lm_score.models(docs, _table(spark, sf_dir, "labels"))
    losses = ("target_loss", "background_loss", "loss_difference")
    return lm_score.score(docs, target, background).withColumns({c: F.round(c, 6) for c in losses})


OP8_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
    SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)
        for i in range(32)], '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM q
"""


def _op3_sql() -> str:
    quoted = ",\n".join(f"({k}, '{label}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (text, label) in enumerate(NOTICES))
    phrases = ",\n".join(f"({phrase.split(' ')!r}, '{label}')" for phrase, label in BASE_PHRASES)
    return rf"""
WITH notices(notice, label, source) AS (VALUES {quoted}), phrases(phrase, label) AS (VALUES {phrases}
), nw AS (
    SELECT notice, label, list_filter(string_split_regex(lower(source), '[^a-z0-9]+'), lambda x: x <> '') AS v FROM notices
), nr AS (
    SELECT notice, label, len(v) AS n, CASE WHEN len(v) <= {license_scan.SHORT} THEN len(v) ELSE ceil({license_scan.COVERAGE} * len(v)) END AS need,
        unnest(range(len(v) - 2)) AS place, v FROM nw
), d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (
    SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d
), hits AS (
    SELECT DISTINCT doc_id, notice, label, n, need, pos, place, pos - place AS diagonal
    FROM p JOIN nr ON w[pos + 1] = v[place + 1] AND w[pos + 2] = v[place + 2] AND w[pos + 3] = v[place + 3]
), steps AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {license_scan.NEIGHBOURS} OR lag(diagonal) OVER o IS NULL THEN 1 ELSE 0 END AS begins
    FROM (SELECT DISTINCT doc_id, notice, n, need, diagonal FROM hits) WINDOW o AS (PARTITION BY doc_id, notice ORDER BY diagonal)
), bands AS (
    SELECT *, sum(begins) OVER (PARTITION BY doc_id, notice ORDER BY diagonal) AS band FROM steps
), mine AS (
    SELECT h.*, b.band FROM hits h JOIN bands b USING (doc_id, notice, diagonal)
), cover AS (
    SELECT b.doc_id, b.notice, b.band, b.diagonal, b.n, b.need, min(h.pos) AS first, max(h.pos) + 2 AS last, count(DISTINCT h.place + k) AS covered
    FROM bands b JOIN mine h ON h.doc_id = b.doc_id AND h.notice = b.notice AND h.band = b.band AND h.pos >= b.diagonal AND h.pos + 3 <= b.diagonal + 2 * b.n, range(3) r(k)
    GROUP BY ALL HAVING count(DISTINCT h.place + k) >= b.need
), found AS (
    SELECT doc_id, list(label) AS more, max(covered / n) AS covered FROM cover JOIN nw USING (notice) GROUP BY doc_id
), base AS (
    SELECT doc_id, pos, label FROM p, phrases WHERE w[pos + 1 : pos + len(phrase)] = phrase
), b AS (
    SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(label) AS labels FROM base GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    array_to_string(list_sort(list_distinct(coalesce(b.labels, []))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(more, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(covered, 0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP10_SQL = rf"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS x,
        doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 0)) = 0) AS hit FROM documents
), u AS (
    SELECT doc_id, hit, x, unnest(range(1, len(x) + 1)) AS i FROM d
), p AS (
    SELECT doc_id, hit, i, x[i] AS w, CASE WHEN i > 1 THEN x[i - 1] END AS v FROM u
), one AS (
    SELECT w, count(*) AS a, count(*) FILTER (hit) AS t FROM p GROUP BY w
), two AS (
    SELECT v, w, count(*) AS a, count(*) FILTER (hit) AS t FROM p WHERE i > 1 GROUP BY v, w
), own1 AS (
    SELECT doc_id, w, count(*) AS k FROM p GROUP BY doc_id, w
), own2 AS (
    SELECT doc_id, v, w, count(*) AS k FROM p WHERE i > 1 GROUP BY doc_id, v, w
), total AS (
    SELECT sum(a) AS a, sum(t) AS t, greatest({lm_score.VOCABULARY}, count(*)) AS size FROM one
), q AS (
    SELECT p.doc_id, p.i, size, CASE WHEN p.hit OR total.t = 0 THEN 1 ELSE 0 END AS mine,
        total.a AS na, CASE WHEN total.t = 0 THEN total.a ELSE total.t END AS nt, count(*) OVER (PARTITION BY p.doc_id) AS n,
        one.a AS wa, CASE WHEN total.t = 0 THEN one.a ELSE one.t END AS wt, o.k AS wk,
        h.a AS ha, CASE WHEN total.t = 0 THEN h.a ELSE h.t END AS ht, oh.k AS hk,
        two.a AS pa, CASE WHEN total.t = 0 THEN two.a ELSE two.t END AS pt, o2.k AS pk
    FROM p CROSS JOIN total JOIN one ON one.w = p.w JOIN own1 o ON o.doc_id = p.doc_id AND o.w = p.w
        LEFT JOIN one h ON h.w = p.v LEFT JOIN own1 oh ON oh.doc_id = p.doc_id AND oh.w = p.v
        LEFT JOIN two ON two.v = p.v AND two.w = p.w LEFT JOIN own2 o2 ON o2.doc_id = p.doc_id AND o2.v = p.v AND o2.w = p.w
), m AS (
    SELECT doc_id, i, size, unnest([0, 1]) AS side, unnest([na - n, nt - mine * n]) AS total, unnest([wa - wk, wt - mine * wk]) AS word,
        unnest([ha - hk, ht - mine * hk]) AS history, unnest([pa - pk, pt - mine * pk]) AS pair FROM q
), s AS (
    SELECT doc_id, side, -ln(CASE WHEN i > 1 AND history > 0 THEN {lm_score.PAIR_WEIGHT} * (pair / history) + {lm_score.WORD_WEIGHT} * one
        ELSE {lm_score.PAIR_WEIGHT + lm_score.WORD_WEIGHT} * one END + {lm_score.UNIFORM_WEIGHT} / size) AS loss
    FROM (SELECT *, CASE WHEN total > 0 THEN word / total ELSE 1.0 / size END::DOUBLE AS one FROM m)
), r AS (
    SELECT doc_id, avg(loss) FILTER (side = 1) AS t, avg(loss) FILTER (side = 0) AS b FROM s GROUP BY doc_id
)
SELECT doc_id, len(x)::BIGINT AS n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(t - b, 6) AS loss_difference FROM d LEFT JOIN r USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 3 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
        ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS s FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), steps AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, steps.y FROM reach JOIN steps ON reach.other = steps.x
), first AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN first USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_wrapper, op2_token_store, op3_license_scan, op4_quality_rules, op5_byte_bpe, op6_decontaminate, op7_jaccard_join, op8_warc, op9_quality_classifier, op10_lm_score)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": _op3_sql(), "op7_jaccard_join": OP7_SQL, "op8_warc": OP8_SQL, "op10_lm_score": OP10_SQL}
