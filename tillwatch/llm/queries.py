"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwatch.llm.centroids import CENTROIDS, ROUNDS, cluster_digest
from tillwatch.llm.chat import Template, chat_digest, with_probe
from tillwatch.llm.common import table
from tillwatch.llm.credentials import secret_digest
from tillwatch.llm.decontaminate import leak_digest
from tillwatch.llm.licenses import license_digest
from tillwatch.llm.lines import line_digest
from tillwatch.llm.mixing import SEED, mix_digest
from tillwatch.llm.neardup import group_digest
from tillwatch.llm.personal import personal_digest
from tillwatch.llm.quality import quality_digest
from tillwatch.llm.toxicity import toxic_digest
from tillwatch.llm.urls import url_digest
from tillwatch.llm.whitening import whitening_digest

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digest(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_digest(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(with_probe(table(spark, sf_dir, "conversations")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_personal_data": op11_personal_data,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_whitening": op13_whitening,
}

_TEMPLATE = Template()


def _escapes(text: str) -> str:
    """SQL for the characters that escaping adds to a text."""
    lost = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in _TEMPLATE.controls]
    return " + ".join([f"(length({text}) - length(replace({text}, '\\', '')))", *lost])


_MARKERS = sum(len(m) for m in (_TEMPLATE.start, _TEMPLATE.middle, _TEMPLATE.end))


def _nearest(i: int) -> str:
    """SQL for the i-th assignment: each kept row's nearest centroid of c{i}."""
    return f"""a{i} AS (
    SELECT r, c, d FROM (
        SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM flat x JOIN c{i} c USING (i) GROUP BY x.r, c.c
    ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""


def _moved(i: int) -> str:
    """SQL for the next centroids: exact floors of the means, the old ones where no row came."""
    return f"""c{i + 1} AS (
    SELECT o.c, o.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, o.x) AS x FROM c{i} o LEFT JOIN (
        SELECT a.c, x.i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN flat x USING (r) GROUP BY a.c, x.i
    ) m USING (c, i)
)"""


ORACLES: dict[str, str] = {
    "op5_chat_format": f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM turns
), states AS (
    SELECT conv_id, i, role, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered
), machine AS (
    SELECT conv_id,
           bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                         WHEN before IN ('system', 'assistant') THEN role = 'user'
                         WHEN before = 'user' THEN role = 'assistant' ELSE false END)
               AND max(CASE WHEN i = n THEN role END) = 'assistant' AS valid
    FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM states) GROUP BY conv_id
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT), 0) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
       CAST(sum({_MARKERS} + length(role) + {_escapes("role")} + length(text) + {_escapes("text")}) AS BIGINT) AS formatted_chars,
       any_value(valid) AS valid
FROM numbered JOIN machine USING (conv_id) GROUP BY conv_id
""",
    "op12_centroid_clusters": f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND list_count(embedding) = 64
      AND len(list_filter(embedding, lambda e: isnan(e) OR isinf(e))) = 0
), flat AS (
    SELECT r, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) t(i)
), firsts AS (
    SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) - 1 AS c FROM kept
    QUALIFY c < {CENTROIDS}
), c0 AS (
    SELECT f.c, x.i, x.x FROM firsts f JOIN flat x USING (r)
), {", ".join(f"{_nearest(i)}, {_moved(i)}" for i in range(ROUNDS))}, {_nearest(ROUNDS)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       h.centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (r)
     JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c) h USING (c)
""",
    "op8_mix_sources": f"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS z,
           (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
    FROM docs GROUP BY source
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY z * 1.0 / w, w, source) AS k FROM sources
), left_over AS (
    SELECT *, sum(z) OVER () - coalesce(sum(3 * z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
           sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
    FROM ordered
), first_free AS (
    SELECT k, words, weight FROM left_over WHERE w * words <= 3 * z * weight ORDER BY k LIMIT 1
), targets AS (
    SELECT o.source, o.z, CASE WHEN o.k < f.k THEN CAST(3 * o.z AS DOUBLE)
                               ELSE CAST(o.w * f.words AS DOUBLE) / CAST(f.weight AS DOUBLE) END AS target
    FROM ordered o, first_free f
), plan AS (
    SELECT *, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS epochs FROM targets
), rests AS (
    SELECT *, CAST(floor(target - epochs * z) AS BIGINT) AS rest FROM plan
), keyed AS (
    SELECT source, key, sum(size) AS size, count(*) AS copies FROM docs GROUP BY source, key
), running AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM keyed
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.z AS source_size, r.target,
       CAST(r.epochs * d.size + CASE WHEN r.rest >= q.start + q.size THEN d.size
                                     WHEN r.rest > q.start THEN (r.rest - q.start) // q.copies ELSE 0 END AS BIGINT) AS taken
FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
     JOIN running q ON d.source IS NOT DISTINCT FROM q.source AND d.key = q.key
""",
}
