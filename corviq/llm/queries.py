"""The registered queries of the training-data operators, one each, with their SQL where it can say the same."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corviq.llm import capfilters, langid, linechunks, maintext, mixing, mpegaudio, packing, simhash, surrogates, urlrules
from corviq.llm.common import materialize, table


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is ``spark.corviq.surrogates.key`` in hexadecimal digits; where it isn't set, a new one for each run."""
    found = spark.conf.get("spark.corviq.surrogates.key", None)
    key = bytes.fromhex(found) if found else secrets.token_bytes(32)
    return surrogates.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linechunks.dedup_lines(docs.select("doc_id", "text"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpegaudio.to_media(table(spark, sf_dir, "documents"))
    return mpegaudio.probe(media).withColumnRenamed("id", "doc_id")


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return marked.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("n_words")))
    mixed = mixing.mix(sized, size_col="n_words")
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_surrogates, op2_url_rules, op3_main_text, op4_line_chunks, op5_mpeg_audio, op6_cap_filters, op7_bin_slack, op8_rank_profiles, op9_mix, op10_simhash)
} | {"pipeline": _pipeline}


def _op2_sql() -> str:
    fits = "\n".join(
        f"    UNION ALL SELECT '{r.name}', '{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}'" for r in urlrules.HOST_RULES
    ).replace("    UNION ALL ", "    ", 1)
    words = "|".join(r.name for r in urlrules.WORD_RULES)
    blocks, allows = ("|".join(r.regex.removeprefix("(?i)") for r in urlrules.PATTERN_RULES if r.verdict == v) for v in ("block", "allow"))
    return f"""
WITH rules(name, says, rhost, rpath) AS (
{fits}
), cut AS (
    SELECT page_id, rn, CASE WHEN spot > 0 THEN substr(url, spot + 3) ELSE '' END AS rest
    FROM (SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS spot, row_number() OVER () AS rn FROM pages)
), parts AS (
    SELECT page_id, rn, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), best AS (
    SELECT rn, arg_max(name, length(name)) AS rule, arg_max(says, length(name)) AS says
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY rn
)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN regexp_matches(host || path, '{allows}', 'is') THEN 'allow'
                           WHEN regexp_matches(host || path, '^([^/]*[.-])?({words})([.:/-]|$)') OR regexp_matches(host || path, '{blocks}', 'is') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (rn)"""


def _op9_sql() -> str:
    """Water-filling by as many rounds as a recursion needs: each round fixes the sources above their limit."""
    return r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
    FROM documents
), src AS (
    SELECT source, sum(size)::BIGINT AS z, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
    FROM docs GROUP BY source
), fill(round, source, z, w, fixed, t) AS (
    SELECT 0, source, z, w, false, 0.0::DOUBLE FROM src
    UNION ALL
    SELECT round + 1, source, z, w, fixed OR share > 3 * z, CASE WHEN fixed THEN t WHEN share > 3 * z THEN (3 * z)::DOUBLE ELSE share END
    FROM (SELECT *, (sum(z) OVER () - sum(CASE WHEN fixed THEN t ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER (), 0) * w AS share FROM fill)
    WHERE round < (SELECT count(*) FROM src)
), goal AS (
    SELECT source, z, t, least(floor(t / nullif(z, 0)), 3) AS base FROM fill WHERE round = (SELECT count(*) FROM src)
), run AS (
    SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS here FROM docs GROUP BY source, h
), cut AS (
    SELECT r.source, r.h, coalesce(g.base, 0) AS base, g.z, g.t,
           CASE WHEN coalesce(g.base, 0) >= 3 THEN false
                WHEN upto <= t - base * z THEN true
                ELSE upto - here < t - base * z AND upto - (t - base * z) < (t - base * z) - (upto - here) END AS more
    FROM run r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT d.doc_id, d.size, c.z AS source_size, c.t AS target, (d.size * (c.base + CASE WHEN c.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h"""


SQL: dict[str, str] = {"op2_url_rules": _op2_sql(), "op9_mix": _op9_sql()}
