"""The queries of this subpackage, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordia.llm import chat, decontaminate, divergence, embed_dup, langid, mixing, near_dup, quality, spelling, substring, token_count, token_out, url_filter
from accordia.llm.url_filter import Rule

URL_RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTED_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.documents.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(added)))


GOOD = "quality = 1 and toxic = 0"


def op6_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.importance_sample(docs, labels.where(GOOD), quality.good_share(labels, GOOD))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by their texts alone, and all pages, by text, markup, suffix and host; page n is doc_id -1 - n."""
    docs = table(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", nothing.alias("declared"), nothing.alias("host"), nothing.alias("suffix"))
    pages = langid.page_evidence(table(spark, sf_dir, "pages")).withColumn("doc_id", -1 - F.col("page_id")).drop("page_id")
    found = langid.identify(texts.unionByName(pages), langid.fit(docs), declared="declared", host="host", suffix="suffix")
    return found.select("doc_id", F.when(F.col("doc_id") < 0, -1 - F.col("doc_id")).alias("page_id"), "lang", "posterior", "text_lang", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find_repeats(table(spark, sf_dir, "documents"))


def op9_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_out.token_digests(token_out.tokenize_documents(table(spark, sf_dir, "documents"), TOKENIZER))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), noise=97)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache, so that each run does a first run's work."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), COUNTED_TOKENIZER)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_source_mixing": op2_source_mixing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_minhash_near_dup": op4_minhash_near_dup,
    "op5_chat_format": op5_chat_format,
    "op6_importance_quality": op6_importance_quality,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dup": op9_embedding_near_dup,
    "op10_token_output": op10_token_output,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
        r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT page_id, arg_max(struct_pack(rule := rh || rp, verdict := verdict), length(rh || rp) * 1000 + length(rh)) AS best
              FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT h.page_id, h.host, h.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id""",
    "op5_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, lag(role) OVER w AS before, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS coded,
                     length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '#', '')) AS named
              FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(coded + 13 + CASE WHEN before IS NULL OR before <> role THEN named + 7 ELSE 0 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT lang, source, coalesce(any_value(t.total), 0)::HUGEINT AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source) GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 2)) // (g.total + 2 * l.v))::BIGINT AS p,
                     (1 + (1000000000 * (k.n::HUGEINT + 2)) // (l.total + 2 * l.v))::BIGINT AS q
              FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM e)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
