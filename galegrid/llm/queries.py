"""The operators' queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, text_sha256
from .conversation_trie import conversation_trie
from .divergence import divergence
from .exact_dedup import exact_dedup
from .language_id import identify_languages
from .line_dedup import line_dedup
from .media import HISTOGRAM_BINS, media_columns
from .mixing import mix_sources, quality_weight
from .near_join import jaccard_join
from .packing import pack
from .pii import find_personal_data, span_columns
from .quality import classify_quality, fit, score_of
from .secrets import scan_secrets
from .token_counts import count_tokens

VOCABULARY = "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = span_columns(docs, find_personal_data(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", text_sha256(F.col("base")).alias("base_sha256"), "spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_documents(spark, sf_dir)).select("doc_id", "start", "end", "found", "score", "is_secret", "labelled")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", text_sha256(F.col("text")).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    score = score_of(spark, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mix_sources(docs, quality_weight(score)).select("doc_id", "size", "source_size", "target", "taken")


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_columns(read_documents(spark, sf_dir))
    payload = F.aggregate("frames", F.lit(b""), lambda a, f: F.concat(a, f["plane"]))
    levels = F.aggregate(
        "frames", F.array_repeat(F.lit(0).cast("long"), HISTOGRAM_BINS),
        lambda a, f: F.zip_with(a, F.slice(f["histogram"], 1, HISTOGRAM_BINS), lambda x, y: x + y),
    )
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), F.aggregate("frames", F.lit(0), lambda a, f: a + f["delay_ms"])),
        F.concat(F.lit("levels="), F.array_join(F.transform(levels, lambda x: x.cast("string")), "-")),
    )
    read = stored.select("doc_id", "n_bytes", "media", payload.alias("payload"), feature.alias("feature"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_ngram_join": op4_ngram_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_gif_media": op10_gif_media,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_language_id": op12_language_id,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM g""",
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (
            SELECT doc_id, line, pos,
                   translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), c AS (
            SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_conversation_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS first,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                       lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ), r AS (
            SELECT c.conv_id, 0 AS part, t.rank, t.role, t.text FROM c JOIN t ON t.conv_id = c.first AND t.rank <= c.h
            UNION ALL
            SELECT c.conv_id, 1, t.rank, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.rank > c.h
        ), s AS (
            SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list({'r': role, 'x': text}) OVER w AS prefix
            FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), n AS (SELECT c.conv_id, coalesce(max(s.depth), 0) AS n FROM c LEFT JOIN s USING (conv_id) GROUP BY 1),
        p AS (
            SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY prefix) AS owner FROM s
            UNION ALL SELECT conv_id, 0, 0, min(conv_id) OVER () FROM c
        ), node AS (
            SELECT p.owner, p.depth, any_value(p.chars) AS chars, count(*) AS n_convs,
                   sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE n.n = p.depth), '')) AS ends_sha256
            FROM p JOIN n USING (conv_id) GROUP BY 1, 2
        ), up AS (
            SELECT node.*, q.owner AS parent FROM node LEFT JOIN p q ON q.conv_id = node.owner AND q.depth = node.depth - 1
        ), kids AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
        under AS (
            SELECT q.owner, q.depth, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
            FROM up v JOIN p q ON q.conv_id = v.owner AND q.depth <= v.depth LEFT JOIN kids k ON k.owner = v.owner AND k.depth = v.depth GROUP BY 1, 2
        )
        SELECT up.owner AS conv_id, up.depth::BIGINT AS depth, up.parent AS parent_conv_id, up.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves,
               u.saved_tokens::BIGINT AS saved_tokens, up.ends_sha256
        FROM up JOIN under u USING (owner, depth) LEFT JOIN kids k USING (owner, depth)""",
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        p AS (
            SELECT lang, source, term, n, (1 + (n + 2)::HUGEINT * 1000000000 // (sum(n) OVER s + 2 * count(*) OVER s))::BIGINT AS p,
                   (1 + (sum(n) OVER t + 2)::HUGEINT * 1000000000 // (sum(n) OVER l + 2 * count(*) OVER s))::BIGINT AS q
            FROM (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term))
            WINDOW s AS (PARTITION BY lang, source), t AS (PARTITION BY lang, term), l AS (PARTITION BY lang)
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
        ), f AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pair.value, 0)::BIGINT AS value
            FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
        )
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f QUALIFY part = 'pair' OR rank <= 10""",
}
