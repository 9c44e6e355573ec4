"""The queries of the ten operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotagraph.llm import chat, media, mixing, ngram, pieces, rules, simhash, tokenbin, toxicity, urls
from rotagraph.llm.shared import is_remainder
from rotagraph.session import table

#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=lambda c: ~is_remainder(c, 4, 2))
    scored = toxicity.with_toxicity(docs, model)
    return scored.select("doc_id", is_remainder("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


OP3_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS h, rest FROM p),
s AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path, row_number() OVER () AS rid FROM q),
m AS (SELECT s.rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM s JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.rid)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (rid)
"""


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenbin.encode_to_shards(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, special=True)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep_text=True)
    decoded = pieces.decode_pieces(encoded, model, into="decoded")
    return decoded.select("doc_id", "ids", "n_pieces", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judge_quality(docs, learned).select("doc_id", *rules.BASE, "base_failed", "kept")


#: A conversation that holds the template's own control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + length('<turn ></turn>') + 1) AS formatted FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = is_remainder("doc_id", 7, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram.score(docs, ~held).select("doc_id", is_remainder("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: No source is repeated more often than this; each is given once in full at least.
MOST_REPEATS = 4.0


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    _, given = mixing.mix(docs, most_repeats=MOST_REPEATS)
    return given.select(F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "position")


def queries() -> dict:
    return {
        "op1_progressive_jpeg": op1_progressive_jpeg,
        "op2_toxicity": op2_toxicity,
        "op3_url_filters": op3_url_filters,
        "op4_token_files": op4_token_files,
        "op5_piece_codec": op5_piece_codec,
        "op6_quality_rules": op6_quality_rules,
        "op7_chat_format": op7_chat_format,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_lm_scores": op9_lm_scores,
        "op10_temperature_mixing": op10_temperature_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": OP3_SQL, "op7_chat_format": OP7_SQL}
