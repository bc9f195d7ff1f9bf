"""The corpus queries and their SQL counterparts, one pair for each operator."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bin_packing, chat_format, ngram_join, piece_matching, quality_rules, sharding, substring_dedup, token_counts, token_packing, topk_search
from ridgeline.llm.shared import Scratch

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24
TOKEN_LIMIT = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "op1"))


OP1_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in generate_series(1, len(ws) - 4)]) END) AS s
  FROM toks
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT d AS doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON d = sizes.doc_id GROUP BY d
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pick = lambda role, content: F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["content"].alias(content)))
    pair = (F.size("turns") == 2) & (F.col("turns")[0]["role"] == "user") & (F.col("turns")[1]["role"] == "assistant")
    # Records come in several layouts, as sources have them.
    record = (
        F.when(pair & (F.pmod("conv_id", F.lit(2)) == 0), F.to_json(F.struct(F.col("turns")[0]["content"].alias("prompt"), F.col("turns")[1]["content"].alias("completion"))))
        .when(pair, F.to_json(F.struct(F.col("turns")[0]["content"].alias("instruction"), F.col("turns")[1]["content"].alias("output"))))
        .when(F.pmod("conv_id", F.lit(2)) == 0, F.to_json(F.struct(pick("role", "content").alias("messages"))))
        .otherwise(F.to_json(F.struct(pick("from", "value").alias("conversations"))))
    )
    chats = chat_format.format_chats(turns.select("conv_id", record.alias("record")))
    back = chats.withColumns({"back": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\0'), '</role>', '\1'), '</turn>', '\2') AS e,
         replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\0'), '</role>', '\1'), '</turn>', '\2') AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(e) + length(r) + 20) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(read(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return out.select("doc_id", *quality_rules.FEATURES, "base_failed", "kept")


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
toks AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM toks),
g AS (
  SELECT doc_id, n, i, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d
         || ' ' || lead(w, 5) OVER d || ' ' || lead(w, 6) OVER d || ' ' || lead(w, 7) OVER d AS g
  FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS dup FROM g),
covered AS (
  SELECT doc_id, max(CASE WHEN dup THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice
),
repeated AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
base AS (
  SELECT d.doc_id, d.source, CAST(len(t.ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM docs d JOIN toks t USING (doc_id) LEFT JOIN dup_lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
),
rated AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f, count(*) FILTER (WHERE base_failed) / CAST(count(*) AS DOUBLE) AS rate
  FROM rated WHERE source IS NOT NULL GROUP BY source
),
moments AS (SELECT avg(rate) AS m, greatest(coalesce(var_samp(rate), 0) - avg(rate * (1 - rate) / n), 0) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 10000) ELSE 10000 END AS s FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM rated
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    folder = scratch.path()  # a run's own maps: a service would keep one folder
    placed, _ = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS, scratch, folder)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot")
    )


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.pack_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Scratch(spark, "op7"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([a * coalesce(c.e[i], 0) for a, i in q.e]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_matching.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def queries() -> dict[str, Query]:
    found = [op1_ngram_join, op2_chat_formatting, op3_quality_rules, op4_best_fit_packing, op5_sharding, op6_token_packing, op7_exact_topk, op8_substring_dedup, op9_sentencepiece, op10_token_counts]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op3_quality_rules": OP3_SQL, "op7_exact_topk": OP7_SQL}
