"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm import align, bpe, centroids, chat, curriculum, exact, media, near, quality, shards, toxicity, urls, vector_near
from quizloom.session import read_table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components(read_table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read_table(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


#: Fixed value: the conversation that op8 adds to the table, whose texts hold control strings of templates.
TRICKY_TEXT = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY_TEXT).alias("text"))
    return chat.digest(chat.read_back(chat.format_conversations(turns.unionByName(extra))))


def op8_chat_sql() -> str:
    def escaped(x: str, escapes: list[tuple[str, str]]) -> str:
        for plain, code in escapes:
            x = f"replace({x}, '{plain}', '{code}')"
        return x

    text, role = escaped("text", chat.ESCAPES), escaped("role", chat.ROLE_ESCAPES)
    marks = len(chat.OPEN + chat.OPEN_END + chat.CLOSE)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '{TRICKY_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
placed AS (
  SELECT *, lag(role) OVER o AS before, row_number() OVER o AS n FROM turns
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
one AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS all_text,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length({text}) + CASE WHEN before IS NOT DISTINCT FROM role THEN {len(chat.SEAM)} ELSE length({role}) + {marks} END) AS BIGINT) AS formatted_chars,
    count(*) FILTER (WHERE before IS DISTINCT FROM role) AS n_blocks
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_blocks FROM one"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), word_tokenizer())


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near.components(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit() and not name.endswith("_sql")}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": near.NEAR_SQL, "op3_curriculum_mix": curriculum.MIX_SQL, "op5_exact_dedup": OP5_SQL, "op8_chat": op8_chat_sql(), "op10_url_filter": urls.judge_sql(), "op12_centroids": centroids.cluster_sql(), "op13_embedding_near": vector_near.NEAR_SQL}
