"""One registered query per operator, over whole tables with production
parameters, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourbook.llm import (
    chat, feistel, filter_audit, mixing, oracle, packing, quality_cnn, quality_rules, sharding, simhash, token_files, topk_search, toxicity, url_filters,
    vector_codes,
)
from hourbook.llm.common import documents, held_out, labels


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k=10)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    written = token_files.write_tokens(documents(spark, sf_dir), path, end_id=0, cut="lead", vocabulary=50257)
    return token_files.read_tokens(spark, written)


#: A text that holds the template's marks and the escape character.
MARKED = "\\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], rows.schema)
    return chat.digests(chat.format_chats(chat.message_events(rows.unionByName(marked))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels(spark, sf_dir).filter(~out))
    scored = docs.select("doc_id", out.alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(documents(spark, sf_dir), path, end_id=1, cut="drop")


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2)
    model = quality_cnn.fit(docs, labels(spark, sf_dir).filter(~out))
    scored = docs.select("doc_id", out.alias("held_out"), quality_cnn.score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_cnn.THRESHOLD).cast("int"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir)).drop("row_number")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure_documents(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken()


#: host, path and verdict of each rule of the query; urls that none fits are allowed
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
URL_DEFAULT = "allow"


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, URL_DEFAULT)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_codes.compress(rows).drop("label")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


#: CRC-32 of UTF-8 bytes, which DuckDB lacks: a table of 256, then byte by byte.
_CRC_SQL = """crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)
), crcs AS (
    SELECT doc_id, text, xor(4294967295, list_reduce(
        list_transform(range(octet_length(raw)), lambda i: 16 * (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1),
        lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS text_crc32, (octet_length(raw) + 1)::BIGINT AS size
    FROM (SELECT doc_id, text, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS hx FROM documents), crc_table
)"""


def feistel_sql() -> str:
    """The same network on row numbers, with a recursive walk."""
    turns = []
    for i, key in enumerate(feistel.round_keys(8)):
        old, new = f"s{i}", f"s{i + 1}"
        turns.append(
            f"""{new} AS (SELECT id, r AS l, (l + ((t * t + {key}) % {feistel.PRIME}) * {feistel.STEP} % {feistel.PRIME}) % a AS r, b AS a, a AS b
            FROM (SELECT *, ((r + {key}) % {feistel.PRIME}) * {feistel.STEP} % {feistel.PRIME} AS t FROM {old}))"""
        )
    image = f"""WITH s0 AS (SELECT v AS id, v // b AS l, v % b AS r, a, b FROM whole), {", ".join(turns)}
        SELECT id AS v, l * b + r AS w FROM s{feistel.ROUNDS}"""
    return f"""
WITH RECURSIVE size AS (SELECT count(*) AS n, greatest(ceil(sqrt(count(*))), 1)::BIGINT AS a FROM documents),
halves AS (SELECT n, a, greatest(ceil(n / a), 1)::BIGINT AS b FROM size),
whole AS (SELECT unnest(range(0, a * b)) AS v, a, b FROM halves),
image AS ({image}),
walk(v, w) AS (
    SELECT v, w FROM image WHERE v < (SELECT n FROM size)
    UNION ALL SELECT walk.v, image.w FROM walk JOIN image ON walk.w = image.v WHERE walk.w >= (SELECT n FROM size)
),
places AS (SELECT v, w FROM walk WHERE w < (SELECT n FROM size)),
{_CRC_SQL},
numbered AS (
    SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS v FROM crcs
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (w % 16)::INTEGER AS shard, w // 16 AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN places USING (v)
"""


def quality_rules_sql() -> str:
    """The measures with lists, and the rule table as conditions."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    measures = {
        "n_words": "n_words",
        "repeat_word_ratio": "n_repeat_words / n",
        "mean_word_chars": "word_chars / n",
        "symbol_word_ratio": "n_symbols / n",
        "stop_words": f"len(list_filter(words, lambda w: lower(w) IN ({stop})))",
        "dup_line_ratio": "n_dup_lines / n_lines",
        "letter_word_ratio": "letters / greatest(word_chars, 1)",
        "upper_letter_ratio": r"length(regexp_replace(body, '\P{Lu}+', '', 'g')) / greatest(letters, 1)",
        "bullet_line_ratio": r"len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) / n_lines",
        "ellipsis_line_ratio": r"len(list_filter(lines, lambda x: regexp_matches(x, '(…|\.\.\.)\s*$'))) / n_lines",
    }

    def holds(rules) -> str:
        ok = [f"{measures[r.measure]} >= {r.low}" for r in rules if r.low is not None]
        return " AND ".join(ok + [f"{measures[r.measure]} <= {r.high}" for r in rules if r.high is not None])

    symbols = "".join("\\" + c for c in quality_rules.SYMBOLS)
    return rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times FROM (
        SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM texts
    ), LATERAL (SELECT words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w)
), repeated AS (
    SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS j) WHERE times > 1 GROUP BY doc_id
), measured AS (
    SELECT t.doc_id, body, words, lines, len(words) AS n_words, greatest(len(words), 1) AS n, greatest(len(lines), 1) AS n_lines,
        length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(body) - length(regexp_replace(body, '[{symbols}]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(regexp_replace(body, '\P{{L}}+', '', 'g')) AS letters FROM texts t LEFT JOIN repeated r ON t.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({holds(quality_rules.BASE_RULES)}) AS base_failed,
    ({holds(quality_rules.BASE_RULES)}) AND ({holds(quality_rules.RULES)}) AS kept
FROM measured
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_simhash_near_dedup,
        op3_token_files,
        op4_chat_formatting,
        op5_toxicity,
        op6_best_fit_packing,
        op7_quality_cnn,
        op8_sharding,
        op9_quality_rules,
        op10_mixing,
        op11_url_filters,
        op12_vector_codes,
        op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
WITH bits AS (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings
), codes AS (
    SELECT vec_id, sum(CASE WHEN x > 0 AND NOT isnan(x) THEN 1::HUGEINT << i ELSE 0 END)::HUGEINT AS code FROM bits GROUP BY vec_id
), pairs AS (
    SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
    FROM codes q JOIN codes r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank, neighbor_id, distance FROM pairs
)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
""",
    "op4_chat_formatting": f"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{MARKED}'), (-7, 1, 'assistant', '{MARKED}')
), escaped AS (
    SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '#', '\\h') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
    sum(length('{chat.OPEN}') + length(role) + 1 + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op8_sharding": feistel_sql(),
    "op9_quality_rules": quality_rules_sql(),
    "op11_url_filters": oracle.url_filters_sql(URL_RULES, URL_DEFAULT),
    "op12_vector_codes": oracle.vector_codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE),
    "op13_filter_audit": oracle.filter_audit_sql(filter_audit.FILTERS),
}
