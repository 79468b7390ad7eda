"""Queries of the operators over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import chat, decontaminate, hamerly, hardnegatives, htmltext, imatch, jaccardjoin, langid, linededup, pieces, simhash, tokencounts, tokenfiles
from flowquarry.llm.common import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.format_conversations(turns.unionByName(extra))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("removed_lines_").cast("long").alias("removed_lines"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written_and_read(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    flipped = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardnegatives.mine(flipped, F.col("vec_id") % 100 == 0)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_imatch, op2_html_main_text, op3_chat_windows, op4_sentencepiece, op5_simhash, op6_decontamination, op7_line_dedup, op8_token_counts, op9_language_id, op10_token_files, op11_ngram_jaccard, op12_hard_negatives, op13_centroid_clusters)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_JACCARD = rf"""WITH RECURSIVE
  cut AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  shingle AS MATERIALIZED (
    SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM cut WHERE len(ws) > 0),
  sizes AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM shingle GROUP BY doc_id),
  both_ AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS MATERIALIZED (SELECT x, y FROM both_ JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
  reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN link ON x = other)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)"""

_USABLE = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_NEGATIVES = f"""WITH rows_ AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_USABLE} AND label IS NOT NULL),
  scored AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s FROM rows_ a JOIN rows_ b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
  positive AS (SELECT * FROM scored WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY r ORDER BY s DESC, id) <= 5)
SELECT * FROM (SELECT p.anchor_id, p.id AS positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY p.r, p.id ORDER BY n.s DESC, n.id) AS INT) AS rank, n.id AS negative_id, p.s AS positive_score, n.s AS negative_score
  FROM positive p JOIN scored n ON n.r = p.r AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s) WHERE rank <= 10"""


def _clusters(rounds: int = 5) -> str:
    """Rounds of full scans, one after another."""
    near = lambda k: f"a{k} AS MATERIALIZED (SELECT r, vec_id, q, j, c, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS d FROM kept, c{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY r ORDER BY d, j) = 1)"
    mean = lambda k: f"c{k + 1} AS MATERIALIZED (SELECT j, list(f ORDER BY i) AS c FROM (SELECT j, i, floor(SUM(q[i]) / COUNT(*)) AS f FROM a{k}, range(1, 65) t(i) GROUP BY j, i) GROUP BY j UNION ALL SELECT j, c FROM c{k} WHERE j NOT IN (SELECT j FROM a{k}))"
    steps = [x for k in range(rounds) for x in (near(k), mean(k))] + [near(rounds)]
    return f"""WITH kept AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS r, vec_id, {_USABLE} AND len(embedding) = 64),
  c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY h, q) - 1 AS j, q AS c FROM (SELECT sha256('2:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT 40)),
  {", ".join(steps)}
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(SUM(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds}"""


ORACLE_SQL: dict[str, str] = {"op11_ngram_jaccard": _JACCARD, "op12_hard_negatives": _NEGATIVES, "op13_centroid_clusters": _clusters()}
