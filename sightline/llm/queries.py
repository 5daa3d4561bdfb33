"""The registered queries of the corpus operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import chat, exact_dedup, langid, mtree, packing, passages, simhash, tokens, toxicity
from sightline.llm.common import table, vocabulary


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.fit(docs))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.parsed(chat.transcript(table(spark, sf_dir, "conversations"))))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash, op3_packing, op4_substring_dedup, op5_language_id,
        op6_chat_formatting, op7_sentencepiece, op8_token_counts, op9_exact_top_k, op10_exact_dedup,
    )
}

ORACLE_SQL = {
    # windows of 50 words that occur earlier, joined where they touch; words of scripts with blanks
    "op4_substring_dedup": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x20\\x09-\\x0D]+|[^\\x20\\x09-\\x0D]+')) AS token,
                          generate_subscripts(regexp_extract_all(text, '[\\x20\\x09-\\x0D]+|[^\\x20\\x09-\\x0D]+'), 1) AS k FROM documents),
        p AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS stop FROM t),
        w AS (SELECT doc_id, stop - length(token) AS start, stop, translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
                     row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS word FROM p WHERE NOT regexp_matches(token, '^[\\x20\\x09-\\x0D]')),
        d AS (SELECT doc_id, list(w ORDER BY word) AS ws FROM w GROUP BY doc_id HAVING count(*) >= 50),
        o AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS word, ws FROM d),
        h AS (SELECT doc_id, word, md5(array_to_string(ws[word + 1:word + 50], ' ')) AS digest FROM o),
        f AS (SELECT doc_id, word, first_value(doc_id) OVER r AS earlier_doc_id, first_value(word) OVER r AS earlier_word
              FROM h WINDOW r AS (PARTITION BY digest ORDER BY doc_id, word)),
        a AS (SELECT * FROM f WHERE doc_id <> earlier_doc_id OR word >= earlier_word + 50),
        n AS (SELECT *, CASE WHEN word <= lag(word) OVER (PARTITION BY doc_id ORDER BY word) + 50 THEN 0 ELSE 1 END AS new FROM a),
        i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY word) AS run FROM n),
        g AS (SELECT doc_id, min(word) AS word, max(word) + 50 AS past, arg_min(earlier_doc_id, word) AS earlier_doc_id, arg_min(earlier_word, word) AS earlier_word FROM i GROUP BY doc_id, run)
        SELECT g.doc_id, CAST(g.word AS INTEGER) AS word, CAST(past - g.word AS INTEGER) AS n_words, CAST(b.start AS INTEGER) AS start, CAST(e.stop - b.start AS INTEGER) AS length,
               earlier_doc_id, CAST(earlier_word AS INTEGER) AS earlier_word
        FROM g JOIN w b ON g.doc_id = b.doc_id AND g.word = b.word JOIN w e ON g.doc_id = e.doc_id AND g.past = e.word + 1
    """,
    "op9_exact_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
}
