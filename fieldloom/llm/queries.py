"""The operators as registered queries: whole tables, production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, language_id, minhash_forest, pii, quality, secret_scan, sharding, site_tree, substring_dedup, topk_search, whitening
from .common import checkpoint_folder, held_out, table


#: Where the public tokenizer files are, by name; see public_tokenizers.path.
WORD_BPE = "word_bpe_49k.json"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    return language_id.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{checkpoint_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    placed, _ = sharding.shard_records(table(spark, sf_dir, "documents"), store, n_shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors.where(topk_search.is_query(F.col("vec_id"), 100)), vectors, k=10)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), inter=100, union=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted")
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), word_bpe_path()).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")), secret_scan.KINDS)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest(found, pii.KINDS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), across=False).drop("row")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, most=2000)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.quantised(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, whitening.fit(vectors, components=4))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_exact_topk": op3_exact_topk,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        ) WHERE rank <= 10
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
        ), n AS (
            SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM (
                SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
                UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
                UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w
            ) GROUP BY lang, k, phrase HAVING count(*) >= 10
        ), cuts AS (
            SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3 FROM f WHERE k > 1
        ), inside AS (
            SELECT lang, phrase, max(f) AS longer FROM (
                SELECT lang, w1 || ' ' || w2 AS phrase, f FROM cuts WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM cuts WHERE k = 3
            ) GROUP BY lang, phrase
        ), parts AS (
            SELECT lang, phrase, f, 1 AS cut, w1 AS a_part, CASE WHEN k = 3 THEN w2 || ' ' || w3 ELSE w2 END AS b_part FROM cuts
            UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM cuts WHERE k = 3
        ), scores AS (
            SELECT p.lang, p.phrase, p.f AS a, cut, l.f AS l, r.f AS r,
                   ((1000000::HUGEINT * p.f * p.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.a_part JOIN f r ON r.lang = p.lang AND r.phrase = p.b_part
            LEFT JOIN inside i ON i.lang = p.lang AND i.phrase = p.phrase
            WHERE i.longer IS NULL OR 100 * i.longer < 50 * p.f
        ), lowest AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scores) WHERE place = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
        )
        SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
}
