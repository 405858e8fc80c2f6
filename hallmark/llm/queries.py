"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hallmark.llm import (
    bpe,
    decontaminate,
    exact_search,
    licenses,
    lm_scores,
    near_dups,
    oracle,
    phrases,
    prefix_trie,
    quotes,
    token_counts,
    token_files,
    toxicity,
    url_filters,
)
from hallmark.llm.tables import folder, table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
FILE_BPE = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filters.judged(table(spark, sf_dir, "pages"), rules)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    return bpe.round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_BPE)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, TOKEN_LIMIT)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: each source has folders of folders of 50 files."""
    number = F.col("doc_id")
    top = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"))
    part = F.concat(top, F.lit("part-"), F.floor(number / 1000), F.lit("/"))
    inner = F.concat(part, F.lit("set-"), F.floor(number / 50) % 20, F.lit("/"))
    path = (
        F.when(number % 10_000 == 11, F.concat(top, F.lit("LICENSE")))
        .when(number % 1000 == 7, F.concat(part, F.lit("LICENSE")))
        .when(number % 10 == 0, F.concat(inner, F.lit("LICENSE.txt")))
        .otherwise(F.concat(inner, F.lit("file-"), number, F.lit(".txt")))
    )
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op6_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return exact_search.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return lm_scores.scored(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op9_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE_BPE), path)
    return token_files.summed(spark, path)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: query
        for name, query in globals().items()
        if name.startswith("op") and name[2].isdigit() and callable(query)
    }


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)
    return {
        "op1_url_filters": oracle.URL_FILTERS.format(rules=rules),
        "op6_exact_search": oracle.EXACT_SEARCH,
        "op9_minhash_near_dups": oracle.NEAR_DUPS,
        "op11_phrase_mining": oracle.COLLOCATIONS,
        "op13_prefix_trie": oracle.PREFIX_TRIE,
    }
