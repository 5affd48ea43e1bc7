"""The queries op1 to op13 over the tables of a scale-factor folder, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversation_trie, decontaminate, hard_negatives, line_dedup, nbsvm, near_dedup, ngram_trie, oracles, overlap_join, packing, pii, quality_rules, secrets, token_counts
from tessera.llm.staging import new_path, stage

#: A fixed key, so that results can be repeated. A real run passes its own secret.
PII_KEY = b"tessera pseudonym key for tests"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score_documents(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_outliers(_documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), TOKENIZER)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir), PII_KEY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, after five commits: documents come in with a provisional count (their words) under
    the tokenizer's name, are revised to its counts, those labelled toxic are withdrawn and put back, and the
    revision is committed a second time, which changes nothing."""
    docs = _documents(spark, sf_dir)
    counts = stage(token_counts.count_tokens(docs, {"byte_bpe_50k": TOKENIZER}), "token-counts")
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")
    provisional = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.lit("byte_bpe_50k").alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), words.alias("n_tokens"))
    provisional = stage(provisional, "token-counts")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    withdrawn = stage(counts.join(toxic, "doc_id", "left_semi"), "token-counts")
    store = token_counts.Rollup(spark, new_path(spark, "token-rollup"))
    revision = token_counts.deltas(provisional, counts)
    store.commit("arrival", token_counts.deltas(None, provisional))
    store.commit("revision", revision)
    store.commit("withdrawal", token_counts.deltas(withdrawn, None))
    store.compact()
    store.commit("return", token_counts.deltas(None, withdrawn))
    if store.commit("revision", revision):
        raise RuntimeError("a batch was committed twice")
    return store.totals()


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100, against all rows."""
    vectors = hard_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.similar_sets(_documents(spark, sf_dir), size=3, tenths=9)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that take the heads of every twentieth one, up to three turns."""
    turns = conversation_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.prefix_trie(conversation_trie.with_heads(stage(turns, "conversations"), every=20, most=4))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scans": op7_secret_scans,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_conversation_trie": op13_conversation_trie,
}
#: The rest (a trained or sampled model, token ids, ciphers, a corpus-wide test procedure) is beyond SQL; the tests have brute-force versions.
SQL: dict[str, str] = {
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op8_near_dedup": oracles.NEAR_DEDUP,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_ngram_jaccard": oracles.NGRAM_JOIN,
    "op13_conversation_trie": oracles.CONVERSATION_TRIE,
}
