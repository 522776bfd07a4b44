"""The contract queries of the operators here, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import filter_audit, line_dedup, mixing, phrase_mining
from threadloom.llm.decontamination import contaminated
from threadloom.llm.html_extraction import main_texts
from threadloom.llm.jaccard_join import similar_documents
from threadloom.llm.language_id import identified
from threadloom.llm.near_vectors import near_vectors
from threadloom.llm.personal_data import personal_data
from threadloom.llm.secrets_scan import secrets, written_out
from threadloom.llm.token_store import stored_digests
from threadloom.llm.toxicity import toxic_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Spans of ``secrets`` as the contract writes them."""
    found = secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), "n_owner_specific", "n_copied")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_spread_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(_table(spark, sf_dir, "documents"), default_tokenizer())


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.top_collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_secret_scan,
        op3_language_id,
        op4_html_extraction,
        op5_ngram_jaccard_join,
        op6_token_store,
        op7_source_mixing,
        op8_line_dedup,
        op9_toxicity,
        op10_decontamination,
        op11_filter_audit,
        op12_personal_data,
        op13_phrase_mining,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_source_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_phrase_mining": phrase_mining.SQL,
}
