"""From raw documents to token ids: five stages, each on what its predecessor kept.

Every stage but the last returns the columns of documents. The driver of the
pipeline writes a stage's result and hands the table read back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm import language_id, mixing
from threadloom.llm._store import written
from threadloom.llm.decontamination import decontaminated
from threadloom.llm.jaccard_join import similar_documents
from threadloom.llm.registry import default_tokenizer
from threadloom.llm.token_store import stored_digests

#: A text is rejected whose n-grams are in no learned language's filter, by this share.
LEAST_SHARE = 0.3
#: Texts of fewer n-grams are too short to be rejected for their share.
SHARE_NGRAMS = 10


def _small_batches(spark: SparkSession) -> None:
    """Bytes of whole texts that go to a Python worker at once, for stages whose rows are made after they return. The pipeline sets this for its session, unless the session has."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == str(64 << 20):  # as Spark has it
        spark.conf.set(key, str(8 << 20))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in some learned language; null texts and texts without letters go."""
    _small_batches(spark)
    found = language_id.predict(docs, language_id.train(docs.where(language_id.fold() != 2)))
    strange = (F.col("score") < LEAST_SHARE) & (F.col("n_grams") >= SHARE_NGRAMS)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~strange).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; of rows that repeat an id, the one whose text and then other columns have the smallest hash. Rows without an id are in no group and stay."""
    heads = similar_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(F.to_json("row")))
    kept = rows.where("doc_id is not null").join(heads, "doc_id", "left_semi").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark passage."""
    _small_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids written to a store; a row per document from the files read back."""
    return stored_digests(docs, default_tokenizer())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID output", tokens),
]

#: SQL expresses neither the language filter nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
