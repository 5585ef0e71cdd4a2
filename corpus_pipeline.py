"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage before it kept, and all but
the last return the columns of ``documents``. Stages are written as Parquet and read again in between, so a lost executor
costs a stage's tasks at most. Stages set the session's ``BATCH_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import langid, minhash, packing, passages, secrets
from touchline.llm.queries import vocabulary
from touchline.session import cut_lineage

#: A document goes if it has no letter or if its best language is less likely than this.
LEAST_SCORE = 0.3
#: Bytes that go to a Python worker at once: Arrow batches lie outside the JVM's heap, and default to 10,000 whole texts.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
#: Result columns of ``run`` can't be expressed in SQL: models, tokenizers and components.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from all of them that have a language."""
    spark.conf.set(*BATCH_BYTES)
    model = langid.fit(docs, "doc_id", "text", "lang")
    # All other columns in one, as their names may be those of results.
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")
    told = langid.predict(rows, model, "text", ["_row", "text"])
    if model.languages:
        told = told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return told.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates; rows without an id stay."""
    spark.conf.set(*BATCH_BYTES)
    found = minhash.near_duplicates(docs, "doc_id", "text", (85, 100))
    gone = cut_lineage(found.where("not kept and doc_id is not null").select("doc_id").distinct())
    small = gone.count() <= minhash.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; emptied documents go."""
    spark.conf.set(*BATCH_BYTES)
    return passages.remove_passages(docs, "doc_id", "text", "n_chars")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced by a mark; widely copied examples stay."""
    return secrets.redact(docs, "doc_id", "text", "source", "doc_id", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens."""
    spark.conf.set(*BATCH_BYTES)
    return packing.pack_documents(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("passages", first_passages),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
