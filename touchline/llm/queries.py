"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    collocations, conversations, covertree, langid, minhash, packing, passages, pieces, quality, rules, sampling, secrets,
    token_counts)
from touchline.llm.oracle import ORACLE  # noqa: F401
from touchline.operators.scan import rank_all
from touchline.session import cut_lineage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weighted_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    Rows with equal id and text are one; rows are ordered by id, then by a hash of both. Small (id, length) rows are
    ranked to find each row's next one; of its text only the head that is needed travels.
    """
    docs = _table(spark, folder, "documents")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    ranked = rank_all(rows.select("doc_id", "key", F.length("text").alias("n")).distinct(), ["doc_id", "key"])
    after = ranked.select((F.col("rank") % F.col("row_count") + 1).alias("rank"), F.col("key").alias("next_key"))
    links = cut_lineage(ranked.join(after, "rank").select("doc_id", "key", "n", "next_key"))
    texts = rows.select("key", "text").repartition("key").distinct()
    wanted = links.select(F.col("key").alias("owner"), F.col("next_key").alias("key"), F.floor(F.col("n") / 3).alias("need"))
    heads = texts.join(wanted, "key").select(
        F.col("owner").alias("key"), F.substr("text", F.lit(1), F.col("need").cast("int")).alias("head"), "need")
    edited = texts.join(heads, "key").select("key", "text", F.concat(
        F.substr("text", F.lit(1), (F.length("text") - F.col("need")).cast("int")), "head").alias("edited"))
    both = edited.select("key", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("s")).select("key", "s.side", "s.body")
    drawn = samples_by_side(sampling.samples(both, ["key", "side"], "body"))
    prints = cut_lineage(
        edited.select("key", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256")).join(drawn, "key", "left")
        .select("key", "edited_sha256", sampling.whole("own").alias("own"), sampling.whole("other").alias("other")))
    following = prints.select(F.col("key").alias("next_key"), F.col("own").alias("next"))
    return links.join(prints, "key").join(following, "next_key").select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), "edited_sha256",
        sampling.fingerprint("own").alias("fingerprint"), sampling.fingerprint("other").alias("edited_fingerprint"),
        sampling.likeness("own", "other").alias("near_edited"), sampling.likeness("own", "next").alias("near_next"))


def samples_by_side(drawn: DataFrame) -> DataFrame:
    """One row per key with the samples of its text (own) and of its edited text (other)."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("samples")))
    return drawn.groupBy("key").agg(pick(0).alias("own"), pick(1).alias("other"))


def op2_pack_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack_documents(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"))


def op3_cosine_links(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.cosine_links(_table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.98)


def op4_owned_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """A document counts as a repository, its source as the owner."""
    found = secrets.scan(_table(spark, folder, "documents"), "doc_id", "text", "source", "doc_id")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    number = lambda test: F.size(F.filter("spans", test)).cast("bigint")
    of_kind = lambda kind: number(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    return found.select(
        "doc_id", *[of_kind(kind) for kind, *_ in secrets.BASE],
        F.sha2(F.encode(secrets.written(base), "utf-8"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"), number(lambda s: ~s["live"]).alias("n_example"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), "doc_id", "text", (85, 100))


def op6_encode_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = _table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")
    # The spans are digested before decoding, so that they do not travel through its workers.
    encoded = pieces.encode(docs, "doc_id", "text", path).select("doc_id", "ids", F.crc32("spans").alias("spans_crc32"))
    return pieces.decode(encoded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"), "spans_crc32")


def op7_shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passages(_table(spark, folder, "documents"), "doc_id", "text").withColumnsRenamed(
        {"doc": "doc_id", "home": "home_doc_id"})


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"), "doc_id", "text", "lang")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"), "doc_id", "text")


def op9_count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(
        _table(spark, folder, "documents"), "doc_id", "text", vocabulary("piece_bpe_32k.model"))


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return rules.judged(docs, labels, "doc_id", "text", "doc_id", "quality").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"), "text", "lang")


def op13_repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repaired_digests(_table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_weighted_samples, op2_pack_best_fit, op3_cosine_links, op4_owned_secrets, op5_near_duplicates, op6_encode_pieces,
    op7_shared_passages, op8_language, op9_count_tokens, op10_quality,
    op11_quality_rules, op12_collocations, op13_repair_conversations)}

