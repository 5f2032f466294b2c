"""The registered queries of the training-data operators: thin mappings from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipelake.columns import TxnColumns
from swipelake.llm import credentials, divergence, jaccard, language, manifest, mixing, negatives, neighbours, packing, privacy, sharding, toxicity, twins, urls
from swipelake.llm.text import listed

# ``documents`` as records of this library: the text is the descriptor, the source the category.
DOCS = TxnColumns(transaction_id="doc_id", merchant="text", category="source", fraud="toxic")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cyclic_weights(docs: DataFrame, cols: TxnColumns = DOCS) -> DataFrame:
    """Categories by code point, NULL last, weigh 1, 2, 3, repeating."""
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("category").asc_nulls_last()))
    names = docs.select(docs[cols.category].alias("category")).distinct()
    return names.withColumn("weight", ((place - 1) % 3 + 1).cast("double"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_transactions(table(spark, sf_dir, "documents"), DOCS, shards=24)
    return placed.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def _digest(spans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of certain spans, and certain and all spans as text."""
    sure = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(sure, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *[count(kind) for kind in kinds],
        F.sha2(listed(sure), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op2_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(privacy.private_spans(table(spark, sf_dir, "documents"), DOCS), privacy.KINDS)


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.judge_quality(table(spark, sf_dir, "documents"), DOCS, "lang")
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        "word_chars",
        F.col("symbols").alias("n_symbols"),
        F.col("dup_lines").alias("n_dup_lines"),
        F.col("repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
        "class_distance",
        "word_distance",
    )


def op4_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_transactions(table(spark, sf_dir, "documents"), DOCS)
    return found.select(
        "doc_id", F.col("shingles").alias("n_shingles"), F.col("class_id").alias("component_id")
    )


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.secret_spans(table(spark, sf_dir, "documents"), DOCS)
    return _digest(found, credentials.KINDS)


def toxic_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may teach; the third whose id has remainder 1 is held out."""
    labels = table(spark, sf_dir, "labels")
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op6_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = toxicity.score_toxicity(docs, toxic_marks(spark, sf_dir), DOCS)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = language.label_languages(docs, ~held_out, DOCS, "lang")
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language").alias("lang_pred"),
        "score",
        F.size("spans").alias("n_spans"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), vocabulary_path(), DOCS)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixing.mix_categories(docs, cyclic_weights(docs), DOCS)
    return found.select(
        "doc_id",
        F.col("words").alias("size"),
        F.col("category_words").alias("source_size"),
        "target",
        "taken",
    )


def op10_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    own = TxnColumns(transaction_id="vec_id")
    return neighbours.nearest_transactions(vectors, F.col("vec_id") % 50 == 0, own, "embedding", k=5)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    return manifest.transaction_manifest(docs, DOCS, fields, by="lang", claimed=claimed)


# The rules of ``op12``: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op12_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_pages(table(spark, sf_dir, "pages"), rules)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = TxnColumns(transaction_id="vec_id", fraud="label")
    return negatives.hard_negatives(
        vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, own, "embedding"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vector_shards,
        op2_private_spans,
        op3_divergence,
        op4_jaccard_classes,
        op5_linked_secrets,
        op6_toxicity_scores,
        op7_language_spans,
        op8_best_fit_packing,
        op9_source_mix,
        op10_forest_neighbours,
        op11_merkle_manifest,
        op12_url_verdicts,
        op13_hard_negatives,
    )
}

SQL: dict[str, str] = {
    "op9_source_mix": twins.SOURCE_MIX,
    "op11_merkle_manifest": twins.merkle_manifest(),
    "op12_url_verdicts": twins.judge_pages(URL_RULES),
    "op13_hard_negatives": twins.HARD_NEGATIVES,
}
