"""One query per operator over its whole table, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, attention, backoff, chat, hosts, mixing, packing, periodic, pivots, secrets, sharding, simhash, topk

SHARDS = 40
#: Host and path rules of the page filter, and their verdicts.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: From this score a document counts as good.
GOOD = 0.3


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_vector_approximation(spark: SparkSession, directory: str) -> DataFrame:
    """The five largest integer inner products of every 50th vector."""
    vectors = topk.integer_vectors(table(spark, directory, "embeddings"), "vec_id", "embedding")
    return topk.top_inner_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op2_pivot_permutations(spark: SparkSession, directory: str) -> DataFrame:
    """Near-duplicate vectors of equal labels."""
    return pivots.near_duplicate_vectors(table(spark, directory, "embeddings"), "vec_id", "embedding", "label", 0.98)


def op3_chat_collapse(spark: SparkSession, directory: str) -> DataFrame:
    """Maximal conversations as text."""
    return chat.rendered(table(spark, directory, "conversations"), "conv_id", "turn", "role", "text")


def op4_source_schedule(spark: SparkSession, directory: str) -> DataFrame:
    """What a mix of 150 % of all words takes of every document."""
    docs = table(spark, directory, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    rows = mixing.mixed(docs, ["doc_id"], "source", "size")[1]
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_feistel_shards(spark: SparkSession, directory: str) -> DataFrame:
    """Shard and slot of every document."""
    docs = table(spark, directory, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    found = sharding.feistel_shards(docs, ["doc_id", "size", "text_crc32"], SHARDS)
    return found.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_attention_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    model = attention.learned(docs, table(spark, directory, "labels"), "doc_id", "text", "quality")
    found = attention.scored(docs, ["doc_id"], "text", model)
    predicted = (F.col("score") >= GOOD).cast("int")
    return found.select("doc_id", attention.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op7_simhash_trie(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    docs = table(spark, directory, "documents")
    prints = simhash.checkpointed(simhash.fingerprints(docs, ["doc_id"], "text"))
    found = simhash.near_duplicates(prints, "doc_id", "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_host_reputation(spark: SparkSession, directory: str) -> DataFrame:
    """Verdict on every page."""
    return hosts.judged(table(spark, directory, "pages"), ["page_id"], "url", RULES)


def op9_stupid_backoff(spark: SparkSession, directory: str) -> DataFrame:
    """Mean word score of every document by the words and pairs of all others."""
    found = backoff.backoff_scores(table(spark, directory, "documents"), "doc_id", "text", order=2)
    return found.withColumn("score", F.round("score", 6))


def op9_whole_backoff(spark: SparkSession, directory: str) -> DataFrame:
    """Mean word score of every document by counts that hold its own, from two up."""
    docs = table(spark, directory, "documents")
    found = backoff.backoff_scores(docs, "doc_id", "text", order=2, least=2, leave_out=False)
    return found.withColumn("score", F.round("score", 6))


def op9_trigram_backoff(spark: SparkSession, directory: str) -> DataFrame:
    """Mean word score of every document by runs of up to three words of all others."""
    found = backoff.backoff_scores(table(spark, directory, "documents"), "doc_id", "text", order=3)
    return found.withColumn("score", F.round("score", 6))


def op10_best_fit(spark: SparkSession, directory: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    pieces = packing.token_pieces(table(spark, directory, "documents"), "doc_id", "text")
    return packing.packed(packing.digests(pieces), "length")


def op11_grammar_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made to repeat, and the text without them."""
    docs = periodic.with_repeats(table(spark, directory, "documents").select("doc_id", "text"), "doc_id", "text")
    found = periodic.periodic_runs(docs, ["doc_id"], "text")
    # Longest first, then by start and period.
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, -r.period as period)))")
    lines = F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_field_secrets(spark: SparkSession, directory: str) -> DataFrame:
    """Secrets in every document: matches of the base patterns, and what the field adds."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs, ["doc_id"], "text", secrets.learned(docs, ["doc_id"], "text"))
    base = [F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id",
        *base,
        F.sha2(F.expr(listed.format(f"filter(spans, s -> s.kind <> '{secrets.KINDS[3]}')")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def op13_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary on every document."""
    return alignment.alignment_measures(table(spark, directory, "documents"), ["doc_id"], "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vector_approximation,
        op2_pivot_permutations,
        op3_chat_collapse,
        op4_source_schedule,
        op5_feistel_shards,
        op6_attention_quality,
        op7_simhash_trie,
        op8_host_reputation,
        op9_stupid_backoff,
        op9_whole_backoff,
        op9_trigram_backoff,
        op10_best_fit,
        op11_grammar_runs,
        op12_field_secrets,
        op13_token_alignment,
    )
}
