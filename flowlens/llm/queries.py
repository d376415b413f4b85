"""The registered queries of the text and vector operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import ann, bpe, chat, decontamination, hard_negatives, html_text, licenses, line_templates, passages, pii, prefix_trie, simhash, toxicity



def byte_bpe() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document; null text is empty."""
    found = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each vector whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark; none for null or empty texts."""
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical length, digest and licence (null: none known) of every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "canonical_chars", "canonical_sha256", "license_id")


ORACLES["op4_license_scan"] = licenses.oracle()


@_query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that documents share; none for null or short texts."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


@_query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation and from conversation -7; null text is empty."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(table.unionByName(extra)))


@_query
def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and the digest of the cleaned text of every document; null text counts as empty in the digest."""
    table = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.line_counts(line_templates.drop_recurring(table))


@_query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for null html."""
    found = html_text.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@_query
def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; zero for texts without words."""
    return simhash.digest_columns(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents with both probabilities; none for null texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxic(docs, _table(spark, sf_dir, "labels"))
    return scored.where("toxic").select("doc_id", "p_low_quality", "p_toxic")


@_query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document (counts and digest), and all spans with those that the field adds."""
    table = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest_columns(pii.find(table, pii.train(table)))


@_query
def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives of each of the five nearest positives of every vector whose id is divisible by 50.

    Where the id is divisible by 7 the label becomes (label + 1) % 10 first.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label=label, anchors=F.col("vec_id") % 50 == 0)


ORACLES["op12_hilbert_negatives"] = hard_negatives.oracle()


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt with the first turns of the hundred's first one."""
    turns = prefix_trie.conversation_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns))


ORACLES["op13_prefix_trie"] = prefix_trie.oracle()
