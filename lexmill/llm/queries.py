"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontam, embed_dup, lang_id, near_dup, pii, prefix_trie, secret_scan, sharding, token_store, toxicity, warc_zip, whitening
from lexmill.llm.oracles import ORACLE_SQL  # noqa: F401
from lexmill.session import Workspace


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, there and back."""
    return bpe.roundtrip(
        _read(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ["doc_id"],
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    found = sharding.shard(_read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the loose ones that only one owner has."""
    found = secret_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text", "source"), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("__spans", lambda s: s["kind"] != "owned")
    live = F.size(F.filter("__spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"), live)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a content-addressed store and read back."""
    store = token_store.write(
        _read(spark, sf_dir, "documents", "doc_id", "text"),
        Workspace(spark, "store").path,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )
    return token_store.read_back(store).select(
        F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has in common with the benchmark's items."""
    found = decontam.scan(
        _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"]
    )
    n_hit = F.aggregate("__hits", F.lit(0), lambda s, h: s + h["b"] - h["a"]).cast("long")
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = near_dup.groups(_read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("__n_shingles").alias("n_shingles"),
        F.col("__component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("__component"), F.col("__kept")).alias("kept"),
    )


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose hashed id isn't held out."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = lang_id.train(docs, ~held & F.col("doc_id").isNotNull())
    found = lang_id.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
    return found.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"})


def op8_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings by cosine."""
    found = embed_dup.groups(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), keep=["vec_id"])
    return found.select(
        "vec_id", F.col("__n_links").alias("n_links"), F.col("__component").alias("component_id"), F.col("__kept").alias("kept")
    )


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP archives, and read back."""
    listing = warc_zip.write(_read(spark, sf_dir, "pages", "page_id", "url", "html"), Workspace(spark, "archives").path)
    return warc_zip.read(spark, listing).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The chain's categories, in order.
CATEGORIES = ["quality", "toxic"]


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    chain = toxicity.train(docs, _read(spark, sf_dir, "labels", "doc_id", *CATEGORIES), CATEGORIES)
    return toxicity.predict(docs, chain, keep=["doc_id"]).withColumnsRenamed({f"__p_{c}": f"p_{c}" for c in CATEGORIES} | {"__rejected": "toxic"})


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and those that the trees add, as kinds like_email and so on."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.scan(docs, pii.train(docs), keep=["doc_id"])
    base = F.filter("__spans", lambda s: s["base"])

    def joined(spans):
        kind = lambda s: F.when(s["base"], s["kind"]).otherwise(F.concat(F.lit("like_"), s["kind"]))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def rebuilt_conversations(turns: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, from_own, place, digest, words) of rebuilt conversations; a row of place 0 stands for each of them.

    Conversation c takes the first h turns of conversation c - c % 20 and its own after its first h; h is crc32(c) % 4. Turns
    of equal number are in the order of a digest of role and text. Turns without a conv_id belong to none.
    """
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *prefix_trie.turn_columns())
    own = ws.write(prefix_trie.placed(own, ws, "own", [F.col("turn").asc_nulls_first(), F.col("digest")]), "placed")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    each = own.where("place = 1").select("conv")
    heads = own.where("conv % 20 = 0 and place <= 3").withColumnRenamed("conv", "base")
    heads = each.withColumn("base", F.col("conv") - F.col("conv") % 20).join(heads, "base").where(F.col("place") <= h)
    roots = each.select("conv", F.lit(0).alias("from_own"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    heads = heads.select("conv", F.lit(0).alias("from_own"), "place", "digest", "words")
    return roots.union(heads).union(own.where(F.col("place") > h).select("conv", F.lit(1).alias("from_own"), "place", "digest", "words"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    ws = Workspace(spark, "trie")
    turns = rebuilt_conversations(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), ws)
    return prefix_trie.trie(turns, ws, [F.col("from_own"), F.col("place")]).drop("k1", "k2", "n_ends")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened."""
    found = whitening.whiten(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), keep=["vec_id"])
    return found.withColumnsRenamed({c: c.removeprefix("__") for c in found.columns})


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_store": op4_token_store,
    "op5_decontamination": op5_decontamination,
    "op6_near_dup": op6_near_dup,
    "op7_lang_id": op7_lang_id,
    "op8_embedding_dup": op8_embedding_dup,
    "op9_warc_zip": op9_warc_zip,
    "op10_toxicity": op10_toxicity,
    "op11_pii": op11_pii,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}
