"""One query per corpus operator, over the whole of its table."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from foldwise.llm import align, ann, bpe, decontaminate, langid, minhash, mixing, pii, prefix_trie, quality_bayes, quality_rules, token_files, url_trees
from foldwise.llm.registry import ORACLE, QUERIES, query
from foldwise.session import cut_lineage, ensure_checkpoint_dir, read_table

__all__ = ["ORACLE", "QUERIES"]

TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"


@query("op5_quality_rules", sql=quality_rules.oracle())
def op5_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_mix_sources", sql=mixing.ORACLE_SQL)
def op3_mix_sources(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size")))
    return mixing.mix(sized, size_col="size").select("doc_id", "size", "source_size", "target", "taken")


@query("op10_url_filter")
def op10_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_trees.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, decoded="decoded").select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_files.read(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_pii_spans")
def op8_pii_spans(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(F.col("pii"), pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("pii")).alias("spans"))


@query("op1_minhash_near_dedup", sql=minhash.ORACLE_SQL)
def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    may = langid.learnable(F.col("doc_id"))
    model = langid.fit(docs.where(may).select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.predict(docs.select("doc_id", "text", (~may).alias("held_out")), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_bayes.classify(docs, read_table(spark, sf_dir, "labels")).drop("text")


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query("op11_prefix_trie", sql=prefix_trie.ORACLE_SQL)
def op11_prefix_trie(spark, sf_dir):
    turns = cut_lineage(prefix_trie.number_turns(read_table(spark, sf_dir, "conversations")))
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return prefix_trie.trie(prefix_trie.share_heads(turns, 20, heads))


@query("op12_decontaminate", sql=decontaminate.ORACLE_SQL)
def op12_decontaminate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_align_tokenizers")
def op13_align_tokenizers(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.align(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(OTHER_TOKENIZER))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("pipeline", sql=corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
