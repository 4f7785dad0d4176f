"""One query per operator, over whole tables with production parameters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, fingerprints, infilling, line_dedup, manifest, near_dups, repeats, token_files, toxicity, vector_dups
from tessera.llm.catalog import ORACLES, QUERIES, query, table, vocabulary
from tessera.llm.common import new_folder
from tessera.llm.packing import pack_documents
from tessera.llm.sharding import shard_documents

__all__ = ["ORACLES", "QUERIES"]


@query("op2_jump_hash_shards")
def op2(spark, base):
    return shard_documents(table(spark, base, "documents"), shards=16)


@query("op3_cost_balanced_packing")
def op3(spark, base):
    pieces = pack_documents(table(spark, base, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


@query("op10_line_windows", line_dedup.ROWS_SQL)
def op10(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs)


@query("op8_bloom_lookup_fingerprints")
def op8(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    return fingerprints.fingerprint_documents(docs, fingerprints.SENTENCE_END)


@query("op9_template_chat")
def op9(spark, base):
    rows = chat.with_probe(table(spark, base, "conversations"))
    return chat.read_back(chat.format_conversations(rows))


@query("op5_repair_token_files")
def op5(spark, base):
    path = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, base, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_hyperminhash_components")
def op4(spark, base):
    rows = near_dups.near_duplicates(table(spark, base, "documents"), width=2, share=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_multiple_instance_toxicity")
def op7(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, table(spark, base, "labels"))
    scored = toxicity.score_documents(docs, weights)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@query("op1_spaced_seed_decontamination")
def op1(spark, base):
    return decontamination.contaminated_items(table(spark, base, "documents"), table(spark, base, "benchmark"))


@query("op6_suffix_family_repeats")
def op6(spark, base):
    rows = repeats.remove_repeats(table(spark, base, "documents"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_swar_infilling", infilling.ROWS_SQL)
def op11(spark, base):
    rows = infilling.fill_in_middle(table(spark, base, "documents"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


@query("op13_merkle_windows", manifest.rows_sql())
def op13(spark, base):
    rows = manifest.manifest(table(spark, base, "documents"), manifest.tampered(F.col("doc_id"), F.col("n_chars")))
    return manifest.verified(rows)


@query("op12_cross_polytope_links")
def op12(spark, base):
    return vector_dups.near_duplicate_vectors(table(spark, base, "embeddings"), least=0.95)
