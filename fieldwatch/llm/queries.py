"""Registered queries of this package, each over a whole given table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fieldwatch.llm import exact, merkle, mixing, packing, postings, simhash, spelling, suffix_array, suffix_tree, templates, tokens, toxicity, vectors
from fieldwatch.llm.common import table, unsigned_hex
from fieldwatch.plans.catalog import Catalog

cat = Catalog()


@cat.query(
    """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.vector) + 1), lambda i: q.vector[i] * c.vector[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 10"""
)
def op1_topk_search(spark, d):
    rows = vectors.integer_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return vectors.top_k(rows, rows.where("vec_id % 100 = 0"))


@cat.query()
def op2_packing(spark, d):
    packed = packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@cat.query()
def op3_simhash_dedup(spark, d):
    linked = simhash.near_duplicates(table(spark, d, "documents"), shingle=3, most_bits=2)
    return linked.withColumn("fingerprint", unsigned_hex(F.col("fingerprint")))


@cat.query()
def op4_toxicity(spark, d):
    docs = table(spark, d, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit_model(docs, table(spark, d, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


@cat.query(templates.SQL)
def op5_line_dedup(spark, d):
    return templates.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))


@cat.query()
def op6_source_mixing(spark, d):
    return mixing.mix_sources(table(spark, d, "documents"))


@cat.query(
    r"""WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)"""
)
def op7_exact_dedup(spark, d):
    return exact.exact_copies(table(spark, d, "documents"))


@cat.query()
def op8_substring_dedup(spark, d):
    cut = suffix_tree.dedup_substrings(table(spark, d, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@cat.query()
def op9_token_files(spark, d):
    folder = tokens.token_folder(spark)
    manifest = tokens.write_token_files(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    back = tokens.read_token_files(manifest, folder)
    return back.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@cat.query()
def op10_suffix_array_dedup(spark, d):
    cut = suffix_array.dedup_bytes(table(spark, d, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@cat.query(spelling.SQL)
def op11_spelling_variants(spark, d):
    return spelling.variants(table(spark, d, "documents"), damage=97)


@cat.query(postings.SQL)
def op12_decontamination(spark, d):
    found = postings.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"), size=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@cat.query(merkle.manifest_sql())
def op13_merkle_manifest(spark, d):
    docs = table(spark, d, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    received = {"text": F.when(tampered, lowered).otherwise(F.col("text"))}
    manifest = merkle.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], received=received)
    return manifest.withColumn("proof_sha256", F.sha2("proof", 256)).drop("proof")
