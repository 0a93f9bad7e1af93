"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knigovod.llm.decontaminate import contamination
from knigovod.llm.fim import fill_in_middle, restored
from knigovod.llm.fourrussians import hard_negatives
from knigovod.llm.jaccard import similarity_classes
from knigovod.llm.katz import katz_scores
from knigovod.llm.linechunks import without_repeated_chunks
from knigovod.llm.mixing import mixed
from knigovod.llm.permutation import nearest
from knigovod.llm.secrets import secret_spans
from knigovod.llm.suffixes import remove_repeats
from knigovod.llm.tokens import read_tokens, write_tokens
from knigovod.llm.toxicity import toxicity
from knigovod.llm.winnow import edited_fingerprints

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf):
    out = without_repeated_chunks(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_fingerprints(spark, sf):
    return edited_fingerprints(table(spark, sf, "documents"))


def op3_decontamination(spark, sf):
    out = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_secrets(spark, sf):
    out = secret_spans(table(spark, sf, "documents"))
    spans = F.expr("transform(kinds, (k, i) -> concat(k, ':', starts[i], ':', ends[i]))")
    base = F.expr("filter(spans, x -> NOT startswith(x, 'guess:'))")
    counted = {f"n_{k}": F.expr(f"cast(size(filter(kinds, x -> x = '{k}')) as bigint)") for k in ("assign", "access", "hex", "guess")}
    return out.withColumn("spans", spans).select(
        "doc_id", *[c.alias(n) for n, c in counted.items()], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"))


def op5_mixing(spark, sf):
    return mixed(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op6_jaccard_join(spark, sf):
    return similarity_classes(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    out = toxicity(docs, table(spark, sf, "labels"), fold() != 0)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op8_katz(spark, sf):
    return katz_scores(table(spark, sf, "documents"), fold() != 1)


def op9_token_files(spark, sf):
    return read_tokens(write_tokens(table(spark, sf, "documents"), tokenizer_path()))


def op10_suffix_dedup(spark, sf):
    return remove_repeats(table(spark, sf, "documents"), digest=True)


def op11_permutation_index(spark, sf):
    out = nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_fill_in_middle(spark, sf):
    out = fill_in_middle(table(spark, sf, "documents")).withColumn("restored", restored(F.col("output"), F.col("form")))
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_hard_negatives(spark, sf):
    rows = table(spark, sf, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % 100 == 0)
    return out.withColumn("rank", F.col("rank").cast("int"))


def pipeline(spark, sf):
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    return importlib.import_module("corpus_pipeline").run(spark, sf)


OPERATORS = (op1_line_dedup, op2_fingerprints, op3_decontamination, op4_secrets, op5_mixing, op6_jaccard_join, op7_toxicity,
             op8_katz, op9_token_files, op10_suffix_dedup, op11_permutation_index, op12_fill_in_middle, op13_hard_negatives)

SQL = {
    "op12_fill_in_middle": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        drawn AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
            CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts),
        formed AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM drawn),
        cut AS (SELECT *, substring(t, 1, low) AS p, substring(t, low + 1, high - low) AS m, substring(t, high + 1) AS s FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut""",
    "op13_hard_negatives": """
        WITH given AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM given a JOIN given c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10""",
}

QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in (*OPERATORS, pipeline)}
