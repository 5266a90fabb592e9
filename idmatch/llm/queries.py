"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from idmatch.llm import chat, classifier, decontaminate, fim, jaccard, katz, mixing, negatives, packing, pages, rules, substrings, suffixes
from idmatch.llm.words import fold, schema, typed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = suffixes.suffix_dedup(table(spark, sf, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", (F.size("runs") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_chat(spark: SparkSession, sf: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = typed(table(spark, sf, "conversations"), conv_id="long", turn="long", role="string", text="string").unionByName(planted)

    def digest(batches):
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                said = chat.read_back(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in said).encode()).hexdigest()
                lost = "".join(chat.unescape(text[a:b]) for a, b in chat.loss_mask(text))
                rows.append((conv, len(said), whole, len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    done = chat.format_trees(chat.as_tree(turns))
    return done.mapInArrow(digest, schema(conv_id="long", n_turns="long", turns_sha256="string", loss_chars="long", loss_sha256="string", formatted_chars="long"))


@query
def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = substrings.substring_dedup(table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.col("covered").cast("long").alias("covered"), F.col("n_slots").cast("long").alias("n_slots"), "kind")


@query
def op7_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf, "documents"), n=3, threshold="0.9")


@query
def op8_katz_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = typed(table(spark, sf, "documents"), doc_id="long", text="string").withColumn("held", fold(F.col("doc_id"), 5) == 1)
    return katz.katz_scores(docs, held="held")


@query
def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf, "pages"))


@query
def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    labels = typed(table(spark, sf, "labels"), doc_id="long", quality="int").withColumnRenamed("quality", "label").filter(fold(F.col("doc_id"), 3) != 1)
    found = classifier.classify(table(spark, sf, "documents"), labels)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


#: The digest numbers of a document and where its two cuts lie.
_FIM_DRAWS = """d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
  CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d)"""


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    done = fim.fill_in_middle(table(spark, sf, "documents"), seed=1, percent=90, spm_percent=20)
    digest = lambda column: F.sha2(column.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = f"""WITH {_FIM_DRAWS},
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN n = 0 OR h3 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p"""


@query
def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("v"))
    return negatives.hard_negatives(vectors, anchor_every=100, positives=5, negatives=10, low=30, high=90)


ORACLES["op13_hard_negatives"] = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score,
  score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10"""


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
