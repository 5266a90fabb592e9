"""Text, date and number-validation queries; whole texts."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import r6, s6, table
from idmatch.functions import text as X
from idmatch.operators import relations
from idmatch.plans import login

NORM = r"trim(regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g'))"
TURNS = f"t AS (SELECT conv_id, turn, {NORM.format('text')} AS s FROM conversations), p AS (SELECT a.conv_id, a.turn, a.s AS a, b.s AS b FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


def _turns(spark, sf):
    turns = relations.spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id")
    t = turns.select("conv_id", "turn", X.normalize_text(F.col("text")).alias("s"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("b"))
    return t.withColumnRenamed("s", "a").join(after, ["conv_id", "turn"])


@query(f"WITH {TURNS} SELECT conv_id, turn, {s6('CASE WHEN greatest(len(a), len(b)) > 0 THEN 1 - levenshtein(a, b) * 1.0 / greatest(len(a), len(b)) END')} AS similarity FROM p")
def text_similarity(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", r6(X.text_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query(f"""WITH b AS (SELECT item_id, {NORM.format('text')} AS phrase FROM benchmark), d AS (SELECT doc_id AS item_id, {NORM.format('text')} AS said FROM documents)
SELECT item_id, {s6('1 - levenshtein(said, phrase) * 1.0 / greatest(len(said), len(phrase))')} AS similarity, 1 - levenshtein(said, phrase) * 1.0 / greatest(len(said), len(phrase)) >= 0.2 AS matched FROM b JOIN d USING (item_id)""")
def phrase_match(spark, sf):
    said = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("said"))
    phrase = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase"))
    j = login.phrase_scores(said, phrase, "item_id", "said", "phrase")
    a, b = F.col("said_norm"), F.col("phrase_norm")
    return j.select("item_id", r6(X.text_similarity(a, b)).alias("similarity"), X.similar_at_least(a, b, 0.2).alias("matched"))


@query(f"""WITH b AS (SELECT item_id, {NORM.format('text')} AS phrase FROM benchmark), s AS (SELECT item_id, phrase, substr(phrase, 1, CAST(len(phrase) * (5 + item_id % 6) // 10 AS BIGINT)) AS cut FROM b),
d AS (SELECT item_id, phrase, CASE WHEN item_id % 2 = 0 THEN cut ELSE reverse(substr(reverse(phrase), 1, len(cut))) END AS said FROM s)
SELECT item_id, {s6('1 - levenshtein(said, phrase) * 1.0 / greatest(len(said), len(phrase))')} AS similarity, {', '.join(f'1 - levenshtein(said, phrase) * 1.0::DOUBLE / greatest(len(said), len(phrase)) >= {x} AS {n}' for n, x in (('login', 0.7), ('strict', 0.85)))} FROM d""")
def phrase_levels(spark, sf):
    """Phrases that lack between none and half of their characters, at their beginning or end, at both levels."""
    phrase = table(spark, sf, "benchmark").select("item_id", X.normalize_text(F.col("text")).alias("phrase"))
    n = F.floor(F.length("phrase") * (5 + F.col("item_id") % 6) / 10).cast("int")
    said = F.when(F.col("item_id") % 2 == 0, F.substring("phrase", F.lit(1), n)).otherwise(F.reverse(F.substring(F.reverse("phrase"), F.lit(1), n)))
    rows = phrase.withColumn("said", said)
    a, b = F.col("said"), F.col("phrase")
    return rows.select("item_id", r6(X.text_similarity(a, b)).alias("similarity"), X.similar_at_least(a, b, X.LOGIN_SIMILARITY).alias("login"),
                       X.similar_at_least(a, b, X.STRICT_SIMILARITY).alias("strict"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(source || doc_id, '^\\d{3}') THEN 1 ELSE NULL END AS bad, CASE WHEN doc_id < 1000 THEN doc_id ELSE CAST(left(doc_id::VARCHAR, 3) AS BIGINT) END AS id,
 CAST(coalesce(nullif(regexp_extract(source || '_' || doc_id, '(\\d+)', 1), ''), '-1') AS BIGINT) AS first_number FROM documents""")
def id_from_name(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.when(F.col("doc_id") < 1000, F.lpad(F.col("doc_id").cast("string"), 3, "0")).otherwise(F.col("doc_id").cast("string")), F.lit("_x.jpg"))
    source = F.concat("source", F.col("doc_id").cast("string"))
    return d.select("doc_id", F.when(X.id_from_name(source).isNotNull(), F.lit(1)).alias("bad"), X.id_from_name(name).alias("id"),
                    X.first_number(F.concat_ws("_", "source", "doc_id")).alias("first_number"))


TOKENS = "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5' WHEN event_type = 'error' THEN event_type ELSE '-' || event_id END AS t FROM events"


@query(f"WITH t AS ({TOKENS}) SELECT event_id, regexp_full_match(t, '[+-]?\\d+') AS whole, regexp_full_match(t, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') AS number FROM t")
def number_checks(spark, sf):
    kind, value = F.col("event_type"), F.floor("value").cast("string")
    t = F.when(kind == "click", value).when(kind == "view", F.concat(value, F.lit(".5"))).when(kind == "error", kind).otherwise(
        F.concat(F.lit("-"), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", X.is_int(t).alias("whole"), X.is_number(t).alias("number"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS version FROM events")
def iso_utc(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", X.iso_utc(ts).alias("iso"), X.version_ts(ts).alias("version"))
