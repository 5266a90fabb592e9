"""Split, sample and label queries."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import EMB, PARTS, table, vectors
from idmatch.operators import split as O

SHUFFLED = EMB + """, s AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) AS r,
 count(*) OVER (PARTITION BY label) AS n FROM emb)"""


@query(f"WITH {SHUFFLED} SELECT sample_id, label, CASE WHEN r <= 2 THEN 'test' ELSE 'train' END AS split FROM s")
def split_per_class(spark, sf):
    return O.split_per_class(vectors(spark, sf)).select("sample_id", "label", "split")


@query(f"WITH {SHUFFLED} SELECT sample_id, label, CASE WHEN r <= 6 THEN 'train' ELSE 'test' END AS split FROM s WHERE r <= 7")
def split_train_test_counts(spark, sf):
    return O.split_train_test_counts(vectors(spark, sf), 6, 1).select("sample_id", "label", "split")


@query(f"WITH {PARTS} SELECT sample_id, label, split FROM parts")
def split_ratio(spark, sf):
    return O.split_ratio(vectors(spark, sf)).select("sample_id", "label", "split")


@query("""WITH s AS (SELECT event_id AS sample_id, user_id AS label, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS r,
 count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT sample_id, label, CASE WHEN r <= CASE WHEN greatest(floor(n * 0.8), 1) >= n THEN n - 1 ELSE greatest(floor(n * 0.8), 1) END THEN 'train' ELSE 'test' END AS split FROM s""")
def split_train_ratio(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("label"))
    return O.split_train_ratio(rows).select("sample_id", "label", "split")


@query(f"""WITH {EMB}, s AS (SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) AS r, count(*) OVER () AS n FROM emb)
SELECT sample_id, r <= greatest(1, least(CAST(round(n * 0.2) AS BIGINT), n)) AS holdout FROM s""")
def fixed_holdout(spark, sf):
    return O.fixed_holdout(vectors(spark, sf)).select("sample_id", "holdout")


@query(f"WITH {SHUFFLED} SELECT sample_id, label FROM s WHERE r <= 5")
def cap_per_class(spark, sf):
    return O.cap_per_class(vectors(spark, sf), 5).select("sample_id", "label")


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3""")
def cap_per_class_first(spark, sf):
    return O.cap_per_class(table(spark, sf, "events"), 3, "event_id", "user_id", None).select("event_id", "user_id")


@query("SELECT ext_id, dense_rank() OVER (ORDER BY ext_id) - 1 AS class_idx FROM (SELECT DISTINCT o_custkey AS ext_id FROM orders)")
def dense_labels(spark, sf):
    return O.dense_labels(table(spark, sf, "orders").select(F.col("o_custkey").alias("label")))


@query("""SELECT s_name AS name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY md5(s_name || ':0'), s_name) AS c_custkey FROM supplier""")
def next_id(spark, sf):
    new = table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return O.next_id(table(spark, sf, "customer"), new, "c_custkey", "name")


@query("SELECT item_id, text FROM benchmark ORDER BY md5(CAST(item_id AS VARCHAR) || ':11'), item_id LIMIT 1")
def random_phrase(spark, sf):
    return O.random_phrase(table(spark, sf, "benchmark"), "item_id", 11)


@query("SELECT user_id AS class, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, class LIMIT 5")
def rank_classes(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("class")).agg(F.count("*").alias("n"))
    return O.rank_classes(counts, "n", top=5)
