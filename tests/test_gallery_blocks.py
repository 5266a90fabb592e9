"""Searches of galleries in blocks: equal to the small plan, whatever blocks, widths and broken values there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from idmatch.operators import gallery_blocks, scoring


def tables(spark, clusters, per_class, width=8, classes=24, tight=0.05):
    draw = np.random.default_rng(clusters)
    middle = draw.normal(size=(clusters, width))
    own = middle[np.arange(classes) % clusters] + tight * draw.normal(size=(classes, width))
    templates = [(int(c), (own[c] + 0.3 * tight * draw.normal(size=width)).tolist(), 0.01 * c) for c in range(classes) for _ in range(per_class if c else 8 * per_class)]
    templates += [(90, [0.0] * width, 0.0), (91, [float("nan")] * width, 0.0), (92, [1e-9] + [0.0] * (width - 1), 0.0), (5, [1.0, 2.0], 0.0), (93, [2.0, 1.0], 0.0), (3, None, 0.0), (94, [float("inf")] * width, 0.0)]
    probes = [(i, int(c) if i % 5 else None, (own[c] + 0.5 * tight * draw.normal(size=width)).tolist()) for i, c in enumerate(draw.integers(0, classes, 120))]
    probes += [(200, 1, [0.0] * width), (201, 1, [float("nan")] * width), (202, 5, [1.0, 1.9]), (203, 777, own[2].tolist()), (204, 2, None), (205, 3, [1e-9] * width), (206, 1, [1.0, 2.0, 3.0]), (0, 2, own[1].tolist())]
    return (spark.createDataFrame(probes, "probe_id long, label long, v array<double>").repartition(4),
            spark.createDataFrame(templates, "class long, t array<double>, b double").repartition(3))


def rows_of(df):
    plain = lambda x: "-" if x is None else f"{x + 0.0:.9f}" if isinstance(x, float) else str(x)
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("metric", [scoring.COSINE, scoring.LINEAR])
@pytest.mark.parametrize("clusters,block", [(4, 600), (24, 200), (1, 2000)])
def test_blocks_give_what_one_broadcast_gives(spark, clusters, block, metric):
    probes, gallery = tables(spark, clusters, 6)
    once = [(scoring.claimed_scores(probes, gallery, metric), scoring.claimed_scores(probes, gallery, metric, gallery_bytes=block))]
    once.append((scoring.score_topk(probes, gallery, 3, metric), scoring.score_topk(probes, gallery, 3, metric, gallery_bytes=block)))
    if clusters == 4:
        once.append((scoring.score_all(probes, gallery, metric), scoring.score_all(probes, gallery, metric, gallery_bytes=block)))
        once.append((scoring.score_range(probes, gallery, metric), scoring.score_range(probes, gallery, metric, gallery_bytes=block)))
    for small, large in once:
        assert rows_of(small) == rows_of(large)


def test_a_search_skips_blocks_and_spreads_a_large_class(spark):
    probes, gallery = tables(spark, 24, 40)
    enrolled = scoring.enrol(gallery)
    blocks = enrolled.blocks(1200)
    of_class = blocks.table.groupBy("class").agg(F.countDistinct("block").alias("n"), F.max("split").alias("split"))
    assert of_class.filter("class = 0").first()["n"] > 5 and of_class.filter("split <> (n > 1)").count() == 0
    assert blocks.table.groupBy("block").count().agg(F.max("count")).first()[0] <= 1200 // 64 + 1
    rows = probes.filter(F.size("v") == 8).withColumn("row", F.monotonically_increasing_id())
    every = gallery_blocks.visits(rows, blocks.bounds).count()
    floor = scoring.search(rows.select("row", "v"), blocks, 1).select("row", F.col("score").alias("need"))
    needed = gallery_blocks.visits(rows.join(floor, "row"), blocks.bounds, "need").count()
    assert 0 < needed < every / 3


def test_bounds_hold_for_every_template(spark):
    probes, gallery = tables(spark, 3, 10, tight=1.0)
    blocks = scoring.enrol(gallery).blocks(500)
    x = np.array([r["v"] for r in probes.filter("probe_id < 100").collect() if len(r["v"]) == 8])
    number, high = blocks.bounds.highest(x)
    for r in blocks.table.filter(F.size("t") == 8).collect():
        t = np.array(r["t"])
        norm = np.linalg.norm(t)
        if np.isfinite(norm) and norm > 1e-5:
            assert (x @ t / norm / np.linalg.norm(x, axis=1) <= high[:, number.tolist().index(r["block"])]).all()


def test_an_empty_side(spark):
    probes, gallery = tables(spark, 3, 2)
    assert scoring.score_topk(probes.limit(0), gallery, 2, gallery_bytes=100).count() == 0
    lost = scoring.claimed_scores(probes.filter("probe_id = 201"), gallery, gallery_bytes=100).collect()
    assert [(r["pred"], r["own"], r["better"]) for r in lost] == [(None, None, None)]


def test_a_probe_is_sent_to_cells_and_not_to_every_block(spark):
    probes, gallery = tables(spark, 1, 30)
    blocks = scoring.enrol(gallery).blocks(256)
    rows = probes.filter(F.size("v") == 8).withColumn("row", F.monotonically_increasing_id()).withColumn("need", F.lit(-2.0))
    assert len(blocks.bounds.every) > 150
    every, asked = gallery_blocks.visits(rows, blocks.bounds), gallery_blocks.visits(rows, blocks.bounds, "need")
    assert every.count() <= rows.count() * 2 * gallery_blocks.CELLS and asked.count() <= rows.count() * 2 * gallery_blocks.CELLS
    cells = blocks.table.groupBy("class").agg(F.countDistinct("cell").alias("n"), F.max("apart").alias("apart"))
    assert cells.filter("apart <> (n > 1)").count() == 0
    assert rows_of(scoring.claimed_scores(probes, gallery)) == rows_of(scoring.claimed_scores(probes, gallery, gallery_bytes=256))
