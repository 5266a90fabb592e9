"""The corpus pipeline against brute force, stage by stage, and the registered queries of the subpackage."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from idmatch.session import durable

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = durable(stage(spark, docs, SF))
        seen.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return seen


def test_columns(stages):
    for _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stages[-1][2] == ["doc_id", "text", "lang", "source", "n_chars", "taken"]


def test_quality_keeps_labelled_good(spark, stages):
    before, after, _ = stages[0]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    right = [(r.doc_id in kept) == (label[r.doc_id] == 1) for r in before if r.doc_id in label]
    assert sum(right) >= 0.95 * len(right)
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_near_duplicates(stages):
    before, after, _ = stages[1]
    sets = {}
    for r in before:
        w = [x.translate(LOWER) for x in WORD.findall(r.text or "")]
        sets[r.doc_id] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert sorted(r.doc_id for r in after) == [i for i in ids if root(i) == i]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = lambda name, k=60: " ".join(f"{name}{j}" for j in range(k))
    rows = [(None, text("a")), (None, text("b")), (None, text("c") + " more"), (None, None), (1, text("c")), (5, text("d")), (5, text("e")), (5, text("f") + " more"),
            (7, text("f")), (8, text("e") + " more"), (9, text("g")), (9, text("g")), (9, text("g") + " more"), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    alone = [(None, text("a")), (None, text("b")), (1, text("c")), (5, text("d")), (5, text("e")), (5, text("f") + " more")]
    assert sorted(map(str, (k for k in kept if k[1] and not k[1].startswith("g")))) == sorted(map(str, alone))
    assert len([k for k in kept if (k[1] or "").startswith("g")]) == 1 and len([k for k in kept if not k[1]]) == 2


def test_repeated_passages(stages):
    before, after, _ = stages[2]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        w = WORD.findall(r.text or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), r.doc_id)
    want = {}
    for r in before:
        w = WORD.findall(r.text or "")
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < r.doc_id for k in range(j, j + 13)}
        want[r.doc_id] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_benchmark_leaks(spark, stages):
    before, after, _ = stages[3]
    plain = lambda t: [x for x in (re.sub(r"\W+", "", w.lower()) for w in WORD.findall(t or "")) if x]
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r.text)
        grams |= {tuple(w[j : j + 13]) for j in range(len(w) - 12)}
    leak = {r.doc_id for r in before if any(tuple(w[j : j + 13]) in grams for w in [plain(r.text)] for j in range(len(w) - 12))}
    assert leak and {r.doc_id for r in before} - {r.doc_id for r in after} == leak


def test_mix(stages):
    before, after, _ = stages[4]
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in before}
    total = Counter()
    for r in before:
        total[r.source] += size[r.doc_id]
    taken = Counter()
    for r in after:
        assert 0 < r.taken <= 3 * size[r.doc_id]
        taken[r.source] += r.taken
    assert sum(taken.values()) == pytest.approx(sum(total.values()), rel=0.02)


def test_run_is_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1][1]))


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
