"""Operators against brute force on small tables, and on odd input: nulls, empty and long texts, ties, repeats, no rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from idmatch import session
from idmatch.llm import chat, classifier, components, decontaminate, jaccard, katz, mixing, packed, pages, rules, substrings, suffixes
from idmatch.llm.words import whole, window_hashes, word_hashes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, slab string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts() -> list[tuple]:
    """Documents of random words with near copies, shared passages, repeats, and odd rows."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, out = make(60), []
    for i in range(60):
        text = make(r.randint(1, 220))
        if i % 5 == 0:
            text = text + "\n" + passage + " " + make(5)
        if i % 7 == 0 and i:
            text = out[-1][1] + " " + make(2)
        if i % 11 == 0 and i:
            text = out[-1][1]
        out.append((i, text))
    out += [(60, None), (61, ""), (62, " \t\n"), (63, "Word"), (64, "word"), (65, "a " * 900), (66, "x" * 3000), (67, "a b"), (68, "same row " * 30), (68, "same row " * 30), (None, make(50)), (69, "  \u0001 Ünï")]
    return [(i, t, ("en", "fr", None)[k % 3], (None, "s1", "s2", "s3")[k % 4], 0, "u", "s", "i") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def of(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows)


def key(doc_id):
    return math.inf if doc_id is None else doc_id


def test_suffix_array():
    r = random.Random(1)
    for _ in range(500):
        x = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize(("crowded", "piece"), [(256, 1 << 19), (1, 300)])
def test_suffix_dedup(docs, empty, crowded, piece):
    got = sorted(suffixes.suffix_dedup(docs, crowded=crowded, piece=piece).collect(), key=lambda r: (key(r.doc_id), r.n_bytes))
    raw = [(i, (t or "").encode()) for i, t, *_ in texts()]
    seen = collections.Counter(x[j : j + 200] for _, x in raw for j in range(len(x) - 199))
    want = []
    for i, x in raw:
        gone = bytearray(len(x))
        for j in range(len(x) - 199):
            if seen[x[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        want.append((i, bytes(c for c, g in zip(x, gone) if not g), len(x), sum(gone), [e for m in re.finditer(b"\1+", bytes(gone)) for e in m.span()]))
    want.sort(key=lambda w: (key(w[0]), w[2]))
    assert [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, list(r.runs)) for r in got] == want
    assert suffixes.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_a_long_periodic_text(spark):
    period = "abcdefghij klmno " * 360_000
    rows = spark.createDataFrame([(1, period), (2, "q" * 250 + "r"), (3, "z" * 199)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, list(r.runs)) for r in suffixes.suffix_dedup(rows).select("doc_id", "n_bytes", "n_removed", "runs").collect()}
    assert got == {1: (len(period), len(period), [0, len(period)]), 2: (251, 250, [0, 250]), 3: (199, 0, [])}


def test_substring_dedup(docs, empty):
    first: dict = {}
    for i, t, *_ in sorted(texts(), key=lambda d: key(d[0])):
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), key(i))
    want = []
    for i, t, *_ in texts():
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < key(i):
                gone[j : j + 13] = [True] * 13
        want.append((str(i), " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    got = substrings.substring_dedup(docs, carry=("lang",)).collect()
    assert sorted((str(r.doc_id), r.text, r.n_words, r.n_removed) for r in got) == sorted(want)
    assert all(sum(b - a for a, b in zip(r.runs[::2], r.runs[1::2])) == r.n_removed for r in got)
    assert substrings.substring_dedup(empty).count() == 0


def _slab(n_bytes: int) -> dict:
    """A slab of texts of about 2000 bytes, their ids descending in part, with a passage that every tenth has."""
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(5000)]
    passage = " ".join(r.choices(vocabulary, k=40))
    found = [(" ".join(r.choices(vocabulary, k=330)) + (f" {passage}" if i % 10 == 0 else "")).encode() for i in range(n_bytes // 2000)]
    raw, offs = b"".join(found), np.cumsum([0, *map(len, found)])
    return {"slab": 3, "id": [i ^ 5 for i in range(len(found))], "offs": offs.tolist(), "size": len(raw), "raw": pa.compress(raw, "zstd", asbytes=True)}


def test_windows_of_a_slab_in_parts_and_pieces(monkeypatch):
    row = _slab(60_000)
    texts_of_row, ids = packed.texts_of(row), np.array(row["id"])
    w = words(texts_of_row)
    start = np.flatnonzero(whole(w, 13))
    want = window_hashes(word_hashes(texts_of_row, w), 13)[start]
    monkeypatch.setattr(substrings, "PART_BYTES", 7000)
    keys, docs = substrings._windows(texts_of_row, 13)
    assert keys.tolist() == want.tolist() and docs.tolist() == w.doc[start].tolist()
    least: dict = {}
    for k, i in zip(keys.tolist(), ids[docs].tolist()):
        least[k] = min(i, least.get(k, i))
    found = substrings._asked(row, 13, 58).to_pylist()
    told = [x for r in found for x in zip(packed.unpack(r["keys"], r["bucket"] << 58).tolist(), (packed.unplanes(r["ids"]).astype(np.int64) + r["base"]).tolist())]
    assert told == sorted(least.items()) and all(r["slab"] == 3 for r in found)


def test_earlier_windows_of_a_bucket(monkeypatch):
    r = np.random.default_rng(4)
    low, width = 63 << 58, 1 << 58
    pool = np.unique(r.integers(low, low + width, 300, np.uint64))
    pool[-1] = low + width - 1  # the largest key there is
    keys = [np.sort(r.choice(pool, n, False)) for n in (200, 1, 0, 150, 250)]
    ids = [r.integers(0, 4, len(k)) for k in keys]
    least: dict = {}
    for k, i in zip(np.concatenate(keys).tolist(), np.concatenate(ids).tolist()):
        least[k] = min(i, least.get(k, i))
    want = [[least[x] < i for x, i in zip(k.tolist(), own.tolist())] for k, own in zip(keys, ids)]
    for together in (1 << 17, 50, 1):
        monkeypatch.setattr(substrings, "TOGETHER", together)
        assert [x.tolist() for x in substrings._earlier(keys, ids, low, width)] == want


def test_substring_dedup_takes_little_memory_for_a_slab(spark, monkeypatch):
    """The task that makes the requests of two slabs of 4 MB, run here."""
    row = _slab(4 << 20)
    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, run, *_: runs.append(run) or df)
    substrings._requests(spark.createDataFrame([], "slab long, id array<long>, offs array<long>, size long, raw binary"), 13, 58)
    batch = pa.RecordBatch.from_pylist([row, row])
    tracemalloc.start()
    try:
        for _ in runs[0](iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 10 * row["size"]
    finally:
        tracemalloc.stop()


def test_slabs_are_written_plainly_in_small_batches(spark):
    before = spark.conf.get(session.BATCH_BYTES)
    rows = spark.range(4).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 100) AS text")
    with session.scratch(spark) as folder:
        table = packed.slabs(rows)
    files = [f for f in table.inputFiles() if folder.split("/")[-1] in f]
    found = pq.ParquetFile(files[0].removeprefix("file:").replace("///", "/")).metadata.row_group(0)
    assert {found.column(i).compression for i in range(found.num_columns)} == {"UNCOMPRESSED"}
    assert spark.conf.get(session.BATCH_BYTES) == before
    assert sorted(i for r in table.collect() for i in r.doc_id) == [0, 1, 2, 3]
    with pytest.raises(KeyError), session.small_batches(spark):
        assert spark.conf.get(session.BATCH_BYTES) == "4m"
        raise KeyError
    assert spark.conf.get(session.BATCH_BYTES) == before
    session.drop(spark, folder)


@pytest.mark.parametrize(("n", "t"), [(3, "0.9"), (5, "0.8"), (3, "0.5")])
def test_jaccard_groups(docs, empty, n, t):
    def shingles(text):
        w = [x.translate(LOWER) for x in WORD.findall(text or "")]
        return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    rows = [(i, shingles(x)) for i, x, *_ in texts()]
    parent = {key(i): key(i) for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    num, den = {"0.9": (9, 10), "0.8": (4, 5), "0.5": (1, 2)}[t]
    for i, a in rows:
        for j, b in rows:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((root(key(i)), root(key(j))))
                parent[y] = x
    want = sorted((str(i), len(a), str(None if root(key(i)) == math.inf else root(key(i)))) for i, a in rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_groups(docs, n, t).collect())
    assert got == want
    assert jaccard.jaccard_groups(empty).count() == 0


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text too far from each other to link make no pairs by what they have in common; links stay."""
    r, n, made = random.Random(11), 5, []
    base = [f"w{j}" for j in range(150)]

    def copy(edits, seed=None):
        words = list(base)
        for j in (random.Random(seed) if seed is not None else r).sample(range(5, 145), edits):
            words[j] = f"e{seed}x{j}" if seed is not None else f"u{r.getrandbits(40)}"
        return words

    found = [base] + [copy(k) for k in [1, 2, 3] * 8 + [4, 5, 6] * 60]
    for seed in range(8):  # far from the base, close to each other
        found += [copy(6, seed) + [f"t{seed}y{j}"] for j in range(3)]
    found += [copy(5)[: r.randint(100, 150)] for _ in range(20)]
    r.shuffle(found)
    sets = [frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for w in found]
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    bounded = jaccard._bounded

    def counted(pairs, *rest):
        made.append(pairs.count())
        return bounded(pairs, *rest)

    monkeypatch.setattr(jaccard, "_bounded", counted)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(found)], "doc_id long, text string").repartition(3)
    got = {row.doc_id: row.component_id for row in jaccard.jaccard_groups(rows, n, "0.8").collect()}
    assert got == {i: root(i) for i in range(len(found))} and len(set(got.values())) > 100
    assert made[-1] <= len(found), made


def test_jaccard_users_of_like_size():
    """A shingle's users are those of sets that may be similar: no class of like sizes is cut, others do not count."""
    r = np.random.default_rng(5)
    for t in (Fraction("0.9"), Fraction("0.8"), Fraction(1)):
        size = np.arange(1, 3000)
        kind = jaccard.size_classes(size, t).astype(int)
        least = -(-size * t.numerator // t.denominator)  # the smallest set that may be similar
        assert (kind - kind[least - 1] <= 1).all()
    token, kind = r.integers(0, 12, 300).astype(np.uint64), r.integers(0, 9, 300).astype(np.uint8)
    got = jaccard.like_users(token, kind, np.ones(300, np.uint8))
    assert got.tolist() == [sum(token[j] == token[i] and abs(int(kind[j]) - int(kind[i])) <= 1 for j in range(300)) for i in range(300)]


def test_jaccard_of_small_groups_reads_no_differences(spark, monkeypatch):
    """Few texts that are alike but not linked meet by their prefixes; their whole sets are not sent to their hub's."""
    r, n, asked, found = random.Random(3), 5, [], []
    for g in range(6):
        base = [f"g{g}w{j}" for j in range(120)]
        for i in range(8):
            words = list(base)
            for j in r.sample(range(5, 115), 5):
                words[j] = f"g{g}i{i}x{j}"
            found.append(words)
    differences = jaccard._differences

    def counted(members, *rest):
        asked.append(members.count())
        return differences(members, *rest)

    monkeypatch.setattr(jaccard, "_differences", counted)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(found)], "doc_id long, text string").repartition(3)
    sets = [frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for w in found]
    least = list(range(len(found)))
    for _ in found:
        least = [min(least[j] for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)) for a in sets]
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_groups(rows, n, "0.8").collect()} == dict(enumerate(least))
    assert asked == [0]


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {row.node: row.component for row in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == c for x, c in parent.items())


def test_katz_is_normalised_and_matches_brute_force(spark, docs, empty):
    train = ["a b a b c", "a b d", "c a b", "b b b", None, "a b a c"]
    table = spark.createDataFrame([(i, t, False) for i, t in enumerate(train)] + [(9, "a d b zz", True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in katz.katz_scores(table, "held").collect()}
    tokens = lambda t: (t or "").split() + ["</s>"]
    c1, c2, past = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = ["<s>", *tokens(t)]
        c1.update(w[1:])
        c2.update(zip(w, w[1:]))
        past.update(w[:-1])
    tally = [sum(v == r for v in c2.values()) for r in range(1, katz.DISCOUNTED + 2)]
    d = katz.discounts(np.array(tally))
    n, v = sum(c1.values()), len(c1)
    base = lambda w: (c1[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(h, w):
        if not past[h]:
            return base(w)
        star = lambda x: d[min(c2[h, x], katz.DISCOUNTED + 1)] * c2[h, x] / past[h]
        if c2[h, w]:
            return star(w)
        seen = [x for x in c1 if c2[h, x]]
        return base(w) * (1 - sum(map(star, seen))) / (1 - sum(map(base, seen)))

    for h in ["<s>", "a", "b", "nowhere"]:
        assert sum(p(h, w) for w in [*c1, "unknown"]) == pytest.approx(1)
    for i, t in [*enumerate(train), (9, "a d b zz")]:
        w = ["<s>", *tokens(t)]
        assert got[i].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(w, w[1:])))
        assert got[i].base_score == pytest.approx(sum(math.log10(base(b)) for b in w[1:]))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n)
    three = katz.katz_scores(docs.withColumn("held", F.col("doc_id") % 5 == 1), "held", order=3)
    assert three.count() == len(texts()) and three.filter("score IS NULL OR score > 0").count() == 0
    assert katz.katz_scores(empty.withColumn("held", F.lit(False)), "held").count() == 0


def test_discounts_of_odd_tallies():
    for tally in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [100, 50, 30, 20, 15, 10]):
        d = katz.discounts(np.array(tally))
        assert ((d[1:] > 0) & (d[1:] <= 1)).all()


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs, shard_words=256).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in texts():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / open_ for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 48 for s in order)
    assert len(got) == len(texts()) and of(got, "taken") == of(mixing.mix_sources(docs.repartition(7), shard_words=256).collect(), "taken")
    assert mixing.mix_sources(empty).count() == 0


def test_apportion_is_sainte_lague(spark):
    claims = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.4, "e": 0.0}
    rows = spark.createDataFrame([(k, v, 17) for k, v in claims.items()], "name string, claim double, seats long")
    got = {r.name: r.quota for r in mixing.apportion(rows, [], [F.col("name")], "claim", "seats").collect()}
    want = dict.fromkeys(claims, 0)
    for _ in range(17):
        want[max(claims, key=lambda k: (claims[k] / (2 * want[k] + 1)))] += 1
    assert {k: got.get(k, 0) for k in claims} == want


def test_targets_over_their_limit(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": pytest.approx(960), "b": 30, "c": 30, None: 0}


def test_chat_round_trip_and_trees(spark):
    odd = r"\### Assistant: </turn> ok"
    messages = spark.createDataFrame(
        [(1, 1, None, "user", odd, 0.0), (1, 2, 1, "assistant", None, 0.2), (1, 3, 1, "assistant", "b\\", 0.9), (1, 4, 3, "us: er\n", "", 0.1), (1, 5, 99, "user", "orphan", 0.5),
         (None, 1, None, "user", "x", None), (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0), (2, 3, 1, "user", "hangs", 1.0), (1, 4, 3, "us: er\n", "", 0.1)],
        "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r["rank"]): r for r in chat.format_trees(messages, branches=9).collect()}
    said = {k: [(a, b) for a, b, _, _ in chat.read_back(r.formatted)] for k, r in got.items()}
    assert said == {(1, 1): [("user", odd), ("assistant", "b\\"), ("us: er\n", "")], (1, 2): [("user", "orphan")], (1, 3): [("user", odd), ("assistant", "")], (None, 1): [("user", "x")]}
    only = [r for r in chat.format_trees(messages).collect()]
    assert {(r.conv_id, r.leaf_id) for r in only} == {(1, 4), (None, 1)}
    text = got[1, 1].formatted
    assert [chat.unescape(text[a:b]) for a, b in chat.loss_mask(text)] == ["b\\"]


def test_long_conversation(spark):
    turns = spark.range(700).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.format_trees(chat.as_tree(turns)).first()
    assert [t for _, t, _, _ in chat.read_back(row.formatted)] == [str(i) for i in range(700)]
    assert chat.format_trees(chat.as_tree(turns.filter("false"))).count() == 0


def test_quality_rules(docs, empty):
    got = sorted(rules.quality_rules(docs).collect(), key=lambda r: (key(r.doc_id), r.n_words))
    want = []
    for i, t, *_ in texts():
        t, seen, dup = t or "", set(), 0
        w = WORD.findall(t)
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    want.sort(key=lambda x: (key(x[0]), x[1]))
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == want
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    assert rules.quality_rules(empty).count() == 0


def test_sketch_quartiles(spark):
    rows = spark.range(1, 1001).select(F.lit("g").alias("g"), (F.col("id") / 100).alias("x"))
    q = rules.quartiles(rules.sketch(rows, ["g"], ("x",)), ["g"]).first()
    assert q["q1"] == pytest.approx(2.5, rel=0.02) and q["q3"] == pytest.approx(7.5, rel=0.02)


def test_classifier(spark, docs, empty):
    r = random.Random(2)
    clean = lambda: " ".join(r.choices(["the", "house", "stands", "near", "rivers", "and"], k=r.randint(10, 90))) + "."
    rows = [(i, clean() if i % 4 else " ".join(w.upper() + "$$!!" for w in clean().split())) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("label"))
    got = classifier.classify(table, labels, "doc_id % 3 <> 1").filter("doc_id % 3 = 1").collect()
    assert np.mean([(r.doc_id % 4 > 0) == r.predicted for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    for some in (labels, labels.filter("label = 1"), labels.filter("false"), labels.withColumn("label", F.lit(None).cast("int"))):
        scores = classifier.classify(docs, some).collect()
        assert len(scores) == len(texts()) and all(0 <= r.score <= 1 for r in scores)
    assert classifier.classify(empty, labels).count() == 0
    kept = classifier.keep_good(table, labels)
    assert kept.columns == table.columns and 280 <= kept.count() <= 320


def test_decontamination(spark, docs, empty):
    item = "If Anna buys 12 apples for 3 dollars each at the small market near the old bridge, how much does Anna pay in total?"
    moved = item.replace("Anna", "Peter").replace("12", "45").replace("3 dollars", "7 euros")
    torn = item.replace("Anna buys", "Peter buys").replace("does Anna", "does Maria")
    table = spark.createDataFrame([(1, "Well then. " + item + " Right."), (2, moved), (3, torn), (4, "nothing of the kind " * 20), (5, None), (6, ""), (2, moved), (None, item.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.kind) for r in decontaminate.contamination(table, bench).collect())
    assert got[:3] == [("1", 10, "verbatim"), ("2", 10, "reparameterised"), ("2", 10, "reparameterised")] and {g[0] for g in got} <= {"1", "2", "None"}
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.filter("false")).count() == 0


def test_decontamination_finds_an_item_at_any_place(spark):
    short = "seven brown foxes jump over two lazy dogs"
    long = "the farmer has red apples in his old barn and sells 25 of them at the market every week for very little money"
    docs = [(i, " ".join(["word"] * i + [short])) for i in range(8)]
    docs += [(10 + i, " ".join(["word"] * i + [long.replace("25", "twenty five")])) for i in range(8)]
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert of(got.collect(), "doc_id", "item_id") == [(i, 1) for i in range(8)] + [(10 + i, 2) for i in range(8)]


def test_decontamination_judges_each_occurrence(spark):
    item = "If Anna buys 12 apples for 3 dollars each at the small market near the old bridge, how much does Anna pay in total?"
    moved, other = item.replace("Anna", "Peter").replace("12", "45"), item.replace("Anna", "Maria").replace("12", "7")
    twice = "We saw 3 red apples for 5 dollars each on one side and 7 red apples for 9 dollars each on one side of the road"
    names = "When the old farmer asked Peter about the red barn near the river and the field behind the mill"
    filler = " and then nothing else of the kind was said. "
    docs = [(1, item + filler + moved), (2, moved + filler + item), (3, moved + filler + other), (4, moved + filler * 9 + "apples for 9 dollars each at the small market near the"),
            (5, twice), (6, names.replace("Peter about the", "Mary Ann about the")), (7, item.replace("Anna buys", "Peter buys").replace("does Anna", "does Maria"))]
    bench = spark.createDataFrame([(1, item), (2, twice), (3, names)], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    want = [(1, 1, "verbatim"), (2, 1, "verbatim"), (3, 1, "reparameterised"), (4, 1, "reparameterised"), (5, 2, "verbatim"), (6, 3, "reparameterised")]
    assert of(got.collect(), "doc_id", "item_id", "kind") == want


def test_decontamination_takes_all_kinds_of_items(spark):
    items = [(1, "What is the capital of France?"), (2, "What is 12 plus 30?"), (3, "Compute the sum of all odd numbers below 100 now"), (None, "name seven rivers that flow into the black sea today"),
             (5, "first text under a repeated id with enough words"), (5, "other text below a shared number with more words"), (6, "Bob and Tom and Ann and Lee met at noon near the mill"),
             (7, "minutes after the train left a man came by"), (8, "17 18 19 20 21 22 23 24 25 26")]
    docs = [(i, f"Here we ask, for once: please {text} And so on") for i, (_, text) in enumerate(items)] + [(20, "We waited 5 " + items[7][1]), (21, items[2][1]), (22, "of course what is 13 plus 31?"), (23, "17 18 19 20 21 22 23 24 25 27")]
    bench = spark.createDataFrame(items + items[:1] + [(9, None), (None, ""), (10, "?")], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    want = sorted([(i, str(item)) for i, (item, _) in enumerate(items)] + [(20, "7"), (21, "3")])
    assert sorted((r.doc_id, str(r.item_id)) for r in got.collect()) == want and got.filter("kind <> 'verbatim'").count() == 0


def test_main_text(spark):
    long = "This is the text of the article and it is long enough to be taken for one by the length of it, with the words that it needs. " * 2
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">{long}</div>
<article><h1>Big &amp; small</h1><p>{long}</p><p>Short one.<br>Second</p><script>var x = "</p>";</script><ul><li>A point</li></ul></article>
<aside>{long}</aside><div id="comments"><p>{long}</p></div><form><label>Name</label></form><footer>{long}</footer></body></html>"""
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>" + long), (5, None, "plain < text & more"), (1, "u", page), (6, "u", "<" * 5000), (7, "u", "<div>" * 3000 + long)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in pages.extract_main_text(table).collect()}
    clean = " ".join(long.split())
    assert got[1].text == f"Big & small {clean} Short one. Second A point" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == clean and got[7].text == clean
    assert pages.extract_main_text(table).count() == len(rows) and pages.extract_main_text(table.filter("false")).count() == 0


ARTICLE = ("<article><h1>Title of it</h1><p>The river runs through the town and it is known for the old bridge that was built by the people.</p>"
           "<p>It is one of the places in which a visitor can see how the mill was used at that time, not far from the station.</p></article>")
READER = "<div class='comments'><p>I think that this is the best of all the articles on the site and I will be back for more of it.</p></div>"


@pytest.mark.parametrize("wrapper", ["div class='page has-sidebar'", "div class='content no-sidebar'", "div class='hentry comments-open'", "div class='left-side'",
                                     "div id='search'", "form id='aspnetForm'", "div class='side'><div class='widget'", "section role='complementary'"])
def test_main_text_inside_a_wrapper_named_like_furniture(wrapper):
    page = f"<html><body><nav><a href='x'>Home</a></nav><{wrapper}>{ARTICLE}</div></form></section>{READER}<footer>All rights are reserved by the owner of the site</footer></body></html>"
    assert pages.main_text(page) == " ".join(re.findall(r"<(?:h1|p)>(.*?)</", ARTICLE))


def test_main_text_of_short_blocks_and_deep_pages():
    page = "<body><ul class=nav><li><a>Home</a></li></ul><p>The cat is on the mat.</p><p>It was there for a day.</p><div class=footer>All of the rights are ours</div></body>"
    assert pages.main_text(page) == "The cat is on the mat. It was there for a day."
    assert pages.main_text("<div class='side'>" * 30_000 + "x" + "</div>" * 30_000) == ""
    assert pages.main_text("<div class='comments'>" + "<p>" + "It is one of the longest of all. " * 20 + "</p></div>" + ARTICLE) == " ".join(re.findall(r"<(?:h1|p)>(.*?)</", ARTICLE))
