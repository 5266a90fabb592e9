"""Fill-in-middle, packing and hard negatives against brute force and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from idmatch.llm import fim, negatives, packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    draw = random.Random(5)
    shared = "".join(draw.choice("abcdefghij öß中😀\n") for _ in range(9000))
    mark_at_edges = ["x" * n + "<P>" + "y" * 300 for n in (253, 254, 255, 256, 257)] + ["z" * n + "<M>" for n in range(254, 259)]
    return [None, "", "a", "<P", "ab<S>c", "<", " \n\t", "ö" * 3, "<P><S>", "x<", "x<S", shared, shared, "new start " + shared, shared[:4000] + " other " + shared[4000:],
            "a" * 40_000, "€" * 30_000, "word " * 300_000, *mark_at_edges, "Aa's don't I'LL 12 'S", "<|endoftext|> A<|EndOfText|>b", "T̈x... KK İ!?", "ẹ́.", "…!! (x).” ½, ²;", "\x1c\x85 a"]


def documents(spark, texts, copies=1):
    rows = [(i if i % 7 else None, t, "en", i) for i, t in enumerate(texts)] * copies
    return spark.createDataFrame(rows, "doc_id long, text string, form string, ids long")


def by_hand(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(text)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("memo_bytes", [fim.MEMO_BYTES, 500])
def test_fill_in_middle_is_what_whole_texts_give(spark, memo_bytes):
    docs = documents(spark, odd_texts() * 4, copies=2)
    done = fim.fill_in_middle(docs, memo_bytes=memo_bytes).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done], key=key)
    assert got == sorted([(d.doc_id, *by_hand(d.doc_id, d.text)) for d in docs.collect()], key=key)
    assert sorted(r.back for r in done) == sorted(d.text or "" for d in docs.collect())
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_fill_in_middle_shares_chunks_and_takes_an_empty_table(spark):
    data = [np.frombuffer(t.encode(), np.uint8) for t in ("".join(random.Random(3).choices("abcdef gh", k=30_000)),)]
    data.append(np.concatenate([np.frombuffer(b"something before ", np.uint8), data[0]]))
    memo = fim.Memo([m.encode() for m in fim.MARKS], 1 << 20)
    for d in data:
        fim.Outline([d[a:b].tobytes() for a, b in fim.chunks(d, 0, len(d), fim.cut_places(d))], memo)
    assert memo.hits > 10
    assert fim.fill_in_middle(documents(spark, ["a"]).limit(0)).count() == 0


def test_restore_of_parts_that_end_like_a_mark(spark):
    parts = [("a<", "b<S", "<M"), ("<P", "", "<"), ("", "", ""), ("S>", "P>", "M>")]
    rows = [(f"<P>{p}<S>{s}<M>{m}", "psm", p + m + s) for p, m, s in parts] + [(f"<S>{s}<P>{p}<M>{m}", "spm", p + m + s) for p, m, s in parts]
    done = spark.createDataFrame(rows, "output string, form string, want string").withColumn("got", fim.restore(F.col("output"), F.col("form"))).collect()
    assert [r.got for r in done] == [r.want for r in done]


def check_packing(rows, docs, size):
    model = tokenizers.Tokenizer.from_file(TOKENS)
    want = sorted((-1 if d.doc_id is None else d.doc_id, model.encode(d.text or "", add_special_tokens=False).ids + [1]) for d in docs.collect())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, ids in want:  # repeated ids: every document finds its pieces, and no piece is left over
        at = 0
        while at < len(ids):
            r = next(r for r in by_doc[doc_id] if r.start == at and r.doc_tokens == len(ids)
                     and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            by_doc[doc_id].remove(r)
            at += r.length
    assert not any(by_doc.values())
    lengths = []
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        lengths.append(at)
    assert max(lengths) <= size
    return lengths


@pytest.mark.parametrize("size,group", [(2048, packing.GROUP_TOKENS), (64, 2000)])
def test_packing_places_every_id_once(spark, size, group):
    docs = documents(spark, odd_texts() + [f"number {i} " * (i % 90) for i in range(300)], copies=2)
    packed = packing.pack(docs, TOKENS, keep_ids=True, size=size, group_tokens=group)
    lengths = check_packing(packed.collect(), docs, size)
    assert sum(lengths) > 0.98 * size * len(lengths)
    whole = packing.sequences(packed).collect()
    assert sorted(len(r.ids) // 4 for r in whole) == sorted(lengths) == sorted(r.length for r in whole)


def test_packing_of_nothing_and_of_one_empty_text(spark):
    assert packing.pack(documents(spark, ["a"]).limit(0), TOKENS).count() == 0
    row = packing.pack(documents(spark, [None]), TOKENS).collect()
    assert [(r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in row] == [(0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0)]


def test_words_found_again_have_the_ids_of_the_whole_text():
    encoder, model = packing.Encoder(TOKENS), tokenizers.Tokenizer.from_file(TOKENS)
    texts = [t or "" for t in odd_texts()] + ["x" * 300 + "! " + "Y" * 300] + ["don't Don'T ('s) 's! DON'T. a.b.c x-y-z z9,a 9a9 (9)."] * 2
    assert encoder.ids([t.encode() for t in texts]) == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_differencing_evens_out():
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 700, 400)
    window = packing.differencing(sizes, 40)
    load = np.bincount(window, sizes, minlength=40)
    assert load.max() - load.min() <= 4
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2).tolist().count(0) in (2, 3)
    assert set(np.bincount(packing.windows(np.array([60, 60, 60]), 100), [60, 60, 60])) == {60}


def brute_negatives(rows, every=100, positives=5, negatives_=10):
    kept = [(i, v, l, np.floor(np.array(x, float) * 256)) for i, (v, l, x) in enumerate(rows)
            if l is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, v, l, x in kept:
        if v is None or v % every:
            continue
        score = [(-int(y @ x), 2**63 if w is None else w, j, m) for j, w, m, y in kept if j != i and len(y) == len(x)]
        own = sorted(s for s in score if s[3] == l)[:positives]
        for p in own:
            fit = sorted(s for s in score if s[3] != l and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:negatives_]
            real = lambda w: None if w == 2**63 else w
            out += [(v, real(p[1]), k, real(n[1]), -p[0], -n[0]) for k, n in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("width", [3, 64, 130])
def test_hard_negatives_are_those_of_brute_force(spark, width):
    draw = np.random.default_rng(width)
    middle = draw.normal(size=(4, width))
    rows = [(i, i % 4, (middle[draw.integers(4)] + draw.normal(size=width) * 0.7).tolist()) for i in range(500)]
    rows += rows[100:101] * 3 + rows[7:9] * 2  # repeated rows, an anchor among them
    rows += [(600, None, [1.0] * width), (601, 1, None), (602, 2, [float("nan")] * width), (603, 2, [None] * width), (604, 3, []), (605, 1, [float("inf")] + [0.0] * (width - 1)),
             (700, 1, [1.0, 2.0]), (701, 1, [1.0, 1.5]), (702, 2, [1.0, 1.0]), (703, 2, [0.0, 0.0]), (800, 2, [0.0] * width), (None, 1, rows[0][2]), (-100, 0, rows[4][2])]
    table = spark.createDataFrame([(v, l, x, 1, "x") for v, l, x in rows], "vec_id long, label int, v array<double>, id int, row string").repartition(5)
    done = negatives.hard_negatives(table, block=64, row_blocks=(1, 3), anchor_group=(4, 8)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in done), key=key) == sorted(brute_negatives(rows), key=key)


def test_hard_negatives_of_few_or_far_values(spark):
    kind = "vec_id long, label int, v array<double>"
    assert negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], kind)).count() == 0
    rows = [(0, 1, [1e300, 1.0]), (1, 1, [1e200, 0.0]), (2, 2, [-1e300, 1.0]), (3, 2, [1e18, 0.0])]
    assert all(r.negative_score <= r.positive_score for r in negatives.hard_negatives(spark.createDataFrame(rows, kind)).collect())


def test_intervals_hold_and_narrow():
    draw = np.random.default_rng(1)
    x = negatives.np.floor(draw.normal(size=(2000, 64)) * 256).astype(np.int64)
    codes, seen = negatives.Codes.of(x), []
    for q in x[:20]:
        score = x @ q

        def wanted(low, high, score=score):
            if len(low) == len(score):
                assert (low <= score).all() and (score <= high).all()
            seen.append(float(np.median(high - low)))
            return np.ones(len(low), bool)

        negatives.Asked.all_of(q[None, :])[0].narrow(codes, wanted)
    layers = np.array(seen).reshape(20, len(negatives.TESTED)).mean(axis=0)
    assert (layers[1:] < 0.5 * layers[:-1]).all()
