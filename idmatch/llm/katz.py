"""A Katz back-off language model: counted, normalised and evaluated over partitioned n-gram tables.

A slab of texts asks for the counts of its distinct n-grams, whose keys are dealt into buckets (see ``packed``). Each
bucket adds up what the slabs say and answers them. So a frequent n-gram is one entry for each slab, and nothing whole
is held on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.llm.packed import dealt, pack, planes, record, shift_for, slabs, texts_of, unpack, unplanes
from idmatch.llm.words import U64, WORD_BASE, Texts, mix, schema, word_hashes, words
from idmatch.session import durable

#: Keys have so many bits: 1 in 10^5 of 10^12 n-grams shares its key with another.
BITS = 56
#: Counts up to this are discounted.
DISCOUNTED = 5
END, START = U64(0x1D8AF066), U64(0x2F3C5A11)


@dataclass
class Grams:
    """The n-grams that end at each token of a slab. ``keys[m]`` is that of order m + 1, ``past[m]`` its history's."""

    doc: np.ndarray
    keys: list[np.ndarray]
    past: list[np.ndarray]


def grams(texts: Texts, order: int) -> Grams:
    """Tokens are lower-cased (A-Z) words and an end for each text; histories reach back over ``order - 1`` starts."""
    texts = texts.lower()
    w = words(texts)
    count = w.count + 1
    doc = np.repeat(np.arange(texts.n), count)
    last = np.cumsum(count) - 1
    token = np.full(len(doc), END, U64)
    inner = np.ones(len(doc), bool)
    inner[last] = False
    token[inner] = word_hashes(texts, w)
    place = np.arange(len(doc)) - np.repeat(last - count + 1, count)
    short = lambda h, m: mix(h + U64(m)) >> U64(64 - BITS)
    keys, past, so_far = [short(token, 1)], [np.zeros(len(doc), U64)], token.copy()
    history, base = np.zeros(len(doc), U64), U64(1)
    for m in range(1, order):
        back = np.full(len(doc), START, U64)
        back[m:] = np.where(place[m:] >= m, token[:-m], START) if len(doc) > m else back[m:]
        history = history + back * base
        base = base * WORD_BASE
        so_far = history * WORD_BASE + token
        keys.append(short(mix(so_far), m + 1))
        past.append(short(mix(history), m + 100))
    return Grams(doc, keys, past)


def _requests(table: DataFrame, order: int, shift: int) -> DataFrame:
    """(bucket, slab, m, keys, times): the distinct n-grams of each slab, with their number in training texts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts, held = texts_of(row), np.array(row["held"], bool)
                g = grams(texts, order)
                train = ~held[g.doc]
                out = []
                for m in range(order):
                    own, inverse = np.unique(g.keys[m], return_inverse=True)
                    times = np.bincount(inverse, train, minlength=len(own)).astype(U64)
                    out += [(b, row["slab"], m, pack(own[i:j], b << shift), planes(times[i:j])) for b, i, j in dealt(own, shift)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                                 ["bucket", "slab", "m", "keys", "times"])

    return table.mapInArrow(run, schema(bucket="long", slab="long", m="int", keys="binary", times="binary"))


def _answers(requests: DataFrame, shift: int) -> DataFrame:
    """(bucket, slab, m, n, owned): the training counts of what each slab asked for, and which of them the slab is
    the first to have. Rows with slab -1 have, as n, how many n-grams of order m + 1 occur 1, 2, ... times, all
    their tokens, and how many there are."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        asked = group.to_pylist()
        asked.sort(key=lambda r: (r["m"], r["slab"]))
        for m in sorted({r["m"] for r in asked}):
            rows = [r for r in asked if r["m"] == m]
            keys = [unpack(r["keys"], r["bucket"] << shift) for r in rows]
            times = np.concatenate([unplanes(r["times"]) for r in rows]).astype(np.int64)
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, times, minlength=len(every)).astype(np.int64)
            here = np.flatnonzero(times > 0)
            first = np.zeros(len(times), bool)
            first[here[np.unique(inverse[here], return_index=True)[1]]] = True
            at = 0
            for r, k in zip(rows, keys, strict=True):
                span = slice(at, at + len(k))
                out.append((r["bucket"], r["slab"], m, planes(total[inverse[span]].astype(U64)), np.packbits(first[span]).tobytes()))
                at += len(k)
            seen = total[total > 0]
            tally = np.bincount(np.minimum(seen, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()
            out.append((rows[0]["bucket"], -1, m, planes(np.array([*tally, seen.sum(), len(seen)], U64)), b""))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                    ["bucket", "slab", "m", "n", "owned"])

    return requests.groupBy("bucket").applyInArrow(run, schema(bucket="long", slab="long", m="int", n="binary", owned="binary"))


def _totals(answers: DataFrame, order: int) -> np.ndarray:
    """Per order: how many n-grams occur 1 ... ``DISCOUNTED`` + 1 times, all tokens, distinct n-grams. Added up in Spark."""

    def run(batches):
        for batch in batches:
            out = np.zeros((order, DISCOUNTED + 3), np.int64)
            for m, n in zip(batch.column("m").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out[m] += unplanes(n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(order), DISCOUNTED + 3)), pa.array(np.tile(np.arange(DISCOUNTED + 3), order)), pa.array(out.ravel())], ["m", "r", "n"])

    found = answers.filter("slab = -1").mapInArrow(run, schema(m="long", r="long", n="long")).groupBy("m", "r").agg(F.sum("n").alias("n"))
    out = np.zeros((order, DISCOUNTED + 3), np.int64)
    for r in found.collect():  # order * (DISCOUNTED + 3) rows
        out[r.m, r.r] = r.n
    return out


def discounts(tally: np.ndarray, k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts d[r] for counts r up to ``k`` (1 beyond), from how many n-grams occur 1 ... k + 1 times.

    Where the counts of counts give no discount between 0 and 1, the count loses n1 / (n1 + 2 n2) instead.
    """
    n = np.concatenate([[0], tally[: k + 1]]).astype(float)
    out = np.ones(k + 2)
    lost = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    lost = min(max(lost, 0.05), 0.95)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - lost) / r
    return out


@dataclass
class Model:
    """What a task needs besides counts: discounts per order, tokens and words of the training texts, and their number."""

    order: int
    d: list[np.ndarray]
    tokens: int
    vocabulary: int
    texts: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))

    def discounted(self, m: int, c: np.ndarray) -> np.ndarray:
        return self.d[m][np.minimum(c, DISCOUNTED + 1)] * c


def _scored(joined: DataFrame, model: Model, shift: int) -> DataFrame:
    """Per slab: a row of kind 0 with what is known of its documents; rows of kind 1 with what its n-grams add to their
    histories (mass given to seen words, and what the lower order gives those); rows of kind 2 with the histories whose
    back-off weights its documents need, and how often."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts, held = texts_of(row), np.array(row["held"], bool)
                g = grams(texts, model.order)
                n_docs = texts.n
                answers: dict[int, list] = {m: [] for m in range(model.order)}
                for a in row["answers"]:
                    answers[a["m"]].append((a["bucket"], a["n"], a["owned"]))
                count, own, owned = [], [], []
                for m in range(model.order):
                    keys, inverse = np.unique(g.keys[m], return_inverse=True)
                    parts = sorted(answers[m])
                    n = [unplanes(x[1]).astype(np.int64) for x in parts]
                    total = np.concatenate(n) if n else np.zeros(0, np.int64)
                    mine = np.concatenate([np.unpackbits(np.frombuffer(x[2], np.uint8), count=len(y)) for x, y in zip(parts, n, strict=True)]) if n else total
                    if len(total) != len(keys):
                        raise ValueError(f"slab {row['slab']} has {len(keys)} n-grams of order {m + 1} and {len(total)} answers")
                    count.append(total[inverse])
                    own.append(np.unique(inverse, return_index=True)[1])
                    owned.append(mine.astype(bool))
                c1 = count[0]
                p = [model.base(c1)]
                context = []
                place = np.arange(len(g.doc)) - np.searchsorted(g.doc, g.doc)
                for m in range(1, model.order):
                    # a history of m words occurs as often as the n-gram of its words; one of starts alone, once a text
                    before = np.zeros(len(g.doc), np.int64)
                    before[1:] = count[m - 1][:-1]
                    past = np.where(place == 0, model.texts, before)
                    context.append(past)
                    p.append(np.where(count[m] > 0, model.discounted(m, count[m]) / np.maximum(past, 1), 0.0))
                known = np.zeros(len(g.doc))
                open_ = np.ones(len(g.doc), bool)
                needs = []
                for m in range(model.order - 1, 0, -1):
                    seen = open_ & (count[m] > 0)
                    known[seen] = np.log10(p[m][seen])
                    open_ &= ~seen
                    back = open_ & (context[m - 1] > 0)
                    needs.append((g.past[m][back], g.doc[back]))
                known[open_] = np.log10(p[0][open_])
                per_doc = lambda v: np.bincount(g.doc, v, minlength=n_docs)
                out = [(0, 0, row["slab"], b"", b"", b"", None)]
                facts = [{"doc_id": i, "held_out": h, "n_tokens": int(t), "n_known": int(k), "base_score": float(b), "score": float(s)}
                         for i, h, t, k, b, s in zip(row["doc_id"], held.tolist(), per_doc(None), per_doc(c1 > 0), per_doc(np.log10(p[0])), per_doc(known), strict=True)]
                out[0] = (*out[0][:6], facts)
                for m in range(1, model.order):
                    first = own[m][owned[m]]
                    keys, inverse = np.unique(g.past[m][first], return_inverse=True)
                    given = np.bincount(inverse, p[m][first], minlength=len(keys))
                    lower = np.bincount(inverse, p[m - 1][first], minlength=len(keys))
                    out += [(1, b, row["slab"], pack(keys[i:j], b << shift), given[i:j].tobytes(), lower[i:j].tobytes(), None) for b, i, j in dealt(keys, shift)]
                asked = np.concatenate([x[0] for x in needs]) if needs else np.zeros(0, U64)
                by = np.concatenate([x[1] for x in needs]) if needs else np.zeros(0, np.int64)
                order = np.lexsort((by, asked))
                asked, by = asked[order], by[order]
                out += [(2, b, row["slab"], pack(asked[i:j], b << shift), planes(by[i:j].astype(U64)), b"", None) for b, i, j in dealt(asked, shift)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(
                    (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), FACTS_ARROW))], ["kind", "bucket", "slab", "keys", "x", "y", "facts"])

    return joined.mapInArrow(run, schema(kind="int", bucket="long", slab="long", keys="binary", x="binary", y="binary", facts=FACTS))


FACTS = "array<struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,n_known:bigint,base_score:double,score:double>>"
FACTS_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))


def _backed_off(parts: DataFrame, shift: int) -> DataFrame:
    """(slab, at, back): the logarithms of back-off weights that each document needs, added up.

    A history's weight is what its seen words leave of its mass, over what the lower order leaves of its own: exactly
    normalised, as every seen word of the history is counted in the history's bucket once.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: (r["kind"], r["slab"]))
        given = [r for r in rows if r["kind"] == 1]
        keys = np.concatenate([unpack(r["keys"], r["bucket"] << shift) for r in given]) if given else np.zeros(0, U64)
        every, inverse = np.unique(keys, return_inverse=True)
        total = lambda c: np.bincount(inverse, np.concatenate([np.frombuffer(r[c]) for r in given]) if given else None, minlength=len(every))
        weight = np.log10(np.maximum(1 - total("x"), 1e-9) / np.maximum(1 - total("y"), 1e-9)) if given else np.zeros(0)
        slab, at, back = [], [], []
        for r in rows:
            if r["kind"] == 2:
                asked, doc = unpack(r["keys"], r["bucket"] << shift), unplanes(r["x"]).astype(np.int64)
                where = np.minimum(np.searchsorted(every, asked), max(len(every) - 1, 0))
                value = np.where(every[where] == asked, weight[where], 0.0) if len(every) else np.zeros(len(asked))
                docs, index = np.unique(doc, return_inverse=True)
                slab += [r["slab"]] * len(docs)
                at += docs.tolist()
                back += np.bincount(index, value).tolist()
        return pa.Table.from_arrays([pa.array(slab, pa.int64()), pa.array(at, pa.int32()), pa.array(back, pa.float64())], ["slab", "at", "back"])

    found = parts.filter("kind > 0").select("kind", "bucket", "slab", "keys", "x", "y").groupBy("bucket").applyInArrow(run, schema(slab="long", at="int", back="double"))
    return found.groupBy("slab", "at").agg(F.sum("back").alias("back"))


def katz_scores(docs: DataFrame, held: str, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Documents for which the SQL condition ``held`` does not hold train the model. ``score`` is the log10 probability of the
    whole text: a token takes the discounted relative frequency of the longest n-gram seen in training, and for each longer
    history that was seen without it that history's back-off weight. Below bigrams stand words with half a count added,
    one unknown word among them, which is also ``base_score``.

    Null and empty texts have one token, their end; repeated rows each count and each get a row. Without training rows all
    tokens are the unknown word. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held), F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    table = slabs(rows)
    shift = shift_for(table, BITS)
    texts = table.agg(F.sum(F.expr("aggregate(held, 0L, (a, h) -> a + IF(h, 0L, 1L))")).alias("n")).first().n or 0
    answers = durable(_answers(_requests(table, order, shift), shift))
    totals = _totals(answers, order)
    model = Model(order, [discounts(t) for t in totals], int(totals[0, -2]), int(totals[0, -1]), int(texts))
    given = answers.filter("slab >= 0").groupBy("slab").agg(F.collect_list(F.struct("bucket", "m", "n", "owned")).alias("answers"))
    parts = durable(_scored(table.join(given, "slab"), model, shift))
    back = _backed_off(parts, shift)
    known = parts.filter("kind = 0").select("slab", F.posexplode("facts").alias("at", "f")).select("slab", "at", "f.*")
    return known.join(back, ["slab", "at"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("back", F.lit(0.0))).alias("score"))
