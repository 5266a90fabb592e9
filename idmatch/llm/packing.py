"""Token sequences of one length from documents, packed by multiway differencing.

Each text becomes token ids where its row is; words seen before are not encoded again. The ids are cut into pieces: whole
sequences, the tail, and for one document in FINE the tail in halves down to single ids, which later even out the
sums. Pieces are dealt at random to groups of about GROUP_TOKENS; a group starts with the least number of windows its tails
could fill and joins partial partitions with opposing imbalances (Karmarkar-Karp); while a window is above the capacity,
it takes more windows. No group depends on another, whatever the order, source or length of the documents.
"""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.llm.words import SPACE, schema, slices, typed
from idmatch.session import durable

SEQUENCE, END = 2048, 1
#: One document in so many has its tail cut fine.
FINE = 5
#: Tokens of tails in a group, about; tails below one SMALL-th of a sequence are joined to about twice that before they are
#: dealt out.
GROUP_TOKENS, SMALL = 1 << 20, 80
#: Text bytes taken at once, and words that a task remembers with their ids before it starts anew (speed only).
SLICE, MEMO_WORDS, MEMO_WORD_BYTES = 1 << 20, 1_000_000, 64
#: Marks that end words, and words encoded together.
MARKS, RUN = b".,;:!?)]}\"*#$%&", 400


class Encoder:
    """Ids of texts. The tokenizer drops white space, and none of its tokens or rules reaches across an ASCII space, so a
    text's ids are those of its words one after the other; nor does one reach from a letter or digit to the marks that end
    a word, and plain capitals count as small letters, so words that differ in those only share what was found out."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model, self.words, self.stems = Tokenizer.from_file(path), {}, {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > MEMO_WORDS:
            self.words, self.stems = {}, {}
        held, stems, long = self.words, self.stems, {}
        lists = [t.split() for t in texts]
        known = [list(map(held.get, words)) for words in lists]
        new = set()
        for words, values in zip(lists, known, strict=True):
            new.update([w for w, v in zip(words, values, strict=True) if v is None])
        parted = {w: stem(w) for w in new}
        self.learn({part for parts in parted.values() for part in parts if part and part not in stems})
        for word, (body, marks) in parted.items():
            (held if len(word) <= MEMO_WORD_BYTES else long)[word] = stems[body] + stems[marks] if marks else stems[body]
        for part in [s for s in stems if len(s) > MEMO_WORD_BYTES] if long else []:
            del stems[part]
        of = lambda w: long[w] if w in long else held[w]
        return [b"".join([of(w) if v is None else v for w, v in zip(words, values, strict=True)]) for words, values in zip(lists, known, strict=True)]

    def learn(self, parts: set[bytes]) -> None:
        """Ids of some hundred words at once, told apart by where their tokens begin."""
        parts = list(parts)
        runs = [[w.decode("utf-8", "replace") for w in parts[at : at + RUN]] for at in range(0, len(parts), RUN)]
        for at in range(0, len(runs), 64):
            found = self.model.encode_batch([" ".join(run) for run in runs[at : at + 64]], add_special_tokens=False)
            for i, encoding in enumerate(found, at):
                run = runs[i]
                start = np.cumsum([0] + [len(w) + 1 for w in run[:-1]])
                first = np.array([a for a, _ in encoding.offsets], np.int64)
                edge = 4 * np.searchsorted(first, np.append(start, np.iinfo(np.int64).max))
                raw = np.array(encoding.ids, "<u4").tobytes()
                self.stems.update((w, raw[a:b]) for w, a, b in zip(parts[i * RUN : (i + 1) * RUN], edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def stem(word: bytes) -> tuple[bytes, bytes]:
    """A word as its body and the marks that end it; whole where the two might be one token."""
    if b"<|" in word:
        return word, b""
    low = word.lower() if word.isascii() else word
    body = low.rstrip(MARKS)
    if not body or not (body[-1:].isalnum() if body[-1] < 128 else normalize("NFC", body[-4:].decode("utf-8", "ignore")[-1:]).lower()[-1:].isalpha()):
        return low, b""
    return body, low[len(body) :]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def stretches(data: np.ndarray) -> Iterator[bytes]:
    """A text in runs of about SLICE bytes that end before white space."""
    at = 0
    while at < len(data):
        to = at + SLICE
        while to < len(data):
            gap = np.flatnonzero(SPACE[data[to : to + SLICE]])
            if len(gap):
                to += int(gap[0])
                break
            to += SLICE
        yield data[at:to].tobytes()
        at = to


def cuts(n: int, fine: bool, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids."""
    tail = n - n % size
    out = [(a, a + size) for a in range(0, tail, size)]
    while fine and n - tail > 1:
        out.append((tail, tail + (n - tail + 1) // 2))
        tail = out[-1][1]
    return out + [(tail, n)] * (tail < n)


def pieces(docs: DataFrame, path: str, keep_ids: bool = False, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, fine, ids_crc32, doc_tokens[, ids]), written once."""
    rows = typed(docs, doc_id="long", text="string")
    kinds = {"doc_id": pa.int64(), "piece": pa.int64(), "start": pa.int64(), "length": pa.int64(), "fine": pa.bool_(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
    out = schema(doc_id="long", piece="long", start="long", length="long", fine="boolean", ids_crc32="long", doc_tokens="long")
    if keep_ids:
        kinds["ids"] = pa.binary()
        out.add("ids", "binary")
    end = struct.pack("<I", END)

    def run(batches):
        encoder, task, done = encoder_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, texts in slices(batch, limit=SLICE):
                if texts.n == 1:
                    found = [b"".join(encoder.ids([run])[0] for run in stretches(texts.data))]
                else:
                    found = encoder.ids([texts.data[a:b].tobytes() for a, b in zip(texts.offs[:-1], texts.offs[1:], strict=True)])
                made = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    ids += end
                    n = len(ids) // 4
                    for a, b in cuts(n, zlib.crc32(ids) % FINE == 0, size):
                        raw = ids[4 * a : 4 * b]
                        made.append((doc_id, (task << 36) + done, a, b - a, b - a < size and (a % size > 0 or b < n), zlib.crc32(raw), n, raw)[: len(kinds)])
                        done += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds.values())], list(kinds))

    return durable(rows.mapInArrow(run, out))


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, of each item: again and again the two partial partitions with the largest spread are joined,
    the fullest windows of one with the emptiest of the other, and what all windows have in common is forgotten."""
    parts = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    if k == 1:
        return np.zeros(len(sizes), np.int64)
    heapq.heapify(parts)
    joined, n = [], len(sizes)
    while len(parts) > 1:
        _, _, load, root = heapq.heappop(parts)
        _, _, load2, root2 = heapq.heappop(parts)
        over = len(load) + len(load2) - k
        if over > 0:  # the last of one meets the last of the other
            a, b = slice(len(load) - over, None), slice(len(load2) - over, None)
            joined.append((root[a], root2[b][::-1]))
            load = np.concatenate([load[: len(load) - over], load[a] + load2[b][::-1], load2[: len(load2) - over]])
            root = np.concatenate([root, root2[: len(load2) - over]])
        else:
            load, root = np.concatenate([load, load2]), np.concatenate([root, root2])
        order = np.argsort(-load, kind="stable")
        load, root = load[order], root[order]
        if len(load) == k:
            load = load - load[-1]
        heapq.heappush(parts, (-int(load[0]), n, load, root))
        n += 1
    window = np.zeros(len(sizes), np.int64)
    root = parts[0][3]
    window[root] = np.arange(len(root))
    for kept, gone in reversed(joined):
        window[gone] = window[kept]
    return window


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none above the capacity: the least number of windows, and more while one is too full."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, min(k, len(sizes)))
        if np.bincount(found, sizes).max() <= capacity:
            return found
        k += max(1, k // 512)


def placed(length: np.ndarray, fine: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of a group's pieces."""
    window, order = np.zeros(len(length), np.int64), np.argsort(length, kind="stable")
    full = order[length[order] == size]
    window[full] = np.arange(len(full))
    rest = order[length[order] < size]
    if len(rest):
        least = size // SMALL
        small = (length[rest] < least) & ~fine[rest]
        bundle = np.zeros(len(rest), np.int64)
        bundle[small] = (np.cumsum(length[rest][small]) - 1) // max(1, 2 * least)
        _, bundle[small] = np.unique(bundle[small], return_inverse=True)
        bundle[~small] = np.arange(int((~small).sum())) + (bundle[small].max() + 1 if small.any() else 0)
        window[rest] = windows(np.bincount(bundle, length[rest]).astype(np.int64), size)[bundle] + len(full)
    by = np.lexsort((np.arange(len(length)), window))
    upto = np.cumsum(length[by]) - length[by]
    first = np.searchsorted(window[by], window[by])
    offset = np.empty(len(length), np.int64)
    offset[by] = upto - upto[first]
    return window, offset


def pack(docs: DataFrame, path: str, keep_ids: bool = False, size: int = SEQUENCE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): a row for each piece of each document.

    ``path`` is a tokenizer file that every executor has. A document is its ids and the end id (``END``), so an empty or
    null text is one id. Repeated rows are packed as often as they occur; a null id stays null. A text of any length is
    encoded run by run and cut into whole sequences and a tail. Sequences hold at most ``size`` ids and are near-equal
    within a group; in all they waste less than a window a group, beyond the windows that the capacity forces. Pieces
    that tie in length keep the order in which the tasks made them. Other columns, whatever their names, stay out.
    """
    made = pieces(docs, path, keep_ids, size)
    tokens = made.agg(F.sum(F.when(F.col("length") < size, F.col("length")).otherwise(F.lit(size // 64)))).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    dealt = made.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    names = [c for c in made.columns if c not in ("piece", "fine")]
    out = schema(**{c: made.schema[c].dataType.simpleString() for c in names}, sequence_id="long", offset="long")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        window, offset = placed(group.column("length").to_numpy(), group.column("fine").to_numpy(zero_copy_only=False), size)
        return group.select(names).append_column("sequence_id", pa.array((group.column("group")[0].as_py() << 32) + window)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(run, out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): whole sequences, as little-endian unsigned 32-bit ids, of ``pack(..., keep_ids=True)``."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit("").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
