"""Fill-in-middle rewriting of whole texts.

A rolling hash cuts each text into chunks where its content says so, so texts that share a passage share its inner
chunks. A task keeps what it found out about a chunk (its code points, whether it holds a mark, its first and last bytes)
under the chunk's whole content; a later chunk of equal content takes that summary instead of being read again. The
summaries of a text's chunks, put side by side, give its length, tell whether a mark lies in it or across two chunks, and
find the chunk of each cut, so only the one or two chunks with a cut are decoded.

Everything happens where the row is: there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.llm.words import U64, byte_hashes, schema, slices, typed

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that decide on a cut, and the least and largest chunk; one place in CHUNK_EVERY is a cut.
WINDOW, LEAST, MOST, CHUNK_EVERY = 32, 256, 8192, 1024
#: Bytes hashed at once, and bytes of chunks a task remembers before it starts anew (this changes its speed only).
SEGMENT, MEMO_BYTES = 1 << 20, 32 << 20


class Summary(NamedTuple):
    points: int
    marked: bool
    head: bytes
    tail: bytes


class Memo:
    """Summaries of chunks by their whole content."""

    def __init__(self, marks: list[bytes], limit: int):
        self.marks, self.limit, self.reach = marks, limit, max(map(len, marks)) - 1
        self.held: dict[bytes, Summary] = {}
        self.size = self.hits = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.held.get(chunk)  # equal content, not only an equal hash
        if found:
            self.hits += 1
            return found
        found = Summary(len(decoded(chunk)), self.has_mark(chunk), chunk[: self.reach], chunk[-self.reach :])
        if self.size > self.limit:
            self.held.clear()
            self.size = 0
        self.held[chunk] = found
        self.size += len(chunk)
        return found

    def has_mark(self, raw: bytes) -> bool:
        return any(m in raw for m in self.marks)


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places before which the rolling hash of the last WINDOW bytes allows a cut; none is inside a code point."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data) - WINDOW + 1, SEGMENT):
        with np.errstate(over="ignore"):
            h = byte_hashes(data[at : at + SEGMENT + WINDOW - 1], WINDOW)
        found.append(np.flatnonzero(h % U64(CHUNK_EVERY) == 0) + at + WINDOW)
    places = np.concatenate(found)
    places = places[places < len(data)]
    return places[(data[places] & 0xC0) != 0x80]


def chunks(data: np.ndarray, start: int, end: int, places: np.ndarray) -> Iterator[tuple[int, int]]:
    """The chunks of the text data[start:end]; ``places`` are the cut places of all data."""
    places = places[np.searchsorted(places, start + WINDOW) : np.searchsorted(places, end)]
    at, i = start, 0
    while end - at > LEAST:
        i = max(i, int(np.searchsorted(places, at + LEAST)))
        to = int(places[i]) if i < len(places) else end
        if to - at > MOST:
            to = at + MOST
            while to > at + LEAST and (data[to] & 0xC0) == 0x80:
                to -= 1
        yield at, to
        at = to
    if at < end:
        yield at, end


class Outline:
    """A text as the counts of its chunks."""

    def __init__(self, parts: list[bytes], memo: Memo):
        known = [memo.of(part) for part in parts]
        self.parts, self.upto = parts, [0, *accumulate(k.points for k in known)]
        self.n = self.upto[-1]
        self.marked = any(k.marked for k in known)
        tail = b""
        for k in known:
            self.marked = self.marked or memo.has_mark(tail + k.head)
            tail = (tail + k.tail)[-memo.reach :]

    def cut(self, points: int) -> tuple[int, int]:
        """(chunk, bytes into it) of the place after so many code points."""
        if not points:
            return 0, 0
        i = bisect_left(self.upto, points) - 1
        inside = points - self.upto[i]
        if points == self.upto[i + 1]:
            return i, len(self.parts[i])
        return i, len(decoded(self.parts[i])[:inside].encode("utf-8", "surrogateescape"))

    def between(self, a: tuple[int, int], b: tuple[int, int]) -> bytes:
        if a[0] == b[0]:
            return self.parts[a[0]][a[1] : b[1]]
        return b"".join([self.parts[a[0]][a[1] :], *self.parts[a[0] + 1 : b[0]], self.parts[b[0]][: b[1]]])


def draws(doc_id: Column, seed: int) -> Column:
    """The first four 32-bit numbers of the digest of seed and id; a null id counts as the text ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS,
                   memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs`` (doc_id, text).

    Two draws from the id place two cuts among the n code points; they may meet or lie at an end. ``percent`` of the texts
    are rewritten, of those ``spm_percent`` with the suffix first (form ``spm``), the others with the prefix first
    (``psm``). A text that is empty or holds a mark stays as it is (``plain``, no cuts), so every output can be read back
    with ``restore``. A null text is empty. Rows with equal id and text get equal outputs, each its own row; a null id
    draws as the text ``null``. Texts of any length are handled chunk by chunk; other columns, whatever their names, stay out.
    """
    p, s, m = [x.encode() for x in marks]
    rows = typed(docs, doc_id="long", text="string").withColumn("draws", draws(F.col("doc_id"), seed))

    def run(batches):
        memo = Memo([p, s, m], memo_bytes)
        for batch in batches:
            for part, texts in slices(batch, limit=SEGMENT):
                places = cut_places(texts.data)
                out = []
                for i, (h1, h2, h3, h4) in enumerate(part.column("draws").to_pylist()):
                    a, b = int(texts.offs[i]), int(texts.offs[i + 1])
                    text = Outline([texts.data[x:y].tobytes() for x, y in chunks(texts.data, a, b, places)], memo)
                    n = text.n
                    if not n or text.marked or h3 % 100 >= percent:
                        out.append((n, "plain", None, None, texts.data[a:b].tobytes()))
                        continue
                    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
                    at, to = text.cut(x), text.cut(y)
                    prefix, middle, suffix = text.between((0, 0), at), text.between(at, to), text.between(to, (len(text.parts) - 1, len(text.parts[-1])))
                    form, whole = ("spm", s + suffix + p + prefix + m + middle) if h4 % 100 < spm_percent else ("psm", p + prefix + s + suffix + m + middle)
                    out.append((n, form, x, y - x, whole))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, schema(doc_id="long", n="long", form="string", prefix_chars="long", middle_chars="long", output="string"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an output was made of. No part holds a mark, so the first of each ends the part before it."""
    p, s, m = marks
    after = lambda column, n: F.substring(column, n + 1, 2**31 - 1)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = after(output, len(first))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
