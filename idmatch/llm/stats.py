"""Counts of whole texts that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np

from idmatch.llm.words import U64, Texts, covered, mix, repeated, span_hashes, whole, window_hashes, word_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(b"!?.,;:\"'()-_/\\=+@[]{}~`^")] = True
REPEAT_WORDS = 8


def by_text(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)


def line_counts(texts: Texts, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line, for each text."""
    edge = np.concatenate([texts.offs, np.flatnonzero(texts.data == 10) + 1])
    begin = np.unique(edge[edge < len(texts.data)])
    end = np.append(begin[1:], len(texts.data))
    end = end - ((end > begin) & (texts.data[end - 1] == 10))
    has = np.searchsorted(start, end) > np.searchsorted(start, begin)
    begin, end = begin[has], end[has]
    doc = np.searchsorted(texts.offs, begin, "right") - 1
    key = mix(span_hashes(texts.data, begin, end) ^ mix(doc.astype(U64)))
    twice = repeated(key)
    _, keep = np.unique(key[twice], return_index=True)
    extra = by_text(doc[twice], texts.n) - by_text(doc[twice][keep], texts.n)
    return by_text(doc, texts.n), extra


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """Counts per text, as long arrays."""
    w = words(texts)
    data, n = texts.data, texts.n
    point = (data & 0xC0) != 0x80
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    solid = np.cumsum(solid[:-1], dtype=np.int8) > 0
    hashes = word_hashes(texts, w)
    keyed = mix(hashes ^ mix(w.doc.astype(U64) + U64(1)))
    windows = window_hashes(keyed, REPEAT_WORDS)
    inside = np.flatnonzero(whole(w, REPEAT_WORDS))
    again = inside[repeated(windows[inside])]
    spread = np.sort((w.doc.astype(U64) << U64(40)) | (hashes >> U64(24)))
    fresh = np.ones(len(spread), bool)
    fresh[1:] = spread[1:] != spread[:-1]
    lines, dup = line_counts(texts, w.first, w.start)
    size = w.end - w.start
    return {
        "n_words": w.count,
        "word_chars": texts.per_text(point & solid),
        "n_symbols": texts.per_text(SYMBOL[data]),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": by_text(w.doc[covered(again, REPEAT_WORDS, len(w.doc))], n),
        "n_upper": texts.per_text(UPPER[data]),
        "n_digits": texts.per_text(DIGIT[data]),
        "n_punct": texts.per_text(PUNCT[data]),
        "n_bangs": texts.per_text(data == 33),
        "n_distinct": by_text((spread[fresh] >> U64(40)).astype(np.int64), n),
        "n_stuck": by_text(w.doc[1:][(w.doc[1:] == w.doc[:-1]) & (hashes[1:] == hashes[:-1])], n),
        "n_short": by_text(w.doc[size <= 3], n),
        "n_chars_all": texts.per_text(point),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct",
         "n_bangs", "n_distinct", "n_stuck", "n_short", "n_chars_all")
