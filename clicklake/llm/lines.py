"""Statistics of lines of text, counted over whole batches of documents at once.

The texts of a batch are one array of code points; classes of characters come from a table, and sums over lines, words and
tokens are differences of running sums. No text is visited character by character in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np

U = np.uint64
#: Lines above this many characters are measured in pieces, cut before the first token past each multiple.
PIECE = 160
LETTER, WORD, DIGIT, UPPER, BLANK, BREAK, ODD, END = (1 << i for i in range(8))
_HARD, _TAG, _STOP, _COMMA, _CLOSER, _OPEN = (1 << i for i in range(6))
_BASE = 0x9E3779B97F4A7C15
#: Bins of each statistic: `codes` has one of so many values in each column.
BINS = {
    "words": 7, "familiar": 7, "digits": 6, "odd": 6, "capitals": 6, "first": 7, "last": 7, "cells": 6, "longest": 6, "word_length": 6, "tags": 5, "seen": 7, "letters": 6, "stops": 4, "stray": 4, "like_before": 3, "mixed": 4, "commas": 5,
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: classes of characters, marks that matter to lines, and the lower-case code point."""
    kinds, marks, lower = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE01F0)]:
        s = chr(c)
        k = unicodedata.category(s)
        if k[0] == "L":
            kinds[c] = LETTER | WORD | (UPPER if k == "Lu" else 0)
            low = s.lower()
            if len(low) == 1 and low != s:
                lower[c] = ord(low)
        elif k[0] == "M":
            kinds[c] = WORD
        elif k == "Nd":
            kinds[c] = DIGIT
        elif k[0] == "Z" or s.isspace():
            kinds[c] = BLANK
        elif k[0] in "SC" or k in ("Po", "Pd", "Pc", "Ps", "Pe", "Pi", "Pf"):
            kinds[c] = ODD
    for s in "'’-":
        kinds[ord(s)] |= WORD
    for s in ".,;:!?'\"()-–—»«„“”’%&/…|":
        kinds[ord(s)] &= ~ODD & 255
    for s in "\r\n":
        kinds[ord(s)] |= BREAK
    for s in ".!?…:":
        kinds[ord(s)] |= END
    for s, m in (("\t|;", _HARD), ("<>{}[]=", _TAG), (".!?", _STOP), (",", _COMMA), ("\"'”’»«)]", _CLOSER), ("-–—*•·+>", _OPEN)):
        for x in s:
            marks[ord(x)] |= m
    return kinds, marks, lower


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the hashes' base and of its inverse modulo 2^64, as many as the longest batch so far needs."""

    up = down = np.ones(1, U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(2 * n, base, U)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of lower-case words, as `measure` hashes those of a text."""
    mask = (1 << 64) - 1
    out = [sum((ord(c) + 1) * pow(_BASE, i, 1 << 64) for i, c in enumerate(w)) & mask for w in words]
    return np.unique(_mix(np.array(out, U)))


@dataclass
class Lines:
    """Of a batch of texts: `doc` and codes of each line, its characters other than blanks, and sums over each text."""

    doc: np.ndarray
    codes: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    word_chars: np.ndarray
    common: np.ndarray
    solid: np.ndarray
    symbols: np.ndarray
    lines: np.ndarray
    ended: np.ndarray


def _sums(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=out[1:])
    return out


def _bin(x: np.ndarray, *edges: float) -> np.ndarray:
    """0 for values up to the first edge, and so on."""
    return np.searchsorted(np.array(edges), x, side="left").astype(np.uint8)


def measure(texts: list[str], common: np.ndarray, familiar: np.ndarray) -> Lines:
    """Statistics of the texts' lines; `common` and `familiar` are hashes of words.

    Lines end at CR and LF, those of blanks alone are none. A word starts with a letter and goes on over letters, marks,
    hyphens and apostrophes.
    """
    kinds, marks, lower = _tables()
    n_docs = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(code)
    doc_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    kind, mark = kinds[code], marks[code]
    solid = (kind & BLANK) == 0
    n_solid = _sums(solid)

    # tokens: runs without blanks; units: lines, or pieces of them, each from a token's start to the next unit's
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if size and solid[0]:
        edge = np.concatenate([[0], edge])
    tok, tok_end = edge[0::2], edge[1::2]  # the last character is a line end, so every token ends
    breaks = _sums((kind & BREAK) != 0)
    line_of = breaks[tok]
    head = np.ones(len(tok), bool)
    head[1:] = line_of[1:] != line_of[:-1]
    line_at = tok[head][np.cumsum(head) - 1] if len(tok) else tok
    piece = (tok - line_at) // PIECE
    start = head.copy()
    start[1:] |= piece[1:] != piece[:-1]
    a = tok[start]  # where units start
    n = len(a)
    starts_line = head[start]
    last_tok = np.concatenate([np.flatnonzero(start)[1:] - 1, [len(tok) - 1]]) if n else np.zeros(0, int)
    z = tok_end[last_tok]  # and end
    ends_line = np.concatenate([starts_line[1:], [True]]) if n else np.zeros(0, bool)
    doc = np.searchsorted(doc_at, a, side="right") - 1

    def within(flag: np.ndarray) -> np.ndarray:
        s = _sums(flag)
        return s[z] - s[a]

    weight = n_solid[z] - n_solid[a]
    letter = (kind & LETTER) != 0
    letters, digits = within(letter), within((kind & DIGIT) != 0)
    odd = within((kind & ODD) != 0)

    # words: of each run of word characters, from its first letter on
    wordy = (kind & WORD) != 0
    edge = np.flatnonzero(wordy[1:] != wordy[:-1]) + 1
    if size and wordy[0]:
        edge = np.concatenate([[0], edge])
    run, run_end = edge[0::2], edge[1::2]
    letter_at = np.flatnonzero(letter)
    first = np.searchsorted(letter_at, run)
    w = letter_at[np.minimum(first, max(len(letter_at) - 1, 0))] if len(letter_at) else run
    keep = (w >= run) & (w < run_end) if len(letter_at) else np.zeros(len(run), bool)
    w, w_end = w[keep], run_end[keep]
    up, down = _Powers.upto(size + 1)
    sums = np.zeros(size + 1, U)
    np.cumsum((lower[code].astype(U) + U(1)) * up[:size], out=sums[1:])
    h = _mix((sums[w_end] - sums[w]) * down[w])
    unit_of = np.searchsorted(a, w, side="right") - 1
    word_doc = doc[unit_of] if n else unit_of
    chars = w_end - w
    cap = (kind[w] & UPPER) != 0
    is_common = _member(h, common)
    known = is_common if familiar is common else _member(h, familiar)
    per = lambda x=None: np.bincount(unit_of, x, n)
    words, word_chars, caps, fam = per(), per(chars), per(cap), per(known)

    # word threes and whole lines that the text had before
    seen3 = np.zeros(n)
    if len(h) > 2:
        three = h[:-2] * U(3) + _mix(h[1:-1] * U(5) + h[2:] * U(7))
        inside = word_doc[:-2] == word_doc[2:]
        key = _mix(three ^ _mix(word_doc[:-2].astype(U) + U(99)))
        seen3 = np.bincount(unit_of[:-2][inside], _repeated(key[inside]), n)
    # what a line's words hash to, with its size, for lines told twice
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_mix(h))])
    upto = np.cumsum(words)
    line_key = sums[upto] - sums[upto - words]
    repeated = _repeated(_mix(line_key ^ _mix(doc.astype(U) + U(77)) ^ (weight.astype(U) << U(40)))) & (weight > 20) & (words > 0)

    # kinds of the first and the last character
    fk, fm = (kind[a], mark[a]) if n else (np.zeros(0, np.uint8),) * 2
    first_kind = np.select([~starts_line, (fk & UPPER) != 0, (fk & LETTER) != 0, (fk & DIGIT) != 0, (fm & _OPEN) != 0, (fm & _TAG) != 0], [0, 1, 2, 3, 4, 5], 6).astype(np.uint8)
    back = z - 1
    for _ in range(2):  # over closing quotes and brackets
        closes = ((mark[back] & _CLOSER) != 0) & (back > a) if n else np.zeros(0, bool)
        back = np.where(closes, back - 1, back)
    bk, bm, zk, zm = (kind[back], mark[back], kind[z - 1], mark[z - 1]) if n else (np.zeros(0, np.uint8),) * 4
    ended = (bk & END) != 0
    last_kind = np.select([~ends_line, ended, (zk & LETTER) != 0, (zk & DIGIT) != 0, (zm & (_COMMA | _HARD)) != 0, (zm & _CLOSER) != 0], [0, 1, 2, 3, 4, 5], 6).astype(np.uint8)

    wide = np.zeros(size, bool)  # the third blank of a run
    if size > 2:
        wide[2:] = (code[2:] == 32) & (code[1:-1] == 32) & (code[:-2] == 32)
        wide[3:] &= ~((code[3:] == 32) & (code[2:-1] == 32) & (code[1:-2] == 32) & (code[:-3] == 32))
    cells = within((mark & _HARD) != 0) + within(wide)
    gap = np.zeros(size, bool)  # a comma or stop after a blank
    gap[1:] = ((mark[1:] & (_COMMA | _STOP)) != 0) & ~solid[:-1]
    stray = within(gap)
    mixed = np.zeros(size, bool)  # a digit or odd sign next to a letter
    mixed[1:] = letter[1:] & ((kind[:-1] & (DIGIT | ODD)) != 0)
    longest = np.zeros(n, np.int64)
    if n:
        longest = np.maximum.reduceat(tok_end - tok, np.flatnonzero(start))
    stops, commas, tags = within((mark & _STOP) != 0), within((mark & _COMMA) != 0), within((mark & _TAG) != 0)

    one = np.maximum(words, 1)
    share = lambda x: x / np.maximum(weight, 1)
    fam_share = fam / one
    columns = [
        _bin(words, 0, 2, 5, 8, 12, 18), _bin(fam_share, 0, 0.08, 0.16, 0.26, 0.38, 0.55), _bin(share(digits), 0, 0.03, 0.1, 0.25, 0.5), _bin(share(odd), 0, 0.015, 0.05, 0.12, 0.3), _bin(caps / one, 0, 0.15, 0.35, 0.6, 0.9), first_kind, last_kind,
        _bin(cells, 0, 1, 2, 4, 8), _bin(longest, 8, 14, 20, 30, 50), _bin(word_chars / one, 2, 4, 5.5, 7, 9), _bin(tags, 0, 1, 3, 8), np.where(repeated, 6, _bin(seen3 / one, 0, 0.1, 0.25, 0.5, 0.8)), _bin(share(letters), 0.3, 0.5, 0.7, 0.85, 0.95), _bin(stops, 0, 1, 2), _bin(stray, 0, 1, 2),
    ]
    shape = sum(columns[i].astype(np.int64) << 4 * k for k, i in enumerate((5, 6, 7, 14, 2))) + (columns[0] // 2 * (columns[1] < 3)).astype(np.int64) * (1 << 20)
    like = np.zeros(n, np.uint8)
    if n > 1:
        prior = doc[1:] == doc[:-1]
        like[1:] = np.where(prior, 1 + (shape[1:] == shape[:-1]), 0)
    columns += [like, _bin(within(mixed) / one, 0, 0.1, 0.5), _bin(commas, 0, 1, 3, 6)]
    codes = np.column_stack(columns) if n else np.zeros((0, len(BINS)), np.uint8)

    by = lambda x=None: np.bincount(doc, x, n_docs)
    all_solid = by(weight)
    return Lines(doc, codes.astype(np.uint8), weight, by(words), by(word_chars), np.bincount(word_doc, is_common, n_docs), all_solid, all_solid - by(word_chars) - by(digits), by(starts_line), by(ended & ends_line))


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether the same key stands earlier."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out
