"""Statistics of the form of a text, for whole chunks of rows at once."""

from __future__ import annotations

import numpy as np

from topicspark.llm import textvec as tv

NAMES = ("word_bytes", "symbols", "capitals", "variety", "echo", "punctuation", "repeated_lines")
#: Shares are taken as if so many average words or bytes stood before the text: short texts lie near the centre.
PSEUDO_WORDS, PSEUDO_BYTES = 40.0, 200.0
TYPICAL = {"word_bytes": 6.0, "symbols": 0.002, "capitals": 0.03, "variety": 0.9, "echo": 0.005, "punctuation": 0.03, "repeated_lines": 0.02}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in ".,;:'\"()-?"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _share(part: np.ndarray, whole: np.ndarray, typical: float, pseudo: float) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip((part + typical * pseudo) / (whole + pseudo), 0, 1)))


def typical() -> np.ndarray:
    """The statistics of a text without words."""
    return statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text: shares on the arc-sine scale, the mean word length as a logarithm, variety as
    log(distinct words) / log(words). A text without words gets the typical value in every place."""
    w = tv.words(data, offsets)
    n = w.n_rows
    n_words = np.diff(w.first).astype(float)
    h = w.hashes()
    edge = np.concatenate(([0], np.cumsum(w.end - w.start)))
    word_bytes = (edge[w.first[1:]] - edge[w.first[:-1]]).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    word_mask = tv._WORD[data]
    solid = total(~_SPACE[data])
    symbols = total(~(word_mask | _SPACE[data] | _PUNCTUATION[data]))
    punctuation = total(_PUNCTUATION[data])
    changed = w.lower != data
    letters = total(_LETTER[data]) + total(changed & ~_LETTER[data])
    row, value = tv.unique_pairs(w.row, h >> np.uint64(32))
    distinct = np.bincount(row, minlength=n).astype(float)
    same = np.flatnonzero((h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])) + 1
    echo = np.bincount(w.row[same], minlength=n).astype(float)

    # lines: runs without a line feed
    power, inv = tv._powers(len(data) + 1)
    start, end = tv.runs(data != 10, offsets)
    line_row = np.searchsorted(offsets, start, "right") - 1
    line = tv.mix((w.sums[end] - w.sums[start]) * inv[start])
    order = np.lexsort((line, line_row))
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (line_row[order[1:]] == line_row[order[:-1]])
    repeated = np.bincount(line_row[again], weights=(end - start)[again], minlength=n)

    t = TYPICAL
    cols = [
        np.log((word_bytes + t["word_bytes"] * PSEUDO_WORDS) / (n_words + PSEUDO_WORDS)),
        _share(symbols, solid, t["symbols"], PSEUDO_BYTES),
        _share(total(changed), letters, t["capitals"], PSEUDO_BYTES),
        np.log(distinct + PSEUDO_WORDS) / np.log(n_words + PSEUDO_WORDS),
        _share(echo, n_words, t["echo"], PSEUDO_WORDS),
        _share(punctuation, solid, t["punctuation"], PSEUDO_BYTES),
        _share(repeated, np.diff(offsets).astype(float), t["repeated_lines"], PSEUDO_BYTES),
    ]
    return np.stack(cols, axis=1)
