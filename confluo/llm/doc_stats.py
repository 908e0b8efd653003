"""Statistics of a text that the quality operators score; words are runs without ASCII white space."""

from __future__ import annotations

from collections import Counter

import numpy as np

from confluo.llm.common import SYMBOLS

#: Columns of ``features``; the sign is the direction in which quality may go as the feature grows (0: any).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1,
    "bang_rate": -1, "digit_rate": -1, "pipe_words": -1, "distinct_rate": 0, "stop_rate": 0, "end_rate": 0, "title_rate": 0,
}
#: Frequent short words of the four languages of the corpus.
STOP = frozenset("the of and to in a is that it for on was as der die und das nicht ein von zu le la les et de des un du que el los en y se por".encode().split())
WINDOW, LONG = 5, 50_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that the text holds twice or more, the first ones included."""
    m = len(words) - WINDOW + 1
    if m < 2:
        return 0
    if len(words) <= LONG:
        grams = list(zip(*(words[i : i + m] for i in range(WINDOW))))
        count = Counter(grams)
        if len(count) == m:
            return 0
        twice = np.fromiter((count[g] > 1 for g in grams), np.bool_, m)
    else:  # the same in arrays: windows get exact ranks step by step
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        rank = ids
        for k in range(1, WINDOW):
            rank = np.unique(rank[: len(ids) - k] * len(number) + ids[k:], return_inverse=True)[1]
        twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at := np.flatnonzero(twice), 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_stats(raw: bytes, text: str) -> tuple[list[bytes], int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, repeated words)."""
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\r\v\f")]
    return words, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def features(raw: bytes, text: str, base: tuple[list[bytes], int, int, int, int]) -> tuple[float, ...]:
    words, chars, symbols, dup_lines, repeats = base
    n, c = max(1, len(words)), max(1, chars)
    lines = max(1, raw.count(b"\n") + 1)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    stop = sum(map(STOP.__contains__, words))
    return (
        float(np.log1p(len(words))), chars / n, symbols / c, dup_lines / lines, repeats / n, upper / c,
        raw.count(b"!") / n, digits / c, words.count(b"|") / n, len(set(words)) / n, stop / n, (raw.count(b".") + raw.count(b",")) / n, sum(map(bytes.istitle, words)) / n,
    )
