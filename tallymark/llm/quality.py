"""Quality rules from counts of words and from how much of a text repeats itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text
from .words import code_points, ngram_hashes, span_hashes, word_spans

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
# Largest share of word characters inside duplicated n-grams, by n, and in duplicated lines. Both
# bind below MAX_REPEAT_PERCENT. Not counted for n-grams: a line of at most SHORT_LINE words that
# occurs twice, if no other line comes back.
MAX_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_COVERAGE = 0.25
SHORT_LINE = 20


def covered(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more, the first included."""
    out = np.zeros(len(hashes) + 1, np.int64)
    rolled = ngram_hashes(hashes, n)
    if len(rolled) > 1:
        order = np.argsort(rolled, kind="stable")
        same = rolled[order[1:]] == rolled[order[:-1]]
        twice = np.zeros(len(rolled), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        out[at] += 1  # each window starts once
        out[at + n] -= 1
    return np.cumsum(out[:-1]) > 0


def duplicate_lines(text: str) -> tuple[int, int, list[tuple[int, int]]]:
    """Lines with a word that equal an earlier line, the characters of their words, and where the
    first such line and the line it equals stand."""
    seen, lines, chars, at, pair = {}, 0, 0, 0, []
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            chars += len(line) - sum(line.count(c) for c in " \t\n\v\f\r")
            pair = pair or [(x, x + len(line)) for x in (seen[line], at)]
        elif line.strip(" \t\n\v\f\r"):
            seen[line] = at
        at += len(line) + 1
    return lines, chars, pair


def outside(start: np.ndarray, lines: int, pair: list[tuple[int, int]]) -> np.ndarray:
    """Which words, by their starts, are not part of the one short line that a text has twice."""
    out = np.ones(len(start), bool)
    if lines == 1:
        for a, b in np.searchsorted(start, pair):
            if b - a <= SHORT_LINE:
                out[a:b] = False
    return out


def measure(text: str) -> dict:
    points = code_points(text)
    start, end = word_spans(~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D))))
    sizes = end - start
    chars = int(sizes.sum())
    lines, line_chars, pair = duplicate_lines(text)
    out = {"n_words": len(start), "word_chars": chars,
           "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": lines,
           "n_repeat_words": 0, "line_coverage": line_chars / chars if chars else 0.0,
           "coverage": [0.0] * len(MAX_COVERAGE), "counted": [0.0] * len(MAX_COVERAGE)}
    if len(start) <= WINDOW:
        return out
    hashes = span_hashes(points, start, end)
    counted = outside(start, lines, pair)
    for i, n in enumerate(MAX_COVERAGE):
        inside = covered(hashes, n)
        if n == WINDOW:
            out["n_repeat_words"] = int(inside.sum())
        if not inside.any():
            break  # a longer repeat holds a shorter one
        out["coverage"][i] = float(sizes[inside].sum() / chars)
        out["counted"][i] = float(sizes[inside & counted].sum() / chars)
    return out


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, measured shares and verdict per row of `docs`.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows.
    kept: not base_failed, and the shares of characters inside repeated n-grams (counted, by
    the lengths in MAX_COVERAGE) and repeated lines within their limits. `counted` is `coverage`
    without the words of a line of at most SHORT_LINE words that the text has twice, if it is the
    only line that comes back; other repeats count in full. A null or empty text has no words, so
    it fails. Rows with a null or repeated id are rated like any other, other
    columns are not read, and an empty table gives no rows. Texts are rated whole, one at a
    time, in memory in proportion to the text.
    """
    def run(columns):
        found = [measure(t) for t in columns["text"]]
        yield {"doc_id": columns["doc_id"], **{k: [f[k] for f in found] for k in names}}

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = ", ".join(f"{n} long" for n in names)
    names += ["line_coverage", "coverage", "counted"]
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    found = map_rows(rows, run, f"doc_id {id_type}, {fields}, line_coverage double, "
                     "coverage array<double>, counted array<double>")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    fine = F.col("line_coverage") <= MAX_LINE_COVERAGE
    for i, limit in enumerate(MAX_COVERAGE.values()):
        fine &= F.col("counted")[i] <= limit
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
