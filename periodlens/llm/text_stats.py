"""Statistics of whole texts, one Arrow pass, shared by the quality operators.

All are counts: of words, characters, bytes of a kind, lines and repeats. Null
and empty texts have all counts 0. Memory is bounded by ``words.slices``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import schema_of, small_batches
from .words import mix, range_hashes, row_sums, slices, text_bytes, window_hashes, \
    window_starts, word_bounds

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_chars_all", "n_upper", "n_digits", "n_bangs", "n_pipes", "n_punct", "n_short_words",
          "n_long_words", "n_distinct_words", "n_upper_words")


def _in_rows(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows of a slice."""
    return mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))


def text_counts(data: np.ndarray, at: np.ndarray, only: tuple[str, ...] = COUNTS
                ) -> dict[str, np.ndarray]:
    """The counts named in ``only``, by row."""
    rows = np.arange(len(at) - 1)
    starts, ends, first = word_bounds(data, at)
    n_words = np.diff(first)
    per_byte = lambda flags: row_sums(flags, at)
    among = lambda chars: np.isin(np.arange(256), list(chars))[data]
    between = lambda low, high: per_byte((data >= low) & (data <= high))
    new_char = (data & 0xC0) != 0x80
    size = ends - starts
    simple = {
        "n_words": lambda: n_words,
        "word_chars": lambda: per_byte(new_char & ~among(b" \t\n\x0b\x0c\r")),
        "n_symbols": lambda: per_byte(among(SYMBOLS)),
        "n_chars_all": lambda: per_byte(new_char),
        "n_upper": lambda: between(65, 90), "n_digits": lambda: between(48, 57),
        "n_bangs": lambda: between(33, 33), "n_pipes": lambda: between(124, 124),
        "n_punct": lambda: per_byte(among(b".,;:?'\"()-")),
        "n_short_words": lambda: row_sums(size <= 3, first),
        "n_long_words": lambda: row_sums(size >= 12, first)}
    out = {name: simple[name]() for name in only if name in simple}
    if "n_upper_words" in only:
        uppers = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        out["n_upper_words"] = row_sums((uppers[ends] - uppers[starts]) * 2 > size, first)

    words = range_hashes(data, starts, ends)
    word_row = np.repeat(rows, n_words)
    if "n_distinct_words" in only:
        seen = np.unique(_in_rows(words, word_row), return_index=True)[1]
        out["n_distinct_words"] = np.bincount(word_row[seen], minlength=len(rows))

    # Words that a 3-word window covers which its text holds twice or more.
    begin = window_starts(first, REPEAT_WORDS)
    repeated = np.zeros(len(words) + REPEAT_WORDS, bool)
    if len(begin):
        keys = _in_rows(window_hashes(words, REPEAT_WORDS)[begin], word_row[begin])
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = begin[times[which] > 1]
        for k in range(REPEAT_WORDS):
            repeated[twice + k] = True
    out["n_repeat_words"] = row_sums(repeated[:len(words)], first)

    # Lines with a word, and those equal to an earlier line of the text.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([at[1:], breaks]))
    row = np.searchsorted(at[1:], line_ends, "left")
    line_starts = np.minimum(line_starts, line_ends)
    lively = (np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts))
    line_starts, line_ends, row = line_starts[lively], line_ends[lively], row[lively]
    lines = _in_rows(range_hashes(data, line_starts, line_ends), row)
    distinct = np.unique(lines, return_index=True)[1]
    out["n_lines"] = np.bincount(row, minlength=len(rows))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[distinct], minlength=len(rows))
    return {name: out[name] for name in only}


def with_text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                     counts: tuple[str, ...] = COUNTS) -> DataFrame:
    """``keep`` columns and the counts of every row."""
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = schema_of(docs.select(*keep), ", ".join(f"{c} long" for c in counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__text"):
                found = text_counts(*text_bytes(b.column("__text")), counts)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], *[pa.array(found[c], pa.int64()) for c in counts]],
                    names=[*keep, *counts])

    return src.mapInArrow(run, schema)
