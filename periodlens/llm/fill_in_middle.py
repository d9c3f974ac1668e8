"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, stop) over two immutable buffers:
the texts as they came, and the sentinels. A fresh document is one descriptor over its
whole text; two cuts split it into prefix, middle and suffix; an arrangement permutes
those three and the three sentinel descriptors; the inverse permutation brings them
back. Texts are never rewritten on the way: digests stream over the descriptors, and
only ``output`` (where asked for) copies the bytes they name, once.

The draw is a function of the seed and the doc_id: the first four 8-digit groups of
the hex sha256 of ``<seed>:<doc_id>`` as unsigned integers h1 to h4. Cuts fall after
h1 % (n + 1) and h2 % (n + 1) of the text's n code points; the form is ``plain`` where
the text is empty or holds a sentinel or h3 % 100 >= 100 - plain_percent, else ``spm``
where h4 % 100 < spm_percent, else ``psm``.

Defined cases: a null text counts as empty (its output is ''); a null doc_id draws as
the empty word; rows of one doc_id draw alike; an empty table gives an empty result;
other columns pass where ``keep`` names them, unless the result has a column so named.

Scale: no shuffle. A task holds a slice of a few MB, or one text, and its pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import schema_of, small_batches
from .words import slices, text_bytes

SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
TEXT, SENTINEL = 0, 1  # buffers
# The pieces of a cut document: prefix, middle, suffix, then the three sentinels.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
FORMS = ("plain", "psm", "spm")
ARRANGED = {"psm": np.array([P, PREFIX, S, SUFFIX, M, MIDDLE]),
            "spm": np.array([S, SUFFIX, P, PREFIX, M, MIDDLE])}
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output_sha256")


class Pieces(NamedTuple):
    """Descriptors of one document, in order."""

    buffer: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def permuted(self, order: np.ndarray) -> "Pieces":
        return Pieces(self.buffer[order], self.start[order], self.stop[order])

    def spans(self, buffers: tuple[memoryview, memoryview]) -> Iterator[memoryview]:
        for b, start, stop in zip(self.buffer.tolist(), self.start.tolist(),
                                  self.stop.tolist()):
            yield buffers[b][start:stop]

    def sha256(self, buffers: tuple[memoryview, memoryview]) -> str:
        digest = hashlib.sha256()
        for span in self.spans(buffers):
            digest.update(span)
        return digest.hexdigest()

    def rendered(self, buffers: tuple[memoryview, memoryview]) -> bytes:
        return b"".join(self.spans(buffers))


_SENTINEL_STOPS = np.cumsum([len(x) for x in SENTINELS.values()])
_SENTINEL_STARTS = _SENTINEL_STOPS - [len(x) for x in SENTINELS.values()]
_SENTINEL_BUFFER = b"".join(SENTINELS.values())


def whole(start: int, stop: int) -> Pieces:
    return Pieces(np.array([TEXT]), np.array([start]), np.array([stop]))


def cut(start: int, stop: int, first: int, second: int) -> Pieces:
    """The descriptor ``start:stop`` split at two bytes, and the sentinels behind it."""
    return Pieces(np.array([TEXT] * 3 + [SENTINEL] * 3),
                  np.concatenate([[start, first, second], _SENTINEL_STARTS]),
                  np.concatenate([[first, second, stop], _SENTINEL_STOPS]))


def restored_pieces(raw: bytes, form: str) -> Pieces:
    """Descriptors over an output that give the text it was made from: the output is
    split around its sentinels, and the form's inverse permutation puts the pieces back."""
    if form == "plain":
        return whole(0, len(raw))
    order = ARRANGED[form]
    marks = [SENTINELS["PSM"[k - P]] for k in order[::2]]
    start, stop, at = [], [], 0
    for k, mark in enumerate(marks):
        start.append(raw.index(mark, at))
        stop.append(start[-1] + len(mark))
        at = stop[-1]
    edges = np.array([*np.ravel(list(zip(start, stop))), len(raw)])
    pieces = Pieces(np.zeros(6, np.int64), edges[:-1], edges[1:])
    return pieces.permuted(np.argsort(order)[:3])


def _with_sentinel(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row holds a sentinel."""
    if len(data) < 3:
        return np.zeros(len(at) - 1, bool)
    letter = np.isin(data[1:-1], list(b"PSM"))
    begin = np.flatnonzero((data[:-2] == ord("<")) & letter & (data[2:] == ord(">")))
    row = np.searchsorted(at, begin, "right") - 1
    found = np.zeros(len(at) - 1, bool)
    found[row[begin + 3 <= at[row + 1]]] = True
    return found


def _draw(doc_id, seed: int):
    """h1 to h4 of each row, as columns."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"),
                                                           F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k + 1}")
            for k in range(4)]


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = 1,
                   plain_percent: int = 10, spm_percent: int = 20, output: bool = True,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns, n, form, prefix_chars and middle_chars (null if plain),
    output_sha256 and, with ``output``, the transformed text."""
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in (*RESULT, "output")]
    src = docs.select(*keep, *_draw(doc_id, seed), F.col(text).alias("__text"))
    schema = schema_of(docs.select(*keep),
                       "n long, form string, prefix_chars long, middle_chars long, "
                       "output_sha256 string" + (", output string" if output else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, "__text"):
                data, at = text_bytes(b.column("__text"))
                buffers = (memoryview(data), memoryview(_SENTINEL_BUFFER))
                chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                first = np.searchsorted(chars[:-1], at)
                n = np.diff(first)
                h1, h2, h3, h4 = (b.column(f"__h{k}").to_numpy(zero_copy_only=False)
                                  for k in range(1, 5))
                low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
                plain = (n == 0) | _with_sentinel(data, at) | (h3 % 100 >= 100 - plain_percent)
                form = np.where(plain, 0, np.where(h4 % 100 < spm_percent, 2, 1))
                spots = chars[first[:-1] + low], chars[first[:-1] + high]
                digests, texts = [], []
                for i, f in enumerate(form.tolist()):
                    if f:
                        pieces = cut(at[i], at[i + 1], spots[0][i], spots[1][i]).permuted(
                            ARRANGED[FORMS[f]])
                    else:
                        pieces = whole(at[i], at[i + 1])
                    digests.append(pieces.sha256(buffers))
                    if output:
                        texts.append(pieces.rendered(buffers))
                found = [pa.array(n, pa.int64()),
                         pa.array([FORMS[f] for f in form], pa.string()),
                         pa.array(low, pa.int64(), mask=plain),
                         pa.array(high - low, pa.int64(), mask=plain),
                         pa.array(digests, pa.string())]
                if output:
                    found.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *found],
                                                 names=schema.names)

    return src.mapInArrow(run, schema)


def restored(filled: DataFrame, text: bool = True) -> DataFrame:
    """All columns but ``output``, with ``restored_sha256`` and, with ``text``, the
    ``restored`` text, both rebuilt from ``output`` and ``form`` alone; null in either
    counts as empty and plain."""
    small_batches(filled.sparkSession)
    names = [c for c in filled.columns
             if c not in ("output", "restored_sha256", *(("restored",) if text else ()))]
    src = filled.select(*names, F.col("output").alias("__out"),
                        F.coalesce("form", F.lit("plain")).alias("__form"))
    schema = schema_of(filled.select(*names),
                       "restored_sha256 string" + (", restored string" if text else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for b in slices(all_rows, "__out"):
                digests, texts = [], []
                raws = b.column("__out").cast(pa.binary()).to_pylist()
                for raw, form in zip(raws, b.column("__form").to_pylist()):
                    raw = raw or b""
                    pieces, buffers = restored_pieces(raw, form), (memoryview(raw),) * 2
                    digests.append(pieces.sha256(buffers))
                    if text:
                        texts.append(pieces.rendered(buffers))
                found = [pa.array(digests, pa.string())]
                if text:
                    found.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], *found],
                                                 names=schema.names)

    return src.mapInArrow(run, schema)
