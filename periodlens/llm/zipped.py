"""Texts as compressed bytes, for shuffles that move whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import schema_of, small_batches
from .words import lean, slices


def zipped(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None,
           more: str = "", also: Callable[[pa.RecordBatch], list] | None = None) -> DataFrame:
    """``keep`` columns (else all but the text) and the text as ``__zip``; null stays null.
    ``also`` gives the columns ``more`` (DDL) of a batch in the same pass."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text] if keep is None else list(keep)
    schema = schema_of(docs.select(*names), "__zip binary" + (f", {more}" if more else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zipper = zstandard.ZstdCompressor(level=1)
        for b in (part for whole in batches for part in slices(whole, text)):
            packed = pa.array([None if t is None else zipper.compress(t.encode())
                               for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], packed, *(also(b) if also else [])],
                names=schema.names)

    return docs.select(*names, text).mapInArrow(run, schema)


def unzipped(batch: pa.RecordBatch, name: str = "__text") -> pa.RecordBatch:
    """The batch with its texts again, in place of ``__zip``."""
    import zstandard

    lean()
    unzip = zstandard.ZstdDecompressor()
    texts = [None if z is None else unzip.decompress(z) for z in
             batch.column("__zip").to_pylist()]
    at = batch.schema.get_field_index("__zip")
    return batch.set_column(at, name, pa.array(texts, pa.binary()).cast(pa.string()))
