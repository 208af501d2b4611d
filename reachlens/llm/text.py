"""Helpers for Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import memo

#: Texts go to Python in Arrow batches; a batch is worked off in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """The same for a column of texts, of which nothing is copied."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, upto = 0, np.append(0, np.cumsum(size))
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
        yield start, end
        start = end


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of a group as one array."""
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end and A-Z lower-cased, and their numbers by text; null counts as empty."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words, filled = split.flatten(), pc.greater(pc.binary_length(split.flatten()), 0)
    upto = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))  # what stands before and after outer white space is no word
    edges = split.offsets.to_numpy() - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
    return pc.ascii_lower(words.filter(filled)), np.diff(upto[edges])


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` bytes each; a longer text is a run of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def map_texts(docs: DataFrame, work: Callable[[list[bytes]], dict], schema: str, owner: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``work`` turns a list of texts into columns, one value a text; they come back beside ``id_col``. ``owner``: see ``memo``.

    Only the two columns named are read, so further columns of ``docs`` can't clash.
    """
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only(owner)
        for batch in batches:
            for a, b in runs(batch.column(1)):
                made = work(as_bytes(batch.column(1).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(made[f] if isinstance(made[f], pa.Array) else pa.array(made[f]) for f in fields)], [id_col, *fields])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, {schema}")
