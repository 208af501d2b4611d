"""Media columns: baseline JPEG dimensions and thumbnail hashes, and texts stored as JPEG payloads.

Defined results: null media give nulls and ``error`` null; bytes that are no baseline JPEG give nulls and a message
in ``error``, never a failed task. A null text counts as empty, and an empty one is stored as 64 zero bytes. Equal inputs
give equal values; an empty table gives an empty one. A text of any length is stored whole: beyond half a megabyte as several files end to end, of which
one at a time is written and read back. Only the id and the text (or media) are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import jpeg
from reachlens.llm.text import map_texts, slices


def jpeg_columns(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id_col``, width, height, thumbnail (binary, row by row), thumbnail_hash and error of each JPEG."""
    fields = {"width": pa.int32(), "height": pa.int32(), "thumbnail": pa.binary(), "thumbnail_hash": pa.string(), "error": pa.string()}

    def look(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        try:
            width, height, thumb = jpeg.thumbnails([data])[0]
        except (jpeg.JpegError, IndexError, KeyError, ValueError) as bad:
            return (None, None, None, None, str(bad) or type(bad).__name__)
        return width, height, thumb.tobytes(), jpeg.average_hash(thumb), None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*map(look, batch.column(1).to_pylist()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(made, fields.values(), strict=True))], [id_col, *fields])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(run, f"{id_col} {kind}, width int, height int, thumbnail binary, thumbnail_hash string, error string")


def padded(text: bytes) -> bytes:
    """``text`` and zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % jpeg.ACROSS if text else jpeg.ACROSS)


def file_parts(payload: bytes) -> list[bytes]:
    """What each file of a payload holds."""
    most = jpeg.ACROSS * jpeg.MOST_ROWS
    return [payload[k : k + most] for k in range(0, len(payload), most)]


class Stored:
    """What is told about one stored payload, gathered file by file."""

    def __init__(self, with_media: bool) -> None:
        self.back, self.media, self.size, self.width = hashlib.sha256(), hashlib.sha256(), 0, 0
        self.thumbs: list[np.ndarray] = []
        self.files: list[bytes] | None = [] if with_media else None

    def add(self, file: bytes, thumb: np.ndarray, width: int) -> None:
        self.back.update(np.ascontiguousarray(thumb))
        self.media.update(file)
        self.size, self.width = self.size + len(file), width
        self.thumbs.append(thumb.astype(np.uint8))
        if self.files is not None:
            self.files.append(file)

    def row(self) -> tuple:
        thumb = np.concatenate(self.thumbs)
        height = 8 * len(thumb)
        out = (thumb.size, self.back.hexdigest(), zlib.crc32(thumb.reshape(-1)[-64:].tobytes()), self.size, self.media.hexdigest(), f"{self.width}x{height}:{jpeg.average_hash(thumb)}", self.width, height)
        return out if self.files is None else (*out, b"".join(self.files))


def text_media(docs: DataFrame, with_media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as JPEG payload, read the files back through the decoder, and describe both.

    The payload's checksums and the feature (dimensions and thumbnail hash) come from what was read back.
    ``with_media`` adds the files.
    """

    def work(texts: list[bytes]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", *(["media"] * with_media))}
        # a payload of more rows than a file holds is several files, which are written and read back one slice at a time
        parts = [(k, part) for k, text in enumerate(texts) for part in file_parts(padded(text))]
        stored = Stored(with_media)
        for lo, hi in slices([part for _, part in parts], 1 << 19):
            files = jpeg.store([part for _, part in parts[lo:hi]])
            for at, file, (width, _, thumb) in zip(range(lo, hi), files, jpeg.thumbnails(files), strict=True):
                stored.add(file, thumb, width)
                if at + 1 == len(parts) or parts[at + 1][0] != parts[at][0]:
                    for values, v in zip(out.values(), (len(texts[parts[at][0]]), *stored.row()), strict=True):
                        values.append(v)
                    stored = Stored(with_media)
        return out

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int" + ", media binary" * with_media
    typed = {"width": pa.int32(), "height": pa.int32()}
    return map_texts(docs, lambda t: {k: pa.array(v, typed.get(k)) for k, v in work(t).items()}, schema, "media", id_col, text_col)
