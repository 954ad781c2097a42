"""Media columns: text bytes as baseline JPEG, and what a JPEG's bytes tell.

`store` adds a binary column; `read_back` and `describe` take any such column. A file
that is no baseline JPEG of one scan gets null sizes and a reason in `error`; null media
give nulls. Null text is stored as no bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import tune

#: Bytes of media decoded together.
TOGETHER = 2 << 20


def _groups(sizes: list[int]) -> Iterator[range]:
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > TOGETHER:
            yield range(at, k)
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield range(at, len(sizes))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, media): a JPEG that holds the UTF-8 bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for own in _groups([len(t) for t in texts]):
                files = jpeg.encode([texts[k] for k in own])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(own.start, len(own)), pa.array(files, pa.binary())], names=[id_col, "media"])

    tune(docs.sparkSession)
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, media binary")


def _decoded(batch: pa.RecordBatch, column: int) -> Iterator[tuple[range, list[bytes], list]]:
    files = batch.column(column).to_pylist()
    for own in _groups([len(f or b"") for f in files]):
        data = [files[k] for k in own]
        try:
            images = [jpeg.parse(f) for f in data]
            yield own, data, list(zip(images, jpeg.coefficients(images, data), strict=True))
        except (ValueError, KeyError, IndexError, TypeError):
            got = []
            for f in data:
                try:
                    image = jpeg.parse(f)
                    got.append((image, jpeg.coefficients([image], [f])[0]))
                except (ValueError, KeyError, IndexError, TypeError) as e:
                    got.append(None if f is None else str(e) or type(e).__name__)
            yield own, data, got


def read_back(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, media) of `store` -> digests of the stored form, of the bytes read back, and the thumbnail's feature."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, got in _decoded(batch, 1):
                rows = []
                for f, (image, coefs) in zip(data, got, strict=True):
                    n, stored = jpeg.payload(image, coefs)
                    rows.append((n, len(stored), jpeg.sha(stored), zlib.crc32(stored[-64:]), len(f), jpeg.sha(f), jpeg.feature(image, coefs)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(own.start, len(own)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return media.select(id_col, "media").mapInArrow(run, f"`{id_col}` {dict(media.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def describe(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """df -> (id_col, width, height, components, thumbnail binary, thumb_width, thumb_height, thumb_hash, error)."""
    names = [id_col, "width", "height", "components", "thumbnail", "thumb_width", "thumb_height", "thumb_hash", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _, got in _decoded(batch, 1):
                rows = []
                for x in got:
                    if x is None or isinstance(x, str):
                        rows.append((None,) * 7 + (x,))
                        continue
                    grey = jpeg.thumbnail(*x)
                    rows.append((x[0].width, x[0].height, len(x[0].components), grey.tobytes(), grey.shape[1], grey.shape[0], jpeg.average_hash(grey), None))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(own.start, len(own)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    tune(df.sparkSession)
    return df.select(id_col, F.col(media_col)).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, width int, height int, components int, thumbnail binary, thumb_width int, thumb_height int, thumb_hash string, error string")
