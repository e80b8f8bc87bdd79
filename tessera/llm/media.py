"""Media columns: lossless WebP files in, pixel arrays out, and texts as such files.

``decode_images`` turns a binary column of lossless WebP files into width, height and raw
pixel arrays; damaged files give an error instead of failing the job. ``store_payload`` and
``read_payload`` keep arbitrary bytes as RGB samples, 64 pixels a row; bytes beyond one
image's largest size go on in further images, one file after another.

Defined cases: a null or empty text is stored as one row of spaces; a null file gives null
results; repeated rows give equal files; empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, webp

WIDTH = 64
ROW = 3 * WIDTH


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of one row of samples."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def store_payload(payload: bytes) -> bytes:
    """The payload (whole rows of samples) as one or more lossless WebP files."""
    out = []
    for i in range(0, len(payload), ROW * webp.SIDE):
        rgb = np.frombuffer(payload[i : i + ROW * webp.SIDE], np.uint8).reshape(-1, WIDTH, 3).astype(np.uint32)
        out.append(webp.encode(webp.BLACK | rgb[..., 0] << np.uint32(16) | rgb[..., 1] << np.uint32(8) | rgb[..., 2]))
    return b"".join(out)


def read_images(media: bytes) -> list[np.ndarray]:
    """The pixels of the files in ``media``, one after another."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(webp.decode(media[at : at + size]))
        at += size
    return out


def samples(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue of each pixel (height x width x 3)."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)[..., 2::-1]


def read_payload(media: bytes) -> bytes:
    return b"".join(samples(p).tobytes() for p in read_images(media))


def feature(images: list[np.ndarray]) -> str:
    """Size, mean samples, and a 64-bit difference hash of 65 equal stretches of the samples."""
    flat = [samples(x).reshape(-1, 3) for x in images]
    rgb = flat[0] if len(flat) == 1 else np.concatenate(flat)
    mean = rgb.sum(axis=0, dtype=np.int64) / len(rgb)
    sums = np.concatenate([[0], np.cumsum(rgb.ravel(), dtype=np.int64)])
    at = np.arange(66) * rgb.size // 65
    level = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    bits = np.packbits(level[1:] > level[:-1]).tobytes().hex()
    return f"{images[0].shape[1]}x{sum(x.shape[0] for x in images)} rgb {mean[0]:.3f} {mean[1]:.3f} {mean[2]:.3f} dhash {bits}"


def _store_batches(batches):
    for batch in batches:
        n, media = [], []
        for t in batch.column("text"):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            n.append(len(data))
            media.append(store_payload(pad(data)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read_batches(batches):
    for batch in batches:
        rows = []
        for m in batch.column("media"):
            media = m.as_py()
            images = read_images(media)
            payload = b"".join(samples(p).tobytes() for p in images)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a lossless WebP column."""
    return _store.doc_text(docs).mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary")


def describe_media(stored: DataFrame) -> DataFrame:
    """Reads the stored files back: digests of payload and file, and a feature of the pixels."""
    return stored.mapInArrow(_read_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def decode_images(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """id, image (number within the row), width, height, pixels (R, G, B, A bytes by row) and error of every file."""

    def run(batches):
        for batch in batches:
            for i, m in zip(batch.column("id"), batch.column("media"), strict=True):
                data, rows = m.as_py(), []
                if data is not None:
                    try:
                        for k, p in enumerate(read_images(data)):
                            rgba = np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)[..., [2, 1, 0, 3]]
                            rows.append((i.as_py(), k, p.shape[1], p.shape[0], rgba.tobytes(), None))
                    except (webp.Broken, struct.error) as e:
                        rows = [(i.as_py(), 0, None, None, None, str(e))]
                else:
                    rows = [(i.as_py(), 0, None, None, None, None)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["id", "image", "width", "height", "pixels", "error"])

    named = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{media}`").alias("media"))
    return named.mapInArrow(run, "id long, image int, width int, height int, pixels binary, error string")


def op2_webp(spark, sf_dir: str) -> DataFrame:
    """Every document's text as lossless WebP, stored, read back and described."""
    stored = _store.materialise(store_texts(_store.table(spark, sf_dir, "documents")), "media")
    return describe_media(stored)
