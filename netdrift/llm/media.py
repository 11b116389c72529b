"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, and written as NPY tiles with difference hashes.

Read: Netpbm P2, P3 (text), P5, P6 (binary) with samples of up to 8 bits, brought to 0..255 from their own maximum,
and BMP with 8 (palette), 24 or 32 bits a pixel, uncompressed, rows bottom-up or top-down. Written: P5, P6 and
24-bit BMP. Images are (height, width, channels) uint8 arrays. Area resizing averages the exact rectangle of source
pixels under a target pixel, with fractions at its edges, by an integral image that is built a band of rows at a
time, so that it holds no more than a band besides the image. A tile is the resized image as an NPY file (version
1.0). The difference hash is 64 bits: pixel brighter than its right neighbour, on the grey tile of 8 x 9.

Text as media: UTF-8 with blanks up to a positive multiple of 192 bytes, as rows of 64 RGB pixels; a Netpbm P6 image
where the number of rows is even, and a BMP where it is odd.

Defined cases: a null text is the empty one; equal texts give equal bytes; bytes that are no image that is read
here (or whose samples are above their maximum) give a null in decode_column; repeated rows give repeated rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, slices

ROW = 192  # bytes of a row of 64 RGB pixels
TILE = (8, 9)
BAND = 1 << 18  # samples of a band
GREY = np.array([299, 587, 114], np.float64) / 1000  # fixed values: luma of RGB


def _netpbm_header(raw: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after the magic, with comments skipped, and where the samples begin."""
    found, at = [], 2
    while len(found) < fields:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(raw[at:end]))
        at = end
    return found, at + 1


def read_netpbm(raw: bytes) -> np.ndarray:
    magic = raw[:2]
    if magic not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not an 8-bit grey or RGB Netpbm")
    (width, height, top), at = _netpbm_header(raw, 3)
    if not 0 < top < 256:
        raise ValueError("not 8-bit samples")
    channels = 3 if magic in (b"P3", b"P6") else 1
    size = width * height * channels
    if magic in (b"P2", b"P3"):
        samples = np.array(raw[at:].split()[:size], np.int64)
    else:
        samples = np.frombuffer(raw, np.uint8, count=size, offset=at)
    if top < 255 or magic in (b"P2", b"P3"):
        if samples.min(initial=0) < 0 or samples.max(initial=0) > top:
            raise ValueError("a sample above the maximum")
        samples = ((samples.astype(np.uint32) * 510 + top) // (2 * top)).astype(np.uint8)  # rounded half up
    return samples.reshape(height, width, channels)


def write_netpbm(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def read_bmp(raw: bytes) -> np.ndarray:
    if raw[:2] != b"BM":
        raise ValueError("not a BMP")
    (start,) = struct.unpack_from("<I", raw, 10)
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("not an uncompressed BMP of 8, 24 or 32 bits")
    stride, lines = (width * bits // 8 + 3) // 4 * 4, abs(height)
    rows = np.frombuffer(raw, np.uint8, count=stride * lines, offset=start).reshape(lines, stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        (used,) = struct.unpack_from("<I", raw, 46)
        palette = np.frombuffer(raw, np.uint8, count=4 * (used or 256), offset=14 + header).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(lines, width, bits // 8)[:, :, 2::-1]


def write_bmp(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = image[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def read_image(raw: bytes) -> np.ndarray:
    return read_bmp(raw) if raw[:2] == b"BM" else read_netpbm(raw)


def _at(integral: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
    """An integral image's values at fractional ``edges`` along an axis."""
    low = np.minimum(edges.astype(int), integral.shape[axis] - 2)
    part = (edges - low).reshape([-1 if i == axis else 1 for i in range(3)])
    return np.take(integral, low, axis) * (1 - part) + np.take(integral, low + 1, axis) * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's rectangle of the source, as float64 (height, width, channels)."""
    h, w, channels = image.shape
    if not h or not w:
        raise ValueError("an image without pixels")
    rows, columns = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    corners, above = np.zeros((height + 1, width, channels)), np.zeros((width, channels))
    band = max(1, BAND // (w * channels))
    for top in range(0, h, band):
        part = image[top : top + band]
        integral = np.zeros((len(part) + 1, w + 1, channels))
        np.cumsum(part, axis=1, out=integral[1:, 1:], dtype=np.float64)
        cells = np.diff(_at(integral, columns, 1), axis=1)
        np.cumsum(cells, axis=0, out=cells)
        here = np.flatnonzero((rows > top) & (rows <= top + len(part)))
        corners[here] = above + _at(cells, rows[here] - top, 0)
        above = above + cells[-1]
    return np.diff(corners, axis=0) * (height * width / (h * w))


def npy(image: np.ndarray) -> bytes:
    """A resized image as an NPY file of uint8."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.rint(image).clip(0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """64 bits in hex of an image resized to TILE."""
    grey = tile @ GREY if tile.shape[2] == 3 else tile[:, :, 0]
    grey = np.round(grey, 6)  # so that equal areas compare as equal
    return np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()


def text_payload(text: str) -> tuple[bytes, int]:
    """The padded bytes and the length before padding."""
    raw = text.encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % ROW if raw else ROW), len(raw)


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, format string, tile binary"


def _store_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "tile"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        rows = []
        for texts in slices(batch):
            for text in texts:
                payload, n = text_payload(text)
                image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
                kind, write = ("bmp", write_bmp) if len(image) % 2 else ("ppm", write_netpbm)
                stored = write(image)
                image = read_image(stored)
                back = image.tobytes()
                small = area_resize(image, *TILE)
                tile = npy(small)
                feature = f"dhash:{difference_hash(small)};tile:{hashlib.sha256(tile).hexdigest()[:16]}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, kind, tile))
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the fields of ``FEATURES``, of each text stored as an image and read back."""
    arrow_batches(docs.sparkSession)
    stored = F.arrow_udf(_store_texts, FEATURES)
    return docs.select(F.col(id_column).alias("doc_id"), stored(F.col(text_column)).alias("_m")).select("doc_id", "_m.*")


def decode_column(media: Column, height: int = 8, width: int = 9) -> Column:
    """struct(height, width, channels, tile: NPY bytes, dhash) of a binary column of images; null for other bytes."""

    def decode(batch: pa.Array) -> pa.Array:
        out = []
        for raw in batch.to_pylist():
            try:
                image = read_image(raw)
                small = area_resize(image, *TILE)
                tile = npy(small if (height, width) == TILE else area_resize(image, height, width))
                out.append({"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "tile": tile, "dhash": difference_hash(small)})
            except (ValueError, TypeError, IndexError, struct.error, OverflowError):
                out.append(None)
        return pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string())]))

    return F.arrow_udf(decode, "height int, width int, channels int, tile binary, dhash string")(media)
