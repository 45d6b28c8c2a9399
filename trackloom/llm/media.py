"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images,
written as NPY tiles with difference hashes.

`encode_pgm` stores any payload of a multiple of 64 bytes losslessly as 8-bit grey samples,
64 to a row; `decode_image` reads Netpbm (P1 to P6) and BMP (uncompressed, 1, 4, 8, 24 and
32 bits a pixel). Images and tiles are tables of files in the shared folder; what is
returned is read back from both.

Edge cases: null and empty texts are one row of 64 zero samples; a damaged image, one of no
pixels or of an unknown kind gives nulls for what its pixels would tell, never a failed job;
repeated rows, and rows that repeat an id or have none, are described one by one, equal
texts by equal values; very long texts are stored whole, some MB to a batch; other columns of
the table are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Workspace, source_columns

WIDTH = 64
TILE = (16, 16)


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """raw and bytes 0 up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(gray: np.ndarray) -> bytes:
    """An 8-bit grey BMP, bottom row first, rows padded to four bytes."""
    h, w = gray.shape
    stride = -(-w // 4) * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, :w] = gray[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + body.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at, need, nums = raw[1] - 48, 2, 2 if raw[1] in b"14" else 3, []
    while len(nums) < need:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        nums.append(int(raw[at:end]))
        at = end
    w, h, top = nums[0], nums[1], nums[2] if need == 3 else 1
    if w < 1 or h < 1 or not 1 <= top < 1 << 16:
        raise ValueError("no pixels, or no such range")
    planes = 3 if kind in (3, 6) else 1
    at += 1
    if kind == 4:
        rows = np.frombuffer(raw, np.uint8, h * -(-w // 8), at).reshape(h, -1)
        out = (1 - np.unpackbits(rows, axis=1)[:, :w])[..., None]
    elif kind == 1:
        bits = np.frombuffer(bytes(c for c in raw[at - 1 :] if c in b"01"), np.uint8)[: w * h] - 48
        out = (1 - bits).reshape(h, w, 1)
    elif kind in (2, 3):
        out = np.array(raw[at - 1 :].split()[: w * h * planes], np.int64).reshape(h, w, planes)
    else:
        out = np.frombuffer(raw, np.uint8 if top < 256 else ">u2", w * h * planes, at).reshape(h, w, planes)
    if top != 255:
        out = np.round(out.astype(np.float64) * 255 / top)
    return out.astype(np.uint8)


def _bmp(raw: bytes) -> np.ndarray:
    (at,) = struct.unpack_from("<I", raw, 10)
    size, w, h, _, depth, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed != 0 or depth not in (1, 4, 8, 24, 32) or w < 1 or h == 0:
        raise ValueError("compressed, of an unknown depth, or without pixels")
    colours = struct.unpack_from("<I", raw, 46)[0] or (1 << depth if depth <= 8 else 0)
    stride = (w * depth + 31) // 32 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    if depth <= 8:
        palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        per = 8 // depth
        shift = np.arange(per - 1, -1, -1, dtype=np.uint8) * depth
        index = (rows[:, :, None] >> shift & ((1 << depth) - 1)).reshape(abs(h), -1)[:, :w]
        out = palette[index]
        if (palette[:, :1] == palette).all():
            out = out[..., :1]
    else:
        out = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[..., 2::-1]
    return out if h < 0 else out[::-1]


def decode_image(raw: bytes | None) -> np.ndarray | None:
    """height x width x (1 or 3) bytes; None for what is not a readable Netpbm or BMP image."""
    try:
        if raw and raw[:1] == b"P" and raw[1:2] in b"123456":
            return _netpbm(raw)
        if raw and raw[:2] == b"BM":
            return _bmp(raw)
    except (ValueError, IndexError, struct.error, OverflowError, MemoryError):
        pass
    return None


def area_resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each output pixel is the exact mean of the area it covers, from an integral image that is linear between pixels."""
    h, w, c = img.shape
    total = np.zeros((h + 1, w + 1, c), np.float64)
    total[1:, 1:] = img.astype(np.float64).cumsum(0).cumsum(1)
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(y.astype(np.int64), h - 1), np.minimum(x.astype(np.int64), w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    rows = total[y0] * (1 - fy) + total[y0 + 1] * fy
    grid = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    part = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return part / (h / height * (w / width))


def difference_hash(img: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 area means is below its right neighbour."""
    grey = area_resize(img, 8, 9).mean(2)
    return np.packbits(np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6)).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, held, n, media = 0, [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = t.encode() if isinstance(t, str) else bytes(t or b"")
            held.append(i)
            n.append(len(raw))
            media.append(encode_pgm(pad(raw)))
            size += len(media[-1])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                size, held, n, media = 0, [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


FEATURES = "doc_id bigint, n_bytes bigint, height int, width int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary"


def _features(tile: tuple[int, int]):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, m in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                img = decode_image(m)
                if img is None:
                    rows.append((i, n, None, None, None, None, None, len(m or b""), hashlib.sha256(m or b"").hexdigest(), None, None))
                    continue
                payload = img.tobytes()
                small = npy(np.round(area_resize(img, *tile)).astype(np.uint8))
                rows.append((i, n, img.shape[0], img.shape[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), difference_hash(img), small))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = [c.split()[0] for c in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return features


def image_features(media: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """For (doc_id, n_bytes, media) rows of stored images: shape, digests, difference hash and an NPY tile."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features(tile), FEATURES)


def read_tile(stored: bytes | None) -> np.ndarray | None:
    """The array of an NPY tile; None for null."""
    return None if stored is None else np.lib.format.read_array(io.BytesIO(stored), allow_pickle=False)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's bytes as a grey image in the shared folder, read the images back, describe them, write NPY tiles beside the descriptions, and return these as read back."""
    work = Workspace(docs.sparkSession, "media")
    rows = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    stored = work.stage(rows.mapInArrow(_encoder, "doc_id bigint, n_bytes bigint, media binary"), "images")
    return work.stage(image_features(stored), "tiles")
