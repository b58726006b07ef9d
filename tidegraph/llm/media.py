"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral images, NPY tiles and difference hashes."""

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

from tidegraph.llm.common import sliced

#: Bytes of a row of samples, the unit payloads are padded to.
UNIT = 576
TILE = (8, 9)
_BAND = 4096


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header behind its magic, comments skipped, and where the samples start."""
    out, at = [], 2
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                while at < len(data) and data[at] not in b"\r\n":
                    at += 1
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if at == start:
            raise ValueError("broken Netpbm header")
        out.append(int(data[start:at]))
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with samples of up to 8 bits, scaled to 0 to 255, as (height, width) or (height, width, 3); bitmaps have 0 for black."""
    kind = data[1] - 48
    (width, height, *most), at = _header(data, 2 if kind in (1, 4) else 3)
    if width < 1 or height < 1 or most and not 0 < most[0] < 256:
        raise ValueError("unsupported Netpbm size or depth")
    depth = 3 if kind in (3, 6) else 1
    need = width * height * depth
    if kind == 4:
        row = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, row * height, at).reshape(height, row)
        return (1 - np.unpackbits(raw, axis=1)[:, :width]) * np.uint8(255)
    if kind in (5, 6):
        flat = np.frombuffer(data, np.uint8, need, at)
    elif kind == 1:
        flat = (1 - np.array([c - 48 for c in data[at - 1 :] if c in b"01"][:need], np.uint8)) * np.uint8(255)
    else:
        flat = np.array([int(x) for x in data[at - 1 :].split()[:need]], np.int64)
    if len(flat) < need:
        raise ValueError("Netpbm samples missing")
    if most and len(flat) and int(flat.max()) > most[0]:
        raise ValueError("a Netpbm sample is over its greatest value")
    if most and (most[0] < 255 or flat.dtype != np.uint8):
        flat = ((flat.astype(np.int64) * 255 + most[0] // 2) // most[0]).astype(np.uint8)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, as (height, width, 3)."""
    offset, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    up, height = height > 0, abs(height)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width < 1 or height < 1:
        raise ValueError("unsupported BMP")
    # bit fields are read where they are those of plain 32-bit pixels
    if packed == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("unsupported BMP bit fields")
    row = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, row * height, offset).reshape(height, row)[:, : width * bits // 8].reshape(height, width, bits // 8)
    if bits == 8:
        head, used = struct.unpack_from("<I", data, 14)[0], struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)
        raw = palette[raw[:, :, 0]]
    out = raw[:, :, 2::-1]
    return out[::-1] if up else out


def decode_image(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: bytes, width: int = UNIT) -> bytes:
    """An 8-bit binary greymap of rows of `width` samples."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, fractions of samples included, by an integral image.

    The integral is kept only at rows that cell edges touch, and rows are summed in bands, so memory stays bounded.
    """
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width) for c in range(image.shape[2])], axis=2)
    h, w = image.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    total, rows = np.zeros(w + 1), {}
    want = sorted({int(v) for v in np.floor(ys)} | {min(h, int(v) + 1) for v in np.floor(ys)})
    at, k = 0, 0
    while k < len(want) and want[k] == 0:
        rows[0] = total.copy()
        k += 1
    while at < h and k < len(want):
        end = min(h, at + _BAND, want[k])
        total[1:] += np.cumsum(image[at:end].sum(0, dtype=np.float64))
        at = end
        if at == want[k]:
            rows[at] = total.copy()
            k += 1
    y0 = np.minimum(np.floor(ys).astype(int), h)
    fy = (ys - y0)[:, None]
    low = np.stack([rows[v] for v in y0])
    high = np.stack([rows[min(h, v + 1)] for v in y0])
    lines = low * (1 - fy) + high * fy
    x0 = np.minimum(np.floor(xs).astype(int), w)
    fx = xs - x0
    at_x = lines[:, x0] * (1 - fx) + lines[:, np.minimum(x0 + 1, w)] * fx
    cell = at_x[1:, 1:] - at_x[:-1, 1:] - at_x[1:, :-1] + at_x[:-1, :-1]
    return cell / ((ys[1:] - ys[:-1])[:, None] * (xs[1:] - xs[:-1]))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(tile: np.ndarray) -> int:
    """A bit for each cell that is darker than the one on its right: 64 for 8 rows of 9."""
    return int.from_bytes(np.packbits((grey(tile)[:, :-1] < grey(tile)[:, 1:]).ravel()).tobytes(), "big")


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.rint(tile).astype(np.uint8), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def media_features(media: DataFrame, key_cols: list[str], media_col: str = "media") -> DataFrame:
    """key columns, height, width, dhash (16 hex digits), tile (NPY bytes), error: one row per input row.

    Null, empty or broken media give nulls and the reason in error; repeated rows repeat; extra columns are not read.
    """
    fields = [media.schema[k] for k in key_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", height int, width int, dhash string, tile binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            out: list[tuple] = []
            for x in b.column(len(key_cols)):
                try:
                    image = decode_image(x.as_py() or b"")
                    tile = area_resize(image, *TILE)
                    out.append((*image.shape[:2], f"{difference_hash(tile):016x}", npy_tile(tile), None))
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    out.append((None, None, None, None, str(e)[:200]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(key_cols))), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*key_cols, "height", "width", "dhash", "tile", "error"])

    return media.select(*key_cols, media_col).mapInArrow(run, schema)


def payload_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as the
    samples of a greymap 576 wide. Null texts are empty: one row of padding."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [encode_pgm(x + b"\xff" * (-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_digests(images: DataFrame) -> DataFrame:
    """Decodes stored media: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tile)
    of images (doc_id, n_bytes, media), one row per input row; tile: NPY bytes of the area-resized image. Repeated rows
    repeat, an empty table gives an empty result, extra columns are not read; broken media raise: they are our own."""
    kind = images.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            rows = []
            for x in b.column(2):
                data = x.as_py()
                image = decode_image(data)
                payload = image.tobytes()
                tile = area_resize(image, *TILE)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), npy_tile(tile)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return images.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary")


def tile_features(tiles: DataFrame) -> DataFrame:
    """Reads stored NPY tiles back: the columns of tiles but tile, and feature: the difference hash and the tile's CRC-32."""
    rest = [c for c in tiles.columns if c != "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(len(rest)).to_pylist()
            found = [f"{difference_hash(np.load(io.BytesIO(x), allow_pickle=False)):016x}-{zlib.crc32(x):08x}" for x in raw]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], [*rest, "feature"])

    return tiles.select(*rest, "tile").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema if f.name != "tile") + ", feature string")
