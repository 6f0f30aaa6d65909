"""Images as columns: Netpbm and BMP decoded to numpy arrays, area-resized, hashed and kept as NPY tiles."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SPACE = rb"(?:\s|#[^\n]*\n)"
_HEADER = re.compile(rb"P([1-6])" + _SPACE + rb"+(\d+)" + _SPACE + rb"+(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16 of shape (height, width[, 3]); bitmaps are 0 for black and 1 for white."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, width, height = (int(x) for x in head.groups())
    at, depth = head.end(), 1
    if kind in (2, 3, 5, 6):
        top = re.compile(_SPACE + rb"+(\d+)").match(data, at)
        depth, at = int(top[1]), top.end()
        if not 0 < depth < 1 << 16:
            raise ValueError(f"samples up to {depth}")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = int(np.prod(shape))
    if kind == 1:
        bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:count], np.uint8) - 48
        return (1 - bits).reshape(shape)
    if kind in (2, 3):
        numbers = re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count]
        return _within(np.array(numbers, np.uint32), depth).astype(np.uint8 if depth < 256 else np.uint16).reshape(shape)
    at += 1  # one white space ends the header
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at).reshape(height, -1)
        return 1 - np.unpackbits(rows, axis=1)[:, :width]
    unit = np.dtype(np.uint8 if depth < 256 else ">u2")
    return _within(np.frombuffer(data, unit, count, at), depth).astype(unit.newbyteorder("=")).reshape(shape)


def _within(samples: np.ndarray, top: int) -> np.ndarray:
    if len(samples) and int(samples.max()) > top:
        raise ValueError(f"a sample above {top}")
    return samples


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as uint8 of shape (height, width, 3), in RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    number = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=size == 4)
    start, head, width, height, bits = number(10), number(14), number(18), number(22), number(28, 2)
    if number(30) not in (0, 3):
        raise ValueError("compressed BMP")
    if bits not in (1, 4, 8, 24, 32) or number(30) == 3 and bits != 32:
        raise ValueError(f"BMP of {bits} bits a pixel")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if bits <= 8:
        places = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
        places = (places @ (1 << np.arange(bits)[::-1])).astype(int)[:, :width]
        colours = np.frombuffer(data, np.uint8, (number(46) or 1 << bits) * 4, 14 + head).reshape(-1, 4)
        pixels = colours[places][:, :, 2::-1]
    elif number(30) == 3:  # each channel has a mask
        whole = rows[:, : width * 4].copy().view("<u4")
        channels = []
        for at in (54, 58, 62):
            mask = int.from_bytes(data[at : at + 4], "little")
            low = (mask & -mask).bit_length() - 1 if mask else 0
            channels.append(np.rint(((whole & mask) >> low) * (255.0 / max(mask >> low, 1))))
        pixels = np.stack(channels, 2).astype(np.uint8)
    else:
        pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(pixels[::-1] if height > 0 else pixels)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of (height, width, 3) samples in RGB."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    number = lambda x, size=4: x.to_bytes(size, "little")
    head = number(40) + number(width) + number(height) + number(1, 2) + number(24, 2) + number(0) + number(rows.size) + bytes(16)
    return b"BM" + number(54 + rows.size) + bytes(4) + number(54) + head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The stored samples of a Netpbm or BMP image."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def shades(data: bytes) -> np.ndarray:
    """The image with black at 0 and white at the largest number of its type, whatever its format calls white."""
    pixels = decode(data)
    kind = data[1:2] if data[:1] == b"P" else b""
    top = 1 if kind in (b"1", b"4") else int(re.compile(_SPACE + rb"+(\d+)").match(data, _HEADER.match(data).end())[1]) if kind else 255
    full = np.iinfo(pixels.dtype).max
    return pixels if top == full else np.rint(pixels * (full / max(top, 1))).clip(0, full).astype(pixels.dtype)


#: Rows of an integral image that are made at a time.
BAND_ROWS = 1 << 14


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image that is interpolated at fractional borders; only its rows beside a border are kept."""
    rows, columns = pixels.shape[:2]

    def borders(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.linspace(0, size, parts + 1)
        low = np.minimum(at.astype(int), size - 1)
        return low, at - low

    (top, f), (left, g) = borders(rows, height), borders(columns, width)
    needed = np.unique(np.r_[top, top + 1])
    kept, total = np.zeros((len(needed), columns + 1)), np.zeros(columns + 1)
    for a in range(0, rows, BAND_ROWS):
        band = pixels[a : a + BAND_ROWS]
        grey = band if band.ndim == 2 else band @ np.array([0.299, 0.587, 0.114])
        sums = np.zeros((len(band) + 1, columns + 1))
        sums[1:, 1:] = grey.cumsum(0, dtype=float).cumsum(1)
        sums += total
        some = (needed >= a) & (needed <= a + len(band))
        kept[some] = sums[needed[some] - a]
        total = sums[-1]
    place = np.searchsorted(needed, top)
    lines = kept[place] * (1 - f)[:, None] + kept[place + 1] * f[:, None]
    corners = lines[:, left] * (1 - g) + lines[:, left + 1] * g
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / (rows * columns / (height * width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, in hex: whether each of 8 x 9 area means is below its right neighbour."""
    small = area_resize(pixels, 8, 9)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def to_npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


#: Samples in a row of the images that carry texts.
WIDTH = 64


def text_image(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, and a PGM of them: 64 samples a row, zeros to the end of the last, one row at least."""
    data = (text or "").encode()
    padded = data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")
    return len(data), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


_SCHEMA = "n_bytes long, tile binary, height int, width int, feature string"


def text_tiles(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` without the text column, with the NPY tile of its image: n_bytes, tile, height, width, feature (the difference hash).

    Each text becomes a PGM, which is decoded as any image column is, and its
    pixels are kept as an NPY tile.  Rows are worked on one at a time; nothing
    is shuffled.  Null texts count as empty; equal texts give equal tiles.
    """
    kept = [x for x in texts.columns if x not in (text, "n_bytes", "tile", "height", "width", "feature")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # tiles are as large as texts: a few at a time
                part = batch.slice(at, 256)
                sizes, tiles, shapes, features = [], [], [], []
                for value in part.column(len(kept)):
                    size, image = text_image(value.as_py())
                    pixels = decode(image)
                    sizes.append(size)
                    tiles.append(to_npy(pixels))
                    shapes.append(pixels.shape)
                    features.append(difference_hash(pixels))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(tiles, pa.binary()), *(pa.array([x[i] for x in shapes], pa.int32()) for i in (0, 1)), pa.array(features, pa.string())],
                    names=[*kept, "n_bytes", "tile", "height", "width", "feature"],
                )

    narrow = texts.select(*kept, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), _SCHEMA])
    return narrow.mapInArrow(run, schema)


def image_tiles(images: DataFrame, image: str, height: int, width: int) -> DataFrame:
    """``images`` with the decoded image, area-resized to height x width, as an NPY tile and its difference hash; null where it can't be decoded: damaged, cut short, without pixels, or with samples above its white.

    Tiles have 8 bits a sample, or 16 where the image has; white is the largest number of either.
    """
    kept = [x for x in images.columns if x not in ("tile", "feature")]
    place = kept.index(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, features = [], []
            for value in batch.column(place).to_pylist():
                try:
                    pixels = shades(value or b"")
                    if not pixels.size:
                        raise ValueError("an image without pixels")
                except (ValueError, TypeError, IndexError, OverflowError):
                    tiles.append(None)
                    features.append(None)
                    continue
                tiles.append(to_npy(np.rint(area_resize(pixels, height, width)).astype(pixels.dtype)))
                features.append(difference_hash(pixels))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles, pa.binary()), pa.array(features, pa.string())], names=[*kept, "tile", "feature"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*kept).schema.fields), "tile binary", "feature string"])
    return images.select(*kept).mapInArrow(run, schema)
