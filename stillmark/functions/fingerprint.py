"""Frame fingerprints from pixels: numpy kernels on whole Arrow batches of images.

Sums of pixels run in single precision and in reading order, as bits are set by comparing such sums: solid pictures sit
exactly on the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

GRID, LAYOUT, BINS = 16, 4, 64
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
SIGNATURE = "dhash long, " + ", ".join(f"s{i} long" for i in range(16)) + ", color array<int>, color_total long, spatial array<int>, luma float"


def rgb(data: bytes, width: int, height: int, channels: int, order: str = "RGB") -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, :3]
    return pixels[:, :, ::-1] if order == "BGR" else pixels


def luma(pixels: np.ndarray) -> np.ndarray:
    f = pixels.astype(np.float32)
    return np.float32(0.299) * f[:, :, 0] + np.float32(0.587) * f[:, :, 1] + np.float32(0.114) * f[:, :, 2]


def _sequential(values: np.ndarray) -> np.float32:
    return np.cumsum(values.ravel(), dtype=np.float32)[-1] if values.size else np.float32(0)


def _boxes(plane: np.ndarray, rows: list[tuple[int, int]], cols: list[tuple[int, int]]) -> np.ndarray:
    return np.array([[_sequential(b := plane[y0:y1, x0:x1]) / np.float32(max(1, b.size)) for x0, x1 in cols] for y0, y1 in rows], np.float32)


def _overlapping(size: int, n: int) -> list[tuple[int, int]]:
    r = size / n
    return [(int(i * r), min(size, max(int(np.ceil((i + 1) * r)), int(i * r) + 1))) for i in range(n)]


def _disjoint(size: int, n: int) -> list[tuple[int, int]]:
    r = size / n
    return [(int(i * r), max(int((i + 1) * r), int(i * r) + 1)) for i in range(n)]


def gray(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Box means whose borders round outwards, so neighbours may share pixels."""
    y = luma(pixels)
    return _boxes(y, _overlapping(y.shape[0], height), _overlapping(y.shape[1], width))


def cells(plane: np.ndarray, n: int) -> np.ndarray:
    """Box means whose borders round down, so cells are disjoint."""
    return _boxes(plane.astype(np.float32), _disjoint(plane.shape[0], n), _disjoint(plane.shape[1], n))


def difference_hash(gray98: np.ndarray) -> int:
    """A bit for each pixel darker than its right neighbour; the first half of the bits in the high word."""
    bits = (gray98[:, :-1] < gray98[:, 1:]).ravel()
    high, low = (int(np.packbits(h, bitorder="little").view("<u4")[0]) for h in (bits[:32], bits[32:]))
    return high << 32 | low


def structure_hash(pixels: np.ndarray) -> bytes:
    """For luma, red, green and blue a bit for each of 256 cells that is at least the mean of the grid."""
    out = []
    for plane in (luma(pixels), *(pixels[:, :, c] for c in range(3))):
        grid = cells(plane, GRID)
        mean = _sequential(grid) / np.float32(grid.size)
        out.append(np.packbits(grid.ravel() >= mean, bitorder="little").tobytes())
    return b"".join(out)


def color_histogram(pixels: np.ndarray) -> np.ndarray:
    h, w = pixels.shape[:2]
    step = max(1, int(np.floor(np.sqrt(w * h / 65536))))
    p = pixels[::step, ::step].astype(np.int64) >> 6
    counts = np.bincount(((p[:, :, 0] << 4) | (p[:, :, 1] << 2) | p[:, :, 2]).ravel(), minlength=BINS).astype(np.float32)
    return counts / np.float32(max(1, p.shape[0] * p.shape[1]))


def quantized(histogram: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(histogram.astype(np.float32) * np.float32(255) + np.float32(0.5)), 0, 255).astype(np.int32)


def spatial_layout(pixels: np.ndarray) -> np.ndarray:
    grids = [cells(pixels[:, :, c], LAYOUT).ravel() for c in range(3)]
    return np.clip(np.floor(np.concatenate(grids) + 0.5), 0, 255).astype(np.int32)


def ssim(a: np.ndarray, b: np.ndarray, win: int = 8) -> float:
    """Mean structural similarity over tiled 8x8 blocks, sample variances, not below 0."""
    h, w = a.shape[0] // win * win, a.shape[1] // win * win
    if not h or not w:
        return 0.0
    x, y = (m[:h, :w].astype(np.float64).reshape(h // win, win, w // win, win).transpose(0, 2, 1, 3).reshape(-1, win * win) for m in (a, b))
    mx, my = x.mean(1), y.mean(1)
    dx, dy = x - mx[:, None], y - my[:, None]
    n = win * win - 1
    vx, vy, cov = (dx * dx).sum(1) / n, (dy * dy).sum(1) / n, (dx * dy).sum(1) / n
    score = (2 * mx * my + C1) * (2 * cov + C2) / ((mx * mx + my * my + C1) * (vx + vy + C2))
    return float(max(0.0, score.mean()))


def signature(pixels: np.ndarray) -> dict:
    small = gray(pixels, 9, 8)
    words = np.frombuffer(structure_hash(pixels), "<i8")
    color = quantized(color_histogram(pixels))
    return {
        "dhash": int(np.uint64(difference_hash(small)).view(np.int64)),
        **{f"s{i}": int(x) for i, x in enumerate(words)},
        "color": color.tolist(),
        "color_total": int(color.sum()),
        "spatial": spatial_layout(pixels).tolist(),
        "luma": float(_sequential(small) / np.float32(small.size)),
    }


def with_signature(images: DataFrame, id_columns: list[str], order: str = "BGR") -> DataFrame:
    """Fingerprints of Spark's ``image`` structs (BGR); undecodable images give no row."""
    kept = images.select(*id_columns, "image.width", "image.height", "image.nChannels", "image.data").where("width > 0 and height > 0 and nChannels >= 3")
    fields = ", ".join(f"{c} {t}" for c, t in kept.select(*id_columns).dtypes)
    schema = T.StructType.fromDDL(f"{fields}, {SIGNATURE}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [{**{c: r[c] for c in id_columns}, **signature(rgb(r["data"], r["width"], r["height"], r["nChannels"], order))} for r in rows]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return kept.mapInArrow(run, schema)


def pack_frame(dhash: F.Column, words: list, color, spatial, frame_index, time_ms):
    """The 256-byte record of a frame: hash, structure, colours, layout, frame number and time, little-endian."""
    little = lambda c, n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(c), 2 * n, "0"), F.lit("(..)"))), ""))
    byte = lambda a: F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    return F.concat(little(dhash, 8), *[little(w, 8) for w in words], byte(color), byte(spatial), little(frame_index, 4), little(time_ms, 4))


def unpack_frame(record):
    """The fields of a 256-byte record as columns; short records are padded with zero bytes."""
    full = F.rpad(F.hex(record), 512, "0")

    def little(at: int, n: int):
        text = F.array_join(F.reverse(F.regexp_extract_all(F.substring(full, 2 * at + 1, 2 * n), F.lit("(..)"))), "")
        return F.conv(text, 16, -10).cast("long") if n < 8 else F.shiftleft(F.conv(F.substring(text, 1, 8), 16, -10).cast("long"), 32).bitwiseOR(F.conv(F.substring(text, 9, 8), 16, -10).cast("long"))

    def numbers(at: int, n: int):
        return F.transform(F.regexp_extract_all(F.substring(full, 2 * at + 1, 2 * n), F.lit("(..)")), lambda x: F.conv(x, 16, -10).cast("int"))

    return {"dhash": little(0, 8), **{f"s{i}": little(8 + 8 * i, 8) for i in range(16)}, "color": numbers(136, 64), "spatial": numbers(200, 48), "frame_index": little(248, 4), "time_ms": little(252, 4)}
