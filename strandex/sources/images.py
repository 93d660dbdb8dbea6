"""Frame statistics from image bytes: size, brightness, sharpness, difference hash; resizing of frames.

Decoding needs a library; without Pillow, binary PGM and PPM are read here. Whatever can't be decoded has null statistics, which the filters
count as blank and blurry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex import schemas

#: Thresholds of the cleaning filters (fixed values).
LEAST_BYTES, LEAST_MEAN, LEAST_STD, LEAST_SHARPNESS = 3000, 8.0, 3.0, 10.0


def decode(body: bytes) -> np.ndarray | None:
    """Pixels as height x width x channels, or None."""
    try:
        if body[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while body[at : at + 1].isspace():
                    at += 1
                if body[at : at + 1] == b"#":
                    at = body.index(b"\n", at)
                    continue
                end = at
                while not body[end : end + 1].isspace():
                    end += 1
                head.append(int(body[at:end]))
                at = end
            w, h, _ = head
            n = 1 if body[:2] == b"P5" else 3
            return np.frombuffer(body, np.uint8, w * h * n, at + 1).reshape(h, w, n)
        import io

        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(body)).convert("RGB"))
    except Exception:
        return None


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., 0].astype(float) if pixels.shape[2] == 1 else pixels[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def laplacian_variance(g: np.ndarray) -> float:
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def shrink(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over a grid of equal areas."""
    def weights(n: int, k: int) -> np.ndarray:
        edge = np.linspace(0, n, k + 1)
        lo, hi = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
        return np.maximum(0, hi - lo) * k / n

    return weights(g.shape[0], height) @ g @ weights(g.shape[1], width).T


def dhash(g: np.ndarray, size: int = 8) -> int:
    """A bit for each place of a size x size grid that is brighter than its right neighbour, as a signed 64-bit number."""
    s = shrink(g, size, size + 1)
    value = int("".join("1" if x else "0" for x in (s[:, :-1] > s[:, 1:]).ravel()), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def frame_statistics(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, n, body in zip(p["path"], p["length"], p["content"], strict=True):
                px = decode(body)
                if px is None:
                    rows.append((name, n, None, None, None, None, None, None))
                else:
                    g = grey(px)
                    rows.append((name, n, px.shape[1], px.shape[0], g.mean(), g.std(), laplacian_variance(g), dhash(g)))
            out = pd.DataFrame(rows, columns=[f.name for f in schemas.FRAME_STATS])
            yield out.astype({"width": "Int32", "height": "Int32", "dhash": object})

    return files.select("path", "length", "content").mapInPandas(run, schemas.FRAME_STATS)


def encode(pixels: np.ndarray) -> bytes:
    """Binary PGM or PPM, which need no library."""
    p = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P%d\n%d %d\n255\n" % (5 if p.shape[2] == 1 else 6, p.shape[1], p.shape[0]) + p.tobytes()


def resized(frames: DataFrame, longest: int | None = None, shortest: int | None = None, content: str = "content") -> DataFrame:
    """frames with their content scaled down to at most so long a long or short side, by means over equal areas; images that are small enough, and bytes that
    can't be decoded, stay as they are."""

    def one(body):
        px = decode(body) if body is not None else None
        if px is None:
            return body
        h, w, n = px.shape
        scale = longest / max(w, h) if longest else shortest / min(w, h)
        if scale >= 1:
            return body
        width, height = (max(1, int(x * scale)) if longest else round(x * scale) for x in (w, h))
        return encode(np.stack([shrink(px[..., k].astype(float), height, width) for k in range(n)], axis=2))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{content: [one(b) for b in p[content]]})

    return frames.mapInPandas(run, frames.schema)


def is_blank(n_bytes: Column, mean: Column, std: Column) -> Column:
    """The cheap test of the file's size first, then the pixels'; what isn't known is blank."""
    return (F.coalesce(n_bytes, F.lit(0)) < LEAST_BYTES) | (F.coalesce(mean, F.lit(0.0)) < LEAST_MEAN) | (F.coalesce(std, F.lit(0.0)) < LEAST_STD)


def is_blurry(sharpness: Column) -> Column:
    return F.coalesce(sharpness, F.lit(0.0)) < LEAST_SHARPNESS


def frame_times(frames: DataFrame, by: str, fps: float) -> DataFrame:
    """Adds frame_idx and ts = frame_idx / fps, by the order of names."""
    from strandex.operators.sequence import Window

    return frames.withColumn("frame_idx", F.row_number().over(Window.partitionBy(by).orderBy("path")) - 1).withColumn("ts", F.col("frame_idx") / F.lit(float(fps)))


__all__ = ["decode", "dhash", "encode", "frame_statistics", "frame_times", "grey", "is_blank", "is_blurry", "laplacian_variance", "resized", "shrink"]
