"""Kernels over small images as numpy functions, applied in Arrow batches: one image is one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned; in single precision for pictures of bytes, else in double."""
    kind = np.float32 if image.dtype == np.uint8 else np.float64
    a = image
    for axis, n in ((0, height), (1, width)):
        at = np.clip((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0, a.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, a.shape[axis] - 1)
        part = (at - low).astype(kind).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        near, far = np.take(a, low, axis).astype(kind), np.take(a, high, axis).astype(kind)
        a = near + (far - near) * part
    return a


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """size * size bits, row by row: whether a cell is darker than the one to its right."""
    small = resize(grey(image), size, size + 1)
    return "".join("1" if x else "0" for x in (small[:, 1:] > small[:, :-1]).ravel())


def offset_wrap(image: np.ndarray) -> np.ndarray:
    """Rolled by half in both directions, so that the edges meet in the middle."""
    return np.roll(image, (image.shape[0] // 2, image.shape[1] // 2), (0, 1))


def edge_score(a: np.ndarray, b: np.ndarray) -> float:
    d = a.astype(np.float64) - b.astype(np.float64)
    return float(np.clip(1 - (np.abs(d).mean() + np.sqrt((d * d).mean())) / 2 / 255, 0, 1))


def seam_scores(image: np.ndarray) -> tuple[float, float, float]:
    """How well left and right, and top and bottom, fit; and the lesser of the two."""
    x, y = edge_score(image[:, 0], image[:, -1]), edge_score(image[0], image[-1])
    return x, y, min(x, y)


def noise_sigma(image: np.ndarray) -> float:
    """Immerkaer's estimate from the second differences of second differences."""
    g = grey(image).astype(np.float64)
    if min(g.shape) < 3:
        return 0.0
    rows = g[:, :-2] - 2 * g[:, 1:-1] + g[:, 2:]
    k = rows[:-2] - 2 * rows[1:-1] + rows[2:]
    return float(np.abs(k).mean() * np.sqrt(np.pi / 2) / 6)


def diffuse(image: np.ndarray, levels: int = 2) -> np.ndarray:
    """Error diffusion to so many grey levels."""
    from .filters import error_diffusion

    steps = np.repeat(np.linspace(0, 255, levels)[:, None], 3, 1)
    return error_diffusion(np.repeat(grey(image)[..., None], 3, -1), steps)[..., 0]


def boxes(mask: np.ndarray, least: int = 1) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of 4-connected regions of at least so many pixels, from top to bottom, left to right."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:  # the least label of its neighbours, then of that pixel, until nothing changes
        new = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            both = mask[a] & mask[b]
            for side in (a, b):
                new[side] = np.where(both, np.minimum(new[a], new[b]), new[side])
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(mask, flat[new], 0)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[mask]):
        y, x = np.nonzero(label == k)
        if len(y) >= least:
            out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return sorted(out, key=lambda b: (b[1], b[0]))


def white_balance(image: np.ndarray, p: float = 6.0) -> np.ndarray:
    """Gains from the p-norm of each channel, so that their norms become equal."""
    a = image[..., :3].astype(np.float64)
    norm = np.maximum((a**p).mean(axis=(0, 1)) ** (1 / p), 1e-6)
    return np.clip(a * (norm.mean() / norm), 0, 255).astype(np.uint8)


def kernel_report(vectors: DataFrame, side: int = 8) -> DataFrame:
    """vec_id, mean, seam, noise, hash, white share of the dithered picture and number of regions, from vectors of
    side * side numbers taken as grey pictures. Vectors of another length or null give nulls."""

    def run(it):
        for b in it:
            rows = []
            for v in b.column(1).to_pylist():
                if v is None or len(v) != side * side:
                    rows.append((None,) * 6)
                    continue
                image = np.clip((np.array(v) + 0.5) * 255, 0, 255).astype(np.uint8).reshape(side, side)
                rows.append((round(float(image.mean()), 6), round(seam_scores(image)[2], 6), round(noise_sigma(image), 6), difference_hash(image), round(float((diffuse(image) > 0).mean()), 6), len(boxes(image > 140))))
            kinds = [pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.int32()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["vec_id", "mean", "seam", "noise", "hash", "white", "regions"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, mean double, seam double, noise double, hash string, white double, regions int")
