"""Background and star detection on whole frames, in numpy, a frame a task step.

The background is a mesh of 64-pixel boxes, each clipped to three sigma, with a
3 by 3 median filter.  Stars are connected groups of five or more pixels over
background + 3 sigma on the image as it is, split where a group has several
peaks with a share of its flux, and cleaned of those that their neighbours'
wings explain.  Kron radii and elliptical fluxes follow from the moments.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nightglass import schemas as S
from nightglass.sources import scan

#: Pixels of one group's levels that are labelled together.
LABELLED = 1 << 18
NAMES = [c.split()[0] for c in S.STARS.split(", ")]


@dataclass(frozen=True)
class Detection:
    box: int = 64
    filter_size: int = 3
    sigmas: float = 3.0
    min_area: int = 5
    levels: int = 32
    contrast: float = 0.005
    clean: float = 1.0
    max_stars: int | None = None


def _clipped(px: np.ndarray) -> tuple[float, float]:
    """Mode estimate and deviation of values after clipping at three deviations around the median."""
    px = px[np.isfinite(px)].astype(np.float64)
    if not len(px):
        return 0.0, 0.0
    while True:
        middle, spread = np.median(px), px.std()
        kept = px[np.abs(px - middle) <= 3 * spread] if spread > 0 else px
        if len(kept) == len(px) or not len(kept):
            break
        px = kept
    mean = px.mean()
    mode = 2.5 * middle - 1.5 * mean if spread > 0 and abs(mean - middle) < 0.3 * spread else middle
    return float(mode if spread > 0 else mean), float(spread)


def _median_filter(mesh: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    padded = np.pad(mesh, r, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3))


def background_mesh(image: np.ndarray, how: Detection = Detection()) -> tuple[np.ndarray, np.ndarray]:
    """Filtered levels and deviations of the boxes."""
    h, w = image.shape
    rows, cols = -(-h // how.box), -(-w // how.box)
    cells = np.array([[_clipped(image[i * how.box : (i + 1) * how.box, j * how.box : (j + 1) * how.box].ravel()) for j in range(cols)] for i in range(rows)])
    return _median_filter(cells[..., 0], how.filter_size), _median_filter(cells[..., 1], how.filter_size)


def background(image: np.ndarray, how: Detection = Detection()) -> dict[str, float]:
    level, spread = background_mesh(image, how)
    low, high = float(level.min()), float(level.max())
    return {"median": float(np.median(level)), "rms": float(np.median(spread)), "min": low, "max": high, "uniformity": 1 - (high - low) / high if high > 0 else 1.0}


def _labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the groups of true pixels that touch, corners included, from 1."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros(mask.shape, np.int32), 0
    number = np.full(mask.shape, -1, np.int64)
    number[ys, xs] = np.arange(len(ys))
    parent = np.arange(len(ys))
    pairs = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        y, x = ys + dy, xs + dx
        ok = (y < mask.shape[0]) & (x >= 0) & (x < mask.shape[1])
        other = np.full(len(ys), -1)
        other[ok] = number[y[ok], x[ok]]
        pairs.append(np.stack((np.flatnonzero(other >= 0), other[other >= 0])))
    a, b = np.concatenate(pairs, axis=1)
    while True:  # hang roots under the least neighbour's root, then shorten
        ra, rb = parent[a], parent[b]
        if (ra == rb).all():
            break
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    _, names = np.unique(parent, return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    out[ys, xs] = names + 1
    return out, int(names.max()) + 1


def _branches(cut: np.ndarray, inside: np.ndarray, steps: np.ndarray, min_area: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Each level, the numbers of a group's pixels over it by those that touch, and the numbers that ``min_area`` pixels have.

    Levels are labelled together, one below the other with an empty row
    between, as many as ``LABELLED`` pixels allow.
    """
    h, w = cut.shape
    some = max(1, LABELLED // ((h + 1) * w))
    for i in range(0, len(steps), some):
        levels = steps[i : i + some]
        stack = np.zeros((len(levels), h + 1, w), bool)
        stack[:, :h] = inside & (cut > levels[:, None, None])
        names, n = _labels(stack.reshape(-1, w))
        names = names.reshape(stack.shape)[:, :h]
        large = np.flatnonzero(np.bincount(names.ravel(), minlength=n + 1)[1:] >= min_area) + 1
        # numbers rise from level to level
        ends = np.searchsorted(large, np.maximum.accumulate(names.reshape(len(levels), -1).max(1)), "right")
        for level, own, first, last in zip(levels, names, [0, *ends[:-1]], ends):
            yield level, own, large[first:last]


def _split(cut: np.ndarray, inside: np.ndarray, threshold: float, how: Detection) -> list[np.ndarray]:
    """Masks of the parts of one group: branches of its levels that hold enough of its flux, other pixels going to the nearest."""
    peak = float(cut[inside].max())
    total = float((cut[inside] - threshold).sum())
    if peak <= threshold or threshold <= 0:
        steps = threshold + (peak - threshold) * np.arange(1, how.levels) / how.levels
    else:
        steps = threshold * (peak / threshold) ** (np.arange(1, how.levels) / how.levels)
    seeds: list[np.ndarray] = [inside]
    for level, names, large in _branches(cut, inside, steps, how.min_area):
        if len(large) < 2:
            continue
        grown: list[np.ndarray] = []
        for seed in seeds:
            # a branch of the group lies in one seed or in none, as levels rise
            own = np.intersect1d(names[seed], large)
            strong = [p for p in (names == k for k in own) if float((cut[p] - level).sum()) > how.contrast * total] if len(own) > 1 else []
            grown += strong if len(strong) > 1 else [seed]
        seeds = grown
    if len(seeds) == 1:
        return [inside]
    ys, xs = np.nonzero(inside)
    peaks = [np.unravel_index(np.argmax(np.where(s, cut, -np.inf)), cut.shape) for s in seeds]
    distance = np.stack([np.where(s[ys, xs], -1.0, np.hypot(ys - p[0], xs - p[1])) for s, p in zip(seeds, peaks)])
    owner = distance.argmin(0)
    out = []
    for k in range(len(seeds)):
        m = np.zeros_like(inside)
        m[ys[owner == k], xs[owner == k]] = True
        out.append(m)
    return out


def _ellipse_sum(image: np.ndarray, x: float, y: float, form: tuple[float, float, float], r: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pixels inside ``r`` in the ellipse's own distance, and those distances."""
    y0, y1 = max(0, int(y - reach) - 1), min(image.shape[0], int(y + reach) + 2)
    x0, x1 = max(0, int(x - reach) - 1), min(image.shape[1], int(x + reach) + 2)
    yy, xx = np.mgrid[y0:y1, x0:x1]
    cxx, cyy, cxy = form
    distance = np.sqrt(np.maximum(0, cxx * (xx - x) ** 2 + cyy * (yy - y) ** 2 + cxy * (xx - x) * (yy - y)))
    held = distance <= r
    return image[y0:y1, x0:x1][held], distance[held]


def _measure(image: np.ndarray, y0: int, x0: int, mask: np.ndarray, threshold: float, noise: float, flag: int) -> dict:
    ys, xs = np.nonzero(mask)
    values = image[ys + y0, xs + x0].astype(np.float64)
    weights = values - threshold
    if weights.sum() <= 0:
        weights = np.ones_like(values)
    total = weights.sum()
    x, y = (weights * (xs + x0)).sum() / total, (weights * (ys + y0)).sum() / total
    dx, dy = xs + x0 - x, ys + y0 - y
    x2, y2, xy = (weights * dx * dx).sum() / total, (weights * dy * dy).sum() / total, (weights * dx * dy).sum() / total
    if x2 * y2 - xy * xy < 0.00694:  # a line or a point: the variance of a pixel is added
        x2, y2 = x2 + 1 / 12, y2 + 1 / 12
    half, root = (x2 + y2) / 2, np.sqrt(((x2 - y2) / 2) ** 2 + xy * xy)
    a, b = np.sqrt(half + root), np.sqrt(max(half - root, 0.0))
    theta = 0.5 * np.arctan2(2 * xy, x2 - y2)
    det = max(x2 * y2 - xy * xy, 1e-12)
    form = (y2 / det, x2 / det, -2 * xy / det)
    flux = float(weights.sum())
    edge = mask.shape and (min(xs + x0) == 0 or min(ys + y0) == 0 or max(xs + x0) == image.shape[1] - 1 or max(ys + y0) == image.shape[0] - 1)
    near, distance = _ellipse_sum(image, x, y, form, 6.0, 6.0 * a)
    lifted = near.astype(np.float64) - (threshold - 3 * noise)
    kron = float((lifted * distance).sum() / lifted.sum()) if len(lifted) and lifted.sum() > 0 and (lifted * distance).sum() > 0 else 0.0
    auto, err = flux, 0.0
    if kron > 0:
        scale = 2.5 * kron
        inside, _ = _ellipse_sum(image, x, y, form, scale, scale * a)
        auto = float((inside.astype(np.float64) - (threshold - 3 * noise)).sum())
        err = float(np.sqrt(max(0.0, len(inside) * noise**2 + max(auto, 0.0))))
    return {"x": x, "y": y, "flux": flux, "peak": float(values.max()), "a": a, "b": b, "theta": theta, "eccentricity": float(np.sqrt(1 - b * b / (a * a))) if a else 0.0, "fwhm": (a + b) / 2, "kron_radius": kron, "flux_auto": auto, "fluxerr_auto": err, "npix": len(xs), "elongation": a / b if a > 0 and b > 0 else 1.0, "flag": flag | (8 if edge else 0), "_form": form}


def _cleaned(stars: list[dict], threshold: float, how: Detection) -> list[dict]:
    """Without the stars whose mean lies under the wing, a Moffat profile, of a brighter neighbour.

    A wing is looked at within three of its star's ellipses.  Kept stars are
    listed in the cells that they reach, so that a star is compared with its
    neighbours only.
    """
    out: list[dict] = []
    cell = max(4.0, 3 * float(np.median([s["a"] for s in stars]))) if stars else 4.0
    cells: dict[tuple[int, int], list[dict]] = {}
    for s in sorted(stars, key=lambda s: -s["flux"]):
        hidden = False
        for t in cells.get((int(s["y"] // cell), int(s["x"] // cell)), ()):
            dx, dy = s["x"] - t["x"], s["y"] - t["y"]
            cxx, cyy, cxy = t["_form"]
            r2 = cxx * dx * dx + cyy * dy * dy + cxy * dx * dy
            wing = (t["peak"] - threshold) / (1 + how.clean * r2) ** 2.5
            if wing > max(0.0, s["flux"] / max(1, s["npix"])) and r2 < 9:
                hidden = True
                break
        if not hidden:
            out.append(s)
            reach = 3 * s["a"]
            for i in range(int((s["y"] - reach) // cell), int((s["y"] + reach) // cell) + 1):
                for j in range(int((s["x"] - reach) // cell), int((s["x"] + reach) // cell) + 1):
                    cells.setdefault((i, j), []).append(s)
    return out


def detect(image: np.ndarray, level: float, noise: float, how: Detection = Detection()) -> list[dict]:
    """Stars of one frame in page order of their first pixel; none on a side under three pixels."""
    if min(image.shape) < 3:
        return []
    threshold = level + how.sigmas * noise
    above = image > threshold
    names, n = _labels(above)
    if not n:
        return []
    ys, xs = np.nonzero(names)
    which = names[ys, xs] - 1
    area = np.bincount(which, minlength=n)
    low_y, low_x = np.full(n, image.shape[0]), np.full(n, image.shape[1])
    high_y, high_x = np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(low_y, which, ys)
    np.minimum.at(low_x, which, xs)
    np.maximum.at(high_y, which, ys)
    np.maximum.at(high_x, which, xs)
    stars = []
    for k in np.flatnonzero(area >= how.min_area):
        y0, x0, y1, x1 = low_y[k], low_x[k], high_y[k] + 1, high_x[k] + 1
        inside = names[y0:y1, x0:x1] == k + 1
        parts = _split(image[y0:y1, x0:x1], inside, threshold, how)
        stars += [_measure(image, int(y0), int(x0), p, threshold, noise, 2 if len(parts) > 1 else 0) for p in parts if p.sum() >= how.min_area]
    kept = _cleaned(stars, threshold, how)
    return sorted(kept, key=lambda s: (s["y"], s["x"]))


def found_in(image: np.ndarray, how: Detection) -> tuple[dict, list[dict]]:
    """The background of a frame of finite pixels, and its stars as rows of ``schemas.STAR_LIST``."""
    level = background(image, how)
    found = detect(image, level["median"], level["rms"], how)
    if how.max_stars is not None:
        found = sorted(found, key=lambda s: -s["flux"])[: how.max_stars]
    return level, [{"star_idx": i} | {k: v for k, v in s.items() if k in NAMES} for i, s in enumerate(found)]


def detect_stars(images: DataFrame, how: Detection = Detection()) -> DataFrame:
    """(path, frame_id, status, background, stars) of each image row (path, width, height, pixels, status).

    Frames that failed, or with a pixel that isn't finite, have no stars and no
    background.  One frame is in a worker's memory at a time; no shuffle.
    """
    kinds = images.sparkSession.createDataFrame([], S.DETECTED).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("path", "width", "height", "pixels", "status")]
            for path, w, h, pixels, status in zip(*cols):
                row = {"path": path.as_py(), "frame_id": frame_id(path.as_py()), "status": status.as_py(), "background": None, "stars": []}
                if row["status"] == "ok":
                    px = pixels.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
                    if np.isfinite(px).all():
                        row["background"], row["stars"] = found_in(px.reshape(h.as_py(), w.as_py()), how)
                    else:
                        row["status"] = "nonfinite"
                yield pa.RecordBatch.from_pylist([row], arrow)

    return images.select("path", "width", "height", "pixels", "status").mapInArrow(run, S.DETECTED)


def frame_id(path: str) -> str:
    """The path's last part, or 'unknown'."""
    return path.rstrip("/").rsplit("/", 1)[-1] or "unknown"


def frame_row(path: str, data: bytes, how: Detection = Detection()) -> dict:
    """One row of ``read_frames``."""
    began = time.perf_counter()
    row = scan.decode_header(path, data)
    headed = time.perf_counter()
    image = scan.decode_image(path, data)
    loaded = time.perf_counter()
    row |= {"image_status": image["status"], "image_error": image["error"], "width": image["width"], "height": image["height"], "pixel_stats": None, "nonfinite": None, "background": None, "stars": []}
    if image["status"] == "ok":
        px = np.asarray(image["pixels"], np.float32)
        good = px[np.isfinite(px)].astype(np.float64)
        row["pixel_stats"] = {"min": float(good.min()) if len(good) else None, "max": float(good.max()) if len(good) else None, "mean": float(good.sum() / len(px)) if len(px) else None}
        row["nonfinite"] = len(good) < len(px)
        if not row["nonfinite"] and len(px):
            row["background"], row["stars"] = found_in(px.reshape(row["height"], row["width"]), how)
    return row | {"header_seconds": headed - began, "load_seconds": loaded - headed, "detect_seconds": time.perf_counter() - loaded}


def read_frames(spark: SparkSession, path: str, how: Detection = Detection(), recursive: bool = True) -> DataFrame:
    """Header, pixel statistics, background, stars and seconds of each file under ``path``, read and decoded once."""
    return scan.decoded(spark, path, partial(frame_row, how=how), S.FRAME, recursive)


def star_table(detected: DataFrame) -> DataFrame:
    """A row for each star."""
    return detected.selectExpr("path", "frame_id", "explode(stars) AS s").selectExpr("path", "frame_id", "s.*")
