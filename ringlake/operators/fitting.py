"""Pattern centres by bounded least-squares fits of a circular Gaussian to a ring of pixels, many frames at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlake.operators.frames import missing_as_null

# Ring and bounds of the fit.
FIT_RING = (80, 400)
CENTRE_RING = (40, 200)
SCALE_BOUNDS = (0.2, 5.0)
CENTRE_BOUND = 30
OFFSET_BOUND = 20
NAMES = ("amplitude", "x0", "y0", "sigma", "offset")
FITTED = "success boolean, n_pixels long, " + ", ".join(f"{n} double, {n}_error double" for n in NAMES) + ", total_intensity double"
#: Numbers (frames by ring pixels) that are fitted together; bounds a task's memory, some fifty times as many bytes.
TOGETHER = 1_000_000

Start = tuple[float, float, float, float, float]


def _model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (frames, pixels) and derivatives (frames, pixels, 5) for parameters (frames, 5)."""
    a, x0, y0, s, o = (p[:, k, None] for k in range(5))
    dx, dy = x - x0, y - y0
    r2 = dx * dx + dy * dy
    e = np.exp(-r2 / (2 * s * s))
    return a * e + o, np.stack([e, a * e * dx / s**2, a * e * dy / s**2, a * e * r2 / s**3, np.ones_like(e)], axis=2)


def bounds_of(start: Start, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest parameters of a fit that begins at ``start``."""
    amplitude, x0, y0, sigma, offset = start
    low = np.array([amplitude * SCALE_BOUNDS[0], max(0, x0 - CENTRE_BOUND), max(0, y0 - CENTRE_BOUND), max(1.0, sigma * SCALE_BOUNDS[0]), offset - OFFSET_BOUND])
    high = np.array([amplitude * SCALE_BOUNDS[1], min(width, x0 + CENTRE_BOUND), min(height, y0 + CENTRE_BOUND), sigma * SCALE_BOUNDS[1], offset + OFFSET_BOUND])
    return low, high


def fit_rings(x: np.ndarray, y: np.ndarray, v: np.ndarray, start: Start, height: int, width: int, evaluations: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(success, parameters, errors) of each row of ``v``, the values at (x, y), by Levenberg-Marquardt steps inside bounds.

    All rows step together, each with a damping of its own, on stacked 5 x 5 normal
    equations; a row whose steps have become small, or can't lower its cost any more, is
    left out of the next ones. Errors are the roots of the covariance's diagonal, scaled by
    the residual variance. Rows with a missing value, too few values and a start outside the
    bounds have no fit.
    """
    n, m = v.shape
    low, high = bounds_of(start, height, width)
    p = np.tile(np.array(start, dtype=float), (n, 1))
    errors = np.full((n, 5), np.nan)
    good = np.isfinite(v).all(axis=1) & (m > len(NAMES)) & (low < high).all() & (p >= low).all(axis=1) & (p <= high).all(axis=1)
    left = np.flatnonzero(good)
    f, jacobian = _model(p[left], x, y)
    cost, damping = ((f - v[left]) ** 2).sum(axis=1), np.full(len(left), 1e-3)
    normal, gradient = np.matmul(jacobian.transpose(0, 2, 1), jacobian), np.matmul(jacobian.transpose(0, 2, 1), (f - v[left])[..., None])[..., 0]
    ends = np.zeros((n, 5, 5)), np.zeros(n)
    for step_number in range(evaluations + 1):
        here = p[left]
        fixed = ((here <= low) & (gradient > 0)) | ((here >= high) & (gradient < 0))
        # a parameter at its bound doesn't move: its row and column become those of the unit matrix
        both = fixed[:, :, None] | fixed[:, None, :]
        inner = np.where(both, 0.0, normal)
        diagonal = np.maximum(np.einsum("ijj->ij", inner), 1e-12)
        inner = inner + np.einsum("ij,jk->ijk", np.where(fixed, 1.0, damping[:, None] * diagonal), np.eye(5))
        step = np.linalg.solve(inner, np.where(fixed, 0.0, -gradient)[..., None])[..., 0]
        tried = np.clip(here + step, low, high)
        g, other = _model(tried, x, y)
        new = ((g - v[left]) ** 2).sum(axis=1)
        small = (np.abs(tried - here) <= 1e-12 * (1 + np.abs(here))).all(axis=1)
        better = new <= cost
        p[left[better]] = tried[better]
        rest = g[better] - v[left[better]]
        jt = other[better].transpose(0, 2, 1)
        normal[better], gradient[better] = np.matmul(jt, other[better]), np.matmul(jt, rest[..., None])[..., 0]
        cost = np.where(better, new, cost)
        damping = np.where(better, np.maximum(damping / 5, 1e-12), damping * 4)
        done = small | (damping > 1e12) | fixed.all(axis=1)
        if step_number == evaluations:
            done[:] = True
        ends[0][left[done]], ends[1][left[done]] = normal[done], cost[done]
        left, cost, damping, normal, gradient = left[~done], cost[~done], damping[~done], normal[~done], gradient[~done]
        if not len(left):
            break
    if good.any():
        covariance = np.linalg.pinv(ends[0][good], hermitian=True) * (ends[1][good] / (m - len(NAMES)))[:, None, None]
        errors[good] = np.sqrt(np.maximum(np.einsum("ijj->ij", covariance), 0))
    p[~good] = np.nan
    return good, p, errors


def fitted_frames(frames: DataFrame, start: Start, height: int, width: int, inner: float = FIT_RING[0], outer: float = FIT_RING[1]) -> DataFrame:
    """The frames with the columns FITTED: success, the five parameters, their errors and the ring's total intensity.

    ``start`` is amplitude, x0, y0, sigma, offset; the ring is closed and lies around
    (x0, y0). Frames are rows with an array of pixels, of which the ring is cut out; as many
    as TOGETHER allows are fitted at once. A frame of another size, a ring with a missing
    pixel, too few pixels or a start outside the bounds give success false. No join and no shuffle.
    """
    y, x = (a.ravel() for a in np.mgrid[:height, :width].astype(float))
    dx, dy = x - float(start[1]), y - float(start[2])
    d = np.sqrt(dx * dx + dy * dy)
    ring = np.flatnonzero((d >= inner) & (d <= outer))
    kept = [c for c in frames.columns if c not in {f.split()[0] for f in FITTED.split(", ")}]
    schema = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes if c in kept) + ", " + FITTED
    at_once = max(1, TOGETHER // max(1, len(ring)))

    def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column("pixels")
        whole = lists.value_lengths().fill_null(0).to_numpy() == height * width
        v = np.full((len(batch), len(ring)), np.nan)
        if whole.any():
            v[whole] = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, height * width)[:, ring]
        good, p, errors = fit_rings(x[ring], y[ring], v, start, height, width)
        number = lambda a: pa.array(a, from_pandas=True)
        pairs = [number(a[:, k]) for k in range(5) for a in (p, errors)]
        return [pa.array(good), pa.array(np.where(whole, len(ring), 0)), *pairs, number(v.sum(axis=1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), at_once):
                some = batch.slice(i, at_once)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], *columns_of(some)], names=[*kept, *(f.split()[0] for f in FITTED.split(", "))])

    return missing_as_null(frames).select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def gaussian_centres(frames: DataFrame, start: Start, height: int, width: int, inner: float = FIT_RING[0], outer: float = FIT_RING[1]) -> DataFrame:
    """frame_id and the columns FITTED of each frame."""
    return fitted_frames(frames.select("frame_id", "pixels"), start, height, width, inner, outer).drop("pixels")


def centred_frames(frames: DataFrame, start: Start, height: int, width: int, inner: float = CENTRE_RING[0], outer: float = CENTRE_RING[1]) -> DataFrame:
    """The frames whose fit succeeded with center_x, center_y and total_count, which radial profiles take along.

    total_count is the sum of the ring around the start, not around the fitted centre.
    """
    found = fitted_frames(frames, start, height, width, inner, outer).where("success")
    return found.select(*[F.col(f"`{c}`") for c in frames.columns], F.col("x0").alias("center_x"), F.col("y0").alias("center_y"), F.col("total_intensity").alias("total_count"))
