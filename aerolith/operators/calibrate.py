"""Mount calibration: small offset angles that bring known targets into place, by normal equations or a simplex search over sums from Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CALIBRATION_GUARD, FIELD_CAMERA_FLAT, M_PER_DEG, MOUNT_NED, Camera
from .scratch import release, written

#: Step of the derivatives, in radians.
STEP = 1e-3


def euler_matrix(a: float, b: float, c: float) -> np.ndarray:
    """Rotation by a about x, then b about y, then c about z of fixed axes (radians); arrays of n angles give 3 x 3 x n."""
    (sa, sb, sc), (ca, cb, cc) = np.sin([a, b, c]), np.cos([a, b, c])
    return np.array([
        [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa],
        [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa],
        [-sb, cb * sa, cb * ca],
    ])


def simplex_minimum(
    f: Callable | None, start: np.ndarray, step: float = 0.02, tolerance: float = 1e-5, most: int = 5000, several: Callable | None = None,
) -> tuple[np.ndarray, float]:
    """Nelder-Mead with the usual coefficients; ends when points and values are both within ``tolerance``.

    ``several`` takes a list of points to their values at once, in place of ``f``: each step asks for all
    points it may need in one call.
    """
    several = several or (lambda points: [f(p) for p in points])
    n = len(start)
    points = np.vstack([start, start + step * np.eye(n)])
    values = np.array(several(list(points)))
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(points[1:] - points[0]).max() <= tolerance and np.abs(values[1:] - values[0]).max() <= tolerance:
            break
        centre, worst = points[:-1].mean(axis=0), points[-1]
        tried = [centre + k * (centre - worst) for k in (1.0, 2, 0.5, -0.5)]
        r, e, outer, inner = several(tried)
        if r < values[0]:
            points[-1], values[-1] = (tried[1], e) if e < r else (tried[0], r)
        elif r < values[-2]:
            points[-1], values[-1] = tried[0], r
        else:
            near, c = (tried[2], outer) if r < values[-1] else (tried[3], inner)
            if c < min(r, values[-1]):
                points[-1], values[-1] = near, c
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = several(list(points[1:]))
    best = int(values.argmin())
    return points[best], float(values[best])


def errors_at(rays: np.ndarray, angles: np.ndarray, height: np.ndarray, uav: np.ndarray, truth: np.ndarray, mount: np.ndarray | None) -> Callable[[np.ndarray], np.ndarray]:
    """:func:`ground_errors` of these observations by offsets; what no offset changes is computed once."""
    given = rays if mount is None else rays @ mount.T
    attitude = None if mount is None else euler_matrix(*angles.T)
    per_lon, true_cos = M_PER_DEG * np.cos(np.radians(uav[:, 0])), np.cos(np.radians(truth[:, 0]))

    def errors(offsets: np.ndarray) -> np.ndarray:
        turned = given @ euler_matrix(*offsets).T
        w = np.einsum("ijn,nj->ni", euler_matrix(*(angles + offsets).T) if mount is None else attitude, turned)
        ok = np.abs(w[:, 2]) >= CALIBRATION_GUARD
        t = np.where(ok, height / np.where(ok, w[:, 2], 1.0), 0.0)
        north, east = (w[:, 1], w[:, 0]) if mount is None else (w[:, 0], w[:, 1])
        n = (uav[:, 0] + t * north / M_PER_DEG - truth[:, 0]) * M_PER_DEG
        e = (uav[:, 1] + t * east / per_lon - truth[:, 1]) * M_PER_DEG * true_cos
        return np.where(ok[:, None], np.stack([n, e], axis=1), 0.0)

    return errors


def ground_errors(offsets: np.ndarray, rays: np.ndarray, angles: np.ndarray, height: np.ndarray, uav: np.ndarray, truth: np.ndarray, mount: np.ndarray | None) -> np.ndarray:
    """Errors in metres, north and east, of each observation; 0 where the ray is too flat to meet the ground.

    With a ``mount`` the offsets turn what it has turned. Without one they are the mount themselves and are added to the
    attitude's ``angles`` too, and the first component is east: the older order, which applies them twice.
    """
    return errors_at(rays, angles, height, uav, truth, mount)(offsets)


def squared_error(offsets: np.ndarray, rays: np.ndarray, angles: np.ndarray, height: np.ndarray, uav: np.ndarray, truth: np.ndarray, mount: np.ndarray | None) -> float:
    """Sum of squared ground errors in metres; see :func:`ground_errors`."""
    return float(np.square(ground_errors(offsets, rays, angles, height, uav, truth, mount)).sum())


COLUMNS = ("u", "v", "altitude", "lat_uav", "lon_uav", "roll_deg", "pitch_deg", "yaw_deg", "true_lat", "true_lon")


def observed(observations: DataFrame, mount: tuple | None) -> DataFrame:
    """The columns a fit reads, without rows that lack one; for the older order height and position are their means over all rows."""
    rows = observations.select(*[observations[c].cast("double") for c in COLUMNS]).dropna()
    if mount is None:
        means = rows.agg(*[F.avg(c).alias(f"_{c}") for c in ("altitude", "lat_uav", "lon_uav")])
        rows = rows.crossJoin(F.broadcast(means)).withColumns({c: F.col(f"_{c}") for c in ("altitude", "lat_uav", "lon_uav")}).select(*COLUMNS)  # one row
    return rows


def _arrays(batch: pa.RecordBatch, cam: Camera) -> tuple:
    """Rays, attitude in radians, height, place and truth of a batch of observations."""
    a = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
    rays = np.stack([(a[:, 0] - cam.cx) / cam.fx, (a[:, 1] - cam.cy) / cam.fy, np.ones(len(a))], axis=1)
    return rays, np.radians(a[:, 5:8]), a[:, 2], a[:, 3:5], a[:, 8:10]


def squared_errors(rows: DataFrame, points: list[np.ndarray], cam: Camera, mount: tuple | None) -> list[float]:
    """The objective at each of ``points`` (offsets in radians), summed over all ``rows`` in Spark; only sums reach the driver."""
    turn = None if mount is None else np.array(mount, dtype=float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(points))
        for batch in batches:
            errors = errors_at(*_arrays(batch, cam), turn)
            total += [np.square(errors(x)).sum() for x in points]
        yield pa.record_batch([pa.array([v]) for v in total], names=[f"e{i}" for i in range(len(points))])

    parts = rows.mapInArrow(sums, ", ".join(f"e{i} double" for i in range(len(points))))
    return list(parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in parts.columns]).first())


_PAIRS = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))


def local_sums(at: np.ndarray, errors: Callable[[np.ndarray], np.ndarray], step: float = STEP) -> np.ndarray:
    """22 sums over the rows of ``errors``: products of (slope by each angle, error), 4 x 4, and error times second slope, by ``_PAIRS``."""
    e = step * np.eye(3)
    here = errors(at)
    ahead, behind = [errors(at + d) for d in e], [errors(at - d) for d in e]
    flat = (here == 0).all(axis=1)[:, None]  # no ray, no slope
    sides = [np.where(flat, 0.0, (p - q) / (2 * step)) for p, q in zip(ahead, behind)]
    bends = []
    for i, j in _PAIRS:
        if i == j:
            bends.append(((ahead[i] - 2 * here + behind[i]) * here).sum() / step**2)
        else:
            both = errors(at + e[i] + e[j]) + errors(at - e[i] - e[j])
            bends.append(((both - ahead[i] - ahead[j] - behind[i] - behind[j] + 2 * here) * here).sum() / (2 * step**2))
    a = np.stack([*sides, here], axis=2).reshape(-1, 4)
    return np.concatenate([(a.T @ a).ravel(), bends])


def normal_equations(
    rows: DataFrame, at: np.ndarray | list[np.ndarray], cam: Camera, mount: tuple | None, step: float = STEP,
) -> tuple[np.ndarray, np.ndarray, float, np.ndarray] | list[tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
    """J'J, J'r and r'r of the ground errors r at offsets ``at`` (radians), and the sum of r times its second slopes; one pass, summed in Spark.

    For a list of offsets a list of these, from the same pass.
    """
    turn, points = None if mount is None else np.array(mount, dtype=float), at if isinstance(at, list) else [at]
    names = [f"s{k}" for k in range(22 * len(points))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), 22))
        for batch in batches:
            errors = errors_at(*_arrays(batch, cam), turn)
            total += [local_sums(x, errors, step) for x in points]
        yield pa.record_batch([pa.array([v]) for v in total.ravel()], names=names)

    parts = rows.mapInArrow(sums, ", ".join(f"{c} double" for c in names))
    total = np.array(list(parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in names]).first()))
    found = [equations_of(v) for v in total.reshape(-1, 22)]
    return found if isinstance(at, list) else found[0]


def equations_of(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    whole, bend = sums[:16].reshape(4, 4), np.zeros((3, 3))
    for (i, j), v in zip(_PAIRS, sums[16:]):
        bend[i, j] = bend[j, i] = v
    return whole[:3, :3], whole[:3, 3], float(whole[3, 3]), bend


def least_squares(equations: Callable, start: np.ndarray, tolerance: float = 1e-6, most: int = 60) -> tuple[np.ndarray, float, int]:
    """Levenberg-Marquardt: point, value and passes. Each pass gives the sums at a trial point; a worse one only raises the damping.

    Where errors stay large, J'J alone is a poor curvature and steps are short; so the second slopes' part is added where the whole is positive.
    It ends when a step moves no coordinate by more than ``tolerance``, or lowers the value by less than a billionth.
    """
    x, damping = np.array(start, dtype=float), 1e-3
    a, g, value, bend = equations(x)
    for done in range(1, most):
        curve = a + bend if np.linalg.eigvalsh(a + bend).min() > 1e-9 * np.trace(a) else a
        step = -np.linalg.lstsq(curve + damping * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
        if np.abs(step).max() <= tolerance:
            return x, value, done
        trial = equations(x + step)
        if trial[2] <= value:
            small = value - trial[2] <= 1e-9 * value
            x, (a, g, value, bend), damping = x + step, trial, damping / 10
            if small:
                return x, value, done + 1
        else:
            damping *= 10
    return x, value, most


def normal_sums(observations: DataFrame, offsets_deg: list[tuple], cam: Camera = FIELD_CAMERA_FLAT, mount: tuple | None = MOUNT_NED) -> DataFrame:
    """What a step of the fit solves, at each of given offsets: ``roll_deg, pitch_deg, yaw_deg, row, a1, a2, a3, g``, J'J by row beside J'r.

    The observations are read once, and without a ``mount`` once more before, for their means.
    """
    found = normal_equations(observed(observations, mount), [np.radians(o) for o in offsets_deg], cam, mount) if offsets_deg else []
    out = [(*map(float, o), k, *map(float, a[k]), float(g[k])) for o, (a, g, _, _) in zip(offsets_deg, found) for k in range(3)]
    return observations.sparkSession.createDataFrame(out, "roll_deg double, pitch_deg double, yaw_deg double, row int, a1 double, a2 double, a3 double, g double")


def mount_objective(observations: DataFrame, offsets_deg: list[tuple], cam: Camera = FIELD_CAMERA_FLAT, mount: tuple | None = MOUNT_NED) -> DataFrame:
    """``roll_deg, pitch_deg, yaw_deg, squared_m2`` of given offsets: what :func:`calibrate_mount` minimizes.

    The observations are read once, and without a ``mount`` once more before, for their means.
    """
    found = squared_errors(observed(observations, mount), [np.radians(o) for o in offsets_deg], cam, mount)
    return observations.sparkSession.createDataFrame([(*map(float, o), e) for o, e in zip(offsets_deg, found)], "roll_deg double, pitch_deg double, yaw_deg double, squared_m2 double")


def calibrate_mount(observations: DataFrame, cam: Camera = FIELD_CAMERA_FLAT, mount: tuple | None = MOUNT_NED, simplex: bool = False) -> DataFrame:
    """One row ``roll_deg, pitch_deg, yaw_deg, rms_m, n_rows``: the mount's offsets that fit the observations best.

    ``observations`` has ``u, v, altitude, lat_uav, lon_uav, roll_deg, pitch_deg, yaw_deg, true_lat, true_lon``.
    All of them count: they are written once, each step is one pass that sums normal equations over them in Spark, and only
    sums reach the driver. The root mean square counts skipped rows too. No rows give no result row. Without a ``mount`` the older
    order is fitted, see :func:`ground_errors`. ``simplex`` searches with values alone, which takes some ten times the passes.
    """
    spark = observations.sparkSession
    schema = "roll_deg double, pitch_deg double, yaw_deg double, rms_m double, n_rows long"
    rows = written(observed(observations, mount))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    if simplex:
        best, value = simplex_minimum(None, np.zeros(3), several=lambda points: squared_errors(rows, points, cam, mount))
    else:
        best, value, _ = least_squares(lambda x: normal_equations(rows, x, cam, mount), np.zeros(3))
    release(rows)
    return spark.createDataFrame([(*(float(x) for x in np.degrees(best)), math.sqrt(value / n), n)], schema)
