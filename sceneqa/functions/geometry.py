"""Geometry as Column expressions: boxes, quaternions, projection, overlap, schedules.

Angles are radians, quaternions are [w, x, y, z] arrays, boxes are x1, y1, x2, y2. Everything stays in generated code
but the search for a contact, whose steps are numpy's for a batch of rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

Box = Sequence[Column]


def normalize_pixel(value: Column, size: Column | float, grid: int = 1000) -> Column:
    """A pixel on a grid of 0..grid, rounded half to even and clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(grid), F.rint(value / size * grid).cast("int")))


def absolute_pixel(value: Column, size: Column | int, new_size: Column | int) -> Column:
    """A pixel carried to a resized image, below its size."""
    return F.greatest(F.lit(0), F.least(F.rint(value * new_size / size).cast("int"), F.lit(new_size).cast("int") - 1 if isinstance(new_size, int) else new_size - 1))


def mirror(x1: Column, x2: Column, width: float) -> tuple[Column, Column]:
    """The x range as a mirrored (rear) view shows it."""
    return F.lit(width) - x2, F.lit(width) - x1


def clip_box(box: Box, width: Column | float, height: Column | float) -> list[Column]:
    return [F.least(F.greatest(v, F.lit(0.0)), F.lit(m) if not isinstance(m, Column) else m) for v, m in zip(box, (width, height, width, height), strict=True)]


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def area(a: Box) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without overlap."""
    common = intersection(a, b)
    return F.when(common > 0, common / (area(a) + area(b) - common)).otherwise(0.0)


def giou(a: Box, b: Box) -> Column:
    """Generalised IoU in [-1, 1]; 0 where the union is empty."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return F.when(union > 0, common / union - F.when(hull > 0, (hull - union) / hull).otherwise(0.0)).otherwise(0.0)


def xyxy_to_xywh(a: Box) -> list[Column]:
    return [a[0], a[1], a[2] - a[0], a[3] - a[1]]


def _q(q: Column) -> list[Column]:
    return [F.get(q, i) for i in range(4)]


def quat_multiply(a: Column, b: Column) -> Column:
    """Hamilton product."""
    aw, ax, ay, az = _q(a)
    bw, bx, by, bz = _q(b)
    return F.array(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def quat_inverse(q: Column) -> Column:
    w, x, y, z = _q(q)
    n = w * w + x * x + y * y + z * z
    return F.array(*[F.try_divide(v, n) for v in (w, -x, -y, -z)])


def quat_matrix(q: Column, normalize: bool = False) -> Column:
    """The rotation matrix, row by row; the quaternion is taken as it is unless normalize is set."""
    w, x, y, z = _q(q)
    if normalize:
        n = F.sqrt(w * w + x * x + y * y + z * z)
        w, x, y, z = (F.try_divide(v, n) for v in (w, x, y, z))
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        F.array(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        F.array(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def quat_yaw(q: Column) -> Column:
    w, x, y, z = _q(q)
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def quat_euler(q: Column) -> Column:
    """Roll, pitch and yaw in degrees; pitch is +-90 at the poles."""
    w, x, y, z = _q(q)
    sinp = 2 * (w * y - z * x)
    pitch = F.when(F.abs(sinp) >= 1, F.signum(sinp) * 90.0).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sinp)))))
    return F.array(F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), pitch, F.degrees(quat_yaw(q)))


def matrix_quat(m: Column) -> Column:
    """The quaternion of a rotation matrix: by the trace, else by the largest diagonal element."""
    e = [[F.get(F.get(m, i), j) for j in range(3)] for i in range(3)]
    tiny = F.lit(1e-12)
    trace = e[0][0] + e[1][1] + e[2][2]

    def branch(first: Column, w: Column, x: Column, y: Column, z: Column) -> Column:
        s = 2 * F.sqrt(F.greatest(first, tiny))
        return F.array(*[s / 4 if v is None else v / s for v in (w, x, y, z)])

    return (
        F.when(trace > 0, branch(trace + 1, None, e[2][1] - e[1][2], e[0][2] - e[2][0], e[1][0] - e[0][1]))
        .when((e[0][0] > e[1][1]) & (e[0][0] > e[2][2]), branch(1 + e[0][0] - e[1][1] - e[2][2], e[2][1] - e[1][2], None, e[0][1] + e[1][0], e[0][2] + e[2][0]))
        .when(e[1][1] > e[2][2], branch(1 + e[1][1] - e[0][0] - e[2][2], e[0][2] - e[2][0], e[0][1] + e[1][0], None, e[1][2] + e[2][1]))
        .otherwise(branch(1 + e[2][2] - e[0][0] - e[1][1], e[1][0] - e[0][1], e[0][2] + e[2][0], e[1][2] + e[2][1], None))
    )


def rotate(m: Column, v: Sequence[Column]) -> list[Column]:
    return [sum((F.get(F.get(m, i), j) * v[j] for j in range(1, 3)), F.get(F.get(m, i), 0) * v[0]) for i in range(3)]


def rotate_back(m: Column, v: Sequence[Column]) -> list[Column]:
    return [sum((F.get(F.get(m, j), i) * v[j] for j in range(1, 3)), F.get(F.get(m, 0), i) * v[0]) for i in range(3)]


def rigid_apply(q: Column, t: Column, v: Sequence[Column]) -> list[Column]:
    return [a + F.get(t, i) for i, a in enumerate(rotate(quat_matrix(q), v))]


def rigid_inverse(q: Column, t: Column) -> tuple[Column, Column]:
    """The inverse of x -> R x + t as its matrix (columns of R) and translation."""
    m = quat_matrix(q)
    back = rotate_back(m, [F.get(t, i) for i in range(3)])
    inverse = F.array(*[F.array(*[F.get(F.get(m, j), i) for j in range(3)]) for i in range(3)])
    return inverse, F.array(*[-b for b in back])


def wrap_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def camera_heading(q: Column) -> Column:
    """Degrees of the optical axis (z of the camera) in the frame the camera is turned to."""
    x, y, _ = rotate(quat_matrix(q), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    return F.degrees(F.atan2(y, x))


def box_corners(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """The eight corners: front before rear, left before right, top before bottom."""
    c, s = F.cos(yaw), F.sin(yaw)
    out = []
    for i in (1, -1):
        for j in (1, -1):
            for k in (1, -1):
                dx, dy, dz = length * (i / 2), width * (j / 2), height * (k / 2)
                out.append(F.array(x + c * dx - s * dy, y + s * dx + c * dy, z + dz))
    return F.array(*out)


def project(point: Column, rotation: Column, translation: Column, k: Column) -> Column:
    """u, v, depth of a point after x -> R x + t and the intrinsics k; u and v are null at depth 0."""
    p = [a + F.get(translation, i) for i, a in enumerate(rotate(rotation, [F.get(point, i) for i in range(3)]))]
    u = F.get(F.get(k, 0), 0) * p[0] + F.get(F.get(k, 0), 1) * p[1] + F.get(F.get(k, 0), 2) * p[2]
    v = F.get(F.get(k, 1), 1) * p[1] + F.get(F.get(k, 1), 2) * p[2]
    return F.array(F.try_divide(u, p[2]), F.try_divide(v, p[2]), p[2])


def projected_box(points: Column, width: int, height: int, resize: int = 1, least_depth: float = 0.1) -> Column:
    """The clipped box of projected points (u, v, depth) in front of the camera, cut to integers; null without any."""
    front = F.filter(points, lambda p: F.get(p, 2) > least_depth)

    def side(i: int, most: int, fn) -> Column:
        return (F.least(F.greatest(fn(F.transform(front, lambda p: F.get(p, i))), F.lit(0.0)), F.lit(float(most))) / resize).cast("int")

    box = F.array(side(0, width, F.array_min), side(1, height, F.array_min), side(0, width, F.array_max), side(1, height, F.array_max))
    return F.when(F.size(front) > 0, box)


def visible(points: Column, width: int = 1600, height: int = 900, least_depth: float = 0.1) -> Column:
    """Whether a projected point lies in the image, which ends before its width and height."""
    return F.exists(points, lambda p: (F.get(p, 2) > least_depth) & (F.get(p, 0) >= 0) & (F.get(p, 0) < width) & (F.get(p, 1) >= 0) & (F.get(p, 1) < height))


def obb_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two oriented boxes (x, y, yaw, half length, half width) overlap or touch: no axis separates them."""
    (ax, ay, at, ah, aw), (bx, by, bt, bh, bw) = a, b
    dx, dy = bx - ax, by - ay
    out = None
    for yaw in (at, bt):
        for ux, uy in ((F.cos(yaw), F.sin(yaw)), (-F.sin(yaw), F.cos(yaw))):
            reach = None
            for t, h, w in ((at, ah, aw), (bt, bh, bw)):
                part = h * F.abs(F.cos(t) * ux + F.sin(t) * uy) + w * F.abs(-F.sin(t) * ux + F.cos(t) * uy)
                reach = part if reach is None else reach + part
            near = F.abs(dx * ux + dy * uy) <= reach
            out = near if out is None else out & near
    return out


def ttc_axis(p: Column, v: Column, reach: Column) -> tuple[Column, Column]:
    """The times between which |p + v t| <= reach; nulls if never."""
    a, b = F.try_divide(-reach - p, v), F.try_divide(reach - p, v)
    still = F.abs(v) < 1e-9
    inside = F.abs(p) <= reach
    enter = F.when(still, F.when(inside, F.lit(0.0))).otherwise(F.least(a, b))
    leave = F.when(still, F.when(inside, F.lit(float("inf")))).otherwise(F.greatest(a, b))
    return enter, leave


def ttc_boxes(px: Column, py: Column, vx: Column, vy: Column, reach_x: Column, reach_y: Column) -> Column:
    """Time to collision of axis-aligned boxes in relative motion: 0 if they overlap, null if never."""
    ex, lx = ttc_axis(px, vx, reach_x)
    ey, ly = ttc_axis(py, vy, reach_y)
    enter, leave = F.greatest(ex, ey, F.lit(0.0)), F.least(lx, ly)
    return F.when(ex.isNotNull() & ey.isNotNull() & (enter <= leave) & (leave >= 0), enter)


def ttc_obb(ego: Sequence[Column], other: Sequence[Column], velocity: Sequence[Column], acceleration: Sequence[Column], horizon: float = 10.0, step: float = 0.05, fine: float = 1e-3) -> Column:
    """Time to contact of two oriented boxes (x, y, yaw, half length, half width) in accelerated relative motion, their headings
    kept: 0 if they touch, null without relative motion (0.1) or contact. Searched in steps, then by halving the step.

    On each of the four axes that could separate them the distance is a quadratic in time; contact is where all are in reach.
    """
    (ax, ay, at, ah, aw), (bx, by, bt, bh, bw) = ego, other
    axes = []
    for yaw in (at, bt):
        for ux, uy in ((F.cos(yaw), F.sin(yaw)), (-F.sin(yaw), F.cos(yaw))):
            reach = sum((h * F.abs(F.cos(t) * ux + F.sin(t) * uy) + w * F.abs(-F.sin(t) * ux + F.cos(t) * uy) for t, h, w in ((at, ah, aw), (bt, bh, bw))), F.lit(0.0))
            along = [x * ux + y * uy for x, y in ((bx - ax, by - ay), velocity, acceleration)]
            axes.append(F.struct(along[0].alias("p"), along[1].alias("v"), (along[2] / 2).alias("a"), reach.alias("r")))

    moves = (F.hypot(*velocity) >= 0.1) | (F.hypot(*acceleration) >= 0.1)
    # a null on any axis is no contact
    known = F.array(*axes)
    whole = F.forall(known, lambda x: (x["p"] + x["v"] + x["a"] + x["r"]).isNotNull())
    parts = [x.getField(c) for x in axes for c in "pvar"]
    return F.when(whole, _first_contact(horizon, step, fine)(F.coalesce(moves, F.lit(False)), *parts))


def _first_contact(horizon: float, step: float, fine: float):
    """A Column function of whether a box moves and p, v, a, r of each of four axes."""

    @pandas_udf(DoubleType())
    def search(moves: pd.Series, *parts: pd.Series) -> pd.Series:
        every = np.array([c.to_numpy(float) for c in parts]).reshape(4, 4, -1)

        def near(x: np.ndarray, t: float | np.ndarray) -> np.ndarray:
            p, v, a, r = x.transpose(1, 0, 2)
            return ((np.abs(p + v * t + a * t * t) <= r) | np.isnan(r)).all(axis=0)  # to Spark NaN is above all numbers

        with np.errstate(all="ignore"):
            now = near(every, 0.0)
            out = np.where(now, 0.0, np.nan)
            left = np.flatnonzero(~now & moves.to_numpy(bool))
            x = every[:, :, left]
            for k in range(1, round(horizon / step) + 1):
                hit = near(x, k * step)
                if hit.any():
                    y, lo, hi = x[:, :, hit], np.full(hit.sum(), (k - 1) * step), np.full(hit.sum(), k * step)
                    for _ in range(math.ceil(math.log2(step / fine))):
                        mid = (lo + hi) / 2
                        there = near(y, mid)
                        lo, hi = np.where(there, lo, mid), np.where(there, mid, hi)
                    out[left[hit]] = hi
                    left, x = left[~hit], x[:, :, ~hit]
        return pd.Series(out)

    return search


def directions(label: Column) -> Column:
    """The directions that a label of relative position names: two for one like `ahead-left`."""
    return F.filter(F.array(*[F.lit(d) for d in ("ahead", "behind", "left", "right")]), lambda d: F.contains(label, d))


def risk_band(ttc: Column) -> Column:
    """CRITICAL at 0, HIGH below 2 s, MODERATE below 5 s, LOW if finite, NONE else (null)."""
    return F.when(ttc.isNull(), "NONE").when(ttc <= 0, "CRITICAL").when(ttc < 2, "HIGH").when(ttc < 5, "MODERATE").otherwise("LOW")


def motion_band(speed: Column) -> Column:
    return F.when(speed < 0.1, "stationary").when(speed < 5, "slow").when(speed < 15, "moderate").otherwise("fast")


def sector(x: Column, y: Column) -> Column:
    """The diagonal sector of a point in a frame with x ahead and y to the left."""
    return F.when(F.abs(y) > F.abs(x), F.when(y > 0, "left").otherwise("right")).otherwise(F.when(x >= 0, "ahead").otherwise("behind"))


def relative_label(x: Column, y: Column, lon: float = 2.0, lat: float = 1.0) -> Column:
    """ahead, behind or beside, and left, right or center, as in `ahead-left`."""
    a = F.when(x > lon, "ahead").when(x < -lon, "behind").otherwise("beside")
    b = F.when(y > lat, "left").when(y < -lat, "right").otherwise("center")
    return F.concat_ws("-", a, b)


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 3136, most: int = 1_003_520) -> Column:
    """Height and width as multiples of factor within pixel bounds; null if one side is over 200 times the other."""
    h0 = F.greatest(F.lit(factor), F.rint(height / factor).cast("int") * factor)
    w0 = F.greatest(F.lit(factor), F.rint(width / factor).cast("int") * factor)
    shrink, grow = F.sqrt(height * width / most), F.sqrt(F.try_divide(F.lit(float(least)), height * width))
    small = F.array(*[F.greatest(F.lit(factor), (F.floor(v / shrink / factor) * factor).cast("int")) for v in (height, width)])
    large = F.array(*[(F.ceil(v * grow / factor) * factor).cast("int") for v in (height, width)])
    out = F.when(h0 * w0 > most, small).when(h0 * w0 < least, large).otherwise(F.array(h0, w0))
    return F.when(F.greatest(height, width) / F.least(height, width) <= 200, out)


def frame_count(total: Column, video_fps: Column, fps: float = 2.0, least: int = 4, most: int = 768) -> Column:
    """Frames to take: within bounds and the total, floored to a multiple of two."""
    n = F.least(F.greatest(total / video_fps * fps, F.lit(float(least))), F.least(F.lit(float(most)), total.cast("double")))
    return (F.floor(n / 2) * 2).cast("int")


def trapezoid(step: Column, total: int, warmup: float = 0.1, decay: float = 0.2, peak: float = 1.0) -> Column:
    """A factor that rises over the warm-up, holds, and falls to 0 over the decay."""
    up, down = int(total * warmup), int(total * decay)
    left = F.lit(float(total)) - step
    return F.when(step < up, step / max(up, 1) * peak).when(step < total - down, F.lit(peak)).otherwise(F.greatest(F.lit(0.0), left / max(down, 1)) * peak)


def sparse_peak(fraction: Column, low: float = 0.15, factor: float = 0.3) -> Column:
    return F.when(fraction < low, factor).otherwise(1.0)


def homography(h: Column, u: Column, v: Column) -> Column:
    r = [F.get(F.get(h, i), 0) * u + F.get(F.get(h, i), 1) * v + F.get(F.get(h, i), 2) for i in range(3)]
    return F.array(F.try_divide(r[0], r[2]), F.try_divide(r[1], r[2]))


def stopping_distance(speed: Column, deceleration: float = 3.5) -> Column:
    return F.when(speed > 0.5, speed * speed / (2 * deceleration))


def closing_speed(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    """The speed at which a point nears the origin."""
    return -F.try_divide(x * vx + y * vy, F.sqrt(x * x + y * y))


def coordinate_scale(largest: Column) -> Column:
    """1 for coordinates in 0..1 (up to 1.5), else 1000."""
    return F.when(largest <= 1.5, 1).otherwise(1000)


def coordinate_width(largest_x: Column) -> Column:
    return F.when(largest_x > 800, 1600).when(largest_x > 400, 800).when(largest_x > 0, 400)


def ground_hit(origin: Sequence[Column], direction: Sequence[Column], furthest: float = 120.0) -> Column:
    """Where a ray meets the plane z = 0, null if it doesn't ahead within the range."""
    t = F.try_divide(-origin[2], direction[2])
    p = [origin[i] + t * direction[i] for i in range(2)]
    return F.when((t > 0) & (F.sqrt((p[0] - origin[0]) ** 2 + (p[1] - origin[1]) ** 2) <= furthest), F.array(p[0], p[1], F.lit(0.0)))


def pinhole_depth(focal: Column, real_size: Column | float, pixels: Column, estimate: Column, furthest: float = 120.0) -> Column:
    """Depth of an object of known size, else the estimate, if plausible."""
    d = F.coalesce(F.when(pixels > 0, focal * real_size / pixels), estimate)
    return F.when((d > 0) & (d <= furthest), d)
