"""Perspective camera: basis, view and projection as literals (one camera) or columns (a path)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: frames in one array literal; a longer path is an array of such arrays
FRAMES_PER_LITERAL = 512


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _unit(v):
    n = math.sqrt(_dot(v, v))
    return tuple(c / n for c in v)


@dataclass(frozen=True)
class Camera:
    """One view. ``fov`` is the vertical field of view in degrees."""

    position: tuple[float, float, float]
    forward: tuple[float, float, float] = (0.0, 0.0, -1.0)
    up: tuple[float, float, float] = (0.0, 1.0, 0.0)
    fov: float = 90.0
    near: float = 1e-4
    far: float = 10.0
    width: int = 128
    height: int = 128

    @property
    def aspect(self) -> float:
        return self.width / self.height

    @property
    def focal(self) -> float:
        return 1.0 / math.tan(math.radians(self.fov) / 2)

    @property
    def clip_near(self) -> float:
        """Smallest visible depth: a GL-style projection drawn into a 0..w clip volume."""
        return 2.0 * self.far * self.near / (self.far + self.near)

    def basis(self):
        """Orthonormal (forward, right, up)."""
        f = _unit(self.forward)
        r = _unit(_cross(f, self.up))
        return f, r, _cross(r, f)

    def values(self) -> dict[str, float | int]:
        """Flat record of everything the projection needs."""
        f, r, u = self.basis()
        out = {}
        for name, vec in (("p", self.position), ("f", f), ("r", r), ("u", u)):
            out.update({f"{name}{axis}": float(c) for axis, c in zip("xyz", vec)})
        out.update(
            focal=self.focal, aspect=self.aspect, near=self.clip_near, far=float(self.far),
            width=int(self.width), height=int(self.height),
        )
        return out


def literal(cam: Camera) -> SimpleNamespace:
    """The camera as literal columns, so Catalyst folds it into the projection."""
    return SimpleNamespace(**{k: F.lit(v) for k, v in cam.values().items()})


def fan_out(df: DataFrame, path: list[Camera], name: str = "cam") -> DataFrame:
    """One copy of each row per frame of a camera path, as a ``cam`` struct with ``cam_id``.

    The path is configuration: it becomes array literals that are exploded inside the scan stage,
    so no join and no exchange is planned.
    """
    frames = [
        F.struct(F.lit(i).alias("cam_id"), *[F.lit(v).alias(k) for k, v in cam.values().items()])
        for i, cam in enumerate(path)
    ]
    n = FRAMES_PER_LITERAL
    parts = [F.array(*frames[i : i + n]) for i in range(0, len(frames), n)]
    if len(parts) == 1:
        return df.withColumn(name, F.explode(parts[0]))
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(len(parts))]))).withColumn(
        name, F.explode(reduce(lambda rest, i: F.when(F.col(name) == i, parts[i]).otherwise(rest), range(len(parts) - 1), parts[-1]))
    )


def fields_of(name: str = "cam") -> SimpleNamespace:
    """Camera columns read from a struct column made by :func:`fan_out`."""
    keys = Camera((0.0, 0.0, 0.0)).values()
    return SimpleNamespace(**{k: F.col(f"{name}.{k}") for k in keys})


def view(cam, x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Camera-space coordinates: ``depth`` along forward, ``right_d`` and ``up_d`` across."""
    dx, dy, dz = x - cam.px, y - cam.py, z - cam.pz
    return {
        "depth": dx * cam.fx + dy * cam.fy + dz * cam.fz,
        "right_d": dx * cam.rx + dy * cam.ry + dz * cam.rz,
        "up_d": dx * cam.ux + dy * cam.uy + dz * cam.uz,
    }


def ndc(cam, depth: Column, right_d: Column, up_d: Column) -> dict[str, Column]:
    """Normalised device coordinates of a point: ``nx`` right, ``ny`` up, both -1..1 on screen."""
    return {"nx": cam.focal / cam.aspect * right_d / depth, "ny": cam.focal * up_d / depth}


def in_depth_range(cam, depth: Column) -> Column:
    return (depth >= cam.near) & (depth <= cam.far)


def in_frustum(half_tan: float, aspect: float, depth: Column, right_d: Column, up_d: Column, h: Column) -> Column:
    """Sphere of radius ``h`` against the side planes and the plane behind the camera."""
    front = F.greatest(depth + h, F.lit(0.0)) * half_tan
    return (depth > -h) & (F.abs(right_d) < front * aspect + h) & (F.abs(up_d) < front + h)


def _box_test(cam: Camera, low: dict, high: dict, h, least, size) -> list:
    """Conditions under which a box of particle centres (``low`` to ``high`` per axis, lengths up to ``h``) may touch a pixel.

    Each compares the least distance over the box from one plane of the view; ``least`` and ``size`` work on columns or arrays.
    """
    f, r, u = cam.basis()

    def nearest(normal):
        parts = [least(n * (low[a] - p), n * (high[a] - p)) for n, a, p in zip(normal, "xyz", cam.position)]
        return parts[0] + parts[1] + parts[2]

    slack = sum(size(low[a]) + size(high[a]) + abs(p) for a, p in zip("xyz", cam.position)) * 1e-9 + h * 1e-9
    found = [nearest([-n for n in f]) <= slack - cam.clip_near, nearest(f) <= slack + cam.far]
    for axis, slope in ((r, cam.aspect / cam.focal), (u, 1.0 / cam.focal)):
        found += [nearest([n * sign - m * slope for n, m in zip(axis, f)]) <= h + slack for sign in (1.0, -1.0)]
    return found


def meets(cam: Camera, low: dict[str, Column], high: dict[str, Column], h: Column) -> Column:
    """Whether a box may hold a visible particle, as a column; never false for a box with one."""
    return reduce(lambda a, b: a & b, _box_test(cam, low, high, h, F.least, F.abs))


def box_meets(cam: Camera, low: dict, high: dict, h):
    """As `meets`, for arrays of boxes."""
    import numpy as np

    return reduce(lambda a, b: a & b, _box_test(cam, low, high, h, np.minimum, np.abs))


# ---- cameras as rows -------------------------------------------------------------------------


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return list(_cross(a, b))


def dot(a: list[Column], b: list[Column]) -> Column:
    return _dot(a, b)


def _columns(prefix: str) -> list[Column]:
    return [F.col(prefix + axis) for axis in "xyz"]


def _assign(df: DataFrame, prefix: str, vec: list[Column]) -> DataFrame:
    return df.withColumns({prefix + axis: c for axis, c in zip("xyz", vec)})


def with_basis(df: DataFrame) -> DataFrame:
    """Adds unit ``f*``, ``r*``, ``u*`` columns from ``forward*`` and ``up*`` columns."""
    fwd, up = _columns("forward"), _columns("up")
    n = F.sqrt(dot(fwd, fwd))
    df = _assign(df, "f", [c / n for c in fwd])
    side = cross(_columns("f"), up)
    n = F.sqrt(dot(side, side))
    df = _assign(df, "r", [c / n for c in side])
    return _assign(df, "u", cross(_columns("r"), _columns("f")))


def rotated(vec: list[Column], axis: list[Column], angle: Column) -> list[Column]:
    """Rodrigues rotation of ``vec`` about unit ``axis``."""
    c, s = F.cos(angle), F.sin(angle)
    turn, along = cross(axis, vec), dot(axis, vec)
    return [v * c + t * s + a * along * (1 - c) for v, t, a in zip(vec, turn, axis)]


def yaw(df: DataFrame, angle: Column) -> DataFrame:
    """Turns the view direction about the basis up; the stored up vector stays."""
    df = with_basis(df)
    return with_basis(_assign(df, "forward", rotated(_columns("forward"), _columns("u"), angle)))


def pitch(df: DataFrame, angle: Column) -> DataFrame:
    """Turns view direction and up vector about the basis right."""
    df = with_basis(df)
    fwd = rotated(_columns("forward"), _columns("r"), angle)
    up = rotated(_columns("up"), _columns("r"), angle)
    return with_basis(_assign(_assign(df, "forward", fwd), "up", up))


def roll(df: DataFrame, angle: Column) -> DataFrame:
    """Turns only the up vector, about the view direction."""
    df = with_basis(df)
    return with_basis(_assign(df, "up", rotated(_columns("up"), _columns("f"), angle)))


# ---- camera paths ----------------------------------------------------------------------------


def zoom_path(start: Camera, target, frames: int, dt: float, tau: float, stop: float) -> list[Camera]:
    """Straight flight to ``target``: distance falls as exp(-t/tau) and is floored at ``stop``.

    The flight has at most ``frames`` frames; its last is the first one at the floor after more than four e-foldings.
    """
    from dataclasses import replace

    gap = [t - p for t, p in zip(target, start.position)]
    far = math.sqrt(_dot(gap, gap))
    at_floor = max(0, math.ceil(tau * math.log(far / stop) / dt)) if far > stop > 0 else 0 if far <= stop else frames
    count = min(frames, max(at_floor, math.floor(4 * tau / dt) + 1) + 1)
    share = [max(math.exp(-i * dt / tau), stop / max(far, 1e-30)) for i in range(count)]  # of the way that is left
    return [replace(start, position=tuple(c - s * g for c, g in zip(target, gap))) for s in share]


def orbit_path(
    start: Camera, center, frames: int, duration: float, period: float, inner: float, outer: float, passes: int
) -> list[Camera]:
    """Orbit in the x-z plane looking inward; the radius swings inner-outer-inner ``passes`` times."""
    from dataclasses import replace

    out = []
    for i in range(frames):
        t = duration * i / max(frames - 1, 1)
        angle = 2 * math.pi * t / period
        swing = 2 * math.pi * passes * t / max(duration, 1e-6)
        radius = 0.5 * (inner + outer) - 0.5 * (outer - inner) * math.cos(swing)
        arm = (radius * math.cos(angle), 0.0, radius * math.sin(angle))
        size = max(math.sqrt(_dot(arm, arm)), 1e-30)
        out.append(
            replace(
                start,
                position=tuple(c + a for c, a in zip(center, arm)),
                forward=tuple(-a / size for a in arm),
                up=(0.0, 1.0, 0.0),
            )
        )
    return out
