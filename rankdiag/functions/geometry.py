"""Rigid transforms, boxes and camera projection as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Rotation = tuple[Vector, Vector, Vector]


def rotation(w: Column, x: Column, y: Column, z: Column) -> Rotation:
    """Rotation matrix of a unit quaternion."""
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        (2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        (2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def to_ego(r: Rotation, t: Vector, p: Vector) -> Vector:
    """Transpose of r times (p - t)."""
    d = [a - b for a, b in zip(p, t, strict=True)]
    return tuple(r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3))


def to_city(r: Rotation, t: Vector, p: Vector) -> Vector:
    """r times p plus t."""
    return tuple(r[i][0] * p[0] + r[i][1] * p[1] + r[i][2] * p[2] + t[i] for i in range(3))


def ego_yaw(r: Rotation) -> Column:
    return F.atan2(r[1][0], r[0][0])


def corners(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """Eight corners as structs, signs in order of x, y, z, each - before +."""
    out = []
    for sx in (-0.5, 0.5):
        for sy in (-0.5, 0.5):
            for sz in (-0.5, 0.5):
                dx, dy = length * sx, width * sy
                out.append(F.struct((x + dx * F.cos(yaw) - dy * F.sin(yaw)).alias("x"), (y + dx * F.sin(yaw) + dy * F.cos(yaw)).alias("y"), (z + height * sz).alias("z")))
    return F.array(*out)


def rotated_corners(centre: Vector, size: Vector, r: Rotation) -> Column:
    """As corners, for a box turned by a whole rotation matrix."""
    out = []
    for sx in (-0.5, 0.5):
        for sy in (-0.5, 0.5):
            for sz in (-0.5, 0.5):
                p = to_city(r, centre, (size[0] * sx, size[1] * sy, size[2] * sz))
                out.append(F.struct(*[v.alias(n) for v, n in zip(p, "xyz", strict=True)]))
    return F.array(*out)


#: Pairs of corner numbers that differ in one sign.
EDGES = [(i, i ^ b) for i in range(8) for b in (1, 2, 4) if i < i ^ b]


def project(points: Column, fx: float, fy: float, cx: float, cy: float, width: float, height: float, near: float = 0.1) -> Column:
    """The box that a camera sees of eight corners (z ahead), clipped at the near plane; null out of view.

    Corners before the plane stay, edges that cross it add their crossing; the box is clamped to the image and must
    cover more than one square pixel.
    """
    def cut(p: Column, q: Column) -> Column:
        t = (near - p["z"]) / (q["z"] - p["z"])
        at = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"), F.lit(near).alias("z"))
        return F.when((p["z"] >= near) != (q["z"] >= near), at)

    def seen(p: Column) -> Column:
        crossed = F.array(*[cut(F.get(p, i), F.get(p, j)) for i, j in EDGES])
        return F.concat(F.filter(p, lambda c: c["z"] >= near), F.filter(crossed, lambda c: c.isNotNull()))

    def bounds(s: Column) -> Column:
        u, v = F.transform(s, lambda c: c["x"] * fx / c["z"] + cx), F.transform(s, lambda c: c["y"] * fy / c["z"] + cy)
        return F.array(F.greatest(F.lit(0.0), F.array_min(u)), F.greatest(F.lit(0.0), F.array_min(v)), F.least(F.lit(width), F.array_max(u)), F.least(F.lit(height), F.array_max(v)))

    def visible(b: Column) -> Column:
        area = F.greatest(F.lit(0.0), F.get(b, 2) - F.get(b, 0)) * F.greatest(F.lit(0.0), F.get(b, 3) - F.get(b, 1))
        return F.when(area > 1.0, b)

    return let(points, lambda p: let(seen(p), lambda s: F.when(F.size(s) > 0, let(bounds(s), visible))))


def project_unclipped(points: Column, fx: float, fy: float, cx: float, cy: float, width: float, height: float, near: float = 0.1) -> Column:
    """As project, for a camera that looks at corners beyond the plane alone; each bound is clamped to the image."""
    def bounds(s: Column) -> Column:
        u, v = F.transform(s, lambda c: c["x"] * fx / c["z"] + cx), F.transform(s, lambda c: c["y"] * fy / c["z"] + cy)
        clamp = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(most), c))
        return F.array(clamp(F.array_min(u), width), clamp(F.array_min(v), height), clamp(F.array_max(u), width), clamp(F.array_max(v), height))

    def visible(b: Column) -> Column:
        return F.when((F.get(b, 2) - F.get(b, 0)) * (F.get(b, 3) - F.get(b, 1)) > 1.0, b)

    return let(F.filter(points, lambda c: c["z"] > near), lambda s: F.when(F.size(s) > 0, let(bounds(s), visible)))


#: One projection of a candidate into a camera; a camera without an image near in time is a missing asset.
PROJECTED, OUT_OF_VIEW, MISSING_ASSET = "PROJECTED", "OUT_OF_VIEW", "MISSING_CAMERA_ASSET"


def projection_entry(camera: str, box: Column, there: Column, image: Column | None = None, delta: Column | None = None) -> Column:
    """(camera_name, status, box, image_path, timestamp_delta_ns) of one camera; `there`: whether it has an image."""
    status = F.when(~there, MISSING_ASSET).when(box.isNotNull(), PROJECTED).otherwise(OUT_OF_VIEW)
    null = lambda c, kind: F.when(there, c if c is not None else F.lit(None).cast(kind)).cast(kind)
    return F.struct(F.lit(camera).alias("camera_name"), status.alias("status"), F.when(there, box).alias("box"), null(image, "string").alias("image_path"), null(delta, "bigint").alias("timestamp_delta_ns"))


def area_sum(entries: Column) -> Column:
    """Projected pixels of an array of entries over all cameras."""
    area = lambda e: F.when(e["box"].isNotNull(), (F.get(e["box"], 2) - F.get(e["box"], 0)) * (F.get(e["box"], 3) - F.get(e["box"], 1))).otherwise(F.lit(0.0))
    return F.aggregate(entries, F.lit(0.0), lambda a, e: a + area(e))


def camera_counts(entries: Column) -> dict[str, Column]:
    """Projected and available cameras of an array of entries, with flags for any and all, and one status."""
    projected = F.size(F.filter(entries, lambda e: e["status"] == PROJECTED))
    available = F.size(F.filter(entries, lambda e: e["status"] != MISSING_ASSET))
    return {
        "projected_camera_count": projected, "available_camera_count": available, "any_projected": projected > 0, "all_assets": available == F.size(entries),
        "projection_status": F.when(projected > 0, PROJECTED).when(available > 0, OUT_OF_VIEW).otherwise("MISSING_CAMERA_FRAMES"),
    }


def fixed_camera(entries: Column, camera: str) -> dict[str, Column]:
    """Single-camera fields for readers that know no list: those of one camera's entry."""
    e = F.get(F.filter(entries, lambda x: x["camera_name"] == camera), 0)
    return {"camera_name": F.lit(camera), "image_path": e["image_path"], "camera_delta_ns": e["timestamp_delta_ns"], "projected_box": e["box"]}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)
