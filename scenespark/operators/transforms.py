"""Local matrices, axis systems and geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenespark.functions import linalg as la

#: WGS84: fixed values.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)
ORDERS = ("XYZ", "XZY", "YZX", "YXZ", "ZXY", "ZYX")


def euler_quaternion(degrees, order: Column) -> Column:
    """array(x, y, z, w) of rotations about the axes in an order; the first letter turns first."""
    turns = {a: la.quaternion(d, k) for k, (a, d) in enumerate(zip("XYZ", degrees))}
    out = F.lit(None).cast("array<double>")
    for o in reversed(ORDERS):
        out = F.when(order == o, la.then(la.then(turns[o[0]], turns[o[1]]), turns[o[2]])).otherwise(out)
    return out


def compose(t, q, s) -> Column:
    """The matrix that scales, turns by the quaternion, then moves."""
    return la.multiply(la.multiply(la.scaling(*s), la.rotation(q)), la.translation(*t))


def fbx_local(t, rot_offset, rot_pivot, pre, rot, post, scale_offset, scale_pivot, scale, order: Column, active: Column) -> Column:
    """A node's local matrix from its nine components; pre and post rotation count only where active."""
    add = lambda *vs: [sum(x[1:], x[0]) for x in zip(*vs)]
    neg = lambda v: [-x for x in v]
    xyz = F.lit("XYZ")
    turn = euler_quaternion(rot, F.when(active, order).otherwise(xyz))
    full = la.then(la.then(euler_quaternion(post, xyz), turn), euler_quaternion(pre, xyz))
    turned = F.when(active, la.rotation(full)).otherwise(la.rotation(turn))
    m = la.multiply(turned, la.translation(*add(t, rot_offset, rot_pivot)))
    m = la.multiply(la.translation(*add(scale_offset, scale_pivot, neg(rot_pivot))), m)
    m = la.multiply(la.scaling(*scale), m)
    return la.multiply(la.translation(*neg(scale_pivot)), m)


def to_y_up(axis: Column, p) -> tuple[Column, Column, Column]:
    """A point of a system whose up axis is named, in a Y-up system."""
    x, y, z = p
    pick = lambda a, b, c, d, e: F.when(axis == "X", a).when(axis == "-X", b).when(axis == "-Y", c).when(axis == "Z", d).when(axis == "-Z", e)
    return (pick(-y, y, x, x, x).otherwise(x), pick(x, -x, -y, z, -z).otherwise(y), pick(z, z, -z, -y, y).otherwise(z))


def ecef(lng: Column, lat: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to earth-centred metres."""
    lo, la_ = F.radians(lng), F.radians(lat)
    n = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY2 * F.sin(la_) * F.sin(la_))
    return (n + alt) * F.cos(la_) * F.cos(lo), (n + alt) * F.cos(la_) * F.sin(lo), (n * (1 - ECCENTRICITY2) + alt) * F.sin(la_)


def geodetic(p) -> tuple[Column, Column, Column]:
    """Earth-centred metres to degrees and metres (Bowring's closed form)."""
    x, y, z = p
    b = SEMI_MAJOR * (1 - FLATTENING)
    second = (SEMI_MAJOR * SEMI_MAJOR - b * b) / (b * b)
    r = F.sqrt(x * x + y * y)
    th = F.atan2(z * SEMI_MAJOR, r * b)
    lat = F.atan2(z + second * b * F.pow(F.sin(th), F.lit(3.0)), r - ECCENTRICITY2 * SEMI_MAJOR * F.pow(F.cos(th), F.lit(3.0)))
    n = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY2 * F.sin(lat) * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), r / F.cos(lat) - n


def ecef_frame(lng: Column, lat: Column, alt: Column) -> Column:
    """East, north, up and the origin: the local frame at a place, as a matrix."""
    lo, la_ = F.radians(lng), F.radians(lat)
    x, y, z = ecef(lng, lat, alt)
    return la.matrix(-F.sin(lo), F.cos(lo), 0, 0, -F.sin(la_) * F.cos(lo), -F.sin(la_) * F.sin(lo), F.cos(la_), 0, F.cos(la_) * F.cos(lo), F.cos(la_) * F.sin(lo), F.sin(la_), 0, x, y, z, 1)


def decompose(m: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Translation and scale of a matrix without shear; a mirrored matrix gets a negative scale along x."""
    rows = [tuple(m[4 * i + j] for j in range(3)) for i in range(3)]
    mirrored = F.when(la.dot(la.cross(rows[0], rows[1]), rows[2]) < 0, -1.0).otherwise(1.0)
    size = [la.norm(r) for r in rows]
    return tuple(m[12 + j] for j in range(3)), (size[0] * mirrored, size[1], size[2])


def rotation_of(m: Column) -> Column:
    """The unit quaternion array(x, y, z, w) of a matrix without shear, with w >= 0: from the largest of the four."""

    def body(r: Column) -> Column:
        a = [[r[3 * i + j] for j in range(3)] for i in range(3)]
        w, x, y, z = (1 + a[0][0] + a[1][1] + a[2][2], 1 + a[0][0] - a[1][1] - a[2][2], 1 - a[0][0] + a[1][1] - a[2][2], 1 - a[0][0] - a[1][1] + a[2][2])
        yz, zx, xy = a[1][2] - a[2][1], a[2][0] - a[0][2], a[0][1] - a[1][0]
        syz, szx, sxy = a[1][2] + a[2][1], a[2][0] + a[0][2], a[0][1] + a[1][0]
        largest = F.greatest(w, x, y, z)
        rows = F.when(w == largest, F.array(yz, zx, xy, w)).when(x == largest, F.array(x, sxy, szx, yz)).when(y == largest, F.array(sxy, y, syz, zx)).otherwise(F.array(szx, syz, z, xy))
        return la.let(rows, lambda q: la.let(F.sqrt(sum(q[k] * q[k] for k in range(1, 4)) + q[0] * q[0]) * F.when(q[3] < 0, -1.0).otherwise(1.0), lambda n: F.transform(q, lambda v: v / n)))

    _, scale = decompose(m)
    return la.let(F.array(*[m[4 * i + j] / scale[i] for i in range(3) for j in range(3)]), body)
