"""Vectors and 4 x 4 matrices as columns. A matrix is array<double> of 16, row after row; v' = v * M."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def c(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a, b) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def matrix(*entries) -> Column:
    return F.array(*map(c, entries))


def identity() -> Column:
    return F.array(*map(F.lit, IDENTITY))


def translation(x, y, z) -> Column:
    return matrix(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z, 1)


def scaling(x, y, z) -> Column:
    return matrix(x, 0, 0, 0, 0, y, 0, 0, 0, 0, z, 0, 0, 0, 0, 1)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def multiply(a: Column, b: Column) -> Column:
    """a * b."""

    def entries(s: Column) -> Column:
        def entry(k: Column) -> Column:
            row, col = (k - k % 4).cast("int"), (k % 4).cast("int")
            return dot([s["a"][row + i] for i in range(4)], [s["b"][F.lit(4 * i) + col] for i in range(4)])

        return F.transform(F.sequence(F.lit(0), F.lit(15)), entry)

    return let(F.struct(a.alias("a"), b.alias("b")), entries)


def apply(v, m: Column) -> tuple[Column, Column, Column]:
    """The point v under m (affine)."""
    return tuple(v[0] * m[j] + v[1] * m[4 + j] + v[2] * m[8 + j] + m[12 + j] for j in range(3))


def quaternion(degrees, axis: int) -> Column:
    """A rotation about a coordinate axis as array(x, y, z, w)."""
    half = F.radians(degrees) / 2
    return F.array(*[F.sin(half) if i == axis else F.lit(0.0) for i in range(3)], F.cos(half))


def then(p: Column, q: Column) -> Column:
    """The rotation p followed by q (Hamilton's product q p)."""

    def product(s: Column) -> Column:
        (x1, y1, z1, w1), (x2, y2, z2, w2) = ([s[n][k] for k in range(4)] for n in "qp")
        return F.array(w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2, w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2)

    return let(F.struct(p.alias("p"), q.alias("q")), product)


def rotation(q: Column) -> Column:
    """The matrix of a unit quaternion."""

    def entries(q: Column) -> Column:
        x, y, z, w = (q[k] for k in range(4))
        return matrix(1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w), 0, 2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w), 0, 2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y), 0, 0, 0, 0, 1)

    return let(q, entries)
