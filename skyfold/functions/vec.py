"""Three-vectors and 3x3 matrices as plain Column expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 (ANSI mode would raise) or something is null; each argument occurs once in the expression."""
    return F.coalesce(F.try_divide(a, b), F.lit(NAN))


def clip(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def not_nan(x: Column) -> Column:
    """True where x is a number: Spark orders NaN above all numbers, so comparisons alone don't tell."""
    return x.isNotNull() & ~F.isnan(x)


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, *parts) -> Vec:
        return cls(*(lit(p) for p in parts))

    @classmethod
    def columns(cls, prefix: str) -> Vec:
        return cls(*(F.col(f"{prefix}{a}") for a in "xyz"))

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        """NaN components for the zero vector."""
        n = self.norm()
        return Vec(*(safe_div(c, n) for c in self))

    def named(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{a}") for a, c in zip("xyz", self, strict=True)]


Matrix = tuple[Vec, Vec, Vec]


def matrix(columns: list[Column]) -> Matrix:
    """Row-major 9 columns."""
    return tuple(Vec(*columns[3 * i : 3 * i + 3]) for i in range(3))


def apply(m: Matrix, v: Vec) -> Vec:
    return Vec(*(row.dot(v) for row in m))


def transpose(m: Matrix) -> Matrix:
    return tuple(Vec(*(row[i] for row in m)) for i in range(3))


def product(a: Matrix, b: Matrix) -> Matrix:
    bt = transpose(b)
    return tuple(Vec(*(row.dot(c) for c in bt)) for row in a)


def quaternion(m: Matrix) -> list[Column]:
    """Scalar-first quaternion of a rotation matrix: the largest of the four candidates, with a scalar not negative."""
    (a, b, c), (d, e, f), (g, h, i) = m
    four = [1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i]
    r = [F.sqrt(F.greatest(x, F.lit(0.0))) / 2 for x in four]
    k = lambda n: 4 * r[n]
    pick = [
        [r[0], safe_div(h - f, k(0)), safe_div(c - g, k(0)), safe_div(d - b, k(0))],
        [safe_div(h - f, k(1)), r[1], safe_div(b + d, k(1)), safe_div(c + g, k(1))],
        [safe_div(c - g, k(2)), safe_div(b + d, k(2)), r[2], safe_div(f + h, k(2))],
        [safe_div(d - b, k(3)), safe_div(c + g, k(3)), safe_div(f + h, k(3)), r[3]],
    ]
    top = F.greatest(*four)
    best = [F.when(four[0] == top, pick[0][j]).when(four[1] == top, pick[1][j]).when(four[2] == top, pick[2][j]).otherwise(pick[3][j]) for j in range(4)]
    sign = F.when(best[0] < 0, -1.0).otherwise(1.0)
    return [q * sign for q in best]


def rotation(q: list[Column]) -> Matrix:
    """Rotation matrix of a scalar-first unit quaternion."""
    w, x, y, z = q
    return (
        Vec(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        Vec(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        Vec(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def about(axis: int, angle: Column) -> Matrix:
    """Rotation of the frame by an angle about axis 1, 2 or 3."""
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {1: (Vec(o, z, z), Vec(z, c, s), Vec(z, -s, c)), 2: (Vec(c, z, -s), Vec(z, o, z), Vec(s, z, c)), 3: (Vec(c, s, z), Vec(-s, c, z), Vec(z, z, o))}[axis]


def euler(m: Matrix, sequence: tuple[int, int, int] = (1, 2, 3)) -> list[Column]:
    """Angles (a1, a2, a3), radians, with m = about(s1, a1) about(s2, a2) about(s3, a3)."""
    if not all(s in (1, 2, 3) for s in sequence) or sequence[0] == sequence[1] or sequence[1] == sequence[2]:
        raise ValueError("three axes of 1, 2, 3 without equal neighbours")
    i, j, k = (s - 1 for s in sequence)
    sign = 1.0 if (j - i) % 3 == 1 else -1.0
    if i != k:
        return [F.atan2(sign * m[j][k], m[k][k]), F.asin(clip(-sign * m[i][k], -1.0, 1.0)), F.atan2(sign * m[i][j], m[i][i])]
    o = 3 - i - j
    return [F.atan2(m[j][i], sign * m[o][i]), F.acos(clip(m[i][i], -1.0, 1.0)), F.atan2(m[i][j], -sign * m[i][o])]
