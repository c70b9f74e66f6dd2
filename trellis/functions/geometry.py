"""Plane and space geometry as column expressions; a point is three columns, or two and zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


@dataclass(frozen=True)
class Point:
    x: Column
    y: Column
    z: Column

    def __sub__(self, o: Point) -> Point:
        return Point(self.x - o.x, self.y - o.y, self.z - o.z)

    def __add__(self, o: Point) -> Point:
        return Point(self.x + o.x, self.y + o.y, self.z + o.z)

    def times(self, k: Column | float) -> Point:
        return Point(self.x * k, self.y * k, self.z * k)


def point(prefix: str, space: bool = True) -> Point:
    """Columns ``<prefix>x``, ``<prefix>y`` and, in space, ``<prefix>z``."""
    return Point(F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z") if space else F.lit(0.0))


def dot(a: Point, b: Point) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Point, b: Point) -> Point:
    return Point(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def length(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return length(a - b)


def angle(a: Point, b: Point) -> Column:
    """Between two vectors, in radians; null when one is zero."""
    size = length(a) * length(b)
    return F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), size)))))


def jacobian_2d(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area in the plane."""
    return (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)


def triangle_area(a: Point, b: Point, c: Point) -> Column:
    return length(cross(b - a, c - a)) / 2


def tetra_volume(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Signed; positive when d is on the side to which a, b, c turn left."""
    return dot(cross(b - a, c - a), d - a) / 6


def triangle_aspect(a: Point, b: Point, c: Point) -> Column:
    """Longest edge over the inscribed circle's diameter; infinite when degenerate."""
    edges = [distance(a, b), distance(b, c), distance(c, a)]
    area = triangle_area(a, b, c)
    return F.when(area > 0, F.try_divide(F.greatest(*edges) * (edges[0] + edges[1] + edges[2]), 4 * area)).otherwise(INFINITY)


def tetra_aspect(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Longest edge cubed over 8.48 volumes; infinite when degenerate."""
    longest = F.greatest(distance(a, b), distance(a, c), distance(a, d), distance(b, c), distance(b, d), distance(c, d))
    volume = F.abs(tetra_volume(a, b, c, d))
    return F.when(volume > 0, F.try_divide(longest * longest * longest, 8.48 * volume)).otherwise(INFINITY)


def smallest_angle(a: Point, b: Point, c: Point) -> Column:
    return F.least(angle(b - a, c - a), angle(a - b, c - b), angle(a - c, b - c))


def barycentric(p: Point, a: Point, b: Point, c: Point) -> tuple[Column, Column, Column]:
    """Weights of a, b and c at p in the plane; null in a degenerate triangle."""
    whole = jacobian_2d(a, b, c)
    u, v = F.try_divide(jacobian_2d(p, b, c), whole), F.try_divide(jacobian_2d(a, p, c), whole)
    return u, v, 1 - u - v


def in_triangle(p: Point, a: Point, b: Point, c: Point, tolerance: float = 1e-12) -> Column:
    u, v, w = barycentric(p, a, b, c)
    return F.coalesce((u >= -tolerance) & (v >= -tolerance) & (w >= -tolerance), F.lit(False))


def projection_parameter(p: Point, a: Point, b: Point) -> Column:
    """Where the nearest point of the line a-b lies, 0 at a and 1 at b; 0 if they agree."""
    return F.coalesce(F.try_divide(dot(p - a, b - a), dot(b - a, b - a)), F.lit(0.0))


def distance_to_segment(p: Point, a: Point, b: Point) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), projection_parameter(p, a, b)))
    return distance(p, a + (b - a).times(t))


def distance_to_plane(p: Point, origin: Point, normal: Point) -> Column:
    """Signed, along the normal."""
    return F.try_divide(dot(p - origin, normal), length(normal))


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> tuple[Column, Column, Column]:
    """Whether segments a-b and c-d cross in the plane, and where on each; parallel ones do not."""
    turn = (b.x - a.x) * (d.y - c.y) - (b.y - a.y) * (d.x - c.x)
    t = F.try_divide((c.x - a.x) * (d.y - c.y) - (c.y - a.y) * (d.x - c.x), turn)
    s = F.try_divide((c.x - a.x) * (b.y - a.y) - (c.y - a.y) * (b.x - a.x), turn)
    return F.coalesce(t.between(0, 1) & s.between(0, 1), F.lit(False)), t, s


def rotated(p: Point, around: Point, radians: Column | float) -> Point:
    """Turned in the plane about a point."""
    radians = radians if isinstance(radians, Column) else F.lit(radians)
    dx, dy = p.x - around.x, p.y - around.y
    return Point(around.x + dx * F.cos(radians) - dy * F.sin(radians), around.y + dx * F.sin(radians) + dy * F.cos(radians), p.z)


def edge_crosses_ray(p: Point, a: Point, b: Point) -> Column:
    """Whether the ray from p to the right crosses the edge a-b; an odd count means inside."""
    return ((a.y > p.y) != (b.y > p.y)) & (p.x < a.x + F.try_divide((p.y - a.y) * (b.x - a.x), b.y - a.y))


def orientation(a: Point, b: Point, c: Point) -> Column:
    """1 where a, b, c turn counter-clockwise, -1 clockwise, 0 on a line (in the plane)."""
    return F.signum(jacobian_2d(a, b, c)).cast("int")


def signed_angle(a: Point, b: Point) -> Column:
    """The angle from a to b in the plane, in (-pi, pi]."""
    return F.atan2(a.x * b.y - a.y * b.x, a.x * b.x + a.y * b.y)


def quad_area(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Area of a plane quadrilateral that does not cross itself."""
    p, q = c - a, d - b
    return F.abs(p.x * q.y - p.y * q.x) / 2


def quad_is_convex(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether all four corners turn the same way."""
    turns = [orientation(*t) for t in ((a, b, c), (b, c, d), (c, d, a), (d, a, b))]
    return F.abs(sum(turns[1:], turns[0])) == 4


def on_segment(p: Point, a: Point, b: Point, tolerance: float = 1e-12) -> Column:
    """Whether p lies on the segment from a to b."""
    return distance_to_segment(p, a, b) <= tolerance


def middle(*points: Point) -> Point:
    """The mean of some points."""
    total = points[0]
    for p in points[1:]:
        total = total + p
    return total.times(1.0 / len(points))
