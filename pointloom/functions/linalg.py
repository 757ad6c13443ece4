"""3-vectors and symmetric 3x3 matrices as tuples of Columns.

A vector is ``(x, y, z)``; a symmetric matrix is ``(xx, xy, xz, yy, yz, zz)``; a
rotation is nine row-major Columns.  Everything stays inside code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")


def cols(prefix: str, names=("x", "y", "z")) -> tuple[Column, ...]:
    return tuple(F.col(prefix + n) for n in names)


def add(a, b):
    return tuple(p + q for p, q in zip(a, b))


def sub(a, b):
    return tuple(p - q for p, q in zip(a, b))


def scale(a, s):
    return tuple(p * s for p in a)


def dot(a, b) -> Column:
    total = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        total = total + p * q
    return total


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def mat_vec(r, v):
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def mat_t(r):
    return tuple(r[3 * j + i] for i in range(3) for j in range(3))


def mat_mul(a, b):
    return tuple(
        a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)
    )


def rigid(tf: Column | str):
    """Split a row-major 4x4 array column into (rotation, translation)."""
    tf = F.col(tf) if isinstance(tf, str) else tf
    rot = tuple(tf[4 * i + j] for i in range(3) for j in range(3))
    return rot, tuple(tf[4 * i + 3] for i in range(3))


def rigid_array(rot, trans) -> Column:
    """Row-major 4x4 array column from nine rotation and three translation Columns."""
    cells = []
    for i in range(3):
        cells += [rot[3 * i], rot[3 * i + 1], rot[3 * i + 2], trans[i]]
    return F.array(*[c.cast("double") for c in cells], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def rigid_apply(tf, v):
    rot, trans = rigid(tf)
    return add(mat_vec(rot, v), trans)


def rigid_inverse(tf) -> Column:
    rot, trans = rigid(tf)
    back = mat_t(rot)
    return rigid_array(back, scale(mat_vec(back, trans), F.lit(-1.0)))


def rigid_mul(a, b) -> Column:
    ra, ta = rigid(a)
    rb, tb = rigid(b)
    return rigid_array(mat_mul(ra, rb), add(mat_vec(ra, tb), ta))


def quaternion_rotation(qx, qy, qz, qw):
    """Rotation of a unit quaternion given in x, y, z, w order."""
    one, two = F.lit(1.0), F.lit(2.0)
    return (
        one - two * (qy * qy + qz * qz), two * (qx * qy - qz * qw), two * (qx * qz + qy * qw),
        two * (qx * qy + qz * qw), one - two * (qx * qx + qz * qz), two * (qy * qz - qx * qw),
        two * (qx * qz - qy * qw), two * (qy * qz + qx * qw), one - two * (qx * qx + qy * qy),
    )


def axis_angle(rot):
    """Rotation vector (log map) of a rotation matrix; zero for the identity."""
    angle = F.acos(clamp((rot[0] + rot[4] + rot[8] - 1.0) / 2.0, -1.0, 1.0))
    axis = (rot[7] - rot[5], rot[2] - rot[6], rot[3] - rot[1])
    factor = F.when(F.sin(angle) > 1e-12, angle / (2.0 * F.sin(angle))).otherwise(F.lit(0.5))
    return scale(axis, factor)


def rotation_angle_deg(rot) -> Column:
    return F.degrees(F.acos(clamp((rot[0] + rot[4] + rot[8] - 1.0) / 2.0, -1.0, 1.0)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sym_vec(s, v):
    return (
        s[0] * v[0] + s[1] * v[1] + s[2] * v[2],
        s[1] * v[0] + s[3] * v[1] + s[4] * v[2],
        s[2] * v[0] + s[4] * v[1] + s[5] * v[2],
    )


def rotate_sym(rot, s):
    """R S R' of a symmetric matrix, as six Columns."""
    rows = [sym_vec(s, rot[3 * i : 3 * i + 3]) for i in range(3)]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    return tuple(dot(rows[i], rot[3 * j : 3 * j + 3]) for i, j in pairs)


def sym_det(s) -> Column:
    return (
        s[0] * (s[3] * s[5] - s[4] * s[4])
        - s[1] * (s[1] * s[5] - s[4] * s[2])
        + s[2] * (s[1] * s[4] - s[3] * s[2])
    )


def mahalanobis(s, v) -> Column:
    """sqrt(v' S^-1 v) through the adjugate of a symmetric 3x3 matrix."""
    adj = (
        s[3] * s[5] - s[4] * s[4], s[2] * s[4] - s[1] * s[5], s[1] * s[4] - s[2] * s[3],
        s[0] * s[5] - s[2] * s[2], s[1] * s[2] - s[0] * s[4], s[0] * s[3] - s[1] * s[1],
    )
    return F.sqrt(F.try_divide(dot(v, sym_vec(adj, v)), sym_det(s)))


def fence(c: Column) -> Column:
    """The same value, but computed where it stands.

    Catalyst moves filters below projections by copying the projected expressions into
    them; for nested eigenvector formulas the copies grow without bound.  It never does so
    for an expression that depends on the partition.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def with_eigenvalues(df: DataFrame, sym=SYM, out=("l0", "l1", "l2")) -> DataFrame:
    """Ascending eigenvalues of a symmetric 3x3 matrix by the trigonometric closed form."""
    s = tuple(F.col(n) for n in sym)
    df = df.withColumns(
        {
            "_q": (s[0] + s[3] + s[5]) / 3.0,
            "_off": s[1] * s[1] + s[2] * s[2] + s[4] * s[4],
        }
    )
    q = F.col("_q")
    d = (s[0] - q, s[3] - q, s[5] - q)
    df = df.withColumn("_p", F.sqrt((dot(d, d) + 2.0 * F.col("_off")) / 6.0))
    p = F.col("_p")
    det = sym_det((d[0], s[1], s[2], d[1], s[4], d[2]))
    df = df.withColumn(
        "_phi", F.when(p > 1e-100, F.acos(clamp(det / (2.0 * p * p * p), -1.0, 1.0)) / 3.0).otherwise(F.lit(0.0))
    )
    phi = F.col("_phi")
    df = df.withColumns({"_l2": q + 2.0 * p * F.cos(phi), "_l0": q + 2.0 * p * F.cos(phi + F.lit(2.0 * math.pi / 3.0))})
    low, high = F.col("_l0"), F.col("_l2")
    df = df.withColumns({out[0]: fence(low), out[1]: fence(3.0 * q - low - high), out[2]: fence(high)})
    return df.drop("_q", "_off", "_p", "_phi", "_l0", "_l2")


def with_eigenvector(df: DataFrame, value: str, out=("nx", "ny", "nz"), sym=SYM) -> DataFrame:
    """Unit eigenvector for eigenvalue column ``value``.

    It is the longest cross product of two rows of S - lambda I, signed so that its
    last non-negligible component is positive; the z axis when all products vanish.
    """
    s = tuple(F.col(n) for n in sym)
    lam = F.col(value)
    rows = ((s[0] - lam, s[1], s[2]), (s[1], s[3] - lam, s[4]), (s[2], s[4], s[5] - lam))
    prods = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    names = [[f"_c{k}{a}" for a in "xyz"] for k in range(3)]
    df = df.withColumns({n: c for k in range(3) for n, c in zip(names[k], prods[k])})
    vecs = [tuple(F.col(n) for n in names[k]) for k in range(3)]
    df = df.withColumns({f"_n{k}": dot(vecs[k], vecs[k]) for k in range(3)})
    n0, n1, n2 = F.col("_n0"), F.col("_n1"), F.col("_n2")

    def pick(a, b, c):
        return F.when((n0 >= n1) & (n0 >= n2), a).when(n1 >= n2, b).otherwise(c)

    df = df.withColumns(
        {"_len": F.sqrt(F.greatest(n0, n1, n2)), **{f"_v{a}": pick(*(v[i] for v in vecs)) for i, a in enumerate("xyz")}}
    )
    ok = F.col("_len") > 1e-300
    axis = (0.0, 0.0, 1.0)
    df = df.withColumns(
        {f"_v{a}": F.when(ok, F.col(f"_v{a}") / F.col("_len")).otherwise(F.lit(axis[i])) for i, a in enumerate("xyz")}
    )
    eps = 1e-9
    flip = (
        F.when(F.abs(F.col("_vz")) > eps, F.col("_vz"))
        .when(F.abs(F.col("_vy")) > eps, F.col("_vy"))
        .otherwise(F.col("_vx"))
    )
    df = df.withColumn("_sign", F.when(flip < 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    df = df.withColumns({o: fence(F.col(f"_v{a}") * F.col("_sign")) for o, a in zip(out, "xyz")})
    drop = [n for trio in names for n in trio] + ["_n0", "_n1", "_n2", "_len", "_vx", "_vy", "_vz", "_sign"]
    return df.drop(*drop)
