"""Scalar functions over columns; null in, null out, unless said otherwise."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epsilons, fixed values.
EPS = 1e-12
MIN_STD, MIN_GRAD, MIN_BAND_STD = 1e-9, 1e-6, 1e-4

#: Coefficients of rational approximations to erf (Cody, Math. Comp. 23, 1969), fixed values.
ERF_A = (3.1611237438705655, 113.86415415105016, 377.485237685302, 3209.3775891384694, 0.18577770618460315)
ERF_B = (23.601290952344122, 244.02463793444417, 1282.6165260773723, 2844.236833439171)
ERF_C = (0.5641884969886701, 8.883149794388377, 66.11919063714163, 298.6351381974001, 881.952221241769, 1712.0476126340707, 2051.0783778260716, 1230.3393547979972, 2.1531153547440383e-08)
ERF_D = (15.744926110709835, 117.6939508913125, 537.1811018620099, 1621.3895745666903, 3290.7992357334597, 4362.619090143247, 3439.3676741437216, 1230.3393548037495)
ERF_P = (0.30532663496123236, 0.36034489994980445, 0.12578172611122926, 0.016083785148742275, 0.0006587491615298378, 0.016315387137302097)
ERF_Q = (2.568520192289822, 1.8729528499234673, 0.5279051029514285, 0.06051834131244132, 0.0023352049762686918)


def horner(z, lead: float, rest) -> str:
    """SQL text of a polynomial, by Horner's rule."""
    text = f"cast({lead!r} as double)"
    for c in rest:
        text = f"({text} * {z} + cast({c!r} as double))"
    return text


def erf_sql(x: str) -> str:
    """SQL text of erf, for Spark and DuckDB alike."""
    y, s = f"abs({x})", f"(({x}) * ({x}))"
    r = f"(cast(1 as double) / greatest({s}, cast(1e-300 as double)))"
    small = f"({x}) * {horner(s, ERF_A[4], ERF_A[:4])} / {horner(s, 1.0, ERF_B)}"
    middle = f"sign({x}) * (1 - exp(-{s}) * {horner(y, ERF_C[8], ERF_C[:8])} / {horner(y, 1.0, ERF_D)})"
    large = f"sign({x}) * (1 - exp(-least({s}, cast(700 as double))) / greatest({y}, cast(1 as double)) * (cast({1 / math.sqrt(math.pi)!r} as double) - {r} * {horner(r, ERF_P[5], ERF_P[:5])} / {horner(r, 1.0, ERF_Q)}))"
    return f"(case when {y} <= 0.46875 then {small} when {y} <= 4 then {middle} when {y} < 6 then {large} else cast(sign({x}) as double) end)"


def normal_cdf_sql(x: str) -> str:
    return f"(cast(0.5 as double) * (1 + {erf_sql(f'(({x}) / cast({math.sqrt(2.0)!r} as double))')}))"


def normal_cdf(name: str) -> Column:
    """The standard normal distribution function of a column, by name; within 2e-16 of the double-precision one."""
    return F.expr(normal_cdf_sql(f"`{name}`"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def clamp_positive(x: Column, eps: float = EPS) -> Column:
    return F.greatest(x, F.lit(eps))


def sigmoid(x: Column) -> Column:
    """Stable on either side of zero."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def equivalent(a: Column, b: Column, tolerance: float = EPS) -> Column:
    return F.abs(a - b) <= tolerance + tolerance * F.abs(b)


def safe_ratio(a: Column, b: Column) -> Column:
    """NaN under a non-finite denominator; over one of up to EPS, 0 for a numerator of up to EPS and infinity for any other."""
    small = F.when(F.abs(a) <= EPS, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(F.isnan(b) | (F.abs(b) == float("inf")), F.lit(float("nan"))).when(F.abs(b) <= EPS, small).otherwise(F.try_divide(a, b))


def charbonnier(x: Column, scale: float = 1.0, eps: float = 1e-3) -> Column:
    """A smooth absolute value of x / scale, times the scale."""
    if scale <= 0 or eps <= 0:
        raise ValueError("scale and eps have to be positive")
    y = x / scale
    return scale * (F.sqrt(y * y + eps * eps) - eps)


def finite(x: Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def rbf(d2: Column, lengthscale: float = 0.34, variance: float = 1.0) -> Column:
    """The kernel of a squared distance."""
    return variance * F.exp(-0.5 * d2 / (lengthscale * lengthscale))


def ard(deltas: list[Column], lengthscales: list[float], variance: float = 1.0) -> Column:
    return variance * F.exp(-0.5 * sum((d / s) * (d / s) for d, s in zip(deltas, lengthscales, strict=True)))


#: Radii of the analytic shapes, fixed values: of a scene's sphere and torus, and of those of a backend's benchmark.
SPHERE, TORUS = 0.72, (0.78, 0.28)
BENCHMARK_SPHERE, BENCHMARK_TORUS = 0.65, (0.62, 0.22)


def _torus(x: Column, y: Column, z: Column, major: float, minor: float) -> Column:
    ring = F.sqrt(x * x + y * y) - major
    return F.sqrt(ring * ring + z * z) - minor


def sdf(x: Column, y: Column, z: Column, shape: str) -> Column:
    """Signed distances of a scene's analytic shapes."""
    if shape == "sphere":
        return norm3(x, y, z) - SPHERE
    if shape == "torus":
        return _torus(x, y, z, *TORUS)
    if shape == "two_objects":
        return F.least(norm3(x + 0.52, y, z) - 0.47, norm3(x - 0.52, y, z) - 0.42)
    if shape == "non_star_convex":
        return F.greatest(norm3(x, y, z) - 0.82, 0.62 - norm3(x - 0.38, y, z))
    raise ValueError(f"unknown shape {shape!r}")


def benchmark_sdf(x: Column, y: Column, z: Column, shape: str) -> Column:
    """Signed distances of the shapes that backends are compared on."""
    if shape == "sphere":
        return norm3(x, y, z) - BENCHMARK_SPHERE
    if shape == "torus":
        return _torus(x, y, z, *BENCHMARK_TORUS)
    if shape == "wavy_plane":
        return z - 0.18 * F.sin(4 * x) * F.cos(4 * y)
    raise ValueError(f"unknown shape {shape!r}")


def sdf_normal(x: Column, y: Column, z: Column, shape: str, eps: float = 1e-3) -> tuple[Column, Column, Column]:
    """Central differences, normalised."""
    grads = []
    for axis in range(3):
        moved = lambda sign, axis=axis: [c + sign * eps if k == axis else c for k, c in enumerate((x, y, z))]
        grads.append((sdf(*moved(1), shape) - sdf(*moved(-1), shape)) / (2 * eps))
    length = F.greatest(norm3(*grads), F.lit(1e-8))
    return tuple(g / length for g in grads)


def affine(x: Column, y: Column, z: Column, matrix) -> tuple[Column, Column, Column]:
    """A 4 x 4 matrix (rows) applied to points."""
    return tuple(x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + float(r[3]) for r in matrix[:3])


def pinhole(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, convention: str = "opencv") -> tuple[Column, Column, Column]:
    """(u, v, depth) of points in camera coordinates; opengl looks along -z with y up."""
    depth = z if convention == "opencv" else -z
    safe = F.when(F.abs(depth) < EPS, EPS).otherwise(depth)
    v = fy * y / safe + cy if convention == "opencv" else -fy * y / safe + cy
    return fx * x / safe + cx, v, depth


def distorted(x: Column, y: Column, model: str, k: dict[str, float]) -> tuple[Column, Column]:
    """Normalised image points under a camera model: pinhole, radial (k1, k2), opencv (k1, k2, p1, p2), fisheye (k1 to k4)."""
    r2 = x * x + y * y
    g = lambda n: float(k.get(n, 0.0))
    if "fisheye" in model:
        r = F.sqrt(r2)
        t = F.atan(r)
        t2 = t * t
        scale = F.when(r > 1e-8, t * (1 + t2 * (g("k1") + t2 * (g("k2") + t2 * (g("k3") + t2 * g("k4"))))) / F.greatest(r, F.lit(1e-8))).otherwise(1.0)
        return x * scale, y * scale
    radial = 1 + r2 * (g("k1") + r2 * (g("k2") + r2 * g("k3")))
    return (
        x * radial + 2 * g("p1") * x * y + g("p2") * (r2 + 2 * x * x),
        y * radial + g("p1") * (r2 + 2 * y * y) + 2 * g("p2") * x * y,
    )


def rotation(q: list[Column]) -> list[list[Column]]:
    """The matrix of a quaternion (w, x, y, z), normalised; zero is the identity."""
    n = F.sqrt(sum(c * c for c in q))
    ok = n > EPS
    w, x, y, z = (F.when(ok, c / F.greatest(n, F.lit(EPS))).otherwise(1.0 if k == 0 else 0.0) for k, c in enumerate(q))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def covariance(scales: list[Column], q: list[Column]) -> list[list[Column]]:
    """R diag(s^2) R'."""
    r = rotation(q)
    return [[sum(r[i][k] * r[j][k] * scales[k] * scales[k] for k in range(3)) for j in range(3)] for i in range(3)]


def quaternion(m: list[list[Column]]) -> list[Column]:
    """(w, x, y, z) of a rotation matrix: by the trace if it is positive, else by the largest diagonal element."""
    trace = m[0][0] + m[1][1] + m[2][2]
    root = lambda v: F.sqrt(F.greatest(v, F.lit(EPS)))
    s0 = 2 * root(trace + 1)
    s1, s2, s3 = (2 * root(1 + m[i][i] - m[(i + 1) % 3][(i + 1) % 3] - m[(i + 2) % 3][(i + 2) % 3]) for i in range(3))
    by = [
        [s0 / 4, (m[2][1] - m[1][2]) / s0, (m[0][2] - m[2][0]) / s0, (m[1][0] - m[0][1]) / s0],
        [(m[2][1] - m[1][2]) / s1, s1 / 4, (m[0][1] + m[1][0]) / s1, (m[0][2] + m[2][0]) / s1],
        [(m[0][2] - m[2][0]) / s2, (m[0][1] + m[1][0]) / s2, s2 / 4, (m[1][2] + m[2][1]) / s2],
        [(m[1][0] - m[0][1]) / s3, (m[0][2] + m[2][0]) / s3, (m[1][2] + m[2][1]) / s3, s3 / 4],
    ]
    x_largest = (m[0][0] > m[1][1]) & (m[0][0] > m[2][2])
    return [F.when(trace > 0, by[0][k]).when(x_largest, by[1][k]).when(m[1][1] > m[2][2], by[2][k]).otherwise(by[3][k]) for k in range(4)]


def rotation_angle(trace: Column) -> Column:
    """Degrees of a rotation from its matrix's trace."""
    return F.degrees(F.acos(clamp((trace - 1) / 2, -1.0, 1.0)))


def threshold_label(value: float) -> str:
    return f"{value:g}".replace("-", "m").replace(".", "p")


def source_map(encoded: Column) -> Column:
    """k=v;k=v as a map; empty for null and empty."""
    return F.when(F.coalesce(encoded, F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(encoded, F.lit(";"), F.lit("=")))


def sha256_12(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def natural_key(name: Column) -> Column:
    """Sorts as text in which runs of digits are numbers: digit runs are padded to 20 places."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def psnr(mse: Column) -> Column:
    return F.when(mse <= 1e-12, float("inf")).otherwise(10 * F.log10(1 / F.greatest(mse, F.lit(1e-300))))
