"""The rotation of a least-squares fit, in columns.

The best unit quaternion is the eigenvector, to the greatest eigenvalue, of a symmetric 4 x 4 matrix made of the nine weighted products. Its
characteristic polynomial has no cubic term and real roots only, so that Newton steps from above the greatest one fall onto it; a column of the adjugate of
(matrix - eigenvalue) is the eigenvector. No Python worker, a few hundred operations a frame.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: Newton steps; near a double root each one still halves the distance.
STEPS = 60
#: Below this slope of the polynomial, for products of norm 1, the best rotation is not unique; then one with little turn is preferred, by this much.
FLAT, BIAS = 1e-9, 1e-5


def _sign(p: tuple[int, ...]) -> int:
    return -1 if sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2 else 1


def _det3(m: list[list[Column]]) -> Column:
    total = None
    for p in permutations(range(3)):
        term = m[0][p[0]] * m[1][p[1]] * m[2][p[2]]
        total = term if total is None else total + term if _sign(p) > 0 else total - term
    return total


def _greatest(s: dict[str, Column]) -> tuple[Column, Column]:
    """The greatest eigenvalue for products of norm 1, and the polynomial's slope there."""
    linear = _det3([[s[a + b] for b in XYZ] for a in XYZ]) * -8.0
    inner = {a + b: sum(s[c + a] * s[c + b] for c in XYZ) for a in XYZ for b in XYZ}
    size = sum(s[a + b] * s[a + b] for a in XYZ for b in XYZ)
    last = sum(inner[k] * inner[k] for k in inner) * 2.0 - size * size
    terms = F.struct(linear.alias("c1"), (size * -2.0).alias("c2"), last.alias("c0"))

    def step(x: Column, c: Column) -> Column:
        slope = 4.0 * x * x * x + 2.0 * c["c2"] * x + c["c1"]
        return F.when(slope > 1e-14, x - (((x * x + c["c2"]) * x + c["c1"]) * x + c["c0"]) / slope).otherwise(x)

    root = F.aggregate(F.array_repeat(terms, STEPS), F.sqrt(size) * 3.0**0.5, step)
    return root, 4.0 * root * root * root + 2.0 * terms["c2"] * root + terms["c1"]


def turns(sums: DataFrame, dims: int = 3) -> DataFrame:
    """sums with columns m<a><b> = sum of weight * (own coordinate a) * (reference coordinate b), both about their centres, plus the rotation q<a><b> that
    turns own coordinates onto the reference. dims 2: about z only. All products 0: no turn. Where turns fit equally well, one of them."""
    m = {a + b: F.col(f"m{a}{b}") for a in XYZ for b in XYZ}
    if dims == 2:
        co, si = m["xx"] + m["yy"], m["xy"] - m["yx"]
        norm = F.sqrt(co * co + si * si)
        cos, sin = F.coalesce(F.try_divide(co, norm), F.lit(1.0)), F.coalesce(F.try_divide(si, norm), F.lit(0.0))
        one, zero = F.lit(1.0), F.lit(0.0)
        return sums.withColumns(dict(zip([f"q{a}{b}" for a in XYZ for b in XYZ], [cos, -sin, zero, sin, cos, zero, zero, zero, one])))
    temporary = []

    def keep(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        temporary.extend(columns)
        return df.withColumns(columns)

    norm = F.sqrt(sum(c * c for c in m.values()))
    out = keep(sums, {f"_s{k}": F.coalesce(F.try_divide(c, norm), F.lit(1.0 if k[0] == k[1] else 0.0)) for k, c in m.items()})
    s = {k: F.col(f"_s{k}") for k in m}
    out = keep(out, {"_slope": _greatest(s)[1]})
    out = keep(out, {f"_t{k}": c + F.when(F.col("_slope") < FLAT, BIAS).otherwise(0.0) if k[0] == k[1] else c for k, c in s.items()})
    s = {k: F.col(f"_t{k}") for k in m}
    out = keep(out, {"_root": _greatest(s)[0]})
    root = F.col("_root")
    diagonal = [s["xx"] + s["yy"] + s["zz"], s["xx"] - s["yy"] - s["zz"], s["yy"] - s["xx"] - s["zz"], s["zz"] - s["xx"] - s["yy"]]
    upper = {(0, 1): s["yz"] - s["zy"], (0, 2): s["zx"] - s["xz"], (0, 3): s["xy"] - s["yx"], (1, 2): s["xy"] + s["yx"], (1, 3): s["zx"] + s["xz"], (2, 3): s["yz"] + s["zy"]}
    out = keep(out, {f"_k{i}{i}": d - root for i, d in enumerate(diagonal)} | {f"_k{i}{j}": c for (i, j), c in upper.items()})
    cell = lambda i, j: F.col(f"_k{min(i, j)}{max(i, j)}")
    minor = lambda i, j: _det3([[cell(r, c) for c in range(4) if c != j] for r in range(4) if r != i])
    out = keep(out, {f"_a{i}{j}": minor(i, j) * (-1.0) ** (i + j) for i in range(4) for j in range(i, 4)})
    adjugate = lambda i, j: F.col(f"_a{min(i, j)}{max(i, j)}")
    out = keep(out, {"_most": F.greatest(*[F.abs(adjugate(i, i)) for i in range(4)])})
    picked = [F.coalesce(*[F.when(F.abs(adjugate(k, k)) == F.col("_most"), adjugate(k, i)) for k in range(4)]) for i in range(4)]
    out = keep(out, {f"_p{i}": c for i, c in enumerate(picked)})
    length = F.sqrt(sum(F.col(f"_p{i}") * F.col(f"_p{i}") for i in range(4)))
    out = keep(out, {f"_q{i}": F.coalesce(F.try_divide(F.col(f"_p{i}"), length), F.lit(float(i == 0))) for i in range(4)})
    w, x, y, z = (F.col(f"_q{i}") for i in range(4))
    rows = [w * w + x * x - y * y - z * z, 2.0 * (x * y - w * z), 2.0 * (x * z + w * y), 2.0 * (x * y + w * z), w * w - x * x + y * y - z * z, 2.0 * (y * z - w * x), 2.0 * (x * z - w * y), 2.0 * (y * z + w * x), w * w - x * x - y * y + z * z]
    return out.withColumns(dict(zip([f"q{a}{b}" for a in XYZ for b in XYZ], rows))).drop(*temporary)
