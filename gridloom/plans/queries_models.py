"""Queries of tensors, transforms, decompositions, mixtures and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import models, neighborhood, tensor, transforms, wide
from gridloom.operators.thickness import propagated_thickness
from gridloom.plans.lineage import checkpointed
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry(digits=6)
add = REGISTRY.add
P = fx.PART_SQL

# Tensors I + u u' of the embeddings' first three entries: eigenvalues 1, 1 and 1 + u.u.
T = "ten AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), e AS (SELECT *, a * a + b * b + c * c AS s FROM ten)"


def tensors(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    a, b, c = (F.col("embedding")[i].cast("double") for i in range(3))
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("grp"), F.array(1 + a * a, a * b, a * c, 1 + b * b, b * c, 1 + c * c).alias("t"))


@add("tensor_components", "id", "xx xy xz yy yz zz", f"{T} :: SELECT id, 1 + a * a AS xx, a * b AS xy, a * c AS xz, 1 + b * b AS yy, b * c AS yz, 1 + c * c AS zz FROM e")
def _(spark, sf):
    return tensors(spark, sf).select("id", *[tensor.component("t", n).alias(n) for n in tensor.COMPONENTS])


@add("tensor_mean_diffusion", "id", "out", f"{T} :: SELECT id, (3 + s) / 3 AS out FROM e")
def _(spark, sf):
    return tensors(spark, sf).withColumn("out", tensor.mean_diffusion("t"))


@add("tensor_eigenvalues", "id", "e0 e1 e2", f"{T} :: SELECT id, 1.0 AS e0, 1.0 AS e1, 1 + s AS e2 FROM e")
def _(spark, sf):
    return tensor.with_eigenvalues(tensors(spark, sf))


@add("tensor_axial", "id", "out", f"{T} :: SELECT id, 1 + s AS out FROM e")
def _(spark, sf):
    return tensor.axial(tensors(spark, sf))


@add("tensor_radial", "id", "out", f"{T} :: SELECT id, 1.0 AS out FROM e")
def _(spark, sf):
    return tensor.radial(tensors(spark, sf))


@add("tensor_fa", "id", "fa numerator denominator", f"{T} :: SELECT id, sqrt(1.5) * s * sqrt(2 / 3.0) / sqrt(2 + pow(1 + s, 2)) AS fa, s * sqrt(2 / 3.0) AS numerator, sqrt(2 + pow(1 + s, 2)) AS denominator FROM e")
def _(spark, sf):
    return tensor.fa(tensors(spark, sf))


@add("tensor_principal_direction", "id", "vx vy vz", f"{T}, g AS (SELECT *, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN sign(a) WHEN abs(b) >= abs(c) THEN sign(b) ELSE sign(c) END AS f FROM e) :: SELECT id, f * a / sqrt(s) AS vx, f * b / sqrt(s) AS vy, f * c / sqrt(s) AS vz FROM g")
def _(spark, sf):
    return tensors(spark, sf).withColumn("v", tensor.principal_direction("t")).select("id", *[F.col("v")[i].alias(f"v{a}") for i, a in enumerate("xyz")])


_COLOR = f"{T}, q AS (SELECT *, s * sqrt(2.0 / 3) * sqrt(1.5) / sqrt(2 + (1 + s) * (1 + s)) AS fa FROM e)"


@add("tensor_color", "id r g b", "", f"{_COLOR} :: SELECT id, CAST(floor(abs(a) / sqrt(s) * fa * 255) AS BIGINT) AS r, CAST(floor(abs(b) / sqrt(s) * fa * 255) AS BIGINT) AS g, CAST(floor(abs(c) / sqrt(s) * fa * 255) AS BIGINT) AS b FROM q")
def _(spark, sf):
    return tensor.color(tensors(spark, sf))


@add("tensor_reflect", "id", "xy xz yz", f"{T} :: SELECT id, -(a * b) AS xy, -(a * c) AS xz, b * c AS yz FROM e")
def _(spark, sf):
    return tensors(spark, sf).withColumn("t", tensor.reflect("t", 1.0)).select("id", *[tensor.component("t", n).alias(n) for n in ("xy", "xz", "yz")])


@add("tensor_mask", "id", "xx xy", f"{T} :: SELECT id, CASE WHEN grp > 4 THEN 1 + a * a ELSE 0.7 END AS xx, CASE WHEN grp > 4 THEN a * b ELSE 0 END AS xy FROM e")
def _(spark, sf):
    return tensor.mask(tensors(spark, sf), "grp", isotropic=0.7).withColumn("out", F.when(F.col("grp") > 4, F.col("t")).otherwise(F.array(*map(F.lit, (0.7, 0.0, 0.0, 0.7, 0.0, 0.7))))).select("id", tensor.component("out", "xx").alias("xx"), tensor.component("out", "xy").alias("xy"))


@add("tensor_rotate", "id", "xx xy yy", f"{T} :: SELECT id, 1 + b * b AS xx, -(a * b) AS xy, 1 + a * a AS yy FROM e")
def _(spark, sf):
    return tensor.rotate(tensors(spark, sf), [[0, -1, 0], [1, 0, 0], [0, 0, 1]]).select("id", *[tensor.component("out", n).alias(n) for n in ("xx", "xy", "yy")])


# log(I + u u') = log(1 + s) u u' / s
@add("tensor_log", "id", "xx xy", f"{T} :: SELECT id, ln(1 + s) * a * a / s AS xx, ln(1 + s) * a * b / s AS xy FROM e")
def _(spark, sf):
    return tensors(spark, sf).withColumn("l", tensor.log_tensor("t")).select("id", tensor.component("l", "xx").alias("xx"), tensor.component("l", "xy").alias("xy"))


@add("tensor_exp_of_log", "id", "xx yz", f"{T} :: SELECT id, 1 + a * a AS xx, b * c AS yz FROM e")
def _(spark, sf):
    return tensors(spark, sf).withColumn("l", tensor.log_tensor("t")).withColumn("m", tensor.exp_tensor("l")).select("id", tensor.component("m", "xx").alias("xx"), tensor.component("m", "yz").alias("yz"))


def _symmetric(a: str, b: str) -> list[str]:
    """The six components of the product of two commuting symmetric matrices, whose columns begin with a and b."""
    at = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]
    return [" + ".join(f"{a}{at[i][k]} * {b}{at[k][j]}" for k in range(3)) for i in range(3) for j in range(i, 3)]


def _mean_sql(terms: int = 16) -> str:
    """The exponential, by its series, of the mean of the logarithms ln(1 + s) / s u u'."""
    u = ["a * a", "a * b", "a * c", "b * b", "b * c", "c * c"]
    parts = [f"{T}, m AS (SELECT grp, " + ", ".join(f"avg(ln(1 + s) / s * {x}) AS m{i}" for i, x in enumerate(u)) + " FROM e GROUP BY grp)", "p1 AS (SELECT *, " + ", ".join(f"m{i} AS p{i}" for i in range(6)) + " FROM m)"]
    for k in range(2, terms):
        parts.append(f"p{k} AS (SELECT grp, " + ", ".join(f"m{i}" for i in range(6)) + ", " + ", ".join(f"({x}) / {k} AS p{i}" for i, x in enumerate(_symmetric("p", "m"))) + f" FROM p{k - 1})")
    every = " UNION ALL ".join(f"SELECT grp, p0, p3, p5 FROM p{k}" for k in range(1, terms))
    return ", ".join(parts) + f", z AS ({every}) :: SELECT grp, 1 + sum(p0) AS xx, 1 + sum(p3) AS yy, 1 + sum(p5) AS zz FROM z GROUP BY grp"


@add("tensor_log_euclidean_mean", "grp", "xx yy zz", _mean_sql())
def _(spark, sf):
    return tensor.average_log_euclidean(tensors(spark, sf), ["grp"]).select("grp", *[tensor.component("t", n).alias(n) for n in ("xx", "yy", "zz")])


#: A displacement field on the part grid, linear inside, so central differences are exact.
FIELD = f"{P}, f AS (SELECT x, y, v, 0.1 * x + 0.02 * y AS ux, 0.05 * y - 0.01 * x AS uy FROM img)"


def field(spark, sf):
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return fx.part_image(spark, sf).select("x", "y", "v", (0.1 * x + 0.02 * y).alias("ux"), (0.05 * y - 0.01 * x).alias("uy"))


def _strain(mode: str, a: float, b: float, c: float, d: float) -> None:
    @add(f"strain_{mode}", "x y", "a b c d", f"{FIELD} :: SELECT x, y, {a!r} AS a, {b!r} AS b, {c!r} AS c, {d!r} AS d FROM f")
    def _(spark, sf):
        return tensor.strain(field(spark, sf), mode)


_strain("d", 1.1, 0.02, -0.01, 1.05)
_strain("rc", 1.2101, 0.0115, 0.0115, 1.1029)
_strain("lc", 1.2104, 0.01, 0.01, 1.1026)
_strain("l", 0.10505, 0.00575, 0.00575, 0.05145)

ROTATE = [[0.8, -0.6, 2.0], [0.6, 0.8, -1.0]]


@add("transform_points", "id", "px py c_acctbal", "c AS (SELECT c_custkey AS id, c_acctbal, c_custkey * 0.5 AS a, c_nationkey * 1.0 AS b FROM customer) :: SELECT id, 0.8 * a - 0.6 * b + 2 AS px, 0.6 * a + 0.8 * b - 1 AS py, c_acctbal FROM c")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 0.5).alias("px"), (F.col("c_nationkey") * 1.0).alias("py"), "c_acctbal")
    return transforms.apply_to_points(c, ROTATE, ["px", "py"])


@add("transform_inverse_round_trip", "id", "px py", "c AS (SELECT c_custkey AS id, c_custkey * 0.5 AS px, c_nationkey * 1.0 AS py FROM customer) :: SELECT id, px, py FROM c")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 0.5).alias("px"), (F.col("c_nationkey") * 1.0).alias("py"))
    return transforms.apply_to_points(c, transforms.compose(transforms.invert(ROTATE), ROTATE), ["px", "py"])


_WA = f"{P}, g AS (SELECT x, y, x + 0.25 AS px, y + 0.5 AS py FROM img), c AS (SELECT g.x, g.y, sum((CASE WHEN b.x = floor(px) THEN 0.75 ELSE 0.25 END) * 0.5 * b.v) AS v FROM g JOIN img b ON b.x IN (g.x, g.x + 1) AND b.y IN (g.y, g.y + 1) GROUP BY g.x, g.y)"


@add("warp_translation", "x y", "v", f"{_WA} :: SELECT img.x, img.y, coalesce(c.v, 0) AS v FROM img LEFT JOIN c ON c.x = img.x AND c.y = img.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", "v")
    return transforms.warp_affine(a, a, [[1.0, 0.0, 0.25], [0.0, 1.0, 0.5]])


@add("warp_field_constant", "x y", "v", f"{_WA} :: SELECT img.x, img.y, coalesce(c.v, 0) AS v FROM img LEFT JOIN c ON c.x = img.x AND c.y = img.y")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", "v")
    return transforms.warp_field(a, a.select("x", "y", F.lit(0.25).alias("ux"), F.lit(0.5).alias("uy")))


@add("jacobian_determinant", "x y", "v", f"{FIELD} :: SELECT x, y, 1.1 * 1.05 + 0.02 * 0.01 AS v FROM f")
def _(spark, sf):
    return transforms.jacobian(field(spark, sf))


@add("jacobian_log", "x y", "v", f"{FIELD} :: SELECT x, y, ln(1.1 * 1.05 + 0.02 * 0.01) AS v FROM f")
def _(spark, sf):
    return transforms.jacobian(field(spark, sf), log=True)


@add("inverse_error", "x y", "v", f"{P}, m AS (SELECT max(y) AS my FROM img) :: SELECT x, y, CASE WHEN x + 1 <= 49 THEN 0.0 ELSE 1.0 END AS v FROM img, m")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return transforms.inverse_error(a.select("x", "y", F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy")), a.select("x", "y", F.lit(-1.0).alias("ux"), F.lit(0.0).alias("uy")))


@add("lipschitz_bound", "x y", "v", f"{P}, n AS (SELECT a.x, a.y, abs(a.v - b.v) / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS r FROM img a JOIN img b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y)) :: SELECT x, y, max(r) AS v FROM n GROUP BY x, y")
def _(spark, sf):
    return transforms.lipschitz(fx.part_image(spark, sf).select("x", "y", F.col("v").alias("ux"), F.lit(0.0).alias("uy")))


@add("reflection_matrix", "", "a b cx c d cy", f"{P} :: SELECT -1.0 AS a, 0.0 AS b, 2 * sum(x * v) / sum(v) AS cx, 0.0 AS c, 1.0 AS d, 0.0 AS cy FROM img")
def _(spark, sf):
    return transforms.reflection(fx.part_image(spark, sf), "x")


@add("fit_affine", "row", "a b c", "SELECT * FROM (VALUES (0, 0.8, -0.6, 2.0), (1, 0.6, 0.8, -1.0)) t(row, a, b, c)")
def _(spark, sf):
    return _rows(spark, transforms.fit(_pairs(spark, sf), ["px", "py"], ["qx", "qy"]))


@add("fit_rigid", "row", "a b c", "SELECT * FROM (VALUES (0, 0.8, -0.6, 2.0), (1, 0.6, 0.8, -1.0)) t(row, a, b, c)")
def _(spark, sf):
    return _rows(spark, transforms.fit(_pairs(spark, sf), ["px", "py"], ["qx", "qy"], "rigid"))


def _pairs(spark, sf):
    p = fx.part_image(spark, sf).select(F.col("x").cast("double").alias("px"), F.col("w").alias("py"))
    q = transforms.affine([F.col("px"), F.col("py")], ROTATE)
    return p.withColumns({"qx": q[0], "qy": q[1]})


def _rows(spark, m):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "row int, a double, b double, c double")


@add("fit_landmarks", "row", "a b c", "SELECT * FROM (VALUES (0, 1.0, 0.0, 4.0), (1, 0.0, 1.0, 1.0)) t(row, a, b, c)")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.col("lb").alias("label"))
    return _rows(spark, transforms.landmarks(a, a.withColumns({"x": F.col("x") + 4, "y": F.col("y") + 1})))


@add("integrate_field", "id", "px py", "s AS (SELECT i AS id FROM range(5) r(i)) :: SELECT id, id + 2.0 AS px, 1.0 AS py FROM s")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.lit(1.0).alias("ux"), F.lit(0.0).alias("uy"))
    return transforms.integrate(a, spark.range(5).select("id", F.col("id").cast("double").alias("px"), F.lit(1.0).alias("py")), 4)


# Decompositions.
def _matrix(spark, sf, width: int = 64):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, width), lambda x: x.cast("double")).alias("values"))


@add("matrix_covariance", "i j", "c", "m AS (SELECT vec_id, unnest(range(8)) AS i, embedding AS e FROM embeddings), p AS (SELECT a.i AS i, b.i AS j, covar_pop(CAST(a.e[a.i + 1] AS DOUBLE), CAST(b.e[b.i + 1] AS DOUBLE)) AS c FROM m a JOIN m b ON a.vec_id = b.vec_id GROUP BY a.i, b.i) :: SELECT i, j, c FROM p")
def _(spark, sf):
    _, _, cov = models.covariance(_matrix(spark, sf, 8))
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(8) for j in range(8)], "i bigint, j bigint, c double")


@add("principal_components", "component", "variance", None)
def _(spark, sf):
    return models.principal_components(_matrix(spark, sf), 5)


@add("project_on_components", "vec_id", "s0 s1", None)
def _(spark, sf):
    m = _matrix(spark, sf)
    return models.project(m, models.principal_components(m, 2)).select("vec_id", F.col("scores")[0].alias("s0"), F.col("scores")[1].alias("s1"))


SVD_ROUNDS, SVD_SHARE, CCA_ROUNDS = 6, 0.25, 4


def _soft_sql(name: str, source: str, share: float, columns: int) -> str:
    """CTE name (col, w): source (col, w), soft-thresholded to a share of its columns and of length 1."""
    keep = max(1, round(share * columns))
    cut = f"coalesce((SELECT abs(w) FROM {source} ORDER BY abs(w) DESC LIMIT 1 OFFSET {keep}), 0)" if keep < columns else "0"
    return f"{name}_s AS MATERIALIZED (SELECT col, sign(w) * greatest(abs(w) - {cut}, 0) AS w FROM {source}), {name} AS MATERIALIZED (SELECT col, w / (SELECT sqrt(sum(w * w)) FROM {name}_s) AS w FROM {name}_s)"


def _times_sql(name: str, x: str, v: str, y: str) -> str:
    """CTE name (col, w): Y'X v / n for centred cells x and y (row, col, v)."""
    return f"{name}_u AS MATERIALIZED (SELECT row, sum(x.v * v.w) AS u FROM {x} x JOIN {v} v USING (col) GROUP BY row), {name} AS MATERIALIZED (SELECT col, sum(y.v * u) / (SELECT count(*) FROM {name}_u) AS w FROM {y} y JOIN {name}_u USING (row) GROUP BY col)"


def _cells_sql(name: str, lo: int, hi: int) -> str:
    """CTE name (row, col, v): the embeddings' entries lo to hi, centred."""
    return f"{name} AS MATERIALIZED (SELECT row, col, e - avg(e) OVER (PARTITION BY col) AS v FROM (SELECT vec_id AS row, unnest(range({hi - lo})) AS col, CAST(unnest(embedding[{lo + 1}:{hi}]) AS DOUBLE) AS e FROM embeddings))"


def _start_sql(name: str, x: str) -> str:
    return f"{name}_v AS (SELECT col, avg(v * v) AS w FROM {x} GROUP BY col), {name} AS MATERIALIZED (SELECT col, w / (SELECT sqrt(sum(w * w)) FROM {name}_v) AS w FROM {name}_v)"


def _svd_sql(components: int) -> str:
    """Power rounds written out, less the components before."""
    parts, found = [_cells_sql("x", 0, 64), _start_sql("start", "x")], []
    for c in range(components):
        at = "start"
        for k in range(SVD_ROUNDS + 1):
            now = f"z{c}_{k}"
            parts.append(_times_sql(now + "_all", "x", at, "x"))
            less = "".join(f" - coalesce((SELECT w FROM v{i} WHERE v{i}.col = z.col), 0) * (SELECT variance FROM var{i}) * (SELECT sum(a.w * b.w) FROM v{i} a JOIN {at} b USING (col))" for i in range(c))
            parts.append(f"{now} AS MATERIALIZED (SELECT col, w{less} AS w FROM {now}_all z)")
            if k == SVD_ROUNDS:
                parts += [f"v{c} AS MATERIALIZED (SELECT col, w * (SELECT sign(w) FROM {at} ORDER BY abs(w) DESC LIMIT 1) AS w FROM {at})", f"var{c} AS MATERIALIZED (SELECT sum(z.w * v.w) AS variance FROM {now} z JOIN {at} v USING (col))"]
            else:
                parts.append(_soft_sql(f"s{c}_{k}", now, SVD_SHARE, 64))
                at = f"s{c}_{k}"
        found.append(f"SELECT {c} AS component, col, w AS loading, variance FROM v{c}, var{c} WHERE w <> 0")
    return ", ".join(parts) + " :: " + " UNION ALL ".join(found)


def _cca_sql(given: tuple[int, ...] = ()) -> str:
    """Alternating rounds written out; given entries are regressed out of both sides, one after another."""
    parts = [_cells_sql("x", 0, 32), _cells_sql("y", 32, 56)]
    x, y, basis = "x", "y", []
    for g in given:
        parts.append(_cells_sql(f"g{g}", g, g + 1))
        z = f"g{g}"
        for b in basis:  # the given columns are made orthogonal first
            parts.append(f"{z}{b} AS MATERIALIZED (SELECT row, col, a.v - b.v * (SELECT sum(a.v * b.v) / sum(b.v * b.v) FROM {z} a JOIN {b} b USING (row)) AS v FROM {z} a JOIN {b} b USING (row, col))")
            z += b
        basis.append(z)
        for side in (x, y):
            slope = f"(SELECT a.col, sum(a.v * b.v) / sum(b.v * b.v) AS f FROM {side} a JOIN {z} b ON b.row = a.row GROUP BY a.col)"
            parts.append(f"{side}_{g} AS MATERIALIZED (SELECT a.row, a.col, a.v - b.v * p.f AS v FROM {side} a JOIN {z} b ON b.row = a.row JOIN {slope} p ON p.col = a.col)")
        x, y = f"{x}_{g}", f"{y}_{g}"
    parts.append(_start_sql("u0", "x"))
    for k in range(CCA_ROUNDS):
        parts += [_times_sql(f"p{k}", x, f"u{k}", y), _soft_sql(f"v{k}", f"p{k}", 0.5, 24), _times_sql(f"q{k}", y, f"v{k}", x), _soft_sql(f"u{k + 1}", f"q{k}", 0.25, 32)]
    u, v = f"u{CCA_ROUNDS}", f"v{CCA_ROUNDS - 1}"
    parts += [f"a AS (SELECT row, sum(m.v * w) AS s FROM {x} m JOIN {u} USING (col) GROUP BY row)", f"b AS (SELECT row, sum(m.v * w) AS t FROM {y} m JOIN {v} USING (col) GROUP BY row)", "r AS (SELECT sum(s * t) / sqrt(sum(s * s) * sum(t * t)) AS r FROM a JOIN b USING (row))"]
    return ", ".join(parts) + f" :: SELECT 'x' AS side, col, w AS loading, r FROM {u}, r WHERE w <> 0 UNION ALL SELECT 'y', col, w, r FROM {v}, r WHERE w <> 0"


def _entries(spark, sf, lo: int, hi: int):
    return wide.entries(fx.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", lo + 1, hi - lo).alias("values")), "vec_id", "values")


@add("sparse_svd", "component col", "loading variance", _svd_sql(2))
def _(spark, sf):
    variances, loadings = wide.sparse_svd(wide.wide(_entries(spark, sf, 0, 64)), 2, SVD_SHARE, SVD_ROUNDS)
    return loadings.withColumn("variance", F.array(*map(F.lit, variances))[F.col("component")])


def _sparse_pair(spark, sf, given=None):
    r, loadings = wide.sparse_cca(wide.wide(_entries(spark, sf, 0, 32), given), wide.wide(_entries(spark, sf, 32, 56), given), 0.25, 0.5, CCA_ROUNDS)
    return loadings.withColumn("r", F.lit(r))


@add("sparse_cca", "side col", "loading r", _cca_sql())
def _(spark, sf):
    return _sparse_pair(spark, sf)


@add("sparse_partial_cca", "side col", "loading r", _cca_sql((60, 61)))
def _(spark, sf):
    return _sparse_pair(spark, sf, _entries(spark, sf, 60, 62))


@add("ridge_cca", "", "r", None)
def _(spark, sf):
    m = _matrix(spark, sf).select(F.slice("values", 1, 8).alias("a"), F.slice("values", 9, 8).alias("b"))
    return spark.createDataFrame([(models.sparse_cca(m, "a", "b")[0],)], "r double")


@add("sparse_svd_of_moments", "component kept", "variance", None)
def _(spark, sf):
    return models.sparse_svd(_matrix(spark, sf), 3, 0.25).withColumn("kept", F.size(F.filter("loadings", lambda x: x != 0)))


@add("regression", "i", "c", "d AS (SELECT regr_slope(CAST(embedding[3] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS s, regr_intercept(CAST(embedding[3] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) AS k FROM embeddings) :: SELECT CAST(0 AS BIGINT) AS i, s AS c FROM d UNION ALL SELECT 1, k FROM d")
def _(spark, sf):
    m = _matrix(spark, sf, 3).select(F.slice("values", 1, 1).alias("a"), F.col("values")[2].alias("y"))
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(models.ridge(m, "a", "y"))], "i bigint, c double")


def _mixture_sql(rounds: int, k: int, smooth: float = 0.0) -> str:
    """Rounds of posteriors (p), class sums (c) and, with smooth, the neighbours' posteriors (n)."""
    i3 = range(k)
    parts = [f"{P}, b AS (SELECT min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd, count(*) AS cells FROM img)", "c0 AS (SELECT " + ", ".join(f"1.0 / {k} AS w{i}, lo + (hi - lo) * {i + 1} / {k + 1} AS m{i}, sd / {k} AS s{i}" for i in i3) + " FROM b)"]

    def posterior(r: int, near: str) -> str:
        like = [f"w{i} * exp(-pow(v - m{i}, 2) / (2 * s{i} * s{i})) / s{i}" + (f" * exp({smooth} * near{i})" if near else "") for i in i3]
        source = f"img JOIN {near} USING (x, y), c{r}" if near else f"img, c{r}"
        total = " + ".join(f"l{i}" for i in i3)
        return f"SELECT x, y, v, " + ", ".join(f"CASE WHEN {total} > 0 THEN l{i} / ({total}) ELSE 1.0 / {k} END AS p{i}" for i in i3) + " FROM (SELECT x, y, v, " + ", ".join(f"{q} AS l{i}" for i, q in enumerate(like)) + f" FROM {source})"

    for r in range(1, rounds + 1):
        near = f"n{r - 1}" if smooth and r > 1 else ""
        parts.append(f"p{r} AS ({posterior(r - 1, near)})")
        parts.append(f"c{r} AS (SELECT " + ", ".join(f"greatest(sum(p{i}), 1e-9) / any_value(cells) AS w{i}, sum(p{i} * v) / greatest(sum(p{i}), 1e-9) AS m{i}, sqrt(greatest(sum(p{i} * v * v) / greatest(sum(p{i}), 1e-9) - pow(sum(p{i} * v) / greatest(sum(p{i}), 1e-9), 2), 1e-6 * pow(any_value(sd), 2))) AS s{i}" for i in i3) + f" FROM p{r}, b)")
        if smooth:
            parts.append(f"n{r} AS (SELECT a.x, a.y, " + ", ".join(f"coalesce(sum(q.p{i}), 0) AS near{i}" for i in i3) + f" FROM p{r} a LEFT JOIN p{r} q ON abs(q.x - a.x) + abs(q.y - a.y) = 1 GROUP BY a.x, a.y)")
    last = f"n{rounds}" if smooth else ""
    parts.append(f"z AS ({posterior(rounds, last)})")
    label = "CASE " + " ".join(f"WHEN p{i} >= greatest({', '.join(f'p{j}' for j in i3)}) THEN {i + 1}" for i in i3) + " END"
    return ", ".join(parts) + f" :: SELECT x, y, CAST({label} AS BIGINT) AS label FROM z"


# Mixtures, fusion, denoising, alignment.
@add("mixture_segmentation", "x y label", "", _mixture_sql(5, 3))
def _(spark, sf):
    return models.mixture(fx.part_image(spark, sf), 3)[0]


@add("mixture_random_field", "x y label", "", _mixture_sql(2, 3, 0.1))
def _(spark, sf):
    return models.mixture(fx.part_image(spark, sf), 3, 2, smooth=0.1)[0]


def _group_means(spark, sf):
    """The mean image of each group: ten images over the whole table."""
    return fx.embed_set(spark, sf).groupBy(F.col("grp").alias("image"), "x", "y").agg(F.avg("v").alias("v"))


@add("joint_label_fusion", "x y label", "", None)
def _(spark, sf):
    e = _group_means(spark, sf).withColumn("label", (F.col("v") > 0).cast("bigint"))
    return models.joint_fusion(e.groupBy("x", "y").agg(F.avg("v").alias("v")), e)


def _staple_sql(raters: int, rounds: int) -> str:
    """Rounds over the patterns of decisions: prior, then truth of each pattern, then each rater's rates."""
    d = lambda j: f"CAST(substr(pattern, {j + 1}, 1) AS INT)"
    parts = [f"{fx.EMBED_SQL}, g AS (SELECT x, y, grp, CAST(avg(v) > 0 AS INT) AS d FROM eset GROUP BY ALL), cell AS (SELECT x, y, string_agg(CAST(d AS VARCHAR), '' ORDER BY grp) AS pattern FROM g GROUP BY x, y), pat AS (SELECT pattern, count(*) AS c FROM cell GROUP BY pattern)"]
    parts.append(f"pri AS (SELECT sum(c * ({' + '.join(d(j) for j in range(raters))})) / (sum(c) * {raters}.0) AS g FROM pat)")
    parts.append("r0 AS (SELECT " + ", ".join(f"0.99999 AS p{j}, 0.99999 AS q{j}" for j in range(raters)) + ")")
    for k in range(1, rounds + 1):
        on = " * ".join(f"(CASE WHEN {d(j)} = 1 THEN p{j} ELSE 1 - p{j} END)" for j in range(raters))
        off = " * ".join(f"(CASE WHEN {d(j)} = 1 THEN 1 - q{j} ELSE q{j} END)" for j in range(raters))
        parts.append(f"t{k} AS (SELECT pattern, c, g * {on} / (g * {on} + (1 - g) * {off}) AS w FROM pat, pri, r{k - 1})")
        parts.append(f"r{k} AS (SELECT " + ", ".join(f"sum(w * c * {d(j)}) / sum(w * c) AS p{j}, sum((1 - w) * c * (1 - {d(j)})) / sum((1 - w) * c) AS q{j}" for j in range(raters)) + f" FROM t{k})")
    return ", ".join(parts) + f" :: SELECT x, y, w AS p FROM cell JOIN t{rounds} USING (pattern)"


@add("staple", "x y", "p", _staple_sql(10, 8))
def _(spark, sf):
    from gridloom.operators import iterative

    e = _group_means(spark, sf).select("x", "y", F.col("image").alias("rater"), (F.col("v") > 0).cast("int").alias("d"))
    return iterative.staple(e, 10, 8)[0]


_DN = f"{P}, w1 AS (SELECT *, lag(v) OVER wx AS xl, lead(v) OVER wx AS xr, lag(v) OVER wy AS yl, lead(v) OVER wy AS yr FROM img WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)), z AS (SELECT var_pop(coalesce(xl, v) + coalesce(xr, v) + coalesce(yl, v) + coalesce(yr, v) - 4 * v) / 20 AS noise FROM w1), q AS (SELECT a.x, a.y, b.x AS qx, b.y AS qy, b.v AS bv FROM img a JOIN img b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2), o AS (SELECT i.i - 1 AS i, j.j - 1 AS j FROM range(3) i(i), range(3) j(j)), m AS (SELECT q.x, q.y, qx, qy, any_value(bv) AS bv, avg(pow(s.v - t.v, 2)) AS d FROM q, o JOIN img s ON s.x = q.x + i AND s.y = q.y + j JOIN img t ON t.x = qx + i AND t.y = qy + j GROUP BY q.x, q.y, qx, qy)"


@add("denoise_nonlocal_means", "x y", "v", f"{_DN} :: SELECT x, y, sum(exp(-d / (2 * noise)) * bv) / sum(exp(-d / (2 * noise))) AS v FROM m, z GROUP BY x, y")
def _(spark, sf):
    return models.denoise(fx.part_image(spark, sf))


@add("bias_field_correction", "x y", "v", None)
def _(spark, sf):
    return models.bias_correct(fx.part_image(spark, sf), 2, 1, 1)


@add("register_translation", "sx sy", "", "SELECT CAST(2 AS INT) AS sx, CAST(-1 AS INT) AS sy")
def _(spark, sf):
    a = fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v"))
    s = models.register_translation(a, a.withColumns({"x": F.col("x") + 2, "y": F.col("y") - 1}), 2)
    return spark.createDataFrame([s], "sx int, sy int")


@add("register_affine", "row", "a b c", None)
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    shape = lambda dx: fx.part_image(spark, sf).select("x", "y", F.exp(-((x - 20 - dx) ** 2) / 100 - (y - 15) ** 2 / 100).alias("v"))
    return _rows(spark, models.register_affine(shape(0.0), shape(1.0), 2))


@add("register_demons", "x y", "ux uy", None)
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    shape = lambda dx: fx.part_image(spark, sf).select("x", "y", F.exp(-((x - 20 - dx) ** 2) / 100 - (y - 15) ** 2 / 100).alias("v"))
    return models.register_demons(shape(0.0), shape(1.0), 1)


@add("blob_detector", "x y", "sigma response", None)
def _(spark, sf):
    return models.blobs(fx.part_image(spark, sf), (1.0, 1.5, 2.0), 5, "w")


@add("canny_edges", "x y v", "", None)
def _(spark, sf):
    return models.canny(fx.part_image(spark, sf), 1.0, 1.0, 2.0, "w")


_LT = ", ".join(f"n{k} AS (SELECT x, y, l, v, lag(v) OVER wx AS xl, lead(v) OVER wx AS xr, lag(v) OVER wy AS yl, lead(v) OVER wy AS yr FROM t{k - 1} WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y)), t{k} AS (SELECT x, y, l, CASE WHEN l = 3 THEN (coalesce(xl, 0) + coalesce(xr, 0) + coalesce(yl, 0) + coalesce(yr, 0)) / ((xl IS NOT NULL)::INT + (xr IS NOT NULL)::INT + (yl IS NOT NULL)::INT + (yr IS NOT NULL)::INT) ELSE v END AS v FROM n{k})" for k in range(1, 6))
_LT = f"{P}, t0 AS (SELECT x, y, CASE WHEN x < 10 THEN 1 WHEN x < 20 THEN 3 ELSE 2 END AS l, CASE WHEN x < 10 THEN 0.0 WHEN x < 20 THEN 0.5 ELSE 1.0 END AS v FROM img WHERE x < 30), {_LT}, g AS (SELECT x, y, l, (coalesce(lead(v) OVER wx, v) - coalesce(lag(v) OVER wx, v)) / (count(*) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1) AS gx, (coalesce(lead(v) OVER wy, v) - coalesce(lag(v) OVER wy, v)) / (count(*) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 1) AS gy FROM t5 WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"


@add("propagated_thickness", "x y", "thickness", None)
def _(spark, sf):
    """The upper part of the smoothed image is the inner tissue, a band of values below it the middle one."""
    a = checkpointed(neighborhood.gaussian(fx.part_image(spark, sf).select("x", "y", F.col("w").alias("v")), 3.0))
    shares = a.select("x", "y", (F.col("v") > 26).cast("double").alias("inner"), F.col("v").between(24.5, 26).cast("double").alias("middle"))
    return propagated_thickness(shares, prior=8, rounds=12)


@add("laplace_thickness", "x y", "v", f"{_LT} :: SELECT x, y, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-9 THEN 1 / sqrt(gx * gx + gy * gy) ELSE 0 END AS v FROM g WHERE l = 3")
def _(spark, sf):
    a = fx.part_image(spark, sf).withColumn("label", F.when(F.col("x") < 10, 1).when(F.col("x") < 20, 3).when(F.col("x") < 30, 2).otherwise(0))
    return models.thickness(a, 1, 2, 3, rounds=5)
