"""Queries over the spectra of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plotweave.operators import alpha as alpha_ops
from plotweave.operators import beta as beta_ops
from plotweave.operators import masks, species, transforms
from plotweave.operators import ordination as ord_ops
from plotweave.plans import workflows
from plotweave.plans.bindings import N_BANDS, SPECTRA_SQL, WAVELENGTHS, rounded, spectra, table

#: Centroids as rows of the table: (iteration, cluster, vec_id).
CENTRES = [(i, j + 1, 20 * i + 3 * j) for i in (1, 2, 3) for j in range(5)]
N_FLAT = N_BANDS


def centroids(spark, sf_dir):
    at = spark.createDataFrame(CENTRES, "iter int, cid int, vec_id bigint")
    return spectra(spark, sf_dir).join(F.broadcast(at), "vec_id").select("iter", "cid", F.col("x").alias("center"))


def centre_sets(spark, sf_dir):
    rows = centroids(spark, sf_dir).orderBy("iter", "cid").collect()  # as many as CENTRES
    return [np.array([r.center for r in rows if r.iter == i]) for i in (1, 2, 3)]


def flat(spark, sf_dir):
    """All bands as columns ``b0`` ... ."""
    # Each number is cast by itself: a filter over all bands would cast the whole array for each of them.
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"b{i}") for i in range(N_FLAT)))


BANDS = tuple(f"b{i}" for i in range(N_FLAT))


def _assigned(spark, sf_dir, *keep):
    return species.assign(spectra(spark, sf_dir), centre_sets(spark, sf_dir), "x", keep)


def species_assign(spark, sf_dir):
    return _assigned(spark, sf_dir, "vec_id").select("vec_id", *(F.col("species")[i].alias(f"iter_{i + 1}") for i in range(3)))


def species_assign_native(spark, sf_dir):
    return species.assign_native(spectra(spark, sf_dir), centroids(spark, sf_dir), "x", "vec_id")


def species_map(spark, sf_dir):
    return _assigned(spark, sf_dir, "vec_id").select("vec_id", F.col("species")[0].alias("cid"))


def plot_species(spark, sf_dir):
    return alpha_ops.iteration_counts(_assigned(spark, sf_dir, "label"), ["label"])


def alpha_iterations(spark, sf_dir):
    counts = alpha_ops.iteration_counts(_assigned(spark, sf_dir, "label"), ["label"])
    return rounded(alpha_ops.alpha_iterations(counts, ["label"]))


def bc_iteration_mean(spark, sf_dir):
    counts = alpha_ops.iteration_counts(_assigned(spark, sf_dir, "label"), ["label"])
    sparse = beta_ops.species_shares(counts, ["label", "iter"])
    return rounded(beta_ops.mean_over_iterations(beta_ops.bray_curtis_pairs(sparse, "label", ["iter"])))


def pcoa_spectra(spark, sf_dir):
    pairs = bc_iteration_mean(spark, sf_dir)
    return rounded_arrays(ord_ops.ordinate(pairs, spectra(spark, sf_dir).select("label"), "label"))


def rounded_arrays(df):
    return df.select(*(F.transform(f.name, lambda x: F.round(x, 6)).alias(f.name) if f.dataType.simpleString() == "array<double>" else F.col(f.name) for f in df.schema))


def catalog(spark, sf_dir):
    return masks.band_catalog(spectra(spark, sf_dir), WAVELENGTHS, "x")


TARGETS = [("blue", 480.0), ("green", 560.0), ("red", 670.0), ("nir", 835.0), ("tie", 416.5)]


def nearest_bands(spark, sf_dir):
    return masks.nearest_bands(catalog(spark, sf_dir), spark.createDataFrame(TARGETS, "name string, target double"))


def excluded_domains(spark, sf_dir):
    return masks.keep_bands(catalog(spark, sf_dir))


def band_check(spark, sf_dir):
    return masks.check_bands(catalog(spark, sf_dir))


def _bands(spark, sf_dir, targets):
    rows = masks.nearest_bands(catalog(spark, sf_dir), spark.createDataFrame(list(targets.items()), "name string, target double")).collect()  # a row a target
    return {r.name: F.col("x")[r.ix] for r in rows}


def radiometric_mask(spark, sf_dir):
    b = _bands(spark, sf_dir, {"blue": 480.0, "red": 670.0, "nir": 835.0})
    given = F.when(F.col("vec_id") % 9 == 0, 0).otherwise(1)
    mask = masks.radiometric_mask(b["blue"], b["red"], b["nir"], given, ndvi_least=0.2, blue_most=0.15, nir_least=-0.1)
    return spectra(spark, sf_dir).select("vec_id", mask.alias("mask"))


def spectral_indices(spark, sf_dir):
    b = _bands(spark, sf_dir, {"red": 664.5, "nir": 835.1, "b8a": 864.8, "b11": 1613.7, "b12": 2202.4})
    # Reflectances are positive; the fixture's values are not.
    positive = {k: F.abs(v) + 0.1 for k, v in b.items()}
    given = F.when(F.col("vec_id") % 5 == 0, 0).otherwise(1)
    return rounded(transforms.spectral_indices(spectra(spark, sf_dir), list(transforms.INDICES), positive, given).select("vec_id", *transforms.INDICES))


def invariant_bands(spark, sf_dir):
    with_constant = flat(spark, sf_dir).withColumn("constant", F.lit(3.5))
    return rounded(masks.invariant_bands(with_constant, [*BANDS, "constant"]))


def continuum_removed(spark, sf_dir):
    found = transforms.continuum_removed(spectra(spark, sf_dir), WAVELENGTHS, "vec_id", "x")
    return rounded(found.select("vec_id", F.posexplode("cr").alias("i", "cr")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "cr"))


def continuum_variants(spark, sf_dir):
    """Differences to the hull, and the same spectra taken as absorbances; they are positive."""
    positive = spectra(spark, sf_dir).select("vec_id", F.transform("x", lambda v: F.abs(v) + 0.1).alias("x"))
    found = [transforms.continuum_removed(positive, WAVELENGTHS, "vec_id", "x", **{kind: True}).select("vec_id", F.posexplode("cr").alias("i", kind)) for kind in ("subtract", "absorbance")]
    return rounded(found[0].join(found[1], ["vec_id", "i"]).withColumn("i", (F.col("i") + 1).cast("bigint")))


def pca_scores(spark, sf_dir):
    px = flat(spark, sf_dir)
    return rounded(ord_ops.rotate(px, ord_ops.fit_pca(px, BANDS, keep=3), ["vec_id"]))


def spca_scores(spark, sf_dir):
    px = flat(spark, sf_dir)
    return rounded(ord_ops.rotate(px, ord_ops.fit_pca(px, BANDS, True), ["vec_id"], [1, 3]))


def _scores(px, model):
    return ord_ops.rotate(px, model, ["vec_id"]), [f"pc{k + 1}" for k in range(model.rotation.shape[1])]


def _lengths(px, standardize):
    scores, names = _scores(px, ord_ops.fit_pca(px, BANDS, standardize))
    squares = F.transform(F.array(*names), lambda v: v * v)
    return rounded(scores.select("vec_id", F.aggregate(squares, F.lit(0.0), lambda a, v: a + v).alias("length")), 5)


def pca_lengths(spark, sf_dir):
    """Squared lengths of all spectra's scores on all components: a rotation keeps distances to the mean."""
    return _lengths(flat(spark, sf_dir), False)


def spca_lengths(spark, sf_dir):
    """As ``pca_lengths``, of standardised bands."""
    return _lengths(flat(spark, sf_dir), True)


def pca_variances(spark, sf_dir):
    """Scores of components don't covary, their variances fall and are the model's, and add up to those of the bands."""
    px = flat(spark, sf_dir)
    model = ord_ops.fit_pca(px, BANDS)
    scores, names = _scores(px, model)
    _, _, covariance = ord_ops.moments(scores, names)
    found = np.diag(covariance)
    apart = bool(np.abs(covariance - np.diag(found)).max(initial=0) < 1e-9)
    return rounded(spark.createDataFrame([(float(found.sum()), apart, bool((np.diff(found) <= 1e-12).all()), bool(np.allclose(found, model.variance)))], "total double, uncorrelated boolean, falling boolean, as_fitted boolean"))


def band_covariance(spark, sf_dir):
    """Covariances of all 64 bands."""
    _, _, covariance = ord_ops.array_moments(spectra(spark, sf_dir), "x")
    rows = [(i, j, float(v)) for i, own in enumerate(covariance) for j, v in enumerate(own) if i <= j]
    return rounded(spark.createDataFrame(rows, "i int, j int, covariance double"))


def spectral_components(spark, sf_dir):
    """All bands: domains, continuum, constant bands, standardised components."""
    model = workflows.fit_components(spectra(spark, sf_dir), WAVELENGTHS, "vec_id", "x", keep=4)
    return rounded(workflows.components(spectra(spark, sf_dir), model, "vec_id", "x"))


def kmeans_fit(spark, sf_dir):
    model = species.fit_species(flat(spark, sf_dir), BANDS, "vec_id", 4, 6, starts=3)
    return rounded(model.centroids.select("iter", "cid", F.col("center")[0].alias("c0"), "cost"))


TRANSFER_LOTS, TRANSFER_CLUSTERS = 2, 6


def kmeans_transfers(spark, sf_dir):
    """Of every spectrum: would its transfer to another cluster of its lot lower the sum of squares, and is its centre the mean of its members? All bands."""
    px = flat(spark, sf_dir)
    model = species.fit_species(px, BANDS, "vec_id", TRANSFER_LOTS, TRANSFER_CLUSTERS, starts=3).kept()
    scaled = transforms.scale(px, model.bounds, BANDS).select("vec_id", F.array(*BANDS).alias("x"), species.lot("vec_id", TRANSFER_LOTS).alias("iter"))
    return species.transfer_check(scaled, model.centroids, "x", "vec_id")


def explore_k(spark, sf_dir):
    return rounded(species.explore_clusters(flat(spark, sf_dir), BANDS, "vec_id", (2, 4, 8), 3, starts=2))


def species_workflow(spark, sf_dir):
    px = flat(spark, sf_dir)
    model = species.fit_species(px, BANDS, "vec_id", 1, 6, starts=2)
    return workflows.species_map(px, model, ["vec_id"])


QUERIES = {f.__name__: f for f in (species_assign, species_assign_native, species_map, plot_species, alpha_iterations, bc_iteration_mean, pcoa_spectra, nearest_bands, excluded_domains, band_check, radiometric_mask, spectral_indices, invariant_bands, continuum_removed, continuum_variants, pca_scores, spca_scores, pca_lengths, spca_lengths, pca_variances, band_covariance, spectral_components, kmeans_fit, kmeans_transfers, explore_k, species_workflow)}

_CENTRES = ", ".join(map(str, CENTRES))
_ASSIGN = f"""{SPECTRA_SQL}, ce(iter, cid, vec) as (values {_CENTRES}),
 ct as (select iter, cid, x as center from ce join sp on vec = vec_id),
 dd as (select vec_id, label, iter, cid, list_distance(x, center) as d from sp, ct),
 asg as (select vec_id, label, iter::int as iter, first(cid order by d, cid)::int as cid from dd group by 1, 2, 3)"""
_WL = "wl as (select i::int as ix, (400 + 33 * i)::double as wl from (select unnest(range((select max(len(embedding)) from embeddings))) as i))"
_TARGETS = ", ".join(map(str, TARGETS))
_BAND = {480.0: 2, 670.0: 8, 835.0: 13, 664.5: 8, 835.1: 13, 864.8: 14, 1613.7: 37, 2202.4: 55}
_V = lambda nm: f"(abs(x[{_BAND[nm] + 1}]) + 0.1)"
_DOMAINS = " and ".join(f"not (wl > {a} and wl < {b})" for a, b in masks.EXCLUDED_DOMAINS)
_ITER = f"""a as (select label, iter, cid, count(*) as n from asg group by 1, 2, 3), t as (select *, sum(n) over (partition by label, iter) as t from a),
 s as (select label, iter, cid, n * 1.0 / sum(n) over (partition by label, iter) as p from t where n >= {alpha_ops.PCELIM}::double * t)"""

_MOMENTS = "u as (select vec_id, unnest(x) as v, generate_subscripts(x, 1) as i from sp), m as (select i, avg(v) as m, stddev_samp(v) as s from u group by i)"

ORACLE_SQL = {
    "band_covariance": f"with {SPECTRA_SQL}, u as (select vec_id, unnest(x) as v, generate_subscripts(x, 1) as i from sp) select (a.i - 1)::int as i, (b.i - 1)::int as j, round(covar_samp(a.v, b.v), 6) as covariance from u as a join u as b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2",
    "pca_lengths": f"with {SPECTRA_SQL}, {_MOMENTS} select vec_id, round(sum(power(v - m, 2)), 5) as length from u join m on u.i = m.i group by 1",
    "spca_lengths": f"with {SPECTRA_SQL}, {_MOMENTS} select vec_id, round(sum(power((v - m) / s, 2)), 5) as length from u join m on u.i = m.i group by 1",
    "pca_variances": f"with {SPECTRA_SQL}, {_MOMENTS} select round(sum(s * s), 6) as total, true as uncorrelated, true as falling, true as as_fitted from m",
    "species_assign": f"with {_ASSIGN} select vec_id, " + ", ".join(f"max(case when iter = {i} then cid end) as iter_{i}" for i in (1, 2, 3)) + " from asg group by 1",
    "species_assign_native": f"with {_ASSIGN} select vec_id, iter, cid from asg",
    "species_map": f"with {_ASSIGN} select vec_id, cid from asg where iter = 1",
    "plot_species": f"with {_ASSIGN} select label, iter, cid, count(*) as n from asg group by 1, 2, 3",
    "alpha_iterations": f"""with {_ASSIGN}, {_ITER}, m as (select label, iter, count(*) as richness, 0.0 - sum(p * ln(p)) as shannon, 1 - sum(p * p) as simpson from s group by 1, 2)
 select label, """ + ", ".join(f"round(avg({x}), 6) as {x}_mean, round(stddev_samp({x}), 6) as {x}_sd" for x in ("richness", "shannon", "simpson")) + " from m group by 1",
    "bc_iteration_mean": f"""with {_ASSIGN}, {_ITER}, l as (select distinct label, iter from s), c as (select distinct iter, cid from s),
 f as (select l.label, l.iter, c.cid, coalesce(s.p, 0) as p from l join c on l.iter = c.iter left join s on s.label = l.label and s.iter = l.iter and s.cid = c.cid),
 b as (select x.label as a, y.label as b, x.iter, sum(abs(x.p - y.p)) / sum(x.p + y.p) as bc from f as x join f as y on x.iter = y.iter and x.cid = y.cid and x.label < y.label group by 1, 2, 3)
 select a, b, round(avg(bc), 6) as bc from b group by 1, 2""",
    # Of an optimum under single transfers SQL knows the answer of every point.
    "kmeans_transfers": f"select vec_id, {TRANSFER_CLUSTERS}::bigint as clusters, false as improvable, true as centred from embeddings",
    "nearest_bands": f"with {_WL}, t(name, target) as (values {_TARGETS}) select name, first(ix order by abs(wl - target::double), ix) as ix, min(abs(wl - target::double)) as distance from wl, t group by name",
    "excluded_domains": f"with {_WL} select ix, wl from wl where {_DOMAINS}",
    "band_check": f"with {_WL} select bool_and(isfinite(wl)) as numeric, max(wl) >= 40 as nanometres, count(distinct wl) = count(*) as distinct_wl, count(*) as n_bands from wl",
    "radiometric_mask": f"""with {SPECTRA_SQL}, v as (select vec_id, x[3] as blue, x[9] as red, x[14] as nir from sp)
 select vec_id, case when vec_id % 9 = 0 or nir < -0.1 or blue > 0.15 or nir + red = 0 or (nir - red) / (nir + red) < 0.2 then 0 else 1 end as mask from v""",
    "spectral_indices": f"""with {SPECTRA_SQL}, v as (select vec_id, {_V(664.5)} as red, {_V(835.1)} as nir, {_V(864.8)} as b8a, {_V(1613.7)} as b11, {_V(2202.4)} as b12 from sp),
 i as (select vec_id, (nir - red) / (nir + red) as ndvi, b11 / (b8a + (1613.7 - 864.8) * (b12 - b8a) / (2202.4 - 864.8)) as cr_swir, 0.371 + 1.5 * (nir - red) / (nir + red + 0.5) as inner_ from v)
 select vec_id, """ + ", ".join(f"case when vec_id % 5 <> 0 then round({e}, 6) end as {n}" for n, e in (("ndvi", "ndvi"), ("cr_swir", "cr_swir"), ("lai_savi", "case when inner_ > 0 then -ln(case when inner_ > 0 then inner_ end) / 2.4 end"))) + " from i",
    # The upper hull at a band is the highest of all chords over it.
    "continuum_removed": f"""with {SPECTRA_SQL}, {_WL}, u as (select ix, wl, row_number() over (order by ix) - 1 as i from wl where {_DOMAINS}),
 k as (select vec_id, i, wl, greatest(x[ix + 1], 0) as v from sp, u), r as (select vec_id, max(v) > min(v) as good, max(i) as last from k group by 1),
 h as (select a.vec_id, m.i, max(a.v + (b.v - a.v) * (m.wl - a.wl) / (b.wl - a.wl)) as hull from k as a join k as b on a.vec_id = b.vec_id and a.i < b.i join k as m on m.vec_id = a.vec_id and m.i between a.i and b.i group by 1, 2)
 select k.vec_id, k.i, case when good and hull <> 0 then round(v / hull, 6) else 0.0::double end as cr from k join r on k.vec_id = r.vec_id join h on h.vec_id = k.vec_id and h.i = k.i where k.i between 1 and last - 1""",
    # Within lists, so that no join's order matters.
    "continuum_variants": f"""with {SPECTRA_SQL}, {_WL}, g as materialized (select list(ix order by ix) as used, list(wl order by ix) as x, count(*)::int as n from wl where {_DOMAINS}),
 k as materialized (select vec_id, n, g.x, [abs(sp.x[j + 1]) + 0.1::double for j in used] as v from sp, g), l as (select vec_id, n, x, v, [1 / y for y in v] as w, unnest(range(2, n)) as i from k),
 h as (select *, list_max(flatten([[v[a] + (v[b] - v[a]) * (x[i] - x[a]) / (x[b] - x[a]) for b in range(i, n + 1) if b > a] for a in range(1, i + 1)])) as hv,
  list_max(flatten([[w[a] + (w[b] - w[a]) * (x[i] - x[a]) / (x[b] - x[a]) for b in range(i, n + 1) if b > a] for a in range(1, i + 1)])) as hw from l)
 select vec_id, i - 1 as i, round(1 + v[i] - hv, 6) as subtract, round(hw / w[i] - 1, 6) as absorbance from h""",
    "invariant_bands": f"with {SPECTRA_SQL} " + " union all ".join([*(f"select 'b{i}' as band, round(stddev_samp(x[{i + 1}]), 6) as sd, stddev_samp(x[{i + 1}]) = 0 as invariant from sp" for i in range(N_FLAT)), "select 'constant', 0.0::double, true"]),
}
