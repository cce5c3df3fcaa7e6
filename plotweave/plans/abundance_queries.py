"""Queries over the abundance of brands by nation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plotweave.operators import alpha as alpha_ops
from plotweave.operators import beta as beta_ops
from plotweave.operators import ordination as ord_ops
from plotweave.operators import search
from plotweave.plans import workflows
from plotweave.plans.bindings import ABUNDANCE_SQL, abundance, rounded, table
from plotweave.plans.options import for_entry
from plotweave.plans.spectra_queries import rounded_arrays

METRICS = ("richness", "shannon", "simpson", "hill")
#: Shares below this are left out of the species distributions, so that some sites differ in species.
PCELIM = 0.035
#: Sites that train the ordination; their coordinates in these queries are made up.
N_TRAIN = 8


def hill_numbers(spark, sf_dir):
    return rounded(alpha_ops.hill_profile(abundance(spark, sf_dir), ["site"], (0, 1, 2, 3)))


def fisher_alpha(spark, sf_dir):
    return rounded(alpha_ops.alpha(abundance(spark, sf_dir), ["site"], ("richness", "fisher"), pcelim=0))


def alpha_abundance(spark, sf_dir):
    return rounded(workflows.abundance_diversity(abundance(spark, sf_dir), "site", for_entry("abundance", alpha_metrics=METRICS)))


def _shares(spark, sf_dir):
    return beta_ops.species_shares(abundance(spark, sf_dir), ["site"], PCELIM)


def _numbered(spark, sf_dir):
    """Brands by the number in their name."""
    return _shares(spark, sf_dir).withColumn("cid", F.regexp_extract("cid", r"(\d+)$", 1).cast("int"))


def ssd_dense(spark, sf_dir):
    listed = beta_ops.dense(_numbered(spark, sf_dir), ["site"], 25)
    return rounded(listed.select("site", F.posexplode("ssd").alias("i", "p")).select("site", (F.col("i") + 1).alias("cid"), "p"))


def bray_curtis_pairs(spark, sf_dir):
    # Rounded twice on both sides: some values are halves of the last digit.
    return rounded(rounded(beta_ops.bray_curtis_pairs(_shares(spark, sf_dir), "site"), 10))


def _training(spark, sf_dir):
    shares = _shares(spark, sf_dir)
    train = shares.filter(F.col("site") < N_TRAIN).withColumnRenamed("site", "train_id")
    coordinates = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(N_TRAIN)], "train_id int, x double, y double")
    return shares, train, coordinates


def knn_projection(spark, sf_dir):
    shares, train, coordinates = _training(spark, sf_dir)
    return rounded(beta_ops.project_shares(shares, train, coordinates, "site", ["x", "y"]))


def knn_projection_broadcast(spark, sf_dir):
    """The same by the kernel that large maps use."""
    windows = beta_ops.dense(_numbered(spark, sf_dir), ["site"], 25)
    rows = windows.filter(F.col("site") < N_TRAIN).orderBy("site").collect()  # N_TRAIN rows
    places = np.array([[r.site, r.site**2] for r in rows], float)
    found = beta_ops.project(windows, np.array([r.ssd for r in rows]), places, ["site"])
    return rounded(found.select("site", F.col("coord")[0].alias("x"), F.col("coord")[1].alias("y")))


def pcoa(spark, sf_dir):
    return rounded_arrays(ord_ops.ordinate(bray_curtis_pairs(spark, sf_dir), abundance(spark, sf_dir), "site"))


def _observed(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.avg("s_acctbal").alias("observed"))


def corr_observed(spark, sf_dir):
    both = alpha_abundance(spark, sf_dir).join(_observed(spark, sf_dir), "site")
    return rounded(search.correlation(both, "shannon", "observed"))


def spearman_observed(spark, sf_dir):
    both = alpha_abundance(spark, sf_dir).join(_observed(spark, sf_dir), "site")
    return rounded(search.correlation(both, "simpson", "observed", "spearman"))


def mantel_stat(spark, sf_dir):
    values = _observed(spark, sf_dir)
    left, right = (values.select(F.col("site").alias(x), F.col("observed").alias(f"o{x}")) for x in "ab")
    gaps = left.join(right, F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("oa") - F.col("ob")).alias("bc"))
    return rounded(search.mantel(beta_ops.bray_curtis_pairs(_shares(spark, sf_dir), "site"), gaps))


def sdm_workflow(spark, sf_dir):
    _, train, coordinates = _training(spark, sf_dir)
    raw = beta_ops.species_shares(abundance(spark, sf_dir), ["site"], 0.0)
    train = raw.filter(F.col("site") < N_TRAIN).withColumnRenamed("site", "train_id")
    return rounded(workflows.abundance_diversity(abundance(spark, sf_dir), "site", for_entry("abundance", alpha_metrics=METRICS), train, coordinates, ["x", "y"]))


QUERIES = {f.__name__: f for f in (hill_numbers, fisher_alpha, alpha_abundance, ssd_dense, bray_curtis_pairs, knn_projection, knn_projection_broadcast, pcoa, corr_observed, spearman_observed, mantel_stat, sdm_workflow)}

_SHARES = lambda pcelim: f"""t as (select *, sum(n) over (partition by site) as t from ab),
 s as (select site, cid, n * 1.0 / sum(n) over (partition by site) as p from t where n >= {pcelim}::double * t)"""  # noqa: E731
_DENSE = """l as (select distinct site from s), u as (select distinct cid from s),
 f as (select l.site, u.cid, coalesce(s.p, 0) as p from l cross join u left join s on s.site = l.site and s.cid = u.cid)"""
_PAIRS = "bp as (select x.site as a, y.site as b, sum(abs(x.p - y.p)) / sum(x.p + y.p) as bc from f as x join f as y on x.cid = y.cid and x.site < y.site group by 1, 2)"
_KNN = f"""bt as (select x.site, y.site as train_id, round(sum(abs(x.p - y.p)) / sum(x.p + y.p), 12) as bc from f as x join f as y on x.cid = y.cid where y.site < {N_TRAIN} group by 1, 2),
 nn as (select *, row_number() over (partition by site order by bc, train_id) as i from bt),
 pl as (select site, case when min(bc) = 0 then first(train_id order by bc, train_id) else sum(train_id / nullif(bc, 0)) / sum(1 / nullif(bc, 0)) end as x,
  case when min(bc) = 0 then first(train_id * train_id order by bc, train_id) else sum(train_id * train_id / nullif(bc, 0)) / sum(1 / nullif(bc, 0)) end as y from nn where i <= 3 group by 1)"""
_ALPHA = """al as (select site, count(*) as richness, round(0.0 - sum(p * ln(p)), 6) as shannon, round(1 - sum(p * p), 6) as simpson, round(exp(0.0 - sum(p * ln(p))), 6) as hill, count(*) as layers from s group by 1)"""
_OBSERVED = "ob as (select s_nationkey as site, avg(s_acctbal) as observed from supplier group by 1)"

ORACLE_SQL = {
    "hill_numbers": f"with {ABUNDANCE_SQL}, {_SHARES(0)} select site, count(*)::double as hill_0, round(exp(0.0 - sum(p * ln(p))), 6) as hill_1, round(1 / sum(p * p), 6) as hill_2, round(power(sum(power(p, 3)), -0.5), 6) as hill_3 from s group by 1",
    # Bisection on the logarithm of alpha.
    "fisher_alpha": f"""with recursive {ABUNDANCE_SQL}, g as (select site, count(*) as s, sum(n) as n from ab group by 1),
 b(site, s, n, lo, hi, i) as (select site, s, n, -20.0::double, 40.0::double, 0 from g union all
  select site, s, n, case when v < s then m else lo end, case when v < s then hi else m end, i + 1 from (select *, (lo + hi) / 2 as m, exp((lo + hi) / 2) * ln(1 + n / exp((lo + hi) / 2)) as v from b) as t where i < 90)
 select site, s as richness, case when s > 1 and n > s then round(exp((lo + hi) / 2), 6) end as fisher from b where i = 90""",
    "alpha_abundance": f"with {ABUNDANCE_SQL}, {_SHARES(0)}, {_ALPHA} select * from al",
    "ssd_dense": f"with {ABUNDANCE_SQL}, {_SHARES(PCELIM)}, i as (select i::int as cid from range(1, 26) as t(i)), l as (select distinct site from s) select l.site, i.cid, round(coalesce(s.p, 0), 6) as p from l cross join i left join s on s.site = l.site and regexp_extract(s.cid, '\\d+$')::int = i.cid",
    "bray_curtis_pairs": f"with {ABUNDANCE_SQL}, {_SHARES(PCELIM)}, {_DENSE}, {_PAIRS} select a, b, round(round(bc, 10), 6) as bc from bp",
    "knn_projection": f"with {ABUNDANCE_SQL}, {_SHARES(PCELIM)}, {_DENSE}, {_KNN} select site, round(x, 6) as x, round(y, 6) as y from pl",
    "knn_projection_broadcast": f"with {ABUNDANCE_SQL}, {_SHARES(PCELIM)}, {_DENSE}, {_KNN} select site, round(x, 6) as x, round(y, 6) as y from pl",
    "corr_observed": f"with {ABUNDANCE_SQL}, {_SHARES(0)}, {_ALPHA}, {_OBSERVED} select count(*) as n, round(corr(shannon, observed), 6) as r from al join ob using (site)",
    "spearman_observed": f"""with {ABUNDANCE_SQL}, {_SHARES(0)}, {_ALPHA}, {_OBSERVED}, b as (select simpson as x, observed as y from al join ob using (site)),
 k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as y from b)
 select count(*) as n, round(corr(x, y), 6) as r from k""",
    "mantel_stat": f"with {ABUNDANCE_SQL}, {_SHARES(PCELIM)}, {_DENSE}, {_PAIRS}, {_OBSERVED} select count(*) as n, round(corr(bc, abs(oa.observed - ob2.observed)), 6) as r from bp join ob as oa on oa.site = a join ob as ob2 on ob2.site = b",
    "sdm_workflow": f"with {ABUNDANCE_SQL}, {_SHARES(0)}, {_ALPHA}, {_DENSE}, {_KNN} select al.*, round(x, 6) as x, round(y, 6) as y from al join pl using (site)",
}
