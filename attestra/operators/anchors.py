"""Agreement of sources with an outside reference set, and resampling intervals over roots.

Claims that go back to an anchor's own root cannot confirm it.  Intervals resample roots, the
unit that is independent, never rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws, labels, stats
from ..functions.text import ratio
from ..registry import Registry
from ..session import written
from .roots import dominant_root
from .subjects import subject_table


def decisions(claims: DataFrame, truth: DataFrame, reg: Registry) -> DataFrame:
    """One row per (anchor, source) that says anything independent of the anchor: its modal known
    label (ties by name), the root behind it, and the outcome against the anchor's label."""
    anchors = truth.select("address", labels.canonical_category(reg, F.col("label")).alias("anchor_canon"),
                           F.col("root").alias("anchor_root"))
    # claims are reduced before the join, so a busy address brings few rows
    said = claims.groupBy("address", "source", "root", "root_known", "canon").agg(F.count("*").alias("n"))
    met = said.join(anchors, "address").where(F.col("root") != F.col("anchor_root"))
    known = F.col("canon") != reg.unknown
    per_label = met.groupBy("address", "anchor_canon", "source", "canon").agg(
        F.sum("n").alias("n"), F.min(F.struct("root", "root_known")).alias("least"))
    best = per_label.groupBy("address", "anchor_canon", "source").agg(
        F.min_by(F.struct("canon", "least"), F.when(known, F.struct(-F.col("n"), F.col("canon")))).alias("b"))
    codes = labels.CategoryCodes(reg)
    # two opinions, the anchor's and the source's, merged by the same codes as everywhere else
    rows = best.select("address", "anchor_canon", "source", F.col("b.canon").alias("label"), F.col("b.least.root").alias("root"),
                       F.col("b.least.root_known").alias("root_known"))
    same, c, a = F.col("label") == F.col("anchor_canon"), F.col("label"), F.col("anchor_canon")
    pol_c, pol_a = labels.polarity_of(reg, c), labels.polarity_of(reg, a)
    opposed = (pol_c != pol_a) & (pol_c != "unknown") & (pol_a != "unknown")
    kin = F.lit(False)
    for name in codes.names:
        above = [x for x in reg.lineage(name) if x != name]
        if above:
            kin = kin | ((c == name) & a.isin(above)) | ((a == name) & c.isin(above))
    outcome = (F.when(c.isNull() | (c == reg.unknown), "incomparable").when(a == reg.unknown, "incomparable").when(same, "exact")
               .when(opposed, "licit/illicit conflict").when(c.isin(reg.generic) | a.isin(reg.generic) | kin, "hierarchical refinement")
               .otherwise("entity-type conflict"))
    return rows.withColumn("outcome", F.when(a.isNotNull(), outcome))


def validation(claims: DataFrame, truth: DataFrame, reg: Registry) -> DataFrame:
    """Per source: decisions, agreement, independent roots behind them, Wilson interval."""
    d = decisions(claims, truth, reg).where(F.col("anchor_canon").isNotNull())
    evaluated = F.col("label").isNotNull() & (F.col("label") != reg.unknown)
    o = F.col("outcome")
    per_root = d.groupBy("source", "root", "root_known").agg(
        F.count_if(evaluated).alias("n"), F.count_if(evaluated & (o == "exact")).alias("exact"),
        F.count_if(evaluated & (o == "hierarchical refinement")).alias("hierarchical"),
        F.count_if(evaluated & o.isin("entity-type conflict", "licit/illicit conflict")).alias("conflicting"),
        F.count_if(o == "incomparable").alias("incomparable"))
    some = F.col("n") > 0
    out = per_root.groupBy("source").agg(
        *[F.sum(c).alias(c) for c in ("n", "exact", "hierarchical", "conflicting", "incomparable")],
        F.count_if(some & F.col("root_known")).alias("independent_roots"), F.max("n").alias("largest"))
    lo, hi = stats.wilson(F.col("exact"), F.col("n"), float(reg.analysis["bootstrap"]["confidence"]))
    judged = F.col("n") > 0
    return out.select(
        "source", "n", "exact", "hierarchical", "conflicting", "incomparable", ratio(F.col("exact"), F.col("n")).alias("agreement"),
        "independent_roots", ratio(F.col("largest"), F.col("n")).alias("largest_root_share"),
        F.when(judged, lo).alias("wilson_low"), F.when(judged, hi).alias("wilson_high"),
        (judged & (F.col("independent_roots") >= reg.analysis["anchor_min_roots"])).alias("estimable"))


def anchor_summary(claims: DataFrame, truth: DataFrame, reg: Registry) -> DataFrame:
    """Anchors, those an independent claim reaches, and claims excluded as the anchor's own root."""
    said = claims.groupBy("address", "root", "root_known").agg(F.count("*").alias("n"))
    anchors = truth.select("address", labels.canonical_category(reg, F.col("label")).alias("canon"), F.col("root").alias("anchor_root"))
    own = F.col("root") == F.col("anchor_root")
    per = (anchors.join(said, "address", "left").groupBy("address", "canon", "anchor_root").agg(
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("self_claims"),
        F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("independent_claims")))
    usable = F.col("independent_claims") > 0
    return (per.agg(F.count("*").alias("anchors"), F.count_if(usable).alias("usable"), F.sum("self_claims").alias("excluded_self_root_claims"),
                    F.count_if(usable & F.col("canon").isNull()).alias("uninterpretable"))
            .withColumn("coverage", ratio(F.col("usable"), F.col("anchors"))))


def independent_root_histogram(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Usable anchors by the number of distinct known roots that speak about them independently."""
    said = claims.select("address", "root", "root_known").distinct()
    met = said.join(truth.select("address", F.col("root").alias("anchor_root")), "address").where("root <> anchor_root")
    return (met.groupBy("address").agg(F.count_if("root_known").alias("n_roots"))
            .groupBy("n_roots").agg(F.count("*").alias("n_anchors")))


# ------------------------------------------------------------------ resampling
def cluster_counts(claims: DataFrame, reg: Registry, upper: bool = False) -> DataFrame:
    """One row per cluster: subjects, subjects with several sources, and three outcomes among those.
    ``upper`` makes every subject of unresolved root a cluster of its own instead of pooling them."""
    subjects = subject_table(claims, reg).select("subject", "n_sources", "outcome")
    rows = subjects.join(dominant_root(claims), "subject")        # one row per subject on both sides
    own = F.when(~F.col("root_known"), F.col("subject")) if upper else F.lit(None).cast("string")
    multi = F.col("n_sources") >= 2
    return rows.groupBy(F.when(own.isNull(), F.col("root")).alias("root"), own.alias("alone")).agg(
        F.count("*").alias("subjects"), F.count_if(multi).alias("multi"),
        *[F.count_if(multi & (F.col("outcome") == o)).alias(n) for n, o in
          (("exact", "exact"), ("refined", "hierarchical refinement"), ("opposed", "licit/illicit conflict"))])


#: statistic -> (numerator, denominator) of the cluster counts
RATES = {"multi_source_rate": ("multi", "subjects"), "exact": ("exact", "multi"),
         "hierarchical refinement": ("refined", "multi"), "licit/illicit conflict": ("opposed", "multi")}


def resampled(clusters: DataFrame, by: list[str], values: list[str], replicates: int, seed: int, depth: int = 2) -> DataFrame:
    """(by, rep, sums of the values) when as many clusters as there are get drawn with replacement, ``replicates`` times for each group of ``by``.

    Clusters with equal values are interchangeable, so they are counted into classes; drawing gives each class a multinomial count.  Classes hang in a tree by the
    digits of a hash of their values: the draws of a group are dealt to its 16 children, theirs to their own, and after ``depth`` levels to
    the classes.  So no task holds all classes, and each draw depends on its name alone."""
    spark = clusters.sparkSession
    stream = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)) if by else F.lit("")
    classes = clusters.groupBy(*by, *values).agg(F.count("*").cast("double").alias("m")).withColumn("stream", stream)
    classes = written(classes.withColumn("id", F.md5(F.concat_ws(",", *(F.col(v).cast("string") for v in values)).cast("binary"))))      # read once a level
    rows = (classes.groupBy("stream", *by).agg(F.sum("m").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("node", F.lit(""))
            .repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "stream", "rep"))      # little data, much work
    key = F.concat_ws(":", F.lit(str(seed)), "stream", "rep")
    for level in range(depth + 1):
        node, leaf = F.substring("id", 1, level), level == depth
        found = classes if leaf else classes.groupBy("stream", F.substring("id", 1, level + 1).alias("id")).agg(F.sum("m").alias("m"))
        kept = ["id", "m", *(values if leaf else [])]
        children = found.groupBy("stream", node.alias("node")).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("children"))
        dealt = rows.join(children, ["stream", "node"]).withColumn("counts", draws.multinomial(F.col("n"), F.col("children"), key))
        dealt = dealt.select("stream", *by, "rep", F.explode(F.arrays_zip("children", "counts")).alias("c")).where("c.counts > 0")
        rows = dealt.select("stream", *by, "rep", F.col("c.children.id").alias("node"), F.col("c.counts").alias("n"), *(F.col(f"c.children.{v}").alias(v) for v in values if leaf))
    return rows.groupBy(*by, "rep").agg(*(F.sum(F.col("n") * F.col(v)).alias(v) for v in values))


def _intervals(points: DataFrame, drawn: DataFrame, by: list[str], confidence: float) -> DataFrame:
    """Percentile intervals of num / den over the replicates whose denominator is not empty."""
    ranked = drawn.where("den > 0").groupBy(*by).agg(F.array_sort(F.collect_list(F.col("num") / F.col("den"))).alias("v"))       # one ratio per replicate
    tail = (1 - confidence) / 2
    met = points.join(ranked, by, "left") if by else points.join(ranked)
    return met.select(*by, "n_clusters", "point", stats.index_percentile(F.col("v"), tail).alias("ci_low"), stats.index_percentile(F.col("v"), 1 - tail).alias("ci_high"))


def bootstrap_ratio(clusters: DataFrame, by: list[str], num: str, den: str, replicates: int, seed: int, confidence: float) -> DataFrame:
    """Percentile interval of sum(num)/sum(den) from resampling clusters, for each group of ``by``."""
    named = clusters.select(*by, F.col(num).alias("num"), F.col(den).alias("den"))
    points = named.groupBy(*by).agg(ratio(F.sum("num"), F.sum("den")).alias("point"), F.count("*").alias("n_clusters"))
    return _intervals(points, resampled(named, by, ["num", "den"], replicates, seed), by, confidence)


def bootstrap(claims: DataFrame, reg: Registry, upper: bool = False, replicates: int | None = None) -> DataFrame:
    """Intervals of the corpus rates, resampling roots; one set of draws serves all rates."""
    cfg = reg.analysis["bootstrap"]
    counts = ["subjects", "multi", "exact", "refined", "opposed"]
    clusters = written(cluster_counts(claims, reg, upper).select(*counts))
    rates = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(n).alias("num"), F.col(d).alias("den")) for s, (n, d) in RATES.items()])).alias("r")
    points = clusters.agg(*(F.sum(c).alias(c) for c in counts), F.count("*").alias("n_clusters")).select("n_clusters", rates).select("n_clusters", "r.*")
    points = points.select("statistic", "n_clusters", ratio(F.col("num"), F.col("den")).alias("point"))
    drawn = resampled(clusters, [], counts, replicates or cfg["replicates"], cfg["seed"]).select(rates).select("r.*")
    return _intervals(points, drawn, ["statistic"], cfg["confidence"])


def anchor_intervals(claims: DataFrame, truth: DataFrame, reg: Registry, replicates: int | None = None) -> DataFrame:
    """Root-cluster interval of each source's agreement with the anchors, where two roots or more allow one."""
    cfg = reg.analysis["bootstrap"]
    d = decisions(claims, truth, reg).where(F.col("anchor_canon").isNotNull() & F.col("label").isNotNull()
                                            & (F.col("label") != reg.unknown))
    per_root = d.groupBy("source", "root", "root_known").agg(F.count("*").alias("den"), F.count_if(F.col("outcome") == "exact").alias("num"))
    ok = per_root.groupBy("source").agg(F.count_if("root_known").alias("r")).where(F.col("r") >= reg.analysis["anchor_min_roots"]).select("source")
    return bootstrap_ratio(per_root.join(ok, "source", "left_semi"), ["source"], "num", "den",
                           replicates or cfg["replicates"], cfg["seed"], cfg["confidence"])
