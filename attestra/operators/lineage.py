"""The lineage graph the source rules declare, annotated with what was measured."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry


def edges(spark: SparkSession, reg: Registry) -> DataFrame:
    """dataset -> root as declared, inferred or unknown; as many rows as the rules name."""
    rows = []
    for s, r in sorted(reg.sources.items()):
        for root, flags, kind in r.declared_roots():
            label = root.split("{", 1)[0] + "*" if "{" in root else root
            rows.append((s, label, kind, flags.resolved, reg.owner_of(label)))
    return spark.createDataFrame(rows, "dataset string, root string, kind string, resolved boolean, owner string").distinct()


def nodes(edge_rows: DataFrame) -> DataFrame:
    """Datasets and roots; a root several datasets point at is where corroboration can collapse."""
    datasets = edge_rows.select(F.lit("dataset").alias("type"), F.col("dataset").alias("label")).distinct().select(
        "type", "label", F.lit(None).cast("string").alias("owner"), F.lit(0).cast("bigint").alias("n_datasets"), F.lit(False).alias("shared"))
    roots = (edge_rows.groupBy("root").agg(F.count_distinct("dataset").alias("n_datasets"), F.max("owner").alias("owner"),
                                           F.bool_or("resolved").alias("resolved"))
             .select(F.when(F.col("resolved"), "root").otherwise("root_unresolved").alias("type"), F.col("root").alias("label"),
                     "owner", "n_datasets", (F.col("n_datasets") > 1).alias("shared")))
    return datasets.unionByName(roots)


def measured_nodes(node_rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Nodes with the claims and subjects found under each: a dataset's own, and those of a root or, where its name ends in a star, of the roots that begin so."""
    said = claims.groupBy("source", "root", "subject").agg(F.count("*").alias("n"))                 # a subject counts once for each node below
    star = F.col("label").endswith("*")
    fits = F.when(F.col("type") == "dataset", F.col("source") == F.col("label")).when(star, F.col("root").startswith(F.expr("substring(label, 1, length(label) - 1)"))).otherwise(F.col("root") == F.col("label"))
    under = said.join(F.broadcast(node_rows.select("type", "label")), fits)                         # as many nodes as the rules name
    found = under.groupBy("type", "label", "subject").agg(F.sum("n").alias("n")).groupBy("type", "label").agg(F.sum("n").alias("n_claims"), F.count("*").alias("n_subjects"))
    return node_rows.join(found, ["type", "label"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_claims", "n_subjects")})


def annotated(edge_rows: DataFrame, decode_rows: DataFrame, residue: DataFrame, contained: DataFrame, propagated: DataFrame) -> DataFrame:
    """Edges with the evidence measured for each: decoded codes, names left in labels, containment in
    the root's owner, and how much of the root's own list reappears.  All sides are small results."""
    shared = edge_rows.groupBy("root").agg((F.count_distinct("dataset") > 1).alias("shared_root"))
    decoded = decode_rows.groupBy("dataset", F.col("candidate").alias("owner")).agg(
        F.sum(F.when(F.col("verdict") == "inherited", F.col("n")).otherwise(0)).alias("decoded_subjects"))
    left = residue.where("root <> 'unmarked'").select("dataset", "root", F.col("n_claims").alias("residue_claims"))
    inside = contained.select(F.col("source").alias("dataset"), F.col("inside").alias("owner"), F.col("share_of_a").alias("contained_share"))
    spread = propagated.select(F.col("source").alias("dataset"), "root", F.col("n_found").alias("propagated_subjects"))
    return (edge_rows.join(shared, "root").join(decoded, ["dataset", "owner"], "left").join(left, ["dataset", "root"], "left")
            .join(inside, ["dataset", "owner"], "left").join(spread, ["dataset", "root"], "left"))
