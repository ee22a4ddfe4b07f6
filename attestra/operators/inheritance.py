"""Does one source repeat another?  Coded fields, names left in labels, spread of an address list."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..registry import Registry

VERDICTS = ["inherited", "independent", "mixed", "insufficient", "malformed"]


def code_of(field: Column) -> Column:
    """The code in a provenance field: after the first colon, or the whole text without one."""
    text = F.coalesce(field, F.lit(""))
    at = F.instr(text, ":")
    return F.when(at > 0, F.substring(text, at + F.lit(1), F.length(text))).otherwise(text)


def coded_subjects(claims: DataFrame, dataset: str, field: str, candidate: str) -> DataFrame:
    """(code, subject, inside): each subject of a code once, and whether the candidate names it too.
    Both sides are reduced to distinct subjects before they meet."""
    coded = (claims.where(F.col("source") == dataset).select(code_of(F.col(field)).alias("code"), "subject").distinct())
    there = claims.where(F.col("source") == candidate).select("subject", F.lit(True).alias("inside")).distinct()
    return coded.join(there, "subject", "left").select("code", "subject", F.coalesce("inside", F.lit(False)).alias("inside"))


def _verdict(reg: Registry) -> Column:
    cut = reg.analysis["decode"]
    share = F.col("share_in_candidate")
    return (F.when(~F.col("code").rlike(r"\A\p{L}+\z"), "malformed").when(F.col("n") < cut["min_group"], "insufficient")
            .when(share > F.lit(cut["inherited_above"]), "inherited")
            .when(share < F.lit(cut["independent_below"]), "independent").otherwise("mixed"))


def decode_groups(claims: DataFrame, reg: Registry, dataset: str, field: str, candidate: str) -> DataFrame:
    """Each code of an undocumented field: size, overlap with the candidate, verdict."""
    groups = coded_subjects(claims, dataset, field, candidate).groupBy("code").agg(
        F.count("*").alias("n"), F.count_if("inside").alias("overlap"))
    return (groups.withColumn("share_in_candidate", F.col("overlap") / F.col("n"))
            .withColumn("verdict", _verdict(reg)))


def decode_examples(claims: DataFrame, dataset: str, field: str, candidate: str, k: int = 5) -> DataFrame:
    """The first subjects of each code in text order, from inside the candidate when any are.
    A rank filter, so each mapper keeps k rows per code before anything is shuffled."""
    pairs = coded_subjects(claims, dataset, field, candidate)
    order = Window.partitionBy("code").orderBy(F.desc("inside"), "subject")
    first = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    best = first.groupBy("code").agg(F.bool_or("inside").alias("any_inside"),
                                     F.array_sort(F.collect_list(F.when(F.col("inside"), F.col("subject")))).alias("within"),
                                     F.array_sort(F.collect_list("subject")).alias("all"))
    return best.select("code", F.when(F.col("any_inside"), F.col("within")).otherwise(F.col("all")).alias("examples"))


def decode_summary(groups: DataFrame, reg: Registry) -> DataFrame:
    """Is the split clean, and how many subjects are inherited?  Groups too small or malformed to
    judge still count when they sit inside the candidate."""
    v = F.col("verdict")
    inside = F.col("share_in_candidate") > F.lit(reg.analysis["decode"]["inherited_above"])
    carried = (v == "inherited") | (v.isin("insufficient", "malformed") & inside)
    one = groups.agg(F.count_if(v == "inherited").alias("inherited_groups"), F.count_if(v == "independent").alias("independent_groups"),
                     F.count_if(v == "mixed").alias("mixed_groups"),
                     F.count_if(v.isin("mixed", "malformed", "insufficient")).alias("inconclusive_groups"),
                     F.coalesce(F.sum(F.when(carried, F.col("n"))), F.lit(0)).alias("inherited_subjects"))
    return one.withColumn("clean_split", (F.col("inherited_groups") > 0) & (F.col("independent_groups") > 0)
                          & (F.col("mixed_groups") == 0))


def decoded_letters(groups: DataFrame) -> DataFrame:
    """Letters every inherited code has and no independent code has."""
    judged = groups.where(F.col("verdict").isin("inherited", "independent"))
    n_inherited = judged.agg(F.count_if(F.col("verdict") == "inherited").alias("n_inherited"))
    letters = (judged.select("code", "verdict", F.explode(F.array_distinct(F.split("code", ""))).alias("letter")).where("letter <> ''")
               .groupBy("letter").agg(F.count_if(F.col("verdict") == "inherited").alias("in_inherited"),
                                      F.count_if(F.col("verdict") == "independent").alias("in_independent")))
    return (letters.join(F.broadcast(n_inherited))           # one row
            .where((F.col("in_inherited") == F.col("n_inherited")) & (F.col("n_inherited") > 0) & (F.col("in_independent") == 0))
            .select("letter"))


def decode_totals(groups: DataFrame, reg: Registry) -> DataFrame:
    """Subjects of the well-formed codes inside the candidate, and of everything else."""
    inside = ((F.col("verdict") != "malformed")
              & (F.col("share_in_candidate") > F.lit(reg.analysis["decode"]["inherited_above"])))
    zero = F.lit(0).cast("bigint")
    return groups.agg(F.coalesce(F.sum(F.when(inside, F.col("overlap"))), zero).alias("inside_subjects"),
                      F.coalesce(F.sum(F.when(~inside, F.col("n"))), zero).alias("outside_subjects"),
                      F.coalesce(F.sum(F.when(~inside, F.col("overlap"))), zero).alias("outside_overlap"))


def largest_groups(groups: DataFrame, reg: Registry) -> DataFrame:
    return groups.orderBy(F.desc("n"), "code").limit(reg.analysis["decode"]["groups_shown"])


def decodes(claims: DataFrame, reg: Registry) -> DataFrame:
    """Every coded field the source rules point at, decoded."""
    parts = [decode_groups(claims, reg, **d).withColumns({k: F.lit(v) for k, v in d.items()}) for d in reg.decode_checks()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("dataset", "field", "candidate", "code", "n", "overlap", "share_in_candidate", "verdict")


def naming_residue(claims: DataFrame, reg: Registry) -> DataFrame:
    """Claims whose own label text starts with the name of an upstream study."""
    out = None
    for check in reg.residue_checks():
        text = F.lower(F.coalesce(F.col(check["field"]), F.lit("")))
        hit = F.lit("unmarked")
        for prefix, root in reversed(check["prefixes"]):
            hit = F.when(text.startswith(prefix), root).otherwise(hit)
        part = (claims.where(F.col("source") == check["dataset"]).groupBy(hit.alias("root")).agg(F.count("*").alias("n_claims"))
                .select(F.lit(check["dataset"]).alias("dataset"), F.lit(check["field"]).alias("field"), "root", "n_claims"))
        out = part if out is None else out.unionByName(part)
    return out


def residue_summary(residue: DataFrame) -> DataFrame:
    marked = F.sum(F.when(F.col("root") != "unmarked", F.col("n_claims")).otherwise(0))
    return (residue.groupBy("dataset", "field").agg(F.sum("n_claims").alias("total"), marked.alias("attributed"))
            .withColumn("share", ratio(F.col("attributed"), F.col("total"))))


def root_propagation(claims: DataFrame, reg: Registry) -> DataFrame:
    """How far each seed address list reappears in the other sources; sources without any are kept."""
    out = None
    named = claims.select("source", "subject").distinct()
    sources = named.select("source").distinct()
    for seed in reg.seeds:
        mine = (claims.where((F.col("source") == seed["source"]) & (F.col(seed["field"]) == seed["value"]))
                .select("subject").distinct())
        size = mine.agg(F.count("*").alias("seed_size"))
        found = (named.where(F.col("source") != seed["source"]).join(mine, "subject", "left_semi")
                 .groupBy("source").agg(F.count("*").alias("n_found")))
        part = (sources.where(F.col("source") != seed["source"]).join(found, "source", "left").join(F.broadcast(size))   # one row
                .select(F.lit(seed["root"]).alias("root"), "source", "seed_size",
                        F.coalesce("n_found", F.lit(0)).alias("n_found"),
                        ratio(F.coalesce("n_found", F.lit(0)), F.col("seed_size")).alias("share")))
        out = part if out is None else out.unionByName(part)
    return out
