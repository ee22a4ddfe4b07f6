"""Free-text label -> category of the tree, and the codes the aggregations work on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from .text import cell, lookup, strip

#: categories per 64-bit word of a category set (the sign bit stays free)
WORD = 62


def _alias(reg: Registry, text: Column) -> Column:
    return lookup(reg.aliases, F.lower(strip(text)))


def structured_category(reg: Registry, raw: Column) -> Column:
    """Category named by the part before the first separator, when the whole text is no alias."""
    text, out = cell(raw), F.lit(None).cast("string")
    for sep in reversed(reg.separators):
        out = F.when(F.instr(text, sep) > 0, _alias(reg, F.substring_index(text, sep, 1))).otherwise(out)
    return F.when(_alias(reg, text).isNull(), out)


def structured_entity(reg: Registry, raw: Column) -> Column:
    """The part after the separator of a structured label, NULL when it is not one."""
    text, out = cell(raw), F.lit(None).cast("string")
    for sep in reversed(reg.separators):
        at = F.instr(text, sep)
        out = F.when(at > 0, strip(F.substring(text, at + F.lit(len(sep)), F.length(text)))).otherwise(out)
    return F.when(structured_category(reg, raw).isNotNull(), out)


def canonical_category(reg: Registry, raw: Column) -> Column:
    """The category a label names, NULL (never a guess) when it names none."""
    return F.coalesce(_alias(reg, cell(raw)), structured_category(reg, raw))


def with_category(df: DataFrame, reg: Registry, columns: list[str]) -> DataFrame:
    """Read several label columns (trimmed cells) at once, the first that names a category deciding.

    Adds ``canon`` and ``structured_entity``.  Same rules as ``canonical_category``; every lookup is
    made once, in a step of its own, so later expressions stay small."""
    lower = {f"_low{i}": F.lower(F.col(c)) for i, c in enumerate(columns)}
    df = df.withColumns(lower)
    cuts, steps = {}, {}
    for i, c in enumerate(columns):
        at, width = F.lit(0), F.lit(0)
        for sep in reversed(reg.separators):
            here = F.instr(F.col(c), sep)
            at, width = F.when(here > 0, here).otherwise(at), F.when(here > 0, len(sep)).otherwise(width)
        cuts[f"_at{i}"], cuts[f"_width{i}"] = at, width
        steps[f"_whole{i}"] = lookup(reg.aliases, F.col(f"_low{i}"))
    df = df.withColumns({**cuts, **steps})
    df = df.withColumns({f"_part{i}": F.when(F.col(f"_whole{i}").isNull() & (F.col(f"_at{i}") > 0), lookup(
        reg.aliases, strip(F.substring(F.col(f"_low{i}"), F.lit(1), F.col(f"_at{i}") - F.lit(1))))) for i in range(len(columns))})
    canon = F.coalesce(*[F.coalesce(F.col(f"_whole{i}"), F.col(f"_part{i}")) for i in range(len(columns))], F.lit(reg.unknown))
    entity, before = None, F.lit(True)
    for i, c in enumerate(columns):
        rest = strip(F.substring(F.col(c), F.col(f"_at{i}") + F.col(f"_width{i}"), F.length(F.col(c))))
        test = before & F.col(f"_whole{i}").isNull() & F.col(f"_part{i}").isNotNull()
        entity = F.when(test, rest) if entity is None else entity.when(test, rest)
        before = before & F.col(f"_whole{i}").isNull() & F.col(f"_part{i}").isNull()
    df = df.withColumns({"canon": canon, "structured_entity": entity})
    return df.drop(*[f"_{n}{i}" for n in ("low", "at", "width", "whole", "part") for i in range(len(columns))])


def polarity_of(reg: Registry, canon: Column) -> Column:
    return F.coalesce(lookup({c.name: c.polarity for c in reg.categories.values()}, canon), F.lit("unknown"))


class CategoryCodes:
    """Categories as bits, so a set of categories is an integer that BIT_OR can build.

    Two facts replace any per-group list of names.  The categories of a set lie on one
    branch exactly when the union of their lineages is as large as the longest lineage;
    and a set has as many members as bits.  Both need only BIT_OR and MAX, which stay in
    hash aggregation whatever the group size.
    """

    def __init__(self, reg: Registry):
        self.reg = reg
        self.names = [c for c in reg.categories if c != reg.unknown]
        self.words = -(-len(self.names) // WORD)
        self._pos = {n: i for i, n in enumerate(self.names)}

    def _mask(self, names: list[str], word: int) -> int:
        return sum(1 << (self._pos[n] % WORD) for n in names if n in self._pos and self._pos[n] // WORD == word)

    def with_codes(self, df: DataFrame, canon: str = "canon") -> DataFrame:
        """Add the codes of each claim's category (the columns of ``aggregates``).

        The category's position is looked up once; every code is then an array access, which
        keeps the generated code small enough for the JIT compiler.
        """
        reg, generic = self.reg, set(self.reg.generic)
        table = F.create_map(*[F.lit(x) for i, n in enumerate(self.names) for x in (n, i + 3)], F.lit(reg.unknown), F.lit(1))
        df = df.withColumn("_at", F.coalesce(F.try_element_at(table, F.col(canon)), F.lit(2)))   # 1 unknown, 2 off the tree

        def pick(values: list[int], sql_type: str) -> Column:
            return F.element_at(F.array(*[F.lit(v).cast(sql_type) for v in [0, 0] + values]), F.col("_at"))

        pol = {"licit": 1, "illicit": 2}
        cols = {"known": (F.col("_at") != 1).cast("int"),
                "depth": pick([0 if n in generic else len(reg.lineage(n)) for n in self.names], "int"),
                "poles": pick([pol.get(reg.categories[n].polarity, 0) for n in self.names], "int")}
        for w in range(self.words):
            cols[f"cats{w}"] = pick([self._mask([n], w) for n in self.names], "bigint")
            cols[f"line{w}"] = pick([0 if n in generic else self._mask(reg.lineage(n), w) for n in self.names], "bigint")
        # a category outside the tree: only "none, one or several" matters, which a min and a max tell
        cols["off_lo"] = F.when(F.col("_at") == 2, F.xxhash64(F.col(canon)))
        cols["off_hi"] = F.when(F.col("_at") == 2, F.xxhash64(F.col(canon)))
        return df.withColumns(cols).drop("_at")

    @property
    def aggregates(self) -> dict[str, str]:
        """column -> aggregate that merges it, at any level."""
        out = {"known": "max", "depth": "max", "poles": "bit_or", "off_lo": "min", "off_hi": "max"}
        for w in range(self.words):
            out[f"cats{w}"] = out[f"line{w}"] = "bit_or"
        return out

    def merge(self) -> list[Column]:
        fn = {"max": F.max, "min": F.min, "bit_or": F.bit_or}
        return [fn[how](c).alias(c) for c, how in self.aggregates.items()]

    def _bits(self, prefix: str, drop: str | None = None) -> Column:
        total = F.lit(0)
        for w in range(self.words):
            word = F.col(f"{prefix}{w}")
            if drop == "generic":
                word = word.bitwiseAND(F.lit(~self._mask(self.reg.generic, w)).cast("bigint"))
            total = total + F.bit_count(word)
        return total

    @staticmethod
    def _off_tree() -> Column:
        return F.when(F.col("off_lo").isNull(), 0).when(F.col("off_lo") == F.col("off_hi"), 1).otherwise(2)

    def n_categories(self) -> Column:
        """Known categories, those outside the tree told apart as none, one or several; see ``off_tree_counts``."""
        return self._bits("cats") + self._off_tree()

    def off_tree_counts(self, claims: DataFrame, keys: list[str]) -> DataFrame:
        """keys, n_off: how many categories outside the tree a group has.  Only claims with such a category move."""
        rows = claims.where(~F.col("canon").isin([*self.names, self.reg.unknown])).select(*keys, "canon").distinct()
        return rows.groupBy(*keys).agg(F.count("*").alias("n_off"))

    def with_exact_counts(self, merged: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
        """Adds ``n_categories`` to a merged table, whose keys may be null."""
        off = self.off_tree_counts(claims, keys)
        same = [merged[k].eqNullSafe(off[k]) for k in keys]
        joined = merged.join(off, same, "left").select(merged["*"], off["n_off"])
        return joined.withColumn("n_categories", (self._bits("cats") + F.coalesce("n_off", F.lit(0))).cast("int")).drop("n_off")

    def relationship(self) -> Column:
        """How the known categories of a merged group relate (the group has at least one)."""
        specific = self._bits("cats", "generic") + self._off_tree()
        one_branch = (self._off_tree() == 0) & (self._bits("line") == F.col("depth"))
        return (F.when(self.n_categories() == 1, "exact")
                .when(F.col("poles") == 3, "licit/illicit conflict")
                .when((specific <= 1) | one_branch, "hierarchical refinement")
                .otherwise("entity-type conflict"))
