"""Where a claim's evidence originates: source rules compiled to one CASE expression."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Flags, Registry, RootRef, SourceRule
from .text import lookup


@dataclass(frozen=True)
class _Branch:
    """One way a root is assigned, and what the claim then carries."""
    root: str
    flags: Flags
    kind: str
    value: Column | None = None      # fills the root's template


class _Plan:
    """The rules of a registry as numbered branches, in three kinds of lookup."""

    def __init__(self, reg: Registry):
        self.branches: list[_Branch] = []
        self.by_source: dict[str, int] = {}                    # where a source's claims end up by default
        self.by_value: dict[str, dict[str, int]] = {}          # field -> "source / value" -> branch
        self.tests: list[tuple[Column, int]] = []              # fragments and residues, in rule order
        self.tails: set[str] = set()
        for rule in reg.sources.values():
            self._add(rule)
        self.stranger = len(self.branches) + 1

    def _number(self, branch: _Branch) -> int:
        self.branches.append(branch)
        return len(self.branches)

    def _add(self, rule: SourceRule) -> None:
        if rule.kind is None:
            return
        if rule.kind == "fixed":
            self.by_source[rule.source] = self._number(_Branch(rule.fixed.root, rule.fixed.flags, "DECLARED"))
            return
        field = F.coalesce(F.col(rule.field), F.lit(""))
        if rule.kind == "lookup":
            table = self.by_value.setdefault(rule.field, {})
            for value, ref in rule.by_value:
                table[f"{rule.source}\x1f{value}"] = self._number(_Branch(ref.root, ref.flags, "DECLARED"))
            other = rule.otherwise or RootRef(f"{rule.source}_other", Flags(False, False, False))
            self.by_source[rule.source] = self._number(
                _Branch(other.root, other.flags, "DECLARED" if rule.otherwise_declared else "INFERRED"))
            return
        mine, value = F.col("source") == rule.source, field
        if rule.after_colon:
            self.tails.add(rule.field)
            value = F.coalesce(F.col(f"_tail_{rule.field}"), F.lit(rule.when_no_colon))
        hay = F.lower(value) if rule.ignore_case else value
        for fragment, ref in rule.fragments:
            test = mine & hay.contains(fragment.lower() if rule.ignore_case else fragment)
            self.tests.append((test, self._number(_Branch(ref.root, ref.flags, "INFERRED"))))
        for prefix, ref in rule.residues:
            residue = F.lower(F.coalesce(F.col(rule.residue_field), F.lit("")))
            self.tests.append((mine & residue.startswith(prefix), self._number(_Branch(ref.root, ref.flags, "INFERRED"))))
        self.by_source[rule.source] = self._number(
            _Branch(rule.fallback.root, rule.fallback.flags, "INFERRED", value))

    def choice(self) -> Column:
        """The number of the branch that decides a claim."""
        options = [F.try_element_at(_int_map(table), F.concat_ws("\x1f", "source", F.coalesce(F.col(field), F.lit(""))))
                   for field, table in self.by_value.items()]
        if self.tests:
            case = F.when(*self.tests[0][:1], self.tests[0][1])
            for test, number in self.tests[1:]:
                case = case.when(test, number)
            options.append(case)
        if self.by_source:
            options.append(F.try_element_at(_int_map(self.by_source), F.col("source")))
        return F.coalesce(*options, F.lit(self.stranger))


def _int_map(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _filled_template(template: str, value: Column) -> Column:
    parts = [p for p in re.split(r"(\{value\}|\{value_or_unknown\})", template) if p]
    known = {"{value}": value, "{value_or_unknown}": F.when(value == "", "unknown").otherwise(value)}
    cols = [known.get(p, F.lit(p)) for p in parts]
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def _known_outright(reg: Registry, root: str) -> bool | None:
    """Whether a branch's root is a known origin, when its name or template alone decides that."""
    exact, prefixes = reg.ledger
    if "{" not in root:
        return exact.get(root, False)
    stem = root.split("{", 1)[0]
    clash = any(e.startswith(stem) for e in exact) or sum(p.startswith(stem) or stem.startswith(p) for p, _ in prefixes) > 1
    return None if clash else dict(prefixes)[stem]


def with_provenance(df: DataFrame, reg: Registry) -> DataFrame:
    """Add root, its flags, how it was established, and whether it is a known origin.

    The rules become one small expression that yields the number of the branch that decides;
    root and flags are then array accesses.  CASE expressions that carry the values themselves
    generate methods too large for the JIT compiler.
    """
    plan = _Plan(reg)
    for field in sorted(plan.tails):
        text = F.coalesce(F.col(field), F.lit(""))
        at = F.instr(text, ":")
        df = df.withColumn(f"_tail_{field}", F.when(at > 0, F.substring(text, at + F.lit(1), F.length(text))))
    df = df.withColumn("_branch", plan.choice())
    branch = F.col("_branch")

    def per_branch(values: list, stranger, sql_type: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(sql_type) for v in values + [stranger]]), branch)

    root = per_branch([None if "{" in b.root else b.root for b in plan.branches], None, "string")
    templated = [(i, b) for i, b in enumerate(plan.branches) if "{" in b.root]
    for i, b in templated:
        root = F.when(branch == i + 1, _filled_template(b.root, b.value)).otherwise(root)
    root = F.when(branch == plan.stranger, F.concat(F.col("source"), F.lit(":unresolved"))).otherwise(root)
    stated = per_branch([_known_outright(reg, b.root) for b in plan.branches], None, "boolean")
    df = df.withColumns({
        "root": root,
        "prov_resolved": per_branch([b.flags.resolved for b in plan.branches], False, "boolean"),
        "prov_native": per_branch([b.flags.native for b in plan.branches], False, "boolean"),
        "prov_verified": per_branch([b.flags.verified for b in plan.branches], False, "boolean"),
        "prov_kind": per_branch([b.kind for b in plan.branches], "UNKNOWN", "string"),
        "_stated": stated})
    df = df.withColumn("root_known", F.coalesce(F.col("_stated"), root_known(reg, F.col("root"))))
    return df.drop("_branch", "_stated", *[f"_tail_{f}" for f in plan.tails])


def root_known(reg: Registry, root: Column) -> Column:
    """Is the root a known evidential origin?  Decided from its name alone, so it also holds for
    roots that no loaded claim carries; a root no rule names is unknown."""
    exact, prefixes = reg.ledger
    out = F.lit(False)
    for prefix, resolved in reversed(prefixes):
        out = F.when(root.startswith(prefix), F.lit(resolved)).otherwise(out)
    named = lookup({r: ("1" if ok else "0") for r, ok in exact.items()}, root)
    return F.when(named.isNotNull(), named == "1").otherwise(out)


def provenance_status(resolved: Column, native: Column) -> Column:
    return F.when(~resolved, "unresolved").when(native, "resolved").otherwise("inherited")


def strip_source_prefix(reg: Registry, source: Column, raw: Column) -> Column:
    """Drop the marker one source puts before its identifiers; other sources are untouched."""
    out = raw
    for rule in reg.sources.values():
        if rule.strip_prefix:
            p = rule.strip_prefix
            out = F.when((source == rule.source) & raw.startswith(p),
                         F.substring(raw, F.lit(len(p) + 1), F.length(raw))).otherwise(out)
    return out


def source_chain(reg: Registry, source: Column) -> Column:
    """The chain a known source declares for its identifiers, NULL when it declares none."""
    return lookup({s: r.chain for s, r in reg.sources.items() if r.chain}, source)
