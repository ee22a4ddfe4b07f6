"""Configuration as plain Python values, read once on the driver.

The files under ``config/`` are small and fixed in size (a category tree, a list of
known sources, cut-offs).  Operators turn them into Column expressions, so nothing
here is ever shipped to executors as data.
"""
from __future__ import annotations

import dataclasses
import functools
import pathlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

try:
    import yaml
except ImportError:  # pragma: no cover - PyYAML is only needed to read the files
    yaml = None

CONFIG_DIR = pathlib.Path(__file__).parent / "config"


def _read(directory: pathlib.Path, name: str) -> dict:
    if yaml is None:
        raise RuntimeError("PyYAML is needed on the driver to read the configuration files")
    return yaml.safe_load((directory / name).read_text(encoding="utf-8"))


@dataclass(frozen=True)
class Category:
    name: str
    polarity: str
    parent: str | None
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class Flags:
    """What a rule says about the root it assigns."""
    resolved: bool
    native: bool
    verified: bool


@dataclass(frozen=True)
class RootRef:
    root: str
    flags: Flags


@dataclass(frozen=True)
class SourceRule:
    """How one known source's claims are traced to a root (see config/sources.yml)."""
    source: str
    title: str
    cites: str
    chain: str | None
    strip_prefix: str | None
    kind: str | None
    field: str | None = None
    fixed: RootRef | None = None
    by_value: tuple[tuple[str, RootRef], ...] = ()
    otherwise: RootRef | None = None
    otherwise_declared: bool = False
    after_colon: bool = False
    when_no_colon: str = ""
    ignore_case: bool = False
    fragments: tuple[tuple[str, RootRef], ...] = ()
    residue_field: str | None = None
    residues: tuple[tuple[str, RootRef], ...] = ()
    fallback: RootRef | None = None

    def declared_roots(self) -> list[tuple[str, Flags, str]]:
        """(root or template, flags, DECLARED|INFERRED) for every root the rule can name."""
        if self.kind is None:
            return [(f"{self.source}:unresolved", Flags(False, False, False), "UNKNOWN")]
        if self.kind == "fixed":
            return [(self.fixed.root, self.fixed.flags, "DECLARED")]
        if self.kind == "lookup":
            rows = [(r.root, r.flags, "DECLARED") for _, r in self.by_value]
            return rows + ([(self.otherwise.root, self.otherwise.flags, "INFERRED")] if self.otherwise else [])
        rows = [(r.root, r.flags, "INFERRED") for _, r in self.fragments + self.residues]
        return rows + ([(self.fallback.root, self.fallback.flags, "INFERRED")] if self.fallback else [])


def _ref(pair) -> RootRef:
    return RootRef(pair[0], Flags(*pair[1]))


def _source_rule(name: str, spec: dict) -> SourceRule:
    rule = spec.get("rule") or {}
    kind = rule.get("kind")
    base = dict(source=name, title=spec.get("title", name), cites=spec.get("cites", ""), chain=spec.get("chain"),
                strip_prefix=spec.get("strip_prefix"), kind=kind, field=rule.get("field"))
    if kind == "fixed":
        return SourceRule(**base, fixed=_ref([rule["root"], rule["flags"]]))
    if kind == "lookup":
        return SourceRule(**base, by_value=tuple((k, _ref(v)) for k, v in rule["by_value"].items()),
                          otherwise=_ref(rule["otherwise"]) if rule.get("otherwise") else None,
                          otherwise_declared=bool(rule.get("otherwise_declared")))
    if kind == "contains":
        residue_flags = rule.get("residue_flags", [True, False, False])
        return SourceRule(**base, after_colon=bool(rule.get("after_colon")),
                          when_no_colon=rule.get("when_no_colon", ""), ignore_case=bool(rule.get("ignore_case")),
                          fragments=tuple((f, _ref([root, flags])) for f, root, flags in rule["fragments"]),
                          residue_field=rule.get("residue_field"),
                          residues=tuple((p, _ref([root, residue_flags])) for p, root in rule.get("residue_prefixes", [])),
                          fallback=_ref(rule["fallback"]))
    if kind is not None:
        raise ValueError(f"unknown rule kind {kind!r} for source {name!r}")
    return SourceRule(**base)


@dataclass(frozen=True)
class Family:
    """How the identifiers of a group of chains are told and spelled: functions of a Column of trimmed cells.  A check that Spark cannot express may
    be a vectorised UDF inside ``address``; null counts as invalid."""
    address: Callable[[Column], Column]
    transaction: Callable[[Column], Column]
    spelled: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Registry:
    categories: dict[str, Category]
    separators: tuple[str, ...]
    sources: dict[str, SourceRule]
    seeds: tuple[dict, ...]
    analysis: dict
    intake: dict
    adapters: dict
    unknown: str = "unknown"
    families: dict[str, Family] = field(default_factory=dict)

    def with_family(self, name: str, family: Family, chains: dict[str, list[str]]) -> "Registry":
        """A registry that also knows a family and its chains ({chain: names it goes by}); validation, profiling, intake and naming pick both up."""
        if name in ("evm", "bitcoin") or (taken := set(chains) & set(self.chains)):
            raise ValueError(f"already there: {name if name in ('evm', 'bitcoin') else ', '.join(sorted(taken))}")
        plain = {c: [re.sub("[^a-z0-9]+", "_", a.lower()).strip("_") for a in aliases] for c, aliases in chains.items()}
        names = [a for aliases in plain.values() for a in aliases]
        if clash := sorted(set(names) & set(self.chain_aliases) | {a for a in names if names.count(a) > 1}):
            raise ValueError(f"names of two chains: {', '.join(clash)}")
        known = {**self.intake["chains"], **{c: {"family": name, "aliases": aliases} for c, aliases in plain.items()}}
        return dataclasses.replace(self, intake={**self.intake, "chains": known}, families={**self.families, name: family})

    @classmethod
    def load(cls, directory: str | pathlib.Path | None = None, sources: dict | None = None) -> "Registry":
        """Read every file in ``directory`` (default: the bundled one).  ``sources`` replaces the
        source rules, in the shape of config/sources.yml."""
        d = pathlib.Path(directory) if directory else CONFIG_DIR
        tax = _read(d, "taxonomy.yml")
        src = _read(d, "sources.yml")
        cats = {name: Category(name, pol, parent, tuple(str(a) for a in aliases))
                for name, (pol, parent, aliases) in tax["categories"].items()}
        rules = {n: _source_rule(n, s) for n, s in (sources if sources is not None else src["sources"]).items()}
        return cls(cats, tuple(tax["structured_separators"]), rules, tuple(src.get("propagation_seeds", [])),
                   _read(d, "analysis.yml"), _read(d, "intake.yml"), _read(d, "adapters.yml"), tax["placeholder"])

    # ------------------------------------------------------------- category tree
    @functools.cached_property
    def aliases(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for c in self.categories.values():
            out[c.name.lower()] = c.name
            out.update({a.lower(): c.name for a in c.aliases})
        return out

    @functools.cached_property
    def generic(self) -> list[str]:
        """The placeholder at the top of each polarity branch."""
        return [c.name for c in self.categories.values() if c.parent is None and c.polarity in ("licit", "illicit")]

    def lineage(self, name: str) -> list[str]:
        """The category and everything above it."""
        out: list[str] = []
        while name in self.categories and name not in out:
            out.append(name)
            name = self.categories[name].parent
        return out

    # ------------------------------------------------------------- root ledger
    @functools.cached_property
    def ledger(self) -> tuple[dict[str, bool], list[tuple[str, bool]]]:
        """(exact root -> resolved, [(templated prefix, resolved)])."""
        exact: dict[str, bool] = {}
        prefixes: list[tuple[str, bool]] = []
        for rule in self.sources.values():
            if rule.kind is None:
                continue
            for root, flags, _ in rule.declared_roots():
                if "{" in root:
                    prefixes.append((root.split("{", 1)[0], flags.resolved))
                else:
                    exact[root] = flags.resolved
        return exact, prefixes

    @functools.cached_property
    def verified_roots(self) -> list[str]:
        """Roots a rule declares re-checkable.  Case-insensitive fragment rules never declare one."""
        out = set()
        for r in self.sources.values():
            named = [r.fixed] if r.fixed else []
            named += [x for _, x in r.by_value]
            named += [] if r.ignore_case else [x for _, x in r.fragments]
            out |= {x.root for x in named if x.flags.verified}
        return sorted(out)

    def owner_of(self, root: str) -> str | None:
        """The source that natively owns a root."""
        return next((s for s, r in self.sources.items()
                     if r.fixed and r.fixed.root == root and r.fixed.flags.native), None)

    def decode_checks(self) -> list[dict]:
        """(dataset, field, candidate) triples: a coded field whose fragment names a root some
        other source natively owns.  Only case-sensitive fragment rules hold codes."""
        out = []
        for s, r in self.sources.items():
            if r.kind == "contains" and not r.ignore_case:
                for _, ref in r.fragments:
                    owner = self.owner_of(ref.root)
                    if owner and owner != s:
                        out.append(dict(dataset=s, field=r.field, candidate=owner))
        return out

    def residue_checks(self) -> list[dict]:
        return [dict(dataset=s, field=r.residue_field, prefixes=[(p, ref.root) for p, ref in r.residues])
                for s, r in self.sources.items() if r.residues]

    # ------------------------------------------------------------- chains
    @functools.cached_property
    def chains(self) -> dict[str, dict]:
        return {k: v for k, v in self.intake["chains"].items() if k != "network_suffixes"}

    @functools.cached_property
    def chain_aliases(self) -> dict[str, str]:
        return {a.lower(): c for c, spec in self.chains.items() for a in spec["aliases"]}

    @property
    def evm_chains(self) -> list[str]:
        return [c for c, spec in self.chains.items() if spec["family"] == "evm"]
