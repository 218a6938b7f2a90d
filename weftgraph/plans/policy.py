"""Who may ask and see what."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, expand
from . import sparql_parser as P

REDACTED, MASKED = "[REDACTED]", "[MASKED]"


def _has(text: Column, terms: list[str], any_case: bool) -> Column:
    text = F.lower(text) if any_case else text
    return F.coalesce(reduce(lambda x, y: x | y, (F.contains(text, F.lit(t.lower() if any_case else t)) for t in terms), F.lit(False)), F.lit(False))


def redact(rows: DataFrame, denied: list[str]) -> DataFrame:
    """a value becomes [REDACTED] if its column's name or its text has a denied term (any case)."""
    if not denied:
        return rows
    whole = lambda c: any(t.lower() in c.lower() for t in denied)
    return rows.select(*(F.lit(REDACTED).alias(c) if whole(c) else F.when(_has(F.col(f"`{c}`").cast("string"), denied, True), REDACTED).otherwise(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in rows.dtypes))


@dataclass
class Role:
    allow_entities: list[str] = field(default_factory=list)
    deny_entities: list[str] = field(default_factory=list)
    allow_properties: list[str] = field(default_factory=list)
    deny_properties: list[str] = field(default_factory=list)
    mask_properties: list[str] = field(default_factory=list)
    max_rows: int = 500

    def __post_init__(self):
        # a prefixed name also means its IRI
        for name in ("allow_properties", "deny_properties", "mask_properties"):
            setattr(self, name, list(dict.fromkeys(x for p in getattr(self, name) for x in (p, expand(p)))))

    def filter_rows(self, rows: DataFrame) -> DataFrame:
        """columns with a denied property in their name go, values with one become null; values and columns with a masked one become
        [MASKED]; at most ``max_rows`` rows. Case counts. Columns of an answer are variables, so allowed properties say nothing here."""
        out = []
        for c, kind in rows.dtypes:
            if any(t in c for t in self.deny_properties):
                continue
            col = F.col(f"`{c}`")
            if any(t in c for t in self.mask_properties):
                out.append(F.lit(MASKED).alias(c))
            elif kind == "string" and (self.deny_properties or self.mask_properties):
                out.append(F.when(_has(col, self.deny_properties, False), F.lit(None)).when(_has(col, self.mask_properties, False), MASKED).otherwise(col).alias(c))
            else:
                out.append(col)
        return rows.limit(self.max_rows).select(*out)

    def filter_schema(self, tables: list[dict]) -> list[dict]:
        """entities that may be seen, with their allowed columns (all, if none are named) less the denied ones. A property is a
        column's name, or the predicate it becomes."""
        named = lambda c, spec, terms_: any(d in c or d in (spec.get("property") or "") for d in terms_)
        seen = [t for t in tables if t["entity"] not in self.deny_entities and (not self.allow_entities or t["entity"] in self.allow_entities)]
        keep = lambda c, spec: not named(c, spec, self.deny_properties) and (not self.allow_properties or named(c, spec, self.allow_properties))
        return [t | {"columns": {c: s for c, s in t["columns"].items() if keep(c, s)}} for t in seen]

    def filter_triples(self, triples: DataFrame) -> DataFrame:
        """By predicate and subject, before any query: what is denied cannot be inferred from answers, and literals of masked
        properties are masked under whatever variable they are asked."""
        own = ~_has(F.col("predicate"), self.deny_properties, False) if self.deny_properties else F.lit(True)
        if self.allow_properties:
            own = own & (_has(F.col("predicate"), self.allow_properties, False) | (F.col("predicate") == RDF_TYPE))
        if self.allow_entities:
            own = own & reduce(lambda x, y: x | y, (F.contains("subject", F.lit(f"/{e}/")) for e in self.allow_entities))
        if self.mask_properties:
            masked = _has(F.col("predicate"), self.mask_properties, False) & ~F.col("is_iri")
            triples = triples.withColumn("object", F.when(masked, MASKED).otherwise(F.col("object")))
        for e in self.deny_entities:
            own = own & ~F.contains("subject", F.lit(f"/{e}/")) & ~(F.col("is_iri") & F.contains("object", F.lit(f"/{e}/")))
        return triples.where(own)


@dataclass
class Policies:
    """A role's policy, else that of default. Without any policy there are no rules; where there are policies, a named role that
    has none, and no default, sees no rows."""

    roles: dict[str, Role] = field(default_factory=dict)

    def of(self, role: str | None) -> Role:
        found = self.roles.get(role or "default") or self.roles.get("default")
        return found or (Role(max_rows=0) if role and self.roles else Role())

    @classmethod
    def from_config(cls, security: dict) -> Policies:
        """``policies`` is a list of mappings, each with its ``role``; ``roles`` is a mapping of names to mappings. An unknown key is an
        error, so that no rule is dropped without a word."""
        if unknown := set(security) - {"policies", "roles", "query"}:
            raise ValueError(f"security does not know {sorted(unknown)}: policies, roles, query")
        listed = [(p.get("role"), p) for p in security.get("policies") or []]
        found = {}
        for name, spec in [*listed, *(security.get("roles") or {}).items()]:
            spec = {k: v for k, v in (spec or {}).items() if k != "role"}
            if not name or (unknown := set(spec) - set(Role.__dataclass_fields__)):
                raise ValueError(f"the policy of role {name!r} " + ("has no role" if not name else f"does not know {sorted(unknown)}: {', '.join(Role.__dataclass_fields__)}"))
            found[name] = Role(**{k: v for k, v in spec.items() if v is not None})
        return cls(found)


@dataclass
class QueryPolicy:
    """what a query's text may be."""

    max_characters: int = 20_000
    default_limit: int = 500
    denied_terms: list[str] = field(default_factory=list)

    def check(self, text: str) -> tuple[P.Query | None, list[str]]:
        """The parsed query with a limit, and all errors."""
        errors = []
        if len(text or "") > self.max_characters:
            errors.append(f"the query has more than {self.max_characters} characters")
        errors += [f"the query names {t}, which is denied" for t in self.denied_terms if t.lower() in (text or "").lower()]
        query = None
        try:
            query = P.parse(text)
        except P.SparqlError as e:
            errors.append(str(e))
        if query is not None and query.form == "select" and query.limit is None:
            query.limit = self.default_limit  # on the query itself: a limit in a sub-select is another one
        return (None if errors else query), errors
