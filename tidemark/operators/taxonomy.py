"""Rule taxonomy as expressions: rules are literals of a CASE chain, so that rows are classified in one scan without a join.

Domain: exact event id, else the prefix rule first by (priority, rule_id), else the title rule, else the default. Rows
whose title matches rules of more than one (domain, category) are ``ambiguous`` whatever else matched. Event family:
exact id, else the regex rule first by (priority, rule_id), else the event id, else the contract id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import keywords_pattern


@dataclass(frozen=True)
class Rule:
    """A prefix rule (``pattern``, on "event_id contract_id"), or a title rule (``keywords``)."""

    rule_id: str
    domain: str
    category: str
    priority: int
    pattern: str = ""
    keywords: tuple[str, ...] = ()
    confidence: str = "medium"
    is_sports: bool = False


@dataclass(frozen=True)
class FamilyRule:
    """``prefix`` with the pattern's group of the event id after it. The match ignores case, the extraction doesn't."""

    rule_id: str
    priority: int
    pattern: str
    prefix: str
    group: int = 1


@dataclass(frozen=True)
class Taxonomy:
    exact: dict[str, tuple[str, str]]
    prefixes: tuple[Rule, ...]
    titles: tuple[Rule, ...]
    families: tuple[FamilyRule, ...] = ()
    exact_families: dict[str, str] | None = None
    default: str = "unknown"


def _text() -> Column:
    """A missing event id leaves a leading space, so that ^ rules can't reach the contract id then."""
    return F.concat_ws(" ", F.coalesce("event_id", F.lit("")), F.coalesce("contract_id", F.lit("")))


def _first(matches: list[tuple[Column, Rule]]) -> Column:
    """The first matching rule as a struct."""
    return F.coalesce(F.lit(None), *[F.when(m, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.domain).alias("domain"), F.lit(r.category).alias("category"), F.lit(r.confidence).alias("confidence"), F.lit(r.is_sports).alias("is_sports"))) for m, r in matches])


def classify(rows: DataFrame, rules: Taxonomy) -> DataFrame:
    """``rows`` (contract_id, event_id, title, ...) with domain, category, taxonomy_source, taxonomy_confidence, taxonomy_rule_id, taxonomy_ambiguous, is_sports, event_family_id and event_family_source."""
    ordered = lambda rs: sorted(rs, key=lambda r: (r.priority, r.rule_id))
    prefixes, titles = ordered(rules.prefixes), ordered(rules.titles)
    title = F.coalesce("title", F.lit(""))
    title_match = [(title.rlike(keywords_pattern(list(r.keywords))), r) for r in titles]
    exact = [(F.col("event_id") == event, Rule(f"exact:{event}", d, c, 0, confidence="manual")) for event, (d, c) in sorted(rules.exact.items())]
    kinds = F.array_distinct(F.array_compact(F.array(*[F.when(m, F.lit(f"{r.domain}|{r.category}")) for m, r in title_match]))) if title_match else F.array().cast("array<string>")
    found = rows.withColumns({
        "__exact": _first(exact) if exact else F.lit(None),
        "__prefix": _first([(_text().rlike("(?i)" + r.pattern), r) for r in prefixes]),
        "__title": _first(title_match),
        "__torn": F.size(kinds) > 1,
    })
    best = F.coalesce(*([F.col("__exact")] if exact else []), F.col("__prefix"), F.col("__title"))
    torn = F.col("__torn")
    source = F.when(F.col("__exact").isNotNull(), "manual").when(F.col("__prefix").isNotNull(), "prefix").when(F.col("__title").isNotNull(), "title").otherwise("event_id_proxy")
    family_rules = ordered(rules.families)
    matched = [(F.coalesce("event_id", F.lit("")).rlike("(?i)" + r.pattern), r) for r in family_rules]
    by_rule = F.coalesce(F.lit(None), *[F.when(m, F.concat(F.lit(r.prefix), F.regexp_extract(F.col("event_id"), r.pattern, r.group))) for m, r in matched])
    exact_family = F.coalesce(F.lit(None), *[F.when(F.col("event_id") == e, F.lit(f)) for e, f in sorted((rules.exact_families or {}).items())])
    out = found.withColumn("__best", best).withColumns({
        "domain": F.when(torn, "ambiguous").otherwise(F.coalesce("__best.domain", F.lit(rules.default))),
        "category": F.when(torn, "ambiguous").otherwise(F.coalesce("__best.category", F.lit(rules.default))),
        "taxonomy_source": source,
        "taxonomy_confidence": F.when(torn, "ambiguous").otherwise(F.coalesce("__best.confidence", F.lit("low"))),
        "taxonomy_rule_id": F.col("__best.rule_id"),
        "taxonomy_ambiguous": torn,
        "is_sports": F.when(torn, False).otherwise(F.coalesce("__best.is_sports", F.lit(False))),
        "event_family_id": F.coalesce(exact_family, by_rule, F.col("event_id"), F.col("contract_id")),
        "event_family_source": F.when(exact_family.isNotNull(), "exact").when(by_rule.isNotNull(), "regex").when(F.col("event_id").isNotNull(), "event_id").otherwise("contract_id"),
    })
    return out.drop("__exact", "__prefix", "__title", "__torn", "__best")


AUDIT_KEYS = ["domain", "category", "taxonomy_source", "taxonomy_confidence", "taxonomy_ambiguous", "is_sports", "event_family_source"]


def audit(classified: DataFrame) -> DataFrame:
    """Rows, contracts, events and families per combination of labels."""
    return classified.groupBy(*AUDIT_KEYS).agg(F.count(F.lit(1)).alias("row_count"), *[F.count_distinct(c).alias(n) for c, n in (("contract_id", "contracts"), ("event_id", "events"), ("event_family_id", "families"))])


# How sure a family is by its source, and what its source means.
FAMILY_CONFIDENCE = {"exact": "high", "regex": "medium", "event_id": "low", "contract_id": "low"}
NOTES = {"manual": "matched by id", "prefix": "matched by a prefix rule", "title": "matched by title words", "event_id_proxy": "no rule matched"}


def _mapped(column: str, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def full_audit(classified: DataFrame) -> DataFrame:
    """Rows, contracts and families per combination of all twelve labels."""
    rows = classified.withColumns({
        "event_family_confidence": _mapped("event_family_source", FAMILY_CONFIDENCE), "taxonomy_notes": _mapped("taxonomy_source", NOTES),
        "is_unknown_group": (F.col("domain") == "unknown") | (F.col("category") == "unknown"), "is_ambiguous_group": F.col("taxonomy_ambiguous"),
    })
    keys = [*AUDIT_KEYS, "taxonomy_rule_id", "event_family_confidence", "taxonomy_notes", "is_unknown_group", "is_ambiguous_group"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("contract_id").alias("contracts"), F.count_distinct("event_family_id").alias("families"))


def examples(classified: DataFrame, n: int = 25) -> DataFrame:
    """The first n contracts of each (domain, category, source)."""
    w = Window.partitionBy("domain", "category", "taxonomy_source").orderBy("contract_id")
    return classified.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("domain", "category", "taxonomy_source", "contract_id", "title", "rank")


def summary(classified: DataFrame) -> DataFrame:
    """One row of counts and shares."""
    share = lambda c: F.avg(c.cast("double"))
    return classified.agg(
        F.count(F.lit(1)).alias("row_count"), share(F.col("domain") == "unknown").alias("unknown_share"), share(F.col("taxonomy_ambiguous")).alias("ambiguous_share"), share(F.col("is_sports")).alias("sports_share"),
        share(F.col("event_family_source") == "regex").alias("regex_family_share"), F.count_if(F.col("event_family_id").isNull()).alias("missing_family"),
    )
