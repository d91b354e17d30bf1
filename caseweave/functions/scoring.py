"""Scores, bands, labels and templates, as Columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import let


def parse_amount(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit(""))


def parse_duration(raw: Column) -> Column:
    """Seconds as double, only for a plain non-negative number."""
    return F.when(raw.rlike(r"^\d+(?:\.\d+)?$"), raw.try_cast("double"))


def lead_confidence(connections: Column, sources: Column) -> Column:
    """min(0.98, round(0.70 + 0.04*connections + 0.03*sources, 2)) in exact decimals."""
    score = (F.expr("0.70BD") + connections.cast("decimal(18,0)") * F.expr("0.04BD")
             + sources.cast("decimal(18,0)") * F.expr("0.03BD"))
    return F.least(F.expr("0.98BD"), F.round(score, 2)).cast("double")


def lead_severity(connections: Column, sources: Column) -> Column:
    return F.when((connections >= 5) | (sources >= 2), F.lit("high")).otherwise(F.lit("medium"))


def confidence_band(score: Column) -> Column:
    return (F.when(score >= 0.90, F.lit("strong")).when(score >= 0.75, F.lit("moderate"))
            .otherwise(F.lit("weak")))


def confidence_percent(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def edge_label(kind: Column, occurrences: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in V.EDGE_LABELS.items() for x in pair])
    base = F.coalesce(F.try_element_at(known, kind), F.replace(F.lower(kind), F.lit("_"), F.lit(" ")))
    return F.concat(base, F.when(occurrences > 1, F.concat(F.lit(" ×"), occurrences.cast("string")))
                    .otherwise(F.lit("")))


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit,
                  F.concat(F.substr(text, F.lit(1), F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def mask_account(bank: Column, number: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")) != "",
                  F.concat(F.coalesce(bank, F.lit("")), F.lit(" ···"), F.right(number, F.lit(4)))).otherwise(fallback)


def evidence_text(template: str, *values: Column) -> Column:
    return F.format_string(template, *[F.coalesce(v, F.lit("")) for v in values])


def drop_empty(entries: Column) -> Column:
    """Map without NULL or empty values."""
    return F.map_filter(entries, lambda _, v: F.coalesce(v, F.lit("")) != "")


def round3(value: Column) -> Column:
    return F.round(value, 3)


def role_type(name: Column) -> Column:
    org = F.lower(name).rlike("|".join(V.FORM_ORG_WORDS))
    return F.when(org, F.lit("Organization")).otherwise(F.lit("Person"))


def role_relation(role: Column) -> Column:
    accused = F.lower(role).rlike("|".join(V.FORM_ACCUSED_WORDS))
    return F.when(accused, F.lit("ACCUSED_IN")).otherwise(F.lit("MENTIONED_IN"))


def extraction_version(mode: str = "rules") -> Column:
    return F.lit(":".join([*V.COMPONENT_VERSIONS, mode]))


def clamp_currency(raw: Column) -> Column:
    """Matched currency token as an ISO code; absent tokens stay NULL."""
    return let(F.upper(F.replace(raw, F.lit("."), F.lit(""))),
               lambda c: F.when(c.isin("USD", "$"), F.lit("USD")).when(c != "", F.lit("INR")))
