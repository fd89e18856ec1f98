"""Score arithmetic. Rounding is half-up on decimal digits, as in the browser client."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocab
from .text import collapse, count_numbers, text_or_empty


def half_up(c: Column, digits: int) -> Column:
    """Round half-up; the inner rounding removes binary noise such as 45.349999999."""
    return F.round(F.round(c, digits + 6), digits)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    number = c.cast("string").try_cast("double")
    return F.when(number.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))


def parse_year(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


def normalize_weights(weights: dict[str, Column]) -> dict[str, Column]:
    """Negative weights count as 0; the rest is divided by its sum, three digits;
    without any weight the defaults apply."""
    raw = {a: F.greatest(F.lit(0.0), F.coalesce(weights[a].cast("double"), F.lit(0.0))) for a in vocab.AXES}
    total = sum(raw.values(), F.lit(0.0))
    return {
        a: F.when(total <= 0, F.lit(vocab.DEFAULT_WEIGHTS[a])).otherwise(
            half_up(raw[a] / F.nullif(total, F.lit(0.0)), 3)
        )
        for a in vocab.AXES
    }


def weights_from_json(c: Column) -> Column:
    """map<axis,double> or null for malformed text."""
    parsed = F.from_json(c, "map<string,double>", {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(c).isNotNull(), parsed)


def effective(expert: Column, model: Column) -> Column:
    """The expert's override where given, else the model's score."""
    return F.coalesce(expert, model)


def composite(scores: dict[str, Column], weights: dict[str, Column] | None = None) -> Column:
    """Weighted mean of the axes, risk inverted, one digit; 0 for weights that sum to 0."""
    weights = weights or {}
    w = {a: F.coalesce(weights.get(a, F.lit(None)).cast("double"), F.lit(vocab.DEFAULT_WEIGHTS[a]))
         for a in vocab.AXES}
    s = {a: F.coalesce(scores[a].cast("double"), F.lit(0.0)) for a in vocab.AXES}
    gain = (w["novelty"] * s["novelty"] + w["value"] * s["value"]
            + w["feasibility"] * s["feasibility"] + w["risk"] * (F.lit(100.0) - s["risk"]))
    total = w["novelty"] + w["value"] + w["feasibility"] + w["risk"]
    return F.coalesce(half_up(gain / F.nullif(total, F.lit(0.0)), 1), F.lit(0.0))


def band(c: Column) -> Column:
    return F.when(c >= 70, "good").when(c >= 45, "mid").otherwise("weak")


def confidence(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def review_status(c: Column) -> Column:
    return F.when(c.isin("ok", "warning", "failed"), c).otherwise("warning")


def _weight_text(percent: Column) -> Column:
    text = F.translate(F.format_string("%.2f", percent / F.lit(100.0)), ".", ",")
    return F.regexp_replace(text, r",?0+$", "")


def formula_text(weights: dict[str, Column]) -> Column:
    """The ranking formula in words; the weights are percentages."""
    w = {a: _weight_text(weights[a]) for a in vocab.AXES}
    return F.concat_ws(
        " + ",
        F.concat(w["novelty"], F.lit(" × новизна")),
        F.concat(w["value"], F.lit(" × ценность")),
        F.concat(w["feasibility"], F.lit(" × реализуемость")),
        F.concat(w["risk"], F.lit(" × (100 - риск)")),
    )


# ---- library items (scale 0..10) ----

def ten(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0.0)).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(10.0), c)), 1))


def freshness(year: Column, this_year: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(this_year) - year)
    return (
        F.when(F.coalesce(year, F.lit(0)) == 0, 4.5)
        .when(age <= 5, F.lit(10.0) - age)
        .when(age <= 8, 4.0)
        .when(age <= 12, 3.0)
        .otherwise(2.0)
    )


def uniqueness(token_count: Column, item_count: Column, max_similarity: Column) -> Column:
    return (
        F.when(token_count == 0, 4.0)
        .when(item_count <= 1, 7.5)
        .otherwise(ten(F.lit(4.0) + (F.lit(1.0) - max_similarity) * 6.0))
    )


def relevance(token_count: Column, total_weight: Column, matched_weight: Column, matched_terms: Column) -> Column:
    share = matched_weight / F.nullif(total_weight, F.lit(0.0))
    return (
        F.when(token_count == 0, 0.0)
        .when(F.coalesce(total_weight, F.lit(0.0)) == 0, 5.0)
        .when(F.coalesce(matched_terms, F.lit(0)) == 0, 1.5)
        .otherwise(ten(F.lit(2.5) + share * 6.0 + F.least(F.lit(1.5), matched_terms * 0.35)))
    )


def factual(corpus: Column, reference: Column, kind: Column, table_count: Column,
            source_type: Column, file_type: Column) -> Column:
    size = F.length(corpus)
    points = (
        F.when(size >= 80, 2.0).otherwise(0.0)
        + F.when(size >= 220, 1.5).otherwise(0.0)
        + F.when(size >= 500, 1.0).otherwise(0.0)
        + F.least(F.lit(2.5), count_numbers(corpus) * 0.35)
        + F.when(collapse(reference) != "", 1.5).otherwise(0.0)
        + F.when((kind == "document") & (table_count > 0), 2.0).otherwise(0.0)
        + F.when(source_type.isin("dataset", "report", "experiment", "patent"), 1.0).otherwise(0.0)
        + F.when(F.lower(text_or_empty(file_type)).isin("xlsx", "csv"), 1.0).otherwise(0.0)
    )
    return F.when(size == 0, 0.0).otherwise(ten(points))


def usage(count: Column) -> Column:
    return (
        F.when(count >= 4, 10.0).when(count == 3, 9.0).when(count == 2, 8.0)
        .when(count == 1, 6.0).otherwise(0.0)
    )


def novelty_label(score: Column) -> Column:
    return (
        F.when(score >= 8.5, "Очень высокая").when(score >= 6.5, "Высокая")
        .when(score >= 4.5, "Средняя").when(score >= 2.5, "Низкая").otherwise("Очень низкая")
    )
