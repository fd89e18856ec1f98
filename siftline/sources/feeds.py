"""Bibliographic feeds: raw JSON lines in, one record schema out.

A feed is a JSON schema plus a projection of the parsed struct; further feeds are added
to FEEDS. Raw lines arrive as (feed, pos, json); the scan of a feed is one map-only stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.ranking import first_row

RECORD = ["external_id", "title", "source_type", "authors", "year", "reference", "content", "excerpt",
          "journal", "work_type", "landing_page_url", "pdf_url", "is_open_access", "tldr", "origin"]

# Feeds tried by default, in this order.
DEFAULT_ORDER = ["openalex", "crossref", "semantic_scholar"]


@dataclass(frozen=True)
class Feed:
    schema: str
    project: Callable[[Column], dict[str, Column]]
    keyless: bool = True


def _clean(c: Column) -> Column:
    return tx.strip(tx.text_or_empty(c))


def _opt(c: Column) -> Column:
    return F.nullif(_clean(c), F.lit(""))


def _doi_link(doi: Column, other: Column) -> Column:
    return F.when(_clean(doi) != "", F.concat(F.lit("https://doi.org/"), _clean(doi))).otherwise(_opt(other))


_LOCATION = "struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string,homepage_url:string>>"


def _work(r: Column) -> dict[str, Column]:
    places = F.concat(F.array(r["best_oa_location"], r["primary_location"]),
                      F.coalesce(r["locations"], F.array().cast(f"array<{_LOCATION}>")))
    landings = F.flatten(F.transform(places, lambda p: F.array(p["landing_page_url"], p["source"]["homepage_url"])))
    oa = r["open_access"]["oa_url"]

    def first(items):
        return F.get(F.filter(items, lambda x: x.isNotNull() & (x != "")), F.lit(0))

    landing = F.coalesce(first(landings), oa)
    pdf = F.coalesce(first(F.transform(places, lambda p: p["pdf_url"])),
                     F.when(F.lower(oa).endswith(".pdf"), oa))
    body = tx.strip(tx.inverted_index_text(r["abstract_inverted_index"]))
    names = F.transform(F.coalesce(r["authorships"], F.array().cast("array<struct<author:struct<display_name:string>>>")),
                        lambda a: a["author"]["display_name"])
    return {
        "external_id": _clean(r["id"]),
        "title": _clean(F.coalesce(F.nullif(r["display_name"], F.lit("")), r["title"])),
        "source_type": F.lit("literature"), "authors": tx.author_line(names), "year": r["publication_year"],
        "reference": F.coalesce(_opt(r["doi"]), F.nullif(landing, F.lit("")), _clean(r["id"])),
        "content": body, "journal": _opt(r["primary_location"]["source"]["display_name"]),
        "work_type": _opt(r["type"]), "landing_page_url": landing, "pdf_url": pdf,
        "is_open_access": F.coalesce(r["open_access"]["is_oa"], F.lit(False)),
    }


def _publication(r: Column) -> dict[str, Column]:
    people = F.coalesce(r["author"], F.array().cast("array<struct<name:string,given:string,family:string>>"))
    names = F.transform(people, lambda a: F.coalesce(_opt(a["name"]), F.concat_ws(" ", _opt(a["given"]), _opt(a["family"]))))
    link = _doi_link(r["DOI"], r["URL"])
    year = F.get(F.get(r["issued"]["date-parts"], F.lit(0)), F.lit(0))
    return {
        "external_id": F.coalesce(link, F.lit("")), "title": _clean(F.get(r["title"], F.lit(0))),
        "source_type": F.lit("literature"), "authors": F.nullif(tx.author_line(names), F.lit("")), "year": year,
        "reference": link, "content": tx.strip_tags(r["abstract"]),
        "journal": _opt(F.get(r["container-title"], F.lit(0))), "work_type": _opt(r["type"]),
        "landing_page_url": _opt(r["URL"]),
    }


def _paper(r: Column) -> dict[str, Column]:
    names = F.transform(F.coalesce(r["authors"], F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    link = _doi_link(r["externalIds"]["DOI"], r["url"])
    tldr = _opt(r["tldr"]["text"])
    return {
        "external_id": F.coalesce(link, _clean(r["externalIds"]["CorpusId"])), "title": _clean(r["title"]),
        "source_type": F.lit("literature"), "authors": F.nullif(tx.author_line(names), F.lit("")),
        "year": r["year"], "reference": link, "content": F.coalesce(_opt(r["abstract"]), tldr, F.lit("")),
        "journal": _opt(r["venue"]), "work_type": F.lit("article"), "landing_page_url": _opt(r["url"]),
        "pdf_url": _opt(r["openAccessPdf"]["url"]), "is_open_access": r["openAccessPdf"].isNotNull(), "tldr": tldr,
    }


def _material(r: Column) -> dict[str, Column]:
    formula = _clean(r["formula_pretty"])

    def prop(label, c, unit):
        return F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string"), F.lit(unit)))

    facts = F.concat_ws(
        "; ", prop("band_gap=", r["band_gap"], " эВ"), prop("E_form=", r["formation_energy_per_atom"], " эВ/ат"),
        prop("E_above_hull=", r["energy_above_hull"], " эВ/ат"), prop("плотность=", r["density"], " г/см³"),
        F.when(r["is_stable"], "термодинамически стабильна"))
    link = F.when(_clean(r["material_id"]) != "",
                  F.concat(F.lit("https://materialsproject.org/materials/"), _clean(r["material_id"])))
    return {
        "external_id": _clean(r["material_id"]),
        "title": F.when(formula != "", F.concat(formula, F.lit(" — расчётные свойства (Materials Project)"))).otherwise(""),
        "source_type": F.lit("dataset"), "authors": F.lit("Materials Project"), "year": F.lit(None).cast("int"),
        "reference": link,
        "content": F.concat(F.lit("Материал "), formula, F.lit(" (Materials Project). "), facts, F.lit(".")),
        "journal": F.lit("Materials Project"), "work_type": F.lit("dataset"), "landing_page_url": link,
        "is_open_access": F.lit(True),
    }


FEEDS: dict[str, Feed] = {
    "openalex": Feed(
        "id string, doi string, display_name string, title string, type string, publication_year int, "
        "abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, "
        f"open_access struct<is_oa:boolean,oa_url:string>, best_oa_location {_LOCATION}, primary_location {_LOCATION}, "
        f"locations array<{_LOCATION}>", _work),
    "crossref": Feed(
        "title array<string>, author array<struct<name:string,given:string,family:string>>, "
        "issued struct<`date-parts`:array<array<int>>>, DOI string, abstract string, `container-title` array<string>, "
        "type string, URL string", _publication),
    "semantic_scholar": Feed(
        "title string, abstract string, venue string, url string, year int, authors array<struct<name:string>>, "
        "externalIds struct<DOI:string,CorpusId:string>, tldr struct<text:string>, openAccessPdf struct<url:string>", _paper),
    "materials_project": Feed(
        "material_id string, formula_pretty string, band_gap double, formation_energy_per_atom double, "
        "energy_above_hull double, density double, is_stable boolean", _material, keyless=False),
}


def feed_order(requested: list[str] | None = None, keys: set[str] = frozenset()) -> list[str]:
    """Active feeds in order. A feed that needs a key joins by itself once its key is
    there; if nothing is active the first default is used."""
    def active(name):
        return name in FEEDS and (FEEDS[name].keyless or name in keys)

    names = [n.strip() for n in (DEFAULT_ORDER if requested is None else requested) if active(n.strip())]
    names += [n for n, f in FEEDS.items() if not f.keyless and active(n) and n not in names]
    return names or DEFAULT_ORDER[:1]


def feed_table(spark: SparkSession, order: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(order)), "priority int, feed string")


def normalize(raw: DataFrame, feed: str) -> DataFrame:
    """pos + record columns of one feed. A line that does not parse or has no title gives nothing."""
    spec = FEEDS[feed]
    parsed = raw.select("pos", F.from_json("json", spec.schema, {"mode": "PERMISSIVE"}).alias("r"))
    cols = spec.project(F.col("r"))
    cols["origin"] = F.lit(feed)
    types = {"year": "int", "is_open_access": "boolean"}
    out = [cols.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in RECORD]
    # A filter would be pushed below the projection and compute its columns twice; the
    # one-element array is computed once and kept or dropped.
    kept = F.filter(F.array(F.struct(*out)), lambda record: record["title"] != "")
    return parsed.select("pos", F.inline(kept)).withColumn("excerpt", tx.excerpt(F.col("content")))


def combine(raw: DataFrame, order: list[str]) -> DataFrame:
    """The ordered union of feeds without duplicates: of records with the same key the
    earlier feed wins, then the earlier line. Records without content do not take part.

    Only the first record of a key survives each map task, so a key shared by a third of
    all records moves one row per task.
    """
    parts = [
        normalize(raw.filter(F.col("feed") == name), name).withColumn("priority", F.lit(i))
        for i, name in enumerate(order)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    key = tx.dedupe_key(F.col("reference"), F.col("title"), F.col("year"))
    filled = union.filter(_clean(F.col("content")) != "").withColumn("dedupe_key", key)
    return first_row(filled, ["dedupe_key"], [F.col("priority"), F.col("pos")])


def feed_stats(raw: DataFrame, kept: DataFrame, order: list[str]) -> DataFrame:
    """feed, kept, errors for every feed of the order, zeros included."""
    feeds = feed_table(raw.sparkSession, order)
    counts = kept.groupBy(F.col("origin").alias("feed")).agg(F.count(F.lit(1)).alias("kept"))
    bad = raw.filter(F.try_parse_json("json").isNull()).groupBy("feed").agg(F.count(F.lit(1)).alias("errors"))
    return (
        feeds.join(counts, "feed", "left").join(bad, "feed", "left")
        .select("feed", "priority", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("errors", F.lit(0)).alias("errors"))
    )
