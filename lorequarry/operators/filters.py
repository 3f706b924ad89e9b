"""Metadata filters: their normal form, the predicate they make, and the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.config import ABSTAIN, EMPTY_CATALOG, FILTER_SECTIONS
from lorequarry.functions.text import blank_to_null
from lorequarry.operators.ranking import first_per_key, year_asc


def _whole_number(v: Column) -> Column:
    """The integer of a variant: integers, and true as 1; text and fractions are null."""
    kind = F.schema_of_variant(v)
    as_bool = F.try_variant_get(v, "$", "boolean").cast("int")
    return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "int")).when(kind == "BOOLEAN", as_bool)


def string_list(v: Column) -> Column:
    """A variant as trimmed strings: a text is a list of one, anything else empty."""
    kind = F.schema_of_variant(v)
    many = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.trim(x.cast("string")))
    one = F.array(F.trim(F.try_variant_get(v, "$", "string")))
    listed = F.when(kind.startswith("ARRAY"), many).when(kind == "STRING", one)
    return F.coalesce(F.filter(listed, lambda x: x != ""), F.array().cast("array<string>"))


def normalize_filter(raw_json: Column) -> Column:
    """A filter's JSON as a struct: ``year_min, year_max, authors, section``."""
    v = F.try_parse_json(raw_json)
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    section = F.lower(F.trim(F.try_variant_get(v, "$.section", "string")))
    return F.struct(
        _whole_number(part("year_min")).alias("year_min"),
        _whole_number(part("year_max")).alias("year_max"),
        string_list(part("authors")).alias("authors"),
        F.when(section.isin(*FILTER_SECTIONS), section).alias("section"),
    )


def normalize_entities(raw_json: Column) -> Column:
    """A question's entities as a struct: ``author_name, topic, method, year_min``."""
    v = F.try_parse_json(raw_json)
    text = lambda n: blank_to_null(F.try_variant_get(v, f"$.{n}", "string")).alias(n)
    return F.struct(
        text("author_name"), text("topic"), text("method"),
        _whole_number(F.try_variant_get(v, "$.year_min", "variant")).alias("year_min"),
    )


def normalize_record(raw_json: Column, paper_id: Column, fallback_title: Column) -> Column:
    """An extractor's answer as a struct of six fields; a title that is no text, or
    blank, gives way to the fallback.  An answer that does not parse has no lists."""
    v = F.try_parse_json(raw_json)
    titled = F.when(F.schema_of_variant(F.try_variant_get(v, "$.title", "variant")) == "STRING", F.try_variant_get(v, "$.title", "string"))
    names = ("authors", "methods_proposed", "methods_criticized", "topics")
    return F.struct(
        paper_id.alias("arxiv_id"),
        F.trim(F.coalesce(blank_to_null(titled), fallback_title)).alias("title"),
        *(string_list(F.try_variant_get(v, f"$.{n}", "variant")).alias(n) for n in names),
    )


def build_where(year_min: int | None = None, year_max: int | None = None, section: str | None = None) -> Column | None:
    """The conjunction of the clauses there are; rows of unknown year fail a bound.
    Authors are never part of it."""
    clauses = []
    if year_min is not None:
        clauses.append(F.col("year") >= year_min)
    if year_max is not None:
        clauses.append(F.col("year") <= year_max)
    if section:
        clauses.append(F.col("section") == section)
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def author_matches(field: Column, needles: list[str] | Column) -> Column:
    """Whether any needle stands in the field, ignoring case, as a part of any word."""
    if isinstance(needles, list):
        needles = F.array(*(F.lit(n) for n in needles)) if needles else F.array().cast("array<string>")
    lowered = F.lower(F.coalesce(field, F.lit("")))
    return F.exists(needles, lambda n: F.contains(lowered, F.lower(n)))


def year_ok(year: Column, bound: Column) -> Column:
    """No bound passes all; with a bound, unknown years fail."""
    return bound.isNull() | F.coalesce(year >= bound, F.lit(False))


def catalog(rows: DataFrame, where: Column | None = None, authors: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Distinct papers among matching rows, as their first row by ``seq`` has them."""
    kept = rows if where is None else rows.where(where)
    kept = kept.where(F.trim(F.coalesce("arxiv_id", F.lit(""))) != "")
    if authors:
        kept = kept.where(author_matches(F.col("authors"), authors))
    return first_per_key(kept, ["arxiv_id"], [F.col(seq)]).select("arxiv_id", "year", "authors").orderBy(*year_asc("year", "arxiv_id"))


def catalog_line(papers: DataFrame) -> DataFrame:
    """One row: ``id (year=Y)`` of each paper, in order."""
    entry = F.concat("arxiv_id", F.lit(" (year="), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit(")"))
    key = F.struct(F.col("year").isNull().alias("last"), "year", "arxiv_id", entry.alias("entry"))
    listed = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["entry"])
    return papers.agg(F.coalesce(F.nullif(F.array_join(listed, ", "), F.lit("")), F.lit(EMPTY_CATALOG)).alias("catalog"))


def answer_or_abstain(hits: Column, listed: Column, answer: Column) -> Column:
    """The fixed answer where there is neither a hit nor a listed paper."""
    return F.when((F.size(hits) == 0) & (F.size(listed) == 0), F.lit(ABSTAIN)).otherwise(answer)
