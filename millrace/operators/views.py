"""Filters, labels and scores of stored rows: content gates, bookmarks and history, document relevance, document structure, dates and literals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import any_of, found
from millrace.operators.extraction import entities

# Lenses whose rows are read as files, and those whose pages are scraped; marks of a blocked page.
FILE_LENSES = ["pdf", "government", "procurement"]
PAGE_LENSES = ["procurement", "provider", "pricing", "legal", "medical", "academic", "financial"]
#: Texts longer than this are enriched, and kept from a direct scrape.
ENOUGH = 100


def enough(text: Column) -> Column:
    """More than ``ENOUGH`` characters, untrimmed; False for NULL."""
    return F.coalesce(F.length(text) > ENOUGH, F.lit(False))


def content_way(lens: Column, url: Column) -> Column:
    """How a row's content is got: 'pdf', 'docx' or 'html', or 'none' for a lens that reads neither."""
    low = F.lower(F.coalesce(url, F.lit("")))
    pdf, docx, files = low.contains(".pdf"), low.endswith(".docx"), F.coalesce(lens.isin(FILE_LENSES), F.lit(False))
    return F.when((files | pdf) & pdf, "pdf").when(files & docx, "docx").when(F.coalesce(lens.isin(PAGE_LENSES), F.lit(False)), "html").otherwise("none")


def bookmarks(rows: DataFrame, term: str, folder: str | None = None) -> DataFrame:
    """Rows whose title, description or one of whose tags contains ``term`` in any case, in ``folder`` if given; an empty term holds for all."""
    t = F.lit(term.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), t), F.lit(False))
    kept = rows.where(has(F.col("title")) | has(F.col("description")) | F.coalesce(F.exists("tags", lambda x: F.contains(F.lower(x), t)), F.lit(False)))
    return kept.where(F.col("folder") == folder) if folder is not None else kept


def toggled(rows: DataFrame, key: str, which: Column, flag: str = "starred") -> DataFrame:
    """``rows`` with the flag turned where ``which`` holds."""
    return rows.withColumn(flag, F.when(F.coalesce(which, F.lit(False)), ~F.col(flag)).otherwise(F.col(flag)))


def hinted(addresses: Column, hint: str | None) -> Column:
    """Addresses that contain ``hint``, all for none."""
    return F.filter(addresses, lambda a: F.contains(a, F.lit(hint))) if hint else addresses


def relevance(text: Column, title: Column, query: str, lens: str, headers: Column | None = None, tables: Column | None = None) -> Column:
    """0 to 100: 5 a match of a query word in the text, 20 a word that the title contains, and what the lens looks for; words are taken literally.

    NULL texts and titles count as empty; a NULL list has no element.
    """
    low, t = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    score = F.lit(0)
    for w in query.lower().split():
        score = score + 5 * F.regexp_count(low, F.lit(re.escape(w))) + F.when(t.contains(w), 20).otherwise(0)
    e = entities(F.coalesce(text, F.lit("")))
    some = lambda c, n: F.when(F.size(c) > 0, n).otherwise(0)
    if lens == "procurement":
        score = score + some(e["dates"], 15) + some(e["money"], 15) + F.when(any_of(low, ["rfp", "solicitation"]), 30).otherwise(0)
    elif lens == "pricing":
        score = score + some(e["money"], 25) + F.when(any_of(low, ["fee", "price", "rate"]), 20).otherwise(0)
    elif lens == "provider":
        score = score + some(e["phones"], 15) + some(e["emails"], 10) + F.when(any_of(low, ["clinic", "provider"]), 20).otherwise(0)
    if headers is not None:
        score = score + F.when(F.coalesce(F.size(headers), F.lit(0)) > 3, 10).otherwise(0)
    if tables is not None:
        score = score + F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, 15).otherwise(0)
    return F.least(F.lit(100), score)


def text_structure(text: Column, kind: str) -> Column:
    """STRUCT<title, headers, paragraphs> of the text of a 'pdf' or 'docx' file: the first line that isn't blank, lines of a heading's form, and the lines run together if they are longer than 50 (30) characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    forms = [r"^[A-Z][A-Z\s]{10,}$", r"^\d+\.\s+[A-Z]"] if kind == "pdf" else [r"^[A-Z][A-Z\s]{8,}$", r"^\d+\.\s+[A-Z]"]
    heading = lambda x: F.lit(False)
    chapter = r"^(?:Chapter|Section|Part)\s+\d+"
    heads = F.filter(lines, lambda x: (found(x, chapter) if kind == "pdf" else heading(x)) | x.rlike(forms[0]) | x.rlike(forms[1]))
    run = F.concat(F.array_join(lines, " "), F.lit(" "))
    least = 50 if kind == "pdf" else 30
    paragraphs = F.when((F.size(lines) > 0) & (F.length(run) > least), F.array(F.trim(run))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.trim(F.get(lines, F.lit(0))).alias("title"), F.transform(heads, lambda x: F.trim(x)).alias("headers"), paragraphs.alias("paragraphs"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def vector_literal(vector: Column) -> Column:
    """``[1.0,2.5]``."""
    return F.to_json(vector)


def parsed_vector(literal: Column) -> Column:
    """ARRAY<DOUBLE> of a literal, NULL for what is none."""
    return F.from_json(literal, "array<double>")


def relative_date(at: Column, now: Column) -> Column:
    """Today, Yesterday, days, weeks (under 30 days) or months ago; NULL for NULL."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000))
    ago = lambda n, unit: F.concat(F.floor(days / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, ago(1, "days")).when(days < 30, ago(7, "weeks")).when(days.isNotNull(), ago(30, "months"))


def feed_time(said: Column, now: Column) -> Column:
    """The instant that a feed's date states (RFC 822 or ISO 8601), else ``now``."""
    zone = F.regexp_replace(F.trim(said), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(zone, r"\b(GMT|UT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.trim(said)), now)


def leading_integer(text: Column) -> Column:
    """BIGINT of the digits that a text begins with, a sign and spaces before allowed; NULL for none or too many."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def crawl_state(status: Column) -> Column:
    return F.when(status == "success", "active").when(status.isin("blocked", "empty"), status).when(status.isin("failed", "unavailable"), "failed").otherwise("experimental")


def opportunity_kind(title: Column) -> Column:
    return F.when(found(title, "rfp"), "RFP").when(found(title, "rfq"), "RFQ").when(found(title, "solicitation"), "solicitation").otherwise("procurement")
