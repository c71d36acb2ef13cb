"""URL expressions and scores of URLs and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import any_of, found

# Substrings and endings that the scores look for.
TRACKERS = [
    "google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.com/tr", "pixel.facebook.com", "connect.facebook.net", "analytics.twitter.com", "t.co", "analytics.yahoo.com",
    "pixel.quantserve.com", "scorecardresearch.com", "c.amazon-adsystem.com", "ad.doubleclick.net", "adsystem.google.com", "pagead2.googlesyndication.com",
]
AFFILIATE = r"ref=|affiliate|utm_source=|utm_medium=|utm_campaign=|aff_id=|affiliate_id=|partner=|referral|click\.track|tracking"
SLOP_HOSTS = ["medium.com", "substack.com"]
SPAM_ENDINGS = [".xyz", ".top", ".zip", ".mov", ".mp4"]
TRUSTED = ["wikipedia.org", "github.com", "stackoverflow.com", "reddit.com", ".gov", ".edu", ".org"]
SALES = ["buy now", "click here", "limited time", "act now", "don't miss", "exclusive deal"]


def host(url: Column) -> Column:
    """Lower-case host, NULL for what is no URL."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain(url: Column) -> Column:
    """Host without a leading ``www.``; '' for what is no URL."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def parameters(url: Column) -> Column:
    """Number of query parameters."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.size(F.filter(F.split(query, "&"), lambda p: p != ""))


def encode_component(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def unwrap_redirect(href: Column) -> Column:
    """Target of a ``/url?q=`` redirect, percent-decoded; other links unchanged."""
    target = F.nullif(F.regexp_extract(href, r"^/url\?(?:[^#]*&)?q=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), href)


def url_penalties(url: Column) -> list[tuple[str, float, Column]]:
    """(reason, weight, condition) in the order of the reasons."""
    h = host(url)
    valid = h.isNotNull()
    return [
        ("tracker detected", 0.5, valid & (any_of(h, TRACKERS) | any_of(url, TRACKERS))),
        ("affiliate link detected", 1.0, valid & found(url, AFFILIATE)),
        ("potential AI slop domain", 2.0, valid & any_of(h, SLOP_HOSTS)),
        ("spammy TLD", 1.0, valid & F.coalesce(h.rlike("(" + "|".join(x.replace(".", r"\.") for x in SPAM_ENDINGS) + ")$"), F.lit(False))),
        ("excessive tracking parameters", 0.5, valid & (parameters(url) > 5)),
        ("suspiciously long URL", 0.5, valid & (F.length(url) > 200)),
        ("invalid URL", 3.0, ~valid),
    ]


def content_penalties(content: Column) -> list[tuple[str, float, Column]]:
    words = F.split(F.lower(content), r"[\s ﻿]+", -1)
    sales = sum((found(content, s).cast("int") for s in SALES), F.lit(0))
    return [
        ("low content uniqueness", 1.0, F.size(F.array_distinct(words)) / F.size(words) < 0.3),
        ("keyword stuffing detected", 1.0, sales > 3),
        ("very short content", 0.5, F.length(content) < 100),
    ]


def total(parts: list[tuple[str, float, Column]]) -> Column:
    return sum((F.when(c, w).otherwise(0.0) for _, w, c in parts), F.lit(0.0))


def reasons(parts: list[tuple[str, float, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, _, c in parts]))


def trust(h: Column) -> Column:
    """0.5, more for well-known hosts, less for ones that begin with a number, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.when(any_of(h, TRUSTED), 0.3).otherwise(0.0) - F.when(F.coalesce(h.rlike(r"^\d+\."), F.lit(False)), 0.2).otherwise(0.0)))


def combined_spam(url: Column, content: Column | None = None) -> Column:
    """URL and content penalties, cut by up to a half by trust; an invalid URL's penalty isn't cut."""
    parts = url_penalties(url)
    raw = total(parts) + (F.when(F.coalesce(content, F.lit("")) != "", total(content_penalties(content))).otherwise(0.0) if content is not None else F.lit(0.0))
    return F.when(host(url).isNull(), raw).otherwise(raw * (1 - trust(host(url)) * 0.5))
