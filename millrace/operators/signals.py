"""Signals in texts and URLs, what they add up to, and lens boosts of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import any_of, found

# Fixed values: (name, score, scope, pattern); patterns on texts match in any case, the first three on URLs as written.
SIGNALS = [
    (".gov domain", 35, "url", r"\.gov\b"),
    (".edu domain", 30, "url", r"\.edu\b"),
    (".org domain", 15, "url", r"\.org\b"),
    ("procurement portal", 30, "url", r"(?i)sam\.gov|bonfire|planetbids|ionwave|bidnet"),
    ("procurement language", 40, "text", r"RFP|solicitation|bid|tender|procurement|RFQ|RFT"),
    ("PDF document", 40, "text", r"filetype:pdf|\.pdf"),
    ("includes deadline", 25, "text", r"due date|deadline|closing date|responses due|submission deadline"),
    ("active opportunity", 30, "text", r"open|active|current|accepting proposals|bid opportunity"),
    ("hidden goldmine terms", 35, "text", r"notice inviting bids|request for qualifications|competitive sealed proposal"),
    ("2026 active", 20, "text", r"2026"),
    ("pricing document", 40, "text", r"fee schedule|price list|rate card|fee structure|chargemaster"),
    ("monetary values", 25, "text", r"\$[\d,]"),
    ("self-pay mention", 30, "text", r"self-pay|cash price|out-of-pocket|cash pay"),
    ("employer payment", 25, "text", r"employer account|work comp|workers compensation"),
    ("occupational health match", 25, "text", r"occupational health|occupational medicine|worksite clinic|employee health"),
    ("DOT physical", 20, "text", r"DOT physical|CDL physical|department of transportation"),
    ("PFT pricing", 20, "text", r"spirometry|pulmonary function|PFT"),
    ("occupational services", 25, "text", r"drug testing|pre-employment physical|audiometry|respirator fit test"),
    ("provider entity", 30, "text", r"clinic|medical center|health center|practice|facility"),
    ("provider keywords", 25, "text", r"physician|doctor|provider|clinician|medical group"),
    ("credentials", 20, "text", r"board certified|licensed|accredited"),
    ("physical address", 15, "text", r"location|address|suite|floor"),
    ("suspicious content", -40, "text", r"spam|scam|fake|unverified"),
    ("archived page", -25, "url", r"(?i)archive\.org|wayback|cached"),
    ("junk directory", -20, "url", r"(?i)directory|list|index|catalog"),
    ("page error", -30, "text", r"404|not found|error|unavailable"),
]
PROCUREMENT_TERMS = ["rfp", "rfq", "ifb", "bid", "solicitation", "proposal", "due date", "addendum", "tender", "procurement"]
HEALTH_TERMS = ["occupational health", "occupational medicine", "employee health", "dot physical", "pft", "pulmonary function", "drug screen", "fit test", "audiogram"]
JUNK = ["directory", "listing", "aggregator", "portal", "marketplace"]


def signals(text: Column, url: Column | None = None) -> Column:
    """ARRAY<STRUCT<name, score>> of the rules that hold, in their order; without ``url`` its rules are left out."""
    out = []
    for name, score, scope, pattern in SIGNALS:
        if scope == "url" and url is None:
            continue
        hit = F.coalesce(url.rlike(pattern), F.lit(False)) if scope == "url" else found(text, pattern)
        out.append(F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(score).alias("score"))))
    return F.array_compact(F.array(*out))


def confidence(scores: Column) -> Column:
    """40 more than the sum, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.coalesce(scores, F.lit(0)) + 40, F.lit(100))).cast("int")


def intelligence(rows: DataFrame, text: str, order: str, url: str | None = None) -> DataFrame:
    """One row (n_signals, confidence, summary): each signal once over all texts, by first text and rule; the summary names the first three positive ones.

    Reduced to at most one row a signal and task before anything moves.
    """
    each = rows.select(F.col(order).alias("o"), F.posexplode(signals(F.col(text), F.col(url) if url else None)).alias("pos", "s"))
    first = each.groupBy("s.name", "s.score").agg(F.min(F.struct("o", "pos")).alias("at"))
    made = first.agg(F.count(F.lit(1)).alias("n_signals"), F.sum("score").alias("total"), F.sort_array(F.collect_list(F.struct("at", "name", "score"))).alias("all"))
    positive = F.slice(F.transform(F.filter("all", lambda s: s["score"] > 0), lambda s: s["name"]), 1, 3)
    return made.select("n_signals", confidence(F.col("total")).alias("confidence"), F.when(F.size(positive) > 0, F.array_join(positive, ", ")).otherwise("general content").alias("summary"))


def lens_boost(lens: str, domain: Column, url: Column, title: Column, description: Column) -> Column:
    """Points that a result row gains or loses under ``lens``; NULL columns count as empty."""
    d, u, t, s = (F.lower(F.coalesce(c, F.lit(""))) for c in (domain, url, title, description))
    boost = F.lit(0)
    if lens in ("government", "procurement", "pdf"):
        boost = boost + F.when(d.endswith(".gov"), 50).otherwise(0) + F.when(d.endswith(".us") | any_of(d, [".gov.", "county", "city", "state"]), 30).otherwise(0)
        boost = boost + F.when(u.endswith(".pdf"), 40).otherwise(0) + F.when(any_of(t, PROCUREMENT_TERMS) | any_of(s, PROCUREMENT_TERMS), 25).otherwise(0)
    if lens in ("procurement", "pricing", "provider"):
        boost = boost + F.when(any_of(t, HEALTH_TERMS) | any_of(s, HEALTH_TERMS), 20).otherwise(0)
    return boost - F.when(any_of(d, JUNK) & ~d.contains(".gov"), 20).otherwise(0)
