"""Typed records and contacts out of free text, by tables of fields that become column expressions.

A lens's table says how a record's kind is told, where each field is found and which signals raise its confidence; ``record``
compiles it to one struct of regular expressions, so nothing leaves the JVM. Patterns whose first part can begin at any
letter of a run are anchored to the run's start (``RUN``) or to a word's (``WORD``), which finds the same match and keeps the cost
linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import first_match, found

#: Before a pattern that begins with letters and spaces, or with a word: it can only match from the start of such.
RUN = r"(?:^|[^a-zA-Z\s])\s*"
WORD = r"(?<![a-zA-Z])(?<![a-zA-Z]{2}\s{1,20})"

# Patterns, matched in any case, with the kinds and labels that they stand for; bases and steps of confidence.
PHONE_LABELLED = r"(?:phone|tel|call|contact|telephone)[:\s]*(\+?1?[\d\s\-\(\)]{10,})"
PHONE_BARE = r"(\+?1?[\d\s\-\(\)]{10,})"
LONG_DATE = r"([A-Z][a-z]+ \d{1,2},?\s+\d{4})"
SLASHED = r"(\d{1,2}\/\d{1,2}\/\d{4})"
PAYERS = {
    "self": r"self-pay|cash pay|out-of-pocket|private pay",
    "employer": r"employer|work comp|workers compensation|workers' comp",
    "insurance": r"insurance|in-network|blue cross|aetna|cigna|united",
}
KINDS = {
    "procurement": [
        ("RFP", r"rfp|request for proposal|request for proposals"),
        ("RFQ", r"rfq|request for quotation|request for quote"),
        ("RFT", r"rft|request for tender|request for tenders"),
        ("solicitation", r"solicitation|solicitations"),
        ("bid", r"bid|bidding|invitation to bid|itb"),
        ("tender", r"tender|tendering"),
        ("procurement", r"procurement|contract"),
        ("RFQ", r"quote|quotation"),
        ("RFP", r"proposal|proposals"),
    ],
    "pricing": [
        ("PFT", r"pft|spirometry|pulmonary function|lung function"),
        ("DOT", r"dot physical|cdl physical|department of transportation"),
        ("physical", r"physical exam|pre-employment|pre employment"),
        ("drug test", r"drug test|drug screening|drug screen|substance abuse"),
        ("audiometry", r"audiometry|hearing test|hearing screening"),
        ("respirator", r"respirator|fit test|respiratory protection"),
        ("vaccination", r"vaccination|immunization|flu shot"),
        ("x-ray", r"x-ray|radiology|imaging"),
        ("lab", r"lab|laboratory|blood work"),
    ],
    "legal": [
        ("case law", r"court|ruling|judgment|decision|case law|v\.|vs\.|plaintiff|defendant"),
        ("statute", r"statute|act|bill|legislation|code|\d+\s+U\.S\.C\.|§\s+\d+"),
        ("regulation", r"regulation|rule|compliance|requirement|standard"),
        ("compliance", r"compliance|adhere|requirement|mandate"),
    ],
    "medical": [
        ("research", r"clinical trial|study|research|investigation|nct\d+"),
        ("clinical", r"clinical|treatment|therapy|intervention|procedure"),
        ("diagnosis", r"diagnosis|diagnostic|screening|test"),
        ("treatment", r"treatment|therapy|medication|drug"),
    ],
    "academic": [
        ("journal", r"journal|article|paper", r"doi\.org"),
        ("conference", r"conference|proceedings|symposium"),
        ("thesis", r"thesis|dissertation|doctoral"),
        ("preprint", r"preprint|arxiv|bioRxiv|medRxiv", r"arxiv\.org"),
    ],
    "financial": [
        ("earnings", r"earnings|revenue|profit|income statement|q\d+|fiscal"),
        ("report", r"financial report|annual report|10-k|10-q"),
        ("market", r"market|stock|trading|equity|share"),
        ("economic", r"economic|gdp|inflation|unemployment|federal reserve"),
    ],
}
STATUS = [
    ("open", r"open|active|current|accepting proposals|accepting bids"),
    ("closed", r"closed|awarded|expired|complete|withdrawn"),
    ("active", r"pending|under review|evaluation"),
]
SERVICES = [
    ("occupational health", r"occupational health|occupational medicine|occ health"),
    ("DOT physical", r"dot physical|cdl physical|department of transportation"),
    ("drug testing", r"drug test|drug screening|drug screen|substance abuse"),
    ("PFT", r"pft|spirometry|pulmonary function|lung function"),
    ("audiometry", r"audiometry|hearing test|hearing screening"),
    ("respirator fit test", r"respirator|fit test|respiratory protection"),
    ("physical exams", r"physical exam|pre-employment|pre employment"),
    ("vaccinations", r"vaccination|immunization|flu shot|tb test"),
    ("x-ray services", r"x-ray|radiology|imaging"),
    ("laboratory services", r"lab|laboratory|blood work"),
]
CREDENTIALS = [
    ("Board Certified", r"board certified|board-certified"),
    ("Licensed", r"licensed|licensure"),
    ("Accredited", r"accredited|accreditation"),
    ("Certified", r"certified|certification"),
    ("Fellow", r"fellow|fellowship"),
]
CONFIDENCE = {"procurement": (35, 8), "provider": (35, 8), "pricing": (35, 8), "legal": (40, 10), "medical": (40, 10), "academic": (35, 8), "financial": (40, 10)}
LENSES = list(CONFIDENCE)


class _Page:
    """The text, url and title of a page as columns, and ways to look for fields in them; NULLs count as empty."""

    def __init__(self, text: Column, url: Column, title: Column):
        self.text, self.url, self.title = (F.coalesce(c, F.lit("")) for c in (text, url, title))

    def first(self, *patterns: str, group: int = 1, title: bool = False) -> Column:
        """First match of the first pattern that has any, in the text and then, with ``title``, in the title; trimmed, NULL if none."""
        tries = [(c, p, group) for p in patterns for c in ((self.text, self.title) if title else (self.text,))]
        return F.nullif(F.trim(first_match(tries)), F.lit(""))

    def phone(self) -> Column:
        return F.nullif(F.regexp_replace(first_match([(self.text, PHONE_LABELLED, 1), (self.text, PHONE_BARE, 1)]), r"[\s\-\(\)]", ""), F.lit(""))

    def has(self, pattern: str) -> Column:
        return found(self.text, pattern)

    def kind(self, lens: str, title: bool = False) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern, *on_url in reversed(KINDS[lens]):
            hit = self.has(pattern) | found(self.title, pattern) if title else self.has(pattern)
            out = F.when(hit | found(self.url, on_url[0]) if on_url else hit, name).otherwise(out)
        return out

    def labels(self, table: list[tuple[str, str]]) -> Column:
        return F.array_compact(F.array(*[F.when(self.has(p), name) for name, p in table]))

    def words_of_title(self, n: int) -> Column:
        return F.array_join(F.slice(F.split(self.title, r"\s+"), 1, n), " ")


def _dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), c)


def _procurement(p: _Page) -> tuple[dict, list]:
    bodies = "County|City|State|Department|Agency|District|Bureau|Office|Authority|Commission"
    kinds = "services?|health|medicine|clinic|care|support|management|consulting"
    status = F.lit("unknown")
    for name, pattern in reversed(STATUS):
        status = F.when(p.has(pattern), name).otherwise(status)
    f = {
        "kind": p.kind("procurement", title=True),
        "organization": F.coalesce(p.first(rf"(?:{bodies})\s+(?:of|for)\s+([A-Z][a-zA-Z\s]+)", RUN + rf"([A-Z][a-zA-Z\s]+(?:{bodies}))", r"(?:Department|Agency|Office)\s+of\s+([A-Z][a-zA-Z\s]+)", title=True), p.words_of_title(3)),
        "service": F.coalesce(p.first(rf"(?:for|providing|offering|services?|contract for)\s+([a-zA-Z\s]+(?:{kinds}))", RUN + r"([a-zA-Z\s]+(?:Health|Medicine|Services|Care|Support|Management|Consulting))", title=True), F.lit("professional services")),
        "due_date": p.first(r"(?:due date|deadline|closing|responses due|submission deadline|response due)[:\s]+" + LONG_DATE, r"(?:due|deadline|closing)[:\s]+" + SLASHED, r"(?:due|deadline)[:\s]+(\d{4}-\d{2}-\d{2})", r"(?:due|deadline)[:\s]+(\d{1,2}\s+[A-Z][a-z]+,\s+\d{4})"),
        "email": p.first(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", group=0),
        "phone": p.phone(),
        "amount": p.first(r"\$[\d,]+(?:\.\d{2})?", r"\$\d+\s*(?:million|billion|k|K|M|B)", r"(?:estimated|approx|about|up to)\s*\$[\d,]+", group=0),
        "posted_date": p.first(r"(?:posted|published|date|created|issued)[:\s]+" + LONG_DATE, r"(?:posted|published|date)[:\s]+" + SLASHED, r"(?:posted|published|date)[:\s]+(\d{4}-\d{2}-\d{2})"),
        "status": status,
    }
    return f, [
        ("procurement language", lambda r: r["kind"].isNotNull()), (".gov domain", found(p.url, r"\.gov")), ("procurement portal", found(p.url, r"sam\.gov|bonfire|planetbids|ionwave|bidnet|governmentbids|rfpdb")),
        ("includes deadline", lambda r: r["due_date"].isNotNull()), ("monetary value", lambda r: r["amount"].isNotNull()), ("active opportunity", lambda r: r["status"] == "open"), ("contact email", lambda r: r["email"].isNotNull()), ("contact phone", lambda r: r["phone"].isNotNull()),
    ]


def _provider(p: _Page) -> tuple[dict, list]:
    # as fixed: a number and words, then state and code, with and without a comma, and words alone; runs of words are possessive, so that long ones need no stack
    words = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)++"
    address = p.first(rf"(\d+\s+{words},\s+[A-Z]{{2}}\s+\d{{5}})", r"(\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+(?=\s+[A-Z]))++\s+[A-Z]{2}\s+\d{5})", rf"{WORD}({words},\s+[A-Z]{{2}}\s+\d{{5}})")
    parts = F.split(address, ", ")
    street, rest, cut = F.get(parts, F.lit(0)), F.trim(F.get(parts, F.lit(1))), F.size(parts) >= 2
    f = {
        "name": F.coalesce(p.first(RUN + r"([A-Z][a-zA-Z\s]+(?:Clinic|Center|Health|Medicine|Medical|Occupational|Wellness|Care))", r"(?:provider|clinic|facility|practice|hospital)[:\s]+([A-Z][a-zA-Z\s]+)", RUN + r"([A-Z][a-zA-Z\s]+(?:Associates|Group|Partners))", title=True), p.words_of_title(2)),
        "address": address,
        "city": F.when(cut, F.coalesce(F.nullif(F.trim(F.get(F.split(street, r"\d+"), F.lit(1))), F.lit("")), street)),
        "state": F.when(cut, F.nullif(F.regexp_extract(rest, r"^([A-Z]{2})", 1), F.lit(""))),
        "zip": F.when(cut, F.nullif(F.regexp_extract(rest, r"(\d{5})", 1), F.lit(""))),
        "phone": p.phone(),
        "services": p.labels(SERVICES),
        "credentials": p.labels(CREDENTIALS),
        "accepts_self_pay": p.has(PAYERS["self"]),
        "accepts_employer": p.has(PAYERS["employer"]),
        "accepts_insurance": p.has(PAYERS["insurance"]),
    }
    return f, [
        ("physical address", lambda r: r["address"].isNotNull()), ("contact information", lambda r: r["phone"].isNotNull()), ("occupational services", lambda r: F.size(r["services"]) > 0),
        ("credentials", lambda r: F.size(r["credentials"]) > 0), ("accepts insurance", lambda r: r["accepts_insurance"]),
    ]


def _pricing(p: _Page) -> tuple[dict, list]:
    dash, words = r"\$([\d,]+)\s*-\s*\$([\d,]+)", r"(?:from|between)\s*\$([\d,]+)\s*(?:and|to)\s*\$([\d,]+)"
    low, high = p.first(dash, words, group=1), p.first(dash, words, group=2)
    cash = r"self-pay|cash|out-of-pocket|private pay"
    kind = p.kind("pricing")
    f = {
        "kind": kind,
        "name": F.coalesce(p.first(RUN + r"([A-Z][a-zA-Z\s]+(?:Clinic|Center|Health|Medicine|Medical))", r"(?:provider|clinic|facility|practice)[:\s]+([A-Z][a-zA-Z\s]+)", title=True), p.words_of_title(2)),
        "service": F.coalesce(F.concat(kind, F.lit(" testing")), F.lit("occupational health services")),
        "price_cash": _dollars(p.first(rf"(?:{cash})[:\s]*\$?([\d,]+(?:\.\d{{2}})?)", r"\$([\d,]+(?:\.\d{2})?)\s*(?:self-pay|cash|out-of-pocket)")),
        "price_employer": _dollars(p.first(r"(?:employer|work comp|workers comp|workers' comp)[:\s]*\$?([\d,]+(?:\.\d{2})?)", r"\$([\d,]+(?:\.\d{2})?)\s*(?:employer|work comp)")),
        "price_range": F.concat(_dollars(low), F.lit(" - "), _dollars(high)),
        "payment_types": F.concat(*[F.when(p.has(x), F.array(*map(F.lit, said))).otherwise(F.array().cast("array<string>")) for x, said in ((cash, ("self-pay", "cash")), (PAYERS["employer"], ("employer", "work comp")), (PAYERS["insurance"], ("insurance",)))]),
    }
    return f, [("self-pay mention", lambda r: r["price_cash"].isNotNull()), ("employer payment", lambda r: r["price_employer"].isNotNull()), ("service category", lambda r: r["kind"].isNotNull()), ("pricing document", p.has(r"fee schedule|price list|rate card|pricing"))]


def _legal(p: _Page) -> tuple[dict, list]:
    f = {
        "kind": p.kind("legal"),
        "case_name": p.first(r"(?:^|[^a-zA-Z\s&])[\s&]*([A-Z][a-zA-Z\s&]+(?:v\.|vs\.|versus)[A-Z][a-zA-Z\s&]+)", title=True),
        "court": p.first(r"(?:Court of|Supreme Court|District Court|Circuit Court|Appellate Court)\s+(?:the\s+)?([A-Z][a-zA-Z\s]+)"),
        "jurisdiction": p.first(r"(?:Jurisdiction|State|Federal|Circuit)\s*[:\s]+([A-Z][a-zA-Z\s]+)"),
        "citation": p.first(r"\d+\s+F\.\d+|\d+\s+U\.S\.\s+\d+|\d+\s+S\.Ct\.\s+\d+", group=0),
        "decision_date": p.first(r"(?:Decided|Decision Date|Date)\s*[:\s]+" + LONG_DATE, SLASHED),
        "statute_name": p.first(r"(?:Act|Statute|Code)\s+(?:of\s+)?([A-Z][a-zA-Z\s]+)"),
        "regulation_number": p.first(r"(?:Regulation|Rule|CFR)\s*[:\s]+(\d+\s+CFR\s+\d+\.?\d*)"),
    }
    return f, [("case name", lambda r: r["case_name"].isNotNull()), ("citation", lambda r: r["citation"].isNotNull()), ("court", lambda r: r["court"].isNotNull()), ("legal type", lambda r: r["kind"].isNotNull())]


def _medical(p: _Page) -> tuple[dict, list]:
    f = {
        "kind": p.kind("medical"),
        "condition": F.coalesce(p.first(r"(?:condition|disease|disorder|syndrome)\s*[:\s]+([A-Z][a-zA-Z\s]+)"), F.nullif(F.trim(first_match([(p.title, RUN + r"([A-Z][a-zA-Z\s]+(?:Disease|Disorder|Syndrome|Condition))", 1)])), F.lit(""))),
        "treatment": p.first(r"(?:treatment|therapy)\s*(?:for|of)\s+([a-zA-Z\s]+)"),
        "diagnosis": p.first(r"(?:diagnosis|diagnosed as)\s*[:\s]+([a-zA-Z\s]+)"),
        "study_type": p.first(r"(?:study type|design)\s*[:\s]+([a-zA-Z\s]+)"),
        "trial_id": p.first(r"NCT\d+", group=0),
        "publication_date": p.first(r"(?:Published|Publication Date)\s*[:\s]+" + LONG_DATE, SLASHED),
    }
    return f, [("condition", lambda r: r["condition"].isNotNull()), ("clinical trial ID", lambda r: r["trial_id"].isNotNull()), ("medical type", lambda r: r["kind"].isNotNull()), ("academic source", found(p.url, r"\.edu\b")), ("government source", found(p.url, r"\.gov\b"))]


def _academic(p: _Page) -> tuple[dict, list]:
    authors = p.first(r"(?:Authors?|By)\s*[:\s]+([A-Z][a-zA-Z\s,]+)")
    f = {
        "kind": p.kind("academic"),
        "paper_title": p.title,
        "authors": F.transform(F.split(authors, ","), lambda x: F.trim(x)),
        "journal": p.first(r"(?:Journal|Published in)\s*[:\s]+([A-Z][a-zA-Z\s]+)"),
        "publication_date": p.first(r"(?:Published|Date|Publication)[:\s]+" + LONG_DATE),
        "doi": F.coalesce(p.first(r"doi[:\s]+(10\.\d+\/[^\s]+)"), F.nullif(F.regexp_extract(p.url, r"doi\.org\/(10\.\d+\/[^\s]+)", 1), F.lit(""))),
        "citations": p.first(r"(?:citations|cited by)[:\s]+(\d+)").try_cast("bigint"),
        "abstract": p.first(r"(?:Abstract|Summary)[:\s]+([^.]+\.)"),
    }
    return f, [("academic type detected", lambda r: r["kind"].isNotNull()), ("DOI present", lambda r: r["doi"].isNotNull()), ("authors listed", lambda r: r["authors"].isNotNull()), ("journal specified", lambda r: r["journal"].isNotNull()), ("publication date", lambda r: r["publication_date"].isNotNull())]


def _financial(p: _Page) -> tuple[dict, list]:
    marks = r"\(([A-Z]{1,5})\)|NYSE:\s*([A-Z]{1,5})|NASDAQ:\s*([A-Z]{1,5})"
    f = {
        "kind": p.kind("financial"),
        "company": F.coalesce(p.first(r"(?:Company|Corporation|Inc\.|LLC)\s*[:\s]+([A-Z][a-zA-Z\s]+)"), F.nullif(F.trim(first_match([(p.title, RUN + r"([A-Z][a-zA-Z\s]+(?:Inc\.|LLC|Corporation|Company))", 1)])), F.lit(""))),
        "ticker": F.coalesce(*[p.first(marks, group=i) for i in (1, 2, 3)]),
        "report_type": p.first(r"(?:Report Type|Form)\s*[:\s]+([A-Z0-9-]+)"),
        "period": p.first(r"(?:Period|Quarter|Fiscal Year)\s*[:\s]+([A-Z0-9\s]+)"),
        "revenue": _dollars(p.first(r"(?:Revenue|Total Revenue)\s*[:\s]?\$?([\d,]+(?:\.\d{2})?)")),
        "profit": _dollars(p.first(r"(?:Profit|Net Income|Earnings)\s*[:\s]?\$?([\d,]+(?:\.\d{2})?)")),
        "eps": _dollars(p.first(r"(?:EPS|Earnings Per Share)\s*[:\s]?\$?([\d.]+)")),
    }
    return f, [("company name", lambda r: r["company"].isNotNull()), ("ticker", lambda r: r["ticker"].isNotNull()), ("revenue", lambda r: r["revenue"].isNotNull()), ("financial type", lambda r: r["kind"].isNotNull()), ("government source", found(p.url, r"\.gov\b"))]


_MAKERS = {"procurement": _procurement, "provider": _provider, "pricing": _pricing, "legal": _legal, "medical": _medical, "academic": _academic, "financial": _financial}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[-. ]?)?(?:\(\d{3}\) ?|\d{3}[-. ])?\d{3}[-. ]\d{4}"
WEBSITE = r"https?://(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:/[a-zA-Z0-9._~:/?#@!$&'()*+,;=\[\]-]*)?"
DATE = r"\d{1,2}/\d{1,2}/\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}"
MONEY = r"\$[\d,]+(?:\.\d{2})?"
FAX = r"(?i)fax(?: no\.)?(?: is)?[:\s]+([\d() .-]{7,})"
LINKEDIN = r"(?i)linkedin\.com/(?:in|company)/[a-zA-Z0-9_-]+"


def record(lens: str, text: Column, url: Column, title: Column) -> Column:
    """STRUCT of a lens's fields (trimmed, NULL if absent), ``signals`` (names of those that hold, in order) and ``confidence``, which each signal raises up to 95."""
    fields, signals = _MAKERS[lens](_Page(text, url, title))
    base, step = CONFIDENCE[lens]

    def finished(r: Column) -> Column:
        named = F.array_compact(F.array(*[F.when(on(r) if callable(on) and not isinstance(on, Column) else on, name) for name, on in signals]))
        return F.struct(*[r[n].alias(n) for n in fields], named.alias("signals"), F.least(F.lit(95), base + step * F.size(named)).alias("confidence"))

    # the fields are found once, though signals and confidence name them again
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])), finished), F.lit(0))


def route(lens: Column, text: Column, url: Column, title: Column) -> Column:
    """STRUCT with one record a lens, all NULL but that of the row's lens."""
    return F.struct(*[F.when(lens == x, record(x, text, url, title)).alias(x) for x in LENSES])


def entities(text: Column) -> Column:
    """STRUCT of distinct emails, phones, urls, dates and money amounts, in order of first occurrence."""
    find = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.struct(find(EMAIL).alias("emails"), find(PHONE).alias("phones"), find(WEBSITE).alias("urls"), find(DATE).alias("dates"), find(MONEY).alias("money"))


def contacts(text: Column) -> Column:
    """ARRAY<STRUCT<type, value, label, confidence>>: emails (no pictures, no test hosts), phones, faxes, LinkedIn pages, websites; confidence falls with place."""

    def rows(kind: str, values: Column, label: str, base: int, floor: int) -> Column:
        return F.transform(F.array_distinct(values), lambda v, i: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.when(i == 0, f"Primary {label}").otherwise(F.concat(F.lit(f"{label} "), (i + 1).cast("string"))).alias("label"), F.greatest(F.lit(floor), base - 8 * i).alias("confidence")))

    find = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    mail = F.filter(F.transform(find(EMAIL), lambda e: F.lower(e)), lambda e: ~e.rlike(r"\.(png|jpg|gif)$|@(example|test)\.com$"))
    return F.concat(
        rows("email", mail, "Email", 95, 50), rows("phone", find(PHONE), "Phone", 90, 45), rows("fax", F.transform(find(FAX, 1), lambda x: F.trim(x)), "Fax", 85, 40),
        rows("linkedin", F.transform(find(LINKEDIN), lambda x: F.concat(F.lit("https://www."), x)), "LinkedIn", 85, 40), rows("website", find(WEBSITE), "Website", 80, 40),
    )
