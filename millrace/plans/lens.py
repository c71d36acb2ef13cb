"""Query understanding: lenses, their keywords, synonyms, templates and operators, and what a query becomes under one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lenses in order; keywords; weighted words that must stand alone; site operators; expansion templates ({q} is the query); synonyms.
ORDER = [
    "web", "pdf", "government", "procurement", "pricing", "provider", "technical", "news", "legal", "medical", "academic", "financial",
]
KEYWORDS = {
    "pdf": [
        "pdf", "document", "file", "report", "guide", "manual",
    ],
    "government": [
        "government", "official", "federal", "state", "agency", "department", "county", "city", "municipal",
    ],
    "procurement": [
        "rfp", "bid", "solicitation", "procurement", "tender", "contract", "proposal", "rfq", "rft",
    ],
    "pricing": [
        "price", "cost", "fee", "rate", "schedule", "pricing", "charge", "cash pay", "self pay",
    ],
    "provider": [
        "clinic", "provider", "doctor", "physician", "healthcare", "medical", "practice", "occupational health", "occupational medicine",
    ],
    "technical": [
        "api", "documentation", "code", "developer", "github", "stack overflow", "programming",
    ],
    "news": [
        "news", "press", "article", "report", "breaking", "coverage",
    ],
    "legal": [
        "law", "legal", "statute", "regulation", "case law", "court", "ruling", "act", "bill", "legislation", "compliance",
    ],
    "medical": [
        "medical", "clinical", "healthcare", "study", "research", "treatment", "diagnosis", "therapy", "medicine", "health",
    ],
    "academic": [
        "paper", "research", "study", "journal", "publication", "scholarly", "academic", "thesis", "dissertation", "citation",
    ],
    "financial": [
        "financial", "finance", "market", "stock", "investment", "economy", "economic", "report", "earnings", "revenue", "profit",
    ],
}
BONUS = {
    "procurement": (5, [
        "rfp", "rfq", "tender", "solicitation", "procurement", "bid",
    ]),
    "pricing": (5, [
        "price", "cost", "fee", "rate", "pricing", "schedule",
    ]),
    "provider": (5, [
        "clinic", "provider", "doctor", "physician", "occupational health", "occupational medicine",
    ]),
    "pdf": (3, [
        "pdf", "document", "file", "report", "guide", "manual",
    ]),
    "government": (4, [
        "government", "official", "federal", "state", "agency",
    ]),
    "technical": (4, [
        "api", "documentation", "code", "developer", "github", "programming",
    ]),
    "news": (4, [
        "news", "press", "article", "coverage", "breaking",
    ]),
}
OPERATORS = {
    "pdf": [
        "filetype:pdf",
    ],
    "government": [
        "site:.gov", "site:.us",
    ],
    "procurement": [
        "site:.gov", "site:sam.gov", "site:ionwave.net", "site:bonfirehub.com", "site:planetbids.com", "site:bidnetdirect.com",
    ],
    "technical": [
        "site:github.com", "site:stackoverflow.com", "site:devdocs.io",
    ],
    "pricing": [
        "filetype:pdf",
    ],
    "legal": [
        "site:.gov",
    ],
    "medical": [
        "site:.edu", "site:.gov",
    ],
    "academic": [
        "site:.edu", "filetype:pdf",
    ],
    "financial": [
        "filetype:pdf",
    ],
}
TEMPLATES = {
    "web": [
        "{q} information", "{q} about", "{q} services", "{q} overview",
    ],
    "pdf": [
        "filetype:pdf {q}", "{q} pdf", "{q} document", "{q} report", "{q} guide",
    ],
    "government": [
        "site:.gov {q}", "site:.us {q}", "{q} government", "{q} official", "{q} agency", "{q} county", "{q} city", "{q} state", "{q} procurement",
        "{q} bid", "{q} RFP", "{q} solicitation", "occupational health site:.gov", "occupational medicine site:.gov",
    ],
    "procurement": [
        "{q} RFP", "{q} solicitation", "{q} bid", "{q} procurement", "{q} contract opportunity", "{q} vendor opportunity",
        "{q} professional services agreement", "{q} competitive sealed proposal", "site:.gov {q}", "site:sam.gov {q}", "site:ionwave.net {q}",
        "site:bonfirehub.com {q}", "site:bidnetdirect.com {q}", "site:planetbids.com {q}", "filetype:pdf {q}", "{q} filetype:pdf", "{q} 2026 open",
        "{q} 2026 active", "{q} 2026 solicitation currently open", "{q} bid opportunity 2026", "{q} due date 2026", "{q} responses due 2026",
        "{q} closing date 2026", "{q} notice inviting bids", "{q} request for qualifications", "{q} procurement opportunity",
        "{q} current opportunities",
    ],
    "technical": [
        "{q} api documentation", "{q} developer guide", "site:github.com {q}", "site:stackoverflow.com {q}", "{q} tutorial", "{q} code example",
    ],
    "news": [
        "{q} news", "{q} press release", "{q} article", "{q} coverage", "{q} latest",
    ],
    "pricing": [
        "{q} fee schedule", "{q} pricing", "{q} cost", "{q} rates", "{q} price list", "{q} fee structure", "{q} chargemaster", "filetype:pdf {q}",
        "{q} filetype:pdf", "{q} transparency file", "{q} self-pay pricing", "{q} cash pay", "{q} out-of-pocket cost", "{q} employer account",
        "{q} work comp", "{q} workers compensation", "{q} clinic", "{q} provider", "{q} urgent care", "{q} occupational medicine",
    ],
    "provider": [
        "{q} clinic", "{q} provider directory", "{q} medical practice", "{q} healthcare provider", "{q} physician", "{q} services offered",
        "{q} locations", "{q} occupational health services", "{q} DOT physical", "{q} drug testing", "{q} pre-employment physical",
        "{q} pulmonary function test", "{q} audiometry", "{q} respirator fit test", "{q} near me", "{q} locations", "{q} directory",
        "{q} clinic locations",
    ],
    "legal": [
        "{q} law", "{q} legal", "{q} statute", "{q} regulation", "{q} case law", "{q} court ruling", "{q} compliance", "site:.gov {q}",
    ],
    "medical": [
        "{q} medical", "{q} clinical study", "{q} research", "{q} treatment", "{q} diagnosis", "{q} therapy", "site:.edu {q}", "site:.gov {q}",
    ],
    "academic": [
        "{q} paper", "{q} research", "{q} study", "{q} journal", "{q} academic", "site:.edu {q}", "filetype:pdf {q}",
    ],
    "financial": [
        "{q} financial", "{q} market", "{q} investment", "{q} economic", "{q} report", "{q} earnings", "filetype:pdf {q}",
    ],
}
SYNONYMS = {
    "pdf": {
        "pdf": [
            "document", "file", "report", "guide", "manual", "whitepaper",
        ],
    },
    "government": {
        "government": [
            "federal", "state", "official", "agency", "department", "authority", "municipal", "county", "city",
        ],
    },
    "procurement": {
        "RFP": [
            "request for proposal", "solicitation", "bid", "tender", "procurement", "RFQ", "RFT", "request for qualifications",
        ],
        "occupational health": [
            "occupational medicine", "worksite clinic", "employee health", "industrial medicine", "pre-employment", "employer clinic",
        ],
        "services": [
            "contract", "agreement", "engagement", "arrangement", "professional services",
        ],
        "open": [
            "active", "current", "accepting proposals", "bid opportunity", "vendor opportunity",
        ],
    },
    "technical": {
        "api": [
            "interface", "endpoint", "rest", "graphql", "sdk",
        ],
        "documentation": [
            "docs", "guide", "reference", "manual", "tutorial",
        ],
        "code": [
            "source", "repository", "repo", "programming", "development",
        ],
    },
    "news": {
        "news": [
            "press", "article", "report", "coverage", "breaking",
        ],
    },
    "pricing": {
        "pricing": [
            "fee schedule", "cost", "rates", "charges", "fees", "price list", "rate card", "chargemaster",
        ],
        "occupational health": [
            "occupational medicine", "worksite clinic", "employee health", "industrial medicine", "pre-employment", "employer clinic",
        ],
        "PFT": [
            "spirometry", "pulmonary function test", "breathing test", "lung function",
        ],
        "DOT": [
            "department of transportation", "DOT physical", "DOT exam", "CDL physical",
        ],
        "physical": [
            "exam", "screening", "medical exam", "health screening", "pre-employment physical",
        ],
        "PDF": [
            "document", "fee schedule", "price list", "rate sheet", "transparency file",
        ],
        "occupational": [
            "worksite", "industrial", "employee", "corporate", "employer",
        ],
    },
    "provider": {
        "clinic": [
            "medical center", "health center", "practice", "facility", "office", "urgent care",
        ],
        "provider": [
            "doctor", "physician", "practitioner", "specialist", "clinician", "medical group",
        ],
        "occupational health": [
            "occupational medicine", "worksite clinic", "employee health", "industrial medicine", "pre-employment", "employer clinic",
        ],
        "services": [
            "exams", "screenings", "physicals", "testing", "drug testing", "DOT physical", "PFT",
        ],
    },
    "legal": {
        "legal": [
            "law", "statute", "regulation", "compliance", "legislation", "act", "bill",
        ],
        "case law": [
            "court ruling", "judicial decision", "precedent", "case",
        ],
        "regulation": [
            "rule", "compliance", "standard", "requirement",
        ],
    },
    "medical": {
        "medical": [
            "healthcare", "clinical", "medicine", "health",
        ],
        "study": [
            "research", "trial", "clinical trial", "investigation",
        ],
        "treatment": [
            "therapy", "intervention", "procedure",
        ],
    },
    "academic": {
        "paper": [
            "article", "publication", "journal", "research",
        ],
        "study": [
            "research", "investigation", "analysis",
        ],
        "academic": [
            "scholarly", "university", "research",
        ],
    },
    "financial": {
        "financial": [
            "finance", "economic", "monetary", "fiscal",
        ],
        "market": [
            "stock", "equity", "trading", "investment",
        ],
        "report": [
            "earnings", "revenue", "profit", "financial statement",
        ],
    },
}
PROCUREMENT_PLAN = [
    "{q}", "{q} RFP", "{q} RFQ", "{q} bid", "{q} solicitation", "{q} site:.gov", "{q} site:.us", "{q} PDF", "occupational health RFP",
    "occupational medicine bid", "occupational health services solicitation", "DOT physical pricing", "pulmonary function test pricing",
]
SUGGESTIONS = [
    ("{q} tutorial", "related", 0.95), ("{q} best practices", "related", 0.92), ("{q} documentation", "related", 0.9), ("{q} examples", "related", 0.88), ("what is {q}", "trending", 0.85),
    ("{q} vs alternatives", "trending", 0.82), ("how to use {q}", "related", 0.8), ("{q} getting started", "trending", 0.78),
]


def lens_scores(query: Column) -> dict[str, Column]:
    """Score of each lens for a query column: 1 for web, else 2 a keyword contained and the bonus of its stand-alone words."""
    q = F.lower(query)
    out: dict[str, Column] = {"web": F.lit(1)}
    for lens in ORDER[1:]:
        score = sum((q.contains(k).cast("int") * 2 for k in KEYWORDS[lens]), F.lit(0))
        if lens in BONUS:
            weight, alone = BONUS[lens]
            words = "|".join(alone)
            score = score + q.rlike(rf"(?<![0-9a-z_])({words})(?![0-9a-z_])").cast("int") * weight
        out[lens] = score
    return out


def classify(query: Column) -> Column:
    """The lens of the greatest score, the first in order among equals; NULL for NULL."""
    scores = lens_scores(query)
    ranked = F.array(*[F.struct(scores[x].alias("s"), F.lit(-i).alias("o"), F.lit(x).alias("lens")) for i, x in enumerate(ORDER)])
    return F.when(query.isNotNull(), F.array_max(ranked)["lens"])


def classify_text(query: str) -> str:
    """``classify`` for one query on the driver."""
    q = query.lower()
    best = ("web", 1)
    for lens in ORDER[1:]:
        s = 2 * sum(k in q for k in KEYWORDS[lens])
        if lens in BONUS and re.search(rf"(?<![0-9a-z_])({'|'.join(BONUS[lens][1])})(?![0-9a-z_])", q):
            s += BONUS[lens][0]
        if s > best[1]:
            best = (lens, s)
    return best[0]


def expand(query: str, lens: str | None = None) -> dict:
    """Lens, expansions (templates, then synonym swaps, each once), operator queries and the synonyms that apply."""
    lens = lens or classify_text(query)
    low = query.lower()
    synonyms = {k: v for k, v in SYNONYMS.get(lens, {}).items() if k.lower() in low}
    swaps = [re.sub(re.escape(k), v, query, flags=re.I) for k, vs in synonyms.items() for v in vs]
    made = [t.replace("{q}", query) for t in TEMPLATES[lens]]
    operators = [f'{o} "{query}"' for o in OPERATORS.get(lens, [])]
    return {"query": query, "lens": lens, "expansions": list(dict.fromkeys([*made, *(s for s in swaps if s != query)])), "operators": operators, "synonyms": synonyms}


def plan(query: str, lens: str | None = None) -> list[str]:
    """The queries that are sent out: a fixed list for procurement, else the query, six expansions and three operator queries."""
    e = expand(query, lens)
    if e["lens"] == "procurement":
        return [t.replace("{q}", query) for t in PROCUREMENT_PLAN]
    return [query, *e["expansions"][:6], *e["operators"][:3]]


def suggestions(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query, place, text, type, score): templates, then a guide for each word of more than two characters, ten at most."""
    q = F.col(query)
    fixed = [F.struct(F.replace(F.lit(t), F.lit("{q}"), q).alias("text"), F.lit(k).alias("type"), F.lit(s).alias("score")) for t, k, s in SUGGESTIONS]
    words = F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 2)
    guides = F.transform(words, lambda w, i: F.struct(F.concat(w, F.lit(" guide")).alias("text"), F.lit("related").alias("type"), (F.lit(0.75) - i * 0.02).alias("score")))
    return queries.select(q.alias("query"), F.posexplode(F.slice(F.concat(F.array(*fixed), guides), 1, 10)).alias("place", "s")).select("query", (F.col("place") + 1).alias("place"), "s.text", "s.type", F.round("s.score", 6).alias("score"))
