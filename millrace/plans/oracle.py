"""The same queries as SQL for DuckDB, over views named like the tables."""

from __future__ import annotations

from millrace.functions import urls as U
from millrace.functions.text import SEARCH_STOP, SUMMARY_STOP
from millrace.operators import extraction, signals
from millrace.operators.retrieval import B, K1, query_terms, query_vector
from millrace.plans import lens as L

QUERY = "occupational health services request for proposal"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {q(n)})" for n in needles) + ")"


def rx(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {q(pattern)}, 'i'), false)"


TERMS = r"regexp_extract_all(lower(text), '\b[a-z]{3,}\b')"
TF = f"select doc_id, term, count(*) tf, min(pos) first from (select doc_id, unnest({TERMS}) term, generate_subscripts({TERMS}, 1) pos from documents where text is not null) group by all"
HASH = "list_reduce(list_prepend(0::bigint, list_transform(list_filter(string_split({w}, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)"
SIGNED = "(({x} + 2147483648) % 4294967296 - 2147483648)"


def bm25() -> str:
    asked = query_terms(QUERY)
    words = sorted(set(asked))
    values = ", ".join(f"({q(w)}, {asked.count(w)})" for w in words)
    return f"""with d as (select doc_id, coalesce(len({TERMS}), 0) dl from documents), s as (select count(*) n, avg(dl) a from d),
tf as ({TF}), w(term, m) as (values {values}), df as (select term, count(*) df from tf where term in (select term from w) group by term),
p as (select tf.doc_id, sum(w.m * ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1) * (tf.tf * {K1 + 1}) / (tf.tf + {K1} * ({1 - B} + {B} * d.dl / s.a))) score
from tf join w using (term) join df using (term) join d on d.doc_id = tf.doc_id, s group by tf.doc_id)
select d.doc_id, coalesce(p.score, 0.0) score from d left join p using (doc_id)"""


def vectors() -> str:
    h = SIGNED.format(x=HASH.format(w="term"))
    return f"""with tf as ({TF}), l as (select doc_id, sum(tf) n from tf group by doc_id), v as (select term, (abs({h}) % 128)::int bucket from (select distinct term from tf)),
c as (select doc_id, bucket, arg_max(tf, first) tf from tf join v using (term) group by all), r as (select doc_id, bucket, least(1.0, tf / n) val from c join l using (doc_id)),
m as (select doc_id, sqrt(sum(val * val)) norm from r group by doc_id) select r.doc_id, bucket, val / norm val from r join m using (doc_id)"""


def cosine() -> str:
    values = ", ".join(f"({b}, {v!r})" for b, v in query_vector(QUERY).items())
    return f"select doc_id, sum(val * x) similarity from ({vectors()}) v join (values {values}) w(bucket, x) using (bucket) group by doc_id"


HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
DOMAIN = f"coalesce(regexp_replace({HOST}, '^www\\.', ''), '')"
PARAMS = r"len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> ''))"
PENALTIES = [
    ("tracker detected", 0.5, f"host is not null and ({has('host', U.TRACKERS)} or {has('url', U.TRACKERS)})"),
    ("affiliate link detected", 1.0, f"host is not null and {rx('url', U.AFFILIATE)}"),
    ("potential AI slop domain", 2.0, f"host is not null and {has('host', U.SLOP_HOSTS)}"),
    ("spammy TLD", 1.0, "host is not null and (" + " or ".join(f"ends_with(host, {q(x)})" for x in U.SPAM_ENDINGS) + ")"),
    ("excessive tracking parameters", 0.5, f"host is not null and {PARAMS} > 5"),
    ("suspiciously long URL", 0.5, "host is not null and length(url) > 200"),
    ("invalid URL", 3.0, "host is null"),
]
TRUST = f"greatest(0.0, least(1.0, 0.5 + case when {has('host', U.TRUSTED)} then 0.3 else 0.0 end - case when regexp_matches(host, '^\\d+\\.') then 0.2 else 0.0 end))"


def content(column: str) -> list[tuple[str, float, str]]:
    words = f"regexp_split_to_array(lower({column}), '[\\s\\x{{00A0}}\\x{{FEFF}}]+')"
    sales = " + ".join(f"{rx(column, s)}::int" for s in U.SALES)
    return [("low content uniqueness", 1.0, f"len(list_distinct({words})) / len({words}) < 0.3"), ("keyword stuffing detected", 1.0, f"({sales}) > 3"), ("very short content", 0.5, f"length({column}) < 100")]


def total(parts) -> str:
    return "(" + " + ".join(f"case when {c} then {w} else 0.0 end" for _, w, c in parts) + ")"


def reasons(parts) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when {c} then {q(r)} end" for r, _, c in parts) + ")"


R = f"(select *, {HOST} host from results)"
SPAM = f"case when host is null then {total(PENALTIES)} else {total(PENALTIES)} * (1 - {TRUST} * 0.5) end"
SPAM_TEXT = f"(({total(PENALTIES)} + case when coalesce(description, '') <> '' then {total(content('description'))} else 0.0 end) * case when host is null then 1.0 else 1 - {TRUST} * 0.5 end)"
FIRST = "(select * from results where url is not null qualify row_number() over (partition by url order by arrival) = 1)"
LOW = f"(select *, lower(coalesce(nullif(domain, ''), {DOMAIN})) d, lower(url) u, lower(coalesce(title, '')) t, lower(coalesce(description, '')) s from {FIRST})"
BOOST = f"""(case when ends_with(d, '.gov') then 50 else 0 end + case when ends_with(d, '.us') or {has('d', ['.gov.', 'county', 'city', 'state'])} then 30 else 0 end + case when ends_with(u, '.pdf') then 40 else 0 end
+ case when {has('t', signals.PROCUREMENT_TERMS)} or {has('s', signals.PROCUREMENT_TERMS)} then 25 else 0 end + case when {has('t', signals.HEALTH_TERMS)} or {has('s', signals.HEALTH_TERMS)} then 20 else 0 end
- case when {has('d', signals.JUNK)} and not contains(d, '.gov') then 20 else 0 end)"""
BOOSTED = f"select result_id, arrival, round(coalesce(case when isnan(score) then 0.0 else score end, 0.0) + {BOOST}, 6) score from {LOW}"


def signal_rows(url: bool) -> str:
    rows = []
    for i, (name, score, scope, pattern) in enumerate(signals.SIGNALS):
        if scope == "url" and not url:
            continue
        flag = "" if scope == "url" and not pattern.startswith("(?i)") else ", 'i'"
        rows.append(f"select doc_id, {q(name)} as name, {score} as score, {i} as pos from documents where regexp_matches({scope}, {q(pattern.replace('(?i)', ''))}{flag})")
    return " union all ".join(rows)


def lens_sql() -> str:
    out = ["1"]
    for x in L.ORDER[1:]:
        s = " + ".join(f"2 * contains(t, {q(k)})::int" for k in L.KEYWORDS[x])
        if x in L.BONUS:
            w, words = L.BONUS[x][0], '|'.join(L.BONUS[x][1])
            s += f" + {w} * regexp_matches(t, {q(chr(92) + 'b(' + words + ')' + chr(92) + 'b')})::int"
        out.append(s)
    names = ", ".join(q(x) for x in L.ORDER)
    return f"select entry_row, case when t is not null then list_extract([{names}], list_position(x, list_max(x))::int) end as lens from (select entry_row, t, [{', '.join(out)}] as x from (select entry_row, lower(title) t from feed_entries))"


COMPOSED = r"""select opp_row, regexp_replace(concat_ws(' ', title, '. Due date:', due_date, '. Posted:', posted_date, 'by', organization, '. Phone: ' || contact_phone, contact_email, monetary_value, '.', description,
'Journal: Review of ' || opportunity_type || '. By: Ann Lee, Bo Ray. doi: 10.10/' || opp_row || ' cited by: ' || (opp_row % 90) || '. Summary: ' || status || '.',
'Company: ' || organization || '. Form: 10-K Quarter: Q' || (opp_row % 4 + 1) || '. Revenue: $' || (opp_row * 7)), '[\r\n\v]+', ' ', 'g') as text, coalesce(source_url, '') as url, coalesce(title, '') as title from opportunities"""
FEED = "regexp_extract_all(lower(concat_ws(' ', title, description, content)), '\\b[a-z]{3,}\\b')"


def all_words(query: str) -> str:
    return " and ".join(f"list_contains({FEED}, {q(w)})" for w in sorted({w for w in query_terms(query) if w not in SEARCH_STOP}))


def m(pattern: str, group: int = 1, *columns: str) -> str:
    """First match in the text or the columns given, trimmed."""
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({c}, {q('(?i)' + pattern)}, {group}), ' '), '')" for c in columns or ("text",)) + ")"


def either(*patterns: str, group: int = 1, title: bool = False) -> str:
    return "coalesce(" + ", ".join(m(p, group, *(("text", "title") if title else ("text",))) for p in patterns) + ")"


def cases(rows: list[tuple[str, str]], title: bool = False) -> str:
    return "case " + " ".join(f"when {rx('text', p)}" + (f" or {rx('title', p)}" if title else "") + f" then {q(n)}" for n, p in rows) + " end"


def listed(rows: list[tuple[str, str]]) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when {rx('text', p)} then {q(n)} end" for n, p in rows) + ")"


def opening(n: int) -> str:
    return f"array_to_string(regexp_split_to_array(title, '\\s+')[1:{n}], ' ')"


NUMBER = r"nullif(regexp_replace(coalesce(nullif(regexp_extract(text, '(?i)(?:phone|tel|call|contact|telephone)[:\s]*(\+?1?[\d\s\-\(\)]{10,})', 1), ''), regexp_extract(text, '(\+?1?[\d\s\-\(\)]{10,})', 1)), '[\s\-\(\)]', '', 'g'), '')"
BODIES = "County|City|State|Department|Agency|District|Bureau|Office|Authority|Commission"
TESTS = [("PFT", "pft|spirometry|pulmonary function|lung function"), ("DOT", "dot physical|cdl physical|department of transportation"), ("physical", "physical exam|pre-employment|pre employment"), ("drug test", "drug test|drug screening|drug screen|substance abuse"), ("audiometry", "audiometry|hearing test|hearing screening"), ("respirator", "respirator|fit test|respiratory protection"), ("vaccination", "vaccination|immunization|flu shot"), ("x-ray", "x-ray|radiology|imaging"), ("lab", "lab|laboratory|blood work")]
EMPLOYER, INSURANCE = "employer|work comp|workers compensation|workers' comp", "insurance|in-network|blue cross|aetna|cigna|united"
EMPLOYED = r"(?:employer|work comp|workers comp|workers' comp)[:\s]*\$?([\d,]+(?:\.\d{2})?)"
DAY, SLASH = r"([A-Z][a-z]+ \d{1,2},?\s+\d{4})", r"(\d{1,2}/\d{1,2}/\d{4})"
#: Written from the survey's inventory of patterns, apart from the operator: columns, signals, base and step.
RECORDS: dict[str, tuple[dict[str, str], list[tuple[str, str]], int, int]] = {
    "procurement": (
        {
            "kind": cases([("RFP", "rfp|request for proposal"), ("RFQ", "rfq|request for quotation|request for quote"), ("RFT", "rft|request for tender"), ("solicitation", "solicitation"), ("bid", "bid|itb"), ("tender", "tender"), ("procurement", "procurement|contract"), ("RFQ", "quote|quotation"), ("RFP", "proposal")], title=True),
            "organization": f"coalesce({either(rf'(?:{BODIES})\s+(?:of|for)\s+([A-Z][a-zA-Z\s]+)', rf'([A-Z][a-zA-Z\s]+(?:{BODIES}))', r'(?:Department|Agency|Office)\s+of\s+([A-Z][a-zA-Z\s]+)', title=True)}, {opening(3)})",
            "service": f"coalesce({either(r'(?:for|providing|offering|services?|contract for)\s+([a-zA-Z\s]+(?:services?|health|medicine|clinic|care|support|management|consulting))', r'([a-zA-Z\s]+(?:Health|Medicine|Services|Care|Support|Management|Consulting))', title=True)}, 'professional services')",
            "due_date": either(r"(?:due date|deadline|closing|responses due|submission deadline|response due)[:\s]+" + DAY, r"(?:due|deadline|closing)[:\s]+" + SLASH, r"(?:due|deadline)[:\s]+(\d{4}-\d{2}-\d{2})", r"(?:due|deadline)[:\s]+(\d{1,2}\s+[A-Z][a-z]+,\s+\d{4})"),
            "email": m(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0),
            "phone": NUMBER,
            "amount": m(r"\$[\d,]+(?:\.\d{2})?", 0),
            "posted_date": either(r"(?:posted|published|date|created|issued)[:\s]+" + DAY, r"(?:posted|published|date)[:\s]+" + SLASH, r"(?:posted|published|date)[:\s]+(\d{4}-\d{2}-\d{2})"),
            "status": f"coalesce({cases([('open', 'open|active|current|accepting proposals|accepting bids'), ('closed', 'closed|awarded|expired|complete|withdrawn'), ('active', 'pending|under review|evaluation')])}, 'unknown')",
        },
        [("procurement language", "kind is not null"), (".gov domain", rx("url", r"\.gov")), ("procurement portal", rx("url", r"sam\.gov|bonfire|planetbids|ionwave|bidnet|governmentbids|rfpdb")), ("includes deadline", "due_date is not null"), ("monetary value", "amount is not null"), ("active opportunity", "status = 'open'"), ("contact email", "email is not null"), ("contact phone", "phone is not null")],
        35, 8,
    ),
    "provider": (
        {
            "name": f"coalesce({either(r'([A-Z][a-zA-Z\s]+(?:Clinic|Center|Health|Medicine|Medical|Occupational|Wellness|Care))', r'(?:provider|clinic|facility|practice|hospital)[:\s]+([A-Z][a-zA-Z\s]+)', r'([A-Z][a-zA-Z\s]+(?:Associates|Group|Partners))', title=True)}, {opening(2)})",
            "address": either(r"(\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+,\s+[A-Z]{2}\s+\d{5})", r"(\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s+[A-Z]{2}\s+\d{5})", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+,\s+[A-Z]{2}\s+\d{5})"),
            "city": r"case when contains(address, ', ') then coalesce(nullif(trim(regexp_split_to_array(string_split(address, ', ')[1], '\d+')[2], ' '), ''), string_split(address, ', ')[1]) end",
            "state": r"case when contains(address, ', ') then nullif(regexp_extract(trim(string_split(address, ', ')[2], ' '), '^([A-Z]{2})', 1), '') end",
            "zip": r"case when contains(address, ', ') then nullif(regexp_extract(string_split(address, ', ')[2], '(\d{5})', 1), '') end",
            "phone": NUMBER,
            "services": listed([("occupational health", "occupational health|occupational medicine|occ health"), ("DOT physical", TESTS[1][1]), ("drug testing", TESTS[3][1]), ("PFT", TESTS[0][1]), ("audiometry", TESTS[4][1]), ("respirator fit test", TESTS[5][1]), ("physical exams", TESTS[2][1]), ("vaccinations", "vaccination|immunization|flu shot|tb test"), ("x-ray services", TESTS[7][1]), ("laboratory services", TESTS[8][1])]),
            "credentials": listed([("Board Certified", "board certified|board-certified"), ("Licensed", "licensed|licensure"), ("Accredited", "accredited|accreditation"), ("Certified", "certified|certification"), ("Fellow", "fellow")]),
            "accepts_self_pay": rx("text", "self-pay|cash pay|out-of-pocket|private pay"),
            "accepts_employer": rx("text", EMPLOYER),
            "accepts_insurance": rx("text", INSURANCE),
        },
        [("physical address", "address is not null"), ("contact information", "phone is not null"), ("occupational services", "services <> ''"), ("credentials", "credentials <> ''"), ("accepts insurance", "accepts_insurance")],
        35, 8,
    ),
    "pricing": (
        {
            "kind": cases(TESTS),
            "name": f"coalesce({either(r'([A-Z][a-zA-Z\s]+(?:Clinic|Center|Health|Medicine|Medical))', r'(?:provider|clinic|facility|practice)[:\s]+([A-Z][a-zA-Z\s]+)', title=True)}, {opening(2)})",
            "service": "coalesce(kind || ' testing', 'occupational health services')",
            "price_cash": f"'$' || {either(r'(?:self-pay|cash|out-of-pocket|private pay)[:\s]*\$?([\d,]+(?:\.\d{2})?)', r'\$([\d,]+(?:\.\d{2})?)\s*(?:self-pay|cash|out-of-pocket)')}",
            "price_employer": f"'$' || {either(EMPLOYED, r'\$([\d,]+(?:\.\d{2})?)\s*(?:employer|work comp)')}",
            "price_range": f"'$' || {either(r'\$([\d,]+)\s*-\s*\$([\d,]+)', r'(?:from|between)\s*\$([\d,]+)\s*(?:and|to)\s*\$([\d,]+)')} || ' - $' || {either(r'\$([\d,]+)\s*-\s*\$([\d,]+)', r'(?:from|between)\s*\$([\d,]+)\s*(?:and|to)\s*\$([\d,]+)', group=2)}",
            "payment_types": listed([("self-pay, cash", "self-pay|cash|out-of-pocket|private pay"), ("employer, work comp", EMPLOYER), ("insurance", INSURANCE)]),
        },
        [("self-pay mention", "price_cash is not null"), ("employer payment", "price_employer is not null"), ("service category", "kind is not null"), ("pricing document", rx("text", "fee schedule|price list|rate card|pricing"))],
        35, 8,
    ),
    "legal": (
        {
            "kind": cases([("case law", r"court|ruling|judgment|decision|case law|v\.|vs\.|plaintiff|defendant"), ("statute", r"statute|act|bill|legislation|code|\d+\s+U\.S\.C\.|§\s+\d+"), ("regulation", "regulation|rule|compliance|requirement|standard"), ("compliance", "adhere|mandate")]),
            "case_name": m(r"([A-Z][a-zA-Z\s&]+(?:v\.|vs\.|versus)[A-Z][a-zA-Z\s&]+)", 1, "text", "title"),
            "court": m(r"(?:Court of|Supreme Court|District Court|Circuit Court|Appellate Court)\s+(?:the\s+)?([A-Z][a-zA-Z\s]+)"),
            "jurisdiction": m(r"(?:Jurisdiction|State|Federal|Circuit)\s*[:\s]+([A-Z][a-zA-Z\s]+)"),
            "citation": m(r"\d+\s+F\.\d+|\d+\s+U\.S\.\s+\d+|\d+\s+S\.Ct\.\s+\d+", 0),
            "decision_date": either(r"(?:Decided|Decision Date|Date)\s*[:\s]+" + DAY, SLASH),
            "statute_name": m(r"(?:Act|Statute|Code)\s+(?:of\s+)?([A-Z][a-zA-Z\s]+)"),
            "regulation_number": m(r"(?:Regulation|Rule|CFR)\s*[:\s]+(\d+\s+CFR\s+\d+\.?\d*)"),
        },
        [("case name", "case_name is not null"), ("citation", "citation is not null"), ("court", "court is not null"), ("legal type", "kind is not null")],
        40, 10,
    ),
    "medical": (
        {
            "kind": cases([("research", r"clinical trial|study|research|investigation|nct\d+"), ("clinical", "clinical|treatment|therapy|intervention|procedure"), ("diagnosis", "diagnosis|diagnostic|screening|test"), ("treatment", "medication|drug")]),
            "condition": f"coalesce({m(r'(?:condition|disease|disorder|syndrome)\s*[:\s]+([A-Z][a-zA-Z\s]+)')}, {m(r'([A-Z][a-zA-Z\s]+(?:Disease|Disorder|Syndrome|Condition))', 1, 'title')})",
            "treatment": m(r"(?:treatment|therapy)\s*(?:for|of)\s+([a-zA-Z\s]+)"),
            "diagnosis": m(r"(?:diagnosis|diagnosed as)\s*[:\s]+([a-zA-Z\s]+)"),
            "study_type": m(r"(?:study type|design)\s*[:\s]+([a-zA-Z\s]+)"),
            "trial_id": m(r"NCT\d+", 0),
            "publication_date": either(r"(?:Published|Publication Date)\s*[:\s]+" + DAY, SLASH),
        },
        [("condition", "condition is not null"), ("clinical trial ID", "trial_id is not null"), ("medical type", "kind is not null"), ("academic source", rx("url", r"\.edu\b")), ("government source", rx("url", r"\.gov\b"))],
        40, 10,
    ),
    "academic": (
        {
            "kind": f"case when {rx('text', 'journal|article|paper')} or {rx('url', 'doi.org')} then 'journal' when {rx('text', 'conference|proceedings|symposium')} then 'conference' when {rx('text', 'thesis|dissertation|doctoral')} then 'thesis' when {rx('text', 'preprint|arxiv|biorxiv|medrxiv')} or {rx('url', 'arxiv.org')} then 'preprint' end",
            "paper_title": "title",
            "authors": f"array_to_string(list_transform(string_split({m(r'(?:Authors?|By)\s*[:\s]+([A-Z][a-zA-Z\s,]+)')}, ','), lambda x: trim(x, ' ')), ', ')",
            "journal": m(r"(?:Journal|Published in)\s*[:\s]+([A-Z][a-zA-Z\s]+)"),
            "publication_date": m(r"(?:Published|Date|Publication)[:\s]+" + DAY),
            "doi": f"coalesce({m(r'doi[:\s]+(10\.\d+/[^\s]+)')}, nullif(regexp_extract(url, 'doi\\.org/(10\\.\\d+/[^\\s]+)', 1), ''))",
            "citations": f"try_cast({m(r'(?:citations|cited by)[:\s]+(\d+)')} as bigint)",
            "abstract": m(r"(?:Abstract|Summary)[:\s]+([^.]+\.)"),
        },
        [("academic type detected", "kind is not null"), ("DOI present", "doi is not null"), ("authors listed", "authors is not null"), ("journal specified", "journal is not null"), ("publication date", "publication_date is not null")],
        35, 8,
    ),
    "financial": (
        {
            "kind": cases([("earnings", r"earnings|revenue|profit|income statement|q\d+|fiscal"), ("report", "financial report|annual report|10-k|10-q"), ("market", "market|stock|trading|equity|share"), ("economic", "economic|gdp|inflation|unemployment|federal reserve")]),
            "company": f"coalesce({m(r'(?:Company|Corporation|Inc\.|LLC)\s*[:\s]+([A-Z][a-zA-Z\s]+)')}, {m(r'([A-Z][a-zA-Z\s]+(?:Inc\.|LLC|Corporation|Company))', 1, 'title')})",
            "ticker": "coalesce(" + ", ".join(m(r"\(([A-Z]{1,5})\)|NYSE:\s*([A-Z]{1,5})|NASDAQ:\s*([A-Z]{1,5})", i) for i in (1, 2, 3)) + ")",
            "report_type": m(r"(?:Report Type|Form)\s*[:\s]+([A-Z0-9-]+)"),
            "period": m(r"(?:Period|Quarter|Fiscal Year)\s*[:\s]+([A-Z0-9\s]+)"),
            "revenue": f"'$' || {m(r'(?:Revenue|Total Revenue)\s*[:\s]?\$?([\d,]+(?:\.\d{2})?)')}",
            "profit": f"'$' || {m(r'(?:Profit|Net Income|Earnings)\s*[:\s]?\$?([\d,]+(?:\.\d{2})?)')}",
            "eps": f"'$' || {m(r'(?:EPS|Earnings Per Share)\s*[:\s]?\$?([\d.]+)')}",
        },
        [("company name", "company is not null"), ("ticker", "ticker is not null"), ("revenue", "revenue is not null"), ("financial type", "kind is not null"), ("government source", rx("url", r"\.gov\b"))],
        40, 10,
    ),
}


def record_sql(lens: str) -> str:
    columns, signals, base, step = RECORDS[lens]
    points = " + ".join(f"coalesce({on}, false)::int" for _, on in signals)
    names = "concat_ws(', ', " + ", ".join(f"case when {on} then {q(n)} end" for n, on in signals) + ")"
    shown = ", ".join(columns)
    return f"select opp_row, {shown}, {names} as signals, least(95, {base} + {step} * ({points}))::int as confidence from (select *, {', '.join(f'{c} as {n}' for n, c in columns.items() if n != 'paper_title' and not c.startswith('coalesce(kind') and not c.startswith('case when contains(address'))}{''.join(f', {c} as {n}' for n, c in columns.items() if n == 'paper_title' or c.startswith('coalesce(kind') or c.startswith('case when contains(address'))} from ({COMPOSED}))"


STOP = "(" + ", ".join(q(w) for w in SUMMARY_STOP) + ")"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda w: length(w) > 2 and w not in {STOP})"


PIECES = "list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: trim(s, ' ')), lambda s: length(s) > {n})"
WEIGHTS = f"select word, ln((select count(*) from feed_entries)::double / count(*)) + 1 weight from (select unnest(list_distinct({words('description')})) word from feed_entries where description is not null) group by word"
SENTENCES = PIECES.format(x="coalesce(title, '') || '. ' || coalesce(description, '')", n=10)
SCORED = f"""with w as ({WEIGHTS}), s as (select entry_row, unnest({SENTENCES}) sentence, generate_subscripts({SENTENCES}, 1) - 1 pos from feed_entries),
t as (select entry_row, pos, unnest({words('sentence')}) word from s), m as (select entry_row, pos, sum(coalesce(weight, 0.0)) / count(*) score from t left join w using (word) group by all)
select entry_row, pos, sentence, round(coalesce(score, 0.0), 6) score from s left join m using (entry_row, pos)"""
PREFS = "(values ('bids.harrowmere-county.gov.example', 'pin'), ('malga-medhun-clinic.example', 'raise'), ('news.norzock-darsun.example', 'lower'), ('procure.gistmint-barvmarsh.example', 'block')) p(dom, action)"
PREF_ROWS = "(values ('u1', 'bids.harrowmere-county.gov.example', 'pin'), ('u1', 'malga-medhun-clinic.example', 'raise'), ('u1', 'news.norzock-darsun.example', 'lower'), ('u1', 'procure.gistmint-barvmarsh.example', 'block')) p(user_id, domain, action)"


def distinct_joined(pattern: str) -> str:
    found = f"regexp_extract_all(text, {q(pattern)})"
    return f"array_to_string(list_transform(list_sort(list_transform(list_distinct({found}), lambda x: {{'p': list_position({found}, x), 'x': x}})), lambda s: s.x), ' | ')"


def csv(c: str) -> str:
    return f"'\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"'"


_PLANNED = sorted({w for x in L.PROCUREMENT_PLAN for w in query_terms(x.replace("{q}", "request for proposals road resurfacing")) if w not in ("site", "filetype", "gov", "com")})
_SAID = "lower(concat_ws(' ', title, description))"
ASKED_FIRST = FIRST.replace("where url is not null", f"where url <> '' and title <> '' and {has(_SAID, _PLANNED)}")

ORACLE: dict[str, str] = {
    "term_frequency": f"select doc_id, term, tf from ({TF})",
    "document_frequency": f"select term, count(*) df from ({TF}) group by term",
    "doc_length_stats": f"select count(*) docs, round(avg(n), 6) avg_len, max(n) max_len from (select coalesce(len({TERMS}), 0) n from documents)",
    "bm25_score": f"select doc_id, round(score, 6) score from ({bm25()})",
    "bm25_topk": f"select doc_id, round(score, 6) score from ({bm25()}) order by round(score, 6) desc, doc_id limit 10",
    "tf_hash_embedding": f"select doc_id, bucket, round(val, 6) val from ({vectors()})",
    "semantic_rerank": f"select doc_id, round(similarity, 6) similarity from ({cosine()}) order by round(similarity, 6) desc, doc_id limit 10",
    "hybrid_topk": f"""with b as ({bm25()}), c as ({cosine()}), j as (select b.doc_id, b.score bm25, coalesce(c.similarity, 0.0) cosine from b left join c using (doc_id)), m as (select greatest(max(bm25), 1.0) mb, greatest(max(cosine), 1.0) mc from j)
select doc_id, round(bm25, 6) bm25, round(cosine, 6) cosine, round(0.5 * bm25 / mb + 0.5 * cosine / mc, 6) score from j, m order by score desc, doc_id limit 10""",
    "hash_embedding_384": f"""with h as (select doc_id, {HASH.format(w="regexp_replace(lower(coalesce(text, '')), '[\\s\\x0B\\x{00A0}\\x{FEFF}]+', ' ', 'g')")} h from documents), r as (select doc_id, i - 1 slot, ({SIGNED.format(x="(h * i) % 4294967296")} % 1000) / 1000.0 v from h, range(1, 385) t(i)),
n as (select doc_id, sqrt(sum(v * v)) n from r group by doc_id) select doc_id, slot::int slot, round(case when n > 0 then v / n else 0.0 end, 6) v from r join n using (doc_id)""",
    "cosine_topk": """with a as (select embedding e, vec_id i from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(embedding::double[], a.e::double[]), 6) similarity from embeddings, a where vec_id <> a.i
order by round(list_cosine_similarity(embedding::double[], a.e::double[]), 12) desc, vec_id limit 10""",
    "knn_label_join": """select query, vec_id, place::int place, round(s, 6) similarity, same_label from (select a.vec_id as query, b.vec_id, a.label = b.label as same_label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s,
row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) desc, b.vec_id) place from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) where place <= 5""",
    "text_match_counts": """select doc_id, score::int score from (select doc_id, len(regexp_extract_all(lower(text), 'county')) + len(regexp_extract_all(lower(text), 'health')) + len(regexp_extract_all(lower(text), 'review')) score from documents where text is not null)
where score > 0 order by score desc, doc_id limit 20""",
    "ilike_search": "select doc_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') created from documents where text ilike '%bilingual coordinator%' order by created_at desc, doc_id limit 25",
    "feed_search": f"select entry_row, title, feed_url from feed_entries where {all_words('review schedule')} order by published_at desc nulls first, entry_row limit 50",
    "feed_text_hits": f"select entry_row from feed_entries where {all_words('contractor agreement')}",
    "url_domain": f"select result_id, {DOMAIN} as domain, {PARAMS}::int n_params from results",
    "url_encode_decode": "select result_id, case when title = '' then '/url?q=' else title end target from results where title is not null",
    "url_spam_score": f"select result_id, {total(PENALTIES)}::double score, {reasons(PENALTIES)} reasons from {R}",
    "domain_trust": f"select distinct host, round({TRUST}, 6)::double trust from {R}",
    "combined_spam": f"select result_id, round({SPAM_TEXT}, 6)::double spam from {R}",
    "content_spam": f"select doc_id, {total(content('text'))}::double score, {reasons(content('text'))} reasons from documents where text is not null",
    "spam_adjusted_score": f"select result_id, round(score * pow(0.5, {SPAM}), 6) adjusted from {R} where score is not null and not isnan(score)",
    "dedupe_first": f"select url, result_id, source from {FIRST}",
    "lens_boost_rank": f"select result_id, score, row_number() over (order by score desc, arrival) as rank from ({BOOSTED})",
    "source_rank": "select result_id, source, row_number() over (partition by source order by arrival) rank_in_source from results",
    "source_counts": "select source, count(*) n, count(distinct url) urls from results group by source",
    "usable_results": "select result_id from results where trim(coalesce(title, ''), ' ') <> '' and length(trim(coalesce(description, ''), ' ')) > 50",
    "union_sources": """select url, title, source, ord from (select url, title, source, arrival ord from results union all select url, title, 'small-web', entry_row + 1000000000 from feed_entries) where url <> '' and title <> '' qualify row_number() over (partition by url order by ord) = 1""",
    "joined_texts": "select url, part, string_agg(description, ' ' order by arrival) as text from (select url, description, arrival, (row_number() over (partition by url order by arrival) - 1) // 1000 as part from results where description is not null) group by url, part",
    "page_signals": f"select doc_id, name, score from ({signal_rows(True)})",
    "page_confidence": f"select doc_id, greatest(0, least(coalesce(t, 0) + 40, 100))::int confidence from documents left join (select doc_id, sum(score) t from ({signal_rows(False)}) group by doc_id) using (doc_id)",
    "intelligence_summary": f"""with f as (select name, score, min(doc_id * 1000 + pos) spot from ({signal_rows(False)}) group by all) select count(*) n_signals, greatest(0, least(coalesce(sum(score), 0) + 40, 100))::int confidence,
coalesce((select string_agg(name, ', ' order by spot) from (select * from f where score > 0 order by spot limit 3)), 'general content') summary from f""",
    "classify_queries": lens_sql(),
    "suggestions": "select query, place::int place, text, type, round(score, 6)::double score from (select query, unnest(list_slice(list_concat([" + ", ".join(f"{{'text': replace({q(t)}, '{{q}}', query), 'type': {q(k)}, 'score': {s}::double}}" for t, k, s in L.SUGGESTIONS)
    + "], list_transform(g, lambda w, i: {'text': w || ' guide', 'type': 'related', 'score': (0.75 - (i - 1) * 0.02)::double})), 1, 10), recursive := true), unnest(range(1, least(10, 8 + len(g)) + 1)) place from (select distinct p_name query, list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: length(w) > 2) g from part))",
    "domain_prefs_apply": f"""select result_id, round(case p.action when 'pin' then b * 10 when 'raise' then b * 2 when 'lower' then b * 0.5 else coalesce(s, 0.0) end, 6)::double adjusted from (select result_id, {DOMAIN} dd, case when isnan(score) then null else score end s,
coalesce(case when isnan(score) then null else score end, 1.0 / coalesce(rank, 1)) b from results) r left join {PREFS} on p.dom = r.dd where coalesce(p.action, '') <> 'block'""",
    "prefs_upsert": f"select user_id, domain, case when domain = 'malga-medhun-clinic.example' then 'block' else action end as action from {PREF_ROWS} union all select 'u2', 'new.example', 'pin'",
    "prefs_delete": f"select * from {PREF_ROWS} where not (user_id = 'u1' and domain = 'news.norzock-darsun.example')",
    "opportunities_upsert": """with old as (select id, arg_max({'t': title, 's': status}, {'f': fetched_at, 'r': opp_row}) r, min(fetched_at) c from opportunities where opp_row % 2 = 0 group by id),
new as (select id, arg_max({'t': title, 's': status, 'f': fetched_at}, {'f': fetched_at, 'r': opp_row}) r from opportunities where opp_row % 2 = 1 group by id)
select coalesce(new.id, old.id) id, case when new.id is not null then new.r.t else old.r.t end title, case when new.id is not null then new.r.s else old.r.s end status, strftime(coalesce(old.c, new.r.f), '%Y-%m-%d %H:%M:%S') created from old full join new using (id)""",
    "documents_upsert": """with old as (select * from documents where doc_id % 4 <> 0 and id is not null qualify row_number() over (partition by id order by created_at desc, doc_id desc) = 1), new as (select * from documents where doc_id % 4 = 0 and id is not null qualify row_number() over (partition by id order by created_at desc, doc_id desc) = 1)
select coalesce(new.id, old.id) id, case when new.id is not null then new.title else old.title end title, case when new.id is not null then new.lens else old.lens end lens, coalesce(new.doc_id, old.doc_id) doc_id, strftime(case when old.id is not null then old.created_at else new.created_at end, '%Y-%m-%d %H:%M:%S') created from old full join new on old.id = new.id""",
    "feed_upsert": """with old as (select * from feed_entries where entry_row % 3 <> 0 and id is not null qualify row_number() over (partition by id order by created_at desc, entry_row desc) = 1), new as (select * from feed_entries where entry_row % 3 = 0 and id is not null qualify row_number() over (partition by id order by created_at desc, entry_row desc) = 1)
select coalesce(new.id, old.id) id, case when new.id is not null then new.title else old.title end title, case when new.id is not null then new.description else old.description end description, case when old.id is not null then old.category else new.category end category, coalesce(old.entry_row, new.entry_row) entry_row from old full join new on old.id = new.id""",
    "feed_touch": "select url, case when active then '2030-01-01 00:00:00' else strftime(last_fetched, '%Y-%m-%d %H:%M:%S') end last_fetched from feed_sources",
    "active_feed_entries": "select entry_row, feed_url from feed_entries where feed_url in (select url from feed_sources where active)",
    "feed_cascade_delete": "select entry_row, feed_url from feed_entries where feed_url is null or feed_url not in (select url from feed_sources where not active)",
    "index_batch": f"""with b as (select *, row_number() over (order by score desc, arrival) rank from ({BOOSTED}) order by score desc, arrival limit 20), t as (select r.url as id, concat_ws(' ', r.title, r.description) as text, r.source, b.rank from b join results r using (result_id)),
h as (select *, {HASH.format(w="regexp_replace(lower(text), '[\\s\\x0B\\x{00A0}\\x{FEFF}]+', ' ', 'g')")} h from t), v as (select *, list_transform(range(1, 385), lambda i: ({SIGNED.format(x="(h * i) % 4294967296")} % 1000) / 1000.0) v from h)
select id, text, 'procurement' as lens, source, rank, 384 as dim, round(v[1] / n, 6) v0, round(v[384] / n, 6) v383 from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from v)""",
    "search_procurement": f"""with c as (select *, row_number() over (order by score desc, arrival) n from ({BOOSTED.replace(FIRST, ASKED_FIRST)}) order by score desc, arrival limit 30)
select 'procurement' as lens, case when r.url in (select url from documents where url is not null) then greatest(1, c.n - 1) else c.n end::int as place, r.result_id, r.title, r.url, coalesce(nullif(r.domain, ''), {DOMAIN.replace("url,", "r.url,")}) as domain, r.source, c.score as boosted, null::double as similarity, null::double as spam_score,
case when contains(lower(r.url), '.pdf') then 'pdf' when ends_with(lower(r.url), '.docx') then 'docx' else 'html' end as way, e.record_signals, g.confidence from c join results r using (result_id)
join (select result_id, case when length(text) > 100 then signals end as record_signals from ({record_sql("procurement").replace("opp_row", "result_id").replace(COMPOSED.replace("opp_row", "result_id"), "select result_id, concat_ws(' ', title, description) as text, coalesce(url, '') as url, coalesce(title, '') as title from results").replace("select result_id, kind", "select result_id, text, kind")})) e using (result_id)
join (select result_id, greatest(0, least(coalesce(t, 0) + 40, 100))::int confidence from results left join (select doc_id as result_id, sum(score) t from ({signal_rows(False).replace("from documents", "from (select result_id as doc_id, concat_ws(' ', title, description) as text from results)")}) group by doc_id) using (result_id)) g using (result_id)""",
    "rank_nudge": "select result_id, case when url in (select url from documents where url is not null) then greatest(1, rank - 1) else rank end as rank from results",
    "extract_entities": "select doc_id, " + ", ".join(f"{distinct_joined(p)} as {n}" for n, p in (("emails", extraction.EMAIL), ("phones", extraction.PHONE), ("urls", extraction.WEBSITE), ("dates", extraction.DATE), ("money", extraction.MONEY))) + " from documents where text is not null",
    **{f"extract_{x}": record_sql(x) for x in RECORDS},
    "rss_parse": "select entry_row, trim(title, ' ') title, trim(url, ' ') link, trim(coalesce(description, ''), ' ') description from feed_entries where trim(title, ' ') <> '' and trim(url, ' ') <> ''",
    "engine_json_parse": "select result_id, title, url, coalesce(description, '') description, source from results where source like 'searxng-%' and title <> '' and url <> ''",
    "export_csv": "select " + " || ',' || ".join(csv(c) for c in ("title", "description", "url", "source")) + " as value from results",
    "export_csv_metadata": '''select 0 as place, '"Metadata","Query: county ""services""","Lens: government","Timestamp: 2026-01-31T00:00:00Z","Results: ' || (select count(*) from results) || '"' as value union all select 1, 'title,url,description,source' union all select 2, ''' + " || ',' || ".join(csv(c) for c in ("title", "url", "description", "source")) + " from results",
    "idf_words": f"select word, round(weight, 6) weight from ({WEIGHTS})",
    "sentence_rank": f"select * from ({SCORED}) order by score desc, entry_row, pos limit 3",
    "sentence_scores": f"select entry_row, sentence, score from ({SCORED})",
    "key_points": f"select entry_row, coalesce(list_extract({PIECES.format(x='description', n=20)}, 1), nullif(title, '')) point from feed_entries",
    "bigram_topics": f"""with t as (select entry_row, unnest({words('description')}) w, generate_subscripts({words('description')}, 1) - 1 p from feed_entries), b as (select w || ' ' || lead(w) over (order by entry_row, p) phrase, entry_row, p from t)
select upper(phrase[1]) || phrase[2:] phrase, n from (select phrase, count(*) n, min(entry_row * 1000000 + p) spot from b where phrase is not null group by phrase having count(*) > 1) order by n desc, spot limit 8""",
    "history_filter": "select p_partkey from part where contains(lower(p_name), 'a')",
}
