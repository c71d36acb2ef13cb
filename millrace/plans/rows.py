"""Queries over stored rows, each with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import extraction, ranking, state, store, summary, views
from millrace.plans import lens
from millrace.sources import listings, markup
from millrace.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = "2026-01-31 00:00:00"
ASKED = "request proposals services"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("select doc_id from documents where length(text) > 100")
def enough_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(views.enough(F.col("text"))).select("doc_id")


@query("""select doc_id, case when contains(lower(coalesce(url, '')), '.pdf') then 'pdf' when lens in ('pdf', 'government', 'procurement') and ends_with(lower(coalesce(url, '')), '.docx') then 'docx'
when lens in ('procurement', 'provider', 'pricing', 'legal', 'medical', 'academic', 'financial') then 'html' else 'none' end way from documents""")
def content_gate(spark, d):
    return table(spark, d, "documents", "doc_id", "lens", "url").select("doc_id", views.content_way(F.col("lens"), F.col("url")).alias("way"))


@query("select result_id, title from results where source = (select min(source) from results)")
def source_filter(spark, d):
    r = table(spark, d, "results", "result_id", "title", "source")
    return r.join(F.broadcast(r.agg(F.min("source").alias("source"))), "source").select("result_id", "title")


@query("""select result_id, row_number() over (order by coalesce(case when isnan(score) then 0.0 else score end, 0.0) desc, arrival) by_score, row_number() over (order by rank nulls first, arrival) by_rank, row_number() over (order by source nulls first, arrival) by_source from results""")
def sorted_views(spark, d):
    """Places of every row in the three orders a reader may choose: score, rank, source (by code point)."""
    r = table(spark, d, "results", "result_id", "score", "rank", "source", "arrival").withColumnRenamed("rank", "rnk").withColumn("score", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))
    r = ranking.global_rank(r, F.desc("score"), F.asc("arrival"), out="by_score")
    r = ranking.global_rank(r, F.asc("rnk"), F.asc("arrival"), out="by_rank")
    return ranking.global_rank(r, F.asc("source"), F.asc("arrival"), out="by_source").select("result_id", "by_score", "by_rank", "by_source")


def _marks(spark, d):
    e = table(spark, d, "feed_entries", "entry_row", "title", "url", "description", "category", "feed_title")
    return e.select(F.col("entry_row").alias("id"), "title", "url", "description", F.array("category").alias("tags"), F.col("feed_title").alias("folder"))


@query("""select entry_row as id, title from feed_entries where (contains(lower(title), 'review') or contains(lower(coalesce(description, '')), 'review') or contains(lower(coalesce(category, '')), 'review')) and feed_title = (select min(feed_title) from feed_entries)""")
def bookmark_filter(spark, d):
    folder = _marks(spark, d).agg(F.min("folder")).first()[0]
    return views.bookmarks(_marks(spark, d), "Review", folder).select("id", "title")


@query("select feed_title as folder, count(*) n from feed_entries where feed_title is not null group by feed_title")
def bookmark_folders(spark, d):
    return _marks(spark, d).where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, case when p_partkey % 7 = 0 then p_size % 2 <> 0 else p_size % 2 = 0 end starred from part where p_partkey % 5 <> 0")
def history_edit(spark, d):
    """Stored searches after one in five is deleted and one in seven starred or unstarred."""
    h = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_size") % 2 == 0).alias("starred"))
    gone = h.where("p_partkey % 5 = 0").select("p_partkey")
    return views.toggled(store.delete(h, gone, ["p_partkey"]), "p_partkey", F.col("p_partkey") % 7 == 0)


@query(r"""select doc_id, array_to_string(list_filter(regexp_extract_all(text, 'https?://(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:/[a-zA-Z0-9._~:/?#@!$&''()*+,;=\[\]-]*)?'), lambda x: contains(x, 'example')), ' ') as sites from documents where text is not null""")
def website_hints(spark, d):
    sites = F.regexp_extract_all("text", F.lit(extraction.WEBSITE), F.lit(0))
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.array_join(views.hinted(sites, "example"), " ").alias("sites"))


@query("select doc_id from documents where contains(text, 'Access Denied') or contains(text, 'captcha') or contains(text, 'bot detection')")
def blocked_pages(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where(markup.blocked_page(F.col("text"))).select("doc_id")


@query("select query, engine, (row_number() over (partition by query order by engine))::int place from (select distinct p_name as query from part), (values ('bing'), ('duckduckgo'), ('google'), ('marginalia'), ('searxng')) e(engine)")
def query_engines(spark, d):
    """Every stored query for every engine, in the order in which they are asked."""
    engines = F.array(*[F.lit(e) for e in ("bing", "duckduckgo", "google", "marginalia", "searxng")])
    q = table(spark, d, "part", "p_name").distinct().select(F.col("p_name").alias("query"), F.posexplode(engines).alias("pos", "engine"))
    return q.select("query", "engine", (F.col("pos") + 1).alias("place"))


@query(r"select opp_row, regexp_replace(lower(organization), '\s+', '', 'g') as slug from opportunities")
def organization_slug(spark, d):
    return table(spark, d, "opportunities", "opp_row", "organization").select("opp_row", views.slug(F.col("organization")).alias("slug"))


@query("select vec_id, len(embedding)::int n, round(list_sum(embedding::double[]), 4) total from embeddings")
def vector_literals(spark, d):
    """Vectors written as literals and read back."""
    v = views.parsed_vector(views.vector_literal(F.col("embedding")))
    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"""select entry_row, case when n is null then null when n = 0 then 'Today' when n = 1 then 'Yesterday' when n < 7 then n || ' days ago' when n < 30 then (n // 7) || ' weeks ago' else (n // 30) || ' months ago' end as ago
from (select entry_row, floor((epoch_us(timestamp '{NOW}') - epoch_us(published_at)) / 86400000000)::bigint n from feed_entries)""")
def relative_dates(spark, d):
    at, now = F.col("published_at").cast("timestamp"), F.lit(NOW).cast("timestamp")
    return table(spark, d, "feed_entries", "entry_row", "published_at").select("entry_row", views.relative_date(at, now).alias("ago"))


@query(f"select entry_row, strftime(coalesce(date_trunc('second', published_at), timestamp '{NOW}'), '%Y-%m-%d %H:%M:%S') as at from feed_entries")
def feed_times(spark, d):
    """Times of entries as feeds write them (RFC 822), read back; a missing one is the time of reading."""
    e = table(spark, d, "feed_entries", "entry_row", "published_at")
    said = F.date_format(F.col("published_at").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return e.select("entry_row", F.date_format(views.feed_time(said, F.lit(NOW).cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(r"select opp_row, try_cast(nullif(regexp_extract(replace(monetary_value, '$', ''), '^\s*([+-]?\d+)', 1), '') as bigint) as n from opportunities")
def leading_integers(spark, d):
    return table(spark, d, "opportunities", "opp_row", "monetary_value").select("opp_row", views.leading_integer(F.replace("monetary_value", F.lit("$"), F.lit(""))).alias("n"))


def _lens_rows() -> str:
    parts = []
    for x in lens.ORDER[1:]:
        s = " + ".join(f"2 * contains(lower(title), '{k}')::int" for k in lens.KEYWORDS[x])
        if x in lens.BONUS:
            s += f" + {lens.BONUS[x][0]} * regexp_matches(lower(title), '\\b({'|'.join(lens.BONUS[x][1])})\\b')::int"
        parts.append(f"select entry_row, '{x}' as lens, ({s}) as score from feed_entries where title is not null")
    return f"select * from ({' union all '.join(parts)}) where score > 0"


@query(_lens_rows())
def lens_scores(spark, d):
    """Every lens but web that a title speaks for, with its score."""
    scores = lens.lens_scores(F.col("title"))
    pairs = F.create_map(*[x for name, c in scores.items() if name != "web" for x in (F.lit(name), c.cast("int"))])
    e = table(spark, d, "feed_entries", "entry_row", "title").where("title is not null")
    return e.select("entry_row", F.explode(F.map_filter(pairs, lambda _, v: v > 0)).alias("lens", "score"))


@query(None)
def expansion_suggestions(spark, d):
    """Expansions of a query as suggestions: the first is related, the others guessed, each a tenth below the one before."""
    from millrace.plans.queries import SEARCHES

    rows = spark.createDataFrame([(q, lens.expand(q)["expansions"]) for q in SEARCHES], "query string, said array<string>")
    return rows.select("query", F.posexplode("said").alias("pos", "text")).select("query", "text", F.when(F.col("pos") == 0, "related").otherwise("ai").alias("type"), F.round(1 - F.col("pos") * 0.1, 6).alias("score"))


_RELEVANCE = " + ".join(f"5 * len(regexp_extract_all(t, '{w}')) + case when contains(h, '{w}') then 20 else 0 end" for w in ASKED.split())


@query(rf"""select extract_id, least(100, {_RELEVANCE} + case when len(regexp_extract_all(x, '\d{{1,2}}/\d{{1,2}}/\d{{4}}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{{1,2}}, \d{{4}}')) > 0 then 15 else 0 end
+ case when len(regexp_extract_all(x, '\$[\d,]+(?:\.\d{{2}})?')) > 0 then 15 else 0 end + case when contains(t, 'rfp') or contains(t, 'solicitation') then 30 else 0 end + case when coalesce(len(headers), 0) > 3 then 10 else 0 end)::int as score
from (select extract_id, coalesce(text, '') x, lower(coalesce(text, '')) t, lower(coalesce(title, '')) h, headers from extracted_documents)""")
def document_relevance(spark, d):
    e = table(spark, d, "extracted_documents", "extract_id", "text", "title", "headers")
    return e.select("extract_id", views.relevance(F.col("text"), F.col("title"), ASKED, "procurement", F.col("headers")).cast("int").alias("score"))


@query(r"""select extract_id, trim(l[1], ' ') as title, len(list_filter(l, lambda x: regexp_matches(x, '(?i)^(?:Chapter|Section|Part)\s+\d+') or regexp_matches(x, '^[A-Z][A-Z\s]{10,}$') or regexp_matches(x, '^\d+\.\s+[A-Z]')))::int as n_headers,
coalesce(case when len(l) > 0 and length(array_to_string(l, ' ')) + 1 > 50 then 1 else 0 end, 0) as n_paragraphs from (select extract_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') l from extracted_documents) where l is not null""")
def pdf_text_structure(spark, d):
    e = table(spark, d, "extracted_documents", "extract_id", "text").where("text is not null").select("extract_id", views.text_structure(F.col("text"), "pdf").alias("s"))
    return e.select("extract_id", "s.title", F.size("s.headers").alias("n_headers"), F.size("s.paragraphs").alias("n_paragraphs"))


@query(r"""select extract_id, array_to_string(list_transform(list_filter(l, lambda x: regexp_matches(x, '^[A-Z][A-Z\s]{8,}$') or regexp_matches(x, '^\d+\.\s+[A-Z]')), lambda x: trim(x, ' ')), ' | ') as headers from (select extract_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') l from extracted_documents) where l is not null""")
def docx_text_structure(spark, d):
    e = table(spark, d, "extracted_documents", "extract_id", "text").where("text is not null").select("extract_id", views.text_structure(F.col("text"), "docx").alias("s"))
    return e.select("extract_id", F.array_join("s.headers", " | ").alias("headers"))


@query("select opp_row, case when regexp_matches(title, 'rfp', 'i') then 'RFP' when regexp_matches(title, 'rfq', 'i') then 'RFQ' when regexp_matches(title, 'solicitation', 'i') then 'solicitation' else 'procurement' end kind, case lower(status) when 'success' then 'active' when 'blocked' then 'blocked' when 'empty' then 'empty' when 'failed' then 'failed' when 'unavailable' then 'failed' else 'experimental' end state from opportunities")
def opportunity_labels(spark, d):
    o = table(spark, d, "opportunities", "opp_row", "title", "status")
    return o.select("opp_row", views.opportunity_kind(F.col("title")).alias("kind"), views.crawl_state(F.lower("status")).alias("state"))


@query("select opp_row as id, title, coalesce(organization, '') as description, document_url as url, source from opportunities where title <> '' and document_url <> '' qualify row_number() over (partition by document_url order by opp_row) = 1")
def opportunity_rows(spark, d):
    """Notices of all portals as result rows, the first of each URL."""
    o = table(spark, d, "opportunities", "opp_row", "title", "organization", "document_url", "source").where("title <> '' and document_url <> ''")
    return ranking.keep_first(o, "document_url", "opp_row").select(F.col("opp_row").alias("id"), "title", F.coalesce("organization", F.lit("")).alias("description"), F.col("document_url").alias("url"), "source")


def _listing(site: str, item: str):
    """Result rows written as a site's pages of about 50, and read back."""

    def run(spark, d):
        esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
        r = table(spark, d, "results", "result_id", "title", "url").where("title is not null and url is not null")
        html = F.format_string(item.replace("%", "%%").replace("{u}", "%1$s").replace("{t}", "%2$s").replace("{i}", "%3$s"), esc(F.col("url")), esc(F.col("title")), F.col("result_id").cast("string"))
        pages = r.groupBy(F.floor(F.col("result_id") / 50).alias("page")).agg(F.concat(F.lit("<html><body><div class='top'><a href='/x'>Menu</a></div>"), F.array_join(F.sort_array(F.collect_list(F.struct("result_id", html.alias("h")))).getField("h"), ""), F.lit("</body></html>")).alias("html"))
        return listings.listings(pages, site).select(F.col("snippet").cast("bigint").alias("result_id"), "title", "url")

    return run


_ROWS = r"select result_id, trim(regexp_replace(title, '\s+', ' ', 'g'), ' ') as title, trim(url, ' ') as url from results where trim(title, ' ') <> '' and trim(url, ' ') <> '' qualify row_number() over (partition by result_id // 50, trim(url, ' ') order by result_id) = 1"
for _name, _site, _item in (
    ("duckduckgo_listing", "duckduckgo", '<div class="result web"><h2><a class="result__a" href="{u}">{t}</a></h2><a class="result__snippet" href="/y">{i}</a></div>'),
    ("bing_listing", "bing", '<ol><li class="b_algo"><h2><a href="{u}">{t}</a></h2><div class="b_caption"><p>{i}</p></div></li></ol>'),
    ("google_listing", "google", '<div class="g"><a href="{u}"><h3>{t}</h3></a><div class="VwiC3b">{i}</div></div>'),
    ("portal_listing", "sam.gov", '<div class="usa-card"><h3 class="title">{t}</h3><a href="{u}">open</a><br><span class="agency">{i}</span></div>'),
):
    _run = _listing(_site, _item)
    _run.__name__ = _name
    query(_ROWS)(_run)


# ── preferences, stores ──
@query("select domain, action from (values ('u1', 'bids.harrowmere-county.gov.example', 'pin'), ('u1', 'malga-medhun-clinic.example', 'raise'), ('u1', 'news.norzock-darsun.example', 'lower'), ('u1', 'procure.gistmint-barvmarsh.example', 'block')) p(user_id, domain, action) where user_id = 'u1' and action in ('pin', 'raise')")
def prefs_read(spark, d):
    from millrace.plans.queries import _prefs

    return store.preferences_of(_prefs(spark), "u1", actions=["pin", "raise"]).select("domain", "action")


@query("""select result_id, row_number() over (order by adjusted desc, arrival) as new_rank from (select result_id, arrival, case p.action when 'pin' then b * 10 when 'raise' then b * 2 when 'lower' then b * 0.5 else coalesce(s, 0.0) end adjusted
from (select result_id, arrival, coalesce(regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), '^www\\.', ''), '') dd, case when isnan(score) then null else score end s, coalesce(case when isnan(score) then null else score end, 1.0 / coalesce(rank, 1)) b from results) r
left join (values ('bids.harrowmere-county.gov.example', 'pin'), ('malga-medhun-clinic.example', 'raise'), ('news.norzock-darsun.example', 'lower'), ('procure.gistmint-barvmarsh.example', 'block')) p(dom, action) on p.dom = r.dd where coalesce(p.action, '') <> 'block')""")
def domain_prefs_rank(spark, d):
    """Rows under a user's preferences in their new order."""
    from millrace.plans.queries import _prefs

    adjusted = store.apply_preferences(table(spark, d, "results"), _prefs(spark))
    return ranking.global_rank(adjusted.select("result_id", "arrival", "adjusted"), F.desc("adjusted"), F.asc("arrival"), out="new_rank").select("result_id", "new_rank")


@query("select url, title, category, active or url in (select url from feed_sources order by url limit 5) as active from feed_sources union all select 'https://new.example/feed', 'New', 'news', true")
def feed_source_upsert(spark, d):
    """Five known sources are switched on and a new one is added."""
    s = table(spark, d, "feed_sources", "url", "title", "category", "active")
    new = s.orderBy("url").limit(5).withColumn("active", F.lit(True)).unionByName(spark.createDataFrame([("https://new.example/feed", "New", "news", True)], s.schema))
    return store.upsert(s, new, ["url"], replace=["active"])


@query("select count(*) n from documents where false")
def store_clear(spark, d):
    return store.cleared(table(spark, d, "documents", "doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) n from events where user_id is not null and ts is not null),
r as (select user_id, n, event_id, true as allowed, [us] as kept from e where n = 1 union all
select user_id, n, event_id, len(f) < 3 as allowed, case when len(f) < 3 then list_append(f, us) else f end as kept from (select e.user_id, e.n, e.event_id, e.us, list_filter(r.kept, lambda x: e.us - x < 21600000000) f from r join e on e.user_id = r.user_id and e.n = r.n + 1))
select user_id, event_id, allowed from r""")
def rate_limit_decisions(spark, d):
    return state.rate_limit(table(spark, d, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 6 * 3600.0).select("user_id", "event_id", "allowed")


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) us, 86400000000 * (1 + event_id % 3) ttl, row_number() over (partition by user_id order by ts, event_id) n from events where user_id is not null and ts is not null),
r as (select user_id, n, event_id, false as hit, us as stored from e where n = 1 union all
select e.user_id, e.n, e.event_id, e.us - r.stored <= e.ttl as hit, case when e.us - r.stored <= e.ttl then r.stored else e.us end as stored from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, event_id, hit from r""")
def cache_ttl_replay(spark, d):
    """Reads whose lifetime differs from row to row."""
    return state.cache_replay(table(spark, d, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", F.lit(86_400) * (1 + F.col("event_id") % 3)).select("user_id", "event_id", "hit")


@query("select to_json({'result_id': result_id, 'url': url, 'source': source})::varchar as value from results")
def export_json(spark, d):
    from millrace.sources import sinks

    return sinks.as_json_lines(table(spark, d, "results", "result_id", "url", "source"))


@query("select result_id, rank, greatest(1, rank - 1) as nudged from results where url in (select url from documents where url is not null)")
def known_nudge(spark, d):
    known = table(spark, d, "documents", "url").where("url is not null").distinct()
    r = table(spark, d, "results", "result_id", "url", "rank").join(known, "url", "left_semi")
    return r.select("result_id", "rank", F.greatest(F.lit(1), F.col("rank") - 1).alias("nudged"))


@query(None)
def insight_assembled(spark, d):
    """The summary of a result set: text of the best three sentences, key points, topics and confidence, one row."""
    rows = table(spark, d, "feed_entries", "entry_row", "title", "description")
    return summary.assembled(rows, "entry_row", "title", "description", "county services")


@query("select doc_id, case when contains(lower(coalesce(url, '')), '.pdf') then 'pdf' when ends_with(lower(coalesce(url, '')), '.docx') then 'docx' when regexp_matches(lower(coalesce(url, '')), '\\.(png|jpe?g|gif|tiff?|webp)$') then 'image' else 'html' end kind from documents")
def content_kinds(spark, d):
    return table(spark, d, "documents", "doc_id", "url").select("doc_id", F.when(F.lower(F.coalesce("url", F.lit(""))).contains(".pdf"), "pdf").otherwise(markup.content_kind(F.lit(None).cast("string"), F.col("url"))).alias("kind"))

