"""Registry of the core queries. Each takes (spark, data directory); the SQL of those that SQL expresses is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import extraction, ranking, retrieval, search, signals, store, summary
from millrace.operators.instants import normalise_instants
from millrace.plans import lens
from millrace.sources import markup, sinks
from millrace.sources.tables import table

QUERY = "occupational health services request for proposal"
SEARCHES = ["Request for Proposal occupational health services", "occupational health services RFP county PDF", "DOT physical cash price", "pulmonary function test pricing", "site:.gov occupational medicine bid", "SAM.gov occupational health services"]
PREFERENCES = [("u1", "bids.harrowmere-county.gov.example", "pin"), ("u1", "WWW.malga-medhun-clinic.example", "raise"), ("u1", "news.norzock-darsun.example", "lower"), ("u1", "procure.gistmint-barvmarsh.example", "block"), ("u1", "dorpa-pedmwick-clinic.example", "ignore")]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark, d, *more):
    return table(spark, d, "documents", "doc_id", "text", *more)


def results(spark, d):
    return table(spark, d, "results")


# ── training-data operator of the core ──
@query
def p5_found(spark, d):
    opp = table(spark, d, "opportunities", "opp_row", "source", "due_date", "posted_date")
    return normalise_instants(opp, "opp_row", ["due_date", "posted_date"], "source", table(spark, d, "source_registry"))


# ── terms, BM25, vectors ──
@query
def term_frequency(spark, d):
    return retrieval.term_frequency(docs(spark, d), "doc_id", "text").select("doc_id", "term", "tf")


@query
def document_frequency(spark, d):
    return retrieval.document_frequency(retrieval.term_frequency(docs(spark, d), "doc_id", "text"))


@query
def doc_length_stats(spark, d):
    return docs(spark, d).select(F.coalesce(F.size(T.terms(F.col("text"))), F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.greatest("n", F.lit(0))), 6).alias("avg_len"), F.max("n").alias("max_len"))


@query
def bm25_score(spark, d):
    return retrieval.bm25(docs(spark, d), QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, d):
    return ranking.top(bm25_score(spark, d), 10, F.desc("score"), F.asc("doc_id"))


@query
def tf_hash_embedding(spark, d):
    return retrieval.hashed_vectors(retrieval.term_frequency(docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "bucket", F.round("val", 6).alias("val"))


@query
def semantic_rerank(spark, d):
    near = retrieval.term_cosine(docs(spark, d), QUERY).select("doc_id", F.round("similarity", 6).alias("similarity"))
    return ranking.top(near, 10, F.desc("similarity"), F.asc("doc_id"))


@query
def hybrid_topk(spark, d):
    both = retrieval.hybrid(docs(spark, d), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))
    return ranking.top(both, 10, F.desc("score"), F.asc("doc_id"))


@query
def hash_embedding_384(spark, d):
    v = retrieval.hash_embedding(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.posexplode(v).alias("slot", "v")).select("doc_id", "slot", F.round("v", 6).alias("v"))


@query
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    first = v.orderBy("vec_id").limit(1)
    near = retrieval.nearest(v, first, 10)
    return near.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def knn_label_join(spark, d):
    """For every vector whose id is divisible by 20 its five nearest of all, and whether the labels agree."""
    v = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    near = retrieval.nearest(v, v.where(F.col("vec_id") % 20 == 0), 5)
    named = near.join(v.select("vec_id", F.col("label").alias("near_label")), "vec_id").join(v.select(F.col("vec_id").alias("query"), "label"), "query")
    return named.select("query", "vec_id", "place", F.round("similarity", 6).alias("similarity"), (F.col("label") == F.col("near_label")).alias("same_label"))


@query
def text_match_counts(spark, d):
    counts = [F.regexp_count(F.lower("text"), F.lit(w)) for w in ("county", "health", "review")]
    scored = docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", sum(counts[1:], counts[0]).alias("score")).where("score > 0")
    return ranking.top(scored, 20, F.desc("score"), F.asc("doc_id"))


@query
def ilike_search(spark, d):
    return docs(spark, d, "created_at").where(F.col("text").ilike("%bilingual coordinator%")).orderBy(F.desc("created_at"), "doc_id").limit(25).select("doc_id", F.col("created_at").cast("string").substr(1, 19).alias("created"))


@query
def feed_search(spark, d):
    """Entries with every word, newest first, ones without a time before all."""
    e = table(spark, d, "feed_entries")
    text = F.concat_ws(" ", "title", "description", "content")
    return e.where(retrieval.contains_all(text, "review schedule")).orderBy(F.col("published_at").desc_nulls_first(), "entry_row").limit(50).select("entry_row", "title", "feed_url")


@query
def feed_search_stemmed(spark, d):
    e = table(spark, d, "feed_entries")
    text = F.concat_ws(" ", "title", "description", "content")
    return e.where(retrieval.contains_all_stemmed(text, "reviewing schedules")).orderBy(F.col("published_at").desc_nulls_first(), "entry_row").limit(50).select("entry_row", "title", "feed_url")


@query
def feed_text_hits(spark, d):
    e = table(spark, d, "feed_entries")
    return e.where(retrieval.contains_all(F.concat_ws(" ", "title", "description", "content"), "contractor agreement")).select("entry_row")


# ── URLs and spam ──
@query
def url_domain(spark, d):
    return results(spark, d).select("result_id", U.domain(F.col("url")).alias("domain"), U.parameters(F.col("url")).alias("n_params"))


@query
def url_encode_decode(spark, d):
    q = results(spark, d).where(F.col("title").isNotNull()).select("result_id", F.concat(F.lit("/url?q="), U.encode_component(F.col("title"))).alias("href"))
    return q.select("result_id", U.unwrap_redirect(F.col("href")).alias("target"))


@query
def url_spam_score(spark, d):
    p = U.url_penalties(F.col("url"))
    return results(spark, d).select("result_id", U.total(p).alias("score"), F.array_join(U.reasons(p), ", ").alias("reasons"))


@query
def domain_trust(spark, d):
    return results(spark, d).select(U.host(F.col("url")).alias("host")).distinct().select("host", F.round(U.trust(F.col("host")), 6).alias("trust"))


@query
def combined_spam(spark, d):
    return results(spark, d).select("result_id", F.round(U.combined_spam(F.col("url"), F.col("description")), 6).alias("spam"))


@query
def content_spam(spark, d):
    p = U.content_penalties(F.col("text"))
    return docs(spark, d).where(F.col("text").isNotNull()).select("doc_id", U.total(p).alias("score"), F.array_join(U.reasons(p), ", ").alias("reasons"))


@query
def spam_adjusted_score(spark, d):
    r = results(spark, d).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return r.select("result_id", F.round(F.col("score") * F.pow(F.lit(0.5), U.combined_spam(F.col("url"))), 6).alias("adjusted"))


# ── deduplication, ranks, set operations ──
@query
def dedupe_first(spark, d):
    return ranking.keep_first(results(spark, d), "url", "arrival").select("url", "result_id", "source")


def _boosted(spark, d):
    first = ranking.keep_first(results(spark, d), "url", "arrival")
    dom = F.coalesce(F.nullif(F.col("domain"), F.lit("")), U.domain(F.col("url")))
    score = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)) + signals.lens_boost("procurement", dom, F.col("url"), F.col("title"), F.col("description"))
    return first.select("result_id", "arrival", F.round(score, 6).alias("score"))


@query
def lens_boost_rank(spark, d):
    return ranking.global_rank(_boosted(spark, d), F.desc("score"), F.asc("arrival")).select("result_id", "score", "rank")


@query
def source_rank(spark, d):
    return ranking.group_rank(results(spark, d), "source", F.asc("arrival")).select("result_id", "source", F.col("rank_in_group").cast("bigint").alias("rank_in_source"))


@query
def source_counts(spark, d):
    return results(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


@query
def usable_results(spark, d):
    r = results(spark, d)
    return r.where((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.length(F.trim(F.coalesce("description", F.lit("")))) > 50)).select("result_id")


@query
def union_sources(spark, d):
    """Rows of engines and feeds in one list, first of each URL."""
    r = results(spark, d).select("url", "title", "source", F.col("arrival").alias("ord"))
    e = table(spark, d, "feed_entries").select("url", "title", F.lit("small-web").alias("source"), (F.col("entry_row") + 1_000_000_000).alias("ord"))
    return ranking.keep_first(r.unionByName(e).where("url <> '' and title <> ''"), "url", "ord")


@query
def joined_texts(spark, d):
    """Descriptions of a URL joined in order of arrival, in parts of up to 1,000 rows, so that a hot URL is no one task's."""
    r = ranking.group_rank(results(spark, d).where(F.col("description").isNotNull()).select("url", "arrival", "description"), "url", F.asc("arrival"))
    return r.groupBy("url", F.floor((F.col("rank_in_group") - 1) / 1000).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "description"))), lambda x: x["description"]), " ").alias("text"))


# ── signals, lenses ──
@query
def page_signals(spark, d):
    return docs(spark, d, "url").select("doc_id", F.explode(signals.signals(F.col("text"), F.col("url"))).alias("s")).select("doc_id", "s.name", "s.score")


@query
def page_confidence(spark, d):
    total = F.aggregate(signals.signals(F.col("text")), F.lit(0), lambda s, x: s + x["score"])
    return docs(spark, d).select("doc_id", signals.confidence(total).alias("confidence"))


@query
def intelligence_summary(spark, d):
    return signals.intelligence(docs(spark, d).where(F.col("text").isNotNull()), "text", "doc_id")


@query
def classify_queries(spark, d):
    return table(spark, d, "feed_entries", "entry_row", "title").select("entry_row", lens.classify(F.col("title")).alias("lens"))


@query
def expand_queries(spark, d):
    rows = [(q, e["lens"], i, x) for q in SEARCHES for e in [lens.expand(q)] for i, x in enumerate([*e["expansions"], *e["operators"]])]
    return spark.createDataFrame(rows, "query string, lens string, place int, expansion string")


@query
def query_plan(spark, d):
    return spark.createDataFrame([(q, i, x) for q in SEARCHES for i, x in enumerate(lens.plan(q))], "query string, place int, sent string")


@query
def suggestions(spark, d):
    return lens.suggestions(table(spark, d, "part", F.col("p_name").alias("query")).distinct())


# ── preferences and keyed tables ──
def _prefs(spark):
    return store.checked_preferences(spark.createDataFrame(PREFERENCES, "user_id string, domain string, action string"))


@query
def domain_prefs_apply(spark, d):
    return store.apply_preferences(results(spark, d), _prefs(spark)).select("result_id", F.round("adjusted", 6).alias("adjusted"))


@query
def prefs_upsert(spark, d):
    old = _prefs(spark)
    new = store.checked_preferences(spark.createDataFrame([("u1", "malga-medhun-clinic.example", "block"), ("u2", "www.new.example", "pin")], "user_id string, domain string, action string"))
    return store.upsert(old, new, ["user_id", "domain"])


@query
def prefs_delete(spark, d):
    return store.delete(_prefs(spark), spark.createDataFrame([("u1", "news.norzock-darsun.example")], "user_id string, domain string"), ["user_id", "domain"])


@query
def opportunities_upsert(spark, d):
    """Notices fetched last win; the stored creation time of a notice stays that of its first fetch."""
    o = table(spark, d, "opportunities", "opp_row", "id", "title", "status", "fetched_at")
    order = F.struct("fetched_at", "opp_row")
    old = o.where("opp_row % 2 = 0").groupBy("id").agg(F.max_by(F.struct("title", "status"), order).alias("r"), F.min("fetched_at").alias("created_at")).select("id", "r.*", "created_at")
    new = store.last_of_batch(o.where("opp_row % 2 = 1"), ["id"], order).select("id", "title", "status", F.col("fetched_at").alias("created_at"))
    return store.upsert(old, new, ["id"], keep=["created_at"]).select("id", "title", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query
def documents_upsert(spark, d):
    """Documents in two batches: a known id takes the new row, its creation time stays."""
    dd = table(spark, d, "documents", "doc_id", "id", "title", "lens", "created_at")
    order = F.struct("created_at", "doc_id")
    old = store.last_of_batch(dd.where("doc_id % 4 <> 0"), ["id"], order)
    new = store.last_of_batch(dd.where("doc_id % 4 = 0"), ["id"], order)
    return store.upsert(old, new, ["id"], keep=["created_at"]).select("id", "title", "lens", "doc_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query
def feed_upsert(spark, d):
    """Entries in two batches: the second replaces title, description, content and time of known ids, the other columns stay."""
    e = table(spark, d, "feed_entries").drop("feed_title", "author")
    order = F.struct("created_at", "entry_row")
    old = store.last_of_batch(e.where("entry_row % 3 <> 0"), ["id"], order)
    new = store.last_of_batch(e.where("entry_row % 3 = 0"), ["id"], order)
    return store.upsert(old, new, ["id"], replace=["title", "description", "content", "published_at"]).select("id", "title", "description", "category", "entry_row")


@query
def feed_touch(spark, d):
    s = table(spark, d, "feed_sources")
    return s.select("url", F.when(F.col("active"), F.lit("2030-01-01 00:00:00")).otherwise(F.date_format("last_fetched", "yyyy-MM-dd HH:mm:ss")).alias("last_fetched"))


@query
def active_feed_entries(spark, d):
    s = table(spark, d, "feed_sources", "url", "active").where("active").select(F.col("url").alias("feed_url"))
    return table(spark, d, "feed_entries", "entry_row", "feed_url").join(s, "feed_url", "left_semi")


@query
def feed_cascade_delete(spark, d):
    gone = table(spark, d, "feed_sources", "url", "active").where("not active").select(F.col("url").alias("feed_url"))
    return store.delete(table(spark, d, "feed_entries", "entry_row", "feed_url"), gone, ["feed_url"])


@query
def index_batch(spark, d):
    """What the store takes from a search, of the best twenty: id, text, lens, source, metadata with the rank, and the first entries of the 384 of its hash embedding."""
    top = ranking.top(_boosted(spark, d), 20, F.desc("score"), F.asc("arrival"))
    top = ranking.global_rank(top, F.desc("score"), F.asc("arrival")).withColumnRenamed("rank", "place")
    top = top.join(results(spark, d).select("result_id", "url", "title", "description", "source"), "result_id")
    text = F.concat_ws(" ", "title", "description")
    made = top.select(F.col("url").alias("id"), text.alias("text"), F.lit("procurement").alias("lens"), "source", F.to_json(F.struct(F.col("place").alias("rank"), "score")).alias("metadata"), retrieval.hash_embedding(text).alias("v"))
    return made.select("id", "text", "lens", "source", F.get_json_object("metadata", "$.rank").cast("bigint").alias("rank"), F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("v0"), F.round(F.get("v", F.lit(383)), 6).alias("v383"))


@query
def rank_nudge(spark, d):
    """Rows that the vector store knows move up one rank."""
    known = table(spark, d, "documents", "url").where("url is not null").distinct()
    r = results(spark, d).join(known.withColumn("hit", F.lit(True)), "url", "left")
    return r.select("result_id", F.when(F.col("hit"), F.greatest(F.lit(1), F.col("rank") - 1)).otherwise(F.col("rank")).alias("rank"))


# ── extraction ──
@query
def extract_entities(spark, d):
    e = extraction.entities(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", e.alias("e")).select("doc_id", *[F.array_join(f"e.{x}", " | ").alias(x) for x in ("emails", "phones", "urls", "dates", "money")])


@query
def extract_contacts(spark, d):
    o = table(spark, d, "opportunities", "opp_row", "contact_email", "contact_phone", "document_url")
    text = F.concat_ws(" ", F.lit("Contact:"), "contact_email", F.lit("fax:"), "contact_phone", "document_url")
    return o.select("opp_row", F.explode(extraction.contacts(text)).alias("c")).select("opp_row", "c.type", "c.value", "c.label", "c.confidence")


def composed(spark, d):
    """Texts in which the record patterns occur: notices with labelled parts."""
    o = table(spark, d, "opportunities")
    text = F.concat_ws(
        " ", "title", F.lit(". Due date:"), "due_date", F.lit(". Posted:"), "posted_date", F.lit("by"), "organization", F.concat(F.lit(". Phone: "), "contact_phone"), "contact_email", "monetary_value", F.lit("."), "description",
        F.concat(F.lit("Journal: Review of "), "opportunity_type", F.lit(". By: Ann Lee, Bo Ray. doi: 10.10/"), F.col("opp_row").cast("string"), F.lit(" cited by: "), (F.col("opp_row") % 90).cast("string"), F.lit(". Summary: "), "status", F.lit(".")),
        F.concat(F.lit("Company: "), "organization", F.lit(". Form: 10-K Quarter: Q"), (F.col("opp_row") % 4 + 1).cast("string"), F.lit(". Revenue: $"), (F.col("opp_row") * 7).cast("string")),
    )
    return o.select("opp_row", F.regexp_replace(text, r"[\r\n\v]+", " ").alias("text"), F.coalesce("source_url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"))


def _extract(name):
    def run(spark, d):
        r = composed(spark, d).select("opp_row", extraction.record(name, F.col("text"), F.col("url"), F.col("title")).alias("r")).select("opp_row", "r.*")
        return r.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in r.dtypes])

    run.__name__ = f"extract_{name}"
    return run


for _lens in extraction.LENSES:
    query(_extract(_lens))


@query
def extract_routed(spark, d):
    dd = table(spark, d, "documents", "doc_id", "lens", "text", "url", "title")
    r = dd.select("doc_id", "lens", extraction.route(F.col("lens"), F.col("text"), F.col("url"), F.col("title")).alias("r"))
    return r.select("doc_id", "lens", F.coalesce(*[F.col(f"r.{x}.confidence") for x in extraction.LENSES]).alias("confidence"))


# ── sources and sinks ──
@query
def rss_parse(spark, d):
    """Feeds written as RSS, a document a feed and hour, and read back."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    e = table(spark, d, "feed_entries").where("title is not null and url is not null")
    item = F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><link>"), esc(F.col("url")), F.lit("</link><description>"), esc(F.col("description")), F.lit("</description></item>"))
    feeds = e.groupBy(F.concat_ws("#", "feed_url", "entry_row").alias("feed_url")).agg(F.concat(F.lit("<rss><channel>"), F.max(item), F.lit("</channel></rss>")).alias("xml"))
    return markup.rss_items(feeds).select(F.substring_index("feed_url", "#", -1).cast("bigint").alias("entry_row"), "title", "link", F.coalesce("description", F.lit("")).alias("description"))


@query
def engine_json_parse(spark, d):
    r = results(spark, d).where("source like 'searxng-%'")
    answers = r.select(F.to_json(F.struct(F.col("result_id").cast("string").alias("query"), F.array(F.struct("title", "url", F.col("description").alias("content"), F.regexp_replace("source", "^searxng-", "").alias("engine"))).alias("results"))).alias("json"))
    return markup.engine_answers(answers, prefix="searxng-").select(F.col("query").cast("bigint").alias("result_id"), "title", "url", "description", "source")


@query
def html_extract(spark, d):
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    x = table(spark, d, "documents", "doc_id", "title", "text").where("text is not null")
    page = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title><script>var a = 1 < 2;</script></head><body><nav>Menu</nav><h1>"), esc(F.col("title")), F.lit("</h1><p>"), esc(F.col("text")), F.lit("<footer>Foot</footer></body></html>"))
    made = x.select("doc_id", markup.html_parts(page).alias("p"))
    return made.select("doc_id", "p.title", F.size("p.headers").alias("n_headers"), F.size("p.paragraphs").alias("n_paragraphs"))


@query
def export_csv(spark, d):
    return sinks.as_csv_lines(results(spark, d), "title", "description", "url", "source")


@query
def export_csv_metadata(spark, d):
    return sinks.csv_with_metadata(results(spark, d), 'county "services"', "government", "2026-01-31T00:00:00Z", "title", "url", "description", "source")


# ── summaries ──
def _summary_rows(spark, d):
    return table(spark, d, "feed_entries", "entry_row", "title", "description")


@query
def idf_words(spark, d):
    return summary.word_weights(_summary_rows(spark, d), "entry_row", "description").select("word", F.round("weight", 6).alias("weight"))


@query
def sentence_rank(spark, d):
    r = summary.ranked_sentences(_summary_rows(spark, d), "entry_row", "title", "description").select("entry_row", "pos", "sentence", F.round("score", 6).alias("score"))
    return ranking.top(r, 3, F.desc("score"), F.asc("entry_row"), F.asc("pos"))


@query
def sentence_scores(spark, d):
    return summary.ranked_sentences(_summary_rows(spark, d), "entry_row", "title", "description").select("entry_row", "sentence", F.round("score", 6).alias("score"))


@query
def key_points(spark, d):
    return summary.key_points(_summary_rows(spark, d), "entry_row", "title", "description")


@query
def bigram_topics(spark, d):
    return summary.bigrams(_summary_rows(spark, d), "entry_row", "description")


# ── pipeline ──
@query
def search_general(spark, d):
    return search.search(results(spark, d), "drug screening services county", "government", known=table(spark, d, "documents", "url"))


@query
def search_procurement(spark, d):
    return search.search(results(spark, d), "request for proposals road resurfacing", k=30, known=table(spark, d, "documents", "url"))


@query
def search_insight(spark, d):
    return search.insight(search.candidates(results(spark, d), ["road resurfacing bids"]))


@query
def history_filter(spark, d):
    """Stored searches whose text contains a term, whatever its case."""
    return table(spark, d, "part", "p_partkey", "p_name").where(F.contains(F.lower("p_name"), F.lit("a"))).select("p_partkey")


FLAGSHIP = search_general
from millrace.plans import rows as _rows  # noqa: E402
from millrace.plans.oracle import ORACLE as _SQL  # noqa: E402

QUERIES.update(_rows.QUERIES)
ORACLE = {**_SQL, **_rows.ORACLE}

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
