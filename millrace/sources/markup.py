"""Feeds, engine answers and pages as sources: parsed in JVM expressions, or for whole HTML in a vectorised UDF."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that carry no page text.
SILENT = {"script", "style", "nav", "header", "footer", "noscript", "template"}
_BLOCK = set("p div section article li ul ol table tr td th h1 h2 h3 h4 h5 h6 br hr main aside form blockquote pre title".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.headers, self.paragraphs, self.tables, self.title = [], [], [], [], ""
        self._quiet, self._open, self._kind, self._cells = 0, None, "", None

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self._quiet += 1
        if tag in _BLOCK:
            self.text.append(" ")
        if tag in ("title", "p", "td", "th") or re.fullmatch(r"h[1-6]", tag):
            self._close()
            self._open, self._kind = [], tag
        if tag == "table":
            self._cells = []

    def handle_endtag(self, tag):
        if tag in SILENT and self._quiet:
            self._quiet -= 1
        if tag in _BLOCK:
            self.text.append(" ")
        if tag == self._kind or tag in ("div", "section", "article", "body", "tr", "table"):
            self._close()
        if tag == "table" and self._cells is not None:
            self.tables.append(self._cells)
            self._cells = None

    def _close(self):
        if self._open is None:
            return
        said, kind = " ".join("".join(self._open).split()), self._kind
        self._open, self._kind = None, ""
        if not said:
            return
        if kind == "title":
            self.title = self.title or said
        elif kind == "p":
            self.paragraphs.append(said)
        elif kind in ("td", "th"):
            if self._cells is not None:
                self._cells.append(said)
        else:
            self.headers.append(said)

    def handle_data(self, data):
        if self._open is not None and not (self._quiet and self._kind != "title"):
            self._open.append(data)
        if not self._quiet and self._kind != "title":
            self.text.append(data)


def parse_html(html: str | None) -> dict:
    """text (spaces collapsed), title (of the page, else its first heading), headers, paragraphs over 20 characters, tables as cell lists. Unclosed tags are tolerated; NULL gives empty parts."""
    p = _Page()
    p.feed(html or "")
    p.close()
    p._close()
    return {"text": " ".join("".join(p.text).split()), "title": p.title or (p.headers[0] if p.headers else ""), "headers": p.headers, "paragraphs": [x for x in p.paragraphs if len(x) > 20], "tables": p.tables}


HTML_TYPE = "struct<text:string,title:string,headers:array<string>,paragraphs:array<string>,tables:array<array<string>>>"


def html_parts(html: Column) -> Column:
    @F.pandas_udf(HTML_TYPE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_html(x) for x in pages], columns=["text", "title", "headers", "paragraphs", "tables"])

    return parse(html)


def parse_docx(data: bytes | None) -> str | None:
    """Text of a DOCX file's paragraphs, or None for what is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, ValueError):
        return None
    paras = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    import html as h

    return "\n".join(h.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", x))) for x in paras)


def content_kind(content_type: Column, url: Column) -> Column:
    """pdf, docx, image or html by header or, failing that, the URL's ending."""
    t, u = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(t.contains("pdf") | u.endswith(".pdf"), "pdf").when(t.contains("wordprocessingml") | u.endswith(".docx"), "docx")
        .when(t.startswith("image/") | u.rlike(r"\.(png|jpe?g|gif|tiff?|webp)$"), "image").otherwise("html")
    )


def documents_of(binary: DataFrame) -> DataFrame:
    """(path, kind, success, text, error) of Spark's ``binaryFile`` rows: HTML and DOCX are read; PDF and pictures need libraries that aren't here and say so."""

    def run(batches):
        for b in batches:
            rows = []
            for path, kind, data in zip(b.path, b.kind, b.content, strict=True):
                if kind == "html":
                    rows.append((path, kind, True, parse_html(bytes(data).decode("utf-8", "replace"))["text"], None))
                elif kind == "docx":
                    text = parse_docx(bytes(data))
                    rows.append((path, kind, text is not None, text, None if text is not None else "not a DOCX file"))
                else:
                    rows.append((path, kind, False, None, f"no reader for {kind}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "success", "text", "error"])

    return binary.select("path", content_kind(F.lit(None).cast("string"), F.col("path")).alias("kind"), "content").mapInPandas(run, "path string, kind string, success boolean, text string, error string")


def rss_items(feeds: DataFrame, url: str = "feed_url", xml: str = "xml") -> DataFrame:
    """(feed_url, place, id, title, link, description, published, author) of RSS items and Atom entries; ones without title or link are dropped; CDATA and tags inside are removed."""

    def part(item: Column, *names: str) -> Column:
        found = [F.nullif(F.regexp_extract(item, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), F.lit("")) for n in names]
        plain = F.regexp_replace(F.coalesce(*found), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        return F.nullif(F.trim(F.regexp_replace(plain, r"<[^>]*>", "")), F.lit(""))

    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    each = feeds.select(F.col(url).alias("feed_url"), F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>.*?</(?:item|entry)>"), F.lit(0))).alias("place", "item"))
    item = F.col("item")
    link = F.coalesce(part(item, "link"), F.nullif(F.regexp_extract(item, r"""(?is)<link[^>]*href=["']([^"']*)["']""", 1), F.lit("")))
    made = each.select("feed_url", "place", F.concat("feed_url", F.lit("-"), F.col("place").cast("string")).alias("id"), unescape(part(item, "title")).alias("title"), unescape(link).alias("link"), unescape(part(item, "description", "summary", "content")).alias("description"), part(item, "pubDate", "published", "updated").alias("published"), unescape(part(item, "author", "dc:creator")).alias("author"))
    return made.where(F.col("title").isNotNull() & F.col("link").isNotNull())


def engine_answers(answers: DataFrame, json: str = "json", prefix: str = "") -> DataFrame:
    """Result rows (query, title, url, description, source, rank) of JSON answers ``{"results": [{title, url, content, engine}]}``; rows without URL or title are dropped."""
    parsed = F.from_json(F.col(json), "struct<query:string,results:array<struct<title:string,url:string,content:string,engine:string>>>")
    each = answers.select(parsed.alias("a")).select("a.query", F.posexplode("a.results").alias("pos", "r"))
    made = each.select("query", "r.title", "r.url", F.coalesce("r.content", F.lit("")).alias("description"), F.concat(F.lit(prefix), F.coalesce("r.engine", F.lit(""))).alias("source"), (F.col("pos") + 1).alias("rank"))
    return made.where(F.coalesce(F.col("url") != "", F.lit(False)) & F.coalesce(F.col("title") != "", F.lit(False)))


def blocked_page(html: Column) -> Column:
    """Whether a page is an answer to a robot."""
    return F.coalesce(html.contains("Access Denied") | html.contains("captcha") | html.contains("bot detection"), F.lit(False))
