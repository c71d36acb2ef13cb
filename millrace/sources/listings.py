"""Result lists in HTML as a source: one parser for every engine and portal, told where things are by a small table."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Of each site the selectors of an item and, within it, of title, link and snippet, the prefix of relative links, and the default body. Selectors name a tag, classes, or both.
SITES = {
    "duckduckgo": (".result", ".result__a", ".result__a", ".result__snippet", "https:", ""),
    "bing": ("li.b_algo", "h2", "a", ".b_caption", "https://www.bing.com", ""),
    "google": (".g", "h3", "a", ".VwiC3b", "https://www.google.com", ""),
    "sam.gov": (".usa-card,.solicitation-card,.card,.listing,.opportunity,.result", ".usa-card__heading,.title,h3,h4,h2,.heading", "a", ".org-name,.agency,.organization,.entity,.department,.office", "https://sam.gov", "Federal Agency"),
    "portal": (".card,.listing,.opportunity,.result,.row", ".title,h3,h4,h2,.heading", "a", ".agency,.organization,.entity,.department,.office", "", "Government Agency"),
}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


def _match(selectors: str, tag: str, classes: set[str]) -> bool:
    for s in selectors.split(","):
        want, *named = s.strip().split(".")
        if (not want or want == tag) and all(c in classes for c in named):
            return True
    return False


class _Listing(HTMLParser):
    def __init__(self, site: tuple):
        super().__init__(convert_charrefs=True)
        self.item, self.parts, self.link_at = site[0], {"title": site[1], "snippet": site[3]}, site[2]
        self.depth, self.items, self.now, self.at, self.open = 0, [], None, 0, {}

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        classes = set((values.get("class") or "").split())
        if tag not in _VOID:
            self.depth += 1
        if self.now is None and _match(self.item, tag, classes):
            self.now, self.at = {"title": None, "link": None, "snippet": None}, self.depth
        if self.now is None:
            return
        for part, s in self.parts.items():
            if self.now[part] is None and _match(s, tag, classes):
                self.now[part], self.open[part] = "", self.depth
        if self.now["link"] is None and values.get("href") and (_match(self.link_at, tag, classes) or tag == "a" and self.link_at == "a"):
            self.now["link"] = values["href"]

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        for part in [p for p, d in self.open.items() if d == self.depth]:
            del self.open[part]
        if self.now is not None and self.depth == self.at:
            self.items.append(self.now)
            self.now, self.open = None, {}
        self.depth -= 1

    def handle_data(self, data):
        if self.now is not None:
            for part in self.open:
                self.now[part] += data


def parse_listing(html: str | None, site: str) -> list[tuple[str, str, str]]:
    """(title, url, snippet) of each item that has a title and a link, relative links completed."""
    p = _Listing(SITES[site])
    p.feed(html or "")
    p.close()
    out = []
    for x in [*p.items, *([p.now] if p.now else [])]:
        title, link = " ".join((x["title"] or "").split()), (x["link"] or "").strip()
        if title and link:
            out.append((title, link if link.startswith("http") else SITES[site][4] + link, " ".join((x["snippet"] or "").split()) or SITES[site][5]))
    return out


def listings(pages: DataFrame, site: str) -> DataFrame:
    """(page, rank, title, url, snippet) of ``pages`` (page, html) of one site, each URL once a page; NULL pages have no row. Unclosed tags are tolerated."""
    kind = "array<struct<title:string,url:string,snippet:string>>"

    @F.pandas_udf(kind)
    def parse(html: pd.Series) -> pd.Series:
        def one(h):
            seen: set[str] = set()
            return [{"title": t, "url": u, "snippet": s} for t, u, s in parse_listing(h, site) if not (u in seen or seen.add(u))]

        return html.map(one)

    each = pages.select("page", F.posexplode(parse(F.coalesce("html", F.lit("")))).alias("pos", "r"))
    return each.select("page", (F.col("pos") + 1).alias("rank"), "r.title", "r.url", "r.snippet")
