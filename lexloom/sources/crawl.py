"""Crawling: breadth first over a table of pages, or through a fetcher.

Over a table each level is one join of the frontier with the pages; the frontier and the visited pages stay tables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.batches import by_row
from lexloom.functions.html import BLOCK, extract, links, parse
from lexloom.functions.urls import normal, normalized, permitted, resolve, robots, same_host
from lexloom.session import shared_folder, ship

#: At most so many sitemaps, and bytes of a body.
SITEMAPS, MOST_BYTES = 10, 5 * 1024 * 1024


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """url, depth: pages reached from seeds (url) over links (url, target) in at most max_depth steps, each at its least depth.

    Links and levels are written to the shared folder, so pages are parsed once and no level is made again."""
    spark = seeds.sparkSession

    def keep(df: DataFrame) -> DataFrame:
        path = shared_folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    links = keep(links.select("url", "target"))
    seen = frontier = keep(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        found = frontier.select("url").join(links, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        found = keep(found.withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            break
        seen, frontier = seen.unionByName(found), found
    return seen


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", within: bool = False) -> DataFrame:
    """url, target in normal form; within: only between pages of the table.

    A page is parsed for its links alone and they are brought to normal form where it is parsed, so a task needs one Python worker."""

    def of_page(html: str | None, url: str | None) -> tuple[str | None, list[str]]:
        targets = dict.fromkeys(map(normal, links(parse(html or ""), url)))
        return None if url is None else normal(url), [t for t in targets if t is not None]

    own = pages.select(by_row(lambda: of_page, "url string, targets array<string>", F.col(html_col), F.col(url_col)).alias("page"))
    own = own.select("page.url", F.explode("page.targets").alias("target")).distinct()
    if not within:
        return own
    return own.join(pages.select(normalized(F.col(url_col)).alias("target")).distinct(), "target", "left_semi").select("url", "target")


@dataclass
class Crawl:
    """A crawl through fetch: url -> (status, content type, body) or None."""

    fetch: Callable[[str], tuple[int, str, str] | None]
    max_pages: int = 100
    max_depth: int = 5
    same_domain: bool = True
    accept: Callable[[str], bool] = lambda text: True
    rules: dict[str, dict] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def of(self, url: str) -> dict:
        s = urlsplit(url)
        origin = f"{s.scheme}://{s.netloc}"
        if origin not in self.rules:
            got = self.fetch(f"{origin}/robots.txt")
            self.rules[origin] = robots(got[2] if got and got[0] == 200 else "", origin)
        return self.rules[origin]

    def sitemaps(self, urls: list[str], origin: str) -> list[str]:
        import html
        import re

        todo, seen, out = deque(urls), set(), []
        while todo and len(seen) < SITEMAPS:
            url = resolve(todo.popleft(), origin)
            if not url or url in seen:
                continue
            seen.add(url)
            got = self.fetch(url)
            for loc in re.findall(r"(?i)<loc>([^<]+)</loc>", got[2] if got and got[0] == 200 else ""):
                found = resolve(html.unescape(loc.strip()), origin)
                if found:
                    (todo if found.lower().endswith(".xml") or "sitemap" in found.lower() else out).append(found)
        return out

    def begin(self, seed: str) -> tuple[str, list[str]]:
        """The seed in normal form, and the pages that its site's maps name."""
        start = normal(seed)
        if not start:
            raise ValueError(f"not an http(s) URL: {seed}")
        return start, [normal(u) for u in self.sitemaps(self.of(start)["sitemap"], start)]

    def wanted(self, url: str, depth: int, start: str) -> bool:
        return not (self.same_domain and not same_host(start, url) or depth > self.max_depth) and permitted(urlsplit(url).path or "/", self.of(url))

    def taken(self, url: str) -> dict | None:
        """The page, or None; errors say why one that should be there is not."""
        try:
            got = self.fetch(url)
        except Exception as e:  # one page must not stop the crawl
            self.errors.append(f"{url}: {e}")
            return None
        kind = (got[1] or "").partition(";")[0].strip().lower() if got else ""
        if not got or got[0] >= 400 or kind and not (kind.startswith("text/") or kind in ("application/json", "application/xml", "application/xhtml+xml", "application/rss+xml", "application/atom+xml")):
            self.errors.append(f"{url}: not read")
            return None
        if len(got[2].encode("utf-8", "replace")) > MOST_BYTES:
            self.errors.append(f"{url}: too large")
            return None
        page = extract(got[2], url) if not kind or "html" in kind else {"title": url, "text": got[2], "links": [], "code_blocks": []}
        return page if page["text"].strip() and self.accept(page["text"]) else None

    def run(self, seed: str) -> list[dict]:
        """url, depth, title, text, links, code_blocks of each page taken in."""
        start, mapped = self.begin(seed)
        queue = deque([(start, 0)] + [(u, 1) for u in mapped])
        seen, out = set(), []
        while queue and len(out) < self.max_pages:
            url, depth = queue.popleft()
            if not url or url in seen:
                continue
            seen.add(url)
            if not self.wanted(url, depth, start):
                continue
            page = self.taken(url)
            if page is None:
                continue
            out.append({"url": url, "depth": depth} | page)
            if depth < self.max_depth:
                queue += [(normal(u), depth + 1) for u in page["links"]]
        return out


PAGE = f"url string, depth int, nth long, host string, title string, text string, links array<string>, code_blocks array<{BLOCK}>, error string"
FRONTIER = "url string, depth int, nth long, host string"


class SpreadCrawl:
    """A crawl whose frontier is a table, fetched in tasks: all pages of a host by one task at a time, with a pause between them.

    Each level is dealt out by host and taken in rounds of as many pages as are still wanted, in the order in which links were found, so the pages are those that one queue would
    take. Every frontier and round is a table in `folder`; one that is complete is read and not made again, so a crawl that was stopped goes on where it
    was, with the pages it had. make(): called in a task, gives the settings of a Crawl there (its fetch, accept and so on)."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[], Crawl], pace_s: float = 0.0, hosts: int | None = None):
        self.spark, self.folder, self.make, self.pace_s, self.hosts = ship(spark), folder.rstrip("/"), make, pace_s, hosts

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _fetched(self, rows: DataFrame, start: str) -> DataFrame:
        """A row for each URL: the page, or why there is none."""
        make, pace = self.make, self.pace_s

        def run(batches):
            import time

            import pandas as pd

            crawl, last = make(), {}
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    page, before = None, len(crawl.errors)
                    if crawl.wanted(r.url, r.depth, start):
                        if r.host in last:
                            time.sleep(max(0.0, last[r.host] + pace - time.monotonic()))
                        page = crawl.taken(r.url)
                        last[r.host] = time.monotonic()
                    error = crawl.errors[-1] if len(crawl.errors) > before else None
                    page = page or {"title": None, "text": None, "links": None, "code_blocks": None}
                    out.append((r.url, r.depth, r.nth, r.host, page["title"], page["text"], page["links"], page["code_blocks"], error))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FRONTIER.split(", ")] + ["title", "text", "links", "code_blocks", "error"])

        dealt = rows.repartition(self.hosts, "host") if self.hosts else rows.repartition("host")
        return dealt.sortWithinPartitions("host", "nth").mapInPandas(run, PAGE)

    def run(self, seed: str) -> tuple[DataFrame, DataFrame]:
        """The pages taken in (url, depth, nth, title, text, links, code_blocks), in the order of nth within a depth, and the errors (url, error)."""
        crawl = self.make()

        def begin():
            start, mapped = crawl.begin(seed)
            return self.spark.createDataFrame([(u, i) for i, u in enumerate(dict.fromkeys([start, *filter(None, mapped)]))], "url string, nth long")

        first = self._kept("seed", begin)
        start = first.filter("nth = 0").first()["url"]
        host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1), F.lit("")))
        left, pages, seen = crawl.max_pages, None, None
        frontier = first.filter("nth = 0")
        mapped = first.filter("nth > 0")
        for depth in range(crawl.max_depth + 1):
            own = self._kept(f"frontier-{depth}", lambda f=frontier, d=depth, h=host: f.select("url", F.lit(d).alias("depth"), "nth", h.alias("host")))
            seen = own.select("url") if seen is None else seen.unionByName(own.select("url"))
            level, after, turn = None, -1, 0
            while left > 0:
                part = own.filter(F.col("nth") > after).orderBy("nth").limit(left)
                got = self._kept(f"pages-{depth}-{turn}", lambda p=part, s=start: self._fetched(p, s))
                n, taken, after = got.agg(F.count("*"), F.count("text"), F.max("nth")).first()
                if not n:
                    break
                level, left, turn = got if level is None else level.unionByName(got), left - taken, turn + 1
            if level is None:
                break
            pages = level if pages is None else pages.unionByName(level)
            # links in the order of their pages and places; those of the site's maps come first
            links = level.filter("text IS NOT NULL").select(F.col("nth").alias("a"), F.posexplode("links").alias("b", "link")).select("a", F.col("b").cast("long").alias("b"), normalized(F.col("link")).alias("url"))
            if depth == 0:
                links = links.unionByName(mapped.select(F.lit(-1).cast("long").alias("a"), F.col("nth").alias("b"), "url"))
            new = links.filter("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("a", "b")).alias("at")).join(seen, "url", "left_anti")
            frontier = new.orderBy("at").select("url", F.monotonically_increasing_id().alias("nth"))
            if left <= 0:
                break
        none = self.spark.createDataFrame([], PAGE)
        pages = none if pages is None else pages
        return pages.filter("text IS NOT NULL").drop("error", "host").orderBy("depth", "nth"), pages.filter("error IS NOT NULL").select("url", "error")
