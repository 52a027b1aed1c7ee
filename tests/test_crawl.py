"""A crawl in tasks against the crawl of one queue."""

import random
from pathlib import Path

import pytest

from lexloom.sources.crawl import Crawl, SpreadCrawl


def site(seed, n=40, hosts=3):
    """Pages of several hosts with links among them, some missing, empty, forbidden or of another kind."""
    rng = random.Random(seed)
    at = lambda i: f"https://h{i % hosts}.e.com/{'no/' if i % 11 == 5 else ''}p{i}"
    out = {}
    for i in range(n):
        links = "".join(f'<a href="{at(rng.randrange(n + 5))}#x">l</a>' for _ in range(4))
        out[at(i)] = (200, "image/png" if i % 13 == 7 else "text/html", f"<title>t{i}</title><p>{'' if i % 17 == 9 else f'words of {i}'}</p>{links}")
    for h in range(hosts):
        out[f"https://h{h}.e.com/robots.txt"] = (200, "text/plain", "User-agent: *\nDisallow: /no\nSitemap: /map.xml")
    out["https://h0.e.com/map.xml"] = (200, "text/xml", f"<loc>{at(8)}</loc><loc>{at(3)}</loc>")
    return at(0), out


def crawls(pages, log=None, **options):
    def fetch(url):
        if log:
            with open(log, "a") as f:
                f.write(url + "\n")
        return pages.get(url, (404, "", ""))

    return lambda: Crawl(fetch, **options)


@pytest.mark.parametrize("options", [{"same_domain": False, "max_pages": 100}, {"same_domain": False, "max_pages": 9}, {"same_domain": True}, {"same_domain": False, "max_depth": 1}, {"max_pages": 1}])
def test_equal_to_the_queue(spark, tmp_path, options):
    start, pages = site(1)
    make = crawls(pages, **options)
    want = make().run(start)
    got, errors = SpreadCrawl(spark, str(tmp_path / "c"), make, hosts=2).run(start)
    rows = got.collect()
    assert [(r["url"], r["depth"], r["title"], r["text"], list(r["links"])) for r in rows] == [(p["url"], p["depth"], p["title"], p["text"], p["links"]) for p in want]
    if options.get("max_pages") == 100:
        queue = make()
        queue.run(start)
        assert sorted(r["error"] for r in errors.collect()) == sorted(queue.errors)


def test_goes_on_where_it_was(spark, tmp_path):
    """A crawl that broke off takes up its written rounds, and fetches only what is missing."""
    start, pages = site(2)
    log, folder = tmp_path / "log", str(tmp_path / "c")
    make = crawls(pages, str(log), same_domain=False)
    whole = [tuple(r)[:5] for r in SpreadCrawl(spark, folder, make).run(start)[0].collect()]
    first = len([x for x in log.read_text().split() if "/p" in x])
    for p in Path(folder).glob("pages-2-0/_SUCCESS"):
        p.unlink()  # this round was not ended
    log.write_text("")
    again = [tuple(r)[:5] for r in SpreadCrawl(spark, folder, make).run(start)[0].collect()]
    fetched = [x for x in log.read_text().split() if "/p" in x]
    assert again == whole and 0 < len(fetched) < first


def test_pace_of_a_host(spark, tmp_path):
    import time

    start, pages = site(3, n=6, hosts=1)
    began = time.monotonic()
    got, _ = SpreadCrawl(spark, str(tmp_path / "c"), crawls(pages, same_domain=False), pace_s=0.5, hosts=1).run(start)
    assert got.count() >= 4 and time.monotonic() - began > 1
    assert SpreadCrawl(spark, str(tmp_path / "d"), crawls({})).run("https://e.com/")[0].count() == 0
    with pytest.raises(ValueError):
        SpreadCrawl(spark, str(tmp_path / "e"), crawls({})).run("ftp://e.com/")
