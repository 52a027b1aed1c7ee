"""URLs: hosts, normal forms, titles, robots and sitemaps."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORTS = {"http": 80, "https": 443}


def host(url: Column) -> Column:
    """Lower-case host without one leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def title_from_url(url: Column) -> Column:
    """Last part of the path, percent-decoded, else the host, else ''."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    last = F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.when(F.size(parts) > 0, F.try_url_decode(last)), F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def resolve(value: str, base: str | None = None) -> str | None:
    """Absolute http(s) URL with single slashes in its path, or None."""
    try:
        s = urlsplit(urljoin(base, value.strip()) if base else value.strip())
        if s.scheme not in DEFAULT_PORTS or not s.hostname:
            return None
        port = f":{s.port}" if s.port and s.port != DEFAULT_PORTS[s.scheme] else ""
        user = s.netloc.rpartition("@")[0]
        name = s.hostname if s.hostname.isascii() else s.hostname.encode("idna").decode()
    except ValueError:
        return None
    path, out = quote(re.sub(r"/+", "/", s.path or "/"), safe="/%:@!$&'()*+,;=~-._[]|^"), []
    for part in path.split("/"):
        if part in (".", ".."):
            if part == ".." and len(out) > 1:
                out.pop()
        else:
            out.append(part)
    if path.rsplit("/", 1)[-1] in (".", ".."):
        out.append("")
    keep = "/%:@!$&'()*+,;=~-._[]|^?`{}"
    return urlunsplit((s.scheme, (f"{user}@" if user else "") + name + port, "/".join(out) or "/", quote(s.query, safe=keep), quote(s.fragment, safe=keep + "#")))


def normal(value: str, base: str | None = None) -> str | None:
    """resolve() without the fragment and the path's closing slash: the form in which URLs are compared."""
    found = resolve(value, base)
    if found is None:
        return None
    s = urlsplit(found)
    return urlunsplit((s.scheme, s.netloc, s.path.rstrip("/") or "/", s.query, ""))


def normalized(url: Column) -> Column:
    return F.pandas_udf(lambda x: x.map(lambda u: None if u is None else normal(u)), "string")(url)


def same_host(a: str, b: str) -> bool:
    x, y = ((urlsplit(u).hostname or "").lower().removeprefix("www.") for u in (a, b))
    return x == y


def title_of(url: str | None) -> str:
    try:
        s = urlsplit(url or "")
        parts = [p for p in s.path.split("/") if p]
        return unquote(parts[-1], errors="strict") if parts else s.hostname or ""
    except ValueError:
        return ""


def robots(text: str, origin: str) -> dict[str, list[str]]:
    """allow, disallow and sitemap lines that hold for any agent."""
    out: dict[str, list[str]] = {"allow": [], "disallow": [], "sitemap": []}
    applies, ruled = False, False
    for line in text.splitlines():
        key, colon, value = line.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not key or not colon or not value and key != "disallow":
            continue
        if key == "user-agent":
            applies, ruled = (applies and not ruled) or value == "*", False
        elif key == "sitemap":
            out["sitemap"] += [u for u in [resolve(value, origin)] if u]
        elif key in ("allow", "disallow"):
            ruled = True
            if applies and value:
                out[key].append(value)
    return out


def permitted(path: str, rules: dict[str, list[str]]) -> bool:
    """The longest rule that the path begins with decides, allow before disallow; rules count up to their first star."""

    def reach(kind: str) -> int:
        return max((len(r) for r in (x.partition("*")[0].strip() for x in rules[kind]) if r and path.startswith(r)), default=0)

    return reach("allow") >= reach("disallow")
