"""HTTP with a time limit: pages for the crawl up to a number of bytes, and JSON for models."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

from lexloom.sources.crawl import MOST_BYTES

AGENT = "lexloom/1.0"


def fetch(url: str, timeout_s: float = 15.0, most: int = MOST_BYTES) -> tuple[int, str, str]:
    """Status, content type and text. A body of more than `most` bytes is an error, by its header or as it comes."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": "text/html,text/plain,application/xml;q=0.9,*/*;q=0.5"})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:  # noqa: S310  callers pass http(s) URLs only
            if int(answer.headers.get("Content-Length") or 0) > most:
                raise ValueError(f"{url}: more than {most} bytes")
            data = answer.read(most + 1)
            if len(data) > most:
                raise ValueError(f"{url}: more than {most} bytes")
            return answer.status, answer.headers.get("Content-Type") or "", data.decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, "", ""
    except TimeoutError as e:
        raise TimeoutError(f"{url}: no answer in {timeout_s} s") from e


def post(url: str, headers: dict[str, str], body: dict, timeout_s: float = 30.0) -> dict:
    """A JSON answer to a JSON body."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "User-Agent": AGENT} | headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:  # noqa: S310
            return json.loads(answer.read())
    except TimeoutError as e:
        raise TimeoutError(f"{url}: no answer in {timeout_s} s") from e
