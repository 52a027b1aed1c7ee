"""Query plans as lists of steps with an estimated cost. Spark's own optimizer decides; this describes."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: The cost of each kind of step.
COSTS = {"scalar_filter": 10, "keyword_search": 15, "tag_filter": 20, "vector_search": 50, "limit": 5}


@dataclass(frozen=True)
class Step:
    kind: str
    cost: int
    detail: str = ""


def plan(vector: bool = True, filters: int = 0, tags: bool = False, keywords: bool = False, limit: int | None = 10) -> list[Step]:
    steps = [Step("scalar_filter", COSTS["scalar_filter"], f"{filters} filters")] if filters else []
    steps += [Step("tag_filter", COSTS["tag_filter"])] if tags else []
    steps += [Step("keyword_search", COSTS["keyword_search"])] if keywords else []
    steps += [Step("vector_search", COSTS["vector_search"])] if vector else []
    return steps + ([Step("limit", COSTS["limit"], str(limit))] if limit is not None else [])


def optimized(steps: list[Step]) -> list[Step]:
    """Filters before the vector search; a limit stays last, as before the search it would change results."""
    rank = {"scalar_filter": 0, "tag_filter": 1, "keyword_search": 2, "vector_search": 3, "limit": 4}
    return sorted((replace(s) for s in steps), key=lambda s: rank.get(s.kind, 3))


def total(steps: list[Step]) -> int:
    return sum(s.cost for s in steps)


def estimate(rows: int, filters: int) -> int:
    return 10 + math.ceil(5 * math.log2(max(rows, 1))) + 5 * filters + 5
