"""Small process-local stores of the driver: results, vectors and connections that are used again. Tables are never held here."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator, MutableMapping
from contextlib import contextmanager
from queue import Empty, LifoQueue


class Lru:
    """At most `size` values; the one unused for longest goes first. With a time to live, older values count as gone."""

    def __init__(self, size: int = 1000, ttl_s: float | None = None, clock: Callable[[], float] = time.monotonic):
        if size < 1:
            raise ValueError("a cache holds one value at least")
        self.size, self.ttl_s, self.clock = size, ttl_s, clock
        self.held: OrderedDict = OrderedDict()
        self.hits = self.misses = self.evicted = 0
        self.guard = threading.RLock()

    def _fresh(self, at: float) -> bool:
        return self.ttl_s is None or self.clock() - at < self.ttl_s

    def get(self, key, default=None):
        with self.guard:
            found = self.held.get(key)
            if found is None or not self._fresh(found[1]):
                self.held.pop(key, None)
                self.misses += 1
                return default
            self.held.move_to_end(key)
            self.hits += 1
            return found[0]

    def put(self, key, value) -> None:
        with self.guard:
            self.held[key] = value, self.clock()
            self.held.move_to_end(key)
            self._shrink()

    def _shrink(self) -> None:
        while len(self.held) > self.size:
            self.held.popitem(last=False)
            self.evicted += 1

    def __contains__(self, key) -> bool:
        """Without a sign of use."""
        with self.guard:
            return key in self.held and self._fresh(self.held[key][1])

    def __len__(self) -> int:
        return len(self.held)

    def drop(self, key) -> bool:
        with self.guard:
            return self.held.pop(key, None) is not None

    def drop_where(self, test: Callable[[object], bool]) -> int:
        with self.guard:
            gone = [k for k in self.held if test(k)]
            for k in gone:
                del self.held[k]
            return len(gone)

    def expire(self) -> int:
        """Drops what has outlived its time."""
        with self.guard:
            gone = [k for k, (_, at) in self.held.items() if not self._fresh(at)]
            for k in gone:
                del self.held[k]
            return len(gone)

    def clear(self) -> None:
        with self.guard:
            self.held.clear()
            self.hits = self.misses = self.evicted = 0

    def resize(self, size: int) -> None:
        with self.guard:
            self.size = max(1, size)
            self._shrink()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.held), "max_size": self.size, "hits": self.hits, "misses": self.misses, "requests": asked, "hit_rate": self.hits / asked if asked else 0.0, "evicted": self.evicted}


class Vectors(Lru):
    """Embeddings by text and model."""

    @staticmethod
    def key(model: str, text: str) -> str:
        return hashlib.sha256(f"{model}:{text.lower().strip()}".encode("utf-8", "surrogatepass")).hexdigest()[:16]

    def memory(self) -> int:
        """Bytes, estimated: eight a number and a hundred for each vector."""
        return sum(8 * len(v) + 100 for v, _ in self.held.values())

    def preload(self, model: str, pairs: Iterable[tuple[str, list[float]]]) -> int:
        for text, vector in pairs:
            self.put(self.key(model, text), vector)
        return len(self)

    def exported(self) -> dict:
        return {"version": 1, "entries": [[k, list(v)] for k, (v, _) in self.held.items()]}

    def imported(self, data: dict) -> int:
        if data.get("version") != 1:
            raise ValueError("not an export of this version")
        for k, v in data["entries"]:
            self.put(k, v)
        return len(self)


def query_key(text: str, filters: dict | None = None, **options) -> str:
    """One key a query: all of its filters at any depth, in any order of their names."""
    return hashlib.sha256(json.dumps([text, filters or {}, options], sort_keys=True, default=str).encode()).hexdigest()


class Results:
    """Results of queries at two levels: this process, and whatever mapping of strings is shared behind it."""

    def __init__(self, size: int = 500, near_s: float = 60, far_s: float = 300, far: MutableMapping[str, str] | None = None, clock: Callable[[], float] = time.time):
        self.near, self.far, self.far_s, self.clock = Lru(size, near_s, clock), far, far_s, clock
        self.far_hits = 0

    def get(self, key: str):
        if (found := self.near.get(key)) is not None:
            return found
        try:
            text = self.far.get(key) if self.far is not None else None
            entry = json.loads(text) if text else None
        except Exception:  # the far level may be away; a query has an answer without it
            return None
        if entry is None or self.clock() - entry["at"] >= self.far_s:
            return None
        self.far_hits += 1
        self.near.put(key, entry["value"])
        return entry["value"]

    def put(self, key: str, value) -> None:
        self.near.put(key, value)
        if self.far is not None:
            try:
                self.far[key] = json.dumps({"at": self.clock(), "value": value})
            except Exception:  # as above
                return

    def clear(self) -> None:
        """After a change of the tables."""
        self.near.clear()
        if self.far is not None:
            for k in list(self.far):
                del self.far[k]

    def stats(self) -> dict:
        return self.near.stats() | {"far_hits": self.far_hits}


class Pool:
    """At most `most` connections, made when first needed, lent to one user at a time; idle ones beyond `least` are closed."""

    def __init__(self, make: Callable[[], object], least: int = 1, most: int = 8, wait_s: float = 30.0, idle_s: float = 300.0, close: Callable[[object], None] = lambda c: None, clock: Callable[[], float] = time.monotonic):
        self.make, self.least, self.most, self.wait_s, self.idle_s, self.close, self.clock = make, least, most, wait_s, idle_s, close, clock
        self.free: LifoQueue = LifoQueue()
        self.made, self.guard = 0, threading.Lock()
        for _ in range(least):
            self.free.put((self._new(), clock()))

    def _new(self):
        with self.guard:
            if self.made >= self.most:
                return None
            self.made += 1
        try:
            return self.make()
        except Exception:
            with self.guard:
                self.made -= 1
            raise

    @contextmanager
    def lent(self) -> Iterator[object]:
        try:
            own = self.free.get_nowait()[0]
        except Empty:
            own = self._new()
            if own is None:
                try:
                    own = self.free.get(timeout=self.wait_s)[0]
                except Empty:
                    raise TimeoutError(f"no connection in {self.wait_s} s") from None
        try:
            yield own
        finally:
            self.free.put((own, self.clock()))

    def trim(self) -> int:
        """Closes connections that were idle for idle_s, down to the least number."""
        kept, gone = [], 0
        while True:
            try:
                own, at = self.free.get_nowait()
            except Empty:
                break
            if self.made > self.least and self.clock() - at >= self.idle_s:
                self.close(own)
                self.made, gone = self.made - 1, gone + 1
            else:
                kept.append((own, at))
        for x in reversed(kept):
            self.free.put(x)
        return gone

    def stats(self) -> dict:
        free = self.free.qsize()
        return {"total": self.made, "idle": free, "lent": self.made - free, "max": self.most}


class Metrics:
    """The last records of queries: when, how long, and the time of each step."""

    def __init__(self, last: int = 1000):
        self.records: deque[dict] = deque(maxlen=last)

    def add(self, total_time: float, steps: dict[str, float] | None = None, at: float | None = None) -> None:
        self.records.append({"at": time.time() if at is None else at, "total_time": float(total_time), "steps": dict(steps or {})})

    @contextmanager
    def timed(self, **steps: float) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add((time.perf_counter() - began) * 1000, steps)

    def frames(self, spark):
        """(records, steps) as tables for operators.stats."""
        records = spark.createDataFrame([(float(r["at"]), r["total_time"]) for r in self.records], "at double, total_time double")
        steps = spark.createDataFrame([(k, float(v)) for r in self.records for k, v in r["steps"].items()], "step string, time double")
        return records, steps
