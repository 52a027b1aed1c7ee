"""How far the sources of a language are apart in their words, by sorted streams of (language, term, source) and scans of their runs.

Each task sums up its own documents first: for every (lang, source, term) in how many of them it stands (each document is read whole by one
task) and how often. These rows are dealt out by (lang, term, a slot of the source), sorted, and scanned run by run, which makes one row
of each (lang, term, source); these are dealt out by (lang, term) and sorted in turn, and a run, one row for each source, gives the
term's document frequency and its count in the language. Kept terms are dealt out a third time, by (lang, a pair of blocks of
sources, a slot of the term), behind rows that name the sources of both blocks with their totals: a run is then a column of counts, from
which shares follow, and the scan adds up partial distances of pairs of sources and keeps partial best terms. Only those are summed
up and ranked in the end.

A task holds a run of one term (its sources), the totals of two blocks of sources, their matrix of distances and the best terms of one
block, never a vocabulary. Shares are exact: floor(10^9 * a / b) by long division in 64 bits.

Defined results: null text, lang and source are ''; rows are documents, repeated ones too; a language without a kept term gives
distance 0 to all its pairs and no terms; a source without terms has the share that the smoothing leaves; ties end in the item's UTF-8 bytes; an
empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import forget, released, ship, written

TERM = re.compile(rb"[a-z\x80-\xFF]+")  # bytes of UTF-8, A-Z lower-cased
OUT = re.compile(rb"[^a-zA-Z\x80-\xFF]")
STRETCH = 1 << 20
HELD = 1 << 18  # entries that a task sums up before it hands them on
SHARE = 1_000_000_000
BLOCK = 256  # sources of a block
SLOT_ROWS = 1 << 18  # of a language's part, about
LEAST_SLOTS = 8
SALT = 16  # parts of a term's sources


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """A text's terms in bytes, a stretch at a time."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while len(data) - at > STRETCH and (end := OUT.search(data, at + STRETCH)):
        yield TERM.findall(data[at : end.start()].lower())
        at = end.end()
    yield TERM.findall((data[at:] if at else data).lower())


def partials(docs: DataFrame) -> DataFrame:
    """lang, term, source, docs, n of (text, lang, source): sums over the documents that a task holds at a time."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def close():
            for (lang, source), (n, d) in held.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.repeat(source, k), pa.array([d[t] for t in n], pa.int64()), pa.array(n.values(), pa.int64())], names=["lang", "term", "source", "docs", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for text, *key in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                    n, d = held.setdefault(tuple(key), (Counter(), Counter()))
                    before, own = len(n), set()
                    for terms in terms_of(text):
                        n.update(terms)
                        own.update(terms)
                    d.update(own)
                    size += len(n) - before
                    if size > HELD:
                        yield from close()
                        held, size = {}, 0
        yield from close()

    return docs.mapInArrow(released(run), "lang string, term string, source string, docs long, n long")


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin, in a batch with at least one row. Null keys are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, batch.num_rows - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_runs(batches, keys: list[str], fold=None) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, cut between runs of equal keys; the last run waits for the next batch, made smaller by fold."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.concat_batches([held, b])
        cut = int(changes(b, keys)[-1])
        if cut:
            yield b.slice(0, cut)
        held = b.slice(cut) if fold is None else fold(b.slice(cut))
    if held is not None:
        yield held


def summed(b: pa.RecordBatch, keys: list[str], sums: list[str]) -> pa.RecordBatch:
    """A row for each run of equal keys."""
    at = changes(b, keys)
    first = pa.array(at)
    return pa.RecordBatch.from_arrays([*(b.column(k).take(first) for k in keys), *(pa.array(np.add.reduceat(b.column(s).to_numpy(), at)) for s in sums)], names=[*keys, *sums])


def by_source(parts: DataFrame) -> DataFrame:
    """One row of each (lang, term, source). A term's sources lie in SALT slots, so the rows of a common term don't meet in one task."""
    keys = ["lang", "term", "source"]

    def run(batches):
        fold = lambda b: summed(b, keys, ["docs", "n"])
        for b in whole_runs(batches, keys, fold):
            yield fold(b)

    slot = F.pmod(F.xxhash64("source"), F.lit(SALT))
    return parts.repartition(F.col("lang"), F.col("term"), slot).sortWithinPartitions(*keys).mapInArrow(released(run), parts.schema)


def kept(sources: DataFrame, least_docs: int) -> DataFrame:
    """The rows (lang, term, source, n) of terms in at least least_docs documents of their language, and one with source null for the language's own count."""

    def run(batches):
        for b in whole_runs(batches, ["lang", "term"]):
            at = changes(b, ["lang", "term"])
            sizes = np.diff(np.append(at, b.num_rows))
            often = np.add.reduceat(b.column("docs").to_numpy(), at) >= least_docs
            of_lang = pa.array(at[often])
            whole = np.add.reduceat(b.column("n").to_numpy(), at)[often]
            yield pa.RecordBatch.from_arrays([b.column("lang").take(of_lang), b.column("term").take(of_lang), pa.nulls(len(of_lang), pa.string()), pa.array(whole)], names=["lang", "term", "source", "n"])
            yield b.select(["lang", "term", "source", "n"]).filter(pa.array(np.repeat(often, sizes)))

    return sources.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(released(run), "lang string, term string, source string, n long")


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), by long division: no step leaves 64 bits under totals of 9 * 10^15."""
    rest, by = count + 5, total + 5 * terms
    out = np.zeros(np.broadcast_shapes(rest.shape, by.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


class Scan:
    """Partial pairs and terms of one language and two blocks of sources, fed with whole runs."""

    def __init__(self, key: tuple, best: int):
        self.lang, self.cross, self.most = key[0], key[1] != key[2], best
        self.sources, self.ends, self.best, self.seen = [], [], [], 0
        self.ready = False

    def name(self, source: list, total: list, side: list, v: int, of_lang: int) -> None:
        """The sources of both blocks: named in each slot, in the same order; read once."""
        if self.ready:
            return
        if not self.sources:
            self.total, self.side = [], []
        self.v, self.of_lang = v, of_lang
        self.sources += source
        self.total += total
        self.side += side

    def begin(self) -> None:
        self.ready = True
        at = sorted({s: (t, d) for s, t, d in zip(self.sources, self.total, self.side, strict=True)}.items())
        self.sources = [s for s, _ in at]
        self.named = pa.array(self.sources, pa.string())
        self.total = np.array([t for _, (t, _) in at], np.int64)
        side = np.array([d for _, (_, d) in at], np.int64)
        self.a = np.flatnonzero(side == 0)
        self.b = np.flatnonzero(side == 1) if self.cross else self.a
        self.apart = np.zeros((len(self.a), len(self.b)), np.int64)
        self.best = [[] for _ in self.a]

    def runs(self, b: pa.RecordBatch) -> None:
        """Rows of whole terms, each with its language's count first."""
        at = changes(b, ["term"])
        which = np.repeat(np.arange(len(at)), np.diff(np.append(at, b.num_rows)))
        n, own = b.column("n").to_numpy(), pc.index_in(b.column("source"), self.named)
        there = own.is_valid().to_numpy(zero_copy_only=False)
        counts = np.zeros((len(at), len(self.sources)), np.int64)
        counts[which[there], own.drop_null().to_numpy()] = n[there]
        p = shares(counts, self.total, self.v)
        pa_, pb = p[:, self.a], p[:, self.b]
        for i in range(len(self.a)):
            self.apart[i] += np.abs(pa_[:, i : i + 1] - pb).sum(axis=0)
        self.seen += len(at)
        if self.cross:
            return
        over = p - shares(n[at], np.array(self.of_lang, np.int64), self.v)[:, None]
        over[counts == 0] = 0
        names = b.column("term")
        for i in range(len(self.a)):
            held = self.best[i]
            f = over[:, i]
            good = np.flatnonzero(f > (held[-1][0] * -1 - 1 if len(held) == self.most else 0))
            if len(good) > self.most:
                good = good[f[good] >= np.partition(f[good], -self.most)[-self.most]]
            if len(good):
                found = zip((-f[good]).tolist(), names.take(pa.array(at[good])).cast(pa.binary()).to_pylist(), strict=True)
                self.best[i] = sorted([*held, *found])[: self.most]

    def rows(self) -> list[tuple]:
        if not self.ready:
            self.begin()
        alone = shares(np.zeros(len(self.total), np.int64), self.total, self.v) if self.v else np.zeros(len(self.total), np.int64)
        out = []
        for i, x in enumerate(self.a):
            for j, y in enumerate(self.b):
                if x != y:
                    row = (int(self.apart[i, j]), self.seen, self.v, abs(int(alone[x] - alone[y])))
                    out.append((self.lang, self.sources[x], "pair", self.sources[y], *row))
                    if self.cross:
                        out.append((self.lang, self.sources[y], "pair", self.sources[x], *row))
            out += [(self.lang, self.sources[x], "term", t.decode(), -f, 0, 0, 0) for f, t in self.best[i]]
        return out


FOUND = "lang string, source string, part string, item string, value long, seen long, v long, gap long"


def scanned(rows: DataFrame, best: int) -> DataFrame:
    """Partial pairs and terms from rows in the order lang, bi, bj, slot, term (null: a source's name and totals), source (null: the language's count)."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def made(scan):
        cols = list(zip(*scan.rows(), strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 4 else pa.int64()) for i, c in enumerate(cols)], names=names)

    def run(batches):
        key, scan = None, None
        for b in whole_runs(batches, ["lang", "bi", "bj", "slot", "term"]):
            cuts = np.append(changes(b, ["lang", "bi", "bj", "slot"]), b.num_rows).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                now = tuple(part.column(c)[0].as_py() for c in ("lang", "bi", "bj"))
                if now != key:
                    if scan:
                        yield made(scan)
                    key, scan = now, Scan(now, best)
                heads = part.column("term").null_count
                if heads:
                    h = part.slice(0, heads)
                    scan.name(*(h.column(c).to_pylist() for c in ("source", "n", "side")), h.column("v")[0].as_py(), h.column("of_lang")[0].as_py())
                if heads < part.num_rows:
                    if not scan.ready:
                        scan.begin()
                    terms = part.slice(heads)
                    starts = changes(terms, ["term"])
                    step = max(1, (1 << 19) // max(1, len(scan.sources)))
                    ends = np.append(starts[step::step], terms.num_rows).tolist()
                    for s, e in zip(starts[::step].tolist(), ends, strict=True):
                        scan.runs(terms.slice(s, e - s))
        if scan:
            yield made(scan)

    order = ["lang", "bi", "bj", "slot", F.col("term").asc_nulls_first(), F.col("source").asc_nulls_first()]
    rows = rows.repartition("lang", "bi", "bj", "slot").sortWithinPartitions(*order)
    return rows.mapInArrow(released(run), FOUND)


def audited(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, best: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language by distance, part `term` the `best` terms that a source has most beyond its language."""
    ship(docs.sparkSession)
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(a) for a, c in (("text", text_col), ("lang", lang_col), ("source", source_col))))
    terms = written(kept(by_source(partials(docs)), least_docs))
    of_lang = terms.filter("source IS NULL").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("of_lang"))
    of_source = terms.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(groups.fillna(0, ["n", "v", "of_lang"]))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK))
    rows = terms.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    slots = max(LEAST_SLOTS, -(-rows // SLOT_ROWS))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    pair = lambda df: df.withColumn("other", F.explode(every)).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).withColumn("side", (F.col("block") != F.col("bi")).cast("int"))
    cols = ["lang", "bi", "bj", "slot", "term", "source", "n", "side", "v", "of_lang"]
    heads = pair(groups.withColumn("block", block)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("term", F.lit(None).cast("string")).select(*cols)
    slotted = terms.withColumns({"slot": F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int"), "v": F.lit(0).cast("long"), "of_lang": F.lit(0).cast("long")})
    own = pair(slotted.filter("source IS NOT NULL").withColumn("block", block)).select(*cols)
    whole = slotted.filter("source IS NULL").withColumns({"bi": F.explode(every), "side": F.lit(0)}).withColumn("bj", F.explode(F.sequence("bi", F.lit(blocks - 1)))).select(*cols)
    found = written(scanned(heads.unionByName(own).unionByName(whole), best))
    keys = ["lang", "source", "part", "item"]
    pairs = found.filter("part = 'pair'").groupBy(*keys).agg((F.sum("value") + (F.max("v") - F.sum("seen")) * F.max("gap")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))  # of sources, or of a few terms of each task
    place = F.row_number().over(order)
    ranked = pairs.withColumn("rank", place).unionByName(found.filter("part = 'term'").select(*keys, "value").withColumn("rank", place).filter(F.col("rank") <= best))
    forget(terms, groups)
    return ranked.select(*keys, "value", "rank")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(l.n, 0) AS of_lang, coalesce((SELECT sum(n) FROM counts JOIN kept USING (lang, term) WHERE counts.lang = g.lang AND counts.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON g.lang = l.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.c + 5)) // (of_lang + 5 * v))::BIGINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
