"""Source divergence, importance resampling and WARC archives against brute force and round trips, and on odd rows."""

import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import divergence, resample, warc
from lexloom.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "weight string, score string, rank string, n string, term string, slot string, value string, payload string, archive string"


def frame(spark, rows, schema=DOCS):
    """With further columns whose names the operators use."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast(k) for c, k in (x.split() for x in ODD.split(", "))})


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- 11 source divergence ---


def plain_audit(rows, least=30, best=50):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t, n in df.items() if n >= least]
        of = {s: sum((d[2] for d in own if d[1] == s), Counter()) for s in {d[1] for d in own}}
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        for s in of:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in of if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])) for k, (v, i) in enumerate(found)]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "the", "Ä", "ä", "日本", "x" * 40]) if rng.random() < 0.3 else f"w{chr(97 + int(rng.paretovariate(0.6)) % 26)}"
    rows = [(i, None if i % 50 == 7 else " 7,".join(word() for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]), 0) for i in range(n)]
    return [*rows, *rows[:40], (1000, "", "void", "a", 0), (1001, "9 9", "void", "b", 0), (None, "the the", None, "alone", None)]


def audit(df, **options):
    return sorted(map(tuple, divergence.audited(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("seed", "least", "best", "block", "held"), [(1, 30, 50, 256, 1 << 18), (2, 3, 2, 2, 20), (3, 1, 4, 3, 1)])
def test_audit(spark, monkeypatch, seed, least, best, block, held):
    """Few and many blocks of sources; partial sums handed on seldom and after each document."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SLOT_ROWS", held)
    rows = corpus(seed)
    assert audit(frame(spark, rows), least_docs=least, best=best) == plain_audit(rows, least, best)


def test_audit_on_odd_tables(spark):
    assert audit(frame(spark, [(1, "x", "en", "a", 1)]).limit(0)) == []
    assert audit(frame(spark, [(None, None, None, None, None)] * 3)) == []
    rows = [(i, "same words here", "en", s, 0) for i, s in enumerate("ab" * 20)]  # ties
    assert audit(frame(spark, rows)) == plain_audit(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    """Totals near the bound, where a product would leave 64 bits."""
    rng = random.Random(5)
    for _ in range(200):
        terms, total = rng.randrange(1, 10**9), rng.randrange(9 * 10**15 // 2)
        count = rng.randrange(total + 1)
        assert divergence.shares(np.array([count]), np.array(total), terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_terms_of_stretches(monkeypatch):
    text = " ".join(random.Random(6).choice(["Ab", "é", "c" * 30, "1x2"]) for _ in range(500))
    [whole] = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "STRETCH", 10)
    parts = list(divergence.terms_of(text))
    assert sum(parts, []) == whole and len(parts) > 9


# --- 12 importance resampling ---


def plain_draw(docs, target, percent=5, least=20, buckets=10_000):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own, s, t = [(i, *grams(x)) for i, x in docs], Counter(), Counter()
    for *_, g in own:
        s.update(g)
    for x in target:
        t.update(grams(x)[1])
    total, other = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (other + buckets))))
    out = []
    for i, n, g in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_crc_of_joined_strings():
    shifts, rng = resample.Shifts(), random.Random(7)
    for n in [0, 1, 2, 63, 64, 65, 127, 128, 4096, 1_000_003]:
        a, b = rng.randbytes(9), rng.randbytes(n)
        assert shifts(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_draw(spark, monkeypatch, stretch):
    monkeypatch.setattr(resample, "STRETCH", stretch)
    rng = random.Random(8)
    word = lambda: rng.choice(["Und", "ÄÖ", "a1", "x" * 70, "q" * 33, "日本語", *"abcdefgh"])
    docs = [(i, None if i % 40 == 3 else rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(60)))) for i in range(400)]
    docs += [*docs[:100], (None, docs[5][1] + docs[6][1]), (9_999, "")]
    target = [docs[7][1], None, "a1 und ab", ""]
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in docs])
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "weight long, text string")
    got = resample.drawn(df, goal).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    want = plain_draw(docs, target)
    assert sorted(map(tuple, got), key=str) == want and sum(r[5] is not None for r in want) == 5 * sum(r[1] >= 20 for r in want) // 100 > 5


def test_draw_on_odd_tables(spark):
    df, goal = frame(spark, [(1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (None, None, None, None, None)]), spark.createDataFrame([], "text string")
    got = sorted(map(tuple, resample.drawn(df, goal).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == plain_draw([(1, "a b c"), (1, "a b c"), (None, None)], [])
    assert resample.drawn(df.limit(0), goal).count() == 0
    long = "word " * 300_000
    [row] = resample.drawn(frame(spark, [(1, long, "en", "s", 0)]), goal).collect()
    assert row["n_words"] == 300_000 and row["n_features"] == 899_997 and row["rank"] is None


# --- 13 WARC ---


def pages(spark, rows):
    return frame(spark, rows, "page_id long, url string, html string")


def plain_records(data):
    """(fields, block) of what a whole WARC file holds."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(named["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((named, rest[:n]))
        data = rest[n + 4 :]
    return out


def plain_kinds(rows):
    by = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            by[html] = min(by.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = by.get(html) if len(data) >= 100 else None
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


LONG = "<p>é日</p>\r\n\r\nWARC/1.1\r\n" * 9
ROWS = [(5, "http://a/ b\r\nX: y", LONG), (3, "http://a", LONG), (9, None, LONG), (1, "u", None), (2, "", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", LONG), (7, "u", "z" * 100), (8, "u", "z" * 100), (8, "u", "z" * 100), (7, "u", "z" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (8, "u", "other text " * 20)]


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == plain_kinds(ROWS)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc.round_trip(pages(spark, ROWS).limit(0)).count() == 0
    nulls = [(None, None, "n" * 200)] * 3
    assert sorted(map(tuple, warc.round_trip(pages(spark, nulls)).collect())) == plain_kinds(nulls)


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_archives(spark, tmp_path, monkeypatch, size):
    """Files as they lie there: one stream before, a member a record after; each line of the index opens one."""
    monkeypatch.setattr(warc, "BLOCK", size)
    rng = random.Random(9)
    rows = [*ROWS, *((100 + i, f"http://h/{i}", "".join(rng.choice("abc <>é") for _ in range(rng.randrange(3000)))) for i in range(60))]
    a, b, c = (str(tmp_path / x) for x in "abc")
    warc.write(pages(spark, rows).coalesce(2), a, date="2024-01-02T03:04:05Z", records=20)
    plain = {p.name: plain_records(gzip.decompress(p.read_bytes())) for p in Path(a).glob("*.gz")}
    assert len(plain) >= 4 and sum(map(len, plain.values())) == len(rows)
    assert all(len(zlib_members(p.read_bytes())) == 1 for p in Path(a).glob("*.gz"))
    manifest = warc.normalised(spark, a, b).collect()
    assert {Path(m.source.removeprefix("file:")).name: m.records for m in manifest} == {k: len(v) for k, v in plain.items()} and not any(m.damage for m in manifest)
    for m in manifest:
        data, was = Path(m.archive).read_bytes(), plain[Path(m.source.removeprefix("file:")).name]
        assert [plain_records(x) for x in zlib_members(data)] == [[r] for r in was]
        lines = [json.loads(x) for x in Path(m["index"]).read_text().splitlines()]
        for line, (named, block) in zip(lines, was, strict=True):
            [(again, body)] = plain_records(gzip.decompress(data[line["offset"] : line["offset"] + line["length"]]))
            assert (again, body, line["id"], line["type"]) == (named, block, named["WARC-Record-ID"], named["WARC-Type"])
            assert int(named["Content-Length"]) == len(block) and named["WARC-Date"] == "2024-01-02T03:04:05Z" and re.fullmatch(r"[^\x00-\x20\x7F]*", named.get("WARC-Target-URI", ""))
    monkeypatch.setattr(warc, "RANGE", 500)
    found = warc.read(spark, b, payloads=True)
    full = warc.resolved(found)
    assert sorted(((r.payload or b"").decode(), r.payload_bytes, r.payload_digest) for r in full.collect()) == sorted((h or "", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for _, _, h in rows)
    assert all(r.intact for r in found.collect())
    warc.normalised(spark, f"{b}/*.warc.gz", c)  # what is normal already stays as it is
    assert sorted(p.read_bytes() for p in Path(b).glob("*.warc.gz")) == sorted(p.read_bytes() for p in Path(c).glob("*.warc.gz"))


def zlib_members(data):
    out = []
    while data:
        m = zlib.decompressobj(31)
        out.append(m.decompress(data))
        assert m.eof
        data = m.unused_data
    return out


def made(*blocks, kind="resource", extra=""):
    return [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n{extra}Content-Type: text/plain\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks)]


def test_damaged_archives(spark, tmp_path):
    """Those before the damage stay; the manifest says what was wrong."""
    good = made(b"one", b"two\r\n\r\n", b"")
    folder = tmp_path / "in"
    folder.mkdir()
    files = {
        "whole": gzip.compress(b"".join(good)), "cut": gzip.compress(b"".join(good) + made(random.Random(1).randbytes(5000))[0])[:-40], "short": gzip.compress(b"".join(good) + made(b"x" * 50)[0][:-20]), "odd": gzip.compress(b"".join(good) + b"HTTP/1.1 200 OK\r\n\r\n"),
        "plain": b"".join(good), "empty": b"", "blank": gzip.compress(b""), "loose": gzip.compress(b"\r\n".join(good) + b"\r\n\r\n\r\n"),
    }
    for name, data in files.items():
        (folder / f"{name}.warc.gz").write_bytes(data)
    m = {Path(r.source).name.split(".")[0]: r for r in warc.normalised(spark, str(folder), str(tmp_path / "out")).collect()}
    assert {k: r.records for k, r in m.items()} == {"whole": 3, "cut": 3, "short": 3, "odd": 3, "plain": 0, "blank": 0, "loose": 3}
    assert {k for k, r in m.items() if r.damage} == {"cut", "short", "odd", "plain"}
    got = warc.read(spark, str(tmp_path / "out"), payloads=True).collect()
    assert Counter(bytes(r.payload) for r in got) == Counter({b"one": 5, b"two\r\n\r\n": 5, b"": 5})


def test_long_records_pass_in_blocks():
    """A record of 40 MB is rewritten while no more than a few blocks are held."""
    import tracemalloc

    def blocks():
        machine = zlib.compressobj(1, zlib.DEFLATED, 31)
        yield machine.compress(f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {40 << 20}\r\n\r\n".encode())
        for i in range(40):
            yield machine.compress(bytes([i]) * (1 << 20))
        yield machine.compress(b"\r\n\r\n") + machine.flush()

    out, index = io.BytesIO(), io.BytesIO()
    tracemalloc.start()
    assert warc.rewritten(warc.inflated(blocks()), out, index)[::2] == (1, None)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()
    assert len(gzip.decompress(out.getvalue())) > 40 << 20


def test_digests_are_held_against_payloads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = made(b"one", extra="WARC-Payload-Digest: sha256:00\r\n") + made(b"two", extra="WARC-Payload-Digest: sha1:ABC\r\n")
    (tmp_path / "in/x.warc.gz").write_bytes(gzip.compress(b"".join(data)))
    warc.normalised(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r.intact for r in warc.read(spark, str(tmp_path / "out")).collect()) == [False, True]


# --- the queries ---


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs = corpus(10, 800)
    spark.createDataFrame(docs, DOCS).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, docs[i][1]) for i in range(0, 40)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([r for r in ROWS if r[0] not in (None, 8)], "page_id long, url string, html string").dropDuplicates(["page_id"]).write.parquet(f"{top}/pages.parquet")
    return top


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling", "op13_warc"])
def test_query_against_sql(spark, tables, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want, got = duck.sql(SQL[name]), QUERIES[name](spark, tables)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    lines = lambda rows: sorted(map(str, rows))
    assert lines(want.project(", ".join(cols)).fetchall()) == lines(map(tuple, got.select(*cols).collect()))
