"""WARC archives: written by Spark, normalised from one gzip stream to a member for each record with an index of offsets beside it, and read back in ranges.

`write` lets Spark's text writer make the files: a record is a string, records end in two line ends, and the file is one gzip stream, as
plain tools write it and no reader can enter but at its start. `normalised` inflates each such file once, front to back, and writes every record as a gzip
member of its own; a line of the index (JSON, `.cdxj`) beside each archive names a record's offset, length, id, type and digest. `read` then
deals out ranges of members, opens the archive there and inflates record by record. Inflating and writing go through blocks of fixed size:
a task never holds a file, nor a record unless its payload is asked for.

An attempt of a task writes under a name of its own, and only what the manifest (a table, written when all are done) names counts, so a lost executor or a
second attempt leaves a file that nobody reads. Archives lie in a folder that tasks open through Arrow's file systems (file, hdfs, s3, gs).

Equal payloads of at least `least` bytes are stored once, with the smallest id; the others are revisit records that refer to it.

Defined results: null payloads are empty; rows that repeat the smallest id with the same payload are all responses; a null id is never
the smallest, and where all ids are null all are responses; a null or empty URL has no WARC-Target-URI; control characters and blanks in ids and URLs are
percent-encoded; an empty table gives no archive and an empty result; other columns are not read, whatever their names. A record that an archive breaks off in
is left out of the index, and the manifest says so (damage); so does one whose head isn't WARC, with all after it. A file of no bytes has no row there.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import forget, released, shared_dir, ship, written
from lexloom.llm.common import _place as place

BLOCK = 1 << 20
MOST_BROADCAST = 1 << 19  # rows of two ids and a digest
MOST_HEAD = 1 << 20
RANGE = 8 << 20  # bytes of members that a task reads at a time
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
    own, fs = place(spark, path)
    fs.deleteOnExit(own)
    return path


def delete(spark: SparkSession, path: str) -> None:
    own, fs = place(spark, path)
    fs.delete(own, True)


def opened(path: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path)


# Writing


def escaped(c: Column) -> Column:
    """Control characters and blanks percent-encoded."""
    parts = F.transform(F.split(c.cast("string"), ""), lambda x: F.when(x.rlike(r"^[\x00-\x20\x7F]$"), F.concat(F.lit("%"), F.lpad(F.hex(x.cast("binary")), 2, "0"))).otherwise(x))
    return F.when(c.cast("string").rlike(r"[\x00-\x20\x7F]"), F.array_join(parts, "")).otherwise(c.cast("string"))


def revisits(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """_id, _digest, _first of the rows whose payload stands under a smaller id; ids and digests move, payloads don't."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    marks = written(pages.filter(F.octet_length(payload) >= least).select(F.col(f"`{id_col}`").alias("_id"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("_digest")))
    first = written(marks.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("n")).filter("n > 1 AND _first IS NOT NULL").drop("n"))  # apart from the join, which then may split a hot group
    found = written(marks.join(first, "_digest").filter(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_digest", "_first").distinct())
    forget(marks, first)
    return found


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str | None = None, records: int = 0) -> None:
    """One gzip stream a file, at most `records` records in each (0: no bound). date: of all records; by default the time of the call."""
    line = "\r\n"
    others = revisits(pages, id_col, payload_col, least)
    side = F.broadcast(others) if others.count() <= MOST_BROADCAST else others.hint("merge")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.unhex("digest") == F.col("_digest")), "left")
    again = F.col("_first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:x-row:"), F.coalesce(escaped(c), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(line * 2))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length("payload"))
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    field = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit(line))
    head = F.concat(
        F.lit(f"WARC/1.1{line}"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", name(F.col("id"))),
        field("WARC-Date", when),
        F.when(F.coalesce(F.col("url"), F.lit("")) == "", "").otherwise(field("WARC-Target-URI", escaped(F.col("url")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(field("WARC-Profile", F.lit(REVISIT)), field("WARC-Refers-To", name(F.col("_first"))))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{line}"),
        field("Content-Length", block.cast("string")),
        F.lit(line),
    )
    record = F.concat(head, http, F.when(again, "").otherwise(F.col("payload")))
    writer = rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", line * 2)
    (writer.option("maxRecordsPerFile", records) if records else writer).text(path)
    forget(others)


# Records of a stream


class Damaged(ValueError):
    pass


def inflated(blocks) -> Iterator[bytes]:
    """What gzip blocks hold, one stream or many members after each other, a block at a time."""
    machine, fed = zlib.decompressobj(31), False
    for data in blocks:
        while data:
            if machine.eof:
                machine, fed = zlib.decompressobj(31), False
            try:
                out = machine.decompress(data, BLOCK)
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            fed = True
            if out:
                yield out
            data = machine.unused_data if machine.eof else machine.unconsumed_tail
            while not machine.eof and not data and len(out) == BLOCK:  # more may wait inside
                out = machine.decompress(b"", BLOCK)
                if out:
                    yield out
                data = machine.unused_data if machine.eof else machine.unconsumed_tail
    if fed and not machine.eof:
        raise Damaged("gzip: the stream breaks off")


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's or message's head, names in lower case; lines that begin with a blank go on."""
    out, last = {}, None
    for row in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if row[:1] in (" ", "\t") and last:
            out[last] += " " + row.strip()
        elif ":" in row:
            last, value = row.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def records(blocks) -> Iterator[tuple[str, object]]:
    """("head", (its bytes, fields)), ("body", bytes) any number of times, ("end", None) for each record of a stream."""
    held, it = b"", iter(blocks)
    while True:
        held = held.lstrip(b"\r\n")  # two line ends end a record; more or fewer are let pass
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(it, None)
            if more is None:
                if held:
                    raise Damaged("a record's head breaks off")
                return
            held = held.lstrip(b"\r\n") + more if not held.strip(b"\r\n") else held + more
            if len(held) > MOST_HEAD + BLOCK:
                raise Damaged("a record's head has no end")
            held = held.lstrip(b"\r\n")
        head = held[: end + 4]
        named = fields(head)
        if not head.startswith(b"WARC/") or not named.get("content-length", "").isdigit():
            raise Damaged("not a WARC record")
        held, left = held[end + 4 :], int(named["content-length"])
        yield "head", (head, named)
        while left:
            part, held = held[:left], held[left:]
            if part:
                left -= len(part)
                yield "body", part
            elif left:
                held = next(it, None)
                if held is None:
                    raise Damaged("a record's block breaks off")
        yield "end", None


def chunks(stream, size: int = BLOCK) -> Iterator[bytes]:
    while data := stream.read(size):
        yield data


# Normalising

INDEX = "offset long, length long, id string, type string, uri string, digest string"
MANIFEST = "source string, archive string, index string, records long, bytes long, damage string"


def rewritten(blocks, out, index) -> tuple[int, int, str | None]:
    """Each record of an inflated stream as a gzip member of its own in `out`, a line for each in `index`: how many, the bytes, and what was wrong."""
    n = at = 0
    began, machine = 0, None
    try:
        for kind, what in records(blocks):
            if kind == "head":
                head, named = what
                began, machine = at, zlib.compressobj(6, zlib.DEFLATED, 31)
                data = machine.compress(head)
            elif kind == "body":
                data = machine.compress(what)
            else:
                data = machine.compress(b"\r\n\r\n") + machine.flush()
                machine = None
            if data:
                out.write(data)
                at += len(data)
            if kind == "end":
                row = {"offset": began, "length": at - began, "id": named.get("warc-record-id"), "type": named.get("warc-type"), "uri": named.get("warc-target-uri"), "digest": named.get("warc-payload-digest")}
                index.write((json.dumps(row) + "\n").encode())
                n += 1
    except Damaged as e:
        if machine:
            data = machine.flush()  # the member is closed, though no line of the index names it
            out.write(data)
            at += len(data)
        return n, at, str(e)
    return n, at, None


def normalised(spark: SparkSession, source: str, target: str) -> DataFrame:
    """The manifest of the archives made in target from the files in source: source, archive, index (paths), records, bytes, damage (null if none)."""
    ship(spark)
    files = spark.read.format("binaryFile").load(source).select("path")  # the files' bytes are not read here

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                there, own = opened(path)
                to, base = opened(target)
                name = f"{base}/{uuid.uuid4().hex}"
                to.create_dir(base, recursive=True)
                with there.open_input_stream(own, compression=None) as i, to.open_output_stream(f"{name}.warc.gz", compression=None) as out, to.open_output_stream(f"{name}.cdxj", compression=None) as index:
                    n, size, damage = rewritten(inflated(chunks(i)), out, index)
                made = f"{target}/{name.rsplit('/', 1)[1]}"
                row = (path, f"{made}.warc.gz", f"{made}.cdxj", n, size, damage)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()], strict=True)], names=["source", "archive", "index", "records", "bytes", "damage"])

    files.mapInArrow(released(run), MANIFEST).write.parquet(f"{target}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


# Reading

RECORD = "archive string, offset long, length long, id string, type string, uri string, payload_bytes long, payload_digest string, refers_to string, intact boolean, payload binary"


def indexed(spark: SparkSession, target: str) -> DataFrame:
    """archive and the rows of the index, of all archives that the manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{target}/manifest").filter("records > 0").select("archive", F.regexp_extract("index", r"[^/]+$", 0).alias("name"))
    lines = spark.read.schema(INDEX).json(f"{target}/*.cdxj").withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0))
    return lines.join(manifest, "name").drop("name")


def parsed(events, payloads: bool) -> Iterator[tuple]:
    """(id, type, uri, payload bytes, digest, refers_to, intact, payload) of each record. Of a revisit, bytes and digest are those it names; of others, measured."""
    for kind, what in events:
        if kind == "head":
            named = what[1]
            http = named.get("content-type", "").startswith("application/http")
            digest, size, held, message, kept = hashlib.sha256(), 0, b"", {}, []
        elif kind == "body":
            if http:  # the message's head goes before the payload
                held += what
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    continue
                message, what, held, http = fields(held[: end + 4]), held[end + 4 :], b"", False
            digest.update(what)
            size += len(what)
            if payloads:
                kept.append(what)
        else:
            said = named.get("warc-payload-digest", "")
            said = said.removeprefix("sha256:") if said.startswith("sha256:") else None
            base = named.get("warc-record-id"), named.get("warc-type"), named.get("warc-target-uri")
            if named.get("warc-type") == "revisit":
                size = message.get("content-length", "")
                yield *base, int(size) if size.isdigit() else None, said, named.get("warc-refers-to"), True, None
            else:
                own = digest.hexdigest()
                yield *base, size, own, None, said is None or own == said, b"".join(kept) if payloads else None


def read(spark: SparkSession, target: str, payloads: bool = False) -> DataFrame:
    """A row for each record that the index of target's archives names. intact: the digest is what the record says. payloads: whether these are held and returned."""
    ship(spark)
    ranges = indexed(spark, target).groupBy("archive", F.floor(F.col("offset") / RANGE).alias("part")).agg(F.min("offset").alias("lo"), F.max(F.col("offset") + F.col("length")).alias("hi"))
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), RECORD.split(", "), strict=True)], names=names)

    def run(batches):
        for b in batches:
            for archive, lo, hi in zip(*(b.column(c).to_pylist() for c in ("archive", "lo", "hi")), strict=True):
                there, own = opened(archive)
                with there.open_input_file(own) as f:
                    f.seek(lo)
                    found, rows, size = members(f, hi - lo), [], 0
                    for (at, length), events in found:
                        for row in parsed(records(events), payloads):
                            rows.append((archive, lo + at, length(), *row))
                            size += len(row[-1] or b"") + 1000
                        if size > BLOCK * 4:
                            yield made(rows)
                            rows, size = [], 0
                    if rows:
                        yield made(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, or a few bytes of ranges would end in one task
    return ranges.repartition(parts, "archive", "part").mapInArrow(released(run), RECORD)


def members(stream, size: int):
    """((where it begins, its length once read), its inflated blocks) of each gzip member in the next `size` bytes."""
    left, held, done = size, b"", 0
    while held or left:
        machine, began, used = zlib.decompressobj(31), done, [0]

        def blocks(machine=machine, used=used):
            nonlocal held, left
            while not machine.eof:
                if not held:
                    held = stream.read(min(BLOCK // 4, left)) if left else b""
                    left -= len(held)
                    if not held:
                        raise Damaged("a member breaks off")
                before = len(held)
                out = machine.decompress(held, BLOCK)
                held = machine.unused_data if machine.eof else machine.unconsumed_tail
                used[0] += before - len(held)
                if out:
                    yield out

        yield (began, lambda used=used: used[0]), blocks()
        done = began + used[0]


def resolved(found: DataFrame) -> DataFrame:
    """Rows of read() in which a revisit has the payload, if that was read, and the measured size and digest of the record that it refers to (null if that is missing)."""
    full = written(found.filter("type = 'response' AND id IS NOT NULL").groupBy("id").agg(F.first(F.struct("payload_bytes", "payload_digest", "payload")).alias("_full")).withColumnRenamed("id", "_of"))
    joined = found.join(full, F.col("refers_to") == F.col("_of"), "left")
    again = F.col("type") == "revisit"
    return joined.withColumns({c: F.when(again, F.col("_full")[c]).otherwise(F.col(c)) for c in ("payload_bytes", "payload_digest", "payload")}).drop("_of", "_full")


def row_id(c: Column, kind: str) -> Column:
    """The id that a record's name was made from, for ids without control characters and blanks."""
    text = F.regexp_extract(c, r"^<urn:x-row:(.*)>$", 1)
    return F.when(text == "", None).otherwise(text.cast(kind))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of every record, after writing, normalising and reading. Archives that are damaged or not intact are an error."""
    spark = pages.sparkSession
    plain, target = folder(spark), folder(spark)
    write(pages, plain, id_col, url_col, payload_col, least)
    bad = normalised(spark, plain, target).filter("damage IS NOT NULL").limit(5).collect()
    if bad:
        raise ValueError(f"damaged archives: {bad}")
    delete(spark, plain)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = read(spark, target)
    out = written(rows.select(row_id(F.col("id"), kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), row_id(F.col("refers_to"), kind).alias("refers_to"), "intact"))
    delete(spark, target)
    if not out.filter("NOT intact").isEmpty():
        raise ValueError("a payload differs from its record's digest")
    return out.drop("intact")


SQL = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
