"""A store of the seven tables as versioned snapshots.

A version is a manifest that names the folders of each table; the newest manifest is the store. Manifests are written beside
their place and renamed into it, never changed or replaced, so a crash leaves the last version as it was. Appending adds a folder
to a table, and deleting adds a folder of markers (the ids of documents, and the table that it concerns), so what is written follows
the rows that come and go alone: a row is gone if a marker of a later version names its document. Folders carry their version in their
names; reading joins the markers against the rows, and `compact` folds them in. One writer holds the lock at a time, proven by a token that it
checks before it publishes; a version that another writer published meanwhile is a conflict, and the change is made again on top of it.
Readers keep the version they opened. All files go through Hadoop's file system, so a store may lie wherever Spark reads and writes
and renames are atomic.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import ship
from lexloom.sources.schema import CHILDREN, TABLES, VERSION, checked, conform, latest_version, schema

STALE_S = 30
#: How often a conflict is tried again, and the first and the longest wait.
RETRIES, FIRST_WAIT_S, LONGEST_WAIT_S = 5, 0.1, 5.0
MARKS = "deleted"  # the manifest's name for folders of markers
MARK = "document_id string, what string"  # what: a table, or null for all that belongs to the document
VECTORS = "vectors"  # of texts that were embedded, by key and model
VECTOR = "key string, model string, embedding array<float>"
LOWER = {"document_tags": "tag", "document_languages": "language_code", "keywords": "keyword"}
Change = Callable[[], tuple[dict[str, DataFrame], dict[str, DataFrame]]]


def version_of(folder: str) -> int:
    """The version that wrote a folder; 0 where the name doesn't say."""
    found = re.search(r"-(\d{9})-\w+$", folder)
    return int(found[1]) if found else 0


class Conflict(RuntimeError):
    """Another writer was faster."""


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + f".{int(time.time() * 1000) % 1000:03d}Z"


def retried(action: Callable, retries: int = RETRIES, first: float = FIRST_WAIT_S, longest: float = LONGEST_WAIT_S, sleep: Callable[[float], None] = time.sleep):
    """action's result; conflicts are tried again after waits that double."""
    for n in range(retries + 1):
        try:
            return action()
        except Conflict:
            if n == retries:
                raise
            sleep(min(first * 2**n, longest))


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = ship(spark), (path or os.environ.get("LEXLOOM_STORE") or "lexloom-store").rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(self.conf)
        self.token: str | None = None

    # --- files ---
    def _p(self, *parts: str):
        return self.Path("/".join([self.path, *parts]))

    def _write(self, text: str, *parts: str, overwrite: bool = True) -> None:
        out = self.fs.create(self._p(*parts), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, *parts: str) -> str:
        source = self.fs.open(self._p(*parts))
        data = bytes(source.readAllBytes())
        source.close()
        return data.decode()

    def _names(self, *parts: str) -> list[str]:
        at = self._p(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    # --- versions ---
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    @property
    def version(self) -> int:
        """The newest one; 0 without any."""
        return max(self.versions(), default=0)

    def exists(self) -> bool:
        return self.version > 0

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Table -> its folders under the store."""
        return json.loads(self._read("manifests", f"{version or self.version}.json"))

    def create(self, force: bool = False) -> Store:
        """Empty tables and the schema version; an existing store is left as it is unless forced."""
        if self.exists() and not force:
            return self
        with self.held():
            before = self.version
            if not before or force:
                tables = {n: self.spark.createDataFrame([], schema(n)) for n in TABLES}
                tables["schema_version"] = self.spark.createDataFrame([(1, VERSION, now(), "first version")], schema("schema_version"))
                self._publish({n: [self._folder(n, df, before + 1)] for n, df in tables.items()}, before + 1)
        return self

    def open(self) -> Store:
        """Creates what is missing, then checks columns and version."""
        self.create()
        for name in TABLES:
            checked(name, self.spark.read.parquet(*self._paths(name)))
        if (found := latest_version(self.table("schema_version"))) != VERSION:
            raise ValueError(f"the store has version {found}, not {VERSION}")
        return self

    def drop(self, confirm: bool = False, backup_to: str | None = None) -> None:
        """Deletes the store; with backup_to it is copied there first."""
        if not confirm:
            raise ValueError("dropping a store must be confirmed")
        if backup_to:
            self.backup(folder=backup_to)
        self.fs.delete(self._p(), True)

    def _folder(self, name: str, df: DataFrame, version: int | None = None) -> str:
        """df's rows in a new folder that no version names yet. version: that which will, by default the next."""
        folder = f"data/{name}-{version or self.version + 1:09d}-{uuid.uuid4().hex}"
        rows = df.select("document_id", "what") if name == MARKS else df.select("key", "model", "embedding") if name == VECTORS else conform(name, df)
        if name == "keywords":  # in their order, so that a filter on keywords reaches the files' statistics
            rows = rows.repartitionByRange("keyword").sortWithinPartitions("keyword")
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, folders: dict[str, list[str]], version: int) -> int:
        """The manifest, complete or not at all. The lock must still be ours and the version's place free."""
        mine = f".{uuid.uuid4().hex}"
        self._write(json.dumps(folders), "manifests", mine)
        if self._owner() != self.token or self.fs.exists(self._p("manifests", f"{version}.json")):
            self.fs.delete(self._p("manifests", mine), False)
            raise Conflict(f"version {version} was published by another writer")
        if not self.fs.rename(self._p("manifests", mine), self._p("manifests", f"{version}.json")):
            raise Conflict(f"version {version} could not be published")
        return version

    # --- the lock ---
    def _owner(self) -> str | None:
        try:
            return json.loads(self._read("LOCK"))["token"]
        except Exception:  # no lock, or one that is being written
            return None

    def lock(self) -> None:
        """One writer. A lock without a sign of life for STALE_S is taken over."""
        at = self._p("LOCK")
        if self.fs.exists(at) and time.time() * 1000 - self.fs.getFileStatus(at).getModificationTime() > STALE_S * 1000:
            self.fs.delete(at, False)
        token = uuid.uuid4().hex
        try:
            self._write(json.dumps({"token": token, "pid": os.getpid(), "at": now()}), "LOCK", overwrite=False)
        except Exception as e:
            raise Conflict("another writer holds the store") from e
        self.token = token

    def unlock(self) -> None:
        """Gives back our own lock; another's stays."""
        if self.token and self._owner() == self.token:
            self.fs.delete(self._p("LOCK"), False)
        self.token = None

    @contextmanager
    def held(self):
        """The lock, with a sign of life while the work goes on."""
        self.lock()
        done, token = threading.Event(), self.token

        def beat():
            while not done.wait(STALE_S / 3):
                if self._owner() == token:
                    self.fs.setTimes(self._p("LOCK"), int(time.time() * 1000), -1)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            self.unlock()

    def commit(self, change: Change, retries: int = RETRIES) -> int:
        """A new version. change reads the current one, under the lock, and gives tables that are replaced, rows that are added (with
        MARKS: markers, which don't concern what is added with them), and perhaps True if all markers are folded in."""

        def once() -> int:
            with self.held():
                before = self.version
                folders = self.manifest(before)
                replaced, added, *folded = change()
                folders |= {n: [self._folder(n, df, before + 1)] for n, df in replaced.items()}
                if folded:
                    folders.pop(MARKS, None)
                for n, df in added.items():
                    folders[n] = [*folders.get(n, []), self._folder(n, df, before + 1)]
                return self._publish(folders, before + 1)

        return retried(once, retries)

    @contextmanager
    def staging(self):
        """Gives a function that writes rows under the store and reads them back; they go when the block ends."""
        at = f"staging/{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            path = f"{self.path}/{at}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield keep
        finally:
            self.fs.delete(self._p(*at.split("/")), True)

    def replace(self, changed: dict[str, DataFrame]) -> int:
        """A new version with these tables changed."""
        return self.commit(lambda: (changed, {}))

    # --- reading ---
    def _paths(self, name: str, version: int | None = None) -> list[str]:
        return [f"{self.path}/{f}" for f in self.manifest(version)[name]]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows that no later marker names."""
        folders = self.manifest(version)
        rows = self.spark.read.schema(schema(name)).parquet(*(f"{self.path}/{f}" for f in folders[name]))
        marks = [f for f in folders.get(MARKS, []) if version_of(f) > min(map(version_of, folders[name]))]
        if not marks or name not in (*CHILDREN, "documents"):
            return rows
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/data/\w+-(\d{9})-\w+/", 1).try_cast("int")
        gone = self.spark.read.schema(MARK).parquet(*(f"{self.path}/{f}" for f in marks)).select("document_id", "what", at.alias("marked"))
        gone = gone.filter(F.col("what").isNull() | (F.col("what") == name)).groupBy(F.col("document_id").alias("gone")).agg(F.max("marked").alias("marked"))
        key = "id" if name == "documents" else "document_id"
        rows = rows.withColumn("written", F.coalesce(at, F.lit(0)))  # folders of older stores have no version in their names
        return rows.join(gone, (F.col(key) == F.col("gone")) & (F.col("written") < F.col("marked")), "left_anti").drop("written")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All of one version."""
        version = version or self.version
        return {n: self.table(n, version) for n in TABLES}

    def vectors(self, model: str, version: int | None = None) -> DataFrame | None:
        """key, embedding of the texts that this model embedded, once each; None if there are none. They outlive documents and processes."""
        folders = self.manifest(version).get(VECTORS)
        if not folders:
            return None
        held = self.spark.read.schema(VECTOR).parquet(*(f"{self.path}/{f}" for f in folders)).filter(F.col("model") == model)
        return held.groupBy("key").agg(F.any_value("embedding").alias("embedding"))

    def export_vectors(self, path: str) -> None:
        """All of them as files, for another store."""
        folders = self.manifest().get(VECTORS, [])
        rows = self.spark.read.schema(VECTOR).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], VECTOR)
        rows.dropDuplicates(["key", "model"]).write.parquet(path)

    def import_vectors(self, path: str) -> int:
        """Those of another store's files that aren't there yet."""
        given = self.spark.read.schema(VECTOR).parquet(path)

        def change():
            folders = self.manifest().get(VECTORS)
            if not folders:
                return {}, {VECTORS: given}
            known = self.spark.read.schema(VECTOR).parquet(*(f"{self.path}/{f}" for f in folders)).select("key", "model")
            return {}, {VECTORS: given.join(known, ["key", "model"], "left_anti")}

        return self.commit(change)

    # --- writing ---
    @staticmethod
    def accepted(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Rows as they are stored: tags, codes and keywords lower-cased, chunks and code blocks without an embedding left out."""
        out = {}
        for name, df in rows.items():
            if c := LOWER.get(name):
                df = df.withColumn(c, F.lower(c))
            out[name] = df.filter(F.size("embedding") > 0) if name in ("chunks", "code_blocks") else df
        return out

    def append(self, rows: dict[str, DataFrame]) -> int:
        """Rows added to tables, as folders of their own."""
        return self.commit(lambda: ({}, self.accepted(rows)))

    @staticmethod
    def markers(gone: DataFrame, what: str | None = None) -> DataFrame:
        """Markers for the documents of gone (document_id): of one table's rows, or of all."""
        return gone.select("document_id", F.lit(what).cast("string").alias("what")).distinct()

    def discard(self, gone: DataFrame) -> int:
        """Deletes the documents of gone (document_id), and all rows of theirs. Only their ids are written."""
        return self.commit(lambda: ({}, {MARKS: self.markers(gone)}))

    def delete(self, condition: Column) -> int:
        """The documents that meet the condition, and all rows of theirs."""
        chosen = lambda: self.table("documents").filter(F.coalesce(condition, F.lit(False))).select(F.col("id").alias("document_id"))
        return self.commit(lambda: ({}, {MARKS: self.markers(chosen())}))

    def delete_document(self, document_id: str) -> int:
        return self.delete(F.col("id") == F.lit(document_id))

    def delete_crawl(self, crawl_id: str) -> tuple[int, int]:
        """Version, and how many documents went."""
        before = self.version
        after = self.delete(F.col("crawl_id") == F.lit(crawl_id))
        return after, self.table("documents", before).filter(F.col("crawl_id") == F.lit(crawl_id)).count()

    def remove_chunks(self, document_id: str) -> int:
        one = self.spark.createDataFrame([(document_id,)], "document_id string")
        return self.commit(lambda: ({}, {MARKS: self.markers(one, "chunks")}))

    def counted(self) -> DataFrame:
        """The documents whose chunks_count or code_blocks_count differs from the rows there are, with the right ones."""
        docs = self.table("documents").withColumn("was", F.struct("chunks_count", "code_blocks_count"))
        for name, column in (("chunks", "chunks_count"), ("code_blocks", "code_blocks_count")):
            n = self.table(name).groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("n"))
            docs = docs.join(n, "id", "left")
            docs = docs.withColumn("updated_at", F.when(F.coalesce("n", F.lit(0)) != F.coalesce(column, F.lit(-1)), F.lit(now())).otherwise(F.col("updated_at"))).withColumn(column, F.coalesce("n", F.lit(0))).drop("n")
        return docs.filter(~F.struct("chunks_count", "code_blocks_count").eqNullSafe(F.col("was"))).drop("was")

    def update_counts(self) -> int:
        """Writes the documents whose counts changed, and markers for what they were."""
        with self.staging() as keep:

            def change():
                new = keep(self.counted())
                return {}, {"documents": new, MARKS: self.markers(new.select(F.col("id").alias("document_id")), "documents")}

            return self.commit(change)

    def compact(self, most: int = 1) -> int:
        """Tables of more than so many folders become one folder each; markers are folded in, where there are any."""
        folders = self.manifest()
        marked = MARKS in folders
        many = [n for n in TABLES if len(folders[n]) > most or marked and n in (*CHILDREN, "documents")]
        return self.commit(lambda: ({n: self.table(n) for n in many}, {}, *([True] if marked else []))) if many else self.version

    # --- backups ---
    def backup(self, keep: int = 7, folder: str | None = None) -> dict:
        """Copies the current version beside the store (or to folder), by Spark's tasks, and forgets the oldest copies beyond `keep`."""
        began, version = time.time(), self.version
        entry = {"id": uuid.uuid4().hex, "version": version, "timestamp": now(), "folder": folder or self.backup_folder()}
        at = f"{entry['folder']}/{entry['id']}"
        try:
            for name, df in self.tables(version).items():
                df.write.parquet(f"{at}/{name}")
            size, success = self.fs.getContentSummary(self.Path(at)).getLength(), True
        except Exception as e:  # a failed copy is part of the history
            size, success, entry["error"] = 0, False, str(e)[:500]
        entry |= {"success": success, "duration_ms": int((time.time() - began) * 1000), "size": size}
        history = [*self.backups(entry["folder"]), entry]
        old = sorted((e for e in history if e["success"]), key=lambda e: e["timestamp"], reverse=True)[keep:]
        for e in old:
            self.fs.delete(self.Path(f"{e['folder']}/{e['id']}"), True)
        self._history([e for e in history if e not in old], entry["folder"])
        return entry

    def backup_folder(self) -> str:
        """Outside the store, so that a dropped or damaged store can come back."""
        return f"{self.path}-backups"

    def _history(self, entries: list[dict], folder: str) -> None:
        out = self.fs.create(self.Path(f"{folder}/history.json"), True)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()

    def backups(self, folder: str | None = None) -> list[dict]:
        """Newest first."""
        at = self.Path(f"{folder or self.backup_folder()}/history.json")
        if not self.fs.exists(at):
            return []
        source = self.fs.open(at)
        data = bytes(source.readAllBytes())
        source.close()
        return sorted(json.loads(data), key=lambda e: e["timestamp"], reverse=True)

    def forget_backup(self, backup_id: str, folder: str | None = None) -> bool:
        every = self.backups(folder)
        gone = [e for e in every if e["id"] == backup_id]
        for e in gone:
            self.fs.delete(self.Path(f"{e['folder']}/{e['id']}"), True)
            self._history([x for x in every if x["id"] != backup_id], e["folder"])
        return bool(gone)

    def restore(self, backup_id: str, folder: str | None = None) -> int:
        """A new version with the tables of a copy; the store may be gone. Until it is published, the current version stays."""
        entry = next(e for e in self.backups(folder) if e["id"] == backup_id and e["success"])

        def once() -> int:
            with self.held():
                before = self.version
                tables = {n: self.spark.read.schema(schema(n)).parquet(f"{entry['folder']}/{entry['id']}/{n}") for n in TABLES}
                return self._publish({n: [self._folder(n, df, before + 1)] for n, df in tables.items()}, before + 1)

        return retried(once)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the newest `keep`, and the data that none of these names; how many folders went. No reader may be on an older version."""
        with self.held():
            versions = self.versions()
            held = {f for v in versions[-keep:] for folders in self.manifest(v).values() for f in folders}
            for v in versions[:-keep]:
                self.fs.delete(self._p("manifests", f"{v}.json"), False)
            gone = [n for n in self._names("data") if f"data/{n}" not in held]
            for n in gone:
                self.fs.delete(self._p("data", n), True)
            return len(gone)


def open_store(spark: SparkSession, path: str | None = None, attempts: int = 4, wait_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Store:
    """The store, ready. Opening is tried again after waits that double; a wrong schema is not."""
    for n in range(attempts):
        try:
            return Store(spark, path).open()
        except ValueError:
            raise
        except Exception:
            if n == attempts - 1:
                raise
            sleep(wait_s * 2**n)
    raise ValueError("at least one attempt is needed")


def next_backup(schedule: str, after: datetime) -> datetime:
    """When a schedule (minute hour day month weekday, as cron has it; numbers, lists, ranges, steps and stars) comes up next."""
    spans = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    parts = schedule.split()
    if len(parts) != 5:
        raise ValueError(f"not a schedule: {schedule}")
    allowed = []
    for part, (low, high) in zip(parts, spans, strict=True):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
            if not low <= first <= last <= high:
                raise ValueError(f"not a schedule: {schedule}")
            values.update(range(first, last + 1, int(step or 1)))
        allowed.append(values)
    minutes, hours, days, months, weekdays = allowed
    weekdays = {d % 7 for d in weekdays}
    either = parts[2] != "*" and parts[4] != "*"
    day = datetime(after.year, after.month, after.day, tzinfo=after.tzinfo)
    for _ in range(366 * 8):
        own, week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        if day.month in months and (own or week if either else own and week):
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = day.replace(hour=h, minute=m)
                    if at > after:
                        return at
        day += timedelta(days=1)
    raise ValueError(f"never comes up: {schedule}")


def backup_due(store: Store, schedule: str = "0 2 * * *", at: datetime | None = None) -> bool:
    """Whether the schedule came up since the last successful copy; a job runner asks, and calls backup()."""
    done = [e["timestamp"] for e in store.backups() if e["success"]]
    return not done or next_backup(schedule, datetime.strptime(done[0], "%Y-%m-%dT%H:%M:%S.%fZ")) <= (at or datetime.strptime(now(), "%Y-%m-%dT%H:%M:%S.%fZ"))
