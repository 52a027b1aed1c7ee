from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.__main__ import main
from lexloom.api import Tools
from lexloom.functions.embed import Sine
from lexloom.operators import hybrid, validate
from lexloom.plans.config import Settings
from lexloom.plans.ingest import ingest
from lexloom.sources import schema, uploads
from lexloom.sources.crawl import Crawl, reachable
from lexloom.sources.store import Conflict, Store, backup_due, next_backup, open_store, retried
from lexloom.streaming.uploads import watch


def sine():
    return Sine(16)


@pytest.fixture
def tools(spark, tmp_path):
    return Tools(open_store(spark, str(tmp_path / "store")), sine, Settings(query_languages=("unknown",)))


def test_lifecycle(tools):
    tools.add_document("Guide", "# Guide\n\nSome words.\n\n```js\nlet a = 1\n```\n- x", {"tags": ["A", "b "], "author": "Ann"})
    tools.add_document("Page", "<html><head><title>Real</title></head><body><p>Body words</p><pre class='python'>x = 1</pre></body></html>")
    t = tools.store.tables()
    titles = {r["title"]: r["id"] for r in t["documents"].collect()}
    assert set(titles) == {"Guide", "Real"}
    assert {(r["language"], r["content"]) for r in t["code_blocks"].collect()} == {("javascript", "let a = 1"), ("python", "x = 1")}
    assert validate.validate({k: t[k] for k in ("documents", "chunks", "code_blocks")}).count() == 0
    assert {r["tag"] for r in t["document_tags"].collect()} == {"a", "b"}
    rows, info = tools.query("guide words", options=hybrid.Options(threshold=0.0, default_languages=("unknown",)))
    assert [r["title"] for r in rows.collect()] == ["Guide"] and info.first()["total_documents"] == 1
    assert tools.search_documents(titles["Guide"], "words").count() > 0
    assert tools.search_code_blocks("x", language="PY").count() == 1 and tools.search_code_blocks("x", language="rust").count() == 0
    assert tools.get_code_blocks(titles["Guide"]).first()["variant_count"] == 1
    assert tools.get_context_window(titles["Guide"], 0).count() >= 1 and tools.get_document(titles["Guide"]).first()["tags"] == ["a", "b"]
    tools.generate_tags(titles["Guide"], lambda p: '["New"]')
    assert tools.get_document(titles["Guide"]).first()["tags_generated"] == ["new"]
    got = tools.search_documents_with_ai(titles["Guide"], "words", lambda p: '{"relevant_sections": [{"chunk_index": 0, "content": "Some"}]}')
    assert got.first()["content"] == "Some"
    tools.delete_document(titles["Guide"])
    t = tools.store.tables()
    assert t["documents"].count() == 1 and t["chunks"].filter(F.col("document_id") == titles["Guide"]).count() == 0
    assert tools.list_documents(preview_length=4).first()["preview"] == "Body..."
    assert isinstance(tools.add_document(" ", "x"), str)


def test_queries_through_the_index(tools):
    """The index gives what a scan gives, grows with the store, and deleted documents are in no result."""
    text = lambda i: f"Guide {i}\n\nwords about subject {i} and number {i * 7}"
    for i in range(3):
        tools.add_document(f"Doc {i}", text(i))
    o = hybrid.Options(threshold=0.0, default_languages=("unknown",))
    ask = lambda: [(r["title"], round(r["score"], 5)) for r in tools.query("words about subject 2", options=o)[0].collect()]
    plain = ask()
    tools.build_index()
    assert ask() == plain and len(plain) == 3
    tools.add_document("Doc 9", text(9))
    assert {t for t, _ in ask()} == {t for t, _ in plain} | {"Doc 9"} and not tools.sync_index()
    ids = {r["title"]: r["id"] for r in tools.list_documents().collect()}
    tools.delete_document(ids["Doc 2"])
    assert {t for t, _ in ask()} == {"Doc 0", "Doc 1", "Doc 9"}


def test_crawl_sessions(tools):
    pages = {"https://e.com/robots.txt": "User-agent: *\nDisallow: /no\nSitemap: /map.xml", "https://e.com/map.xml": "<loc>https://e.com/c</loc>"}
    pages |= {f"https://e.com/{p}": f"<title>{p or 'home'}</title><p>words of {p}</p><a href='/a'>a</a><a href='/no/x'>n</a><a href='https://o.com/'>o</a>" for p in ("", "a", "c", "no/x")}
    fetch = lambda u: (200, "text/html; charset=utf-8" if not u.endswith(("xml", "txt")) else "text/plain", pages[u]) if u in pages else (404, "", "")
    got = tools.crawl_documentation("https://e.com/", fetch, crawl_id="s1")
    assert got["pages"] == 3 and [p["depth"] for p in Crawl(fetch, max_pages=9).run("https://e.com/")] == [0, 1, 1]
    assert len(Crawl(fetch, max_pages=1).run("https://e.com/")) == 1 and len(Crawl(fetch, max_depth=0).run("https://e.com/")) == 1
    assert tools.delete_crawl_session("other") == 0 and tools.delete_crawl_session("s1") == 3 and tools.store.table("documents").count() == 0


def test_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "url string, target string")
    got = {r["url"]: r["depth"] for r in reachable(links, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_uploads(spark, tools, tmp_path):
    folder = tmp_path / "up"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("alpha words")
    (folder / "sub/b.md").write_text("# beta")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.bin").write_bytes(b"x")
    listed = {r["name"]: r["supported"] for r in tools.list_uploads_files(str(folder)).collect()}
    assert listed == {"a.txt": True, "b.md": True, "c.pdf": True, "d.bin": False}
    got = tools.process_uploads(str(folder))
    assert got["processed"] == 2 and len(got["errors"]) == 1
    assert tools.process_uploads(str(folder), pdf=lambda d: "pdf words")["processed"] == 3 and tools.store.table("documents").count() == 3
    assert uploads.inside("/u/a/../b", "/u") and not uploads.inside("/u/../x", "/u") and not uploads.inside("/upper", "/up")


def test_streaming(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("some words")
    for _ in range(2):
        watch(store, str(tmp_path / "in"), str(tmp_path / "cp"), sine, "sine", once=True).awaitTermination()
    assert [r["title"] for r in store.table("documents").collect()] == ["a.txt"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s")).create().open()
    raw = spark.createDataFrame([("t", "some words")], "title string, content string")
    ingest(store, raw, sine, "sine")
    kept = store.backup()
    ingest(store, raw.withColumn("title", F.lit("u")), sine, "sine")
    assert store.table("documents").count() == 2 and store.table("documents", kept["version"]).count() == 1
    store.restore(kept["id"])
    assert store.table("documents").count() == 1 and store.vacuum() > 0 and store.table("documents").count() == 1
    store.lock()
    with pytest.raises(RuntimeError):
        ingest(store, raw, sine, "sine")
    store.unlock()
    ingest(store, raw, sine, "sine", replace_titles=True)
    assert store.table("documents").count() == 1
    docs = store.table("documents")
    store.remove_chunks(docs.first()["id"])
    store.update_counts()
    assert store.table("documents").first()["chunks_count"] == 0
    assert store.forget_backup(kept["id"]) and not store.backups()
    with pytest.raises(ValueError):
        schema.checked("documents", docs.drop("title"))
    with pytest.raises(ValueError):
        store.drop()
    store.drop(confirm=True)
    assert not store.exists()


def test_a_crash_leaves_the_last_version(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    raw = spark.createDataFrame([("t", "some words")], "title string, content string")
    ingest(store, raw, sine, "sine")
    kept = store.version
    class Broken:
        def __getattr__(self, name):
            return getattr(store_fs, name)

        def rename(self, *a):
            raise OSError("the machine is gone")

    store_fs = store.fs
    store.fs = Broken()
    with pytest.raises(OSError):
        ingest(store, raw.withColumn("title", F.lit("u")), sine, "sine")
    store.fs = store_fs
    again = open_store(spark, str(tmp_path / "s"))
    assert again.version == kept and again.table("documents").count() == 1
    ingest(again, raw.withColumn("title", F.lit("u")), sine, "sine")
    assert again.table("documents").count() == 2 and again.vacuum() > 0 and again.table("documents").count() == 2


def test_two_writers(spark, tmp_path):
    """One that lost its lock can't publish, nor take the other's lock away; the other's rows stay."""
    a, b = open_store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    tag = lambda n: {"document_tags": spark.createDataFrame([(n, "d", n, False, "")], schema.schema("document_tags"))}
    a.lock()
    a.fs.setTimes(a._p("LOCK"), 1, -1)  # no sign of life
    with b.held():
        a.unlock()
        assert b._owner() == b.token
        with pytest.raises(Conflict):
            a._publish({}, a.version + 1)
    before = a.manifest()

    calls = []

    def change():
        if not calls:  # while a works, b publishes
            b.token = a.token
            b._publish(before | {"document_tags": [b._folder("document_tags", tag("b")["document_tags"])]}, a.version + 1)
        calls.append(1)
        return {}, tag("a")

    a.commit(change)
    assert len(calls) == 2
    assert {r["tag"] for r in a.table("document_tags").collect()} == {"a", "b"}


def test_append_writes_new_rows_only(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    rows = lambda n: {"document_tags": spark.range(n).selectExpr("uuid() AS id", "'d' AS document_id", "uuid() AS tag", "false AS is_generated", "'' AS created_at")}
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s/data").rglob("*.parquet"))
    store.append(rows(20_000))
    big = size()
    store.append(rows(10))
    assert size() - big < big / 20 and store.table("document_tags").count() == 20_010
    store.compact()
    assert len(store.manifest()["document_tags"]) == 1 and store.table("document_tags").count() == 20_010


def test_deletion_writes_ids_only(spark, tmp_path):
    """What a deletion writes doesn't follow the table; rows that come later under a deleted id stay; compaction folds the markers in."""
    wrote = {}
    for n in (200, 4000):
        store = open_store(spark, str(tmp_path / f"s{n}"))
        docs = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "uuid() AS title", "repeat(uuid(), 20) AS content", "'active' AS status", "IF(id % 2 = 0, 'c', 'd') AS crawl_id")
        chunks = spark.range(2 * n).selectExpr("CAST(id AS STRING) AS id", "CAST(id DIV 2 AS STRING) AS document_id", "uuid() AS content", "array(CAST(1 AS FLOAT), CAST(rand() AS FLOAT)) AS embedding")
        store.append({"documents": docs, "chunks": chunks})
        size = lambda: sum(f.stat().st_size for f in (tmp_path / f"s{n}/data").rglob("*.parquet"))  # noqa: B023, E731
        before = size()
        store.delete_document("7")
        store.remove_chunks("9")
        wrote[n] = size() - before
        assert (store.table("documents").count(), store.table("chunks").count()) == (n - 1, 2 * n - 4)
        store.append({"documents": docs.filter("id = '7'"), "chunks": chunks.filter("document_id = '9'")})
        assert (store.table("documents").count(), store.table("chunks").count()) == (n, 2 * n - 2)
    assert wrote[4000] < 1.1 * wrote[200] < before / 10
    store.update_counts()
    t = store.table("documents")
    assert (t.count(), t.filter("chunks_count = 2").count(), t.filter("id = '7' AND chunks_count = 0").count()) == (n, n - 1, 1)
    size_before = size()
    store.update_counts()
    assert size() - size_before < before / 10  # nothing changed, nothing is written
    assert store.delete_crawl("c")[1] == n // 2 and store.table("documents").count() == n // 2
    assert store.discard(spark.range(1, 40, 2).selectExpr("CAST(id AS STRING) AS document_id")) and store.table("documents").count() == n // 2 - 20
    copy, held = store.backup(), sorted(map(tuple, store.table("chunks").select("id", "document_id").collect()))
    store.compact()
    assert "deleted" not in store.manifest() and sorted(map(tuple, store.table("chunks").select("id", "document_id").collect())) == held
    store.restore(copy["id"])
    assert sorted(map(tuple, store.table("chunks").select("id", "document_id").collect())) == held and store.vacuum() > 0


class Counting(Sine):
    def __init__(self, path):
        super().__init__(8)
        self.path = path

    def batch(self, texts):
        with open(self.path, "a") as f:
            f.writelines("x\n" for _ in texts)
        return super().batch(texts)


def test_each_text_is_embedded_once(spark, tmp_path):
    store, log = open_store(spark, str(tmp_path / "s")), str(tmp_path / "calls")
    raw = spark.createDataFrame([(f"t{i}", f"# words\n\n```js\nlet a = {i}\n```\nand {i}", "api") for i in range(5)], "title string, content string, source string")
    ingest(store, raw.unionByName(raw), lambda: Counting(log), "sine")
    t = store.tables()
    n = t["chunks"].select("content").distinct().count() + t["code_blocks"].select("content").distinct().count()
    assert len(open(log).readlines()) == n and t["documents"].count() == 5
    assert validate.validate({k: t[k] for k in ("documents", "chunks", "code_blocks")}).count() == 0
    before = store.version
    ingest(store, raw.limit(2), sine, "sine", replace_titles=True)
    assert store.version == before + 1 and store.table("documents").count() == 5


def test_vectors_outlive_the_process(spark, tmp_path):
    """A model is asked nothing that the store has seen: after a deletion, in another store that took the vectors over, and for part of the texts."""
    log = tmp_path / "calls"
    asked = lambda: len(log.read_text().splitlines()) if log.exists() else 0
    raw = spark.createDataFrame([(f"t{i}", f"# words\n\n```js\nlet a = {i}\n```\nand {i}", "api") for i in range(4)], "title string, content string, source string")
    store = open_store(spark, str(tmp_path / "s"))
    ingest(store, raw, lambda: Counting(str(log)), "sine")
    n, first = asked(), sorted(map(tuple, store.table("chunks").select("content", "embedding").collect()))
    assert n == store.vectors("sine").count() > 0 and store.vectors("other") is None or store.vectors("other").count() == 0
    store.discard(store.table("documents").select(F.col("id").alias("document_id")))
    again = open_store(spark, str(tmp_path / "s"))
    ingest(again, raw, lambda: Counting(str(log)), "sine")
    assert asked() == n and sorted(map(tuple, again.table("chunks").select("content", "embedding").collect())) == first
    again.export_vectors(str(tmp_path / "v"))
    other = open_store(spark, str(tmp_path / "o"))
    other.import_vectors(str(tmp_path / "v"))
    before = other.vectors("sine").count()
    other.import_vectors(str(tmp_path / "v"))
    ingest(other, raw.unionByName(raw.limit(1).withColumn("content", F.lit("new words only"))), lambda: Counting(str(log)), "sine")
    assert asked() == n + 1 and other.vectors("sine").count() == before + 1 == n + 1


def test_backups(spark, tmp_path):
    store = open_store(spark, str(tmp_path / "s"))
    ingest(store, spark.createDataFrame([("t", "some words")], "title string, content string"), sine, "sine")
    assert backup_due(store)
    copies = [store.backup(keep=2) for _ in range(3)]
    assert [e["id"] for e in store.backups()] == [copies[2]["id"], copies[1]["id"]] and not backup_due(store)
    store.drop(confirm=True)
    assert not store.exists() and store.restore(copies[2]["id"]) == 1 and store.table("documents").count() == 1
    at = datetime(2024, 2, 28, 3)
    assert next_backup("0 2 * * *", at) == datetime(2024, 2, 29, 2) and next_backup("30 3 * * 0", at) == datetime(2024, 3, 3, 3, 30)
    assert next_backup("*/20 4-5 1 1,6 *", at) == datetime(2024, 6, 1, 4) and next_backup("0 0 13 * 5", at) == datetime(2024, 3, 1)
    with pytest.raises(ValueError):
        next_backup("61 * * * *", at)


def test_opening_is_tried_again(spark, tmp_path, monkeypatch):
    waits, real = [], Store.open

    def flaky(self):
        if len(waits) < 2:
            raise OSError("not yet")
        return real(self)

    monkeypatch.setattr(Store, "open", flaky)
    assert open_store(spark, str(tmp_path / "s"), sleep=waits.append).exists() and waits == [0.5, 1.0]
    tries = []
    with pytest.raises(Conflict):
        retried(lambda: (_ for _ in ()).throw(Conflict("x")), sleep=tries.append)
    assert tries == [0.1, 0.2, 0.4, 0.8, 1.6]


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "s")
    assert main(["init", path], spark) == 0 and main(["init", path], spark) == 1 and main(["drop", path], spark) == 1
    assert main(["stats", path], spark) == 0 and '"documents": 0' in capsys.readouterr().out
    assert main(["drop", path, "--confirm", "--backup-to", str(tmp_path / "b")], spark) == 0
    assert main(["restore", path, "--backup-to", str(tmp_path / "b")], spark) == 0 and main(["validate", path], spark) == 0


def test_single_uploads(spark, tools, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.txt").write_text("alpha words")
    (tmp_path / "secret.txt").write_text("no")
    (tmp_path / "up/link.txt").symlink_to(tmp_path / "secret.txt")
    assert tools.process_upload(str(tmp_path / "up"), "a.txt", title="Other")["processed"] == 1
    assert tools.list_documents(include_metadata=True).first()["title"] == "Other"
    for path in ("../secret.txt", "link.txt", str(tmp_path / "secret.txt")):
        with pytest.raises(ValueError):
            tools.process_upload(str(tmp_path / "up"), path)
    assert tools.features()["store"]["version"] == tools.store.version
