import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import answers, chunk, embed, html, langtag, language, markdown, text, urls


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_keywords_keep_order_and_repeats(spark):
    assert one(spark, text.keywords(F.col("t")), t="The Quick, quick fox is ab " + "x" * 20) == ["quick", "quick", "fox"]
    assert text.query_keywords("The Quick, quick café") == ["quick", "quick", "caf"]


def test_hash_trims_first(spark):
    assert one(spark, text.content_hash(F.col("t")), t=" a \n") == one(spark, text.content_hash(F.col("t")), t="a")


@pytest.mark.parametrize("raw, want", [("Upload ", "upload"), ("crawler", "api"), (None, "api")])
def test_source(spark, raw, want):
    assert one(spark, text.normalize_source(F.col("t")), t=raw) == want


def test_tags(spark):
    assert one(spark, text.split_tags(F.col("t")), t=" A,b,, a ,C") == ["a", "b", "c"]


def test_preview(spark):
    assert one(spark, text.preview(F.col("t"), 3), t="abcd") == "abc..." and one(spark, text.preview(F.col("t"), 3), t="abc") == "abc"


def test_phrase(spark):
    assert one(spark, text.phrase_match(F.col("t"), "Foo-Bar"), t="a foobar b") and not one(spark, text.phrase_match(F.col("t"), "f!"), t="f")


@pytest.mark.parametrize("raw, want", [("JavaScript", "javascript"), ("js", "javascript"), ("ts", "typescript"), ("c#", "csharp"), ("c++", "cpp"), ("sh", "shell"), ("", "unknown"), ("  ", "unknown"), (None, "unknown"), ("UNKNOWN-LANG", "unknown-lang"), ("{.lang-js}", "javascript")])
def test_language_tag(spark, raw, want):
    assert one(spark, langtag.language_tag(F.col("t")), t=raw) == want == langtag.tag_of(raw)


def test_code_language(spark):
    f = langtag.code_language(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, f, a=None, b=None, c="x.PY") == "python" and one(spark, f, a="rs", b=".js", c=None) == "rust" and one(spark, f, a=None, b=".xyz", c=None) is None


@pytest.mark.parametrize("have, accepted, want", [(["en"], None, True), (["unknown"], ["en"], False), (["unknown"], ["unknown"], True), (["fr", "en"], ["en"], True), (["fr"], ["en"], False)])
def test_allowed(spark, have, accepted, want):
    assert one(spark, langtag.allowed(F.col("t"), accepted), t=have) is want


@pytest.mark.parametrize("have, wanted, want", [([], ["en"], False), ([], ["unknown"], True), (["en"], [], True), (["en"], ["en", "no"], True), (["de"], ["en"], False)])
def test_matches(spark, have, wanted, want):
    assert one(spark, langtag.matches(F.col("t"), wanted), t=have) is want


def test_parse_languages():
    assert langtag.parse_languages(" EN, no ,,") == ["en", "no"] and langtag.parse_languages("  ") is None


@pytest.mark.parametrize("url, want", [("HTTP://Www.E.com:80//a//b/?q=1#f", "http://www.e.com/a/b?q=1"), ("https://e.com/", "https://e.com/"), ("ftp://e.com/a", None), ("https://e.com/a/../b/", "https://e.com/b")])
def test_normal_url(url, want):
    assert urls.normal(url) == want


def test_robots():
    rules = urls.robots("User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b*c # why\nSitemap: /s.xml", "https://e.com")
    assert rules == {"allow": ["/a/b*c"], "disallow": ["/a"], "sitemap": ["https://e.com/s.xml"]}
    assert urls.permitted("/a/bx", rules) and not urls.permitted("/a/x", rules) and urls.permitted("/z", rules)


def test_html_page():
    got = html.extract('<title>Doc &amp; Title</title><nav>menu</nav><main>Hello<br>you<p>a<p>b</main><script>var t="</p>";</script><a href="/x">l</a><a href="#f">f</a><a href="mailto:a@b">m</a><a href="https://o.com/y">o</a>', "https://e.com/base/")
    assert got["title"] == "Doc & Title" and got["links"] == ["https://e.com/x", "https://o.com/y"]
    assert "Hello\nyou" in got["text"] and "menu" not in got["text"] and "var" not in got["text"] and "a\nb" in got["text"]
    assert html.extract("<p>x", "https://e.com/path/to/page")["title"] == "page" and html.extract("", None, "f")["title"] == "f"


def blocks(source):
    return [(b["block_id"], b["language"], b["content"], b["extraction_method"]) for b in html.extract(source)["code_blocks"]]


def test_code_blocks():
    assert blocks('<pre><code class="language-javascript">a</code></pre><pre class="python"><code>b</code></pre><pre><code>c</code></pre><pre><code> </code></pre>') == [("block-0", "javascript", "a", "standard"), ("block-1", "python", "b", "standard"), ("block-2", "unknown", "c", "plain")]
    tabs = '<div class="tabs"><div class="tab" data-lang="js"><pre><code>x</code></pre></div><div class="tab" data-lang="python"><pre><code>x</code></pre></div></div>'
    assert blocks(tabs) == [("tabbed-block-0", "javascript", "x", "tabbed"), ("tabbed-block-0", "python", "x", "tabbed")]
    assert [b[3] for b in blocks('<pre data-language="rust">r</pre><pre data-lang="go">g</pre>')] == ["data-lang", "data-lang-short"]
    assert blocks('<pre>same</pre><pre class="ruby">same</pre>') == [("block-1", "ruby", "same", "standard")]


def test_markdown(spark):
    found = one(spark, markdown.code_blocks(F.col("t")), t="a\n```js\nx = 1\n```\nb\n~~~\n\n~~~\n~~~py\ny\n~~~")
    assert [(b["block_id"], b["language"], b["content"]) for b in found] == [("block-0", "javascript", "x = 1"), ("block-1", "python", "y")]


@pytest.mark.parametrize("source, want", [("plain words", "text"), ("# A\n- b\n", "markdown"), ("<html><body>x", "html"), ("function a() class b", "code"), ("# A\nfunction b", "mixed")])
def test_kind(spark, source, want):
    assert one(spark, text.content_kind(F.col("t")), t=source) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=300), st.integers(5, 40), st.integers(0, 10))
def test_chunks_are_where_they_say(source, size, overlap):
    got = chunk.chunks(source, "text", size, min(overlap, size - 1))
    assert all(source[c["start_position"] : c["end_position"]] == c["content"] and 0 < len(c["content"]) <= size for c in got)
    assert "".join(sorted("".join(c["content"] for c in chunk.chunks(source, "text", size, 0)).replace(" ", "").replace("\n", ""))) == "".join(sorted(source.replace(" ", "").replace("\n", "")))


def test_embedding_once_for_each_text(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b"), (4, None)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in embed.embedded(rows, "t", lambda: embed.Sine(8), "sine").collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and len(got[3]) == 8


def test_failover():
    class Bad(embed.Sine):
        def batch(self, texts):
            raise OSError

    p = embed.Failover([Bad(4), embed.Sine(4)])
    assert len(p.embed("x")) == 4 and p.at == 1
    with pytest.raises(ValueError):
        embed.Failover([type("Short", (embed.Sine,), {"batch": lambda s, t: [[1.0]] * len(t)})(4)]).embed("x")


def test_detect_language(spark):
    rows = spark.createDataFrame([("en", "the house and the garden with the dog"), ("de", "das Haus und der Garten mit dem Hund"), (None, "x")], "lang string, text string")
    detect = language.Detector(language.profiles(rows))
    assert detect("the dog and the garden")[0] == "en" and detect("der Hund und das Haus")[0] == "de" and detect("12")[0] == "unknown"
    assert one(spark, language.detected(F.col("t"), language.profiles(rows)), t="the dog") == ["unknown"]


def test_answers(spark):
    assert one(spark, answers.tags(F.col("t")), t='Sure: ["A", "b"]') == ["a", "b"] and one(spark, answers.tags(F.col("t")), t="x, Y\nz") == ["x", "y", "z"]
    got = one(spark, answers.sections(F.col("t")), t='text {"relevant_sections": [{"chunk_index": 1, "content": "c"}, {"chunk_index": 2}]} end')
    assert [(s["chunk_index"], s["content"]) for s in got] == [(1, "c")]


def test_sitemap_and_entities(spark):
    assert one(spark, text.sitemap_locs(F.col("t")), t="<LOC> https://e.com/?a&amp;b </LOC><loc> </loc>") == ["https://e.com/?a&b"]
    assert one(spark, html.decoded_entities(F.col("t")), t="a &lt; <b>c</b>") == "a < c"


def test_title_from_url(spark):
    assert one(spark, urls.title_from_url(F.col("t")), t="https://e.com/a/b%20c/") == "b c" and one(spark, urls.title_from_url(F.col("t")), t="https://e.com/") == "e.com"
