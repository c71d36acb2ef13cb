import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import markup, sinks
from millrace.streaming import feeds

RSS = """<rss><channel><item><title><![CDATA[One & all]]></title><link>http://a.example/1</link><description>&lt;b&gt;Bold&lt;/b&gt; text</description><pubDate>Mon, 1 Jan 2024 00:00:00 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed><entry><title>Atom</title><link href="http://a.example/2"/><summary>S</summary><updated>2024-01-01</updated></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("f1", RSS), ("f2", ATOM), ("f3", None), ("f4", "<rss></rss>")], "feed_url string, xml string")
    got = {r.id: (r.title, r.link, r.published) for r in markup.rss_items(df).collect()}
    assert got == {"f1-0": ("One & all", "http://a.example/1", "Mon, 1 Jan 2024 00:00:00 GMT"), "f2-0": ("Atom", "http://a.example/2", "2024-01-01")}


def test_html():
    p = markup.parse_html("<title>T &amp; t</title><script>var x=1</script><nav>Menu</nav><h1>Head</h1><p>A paragraph that is long enough<br>and more<p>short<table><tr><td>a<td>b</table><footer>x</footer>")
    assert p["title"] == "T & t" and p["headers"] == ["Head"] and len(p["paragraphs"]) == 1 and p["tables"] == [["a", "b"]]
    assert "Menu" not in p["text"] and "var" not in p["text"] and p["text"].startswith("Head A paragraph")
    assert markup.parse_html(None)["text"] == "" and markup.parse_html("<h2>Only")["title"] == "Only"


def test_documents_of_files(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p><w:t>Three</w:t></w:p></w:document>")
    (tmp_path / "a.docx").write_bytes(z.getvalue())
    (tmp_path / "b.docx").write_bytes(b"junk")
    (tmp_path / "c.html").write_text("<p>Hi there</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.path.rpartition("/")[2]: (r.kind, r.success, r.text) for r in markup.documents_of(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.docx": ("docx", True, "One & two\nThree"), "b.docx": ("docx", False, None), "c.html": ("html", True, "Hi there"), "d.pdf": ("pdf", False, None)}


def test_answers_and_robots(spark):
    df = spark.createDataFrame([('{"query":"q","results":[{"title":"T","url":"u","engine":"e"},{"title":"","url":"u"}]}',), ("bad",), (None,)], "json string")
    assert [tuple(r) for r in markup.engine_answers(df, prefix="x-").collect()] == [("q", "T", "u", "", "x-e", 1)]
    assert [r.b for r in spark.createDataFrame([("a captcha",), (None,)], "h string").select(markup.blocked_page(F.col("h")).alias("b")).collect()] == [True, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', None, 1)], "t string, d string, n int")
    assert sinks.as_csv_lines(df, "t", "d").first().value == '"a ""q"", b",""'
    assert sinks.as_json_lines(df).first().value == '{"t":"a \\"q\\", b","d":null,"n":1}'
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().t == 'a "q", b'
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_feed_stream(spark, tmp_path):
    schema = "id string, title string, description string, content string, published_at timestamp, url string, created_at timestamp"
    for i, (t, u) in enumerate([("first", "u1"), ("second", "u2")]):
        spark.sql(f"select 'a' id, '{t}' title, 'd' description, 'c' content, timestamp'2024-01-0{i + 1} 00:00:00' published_at, '{u}' url, timestamp'2024-01-0{i + 1} 00:00:00' created_at").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(2):
        shutil.copy(next((tmp_path / f"in/b{i}").glob("*.parquet")), flat / f"{i}.parquet")
        feeds.poll_feeds(spark, str(flat), schema, str(tmp_path / "table"), str(tmp_path / "chk")).awaitTermination()
    last = max((tmp_path / "table").iterdir())
    assert [(r.title, r.url) for r in spark.read.parquet(str(last)).collect()] == [("second", "u1")]


def test_limit_stream(spark, tmp_path):
    spark.sql("select 'k' as u, timestamp_seconds(id) as ts from range(10)").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "e"))
    q = feeds.limit_stream(s, "u", "ts", 2, 5.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.allowed for r in spark.sql("select allowed from limited order by us").collect()]
    assert got == [True, True, False, False, False] * 2


@pytest.mark.parametrize("late", ["2 hours"])
def test_hourly_counts(spark, late):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as at, 'a' as kind union all select timestamp'2024-01-01 00:50:00', 'a'")
    assert [r.n for r in feeds.hourly_counts(df, "at", "kind", late).collect()] == [2]
