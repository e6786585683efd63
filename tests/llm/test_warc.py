"""WARC derivatives, and readers on whole, broken and compressed files."""

import collections
import gzip
import html.parser
import random
import zlib

from quirespark.llm import warc

def test_warc(spark):
    html = '<html><head><title>T &amp; t</title><style>x</style></head><body><p>One <b>two</b></p><script>no</script><a href="/x?a=1&amp;b=2">three</a></body></html>'
    pages = spark.createDataFrame([(1, "http://e.org/a b", html), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    responses = warc.page_responses(pages)
    found = warc.derive(responses, keep=("page_id",)).collect()
    assert collections.Counter((r.page_id, r.record_type) for r in found) == {(1, "metadata"): 1, (1, "conversion"): 1, (2, "metadata"): 2, (2, "conversion"): 2}
    source = next(warc.records(responses.where("page_id = 1").first().record))
    for r in (x for x in found if x.page_id == 1):
        back = next(warc.records(r.record))
        assert back.get("WARC-Refers-To") == source.get("WARC-Record-ID") == r.refers_to
        assert back.get("WARC-Source-Payload-Digest") == warc.digest(html.encode()) == r.source_payload_digest
        assert back.block.decode() == r.block and int(back.get("Content-Length")) == len(back.block)
        assert back.get("WARC-Block-Digest") == warc.digest(back.block)
    texts = {r.record_type: r.block for r in found if r.page_id == 1}
    assert texts["conversion"] == "One two\nthree"
    assert "title: T & t\r\n" in texts["metadata"] and "outlink: /x?a=1&b=2\r\n" in texts["metadata"] and "http-Content-Type: text/html" in texts["metadata"]


def test_warc_files(spark, tmp_path):
    one, two = warc.response("http://a", b"<p>hi"), warc.response("http://b", b"x", "text/plain")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one.raw()) + gzip.compress(two.raw()))
    (tmp_path / "b.warc").write_bytes(one.raw() + two.raw())
    (tmp_path / "c.warc").write_bytes(b"no records")
    found = warc.read_warc(spark, "file://" + str(tmp_path))
    assert found.where("error is null").count() == 4
    assert [(r.block, bytes(r.record), r.error) for r in found.where("error is not null").collect()] == [("no records", b"no records", "no record")]
    assert sorted(r.block for r in warc.derive(found.select("record")).where("record_type = 'conversion'").collect()) == ["hi", "hi", "x", "x"]
    body = b"5\r\nhello\r\n1\r\n!\r\n0\r\n\r\n"
    assert warc.http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)[2] == b"hello!"


def shown(data):
    return [(r.get("WARC-Target-URI"), r.error, len(r.block)) for r in warc.records(data)]


def test_broken_files():
    """What is no whole record gives an error, and the records behind it are read."""
    one, two, three = (warc.response(f"http://{c}", f"<p>{c}".encode() * n) for c, n in (("a", 1), ("b", 200_000), ("c", 3)))
    a, b, c = (x.raw() for x in (one, two, three))
    whole = [(x.get("WARC-Target-URI"), "", len(x.block)) for x in (one, two, three)]
    assert shown(a + b + c) == shown(b"".join(map(gzip.compress, (a, b, c)))) == shown(gzip.compress(a + b + c)) == whole
    first, last = whole[:1], whole[2:]
    assert shown(a + b"garbage\r\nmore\n" + c) == first + [("", "no record", 13)] + last
    assert shown(a + b"WARC/1.1\r\nX: y\r\n\r\nbody\r\n\r\n" + c) == first + [("", "a record without a length", 25)] + last
    assert shown(a + b"WARC/1.1\r\nX: y\r\n" + b"z" * warc.MOST_HEAD + b"\n" + c)[1][1] == "a record without an end of its fields"
    assert shown(a + b"WARC/1.1\r\nX: y\r\n" + b"z" * 3 * warc.MOST_HEAD + b"\n" + c)[-1:] == last
    assert shown(a + b[:-1000]) == first + [("http://b", f"cut short: {len(two.block) - 996} of {len(two.block)} bytes", len(two.block) - 996)]
    packed = bytearray(gzip.compress(b))
    packed[len(packed) // 2] ^= 255
    for middle in (bytes(packed), b"junk", gzip.compress(b)[:-300]):
        found = shown(gzip.compress(a) + middle + gzip.compress(c))
        assert found[0] == whole[0] and found[-1] == whole[2] or middle == gzip.compress(b)[:-300]
        assert any(x[1] for x in found)
    assert shown(b"no records") == [("", "no record", 10)] and shown(b"") == shown(b"\r\n") == []


def test_cut_anywhere():
    """Of a file cut at any byte no record is lost unseen."""
    r = random.Random(3)
    parts = [warc.response(f"http://{i}", bytes(r.randrange(256) for _ in range(r.randrange(0, 400)))) for i in range(6)]
    for data in (b"".join(x.raw() for x in parts), b"".join(gzip.compress(x.raw()) for x in parts)):
        for end in range(0, len(data), 41):
            found = list(warc.records(data[:end]))
            good = [x for x in found if not x.error]
            assert [x.block for x in good] == [x.block for x in parts[: len(good)]]
            assert end == 0 or len(good) == len(parts) or any(x.error for x in found) or sum(len(x.raw()) for x in good) >= end - 8 or data[:2] == b"\x1f\x8b"


class Shown(html.parser.HTMLParser):
    """The words of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template", "svg"):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def test_plain_text(spark):
    assert warc.plain_text("<html><head><script>x</script><title>TITLE</title></head><body><p>Body</p>") == "Body"
    assert warc.plain_text("<head><meta a><style>s</style><body>text<title>a</title>more") == "text more"
    r = random.Random(5)
    for _ in range(200):
        page = "<html>" + "".join(r.choice(["<p>", "</p>", " one two ", " &amp; ", "<title>t</title>", "<script>if (a) b</script>", "<style>c</style>", "<b>", "</b>", "<!-- no -->", "<svg><path d></svg>", "<br/>", " x1 "]) for _ in range(30))
        parser = Shown()
        parser.feed(page)
        parser.close()
        assert "".join(warc.plain_text(page).split()) == "".join(parser.words)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {x.page_id: x.block for x in warc.derive(warc.page_responses(pages), keep=("page_id",)).where("record_type = 'conversion'").collect()}
    for row in pages.collect():
        parser = Shown()
        parser.feed(row.html or "")
        parser.close()
        assert "".join(texts[row.page_id].split()) == "".join(parser.words)


def test_codings():
    body = b"<p>words</p>" * 999
    for coding, packed in (("gzip", gzip.compress(body)), ("deflate", zlib.compress(body)), ("deflate", zlib.compress(body)[2:-4]), ("gzip", body)):
        assert warc.http(b"HTTP/1.1 200 OK\r\nContent-Encoding: " + coding.encode() + b"\r\n\r\n" + packed)[2] == body
    assert body.startswith(warc.http(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(body)[:-20])[2])


def test_clashing_names(spark):
    """Kept columns named like the result's give way to them; a broken record gives an error row and keeps its columns."""
    good = warc.response("http://a", b"<p>hi").raw()
    table = spark.createDataFrame([(1, "x", "y", good), (2, "x", "y", good[:-30]), (3, None, None, None)], "content int, block string, error string, record binary")
    found = warc.derive(table, keep=("record", "content", "block", "error", "content"))
    assert found.columns[0] == "content" and len(set(found.columns)) == len(found.columns)
    assert collections.Counter((r.content, r.record_type, bool(r.error)) for r in found.collect()) == {(1, "metadata", False): 1, (1, "conversion", False): 1, (2, "response", True): 1}
    pages = spark.createDataFrame([(1, "http://e.org", "<p>x" * 10, "r")], "page_id int, url string, html string, record string")
    assert warc.page_responses(pages, keep=("page_id", "record", "html")).columns == ["page_id", "html", "record"]


def test_long_pages(spark):
    """Pages beyond a batch, many in a file."""
    rows = [(i, f"http://{i}", "<p>word</p>" * 300_000) for i in range(5)]
    found = warc.derive(warc.page_responses(spark.createDataFrame(rows, "page_id int, url string, html string")), keep=("page_id",))
    assert {(r.page_id, r.content_length) for r in found.where("record_type = 'conversion'").select("page_id", "content_length").collect()} == {(i, 300_000 * 5 - 1) for i in range(5)}
