"""Responses as crawls hold them (chunked, compressed, cut off), files of many members, and plain text against a parser's."""

import gzip
import random
import zlib
from html.parser import HTMLParser

import pyarrow.parquet as pq

from threadloom.llm import warc

HTML = "<html><body><h1>Title</h1><p>he" + "l" * 300 + "o &amp; wörld</p></body></html>"
PLAIN = "Title\nhe" + "l" * 300 + "o & wörld"


def chunked(data, r):
    out, at = b"", 0
    while at < len(data):
        n = r.randint(1, 60)
        out += f"{len(data[at : at + n]):x}".encode() + (b";ext=1" if r.random() < 0.3 else b"") + b"\r\n" + data[at : at + n] + b"\r\n"
        at += n
    return out + b"0\r\n\r\n"


def text_of(payload, *http):
    head = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *http]).encode() + b"\r\n\r\n"
    meta, conversion = warc.derive_one([("WARC-Record-ID", "<urn:x>"), ("WARC-Type", "response")], head + payload)
    assert f"WARC-Source-Payload-Digest: {warc.digest(payload)}" in conversion[11]  # of the stored form
    return conversion[12]


def test_codings():
    r, body = random.Random(1), HTML.encode()
    bare = zlib.compressobj(wbits=-15)
    forms = {"": body, "gzip": gzip.compress(body), "deflate": zlib.compress(body), "Deflate": bare.compress(body) + bare.flush()}
    for coding, data in forms.items():
        http = [f"Content-Encoding: {coding}"] if coding else []
        assert text_of(data, *http) == PLAIN
        for _ in range(5):
            assert text_of(chunked(data, r), *http, "Transfer-Encoding: chunked") == PLAIN
    assert text_of(body, "Transfer-Encoding: chunked") == PLAIN and text_of(body, "Content-Encoding: gzip") == PLAIN  # not as the headers say
    assert text_of(gzip.compress(body)[:-30], "Content-Encoding: gzip").startswith("Title\nhe")
    assert text_of(b"", "Content-Encoding: gzip", "Transfer-Encoding: chunked") == ""
    assert warc.unchunked(b"5\r\nhello\r\n7\r\n wor") == b"hello wor"
    assert text_of(gzip.compress(gzip.compress(body)), "Content-Encoding: gzip, gzip") == PLAIN


def test_streamed_files(spark, tmp_path):
    r = random.Random(7)
    inner = b"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    blocks = [bytes(r.randbytes(r.randint(0, 5000))) for _ in range(40)] + [b"", inner, inner * 3, b"\r\n\r\nWARC/1.", b"last"]
    records = [([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>")], b) for i, b in enumerate(blocks)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(warc.serialise(h, b, True) for h, b in records))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(warc.serialise(h, b) for h, b in records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(warc.serialise(h, b) for h, b in records))
    (tmp_path / "empty.warc").write_bytes(b"")
    for name in ("members.warc.gz", "one.warc.gz", "plain.warc"):
        got = {x["record_id"]: bytes(x["block"]) for x in warc.read_records(spark, str(tmp_path / name)).collect()}
        assert got == {f"<urn:{i}>": b for i, b in enumerate(blocks)}
    assert warc.read_records(spark, str(tmp_path)).count() == 3 * len(blocks)
    assert warc.read_records(spark, str(tmp_path / "empty.warc")).count() == 0
    (tmp_path / "cut.warc").write_bytes(warc.serialise(*records[0]) + warc.serialise([("WARC-Type", "response")], b"x" * 100)[:-50])
    cut = warc.read_records(spark, str(tmp_path / "cut.warc")).collect()
    assert len(cut) == 2 and 0 < len(cut[1]["block"]) < 100
    derived = warc.derive(warc.read_records(spark, str(tmp_path / "cut.warc")).withColumn("extra", warc.F.lit(1)))
    assert derived.count() == 4 and warc.serialised(derived).count() == 4


def test_null_records(spark):
    rows = [(None, "response", None, None), ("<urn:a>", "response", [], b""), ("<urn:b>", None, None, b"x"), ("<urn:c>", "response", [(None, None)], b"HTTP/1.1 200 OK\r\n")]
    derived = warc.derive(spark.createDataFrame(rows, warc.RECORD))
    assert derived.count() == 6 and {r["block"] for r in derived.filter("warc_type = 'conversion'").collect()} == {""}
    made = [bytes(r["record"]) for r in warc.serialised(derived).collect()]
    assert all(len(list(warc.parse(m))) == 1 for m in made)


class Slow(HTMLParser):
    """Visible text by the standard library's parser."""

    LINES = set(warc._LINE_TAGS.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))
    HIDDEN = {"head", "script", "style", "noscript", "template"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.out.append("\n" if tag in self.LINES else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        self.out.append("\n" if tag in self.LINES else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(" ".join(["", *data.split(), ""]) if data.strip() else " ")


def test_plain_text_of_pages():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    squeeze = lambda t: [" ".join(x.split()) for x in t.split("\n") if x.strip()]
    for page in pages:
        words = " ".join(squeeze("".join(Slow(page).out))).split()
        assert warc.plain_text(page).split() == words
