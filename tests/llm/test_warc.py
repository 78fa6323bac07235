import gzip
import hashlib

from pyspark.sql import functions as F

from threadloom.llm import warc

PAGE = "<html><head><title>t</title></head><body><p>A &amp; <b>B</b>c<br>d</p><script>no</script><!-- x --><div>E</div></body></html>"


def responses(spark, rows):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, headers string, block string")
    return warc.page_responses(pages)


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & Bc\nd\nE"
    assert warc.plain_text("") == "" and warc.plain_text("a  b\n c <") == "a b c <"


def test_derivatives(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (3, "http://b/", ""), (None, "http://c/", "x" * 100_000)]
    source = responses(spark, rows)
    got = warc.derive(source).collect()
    assert len(got) == 2 * len(rows)
    of = {(r["target_uri"], r["warc_type"]): r for r in got}
    conv, meta = of["http://a/", "conversion"], of["http://a/", "metadata"]
    ids = {r["record_id"] for r in source.collect()}
    assert conv["refers_to"] == meta["refers_to"] and conv["refers_to"] in ids
    assert conv["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] == conv["record_id"]
    assert conv["block"] == "A & Bc\nd\nE" and conv["content_length"] == len(conv["block"].encode())
    assert conv["payload_digest"] == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
    assert "http-content-type: text/html; charset=utf-8" in meta["block"] and "source-warc-target-uri: http://a/" in meta["block"]
    assert of[None, "conversion"]["block"] == "" and f"WARC-Refers-To: {conv['refers_to']}" in conv["headers"]
    assert warc.derive(source.limit(0)).collect() == [] and warc.derive(source.withColumn("warc_type", F.lit("request"))).count() == 0


def test_files(spark, tmp_path):
    source = responses(spark, [(i, f"http://a/{i}", PAGE + str(i)) for i in range(3)])
    records = [([(h["name"], h["value"]) for h in r["headers"]], bytes(r["block"])) for r in source.collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.serialise(h, b, True) for h, b in records))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.serialise(h, b) for h, b in records))
    read = warc.read_records(spark, str(tmp_path))
    assert read.count() == 6
    texts = lambda df: {(r["record_id"], r["block"]) for r in df.filter("warc_type = 'conversion'").collect()}
    assert texts(warc.derive(read)) == texts(warc.derive(source))
    made = warc.serialised(warc.derive(source)).collect()
    back = [x for r in made for x in warc.parse(bytes(r["record"]))]
    assert len(back) == 6 and {warc.field(h, "WARC-Type") for h, _ in back} == {"metadata", "conversion"}
    assert all(warc.field(h, "WARC-Block-Digest") == warc.digest(b) for h, b in back)
    assert gzip.decompress(bytes(made[0]["record"])).startswith(b"WARC/1.1\r\n")
