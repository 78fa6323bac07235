"""Payloads as servers send them: several gzip members, codings that aren't known, character sets named in the page."""

import gzip
import zlib

import pytest

from threadloom.llm import warc


def derived(body: bytes, *http: str):
    block = "\r\n".join(["HTTP/1.1 200 OK", *http]).encode() + b"\r\n\r\n" + body
    rows = warc.derive_one([("WARC-Record-ID", "<urn:x>"), ("WARC-Type", "response")], block)
    named = [dict(zip(warc._DERIVED_NAMES, r, strict=True)) for r in rows]
    return {r["warc_type"]: r["block"] for r in named}


@pytest.mark.parametrize("tail", [b"", b"\0\0 no member"])
def test_every_member_counts(tail):
    body = gzip.compress(b"<p>first part</p>") + gzip.compress(b"<p>second part</p>") + tail
    assert derived(body, "Content-Type: text/html", "Content-Encoding: gzip")["conversion"] == "first part\nsecond part"


def test_one_member_and_deflate():
    for body, coding in ((gzip.compress(b"<p>a"), "x-gzip"), (zlib.compress(b"<p>a"), "deflate"), (zlib.compress(b"<p>a")[2:-4], "deflate"), (b"<p>a", "gzip"), (b"", "gzip")):
        assert derived(body, "Content-Type: text/html", f"Content-Encoding: {coding}")["conversion"] == ("a" if body else "")


def test_unknown_codings_give_no_text():
    got = derived(b"\x8b\x02\x80<p>x", "Content-Type: text/html", "Content-Encoding: br")
    assert got["conversion"] == "" and "content-coding-not-decoded: br\r\n" in got["metadata"]
    plain = derived(b"<p>x", "Content-Type: text/html", "Content-Encoding: identity")
    assert plain["conversion"] == "x" and "not-decoded" not in plain["metadata"]


@pytest.mark.parametrize("meta", ['<meta charset="windows-1251">', "<META http-equiv='Content-Type' content='text/html; charset=windows-1251'>"])
def test_character_sets_in_the_page(meta):
    page = f"<html><head>{meta}</head><body><p>привет</p></body></html>".encode("windows-1251")
    assert derived(page, "Content-Type: text/html")["conversion"] == "привет"
    # the header goes first; a name that isn't known, and one beyond the first 1024 bytes, don't count
    utf = page.decode("windows-1251").encode()
    assert derived(utf, "Content-Type: text/html; charset=utf-8")["conversion"] == "привет"
    assert derived(utf.replace(b"windows-1251", b"no-such-set"), "Content-Type: text/html")["conversion"] == "привет"
    assert derived(b"<!--" + b"x" * 1100 + b"-->" + utf, "Content-Type: text/html")["conversion"] == "привет"
