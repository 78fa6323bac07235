"""Markup that must not take the rest of a page with it."""

import time

import pytest

from threadloom.llm import warc, wrappers


def both(source):
    return wrappers.extract(source, [], []), " ".join(warc.plain_text(source).split())


@pytest.mark.parametrize("head", ["<head>", "<head><title>T</title><meta x>", "<head><script>a<p>b</script><!-- <body> --><style>p</style>", "<head><title>T", "<head lang=en>\n<link y>"])
@pytest.mark.parametrize("body", ["<body>", "<BODY class=x>"])
def test_head_without_end_tag(head, body):
    source = f"<html>{head}{body}<p>Hello</p><p>world</p></html>"
    assert both(source) == ("Hello world", "Hello world")


def test_head_ends_at_content():
    for rest in ("<p>Hello", "Hello", "<b>Hello</b>", "<div>Hello</div></head>"):
        assert both("<head><title>T</title>" + rest) == ("Hello", "Hello")
    assert both("<head><title>T <b>x</b></title><meta></head><body><header>h</header><p>Hello")[0] == "Hello"


@pytest.mark.parametrize("empty", ["<svg class=a />", "<svg/>"])
def test_empty_svg(empty):
    assert both(f"<p>one</p>{empty}<p>two</p>") == ("one two", "one two")
    assert both(f"<p>one</p>{empty}<p>two</p><svg><path/><text>t</text></svg><p>three</p>") == ("one two three", "one two three")
    assert wrappers.extract(f"<p>one</p>{empty.replace('svg', 'math')}<p>two</p>", [], []) == "one two"


def test_deep_nests():
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    source = f"<body><nav>n</nav><div class='article'><p>before</p>{deep}<p>after</p></div><div>outside</div></body>"
    assert wrappers.extract(source, [], []) == "before deep after"
    lists = f"<body><article><ul><li>{'<ul><li>' * 150}x{'</ul>' * 150}<li>last</ul></article><div>outside</div></body>"
    assert wrappers.extract(lists, [], []) == "x last"
    began = time.monotonic()
    wrappers.tidy("<p><button>" + "<dl>" * 100_000 + "</p>" * 1000)
    assert time.monotonic() - began < 20
