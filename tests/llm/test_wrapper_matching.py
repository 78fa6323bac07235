"""Wrappers against brute force: every page of a sample is in the wrapper's language, and pages give what was planted in them."""

import random

from threadloom.llm import wrappers


def ends(items, children, at):
    """Where a backtracking matcher of the wrapper's items may stand after some children from ``at`` on; the slow, plain way."""
    if not items:
        return {at}
    first, rest = items[0], items[1:]
    once = {n for n in one(first, children, at)}
    reached = set(once)
    while first.get("r") and (more := {m for n in once for m in one(first, children, n)} - reached):
        reached |= more
        once = more
    if first.get("o"):
        reached.add(at)
    return {m for n in reached for m in ends(rest, children, n)}


def one(item, children, at):
    if "g" in item:
        return ends(item["g"], children, at) - {at}
    if at >= len(children):
        return set()
    child = children[at]
    if "t" in item:
        return {at + 1} if isinstance(child, str) and item["t"] in (None, child) else set()
    whole = not isinstance(child, str) and child[0] == item["k"] and len(kids := wrappers._runs(child)) in ends(item["c"], kids, 0)
    return {at + 1} if whole else set()


def accepts(wrapper, page):
    kids = wrappers._runs(wrappers.tidy(page))
    return len(kids) in ends(wrapper, kids, 0)


def body(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def made(r, host, n):
    """(page, main text) pairs of one host: a layout with constant template text, menus of varying length, comments and adverts."""
    words = [body(random.Random(k), "abcdefgh", 3).replace(" ", "") for k in range(200)]
    named, pages = r.random() < 0.5, []
    for _ in range(n):
        blocks = [body(r, words, r.randint(12, 40)) for _ in range(r.randint(2, 6))]
        menu = "".join(f"<li>{r.choice(words)}</li>" for _ in range(r.randint(1, 5)))
        table = f"<table><tr><td>{body(r, words, 3)}</td></tr></table>" if r.random() < 0.3 else ""
        comments = f"<div class='post-comments'><p>{body(r, words, 9)}</p></div>" if r.random() < 0.4 else ""
        line = f"<p>All of {host} is free to read.</p>"
        inner = f"<h2>{blocks[0]}</h2>{line}" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + table
        tag = "<article>%s</article>" if named else "<div class='col has-sidebar'>%s</div>"
        page = f"<html><body><nav><ul>{menu}</ul></nav><div id=top>Welcome to {host}</div><div class='wrap'>{tag % inner}{comments}</div><footer>{body(r, words, 4)}</footer></body></html>"
        cell = " " + " ".join(table[15:-18].split()) if table else ""
        pages.append((page, " ".join(blocks) + cell))
    return pages


def test_planted_texts():
    r = random.Random(3)
    for k in range(12):
        pages = made(r, f"host{k}", 30)
        wrapper = wrappers.infer([p for p, _ in pages[:24]])
        again = wrappers.unpacked(wrappers.packed(wrapper))
        root = wrappers.main_paths(again)
        assert wrappers.expression(again) == wrappers.expression(wrapper)
        for page, want in pages:
            assert wrappers.extract(page, root, again) == want
            # a page alone can't tell its template from its text: the wrapper is what makes the difference
            assert "is free to read" in wrappers.extract(page, None, [])


def test_samples_are_accepted():
    r = random.Random(5)
    ok = total = 0
    for k in range(12):
        pages = [p for p, _ in made(r, f"host{k}", 10)]
        wrapper = wrappers.infer(pages)
        ok += sum(accepts(wrapper, p) for p in pages)
        total += len(pages)
        assert not accepts(wrapper, "<html><body><video>x</video></body></html>")
    assert ok == total


def learned(pages):
    wrapper = wrappers.infer(pages)
    return wrappers.main_paths(wrapper), wrapper


def test_names_are_compared_whole():
    for name in ("has-sidebar", "content with-sidebar", "no-comments"):
        pages = [f"<body><div class='{name}'><h1>T{i}</h1><p>body text {i} " + "words " * 20 + f"</p></div><div>contact</div></body>" for i in range(9)]
        assert wrappers.extract(pages[0], *learned(pages)).startswith("T0 body text 0 words")
    inside = [f"<article><p>one {i}</p><p class='notice-period'>notice of {i} days</p><p>a{i} <span class='ad'>buy {i}</span>b{i}</p><p class='cookie-notice'>c{i}</p></article>" for i in range(9)]
    assert wrappers.extract(inside[4], *learned(inside)) == "one 4 notice of 4 days a4 b4"
    widget = [f"<body><div class='widget'><div><p>all of the page {i} stands here</p></div><div class='ad'>buy {i}</div></div></body>" for i in range(9)]
    assert wrappers.extract(widget[2], *learned(widget)) == "all of the page 2 stands here"


def test_articles_elsewhere_and_copies():
    pages = [f"<body><div><article><p>first {i} is here</p></article></div></body>" for i in range(9)]
    other = "<body><div><article><p>first x</p></article></div><section><article><p>second</p></article></section></body>"
    assert wrappers.extract(other, *learned(pages)) == "first x second"
    near = [f"<article><p>number {i}</p>" + "".join(f"<p>the same long paragraph {k} of all</p>" for k in range(5)) + "</article>" for i in range(12)]
    assert wrappers.extract(near[3], *learned(near)).count("the same long paragraph") == 5  # copies of one page have no template
    same = ["<article><p>only this</p></article>"] * 12
    assert wrappers.extract(same[0], *learned(same)) == "only this"


def test_deep_nests():
    for depth in (150, 250, 3000):
        deep = "<body>" + "<div>" * depth + "<nav>menu</nav><p>text</p>" + "</div>" * depth + "<p>after</p></body>"
        pages = [deep.replace("text", f"text {i}") for i in range(3)]
        root, wrapper = learned(pages)
        assert "menu" not in wrappers.extract(pages[1], root, wrapper) and "text 1" in wrappers.extract(pages[1], root, wrapper)
        again = wrappers.unpacked(wrappers.packed(wrapper))
        assert wrappers.extract(pages[2], wrappers.main_paths(again), again) == wrappers.extract(pages[2], root, wrapper)


def test_many_different_elements():
    page = "<body>" + "".join(f"<div class='c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>t{k}</div>" for k in range(4000)) + "</body>"
    assert wrappers.extract(page, *learned([page, page.replace(">t", ">u")])).startswith("t0 t1 ")


def test_names_of_asides():
    """Regions are told by the first or the last word of their names; running text isn't dropped for what it is about."""
    story = "".join(f"<p>A long paragraph of the story, part {k}.</p>" for k in range(4))
    want = " ".join(f"A long paragraph of the story, part {k}." for k in range(4))
    asides = "ad-inline advert-top nav-primary menu-main sidebar-left footer-widgets disqus_thread discussion cookie-law related-posts newsletter-signup-form".split()
    for name in asides:
        pages = [f"<body><div id='page'>{story.replace('story', f'story {i}')}<div class='{name}'><span>Say {i} now</span></div></div></body>" for i in range(10)]
        known = learned(pages)
        assert [wrappers.extract(p, *known) for p in pages] == [want.replace("story", f"story {i}") for i in range(10)], name
    for name in "social search share overlay menu".split():
        page = f"<body><article>{story}<p class='{name}'>On this topic too.</p></article></body>"
        assert wrappers.extract(page, *learned([page])) == f"{want} On this topic too."
    for name in "has-sidebar menu-open sidebar-hidden".split():
        page = f"<body><div class='{name}'><article>{story}</article></div></body>"
        assert wrappers.extract(page, *learned([page])) == want
