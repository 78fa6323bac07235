"""Main-text extraction by wrappers: union-free regular expressions inferred for each host.

A page is tidied into a balanced stream of start tags, texts and end tags. Streams of one host are aligned one
after another with the wrapper so far. Where they differ, texts become slots, an element that follows its like becomes a
repeated group, and an element that only one side has becomes optional. Slots hold what a page says, constants and the
texts that a slot repeats on most pages are the host's template. The region of the wrapper with most of the slot text is the main
text; every page is matched against the wrapper and gives what stands in that region's slots. Names of elements tell
regions of slots apart, and what in them is menu, advert and the like. A page with parts that the wrapper lacks refines it.
"""

from __future__ import annotations

import html
import json
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import BROADCAST_BYTES, written

#: Inference takes at most so many pages of a host, drawn by a hash of their ids, each of at most so many characters.
SAMPLE_PAGES, SAMPLE_CHARS = 24, 500_000
SQUARE = 4
#: A text of a slot is template if so many pages of the sample have it there, and this share of those that have the slot; but not
#: where template would be more than that share of the main text: such pages are copies of one another.
TEMPLATE_PAGES, TEMPLATE_SHARE, COPIES_SHARE = 8, 0.8, 0.5
#: The main text is the deepest region with this share of the slot text; elements called main text are taken with half of it.
MAIN_SHARE, NAMED_SHARE = 0.6, 0.5

# Kinds of HTML elements.
_RAW = "script|style|xmp|iframe|noembed|noframes|noscript|template|svg|math|object"
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
_BREAK = frozenset(["br", "hr", "wbr"])
#: An end tag of an inline element doesn't reach out of these.
_BLOCKS_INLINE = frozenset("article aside blockquote body div dl fieldset figure footer form header html li main nav ol p section table td th tr ul".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
# Elements, roles and words of class or id that mark what isn't main text.
_ASIDE_TAGS = frozenset("head title nav header footer aside form button select textarea menu dialog fieldset input audio video canvas".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments commentlist discussion disqus respond replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar skip".split()
)
_MAIN_WORDS = frozenset("article main content post story entry".split())
# Parts of a class or id that say nothing about its kind: ahead of the words they qualify, and behind them.
_QUALIFIERS = frozenset("has have with without no not is hide show".split())
_STATES = frozenset("open opened closed hidden visible active inactive enabled disabled sticky fixed offset free less none off on".split())
# Elements of running text, and words that such an element may be called by without being aside: what it is about.
_PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 td dd".split())
_TOPICS = frozenset("social search share sharing overlay menu related recommended login signup banner comment sponsor header footer modal toolbar skip".split())
_CONTAINERS = frozenset("area bar block box container holder inner item items link links list outer panel section slot unit wrap wrapper zone".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^>]*/>|<(?P<raw>" + _RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?:/?[a-zA-Z]|[!?])[^>]*>?|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


# -- names ----------------------------------------------------------------------------------------------------------


@lru_cache(100_000)
def _kind(token: str, first: bool = True) -> str:
    """What a class or id calls its element: the last word of a compound, containers aside, or the ``first`` if that one is aside and the
    last isn't (sidebar-left, menu-main); nothing for qualifiers and states like has-sidebar and menu-open."""
    parts = [x for x in re.split(r"[^a-z]+", token) if x]
    if not parts or parts[0] in _QUALIFIERS or len(parts) > 1 and parts[-1] in _STATES:
        return ""
    while len(parts) > 1 and parts[-1] in _CONTAINERS:
        parts.pop()
    return parts[0] if first and parts[0] in _ASIDE_WORDS and parts[-1] not in _ASIDE_WORDS else parts[-1]


@lru_cache(100_000)
def _named_aside(key: str) -> bool:
    tag, _, named = key.partition(".")
    if not named or tag in ("html", "body", "article", "main"):
        return False
    if tag in _PROSE:
        return any(_kind(x, False) in _ASIDE_WORDS - _TOPICS for x in named.split())
    return any(_kind(x) in _ASIDE_WORDS for x in named.split())


def _tag_aside(key: str) -> bool:
    return key.partition(".")[0] in _ASIDE_TAGS


#: What an element that holds main text is called, the surest first.
_MAIN = (
    lambda k: k.partition(".")[0] == "article",
    lambda k: k.partition(".")[0] == "main" or "main" in k.partition(".")[2].split(),
    lambda k: any(_kind(x) in _MAIN_WORDS for x in k.partition(".")[2].split()),
)


@lru_cache(100_000)
def _called_main(key: str) -> int:
    return next((n for n, wanted in enumerate(_MAIN) if wanted(key)), len(_MAIN))


# -- pages -> balanced elements -----------------------------------------------------------------------------------


def tidy(source: str | None) -> list:
    """The page as [key, children]; children are texts and elements. Inline tags leave their text to the element around,
    but for those that are named as adverts and the like."""
    root: list = ["", []]
    stack, tags = [root], [""]
    where: dict[str, list[int]] = {}  # the open places of each tag

    def close(n: int) -> None:
        for tag in reversed(tags[n:]):
            where[tag].pop()
        del stack[n:], tags[n:]

    def last(some: set | frozenset) -> int:
        return max((where[t][-1] for t in some if where.get(t)), default=0)

    def above(wanted: set | frozenset, stop: set | frozenset) -> int:
        n = last(wanted)
        return n if n and n > last(stop) else 0

    for m in _TOKEN.finditer(source or ""):
        text = m["text"]
        if text is not None:
            if tags[-1] == "head" and text.strip():
                close(len(tags) - 1)
            stack[-1][1].append(html.unescape(text))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if not m["end"] and where.get("head") and (tag == "body" or tags[-1] == "head" and tag not in _IN_HEAD):
            close(where["head"][0])  # its end tag may be left out
        if m["end"]:
            n = last({tag})
            if n and not (tag in _INLINE and n <= last(_BLOCKS_INLINE)):
                close(n)
            continue
        named = "" if not m["attrs"] else " ".join(a or b or c for a, b, c in _NAMED.findall(m["attrs"]))
        key = tag + ("." + re.sub(r"\d+", "", named.lower()) if named else "")
        if tag in _INLINE:
            if where.get(tag):  # inside one that is kept: end tags must find their own
                element = ["", stack[-1][1]]
            elif _named_aside(key):
                element = [key, []]
                stack[-1][1].append(element)
            else:
                continue
            where.setdefault(tag, []).append(len(tags))
            stack.append(element)
            tags.append(tag)
            continue
        if tag in _CLOSES_P and (n := above({"p"}, {"div", "td", "li", "article", "section", "button"})):
            close(n)
        if tag in _CLOSED_BY:
            wanted, stop = _CLOSED_BY[tag]
            while n := above(wanted, stop):
                close(n)
        if tag in _BREAK:
            stack[-1][1].append("\n")
        if tag in _VOID or tag in ("html", "body") and where.get(tag):
            continue
        element = [key, []]
        stack[-1][1].append(element)
        where.setdefault(tag, []).append(len(tags))
        stack.append(element)
        tags.append(tag)
    return root


# -- elements -> wrapper --------------------------------------------------------------------------------------------
# A wrapper item: {"k": key, "c": items} for an element, {"g": items} for a group, {"t": text or None} for a text that all
# pages share or a slot, with "n" the characters it has held, "s" {text: pages} what it has held and "m" the pages that have it (sets
# of pages as bits); each with "o" if it may be missing and "r" if it may be repeated.


def _key(item: dict) -> str:
    if "k" in item:
        return item["k"]
    return "#" if "t" in item else item["key"]


def _group(items: list[dict]) -> dict:
    return {"g": items, "key": "(" + " ".join(_key(x) for x in items) + ")"}


def _flags(a: dict, b: dict, made: dict) -> dict:
    for f in ("o", "r"):
        if a.get(f) or b.get(f):
            made[f] = 1
    return made


def merge(a: dict, b: dict) -> dict:
    """Two items of the same key as one."""
    if "t" in a:
        seen = dict(a["s"])
        for text, pages in b["s"].items():
            seen[text] = seen.get(text, 0) | pages
        return _flags(a, b, {"t": a["t"] if a["t"] == b["t"] else None, "n": a["n"] + b["n"], "s": seen, "m": a["m"] | b["m"]})
    if "g" in a:
        return _flags(a, b, _group(align(a["g"], b["g"])))
    return _flags(a, b, {"k": a["k"], "c": align(a["c"], b["c"])})


def fold(items: list[dict]) -> list[dict]:
    """Runs of like items become one repeated item; longer squares become repeated groups."""
    for size in range(1, SQUARE + 1):
        if len(items) < 2 * size and not (size > 1 and len(items) > size):
            break
        out: list[dict] = []
        keys: list[str] = []
        for item in items:
            out.append(item)
            keys.append(_key(item))
            while len(out) >= 2 * size and keys[-size:] == keys[-2 * size : -size] and "#" not in (keys[-size:] if size == 1 else ()):
                first, second = out[-2 * size : -size], out[-size:]
                both = [merge(x, y) for x, y in zip(first, second, strict=True)]
                del out[-2 * size :], keys[-2 * size :]
                made = both[0] if size == 1 else _group(both)
                out.append({**made, "r": 1})
                keys.append(_key(out[-1]))
            if size > 1 and len(out) > size and keys[-size - 1] == "(" + " ".join(keys[-size:]) + ")":  # one more of a group
                group = out[-size - 1]
                out[-size - 1 :] = [{**group, "g": [merge(x, y) for x, y in zip(group["g"], out[-size:], strict=True)]}]
                del keys[-size:]
        items = out
    return items


def _runs(element: list) -> list:
    """Children with adjacent texts joined and their white space made one; texts of white space alone go."""
    out: list = []
    held: list[str] = []
    for child in (*element[1], None):
        if isinstance(child, str):
            held.append(child)
            continue
        if held and (text := " ".join("".join(held).split())):
            out.append(text)
        held.clear()
        if child is not None:
            out.append(child)
    return out


def items_of(element: list, page: int = 0) -> list[dict]:
    """The items of a page, whose number is the bit of the sets in them."""
    found: list[dict] = []
    for child in _runs(element):
        if isinstance(child, str):
            if found and "t" in found[-1]:  # around what was left out
                child = found.pop()["t"] + " " + child
            found.append({"t": child, "n": len(child), "s": {child: 1 << page}, "m": 1 << page})
        else:
            found.append({"k": child[0], "c": items_of(child, page)})
    return fold(found)


def align(wrapper: list[dict], page: list[dict]) -> list[dict]:
    """The wrapper's items made general enough for the page's items too."""
    out: list[dict] = []
    i = j = 0
    keys_w, keys_p = [_key(x) for x in wrapper], [_key(x) for x in page]
    at_w, at_p = _places(keys_w), _places(keys_p)
    while i < len(wrapper) or j < len(page):
        a, b = (keys_w[i] if i < len(wrapper) else None), (keys_p[j] if j < len(page) else None)
        if a is not None and a == b:
            out.append(merge(wrapper[i], page[j]))
            i, j = i + 1, j + 1
            continue
        if out and "t" not in out[-1]:  # another one of what stands before
            last = _key(out[-1])
            if b == last:
                out[-1] = {**merge(out[-1], page[j]), "r": 1}
                j += 1
                continue
            if a == last:
                out[-1] = {**merge(out[-1], wrapper[i]), "r": 1}
                i += 1
                continue
        ahead_w = None if b is None else _next(at_w.get(b), i + 1)
        ahead_p = None if a is None else _next(at_p.get(a), j + 1)
        if a is not None and (b is None or ahead_p is None or (ahead_w is not None and ahead_w - i <= ahead_p - j)):
            out.append({**wrapper[i], "o": 1})
            i += 1
        else:
            out.append({**page[j], "o": 1})
            j += 1
    return fold(out)


def _places(keys: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for n, key in enumerate(keys):
        out.setdefault(key, []).append(n)
    return out


def _next(places: list[int] | None, at: int) -> int | None:
    """The first of some places that is ``at`` or later."""
    if not places:
        return None
    n = bisect_left(places, at)
    return places[n] if n < len(places) else None


def _room(depth: int) -> None:
    """Room for the recursion that pages of this depth need; Python's own frames don't use the C stack."""
    if 8 * depth + 1000 > sys.getrecursionlimit():
        sys.setrecursionlimit(8 * depth + 1000)


def _allow(tree: list) -> None:
    deepest, todo = 0, [(tree, 1)]
    while todo:
        element, n = todo.pop()
        deepest = max(deepest, n)
        todo += [(x, n + 1) for x in element[1] if not isinstance(x, str)]
    _room(deepest)


def infer(pages: list[str]) -> list[dict]:
    """The wrapper of some pages of a host: each is aligned with what the pages before it have given. Repeated pages count once."""
    wrapper: list[dict] = []
    for n, source in enumerate(dict.fromkeys(pages)):
        tree = tidy(source)
        _allow(tree)
        own = items_of(tree, n)
        wrapper = own if n == 0 else align(wrapper, own)
    return wrapper


def expression(items: list[dict]) -> str:
    """The wrapper as a regular expression: #TEXT for slots, + and ? for repeated and optional parts."""
    out = []
    for x in items:
        if "t" in x:
            part = "#TEXT" if x["t"] is None else json.dumps(x["t"], ensure_ascii=False)
        elif "g" in x:
            part = expression(x["g"])
        else:
            part = f"<{x['k']}>{expression(x['c'])}</{x['k'].partition('.')[0]}>"
        marks = "+" * ("r" in x) + "?" * ("o" in x)
        out.append(f"({part}){marks}" if marks else part)
    return "".join(out)


def packed(wrapper: list[dict]) -> str:
    """The wrapper as a flat list of tokens in JSON. Of the texts of slots only those that are template stay."""
    out: list = []

    def add(items: list[dict]) -> None:
        for x in items:
            flags = "o" * ("o" in x) + "r" * ("r" in x)
            if "t" in x:
                out.append([x["t"], flags, x["n"], x["m"].bit_count(), template_texts(x)])
            else:
                out.append([("<" + x["k"]) if "k" in x else "(", flags])
                add(x["c"] if "k" in x else x["g"])
                out.append(0)

    add(wrapper)
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def unpacked(tokens: str) -> list[dict]:
    """The wrapper of ``packed``; its pages are numbered from 1, so that page 0 can refine it."""
    stack: list[list[dict]] = [[]]
    heads: list[list] = []
    deepest = 1

    def pages(n: int) -> int:
        return ((1 << n) - 1) << 1

    for token in json.loads(tokens):
        if token == 0:
            kind, flags = heads.pop()
            items = stack.pop()
            made = _group(items) if kind == "(" else {"k": kind[1:], "c": items}
        elif len(token) > 2:
            text, flags, n, m, shared = token
            made = {"t": text, "n": n, "s": {x: pages(k) for x, k in shared.items()}, "m": pages(m)}
        else:
            heads.append(token)
            stack.append([])
            deepest = max(deepest, len(stack))
            continue
        for f in flags:
            made[f] = 1
        stack[-1].append(made)
    _room(deepest)
    return stack[0]


def template_texts(slot: dict) -> dict[str, int]:
    """The texts that most pages of the sample have in this slot, and how many do."""
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * slot["m"].bit_count())
    return {x: n for x, pages in slot["s"].items() if (n := pages.bit_count()) >= least}


# -- wrapper -> where the main text lies ------------------------------------------------------------------------------


class Region:
    """An element of the wrapper, made ready for matching: what it holds by key, and whether it is main text."""

    __slots__ = ("aside", "every", "inside", "key", "main", "plain", "r", "slots", "template", "up")

    def __init__(self, key: str, up: Region | None, repeated: bool):
        self.key, self.up, self.r = key, up, repeated
        self.inside: dict[str, Region] = {}
        self.template: dict[str, int] = {}  # texts, and the pages of the sample that have them
        self.plain = False  # texts stand here
        self.main = False
        self.aside = _tag_aside(key)
        self.slots = self.every = 0  # characters below, without those of asides

    def regions(self) -> list[Region]:
        """All regions from here on that are not aside, outer ones first."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += [y for y in reversed(x.inside.values()) if not y.aside]
        return out


def _region(items: list[dict], into: Region) -> None:
    for x in items:
        if "t" in x:
            into.plain = True
            into.every += x["n"]
            into.slots += x["n"] if x["t"] is None else 0
            for text, pages in template_texts(x).items():
                into.template[text] = max(pages, into.template.get(text, 0))
        elif "g" in x:
            _region(x["g"], into)
        else:
            own = into.inside.get(x["k"])
            if own is None:
                own = into.inside[x["k"]] = Region(x["k"], into, "r" in x)
            else:
                own.r = True
            _region(x["c"], own)


def _weigh(root: Region, named: bool) -> None:
    """Adds what regions hold to the ones around them. ``named``: leave out what is named as aside too."""
    for x in reversed(root.regions()):
        if x.up is not None and not (named and _named_aside(x.key)):
            x.up.slots += x.slots
            x.up.every += x.every


def main_paths(wrapper: list[dict]) -> Region:
    """The wrapper's elements as regions below one root, with those of the main text marked.

    An element named as aside is none if it holds most of the slot text and no element outside of it is called main text. The
    main text is the deepest region with most of the slot text that is left (of all text, where a single page leaves no slots); but
    elements that are called main text are taken instead of it, the surest kind that holds half of the slot text (or any text, without slots).
    """
    root = Region("", None, False)
    _region(wrapper, root)
    every = root.regions()
    if any(_named_aside(x.key) for x in every):
        own = [(x.slots, x.every) for x in every]
        _weigh(root, False)
        size = "slots" if root.slots else "every"
        total = getattr(root, size)
        main = [x for x in every if _called_main(x.key) < len(_MAIN) and getattr(x, size)]
        for x in every:
            if _named_aside(x.key) and not (total and getattr(x, size) >= MAIN_SHARE * total and all(_within(m, x) or _within(x, m) for m in main)):
                x.aside = True
        for x, (slots, all_) in zip(every, own, strict=True):
            x.slots, x.every = slots, all_
    _weigh(root, False)
    size = "slots" if root.slots else "every"
    total = getattr(root, size)
    live = root.regions()
    for kind in range(len(_MAIN)):
        called = [x for x in live if _called_main(x.key) == kind and x.every]
        outer = [x for x in called if not any(_called_main(up.key) == kind for up in _around(x))]
        if outer and (not root.slots or sum(x.slots for x in outer) >= NAMED_SHARE * total):
            for x in outer:
                x.main = True
            break
    else:
        best = root
        while True:
            inner = [x for x in best.inside.values() if not x.aside and not x.r and any(not y.aside for y in x.inside.values())]
            down = next((x for x in inner if total and getattr(x, size) >= MAIN_SHARE * total), None)
            if down is None:
                break
            best = down
        best.main = True
    for x in live:
        if x.main:
            inside = x.regions()
            if sum(len(t) * n for y in inside for t, n in y.template.items()) > COPIES_SHARE * x.every:
                for y in inside:
                    y.template.clear()
    return root


def _around(x: Region) -> list[Region]:
    out = []
    while x.up is not None:
        x = x.up
        out.append(x)
    return out


def _within(x: Region, y: Region) -> bool:
    return x is y or y in _around(x)


# -- pages against the wrapper ------------------------------------------------------------------------------------


def _text(element: list, out: list[str]) -> None:
    """All text of an element without what is aside in it."""
    todo: list = [element]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append("\n")
        todo.append("\n")
        todo += [c for c in reversed(x[1]) if isinstance(c, str) or not (_tag_aside(c[0]) or _named_aside(c[0]))]


def _chars(element: list) -> int:
    out: list[str] = []
    _text(element, out)
    return len(" ".join("".join(out).split()))


def _match(tree: list, root: Region, template: bool, extra: frozenset = frozenset()) -> tuple[str, list[list]]:
    """(text in the slots of the main regions, the outermost elements with text that the wrapper lacks outside of them).

    ``extra``: identities of further elements that are taken as main text.
    """
    out: list[str] = []
    lacking: list[list] = []
    todo: list = [(tree, root, root.main)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        element, region, inside = x
        inside = inside or id(element) in extra
        if not inside and not extra and not region.plain and element is not tree and any(isinstance(c, str) and c.strip() for c in element[1]):
            lacking.append(element)
            continue
        known = region.template if template and region is not None else ()
        for c in reversed(_runs(element) if inside else element[1]):
            if isinstance(c, str):
                if inside and c not in known:
                    todo.append(c)
                continue
            below = region.inside.get(c[0]) if region is not None else None
            if below.aside if below is not None else _tag_aside(c[0]) or _named_aside(c[0]):
                continue
            if inside or below is not None or extra:
                todo.append((c, below, inside or below is not None and below.main))
            elif _chars(c):
                lacking.append(c)
    return " ".join(out), lacking


def extract(source: str | None, root: Region | None, wrapper: list[dict]) -> str:
    """The main text of a page: what stands in the slots of the wrapper's main regions, in page order, white space as one space.

    A page of which nothing stands there, or that has text outside of them in elements that the wrapper lacks, refines the wrapper by
    alignment. Of the lacking elements those that are called main text as surely as the known regions are added, and all of
    them where they hold more than the rest. A page of which everything is template gives that.

    ``root`` is ``main_paths(wrapper)``.
    """
    tree = tidy(source)
    text, lacking = "", []
    if wrapper:
        text, lacking = _match(tree, root, True)
        text = text or _match(tree, root, False)[0]
    if text and not lacking:
        return text
    _allow(tree)
    own = items_of(tree)
    refined = main_paths(align(wrapper, own) if wrapper else own)
    if not text:
        return _match(tree, refined, False)[0] or _match(tree, main_paths(own), False)[0]
    most = min((_called_main(x.key) for x in root.regions() if x.main), default=len(_MAIN))
    named, rest = [], 0
    for element in lacking:
        found = _outermost(element, most)
        named += found
        rest += 0 if found else _chars(element)
    marks = frozenset(id(x) for x in (named if rest <= len(text) else [*named, *lacking]))
    return _match(tree, refined, True, marks)[0] or text


def _outermost(element: list, most: int) -> list[list]:
    """The outermost elements that are called main text at least as surely as ``most`` says."""
    out, todo = [], [element]
    while todo:
        x = todo.pop()
        if _called_main(x[0]) < len(_MAIN) and _called_main(x[0]) <= most:
            out.append(x)
        else:
            todo += [c for c in reversed(x[1]) if not isinstance(c, str) and not (_tag_aside(c[0]) or _named_aside(c[0]))]
    return out


# -- tables -------------------------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def host_wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, paths, pages, expression): the wrapper of each host from a bounded sample of its pages.

    The sample is the SAMPLE_PAGES pages with the smallest hashes; Spark cuts each task's rows to as many
    before the shuffle, so a host with a third of all pages costs no more than the others.
    """
    own = pages.select(host(F.col(url_col)).alias("host"), F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).cast("string").alias("html"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("h", F.length("html")))
    sample = own.filter(F.length("html").between(1, SAMPLE_CHARS)).withColumn("n", rank).filter(F.col("n") <= SAMPLE_PAGES)

    def work(part: pd.DataFrame) -> pd.DataFrame:
        wrapper = infer(part.sort_values("n")["html"].tolist())
        return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [packed(wrapper)], "pages": [len(part)], "expression": [expression(wrapper)]})

    return sample.select("host", "n", "html").groupBy("host").applyInPandas(work, "host string, wrapper string, pages int, expression string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Null pages count as empty and give an empty text; pages without a host form one host. Repeated rows give
    repeated rows; an empty table gives an empty result; further columns are not read.

    Wrappers of BROADCAST_BYTES in all go to the tasks as a whole, once; more are joined to the pages of their hosts.
    """
    spark = pages.sparkSession
    known = written(host_wrappers(pages, id_col, url_col, html_col).select(F.col("host").alias("of"), "wrapper"), "wrappers")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
        host(F.col(url_col)).alias("host"),
    )
    total = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("of") + 64).alias("n")).first()["n"] or 0
    whole = None
    if total <= BROADCAST_BYTES:
        whole = spark.sparkContext.broadcast({r["of"]: r["wrapper"] for r in known.toLocalIterator()})
        both = rows
    else:
        both = rows.join(known, rows.host == F.col("of"), "left").select("page_id", "url", "html", "wrapper")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, tuple] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = []
                for source, key in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                    if key not in read:
                        if len(read) > 256:
                            read.clear()
                        items = unpacked((whole.value.get(key) if whole is not None else key) or "[]")
                        read[key] = main_paths(items), items
                    texts.append(extract(source.as_py(), *read[key]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return both.mapInArrow(work, "page_id long, url string, text string, n_chars long")
