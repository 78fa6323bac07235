import html
import json

import pytest

from threadloom.llm import wrappers

MENU = "<nav><ul><li><a href=/>Home</a></li><li>Shop</li></ul></nav>"


def page(kind, title, *paras, extra=""):
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paras)
    return {
        "article": f"<html><body>{MENU}<div class='ad'>buy</div><article><h1>{title}</h1>{body}{extra}</article><footer>f</footer></body></html>",
        "main": f"<body>{MENU}<main><h1>{title}</h1>{body}{extra}</main><aside>x</aside>",
        "div": f"<body><div class='menu'>m</div><div><h1>{title}</h1>{body}{extra}</div><form>q<input></form><div class='cookie-notice'>ok</div></body>",
    }[kind]


@pytest.mark.parametrize("kind", ["article", "main", "div"])
def test_main_text(spark, kind):
    extras = ["", "<div class='comments'><p>first!</p></div>", "<ul><li>one<li>two</ul>", "<p><b>Bo<i>ld</i></b> a\n  b<br>c<p>d"]
    gains = ["", "", " one two", " Bold a b c d"]
    pages = [(i, f"http://h.{kind}/{i}", page(kind, f"T{i}", "some longer text & more " * 3, f"para {i}", extra=extras[i % 4])) for i in range(12)]
    pages += [(50, f"http://h.{kind}/x", None), (51, None, "<p>lone</p>"), (52, f"http://h.{kind}/y", ""), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, text string, wrapper string")
    got = wrappers.main_text(df).collect()
    assert len(got) == len(pages)
    for r in got:
        i = r["page_id"]
        want = {50: "", 51: "lone", 52: ""}.get(i) if i >= 50 else f"T{i} {' '.join(('some longer text & more ' * 3).split())} para {i}{gains[i % 4]}"
        assert r["text"] == want and r["n_chars"] == len(want)


def test_inference():
    pages = [page("article", "a", "x"), page("article", "b", "y", "z", extra="<table><tr><td>1</table>")]
    text = wrappers.expression(wrappers.infer(pages))
    assert "(<p>#TEXT</p>)+" in text and "(<table>" in text and ")?" in text and '"f"' in text
    assert "(<li>#TEXT</li>)+" in text
    group = wrappers.fold([{"k": k, "c": []} for k in ("dt", "dd") * 3])
    assert len(group) == 1 and group[0]["r"] and len(group[0]["g"]) == 2


def test_odd_markup():
    for source in ("<", "<p", "</p></div>", "<!-- open", "<script>x", "<a href='x>y' b=\">\">t</a>", "<div>" * 5000 + "deep", "a<b>c</b>d<p>e", "&amp;amp; &nbsp;x"):
        assert isinstance(wrappers.extract(source, [], []), str)
    assert wrappers.extract("<a href='x>y'>t</a>", [], []) == "t"
    assert wrappers.extract("a<b>c</b>d<p>e", [], []) == "acd e"
    assert wrappers.extract("&amp;amp; &nbsp;x", [], []) == "&amp; x"
    json.dumps(wrappers.infer(["<div>" * 300 + "x", "<p>y"]))


def test_empty(spark):
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
