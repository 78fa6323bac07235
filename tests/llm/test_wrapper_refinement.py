from threadloom.llm import wrappers

COMMON = ["<body><nav>n</nav><div class='content'><p>Text %d</p></div><div>contact us</div></body>" % i for i in range(24)]


def learned(pages):
    wrapper = wrappers.infer(pages)
    return wrappers.main_paths(wrapper), wrapper


def test_rare_layouts_refine():
    known = learned(COMMON)
    long = "a long story told here " * 5
    teaser = f"<body><nav>n</nav><div class='content'><p>Teaser</p></div><div class='longread'><p>{long}</p></div><div>contact us</div></body>"
    assert wrappers.extract(teaser, *known) == f"Teaser {long}".strip()
    parts = "<body><div class='content'><p>One</p></div><div class='wrap'><section class='story'><p>Two</p></section></div><div>contact us</div></body>"
    assert wrappers.extract(parts, *known) == "One Two"
    slot = "<body><div class='content'><p>One</p></div><div class='empty'>" + long + "</div></body>"
    empty = learned([p.replace("<div>contact us", "<div class='empty'></div><div>contact us") for p in COMMON])
    assert wrappers.extract(slot, *empty) == f"One {long}".strip()


def test_known_layouts_stay():
    known = learned(COMMON)
    assert wrappers.extract(COMMON[3], *known) == "Text 3"
    small = COMMON[3].replace("<div>contact", "<div class='box'>hi</div><div class='promo'>" + "buy " * 50 + "</div><div>contact")
    assert wrappers.extract(small, *known) == "Text 3"
    article = learned(["<body><article><p>A %d long enough</p></article></body>" % i for i in range(5)])
    assert wrappers.extract("<body><article><p>A long enough text</p></article><div class='post-meta'>by me</div></body>", *article) == "A long enough text"


def test_on_a_table(spark):
    long = "words of the rare page " * 9
    rare = [(1000 + i, "http://h/", f"<body><nav>n</nav><div class='content'><p>Teaser</p></div><div class='longread{i}'>{long}</div></body>") for i in range(3)]
    pages = [(i, "http://h/", p) for i, p in enumerate(COMMON * 20)] + rare
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(got[i] == f"Teaser {long}".strip() for i, *_ in rare)
    assert all(got[i] == f"Text {i % 24}" for i in range(480))
