import random
import re

from threadloom.llm import licences

from .common import docs, plain

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    words = WORD.findall((text or "").encode().lower())
    hits = []
    for phrase, label in licences.BASE_PHRASES.items():
        p = phrase.encode().split()
        hits += [(a, label) for a in range(len(words) - len(p) + 1) if words[a : a + len(p)] == p]
    return len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_against_brute_force(spark):
    r = random.Random(8)
    pool = "gnu general public license apache mit cc by the software is x éé 2".split()
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(200)]
    texts += ["", None, "CC-BY", "ccby", "MIT\nLicense.", "gnu gnu general general public license", "the " * 50_000 + "mit license"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "mit license")]
    got = licences.scan(docs(spark, plain(rows))).collect()
    assert len(got) == len(rows)
    mine = sorted(str(tuple(x)[:6]) for x in got)
    assert mine == sorted(str((i, *slow(t))) for i, t in rows)
    assert all(set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1 for x in got)


def test_chains():
    s = licences.Scanner()
    text = licences.TEMPLATES["mit"][1].split()
    for cut in (text, text[:20] + ["oops"] + text[20:], text[2:], text[:30] + text[34:]):
        _, _, spans = s.scan("word " * 5 + " ".join(cut) + " end")
        assert "mit" in {x[0] for x in spans}
    assert s.scan(" ".join(text[:12]))[2] == [] and s.scan("the software is here and the license")[2] == []
    _, _, spans = s.scan("Licensed under CC BY-NC 4.0.")
    assert {x[0] for x in spans} == {"cc-by-nc"}


def test_automaton():
    r = random.Random(1)
    seqs = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(6)]
    a = licences.Automaton(seqs)
    for _ in range(300):
        q = [r.randint(1, 3) for _ in range(r.randint(1, 5))]
        want = sorted({(n, i + len(q)) for n, s in enumerate(seqs) for i in range(len(s) - len(q) + 1) if s[i : i + len(q)] == q})
        state = 0
        for x in q:
            state = a.next[state].get(x) if state is not None else None
        assert (a.ends[state] if state is not None else []) == want


def test_empty(spark):
    assert licences.scan(docs(spark, [])).collect() == []
