"""Whole licence texts and their spans; chains against a brute-force alignment."""

import random

import pytest

from threadloom.llm import licences
from threadloom.llm.licence_texts import LICENCE_TEXTS

SCANNER = licences.Scanner()


def labels(text):
    return {x[0] for x in SCANNER.scan(text)[2]}


@pytest.mark.parametrize("label", sorted(LICENCE_TEXTS))
def test_texts_get_their_label_alone(label):
    for text in LICENCE_TEXTS[label]:
        assert labels("Copyright (c) 2020 Some Body\n\n" + text.replace(",", " ,").upper() + "\n\nint main() {}") == {label}


def test_edited_texts():
    mit = LICENCE_TEXTS["mit"][1]
    for text in (mit.replace("without restriction, ", ""), mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "REGENTS"), "# " + mit.replace("\n", "\n# ")):
        assert labels(text) == {"mit"}
    n = len(licences.words(mit))
    two = "a b " + mit + " c d " + LICENCE_TEXTS["isc"][0]
    spans = SCANNER.scan(two)[2]
    assert [x[0] for x in spans] == ["mit", "isc"] and spans[0][1:3] == (2, 2 + n) and spans[1][1] == 4 + n
    assert SCANNER.read(" ".join(mit.split()[:40]))[2] == []


def test_score_is_a_share():
    score = lambda t: SCANNER.read(t)[3]
    assert score("nothing of the kind") == 0 and score(LICENCE_TEXTS["zlib"][0]) == 1
    assert 0 < score("see the MIT License") < score("Released under the MIT license") == 1
    part = licences.TEMPLATES["isc"][0].split()
    assert score(" ".join(part[:30])) == pytest.approx(30 / len(part))


def lcs_share(words, template):
    """The most words of a template that stand in a text in its order, by the quadratic table."""
    row = [0] * (len(template) + 1)
    for w in words:
        above = row[:]
        for j, t in enumerate(template):
            row[j + 1] = above[j] + 1 if w == t else max(above[j + 1], row[j])
    return row[-1] / len(template)


def test_chains_against_alignment():
    """A chain never covers more than the best alignment, and nearly as much where a text is edited in a few places."""
    r = random.Random(3)
    for label in ("mit", "isc", "zlib", "bsd-3-clause"):
        template = licences.TEMPLATES[label][-1].split()
        for _ in range(10):
            text = template[:]
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(text))
                text[at : at + r.randint(0, 2)] = ["changed"] * r.randint(0, 2)
            got = SCANNER.read(" ".join(["before"] * 5 + text))
            best = lcs_share(text, template)
            assert got[3] <= 1 and (label in {x[0] for x in got[2]})
            share = max(x[3] for x in got[2] if x[0] == label)
            assert best - 0.1 <= share <= best + 1e-9
