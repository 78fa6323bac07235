"""Licence scans with a generalised suffix automaton of licence texts.

All templates go into one automaton over words. A file streams through it word by word, which gives at each
word the longest stretch ending there that some template holds. Base phrases are found where a stretch ends
with them; long stretches are chained, in the order of a template, into the span of it that the file covers. Of templates that cover
the same place the one that is covered best gives its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.licence_texts import LICENCE_TEXTS

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that name a licence.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Stretches of so many words, or of a whole shorter template, are chained; a chain that covers this share of its template gives a label.
LONG, COVER, GAP = 4, 0.75, 12


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


#: The texts of licences and notices as words, single spaces between.
TEMPLATES = {label: [" ".join(w.decode() for w in words(text)) for text in texts] for label, texts in LICENCE_TEXTS.items()}


class Automaton:
    """Generalised suffix automaton; symbols are numbers from 1 on."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol, ends)
                ends[last].append((number, at + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] = ends[self.link[state]] + ends[state]
        #: (sequence, end) of every place where a state's words stand
        self.ends = [sorted(set(e)) for e in ends]

    def _split(self, state: int, symbol: int, target: int, ends: list) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[target])
        ends.append([])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int, ends: list) -> int:
        if symbol in self.next[last]:
            target = self.next[last][symbol]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target, ends)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        ends.append([])
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target, ends)
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str] = BASE_PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        texts = [(label, text, True) for text, label in phrases.items()]
        texts += [(label, text, False) for label, more in templates.items() for text in more]
        self.labels = [label for label, _, _ in texts]
        self.base = [base for _, _, base in texts]
        self.symbol: dict[bytes, int] = {}
        sequences = [[self.symbol.setdefault(w, len(self.symbol) + 1) for w in words(text)] for _, text, _ in texts]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        #: for each state the base phrases among the suffixes of its words: (length, sequence)
        self.phrases = [[] for _ in self.automaton.next]
        for number, sequence in enumerate(sequences):
            if self.base[number]:
                state = 0
                for symbol in sequence:
                    state = self.automaton.next[state][symbol]
                own = state
                for s in range(len(self.phrases)):
                    up = s
                    while up > 0 and up != own:
                        up = self.automaton.link[up]
                    if up == own:
                        self.phrases[s].append((len(sequence), number))
        #: of each phrase the share that it is of the shortest template that has it and its label
        self.phrase_share = {}
        for number, sequence in enumerate(sequences):
            if self.base[number]:
                n = len(sequence)
                holders = [
                    len(other)
                    for k, other in enumerate(sequences)
                    if not self.base[k] and self.labels[k] == self.labels[number] and any(other[i : i + n] == sequence for i in range(len(other) - n + 1))
                ]
                self.phrase_share[number] = n / min(holders) if holders else 1.0
        self.shortest = min((n for n, base in zip(self.sizes, self.base, strict=True) if not base), default=LONG)
        self.least = min((n for n, base in zip(self.sizes, self.base, strict=True) if base), default=1)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """(number of words, base hits as (first word, sequence), covered spans as (label, from, to, share))."""
        return self.read(text)[:3]

    def read(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]], float]:
        """``scan``, and the score: the largest share of any template that the text covers, phrases included."""
        found = words(text)
        symbols = np.fromiter(map(self.symbol.get, found, (0 for _ in found)), np.int64, len(found)) if found else np.zeros(0, np.int64)
        hits: list[tuple[int, int]] = []
        long: list[tuple[int, int, int]] = []
        known = np.flatnonzero(symbols)
        if known.size >= self.least:
            cut = np.flatnonzero(np.diff(known) > 1) + 1
            heads, tails = known[np.r_[0, cut]], known[np.r_[cut - 1, known.size - 1]] + 1
            wide = tails - heads >= self.least
            for a, b in zip(heads[wide].tolist(), tails[wide].tolist(), strict=True):
                self._stream(symbols[a:b].tolist(), a, hits, long)
        spans, score = self._chain(long)
        return len(found), hits, spans, max([score, *{self.phrase_share[k] for _, k in hits}])

    def _stream(self, symbols: list[int], at: int, hits: list, long: list) -> None:
        """Matching statistics of a run of known words; keeps base hits and stretches that can't be made longer."""
        step, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        state = size = 0
        for i, symbol in enumerate(symbols):
            before, was = state, size
            while state and symbol not in step[state]:
                state = link[state]
                size = length[state]
            target = step[state].get(symbol)
            if target is None:
                state = size = 0
            else:
                state, size = target, size + 1
            if size != was + 1 and was > 1:
                long.append((at + i, was, before))
            for n, number in phrases[state]:
                if n <= size:
                    hits.append((at + i + 1 - n, number))
        if size > 1:
            long.append((at + len(symbols), size, state))

    def _chain(self, long: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """The best chains of stretches (end, size, state) that follow one another in the same template, and the largest share of one.

        Every stretch begins a chain or goes on with the best one before it in the text and in the template, and leaves that
        one open for others. Between two stretches there may be GAP words, or a third of the template. Of chains that overlap by more
        than half the one with the largest share stays, then the one that covers most words.
        """
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # sequence -> (from, to, template end, covered words)
        full: list[tuple[float, int, int, int, int]] = []
        best = 0.0
        for end, size, state in long:
            if size < min(LONG, self.shortest):
                continue
            for number, to in self.automaton.ends[state]:
                if self.base[number]:
                    continue
                n = min(size, to)
                if n < min(LONG, self.sizes[number]):
                    continue
                reach = end - n - max(GAP, self.sizes[number] // 3)
                chains = open_[number] = [c for c in open_.get(number, ()) if c[1] >= reach]
                made = (end - n, end, to, n)
                for a, b, before, covered in chains:
                    if before < to and b < end and covered + min(n, to - before, end - b) > made[3]:
                        made = (a, end, to, covered + min(n, to - before, end - b))
                chains.append(made)
                share = made[3] / self.sizes[number]
                best = max(best, share)
                if share >= COVER:
                    full.append((share, made[3], made[0], made[1], number))
        done: list[tuple[str, int, int, float]] = []
        for share, _, a, b, number in sorted(full, key=lambda c: (-min(c[0], 1.0), -c[1], c[3] - c[2], c[2], c[4])):
            if all(2 * (min(b, y) - max(a, x)) <= min(b - a, y - x) for _, x, y, _ in done):
                done.append((self.labels[number], a, b, min(1.0, share)))
        return sorted(done, key=lambda t: t[1:]), min(1.0, best)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per input row.

    spans: (label, from, to, share) of the templates that are covered, as word ranges [from, to). score: the largest share of a
    template that is covered, from a phrase alone (which is part of one) to a whole licence text. Null and empty texts have no words, no labels (empty strings) and score 0. Repeated
    rows give repeated rows; an empty table gives an empty result; further columns are not read.
    """
    scanner = scanner or Scanner()
    span = pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("share", pa.float64())]))
    kinds = {
        "n_words": pa.int64(),
        "n_base": pa.int64(),
        "first_word": pa.int64(),
        "last_word": pa.int64(),
        "base_labels": pa.string(),
        "labels": pa.string(),
        "score": pa.float64(),
        "spans": span,
    }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                out = []
                for text in part.column(1):
                    n, hits, spans, score = scanner.read(text.as_py())
                    base = {scanner.labels[k] for _, k in hits}
                    both = base | {label for label, *_ in spans}
                    starts = [s for s, _ in hits]
                    out.append(
                        (
                            n,
                            len(hits),
                            min(starts, default=None),
                            max(starts, default=None),
                            ",".join(sorted(base)),
                            ",".join(sorted(both)),
                            score,
                            [dict(zip(("label", "from", "to", "share"), s, strict=True)) for s in spans],
                        )
                    )
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *kinds])

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,`from`:long,`to`:long,share:double>>"
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
