"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case and with white space folded to single
spaces. An item of n characters may differ from a passage by a budget of floor(RATE * n) edits.
Cut into budget + 1 pieces, at least one piece of any such passage is untouched, so an automaton
over all pieces finds every place worth a look. Two exact filters follow: enough disjoint grams
of the item must occur near the place (each edit spoils one at most), and Myers' bit-parallel
distance must stay within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fields, filter_texts, map_texts

#: Edits per character of an item; characters of the grams that a place is filtered by.
RATE, GRAM = 0.1, 5
#: Characters of items that travel to the tasks at once; more items take more passes.
BLOCK_CHARS = 8 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, limit: int, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best place in text that pattern ends at, the first such; (limit + 1, 0) if none.

    anchored: the place has to start at the start of text.
    """
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = (limit + 1, 0) if m > limit else (m, 0)
    get, carry = peq.get, int(anchored)
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | carry) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Matcher:
    """Finds the items in a text; built once on each worker."""

    items: list[tuple[int, str]]
    rate: float = RATE
    _built: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"items": self.items, "rate": self.rate, "_built": None}

    def build(self) -> tuple:
        if self._built is None:
            import ahocorasick

            texts, budgets, grams = [], [], []
            pieces: dict[str, list[tuple[int, int]]] = {}
            for item, raw in self.items:
                t = normal(raw)
                if not t:
                    continue
                k, e = len(texts), min(int(self.rate * len(t)), len(t) - 1)
                texts.append((item, t))
                budgets.append(e)
                grams.append([t[i : i + GRAM] for i in range(0, len(t) - GRAM + 1, GRAM)])
                for j in range(e + 1):
                    a, b = j * len(t) // (e + 1), (j + 1) * len(t) // (e + 1)
                    pieces.setdefault(t[a:b], []).append((k, b))
            automaton = ahocorasick.Automaton()
            for piece, uses in pieces.items():
                automaton.add_word(piece, uses)
            if pieces:
                automaton.make_automaton()
            self._built = (texts, budgets, grams, automaton if pieces else None)
        return self._built

    def _near(self, text: str, k: int, start: int, texts, budgets, grams) -> bool:
        """Whether the item can be at about start: at most budget of its disjoint grams are missing there."""
        e = budgets[k]
        window = text[max(0, start - e) : start + len(texts[k][1]) + e]
        missing = 0
        for g in grams[k]:
            if g not in window:
                missing += 1
                if missing > e:
                    return False
        return True

    def find(self, text: str) -> list[dict]:
        """The best place of each item that the text holds; start and end count in the normal text."""
        texts, budgets, grams, automaton = self.build()
        text, found = normal(text), []
        if automaton is None:
            return found
        starts: dict[int, set[int]] = {}
        for end, uses in automaton.iter(text):
            for k, b in uses:
                starts.setdefault(k, set()).add(end + 1 - b)
        for k, at in starts.items():
            item, pattern = texts[k]
            e, n, best, zones = budgets[k], len(pattern), None, []
            for s in sorted(at):
                if not self._near(text, k, s, texts, budgets, grams):
                    continue
                a, b = max(0, s - e), min(len(text), s + n + e)
                if zones and a <= zones[-1][1]:
                    zones[-1][1] = b
                else:
                    zones.append([a, b])
            for a, b in zones:
                exact = text.find(pattern, a, b)
                d, end = (0, exact - a + n) if exact >= 0 else myers(pattern, text[a:b], e)
                if d <= e and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                d, end = best
                back = text[max(0, end - n - e) : end][::-1]
                size = n if d == 0 else myers(pattern[::-1], back, e, anchored=True)[1]
                found.append({"item_id": item, "distance": d, "start": end - size, "end": end})
        return found


def _blocks(benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items by id, in lists of about BLOCK_CHARS characters; the driver holds one block."""
    block, held = [], 0
    for r in benchmark.select(item_col, text).where(F.col(text).isNotNull()).orderBy(item_col, text).toLocalIterator():
        if block and held + len(r[1]) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    if block:
        yield block


_FOUND = "found array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def _matched(docs: DataFrame, items: list[tuple[int, str]], keep: list[str], rate: float, text: str) -> DataFrame:
    matcher = Matcher(items, rate)
    return map_texts(docs, keep, fields(_FOUND), lambda texts: {"found": [matcher.find(t) for t in texts]}, text)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(id, item_id, distance, start, end) for every row of docs and item that it holds.

    distance is the least number of edits between the item and a passage of the text, at most
    floor(rate * n); start and end are the passage's, in the folded text. An item of any length
    counts wherever its characters stand, inside words too, so a benchmark should hold no single
    words. Null and empty texts and items match nothing; whole texts are searched, however long,
    each in one task; repeated rows each report; null ids stay; items of one id each report;
    empty tables give no rows; other columns, clashing names among them, are not read.
    """
    blocks = _blocks(benchmark, item_col, text)
    out, block = None, next(blocks, [])
    while True:
        after = next(blocks, None)
        rows = _matched(docs, block, [id_col], rate, text).where(F.size("found") > 0).select(id_col, F.inline("found"))
        # of several passes each is run before the next block is read
        out = rows if out is None and after is None else checkpointed(rows) if out is None else out.union(checkpointed(rows))
        if after is None:
            return out
        block = after


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, item_col: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all columns of docs; one pass over docs a block.

    Between passes what is left is written to the shared folder, so that a task holds one block's
    automaton. Null and empty texts stay, as do all rows if there are no items; of repeated rows
    all stay or all go; whole texts are searched, however long; an empty table gives no rows.
    """
    blocks = _blocks(benchmark, item_col, text)
    block = next(blocks, None)
    while block:
        after, matcher = next(blocks, None), Matcher(block, rate)
        docs = filter_texts(docs, lambda texts, m=matcher: [not m.find(t) for t in texts], text)
        docs, block = docs if after is None else checkpointed(docs), after
    return docs
