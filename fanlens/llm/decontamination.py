"""Benchmark decontamination by pigeonhole edit matching.

A test item of length m has an error budget e = floor(m x rate).  It is split
into e + 1 pieces: a passage within e edits of the item holds at least one piece
unchanged.  One automaton finds all exact piece hits in a text; each hit's
neighbourhood, the item's place widened by e on both sides, is verified with
Myers' bit-parallel distance of the whole item to any substring.

The benchmark is a query set read in blocks of at most ``BLOCK_CHARS``
characters; each block's items go to the tasks as one bounded closure, and every
block meets every whole text.  Texts stay where they are: there is no shuffle.

Defined cases: texts and items are compared by code points after case folding, with
white space runs as one space and none around an item; budgets and distances count
folded characters, spans are places in the text as given.  A null or empty text
matches nothing; a null, empty or blank item is ignored; an item too short for an
error must occur exactly, but for case and white space.  Repeated items are found each under its id.
Repeated rows and null ids are kept.  A text is matched once per item, at the
smallest distance, then the earliest end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.llm.common import bounded_batches, free_name, stored

RATE = 0.05
BLOCK_CHARS = 2_000_000
MATCHES = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("distance", T.IntegerType())])
)


def folded(text: str) -> str:
    """``text`` in one case (``casefold``, which looks at single characters only), white space runs as one space."""
    text = text.casefold()
    words = " ".join(text.split())
    return f"{' ' if text[:1].isspace() else ''}{words}{' ' if words and text[-1].isspace() else ''}"


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each character of ``folded(text)``."""
    return [x.span() for x in re.finditer(r"\s+|\S", text) for _ in ("" if x[0].isspace() else x[0].casefold()) or " "]


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(offset, piece): error budget + 1 pieces of nearly equal length."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int, prefix: bool = False) -> tuple[int, int] | None:
    """(smallest distance of ``pattern`` to a substring of ``text``, its earliest end) within the budget.

    prefix: of the prefixes of ``text`` the shortest within the budget."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | prefix) & full  # unless anchored, the text before a match costs nothing
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
            if prefix:
                return best
    return best


def build(items: list[tuple[int | None, str]], rate: float):
    """Automaton over all pieces; a piece's value lists (item index, offset)."""
    import ahocorasick

    uses: dict[str, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(items):
        for at, piece in pieces(text, rate):
            uses.setdefault(piece, []).append((k, at))
    found = ahocorasick.Automaton()
    for piece, of in uses.items():
        found.add_word(piece, (len(piece), of))
    found.make_automaton()
    return found


def find(text: str, items: list[tuple[int | None, str]], automaton, rate: float) -> list[tuple[int | None, int, int, int]]:
    """(item id, start, end, distance) of each item within its budget of a passage of ``text``."""
    spans: dict[int, list[list[int]]] = {}
    for last, (length, uses) in automaton.iter(text):
        for k, at in uses:
            m = len(items[k][1])
            e = int(m * rate)
            a = last + 1 - length - at - e
            a, b = max(a, 0), min(a + m + 2 * e, len(text))
            of = spans.setdefault(k, [])
            if of and a <= of[-1][1]:  # hits of one passage, and overlapping ones, are verified together
                of[-1][0], of[-1][1] = min(of[-1][0], a), max(of[-1][1], b)
            else:
                of.append([a, b])
    out = []
    for k, of in spans.items():
        item_id, item = items[k]
        best = None
        for a, b in of:
            got = myers(item, text[a:b], int(len(item) * rate))
            if got and (best is None or got[0] < best[0]):
                best = (got[0], a + got[1])
        if best:
            distance, end = best
            back = text[max(0, end - len(item) - distance) : end][::-1]
            _, length = myers(item[::-1], back, distance, prefix=True)
            out.append((item_id, end - length, end, distance))
    return out


def find_folded(text: str, items: list[tuple[int | None, str]], automaton, rate: float) -> list[tuple[int | None, int, int, int]]:
    """``find`` of folded items in the folded text, with the places in ``text``."""
    got = find(folded(text), items, automaton, rate)
    if not got:
        return got
    at = [*places(text), (len(text), len(text))]
    return [(k, at[a][0], at[b - 1][1] if b > a else at[a][0], d) for k, a, b, d in got]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The folded items in blocks of a bounded number of characters; the driver holds one at a time."""
    block, chars = [], 0
    items = benchmark.select(F.col(item_id).cast("bigint"), F.col(text)).where(F.length(text) > 0)
    for row in items.orderBy(item_id, text).toLocalIterator():
        item = folded(row[1]).strip()
        if not item:
            continue
        if block and chars + len(item) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], item))
        chars += len(item)
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, into: str = "matches") -> DataFrame:
    """``docs`` with ``into``: array of (item_id, start, end, distance), empty where a text is clean."""
    kept = [c for c in docs.columns if c != into]
    out = bounded_batches(docs).select(*kept, F.array().cast(MATCHES).alias(into))
    schema = out.schema

    def scan(items):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = build(items, rate)
            for pdf in frames:
                old = [list(x) for x in pdf[into]]
                new = [[] if not isinstance(x, str) else find_folded(x, items, automaton, rate) for x in pdf[text]]
                found = [a + [dict(zip(("item_id", "start", "end", "distance"), m)) for m in b] for a, b in zip(old, new)]
                yield pdf.assign(**{into: pd.Series(found, index=pdf.index, dtype=object)})

        return run

    for k, items in enumerate(_blocks(benchmark, item_id, item_text)):
        if k:  # written before the next block is read: driver and tasks hold one at a time
            out = stored(out, "matches")
        out = out.mapInPandas(scan(items), schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row for each text and item it holds: id, item_id, start, end, distance."""
    hits = find_items(docs.select(id_col, text), benchmark, text, rate=rate)
    return hits.select(id_col, F.explode("matches").alias("m")).select(id_col, "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    into = free_name(docs, "matches")
    return find_items(docs, benchmark, text, rate=rate, into=into).where(F.size(into) == 0).drop(into)
