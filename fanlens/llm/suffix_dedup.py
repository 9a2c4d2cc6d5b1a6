"""Suffix-array dedup: remove bytes of repeated strings of ``LENGTH`` bytes, all but the first.

A string of LENGTH bytes that occurs twice holds, at the same place in both, the
``GRAM`` bytes whose hash is least in it, the last such.  So every text is anchored
at the grams that are least in some window (about one in 35 bytes), and an anchor's
context is the bytes of the windows in which it is: a run of neighbouring windows.

1. Each task anchors its texts; of equal contexts it keeps the first and marks
   the others as covered.
2. Anchors meet by gram.  Of equal contexts the first is kept again, and the
   first ones of grams with several contexts fetch their bytes from their texts.
3. Contexts of a gram are cut where some of them part, left and right; what two
   share is a common run of symbols.  A suffix array of these runs, built by
   linear grouping, gives the longest run each shares with an earlier one.
4. Covered ranges meet by document and are cut out of the text.

Copies and boilerplate collapse before the shuffle, so a passage with a third of
all rows is a row for each task; a gram with more than ``WIDE`` contexts is dealt
again by ``SPLITS`` longer strings around it, one of which every window holds.

"First" is by document id, then place.  Defined cases: a null or empty text, or
one shorter than LENGTH, loses nothing (0 bytes if null).  Rows that share an id
are parts of one document in order of their texts' MD5, and a repeated row is the
same part; rows without id are one document behind all others.  Matches never
cross rows.  Whole texts are judged on the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanlens.llm.common import join_small, stored
from fanlens.llm.suffix_groups import common_prefixes, longest_earlier, suffix_array

LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM  # windows that hold a gram start at most so far before it
WIDE, SPLITS = 256, 4
CHUNK_BYTES = 1 << 20  # text hashed at once
HELD_ANCHORS = 400_000  # anchors among which a task drops equal contexts
HELD_CONTEXTS = 20_000  # contexts in one suffix array
LAST = (1 << 63) - 1

SHAPE = 128  # bytes before a gram x SHAPE + bytes from it on, both at most LENGTH
ANCHOR = "kind int, h long, c long, o long, sub long, a int, b int"
COVER = "o long, sub long, a int, b int"


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in ``data`` (texts one after the other, uint8): place, first and last window each stands for."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    x = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    for w in (1, 2, 4, 8, 16):
        x = x[:-w] * np.uint32(0x85EBCA6B) + (x[w:] ^ x[w:] >> np.uint32(15)) * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x27D4EB2F)
    x ^= x >> np.uint32(15)
    # the least hash, and of equal ones the last
    key = x.astype(np.uint64) << np.uint64(32) | np.arange(len(x), 0, -1, dtype=np.uint64)
    least = _sliding(key, BEFORE + 1, np.minimum)
    inside = np.ones(len(least), bool)  # windows that do not cross the end of a text
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~inside[1:]
    begin = np.flatnonzero(first)
    return len(x) - (least[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64), begin, np.flatnonzero(last)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i], ..., x[i + width - 1]) for each i."""
    w = 1
    while 2 * w <= width:
        x = best(x[:-w], x[w:])
        w *= 2
    return best(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def merged(o: np.ndarray, sub: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Ranges a to b of each (o, sub), overlapping and touching ones made one."""
    order = np.lexsort((a, sub, o))
    o, sub, a, b = o[order], sub[order], a[order], b[order]
    if not len(o):
        return pd.DataFrame({"o": o, "sub": sub, "a": a, "b": b})
    doc = np.cumsum(np.concatenate(([0], (o[1:] != o[:-1]) | (sub[1:] != sub[:-1])))) << np.int64(32)
    reach = np.maximum.accumulate(doc + b)
    first = np.flatnonzero(np.concatenate(([True], (doc + a)[1:] > reach[:-1])))
    last = np.append(first[1:], len(o)) - 1
    return pd.DataFrame({"o": o[first], "sub": sub[first], "a": a[first], "b": (reach[last] - doc[last]).astype(np.int64)})


def _bounds(pos: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where contexts begin and end, from their gram's place and the bytes before and from it."""
    return pos - shape // SHAPE, pos + shape % SHAPE


def _first_of_class(h, c, o, sub, pos) -> tuple[np.ndarray, np.ndarray]:
    """Order by context, then age, each place once (a repeated row has the same); where a context begins in it."""
    order = np.lexsort((pos, sub, o, c, h))
    if not len(order):
        return order, np.zeros(0, bool)
    differs = lambda x: x[order][1:] != x[order][:-1]
    first = np.concatenate(([True], differs(h) | differs(c)))
    once = first | np.concatenate(([True], differs(o) | differs(sub) | differs(pos)))
    return order[once], first[once]


def _anchored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to anchors (kind 0; a, b: place, shape of the context) and covered ranges (kind 1)."""
    import xxhash

    gram, context = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    held: list[tuple] = []

    def take(texts: list[bytes], o: list[int], sub: list[int]) -> int:
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        at, lo, hi = anchors(np.frombuffer(data, np.uint8), ends)
        doc = np.searchsorted(ends, at, side="right")
        starts = ends - [len(t) for t in texts]
        hi = hi + LENGTH
        h = np.array([gram(data[p : p + GRAM]) for p in at.tolist()], np.uint64).view(np.int64)
        shape = (at - lo) * SHAPE + (hi - at)
        c = np.array([context(data[p:q], s) for p, q, s in zip(lo.tolist(), hi.tolist(), shape.tolist())], np.uint64).view(np.int64)
        held.append((h, c, np.array(o, np.int64)[doc], np.array(sub, np.int64)[doc], at - starts[doc], shape))
        return len(at)

    def flush() -> Iterator[pd.DataFrame]:
        h, c, o, sub, pos, shape = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order, first = _first_of_class(h, c, o, sub, pos)
        keep, gone = order[first], order[~first]
        yield pd.DataFrame({"kind": 0, "h": h[keep], "c": c[keep], "o": o[keep], "sub": sub[keep], "a": pos[keep], "b": shape[keep]})
        if len(gone):
            m = merged(o[gone], sub[gone], *_bounds(pos[gone], shape[gone]))
            yield m.assign(kind=1, h=h[gone[: len(m)]], c=0)[["kind", "h", "c", "o", "sub", "a", "b"]]

    texts, o, sub, size, rows = [], [], [], 0, 0
    for pdf in frames:
        for text, x, y in zip(pdf["text"], pdf["o"].tolist(), pdf["sub"].tolist(), strict=True):
            data = text.encode() if text else b""
            if len(data) >= LENGTH:
                texts.append(data)
                o.append(x)
                sub.append(y)
                size += len(data)
            if size >= CHUNK_BYTES:
                rows += take(texts, o, sub)
                texts, o, sub, size = [], [], [], 0
                if rows >= HELD_ANCHORS:
                    yield from flush()
                    rows = 0
    if texts:
        take(texts, o, sub)
    if held:
        yield from flush()


def whole_groups(frames: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``key`` as frames of whole groups, of about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in frames:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n >= rows and held[0][key].iat[0] != pdf[key].iat[-1]:
            pdf = pd.concat(held, ignore_index=True)
            cut = int((pdf[key] != pdf[key].iat[-1]).to_numpy().sum())
            yield pdf.iloc[:cut]
            held, n = [pdf.iloc[cut:]], len(pdf) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def _collapsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors by gram to covered ranges (kind 1) and contexts to compare (kind 2; a, b: place, shape; c: 1 if wide)."""
    for pdf in whole_groups(frames, "h", 100_000):
        passed = pdf[pdf["kind"] == 1]
        pdf = pdf[pdf["kind"] == 0]
        h, c, o, sub, pos, shape = (pdf[x].to_numpy(np.int64) for x in ("h", "c", "o", "sub", "a", "b"))
        order, first = _first_of_class(h, c, o, sub, pos)
        h, c, o, sub, pos, shape = (x[order] for x in (h, c, o, sub, pos, shape))
        group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        classes = np.bincount(group[first], minlength=int(group[-1]) + 1 if len(group) else 0)
        ask = first & (classes[group] > 1)
        wide = (classes[group[ask]] > WIDE).astype(np.int64)
        yield pd.DataFrame({"kind": 2, "h": h[ask], "c": wide, "o": o[ask], "sub": sub[ask], "a": pos[ask], "b": shape[ask]})
        gone = ~first
        a, b = _bounds(pos[gone], shape[gone])
        m = merged(np.concatenate((o[gone], passed["o"])), np.concatenate((sub[gone], passed["sub"])), np.concatenate((a, passed["a"])), np.concatenate((b, passed["b"])))
        yield m.assign(kind=1, h=0, c=0)[["kind", "h", "c", "o", "sub", "a", "b"]]


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with the places asked for to the bytes before and from each place, by gram."""
    import xxhash

    out: list[tuple] = []
    names = ["h", "o", "sub", "pos", "before", "after"]
    for pdf in frames:
        for text, o, sub, found in zip(pdf["text"], pdf["o"].tolist(), pdf["sub"].tolist(), pdf["found"], strict=True):
            data = text.encode()
            for x in found:
                pos = x["a"]
                before, after = data[pos - x["b"] // SHAPE : pos], data[pos : pos + x["b"] % SHAPE]
                if not x["c"]:
                    out.append((x["h"], o, sub, pos, before, after))
                    continue
                # windows by how many bytes they have before the gram: all of a range share the bytes that the range has
                for k in range(SPLITS):
                    least, most = (BEFORE + 1) * k // SPLITS, (BEFORE + 1) * (k + 1) // SPLITS - 1
                    if len(before) >= least and len(after) >= LENGTH - most:
                        key = before[len(before) - least :] + after[: LENGTH - most]
                        out.append((xxhash.xxh64_intdigest(key, k) - (1 << 63), o, sub, pos, before, after))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
    if out:
        yield pd.DataFrame(out, columns=names)


def _parting(group: np.ndarray, cells: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings (rows of bytes) within their groups, and bytes each shares with the one before."""
    n, width = cells.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = cells
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *words.T[::-1], group))
    cells, length, g = cells[order], size[order], group[order]
    same = cells[1:] == cells[:-1]
    shared = np.where(same.all(axis=1), width, same.argmin(axis=1))
    shared = np.minimum(shared, np.minimum(length[1:], length[:-1]))
    shared[g[1:] != g[:-1]] = 0
    return order, np.concatenate(([0], shared))


def _most(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with any other of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def _cells(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)
    return data, np.array([len(s) for s in strings], np.int64)


def _levels(group: np.ndarray, order: np.ndarray, shared: np.ndarray, least: np.ndarray, name: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each string (level, name) of the sets of strings it shares ``level`` bytes with, from the widest set.

    Only levels of at least the group's ``least``; a set is one name."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(order))]
    g = group[order]
    cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist() + [len(order)]
    least = least[g].tolist()
    order, shared = order.tolist(), shared.tolist()
    todo = [(p, q) for p, q in zip(cuts, cuts[1:]) if q - p > 1]
    while todo:
        p, q = todo.pop()
        level = min(shared[p + 1 : q])
        if level >= least[p]:
            name += 1
            for k in range(p, q):
                out[order[k]].append((level, name))
        at = p
        for k in range(p + 1, q):
            if shared[k] == level:
                if k - at > 1:
                    todo.append((at, k))
                at = k
        if q - at > 1:
            todo.append((at, q))
    return out, name


def match_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ranges of contexts (h, o, sub, pos, before, after) that an earlier context of their gram repeats."""
    pdf = pdf.drop_duplicates(["h", "o", "sub", "pos"]).sort_values(["o", "sub", "pos"], kind="stable")  # of repeated rows
    group = np.unique(pdf["h"].to_numpy(), return_inverse=True)[1]
    left, left_size = _cells([x[::-1] for x in pdf["before"]], BEFORE)
    right, right_size = _cells(list(pdf["after"]), LENGTH)
    o, sub, pos = (pdf[c].to_numpy() for c in ("o", "sub", "pos"))
    del pdf
    while True:  # contexts that share too little on both sides together part from all others
        l_order, l_shared = _parting(group, left, left_size)
        r_order, r_shared = _parting(group, right, right_size)
        l_most, r_most = _most(l_order, l_shared), _most(r_order, r_shared)
        keep = l_most + r_most >= LENGTH
        if keep.all():
            break
        group, left, left_size, right, right_size, o, sub, pos = (x[keep] for x in (group, left, left_size, right, right_size, o, sub, pos))
    if not len(group):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("o", "sub", "a", "b")})
    l_top, r_top = np.zeros(group.max() + 1, np.int64), np.zeros(group.max() + 1, np.int64)
    np.maximum.at(l_top, group, l_most)
    np.maximum.at(r_top, group, r_most)
    lefts, name = _levels(group, l_order, l_shared, np.maximum(LENGTH - r_top, 1), 0)
    rights, name = _levels(group, r_order, r_shared, np.maximum(LENGTH - l_top, 1), name)
    text: list[int] = []
    edge: list[tuple[int, int]] = []  # of each symbol: context, level (below zero on the right)
    for k, (x, y) in enumerate(zip(lefts, rights, strict=True)):
        if y:
            for level, s in reversed(x):
                text.append(s)
                edge.append((k, level))
            for level, s in y:
                text.append(s)
                edge.append((k, -level))
            name += 1
            text.append(name)  # no run goes on into the next context
            edge.append((-1, 0))
    text.append(-1)
    edge.append((-1, 0))
    order = suffix_array(text)
    runs = longest_earlier(order, common_prefixes(text, order), range(len(text)))
    found = []
    before = -1
    for i, run in enumerate(runs):
        k, level = edge[i]
        if run and (level > 0 or before != k):  # a run from a place left of the gram, or from the gram
            end, start = -edge[i + run - 1][1], max(level, 0)
            if end > 0 and start + end >= LENGTH:
                found.append((o[k], sub[k], pos[k] - start, pos[k] + end))
        before = k if level < 0 else -1
    return pd.DataFrame(found, columns=["o", "sub", "a", "b"])


def _matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in whole_groups(frames, "h", HELD_CONTEXTS):
        m = match_contexts(pdf)
        yield merged(*(m[c].to_numpy(np.int64) for c in ("o", "sub", "a", "b")))


def _spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges sorted by document to one row a document, its ranges merged."""
    for pdf in whole_groups(frames, "o", 100_000):
        m = merged(*(pdf[c].to_numpy(np.int64) for c in ("o", "sub", "a", "b")))
        if len(m):
            m = m.groupby(["o", "sub"], sort=False).agg(starts=("a", list), stops=("b", list)).reset_index()
            yield m


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        kept, gone, spans, size = [], [], [], []
        for text, starts, stops in zip(pdf["text"], pdf["starts"], pdf["stops"], strict=True):
            data = text.encode() if text else b""
            parts, at, n = [], 0, 0
            if starts is not None:
                for a, b in zip(starts, stops, strict=True):
                    parts.append(data[at:a])
                    at, n = b, n + b - a
            kept.append(b"".join([*parts, data[at:]]))
            gone.append(n)
            spans.append(0 if starts is None else len(starts))
            size.append(len(data))
        yield pd.DataFrame({"id": pdf["id"], "n_bytes": size, "n_removed": gone, "n_spans": spans, "kept": kept})


def covered(texts: DataFrame) -> DataFrame:
    """texts: o, sub, text.  Returns a row for each text with covered bytes: o, sub, starts, stops."""
    met = texts.select("o", "sub", "text").mapInPandas(_anchored, ANCHOR).repartition("h").sortWithinPartitions("h")
    told = stored(met.mapInPandas(_collapsed, ANCHOR), "repeats")
    asked = told.where("kind = 2").groupBy("o", "sub").agg(F.collect_list(F.struct("h", "c", "a", "b")).alias("found"))
    shown = texts.join(asked, ["o", "sub"]).select("o", "sub", "text", "found")
    context = "h long, o long, sub long, pos int, before binary, after binary"
    shown = shown.mapInPandas(_contexts, context).repartition("h").sortWithinPartitions("h")
    ranges = told.where("kind = 1").select("o", "sub", "a", "b").unionByName(shown.mapInPandas(_matched, COVER))
    ranges = ranges.repartition("o", "sub").sortWithinPartitions("o", "sub", "a")
    return ranges.mapInPandas(_spans, "o long, sub long, starts array<int>, stops array<int>")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans (long), kept (binary)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("o"), F.col(text).alias("text"))
    shared = rows.groupBy("o").agg(F.count("*").alias("n")).where("n > 1").select("o", F.lit(True).alias("shared"))
    part = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("bigint")
    rows = join_small(rows, shared, ["o"], "left", F.lit(9))
    rows = rows.select("id", "o", F.when(F.col("shared"), part).otherwise(F.lit(0)).cast("bigint").alias("sub"), "text")
    spans = covered(rows)
    rows = rows.join(spans, ["o", "sub"], "left")
    out = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.select("id", "text", "starts", "stops").mapInPandas(_cut, out).withColumnRenamed("id", id_col)
