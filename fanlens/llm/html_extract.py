"""HTML extraction by union-free regular-expression inference.

Pages of one host come from one template.  A page becomes a tree of element and
text tokens; runs of equal siblings, or of groups of up to three, fold into
repeated groups.  Two trees are aligned child by child: what only one of them
has becomes optional, differing texts become a text slot.  Aligning all pages of
a host in turn gives its wrapper, a union-free expression of fixed tags, ``( )?``,
``( )+`` and slots ``#``.  The wrapper's element that holds the article, by its
tag or else by the mass of its slots outside menus, notices and the like, is the
host's rule; every page is then read at that element.

Each task aligns the pages it reads and emits one wrapper a host; those are
aligned again under a salt and then by host, so a host with a third of all pages
is never gathered.  Rules are one short path a host: measured, then broadcast or
joined by shuffle.  Extraction reads whole pages.

Defined cases: null or empty html gives an empty text; a null url, or one
without host, belongs to the empty host; a page without the rule's element is
read at the element its own tree suggests.  Repeated rows and null ids stay.
Texts that are equal on all pages stay if they stand inside the article.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanlens.llm.common import join_small
from fanlens.llm.url_filter import split_url

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
# fixed values: parts of a page that are no article text
DROP_TAGS = frozenset("nav footer aside form button select menu dialog head script style noscript template iframe svg textarea title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer sidebar aside related notice notices cookie cookies consent popup modal overlay comment comments disqus respond "
    "share sharing social newsletter subscribe signup login search pagination pager widget toolbar".split()
)
MAX_DEPTH = 40  # deeper elements count as part of their ancestor in a wrapper; extraction goes all the way
SALTS = 32
FLUSH_HOSTS = 2000


def parse(page: str) -> Iterator[tuple[str, str, dict]]:
    """('open' | 'close' | 'text', tag or text, attributes): balanced, block elements only."""
    stack: list[str] = []
    opened: Counter[str] = Counter()
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], {}
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if tag in ("br", "wbr"):
            yield "text", " " if tag == "br" else "", {}
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        if m[2] or m[5]:
            if opened[tag]:
                while stack:
                    top = stack.pop()
                    opened[top] -= 1
                    yield "close", top, {}
                    if top == tag:
                        break
            continue
        if opened["p"] and tag != "p":  # a block ends the paragraph before it
            closes = ("p",)
        else:
            closes = CLOSES.get(tag, ("p",) if tag == "p" else ())
        for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if stack[i] in closes:
                for top in reversed(stack[i:]):
                    opened[top] -= 1
                    yield "close", top, {}
                del stack[i:]
                break
        rest = m[4] if m[3] else m[7]
        attrs = {a.lower(): (b or c or d or "").lower() for a, b, c, d in ATTRIBUTE.findall(rest)} if rest else {}
        yield "open", tag, attrs
        if tag == "hr":
            yield "close", tag, {}
        else:
            stack.append(tag)
            opened[tag] += 1
    if at < len(page):
        yield "text", page[at:], {}
    for top in reversed(stack):
        yield "close", top, {}


def dropped(tag: str, attrs: dict, inside: bool = True) -> bool:
    """Whether the element is a menu, notice, advert, comment list and the like."""
    if tag in DROP_TAGS or tag == "header" and not inside:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if attrs.get("role") in DROP_ROLES:
        return True
    words = re.split(r"[^a-z]+", attrs.get("class", "") + " " + attrs.get("id", ""))
    return not DROP_WORDS.isdisjoint(words)


def _key(tag: str, attrs: dict) -> str:
    marks = sorted(set((attrs.get("class", "") + " " + attrs.get("role", "") + " " + attrs.get("itemprop", "")).split()))
    return ".".join([tag, *(re.sub(r"\d+", "0", x) for x in marks)])


# a wrapper node: [key, mark, children, characters of text, text if fixed]; mark: 1 once, ? optional, + repeated, * both
def wrapper_of(page: str) -> list:
    """The page as a wrapper of its own."""
    root = ["", "1", [], 0, None]
    path, hidden, deep = [root], 0, 0
    for kind, what, attrs in parse(page):
        if kind == "open":
            if hidden or deep or len(path) > MAX_DEPTH:
                hidden, deep = hidden + bool(hidden), deep + (not hidden)
            elif dropped(what, attrs, inside=False):
                path[-1][2].append([_key(what, attrs) + "!", "1", [], 0, None])
                hidden = 1
            else:
                node = [_key(what, attrs), "1", [], 0, None]
                path[-1][2].append(node)
                path.append(node)
        elif kind == "close":
            if hidden:
                hidden -= 1
            elif deep:
                deep -= 1
            elif len(path) > 1:
                node = path.pop()
                node[2] = fold(node[2])
        elif not hidden:
            words = entities.unescape(what).split()
            if words:
                text = " ".join(words)
                if path[-1][2] and path[-1][2][-1][0] == "#":
                    last = path[-1][2][-1]
                    last[3], last[4] = last[3] + len(text), None
                else:
                    path[-1][2].append(["#", "1", [], len(text), text[:80]])
    while path:
        node = path.pop()
        node[2] = fold(node[2])
    return root


def _mark(a: str, b: str) -> str:
    optional, repeated = {a, b} & {"?", "*"}, {a, b} & {"+", "*"}
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def fold(nodes: list) -> list:
    """Runs of equal siblings, and of groups of two or three, become repeated groups."""
    for width in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(nodes):
            group = nodes[i : i + width]
            keys = [n[0] for n in group]
            j = i + width
            while j + width <= len(nodes) and [n[0] for n in nodes[j : j + width]] == keys and keys[0] != "#":
                group = [align(a, b) for a, b in zip(group, nodes[j : j + width])]
                j += width
            if j == i + width:
                out.append(nodes[i])
                i += 1
            else:
                out.append([group[0][0], _mark(group[0][1], "+"), *group[0][2:]] if width == 1 else ["(" + " ".join(keys) + ")", "+", group, 0, None])
                i = j
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """One wrapper for both: common children in order, the others optional."""
    if a[0] == "#":
        return ["#", _mark(a[1], b[1]), [], a[3] + b[3], a[4] if a[4] == b[4] else None]
    x, y = a[2], b[2]
    n, m = len(x), len(y)
    if [c[0] for c in x] == [c[0] for c in y]:
        both = [align(c, d) for c, d in zip(x, y)]
        return [a[0], _mark(a[1], b[1]), both, a[3] + b[3], None]
    best = [[0] * (m + 1) for _ in range(n + 1)]  # longest common subsequence of keys
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    both, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            both.append(align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            both.append([x[i][0], _mark(x[i][1], "?"), *x[i][2:]])
            i += 1
        else:
            both.append([y[j][0], _mark(y[j][1], "?"), *y[j][2:]])
            j += 1
    return [a[0], _mark(a[1], b[1]), fold(both), a[3] + b[3], None]


def expression(node: list) -> str:
    """The wrapper as text: tags, slots #, fixed texts, ( )? and ( )+."""
    key, mark, children = node[0], node[1], node[2]
    if key == "#":
        body = "#" if node[4] is None else json.dumps(node[4], ensure_ascii=False)
    else:
        inner = " ".join(expression(c) for c in children)
        body = inner if not key or key[0] == "(" else f"<{key}> {inner} </{key.split('.')[0]}>" if inner else f"<{key}/>"
    return body if mark == "1" else f"({body}){mark}"


def content_path(wrapper: list) -> list[str]:
    """Keys from the root to the element that holds the article."""
    found: list[tuple[int, int, list[str]]] = []

    def mass(node: list, path: list[str], linked: bool) -> int:
        key = node[0]
        if key == "#":
            return node[3]
        group = not key or key[0] == "("
        here = path if group else [*path, key]
        got = sum(mass(c, here, linked) for c in node[2])
        if not group and not key.endswith("!"):
            tag = key.split(".")[0]
            rank = 2 if tag == "article" or "articlebody" in key else 1 if tag == "main" or ".main" in key else 0
            found.append((rank, got, here))
        return got

    total = mass(wrapper, [], False)
    named = [f for f in found if f[0] and f[1]]
    if named:
        rank = max(f[0] for f in named)
        return max((f for f in named if f[0] == rank), key=lambda f: (f[1], -len(f[2])))[2]
    heavy = [f for f in found if f[1] * 10 >= total * 7 and f[1]]
    blocks = [f for f in heavy if f[2][-1].split(".")[0] not in ("p", "h1", "li", "td", "tr", "tbody")]
    return max(blocks or heavy, key=lambda f: len(f[2]))[2] if heavy else []


def article_text(page: str, rule: list[str]) -> str | None:
    """The text of the elements at ``rule``; None if the page has no such element."""
    blocks: list[str] = []
    buffer: list[str] = []
    path: list[str] = []
    inside = hidden = 0
    met = False

    def end() -> None:
        if buffer:
            words = entities.unescape("".join(buffer)).split()
            if words:
                blocks.append(" ".join(words))
            buffer.clear()

    for kind, what, attrs in parse(page):
        if kind == "text":
            if inside and not hidden:
                buffer.append(what)
        elif kind == "open":
            end()
            if hidden:
                hidden += 1
            elif dropped(what, attrs, inside=bool(inside)):
                hidden = 1
            elif inside:
                inside += 1
            else:
                path.append(_key(what, attrs))
                if path == rule:
                    inside, met = 1, True
        else:
            end()
            if hidden:
                hidden -= 1
            elif inside > 1:
                inside -= 1
            else:
                inside = 0
                if path:
                    path.pop()
    end()
    return "\n".join(blocks) if met else None


def extract(page: str | None, rule: list[str] | None) -> str:
    if not page:
        return ""
    text = article_text(page, rule) if rule else None
    if text is None:
        own = content_path(wrapper_of(page))
        text = article_text(page, own) if own else ""
    return text or ""


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for each host that this task has met."""
    made: dict[str, list] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"host": list(made), "wrapper": [json.dumps(w) for w in made.values()]}, dtype=object)
        made.clear()
        return out

    for pdf in frames:
        for host, page in zip(pdf["host"], pdf["page"], strict=True):
            if page:
                w = wrapper_of(page)
                made[host] = align(made[host], w) if host in made else w
                if len(made) >= FLUSH_HOSTS:
                    yield flush()
    yield flush()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    w = None
    for x in sorted(pdf["wrapper"]):
        w = json.loads(x) if w is None else align(w, json.loads(x))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(w)]})


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper (JSON): the alignment of all pages of each host."""
    host, _ = split_url(F.col(url))
    schema = "host string, wrapper string"
    parts = pages.select(host.alias("host"), F.col(html).alias("page")).mapInPandas(_aligned, schema)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    parts = parts.groupBy("host", "salt").applyInPandas(_merged, schema)
    return parts.groupBy("host").applyInPandas(_merged, schema)


def _rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"host": pdf["host"], "rule": [json.dumps(content_path(json.loads(w))) for w in pdf["wrapper"]]})


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rules = {r: json.loads(r) for r in pdf["rule"].dropna().unique()}
        texts = [extract(p, rules.get(r)) for p, r in zip(pdf["html"], pdf["rule"], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts})


def extract_articles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text: the article of every page, blocks joined by one newline."""
    rules = infer_wrappers(pages, url, html).mapInPandas(_rules, "host string, rule string")
    host, _ = split_url(F.col(url))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    rows = join_small(rows, rules, ["host"], "left", F.octet_length("host") + F.octet_length("rule"))
    done = rows.select("id", "url", "html", "rule").mapInPandas(_extracted, "id long, url string, text string")
    return done.select(F.col("id").alias(id_col), "url", "text")
