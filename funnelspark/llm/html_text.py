"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements with the runs of text between them as leaves.  Every node has
a hidden state, main text or not.  A node's own potential comes from its features: of an element its tag, the words
of its class and id, how much text and how many links it holds, its like siblings and what its first words say
of it; of a run of text its length, links, punctuation and telling words.  A potential joins each parent
with each child, by the child's kind.  Both are counted on labelled pages.  Sum-product messages
passed up and then down the tree give every run's exact marginal, and the runs at 0.5 or more are
the main text.

Defined cases: null or empty html and pages without main text give an empty text; unclosed, stray and
badly nested tags never fail; an unseen element without end tag hides nothing (script, style,
textarea, title and iframe: the rest of the page), formulas are text; rows are judged each by itself, so repeated rows give equal results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_refs
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.labelled_pages import ASIDE_NAMES, COMMENT_NAMES, MAIN_NAMES, labelled_pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|data-y|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
UNSEEN = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "title", "textarea", "audio", "video"))
#: Those of them whose content is letters up to the end tag, or to the end of the page without one.
RAW = frozenset(("script", "style", "textarea", "title", "iframe"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
                    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
                    "math", "semantics", "annotation", "annotation-xml", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn",
                    "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup",
                    "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none"))
#: A start tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Element kinds that share a parent-child potential.
KINDS = {"p": "para", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "ul": "list", "ol": "list", "li": "item",
         "#text": "text", "div": "box", "section": "box", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table", "th": "table",
         "caption": "table", "blockquote": "para", "pre": "para", "dl": "list", "dt": "item", "dd": "item", "figure": "box", "figcaption": "para"}
MAIN, OTHER = 1, 0


class Tree:
    """Nodes in page order (a parent stands before its children)."""

    __slots__ = ("parent", "tag", "names", "mark", "text", "linked")

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.mark, self.text, self.linked = [-1], ["#page"], [()], [None], [""], [0]

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), mark: int | None = None, text: str = "", linked: int = 0) -> int:
        for column, value in zip((self.parent, self.tag, self.names, self.mark, self.text, self.linked), (parent, tag, names, mark, text, linked), strict=True):
            column.append(value)
        return len(self.parent) - 1


def _ends(page: str) -> dict[int, int]:
    """Where the element of each closed start tag of UNSEEN (but RAW) ends, by where the tag begins."""
    ends: dict[int, int] = {}
    starts: dict[str, list[int]] = {}
    for found in _TOKEN.finditer(page):
        tag = (found[2] or found[5] or "").lower()
        if tag not in UNSEEN or tag in RAW:
            continue
        if not (found[1] or found[4]):
            if not _closed(tag, found):
                starts.setdefault(tag, []).append(found.start())
        elif starts.get(tag):
            ends[starts[tag].pop()] = found.end()
    return ends


def _closed(tag: str, found: re.Match) -> bool:
    """Whether a start tag ends its element itself."""
    return tag == "svg" and (found[3] or found[6] or "").rstrip().endswith("/")


def parse(page: str) -> Tree:
    tree = Tree()
    ends: dict[int, int] | None = None
    stack, opened = [(0, "#page")], Counter()
    run: list[str] = []
    link_depth = linked = 0

    def end_run() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(html_refs.unescape("".join(run)).split())
            if text:
                tree.add(stack[-1][0], "#text", text=text, linked=linked)
        run, linked = [], 0

    def close_to(depth: int) -> None:
        end_run()
        while len(stack) > depth:
            opened[stack.pop()[1]] -= 1

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        piece = page[at:found.start() if found else size]
        if piece:
            run.append(piece)
            if link_depth:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = found[1] or found[4]
        if tag in UNSEEN:
            if closing:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else size
            elif not _closed(tag, found):  # one that is never closed hides nothing
                ends = _ends(page) if ends is None else ends
                at = ends.get(found.start(), at)
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                run.append(" " if tag == "br" else "")
            elif tag == "hr":
                end_run()
            continue
        if tag in INLINE:
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if closing else 1))
            continue
        if closing:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][1] != tag:
                    depth -= 1
                close_to(depth)
                link_depth = 0
            elif tag == "p":
                end_run()
            continue
        if opened["p"] and tag not in ("label", "button", "option", "select"):  # a block ends an open paragraph
            depth = len(stack) - 1
            while depth and stack[depth][1] != "p":
                depth -= 1
            close_to(depth)
        for other in ENDS.get(tag, ()):
            if stack[-1][1] == other:
                close_to(len(stack) - 1)
        end_run()
        names: tuple[str, ...] = ()
        mark = None
        attributes = found[3] or found[6]
        if attributes and attributes.strip(" /"):
            words: list[str] = []
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                if name.lower() == "data-y":
                    mark = int(value) if value in ("0", "1") else None
                elif name.lower() == "hidden":
                    words.append("hidden")
                else:
                    words += _NAME.findall(value)
            names = tuple(dict.fromkeys(words))
        stack.append((tree.add(stack[-1][0], tag, names, mark), tag))
        opened[tag] += 1
        link_depth = 0
    end_run()
    return tree


#: Words by which parts that are not main text tell what they are; a node has those of its own first words.
TELLING = frozenset(("ad", "advert", "advertisement", "anzeige", "promoted", "promotion", "sponsored", "comment", "comments", "reply", "replies", "responses", "readers", "reader",
                     "discussion", "related", "recommended", "trending", "popular", "newsletter", "subscribe", "sign", "share", "follow", "cookies", "cookie",
                     "log", "login", "tags", "categories", "archive", "sources", "references", "notes", "see", "bibliography", "reading", "next"))


#: Names that say alike what a part is, so that rare ones are judged by the others.
NAMED = {"aside": frozenset((*ASIDE_NAMES, *COMMENT_NAMES)), "main": frozenset(MAIN_NAMES)}
LANDMARKS = frozenset(("article", "main", "aside", "nav", "header", "footer", "blockquote", "form", "figure", "table"))


def _told(text: str, most: int) -> set[str]:
    return TELLING.intersection(_NAME.findall(text.lower())) if len(text) <= most else set()


def features(tree: Tree) -> list[list[str]]:
    """The features of every node: its own, and for an element those of all that it holds (words, links, first words)."""
    n = len(tree.parent)
    held, linked, first, kin = [0] * n, [0] * n, [0] * n, Counter(zip(tree.parent, tree.tag, strict=True))
    within = ["page"] * n  # the nearest landmark above
    for i in range(1, n):
        p = tree.parent[i]
        within[i] = tree.tag[p] if tree.tag[p] in LANDMARKS else within[p]
    for i in range(n - 1, 0, -1):
        if tree.tag[i] == "#text":
            held[i], linked[i], first[i] = len(tree.text[i]), tree.linked[i], i
        p = tree.parent[i]
        held[p], linked[p], first[p] = held[p] + held[i], linked[p] + linked[i], first[i] or first[p]
    before, last_of = [0] * n, [0] * n  # the node before, under the same parent
    for i in range(1, n):
        before[i], last_of[tree.parent[i]] = last_of[tree.parent[i]], i
    few = ["few"] if tree.tag.count("#text") <= 2 else []  # a page of one or two runs is hardly all menu
    out: list[list[str]] = [[]]
    for i in range(1, n):
        tag = tree.tag[i]
        if tag == "#text":
            text = tree.text[i]
            share = tree.linked[i] / len(text)
            last = text[-1]
            out.append([f"len:{min(9, len(text).bit_length())}", *few, f"link:{0 if share == 0 else 1 if share < 0.5 else 2}",
                        f"in:{within[i]}>{tree.tag[tree.parent[i]]}>text", f"end:{'stop' if last in '.!?…。' else 'other'}", f"comma:{',' in text}", f"copy:{text[:9].lower().startswith(('©', '(c)', 'copyright'))}",
                        *("s:" + w for w in _told(text, 100))])
        else:
            share = linked[i] / held[i] if held[i] else 0
            links = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
            out.append(["t:" + tag, f"in:{within[i]}>{tag}", *("n:" + w for w in tree.names[i]), *(f"named:{k}" for k, words in NAMED.items() if words & set(tree.names[i])), f"links:{links}",
                        f"holds:{min(12, held[i].bit_length()) // 2}", f"kin:{min(3, kin[tree.parent[i], tag])}",
                        *("b:" + w for w in _told(tree.text[first[i]], 40)),
                        *("a:" + w for w in _told(tree.text[first[before[i]]], 40) if before[i])])
    return out


class Model:
    """Log potentials: of a feature under each state, of (child's kind, parent's state, child's state).

    They start from counts on the labelled pages and are then fitted by gradient steps on the pages'
    conditional likelihood, whose gradient is what the marginals expect less what is marked.
    """

    def __init__(self, pages: list[str], prior: float = 0.5, epochs: int = 20, rate: float = 0.15):
        self.unary: dict[str, list[float]] = {}
        self.pair: dict[tuple[str, int], list[float]] = {}
        examples = []
        for page in pages:
            tree = parse(page)
            state, given = self.states(tree), features(tree)
            examples.append((tree, state, given))
            for i in range(1, len(state)):
                if state[i] is None:
                    continue
                for f in given[i]:
                    self.unary.setdefault(f, [0.0, 0.0])[state[i]] += 1
                above = state[tree.parent[i]]
                if above is not None:
                    self.pair.setdefault((KINDS.get(tree.tag[i], "other"), above), [0.0, 0.0])[state[i]] += 1
        for table, strength in ((self.unary, 0.5), (self.pair, 1.0)):  # features of a node overlap: they start at half strength
            for key, c in table.items():
                table[key] = [strength * math.log((c[s] + prior) / (sum(c) + 2 * prior)) for s in (0, 1)]
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for tree, state, given in examples:
                self._fit(tree, state, given, step)

    def _fit(self, tree: Tree, state: list[int | None], given: list[list[str]], step: float) -> None:
        chance, edges = self.infer(tree, given=given)
        for i in range(1, len(state)):
            if state[i] is None:
                continue
            miss = state[i] - chance[i]
            for f in given[i]:
                w = self.unary.setdefault(f, [0.0, 0.0])
                w[1] += step * miss
                w[0] -= step * miss
            above = state[tree.parent[i]]
            if above is not None:
                kind = KINDS.get(tree.tag[i], "other")
                for s in (0, 1):
                    w = self.pair.setdefault((kind, s), [math.log(0.5)] * 2)
                    for t in (0, 1):
                        w[t] += step * (float(s == above and t == state[i]) - edges[i][2 * s + t])

    @staticmethod
    def states(tree: Tree) -> list[int | None]:
        """Marks handed down; unmarked elements above get the state of most of the text inside them."""
        n = len(tree.parent)
        state: list[int | None] = [None] * n
        for i in range(1, n):
            state[i] = tree.mark[i] if tree.mark[i] is not None else state[tree.parent[i]]
        chars = [[0, 0] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            if state[i] is not None and tree.text[i]:
                chars[i][state[i]] += len(tree.text[i])
            for s in (0, 1):
                chars[tree.parent[i]][s] += chars[i][s]
        return [s if s is not None else (int(c[1] >= c[0]) if sum(c) else None) for s, c in zip(state, chars, strict=True)]

    def marginals(self, tree: Tree) -> list[float]:
        """P(main text) of every node."""
        return self.infer(tree, edges=False)[0]

    def infer(self, tree: Tree, edges: bool = True, given: list[list[str]] | None = None) -> tuple[list[float], list[tuple[float, ...]]]:
        """Messages up, then down: P(main text) of every node and P(parent's state, own state) of every edge."""
        n = len(tree.parent)
        even = (math.log(0.5), math.log(0.5))
        up0, up1 = [0.0] * n, [0.0] * n  # a node's own potential and the messages of its children
        given = given or features(tree)
        for i in range(1, n):
            for f in given[i]:
                w = self.unary.get(f)
                if w:
                    up0[i] += w[0]
                    up1[i] += w[1]
        psi = [(self.pair.get((k, 0), even), self.pair.get((k, 1), even)) for k in (KINDS.get(t, "other") for t in tree.tag)]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            (a0, a1), (b0, b1) = psi[i]
            m0, m1 = _either(a0 + up0[i], a1 + up1[i]), _either(b0 + up0[i], b1 + up1[i])
            sent[i] = (m0, m1)
            up0[tree.parent[i]] += m0
            up1[tree.parent[i]] += m1
        out, joint = [0.5] * n, [(0.25,) * 4] * (n if edges else 0)
        all0, all1 = up0[:], up1[:]  # with the message from above
        for i in range(n):
            if i:
                p = tree.parent[i]
                rest0, rest1 = all0[p] - sent[i][0], all1[p] - sent[i][1]
                (a0, a1), (b0, b1) = psi[i]
                if edges:
                    four = (rest0 + a0 + up0[i], rest0 + a1 + up1[i], rest1 + b0 + up0[i], rest1 + b1 + up1[i])
                    top = max(four)
                    grown = [math.exp(x - top) for x in four]
                    joint[i] = tuple(x / sum(grown) for x in grown)
                all0[i] += _either(rest0 + a0, rest1 + b0)
                all1[i] += _either(rest0 + a1, rest1 + b1)
            d = all0[i] - all1[i]
            shift = max(all0[i], all1[i])
            all0[i], all1[i] = all0[i] - shift, all1[i] - shift
            out[i] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
        return out, joint


def _either(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@cache
def trained(pages: int = 600, seed: int = 3) -> Model:
    return Model(labelled_pages(pages, seed))


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    tree = parse(page)
    chance = model.marginals(tree)
    return "\n\n".join(t for t, c, tag in zip(tree.text, chance, tree.tag, strict=True) if tag == "#text" and c >= 0.5)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(id, url, text, n_chars) for every row."""
    model = model or trained()

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for one in batches:
            yield pd.Series([main_text(x, model) for x in one], dtype="object")

    rows = pages.select(F.col(id_col), F.col(url_col), text_of(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: The given pages' main text by their known template (one article of h1 and p, few character references):
#: what the model must find without knowing the template.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')) AS parts FROM a),
d AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x,
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp$', '&'), '\s+', ' ', 'g'))) AS parts FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
