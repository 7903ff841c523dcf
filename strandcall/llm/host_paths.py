"""Main text of web pages by consensus paths of their hosts.

Every page is parsed and its containers are scored: a block gives the length of its
text, without links, to the container around it, and half of it to the next. From the
best tag-class path, in which digits are generalised, the page climbs to the lowest one that
holds nearly all text outside asides and links, the headings, and the article or main
element around it. It votes for that path. Spark sums the votes of a host; its pages are then parsed
again and the text under the winning path is taken. A page on which that path doesn't hold
most of the text uses its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcall.llm.common import LOWER, UPPER, modest_batches, ship, small_batches
from strandcall.session import stage

# Element names of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe".split())
SILENT = frozenset(
    "head script style noscript template iframe svg math object canvas audio video map nav header footer aside form "
    "button select option textarea input label dialog menu datalist title xmp".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body div main section td center blockquote".split())
CLOSES_P = BLOCKS - {"option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}
SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class and id names, and roles, of what is not main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "aside footer header masthead toolbar comment comments reply replies respond disqus share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets copyright".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME = re.compile(r"[A-Za-z]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")  # of names written like sideBar
DIGITS = re.compile(r"\d+")
OPEN, CLOSE, TEXT = 0, 1, 2
CORE = frozenset(("article", "main", "h1", "body"))
MAIN_SHARE = 0.6
MOST = 0.5
NEARLY_ALL = 0.98


class Page:
    """Elements in page order with their parents, and the events (what, element or text) between them."""

    def __init__(self, source: str):
        self.tags, self.parents, self.names, self.aside, self.named, self.talk = ["#"], [-1], ["#"], [False], [False], [False]
        self.events: list[tuple[int, int | str]] = []
        self._parse(source)
        self._number()
        self._weigh()

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        if not attributes.strip():
            return self._add(parent, tag, tag, tag in SILENT, False, False)
        found = {}
        for a in ATTRIBUTE.finditer(attributes):
            found.setdefault(a[1].lower(), html.unescape((a[2] or "").strip("\"'")))
        classes = sorted({DIGITS.sub("#", c.lower()) for c in found.get("class", "").split()})
        said = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in (*NAME.findall(said), *PART.findall(said))}
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        aside = tag in SILENT or hidden or found.get("role", "").lower() in ASIDE_ROLES
        name = ".".join([tag, *classes]).replace(">", "")
        return self._add(parent, tag, name, aside, not words.isdisjoint(ASIDE_WORDS), not words.isdisjoint(COMMENT_WORDS))

    def _add(self, parent: int, tag: str, name: str, aside: bool, named: bool, talk: bool) -> int:
        for column, value in ((self.tags, tag), (self.parents, parent), (self.names, name), (self.aside, aside), (self.named, named), (self.talk, talk)):
            column.append(value)
        self.events.append((OPEN, len(self.tags) - 1))
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack, at, last = [0], 0, source.rfind(">")
        depths: dict[str, list[int]] = {"block ": [], "container ": []}  # of the open elements, by tag; blocks and containers also together
        def close(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                self.events.append((CLOSE, node))
                tag = self.tags[node]
                depths[tag].pop()
                if tag in BLOCKS:
                    depths["block "].pop()
                if tag in CONTAINERS:
                    depths["container "].pop()

        def inner(tags: tuple[str, ...], stops: tuple[str, ...]) -> int:
            """The depth of the innermost of these elements, 0 if a stop or nothing comes first."""
            depth, stop = (max((depths[t][-1] for t in some if depths.get(t)), default=0) for some in (tags, stops))
            return depth if depth >= stop else 0

        while at < len(source):
            found = TOKEN.search(source, at) if at <= last or "<!--" in source[at:] else None
            text = source[at : found.start() if found else len(source)]
            if text:
                self.events.append((TEXT, text))
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                depth = inner((tag,), () if tag in BLOCKS else ("block ",))
                if depth:
                    close(depth)
                continue
            if tag in CLOSES_P and (depth := inner(("p",), ("container ",))):
                close(depth)
            if tag in SAME and (depth := inner((tag, "dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,), SAME[tag])):
                close(depth)
            node = self._open(stack[-1], tag, found[3] or found[6] or "")
            if tag in RAW:
                closing = re.compile(rf"</{tag}\b", re.I).search(source, at)
                at = (source.find(">", closing.end()) if closing else -1) + 1 or len(source)
            if tag in VOID or tag in RAW or (found[3] or "").endswith("/") and tag not in BLOCKS:
                self.events.append((CLOSE, node))
            else:
                depths.setdefault(tag, []).append(len(stack))
                if tag in BLOCKS:
                    depths["block "].append(len(stack))
                if tag in CONTAINERS:
                    depths["container "].append(len(stack))
                stack.append(node)
        close(1)

    def _number(self) -> None:
        """Numbers of the paths, and the block, the container and whether a link in its block is around each element."""
        self.numbers: dict[tuple[int, str], int] = {(-1, "#"): 0}
        self.number, self.block, self.linked, self.container = [0], [0], [False], [0]
        for node in range(1, len(self.tags)):
            tag, parent = self.tags[node], self.parents[node]
            self.number.append(self.numbers.setdefault((self.number[parent], self.names[node]), len(self.numbers)))
            self.block.append(node if tag in BLOCKS else self.block[parent])
            self.linked.append(tag not in BLOCKS and (tag == "a" or self.linked[parent]))
            self.container.append(node if tag in CONTAINERS else self.container[parent])

    def _weigh(self) -> None:
        """Lengths of text per element. A container named like an aside is one, unless the main text's elements are in it.

        An ``article`` in such a container tells this only with most of the page's text, as teasers and readers' comments are
        articles too; one named as a comment never does. If nothing is left so, every one tells it. If a page has neither
        these nor other text, only small containers are left out by name.
        """
        total, own, stack = [0] * len(self.tags), {}, [0]
        silent = 0
        for what, value in self.events:
            if what == OPEN:
                stack.append(value)
                silent += self.aside[value]
            elif what == CLOSE:
                silent -= self.aside[stack.pop()]
            elif not silent:
                own[stack[-1]] = own.get(stack[-1], 0) + len("".join(value.split()))
        for node, size in own.items():
            total[node] += size
        for node in range(len(total) - 1, 0, -1):
            total[self.parents[node]] += total[node]
        self.own = own
        beside = [False] * len(total)  # in a container named like an aside
        for node in range(1, len(total)):
            above = self.parents[node]
            beside[node] = beside[above] or self.named[above] and self.tags[above] not in ("body", "html")
        core = [tag in CORE for tag in self.tags]
        told = [
            c and (t != "article" or not self.talk[n] and (not beside[n] or total[n] >= MAIN_SHARE * total[0]))
            for n, (c, t) in enumerate(zip(core, self.tags))
        ]
        for lifted in (told, core):
            for node in range(len(total) - 1, 0, -1):
                lifted[self.parents[node]] |= lifted[node]
            self._cover([self.named[n] and not lifted[n] for n in range(len(total))])
            if any(size and not self.covered[node] for node, size in own.items()):
                break
        if not any(core) and not any(size and not self.covered[node] for node, size in own.items()):
            self._cover([self.named[n] and total[n] < MAIN_SHARE * total[0] for n in range(len(core))])

    def _cover(self, more: list[bool]) -> None:
        """Mark what lies in an aside, in one by its name too."""
        self.left_out = [a or m for a, m in zip(self.aside, more)]
        self.covered = [False] * len(self.tags)
        for node in range(1, len(self.tags)):
            self.covered[node] = self.left_out[node] or self.covered[self.parents[node]]

    def path(self, node: int) -> str:
        names = []
        while node >= 0:
            names.append(self.names[node])
            node = self.parents[node]
        return ">".join(reversed(names))

    def scores(self) -> dict[int, float]:
        """What each container gets from the blocks in it."""
        found: dict[int, float] = {}
        self.main: dict[int, int] = {}  # text that counts, by element
        self.heads: dict[int, int] = {}  # that of main headings, linked too
        for node, size in self.own.items():
            at, linked = self.block[node], self.linked[node]
            if self.covered[node] or not size:
                continue
            if self.tags[at] == "h1":
                self.heads[node] = size
            if linked:
                continue
            self.main[node] = size
            share = float(size)
            if self.tags[at] not in CONTAINERS:
                at = self.parents[at]
            for _ in range(2):
                at = self.container[max(at, 0)]
                found[at] = found.get(at, 0.0) + share
                share /= 2
                if at <= 0:
                    break
                at = self.parents[at]
        return found

    def votes(self) -> dict[str, float]:
        """The page's vote, for the path that it climbs to; none without text."""
        scores = self.scores()
        if not scores:
            return {}
        numbers, number = self.numbers, self.number
        above = [parent for parent, _ in numbers]
        shared: dict[int, float] = {}
        for node, score in scores.items():
            shared[number[node]] = shared.get(number[node], 0.0) + score
        held = []
        for sizes in (self.main, self.heads):
            total = [0] * len(numbers)
            for node, size in sizes.items():
                total[number[node]] += size
            for k in range(len(total) - 1, 0, -1):
                total[above[k]] += total[k]
            held.append(total)
        main, heads = held
        first = {k: node for node, k in reversed(list(enumerate(number)))}
        at = max(shared, key=lambda k: (shared[k], -k))
        while at > 0 and (main[at] < NEARLY_ALL * main[0] or heads[at] < heads[0]):
            at = above[at]
        up = at
        while up > 0 and self.tags[first[up]] not in ("article", "main"):
            up = above[up]
        return {self.path(first[up if up > 0 else at]): 1.0}

    def blocks(self, roots: set[int]) -> list[str]:
        """Blocks of text under these elements, without asides."""
        found, parts = [], []
        stack, inside, silent = [0], int(0 in roots), 0

        def end() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append(text)

        for what, value in self.events:
            if what == TEXT:
                if inside and not silent:
                    parts.append(value)
                continue
            if what == OPEN:
                stack.append(value)
            if self.tags[value] in BLOCKS:
                end()
            elif self.tags[value] == "br" and what == OPEN and inside and not silent:
                parts.append(" ")
            step = 1 if what == OPEN else -1
            if value in roots:
                inside += step
            elif inside and self.left_out[value]:
                silent += step
            if what == CLOSE:
                stack.pop()
        end()
        return found

    def _under(self, path: str | None) -> set[int]:
        """Elements of this path that are no asides."""
        at = None if path is None else 0
        for name in path.split(">")[1:] if path is not None else ():
            at = self.numbers.get((at, name))
            if at is None:
                break
        return {n for n, k in enumerate(self.number) if k == at and not self.covered[n]}

    def text(self, path: str | None) -> str:
        """Text under a path, if it holds most of the text that counts; else under the path that the page itself votes for."""
        roots = self._under(path)
        inside = [node in roots for node in range(len(self.tags))]
        for node in range(1, len(inside)):
            inside[node] |= inside[self.parents[node]]
        self.scores()
        held = sum(size for node, size in self.main.items() if inside[node])
        if (not roots or held <= MOST * sum(self.main.values())) and (votes := self.votes()):
            roots = self._under(max(votes, key=lambda p: (votes[p], -len(p), p)))
        return "\n".join(self.blocks(roots))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def host_votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): what the pages of each host vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hosts, paths, votes = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, vote in Page(source or "").votes().items():
                    hosts.append(host)
                    paths.append(path)
                    votes.append(round(vote * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "vote"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = modest_batches(rows).mapInArrow(run, "host string, path string, vote long")
    return found.groupBy("host", "path").agg(F.sum("vote").alias("votes"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, host, path, text): each row of ``pages`` as a struct, its host's winning path and its main text.

    Votes of a host are summed before they are shuffled; ties go to the shorter, then
    the larger path. A missing url belongs to the host of an empty name. Null,
    empty and textless pages have an empty text. Nothing is cut off.
    """
    rank = F.struct("votes", (-F.length("path")).alias("short"), "path")
    winners = host_votes(pages, url_col, html_col).groupBy("host").agg(F.max(rank).alias("best")).select(F.col("host"), F.col("best.path").alias("path"))
    winners = stage(winners, "host-paths")  # its size is known then: pages are shuffled only if hosts are too many to send round
    rows = pages.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("host")).join(winners, "host", "left")
    rows = rows.select("row", "host", "path", F.col(f"row.{html_col}").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            paths, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = pa.array([Page(s or "").text(p) for s, p in zip(sources, paths)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], ["row", "host", "path", "text"])

    return modest_batches(rows).mapInArrow(run, rows.select("row", "host", "path", F.lit("").alias("text")).schema)


ship(__name__)
