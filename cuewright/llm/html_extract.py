"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands directly in them; a container's path is the chain of
tags and classes above it, digits generalised. Spark sums the shares that each path has of its pages' scores
over a host and takes the winner; then every page is extracted again along its host's path, and along its own
best path where the host's has less than half of the page's weight. A path stands for the article around it.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import checkpointed, small_batches

#: Hosts up to this many are broadcast with their paths; more are joined by shuffle, with pages salted.
BROADCAST_HOSTS, SALTS = 100_000, 64
#: A path longer than this goes on from its hash, so deep pages need no more room than flat ones.
LONG_PATH = 512

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z))""", re.S)
#: A tag that the end of the page cuts off.
CUT = re.compile(r"</?[a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym audio b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow mroot msqrt mstyle msub msubsup msup mtext nobr "
    "object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var video wbr".split()
)
SKIPPED = set("nav header footer aside form script style noscript template iframe svg button select option datalist menu dialog canvas embed textarea head title".split())
#: Words in class or id that mark what is not the article.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations share sharing "
    "social footer header masthead comment comments disqus respond reply replies newsletter subscribe subscription signup login search pagination pager "
    "toolbar copyright hidden".split()
)
#: Those of them that an article may also be about, or be marked with in its own words.
TOPICS = set("cookie cookies notice notices alert navigation menu menus related share sharing social footer header search copyright pagination banner login respond reply toolbar widget widgets".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What stands beside an article that says so in its class: not a mark.
MODIFIER = re.compile(r"(?<![a-z])(?:has|no|not|with|without)[-_]+[a-z]+")
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LIKELY = set("article content post entry story main body text".split())
#: Their text counts for the container around them.
LEAVES = set("p li blockquote pre td h1 h2 h3 h4 h5 h6 dd dt".split())
#: An opening tag of the first closes an open one of the second, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Page:
    """Blocks of text in page order, and the containers around them as ranges of blocks."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.weights: list[float] = []
        self.paths: list[str] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.marked: list[bool] = []
        self.ranges: list[list[int]] = []
        self.scores: list[float] = []
        self._stack: list[tuple[str, int, bool, int, bool]] = []  # tag, container (-1: inline), skipped, the innermost container, inline and marked
        self._open_tags: Counter[str] = Counter()
        self._around: list[tuple[int, int, int]] = []  # the container of a block, the two that it scores
        self._text: list[str] = []
        self._aside: list[int] = []  # places in _text that a marked inline tag holds
        self._linked = 0
        self._slugs: dict[int, str] = {}  # containers whose id may be a heading's: the id, until their first heading
        self._topics: set[int] = set()  # those whose first heading says the same
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self._add(CUT.sub("", source[at:]))
                break
            self._add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?![-a-zA-Z0-9:])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self._add(" ")
                if tag == "hr":
                    self._flush()
            else:
                self._open(tag, m[3] or m[6] or "")
        while self._stack:
            self._pop()
        self._flush()

    def _add(self, text: str) -> None:
        if text and not (self._stack and self._stack[-1][2]):
            if self._stack and self._stack[-1][4]:
                self._aside.append(len(self._text))
            self._text.append(html.unescape(text))
            if self._open_tags["a"]:
                self._linked += len(text)

    def _inner(self) -> int:
        """The innermost open container, or -1."""
        return self._stack[-1][3] if self._stack else -1

    def _flush(self) -> None:
        if self._aside:  # a marked word stays inside a sentence, and goes where it begins or ends most of the block
            sizes = [len(t.strip()) for t in self._text]
            marked, first, last = sum(sizes[k] for k in self._aside), self._aside[0], self._aside[-1]
            if 2 * marked > sum(sizes) and not (any(sizes[:first]) and any(sizes[last + 1 :])):
                for k in self._aside:
                    self._text[k] = " "
            self._aside = []
        text = " ".join("".join(self._text).split())
        if text and self._slugs:
            self._heading(text)
        if text:
            weight = len(text) * max(0.0, 1 - self._linked / len(text)) + 20 * text.count(",")
            inner = self._inner()
            near = self.parents[inner] if inner >= 0 and self.tags[inner] in LEAVES else inner
            self._around.append((inner, near, self.parents[near] if near >= 0 else -1))
            self.blocks.append(text)
            self.weights.append(weight)
        self._text, self._linked = [], 0

    def _heading(self, text: str) -> None:
        """The first block of a container whose id may come from its heading: a section on cookies is no notice of them."""
        c = self._inner()
        is_heading = c >= 0 and self.tags[c] in HEADINGS
        while c >= 0:
            if (slug := self._slugs.pop(c, None)) is not None and is_heading and "".join(re.findall(r"\w+", text.lower())) == slug:
                self._topics.add(c)
            c = self.parents[c]

    def _settle(self) -> None:
        """Drop the blocks in marked containers, but for those that hold the article, and score the rest."""
        weigh = [0.0, *itertools.accumulate(self.weights)]
        mass = [weigh[stop] - weigh[start] for start, stop in self.ranges]
        for c in self._topics:  # prose under its own heading; lists of links weigh next to nothing
            start, stop = self.ranges[c]
            if 2 * mass[c] > sum(map(len, self.blocks[start:stop])) and sum(b.count(" ") for b in self.blocks[start:stop]) >= 20:
                self.marked[c] = False
        if any(self.marked):
            near: list[int] = []  # the marked container at or next above each
            for c, up in enumerate(self.parents):
                near.append(c if self.marked[c] else near[up] if up >= 0 else -1)
            direct = dict.fromkeys([-1, *near], 0.0)
            for (inner, _, _), weight in zip(self._around, self.weights, strict=True):
                direct[near[inner] if inner >= 0 else -1] += weight
            clean = direct[-1]

            def keep(c: int) -> None:
                nonlocal clean
                self.marked[c] = False
                clean += direct[c]

            bodies = [c for c, tag in enumerate(self.tags) if tag in ("article", "main") and mass[c]]
            most = max(bodies, key=mass.__getitem__, default=-1)
            if most >= 0 and near[most] >= 0 and mass[most] > clean * (10 if self.marked[most] else 1):
                chain, c = [], near[most]
                while c >= 0:
                    chain.append(c)
                    c = near[self.parents[c]] if self.parents[c] >= 0 else -1
                for c in chain:
                    keep(c)
            elif all(near[c] >= 0 for c in bodies):
                for c in [c for c, m in enumerate(self.marked) if m]:
                    above = near[self.parents[c]] if self.parents[c] >= 0 else -1
                    if (above < 0 or not self.marked[above]) and 2 * mass[c] > weigh[-1] and 10 * clean < mass[c] and self.ranges[c][1] - self.ranges[c][0] > 1:
                        keep(c)
            under: list[bool] = []
            for c, up in enumerate(self.parents):
                under.append(self.marked[c] or (up >= 0 and under[up]))
            kept = [inner < 0 or not under[inner] for inner, _, _ in self._around]
            place = [0, *itertools.accumulate(kept)]
            self.ranges = [[place[start], place[stop]] for start, stop in self.ranges]
            self.blocks, self.weights, self._around = ([x for x, k in zip(xs, kept, strict=True) if k] for xs in (self.blocks, self.weights, self._around))
        for (_, first, second), weight in zip(self._around, self.weights, strict=True):
            if first >= 0:
                self.scores[first] += weight
            if second >= 0:
                self.scores[second] += weight * 0.5

    def _open(self, tag: str, attributes: str) -> None:
        found = {a.lower(): html.unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        marks = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{found.get('class', '')} {found.get('id', '')}").lower()
        tokens = set(re.findall(r"[a-z]+", MODIFIER.sub(" ", marks)))
        marks = tokens & BOILERPLATE if tag not in ("html", "body", "main") and tag not in HEADINGS else set()
        within = bool(self._open_tags["article"] or self._open_tags["main"])
        if tag == "p" and within and marks <= TOPICS - {"cookie", "cookies", "share", "sharing", "social", "pagination"}:
            marks = set()
        marked = bool(marks)
        hides = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        skipped = tag in SKIPPED or hides or found.get("role", "").lower() in ROLES
        skipped = skipped or bool(self._stack and self._stack[-1][2])
        if tag in INLINE:
            self._open_tags[tag] += 1
            self._stack.append((tag, -1, skipped, self._inner(), marked or bool(self._stack and self._stack[-1][4])))
            return
        self._flush()
        if self._open_tags["p"]:
            self._close("p")
        if tag in CLOSES and any(self._open_tags[t] for t in CLOSES[tag][0]):
            closed, barrier = CLOSES[tag]
            for t, *_ in reversed(self._stack):
                if t in barrier:
                    break
                if t in closed:
                    self._close(t)
                    if tag != "tr":
                        break
        above = self._inner()
        step = ".".join([tag, *sorted(set(re.sub(r"\d+", "#", found.get("class", "").lower()).split()))])
        before = self.paths[above] if above >= 0 else ""
        if len(before) > LONG_PATH:
            before = "~" + hashlib.blake2b(before.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        self.paths.append(f"{before}/{step}" if before else step)
        self.tags.append(tag)
        self.parents.append(above)
        self.marked.append(marked)
        self.ranges.append([len(self.blocks), -1])
        self.scores.append(0.0)
        self._open_tags[tag] += 1
        self._stack.append((tag, len(self.paths) - 1, skipped, len(self.paths) - 1, False))
        if marked and within and tag in ("section", "div") and marks <= TOPICS and not set(re.findall(r"[a-z]+", found.get("class", "").lower())) & BOILERPLATE:
            self._slugs[len(self.paths) - 1] = "".join(re.findall(r"\w+", found.get("id", "").lower()))
        if tag in ("article", "main") or tokens & LIKELY:
            self.scores[-1] += 0.001

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                if tag not in INLINE:
                    self._flush()
                    while len(self._stack) > i:
                        self._pop()
                else:  # only inline tags may be left open below
                    if all(t in INLINE for t, *_ in self._stack[i:]):
                        self._open_tags.subtract(t for t, *_ in self._stack[i:])
                        del self._stack[i:]
                return
            if tag in INLINE and self._stack[i][0] not in INLINE:
                return

    def _pop(self) -> None:
        self._flush()
        tag, c, *_ = self._stack.pop()
        self._open_tags[tag] -= 1
        if c >= 0:
            self.ranges[c][1] = len(self.blocks)

    def shares(self) -> dict[str, float]:
        """Each path's share of the page's score."""
        found: dict[str, float] = {}
        for path, score in zip(self.paths, self.scores, strict=True):
            if score > 0.01:
                parts = path.rpartition("/")[2].split(".")
                found[path] = found.get(path, 0.0) + score * (1.5 if parts[0] in ("article", "main") or LIKELY & set(re.findall(r"[a-z]+", " ".join(parts[1:]))) else 1.0)
        total = sum(found.values())
        return {p: s / total for p, s in found.items()}

    def spans(self, path: str | None) -> list[tuple[int, int]]:
        """Ranges of blocks, each once: those of the widened containers with this path; all for None.

        A container is widened to the outermost article or main around it; without one, to the lowest ancestor
        that holds every block of weight and every main heading.
        """
        if path is None:
            return [(0, len(self.blocks))]
        enough = 40 if max(self.weights, default=0.0) >= 40 else max(self.weights, default=0.0) / 2
        good = [i for i, w in enumerate(self.weights) if w >= enough or self._around[i][0] >= 0 and self.tags[self._around[i][0]] == "h1"]
        article, cover = [], []  # of each container: the outermost article or main around it, the lowest one that holds all of weight
        for c, up in enumerate(self.parents):
            outer = article[up] if up >= 0 else -1
            article.append(outer if outer >= 0 else c if self.tags[c] in ("article", "main") else -1)
            start, stop = self.ranges[c]
            cover.append(c if not good or start <= good[0] and good[-1] < stop else cover[up] if up >= 0 else -1)
        wide = []
        for c, p in enumerate(self.paths):
            if p == path and self.ranges[c][0] < self.ranges[c][1] and not (wide and self.ranges[c][1] <= wide[-1][1]):
                found = article[c] if article[c] >= 0 else cover[c]
                wide.append(tuple(self.ranges[found]) if found >= 0 else (0, len(self.blocks)))
        out, done = [], 0
        for start, stop in wide:
            if stop > done:
                out.append((max(start, done), stop))
                done = stop
        return out

    def text(self, spans: list[tuple[int, int]]) -> str:
        return " ".join(b for start, stop in spans for b in self.blocks[start:stop])

    def weight(self, spans: list[tuple[int, int]]) -> float:
        return sum(w for start, stop in spans for w in self.weights[start:stop])


def extract(source: str, host_path: str | None) -> str:
    page = Page(source)
    hosts = page.spans(host_path) if host_path else []
    if hosts and 2 * page.weight(hosts) >= sum(page.weights):
        return page.text(hosts)
    shares = page.shares()
    own = page.spans(max(shares, key=lambda p: (shares[p], p)) if shares else None)
    return page.text(hosts if hosts and page.weight(hosts) >= page.weight(own) else own)


def host_of(url):
    """The lower-cased host of a url column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, share), summed in the worker."""
    seen: dict[tuple[str, str], float] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.float64())], names=["host", "path", "share"])
        seen.clear()
        return out

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for path, share in Page(source.as_py()).shares().items() if source.is_valid else ():
                seen[host, path] = seen.get((host, path), 0.0) + share
        if len(seen) > 100_000:
            yield flush()
    yield flush()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py(), p) if h.is_valid else "" for h, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column(3)],
            names=["page_id", "url", "text", "n_chars", "path"],
        )


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the largest sum of shares on each host, ties by path."""
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string, share double")
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("share"))
    return sums.groupBy("host").agg(F.max(F.struct("share", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every page.

    * Null html counts as empty; a page without text has an empty ``text``. Pages whose url is null or has no
      host vote together. ``path`` is the host's, whether or not the page has text there.
    * Pages of any depth take time and memory in proportion to their length. Of paths with equal shares the last in order wins.
    * Repeated rows are extracted each for itself. An empty table gives an empty result; further columns are
      ignored.
    """
    small_batches(pages.sparkSession)
    paths = checkpointed(host_paths(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if paths.count() <= broadcast_hosts:
        found = rows.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return found.select("page_id", "url", "html", "path").mapInArrow(_extracted, f"page_id {dict(pages.dtypes)[id_col]}, url string, text string, n_chars long, path string")
