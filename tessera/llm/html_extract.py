"""Main text of web pages by consensus of the host's pages.

Each page is parsed once to score its containers: blocks of text count for the
container around them, half for the next one out, and text in links counts
against. From the best one a page climbs to the article or main element around
it, and on to the outermost container that adds only prose, so that a headline or
lead beside the body stays. It votes for the generalised tag-class path (digits
as #) of the container it comes to. Spark sums the votes per host. Then every page is extracted
again with its host's winning path; a page on which that path has no text uses
its own container.

What an element's name or class says is judged after the page is read: an element
named like a sidebar, or a form, that holds nearly all of the page's prose is the
layout around the article and stays. A header inside an article loses all but its
headings.

The winners of up to ``host_bound`` hosts are broadcast; beyond that they are
joined by host, a join that Spark may split where a host is large.

Defined results: null or empty html gives an empty text. A null url counts as
the host ''. Ties between paths go to the greater summed score, then to the
lesser path. Repeated rows each get a row. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lightened, saved, table, tidied

HOST_BOUND = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt ul ol dl figcaption figure table tbody thead tr td th".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr"))}

#: Elements that are never part of an article.
DROP = frozenset("head title nav header footer aside form button select option script style noscript iframe template svg math dialog menu object canvas audio video textarea".split())
#: Parts of class and id names that mark the same things.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

#: A marked element that holds this share of the page's prose is a layout, not what its name says; a form must hold paragraphs too.
LAYOUT = 0.9
PARAGRAPHS = 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Text outside paragraphs, headings, lists and tables is prose from so many characters on.
PROSE = 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'){0,1000}+)>|<[!?][^>]*>|</?[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|hidden|role)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """Elements (parent, tag, label, path number) and the blocks of text that are not dropped."""

    def __init__(self, html: str):
        self.parent, self.tag, self.label = [-1], ["root"], ["root"]
        self.path = [0]  # numbers of paths; inline elements have their parent's
        self._paths: dict[tuple[int, str], int] = {(-1, "root"): 0}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._mark = [0]  # of the element itself: 0 none, 1 by name, 2 by element
        self._owner_of, self.holder = [0], [0]  # the nearest element that is not inline, and the nearest container
        self._open_tags: dict[str, int] = {}
        self._buffer: list[str] = []
        self._links = self._in_link = 0
        self._owner = 0
        self._stack = [0]
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                self._close(tag)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self._flush()
            else:
                self._open(tag, m[4])
        if at < len(html):
            self._text(html[at:])
        self._flush()
        del self._stack, self._open_tags
        self._settle()

    def _settle(self) -> None:
        """Drop the blocks of what is marked."""
        n = len(self.parent)
        if not any(self._mark):
            return
        hard = [False] * n  # in an element dropped for what it is, forms aside
        for e in range(1, n):
            hard[e] = hard[self.parent[e]] or self._mark[e] == 2 and self.tag[e] != "form"
        prose, paragraphs = [0] * n, [0] * n
        for element, text, links in self.blocks:
            if not hard[element]:
                prose[element] += len(text) - links
                paragraphs[element] += self.tag[element] == "p"
        for e in range(n - 1, 0, -1):
            prose[self.parent[e]] += prose[e]
            paragraphs[self.parent[e]] += paragraphs[e]
        dropped, inside = [0] * n, [False] * n
        for e in range(1, n):
            up, tag, mark = self.parent[e], self.tag[e], self._mark[e]
            drop = dropped[up]
            inside[e] = inside[up] or tag in ("article", "main")
            if tag in ("article", "main") and drop == 1:
                drop = 0
            if mark and not drop:
                layout = prose[e] and prose[e] >= LAYOUT * prose[0]
                if mark == 2:
                    spared = layout and tag == "form" and paragraphs[e] >= PARAGRAPHS
                    drop = 0 if spared else 3 if tag == "header" and inside[up] else 2
                else:
                    drop = 0 if layout else 1
            elif mark == 2 and drop in (1, 3):
                drop = 2
            dropped[e] = drop
        self.blocks = [b for b in self.blocks if not dropped[b[0]] or dropped[b[0]] == 3 and self.tag[b[0]] in HEADINGS]

    def path_of(self, element: int) -> str:
        """Path of an element, from the root."""
        out, last = [], -1
        while element >= 0:
            if self.path[element] != last:
                last = self.path[element]
                while self.tag[element] in INLINE:
                    element = self.parent[element]
                out.append(self.label[element])
            element = self.parent[element]
        return ">".join(out[::-1])

    def at(self, path: str) -> list[int]:
        """Elements with a path. Labels are compared along the path, so no other path is ever written out."""
        reach = [-1] * len(self._paths)
        for (up, label), no in self._paths.items():
            begin = 0 if up < 0 else reach[up]
            word = label if up < 0 else ">" + label
            if begin >= 0 and path.startswith(word, begin):
                reach[no] = begin + len(word)
        return [e for e, no in enumerate(self.path) if reach[no] == len(path) and self.tag[e] not in INLINE]

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        if not self._buffer:
            self._owner = self._owner_of[self._stack[-1]]
        self._buffer.append(text)
        if self._in_link:
            self._links += len(text)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                self.blocks.append((self._owner, text, self._links))
            self._buffer.clear()
        self._links = 0

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag not in INLINE:
            self._flush()
            if tag in CLOSES_P:
                self._pop(("p",), frozenset(("td", "th", "li", "div", "article", "section", "main", "body")))
            if tag in SAME:
                self._pop(SAME[tag], SCOPE.get(tag, frozenset()))
        elif tag == "a":
            self._pop(("a",), frozenset(("td", "th", "li", "div", "p")))
            self._in_link += 1
        classes, names, hidden = "", "", False
        for name, *values in _NAMES.findall(attributes) if attributes else ():
            value = "".join(values)
            if name.lower() == "class":
                classes = value
            hidden |= name.lower() == "hidden"
            if name.lower() in ("class", "id"):
                names += " " + value
        up, element = stack[-1], len(self.tag)
        mark = 0
        if tag in DROP:
            mark = 2
        elif hidden or (names and tag not in ("html", "body") and not MARKS.isdisjoint(_PARTS.split(names.lower()))):
            mark = 1
        label = tag + "".join("." + c for c in sorted(set(_DIGITS.sub("#", classes).split()))) if classes else tag
        inline = tag in INLINE
        self.parent.append(up)
        self.tag.append(tag)
        self.label.append(label)
        self.path.append(self.path[up] if inline else self._paths.setdefault((self.path[up], label), len(self._paths)))
        self._mark.append(mark)
        self._owner_of.append(self._owner_of[up] if inline else element)
        self.holder.append(self.holder[up] if inline or tag in LEAF else element)
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1
        stack.append(element)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        self._pop((tag,), frozenset())

    def _pop(self, tags: tuple[str, ...], stop: frozenset) -> None:
        """Close the innermost of some elements and all that is open in it, unless an element of ``stop`` is nearer."""
        stack, count = self._stack, self._open_tags
        if not any(count.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in tags:
                for x in stack[i:]:
                    count[self.tag[x]] -= 1
                    self._in_link -= self.tag[x] == "a"
                del stack[i:]
                return
            if tag in stop:
                return

    def best(self) -> tuple[int, float]:
        """The container of the article and the score of the best one in it; the root of a page without text."""
        score: dict[int, float] = {}
        for element, text, links in self.blocks:
            worth = len(text) - 2 * links
            c = self.holder[element]
            factor = 1.5 if self.tag[c] in ("article", "main") else 1.0
            score[c] = score.get(c, 0) + worth * factor
            if c:
                score[self.parent[c]] = score.get(self.parent[c], 0) + worth / 2
        if not score:
            return 0, 0.0
        top = min(score, key=lambda c: (-score[c], c))
        return self.climbed(top), score[top]

    def climbed(self, top: int) -> int:
        """The article or main around a container, or a container further out that adds prose and nothing else."""
        chain = [top]
        while chain[-1]:
            chain.append(self.parent[chain[-1]])
        meets = dict(zip(chain, range(len(chain)), strict=True))  # where an element's ancestors meet the chain
        for element in range(len(self.parent)):
            if element not in meets:
                meets[element] = meets[self.parent[element]]
        least = next((i for i, c in enumerate(chain) if self.tag[c] in ("article", "main")), 0)
        adds, other = {least}, len(chain)
        for element, text, links in self.blocks:
            if meets[element] <= least:
                continue
            if 2 * links < len(text) and (self.tag[element] in LEAF or len(text) >= PROSE):
                adds.add(meets[element])
            else:
                other = min(other, meets[element])
        return chain[max(i for i in adds if i < other)]

    def text(self, inside) -> str:
        """Blocks inside some elements, joined in page order."""
        chosen = [False] * len(self.parent)
        for e in inside:
            chosen[e] = True
        for e in range(1, len(chosen)):
            chosen[e] = chosen[e] or chosen[self.parent[e]]
        return "\n".join(text for element, text, _ in self.blocks if chosen[element])

    def extract(self, path: str | None) -> str:
        """Text by a host's path, or else by the page's own container."""
        if path is not None:
            out = self.text(self.at(path))
            if out:
                return out
        return self.text([self.best()[0]])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of a task's pages, summed by host and path."""
    votes: dict[tuple[str, str], list[float]] = {}

    def summed() -> pa.RecordBatch:
        keys = list(votes)
        out = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
        out += [pa.array([int(votes[k][0]) for k in keys], pa.int64()), pa.array([float(votes[k][1]) for k in keys], pa.float64())]
        return pa.RecordBatch.from_arrays(out, ["host", "path", "votes", "score"])

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            top, score = page.best()
            if page.blocks:
                v = votes.setdefault((host, page.path_of(top)), [0, 0.0])
                v[0] += 1
                v[1] += round(score)
        if len(votes) > 50_000:
            yield summed()
            votes.clear()
    yield summed()
    tidied()


def _extractor(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist() if shared is None else [shared.value.get(h) for h in batch.column("host").to_pylist()]
            texts = [Page(h).extract(p) for h, p in zip(batch.column("html").to_pylist(), paths, strict=True)]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])
        tidied()

    return extract


def host_of(url):
    """Lower-case host of a url column, '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host. Takes host and html."""
    votes = pages.select("host", "html").mapInArrow(_vote, "host string, path string, votes bigint, score double")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    ranked = summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path"))
    return ranked


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", host_bound: int = HOST_BOUND) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    lightened(pages.sparkSession)
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    winners = saved(host_paths(rows))
    some = winners.limit(host_bound + 1).collect()
    shared = None
    if len(some) <= host_bound:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["path"] for r in some})
    else:
        rows = rows.join(winners, "host", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extractor(shared), f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
