"""Main text of web pages by paths on which the pages of a host agree.

Each page is cut into blocks with their *generalised* path: tag names with class names, digits and ids left
out. Every container scores the prose in its whole subtree, less what stands in links. From the root, a page walks
down while all prose lies in one child, so that the container it votes for has the headline, the lead and the closing
beside the largest child; an ``article`` with most of the prose is taken as it is.
Spark sums the votes per host, and the paths with at least ``share`` of a host's pages win. Each page is
then read again at the first winning path with at least half the prose of its own container, or else at that.

Parts that are never article (menus, footers, adverts, forms, comments and so on) are left out by tag, role, or by a class name or id
that names such a part as a whole: each of its words is in ``MARKS`` or ``NEUTRAL``, one in ``MARKS`` at least. If nothing else
is left of a page, what names alone had left out is read.

Edge cases. A null or empty html gives an empty text. Pages without a usable url share the host ''. Broken,
unclosed or cut-off markup is read as far as it goes, and attributes count by their whole names alone; time grows with the page, however deep it is nested. Ties between paths go to the larger score, then the
smaller path. Null ids and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimward.llm.common import materialize

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input link menu meta nav noscript object option select svg template textarea title video".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
MARKS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus "
    "disclaimer footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted "
    "related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons card column container content desktop fixed form global group head icons inner item items left link links list "
    "main mobile outer page panel post posts right row section site slot sticky text thread title top unit wrap wrapper zone".split()
)
#: Elements that hold prose themselves, and lists of them; the others are containers.
PROSE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
LISTS = frozenset("dl ol ul".split())
#: Characters from which a paragraph, or text in a container itself, counts as prose when containers are compared. No text is dropped for its length.
LONG, LONG_BARE = 60, 150

#: The attributes of a tag, name by name with their values consumed, so that a quote within an unquoted value, or one never closed, ends with its attribute.
#: Nothing is given up once matched, so time grows with the tag.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+"
_ATTRIBUTES = r"(?:[\s/=]++|[^\s/>=]++(?:" + _VALUE.replace("([^", "(?:[^") + r")?+)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:{_VALUE})?+", re.S)
READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
#: A start tag that ends an open element of the same kind.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


def _names_other_part(name: str) -> bool:
    """Whether a class name or id says that its element is no article: by all its words, not by any."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in MARKS for w in words) and all(w in MARKS or w in NEUTRAL for w in words)


def _step(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The generalised path step of an element, whether it's never part of an article, and whether only its names say so."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if (name := m[1].lower()) in READ:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    classes = sorted({re.sub(r"\d+", "", c.lower()).replace("/", "|") for c in found.get("class", "").split()} - {""})
    off = tag in NEVER or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    named = tag not in ("html", "body", "main", "article") and any(_names_other_part(c) for c in [*classes, found.get("id", "").lower()])
    return ".".join([tag, *classes]), off, named or (tag == "article" and any(c.rstrip("s") == "comment" for c in classes))


@dataclass
class Page:
    """The blocks of a page in order, (path, text, characters in links), and its paths; path 0 is the page, a path comes after its parent."""

    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    named: list[tuple[int, str, int]] = field(default_factory=list)  # left out for a name alone
    parents: list[int] = field(default_factory=lambda: [0])
    steps: list[str] = field(default_factory=lambda: [""])
    known: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, parent: int, step: str) -> int:
        found = self.known.get((parent, step))
        if found is None:
            found = self.known[parent, step] = len(self.steps)
            self.parents.append(parent)
            self.steps.append(step)
        return found

    def tag(self, path: int) -> str:
        return self.steps[path].partition(".")[0]

    def name(self, path: int) -> str:
        out = []
        while path:
            out.append(self.steps[path])
            path = self.parents[path]
        return "/".join(reversed(out))

    def find(self, name: str) -> int | None:
        path: int | None = 0
        for step in filter(None, name.split("/")):
            path = self.known.get((path, step))
            if path is None:
                return None
        return path

    def inside(self, path: int) -> list[bool]:
        """For every path, whether it's ``path`` or below it."""
        out = [path == 0]
        for i in range(1, len(self.parents)):
            out.append(i == path or out[self.parents[i]])
        return out


@dataclass(frozen=True)
class _Open:
    tag: str
    path: int
    off: bool
    named: bool
    block: int  # where the nearest block element is in the stack, itself included; -1 for none


def parse(page: str) -> Page:
    """The blocks of text that may be article. Each element is opened and closed once, so time grows with the page."""
    out = Page()
    stack: list[_Open] = []
    counts: Counter[str] = Counter()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                top = stack[-1] if stack else None
                (out.named if top and top.named else out.blocks).append((top.path if top else 0, joined, linked))
        text.clear()
        linked = 0

    def close() -> None:
        counts[stack.pop().tag] -= 1

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if (m[0][0] != "<" or m[0] == "<") and not (stack and stack[-1].off):
                text.append(m[0])
                if counts["a"]:
                    linked += len(m[0])
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCK:
                flush()
            if counts[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in BLOCK:
            flush()
            while stack and (at := stack[-1].block) >= 0 and tag in ENDS.get(stack[at].tag, ()):
                while len(stack) > at:
                    close()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        step, off, named = _step(tag, m[4])
        above = stack[-1] if stack else _Open("", 0, False, False, -1)
        off = off or above.off or (tag == "header" and not counts["article"] and not counts["main"])
        if named and tag not in BLOCK:  # inside a block
            off = True
        path = out.child(above.path, step) if tag in BLOCK else above.path
        stack.append(_Open(tag, path, off, named or above.named, len(stack) if tag in BLOCK else above.block))
        counts[tag] += 1
    flush()
    if not out.blocks:
        out.blocks = out.named
    return out


def _prose(page: Page, path: int, text: str, linked: int) -> tuple[int, bool]:
    """How much prose a block is, and whether it alone shows that its container is article."""
    worth, tag = max(0, len(text) - 2 * linked), page.tag(path)
    if tag in PROSE:
        return worth, worth > 0 and (len(text) >= LONG or tag == "h1")
    return int(0.6 * worth), worth >= LONG_BARE


def best_container(page: Page) -> tuple[int, int] | None:
    """(path, prose): the smallest container with all of a page's prose, as far as its marks tell."""
    if not page.blocks:
        return None
    n = len(page.steps)
    holder = list(range(n))  # the container of a path
    for i in range(1, n):
        if page.tag(i) in PROSE or page.tag(i) in LISTS:
            holder[i] = holder[page.parents[i]]
    total, strong, own, heads, own_heads = ([0] * n for _ in range(5))
    for path, text, linked in page.blocks:
        at, (worth, shows) = holder[path], _prose(page, path, text, linked)
        head = page.tag(path) == "h1"
        total[at] += worth
        strong[at] += worth if shows and not head else 0
        own[at] += worth if shows else 0
        heads[at] += head
        own_heads[at] += head
    children: dict[int, list[int]] = {}
    for i in range(n - 1, 0, -1):
        if holder[i] == i:
            up = holder[page.parents[i]]
            total[up] += total[i]
            strong[up] += strong[i]
            heads[up] += heads[i]
            children.setdefault(up, []).append(i)
    start, most = 0, 0
    for tag in ("article", "main"):
        pick = max((i for i in range(n) if page.tag(i) == tag), key=lambda i: (total[i], -i), default=None)
        if pick is not None and 2 * total[pick] >= max(1, total[0]):
            start = pick
            up = holder[page.parents[pick]]
            if tag == "article" and not heads[pick] and own_heads[up] and page.tag(up) not in ("", "html", "body"):
                start = up
            if tag == "article":
                return start, total[start]
            break
    while not own[start]:
        below = [i for i in children.get(start, ()) if strong[i]]
        if not below:
            below = [i for i in children.get(start, ()) if total[i] and total[i] >= 0.9 * total[start]]
        most = max(below, key=lambda i: (strong[i], total[i], -i), default=0)
        if not most or len(below) > 1 or (heads[start] > heads[most] == 0):
            break
        start = most
    return start, total[start]


def read_at(page: Page, names: list[str]) -> str:
    """The text at the first of the containers ``names`` that has half the prose of the page's own container at least, or at that one."""
    own = best_container(page)
    if own is None:
        return ""
    for name in names:
        path = page.find(name)
        if path is None or path == own[0]:
            if path is not None:
                break
            continue
        inside = page.inside(path)
        prose = sum(_prose(page, p, t, k)[0] for p, t, k in page.blocks if inside[p])
        if prose and 2 * prose >= own[1]:
            return "\n".join([t for p, t, _ in page.blocks if inside[p]])
    inside = page.inside(own[0])
    return "\n".join([t for p, t, _ in page.blocks if inside[p]])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: Winning paths up to this many rows are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def winning_paths(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(host, paths): the container paths that win the vote of each host's pages, best first."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed = parse(page or "")
                if best := best_container(parsed):
                    tally = cast.setdefault((host, parsed.name(best[0])), [0, 0])
                    tally[0] += 1
                    tally[1] += best[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in cast], pa.string()), pa.array([p for _, p in cast], pa.string()), pa.array([n for n, _ in cast.values()], pa.int64()), pa.array([s for _, s in cast.values()], pa.int64())],
                names=["host", "path", "votes", "score"],
            )

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(vote, "host string, path string, votes long, score long")
    tally = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    ranked = tally.withColumn("all_votes", F.sum("votes").over(Window.partitionBy("host"))).where(F.col("votes") >= share * F.col("all_votes"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return ranked.groupBy("host").agg(order["path"].alias("paths"))


def extract(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html)."""
    winners = materialize(winning_paths(pages, share), "host-paths")
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    if winners.count() <= BROADCAST_ROWS:
        winners = F.broadcast(winners)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_at(parse(page or ""), paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    out = joined.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
