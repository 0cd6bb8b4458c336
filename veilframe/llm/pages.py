"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the running text in them. The page votes with its best containers
for their generalised paths (tags and classes, digits and repeats left out); votes are summed by host and
path in Spark, and every page of a host is read again with the path that won. A page without such a
container falls back on its own best one.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hosts whose winning path is broadcast; with more of them the pages are joined by a shuffle.
BROADCAST_HOSTS = 50_000
#: Containers that a page votes for.
VOTES = 3
#: What text in a container counts for those around it, a level up.
FADE = 0.85
#: Share of a page's running text with which a container is taken for the one around the article, whatever its name.
WRAPPER = 0.8

# Fixed names of HTML and of parts that are no article.
CONTAINERS = frozenset(
    "html head body main article section div nav header footer aside form ul ol dl table thead tbody tfoot tr td th"
    " blockquote figure details fieldset noscript iframe button select svg template dialog menu object canvas".split()
)
NOISE_TAGS = frozenset(
    "head nav header footer aside form noscript iframe button select svg template dialog menu object canvas".split()
)
RAW_TAGS = frozenset("script style title textarea xmp".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend option".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices notification alert popup modal overlay newsletter subscribe signup nav navbar navigation menu"
    " breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social"
    " comment comments disqus reply replies pagination pager login search".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
CONTENT_WORDS = frozenset("article post entry content story main body text".split())
#: Roles of the accessibility standard that are no article.
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW_TAGS}


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class _Paths:
    """The different paths of a page as numbers: a path is its parent's number and a step, so deep pages stay small."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]

    def below(self, path: int, step: str) -> int:
        found = self.numbers.setdefault((path, step), len(self.steps))
        if found == len(self.steps):
            self.steps.append((path, step))
        return found

    def text(self, path: int) -> str:
        out = []
        while path >= 0:
            path, step = self.steps[path]
            out.append(step)
        return ">".join(reversed(out))

    def number(self, text: str) -> int | None:
        """The path of this text, or None where the page has none."""
        path: int | None = 0
        for step in text.split(">")[1:]:
            path = self.numbers.get((path, step))
            if path is None:
                return None
        return path


class _Node:
    __slots__ = ("path", "step", "tag", "parent", "noise", "out", "named", "title", "body", "chars", "weight", "score", "depth")

    def __init__(self, tag: str, words: list[str], parent: _Node | None, out: bool = False, named: frozenset | set = frozenset(), paths: _Paths | None = None):
        self.step = ".".join([tag, *sorted(set(words))[:4]])
        if parent is None:
            self.path = 0
        else:
            self.path = parent.path if parent.step == self.step else paths.below(parent.path, self.step)
        self.tag, self.parent = tag, parent
        # out: no article by its tag, role or being hidden; named: its class and id words that speak against it
        self.out, self.named = out or parent is not None and parent.out, named
        self.noise = self.out or bool(named) or parent is not None and parent.noise
        self.title = self.body = False
        self.chars = 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.weight = {"article": 1.5, "main": 1.4, "body": 0.6, "html": 0.5}.get(tag, 1.0)
        if tag not in ("body", "html") and CONTENT_WORDS & set(words):
            self.weight *= 1.2
        self.score = 0.0


def _attributes(raw: str) -> tuple[list[str], list[str], bool]:
    """(class words, id words, hidden or a role that is no article)."""
    classes, ids, out = [], [], False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "class":
            classes = _WORDS.findall(value)
        elif name == "id":
            ids = _WORDS.findall(value)
        elif name == "role":
            out |= value in NOISE_ROLES
        elif name == "hidden":
            out = True
        elif value == "true":
            out = True
    return classes, ids, out


def parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]], _Paths]:
    """Containers, and blocks (container, text, characters that are no link) of a page in page order; its paths."""
    root, paths = _Node("", [], None), _Paths()
    nodes, blocks, stack = [root], [], [root]
    pieces: list[str] = []
    linked = skip = in_link = 0
    at = 0

    def flush():
        nonlocal linked, skip
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not skip and not stack[-1].out:
                blocks.append((stack[-1], text, max(0, len(text) - linked)))
            pieces.clear()
        linked = skip = 0

    def words(text: str):
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                linked += len(text)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if name in CONTAINERS:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        del stack[k:]
                        break
                continue
            if name in ("article", "main", "footer", "body"):
                # these end what a page forgot to close
                while len(stack) > 1 and stack[-1].noise and stack[-1].tag in ("head", "nav", "header", "aside", "ul", "ol", "li", "form"):
                    stack.pop()
            classes, ids, out = _attributes(raw) if raw else ([], [], False)
            bad = COMMENT_WORDS if name in ("article", "main") else NOISE_WORDS
            whole = name in ("html", "body")
            node = _Node(name, classes, stack[-1], not whole and (out or name in NOISE_TAGS), set() if whole else bad & {*classes, *ids}, paths)
            node.body = name in ("article", "main")
            nodes.append(node)
            if not raw.endswith("/"):
                stack.append(node)
        elif name in RAW_TAGS:
            if not closing:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
        elif name in BREAKS:
            flush()
            if not closing and name == "h1":
                stack[-1].title = True
            if not closing and raw:
                classes, ids, out = _attributes(raw)
                skip = int(out or name != "h1" and bool(NOISE_WORDS & {*classes, *ids}))
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
    flush()
    _judge(nodes, blocks)
    return nodes, [b for b in blocks if not b[0].noise], paths


def _judge(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Clear containers that only their names speak against where they hold the article.

    That is one with an h1 or an article element, and over half of the page's running text; one with
    an h1 inside an article; and one with WRAPPER of the running text. Where comment words speak against it,
    it must hold an h1, and without one its text does not count.
    """
    if not any(n.named and not n.out for n in nodes):
        return
    for node, _, chars in blocks:
        node.chars += chars
    for node in reversed(nodes):  # those inside come after those around them
        comments = bool(COMMENT_WORDS & node.named) and not node.title
        if node.parent is not None and not node.out and not comments:
            node.parent.title |= node.title
            node.parent.chars += node.chars
            node.parent.body |= node.body
    half = nodes[0].chars / 2
    inside = set()
    for node in nodes[1:]:
        up = node.parent
        held = node.title or node.body and not COMMENT_WORDS & node.named
        wrapper = node.chars > WRAPPER * nodes[0].chars and not COMMENT_WORDS & node.named
        clear = wrapper or held and node.chars > half or node.title and id(up) in inside
        node.noise = up.noise or node.out or bool(node.named) and not clear
        if not node.noise and (id(up) in inside or node.tag in ("article", "main")):
            inside.add(id(node))


def score(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """A container's score: the running text in it, less with each level between, times its kind's weight."""
    for node, _, chars in blocks:
        value, up = float(chars), node
        while up is not None and up.depth:
            up.score += value
            value *= FADE
            up = up.parent
    for node in nodes:
        node.score *= node.weight


def votes(page: str) -> list[tuple[str, float]]:
    """(path, share) of the page's best containers."""
    nodes, blocks, paths = parse(page)
    score(nodes, blocks)
    best: dict[int, float] = defaultdict(float)
    for node in nodes:
        if node.score > 0 and not node.noise:
            best[node.path] += node.score
    least = sorted(best.values(), reverse=True)[:VOTES][-1:]
    named = [(paths.text(path), v) for path, v in best.items() if v >= least[0]]
    top = sorted(named, key=lambda x: (-x[1], x[0]))[:VOTES]
    total = sum(v for _, v in top)
    return [(path, value / total) for path, value in top]


def extract(page: str | None, path: str | None) -> str:
    """Blocks of the containers with this path, or of the page's best container, joined by line ends."""
    if not page:
        return ""
    nodes, blocks, paths = parse(page)
    own = paths.number(path) if path else None
    chosen = {id(n) for n in nodes if own is not None and n.path == own and not n.noise}
    out = _inside(nodes, blocks, chosen)
    if not out and blocks:
        score(nodes, blocks)
        best = max((n for n in nodes if not n.noise), key=lambda n: n.score)
        out = _inside(nodes, blocks, {id(best)})
    return "\n".join(out)


def _inside(nodes: list[_Node], blocks: list[tuple[_Node, str, int]], chosen: set[int]) -> list[str]:
    """Texts of the blocks in these containers, however deep; nodes come before those they hold."""
    held = set(chosen)
    for node in nodes:
        if node.parent is not None and id(node.parent) in held:
            held.add(id(node))
    return [text for node, text, _ in blocks if id(node) in held]


def _vote(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        # votes of a batch's pages are summed before they leave the task
        sums: dict[tuple[str, str], float] = defaultdict(float)
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for path, share in votes(page) if page else ():
                sums[host_of(url), path] += share
        columns = list(zip(*((h, p, round(v * 1e6)) for (h, p), v in sums.items()), strict=True)) if sums else [[]] * 3
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "votes"]
        )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path) of the path with most votes; ties go to the first by name."""
    sums = pages.select("url", "html").mapInArrow(_vote, "host string, path string, votes long")
    sums = sums.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("votes"), "path")).alias("x")
    return sums.groupBy("host").agg(best).select("host", "x.path")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    text is the article's blocks, white space in each made one space, joined by line ends; '' for null or
    empty html and where there is no text outside menus, headers, footers, asides, forms, adverts and
    comments; header elements go with their titles, inside an article too. Words of class names and ids
    (see _judge) do not condemn a container that holds the article. A url without a host shares one host with its like. Other columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # one row per host; read once, and kept as a table only beyond the size that may be broadcast
    rows = winning_paths(base).limit(BROADCAST_HOSTS + 1).collect()
    kind = base.schema["page_id"].dataType
    schema = f"page_id {kind.simpleString()}, url string, text string, n_chars long"

    def read(paths_of):
        def run(batches):
            for batch in batches:
                urls = batch.column("url").to_pylist()
                texts = [
                    extract(page, path)
                    for page, path in zip(batch.column("html").to_pylist(), paths_of(batch, urls), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

        return run

    if len(rows) <= BROADCAST_HOSTS:
        known = spark.sparkContext.broadcast({r["host"]: r["path"] for r in rows})
        return base.mapInArrow(read(lambda _, urls: [known.value.get(host_of(u)) for u in urls]), schema)
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST.pattern, 1), F.lit("")))
    joined = base.withColumn("host", host).join(winning_paths(base), "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(
        read(lambda batch, _: batch.column("path").to_pylist()), schema
    )
