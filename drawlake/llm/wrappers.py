"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of blocks; the sequence of a block's children is a string of tokens. Inference folds adjacent repeats of any
period into repeated groups, then aligns the sequences of the same host's pages, block by block: what one of two lacks becomes
optional, a group that repeats in one repeats in the other, equal texts stay template text and texts that differ become slots.
Wrappers of parts of a host are aligned in the same way, so tasks fold their own pages first, and no task holds more than
MOST_HOSTS of them.

A page is then parsed with the wrapper of its host. On hosts of LEAST_PAGES different pages or more, the article is the block
of the wrapper in which slots hold most of the text that differs from page to page; template text inside of it is left out.
Only hosts of fewer pages, which say nothing of what differs, are read by the meaning of element names.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import cut, ship, tidy

PARTS = 64  # parts of a host that are folded apart before the whole
MOST_HOSTS = 256  # wrappers that a task holds at a time while it folds pages
LEAST_PAGES = 3  # different pages that tell template text from slots
DEEPEST = 128  # blocks inside of each other; what is nested deeper counts to the block at that depth, as in browsers (512)
DOMINANT = 0.5  # share of a block's slot text that a block inside of it must hold to be entered
SALTS = 16  # parts that a host's pages are dealt to where wrappers are too many to broadcast
BROADCAST_BYTES = 8 << 20

# Element names by what they mean to a reader of the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
RCDATA = set("title textarea".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = set("article aside body div footer form header main nav section table ul ol dl td th html".split())
APART = set("head title nav header footer aside form script style noscript template iframe button select textarea svg canvas object menu dialog fieldset".split())
APART_WORDS = set(
    """ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies
    dialog disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo
    promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe
    subscription toolbar widget widgets alert alerts""".split()
)
PAGE_WORDS = set("site page global top main bottom".split())  # a header or footer of the page, not of a section
STATE_WORDS = set("has with without no is hide show".split())  # a name that tells of the page's layout
ARTICLE_APART = set("ad ads advert advertisement comment comments promo promoted related replies reply respond sponsored teaser".split())
APART_ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation note search".split())
ARTICLE = {"article", "main"}

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>\x00]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


@lru_cache(4096)
def _element(name: str, attributes: str) -> tuple[str, bool]:
    """The name of a container in paths, and whether it stands apart from an article."""
    a = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(attributes)}
    names = (a.get("class", "") + " " + a.get("id", "")).lower().split()
    parts = [[w for w in _NAME_PARTS.split(n) if w] for n in names]
    hidden = bool(_HIDDEN.search(attributes)) or a.get("aria-hidden") == "true"
    if name in ("html", "body"):
        apart = False
    elif name in ARTICLE:
        apart = hidden or any(w in ARTICLE_APART for p in parts for w in p)
    else:
        apart = hidden or name in APART or a.get("role", "").lower() in APART_ROLES or any(_names_apart(p) for p in parts)
    own = ".".join(filter(None, (re.sub(r"\d.*", "", n) for n in names)))  # numbers tell instances apart, not kinds
    return "!" * apart + name + ("." + own if own else ""), apart


def _names_apart(words: list[str]) -> bool:
    """Whether a class or id names something that is no part of an article."""
    if not words or words[0] in STATE_WORDS:
        return False
    said = APART_WORDS.intersection(words)
    if said <= {"header", "footer"}:
        return bool(said) and set(words) - said <= PAGE_WORDS
    return True


class Node:
    """A block ("e"), a text ("t") or a repeated group of several nodes ("g") of a page or a wrapper.

    key: what alignment compares. A text's `said` is the hash of the template text, or None for a slot; `pages` are hashes of
    up to LEAST_PAGES different pages that hold it, chars and linked the characters seen in it and those inside links.
    """

    __slots__ = ("apart", "chars", "items", "key", "kind", "linked", "optional", "pages", "repeats", "said", "text")

    def __init__(self, kind: str, key: str, items: list[Node] | None = None):
        self.kind, self.key, self.items = kind, key, items if items is not None else []
        self.optional = self.repeats = self.apart = False
        self.said: int | None = None
        self.pages: list[int] = []
        self.chars = self.linked = 0
        self.text = ""

    def dump(self) -> list:
        marks = self.optional + 2 * self.repeats + 4 * self.apart
        own = [self.said, self.pages, self.chars, self.linked] if self.kind == "t" else [x.dump() for x in self.items]
        return [self.kind, self.key, marks, own]

    @staticmethod
    def load(x: list) -> Node:
        node = Node(x[0], x[1])
        node.optional, node.repeats, node.apart = bool(x[2] & 1), bool(x[2] & 2), bool(x[2] & 4)
        if node.kind == "t":
            node.said, node.pages, node.chars, node.linked = x[3]
        else:
            node.items = [Node.load(y) for y in x[3]]
        return node


def read_page(page: str) -> Node:
    """The tree of a page: blocks by element and names, texts with their white space squeezed, empty texts left out."""
    root = Node("e", "")
    stack: list[tuple[str, Node]] = [("", root)]
    said: list[str] = []
    links = linked = 0

    def close_text() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            said.clear()
            if text:
                node = Node("t", "#")
                node.text, node.chars, node.linked = text, len(text), min(linked, len(text))
                node.apart = stack[-1][1].apart
                stack[-1][1].items.append(node)
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            said.append(text)
            if links:
                linked += len(text)

    def pop_to(names: tuple[str, ...], scope: bool) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if scope and stack[k][0] in SCOPE:
                return

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        if m.group(4) != ">":
            break  # the page ends inside a tag
        name = name.lower()
        if m.group(1):
            if name in INLINE:
                links = max(0, links - (name == "a"))
            elif name == "p" or name not in VOID:
                close_text()
                pop_to(("h1", "h2", "h3", "h4", "h5", "h6") if re.fullmatch("h[1-6]", name) else (name,), False)
            else:
                say(" ")
            continue
        if name in INLINE:
            links += name == "a"
            continue
        if name == "br" or name == "img":
            say(" ")
            continue
        close_text()
        if name in VOID:
            continue
        if name in RAW or name in RCDATA:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        if name in CLOSES_P:
            pop_to(("p",), True)
        elif name in SELF_CLOSING:
            pop_to(SELF_CLOSING[name], True)
        called, apart = _element(name, m.group(3))
        node = Node("e", called)
        node.apart = apart or stack[-1][1].apart
        if len(stack) <= DEEPEST:
            stack[-1][1].items.append(node)
        else:
            node = stack[-1][1]
        stack.append((name, node))
    close_text()
    return root


def texts_of(node: Node) -> Iterator[Node]:
    """The texts under a node in page order."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.kind == "t":
            yield x
        else:
            todo.extend(reversed(x.items))


def merge(a: Node, b: Node) -> Node:
    """The node that matches what either of two nodes of one key matches."""
    out = Node(a.kind, a.key)
    out.optional, out.repeats, out.apart = a.optional or b.optional, a.repeats or b.repeats, a.apart and b.apart
    if a.kind == "t":
        out.said = a.said if a.said == b.said else None
        out.pages = sorted({*a.pages, *b.pages})[:LEAST_PAGES]
        out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    else:
        out.items = align(a.items, b.items)
    return out


def fold_repeats(items: list[Node]) -> list[Node]:
    """items, in which adjacent runs of equal keys, the shortest period first, are one repeated node or group."""
    number: dict[str, int] = {}
    size = 1
    while 2 * size <= len(items):
        keys = np.array([number.setdefault(x.key, len(number)) for x in items])
        same = np.concatenate([[0], np.cumsum(keys[size:] == keys[:-size])])
        starts = np.flatnonzero(same[size:] - same[:-size] == size)
        if not len(starts):
            size += 1
            continue
        out, at = list(items[: starts[0]]), int(starts[0])
        run = items[at : at + size]
        at += size
        while [x.key for x in items[at : at + size]] == [x.key for x in run]:
            run = [merge(x, y) for x, y in zip(run, items[at : at + size], strict=True)]
            at += size
        node = run[0] if size == 1 else Node("g", "(" + " ".join(x.key for x in run) + ")", run)
        node.apart = all(x.apart for x in run)
        node.repeats = True
        items, size = [*out, node, *items[at:]], 1
    return items


def fold_tree(node: Node) -> Node:
    """The wrapper that one page makes by itself."""
    todo, order = [node], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(x.items)
    for x in reversed(order):
        if len(x.items) > 1:
            x.items = fold_repeats(x.items)
    return node


def _adopt_groups(items: list[Node], other: list[Node]) -> list[Node]:
    """items, where single occurrences of the other's groups are groups as well."""
    for group in sorted((x for x in other if x.kind == "g"), key=lambda x: -len(x.items)):
        keys = [x.key for x in group.items]
        out, i = [], 0
        while i < len(items):
            if [x.key for x in items[i : i + len(keys)]] == keys:
                node = Node("g", group.key, items[i : i + len(keys)])
                node.optional, node.apart = all(x.optional for x in node.items), all(x.apart for x in node.items)
                out.append(node)
                i += len(keys)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The nodes that match both sequences: what only one of them has becomes optional."""
    keys_a, keys_b = [x.key for x in a], [x.key for x in b]
    if keys_a == keys_b:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _adopt_groups(a, b), _adopt_groups(b, a)
    keys_a, keys_b = [x.key for x in a], [x.key for x in b]
    out: list[Node] = []
    for op, i, j, k, m in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            for x in [*a[i:j], *b[k:m]]:
                x.optional = True
                out.append(x)
    return fold_repeats(out)


def wrapper_of(page: str) -> Node:
    root = read_page(page)
    mark = crc32(page.encode("utf-8", "replace"))
    for x in texts_of(root):
        x.said, x.pages, x.text = crc32(x.text.encode("utf-8", "replace")), [mark], ""
    return fold_tree(root)


class Parser:
    """A wrapper compiled for reading pages."""

    def __init__(self, root: Node):
        self.root = root
        self.by_key: dict[int, tuple[list[tuple[int, Node]], dict[str, Node] | None]] = {}
        marks = sorted({p for x in texts_of(root) for p in x.pages})
        self.told = len(marks) >= LEAST_PAGES
        self.main, self.kept = self._article()

    def slot(self, x: Node) -> bool:
        """Whether a text of the wrapper is a slot: one that differs, or that too few pages hold to tell."""
        return x.said is None or len(x.pages) < LEAST_PAGES

    def _article(self) -> tuple[Node | None, set[int]]:
        """The block that holds the article, and its slots; (None, ...) if the wrapper doesn't tell."""
        if not self.told:
            return None, set()
        weight: dict[int, int] = {}

        def weigh(x: Node) -> int:
            own = 0
            if x.kind == "t":
                own = max(0, x.chars - x.linked) if self.slot(x) and not x.apart else 0
            else:
                own = sum([weigh(y) for y in x.items])
            weight[id(x)] = own
            return own

        at = self.root
        if not weigh(at):
            return None, set()
        while True:
            blocks = [y for x in at.items for y in (_leaves(x) if x.kind == "g" else [x]) if y.kind == "e"]
            best = max(blocks, key=lambda x: weight[id(x)], default=None)
            if best is None or weight[id(best)] <= DOMINANT * weight[id(at)] or best.repeats or not any(y.kind != "t" for y in best.items):
                break
            at = best
        return at, {id(x) for x in texts_of(at) if self.slot(x) and not x.apart}

    def _assign(self, kids: list[Node], node: Node) -> list[Node | None]:
        """For each child of a page's block the node of the wrapper's block that it matches."""
        if id(node) not in self.by_key:
            flat = [(k, y) for k, x in enumerate(node.items) for y in (_leaves(x) if x.kind == "g" else [x])]
            first = {y.key: y for _, y in reversed(flat)}
            self.by_key[id(node)] = flat, first if len(first) == len(flat) else None
        flat, first = self.by_key[id(node)]
        if first is not None:
            return [first.get(x.key) for x in kids]
        out: list[Node | None] = []
        at = 0
        for x in kids:
            hit = next((k for k in chain(range(at, len(flat)), range(at)) if flat[k][1].key == x.key), None)
            out.append(None if hit is None else flat[hit][1])
            if hit is not None:
                group = flat[hit][0]
                whole = node.items[group]
                if not whole.repeats and not flat[hit][1].repeats:
                    at = hit + 1
                elif whole.kind == "g" and (hit + 1 == len(flat) or flat[hit + 1][0] != group):
                    at = next(k for k, (g, _) in enumerate(flat) if g == group)
                else:
                    at = hit + (whole.kind == "g" and not flat[hit][1].repeats)
        return out

    def text(self, page: str) -> str:
        """The texts of the article's slots in page order, joined by one space.

        Where the wrapper doesn't tell, or the page has no such block: texts inside of article or main elements; without
        those, all texts outside of what stands apart that are not mostly links, nor template text.
        """
        inside: list[str] = []
        meant: list[str] = []
        rest: list[str] = []
        met = False
        todo: list[tuple[Node, Node | None, bool]] = [(read_page(page), self.root, False)]
        while todo:
            x, node, article = todo.pop()
            if x.kind == "t":
                if x.apart:
                    continue
                if node is not None and id(node) in self.kept:
                    inside.append(x.text)
                if article:
                    meant.append(x.text)
                elif 2 * x.linked < x.chars and (node is None or self.slot(node)):
                    rest.append(x.text)
                continue
            met = met or (node is not None and node is self.main)
            article = article or x.key.split(".")[0] in ARTICLE
            to = self._assign(x.items, node) if node is not None else [None] * len(x.items)
            todo.extend((y, z, article) for y, z in zip(reversed(x.items), reversed(to), strict=True))
        return " ".join(inside if met else meant or rest)


def _leaves(group: Node) -> Iterator[Node]:
    for x in group.items:
        if x.kind == "g":
            yield from _leaves(x)
        else:
            yield x


class Folder:
    """Wrappers of hosts, built up page by page; the oldest go out once there are more than MOST_HOSTS."""

    def __init__(self):
        self.held: dict[str, Node] = {}

    def add(self, host: str, node: Node) -> Iterator[tuple[str, str]]:
        self.held[host] = merge(self.held[host], node) if host in self.held else node
        if len(self.held) > MOST_HOSTS:
            oldest = next(iter(self.held))
            yield oldest, _dumped(self.held.pop(oldest))

    def rest(self) -> Iterator[tuple[str, str]]:
        for host, node in self.held.items():
            yield host, _dumped(node)
        self.held = {}


def _dumped(node: Node) -> str:
    return json.dumps(node.dump(), separators=(",", ":"), ensure_ascii=False)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty for a null URL or one without a host."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, wrapper (JSON): one row per host, folded over all its pages in tasks, then in parts, then as a whole.

    Null html is an empty page; pages of null or odd URLs form the host of the empty name; repeated rows add nothing; an
    empty table has no wrappers. Other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("page"))

    def pack(found: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        for host, wrapper in found:
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([wrapper], pa.string())], names=["host", "wrapper"])

    def over_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            for host, text in zip(batch.column(0), batch.column(1), strict=True):
                yield from pack(list(folder.add(host.as_py(), wrapper_of(text.as_py()))))
        yield from pack(list(folder.rest()))

    def over_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, last = Folder(), None
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if host != last:
                    yield from pack(list(folder.rest()))
                    last = host
                yield from pack(list(folder.add(host, Node.load(json.loads(text)))))
        yield from pack(list(folder.rest()))

    parts = rows.mapInArrow(tidy(over_pages), "host string, wrapper string")
    salted = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    some = salted.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").select("host", "wrapper").mapInArrow(tidy(over_wrappers), "host string, wrapper string")
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(tidy(over_wrappers), "host string, wrapper string")


def article_text(page: str, wrapper: str | None) -> str:
    """The main text of one page by a wrapper; without one, the page is its own."""
    return Parser(Node.load(json.loads(wrapper)) if wrapper else wrapper_of(page)).text(page)


def extract(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages (without the column `html`) plus `text`, the main text of each page by the wrapper of its host.

    Null html is empty and gives an empty text. Pages of null or odd URLs form one host. A host of fewer than LEAST_PAGES
    different pages is read by the meaning of its elements. Repeated rows give repeated results; an empty table an empty
    one. A column named like `text` is replaced; all others pass through, whatever their names.

    Wrappers within `broadcast_bytes` are broadcast and compiled once per task; beyond, a host's pages are dealt to SALTS
    groups that the wrapper goes ahead of.
    """
    spark = pages.sparkSession
    ship(spark)
    found = cut(infer(pages, url, page))
    size = found.agg(F.sum(F.octet_length("wrapper") + 100)).first()[0] or 0
    rest = [c for c in pages.columns if c.lower() not in (page.lower(), text.lower())]
    names = [f"c{i}" for i in range(len(rest))]
    body = F.coalesce(F.col(f"`{page}`").cast("string"), F.lit(""))
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], host_of(F.col(f"`{url}`")).alias("host"), body.alias("page"))
    schema = rows.select(*names, F.col("page").alias("text")).schema
    k = len(rest)

    def emit(batch: pa.RecordBatch, parsers: list[Parser]) -> pa.RecordBatch:
        out = [p.text(x.as_py()) for x, p in zip(batch.column(k + 1), parsers, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(out, pa.string())], names=[*names, "text"])

    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(dict(map(tuple, found.collect())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            @lru_cache(MOST_HOSTS)
            def parser(host: str) -> Parser:
                return Parser(Node.load(json.loads(shared.value[host])))

            for whole in batches:
                for a in range(0, whole.num_rows, 128):
                    batch = whole.slice(a, 128)
                    yield emit(batch, [parser(h) for h in batch.column(k).to_pylist()])

        out = rows.mapInArrow(tidy(run), schema)
    else:
        salt = F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")
        ahead = found.select(*[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names], "host", F.lit("").alias("page"), "wrapper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        work = rows.withColumn("wrapper", F.lit(None).cast("string")).withColumn("salt", salt).unionByName(ahead)
        work = work.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull())

        def run_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for whole in batches:
                for a in range(0, whole.num_rows, 128):
                    batch = whole.slice(a, 128)
                    wrappers = batch.column(k + 2).to_pylist()
                    keep, parsers = [], []
                    for i, w in enumerate(wrappers):
                        if w is not None:
                            now = Parser(Node.load(json.loads(w)))
                        else:
                            keep.append(i)
                            parsers.append(now)
                    if keep:
                        yield emit(batch.take(pa.array(keep)), parsers)

        out = work.mapInArrow(tidy(run_dealt), schema)
    return out.toDF(*rest, text)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; nulls, repeats and empty tables as in extract()."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The main texts of the test pages in DuckDB's SQL. It knows what inference has to find out: that every text stands in one
#: article element of paragraphs and a heading, with no more than three kinds of character references.
TEST_PAGES_SQL = r"""
with articles as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) x from pages),
bare as (select page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)(\s[^>]*)?>', ' ', 'g'), '<[^>]*(>|$)', '', 'g') x from articles),
decoded as (select page_id, url, regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') x from bare),
texts as (select page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) as text from decoded)
select page_id, url, text, length(text) n_chars from texts
"""
