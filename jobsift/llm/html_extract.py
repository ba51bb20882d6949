"""Operator 10: main text of web pages by site template removal.

Every page's element tree is walked twice. The first walk hashes the subtrees of its
containers (lists, tables, sections, generic blocks); Spark counts, per host, the distinct
pages that hold each hash: pages of one main text are one page, so a page's copies make
nothing of it a template. Subtrees on many pages of the host are the site's template. A
container whose text all lies in links has a second print: its place in the tree and its
tags and classes without the words, so that a menu recurs whatever it links to; it counts
from ``SKELETON_RATIO`` of a host's pages on, and never inside the main part. The second walk takes the article (or, without one, the body) and leaves out the template's
subtrees together with what the markup itself names as no article: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. A class or
id names such a part only where all its words do ("share-buttons", not "share-price").

Only containers outside plain text blocks count as template: paragraphs and headings of an
article may repeat on a host (copies, quotations) and are text all the same.

Counting groups by (host, hash) and is combined before the shuffle, so a host with a third
of all pages is no hot group. A host's list holds at most (containers a page) / ratio
hashes; it joins back on the host, by broadcast while Spark finds it small.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import keep, ship

RATIO = 0.1
SKELETON_RATIO = 0.5
MIN_PAGES = 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?=[/a-zA-Z!?])[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/\"'>]+)")
_TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg annotation annotation-xml".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
table tbody tfoot thead tr ul caption""".split())
CONTAINER = frozenset("address aside blockquote center details dialog dir div dl fieldset figure footer form header menu nav ol section table ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Elements that are never part of an article.
DROP = frozenset("nav footer aside form head button select datalist dialog menu object canvas audio video map search".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of a class or id that name such a part.
DROP_WORDS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar aside
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices cookie cookies
consent gdpr popup modal overlay newsletter subscribe subscription signup login form share sharing social related
recommended comment comments commentlist reply replies disqus respond pagination pager skip toolbar""".split())
# Words that a class or id may add to those.
PLAIN_WORDS = frozenset("""area bar block bottom box button buttons col column container content fixed float inline inner item items left link
links list main mobile outer panel post posts primary right row secondary section site slot sticky stories top unit widget
widgets wrap wrapper""".split())
# Headings of reader comments.
_COMMENTS = re.compile(r"(?:\(?\d+\)?\s*)?(?:(?:reader|user|leave a|post a|add a)\s+)?(?:comments?|reply|replies|kommentare|leserkommentare|commentaires|comentarios)(?:\s*\(?\d+\)?)?:?", re.I)
# What a start tag closes among the open elements, up to a container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article main body html div section ul ol dl table td th blockquote aside nav header footer form figure".split())


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value, bare in _ATTRIBUTE.findall(text):
        found.setdefault((name or bare).lower(), entities.unescape(value.strip("\"'")) if value else "")
    return found


def _dropped(name: str, attributes: str, holds: bool = False) -> bool:
    """Whether an element's name or attributes say that it is no part of an article.

    One that ``holds`` the page's article is never dropped for its name, class or id.
    """
    if name in DROP and not holds:
        return True
    if not _TELLING.search(attributes):
        return False
    if name in ("html", "body", "article", "main"):
        if not re.search("comment", attributes, re.I):
            return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if DROP_ROLES & set(found.get("role", "").lower().split()):
        return True
    names = [{w.lower() for w in _WORD.findall(x)} for x in f"{found.get('class', '')} {found.get('id', '')}".split()]
    if name in ("html", "body", "article", "main"):
        return name == "article" and any(x & {"comment", "comments", "reply"} for x in names)
    return not holds and any(x & DROP_WORDS and all(w in DROP_WORDS or w in PLAIN_WORDS or w.isdigit() for w in x) for x in names)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``("start", name, attributes)``, ``("end", name, "")`` and ``("text", "", text)``.

    Every start has its end, in order, however broken the markup is.
    """
    open_: list[str] = []
    at, size = 0, len(page)
    while at < size:
        tag = _TOKEN.search(page, at)
        if tag is None:
            yield "text", "", page[at:]
            break
        if tag.start() > at:
            yield "text", "", page[at : tag.start()]
        at = tag.end()
        if not tag[2] or not tag[4]:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name in open_:
                while True:
                    last = open_.pop()
                    yield "end", last, ""
                    if last == name:
                        break
            elif name in ("p", "br"):
                yield "start", name, ""
                yield "end", name, ""
            continue
        closing = CLOSES.get(name, ())
        if name in BLOCK:
            closing += ("p",)
        for i in range(len(open_) - 1, -1, -1):
            if open_[i] in closing:
                while len(open_) > i:
                    yield "end", open_.pop(), ""
                break
            if open_[i] in SCOPE:
                break
        if name in VOID or tag[3].endswith("/") and name in ("svg", "math"):
            yield "start", name, tag[3]
            yield "end", name, ""
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            yield "start", name, tag[3]
            yield "end", name, ""
        else:
            open_.append(name)
            yield "start", name, tag[3]
    while open_:
        yield "end", open_.pop(), ""


class _Open:
    __slots__ = ("name", "hash", "whole", "text", "path", "children", "shapes", "links", "words")

    def __init__(self, name: str, attributes: str, path: int):
        self.name, self.whole, self.text, self.path = name, name in CONTAINER, False, path
        self.children, self.shapes, self.links, self.words = 0, set(), 0, False
        self.hash = hashlib.blake2b(f"{name} {' '.join(attributes.split())}".encode("utf-8", "surrogatepass"), digest_size=8)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def walk(page: str | None) -> tuple[list[tuple[str, str, str]], dict[int, tuple[int, ...]]]:
    """The page's events, and for each container's start the hashes of its subtree.

    The first, even, is that of tags, attributes and words. A container with two links or more and
    no words outside links has a second, odd one, of its place and the kinds of its elements. A
    container that holds an article, a main part or a first heading has none.
    """
    seen, hashes, stack, starts = [], {}, [], []
    linked = 0
    for kind, name, value in events(page or ""):
        seen.append((kind, name, value))
        if kind == "start":
            path = 0
            if stack:
                stack[-1].children += 1
                path = zlib.crc32(f"{name} {stack[-1].children}".encode("utf-8", "surrogatepass"), stack[-1].path)
            stack.append(_Open(name, value, path))
            starts.append(len(seen) - 1)
            linked += name == "a"
            if name in ("article", "main", "h1"):
                for above in stack:
                    above.whole = False
        elif kind == "text":
            words = " ".join(value.split())
            if words and stack:
                stack[-1].hash.update(words.encode("utf-8", "surrogatepass"))
                stack[-1].text = True
                stack[-1].words |= not linked
        else:
            done, first = stack.pop(), starts.pop()
            digest = done.hash.digest()
            linked -= name == "a"
            done.links += name == "a"
            shape = None
            if not done.words:
                kept = _attributes(seen[first][2]).get("class", "") if seen[first][2] else ""
                shape = hashlib.blake2b(f"{name} {kept} {sorted(done.shapes)}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
            if done.whole and done.text:
                hashes[first] = (_number(digest) & ~1,)
                if shape and done.links > 1:
                    hashes[first] += (_number(hashlib.blake2b(shape + done.path.to_bytes(4, "little"), digest_size=8).digest()) | 1,)
            if stack:
                above = stack[-1]
                above.hash.update(digest)
                above.text |= done.text
                above.links += done.links
                above.words |= done.words
                if shape:
                    above.shapes.add(shape)
    return seen, hashes


def extract(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page, without subtrees whose hash is in ``template``."""
    return _main_text(*walk(page), template)


def _parts(seen: list[tuple[str, str, str]]) -> tuple[set[int], set[int], set[int]]:
    """Starts of the main parts, of the elements around them, and of reader comments known by their heading.

    The main part is the longest article or main element outside menus, sidebars, footers and
    parts named so. One inside such a part counts only where it is longer than all text
    outside of them. Articles beside the main part, of the same parent, belong to it. Without a main
    part, the elements around the first h1 are the holders. Nothing hidden is a candidate.
    """
    stack: list[list] = []        # start, name, hidden, aside, candidate, characters
    candidates: list[tuple[int, bool, int]] = []      # characters, aside, start
    headings: list[tuple[bool, int]] = []             # aside, start
    parent: dict[int, int] = {}
    comments: set[int] = set()
    title: list[str] = []
    outside = whole = titles = 0
    for i, (kind, name, value) in enumerate(seen):
        if kind == "start":
            off = bool(stack) and stack[-1][2] or bool(value.strip()) and _dropped(name, value, True)
            aside = bool(stack) and stack[-1][3] or name not in ("form", "head") and name not in ("article", "main") and _dropped(name, value)
            if stack:
                parent[i] = stack[-1][0]
            if name == "h1" and not off:
                headings.append((aside, i))
            if name in HEADING:
                titles += 1
                if titles == 1:
                    title.clear()
            stack.append([i, name, off, aside, name in ("article", "main") and not off and not _dropped(name, value), 0])
        elif kind == "end":
            done = stack.pop()
            if stack:
                stack[-1][5] += done[5]
            if done[4]:
                candidates.append((done[5], done[3], done[0]))
            if name in HEADING:
                titles -= 1
                if not titles and name != "h1" and _COMMENTS.fullmatch(" ".join(entities.unescape("".join(title)).split())):
                    around = next((x for x in reversed(stack) if x[1] not in ("header", "hgroup")), None)
                    if around and around[1] in ("section", "div") and around[5] + sum(x[5] for x in stack if x[0] > around[0]) == done[5]:
                        comments.add(around[0])
        else:
            n = len(value.strip())
            if titles:
                title.append(value)
            if stack:
                stack[-1][5] += n
            whole += n
            outside += n * (not stack or not (stack[-1][2] or stack[-1][3]))
    best = max((x for x in candidates if x[1] and x[0] > outside), key=lambda x: x[0], default=None)
    best = best or max((x for x in candidates if not x[1]), key=lambda x: x[0], default=None)
    heading = next((h for aside, h in headings if not aside), None)
    if heading is None and headings and whole - outside > outside:
        heading = headings[0][1]
    at = best[2] if best else parent.get(heading)
    holders: set[int] = set()
    while at is not None:
        holders.add(at)
        at = parent.get(at)
    mains = {x[2] for x in candidates if x[1] == best[1] and parent.get(x[2]) == parent.get(best[2])} if best else set()
    return mains, holders, comments - holders


def _main_text(seen: list[tuple[str, str, str]], hashes: dict[int, tuple[int, ...]], template: frozenset[int] | set[int] = frozenset()) -> str:
    mains, holders, comments = _parts(seen)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    depth = inside = out = heading = 0
    starts = []
    out_at = []      # depths at which something left out began
    for i, (kind, name, value) in enumerate(seen):
        if kind == "start":
            depth += 1
            starts.append(i)
            if i in mains and not out:
                inside += 1
            if name in HEADING:
                heading += 1
            named = name == "header" and i not in holders or i in comments or _dropped(name, value, i in holders)
            if name in ("article", "main"):
                named = _dropped(name, value)
            recurs = bool(template) and not template.isdisjoint(hashes.get(i, ())[: 1 if inside else 2])
            if recurs or named:
                out += 1
                out_at.append((depth, name == "header" and inside > 0 and not recurs))
            if name in BLOCK:
                flush()
            elif name in ("br", "td", "th", "img"):
                line.append(" ")
        elif kind == "end":
            start = starts.pop()
            if name in BLOCK:
                flush()
            elif name in ("td", "th"):
                line.append(" ")
            if name in HEADING:
                heading -= 1
            if out_at and out_at[-1][0] == depth:
                out_at.pop()
                out -= 1
            elif start in mains and not out and inside:
                inside -= 1
            depth -= 1
        elif (inside or not mains) and (not out or heading and all(x for _, x in out_at)):
            line.append(entities.unescape(value) if "&" in value else value)
    flush()
    return "\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, prints = [], []
        for page in batch.column(1).to_pylist():
            seen, hashes = walk(page)
            found.append(list({h for both in hashes.values() for h in both}))
            text = _main_text(seen, hashes).encode("utf-8", "surrogatepass")
            prints.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "print", "hashes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x, frozenset(t or ())) for x, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def templates(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, template``: hashes of the subtrees on more than ``ratio`` of a host's distinct pages.

    Odd hashes, those of skeletons, need more than ``SKELETON_RATIO`` where that is more.
    """
    walked = keep(pages.select("host", "html").mapInArrow(_subtrees, "host string, print long, hashes array<long>"), "subtrees").df
    total = walked.select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("host", "of")
    each = walked.select("host", "print", F.explode("hashes").alias("hash")).distinct()
    counts = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    bar = F.when(F.col("hash").bitwiseAND(F.lit(1)) == 1, max(ratio, SKELETON_RATIO)).otherwise(ratio)
    return (counts.join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("pages") > bar * F.col("total"))
            .groupBy("host").agg(F.collect_list("hash").alias("template")))


def extract_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of every row of ``pages(page_id, url, html, ...)``.

    Returns ``page_id, url, text, n_chars`` (code points), one row an input row, repeated
    rows and nulls in ids and urls included. Null and empty html, and pages without an
    article's text, give an empty text. The host is the url's, lower-cased, without port;
    urls without one form one host. Character references are decoded, white space inside a
    block becomes one space, blocks are trimmed and joined by one newline. Other columns
    are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)).alias("host"))
    found = keep(templates(rows, ratio, min_pages), "templates").df.withColumnRenamed("host", "of")
    joined = rows.join(found, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
