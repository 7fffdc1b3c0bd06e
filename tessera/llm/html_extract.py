"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: each start tag with the path of tags that it stands under, and each piece of
text with its path. Spark gathers, for every token of a host, its occurrence vector over the host's pages (how
often it occurs in each page) as a fingerprint; copies of a page count once. Tokens with one vector form an
equivalence class; a text counts if it is on at least half of the pages that have its element, and a class is
kept if it occurs in at least three pages and has at least three tokens. In a page a class is valid if
its tokens occur equally often and in the same order every time; valid classes nest, by the places they
span, into the template. What the template leaves are slots. Slots in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are dropped, and so is text that the template itself holds outside
the article; the text of the other slots, those of the article where the page marks one, is the main text.

A host with one or two pages has no template; its pages are read by their tags alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, frugal, map_texts, slices

LEAST_PAGES, LEAST_TOKENS = 3, 3
SCHEMA = "page_id long, url string, text string, n_chars long"

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CHROME = frozenset("nav footer aside form button select menu dialog head object svg canvas audio video iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that mark what is not the article, and those that mark the article.
CHROME_WORDS = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split())
HEADER_WORDS = frozenset("header site-header page-header topbar".split())
MAIN_WORDS = frozenset("articlebody".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+(?:-[a-z]+)*")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)|^//([^/?#:]*)")


class Token(NamedTuple):
    key: int
    path: int  # of the element that it stands in; of a start tag, its own
    text: str | None  # of a piece of text, as written
    block: int
    chrome: bool
    main: bool


class _Open(NamedTuple):
    name: str
    path: int
    chrome: bool
    main: bool


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return (found.group(1) or found.group(2) or "").lower() if found else ""


def _key(path: int, value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF)


def _marks(attributes: str) -> frozenset[str]:
    out = set()
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for word in (a or b or c).lower().split():
            out.add(word)
            out.update(re.split(r"[-_]", word))
    return frozenset(out)


def tokens(page: str) -> list[Token]:
    """The page's start tags and pieces of text in order."""
    out: list[Token] = []
    stack = [_Open("", 0, False, False)]
    open_names: Counter[str] = Counter()
    at, block, n = 0, 0, len(page)

    def pop(to: int) -> None:
        for e in stack[to:]:
            open_names[e.name] -= 1
        del stack[to:]

    def text(piece: str) -> None:
        if piece:
            top = stack[-1]
            out.append(Token(_key(top.path, " ".join(piece.split())), top.path, piece, block, top.chrome, top.main))

    while at < n:
        found = TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            closing, name, attributes = found.group(4), found.group(5), found.group(6)
            if name is None:
                continue  # a comment or declaration
            if not page.endswith(">", 0, at):
                continue  # cut off
        name = name.lower()
        if name in BLOCK:
            block += 1
        if closing:
            if open_names[name] > 0:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop(k)
            continue
        if name in BLOCK and open_names["p"] > 0:  # a block ends an open paragraph
            k = len(stack) - 1
            while k and stack[k].name in INLINE:
                k -= 1
            if stack[k].name == "p":
                pop(k)
        top, marks = stack[-1], _marks(attributes) if "=" in attributes else frozenset()
        path = _key(top.path, name + "." + ".".join(sorted(marks)))
        main = top.main or name in ("article", "main") or "main" in marks and "role" in attributes.lower() or bool(marks & MAIN_WORDS)
        chrome = top.chrome or name in CHROME or name not in ("html", "body", "article", "main") and bool(marks & CHROME_WORDS)
        if (name == "header" or name not in ("html", "body", "article", "main") and marks & HEADER_WORDS) and not main:
            chrome = True
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = n if not end else end.start()
            if end:
                close = page.find(">", at)
                at = n if close < 0 else close + 1
            continue
        out.append(Token(path, path, None, block, chrome, main))
        if name == "br":
            text(" ")
        if name not in VOID and not attributes.rstrip().endswith("/") or name not in VOID and name in BLOCK:
            stack.append(_Open(name, path, chrome, main))
            open_names[name] += 1
    return out


def valid_classes(sequence: list[int], classes: dict[int, int]) -> set[int]:
    """Of the host's classes (by token), those whose tokens occur here equally often, in the same order each time."""
    order: dict[int, list[int]] = defaultdict(list)
    for key in sequence:
        if key in classes:
            order[classes[key]].append(key)
    out = set()
    for number, own in order.items():
        width = len(set(own))
        if len(own) % width == 0 and own == own[:width] * (len(own) // width) and len(set(own[:width])) == width:
            out.add(number)
    return out


def nested(sequence: list[int], classes: dict[int, int], valid: set[int]) -> set[int]:
    """Of the valid classes, those that nest: of two whose spans cross, the one with fewer tokens goes."""
    spans: dict[int, list[int]] = {}
    for at, key in enumerate(sequence):
        number = classes.get(key)
        if number in valid:
            spans.setdefault(number, [at, at, 0])[1] = at
            spans[number][2] += 1
    # The ends of all spans by place; a kept span stands at both of its ends with the place of the other.
    places = {at: i for i, at in enumerate(sorted({at for low, high, _ in spans.values() for at in (low, high)}))}
    width = len(places)
    least, most = [width] * (2 * width), [-1] * (2 * width)
    out = set()
    for number, (low, high, _) in sorted(spans.items(), key=lambda x: (-x[1][2], x[0])):
        first, last = places[low], places[high]
        # Of the kept spans with an end strictly inside, the places of the other ends.
        i, j, before, behind = first + 1 + width, last + width, width, -1
        while i < j:
            if i & 1:
                before, behind, i = min(before, least[i]), max(behind, most[i]), i + 1
            if j & 1:
                j -= 1
                before, behind = min(before, least[j]), max(behind, most[j])
            i, j = i >> 1, j >> 1
        if before < first or behind > last:
            continue
        out.add(number)
        for at, other in ((first, last), (last, first)):
            at += width
            while at:
                least[at], most[at] = min(least[at], other), max(most[at], other)
                at >>= 1
    return out


def main_text(page: str, classes: dict[int, int]) -> str:
    """The text of the slots that are left, in blocks."""
    found = tokens(page)
    sequence = [t.key for t in found]
    template = nested(sequence, classes, valid_classes(sequence, classes)) if classes else set()
    has_main = any(t.main and not t.chrome and t.text is not None and t.text.strip() for t in found)
    blocks: dict[int, list[str]] = {}
    for t in found:
        if t.text is None:
            continue
        if t.chrome or has_main and not t.main:
            continue
        if not t.main and classes.get(t.key) in template:
            continue
        blocks.setdefault(t.block, []).append(t.text)
    breaks = {t.block for t in found}
    out = [" ".join(html.unescape("".join(blocks[b])).split()) for b in sorted(breaks) if b in blocks]
    return "\n\n".join(b for b in out if b)


def page_tokens(pages: DataFrame) -> DataFrame:
    """``host, token, path, first, second``: each distinct token of each distinct page of a host, with its path and two hashes of the page and its number there.

    Pages of a host with one content are one page. Token 0 stands for the page as a whole.
    """

    def pack(part: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list] = [[], [], [], []]
        seen = set()
        for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
            host, content = host_of(url), xxhash.xxh128((page or "").encode("utf-8", "surrogatepass"))
            name = (host, content.digest())
            if name in seen:
                continue
            seen.add(name)
            found = tokens(page or "")
            counts = Counter(t.key for t in found)
            at = {0: 0} | {key: i + 1 for i, key in enumerate(counts)}
            paths = {t.key: at[t.path] for t in found}
            keys = np.array([0, *counts], np.uint64)
            rest = np.array([[0, *(paths[k] for k in counts)], [1, *counts.values()]], np.uint32)
            half = content.intdigest()
            for column, value in zip(out, (host, (half >> 64) - (1 << 63), (half & ((1 << 64) - 1)) - (1 << 63), keys.tobytes() + rest.tobytes()), strict=True):
                column.append(value)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["host", "c1", "c2", "packed"])

    def unpack(batches):
        for part in slices(batches, "packed"):
            hosts, keys, paths, marks = [], [], [], []
            for host, c1, packed in zip(part.column("host").to_pylist(), part.column("c1").to_pylist(), part.column("packed").to_pylist(), strict=True):
                n = len(packed) // 16
                own = np.frombuffer(packed, np.uint64, n)
                rest = np.frombuffer(packed, np.uint32, 2 * n, 8 * n).reshape(2, n)
                hosts += [host] * n
                keys.append(own)
                paths.append(own[rest[0]])
                numbers, inverse = np.unique(rest[1], return_inverse=True)
                marks.append(np.array([xxhash.xxh64_intdigest(f"{c1} {k}") for k in numbers], np.uint64)[inverse])
            key, path, mark = (np.concatenate(x) for x in (keys, paths, marks))
            shifted = [(x ^ np.uint64(1 << 63)).view(np.int64) for x in (key, path)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts), *map(pa.array, shifted), pa.array((mark & np.uint64(0x7FFFFFFF)).astype(np.int64)), pa.array((mark >> np.uint64(33)).astype(np.int64))], ["host", "token", "path", "first", "second"])

    packed = map_texts(pages, pack, "host string, c1 long, c2 long, packed binary", "html")
    return packed.dropDuplicates(["host", "c1", "c2"]).mapInArrow(frugal(unpack), "host string, token long, path long, first long, second long")


def templates(pages: DataFrame) -> DataFrame:
    """``host, tokens, numbers``: the classes of each host that has enough pages.

    A layout is told by the paths of its elements: a text is supported by at least half of the pages that have
    its element, however few of the host's pages these are.
    """
    vectors = page_tokens(pages).groupBy("host", "token").agg(F.first("path").alias("path"), F.sum("first").alias("v1"), F.sum("second").alias("v2"), F.count(F.lit(1)).alias("pages"))
    vectors = cut(vectors.where(F.col("pages") >= LEAST_PAGES))
    layouts = vectors.where(F.col("token") == F.col("path")).select("host", "path", F.col("pages").alias("of"))
    often = vectors.where(F.col("token") != -(1 << 63)).join(layouts, ["host", "path"]).where(2 * F.col("pages") >= F.col("of"))
    classes = often.groupBy("host", "v1", "v2", "pages").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    return classes.groupBy("host").agg(F.collect_list(F.struct("tokens")).alias("classes"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row for each row of ``pages`` (``page_id, url, html``).

    Null html is empty and gives an empty text; a null url is a host of its own. Repeated rows give a row
    each; an empty table gives none.
    """
    picked = pages.select("page_id", "url", "html")
    found = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)|^//([^/?#:]*)", 0)
    bare = F.regexp_replace(F.regexp_replace(found, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//", ""), r"^[^/?#@]*@", "")
    joined = picked.withColumn("host", F.lower(bare)).join(templates(picked), "host", "left")

    def run(batches):
        for part in slices(batches, "html"):
            texts = []
            for page, classes in zip(part.column("html").to_pylist(), part.column("classes").to_pylist(), strict=True):
                numbers = {t + (1 << 63): i for i, c in enumerate(classes or []) for t in c["tokens"]}
                texts.append(main_text(page or "", numbers))
            yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "classes").mapInArrow(frugal(run), SCHEMA)
