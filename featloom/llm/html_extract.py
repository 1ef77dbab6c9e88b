"""Main text of pages by equivalence classes of template tokens.

Each page is cut once into tokens in context: block tags with the path of block tags around them, and whole text blocks
with theirs. Over the pages of a host each token has an occurrence vector (how often each page has it); tokens of equal
vectors are an equivalence class. Vectors are never built: a class is known by sums of hashes of (page, count), which
combine in any order, so that a host of any size is summed up in parts.

A class is valid if on all its pages its tokens come in the same order, again and again, and lie inside the same gap
between tokens of the same other class, none crossing (`walk`). Valid classes thus nest into the host's template, and the
gaps are its slots. Text that belongs to the template is the site's; slots of menus (links on several pages, and not the
host's largest) go as a whole; what the tags around a block, and whole tokens of class, id or role say decides about the
rest, with the template's word where these are vague. All other text is extracted, in whatever slots it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_side, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|select|textarea|title|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?](?:[^>])*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open blocks that the start of another closes.
CLOSES = {"p": {"p"}, "li": {"p", "li"}, "dd": {"p", "dd", "dt"}, "dt": {"p", "dd", "dt"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
#: Blocks that aren't the article's, by tag and by whole tokens of class, id or role; the latter not where they hold the
#: article, nor on blocks of running text. What VAGUE names counts inside a landmark only if the template has the block.
OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
CLEAR = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comment-list commentlist comments comments-area consent cookie cookies disqus_thread footer login menu modal "
    "nav navbar navigation newsletter popup replies respond reviews sidebar signup sponsored subscribe toolbar user-reviews".split()
)
VAGUE = frozenset("banner notice notification promo related share sharing social sponsor".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr dt dd figcaption caption legend summary".split())
#: Share of its host's pages that a class spans at least, and so many tokens where it spans less than the share COMMON.
FREQUENT, SIZE, COMMON = 0.2, 3, 0.5
#: Pages a text is on at least to be the site's, and to be so inside a landmark.
TWICE, THRICE = 2, 3
#: Share of the text above which classes are taken for copies of one article, not for a template.
COPIED = 0.5
#: Share of a slot's text that is links where it is a menu.
LINKED = 0.9


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # of open blocks, outermost first
    nodes: tuple[int, ...]  # the same as numbers of elements
    linked: int  # code points inside links
    after: int  # elements begun before it


@dataclass
class Page:
    """Blocks in page order; by number the path of every block element; elements outside the article; vaguely marked
    elements inside a landmark; landmarks."""

    blocks: list[Block]
    paths: list[tuple[str, ...]]
    outside: set[int]
    vague: set[int]
    landmarks: set[int]

    def out(self, b: Block) -> bool:
        return bool(b.nodes) and b.nodes[-1] in self.outside


def _label(name: str, attributes: str) -> tuple[str, int]:
    """The tag with its class, id and role; and whether a token of these says clearly (2) or vaguely (1) that it is outside
    the article."""
    named = " ".join(x.strip("\"'") for x in NAMED.findall(attributes)).lower()
    words = named.split()
    mark = 0 if name in RUNNING else 2 if not CLEAR.isdisjoint(words) else 1 if not VAGUE.isdisjoint(words) else 0
    return (f"{name}[{named}]" if named else name), mark


def parse(html: str) -> Page:
    """A mark doesn't hold for html, body, main and article, nor for an element with one of the latter two inside, nor for
    one with more than half of the text that isn't outside by its tags, unless the page has landmarks with text and it
    lies in none of them."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    paths: list[tuple[str, ...]] = []
    parents: list[int] = []  # -1 for none
    off: set[int] = set()  # by tag
    marks: dict[int, int] = {}
    landmarks: set[int] = set()
    holding: set[int] = set()  # landmarks and what they lie in
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                blocks.append(Block(joined, tuple(x[1] for x in stack), tuple(x[2] for x in stack), min(linked, len(joined)), len(paths)))
            text.clear()
        linked = 0

    def pop(upto: int) -> None:
        del stack[upto:]

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name == "a":
            links = 0 if closing else 1
        if name == "br" or name == "hr":
            flush()
        if name not in BLOCKS or name in VOID:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        links = 0
        if name in CLOSES:
            while stack and stack[-1][0] in CLOSES[name]:
                pop(len(stack) - 1)
        elif stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        label, mark = _label(name, attributes)
        node = len(paths)
        parents.append(stack[-1][2] if stack else -1)
        if name in OUTSIDE or parents[-1] in off or name == "header" and not any(x[0] in ("article", "main") for x in stack):
            off.add(node)
        stack.append((name, label, node))
        paths.append(tuple(x[1] for x in stack))
        if mark:
            marks[node] = mark
        if name in ("html", "body"):
            holding.add(node)
        elif name in ("article", "main") or "role" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes, re.IGNORECASE):
            landmarks.add(node)
            holding.update(x[2] for x in stack)
    if at < len(html):
        text.append(html[at:])
    flush()
    marked = set(marks) - holding
    if marked:
        sizes, total, within, article = dict.fromkeys(marked, 0), 0, set(), False
        for b in blocks:
            if not b.nodes or b.nodes[-1] not in off:
                total += len(b.text)
                main = next((k for k, node in enumerate(b.nodes) if node in landmarks), len(b.nodes))
                article = article or main < len(b.nodes)
                within.update(marked.intersection(b.nodes[main:]))
                for node in marked.intersection(b.nodes):
                    sizes[node] += len(b.text)
        marked = {x for x, n in sizes.items() if 2 * n <= total or article and x not in within}
    outside: set[int] = set()
    inside: set[int] = set()  # landmarks
    vague: set[int] = set()
    for node, parent in enumerate(parents):
        if node in landmarks or parent in inside:
            inside.add(node)
        if node in off or parent in outside or node in marked and (marks[node] == 2 or node not in inside):
            outside.add(node)
        elif parent in vague or node in marked:
            vague.add(node)
    return Page(blocks, paths, outside, vague, inside)


def token(kind: str, path: tuple[str, ...], text: str = "") -> int:
    return int.from_bytes(blake2b("\x00".join([kind, *path, text]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _key(numbers) -> int:
    return int.from_bytes(blake2b(b"".join(x.to_bytes(8, "little", signed=True) for x in numbers), digest_size=8).digest(), "little", signed=True) or 1


PAGE = 0  # the token that every page with text has once
FREE, OUT, MAYBE = 0, 1, 2


@dataclass
class Cut:
    """A page's tokens in page order (blk: which block, -1 for tags), and of its blocks the texts, whether they are outside
    (OUT) or that is for the template to say (MAYBE, of the element whose token is vague), and code points in links."""

    tok: list[int]
    blk: list[int]
    texts: list[str]
    flag: list[int]
    vague: list[int]
    linked: list[int]
    inside: list[int]  # 1 for tokens inside a landmark


def cut_page(html: str) -> Cut:
    page = parse(html)
    names = [token("tag", path) for path in page.paths]
    out = Cut([], [], [], [], [], [], [])
    node = 0

    def tags(upto: int) -> None:
        nonlocal node
        while node < upto:
            out.tok.append(names[node])
            out.blk.append(-1)
            out.inside.append(int(node in page.landmarks))
            node += 1

    for i, b in enumerate(page.blocks):
        tags(b.after)
        out.tok.append(token("text", b.path, b.text))
        out.blk.append(i)
        out.inside.append(int(bool(b.nodes) and b.nodes[-1] in page.landmarks))
        maybe = next((x for x in b.nodes if x in page.vague), -1)
        out.texts.append(b.text)
        out.flag.append(OUT if page.out(b) else MAYBE if maybe >= 0 else FREE)
        out.vague.append(names[maybe] if maybe >= 0 else 0)
        out.linked.append(b.linked)
    tags(len(names))
    return out


def walk(tok: list[int], of: dict[int, int]) -> tuple[dict[int, tuple[int, int, int]], list[tuple[int, int]]]:
    """Of a page's tokens, the classes of which are given: for each class (order, parent, gap), a hash of its tokens in
    order and the gap of the class it lies in, or 0s if it has no order, crosses another or lies in several gaps; and for
    each token the slot it lies in, as class and gap (0, 0 outside of all)."""
    places: dict[int, list[int]] = {}
    for t in tok:
        if t in of:
            places.setdefault(of[t], []).append(t)
    index: dict[int, int] = {}
    found: dict[int, tuple[int, int, int]] = {}
    size: dict[int, int] = {}
    for c, ts in places.items():
        first = list(dict.fromkeys(ts))
        k = size[c] = len(first)
        if len(ts) % k or any(t != first[i % k] for i, t in enumerate(ts)):
            found[c] = (0, 0, 0)
        else:
            index.update((t, i) for i, t in enumerate(first))
            found[c] = (_key(first), -1, -1)
    stack: list[list[int]] = []  # class, gap

    def lies(c: int) -> None:
        parent, gap = stack[-1] if stack else (0, 0)
        order, p, g = found[c]
        if order:
            found[c] = (order, parent, gap) if g in (-1, gap) and p in (-1, parent) else (0, 0, 0)

    slots = []
    for t in tok:
        c = of.get(t)
        if c is not None and found[c][0]:
            if size[c] == 1:
                lies(c)
            else:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
                if at is not None:
                    for other, gap in stack[at + 1 :]:
                        if gap < size[other]:  # not at its end
                            found[other] = (0, 0, 0)
                    del stack[at + 1 :]
                    if index[t] == 0:
                        stack.pop()
                        lies(c)
                        stack.append([c, 1])
                    else:
                        stack[at][1] = index[t] + 1
                elif index[t] == 0:
                    lies(c)
                    stack.append([c, 1])
        slots.append((stack[-1][0], stack[-1][1]) if stack else (0, 0))
    return found, slots


def _host(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _batched(rows: DataFrame, kinds: str, types: list[pa.DataType], columns: list[str], of) -> DataFrame:
    """Rows (tuples) that of makes of each row's columns, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                b = batch.slice(part, 200)
                out = [x for row in zip(*(b.column(c).to_pylist() for c in columns)) for x in of(*row)]
                cols = list(zip(*out)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in kinds.split(", ")])

    return rows.select(*columns).mapInArrow(run, kinds)


def cut_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (hash), the columns of Cut, and of its distinct tokens ut the counts un, code points of
    text um, and whether they are inside a landmark ui; ut is empty for pages without text, which say nothing about a host."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", _host(F.col("url"))).withColumn("page", F.xxhash64("page_id", "url", "html"))
    longs, ints, texts = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())

    def of(page_id, url, host, page, html):
        x = cut_page(html)
        distinct: dict[int, list[int]] = {PAGE: [1, 0, 0]} if x.texts else {}
        if x.texts:
            for t, i, inside in zip(x.tok, x.blk, x.inside):
                u = distinct.setdefault(t, [0, 0, inside])
                u[0] += 1
                u[1] += len(x.texts[i]) if i >= 0 else 0
        u = list(distinct.values())
        yield page_id, url, host, page, x.tok, x.blk, x.texts, x.flag, x.vague, x.linked, list(distinct), [y[0] for y in u], [y[1] for y in u], [y[2] for y in u]

    kinds = "page_id long, url string, host string, page long, tok array<long>, blk array<int>, texts array<string>, flag array<int>, vague array<long>, linked array<int>, ut array<long>, un array<int>, um array<int>, ui array<int>"
    return _batched(rows, kinds, [pa.int64(), pa.string(), pa.string(), pa.int64(), longs, ints, texts, ints, longs, ints, longs, ints, ints, ints], ["page_id", "url", "host", "page", "html"], of)


def classes(pages: DataFrame) -> DataFrame:
    """host, token, cls, pages, p (of the host), mass, inside: the equivalence classes of hosts' tokens, of pages that are
    cut. cls stands for the occurrence vector."""
    rows = pages.where("host <> ''").select("host", "page", F.explode(F.arrays_zip("ut", "un", "um", "ui")).alias("u"))
    part = lambda seed: F.sum(F.pmod(F.xxhash64("page", "u.un", F.lit(seed)), F.lit(1 << 31))).alias(f"v{seed}")
    seen = rows.groupBy("host", F.col("u.ut").alias("token")).agg(F.count(F.lit(1)).alias("pages"), part(1), part(2), F.sum("u.um").alias("mass"), F.max("u.ui").alias("inside"))
    seen = seen.select("host", "token", F.xxhash64("pages", "v1", "v2").alias("cls"), "pages", "mass", "inside")
    whole = seen.where(F.col("token") == PAGE).select("host", F.col("pages").alias("p"))
    return seen.join(whole, "host")


def templates(pages: DataFrame) -> DataFrame:
    """host, entries array<struct<token, cls, pages, site>> (tokens of valid classes; site: text that is the site's), menus
    array<struct<cls, gap>> (slots that are left out), of pages that are cut.

    Kept are classes on at least the share FREQUENT of the host's pages, of at least SIZE tokens where they are on less
    than COMMON, that have one order and lie in one gap on all pages. Their text is the site's if it is on TWICE pages
    (inside a landmark THRICE and COMMON), unless copies of an article explain it: a class with more than the share COPIED of
    the host's text on its pages, or together with those at least as frequent, isn't template. A host of one page has a
    template of tags only, by the same rules."""
    # few tokens of a host are so frequent: some times those of one page at most
    seen = cut(classes(pages).where((F.col("pages") >= F.lit(FREQUENT) * F.col("p")) & (F.col("token") != PAGE) & ((F.col("mass") == 0) | (F.col("pages") >= TWICE))))
    known = small_side(cut(seen.groupBy("host").agg(F.collect_list(F.struct("token", "cls")).alias("of"))))
    kinds = "host string, cls long, gap int, kind int, a long, b long, mass long, linked long"
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def of(host, tok, blk, texts, flag, linked, of):
        found, slots = walk(tok, {x["token"]: x["cls"] for x in of})
        for c, (order, parent, gap) in found.items():
            yield host, c, 0, 0, order, _key((parent, gap)), 0, 0
        sums: dict[tuple[int, int], list[int]] = {}
        for i, slot in zip(blk, slots):
            if i >= 0 and flag[i] != OUT:
                x = sums.setdefault(slot, [0, 0])
                x[0] += len(texts[i])
                x[1] += linked[i]
        for (c, gap), (mass, links) in sums.items():
            yield host, c, gap, 1, 0, 0, mass, links

    told = _batched(pages.where("size(ut) > 0").join(known, "host"), kinds, types, ["host", "tok", "blk", "texts", "flag", "linked", "of"], of)
    told = cut(told.groupBy("host", "cls", "gap", "kind").agg(*[f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("min", F.min), ("max", F.max))], F.sum("mass").alias("mass"), F.sum("linked").alias("linked"), F.count(F.lit(1)).alias("pages")))
    valid = told.where("kind = 0 and min_a = max_a and min_b = max_b and min_a <> 0").select("host", "cls")
    rows = seen.join(valid, ["host", "cls"])
    total = seen.groupBy("host").agg(F.lit(0).alias("z")).select("host").join(pages.where("host <> ''").groupBy("host").agg(F.sum(F.aggregate("um", F.lit(0).cast("long"), lambda n, x: n + x)).alias("all")), "host")
    grouped = rows.groupBy("host", "cls").agg(F.first("pages").alias("pages"), F.first("p").alias("p"), F.count(F.lit(1)).alias("size"), F.sum("mass").alias("m")).join(total, "host")
    frequent = grouped.where((F.col("size") >= SIZE) | (F.col("pages") >= F.lit(COMMON) * F.col("p")))
    outer = Window.partitionBy("host").orderBy(F.col("pages").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("m") <= F.lit(COPIED) * F.col("all") * F.col("pages") / F.col("p")
    frequent = frequent.withColumn("original", own & (F.sum(F.when(own, F.col("m")).otherwise(0)).over(outer) <= F.lit(COPIED) * F.col("all")))
    rows = rows.join(frequent.select("host", "cls", "original"), ["host", "cls"])
    enough = (F.col("inside") == 0) | ((F.col("pages") >= THRICE) & (F.col("pages") >= F.lit(COMMON) * F.col("p")))
    site = (F.col("mass") > 0) & F.col("original") & enough
    entries = rows.groupBy("host").agg(F.collect_list(F.struct("token", "cls", "pages", site.alias("site"))).alias("entries"))
    slots = told.where("kind = 1")
    largest = slots.groupBy("host").agg(F.max("mass").alias("most"))
    menus = slots.where((F.col("pages") >= TWICE) & (F.col("linked") >= F.lit(LINKED) * F.col("mass"))).join(largest, "host").where("mass < most")
    return entries.join(menus.groupBy("host").agg(F.collect_list(F.struct("cls", "gap")).alias("menus")), "host", "left")


def slots_text(x: Cut, entries: list, menus: list) -> str:
    """The blocks of the page that are neither the site's, nor in a menu's slot, nor outside the article, joined by line feeds."""
    _, slots = walk(x.tok, {e["token"]: e["cls"] for e in entries})
    site = {e["token"] for e in entries if e["site"]}
    often = {e["token"] for e in entries if e["pages"] >= TWICE}
    left_out = {(m["cls"], m["gap"]) for m in menus}
    out = []
    for t, i, slot in zip(x.tok, x.blk, slots):
        if i >= 0 and t not in site and x.flag[i] != OUT and not (x.flag[i] == MAYBE and x.vague[i] in often) and slot not in left_out:
            out.append(x.texts[i])
    return "\n".join(out)


def main_text(html: str) -> str:
    """The text of a page of which no other of its host is known."""
    return slots_text(cut_page(html), [], [])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text).

    Null and empty html, and pages of nothing but menus and the like, have an empty text. A null or odd url belongs to
    no host and its page is taken for itself; null ids stay and repeated rows give repeated results (and count as pages);
    an empty table gives no rows; other columns, whatever their names, go. Decoded references follow HTML 5; white space of
    any kind becomes one space; a line break ends a block. Pages are parsed once and kept, cut into tokens, in the shared
    folder. The host's template goes to the pages by a broadcast where its table is small, else by a join on the host, whose
    large partitions Spark splits."""
    held = stored(cut_pages(pages))
    found = small_side(cut(templates(held)))

    def of(page_id, url, tok, blk, texts, flag, vague, linked, entries, menus):
        text = slots_text(Cut(tok, blk, texts, flag, vague, linked, []), entries or [], menus or [])
        yield page_id, url, text, len(text)

    columns = ["page_id", "url", "tok", "blk", "texts", "flag", "vague", "linked", "entries", "menus"]
    return _batched(held.join(found, "host", "left"), "page_id long, url string, text string, n_chars long", [pa.int64(), pa.string(), pa.string(), pa.int64()], columns, of)
