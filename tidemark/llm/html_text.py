"""Main text of web pages, with site templates removed.

Every element subtree is hashed: its tag, class, id and role, its own text and its
children's hashes. It stands in a slot of its host: the path of tags and names
that leads to it, with its number among like siblings. Spark counts in how many
different surroundings and under how many URLs each subtree recurs in its slot, and
how much of the slot recurring subtrees fill. Subtrees recurring three times, however
many pages the host has, in a slot mostly filled by such, are the site's template
and are deleted; a quoted passage or a copied article recurs in a slot that holds
other text on most pages, and stays. Within a declared article prose goes only if it
has a class or id or consists of links, since near copies of a whole article recur in place too.

What remains of the page's article, less what tags and roles mark as menus, notices,
adverts, forms or comments, is its text. Class names count beside other evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import in_slices
from tidemark.runtime import stage

MIN_PAGES = 3
# Template hashes of all hosts together, of 8 bytes each, up to which they are broadcast.
BROADCAST_HASHES = 2_000_000
SALTS = 32  # parts of a template's pages in the join

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
FOREIGN = frozenset(["svg", "math"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
# Names of these say little: they hold text in any article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd table thead tbody tfoot tr td th caption "
                  "figure figcaption b i em strong code a span cite q sub sup small mark abbr time kbd var".split())
DROPPED = RAW | frozenset(
    "head nav header footer aside form button select input label menu dialog object canvas audio video "
    "map search fieldset datalist svg annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted "
    "promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar pagination pager "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search "
    "comment comments discussion disqus replies respond widget widgets skip teaser".split())
# Words that change nothing beside a mark: cookie-notice-box, related-posts.
NEUTRAL = frozenset("area bar block box button buttons container content form icons inner item items left link links list "
                    "outer panel posts right row section slot stories top unit wrap wrapper".split())
# Inside an article these hold its title.
TITLES = frozenset(["header", "masthead"])
# An open element of the key is closed by a start tag of the values.
CLOSED_BY = {
    "p": BLOCKS - frozenset(["body", "html"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]), "thead": frozenset(["tbody", "tfoot"]),
    "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]),
}
CLOSES = {tag: [k for k, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
# An implied end does not reach beyond these.
SCOPE = frozenset("html body article main section div table td th ul ol dl aside nav header footer form blockquote".split())
_KINDS = {tag: [kind for kind, tags in (("#block", BLOCKS), ("#scope", SCOPE), ("#foreign", FOREIGN)) if tag in tags]
          for tag in BLOCKS | SCOPE | FOREIGN}

_START = re.compile(r"[a-zA-Z][^\s/>]*")
# Quotes inside a name or an unquoted value are part of it; a quote that is never closed as well.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_REST = re.compile(r"[\s/]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element: `parts` holds texts and child elements in order.

    `size` and `links` are the characters of its texts and those in links.
    """

    __slots__ = ("tag", "marks", "parts", "hash", "slot", "size", "links")

    def __init__(self, tag: str, marks: tuple[tuple[str, str], ...]):
        self.tag, self.marks, self.parts = tag, marks, []
        self.hash = self.slot = self.size = self.links = 0


class _Open:
    """The open elements, with the places of each tag, of blocks, of scopes and of foreign roots."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        for key in (node.tag, *_KINDS.get(node.tag, ())):
            self.places.setdefault(key, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, key: str) -> int:
        found = self.places.get(key)
        return found[-1] if found else 0

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            for key in (tag, *_KINDS.get(tag, ())):
                self.places[key].pop()


def _attributes(page: str, at: int) -> tuple[tuple[tuple[str, str], ...], bool, int]:
    """The attributes that matter, whether the tag closes itself, and the place after it (-1: the page ends)."""
    marks = {}
    while True:
        if page[at:at + 1] == ">":
            return tuple(marks.items()), False, at + 1
        rest = _REST.match(page, at).end()
        if page[rest:rest + 1] == ">":
            return tuple(marks.items()), page[rest - 1] == "/", rest + 1
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            return (), False, -1
        name = m[1].lower()
        if name in ("class", "id", "role", "aria-hidden", "hidden"):
            marks.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()


def parse(page: str) -> Node:
    """Element tree of a page, in time linear in its length.

    Unclosed and stray tags are tolerated, a cut tag at the end is dropped. The end
    tag of an inline element closes no block.
    """
    root = Node("#page", ())
    open_ = _Open(root)
    stack = open_.stack
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            stack[-1].parts.append(page[at:])
            break
        follows = page[start + 1:start + 2]
        begins = _START.match(page, start + 1 + (follows == "/"))
        if begins is None and follows not in ("!", "?", "/", ""):
            stack[-1].parts.append(page[at:start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].parts.append(page[at:start])
        if begins is None:
            if page.startswith("<!--", start):
                short = 5 if page.startswith("<!-->", start) else 6 if page.startswith("<!--->", start) else 0
                end = None if short else _COMMENT_END.search(page, start + 4)
                at = start + short if short else end.end() if end else size
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                stack[-1].parts.append(page[start + 9:end if end >= 0 else size].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        tag = begins[0].lower()
        at = begins.end()
        marks, closed, at = ((), False, at + 1) if page[at:at + 1] == ">" else _attributes(page, at)
        if at < 0:
            break
        if follows == "/":
            place = open_.last(tag)
            if place and (tag in BLOCKS or tag in FOREIGN or place > open_.last("#block")):
                open_.cut(place)
            continue
        if tag == "form" and open_.last("form"):
            continue
        foreign = open_.last("#foreign")
        if foreign and tag in BLOCKS and stack[-1].tag not in ("foreignobject", "annotation-xml"):
            if foreign > open_.last("#block"):
                open_.cut(foreign)
                foreign = open_.last("#foreign")
        closes = CLOSES.get(tag, ())
        while closes:
            scope = open_.last("#scope")
            place = max(map(open_.last, closes))
            if not place or place < scope:
                break
            open_.cut(place)
        node = Node(tag, marks)
        stack[-1].parts.append(node)
        if tag in RAW and not foreign:
            end = _RAW_END[tag].search(page, at)
            node.parts.append(page[at:end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not (closed and (foreign or tag in FOREIGN)):
            open_.push(node)
    return root


def _walk(root: Node) -> Iterator[Node]:
    """All elements, parents first, without recursion."""
    work = [root]
    while work:
        node = work.pop()
        yield node
        work.extend(p for p in reversed(node.parts) if isinstance(p, Node))


def _signed(h: xxhash.xxh64) -> int:
    return h.intdigest() - (1 << 63)


def hash_subtrees(root: Node) -> list[Node]:
    """Set hash, slot, size and links of every element; returns the elements, parents first."""
    nodes = list(_walk(root))
    for node in nodes:
        like: dict[str, int] = {}
        for part in node.parts:
            if isinstance(part, Node):
                name = f"{part.tag} {_DIGITS.sub('', repr(part.marks))}" if part.marks else part.tag
                number = like.get(name, 0)
                like[name] = number + 1
                part.slot = _signed(xxhash.xxh64(f"{node.slot} {name} {number}"))
    for node in reversed(nodes):
        h = xxhash.xxh64(f"{node.tag} {node.marks}")
        raw = node.tag in RAW
        for part in node.parts:
            if isinstance(part, Node):
                h.update(part.hash.to_bytes(8, "little", signed=True))
                node.size += part.size
                node.links += part.links
            else:
                text = " ".join(part.split())
                h.update(text)
                node.size += 0 if raw else len(text)
            h.update(b"\0")
        if node.tag == "a":
            node.links = node.size
        node.hash = _signed(h)
    return nodes


def _removed(node: Node, page: Node) -> bool:
    """Whether tag or role say that the element is not content, wherever it stands.

    A form around half of the page's text, with paragraphs or headings in it, is a wrapper of the page.
    """
    if node.tag == "form":
        return 2 * node.size < page.size or not any(
            n.tag in ("article", "main", "p", "h1", "h2", "h3") for n in _walk(node))
    if node.tag in DROPPED and node.tag != "header":
        return True
    return any(name == "role" and value.strip().lower() in ROLES or name == "hidden"
               or name == "aria-hidden" and value.strip().lower() == "true" for name, value in node.marks)


def _named(node: Node, inside: bool) -> bool:
    """Whether class or id mark the element as foreign to the article.

    Inside an article, and of prose, a name must say nothing else, or links must fill half of the element.
    """
    prose = node.tag in PROSE
    for name, value in node.marks:
        if name not in ("class", "id"):
            continue
        for word in value.split():
            names = _NAME.findall(_CAMEL.sub(" ", word).lower())
            pairs = [a + b for a, b in zip(names, names[1:], strict=False)]  # side-bar, sideBar
            marked = {n for n in names + pairs if n in MARKS and not (inside and n in TITLES)}
            if not marked:
                continue
            if not inside and not prose:
                return True
            known = [n in marked or n in NEUTRAL for n in names]
            known = [k or any(p in marked for p in pairs[max(i - 1, 0):i + 1]) for i, k in enumerate(known)]
            if all(known) and not (inside and prose) or node.size and 2 * node.links >= node.size:
                return True
    return False


def _plain(node: Node) -> bool:
    """Whether an element is prose without a name, and not a list of links: near copies of an article share it."""
    return (node.tag in PROSE or node.tag in ("ol", "ul")) and 2 * node.links < max(node.size, 1) and not any(
        name in ("class", "id") for name, _ in node.marks)


def _dropped(node: Node, inside: bool, page: Node) -> bool:
    if _removed(node, page) or node.tag == "header" and not inside:
        return True
    return node.tag not in ("html", "body", "main") and _named(node, inside)


def _text(parts: list[str]) -> str:
    return _SPACE.sub(" ", unescape("".join(parts))).strip()


def _outermost(top: Node, tag: str, page: Node, template: set[int], named: bool) -> list[Node]:
    """The outermost elements of a tag that are neither dropped nor template; `named`: articles of any name."""
    found, work = [], [top]
    while work:
        node = work.pop()
        if node is not top:
            if node.slot in template or (_removed(node, page) if named and node.tag == tag
                                         else _dropped(node, False, page)):
                continue
            if node.tag == tag:
                found.append(node)
                continue
        work.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return found


def _roots(page: Node, template: set[int]) -> tuple[list[Node], bool]:
    """What holds the article, and whether it is declared so.

    These are the outermost articles or mains, whichever hold more text; in a main
    its articles if they hold half of its text. Else it is the page.
    """
    for named in (False, True):
        articles = _outermost(page, "article", page, template, named)
        mains = _outermost(page, "main", page, template, named)
        if not mains:
            if articles:
                return articles, True
            continue
        within = [a for m in mains for a in _outermost(m, "article", page, template, named)]
        if 2 * sum(a.size for a in within) >= sum(m.size for m in mains) and within:
            mains = within
        if sum(a.size for a in articles) > sum(m.size for m in mains):
            return articles, True
        return mains, True
    return [page], False


def main_text(page: Node, template: set[int]) -> str:
    """Blocks of the main text of a tree with hashes, in page order, joined by line breaks."""
    blocks: list[str] = []
    roots, inside = _roots(page, template)
    for root in roots:
        run: list[str] = []

        def flush(run: list[str] = run) -> None:
            if run:
                text = _text(run)
                if text:
                    blocks.append(text)
                run.clear()

        work: list = [root]
        while work:
            part = work.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                run.append(part)
            elif part.tag == "br":
                run.append(" ")
            elif part is root or not _dropped(part, inside, page) and not (
                    part.slot in template and not (inside and _plain(part))):
                if part.tag in BLOCKS or part is root:
                    flush()
                    work.append(None)
                work.extend(reversed(part.parts))
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; null or none: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(rest)


def _keys(host: str, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of slot and of subtree for each element, of one host."""
    seed = np.uint64(xxhash.xxh64_intdigest(host))
    slots = np.array([n.slot for n in nodes], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seed
    trees = np.array([n.hash for n in nodes], np.int64).view(np.uint64)
    return slots, (slots ^ slots >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) ^ trees


def _candidates(page: Node) -> list[tuple[Node, Node]]:
    """Elements with text that tags and roles leave, each with its parent; inline ones only if named."""
    found, work = [], [page]
    while work:
        node = work.pop()
        for part in node.parts:
            if isinstance(part, Node) and part.size and not _removed(part, page):
                if part.tag in BLOCKS and part.tag not in ("html", "body") or part.marks:
                    found.append((part, node))
                work.append(part)
    return found


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "html"):
        rows, slots, trees, around = [], [], [], []
        for i in range(batch.num_rows):
            page = batch.column("html")[i].as_py()
            if not page:
                continue
            root = parse(page)
            hash_subtrees(root)
            found = _candidates(root)
            if found:
                slot, tree = _keys(batch.column("host")[i].as_py(), [n for n, _ in found])
                rows += [i] * len(found)
                slots.append(slot.view(np.int64))
                trees.append(tree.view(np.int64))
                around += [p.hash for _, p in found]
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(none + slots)), pa.array(np.concatenate(none + trees)),
             pa.array(around, pa.int64()), batch.column("page").take(pa.array(rows, pa.int64()))],
            names=["slot", "tree", "around", "page"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(tree): keys of host, slot and subtree of the template, a row each.

    A subtree recurs if at least `min_pages` different parents hold it in its slot,
    under as many URLs of the host. The number is absolute, so a block of one
    section of a large host is found as on a small host. One page under several
    URLs is not its own template, nor are several states of one URL, and of a copied
    passage only the whole of it recurs, not its parts. A recurring subtree is
    template if recurring ones make up half of its slot, repeated parents once.
    Pages without html have no subtrees; no pages give no rows.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"),
                        F.xxhash64(url_col).alias("page"))
    held = (rows.mapInArrow(_subtrees, "slot long, tree long, around long, page long")
            .groupBy("slot", "tree", "around").agg(F.min("page").alias("page"))
            .groupBy("slot", "tree").agg(F.count(F.lit(1)).alias("parents"), F.count_distinct("page").alias("urls"))
            .withColumn("recurs", F.least("parents", "urls") >= min_pages))
    slots = (held.groupBy("slot")
             .agg(F.sum("parents").alias("parents"),
                  F.sum(F.when(F.col("recurs"), F.col("parents")).otherwise(0)).alias("recurring"))
             .where((F.col("recurring") > 0) & (2 * F.col("recurring") >= F.col("parents"))).select("slot"))
    return held.where("recurs").select("slot", "tree").join(slots, "slot").select("tree")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of template rows as bytes, a row a batch."""
    for batch in batches:
        keys = batch.column("tree").to_numpy().tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([keys], pa.binary())], names=["keys"])


def _extract(shared=None):
    """Texts of pages; templates come as broadcast keys or as the `template` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None if shared is None else shared.value
        for batch in in_slices(batches, "html"):
            texts = []
            for i in range(batch.num_rows):
                page = batch.column("html")[i].as_py()
                if not page:
                    texts.append("")
                    continue
                tree = parse(page)
                nodes = hash_subtrees(tree)
                _, own = _keys(batch.column("host")[i].as_py(), nodes)
                if keys is None:
                    mine = set(batch.column("template")[i].as_py() or ())
                    template = {n.slot for n, k in zip(nodes, own.view(np.int64).tolist(), strict=True) if k in mine}
                elif len(keys):
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    template = {nodes[k].slot for k in np.flatnonzero(keys[place] == own)}
                else:
                    template = set()
                texts.append(main_text(tree, template))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes)],
                names=["page_id", "url", "text", "n_chars"])

    return run


def _with_templates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the template hashes of each page, joined by shuffles.

    The template rows are repeated for each salt, so a subtree on all pages of a
    host is dealt over tasks. A page's list is bounded by its elements.
    """
    doc = F.when(F.length("html") > 0, F.xxhash64("host", "html")).otherwise(F.xxhash64("page_id", "url"))
    rows = rows.withColumn("doc", doc).withColumn("doc2", F.xxhash64(F.lit(1), "html", "host"))
    own = (rows.select("host", "html", F.struct("doc", "doc2").alias("page"))
           .mapInArrow(_subtrees, "slot long, tree long, around long, page struct<doc:long,doc2:long>")
           .withColumn("salt", F.pmod("page.doc", F.lit(SALTS))))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(
        "salt", F.col("salt").cast("long"))
    lists = (own.join(salted, ["tree", "salt"]).select("page.doc", "page.doc2", "tree")
             .groupBy("doc", "doc2").agg(F.collect_set("tree").alias("template")))
    return rows.join(lists, ["doc", "doc2"], "left")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns one row per input row: `page_id`, `url`, `text` (empty if none) and
    `n_chars`. Blocks come in page order, one line each, white space inside a
    block as one blank, character references decoded. A null or empty page has an
    empty text; a null URL belongs to the empty host. Null ids and repeated rows are kept; rows of
    one URL count as one page of the host. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    known = stage(templates(pages, url_col, html_col))
    kind = rows.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"
    if known.count() <= BROADCAST_HASHES:
        keys = [np.frombuffer(r["keys"], np.uint64) for r in known.mapInArrow(_packed, "keys binary").collect()]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))
        return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(keys)), out)
    return _with_templates(rows, known).select("page_id", "url", "html", "host", "template").mapInArrow(_extract(), out)
