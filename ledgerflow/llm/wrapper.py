"""Main text of web pages by wrapper induction.

Pages of one host come from one template, or from one per layout. Every page is parsed once, to a tree of block elements, with runs
of siblings of one shape folded into one node. The tree of elements that hold what can be content is the page's shape; the shapes that
most pages of a host have, `REFERENCES` at most, are merged to the host's template, and every shape is aligned with it by simple tree
matching: nodes of one element, an order-keeping matching of children with the most weight. An element that stands around or is missing
around what the other tree has is seen through where that matches more. A node takes the place (path) of the template's node
that it matches; one without a counterpart has a place of its own below its parent's, so nothing is left out.

A text that nearly all pages with a place hold there, of the host or of the layout, is constant and belongs to the template; all else is
a slot. All pages are counted, none stand for others. Then the template texts of each page go, and the slots that remain are read:
those in the article, or, in a page without one, those outside of menus, headers, footers, sidebars, notices, adverts, forms and
comments, by element, role and class. There a list is a menu too if all of its items, two at least, are links and none is a sentence.

The layout of a page is the set of paths to its containers, to `LAYOUT_DEPTH`, that hold what can be content. Pages are counted by what they
say, so that copies of one article with other adverts count once: texts that most pages of the host or layout hold are left aside,
and the longest of the others stands for the page; pages with little else count as one.

Shapes, places and texts are hashed and counted in groups; no group of pages meets in one task. Shapes are aligned once each, with one
template in hand; pages are joined with the places of their shape and the constants of their layout, not grouped. A shape of more than
`MOST_NODES` elements is no reference and keeps its own paths as places. `induce` learns from a handful of pages at hand.

A block's character references are decoded and its white space becomes single blanks; line breaks inside a block count as
white space. Blocks are joined by a line feed in page order.

Nulls and ties: a null page is empty; a null or unreadable address counts as one host. Exact copies of a page count once; repeated
rows get the same text each. An empty table gives no rows. Columns other than id, address and html are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import batches_of, materialize, with_facts
from ledgerflow.session import work_dir

#: Share of the pages with its node, and number of them, that a constant text needs.
CONSTANT = 0.75
LEAST_PAGES = 3
#: Share of the pages of a host or layout from which a text does not tell a page from its copies.
USUAL = 0.5
#: Share of a page's text that must be other than usual for the page to count by itself.
OWN = 0.25
LAYOUT_DEPTH = 6
#: Elements nested deeper belong to the node at this depth.
DEPTH = 60
#: Shapes that a host's template is merged from, and elements of a shape that is aligned.
REFERENCES = 8
MOST_NODES = 2000
BYTES_AT_ONCE = 4 << 20

# Elements and names by role.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("html body div main article section header footer center fieldset td table tbody tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_CONTENT = frozenset("head title nav footer aside form noscript template iframe button select textarea dialog menu svg object option".split())
BLOCK_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer comment comments "
    "commentlist reply replies disqus cookie cookies consent gdpr notice notices alert breadcrumb breadcrumbs share sharing social related recommended newsletter "
    "subscribe subscription signup popup modal overlay widget toolbar pagination pager login search skip copyright disclaimer respond".split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
LISTS = frozenset("ul ol dl menu dir".split())
#: What an opening element closes, and the elements that keep it open.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.S | re.I,
)
#: One attribute after another, so that a value is never taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++)))?""")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019)\]]*(?:\s|\Z)")
_NAME_PARTS = re.compile(r"[^a-z]+")
# Parts of a name that say what is around an element, or that it heads its content.
BESIDE = frozenset("has no with without".split())
STATES = frozenset("open closed layout enabled disabled visible active".split())
HEADED = frozenset("entry post article content section story".split())


def _telling(name: str) -> set[str]:
    """The part of a class or id that may name no content: its first or its last."""
    parts = [p for p in _NAME_PARTS.split(name) if p]
    if not parts or BESIDE & set(parts) or (len(parts) > 1 and parts[-1] in STATES):
        return set()
    found = {parts[0], parts[-1]} & (NO_CONTENT_NAMES | HEADER_NAMES)
    return found - HEADER_NAMES if parts[0] in HEADED else found


class Block:
    """A run of text: what it says, whether it lies in an article, whether it can be content, whether all its words are links, and its outermost list or 0."""

    __slots__ = ("text", "article", "content", "linked", "listed")

    def __init__(self, text: str, article: bool, content: bool, linked: bool, listed: int):
        self.text, self.article, self.content, self.linked, self.listed = text, article, content, linked, listed


@lru_cache(maxsize=4096)
def _attributes(attrs: str) -> tuple[str, frozenset[str], str, bool]:
    """(class and id without digits, the parts of those that may name no content, role, hidden) of an element."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), "".join(values))
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    telling = frozenset().union(*map(_telling, names.split()))
    return re.sub(r"\d+", "", names).strip(), telling, found.get("role", "").lower(), hidden


def parse(page: str) -> tuple[list, list[Block]]:
    """The folded tree of a page and its blocks. A node is [signature, children, blocks of its own text]."""
    blocks: list[Block] = []
    root = ["", [], []]
    # Open elements: tag, node, in an article, can be content, number of the outermost list around.
    stack = [("", root, False, True, 0)]
    opened: Counter = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    links = at = lists = 0

    def flush() -> None:
        if not pieces:
            return
        text = _plain("".join(pieces))
        pieces.clear()
        if text:
            _, node, article, content, listed = stack[-1]
            all_linked = bool(linked) and _word_signs("".join(linked)) == _word_signs(text)
            node[1].append(["#", [], [len(blocks)]])
            blocks.append(Block(text, article, content, all_linked, listed))
        linked.clear()

    def close_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, node, *_ = stack.pop()
            opened[tag] -= 1
            if tag == "a":
                links -= 1
            if node is not stack[-1][1]:
                node[1] = _folded(node[1])

    def nearest(tags, stops=()) -> int:
        if not any(opened[t] for t in tags):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in stops:
                return 0
        return 0

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text = page[at : token.start()]
            pieces.append(text)
            if links > 0:
                linked.append(text)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            depth = nearest((tag,), () if tag in BLOCKS else ("td", "th", "table"))
            if depth:
                if any(entry[0] in BLOCKS for entry in stack[depth:]):
                    flush()
                close_to(depth)
            continue
        if tag in BLOCKS:
            flush()
            depth = nearest(("p",), ("td", "th", "table", "button", "object"))
            if depth:
                close_to(depth)
            if tag in CLOSES:
                tags, stops = CLOSES[tag]
                while depth := nearest(tags, stops):
                    close_to(depth)
        if tag in VOID:
            pieces.append(" ")
            continue
        _, node, article, content, listed = stack[-1]
        if tag in LISTS and not listed:
            lists += 1
            listed = lists
        if tag in BLOCKS or token["attrs"]:
            names, parts, role, hidden = _attributes(token["attrs"]) if token["attrs"] else ("", frozenset(), "", False)
            if tag in ("html", "body"):
                pass
            elif hidden or tag in NO_CONTENT or role in BLOCK_ROLES or parts & NO_CONTENT_NAMES:
                content = False
            elif not article and (tag == "header" or parts & HEADER_NAMES):
                content = False
            article = article or content and (tag in ("article", "main") or role in ("main", "article"))
            if tag in BLOCKS and len(stack) <= DEPTH:
                child = [f"{tag} {names}".strip(), [], []]
                node[1].append(child)
                node = child
        stack.append((tag, node, article, content, listed))
        opened[tag] += 1
        links += tag == "a"
    if at < len(page):
        pieces.append(page[at:])
    flush()
    close_to(1)
    root[1] = _folded(root[1])
    return root, blocks


def _plain(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def _word_signs(text: str) -> int:
    return sum(map(str.isalnum, _plain(text)))


def _same_shape(a: list, b: list) -> bool:
    return a[0] == b[0] and len(a[1]) == len(b[1]) and all(map(_same_shape, a[1], b[1]))


def _folded(nodes: list) -> list:
    """Runs of siblings of one shape as one node that holds the texts of all."""
    done: list = []
    for node in nodes:
        if done and _same_shape(done[-1], node):
            _join(done[-1], node)
        else:
            done.append(node)
    return done


def _join(into: list, node: list) -> None:
    into[2] += node[2]
    for a, b in zip(into[1], node[1]):
        _join(a, b)


def match(left: list, right: list, same_text) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: the number of matched nodes and the matched pairs; equal texts weigh more."""
    if left[0] != right[0]:
        return 0, []
    own = 1 + 4 * same_text(left, right)
    a, b = left[1], right[1]
    if not a or not b:
        return own, [(left, right)]
    pairs = [[match(x, y, same_text) if x[0] == y[0] else (0, []) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pairs[i - 1][j - 1][0])
    found, i, j = [(left, right)], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            found += pairs[i - 1][j - 1][1]
            i, j = i - 1, j - 1
    return own + best[-1][-1], found


def induce(pages: list[str]) -> list | None:
    """The wrapper of pages of one host: [signature, children, constant texts], or None without constants."""
    template, seen, accepted = None, {}, []
    for page in pages:
        root, blocks = parse(page)
        texts = {b.text for b in blocks if b.content}
        size = sum(map(len, texts)) or 1
        # A page that mostly repeats another tells nothing about the template.
        if any(2 * sum(len(t) for t in texts & other) > size for other in accepted):
            continue
        accepted.append(texts)
        named = _with_texts(root, blocks)
        if template is None:
            template = _bare(named)
        _, pairs = match(template, named, lambda t, p: bool(p[2] & seen.get(id(t), (0, Counter()))[1].keys()))
        matched = {id(p): t for t, p in pairs}
        _grow(template, named, matched)
        for node, t in _walk_pairs(named, matched):
            count, held = seen.setdefault(id(t), (0, Counter()))
            held.update(node[2])
            seen[id(t)] = (count + 1, held)
    return _pruned(template, seen) if template else None


def _with_texts(node: list, blocks: list[Block]) -> list:
    return [node[0], [_with_texts(c, blocks) for c in node[1]], {blocks[i].text for i in node[2]}]


def _bare(node: list) -> list:
    return [node[0], [_bare(c) for c in node[1]], set()]


def _grow(template: list, node: list, matched: dict) -> None:
    """Add to the template, in place, what it has no node for."""
    at = 0
    for child in node[1]:
        own = matched.get(id(child))
        place = next((i for i, c in enumerate(template[1]) if c is own), None) if own is not None else None
        if place is None:
            own = _bare(child)
            template[1].insert(at, own)
            _claim(own, child, matched)
            at += 1
        else:
            _grow(own, child, matched)
            at = place + 1


def _claim(template: list, node: list, matched: dict) -> None:
    matched[id(node)] = template
    for a, b in zip(template[1], node[1]):
        _claim(a, b, matched)


def _walk_pairs(node: list, matched: dict) -> Iterator[tuple[list, list]]:
    if id(node) in matched:
        yield node, matched[id(node)]
    for child in node[1]:
        yield from _walk_pairs(child, matched)


def _pruned(node: list, seen: dict) -> list | None:
    count, held = seen.get(id(node), (0, Counter()))
    constant = sorted(t for t, n in held.items() if n >= LEAST_PAGES and n > CONSTANT * count)
    children = [c for c in (_pruned(c, seen) for c in node[1]) if c]
    return [node[0], children, constant] if children or constant else None


def main_text(page: str | None, wrapper: list | None) -> str:
    """The content of a page, its template texts left out."""
    if not page:
        return ""
    root, blocks = parse(page)
    template: set[int] = set()
    if wrapper:
        named = lambda w, p: bool(w[2]) and any(blocks[i].text in w[2] for i in p[2])
        for known, node in match(wrapper, root, named)[1]:
            constant = set(known[2])
            template.update(i for i in node[2] if blocks[i].text in constant)
    return "\n".join(blocks[i].text for i in _read(blocks) if i not in template)


def _read(blocks: list[Block]) -> list[int]:
    """The blocks that are content by where they stand."""
    if any(b.article for b in blocks):
        return [i for i, b in enumerate(blocks) if b.article and b.content]
    menus = _menus(blocks)
    return [i for i, b in enumerate(blocks) if b.content and b.listed not in menus]


def _menus(blocks: list[Block]) -> set[int]:
    """The lists of links alone, without a sentence among them."""
    held: dict[int, list[Block]] = {}
    for b in blocks:
        if b.listed and b.content:
            held.setdefault(b.listed, []).append(b)
    return {n for n, items in held.items() if len(items) > 1 and all(b.linked and not _SENTENCE.search(b.text) for b in items)}


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1 << 16)
def _step(path: int, signature: str) -> int:
    """The path to a child."""
    return _hashed(f"{path} {signature}")


def outline(root: list, blocks: list[Block]) -> tuple[int, list, list[int]]:
    """The layout of a page, its shape [signature, children], and for each block the number of its node there in page order, -1 if it cannot be content."""
    containers, places = set(), [-1] * len(blocks)
    # Numbers are given when an element's first block or child is met, and put in order below.
    owners: list[list] = []

    def walk(node: list, path: int, depth: int) -> list | None:
        shape = [_bare_signature(node[0]), []]
        mine = [i for child in node[1] if child[0] == "#" for i in child[2] if blocks[i].content]
        for child in node[1]:
            if child[0] != "#":
                inner = walk(child, _step(path, _bare_signature(child[0])), depth + 1)
                if inner:
                    shape[1].append(inner)
        if not mine and not shape[1]:
            return None
        owners.append([shape, mine])
        if depth <= LAYOUT_DEPTH and node[0].partition(" ")[0] in CONTAINERS:
            containers.add(path)
        return shape

    shape = walk(root, 0, 0) or ["", []]
    number = {id(node): n for n, node in enumerate(_preorder(shape))}
    for node, mine in owners:
        for i in mine:
            places[i] = number[id(node)]
    return _hashed(" ".join(map(str, sorted(containers)))) or 1, shape, places


def _bare_signature(signature: str) -> str:
    """Names of the whole page are often its own."""
    tag = signature.partition(" ")[0]
    return tag if tag in ("html", "body") else signature


def _preorder(shape: list) -> Iterator[list]:
    yield shape
    for child in shape[1]:
        yield from _preorder(child)


def paths(shape: list, path: int = 0) -> list[int]:
    """The path to every node, in page order."""
    return [path, *(p for child in shape[1] for p in paths(child, _step(path, child[0])))]


class Alignment:
    """Simple tree matching of a template with a page's shape; `found` has the template's node of each page node that has one, by identity.

    Nodes match if their elements are the same, and weigh more with the same names. Where a child is unknown to the other side, its own
    children stand for it if they match more there than it does itself.
    """

    def __init__(self, template: list, shape: list):
        self.lists: dict = {}
        self.found: dict[int, list] = {}
        self._claim(template, shape)

    def weight(self, t: list, p: list) -> int:
        if t[0].partition(" ")[0] != p[0].partition(" ")[0]:
            return 0
        return (3 if t[0] == p[0] else 1) + self.matched(t[1], p[1])[0]

    def matched(self, left: list, right: list) -> tuple[int, list[tuple[list, list]]]:
        """The weight and the pairs of the best matching of two lists of children."""
        if not left or not right:
            return 0, []
        key = id(left), id(right)
        if key not in self.lists:
            a, b = left, self._opened(right, left, lambda inner, other: self.matched(other, inner)[0], lambda x, y: self.weight(y, x))
            a = self._opened(a, b, lambda inner, other: self._best(inner, other)[0], self.weight)
            # Kept with its lists, so that no other list gets their identity.
            self.lists[key] = *self._best(a, b), left, right, a, b
        return self.lists[key][:2]

    def _opened(self, nodes: list, others: list, within, weight) -> list:
        """The nodes, unknown ones replaced by their children where these match more."""
        known, out = {o[0] for o in others}, []
        for node in nodes:
            if node[0] not in known and node[1] and within(node[1], others) > max(weight(node, o) for o in others):
                out += self._opened(node[1], others, within, weight)
            else:
                out.append(node)
        return out

    def _best(self, a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
        weights = [[self.weight(x, y) for y in b] for x in a]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, line in enumerate(weights, 1):
            for j, w in enumerate(line, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
        pairs, i, j = [], len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs.append((a[i - 1], b[j - 1]))
                i, j = i - 1, j - 1
        return best[-1][-1], pairs

    def _claim(self, template: list, shape: list) -> None:
        self.found[id(shape)] = template
        for t, p in self.matched(template[1], shape[1])[1]:
            self._claim(t, p)


def merged(shapes: list[list]) -> list:
    """The template of shapes, the first of them with what it lacks of the others."""
    template = json.loads(json.dumps(shapes[0]))
    for shape in shapes[1:]:
        if set(paths(shape)) <= set(paths(template)):
            continue
        found = Alignment(template, shape).found
        added: list[tuple[list, list]] = []

        def place(node: list, owner: list) -> None:
            own = found.get(id(node))
            # An element seen through is not part of the template.
            if own is None and not any(id(n) in found for n in _preorder(node)):
                added.append((owner, json.loads(json.dumps(node))))
                return
            for child in node[1]:
                place(child, own or owner)

        place(shape, template)
        for owner, node in added:
            if all(node[0] != c[0] for c in owner[1]):
                owner[1].append(node)
    return template


def located(template: list, shape: list) -> list[int]:
    """The place of every node of a shape, in page order: the path of the template's node that it matches, or one below its parent's."""
    own = paths(shape)
    # Elements that all have their place in the template need no matching.
    if len(own) > MOST_NODES or set(own) <= set(paths(template)):
        return own
    found, out = Alignment(template, shape).found, []
    known = {id(node): path for node, path in zip(_preorder(template), paths(template))}

    def walk(node: list, above: int) -> None:
        match_ = found.get(id(node))
        here = known[id(match_)] if match_ is not None else _step(above, node[0])
        out.append(here)
        for child in node[1]:
            walk(child, here)

    walk(shape, 0)
    return out


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


_BLOCK = pa.struct([("place", pa.int32()), ("text", pa.int64()), ("size", pa.int64()), ("said", pa.string())])


def parsed(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, host, hash, layout, shape, shape_key, blocks) of every page, stored.

    Blocks are those that can be content: the number of their node, hash and length of their text, and the text itself where it is read
    if it is no constant, else null.
    """
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.xxhash64(html).alias("hash"), F.col(html).alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "html", BYTES_AT_ONCE):
                layouts, shapes, held = [], [], []
                for page in part.column("html").to_pylist():
                    root, blocks = parse(page or "")
                    layout, shape, places = outline(root, blocks)
                    kept = set(_read(blocks))
                    layouts.append(layout)
                    shapes.append(json.dumps(shape, separators=(",", ":"), ensure_ascii=False))
                    held.append([
                        {"place": n, "text": _hashed(b.text), "size": len(b.text), "said": b.text if i in kept else None}
                        for i, (n, b) in enumerate(zip(places, blocks)) if n >= 0
                    ])
                found = [pa.array(layouts, pa.int64()), pa.array(shapes, pa.string()), pa.array(held, pa.list_(_BLOCK))]
                yield pa.record_batch([*(part.column(c) for c in ("id", "url", "host", "hash")), *found], ["id", "url", "host", "hash", "layout", "shape", "blocks"])

    block = "array<struct<place:int,text:long,size:long,said:string>>"
    found = rows.mapInArrow(read, f"id {kind}, url string, host string, hash long, layout long, shape string, blocks {block}")
    # This holds the texts of all pages, so it is packed more tightly than other tables.
    path = work_dir(pages.sparkSession, "wrapper-parsed")
    found.withColumn("shape_key", F.xxhash64("host", "shape")).write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.parquet(path)


def templates(shapes: DataFrame) -> DataFrame:
    """(host, template) from the shapes that most pages of a host have."""
    most = Window.partitionBy("host").orderBy(F.desc("pages"), "shape_key")
    usable = shapes.where(F.size(F.split("shape", "\\[")) <= 2 * MOST_NODES)
    chosen = usable.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= REFERENCES)
    grouped = chosen.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "shape")))["shape"].alias("shapes"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(merged([json.loads(x) for x in known]), separators=(",", ":"), ensure_ascii=False) for known in batch.column("shapes").to_pylist()]
            yield pa.record_batch([batch.column("host"), pa.array(made, pa.string())], ["host", "template"])

    return grouped.mapInArrow(merge, "host string, template string")


def places(pages: DataFrame) -> DataFrame:
    """(shape_key, paths) of every different shape: the places of its nodes, aligned with the template of the host; stored."""
    counted = pages.groupBy("host", "shape_key").agg(F.count("*").alias("pages"), F.first("shape").alias("shape"))
    shapes = materialize(counted, "wrapper-shapes")
    known = materialize(templates(shapes), "wrapper-templates")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("template").to_pylist(), batch.column("shape").to_pylist())
            out = [located(_tree(t), json.loads(s)) if t else paths(json.loads(s)) for t, s in both]
            yield pa.record_batch([batch.column("shape_key"), pa.array(out, pa.list_(pa.int64()))], ["shape_key", "paths"])

    both = shapes.join(known, "host", "left").select("shape_key", "shape", "template")
    return materialize(both.mapInArrow(align, "shape_key long, paths array<long>"), "wrapper-places")


@lru_cache(maxsize=64)
def _tree(template: str) -> list:
    return json.loads(template)


def outlines(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, hash, layout, nodes) of every different page; nodes are the place and hashed text of blocks, with the text's length."""
    slim = pages.select("host", "hash", "layout", "shape_key", F.col("blocks.place").alias("at"), F.col("blocks.text").alias("texts"), F.col("blocks.size").alias("sizes"))
    node = lambda z: F.struct(F.get("paths", z["at"]).alias("path"), z["texts"].alias("text"), z["sizes"].alias("size"))
    nodes = F.array_distinct(F.transform(F.arrays_zip("at", "texts", "sizes"), node))
    different = slim.where(F.size("at") > 0).dropDuplicates(["host", "hash"])
    return different.join(known, "shape_key").select("host", "hash", "layout", nodes.alias("nodes"))


def _by_level(pages: DataFrame) -> DataFrame:
    """Every page twice: for its host, as level 0, and for its layout."""
    return pages.withColumn("level", F.explode(F.array(F.lit(0).cast("long"), "layout")))


def _with_both(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """The rows with the array `name` of their host's and their layout's list."""
    of_host = lists.where("level = 0").select("host", F.col(name).alias("_of_host"))
    of_layout = lists.where("level != 0").select("host", F.col("level").alias("layout"), F.col(name).alias("_of_layout"))
    empty = F.array().cast(lists.schema[name].dataType)
    both = F.array_union(F.coalesce("_of_host", empty), F.coalesce("_of_layout", empty))
    return rows.join(of_host, "host", "left").join(of_layout, ["host", "layout"], "left").withColumn(name, both).drop("_of_host", "_of_layout")


def contents(pages: DataFrame) -> DataFrame:
    """Outlines with `content`, which is the same for pages that say the same but for usual texts and short ones."""
    levels = _by_level(pages)
    totals = levels.groupBy("host", "level").agg(F.count("*").alias("pages"))
    texts = levels.select("host", "level", F.explode(F.array_distinct(F.col("nodes.text"))).alias("text")).groupBy("host", "level", "text").agg(F.count("*").alias("n"))
    usual = texts.where(F.col("n") >= LEAST_PAGES).join(totals, ["host", "level"]).where(F.col("n") > USUAL * F.col("pages"))
    # Stored, so that Catalyst knows how small it is.
    usual = materialize(usual.groupBy("host", "level").agg(F.collect_list("text").alias("usual")), "wrapper-usual")
    size = lambda nodes: F.aggregate(nodes, F.lit(0).cast("long"), lambda total, n: total + n["size"])
    told = _with_both(pages, usual, "usual").withColumn("own", F.filter("nodes", lambda n: ~F.array_contains("usual", n["text"])))
    longest = F.array_max(F.transform("own", lambda n: F.struct(n["size"], n["text"].alias("text"))))["text"]
    alone = (F.size("own") > 0) & (size(F.col("own")) >= OWN * size(F.col("nodes")))
    return told.withColumn("content", F.when(alone, longest).otherwise(F.lit(0).cast("long"))).drop("own", "usual")


def wrappers(outlined: DataFrame) -> DataFrame:
    """(host, level, constants) of every host (level 0) and layout with constant texts, as hashes of place and text.

    A text is constant where more than `CONSTANT` of the contents that have its node hold it, of all pages.
    """
    told = contents(outlined)
    seen = _by_level(told).select("host", "level", "content", F.inline("nodes")).drop("size").distinct()
    texts = seen.groupBy("host", "level", "path", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    nodes = seen.drop("text").distinct().groupBy("host", "level", "path").agg(F.count("*").alias("held"))
    constant = texts.join(nodes, ["host", "level", "path"]).where(F.col("n") > CONSTANT * F.col("held"))
    return constant.groupBy("host", "level").agg(F.collect_list(F.xxhash64("path", "text")).alias("constants"))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every page."""
    read = parsed(pages, key=key, url=url, html=html)
    known = places(read)
    constants = materialize(wrappers(materialize(outlines(read, known), "wrapper-outlines")), "wrappers")
    joined = _with_both(with_facts(read.drop("shape", "hash"), known, "shape_key"), constants, "constants")
    # Hashes of the page's own blocks that are constants: a set of longs, so the test is linear.
    mark = lambda b: F.xxhash64(F.get("paths", b["place"]), b["text"])
    gone = joined.withColumn("gone", F.array_intersect(F.transform("blocks", mark), "constants"))
    kept = F.filter("blocks", lambda b: b["said"].isNotNull() & ~F.array_contains("gone", mark(b)))
    text = F.array_join(F.transform(kept, lambda b: b["said"]), "\n")
    return gone.select(F.col("id").alias(key), F.col("url").alias(url), text.alias("text"))
