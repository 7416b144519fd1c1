"""Main text of web pages by wrapper induction.

Every page is parsed once, into the tags of its tree of block elements and its blocks of text. The pages of a
host with the same nesting of elements, runs of like siblings counted once, are a layout. Each layout of
``LEAST_PAGES`` different pages or more has a reference page; pages of rarer layouts go to the host's most
frequent one. Every tree is aligned with its reference's by simple tree matching; an aligned place is a slot.
Spark counts, for each reference and slot, on how many different pages its text is one that pages of other
stories repeat there (near copies of one story are told by a block drawn from each page by its length), and how much different text outside links it holds over all pages; pages whose blocks are all equal count once,
and pages without a block not at all. A slot whose texts mostly recur is template; one whose texts vary is content.

The slots' sums also tell the reference's region: from the root down, the one container that holds at least
``REGION`` of the different text below it, as long as no paragraph or heading beside it varies. Menus,
adverts and footers that rotate vary too, but hold little text outside links, so they lie outside. Blocks in a
slot outside the region, or below one, are dropped, whatever their elements are called; so are template slots.
Content slots in the region are kept, inside and outside article or main elements alike, unless their
element's name or class word (aside, advert, comments, ...) says that it is no main text, or it is hidden.
Names, class words and the bounds of an article or main element decide alone where no slot does: on hosts of
too few pages, for slots that too few pages have, and on pages with no block in their reference's region.

Only tags of the references and lists of slots travel with the pages, never a host's pages together: a
host of any size is a sum of counts.

Blocks are runs of text between block elements. Character references are decoded, white space in
a block becomes one space, blocks are joined by one space.

Defined results: a null or empty page has an empty text; a null URL, or one without ``://``, belongs to
the host of the empty name; a broken page is read to its end, with open elements closed there and a tag that
never ends dropped; once a quote stays open to the end of the page, tags end at the next ``>``; a page of any
length and depth is read in one pass, in time that grows with its length, and aligned whole; of equally good
alignments the one with the later pairs counts; layouts equally frequent on a host rank by their hash; repeated
rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import stage
from tidewater.llm.urlfilter import host_of

#: A slot is template if this share of at least so many pages has a text there that the host repeats.
SHARE, LEAST_PAGES = 0.5, 5
#: A text is repeated if the pages that have it hold at least two stories, and one for so many pages, or half of
#: the places that stories are hashed to.
STORIES, PLACES = 0.25, 64
#: A container is the region, or holds it, if this share of the different text below its parent is in it.
REGION = 0.8
#: Elements that may hold the region, and those that end the way down if they vary beside it.
HOLDERS = frozenset("# html body div main article section center".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dl ul ol table figure".split())
#: Child lists of more pairs than this are aligned by array operations, with the same result.
BY_ARRAYS = 2048
#: Blocks of one element have slots of their own, up to so many.
TURNS = 1 << 31
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind closes an open element of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"button", "td", "th", "table"}}
OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
OUTSIDE_WORDS = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|banner|notice|notices|cookie|cookies|consent|comment|comments|disqus|promo|sponsor|sponsored|breadcrumb|breadcrumbs|share|social|related|widget|subscribe|newsletter|popup|modal|alert)(?:$|[\s_-])", re.I)
#: Readers' comments may outweigh the story, so they do not count in the search for the region.
READERS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: From a tag's name to its end, past quoted values; possessive, so it is tried once.
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "kids", "index", "flat", "outside", "inside", "shape")

    def __init__(self, tag: str, index: int, outside: int = 0, inside: int = 0) -> None:
        self.tag, self.index, self.outside, self.inside = tag, index, outside, inside
        self.kids: list[Node] = []
        self.flat: str | None = None
        self.shape = 0


def _marked(tag: str, attributes: str) -> int:
    """1 if the element's name or attributes say that it is not part of an article, 2 if it is hidden or readers' comments, else 0."""
    found = int(tag in OUTSIDE)
    if not attributes or attributes.isspace():
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and READERS.search(value) or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
        if name in ("class", "id") and OUTSIDE_WORDS.search(value) or name == "role" and value.lower() in OUTSIDE_ROLES:
            found = 1
    return found


def parse(page: str, free: list[int] | None = None) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the blocks of text in page order with their element.

    ``free`` gets the code points, without white space, that each block has outside links.
    """
    root = Node("#", 0)
    stack: list[tuple[str, Node]] = [("#", root)]  # every open element, with its block
    where: dict[str, list[int]] = defaultdict(list)  # the places of a tag on the stack
    blocks: list[tuple[Node, str]] = []
    pieces: list[str] = []
    plain: list[str] = []  # those outside links
    count, at, quoted = 1, 0, True

    def push(tag: str, node: Node) -> None:
        where[tag].append(len(stack))
        stack.append((tag, node))

    def pop_from(k: int) -> None:
        while len(stack) > k:
            where[stack.pop()[0]].pop()

    def last(tags: frozenset[str] | set[str]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def flush() -> None:
        if pieces:
            if text := " ".join("".join(pieces).split()):
                blocks.append((stack[-1][1], text))
                if free is not None:
                    free.append(sum(len(w) for x in plain for w in x.split()))
            pieces.clear()
            plain.clear()

    while True:
        m = _TOKEN.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw:
            pieces.append(entities.unescape(raw) if "&" in raw else raw)
            if not where.get("a"):
                plain.append(pieces[-1])
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        end = _REST.match(page, at).end() if quoted else page.find(">", at)
        if end == len(page) or page[end : end + 1] != ">":
            quoted, end = False, page.find(">", at)
        if end < 0:  # no tag ends any more
            break
        attributes, at = page[at:end], end + 1
        tag = name.lower()
        if m[1]:
            if tag not in VOID and where.get(tag):
                k = where[tag][-1]
                if stack[-1][1] is not stack[k - 1][1]:  # a block ends here
                    flush()
                pop_from(k)
            continue
        if tag == "br" or tag == "hr":
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if tag in INLINE:
            if attributes.endswith("/"):
                continue
            top = stack[-1][1]
            if (mark := _marked(tag, attributes)) > top.outside:  # hidden or marked inline text is a block of its own
                flush()
                top = Node(tag, count, mark, top.inside)
                count += 1
            push(tag, top)
            continue
        flush()
        closes, scope = _CLOSES.get(tag, frozenset()) | {"p"}, last(_SCOPES.get(tag, _SCOPES["p"]))
        while (k := last(closes)) > scope:
            pop_from(k)
            if tag not in _CLOSES:
                break
        up = stack[-1][1]
        inside = 2 if tag == "article" else 1 if tag == "main" or re.search(r"role\s*=\s*[\"']?main", attributes, re.I) else 0
        node = Node(tag, count, max(up.outside, _marked(tag, attributes)), max(up.inside, inside))
        count += 1
        up.kids.append(node)
        if not attributes.endswith("/"):
            push(tag, node)
    flush()
    return root, blocks


def _settle(node: Node) -> Node:
    """Mark nodes whose children are leaves of one kind: these align in order."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.kids and all(not k.kids and k.tag == n.kids[0].tag for k in n.kids):
            n.flat = n.kids[0].tag
        todo += n.kids
    return node


def skeleton(root: Node) -> tuple[str, dict[int, int]]:
    """The tags of a tree in order, each after its depth, and each node's place there."""
    out, places, todo = [], {}, [(root, 0)]
    while todo:
        node, depth = todo.pop()
        places[node.index] = len(out)
        out.append(f"{depth} {node.tag}")
        todo += [(k, depth + 1) for k in reversed(node.kids)]
    return ",".join(out), places


def layout(root: Node) -> str:
    """Hash of a tree's nesting: runs of equal siblings count once, so that the number of paragraphs does not matter."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    of: dict[int, str] = {}
    for n in reversed(order):
        kids = [of[k.index] for k in n.kids]
        runs = [k for i, k in enumerate(kids) if not i or k != kids[i - 1]]
        of[n.index] = xxhash.xxh64_hexdigest(f"{n.tag}({','.join(runs)})")
    return of[root.index]


def content_hash(blocks: list[tuple[Node, str]]) -> int:
    """Hash of all of a page's blocks: comments and scripts do not make another page."""
    return xxhash.xxh64_intdigest("\0".join(text for _, text in blocks)) - 2**63


def story_hash(blocks: list[tuple[Node, str]], free: list[int]) -> int:
    """A place for the page's story, from 0 up to PLACES: the hash of one block, drawn by its text with odds like its code points outside links.

    Near copies draw the same block as often as they share text; pages that share a menu or a notice seldom do.
    """
    hashes = [xxhash.xxh64_intdigest(text) for _, text in blocks]
    drawn = [(-math.log((h + 1) / 2.0**64) / n if h < 2**64 - 2**11 else 0.0, h) for h, n in zip(hashes, free, strict=True) if n]
    return (min(drawn)[1] if drawn else xxhash.xxh64_intdigest(repr(hashes))) % PLACES


def grown(tags: str) -> Node:
    """The tree of a skeleton; indices are places there."""
    path: list[Node] = []
    for i, item in enumerate(tags.split(",")):
        depth, tag = item.split(" ", 1)
        node = Node(tag, i)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return _settle(path[0])


_reference = lru_cache(256)(grown)


def _shaped(root: Node, known: dict[tuple, int]) -> None:
    """Number each node by its tag and its children's numbers: subtrees of one number are the same."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    for n in reversed(order):
        n.shape = known.setdefault((n.tag, *(k.shape for k in n.kids)), len(known))


class _Matching:
    """Simple tree matching: the most nodes that pair up with order and ancestry kept. Sizes depend on shapes alone."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if not a.kids or not b.kids:
            return 1
        key = (a.shape, b.shape)
        if key not in self.sizes:
            self.sizes[key] = 1 + (min(len(a.kids), len(b.kids)) * (a.flat == b.flat) if a.flat and b.flat else int(self._rows(a.kids, b.kids)[-1][-1]))
        return self.sizes[key]

    def _rows(self, x: list[Node], y: list[Node]) -> list:
        """Row i, column j: the size of the best alignment of the first i of ``x`` with the first j of ``y``."""
        if len(x) * len(y) > BY_ARRAYS:
            found, which = np.unique([q.shape for q in y], return_inverse=True)
            first = {s: q for s, q in zip((q.shape for q in reversed(y)), reversed(y), strict=True)}
            weights: dict[int, np.ndarray] = {}
            rows = [np.zeros(len(y) + 1, np.int32)]
            for p in x:
                if p.shape not in weights:
                    weights[p.shape] = np.array([self.size(p, first[s]) for s in found.tolist()], np.int32)[which]
                row = np.zeros(len(y) + 1, np.int32)
                np.maximum.accumulate(np.maximum(rows[-1][1:], rows[-1][:-1] + weights[p.shape]), out=row[1:])
                rows.append(row)
            return rows
        best = [[0] * (len(y) + 1)]
        for p in x:
            above, row = best[-1], [0]
            for j, q in enumerate(y):
                here = above[j] + self.size(p, q) if p.tag == q.tag else 0
                left, up = row[j], above[j + 1]
                row.append(max(here, left, up))
            best.append(row)
        return best

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The children that pair up under two nodes that do."""
        x, y = a.kids, b.kids
        if not x or not y:
            return []
        if a.shape == b.shape or a.flat and a.flat == b.flat:
            return list(zip(x, y, strict=False))
        if a.flat and b.flat:
            return []
        best, out, i, j = self._rows(x, y), [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
        return out


def aligned(reference: Node, page: Node) -> dict[int, int]:
    """Page node index to slot, the reference node's index."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # sizes recurse as deep as both trees go
    known: dict[tuple, int] = {}
    _shaped(reference, known)
    _shaped(page, known)
    matching, out = _Matching(), {}
    todo = [(reference, page)] if reference.tag == page.tag else []
    while todo:
        a, b = todo.pop()
        out[b.index] = a.index
        todo += matching.pairs(a, b)
    return out


def blocks_of(page: str) -> tuple[str, str, int, list[int], list[str], list[int], list[int], int]:
    """(layout, tags, content hash, of each block the element's place in the tags, the text, the element's mark and the code points outside links; story hash).

    The place of an element that is not in the tree is -1. The mark is -1 for an element that is
    no main text, -2 for a hidden one or readers' comments, else 2 inside an article, 1 inside a main element, 0 elsewhere.
    """
    free: list[int] = []
    root, blocks = parse(page, free)
    tags, places = skeleton(root)
    return layout(root), tags, content_hash(blocks), [places.get(n.index, -1) for n, _ in blocks], [t for _, t in blocks], [-n.outside if n.outside else n.inside for n, _ in blocks], free, story_hash(blocks, free)


def slots_of(reference: str | None, tags: str, places: list[int]) -> list[int | None]:
    """The slot of each block; it also counts the element's earlier blocks.

    A block that is not aligned has -1 less the reference's place of the nearest aligned element around it, or
    None if there is none.
    """
    slots = aligned(_reference(reference), grown(tags)) if reference else {}
    around: list[int | None] = []  # of each place in the page, the nearest aligned one's in the reference
    path: list[int | None] = []
    for i, item in enumerate(tags.split(",") if slots else ()):
        depth = int(item.split(" ", 1)[0])
        del path[depth:]
        path.append(slots.get(i, path[-1] if path else None))
        around.append(path[-1])
    seen: dict[int, int] = {}
    out: list[int | None] = []
    for place in places:
        turn = seen[place] = seen.get(place, -1) + 1
        slot = slots.get(place)
        above = around[place] if slot is None and 0 <= place < len(around) else None
        out.append(slot * TURNS + turn if slot is not None else None if above is None else -1 - above)
    return out


def region_of(tags: str, sums: list[tuple[int, int, bool]]) -> tuple[int, int, list[int]]:
    """(first place, place after the last, places above) of the reference's region; (0, 0, []) if there is none.

    ``sums`` holds, for each slot, its different text and whether it is a content slot.
    """
    depths, names = zip(*((int(d), t) for d, t in (item.split(" ", 1) for item in tags.split(","))), strict=True)
    after, mass, varies, path = [len(depths)] * len(depths), [0] * (len(depths) + 1), [False] * len(depths), []
    for i, depth in enumerate(depths):
        while len(path) > depth:
            after[path.pop()] = i
        path.append(i)
    for slot, size, content in sums:
        place = slot // TURNS if slot >= 0 else -1 - slot
        mass[place + 1] += size
        varies[place] |= content and size > 0
    for i in range(len(depths)):
        mass[i + 1] += mass[i]
    weight = lambda i: mass[after[i]] - mass[i]
    if not weight(0):
        return 0, 0, []
    at, above = 0, []
    while not varies[at] and names[at] not in ("article", "main"):
        kids, i = [], at + 1
        while i < after[at]:
            kids.append(i)
            i = after[i]
        if not kids or any(names[k] in FLOW and any(varies[k : after[k]]) for k in kids):
            break
        best = max(kids, key=weight)
        if names[best] not in HOLDERS or after[best] == best + 1 or weight(best) < REGION * weight(at):
            break
        above.append(at)
        at = best
    return at, after[at], above


def main_text(slots: list[int | None], texts: list[str], marks: list[int], template: frozenset[int], content: frozenset[int] = frozenset(), region: tuple[int, int, list[int]] = (0, 0, [])) -> tuple[str, int, int]:
    """(text, blocks dropped by their slot, blocks dropped by their element)."""
    bound = max(marks, default=0)
    start, end, above = region
    places = [None if s is None else s // TURNS if s >= 0 else -1 - s for s in slots]
    if not any(p is not None and start <= p < end for p in places):
        start, end = 0, sys.maxsize  # not a page of this wrapper
    kept, by_slot, marked = [], 0, 0
    for slot, place, text, mark in zip(slots, places, texts, marks, strict=True):
        if slot in template or place is not None and not start <= place < end and place not in above:
            by_slot += 1
        elif mark < 0 or slot not in content and mark < bound:
            marked += 1
        else:
            kept.append(text)
    return " ".join(kept), by_slot, marked


READ = "_layout string, _tags string, _page long, _places array<int>, _texts array<string>, _marks array<int>, _free array<int>, _story int"


def _arrays(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * len(types), types, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars, n_template_blocks and n_marked_blocks."""
    url = pages[url_col].cast("string")
    slim = pages.select(pages[id_col].alias("_id"), url.alias("_url"), host_of(url).alias("_host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("_html"))
    id_type = slim.schema["_id"].dataType.simpleString()
    head, names = f"_id {id_type}, _url string, _host string", [x.split()[0] for x in READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [blocks_of(x.as_py()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *_arrays(got, [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()])], ["_id", "_url", "_host", *names])

    parsed = stage(slim.mapInArrow(read, f"{head}, {READ}"), "parsed")
    # Copies meet in the map task first; a layout of any size is then a count and its least page.
    different = parsed.filter(F.size("_texts") > 0).groupBy("_host", "_layout", "_page").agg(F.min("_tags").alias("_tags"))
    layouts = stage(different.groupBy("_host", "_layout").agg(F.count("*").alias("_pages"), F.min(F.struct("_page", "_tags"))["_tags"].alias("_reference")), "layouts")
    usual = layouts.groupBy("_host").agg(F.max(F.struct("_pages", "_layout"))["_layout"].alias("_layout"))
    often = layouts.join(usual.withColumn("_usual", F.lit(True)), ["_host", "_layout"], "left").filter((F.col("_pages") >= LEAST_PAGES) | F.col("_usual"))
    references = stage(often.select("_host", "_layout", "_reference", F.coalesce("_usual", F.lit(False)).alias("_usual")), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [slots_of(*row) for row in zip(*(b.column(c).to_pylist() for c in ("_reference", "_tags", "_places")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(slots, pa.list_(pa.int64()))], [*kept, "_slots"])

    # Each page beside its layout's reference, else its host's most frequent one, else nulls.
    own = references.select("_host", "_layout", F.struct("_layout", "_reference").alias("_own"))
    other = references.filter("_usual").select("_host", F.struct("_layout", "_reference").alias("_other"))
    placed = parsed.join(own, ["_host", "_layout"], "left").join(other, "_host", "left").withColumn("_w", F.coalesce("_own", "_other"))
    placed = placed.select("_id", "_url", "_host", F.col("_w._layout").alias("_layout"), "_page", "_texts", "_marks", "_free", "_story", F.col("_w._reference").alias("_reference"), "_tags", "_places")
    kept = ["_id", "_url", "_host", "_layout", "_page", "_texts", "_marks", "_free", "_story"]
    # Aligned anew for each use: a table of it would hold all texts a second time.
    slotted = placed.mapInArrow(align, f"{head}, _layout string, _page long, _texts array<string>, _marks array<int>, _free array<int>, _story int, _slots array<long>")

    key = ["_host", "_layout", "_slot"]
    found = slotted.filter("_layout is not null").select("_host", "_layout", "_page", "_story", F.explode(F.arrays_zip("_slots", "_texts", "_marks", "_free")).alias("_b")).filter("_b._slots is not null")
    found = found.select("_host", "_layout", F.col("_b._slots").alias("_slot"), F.xxhash64("_b._texts").alias("_hash"), "_page", "_story", F.when(F.col("_b._marks") > -2, F.col("_b._free")).otherwise(0).alias("_free"))
    counts = found.groupBy(*key, "_hash", "_page").agg(F.max("_free").alias("_free"), F.min("_story").alias("_story"))
    # Stories are counted by their places, eight bytes a text. Copies and near copies of one story repeat all its texts, which are no template for that.
    counts = counts.groupBy(*key, "_hash").agg(F.count("*").alias("count"), F.max("_free").alias("_free"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, _story)"))).alias("_stories"))
    again = (F.col("_stories") > 1) & (F.col("_stories") >= F.least(STORIES * F.col("count"), F.lit(PLACES / 2)))
    slots = counts.groupBy(*key).agg(F.sum("count").alias("_n"), F.sum(F.when(again, F.col("count")).otherwise(0)).alias("_again"), F.sum("_free").alias("_free"))
    # One row a slot of a reference page: as many as that page has blocks.
    listed = slots.groupBy("_host", "_layout").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("_slot", "_n", "_again", "_free")).alias("_sums"))
    wrapped = listed.filter(F.col("_n") >= LEAST_PAGES).join(references.select("_host", "_layout", "_reference"), ["_host", "_layout"]).select("_host", "_layout", "_reference", "_sums")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for reference, sums in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                told = [(x["_slot"], x["_again"] >= SHARE * x["_n"]) for x in sums if x["_slot"] >= 0 and x["_n"] >= LEAST_PAGES]
                content = {slot for slot, again in told if not again}
                start, end, above = region_of(reference, [(x["_slot"], x["_free"], x["_slot"] in content) for x in sums])
                rows.append((sorted(slot for slot, again in told if again), sorted(content), start, end, above))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_arrays(rows, [longs, longs, pa.int64(), pa.int64(), longs])], ["_host", "_layout", "_template", "_content", "_start", "_end", "_above"])

    decided = stage(wrapped.mapInArrow(decide, "_host string, _layout string, _template array<long>, _content array<long>, _start long, _end long, _above array<long>"), "wrappers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("_slots", "_texts", "_marks", "_template", "_content", "_start", "_end", "_above")), strict=True)
            got = [(t, len(t), by_slot, marked) for slots_, texts, marks, template, content, start, end, above in rows for t, by_slot, marked in (main_text(slots_, texts, marks, frozenset(template or ()), frozenset(content or ()), (start or 0, end or 0, above or [])),)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_arrays(got, [pa.string(), pa.int64(), pa.int64(), pa.int64()])], [id_col, url_col, "text", "n_chars", "n_template_blocks", "n_marked_blocks"])

    shape = f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long, n_template_blocks long, n_marked_blocks long"
    return slotted.join(decided, ["_host", "_layout"], "left").select("_id", "_url", "_slots", "_texts", "_marks", "_template", "_content", "_start", "_end", "_above").mapInArrow(cut, shape)
