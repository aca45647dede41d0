"""Main text of HTML pages by wrapper induction over the pages of a host.

Each page is parsed into a tree of block elements whose leaves are runs of text. Equal siblings are folded, so
the *shape* of a page (labels without text) is small and most pages of a host share a few. Per host:

1. the most frequent shape is the seed; every other shape is aligned with it by simple tree matching, which
   maps its leaves to the seed's slots (a leaf that matches none has no slot);
2. texts are counted per slot over distinct pages. A text that at least ``MANY`` pages and nine tenths of the
   host's pages have in the same slot is constant, so part of the template; other texts vary;
3. content is what varies, outside of elements that by name are not content (`DROP_TAGS`, `DROP_NAMES`). Where
   a shape has an article or main element, only what is inside; else runs of mostly links are left out too.
   Inside, a name drops an element only if it is a listed word or made of such words and neutral ones (`NEUTRAL`):
   ``social-share`` goes, ``related-work`` and ``share-price`` stay.
   Names do not drop what frames the content: html, body, main, an element around all main elements (without
   one: all outer articles), nor an article unless another has no such name. ``has-sidebar`` is not a sidebar.

All decisions are made per (host, shape), from counts: no host is gathered in one task, and a host that
holds a third of all pages costs its distinct shapes. Pages meet their wrapper in one join, split by AQE if
a key is hot.

Null html is empty and gives an empty text. A null or odd url is host "". Truncated and malformed pages are
parsed as browsers do as far as blocks go: unclosed elements end with their parent, script, style and the like (`CODE`)
without an end tag hold the rest of the page, and of others that are left out (`RAW`) only the tag goes then. Formulas
and what ``object`` holds are text. Elements may be nested to any depth. Repeated rows are treated alike. Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import staged

MANY = 5

BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style textarea xmp".split())
RAW = CODE | frozenset("title noscript template iframe noembed noframes svg annotation annotation-xml".split())
#: an element of the key's name ends open ones of the first set, up to one of the second
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
DROP_TAGS = frozenset("head nav aside footer form button select dialog menu".split())
#: words in a class, id or role that mark what is not content
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar complementary footer contentinfo masthead comment comments reply replies disqus respond cookie cookies consent gdpr notice "
    "notices alert share sharing social related recommended newsletter subscribe signup login popup modal overlay toolbar pagination pager "
    "search skip".split())
#: words that say nothing of what an element is
NEUTRAL = frozenset("area bar block box button buttons container count form icons item items link links list panel section slot thread unit widget wrap wrapper".split())
CONTENT_TAGS = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_NAMES = re.compile(r"[a-z]+(?:[-_][a-z]+)*")
#: a class that says what an element has or lacks is one word: it names no such element
_MODIFIED = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_]off")


def label_of(tag: str, attrs: str) -> str:
    """Tag with the names of its class, id and role; digits are left out."""
    if "=" not in attrs:
        return tag
    names = [c for m in _ATTR.finditer(attrs) for c in (m[2] or m[3] or m[4] or "").lower().split()]
    words = sorted({w for c in names for w in (["".join(_NAME.findall(c))] if _MODIFIED.fullmatch(c) else _NAMES.findall(c))} - {""})
    return ".".join([tag, *words])


def parse(page: str) -> list:
    """Tree of ``[label, children]``; leaves are ``("#" or "#a", text)``, "#a" where most of it is links."""
    root = ["html", []]
    tags, stack = ["html"], [root]
    text, linked, in_link = [], 0, 0
    at, end = 0, len(page)

    def flush():
        nonlocal linked
        if text:
            run = " ".join(html_lib.unescape("".join(text)).split())
            if run:
                stack[-1][1].append(("#a" if 2 * linked > len(run) else "#", run))
            text.clear()
            linked = 0

    def close(to: int):
        flush()
        del tags[to:], stack[to:]

    def add(piece: str):
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece.strip())

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] == tag:
                        close(i)
                        in_link = 0
                        break
                else:
                    flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                if stop is None:
                    if tag in CODE:
                        break
                    continue
                close_at = page.find(">", stop.end())
                at = end if close_at < 0 else close_at + 1
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if tag in ("html", "body") and tag in tags:
                continue
            if tags[-1] == "p":
                close(len(tags) - 1)
            if tag in ENDS:
                ends, within = ENDS[tag]
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] in within:
                        break
                    if tags[i] in ends:
                        close(i)
                        break
            if tag in VOID:
                continue
            node = [label_of(tag, m[3]), []]
            stack[-1][1].append(node)
            tags.append(tag)
            stack.append(node)
    flush()
    return root


def shape_of(root: list) -> tuple[str, list[int], list[str]]:
    """The folded shape, and for each text run its leaf in the shape and the text, in page order."""
    level, depth = [root], 0
    while level:
        level, depth = [c for n in level if type(n) is list for c in n[1]], depth + 1
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * depth + 1000))

    def walk(node):
        """(shape, leaves in it, runs as (leaf, text)); childless elements are left out"""
        if type(node) is tuple:
            return node[0], 1, [(0, node[1])]
        parts, leaves, runs, before = [], 0, [], None
        for child in node[1]:
            got = walk(child)
            if got is None:
                continue
            form, n, own = got
            if form != before:
                parts.append(form)
                base, before = leaves, form
                leaves += n
            runs += [(base + k, t) for k, t in own]
        return (f"{node[0]}({' '.join(parts)})", leaves, runs) if parts else None

    got = walk(root)
    if got is None:
        return "", [], []
    return got[0], [k for k, _ in got[2]], [t for _, t in got[2]]


def read_shape(shape: str) -> tuple:
    """A shape string as ``(label, children, first leaf, leaves)``."""
    pos = leaf = 0

    def node():
        nonlocal pos, leaf
        start = pos
        while pos < len(shape) and shape[pos] not in "() ":
            pos += 1
        label = shape[start:pos]
        first = leaf
        if pos < len(shape) and shape[pos] == "(":
            pos += 1
            children = [node()]
            while shape[pos] == " ":
                pos += 1
                children.append(node())
            pos += 1
            return label, tuple(children), first, leaf - first
        leaf += 1
        return label, (), first, 1

    return node()


def _deep(shape: str) -> None:
    """Lets the walks below call themselves once or twice per level of a shape."""
    level = most = 0
    for c in re.findall(r"[()]", shape):
        level += 1 if c == "(" else -1
        most = max(most, level)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * most + 1000))


def _kinds(root: tuple, known: dict, kinds: dict) -> None:
    """Numbers equal subtrees alike; ``kinds``: (number, nodes) by id of the node."""
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if ready or not node[1]:
            key = node[0], tuple(kinds[id(c)][0] for c in node[1])
            kinds[id(node)] = known.setdefault(key, len(known)), 1 + sum(kinds[id(c)][1] for c in node[1])
        else:
            todo.append((node, True))
            todo += [(c, False) for c in node[1]]


def tree_match(a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest top-down order-preserving match, and its pairs of leaves.

    Equal subtrees match whole. Of others, each pair of different kinds is aligned once; an alignment of m and n children
    takes m passes over rows of n numbers and keeps every square root of m-th row, the others are made again on the way back.
    """
    known: dict[tuple, int] = {}
    kinds: dict[int, tuple[int, int]] = {}
    _kinds(a, known, kinds)
    _kinds(b, known, kinds)
    memo: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    none = np.zeros((0, 2), np.int64)

    def leaves(x):
        todo, out = [x], []
        while todo:
            n = todo.pop()
            todo += reversed(n[1])
            if not n[1] and n[0].startswith("#"):
                out.append(n[2] - x[2])
        return np.repeat(np.array(out, np.int64)[:, None], 2, axis=1)

    def align(x, y):
        m, n = len(x[1]), len(y[1])
        (cx, ix, jx), (cy, iy, jy) = (np.unique([kinds[id(c)][0] for c in z[1]], return_index=True, return_inverse=True) for z in (x, y))
        worth = np.zeros((len(cx), len(cy)), np.int64)
        for i, p in enumerate(ix):
            for j, q in enumerate(iy):
                if x[1][p][0] == y[1][q][0]:
                    worth[i, j] = match(x[1][p], y[1][q])[0]
        if not worth.any():
            return 1, none

        def row(before, i):
            out = np.zeros(n + 1, np.int64)
            out[1:] = np.maximum.accumulate(np.maximum(before[1:], before[:-1] + worth[jx[i]][jy]))
            return out

        step = isqrt(m) + 1
        now, saved = np.zeros(n + 1, np.int64), []
        for i in range(m):
            if i % step == 0:
                saved.append(now)
            now = row(now, i)
        size, i, j, pairs = int(now[n]) + 1, m, n, []
        while i and j:
            low = (i - 1) // step * step
            rows = [saved[low // step]]
            for k in range(low, i):
                rows.append(row(rows[-1], k))
            while i > low and j:
                best = rows[i - low]
                if best[j] == rows[i - 1 - low][j]:
                    i -= 1
                elif best[j] == best[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    p, q = x[1][i], y[1][j]
                    pairs.append(match(p, q)[1] + [p[2] - x[2], q[2] - y[2]])
        return size, np.concatenate([none, *reversed(pairs)])

    def match(x, y):
        """Size, and pairs of leaves counted from the first of each."""
        if x[0] != y[0]:
            return 0, none
        key = kinds[id(x)][0], kinds[id(y)][0]
        if key not in memo:
            if key[0] == key[1]:
                memo[key] = kinds[id(x)][1], leaves(x)
            elif not x[1] or not y[1]:
                memo[key] = 1, none
            else:
                memo[key] = align(x, y)
        return memo[key]

    size, pairs = match(a, b)
    return size, [tuple(p) for p in pairs.tolist()]


def _named(label: str, inside: bool = False) -> bool:
    """Does a name mark what is not content? Inside of content all words of the name must."""
    for name in label.split(".")[1:]:
        words = {w for w in re.split("[-_]", name) if len(w) > 1}
        if words & DROP_NAMES and (not inside or words <= DROP_NAMES | NEUTRAL):
            return True
    return False


def _dropped(label: str, inside: bool) -> bool:
    tag = label.split(".")[0]
    return tag in DROP_TAGS or (tag == "header" and not inside)


def _frames(tree: tuple) -> set[int]:
    """Ids of the nodes that names do not drop: see the module's point 3."""
    mains, articles, path = [], [], []

    def walk(node, outer):
        tag = node[0].split(".")[0]
        if not node[1] or tag in DROP_TAGS:
            return
        path.append(node)
        if tag == "main":
            mains.append(list(path))
        elif tag == "article" and outer:
            articles.append(list(path))
        for c in node[1]:
            walk(c, outer and tag != "article")
        path.pop()

    walk(tree, True)
    free = {id(p[-1]) for p in mains}
    if any(not _named(p[-1][0]) for p in articles):
        articles = [p for p in articles if not _named(p[-1][0])]
    free |= {id(p[-1]) for p in articles}
    paths = mains or articles
    if paths:
        free |= set.intersection(*({id(n) for n in p} for p in paths))
    return free


def wrapper(shape: str, seed: str) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """Per leaf of the shape: its slot in the seed (-1: none), and whether it may be content."""
    if not shape:
        return (), ()
    _deep(shape)
    _deep(seed)
    tree = read_shape(shape)
    slots = [-1] * tree[3]
    for x, y in tree_match(tree, read_shape(seed))[1]:
        slots[x] = y
    keep, inside_any = [False] * tree[3], []
    free = _frames(tree)

    def walk(node, inside, dropped):
        label, children, first, _ = node
        if label.startswith("#") and not children:
            keep[first] = not dropped
            inside_any.append((first, inside and not dropped, label == "#a"))
            return
        named = _named(label, inside) and label.split(".")[0] not in ("html", "body") and id(node) not in free
        dropped = dropped or named or _dropped(label, inside)
        inside = inside or (label.split(".")[0] in CONTENT_TAGS and not dropped)
        for c in children:
            walk(c, inside, dropped)

    walk(tree, False, False)
    framed = any(i for _, i, _ in inside_any)
    for leaf, inside, links in inside_any:
        keep[leaf] = keep[leaf] and (inside if framed else not links)
    return tuple(slots), tuple(keep)


PARSED = "id long, url string, host string, shape string, leaf array<int>, run array<string>"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """``id, url, html`` to `PARSED`."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [shape_of(parse(h)) if h else ("", [], []) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), part.column("host"), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                    ["id", "url", "host", "shape", "leaf", "run"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host")
    return pages.select("id", "url", host, "html").mapInArrow(run, PARSED)


def induced(trees: DataFrame) -> DataFrame:
    """``host, shape, slots, keep, constant``: the wrapper of each shape of each host; ``constant`` lists the
    host's (slot, text hash) pairs that belong to its template. ``trees``: ``host, shape, leaf, hashes``."""
    light = staged(trees.groupBy("host", "shape", "leaf", "hashes").agg(F.count(F.lit(1)).alias("copies")), "distinct-pages")
    shapes = light.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    shapes = staged(shapes, "shapes")
    # the least of the most frequent shapes, by string
    top = shapes.groupBy("host").agg(F.max("n").alias("n"), F.sum("n").alias("pages"))
    seeds = shapes.join(top, ["host", "n"]).groupBy("host").agg(F.min("shape").alias("seed"), F.first("pages").alias("pages"))
    pairs = shapes.select("host", "shape").join(staged(seeds, "seeds"), "host")

    def align(batches):
        for batch in batches:
            got = [wrapper(s, seed) for s, seed in zip(batch.column("shape").to_pylist(), batch.column("seed").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("shape"), batch.column("pages"), pa.array([list(g[0]) for g in got], pa.list_(pa.int32())),
                 pa.array([list(g[1]) for g in got], pa.list_(pa.bool_()))], ["host", "shape", "pages", "slots", "keep"])

    wrappers = staged(pairs.select("host", "shape", "seed", "pages").mapInArrow(align, "host string, shape string, pages long, slots array<int>, keep array<boolean>"), "wrappers")
    spots = light.join(wrappers.where(F.col("pages") >= MANY), ["host", "shape"]).select(
        "host", "pages", F.explode(F.array_distinct(F.zip_with("leaf", "hashes", lambda k, h: F.struct(F.get("slots", k).alias("slot"), h.alias("h"))))).alias("s"))
    counts = spots.where("s.slot >= 0").groupBy("host", "pages", "s").agg(F.count(F.lit(1)).alias("n"))
    # at most 10 / 9 texts for each slot of a seed pass
    constant = counts.where((F.col("n") >= MANY) & (10 * F.col("n") >= 9 * F.col("pages"))).groupBy("host").agg(F.collect_list("s").alias("constant"))
    return wrappers.drop("pages").join(constant, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id, url, text`` per page."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    trees = parsed(base)
    hashes = F.transform("run", lambda r: F.xxhash64(r)).alias("hashes")
    wrappers = staged(induced(staged(trees.select("host", "shape", "leaf", hashes), "trees")), "page-wrappers")
    met = trees.join(wrappers, ["host", "shape"], "left")
    runs = F.zip_with("leaf", "run", lambda k, r: F.struct(k.alias("k"), r.alias("r")))
    stays = lambda x: F.get("keep", x["k"]) & ~F.exists(
        "constant", lambda c: (c["slot"] == F.get("slots", x["k"])) & (c["h"] == F.xxhash64(x["r"])))
    free = lambda x: F.get("keep", x["k"])
    chosen = F.when(F.col("constant").isNull(), F.filter(runs, free)).otherwise(F.filter(runs, stays))
    text = F.coalesce(F.array_join(F.transform(chosen, lambda x: x["r"]), "\n"), F.lit(""))
    return met.select("id", "url", text.alias("text"))
