"""Main text of web pages by a site style tree.

The pages of a host (of all hosts with few pages together) are merged: nodes with the same path of presentations (element, classes, id, role) are one
node of the tree, and grouped sums give the entropy of the presentations below it and of the contents below it
over the host's pages.  A node whose pages agree in both is of low importance, and so is one content of a node
that most of the node's pages share (a notice in a plain paragraph of the article); such branches are removed.
Every node with text is judged, around the article and in it.  What a presentation's name tells (menus, footers,
adverts, forms, comments and so on) is the prior: importance zero, since sites also fill such branches anew on
every page, which no entropy shows.  An article of low importance is the main text only if there is no other.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import arrow_map, checkpointed, pick

#: A node is judged if it is on at least so many distinct pages; hosts with fewer pages share one tree.
LEAST_PAGES = 8
#: Normalised entropies below this are low.
LOW = 0.2
#: Most low nodes that are sent to all tasks; beyond it they are joined by host.
MOST_SENT = 20_000

_NAME = r"[a-zA-Z][^\s/>]*"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)({_NAME})((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)({_NAME})([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, with content that is no markup, that end a paragraph, and the
# elements that an opening tag closes, with those that stop the search.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPAQUE = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset({"table", "td", "th", "article", "section", "div", "body", "html", "li", "blockquote", "main", "aside", "nav", "footer", "header"})
_PHRASE = frozenset("td th tr b i em strong a span u s sub sup small code q cite mark".split())

# Presentations of importance zero: elements, roles, and parts of class names and ids.
_CHROME = frozenset("nav footer aside form button select input dialog menu svg canvas object audio video head fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "comment comments reply replies respond disqus cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription share sharing social "
    "related recommended widget login signup signin search pagination pager toolbar copyright masthead topbar".split()
)
# Words of class names and ids that say how a part is laid out, not what it is.
_NEUTRAL = frozenset(
    "box boxes bar list lists slot wrapper wrap container block blocks unit units item items posts section area link links button buttons inner outer form row col column grid panel "
    "title header heading top bottom left right label count icon icons js fixed sticky small large".split()
)
#: Modulus and base of the rolling hash over words and paths.
_MODULUS, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


class _Rolling:
    """Hashes of any span of a sequence of whole numbers, from the hashes of its beginnings."""

    def __init__(self, values):
        self.sums, self.powers = [0], [1]
        for v in values:
            self.sums.append((self.sums[-1] * _BASE + v + 1) % _MODULUS)
            self.powers.append(self.powers[-1] * _BASE % _MODULUS)

    def span(self, lo: int, hi: int) -> bytes:
        return ((self.sums[hi] - self.sums[lo] * self.powers[hi - lo]) % _MODULUS).to_bytes(8, "big") + (hi - lo).to_bytes(8, "big")


#: Host of a URL, without user and port.
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]*)"


def host_of(url: str) -> Column:
    """Null where the URL has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


class Page:
    """Nodes in page order (parent, tag, label, path) and items: (node, text), with None as text where a block ends."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.path = [-1], ["#"], ["#"], [0]
        self.last = [0]  # the last node below each
        self.begin, self.end = [0], [0]  # the items below each
        self.hidden = [False]
        self.within = [False]  # an article or a main element
        self.items: list[tuple[int, str | None]] = []
        self._contents: list[int] | None = None
        self._read(source)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        label, hidden = tag, False
        if attributes and not attributes.isspace():
            found: dict[str, str] = {}
            for name, value in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), value.strip("\"'"))
            for name in ("class", "id", "role"):
                if found.get(name):
                    label += {"class": ".", "id": "#", "role": "@"}[name] + ".".join(sorted(re.sub(r"\d+", "", html.unescape(found[name])).split()))
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        up = stack[-1]
        self.parent.append(up)
        self.tag.append(tag)
        self.label.append(label)
        self.path.append(xxhash.xxh3_64_intdigest(label, self.path[up]))
        self.hidden.append(hidden)
        self.within.append(self.within[up] or self.tag[up] in ("article", "main"))
        self.begin.append(len(self.items))
        self.end.append(len(self.items))
        self.last.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, at, items, tag_of = [0], 0, self.items, self.tag
        n = len(source)
        opened: Counter[str] = Counter()  # elements of the stack by tag: what is not open needs no search

        def close(to: int) -> None:
            for x in stack[to:]:
                self.end[x] = len(items)
                opened[tag_of[x]] -= 1
            if any(tag_of[x] in _BLOCK for x in stack[to:]):
                items.append((stack[to], None))
            del stack[to:]

        while at < n:
            m = _TOKEN.match(source, at)
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                text = m.group()
                if not (text.startswith(("<!", "<?")) and len(text) > 1):
                    items.append((stack[-1], html.unescape(text) if "&" in text else text))
                continue
            tag = name.lower()
            if m.group(1) or m.group(4):
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if tag_of[stack[k]] == tag:
                        close(k)
                        break
                    if tag not in _BLOCK and tag_of[stack[k]] in _SCOPE:
                        break
                continue
            if tag == "br" or tag in ("td", "th"):
                items.append((stack[-1], " "))
            if tag in _BLOCK or tag in _CLOSES:
                ends, stops = _CLOSES.get(tag, (set(), set()))
                searched = opened["p"] and tag in _BLOCK or any(opened[e] for e in ends)
                for k in range(len(stack) - 1, 0, -1) if searched else ():
                    seen = tag_of[stack[k]]
                    if seen in ends or seen == "p" and tag in _BLOCK:
                        close(k)
                        if not ends:
                            break
                    elif seen in stops or seen in _SCOPE and not ends:
                        break
                if tag in _BLOCK:
                    items.append((stack[-1], None))
            node = self._open(tag, m.group(3) or m.group(6) or "", stack)
            if tag in _OPAQUE:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
            elif tag not in _VOID:
                stack.append(node)
                opened[tag] += 1
        for x in stack:
            self.end[x] = len(items)
        for k in range(len(tag_of) - 1, 0, -1):
            up = self.parent[k]
            self.last[up] = max(self.last[up], self.last[k])

    def pure(self, k: int) -> bool:
        """Whether the class, id and role name nothing but what is not the main text, and how it is laid out; single letters name nothing."""
        parts = [p.lower() for p in _PART.findall(self.label[k][len(self.tag[k]) :]) if len(p) > 1]
        return any(p in _PARTS for p in parts) and all(p in _PARTS or p in _NEUTRAL for p in parts)

    def chrome(self, k: int) -> bool:
        """Whether the presentation's own name says that this is not the main text."""
        tag, label = self.tag[k], self.label[k]
        if tag in _CHROME or tag in _OPAQUE or self.hidden[k]:
            return True
        if tag == "header":
            return not self.inside(k)
        if label == tag or tag in ("html", "body"):
            return False
        if tag in ("article", "main"):
            return self.pure(k)
        if "@" in label and label.split("@")[1] in _ROLES:
            return True
        # inside an article a name that tells of anything else is no proof
        return self.pure(k) if self.inside(k) else any(p.lower() in _PARTS for p in _PART.findall(label[len(tag) :]))

    def firm(self, k: int) -> bool:
        """Whether the element itself is out, whatever it holds; a form may stand around a whole page."""
        return self.tag[k] in _OPAQUE or self.tag[k] in _CHROME and self.tag[k] not in ("form", "head") or self.hidden[k]

    def weights(self, out: list[bool]) -> list[int]:
        """Characters below each node, without those of nodes below it that are out."""
        w = [0] * len(self.tag)
        for k, t in self.items:
            if t is not None:
                w[k] += len(" ".join(t.split()))
        for k in range(len(w) - 1, 0, -1):
            if not out[k]:
                w[self.parent[k]] += w[k]
        return w

    def roots(self, chrome: list[bool], weight: list[int], low: list[bool]) -> list[int]:
        """Articles, else main elements, else the body.  Names of wrappers that hold most of the page rule nothing out."""
        n = len(self.tag)
        body = [k for k in range(1, n) if self.tag[k] == "body"][:1] or [0]
        for kind in (lambda k: self.tag[k] == "article", lambda k: self.tag[k] == "main" or "@main" in self.label[k]):
            clean, pure, within, outer = [], [], [], [False] * n
            firm, named = [False] * n, [False] * n
            for k in range(1, n):
                up = self.parent[k]
                around = self.tag[k] in ("html", "body")
                firm[k] = firm[up] or not around and self.firm(k)
                named[k] = named[up] or not around and chrome[k]
                outer[k] = outer[up]
                if kind(k) and not outer[k]:
                    outer[k] = True
                    if not firm[k]:
                        (within if named[up] else pure if chrome[k] else clean).append(k)
            page = weight[body[0]]
            found = clean + [k for k in pure + within if 2 * weight[k] > page]
            found = [k for k in found if not low[k]] or found or pure or (within if 2 * sum(weight[k] for k in within) > page else [])
            if found:
                return sorted(found)
        return body

    def inside(self, k: int) -> bool:
        return self.within[k]

    def states(self, low: frozenset[int] = frozenset()) -> tuple[list[bool], list[bool], list[bool]]:
        """Of each node: dropped by name, inside the main text, and protected (outside of it, or its root)."""
        n = len(self.tag)
        dropped, inside = [False] * n, [False] * n
        chrome = [False, *(self.chrome(k) for k in range(1, n))]
        weight = self.weights([False, *(self.firm(k) for k in range(1, n))])
        named = self.roots(chrome, weight, self.low_ones(low))
        # names judge inside and beside the roots, never what is around them
        spared = set(named)
        for k in named:
            while k > 0:
                k = self.parent[k]
                spared.add(k)
        below: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            below[self.parent[k]].append(k)
        kept = self.weights(chrome)
        for root in named:
            at = root
            while heavy := [k for k in below[at] if 2 * weight[k] > weight[root] and not self.firm(k)]:
                at = heavy[0]
                if chrome[at] and not (self.pure(at) and kept[root]):
                    spared.add(at)
        for k in range(1, n):
            dropped[k] = k not in spared and (dropped[self.parent[k]] or chrome[k])
        roots, protected = set(named), [False] * n
        for k in range(n):
            inside[k] = k in roots or k > 0 and inside[self.parent[k]]
            protected[k] = not inside[k] or k in roots
        return dropped, inside, protected

    def contents(self) -> list[int]:
        """Hash of the path and of the text below each node; 0 where there is none, or the node's parent has the same."""
        if self._contents is None:
            parts: list[str] = []
            before = [0]
            for _, t in self.items:
                parts.extend(t.split() if t is not None else ())
                before.append(len(parts))
            spans = [(before[b], before[e]) for b, e in zip(self.begin, self.end, strict=True)]
            words = _Rolling(map(xxhash.xxh3_64_intdigest, parts))
            self._contents = [
                xxhash.xxh3_64_intdigest(words.span(*spans[k]), self.path[k]) if k and spans[k][0] < spans[k][1] and (not self.parent[k] or spans[k] != spans[self.parent[k]]) else 0
                for k in range(len(self.tag))
            ]
        return self._contents

    def low_ones(self, low: frozenset[int]) -> list[bool]:
        """Whether the path or the content of each node is low; an only child goes with its parent."""
        if not low:
            return [False] * len(self.tag)
        out = [bool(c) and (p in low or c in low) for p, c in zip(self.path, self.contents(), strict=True)]
        for k in range(1, len(out)):
            if not self.contents()[k] and self.begin[k] < self.end[k]:
                out[k] = out[self.parent[k]]
        return out

    def branches(self) -> list[tuple[int, int, int, int, int]]:
        """(path, style, content, how often, 1 for the first content of a path) of the page's nodes: hashes of the presentations and of the text below."""
        out: dict[tuple[int, int], list[int]] = {}
        seen: set[int] = set()
        paths = _Rolling(self.path)
        for k, content in enumerate(self.contents()):
            if content:
                path = self.path[k]
                if (path, content) in out:
                    out[path, content][1] += 1
                    continue
                style = xxhash.xxh3_64_intdigest(paths.span(k, self.last[k] + 1)) if self.last[k] > k else 0
                out[path, content] = [style, 1, int(path not in seen)]
                seen.add(path)
        return [(path, style, content, n, first) for (path, content), (style, n, first) in out.items()]

    def removed(self, low: frozenset[int], states: tuple[list[bool], list[bool], list[bool]]) -> list[bool]:
        """Of each node: in a branch whose path or content is low.  None that holds most of the main text; none at all where less than a quarter would be left.

        A bare phrase or table cell goes with its block only, so that no sentence or row loses a part.
        """
        dropped, inside, protected = states
        n = len(dropped)
        out = [False] * n
        if not low:
            return out
        kept = [0] * n
        for k, t in self.items:
            if t is not None and inside[k] and not dropped[k]:
                kept[k] += len(" ".join(t.split()))
        below = kept.copy()
        for k in range(n - 1, 0, -1):
            below[self.parent[k]] += below[k]
        ones = self.low_ones(low)
        for k in range(1, n):
            out[k] = out[self.parent[k]] or not protected[k] and ones[k] and not (self.tag[k] in _PHRASE and self.label[k] == self.tag[k]) and 2 * below[k] <= below[0]
        gone = sum(x for x, o in zip(kept, out, strict=True) if o)
        return out if 4 * (below[0] - gone) >= below[0] else [False] * n

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The main text without branches whose path or content is low."""
        states = self.states(low)
        dropped, inside = [d or r for d, r in zip(states[0], self.removed(low, states), strict=True)], states[1]
        blocks, open_block = [], []
        for k, t in [*self.items, (0, None)]:
            if t is not None:
                if inside[k] and not dropped[k]:
                    open_block.append(t)
            elif open_block:
                line = " ".join("".join(open_block).split())
                open_block = []
                if line:
                    blocks.append(line)
        return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of pages (host, html): (host, path, pages, m, h_style, h_content) of each node, and (host, path, content, d): on how many pages, and (host): those with a tree of their own.

    Each distinct page of a tree counts once, however often it is repeated.  Pages of hosts with fewer than
    LEAST_PAGES distinct pages, and pages without a host, are in the tree of the host "" together.
    """

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        done, rows = set(), []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = _signed(xxhash.xxh3_64_intdigest(source or ""))
            if (host, page) not in done:
                done.add((host, page))
                rows.extend((host, page, _signed(path), _signed(style), _signed(content), n, first) for path, style, content, n, first in Page(source or "").branches())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.string(), *[pa.int64()] * 6]
        names = ["host", "page", "path", "style", "content", "n", "first"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    fields = "host string, page long, path long, style long, content long, n long, first long"
    own = checkpointed(arrow_map(pages.select("host", "html"), read, fields, rows=500).distinct())
    pages_of = own.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").count()
    large = checkpointed(pages_of.where((F.col("count") >= LEAST_PAGES) & F.col("host").isNotNull()).select("host"))
    small = own.join(large, "host", "left_anti").withColumn("host", F.lit("")).distinct()
    nodes = own.join(large, "host", "left_semi").unionByName(small)
    contents = nodes.groupBy("host", "path", "content").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    styles = nodes.groupBy("host", "path", "style").agg(F.sum("n").alias("n"), F.sum("first").alias("pages"))

    def entropy(one: DataFrame, by: str, *more: Column) -> DataFrame:
        both = one.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"), *more)
        return both.withColumn(f"h_{by}", (F.ln("m") - F.col("s") / F.col("m")) / F.ln(F.greatest("m", F.lit(2)))).drop("s")

    judged = entropy(styles, "style", F.sum("pages").alias("pages")).join(entropy(contents, "content").drop("m"), ["host", "path"])
    return judged, contents, large


def low_nodes(pages: DataFrame) -> DataFrame:
    """(host, low) of pages (host, html): paths, and contents of paths, of low importance in each style tree.

    One row of each host with a tree of its own, and of "" for the others where anything is low in their tree.
    """
    judged, contents, large = style_tree(pages)
    paths = judged.where((F.col("pages") >= LEAST_PAGES) & (F.greatest("h_style", "h_content") < LOW)).select("host", "path")
    # a content spread evenly over d of a node's pages has the normalised entropy ln d / ln pages, and one less that as importance
    shared = contents.where(F.col("d") >= LEAST_PAGES).join(judged.select("host", "path", "pages"), ["host", "path"])
    low = paths.unionByName(shared.where(1 - F.ln("d") / F.ln("pages") < LOW).select("host", F.col("content").alias("path")))
    return low.unionByName(large.withColumn("path", F.lit(None).cast("long"))).groupBy("host").agg(F.collect_set("path").alias("low"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars (code points).

    Text is decoded, white space inside a block is one space, blocks are joined by line breaks in page order.
    With an article (or a main element) the main text is inside it, else in the body.  Null and empty pages
    give an empty text; pages without a host in their URL, and of hosts with fewer than LEAST_PAGES distinct pages,
    are judged by names and one style tree in common;
    null ids and repeated rows pass through; other columns are ignored; an empty table gives an empty table.
    """
    source = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("host", host_of("url"))
    low = checkpointed(low_nodes(source))
    shared = [x for r in low.where("host = ''").collect() for x in r["low"]]
    # hosts of their own tree without low nodes need to be told from the others only where the common tree has low nodes
    low = low.where("host != ''") if shared else low.where(F.size("low") > 0)
    sent = {r["host"]: r["low"] for r in low.collect()} if (low.agg(F.sum(F.size("low") + 1)).first()[0] or 0) <= MOST_SENT else None
    kind = source.schema["id"].dataType.simpleString()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        sources, hosts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        lows = [sent.get(h) for h in hosts] if sent is not None else batch.column(4).to_pylist()
        lows = [shared if x is None else x for x in lows]
        texts = [Page(s or "").text(frozenset(x & 0xFFFFFFFFFFFFFFFF for x in low_of)) for s, low_of in zip(sources, lows, strict=True)]
        data = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.record_batch(data, names=[id_col, url_col, "text", "n_chars"])

    if sent is None:
        source = source.join(low, "host", "left").select("id", "url", "html", "host", "low")
    return arrow_map(source, read, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long", rows=500)
