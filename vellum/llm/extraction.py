"""HTML extraction with a site style tree.

The DOMs of a host's different pages are merged into one tree. A node is a path of elements, each a
tag with its first class (digits left out), from the root down; text that stands in an element is a
leaf below it. Of each node the tree holds how many pages have it, in which presentations (the set
of its children on a page), and of a leaf its contents. Importance, from 0 for what every page
repeats to 1 for what differs everywhere, is an entropy over the pages, relative to the most that so many could have:

- of a leaf, that of its contents;
- of an inner node, its presentations' entropy with the weight 1 - GAMMA^l, l being their number, and
  with GAMMA^l the mean, over pages and children, of its children's importance. This composite comes
  from the bottom up; each node's part reaches an ancestor multiplied by the weights on the way,
  so all of them are summed at once, without a round per level.

What few pages have is judged by the branch it stands in: from the root down, a node's importance is
averaged with its parent's, the latter with the weight of KNOWN pages. The role of an element is a prior
to the result, its weight (WEIGHTS): menus, adverts, footers and text made of links weigh so little that
no importance outweighs it, as statistics tell nothing of an advert that differs on every page; text inside
an article or main element weighs most; the rest of such a page weighs less, and what is not known of it
counts against it. Text with a weighted importance below LEAST_IMPORTANCE goes, and so does one content that
a REPEATED_SHARE of the pages with its leaf, less two, repeat there.

A page is parsed once, into numbers of nodes and contents beside its texts, and its text is put together
from these. Statistics are counts over the different pages of a host, so copies of a page do not make
it boilerplate; they are pre-aggregated before the shuffle, by (host, node), so a host with a third of
the pages is no hot group. Blocks on which the tree overrules the prior go back to their pages; they are
broadcast only if they are few.

Defined cases: a null html is empty and has an empty text; a very long one is one page, its blocks held by one
task; below MAX_DEPTH elements are part of the node above; a null url is the host ''; on a host of few pages
the prior all but decides; unclosed and stray tags are taken as browsers do; pages that repeat, a page_id or
all of it, or one host's pages with equal html, count once in the tree and each get their text; contents that
tie are all kept or all removed; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GAMMA = 0.9
KNOWN = 8
LEAST_IMPORTANCE = 0.3
REPEATED_SHARE = 0.5
LINKED = 0.6
MAX_DEPTH = 24
#: Characters of pages that a worker holds at a time.
SLICE = 1 << 20
#: Weight of a block's importance by its role: in what surrounds an article, beside an article or main element, on a page without one, inside one.
AROUND, BESIDE, PLAIN, INSIDE = range(4)
WEIGHTS = (0.25, 0.5, 1.0, 2.0)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img script style textarea template svg button select iframe object canvas noscript".split())
#: Elements whose text nobody reads as text, and elements that surround an article.
UNSEEN = {"script", "style", "textarea", "title", "xmp", "head", "noscript", "template", "svg", "button", "select", "iframe", "dialog", "object", "canvas"}
BORDERS = {"nav", "footer", "aside", "form", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Parts of class names and ids of what surrounds an article.
NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer foot gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay paginate pagination pager popup promo promotion promoted recommended reader-comments related reply replies respond responses search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th", "blockquote", "figure", "details"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}




@dataclass
class Block:
    node: int  # its leaf
    text: str
    inside: bool  # an article or main element
    linked: float  # share of its characters that are in links
    role: int = PLAIN


@dataclass
class Page:
    """A page's nodes (path, parent's number; the first is the root) and its blocks of text, in page order."""

    paths: list[str] = field(default_factory=lambda: [""])
    up: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    number: dict[str, int] = field(default_factory=lambda: {"": 0})
    blocks: list[Block] = field(default_factory=list)

    def below(self, at: int, label: str) -> int:
        path = f"{self.paths[at]}/{label}"
        if path not in self.number:
            self.number[path] = len(self.paths)
            self.paths.append(path)
            self.up.append(at)
            self.depth.append(self.depth[at] + 1)
        return self.number[path]

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.paths]
        for k, u in enumerate(self.up[1:], 1):
            out[u].append(k)
        return out


def _attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): markup.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(said)} if said.strip() else {}


SEEN, SURROUNDS, HIDDEN = range(3)


def _state(tag: str, a: dict[str, str], inside: bool) -> int:
    if tag in UNSEEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return HIDDEN
    if tag in BORDERS or tag == "header" and not inside or a.get("role", "").lower() in ROLES:
        return SURROUNDS
    if tag in ("html", "body", "main", "article"):
        return SURROUNDS if {*a.get("class", "").lower().split()} & {"comment", "reply"} else SEEN
    names = re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower())
    return SURROUNDS if any(x in NAMES and not (inside and x == "header") for x in names) else SEEN


def blocks(page: str) -> list[Block]:
    """The blocks of text that the prior alone chooses, in page order."""
    return [b for b in parse(page).blocks if b.role >= PLAIN]


def parse(page: str) -> Page:
    out = Page()
    stack: list[tuple[str, int, int, bool]] = [("", 0, SEEN, False)]  # tag, node, state, inside
    parts: list[str] = []
    in_link = held = links = 0

    def end() -> None:
        nonlocal held, links
        text = " ".join("".join(parts).split())
        if text and stack[-1][2] != HIDDEN:
            block = Block(out.below(stack[-1][1], "#"), text, stack[-1][3], links / max(1, held))
            block.role = AROUND if stack[-1][2] == SURROUNDS or block.linked >= LINKED and not block.inside else INSIDE if block.inside else PLAIN
            out.blocks.append(block)
        parts.clear()
        held = links = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        if any(s[0] not in INLINE for s in stack[k:]):
            end()
        in_link -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal held, links
        if raw and stack[-1][2] != HIDDEN:
            parts.append(markup.unescape(raw))
            held += len(raw)
            links += len(raw) if in_link else 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if k:
                pop_to(k)
            elif tag in ("p", "br"):
                end()
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                end()
            continue
        shut = {"p"} if tag in ENDS_P else CLOSES.get(tag, set())
        if tag in CLOSES:
            shut = shut | CLOSES[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in shut:
                pop_to(i)
                if tag != "tr":
                    break
            elif stack[i][0] in SCOPE:
                break
        if tag not in INLINE:
            end()
        a = _attributes(m[3] or m[6] or "")
        up = stack[-1]
        inside = up[3] or tag in ("article", "main") or a.get("role", "").lower() == "main"
        if tag == "a":
            in_link += 1
        state = max(up[2], _state(tag, a, up[3]))
        node = up[1]
        if tag not in INLINE and state != HIDDEN and out.depth[node] < MAX_DEPTH:
            first = (a.get("class", "").split() or [""])[0]
            node = out.below(node, f"{tag}.{re.sub(r'[0-9]+', '', first)}" if first else tag)
        stack.append((tag, node, state, inside))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
            pop_to(len(stack) - 1)
    end()
    if any(b.role == INSIDE for b in out.blocks):
        for b in out.blocks:
            b.role = BESIDE if b.role == PLAIN else b.role
    return out


def host() -> Column:
    return F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _number(said: str) -> int:
    return int.from_bytes(blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PARSED = (
    "page_id long, url string, pk long, host string, page long, nodes array<struct<id:long,up:long,style:int,share:double>>, "
    "blocks array<struct<node:long,content:long,role:int,once:boolean>>, texts array<string>, id long, chain array<long>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> a row per page (PARSED without id and chain), and rows of id and chain, the nodes from the root to each; with a text for each block that may stay."""

    def batch_of(given: pa.RecordBatch, held: list[Page], ids: dict[str, int]) -> pa.RecordBatch:
        node, block, texts = ([], [], [], []), ([], [], [], []), []
        ends = [[0], [0]]
        new: dict[int, list[int]] = {}
        for page in held:
            kids, mine = page.children(), []
            for k, path in enumerate(page.paths):
                known = ids.get(path)
                if known is None:
                    known = ids[path] = _number(path)
                    new[known] = [*(new_chain[mine[page.up[k]]] if k else []), known]
                    new_chain[known] = new[known]
                mine.append(known)
            for k, (x, u) in enumerate(zip(mine, page.up)):
                style = zlib.crc32("|".join(sorted(page.paths[c].rpartition("/")[2] for c in kids[k])).encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
                for column, value in zip(node, (x, mine[u] if k else None, style, 1 / len(kids[u]) if k else 1.0)):
                    column.append(value)
            seen: set = set()
            for b in page.blocks:
                content = _number(b.text)
                for column, value in zip(block, (mine[b.node], content, b.role, (b.node, content) not in seen)):
                    column.append(value)
                seen.add((b.node, content))
                texts.append(None if b.role == AROUND else b.text)
            ends[0].append(len(node[0]))
            ends[1].append(len(block[0]))
        extra = len(new)
        at = [pa.array(e + [e[-1]] * extra, pa.int32()) for e in ends]
        types = ((pa.int64(), pa.int64(), pa.int32(), pa.float64()), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))
        lists = [
            pa.ListArray.from_arrays(a, pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names))
            for a, cols, kinds, names in zip(at, (node, block), types, (("id", "up", "style", "share"), ("node", "content", "role", "once")))
        ]
        lists.append(pa.ListArray.from_arrays(at[1], pa.array(texts, pa.string())))
        old = [pa.concat_arrays([given.column(c), pa.nulls(extra, given.column(c).type)]) for c in range(5)]
        n = len(held)
        own = [pa.array([None] * n + [*new], pa.int64()), pa.array([None] * n + [*new.values()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*old, *lists, *own], ["page_id", "url", "pk", "host", "page", "nodes", "blocks", "texts", "id", "chain"])

    new_chain: dict[int, list[int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        new_chain.clear()
        for batch in batches:
            begin, size, held = 0, 0, []
            for i, said in enumerate(batch.column(5)):
                text = said.as_py()
                held.append(parse(text))
                size += len(text)
                if size >= SLICE or i == batch.num_rows - 1:
                    yield batch_of(batch.slice(begin, len(held)), held, ids)
                    begin, size, held = i + 1, 0, []
                if len(ids) > 200_000:  # paths that are told again are told alike
                    ids.clear()
                    new_chain.clear()
        common.release()

    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("url", html).alias("pk"), host().alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))
    return rows.mapInArrow(run, PARSED)


def _entropy(total: Column, logs: Column) -> Column:
    """Of counts that sum to total, with logs the sum of c * log(c), relative to that of so many different things."""
    return F.when(total > 1, (F.log(total) - logs / total) / F.log(total)).otherwise(1.0)


def style_tree(pages: DataFrame, chains: DataFrame, gamma: float = GAMMA, known: float = KNOWN) -> tuple[DataFrame, DataFrame]:
    """The tree of each host. pages: host, page, nodes, blocks; chains: id, chain.

    Returns nodes (host, id, held: pages, importance: composite, from_one and from_none: averaged down from a
    root of importance 1 and 0) and contents (host, node, content, n: pages).
    """
    each = common.table(pages.select("host", "page", "nodes", "blocks").dropDuplicates(["host", "page"]), "style-pages")
    styles = each.select("host", F.explode("nodes").alias("x")).groupBy("host", "x.id", "x.up", "x.style").agg(F.count("*").alias("n"), F.sum("x.share").alias("w"))
    nodes = styles.groupBy("host", "id", "up").agg(F.sum("n").alias("held"), F.sum("w").alias("w"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("logs"))
    contents = each.select("host", F.explode("blocks").alias("x")).where("x.once").groupBy("host", "x.node", "x.content").agg(F.count("*").alias("n"))
    contents = common.table(contents, "style-contents")
    leaves = contents.groupBy(F.col("host").alias("f_host"), F.col("node").alias("f_id")).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("f_logs"))
    nodes = nodes.join(leaves, (F.col("host") == F.col("f_host")) & (F.col("id") == F.col("f_id")), "left")
    turns = F.pow(F.lit(gamma), F.col("l"))
    leaf = F.col("f_id").isNotNull()
    own = F.when(leaf, _entropy(F.col("all"), F.col("f_logs"))).otherwise((1 - turns) * _entropy(F.col("held"), F.col("logs")))
    nodes = common.table(nodes.select("host", "id", "up", "held", "w", turns.alias("turns"), own.alias("own")), "style-nodes")
    above = nodes.select(F.col("host").alias("a_host"), F.col("id").alias("a_id"), (F.col("turns") / F.col("held")).alias("share"))
    nodes = nodes.join(above, (F.col("host") == F.col("a_host")) & (F.col("up") == F.col("a_id")), "left")
    nodes = common.table(nodes.select("host", "id", "held", "own", (F.col("w") * F.coalesce("share", F.lit(0.0))).alias("climb")), "style-weights")
    chains = common.table(chains.where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("c_id"), "chain"), "style-chains")

    def along(value: DataFrame, *names: str) -> DataFrame:
        """Each node with what its ancestors and itself have, from the root down."""
        rows = common.join_small(nodes, chains, F.col("id") == F.col("c_id")).select("host", "id", "own", F.posexplode("chain").alias("pos", "x_id"))
        value = value.select(F.col("host").alias("v_host"), F.col("id").alias("v_id"), *names)
        rows = rows.join(value, (F.col("host") == F.col("v_host")) & (F.col("x_id") == F.col("v_id")))
        return rows.groupBy("host", "id", "own").agg(F.array_sort(F.collect_list(F.struct("pos", "x_id", *names))).alias("way"))

    # from each node upwards, with the product of the weights below
    step = lambda acc, e: F.struct((acc["x"] * e["climb"]).alias("x"), F.concat(acc["out"], F.array(F.struct(e["x_id"].alias("id"), acc["x"].alias("x")))).alias("out"))
    start = F.struct(F.lit(1.0).alias("x"), F.array().cast("array<struct<id:long,x:double>>").alias("out"))
    reach = along(nodes, "climb").select("host", "own", F.explode(F.aggregate(F.reverse("way"), start, step)["out"]).alias("r"))
    whole = reach.groupBy("host", F.col("r.id").alias("id")).agg(F.sum(F.col("own") * F.col("r.x")).alias("importance"))
    held = nodes.select(F.col("host").alias("h_host"), F.col("id").alias("h_id"), "held")
    whole = common.table(whole.join(held, (F.col("host") == F.col("h_host")) & (F.col("id") == F.col("h_id"))).select("host", "id", "held", "importance"), "style-whole")
    down = lambda first: F.aggregate("way", F.lit(first), lambda s, e: (e["held"] * e["importance"] + known * s) / (e["held"] + known))
    judged = along(whole, "held", "importance").select("host", "id", F.element_at("way", -1)["held"].alias("held"), F.element_at("way", -1)["importance"].alias("importance"), down(1.0).alias("from_one"), down(0.0).alias("from_none"))
    return common.table(judged, "style-judged"), contents


def overruled(pages: DataFrame, judged: DataFrame, contents: DataFrame, least: float = LEAST_IMPORTANCE, share: float = REPEATED_SHARE) -> DataFrame:
    """pid, g_pk, turned: the numbers of the blocks on which the tree decides against the prior."""
    leaf = judged.select(F.col("host").alias("l_host"), F.col("id").alias("l_id"), "held", "from_one", "from_none")
    often = contents.join(leaf, (F.col("host") == F.col("l_host")) & (F.col("node") == F.col("l_id"))).where(F.col("n") - 2 >= F.lit(share) * F.col("held"))
    often = common.table(often.select(F.col("host").alias("o_host"), F.col("node").alias("o_node"), F.col("content").alias("o_content")), "style-repeated")
    low = [F.col("from_none") * WEIGHTS[BESIDE] < least, F.col("from_one") * WEIGHTS[PLAIN] < least, F.col("from_one") * WEIGHTS[INSIDE] < least]
    judged = leaf.select("l_host", "l_id", F.array_compact(F.array(*[F.when(x, F.lit(r)) for r, x in zip((BESIDE, PLAIN, INSIDE), low)])).alias("gone"))
    judged = common.table(judged.where(F.array_contains("gone", PLAIN) | ~F.array_contains("gone", BESIDE)), "style-gone")
    rows = pages.select("page_id", "pk", "host", F.posexplode("blocks").alias("number", "x")).select("page_id", "pk", "host", "number", "x.node", "x.content", "x.role").where(F.col("role") > AROUND)
    rows = common.join_small(rows, judged, (F.col("host") == F.col("l_host")) & (F.col("node") == F.col("l_id")), "left")
    rows = common.join_small(rows, often, (F.col("host") == F.col("o_host")) & (F.col("node") == F.col("o_node")) & (F.col("content") == F.col("o_content")), "left")
    unknown = F.col("role") == BESIDE  # leaves that are not in the table go by the prior
    gone = F.col("o_host").isNotNull() | F.when(F.col("gone").isNull(), unknown).otherwise(F.array_contains("gone", F.col("role")))
    rows = rows.where(gone != unknown)
    return common.table(rows.groupBy(F.col("page_id").alias("pid"), F.col("pk").alias("g_pk")).agg(F.collect_set("number").alias("turned")), "style-turned")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    every = common.table(parsed(pages), "style-parsed")
    rows = every.where("id IS NULL")
    turned = common.settled("style-overruled", lambda: overruled(rows, *style_tree(rows, every.select("id", "chain"))))
    rows = common.join_small(rows.select("page_id", "url", "pk", "blocks", "texts"), turned, F.col("page_id").eqNullSafe(F.col("pid")) & (F.col("pk") == F.col("g_pk")), "left")
    other = F.coalesce("turned", F.array().cast("array<int>"))
    stays = F.transform("blocks", lambda b, i: (b["role"] > AROUND) & ((b["role"] >= PLAIN) != F.array_contains(other, i)))
    text = F.array_join(F.filter("texts", lambda t, i: F.get(stays, i)), " ")
    return rows.select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
