"""Operator 5, HTML extraction: a site style tree of each host and its low-importance branches.

Pages of one host are merged into a style tree. A node is a path of element labels (tag with its first class or id,
digits masked, and whether the element is the first, the last or another of its label among its siblings). Over the
host's distinct pages, a node's content importance is the entropy of its branch's text, its presentation importance
that of its sequence of children, each as a share of the largest possible over these pages and ``unseen`` more that
are like no other (so a host of a few pages shows little, without a least number of pages). A branch that looks and
reads alike on most pages scores near 0; one below ``least`` is taken out of each page that has it, inside article and
main as well. Entropies come from counts that are pre-aggregated in each task, so a host with a third of all pages is no larger a
group than any other.

What HTML itself says goes first: script, style, nav, aside, form, button and the like, and headers and footers outside
the article are never main text, be they blocks or inside a line of text. Names in class, id or role are evidence in
two grades. A name whose every word tells of a menu, notice, advert, sidebar or comments, or of mere layout
(``sidebar-left``) takes its element out, as does such an element's own article only for comments; a name with such
a word among others (``related-work``) only raises the limit for its branch to ``least_named``. No name takes out html,
body, main or article. Where a page has article or main elements with text, its text is within these.

Tags are read by one pass of a pattern, elements close as HTML lets them (p, li, td ... by the next), and truncated
tags at the end are dropped. Character references are decoded, white space inside a block becomes one blank, blocks
are joined by a newline in page order.

Defined results: null and empty html give empty text; a null url is a host of its own without a tree; repeated rows
each get a row; extra columns are dropped; nesting may have any depth.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, small
from .tokens import chunks

LEAST, LEAST_NAMED, UNSEEN = 0.2, 0.6, 2

TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("aside audio button canvas dialog embed form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split())
OUTSIDE = frozenset("header footer".split())
MAIN = frozenset("article main".split())
#: An opening tag ends the open elements named here, up to the nearest of the barriers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words in class, id or role names (parted at capitals, digits and marks) of what is not main text.
NAMES = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pagination pager popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar topbar widget complementary contentinfo search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Words that tell of layout only.
LAYOUT = frozenset("area bar block body bottom box col column container content form group holder inner item items left line link links list main outer panel right row section side slot text top unit wrap wrapper".split())
PROTECTED = frozenset("html body main article".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NONE, NAMED, COMMENT = 0, 1, 2


def label(tag: str, attrs: str) -> tuple[str, int, bool, bool]:
    """A node's label; what its names take it for; whether some word of a name hints at it; whether it names the main part."""
    if not attrs or "=" not in attrs:
        return tag, NONE, False, False
    names = [(k.lower(), a or b or c) for k, a, b, c in MARK.findall(attrs)]
    if not names:
        return tag, NONE, False, False
    kind, hint = NONE, False
    for _, v in names:
        for token in v.split():
            words = {w.lower() for w in WORD.findall(token)}
            told = words & COMMENTS or words & NAMES
            if told:
                hint = True
                if words <= NAMES | COMMENTS | LAYOUT:
                    kind = max(kind, COMMENT if words & COMMENTS else NAMED)
    if tag in PROTECTED:
        kind, hint = NONE, False
    first = next((v for k, v in names if k == "class" and v.strip()), None)
    text = f"{tag}.{first.split()[0]}" if first else next((f"{tag}#{v}" for k, v in names if k == "id"), tag)
    return DIGITS.sub("0", text), kind, hint, ("role", "main") in names


class Node:
    """An element that can hold blocks."""

    __slots__ = ("parent", "label", "children", "texts", "hint")

    def __init__(self, parent, label, hint=False):
        self.parent, self.label, self.children, self.texts, self.hint = parent, label, [], [], hint
        if parent is not None:
            parent.children.append(self)


class Block:
    __slots__ = ("node", "text", "main")

    def __init__(self, node, text, main):
        self.node, self.text, self.main = node, text, main


def blocks(html: str | None) -> tuple[Node, list[Block]]:
    """The tree of a page and its text blocks in order, without what the tags and whole names take out."""
    root, out = Node(None, ""), []
    if not html:
        return root, out
    # of each open element: tag, node, taken out by a tag, taken out by a name, inside the main part
    stack: list[tuple[str, Node, bool, int, bool]] = [("", root, False, NONE, False)]
    held: list[str] = []
    pos, search = 0, TAG.search

    def hold(text: str):
        _, _, side, named, _ = stack[-1]
        held.append(" " if side or named else unescape(text) if "&" in text else text)

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, node, _, _, main = stack[-1]
                node.texts.append(text)
                out.append(Block(node, text, main))

    def close(i: int):
        if any(e[0] in BLOCK for e in stack[i:]):
            flush()
        del stack[i:]

    while True:
        m = search(html, pos)
        if m is None:
            hold(html[pos:])
            break
        if m.start() > pos:
            hold(html[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends here, with what is open in it
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            flush()
            ends = ENDS.get(tag)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends[1]:
                        break
                    if stack[i][0] in ends[0]:
                        close(i)
                        break
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        _, node, side, named, main = stack[-1]
        own, kind, hint, is_main = label(tag, m[3])
        is_main = is_main or tag in MAIN
        if is_main and named == NAMED:  # a name never hides an article, but those of comments
            named = NONE
        main = main or is_main
        named = max(named, kind)
        side = side or tag in NEVER or (tag in OUTSIDE and (not main or tag == "footer"))
        if tag in BLOCK:
            node = Node(node, own, hint)
        stack.append((tag, node, side, named, main))
    flush()
    return root, out


def merged(root: Node) -> tuple[dict[int, int], dict[int, list]]:
    """The key of each element's path (by id of the node), and of each path its texts, sequence of children and hint."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    paths, of = {id(root): 0}, {}
    order = [root]
    for node in order:  # parents first
        count: dict[str, int] = {}
        for c in node.children:
            count[c.label] = count.get(c.label, 0) + 1
        seen: dict[str, int] = {}
        for c in node.children:
            seen[c.label] = k = seen.get(c.label, 0) + 1
            place = "first" if k == 1 else "last" if k == count[c.label] else ""
            paths[id(c)] = digest(f"{c.label} {place}".encode("utf-8", "surrogatepass"), seed=paths[id(node)])
            order.append(c)
    content: dict[int, int] = {}
    for node in reversed(order):  # children first; a branch without text is no node
        parts = [digest(t.encode("utf-8", "surrogatepass")) for t in node.texts] + [content[id(c)] for c in node.children if id(c) in content]
        if parts:
            content[id(node)] = digest(b"".join(p.to_bytes(8, "little") for p in parts))
    for node in order[1:]:
        if id(node) in content:
            row = of.setdefault(paths[id(node)], [[], [], False])
            row[0].append(content[id(node)])
            row[1].append(" ".join(c.label for i, c in enumerate(node.children) if i == 0 or node.children[i - 1].label != c.label))
            row[2] = row[2] or node.hint
    return paths, of


def main_text(page: tuple[Node, list[Block]], low: frozenset[int]) -> str:
    """The page's main text, without the branches whose paths are in low."""
    root, kept = page
    if any(b.main for b in kept):
        kept = [b for b in kept if b.main]
    if low:
        paths, gone = merged(root)[0], {id(root): False}

        def out(node: Node) -> bool:
            above = []
            while id(node) not in gone:
                above.append(node)
                node = node.parent
            for n in reversed(above):
                gone[id(n)] = gone[id(n.parent)] or paths[id(n)] in low
            return gone[id(above[0])] if above else gone[id(node)]

        kept = [b for b in kept if not out(b.node)]
    return "\n".join(b.text for b in kept)


def _node_rows(batches):
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for b in chunks(batches, 1 << 20):
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            if not html or not host:
                continue
            page = signed(digest(html.encode("utf-8", "surrogatepass")))
            for path, (content, look, hint) in merged(blocks(html)[0])[1].items():
                text, look = digest(b"".join(c.to_bytes(8, "little") for c in content)), digest("|".join(look).encode("utf-8", "surrogatepass"))
                for col, v in zip(cols, (host, signed(path), page, signed(text), signed(look), hint)):
                    col.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "path", "page", "content", "look", "hint"])


def importance(nodes: DataFrame, unseen: int = UNSEEN) -> DataFrame:
    """host, path, hint, importance of each node of the hosts' style trees."""

    def entropy(by: str) -> DataFrame:
        n = nodes.groupBy("host", "path", by).agg(F.count("*").alias("c"), F.max("hint").alias("hint")).groupBy("host", "path")
        h = n.agg((F.sum("c") + unseen).alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.max("hint").alias("hint"))
        return h.select("host", "path", "hint", ((F.log("n") - F.col("s") / F.col("n")) / F.log("n")).alias(by))

    both = entropy("content").join(entropy("look").drop("hint"), ["host", "path"])
    return both.select("host", "path", "hint", (1 - (1 - F.col("content")) * (1 - F.col("look"))).alias("importance"))


def extract(spark: SparkSession, pages: DataFrame, least: float = LEAST, least_named: float = LEAST_NAMED, unseen: int = UNSEEN) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    scratch = Scratch(spark, "html-extract")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = columns_or_null(pages, {"page_id": "bigint", "url": "string", "html": "string"}).withColumn("host", host)
    nodes = rows.select("host", "html").mapInArrow(_node_rows, "host string, path bigint, page bigint, content bigint, look bigint, hint boolean")
    nodes = scratch.save(nodes.dropDuplicates(["host", "path", "page"]), "nodes")  # equal pages count once
    low = importance(nodes, unseen).where(F.col("importance") < F.when(F.col("hint"), least_named).otherwise(least))
    low = scratch.save(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "low")
    scratch.drop(nodes)
    n, size = low.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("low") + F.length("host")), F.lit(0))).first()

    def run(batches):
        sets: dict[tuple, frozenset[int]] = {}
        for b in chunks(batches, 1 << 20):
            text = []
            for html, low in zip(b.column("html").to_pylist(), b.column("low").to_pylist()):
                low = tuple(low or ())
                if low not in sets:
                    if len(sets) > 1_000:
                        sets.clear()
                    sets[low] = frozenset(x % (1 << 64) for x in low)
                text.append(main_text(blocks(html), sets[low]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(small(low, 1, rows=2 * size + 100 * n), "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
