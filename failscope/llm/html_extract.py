"""Main text of web pages by wrapper induction.

*Trees.* A tolerant parser turns a page into its tree of block elements and texts. Runs of unlabelled
paragraphs, headings, lists and tables beside each other are one flow node, and elements repeated
in a row one node, so that a tree is as small as the site's layout, however long the page is.

*Alignment.* The trees of a host's pages are aligned by simple tree matching and merged into the
host's template. Equal trees are counted first, each task merges a share of a host's different
trees, and one small merge a host is left. Then each different tree is aligned with the template,
which says for every flow node of every page which node of the template, its slot, it is.

*Slots.* One aggregate over the host's different pages counts on how many of them each text of each
slot stands. Constant texts of a slot are template and go, wherever they stand, but for headings
with more text of their slot behind them, which title it; what varies is content. Tag names and class words only break ties: varying text in page furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments) is no content, and where most of the
host's varying text is in article or main nodes, what varies outside them isn't.

*Extraction.* The parsed texts, written once, meet the kept nodes and the constant texts of their
tree; this and all counting is done with DataFrame functions, and no page is parsed twice.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import by_size, materialise, partitions, table
from failscope.llm.url_filter import url_host

#: Attributes: a quote begins a value only behind an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)", re.IGNORECASE)
#: Elements whose content is never text of the page.
UNSEEN = frozenset("script style noscript template iframe svg textarea select button title head datalist noembed noframes".split())
#: Of those, the ones whose content has no markup.
_RAW = {t: re.compile(f"</{t}[\\s/>]", re.IGNORECASE) for t in "script style iframe textarea title noembed noframes xmp".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of running text; without a label they are no nodes of their own.
FLOW = frozenset("address blockquote caption center dd details dir dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
#: Elements that begin and end blocks.
BLOCKS = FLOW | frozenset("article aside body dialog div footer form header hr html main menu nav search section optgroup option".split())
#: Open elements that a start tag closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol menu dl table html body div article section".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Page furniture by tag, and by the words of one class, id or role: one of the first, no other word than the second.
FURNITURE_TAGS = frozenset("nav footer aside form menu header search".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments respond reply replies disqus cookie cookies consent notice notices alert gdpr newsletter subscribe signup popup modal overlay related recommended share sharing social toolbar widget widgets pagination pager complementary contentinfo search login".split()
)
NEUTRAL_WORDS = frozenset(
    "left right top bottom side site page global box bar list area container wrapper wrap block section link links button buttons icon icons item items inner outer slot unit text module panel group row col column primary secondary posts post articles stories form body title count meta author content media thread field input main".split()
)
#: A word of a class or id; of its number one digit counts, longer ones name single pages.
_WORD = re.compile("[a-z]+(?:[0-9](?![0-9]))?")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
#: Deeper nodes are part of their ancestor at this depth; so many siblings of a node are aligned, and
#: so many nodes of a template are kept, the most frequent ones. What isn't aligned counts as varying.
MAX_DEPTH, MAX_SIBLINGS, MAX_NODES = 64, 200, 4000
#: Longer runs of siblings of one tag without label are one repeated node.
LONG_RUN = 8
#: A text of a slot is constant if all of so many pages have it, or nine tenths of so many.
ALL_PAGES, MOST_PAGES = 4, 10


@lru_cache(1 << 16)
def _label(tag: str, attributes: str) -> str:
    """``tag.word-word.word``: the tag and the words of its classes, id and role."""
    if not attributes or "=" not in attributes:
        return tag
    names: list[str] = []
    for _, value in _ATTRIBUTE.findall(attributes):
        names += ("-".join(_WORD.findall(_CAMEL.sub(" ", name).lower())) for name in value.strip("\"'").split())
    return ".".join([tag, *dict.fromkeys(filter(None, names))])


@lru_cache(1 << 16)
def furniture(label: str, inside: bool = False) -> bool:
    """Whether a node with this label is page furniture; a header inside an article isn't."""
    tag, *names = label.split(".")
    if tag in ("article", "main", "body", "html"):
        return False
    if inside:  # the head of an article is part of it
        names = [n for n in names if "header" not in n.split("-")]
        tag = "div" if tag == "header" else tag
    for name in names:
        words = [w.rstrip("0123456789") for w in name.split("-")]
        known = [w in FURNITURE_WORDS for w in words]
        if any(known) and all(k or w in NEUTRAL_WORDS for k, w in zip(known, words, strict=True)):
            return True
    return tag in FURNITURE_TAGS


def parse(page: str) -> tuple[list, list[str], list[bool]]:
    """The tree of a page, its texts in page order, and which are headings; a node is [label,
    children, texts], its children are nodes and numbers of texts.

    Character references are decoded and white space is one space. Elements that are never closed
    end with the page; an unfinished tag at its end is no text.
    """
    root: list = ["", [], None]
    texts: list[str] = []
    headings: list[bool] = []
    stack: list[tuple[str, list]] = []
    open_: dict[str, int] = {}
    held: list[str] = []
    at, end, hidden = 0, len(page), 0

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text and not hidden:
                (stack[-1][1] if stack else root)[1].append(len(texts))
                texts.append(text)
                headings.append(bool(stack) and stack[-1][0] in _HEADINGS)

    def cut(to: int) -> None:
        nonlocal hidden
        for tag, _ in stack[to:]:
            open_[tag] -= 1
            hidden -= tag in UNSEEN
        del stack[to:]

    def push(tag: str, label: str) -> None:
        nonlocal hidden
        above = stack[-1][1] if stack else root
        node = above
        if len(stack) < MAX_DEPTH and tag not in UNSEEN:
            node = [label, [], None]
            above[1].append(node)
        stack.append((tag, node))
        open_[tag] = open_.get(tag, 0) + 1
        hidden += tag in UNSEEN

    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            held.append(page[at:])
            break
        held.append(page[at : token.start()])
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(1):
            if open_.get(tag):
                flush()
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag == "br":
            held.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            if tag not in UNSEEN:
                held.append(page[at : stop.start() if stop else end])
            at = end if stop is None else page.find(">", stop.start()) + 1 or end
            continue
        if tag in UNSEEN:
            flush()
            push(tag, tag)
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if stack and stack[-1][0] == "p":  # a block ends an open paragraph
            cut(len(stack) - 1)
        if any(open_.get(t) for t in _CLOSES.get(tag, ())):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[tag]:
                    cut(i)
                    break
                if stack[i][0] in _SCOPES:
                    break
        if tag == "body" and hidden:  # an unclosed head ends here
            cut(next(i for i, (t, _) in enumerate(stack) if t in UNSEEN))
        push(tag, _label(tag, token.group(3)))
    flush()
    return root, texts, headings


def _absorb(a: list, b: list) -> None:
    """Makes b, a repetition of a, part of it."""
    a[2] += b[2]
    for child in b[1]:
        same = next((x for x in a[1] if x[0] == child[0]), None)
        if same is None:
            a[1].append(child)
        else:
            _absorb(same, child)


def fold(node: list) -> list:
    """The node as the alignment sees it: [label, children, texts], where only flow nodes, labelled
    ``#``, have texts."""
    children: list[list] = []

    def flow(numbers: list[int]) -> None:
        if children and children[-1][0] == "#":
            children[-1][2].extend(numbers)
        else:
            children.append(["#", [], numbers])

    for child in node[1]:
        if isinstance(child, int):
            flow([child])
            continue
        inner = fold(child)
        if inner[0] in FLOW and all(x[0] == "#" for x in inner[1]):
            for x in inner[1]:
                flow(x[2])
        elif inner[1]:
            children.append(inner)
    # repetitions in a row; what has no label may be different things, if there are few
    out: list[list] = []
    i = 0
    while i < len(children):
        j = i
        while j < len(children) and children[j][0] == children[i][0]:
            j += 1
        if "." in children[i][0] or j - i > LONG_RUN:
            for x in children[i + 1 : j]:
                _absorb(children[i], x)
            out.append(children[i])
        else:
            out += children[i:j]
        i = j
    return [node[0], out, []]


def shape_of(node: list) -> list:
    """[label, children] of a folded tree."""
    return [node[0], [shape_of(x) for x in node[1]]]


def flow_nodes(node: list, path: tuple = ()) -> list[tuple[tuple, list]]:
    """(labels above, node) of the flow nodes below, in order; works on folded trees and on shapes."""
    out = []
    for child in node[1]:
        if child[0] == "#":
            out.append((path, child))
        else:
            out += flow_nodes(child, (*path, child[0]))
    return out


FURNITURE, PLAIN, MAIN = 0, 1, 2


def place_of(path: tuple) -> int:
    """Where a path leads: into furniture, into an article or main node, or elsewhere."""
    inside = False
    for label in path:
        if furniture(label, inside):
            return FURNITURE
        tag, *names = label.split(".")
        inside = inside or tag in ("article", "main") or tag == "div" and "main" in names
    return MAIN if inside else PLAIN


def number_of(text: str) -> int:
    """A 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def page_blocks(page: str) -> tuple[str, list[tuple[int, str, bool]], int]:
    """(shape, (flow node, text, heading) in page order, digest of the three longest texts outside
    furniture)."""
    root, texts, headings = parse(page)
    tree = fold(root)
    nodes = [0] * len(texts)
    content = []
    for n, (path, node) in enumerate(flow_nodes(tree)):
        for i in node[2]:
            nodes[i] = n
        if place_of(path) != FURNITURE:
            content += [texts[i] for i in node[2]]
    longest = sorted(content, key=lambda t: (-len(t), t))[:3]
    own = number_of("\n".join(longest))
    return json.dumps(shape_of(tree), separators=(",", ":")), list(zip(nodes, texts, headings, strict=True)), own


_PARSED = "shape string, shape_id long, page long, blocks array<struct<node: int, text: string, heading: boolean>>"


def _parse(batches):
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("heading", pa.bool_())]))
    for batch in batches:
        pages = batch.column(batch.num_columns - 1)
        for at in range(0, len(pages), 64):
            part = batch.slice(at, 64)
            shapes, blocks, digests = [], [], []
            for page in part.column(part.num_columns - 1).to_pylist():
                shape, own, digest = page_blocks(page)
                shapes.append(shape)
                digests.append(digest)
                blocks.append([{"node": n, "text": t, "heading": h} for n, t, h in own])
            ids = [number_of(f"{h} {x}") for h, x in zip(part.column("host").to_pylist(), shapes, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shapes, pa.string()), pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(blocks, kind)], names=[*part.schema.names[:-1], "shape", "shape_id", "page", "blocks"])


def matching(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes of one label: the size of the greatest matching that keeps
    order and ancestry, and the matched pairs of children. Children are a node's second field."""
    m, n = min(len(a[1]), MAX_SIBLINGS), min(len(b[1]), MAX_SIBLINGS)
    size = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            same = matching(a[1][i], b[1][j])[0] if a[1][i][0] == b[1][j][0] else 0
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + same)
    pairs, i, j = [], m, n
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return size[m][n] + 1, pairs[::-1]


def merged(a: list, b: list) -> list:
    """Two templates [label, children, pages] aligned: matched nodes are one node on the pages of
    both, the others stay in their places."""
    below = dict((j, i) for i, j in matching(a, b)[1])
    children, taken = [], 0
    for j, child in enumerate(b[1]):
        if j in below:
            children += a[1][taken : below[j]]
            taken = below[j] + 1
            children.append(merged(a[1][below[j]], child))
        else:
            children.append(child)
    return [a[0], children + a[1][taken:], a[2] + b[2]]


def weighted(shape: list, n: int) -> list:
    return [shape[0], [weighted(x, n) for x in shape[1]], n]


def _counts(tree: list) -> list[int]:
    return [tree[2], *(n for x in tree[1] for n in _counts(x))]


def pruned(tree: list, most: int = MAX_NODES) -> list:
    """The template with its ``most`` most frequent nodes, the first of equally frequent ones; a node
    never outlives its parent."""
    counts = sorted(_counts(tree), reverse=True)
    if len(counts) <= most:
        return tree
    least = counts[most - 1]
    ties = most - sum(n > least for n in counts)

    def keep(node: list) -> list:
        nonlocal ties
        children = []
        for child in node[1]:
            if child[2] == least:
                ties -= 1
            if child[2] > least or child[2] == least and ties >= 0:
                children.append(keep(child))
        return [node[0], children, node[2]]

    ties -= tree[2] == least
    return keep(tree)


def aligned(template: list, shape: list) -> list[int]:
    """For each flow node of a shape, the number of its flow node in the template, -1 if it has none."""
    number = {id(node): n for n, (_, node) in enumerate(flow_nodes(template))}
    out: list[int] = []

    def walk(a: list | None, b: list) -> None:
        below = dict((j, i) for i, j in matching(a, b)[1]) if a is not None else {}
        for j, child in enumerate(b[1]):
            other = a[1][below[j]] if j in below else None
            if child[0] == "#":
                out.append(number[id(other)] if other is not None else -1)
            else:
                walk(other, child)

    walk(template, shape)
    return out


SHARES = 16
_RUN = "host string, share int, shape string, n long"


def _merge_runs(batches):
    """Rows (host, share, shape, n) sorted by (host, share) -> one template each. Rows with n 0 are
    templates already."""
    at, tree = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*at, json.dumps(tree, separators=(",", ":")), 0), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["host", "share", "shape", "n"])

    for batch in batches:
        for host, share, shape, n in zip(*(batch.column(c).to_pylist() for c in ("host", "share", "shape", "n")), strict=True):
            own = weighted(json.loads(shape), n) if n else json.loads(shape)
            if (host, share) != at:
                if at is not None:
                    yield out()
                at, tree = (host, share), own
            else:
                tree = pruned(merged(tree, own))
    if at is not None:
        yield out()


def _align_runs(batches):
    """Rows (host, share, shape, n, shape_id) sorted by (host, share, n), a template (n 0) first ->
    (host, shape_id, slots, places) of the shapes."""
    template = None
    for batch in batches:
        rows = []
        for shape, n, shape_id, host in zip(*(batch.column(c).to_pylist() for c in ("shape", "n", "shape_id", "host")), strict=True):
            tree = json.loads(shape)
            if not n:
                template = tree
            else:
                rows.append((host, shape_id, aligned(template, tree), [place_of(p) for p, _ in flow_nodes(tree)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["host", "shape_id", "slots", "places"])


def align_hosts(parsed: DataFrame, templates: bool = True) -> DataFrame:
    """(host, shape_id, slots, places): for each different tree of a host, and each of its flow nodes,
    the slot in the host's template, and :func:`place_of` its path. Without ``templates`` no node is
    aligned, as if each page were a host of its own."""
    parts = partitions(parsed.sparkSession)
    shapes = parsed.groupBy("host", "shape_id").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n"))
    shapes = materialise(shapes.withColumn("share", F.pmod(F.xxhash64("shape_id"), F.lit(SHARES)).cast("int")), "page-shapes")
    rows = shapes.select("host", "share", "shape", "n")
    shared = rows.repartition(parts, "host", "share").sortWithinPartitions("host", "share", "shape").mapInArrow(_merge_runs, _RUN)
    whole = shared.withColumn("share", F.lit(0)).repartition(parts, "host").sortWithinPartitions("host", "share", "shape").mapInArrow(_merge_runs, _RUN)
    # a template meets its host's trees in front of them, once for each share, and is copied to no row
    first = whole.select("host", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), "shape" if templates else F.lit('["",[],0]').alias("shape"), "n", F.lit(None).cast("long").alias("shape_id"))
    both = first.unionByName(shapes).repartition(parts, "host", "share").sortWithinPartitions("host", "share", "n", "shape_id")
    return materialise(both.mapInArrow(_align_runs, "host string, shape_id long, slots array<int>, places array<int>"), "page-slots")


def induce_wrappers(parsed: DataFrame, templates: bool = True) -> DataFrame:
    """(shape_id, kept, constant): of each different tree of a host the flow nodes whose text is
    content, and hashes of (node, text) of the constant texts in them. Learnt from all pages."""
    slots = align_hosts(parsed, templates)
    # pages with the same long texts count once: copies of an article make it no template. A tree's id
    # is of its host, and only hashes of texts are shuffled
    block = parsed.select("shape_id", "page", F.explode("blocks").alias("b")).select("shape_id", "page", "b.node", F.xxhash64("b.text").alias("h"), F.char_length("b.text").alias("chars"))
    once = block.groupBy("shape_id", "node", "h", "page").agg(F.max("chars").alias("chars"))
    texts = materialise(once.groupBy("shape_id", "node", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "page-texts")
    having = parsed.select("shape_id", "page").distinct().groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = slots.select("host", "shape_id", F.posexplode(F.arrays_zip("slots", "places")).alias("node", "x")).select("host", "shape_id", "node", F.col("x.slots").alias("slot"), F.col("x.places").alias("place"))
    nodes = materialise(nodes, "page-nodes")

    in_slot = texts.join(by_size(nodes, 128), ["shape_id", "node"])
    slot_pages = nodes.where("slot >= 0").join(having, "shape_id").groupBy("host", "slot").agg(F.sum("n").alias("pages"))
    counted = in_slot.where("slot >= 0").groupBy("host", "slot", "h").agg(F.sum("n").alias("n")).join(slot_pages, ["host", "slot"])
    constant = counted.where(f"n >= {ALL_PAGES} and n >= pages or pages >= {MOST_PAGES} and 10 * n >= 9 * pages").select("host", "slot", "h")
    constant = materialise(constant, "page-constants")

    fixed = in_slot.join(by_size(constant, 64), ["host", "slot", "h"], "left_semi")
    hashes = fixed.groupBy("shape_id").agg(F.collect_set(F.xxhash64("node", "h")).alias("constant"))
    varying = in_slot.join(by_size(constant, 64), ["host", "slot", "h"], "left_anti").groupBy("host", "place").agg(F.sum("chars").alias("chars"))
    mass = lambda place: F.coalesce(F.sum(F.when(F.col("place") == place, F.col("chars"))), F.lit(0))
    of_host = varying.groupBy("host").agg((mass(MAIN) >= mass(PLAIN)).alias("in_main"))

    chosen = slots.join(of_host, "host", "left").join(hashes, "shape_id", "left")
    only_main = F.coalesce("in_main", F.lit(True)) & F.array_contains("places", MAIN)
    least = F.when(only_main, F.lit(MAIN)).otherwise(F.lit(PLAIN))
    kept = F.transform("places", lambda p: (p == MAIN) | (p >= least))
    return materialise(chosen.select("shape_id", kept.alias("kept"), "constant"), "wrappers")


def extract_main_text(pages: DataFrame, templates: bool = True) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    ``text`` is the main text: its blocks in page order, joined by two line feeds; n_chars its code
    points. Null and empty html give an empty text. Pages whose URL is null or has no host share a
    wrapper of their own. Null page_ids and repeated rows stay; no rows give no rows. Columns other
    than page_id, url and html are ignored. Pages may be nested to any depth.

    Wrappers are one small row for each different tree of a host; they are broadcast only if they
    are known to be small, and else Spark splits the pages of large hosts. ``templates`` false
    switches alignment off.
    """
    plain = pages.select("page_id", "url", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = materialise(plain.mapInArrow(_parse, f"page_id {kind}, url string, host string, {_PARSED}"), "page-blocks")
    wrappers = induce_wrappers(parsed, templates)
    joined = parsed.select("page_id", "url", "shape_id", "blocks").join(by_size(wrappers, 1024), "shape_id", "left")
    fixed = lambda b: F.coalesce(F.array_contains("constant", F.xxhash64(b["node"], F.xxhash64(b["text"]))), F.lit(False))
    titles = lambda b, i: b["heading"] & F.get("blocks", i + 1)["node"].eqNullSafe(b["node"])
    content = F.filter("blocks", lambda b, i: F.get("kept", b["node"]) & (~fixed(b) | titles(b, i)))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    """All pages: page_id, url, text, n_chars."""
    return extract_main_text(table(spark, sf_dir, "pages"))
