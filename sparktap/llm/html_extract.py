"""Main text of web pages by a site style tree.

The pages of a host are merged by presentation: a node is the path of tags, classes and roles from the root. For each
node of a host the entropy of its child layouts (presentation) and of its texts (content) over the host's pages is its
importance: what looks and reads the same on all pages has none. Nodes whose own mark-up says what they are have a fixed
importance: 1 for an article and what holds it, 0 for menus, headers, footers, sidebars, notices, adverts, forms and
comments. Branches of low importance are cut from each page, within articles too; where a page has an article, the rest
of it is the text.

Counts are combined map-side and by value, then by node, so a host with most pages is no hot group. A page's cut
branches come from a broadcast of the low nodes while these are few, and from a join by page beyond that.

Defined results: null html is empty and has an empty text; a null url is a host of its own name; rows that repeat a page
are extracted each. A host's single page has importance 1 where mark-up doesn't say otherwise.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap.session import materialise, ship

LEAST_IMPORTANCE = 0.2
#: Pages that a host has at least where entropy decides.
LEAST_PAGES = 5
#: Low nodes up to this number are broadcast (16 bytes and the host's name each), if no host has more than MOST_OF_HOST.
BROADCAST_NODES = 200_000
MOST_OF_HOST = 2000
#: Parts of a host's pages in the join beyond the broadcast.
DEAL = 64

# Fixed values of HTML and of common mark-up.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select object canvas audio video head".split())
NESTED_RAW = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LOW_TAGS = frozenset("nav header footer aside form menu dialog button label input".split())
LOW_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LOW_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notice|notification|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|disqus|replies|respond|related|recommended|pagination|pager|toolbar|widget|copyright)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

_paths: dict[tuple, tuple[int, int, bool]] = {}


def _node(parent: int, tag: str, attrs: str) -> tuple[int, int, bool]:
    """Path hash, fixed importance (0, 1, or -1 for none) and whether it is an article, of a node under a path."""
    import xxhash

    key = (parent, tag, attrs)
    found = _paths.get(key)
    if found is None:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
        role = named.get("role", "").strip().lower()
        article = tag in ("article", "main") or role in ("main", "article")
        names = f"{named.get('class', '')} {named.get('id', '')}"
        low = tag in LOW_TAGS or role in LOW_ROLES or (tag not in ("body", "html") and bool(names.strip()) and bool(LOW_NAMES.search(names)))
        fixed = 0 if low else 1 if article else -1
        style = f"{parent}/{tag}.{' '.join(named.get('class', '').split())}#{role}{fixed}"  # ids may fix it too
        found = (xxhash.xxh64_intdigest(style) >> 1, fixed, article and not low)
        if len(_paths) > 200_000:
            _paths.clear()
        _paths[key] = found
    return found


class Node:
    __slots__ = ("tag", "path", "fixed", "article", "kids", "text_at", "inside", "holds")

    def __init__(self, tag, path, fixed, article, text_at, inside):
        self.tag, self.path, self.fixed, self.article, self.text_at, self.inside = tag, path, fixed, article, text_at, inside
        self.kids, self.holds = [], False


def walk(page: str, opened, closed, said) -> None:
    """Calls opened(node), closed(node) and said(text, node) in page order; raw elements are passed over."""
    stack = [Node("#root", 0, -1, False, 0, False)]
    at, end = 0, len(page)

    def close_top() -> None:
        closed(stack.pop())

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            said(page[at:], stack[-1])
            break
        if m.start() > at:
            said(page[at : m.start()], stack[-1])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        close_top()
                    break
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW and not attrs.endswith("/"):
            shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if shut:
                at = shut.end()
            elif tag in NESTED_RAW:
                at = end
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        close_top()
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same and (tag != "tr" or stack[i].tag == "tr"):
                    while len(stack) > i:
                        close_top()
                    break
                if stack[i].tag in stop:
                    break
        top = stack[-1]
        path, fixed, article = _node(top.path, tag, attrs)
        node = Node(tag, path, fixed, article, 0, top.inside or article)
        top.kids.append(path)
        if article:
            for x in stack:
                x.holds = True
        opened(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            closed(node)
        else:
            stack.append(node)
    while len(stack) > 1:
        close_top()


def styles(page: str) -> list[tuple[int, int, int, int]]:
    """Of each block's path: path, fixed importance, layout hash and content hash over its nodes of this page."""
    import xxhash

    texts: list[str] = []
    found: dict[int, list] = {}

    def opened(n: Node) -> None:
        n.text_at = len(texts)

    def closed(n: Node) -> None:
        if n.tag not in BLOCK and n.fixed < 0:
            return  # inline mark-up is part of the content around it
        own = found.setdefault(n.path, [n.fixed, [], []])
        if n.holds or n.article:
            own[0] = 1
        else:
            own[1].append(",".join(map(str, n.kids)))
            own[2].append(" ".join("".join(texts[n.text_at :]).split()))

    walk(page, opened, closed, lambda t, n: texts.append(t))
    digest = lambda x: xxhash.xxh64_intdigest("\n".join(x)) >> 1
    return [(p, f, digest(a), digest(b)) for p, (f, a, b) in found.items()]


def main_text(page: str, low: set[int]) -> str:
    """The page's text without branches of low importance; within its articles, if it has any outside such branches."""
    blocks: dict[bool, list[list[str]]] = {False: [[]], True: [[]]}
    cut = 0
    seen = False

    def opened(n: Node) -> None:
        nonlocal cut, seen
        if cut or n.path in low:
            cut += 1
            return
        seen = seen or n.article
        if n.tag in BLOCK:
            split()
        elif n.tag == "br":
            said(" ", n)

    def split() -> None:
        for x in blocks.values():
            if x[-1]:
                x.append([])

    def closed(n: Node) -> None:
        nonlocal cut
        if cut:
            cut -= 1
            if not cut and n.tag in BLOCK:
                split()
        elif n.tag in BLOCK:
            split()

    def said(t: str, n: Node) -> None:
        if not cut:
            blocks[False][-1].append(t)
            if n.inside:
                blocks[True][-1].append(t)

    walk(page, opened, closed, said)
    whole = (" ".join(entities.unescape("".join(x)).split()) for x in blocks[seen])
    return "\n".join(x for x in whole if x)


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, names, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for i, page in enumerate(batch.column(2).to_pylist()):
            rows += [(hosts[i], names[i], *x) for x in styles(page or "")]
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.string(), batch.column(1).type, pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "name", "path", "fixed", "layout", "content"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = batch.column(batch.num_columns - 1).to_pylist()
        texts = [main_text(p or "", set(x or ())) for p, x in zip(batch.column(batch.num_columns - 2).to_pylist(), low)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[*batch.schema.names[:-2], "text"])


def importance(rows: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rows (host, path, importance, pages) from rows (host, path, fixed, layout, content), one for each page and path.

    A node's importance is the mean of two entropies over the host's pages that have it, each as a share of the largest
    one possible: of its layouts and of its contents. On fewer than `least_pages` pages there is too little to compare.
    """
    parts = rows.select("host", "path", "fixed", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("layout").alias("v")), F.struct(F.lit(1).alias("k"), F.col("content").alias("v")))).alias("x"))
    each = parts.groupBy("host", "path", "x.k", "x.v").agg(F.count(F.lit(1)).alias("c"), F.max("fixed").alias("most"), F.min(F.when(F.col("fixed") >= 0, F.col("fixed"))).alias("least"))
    c = F.col("c").cast("double")
    kinds = each.groupBy("host", "path", "k").agg(F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("s"), F.max("most").alias("most"), F.min("least").alias("least"))
    m = F.col("m").cast("double")
    entropy = F.when(F.col("m") > 1, (F.log(m) - F.col("s") / m) / F.log(m)).otherwise(1.0)
    nodes = kinds.groupBy("host", "path").agg(F.avg(entropy).alias("entropy"), F.max("m").alias("pages"), F.max("most").alias("most"), F.min("least").alias("least"))
    return nodes.select("host", "path", F.when(F.col("most") == 1, 1.0).when(F.col("least") == 0, 0.0).when(F.col("pages") < least_pages, 1.0).otherwise(F.col("entropy")).alias("importance"), "pages")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, deal: int = DEAL) -> DataFrame:
    """Rows (id, url, text) of all pages.

    least_importance: nodes below it are cut. least_pages: pages of a host on which a node occurs before its entropies
    count; beyond the largest host's, mark-up alone decides. deal: parts that a host's low nodes are dealt into where they
    are too many for a broadcast, so that no path of a giant host meets all its pages in one task.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    bare = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.col(html_col).alias("html"))
    bare = bare.withColumn("name", F.xxhash64("id", "url", "html"))
    nodes = materialise(bare.select("host", "name", "html").mapInArrow(_style_rows, "host string, name long, path long, fixed int, layout long, content long"), "styles")
    # Pages of a host with the same html say nothing about each other: they count once.
    once = bare.groupBy("host", F.xxhash64("html").alias("h")).agg(F.min("name").alias("name")).select("name")
    counted = nodes.join(once, "name", "left_semi").dropDuplicates(["name", "path"])
    low = materialise(importance(counted, least_pages).where(F.col("importance") < least_importance).select("host", "path"), "low")
    by_host = low.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("most")).first()
    if by_host["n"] <= broadcast_nodes and by_host["most"] <= MOST_OF_HOST:
        cuts = low.groupBy("host").agg(F.collect_set("path").alias("low"))
        joined = bare.join(F.broadcast(cuts), "host", "left")
    else:
        dealt = low.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("part"))
        mine = nodes.select("host", "name", "path", F.pmod("name", F.lit(deal)).cast("int").alias("part")).distinct()
        cuts = mine.join(dealt, ["host", "path", "part"]).groupBy("name").agg(F.collect_set("path").alias("low"))
        joined = bare.join(cuts, "name", "left")
    out = joined.select("id", "url", "html", "low").mapInArrow(_text_rows, f"id {kind}, url string, text string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
