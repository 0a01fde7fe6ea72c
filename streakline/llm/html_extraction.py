"""HTML main-text extraction with a site style tree.

The DOMs of a host are merged: nodes with the same path of tags, classes and ids are
one node of the style tree.  A node's presentation importance is the entropy of its
child sequences over the host's pages, a content node's that of its texts, both to
base m for m pages, and both drawn to 1 by ``PRIOR_PAGES`` pages that nobody has seen:
few pages say little, many pages say what they say.  A branch's importance is the
largest in it; branches whose importance is low are removed from each page.  Branches whose tag or name states
their role have a fixed importance: 1 for the article's own node, 0 for menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments.  A name states
a role only as a whole (``cookie-notice``, not ``with-sidebar``), and does not hold
for a branch with the page's only article in it, nor, where it may mean content, for one of high importance.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Branches below this importance go; unseen pages, each different, that every node's importance reckons with.
LOW, PRIOR_PAGES = 0.3, 1.0
#: Low nodes of all hosts (about 100 bytes each) up to which they are broadcast; more are joined by host and node.
BROADCAST_STYLES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas math audio video title".split())
CHROME = frozenset("nav header footer aside form button select option textarea input label fieldset dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose own text is prose.
PROSE = frozenset("article blockquote dd h1 h2 h3 h4 h5 h6 li main p pre td".split())
#: A start tag of the left closes an open one of the right, up to a tag that scopes it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body article section main div ul ol dl table nav header footer aside form blockquote td th".split())
CLOSES_P = BLOCKS - frozenset("br body html td th tr tbody thead tfoot caption option".split())
#: Words of which a class, id or role that names a part of the page other than the article is made.
ROLES = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promoted promotion banner nav navbar navigation navigate menu menubar breadcrumb breadcrumbs toolbar masthead topbar header footer foot "
    "sidebar aside rail widget complementary cookie cookies consent gdpr notice alert popup modal overlay toast newsletter subscribe subscription signup signin login register search share sharing social "
    "comment comments commentlist reply replies respond discussion disqus related recommended recommendations pagination pager skip contentinfo form".split()
)
#: Of these, names of other people's articles, and names that an article's own parts may have too.
OTHERS = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations".split())
UNSURE = frozenset("header banner masthead notice alert form register search discussion promotion subscription toolbar rail".split())
_NAME = re.compile(r"[a-z]+|\d+", re.I)
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """``path`` is a hash of the names from the root on, so that deep pages cost no more for it."""

    __slots__ = ("tag", "name", "parent", "children", "role", "path")

    def __init__(self, tag: str, name: str, parent: Node | None, role: int):
        self.tag, self.name, self.parent, self.role = tag, name, parent, role
        self.children: list[Node | str] = []
        self.path = path_key(parent.path, name) if parent else 0


def role_words(attrs: dict[str, str | None]) -> list[str]:
    text = " ".join(_SPLIT_CAMEL.sub(" ", attrs.get(k) or "") for k in ("class", "id", "role"))
    return [w.lower() for w in _NAME.findall(text)]


def stated_role(attrs: dict[str, str | None]) -> int:
    """3 for a part of others' making, 2 for another part that is not the article, 1 for one that may be, 0 for none."""
    found = 0
    for name in " ".join(attrs.get(k) or "" for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _NAME.findall(_SPLIT_CAMEL.sub(" ", name)) if not w.isdigit()]
        if words and all(w in ROLES for w in words):
            found = max(found, 3 if any(w in OTHERS for w in words) else 1 if all(w in UNSURE for w in words) else 2)
    return found


class TreeBuilder(HTMLParser):
    """A forgiving DOM of elements and texts; what is left open closes with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", "", None, 0)
        self.open: dict[str, int] = {}  # open elements by tag, so that an end tag without a start is known at once

    def _up_to(self, node: Node) -> None:
        """Close all open elements up to and with ``node``."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",))
        if tag in CLOSES:
            self._close(CLOSES[tag])
        words, role = [], 0
        if attrs:
            named = dict(attrs)
            words = role_words(named)
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style") or "") is not None
            stated = stated_role(named) if words else 0
            role = 3 if hidden or (tag in ("article", "main") and stated == 3) else 0 if tag in ("html", "body", "article", "main") else stated
        name = ".".join([tag, *(w for w in words[:3] if not w.isdigit())]) if words else tag
        node = Node(tag, name, self.at, role)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path"):
            self._up_to(self.at)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        node = self.at
        while node.parent and node.tag != tag:
            if node.tag in SCOPES and tag not in SCOPES:
                return  # a stray end tag closes nothing outside its scope
            node = node.parent
        if node.parent:
            self._up_to(node)

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tags):
        if not any(self.open.get(t) for t in tags):
            return
        node = self.at
        while node.parent and node.tag not in SCOPES:
            if node.tag in tags:
                self._up_to(node)
                return
            node = node.parent
        if node.parent and node.tag in tags:  # td and th scope what is in them, and close each other
            self._up_to(node)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def walk(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.children) if isinstance(x, Node)]


def style_rows(html: str):
    """(path, kind, signature) of each node of the page, once: its child sequence (kind 0) and its own text (kind 1)."""
    found = set()
    for node in walk(parse(html)):
        names, text = [], []
        for x in node.children:
            if isinstance(x, str):
                text.append(x)
            elif not names or names[-1] != x.name:  # runs of equal children count as one
                names.append(x.name)
        found.add((node.path, 0, _digest(" ".join(names))))
        own = " ".join("".join(text).split())
        if own and node.tag not in NO_TEXT:
            found.add((node.path, 1, _digest(own)))
    return found


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def path_key(above: int, name: str) -> int:
    memo = c.kept("html")
    key = memo.get((above, name))
    if key is None:
        if len(memo) > 50_000:
            memo.clear()
        key = memo[above, name] = _digest(f"{above}/{name}")
    return key


def extract(html: str, low_nodes: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text; ``low_nodes``: path keys of the host's nodes whose own importance is low."""
    root = parse(html)
    nodes = list(walk(root))
    gone = _dropped(nodes, frozenset())
    kind = "article" if any(n.tag == "article" and n.role < 3 for n in nodes) else "main"
    wrapped = not any(n.tag == kind and id(n) not in gone for n in nodes)  # else those within other parts are teasers
    low, holds, prose = set(), set(), {}  # holds: nodes with an article or main element in their branch; low: whole branches
    for n in reversed(nodes):  # children come after their parents
        within = [x for x in n.children if isinstance(x, Node)]
        if n.path in low_nodes and all(id(x) in low for x in within):
            low.add(id(n))
        own = sum(len(x.strip()) for x in n.children if isinstance(x, str)) if n.tag in PROSE else 0
        prose[id(n)] = 0 if n.tag in NO_TEXT or id(n) in low else own + sum(prose[id(x)] for x in within)
        if n.role and n.role < 3 and ((wrapped and id(n) in holds) or (n.role == 1 and id(n) not in low)):
            n.role = 0
        if not n.role and (n.tag in ("article", "main") or id(n) in holds):
            holds.add(id(n.parent))
    # a form around the page's article, or without one around most of its paragraphs, is only the page's frame
    frames = frozenset(id(n) for n in nodes if n.tag in ("form", "fieldset") and (wrapped and id(n) in holds or not holds and 2 * prose[id(n)] > prose[id(root)]))
    gone = _dropped(nodes, frames)
    articles = [n for n in nodes if n.tag == "article" and id(n) not in gone]
    mains = [n for n in nodes if n.tag == "main" and id(n) not in gone]
    tops = articles or mains
    parts: list[str] = []
    for top in _outermost(nodes, tops) if tops else [root]:
        _collect(top, parts, low, bool(tops), frames)
        parts.append(" ")
    return " ".join("".join(parts).split())


def _dropped(nodes: list[Node], frames: frozenset[int]) -> set[int]:
    """Nodes in branches that are no part of the main text, by tag or role; parents come before their children."""
    gone: set[int] = set()
    for n in nodes:
        if n.parent and (id(n.parent) in gone or n.role or n.tag in NO_TEXT or (n.tag in CHROME and id(n) not in frames)):
            gone.add(id(n))
    return gone


def _outermost(nodes: list[Node], some: list[Node]) -> list[Node]:
    chosen, inside, out = {id(n) for n in some}, set(), []
    for n in nodes:
        if n.parent and id(n.parent) in inside:
            inside.add(id(n))
        elif id(n) in chosen:
            inside.add(id(n))
            out.append(n)
    return out


def _collect(top: Node, parts: list[str], low: set[int], article: bool, frames: frozenset[int]) -> None:
    """Text of the branch in page order, with a space at each border of a block.

    Branches of low importance go, but within an article not an inline one that is part of a sentence."""
    stack: list[Node | str] = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x is not top and (x.role or x.tag in NO_TEXT or (x.tag in CHROME and id(x) not in frames and not (x.tag == "header" and article))):
            parts.append(" ")
            continue
        if x is not top and x.tag not in ("html", "body") and id(x) in low and not (article and _in_sentence(x)):
            parts.append(" ")
            continue
        if x.tag in BLOCKS:
            parts.append(" ")
            stack.append(" ")
        stack += reversed(x.children)


def _in_sentence(node: Node) -> bool:
    return node.tag not in BLOCKS and any(isinstance(x, str) and x.strip() for x in node.parent.children)


def style_tree(pages: DataFrame, host: str = "_host", html: str = "_html") -> DataFrame:
    """(host, path, pages, importance) of the merged trees: the larger of presentation and content entropy to base pages, drawn to 1 by the unseen pages."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[tuple, int] = {}
        for h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for path, kind, sig in style_rows((text or b"").decode("utf-8", "replace")):
                k = (h, path, kind, sig)
                n[k] = n.get(k, 0) + 1
        cols = list(zip(*n, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(cols, kinds, strict=True)), pa.array(list(n.values()), pa.int64())], names=["host", "path", "kind", "sig", "n"])

    rows = c.map_arrow(pages.select(F.col(host), F.col(html)), run, "host string, path long, kind int, sig long, n long", html)
    counts = rows.groupBy("host", "path", "kind", "sig").agg(F.sum("n").alias("n"))
    m, nlogn = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    nodes = counts.groupBy("host", "path", "kind").agg(m.alias("pages"), F.when(m > 1, (F.log(m) - nlogn / m) / F.log(m)).otherwise(1.0).alias("entropy"))
    seen = (F.col("pages") * F.col("entropy") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    return nodes.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(seen).alias("importance"))


def low_lists(pages: DataFrame, low_nodes: DataFrame) -> DataFrame:
    """(_host, _page, _low): for each distinct page (_host, _html) the keys of its low nodes, met by a join on host and node, so that no task holds a host's tree."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hosts, keys, paths = [], [], []
        for h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = {n.path for n in walk(parse((text or b"").decode("utf-8", "replace")))}
            paths += found
            hosts += [h] * len(found)
            keys += [hashlib.md5(text or b"").digest()] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(paths, pa.int64())], names=["_host", "_page", "path"])

    nodes = c.map_arrow(pages.select("_host", "_html"), run, "_host string, _page binary, path long", "_html")
    return nodes.join(low_nodes.withColumnRenamed("host", "_host"), ["_host", "path"]).groupBy("_host", "_page").agg(F.collect_set("path").alias("_low"))


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", low: float = LOW, broadcast_styles: int = BROADCAST_STYLES) -> DataFrame:
    """All columns of ``pages`` plus text (empty if there is none) and n_chars (code points).

    Null pages have no text; a null url, or one without a host, counts as a host of its own name (empty); repeated rows
    have a row each, but count once in the style tree; an empty table gives an empty result; input columns named text or
    n_chars are replaced.  Pages are read whole, however long or deeply nested.  Character references are decoded; white space is one space."""
    from pyspark.sql import types as T

    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    bytes_ = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    # copies of a page count once, or a large group of them would make its own text look like the site's frame
    distinct = pages.select(host.alias("_host"), bytes_.alias("_html")).distinct()
    low_nodes = c.stored(style_tree(distinct).filter(F.col("importance") < low).select("host", "path"), "style-tree")
    keep = [x for x in pages.columns if x not in ("text", "n_chars")]
    src = pages.select(*[F.col(f"`{x}`") for x in keep], host.alias("_host"), bytes_.alias("_html"))
    sent = None
    if low_nodes.count() <= broadcast_styles:
        by_host: dict[str, set[int]] = {}
        for r in low_nodes.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["path"])
        sent = spark.sparkContext.broadcast(by_host)
        src = src.withColumn("_low", F.lit(None).cast("array<long>"))
    else:
        page = F.unhex(F.md5("_html"))
        src = src.withColumn("_page", page).join(c.stored(low_lists(distinct, low_nodes), "low-nodes"), ["_host", "_page"], "left").select(*[F.col(f"`{x}`") for x in keep], "_host", "_html", "_low")
    schema = T.StructType([src.schema[x] for x in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    k = len(keep)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for i, (h, page) in enumerate(zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True)):
            found = sent.value.get(h, frozenset()) if sent is not None else set(part.column(k + 2)[i].as_py() or ())
            texts.append(extract(page.decode("utf-8", "replace"), found))
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return c.map_arrow(src, run, schema, "_html")


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(c.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: Holds for pages whose article element bears the text and whose references are the five below.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
s AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br|article)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
u AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS t FROM s),
w AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM w
"""
