"""Main text of pages by site style trees.

The pages of a host are merged into one tree of styles. A node of that tree is a path of block elements, each
named by tag, role and class without digits. Over the pages that have it, two things can vary: what its children
look like (presentation) and what it says (content). The importance of a node is the larger of the two
entropies, divided by that of all pages being different: 0 for a part that is the same everywhere, near 1 for
what each page has of its own. A few pages say little, so the importance on a host is averaged with that of the
same path in the tree of all hosts, which counts as a number of pages; what is low everywhere goes as well.

From each page the branches of low importance go, and elements that are furniture by their meaning: menus,
headers and footers outside of the article, sidebars, forms, adverts, notices and comments by tag, role or class.
Inside of the article only class names count that are plain about it, and not those of headings and paragraphs.
The article itself (``article``, ``main``, or their roles) is never a low branch: its text may be copied on many
pages, and inside of it a branch is measured by the article's own importance. A page that would lose all text keeps what the meaning of its elements leaves.

Blocks are joined in page order by newlines; character references are decoded, white space inside a block becomes
one space. Null and empty pages give an empty text; a null or odd url is a host of its own, the empty one;
repeated rows are read alike. Pages are parsed by a tolerant scanner: open elements end with their parents. Nesting
may be of any depth; very long paths and class lists are named by their hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.session import materialise

#: A branch goes when its importance, averaged with the one expected, is below this.
LEAST_IMPORTANCE = 0.7
#: Pages that the expectation counts as: beside an article, on hosts without articles, and inside of articles or in the
#: tree of all hosts, where equal headings and copied pages are no sign of furniture.
BESIDE, WITHOUT, INSIDE = 2, 6, 60
#: Name of the tree of all hosts.
EVERYWHERE = ""
#: Start of a path up to its article.
MAIN_PATH = r"^(.*?/(?:(?:article|main)(?:[.@#][^/]*)?|[^/]*@(?:article|main)))(?=/|$)"
IN_MAIN = regex.compile(MAIN_PATH)
#: Characters of a path and of a style that are spelled out.
LONGEST_PATH, LONGEST_STYLE = 2000, 300

TAG = regex.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>""", regex.S
)
NAME = regex.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = regex.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "head", "canvas", "audio", "video"}
RAW_END = {name: regex.compile(rf"</{name}\s*>", regex.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = {"nav", "aside", "form", "footer", "header", "menu", "dialog", "button", "select", "fieldset"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Parts of class names and ids that say what an element is for.
FURNITURE_NAMES = regex.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|"
    r"nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer|footnav|header|masthead|comments?|"
    r"commentlist|disqus\w*|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search\w*|pagination|pager)"
    r"(?:$|[\s_-])", regex.I,
)
#: Class names and ids, whole, that are as plain inside of an article.
PLAIN_NAMES = regex.compile(
    r"(?:ads?|advert\w*|adsense|sponsor(?:ed)?|promo|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|share|sharing|social|"
    r"navbar|breadcrumbs?|sidebar|pagination|pager|comments|commentlist|disqus|replies|respond)"
    r"(?:[_-](?:ads?|area|bar|banner|block|box|buttons?|container|links|list|notice|section|slot|unit|widget|wrapper|\d+))*", regex.I,
)
PROSE = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figure", "table", "ul", "ol", "li"}
ENDS_PARAGRAPH = {"p"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: Sequences of text hashes are hashed as polynomials.
PRIME, SEQUENCE = (1 << 61) - 1, 0x9E3779B97F4A7C15


class Node:
    __slots__ = ("style", "furniture", "main", "article", "inside", "children", "parent", "tag")

    def __init__(self, tag: str, style: str, furniture: bool, main: bool, article: bool, parent: Node | None):
        self.tag, self.style, self.furniture, self.main, self.parent = tag, style, furniture, main, parent
        self.inside = main or parent is not None and parent.inside  # of main or article
        self.article = article or parent is not None and parent.article
        self.children: list[Node | str] = []


def styled(tag: str, markup: str, parent: Node) -> Node:
    """Element of the tree with its style name and what it is for."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(markup, len(tag) + 1) if len(markup) > len(tag) + 2 else ():
        found.setdefault(name.lower(), value.strip("\"'"))
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    main = tag in MAIN or role in MAIN
    # a header inside of the article holds its title
    furniture = hidden or (tag in FURNITURE and not (tag == "header" and parent.inside)) or role in ROLES
    if not furniture and not main and names and tag != "body":
        if parent.article:
            furniture = tag not in PROSE and any(map(PLAIN_NAMES.fullmatch, names.split()))
        else:
            furniture = bool(FURNITURE_NAMES.search(names))
    style = ".".join([tag, *sorted(regex.sub(r"\d+", "", names.lower()).split())]) + (f"@{role}" if role else "")
    style = style.replace("/", "|")
    if len(style) > LONGEST_STYLE:
        style = f"{tag}#{xxhash.xxh64_hexdigest(style)}"
    return Node(tag, style, furniture, main, "article" in (tag, role), parent)


def parse(html: str) -> Node:
    """Tree of block elements; inline markup leaves its text to the block around it."""
    root = at = Node("", "", False, False, False, None)
    place, end, opened = 0, len(html), Counter()
    while place < end:
        match = TAG.search(html, place)
        if match is None:
            at.children.append(html[place:])
            break
        if match.start() > place:
            at.children.append(html[place : match.start()])
        place, markup = match.end(), match[0]
        named = NAME.match(markup)
        if named is None:
            if markup.startswith("<![CDATA["):
                at.children.append(markup[9:].removesuffix("]]>"))
            continue
        tag, closing = named[1].lower(), markup[1] == "/"
        if tag in RAW and not closing:
            if not markup.endswith("/>") and (stop := RAW_END[tag].search(html, place)):
                place = stop.end()
            elif tag not in ("head", "svg", "math") and not markup.endswith("/>"):
                break
            continue
        if tag in INLINE or tag in RAW:
            if tag == "br":
                at.children.append(" ")
            continue
        if closing:
            while opened[tag]:
                opened[at.tag] -= 1
                found, at = at.tag, at.parent
                if found == tag:
                    break
            continue
        ends = CLOSED_BY.get(tag, set()) | ENDS_PARAGRAPH
        if at.tag in ends and at.parent is not None:
            opened[at.tag] -= 1
            at = at.parent
        node = styled(tag, markup, at)
        at.children.append(node)
        if tag not in VOID and not markup.endswith("/>"):
            at = node
            opened[tag] += 1
    return root


def below(path: str, style: str) -> str:
    """Path of a child; a long one keeps the part up to its article and is a hash from there on."""
    path = f"{path}/{style}"
    if len(path) > LONGEST_PATH:
        main = IN_MAIN.match(path)
        path = f"{main[1] if main else ''}/#{xxhash.xxh64_hexdigest(path)}"
    return path


def texts(root: Node, dropped: set[str], furniture: bool) -> Iterator[str]:
    """Raw texts of the blocks of a page in page order."""
    mains: set[int] | None = None
    block: list[str] = []
    open_nodes = [("", iter(root.children))]
    while open_nodes:
        path, children = open_nodes[-1]
        child = next(children, None)
        if isinstance(child, str):
            block.append(child)
            continue
        if block:
            yield "".join(block)
            block = []
        if child is None:
            open_nodes.pop()
            continue
        own = below(path, child.style)
        if furniture and child.furniture:
            continue
        if own in dropped:
            mains = holding_main(root) if mains is None else mains
            if id(child) not in mains:
                continue
        open_nodes.append((own, iter(child.children)))


def holding_main(root: Node) -> set[int]:
    """Nodes that are or hold the article."""
    found: set[int] = set()
    left = [root]
    while left:
        node = left.pop()
        left.extend(c for c in node.children if not isinstance(c, str))
        up = node if node.main else None
        while up is not None and id(up) not in found:
            found.add(id(up))
            up = up.parent
    return found


def tidy(blocks: Iterator[str]) -> list[str]:
    return [line for block in blocks if (line := " ".join((unescape(block) if "&" in block else block).split()))]


def extract(html: str | None, dropped: set[str]) -> str:
    """Main text of a page, given the paths of its site's low branches."""
    root = parse(html or "")
    return "\n".join(tidy(texts(root, dropped, True)) or tidy(texts(root, set(), True)))


def styles(html: str | None) -> Iterator[tuple[str, int, int]]:
    """Path, hash of the children's styles and hash of the text of each kind of node on a page."""
    looks: dict[str, list[str]] = {}
    says: dict[str, list[int]] = {}
    # per open element: path, children left, styles of its children so far, hash and number of the texts so far
    open_nodes: list[list] = [["", iter(parse(html or "").children), [], 0, 0]]
    while open_nodes:
        frame = open_nodes[-1]
        child = next(frame[1], None)
        if isinstance(child, str):
            if text := child.strip():
                frame[3], frame[4] = followed(frame[3], xxhash.xxh64_intdigest(text), 1), frame[4] + 1
        elif child is not None:
            frame[2].append(child.style)
            open_nodes.append([below(frame[0], child.style), iter(child.children), [], 0, 0])
        else:
            path, _, look, said, times = open_nodes.pop()
            if open_nodes:
                up = open_nodes[-1]
                up[3], up[4] = followed(up[3], said, times), up[4] + times
                looks.setdefault(path, []).append("+".join(x for i, x in enumerate(look) if not i or look[i - 1] != x))
                says.setdefault(path, []).append(said)
    for path, said in says.items():
        yield path, xxhash.xxh64_intdigest("|".join(looks[path])) >> 1, xxhash.xxh64_intdigest(repr(said)) >> 1


def followed(first: int, second: int, times: int) -> int:
    """Hash of a sequence of texts followed by another of so many, from the hashes of both."""
    return (first * pow(SEQUENCE, times, PRIME) + second) % PRIME


def host(url: str) -> Column:
    """Host of a url column in lower case, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, n, importance`` of each node of each site's tree; the empty host stands for all hosts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Counter((h, *s) for h, html in zip(*[c.to_pylist() for c in batch.columns], strict=True) for s in styles(html))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], pa.array(list(rows.values()), pa.int64())],
                ["host", "path", "look", "said", "n"],
            )

    seen = pages.select("host", "html").mapInArrow(run, "host string, path string, look long, said long, n long")
    seen = materialise(seen, "sitetree-seen")  # two sums read it, pages are parsed once
    each = seen.withColumn("h", F.explode(F.array_distinct(F.array("host", F.lit(EVERYWHERE))))).drop("host").withColumnRenamed("h", "host")

    def entropy(of: str) -> DataFrame:
        counted = each.groupBy("host", "path", of).agg(F.sum("n").alias("n"))
        return counted.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias(of))

    both = entropy("look").join(entropy("said").drop("n"), ["host", "path"])
    share = lambda c: 1 - F.col(c) / (F.col("n") * F.log("n"))
    return both.select("host", "path", "n", F.when(F.col("n") > 1, F.greatest(share("look"), share("said"))).otherwise(1.0).alias("importance"))


def low_branches(tree: DataFrame) -> DataFrame:
    """``host, dropped``: paths of low importance; inside of an article, of low importance for that article."""
    tree = materialise(tree.withColumn("main", F.regexp_extract("path", MAIN_PATH, 1)), "sitetree-tree")
    articles = tree.where((F.col("main") != "") & (F.col("path") == F.col("main")))
    hosts = articles.select("host").distinct().withColumn("has_main", F.lit(True))
    articles = articles.select("host", "main", F.col("importance").alias("measure"))

    def averaged(expected: Column, pages: Column | int) -> Column:
        return (F.col("n") * F.col("importance") + pages * expected) / (F.col("n") + pages)

    everywhere = F.col("host") == EVERYWHERE
    common = tree.where(everywhere).select("path", averaged(F.lit(1.0), F.lit(INSIDE)).alias("expected"))
    rows = tree.join(common, "path").join(articles, ["host", "main"], "left").join(hosts, "host", "left")
    pages = F.when(everywhere | (F.col("main") != ""), INSIDE).when(F.col("has_main"), BESIDE).otherwise(WITHOUT)
    importance = averaged(F.when(everywhere, 1.0).otherwise(F.col("expected")), pages)
    measure = F.coalesce("measure", F.lit(1.0))
    low = rows.where((importance < LEAST_IMPORTANCE * measure) & (F.col("path") != F.col("main")))
    return low.groupBy("host").agg(F.collect_set("path").alias("dropped"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``; a column of that name is replaced."""
    columns = [c for c in pages.columns if c != "text"]
    named = pages.select(*columns, host("url").alias("_host"))
    low = materialise(low_branches(style_tree(named.select(F.col("_host").alias("host"), "html"))), "sitetree-low")
    everywhere = low.where(F.col("host") == EVERYWHERE).select(F.col("dropped").alias("_common"))
    joined = named.join(low.select(F.col("host").alias("_host"), F.col("dropped").alias("_own")), "_host", "left")
    # one row: the paths of all sites together
    common = F.coalesce(everywhere.agg(F.first("_common")).scalar(), F.array().cast("array<string>"))
    joined = joined.withColumn("_dropped", F.array_union(F.coalesce("_own", F.array().cast("array<string>")), common))
    rows = joined.select(*columns, "_dropped")
    at = columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h, set(d)) for h, d in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*columns, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, text string")
