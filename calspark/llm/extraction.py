"""Main text of web pages by consensus host paths.

1. Every page is parsed (a forgiving tokenizer, no DOM library) and its containers
   are scored: text blocks credit their container, its parent half and its
   grandparent a third; link text and headings of boilerplate count against it.
2. Each page votes for the generalised tag-class path of its best containers
   (digits in names become '#'); votes are summed by host in Spark, and the path
   with most votes wins. A hot host is reduced by partial sums before the shuffle.
3. Pages are extracted again from all containers on their host's winning path. A
   page without such a container, or whose own best container holds far more text,
   uses its own.

The winners are broadcast if their measured size is at most BROADCAST_BYTES, else
joined by host; skewed hosts are then split by adaptive execution.

Within the article, menus, headers, footers, sidebars, notices, adverts, forms (but
for one that wraps the page or its article, of which only the controls go),
comments, scripts and styles are left out by tag, role, visibility and words of
class and id. A name alone does not hide what holds the article, nor a section of
prose within it. Defined cases. Null or empty html: empty text. Null url: its pages
share the host ''. Truncated markup: an unfinished tag is dropped, open elements
end with the page; a head without an end tag ends before what belongs in a body. No
container: the body's text. Very long and very deep pages are parsed whole, a page at a
time, in steps that follow its length. Repeated rows give repeated rows. Extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calspark.llm.storage import materialize

BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z|(?=[\"']))", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template svg annotation annotation-xml canvas object audio video select button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body main section div td blockquote center html".split())
CLOSES_P = BLOCK - frozenset("html body head".split())
#: What a head can hold; anything else ends it.
HEADED = frozenset("base basefont bgsound link meta title style script noscript noframes template head".split())
DROPPED = frozenset("nav aside footer form dialog menu head fieldset".split())
#: Dropped in a form that wraps the page, beside what RAW drops.
CONTROLS = frozenset("label legend option optgroup datalist output".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: Words of class and id that name boilerplate, and those that name the article.
NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar header comment comments disqus respond responses reply replies discussion cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login search share sharing shares social follow related recommended recommendations recommendation widget widgets toolbar pagination pager paging skip hidden disclaimer toc".split()
)
#: Of these, the words that also head a section of prose, and those that mark readers' comments.
PROSE = frozenset("discussion related recommended recommendation recommendations responses search share sharing social follow promotion promotions menu navigation notification notifications subscription".split())
REMARKS = ("comment", "disqus", "repl", "respon", "discussion", "usercomment", "usernote")
#: Class names that state something about a page or a layout, not what it holds.
STATE = re.compile(r"(?i)^(?:has|with|without|no|not|show|hide|allow|supports)[-_]|[-_](?:open|opened|closed|enabled|disabled|on|off|active|visible)$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of prose, and the most of them in links, for a section of an article named by a word of PROSE.
SECTION_CHARS, SECTION_LINKED = 80, 0.3
#: Longer names that run words together are known by how they begin.
NEGATIVE_START = ("advert", "adsby", "adslot", "adbox", "adunit", "sponsor", "comment", "cookie", "sidebar", "newsletter", "navbar", "navmenu", "breadcrumb", "footer", "masthead", "subscri", "usercomment", "usernote")
POSITIVE = frozenset("article content post entry main body story text blog page hentry prose".split())
PAIRED = {"li": ("li", {"ul", "ol", "menu", "dir"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"}), "tr": ("tr", {"table"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"})}


#: Boilerplate; a header, of which an article keeps the headings.
HARD, SOFT = 2, 1


class Node:
    __slots__ = ("tag", "parent", "label", "bad", "good", "score", "size", "linked", "first", "last", "heading", "holder", "path_hash", "in_link", "index", "plain_form", "named", "remarks", "prose")

    def __init__(self, tag: str, parent: Node | None, label: str, bad: int, good: bool):
        self.tag, self.parent, self.label, self.bad, self.good = tag, parent, label, bad, good
        self.score, self.size, self.linked, self.first, self.last, self.heading = 0.0, 0, 0, 0, 0, False
        self.index, self.plain_form = 0, False
        self.named = self.remarks = self.prose = False  # bad by name alone; a name of comments; an id that may head prose
        # what every node inherits is kept in it, so that deep pages cost no more than flat ones
        self.holder = self if tag in CONTAINER or parent is None else parent.holder
        self.path_hash = hash((parent.path_hash, label)) if parent is not None else 0
        self.in_link = tag == "a" or parent is not None and parent.in_link


def _node(tag: str, attributes: str, parent: Node | None) -> Node:
    label, bad, good = tag, HARD if tag in DROPPED and tag != "form" else SOFT if tag == "header" else 0, tag in ("article", "main")
    named = remarks = prose = False
    if attributes and "=" in attributes or "hidden" in attributes:
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        classes = found.get("class", "").split()
        by_class = {w.lower() for c in classes if not STATE.search(c) for w in WORD.findall(c)}
        by_id = set() if tag in HEADINGS or STATE.search(found.get("id", "")) else {w.lower() for w in WORD.findall(found.get("id", ""))}
        words = by_class | by_id
        role = found.get("role", "").lower()
        if role == "main" or role == "article":
            good = True
        elif role in DROPPED_ROLES and role != tag:
            bad = HARD
        against = words & NEGATIVE | {w for w in words if w.startswith(NEGATIVE_START) and w != "commentary"}
        if against and (parent is None or parent.holder.tag != "pre" and parent.tag not in ("pre", "code")):
            if tag not in ("html", "body", "main") and not (tag == "article" and words & POSITIVE and against <= {"header", "banner", "sidebar", "related"}):
                named = bad != HARD and against != {"header"}
                remarks = any(w.startswith(REMARKS) for w in against)
                prose = named and tag in ("section", "div") and against <= PROSE and not against & by_class
                bad = max(bad, SOFT if against == {"header"} else HARD)
        elif words & POSITIVE:
            good = True
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            bad, named, prose = HARD, False, False
        if classes:
            label += "." + re.sub(r"\d+", "#", classes[0].lower())
    node = Node(tag, parent, label, HARD if tag == "form" else bad, good)
    node.plain_form = tag == "form" and not bad
    node.named, node.remarks, node.prose = named, remarks, prose
    return node


def parse(html: str) -> tuple[list[Node], list[tuple]]:
    """Nodes in document order and events: (node, text) for text, (node, None) where a block begins or ends."""
    root = Node("html", None, "", 0, False)
    nodes, events, stack = [root], [], [root]
    at, end, lower = 0, len(html), None

    def close_to(k: int) -> None:
        while len(stack) > k:
            gone = stack.pop()
            gone.last = len(events)
            if gone.tag in BLOCK:
                events.append((gone, None))

    while at < end:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if stack[-1].tag == "head" and text and not text.isspace():
            close_to(len(stack) - 1)
        if text and not text.isspace() or text and events:
            events.append((stack[-1], unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if stack[-1].tag == "head" and tag not in HEADED and tag != "html":
            close_to(len(stack) - 1)  # nothing is ever open in a head
        if tag in RAW:
            if m[3].rstrip().endswith("/"):
                continue
            lower = html.lower() if lower is None else lower
            if len(lower) != end:  # lower-casing changed the length: search without it
                close = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                stop = close.start() if close else -1
            else:
                stop = lower.find(f"</{tag}", at)
            if stop < 0:
                at = end
            else:
                gt = html.find(">", stop)
                at = gt + 1 if gt >= 0 else end
            continue
        if tag in VOID:
            if tag == "hr":
                events.append((stack[-1], None))
            elif tag in ("br", "wbr"):
                events.append((stack[-1], " " if tag == "br" else ""))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in PAIRED:
            other, fence = PAIRED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in fence:
                    break
                if stack[k].tag in (tag, other):
                    close_to(k)
                    break
        node = _node(tag, m[3] or "", stack[-1])
        if tag in BLOCK:
            events.append((stack[-1], None))
        if tag in ("h1", "h2"):
            stack[-1].heading = True
        node.first, node.index = len(events), len(nodes)
        nodes.append(node)
        if not (m[3] or "").rstrip().endswith("/") or tag in BLOCK:
            stack.append(node)
    close_to(1)
    root.last = len(events)
    if any(n.plain_form or n.named for n in nodes):
        _free_wrappers(nodes, events)
    return nodes, events


def _free_wrappers(nodes: list[Node], events: list[tuple]) -> None:
    """Takes back what forms and names say of nodes that hold the article itself.

    A form that holds most of the page's text, or its article, is a wrapper: only its
    controls stay boilerplate. So is a node called boilerplate by name that alone holds
    the page's article, main or first heading and most of its text, or four fifths of
    the text without being made of links; comments need the article and the heading.
    Within an article, a section whose id may head prose stays if it holds prose.
    """
    count = len(nodes)
    freeable = [n.plain_form or n.named for n in nodes]
    clean, formed, fine, inside = [True] * count, [False] * count, [True] * count, [False] * count
    size, linked, remarks, articles, titles, outer = [0] * count, [0] * count, [0] * count, [0] * count, [0] * count, [False] * count
    for k, node in enumerate(nodes[1:], 1):
        up = node.parent.index
        formed[k] = formed[up] or node.plain_form
        clean[k] = clean[up] and (not node.bad or freeable[k] or node.bad == SOFT) and not (formed[k] and node.tag in CONTROLS)
        fine[k] = fine[up] and not node.named  # under no name that speaks against it
        inside[k] = inside[up] or nodes[up].tag in ("article", "main") or nodes[up].good and not nodes[up].bad and nodes[up].tag in CONTAINER
        articles[k] = int(clean[k] and node.tag in ("article", "main") and not node.named)
        titles[k] = int(clean[k] and node.tag == "h1")
    for node, text in events:
        if text is not None and clean[node.index]:
            n = len(text.strip())
            size[node.index] += n
            linked[node.index] += n * node.in_link
    for k in range(count - 1, 0, -1):
        up = nodes[k].parent.index
        size[up] += size[k]
        linked[up] += linked[k]
        remarks[up] += size[k] if nodes[k].remarks else remarks[k]
        articles[up] += articles[k]
        titles[up] += titles[k]
    wrapped = [False] * count
    for k, node in enumerate(nodes[1:], 1):
        free = False
        if node.plain_form:
            free = clean[k] and (2 * size[k] > size[0] or articles[k] > 0)
            wrapped[k] = wrapped[node.parent.index] or free
        else:
            wrapped[k] = wrapped[node.parent.index]
            if wrapped[k] and node.tag in CONTROLS:
                node.bad = HARD
        if node.named and clean[k]:
            most = 2 * size[k] > size[0] and 2 * linked[k] < size[k]
            alone = articles[k] + titles[k] > 0 and articles[k] == articles[0] and titles[k] == titles[0]
            if node.remarks:
                free = most and alone and articles[k] > 0 and titles[k] > 0
            else:
                free = most and (alone or articles[0] + titles[0] == 0 and 5 * size[k] > 4 * size[0])
            if not free and node.prose and inside[k]:
                free = size[k] >= SECTION_CHARS and linked[k] < SECTION_LINKED * size[k] and 2 * remarks[k] < size[k]
        if free:
            node.bad, node.named = 0, False


def _shown(nodes: list[Node], root: Node) -> set[int]:
    """Ids of the nodes from ``root`` down that are no boilerplate. Headings in an article's own header stay."""
    shown, waiting, inside, page = {id(root)}, set(), {id(root)}, root.tag == "html"
    for k in range(root.index + 1, len(nodes)):  # what is below a node follows it
        node = nodes[k]
        key = id(node.parent)
        if key not in inside:
            break
        inside.add(id(node))
        if key not in shown and key not in waiting or node.bad == HARD or node.bad == SOFT and page:
            continue
        if node.tag not in ("h1", "h2", "h3") and (node.bad == SOFT or key in waiting):
            waiting.add(id(node))
        else:
            shown.add(id(node))
    return shown


def path_of(node: Node) -> str:
    out = []
    while node is not None and node.parent is not None:
        out.append(node.label)
        node = node.parent
    return ">".join(reversed(out)) or "body"


def _promote(node: Node) -> Node:
    """The article or main that holds the container, or a parent that holds its heading."""
    up, main = node, None
    while up is not None and up.parent is not None:
        if up.bad:
            break
        if up.tag == "article":
            return up
        if up.tag == "main" and main is None:
            main = up
        up = up.parent
    if main is not None:
        return main
    while node.parent is not None and node.parent.parent is not None and not node.heading and node.parent.heading and not node.parent.bad:
        node = node.parent
    return node


def score(nodes: list[Node], events: list[tuple]) -> list[Node]:
    """Scores every container; returns the containers of a text, best first."""
    shown = _shown(nodes, nodes[0])
    block: list[str] = []
    owner: Node | None = None

    def credit() -> None:
        text = " ".join("".join(block).split())
        if text:
            holder: Node | None = owner.holder
            worth = 1 + text.count(",") + min(len(text) / 100, 10) if len(text) >= 25 else 0.2
            for share in (1.0, 0.5, 1 / 3):
                if holder is None:
                    break
                holder.score += worth * share
                holder = holder.parent and holder.parent.holder

    for node, text in events:
        if text is None:
            if block:
                credit()
                block = []
            continue
        if id(node) not in shown:
            continue
        if not block:
            owner = node
        block.append(text)
        n = len(text.strip())
        node.size += n
        node.linked += n * node.in_link
    if block:
        credit()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
        if node.size:
            node.score *= max(0.0, 1 - node.linked / node.size) * (1.25 if node.good else 1.0)
    seen = [n for n in nodes if n.tag in CONTAINER and n.score > 0 and id(n) in shown]
    return sorted(seen, key=lambda n: -n.score)


def votes(html: str) -> list[tuple[str, int]]:
    """(path, weight) of the page's best containers, weights in thousandths of the best score."""
    nodes, events = parse(html)
    ranked = score(nodes, events)
    out: dict[str, int] = {}
    for node in ranked[:3]:
        path = path_of(_promote(node))
        out[path] = max(out.get(path, 0), round(1000 * node.score / ranked[0].score))
    return list(out.items())


def _text(roots: list[Node], nodes: list[Node], events: list[tuple]) -> str:
    blocks: list[str] = []
    for root in roots:
        parts: list[str] = []
        shown = _shown(nodes, root)
        for node, text in [*events[root.first : root.last], (root, None)]:
            if text is not None:
                if id(node) in shown:
                    parts.append(text)
            elif parts:
                if found := " ".join("".join(parts).split()):
                    blocks.append(found)
                parts = []
    return "\n\n".join(blocks)


def _on_path(nodes: list[Node], winner: str) -> list[Node]:
    """The outermost containers on a path, in page order."""
    wanted = 0
    for label in winner.split(">"):
        wanted = hash((wanted, label))
    found, inside, shown = [], set(), _shown(nodes, nodes[0])
    for node in nodes[1:]:
        if id(node.parent) in inside:
            inside.add(id(node))
        elif node.path_hash == wanted and id(node) in shown and path_of(node) == winner:
            found.append(node)
            inside.add(id(node))
    return found


def extract(html: str, winner: str | None) -> tuple[str, str]:
    """(text, path): the page's text by the host's path, or by its own best container."""
    nodes, events = parse(html)
    ranked = score(nodes, events)
    own = _promote(ranked[0]) if ranked else nodes[0]
    chosen = _on_path(nodes, winner) if winner else []
    if not chosen or 2 * sum(n.size - n.linked for n in chosen) < own.size - own.linked:
        chosen = [own]
    return _text(chosen, nodes, events), path_of(chosen[0])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, weights = [], [], []
        for host, html in zip(*batch.columns):
            for path, weight in votes(html.as_py() or ""):
                hosts.append(host.as_py())
                paths.append(path)
                weights.append(weight)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())], ["host", "path", "weight"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(html.as_py() or "", winner.as_py()) for html, winner in zip(batch.column(2), batch.column(3))]
        texts = [t for t, _ in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in found], pa.string())],
            ["page_id", "url", "text", "n_chars", "path"],
        )


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winner): the path with most votes of each host, ties to the shorter and then the first by name."""
    cast = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string"))
    summed = cast.mapInArrow(_vote, "host string, path string, weight long").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    best = F.min_by("path", F.struct(-F.col("weight"), F.length("path"), F.col("path")))
    return summed.groupBy("host").agg(best.alias("winner"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path of every page."""
    winners = materialize(host_paths(pages), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length("winner") + 64)).first()[0] or 0
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host"))
    joined = rows.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left").select("page_id", "url", "html", "winner")
    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long, path string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict[str, str] = {}
