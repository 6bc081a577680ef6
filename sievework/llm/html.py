"""Main text of HTML pages by tree scoring.

The page becomes a tree of block elements; its text becomes blocks in page order, each owned by its innermost block element.

Scoring. A block of running text gives points for its length and commas to the ancestors of its owner, fewer the further up. A
container's value is its points, discounted by the share of its text that stands in links, times HOME_WEIGHT if it is marked as an article or as the main
part. The container of greatest value is chosen on every page, of equals the first. With it are kept those of its siblings that
score well enough by the same measure, plain paragraphs of running text, and headings before it, alone or in a short element; beside a marked article no other containers.

What is not the article. Elements that are menus, footers, forms, scripts and the like by tag, role or style never count. Names in class and id
count as a whole: a name all of whose words are marks or fillers (`comment-list`, `user-feedback`) excludes its element, one with another
word in it (`legal-analysis`) only halves the points and keeps the element from being taken along as a sibling. A named element that holds most of
the page's running text is the article's frame, and not excluded, unless the name says that readers wrote it. Readers' remarks are also
known by structure: at least two elements of one tag and class in a row that each show who wrote, or when, or a link to reply.
Inside the chosen container, lists of links before the first and after the last running text go, as do headings of which
nothing else is left.

Parsing follows the HTML standard where pages need it: raw text in script and style, comments, attributes in quotes,
implied ends of p, li, cells and rows, void elements, end tags without a start, markup cut off at the end of the page. Its time is linear
in the page, however deep it is nested.

Edge cases: a null, empty or markup-only page gives an empty text; a page without any scoring block gives the blocks of
its body; line breaks are white space; deep nesting and long pages need no recursion; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .staging import pick

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>"']|(?<==)"[^"]*"|(?<==)'[^']*'|(?<==\s)"[^"]*"|(?<==\s)'[^']*'|["'])*+)(?:>|\Z)
    | [^<]++ | <""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav noscript object ol option optgroup p pre search section select summary svg table tbody td template tfoot th thead tr ul canvas video audio".split()
)
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag of the key ends open elements of the values, but not beyond the barriers.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
KEEPS_P_OPEN = frozenset(("table", "td", "th", "caption", "button", "object", "template"))
EXCLUDED = frozenset("head nav footer aside form script style noscript template button select option textarea iframe svg canvas object dialog menu search video audio fieldset".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in class and id that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer colophon sidebar aside widget ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "sponsors promo promotion popup modal overlay lightbox banner banners cookie cookies consent gdpr notice notices announcement disclaimer newsletter subscribe subscription signup signin login register sharing share social "
    "related recommended recommendations trending popular pagination pager toolbar copyright taboola outbrain".split()
)
#: Words that say that readers wrote it.
REMARKS = frozenset("comment comments commentlist disqus discussion reply replies respond responses reactions feedback guestbook".split())
#: Words that go with a mark without changing what it says.
FILLERS = frozenset("site page list item items area box block bar wrapper wrap container section sections holder inner outer top bottom left right main global user users reader readers visitor links link buttons icons primary secondary thread post posts article articles stories news reading content".split())
#: With one of these a header is that of a text, not of the site.
TEXT_HEADERS = frozenset(("post", "posts", "article", "articles", "page", "section", "content", "news"))
#: Words in class and id of what shows who wrote a remark, and when.
BYLINE = frozenset("author avatar byline commenter username user nick date time timestamp posted reply says".split())
HOMES = frozenset(("article", "main"))
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
REPLY = re.compile(r"\W*(?:reply|répondre|antworten|responder|permalink|report|like)\W*", re.I)
HOME_WEIGHT = 2.2
WEAK_WEIGHT = 0.5
FRAME_SHARE = 0.6
SIBLING_SHARE = 0.2
HEAD_CHARS = 300
MAX_LINK_DENSITY = 0.5


class Node:
    __slots__ = ("tag", "parent", "at", "out", "mark", "home", "in_home", "name", "byline", "titled", "points", "text", "linked", "children")

    def __init__(self, tag: str, parent: Node | None, at: int):
        self.tag, self.parent, self.at = tag, parent, at
        self.out = self.home = self.byline = self.titled = False
        self.in_home = parent is not None and (parent.home or parent.in_home)
        self.mark = 0  # 1 by one of several words, 2 by a whole name, 3 by a name that says that readers wrote it
        self.name = ""
        self.points, self.text, self.linked = 0.0, 0, 0
        self.children: list[Node] = []


class Block:
    __slots__ = ("owner", "text", "linked")

    def __init__(self, owner: Node, text: str, linked: int):
        self.owner, self.text, self.linked = owner, text, linked


class Scope:
    """How many elements of some tags are open since the last barrier, so that no search is made in vain."""

    __slots__ = ("tags", "barriers", "open")

    def __init__(self, tags, barriers):
        self.tags, self.barriers, self.open = frozenset(tags), frozenset(barriers), [0]

    def push(self, tag: str) -> None:
        if tag in self.barriers:
            self.open.append(0)
        if tag in self.tags:
            self.open[-1] += 1

    def pop(self, tag: str) -> None:
        if tag in self.tags:
            self.open[-1] -= 1
        if tag in self.barriers:
            self.open.pop()


def parse(page: str) -> tuple[Node, list[Node], list[Block]]:
    """The root, all block elements in page order, and the text blocks in page order."""
    root = Node("", None, 0)
    nodes, blocks = [root], []
    stack: list[tuple[str, Node]] = [("", root)]  # every open element with the block element it is in
    paragraphs = Scope(("p",), KEEPS_P_OPEN)
    implied = {tag: Scope(ends, BARRIER[tag]) for tag, ends in IMPLIED.items()}
    scopes: dict[str, list[Scope]] = {}
    for scope in (paragraphs, *implied.values()):
        for tag in scope.tags | scope.barriers:
            scopes.setdefault(tag, []).append(scope)
    count: dict[str, int] = {}  # open elements by tag
    links = 0
    buffer: list[str] = []
    linked = 0

    def push(tag: str, node: Node) -> None:
        stack.append((tag, node))
        count[tag] = count.get(tag, 0) + 1
        for scope in scopes.get(tag, ()):
            scope.push(tag)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append(Block(stack[-1][1], text, min(linked, len(text))))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, _ = stack[-1]
            if tag in BLOCK:
                flush()
            elif tag == "a":
                links -= 1
            stack.pop()
            count[tag] -= 1
            for scope in scopes.get(tag, ()):
                scope.pop(tag)

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            text = m.group()
            if not text.startswith(("<!", "<?")):
                text = entities.unescape(text) if "&" in text else text
                buffer.append(text)
                if links:
                    linked += len(text.strip())
            elif text.startswith("<![CDATA["):
                buffer.append(text[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group("end"):
            if tag == "br":
                buffer.append(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1) if count.get(tag) else ():
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK and tag not in BLOCK:
                    break  # an inline end tag does not reach out of its block
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            if paragraphs.open[-1] and tag not in ("button", "option", "optgroup", "object", "svg", "canvas", "video", "audio"):
                depth = len(stack) - 1  # a block's start ends an open paragraph
                while stack[depth][0] != "p":
                    depth -= 1
                pop_to(depth)
            if tag in IMPLIED and implied[tag].open[-1]:
                depth, left = len(stack), implied[tag].open[-1]
                while left:
                    depth -= 1
                    left -= stack[depth][0] in implied[tag].tags
                pop_to(depth)
            if tag in HEADING and stack[-1][0] in HEADING:
                pop_to(len(stack) - 1)
            flush()
            parent = stack[-1][1]
            node = Node(tag, parent, len(nodes))
            mark(node, m.group("attrs"))
            parent.children.append(node)
            nodes.append(node)
            if not (m.group("attrs") or "").rstrip().endswith("/") or tag not in ("svg", "canvas", "object"):
                push(tag, node)
        else:
            if tag == "a":
                links += 1
            elif tag in ("time", "cite"):
                stack[-1][1].byline = True
            push(tag, stack[-1][1])
    flush()
    return root, nodes, blocks


def named(value: str, of_site: bool = False) -> int:
    """What a class or id says: 0 nothing, 1 a mark among other words, 2 a mark, 3 that readers wrote it. ``of_site``: a header here is the site's."""
    out = 0
    for name in value.split():
        words = {w.lower() for w in WORDS.findall(name)}
        header = {"header"} if of_site and not words & TEXT_HEADERS else set()
        if words & (MARKS | REMARKS | header):
            whole = words <= MARKS | REMARKS | FILLERS | header
            out = max(out, 1 if not whole else 3 if words & REMARKS else 2)
    return out


def near_the_top(node: Node) -> bool:
    """Whether a block stands in the page's body or in a frame right in it."""
    up = node.parent
    for _ in range(2):
        if up is None or up.tag in ("body", "html", ""):
            return True
        up = up.parent
    return False


def mark(node: Node, attributes: str) -> None:
    """Sets what tag and attributes say."""
    node.out = node.tag in EXCLUDED or (node.tag == "header" and not node.in_home)
    node.home = node.tag in HOMES
    if not attributes or attributes.isspace():
        return
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id"):
            if node.tag not in ("html", "body", "main", "p", *HEADING):
                node.mark = max(node.mark, named(value, of_site=not node.in_home and near_the_top(node)))
            if name == "class":
                node.name = value
            node.byline |= bool(BYLINE & {w.lower() for w in WORDS.findall(value)})
        elif name == "role":
            node.out |= value.lower() in EXCLUDED_ROLES
            node.home |= value.lower() in ("main", "article")
        elif name == "itemprop":
            node.home |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            node.out = True


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes, blocks = parse(page)
    exclude(nodes, blocks)
    blocks = [b for b in blocks if not b.owner.out]
    best = choose(nodes, blocks)
    kept = {root.at} if best is None else keep_siblings(best)
    inside = [False] * len(nodes)
    for node in nodes:
        inside[node.at] = node.at in kept or (node.parent is not None and inside[node.parent.at])
    own = [b for b in blocks if inside[b.owner.at]]
    return "\n\n".join(b.text for b in (own if best is None else clean(own)))


def points_of(block: Block) -> float:
    """Headings and blocks of links give none."""
    if block.owner.tag in HEADING or block.linked > MAX_LINK_DENSITY * len(block.text):
        return 0.0
    return 1 + block.text.count(",") + min(3.0, len(block.text) / 100)


def by_structure(nodes: list[Node], blocks: list[Block]) -> list[bool]:
    """For each node whether it is, or is in, one of several elements of one tag and class in a row that have no heading, more than
    one block, and something in one of these that shows who wrote, or when, or a link to reply."""
    byline, size, plain = [n.byline for n in nodes], [0] * len(nodes), [n.tag not in HEADING and not n.home for n in nodes]
    for b in blocks:
        size[b.owner.at] += 1
        byline[b.owner.at] |= bool(b.linked and REPLY.fullmatch(b.text))
    for node in reversed(nodes):
        if node.parent is not None:
            size[node.parent.at] += size[node.at]
            byline[node.parent.at] |= byline[node.at]
            plain[node.parent.at] &= plain[node.at]
    out = [False] * len(nodes)
    like = lambda n: plain[n.at] and byline[n.at] and size[n.at] > 1 and n.tag in ("div", "li", "section", "blockquote", "dd")
    for node in nodes:
        out[node.at] |= node.parent is not None and out[node.parent.at]
        for item, following in zip(node.children, node.children[1:], strict=False):
            if item.tag == following.tag and item.name == following.name and like(item) and like(following):
                out[item.at] = out[following.at] = True
    return out


def exclude(nodes: list[Node], blocks: list[Block]) -> None:
    """Sets ``out`` of all that is not the article by tag, name or structure, and of all below it."""
    remarks = by_structure(nodes, blocks)
    if any(points_of(b) and not remarks[b.owner.at] for b in blocks):  # else the page is nothing but remarks
        for node in nodes:
            node.mark = 3 if remarks[node.at] else node.mark
    sure = [False] * len(nodes)
    for node in nodes:
        sure[node.at] = node.out or node.mark == 3 or (node.parent is not None and sure[node.parent.at])
    share, homes = [0.0] * len(nodes), [0.0] * len(nodes)
    for b in blocks:
        if not sure[b.owner.at]:
            share[b.owner.at] += points_of(b)
    for node in reversed(nodes):
        if node.home:
            homes[node.at] = share[node.at]
        if node.parent is not None:
            share[node.parent.at] += share[node.at]
            homes[node.parent.at] += homes[node.at]
    for node in nodes:
        frame = node.mark == 2 and share[node.at] >= FRAME_SHARE * share[0] and homes[node.at] >= homes[0]
        node.out |= node.mark == 3 or (node.mark == 2 and not frame)
        if node.parent is not None:
            node.out |= node.parent.out


def choose(nodes: list[Node], blocks: list[Block]) -> Node | None:
    """Gives the blocks' points to their ancestors; the container of greatest value, of equals the first."""
    weak = [False] * len(nodes)
    for node in nodes:
        weak[node.at] = node.mark == 1 or (node.parent is not None and weak[node.parent.at])
    for b in blocks:
        b.owner.text += len(b.text)
        b.owner.linked += b.linked
        b.owner.titled |= b.owner.tag in HEADING
        points = points_of(b) * (WEAK_WEIGHT if weak[b.owner.at] else 1.0)
        # running text right in a container gives to it as a paragraph does to its parent
        up = b.owner.parent if b.owner.tag in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote") and b.owner.parent is not None else b.owner
        level = 1
        while points and up is not None and level <= 5:
            up.points += points / level
            up, level = up.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
            node.parent.titled |= node.titled
    return max((n for n in nodes if n.points > 0), key=lambda n: (value(n), -n.at), default=None)


def density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def value(node: Node) -> float:
    return node.points * (1 - density(node)) * (HOME_WEIGHT if node.home else 1.0)


def keep_siblings(best: Node) -> set[int]:
    """The places of ``best`` and of the siblings that belong to it."""
    kept = {best.at}
    if best.parent is None or best.tag in ("body", "html"):
        return kept
    least = max(1.0, SIBLING_SHARE * value(best))
    for node in best.parent.children:
        if node.out or node is best:
            continue
        if node.tag in HEADING or node.tag == "header" or (node.titled and node.text <= HEAD_CHARS and node.at < best.at):
            good = node.at < best.at and not node.mark
        elif node.tag in ("p", "pre", "blockquote"):
            good = node.text > 0 and density(node) <= MAX_LINK_DENSITY / 2
        else:
            good = not node.mark and not best.home and not node.home and value(node) >= least
        if good:
            kept.add(node.at)
    return kept


def clean(blocks: list[Block]) -> list[Block]:
    """Without lists of links at either end, and without headings of which nothing is left."""
    running = [i for i, b in enumerate(blocks) if points_of(b)]
    if not running:
        return blocks
    first, last = running[0], running[-1]
    gone = [(i < first or i > last) and b.owner.tag not in HEADING and b.linked > MAX_LINK_DENSITY * len(b.text) for i, b in enumerate(blocks)]
    open_: list[tuple[int, int, bool]] = []  # headings: level, place, whether anything under them stays
    empty: set[int] = set()

    def close(level: int, at: int) -> None:
        while open_ and open_[-1][0] >= level:
            _, place, some = open_.pop()
            if not some and at > place + 1 and gone[at - 1]:
                empty.add(place)
            elif open_:
                open_[-1] = (*open_[-1][:2], open_[-1][2] or some)

    for i, b in enumerate(blocks):
        if b.owner.tag in HEADING:
            close(int(b.owner.tag[1]), i)
            open_.append((int(b.owner.tag[1]), i, False))
        elif not gone[i] and open_:
            open_[-1] = (*open_[-1][:2], True)
    close(0, len(blocks))
    return [b for i, b in enumerate(blocks) if not gone[i] and i not in empty]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: the id and the page's main text."""
    source = pick(pages, key=id_col, html=html_col)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([main_text(x) for x in rows.column(1).to_pylist()], pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)
