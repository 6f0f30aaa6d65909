"""Main text of HTML pages by composite text density.

For every node of the DOM: C characters of text, T tags, LC characters and LT
tags of links below it.  Its density is C/T, lowered by a logarithm whose base
grows with the share of links.  The density sum of a node adds up its
children's densities; the subtree of the largest sum holds the article.  It is
raised to the article or main element around it or, without one, to where all
text meets that isn't links only; all below that isn't marked out is content.
The least density on the way from there to the body is the threshold that a
subtree beside it must reach to count as content too.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The elements of HTML, and words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()) | frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose mfenced msup msub msubsup mover munder munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOT_TEXT = frozenset("head script style noscript template nav footer aside button select textarea iframe svg object menu dialog title input canvas audio video map annotation annotation-xml".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
NOT_NAMES = frozenset("ad ads adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall share sharing social related recommended recommendations pagination pager widget widgets skip copyright login tags".split())
COMMENT_NAMES = frozenset("comment comments respond replies disqus commentlist".split())
HEADER_NAMES = frozenset("header hdr".split())
#: Words that only say where or what kind of box a named part is, so that ``site-footer`` is a footer, but ``has-sidebar`` no sidebar.
PLACES = frozenset("site page main top bottom left right side primary secondary global mobile desktop header footer area wrapper wrap container inner outer box bar block list item items links link section slot unit text buttons button post posts article articles stories story entry body content form thread js".split())
#: Elements nested deeper become siblings, as in browsers, so that a page takes time in proportion to its length.
MAX_DEPTH = 512
#: Largest share of a page's text that a box of a boilerplate name is taken out with: where the name is all that is said, and where it is a part of a longer one.
NAMED_SHARE, PARTLY_NAMED_SHARE = 1 / 2, 1 / 4
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>\"']*)([^>]*)>", re.S)
#: One attribute: a name and, if there is one, its value; what stands inside a value is no name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOLD_BY = frozenset("class id role hidden aria-hidden style".split())
_WORD = re.compile(r"[a-z]+")
_BETWEEN = re.compile(r"[-_0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACES = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "children", "out", "article", "talk", "link", "block", "c", "t", "lc", "lt", "density", "total")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children, self.out, self.article, self.talk = tag, parent, [], False, False, False
        self.link = self if tag == "a" else parent and parent.link  # the link and the block around its text
        self.block = parent.block if parent and tag in INLINE else self
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0


def _names(value: str) -> set[str]:
    """What the tokens of a class or id name: the token, or its one word that isn't of PLACES."""
    said = set()
    for token in value.split():
        said.add(token.lower())
        words = [x.lower() for x in _BETWEEN.split(token) if x]
        if all(_WORD.fullmatch(x) for x in words):
            told = [x for x in words if x not in PLACES]
            if len(set(told)) == 1:
                said.add(told[0])
            elif told and all(x in NOT_NAMES or x in COMMENT_NAMES for x in told):
                said.update(told)
            elif not told and not set(words) & {"article", "articles", "entry", "post", "posts", "story", "stories", "section", "content", "list", "item", "items"}:
                said |= {"header", "footer"} & set(words)
    return said


def _named_out(tag: str, attributes: str, inside_article: bool) -> int:
    """5: surely no article text; 4: no article text, as comments; 3: comments if it is built like them; 2: no article text, unless an article lies below or, where no other text is marked as one, too much of the page's; 1: as 2, by a part of a name; -1: an anchor inside an article, out only if it is links for the most part; 0: may be."""
    if tag in NOT_TEXT or tag == "header" and not inside_article:
        return 5
    found = 2 if tag == "form" else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name not in _TOLD_BY:
            continue
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and "display:none" in low.replace(" ", ""):
            return 5
        if name == "role" and low in NOT_ROLES:
            return 5
        if name in ("class", "id"):
            said = _names(value)
            if said & COMMENT_NAMES:
                found = 4
            elif "discussion" in said:
                found = max(found, 3)
            elif tag != "article" and (said & NOT_NAMES or said & HEADER_NAMES and not inside_article):
                if name == "id" and inside_article and not found:
                    found = -1
                elif name != "id" or not inside_article:
                    found = max(found, 2 if set(low.split()) & (NOT_NAMES | HEADER_NAMES) else 1)
    return found


def parse(page: str) -> tuple[_Node, list[tuple[_Node, str]]]:
    """The root and, in page order, the pieces of text with the node that holds each; a break is a piece of its own."""
    root = _Node("html", None)
    nodes, stack, pieces, soft = [root], [root], [], []
    at, articles, last = 0, 0, page.rfind(">") + 1
    open_: Counter[str] = Counter()  # elements of each tag on the stack, and those left off it
    flat: Counter[str] = Counter()

    def pop(i: int) -> None:
        nonlocal articles
        for x in stack[i:]:
            open_[x.tag] -= 1
            articles -= x.tag in ("article", "main")
        del stack[i:]

    while at < len(page):
        m = _TAG.search(page, at, last) if at < last or page.startswith("<!--", at) else None
        if m is None:
            pieces.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            pieces.append((stack[-1], page[at : m.start()]))
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                pieces.append((stack[-1], " "))
            if flat[tag]:
                flat[tag] -= 1
            elif open_[tag]:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "html":
            continue
        if tag == "br":
            pieces.append((stack[-1], " "))
        if tag in CLOSES_P and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in CLOSES_SELF and any(open_[x] for x in CLOSES_SELF[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPE[tag]:
                    break
                if stack[i].tag in CLOSES_SELF[tag]:
                    pop(i)
                    break
        if tag == "body" and stack[-1].tag == "head":
            pop(len(stack) - 1)
        node = _Node(tag, stack[-1])
        stack[-1].children.append(node)
        nodes.append(node)
        level = _named_out(tag, attributes, articles > 0)
        node.out = stack[-1].out or level >= 4
        if level in (-1, 1, 2, 3) and not node.out:
            soft.append((node, level, articles > 0))
        if level == 4 or tag == "textarea":
            up = node
            while up is not None and not up.talk:
                up.talk = True
                up = up.parent
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I | re.A).search(page, at)
            close = page.find(">", end.start()) if end else -1
            if tag == "xmp":  # shown as it stands, markup and all
                pieces.append((node, html.escape(page[at : end.start() if end else len(page)], quote=False)))
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and not attributes.endswith("/"):
            if len(stack) <= MAX_DEPTH:
                stack.append(node)
                open_[tag] += 1
                articles += tag in ("article", "main")
            else:
                flat[tag] += 1
        if tag in ("article", "main"):
            up = node
            while up is not None and not up.article:
                up.article = True
                up = up.parent
    sizes = [0 if node.out else len(_SPACES.sub(" ", html.unescape(text)).strip()) for node, text in pieces]
    if soft:
        below, linked = ({id(node): 0 for node in nodes} for _ in range(2))
        for (node, _), n in zip(pieces, sizes, strict=True):
            below[id(node)] += n
            linked[id(node)] += n if node.link else 0
        for node in reversed(nodes[1:]):
            below[id(node.parent)] += below[id(node)]
            linked[id(node.parent)] += linked[id(node)]
        told = any(below[id(x)] for x in nodes if x.tag in ("article", "main"))  # the page says which text is its article
        for node, level, inside in soft:
            share = NAMED_SHARE if level == 2 else PARTLY_NAMED_SHARE
            if level == -1:
                node.out = not node.article and 2 * linked[id(node)] > below[id(node)]
                continue
            node.out = node.talk if level == 3 else not node.article and (told and not inside or below[id(node)] <= share * below[id(root)])
    for node in nodes[1:]:  # parents come before their children
        node.out = node.out or node.parent.out
    root.children = [x for x in nodes if x.parent is root]
    for (node, _), n in zip(pieces, sizes, strict=True):
        if not node.out:
            node.c += n
            node.lc += n if node.link else 0
    _measure(nodes)
    return root, pieces


def _measure(nodes: list[_Node]) -> None:
    for node in reversed(nodes):
        if node.out:
            continue
        for child in node.children:
            if not child.out:
                node.c += child.c
                node.lc += child.lc
                node.t += child.t + 1
                node.lt += child.lt + (child.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    for node in nodes:
        if node.out or not node.c:
            continue
        c, t, lc, lt = node.c, max(node.t, 1), max(node.lc, 1), max(node.lt, 1)
        base = math.log(c / max(c - node.lc, 1) * node.lc + body.lc / max(body.c, 1) * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1.0)
    for node in nodes:  # text-level elements are part of the block that holds them
        node.total = sum(x.density for x in node.children if not x.out and x.tag not in INLINE)


def content(root: _Node) -> set[int]:
    """ids of the nodes whose subtrees are the article: what the largest density sum is raised to, and what reaches the threshold beside it."""
    body = root
    walk = [root]
    while walk:
        node = walk.pop()
        if node.tag == "body" and not node.out:
            body = node
            break
        walk += reversed(node.children)

    best, todo = body, [body]
    while todo:
        node = todo.pop()
        if node.total > best.total:
            best = node
        todo += [x for x in node.children if not x.out]
    densest = best

    def above(node: _Node) -> list[_Node]:
        way = []
        while node is not None and node is not body:
            way.append(node)
            node = node.parent
        return way

    named = [x for x in above(best) if x.tag in ("article", "main")]
    marked: set[int] = set()
    if named:  # with the other articles of the page
        best = named[-1]
        todo = [body]
        while todo:
            node = todo.pop()
            if node.tag in ("article", "main"):
                marked.add(id(node))
            else:
                todo += [x for x in node.children if not x.out]
    else:
        best = body
    threshold = min([densest.density, body.density, *(x.density for x in above(densest))])
    marked.add(id(best))
    if best is body:  # no article is named: navigation are the subtrees of nothing but links beside the densest one
        marked.remove(id(body))
        way = {id(x) for x in above(densest)}
        if densest is body:
            return {id(body)}
        marked.add(id(densest))
        todo = [body]
        while todo:
            node = todo.pop()
            for child in node.children:
                if child.out or id(child) in marked:
                    continue
                if id(child) in way:
                    todo.append(child)
                elif child.tag in INLINE or child.tag in HEADINGS or child.c > child.lc + child.c // 10:
                    marked.add(id(child))
            marked.add(-id(node))  # its own text
        return marked
    way = {id(x) for x in above(best)} | {id(body)}
    todo = [body]
    while todo:
        node = todo.pop()
        passed = False
        for child in node.children:
            passed = passed or id(child) in way
            if child.out or id(child) in marked:
                continue
            if id(child) in way:
                todo.append(child)
            elif child.tag in HEADINGS and not passed:  # a title that stands over the article
                marked.add(id(child))
            elif child.density >= threshold and child.c > 0:
                marked.add(id(child))
    return marked


def extract(page: str | None) -> str:
    """The article's blocks, white space folded, joined by an empty line."""
    if not page:
        return ""
    root, pieces = parse(page)
    marked = content(root)
    inside: dict[int, bool] = {}

    def within(node: _Node) -> bool:
        path = []
        while node is not None and id(node) not in inside:
            path.append(node)
            if id(node) in marked:
                inside[id(node)] = True
                break
            node = node.parent
        answer = inside[id(node)] if node is not None else False
        for x in path:
            inside[id(x)] = answer
        return answer

    blocks: list[str] = []
    parts: list[str] = []
    last = None
    for node, text in pieces:
        if node.out:
            continue
        if node.block is not last:
            blocks.append("".join(parts))
            parts, last = [], node.block
        if -id(node) in marked or within(node):
            parts.append(html.unescape(text))  # a reference ends with its piece of text
    blocks.append("".join(parts))
    clean = (_SPACES.sub(" ", x).strip() for x in blocks)
    return "\n\n".join(x for x in clean if x)


def main_text(pages: DataFrame, markup: str = "html") -> DataFrame:
    """``pages`` without the markup column, with ``text``: the main text, empty where there is none or the page is null; a ``text`` of its own is replaced.

    Pages are worked on where they are read, one at a time; nothing is shuffled.
    """
    kept = [x for x in pages.columns if x not in (markup, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x.as_py()) for x in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], names=[*kept, "text"])

    narrow = pages.select(*kept, markup)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "text string"])
    return narrow.mapInArrow(run, schema)
