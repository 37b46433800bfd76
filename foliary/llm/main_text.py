"""Main text of HTML pages by composite text density.

A page becomes a tree. For every node, its characters, its tags, and both inside links give the
composite density: characters per tag, less where links hold much of the text. The sum of a
node's children's densities is largest at the element whose children are the article's blocks.
An article or main element around it is taken whole. Without one the subtree grows towards the body
to the outermost element with a sibling on the path that reaches the least density of that path, so
an article in several sections stays whole, however unequal they are.

What is never main text is left out of the tree: scripts, styles, menus, page headers and
footers, sidebars, forms, and elements whose class or id calls them an advert, a notice, a menu or
reader comments. Character references are decoded; white space inside a block becomes one space;
blocks are joined by one line feed.

Defined results: a null, empty or textless page has an empty text; broken markup is read
as far as it goes (an open tag at the end is dropped); repeated rows repeat their result; an empty
table gives an empty result. Other columns are not read by `report`; `extract` keeps them, and
replaces a column of the output's name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.llm.common import pieces, prepare, strings

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|xmp|noembed|noframes|object|audio|video|canvas"
DROPPED = frozenset("head nav aside footer form button select dialog menu fieldset option label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of the same group closes, up to the element that holds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of a class or id that name what is not main text.
NOISE = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice popup modal newsletter subscribe signup paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget related recommended share sharing "
    "social footer masthead comment comments respond reply replies disqus pagination pager skip toolbar".split()
)
#: Words beside which those only say what an element has, lacks or looks like.
ABOUT = frozenset("has have no not non with without by hoc for is show hide hidden open free enabled disabled allow".split())
#: The part of a page's text beyond which an element is main text, whatever its class or id says.
MOST = 0.9
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())

TOKEN = re.compile(
    # Nothing is given back once it is matched, so broken tags take time in proportion.
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>|<[a-z/!?][^>]*+\Z",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Node:
    """An element: its parts in page order are texts and elements."""

    __slots__ = ("chars", "density", "link_chars", "link_tags", "name", "parent", "parts", "sum", "tags")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.parts = name, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def names_noise(value: str) -> bool:
    """Whether a class or id names an element that is no main text, as a word of its own."""
    for name in value.split():
        words = re.split("[_-]+", name)
        if not NOISE.isdisjoint(words) and ABOUT.isdisjoint(words):
            return True
    return False


def is_noise(name: str, rest: str, inside: Counter) -> str:
    """Why an element is never main text: by its `tag`, by its `name`, or not at all."""
    if name in DROPPED:
        return "" if name in ("footer", "label") and inside["blockquote"] else "tag"
    if name == "header":
        return "" if inside["article"] or inside["main"] else "tag"
    if not rest or name in ("html", "body", "article", "main"):
        return ""
    named = ""
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in NOISE_ROLES:
            return "tag"
        if key in ("class", "id") and names_noise(value):
            named = "name"
    return named


def parse(page: str) -> Node:
    """The tree of a page without what is never main text.

    An element that was left out for its name, but holds nearly all of the text, is kept after all.
    """
    kept: set[int] = set()
    for _ in range(8):
        root, left_out, read = _parse(page, kept)
        place, most = max(left_out.items(), key=lambda x: x[1], default=(0, 0))
        if most <= MOST * (read + sum(left_out.values())) or not most:
            break
        kept.add(place)
    return root


def _parse(page: str, kept: set[int]) -> tuple[Node, dict[int, int], int]:
    """The tree; characters of the elements left out for their name, by place; characters of the tree."""
    root = Node("html", None)
    stack, skipping, at = [root], 0, 0
    skipped: list[str] = []
    # Open elements by name: what lies around a tag is never listed.
    inside: Counter = Counter()
    left_out: dict[int, int] = {}
    place, read = -1, 0

    def text(value: str) -> None:
        nonlocal read
        if not value:
            return
        if not skipping:
            read += len(value.strip())
            stack[-1].parts.append(html.unescape(value) if "&" in value else value)
        elif place >= 0:
            left_out[place] += len(value.strip())

    def cut(i: int) -> None:
        """Close the elements from the i-th on."""
        inside.subtract([n.name for n in stack[i:]])
        del stack[i:]

    def enter(node: Node) -> None:
        inside[node.name] += 1
        stack.append(node)

    for token in TOKEN.finditer(page):
        text(page[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        closing = token["end"] or token["end2"]
        if skipping:
            if closing:
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                    skipping = len(skipped)
            elif name not in VOID:
                if name in CLOSES and skipped[-1] in CLOSES[name][0] and len(skipped) > 1:
                    skipped.pop()
                if not (name == "p" and skipped[-1] == "p" and len(skipped) > 1):
                    skipped.append(name)
                skipping = len(skipped)
            continue
        if closing:
            if inside[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            elif name == "p":
                stack[-1].parts.append(Node("p", stack[-1]))
            continue
        if name in ("html", "body"):
            if name == "body" and len(stack) == 1:
                node = Node("body", root)
                root.parts.append(node)
                enter(node)
            continue
        if name in BLOCKS and inside["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    cut(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if name in CLOSES and any(inside[n] for n in CLOSES[name][0]):
            same, holders = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in holders:
                    break
                if stack[i].name in same:
                    cut(i)
                    break
        why = "" if name in VOID else is_noise(name, token["rest"] or "", inside)
        if why and not (why == "name" and token.start() in kept):
            skipped, skipping = [name], 1
            place = token.start() if why == "name" else -1
            if place >= 0:
                left_out[place] = 0
            continue
        node = Node(name, stack[-1])
        stack[-1].parts.append(node)
        if name not in VOID and not (token["rest"] or "").endswith("/"):
            enter(node)
    text(page[at:])
    return root, left_out, read


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += [p for p in node.parts if isinstance(p, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, densities and sums; the nodes, parents first."""
    nodes = nodes_of(root)
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, Node):
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
            else:
                node.chars += len(SPACE.sub(" ", part).strip())
        if node.name == "a":
            node.link_chars = node.chars
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            # Links only lower a density: without any it is the characters per tag.
            lowered = min(math.log(max(ratio, 1.0) + 1e-9) / math.log(base + 1.0), 1.0)
            node.density = node.chars / max(node.tags, 1) * lowered
    for node in nodes:
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node))
    return nodes


def best(root: Node) -> Node:
    """The subtree that holds the main text."""
    nodes = measure(root)
    body = next((n for n in nodes if n.name == "body"), root)
    found = max(nodes, key=lambda n: n.sum)
    if found.sum == 0.0:
        return body
    path = [found]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    # A mark-up for the article ends the path, however dense its parts are.
    for name in ("article", "main"):
        marked = [n for n in path if n.name == name]
        if marked:
            return marked[-1]
    # The least density on the path is the threshold that one of the siblings has to reach.
    least, first = min(n.density for n in path), found.density
    for inner, step in zip(path, path[1:], strict=False):
        siblings = any(isinstance(p, Node) and p is not inner and p.chars and p.density >= least for p in step.parts)
        if siblings or step is not body and step.density >= body.density and step.density >= first / 2:
            found = step
    while found.parent is not None and (found.name == "p" or found.name not in BLOCKS):
        found = found.parent
    return found


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks, in page order."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        value = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if value:
            out.append(value)

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        own, i = stack.pop()
        if i == 0 and own.name in BLOCKS:
            close()
        while i < len(own.parts):
            part = own.parts[i]
            i += 1
            if isinstance(part, Node):
                if part.name == "br":
                    held.append(" ")
                    continue
                stack += [(own, i), (part, 0)]
                break
            held.append(part)
        else:
            if own.name in BLOCKS:
                close()
    close()
    return out


def main_text(page: str) -> str:
    return "\n".join(blocks(best(parse(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch], source: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        names = [n for n in batch.schema.names if n != out]
        texts = pa.array([main_text(x) for x in strings(batch, source)], pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], names=[*names, out])


def extract(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add the column `out`: the main text of the HTML column `source`."""
    prepare(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    return df.mapInArrow(partial(_extract, source=source, out=out), schema)


def report(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"), "html", "text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
