"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# contents that are never text
OPAQUE = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea xmp noembed noframes".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr".split()
)
NOISE_TAGS = frozenset("button select option".split())
# noise like what is named so, unless they hold the page's main text
FORM_TAGS = frozenset("form fieldset".split())
# noise unless an article or main is in them, or no text beside them, as where their end tag is missing
FRAME_TAGS = frozenset("nav footer aside header menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
# words of class, id and role that name what is not the article
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar sidenav footer "
    "masthead topbar breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login search searchbox share sharing social related recommended recommendations pagination pager "
    "skip widget toolbar complementary contentinfo".split()
)
MAIN_WORDS = frozenset("article articlebody entry story post content maincontent main body".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p "
    "pre section table ul tr td th thead tbody tfoot caption".split()
)
# an opening tag ends an open one of these, up to the border
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\saria-hidden\s*=\s*["']?true|\shidden(?=[\s>=/])|display\s*:\s*none""", re.I)
NEGATED = re.compile(r"(?i)\b(?:no|has|with|without|hide)[-_][a-z]+")
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PUNCTUATION = re.compile(r"""[.,;:!?…。，、；：！？«»“”"()]""")
BLANK = re.compile(r"\s+")
SMOOTHING = (0.25, 0.5, 0.25)
THRESHOLD = 0.35
# the part of the fused score that blocks outside article and main have on pages with these
UNMARKED = 0.3
# a named subtree that holds the main text has so many times the text beside it, and so many characters if no article or main is in it
OVERRULE = 3
LEAST_TEXT = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# text elements that may be short, and what they stand in; other short blocks are judged by their ratio only
SHORT = frozenset("p blockquote pre li dt dd td th caption figcaption address summary".split())
SETS = SHORT | frozenset("ul ol dl table thead tbody tfoot tr figure".split())


@dataclass(eq=False)
class _Named:
    """A form, a frame, or an element with the name of noise, in the innermost of these around it."""

    parent: _Named | None
    number: int
    frame: bool


@dataclass(eq=False)
class _Node:
    """An open element; line is itself or the element around it that is not inline, and what follows holds for line."""

    tag: str
    noise: bool = False
    main: bool = False
    opaque: bool = False
    hidden: bool = False
    named: _Named | None = None
    line: _Node | None = None
    parent: _Node | None = None
    number: int = 0
    depth: int = 1
    path: int = 0  # number of the root-to-leaf path
    anchor: int = 0  # the element around it, past lists, tables, quotes and figures


@dataclass
class Block:
    """Text of one leaf of the page: the pieces between block borders. Its root-to-leaf path is known by a number."""

    leaf: _Node
    named: _Named | None
    noise: bool
    main: bool
    text: str
    linked: int = 0
    score: float = field(default=0.0)

    @property
    def path(self) -> int:
        return self.leaf.path

    @property
    def around(self) -> int:
        return self.leaf.parent.number if self.leaf.parent else 0

    @property
    def own(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.linked)


def _words(tag: str) -> set[str]:
    """Lower-case parts of the class, id and role values of a tag."""
    found: set[str] = set()
    for value in HINTS.findall(tag):
        for word in re.split(r"[^A-Za-z]+", NEGATED.sub("", value)):
            found.add(word.lower())
            found.update(p.lower() for p in PART.findall(word))
    return found


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with markup gone, references decoded and white space made single.

    Open tags are closed as browsers do for the usual omissions: a paragraph by any block, list items and table cells by
    the next one. A line break ends no block. Unclosed inline tags do not reach beyond their block. Each element knows the
    one around it and the number of its path, so the work does not grow with the depth of the page.
    """
    root = _Node("html")
    root.line = root
    stack = [root]
    opened = 0
    open_tags: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = BLANK.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            out.append(Block(top.line, top.named, top.noise or top.hidden, top.main, text, linked))
        parts.clear()
        linked = 0

    def close(count: int):
        for node in stack[len(stack) - count :]:
            open_tags[node.tag] -= 1
        del stack[len(stack) - count :]

    def find(tags, border) -> int:
        """How many nodes to close to end the nearest of `tags`; 0 if none is open or a border comes first."""
        if not any(open_tags.get(t) for t in tags):
            return 0
        for depth in range(1, len(stack)):
            tag = stack[-depth].tag
            if tag in tags:
                return depth
            if tag in border:
                return 0
        return 0

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            if not stack[-1].opaque:
                piece = page[at:start]
                parts.append(piece)
                if any(n.tag == "a" for n in stack[-4:]):
                    linked += len(piece)
            at = start
            continue
        token = TOKEN.match(page, at)
        if not token:
            if not stack[-1].opaque:
                parts.append("<")
            at += 1
            continue
        raw, at = token[0], token.end()
        name = NAME.match(raw)
        if not name:
            continue
        tag = name[1].lower()
        if raw.startswith("</"):
            if tag not in INLINE:
                depth = find({tag}, ())
                if depth:
                    flush()
                    close(depth)
                elif tag == "p":
                    flush()
            else:
                depth = find({tag}, CLOSES_P)
                if depth:
                    close(depth)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr", "img", "input"):
                parts.append(" " if tag != "wbr" else "")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                depth = find({"p"}, {"article", "aside", "blockquote", "body", "div", "footer", "form", "header", "li", "main", "nav", "section", "td", "th"})
                if depth:
                    close(depth)
            if tag in ENDS:
                depth = find(*ENDS[tag])
                if depth:
                    close(depth)
                    if tag == "tr":
                        while (more := find({"tr"}, {"table"})) :
                            close(more)
        if raw.endswith("/>") and tag not in RAW:
            continue
        top = stack[-1]
        words = _words(raw) if "=" in raw else set()
        main = top.main or tag in MAIN_TAGS or "articlebody" in words
        hidden = top.hidden or ("=" in raw or " hidden" in raw) and bool(HIDDEN.search(raw))
        role_noise = bool(words & NOISE_WORDS) and tag not in ("body", "html") and tag not in MAIN_TAGS
        noise = tag != "main" and (top.noise or tag in NOISE_TAGS)
        opened += 1
        frame = tag in FRAME_TAGS and not (tag == "header" and top.main)
        # a page has one main, and it is not part of a menu, whatever was left open before it
        named = None if tag == "main" else _Named(top.named, opened, frame) if role_noise or frame or tag in FORM_TAGS else top.named
        node = _Node(tag, noise, main, top.opaque or tag in OPAQUE, hidden, named, top.line, number=opened)
        if tag not in INLINE:
            hint = next(iter(sorted(words & MAIN_WORDS)), "")
            around = top.line
            node.line, node.parent, node.depth = node, around, around.depth + 1
            node.path = paths.setdefault((around.path, f"{tag}.{hint}" if hint else tag), len(paths) + 1)
            node.anchor = around.anchor if around.tag in SETS else around.number
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag not in OPAQUE:
                parts.append(page[at : end.start() if end else size])
            at = end.start() if end else size
    flush()
    return out


def _path_means(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Of each block's path: text length per node and punctuation per node, linked text not counted in the length."""
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    nodes: dict[int, int] = {}
    for b in blocks:
        length[b.path] = length.get(b.path, 0) + b.own
        marks[b.path] = marks.get(b.path, 0.5) + len(PUNCTUATION.findall(b.text))
        nodes[b.path] = nodes.get(b.path, 0) + 1
    return tuple(np.array([table[b.path] / nodes[b.path] for b in blocks]) for table in (length, marks))


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """Fused tag-path ratio of each block, smoothed over the page.

    Per path: text length per node and punctuation per node. Both are smoothed over the blocks in page order; the
    geometric mean of the path's own value and the smoothed one, which neighbours alone cannot raise far, is scaled by
    the page's largest. The two are fused as their geometric mean, with a lower part for blocks outside article and main
    if the page has these.
    """
    fused = np.ones(len(blocks))
    for values in _path_means(blocks):
        padded = np.pad(values, 1, mode="edge")
        smooth = np.sqrt(values * sum(w * padded[k : k + len(values)] for k, w in enumerate(SMOOTHING)))
        fused *= np.sqrt(smooth / smooth.max()) if smooth.max() > 0 else 0
    if any(b.main for b in blocks):
        fused *= np.array([1 if b.main else UNMARKED for b in blocks])
    return fused


def _without_named(blocks: list[Block]) -> list[Block]:
    """The blocks outside forms, frames and subtrees with the name of noise, where these do not hold the page's main text.

    From outside in and strongest first, a subtree is let in if its best path is no weaker than the best one that is in,
    and its text is more than OVERRULE times the text that is in beside it. Frames must also hold an article or main, or
    have no text beside them. What is named inside a subtree is judged in turn.
    """
    if not any(b.named for b in blocks):
        return blocks
    length, marks = _path_means(blocks)
    marked = any(b.main for b in blocks)
    worth = [float(np.sqrt(n * m)) * (1 if b.main or not marked else UNMARKED) for b, n, m in zip(blocks, length, marks)]
    best: dict[_Named, float] = {}
    text: dict[_Named, int] = {}
    alone: dict[_Named | None, tuple[float, int]] = {}  # of what is in a subtree and in no named one inside it
    marks_in: set[_Named] = set()
    for b, value in zip(blocks, worth):
        top, own = alone.get(b.named, (0.0, 0))
        alone[b.named] = (max(top, value), own + b.own)
        if b.named and b.main:
            marks_in.add(b.named)
    # inner ones have larger numbers than those around them
    chain: dict[_Named, None] = {}
    for n in alone:
        while n and n not in chain:
            chain[n] = None
            n = n.parent
    inner: dict[_Named | None, list[_Named]] = {}
    for n in sorted(chain, key=lambda n: -n.number):
        top, own = alone.get(n, (0.0, 0))
        best[n], text[n] = max(best.get(n, 0.0), top), text.get(n, 0) + own
        inner.setdefault(n.parent, []).append(n)
        if n.parent:
            best[n.parent] = max(best.get(n.parent, 0.0), best[n])
            text[n.parent] = text.get(n.parent, 0) + text[n]
            if n in marks_in:
                marks_in.add(n.parent)
    let: set[_Named | None] = {None}
    out = list(inner.get(None, []))
    most, beside = alone.get(None, (0.0, 0))
    while True:
        strong = [
            n for n in out
            if best[n] > 0 and best[n] >= most and text[n] > OVERRULE * beside and (n in marks_in or text[n] >= LEAST_TEXT)
            and (not n.frame or n in marks_in or not beside)
        ]
        if not strong:
            return [b for b in blocks if b.named in let]
        chosen = max(strong, key=lambda n: (best[n], text[n], -n.number))
        let.add(chosen)
        out.remove(chosen)
        out += inner.get(chosen, [])
        top, own = alone.get(chosen, (0.0, 0))
        most, beside = max(most, top), beside + own


def extract(page: str | None, threshold: float = THRESHOLD) -> str:
    """Main text of a page: the kept blocks in page order, joined by two line ends.

    Blocks of buttons and choices are noise and take no part in the ratios; neither do those in menus, asides, headers,
    footers and forms and under names of notices, adverts, comments and the like, unless the main text is there.
    Of the others, on every page, paths are kept whose ratio makes up enough of the best path's, and that are not mostly
    links. With them go the headings above them, and quotes, items, cells and paragraphs that stand beside them.
    """
    if not page:
        return ""
    found = _without_named([b for b in blocks_of(page) if not b.noise])
    if not found:
        return ""
    weight: dict[int, float] = {}
    links: dict[tuple[str, int], int] = {}  # by path, and by the element around the block: how much more text is in links than not
    for b, ratio in zip(found, path_ratios(found)):
        b.score = float(ratio)
        weight[b.path] = max(weight.get(b.path, 0.0), b.score)
        for key in (("path", b.path), ("in", b.around)):
            links[key] = links.get(key, 0) + 2 * b.linked - len(b.text)
    best = max(weight.values())
    if best == 0:
        return "\n\n".join(b.text for b in found)
    content = {p for p, w in weight.items() if w >= threshold * best and links["path", p] <= 0}
    above: set[int] = set()
    beside: set[int] = set()
    for b in found:
        if b.path in content:
            beside.add(b.leaf.anchor)
            if b.leaf.tag not in SETS:
                beside.add(b.leaf.number)
            node = b.leaf
            while node.parent and node.number not in above:
                above.add(node.number)
                node = node.parent

    def joins(b: Block) -> bool:
        tag = b.leaf.tag
        if b.leaf.depth < 3 or b.linked > len(b.text) // 2:
            return False
        return tag in HEADINGS and b.around in above or tag in SHORT and links["in", b.around] <= 0 and b.leaf.anchor in beside

    return "\n\n".join(b.text for b in found if b.path in content or joins(b))


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """The pages with text and n_chars (code points of the text).

    Works on whole pages. Null and empty pages give an empty text; columns called text or n_chars are replaced; repeated
    rows get equal texts; an empty table gives an empty result.
    """
    kept = pages.drop("text", "n_chars")
    names = [*kept.columns, "text", "n_chars"]
    column = names.index(page)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = [extract(value.as_py()) for value in batch.column(column)]
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    return kept.mapInArrow(run, schema)
