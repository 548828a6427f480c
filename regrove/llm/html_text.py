"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags). Every block has a root-to-leaf path of block-level tags. Per path the
page's text length, punctuation marks, link text and blocks are added up; the path's ratio is text per block, raised by its
punctuation and lowered by its links. The ratios are smoothed along the page with a small Gaussian kernel and fused with a prior
for the path's elements (article and main raise the value, navigation, notices and the like are no content).

Containers (sections, divs and the like) hold the summed values of their blocks. From the page's root on, the containers of one
parent are thresholded by their path (name and class): those below a share of the highest value go, the others are gone into. A
container with as much text of its own is content and stays whole: headings, lists and tables included, without boilerplate and
lists of nothing but links (inside an article those stay too); so does an article or main that gets there. A weak article, such
as a teaser beside the content or within it, goes like any other path. Inside an article only unmistakable classes and roles (ads,
cookie bars, sharing) are boilerplate by themselves; other such words lower a subtree's ratio, and in an id, which may be an
anchor, they count where links prevail.

Characters are decoded (`html.unescape`), white space inside a block becomes one space, and the kept blocks are joined by one
space in page order. Nothing is cut off. Broken markup is read as browsers do in the common cases: a new paragraph ends the open
one, unknown end tags are ignored, an unterminated tag at the end is dropped.

Defined cases: null or empty html gives the empty text; a page without tags is one block; a page of nothing but boilerplate
gives the empty text; repeated rows each get their own result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import blocks, pick, table

#: Share of the highest value beside it that a container's path needs, and of text outside links that a list needs.
THRESHOLD = 0.12
#: Factors of a value inside an article or main, and of a ratio under a doubtful class within one.
ARTICLE, DOUBTFUL = 2.0, 0.25
KERNEL = (0.25, 0.5, 0.25)

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?=/?[a-zA-Z])[^>]*+\Z""",
    re.S,
)
_RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "template", "xmp", "svg", "math", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: An opening tag ends the open element of these kinds, looked for no further out than the second set.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "main", "aside", "nav", "blockquote"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist"}
_CONTENT = {"article", "main"}
#: Block-level elements that belong to the container around them.
_PARTS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th",
    "pre", "blockquote", "figure", "figcaption", "address", "details", "summary",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that are left out as a list of links; a heading or paragraph that is a link is text.
_LISTS = {"ul", "ol", "dl", "table"}
_BAD_HINT = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|banner|cookies?|cookiebar|consent|gdpr|notice|notification|popup|modal|overlay|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|"
    r"subscribe|signup|login|search|widget|pagination|pager|toolbar|disclaimer|legal|copyright)(?:$|[-_\s])", re.I,
)
#: Classes and roles that make a subtree of an article boilerplate whatever its text is like.
_PLAINLY_BAD = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adslot|sponsor\w*|promo\w*|cookies?|cookiebar|consent|gdpr|popup|modal|navbar|navigation|breadcrumbs?|"
    r"share|sharing|newsletter|subscribe|signup|login|pagination|pager|toolbar)(?:$|[-_\s])", re.I,
)
_COMMENT_HINT = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|replies|reply|disqus|respond|discussion)(?:$|[-_\s])", re.I)
_GOOD_HINT = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story|body|page|wrapper|container|layout)(?:$|[-_\s])", re.I)
_ROOT_HINT = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story)(?:$|[-_\s])", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ID = re.compile(r"""(?:^|\s)id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


def _prior_in_article(name: str, attributes: str) -> tuple[int, int]:
    """As `_prior`, inside an article, and how doubtful the element is: 2 by a class or role, 1 by an id, 0 not at all."""
    if _HIDDEN.search(attributes) or name in _BOILERPLATE:
        return -1, 0
    hints = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else ""
    if not hints:
        return int(name in _CONTENT), 0
    ids = " ".join(a or b or c for a, b, c in _ID.findall(attributes))
    kinds = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(_ID.sub(" ", attributes)))
    anchor = name in _HEADINGS or re.fullmatch(r"discussion|reply|replies|respond", ids, re.I)
    if _COMMENT_HINT.search(kinds) or (_COMMENT_HINT.search(ids) and not anchor):
        return -1, 0
    if name in _CONTENT or hints in ("main", "article"):
        return 1, 0
    if _GOOD_HINT.search(hints):
        return 0, 0
    if _PLAINLY_BAD.search(kinds):
        return -1, 0
    if (_BAD_HINT.search(kinds) and "header" not in kinds.lower()) or (_PLAINLY_BAD.search(ids) and name not in _HEADINGS):
        return 0, 2
    return 0, int(bool(_BAD_HINT.search(ids) or _COMMENT_HINT.search(ids)))


def _prior(name: str, attributes: str) -> int:
    """-1: whatever is inside is no content; 1: a content root; 0: says nothing."""
    hints = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)) if attributes else ""
    if _HIDDEN.search(attributes) or (hints and _COMMENT_HINT.search(hints)) or name in _BOILERPLATE or name == "header":
        return -1
    if name in _CONTENT or hints in ("main", "article"):
        return 1
    if name in ("html", "body") or not hints or _GOOD_HINT.search(hints):
        return 0
    return -1 if _BAD_HINT.search(hints) else 0


class Element(NamedTuple):
    """A block-level element: number of its parent, name, class, state inside it, whether it is marked as a content root, and how
    doubtful it is inside an article (2 by a class, 1 by an id)."""

    parent: int
    name: str
    group: str
    state: int
    root: bool
    doubt: int = 0


def page_blocks(page: str) -> tuple[list[dict], list[Element]]:
    """The page's blocks: path (its number), text, link (characters inside links), state (-1 boilerplate, 0 unmarked, 1 inside an article)
    and element (the number of the block-level one around it); and its block-level elements, parents first, the page itself as 0.

    Time and memory are linear in the page, however deep it is nested: a path is a number, one for each (parent's path, name).
    """
    stack: list[tuple[str, int, int]] = []  # block and inline elements with the state inside them and the block-level element
    opened: Counter[str] = Counter()  # names on the stack
    elements = [Element(-1, "", "", 0, False)]
    path_of, numbers = [0], {}  # of an element; of (parent's path, name)
    found: list[dict] = []
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            element = stack[-1][2] if stack else 0
            found.append({"path": path_of[element], "text": text, "link": linked, "state": stack[-1][1] if stack else 0, "element": element})
        buffer.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            text = html_lib.unescape(piece)
            buffer.append(text)
            if opened["a"]:
                linked += len(text)

    def close(down_to: int) -> None:
        if any(name not in _INLINE for name, *_ in stack[down_to:]):
            flush()
        opened.subtract(name for name, *_ in stack[down_to:])
        del stack[down_to:]

    at = 0
    while m := _TAG.search(page, at):
        take(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            take(m[1])
            continue
        ending, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if ending:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in _RAW:
            if name not in _INLINE:
                flush()
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name not in _INLINE:
            ended = _CLOSES.get(name, ())
            for k in range(len(stack) - 1, -1, -1) if opened["p"] or any(opened[x] for x in ended) else ():
                if stack[k][0] == "p" or stack[k][0] in ended:
                    close(k)
                    if name not in _CLOSES:
                        break
                elif stack[k][0] in _SCOPE:
                    break
            flush()
        outer, element = stack[-1][1:] if stack else (0, 0)
        prior, doubt = _prior_in_article(name, attributes) if outer == 1 else (_prior(name, attributes), 0)
        state = outer if outer == -1 else prior or outer
        if name not in _INLINE:
            group = next(("".join(m).lower() for m in _CLASS.findall(attributes)), "")
            hints = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
            elements.append(Element(element, name, group, state, prior == 1 or bool(_ROOT_HINT.search(hints) and name not in _PARTS | {"html", "body"}), doubt))
            path_of.append(numbers.setdefault((path_of[element], name), len(numbers) + 1))
            element = len(elements) - 1
        stack.append((name, state, element))
        opened[name] += 1
    take(page[at:])
    flush()
    return found, elements


def scores(found: list[dict]) -> list[float]:
    """Fused value of each block: smoothed path ratio times the prior of its state."""
    totals: dict[tuple[int, int], list[float]] = {}
    for b in found:
        t = totals.setdefault((b["path"], b["state"]), [0, 0, 0, 0])
        t[0] += len(b["text"])
        t[1] += len(_PUNCTUATION.findall(b["text"]))
        t[2] += b["link"]
        t[3] += 1
    ratio = {k: length / n * (1 + marks / n) * (1 - min(1.0, link / length)) for k, (length, marks, link, n) in totals.items()}
    raw = [ratio[b["path"], b["state"]] for b in found]
    padded = [raw[0], *raw, raw[-1]] if raw else []
    smooth = [sum(w * v for w, v in zip(KERNEL, padded[i:i + 3])) for i in range(len(raw))]
    prior = {-1: 0.0, 0: 1.0, 1: ARTICLE}
    return [(s * v) ** 0.5 * prior[b["state"]] for b, s, v in zip(found, smooth, raw)]


def content(found: list[dict], elements: list[Element], threshold: float = THRESHOLD) -> list[bool]:
    """For each block whether it is content."""
    fused = scores(found)
    n = len(elements)
    holder = list(range(n))  # the container an element belongs to
    own, mass, length, link, marks, count = ([0.0] * n for _ in range(6))
    for e, x in enumerate(elements):
        if x.name in _PARTS:
            holder[e] = holder[x.parent]
    for b, f in zip(found, fused):
        e = b["element"]
        if b["state"] >= 0:
            own[holder[e]] += f
            mass[e] += f
            length[e] += len(b["text"])
            link[e] += b["link"]
            marks[e] += len(_PUNCTUATION.findall(b["text"]))
            count[e] += 1
    inner: dict[int, list[int]] = {}
    for e in range(n - 1, 0, -1):
        up = elements[e].parent
        mass[up] += mass[e]
        length[up] += length[e]
        link[up] += link[e]
        marks[up] += marks[e]
        count[up] += count[e]
        if holder[e] == e:
            inner.setdefault(holder[up], []).append(e)
    value = mass[:]  # of a container: the mean over those of its path below the same parent
    for kids in inner.values():
        paths: dict[tuple[str, str], list[int]] = {}
        for e in kids:
            paths.setdefault((elements[e].name, elements[e].group), []).append(e)
        for same in paths.values():
            mean = sum(mass[e] for e in same) / len(same)
            for e in same:
                value[e] = mean
    whole, between = set(), set()  # containers that are content, and those on the way to them
    ahead = [0]
    while ahead:
        c = ahead.pop()
        kids = inner.get(c, [])
        best = max([own[c], *(value[e] for e in kids)])
        strong = [e for e in kids if value[e] > 0 and value[e] >= threshold * best]
        if elements[c].root or not strong or own[c] >= threshold * best:
            whole.add(c)
        else:
            between.add(c)
            ahead += strong

    def ratio(e: int) -> float:
        return length[e] / count[e] * (1 + marks[e] / count[e]) * max(0.0, 1 - link[e] / length[e]) if length[e] else 0.0

    def outweighed(e: int) -> bool:
        """Whether a doubtful element's text is too thin to stay in the content container around it."""
        if not elements[e].doubt or elements[e].name in _HEADINGS or not length[e]:
            return False
        if elements[e].doubt == 1 or (elements[e].name in _PARTS and elements[e].name not in _LISTS):
            return link[e] > length[e] / 2
        return ratio(e) * DOUBTFUL < threshold * ratio(max(top[e], 0))

    top = [-1] * n  # the content container an element lies in
    out = [False] * n
    article = [False] * n
    for e, x in enumerate(elements):
        top[e] = e if e in whole else top[x.parent] if e else -1
        article[e] = x.name == "article" or (e > 0 and article[x.parent])
        bare = not article[e] and (x.name in _LISTS or holder[e] == e) and e not in whole and e not in between and length[e] > 0 and 1 - link[e] / length[e] < threshold
        up = top[x.parent] if e else -1
        teaser = x.name == "article" and up >= 0 and value[e] < threshold * max(mass[up] - mass[e], 0.0)
        out[e] = x.state == -1 or bare or teaser or outweighed(e) or (e > 0 and out[x.parent])
    least = threshold * max(fused, default=0.0)
    marked = any(elements[e].state == 1 for e in whole)

    def keeps(b: dict, f: float) -> bool:
        e = b["element"]
        if b["state"] == -1 or out[e]:
            return False
        if top[e] >= 0:
            return True
        # on the way to a container: headings, and what a path's own value carries
        return holder[e] in between and ((elements[e].name in _HEADINGS and not marked) or (f > 0 and f >= least))

    return [keeps(b, f) for b, f in zip(found, fused)]


def main_text(page: str | None, threshold: float = THRESHOLD) -> tuple[str, int, int]:
    """Text of the content blocks, number of blocks, number of kept ones."""
    found, elements = page_blocks(page) if page else ([], [])
    kept = [b["text"] for b, is_content in zip(found, content(found, elements, threshold) if found else []) if is_content]
    return " ".join(kept), len(found), len(kept)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = THRESHOLD) -> DataFrame:
    """Per page: the columns `keep`, text, n_chars (code points), n_blocks, n_kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            texts, every, kept = zip(*[main_text(page, threshold) for page in part.column(len(keep)).to_pylist()], strict=True)
            columns = [pa.array(texts, pa.string()), *(pa.array(v, pa.int64()) for v in ([len(t) for t in texts], every, kept))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], [*keep, "text", "n_chars", "n_blocks", "n_kept"])

    picked = pick(pages, *keep, html)
    added = [T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_kept")]]
    return picked.mapInArrow(run, T.StructType([*(picked.schema[c] for c in keep), *added]))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("text"), "n_chars")
