"""One web page: a forgiving reader of markup into elements and blocks of text, and what the markup itself declares.

`main_text` merges the pages of a site on Spark.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|(?P<tag></?[a-zA-Z][^\s/>]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]++|=)*+>?)|(?P<text>[^<]++|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
_NAME, _WORDS, _DIGITS = re.compile(r"</?([^\s/>]+)"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"), re.compile(r"\d{3,}")

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Whose text is never shown as a part of the page; they don't end a block either.
SILENT = frozenset("head script style noscript template iframe object svg canvas audio video button select textarea label noembed noframes title datalist".split())
BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("td th".split())
#: What an element's start closes: elements of these tags, unless one of those stands between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
_P_ENDS_AT = frozenset("table td th caption button object".split())  # a p beyond these stays open
_KEEPS_P = frozenset("caption tbody tfoot thead tr legend".split())

#: Tags and words in class, id or role by which markup declares an element as no part of the text.
CHROME_TAGS = frozenset("nav footer aside form fieldset dialog menu search".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead footer foot sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social related recommended recommendations trending widget widgets comment comments commentlist respond disqus replies discussion pagination pager toolbar skip copyright disclaimer contentinfo complementary".split()
)
_TALK = frozenset("comment comments commentlist respond disqus replies discussion".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored".split())
_INLINE = _TALK | _ADVERTS | {"share", "sharing", "social", "skip"}
_WITH = frozenset("no not has have with without hide show is".split())  # "has-sidebar" is a page with one
DEPTH = 64  # deeper elements count as parts of the one at this depth


def digest(*parts: object) -> int:
    """A long out of a few texts and numbers, equal everywhere."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass(slots=True)
class Element:
    """key: its place in the site's tree, out of the keys above, its tag, and its class and id without longer numbers. names: what stands in it, runs of one name once."""

    tag: str
    key: int
    above: Element | None
    depth: int
    words: list[str]
    attributes: dict[str, str]
    names: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0  # of the characters, those in links
    links: int = 0

    def chain(self) -> list[Element]:
        out, e = [], self
        while e:
            out.append(e)
            e = e.above
        return out


@dataclass(slots=True)
class Block:
    text: str
    at: Element


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def read(page: str | None, site: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of text of a page, in its order. A block is the text between two bounds of block elements, white space made one space."""
    root = Element("html", digest(site), None, 0, [], {})
    elements, blocks, pieces = [root], [], []
    stack: list[tuple[str, Element, bool]] = [("html", root, False)]  # open tags, the element that they are or lie in, whether their text is dropped

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            blocks.append(Block(text, stack[-1][1]))

    def close(upto: int) -> None:
        if any(name in BLOCK for name, _, _ in stack[upto:]):
            flush()
        elif any(name in _CELLS for name, _, _ in stack[upto:]):
            pieces.append(" ")
        del stack[upto:]

    def last(names, until=frozenset()) -> int:
        """The innermost open tag of these names, 0 if there is none or one of `until` comes first."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in until:
                break
        return 0

    at, text = 0, page or ""
    while m := _TOKEN.match(text, at):
        at = m.end()
        _, inside, silent = stack[-1]
        if (piece := m["text"]) is not None:
            if not silent:
                pieces.append(piece := html.unescape(piece))
                n = len(piece.strip())
                inside.chars += n
                if last({"a"}):
                    inside.linked += n
            continue
        if not (tag := m["tag"]):
            continue
        name = _NAME.match(tag)[1].lower()
        if name == "br":
            pieces.append(" ")
        elif tag[1] == "/":
            k = last({name})
            # an inline element's end doesn't end the blocks within it
            if k and (name in BLOCK or name in _CELLS or name in SILENT or not any(n in BLOCK for n, _, _ in stack[k + 1 :])):
                close(k)
            elif name == "p":
                flush()
        elif name in ("html", "body"):
            pass
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            if name in BLOCK and name not in _KEEPS_P and (k := last({"p"}, _P_ENDS_AT)):
                close(k)
            if name in HEADINGS and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
            if name in _CLOSES and (k := last(*_CLOSES[name])):
                close(k)
            _, inside, silent = stack[-1]
            given = _attributes(tag[1 + len(name) :].rstrip(">")) if len(tag) > len(name) + 2 else {}
            words = [w.lower() for a in ("class", "id", "role") if a in given for w in [*_WORDS.findall(given[a]), "|"]]
            if name in BLOCK:
                flush()
                mark = f"{name}.{_DIGITS.sub('#', given.get('class', ''))}#{_DIGITS.sub('#', given.get('id', ''))}"
                deep = inside.depth >= DEPTH
                e = Element(name, inside.key if deep else digest(inside.key, mark), inside, min(inside.depth + 1, DEPTH), words, given)
                elements.append(e)
                if not inside.names or inside.names[-1] != mark:
                    inside.names.append(mark)
                inside = e
            elif name == "a":
                inside.links += 1
            stack.append((name, inside, silent or name in SILENT or name not in BLOCK and bool(_INLINE & set(words))))
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(text, at)
                at = end.start() if end else len(text)
            elif name in SILENT and tag.endswith("/>"):
                stack.pop()
    flush()
    return elements, blocks


def declared_out(e: Element, in_main: bool) -> bool:
    """Whether an element's own markup says that it is no part of the text."""
    if not e.above:
        return False
    if e.tag in CHROME_TAGS or e.tag == "header" and not in_main or "hidden" in e.attributes or re.search(r"display\s*:\s*none", e.attributes.get("style", "")):
        return True
    if e.tag == "main":
        return False
    known = CHROME_WORDS
    if e.tag == "article":
        known = _TALK | _ADVERTS | {"related", "promo"}
    elif e.tag in HEADINGS or e.tag == "p" and in_main:
        known = _TALK | _ADVERTS | {"share", "sharing", "related", "newsletter", "subscribe"}
    before = ""
    for w in e.words:
        if before not in _WITH and (w in known or w == "header" and not in_main and known is CHROME_WORDS):
            return True
        before = w
    return False


def declared_main(e: Element) -> int:
    """2 for an article, 1 for a main part, 0 for others."""
    role = e.attributes.get("role", "").lower()
    return 2 if e.tag == "article" or role == "article" or "articlebody" in e.attributes.get("itemprop", "").lower() else 1 if e.tag == "main" or role == "main" else 0


def main_blocks(elements: list[Element], blocks: list[Block], noisy) -> list[str]:
    """Texts of a page's blocks without branches that the markup declares to be no part of the text or whose keys are noisy.

    An article, or else a main part, that the markup declares and that holds any text is the whole of it, and noisy keys
    that would leave nothing of it aren't followed. Elsewhere elements that hold nothing but two links or more go too.
    """
    state: dict[int, tuple[int, bool, bool]] = {}  # of each element: the main part that it lies in, whether it's declared out, whether it's noisy
    for e in elements:  # each comes after the one above it
        main, out, noise = state[id(e.above)] if e.above else (0, False, False)
        out = out or declared_out(e, main > 0)
        state[id(e)] = (main if out else max(main, declared_main(e)), out, noise or e.above is not None and e.key in noisy)
    for kind in (2, 1):
        inside = [b for b in blocks if state[id(b.at)][0] >= kind and not state[id(b.at)][1]]
        if inside:
            return [b.text for b in inside if not state[id(b.at)][2]] or [b.text for b in inside]
    for e in reversed(elements):
        if e.above:
            e.above.chars, e.above.linked, e.above.links = e.above.chars + e.chars, e.above.linked + e.linked, e.above.links + e.links
    menus = {id(e) for e in elements if e.above and e.links > 1 and e.chars == e.linked}
    return [b.text for b in blocks if not any(state[id(b.at)][1:]) and not any(id(e) in menus for e in b.at.chain())]
