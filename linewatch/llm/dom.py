"""Small lenient DOM: trees of (tag, marks, children), enough to align and read pages."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_MARK = re.compile(r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
# Elements of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
    section select summary table tbody td tfoot th thead tr ul""".split())
#: Elements that end an open paragraph.
_ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: An opening tag ends open ones of these, up to the nearest of the second list.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
         "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)),
         "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
         "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
         "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}


class Node:
    """``marks``: its class, id and role in lower case. Children are nodes or strings."""

    __slots__ = ("children", "label", "marks", "tag")

    def __init__(self, tag: str, marks: tuple[str, ...] = ()) -> None:
        self.tag, self.marks, self.children = tag, marks, []
        self.label = f"{tag} {' '.join(marks)}" if marks else tag


def parse(page: str) -> Node:
    root = Node("#root")
    stack = [root]
    last, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a and (found := page[a:b]):
            stack[-1].children.append(html.unescape(found) if "&" in found else found)

    at = page.find("<")
    while 0 <= at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            at = page.find("<", at + 1)
            continue
        text(last, at)
        last = at = m.end()
        name = m[2]
        if name is not None:
            tag = name.lower()
            if m[1]:
                _close(stack, tag)
            else:
                _imply(stack, tag)
                node = Node(tag, _marks(m[3]) if m[3] else ())
                stack[-1].children.append(node)
                if tag in RAW:
                    close = re.compile(f"</{tag}[\\s>/]", re.I).search(page, at)
                    if close is None:
                        return root
                    gt = page.find(">", close.start())
                    last = at = end if gt < 0 else gt + 1
                elif tag not in VOID and not m[3].endswith("/"):
                    stack.append(node)
        at = page.find("<", at)
    text(last, end)
    return root


def _marks(attributes: str) -> tuple[str, ...]:
    found = []
    for name, value in _MARK.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            found += [f"{name}={v}" for v in html.unescape(value.strip("\"'")).lower().split()]
        elif name in ("hidden", "aria-hidden", "style"):
            flat = value.strip("\"'").lower().replace(" ", "")
            if name == "hidden" or flat == "true" or "display:none" in flat:
                found.append("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|$|/)", attributes):
        found.append("hidden")
    return tuple(found)


def _imply(stack: list[Node], tag: str) -> None:
    if tag in _ENDS_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in ("td", "th", "button", "object", "caption"):
                break
    if tag in _ENDS:
        ends, within = _ENDS[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within:
                break
            if stack[k].tag in ends and not any(x.tag in ends for x in stack[1:k] if x.tag not in within) \
                    or stack[k].tag in ends and k and stack[k - 1].tag in (*within, "tbody", "thead", "tfoot", "#root"):
                del stack[k:]
                break


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in BLOCK and tag not in BLOCK:  # a stray inline end tag doesn't end blocks
            return
