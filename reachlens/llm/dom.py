"""A page's block tree: block elements as inner nodes, runs of inline text between block borders as leaves.

Inline elements leave no nodes, only whether text is inside a link. Missing end tags are made up for as browsers do: a block ends an open
paragraph, list items, cells and rows end their predecessors, and what is open ends with what holds it. Scripts, styles and other
elements without text of the page are passed over, comments too.
"""

from __future__ import annotations

import re
from html import unescape

# Elements of HTML by their part in a page's layout.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "label legend li main menu nav ol p pre search section select option optgroup summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style template iframe noframes noembed object svg math textarea title canvas audio video".split())
VOID = frozenset("hr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Start tags that end an open element of these names, unless one of the second list's is in between.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select", "optgroup"))}

TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>?|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>?)""", re.DOTALL)


class Tree:
    """Parallel lists, a value a node; a node's parent comes before it. The first node is the page."""

    def __init__(self) -> None:
        self.parent, self.depth, self.tag, self.attrs, self.text, self.linked = [-1], [0], ["#page"], [""], [""], [0]

    def add(self, parent: int, tag: str, attrs: str = "", text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def parse(html: str) -> Tree:
    """The block tree of a page. Leaves have the tag ``#text``, their text with white space as single spaces, and how much of it is in links."""
    tree, pieces = Tree(), []
    stack, names = [0], {}  # open elements, and how many of each name
    link, linked, at = 0, 0, 0  # the stack's length where a link began

    def close(upto: int) -> None:
        nonlocal link
        while len(stack) > upto:
            names[tree.tag[stack.pop()]] -= 1
        if link > len(stack):
            link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            tree.add(stack[-1], "#text", "", text, min(linked, len(text)))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        pieces.append(unescape(text) if "&" in text else text)
        if link:
            linked += len(text)

    def up_to(wanted: tuple[str, ...], fence: tuple[str, ...]) -> int:
        """Where the nearest open element of these names stands in the stack, 0 if there is none inside the fence."""
        if any(names.get(w) for w in wanted):
            for k in range(len(stack) - 1, 0, -1):
                tag = tree.tag[stack[k]]
                if tag in wanted:
                    return k
                if tag in fence:
                    return 0
        return 0

    while at < len(html):
        found = TOKEN.search(html, at)
        if found is None:
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name, ending = name.lower(), found.group(1)
        if name in SKIPPED:
            if not ending and not found.group(3).endswith("/"):
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
        elif name not in BLOCKS:
            if name == "a":
                link = 0 if ending else len(stack)
            elif name == "br":
                pieces.append(" ")
        elif ending:
            flush()
            k = up_to(HEADINGS if name in HEADINGS else (name,), ())
            if k:
                close(k)
        else:
            flush()
            if names.get("p"):
                close(up_to(("p",), ()))
            if name in ENDS:
                k = up_to(*ENDS[name])
                if k:
                    close(k)
            if name not in VOID and not (name in ("html", "body") and names.get(name)):
                stack.append(tree.add(stack[-1], name, found.group(3)))
                names[name] = names.get(name, 0) + 1
    if at < len(html):
        say(html[at:])
    flush()
    return tree
