"""A small tolerant reader of HTML: block elements and the runs of text between their boundaries, as flat arrays.

Only what the main-text operator needs: implied end tags, character references, white space, raw text of scripts and styles. Inline elements are
no nodes; they count in the statistics of the run they stand in. ``br`` is white space.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()
#: Never part of what a reader reads: scripts, styles, embedded objects, controls of forms, the head of the page.
UNREAD = frozenset(
    "script style template noscript head title meta link base svg iframe object embed canvas audio video map select option optgroup datalist "
    "button textarea input progress meter noembed noframes xmp param source track dialog".split()
)
CONTROLS = frozenset("input button select textarea label".split())

BLOCK = frozenset(BLOCKS)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
#: An element whose start ends an open one of the same kind, unless one of the others lies between.
SIBLING = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
CELL = frozenset("td th caption".split())
TABLE = frozenset("table tr td th tbody thead tfoot caption".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

RUN = "#run"
#: Codes of node kinds: every block element and a run of text.
KINDS = {name: k for k, name in enumerate([RUN, *BLOCKS])}


@dataclass
class Dom:
    """Nodes in page order. A parent stands before its children; -1 is the page itself."""

    kind: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)  # offset in the page
    controls: list[int] = field(default_factory=list)  # form controls directly inside
    tokens: list[list[str]] = field(default_factory=list)  # words of class, id, role
    text: list[str] = field(default_factory=list)  # of runs, "" for elements
    links: list[int] = field(default_factory=list)  # code points of a run inside links
    inline: list[int] = field(default_factory=list)  # inline tags of a run


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


def _tokens(attributes: dict[str, str]) -> list[str]:
    said = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
    return [t.lower() for t in TOKEN.findall(said)][:40] if said.strip() else []


def parse(page: str) -> Dom:
    """The blocks and runs of a page, whatever its mistakes; time grows with its length."""
    dom = Dom()
    stack: list[tuple[str, int, bool]] = []  # name, node or -1 for inline, unread
    opened: dict[str, int] = {}
    unread = 0
    pieces: list[str] = []
    run_links = run_inline = 0
    run_start = 0

    def holder() -> int:
        return next((n for _, n, _ in reversed(stack) if n >= 0), -1)

    def node(kind: int, tokens: list[str], at: int, text: str = "") -> int:
        parent = holder()
        dom.kind.append(kind)
        dom.parent.append(parent)
        dom.depth.append(dom.depth[parent] + 1 if parent >= 0 else 0)
        dom.start.append(at)
        dom.controls.append(0)
        dom.tokens.append(tokens)
        dom.text.append(text)
        dom.links.append(run_links if text else 0)
        dom.inline.append(run_inline if text else 0)
        return len(dom.kind) - 1

    def end_run() -> None:
        nonlocal pieces, run_links, run_inline
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node(KINDS[RUN], [], run_start, text)
            pieces = []
        run_links = run_inline = 0

    def pop() -> None:
        nonlocal unread
        name, n, off = stack.pop()
        opened[name] -= 1
        unread -= off

    def close(names: frozenset, stop: frozenset) -> None:
        """End the innermost open element of ``names``, if none of ``stop`` lies between."""
        if not any(opened.get(x) for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                end_run()
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            if not unread:
                if not pieces:
                    run_start = at
                text = references.unescape(page[at:lt])
                pieces.append(text)
                if opened.get("a"):
                    run_links += len(text.strip())
            at = lt
            continue
        if page.startswith("<!--", at):
            close_at = page.find("-->", at + 4)
            at = end if close_at < 0 else close_at + 3
            continue
        m = TAG.match(page, at) or PLAIN_TAG.match(page, at)
        if m is None:
            mark = page[at + 1 : at + 2]
            if mark and mark in "!?/":  # a declaration, or an end tag without a name
                close_at = page.find(">", at)
                at = end if close_at < 0 else close_at + 1
            else:
                if not unread:
                    pieces.append("<")
                at += 1
            continue
        begin, at = at, m.end()
        name = m[2].lower()
        if m[1]:  # an end tag
            if not opened.get(name):
                continue
            if name in BLOCK:
                end_run()
                close(frozenset([name]), frozenset() if name in TABLE else CELL)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][1] >= 0 and stack[k][0] in BLOCK:  # it began outside this block: the block goes on
                        break
            continue
        if name == "br":
            if not unread:
                pieces.append(" ")
            continue
        attributes = _attributes(m[3]) if len(m[3]) > 2 else {}
        off = name in UNREAD or "hidden" in attributes or ("style" in attributes and bool(HIDING.search(attributes["style"])))
        if name in CONTROLS:
            n = holder()
            if n >= 0:
                dom.controls[n] += 1
        if name in VOID and name != "hr":
            continue
        if name in BLOCK:
            end_run()
            if name in CLOSES_P and opened.get("p"):
                close(frozenset(["p"]), CELL | frozenset(["table"]))
            if name in SIBLING:
                names, stop = SIBLING[name]
                while True:  # a row ends its cell and the row before
                    before = len(stack)
                    close(names, stop)
                    if len(stack) == before or name in ("li", "dt", "dd"):
                        break
            if name in HEADING and stack and stack[-1][0] in HEADING:
                pop()
            if name in ("html", "body") and opened.get(name):
                continue
            n = node(KINDS[name], _tokens(attributes), begin) if not unread and not off else -1
            if name == "hr":
                continue
        else:
            n = -1
            run_inline += 1
            if name == "a" and opened.get("a"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "a":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in BLOCK:
                        break
        if m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW_TEXT:
            m = RAW_END[name].search(page, at)
            at = end if m is None else page.find(">", m.end())
            at = end if at < 0 else min(end, at + (m is not None))
            continue
        stack.append((name, n, off))
        opened[name] = opened.get(name, 0) + 1
        unread += off
    end_run()
    return dom
