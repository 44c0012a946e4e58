"""Leaf blocks of a web page: text between block-level tags, with the tags above it.

Elements that are not block-level are part of the line they stand in, unknown ones and formulas
included. Scripts, drawings and other embedded things, and controls inside a paragraph, are
passed over without ending its line.
"""

import re
from html import unescape

#: Elements that end a line, those that show no text of their own, and form controls.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav noframes ol p "
    "plaintext pre search section summary table tbody td tfoot th thead title tr ul xmp".split())
HIDDEN = frozenset("annotation annotation-xml audio canvas datalist head iframe noscript object script style svg template title video".split())
CONTROLS = frozenset("button optgroup option select textarea".split())
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                      "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary "
                      "table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
_FENCE = frozenset("table ul ol dl div article section body html main select".split())
_NAME = re.compile(r"[a-z]{2,}")
_NAMED = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: A comment, a tag with quoted attributes, a tag with a stray quote, a declaration, or a cut-off tag.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"""
    r"""|<[!?/][^>]*+>|<[a-zA-Z!?/][^>]*+\Z""", re.S)
_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>|\Z", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "noscript")}


class Path:
    """The tags above a block, as a node of a tree: equal paths are one node, and each knows
    its own tag and its parent only, so a page may be nested to any depth. `kept` holds what
    is worked out for a node from that of its parent."""

    __slots__ = ("parent", "own", "depth", "below", "kept")

    def __init__(self, parent=None, own=None):
        self.parent, self.own, self.depth = parent, own, 0 if parent is None else parent.depth + 1
        self.below, self.kept = {}, {}

    def child(self, own):
        if own not in self.below:
            self.below[own] = Path(self, own)
        return self.below[own]

    def __len__(self):
        return self.depth

    def __iter__(self):
        up, node = [], self
        while node.parent is not None:
            up.append(node.own)
            node = node.parent
        return reversed(up)

    def __getitem__(self, i):
        return list(self)[i]

    def worked(self, name, start, step):
        """`step(parent's, own)` all the way down from `start` at the root; each node's is kept."""
        waiting, node = [], self
        while name not in node.kept and node.parent is not None:
            waiting.append(node)
            node = node.parent
        made = node.kept.get(name, start)
        for node in reversed(waiting):
            made = node.kept[name] = step(made, node.own)
        return made


class _Blocks:
    def __init__(self, root):
        self.root = root
        self.open = []  # (tag, path, whether it stands in a line)
        self.hidden = self.links = self.linked = 0
        self.parts, self.blocks = [], []

    @property
    def path(self):
        return self.open[-1][1] if self.open else self.root

    def read(self, html):
        at = 0
        while at < len(html):
            found = _MARKUP.search(html, at)
            stop = found.start() if found else len(html)
            if stop > at and not self.hidden:
                self.text(html[at:stop])
            if not found:
                break
            at = found.end()
            tag = found[2] or found[5]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1] or found[4]:
                self.end(tag)
                continue
            self.start(tag, found[3] or found[6] or "")
            if tag in _RAW:
                close = _RAW[tag].search(html, at)
                if not self.hidden:
                    self.text(html[at:close.start()])
                at = close.end()
                self.end(tag)
        self.end_block()
        return self.blocks

    def text(self, data):
        if "&" in data:
            data = unescape(data)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def end_block(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.path, text, min(1.0, self.linked / len(text))))
            self.parts = []
        self.linked = self.links = 0

    def keep(self, count):
        """Closes all but the first `count` open elements."""
        for tag, _, in_line in self.open[count:]:
            self.hidden -= tag in HIDDEN or tag in CONTROLS and in_line
        del self.open[count:]

    def push(self, tag, attributes, in_line):
        names = []
        if attributes:
            for key, *value in _NAMED.findall(attributes):
                names += ["hidden"] if key.lower() == "hidden" else _NAME.findall("".join(value).lower())
        self.open.append((tag, self.path.child((tag, tuple(names))), in_line))
        self.hidden += tag in HIDDEN or tag in CONTROLS and in_line

    def in_line(self, tag):
        """Whether an element stands in a line without ending it."""
        if tag in CONTROLS:
            return any(t == "p" for t, _, _ in self.open[-1:]) or bool(self.hidden)
        return tag not in BLOCK or bool(self.hidden)

    def start(self, tag, attributes):
        if tag == "br":
            self.parts.append(" " if not self.hidden else "")
            return
        if tag == "body":  # a head left open ends here
            for i, (t, _, _) in enumerate(self.open):
                if t == "head":
                    self.keep(i)
                    break
        if self.in_line(tag):
            self.links += tag == "a" and not self.hidden
            if tag not in VOID and not attributes.endswith("/") and (tag in HIDDEN or tag in CONTROLS or tag in BLOCK):
                self.push(tag, attributes, True)
            return
        self.end_block()
        if tag in _CLOSES_P:
            self.close({"p"})
        if tag in _SAME:
            self.close(_SAME[tag])
        if tag not in VOID and not (attributes.endswith("/") and tag in HIDDEN):
            self.push(tag, attributes, False)

    def close(self, tags):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.keep(i)
                return
            if self.open[i][0] in _FENCE:
                return

    def end(self, tag):
        if tag not in BLOCK and tag not in HIDDEN and tag not in CONTROLS:
            self.links -= tag == "a" and self.links > 0
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if not self.open[i][2]:
                    self.end_block()
                self.keep(i)
                return
        if tag in BLOCK and not self.hidden:
            self.end_block()


def page_blocks(html, root=None):
    """[(path, text, share of linked text)] in page order; a path is a sequence of (tag, names).
    Pages read with one `root` share the nodes of equal paths."""
    return _Blocks(Path() if root is None else root).read(html) if html else []
