"""Trees of HTML and XML by the standard library, and selectors over them.

Markup may be broken: end tags that fit nothing are dropped, elements that HTML doesn't nest are closed. The
selectors are a subset of CSS: tag, *, #id, .class, [attr], [attr=v], ^=, $=, *=, ~=, :first-child, :not(simple),
descendants, children (>), siblings (+), lists; and ::text, ::attr(name) for what is extracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an element of HTML closes when it begins.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}} | {h: {"p"} for h in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "table", "ul", "ol", "section", "article", "figure")}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: "Node | None" = None

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag not in ("script", "style"):
                    stack += reversed(x.children)
            else:
                out.append(x)
        return "".join(out)

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def html(self) -> str:
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        inner = "".join(c.html() if isinstance(c, Node) else c for c in self.children)
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID and not inner else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml = xml
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        name = self.get_starttag_text() if self.xml else None
        if name:
            tag = re.match(r"<\s*([^\s/>]+)", name)[1]
        if not self.xml and tag in _CLOSES:
            while self.at.tag in _CLOSES[tag]:
                self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if self.xml or tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag.lower() == tag.lower() and (self.xml or tag not in VOID):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag.lower() != tag.lower():
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.at.children.append(data[6:])


def parse(text: str, xml: bool = False) -> Node:
    builder = _Builder(xml)
    builder.CDATA_CONTENT_ELEMENTS = () if xml else builder.CDATA_CONTENT_ELEMENTS
    builder.feed(text)
    builder.close()
    return builder.root


# --- selectors ---------------------------------------------------------------------------------------------------------

_SIMPLE = re.compile(r"(?P<tag>[\w|-]+|\*)|#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[(?P<attr>[\w:.-]+)(?:(?P<op>[\^$*~]?=)[\"']?(?P<value>[^\]\"']*)[\"']?)?\]|:(?P<pseudo>first-child|last-child)|:not\((?P<no>[^()]+)\)")


def _compound(css: str) -> list[dict]:
    at, out = 0, []
    while at < len(css):
        m = _SIMPLE.match(css, at)
        if not m:
            raise ValueError(f"selector not understood: {css!r}")
        out.append({k: v for k, v in m.groupdict().items() if v is not None})
        at = m.end()
    return out


def _fits(node: Node, tests: list[dict]) -> bool:
    for t in tests:
        if "tag" in t:
            ok = t["tag"] == "*" or node.tag.lower() == t["tag"].replace("|", ":").lower()
        elif "id" in t:
            ok = node.attrs.get("id") == t["id"]
        elif "class" in t:
            ok = t["class"] in node.attrs.get("class", "").split()
        elif "pseudo" in t:
            around = node.parent.elements() if node.parent else [node]
            ok = around[0 if t["pseudo"] == "first-child" else -1] is node
        elif "no" in t:
            ok = not _fits(node, _compound(t["no"]))
        else:
            value = node.attrs.get(t["attr"], node.attrs.get(t["attr"].lower()))
            want = t.get("value")
            ok = value is not None and {None: lambda: True, "=": lambda: value == want, "^=": lambda: value.startswith(want), "$=": lambda: value.endswith(want), "*=": lambda: want in value, "~=": lambda: want in value.split()}[t.get("op")]()
        if not ok:
            return False
    return True


def _steps(css: str) -> list[tuple[str, list[dict]]]:
    parts = re.findall(r"\s*([>+]?)\s*((?:\[[^\]]*\]|[^\s>+\[])+)", css.strip())
    return [(rel or " ", _compound(c)) for rel, c in parts]


def _reaches(node: Node, steps: list, root: Node) -> bool:
    rel, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    if rel == "+":
        around = node.parent.elements() if node.parent else []
        i = around.index(node) if node in around else 0
        return i > 0 and _reaches(around[i - 1], steps[:-1], root)
    up = node.parent
    while up is not None:
        if _reaches(up, steps[:-1], root):
            return True
        if rel == ">":
            return False
        up = up.parent
    return False


def select(root: Node, css: str) -> list:
    """Nodes in document order, or texts where the selector ends with ::text or ::attr(name)."""
    out: list = []
    for one in re.split(r",(?![^\[(]*[\])])", css):
        m = re.search(r"::(text|attr\(([\w:-]+)\))\s*$", one)
        base = one[: m.start()] if m else one
        steps = _steps(base)
        nodes = [n for n in root.walk() if n is not root and _reaches(n, steps, root)]
        if m and m[1] == "text":
            out += ["".join(c for c in n.children if not isinstance(c, Node)) if any(isinstance(c, str) for c in n.children) else n.text() for n in nodes]
        elif m:
            out += [n.attrs[m[2]] for n in nodes if m[2] in n.attrs]
        else:
            out += nodes
    if out and isinstance(out[0], Node):
        order = {id(n): i for i, n in enumerate(root.walk())}
        seen: dict[int, Node] = {id(n): n for n in out}
        out = sorted(seen.values(), key=lambda n: order.get(id(n), 0))
    return out


_XSTEP = re.compile(r"(//?|^)(?:(text\(\))|@([\w:-]+)|(\.\.?|[\w:*-]+))((?:\[[^\]]*\])*)")


def xpath(root: Node, path: str) -> list:
    """Nodes in document order, or texts for a path that ends with text() or @name. A subset of XPath: child and
    descendant steps, '.', '..', '*', unions with '|', and predicates on positions, attributes (present, equal, contains,
    starts-with) and own text."""
    if "|" in path:
        parts = [x for one in path.split("|") for x in xpath(root, one.strip())]
        if parts and isinstance(parts[0], Node):
            order = {id(n): i for i, n in enumerate(root.walk())}
            return sorted({id(n): n for n in parts}.values(), key=lambda n: order.get(id(n), 0))
        return parts
    at, found = 0, [root]
    while at < len(path):
        m = _XSTEP.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"no XPath of this subset: {path[at:]}")
        deep, at = m[1] == "//", m.end()
        if m[2] or m[3]:
            inner = [n for base in found for n in (base.walk() if deep else [base])]
            out = [x for n in dict.fromkeys(inner) for x in ([c for c in n.children if not isinstance(c, Node)] if m[2] else [n.attrs[m[3]]] if m[3] in n.attrs else [])]
            if at < len(path):
                raise ValueError(f"a text has nothing below it: {path}")
            return out
        if m[4] == ".":
            found = list(dict.fromkeys(n for base in found for n in base.walk())) if deep else found
            continue
        if m[4] == "..":
            found = list(dict.fromkeys(n.parent for n in found if n.parent is not None))
            continue
        new: dict[Node, None] = {}
        for base in found:
            parents = base.walk() if deep else [base]
            for parent in parents:
                fits = [c for c in parent.elements() if m[4] in ("*", c.tag)]
                for test in re.findall(r"\[([^\]]*)\]", m[5]):
                    fits = _tested(fits, test.strip())
                new.update(dict.fromkeys(fits))
        found = list(new)
    return found


def _tested(nodes: list[Node], test: str) -> list[Node]:
    if test.isdigit():
        return nodes[int(test) - 1 : int(test)]
    if test == "last()":
        return nodes[-1:]
    if m := re.fullmatch(r"(contains|starts-with)\(\s*(@[\w:-]+|\.|text\(\))\s*,\s*(['\"])(.*?)\3\s*\)", test):
        value = lambda n: n.attrs.get(m[2][1:], "") if m[2][0] == "@" else n.text()
        return [n for n in nodes if (m[4] in value(n) if m[1] == "contains" else value(n).startswith(m[4]))]
    if m := re.fullmatch(r"@([\w:-]+)(?:\s*(!?=)\s*(['\"])(.*?)\3)?", test):
        return [n for n in nodes if m[1] in n.attrs and (m[2] is None or (n.attrs[m[1]] == m[4]) == (m[2] == "="))]
    if m := re.fullmatch(r"(?:text\(\)|\.)\s*=\s*(['\"])(.*?)\1", test):
        return [n for n in nodes if n.text() == m[2]]
    raise ValueError(f"no predicate of this subset: {test}")


def text_of(x) -> str:
    return re.sub(r"\s+", " ", x.text() if isinstance(x, Node) else x).strip()


def cleaned(root: Node, kill: tuple[str, ...] = ("script", "style", "noscript"), strip: tuple[str, ...] = (), allow: tuple[str, ...] | None = None) -> Node:
    """The tree without the killed elements; stripped ones, and those not allowed, leave their content."""
    dead = {id(n) for css in kill for n in select(root, css)}
    bare = {id(n) for css in strip for n in select(root, css)}
    if allow is not None:
        fine = {id(n) for css in allow for n in select(root, css)}
        bare |= {id(n) for n in root.walk() if n is not root and id(n) not in fine}

    def copy(node: Node, parent: Node | None) -> Node:
        new = Node(node.tag, dict(node.attrs), [], parent)
        for c in node.children:
            if not isinstance(c, Node):
                new.children.append(c)
            elif id(c) not in dead:
                if id(c) in bare:
                    new.children += [_moved(x, new) for x in copy(c, new).children]
                else:
                    new.children.append(copy(c, new))
        return new

    return copy(root, None)


def _moved(x, parent: Node):
    if isinstance(x, Node):
        x.parent = parent
    return x
