"""Fields of a page by selectors, read from its tree in one Arrow function."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from folioscope.functions import html
from folioscope.functions.text import _c

_PART = re.compile(r"""(?P<tag>[a-z][a-z0-9]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<op>[*^$]?=)["']?(?P<want>[^"'\]]*)["']?)?\]""", re.I)
#: Elements whose content is no text.
_MUTE = frozenset("script style noscript template".split())


@dataclass(frozen=True)
class Field:
    """What is read where a selector leads.

    take: `text` of the first element, `texts` of all, an attribute of the first as `@name`, `html`
    within the first, or `full`, whether the first holds text or an image. drop: elements that go first.
    """

    selector: str
    take: str = "text"
    drop: tuple[str, ...] = ()


def _steps(selector: str) -> list[list[tuple]]:
    """The elements that a selector leads through, from the outermost; spaces within brackets part nothing."""
    return [_compound(s) for s in re.findall(r"(?:\[[^\]]*\]|\S)+", selector)]


def _compound(source: str) -> list[tuple]:
    """Tests of one element: its tag, id, classes and attributes; anything else is an error."""
    tests, at = [], 0
    while at < len(source):
        m = _PART.match(source, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"no selector: {source}")
        tests.append(("tag", m["tag"].lower()) if m["tag"] else ("id", m["id"]) if m["id"] else ("class", m["cls"]) if m["cls"] else ("attr", m["name"].lower(), m["op"], m["want"]))
        at = m.end()
    return tests


def _fits(node: html.Node, tests: list[tuple]) -> bool:
    for kind, *of in tests:
        if kind == "tag":
            if node.tag != of[0]:
                return False
        elif kind == "class":
            if of[0] not in (node.get("class") or "").split():
                return False
        elif kind == "id":
            if node.get("id") != of[0]:
                return False
        else:
            name, op, want = of
            held = node.get(name)
            if held is None or not (op is None or (op == "=" and held == want) or (op == "*=" and want in held) or (op == "^=" and held.startswith(want)) or (op == "$=" and held.endswith(want))):
                return False
    return True


def _found(node: html.Node, steps: list[list[tuple]], met: int = 0):
    """Elements below node, in the order of the page, that a selector's steps lead to; each step is anywhere below the one before."""
    for child in node.children:
        if isinstance(child, html.Node):
            # a step that is met stays met below; the last one must be met by the element itself
            if met == len(steps) - 1 and _fits(child, steps[-1]):
                yield child
            below = met + 1 if met < len(steps) - 1 and _fits(child, steps[met]) else met
            yield from _found(child, steps, below)


def _said(node: html.Node | str) -> str:
    if isinstance(node, str):
        return node
    return "" if node.tag in _MUTE else "".join(map(_said, node.children))


def _plain(node: html.Node) -> str:
    return re.sub(r"\s+", " ", _said(node)).strip()


def _without(node: html.Node, tags: tuple[str, ...]) -> html.Node:
    if not tags:
        return node
    out = html.Node(node.tag, node.attrs)
    out.children = [c if isinstance(c, str) else _without(c, tags) for c in node.children if isinstance(c, str) or c.tag not in tags]
    return out


def read_fields(source: str, fields: dict[str, Field]) -> dict:
    """The fields of one page; what is not there is empty (`full`: false)."""
    tree, out = html.parse(source), {}
    for name, f in fields.items():
        nodes = _found(tree, _steps(f.selector))
        if f.take == "texts":
            out[name] = [_plain(_without(n, f.drop)) for n in nodes]
            continue
        first = next(nodes, None)
        node = _without(first, f.drop) if first is not None else None
        if f.take == "full":
            out[name] = node is not None and (_plain(node) != "" or next(_found(node, [[("tag", "img")]]), None) is not None)
        elif node is None:
            out[name] = ""
        elif f.take == "html":
            out[name] = "".join(html.sanitise_node(c) for c in node.children)
        else:
            out[name] = _plain(node) if f.take == "text" else re.sub(r"\s+", " ", node.get(f.take[1:]) or "").strip()
    return out


def select_fields(page: Column | str, fields: dict[str, Field]) -> Column:
    """A struct of the fields of a page, in one pass over its tree; null for a null page."""
    kinds = {"texts": "array<string>", "full": "boolean"}
    shape = ", ".join(f"`{name}` {kinds.get(f.take, 'string')}" for name, f in fields.items())
    for f in fields.values():
        _steps(f.selector)  # a selector that is none is an error here, not in a task

    def run(pages: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(fields)
        return pd.DataFrame([read_fields(p, fields) if p is not None else empty for p in pages], columns=list(fields))

    return F.when(_c(page).isNotNull(), F.pandas_udf(run, shape)(_c(page)))
