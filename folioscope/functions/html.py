"""HTML to text, clean HTML and Markdown, links and script values. Tree work runs in pandas UDFs, patterns on the JVM."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from folioscope.functions.text import _c

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that act; the cleaner takes them out with their content, and `meta` that refreshes (fixed values).
ACTIVE = frozenset("script object embed base".split())
#: Elements without text to read.
SILENT = frozenset("script style noscript template object embed link meta head title".split())
BLOCKS = frozenset("address article aside blockquote div dl dt dd fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
#: Attributes that hold one URL (fixed values).
URL_ATTRIBUTES = frozenset("action formaction href poster src xlink:href".split())
#: Bars under an article, by id and class (fixed values).
BAR_IDS, BAR_CLASS = frozenset(("content_bottom_area", "js_article_bottom_bar")), "__bottom-bar__"
#: Within a table of Markdown: elements that stay, elements that go with their content, and attributes that stay, on any element and on some (fixed values).
TABLE_TAGS = frozenset("a b blockquote br caption code col colgroup del em i img li ol p pre s span strong table tbody td tfoot th thead tr ul".split())
TABLE_DROPS = frozenset("base embed iframe link math meta noscript object script style svg".split())
TABLE_ATTRIBUTES = {"": frozenset("align colspan rowspan scope span".split()), "a": frozenset("href title".split()), "img": frozenset("alt height src title width".split())}
#: Images that may stand in the URL itself (fixed values).
RASTER = re.compile(r"data:image/(?:avif|bmp|gif|jpe?g|png|webp);base64,[a-z0-9+/]+=*", re.I)
#: Deepest nesting that is followed; deeper elements are read as children of the last one.
DEEPEST = 256


class Node:
    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        return next((v or "" for k, v in self.attrs if k == name), None)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", [])
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "tr", "td", "th", "option") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(source: str) -> Node:
    tree = _Tree()
    tree.feed(source)
    tree.close()
    return tree.root


def _compact(value: str) -> str:
    return re.sub(r"[\x00-\x20]+", "", value)


def safe_attribute(tag: str, name: str, value: str) -> bool:
    """Whether an attribute neither runs anything nor loads what runs; data URLs are for the source of an image only."""
    if name.startswith("on") or name == "srcdoc" or not re.fullmatch(r"[a-z_:@][\w:.@-]*", name):
        return False
    plain = _compact(value).lower()
    if name == "srcset":
        return not re.search("(?:javascript|vbscript|data):", plain)
    if name not in URL_ATTRIBUTES:
        return True
    if plain.startswith("data:"):
        return tag == "img" and name == "src" and plain.startswith("data:image/")
    return not plain.startswith(("javascript:", "vbscript:"))


def safe_link(value: str, mail: bool = True, raster: bool = False) -> bool:
    """Whether a URL of Markdown leads to a page, a message or, with raster, to an image of dots."""
    plain = _compact(value)
    if plain.lower().startswith("data:"):
        return raster and RASTER.fullmatch(plain) is not None
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", plain, re.I)
    return bool(plain) and (not scheme or scheme[1].lower() in ("http", "https", *(["mailto"] if mail else [])))


def _element(node: Node, attrs: list[tuple[str, str]], inner: str) -> str:
    return f"<{node.tag}{''.join(f' {k}=\"{entities.escape(v)}\"' for k, v in attrs)}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")


def _write(node: Node | str) -> str:
    if isinstance(node, str):
        return entities.escape(node, quote=False)
    tag = node.tag
    if tag in ACTIVE or (tag == "meta" and (node.get("http-equiv") or "").strip().lower() == "refresh"):
        return ""
    if tag in ("set", "animate") and _compact(node.get("attributename") or "").lower().endswith("href"):
        return ""
    # a sheet is no markup, and must be none where it stands in a drawing
    inner = "".join(str(c) for c in node.children).replace("<", "\\3c ") if tag == "style" else "".join(map(_write, node.children))
    if not tag:
        return inner
    attrs = [(k, v or "") for k, v in node.attrs if safe_attribute(tag, k, v or "")]
    if tag == "iframe":
        attrs = [(k, v) for k, v in attrs if k not in ("sandbox", "referrerpolicy", "allow")] + [("sandbox", ""), ("referrerpolicy", "no-referrer")]
    if tag == "img" and not node.get("src") and node.get("data-src") and safe_attribute("img", "src", node.get("data-src") or ""):
        attrs = [(k, v) for k, v in attrs if k != "src"] + [("src", node.get("data-src") or "")]
    return _element(node, attrs, inner)


def sanitise(source: str) -> str:
    """HTML without active elements, event handlers and unsafe URLs; lazy images get their source, frames an empty sandbox."""
    return _write(parse(source))


def sanitise_node(node: Node | str) -> str:
    """A node of a tree as HTML, sanitised."""
    return _write(node)


def _is_bar(node: Node) -> bool:
    return node.get("id") in BAR_IDS or BAR_CLASS in (node.get("class") or "").split()


def _table(node: Node | str) -> str:
    """A table as it may stand in Markdown: known elements with known attributes and safe URLs; of others the content."""
    if isinstance(node, str):
        return entities.escape(node, quote=False)
    if node.tag in TABLE_DROPS or _is_bar(node):
        return ""
    inner = "".join(map(_table, node.children))
    if node.tag not in TABLE_TAGS:
        return inner
    known = TABLE_ATTRIBUTES[""] | TABLE_ATTRIBUTES.get(node.tag, frozenset())
    attrs = [(k, v or "") for k, v in node.attrs if k in known and (k != "href" or safe_link(v or "")) and (k != "src" or safe_link(v or "", mail=False, raster=True))]
    return _element(node, attrs, inner)


def _text(node: Node | str, out: list[str]) -> None:
    if isinstance(node, str):
        out.append(node)
        return
    if node.tag in SILENT:
        return
    block = node.tag in BLOCKS or node.tag == "br"
    if block:
        out.append("\n")
    for child in node.children:
        _text(child, out)
    if block:
        out.append("\n")


def to_text(source: str) -> str:
    """Visible text: one line per block, runs of spaces as one, no blank lines."""
    out: list[str] = []
    _text(parse(source), out)
    lines = (re.sub(r"[ \t\r\f ]+", " ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def _inline(children: list) -> str:
    return re.sub(r"\s+", " ", "".join(_markdown(c) for c in children))


def _markdown(node: Node | str, depth: int = 0, mark: str = "-") -> str:
    if isinstance(node, str):
        return re.sub(r"([\\`*_\[\]])", r"\\\1", node)
    tag, children = node.tag, node.children
    if tag in SILENT or _is_bar(node):
        return ""
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {_inline(children).strip()}\n\n"
    if tag in ("strong", "b", "em", "i"):
        inner = _inline(children)
        edge = "**" if tag in ("strong", "b") else "*"
        return f"{edge}{inner.strip()}{edge}" if inner.strip() else inner
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "a":
        href, inner = node.get("href") or "", _inline(children).strip()
        return f"[{inner}]({href})" if safe_link(href) else inner
    if tag == "img":
        src = node.get("src") or node.get("data-src") or ""
        return f"![{node.get('alt') or ''}]({src})" if safe_link(src, mail=False, raster=True) else ""
    if tag in ("code", "kbd") and not any(isinstance(c, Node) for c in children):
        return f"`{''.join(children)}`"
    if tag == "pre":
        out: list[str] = []
        _text(node, out)
        return f"\n\n```\n{''.join(out).strip()}\n```\n\n"
    if tag == "table":
        return f"\n\n{_table(node)}\n\n"
    if tag in ("ul", "ol"):
        items = [c for c in children if isinstance(c, Node) and c.tag == "li"]
        lines = []
        for k, item in enumerate(items, 1):
            body = re.sub(r"\n{2,}", "\n", "".join(_markdown(c) for c in item.children).strip()).replace("\n", "\n    ")
            lines.append(f"{f'{k}. ' if tag == 'ol' else f'{mark}   '}{body}")
        return "\n\n" + "\n".join(lines) + "\n\n"
    if tag == "blockquote":
        body = "".join(_markdown(c) for c in children).strip()
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in re.sub(r"\n{3,}", "\n\n", body).split("\n")) + "\n\n"
    inner = "".join(_markdown(c) for c in children)
    return f"\n\n{inner.strip()}\n\n" if tag in BLOCKS else inner


def to_markdown(source: str) -> str:
    """Markdown with # headings, dashes, fenced code; tables stay as HTML of few elements; bars and images that could run go."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n(?! )", lambda m: "  \n" if m[0].startswith("  ") else "\n", _markdown(parse(source)))).strip()


class _Literal:
    """Reads a script literal by descent: objects, arrays, strings, numbers, decode calls, `* 1` and unary signs; nothing is run."""

    CALLS = ("JsDecode", "htmlDecode")
    MOST, DEEP = 300_000, 128
    TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>\|\||[{}\[\](),:*+\-!.;]))""", re.S)

    def __init__(self, source: str, at: int):
        self.source, self.at, self.seen = source, at, 0

    def peek(self) -> tuple[str, str]:
        m = self.TOKEN.match(self.source, self.at)
        if not m:
            raise ValueError("no literal")
        self.end = m.end()
        return m.lastgroup or "", m[m.lastgroup or 0]

    def take(self, want: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if want is not None and text != want:
            raise ValueError("no literal")
        self.at, self.seen = self.end, self.seen + 1
        if self.seen > self.MOST:
            raise ValueError("too many parts")
        return kind, text

    def value(self, deep: int = 0):
        left = self.product(deep)
        while self.rest("||"):
            right = self.product(deep)
            left = left or right
        return left

    def rest(self, op: str) -> bool:
        try:
            if self.peek() == ("op", op):
                self.take()
                return True
        except ValueError:
            pass
        return False

    def product(self, deep: int):
        out = self.single(deep)
        while self.rest("*"):
            other = self.single(deep)
            out = _number(float(out) * float(other))
        return out

    def single(self, deep: int):
        if deep > self.DEEP:
            raise ValueError("too deep")
        kind, text = self.take()
        if kind == "str":
            return _unescape(text[1:-1])
        if kind == "num":
            return int(text, 16) if text[:2].lower() == "0x" else _number(float(text))
        if kind == "name":
            if text in ("true", "false", "null", "undefined"):
                return {"true": True, "false": False}.get(text)
            if text not in self.CALLS:
                raise ValueError("not allowed")
            self.take("(")
            inner = self.value(deep + 1)
            self.take(")")
            return entities.unescape(str(inner)) if text == "htmlDecode" else _unescape(str(inner))
        if text in "+-!":
            inner = self.single(deep + 1)
            return not inner if text == "!" else _number(float(inner) * (-1 if text == "-" else 1))
        if text == "(":
            inner = self.value(deep + 1)
            self.take(")")
            return inner
        if text == "[":
            items: list = []
            while not self.rest("]"):
                items.append(self.value(deep + 1))
                if not self.rest(","):
                    self.take("]")
                    break
            return items
        if text == "{":
            fields: dict = {}
            while not self.rest("}"):
                kind, key = self.take()
                key = _unescape(key[1:-1]) if kind == "str" else key
                if kind == "op" or key in ("__proto__", "constructor", "prototype"):
                    raise ValueError("not allowed")
                self.take(":")
                fields[key] = self.value(deep + 1)
                if not self.rest(","):
                    self.take("}")
                    break
            return fields
        raise ValueError("no literal")


def _number(x: float) -> float | int:
    return int(x) if x == int(x) else x


def _unescape(s: str) -> str:
    named = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
    return re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else named.get(m[3], m[3]), s, flags=re.S)


def script_value(source: str, name: str) -> str | None:
    """JSON of the literal assigned to a name in a page's scripts; null if there is none that is a plain literal."""
    if name not in source:
        return None
    m = re.search(rf"(?:window\.|var\s+|let\s+|const\s+)?{re.escape(name)}\s*=\s*(?!=)", source)
    if not m:
        return None
    try:
        return json.dumps(_Literal(source, m.end()).value(), ensure_ascii=False)
    except (ValueError, TypeError, OverflowError, RecursionError):
        return None


_TRIVIA = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)


def call_arguments(source: str, name: str) -> list:
    """The arguments of a page's calls `name(literal)`, in order; calls with anything but one plain literal are passed over, nothing is run."""
    found, at = [], source.find(name)
    while at >= 0:
        after = at + len(name)
        m = _TRIVIA.match(source, after)
        if not re.match(r"[\w$.]", source[at - 1 : at]) and source[m.end() : m.end() + 1] == "(":
            try:
                literal = _Literal(source, _TRIVIA.match(source, m.end() + 1).end())
                value = literal.value()
                end = _TRIVIA.match(source, literal.at).end()
                if source[end : end + 1] == ")":
                    found.append(value)
                    after = end + 1
            except (ValueError, TypeError, OverflowError, RecursionError):
                pass
        at = source.find(name, after)
    return found


def _udf(f: Callable[..., str | None]):
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore").astype(object), "string")


def html_text(x: Column | str) -> Column:
    return _udf(to_text)(_c(x))


def html_clean(x: Column | str) -> Column:
    return _udf(sanitise)(_c(x))


def html_markdown(x: Column | str) -> Column:
    return _udf(to_markdown)(_c(x))


def html_script_value(x: Column | str, name: str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: script_value(t, name), na_action="ignore").astype(object)

    return F.pandas_udf(run, "string")(_c(x))


def html_call_arguments(x: Column | str, name: str) -> Column:
    """A JSON array of the literal arguments of a page's calls of a name."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(call_arguments(t, name), ensure_ascii=False), na_action="ignore").astype(object)

    return F.pandas_udf(run, "string")(_c(x))


def decode_entities(x: Column | str) -> Column:
    """Ampersand entities of URLs, decoded."""
    out = _c(x)
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def title(x: Column | str) -> Column:
    return F.trim(F.regexp_extract(_c(x), r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))


def resources(x: Column | str) -> Column:
    """Distinct URLs of images, style sheets and backgrounds, in order."""
    images = F.regexp_extract_all(_c(x), F.lit(r"""(?i)<img\s[^>]*?(?:data-)?src=["']([^"']+)["']"""), F.lit(1))
    sheets = F.regexp_extract_all(_c(x), F.lit(r"""(?i)<link\s[^>]*?href=["']([^"']+\.css[^"']*)["']"""), F.lit(1))
    grounds = F.regexp_extract_all(_c(x), F.lit(r"""(?i)background(?:-image)?\s*:\s*[^;"']*url\(\s*["']?([^"')]+)"""), F.lit(1))
    return F.array_distinct(F.transform(F.concat(images, sheets, grounds), decode_entities))


#: Patterns of a comment id, tried in order (fixed values).
COMMENT_ID = (
    r"var comment_id = '(\d+)' \|\| '0';",
    r"comment_id:\s*JsDecode\('(\d+)'\)",
    r"d\.comment_id\s*=\s*xml \? getXmlValue\('comment_id\.DATA'\) : '(\d+)';",
    r"window\.comment_id\s*=\s*'(\d+)'",
)


def comment_id(x: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(x), p, 1), F.lit("")) for p in COMMENT_ID])


def assigned(x: Column | str, name: str) -> Column:
    """First non-empty quoted value of `var name = "" || "v"`, else its digits, else empty."""
    line = F.regexp_extract(_c(x), rf"(?:var\s+|window\.)?\b{name}\s*=\s*([^;\n]+)", 1)
    quoted = F.filter(F.regexp_extract_all(line, F.lit(r"""["']([^"']*)["']"""), F.lit(1)), lambda v: v != "")
    return F.coalesce(F.get(quoted, F.lit(0)), F.nullif(F.regexp_extract(line, r"^\s*(\d+)", 1), F.lit("")), F.lit(""))


def content_status(x: Column | str, content: str, deleted: str, error: str) -> Column:
    """Success, Deleted, Exception or Error of a page by its marks."""
    page = F.coalesce(_c(x), F.lit(""))
    return F.when(page.contains(content), "Success").when(page.contains(deleted), "Deleted").when(page.contains(error), "Exception").otherwise("Error")
