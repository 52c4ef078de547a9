"""Problem 6: clean text from HTML, Markdown, wiki and LaTeX markup.

A text is parsed into one tree of blocks: HTML elements nest, and the lines of
their text give headings, list items, table rows, code, formulas and paragraphs
of the other notations. Paragraphs pass points for their length and commas to
their container and half of them to the container above; a container's points
are discounted by the share of its text that is links. The best container is
kept with those siblings that have enough points, read as prose or carry
structure. What the parser takes for markup on the way is noted with its
notation; a text of which it takes nothing holds no markup. The tree is written as plain text: "# " headings, "- " items, fenced code,
"$...$" formulas, " | " between table cells.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import spread

BLOCK_TAGS = (
    "address article aside blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul title abstract sec disp-formula "
    "list list-item"
)
INLINE_TAGS = (
    "a abbr acronym b bdi bdo big br cite code del dfn em font i img input ins kbd label link mark math meta q ref s samp script "
    "small span strike strong style sub sup svg tt u var wbr button option select iframe object param source video audio canvas "
    "references nowiki noinclude includeonly gallery blink italic bold monospace sc inline-formula tex-math head base embed hgroup"
)
_NAMES = set(BLOCK_TAGS.split()) | set(INLINE_TAGS.split())
_BLOCKS = set(BLOCK_TAGS.split())
_VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "base", "embed", "param", "source"}
_DROPPED = {"script", "style", "ref", "references", "head", "svg", "iframe", "button", "select", "nav"}
_FLAT = {"ref", "button", "select"}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z]+)*(?::[A-Za-z][\w-]*)?)((?:\s[^<>]*?)?)(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[|\]\]>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_MATH = re.compile(r"\$\$(.+?)\$\$|(?<![\\$])\$(?![\s$])((?:[^$\n]|\n(?![ \t]*\n))*?[^\s$\\])\$(?![$\d])", re.S)
_DISPLAY = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{(equation|align|math|displaymath|gather|eqnarray)(\*?)\}(.+?)\\end\{\3\4\}", re.S)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n(.*?)(?:^[ \t]*\1(?:[ \t]*$|[ \t]+(?=\S))|\Z)", re.S | re.M)
_TICKS = re.compile(r"(?<!`)`(?!`)([^`\n]+)`(?!`)")
_LATEX_CODE = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)\\end\{\1\}", re.S)
_COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\[\"'`^~=.](?:\{?\\?[A-Za-z]|\{\})|\\[%&_#$\[\](){},;!\\]")
_QUOTES = re.compile(r"``(?=\S)([^`\n]*?)''")
_HEADING = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?=\S)([^\n]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_BOLD = re.compile(r"\*\*(?=\S)([^*\n]+?)\*\*|(?<!\w)__(?=[^\s_])([^\n]+?)__(?!\w)")
_ITALIC = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?!\w)")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+)~~")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]+)\]\((?:[a-z][a-z0-9+.-]*:|//|/|#|\.{1,2}/|www\.)[^()\s]*(?:\s+\"[^\"]*\")?\)", re.I)
_MD_REF = re.compile(r"^\[[^\]\n]+\]:[ \t]+\S+.*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_WIKI_URL = re.compile(r"\[(?:https?|ftp)://\S+(?:[ \t]+([^\]\n]+))?\]")
_TEMPLATE = re.compile(r"\{\{(?![\s{}])[^{}]*\}\}")
_WIKI_TABLE = re.compile(r"^\{\||^\|\}|^\|-", re.M)
_WIKI_QUOTES = re.compile(r"'{2,5}(?=\S)([^'\n]+(?:'(?!')[^'\n]+)*)'{2,5}")
_ITEM = re.compile(r"^[ \t]*[-*+•][ \t]+(?=\S)", re.M)
_NUMBERED = re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)", re.M)
_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$", re.M)
_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*(?:\*[ \t]*){3,}$|^-{3,}$|^-{4,}", re.M)
_QUOTE = re.compile(r"^[ \t]*>+[ \t]+(?=\S)", re.M)

#: What a text must contain to be looked at more closely.
MAYBE = r"[<&\\$`#*_~\[{|=]|''|(?m)^[ \t]*([-+•>]|\d{1,3}[.)])[ \t]|(?m)^-{3,}"


_PRE = re.compile(r"(?is)<pre\b[^>]*>(.*?)</pre>")
_CODE = re.compile(r"(?is)<code\b[^>]*>(.*?)</code>")
_SECTION = re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}|\\(?:chapter|paragraph|title)\*?\{([^{}]*)\}")
_ENVIRONMENT = re.compile(r"\\begin\{\w+\*?\}(?:\[[^\]]*\])?|\\end\{\w+\*?\}")
_LATEX_ITEM = re.compile(r"\\item\b[ \t]*(?:\[[^\]]*\])?")


def is_formula(content: str) -> bool:
    """What stands between dollar signs is a formula, not text between two prices."""
    if re.match(r"\d[\d.,]*(?:\s|$)", content):
        return "\\" in content and content.count("$") == 0 and len(content) < 40 and not re.match(r"\d[\d.,]*\s+[a-z]{2,}", content)
    return bool(re.search(r"[\\^_{}=<>+]", content)) or bool(re.fullmatch(r"[A-Za-zΑ-ω]{1,2}'?|[A-Za-z]\([A-Za-z, ]+\)", content))


def _tags(text: str):
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name in _NAMES or ":" in name and name.split(":")[0] in ("jats", "mml", "m", "xhtml", "oasis", "ce", "sb"):
            yield m, name


def _formulas(text: str):
    """Matches of the formulas between dollars; a dollar that closes none may open the next."""
    at = 0
    while m := _MATH.search(text, at):
        if m[1] or is_formula(m[2]):
            yield m
            at = m.end()
        else:
            at = m.end() - 1


def _unclosed(tags: list) -> set[int]:
    """Starts of the opening tags of dropped elements that are never closed, so that the text behind them stays.

    Elements that cannot hold their own kind end at the next of their kind, too.
    """
    out, closes, opens = set(), set(), set()
    for m, _ in reversed(tags):
        name = m[2].lower()
        if name.split(":")[-1] not in _DROPPED or m[4]:
            continue
        if m[1]:
            closes.add(name)
            opens.discard(name)
        else:
            if name not in closes or name in opens and name in _FLAT:
                out.add(m.start())
            opens.add(name)
    return out


class Node:
    """A block: kind and its children or its text."""

    __slots__ = ("kind", "children", "text", "parent", "points", "linked", "mark")

    def __init__(self, kind: str, parent: "Node | None", text: str = "", mark: str = "") -> None:
        self.kind, self.parent, self.text, self.mark = kind, parent, text, mark
        self.children: list[Node] = []
        self.points, self.linked = 0.0, 0
        if parent is not None:
            parent.children.append(self)

    def size(self) -> int:
        return len(self.text) + sum(c.size() for c in self.children)

    def links(self) -> int:
        return self.linked + sum(c.links() for c in self.children)


_STRUCTURE = {"heading", "item", "code", "formula", "row"}
_GUARD = "\ue000{}\ue001"
_GUARDED = re.compile("\ue000(\\d+)\ue001")
_LINK_ON, _LINK_OFF = "\ue002", "\ue003"
#: Marks of items and headings of LaTeX and underlined headings in the lines.
_ITEM_MARK, _HEADING_MARK = "\ue004", "\ue005"


class _Parser:
    """The tree of a text and the notations (`kinds`) of which it holds at least one piece."""

    def __init__(self, text: str) -> None:
        self.kept: list[tuple[str, str]] = []
        self.kinds: set[str] = set()
        self.root = Node("container", None)
        self.parse(re.sub("[\ue000-\ue005]", "", text))

    def keep(self, kind: str, content: str, notation: str) -> str:
        self.kept.append((kind, content))
        self.kinds.add(notation)
        mark = _GUARD.format(len(self.kept) - 1)
        return f"\n{mark}\n" if kind in ("code", "formula") else mark

    def replace(self, notation: str, pattern: re.Pattern, by, text: str) -> str:
        text, n = pattern.subn(by, text)
        if n:
            self.kinds.add(notation)
        return text

    def unescape(self, text: str) -> str:
        if "&" not in text:
            return text
        if any(m[0][1] == "#" or m[0][1:] in html5 for m in _ENTITY.finditer(text)):
            self.kinds.add("html")
        return html.unescape(text)

    def parse(self, text: str) -> None:
        if "`" in text:
            text = _FENCE.sub(lambda m: self.keep("code", m[2], "markdown"), text)
            if "```" in text:
                self.kinds.add("markdown")
        if "\\" in text:
            text = _LATEX_CODE.sub(lambda m: self.keep("code", m[2], "latex"), text)
        if "<" in text:
            text = _PRE.sub(lambda m: self.keep("code", html.unescape(_TAG.sub("", m[1])), "html"), text)
        if "\\" in text:
            text = _DISPLAY.sub(lambda m: self.keep("formula", (m[1] or m[2] or m[5]).strip(), "latex"), text)
        if "$" in text:
            parts, at = [], 0
            for m in _formulas(text):
                parts += [text[at : m.start()], self.keep("formula", m[1].strip(), "latex") if m[1] else self.keep("math", re.sub(r"\s*\n\s*", " ", m[2]), "latex")]
                at = m.end()
            text = "".join([*parts, text[at:]])
        if "<" in text:
            text = _CODE.sub(lambda m: self.keep("ticks", html.unescape(_TAG.sub("", m[1])), "html"), text)
        if "`" in text:
            text = _TICKS.sub(lambda m: self.keep("ticks", m[1], "markdown"), text)
        if "<" in text or "]]>" in text:
            text = self.replace("html", _COMMENT, " ", text)
        at, here, skip = 0, self.root, None
        buffer: list[str] = []

        def flush() -> None:
            nonlocal buffer
            joined, buffer = "".join(buffer), []
            if joined.strip():
                self.lines(joined, here)

        tags = list(_tags(text)) if "<" in text else []
        if tags:
            self.kinds.add("html")
        unclosed = _unclosed(tags)
        for m, name in tags:
            part, at = text[at : m.start()], m.end()
            if skip:
                if m[1] and name == skip:
                    skip = None
                continue
            buffer.append(self.unescape(part))
            name = name.split(":")[-1]
            if name in _DROPPED and not m[4]:
                if not m[1] and m.start() not in unclosed:
                    skip = m[2].lower()
                continue
            if name == "br":
                buffer.append("\n")
            elif name == "a":
                buffer.append(_LINK_OFF if m[1] else _LINK_ON)
            elif name in _BLOCKS or name in ("title", "list-item"):
                flush()
                if name in _VOID or m[4]:
                    continue
                kind = "heading" if re.fullmatch(r"h[1-6]|title|summary|caption", name) else "item" if name in ("li", "list-item", "dt", "dd") else "row" if name == "tr" else "container"
                if not m[1]:
                    if kind == "item":
                        while here.kind == "item" and here.parent and here.mark == name:
                            here = here.parent
                    here = Node(kind, here, mark=name)
                else:
                    back = here
                    while back.parent is not None and back.mark != name:
                        back = back.parent
                    if back.parent is not None:
                        here = back.parent
        if not skip:
            buffer.append(self.unescape(text[at:]))
        flush()

    def lines(self, text: str, parent: Node) -> None:
        """The blocks of the line-based notations."""
        if "\\" in text:
            text = self.replace("latex", _SECTION, lambda m: f"\n{_HEADING_MARK}{m[1] or m[2]}\n", text)
            text = self.replace("latex", _ENVIRONMENT, "\n", text)
            text = self.replace("latex", _LATEX_ITEM, f"\n{_ITEM_MARK}", text)
        if "\n" in text:
            text = self.replace("markdown", _SETEXT, lambda m: f"{_HEADING_MARK}{m[1]}", text)
        if "]:" in text:
            text = self.replace("markdown", _MD_REF, "", text)
        block: list[str] = []
        rows = numbers = 0

        def close() -> None:
            if block:
                self.add("paragraph", "\n".join(block), parent)
                block.clear()

        for line in text.split("\n"):
            bare = line.strip()
            if not bare:
                close()
                continue
            guarded = _GUARDED.fullmatch(bare)
            if guarded and self.kept[int(guarded[1])][0] in ("code", "formula"):
                close()
                kind, content = self.kept[int(guarded[1])]
                Node(kind, parent, content.strip("\n"))
                continue
            heading, wiki = _HEADING.match(line), _WIKI_HEADING.match(line)
            if bare[0] in (_HEADING_MARK, _ITEM_MARK):
                close()
                self.add("heading" if bare[0] == _HEADING_MARK else "item", bare[1:], parent)
            elif heading or wiki:
                close()
                self.kinds.add("markdown" if heading else "wiki")
                self.add("heading", (heading or wiki)[2], parent)
            elif (rule := _RULE.match(line)) or _WIKI_TABLE.match(line):
                close()
                self.kinds.add("markdown" if rule else "wiki")
            elif _ROW.match(line):
                close()
                rows += 1
                self.add("row", " | ".join(c.strip() for c in bare.strip("|").split("|")), parent)
            elif (item := _ITEM.match(line)) or _NUMBERED.match(line):
                close()
                numbers += not item
                if item:
                    self.kinds.add("markdown")
                self.add("item", _NUMBERED.sub("", _ITEM.sub("", line)), parent)
            else:
                if _QUOTE.match(line):
                    self.kinds.add("markdown")
                block.append(_QUOTE.sub("", line).strip())
        close()
        if rows > 1 or numbers > 1:
            self.kinds.add("markdown")

    def add(self, kind: str, text: str, parent: Node) -> None:
        text = self.inline(text)
        linked = sum(len(x) for x in re.findall(f"{_LINK_ON}([^{_LINK_OFF}]*)", text))
        text = re.sub(r"\s+", " ", re.sub(f"[{_LINK_ON}{_LINK_OFF}]", "", text)).strip()
        if not text:
            return
        if parent.kind in ("heading", "item", "row") and kind == "paragraph":
            parent.text = f"{parent.text} {text}".strip()
            parent.linked += linked
        else:
            Node(kind, parent, text).linked = linked

    def inline(self, text: str) -> str:
        link = lambda s: f"{_LINK_ON}{s}{_LINK_OFF}"
        if "{{" in text:
            text = self.replace("wiki", _TEMPLATE, "", text)
        if "[" in text:
            text = self.replace("wiki", _WIKI_LINK, lambda m: "" if re.match(r"(?i)\s*(category|file|image)\s*:", m[1]) else link(m[2] or m[1]), text)
            text = self.replace("wiki", _WIKI_URL, lambda m: link(m[1] or ""), text)
            text = self.replace("markdown", _MD_LINK, lambda m: link(m[1]), text)
        if "''" in text:
            text = self.replace("latex", _QUOTES, lambda m: f'"{m[1]}"', text)
            text = self.replace("wiki", _WIKI_QUOTES, lambda m: m[1], text)
        if "*" in text or "_" in text:
            text = self.replace("markdown", _BOLD, lambda m: m[1] or m[2], text)
            text = self.replace("markdown", _ITALIC, lambda m: m[1] or m[2], text)
        if "~~" in text:
            text = self.replace("markdown", _STRIKE, lambda m: m[1], text)
        if "\\" in text:
            if _COMMAND.search(text):
                self.kinds.add("latex")
            text = _latex_inline(text)
        return _GUARDED.sub(lambda m: self.guarded(int(m[1])), text)

    def guarded(self, i: int) -> str:
        kind, content = self.kept[i]
        return f"`{content}`" if kind in ("ticks", "code") else f"${content}$"


#: LaTeX accents and the combining marks they put on a letter; special letters (fixed values).
_ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
_LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ"}


def _latex_inline(text: str) -> str:
    accent = lambda m: unicodedata.normalize("NFC", m[2].replace("ı", "i") + _ACCENTS[m[1]])
    text = re.sub(r"\\(label|ref|eqref|cite[a-z]*|footnotemark|vspace|hspace|pageref|bibliography\w*)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
    text = re.sub(r"\{?\\([\"'`^~=.])\s*\{?\\?([A-Za-z])\}?\}?", accent, text)
    text = re.sub(r"\{?\\([uvHckrdb])(?:\{\\?([A-Za-z])\}|\s+([A-Za-z])\b)\}?", lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + _ACCENTS[m[1]]), text)
    text = re.sub(r"\{\\(" + "|".join(_LETTERS) + r")\}|\\(" + "|".join(_LETTERS) + r")(?![A-Za-z])\s?", lambda m: _LETTERS[m[1] or m[2]], text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    for _ in range(4):
        text, n = re.subn(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])*\{([^{}]*)\}", r"\1", text)
        if not n:
            break
    text = re.sub(r"\{\\[A-Za-z]+\s+([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([%&_#$])", r"\1", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?|\\[,;!]|\\[ ]", " ", text)
    text = re.sub(r"\\[A-Za-z]+\*?\s?", "", text)
    return re.sub(r"~(?=\S)", " ", text)


def _score(node: Node) -> None:
    for child in node.children:
        _score(child)
    if node.kind in ("paragraph", "item") and len(node.text) >= 25:
        worth = 1 + node.text.count(",") + min(len(node.text) / 100, 3)
        up, share = node.parent, worth
        while up is not None and share >= worth / 2:
            up.points += share
            up, share = up.parent, share / 2


def _best(root: Node) -> Node:
    best, most, stack = root, -1.0, [root]
    while stack:
        node = stack.pop()
        if node.kind == "container":
            value = node.points * (1 - node.links() / max(1, node.size()))
            if value > most:
                best, most = node, value
        stack += reversed(node.children)
    return best


def _holds_blocks(node: Node) -> bool:
    return node.kind in ("heading", "code", "row") or any(_holds_blocks(c) for c in node.children)


def _flat(node: Node) -> str:
    """The text of a table cell and of all that it holds, in one line."""
    text = f"$${node.text}$$" if node.kind == "formula" else node.text
    return " ".join(x for x in (text, *(_flat(c) for c in node.children)) if x)


def _write(node: Node, out: list[str]) -> None:
    if node.kind == "heading" and node.text:
        out.append(f"# {node.text}")
    elif node.kind == "item" and node.text:
        out.append(f"- {node.text}")
    elif node.kind == "row" and (node.text or node.children):
        if not any(_holds_blocks(c) for c in node.children):
            out.append(" | ".join(x for x in [node.text, *(_flat(c) for c in node.children)] if x))
            return
        if node.text:  # a table for layout
            out.append(node.text)
    elif node.kind == "code":
        out.append(f"```\n{node.text}\n```")
    elif node.kind == "formula":
        out.append(f"$${node.text}$$")
    elif node.kind == "paragraph":
        out.append(node.text)
    for child in node.children:
        _write(child, out)


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """(the text without markup, its structure kept; the notations found, sorted). Null stays null, text without markup stays as it is."""
    if not text:
        return text, []
    parsed = _Parser(text)
    if not parsed.kinds:
        return text, []
    root = parsed.root
    _score(root)
    best = _best(root)
    # from the best container upwards, siblings with points, prose or structure stay
    while best.parent is not None:
        parent, limit = best.parent, max(1.0, 0.2 * best.points)
        parent.children = [
            c for c in parent.children
            if c is best or c.points >= limit or c.kind in _STRUCTURE or c.size() and c.links() <= 0.33 * c.size()
        ]
        best = parent
    out: list[str] = []
    _write(best, out)
    return "\n".join(out), sorted(parsed.kinds)


def clean_text(text: str | None) -> str | None:
    return clean(text)[0]


def markup_kinds(text: str | None) -> list[str]:
    return clean(text)[1]


@F.pandas_udf(StructType([StructField("clean", StringType()), StructField("kinds", ArrayType(StringType()))]))
def _clean(values: pd.Series) -> pd.DataFrame:
    read = [clean(v) for v in values]
    return pd.DataFrame({"clean": [c for c, _ in read], "kinds": [k for _, k in read]})


def clean_values(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys + (clean, kinds): texts without markup and the notations found in them.

    kinds is empty for text without markup, which keeps its form; null and empty
    texts stay as they are. The table is read once, and texts that hold no character
    of any markup never leave the JVM. Repeated keys and extra columns do no harm.
    """
    maybe = F.coalesce(F.col("_value").rlike(MAYBE), F.lit(False))
    src = spread(df.select(*keys, F.col(value).alias("_value")), *keys)
    read = src.withColumn("_maybe", maybe).withColumn("_read", _clean(F.when(F.col("_maybe"), F.col("_value"))))
    return read.select(
        *keys, F.when(F.col("_maybe"), F.col("_read.clean")).otherwise(F.col("_value")).alias("clean"),
        F.when(F.col("_maybe"), F.col("_read.kinds")).otherwise(F.array().cast("array<string>")).alias("kinds"),
    )


def paper_fields(papers: DataFrame) -> DataFrame:
    """(vec_id, field_name, value): titles and abstracts."""
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("title", "abstract")]))
    return papers.select("vec_id", pair.alias("p")).select("vec_id", "p.field_name", "p.value")
