"""A Markdown block and inline parser for whole documents: the one part of the engine that needs a program.

Blocks: ATX and underlined headings, paragraphs, bullet and numbered lists with nesting, fenced and indented code,
quotes, thematic breaks, HTML blocks, pipe tables and link definitions. Inlines: code spans, emphasis, links, images,
references, autolinks, bare addresses, entities, raw HTML, escapes and line breaks.

Places are code points from 0; a block's end is its last character's place. Each document is parsed by itself, in a
time linear in its size but for emphasis and brackets within a paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = "struct<url:string,text:string,title:string>"
BLOCK = f"struct<kind:string,level:int,content:string,start:bigint,stop:bigint,line:bigint,top:boolean,has_children:boolean,links:array<{LINK}>,original:string>"

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
_ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_HTML = re.compile(r"<(?:!--|\?|![A-Z]|/?[A-Za-z][A-Za-z0-9-]*(?=[\s/>]|$))")
_TABLE_RULE = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"\[([^\[\]]+)\]:[ \t]*<?(\S+?)>?(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ \t]*$")
_NOTE = re.compile(r"\[\^([^\[\]\s]+)\]:[ \t]*")
_MATH = re.compile(r"(\${2,})[ \t]*$")
_MEANING = re.compile(r":(?=[ \t]{3,}\S|\t\S)")
_ATTRIBUTES = re.compile(r"\{[ \t]*(?:(?:[#.][A-Za-z_][\w:.-]*|[A-Za-z_:][\w:.-]*=(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s{}\"']+))[ \t]*)+\}")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[^\s<>@]+@[^\s<>@]+>")
_RAW_HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>", re.S)
_BARE = re.compile(r"(?:https?://|ftp://|mailto:|www\.)[^\s<>]*[^\s<>.,;:!?\"'()\[\]*_~]")
_ESCAPABLE = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Block:
    kind: str  # heading, paragraph, list, item, code, quote, table, meaning, note, other
    start: int
    stop: int
    line: int
    level: int = 0
    text: str = ""
    children: list[Block] = field(default_factory=list)


Line = tuple[int, str, int]  # place, text without its break, number


def split_lines(text: str) -> list[Line]:
    out, at = [], 0
    for n, raw in enumerate(text.split("\n")):
        out.append((at, raw[:-1] if raw.endswith("\r") else raw, n))
        at += len(raw) + 1
    return out


def _indent(s: str) -> int:
    return len(s.expandtabs(4)) - len(s.expandtabs(4).lstrip(" "))


def _cut(line: Line, columns: int) -> Line:
    """The line without so many leading columns of white space."""
    at, s, n = line
    k = width = 0
    while k < len(s) and width < columns and s[k] in " \t":
        width += 1 if s[k] == " " else 4 - width % 4
        k += 1
    return at + k, s[k:], n


def _opens(s: str) -> bool:
    """Whether a line without its indent ends a paragraph before it."""
    item = _ITEM.match(s)
    starts_item = bool(item and s[item.end() :].strip() and (item[1] in "-+*" or item[1][:-1] == "1"))
    return bool(_ATX.match(s) or _FENCE.match(s) or _RULE.match(s) or s.startswith(">") or starts_item or _HTML.match(s))


def parse_blocks(lines: list[Line], definitions: dict[str, tuple[str, str | None]]) -> list[Block]:
    out: list[Block] = []
    i = 0
    while i < len(lines):
        at, s, n = lines[i]
        if not s.strip():
            i += 1
            continue
        deep = _indent(s) >= 4
        place, bare, _ = _cut(lines[i], 3 if not deep else 0)
        if not deep:
            while bare[:1] == " ":
                place, bare = place + 1, bare[1:]
        if deep:
            i = _indented_code(lines, i, out)
        elif m := _ATX.match(bare):
            title = (m[2] or "").strip()
            out.append(Block("heading", place, place + len(bare.rstrip()) - 1, n, len(m[1]), title if title.strip("#") else ""))
            i += 1
        elif m := _FENCE.match(bare):
            i = _fenced_code(lines, i, place, m[1], out)
        elif _RULE.match(bare):
            out.append(Block("other", place, place + len(bare.rstrip()) - 1, n))
            i += 1
        elif bare.startswith(">"):
            i = _quote(lines, i, place, definitions, out)
        elif _ITEM.match(bare):
            i = _list(lines, i, place, definitions, out)
        elif _HTML.match(bare):
            first = i
            while i < len(lines) and lines[i][1].strip():
                i += 1
            out.append(Block("other", place, lines[i - 1][0] + len(lines[i - 1][1]) - 1, lines[first][2]))
        elif m := _MATH.match(bare):
            i = _fenced_code(lines, i, place, m[1], out)
        elif m := _NOTE.match(bare):
            i = _inside(lines, i, place + m.end(), bare[m.end() :], "note", m[1], definitions, out)
        elif out and out[-1].kind in ("paragraph", "meaning") and (m := _MEANING.match(bare)):
            if out[-1].kind == "paragraph":  # the terms, which are no paragraph
                out.pop()
            body = bare[1:].lstrip(" \t")
            i = _inside(lines, i, place + len(bare) - len(body), body, "meaning", "", definitions, out)
        elif (m := _DEFINITION.match(bare)) and not bare.startswith("[^"):
            definitions.setdefault(m[1].lower(), (m[2], m[3] or m[4] or m[5]))
            i += 1
        elif "|" in bare and i + 1 < len(lines) and "-" in lines[i + 1][1] and "|" in lines[i + 1][1] and _TABLE_RULE.match(lines[i + 1][1].strip()):
            i = _table(lines, i, place, out)
        else:
            i = _paragraph(lines, i, place, out)
    return out


def _inside(lines: list[Line], i: int, at: int, body: str, kind: str, name: str, definitions: dict, out: list[Block]) -> int:
    """A block behind a mark: the rest of its line, lines that go on with its paragraph, and indented ones."""
    first, inner = i, [(at, body, lines[i][2])]
    i += 1
    while i < len(lines):
        s = lines[i][1]
        if not s.strip():
            if i + 1 < len(lines) and lines[i + 1][1].strip() and _indent(lines[i + 1][1]) >= 4:
                inner.append((lines[i][0], "", lines[i][2]))
            else:
                break
        elif _indent(s) >= 4:
            inner.append(_cut(lines[i], 4))
        elif inner[-1][1].strip() and not _opens(s.lstrip(" ")) and not _NOTE.match(s.lstrip(" ")) and not _MEANING.match(s.lstrip(" ")):
            inner.append(lines[i])
        else:
            break
        i += 1
    last = lines[i - 1]
    out.append(Block(kind, lines[first][0], last[0] + len(last[1]) - 1, lines[first][2], text=name, children=parse_blocks(inner, definitions)))
    return i


def _paragraph(lines: list[Line], i: int, place: int, out: list[Block]) -> int:
    first, taken = i, []
    while i < len(lines):
        s = lines[i][1]
        bare = s.strip(" \t")
        if not bare:
            break
        if i > first and _indent(s) < 4:
            if m := _UNDERLINE.match(bare):
                stop = lines[i][0] + len(s.rstrip()) - 1
                out.append(Block("heading", place, stop, lines[first][2], 1 if m[1][0] == "=" else 2, "\n".join(taken)))
                return i + 1
            if _opens(bare) or _MATH.match(bare) or _NOTE.match(bare) or _MEANING.match(bare):
                break
        taken.append(s.lstrip(" \t"))
        i += 1
    last = lines[i - 1]
    out.append(Block("paragraph", place, last[0] + len(last[1].rstrip(" \t")) - 1, lines[first][2], text="\n".join(taken).rstrip(" \t")))
    return i


def _indented_code(lines: list[Line], i: int, out: list[Block]) -> int:
    first, taken, kept = i, [], 0
    while i < len(lines) and (not lines[i][1].strip() or _indent(lines[i][1]) >= 4):
        taken.append(_cut(lines[i], 4)[1])
        if lines[i][1].strip():
            kept = len(taken)
        i += 1
    last = lines[first + kept - 1]
    out.append(Block("code", _cut(lines[first], 4)[0], last[0] + len(last[1]) - 1, lines[first][2], text="\n".join(taken[:kept])))
    return first + kept


def _fenced_code(lines: list[Line], i: int, place: int, mark: str, out: list[Block]) -> int:
    first, indent, taken = i, _indent(lines[i][1]), []
    closing = re.compile(r" {0,3}" + re.escape(mark[0]) + "{%d,}[ \t]*$" % len(mark))
    i += 1
    stop = lines[first][0] + len(lines[first][1]) - 1
    while i < len(lines):
        stop = lines[i][0] + len(lines[i][1]) - 1
        if closing.match(lines[i][1]):
            i += 1
            break
        taken.append(_cut(lines[i], indent)[1])
        i += 1
    out.append(Block("code", place, stop, lines[first][2], text="\n".join(taken)))
    return i


def _quote(lines: list[Line], i: int, place: int, definitions: dict, out: list[Block]) -> int:
    first, inner = i, []
    while i < len(lines):
        at, s, n = lines[i]
        bare = s.lstrip(" ")
        if bare.startswith(">") and len(s) - len(bare) < 4:
            k = len(s) - len(bare) + 1
            k += s[k : k + 1] == " "
            inner.append((at + k, s[k:], n))
        elif s.strip() and inner and inner[-1][1].strip() and not _opens(bare):
            inner.append(lines[i])  # a paragraph goes on without the mark
        else:
            break
        i += 1
    out.append(Block("quote", place, lines[i - 1][0] + len(lines[i - 1][1]) - 1, lines[first][2], children=parse_blocks(inner, definitions)))
    return i


def _list(lines: list[Line], i: int, place: int, definitions: dict, out: list[Block]) -> int:
    family = lambda mark: mark if mark in "-+*" else mark[-1]
    first, kind, items = i, "", []
    while i < len(lines):
        s = lines[i][1]
        lead = len(s) - len(s.lstrip(" "))
        m = _ITEM.match(s, lead) if lead < 4 and not _RULE.match(s.strip()) else None
        if not m or (kind and family(m[1]) != kind):
            break
        kind = family(m[1])
        rest = s[m.end() :]
        gap = len(rest) - len(rest.lstrip(" \t"))
        width = m.end() + (gap if 1 <= gap <= 4 and rest.strip() else 1)
        start, n = lines[i][0] + lead, lines[i][2]
        inner = [(lines[i][0] + min(width, len(s)), s[width:], n)]
        i += 1
        while i < len(lines):
            t = lines[i][1]
            if not t.strip():
                if i + 1 < len(lines) and lines[i + 1][1].strip() and _indent(lines[i + 1][1]) >= width:
                    inner.append((lines[i][0], "", lines[i][2]))
                    i += 1
                    continue
                break
            if _indent(t) >= width:
                inner.append(_cut(lines[i], width))
            elif inner[-1][1].strip() and not _ITEM.match(t.lstrip(" ")) and not _opens(t.lstrip(" ")):
                inner.append(_cut(lines[i], _indent(t)))
            else:
                break
            i += 1
        stop = inner[-1][0] + max(len(inner[-1][1]), 1) - 1
        items.append(Block("item", start, stop, n, children=parse_blocks(inner, definitions)))
        blank = i
        while blank < len(lines) and not lines[blank][1].strip():
            blank += 1
        if blank < len(lines) and blank > i:  # items may stand apart
            t = lines[blank][1]
            m = _ITEM.match(t.lstrip(" ")) if len(t) - len(t.lstrip(" ")) < 4 else None
            if m and family(m[1]) == kind and not _RULE.match(t.strip()):
                i = blank
    out.append(Block("list", place, items[-1].stop, lines[first][2], children=items))
    return i


def _table(lines: list[Line], i: int, place: int, out: list[Block]) -> int:
    first, cells = i, []
    while i < len(lines) and lines[i][1].strip() and "|" in lines[i][1]:
        if i != first + 1:
            for m in re.finditer(r"(?:\\.|[^|\\])+", lines[i][1]):
                if word := m[0].strip():
                    at = lines[i][0] + m.start() + len(m[0]) - len(m[0].lstrip())
                    cells.append(Block("paragraph", at, at + len(word) - 1, lines[i][2], text=word))
        i += 1
    out.append(Block("table", place, lines[i - 1][0] + len(lines[i - 1][1]) - 1, lines[first][2], children=cells))
    return i


# Inlines


#: Where a text may hold more than plain characters; all before the next such place is taken as it stands.
_NOT_PLAIN = re.compile(r"[\\\n`&<${\[*_~^]|!(?=\[)|\+\+|==|https?://|ftp://|mailto:|www\.")
#: Marks of an emphasis that are one character; inserted and marked text have two.
_LONGEST = {"^": 1}


def _formula(s: str, i: int) -> int:
    """The end of an inline formula that opens at ``i``, 0 if none does: its marks stand at words' edges and touch it."""
    run = 2 if s.startswith("$$", i) else 1
    mark = lambda x: not x or x.isspace() or not (x.isalnum() or x == "$")
    if not mark(s[i - 1 : i]) or not s[i + run : i + run + 1].strip():
        return 0
    at = s.find("$" * run, i + run)
    while at >= 0:
        if not s[at - 1].isspace() and s[at - 1] != "\\" and mark(s[at + run : at + run + 1]) and at > i + run:
            return at + run
        at = s.find("$" * run, at + 1)
    return 0


class Inline:
    """Text as a reader sees it, and the links in it; what is inside a link is no link of its own."""

    def __init__(self, definitions: dict[str, tuple[str, str | None]], notes: frozenset[str] = frozenset()):
        self.definitions = definitions
        self.notes = notes
        self.cited: dict[str, None] = {}

    def parse(self, s: str) -> tuple[str, list[dict]]:
        out: list[str] = []
        links: list[dict] = []
        delimiters: list[list] = []  # place in out, mark, length, may open, may close
        i = 0
        while i < len(s):
            special = _NOT_PLAIN.search(s, i)
            upto = special.start() if special else len(s)
            if upto > i:
                bare = s[i:upto].rstrip(" ")
                if bare:
                    out.append(bare)
                out.extend(" " * (upto - i - len(bare)))  # one by one, as a line break or attributes take them back
                i = upto
                continue
            c = s[i]
            if c == "\\" and i + 1 < len(s):
                if s[i + 1] in _ESCAPABLE:
                    out.append(s[i + 1])
                    i += 2
                    continue
                if s[i + 1] == "\n":
                    out.append(" ")
                    i += 2
                    continue
            elif c == "\n":
                while out and out[-1] == " ":
                    out.pop()
                out.append(" ")
                i += 1
                continue
            elif c == "`":
                run = re.match("`+", s[i:])[0]
                close = re.compile(r"(?<!`)" + run + r"(?!`)").search(s, i + len(run))
                if close:
                    body = s[i + len(run) : close.start()].replace("\n", " ")
                    out.append(body[1:-1] if body.startswith(" ") and body.endswith(" ") and body.strip() else body)
                    i = close.end()
                else:
                    out.append(run)
                    i += len(run)
                continue
            elif c == "&" and (m := _ENTITY.match(s, i)):
                i = m.end()
                continue
            elif c == "<" and (m := _AUTOLINK.match(s, i) or _RAW_HTML.match(s, i)):
                i = m.end()
                continue
            elif c == "$" and (end := _formula(s, i)):
                i = end
                continue
            elif c == "{" and (m := _ATTRIBUTES.match(s, i)):
                i = m.end()
                if i == len(s):
                    while out and out[-1] == " ":
                        out.pop()
                continue
            elif s.startswith("[^", i) and (m := re.compile(r"\[\^([^\[\]\s]+)\]").match(s, i)) and m[1].lower() in self.notes:
                self.cited[m[1].lower()] = None
                i = m.end()
                continue
            elif c == "[" or (c == "!" and s[i + 1 : i + 2] == "["):
                if found := self._link(s, i + (c == "!")):
                    text, url, title, i = found
                    out.append(text)
                    links.append({"url": url, "text": text, "title": title})
                    continue
            elif c in "hfmw" and (i == 0 or not (s[i - 1].isalnum() or s[i - 1] == "/")) and (m := _BARE.match(s, i)):
                links.append({"url": ("http://" if m[0].startswith("www.") else "") + m[0], "text": m[0], "title": None})
                out.append(m[0])
                i = m.end()
                continue
            elif c in "*_~^" or s[i : i + 2] in ("++", "=="):
                run = re.match(re.escape(c) + "+", s[i:])[0]
                before, after = s[i - 1 : i] or " ", s[i + len(run) : i + len(run) + 1] or " "
                mark = lambda x: not x.isalnum() and not x.isspace()
                left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
                right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
                opens, closes = (left and (not right or mark(before)), right and (not left or mark(after))) if c == "_" else (left, right)
                delimiters.append([len(out), c, len(run), opens, closes])
                out.append(run)
                i += len(run)
                continue
            out.append(c)
            i += 1
        self._emphasis(out, delimiters)
        return "".join(out), links

    @staticmethod
    def _emphasis(out: list[str], delimiters: list[list]) -> None:
        """Takes the marks of pairs out of ``out``."""
        stack: list[list] = []
        for d in delimiters:
            if d[4]:
                while d[2] and (k := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == d[1]), None)) is not None:
                    o = stack[k]
                    del stack[k + 1 :]
                    use = min(_LONGEST.get(d[1], 2), o[2], d[2]) if d[1] not in "+=" else 2
                    if min(o[2], d[2]) < use:
                        break
                    o[2], d[2] = o[2] - use, d[2] - use
                    out[o[0]], out[d[0]] = o[1] * o[2], d[1] * d[2]
                    if not o[2]:
                        stack.pop()
            if d[3] and d[2]:
                stack.append(d)

    def _link(self, s: str, at: int) -> tuple[str, str, str | None, int] | None:
        depth, i = 0, at
        while i < len(s):
            if s[i] == "\\":
                i += 1
            elif s[i] == "[":
                depth += 1
            elif s[i] == "]":
                depth -= 1
                if not depth:
                    break
            i += 1
        else:
            return None
        label = s[at + 1 : i]
        target = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(([^()]*)\)))?\s*\)").match(s, i + 1)
        if target:
            url = target[1] if target[1] is not None else target[2]
            return self.parse(label)[0], url, next((t for t in target.groups()[2:] if t is not None), None), target.end()
        name = re.compile(r"\[([^\[\]]*)\]").match(s, i + 1)
        known = self.definitions.get(((name[1] if name else "") or label).lower())
        if known:
            return self.parse(label)[0], known[0], known[1], name.end() if name else i + 1
        return None


def document_blocks(text: str) -> list[dict]:
    """Blocks of the four kinds that chunks and elements are made of, in document order; ``top`` for those that stand in
    no other block."""
    definitions: dict[str, tuple[str, str | None]] = {}
    parsed = parse_blocks(split_lines(text), definitions)
    notes: dict[str, Block] = {}

    def gather(blocks: list[Block]) -> None:
        for b in blocks:
            if b.kind == "note":
                notes.setdefault(b.text.lower(), b)
            gather(b.children)

    gather(parsed)
    inline = Inline(definitions, frozenset(notes))
    rows: list[dict] = []

    def row(b: Block, top: bool) -> None:
        links: list[dict] = []
        content = b.text
        if b.kind == "list":
            shown = []
            for item in b.children:
                for p in item.children:
                    if p.kind == "paragraph":
                        said, found = inline.parse(p.text)
                        shown.append("• " + said)
                        links += found
            content = "\n".join(shown)
        elif b.kind != "code":
            content, links = inline.parse(b.text)
        kind = "code_block" if b.kind == "code" else b.kind
        rows.append({
            "kind": kind, "level": b.level, "content": content, "start": b.start, "stop": b.stop, "line": b.line, "top": top, "has_children": b.kind == "list" and bool(b.children), "links": links,
        })

    def walk(blocks: list[Block], top: bool) -> None:
        for b in blocks:
            if b.kind in ("heading", "paragraph", "list", "code"):
                row(b, top)
            elif b.kind in ("quote", "table", "meaning"):
                walk(b.children, False)

    walk(parsed, True)
    told: set[str] = set()
    while left := [n for n in inline.cited if n not in told]:  # notes stand at the end, in the order in which they are cited
        told.add(left[0])
        walk(notes[left[0]].children, False)
    return rows


_LINK_TYPE = pa.struct([("url", pa.string()), ("text", pa.string()), ("title", pa.string())])
_BLOCK_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("line", pa.int64()), ("top", pa.bool_()),
    ("has_children", pa.bool_()), ("links", pa.list_(_LINK_TYPE)), ("original", pa.string()),
]))


def whole_lines(text: str, start: int, stop: int) -> str:
    """The lines from a start to the line's end at or behind ``stop``; empty for a block of one character."""
    if start < 0 or stop > len(text) or start >= stop:
        return ""
    end = text.find("\n", stop)
    return text[text.rfind("\n", 0, start) + 1 : end if end >= 0 else len(text)]


#: Texts parsed before their blocks are passed on.
_AT_ONCE = 500


def blocks(docs: DataFrame, id_col: str = "source_id", text_col: str = "text", parser: Callable[[str], list[dict]] = document_blocks) -> DataFrame:
    """(source_id, text, blocks): one row a document, blank texts with no blocks. ``parser`` may be any function that
    gives rows of the same fields; ``original``, the whole lines of a block, is set here."""
    rows = docs.select(F.col(id_col).cast("string").alias("source_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in (whole.slice(lo, _AT_ONCE) for whole in batches for lo in range(0, whole.num_rows, _AT_ONCE)):
            parsed = []
            for t in batch.column(1).to_pylist():
                found = parser(t) if t and t.strip() else []
                parsed.append([b | {"original": whole_lines(t, b["start"], b["stop"])} for b in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parsed, _BLOCK_TYPE)], ["source_id", "text", "blocks"])

    return rows.mapInArrow(run, f"source_id string, text string, blocks array<{BLOCK}>")
