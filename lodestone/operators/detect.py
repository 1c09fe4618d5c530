"""Elements of source files: imports, classes, functions, headings, tags, keys and the like, one row each.

A detector takes a file's text and returns Element rows; lines are 0-based, both inclusive. It runs per file inside Arrow batches, as
the structure of a file depends on all of it; files are independent, so there's no shuffle. `properties`, `css`, `headings` and `tags` also have
forms that stay in the JVM, further below, for large corpora where only those are wanted.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

MOST = 200
BRACKET = re.compile(r"[{}()\[\];]")


class Element(NamedTuple):
    line: int
    end_line: int
    name: str
    kind: str
    type: str


def short(s: str, most: int, keep: int | None = None) -> str:
    return s if len(s) <= most else s[: most - 3 if keep is None else keep] + "..."


def indent(s: str) -> int:
    return len(s) - len(s.lstrip())


def capped(found: list[Element], most: int = MOST) -> list[Element]:
    """In line order, the first `most`, and a marker for the rest."""
    found = sorted(found, key=lambda e: e.line)
    if len(found) <= most:
        return found
    at = found[most - 1].end_line
    return [*found[:most], Element(at, at, f"[... Truncated - {most}/{len(found)} elements shown ...]", "misc", "marker")]


# --- scripting: by indentation -------------------------------------------------------------------------------------------------


def indented_end(lines: list[str], at: int, stop: int) -> int:
    """Last line of the block that line `at` heads: before the next line that isn't blank and isn't indented further."""
    own = indent(lines[at])
    return next((i for i in range(at + 1, stop) if lines[i].strip() and indent(lines[i]) <= own), stop) - 1


def python(text: str) -> list[Element]:
    lines = text.splitlines()
    out, covered = [], []
    head = lambda s, word: re.split(r"[(:]", s.strip()[len(word) :], maxsplit=1)[0].strip()

    def variable(s: str) -> str | None:
        name = s.split("=")[0].strip()
        return name if "=" in s and name.isidentifier() else None

    i = 0
    while i < len(lines):
        s = lines[i]
        if s.startswith(("class ", "def ")):
            end = indented_end(lines, i, len(lines))
            covered.append((i, end))
            if s.startswith("def "):
                out.append(Element(i, end, s[4:].split("(")[0].strip(), "def", "function"))
            else:
                name = head(s, "class ")
                out.append(Element(i, end, name, "def", "class"))
                k = i + 1
                while k <= end:
                    bare, deep = lines[k].strip(), indent(lines[k])
                    if deep == 4 and bare.startswith("def "):
                        last = indented_end(lines, k, end + 1)
                        out.append(Element(k, last, f"{name}.{bare[4:].split('(')[0].strip()}", "def", "class_method"))
                        k = last
                    elif deep == 4 and not bare.startswith("#") and (v := variable(bare)):
                        out.append(Element(k, k, f"{name}.{v}", "def", "class_variable"))
                    k += 1
            i = end
        i += 1
    inside = set()
    for a, b in covered:
        inside.update(range(a, b + 1))
    joined = 0
    for i, s in enumerate(lines):
        bare = s.strip()
        if i in inside or i < joined or not bare or bare.startswith("#"):
            continue
        if bare.startswith(("import ", "from ")):
            end, whole = i, bare
            if "(" in bare and ")" not in bare:
                end = next((j for j in range(i + 1, len(lines)) if ")" in lines[j]), len(lines) - 1)
                whole = " ".join(x.strip() for x in lines[i : end + 1])
                joined = end + 1
            out.append(Element(i, end, whole, "def", "import"))
        elif indent(s) == 0 and not any(w in bare for w in ("if ", "elif ", "while ", "for ", "return ")) and (v := variable(bare)):
            out.append(Element(i, i, v, "def", "global_variable"))
    return sorted(out, key=lambda e: e.line)


# --- braces: a masked copy of the text gives depths ----------------------------------------------------------------------------

STRING_OR_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


class Braced:
    """Lines of a text, a copy with strings and comments blanked out, and where brackets close."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.masked = STRING_OR_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        self.starts = [0]
        for m in re.finditer("\n", self.masked):
            self.starts.append(m.end())
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", self.masked):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def body(self, at: int) -> tuple[int, int] | None:
        """(open, close) of the block that begins after `at`, before any semicolon outside brackets."""
        depth = 0
        for m in BRACKET.finditer(self.masked, at):
            c = m.group()
            if c == "{" and depth <= 0:
                return (m.start(), self.close.get(m.start(), len(self.masked) - 1))
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == ";" and depth <= 0:
                return None
        return None

    def end_line(self, at: int) -> int:
        b = self.body(at)
        return self.line(b[1] if b else at)


def used(names: list[str], body: str) -> str:
    """` (uses: ...)` of the imported names that the body has as whole words."""
    if not names:
        return ""
    found = sorted(set(re.findall(r"\b(" + "|".join(map(re.escape, names)) + r")\b", body)))
    return f" (uses: {', '.join(found)})" if found else ""


JAVA_TYPE = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(class|interface|enum)\s+(\w+)", re.M)
JAVA_METHOD = re.compile(r"^[ \t]*((?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|void)\s+)+|)(?:<[^>{;]*>\s*)?((?:[\w.]+(?:<[^;{()]*>)?(?:\[\])*\s+)?)(\w+)\s*\([^;{}]*\)[^;{}=]*\{", re.M)
JAVA_FIELD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*[\w.]+(?:<[^;=()]*>)?(?:\[\])*\s+(\w+)\s*(?:=[^;]*)?;", re.M)
NOT_METHODS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "else", "do", "super", "this"}


def java(text: str) -> list[Element]:
    b, out = Braced(text), []
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", b.masked, re.M)
    prefix = None
    if package:
        out.append(Element(b.line(package.start(1)), b.line(package.start(1)), package.group(1), "def", "package"))
        parts = package.group(1).split(".")
        prefix = ".".join(parts[: 2 if parts[0] in ("com", "org") else 1])
    names = []
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", b.masked, re.M):
        names.append(m.group(1).rsplit(".", 1)[-1])
        if prefix is None or m.group(1).startswith(prefix):
            out.append(Element(b.line(m.start(1)), b.line(m.start(1)), m.group(1), "def", "import"))
    names = [n for n in names if n != "*"]
    taken = -1
    for m in JAVA_TYPE.finditer(b.masked):
        span = b.body(m.end())
        if m.start() < taken or span is None:
            continue
        taken = span[1]
        kind, name = m.group(1), m.group(2)
        out.append(Element(b.line(m.start(1)), b.line(span[1]), name, "def", "interface" if kind == "interface" else "class"))
        if kind == "interface":
            continue
        at = span[0] + 1
        while at < span[1]:
            f, g = JAVA_FIELD.search(b.masked, at, span[1]), JAVA_METHOD.search(b.masked, at, span[1])
            if g and g.group(3) in NOT_METHODS:
                g = None
            if f and (g is None or f.start() < g.start()) and not f.group().split()[0] in ("return", "throw", "package", "import"):
                line = b.line(f.start(1))
                out.append(Element(line, line, f"{name}.{f.group(1)}{used(names, b.masked[f.start() : f.end()])}", "def", "field"))
                at = f.end()
            elif g:
                last = b.close.get(g.end() - 1, span[1])
                called = f"{g.group(3)}(constructor)" if g.group(3) == name else g.group(3)
                out.append(Element(b.line(g.start(3)), b.line(last), f"{name}.{called}{used(names, b.masked[g.start() : last])}", "def", "method"))
                at = last + 1
            else:
                break
    return sorted(out, key=lambda e: e.line)


def javascript(text: str) -> list[Element]:
    b, out = Braced(text), []
    top = lambda at: not b.lines[b.line(at)][:1].isspace()
    names: list[str] = []

    def add(m: re.Match, name: str, kind: str, body: bool = True, at: int | None = None) -> None:
        start = b.line(m.start() + len(m.group()) - len(m.group().lstrip()))
        span = b.body(m.end() if at is None else at) if body else None
        refs = used(names, b.masked[span[0] : span[1]]) if span else ""
        out.append(Element(start, b.line(span[1]) if span else b.line(m.end() - 1), name + refs, "def", kind))

    for m in re.finditer(r"^(?:const|let|var)\s+(\w+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", text, re.M):
        names += re.findall(r"\w+", m.group(1))
        out.append(Element(b.line(m.start()), b.line(m.end() - 1), f"{' '.join(m.group(1).split())} from '{m.group(2)}'", "def", "import"))
    for m in re.finditer(r"^import\s+(?:type\s+)?(?:([^'\"]+?)\s+from\s+)?['\"]([^'\"]+)['\"]", text, re.M):
        what = " ".join((m.group(1) or "").split())
        names += [x.split(" as ")[-1].strip() for x in re.split(r"[{},]", what.replace("* as ", "")) if x.strip()]
        out.append(Element(b.line(m.start()), b.line(m.end() - 1), f"{what} from '{m.group(2)}'" if what else m.group(2), "def", "import"))
    markup = lambda span: bool(span and re.search(r"return\s*\(?\s*<[A-Za-z>]|=>\s*\(?\s*<[A-Za-z>]|<[A-Z]\w*[\s/>]", text[span[0] : span[1] + 1]))
    kind_of = lambda name, span: "hook" if re.match(r"use[A-Z]", name) else "component" if name[:1].isupper() and markup(span) else "function"
    exported: dict[str, int] = {}
    for m in re.finditer(r"^(export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(", b.masked, re.M):
        add(m, m.group(2), kind_of(m.group(2), b.body(m.end() - 1)), at=m.end() - 1)
        exported |= {m.group(2): b.line(m.start())} if m.group(1) else {}
    for m in re.finditer(r"^(export\s+(?:default\s+)?)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=(?!=)\s*(?:async\s*)?(?=(\([^;\n]*?\)|\w+)\s*(?::[^={]+)?=>|function\b|(.))", b.masked, re.M):
        name = m.group(2)
        exported |= {name: b.line(m.start())} if m.group(1) else {}
        if "require(" in b.masked[m.start() : m.end() + 40].split("\n")[0]:
            continue
        rest = b.masked[m.end() : m.end() + 400]
        if re.match(r"(\([^;\n]*?\)|\w+)\s*(?::[^={]+)?=>|function\b", rest):
            arrow = m.end() + (rest.find("=>") + 2 if "=>" in rest else 0)
            span = b.body(arrow)
            add(m, name, kind_of(name, span or (m.end(), min(len(text) - 1, m.end() + 400))), at=arrow)
        else:
            add(m, name, "variable", body=rest.lstrip().startswith("{"), at=m.end())
    for m in re.finditer(r"^(export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?", b.masked, re.M):
        name, span = m.group(2), b.body(m.end())
        exported |= {name: b.line(m.start())} if m.group(1) else {}
        component = "Component" in (m.group(3) or "")
        add(m, name, "component" if component else "variable", at=m.end())
        out[-1] = out[-1]._replace(type="component" if component else "class")
        if span:
            at = span[0] + 1
            method = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*(?:\([^;{}]*\)[^;{}=]*\{|=\s*(?:async\s*)?\([^;{}]*\)\s*=>\s*\{)", re.M)
            while (g := method.search(b.masked, at, span[1])) is not None:
                last = b.close.get(g.end() - 1, span[1])
                if g.group(1) not in NOT_METHODS:
                    out.append(Element(b.line(g.start(1)), b.line(last), f"{name}.{g.group(1)}{used(names, b.masked[g.start() : last])}", "def", "method"))
                    at = last + 1
                else:
                    at = g.end()
    for m in re.finditer(r"\(\s*\{\s*$", b.masked, re.M):  # an object literal handed to a call: its methods
        if not top(m.start()) or (m.end() - 1) < 0:
            continue
        opening = b.masked.rfind("{", m.start(), m.end())
        last = b.close.get(opening, len(b.masked) - 1)
        at = opening + 1
        method = re.compile(r"^[ \t]+(?:async\s+)?(\w+)\s*(?::\s*(?:async\s*)?(?:function\s*)?)?\([^;{}]*\)\s*(?:=>\s*)?\{", re.M)
        while (g := method.search(b.masked, at, last)) is not None:
            end = b.close.get(g.end() - 1, last)
            if g.group(1) not in NOT_METHODS:
                out.append(Element(b.line(g.start(1)), b.line(end), g.group(1), "def", "method"))
            at = end + 1
    shown = {e.name.split(" (uses")[0] for e in out}
    for m in re.finditer(r"^export\s+default\s+(\w+)\s*;?\s*$|^module\.exports\s*=\s*(\w+)|^export\s+\{([^}]*)\}", b.masked, re.M):
        for name in re.findall(r"\w+", m.group(1) or m.group(2) or m.group(3) or ""):
            if name not in exported:
                exported[name] = b.line(m.start())
                if name not in shown or m.group(3) is None:
                    out.append(Element(b.line(m.start()), b.line(m.end() - 1), name, "def", "export"))
    return sorted(out, key=lambda e: e.line)


# --- markup and data -----------------------------------------------------------------------------------------------------------

HTML_TAG = r"[a-zA-Z0-9\-]+"


def _attributes(s: str) -> str:
    out = []
    for name in ("id", "class"):
        m = re.search(name + r"\s*=\s*[\"']?([^\"' >]+)[\"']?", s, re.I)
        if m:
            out.append(f'{name}="{m.group(1)}"')
    return " ".join(out)


def _markup(lines: list[str]) -> Iterator[tuple[int, str]]:
    """Lines with markup: not blank, not begun by a comment, not inside one that such a line began."""
    hidden = False
    for i, s in enumerate(map(str.strip, lines)):
        if not hidden and s and not s.startswith("<!--"):
            yield i, s
        else:
            hidden = (hidden or s.startswith("<!--")) and "-->" not in s


def _tag_pairs(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(line of the opening tag, line of the closing one, tag): each closing tag takes the latest open one of its name; a line's opening tags come first."""
    open_at = defaultdict(list)
    for i, s in _markup(lines):
        opening, closing = (re.findall(f"<{slash}({HTML_TAG}){end}", s) for slash, end in (("", ""), ("/", ">")))
        for tag in opening:
            open_at[tag.lower()].append(i)
        yield from ((open_at[tag].pop(), i, tag) for tag in map(str.lower, closing) if open_at[tag])


def _button_label(inner: str) -> str:
    m = re.search(r"<button[^>]*>(.*?)</button>", inner, re.S | re.I)
    label = " ".join(m.group(1).split()) if m else ""
    plain = len(label) <= 50 and "{{" not in label and "{%" not in label
    return "" if not label else f' "{label}"' if plain else f' "{label[:47]}..."'


def _tag_name(tag: str, rows: list[str]) -> tuple[str, str]:
    """(name, type) of an element whose lines are rows."""
    opening = rows[0].strip()
    if tag == "script":
        m = re.search(r"src\s*=\s*[\"']?([^\"' >]+)[\"']?", opening, re.I)
        return (f'<script src="{m.group(1)}">' if m else "<script> (inline)"), "script"
    if tag == "style":
        return "<style>", "style"
    shown = " ".join(filter(None, (tag, _attributes(opening))))
    return f"<{shown}>" + (_button_label(" ".join(map(str.strip, rows))) if tag == "button" else ""), "element"


def html(text: str) -> list[Element]:
    """Closed tags, in the order in which they close, then tags that close themselves; p and span aren't listed."""
    lines = text.splitlines()
    pairs = ((a, b, *_tag_name(tag, lines[a : b + 1])) for a, b, tag in _tag_pairs(lines) if tag not in ("p", "span"))
    out = [Element(a, b, name, "def", kind) for a, b, name, kind in pairs]
    alone = ((i, m) for i, s in enumerate(lines) for m in re.finditer(f"<({HTML_TAG})[^>]*?/>", s))
    out += [Element(i, i, "<" + " ".join(filter(None, (m.group(1).lower(), _attributes(m.group())))) + "/>", "def", "element") for i, m in alone]
    return capped(out)


#: FIXED VALUES: the patterns decide what counts as a comment, selector or rule; between two slashes anything is a comment.
CSS_COMMENT, CSS_SELECTOR, CSS_RULE = r"/\\*.*?\\*/", r"([^{}/]+)\{[^{}]*?\}", r"(@[a-zA-Z\\-]+)[^;{]*?(?:;|\{[^{}]*?\})"


def css(text: str) -> list[Element]:
    line = lambda at: text.count("\n", 0, at)
    comments = [(m.start(), m.end(), m.group()) for m in re.finditer(CSS_COMMENT, text, re.S)]
    inside = lambda at: any(a <= at < b for a, b, _ in comments)
    out = [Element(line(m.start()), line(m.end()), f"{m.group(1)} ...", "def", "at-rule") for m in re.finditer(CSS_RULE, text, re.S) if not inside(m.start())]
    for m in re.finditer(CSS_SELECTOR, text, re.S):
        head = " ".join(m.group(1).split())
        if not inside(m.start()) and not head.startswith("@"):
            out.append(Element(line(m.start()), line(m.end()), short(head, 80) + " {...}", "def", "selector"))
    out += [Element(line(a), line(b), s[:80] + ("... */" if len(s) > 80 else ""), "comment", "comment") for a, b, s in comments]
    return capped(out)


class _JsonLines:
    """Where the text of a JSON document shows what its values hold: found by text, so approximate, each question answered once."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.block, self.key, self.value = cache(self._block), cache(self._key), cache(self._value)

    def _block(self, opening: str, closing: str) -> tuple[int, int]:
        """From the first line that begins or ends with the bracket to that where as many have closed."""
        last = max(len(self.lines) - 1, 0)
        first = next((i for i, s in enumerate(self.lines) if s.strip().startswith(opening) or s.strip().endswith(opening)), None)
        if first is None:
            return 0, last
        depth = accumulate(s.count(opening) - s.count(closing) for s in self.lines[first:])
        return first, next((i for i, d in enumerate(depth, first) if d <= 0 and closing in self.lines[i]), max(first, last))

    def _key(self, k: str) -> int:
        a, b = self.block("{", "}")
        return next((i for i in range(a, b) if json.dumps(k) + ":" in self.lines[i]), a)

    def _value(self, shown: str) -> int:
        return next((i for i, s in enumerate(self.lines) if shown in s and not (s.strip().startswith('"') and ":" in s)), 0)


def _json_events(value, path: str) -> Iterator[tuple[str, str, object]]:
    """(event, path, value) in document order: object, array, key, value. A stack of iterators, so depth isn't limited."""
    todo = [iter([(path, None, value)])]
    while todo:
        for where, key, v in todo[-1]:
            if key is not None:
                yield "key", where, key
            if isinstance(v, dict):
                yield "object", where, v
                todo.append(iter([(f"{where}.{k}", k, w) for k, w in v.items()]))
            elif isinstance(v, list):
                yield "array", where, v
                todo.append(iter([(f"{where}[{i}]", None, w) for i, w in enumerate(v)]))
            else:
                yield "value", where, v
                continue
            break
        else:
            todo.pop()


def _json_elements(text: str, path: str, shift: int = 0) -> Iterator[Element]:
    at = _JsonLines(text.splitlines())
    for event, where, v in _json_events(json.loads(text), path):
        if event in ("object", "array"):
            a, b = at.block("{", "}") if event == "object" else at.block("[", "]")
            name, kind = (f"{where} {{...}}" if event == "object" else f"{where} [...]"), "struct"
        elif event == "key":
            a = b = at.key(v)
            name, kind = f'"{v}" :', "key"
        else:
            a = b = at.value(json.dumps(v))
            name, kind = repr(short(str(v), 50)), "literal"
            event = "string" if isinstance(v, str) else "number" if isinstance(v, int | float) else "unknown"  # booleans count as numbers
        yield Element(a + shift, b + shift, name, kind, event)


def json_keys(text: str) -> list[Element]:
    """Objects, arrays, keys and values in document order. Where the text isn't one document but each of its lines is, the lines' own."""
    try:
        return capped(list(_json_elements(text, "root")))
    except json.JSONDecodeError:
        rows = [(i, s) for i, s in enumerate(text.splitlines()) if s.strip()]
        if len(rows) < 2:
            raise
        return capped([e for n, (i, s) in enumerate(rows) for e in _json_elements(s, f"root[{n}]", i)])


def yaml_keys(text: str) -> list[Element]:
    import yaml

    out, kinds = [], {"str": "string", "int": "number", "float": "number", "bool": "boolean"}

    def visit(n, path: str) -> None:
        a, b = n.start_mark.line, n.end_mark.line
        if isinstance(n, yaml.ScalarNode):
            kind = kinds.get(n.tag.rsplit(":", 1)[-1], "unknown")
            shown = repr(short(n.value, 50, 50)) if kind == "string" else n.value.lower() if kind == "boolean" else n.value if kind == "number" else f"{n.tag} {n.value}"
            out.append(Element(a, b, shown, "literal", kind))
        elif isinstance(n, yaml.MappingNode):
            out.append(Element(a, b, f"{path} {{...}}", "struct", "mapping"))
            for k, v in n.value:
                out.append(Element(k.start_mark.line, k.end_mark.line, f"{k.value}:", "key", "key"))
                visit(v, f"{path}.{k.value}")
        else:
            out.append(Element(a, b, f"{path} [...]", "struct", "sequence"))
            for i, v in enumerate(n.value):
                visit(v, f"{path}[{i}]")

    root = yaml.compose(text)
    if root is not None:
        visit(root, "root")
    return capped(out)


def xml(text: str) -> list[Element]:
    """All elements; a tag's line is the first that is a whole element of that tag by itself, else 0."""
    import xml.etree.ElementTree as ET

    first: dict[str, int] = {}
    for i, s in enumerate(text.splitlines()):
        if s.strip().startswith("<"):
            try:
                first.setdefault(ET.fromstring(s.strip()).tag, i)
            except ET.ParseError:
                continue
    out = []
    for e in ET.fromstring(text).iter():
        attrs = " ".join(f'{k}="{v}"' for k, v in e.attrib.items())
        out.append(Element(first.get(e.tag, 0), first.get(e.tag, 0), f"<{e.tag} {attrs}>" if attrs else f"<{e.tag}>", "def", "element"))
    return capped(out)


def properties(text: str) -> list[Element]:
    out = []
    for i, s in enumerate(text.splitlines()):
        bare = s.strip()
        if not bare:
            continue
        if bare[0] in "#!":
            out.append(Element(i, i, bare, "comment", "comment"))
        elif m := re.match(r"^\s*([^\s:=]+)\s*[:=\s]\s*(.*)", s):
            out.append(Element(i, i, f"{m.group(1)} = {short(m.group(2).strip(), 50, 50)}", "def", "key"))
        else:
            out.append(Element(i, i, bare[:80], "misc", "unknown"))
    return capped(out)


def markdown(text: str) -> list[Element]:
    """The beginning of the text, headings up to two levels below the first, and fenced blocks."""
    lines = text.splitlines()
    out, top, fence = [], None, None
    named = lambda lang: f"Code Block ({lang})" if lang else "Code Block"
    for i, s in enumerate(lines):
        bare = s.strip()
        if bare.startswith("```"):
            if fence is None:
                fence = (i, bare[3:].strip())
            else:
                body = short("\\n".join(lines[fence[0] + 1 : i]).strip(), 150, 150)
                out.append(Element(fence[0], i, f"{named(fence[1])}: {body}" if body else named(fence[1]), "def", "code_block"))
                fence = None
        elif fence is None and (m := re.match(r"^\s*(#+)\s+(.+)", s)):
            level = len(m.group(1))
            top = level if top is None else top
            if 0 <= level - top <= 2:
                out.append(Element(i, i, f"H{level}: {m.group(2).strip()}", "def", f"heading{level - top + 1}"))
    if fence is not None:
        body = short("\\n".join(lines[fence[0] + 1 :]).strip(), 100, 100)
        name = f"{named(fence[1])} (unterminated)"
        out.append(Element(fence[0], len(lines) - 1, f"{name}: {body}" if body else name, "def", "code_block"))
    prefix = Element(-1, -1, f"Prefix: {short(text, 400, 400)}".replace("\n", " "), "def", "heading1")
    found = capped([prefix, *out])
    return [e._replace(line=max(e.line, 0), end_line=max(e.end_line, 0)) for e in found]


#: Detector by language, and language by extension.
DETECTORS: dict[str, Callable[[str], list[Element]]] = {
    "python": python, "java": java, "javascript": javascript, "html": html, "css": css, "json": json_keys, "yaml": yaml_keys, "xml": xml, "properties": properties, "markdown": markdown,
}
EXTENSIONS = {
    "python": (".py",), "java": (".java",), "javascript": (".js", ".jsx", ".ts", ".tsx"), "html": (".html", ".htm", ".xhsml", ".xhtm", ".xhtml"), "css": (".css",), "json": (".json", ".jsonl", ".geojson"),
    "yaml": (".yaml", ".yml"), "xml": (".xml", ".xsd", ".xsl", ".xslt", ".wsdl", ".rss", ".atom", ".plist"), "properties": (".properties",),
    "markdown": (".md", ".markdown", ".mdx", ".txt", ".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".msg", ".eml"),
}


def register(language: str, detector: Callable[[str], list[Element]], extensions: tuple[str, ...]) -> None:
    DETECTORS[language], EXTENSIONS[language] = detector, extensions


def detector_name(path: Column | str) -> Column:
    return X.lookup({e: name for name, own in EXTENSIONS.items() for e in own}, F.lower(X.extension(path)))


def safely(detector: Callable[[str], list[Element]], text: str) -> list[Element]:
    """A text that can't be read gives one error row."""
    try:
        return detector(text)
    except Exception:
        return [Element(0, 0, "[Processing Error]", "err", "unknown")]


def elements(files: DataFrame, language: str | None = None) -> DataFrame:
    """(file_id, path, element_no, element_type, kind, name, start_line, end_line) of files (file_id, path, text), by extension or all in one language."""
    detectors = dict(DETECTORS)
    kind = files.schema["file_id"].dataType.simpleString()
    source = files.select("file_id", "path", (F.lit(language) if language else detector_name("path")).alias("detector"), "text").where("detector is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, rows = [], [], []
            for i, (name, text) in enumerate(zip(b.column("detector").to_pylist(), b.column("text").to_pylist(), strict=True)):
                found = safely(detectors[name], text)
                at += [i] * len(found)
                no += range(len(found))
                rows += found
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id").take(take), b.column("path").take(take), pa.array(no, pa.int32()), *(pa.array(cols[k], pa.string()) for k in (4, 3, 2)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32())],
                names=["file_id", "path", "element_no", "element_type", "kind", "name", "start_line", "end_line"],
            )

    return source.mapInArrow(run, f"file_id {kind}, path string, element_no int, element_type string, kind string, name string, start_line int, end_line int")


# --- forms that stay in the JVM ------------------------------------------------------------------------------------------------


def headings(lines: DataFrame, by: str = "path") -> DataFrame:
    """Headings up to two levels below a text's first, from (by, pos, line): level and element_type."""
    found = lines.withColumn("level", F.length(F.regexp_extract("line", r"^\s*(#+)\s+(.+)", 1))).where("level > 0")
    first = F.first("level").over(Window.partitionBy(by).orderBy("pos"))
    found = found.withColumn("deeper", F.col("level") - first).where(F.col("deeper").between(0, 2))
    return found.select(by, "pos", "level", F.concat(F.lit("heading"), (F.col("deeper") + 1).cast("string")).alias("element_type"), F.trim(F.regexp_extract("line", r"^\s*(#+)\s+(.+)", 2)).alias("name"))


def fences(lines: DataFrame, by: str = "path") -> DataFrame:
    """Fenced blocks by pairing odd and even fence lines; an odd last one has no end."""
    w = Window.partitionBy(by).orderBy("pos")
    f = lines.where(F.ltrim("line").startswith("```")).withColumn("nth", F.row_number().over(w)).withColumn("end_pos", F.lead("pos").over(w))
    return f.where("nth % 2 = 1").select(by, F.col("pos").alias("start_pos"), "end_pos", F.trim(F.substring(F.trim("line"), F.lit(4), F.length("line"))).alias("language"))


def property_rows(lines: DataFrame) -> DataFrame:
    """Key, comment or unknown for each line that isn't blank, from columns that include line."""
    s, pattern = F.trim("line"), r"^\s*([^\s:=]+)\s*[:=\s]\s*(.*)"
    key, value = F.regexp_extract("line", pattern, 1), F.trim(F.regexp_extract("line", pattern, 2))
    kind = F.when(s.rlike(r"^[#!]"), "comment").when(key != "", "key").otherwise("unknown")
    name = F.when(kind == "comment", s).when(kind == "key", F.concat(key, F.lit(" = "), X.truncate(value, 50, 50))).otherwise(F.substring(s, 1, 80))
    return lines.where(s != "").withColumn("element_type", kind).withColumn("name", name)


def css_selectors(text: Column | str) -> Column:
    """Selectors in order, blanks collapsed, rules left out."""
    heads = F.transform(F.regexp_extract_all(X.col(text), F.lit(CSS_SELECTOR), F.lit(1)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(heads, lambda s: ~s.startswith("@"))


def tag_counts(html_text: Column | str) -> Column:
    """Opening tags, in lower case, as an array with repetitions."""
    return F.transform(F.regexp_extract_all(X.col(html_text), F.lit(f"<({HTML_TAG})"), F.lit(1)), F.lower)


def truncated(rows: DataFrame, by: str, order: list[str], most: int = MOST) -> DataFrame:
    """rows (by, name, line, end_line, ...): the first `most` of each `by`, and a marker row for those with more."""
    w, whole = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by)
    numbered = rows.withColumn("nth", F.row_number().over(w)).withColumn("total", F.count("*").over(whole)).where(F.col("nth") <= most)
    marker = numbered.where((F.col("nth") == most) & (F.col("total") > most)).withColumns(
        {"name": F.format_string(f"[... Truncated - {most}/%d elements shown ...]", "total"), "line": F.col("end_line"), "nth": F.lit(most + 1)}
    )
    return numbered.unionByName(marker).drop("total")
