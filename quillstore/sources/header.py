"""Headers of Markdown files: the part of YAML that headers use, read to JSON and written with what must be quoted quoted.

Read are mappings and lists by indentation and in flow form, to any depth, plain and quoted scalars, block scalars and
comments. A file whose fences or header do not parse is all body. Arrow batches of texts go in, JSON comes out, and Spark
takes fields from it by schema.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = re.compile(r"\A\ufeff?---[ \t]*\r?\n"), re.compile(r"^---[ \t]*(?:\r?\n|\Z)", re.M)
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{}#&*!|>'"%@`,-](?:[^#]|(?<=\S)#)*?|-[^\s#](?:[^#]|(?<=\S)#)*?)\s*:(?:\s+|$)""")
_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?\Z")
# Words that are not strings, and escapes in double quotes.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", '"': '"', "/": "/", "\\": "\\", "_": "\xa0", " ": " "}


class Bad(ValueError):
    """Text that is no header."""


def _quoted(s: str, i: int) -> tuple[str, int]:
    """The quoted scalar that begins at s[i], and the place after it."""
    quote, i, out = s[i], i + 1, []
    while i < len(s):
        c = s[i]
        if c == quote == "'" and s[i + 1 : i + 2] == "'":
            out.append("'")
            i += 2
        elif c == quote:
            return "".join(out), i + 1
        elif c == "\\" and quote == '"':
            size = {"x": 2, "u": 4, "U": 8}.get(s[i + 1 : i + 2], 0)
            if not size and s[i + 1 : i + 2] not in ESCAPES:
                raise Bad(s)
            try:
                out.append(chr(int(s[i + 2 : i + 2 + size], 16)) if size else ESCAPES[s[i + 1]])
            except (ValueError, OverflowError) as e:
                raise Bad(s) from e
            i += 2 + size
        else:
            out.append(c)
            i += 1
    raise Bad(s)


def _plain(s: str):
    s = s.strip()
    if s in WORDS:
        return WORDS[s]
    if _NUMBER.match(s):
        return float(s) if re.search("[.eE]", s) else int(s)
    if s[0] in "&*!|>%@`,]}" or ": " in s or s.endswith(":"):
        raise Bad(s)
    return s


def _flow(s: str, i: int):
    """The value in flow form at s[i:], and the place after it."""
    while i < len(s) and s[i] in " \t\n":
        i += 1
    if i >= len(s):
        raise Bad(s)
    if s[i] in "\"'":
        return _quoted(s, i)
    if s[i] not in "[{":
        end = re.compile(r"[,\[\]{}]|:\s|\s#").search(s, i)
        end = end.start() if end else len(s)
        return _plain(s[i:end]), end
    close, out, i = ("]", [], i + 1) if s[i] == "[" else ("}", {}, i + 1)
    while True:
        while i < len(s) and s[i] in " \t\n":
            i += 1
        if s[i : i + 1] == close:
            return out, i + 1
        value, i = _flow(s, i)
        if close == "}":
            if s[i : i + 1] != ":":
                raise Bad(s)
            out[str(value)], i = _flow(s, i + 1)
        else:
            out.append(value)
        while i < len(s) and s[i] in " \t\n":
            i += 1
        if s[i : i + 1] == ",":
            i += 1
        elif s[i : i + 1] != close:
            raise Bad(s)


class _Lines:
    """A header's lines, and the one that is read next."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        """(indentation, text) of the next line with content."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body and not body.startswith("#") and body.strip():
                if body[0] == "\t":
                    raise Bad(line)
                return len(line) - len(body), body.rstrip()
            self.at += 1
        return None

    def block(self, mark: str, indent: int) -> str:
        """A block scalar whose lines are indented by more than `indent`."""
        style = re.fullmatch(r"([|>])([-+]?)(?:\s+#.*)?", mark)
        if not style:
            raise Bad(mark)
        rows = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > indent):
            rows.append(self.lines[self.at])
            self.at += 1
        depth = min((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), default=0)
        rows = [r[depth:] for r in rows]
        ends = len(rows) - next((i for i, r in enumerate(reversed(rows)) if r.strip()), len(rows))
        tail, rows = len(rows) - ends, rows[:ends]
        if style[1] == ">":  # a line break becomes a space, a blank line a break
            text = re.sub(r"(?<=[^\n])\n(?=[^\n ])", " ", "\n".join(rows))
            text = re.sub(r"\n(\n+)(?=[^\n ])", r"\1", text)
        else:
            text = "\n".join(rows)
        return text + ("" if style[2] == "-" or not rows else "\n" * (1 + tail) if style[2] == "+" else "\n")

    def value(self, rest: str, indent: int):
        """What stands after a key or a dash, on its line or below."""
        rest = rest.strip()
        if rest.startswith("#"):
            rest = ""
        if rest[:1] in ("|", ">") and rest[:1]:
            return self.block(rest, indent)
        if rest[:1] in ("[", "{", '"', "'"):
            while True:  # may go on below
                try:
                    out, end = _flow(rest, 0)
                    break
                except Bad:
                    if self.at >= len(self.lines) or not (more := self.lines[self.at]).startswith(" " * (indent + 1)):
                        raise
                    rest, self.at = f"{rest}\n{more.strip()}", self.at + 1
            if rest[end:].strip() and not re.match(r"\s+#", rest[end:]):
                raise Bad(rest)
            return out
        if rest:
            return _plain(re.split(r"\s+#", rest, maxsplit=1)[0])
        below = self.peek()
        if below and (below[0] > indent or (below[0] == indent and below[1].startswith("- "))):
            return self.node(below[0])
        return None

    def node(self, indent: int):
        """The mapping or list whose lines have this indentation."""
        first = self.peek()[1]
        out = [] if first == "-" or first.startswith("- ") else {}
        while (line := self.peek()) and line[0] == indent:
            text = line[1]
            if isinstance(out, list):
                if text != "-" and not text.startswith("- "):
                    break
                rest = text[1:].strip()
                if rest and rest[0] not in "[{" and _KEY.match(rest):  # a mapping that begins on the dash's line
                    inner = indent + len(text) - len(text[1:].lstrip(" "))
                    self.lines[self.at] = " " * inner + rest
                    out.append(self.node(inner))
                else:
                    self.at += 1
                    out.append(self.value(text[1:], indent))
                continue
            if text.startswith("- ") or not (m := _KEY.match(text)):
                raise Bad(text)
            key = _quoted(m[1], 0)[0] if m[1][0] in "\"'" else m[1]
            if key in out:
                raise Bad(key)
            self.at += 1
            out[key] = self.value(text[m.end() :], indent)
        if (line := self.peek()) and line[0] > indent:
            raise Bad(line[1])
        return out


def load(text: str):
    """The value of a header's text."""
    lines = _Lines(text.replace("\r\n", "\n"))
    first = lines.peek()
    if first is None:
        return {}
    out = lines.node(first[0])
    if lines.peek():
        raise Bad(text)
    return out


def split(text: str | None) -> tuple[str | None, str | None]:
    """(header as JSON, body); no header where fences or header do not parse, and then all is body."""
    if text is None:
        return None, None
    begin = _OPEN.match(text)
    end = begin and _CLOSE.search(text, begin.end())
    try:
        header = load(text[begin.end() : end.start()]) if end else None
    except (Bad, RecursionError):
        header = None
    if not isinstance(header, dict):
        return None, text.removeprefix("\ufeff")
    return json.dumps(header, ensure_ascii=False), text[end.end() :]


def _scalar(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool) or isinstance(x, (int, float)):
        return json.dumps(x)
    safe = re.fullmatch(r"[A-Za-z0-9_./(À-ɏ][^\x00-\x1f\x7f-\x9f\ufeff\u2028\u2029\ud800-\udfff]*", x) and not x.endswith((" ", ":", "\xa0")) and ": " not in x and " #" not in x
    if safe and x not in WORDS and not re.match(r"[-+.\d]|(?i:y|n|yes|no|on|off|null|true|false)\Z", x):
        return x
    return _in_quotes(x)


def _in_quotes(x: str) -> str:
    return json.dumps(x, ensure_ascii=False).translate({0x7F: "\\x7f", 0x85: "\\x85", 0x2028: "\\u2028", 0x2029: "\\u2029", 0xFEFF: "\\ufeff"})


def dump(value: dict, indent: int = 0) -> str:
    """A mapping as a header's lines; what could be read as anything but its string is quoted."""
    pad, out = " " * indent, []
    for k, v in value.items():
        key = _scalar(str(k)) if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", str(k)) else _in_quotes(str(k))
        if isinstance(v, dict) and v:
            out += [f"{pad}{key}:", dump(v, indent + 2)]
        elif isinstance(v, list) and v:
            out.append(f"{pad}{key}:")
            for x in v:
                if isinstance(x, dict) and x:
                    out.append(f"{pad}  - {dump(x, indent + 4).lstrip(' ')}")
                else:
                    out.append(f"{pad}  - {_scalar(x) if not isinstance(x, (list, dict)) else json.dumps(x, ensure_ascii=False)}")
        else:
            out.append(f"{pad}{key}: {_scalar(v) if not isinstance(v, (list, dict)) else '[]' if isinstance(v, list) else '{}'}")
    return "\n".join(out)


def parsed(text: Column | str) -> Column:
    """Column (header: JSON, body) of file texts."""

    @F.pandas_udf("header string, body string")
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split(t) for t in texts], columns=["header", "body"], dtype=object)

    return each(text)


def rendered(header: Column | str, body: Column | str) -> Column:
    """File texts of headers (JSON objects) and bodies."""

    @F.pandas_udf("string")
    def each(headers: pd.Series) -> pd.Series:
        return headers.map(lambda h: dump(json.loads(h)), na_action="ignore")

    return F.concat(F.lit("---\n"), each(header), F.lit("\n---\n"), body)
