"""Secret scans: pattern spans plus an assignment-aware lexer.

Base spans come from three patterns (assignments to sensitive words, access key ids, long
hexadecimal runs). The lexer then reads source and configuration syntax: text becomes
tokens (words, strings with escapes, comments, operators), and tokens become name-literal
pairs from

- assignments and mappings (``=``, ``:``, ``:=``, ``=>``, ``==``), with type annotations,
  index targets (``conf["pwd"] =``), and bare values as in .env, YAML and properties files;
- calls (``set("db.password", "x")``, ``with_password("x")``, keyword arguments);
- elements and attributes of markup (``<pwd>x</pwd>``, ``<add key="pwd" value="x">``);
- nesting: a neutral key such as ``value`` takes the name of the mapping that holds it, by
  braces or by indentation.

Constants propagate through references and concatenation (``a = "x" + "y"; db_pwd = a``)
within the braces that they are seen in. Each literal is scored by its value and by the
most sensitive name it ends up under; literals that score enough and that no base span
touches are added under kind ``named``, each piece of a concatenation as a span. Base
patterns stop at characters that secrets may hold, so the whole value is added under kind
``wide`` where it reaches beyond its base span: to the closing quote, or to the end of a
bare value. Base spans always stay. A quoted value with inner spaces counts only under a
name that is strongly sensitive; in comments only quoted values count.

Defined results: null and empty texts have no spans; repeated rows each give a row; a row
without doc_id is scanned like any other; extra columns are ignored; an empty table gives
an empty result. Offsets are code points, ends exclusive. Each row stands alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import lean, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named", "wide")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6

# How strongly a part of a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "secrets": 1.0, "token": 0.8,
    "credential": 0.9, "credentials": 0.9, "cred": 0.9, "creds": 0.9, "apikey": 0.9, "auth": 0.5, "private": 0.4, "key": 0.4, "signing": 0.3, "access": 0.3, "api": 0.3, "encryption": 0.4, "bearer": 0.5,
}
TRIGGERS = ("pass", "pwd", "secret", "token", "cred", "key", "auth", "bearer")
DULL = frozenset("true false none null nil undefined default string str int example".split())
THRESHOLD = 0.55
STRONG = 0.9  # weight of a name under which a quoted value may hold spaces

VALUE_ENDS = {q: re.compile(rf"(?:\\.|[^\\\n{q}])*(?={q})") for q in "\"'`"}
BARE = re.compile(r"""[^\s,;"'`(){}\[\]<>]+""")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# A sensitive word that some syntax may tie to a value: only texts with one are lexed.
HOPEFUL = re.compile(rf"(?:{'|'.join(TRIGGERS)})[\w.$-]*[\"'`\])]*[ \t]*[=:,(<>]|(?:{'|'.join(TRIGGERS)})[\w.$-]*[\"'][ \t]+\w+[ \t]*=")
TOKEN = re.compile(
    r"""(?P<line>\n)
|(?P<gap>[ \t\r\f\v]+)
|(?P<open>/\*|<!--|\"\"\"|''')
|(?P<comment>(?<!\S)\#[^\n]*|(?<![^\s;{}(),])//[^\n]*)
|(?P<string>"(?:\\.|[^"\\\n])*"|(?<!\w)'(?:\\.|[^'\\\n])*'|`[^`\n]+`)
|(?P<op>=>|:=|={1,3}|!={1,2}|::|:|\+=?)
|(?P<word>[$@%]?[A-Za-z_][\w$]*(?:[.-]+[A-Za-z_][\w$]*)*)
|(?P<mark>.)""",
    re.VERBOSE,
)
CLOSING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
TIES = frozenset(("=", ":", ":=", "=>", "==", "===", "!=", "!==", "+="))
NEUTRAL = frozenset("value val default data text content string literal".split())  # keys that speak for the mapping around them
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>\n]+)</\1\s*>")
TAG = re.compile(r"<[A-Za-z][^<>\n]*>")
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
TAG_NAMES, TAG_VALUES = ("key", "name", "id"), ("value", "content", "default")


@dataclass(frozen=True)
class Piece:
    """A literal, or a part of one, as it stands in the text."""

    start: int
    end: int
    quoted: bool


@dataclass(frozen=True)
class Pair:
    name: str
    pieces: tuple[Piece, ...]
    value: str


def name_weight(name: str) -> float:
    """Sum of the weights of a name's parts, at most 1."""
    return min(1.0, sum(NAME_WEIGHTS.get(p.lower(), 0.0) for p in PARTS.findall(name)))


def value_weight(value: str, spaced: bool = False) -> float:
    """How much a literal looks like a secret: long enough, varied, not a plain constant, without spaces unless ``spaced``."""
    if len(value) < LEAST_VALUE or value.lower() in DULL or not spaced and " " in value.strip() or value.isdigit() and len(value) < 8:
        return 0.0
    if value.startswith(("${", "{{", "<", "%(", "os.", "env.")):
        return 0.0
    n = len(value)
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    return min(1.0, 0.35 + entropy / 5 + 0.2 * (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)))


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what matters to the parser: no gaps; comments give only their strings and what ties them."""
    at, dead = 0, set()
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "open":
            mark = m[0]
            close = -1 if mark in dead else text.find(CLOSING[mark], end)
            if close < 0:  # never closed: no need to look again
                dead.add(mark)
                kind, end = ("string", end) if mark in ('"""', "'''") else ("mark", end)
            else:
                end = close + len(CLOSING[mark])
                kind = "string" if mark in ('"""', "'''") else "comment"
        if kind == "comment":
            yield "line", at, at
            inner = at + 1
            while inner < end and text[inner] in "/*#!-":
                inner += 1
            rest = []
            while inner < end:
                n = TOKEN.match(text, inner, end)
                if n.lastgroup not in ("gap", "open", "comment"):
                    rest.append((n.lastgroup, inner, n.end()))
                inner = n.end()
            for i, t in enumerate(rest):  # a value in a comment counts if it is quoted
                if t[0] == "string" or i + 2 < len(rest) and rest[i + 1][0] == "op" and rest[i + 2][0] == "string" or i + 1 < len(rest) and t[0] == "op" and rest[i + 1][0] == "string":
                    yield t
                else:
                    yield "line", t[1], t[1]
            yield "line", end, end
        elif kind != "gap":
            yield kind, at, end
        at = end


def _inside(text: str, start: int, end: int) -> Piece:
    """A string without its quotes."""
    n = 3 if text[start : start + 3] in ('"""', "'''") and end - start >= 6 else 1
    return Piece(start + n, max(start + n, end - n), True)


class Reader:
    """One pass over the tokens of a text, collecting name-literal pairs."""

    def __init__(self, text: str):
        self.text = text
        self.toks = list(tokens(text))
        self.pairs: list[Pair] = []
        self.scopes: list[dict[str, tuple[Piece, ...]]] = [{}]
        self.holders: list[str | None] = []  # names of the open brackets around
        self.blocks: list[tuple[int, str]] = []  # indentation and name of the open mappings above

    def kind(self, i: int) -> str:
        return self.toks[i][0] if i < len(self.toks) else "line"

    def said(self, i: int) -> str:
        return self.text[self.toks[i][1] : self.toks[i][2]] if i < len(self.toks) else ""

    def name_at(self, i: int) -> str:
        t = self.toks[i]
        if t[0] == "string":
            p = _inside(self.text, t[1], t[2])
            return self.text[p.start : p.end]
        return self.said(i).lstrip("$@%")

    def seen(self, name: str) -> tuple[Piece, ...] | None:
        name = name.lstrip("$@%")
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def add(self, name: str, pieces: tuple[Piece, ...]) -> None:
        if not pieces:
            return
        own = name
        if own.lower() in NEUTRAL:
            around = next((h for h in reversed(self.holders) if h), None) or (self.blocks[-1][1] if self.blocks else None)
            own = around or own
        self.pairs.append(Pair(own, pieces, "".join(self.text[p.start : p.end] for p in pieces)))
        self.scopes[-1][name] = pieces

    def joins(self, i: int) -> bool:
        """Whether token i puts strings together."""
        return self.said(i) == "+" or self.said(i) == "." and self.text[self.toks[i][1] - 1].isspace()

    def expression(self, i: int) -> tuple[tuple[Piece, ...], int]:
        """Literals of the expression at token i (strings, references, one bare value), and the token after it."""
        out: list[Piece] = []
        while i < len(self.toks):
            kind, start, end = self.toks[i]
            if kind == "string":
                out.append(_inside(self.text, start, end))
                i += 1
                if self.kind(i) == "string":  # adjacent strings are one
                    continue
            elif kind == "word" and (known := self.seen(self.said(i))) is not None:
                out += known
                i += 1
            elif kind == "word" and (out or self.joins(i + 1)):
                i += 1
            elif kind in ("word", "mark", "op") and not out and (m := BARE.match(self.text, start)):
                if self.text[m.end() : m.end() + 1] in ("(", "["):  # a call or an index, no value
                    return (), i
                while i < len(self.toks) and self.toks[i][1] < m.end():
                    i += 1
                return (Piece(start, m.end(), False),), i
            else:
                break
            if self.joins(i):
                i += 1
                while self.kind(i) == "line" and i < len(self.toks):
                    i += 1
                continue
            break
        return tuple(out), i

    def markup(self) -> None:
        for m in ELEMENT.finditer(self.text):
            value = m[2].strip()
            if value:
                start = m.start(2) + m[2].index(value)
                self.pairs.append(Pair(m[1], (Piece(start, start + len(value), True),), value))
        for m in TAG.finditer(self.text):
            found = {a[1].lower(): a for a in ATTRIBUTE.finditer(self.text, m.start(), m.end())}
            name = next((found[n] for n in TAG_NAMES if n in found), None)
            value = next((found[v] for v in TAG_VALUES if v in found), None)
            if name and value:
                group = 2 if value[2] is not None else 3
                self.pairs.append(Pair(name[2] if name[2] is not None else name[3], (Piece(value.start(group), value.end(group), True),), value[group]))

    def read(self) -> list[Pair]:
        i, fresh, n = 0, True, len(self.toks)
        while i < n:
            kind, start, _ = self.toks[i]
            if kind == "line":
                fresh = True
                i += 1
                continue
            if fresh:  # first token of a line: mappings that are not further out end here
                indent = start - (self.text.rfind("\n", 0, start) + 1)
                while self.blocks and self.blocks[-1][0] >= indent:
                    self.blocks.pop()
                fresh = False
            if kind == "mark":
                c = self.said(i)
                if c in "{[(":
                    self.holders.append(None)
                    if c == "{":
                        self.scopes.append({})
                elif c in "}])":
                    if self.holders:
                        self.holders.pop()
                    if c == "}" and len(self.scopes) > 1:
                        self.scopes.pop()
                i += 1
                continue
            if kind not in ("word", "string"):
                i += 1
                continue
            if kind == "word" and self.said(i + 1) == "(" and self.kind(i + 2) == "string":
                first = self.toks[i + 2]
                if self.said(i + 3) == "," and self.kind(i + 4) == "string":
                    self.add(self.name_at(i + 2), (_inside(self.text, *self.toks[i + 4][1:]),))
                elif self.said(i + 3) == ")":
                    self.add(self.name_at(i), (_inside(self.text, *first[1:]),))
                i += 1
                continue
            j = i + 1
            while self.said(j) == "]":
                j += 1
            if not (self.kind(j) == "op" and self.said(j) in TIES):
                i += 1
                continue
            name, k = self.name_at(i), j + 1
            if self.said(j) == ":" and self.kind(k) == "word" and self.said(k + 1) == "=":
                k += 2  # name: type = value
            if self.kind(k) == "line":
                if self.said(j) == ":":
                    self.blocks.append((start - (self.text.rfind("\n", 0, start) + 1), name))
                i = k
            elif self.said(k) in ("{", "["):
                self.holders.append(name)
                if self.said(k) == "{":
                    self.scopes.append({})
                i = k + 1
            else:
                pieces, after = self.expression(k)
                self.add(name, pieces)
                i = max(after, j + 1)
        self.markup()
        return self.pairs


def literals(text: str) -> list[Pair]:
    """Name-literal pairs with constants propagated through references and concatenation."""
    return Reader(text).read()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base patterns."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def whole_value(text: str, start: int) -> tuple[int, int]:
    """Extent of the value that starts at ``start``: up to its closing quote if a quote that is closed on its line opens it, else a bare run."""
    ends = VALUE_ENDS.get(text[start - 1 : start])
    m = (ends and ends.match(text, start)) or BARE.match(text, start)
    return start, m.end() if m else start


def covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether sorted ``spans`` together hold all of start to end."""
    for s, _, e in spans:
        if s <= start < e:
            start = e
    return start >= end


def named_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Literals under sensitive names that no base span touches, and whole values that reach beyond base spans."""
    wide = {whole_value(text, ASSIGN.match(text, s).start(2)) for s, k, _ in base if k == 0}
    named = set()
    low = text.lower()
    if any(t in low for t in TRIGGERS) and HOPEFUL.search(low):
        for pair in literals(text):
            weight = name_weight(pair.name)
            if weight < THRESHOLD or any(not p.quoted for p in pair.pieces) and not any(c.isdigit() for c in pair.value):
                continue
            if weight * value_weight(pair.value, weight >= STRONG) < THRESHOLD:
                continue
            for p in pair.pieces:
                if p.start == p.end:
                    continue
                touched = any(s < p.end and p.start < e for s, _, e in base)
                (wide if touched else named).add((p.start, p.end))
    return [(s, 3, e) for s, e in named] + [(s, 4, e) for s, e in wide if not covered(s, e, base)]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each sorted (start, kind number, end)."""
    base = base_spans(text)
    return base, sorted(base + named_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """Text with secret values replaced; of an assignment only the value goes."""
    spans = []
    for s, k, e in scan(text)[1]:
        if k == 0:
            s = ASSIGN.match(text, s).start(2)
        spans.append((s, e))
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long, n_wide long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document with its counts and spans."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                base, every = scan(x.as_py() or "")
                n = [sum(k == i for _, k, _ in every) for i in range(5)]
                rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), *n[3:]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), *[pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secret values replaced in ``text``; other columns as they are, ``n_chars`` made to agree."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (v := x.as_py()) is None else redact(v) for x in batch.column(at)]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in names else out
