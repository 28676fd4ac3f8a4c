"""Secret scans by assignment-aware lexing.

Beside three fixed patterns (assign, access, hex), a text is read as source or configuration: every `name = value`,
`name: value`, `name := value`, `name += value`, `"name" => value`, `name: type = value`, `table["name"] = value`,
`<name>value</name>`, YAML block under `name: |`, call `f("name", "value")` and list `name: ["value", ...]` gives a pair of a name and
a value. Values are sums of strings (prefixed, escaped, in triple quotes or backticks; joined by `+` or by standing next to
each other, over lines inside brackets), bare words and names, or the strings in a call (defaults). All pairs of the text are read
first. How sensitive a name is goes on to the names that it is given, to a fixed point, strongest first; a name with one
assignment has the value of its sum, one with several has each of them by itself. A pair or list item inside braces, an
indented block or a section that belongs to a sensitive name is as sensitive as that. A literal is a finding (kind `literal`, at the place
where it is written) if it reaches a sensitive name and looks chosen at random: the weight of the name's words plus the entropy
of the value in bits a character reach `THRESHOLD`. Bare words of letters alone, placeholders and references to an environment
are none. A literal inside an `assign` span is part of that.

The work for a text grows with its length (by the log of it for sorted spans): names, values and weights are resolved once each,
and values that end at the same place share their counts.

Null and empty texts have no findings. Each row is scanned by itself, whole; a column named `secrets` is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import spans
from fleetlens.llm.common import table

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "literal"]
_assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")
_name = re.compile(r"""(?<![A-Za-z0-9_.\-])[A-Za-z_][A-Za-z0-9_.\-]*+""")
_subscript = re.compile(r"""\[[ \t]*+["']([^"'\n\]]*+)["'][ \t]*+\]""")
_sign = re.compile(r"""["']?[ \t]*+(:=|=>|\+=|=(?!=)|:(?!:))[ \t]*+""")
_type = re.compile(r"""[A-Za-z_][A-Za-z0-9_.]*+(?:\[(?:[^\[\]\n=]|\[[^\[\]\n=]*+\])*+\])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+[ \t]*+=(?![=>])[ \t]*+""")
_string = re.compile(r"""(?:[A-Za-z]{1,2}(?=["']))?(?:\"""((?:[^\\"]|\\.|"(?!""))*+)\"""|'''((?:[^\']|\\.|'(?!''))*+)'''|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.S)
_bare = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_glue = re.compile(r"""[ \t]*+(\+(?!=)[ \t]*+)?""")
_wide = re.compile(r"""\s*+(\+(?!=)\s*+)?""")
_call = re.compile(r"""[A-Za-z_][A-Za-z0-9_.]*+\(""")
_comma = re.compile(r"""[\s,]*+(?:[A-Za-z_][A-Za-z0-9_]*+[ \t]*+=(?!=)[ \t]*+)?""")
_element = re.compile(r"""<([A-Za-z_][A-Za-z0-9_.\-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>""")
_block = re.compile(r"""^([ \t]*+)(?:-[ \t]++)?["']?([A-Za-z_][A-Za-z0-9_.\-]*+)["']?[ \t]*+:[ \t]*+[|>][+\-]?[ \t]*+\n((?:\1[ \t]++[^\n]++(?:\n|$))++)""", re.M)
_opened = re.compile(r"""(?<![A-Za-z0-9_.\-])([A-Za-z_][A-Za-z0-9_.\-]*+)["']?[ \t]*+(?:=>|:=|[:=])?\s*+\{|[{}]""")
_line = re.compile(r"""^([ \t]*+)(-[ \t]++)?(?:["']?([A-Za-z_][A-Za-z0-9_.\-]*+)["']?[ \t]*+:[ \t]*+$)?""", re.M)
_item = re.compile(r"""^[ \t]*+-[ \t]++(?=[^\n]*[^\s:][ \t]*+$)""", re.M)
_section = re.compile(r"""^\[([A-Za-z_][A-Za-z0-9_.\- ]*+)\][ \t]*+$""", re.M)
_identifier = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+")
_odd = re.compile(r"[^A-Za-z.,:!?_\-]|[a-z](?=[A-Z])")
_parts = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_placeholder = re.compile(r"(?i)none|null|nil|true|false|changeme|example|password|secret|token")

#: Weights of a name's words; two that stand next to each other count as one.
SENSITIVE = {
    "password": 3.0, "passwords": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "secrets": 3.0, "token": 2.5, "apikey": 3.0, "privatekey": 3.0,
    "accesskey": 3.0, "secretkey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "bearer": 2.0, "signature": 1.0, "salt": 1.0,
}
THRESHOLD, SHORTEST = 5.0, 6


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _parts.findall(name)]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:], strict=False))]), default=0.0)


class Part(NamedTuple):
    """A stretch of a value: a string, or a bare word, which may be a name."""

    name: str | None
    bare: bool
    start: int
    end: int


Pair = tuple[str, int, list[Part]]  # name, where its value starts, value


class Lexer:
    """The pairs of one text."""

    def __init__(self, text: str) -> None:
        self.text, self.run = text, (0, 0)

    def string(self, at: int) -> tuple[Part, int] | None:
        m = _string.match(self.text, at)
        return (Part(None, False, *m.span(m.lastindex)), m.end()) if m else None

    def word(self, at: int) -> tuple[Part, int] | None:
        """A bare word; those that start inside the last one end where that does."""
        start, end = self.run
        if not start <= at < end:
            m = _bare.match(self.text, at)
            if not m:
                return None
            self.run = at, m.end()
            end = m.end()
        m = _identifier.match(self.text, at, end)
        return Part(m[0] if m and m.end() == end else None, True, at, end), end

    def operands(self, at: int) -> list[Part]:
        """The parts of the sum that starts there."""
        glue, out, joined = _glue, [], True
        if self.text.startswith("(", at):
            glue, at = _wide, _wide.match(self.text, at + 1).end()
        while True:
            found = self.string(at)
            if not found and joined:
                found = self.word(at)
            if not found:
                return out
            out.append(found[0])
            m = glue.match(self.text, found[1])
            joined, at = m[1] is not None, m.end()
            if not joined and found[0].bare:
                return out

    def arguments(self, at: int) -> list[Part]:
        """The strings and words among a call's arguments, or a list's items; `at` is behind the bracket."""
        out: list[Part] = []
        while True:
            at = _comma.match(self.text, at).end()
            found = self.string(at) or self.word(at)
            if not found:
                return out
            out.append(found[0])
            at = found[1]

    def named(self, given: list[Part]) -> str | None:
        """The name that a call's first argument is, if others follow."""
        if len(given) > 1 and given[0].end > given[0].start:
            m = _identifier.match(self.text, given[0].start, given[0].end)
            return m[0] if m and m.end() == given[0].end else None
        return None

    def pairs(self) -> list[Pair]:
        text, out = self.text, []
        for m in _name.finditer(text):
            name, at = m[0], m.end()
            if text.startswith("(", at):
                given = self.arguments(at + 1)
                if first := self.named(given):
                    out.append((first, at, given[1:]))
                continue
            while sub := _subscript.match(text, at):
                name, at = sub[1], sub.end()
            sign = _sign.match(text, at)
            if not sign:
                continue
            at = sign.end()
            if sign[1] == ":" and (typed := _type.match(text, at)):
                at = typed.end()
            if text.startswith("[", at):
                out += [(name, p.start, [p]) for p in self.arguments(at + 1) if not p.bare]
                continue
            if called := _call.match(text, at):
                given = self.arguments(called.end())
                parts = given[1:] if self.named(given) else given
            else:
                parts = self.operands(at)
            if parts:
                out.append((name, at, parts))
        for pattern in (_element, _block) if "</" in text or "|" in text or ">" in text else ():
            for m in pattern.finditer(text):
                a, b = m.span(2 if pattern is _element else 3)
                while a < b and text[a].isspace():
                    a += 1
                while b > a and text[b - 1].isspace():
                    b -= 1
                if a < b:
                    out.append((m[1 if pattern is _element else 2], a, [Part(None, False, a, b)]))
        for m in _item.finditer(text) if "- " in text else ():
            found = self.string(m.end()) or self.word(m.end())
            if found and text[found[1] : found[1] + 1] in ("", "\n", "\r"):
                out.append(("", m.end(), [found[0]]))
        return out


def sensitive_regions(text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of what stands in the braces, the indented block or the section of a sensitive name."""
    out: list[tuple[int, int, float]] = []
    if "{" in text:
        stack: list[tuple[int, float]] = []
        for m in _opened.finditer(text):
            if m[0] != "}":
                stack.append((m.end(), sensitivity(m[1]) if m[1] else 0.0))
            elif stack:
                start, weight = stack.pop()
                if weight:
                    out.append((start, m.start(), weight))
    blocks: list[tuple[int, int, float]] = []  # open ones: column, start, weight
    for m in _line.finditer(text) if ":\n" in text or ": \n" in text or ":\r" in text else ():
        if m.end() == len(text) or text[m.end()] in "\r\n" and not m[3]:
            continue
        column = len(m[1])
        while blocks and (blocks[-1][0] > column or blocks[-1][0] == column and not m[2]):
            out.append((blocks[-1][1], m.start(), blocks[-1][2]))
            blocks.pop()
        if m[3] and (weight := sensitivity(m[3])):
            blocks.append((column + len(m[2] or ""), m.end(), weight))
    out += [(start, len(text), weight) for _, start, weight in blocks]
    heads = list(_section.finditer(text)) if "]" in text else []
    for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        if weight := sensitivity(m[1]):
            out.append((m.end(), end, weight))
    return out


def covering(regions: list[tuple[int, int, float]]) -> list[tuple[float, list[int], list[int]]]:
    """For each weight, strongest first, the starts and ends of the separate stretches that its regions cover."""
    out = []
    for weight in sorted({w for _, _, w in regions}, reverse=True):
        starts, ends = [], []
        for a, b in sorted((a, b) for a, b, w in regions if w == weight):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        out.append((weight, starts, ends))
    return out


def bits(counts: Counter) -> float:
    n = counts.total()
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def literals(text: str) -> list[tuple[int, int]]:
    """Where the literals stand that reach a sensitive name."""
    pairs = sorted(Lexer(text).pairs(), key=lambda p: p[1])
    given: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(pairs):
        if name:
            given.setdefault(name, []).append(i)
    used = [[p.name for p in parts if p.name in given] for _, _, parts in pairs]

    # how sensitive each pair is: by its name, by where it stands, and by the names that it reaches, strongest first
    covers, known = covering(sensitive_regions(text)), {name: sensitivity(name) for name in given}
    weights = []
    for name, at, _ in pairs:
        own = known.get(name, 0.0)
        for weight, starts, ends in covers:
            if weight <= own:
                break
            k = bisect_right(starts, at) - 1
            if k >= 0 and at < ends[k]:
                own = weight
        weights.append(own)
    if not any(weights):
        return []
    told: set[str] = set()
    for i in sorted((i for i, w in enumerate(weights) if w), key=lambda i: -weights[i]):
        weight, todo = weights[i], [i]
        while todo:
            j = todo.pop()
            weights[j] = max(weights[j], weight)
            for name in used[j]:
                if name not in told:
                    told.add(name)
                    todo += given[name]

    def random(counts: Counter, weight: float) -> bool:
        return counts.total() >= SHORTEST and weight + bits(counts) >= THRESHOLD

    def placeholder(a: int, b: int) -> bool:
        return text[a] == "$" or text[a : a + 4].lower() == "your" or text[a] + text[b - 1] in ("<>", "%%") or _placeholder.fullmatch(text, a, b) is not None

    left: dict[int, int] = {}  # where the first of the bare words begins that end there
    for _, _, parts in pairs:
        left.update((p.end, min(p.start, left.get(p.end, p.start))) for p in parts if p.bare)
    odd: dict[int, int] = {}

    def taken(part: Part) -> bool:
        """Whether a part can be a secret: no placeholder, and no bare word of letters alone."""
        if part.start == part.end or placeholder(part.start, part.end):
            return False
        if part.bare and part.end not in odd:
            odd[part.end] = max((m.start() for m in _odd.finditer(text, left[part.end], part.end)), default=-1)
        return not part.bare or odd[part.end] >= part.start

    ends: dict[int, tuple[int, Counter]] = {}

    def tally(a: int, b: int) -> Counter:
        """The characters there; asked for from the right to the left, each is counted once for an end."""
        start, counts = ends.get(b, (b, None))
        if a > start:
            return Counter(text[a:b])
        counts = Counter() if counts is None else counts
        counts.update(text[a:start])
        ends[b] = a, counts
        return counts

    found: set[tuple[int, int]] = set()
    own: dict[int, Counter] = {}  # what the literals of a pair come to, where a sum needs it
    wanted = {name for i, names in enumerate(used) if weights[i] for name in names}
    for i in range(len(pairs) - 1, -1, -1):
        name, _, parts = pairs[i]
        if not weights[i]:
            continue
        texts = [p for p in parts if p.name not in given]
        counts = [tally(p.start, p.end) for p in reversed(texts)]
        if used[i]:
            found.update((p.start, p.end) for p, c in zip(reversed(texts), counts) if taken(p) and random(c, weights[i]))
        elif len(parts) > 1 or taken(parts[0]):
            whole = counts[0] if len(counts) == 1 else sum(counts, Counter())
            if random(whole, weights[i]) and not (placeholder(parts[0].start, parts[-1].end) if parts[0].start < parts[-1].end else True):
                found.add((parts[0].start, parts[-1].end))
        if used[i] or name in wanted:
            own[i] = sum(counts, Counter())

    # sums of names with one assignment: their whole values
    value: dict[int, Counter | None] = {}
    for i in range(len(pairs)):
        todo = [i] if used[i] and weights[i] else []
        while todo:
            j = todo[-1]
            below = [given[n][0] if len(given[n]) == 1 else None for n in used[j]]
            if j not in value and None not in below:
                value[j] = None  # until it is known; a name that is given itself stays so
                todo += [k for k in below if k not in value]
                continue
            todo.pop()
            if None not in below and all(k in value or not used[k] for k in below) and value.get(j) is None:
                sums = [value[k] if used[k] else own.get(k) for k in below]
                if None not in sums:
                    value[j] = sums[0] if len(sums) == 1 and not own[j] else sum(sums, own[j].copy())
            value.setdefault(j, None)
    marked: set[int] = set()
    for i, counts in value.items():
        if counts is None or i in marked or not random(counts, weights[i]):
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j in marked:
                continue
            marked.add(j)
            parts = pairs[j][2]
            todo += [given[n][0] for n in used[j]]
            if used[j]:
                found.update((p.start, p.end) for p in parts if p.name not in given and taken(p))
            elif len(parts) > 1 or taken(parts[0]):
                found.add((parts[0].start, parts[-1].end))
    return sorted(found)


def find(text: str | None) -> list[spans.Span]:
    if not text:
        return []
    found: list[spans.Span] = []
    if ":" in text or "=" in text or "</" in text or '("' in text or "('" in text:
        found += [(m.start(), 0, "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= SHORTEST]
        starts, stops = [s for s, _, _, _ in found], [e for _, _, _, e in found]
        for a, b in literals(text):
            k = bisect_right(starts, a) - 1
            if k < 0 or stops[k] < b:
                found.append((a, 3, "literal", b))
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in _hex.finditer(text)]
    return found


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `secrets`: struct of kinds, starts and ends."""

    @F.pandas_udf(spans.TYPE)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(spans.columns([find(t) for t in texts]))

    return df.withColumn("secrets", scanned(F.col(f"`{text}`")))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each finding of a text replaced by its kind in angle brackets; null texts stay null."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = spans.columns([find(t)])
            out.append(t if not t else spans.replaced(t, found["kinds"][0], found["starts"][0], found["ends"][0]))
        return pd.Series(out, dtype=object)

    return df.withColumn(text, redacted(F.col(f"`{text}`")))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Findings in every whole text of documents."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    counts = [spans.count("secrets", k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(spans.joined("secrets", BASE), 256).alias("base_sha256"), spans.joined("secrets").alias("spans"))
