"""Secret scans: base patterns, and assignments lexed into name-literal pairs with constants propagated."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, quoted, unpacked

# The base patterns, the characters they need and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "literal")

# One assignment: a name (bare, quoted, dotted or the key in brackets), a type where one is stated, an operator, and what
# follows it. A type after a colon counts as one only if a quoted value comes next.
TARGET = re.compile(
    r"""(?<![\w.$-])(?P<quote>["'`]?)(?P<name>[A-Za-z_$][\w.$-]*+)(?P=quote)(?:\[\s*["'](?P<key>[^"'\]\n]++)["']\s*\])?"""
    r"""(?:[ \t]++string\b(?=[ \t]*+:?=))?[ \t]*+"""
    r"""(?:\??:[ \t]*+[A-Za-z_][\w.]*+(?:\[[^\]\n"']{0,60}\]|<[^>\n"']{0,60}>)?(?:[ \t]*+\|[ \t]*+\w++){0,4}[ \t]++=[ \t]*+(?=["'`])"""
    r"""|:=|=>|=(?![=~>])|:(?![/:=]))[ \t]*+"""
)
# A bare value ends before "&", and before "=" unless that pads its end: what follows is another assignment's.
TERM = re.compile(
    r"""(?P<string>"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<back>[^`\n]*+)`)"""
    r"""|(?P<bare>[A-Za-z0-9_$+/.~@%^*!-]++=*+)"""
)
# A quoted value may follow on the next line, in brackets or after a line's end mark.
NEXT_LINE = re.compile(r"""[ \t]*+[(\\]?[ \t]*+\r?\n[ \t]*+(?=["'`])""")
# Names and literals that stand side by side: attributes of one tag, and arguments of one call that defines something.
ATTRIBUTES = re.compile(
    r"""\b(?:key|name|id)[ \t]*+=[ \t]*+["'](?P<name>[\w.$:-]++)["'][^<>\n]{0,200}?\bvalue[ \t]*+=[ \t]*+(?P<mark>["'])(?P<value>[^"'\n]*+)(?P=mark)"""
)
ARGUMENTS = re.compile(
    r"""\b(?P<call>\w++)\([ \t]*+["'](?P<name>[\w.$:-]++)["'][ \t]*+,[ \t]*+(?P<mark>["'])(?P<value>[^"'\n]*+)(?P=mark)"""
)
DEFINES = re.compile(r"define|env|environ|put|set|property|default|option", re.I)
PLUS = re.compile(r"[ \t]*+(?:\+|\.\.|~)[ \t]*+(?=[\"'`A-Za-z_$])")
NAME = re.compile(r"[A-Za-z_$][\w.$-]*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|0+|1234567\d*|none|null|true|false|example\w*|changeme|your\w*|todo|test|dummy|\$\{?\w+\}?|%\w+%|<\w+>)$")

# Weights of the words in a target's name; a pair counts where both words are there.
NAME_WEIGHTS = {
    ("password",): 3.0, ("passwd",): 3.0, ("passphrase",): 3.0, ("pwd",): 3.0, ("secret",): 3.0, ("token",): 3.0, ("apikey",): 3.0,
    ("credential",): 2.5, ("credentials",): 2.5, ("bearer",): 2.5, ("pass",): 2.0, ("auth",): 1.5, ("authorization",): 2.5,
    ("api", "key"): 3.0, ("access", "key"): 3.0, ("private", "key"): 3.0, ("signing", "key"): 3.0, ("encryption", "key"): 3.0,
}
THRESHOLD = 5.0
# Characters of a value that are kept as text, and characters that are counted one by one.
HEAD, MOST_COUNTED = 256, 1e12


@lru_cache(1 << 16)
def name_score(name: str) -> float:
    words = {p.lower() for p in PARTS.findall(name)}
    return max((w for need, w in NAME_WEIGHTS.items() if words.issuperset(need)), default=0.0)


class Value:
    """What a score needs of a string: how often each character occurs, and its beginning. Constants that are joined to each
    other again and again add up their counts, never their text; counts above MOST_COUNTED are kept in proportion. A value
    without constants is counted when it is first asked for."""

    __slots__ = ("parts", "start", "stop", "_counts", "_length", "_head")

    def __init__(self, parts: list[str | Value], start: int, stop: int) -> None:
        self.parts, self.start, self.stop, self._counts = parts, start, stop, None
        if any(isinstance(p, Value) for p in parts):
            self._count()

    def _count(self) -> None:
        counts: Counter = Counter()
        length, head = 0.0, ""
        for part in self.parts:
            own = part if isinstance(part, Value) else None
            counts.update(own.counts if own else part)
            length += own.length if own else len(part)
            if len(head) <= HEAD:
                head += own.head if own else part[: HEAD + 1]
        if length > MOST_COUNTED:
            counts, length = {c: n * MOST_COUNTED / length for c, n in counts.items()}, MOST_COUNTED
        self._counts, self._length, self._head, self.parts = counts, length, head[: HEAD + 1], []

    @property
    def counts(self) -> dict[str, float]:
        if self._counts is None:
            self._count()
        return self._counts

    @property
    def length(self) -> float:
        return self._length if self.counts is not None else 0.0

    @property
    def head(self) -> str:
        return self._head if self.counts is not None else ""

    @property
    def placeholder(self) -> bool:
        """Whether it stands for a value; beyond HEAD characters only repeats of one sign do."""
        if self.length <= HEAD:
            return PLACEHOLDER.match(self.head) is not None
        return any(set(self.counts) <= set(same) for same in ("xX", "*", ".", "0"))


def literal_score(value: Value) -> float:
    if value.length < 6 or value.placeholder:
        return 0.0
    entropy = -sum(n / value.length * math.log2(n / value.length) for n in value.counts.values() if n > 0)
    mixed = any(c.isdigit() for c in value.counts) and any(c.isalpha() for c in value.counts)
    score = 1.0 + (entropy >= 2.5) + (entropy >= 3.2) + mixed + (value.length >= 16)
    return score - 2.0 * any(c.isspace() for c in value.counts)


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the lines with an assignment character."""
    at, n = 0, len(text)
    while at < n:
        nearest = [i for i in (text.find("=", at), text.find(":", at)) if i >= 0]
        if not nearest:
            return
        start = text.rfind("\n", at, min(nearest)) + 1 or at
        end = text.find("\n", min(nearest))
        end = n if end < 0 else end
        yield start, end
        at = end + 1


def _triple(text: str, at: int) -> tuple[int, int] | None:
    """Bounds of what stands between triple quotes at a place."""
    mark = text[at : at + 3]
    if mark not in ('"""', "'''"):
        return None
    end = text.find(mark, at + 3)
    return (at + 3, end) if end >= 0 else None


def _value(text: str, at: int, end: int, known: dict[str, Value]) -> Value | None:
    """The right side at a place, with the span that states it. That is where its own literals stand, or where the constant
    it names was given its literal."""
    parts: list[str | Value] = []
    own: list[tuple[int, int]] = []
    named = None
    if over := NEXT_LINE.match(text, at):
        at = over.end()
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
    if triple := _triple(text, at):
        return Value([text[slice(*triple)]], *triple)
    while (m := TERM.match(text, at, end)) is not None:
        kind = m.lastgroup if m.lastgroup == "bare" else next(g for g in ("double", "single", "back") if m[g] is not None)
        part = m[kind]
        if kind == "bare" and part in known:
            named = known[part]
            parts.append(named)
        elif kind == "bare" and parts and NAME.fullmatch(part):
            break
        else:
            own.append(m.span(kind))
            parts.append(part)
        plus = PLUS.match(text, m.end(), end)
        if plus is None:
            break
        at = plus.end()
    if not parts:
        return None
    start, stop = (own[0][0], own[-1][1]) if own else (named.start, named.stop)
    return Value(parts, start, stop)


def literal_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that sensitive targets get, directly or through constants."""
    known: dict[str, Value] = {}
    found: dict[tuple[int, int], tuple[str, float]] = {}

    def given(name: str, value: Value) -> None:
        known[name] = value
        weight, looks = name_score(name), 0.0
        if weight > 0 and value.start <= value.stop:
            looks = literal_score(value)
        span = (value.start, value.stop)
        if looks > 0 and weight + looks >= THRESHOLD and weight + looks > found.get(span, ("", 0.0))[1]:
            found[span] = (name, weight + looks)

    for start, end in _lines(text):
        at = start
        while (m := TARGET.search(text, at, end)) is not None:
            at = m.end()
            value = _value(text, at, end, known)
            if value is not None:
                given(m["key"] or m["name"], value)
    pairs = list(ATTRIBUTES.finditer(text)) if "value" in text else []
    if '("' in text or "('" in text or "( " in text:
        pairs += [m for m in ARGUMENTS.finditer(text) if DEFINES.search(m["call"])]
    for m in pairs:
        given(m["name"], Value([m["value"]], *m.span("value")))
    return [(a, b, name, score) for (a, b), (name, score) in found.items()]


def scan_text(text: str | None) -> dict:
    text = text or ""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    count = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
    literals = literal_spans(text)
    every = sorted(spans + [(a, 3, b) for a, b, _, _ in literals])
    said = lambda rows: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)
    return {
        "n_assign": count[0],
        "n_access": count[1],
        "n_hex": count[2],
        "base_sha256": hashlib.sha256(said(sorted(spans)).encode()).hexdigest(),
        "spans": said(every),
        "literals": [{"start": a, "end": b, "name": n, "score": s} for a, b, n, s in sorted(literals)],
    }


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, literals array<struct<start: long, end: long, name: string, score: double>>"


def scan_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row with the counts of the base kinds, base_sha256, spans (kind:start:end by start, code points, end
    exclusive) and literals, the name-literal pairs that the lexer adds, with target names and scores.

    Lines with an assignment are lexed into targets and values: quoted strings, bare values and their concatenation. A
    target may state a type; a quoted value may follow on the next line or go over lines in triple quotes. Names and
    literals in attributes of a tag (key, value) and in arguments of a defining call are pairs too. A name that was given a
    literal stands for it in later values, so a secret is found where its text is, also if the sensitive name only gets it
    by reference. A literal counts if the words of the name and the look of the literal together reach THRESHOLD. Joined
    constants are scored from their character counts, so no text is built up; of a value longer than HEAD characters only
    repeats of one sign are a placeholder.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty result; columns
    named as a result's are replaced. Whole texts are scanned, whatever their length.
    """

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([scan_text(t) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "literals"])

    names = docs.columns
    rows = docs.select(packed(docs), found(quoted(text)).alias("_found"))
    new = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "literals")
    return unpacked(rows, names, {c: F.col("_found").getField(c) for c in new})
