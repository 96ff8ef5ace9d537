"""Secret scan with assignment-aware lexing (operator 4).

*Base spans* are the contract's three patterns, over the whole text.  Then the text
is lexed as source or configuration: name-literal pairs are read from assignments,
keyword arguments, mappings, attributes and elements (``name = "x"``, ``name: x``,
``"name": "x"``, ``name := 'x'``, ``name => "x"``, ``<name>x</name>``), concatenations
over several lines included.  A value, quoted or not, goes on by reference to the names
that its name is assigned to, also as ``$NAME`` or ``${NAME}``; a later value replaces
it.  Whole-value templates (``${..}``, ``<..>``, ``{{..}}``, ``%..%``) are no literals;
``$NAME`` of a name without a value is one.  A literal's score is the sensitivity of the most telling name it reaches times
how much like a secret it looks; at or over ``THRESHOLD`` it is a span.

Each row is scanned for itself, so nothing is shuffled.  Defined results: a null text
is empty; repeated rows each get their row; null ids stay null; an empty table gives
no rows; prose without an assignment gets no spans from the lexer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices
from .registry import register

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
#: Characters of a value that tell a placeholder, and the length from which only the
#: shares of its characters are kept.
HEAD, LONG = 16, 1e12

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs with the length asked for.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How much a part of a target name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "token": 0.9, "auth": 0.7, "bearer": 0.8, "signature": 0.6,
             "salt": 0.6, "key": 0.6, "private": 0.5, "pin": 0.5, "cert": 0.5}
#: Literals that stand for a value.
PLACEHOLDER = re.compile(r"(?i)(x+|\*+|\.+|your.*|change.?me.*|example.*|placeholder|none|null|true|false|todo|test)\Z")
TEMPLATE = re.compile(r"\$\{[^{}]*\}|<[^<>]*>|\{\{[^{}]*\}\}|%[^%]*%")

_NAME = r"[A-Za-z_][\w.\-]*"
STATEMENT = re.compile(
    rf"(?<![\w.\-])(?:(?P<q>[\"'])(?P<key>{_NAME})(?P=q)|(?P<name>{_NAME}))[ \t]*"
    rf"(?::[ \t]*[A-Za-z_][\w.<>\[\]]{{0,60}}[ \t]*=(?![=>])|:=|=>|=(?![=>~])|:(?![:/]))[ \t]*(?P<open>\(\s*)?(?=[\"'`\w$+/.\-])", re.A)
ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<\n]+)</(?P=name)>", re.A)
LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
WORD = re.compile(_NAME + r"\b(?![$@%&*!?/\\^~])", re.A)
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))", re.A)
BARE = re.compile(r"[^\s,;:=\"'`(){}\[\]<>#]+={0,2}")
#: An operator joins over the line end behind it, and over one before it if a quote follows.
_OPERATOR = r"(?:\+|\.\.|\|\|)\s*"
JOIN = re.compile(rf"[ \t]*{_OPERATOR}|\s*{_OPERATOR}(?=[\"'`])|[ \t]*(?:[ \t]|\\\r?\n)[ \t]*(?=[\"'])")
JOIN_OPEN = re.compile(rf"{JOIN.pattern}|\s+(?=[\"'])")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)

Piece = tuple[int, int, str, bool]  # start, end, value, quoted


@dataclass
class Profile:
    """What the score of a value needs: length, characters and how it begins.  Those
    beyond Latin-1 are counted in 768 classes, so that a profile stays small."""

    n: float
    counts: Counter
    spaced: bool
    head: str
    quoted: bool


class Value:
    """Literals and references to earlier values that an expression joins."""

    __slots__ = ("parts", "_profile")

    def __init__(self, parts: list[Piece | Value]):
        self.parts, self._profile = parts, None
        if any(isinstance(p, Value) for p in parts):
            self._profile = profile(parts)  # while the values it refers to have theirs

    def profile(self) -> Profile:
        if self._profile is None:
            self._profile = profile(self.parts)
        return self._profile

    def replaced(self) -> None:
        """No later expression can refer to this value."""
        self._profile = None


def profile(parts: list[Piece | Value]) -> Profile:
    out, times = Profile(0, Counter(), False, "", False), {}
    if len(parts) == 1 and isinstance(parts[0], Value):
        return parts[0].profile()
    for p in parts:
        if isinstance(p, Value):
            q = p.profile()
            times.setdefault(id(q), [q, 0])[1] += 1
            head = q.head
        else:
            value, head = p[2], p[2][:HEAD]
            out.n += len(value)
            out.counts.update(value if value.isascii() else (c if ord(c) < 256 else ord(c) % 768 for c in value))
            out.spaced |= any(c.isspace() for c in value)
            out.quoted |= p[3]
        if len(out.head) < HEAD:
            out.head = (out.head + head)[:HEAD]
    for q, k in times.values():
        out.n += k * q.n
        for c, v in q.counts.items():
            out.counts[c] += k * v
        out.spaced |= q.spaced
        out.quoted |= q.quoted
    if out.n > LONG:
        out.counts = Counter({c: v / out.n * LONG for c, v in out.counts.items()})
        out.n = LONG
    return out


def sensitivity(name: str) -> float:
    """Of a name in any of the usual spellings (snake, kebab, camel, dotted)."""
    parts = [p.lower() for p in PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


def placeholder(p: Profile) -> bool:
    one = {str(c).lower() for c in p.counts}
    return len(one) == 1 and one <= {"x", "*", "."} or (
        (m := PLACEHOLDER.match(p.head)) is not None and (p.n <= HEAD or m[1].lower().startswith(("your", "change", "example"))))


def plausibility(p: Profile) -> float:
    """How much a value looks like a secret: length and variety, no white space.
    A bare word must mix letters with digits."""
    if p.n < 6 or p.spaced or placeholder(p):
        return 0.0
    if not p.quoted:
        plain = [c if isinstance(c, str) else "" for c in p.counts]
        letters = any(c.isalpha() for c in plain) or "" in plain
        if not (letters and any(c.isdigit() for c in plain)):
            return 0.0
    bits = -sum(s * math.log2(s) for c in p.counts.values() if (s := c / p.n))
    return min(1.0, p.n / 8) * min(1.0, bits / 2.5)


def _literal(piece: Piece, known: dict[str, Value], refers: bool) -> list[Piece | Value]:
    """A literal and the known names that it holds as ``$NAME`` or ``${NAME}``."""
    refs = [m for m in REFERENCE.finditer(piece[2]) if (m[1] or m[2]) in known] if refers and "$" in piece[2] else []
    found: list[Piece | Value] = [known[m[1] or m[2]] for m in refs]
    whole = len(refs) == 1 and refs[0].span() == (0, len(piece[2]))
    return found if whole or TEMPLATE.fullmatch(piece[2]) else [piece, *found]


def _value(text: str, at: int, known: dict[str, Value], join: re.Pattern = JOIN) -> list[Piece | Value]:
    """Literals and earlier values that the expression at a place is made of."""
    out: list[Piece | Value] = []
    first = True
    while True:
        m = LITERAL.match(text, at)
        if m:
            k = m.lastindex or 0
            out += _literal((m.start(k), m.end(k), m[k], True), known, text[at] != "'")
        elif (m := REFERENCE.match(text, at)) and ((m[1] or m[2]) in known or m[1]):
            out += [known[m[1] or m[2]]] if (m[1] or m[2]) in known else []
        elif (m := WORD.match(text, at)) and m[0] in known:
            out.append(known[m[0]])
        elif not first:
            return out
        else:
            m = BARE.match(text, at)
            if not m:
                return out
            value = m[0].rstrip(".,:")
            out += _literal((at, at + len(value), value, False), known, True)
        more = join.match(text, m.end())
        if not more:
            return out
        at, first = more.end(), False


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """Names with their values in order; a name means its last value."""
    known: dict[str, Value] = {}
    if "=" in text or ":" in text:
        for m in STATEMENT.finditer(text):
            found = _value(text, m.end(), known, JOIN_OPEN if m["open"] else JOIN)
            name = m["key"] or m["name"]
            value = Value(found)
            if name in known:
                known.pop(name).replaced()
            if found:
                known[name] = value
                yield name, value
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if not TEMPLATE.fullmatch(m["value"]):
                yield m["name"], Value([(m.start("value"), m.end("value"), m["value"], True)])


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Places of the literals that reach a sensitive name; each value is walked once."""
    found, seen = set(), set()
    for name, value in pairs(text):
        weight = sensitivity(name)
        if weight < threshold or weight * plausibility(value.profile()) < threshold:
            continue
        todo = [value]
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for p in at.parts:
                if isinstance(p, Value):
                    todo.append(p)
                elif p[2]:
                    found.add(p[:2])
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans`` of every row: structs start, kind (place in ``KINDS``), end,
    in code points, by start and kind."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                found = base_spans(text) + [(a, 3, e) for a, e in literal_spans(text, threshold)]
                out.append([{"start": a, "kind": k, "end": e} for a, k, e in sorted(found)])
            yield pa.record_batch([b.column(0), pa.array(out, spans)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, spans array<struct<start:bigint,kind:int,end:bigint>>")


@register("op4_assignment_secrets")
def op4_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = scan(documents(spark, sf_dir))
    kind = F.array(*map(F.lit, KINDS))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(
        ":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
