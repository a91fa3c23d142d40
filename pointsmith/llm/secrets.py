"""Secret scans: base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer reads `name = value`, `name: value`, `"name": "value"`, `name => value`, `name := value`, `<name>value</name>`
and `export NAME=value` into (name, literal) pairs. Values are strings in quotes, with escapes, over several lines in
triple quotes or backticks; YAML blocks after `|` or `>`; strings joined by `+` or side by side; and bare words of any
characters up to white space, brackets or commas. Names are split into words at case changes, underscores, dots and
dashes. Constants are propagated in either direction: `a = "x"` gives the literal x the name password if `password = a`
(or `$a`, `${a}`) stands anywhere in the text, through chains of names. A literal is a secret when one of its names is a
sensitive target and it looks random enough for how telling that name is; quoted literals with blanks count as phrases
by their words. The literals found are added to the base spans as kind `literal`.

Defined results: null and empty texts have no spans; base spans stay as they are; a literal within a base span is not
given again; repeated rows each get their own result; other columns are not looked at. Texts are scanned whole, and
names and literals of any length count, in time proportional to the text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .common import id_text, map_arrow

#: The base patterns. Letters of the names in either case, ASCII only.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: How telling a word of a target's name is; a literal needs that much less randomness.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 0.9, "token": 0.8, "apikey": 0.9, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.4}
_JOINED = ("apikey", "privatekey", "accesskey")

_HEAD = re.compile(r"""(?<![A-Za-z0-9_.\-$])["']?([A-Za-z_][A-Za-z0-9_.\-]*+)["']?[ \t]*+(:=|=>|=(?![=~])|:(?![:/]))[ \t]*+""", re.A)
_XML = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?>([^<>]++)</", re.A)
_TRIPLE = re.compile(r'"""((?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'((?:[^\'\\]|\\.|\'(?!\'\'))*+)\'\'\'', re.S)
_STRING = re.compile(r'"((?:[^"\\\n]|\\.)*+)"|\'((?:[^\'\\\n]|\\.)*+)\'|`([^`]*+)`', re.S)
_JOINT = re.compile(r"[ \t]*+(?:\+|\\)?[ \t]*+(?:\\?\n[ \t]*+(?=[+\"']))?(?:\+[ \t]*+)?")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*+\n")
_BARE = re.compile(r"[^\s,;(){}\[\]<>\"'`]++")
_TAIL = ".,;:!?"
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """How sensitive a target of this name is, 0 to 1."""
    parts = [p.lower() for p in _SPLIT.findall(name)]
    joined = "".join(parts)
    return max([SENSITIVE.get(p, 0.0) for p in parts] + [SENSITIVE[j] for j in _JOINED if j in joined], default=0.0)


def literal_score(value: str, quoted: bool = True) -> float:
    """How random a literal looks, 0 to 1: bits in it against 64, lowered if it has one class of characters only.

    A quoted literal with blanks is a phrase: 12 bits a different word of three letters or more, so four make up a half;
    a bare one is none.
    """
    n = len(value)
    if n < 8:
        return 0.0
    if re.search(r"\s", value.strip()):
        lines = value.split("\n")
        if len(lines) > 1 and not any(re.search(r"\s", x.strip()) for x in lines):  # lines of one key
            return literal_score("".join(value.split()))
        words = {w for w in value.split() if len(w) >= 3}
        return min(0.75, 12 * len(words) / 64) if quoted and 3 <= len(words) <= 12 else 0.0
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, bits / 64) * (0.4 if classes < 2 else 1.0)


def _block(text: str, key_at: int, at: int) -> tuple[int, int]:
    """The lines from `at` on that are indented deeper than the line of the key: where their content begins and ends."""
    line = text.rfind("\n", 0, key_at) + 1
    indent = len(text[line:key_at]) - len(text[line:key_at].lstrip(" "))
    first = end = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        own = text[at:stop]
        if own.strip():
            if len(own) - len(own.lstrip(" ")) <= indent:
                break
            if end == first:
                first = at + len(own) - len(own.lstrip(" "))
            end = stop
        at = stop + 1
    return first, end


def _value(text: str, key_at: int, op: str, at: int) -> tuple[list[tuple[int, int, bool]], str | None, int]:
    """The literal's parts (start, end, quoted), the name it refers to, and where the value ends."""
    if op == ":" and (m := _BLOCK.match(text, at)):
        start, end = _block(text, key_at, m.end())
        return ([(start, end, True)] if end > start else []), None, end
    parts: list[tuple[int, int, bool]] = []
    while m := _TRIPLE.match(text, at) or _STRING.match(text, at):
        parts.append((*m.span(m.lastindex), True))
        at = _JOINT.match(text, m.end()).end()
    if parts:
        return parts, None, m.end() if m else parts[-1][1] + 1
    if m := _BARE.match(text, at):
        end = m.end() - (len(m[0]) - len(m[0].rstrip(_TAIL)))
        word = text[at:end]
        if re.fullmatch(r"\$\{?[A-Za-z_][A-Za-z0-9_.\-]*\}?", word) or word == "$":
            inner = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_.\-]*+)").match(text, at)
            return [], inner[1] if inner else None, m.end()
        if text[m.end() : m.end() + 1] == "(":  # a call
            return [], None, m.end()
        return [(at, end, False)], word, m.end()
    return [], None, at + 1


def literals(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, value, start, end, quoted) of each assigned literal: for its own name, and for the most telling name that
    takes it, through chains of names, if that is another."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    own: dict[str, list[tuple[str, list[tuple[int, int, bool]]]]] = {}
    refs: dict[str, set[str]] = {}
    at = 0
    while m := _HEAD.search(text, at):
        parts, ref, end = _value(text, m.start(1), m[2], m.end())
        if ref is not None and ref != m[1]:
            refs.setdefault(m[1], set()).add(ref)
        if parts := [p for p in parts if p[1] > p[0]]:
            own.setdefault(m[1], []).append(("".join(text[s:e] for s, e, _ in parts), parts))
        at = max(end, m.end())
    if "</" in text:
        for m in _XML.finditer(text):
            own.setdefault(m[1], []).append((m[2], [(m.start(2), m.end(2), True)]))
    # Down from the most telling names, each name once: the first that comes by is the best that takes it.
    best: dict[str, str] = {}
    for name in sorted({*own, *refs}, key=lambda n: (-name_score(n), n)):
        if not name_score(name):
            break
        open_ = [name]
        while open_:
            n = open_.pop()
            if n not in best:
                best[n] = name
                open_ += refs.get(n, ())
    out = []
    for name, values in own.items():
        for value, parts in values:
            # A bare word that is itself a name with values stands for those, not for itself.
            if len(parts) == 1 and not parts[0][2] and value in own:
                continue
            out += [(n, value, s, e, q) for n in dict.fromkeys((name, best.get(name, name))) for s, e, q in parts]
    return out


def secret_spans(text: str, threshold: float = 0.45) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    starts = [a for a, _, _ in base]
    most = list(accumulate((b for _, _, b in base), max))
    found = set()
    for name, value, start, end, quoted in literals(text):
        if (s := name_score(name)) and s * literal_score(value, quoted) >= threshold * min(1.0, s + 0.2):
            i = bisect_right(starts, start)
            if not (i and most[i - 1] >= end):  # not within a base span
                found.add((start, 3, end))
    return base, sorted([*base, *found])


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                out = []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    base, spans = secret_spans(text or "")
                    n = Counter(k for _, k, _ in base)
                    out.append((n[0], n[1], n[2], hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
