"""Secret scan by assignment-aware lexing.

Source and configuration text is parsed into name-literal pairs (``name = "literal"``,
``name: literal``, ``"name": "literal"``, ``NAME=literal``, ``name := literal``, joined with ``+``).
A literal given to a plain name becomes that name's constant; a later use of the name, or of several
joined with ``+``, stands for the constant's literals.  Each literal is scored by how sensitive its
*target* name is and by how much it looks like key material; from ``THRESHOLD`` on it is reported:

* ``literal``: written at the sensitive name itself, outside every base span;
* ``const``: written at a harmless name whose constant reaches a sensitive name.

Next to these stand the base patterns ``assign``, ``access`` and ``hex``, whose matches always stay.

Defined cases: NULL is an empty text and yields no span.  A text is scanned whole, however long, one
row at a time, so memory follows the longest text.  Positions are code points, ends are exclusive.
Constants live within one text; a name assigned again takes the last literal before its use.
Repeated rows each give their own result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm import words
from veritable.llm.common import by_place, documents

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "literal", "const")

#: Parts of names, and how sensitive a name with that part is.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "auth": 0.7,
    "authorization": 0.8,
    "bearer": 0.8,
}
#: Pairs of neighbouring parts.
SENSITIVE_PAIRS = {"api": 1.0, "access": 0.9, "private": 1.0, "encryption": 1.0, "signing": 1.0, "auth": 0.9}
THRESHOLD = 0.6
#: Every sensitive name holds one of these, so a text without them has no pair to score.
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: A type between a name and its value, as in ``name: list[str] | None = value``.
_TYPE = r"[A-Za-z_][A-Za-z0-9_.]*(?:\[[A-Za-z0-9_., \t|\[\]]*\])?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*)*"
_PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])["']?({_NAME})["']?(?:[ \t]*:[ \t]*{_TYPE}(?=[ \t]*=(?!=)))?[ \t]*(?::=|=>|=|:)(?!=|//)[ \t]*""", re.A
)
_ATOM = re.compile(rf"({_QUOTED})|([A-Za-z0-9+/_.=\-]+)", re.A)
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Names as constants have them: upper case, or words joined by underscores.
_CONSTANT_NAME = re.compile(r"(?:[A-Z_][A-Z0-9_]*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+)\Z", re.A)
_PLAIN_NAME = re.compile(rf"{_NAME}\Z", re.A)
_DULL = re.compile(r"(?i)(?:example|changeme|placeholder|your[_-]|xxxx|todo|null|none|true|false|test)")


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    for a, b in zip(parts, parts[1:]):
        if b == "key":
            best = max(best, SENSITIVE_PAIRS.get(a, 0.0))
    return best


def literal_weight(text: str) -> float:
    """How much a literal looks like key material, 0 to 1: length, variety, mixed character kinds."""
    n = len(text)
    if n < 8 or _DULL.search(text) or any(c.isspace() for c in text):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
    kinds = sum(bool(re.search(p, text)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    if kinds < 2:
        return 0.0
    return min(1.0, 0.3 + 0.2 * min(1, n / 20) + 0.3 * min(1, bits / 3.5) + 0.2 * (kinds - 1) / 2)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    # A run of at least 16 is a whole leftmost match of the base pattern: the runs are maximal.
    found += [(*m.span(), "hex") for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Each assignment's name and the atoms joined by ``+`` on its right: start, end, quoted."""
    for m in _PAIR.finditer(text):
        at, atoms = m.end(), []
        while atom := _ATOM.match(text, at):
            lo, hi = atom.span()
            quoted = atom[1] is not None
            if not quoted and hi - lo > 1 and text[hi - 1] == "+" and text[hi : hi + 1] in ('"', "'"):
                hi -= 1  # name+"literal"
            atoms.append((lo + 1, hi - 1, True) if quoted else (lo, hi, False))
            joined = _PLUS.match(text, hi)
            if not joined:
                break
            at = joined.end()
        if atoms:
            yield m[1], atoms


def operands(text: str, lo: int, hi: int, constants: dict) -> list[tuple[int, int]]:
    """An unquoted atom, or the operands of the ``+`` in it where these are constants or the names of such."""
    parts = text[lo:hi].split("+")
    if len(parts) == 1 or not (any(p in constants for p in parts) or all(_CONSTANT_NAME.match(p) for p in parts)):
        return [(lo, hi)]
    out = []
    for p in parts:
        out.append((lo, lo + len(p)))
        lo += len(p) + 1
    return out


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """What the lexer finds: literals that reach a sensitive name."""
    lowered = text.lower()
    if not any(s in lowered for s in STEMS) or not (":" in text or "=" in text):
        return []
    constants: dict[str, list[tuple[int, int]]] = {}
    found: set[tuple[int, int, str]] = set()
    for name, atoms in pairs(text):
        own: list[tuple[int, int, str]] = []
        for start, end, quoted in atoms:
            split = [(start, end)] if quoted else operands(text, start, end, constants)
            for lo, hi in split:
                if not quoted and text[lo:hi] in constants:
                    own += [(a, b, "const") for a, b in constants[text[lo:hi]]]
                elif quoted or hi - lo >= 8 and len(split) == 1:
                    own.append((lo, hi, "literal"))
        weight = name_weight(name)
        whole = "".join(text[a:b] for a, b, _ in own)
        if weight and weight * literal_weight(whole) >= THRESHOLD:
            found.update(own)
        if own and _PLAIN_NAME.match(name):
            constants[name] = [(a, b) for a, b, _ in own]
        else:
            constants.pop(name, None)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the lexer's spans that no base span holds already."""
    text = text or ""
    base = base_spans(text)
    more, at = [], 0
    if extra := lexed_spans(text):
        reach = []  # the furthest end of the base spans up to each
        for a, b, _ in base:
            reach.append(max(b, reach[-1]) if reach else b)
        for span in extra:
            while at < len(base) and base[at][0] <= span[0]:
                at += 1
            if not at or reach[at - 1] < span[1]:
                more.append(span)
    return base, more


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with every found span, overlapping ones as one, replaced by ``mark``."""
    if text is None:
        return None
    base, more = scan(text)
    out, at = [], 0
    for a, b, _ in sorted(base + more):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: the counts, the digest and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            rows = []
            for text in piece.column("text").to_pylist():
                base, more = scan(text)
                n = Counter(kind for *_, kind in base)
                everything = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], digest, joined(everything), len(more)))
            cells = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in cells[:3]),
                    *(pa.array(c, pa.string()) for c in cells[3:5]),
                    pa.array(cells[5], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"],
            )

    return documents(docs, "doc_id", "text").mapInArrow(
        run,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lexed bigint",
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with secrets masked in ``text``, and ``n_chars`` (if there) counted again; every row stays."""
    at, names = docs.columns.index("text"), docs.columns
    docs = by_place(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches, column=at):
            masked = pa.array([redact(t, mark) for t in piece.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [masked if i == at else piece.column(i) for i in range(piece.num_columns)], piece.schema.names
            )

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        n = f"c{names.index('n_chars')}"
        counted = F.length(f"c{at}").cast(docs.schema[n].dataType)
        out = out.withColumn(n, F.coalesce(counted, F.col(n)))
    return out.toDF(*names)
