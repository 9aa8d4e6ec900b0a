"""Secret scans by assignment-aware lexing.

Besides three fixed patterns, each line that holds an assignment is read as a
sequence of name-literal pairs, as source code and configuration files write
them. Names that take their value from another name, from joined pieces or
from a ${reference} inherit the literal, so that a literal counts for every
name it reaches. It is scored by how sensitive those names are and by how much
its characters look drawn at random; spans that score enough have kind `lex`.

Defined cases: a null text is empty and has no spans; a span counts code
points, its end is exclusive; a literal that is reached by several sensitive
names is one span; rows are handled one by one, so repeats are found alike.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import by_batch, fresh, text_of

KINDS = ("assign", "access", "hex", "lex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace(
    "password|passwd|secret|token|api_?key", "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"))
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: One assignment: a name, an operator, and what stands to its right.
NAME = re.compile(r"""(?<![\w.$-])([A-Za-z_][\w.-]*+)["'\]]*+[ \t]*+(?::=|=>|[:=](?!=))[ \t]*+""")
#: Operands of the right side: quoted pieces, references, bare words.
PIECE = re.compile(r"""[rbfuRBFU]?"((?:[^"\\\n]|\\.)*+)"|[rbfuRBFU]?'((?:[^'\\\n]|\\.)*+)'|\$\{?([A-Za-z_][\w.]*+)\}?|([^\s"'+,;(){}\[\]<>|&#]++)""")
JOINED = re.compile(r"[ \t]*+(?:\+|\.\.|\.(?=[ \t\"']))[ \t]*+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: How much a part of a name tells that the value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
             "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.5, "access": 0.4, "api": 0.4, "key": 0.5,
             "signing": 0.4, "encryption": 0.4, "client": 0.2, "bearer": 0.7, "salt": 0.4, "cookie": 0.4, "session": 0.4}


def name_score(name: str) -> float:
    """0 to 1: sensitive parts of a name add up."""
    return min(1.0, sum(SENSITIVE.get(p.lower(), 0.0) for p in set(PARTS.findall(name))))


def value_score(value: str) -> float:
    """0 to 1: long values of many different characters of several classes look drawn at random."""
    n = len(value)
    if n < 6:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    spaced = 0.3 if re.search(r"\s", value) else 1.0
    return spaced * min(1.0, bits / 4) * (0.4 + 0.2 * min(3, classes))


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """(name, literals as (start, end, value), names it refers to) of each assignment, in text order."""
    found = []
    for m in NAME.finditer(text):
        literals, names, at = [], [], m.end()
        while piece := PIECE.match(text, at):
            which = piece.lastindex
            if which in (1, 2):
                literals.append((piece.start(which), piece.end(which), piece[which]))
                names += re.findall(r"\$\{([A-Za-z_][\w.]*)\}", piece[which])
            elif which == 3:
                names.append(piece[3])
            elif which == 4:
                literals.append((piece.start(4), piece.end(4), piece[4]))
                names.append(piece[4])
            if not (plus := JOINED.match(text, piece.end())):
                break
            at = plus.end()
        if literals or names:
            found.append((m[1], literals, names))
    return found


def lexed(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name and look like a secret."""
    found = pairs(text)
    if not found:
        return []
    worth: dict[str, float] = {}
    for name, _, _ in found:
        worth[name] = name_score(name)
    if not any(worth.values()):
        return []
    takes: dict[str, list[str]] = {}
    for name, _, names in found:
        takes.setdefault(name, []).extend(names)
    # A name is worth what the names are that take their value from it: from the highest on, each is settled once.
    settled: set[str] = set()
    for start in sorted(worth, key=worth.__getitem__, reverse=True):
        todo = [start]
        while todo:
            name = todo.pop()
            if name not in settled:
                settled.add(name)
                worth[name] = worth[start]
                todo += [other for other in takes.get(name, ()) if other in worth]
    spans = set()
    for name, literals, _ in found:
        for start, end, value in literals:
            if value in worth and value != name:
                continue
            if worth[name] * value_score(value) >= least:
                spans.add((start, end))
    return sorted(spans)


#: What a text must hold for each kind of span; one fast pass of these spares most texts the rest.
HINTS = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}",
         r"""[A-Za-z0-9_.\-]["'\]]*[ \t]*[:=]""")


def spans(text: str, look: tuple = (True,) * 4) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, ordered by start, then kind; `look` leaves out kinds that can't occur."""
    found = []
    if look[0]:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if look[1]:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if look[2]:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if look[3]:
        found += [("lex", a, b) for a, b in lexed(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def batch_spans(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """The spans of each text."""
    look = list(zip(*(pc.match_substring_regex(texts, h).to_pylist() for h in HINTS)))
    return [spans(texts[i].as_py(), x) if any(x) else [] for i, x in enumerate(look)]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `secrets`: array of (kind, start, end) over the whole text.

    A column of that name stays; the new one then gets underscores in front.
    """
    out = fresh(docs.columns, "secrets")
    kind = "array<struct<kind:string,start:int,end:int>>"

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in batch_spans(texts)]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return docs.withColumn(out, find(text_of(F.col(text))))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, base, every, counts = batch.column(0), [], [], {k: [] for k in KINDS[:3]}
        for found in batch.column(1).to_pylist():
            found = [(x["kind"], x["start"], x["end"]) for x in found]
            own = [x for x in found if x[0] != "lex"]
            for k in counts:
                counts[k].append(sum(x[0] == k for x in own))
            base.append(hashlib.sha256(joined(own).encode()).hexdigest())
            every.append(joined(found))
        return pa.record_batch([ids, *[pa.array(c, pa.int64()) for c in counts.values()], pa.array(base, pa.string()),
                                pa.array(every, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = scan(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "secrets")
    return by_batch(found, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
