"""Secret scanning through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain. Documents are indexed shard by shard (a run of
rows of one task): the shard's postings say which of its rows hold which
trigram, postings are intersected and united as the query says, and only the
candidates meet the expression itself. A rule without mandatory trigrams scans
every row. Shards are independent, so nothing is shuffled and no posting list
outgrows its shard.

Nulls and edges: a null or empty text has no spans; spans may overlap between
kinds but not within one; repeated rows are scanned one by one; an empty table
gives an empty result; other columns are ignored (scan) or kept (redact).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import chunks, scan_rows, scan_texts


@dataclass(frozen=True)
class Rule:
    """kind, the expression, and the least length of a group of each match; shorter matches are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    #: An expression with the same accepted matches that is faster to search for, if there is one, and its group that is the match.
    search: str = ""
    whole: int = 0


#: The first three kinds are the base; spans of the others come on top.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    # a scheme starts at the first letter of its run of characters, so only the run's begin is tried: time stays linear in long runs
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@", 0, 0, r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\x00-\x20:/@]++:[^\x00-\x20:/@]++@)", 1),
]
BASE_KINDS = ("assign", "access", "hex")

# -- Boolean trigram queries ------------------------------------------------
# A query is True (anything matches), a trigram, ("and", parts) or ("or", parts).

_MOST_STRINGS = 32


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(s: str) -> object:
    return _all([s[i : i + 3] for i in range(len(s) - 2)])


def _walk(tree) -> tuple[set[str] | None, object]:
    """(the strings that the node matches, if they are few; what a match must contain)."""
    parts: list[object] = []
    exact: set[str] = {""}
    whole = True

    def flush() -> None:
        nonlocal exact, whole
        parts.append(_any([_of_string(s) for s in exact]))
        exact, whole = {""}, False

    for op, arg in tree:
        name, inner, need = str(op), None, True
        if name == "LITERAL":
            inner = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            inner = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            inner, need = _walk(arg[-1])
        elif name == "BRANCH":
            sides = [_walk(x) for x in arg[1]]
            need = _any([q for _, q in sides])
            inner = set().union(*[s for s, _ in sides]) if all(s is not None for s, _ in sides) else None
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner = _walk(arg[2])[0]
            inner = None if inner is None else inner | {""}
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            _, need = _walk(arg[2])
        if inner is not None and len(inner) * len(exact) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in inner}
        else:
            flush()
            parts.append(need)
    if whole:
        return exact, _any([_of_string(s) for s in exact])
    flush()
    return None, _all(parts)


def trigram_query(regex: str) -> object:
    """What the lower-cased text of a match must contain; True if nothing is sure."""
    return _walk(_parser.parse(regex))[1]


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams(q) for q in query[1]])


def _rows(query: object, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    if query is True:
        return everything
    if isinstance(query, str):
        return postings[query]
    found = [_rows(q, postings, everything) for q in query[1]]
    out = found[0]
    for x in found[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def _number(points: np.ndarray) -> np.ndarray:
    """Each three code points in a row as one number."""
    p = points.astype(np.uint64)
    return p[:-2] << np.uint64(42) | p[1:-1] << np.uint64(21) | p[2:]


def _slot(points: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each three code points in a row."""
    return (points[:-2] + points[1:-1] * np.uint32(31) + points[2:] * np.uint32(961)) & np.uint32(0xFFFF)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def index_shard(texts: list[str], wanted: list[str]) -> dict[str, np.ndarray]:
    """Postings of the shard: the texts' trigrams are read once, and those that some query asks for are kept with their rows."""
    if not wanted:
        return {}
    numbers = np.concatenate([_number(_points(g)) for g in wanted])
    asked = np.zeros(1 << 16, dtype=bool)
    asked[np.concatenate([_slot(_points(g)) for g in wanted])] = True
    # no wanted trigram holds the character between two texts
    folded = [t.lower() for t in texts]
    points = _points("\0".join(folded))
    if len(points) < 3:
        return {g: np.zeros(0, dtype=np.int64) for g in wanted}
    at = np.flatnonzero(asked[_slot(points)])
    p = points.astype(np.uint64)
    found = p[at] << np.uint64(42) | p[at + 1] << np.uint64(21) | p[at + 2]
    order = np.argsort(numbers)
    place = np.minimum(np.searchsorted(numbers[order], found), len(order) - 1)
    real = numbers[order][place] == found
    ends = np.cumsum([len(t) + 1 for t in folded])
    row = np.searchsorted(ends, at[real], side="right")
    which, row = np.divmod(np.unique(order[place[real]].astype(np.int64) * len(texts) + row), len(texts))
    edges = np.searchsorted(which, np.arange(len(wanted) + 1))
    return {g: row[edges[k] : edges[k + 1]] for k, g in enumerate(wanted)}


class Scanner:
    """The rules with their queries; made once for each task."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(k, r, re.compile(r.search or r.regex, re.ASCII), trigram_query(r.regex)) for k, r in enumerate(rules)]
        self.wanted = sorted(set().union(*[trigrams(q) for *_, q in self.rules]))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule's number, end) for each text, in that order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b in chunks(texts):
            shard = texts[a:b]
            postings, everything = index_shard(shard, self.wanted), np.arange(b - a)
            for k, rule, pattern, query in self.rules:
                for i in _rows(query, postings, everything):
                    out[a + i] += [(m.start(rule.whole), k, m.end(rule.whole)) for m in pattern.finditer(shard[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in out]


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then rule; places in code points."""
    rules = RULES if rules is None else rules

    def make():
        scanner = Scanner(rules)
        return lambda texts: {"spans": [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner.spans(texts)]}

    return scan_texts(docs, make, "spans array<struct<kind:string,start:int,end:int>>")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of the base spans, and all spans as text."""

    def digest(found: list[tuple[int, int, int]]) -> tuple:
        named = [(RULES[k].kind, f"{RULES[k].kind}:{s}:{e}") for s, k, e in found]
        base = [x for x in named if x[0] in BASE_KINDS]
        counts = [sum(k == kind for k, _ in base) for kind in BASE_KINDS]
        return *counts, hashlib.sha256(",".join(x for _, x in base).encode()).hexdigest(), ",".join(x for _, x in named)

    def make():
        scanner, names = Scanner(RULES), ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        return lambda texts: dict(zip(names, zip(*map(digest, scanner.spans(texts)), strict=True), strict=True))

    return scan_texts(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with every run of overlapping spans replaced by the mark."""
    out, at, upto = [], 0, -1
    for s, e in sorted(spans):
        if s >= upto:
            out += [text[at:s], mark]
        upto = max(upto, e)
        at = upto
    return "".join(out) + text[at:]


_KEY_BEGIN, _KEY_END = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
#: What follows a key's first line if its last is missing: header lines and runs of base64, with quoting and escaped line ends between; the last may be short.
_KEY_GAP = r"""(?:\s|\\[nrt]|["'>\#*|,])*"""
_KEY_LINES = re.compile(rf"""(?:{_KEY_GAP}(?:(?:Proc-Type|DEK-Info|Comment|Key):[^\n\\]*|[A-Za-z0-9+/]{{16,}}={{0,2}}))*(?:\s*(?:\\[nrt])?[A-Za-z0-9+/]+={{0,2}}(?=\s*(?:\n|\Z)|\\[nr]|["']))?""")


def key_end(text: str, at: int) -> int:
    """Where the private key ends whose first line ends at the place: after its last line, or else after its last base64."""
    last, other = _KEY_END.search(text, at), _KEY_BEGIN.search(text, at)
    if last and (other is None or last.start() < other.start()):
        return last.end()
    return _KEY_LINES.match(text, at).end()


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of docs with secrets replaced in text, private keys with their bodies; null texts stay null; n_chars, if there, follows."""

    def make():
        scanner = Scanner(RULES)

        def clean(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
            return redact(text, [(s, key_end(text, e) if RULES[k].kind == "private_key" else e) for s, k, e in found]) if found else text

        def change(rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            at = rows.schema.get_field_index("text")
            new = [clean(t, x) for t, x in zip(texts, scanner.spans([t or "" for t in texts]), strict=True)]
            return rows.set_column(at, rows.schema.field(at), pa.array(new, type=rows.schema.field(at).type))

        return change

    out = scan_rows(docs, make)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
