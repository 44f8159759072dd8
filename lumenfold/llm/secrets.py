"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer takes every = or : (also := and =>) apart into a name before it, however long, and a value after
it: a quoted literal, a bare word, or a sum of literals and names. Names bound to literals are constants of the text;
a value that names a constant, also through further names, resolves to its literals. A literal is scored
by the sensitive words of every name that it reaches and by its own length, variety and shape, and a
score of THRESHOLD or more adds a span of kind `lexed` over the literal.

Defined results: a null text is empty; an empty text has no spans; equal spans are reported once; a name
that is bound again keeps all its literals; cycles of names end; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts

#: The contract's patterns: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEXED = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "lexed"]
#: Words in names, and how much each says that the value is secret.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3, "private_key": 3, "access_key": 3, "credential": 3, "auth": 2, "bearer": 3, "client_id": 1, "signature": 2, "salt": 2, "key": 1, "cert": 1}
THRESHOLD = 5.0
MIN_LITERAL = 8

#: A whole run of name characters, from its first letter on, closing quotes, and the operator after it.
_TARGET = re.compile(r"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+([A-Za-z_][A-Za-z0-9_.\-]*+)["'\]]{0,2}[ \t]*+(?::=|=>|[=:])""")
_TERM = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z0-9_.+/=\-]+))""")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*(?=[\"'A-Za-z_])")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def assignments(text: str) -> list[tuple[str, list[tuple[str, int, int, bool]]]]:
    """(name, terms) of each assignment; a term is (value, start, end, quoted)."""
    out = []
    for name in _TARGET.finditer(text):
        terms, at = [], name.end()
        while m := _TERM.match(text, at):
            kind = next(k for k in (1, 2, 3) if m[k] is not None)
            terms.append((m[kind], m.start(kind), m.end(kind), kind < 3))
            plus = _PLUS.match(text, m.end())
            if not plus:
                break
            at = plus.end()
        if terms:
            out.append((name[1], terms))
    return out


def name_score(name: str) -> int:
    flat = re.sub(r"[.\-]", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).lower()
    return max((s for w, s in SENSITIVE.items() if w in flat), default=0)


def literal_score(value: str) -> float:
    """Up to 4: length, bits a character, and mixed classes; placeholders and plain words score low."""
    if len(value) < MIN_LITERAL or re.search(r"(?i)example|placeholder|changeme|your[_-]|xxxx|\$\{|<[a-z_]+>", value) or " " in value:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(n, 32) / 32 + min(bits, 4) / 4 + 0.5 * (classes - 1) + 0.5 * (classes > 1)


def lexed(text: str) -> list[tuple[int, int]]:
    """The spans of the literals that sensitive names reach and that look like secrets."""
    found = assignments(text)
    if not found:
        return []
    score: dict[str, int] = {}
    bound: dict[str, list[tuple[str, int, int]]] = {}
    edges: dict[str, set[str]] = {}
    names = {n for n, _ in found}
    for name, terms in found:
        score[name] = max(score.get(name, 0), name_score(name))
        for value, a, b, quoted in terms:
            if not quoted and value in names and value != name and _IDENTIFIER.fullmatch(value):
                edges.setdefault(name, set()).add(value)
            else:
                bound.setdefault(name, []).append((value, a, b))
    # a constant gets the best score of the names that it reaches: from high scores down, each name once
    reach = dict(score)
    for name in sorted(score, key=lambda n: -score[n]):
        todo = [name]
        while todo:
            for to in edges.get(todo.pop(), ()):
                if reach.get(to, 0) < score[name]:
                    reach[to] = score[name]
                    todo.append(to)
    spans = {(a, b) for name, literals in bound.items() if reach[name] for v, a, b in literals if (s := literal_score(v)) and reach[name] + s >= THRESHOLD}
    return sorted(spans)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's matches, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEXED.finditer(text)]
    return sorted(out)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed) of each row of df."""
    kind = df.schema[key].dataType.simpleString()

    def shown(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(kept: pa.Table, texts: list[bytes]) -> pa.Table:
        rows = []
        for raw in texts:
            t = raw.decode("utf-8", "replace")
            base = base_spans(t)
            more = [(a, 3, b) for a, b in lexed(t)] if "=" in t or ":" in t else []
            n = Counter(k for _, k, _ in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + more)), len(more)))
        cols = list(zip(*rows, strict=True))
        for name, values, of in zip(["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"], cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True):
            kept = kept.append_column(name, pa.array(values, of))
        return kept

    return map_texts(df, [key], run, f"{key} {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_lexed bigint", text)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
