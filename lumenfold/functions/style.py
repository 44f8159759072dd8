"""Column functions for writing style: emoji, lexicons of words, prefixes and phrases, counters of a post."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .numbers import col

#: Flags, then a base with its variant or skin tone and what joins it: the same text for Java and RE2.
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]{2}|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1F2FF}]"
    r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]?(?:\x{200D}[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?)*"
)
#: Letters of a token and of a word in capitals: fixed values.
TOKEN = r"[a-záéíóúüñ]+(?:'[a-z]+)?"
CAPITALS = "^[A-ZÁÉÍÓÚÑ]{3,}$"
WORD = r"[\p{L}\p{N}_]"


@dataclass(frozen=True)
class Lexicon:
    """Entries by kind: whole words, prefixes (written with *), and phrases of several words."""

    words: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, entries: list[str]) -> Lexicon:
        low = [e.strip().lower() for e in entries if e.strip()]
        return cls([e for e in low if " " not in e and not e.endswith("*")], [e[:-1] for e in low if e.endswith("*") and " " not in e], [e for e in low if " " in e])

    def hits(self, tokens: Column, lowered: Column) -> Column:
        """Tokens that are words or start with a prefix, each once, and whole phrases in the lower-cased text."""
        n = X.lexicon_hits(tokens, self.words, self.prefixes) if self.words or self.prefixes else F.lit(0)
        for p in self.phrases:
            n = n + F.regexp_count(lowered, F.lit(rf"(?<!{WORD}){re.escape(p)}(?!{WORD})"))
        return n

    def sql(self, tokens: str, doubled: str) -> str:
        """The same as DuckDB SQL; doubled is the text with each separator twice, padded."""
        tests = ([f"x in ({', '.join(_quoted(w) for w in self.words)})"] if self.words else []) + [f"starts_with(x, {_quoted(p)})" for p in self.prefixes]
        parts = [f"len(list_filter({tokens}, lambda x: {' or '.join(tests)}))"] if tests else ["0"]
        sep = f"[^{WORD[1:]}"
        return " + ".join(parts + [f"len(regexp_extract_all({doubled}, {_quoted(sep + p.replace(' ', '  ') + sep)}))" for p in self.phrases])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def emoji(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(EMOJI), F.lit(0))


def valence(found: Column, of: list[str]) -> Column:
    """How many of the emoji are in a list, with or without their variant selector."""
    return F.size(F.filter(found, lambda e: e.isin(of) | F.replace(e, F.lit("️"), F.lit("")).isin(of)))


def style_tokens(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(f"(?iu){TOKEN}"), F.lit(0)), F.lower)


def capitals(c) -> Column:
    words = F.regexp_extract_all(col(c), F.lit(f"{WORD}+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.rlike(CAPITALS)))
