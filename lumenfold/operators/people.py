"""Rules on who an account is: first match wins and says why. Patterns come as banks, in a dialect that Java and RE2 share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import col


@dataclass(frozen=True)
class Bank:
    """Patterns of one study; all without look-around."""

    category: str
    allowed: str
    strong: str
    handle: str
    weak: str
    person: str
    away: str
    home: str
    title: str
    programme: str
    specialty: str
    lab_handle: str
    role: str
    weak_role: str
    student: str
    adult_age: str
    institution: str


def first(c, pattern: str) -> Column:
    """The first match of a pattern, '' if none or null."""
    return F.coalesce(F.regexp_extract(col(c), pattern, 0), F.lit(""))


def reasons(cases: list[tuple[str, Column]]) -> Column:
    """'name (match)' of the first case whose match is not empty, else ''."""
    out = F.lit("")
    for name, match in reversed(cases):
        out = F.when(match != "", F.concat(F.lit(f"{name} ("), F.trim(match), F.lit(")"))).otherwise(out)
    return out


def professional(bio, bank: Bank) -> Column:
    """The category label at the head of a profile: in the first line's first 45 characters, in title case, if no allowed word stands there."""
    head = F.left(F.get(F.split(F.coalesce(col(bio), F.lit("")), "\n"), F.lit(0)), F.lit(45))
    labels = F.filter(F.regexp_extract_all(head, F.lit(f"(?i){bank.category}"), F.lit(0)), lambda m: m.rlike("^[A-Z]"))
    return F.when(head.rlike(f"(?i){bank.allowed}"), "").otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit("")))


def organisation(bio, user, bank: Bank) -> Column:
    weak = F.when(F.coalesce(col(bio), F.lit("")).rlike(f"(?i){bank.person}"), "").otherwise(first(bio, f"(?i){bank.weak}"))
    return reasons([("organisation's words", first(bio, f"(?i){bank.strong}")), ("organisation's handle", first(user, f"(?i){bank.handle}")), ("place without a person", weak)])


def out_of_region(bio, bank: Bank) -> Column:
    return F.when(F.coalesce(col(bio), F.lit("")).rlike(f"(?i){bank.home}"), "").otherwise(first(bio, f"(?i){bank.away}"))


def non_person(name, bio, user, own, others, bank: Bank, least: int = 5) -> Column:
    """Why an account is no private person; own and others count its own posts and those of others that it shows."""
    flat = F.replace(F.coalesce(col(bio), F.lit("")), F.lit("\n"), F.lit(" "))
    both = F.concat(F.coalesce(col(name), F.lit("")), F.lit(" "), flat)
    repeats = F.when((col(own) < least) & (col(others) > col(own)), F.concat(col(own).cast("string"), F.lit(" to "), col(others).cast("string"))).otherwise("")
    return reasons([
        ("organisation's handle", F.when(F.lower(F.coalesce(col(user), F.lit(""))).rlike(bank.lab_handle), F.lower(col(user))).otherwise("")),
        ("title in the name", first(name, f"(?i){bank.title}")),
        ("programme's name", first(name, f"(?i){bank.programme}")),
        ("programme's words", first(flat, f"(?i){bank.programme}")),
        ("specialty", first(both, f"(?i){bank.specialty}")),
        ("repeater", repeats),
    ])


def year_in_handle(user, as_of: int) -> Column:
    """The age that a year of birth in a handle implies, null if there is none that can be."""
    year = F.nullif(F.regexp_extract(F.coalesce(col(user), F.lit("")), r"(19[5-9]\d|20[0-2]\d)", 1), F.lit("")).cast("int")
    return F.when(year.between(1950, as_of - 10), as_of - year)


def handle_reason(user, seed, bank: Bank, as_of: int, lo: int, hi: int, dropped: list[str], rescued: list[str]) -> Column:
    """Why a candidate goes by its seed or handle, '' if it stays; rescued handles stay whatever they are."""
    age = year_in_handle(user, as_of)
    out = F.when(F.lower(col(user)).isin(rescued), "")
    out = out.when(col(seed).isin(dropped), F.concat(F.lit("seed dropped: "), col(seed)))
    out = out.when(F.coalesce(col(user), F.lit("")).rlike(f"(?i){bank.institution}"), "institution's handle")
    return out.when(age.isNotNull() & ~age.between(lo, hi), F.concat(F.lit("handle implies "), age.cast("string"))).otherwise("")


def adult_contradiction(bio, masked, band, bank: Bank, weak_band: str) -> Column:
    """Why a profile cannot be of a band: a role, unless it says student; a family role, for one band; a stated age of 30 to 79."""
    b = F.coalesce(col(bio), F.lit(""))
    role = F.when(b.rlike(f"(?i){bank.student}"), "").otherwise(first(b, f"(?i){bank.role}"))
    family = F.when(col(band) == weak_band, first(b, f"(?i){bank.weak_role}")).otherwise("")
    return reasons([("role", role), ("family role", family), ("age", F.coalesce(F.regexp_extract(col(masked), bank.adult_age, 1), F.lit("")))])


def account_status(visible, posts, cases: list[tuple[str, str]]) -> Column:
    """The state of an account from its page's text: ordered patterns, then whether it has posts."""
    out = F.when(col(posts) > 0, "public_with_posts").otherwise("public_without_posts")
    for name, pattern in reversed(cases):
        out = F.when(F.coalesce(col(visible), F.lit("")).rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def screener(items: list[str], method: str, intent: str, plan: str, behaviour: str, recent: str, yes: str = "yes") -> Column:
    """A six-item triage rule: high, moderate, low, negative, or null without any answer to the items."""
    y = lambda c: F.coalesce(F.col(c) == yes, F.lit(False))
    answered = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (*items, behaviour)]).isNotNull()
    low = y(items[0])
    for c in items[1:]:
        low = low | y(c)
    return F.when(~answered, None).when(y(intent) | y(plan) | (y(behaviour) & y(recent)), "high").when(y(method) | y(behaviour), "moderate").when(low, "low").otherwise("negative")
