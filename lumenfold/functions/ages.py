"""A pattern-bank extractor with confidence ranks, a conflict rule and an agreement boost; ages are its instance.

Each function has its DuckDB twin (…_sql), for patterns must say the same in Java and RE2: no look-around.
Where a number must stand alone, separators are matched and the text is padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import col
from .text import fold_digits

LO, HI = 15, 29
BANDS = [(15, 17), (18, 21), (22, 25), (26, 29)]
_SUPER, _PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹０１２３４５６７８９", "01234567890123456789"
#: What a page adds to a profile's text, and what is no age: (pattern, replacement) in order.
NOISE = [(r"(?im)Followed by .*$", " "), (r"(?im)\.\.\.\s*more$", " ")]
NAMES = [(r"@[\p{L}\p{N}_.]+", " "), (r"https?://\S+", " "), (r"\S*[._][0-9]+\S*[._]?[0-9]*[A-Za-z]\S*", " ")]
MASKS = [
    (r"\b[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{2,4}\b", " "),
    (r"\b[0-9]{1,2}:[0-9]{2}\b", " "),
    (r"[$€]\s*[0-9]+(?:[.,][0-9]+)?", " "),
    (r"\b[0-9]+\s*[xX]\s*[0-9]+\b", " "),
    (r"\b[0-9]+\s*%", " "),
    (r"(?i)\b(?:high school|school|module)\s*(?:no\.?|#)?\s*[0-9]{1,2}\b", " "),
    (r"(?i)\b[0-9]{1,2}\s*(?:st|nd|rd|th)?\s*semester\b", " "),
    (r"(?i)\bsemester\s*[0-9]{1,2}\b", " "),
]
STATED = r"(?i)(?:^|[^0-9])([0-9]{2})\s*(?:years?\s*old|years|y/?o)\b"
LOOSE = r"[^0-9A-Za-zÀ-ÿ]([0-9]{2})[^0-9A-Za-zÀ-ÿ]"
BORN = r"\b(19[89][0-9]|20[0-2][0-9])\b"
COHORT = r"\b(?:gen|class of)\s*\.?\s*'?(20[0-9]{2}|[0-9]{2})\b"
LEVELS = [(r"\b(middle school)\b", 13), (r"\b(high school)\b", 16), (r"\b(university|college)\b", 21), (r"\b(master|doctorate)\b", 26)]
#: First-person formulas of captions: (pattern, rank: 2 is high, 1 medium).
FORMULAS = [
    (r"\bi turn ([0-9]{2})\b", 2), (r"\bi am ([0-9]{2}) years\b", 2), (r"\bhappy ([0-9]{2})(?:st|nd|rd|th)? birthday to me\b", 2),
    (r"\b(?:celebrating|starting) (?:my )?([0-9]{2})\b", 1), (r"\bmy ([0-9]{2})\b", 1), (r"\bturn(?:ed|ing) ([0-9]{2})\b", 2),
]


def _replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def _replaced_sql(c: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return c


def clean(c) -> Column:
    """A profile's text without what the page adds, handles and addresses, with plain digits."""
    return _replaced(fold_digits(_replaced(F.coalesce(col(c), F.lit("")), NOISE)), NAMES)


def clean_sql(c: str) -> str:
    return _replaced_sql(f"translate({_replaced_sql(f'coalesce({c}, {chr(39) * 2})', NOISE)}, '{_SUPER}', '{_PLAIN}')", NAMES)


def caption_clean(c) -> Column:
    return _replaced(fold_digits(F.coalesce(col(c), F.lit(""))), [*NAMES[:2], (r"#[\p{L}\p{N}_]+", " ")])


def caption_clean_sql(c: str) -> str:
    return _replaced_sql(f"translate(coalesce({c}, ''), '{_SUPER}', '{_PLAIN}')", [*NAMES[:2], (r"#[\p{L}\p{N}_]+", " ")])


def mask_dates(c) -> Column:
    """Dates, clock times, prices, products, shares, numbers of schools and semesters as a space."""
    return _replaced(col(c), MASKS)


def mask_sql(c: str) -> str:
    return _replaced_sql(c, MASKS)


def let(value: Column, make) -> Column:
    """make(x) where x is value, evaluated once however often it is read."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _doubled(c: Column) -> Column:
    """Each separator twice, so that one match cannot take the next one's."""
    return F.concat(F.lit(" "), F.regexp_replace(c, "([^0-9A-Za-zÀ-ÿ])", "$1$1"), F.lit(" "))


def _doubled_sql(c: str) -> str:
    return f"(' ' || regexp_replace({c}, '([^0-9A-Za-zÀ-ÿ])', '\\1\\1', 'g') || ' ')"


def explicit(t: Column) -> Column:
    e = _int(F.regexp_extract(t, STATED, 1))
    return F.when(e.between(LO - 3, HI + 5), e)


def explicit_sql(t: str) -> str:
    return f"(select case when e between {LO - 3} and {HI + 5} then e end from (select try_cast(nullif(regexp_extract({t}, '{STATED}', 1), '') as int) as e))"


def loose(t: Column) -> Column:
    """The first number of two digits that stands alone and can be an age."""
    found = F.filter(F.transform(F.regexp_extract_all(_doubled(t), F.lit(LOOSE), F.lit(1)), lambda x: x.cast("int")), lambda x: x.between(LO - 2, HI + 2))
    return F.get(found, F.lit(0))


def loose_sql(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({_doubled_sql(t)}, '{LOOSE}', 1), lambda x: x::int), lambda x: x between {LO - 2} and {HI + 2})[1]"


def birth(t: Column, as_of: int) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(BORN), F.lit(1)), lambda x: as_of - x.cast("int")), lambda x: x.between(LO - 2, HI + 2))
    return F.get(found, F.lit(0))


def birth_sql(t: str, as_of: int) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '{BORN}', 1), lambda x: {as_of} - x::int), lambda x: x between {LO - 2} and {HI + 2})[1]"


def cohort(c: Column, as_of: int) -> Column:
    """18 at the year of leaving school."""
    y = _int(F.regexp_extract(F.lower(c), COHORT, 1))
    y = F.when(y < 100, 2000 + y).otherwise(y)
    return F.when(y.between(2015, as_of + 4), 18 + as_of - y)


def cohort_sql(c: str, as_of: int) -> str:
    raw = f"try_cast(nullif(regexp_extract(lower({c}), '{COHORT.replace(chr(39), chr(39) * 2)}', 1), '') as int)"
    y = f"(case when {raw} < 100 then 2000 + {raw} else {raw} end)"
    return f"case when {y} between 2015 and {as_of + 4} then 18 + {as_of} - {y} end"


def level(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for pattern, age in reversed(LEVELS):
        out = F.when(F.lower(c).rlike(pattern), age).otherwise(out)
    return out


def level_sql(c: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({c}), '{p}') then {a}" for p, a in LEVELS) + " end"


def signals(c, as_of: int) -> Column:
    """(stated, loose, born, cohort, level) of a profile's text."""
    told = lambda k, t: F.struct(explicit(t).alias("stated"), loose(t).alias("loose"), birth(t, as_of).alias("born"), cohort(k, as_of).alias("cohort"), level(k).alias("level"))
    return let(clean(c), lambda k: let(mask_dates(k), lambda t: told(k, t)))


def lower_bound(first_year, as_of: int, opening: int = 10) -> Column:
    return opening + as_of - col(first_year)


def combined(c, first_year, as_of: int) -> Column:
    """(age, conflict, confidence): the strongest signal; one below what the account's age allows loses a rank, two that agree gain one."""
    entry = lambda v, r: F.struct(v.alias("v"), F.lit(r).alias("r"))

    def by_rank(s: Column) -> Column:
        return F.filter(F.array(entry(s["stated"], 3), entry(F.when(s["stated"].isNull(), s["loose"]), 2), entry(s["born"], 2), entry(s["cohort"], 1), entry(s["level"], 1)), lambda x: x["v"].isNotNull())

    def judged(ranked: Column) -> Column:
        top, other = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        conflict = F.coalesce(top["v"] < lower_bound(first_year, as_of) - 1, F.lit(False))
        rank = F.when(conflict, F.when(top["r"] > 1, 1).otherwise(0)).otherwise(top["r"])
        rank = F.when((F.abs(other["v"] - top["v"]) <= 2) & (rank == 2), 3).otherwise(rank)
        name = F.when(top.isNull(), "none").otherwise(F.get(F.array(*[F.lit(x) for x in ("none", "low", "medium", "high")]), rank))
        return F.struct(top["v"].alias("age"), conflict.alias("conflict"), name.alias("confidence"))

    return let(let(signals(c, as_of), by_rank), judged)


def band(age) -> Column:
    out = F.lit("outside")
    for lo, hi in reversed(BANDS):
        out = F.when(col(age).between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return F.when(col(age).isNotNull(), out)


def admitted(age, confidence, accept_low: bool = False) -> Column:
    return F.coalesce(col(confidence).isin(["high", "medium", "low"] if accept_low else ["high", "medium"]) & col(age).between(LO, HI), F.lit(False))


def validated(df: DataFrame, age: str, truth: str) -> DataFrame:
    """Coverage, mean and largest error, hits of the band and within two years."""
    miss = F.abs(F.col(age) - F.col(truth))
    return df.agg(F.count("*").alias("n"), F.count(age).alias("estimated"), (100 * F.count(age) / F.nullif(F.count("*"), F.lit(0))).alias("coverage"), F.avg(miss).alias("mae"), F.max(miss).cast("long").alias("worst"), F.count_if(band(age) == band(truth)).alias("band_hits"), F.count_if(miss <= 2).alias("within_2"))


def caption_age(t: Column) -> Column:
    """(age, r) of the first formula that is found."""

    def first(low: Column) -> Column:
        got = F.array(*[F.struct(_int(F.regexp_extract(low, pattern, 1)).alias("age"), F.lit(rank).alias("r")) for pattern, rank in FORMULAS])
        return F.get(F.filter(got, lambda x: x["age"].isNotNull()), F.lit(0))

    return let(F.lower(t), first)


def caption_sql(t: str) -> str:
    got = lambda p: f"nullif(regexp_extract(lower({t}), '{p}', 1), '')"
    return "case " + " ".join(f"when {got(p)} is not null then {{'age': {got(p)}::int, 'r': {r}}}" for p, r in FORMULAS) + " end"


def from_captions(df: DataFrame, account: str, key: str, text: str, year: str, as_of: int) -> DataFrame:
    """(account, age, confidence): the best caption's age today; a second one within a year makes it high."""
    d = df.select(account, key, year, caption_age(mask_dates(caption_clean(text))).alias("x")).where(F.col("x.age").between(LO - 3, HI + 5))
    d = d.select(account, (F.col("x.age") + as_of - F.col(year)).alias("age"), F.col("x.r").alias("r"), F.row_number().over(Window.partitionBy(account).orderBy(F.desc("x.r"), key)).alias("n"))
    at = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    p = d.where("n <= 2").groupBy(account).agg(at("age", 1).alias("age"), at("r", 1).alias("r"), at("age", 2).alias("other"))
    return p.select(account, F.col("age").cast("int").alias("age"), F.when((F.abs(F.col("other") - F.col("age")) <= 1) | (F.col("r") == 2), "high").otherwise("medium").alias("confidence"))
