"""Column functions for text: tokens, marks, lexicons, handles, counts, dates, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def normalise(c) -> Column:
    """Curly quotes straight, null as ''."""
    return F.translate(F.coalesce(col(c), F.lit("")), "‘’“”", "''\"\"")


#: What Python's str.strip takes off.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(c) -> Column:
    """The text without white space at its ends, null as ''."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(SPACES))


def strip_tags_mentions(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"#[\p{L}\p{N}_]+", " "), r"@[\p{L}\p{N}_.]+", " ")


def tokens(c) -> Column:
    """Alphabetic tokens, lower-cased, outside tags and mentions."""
    return F.transform(F.regexp_extract_all(strip_tags_mentions(normalise(c)), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0)), F.lower)


def word_count(c) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[ \t\n\r]+"), lambda w: w != ""))


def found(c, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(pattern))


def hashtags(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0))


def mentions(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"@[\p{L}\p{N}_.]+"), F.lit(0))


def lexicon_hits(toks: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Tokens that are entries, or start with a prefix entry; each token counts once."""

    def hit(t):
        out = t.isin(exact) if exact else F.lit(False)
        for p in prefixes:
            out = out | t.startswith(p)
        return out

    return F.size(F.filter(toks, hit))


def parse_count(c) -> Column:
    """'1,180', '25.2K', '1.2M' as a number, fractions cut; null if it is none or no long.

    Decimals of 12 places, not doubles: 32773.2 times 1000 in doubles lies below 32773200.
    """
    bare = F.upper(F.replace(F.trim(col(c)), F.lit(","), F.lit("")))
    unit = F.right(bare, F.lit(1))
    num, thousands = (F.regexp_replace(bare, "[KM]$", "").try_cast(t) for t in ("decimal(38,12)", "decimal(30,12)"))
    times = lambda n: F.floor(thousands * F.lit(n).cast("decimal(7,0)")).try_cast("long")
    return F.when(unit == "K", times(1000)).when(unit == "M", times(1_000_000)).otherwise(F.floor(num).try_cast("long"))


def handle(c) -> Column:
    """A bare lower-case handle from a URL or an @name; '' is null."""
    bare = F.regexp_replace(F.lower(F.trim(col(c))), r"^(https?://)?(www\.)?[a-z0-9-]+\.(com|net|org)/", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, "^@", ""), r"[/?#].*$", ""), F.lit(""))


def stable_id(c, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.left(F.sha1(F.lower(F.trim(col(c)))), F.lit(6))))


def safe_name(c) -> Column:
    return F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_")


def fold_digits(c) -> Column:
    """Superscript and full-width digits as ASCII digits."""
    return F.translate(col(c), "⁰¹²³⁴⁵⁶⁷⁸⁹０１２３４５６７８９", "01234567890123456789")


def url_bare(c) -> Column:
    return F.regexp_replace(col(c), r"[?#].*$", "")


def url_drop_param(c, name: str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), rf"([?&]){name}=[^&#]*", "$1"), r"([?&])&+|[?&]$", "$1")


def date_any(c, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats])


def visible_text(c) -> Column:
    """Markup without scripts and tags, white space joined."""
    no = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style|noscript|template|svg)[^>]*>.*?</(script|style|noscript|template|svg)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no, r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))


def shortcode(c) -> Column:
    """The id of a post in its URL, '' if none."""
    return F.regexp_extract(col(c), r"/(?:p|reel)/([^/?#]+)", 1)


def url_owner(c) -> Column:
    return F.regexp_extract(col(c), r"^https?://[^/]+/([^/]+)/(?:p|reel)/", 1)


def url_expiry(c) -> Column:
    """Seconds since 1970 from the hexadecimal parameter oe, null if none."""
    return F.conv(F.nullif(F.regexp_extract(col(c), r"[?&]oe=([0-9A-Fa-f]+)", 1), F.lit("")), 16, 10).cast("long")


def html_links(c) -> Column:
    """Distinct link targets, as first met."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit('href="([^"]+)"'), F.lit(1)))


def caption_header(c) -> Column:
    """(likes, replies, author, caption) of 'N likes, M comments - user on DATE: "caption"', each on its own pattern."""
    part = lambda p: F.regexp_extract(col(c), p, 1)
    return F.struct(parse_count(part(r"([\d.,]+[KM]?) likes?")).alias("likes"), parse_count(part(r"([\d.,]+[KM]?) comments?")).alias("replies"), part(r"- ([\w.]+) on ").alias("author"), part(r'(?s): "(.*)"$').alias("caption"))


def caps_words(c) -> Column:
    """Words of three capitals or more, outside tags and mentions."""
    words = F.regexp_extract_all(strip_tags_mentions(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}{3,}$")))


def language(toks: Column, first: list[str], second: list[str], names: tuple[str, str] = ("en", "es"), least: int = 2) -> Column:
    """The first language if at least so many of its function words stand there, and more than of the second's."""
    count = lambda words: F.size(F.filter(toks, lambda w: w.isin(words)))
    return F.when(F.size(toks) >= 2, F.when((count(first) >= least) & (count(first) > count(second)), names[0]).otherwise(names[1]))


def parse_attempts(c) -> Column:
    """A number of attempts from free text: digits alone, '20' anywhere, or '5-10' as 7; else null."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(t.contains("20"), 20).when(t == "5-10", 7).cast("long")


def parse_hours(c) -> Column:
    """Hours from '4 h' or '2-3 hrs': the first of a range; null if it is no number."""
    return F.get(F.split(F.regexp_replace(F.lower(F.trim(col(c))), r"\s*(h|hrs?|hours?)$", ""), "-"), F.lit(0)).try_cast("double")


def fmt_pct(k, n) -> Column:
    """'k/n (p%)' with one decimal, ties to even."""
    return F.format_string("%d/%d (%.1f%%)", col(k), col(n), F.bround(100 * col(k) / col(n), 1))


def evidence(c, bank: list, agree: int = 2) -> Column:
    """(value, confidence) of the best signal of a bank of (confidence, pattern, column rule), the best first.

    The first pattern that is found decides; another one within agree of it adds '+' to the confidence.
    """
    values = [(conf, rule(F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")).cast("long"))) for conf, p, rule in bank]
    best = F.coalesce(*[v for _, v in values])
    name = F.coalesce(*[F.when(v.isNotNull(), F.lit(conf)) for conf, v in values])
    near = sum((F.coalesce(F.abs(v - best) <= agree, F.lit(False)).cast("int") for _, v in values), F.lit(0))
    return F.struct(best.alias("value"), F.when(near > 1, F.concat(name, F.lit("+"))).otherwise(name).alias("confidence"))


#: Character entities that markup of this kind uses, the ampersand last.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]


def html_meta(c, name: str) -> Column:
    """The content of a meta property, whichever attribute comes first, with entities resolved; '' if none."""
    ahead = F.regexp_extract(col(c), rf'(?is)<meta[^>]*property="{name}"[^>]*content="([^"]*)"', 1)
    out = F.coalesce(F.nullif(ahead, F.lit("")), F.regexp_extract(col(c), rf'(?is)<meta[^>]*content="([^"]*)"[^>]*property="{name}"', 1))
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def profile_counts(c) -> Column:
    """(posts, followers, following, origin): from the page's text, each from its description if missing there."""
    page, meta = visible_text(c), html_meta(c, "og:description")
    names = ("posts", "followers", "following")
    of = lambda text, w: parse_count(F.regexp_extract(text, rf"(?i)([0-9.,]+[KM]?) {w}", 1))
    origin = F.when(of(page, "followers").isNotNull(), "page").when(of(meta, "followers").isNotNull(), "meta")
    return F.struct(*[F.coalesce(of(page, w), of(meta, w)).alias(w) for w in names], origin.alias("origin"))


def profile_bio(visible, stop: str = "Follow") -> Column:
    """What stands after the counts, up to the first word of the page itself; 500 characters, null if nothing."""
    return F.nullif(F.left(F.trim(F.regexp_extract(col(visible), rf"(?i)following (.*?)(?: {stop}\b.*)?$", 1)), F.lit(500)), F.lit(""))


def video_url(c) -> Column:
    """The page's own video address, else the longest one in it (of equals the first in order)."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r'"(https?://[^"]+\.mp4[^"]*)"'), F.lit(1))
    longest = F.array_min(F.transform(found, lambda u: F.struct((-F.length(u)).alias("n"), u.alias("u"))))["u"]
    return F.coalesce(F.nullif(html_meta(c, "og:video"), F.lit("")), longest)


def handles_in(c, stop: list[str], lo: int = 4, hi: int = 30) -> Column:
    """Distinct handle-like tokens of a text: lengths lo to hi, no stop words, not digits alone."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9_.]+"), F.lit(0)))
    return F.array_except(F.filter(found, lambda w: F.length(w).between(lo, hi) & ~w.rlike(r"^[0-9.]+$")), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def longest(strings) -> Column:
    """The longest string of an array, the first in order of equals; null if there is none."""
    return F.array_min(F.transform(col(strings), lambda u: F.struct((-F.length(u)).alias("n"), u.alias("u"))))["u"]
