"""Registered queries on profiles: who an account is, what its page and its JSON say, ages in free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ages as G
from ..functions import text as X
from ..operators import people as P
from .registry import registrar
from .shapes import quoted, shaped, shaped_sql

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: Small pattern banks of this library's own; a study brings its own.
BANK = P.Bank(
    category=r"\b(restaurant|doctor|artist|school|video creator|bar)\b",
    allowed=r"\b(student|personal blog)\b",
    strong=r"(\bwe are\b|official account|\bour (team|school|members)\b|\bfoundation\b)",
    handle=r"(official|council|club|_team|institute)",
    weak=r"\b(high school|university|college)\b",
    person=r"(\bstudent\b|\bi am\b|\bmy\b)",
    away=r"\b(london|paris|berlin)\b",
    home=r"\b(madrid|toledo)\b",
    title=r"^\s*(dr|prof|eng)\b\.?\s",
    programme=r"\b(master in|laboratory|collective|department of|orders and shipping)\b",
    specialty=r"\b(cardiolog|pediatr|dermatolog)",
    lab_handle=r"(^|[._])lab([._]|$)|official$",
    role=r"\b(teacher|director|professor|lawyer|nurse)\b",
    weak_role=r"\b(mother of|father of|my children)\b",
    student=r"\bstudent\b",
    adult_age=r"(?:^|[^0-9A-Za-zÀ-ÿ])([3-7][0-9])(?:\s*years|[^0-9A-Za-zÀ-ÿ]|$)",
    institution=r"(official|school|university|_fest$|shop|news|^dr[._])",
)
BIOS = [
    None, "", "Mexican Restaurant\nopen daily", "the dim lights of the bar in Paris", "Student artist | Madrid", "We are the chess club, official account", "University of Toledo", "i am 17, my university life",
    "Dr. of nothing, cardiologist in Berlin", "teacher and mother of two, 45 years", "student of a teacher, father of none", "Video Creator from London 38", "laboratory of sounds", "orders and shipping on request", "just me, 19 · Madrid", "class of 2006\nPersonal Blog Artist",
]
USERS = ["ana.lab", "chess_team", "luis1999", "maria2012", "school_news", "official", "x1950y", "Kim", None, "dr.house", "rescued_shop"]
_two = f"(select a.c_custkey, a.s as bio, b.s as usr from {shaped_sql(BIOS)} a join {shaped_sql(USERS)} b using (c_custkey))"


def _profiles(t):
    a, b = shaped(t, BIOS).withColumnRenamed("s", "bio"), shaped(t, USERS).withColumnRenamed("s", "usr")
    return a.join(b, "c_custkey")


def _first(c: str, pattern: str) -> str:
    return f"coalesce(regexp_extract({c}, {quoted(pattern)}, 0), '')"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), {quoted(pattern)})"


def _reasons(cases: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {m} <> '' then '{n} (' || trim({m}) || ')'" for n, m in cases) + " else '' end"


@query(f"""with h as (select c_custkey, left(string_split(coalesce(bio, ''), chr(10))[1], 45) as head from {_two})
select c_custkey, case when {_has('head', '(?i)' + BANK.allowed)} then '' else coalesce(list_filter(regexp_extract_all(head, {quoted('(?i)' + BANK.category)}), lambda x: regexp_matches(x, '^[A-Z]'))[1], '') end as label from h""")
def cls_professional(t):
    return _profiles(t).select("c_custkey", P.professional("bio", BANK).alias("label"))


@query(f"""select c_custkey, {_reasons([("organisation's words".replace("'", "''"), _first('bio', '(?i)' + BANK.strong)), ("organisation''s handle", _first('usr', '(?i)' + BANK.handle)), ("place without a person", f"case when {_has('bio', '(?i)' + BANK.person)} then '' else {_first('bio', '(?i)' + BANK.weak)} end")])} as reason from {_two}""")
def cls_organisation(t):
    return _profiles(t).select("c_custkey", P.organisation("bio", "usr", BANK).alias("reason"))


@query(f"select c_custkey, case when {_has('bio', '(?i)' + BANK.home)} then '' else {_first('bio', '(?i)' + BANK.away)} end as place from {_two}")
def cls_out_of_region(t):
    return _profiles(t).select("c_custkey", P.out_of_region("bio", BANK).alias("place"))


_NON = _reasons([
    ("organisation''s handle", f"case when regexp_matches(lower(coalesce(usr, '')), {quoted(BANK.lab_handle)}) then lower(usr) else '' end"),
    ("title in the name", _first("nm", "(?i)" + BANK.title)),
    ("programme''s name", _first("nm", "(?i)" + BANK.programme)),
    ("programme''s words", _first("flat", "(?i)" + BANK.programme)),
    ("specialty", _first("nm || ' ' || flat", "(?i)" + BANK.specialty)),
    ("repeater", "case when own < 5 and others > own then own || ' to ' || others else '' end"),
])


@query(f"""with o as (select c_custkey, count(*) filter (o_orderstatus = 'O') as own, count(*) filter (o_orderstatus <> 'O') as others from customer left join orders on o_custkey = c_custkey group by 1),
p as (select c_custkey, usr, replace(coalesce(bio, ''), chr(10), ' ') as flat, (['Ana', 'Dr. Kim', 'Collective of one', 'Eng Lee'])[(c_custkey % 4)::int + 1] as nm, own, others from {_two} join o using (c_custkey)) select c_custkey, {_NON} as reason from p""")
def cls_non_person(t):
    own = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("own"), F.count_if(F.col("o_orderstatus") != "O").alias("others"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("Ana", "Dr. Kim", "Collective of one", "Eng Lee")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _profiles(t).join(own, "c_custkey").withColumn("nm", name).select("c_custkey", P.non_person("nm", "bio", "usr", "own", "others", BANK).alias("reason"))


@query(f"""with y as (select c_custkey, usr, 's' || (c_custkey % 5) as seed, try_cast(nullif(regexp_extract(coalesce(usr, ''), '(19[5-9]\\d|20[0-2]\\d)', 1), '') as int) as yr from {_two}),
a as (select *, case when yr between 1950 and 2014 then 2024 - yr end as age from y)
select c_custkey, age::int as age, case when lower(usr) = 'rescued_shop' then '' when seed = 's3' then 'seed dropped: s3' when {_has('usr', '(?i)' + BANK.institution)} then 'institution''s handle' when age is not null and age not between 15 and 29 then 'handle implies ' || age else '' end as reason from a""")
def cls_handle_institution(t):
    p = _profiles(t).withColumn("seed", F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string")))
    return p.select("c_custkey", P.year_in_handle("usr", 2024).alias("age"), P.handle_reason("usr", "seed", BANK, 2024, 15, 29, ["s3"], ["rescued_shop"]).alias("reason"))


@query(f"""with p as (select c_custkey, coalesce(bio, '') as b, {G.mask_sql("coalesce(bio, '')")} as masked, case when c_custkey % 2 = 0 then '15-18' else '18-24' end as band from {_two})
select c_custkey, {_reasons([("role", f"case when {_has('b', '(?i)' + BANK.student)} then '' else {_first('b', '(?i)' + BANK.role)} end"), ("family role", f"case when band = '15-18' then {_first('b', '(?i)' + BANK.weak_role)} else '' end"), ("age", f"regexp_extract(masked, {quoted(BANK.adult_age)}, 1)")])} as reason from p""")
def cls_adult_contradiction(t):
    band = F.when(F.col("c_custkey") % 2 == 0, "15-18").otherwise("18-24")
    return _profiles(t).withColumn("band", band).withColumn("masked", G.mask_dates(F.coalesce("bio", F.lit("")))).select("c_custkey", P.adult_contradiction("bio", "masked", "band", BANK, "15-18").alias("reason"))


@query("""with a as (select o_orderkey, (['yes', 'no', '', null])[(o_orderkey % 4)::int + 1] as q1, (['no', 'yes', null])[(o_orderkey % 3)::int + 1] as q2, (['no', 'no', 'yes', '', null])[(o_orderkey % 5)::int + 1] as q3,
  (['no', '', 'yes', 'no', 'no', null, 'no'])[(o_orderkey % 7)::int + 1] as q4, case when o_orderkey % 11 = 0 then 'yes' end as q5, (['no', 'yes', ''])[(o_orderkey // 3 % 3)::int + 1] as q6, case when o_orderkey % 2 = 0 then 'yes' else 'no' end as recent from orders)
select o_orderkey, case when nullif(q1, '') is null and nullif(q2, '') is null and nullif(q6, '') is null then null when q4 = 'yes' or q5 = 'yes' or (q6 = 'yes' and recent = 'yes') then 'high' when q3 = 'yes' or q6 = 'yes' then 'moderate' when q1 = 'yes' or q2 = 'yes' then 'low' else 'negative' end as category from a""")
def screener_category(t):
    k = F.col("o_orderkey")
    pick = lambda by, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (by % len(v) + 1).cast("int"))
    a = t("orders").select("o_orderkey", pick(k, "yes", "no", "", None).alias("q1"), pick(k, "no", "yes", None).alias("q2"), pick(k, "no", "no", "yes", "", None).alias("q3"), pick(k, "no", "", "yes", "no", "no", None, "no").alias("q4"), F.when(k % 11 == 0, "yes").alias("q5"), pick(F.floor(k / 3), "no", "yes", "").alias("q6"), F.when(k % 2 == 0, "yes").otherwise("no").alias("recent"))
    return a.select("o_orderkey", P.screener(["q1", "q2"], "q3", "q4", "q5", "q6", "recent").alias("category"))


# pages

PAGES = [
    None, "<html></html>", '<meta property="og:description" content="1,180 Followers, 25 Following, 1.2K Posts &amp; more"><p>12 posts 1,180 followers 25 following Ana &quot;x&quot; just me Follow</p>',
    "<p>This account is private</p><script>12 posts</script>", "<h1>Sorry, this page is not available</h1>", '<p>0 posts 3 followers 2 following</p><a href="/ana/p/A1/">x</a><a href="/bob/p/B2/">y</a><a href="/ana/p/A1/">z</a>',
    '<meta content="25.2K Followers, 7 Following, 8 Posts" property="og:description"><div>no counts here</div>', '<meta property="og:video" content="https://cdn.example/v.mp4?x=1&amp;y=2">"https://cdn.example/aa.mp4" "https://cdn.example/aaaa.mp4"', '"https://cdn.example/a.mp4" <b>"https://cdn.example/abcdef.mp4?q=1"</b>',
]
_PG = shaped_sql(PAGES, "pages", "page_id")
_META = r'(?is)<meta[^>]*property="og:description"[^>]*content="([^"]*)"'
_META_BACK = r'(?is)<meta[^>]*content="([^"]*)"[^>]*property="og:description"'


def _meta_sql(c: str = "s", name: str = "og:description") -> str:
    a, b = _META.replace("og:description", name), _META_BACK.replace("og:description", name)
    raw = f"coalesce(nullif(regexp_extract({c}, '{a}', 1), ''), regexp_extract({c}, '{b}', 1))"
    for x, y in X.ENTITIES:
        raw = f"replace({raw}, '{x}', {quoted(y)})"
    return raw


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(s, ''), '(?is)<(script|style|noscript|template|svg)[^>]*>.*?</(script|style|noscript|template|svg)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"
_count = lambda text, word: f"regexp_extract({text}, '(?i)([0-9.,]+[KM]?) {word}', 1)"


def _number(x: str) -> str:
    bare = f"replace(upper({x}), ',', '')"
    num = f"try_cast(regexp_replace({bare}, '[KM]$', '') as double)"
    return f"floor(case when right({bare}, 1) = 'K' then {num} * 1000 when right({bare}, 1) = 'M' then {num} * 1000000 else {num} end + 1e-9)::bigint"


@query(f"select page_id, {_meta_sql()} as description, {_meta_sql(name='og:video')} as video from {_PG}")
def html_meta(t):
    return shaped(t, PAGES, "pages", "page_id").select("page_id", X.html_meta("s", "og:description").alias("description"), X.html_meta("s", "og:video").alias("video"))


@query(f"""with v as (select page_id, {_VISIBLE} as v, {_meta_sql()} as og from {_PG}),
n as (select page_id, {', '.join(f"{_number(_count('v', w))} as v_{w}, {_number(_count('og', w))} as o_{w}" for w in ('posts', 'followers', 'following'))} from v)
select page_id, coalesce(v_posts, o_posts) as posts, coalesce(v_followers, o_followers) as followers, coalesce(v_following, o_following) as following, case when v_followers is not null then 'page' when o_followers is not null then 'meta' end as origin from n""")
def html_profile_counts(t):
    return shaped(t, PAGES, "pages", "page_id").select("page_id", X.profile_counts("s").alias("c")).select("page_id", "c.posts", "c.followers", "c.following", "c.origin")


STATES = [("missing", r"page is not available"), ("private", r"account is private")]


@query(f"""with v as (select page_id, {_VISIBLE} as v, {_meta_sql()} as og from {_PG})
select page_id, case when regexp_matches(v, '(?i)page is not available') then 'missing' when regexp_matches(v, '(?i)account is private') then 'private' when coalesce({_number(_count('v', 'posts'))}, {_number(_count('og', 'posts'))}) > 0 then 'public_with_posts' else 'public_without_posts' end as state,
  nullif(left(trim(regexp_extract(v, '(?i)following (.*?)(?: Follow\\b.*)?$', 1)), 500), '') as bio from v""")
def html_account_status(t):
    d = shaped(t, PAGES, "pages", "page_id").select("page_id", X.visible_text("s").alias("v"), X.profile_counts("s")["posts"].alias("posts"))
    return d.select("page_id", P.account_status("v", "posts", STATES).alias("state"), X.profile_bio("v").alias("bio"))


@query(rf"""with u as (select page_id, {_meta_sql(name='og:video')} as meta, list_sort(list_transform(regexp_extract_all(coalesce(s, ''), '"(https?://[^"]+\.mp4[^"]*)"', 1), lambda x: (-length(x), x))) as found from {_PG})
select page_id, coalesce(nullif(meta, ''), found[1][2]) as video from u""")
def html_video_url(t):
    return shaped(t, PAGES, "pages", "page_id").select("page_id", X.video_url("s").alias("video"))


@query(f"""with l as (select page_id, list_distinct(regexp_extract_all(coalesce(s, ''), 'href="([^"]+)"', 1)) as l from {_PG}) select page_id, len(list_filter(l, lambda x: starts_with(x, '/ana/'))) as own, len(list_filter(l, lambda x: not starts_with(x, '/ana/'))) as others from l""")
def html_links_split(t):
    links = X.html_links("s")
    return shaped(t, PAGES, "pages", "page_id").select("page_id", F.size(F.filter(links, lambda x: x.startswith("/ana/"))).alias("own"), F.size(F.filter(links, lambda x: ~x.startswith("/ana/"))).alias("others"))


# ages in free text

TEXTS = [
    None, "", "23 years old | Madrid", "just 19 ✨", "born 2004", "born 1951", "high school no. 12", "university 4th semester", "class of 2023", "gen 26 and 18 years old", "17 years, born 2004", "12.04.98 | 11:11 | $25 | 3x2 | 20%", "shop 100 items", "21 years old, class of 2021",
    "Followed by ana and 19 others", "²² years old", "master 27", "semester 6 of 8, 16",
]
_TX = shaped_sql(TEXTS, "documents", "doc_id")


def _texts(t):
    return shaped(t, TEXTS, "documents", "doc_id")


@query(f"select doc_id, {G.mask_sql(G.clean_sql('s'))} as masked from {_TX}")
def txt_mask_dates(t):
    return _texts(t).select("doc_id", G.mask_dates(G.clean("s")).alias("masked"))


@query(f"select doc_id, {G.clean_sql('s')} as cleaned from {_TX}")
def txt_strip_ui_noise(t):
    return _texts(t).select("doc_id", G.clean("s").alias("cleaned"))


_SIGNALS = f"""m as (select doc_id, s, {G.clean_sql('s')} as c, {G.mask_sql(G.clean_sql('s'))} as t, 2010 + doc_id % 14 as first_year from {_TX}),
g as (select doc_id, first_year, {G.explicit_sql('t')} as stated, {G.loose_sql('t')} as loose, {G.birth_sql('t', 2024)} as born, {G.cohort_sql('c', 2024)} as cohort, {G.level_sql('c')} as level from m)"""


@query(f"with {_SIGNALS} select doc_id, stated::int as stated, loose::int as loose, born::int as born, cohort::int as cohort, level::int as level, (10 + 2024 - first_year)::int as at_least from g")
def age_signals(t):
    d = _texts(t).select("doc_id", G.signals("s", 2024).alias("g"), (2010 + F.col("doc_id") % 14).alias("y"))
    return d.select("doc_id", "g.stated", "g.loose", "g.born", "g.cohort", "g.level", G.lower_bound("y", 2024).cast("int").alias("at_least"))


_COMBINED = f"""{_SIGNALS},
o as (select doc_id, 10 + 2024 - first_year as floor_, list_filter([(stated, 3), (case when stated is null then loose end, 2), (born, 2), (cohort, 1), (level, 1)], lambda x: x[1] is not null) as l from g),
k as (select doc_id, floor_, l[1][1] as age, l[1][2] as r, l[2][1] as other from o),
q as (select *, coalesce(age < floor_ - 1, false) as conflict, case when age < floor_ - 1 then case when r > 1 then 1 else 0 end else r end as r1 from k),
z as (select doc_id, age, conflict, case when abs(other - age) <= 2 and r1 = 2 then 3 else r1 end as r2 from q),
e as (select doc_id, age::int as age, conflict, case when age is null then 'none' else (['none', 'low', 'medium', 'high'])[r2 + 1] end as confidence, case when age between 15 and 17 then '15-17' when age between 18 and 21 then '18-21' when age between 22 and 25 then '22-25' when age between 26 and 29 then '26-29' when age is not null then 'outside' end as band from z)"""


@query(f"with {_COMBINED} select doc_id, age, conflict, confidence, band, coalesce(confidence in ('high', 'medium') and age between 15 and 29, false) as admitted from e")
def age_evidence(t):
    d = _texts(t).select("doc_id", G.combined("s", 2010 + F.col("doc_id") % 14, 2024).alias("e")).select("doc_id", "e.*")
    return d.select("doc_id", "age", "conflict", "confidence", G.band("age").alias("band"), G.admitted("age", "confidence").alias("admitted"))


@query(f"""with {_COMBINED}, w as (select age, 15 + doc_id % 15 as truth, band, case when 15 + doc_id % 15 <= 17 then '15-17' when 15 + doc_id % 15 <= 21 then '18-21' when 15 + doc_id % 15 <= 25 then '22-25' else '26-29' end as real_band from e)
select count(*) as n, count(age) as estimated, round(100 * count(age) / count(*)::double, 6) as coverage, round(avg(abs(age - truth)), 6) as mae, max(abs(age - truth))::bigint as worst, count(*) filter (band = real_band) as band_hits, count(*) filter (abs(age - truth) <= 2) as within_2 from w""")
def age_validate(t):
    d = _texts(t).select((15 + F.col("doc_id") % 15).alias("truth"), G.combined("s", 2010 + F.col("doc_id") % 14, 2024)["age"].alias("age"))
    return G.validated(d, "age", "truth").select("n", "estimated", F.round("coverage", 6).alias("coverage"), F.round("mae", 6).alias("mae"), "worst", "band_hits", "within_2")


CAPTIONS = [None, "today i turn 17", "turning 19 soon!", "happy 21st birthday to me", "my 20 at last", "i am 18 years old", "18 years of the clinic", "celebrating my 22", "my 45 cats", "i am 18 years old on 12.04.98", "turned 16 #17 @u18"]
_CP = f"(select a.doc_id, a.s, 2019 + doc_id % 5 as yr, doc_id % 40 as account from {shaped_sql(CAPTIONS, 'documents', 'doc_id')} a)"


@query(f"""with c as (select account, doc_id, yr, {G.mask_sql(G.caption_clean_sql('s'))} as t from {_CP}),
f as (select account, doc_id, yr, {G.caption_sql('t')} as x from c), k as (select account, doc_id, x.age + 2024 - yr as age, x.r as r from f where x.age between 12 and 34),
o as (select account, age, r, row_number() over (partition by account order by r desc, doc_id) as n from k), p as (select account, max(age) filter (n = 1) as age, max(r) filter (n = 1) as r, max(age) filter (n = 2) as other from o where n <= 2 group by account)
select account, age::int as age, case when abs(other - age) <= 1 or r = 2 then 'high' else 'medium' end as confidence from p""")
def age_captions(t):
    d = shaped(t, CAPTIONS, "documents", "doc_id").select((F.col("doc_id") % 40).alias("account"), "doc_id", "s", (2019 + F.col("doc_id") % 5).alias("yr"))
    return G.from_captions(d, "account", "doc_id", "s", "yr", 2024)
