"""URL filters: host rules first, then pattern rules indexed by their rarest literal token.

Every pattern rule names the literal tokens that any URL it matches must contain. Each rule is filed under
the one of its tokens that is rarest among all URLs of the table; a URL's own tokens fetch the candidate
rules, and only those run their regular expression. Rules without a literal token are tried on every URL.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no host rule and is
judged by the patterns alone (null: none, so allowed); repeated rows are judged one by one; among host rules
the longest wins; an allowing pattern beats a blocking one; no match means ``allow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


#: The rules of the query contract.
HOST_RULES = (
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
)

#: Words that mark a host label, a path segment or a query key, with the verdict of each form.
WORDS = {
    "gambling": "baccarat betting bingo blackjack bookmaker casino casinos jackpot lottery poker roulette slots sportsbook wager",
    "adult": "adult camgirls erotic escort hookup nsfw nude porn sex strip webcam xxx",
    "pharmacy": "cialis levitra pharmacy pills steroids tramadol valium viagra xanax",
    "loans": "cashadvance forex loan loans mortgage payday",
    "advert": "adclick adserver adsystem banner banners clickbank doubleclick popunder popup sponsored tracker tracking",
    "junk": "cracked crackz keygen proxy replica serialz spam torrent warez",
}
SEGMENTS = "addtocart cart checkout feed login logout password print register search signin signup tag tags trackback unsubscribe wishlist"
KEYS = "affid aspsessionid gclid jsessionid phpsessid print replytocom sessionid share sid"


def word_rules() -> Iterator[PatternRule]:
    """A rule for each word and place; wherever one matches, its words stand alone between other characters than a-z and 0-9."""
    for kind, words in WORDS.items():
        for w in words.split():
            yield PatternRule(f"host:{kind}:{w}", "block", f"://([^/?#]*[^a-z0-9/?#])?{w}[^a-z0-9]", (w,))
            yield PatternRule(f"path:{kind}:{w}", "block", f"[./-]{w}[./-]", (w,))
    for w in SEGMENTS.split():
        yield PatternRule(f"segment:{w}", "block", f"/{w}([/?#.]|$)", (w,))
    for w in KEYS.split():
        yield PatternRule(f"key:{w}", "block", f"[?&;]{w}=", (w,))
    for a in ("account", "member", "user", "users"):
        for b in ("edit", "login", "preferences", "profile", "settings"):
            yield PatternRule(f"account:{a}:{b}", "block", f"/{a}/{b}([/?#]|$)", (a, b))


PATTERN_RULES = (
    PatternRule("link-farm", "block", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("archive", "allow", r"://web\.archive\.example\.org/", ("web", "archive", "example", "org")),
    # words that may be glued to others (cheappills, pornsite) are no tokens: tried on every URL
    PatternRule("pill-shop", "block", r"://([^/?#]*\.)?[a-z]*-?pills\.", ()),
    PatternRule("adult", "block", r"://([^/?#]*\.)?(xxx|porn)[a-z0-9-]*\.", ()),
    *word_rules(),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_verdicts(urls: DataFrame, rules: tuple[HostRule, ...]) -> DataFrame:
    """``urls`` (host, path) with ``rule`` and ``rule_verdict`` of the longest rule that fits. The rule list is a parameter, so it is one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is tried first, so it is added last
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def pattern_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with literal tokens, filed under the one that the fewest rows of ``urls`` contain."""
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    held = wanted.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(held, "token").groupBy("token").count()
    rarest = wanted.join(counts, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("least"))
    return rules.join(rarest.select("name", "least.token"), "name")


def pattern_verdicts(urls: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """``url`` (distinct) to ``pattern`` and ``pattern_verdict`` for the URLs that a pattern matches."""
    spark = urls.sparkSession
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("pattern_verdict", T.StringType()), T.StructField("regex", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])
    listed = spark.createDataFrame([(r.name, r.verdict, r.regex, list(r.tokens)) for r in rules], schema)
    indexed = pattern_index(urls, listed)
    fetched = urls.select("url", F.explode("tokens").alias("token")).join(indexed.drop("tokens"), "token").where(F.expr("lower(url) rlike regex"))
    hits = fetched.select("url", "name", "pattern_verdict")
    for r in rules:
        if not r.tokens:
            hits = hits.unionByName(urls.where(F.lower("url").rlike(r.regex)).select("url", F.lit(r.name).alias("name"), F.lit(r.verdict).alias("pattern_verdict")))
    best = F.min(F.struct("pattern_verdict", "name"))  # 'allow' sorts before 'block'
    return hits.groupBy("url").agg(best.alias("b")).select("url", F.col("b.name").alias("pattern"), F.col("b.pattern_verdict").alias("pattern_verdict"))


def filter_urls(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that decided, else null)."""
    judged = host_verdicts(pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), host_rules)
    urls = pages.where("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    found = judged.join(pattern_verdicts(urls, pattern_rules), "url", "left")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "pattern_verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("pattern")).alias("pattern")
    )


def op9_url_filters(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql(rules: tuple[PatternRule, ...], verdict: str) -> str:
    return " or ".join(f"regexp_matches(lower(url), '{r.regex}')" for r in rules if r.verdict == verdict)


def _name_sql(rules: tuple[PatternRule, ...]) -> str:
    order = sorted(rules, key=lambda r: (r.verdict, r.name))
    return "case " + " ".join(f"when regexp_matches(lower(url), '{r.regex}') then '{r.name}'" for r in order) + " end"


OP9_SQL = f"""
with p as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path
  from pages),
rules(rhost, rpath, rverdict) as (values {', '.join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in HOST_RULES)}),
r as (
  select *, case when rhost is null then {_name_sql(PATTERN_RULES)} end pattern from (
    select p.*, rhost, rpath, rverdict, row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last) k
    from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) where k = 1)
select page_id, host, path, rhost || rpath as rule,
  coalesce(rverdict, case when {_sql(PATTERN_RULES, 'allow')} then 'allow' when {_sql(PATTERN_RULES, 'block')} then 'block' else 'allow' end) as verdict, pattern
from r
"""
