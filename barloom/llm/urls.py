"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a regular expression and the literal tokens that any match must contain.
One pass over the urls counts in how many of them each rule token occurs; a rule is
then indexed under its rarest one. The tokens of a url fetch candidate rules, and only
those run their expressions, so the cost of a url doesn't grow with the rules that
share no rare token with it. Up to INLINE rules the index is a literal map of the plan
and nothing is shuffled but the token counts; a longer list is a table of postings that
the urls' tokens are joined with, and each url's hits are gathered again. Both give the
same rows.

Host rules (a host, all its subdomains, and a path prefix) are such patterns too; of
those that fit, the longest decides. Where none fits, any matching block pattern
blocks, else the url is allowed.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule
and is allowed; repeated rows get equal results; other columns are ignored; an empty
table gives an empty result; equally long rules that both fit are decided by the
larger rule string; kept columns named like a result give way to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._run import kept, packed, table, unpacked, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A longer list of rules isn't part of the plan, but a table.
INLINE = 500


@dataclass(frozen=True)
class Rule:
    """target: `site` is host and path, `url` the whole url in lower case. size 0: a pattern, else the length of a host rule."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    target: str = "url"
    size: int = 0


def host_rule(verdict: str, text: str) -> Rule:
    """A rule like `example.com/en/`: a host with all its subdomains, and how the path starts."""
    host, _, path = text.partition("/")
    whole = path.split("/")[:-1]  # the last piece may go on in the url
    literals = tuple(t for part in (*host.split("."), *whole) for t in re.findall("[a-z0-9]+", part.lower()))
    return Rule(text, verdict, "^(?:[^/]*\\.)?" + re.escape(host) + "/" + re.escape(path), literals, "site", len(text))


HOST_RULES = (
    host_rule("block", "com/en/"),
    host_rule("allow", "example.com/en/7"),
    host_rule("allow", "net/de/"),
    host_rule("block", "example.net/de/8"),
    host_rule("block", "org/es/"),
)
#: Patterns of the method's own, with the tokens that a match contains.
PATTERNS = (
    Rule("spam farms", "block", "^[a-z]+://[^/?#]*spam-farm\\.", ("spam", "farm")),
    Rule("adult hosts", "block", "^[a-z]+://([^/?#]*\\.)?porn[.]", ("porn",)),
    Rule("casinos", "block", "^[a-z]+://([^/?#]*[.-])?casino[.-]", ("casino",)),
    Rule("ad paths", "block", "/ads/", ("ads",)),
    Rule("sessions", "block", "[?&]sessionid=", ("sessionid",)),
    Rule("carts", "block", "/cart/checkout([/?#]|$)", ("cart", "checkout")),
    Rule("logins", "block", "/login([/?#]|$)", ("login",)),
    Rule("calendars", "block", "/calendar/[0-9]{4}/", ("calendar",)),
)


def host(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://(.*)$", 1))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://(.*)$", 1))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"))


_HIT = "struct<size:int,name:string,verdict:string>"


def _rarest(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """The rules under the token that the fewest urls have; rules without a token under the empty one."""
    words = sorted({t for r in rules for t in r.literals})
    often = dict.fromkeys(words, 0)
    if 0 < len(words) <= INLINE:
        held = F.array_intersect(_tokens(F.col("url")), F.array(*map(F.lit, words)))
        often |= {r.token: r.n for r in pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    elif words:
        asked = pages.sparkSession.createDataFrame([(w,) for w in words], "token string")
        counted = pages.select(F.explode(_tokens(F.col("url"))).alias("token")).join(asked, "token").groupBy("token").agg(F.count("*").alias("n"))
        often |= {r.token: r.n for r in counted.collect()}  # as many as the caller's list has
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (often[t], t)) if r.literals else "", []).append(i)
    return index


def _inline(rows: DataFrame, rules: tuple[Rule, ...], index: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """The kept columns, host, path, n_candidates and _hits of rows; index and rules are literals."""
    listed = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.target).alias("target"), F.lit(r.size).alias("size")) for r in rules))
    postings = F.create_map(*(x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ids)))))
    own = F.array_intersect(F.concat(_tokens(F.col("_whole")), F.array(F.lit(""))), F.array(*map(F.lit, sorted(index))))
    found = F.flatten(F.transform(own, lambda t: F.element_at(postings, t)))
    rows = rows.select(*keep, "host", "path", "_whole", "_site", F.inline(F.array(F.struct(found.alias("_found")))))
    hits = F.filter(F.transform("_found", lambda i: F.element_at(listed, i + 1)), lambda r: F.rlike(F.when(r["target"] == "site", F.col("_site")).otherwise(F.col("_whole")), r["pattern"]))
    return rows.select(*keep, "host", "path", F.size("_found").cast("long").alias("n_candidates"), F.inline(F.array(F.struct(F.transform(hits, lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))).alias("_hits")))))


def _joined(rows: DataFrame, rules: tuple[Rule, ...], index: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """The same from a table of postings, which Spark broadcasts if it is small enough."""
    listed = [(t, r.name, r.verdict, r.pattern, r.target, r.size) for t, ids in index.items() for r in map(rules.__getitem__, ids)]
    postings = rows.sparkSession.createDataFrame(listed, "_token string, name string, verdict string, pattern string, target string, size int")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    tokens = rows.select("_row", "_whole", "_site", F.explode(F.array_union(_tokens(F.col("_whole")), F.array(F.lit("")))).alias("_token"))
    fits = F.rlike(F.when(F.col("target") == "site", F.col("_site")).otherwise(F.col("_whole")), F.col("pattern"))
    met = tokens.join(postings, "_token").select("_row", F.when(fits, F.struct("size", "name", "verdict")).alias("hit"))
    hits = met.groupBy("_row").agg(F.count("*").alias("n_candidates"), F.collect_list("hit").alias("_hits"))
    out = rows.join(hits, "_row", "left")
    return out.select(*keep, "host", "path", F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"), F.coalesce("_hits", F.array().cast(f"array<{_HIT}>")).alias("_hits"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERNS, *keep: str) -> DataFrame:
    """The kept columns, host, path, rule, verdict, matched (names of all matching rules) and n_candidates of pages (url)."""
    given, keep = kept(keep, "host", "path", "rule", "verdict", "matched", "n_candidates"), ["row"]
    pages = packed(pages, given, url=F.col("url"))
    named = F.contains(F.col("url"), F.lit("://"))
    whole = F.translate(F.when(named, F.col("url")), UPPER, LOWER)  # null where no rule may look
    rows = pages.select(*keep, whole.alias("_whole"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("_site", F.when(F.col("_whole").isNotNull(), F.concat("host", "path")))
    if not rules:
        rows = rows.select(*keep, "host", "path", F.lit(0).cast("long").alias("n_candidates"), F.array().cast(f"array<{_HIT}>").alias("_hits"))
    else:
        index = _rarest(pages, rules)
        rows = (_inline if len(rules) <= INLINE else _joined)(rows, rules, index, keep)
    longest = F.array_max(F.filter("_hits", lambda r: r["size"] > 0))
    blocked = F.exists("_hits", lambda r: (r["size"] == 0) & (r["verdict"] == "block"))
    out = rows.select(
        *keep,
        "host",
        "path",
        longest["name"].alias("rule"),
        F.coalesce(longest["verdict"], F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.array_sort(F.transform("_hits", lambda r: r["name"])).alias("matched"),
        "n_candidates",
    )
    return unpacked(out, given, "host", "path", "rule", "verdict", "matched", "n_candidates")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), HOST_RULES + PATTERNS, "page_id").drop("matched", "n_candidates")


def _fits(rule: Rule) -> str:
    h, _, p = rule.name.partition("/")
    return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))"


_REST = "substr(url, strpos(url, '://') + 3)"
_BY_LENGTH = sorted(HOST_RULES, key=lambda r: -r.size)
OP4_SQL = rf"""
WITH p AS (
  SELECT page_id, url, coalesce(strpos(url, '://') > 0, false) AS named,
         translate(url, '{UPPER}', '{LOWER}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({_REST}, '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r AS (SELECT *, CASE {' '.join(f"WHEN {_fits(x)} THEN '{x.name}'" for x in _BY_LENGTH)} END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE {' '.join(f"WHEN rule = '{x.name}' THEN '{x.verdict}'" for x in HOST_RULES)}
       WHEN named AND ({' OR '.join(f"regexp_matches(low, '{x.pattern}')" for x in PATTERNS)}) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
