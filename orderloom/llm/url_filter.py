"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern of literal text, * for any text and ^ for a separator (any
character but letters and digits, or an end). It fits anywhere in a URL, case aside. Its literal tokens, runs of letters
and digits with a separator or another literal character on both sides, must be whole tokens of any URL it matches. Token
counts over all URLs pick each rule's rarest one for the index; a URL's tokens
fetch candidate rules by an equi-join, and only those run as regular expressions.
A rule without a whole token (*banner*, /ads*) is indexed in the same way by the
rarest of its runs of three characters, or of two, or one where it has no longer ones, and a rule of
separators only is a candidate for every URL. URLs keep only those tokens and runs that some rule
asks for, before anything is shuffled or counted. Any number of rules is taken, as a list or as a table with a column rule.

As a regular expression, a rule looks for its parts between stars in order, each at its first place
after the one before, so the time is linear in the length of a URL.

Hosts are decided first by literal (host, path) rules, the longest that fits;
pattern rules decide what those leave open.

Verdicts depend on the URL alone, so distinct URLs are judged once; the only
rows joined back are the URLs that a pattern blocks. Null URLs and URLs without
:// have empty host and path, fit no rule and are allowed; so is an empty URL. Null rules are ignored, and repeated ones
count once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm._shared import materialize, table

HOST_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
PATTERN_RULES = (
    "^free^bets^", "^casino^", "^cheap^pills^", "^adult^", "^spam^farm^", "^ads^track^", "^poker^online^", "^payday^loans^",
    "^xxx^", "^warez^", "^torrent^download^", "^replica^watches^", "^viagra^", "^escort^", "^click^bait^*^win^", "^lottery^winner^",
    "^sportsbook^", "^slots^", "^roulette^", "^blackjack^", "^betting^odds^", "^jackpot^", "^pharmacy^online^", "^cialis^", "^weight^loss^pills^", "^porn^",
    "^webcam^girls^", "^hookup^", "^crack^keygen^", "^serial^keys^", "^nulled^", "^phishing^", "^malware^", "^get^rich^quick^", "^forex^signals^", "^binary^options^",
    "^crypto^giveaway^", "^miracle^cure^", "^essay^writing^service^", "^buy^followers^", "^link^farm^", "^doorway^", "^ad^click^", "^popunder^", "^tracker^pixel^",
    "^affiliate^redirect^*^offer^", "://ads.*", "^banner^ads^", "*-online-casino-*", "*freemoney*",
)
SEPARATOR = r"(?:\A|\z|[^a-z0-9])"
#: Lengths of the runs that index rules without a whole token, the best first.
RUNS = (3, 2, 1)


def regex_of(rule: Column) -> Column:
    """The rule as a regular expression over lower-case text: its parts in order, none tried at a later place once found."""
    escaped = lambda p: F.replace(F.regexp_replace(p, r"([^\p{L}\p{N}\s^])", r"\\$1"), F.lit("^"), F.lit(SEPARATOR))
    parts = F.filter(F.split(F.lower(rule), r"\*+"), lambda p: p != "")
    return F.concat(F.lit(r"\A"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("(?>(?s:.*?)"), escaped(p), F.lit(")"))), ""))


def named(pieces: Column, kind: str) -> Column:
    return F.transform(F.array_distinct(pieces), lambda p: F.concat(F.lit(kind), p))


def runs_of(text: Column, size: int) -> Column:
    """Every run of size characters, from each place in turn."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def pieces_of(rule: Column) -> Column:
    """What any URL that the rule matches holds: its whole tokens (marked t), else its longest runs (marked by their length)."""
    tokens = F.regexp_extract_all(F.lower(rule), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0))
    literals = F.split(F.lower(rule), r"[*^]+")
    found = F.array(F.lit("0"))
    in_each = lambda size: F.flatten(F.transform(literals, lambda p: runs_of(p, size)))
    for size in reversed(RUNS):
        runs = in_each(size)
        found = F.when(F.size(runs) > 0, named(runs, f"{size}")).otherwise(found)
    return F.when(F.size(tokens) > 0, named(tokens, "t")).otherwise(found)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)


def longest_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        found = F.when(fits(host, path, rule), F.struct(F.lit(rule[1] + rule[2]).alias("rule"), F.lit(rule[0]).alias("verdict"))).otherwise(found)
    return found


def rules_of(spark: SparkSession, patterns) -> DataFrame:
    """rule, pattern and pieces; patterns: a list of rules, or a table with a column rule."""
    if not isinstance(patterns, DataFrame):
        patterns = spark.range(1).select(F.explode(F.array(*map(F.lit, patterns)).cast("array<string>")).alias("rule"))
    rule = F.col("rule")
    return patterns.where("rule is not null").select("rule").distinct().select("rule", regex_of(rule).alias("pattern"), pieces_of(rule).alias("pieces"))


def held_pieces(urls: DataFrame, asked: DataFrame) -> DataFrame:
    """url and piece: which of the asked pieces each distinct URL holds."""
    kinds = {r.kind for r in asked.select(F.substring("piece", 1, 1).alias("kind")).distinct().collect()}  # five at most
    low = F.lower("url")
    pieces = [named(runs_of(low, size), f"{size}") for size in RUNS if f"{size}" in kinds]
    if "t" in kinds:
        pieces.append(named(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), "t"))
    if "0" in kinds:
        pieces.append(F.array(F.lit("0")))
    all_ = F.concat(*pieces) if pieces else F.array().cast("array<string>")
    return urls.where("url is not null").select("url", F.explode(all_).alias("piece")).join(asked, "piece", "left_semi")


def rule_index(held: DataFrame, rules: DataFrame) -> DataFrame:
    """piece and pattern of each rule, under its rarest piece."""
    pieces = rules.select("rule", "pattern", F.explode("pieces").alias("piece"))
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece").alias("piece")))
    return pieces.join(counts, "piece", "left").groupBy("rule", "pattern").agg(rarest.alias("r")).select(F.col("r.piece").alias("piece"), "pattern")


def blocked_urls(urls: DataFrame, patterns=PATTERN_RULES) -> DataFrame:
    """The URLs, in a column url of distinct values, that some pattern rule matches."""
    rules = materialize(rules_of(urls.sparkSession, patterns), "url-rules")
    held = materialize(held_pieces(urls, rules.select(F.explode("pieces").alias("piece")).distinct()), "url-pieces")
    return held.join(rule_index(held, rules), "piece").where(F.expr("lower(url) rlike pattern")).select("url").distinct()


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of pages with page_id and url."""
    rows = pages.select("page_id", "url")
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", longest_rule(F.col("host"), F.col("path"), host_rules).alias("found"))
    hit = blocked_urls(rows.where("found is null and host <> ''").select("url").distinct(), patterns).withColumn("hit", F.lit(True))
    rows = rows.join(hit, "url", "left")
    method = F.when(F.col("hit") & F.col("found").isNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_sql() -> str:
    literal = lambda p: re.sub(r"([^\w\s*^])", r"\\\1", p.lower()).replace("*", "(?s:.*)").replace("^", "(?:[^a-z0-9]|^|$)")
    any_pattern = " OR ".join(f"regexp_matches(lower(url), '{literal(p)}')" for p in PATTERN_RULES)
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in HOST_RULES)
    return rf"""
WITH u AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE {cases} END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE rule {verdicts} ELSE CASE WHEN host <> '' AND ({any_pattern}) THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
