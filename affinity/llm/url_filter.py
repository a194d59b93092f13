"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression together with the literal tokens that any
URL it fits must hold.  The rule is filed under the one of these tokens that is
rarest among the URLs at hand.  A URL's tokens fetch the rules filed under them,
and only those few run their regular expressions.  All of it is DataFrame
operations: one count of the tokens that occur in rules, one join on the token.
The rules themselves are literals of the plan, or a table.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed.  Repeated URLs are judged row by row.  Rules without any
literal token cannot be indexed and are refused.  Rules are a list or a table.  Ties in length go to the
lexically smaller rule.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.common import ascii_lower

#: More rules than this are not broadcast but joined by a shuffle on the token.
BROADCAST_RULES = 100_000
TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows; ``weight`` decides among fitting rules of a kind."""

    name: str
    kind: str  # "site" for host and path rules, "pattern" for the general patterns
    action: str
    regex: str
    tokens: tuple[str, ...]
    weight: int


def site_rule(text: str, action: str) -> Rule:
    """A rule ``host/path``: the host and all its subdomains, paths that start so."""
    host, slash, path = text.partition("/")
    host = host.lower()
    path = slash + path
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # the last piece of the path may go on in the URL, so it is no whole token
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, re.sub(r"[A-Za-z0-9]+$", "", path))
    return Rule(text, "site", action, regex, tuple(t.lower() for t in whole), len(text))


def word_rule(words: str, action: str = "block") -> Rule:
    """A rule for a run of words in the host, as ``casino win`` in ``m.casino-win.example.com``."""
    parts = words.split()
    regex = r"^(?:[^/]*[^a-z0-9/])?" + r"[^a-z0-9/]*".join(map(re.escape, parts)) + r"(?:[^a-z0-9/][^/]*)?(?:/|$)"
    return Rule(words, "pattern", action, regex, tuple(parts), len(words))


def pattern_rule(text: str, action: str = "block") -> Rule:
    """A rule in the syntax of filter lists, over host and path.

    ``*`` stands for anything, ``^`` for a separator or the end, ``||`` at the
    beginning for the host or any of its parent domains, ``|`` at either end for
    that end.  Runs of letters and digits that cannot go on in the URL are tokens.
    """
    body, start, end = text, r"", ""
    if body.startswith("||"):
        body, start = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    regex = "".join({"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|$)"}.get(c) or re.escape(c) for c in body)
    # a token is whole if a sign, or an anchored end, stands on either side of it
    whole = [m.group().lower() for m in re.finditer(TOKEN, body) if (m.start() and body[m.start() - 1] != "*" or not m.start() and start) and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and end)]
    return Rule(text, "pattern", action, start + regex + end, tuple(whole), len(text))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table of literals: name, kind, action, regex, tokens, weight."""
    if bad := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token cannot be indexed: {bad}")
    schema = "name string, kind string, action string, regex string, tokens array<string>, weight int"
    rows = [F.struct(*[F.lit(x) for x in (r.name, r.kind, r.action, r.regex)], F.array(*map(F.lit, r.tokens)), F.lit(r.weight)) for r in rules]
    table = spark.range(1).select(F.inline(F.array(*rows).cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))
    return table


#: Fixed values of the query: site rules as its contract names them.
SITE_RULES = [
    site_rule("com/en/", "block"),
    site_rule("example.com/en/7", "allow"),
    site_rule("net/de/", "allow"),
    site_rule("example.net/de/8", "block"),
    site_rule("org/es/", "block"),
]
#: Host words that mark gambling, adult, advertising, drug and spam sites.
PATTERN_RULES = [word_rule(w) for w in ("casino", "bets", "poker", "adult", "porn", "ads track", "adserver", "pills", "viagra", "spam", "malware", "phishing")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, pattern and candidates (rules fetched) for every row.

    rules: a list, or a table as ``rule_table`` makes.  Among fitting site rules the
    longest wins; without one, any fitting pattern rule decides, the longest first;
    without that, the verdict is ``allow``.
    """
    host, path = url_parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.filter(F.split(ascii_lower(F.concat_ws("/", "host", "path")), r"[^a-z0-9]+"), lambda t: t != ""))
    # the row number keeps repeated rows apart
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "host", "path", tokens.alias("_tokens"))

    given = rule_table(pages.sparkSession, rules) if isinstance(rules, list) else rules
    few = len(rules) <= BROADCAST_RULES if isinstance(rules, list) else given.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    small = F.broadcast if few else lambda df: df
    # what decides among fitting rules, as one value that a minimum picks: site rules first, then the heaviest, then by name
    priority = F.struct((F.col("kind") != "site").alias("pattern"), (-F.col("weight")).alias("weight"), "name", "action")
    table = given.select(priority.alias("priority"), "regex", F.transform("tokens", ascii_lower).alias("tokens"))
    of_rules = table.select(F.explode("tokens").alias("token")).distinct()
    counts = rows.select(F.explode("_tokens").alias("token")).join(small(of_rules), "token").groupBy("token").count()
    # each rule is filed under its rarest token; unseen tokens count 0
    spread = table.select("priority", "regex", F.explode("tokens").alias("token")).join(counts, "token", "left")
    filed = spread.groupBy("priority", "regex").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("_t")).select(F.col("_t.token").alias("token"), "priority", "regex")

    fetched = rows.select("_row", "_id", "host", "path", F.explode_outer("_tokens").alias("token")).join(small(filed), "token", "left")
    fits = F.when(F.expr("concat(host, path) rlike regex"), F.col("priority"))
    best = fetched.groupBy("_row", "_id", "host", "path").agg(F.min(fits).alias("best"), F.count("regex").alias("candidates"))
    is_site = ~F.col("best.pattern")
    return best.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.when(is_site, F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
        F.when(~is_site, F.col("best.name")).alias("pattern"),
        "candidates",
    )
