"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path with the literal tokens that any matching URL must hold. Rules come
from filter lists (list_rules reads their syntax; url_rules.txt is the default) or are host and path rules. A rule is
filed under the token that the fewest URLs hold. A URL's own tokens fetch its candidate rules, and regular expressions
run for those alone; the few rules that have no literal token run for every URL. Built-in column functions only.

Up to INLINE_RULES rules stand in the plan. More are joined by token; URLs post only tokens that a rule is filed under,
and the rules, which the driver holds anyway, are broadcast up to MOST_CHARACTERS of them.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and gets the
default verdict. Repeated URLs are judged alike; an empty table gives an empty result. Extra columns of the input are
carried through, but those named host, path, rule, verdict or pattern are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import ascii_lower

TOKEN_SPLIT = "[^A-Za-z0-9]+"
#: Up to so many rules are held in the plan itself, which needs no shuffle; more go through a join on the token.
INLINE_RULES = 256
#: Characters of names and patterns up to which the rules of a join are broadcast.
MOST_CHARACTERS = 32_000_000


@dataclass(frozen=True)
class UrlRule:
    """name is reported for rules with weight > 0 (host and path rules); others only give the verdict. The rule of the
    greatest weight decides. tokens: lower-case literal tokens that a matching URL holds."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_path_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits host and its subdomains where the path starts with path. The longest such rule wins."""
    literal = host + path
    whole = re.split(TOKEN_SPLIT, literal)
    if path and re.match("[A-Za-z0-9]", literal[-1]):
        whole = whole[:-1]  # a longer token of the URL may start with it
    return UrlRule(literal, action, r"^(?:[^/]*\.)?" + re.escape(literal), tuple(t for t in whole if t), len(literal))


_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"
#: Weights of a filter list's rules and of its exceptions.
LISTED, EXCEPTED = -2, -1


def list_rule(line: str) -> UrlRule | None:
    """The rule of one line of a filter list; None for comments and empty lines. Letters match in either case."""
    name = line.strip()
    if not name or name.startswith("!"):
        return None
    body = name.removeprefix("@@")
    action, weight = ("allow", EXCEPTED) if body != name else ("block", LISTED)
    if len(body) > 2 and body[0] == body[-1] == "/":
        inner = body[1:-1]
        re.compile(inner)
        plain = re.fullmatch(r"(?:[A-Za-z0-9/_-]|\\[./-])+", inner)  # else no literal is sure to be in a match
        whole = re.split(TOKEN_SPLIT, inner.replace("\\", "").lower())[1:-1] if plain else []
        return UrlRule(name, action, f"(?i){inner}", tuple(t for t in whole if t), weight)
    anchored, ended = body.startswith("||"), body.endswith("|")
    literal = body.removeprefix("||").removesuffix("|")
    pattern = "".join({"*": ".*", "^": _SEPARATOR}.get(c, re.escape(c)) for c in literal)
    # a run of letters and digits is a token if nothing can lengthen it: what stands beside it is no wildcard or open end
    marked = ("^" if anchored else "*") + literal.lower() + ("^" if ended else "*")
    whole = [m[0] for m in re.finditer("[a-z0-9]+", marked) if marked[m.start() - 1] != "*" and marked[m.end()] != "*"]
    return UrlRule(name, action, "(?i)" + (r"^(?:[^/]*\.)?" if anchored else "") + pattern + (r"\z" if ended else ""), tuple(whole), weight)


def list_rules(lines: Iterable[str]) -> tuple[UrlRule, ...]:
    """The rules of a filter list, each once."""
    return tuple(dict.fromkeys(rule for line in lines if (rule := list_rule(line))))


@cache
def default_rules() -> tuple[UrlRule, ...]:
    return list_rules(files("vecloom.llm").joinpath("url_rules.txt").read_text(encoding="utf-8").splitlines())


#: The rules of the query's contract.
CONTRACT_RULES = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path, both empty where the URL has no "://"."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def token_counts(parts: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many rows hold each of the rules' tokens; at most one number a token comes to the driver."""
    held = F.explode(F.array_intersect(_tokens(), F.array(*map(F.lit, tokens))))
    return {r[0]: r[1] for r in parts.select(held.alias("token")).groupBy("token").count().collect()} if tokens else {}


def _tokens() -> Column:
    return F.array_distinct(F.split(ascii_lower(F.concat("host", "path")), TOKEN_SPLIT))


def rarest_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> dict[str, list[UrlRule]]:
    """Each rule with tokens under the one with the smallest count."""
    index: dict[str, list[UrlRule]] = {}
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] | None = None, url: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """pages with host, path, rule (the name of the longest fitting host and path rule), verdict and pattern (the name
    of the filter list's rule that decided, if one did). rules: if not given, CONTRACT_RULES and default_rules()."""
    rules = (*CONTRACT_RULES, *default_rules()) if rules is None else rules
    parts = with_parts(pages, url)
    counts = token_counts(parts, sorted({t for r in rules for t in r.tokens}))
    index, always = rarest_index(rules, counts), [r for r in rules if not r.tokens]
    fit = _inline(parts, index, always) if len(rules) <= inline_rules else _joined(parts, index, always)
    own = fit["_fit"]["weight"] > 0
    return fit.withColumns({"rule": F.when(own, F.col("_fit.name")), "verdict": F.coalesce("_fit.action", F.lit(default)), "pattern": F.when(~own, F.col("_fit.name"))}).drop("_fit")


_FIT = "struct<weight:int,name:string,action:string>"


def _struct(rule: UrlRule) -> Column:
    return F.struct(F.lit(rule.weight).alias("weight"), F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"), F.lit(rule.pattern).alias("pattern"))


def _best(candidates: Column) -> Column:
    subject = F.concat("host", "path")
    hits = F.filter(candidates, lambda c: F.rlike(subject, c["pattern"]))
    return F.array_max(F.transform(hits, lambda c: F.struct(c["weight"].alias("weight"), c["name"].alias("name"), c["action"].alias("action"))))


def _inline(parts: DataFrame, index: dict[str, list[UrlRule]], always: list[UrlRule]) -> DataFrame:
    some = [F.array(*map(_struct, always))] if always else []
    if index:
        filed = F.create_map(*[x for token, rules in index.items() for x in (F.lit(token), F.array(*map(_struct, rules)))])
        held = F.array_intersect(_tokens(), F.array(*map(F.lit, index)))
        some.append(F.flatten(F.transform(held, lambda t: F.try_element_at(filed, t))))
    return parts.withColumn("_fit", _best(F.concat(*some)) if some else F.lit(None).cast(_FIT))


def _joined(parts: DataFrame, index: dict[str, list[UrlRule]], always: list[UrlRule]) -> DataFrame:
    """For long rule lists. Distinct host and path pairs are judged once, so a URL that fills a third of the
    table is one row here; only fitting rules reach the shuffle."""
    spark = parts.sparkSession
    rows = [(t, r.weight, r.name, r.action, r.pattern) for t, rules in index.items() for r in rules]
    filed = spark.createDataFrame(rows, "token string, weight int, name string, action string, pattern string")
    small = sum(len(r[2]) + len(r[4]) for r in rows) <= MOST_CHARACTERS
    filed, names = (F.broadcast(x) if small else x for x in (filed, filed.select("token").distinct()))
    keys = parts.select("host", "path").distinct()
    tokens = keys.withColumn("token", F.explode(_tokens())).join(names, "token", "left_semi")
    hits = tokens.join(filed, "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("weight", "name", "action")).alias("_found"))
    joined = parts.join(best, ["host", "path"], "left")
    rest = _best(F.array(*map(_struct, always))) if always else F.lit(None).cast(_FIT)
    return joined.withColumn("_fit", F.greatest("_found", rest)).drop("_found")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _op1_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({r.weight}, {quote(r.name)}, {quote(r.action)}, {quote(r.pattern)})" for r in default_rules())
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rh, rp, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), listed(weight, name, action, pattern) AS (VALUES {listed}
), spam AS (
  SELECT host, path, max(struct_pack(weight := weight, name := name, action := action)) AS spam
  FROM (SELECT DISTINCT host, path FROM parts), listed WHERE regexp_matches(host || path, pattern) GROUP BY ALL
), best AS (
  SELECT p.*, (SELECT max_by(struct_pack(name := rh || rp, action := action), length(rh || rp)) FROM rules
               WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS fit, spam
  FROM parts p LEFT JOIN spam USING (host, path)
)
SELECT page_id, host, path, fit.name AS rule, coalesce(fit.action, spam.action, 'allow') AS verdict,
       CASE WHEN fit IS NULL THEN spam.name END AS pattern
FROM best
"""


OP1_SQL = _op1_sql()
