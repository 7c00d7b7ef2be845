"""Operator 4: URL filters whose rules are indexed by their rarest literal token.

A rule is a pattern with a regular expression and the literal tokens that every URL it
fits must contain. The rule is filed under the one of its tokens that the fewest URLs
contain (counted over the whole table). A URL's own tokens fetch the rules filed
under them; only those run their regular expression. Rules without a literal are few
and always run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small, without

#: Rules that one index may hold: it is sent to every worker.
MAX_RULES = 200_000

_TOKEN = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {i: i + 32 for i in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without ://."""
    m = _HOST.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def tokens_of(s: str) -> list[str]:
    return _TOKEN.findall(s.translate(_UPPER))


@dataclass(frozen=True)
class Rule:
    """verdict is block or allow; text names the rule. rank: the highest wins, ties go to
    the earlier rule. The regular expression is searched in host + path."""

    verdict: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    rank: int
    base: bool = field(default=False)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host, its subdomains, and paths that start with the rule's."""
    text = host + path
    # A path may go on inside its last token, so that one is no token of every URL.
    inner = _TOKEN.findall(path) if not path[-1:].isalnum() else _TOKEN.findall(path)[:-1]
    return Rule(verdict, text, r"\A(?:[^/]*\.)?" + re.escape(text), tuple(tokens_of(host) + [t for t in inner if t == t.lower()]), 1_000_000 + len(text), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """Filter list form: * stands for anything, ^ for a separator or the end, a leading
    || for the start of a host label; other characters are literal, in any case."""
    body = pattern.removeprefix("||")
    rx = (r"\A(?:[^/]*\.)?" if body != pattern else "") + "".join({"*": "[^\n]*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    # A token counts only where the pattern itself bounds it.
    bounded = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", body.translate(_UPPER))
    starts, ends = body != pattern or not body[:1].isalnum(), not body[-1:].isalnum()
    if bounded and not starts and body.lower().startswith(bounded[0]):
        bounded = bounded[1:]
    if bounded and not ends and body.lower().endswith(bounded[-1]):
        bounded = bounded[:-1]
    return Rule(verdict, pattern, "(?i:" + rx + ")", tuple(bounded), len(pattern))


#: The rules that the query is given, longest first where they meet.
SITES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The operator's own rules for URLs that no site rule fits.
PATTERNS = (
    ("block", "||spam-farm."), ("block", "||cheap-pills."), ("block", "-pills."), ("block", "-casino."), ("block", "||casino-"),
    ("block", "/spam/"), ("block", "/ads/*"), ("block", "^adserver^"), ("block", "*/phishing/*"), ("allow", "||example.com/fr/"),
)
#: Numbered hosts below any example domain. They share a token that most URLs have, so only
#: the index by the rarest token keeps them from being fetched for these.
NUMBERED = 10_000


def rules() -> list[Rule]:
    numbered = [pattern_rule("block", f"||ad{i}.example.") for i in range(NUMBERED)]
    return [site_rule(*s) for s in SITES] + [pattern_rule(*p) for p in PATTERNS] + numbered


class Index:
    """token -> places of the rules filed under it."""

    def __init__(self, found: list[Rule], counts: dict[str, int]):
        self.rules = found
        self.patterns: dict[int, re.Pattern[str]] = {}  # compiled when a URL first fetches them
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(found):
            if r.tokens:
                self.filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def pattern(self, i: int) -> re.Pattern[str]:
        if i not in self.patterns:
            self.patterns[i] = re.compile(self.rules[i].regex, re.S)
        return self.patterns[i]

    @property
    def compiled(self) -> list[re.Pattern[str]]:
        return [self.pattern(i) for i in range(len(self.rules))]

    def candidates(self, subject: str) -> set[int]:
        out = set(self.always)
        for t in set(tokens_of(subject)):
            out.update(self.filed.get(t, ()))
        return out

    def best(self, url: str | None) -> tuple[str, str, Rule | None]:
        host, path = host_and_path(url)
        if not host and not path:
            return host, path, None
        subject = f"{host}{path}"
        fits = [i for i in self.candidates(subject) if self.pattern(i).search(subject)]
        return host, path, self.rules[max(fits, key=lambda i: (self.rules[i].rank, -i))] if fits else None


def token_counts(pages: DataFrame, wanted: set[str], url: str = "url") -> dict[str, int]:
    """Of the rules' tokens only: how many URLs of the whole table contain each."""
    if len(wanted) > 20 * MAX_RULES:
        raise ValueError("too many tokens")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url).cast("string")), F.lit("[a-z0-9]+"), F.lit(0)))
    asked = small(pages.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "t string"), len(wanted))
    rows = pages.select(F.explode(tokens).alias("t")).join(asked, "t").groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def judge(pages: DataFrame, found: list[Rule] | None = None, url: str = "url") -> DataFrame:
    """pages plus host, path, rule (a site rule's text or null), verdict and filter (the
    text of the operator's own rule that decided, or null).

    The longest fitting site rule decides; else the longest own rule; else allow. A
    null or empty URL, or one without ://, has an empty host and path, fits no rule
    and is allowed. Repeated rows stay; an empty table gives an empty result; columns
    of pages named like the results give way to them.
    """
    found = rules() if found is None else found
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ship(pages.sparkSession)
    pages = without(pages, ["host", "path", "rule", "verdict", "filter"])
    index = Index(found, token_counts(pages, {t for r in found for t in r.tokens}, url))

    @F.pandas_udf("host string, path string, rule string, verdict string, filter string")
    def judged(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in urls:
            rows = [index.best(u) for u in part]
            yield pd.DataFrame({
                "host": [h for h, _, _ in rows], "path": [p for _, p, _ in rows],
                "rule": [r.text if r and r.base else None for _, _, r in rows],
                "verdict": [r.verdict if r else "allow" for _, _, r in rows],
                "filter": [r.text if r and not r.base else None for _, _, r in rows],
            })

    rows = pages.withColumn("__judged", judged(F.col(url).cast("string")))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns], "__judged.*")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "filter")


ORACLE = r"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), '') as h, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') as path from pages),
p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
r as (select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule, lower(host || path) as s from p),
f as (select *, case when rule is not null or s = '' then null
    when regexp_matches(s, '^([^/]*\.)?example\.com/fr/') then '||example.com/fr/'
    when regexp_matches(s, '^([^/]*\.)?ad[1-9][0-9]{1,3}\.example\.') then '||ad' || regexp_extract(s, '^([^/]*\.)?ad([1-9][0-9]{1,3})\.example\.', 2) || '.example.'
    when regexp_matches(s, '^([^/]*\.)?cheap-pills\.') then '||cheap-pills.'
    when regexp_matches(s, '^([^/]*\.)?ad[0-9]\.example\.') then '||ad' || regexp_extract(s, '^([^/]*\.)?ad([0-9])\.example\.', 2) || '.example.'
    when regexp_matches(s, '[^a-z0-9_.%-]phishing/') and contains(s, '/phishing/') then '*/phishing/*'
    when regexp_matches(s, '^([^/]*\.)?spam-farm\.') then '||spam-farm.'
    when regexp_matches(s, '[^a-z0-9_.%-]adserver([^a-z0-9_.%-]|$)') then '^adserver^'
    when regexp_matches(s, '^([^/]*\.)?casino-') then '||casino-'
    when contains(s, '-casino.') then '-casino.'
    when contains(s, '-pills.') then '-pills.'
    when contains(s, '/spam/') then '/spam/'
    when contains(s, '/ads/') then '/ads/*' end as filter from r)
select page_id, host, path, rule,
       case when rule is not null then case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end
            when filter is null or filter = '||example.com/fr/' then 'allow' else 'block' end as verdict, filter
from f
"""
