"""URL filter: host and path rules first, then a weighted vocabulary matched by Aho-Corasick.

A term counts only between boundaries (neither neighbour is an ASCII letter or digit). One strict term rejects; soft
terms reject when at least SOFT_HITS different ones occur and their weights reach SOFT_WEIGHT. Null URLs and URLs
without `://` have an empty host and path, no rule, and are judged by the vocabulary like all others.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.llm.common import worker_value

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT = ("casino", "porn", "xxx", "adult", "escort", "viagra", "cialis", "phishing", "malware", "warez", "hentai",
          "sexcam", "betting", "gambling", "poker", "payday")
SOFT = {"ads": 1.0, "ad": 0.5, "track": 1.0, "tracker": 1.0, "spam": 1.5, "farm": 0.5, "cheap": 1.0, "pills": 1.0, "pharmacy": 1.0,
        "free": 0.5, "bet": 1.0, "bets": 1.0, "win": 0.5, "bonus": 1.0, "slots": 1.0, "dating": 1.0, "loan": 1.0, "loans": 1.0,
        "crack": 1.0, "keygen": 1.5, "torrent": 1.0, "nude": 1.5, "sexy": 1.0, "click": 0.5, "popup": 1.0, "banner": 0.5,
        "replica": 1.0, "discount": 0.5, "lottery": 1.5, "jackpot": 1.5, "x": 0.25}
SOFT_HITS = 2
SOFT_WEIGHT = 1.5


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all its subdomains, for paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lowered(url: Column) -> Column:
    return F.translate(url, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lowered(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does; equal lengths go by the text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _automaton(strict: tuple, soft: dict) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        a.add_word(term, (term, term in strict, soft.get(term, 0.0)))
    a.make_automaton()
    return a


def judged(url: Column, strict: tuple = STRICT, soft: dict | None = None, hits: int = SOFT_HITS, weight: float = SOFT_WEIGHT) -> Column:
    """Struct of the number of strict hits, of different soft terms, their weight, and whether the URL is rejected."""
    terms = SOFT if soft is None else soft

    @F.pandas_udf("strict int, soft int, weight double, rejected boolean")
    def counted(urls: pd.Series) -> pd.DataFrame:
        automaton = worker_value(f"urls{hash((strict, tuple(sorted(terms.items()))))}", lambda: _automaton(strict, terms))
        out = []
        for url in urls:
            text, sure, found = (url or ""), 0, {}
            for end, (term, is_strict, w) in automaton.iter(text):
                start = end - len(term)
                if (start >= 0 and text[start].isascii() and text[start].isalnum()) or (
                        end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalnum()):
                    continue
                if is_strict:
                    sure += 1
                else:
                    found[term] = w
            total = sum(found.values())
            out.append((sure, len(found), total, sure > 0 or (len(found) >= hits and total >= weight)))
        return pd.DataFrame(out, columns=["strict", "soft", "weight", "rejected"])

    return counted(lowered(url))


def verdict(pages, rules: list[Rule]):
    """pages (url, any more) with host, path, rule and verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, own = rule_for(F.col("host"), F.col("path"), rules)
    out = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("_own", own)
    method = F.when(judged(F.col("url"))["rejected"], "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_own", method)).drop("_own")


def verdict_sql(rules: list[Rule], strict: tuple = STRICT, soft: dict | None = None) -> str:
    """The same over table pages in DuckDB SQL, as page_id, host, path, rule, verdict."""
    terms = SOFT if soft is None else soft
    between = "regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)')"
    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))")
            for r in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)]
    rule = " ".join(f"WHEN {f} THEN '{r.text}'" for r, f in fits)
    own = " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in fits)
    sure = between.format("(" + "|".join(strict) + ")")
    found = " + ".join(f"(CASE WHEN {between.format(t)} THEN 1 ELSE 0 END)" for t in terms)
    weight = " + ".join(f"(CASE WHEN {between.format(t)} THEN {w} ELSE 0 END)" for t, w in terms.items())
    return f"""WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {own} WHEN {sure} THEN 'block' WHEN {found} >= {SOFT_HITS} AND {weight} >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
