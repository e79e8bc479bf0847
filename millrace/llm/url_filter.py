"""URL filters: host and path rules, then a weighted URL vocabulary counted by an Aho-Corasick automaton.

A rule (host, path prefix, verdict) fits its host and all subdomains where the url's path starts with the rule's path;
the longest fitting rule decides. Other urls are judged by vocabulary: all terms are found in one pass of the automaton
over the url, a hit counts only between boundaries (no ASCII letter or digit on either side), and the url is blocked when
its distinct terms weigh `most` = 2 or more: one strict term (weight 2) or two soft ones (weight 1). The vocabulary is a
table of (term, weight); `vocabulary()` reads the library's own from url_terms.tsv, or any other of that form.

Defined results: null urls and urls without :// have an empty host and path, fit no rule and are judged by what text they
have (null: allow); repeated rows are judged alike; each url is judged by itself, so an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .util import UPPER

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Terms, lower-cased, and their weights from lines `term, tab, weight`; lines that begin with # are comments."""
    text = Path(path or Path(__file__).with_name("url_terms.tsv")).read_text(encoding="utf-8")
    rows = [line.split("\t") for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {r[0].lower(): float(r[1]) for r in rows}


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The fitting rule as written (host and path) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def vocabulary_hits(weights: Mapping[str, float]) -> Column:
    """A function of a url column: how many distinct terms with boundaries on both sides it has, and what they weigh."""

    @pandas_udf("terms int, weight double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for urls in batches:
            found = []
            for url in urls:
                text = (url or "").lower()
                hits = set()
                for end, term in automaton.iter(text):
                    before, after = text[end - len(term) : end - len(term) + 1] if end >= len(term) else "", text[end + 1 : end + 2]
                    if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
                        hits.add(term)
                found.append((len(hits), float(sum(weights[t] for t in hits))))
            yield pd.DataFrame(found, columns=["terms", "weight"])

    return count


def judge_urls(urls: DataFrame, url_col: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES, weights: Mapping[str, float] | None = None, most: float = 2) -> DataFrame:
    """The rows with host, path, rule, term_hits, term_weight and verdict (allow or block); other columns are kept, and those
    with the names of these results replaced."""
    host, path = host_and_path(F.col(url_col))
    hits = vocabulary_hits(weights or vocabulary()).asNondeterministic()
    made = "_judged"
    while made in urls.columns:
        made = f"_{made}"
    split = urls.withColumn(made, F.struct(host.alias("host"), path.alias("path"), hits(F.col(url_col)).alias("hits")))
    rule, ruled = longest_rule(F.col(f"{made}.host"), F.col(f"{made}.path"), rules)
    own = F.when(F.col(f"{made}.hits.weight") >= most, "block").otherwise("allow")
    results = {"host": F.col(f"{made}.host"), "path": F.col(f"{made}.path"), "rule": rule, "term_hits": F.col(f"{made}.hits.terms"), "term_weight": F.col(f"{made}.hits.weight"), "verdict": F.coalesce(ruled, own)}
    return split.withColumns(results).drop(made)
