"""URL filter rules by a sort-merge range join on reversed-host keys."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules swept at once: a bound on what is broadcast. Longer lists are swept in blocks, each in the same pass.
BLOCK_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.substr(url, F.instr(url, F.lit("://")) + 3)
    return F.when(F.coalesce(F.instr(url, F.lit("://")), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    rest = F.substr(url, F.instr(url, F.lit("://")) + 3)
    return F.when(F.coalesce(F.instr(url, F.lit("://")), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def key_of(host: str) -> str:
    """Labels from the last to the first, a dot after each: a host and its subdomains are the keys that begin so, the
    interval up to the same key with / for its last dot."""
    return ".".join(reversed(host.split("."))) + "."


class PathRules:
    """The rules of one host, sorted by path: a path is the interval of those that begin with it. Each knows the rule of
    the innermost interval around it, so that the rules that fit a path are a chain from its place in the order."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = sorted(rules)
        self.paths = [r[0] for r in self.rules]
        self.around: list[int] = []
        stack: list[int] = []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.around.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that the path begins with."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.around[i]
        return self.rules[i][1:] if i >= 0 else None


class RuleSweep:
    """A sorted block of rules. Each host's interval holds its path rules; nested intervals are kept on a stack."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        hosts: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            hosts.setdefault(key_of(host), []).append((slash + path, rule, verdict))
        self.low = sorted(hosts)
        self.rules = [PathRules(hosts[k]) for k in self.low]

    def sweep(self, keys: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """Longest fitting rule and its verdict for each (key, path); one pass over both sorted sides."""
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(keys)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        stack: list[int] = []
        at = 0
        for i in order:
            key = keys[i]
            while at < len(self.low) and self.low[at] <= key:
                while stack and not self.low[at].startswith(self.low[stack[-1]]):
                    stack.pop()
                stack.append(at)
                at += 1
            while stack and not key.startswith(self.low[stack[-1]]):
                stack.pop()
            best: tuple[str, str] | None = None
            for host in stack:
                found = self.rules[host].longest(paths[i])
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
            if best:
                out[i] = best
        return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict (the rule's, else `default`).

    rules: (rule, verdict), a rule being host/path-prefix; it fits its host and all subdomains where the path starts
    with its own; the longest fitting rule wins, of equal rules the first by verdict. Urls are sorted within each Arrow
    batch and swept against the sorted rules, so pages aren't shuffled, whatever share of them one host has.
    Null urls have an empty host and path and fit no rule; null rules are left out; repeated rows are judged each.
    """
    lines = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    n = max(1, -(-lines.count() // BLOCK_RULES))
    out = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(pages[url_col].cast("string")).alias("host"), path_of(pages[url_col].cast("string")).alias("path"))
    out = out.withColumn("found", F.lit(None).cast("struct<rule:string,verdict:string>"))
    for k in range(n):
        block = [(r.rule, r.verdict) for r in lines.where(F.pmod(F.xxhash64("rule"), F.lit(n)) == k).toLocalIterator()]
        hit = _sweeper(pages.sparkSession.sparkContext.broadcast(RuleSweep(block)))("host", "path")
        longer = F.col("found").isNull() | (F.length(F.col("hit")["rule"]) > F.length(F.col("found")["rule"]))
        out = out.withColumn("hit", hit).withColumn("found", F.when(F.col("hit")["rule"].isNotNull() & longer, F.col("hit")).otherwise(F.col("found"))).drop("hit")
    return out.select("page_id", "host", "path", F.col("found")["rule"].alias("rule"), F.coalesce(F.col("found")["verdict"], F.lit(default)).alias("verdict"))


def _sweeper(shared):
    @F.pandas_udf("rule string, verdict string")
    def run(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.sweep([key_of(h) for h in host], list(path)), columns=["rule", "verdict"])

    return run
