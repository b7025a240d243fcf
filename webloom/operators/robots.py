"""robots.txt rules as tables, and decisions by first match."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.functions.columns import origin
from webloom.operators.fetch import latest

RULES = "origin string, group_ord int, agents array<string>, delay int, rules array<struct<ord:int,allow:boolean,path:string>>"


def parse_robots(text: str) -> list[dict]:
    """Groups of a robots.txt in file order: agents in small letters, whole-number delay, rules with quoted paths.

    As the standard library reads it: a blank line ends a group only once it has rules; an unknown line is skipped.
    """
    groups: list[dict] = []
    agents: list[str] = []
    rules: list[dict] = []
    delay = None
    state = 0  # 0: before agents, 1: in agents, 2: in rules

    def end() -> None:
        nonlocal agents, rules, delay
        if agents:
            groups.append({"agents": agents, "delay": delay, "rules": [r | {"ord": i} for i, r in enumerate(rules)]})
        agents, rules, delay = [], [], None

    for line in text.splitlines():
        if not line:
            if state == 1:
                agents, rules, delay, state = [], [], None, 0
            elif state == 2:
                end()
                state = 0
        line = line.split("#", 1)[0].strip()
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if state == 2:
                end()
            agents.append(unquote(value).lower())
            state = 1
        elif name in ("disallow", "allow") and state:
            path = quote(unquote(value)) if "?" not in value else quote(unquote(value), safe="/?=&;:@,$!*'()+~%")
            rules.append({"allow": name == "allow" or not value, "path": path})
            state = 2
        elif name == "crawl-delay" and state:
            if value.isdigit():
                delay = int(value)
            state = 2
    if state == 2:
        end()
    return groups


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rule groups per origin: of repeated rows the greatest counts; a status other than 200 has no rules (allow all)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[o, i, g["agents"], g["delay"], g["rules"]] for o, t in zip(frame["origin"], frame["text"]) for i, g in enumerate(parse_robots(t))]
            yield pd.DataFrame(rows, columns=["origin", "group_ord", "agents", "delay", "rules"]).astype({"delay": "Int32"})

    one = latest(robots, "origin", ("status", "text")).where("status = 200 and text is not null").select("origin", "text")
    return one.mapInPandas(run, RULES)


def group_for(rules: DataFrame, agent: str) -> DataFrame:
    """(origin, delay, rules) of the group that speaks to an agent: the first named one, else the one for all."""
    token = agent.split("/")[0].lower()
    named = F.exists("agents", lambda a: (a != "*") & F.lit(token).contains(a))
    everyone = F.array_contains("agents", "*")
    pick = F.min_by(F.struct("delay", "rules"), F.struct(F.when(named, 0).otherwise(1), "group_ord"))
    return rules.where(named | everyone).groupBy("origin").agg(pick.alias("g")).select("origin", "g.delay", "g.rules")


@F.pandas_udf(StringType())
def quoted_path(url: pd.Series) -> pd.Series:
    """Path and query of a URL, percent-quoted; ``/`` for none."""

    def one(u):
        try:
            parts = urlsplit(unquote(u))
            return quote(parts.path + (f"?{parts.query}" if parts.query else ""), safe="/?=&;:@,$!*'()+~%") or "/"
        except ValueError:
            return "/"

    return pd.Series([None if u is None else one(u) for u in url], dtype=object)


def decisions(urls: DataFrame, robots: DataFrame, agent: str = "webloom", url: str = "url") -> DataFrame:
    """Each url with ``allowed`` and ``crawl_delay``: the first rule whose path is a prefix decides; none allows.

    An origin that was never fetched allows everything. The rules of origins are few and small; Spark broadcasts them
    when their size allows and otherwise joins by shuffle with skewed origins split.
    """
    groups = group_for(robots_rules(robots), agent)
    keyed = urls.withColumn("origin", origin(F.col(url))).withColumn("quoted", quoted_path(F.col(url)))
    joined = keyed.join(groups, "origin", "left")
    first = F.get(F.filter("rules", lambda r: F.col("quoted").startswith(r["path"])), F.lit(0))
    return joined.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).withColumnRenamed("delay", "crawl_delay").drop("quoted", "rules", "origin")


def robots_stats(decided: DataFrame, robots: DataFrame) -> DataFrame:
    """One row: origins fetched and urls blocked."""
    cached = robots.agg(F.count_distinct("origin").alias("origins_cached"))
    return cached.crossJoin(decided.agg(F.count_if(~F.col("allowed")).alias("blocked")))  # two single rows
