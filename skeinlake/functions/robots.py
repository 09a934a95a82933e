"""robots.txt rules as nested columns: parsing, agent selection, longest-prefix decisions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

RULES = "groups array<struct<agents:array<string>,allows:array<string>,disallows:array<string>,delay_ms:long>>, sitemaps array<string>"


def parse(content: Column) -> Column:
    """Struct of agent groups and sitemaps of a robots file.

    Comments are dropped, directives are case-insensitive, a user-agent line behind rules opens a new
    group, empty rules are ignored, and only absolute web addresses count as sitemaps. Null content
    gives no groups, which allows everything.
    """
    empty = F.array().cast("array<string>")
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"^\s+|\s+$", ""))
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.regexp_replace(F.regexp_extract(x, "^([^:]*):", 1), r"\s+$", "")).alias("k"), F.regexp_replace(F.regexp_extract(x, "^[^:]*:(.*)$", 1), r"^\s+|\s+$", "").alias("v")),
    )
    group = F.struct(empty.alias("agents"), empty.alias("allows"), empty.alias("disallows"), F.lit(None).cast("long").alias("delay_ms"))
    none = F.array().cast("array<struct<agents:array<string>,allows:array<string>,disallows:array<string>,delay_ms:long>>")
    start = F.struct(none.alias("done"), group.alias("cur"), F.lit(False).alias("ruled"))

    def step(acc, x):
        cur, v = acc["cur"], x["v"]
        agent = F.array(F.lower(v))
        opens = F.struct(agent.alias("agents"), empty.alias("allows"), empty.alias("disallows"), F.lit(None).cast("long").alias("delay_ms"))
        joins = cur.withField("agents", F.concat(cur["agents"], agent))
        is_agent, allow, deny = x["k"] == "user-agent", (x["k"] == "allow") & (v != ""), (x["k"] == "disallow") & (v != "")
        delay = (x["k"] == "crawl-delay") & v.rlike(r"^\d+(?:\.\d+)?$")
        has = F.size(cur["agents"]) > 0
        fresh = is_agent & (acc["ruled"] | ~has)
        return F.struct(
            F.when(is_agent & acc["ruled"] & has, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"),
            F.when(fresh, opens)
            .when(is_agent, joins)
            .when(allow, cur.withField("allows", F.concat(cur["allows"], F.array(v))))
            .when(deny, cur.withField("disallows", F.concat(cur["disallows"], F.array(v))))
            .when(delay, cur.withField("delay_ms", F.round(v.try_cast("double") * 1000).cast("long")))
            .otherwise(cur)
            .alias("cur"),
            F.when(is_agent, F.lit(False)).otherwise(acc["ruled"] | x["k"].isin("allow", "disallow", "crawl-delay")).alias("ruled"),
        )

    groups = F.aggregate(pairs, start, step, lambda acc: F.when(F.size(acc["cur"]["agents"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
    maps = F.transform(F.filter(pairs, lambda x: (x["k"] == "sitemap") & x["v"].rlike("(?i)^https?://")), lambda x: x["v"])
    return F.struct(groups.alias("groups"), maps.alias("sitemaps"))


def for_agent(rules: Column, agent: str) -> Column:
    """The first group with an agent that is part of the crawler's name, else the last group for ``*``; null where there is none."""
    name = F.lit(agent.lower())
    named = F.filter(rules["groups"], lambda g: F.exists(g["agents"], lambda a: (a != "*") & (a != "") & F.contains(name, a)))
    default = F.filter(rules["groups"], lambda g: F.array_contains(g["agents"], "*"))
    return F.coalesce(F.get(named, F.lit(0)), F.try_element_at(default, F.lit(-1)))


def allowed(rules: Column, path: Column, agent: str) -> Column:
    """Plain prefixes; the longer of the longest matching allow and disallow wins, a tie denies. No rules allow."""
    g = for_agent(rules, agent)
    longest = lambda xs: F.coalesce(F.array_max(F.transform(F.filter(xs, lambda x: F.startswith(path, x)), F.octet_length)), F.lit(-1))
    return F.when(g.isNull(), F.lit(True)).otherwise((longest(g["disallows"]) < 0) | (longest(g["allows"]) > longest(g["disallows"])))


def delay_ms(rules: Column, agent: str) -> Column:
    return for_agent(rules, agent)["delay_ms"]
