"""URL filtering by nested host and path rules: a sort-merge range join. DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot (`com.example.`), so a rule's host is the
interval of keys that begin with its own. Intervals of keys nest or are apart. Rules and distinct hosts are sorted
together, and a sweep keeps a stack of the rules that are open: a slot for each number of labels, holding the last rule
of that many labels, which is open as long as the swept key begins with it. Each url then takes the longest of its
host's open rules whose path begins its own path.

Scale: a host is one row however many urls it has. The sorted hosts are dealt in ranges of about equal counts; the
rules that are open where a range begins, at most one host for each of its first key's labels, are put before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.common import cut

#: verdict, host and path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts: distinct, non-empty; rules: host, path, verdict. (host, open): the rules of each host's stack, where any is open."""
    keyed = rules.select("host", "path", "verdict", host_key(F.col("host")).alias("key")).where("host is not null and host != ''")
    grouped = cut(keyed.groupBy("key").agg(F.collect_set(F.struct("host", "path", "verdict")).alias("rules")).withColumn("depth", F.size(F.split("key", r"\.")) - 1))
    depths = [x[0] for x in grouped.select("depth").distinct().orderBy("depth").collect()]  # a host has 127 labels at most
    if not depths:
        return hosts.select("host", F.expr("array()").cast("array<struct<host:string,path:string,verdict:string>>").alias("open")).limit(0)
    empty = F.lit(None).cast(grouped.schema["rules"].dataType)
    starts = grouped.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "depth", "rules")
    ahead = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast("int").alias("depth"), empty.alias("rules"))
    dealt = cut(starts.unionByName(ahead).repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    lows = dealt.groupBy("part").agg(F.min("key").alias("low"))  # a row for each range
    labels = F.split(F.expr("substring(low, 1, length(low) - 1)"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    carried = lows.select("part", F.explode(prefixes).alias("key")).join(starts, "key").select(*dealt.columns)  # rules that are open where a range begins
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = lambda d: F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(sweep)
    swept = carried.unionByName(dealt).select("kind", "host", "key", *[slot(d).alias(f"slot{d}") for d in depths]).where("kind = 1")
    held = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.rules")) for d in depths]
    stack = F.flatten(F.filter(F.array(*held), lambda x: x.isNotNull()))
    return swept.select("host", stack.alias("open")).where(F.size("open") > 0)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    A rule (verdict, host, path) fits its host and all subdomains of it, if the url's path begins with the rule's; the
    longest wins: host and path together, then the host, and of equal rules the one whose verdict sorts last. rule is
    null and the verdict `default` where none fits. A url that is null or has no :// has an empty host and path, which
    no rule fits. Rows that repeat get a row each; other columns are ignored; an empty table gives an empty table.
    """
    if not isinstance(rules, DataFrame):
        made = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
        nothing = F.expr("cast(array() as array<struct<host:string,path:string,verdict:string>>)")
        rules = pages.sparkSession.range(1).select(F.inline(F.array(*made) if made else nothing))  # made in the JVM
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = urls.where("host != ''").select("host").distinct()
    ruled = urls.join(open_rules(hosts, rules), "host", "left")
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("all"), F.length(r["host"]).alias("size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = F.array_max(ranked)
    return ruled.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
urls AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.host || r.path DESC, r.verdict DESC) AS place
  FROM (SELECT DISTINCT * FROM urls) u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, '{DEFAULT}') AS verdict
FROM urls u LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON f.page_id = u.page_id AND f.host = u.host AND f.path = u.path
"""
