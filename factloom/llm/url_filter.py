"""URL filters as a sort-merge range join.

A host's canonical key is its labels in reverse, each closed by a dot
("www.example.com" -> "com.example.www."), so a rule's host and all of its
subdomains are one interval of keys, and the intervals of any two rules nest or
are disjoint. A sweep over the sorted interval ends keeps a stack of the rules
that are open; between two ends the stack is constant. The compiled sweep is a short table
(first key, stack), and the join carries the latest of its rows along the urls
in key order: one sort and a window. Rules for paths are then the first entry of
the stack, longest rule first, whose path begins the url's.

The window's partitions are even shares of the rows by hash, not hosts, so a host that
owns a third of the urls is spread like any other. The table of intervals is repeated in
every share, so shares have several times as many urls as it has rows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Urls in a share of the sweep, and how many there are at least for each interval that the share repeats.
SHARE_ROWS = 1 << 18
URLS_PER_END = 8


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(rules: tuple) -> list[tuple[str, list[Rule]]]:
    """(first key, rules open from there on, longest first) in key order. Each end costs what its stack holds."""
    of_host: dict[str, list[Rule]] = defaultdict(list)
    for r in dict.fromkeys(rules):
        of_host[r.host].append(r)
    ends = []
    for host in of_host:
        key = ".".join(reversed(host.split("."))) + "."
        ends += [(key, 1, host), (key[:-1] + "/", 0, host)]  # "/" follows "." in code-point order
    out, stack = [("", [])], []
    for key, opens, host in sorted(ends, key=lambda e: (e[0], e[1], len(e[2]))):
        if opens:
            stack.append(host)
        else:
            assert stack.pop() == host
        held = sorted((r for h in stack for r in of_host[h]), key=lambda r: (-len(r.name), r.name, r.verdict))
        out.append((key, held))
    return list(dict(out).items())


def judge(pages: DataFrame, rules: tuple = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", shares: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A null url, or one without ://, has an empty host and path, no rule and the
    default verdict. Of the rules that fit, the one with the longest host + path wins
    (ties: code-point order). Repeated rows are judged separately; other
    columns are not read.
    """
    spark = pages.sparkSession
    stacks = [{"key": k, "stack": [{"path": r.path, "rule": r.name, "verdict": r.verdict} for r in held]} for k, held in sweep(rules)]
    kind = "array<struct<key string, stack array<struct<path string, rule string, verdict string>>>>"
    rows = pages.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE_ROWS))
    n = shares or max(1, min(wanted, rows // (URLS_PER_END * len(stacks))))
    # the table is one literal, so that it costs no row code however long it is
    ends = spark.range(n).select(F.col("id").cast("int").alias("share"), F.explode(F.from_json(F.lit(json.dumps(stacks)), kind)).alias("e")).select("share", "e.key", "e.stack")
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    left = urls.select("id", "host", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("id", "host", "path"), F.lit(n)).cast("int").alias("share"), F.lit(1).alias("is_url"))
    merged = left.unionByName(ends.select("key", "stack", "share", F.lit(0).alias("is_url")), allowMissingColumns=True)
    order = Window.partitionBy("share").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.select("id", "host", "path", "is_url", F.last("stack", ignorenulls=True).over(order).alias("stack")).where("is_url = 1")
    first = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return swept.select("id", "host", "path", first.alias("r")).select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict")
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
OP3_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES_SQL}),
p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS cut FROM pages
), u AS (
  SELECT r, page_id, CASE WHEN cut > 0 THEN regexp_extract(substr(url, cut + 3), '^[^/?#]*') ELSE '' END AS raw,
         CASE WHEN cut > 0 THEN regexp_extract(substr(url, cut + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p
), h AS (
  SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
), j AS (
  SELECT h.*, rules.host || rules.path AS rule, rules.verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rules.host || rules.path) DESC, rules.host || rules.path) AS k
  FROM h LEFT JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM j WHERE k = 1
"""
