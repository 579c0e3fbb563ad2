"""URL filters: rules by host and path, and trust propagated over the link graph.

DataFrame operations only.  A url that no rule fits gets the verdict of its host:
trust flows along links from the hosts of allowed urls, distrust against them from
those of blocked ones (personalised PageRank both), and the larger share decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import attach, table, written


class Rule(NamedTuple):
    verdict: str
    text: str  # host and path, as ``example.org/en/``

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))
ROUNDS, DAMPING = 12, 0.85
#: Rounds go on while they add more than this to all shares together.
TOLERANCE = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<(?:a|area|link)\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, or nulls.

    Rules are configuration: their number is that of the given sequence.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, host: str, html_col: str = "html") -> DataFrame:
    """Distinct links between different hosts: src, dst, and the share of src's links."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(LINK), 1)).alias("dst"))
    found = found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> '' and src <> dst").distinct()
    return found


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust and distrust by personalised PageRank: ``rounds``, and more until the shares stay and no host is new.

    ``links`` has src and dst; ``seeds`` has host, allowed and blocked (weights).
    Trust walks along the links from the allowed seeds, distrust against them from
    the blocked ones; a walk that finds no link ends.  One join and one aggregation
    a round, written each time.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    edges = written(both.join(degree, ["kind", "src"]), "host-links")
    sums = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    start = seeds.select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.lit(float(sums[0] or 1))).alias("s")).unionByName(
        seeds.select(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / F.lit(float(sums[1] or 1))).alias("s"))
    ).filter("s > 0")
    start = written(start, "seeds")
    rank = start.select("kind", "host", (F.col("s") * (1 - damping)).alias("s"))
    if edges.take(1):
        before, k = None, 0
        while True:
            moved = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("s") * damping / F.col("degree")).alias("s"))
            back = start.select("kind", "host", (F.col("s") * (1 - damping)).alias("s"))
            rank = written(moved.unionByName(back).groupBy("kind", "host").agg(F.sum("s").alias("s")), "rank")
            k, now = k + 1, rank.agg(F.sum("s"), F.count("*")).first()
            # shares only grow from round to round, so their sums tell how much they changed
            if k >= rounds and before and now[0] - before[0] <= TOLERANCE and now[1] == before[1]:
                break
            before = now
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("s")).otherwise(0.0))
    return rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The verdict is the longest fitting rule's; else the host's: block if its
    distrust is more than its trust, else allow, as for hosts that neither reaches
    and urls without a host.  Null urls and those without ``://`` have an empty host
    and path; null html has no links; rows with null or repeated ids are judged each.
    Seeds weigh as many pages as a rule decided.  An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict})
    by_host = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    by_host = written(by_host, "hosts")
    scores = propagate(host_links(rows, "host"), by_host.filter("host <> ''"))
    scored = written(by_host.select("host", "pages").join(scores, "host", "left").select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "host-scores")
    found = attach(rows.drop("html"), scored, ["host"], "pages")
    own = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def oracle(rules: Sequence[Rule] = RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The same in DuckDB, with the rounds written out."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in ordered) + " END"
    pattern = LINK.replace("'", "''")
    parts = [
        "p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '" + _UPPER + "', '" + _LOWER + "') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"r AS (SELECT *, {case('text')} AS rule, {case('verdict')} AS ruled FROM p)",
        "h AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM r WHERE host <> '' GROUP BY host)",
        f"x AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{pattern}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM r) WHERE src <> '' AND src <> dst)",
        "y AS (SELECT 't' AS kind, src, dst FROM x UNION ALL SELECT 'd', dst, src FROM x)",
        "e AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM y)",
        f"s AS (SELECT 't' AS kind, host, {1 - damping} * a / (SELECT greatest(1, sum(a)) FROM h) AS s FROM h WHERE a > 0 UNION ALL SELECT 'd', host, {1 - damping} * b / (SELECT greatest(1, sum(b)) FROM h) FROM h WHERE b > 0)",
        "k0 AS (SELECT * FROM s)",
    ]
    parts += [f"k{i + 1} AS (SELECT kind, host, sum(s) AS s FROM (SELECT * FROM s UNION ALL SELECT e.kind, dst, k.s * {damping} / degree FROM e JOIN k{i} k ON e.kind = k.kind AND e.src = k.host) GROUP BY ALL)" for i in range(rounds)]
    parts.append(f"v AS (SELECT host, coalesce(sum(s) FILTER (kind = 'd'), 0) > coalesce(sum(s) FILTER (kind = 't'), 0) AS bad FROM k{rounds} GROUP BY host)")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN v USING (host)"


OP5_SQL = oracle()
