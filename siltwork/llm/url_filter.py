"""URL rules with link-graph propagation for the hosts that no rule judges.

Pages' links give weighted edges between hosts; a relative link is an edge of its host to itself. A host is
a trusted seed by the share of its pages that an allow rule matches, and a blocked one by the share that a
block rule matches. Trust flows along links from the trusted seeds (personalised PageRank). Distrust flows
against them from the blocked seeds: a host gets the distrust of the hosts that it links to, by the share of
its links, so distrust is the chance that a surfer who starts at the host and stops with probability 0.15
at each step stops at a blocked page. A link farm of a single blocked host so has 0.85, however many such farms
there are, and a host that has a third of its links there some 0.28. A page without a rule is blocked if its
host's distrust is at least `threshold` and larger than its trust. A link bought from a trusted host that has no other
gives 0.1275 of trust, so it clears no farm; it takes the links of several trusted hosts.

Scores are whole numbers of 1 / SCALE, so sums don't depend on their order and reruns agree. An iteration is
one join of both scores with the edges and a sum that combines before the shuffle; hubs are split by Spark's
skew join. Iterations end when no score changes by more than CHANGE, which leaves at most 6 * CHANGE to come.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialised, need

SCALE = 10**9
DAMPING = 85  # hundredths of a score that follow links
CHANGE = SCALE // 1000  # of a score, up to which it counts as settled
ITERATIONS = 200  # 0.85 ** 200 of the seeds' mass is below any change
#: (verdict, host, path) of the production rules
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(_behind_scheme(url), F.lit("")), "^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(_behind_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the page's or above it and whose path begins the page's."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, html_column: str) -> DataFrame:
    """pages(host, html) as src, dst, weight. Links of other schemes than // and :// are relative."""
    link = F.col("link")
    target = F.when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link))).when(
        F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), host_of(link)
    )
    other = F.regexp_like(link, F.lit("^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"))  # mailto: and such, and places in the page
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_column).cast("string"), F.lit("")), F.lit("""(?i)<a\\s[^>]*?href\\s*=\\s*["']([^"']*)["']"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(hrefs).alias("link"))
    links = links.select("src", F.coalesce(target, F.when(~other, F.col("src"))).alias("dst"))
    return links.filter("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: int = DAMPING, change: int = CHANGE, iterations: int = ITERATIONS) -> DataFrame:
    """hosts(host, allowed, blocked) and edges(src, dst, weight) as (host, trust, distrust).

    trust = (1 - d) allowed + d * the sum over links to the host of the linking host's trust by its share of links;
    distrust = (1 - d) blocked + d * the mean over the host's own links of their hosts' distrust. A host without
    links out counts as linking to itself. Hosts are distinct and contain every end of an edge.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    own = hosts.join(out, F.col("host") == F.col("src"), "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), *(F.lit(1).cast("long").alias(c) for c in ("weight", "out")))
    edges = edges.join(out, "src").select("src", "dst", "weight", "out").union(own)
    ways = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "weight", "out", F.lit(True).alias("along")).union(edges.select("dst", "src", "weight", "out", F.lit(False)))
    ways = materialised(ways, "host-edges")
    scores = hosts.select("host", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"))
    # score * weight in decimal: scores are at most SCALE times the hosts' number
    share = lambda c, on: F.sum(F.when(F.col("along") == on, F.expr(f"cast({c} as decimal(38,0)) * weight div out"))).cast("long")
    mixed = lambda seed, got: F.expr(f"({seed} * {100 - damping} + coalesce({got}, 0L) * {damping}) div 100")
    for _ in range(iterations):
        given = ways.join(scores, F.col("from") == F.col("host")).groupBy("to").agg(share("trust", True).alias("t"), share("distrust", False).alias("d"))
        new = hosts.join(given, F.col("host") == F.col("to"), "left").select("host", mixed("allowed", "t").alias("trust"), mixed("blocked", "d").alias("distrust"))
        new = materialised(new, "host-scores")
        before = scores.toDF("b_host", "b_trust", "b_distrust")
        moved = new.join(before, F.col("host") == F.col("b_host")).filter((F.abs(F.col("trust") - F.col("b_trust")) > change) | (F.abs(F.col("distrust") - F.col("b_distrust")) > change))
        scores = new
        if not moved.limit(1).count():
            return scores
    raise RuntimeError(f"scores did not settle in {iterations} iterations")


def judge(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", rules=RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """Each row of df as id, host, path, rule (null without one), verdict, trust and distrust (0 to 1 as a rule).

    A null URL or one without :// has an empty host and path; nothing speaks against it, so it is allowed.
    Null html has no links. Rows with null or repeated ids are rows like others.
    """
    need(df, id_column, url_column, html_column)
    url = F.col(url_column).cast("string")
    pages = df.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_column).alias("html"))
    edges = materialised(host_edges(pages, "html"), "host-links")
    judged = pages.drop("html").withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))
    seen = judged.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")
    )
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = linked.join(seen, "host", "full").select(
        "host", *(F.coalesce(F.expr(f"{c} * {SCALE} div n"), F.lit(0)).cast("long").alias(c) for c in ("allowed", "blocked"))
    )
    hosts = materialised(hosts, "hosts")
    scores = propagate(hosts, edges)
    bad = F.when((F.col("distrust") >= int(threshold * SCALE)) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    scores = materialised(scores.withColumn("method", bad).withColumnRenamed("host", "s_host"), "host-verdicts")
    out = judged.join(scores, F.col("host") == F.col("s_host"), "left")
    verdict = F.coalesce("ruled", "method", F.lit("allow"))
    return out.select(
        F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"),
        *((F.coalesce(c, F.lit(0)) / SCALE).alias(c) for c in ("trust", "distrust")),
    )
