"""Citation graph: hops, walks, scores.

Edges are rows (src, dst). A hop is a join of the frontier with the edges on each side and an aggregation
that combines before the shuffle. Walks cut their lineage after each hop with a written table, and stop
early when the frontier is empty. Hubs are what skews these joins: they are passed through or recorded but
not expanded by a stated rule, and Spark splits the join where one remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mermaid_label
from ..session import written


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, nbr): distinct neighbours of the frontier's nodes (node), over edges in either direction."""
    return undirected(edges).join(frontier.select(F.col("node").alias("a")), "a").select(F.col("a").alias("seed"), F.col("b").alias("nbr")).filter("seed <> nbr").distinct()


def walk(
    seeds: DataFrame, edges: DataFrame, papers: DataFrame, hops: int = 2, beam: int | None = None, hub: int | None = None,
    min_citations: int | None = None, expand_hubs: bool = False,
) -> DataFrame:
    """Breadth-first walk from seeds(node): node, hop, hits (distinct frontier nodes that reached it first) and is_hub.

    A node outside the beam isn't visited and may come again at a later hop. With `hub`, nodes of more
    citations are recorded but expanded only if expand_hubs. The beam takes the highest hits / ln(2 +
    citations), then the smallest id; it bounds a hop's frontier, so a window without a partition never
    sorts more than one row for each candidate's partial best: Spark takes the top rows of each task first.
    """
    info = papers.select(F.col("corpusid").alias("nbr"), "citationcount")
    visited = seeds.select("node").distinct().withColumn("hop", F.lit(0)).withColumn("hits", F.lit(0).cast("long")).withColumn("is_hub", F.lit(False))
    frontier = visited.select("node")
    for hop in range(1, hops + 1):
        reached = expand(frontier, edges).groupBy("nbr").agg(F.count(F.lit(1)).alias("hits"))
        reached = reached.join(visited.select(F.col("node").alias("nbr")), "nbr", "left_anti").join(info, "nbr")
        if min_citations is not None:
            reached = reached.filter(F.col("citationcount") >= min_citations)
        reached = reached.withColumn("is_hub", F.lit(False) if hub is None else F.col("citationcount") > hub)
        if beam is not None:
            reached = reached.orderBy(F.desc(F.col("hits") / F.log(2 + F.col("citationcount"))), "nbr").limit(beam)
        new = written(reached.select(F.col("nbr").alias("node"), F.lit(hop).alias("hop"), "hits", "is_hub"), "walk")
        frontier = new.select("node") if expand_hubs else new.filter("not is_hub").select("node")
        visited = visited.unionByName(new)
        if not frontier.limit(1).count():
            break
    return visited


def direct_links(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, direct): edges between a node and any seed, mutual ones counted twice."""
    s = seeds.select(F.col("node").alias("a"))
    return undirected(edges).join(s, "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("direct"))


def co_cited(seeds: DataFrame, edges: DataFrame, papers: DataFrame, shared_citer: bool = True) -> DataFrame:
    """(node, n, damped) for nodes that share a citer (or, reversed, a reference) with a seed, paths counted.

    damped weighs a path by 1 / ln(2 + citations of the paper in the middle). The middle papers are
    restricted to the seeds' before the join that multiplies.
    """
    mid, end = ("src", "dst") if shared_citer else ("dst", "src")
    s = seeds.select(F.col("node").alias(end), F.col("node").alias("seed"))
    first = edges.join(s, end).select(F.col(mid).alias("mid"), "seed")
    w = papers.select(F.col("corpusid").alias("mid"), (1 / F.log(2 + F.col("citationcount"))).alias("w"))
    paths = first.join(w, "mid").join(edges.select(F.col(mid).alias("mid"), F.col(end).alias("node")), "mid").filter("node <> seed")
    return paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("damped"))


def recency(year: Column, now: int, tau: float = 5.0, floor: float = 0.35) -> Column:
    return F.when(year.isNull(), 1.0).otherwise(floor + (1 - floor) * F.exp(-F.greatest(F.lit(0), now - year) / tau))


def normed(n: Column, damped: Column, citations: Column, norm: str) -> Column:
    """A count of shared papers: as it is, by logidf, association strength or salton."""
    c = F.greatest(citations, F.lit(1))
    return {"none": n.cast("double"), "logidf": damped, "assoc": n / c, "salton": n / F.sqrt(c.cast("double"))}[norm]


def niche_scores(seeds: DataFrame, edges: DataFrame, papers: DataFrame, now: int, norm: str = "logidf", weights=(1.0, 1.0, 1.0, 0.3), damping: float = 0.5) -> DataFrame:
    """Candidates (neighbours of seeds) with direct, cocite, bib, reach and niche, the weighted and recency-damped sum."""
    alpha, beta, gamma, delta = weights
    s = seeds.select("node").distinct()
    candidates = expand(s, edges).groupBy(F.col("nbr").alias("node")).agg(F.count(F.lit(1)).alias("reach")).join(s, "node", "left_anti")
    sides = [co_cited(s, edges, papers, side).toDF("node", f"n{i}", f"w{i}") for i, side in enumerate((True, False))]
    rows = candidates.join(direct_links(s, edges), "node", "left").join(sides[0], "node", "left").join(sides[1], "node", "left")
    rows = rows.join(papers.select(F.col("corpusid").alias("node"), "year", "citationcount"), "node")
    z = lambda c: F.coalesce(c, F.lit(0))
    signal = [normed(z(F.col(f"n{i}")), z(F.col(f"w{i}")), F.col("citationcount"), norm) for i in (0, 1)]
    raw = alpha * z(F.col("direct")) + beta * signal[0] + gamma * signal[1] + delta * F.col("reach")
    niche = raw * recency(F.col("year"), now) / F.pow(1 + F.col("citationcount"), F.lit(damping))
    return rows.select("node", z(F.col("direct")).alias("direct"), z(F.col("n0")).alias("cocite"), z(F.col("n1")).alias("bib"), "reach", niche.alias("niche"))


def reachable(start: DataFrame, edges: DataFrame, through: DataFrame, hops: int) -> DataFrame:
    """Nodes of `through` that directed edges reach from start over nodes of `through` only."""
    e = edges.join(through.select(F.col("node").alias("dst")), "dst", "left_semi")
    found, frontier = None, start.select("node")
    for _ in range(hops):
        step = e.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = written(step if found is None else step.join(found, "node", "left_anti"), "reach")
        found = new if found is None else found.unionByName(new)
        frontier = new
        if not new.limit(1).count():
            break
    return found


def bridge_hubs(kept: DataFrame, hubs: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Hubs on a path of hubs that leads from a kept node to a kept node."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(kept, edges, hubs, hops).intersect(reachable(kept, back, hubs, hops))


def shortest_path(edges: DataFrame, start: int, goal: int, most: int = 12) -> list[int]:
    """A shortest undirected path, of equally short ones that of least ids going back from the goal; empty for none."""
    spark = edges.sparkSession
    levels = [spark.createDataFrame([(start,)], "node long")]
    both = undirected(edges)
    visited = levels[0]
    for _ in range(most):
        if levels[-1].filter(F.col("node") == goal).limit(1).count():
            break
        step = both.join(levels[-1].withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        new = written(step.join(visited, "node", "left_anti"), "path")
        if not new.limit(1).count():
            return []
        levels.append(new)
        visited = visited.unionByName(new)
    else:
        return []
    path = [goal]
    for level in reversed(levels[:-1]):
        before = both.filter(F.col("b") == path[0]).join(level.withColumnRenamed("node", "a"), "a", "left_semi").agg(F.min("a")).first()[0]
        path.insert(0, before)
    return path


def h_index(authored: DataFrame) -> DataFrame:
    """authored(author, citations) as (author, h): the most papers that have at least as many citations each.

    Counts of counts make it one row for each author and citation number, so a prolific author is short.
    """
    counts = authored.groupBy("author", "citations").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("author").orderBy(F.desc("citations"))
    least = F.least("citations", F.sum("n").over(w))
    return counts.withColumn("h", least).groupBy("author").agg(F.max("h").alias("h"))


# Fixed values of the reliability score: half points, weights, shares
H_HALF, REF_HALF, VENUE_HALF, LEAST_AGE = 20.0, 20.0, 5.0, 0.5
W_VENUE, W_IMPACT, W_AUTHOR, W_GROUND = 0.30, 0.35, 0.20, 0.15


def saturated(x: Column, half: float) -> Column:
    """0 to 1, one half at `half`."""
    x = F.greatest(F.lit(0.0), x)
    return x / (x + half)


def age_bucket(age: Column) -> Column:
    bucket = F.lit("10y+")
    for limit, name in ((10, "5-10y"), (5, "3-5y"), (3, "2-3y"), (2, "1-2y"), (1, "6-12mo"), (0.5, "3-6mo"), (0.25, "0-3mo")):
        bucket = F.when(age < limit, name).otherwise(bucket)
    return bucket


def reliability(rows: DataFrame) -> DataFrame:
    """rows with fwci, confidence, impact, venue_score, author_score, grounding, composite (0 to 100) and verdict.

    rows(age, infl, expected, tier, prestige, max_h, mean_h, refs): tier is reviewed, published or preprint.
    Without a trusted citation window (under half a year, or no cohort) impact is 0 and its weight goes to
    venue and author, 6 to 4; under a year confidence is low as well.
    """
    blind = (F.col("age") < LEAST_AGE) | F.col("expected").isNull() | (F.col("expected") <= 0)
    fwci = F.when(~blind, F.col("infl") / F.col("expected"))
    rows = rows.withColumns({"fwci": fwci, "low": blind | (F.col("age") < 1)})
    tier = F.when(F.col("tier") == "reviewed", 1.0).when(F.col("tier") == "published", 0.5).otherwise(0.2)
    label = F.when(F.col("tier") == "reviewed", "peer-reviewed").otherwise(F.col("tier"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumns({
        "impact": F.coalesce(F.col("fwci") / (F.col("fwci") + 1), F.lit(0.0)), "venue_score": tier * (0.6 + 0.4 * saturated(zero("prestige"), VENUE_HALF)),
        "author_score": 0.6 * saturated(zero("max_h"), H_HALF) + 0.4 * saturated(zero("mean_h"), H_HALF), "grounding": saturated(zero("refs"), REF_HALF),
    })
    sure = W_IMPACT * F.col("impact") + W_VENUE * F.col("venue_score") + W_AUTHOR * F.col("author_score") + W_GROUND * F.col("grounding")
    unsure = (W_VENUE + 0.6 * W_IMPACT) * F.col("venue_score") + (W_AUTHOR + 0.4 * W_IMPACT) * F.col("author_score") + W_GROUND * F.col("grounding")
    rows = rows.withColumn("composite", 100 * F.when(F.col("low"), unsure).otherwise(sure)).withColumn("confidence", F.when(F.col("low"), "low").otherwise("ok"))
    verdict = (
        F.when(F.col("low"), F.concat(F.lit("recent "), label, F.lit(", unproven"))).when(F.col("composite") >= 70, F.concat(F.lit("established, "), label, F.lit(", high field-normalized impact")))
        .when(F.col("composite") >= 45, F.concat(label, F.lit(", moderate impact"))).otherwise(F.concat(label, F.lit(", low signal")))
    )
    return rows.withColumn("verdict", verdict).drop("low")


def rank_order() -> list[Column]:
    """Candidates by niche score; those without overlap last, by reach; then by citations and node."""
    return [F.col("niche") <= 0, F.desc("niche"), F.desc("reach"), F.desc("citationcount"), F.col("node")]


def resolve_seeds(seeds: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """seeds(key, seed) and meta(corpusid, title, arxiv_id, doi, citationcount) as (key, corpusid, how, confidence); nulls where nothing matches.

    A seed's form says how it is looked up: an arXiv id or address, a DOI or its address, digits as a corpus id, 40 hex digits as an id that the
    table doesn't have, other addresses not at all, anything else as a title, of which the most cited paper counts. Each is an equi join.
    """
    s = F.trim("seed")
    arxiv = F.nullif(F.regexp_extract(s, r"(?i)^(?:arxiv:\s*|https?://(?:www\.)?arxiv\.org/(?:abs|pdf|html)/)?([0-9]{4}\.[0-9]{4,6})(?:v[0-9]+)?(?:\.pdf)?$", 1), F.lit(""))
    doi = F.nullif(F.lower(F.regexp_extract(s, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.[0-9]{4,9}/\S+)$", 1)), F.lit(""))
    number = F.when(F.regexp_like(s, F.lit("^[0-9]+$")), s.try_cast("long"))
    other = F.regexp_like(s, F.lit("(?i)^(?:[0-9a-f]{40}|https?://.*)$"))
    title = F.when(arxiv.isNull() & doi.isNull() & ~F.regexp_like(s, F.lit("^[0-9]+$")) & ~other, F.lower(s))
    rows = seeds.select(key, arxiv.alias("a_"), doi.alias("d_"), number.alias("n_"), title.alias("t_"))
    by = lambda df, column, name: df.filter(column.isNotNull()).groupBy(column.alias(name)).agg(F.min("corpusid").alias(name + "id"))
    rows = rows.join(by(meta, F.col("arxiv_id"), "a_"), "a_", "left").join(by(meta, F.lower("doi"), "d_"), "d_", "left").join(by(meta, F.col("corpusid"), "n_"), "n_", "left")
    titles = meta.filter("title is not null").groupBy(F.lower("title").alias("t_")).agg(F.min_by("corpusid", F.struct(-F.col("citationcount"), F.col("corpusid"))).alias("t_id"))
    rows = rows.join(titles, "t_", "left")
    how = F.when(F.col("a_id").isNotNull(), "arxiv_id").when(F.col("d_id").isNotNull(), "doi").when(F.col("n_id").isNotNull(), "corpus_id").when(F.col("t_id").isNotNull(), "title")
    confidence = F.when(how == "title", 0.85).when(how.isNotNull(), 1.0)
    return rows.select(key, F.coalesce("a_id", "d_id", "n_id", "t_id").alias("corpusid"), how.alias("how"), confidence.alias("confidence"))


def diagrams(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """edges(seed, nbr), a bounded number for each seed, and papers(corpusid, title) as seed and text, a Mermaid graph."""
    named = papers.select(F.col("corpusid").alias("nbr"), mermaid_label(F.col("title")).alias("label"))
    at = lambda n, label: F.concat(F.lit("  N"), n.cast("string"), F.lit('["'), label, F.lit('"]'))
    arrow = F.concat(F.lit("  N"), F.col("seed").cast("string"), F.lit(" --> N"), F.col("nbr").cast("string"))
    rows = edges.join(named, "nbr").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("nbr", at(F.col("nbr"), F.col("label")).alias("node"), arrow.alias("arrow")))).alias("r"))
    rows = rows.join(named.withColumnRenamed("nbr", "seed"), "seed")
    lines = F.concat(F.array(F.lit("graph TD"), at(F.col("seed"), F.col("label"))), F.transform("r", lambda x: x["node"]), F.transform("r", lambda x: x["arrow"]))
    return rows.select("seed", F.array_join(lines, "\n").alias("text"))
