"""Citation graph queries. Seeds are the papers whose id is divisible by 20; a hub has more than 30 citations; the year is 2024."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import adjacency as A
from ..operators import graph as G
from ..operators.relational import first_by
from .registry import query

C = F.col
HUB, NOW = 30, 2024


def seeds(t) -> DataFrame:
    """Papers are the rows of part, so seeds need no citations."""
    return t.part.filter("p_partkey % 20 = 0").select(C("p_partkey").alias("node"))


SEEDS = "seeds AS (SELECT corpusid AS node FROM papers WHERE corpusid % 20 = 0)"
BOTH = "both_ AS (SELECT src AS a, dst AS b FROM cites UNION ALL SELECT dst, src FROM cites)"
HOP1 = f"{SEEDS}, {BOTH}, h1 AS (SELECT DISTINCT a AS seed, b AS nbr FROM both_ WHERE a IN (SELECT node FROM seeds) AND a <> b)"


@query(f"WITH {HOP1} SELECT seed, nbr FROM h1", "papers")
def hop1_expand(t) -> DataFrame:
    return G.expand(seeds(t), t.cites)


def _paths(mid: str, end: str) -> str:
    return f"SELECT e2.{end} AS node, count(*) AS n, round(sum(1 / ln(2 + p.citationcount)), 6) AS damped FROM cites e1 JOIN seeds ON seeds.node = e1.{end} JOIN cites e2 ON e2.{mid} = e1.{mid} AND e2.{end} <> e1.{end} JOIN papers p ON p.corpusid = e1.{mid} GROUP BY 1"


@query(f"WITH {SEEDS} {_paths('src', 'dst')}", "papers")
def cocitation(t) -> DataFrame:
    return A.co_cited(seeds(t), t.adjacency()).withColumn("damped", F.round("damped", 6))


@query(f"WITH {SEEDS} {_paths('dst', 'src')}", "papers")
def bib_coupling(t) -> DataFrame:
    return A.co_cited(seeds(t), t.adjacency(), False).withColumn("damped", F.round("damped", 6))


@query(f"WITH {SEEDS}, {BOTH} SELECT b AS node, count(*) AS direct FROM both_ WHERE a IN (SELECT node FROM seeds) GROUP BY b", "papers")
def direct_links(t) -> DataFrame:
    return G.direct_links(seeds(t), t.cites)


@query(f"WITH {HOP1}, s AS (SELECT node FROM seeds UNION SELECT nbr FROM h1) SELECT src, dst FROM cites WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)", "papers")
def induced_edges(t) -> DataFrame:
    t = t.stored()
    from ..operators.relational import in_scope

    nodes = seeds(t).union(G.expand(seeds(t), t.cites).select("nbr")).distinct()
    return in_scope(t.cites.select("src", "dst"), nodes, "node").select("src", "dst")


@query(f"WITH {HOP1}, f AS (SELECT node FROM seeds), c AS (SELECT DISTINCT nbr FROM h1) SELECT src, dst FROM cites WHERE (src IN (SELECT node FROM f) AND dst IN (SELECT nbr FROM c)) OR (dst IN (SELECT node FROM f) AND src IN (SELECT nbr FROM c))", "papers")
def layer_edges(t) -> DataFrame:
    """Edges between two layers, in both directions."""
    t = t.stored()
    f, c = seeds(t), G.expand(seeds(t), t.cites).select(C("nbr").alias("node")).distinct()
    side = lambda a, b: t.cites.join(a.withColumnRenamed("node", "src"), "src", "left_semi").join(b.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return side(f, c).union(side(c, f)).distinct()


@query(f"""WITH {SEEDS}, n AS (SELECT node AS seed, 'out' AS side, dst AS node FROM cites JOIN seeds ON seeds.node = src UNION ALL SELECT node, 'in', src FROM cites JOIN seeds ON seeds.node = dst)
SELECT seed, side, node, citationcount FROM (SELECT n.*, citationcount, row_number() OVER (PARTITION BY seed, side ORDER BY citationcount DESC, n.node) AS place FROM n JOIN papers ON corpusid = n.node) WHERE place <= 10""", "papers")
def neighbors_rank(t) -> DataFrame:
    """The ten most cited references and citers of each seed."""
    side = lambda name, way: t.adjacency().along(seeds(t), way).select(C("node").alias("seed"), F.lit(name).alias("side"), C("nbr").alias("node"), C("citations").alias("citationcount"))
    rows = side("out", "references").unionByName(side("in", "citers")).filter("citationcount is not null")
    w = Window.partitionBy("seed", "side").orderBy(F.desc("citationcount"), "node")
    return rows.withColumn("n", F.row_number().over(w)).filter("n <= 10").drop("n")


def _niche_sql(norm: str) -> str:
    sig = {"logidf": ("coalesce(c.damped, 0)", "coalesce(b.damped, 0)"), "assoc": ("coalesce(c.n, 0) / greatest(p.citationcount, 1)", "coalesce(b.n, 0) / greatest(p.citationcount, 1)")}[norm]
    paths = lambda m, e: _paths(m, e).replace("round(sum(1 / ln(2 + p.citationcount)), 6)", "sum(1 / ln(2 + p.citationcount))")
    return f"""{HOP1}, r AS (SELECT nbr AS node, count(*) AS reach FROM h1 WHERE nbr NOT IN (SELECT node FROM seeds) GROUP BY nbr), d AS (SELECT b AS node, count(*) AS direct FROM both_ WHERE a IN (SELECT node FROM seeds) GROUP BY b),
c AS ({paths('src', 'dst')}), b AS ({paths('dst', 'src')}),
s AS (SELECT r.node, coalesce(direct, 0) AS direct, coalesce(c.n, 0) AS cocite, coalesce(b.n, 0) AS bib, reach,
  (coalesce(direct, 0) + {sig[0]} + {sig[1]} + 0.3 * reach) * (0.35 + 0.65 * exp(-greatest(0, {NOW} - p.year) / 5.0)) / pow(1 + p.citationcount, 0.5) AS niche
  FROM r LEFT JOIN d USING (node) LEFT JOIN c USING (node) LEFT JOIN b USING (node) JOIN papers p ON p.corpusid = r.node)"""


@query(f"WITH {_niche_sql('logidf')} SELECT node, direct, cocite, bib, reach, round(niche, 6) AS niche FROM s", "papers")
def niche_score(t) -> DataFrame:
    return A.niche_scores(seeds(t), t.adjacency(), NOW).drop("citations").withColumn("niche", F.round("niche", 6))


@query(f"WITH {_niche_sql('assoc')}, l AS (SELECT s.* FROM s JOIN papers ON corpusid = node ORDER BY citationcount, node LIMIT 40) SELECT node, round(niche, 6) AS niche FROM l ORDER BY round(niche, 6) DESC, node LIMIT 10", "papers")
def neighbors_niche(t) -> DataFrame:
    """The least cited pool first, then the best of it."""
    return A.niche_scores(seeds(t), t.adjacency(), NOW, norm="assoc").orderBy("citations", "node").limit(40).select("node", F.round("niche", 6).alias("niche")).orderBy(F.desc("niche"), "node").limit(10)


def _walk_sql(hub: int | None) -> str:
    live = "" if hub is None else f" WHERE citationcount <= {hub}"
    return f"""{SEEDS}, {BOTH},
w1 AS (SELECT b AS node, count(DISTINCT a) AS hits, citationcount FROM both_ JOIN papers ON corpusid = b WHERE a IN (SELECT node FROM seeds) AND a <> b AND b NOT IN (SELECT node FROM seeds) GROUP BY ALL),
w2 AS (SELECT b AS node, count(DISTINCT a) AS hits, citationcount FROM both_ JOIN papers ON corpusid = b WHERE a IN (SELECT node FROM w1{live}) AND a <> b AND b NOT IN (SELECT node FROM seeds UNION ALL SELECT node FROM w1) GROUP BY ALL),
w AS (SELECT node, 0 AS hop, 0 AS hits, 0 AS citationcount FROM seeds UNION ALL SELECT node, 1, hits, citationcount FROM w1 UNION ALL SELECT node, 2, hits, citationcount FROM w2)"""


@query(f"WITH {_walk_sql(None)} SELECT node, hop, hits FROM w", "papers")
def bfs_walk(t) -> DataFrame:
    return A.walk(seeds(t), t.adjacency(), 2).select("node", "hop", "hits")


def _directed_sql(direction: str, first: int, last: int, hub: int) -> str:
    """Two hops along one direction or both, with bounds of years; hubs aren't expanded."""
    sides = {"references": "SELECT src AS a, dst AS b FROM cites", "citers": "SELECT dst AS a, src AS b FROM cites"}
    ways = " UNION ALL ".join(sides.values() if direction == "both" else [sides[direction]])
    hop = lambda n, start, seen: f"w{n} AS (SELECT b AS node, count(DISTINCT a) AS hits, citationcount FROM way JOIN papers ON corpusid = b WHERE a IN ({start}) AND b NOT IN ({seen}) AND year BETWEEN {first} AND {last} GROUP BY ALL)"
    return f"""{SEEDS}, way AS ({ways}), {hop(1, "SELECT node FROM seeds", "SELECT node FROM seeds")},
{hop(2, f"SELECT node FROM w1 WHERE citationcount <= {hub}", "SELECT node FROM seeds UNION ALL SELECT node FROM w1")},
w AS (SELECT node, 1 AS hop, hits, citationcount FROM w1 UNION ALL SELECT node, 2, hits, citationcount FROM w2)"""


def _api_walk(name: str, direction: str, years: tuple[int, int]) -> None:
    @query(f"""WITH {_directed_sql(direction, *years, HUB)}, f AS (SELECT * FROM w ORDER BY hop, hits DESC, node LIMIT 300)
SELECT node, 0 AS hop, 0 AS hits, false AS is_hub FROM seeds UNION ALL SELECT node, hop, hits, citationcount > {HUB} FROM f""", "papers", name)
    def api_walk(t) -> DataFrame:
        """Hubs are recorded but not expanded; the budget of 300 found nodes is by hop, then hits."""
        return A.walk(seeds(t), t.adjacency(), 2, direction, years, hub=HUB, budget=300).drop("citations")


for _direction, _years in (("both", (1970, 2100)), ("references", (1975, 2010)), ("citers", (1980, 2015))):
    _name = "api_walk" if _direction == "both" else f"api_walk_{_direction}"
    _api_walk(_name, _direction, _years)


@query(f"WITH {_walk_sql(None)}, f AS (SELECT * FROM w WHERE hop > 0 ORDER BY hits DESC, citationcount DESC, node LIMIT 200) SELECT node, hop, hits FROM f", "papers")
def walk_budget(t) -> DataFrame:
    """Hubs are passed through; the budget of 200 found nodes is by hits, then citations."""
    return A.walk(seeds(t), t.adjacency(), 2, hub=HUB, expand_hubs=True, budget=200, order="hits").filter("hop > 0").select("node", "hop", "hits")


@query(f"WITH {_walk_sql(None)} SELECT hop, count(*) AS n FROM w GROUP BY hop", "papers")
def walk_by_hop(t) -> DataFrame:
    return A.walk(seeds(t), t.adjacency(), 2).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SEEDS}, {BOTH},
c1 AS (SELECT b AS node FROM both_ JOIN papers ON corpusid = b WHERE a IN (SELECT node FROM seeds) AND a <> b AND b NOT IN (SELECT node FROM seeds) GROUP BY b, citationcount ORDER BY count(DISTINCT a) / ln(2 + citationcount) DESC, b LIMIT 10),
c2 AS (SELECT b AS node FROM both_ JOIN papers ON corpusid = b WHERE a IN (SELECT node FROM c1) AND a <> b AND b NOT IN (SELECT node FROM seeds UNION ALL SELECT node FROM c1) GROUP BY b, citationcount ORDER BY count(DISTINCT a) / ln(2 + citationcount) DESC, b LIMIT 10)
SELECT 1 AS hop, node FROM c1 UNION ALL SELECT 2, node FROM c2""", "papers")
def beam_walk(t) -> DataFrame:
    return A.walk(seeds(t), t.adjacency(), 2, beam=10).filter("hop > 0").select("hop", "node")


HUBS = f"hubs AS (SELECT corpusid AS node FROM papers WHERE citationcount > {HUB - 4})"


@query(f"""WITH {SEEDS}, {HUBS}, kept AS (SELECT corpusid AS node FROM papers WHERE corpusid % 20 = 0),
f1 AS (SELECT DISTINCT dst AS node FROM cites WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM hubs)), f AS (SELECT node FROM f1 UNION SELECT dst FROM cites WHERE src IN (SELECT node FROM f1) AND dst IN (SELECT node FROM hubs)),
b1 AS (SELECT DISTINCT src AS node FROM cites WHERE dst IN (SELECT node FROM kept) AND src IN (SELECT node FROM hubs)), b AS (SELECT node FROM b1 UNION SELECT src FROM cites WHERE dst IN (SELECT node FROM b1) AND src IN (SELECT node FROM hubs))
SELECT node FROM f INTERSECT SELECT node FROM b""", "papers")
def bridge_hubs(t) -> DataFrame:
    t = t.stored()
    kept = t.papers.filter("corpusid % 20 = 0").select(C("corpusid").alias("node"))
    return G.bridge_hubs(kept, t.papers.filter(C("citationcount") > HUB - 4).select(C("corpusid").alias("node")), t.cites)


@query(f"WITH {_walk_sql(None)} SELECT 'node' AS kind, node AS a, hop AS b FROM w WHERE hop < 2 UNION ALL SELECT 'edge', src, dst FROM cites WHERE src IN (SELECT node FROM w WHERE hop < 2) AND dst IN (SELECT node FROM w WHERE hop < 2)", "papers")
def subgraph(t) -> DataFrame:
    t = t.stored()
    from ..operators.relational import in_scope

    nodes = G.walk(seeds(t), t.cites, t.papers, 1)
    edges = in_scope(t.cites.select("src", "dst"), nodes, "node").select(F.lit("edge").alias("kind"), C("src").alias("a"), C("dst").alias("b"))
    return nodes.select(F.lit("node").alias("kind"), C("node").alias("a"), C("hop").cast("long").alias("b")).unionByName(edges)


@query(f"WITH {_walk_sql(None)} SELECT c.node, min(p.node) AS parent FROM w c JOIN both_ ON b = c.node JOIN w p ON p.node = a AND p.hop = c.hop - 1 WHERE c.hop > 0 GROUP BY c.node", "papers")
def spanning_tree(t) -> DataFrame:
    """Each node under the least node one hop nearer."""
    t = t.stored()
    nodes = G.walk(seeds(t), t.cites, t.papers, 2).select("node", "hop")
    child, parent = nodes.toDF("b", "child_hop"), nodes.toDF("a", "parent_hop")
    rows = G.undirected(t.cites).join(child, "b").join(parent, "a").filter("parent_hop = child_hop - 1")
    return rows.groupBy(C("b").alias("node")).agg(F.min("a").alias("parent"))


@query(f"WITH {_walk_sql(None)} SELECT node, hop AS depth FROM w", "papers")
def bfs_depth(t) -> DataFrame:
    return A.walk(seeds(t), t.adjacency(), 2).select("node", C("hop").alias("depth"))


@query(f"""WITH {BOTH}, g AS (SELECT max(corpusid) AS goal FROM papers), d1 AS (SELECT DISTINCT b AS n FROM both_ WHERE a = 1), d2 AS (SELECT DISTINCT b AS n FROM both_ WHERE a IN (SELECT n FROM d1)), d3 AS (SELECT DISTINCT b AS n FROM both_ WHERE a IN (SELECT n FROM d2)),
d4 AS (SELECT DISTINCT b AS n FROM both_ WHERE a IN (SELECT n FROM d3)), d5 AS (SELECT DISTINCT b AS n FROM both_ WHERE a IN (SELECT n FROM d4)), d6 AS (SELECT DISTINCT b AS n FROM both_ WHERE a IN (SELECT n FROM d5))
SELECT goal, CASE WHEN goal = 1 THEN 0 WHEN goal IN (SELECT n FROM d1) THEN 1 WHEN goal IN (SELECT n FROM d2) THEN 2 WHEN goal IN (SELECT n FROM d3) THEN 3 WHEN goal IN (SELECT n FROM d4) THEN 4 WHEN goal IN (SELECT n FROM d5) THEN 5 WHEN goal IN (SELECT n FROM d6) THEN 6 ELSE -1 END AS length FROM g""", "papers")
def shortest_path(t) -> DataFrame:
    """The length of a shortest path; the path itself is G.shortest_path's result."""
    t = t.stored()
    goal = t.papers.agg(F.max("corpusid")).first()[0]
    path = G.shortest_path(t.cites, 1, goal)
    return t.spark.createDataFrame([(goal, len(path) - 1)], "goal long, length int")


@query(f"WITH {HOP1} SELECT seed, round(avg(nbr % 100), 6) AS x, round(avg(nbr // 100), 6) AS y FROM h1 WHERE nbr % 2 = 0 GROUP BY seed", "papers")
def centroid(t) -> DataFrame:
    """The mean position of a node's placed neighbours."""
    placed = G.expand(seeds(t), t.cites).filter("nbr % 2 = 0")
    return placed.groupBy("seed").agg(F.round(F.avg(C("nbr") % 100), 6).alias("x"), F.round(F.avg(F.expr("nbr div 100")), 6).alias("y"))


@query(f"SELECT corpusid, round(CASE WHEN year % 11 = 0 THEN 1.0 ELSE 0.35 + 0.65 * exp(-greatest(0, {NOW} - year) / 5.0) END, 6) AS factor FROM papers", "papers")
def recency(t) -> DataFrame:
    return t.papers.select("corpusid", F.round(G.recency(F.when(C("year") % 11 != 0, C("year")), NOW), 6).alias("factor"))


@query("WITH x AS (SELECT DISTINCT l_suppkey AS author, l_partkey, citationcount AS c FROM lineitem JOIN papers ON corpusid = l_partkey) SELECT author, max(least(c, n)) AS h FROM (SELECT author, c, row_number() OVER (PARTITION BY author ORDER BY c DESC) AS n FROM x) GROUP BY author", "papers")
def h_index(t) -> DataFrame:
    return G.h_index(authored(t).select("author", C("citationcount").alias("citations")))


def authored(t) -> DataFrame:
    pairs = t.lineitem.select(C("l_suppkey").alias("author"), C("l_partkey").alias("corpusid")).distinct()
    return pairs.join(t.papers.select("corpusid", "citationcount"), "corpusid")


@query("SELECT field, year // 10 AS decade, round(avg(citationcount), 6) AS expected, count(*) AS n FROM papers GROUP BY ALL", "papers")
def cohort_baseline(t) -> DataFrame:
    return t.papers.groupBy("field", F.expr("year div 10").alias("decade")).agg(F.round(F.avg("citationcount"), 6).alias("expected"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH au AS (SELECT DISTINCT l_suppkey AS author, l_partkey AS corpusid FROM lineitem), hi AS (SELECT author, max(least(c, n)) AS h FROM (SELECT author, citationcount AS c, row_number() OVER (PARTITION BY author ORDER BY citationcount DESC) AS n FROM au JOIN papers USING (corpusid)) GROUP BY author),
wh AS (SELECT corpusid, max(h) AS max_h, avg(h) AS mean_h, count(*) AS n_authors FROM au JOIN hi USING (author) GROUP BY corpusid), inf AS (SELECT dst AS corpusid, sum(infl) AS infl FROM cites GROUP BY dst), rf AS (SELECT src AS corpusid, count(DISTINCT dst) AS refs FROM cites GROUP BY src),
p0 AS (SELECT papers.*, coalesce(infl, 0)::BIGINT AS infl, coalesce(refs, 0) AS refs, CASE WHEN corpusid % 13 = 0 THEN 0.7 ELSE {NOW} - year + 0.4 END::DOUBLE AS age, CASE corpusid % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'published' ELSE 'preprint' END AS tier FROM papers LEFT JOIN inf USING (corpusid) LEFT JOIN rf USING (corpusid)),
p AS (SELECT *, CASE WHEN age < 0.25 THEN '0-3mo' WHEN age < 0.5 THEN '3-6mo' WHEN age < 1 THEN '6-12mo' WHEN age < 2 THEN '1-2y' WHEN age < 3 THEN '2-3y' WHEN age < 5 THEN '3-5y' WHEN age < 10 THEN '5-10y' ELSE '10y+' END AS bucket FROM p0),
ba AS (SELECT field, tier, bucket, avg(infl) AS expected FROM p GROUP BY ALL), ve AS (SELECT venue, avg(infl) AS prestige FROM p GROUP BY venue),
x AS (SELECT p.corpusid, p.tier, age, refs, prestige, coalesce(max_h, 0) AS max_h, coalesce(mean_h, 0) AS mean_h, coalesce(n_authors, 0) AS n_authors, CASE WHEN age >= 0.5 AND expected > 0 THEN p.infl / expected END AS fwci, age < 1 OR NOT expected > 0 AS low
  FROM p JOIN ba ON ba.field = p.field AND ba.tier = p.tier AND ba.bucket = p.bucket JOIN ve ON ve.venue = p.venue LEFT JOIN wh ON wh.corpusid = p.corpusid),
y AS (SELECT *, coalesce(fwci / (fwci + 1), 0) AS i, CASE tier WHEN 'reviewed' THEN 1.0 WHEN 'published' THEN 0.5 ELSE 0.2 END::DOUBLE * (0.6 + 0.4 * prestige / (prestige + 5)) AS v, 0.6 * max_h / (max_h + 20.0) + 0.4 * mean_h / (mean_h + 20.0) AS a, refs / (refs + 20.0) AS g, CASE tier WHEN 'reviewed' THEN 'peer-reviewed' ELSE tier END AS label FROM x),
z AS (SELECT *, (100 * CASE WHEN low THEN 0.51 * v + 0.34 * a + 0.15 * g ELSE 0.35 * i + 0.3 * v + 0.2 * a + 0.15 * g END)::DOUBLE AS composite FROM y)
SELECT corpusid, round(fwci, 6) AS fwci, max_h, n_authors, round(composite, 4) AS composite, CASE WHEN low THEN 'low' ELSE 'ok' END AS confidence,
  CASE WHEN low THEN 'recent ' || label || ', unproven' WHEN composite >= 70 THEN 'established, ' || label || ', high field-normalized impact' WHEN composite >= 45 THEN label || ', moderate impact' ELSE label || ', low signal' END AS verdict FROM z""", "papers")
def reliability(t) -> DataFrame:
    """Impact against the cohort of field, tier and age, venue, authors and references, as 0 to 100."""
    t = t.stored()
    infl = t.cites.groupBy(C("dst").alias("corpusid")).agg(F.sum("infl").alias("infl"))
    refs = t.cites.groupBy(C("src").alias("corpusid")).agg(F.countDistinct("dst").alias("refs"))
    k = C("corpusid") % 3
    p = t.papers.join(infl, "corpusid", "left").join(refs, "corpusid", "left").na.fill(0, ["infl", "refs"])
    p = p.withColumns({
        "age": F.when(C("corpusid") % 13 == 0, 0.7).otherwise(NOW - C("year") + 0.4), "tier": F.when(k == 0, "reviewed").when(k == 1, "published").otherwise("preprint"),
    }).withColumn("bucket", G.age_bucket(C("age")))
    base = p.groupBy("field", "tier", "bucket").agg(F.avg("infl").alias("expected"))
    venue = p.groupBy("venue").agg(F.avg("infl").alias("prestige"))
    h = G.h_index(authored(t).select("author", C("citationcount").alias("citations")))
    who = authored(t).join(h, "author").groupBy("corpusid").agg(F.max("h").alias("max_h"), F.avg("h").alias("mean_h"), F.count(F.lit(1)).alias("n_authors"))
    rows = G.reliability(p.join(base, ["field", "tier", "bucket"]).join(venue, "venue").join(who, "corpusid", "left"))
    zero = lambda c: F.coalesce(C(c), F.lit(0)).alias(c)
    return rows.select("corpusid", F.round("fwci", 6).alias("fwci"), zero("max_h"), zero("n_authors"), F.round("composite", 4).alias("composite"), "confidence", "verdict")


@query("""WITH m AS (SELECT corpusid, title, citationcount, CASE WHEN corpusid % 3 = 0 THEN '2401.' || lpad(corpusid::VARCHAR, 5, '0') END AS arxiv_id, CASE WHEN corpusid % 2 = 0 THEN '10.1234/X' || corpusid END AS doi FROM papers),
q AS (SELECT doc_id, doc_id % 180 + 1 AS k, lpad((doc_id % 180 + 1)::VARCHAR, 5, '0') AS n, p_name FROM documents JOIN part ON p_partkey = doc_id % 180 + 1),
s AS (SELECT doc_id, [' arXiv:2401.' || n || 'v2', 'https://arxiv.org/pdf/2401.' || n, '10.1234/x' || k, 'https://doi.org/10.1234/X' || k, k::VARCHAR, upper(p_name), repeat('0123456789abcdef', 2) || '01234567', 'https://a.org/' || k, '2401.' || n][(doc_id % 9 + 1)::INT] AS seed,
  CASE WHEN doc_id % 9 IN (0, 1, 8) THEN '2401.' || n END AS a, CASE WHEN doc_id % 9 IN (2, 3) THEN '10.1234/x' || k END AS d, CASE WHEN doc_id % 9 = 4 THEN k END AS c, CASE WHEN doc_id % 9 = 5 THEN lower(p_name) END AS t FROM q),
t AS (SELECT lower(title) AS t, corpusid FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY citationcount DESC, corpusid) AS n FROM papers) WHERE n = 1)
SELECT doc_id, coalesce(x.corpusid, y.corpusid, z.corpusid, t.corpusid) AS corpusid, CASE WHEN x.corpusid IS NOT NULL THEN 'arxiv_id' WHEN y.corpusid IS NOT NULL THEN 'doi' WHEN z.corpusid IS NOT NULL THEN 'corpus_id' WHEN t.corpusid IS NOT NULL THEN 'title' END AS how,
  CASE WHEN coalesce(x.corpusid, y.corpusid, z.corpusid) IS NOT NULL THEN 1.0 WHEN t.corpusid IS NOT NULL THEN 0.85 END::DOUBLE AS confidence
FROM s LEFT JOIN m x ON x.arxiv_id = s.a LEFT JOIN m y ON lower(y.doi) = s.d LEFT JOIN papers z ON z.corpusid = s.c LEFT JOIN t ON t.t = s.t""", "papers")
def seed_resolve(t) -> DataFrame:
    """Seeds as people write them, by arXiv id, DOI, corpus id or title."""
    k = C("doc_id") % 180 + 1
    n = F.lpad(C("k").cast("string"), 5, "0")
    forms = F.array(
        F.concat(F.lit(" arXiv:2401."), n, F.lit("v2")), F.concat(F.lit("https://arxiv.org/pdf/2401."), n), F.concat(F.lit("10.1234/x"), C("k").cast("string")), F.concat(F.lit("https://doi.org/10.1234/X"), C("k").cast("string")),
        C("k").cast("string"), F.upper("p_name"), F.lit("0123456789abcdef" * 2 + "01234567"), F.concat(F.lit("https://a.org/"), C("k").cast("string")), F.concat(F.lit("2401."), n),
    )
    seeds_ = t.documents.withColumn("k", k).join(t.part, C("p_partkey") == C("k")).select("doc_id", F.element_at(forms, (C("doc_id") % 9 + 1).cast("int")).alias("seed"))
    c = C("corpusid")
    meta = t.papers.select("corpusid", "title", "citationcount", F.when(c % 3 == 0, F.concat(F.lit("2401."), F.lpad(c.cast("string"), 5, "0"))).alias("arxiv_id"), F.when(c % 2 == 0, F.concat(F.lit("10.1234/X"), c.cast("string"))).alias("doi"))
    return G.resolve_seeds(seeds_, meta, "doc_id")


@query("SELECT DISTINCT id FROM (SELECT '24' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 1000)::VARCHAR, 5, '0') AS id FROM documents UNION ALL SELECT '24' || lpad((page_id % 100)::VARCHAR, 2, '0') || '.' || lpad((page_id % 1000)::VARCHAR, 5, '0') FROM pages)")
def ingested_union(t) -> DataFrame:
    """Ids from places that write them differently, as one set."""
    from ..functions.text import normalize_arxiv

    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    five = lambda c: F.lpad((c % 1000).cast("string"), 5, "0")
    a = t.documents.select(normalize_arxiv(F.concat(F.lit("arXiv:24"), two(C("doc_id")), F.lit("_"), five(C("doc_id")), F.lit("v3"))).alias("id"))
    b = t.pages.select(normalize_arxiv(F.concat(F.lit("/24"), two(C("page_id")), F.lit("."), five(C("page_id")))).alias("id"))
    return a.union(b).distinct()


@query(f"WITH {_niche_sql('logidf')}, o AS (SELECT s.node, round(niche, 6) AS niche, reach, citationcount FROM s JOIN papers ON corpusid = node) SELECT node, niche, row_number() OVER (ORDER BY niche <= 0, niche DESC, reach DESC, citationcount DESC, node) AS rank FROM o QUALIFY rank <= 50", "papers")
def niche_rank(t) -> DataFrame:
    """The fifty best candidates; papers without overlap come last, by reach."""
    t = t.stored()
    scores = G.niche_scores(seeds(t), t.cites, t.papers, NOW).withColumn("niche", F.round("niche", 6)).join(t.papers.select(C("corpusid").alias("node"), "citationcount"), "node")
    best = scores.orderBy(*G.rank_order()).limit(50)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*G.rank_order())).cast("long")).select("node", "niche", "rank")  # of fifty rows


@query(f"""WITH {HOP1}, p AS (SELECT corpusid, left(replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '"', chr(39)), 48) AS label FROM papers), k AS (SELECT seed, nbr FROM h1 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY nbr) <= 10)
SELECT seed, 'graph TD' || chr(10) || '  N' || seed || '["' || s.label || '"]' || chr(10) || string_agg('  N' || nbr || '["' || n.label || '"]', chr(10) ORDER BY nbr) || chr(10) || string_agg('  N' || seed || ' --> N' || nbr, chr(10) ORDER BY nbr) AS text
FROM k JOIN p s ON s.corpusid = seed JOIN p n ON n.corpusid = nbr GROUP BY seed, s.label""", "papers")
def mermaid(t) -> DataFrame:
    """A seed and its ten first neighbours as the text of a diagram."""
    t = t.stored()
    w = Window.partitionBy("seed").orderBy("nbr")
    edges = G.expand(seeds(t), t.cites).withColumn("n", F.row_number().over(w)).filter("n <= 10").drop("n")
    return G.diagrams(edges, t.papers.select("corpusid", "title"))
