"""URL filters (5): link-graph propagation. Host edges come from the pages' absolute links; trust is personalised PageRank from trusted
seed hosts along the edges, distrust the same from blocked seeds against them (who links to a bad host is suspect); each host is then
held against a threshold and the pages of hosts that fail go.

A host's weight on an edge is the share of its linking pages' links that the edge has. Rank is not scaled down by the number of seeds (a seed's own is 1 - damping), so that
thresholds mean the same for every graph; what reaches a host without links on is not handed out again. Trust and distrust go round together, as two sides of one table. Edges are written once; a host with
many of them is split (SPLIT), so that it isn't one task; each round joins ranks with edges and sums at the target, with partial sums before the shuffle. Every STEP rounds
ranks are written, and it ends when what can still come to any host is below TOLERANCE: ranks only grow, and what STEP rounds add is at most damping^STEP of what the STEP rounds before added.

A page that has no absolute links may still refer to others: a navigation whose labels are the first words of another page's title is a link to every host that has this title (title_links).
Where many hosts have such a navigation and many the title, their pairs aren't written out: links go through a hub, a node that hands on what it gets in the same round (through_hubs). Ranks are the same either way.

Defined cases: a page whose url is null or has no host has no host, no edges, and stays. A null html has no links. Relative links stay in
the host and make no edge of themselves. Links to hosts outside the table count. Repeated links and repeated rows count as often as they come. Ties at the threshold stay. Of an empty table comes an empty
one. Extra columns stay; host, trust, distrust and rounds are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import cut, forget, numbered

#: Seeds: hosts under these domains are trusted; hosts with these words in a label are blocked.
TRUSTED, BLOCKED = ("edu", "gov", "ac.uk"), ("casino", "pills", "spam", "porn", "viagra", "warez", "malware", "phishing", "xxx")
#: Damping; rounds between two tests; the most that a host's rank may still be short of at the end; edges of a host that make a part of their own.
DAMPING, STEP, TOLERANCE, SPLIT = 0.85, 6, 1e-4, 100_000
#: A host fails if its distrust is above this and above its trust.
MAX_DISTRUST = 0.02
HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@:]*@)?([^/?#:@]+)"
LINK = "(?i)href\\s*=\\s*[\"']?\\s*((?:https?:)?//[^/?#\"'\\s>]+)"
#: A label of a page's navigation, a title.
LABEL, TITLE = "<li><a href=\"/[^\"]*\">([^<]*)</a>", "<title>([^<]*)</title>"
#: Domains of the trusted seeds in the query.
SEEDS = ("example.org",)
#: Pairs of hosts that are written out for a phrase, for each of the hosts that have it in a navigation or a title; a phrase of more pairs is a hub. How names of hubs begin: no host's can.
SPREAD, HUB = 32, "#"
_SEEDS_RE = "(^|\\.)(" + "|".join(x.replace(".", "\\.") for x in SEEDS) + ")$"
_TRUSTED_RE = "(^|\\.)(" + "|".join(x.replace(".", "\\.") for x in TRUSTED) + ")$"
_BLOCKED_RE = "(^|[.-])(" + "|".join(BLOCKED) + ")([.-]|$)"


def host_of(url: Column) -> Column:
    """The host in lower case, without www.; null if there is none."""
    found = F.regexp_extract(url, HOST, 2)
    return F.nullif(F.regexp_replace(F.lower(found), "^www\\.", ""), F.lit(""))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between hosts."""
    links = F.when(F.contains(F.col(html), F.lit("//")), F.regexp_extract_all(html, F.lit(LINK), 1))
    target = F.regexp_replace("link", "^//", "http://")
    out = pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("link")).select("src", host_of(target).alias("dst"))
    return out.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def title_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): pages whose navigation labels are the first words of a title, by the hosts that have the title: all of them.

    Phrases with more than SPREAD pairs for each of their rows are hubs: (src, hub, n) and (hub, dst, 1) in place of the pairs. So there are no more rows than SPREAD for each row of told and owner.
    """
    labels = F.regexp_extract_all(F.col(html), F.lit(LABEL), 1)
    told = pages.select(host_of(F.col(url)).alias("src"), labels.alias("x")).filter("src is not null and size(x) > 0").groupBy("src", F.array_join("x", " ").alias("phrase"), F.size("x").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    told = cut(told, "titles-told")
    title = F.split(F.regexp_extract(html, TITLE, 1), " ")
    first = F.explode(F.transform(F.sequence(F.lit(1), F.size("x")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("x", F.lit(1), k), " ").alias("phrase"))))
    named = pages.select(host_of(F.col(url)).alias("dst"), title.alias("x")).filter("dst is not null").select("dst", first.alias("p")).select("dst", "p.k", "p.phrase").distinct()
    sources = told.groupBy("k", "phrase").agg(F.count(F.lit(1)).alias("sources"))
    owner = cut(named.join(sources.select("k", "phrase"), ["k", "phrase"], "left_semi"), "titles-owner")
    phrases = sources.join(owner.groupBy("k", "phrase").agg(F.count(F.lit(1)).alias("owners")), ["k", "phrase"])
    phrases = numbered(phrases, "id", "titles-phrases")
    many = F.col("sources") * F.col("owners") > SPREAD * (F.col("sources") + F.col("owners"))
    pairs = told.join(phrases.filter(~many).select("k", "phrase"), ["k", "phrase"]).join(owner, ["k", "phrase"]).filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    hubs = phrases.filter(many).select("k", "phrase", F.concat(F.lit(HUB), F.col("id").cast("string")).alias("hub"))
    if not hubs.head(1):
        return pairs
    into, out = told.join(hubs, ["k", "phrase"]).select("src", F.col("hub").alias("dst"), "n"), owner.join(hubs, ["k", "phrase"]).select(F.col("hub").alias("src"), "dst", F.lit(1).cast("bigint").alias("n"))
    return pairs.unionByName(into).unionByName(out)


def through_hubs(edges: DataFrame) -> DataFrame:
    """edges (side, src, dst, n) such that shares of n are those of the pairs that hubs stand for: src to hub with n and hub to dst with m is an edge from src to dst with n * m, unless they are one.

    What goes into a hub counts as often as goes out of it; what would come back to its own host is taken off by an edge to itself.
    """
    into, out = edges.filter(F.col("dst").startswith(HUB)), edges.filter(F.col("src").startswith(HUB))
    wide = into.join(out.groupBy("side", F.col("src").alias("dst")).agg(F.sum("n").alias("all")), ["side", "dst"]).select("side", "src", "dst", (F.col("n") * F.col("all")).alias("n"))
    back = into.join(out.select("side", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("m")), ["side", "src", "dst"]).groupBy("side", "src").agg((-F.sum(F.col("n") * F.col("m"))).alias("n"))
    return edges.filter(~F.col("dst").startswith(HUB)).unionByName(wide).unionByName(back.select("side", "src", F.col("src").alias("dst"), "n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, step: int = STEP) -> tuple[DataFrame, int]:
    """((side, host, rank), rounds): personalised PageRank of edges (side, src, dst, n) from seeds (side, host), for each side on its own. Edges may go through hubs."""
    hubs = bool(edges.filter(F.col("src").startswith(HUB)).head(1))
    if hubs:
        edges = cut(through_hubs(edges), "host-hubs")
    total = edges.groupBy("side", "src").agg(F.sum("n").alias("total"), F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")).filter("total > 0")
    weights = edges.join(total, ["side", "src"]).select("side", F.col("src").alias("host"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst", (F.col("n") / F.col("total")).alias("w"))
    weights = cut(weights, "host-edges")
    split = cut(total.filter("parts > 1").select("side", F.col("src").alias("host"), "parts"), "host-parts")
    start = cut(seeds.select("side", "host").distinct().withColumn("rank", F.lit(1 - damping)), "host-seeds")
    if not weights.head(1):
        return start, 0
    large = bool(split.head(1))

    def hop(rank: DataFrame, how: str) -> DataFrame:
        """What ranks hand on: those of hosts (inner), or those of hubs, where hosts keep what they have (left)."""
        of = F.col("host").startswith(HUB) if how == "left" else ~F.col("host").startswith(HUB)
        at = rank.withColumn("part", F.lit(0))
        if large:
            at = rank.join(split.filter(of), ["side", "host"], "left").select("side", "host", "rank", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        return at.join(weights.filter(of) if hubs else weights, ["side", "host", "part"], how).select("side", F.coalesce("dst", "host").alias("host"), (F.col("rank") * F.coalesce("w", F.lit(1.0))).alias("rank"))

    mass = lambda df: df.agg(F.sum("rank")).first()[0] or 0.0
    rank, rounds, before = start, 0, mass(start)
    while True:
        last = rank
        for _ in range(step):
            moved = hop(rank, "inner")
            if hubs:
                moved = hop(moved.groupBy("side", "host").agg(F.sum("rank").alias("rank")), "left").filter(~F.col("host").startswith(HUB))
            moved = moved.withColumn("rank", damping * F.col("rank"))
            rank = start.unionByName(moved).groupBy("side", "host").agg(F.sum("rank").alias("rank"))
        rank, rounds = cut(rank, "host-ranks"), rounds + step
        if rounds > step:
            forget(last, "host-ranks")
        now = mass(rank)
        if (now - before) * damping**step / (1 - damping**step) <= tolerance:
            return rank, rounds
        before = now


def score_hosts(pages: DataFrame, url: str = "url", html: str = "html", trusted: DataFrame | None = None, blocked: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((host, trust, distrust) of each host of pages or links, rounds). trusted and blocked (host) are by rule if not given; links (src, dst, n) are edges besides those in the pages, and may go through hubs."""
    edges = host_edges(pages, url, html)
    if links is not None:
        edges = edges.unionByName(links.select("src", "dst", "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = cut(edges, "links")
    hosts = pages.select(host_of(F.col(url)).alias("host")).filter("host is not null").unionByName(edges.select(F.inline(F.array(F.struct(F.col("src").alias("host")), F.struct(F.col("dst").alias("host")))))).filter(~F.col("host").startswith(HUB)).distinct()
    hosts = cut(hosts, "hosts")
    bad = hosts.filter(F.col("host").rlike(_BLOCKED_RE)) if blocked is None else blocked.select(F.lower("host").alias("host"))
    good = hosts.filter(F.col("host").rlike(_TRUSTED_RE)) if trusted is None else trusted.select(F.lower("host").alias("host"))
    good = good.join(bad, "host", "left_anti")
    both = edges.select(F.lit("trust").alias("side"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks, rounds = propagate(both, good.withColumn("side", F.lit("trust")).unionByName(bad.withColumn("side", F.lit("distrust"))))
    own = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("rank"))), F.lit(0.0)).alias(side)
    return hosts.join(ranks, "host", "left").groupBy("host").agg(own("trust"), own("distrust")), rounds


def filter_pages(pages: DataFrame, url: str = "url", html: str = "html", max_distrust: float = MAX_DISTRUST, trusted: DataFrame | None = None, blocked: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """pages of hosts that pass, with host, trust, distrust and the number of rounds that it took."""
    pages = pages.drop("trust", "distrust", "host", "rounds")
    scores, rounds = score_hosts(pages, url, html, trusted, blocked, links)
    scores = cut(scores, "host-scores")
    failed = scores.filter((F.col("distrust") > max_distrust) & (F.col("distrust") > F.col("trust")))
    named = pages.withColumn("host", host_of(F.col(url))).join(failed.select("host"), "host", "left_anti").join(scores, "host", "left")
    return named.select(*pages.columns, "host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")), F.lit(rounds).alias("rounds"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """The given pages have relative links only; their navigation refers to other pages by title. None of their hosts is under a trusted domain, so those under SEEDS are the trusted seeds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    good = pages.select(host_of(F.col("url")).alias("host")).filter(F.col("host").rlike(_SEEDS_RE)).distinct()
    kept = filter_pages(pages, trusted=good, links=title_links(pages))
    return kept.select("page_id", "url", "host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), "rounds")


_SQ = lambda s: "'" + s.replace("'", "''") + "'"
_HOST_SQL = lambda x: f"nullif(regexp_replace(lower(regexp_extract({x}, {_SQ(HOST)}, 2)), '^www\\.', ''), '')"

#: Over pages (page_id, url, html).
ORACLE = f"""
WITH RECURSIVE pg AS MATERIALIZED (SELECT page_id, url, html, {_HOST_SQL('url')} AS host FROM pages),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, {_SQ(LINK)}, 1)) AS link FROM pg),
e AS (SELECT src, {_HOST_SQL("regexp_replace(link, '^//', 'http://')")} AS dst FROM l),
nav AS (SELECT host AS src, array_to_string(x, ' ') AS phrase, len(x) AS k FROM (SELECT host, regexp_extract_all(html, {_SQ(LABEL)}, 1) AS x FROM pg WHERE host IS NOT NULL) WHERE len(x) > 0),
tt AS (SELECT host AS dst, string_split(regexp_extract(html, {_SQ(TITLE)}, 1), ' ') AS x FROM pg WHERE host IS NOT NULL),
own AS (SELECT DISTINCT k, array_to_string(x[1:k], ' ') AS phrase, dst FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM tt)),
g AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM e UNION ALL SELECT src, dst FROM nav JOIN own USING (k, phrase)) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL),
w AS MATERIALIZED (SELECT 'trust' AS side, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM g UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM g),
hosts AS MATERIALIZED (SELECT DISTINCT host FROM (SELECT host FROM pg UNION ALL SELECT src FROM g UNION ALL SELECT dst FROM g) WHERE host IS NOT NULL),
bad AS (SELECT host FROM hosts WHERE regexp_matches(host, {_SQ(_BLOCKED_RE)})),
seeds AS MATERIALIZED (SELECT 'distrust' AS side, host FROM bad UNION ALL SELECT DISTINCT 'trust', host FROM pg WHERE regexp_matches(host, {_SQ(_SEEDS_RE)}) AND host NOT IN (SELECT host FROM bad)),
t(k, side, host, rank, mark) AS (
 SELECT 0, side, host, {1 - DAMPING}::DOUBLE, 0::DOUBLE FROM seeds
 UNION ALL
 SELECT s.k + 1, m.side, m.host, m.rank, CASE WHEN s.k % {STEP} = 0 THEN s.total ELSE s.mark END
 FROM (SELECT max(k) AS k, sum(rank) AS total, max(mark) AS mark FROM t) s,
  (SELECT side, host, sum(rank)::DOUBLE AS rank FROM (SELECT side, host, {1 - DAMPING}::DOUBLE AS rank FROM seeds UNION ALL SELECT w.side, w.dst, {DAMPING} * t.rank * w.w FROM t JOIN w ON t.side = w.side AND t.host = w.src) GROUP BY ALL) m
 WHERE EXISTS (FROM w) AND NOT (s.k > 0 AND s.k % {STEP} = 0 AND (s.total - s.mark) * {DAMPING**STEP / (1 - DAMPING**STEP)!r} <= {TOLERANCE})),
z AS (SELECT max(k)::INT AS rounds FROM t),
s AS (SELECT hosts.host, coalesce(max(rank) FILTER (side = 'trust'), 0) AS trust, coalesce(max(rank) FILTER (side = 'distrust'), 0) AS distrust FROM hosts LEFT JOIN (SELECT t.* FROM t, z WHERE k = rounds) r ON r.host = hosts.host GROUP BY hosts.host)
SELECT page_id, url, pg.host, round(coalesce(trust, 0), 9)::DOUBLE AS trust, round(coalesce(distrust, 0), 9)::DOUBLE AS distrust, coalesce((SELECT rounds FROM z), 0)::INT AS rounds FROM pg LEFT JOIN s USING (host)
WHERE NOT (coalesce(distrust, 0) > {MAX_DISTRUST} AND coalesce(distrust, 0) > coalesce(trust, 0))
"""
