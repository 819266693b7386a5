"""URL filter by rules and link-graph propagation, in DataFrame operations only.

Rules decide a url where one fits. The rest is decided per host, by scores over the links between
different hosts (a host's links to itself say nothing). A host's seed is the share of its pages that rules
allow or block.

Trust is personalised PageRank from the allowed seeds t along links:
T(h) = (1 - d) t(h) + d * sum of T(s) / (hosts that s links to), over hosts s that link to h.
Distrust goes from the blocked seeds b against links, as the mean over the hosts that h links to:
D(h) = max(b(h), (1 - d) b(h) + d * mean of D(s)). So it doesn't matter how many others link to a
blocked host, and D never falls below the host's own seed. A host without links has T = t and D = b.
Where distrust exceeds trust by more than MARGIN, the host is blocked.

Scores rise from the seeds, step by step. What the steps to come can add is bounded: to any D by
d / (1 - d) times the largest last rise, to all T together by d / (1 - d) times the sum of the last rises. Steps go on
until these bounds settle every host, or are below EXACT, so the verdicts are those of the limit.

Edges are the distinct pairs of hosts in absolute and protocol-relative links. Counts and sums
are pre-aggregated before each shuffle, and host scores meet their edges in equi-joins that
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.session import drop_settled, settle

#: (verdict, host/path) of the rules in force.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, MARGIN, EXACT = 0.85, 0.5, 1e-6
#: Steps between two looks at the bounds.
STEPS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = url.isNull() | (at == 0)
    return F.when(empty, "").otherwise(host), F.when(empty, "").otherwise(path)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    target, _ = split_url(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select(F.col("host").alias("src"), target.alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(host, trust, distrust), settled, of all hosts in edges (src, dst) and seeds (host, trust, distrust).

    Scores are those of the limit as far as it matters to whether distrust exceeds trust by more than `margin`.
    """
    degree = edges.groupBy(F.col("src").alias("host")).agg(F.count("*").alias("degree"))
    #: Trust goes along an edge and distrust against it, both by the linking host's share.
    ways = settle(edges.join(degree.withColumnRenamed("host", "src"), "src"), "links")
    along = ways.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.lit(DAMPING) / F.col("degree")).alias("t"), F.lit(0.0).alias("d"))
    against = ways.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.lit(DAMPING) / F.col("degree")).alias("d"))
    moves = along.unionByName(against)
    own = seeds.select("host", (F.lit(1 - DAMPING) * F.col("trust")).alias("t"), (F.lit(1 - DAMPING) * F.col("distrust")).alias("d"), F.col("distrust").alias("least"))
    zero = F.lit(0.0)

    def step(now: DataFrame) -> DataFrame:
        moved = moves.join(now.select("host", "trust", "distrust"), "host").select(F.col("to").alias("host"), (F.col("t") * F.col("trust")).alias("t"), (F.col("d") * F.col("distrust")).alias("d"), zero.alias("least"), zero.alias("trust"), zero.alias("distrust"))
        kept = own.select("host", "t", "d", "least", zero.alias("trust"), zero.alias("distrust")).unionByName(now.select("host", zero.alias("t"), zero.alias("d"), zero.alias("least"), "trust", "distrust"))
        new = moved.unionByName(kept).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"), F.max("least").alias("least"), F.max("trust").alias("trust_was"), F.max("distrust").alias("distrust_was"))
        return new.select("host", F.greatest("t", "trust_was").alias("trust"), F.greatest("d", "least", "distrust_was").alias("distrust"), "trust_was", "distrust_was")

    linked = ways.select(F.col("src").alias("host")).unionByName(ways.select(F.col("dst").alias("host"))).distinct()
    now = own.join(linked, "host", "left_semi").select("host", F.col("t").alias("trust"), F.col("least").alias("distrust"))
    apart = seeds.join(linked, "host", "left_anti").select("host", "trust", "distrust")
    own = settle(own.join(linked, "host", "left_semi"), "linked-seeds")
    now = settle(now, "scores")
    while True:
        last = now
        for _ in range(STEPS):
            now = step(now)
        now = settle(now, "scores")
        drop_settled(last)
        rise = now.agg(F.max(F.col("distrust") - F.col("distrust_was")), F.sum(F.col("trust") - F.col("trust_was"))).first()
        more_d, more_t = (DAMPING / (1 - DAMPING) * (x or 0.0) for x in rise)
        gap = F.col("distrust") - F.col("trust")
        open_ = now.where((gap + more_d > margin) & (gap - more_t <= margin))
        if max(more_d, more_t) < EXACT or open_.isEmpty():
            return now.select("host", "trust", "distrust").unionByName(apart)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A url that is null or has no `://` has an empty host and path: no rule fits, no link leads
    there, and it is allowed. Null html has no links. A host that neither rules nor links judge is allowed. Rows that repeat each give
    a row, null page_ids stay, other columns are left aside; an empty table gives an empty one.
    """
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = named.select("page_id", "html", "host", "path", matched_rule(F.col("host"), F.col("path"), rules).alias("found"))
    edges = settle(host_edges(named), "edges")
    share = ruled.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("found.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("found.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    share = settle(share.where("trust > 0 or distrust > 0"), "seeds")
    bad = settle(propagate(edges, share).where(F.col("distrust") - F.col("trust") > MARGIN + EXACT).select("host", F.lit("block").alias("by_links")), "blocked_hosts")
    return ruled.select("page_id", "host", "path", "found").join(bad, "host", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "by_links", F.lit("allow")).alias("verdict"))


def _sql_split(url: str) -> tuple[str, str]:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    none = f"{url} is null or strpos({url}, '://') = 0"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"
    return f"case when {none} then '' else {host} end", f"case when {none} then '' else regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) end"


def oracle(rules=RULES, steps: int = 150) -> str:
    """The same in DuckDB SQL, by a number of steps after which scores move by less than EXACT."""
    host, path = _sql_split("url")
    target, _ = _sql_split("link")
    link = LINK.replace("'", "''")
    rows = ", ".join("({}, '{}', '/{}', '{}', '{}')".format(len(r), r.partition("/")[0], r.partition("/")[2], r, v) for v, r in rules)
    return f"""
        with recursive named as materialized (select page_id, html, {host} as host, {path} as path from pages),
        rules(len, rhost, rpath, rule, verdict) as (values {rows}),
        urls as materialized (select distinct host, path from named),
        ruled as materialized (select host, path, max_by(rule, len) as rule, max_by(verdict, len) as verdict from urls join rules
            on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by host, path),
        links as (select host, unnest(regexp_extract_all(html, '{link}', 1)) as found from named),
        goal as (select host as src, case when starts_with(found, '//') then 'http:' || found else found end as link from links),
        edges as materialized (select distinct src, dst from (select src, {target} as dst from goal) where src <> '' and dst <> '' and src <> dst),
        share as materialized (select host, avg(case when verdict = 'allow' then 1.0::double else 0 end) as t, avg(case when verdict = 'block' then 1.0::double else 0 end) as d
            from named left join ruled using (host, path) where host <> '' group by host),
        linked as materialized (select src as host from edges union select dst from edges),
        own as materialized (select host, coalesce(t, 0) as t, coalesce(d, 0) as d from linked left join share using (host)),
        deg as materialized (select src, {DAMPING} / count(*) as part from edges group by src),
        score as (select 0 as k, host, {1 - DAMPING} * t as t, d from own
            union all select k, host, sum(t) as t, greatest(sum(d), max(least)) as d from (
                select s.k + 1 as k, e.dst as host, part * s.t as t, 0 as d, 0 as least from score s join edges e on e.src = s.host join deg on deg.src = e.src where s.k < {steps}
                union all select s.k + 1, e.src, 0, part * s.d, 0 from score s join edges e on e.dst = s.host join deg on deg.src = e.src where s.k < {steps}
                union all select s.k + 1, o.host, {1 - DAMPING} * o.t, {1 - DAMPING} * o.d, o.d from score s join own o on o.host = s.host where s.k < {steps})
            group by k, host),
        bad as materialized (select host from (select host, t, d from score where k = {steps} union all select host, t, d from share where host not in (select host from linked))
            where d - t > {MARGIN + EXACT})
        select page_id, host, path, rule, coalesce(verdict, case when host in (select host from bad) then 'block' end, 'allow') as verdict
        from named left join ruled using (host, path)"""
