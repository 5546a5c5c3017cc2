"""URL verdicts by rules and by trust that flows over links between hosts.

A rule names a host and a path; it fits the host and its subdomains where the
URL's path starts with the rule's, and the longest fitting rule decides.  For
other URLs the host decides: trust is personalised PageRank from hosts with
allowed pages along links, distrust flows backwards over links from hosts with
blocked pages, and a host is blocked where its distrust, less its trust for
each of its pages, is above a threshold.  Distrust of a host is the chance
that one who follows its links meets a blocked page: unlike a rank
backwards, which all hosts that link to a blocked one would share, it does not
shrink with their number, and one half is the point from which that is more
likely than not.

*Scale.*  Both are joined and summed in Spark round by round, each round
written to the shared folder and the one before deleted.  A table with a row
for each host is broadcast up to ``BROADCAST_HOSTS``; beyond, it is shuffled,
and hosts with very many rows are cut into pieces, so that a hub is never one
task.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_columns_clashing, scope, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_HOSTS = 500_000
#: Rows of one host that a task of a shuffled join gets at most (or this share of all), which bounds the hosts to be cut.
SPLIT_ROWS, SPLIT_SHARE = 100_000, 100_000
#: The host in a link with a scheme or ``//``.
HREF = r"(?i)href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?[ \t\r\n\f]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"' \t\r\n\f>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    of, slash, rest = rule.partition("/")
    return ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)


def _decided(rules: list[tuple[str, str]], host: Column, path: Column, what: int) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    cases = [F.when(_fits(rule[1], host, path), F.lit(rule[what])) for rule in ordered]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, n)``: pages of host src with a link to another host dst."""
    href = F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(HREF), F.lit(1))
    each = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(F.array_distinct(F.transform(href, lambda h: F.translate(h, UPPER, LOWER)))).alias("dst"))
    return each.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def joined(rows: DataFrame, hosts: DataFrame, on: str, how: str = "inner", most: int | None = None, broadcast_hosts: int | None = None, split_rows: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``hosts``, which has one row for each value of ``on`` (at most ``most`` rows, if known)."""
    if (hosts.count() if most is None else most) <= (BROADCAST_HOSTS if broadcast_hosts is None else broadcast_hosts):
        return rows.join(F.broadcast(hosts), on, how)
    each = max(SPLIT_ROWS if split_rows is None else split_rows, rows.count() // SPLIT_SHARE)
    # At most SPLIT_SHARE hosts have more rows than that.
    heavy = F.broadcast(written(rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > each).select(on, F.ceil(F.col("_n") / each).alias("_pieces"))))
    cut = rows.join(heavy, on, "left").withColumn("_piece", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_pieces", F.lit(1)))).drop("_pieces")
    spread = hosts.join(heavy, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return cut.join(spread, [on, "_piece"], how).drop("_piece")


def _iterated(start: DataFrame, linking: DataFrame, step, rounds: int, tolerance: float) -> DataFrame:
    """``step`` applied to ``(host, x)`` until the sum of changes is below the tolerance: a write and a sum each round.

    ``step`` is also told how much of x is at hosts of ``linking(host)``.
    """
    going, zero = linking.select("host", F.lit(0.0).alias("x"), F.lit(0.0).alias("before"), F.lit(1).alias("goes")), F.lit(0.0)
    flagged = lambda parts: going.union(parts).groupBy("host").agg(F.sum("x").alias("x"), F.sum("before").alias("before"), F.max("goes").alias("goes")).where("x != 0 or before != 0")
    there = flagged(start.select("host", "x", zero, F.lit(0))).agg(F.sum(F.col("x") * F.col("goes"))).first()[0] or 0.0
    now = start
    with scope(start.sparkSession) as made:
        for _ in range(rounds):
            parts = step(now, there).select("host", "x", zero, F.lit(0)).union(now.select("host", zero, "x", F.lit(0)))
            new = written(flagged(parts))
            change, there = (x or 0.0 for x in new.agg(F.sum(F.abs(F.col("x") - F.col("before"))), F.sum(F.col("x") * F.col("goes"))).first())
            made.remove(but=1)  # what the round before left, and what this one needed on the way
            now = new.select("host", "x")
            if change < tolerance:
                break
    return now


def pagerank(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, **how) -> DataFrame:
    """``(host, rank)``: personalised PageRank over ``links(src, dst, n)`` from ``seeds(host, weight)``.

    Ranks sum to one over all hosts; what reaches a host without further links
    returns to the seeds.  Hosts that no flow reaches are not listed; without
    weights there is none.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = written(seeds.where("weight > 0").select("host", (F.col("weight") / F.lit(float(total or 1.0))).alias("x")))
    out = written(links.groupBy("src").agg(F.sum("n").alias("out")))
    steps = written(joined(links, out, "src", **how).select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("w")))
    if steps.isEmpty() or not total:
        return start.withColumnRenamed("x", "rank")
    most = start.count() + steps.agg(F.count_distinct("to")).first()[0]

    def step(now: DataFrame, there: float) -> DataFrame:
        flow = joined(steps, now, "host", most=most, **how).select(F.col("to").alias("host"), (F.col("x") * F.col("w") * damping).alias("x"))
        return flow.union(start.select("host", F.col("x") * F.lit(1 - damping * there)))

    return _iterated(start, out.select(F.col("src").alias("host")), step, rounds, tolerance).withColumnRenamed("x", "rank")


def backward_distrust(links: DataFrame, hosts: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, **how) -> DataFrame:
    """``(host, distrust)``, zero to one, from ``links(src, dst, n)`` and ``hosts(host, pages, blocked)`` (pages of each, and how many are blocked).

    The chance that one who starts on a page of the host and goes on over
    a link with chance ``damping`` meets a blocked page.  It hangs on a host's
    own pages and links, not on how many others link to the same host.  Hosts
    without distrust may not be listed.
    """
    own = written(hosts.select("host", "pages", (F.col("blocked") / F.col("pages")).alias("own")))
    base = written(own.where("own > 0").select("host", F.col("own").alias("x")))
    out = written(links.groupBy("src").agg(F.sum("n").alias("out")).join(own.withColumnRenamed("host", "src"), "src"))
    steps = written(joined(links, out, "src", **how).select("src", F.col("dst").alias("host"), (F.col("n") / F.greatest("out", "pages") * damping * (1 - F.col("own"))).alias("w")))
    if steps.isEmpty():
        return base.withColumnRenamed("x", "distrust")
    most = own.count()

    def step(now: DataFrame, there: float) -> DataFrame:
        flow = joined(steps, now, "host", most=most, **how).select(F.col("src").alias("host"), (F.col("w") * F.col("x")).alias("x"))
        return base.union(flow)

    return _iterated(base, out.select(F.col("src").alias("host")), step, rounds, tolerance).withColumnRenamed("x", "distrust")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", threshold: float = 0.5, keep: list[str] | None = None, **how) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``rules`` are pairs (allow or block, host/path).  A null URL or one without
    ``://`` has an empty host and path and is allowed unless a rule fits; so is
    a host that no flow reaches.  Null html has no links.  Repeated rows each
    count as a page, and equal URLs get equal verdicts.  Of rules of equal
    length the first by code point wins.  An empty table gives an empty one.
    Columns with added names give way.
    """
    given = drop_columns_clashing(pages.select(*keep) if keep else pages, "host", "path", "rule", "verdict")
    names = given.columns
    url = F.col(f"`{url_col}`")
    judged = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = judged.withColumn("rule", _decided(rules, host, path, 1)).withColumn("by_rule", _decided(rules, host, path, 0))
    hosts = written(judged.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")))
    links = written(host_links(pages, url_col, html_col))
    ranks = pagerank(links, hosts.select("host", F.col("allowed").cast("double").alias("weight")), **how)
    distrust = backward_distrust(links, hosts, **how)
    total = float(hosts.agg(F.sum("allowed")).first()[0] or 0)
    score = F.coalesce("distrust", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0)) * total / F.col("pages")
    verdicts = hosts.select("host", "pages").join(ranks, "host", "left").join(distrust, "host", "left").select("host", F.when(score > threshold, F.lit("block")).otherwise(F.lit("allow")).alias("by_host"))
    out = joined(judged, written(verdicts), "host", "left", **{k: v for k, v in how.items() if k in ("broadcast_hosts", "split_rows")})
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def oracle_sql(rules: list[tuple[str, str]] = RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int = 30) -> str:
    """DuckDB SQL for the same verdicts, a table expression for each round."""

    def fits(rule: str) -> str:
        of, slash, rest = rule.partition("/")
        return f"((host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash + rest}'))"

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[what]}'" for r in ordered) + " END"
    href = HREF.replace("'", "''")
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    host = lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    r, d = [], []
    for k in range(1, rounds + 1):
        r.append(f"""f{k} AS MATERIALIZED (SELECT dst AS host, sum(rank * n / out) * {damping} AS rank FROM r{k - 1} JOIN links ON host = src JOIN outs USING (src) GROUP BY dst),
r{k} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (SELECT * FROM f{k} UNION ALL SELECT host, rank * (1 - coalesce((SELECT sum(rank) FROM f{k}), 0)) FROM r0) GROUP BY host)""")
        d.append(f"""d{k} AS MATERIALIZED (SELECT host, sum(x) AS x FROM (SELECT * FROM d0 UNION ALL SELECT src, w * x FROM steps JOIN d{k - 1} ON dst = host) GROUP BY host)""")
    rounds_sql = ",\n".join(r + d)
    return f"""
WITH p AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS MATERIALIZED (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS by_rule FROM p),
hosts AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM j WHERE host != '' GROUP BY host),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{href}', 1), lambda h: {lower.format("h")}))) AS dst FROM p) WHERE src != '' AND dst != '' AND src != dst GROUP BY ALL),
outs AS (SELECT src, sum(n) AS out FROM links GROUP BY src),
steps AS MATERIALIZED (SELECT src, dst, n / greatest(out, pages) * {damping} * (1 - blocked / pages) AS w FROM links JOIN outs USING (src) JOIN hosts ON host = src),
r0 AS (SELECT host, allowed / sum(allowed) OVER () AS rank FROM hosts WHERE allowed > 0),
d0 AS (SELECT host, blocked / pages AS x FROM hosts WHERE blocked > 0),
{rounds_sql},
v AS (SELECT h.host, CASE WHEN coalesce(x, 0) - coalesce(rank, 0) * (SELECT sum(allowed) FROM hosts) / pages > {threshold} THEN 'block' ELSE 'allow' END AS by_host
      FROM hosts h LEFT JOIN r{rounds} r ON h.host = r.host LEFT JOIN d{rounds} d ON h.host = d.host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, by_host, 'allow') AS verdict FROM j LEFT JOIN v ON j.host = v.host
"""
