"""URL rules, and trust and distrust that spread over links between hosts where no rule fits.

A rule is ``host/path``: it fits that host and its subdomains where the url's path starts with the rule's path; of several the
longest string wins. Hosts are seeds by what the rules say of their pages: the share of pages that are allowed is
trust put in, the share that are blocked is distrust put in. Trust is a personalised PageRank from the trusted seeds
along links (a host passes on what it has, by its numbers of links); distrust is one from the blocked seeds against them (who
links to a blocked host inherits). Pages without a rule are blocked where their host's distrust is at least ``floor`` and
more than ``ratio`` times its trust. Seeds put in up to 1 each, so that thresholds do not depend on the number of hosts.

DataFrame functions only. Links are counted by pair of hosts before anything is joined; each round is one equi-join and one
sum by host, and is written to the shared folder; rounds end when no score moves any more; only one number a round comes to the driver.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule and is allowed; a null html
has no links; repeated pages count each; an empty table gives an empty table; extra columns stay as
they are (a result column whose name is taken gets another, see ``free_name``).
"""

from __future__ import annotations

from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.shared import discard, fewer_files, free_name, hidden_prefix, release_shuffles, staged

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, TOLERANCE = 0.85, 1e-4
FLOOR, RATIO = 0.05, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """(source, target, links) between different hosts, from absolute links in the html."""
    found = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("link")
    links = pages.where(F.contains(F.col(html_col), F.lit("//"))).select(F.col(host).alias("source"), found)
    target = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select("source", target.alias("target")).where("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for seeds (host, trust, distrust), after as many rounds as it takes until no score changes by ``tolerance`` of a seed's own share.

    What is still on its way falls by ``damping`` each round, so rounds grow with the logarithm of the number of seeds only. ``rounds``: no more than these."""
    out = links.groupBy("source").agg(F.sum("links").alias("n"))
    into = links.groupBy("target").agg(F.sum("links").alias("n"))
    forward = links.join(out, "source").select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("links") / F.col("n")).alias("trusts"), F.lit(0.0).alias("taints"))
    backward = links.join(into, "target").select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0.0).alias("trusts"), (F.col("links") / F.col("n")).alias("taints"))
    edges = staged(forward.unionByName(backward).groupBy("host", "to").agg(F.sum("trusts").alias("trusts"), F.sum("taints").alias("taints")), "host-links")  # read in every round
    start = seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    start = staged(fewer_files(start), "seeds")
    now = start
    for _ in islice(count(), rounds):
        moved = now.join(edges, "host").select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("trusts")).alias("trust"), (damping * F.col("distrust") * F.col("taints")).alias("distrust"))
        none = (F.lit(0.0).alias("t0"), F.lit(0.0).alias("d0"))
        each = start.select("host", "trust", "distrust", *none).unionByName(moved.select("*", *none))
        each = each.unionByName(now.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.col("trust").alias("t0"), F.col("distrust").alias("d0")))
        new = staged(fewer_files(each.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t0", "d0")])), "trust")
        change = new.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        if now is not start:
            discard(now)
        now = new
        if not change or change < tolerance * (1 - damping):
            break
    return now.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", rules=RULES, floor: float = FLOOR, ratio: float = RATIO, out: str = "judged") -> DataFrame:
    """``pages`` with a struct of host, path, rule, verdict, trust and distrust in column ``out``."""
    release_shuffles(pages.sparkSession)
    p, out = hidden_prefix(pages), free_name(pages, out)
    host, path, found, says = (F.col(f"{p}{c}") for c in ("host", "path", "rule", "verdict"))
    rule, verdict = rule_for(host, path, rules)
    split = pages.withColumns({f"{p}host": host_of(F.col(url_col)), f"{p}path": path_of(F.col(url_col))}).withColumns({f"{p}rule": rule, f"{p}verdict": verdict})
    known = split.where(host != "")
    share = lambda x: F.avg(F.when(says == x, 1.0).otherwise(0.0))
    seeds = known.groupBy(host.alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = spread(host_links(known, f"{p}host", html_col), seeds).select(*[F.col(c).alias(f"{p}{n}") for c, n in (("host", "of"), ("trust", "trust"), ("distrust", "distrust"))])
    joined = split.join(scores, host == F.col(f"{p}of"), "left")
    trust, distrust = F.coalesce(f"{p}trust", F.lit(0.0)), F.coalesce(f"{p}distrust", F.lit(0.0))
    own = F.when((distrust >= (1 - DAMPING) * floor) & (distrust > ratio * trust), "block").otherwise("allow")
    judged = F.struct(host.alias("host"), path.alias("path"), found.alias("rule"), F.coalesce(says, own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
    return joined.select(*pages.columns, judged.alias(out))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
