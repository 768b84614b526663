"""URL verdicts from rules, and by link-graph propagation where no rule fits.

Hosts are joined by the links of their pages. Personalised PageRank starts from the
hosts that rules allow (trust), and on the reversed graph from the hosts that rules
block (distrust: who links to a blocked host is suspect itself). Every host with a page
that a rule decides starts walks, by the share of such pages. A host whose
distrust outweighs its trust is blocked. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skriba.llm.shared import remove, store, work_dir

#: (verdict, host, path); a rule holds for its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Ranks are settled when this many rounds add less than SETTLED to the sum of all ranks
#: (at most 1 for trust and distrust together); DAMPING bounds the rounds that this takes.
STEPS, ROUNDS, SETTLED = 4, 120, 1e-5
#: A host is blocked if its distrust is over this many times its trust.
BLOCK_RATIO = 1.0
#: Hosts that belong to no site (addresses), and domains of two labels that many owners share.
NO_SITE = r"^\[|(^|\.)[0-9]+(:[0-9]*)?$"
SUFFIX = r"^(co|com|net|org|edu|gov|gob|ac|or|ne|go|nom|mil|sch|ltd|plc)\.[a-z]{2}(:[0-9]*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """Between the first :// and the next /, ? or #, A-Z folded; null or no ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ? or #; null or no ://: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules=RULES):
    """(verdict, rule) of the longest fitting rule, else nulls. Of rules as long as one
    another the more special host counts, then the order of `rules`."""
    order = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    verdict = rule = None
    for said, base, start in order:
        fits = ((host == base) | host.endswith("." + base)) & path.startswith(start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
        rule = F.when(fits, base + start) if rule is None else rule.when(fits, base + start)
    return verdict, rule


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, (src, dst, weight): absolute and scheme-relative
    targets of href and src attributes; weight is the number of links."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit("(?i)(?:href|src)\\s*=\\s*[\"']?((?:https?:)?//[^\\s\"'<>]+)"), F.lit(1))
    targets = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return targets.select("src", host_of(to).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """Ties inside a site: a host and the nearest domain above it, up to that of two labels.

    Subdomains share an owner; one tie each way carries trust along it. A domain is a
    node if two hosts or more are its own or below it, whether or not it has pages, so
    siblings are tied through it. Public suffixes, addresses and single labels are no site."""

    def ups(first):
        labels = F.split("host", "\\.")
        each = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        return F.explode(F.slice(each, first, F.size(each)))

    named = hosts.where((F.size(F.split("host", "\\.")) > 1) & ~F.col("host").rlike(NO_SITE))
    shared = named.select(ups(1).alias("up")).where(~F.col("up").rlike(SUFFIX)).groupBy("up").agg(F.count("*").alias("n")).where("n > 1").select("up")
    nodes = named.select("host").union(shared.select("up")).distinct()
    ties = nodes.select("host", ups(2).alias("up")).join(shared, "up").groupBy("host").agg(F.max_by("up", F.length("up")).alias("up"))
    return ties.select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1.0).alias("weight")).union(ties.select(F.col("up").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight")))


def personalised_rank(edges: DataFrame, seeds: DataFrame, folder: str) -> DataFrame:
    """Rank (walk, host, rank) of random walks over (walk, src, dst, share) that start from,
    and return to, the seeds (walk, host, start); walks end at hosts without links.

    The state is one row a walk and host, written after every STEPS rounds. Ranks only
    grow from round to round, so what they grow by in sum says whether they settle."""
    spark = edges.sparkSession
    begun = store(seeds.select("walk", "host", (F.col("start") * (1 - DAMPING)).alias("rank")), folder, "rank-0")
    rank, before = begun, 0.0
    for k in range(STEPS, ROUNDS + STEPS, STEPS):
        for _ in range(STEPS):
            at = rank.select("walk", F.col("host").alias("src"), "rank")
            sent = edges.join(at, ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            rank = sent.union(begun).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        rank = store(rank, folder, f"rank-{k}")
        if k > STEPS:
            remove(spark, f"{folder}/rank-{k - STEPS}")
        mass = rank.agg(F.sum("rank")).first()[0] or 0.0
        if mass - before <= SETTLED:
            break
        before = mass
    return rank


def url_verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides; without one the host's trust and distrust do, and
    a host that neither reaches is allowed. `edges` (src, dst, weight) may come from a
    crawl; else they are taken from the pages' links and their site's ties. Null urls have
    empty host and path and are allowed; repeated rows give repeated results, and a tie of trust
    and distrust allows; links to hosts without pages carry rank as well; null and very long
    html is searched whole for links. Extra columns are ignored, an empty table gives an empty
    result."""
    spark = pages.sparkSession
    folder = work_dir(spark, "urls")
    verdict, rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = store(judged.withColumns({"rule": rule, "said": verdict}), folder, "judged")
    hosts = store(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"), F.count("*").alias("n")), folder, "hosts")
    links = edges if edges is not None else host_edges(pages).union(site_edges(hosts.select("host")))
    links = store(links.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), folder, "links")

    # Trust walks along links, distrust against them; both over ties.
    back = links.select(F.lit("bad").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = links.select(F.lit("good").alias("walk"), "src", "dst", "weight").union(back)
    sums = both.groupBy("walk", "src").agg(F.sum("weight").alias("all"))
    shares = store(both.join(sums, ["walk", "src"]).select("walk", "src", "dst", (F.col("weight") / F.col("all")).alias("share")), folder, "shares")
    # One scale for both walks: a share of all pages that rules decide, whatever they say.
    ruled = hosts.agg(F.sum((F.col("good") + F.col("bad")) / F.col("n"))).first()[0] or 1.0
    starts = [hosts.where(F.col(c) > 0).select(F.lit(c).alias("walk"), "host", (F.col(c) / F.col("n") / ruled).alias("start"), (2 * F.col(c) > F.col("n")).alias("most")) for c in ("good", "bad")]
    seeds = store(starts[0].union(starts[1]), folder, "seeds")
    ranks = personalised_rank(shares, seeds, folder)
    # A rule on some paths says little about the host's other pages: its own start counts
    # for them only if rules decide most of its pages; what arrives over links and ties always does.
    counted = F.col("rank") - F.when(F.coalesce("most", F.lit(True)), 0.0).otherwise(F.col("start") * (1 - DAMPING))
    told = ranks.join(seeds, ["walk", "host"], "left").withColumn("counted", counted)
    of = lambda walk, column: F.sum(F.when(F.col("walk") == walk, F.col(column)).otherwise(0.0))
    scores = store(told.groupBy("host").agg(of("good", "rank").alias("trust"), of("bad", "rank").alias("distrust"), of("good", "counted").alias("pro"), of("bad", "counted").alias("con")), folder, "scores")
    rows = judged.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust", "pro", "con"])
    own = F.when((F.col("con") > 0) & (F.col("con") > BLOCK_RATIO * F.col("pro")), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "trust", "distrust")


__all__ = ["RULES", "fitting_rule", "host_edges", "host_of", "path_of", "personalised_rank", "site_edges", "url_verdicts"]
