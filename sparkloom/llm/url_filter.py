"""URL filters: explicit rules, then empirical-Bayes host reputation.

A rule names a host and a path; it fits the host and all its subdomains where
the url's path starts with the rule's, and the longest fitting rule decides.
Other urls are judged by the reputation of their host: labelled outcomes of its
pages (1 for a bad page), shrunk by beta-binomial priors from public suffix to
registered domain to host.  A level's prior mean is the shrunken rate of the
level above; its strength is estimated by moments from how much the rates of the
level differ beyond binomial noise.  A host is blocked if its rate of bad pages
exceeds ``MAX_BAD`` with a posterior probability of at least ``SURE``: that is, if
the lower bound of that probability, a quantile of the beta posterior, does.

The registered domain is a host's longest public suffix and the label before it.
Suffixes of more than one label are a parameter; any other last label is a suffix.

The join of pages with reputations is a broadcast one if the hosts with outcomes
hold at most ``BROADCAST_HOSTS``; beyond that the pages of each host are dealt out
to ``SALTS`` groups, and the reputations copied to each.

Everything is DataFrame functions, aggregations and joins; hot hosts are
pre-aggregated before they are shuffled.

Defined results: a url that is null or has no ``://`` has an empty host and path
and is judged like a host named '' would be.  Pages without an outcome are
judged but teach nothing; without any outcome nothing is blocked.  Rows repeat
as they do in the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpoint, table

#: (verdict, host/path); fixed values of the query.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
MAX_BAD = 0.35
SURE = 0.95
#: Steps on either side of ``MAX_BAD`` in the integral of a posterior, which reaches this many standard deviations.
STEPS, REACH = 128, 8.0
BROADCAST_HOSTS = 200_000
SALTS = 16
#: Public suffixes of several labels that are known without a list.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.mx",
    "com.sg", "com.tr", "com.tw", "edu.au", "gob.es", "gob.mx", "gouv.fr", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au",
    "org.uk", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app",
    "wordpress.com",
)
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER),
            "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1),
        }
    )


def matching_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits &= F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _levels(df: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Append the public suffix of ``host`` and its registered domain, which is the host itself if that is a suffix."""
    parts = F.split("host", r"\.")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), ".")
    labels = F.lit(1)
    for k in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        labels = F.when(last(k).isin(*[s for s in suffixes if s.count(".") == k - 1]), k).otherwise(labels)
    deepest = max([s.count(".") + 1 for s in suffixes], default=1)
    suffix, domain = last(1), last(2)
    for k in range(2, deepest + 1):
        suffix = F.when(F.col("__labels") == k, last(k)).otherwise(suffix)
        domain = F.when(F.col("__labels") == k, last(k + 1)).otherwise(domain)
    return df.withColumn("__labels", labels).withColumns({"domain": domain, "suffix": suffix}).drop("__labels")


def _strength(stats: DataFrame) -> float:
    """The strength of the prior of a level with columns n, k and prior mean m; no stronger than all pages that it is learned from."""
    total, rows = F.sum("n"), F.count("*")
    noise = F.sum(F.col("m") * (1 - F.col("m"))) / total
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)) / total
    inner = F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / total
    got = stats.agg(rows.alias("rows"), total.alias("n"), noise.alias("noise"), spread.alias("spread"), inner.alias("inner")).first()
    most = min(MOST_STRENGTH, float(got["n"] or 0))
    if not got["rows"] or got["spread"] - got["noise"] <= 1e-9:
        return max(LEAST_STRENGTH, most)
    return max(LEAST_STRENGTH, min(most, (got["inner"] - got["spread"]) / (got["spread"] - got["noise"])))


def exceeds(a: Column, b: Column, rate: float) -> Column:
    """The probability that a rate with a beta(a, b) posterior exceeds ``rate``: an integral over the rate's angle."""
    center, sd = F.asin(F.sqrt(a / (a + b))), 0.5 / F.sqrt(a + b)
    low = F.greatest(F.lit(0.0), center - REACH * sd)
    high = F.least(F.lit(math.pi / 2), center + REACH * sd)
    cut = F.greatest(low, F.least(high, F.lit(math.asin(math.sqrt(rate)))))
    peak = (2 * a - 1) * F.log(F.sin(center)) + (2 * b - 1) * F.log(F.cos(center))

    def mass(begin: Column, end: Column) -> Column:
        width = (end - begin) / STEPS
        at = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: begin + (i.cast("double") + 0.5) * width)
        height = lambda x: F.exp((2 * a - 1) * F.log(F.sin(x)) + (2 * b - 1) * F.log(F.cos(x)) - peak)
        return width * F.aggregate(at, F.lit(0.0), lambda s, x: s + height(x))

    over = mass(cut, high)
    # an interval of no width adds nothing
    return F.when(cut >= high, 0.0).when(cut <= low, 1.0).otherwise(over / (over + mass(low, cut)))


def reputations(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior mean of each host's bad rate, and the probability that it exceeds ``MAX_BAD``; ``outcomes`` has host and bad (0 or 1)."""
    by_host = checkpoint(_levels(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), suffixes))
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    by_domain = by_host.groupBy("suffix", "domain").agg(*add)
    by_suffix = by_domain.groupBy("suffix").agg(*add)
    n, k = by_host.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    levels = by_suffix.withColumn("m", F.lit((k + 1) / (n + 2)))
    domains = by_domain.join(_shrunk(levels, "suffix"), "suffix")
    hosts = by_host.join(_shrunk(domains, "domain"), "domain")
    c = F.lit(_strength(hosts))
    a, b = F.col("k") + c * F.col("m"), F.col("n") - F.col("k") + c * (1 - F.col("m"))
    posterior = hosts.select("host", a.alias("a"), b.alias("b"))
    return posterior.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), exceeds(F.col("a"), F.col("b"), MAX_BAD).alias("p_bad"))


def _shrunk(stats: DataFrame, key: str) -> DataFrame:
    """Each key's rate, drawn towards its prior mean: the prior mean of the level below."""
    c = F.lit(_strength(stats))
    return stats.select(key, ((F.col("k") + c * F.col("m")) / (F.col("n") + c)).alias("m"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Append host, path, rule, bad_rate, p_bad and verdict to pages; ``outcomes`` has url and bad (0 or 1)."""
    learned = checkpoint(reputations(with_host(outcomes).where(F.col("bad").isNotNull()).select("host", "bad"), suffixes))
    rule, verdict = matching_rule(rules)
    fresh = {"host", "path", "rule", "bad_rate", "p_bad", "verdict", "__said", "__salt"}
    kept = [c for c in pages.columns if c not in fresh or c == "url"]
    judged = with_host(pages.select(kept)).withColumns({"rule": rule, "__said": verdict})
    if learned.count() <= BROADCAST_HOSTS:
        joined = judged.join(F.broadcast(learned), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        dealt = judged.withColumn("__salt", F.pmod(F.xxhash64("url", "path"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(learned.withColumn("__salt", salts), ["host", "__salt"], "left")
    by_host = F.when(F.col("p_bad") >= SURE, "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce("__said", by_host)).select(*kept, "host", "path", "rule", "bad_rate", "p_bad", "verdict")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages: the last number of a page's path is the document that the label is about."""
    number = F.regexp_extract("path", r"/([0-9]{1,18})(\.html)?/?$", 1)
    marks = labels.groupBy("doc_id").agg(F.max(F.greatest(1 - F.col("quality"), F.col("toxic"))).alias("bad"))
    return (
        with_host(pages)
        .select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
        .join(marks, "doc_id")
        .select("url", "bad")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = labelled_pages(pages, table(spark, sf_dir, "labels"))
    return url_filter(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(then: int) -> str:
    arms = []
    for verdict, text in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = text.partition("/")
        arms.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
            f" THEN '{(text, verdict)[then]}'"
        )
    return "CASE " + " ".join(arms) + " END"


def _strength_sql(stats: str) -> str:
    return (
        f"SELECT CASE WHEN spread - noise > 1e-9 THEN greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, pages,"
        f" (inside - spread) / (spread - noise))) ELSE greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, pages)) END AS c FROM ("
        f" SELECT sum(n) AS pages, sum(n * pow(k / n - m, 2)) / sum(n) AS spread, sum(n * m * (1 - m)) / sum(n) AS inside,"
        f" sum(m * (1 - m)) / sum(n) AS noise FROM {stats})"
    )


def _last(k: str) -> str:
    return f"array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) + 1 - ({k})), len(string_split(host, '.'))), '.')"


def _mass_sql(begin: str, end: str) -> str:
    x = f"({begin} + (i + 0.5) * (({end} - {begin}) / {STEPS}))"
    height = f"exp((2 * a - 1) * ln(sin({x})) + (2 * b - 1) * ln(cos({x})) - peak)"
    # an interval of no width at an end of the scale has no heights
    return f"CASE WHEN {end} > {begin} THEN ({end} - {begin}) / {STEPS} * list_sum(list_transform(range({STEPS}), lambda i: {height})) ELSE 0 END"


_TWO = _last("2") + " IN (" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"
OP9_SQL = f"""
WITH p AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
marks AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT host, bad FROM p JOIN marks
        ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\\.html)?/?$', 1), '') AS BIGINT)
        WHERE bad IS NOT NULL),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k,
        {_last('CASE WHEN ' + _TWO + ' THEN 3 ELSE 2 END')} AS domain,
        {_last('CASE WHEN ' + _TWO + ' THEN 2 ELSE 1 END')} AS suffix FROM o GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM d) AS m FROM d GROUP BY suffix),
s2 AS (SELECT suffix, (k + c * m) / (n + c) AS m FROM s, ({_strength_sql('s')})),
d1 AS (SELECT domain, n, k, m FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (k + c * m) / (n + c) AS m FROM d1, ({_strength_sql('d1')})),
h1 AS (SELECT host, n, k, m FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, k + c * m AS a, n - k + c * (1 - m) AS b FROM h1, ({_strength_sql('h1')})),
h3 AS (SELECT *, asin(sqrt(a / (a + b))) AS center, 0.5 / sqrt(a + b) AS sd FROM h2),
h4 AS (SELECT *, greatest(0.0, center - {REACH} * sd) AS low, least(CAST(pi() / 2 AS DOUBLE), center + {REACH} * sd) AS high,
        (2 * a - 1) * ln(sin(center)) + (2 * b - 1) * ln(cos(center)) AS peak FROM h3),
h5 AS (SELECT *, greatest(low, least(high, asin(sqrt(CAST({MAX_BAD} AS DOUBLE))))) AS cut FROM h4),
h6 AS (SELECT *, {_mass_sql('cut', 'high')} AS over_it, {_mass_sql('low', 'cut')} AS under_it FROM h5),
r AS (SELECT host, CASE WHEN cut >= high THEN 0.0 WHEN cut <= low THEN 1.0 ELSE over_it / (over_it + under_it) END AS p_bad FROM h6)
SELECT page_id, host, path, {_rule_sql(0)} AS rule,
    coalesce({_rule_sql(1)}, CASE WHEN p_bad >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r USING (host)
"""
