"""URL filters: rules, and empirical-Bayes host reputation. All native.

Labelled page outcomes are counted per host, registered domain and suffix. From the whole
corpus down, each level's rate of bad pages is drawn from a beta distribution around its
parent's posterior mean, with a concentration that the method of moments takes from the
level's own spread. A host's posterior is a beta-binomial update of its domain's; a page is blocked
where the lower bound of its host's bad rate is above a limit. Hosts that no label speaks
of have their nearest parent's posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SECOND = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "co.kr", "com.br", "com.cn", "com.mx", "co.in", "co.za")
Z = 1.6448536269514722  # one-sided 95 %
LIMIT = 0.5
FIRM = (0.5, 10_000.0)  # least and greatest concentration


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    none = F.coalesce(at, F.lit(0)) == 0
    return F.when(none, "").otherwise(host), F.when(none, "").otherwise(path)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Rules are a short list, at most a thousand."""
    if len(rules) > 1000:
        raise ValueError("more rules than an expression should hold: join them instead")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        name, verdict = F.when(fits, r).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last labels, one more where the last two are a known suffix."""
    label = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(label, F.greatest(F.size(label) - (n - 1), F.lit(1)), F.lit(n)), ".")
    two = last(2)
    double = two.isin(*SECOND)
    return F.when(double, last(3)).otherwise(two), F.when(double, two).otherwise(last(1))


def concentration(groups: DataFrame, prior: Column) -> float:
    """How firmly groups (y of n bad) keep to their prior means, by the method of moments for beta-binomials."""
    p = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    r = groups.agg(F.sum(n * F.pow(y / n - p, 2) / (p * (1 - p))).alias("s"), F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("q")).first()
    room = (r.n or 0) - (r.q or 0) / r.n - (r.k - 1) if r.n else 0
    if not r.n or room <= 0:
        return FIRM[1]
    rho = (r.s - (r.k - 1)) / room
    return min(FIRM[1], max(FIRM[0], (1 - rho) / rho)) if rho > 0 else FIRM[1]


def reputation(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior means and spreads: of hosts, domains and suffixes, and the corpus' rate.

    `pages` has page_id, host, domain, suffix; `outcomes` has page_id, bad (0 or 1), once a page.
    """
    hosts = pages.join(outcomes, "page_id").where("host <> ''").groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("y"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    base = (total.y + 1) / (total.n + 2) if total.n else 0.5
    up = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    c = concentration(up, F.lit(base))
    suffix = up.select("suffix", ((F.col("y") + c * base) / (F.col("n") + c)).alias("sm"), (F.col("n") + c).alias("sw"))
    mid = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).join(suffix, "suffix")
    c = concentration(mid, F.col("sm"))
    domain = mid.select("domain", ((F.col("y") + c * F.col("sm")) / (F.col("n") + c)).alias("dm"), (F.col("n") + c).alias("dw"))
    low = hosts.join(domain, "domain")
    c = concentration(low, F.col("dm"))
    host = low.select("host", ((F.col("y") + c * F.col("dm")) / (F.col("n") + c)).alias("hm"), (F.col("n") + c).alias("hw"))
    return host, domain, suffix, base


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; rules go before reputation.

    `outcomes`: page_id and bad, 0 or 1; several rows of a page count as one, bad if any
    is; nulls say nothing. A null url, or one without `://`, has an empty host, of which nothing is
    known, and is allowed. Repeated rows each get a row, and each counts in its host.
    """
    host, path = parts(F.col(url_col).cast("string"))
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    clean = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")  # of userinfo and port
    df = df.withColumn("key", clean)
    d, s = levels(F.col("key"))
    df = df.withColumns({"domain": d, "suffix": s})
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts, domains, suffixes, base = reputation(df.select("page_id", F.col("key").alias("host"), "domain", "suffix"), known)
    # reputation is joined to distinct hosts, and pages to those: the pages of a frequent host meet one row
    one = df.select("key", "domain", "suffix").distinct()
    one = one.join(hosts.withColumnRenamed("host", "key"), "key", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    mean = F.coalesce("hm", "dm", "sm", F.lit(base))
    weight = F.coalesce("hw", "dw", "sw", F.lit(1.0))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))
    one = one.select("key", F.when((F.col("key") != "") & (bound > limit), "block").otherwise("allow").alias("judged"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return df.join(one, "key").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "judged").alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of page_id: bad if of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _level(name: str, keys: str, source: str, prior: str, join: str = "") -> str:
    """SQL of one level: its groups `name`_g, its concentration `name`_c and its posteriors `name`."""
    p = f"least(greatest({prior}, 1e-6), 1 - 1e-6)"
    return f"""
{name}_g AS (SELECT g.*, {prior} AS prior, {p} AS p FROM (SELECT {keys}, sum(n)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM {source} GROUP BY ALL) g {join}),
{name}_s AS (SELECT sum(n * pow(y / n - p, 2) / (p * (1 - p))) AS s, count(*) AS k, sum(n) AS n, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room FROM {name}_g),
{name}_c AS (SELECT CASE WHEN n IS NULL OR room <= 0 OR s - (k - 1) <= 0 THEN {FIRM[1]} ELSE least({FIRM[1]}, greatest({FIRM[0]}, (1 - (s - (k - 1)) / room) / ((s - (k - 1)) / room))) END AS c FROM {name}_s),
{name} AS (SELECT g.*, (y + c * prior) / (n + c) AS m, n + c AS w FROM {name}_g g, {name}_c)"""


def _oracle() -> str:
    rules = sorted(RULES, key=lambda x: -len(x[0]))
    fit = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r, v in rules for h, _, p in [r.partition("/")])
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    second = ", ".join(f"'{x}'" for x in SECOND)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS key FROM b),
d AS (SELECT *, string_split(key, '.') AS l FROM c),
e AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two, array_to_string(l[greatest(len(l) - 2, 1):], '.') AS three FROM d),
f AS (SELECT page_id, host, path, key, CASE WHEN two IN ({second}) THEN three ELSE two END AS domain, CASE WHEN two IN ({second}) THEN two ELSE l[len(l)] END AS suffix FROM e),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h AS (SELECT key, domain, suffix, count(*) AS n, sum(bad) AS y FROM f JOIN o USING (page_id) WHERE key <> '' AND bad IS NOT NULL GROUP BY ALL),
base AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(y) + 1)::DOUBLE / (sum(n) + 2) ELSE 0.5 END AS r FROM h),
{_level("sx", "suffix", "h", "r", "CROSS JOIN base")},
{_level("dm", "domain, suffix", "h", "sx.m", "JOIN sx USING (suffix)")},
{_level("hs", "key, domain", "h", "dm.m", "JOIN dm USING (domain)")},
j AS (SELECT f.*, coalesce(hs.m, dm.m, sx.m, r) AS m, coalesce(hs.w, dm.w, sx.w, 1.0) AS w FROM f CROSS JOIN base LEFT JOIN hs ON f.key = hs.key LEFT JOIN dm ON f.domain = dm.domain LEFT JOIN sx ON f.suffix = sx.suffix),
k AS (SELECT page_id, host, path, CASE {fit} END AS rule, CASE WHEN key <> '' AND m - {Z} * sqrt(m * (1 - m) / (w + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS judged FROM j)
SELECT page_id, host, path, rule, CASE rule {said} ELSE judged END AS verdict FROM k
"""


ORACLE = _oracle()
