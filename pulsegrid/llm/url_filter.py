"""URL filter by empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: Fixed values: (verdict, host, path) rules of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labels that make a public suffix of two labels in front of a country's two letters, as in co.uk; further suffixes are a parameter.
SECOND_LABELS = ("ac", "co", "com", "edu", "gov", "go", "ne", "net", "or", "org")
SUFFIXES: tuple[str, ...] = ()
#: An address in place of a name, without its port.
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"
MIN_REPUTATION = 0.5
Z = 1.0
STRENGTH = (2.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (as host followed by path) and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain (one label more) of a host without user and port.

    The suffix is the last label; the last two where they are in ``suffixes``, or one of SECOND_LABELS and a country's two letters. An address is its own suffix and domain.
    """
    name = F.regexp_replace(host, r"^.*@|:\d*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    two = F.rlike(last(2), F.lit(rf"^(?:{'|'.join(SECOND_LABELS)})\.[a-z][a-z]$")) | (last(2).isin(*suffixes) if suffixes else F.lit(False))
    address = F.rlike(name, F.lit(ADDRESS))
    return F.when(address, name).when(two, last(2)).otherwise(last(1)), F.when(address, name).when(two, last(3)).otherwise(last(2))


def _strength(rates: DataFrame, least: float, most: float) -> float:
    """Prior strength by the method of moments from rows n, s, m (trials, successes, the parent's mean).

    Chi-square-like: the average of (s - n m)^2 / (n m (1 - m)) is 1 + (average n - 1) rho, rho = 1 / (strength + 1).
    """
    m = F.least(F.greatest(F.col("m"), F.lit(1e-3)), F.lit(1 - 1e-3))
    r = rates.where("n > 0").agg(F.avg((F.col("s") - F.col("n") * m) ** 2 / (F.col("n") * m * (1 - m))).alias("x"), F.avg("n").alias("n")).first()
    if r["x"] is None or r["n"] <= 1:
        return least
    rho = (r["x"] - 1) / (r["n"] - 1)
    return most if rho <= 1 / (most + 1) else max(least, 1 / rho - 1)


def host_reputation(outcomes: DataFrame, strength: tuple[float, float] = STRENGTH, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Posterior of each host from rows (host, good), good true, false or null (a page without label).

    Successes of a level are shrunk towards its parent's posterior mean: all pages to suffix to registered
    domain to host. Each level's beta-binomial prior strength comes from the data by the method of moments,
    within ``strength``. Counts are combined before the shuffle; a level is one row for each of its names.

    Returns host, suffix, domain, n, s, alpha, beta.
    """
    low, high = strength
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    good = F.col("good")
    hosts = outcomes.groupBy("host").agg(F.count(good).alias("n"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("s"))
    hosts = written(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "s"), "url-hosts")
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    prior = F.lit(mean)
    levels = []
    parent: DataFrame | None = None
    for keys in (["suffix"], ["suffix", "domain"], ["suffix", "domain", "host"]):
        rows = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        rows = rows.withColumn("m", prior) if parent is None else rows.join(parent, keys[:-1])
        rows = written(rows, f"url-{keys[-1]}")
        k = _strength(rows, low, high)
        rows = rows.withColumns({"alpha": F.col("s") + k * F.col("m"), "beta": F.col("n") - F.col("s") + k * (1 - F.col("m"))})
        levels.append(rows)
        parent = rows.select(*keys, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m"))
    return levels[-1].select("host", "suffix", "domain", "n", "s", "alpha", "beta")


def filter_urls(
    pages: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str | None = None,
    min_reputation: float = MIN_REPUTATION,
    z: float = Z,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """Judge each page by the longest rule that fits, else by its host's reputation.

    Labelled pages are those with a non-null boolean ``label_col``, or without one those that a rule decides
    (allowed: good). A page without rule is blocked where its host's posterior mean plus ``z`` posterior standard
    deviations is below ``min_reputation``: where we are sure enough that the host is bad. Where nothing is
    labelled the prior mean is 1/2 and nothing is blocked.

    Nulls: a null url, or one without ``://``, has an empty host and path and is judged as host ''. Repeated rows are
    judged alike, each on its own; an empty table gives an empty result; other columns are ignored.

    Returns page_id, host, path, rule, verdict, reputation, bound.
    """
    host, path = host_and_path(F.col(url_col))
    label = F.lit(None).cast("boolean") if label_col is None else F.col(label_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("good"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    if label_col is None:
        rows = rows.withColumn("good", F.col("ruled") == "allow")
    rows = written(rows, "url-rows")
    known = host_reputation(rows, suffixes=suffixes)
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    known = written(known.select(F.col("host").alias("_host"), mean.alias("reputation"), (mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound")), "url-known")
    judged = F.coalesce("ruled", F.when(F.col("bound") < min_reputation, "block").otherwise("allow"))
    return rows.join(known, F.col("host") == F.col("_host")).select("page_id", "host", "path", "rule", judged.alias("verdict"), "reputation", "bound")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, keys: str, parent: str | None) -> str:
    """One level of the hierarchy in SQL: its counts with the parent's mean, the prior strength by moments, and the posterior."""
    low, high = STRENGTH
    mean = f"JOIN {parent} USING ({keys.rpartition(', ')[0]})" if parent else ", (SELECT (coalesce(sum(s), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts)"
    return f"""{name}_c AS (SELECT {keys}, g.n, g.s, m FROM (SELECT {keys}, sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s FROM hosts GROUP BY ALL) g {mean}),
{name}_x AS (SELECT avg((s - n * m) * (s - n * m) / (n * m * (1 - m))) AS x, avg(n) AS n FROM (SELECT n, s, least(greatest(m, 1e-3), 1 - 1e-3) AS m FROM {name}_c WHERE n > 0)),
{name}_k AS (SELECT CASE WHEN x IS NULL OR n <= 1 THEN {low} WHEN (x - 1) / (n - 1) <= 1 / ({high} + 1) THEN {high} ELSE greatest({low}, (n - 1) / (x - 1) - 1) END AS k FROM {name}_x),
{name} AS (SELECT {keys}, s + k * m AS a, n - s + k * (1 - m) AS b, (s + k * m) / (n + k) AS m FROM {name}_c, {name}_k)"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE_SQL = rf"""
WITH rules(v, rh, rp) AS (VALUES {_RULES}),
t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
ruled AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
names AS (SELECT host, regexp_replace(host, '^.*@|:\d*$', '', 'g') AS name, count(v) AS n, count(CASE WHEN v = 'allow' THEN 1 END) AS s FROM ruled GROUP BY host),
labels AS (SELECT host, n, s, name, string_split(name, '.') AS l, regexp_matches(name, '{ADDRESS}') AS address FROM names),
parts AS (SELECT *, regexp_matches(array_to_string(l[-2:], '.'), '^(?:{"|".join(SECOND_LABELS)})\.[a-z][a-z]$') AS two FROM labels),
hosts AS (SELECT host, n, s, CASE WHEN address THEN name WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix, CASE WHEN address THEN name ELSE array_to_string(CASE WHEN two THEN l[-3:] ELSE l[-2:] END, '.') END AS domain FROM parts),
{_level("l1", "suffix", None)},
{_level("l2", "suffix, domain", "(SELECT suffix, m FROM l1)")},
{_level("l3", "suffix, domain, host", "(SELECT suffix, domain, m FROM l2)")}
SELECT page_id, ruled.host, path, rule, coalesce(v, CASE WHEN m + {Z} * sqrt(m * (1 - m) / (a + b + 1)) < {MIN_REPUTATION} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled JOIN l3 ON l3.host = ruled.host
"""
