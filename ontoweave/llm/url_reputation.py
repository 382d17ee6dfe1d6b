"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host; Spark expressions only.

Labelled page outcomes are counted by host, registered domain and suffix. A beta prior passes down that chain: the
suffix is shrunk towards the overall rate, the domain towards its suffix and the host towards its domain, each with a
concentration fitted by moments. A host is blocked when the lower posterior bound of its bad rate exceeds a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


# Suffixes of two labels under which domains are registered; a caller may pass the whole public list.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "co.nz", "com.tr", "com.tw", "co.za",
    "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "vercel.app",
)


def site(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user and port; an address in numbers is a domain of its own."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    number = name.rlike(r"^(\[.*|[0-9]{1,3}([.][0-9]{1,3}){3})$")
    last, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    known = two.isin(*suffixes)
    domain = F.when(number, name).when(known, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(number, "number").when(known, two).otherwise(last)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url and for one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == F.lit(at)) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(at + prefix).alias("rule"))).otherwise(found)
    return found


def _concentration(groups: DataFrame, floor: float, ceiling: float) -> tuple[float, float]:
    """Overall rate and moment estimate of the beta concentration of groups with columns n and bad."""
    row = groups.where("n > 0").agg(
        F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("squares"), F.count("*").cast("double").alias("k"),
    ).first()
    n, bad = row["n"] or 0.0, row["bad"] or 0.0
    rate = (bad + 1.0) / (n + 2.0)
    if not n:
        return rate, ceiling
    mean = bad / n
    # Between-group variance above what binomial noise alone gives.
    spread = row["squares"] - n * mean * mean - row["k"] * mean * (1.0 - mean)
    if spread <= 0:
        return rate, ceiling
    return rate, min(ceiling, max(floor, n * mean * (1.0 - mean) / spread))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float, floor: float, ceiling: float, two_labels: Sequence[str] = SUFFIXES) -> DataFrame:
    """A row for each host of ``pages`` (columns page_id, host): its posterior bad rate and lower bound.

    ``outcomes``: page_id, bad (0 or 1); several for one page all count, nulls don't. ``two_labels``: suffixes of two labels.
    """
    domain, suffix = site(F.col("host"), two_labels)
    seen = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = (
        pages.join(seen, "page_id", "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("*", domain.alias("domain"), suffix.alias("suffix"))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate, k_suffix = _concentration(suffixes, floor, ceiling)
    _, k_domain = _concentration(domains, floor, ceiling)
    _, k_host = _concentration(hosts, floor, ceiling)

    def shrunk(prior: Column | float, k: float) -> Column:
        return (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))

    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), k_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_rate"), k_domain).alias("domain_rate"))
    a = F.col("bad") + F.lit(k_host) * F.col("domain_rate")
    whole = F.col("n") + F.lit(k_host)
    mean = a / whole
    deviation = F.sqrt(mean * (F.lit(1.0) - mean) / (whole + F.lit(1.0)))
    return hosts.join(domains, "domain").select("host", mean.alias("bad_rate"), (mean - F.lit(z) * deviation).alias("bad_bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.25,
    z: float = 1.645, floor: float = 2.0, ceiling: float = 200.0,
) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with its verdict: the longest fitting rule's, else by host reputation.

    A null url has an empty host and path and is judged with the other empty hosts; rows with null or repeated ids are
    each judged; an empty table gives no rows and other columns are ignored. Without any outcome all hosts share the
    prior, which allows. The join of pages with hosts is on an equality, so Spark splits a host with most of the rows.
    """
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    scores = host_reputation(pages.select("page_id", "host"), outcomes, z, floor, ceiling)
    rule = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))
    return pages.join(scores, "host").withColumn("by_rule", rule).select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(F.col("by_rule.verdict"), own).alias("verdict"),
        F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"),
    )


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad when the labelled document of the same number is of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes)


OP9_SQL = """
with p as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
seen as (
  select doc_id as page_id, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
  from labels where doc_id is not null and (quality is not null or toxic = 1) group by 1),
named as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name from q),
labelled as (select *, array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') as two, regexp_matches(name, '^(\\[.*|[0-9]{1,3}([.][0-9]{1,3}){3})$') as number from named),
h as (
  select host, coalesce(sum(n), 0)::double as n, coalesce(sum(bad), 0)::double as bad,
         any_value(case when number then name when two in (@SUFFIXES) then array_to_string(list_slice(string_split(name, '.'), -3, -1), '.') else two end) as domain,
         any_value(case when number then 'number' when two in (@SUFFIXES) then two else string_split(name, '.')[-1] end) as suffix
  from labelled left join seen using (page_id) group by host),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
m as (
  select level, sum(n) as n, sum(bad) as bad, sum(bad * bad / n) as squares, count(*)::double as k from (
    select 1 as level, n, bad from s union all select 2, n, bad from d union all select 3, n, bad from h) where n > 0 group by level),
e as (
  select level, (bad + 1) / (n + 2) as rate, n * (bad / n) * (1 - bad / n) as top,
         squares - n * (bad / n) * (bad / n) - k * (bad / n) * (1 - bad / n) as spread from m),
k as (select level, rate, case when spread <= 0 then 200.0::double else least(200.0::double, greatest(2.0::double, top / spread)) end as k from e),
sr as (select suffix, (bad + k * rate) / (n + k) as rate from s, k where level = 1),
dr as (select domain, (bad + k * sr.rate) / (n + k) as rate from d join sr using (suffix), k where level = 2),
hr as (select host, (bad + k * dr.rate) / (n + k) as rate, n + k as whole from h join dr using (domain), k where level = 3),
b as (select host, rate, rate - 1.645::double * sqrt(rate * (1 - rate) / (whole + 1)) as bound from hr),
r as (
  select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as v(verdict, site, prefix)),
f as (
  select page_id, q.host, path, (select arg_max(struct_pack(v := verdict, r := site || prefix), length(site || prefix)) from r
    where (q.host = site or ends_with(q.host, '.' || site)) and starts_with(path, prefix)) as hit from q)
select page_id, f.host, path, hit.r as rule, coalesce(hit.v, case when bound > 0.25 then 'block' else 'allow' end) as verdict,
       round(rate, 6) as bad_rate, round(bound, 6) as bad_bound
from f join b using (host)
""".replace("@SUFFIXES", ", ".join(f"'{x}'" for x in SUFFIXES))
