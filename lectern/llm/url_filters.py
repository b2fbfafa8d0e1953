"""URL filters: rules first, then an empirical-Bayes reputation of the host.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
wins. Each host's suffixes are looked up in the table of rules by an equi-join, once a host.

Pages that no rule fits are judged by what is known of labelled pages. Of n labelled pages of a host k are bad; k is taken
as beta-binomial, and its prior is shrunk down the chain of everything, public suffix, registered domain, host: the prior
mean of a child is the posterior mean of its parent, and the prior's precision at a level is estimated from how much the
children of all parents vary beyond binomial noise (method of moments):

    rho = sum((k - n m)^2 - n m (1 - m)) / sum(n (n - 1) m (1 - m)),  precision = 1 / rho - 1

A host is blocked where the lower bound of its posterior, mean - Z standard deviations, is above MAX_BAD. A host without
labelled pages has its domain's mean and the host level's precision, so it is never blocked on nothing.

Pages are counted by host and label key within tasks before they move, so a host or key with a third of all pages is a
few rows; verdicts go back to the pages as a broadcast of at most BROADCAST_IDS rows, else by a join that may split a hot
host. All of it is DataFrame expressions.

Cases: a null url and one without `://` have an empty host and path, which no rule fits, and count as one host; outcomes
that name a key several times count once, bad if any is; null keys have no outcome; without outcomes nothing is blocked by
reputation; repeated pages count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of bad pages that a host's lower bound must exceed to be blocked.
MAX_BAD = 0.25
#: Standard deviations below the mean: a one-sided bound of 95 %.
Z = 1.645
#: Bounds of a level's precision, and its value where no child has two labelled pages.
PRECISION = (1.0, 10_000.0, 10.0)
# Public suffixes of two labels that registries sell names under.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "co.in", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.tw")


def host_of(url: str = "url") -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    found = F.regexp_extract(_after(url), "^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """Behind the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: str) -> Column:
    text = F.coalesce(F.col(url), F.lit(""))
    return F.when(F.contains(text, F.lit("://")), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))


def domain_of(host: str = "host", suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(public suffix, registered domain). An address of numbers is its own domain, of an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), "^[^@]*@", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.when(F.size(labels) > n, F.array_join(F.slice(labels, -n, n), ".")).otherwise(bare)
    two = last(2).isin(*suffixes) if suffixes else F.lit(False)
    address = bare.rlike(r"^(?:[0-9.]+|\[.*)$")
    return F.when(address, "").when(two, last(2)).otherwise(last(1)), F.when(address, bare).when(two, last(3)).otherwise(last(2))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """rules as a table: verdict, host, path."""
    each = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*each))) if each else spark.range(0).select(*[F.lit("").alias(n) for n in ("verdict", "host", "path")])


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules (array of size, on, verdict, path, rule): the rules whose host is this one or a domain above it; hosts
    without any are left out."""
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - deepest + 1)
    above = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    said = rules.select(F.col("host").alias("on_host"), F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("on"), "verdict", "path", F.concat("host", "path").alias("rule")).alias("rule"))
    return hosts.select("host", F.explode(above).alias("on_host")).join(said, "on_host").groupBy("host").agg(F.collect_set("rule").alias("rules"))


def _precision(children: DataFrame) -> float:
    """The precision of a level, of its children (n, bad, prior: the parent's mean)."""
    low, high, unknown = PRECISION
    spread = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) - F.col("n") * F.col("prior") * (1 - F.col("prior")))
    room = F.sum(F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior")))
    spread, room = children.agg(spread, room).first()
    if not room:
        return unknown
    rho = min(max(spread / room, 1 / (high + 1)), 1 / (low + 1))
    return 1 / rho - 1


def reputation(hosts: DataFrame) -> DataFrame:
    """host, suffix, domain, n, bad, mean, low (of the posterior share of bad pages), of hosts (host, n, bad: labelled pages
    and the bad ones of them)."""
    suffix, domain = domain_of()
    hosts = common.table(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"), "hosts")
    sums = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    level = common.table(sums("suffix").withColumn("prior", F.lit(bad / n if n else 0.0)), "suffixes")
    for name, keys, children in (("domains", ["suffix"], sums("suffix", "domain")), ("rated", ["suffix", "domain"], hosts)):
        s = _precision(level)
        mean = (F.col("bad") + s * F.col("prior")) / (F.col("n") + s)
        level = common.table(children.join(level.select(*keys, mean.alias("prior")), keys), name)
    s = _precision(level)
    mean, weight = (F.col("bad") + s * F.col("prior")) / (F.col("n") + s), F.col("n") + s
    rated = level.select("host", "suffix", "domain", "n", "bad", mean.alias("mean"), weight.alias("weight"))
    low = F.greatest(F.lit(0.0), F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)))
    return rated.withColumn("low", low).drop("weight")


def labelled_hosts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad of pages (host, label_key) and outcomes (label_key, bad: boolean)."""
    pages = pages.groupBy("host", "label_key").agg(F.count(F.lit(1)).alias("pages"))
    known = outcomes.filter("label_key is not null").groupBy("label_key").agg(F.max("bad").alias("x_bad"))
    met = pages.join(known, "label_key", "left")
    return met.groupBy("host").agg(F.sum(F.when(F.col("x_bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.when(F.col("x_bad"), F.col("pages")).otherwise(0)).alias("bad"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame | None = None, label_key: str = "page_id", max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict (allow or block) of every page (page_id, url). outcomes
    (label_key, bad) are labelled pages, found by pages' column or expression label_key."""
    rules = rules if rules is not None else rule_table(pages.sparkSession)
    held = pages.select("page_id", host_of().alias("host"), path_of().alias("path"), F.expr(label_key).alias("label_key"))
    rated = common.table(reputation(labelled_hosts(held, outcomes)), "reputation")
    bad = rated.filter(F.col("low") > max_bad).select("host", F.lit(True).alias("bad"))
    known = rules_of_hosts(rated.select("host"), rules).join(bad, "host", "full")
    known, n = common.table_n(known, "known")
    held = held.select("page_id", "host", "path").join(F.broadcast(known) if n <= common.BROADCAST_IDS else known.hint("merge"), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    out = held.select("page_id", "host", "path", best.alias("best"), "bad")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


#: The test pages are made of documents: the number that ends a url's path is the doc_id, by which labels are known.
LABEL_KEY = r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)[^0-9?#]*(?:[?#]|$)', 1) as bigint)"


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("label_key"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, label_key=LABEL_KEY)


def _level_sql(children: str) -> str:
    low, high, unknown = PRECISION
    rho = "sum(power(bad - n * prior, 2) - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior))"
    return f"(select case when coalesce(sum(n * (n - 1) * prior * (1 - prior)), 0) = 0 then {unknown} else 1 / least(greatest({rho}, 1 / {high + 1}::double), 1 / {low + 1}::double) - 1 end from {children})"


_LISTED = ", ".join(f"'{x}'" for x in SUFFIXES)
_RULE_SQL = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{}}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_BY_SIZE = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP12_SQL = rf"""
with cut as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), seen as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    try_cast(nullif(regexp_extract(url, '^[^?#]*/([0-9]+)[^0-9?#]*(?:[?#]|$)', 1), '') as bigint) as k from cut
), outcomes as (
  select doc_id as k, max((toxic = 1 or quality = 0)::int) as bad from labels where doc_id is not null group by doc_id
), counted as (
  select host, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^[^@]*@', '') as bare, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from seen left join outcomes using (k) group by host
), named as (
  select *, string_split(bare, '.') as l, array_to_string(string_split(bare, '.')[-2:], '.') in ({_LISTED}) as two, regexp_matches(bare, '^(?:[0-9.]+|\[.*)$') as address from counted
), hosts as (
  select host, n, bad, case when address then '' when two then array_to_string(l[-2:], '.') else l[-1] end as suffix, case when address then bare when two then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from named
), suffixes as (
  select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad, (select case when sum(n) > 0 then sum(bad) / sum(n)::double else 0.0 end from hosts) as prior from hosts group by suffix
), s1 as (select suffix, (bad + p * prior) / (n + p) as mean from suffixes, (select {_level_sql("suffixes")} as p)
), domains as (
  select h.suffix, domain, sum(n)::bigint as n, sum(bad)::bigint as bad, any_value(s1.mean) as prior from hosts h join s1 using (suffix) group by h.suffix, domain
), s2 as (select suffix, domain, (bad + p * prior) / (n + p) as mean from domains, (select {_level_sql("domains")} as p)
), kids as (select host, n, bad, mean as prior from hosts join s2 using (suffix, domain)
), rated as (select host, n + p as w, (bad + p * prior) / (n + p) as m from kids, (select {_level_sql("kids")} as p)
)
select page_id, host, path, case {_RULE_SQL.format(*[h + p for _, h, p in _BY_SIZE])} end as rule,
  case {_RULE_SQL.format(*[v for v, _, _ in _BY_SIZE])} else case when m - {Z} * sqrt(m * (1 - m) / (w + 1)) > {MAX_BAD} then 'block' else 'allow' end end as verdict
from seen join rated using (host)
"""
