"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree domain - language - source. At each node it is divided among the children by weight; a
child that cannot use its share keeps what it can, and the shortage goes to its siblings by weight, and to the parent's
siblings only when all of them are full. Each division is one ordered window over the children, without iteration. A leaf
then takes whole epochs of its documents and the token-prefix of one more, in an order seeded for each epoch.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

LEAF = ["domain", "lang", "source"]
#: Words as token measure: runs of anything but space and the characters 9 to 13.
WORDS = r"[^\x20\x09-\x0D]+"


def divide(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children`` (parents, name, budget of the parent, capacity, weight) with ``given``.

    In the order of capacity / weight the children that fill up come first, so the level of the others follows from
    running sums.
    """
    full_at = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    at = Window.partitionBy(*parents).orderBy("full_at", name)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    rest = at.rowsBetween(0, Window.unboundedFollowing)
    everyone = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = children.withColumn("full_at", full_at)
    weights = F.sum("weight").over(rest)
    rows = rows.withColumn("level", F.when(weights > 0, (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / weights).otherwise(F.lit(0.0)))
    rows = rows.withColumn("full", (F.col("weight") > 0) & (F.col("full_at") <= F.col("level")))
    rows = rows.withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everyone))
    given = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * F.greatest(F.col("level"), F.lit(0.0)))
    return rows.withColumn("given", given).drop("full_at", "level", "full")


def _weight(column: str, weights: Mapping[str, float]) -> Column:
    """The weight of a name; 1 for names that are not listed."""
    found = F.lit(1.0)
    for name, weight in weights.items():
        found = F.when(F.col(column) == name, F.lit(float(weight))).otherwise(found)
    return found


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget`` in whole tokens."""
    # A child of weight zero can use nothing, so it offers its parent no capacity either.
    weighed = lambda df, c: df.withColumn("weight", _weight(c, weights.get(c, {}))).withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0.0)))
    upward = lambda df, *by: df.groupBy(*by).agg(F.sum("capacity").alias("capacity"))
    sizes = weighed(leaves.withColumn("capacity", F.col("tokens").cast("double") * epochs), "source").drop("weight")
    langs = weighed(upward(sizes, "domain", "lang"), "lang")
    total = leaves.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    domains = upward(langs, "domain").withColumn("root", F.lit(0)).withColumn("budget", F.lit(math.floor(total * share) * 1.0))
    domains = divide(weighed(domains, "domain"), ["root"], "domain").select("domain", F.col("given").alias("budget"))
    langs = divide(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    found = divide(weighed(sizes.join(langs, ["domain", "lang"]), "source"), ["domain", "lang"], "source")
    return found.select(*LEAF, "tokens", F.floor("given").cast("long").alias("budget"))


def order_key(epoch: Column, seed: int) -> Column:
    """Seeded order of a document in an epoch, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan_mixture(measured: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]], seed: int) -> DataFrame:
    """A row for each leaf of ``measured`` (doc_id, leaf, tokens): whole epochs, and where the prefix of one more ends.

    The prefix is found over hashed slices of the order: slice sums first, then only the documents of the slice in which
    the budget ends. With as many slices as the square root of the number of documents, neither step has a large group.
    """
    leaves = measured.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    slices = max(1, math.isqrt(leaves.agg(F.sum("docs")).first()[0] or 0))
    budgets = leaf_budgets(leaves.drop("docs"), share, epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    plan = materialise(budgets.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    ordered = measured.join(plan.select(*LEAF, "epochs", "rest"), LEAF).withColumn("key", order_key(F.col("epochs"), seed))
    ordered = ordered.withColumn("slice", _slice(F.col("key"), slices))
    upto = Window.partitionBy(*LEAF).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ordered.groupBy(*LEAF, "slice").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest")).withColumn("end", F.sum("held").over(upto))
    ends = sums.where("end > rest").groupBy(*LEAF).agg(F.min_by(F.struct("slice", (F.col("end") - F.col("held")).alias("start")), "slice").alias("last"))
    running = Window.partitionBy(*LEAF).orderBy("key", "tokens")  # rows that tie stand or fall together
    inside = ordered.join(ends, LEAF).where("slice = last.slice").withColumn("end", F.col("last.start") + F.sum("tokens").over(running))
    cuts = inside.where("end <= rest").groupBy(*LEAF).agg(F.max(F.struct("key", "tokens")).alias("cut"))
    return (
        plan.join(ends.select(*LEAF, F.col("last.slice").alias("last_slice")), LEAF, "left").join(cuts, LEAF, "left")
        .select(*LEAF, "budget", "epochs", "rest", "last_slice", "cut", F.lit(slices).alias("slices"))
    )


def _slice(key: Column, slices: int | Column) -> Column:
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(high * (F.lit(slices) if isinstance(slices, int) else slices) / F.lit(1 << 32)).cast("int")


def mix(
    docs: DataFrame, domain: Column, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]], seed: int = 7,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch) for every use of a document in the mixture.

    The budget is ``share`` of all tokens and no document is used more than ``epochs`` times. Null names count as '';
    null and empty texts have no tokens and cost nothing; a null doc_id is ordered as the word null; rows that repeat a
    doc_id with as many tokens are used alike; an empty table gives no rows. With ``carry`` all columns of ``docs`` are
    returned, once for each use. A name of weight zero gets nothing, and what it holds counts for no capacity above it. Only the rows' sizes are shuffled: a document compares its own order key with its leaf's cut.
    """
    name = lambda c: F.coalesce(c, F.lit(""))
    leaf = [name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source")]
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("tokens")
    measured = materialise(docs.select("doc_id", *leaf, tokens), "measured")
    plan = materialise(plan_mixture(measured, share, epochs, weights, seed), "mixture")
    plan = plan.hint("broadcast") if plan.count() <= 100_000 else plan
    rows = docs.select("doc_id", *leaf, tokens, F.struct(*docs.columns).alias("row")) if carry else measured
    key = order_key(F.col("epochs"), seed)
    joined = rows.join(plan, LEAF).withColumn("key", key).withColumn("slice", _slice(F.col("key"), F.col("slices")))
    in_prefix = F.col("last_slice").isNull() | (F.col("slice") < F.col("last_slice")) | ((F.col("slice") == F.col("last_slice")) & F.coalesce(F.struct("key", "tokens") <= F.col("cut"), F.lit(False)))
    more = in_prefix & ((F.col("rest") > 0) | (F.col("epochs") == 0))
    uses = F.col("epochs") + F.when(more, 1).otherwise(0)
    used = joined.withColumn("uses", uses).where("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    return used.select("row.*") if carry else used.select("doc_id", *LEAF, "tokens", "epoch")


#: Production weights: domains are the source numbers modulo 4.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def source_domain() -> Column:
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)) % 4)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), source_domain(), share=0.8, epochs=2, weights=WEIGHTS)


def _divide_sql(source: str, parents: str, name: str, kept: str) -> str:
    return f"""
  select {kept}, case when is_full then capacity else weight * greatest(first_level, 0) end as given from (
    select *, first_value(case when not is_full then level end ignore nulls) over (partition by {parents} order by full_at, {name} rows between unbounded preceding and unbounded following) as first_level from (
      select *, weight > 0 and full_at <= level as is_full from (
        select *, case when w > 0 then (budget - coalesce(caps, 0)) / w else 0 end as level from (
          select *, sum(capacity) over (partition by {parents} order by full_at, {name} rows between unbounded preceding and 1 preceding) as caps,
            sum(weight) over (partition by {parents} order by full_at, {name} rows between current row and unbounded following) as w from (
            select *, case when weight > 0 then capacity / weight else 'inf'::double end as full_at from ({source}))))))"""


OP8_SQL = f"""
with m as (
  select doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int), 0) % 4) as domain, coalesce(lang, '') as lang,
    coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents),
l as (select domain, lang, source, sum(tokens)::bigint as tokens, sum(tokens)::double * 2 as capacity from m group by all),
ds as (select domain, 0 as root, sum(capacity) as capacity, case domain when 'd0' then 4.0::double when 'd1' then 3 when 'd2' then 2 else 1 end as weight,
    floor((select sum(tokens)::double from l) * 0.8::double) as budget from l group by domain),
dd as ({_divide_sql("select * from ds", "root", "domain", "domain")}),
ls as (select domain, lang, sum(capacity) as capacity, any_value(given) as budget,
    case lang when 'en' then 5.0::double when 'de' then 2 when 'fr' then 2 else 1 end as weight from l join dd using (domain) group by domain, lang),
ll as ({_divide_sql("select * from ls", "domain", "lang", "domain, lang")}),
ss as (select domain, lang, source, tokens, capacity, given as budget, 1.0::double as weight from l join ll using (domain, lang)),
sd as ({_divide_sql("select * from ss", "domain, lang", "source", "domain, lang, source, tokens")}),
p as (select domain, lang, source, floor(given)::bigint as budget, case when tokens > 0 then floor(floor(given) / tokens) else 0 end::int as epochs,
    tokens as whole from sd),
r as (select m.*, epochs, budget - epochs * whole as rest,
    sum(tokens) over (partition by domain, lang, source order by md5('7:' || epochs || ':' || coalesce(doc_id::varchar, 'null')), tokens) as upto
  from m join p using (domain, lang, source)),
u as (select *, epochs + case when upto <= rest and (rest > 0 or epochs = 0) then 1 else 0 end as uses from r)
select doc_id, domain, lang, source, tokens, unnest(range(uses))::int as epoch from u where uses > 0
"""
