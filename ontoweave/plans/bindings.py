"""How the driver's tables stand for a knowledge graph.

Parts are leaf terms below their brand and their type, which are below a root; customers are annotated with the
parts they ordered, with their number of lines against that of the customer's most ordered part as frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ontology
from ..operators.lineage import parts_for, settle
from .registry import table


def is_a(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    part, brand, kind = F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), F.concat(F.lit("brand:"), F.col("p_brand")), F.concat(F.lit("type:"), F.col("p_type"))
    low = p.select(F.explode(F.array(F.struct(part.alias("child"), brand.alias("parent")), F.struct(part.alias("child"), kind.alias("parent")))).alias("e"))
    high = p.select(F.explode(F.array(brand, kind)).alias("child")).distinct().withColumn("parent", F.lit("root"))
    return low.select("e.child", "e.parent").repartition(parts_for(p.count()), "child").distinct().unionByName(high)


def coded_is_a(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The edges of ``is_a`` with numbers for terms, and (name, code) of those above the parts. A part's number is twice its key, the others' are odd and in the
    order of their names.

    Numbers take the place of strings where terms meet every line and the result names none.
    """
    p = table(spark, d, "part")
    part, brand, kind = F.col("p_partkey") * 2, F.concat(F.lit("brand:"), F.col("p_brand")), F.concat(F.lit("type:"), F.col("p_type"))
    names = p.select(F.explode(F.array(brand, kind)).alias("name")).where("name is not null").distinct().orderBy("name")
    codes = settle(names.select("name", (F.monotonically_increasing_id() * 2 + 1).alias("code")), "codes")
    low = p.select(part.alias("child"), F.explode(F.array(brand, kind)).alias("name")).join(codes, "name").select("child", F.col("code").alias("parent"))
    return low.repartition(parts_for(p.count()), "child").distinct().unionByName(codes.select(F.col("code").alias("child"), F.lit(-1).cast("long").alias("parent"))), codes


def closed(spark: SparkSession, d: str) -> DataFrame:
    """The closure table, built from the tables as they are now."""
    return ontology.closure(is_a(spark, d))


def index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(closure, annotations, propagated annotations, term weights), each settled once."""
    shut, ann = closed(spark, d), settle(annotations(spark, d), "annotations")
    prop = settle(ontology.propagate(ann, shut), "propagated")
    return shut, ann, prop, settle(ontology.term_weights(prop), "weights")


def lines_by_order(spark: SparkSession, d: str, *columns: Column | str, lines: DataFrame | None = None) -> DataFrame:
    """(o_orderkey, o_custkey, l_partkey, *columns of lines) of lines with an order, joined in partitions of bounded size; ``lines`` may hold the table's rows with more columns."""
    orders = table(spark, d, "orders")
    of = parts_for(max(table(spark, d, "lineitem").count(), orders.count()))
    lines = table(spark, d, "lineitem") if lines is None else lines
    held = orders.select("o_orderkey", "o_custkey").repartition(of, "o_orderkey").hint("shuffle_hash")  # its partitions are small, so lines need no sort
    met = held.join(lines.select("l_orderkey", "l_partkey", *columns).repartition(of, "l_orderkey"), F.expr("o_orderkey = l_orderkey"))
    return met.drop("l_orderkey")


def lines_by_customer(spark: SparkSession, d: str, *columns: Column | str, lines: DataFrame | None = None) -> DataFrame:
    """(o_custkey, l_partkey, *columns of lines) of lines with an order, dealt by customer in partitions of bounded size."""
    return lines_by_order(spark, d, *columns, lines=lines).drop("o_orderkey").repartition(parts_for(table(spark, d, "lineitem").count()), "o_custkey")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    # One shuffle, by customer, serves the counts and the window.
    n = lines_by_customer(spark, d).groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    freq = F.col("n") / F.max("n").over(Window.partitionBy("o_custkey"))
    return n.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("entity"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("term"), freq.alias("freq"))


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()


#: The same bindings in DuckDB SQL, as the head of a query.
ONTOLOGY_SQL = """
with recursive is_a as (
  select 'part:' || p_partkey as child, 'brand:' || p_brand as parent from part union select 'part:' || p_partkey, 'type:' || p_type from part
  union select 'brand:' || p_brand, 'root' from part union select 'type:' || p_type, 'root' from part),
nodes as (select child as n from is_a union select parent from is_a),
up(descendant, ancestor, depth) as (
  select n, n, 0 from nodes union select u.descendant, i.parent, u.depth + 1 from up u join is_a i on u.ancestor = i.child),
closed as (select descendant, ancestor, min(depth)::int as depth from up group by all),
lines as (select o_custkey, l_partkey, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by all),
ann as (select 'customer:' || o_custkey as entity, 'part:' || l_partkey as term, n::double / max(n) over (partition by o_custkey) as freq from lines),
prop as (select entity, ancestor as term, max(freq) as freq from ann join closed on term = descendant group by all),
total as (select count(distinct entity)::double as t from prop),
weights as (select term, count(*) as df, ln(any_value(t) / count(*)) as ic, ln(any_value(t) / count(*)) / ln(any_value(t)) as specificity from prop, total group by term)
"""
