"""Map the driver's generated tables onto the cohort roles (FIXTURES.md §2).

Each function returns a DataFrame with the column contract the operators
expect (the names of the clinical tables), derived by Spark from the given
tables so that the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.codesets import FIXTURE_CHART_TYPES, FIXTURE_EVENT_TYPES, FIXTURE_LAB_TYPES
from wardlens.sources.tables import Tables


def stays(t: Tables) -> DataFrame:
    """stays: one row per order; los = number of line items, end = start + los days."""
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    los = F.coalesce(F.col("n_items"), F.lit(0)).cast("int")
    # both sides grow with the input: neither is sent through the driver
    return (o.join(counts.hint("merge"), o.o_orderkey == counts.l_orderkey, "left")
            .select(F.col("o_custkey").alias("subject_id"),
                    F.col("o_orderkey").alias("hadm_id"),
                    F.col("o_orderkey").alias("icustay_id"),
                    F.col("o_orderpriority").alias("first_careunit"),
                    F.col("o_orderdate").alias("intime"),
                    (F.col("o_orderdate") + F.make_dt_interval(days=los)).alias("outtime"),
                    los.cast("double").alias("los")))


def subjects(t: Tables) -> DataFrame:
    """subjects: customer; gender stand-in = segment, birth = 1995-01-01 - floor(2*acctbal) days."""
    dob = F.date_sub(F.lit("1995-01-01").cast("date"), F.floor(F.col("c_acctbal") * 2).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("subject_id"),
                             F.col("c_mktsegment").alias("gender"),
                             dob.alias("dob"))


def visits(t: Tables) -> DataFrame:
    """visits: orders; raw discharge location = status, ethnicity/language from priority."""
    pr = F.col("o_orderpriority")
    language = F.when(pr == "4-NOT SPECIFIED", F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("L"), F.substring(pr, 1, 1)))
    return t.orders.select(F.col("o_custkey").alias("subject_id"),
                           F.col("o_orderkey").alias("hadm_id"),
                           F.col("o_orderdate").alias("admittime"),
                           F.col("o_orderstatus").alias("discharge_location"),
                           language.alias("language"),
                           F.col("o_orderstatus").alias("insurance"),
                           pr.alias("ethnicity"),
                           F.col("o_orderdate").alias("dischtime"))


def deaths(t: Tables) -> DataFrame:
    """death records: finished orders; expire flag = urgent priority."""
    o = t.orders
    return o.select(F.col("o_custkey").alias("subject_id"),
                    F.col("o_orderkey").alias("hadm_id"),
                    F.when(o.o_orderstatus == "F", o.o_orderdate).alias("deathtime"),
                    F.when(o.o_orderpriority == "1-URGENT", 1).otherwise(0).alias("hospital_expire_flag"))


def code_dictionary(t: Tables) -> DataFrame:
    """code dictionary: part key as code, part name as title."""
    return t.part.select(F.col("p_partkey").cast("string").alias("icd9_code"),
                         F.col("p_name").alias("long_title"))


def code_facts(t: Tables) -> DataFrame:
    """coded facts: one per line item, subject and visit from its order."""
    li = t.lineitem.select("l_orderkey", "l_partkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    return (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("subject_id"),
                    F.col("l_orderkey").alias("hadm_id"),
                    F.col("l_partkey").cast("string").alias("icd9_code")))


def _item_id() -> F.Column:
    pos = None
    for i, et in enumerate(FIXTURE_EVENT_TYPES):
        pos = F.when(F.col("event_type") == et, F.lit(10 * i)) if pos is None \
            else pos.when(F.col("event_type") == et, F.lit(10 * i))
    return (pos + F.pmod(F.col("event_id"), F.lit(3))).cast("bigint")


def event_facts(events: DataFrame, types: list[str]) -> DataFrame:
    """Measurement facts from an events frame (batch or streaming)."""
    return (events.filter(F.col("event_type").isin(types))
            .select(F.col("user_id").alias("subject_id"),
                    F.col("event_id"),
                    _item_id().alias("itemid"),
                    F.col("ts").alias("charttime"),
                    F.col("value").alias("valuenum")))


def lab_events(t: Tables) -> DataFrame:
    """lab events: click/view/purchase events; item id by type and event id."""
    return event_facts(t.events, FIXTURE_LAB_TYPES)


def chart_events(t: Tables) -> DataFrame:
    """chart events: error/signup events."""
    return event_facts(t.events, FIXTURE_CHART_TYPES)


def item_dictionary(spark: SparkSession) -> DataFrame:
    """(itemid, label) lookup for the fixture items: 3 ids per event type."""
    rows = [(10 * i + r, et) for i, et in enumerate(FIXTURE_EVENT_TYPES) for r in range(3)]
    return spark.createDataFrame(rows, "itemid bigint, label string")
