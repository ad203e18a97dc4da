"""Queries of build step 3: code flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions.codesets import FIXTURE
from wardlens.operators import flags
from wardlens.operators.cohort import exclude_units
from wardlens.plans import sqltext as S
from wardlens.plans.catalog import register
from wardlens.sources import roles
from wardlens.sources.tables import Tables

P = FIXTURE
FACT_SIDE = ("copd", "renal_failure")
NAMES = flags.flag_names(P["code_flags"], P["title_flag"])
_EXCL = " AND ".join(f"first_careunit <> {S.q(u)}" for u in P["excluded_units"])


def _sql_flags(a: str = "a", b: str = "b") -> str:
    out = []
    for name, codes in P["code_flags"].items():
        src = f"{b}.icd9_code" if name in FACT_SIDE else f"{a}.icd9_code"
        if name in P["lowercase_flags"]:
            src = f"lower({src})"
        out.append(f"CASE WHEN {src} IN {S.in_list(codes)} THEN 1 ELSE 0 END AS {name}")
    tname, suffix = P["title_flag"]
    out.append(f"CASE WHEN lower({a}.long_title) LIKE {S.q('%' + suffix)} THEN 1 ELSE 0 END AS {tname}")
    return ",\n       ".join(out)


def _kw():
    return dict(code_flags=P["code_flags"], title_flag=P["title_flag"],
                lowercase_flags=P["lowercase_flags"], fact_side_flags=FACT_SIDE)


@register("code_flags", S.with_roles("code_dictionary", "code_facts", body=f"""
SELECT b.subject_id, b.hadm_id, b.icd9_code, a.long_title,
       {_sql_flags()}
FROM code_dictionary a LEFT JOIN code_facts b ON a.icd9_code = b.icd9_code"""))
def code_flags(spark, d):
    t = Tables(spark, d)
    return flags.code_flags(roles.code_dictionary(t), roles.code_facts(t), **_kw())


@register("title_flag", S.with_roles("code_dictionary", body=f"""
SELECT icd9_code, long_title,
       CASE WHEN lower(long_title) LIKE {S.q('%' + P['title_flag'][1])} THEN 1 ELSE 0 END AS {P['title_flag'][0]}
FROM code_dictionary"""))
def title_flag(spark, d):
    return flags.title_flags(roles.code_dictionary(Tables(spark, d)), *P["title_flag"])


_FIRST_SQL = f"""first_st AS (SELECT subject_id, hadm_id FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY outtime ASC NULLS LAST, hadm_id ASC NULLS LAST, icustay_id ASC NULLS LAST) AS rn
  FROM stays WHERE {_EXCL}) WHERE rn = 1),
tagged AS (SELECT b.subject_id, b.hadm_id, {_sql_flags()}
  FROM code_dictionary a JOIN code_facts b ON a.icd9_code = b.icd9_code),
pv AS (SELECT subject_id, hadm_id, {", ".join(f"max({n}) AS {n}" for n in NAMES)}
  FROM tagged GROUP BY subject_id, hadm_id)"""


@register("first_visit_flags", S.with_roles("stays", "code_dictionary", "code_facts", extra=_FIRST_SQL, body=f"""
SELECT f.subject_id, f.hadm_id, {", ".join(f"CAST(coalesce(pv.{n}, 0) AS INTEGER) AS {n}" for n in NAMES)}
FROM first_st f LEFT JOIN pv ON f.subject_id = pv.subject_id AND f.hadm_id = pv.hadm_id"""))
def first_visit_flags(spark, d):
    t = Tables(spark, d)
    return flags.first_visit_flags(roles.stays(t), roles.code_dictionary(t), roles.code_facts(t),
                                   excluded_units=P["excluded_units"], **_kw())


_RUN_SQL = f"""kept AS (SELECT subject_id, hadm_id FROM stays WHERE {_EXCL}),
tagged AS (SELECT b.subject_id, b.hadm_id, {_sql_flags()}
  FROM code_dictionary a JOIN code_facts b ON a.icd9_code = b.icd9_code
  WHERE (b.subject_id, b.hadm_id) IN (SELECT subject_id, hadm_id FROM kept)),
pv AS (SELECT subject_id, hadm_id, {", ".join(f"max({n}) AS {n}" for n in NAMES)}
  FROM tagged GROUP BY subject_id, hadm_id)"""


@register("running_max", S.with_roles("stays", "code_dictionary", "code_facts", extra=_RUN_SQL, body=f"""
SELECT subject_id, hadm_id,
       {", ".join(f"max({n}) OVER (PARTITION BY subject_id ORDER BY hadm_id) AS {n}" for n in NAMES)}
FROM pv"""))
def running_max(spark, d):
    t = Tables(spark, d)
    kept = exclude_units(roles.stays(t), P["excluded_units"]).select("subject_id", "hadm_id")
    f = roles.code_facts(t).withColumnRenamed("icd9_code", "f_code") \
        .join(kept, ["subject_id", "hadm_id"], "left_semi")
    dct = roles.code_dictionary(t).select(F.col("icd9_code").alias("d_code"), "long_title")
    tagged = f.join(dct, f.f_code == dct.d_code).select(
        "subject_id", "hadm_id",
        *flags.flag_columns(P["code_flags"], P["title_flag"], lowercase_flags=P["lowercase_flags"],
                            fact_side_flags=FACT_SIDE))
    pv = tagged.groupBy("subject_id", "hadm_id").agg(*[F.max(n).alias(n) for n in NAMES])
    return flags.running_max(pv, "subject_id", "hadm_id", NAMES)
