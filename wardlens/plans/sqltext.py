"""Oracle SQL building blocks (DuckDB dialect) for the fixture roles.

The oracle is an independent restatement of each query in plain SQL over the
driver's views; it shares no code path with the Spark operators.  Exact
integer forms are used wherever the two engines round differently
"""

from __future__ import annotations

from wardlens.functions.codesets import FIXTURE, FIXTURE_CHART_TYPES, FIXTURE_EVENT_TYPES, FIXTURE_LAB_TYPES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def round_ratio(expr: str, den: int) -> str:
    """Nearest integer to expr/den, ties away from zero, in integer arithmetic."""
    return f"(sign({expr}) * ((2 * abs({expr}) + {den}) // {2 * den}))"


def minutes(later: str, earlier: str) -> str:
    return f"date_sub('minute', {earlier}, {later})"


def days(later: str, earlier: str) -> str:
    return round_ratio(minutes(later, earlier), 1440)


def age(start: str, birth: str, year_days_milli: int = FIXTURE["year_days_milli"]) -> str:
    d = f"(CAST({start} AS DATE) - CAST({birth} AS DATE))"
    return f"(CAST({round_ratio(d + ' * 100000', year_days_milli)} AS DOUBLE) / 100.0)"


def bucket(col: str, mapping, default: str) -> str:
    parts = " ".join(f"WHEN {col} IN {in_list(v)} THEN {q(k)}" for k, v in mapping.items())
    return f"(CASE {parts} ELSE {q(default)} END)"


def item_id(type_col: str = "event_type", id_col: str = "event_id") -> str:
    parts = " ".join(f"WHEN {type_col} = {q(t)} THEN {10 * i}" for i, t in enumerate(FIXTURE_EVENT_TYPES))
    return f"(CAST((CASE {parts} END) + ({id_col} % 3) AS BIGINT))"


ROLE_CTES = {
    "stays": f"""stays AS (
  SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id, o.o_orderkey AS icustay_id,
         o.o_orderpriority AS first_careunit, o.o_orderdate AS intime,
         o.o_orderdate + to_days(CAST(coalesce(c.n_items, 0) AS INTEGER)) AS outtime,
         CAST(coalesce(c.n_items, 0) AS DOUBLE) AS los
  FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY l_orderkey) c
    ON o.o_orderkey = c.l_orderkey)""",
    "subjects": """subjects AS (
  SELECT c_custkey AS subject_id, c_mktsegment AS gender,
         DATE '1995-01-01' - CAST(floor(c_acctbal * 2) AS INTEGER) AS dob
  FROM customer)""",
    "visits": """visits AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
         o_orderstatus AS discharge_location,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 'L' || substr(o_orderpriority, 1, 1) END AS language,
         o_orderstatus AS insurance, o_orderpriority AS ethnicity, o_orderdate AS dischtime
  FROM orders)""",
    "deaths": """deaths AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deathtime,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS hospital_expire_flag
  FROM orders)""",
    "code_dictionary": """code_dictionary AS (
  SELECT CAST(p_partkey AS VARCHAR) AS icd9_code, p_name AS long_title FROM part)""",
    "code_facts": """code_facts AS (
  SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, CAST(l.l_partkey AS VARCHAR) AS icd9_code
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "lab_events": f"""lab_events AS (
  SELECT user_id AS subject_id, event_id, {item_id()} AS itemid, ts AS charttime, value AS valuenum
  FROM events WHERE event_type IN {in_list(FIXTURE_LAB_TYPES)})""",
    "chart_events": f"""chart_events AS (
  SELECT user_id AS subject_id, event_id, {item_id()} AS itemid, ts AS charttime, value AS valuenum
  FROM events WHERE event_type IN {in_list(FIXTURE_CHART_TYPES)})""",
    "item_dictionary": "item_dictionary AS (SELECT CAST(itemid AS BIGINT) AS itemid, label FROM (VALUES "
    + ", ".join(f"({10 * i + r}, {q(t)})" for i, t in enumerate(FIXTURE_EVENT_TYPES) for r in range(3))
    + ") v(itemid, label))",
}


def index_stays_cte(keep_ties: bool = False, all_deaths: bool = False) -> str:
    """CTE ``idx_full``: the D7 index-stay table for the fixture parameters."""
    p = FIXTURE
    excl = " AND ".join(f"first_careunit <> {q(u)}" for u in p["excluded_units"])
    if keep_ties:
        first = """fe AS (SELECT subject_id, min(outtime) AS first_disch FROM s GROUP BY subject_id),
first_rows AS (SELECT s.*, fe.first_disch FROM s JOIN fe ON s.subject_id = fe.subject_id AND s.outtime = fe.first_disch)"""
    else:
        first = """first_rows AS (SELECT * EXCLUDE (events), outtime AS first_disch FROM seq WHERE events = 1 AND outtime IS NOT NULL)"""
    if all_deaths:
        dth = """dth AS (SELECT subject_id, deathtime, hospital_expire_flag FROM deaths
  WHERE deathtime IS NOT NULL AND hospital_expire_flag <> 1)"""
    else:
        dth = """dth AS (SELECT subject_id, deathtime, hospital_expire_flag FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY deathtime DESC, hospital_expire_flag DESC) AS rn
  FROM deaths WHERE deathtime IS NOT NULL AND hospital_expire_flag <> 1) WHERE rn = 1)"""
    return f"""s AS (SELECT * FROM stays WHERE {excl}),
seq AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY outtime ASC NULLS LAST, hadm_id ASC NULLS LAST, icustay_id ASC NULLS LAST) AS events FROM s),
second_stay AS (SELECT subject_id, intime AS next_intime FROM seq WHERE events = 2),
{first},
idx AS (SELECT f.*, {days('n.next_intime', 'f.first_disch')} AS days_elapsed
        FROM first_rows f LEFT JOIN second_stay n ON f.subject_id = n.subject_id),
{dth},
vis AS (SELECT subject_id, hadm_id, {bucket('discharge_location', p['discharge_buckets'], p['discharge_default'])} AS discharge_location,
               language, insurance, ethnicity, dischtime FROM visits),
idx_all AS (
  SELECT i.subject_id, i.hadm_id, i.icustay_id, i.first_careunit, i.intime, i.outtime, i.los,
         b.gender, b.dob, v.discharge_location, v.language, v.insurance, v.ethnicity,
         v.dischtime, d.deathtime, d.hospital_expire_flag,
         {age('i.intime', 'b.dob')} AS age,
         CAST(coalesce(i.days_elapsed, 0) AS BIGINT) AS days_since_discharge,
         CASE WHEN i.days_elapsed > 0 AND i.days_elapsed < {p['return_window_days']} THEN 1 ELSE 0 END AS readmission_30_days
  FROM idx i JOIN subjects b ON i.subject_id = b.subject_id
  LEFT JOIN vis v ON i.subject_id = v.subject_id AND i.hadm_id = v.hadm_id
  LEFT JOIN dth d ON i.subject_id = d.subject_id),
idx_full AS (SELECT * FROM idx_all WHERE age > {p['min_age_years']})"""


def with_roles(*roles: str, extra: str = "", body: str) -> str:
    ctes = [ROLE_CTES[r] for r in roles]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body
