"""Queries of build steps 6-7: split, resampling, weights and AUC.

Fixture roles: the split runs on the index stays (id = subject, label =
return label, cohort = care unit); evaluation runs on ``labels`` joined to
``documents`` (y = quality, cohort = lang, score = a fixed function of the
document length, with many ties).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions.codesets import CLINICAL
from wardlens.operators import evaluate as EV
from wardlens.operators import sampling as SA
from wardlens.plans import sqltext as S
from wardlens.plans.catalog import register
from wardlens.plans.q_cohort import fixture_index_stays
from wardlens.sources.tables import Tables

SEED = 0
REPS = CLINICAL["bootstrap_replicates"]
LANGS = ["de", "en", "es", "fr"]
UNITS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


# ---- Spark side ----------------------------------------------------------

def fixture_scored(t: Tables):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    lab = t.labels.select("doc_id", F.col("quality").alias("y"))
    return lab.hint("merge").join(docs, "doc_id").select(
        "doc_id", "y", "lang", (F.pmod(F.col("n_chars"), F.lit(100)) / F.lit(100.0)).alias("score"))


def fixture_head_predictions(t: Tables):
    """Long (doc_id, task, score): one prediction per language head."""
    docs = t.documents.select("doc_id", "n_chars")
    heads = F.explode(F.array(*[F.struct(F.lit(lg).alias("task"), F.lit(i + 1).alias("mult"))
                                for i, lg in enumerate(LANGS)])).alias("h")
    x = docs.select("doc_id", "n_chars", heads)
    return x.select("doc_id", F.col("h.task").alias("task"),
                    (F.pmod(F.col("n_chars") * F.col("h.mult"), F.lit(101)) / F.lit(101.0)).alias("score"))


def fixture_split(t: Tables):
    s = fixture_index_stays(t).select("subject_id", "readmission_30_days", "first_careunit")
    return SA.stratified_split(s, "readmission_30_days", "subject_id", SEED)


def fixture_draws(t: Tables):
    return SA.bootstrap_draws(fixture_scored(t), "y", "doc_id", REPS, SEED)


# ---- oracle side ---------------------------------------------------------

def _h(*parts: str) -> str:
    s = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({s}), 1, 8))::UBIGINT AS BIGINT)"


def _ceil_frac(n: str, a: int, b: int) -> str:
    return f"(({n}) * {a} + {b - 1}) // {b}"


EVAL_CTES = f"""scored AS (
  SELECT l.doc_id, l.quality AS y, d.lang, CAST(d.n_chars % 100 AS DOUBLE) / 100.0 AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
heads AS ({" UNION ALL ".join(
    f"SELECT doc_id, '{lg}' AS task, CAST((n_chars * {i + 1}) % 101 AS DOUBLE) / 101.0 AS score FROM documents"
    for i, lg in enumerate(LANGS))}),
srk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, doc_id) - 1 AS rank,
               count(*) OVER (PARTITION BY y) AS n_class
        FROM (SELECT doc_id, y, {_h("'" + str(SEED) + "'", 'doc_id')} AS h FROM scored)),
draws AS (
  SELECT 0 AS replicate, y, rank AS k, doc_id FROM srk
  UNION ALL
  SELECT p.replicate, p.y, p.k, r.doc_id FROM (
    SELECT y, rank AS k, n_class, CAST(unnest(range(1, {REPS})) AS INTEGER) AS replicate FROM srk) p
  JOIN srk r ON p.y = r.y AND r.rank = {_h("'" + str(SEED) + "'", 'p.replicate', 'p.y', 'p.k')} % p.n_class)"""


def _auc_sql(src: str, scopes: list[str]) -> str:
    """Brute-force rank-sum AUC per scope (ties share the average rank)."""
    part = ", ".join(scopes) if scopes else "1"
    sel = ", ".join(scopes) + ", " if scopes else ""
    grp = "GROUP BY " + ", ".join(scopes) if scopes else ""
    return f"""SELECT {sel}CASE WHEN p > 0 AND n > 0 THEN (sr - CAST(p AS DOUBLE) * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) END AS auc,
       CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM (
  SELECT {sel}sum(CASE WHEN y = 1 THEN ar ELSE 0 END) AS sr,
         sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n
  FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY score)
                  + CAST(count(*) OVER (PARTITION BY {part}, score) - 1 AS DOUBLE) / 2.0 AS ar FROM {src}) z
  {grp}) q"""


def eval_sql(body: str, extra: str = "") -> str:
    return S.with_roles("stays", "subjects", "visits", "deaths",
                        extra=S.index_stays_cte() + ",\n" + EVAL_CTES + extra, body=body)


_SPLIT_CTE = f""",
xrk AS (SELECT *, row_number() OVER (PARTITION BY readmission_30_days ORDER BY h, subject_id) - 1 AS rank,
               count(*) OVER (PARTITION BY readmission_30_days) AS n_class
        FROM (SELECT subject_id, readmission_30_days, first_careunit, {_h("'" + str(SEED) + "'", 'subject_id')} AS h
              FROM idx_full)),
xsplit AS (SELECT subject_id, readmission_30_days, first_careunit, rank, n_class,
  CASE WHEN rank < {_ceil_frac('n_class', 1, 5)} THEN 'test'
       WHEN rank < {_ceil_frac('n_class', 1, 5)} + {_ceil_frac('n_class - ' + _ceil_frac('n_class', 1, 5), 1, 8)} THEN 'val'
       ELSE 'train' END AS split FROM xrk),
wtrain AS (SELECT x.*, c.n_cohort, CAST(c.n_train AS DOUBLE) / c.n_cohort AS weight FROM xsplit x JOIN (
  SELECT first_careunit, count(*) AS n_cohort, sum(count(*)) OVER () AS n_train FROM xsplit WHERE split = 'train'
  GROUP BY first_careunit) c ON x.first_careunit = c.first_careunit WHERE x.split = 'train')"""


# ---- registered queries ----------------------------------------------------

@register("stratified_split", eval_sql("SELECT * FROM xsplit", _SPLIT_CTE))
def stratified_split(spark, d):
    return fixture_split(Tables(spark, d))


@register("bootstrap_draws", eval_sql("SELECT * FROM draws"))
def bootstrap_draws(spark, d):
    return fixture_draws(Tables(spark, d))


@register("bootstrap_sample", eval_sql(
    "SELECT s.* FROM scored s JOIN draws d ON s.doc_id = d.doc_id WHERE d.replicate = 7"))
def bootstrap_sample(spark, d):
    t = Tables(spark, d)
    return SA.bootstrap_sample(fixture_scored(t), fixture_draws(t), "doc_id", 7)


@register("cohort_weights", eval_sql("SELECT * FROM wtrain", _SPLIT_CTE))
def cohort_weights(spark, d):
    train = fixture_split(Tables(spark, d)).filter(F.col("split") == "train")
    return SA.cohort_weights(train, "first_careunit")


@register("task_weights", eval_sql(
    "SELECT w.*, t.task, CASE WHEN w.first_careunit = t.task THEN w.weight ELSE 0.0 END AS task_weight "
    "FROM wtrain w, (VALUES " + ", ".join(f"({S.q(u)})" for u in UNITS) + ") t(task)", _SPLIT_CTE))
def task_weights(spark, d):
    train = fixture_split(Tables(spark, d)).filter(F.col("split") == "train")
    return SA.task_weights(SA.cohort_weights(train, "first_careunit"), "first_careunit", UNITS, "weight")


@register("auc", eval_sql(_auc_sql("scored", [])))
def auc(spark, d):
    return EV.auc(fixture_scored(Tables(spark, d)))


@register("auc_by_cohort", eval_sql(_auc_sql("scored", ["lang"])))
def auc_by_cohort(spark, d):
    return EV.auc_by_cohort(fixture_scored(Tables(spark, d)), "lang")


_BOOT_CTE = """,
brows AS (SELECT d.replicate, s.* FROM draws d JOIN scored s ON d.doc_id = s.doc_id)"""


@register("auc_bootstrap", eval_sql(f"""
SELECT lang, min(auc) AS auc_min, max(auc) AS auc_max, round(avg(auc), 10) AS auc_mean, count(*) AS replicates
FROM ({_auc_sql('brows', ['replicate', 'lang'])}) WHERE auc IS NOT NULL GROUP BY lang""", _BOOT_CTE))
def auc_bootstrap(spark, d):
    t = Tables(spark, d)
    mult = SA.bootstrap_multiplicity(fixture_scored(t), "y", "doc_id", REPS, SEED)
    out = EV.auc_bootstrap(fixture_scored(t), mult, "doc_id", "lang")
    return out.withColumn("auc_mean", F.round("auc_mean", 10))


_SCOPES_CTE = _BOOT_CTE + f""",
per AS (SELECT replicate, CAST(lang AS VARCHAR) AS scope, auc FROM ({_auc_sql('brows', ['replicate', 'lang'])})),
every AS (SELECT * FROM per
  UNION ALL SELECT replicate, 'macro', avg(auc) FROM per GROUP BY replicate
  UNION ALL SELECT replicate, 'micro', auc FROM ({_auc_sql('brows', ['replicate'])}))"""


@register("auc_bootstrap_macro_micro", eval_sql("""
SELECT scope, round(min(auc), 10) AS auc_min, round(max(auc), 10) AS auc_max, round(avg(auc), 10) AS auc_mean, count(auc) AS replicates
FROM every GROUP BY scope""", _SCOPES_CTE))
def auc_bootstrap_macro_micro(spark, d):
    drawn = SA.bootstrap_scored(fixture_scored(Tables(spark, d)), "y", "doc_id", REPS, SEED)
    out = EV.auc_bootstrap_macro_micro(drawn, "lang")
    return out.withColumns({c: F.round(c, 10) for c in ("auc_min", "auc_max", "auc_mean")})


@register("auc_bootstrap_macro_micro_all", eval_sql("SELECT replicate, scope, round(auc, 10) AS auc FROM every", _SCOPES_CTE))
def auc_bootstrap_macro_micro_all(spark, d):
    drawn = SA.bootstrap_scored(fixture_scored(Tables(spark, d)), "y", "doc_id", REPS, SEED)
    return EV.auc_bootstrap_macro_micro(drawn, "lang", summary=False).withColumn("auc", F.round("auc", 10))


@register("auc_bootstrap_all", eval_sql(
    f"SELECT replicate, lang, auc FROM ({_auc_sql('brows', ['replicate', 'lang'])})", _BOOT_CTE))
def auc_bootstrap_all(spark, d):
    t = Tables(spark, d)
    mult = SA.bootstrap_multiplicity(fixture_scored(t), "y", "doc_id", REPS, SEED)
    return EV.auc_bootstrap(fixture_scored(t), mult, "doc_id", "lang", summary=False)


_ROUTE_CTE = """,
routed AS (SELECT s.doc_id, s.y, s.lang, h.score FROM (SELECT doc_id, y, lang FROM scored) s
           JOIN heads h ON s.doc_id = h.doc_id AND s.lang = h.task)"""


@register("route_predictions", eval_sql("SELECT * FROM routed", _ROUTE_CTE))
def route_predictions(spark, d):
    t = Tables(spark, d)
    rows = fixture_scored(t).drop("score")
    return EV.route_predictions(rows, fixture_head_predictions(t), "doc_id", "lang")


@register("auc_macro_micro", eval_sql(f"""
SELECT scope, round(auc, 10) AS auc FROM per
UNION ALL SELECT 'macro', round(avg(auc), 10) FROM per
UNION ALL SELECT 'micro', round(auc, 10) FROM ({_auc_sql('routed', [])})""",
    _ROUTE_CTE + f""",
per AS (SELECT CAST(lang AS VARCHAR) AS scope, auc FROM ({_auc_sql('routed', ['lang'])}))"""))
def auc_macro_micro(spark, d):
    t = Tables(spark, d)
    rows = EV.route_predictions(fixture_scored(t).drop("score"), fixture_head_predictions(t), "doc_id", "lang")
    out = EV.auc_macro_micro(rows, "lang")
    return out.withColumn("auc", F.round("auc", 10))


@register("average_rank", eval_sql("""
SELECT *, rank() OVER (PARTITION BY lang ORDER BY score)
          + CAST(count(*) OVER (PARTITION BY lang, score) - 1 AS DOUBLE) / 2.0 AS avg_rank
FROM scored"""))
def average_rank(spark, d):
    return EV.average_rank(fixture_scored(Tables(spark, d)), "score", ["lang"])
