"""Code flags per subject (P8, P9, J7, W3, A11; D8).

``first_visit_flags`` is the scalable form: facts are first narrowed to each
subject's first stay (a join on (subject, visit) against one row per
subject), then tagged through the dictionary and reduced with a partial
``max`` aggregate.  The running-max window of the original is kept as its own
operator (``running_max``) and applied to per-visit aggregates, not to raw
fact rows.  The dictionary grows with the input like the facts: joins are by
sort and merge, so that it never goes whole through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalar import in_set_flag, title_flag
from wardlens.operators.cohort import exclude_units, stay_sequence
from wardlens.sources.sinks import materialize


def flag_columns(code_flags: Mapping[str, Iterable[str]], title: tuple[str, str] | None,
                 dict_code: str = "d_code", fact_code: str = "f_code", title_col: str = "long_title",
                 lowercase_flags: Iterable[str] = (), fact_side_flags: Iterable[str] = ()) -> list:
    """One 0/1 column per flag.  Flags in ``fact_side_flags`` test the fact's
    code (0 for dictionary rows without facts), the others the dictionary's."""
    lower, fact_side = set(lowercase_flags), set(fact_side_flags)
    cols = []
    names = list(code_flags)
    if title:
        names.append(title[0])
    for name in names:
        if title and name == title[0]:
            cols.append(title_flag(title_col, title[1]).alias(name))
        else:
            src = fact_code if name in fact_side else dict_code
            cols.append(in_set_flag(src, code_flags[name], lower=name in lower).alias(name))
    return cols


def flag_names(code_flags: Mapping[str, Iterable[str]], title: tuple[str, str] | None) -> list[str]:
    return list(code_flags) + ([title[0]] if title else [])


def code_flags(dictionary: DataFrame, facts: DataFrame, *, code_flags: Mapping[str, Iterable[str]],
               title_flag: tuple[str, str] | None, lowercase_flags: Iterable[str] = (),
               fact_side_flags: Iterable[str] = ("copd", "renal_failure"),
               code: str = "icd9_code") -> DataFrame:
    """J7 + P8 + P9: dictionary LEFT JOIN facts on the code, flags per row.

    Dictionary codes without facts are kept with NULL subject/visit.  Written
    as facts INNER JOIN dictionary (AQE can split a hot code on either side)
    UNION ALL the dictionary rows whose code no fact uses (anti join against
    the distinct fact codes), which is the same multiset of rows.  The facts'
    three columns are written once, so the facts, often a join of their own,
    are made once; the distinct codes read one column of the copy.
    """
    d = dictionary.select(F.col(code).alias("d_code"), "long_title")
    f = materialize(facts.select("subject_id", "hadm_id", F.col(code).alias("f_code")), "code-facts")
    flags = flag_columns(code_flags, title_flag, lowercase_flags=lowercase_flags,
                         fact_side_flags=fact_side_flags)
    matched = f.join(d.hint("merge"), f.f_code == d.d_code, "inner")
    used = f.select(F.col("f_code").alias("d_code")).distinct()
    unused = d.join(used.hint("merge"), "d_code", "left_anti").select(
        F.lit(None).cast("long").alias("subject_id"), F.lit(None).cast("long").alias("hadm_id"),
        F.lit(None).cast("string").alias("f_code"), "d_code", "long_title")
    rows = matched.select("subject_id", "hadm_id", "f_code", "d_code", "long_title").unionByName(unused)
    return rows.select("subject_id", "hadm_id", F.col("f_code").alias(code), "long_title", *flags)


def title_flags(dictionary: DataFrame, name: str, suffix: str, code: str = "icd9_code") -> DataFrame:
    """P9 on the dictionary alone: 1 when the lower-cased title ends with the suffix."""
    return dictionary.select(code, "long_title", title_flag("long_title", suffix).alias(name))


def first_stays(stays: DataFrame, excluded_units: Iterable[str]) -> DataFrame:
    """Each subject's first stay (by end time, visit id) among the kept units."""
    s = exclude_units(stays, excluded_units)
    return stay_sequence(s, 1).filter(F.col("events") == 1).select("subject_id", "hadm_id")


def first_visit_flags(stays: DataFrame, dictionary: DataFrame, facts: DataFrame, *,
                      excluded_units: Iterable[str], code_flags: Mapping[str, Iterable[str]],
                      title_flag: tuple[str, str] | None, lowercase_flags: Iterable[str] = (),
                      fact_side_flags: Iterable[str] = ("copd", "renal_failure"),
                      code: str = "icd9_code") -> DataFrame:
    """A11 (D8): one row per subject: its first stay and the max of each flag
    over that stay's coded facts; subjects without codes get 0 (not NULL)."""
    first = first_stays(stays, excluded_units)
    f = facts.select("subject_id", "hadm_id", F.col(code).alias("f_code"))
    f = f.join(first.hint("merge"), ["subject_id", "hadm_id"], "left_semi")
    d = dictionary.select(F.col(code).alias("d_code"), "long_title")
    tagged = f.join(d.hint("merge"), f.f_code == d.d_code, "inner")
    cols = flag_columns(code_flags, title_flag, lowercase_flags=lowercase_flags,
                        fact_side_flags=fact_side_flags)
    names = flag_names(code_flags, title_flag)
    per_visit = tagged.select("subject_id", "hadm_id", *cols) \
        .groupBy("subject_id", "hadm_id").agg(*[F.max(n).alias(n) for n in names])
    out = first.join(per_visit.hint("merge"), ["subject_id", "hadm_id"], "left")
    return out.select("subject_id", "hadm_id",
                      *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in names])


def running_max(df: DataFrame, partition: str, order: str, cols: Iterable[str],
                binary: bool = True) -> DataFrame:
    """``max(c) OVER (PARTITION BY p ORDER BY o)`` with the default frame
    (RANGE UNBOUNDED PRECEDING .. CURRENT ROW, peers included).

    For 0/1 flags (``binary``) the running max at a row is 1 exactly when its
    order key is at or after the first key carrying a 1, so it is computed
    from a partial aggregate (first flagged key per partition) joined back —
    no window has to hold a whole partition.  Rows with a NULL order key sort
    last and see every row of the partition; a NULL partition key is a partition;
    before the first non-NULL flag the running max is NULL.  ``binary=False`` uses
    the window.
    """
    cols = list(cols)
    if not binary:
        w = Window.partitionBy(partition).orderBy(F.col(order).asc_nulls_last())
        return df.select(*[c for c in df.columns if c not in set(cols)],
                         *[F.max(c).over(w).alias(c) for c in cols])
    firsts = df.groupBy(F.col(partition).alias("_part")).agg(
        *[F.min(F.when(F.col(c) == 1, F.col(order))).alias(f"_first_{c}") for c in cols],
        *[F.min(F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_seen_{c}") for c in cols],
        *[F.max(c).alias(f"_any_{c}") for c in cols])
    j = df.join(firsts, F.col(partition).eqNullSafe(F.col("_part")), "left")
    o = F.col(order)
    out = [F.when(o.isNull(), F.col(f"_any_{c}"))
           .when(o >= F.col(f"_first_{c}"), F.lit(1))
           .when(o >= F.col(f"_seen_{c}"), F.lit(0)).cast("int").alias(c) for c in cols]
    return j.select(*[c for c in df.columns if c not in set(cols)], *out)
