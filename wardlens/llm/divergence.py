"""Source divergence audit by one-hot level products.

Terms (runs of letters and non-ASCII characters, A-Z lower-cased) are counted per
(lang, source); a lang keeps the terms that at least ``min_docs`` of its documents
hold.  With N the count of all kept terms in a group and V their number, a term of
count c has p = 1 + floor(SCALE * (c + SMOOTH) / (N + SMOOTH * V)): within a group p depends on
the count alone, its *level*.  So two sources are compared by their joint table, the
number of terms with level l in one and m in the other:

* a term is a row with a one in column (group, its level there), level 0 included;
* the transposed matrix times the matrix holds every joint table of the lang;
* a block of terms is cut until its levels make at most ``COLUMNS`` columns, terms
  ordered by frequency so that rare ones share their few levels; products of zeros
  and ones are sums of fewer than 2 ** 24 ones, exact in single precision, and are
  added as integers;
* a joint table is priced with |p - p'| per cell and summed to one number per pair.

Blocks are dealt by a hash of the term, so one lang or source with most rows is spread;
a task sees one block's counts and the lang's groups and returns one sum per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize, pieces
from wardlens.llm.words import Words

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
COLUMNS = 512
BLOCK_TERMS = 1024
PIECE_BYTES = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


# ---- terms -------------------------------------------------------------------------------------


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed over a piece of text."""
    for batch in batches:
        for piece, data, off in pieces(batch, "text", PIECE_BYTES):
            w = Words(data, off, _LETTER)
            if not len(w):
                continue
            group = pa.StructArray.from_arrays([piece.column("lang"), piece.column("source")], ["lang", "source"]).to_pylist()
            number = {g: i for i, g in enumerate(dict.fromkeys((g["lang"], g["source"]) for g in group))}
            of_doc = np.array([number[g["lang"], g["source"]] for g in group], dtype=np.int64)
            one, kind = w.distinct()
            in_doc, n = np.unique(w.doc * len(one) + kind, return_counts=True)
            cell, at = np.unique(of_doc[in_doc // len(one)] * len(one) + in_doc % len(one), return_inverse=True)
            terms = pa.array([w.word(i) for i in one], pa.binary()).cast(pa.string())
            names = list(number)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[k] for x in names], pa.string()).take(pa.array(cell // len(one))) for k in (0, 1)),
                 terms.take(pa.array(cell % len(one))), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at))],
                ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of the group that hold the term; nulls are ''."""
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                        for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return src.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, **cols: str) -> tuple[DataFrame, DataFrame]:
    """(terms, groups), both written.

    terms: lang, term, total, found (array of source, n); groups: lang, source, n, v, lang_n for every occurring
    (lang, source), with n and lang_n the counts of all kept terms there and v the lang's number of kept terms."""
    terms = materialize(
        term_counts(docs, **cols).groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found"))
        .filter(F.col("docs") >= min_docs).drop("docs"), "terms")
    every = docs.select(*(F.coalesce(F.col(cols.get(f"{c}_col", c)).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = terms.select("lang", F.explode("found").alias("f")).groupBy("lang", F.col("f.source").alias("source")).agg(F.sum("f.n").alias("n"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    return terms, materialize(groups, "groups")


def price(count: str, n: str, v: str) -> Column:
    """p of a term with ``count`` occurrences among ``n``; exact beyond 64-bit products."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0)) div cast({n} + {SMOOTH} * {v} as decimal(20,0))")


# ---- products ----------------------------------------------------------------------------------


def products(counts: np.ndarray, columns: int = COLUMNS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group of each column, its level, joint tables) of parts of a terms x groups matrix of counts.

    Cell (i, j) is the number of the part's terms with column i's level in its group and column j's in its."""
    parts = [counts[np.argsort(-counts.sum(axis=1), kind="stable")]] if len(counts) else []
    while parts:
        part = parts.pop()
        terms, groups = part.shape
        level, column = np.unique(part.T, return_inverse=True)
        key = np.repeat(np.arange(groups), terms) * len(level) + column.ravel()
        cells, at = np.unique(key, return_inverse=True)
        if len(cells) > columns and terms > 1:
            parts += [part[terms // 2:], part[:terms // 2]]
            continue
        one_hot = np.zeros((terms, len(cells)), np.float32)
        one_hot[np.tile(np.arange(terms), groups), at] = 1
        yield cells // len(level), level[cells % len(level)], (one_hot.T @ one_hot).astype(np.int64)


def _block(terms: pa.Table, groups: pa.Table) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """(sources in order, (n, v) of each, terms x sources counts) of one block."""
    rows = sorted(zip(*(groups.column(c).to_pylist() for c in ("source", "n", "v"))))
    sources = [r[0] for r in rows]
    at = {s: i for i, s in enumerate(sources)}
    found = terms.column("found").combine_chunks()
    counts = np.zeros((terms.num_rows, len(sources)), np.int64)
    if terms.num_rows:
        cell = found.flatten()
        where = [at[s] for s in cell.field("source").to_pylist()]
        counts[np.repeat(np.arange(terms.num_rows), found.value_lengths().to_numpy()), where] = cell.field("n").to_numpy()
    return sources, [r[1:] for r in rows], counts


def _price_block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """One block's sums of |p - p'| for every pair of sources in order."""
    sources, size, counts = _block(terms, groups)
    sums = np.zeros((len(sources), len(sources)), np.int64)
    for group, level, joint in products(counts):
        p = np.array([1 + SCALE * (c + SMOOTH) // (size[g][0] + SMOOTH * size[g][1]) for g, c in zip(group.tolist(), level.tolist())], dtype=np.int64)
        first = np.flatnonzero(np.append(True, np.diff(group)))
        sums += np.add.reduceat(np.add.reduceat(joint * np.abs(p[:, None] - p), first, axis=0), first, axis=1)
    i, j = np.triu_indices(len(sources), 1)
    names = pa.array(sources, pa.string())
    lang = groups.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": pa.array(sums[i, j])})


def _joint_block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """One block's joint tables, empty cells left out."""
    sources, _, counts = _block(terms, groups)
    out: list[list] = [[], [], [], [], []]
    for group, level, joint in products(counts):
        i, j = np.nonzero(np.where(group[:, None] < group, joint, 0))
        for col, x in zip(out, (group[i], level[i], group[j], level[j], joint[i, j])):
            col.append(x)
    a, la, b, lb, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
    names = pa.array(sources, pa.string())
    lang = groups.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "count": pa.array(la),
                     "item": names.take(pa.array(b)), "item_count": pa.array(lb), "n_terms": pa.array(n)})


def _by_block(terms: DataFrame, groups: DataFrame, task, schema: str) -> DataFrame:
    """``task`` over blocks of terms, each with all groups of its lang; a lang without terms has one empty block.

    A block has some ``BLOCK_TERMS`` terms, or four times as many as its lang has sources, so the pairs that it
    returns are fewer than the counts that it reads."""
    size = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("sources"))
    blocks = size.select("lang", F.expr(f"cast(1 + v div greatest({BLOCK_TERMS}, 4 * sources) as int)").alias("blocks"))
    left = terms.join(blocks, "lang").select("lang", F.expr("pmod(xxhash64(term), blocks)").cast("int").alias("block"), "found")
    right = groups.join(blocks, "lang").select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "source", "n", "v")
    return left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(task, schema)


def joint_tables(docs: DataFrame, min_docs: int = MIN_DOCS, **cols: str) -> DataFrame:
    """lang, source, count, item, item_count, n_terms: for every two sources of a lang (source < item) the number of
    kept terms with these counts in the two; cells without terms are left out."""
    terms, groups = kept_terms(docs, min_docs, **cols)
    cells = _by_block(terms, groups, _joint_block, "lang string, source string, count bigint, item string, item_count bigint, n_terms bigint")
    return cells.groupBy("lang", "source", "count", "item", "item_count").agg(F.sum("n_terms").alias("n_terms"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **cols: str) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: item is each other source of the lang, value the sum over all kept terms of |p - q|, p the
    source's, q the item's; all ranks.  Part ``term``: item is a kept term that occurs in the group with
    p > q, q the whole lang's, value p - q, the first ``top`` ranks.  Ranks from 1 by value descending, then
    item by bytes.

    Null text, lang and source are ''.  Every row is a document, repeated ids and rows included; ids are not
    read.  A group without terms, and a lang without kept terms (all values 0), has its pairs too; a lang
    with one source has none; an empty table gives an empty result.  Only the three columns named by ``text_col``,
    ``lang_col`` and ``source_col`` are read, so other columns may have any names."""
    terms, groups = kept_terms(docs, min_docs, **cols)
    sums = _by_block(terms, groups, _price_block, "lang string, source string, item string, value bigint") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    found = terms.select("lang", "term", "total", F.explode("found").alias("f")).select("lang", "term", "total", "f.source", F.col("f.n").alias("count"))
    above = found.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (price("count", "n", "v") - price("total", "lang_n", "v")).alias("value")).filter(F.col("value") > 0)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(
        above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))


def sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """DuckDB SQL of ``audit`` over `documents`, term by term."""
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
             r" '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')")
    def p(count: str, n: str) -> str:
        return f"CAST(1 + (CAST({SCALE} AS HUGEINT) * ({count} + {SMOOTH})) // (CAST({n} AS HUGEINT) + {SMOOTH} * v) AS BIGINT)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {min_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(own, 0) AS own FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY lang, source) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p('coalesce(n, 0)', 'own')} AS p, {p('total', 'lang_n')} AS q
      FROM g JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {top}
"""
