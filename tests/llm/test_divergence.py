"""The audit against plain Python term by term, and joint tables against counting."""
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def counted(rows, least):
    """{lang: ({source: Counter of kept terms}, kept terms)}"""
    langs = defaultdict(lambda: (defaultdict(Counter), Counter()))
    for _, text, lang, source in rows:
        by, docs = langs[lang or ""]
        words = terms_of(text)
        by[source or ""].update(words)
        docs.update(set(words))
    return {lang: ({s: Counter({t: n for t, n in c.items() if docs[t] >= least}) for s, c in by.items()},
                   [t for t, n in docs.items() if n >= least]) for lang, (by, docs) in langs.items()}


def expected(rows, least, top):
    out = []
    for lang, (by, kept) in counted(rows, least).items():
        def p(count, total):
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}
        own = {s: p(c, sum(c.values())) for s, c in by.items()}
        whole = sum(by.values(), Counter())
        q = p(whole, sum(whole.values()))
        for s, c in by.items():
            pair = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in by if o != s]
            term = [(own[s][t] - q[t], t) for t in kept if c[t] > 0 and own[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed, n=160, third=True):
    r = random.Random(seed)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "abcde"] + ["É", "é", "straße", "Z", "z", "ΑΒ", "日本", "\xa0"]
    words = [re.sub(r"\d", "", w) for w in words] + [a + b for a in "klmno" for b in "pqrst"]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(0, 60))) + r.choice(["", "-x9y", "!"]),
             r.choice(["en", "de", None, ""]), "hot" if third and i % 3 == 0 else r.choice(["s1", "s2", "s3", None])) for i in range(n)]
    return rows + [(1, None, "en", "quiet"), (None, None, None, None), (2, "only once", "solo", "s1"), (3, "", "mute", "a"), (3, "", "mute", "b"),
                   rows[0], rows[0], (4, "A" * 50_000 + " wa" * 30_000, "en", "s1")]


@pytest.mark.parametrize("least,top,seed", [(10, 3, 1), (1, 50, 2), (30, 50, 3)])
def test_equals_counting(spark, least, top, seed, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    rows = corpus(seed)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top).collect()
    assert sorted(map(tuple, got)) == expected(rows, least, top)


def test_joint_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 11)
    rows = corpus(5)
    want = Counter()
    for lang, (by, kept) in counted(rows, 10).items():
        for a, b in combinations(sorted(by), 2):
            want.update((lang, a, by[a][t], b, by[b][t]) for t in kept)
    got = divergence.joint_tables(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert {tuple(r)[:5]: r["n_terms"] for r in got} == want and len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 12), st.integers(0, 10**6))
def test_products_are_whole_at_every_width(terms, groups, columns, seed):
    counts = np.random.default_rng(seed).integers(0, 9, (terms, groups))
    want, got = Counter(), Counter()
    for row in counts:
        want.update((g, int(row[g]), h, int(row[h])) for g in range(groups) for h in range(groups))
    for group, level, joint in divergence.products(counts, columns):
        for i, j in zip(*np.nonzero(joint)):
            got[int(group[i]), int(level[i]), int(group[j]), int(level[j])] += int(joint[i, j])
    assert got == want


def test_counts_beyond_64_bit_products(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "c long, n long, v long")
    assert df.select(divergence.price("c", "n", "v")).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 35)


def test_empty_table_and_other_columns(spark, documents):
    assert divergence.audit(documents([])).collect() == []
    rows = [(i, "a b b") for i in range(4)]
    got = divergence.audit(documents(rows).withColumnRenamed("fingerprint", "found").withColumnRenamed("ids", "n"), 2).collect()
    assert sorted(map(tuple, got)) == []  # one source: no pairs, and no term above its lang
