import hashlib
import random
import re

import pytest

from wardlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wanted = []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        wanted += [("null" if i is None else str(i), w[j:j + n]) for j in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for i, gram in wanted:
            for j in range(len(w) - len(gram) + 1):
                if w[j:j + len(gram)] == gram:
                    hit |= set(range(j, j + len(gram)))
                    own.add(i)
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(own), digest, bool(hit)))
    return sorted(out, key=repr)


def cases(seed=1):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "naïve", "résumé", "x1", "averyverylongwordindeed", "averyverylongwordindeee", "Σ", "b"]
    items = [(i if i % 5 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 10, 14, 40])))) for i in range(14)]
    items += [(3, None), (2, "!!"), (2, "same id again, with ten words in it and no more")]
    docs = []
    for i in range(60):
        own = " ".join(rng.choice(vocabulary[1:]) for _ in range(rng.randrange(60)))
        a = words(rng.choice(items)[1])
        k = rng.randrange(len(a) + 1)
        docs.append((i // 2 if i % 7 else None, own + " ! " + "-".join(a[k:k + rng.randrange(30)]).upper() + "?" + own[::-1]))
    return docs + [(90, None), (91, ""), (92, "of " * 20000), (93, "\x00\x7f")], items


@pytest.mark.parametrize("block", [1 << 20, 120])
def test_equals_brute_force(spark, documents, block):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(documents(docs), bench, 10, block).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(docs, items)


def test_longest_match_and_its_place(spark, documents):
    bench = spark.createDataFrame([(5, "a b c d e f g h i j k l m n")], "item_id long, text string")
    d = documents([(1, "zz B c d e f g h i j k l m yy a b c d e f g h i j")])
    found = decontaminate.find_matches(d, bench).first()["_found"]
    assert sorted((m["item"], m["item_word"], m["doc_word"], m["words"]) for m in found) == [("5", 0, 14, 10), ("5", 1, 1, 12)]


def test_removal_keeps_columns_and_clean_rows(spark, documents):
    bench = spark.createDataFrame([(5, "one two three")], "item_id long, text string")
    d = documents([(1, "zero one two three four"), (2, "one two, three"), (3, "one two four"), (None, None)])
    out = decontaminate.remove_affected(d, bench)
    assert out.columns == d.columns and sorted((r.doc_id for r in out.collect()), key=repr) == [3, None]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(documents([]), none).count() == 0
    assert [tuple(r)[1:4] for r in decontaminate.report(documents([(1, "a b")]), none).collect()] == [(2, 0, 0)]


def test_blocks_stay_small_when_a_third_of_the_rows_are_alike(spark, documents, monkeypatch):
    """Equal rows are one; a text under many ids is cut between ids; the report is still whole."""
    monkeypatch.setattr(decontaminate, "IDS", 50)
    passage = " ".join(f"word{i}" for i in range(60))
    items = [(7, passage)] * 1000 + [(1000 + i, passage) for i in range(700)] + [(i, f"own text number n{i} " * 20) for i in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    blocks = decontaminate.blocks_of(bench, 4000).collect()
    size = {}
    for r in blocks:
        size[r.block] = size.get(r.block, 0) + len(r.text) + sum(map(len, r.ids))
    assert max(size.values()) <= 4000 + max(len(r.text) + sum(map(len, r.ids)) for r in blocks) and len(blocks) == 300 + -(-701 // 50)
    docs = [(1, "x " + passage + " y"), (2, "clean " * 30), (3, items[-1][1])]
    got = decontaminate.report(documents(docs), bench, 10, 40_000).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(docs, sorted(set(items)))


def test_names_of_other_columns_do_not_matter(spark, documents):
    bench = spark.createDataFrame([(5, "one two three")], "item_id long, text string")
    d = documents([(1, "one two three"), (2, "clean")]).withColumnsRenamed({"fingerprint": "_found", "ids": "_words", "score": "_FOUND_"})
    out = decontaminate.remove_affected(d, bench)
    assert out.columns == d.columns and [(r.doc_id, r["_found"], r["_words"]) for r in out.collect()] == [(2, 7, 7)]
