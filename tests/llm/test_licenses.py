import math
import re

import duckdb
from pyspark.sql import functions as F

from wardlens.llm import licenses as L
from wardlens.llm import oracles

FILES = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "plain words"), ("a/b/c/LICENSE", "Licensed under CC BY-NC 4.0."),
         ("a/b/c/d/y", "none"), ("a/b/c/z", "first line\nlicensed under the APACHE license, version 2.0. more words"), ("q", "outside"),
         ("a/LICENSE2", "Licensed under the Apache License, Version 2.0."), (None, "Released under the MIT License."), ("r/s", None), ("r/t", ""),
         ("a/b/x.py", "plain words"), ("big", "word " * 50000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "word " * 50000)]


def brute(files):
    n = len(files)
    docs = [set(L.terms_of(t or "")) for _, t in files]
    df = {t: sum(t in d for d in docs) for _, x in L.TEMPLATES for t in L.terms_of(x)}
    w = lambda t: L.idf(n, df.get(t, 1))

    def vec(text):
        own = L.terms_of(text)
        return {t: own.count(t) * w(t) for t in set(own)}

    def cos(a, b):
        la, lb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
        return round(sum(x * b.get(t, 0) for t, x in a.items()) / (la * lb), 6) if la and lb else 0.0

    def best(text):
        return min((-cos(vec(text), vec(x)), k) for k, x in L.TEMPLATES)

    def runs(text):
        """Best of the runs of as many words as a template has, each against that template."""
        words, found = L.terms_of(text), [(9, "")]
        own_terms = {x: set(L.terms_of(x)) for _, x in L.TEMPLATES}
        for k, x in L.TEMPLATES:
            size = len(L.terms_of(x))
            for i in range(max(1, len(words) - size + 1)):
                part = words[i:i + size]
                if set(part) & own_terms[x]:
                    found.append((-cos(vec(" ".join(part)), vec(x)), k))
        return min(found)
    own = []
    for _, t in files:
        t = t or ""
        whole = best(t)
        head = min([*(best(s) for s in re.sub(r"([.!?])[ \t\r]+", "\\1\n", t).split("\n")), runs(t)])
        own.append(("file", whole) if -whole[0] >= L.LICENCE_FILE else ("header", head) if -head[0] >= L.HEADER else None)
    up = lambda p: "" if "/" not in p else p.rsplit("/", 1)[0]
    dirs = {}
    for (p, _), o in zip(files, own):
        if o and o[0] == "file" and p is not None:
            dirs[up(p)] = min(dirs.get(up(p), (9, "")), o[1])
    out = []
    for (p, _), o in zip(files, own):
        if o:
            out.append((p, o[1][1], -o[1][0], o[0], None))
            continue
        d = up(p) if p is not None else None
        while d is not None and d not in dirs:
            d = up(d) if d else None
        out.append((p, dirs[d][1], -dirs[d][0], "inherited", d) if d is not None else (p, None, None, None, None))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    d = spark.createDataFrame(FILES, "path string, text string").withColumns({c: F.lit(1) for c in ("key", "term", "segment", "depth")})
    got = L.inherit(L.scan(d.select("path", "text")))
    assert sorted((tuple(r[c] for c in ("path", "license_id", "score", "origin", "licensed_by")) for r in got.collect()), key=repr) == brute(FILES)
    assert set(d.columns) - {"text"} <= set(L.inherit(L.scan(d)).columns)
    assert L.inherit(L.scan(d)).count() == len(FILES)


def sql_rows(rows):
    """The registered SQL over documents (doc_id, text, lang, source)."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(oracles.licenses(L.TEMPLATES, L.HEADER, L.LICENCE_FILE))
    names = [d[0] for d in cur.description]
    return names, sorted(map(tuple, cur.fetchall()), key=repr)


def test_sql_knows_whole_files_and_wrapped_notices(spark):
    """A licence file without a close line, what inherits from it, a notice wrapped in comment lines, and a plain file."""
    words = L.TEMPLATES[1][1].split()
    spread = "\n".join(f"{' '.join(words[i:i + 5])} zq{i}a zq{i}b" for i in range(0, len(words), 5))
    notice = "import os\n" + "\n".join(wrapped(L.TEMPLATES[5][1], 40, "# ")) + "\n" + "\n".join(f"x{i} = y{i}" for i in range(60))
    rows = [(1, spread, "en", "a"), (2, "plain", "en", "a"), (3, notice, "en", "b"), (4, "outside", "de", "c"), (None, None, None, "a"),
            (5, "Released under\nthe MIT License.", "en", "d"), (6, "", "en", "d"), (3, notice, "en", "b")]
    names, want = sql_rows(rows)
    got = L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    found = {r[names.index("doc_id")]: (r[names.index("license_id")], r[names.index("origin")]) for r in want}
    assert found[1] == ("MIT", "file") and found[2] == ("MIT", "inherited") and found[3] == ("GPL-3.0", "header") and found[4] == (None, None)


def test_heavy_terms_are_enough():
    v = {"a": 0.9, "b": 0.4, "c": 0.17}
    v = {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    heavy = L.heavy_terms([v], 0.75)
    assert heavy == ["a"] and math.sqrt(sum(x * x for t, x in v.items() if t not in heavy)) < 0.75


def test_documents_and_empty_table(documents):
    d = documents([(1, "Released under the MIT License."), (None, None), (2, "x")])
    assert {r.doc_id: r.license_id for r in L.scan_documents(d).collect()} == {1: "MIT", None: "MIT", 2: "MIT"}
    assert L.scan_documents(documents([])).count() == 0


def scores(files, templates=L.TEMPLATES):
    """Function (text, template number) -> cosine, by the document frequencies of ``files``."""
    docs = [set(L.terms_of(t or "")) for _, t in files]
    w = {t: L.idf(len(files), sum(t in d for d in docs)) for _, x in templates for t in L.terms_of(x)}

    def vec(text):
        own = L.terms_of(text)
        return {t: own.count(t) * w.get(t, L.idf(len(files), 1)) for t in set(own)}

    def cos(text, k):
        a, b = vec(text), vec(templates[k][1])
        return sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return cos


def test_whole_text_counts_without_a_header(spark):
    """A licence file none of whose lines is close to a template still speaks for its directory."""
    words = L.TEMPLATES[1][1].split()
    text = "\n".join(f"{' '.join(words[i:i + 5])} zq{i}a zq{i}b" for i in range(0, len(words), 5))
    files = [("m/LICENSE", text), ("m/LICENSE", text), ("m/x/y.py", "plain"), ("n/z.py", "plain")]
    cos = scores(files)
    assert max(cos(s, 1) for s in text.split("\n")) < L.HEADER and cos(text, 1) >= L.LICENCE_FILE
    got = L.inherit(L.scan(spark.createDataFrame(files, "path string, text string"))).collect()
    assert sorted((r.path, r.license_id, r.score, r.origin, r.licensed_by) for r in got if r.license_id) == [
        *[("m/LICENSE", "MIT", round(cos(text, 1), 6), "file", None)] * 2, ("m/x/y.py", "MIT", round(cos(text, 1), 6), "inherited", "m")]


def wrapped(words, width, mark):
    out, line = [], ""
    for x in words.split():
        if line and len(mark) + len(line) + 1 + len(x) > width:
            out, line = [*out, line], ""
        line = f"{line} {x}".strip()
    return [mark + x for x in [*out, line]]


def test_wrapped_notices_are_headers(spark):
    """A notice cut into lines (and two sentences) none of which is close enough; repeated terms count as one dimension."""
    code = "\n" + "\n".join(f"x{i} = y{i}" for i in range(60))
    files, notice = [(f"filler/{i}", f"plain {i}") for i in range(6)], {}
    for k, mark, width in ((1, " * ", 48), (3, "// ", 48), (5, "# ", 40), (8, "-- ", 48), (9, "% ", 36)):
        lines = wrapped(L.TEMPLATES[k][1], width, mark)
        notice[f"p{k}/a"] = k, lines
        files.append((f"p{k}/a", "import os\r\n" + "\r\n".join(lines) + code))
    files.append(("short/a", "this source code form is subject\n# to the terms of the\n# mozilla public license"))
    cos = scores(files)
    for k, lines in notice.values():
        assert max(cos(s, j) for x in lines for s in re.split(r"(?<=[.!?])[ ]+", x) for j in range(len(L.TEMPLATES)) if L.terms_of(s)) < L.HEADER
    got = {r.path: (r.license_id, r.score, r.origin) for r in L.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: got[p] for p in notice} == {p: (L.TEMPLATES[k][0], 1.0, "header") for p, (k, _) in notice.items()}
    assert got["short/a"][0] == "MPL-2.0" and all(got[f"filler/{i}"] == (None, None, None) for i in range(6))
