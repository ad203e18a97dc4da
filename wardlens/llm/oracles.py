"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, j, j + least(10, len(w)) - 1) AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, j, list_slice(w, j, j + size - 1) AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d, sizes WHERE len(w) >= size)),
met AS (SELECT doc_id, item_id, j, size, len(item_windows.gram) AS n FROM doc_windows JOIN item_windows USING (size, gram)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS k FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id, j, size, ij,
                j - row_number() OVER (PARTITION BY doc_id, item_id, j - ij ORDER BY j) AS run
         FROM met JOIN (SELECT item_id, size, gram, ij FROM (
                SELECT item_id, least(10, len(w)) AS size, j AS ij, list_slice(w, j, j + least(10, len(w)) - 1) AS gram
                FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS j FROM b WHERE len(w) > 0))) i
              USING (item_id, size)
              JOIN doc_windows USING (doc_id, size, j)
         WHERE doc_windows.gram = i.gram),
longest AS (SELECT doc_id, max(n) AS longest FROM (
              SELECT doc_id, max(j) - min(j) + max(size) AS n FROM runs GROUP BY doc_id, item_id, j - ij, run) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_ESCAPED = r"regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length({_ESCAPED})) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_learned
FROM t GROUP BY conv_id
"""

_RECORD = r"""'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl
       || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen({html}) || nl || nl || {html} || nl || nl"""


def warc_audit(records_per_file: int = 1024, spoiled: int = 97, lost: int = 499, levels: int = 4, range_bits: int = 16, fan_bits: int = 4) -> str:
    """The audit of `warc.audit_pages` where page_id % spoiled = 0 is spoiled and page_id % lost = 1 is lost."""
    def nodes(side: str, pick: str, keep: str) -> str:
        out = [f"{side}0 AS (SELECT file, off AS node, off >> {range_bits} AS up, {pick} AS digest FROM placed {keep})"]
        for k in range(1, levels + 1):
            up = f"node >> {fan_bits}" if k < levels else "0"
            out.append(f"{side}{k} AS (SELECT file, up AS node, {up.replace('node', 'up')} AS up, sha256(string_agg(node || ':' || digest, ';' ORDER BY node)) AS digest "
                       f"FROM {side}{k - 1} GROUP BY file, {side}{k - 1}.up)")
        out.append(f"{side}{levels + 1} AS (SELECT file, up AS node, 0 AS up, sha256(string_agg(node || ':' || digest, ';' ORDER BY node)) AS digest "
                   f"FROM {side}{levels} GROUP BY file, {side}{levels}.up)")
        return ",\n".join(out)

    steps = [f"c{levels + 1} AS (SELECT file, node, l.digest AS dl, r.digest AS dr FROM a{levels + 1} l FULL JOIN b{levels + 1} r USING (file, node))"]
    for k in range(levels, -1, -1):
        steps.append(f"""c{k} AS (SELECT file, node, l.digest AS dl, r.digest AS dr
  FROM (SELECT a.* FROM a{k} a JOIN c{k + 1} c ON a.file = c.file AND a.up = c.node AND c.dl IS DISTINCT FROM c.dr) l
  FULL JOIN (SELECT b.* FROM b{k} b JOIN c{k + 1} c ON b.file = c.file AND b.up = c.node AND c.dl IS DISTINCT FROM c.dr) r USING (file, node))""")
    seen = " UNION ALL ".join(f"SELECT file FROM c{k}" for k in range(levels + 1))
    bad = "CASE WHEN substr(html, 1, 1) = '#' THEN '?' ELSE '#' END || substr(html, 2)"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
                  {bad} AS bad FROM pages),
leaf AS (SELECT page_id, url, {_RECORD.format(html='html')} AS rec,
                CASE WHEN page_id % {spoiled} = 0 THEN {_RECORD.format(html='bad')} ELSE {_RECORD.format(html='html')} END AS other FROM p),
digest AS (SELECT page_id, url, strlen(rec) AS size, sha256(rec) AS digest, sha256(other) AS other, page_id % {lost} = 1 AS lost FROM leaf),
numbered AS (SELECT *, row_number() OVER (ORDER BY page_id, url, digest) - 1 AS rn FROM digest),
placed AS (SELECT *, rn // {records_per_file} AS file,
                  CAST(coalesce(sum(size) OVER (PARTITION BY rn // {records_per_file} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM numbered),
{nodes('a', 'digest', '')},
{nodes('b', 'other', 'WHERE NOT lost')},
{','.join(steps)},
sizes AS (SELECT file, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM placed GROUP BY file),
seen AS (SELECT file, count(*) AS compared FROM ({seen}) GROUP BY file),
damaged AS (SELECT file, count(*) AS n_damaged, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS damaged FROM c0 WHERE dl IS DISTINCT FROM dr GROUP BY file)
SELECT c.file, n AS n_records, bytes AS n_bytes, dl AS root, dr AS replica_root, dl IS NOT DISTINCT FROM dr AS intact,
       coalesce(compared, 0) AS compared, coalesce(n_damaged, 0) AS n_damaged, coalesce(damaged, '') AS damaged
FROM c{levels + 1} c LEFT JOIN sizes USING (file) LEFT JOIN seen USING (file) LEFT JOIN damaged USING (file)
"""

NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, base, substr(h, 2 * base + 1, 1398) AS h, least(500, strlen(h) // 2 - 199 - base) AS n
  FROM (SELECT r, h, unnest(range(0, strlen(h) // 2 - 199, 500)) AS base FROM d WHERE strlen(h) >= 400)),
s AS (SELECT r, base + i AS p, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, base, h, unnest(range(0, n)) AS i FROM part)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p FROM s SEMI JOIN again USING (k)),
edges AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200, true) AS new FROM hit),
numbered AS (SELECT r, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY p) AS run FROM edges),
runs AS (SELECT r, run, min(p) AS b, max(p) + 200 AS e FROM numbered GROUP BY r, run),
gone AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
gaps AS (SELECT r, run, coalesce(lag(e) OVER (PARTITION BY r ORDER BY run), 0) AS a, b FROM runs
         UNION ALL SELECT r, max(run) + 1, max(e), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY run) AS k
         FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


def lm_score(target: str, mu: float = 10.0, alpha: float = 0.5, digits: int = 9) -> str:
    """Cross-entropy difference; ``target`` is the condition of the target documents."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({target}, false) AS chosen, {_WORDS} AS w FROM documents),
t AS (SELECT r, chosen, unnest(list_concat(['^'], w)[1:len(w)]) AS v, unnest(w) AS w FROM d WHERE len(w) > 0),
uni AS (SELECT w, count(*) AS b, count(*) FILTER (chosen) AS c FROM t GROUP BY w),
ctx AS (SELECT w AS v, b, c FROM uni UNION ALL SELECT '^', count(*), count(*) FILTER (chosen) FROM d WHERE len(w) > 0),
pair AS (SELECT v, w, count(*) AS b, count(*) FILTER (chosen) AS c FROM t GROUP BY v, w),
n AS (SELECT count(*) AS size, coalesce(sum(b), 0) AS b, coalesce(sum(c), 0) AS c FROM uni),
loss AS (SELECT t.r,
    -ln((pair.c + {mu} * ((uni.c + {alpha}) / (n.c + {alpha} * n.size))) / (ctx.c + {mu})) AS target,
    -ln((pair.b + {mu} * ((uni.b + {alpha}) / (n.b + {alpha} * n.size))) / (ctx.b + {mu})) AS background
  FROM t JOIN pair USING (v, w) JOIN uni USING (w) JOIN ctx USING (v), n),
mean AS (SELECT r, avg(target) AS target, avg(background) AS background FROM loss GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(target, 0.0), {digits}) AS target_loss,
       round(coalesce(background, 0.0), {digits}) AS background_loss, round(coalesce(target - background, 0.0), {digits}) AS score
FROM d LEFT JOIN mean USING (r)
"""


def licenses(templates, header: float, licence_file: float) -> str:
    """Licence scan and inheritance over source/lang/doc_id: every line, sentence and whole text is weighed against every
    template, and every run of as many words as a template has against that one.  (Runs are made only for texts that
    hold enough of a template's terms: a cosine is at most the length of that part of its unit vector.)"""
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(templates))
    def terms(c: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    def closest(source: str, keys: str) -> str:
        return f"""
  SELECT {keys}, min(struct_pack(far := -round(dot / length, 6), name := name)) AS best FROM (
    SELECT {keys}, sqrt(sum(w * w)) AS length FROM {source} GROUP BY {keys})
  JOIN (SELECT {keys}, k, sum(w * v) AS dot FROM {source} JOIN tv USING (t) GROUP BY {keys}, k) USING ({keys})
  JOIN tmpl USING (k) GROUP BY {keys}"""
    return f"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
tmpl(k, name, text) AS (VALUES {values}),
tn AS (SELECT k, t, count(*) AS n FROM (SELECT k, unnest({terms('text')}) AS t FROM tmpl) GROUP BY k, t),
words AS (SELECT r, t, count(*) AS n FROM (SELECT r, unnest({terms('text')}) AS t FROM f) GROUP BY r, t),
size AS (SELECT count(*) AS n FROM f),
idf AS (SELECT t, ln((1 + size.n) / (1 + coalesce(df, 0))) + 1 AS x FROM (SELECT DISTINCT t FROM tn)
        LEFT JOIN (SELECT t, count(*) AS df FROM words GROUP BY t) USING (t), size),
other AS (SELECT ln((1 + n) / 2) + 1 AS x FROM size),
tv AS (SELECT k, t, tn.n * x / sqrt(sum(tn.n * x * tn.n * x) OVER (PARTITION BY k)) AS v FROM tn JOIN idf USING (t)),
segments AS (SELECT DISTINCT r, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM f),
segw AS (SELECT r, s, t, count(*) * any_value(coalesce(idf.x, other.x)) AS w FROM (SELECT r, s, unnest({terms('s')}) AS t FROM segments)
         LEFT JOIN idf USING (t), other GROUP BY r, s, t),
near AS ({closest('segw', 'r, s')}),
share AS (SELECT r, k FROM words JOIN tv USING (t) GROUP BY r, k HAVING sum(v * v) >= {header ** 2} - 1e-6),
listed AS (SELECT r, {terms('text')} AS w FROM f SEMI JOIN share USING (r)),
runs AS (SELECT r, k, s, list_slice(w, s + 1, s + m) AS g
         FROM (SELECT r, k, w, m, unnest(range(0, greatest(len(w) - m, 0) + 1)) AS s
               FROM share JOIN listed USING (r) JOIN (SELECT k, CAST(sum(n) AS BIGINT) AS m FROM tn GROUP BY k) USING (k))),
runw AS (SELECT r, k, s, t, count(*) * any_value(coalesce(idf.x, other.x)) AS w FROM (SELECT r, k, s, unnest(g) AS t FROM runs)
         LEFT JOIN idf USING (t), other GROUP BY r, k, s, t),
runnear AS (SELECT r, struct_pack(far := -round(dot / length, 6), name := name) AS best
            FROM (SELECT r, k, s, sqrt(sum(w * w)) AS length, sum(w * coalesce(v, 0)) AS dot FROM runw LEFT JOIN tv USING (k, t) GROUP BY r, k, s)
            JOIN tmpl USING (k)),
heads AS (SELECT r, min(best) AS head FROM (SELECT r, best FROM near UNION ALL SELECT r, best FROM runnear) WHERE -best.far >= {header} GROUP BY r),
allw AS (SELECT r, t, n * coalesce(idf.x, other.x) AS w FROM words LEFT JOIN idf USING (t), other),
whole AS ({closest('allw', 'r')}),
own AS (SELECT r, coalesce(-best.far >= {licence_file}, false) AS is_file, CASE WHEN coalesce(-best.far >= {licence_file}, false) THEN best ELSE head END AS o
        FROM f LEFT JOIN whole USING (r) LEFT JOIN heads USING (r)),
files AS (SELECT f.*, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, is_file, o FROM f LEFT JOIN own USING (r)),
spoken AS (SELECT dir AS ancestor, min(o) AS theirs FROM files WHERE is_file GROUP BY dir),
up AS (SELECT dir, depth, CASE WHEN depth = 0 THEN '' ELSE array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') END AS ancestor
       FROM (SELECT DISTINCT dir, unnest(range(0, CASE WHEN dir = '' THEN 1 ELSE len(string_split(dir, '/')) + 1 END)) AS depth FROM files)),
nearest AS (SELECT dir, arg_max(struct_pack(ancestor := ancestor, theirs := theirs), depth) AS near FROM up JOIN spoken USING (ancestor) GROUP BY dir)
SELECT doc_id, path, coalesce(o.name, near.theirs.name) AS license_id, -coalesce(o.far, near.theirs.far) AS score,
       CASE WHEN is_file THEN 'file' WHEN o IS NOT NULL THEN 'header' WHEN near IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o IS NULL THEN near.ancestor END AS licensed_by
FROM files LEFT JOIN nearest USING (dir)
"""
