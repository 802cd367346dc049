"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import math

from . import decontaminate, license_scan, line_dedup, prefix_trie, quality_rules, substring_dedup, vector_codes


def op10() -> str:
    n = decontaminate.WINDOW
    return rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, w[i : i + least({n}, len(w)) - 1] AS gram
  FROM items, unnest(generate_series(1, len(w) - least({n}, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(gram) AS k FROM grams),
places AS (
  SELECT r, i, k, w[i : i + k - 1] AS gram FROM words, sizes, unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
hits AS (SELECT p.r, p.i, p.k, grams.item FROM places p JOIN grams ON p.gram = grams.gram),
covered AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hits), unnest(generate_series(0, k - 1)) AS t(j) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two DuckDB lists."""
    term = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    x, y = "x[1]", "x[2]"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda x: {term.format(a=x, b=y)} + {term.format(a=y, b=x)})) / 2))"


def op5(documents: str = "documents", columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    q = quality_rules
    shares = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(repr, v))}]" for k, v in q.CLASS_SHARES.items()) + " END"
    words = "CASE lang " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in q.COMMON_WORDS.items()) + " END"
    rates = "CASE lang " + " ".join(f"WHEN '{k}' THEN {[x / 1000 for x in v.values()]}" for k, v in q.COMMON_WORDS.items()) + " END"
    rest = "list_append({a}, greatest(0.0, 1 - list_sum({a})))"
    return rf"""
WITH base AS (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS r FROM {documents}),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
tri AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM words, unnest(generate_series(1, len(w) - 2)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS u(j) GROUP BY r),
marks AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_replace(t, '\p{{L}}+', '', 'g') AS r0, regexp_replace(r0, '[\x20\x09-\x0D]+', '', 'g') AS r1,
         regexp_replace(r1, '[0-9]+', '', 'g') AS r2, regexp_replace(r2, '[.,;:!?''"()\x{{00BF}}\x{{00A1}}\x{{2019}}\x{{2013}}-]+', '', 'g') AS r3,
         ' ' || regexp_replace(lower(t), '[^\p{{L}}]+', '  ', 'g') || ' ' AS z
  FROM words),
hist AS (
  SELECT *, CASE WHEN length(t) >= {q.LEAST_CLASS_CHARS} THEN list_transform([length(t) - length(r0), length(r1) - length(r2), length(r0) - length(r1), length(r2) - length(r3), length(r3)], lambda x: x / length(t)) END AS p1,
         {shares} AS q1, length(z) - length(replace(z, '  ', ' ')) + 1 AS total, {words} AS vocab, {rates} AS rates
  FROM marks),
counted AS (
  SELECT *, CASE WHEN total >= {q.LEAST_COMMON_WORDS} THEN list_transform(vocab, lambda v: (length(z) - length(replace(z, ' ' || v || ' ', ''))) / (length(v) + 2) / total) END AS p2 FROM hist),
judged AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - (length(r0) - length(r1)) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         {_js('p1', 'q1')} AS d1, {_js(rest.format(a='p2'), rest.format(a='rates'))} AS d2
  FROM counted LEFT JOIN rep USING (r)),
verdict AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         NOT base_failed AND coalesce(d1 <= {q.MOST_CLASS_DISTANCE} + sqrt({4 / (8 * math.log(2))!r} / length(t)), true) AND coalesce(d2 <= {q.MOST_WORD_DISTANCE} + sqrt({12 / (8 * math.log(2))!r} / total), true) AS kept
  FROM judged)
SELECT {columns} FROM verdict"""


def op7() -> str:
    esc = r"regexp_replace({x}, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g')"
    text = esc.format(x="text")
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
r AS (
  SELECT *, CASE WHEN regexp_matches(text, '<\\*\|im_(start|end)\|>') THEN {text} ELSE text END AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


def op9() -> str:
    t, quote = license_scan.LEAST_DICE, lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        words = license_scan.template_words(text)
        rows.append(f"({k}, {quote(name)}, {words}, {license_scan.anchors(words, t)})")
    grams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH t AS (SELECT k, license, w AS body, {grams.format(w="w")} AS g, a FROM (VALUES {", ".join(rows)}) AS v(k, license, w, a)),
anchor AS (SELECT k, off, body[off + 1] || ' ' || body[off + 2] AS gram FROM (SELECT k, body, unnest(a) AS off FROM t)),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w, coalesce(regexp_matches(text, {quote(license_scan.LONE_LINE)}), false) AS reserved FROM documents),
p AS (SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram, unnest(range(0, len(w) - 1)) AS pos FROM d),
al AS (SELECT DISTINCT r, k, pos - off AS begin FROM p JOIN anchor USING (gram)),
c AS (SELECT r, k, license, g, greatest(begin, 0) AS start, least(begin + len(body), len(w)) AS stop, w[greatest(begin, 0) + 1 : least(begin + len(body), len(w))] AS win FROM al JOIN t USING (k) JOIN d USING (r)),
x AS (SELECT r, k, license, start, stop, 2 * len(list_intersect(wg, g)) / (len(wg) + len(g)) AS dice FROM (SELECT *, {grams.format(w="win")} AS wg FROM c)),
word AS (SELECT *, unnest(range(start, stop)) AS place FROM x WHERE dice >= {t}),
best AS (SELECT * FROM word QUALIFY row_number() OVER (PARTITION BY r, place ORDER BY dice DESC, k, start, stop DESC) = 1),
own AS (SELECT r, license, dice, count(*) AS n FROM best GROUP BY r, k, license, start, stop, dice HAVING 2 * count(*) >= stop - start),
named AS (SELECT *, max(CAST(license <> {quote(license_scan.LONE)} AS INT)) OVER (PARTITION BY r) AS others FROM own JOIN d USING (r)),
s AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, sum(n) AS n, max(dice) AS best FROM named WHERE CASE WHEN others = 1 THEN license <> {quote(license_scan.LONE)} ELSE reserved END GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_words, round(coalesce(best, 0.0), 6) AS best_dice
FROM d LEFT JOIN s USING (r)"""


def op2() -> str:
    n = substring_dedup.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + {n - 1}], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - {n - 1})) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + j AS i FROM twice, unnest(generate_series(0, {n - 1})) AS t(j)),
kept AS (SELECT r, i, word FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (r, i)),
texts AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN texts USING (r)"""


def op4() -> str:
    n, least = line_dedup.RUN, line_dedup.WORDS
    reach = " ".join(f"WHEN i + {k - 1} <= len(w) AND list_sum(c[i : i + {k - 1}]) >= {least} THEN {k}" for k in range(1, n))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
every AS (SELECT doc_id, r, len(l) AS total, unnest(l) AS line, generate_subscripts(l, 1) AS ln FROM d),
solid AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY ln) AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lists AS (SELECT doc_id, r, list(line ORDER BY i) AS w, list(ln ORDER BY i) AS ats, list(n ORDER BY i) AS c FROM solid GROUP BY ALL),
runs AS (SELECT doc_id, r, i, w, CASE {reach} WHEN i + {n - 1} <= len(w) THEN {n} WHEN i = 1 AND len(w) < {n} THEN -len(w) END AS k FROM lists, unnest(generate_series(1, len(w))) AS t(i)),
win AS (SELECT doc_id, r, i, abs(k) AS k, k || chr(10) || array_to_string(w[i : i + abs(k) - 1], chr(10)) AS h FROM runs WHERE k IS NOT NULL),
later AS (SELECT r, i, k FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, r, i) > 1),
gone AS (SELECT DISTINCT r, ats[i + j] AS ln FROM later JOIN lists USING (r), unnest(generate_series(0, k - 1)) AS t(j)),
kept AS (SELECT * FROM every ANTI JOIN gone USING (r, ln)),
texts AS (SELECT r, string_agg(line || CASE WHEN ln < total THEN chr(10) ELSE '' END, '' ORDER BY ln) AS body FROM kept GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, CAST(coalesce(len(lists.w), 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_lines, sha256(coalesce(texts.body, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN texts USING (r) LEFT JOIN lost USING (r)"""


def op11(rules: list[tuple[str, str, str]]) -> str:
    """Each rule against each URL, by its definition."""
    values = ", ".join("('" + "', '".join(x.replace("'", "''") for x in rule) + "')" for rule in rules)
    return rf"""
WITH cut AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT verdict, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, b FROM (VALUES {values}) AS v(verdict, h, b)),
fit AS (SELECT r, h || b AS rule, verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h) + length(b) DESC, length(h) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (r)"""


def op12() -> str:
    v, rounds = vector_codes, []
    for k in range(v.ROUNDS + 1):
        rounds.append(f"near{k} AS (SELECT r, p, min(d * {v.ENTRIES} + e) AS m FROM (SELECT r, p, e, sum((x.x - b.x) * (x.x - b.x)) AS d FROM x JOIN book{k} b USING (p, j) GROUP BY ALL) GROUP BY ALL)")
        if k < v.ROUNDS:
            rounds.append(f"mean{k} AS (SELECT p, m % {v.ENTRIES} AS e, j, sum(x) AS s, count(*) AS n FROM x JOIN near{k} USING (r, p) GROUP BY ALL)")
            rounds.append(f"book{k + 1} AS (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM book{k} LEFT JOIN mean{k} USING (p, e, j))")
    last = v.ROUNDS
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({v.SCALE} * x) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // {v.PARTS}) AS p, (i - 1) % (len(v) // {v.PARTS}) AS j, v[i] AS x FROM k, unnest(generate_series(1, len(v))) AS t(i)),
book0 AS (SELECT p, r - 1 AS e, j, x FROM x WHERE r <= {v.ENTRIES}),
{", ".join(f"{part.replace(' AS (', ' AS MATERIALIZED (', 1)}" for part in rounds)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(m % {v.ENTRIES} AS INT)), '' ORDER BY p) AS code, CAST(sum(m // {v.ENTRIES}) AS BIGINT) AS error FROM near{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{last}) AS codebooks_sha256
FROM k JOIN coded USING (r)"""


def op13() -> str:
    t = prefix_trie
    step = "xor(a, b) >> 1"
    crc = f"xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor({step}, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {{'role': coalesce(role, ''), 'said': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY p) AS own, {crc} % {t.HEADS} AS h FROM t GROUP BY conv_id),
s AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.own[1 : c.h], []), c.own[c.h + 1 :]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % {t.FAMILY}),
starts AS (SELECT conv_id, d, seq[1 : d] AS path, len(seq) = d AS ends FROM s, unnest(generate_series(0, len(seq))) AS g(d)),
n AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM starts GROUP BY path, d),
kids AS (SELECT path[1 : d - 1] AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
own AS MATERIALIZED (SELECT n.*, coalesce(kids.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(path[d].said)) ELSE 0 END AS saved FROM n LEFT JOIN kids USING (path)),
sums AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved FROM own a JOIN own b ON b.d >= a.d AND b.path[1 : a.d] = a.path GROUP BY a.path)
SELECT o.conv_id, o.d AS depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums USING (path) LEFT JOIN n up ON up.d = o.d - 1 AND up.path = o.path[1 : o.d - 1]"""
