"""DuckDB SQL for the queries that SQL can express, each written from its contract.

Rules and wording come from the operators' own tables of fixed values
(`quality.GRID`, `licenses.TEMPLATES`, `chat.CONTROLS`); how they are applied is
stated here once more, in another way: tails of the binomial distribution by
`lgamma`, phrases by a join of words and positions, Jaccard links by counting
shared shingles of all pairs, components by reachability.
"""

from __future__ import annotations

from gridlens.llm import chat, licenses, quality

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules(risk: float = 0.03, alpha: float = 0.05) -> str:
    p = risk / len(quality.GRID)
    measured = {"symbol_pct": ("n_symbols", "word_chars"), "upper_pct": ("n_upper", "word_chars"), "dup_line_pct": ("n_dup_lines", "n_lines")}
    rates = ", ".join(f"CASE WHEN {whole} > 0 THEN 100.0::DOUBLE * {part} / {whole} ELSE 0 END AS {rule}" for rule, (part, whole) in measured.items())
    steps = ", ".join(f"({literal(rule)}, {j}, {cut}::DOUBLE)" for rule, cuts in quality.GRID.items() for j, cut in enumerate(cuts))
    value = "CASE rule " + " ".join(f"WHEN {literal(rule)} THEN {rule}" for rule in quality.GRID) + " END"
    cut = {rule: f"(SELECT min(cut) FROM certified c WHERE c.rule = {literal(rule)} AND c.stratum IS NOT DISTINCT FROM rated.stratum)" for rule in quality.GRID}
    refused = "CASE WHEN base_failed THEN 'base' " + " ".join(f"WHEN {rule} > {cut[rule]} THEN {literal(rule)}" for rule in quality.GRID) + " END"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w,
         regexp_extract_all(coalesce(text, ''), '[^\n]*[^\x20\x09-\x0D][^\n]*') AS lines
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS words
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM texts)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, words) > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM repeated) GROUP BY r),
measured AS (
  SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper
  FROM texts),
rated AS (
  SELECT m.*, coalesce(c.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(c.n, 0) > 30 * n_words AS base_failed, {rates}
  FROM measured m LEFT JOIN covered c USING (r)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (SELECT rated.* FROM rated JOIN good USING (doc_id) WHERE NOT base_failed),
steps(rule, j, cut) AS (VALUES {steps}),
counted AS (
  SELECT stratum, rule, j, cut, count(*) AS n, count(*) FILTER (WHERE {value} > cut) AS k
  FROM holdout CROSS JOIN steps GROUP BY ALL),
tails AS (
  SELECT stratum, rule, j, cut,
         list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln({1 - p!r})) FOR i IN range(0, k + 1)]) AS tail
  FROM counted),
certified AS (
  SELECT stratum, rule, cut FROM tails
  QUALIFY bool_and(tail <= {alpha} / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM holdout)) * {len(quality.GRID)}))
          OVER (PARTITION BY stratum, rule ORDER BY j))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       {refused} IS NULL AS kept, {refused} AS refused_by
FROM rated"""


def chat_formatting() -> str:
    controls = " + ".join(f"(length(text) - length(replace(text, {literal(c)}, ''))) // {len(c)}" for c in chat.CONTROLS)
    return rf"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT conv_id, turn, role AS given, coalesce(role, 'user') AS role, text AS said, coalesce(text, '') AS text FROM said)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, given NULLS FIRST, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn:' || regexp_replace(role, '([\\|<\[])', '.\1', 'g') || '|>.') + length('<|end|>.')
           + length(text) + length(text) - length(replace(text, chr(92), '')) + {controls})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


def license_scans() -> str:
    rows = ", ".join(
        f"({k}, {literal(label)}, {place}, [{', '.join(map(literal, ws))}], {str(must).lower()})" for k, (label, place, ws, must) in enumerate(licenses.phrases())
    )
    return rf"""
WITH phrases(phrase, label, place, ws, must) AS (VALUES {rows}),
files AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM files),
vocabulary AS (SELECT DISTINCT unnest(ws) AS word FROM phrases),
held AS (SELECT word, count(DISTINCT r) AS n FROM tokens SEMI JOIN vocabulary USING (word) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM files) + 1) / (coalesce(held.n, 0) + 1)::DOUBLE) AS idf FROM vocabulary LEFT JOIN held USING (word)),
weighed AS (
  SELECT phrase, label, place, ws, must, greatest(max(idf), 1e-9) AS weight
  FROM (SELECT *, unnest(ws) AS word FROM phrases) JOIN idf USING (word) GROUP BY ALL),
hits AS (
  SELECT t.r, t.pos, p.* FROM tokens t JOIN weighed p ON t.word = p.ws[1] JOIN files f ON f.r = t.r
  WHERE f.w[t.pos + 1:t.pos + len(p.ws)] = p.ws),
base AS (
  SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label[6:]) AS labels
  FROM hits WHERE starts_with(label, 'base:') GROUP BY r),
votes AS (
  SELECT DISTINCT r, label, phrase, must, weight, unnest([floor((pos - place) / 16) * 2, floor((pos - place + 8) / 16) * 2 + 1]) AS bin
  FROM hits WHERE NOT starts_with(label, 'base:')),
templates AS (SELECT label, sum(weight ORDER BY phrase) AS total, count(*) FILTER (WHERE must) AS musts FROM weighed GROUP BY label),
bins AS (
  SELECT r, label, bin, sum(weight) FILTER (WHERE must) / total + coalesce(sum(weight / total ORDER BY phrase) FILTER (WHERE NOT must), 0) AS score
  FROM votes JOIN templates USING (label) GROUP BY r, label, bin, total, musts HAVING count(*) FILTER (WHERE must) = musts),
found AS (SELECT r, list(DISTINCT label) AS labels, max(least(1.0, score)) AS score FROM bins GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       coalesce(found.score, CASE WHEN base.n > 0 THEN 0.5 END, 0)::DOUBLE AS score
FROM files LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


def jaccard_join() -> str:
    return rf"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{WORDS}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shared JOIN sizes p ON p.r = shared.a JOIN sizes q ON q.r = shared.b JOIN texts x ON x.r = shared.a JOIN texts y ON y.r = shared.b
  WHERE 100 * k >= 80 * (p.n + q.n - k) AND x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM texts WHERE doc_id IS NOT NULL
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = texts.doc_id)::BIGINT AS component_id
FROM texts LEFT JOIN sizes USING (r)"""


def suffix_dedup(length: int = 100) -> str:
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, b, i, b[i + 1:i + {length}] AS s FROM (SELECT *, unnest(range(octet_length(b) - {length - 1})) AS i FROM t)),
again AS (SELECT r, i FROM w QUALIFY rank() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, b, i) > 1),
turns AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 0 ELSE 1 END AS turn FROM again),
runs AS (SELECT r, min(i) AS start, max(i) + {length} AS stop FROM (SELECT *, sum(turn) OVER (PARTITION BY r ORDER BY i) AS run FROM turns) GROUP BY r, run),
edges AS (
  SELECT r, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS a, start AS z FROM runs
  UNION ALL SELECT r, max(stop), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(hex(b[a + 1:coalesce(z, octet_length(b))]), '' ORDER BY a) AS h FROM edges JOIN t USING (r) GROUP BY r),
cut AS (SELECT r, sum(stop - start) AS n, count(*) AS k FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM t LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)"""


WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def hard_negatives() -> str:
    return rf"""
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, count(*) AS n
  FROM embeddings WHERE label IS NOT NULL AND {WHOLE} GROUP BY ALL),
copies AS (SELECT e.* EXCLUDE n, unnest(range(n)) AS copy FROM e),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS kind, a.v, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN copies b ON a.vec_id IS DISTINCT FROM b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, kind, v ORDER BY score DESC, other NULLS LAST) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.kind, p.v, place ORDER BY s.score DESC, s.other NULLS LAST) AS rank,
         s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.kind = p.kind AND s.v = p.v AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    near = lambda k: f"""
a{k} AS (
  SELECT x.r, x.p, min((list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, b.c) + list_inner_product(b.c, b.c)) * {entries} + b.e)::BIGINT AS best
  FROM cut x JOIN b{k} b USING (p) GROUP BY ALL)"""  # noqa: E731
    step = lambda k: f"""
b{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT p, e, list(floor(total / n) ORDER BY j) AS c FROM (
      SELECT p, best % {entries} AS e, j, sum(cut.x[j]) AS total, count(*) AS n FROM a{k} JOIN cut USING (r, p), range(1, (SELECT max(len(v)) FROM kept) // {parts} + 1) t(j) GROUP BY ALL)
    GROUP BY ALL) m USING (p, e))"""  # noqa: E731
    loop = ",".join(near(k) + "," + step(k) for k in range(rounds))
    return rf"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE {WHOLE}),
cut AS (SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, v) - 1 AS e, x AS c FROM cut JOIN (SELECT r, v FROM kept) USING (r) QUALIFY e < {entries}),
{loop},{near(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS digest FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (r), books"""


def oracle_sql() -> dict[str, str]:
    return {"op11_suffix_array_dedup": suffix_dedup(), "op12_hard_negatives": hard_negatives(), "op13_vector_codes": vector_codes(), "op1_quality_rules": quality_rules(), "op2_chat_formatting": chat_formatting(), "op4_license_scans": license_scans(), "op5_ngram_jaccard_join": jaccard_join()}
