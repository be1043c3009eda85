"""DuckDB SQL for the operators that SQL can express, on whole tables."""

from __future__ import annotations

from fairlead.llm.quality import CUTOFFS, DELTA, PRICE, RISK

_WORDS = "list_filter(string_split(translate({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')"

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents WHERE doc_id IS NOT NULL),
  g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  h AS (SELECT doc_id, md5(array_to_string(s, ' ')) AS s FROM g),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
  l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b),
  c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
  SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, d.doc_id = coalesce(c.root, d.doc_id) AS kept
  FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

_FEATURE = {
    "symbol_rate": "n_symbols / nullif(word_chars, 0)", "caps_rate": "caps / nullif(word_chars, 0)", "dup_line_rate": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_rate": "n_repeat_words / nullif(n_words, 0)", "word_length": "word_chars / nullif(n_words, 0)"}
_TESTS = [(r, c) for r, cs in CUTOFFS.items() for c in cs]
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, coalesce(lang, '?null') AS st, '{r}' AS rule, CAST({c} AS DOUBLE) AS cutoff, coalesce({_FEATURE[r]} >= CAST({c} AS DOUBLE), false) AS hit FROM b" for r, c in _TESTS)
_P = RISK / len(CUTOFFS)

OP6 = f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    ')) <> '') AS ln FROM documents),
  win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM w, unnest(range(1, len(w) - 3)) u(i)),
  rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
  cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) r(k) GROUP BY doc_id),
  base AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ln) AS BIGINT) AS n_lines, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS caps FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
  k AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
  hits AS ({_HITS}),
  t AS (SELECT h.st, rule, cutoff, count(*) FILTER (q = 1) AS n, count(*) FILTER (hit AND q = 1) AS g, count(*) FILTER (hit AND q = 0) AS bad
    FROM hits h JOIN k ON k.doc_id = h.doc_id JOIN b ON b.doc_id = h.doc_id WHERE NOT b.base_failed GROUP BY 1, 2, 3),
  p AS (SELECT *, (SELECT count(DISTINCT st) FROM t) AS strata,
    list_sum(list_transform(range(g + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln(1 - {_P})))) AS chance FROM t WHERE bad > {PRICE} * g),
  c AS (SELECT st, rule, cutoff FROM p WHERE chance <= {DELTA}::DOUBLE / ({len(_TESTS)} * strata) QUALIFY row_number() OVER (PARTITION BY st, rule ORDER BY bad - {PRICE} * g DESC, cutoff DESC) = 1),
  f AS (SELECT DISTINCT h.doc_id FROM hits h JOIN c ON c.st = h.st AND c.rule = h.rule AND c.cutoff = h.cutoff WHERE hit)
  SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept FROM b LEFT JOIN f ON f.doc_id = b.doc_id"""

OP8 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
  f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d AND n >= 100"""

def _crc32(points: str) -> str:
    """CRC-32 of a list of bytes, eight bits a step: the register's low byte chooses by its bits."""
    table = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    low = "xor(a, b)"
    mixed = "a >> 8"
    for k, c in enumerate(table):
        mixed = f"xor({mixed}, ({low} >> {k} & 1) * {c})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {points}), lambda a, b: {mixed}), 4294967295::BIGINT)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(fields)})"


def _levels(name: str, many: int) -> str:
    """From {name}0(tree, i, d, n) the runs {name}_r0 ... of each level and the last level, many levels up."""
    return "".join(f""",
  {name}_r{k} AS (SELECT tree, i // 8 AS p, n, list(d ORDER BY i) AS l FROM {name}{k} GROUP BY tree, i // 8, n),
  {name}{k + 1} AS (SELECT tree, p AS i, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS d, CAST(ceil(n / 8e0) AS BIGINT) AS n FROM {name}_r{k})""" for k in range(many))


def _paths(source: str, name: str, at: str, tree: str, many: int) -> str:
    """Folds column f and gathers column proof along the runs of ``name``, from {source}0 to {source}{many}."""
    out = ""
    for k in range(many):
        place = f"(x.{at} // {8 ** k} % 8)"
        left, right = f"array_to_string(l[1:{place}], '')", f"array_to_string(l[{place} + 2:], '')"
        out += f""",
  {source}{k + 1} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN r.n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof
    FROM {source}{k} x JOIN {name}_r{k} r ON r.tree = {tree} AND r.p = x.{at} // {8 ** (k + 1)})"""
    return out


#: Levels of the SQL: enough for 8 ** LEVELS rows of one lang and 8 ** TOP langs.
LEVELS, TOP = 7, 3

OP12 = f"""WITH t AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_crc32("list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda j: CAST(ascii(CAST(doc_id AS VARCHAR)[j]) AS BIGINT))")} % 3 = 0
    THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tried FROM documents),
  a AS (SELECT doc_id, leaf, coalesce(tried, leaf) AS f, '' AS proof, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM t),
  n0 AS (SELECT tree, i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM a){_levels("n", LEVELS)},
  m0 AS (SELECT 0 AS tree, tree AS i, d, count(*) OVER () AS n FROM n{LEVELS}){_levels("m", TOP)},
  x0 AS (SELECT * FROM a){_paths("x", "n", "i", "x.tree", LEVELS)},
  y0 AS (SELECT * FROM x{LEVELS}){_paths("y", "m", "tree", "0", TOP)}
  SELECT doc_id, leaf, n{LEVELS}.d AS subroot, m{TOP}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m{TOP}.d AS verified
  FROM y{TOP} y JOIN n{LEVELS} ON n{LEVELS}.tree = y.tree, m{TOP}"""

_BYTES = "flatten(list_transform(range(1, len(s) + 1), lambda j: CASE WHEN unicode(s[j]) < 128 THEN [unicode(s[j])::BIGINT] ELSE [192 + (unicode(s[j]) >> 6)::BIGINT, 128 + (unicode(s[j]) & 63)::BIGINT] END))"

OP13 = f"""WITH RECURSIVE r AS (SELECT doc_id, translate(u.r, '{_UPPER}', '{_LOWER}') AS w, count(*) AS k FROM documents, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) u(r) GROUP BY ALL),
  h AS (SELECT w, k, {_crc32(_BYTES)} AS h FROM (SELECT *, CAST(doc_id AS VARCHAR) || ':' || w AS s FROM r)),
  c AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, k FROM h),
  v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5),
  e AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS s FROM v, unnest(range(length(word))) u(i)),
  near AS (SELECT a.word, b.word AS other, b.n FROM e a JOIN e b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
    UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.s UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.s),
  best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN other END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best USING (word)),
  up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
  last AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
  SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN last USING (word)"""

SQL = {"op5_minhash_near_dedup": OP5, "op6_quality_rules": OP6, "op8_warc": OP8, "op12_merkle_manifest": OP12, "op13_spelling_variants": OP13}
