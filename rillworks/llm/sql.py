"""DuckDB counterparts of the ledger, spelling and manifest queries."""

from rillworks.llm.blob_ledger import BASE, RULES

#: crc32 of a text's UTF-8 bytes, by the table that the reversed polynomial gives.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""


def _crc32(text: str) -> str:
    bytes_of = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {bytes_of}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


def _spans(i: int) -> str:
    rule = RULES[i]
    pattern = rule.pattern.replace("'", "''")
    before = lambda of, to: f"coalesce(list_sum(list_transform({of}[1:{to}], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {i} AS kind_no, '{rule.kind}' AS kind, {before('gaps', 'j')} + {before('m', 'j - 1')} AS a, length(m[j]) AS n FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
      string_split_regex(t, '{pattern}') AS gaps FROM d)) WHERE length(g[j]) >= {rule.least}"""


_SHOWN = "coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, kind_no){}, '')"

ORACLE = {
    "op11_secrets": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(_spans(i) for i in range(len(RULES))) + f""")
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  sha256({_SHOWN.format(f" FILTER (kind_no < {len(BASE)})")}) AS base_sha256, {_SHOWN.format("")} AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id""",

    "op12_spellings": f"""WITH RECURSIVE {_CRC_TABLE},
  runs AS (SELECT coalesce(doc_id::varchar, '') AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
  per AS (SELECT k || ':' || w AS kw, w, count(*) AS c FROM runs GROUP BY ALL),
  hashed AS (SELECT w, c, {_crc32("kw")} AS h FROM per, crc),
  words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
  v AS (SELECT word, cast(sum(c) AS bigint) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
  less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
  near AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
    UNION SELECT a.word, v.word FROM less a JOIN v ON a.x = v.word UNION SELECT v.word, a.word FROM less a JOIN v ON a.x = v.word),
  best AS (SELECT near.word, count(*) AS n_near, first(near ORDER BY b.n DESC, near) AS near, max(b.n) AS near_n FROM near JOIN v b ON near.near = b.word GROUP BY near.word),
  forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
  steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT steps.word, form FROM steps JOIN forms ON steps.root = forms.word WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT s.word, s.root FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NULL) USING (word)""",
}


def _leaf(n_chars: str) -> str:
    element = lambda v: f"coalesce(strlen({v}::varchar) || ':' || ({v}), '-')"
    return f"sha256({' || '.join(map(element, ['doc_id', 'source', 'lang', n_chars, 'text']))})"


#: The roots of the languages are the leaves of one more tree, named `*`.
ORACLE["op13_manifest"] = f"""WITH RECURSIVE {_CRC_TABLE},
  leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::varchar")} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS claim FROM documents, crc),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS cnt FROM leaves),
  up AS (SELECT tree, 0 AS lv, pos, leaf AS h, cnt FROM placed
    UNION ALL SELECT tree, lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (cnt + 1) // 2 FROM up WHERE cnt > 1 GROUP BY tree, lv, pos // 2, cnt),
  subroots AS (SELECT tree, h AS subroot, lv AS top, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS cnt FROM up WHERE cnt = 1),
  over AS (SELECT 0 AS lv, pos, subroot AS h, cnt FROM subroots
    UNION ALL SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (cnt + 1) // 2 FROM over WHERE cnt > 1 GROUP BY lv, pos // 2, cnt),
  root AS (SELECT h AS root, lv AS top FROM over WHERE cnt = 1),
  nodes AS (SELECT tree, lv, pos, h FROM up WHERE cnt > 1 UNION ALL SELECT '*', lv, pos, h FROM over WHERE cnt > 1),
  walk AS (SELECT doc_id, leaf, tree, placed.pos AS leaf_pos, placed.tree AS at, 0 AS lv, placed.pos AS pos, coalesce(claim, leaf) AS h, '' AS proof FROM placed
    UNION ALL SELECT w.doc_id, w.leaf, w.tree, w.leaf_pos,
      CASE WHEN w.at <> '*' AND w.lv = s.top THEN '*' ELSE w.at END, CASE WHEN w.at <> '*' AND w.lv = s.top THEN 0 ELSE w.lv + 1 END,
      CASE WHEN w.at <> '*' AND w.lv = s.top THEN s.pos ELSE w.pos // 2 END,
      CASE WHEN w.at <> '*' AND w.lv = s.top THEN w.h WHEN w.pos % 2 = 0 THEN sha256(w.h || coalesce(b.h, '')) ELSE sha256(b.h || w.h) END,
      CASE WHEN w.at <> '*' AND w.lv = s.top THEN w.proof ELSE w.proof || coalesce(b.h, '') END
    FROM walk w JOIN subroots s ON w.tree = s.tree CROSS JOIN root r LEFT JOIN nodes b ON w.at = b.tree AND w.lv = b.lv AND b.pos = xor(w.pos, 1)
    WHERE NOT (w.at = '*' AND w.lv = r.top))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM walk w JOIN subroots s ON w.tree = s.tree CROSS JOIN root r WHERE w.at = '*' AND w.lv = r.top"""
