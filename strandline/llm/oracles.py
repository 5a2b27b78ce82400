"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from strandline.llm.common import LOWER, UPPER
from strandline.llm.line_rules import BOILERPLATE

_PHRASES = " OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)
OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
  words AS (SELECT doc_id, unnest(w) w, generate_subscripts(w, 1) i FROM d),
  windows AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o k FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  twice AS (SELECT doc_id, i FROM windows WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
  repeated AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) j FROM twice) GROUP BY 1),
  split AS (SELECT doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i FROM d),
  lines AS (SELECT doc_id, line, i, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') w, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) marks FROM split),
  judged AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 again,
      (NOT regexp_matches(line, '[.!?…。！？؟।]["''”’»›)\\]}}*_]*(?:\\s|$)') AND len(w) < 8) OR marks > 0.1 * chars
      OR (len(list_filter(w, lambda x: x = '|')) >= 3 AND len(list_filter(w, lambda x: x = '|')) >= 0.2 * len(w)) OR {_PHRASES} fails
    FROM lines WHERE len(w) > 0),
  l AS (SELECT doc_id, count(*) FILTER (again) dup, coalesce(sum(chars) FILTER (fails), 0) removed, count(*) FILTER (fails) n_removed FROM judged GROUP BY 1),
  r AS (SELECT doc_id, len(w)::BIGINT n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
      coalesce(dup, 0)::BIGINT n_dup_lines, coalesce(n, 0)::BIGINT n_repeat_words, coalesce(removed, 0)::BIGINT removed_chars, coalesce(n_removed, 0)::BIGINT n_removed_lines
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_chars <= 0.5 * word_chars kept FROM r"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT item_id, {_WORDS} w FROM benchmark),
  bw AS (SELECT item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) s FROM b WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') k FROM bw),
  dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n),
  hits AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN windows ON windows.n = dw.n AND k = array_to_string(w[s:s + dw.n - 1], ' ')),
  words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hits) GROUP BY 1),
  items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


#: Unsigned crc32 of a text, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::INT, 2))::UBIGINT),
    lambda a, b: list_reduce(range(8), lambda x, k: xor(x::UBIGINT >> 1, 3988292384::UBIGINT * (x::UBIGINT & 1)), xor(a, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""


OP12 = f"""
WITH RECURSIVE found AS (SELECT coalesce(doc_id::VARCHAR, '') id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]{{6,}}')) w FROM documents),
  runs AS (SELECT w, id || ':' || w k, count(*) n FROM found GROUP BY id, w),
  checked AS (SELECT w, n, {_CRC32.format("k")} h FROM runs),
  words AS (SELECT word, sum(n)::BIGINT n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END word, n FROM checked)
    WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) rest FROM (SELECT word, unnest(range(1, length(word) + 1)) i FROM words)),
  near AS (SELECT a.word, b.word other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT less.word, w.word FROM less JOIN words w ON w.word = rest UNION SELECT w.word, less.word FROM less JOIN words w ON w.word = rest),
  best AS (SELECT near.word, count(*) n_near, arg_min(o.word, (-o.n, o.word)) form, max(o.n) form_n FROM near JOIN words o ON o.word = other GROUP BY 1),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 5 * n THEN form END form, CASE WHEN form_n >= 5 * n THEN form_n END form_n FROM words w LEFT JOIN best USING (word)),
  chain(word, root, k) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN forms ON forms.word = root WHERE form IS NOT NULL),
  ends AS (SELECT word, arg_max(root, k) root FROM chain GROUP BY 1)
SELECT word, form, coalesce(root, word) root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


OP13 = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () r, coalesce({_CRC32.format("doc_id::VARCHAR")} % 7 = 0, false) altered FROM documents),
  leaves AS (SELECT r, doc_id, lang, {_leaf("n_chars")} leaf, CASE WHEN altered THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END told FROM d),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 i, count(*) OVER (PARTITION BY lang) n FROM leaves),
  tree(lang, level, i, node, n) AS (SELECT lang, 0::BIGINT, i, leaf, n FROM placed
    UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n),
  tops AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 i, count(*) OVER () n FROM tree WHERE n = 1),
  crown(level, i, node, n) AS (SELECT 0::BIGINT, i, node, n FROM tops
    UNION ALL SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, i // 2, n),
  heights AS (SELECT lang, max(level) h FROM tree GROUP BY 1), steps0 AS (
    SELECT p.r, l.level step, (p.i >> l.level) & 1 = 1 is_right, s.node sibling FROM placed p JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
      LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.i = xor(p.i >> l.level, 1)
    UNION ALL SELECT p.r, 1000 + l.level, (t.i >> l.level) & 1 = 1, s.node FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang, (SELECT DISTINCT level FROM crown WHERE n > 1) l
      LEFT JOIN crown s ON s.level = l.level AND s.i = xor(t.i >> l.level, 1)),
  steps AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) k FROM steps0),
  proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) proof FROM steps GROUP BY 1),
  fold(r, k, node) AS (SELECT r, 0::BIGINT, told FROM placed
    UNION ALL SELECT fold.r, steps.k, sha256(CASE WHEN is_right THEN sibling || node ELSE node || coalesce(sibling, '') END) FROM fold JOIN steps ON steps.r = fold.r AND steps.k = fold.k + 1),
  ends AS (SELECT r, arg_max(node, k) node FROM fold GROUP BY 1)
SELECT doc_id, leaf, tops.node subroot, crown.node root, coalesce(proof, sha256('')) proof_sha256, ends.node folded_root, ends.node = crown.node verified
FROM placed p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang JOIN crown ON crown.n = 1 JOIN ends USING (r) LEFT JOIN proofs USING (r)"""
