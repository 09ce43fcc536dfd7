"""SQL of the corpus operators whose whole results it can say."""

from __future__ import annotations

from terrakern.llm.chat import KINDS, REFERENCE
from terrakern.llm.checks import _CRC
from terrakern.llm.common import WORD

_CONV_CRC = _CRC.replace("doc_id", "conv_id").replace("documents", "conversations")

TRIE = f"""WITH RECURSIVE {_CONV_CRC}, own AS (SELECT conv_id AS c, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS d, {{'r': COALESCE(role, ''), 't': COALESCE(text, '')}} AS k FROM conversations),
 h AS (SELECT crc_id AS c, c % 4 AS h FROM crc), lent AS (SELECT h.c, own.d, own.k FROM h JOIN own ON own.c = h.c - h.c % 20 AND own.d <= h.h), many AS (SELECT c, COUNT(*) AS n FROM lent GROUP BY c),
 turns AS (SELECT * FROM lent UNION ALL SELECT own.c, own.d - h.h + COALESCE(n, 0), own.k FROM own JOIN h ON h.c = own.c AND own.d > h.h LEFT JOIN many ON many.c = own.c),
 told AS (SELECT c, d, k, sha256(CAST(list(k) OVER (PARTITION BY c ORDER BY d) AS VARCHAR)) AS s FROM turns),
 path AS (SELECT c, 0 AS d, '' AS s, CAST(NULL AS VARCHAR) AS up, 0 AS words FROM h UNION ALL SELECT c, d, s, COALESCE(LAG(s) OVER (PARTITION BY c ORDER BY d), ''), len(regexp_extract_all(k.t, '{WORD}')) FROM told),
 last AS (SELECT c, MAX(d) AS n FROM path GROUP BY c),
 node AS (SELECT d, s, MIN(up) AS up, MIN(p.c) AS c, COUNT(*) AS n, MIN(words) AS words, sha256(COALESCE(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE last.n = d), '')) AS ends FROM path p JOIN last ON last.c = p.c GROUP BY d, s),
 kids AS (SELECT d - 1 AS d, up AS s, COUNT(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2), owned AS (SELECT v.c, v.d, (v.n - 1) * v.words AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf FROM node v LEFT JOIN kids ON kids.d = v.d AND kids.s = v.s),
 sums AS (SELECT p.d, p.s, SUM(o.saved) AS saved, SUM(o.leaf) AS leaves FROM owned o JOIN path p ON p.c = o.c AND p.d <= o.d GROUP BY p.d, p.s)
 SELECT v.c AS conv_id, v.d AS depth, up.c AS parent_conv_id, v.n AS n_convs, COALESCE(kids.n, 0) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
 FROM node v JOIN sums ON sums.d = v.d AND sums.s = v.s LEFT JOIN kids ON kids.d = v.d AND kids.s = v.s LEFT JOIN node up ON up.d = v.d - 1 AND up.s = v.up"""

_REF = REFERENCE.replace("'", "''")
_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|\||/?INST\]|ATT )', '\1\2\\\3', 'g')"
_ROLE = r"regexp_replace(" + _ESC.format("r") + r", '\|(\\*)>', '|\1\\>', 'g')"
_ENDING = r"lower(regexp_extract(x, '\.([A-Za-z0-9]+)(?:#[0-9x.]+)?\)$', 1))"
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match({_ENDING}, '{endings}') THEN '{kind}'" for kind, endings in KINDS.items()) + " END"
_SIZE = "TRY_CAST(split_part(regexp_extract(x, '#([0-9x.]+)\\)$', 1), 'x', {}) AS DOUBLE)"
_ACROSS, _DOWN = (f"CASE WHEN {_SIZE.format(k)} > 0 THEN {_SIZE.format(k)} END" for k in (1, 2))
_TOKENS = f"CASE {_KIND} WHEN 'image' THEN ceil(COALESCE({_ACROSS}, 448) / 28) * ceil(COALESCE({_DOWN}, 448) / 28) WHEN 'audio' THEN ceil(COALESCE({_ACROSS}, 30) * 25) ELSE ceil(COALESCE({_ACROSS}, 1) * 1024) END"
CHAT = f"""WITH turns AS (SELECT conv_id, turn, COALESCE(role, '') AS r, COALESCE(text, '') AS t FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 seen AS (SELECT *, list_transform(string_split_regex(t, '{_REF}'), lambda x: len({_ESC.format("x")})) AS plain, regexp_extract_all(t, '{_REF}') AS refs FROM turns),
 sized AS (SELECT *, len({_ROLE}) + 4 + CASE WHEN r = 'assistant' THEN 4 ELSE 15 END + list_sum(plain) + COALESCE(list_sum(list_transform(refs, lambda x: len({_KIND}) + 6)), 0) AS chars, COALESCE(list_sum(list_transform(refs, lambda x: {_TOKENS})), 0) AS tokens FROM seen),
 whole AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t) AS said, COALESCE(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '') AS loss,
 SUM(chars) + 3 AS chars, SUM(len(refs)) AS refs, SUM(tokens) AS tokens FROM sized GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(refs AS BIGINT) AS n_attachments, CAST(tokens AS BIGINT) AS attachment_tokens FROM whole"""

ORACLE_SQL = {"op11_trie": TRIE, "op13_chat": CHAT}
