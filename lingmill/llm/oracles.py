"""SQL of the training-data queries that SQL can express, for DuckDB."""

from .common import UPPER

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+')"

#: Nodes and symmetric edges to the smallest node reachable.
_REACH = "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"

MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i : array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 nodes AS (SELECT doc_id AS id FROM documents), edges AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_REACH}
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

GRAPH_DEDUP = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
 nodes AS (SELECT vec_id AS id FROM v), {_REACH}, n AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
 SELECT comp.id AS vec_id, coalesce(n, 0) AS n_links, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN n ON n.id = comp.id"""

_ESCAPED = r"replace(replace({c}, '\', '\e'), '<', '\l')"
_ROLE = r"replace(replace(" + _ESCAPED.format(c="role") + r", '>', '\g'), chr(10), '\n')"

#: budget 1024: half of it for the span, a quarter for history; spans by running sums.
CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 k AS (SELECT *, ceil(length(text) / 4.0)::BIGINT + 4 AS tokens, 6 + length({_ROLE}) + 2 + length({_ESCAPED.format(c='text')}) + 8 AS chars FROM t),
 o AS (SELECT *, row_number() OVER q AS pos, sum((tokens > 256)::INT) OVER q AS longs, sum(CASE WHEN tokens > 256 THEN 0 ELSE tokens END) OVER q AS sums FROM k WINDOW q AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, 2 * longs - (tokens > 256)::INT AS blk, floor((sums - CASE WHEN tokens > 256 THEN 0 ELSE tokens END) / 256) AS stretch FROM o),
 w AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY blk, stretch) AS win FROM b),
 e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, win ORDER BY pos DESC) AS from_end, sum(tokens) OVER (PARTITION BY conv_id, win ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - tokens AS after FROM w),
 c AS (SELECT conv_id, max(win) AS wins, max(CASE WHEN pos = 1 AND role = 'system' THEN chars ELSE 0 END) AS system_chars FROM w GROUP BY conv_id),
 h AS (SELECT e.conv_id, sum(chars) AS chars FROM e JOIN c USING (conv_id) WHERE win < wins AND from_end <= 2 AND after + tokens <= 256 AND NOT (pos = 1 AND role = 'system') GROUP BY e.conv_id)
 SELECT w.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 (sum(w.chars) + max((wins - 1) * system_chars) + max(coalesce(h.chars, 0)))::BIGINT AS formatted_chars
 FROM w JOIN c USING (conv_id) LEFT JOIN h USING (conv_id) GROUP BY w.conv_id"""

ANN = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT x.vec_id AS query_id, y.vec_id, sqrt(list_sum(list_transform(list_zip(x.e, y.e), lambda z : (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM v x JOIN v y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id)
 SELECT query_id, rn::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rn FROM s) WHERE rn <= 10"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT x.vec_id AS query_id, y.vec_id, list_sum(list_transform(list_zip(x.e, y.e), lambda z : z[1] * z[2]))::BIGINT AS score FROM v x JOIN v y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id)
 SELECT query_id, rn::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10"""

ORACLES = {"op2_chat": CHAT, "op5_minhash": MINHASH, "op8_ann": ANN, "op9_graph_dedup": GRAPH_DEDUP, "op11_topk": TOPK}
