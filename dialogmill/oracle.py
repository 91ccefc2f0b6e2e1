"""DuckDB SQL for the registered archive queries, over the same bridge views.

Where a query works on records made for it, the SQL states what the rules must give for each kind of record, not how
the jobs come to it. What SQL can't see here: the bridge views are shared by both sides, and scores are compared at
nine decimals for their order and at six for their values.
"""

from __future__ import annotations

import hashlib

from dialogmill.operators import evaluate
from dialogmill.operators.textindex import STOPWORDS
from dialogmill.plans import bridge, records

_BASE = f"""docs AS ({bridge.DOCS}), events_ AS ({bridge.EVENTS}), sessions AS ({bridge.SESSIONS}), raw AS ({bridge.RAW}), calls AS ({bridge.CALLS_DUCKDB}), queries AS ({bridge.QUERIES}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS idx FROM docs WHERE role <> 'title')"""
_WORDS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS)))


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _search(queries: str = "queries", docs: str = "docs") -> str:
    """Common tables up to hits(qid, id, score)."""
    return f"""tok AS (SELECT id, 'text' AS col, unnest({_WORDS.format("text")}) AS term, unnest(range(len({_WORDS.format("text")}))) AS pos FROM {docs} UNION ALL SELECT id, 'cmd', unnest({_WORDS.format("cmd")}), unnest(range(len({_WORDS.format("cmd")}))) FROM {docs}),
dl AS (SELECT id, len({_WORDS.format("text")}) + len({_WORDS.format("cmd")}) AS dl FROM {docs}),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
q0 AS (SELECT qid, unnest(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}._-]*')) AS token, unnest(range(len(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}._-]*')))) AS phrase FROM {queries}),
q1 AS (SELECT qid, phrase, {_WORDS.format("token")} AS terms FROM q0 WHERE contains(token, '.') OR lower(token) NOT IN ({_STOP})),
q2 AS (SELECT qid, phrase, len(terms) AS n_terms, unnest(terms) AS term, unnest(range(len(terms))) AS place FROM q1),
m AS (SELECT qid, phrase, n_terms, id, col, pos - place AS start FROM q2 JOIN tok USING (term)),
w AS (SELECT qid, phrase, id, col, start FROM m GROUP BY qid, phrase, n_terms, id, col, start HAVING count(*) = n_terms),
tf AS (SELECT qid, phrase, id, count(*) AS tf FROM w GROUP BY qid, phrase, id),
n AS (SELECT qid, phrase, count(*) AS n FROM tf GROUP BY qid, phrase),
idf AS (SELECT qid, phrase, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf, avgdl FROM n, st),
hits AS (SELECT qid, id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY phrase) AS score FROM tf JOIN idf USING (qid, phrase) JOIN dl USING (id) GROUP BY qid, id),
top AS (SELECT * FROM (SELECT h.qid, h.score, row_number() OVER (PARTITION BY h.qid ORDER BY round(h.score, 9), h.id) AS rank, d.* FROM hits h JOIN {docs} d USING (id)) WHERE rank <= 10)"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([_BASE, *more]) + "\n" + body


_S = _search()
_AS_OF = "read_ AS (SELECT concat('r', s.id) AS req_id, n.session_id, n.idx, n.id, n.ts, n.ts <= (s.ts_created + 120000) // 60000 * 60000 AS visible FROM numbered n JOIN sessions s ON n.session_id = s.id)"
_OLD = "old AS (SELECT * REPLACE (CASE WHEN (ts // 60000) % 7 = 4 THEN concat(text, ' (old)') ELSE text END AS text) FROM docs WHERE (ts // 60000) % 7 <> 3), new AS (SELECT * FROM docs WHERE (ts // 60000) % 2 = 1)"
_UPSERTED = "ups AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new))"
_FINGERPRINT = """SELECT md5(string_agg(concat(p, ':', d), chr(10) ORDER BY concat(p, ':', d))) AS fingerprint FROM (SELECT p, md5(concat_ws(':', count(*), sum(a), sum(b), sum(c), sum(e))) AS d
 FROM (SELECT p, ('0x' || d[1:8])::BIGINT AS a, ('0x' || d[9:16])::BIGINT AS b, ('0x' || d[17:24])::BIGINT AS c, ('0x' || d[25:32])::BIGINT AS e FROM (SELECT substring(md5(id), 1, 2) AS p, md5(concat_ws(chr(31), {cols})) AS d FROM {rows})) GROUP BY p)""".replace("{cols}", ", ".join(f"coalesce('=' || {c}, '-')" for c in ("agent", "cmd", "id", "model", "repo", "role", "session_id", "source", "text", "ts")))
_TURNS = r"""tn AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, id) AS turn FROM docs WHERE role <> 'title'),
turns AS (SELECT session_id, turn::BIGINT AS turn, max(CASE WHEN role = 'user' THEN id END) AS id, max(CASE WHEN role = 'user' THEN ts END) AS ts, max(CASE WHEN role = 'user' THEN text END) AS question, max(repo) AS repo,
 count(CASE WHEN role = 'assistant' AND text <> '' THEN 1 END) AS answers, coalesce(string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN {trim} END, chr(10) || chr(10) ORDER BY ts, id), '') AS answer
 FROM tn WHERE turn > 0 GROUP BY session_id, turn HAVING id IS NOT NULL)""".replace("{trim}", _trim("text"))
# the same patterns; the edges of words are those of ASCII here
_ascii = lambda rx: rx.replace(evaluate._EDGE, r"\b").replace("'", "''")
_CONCRETE, _TRIVIAL, _ASKING = (_ascii(x) for x in (evaluate.CONCRETE, evaluate.TRIVIAL, evaluate.ASKING))


def _candidates(asking: str) -> str:
    return rf"""c0 AS (SELECT *, {_trim('question')} AS q, {_trim('answer')} AS a FROM turns WHERE session_id IN (SELECT id FROM sessions WHERE parent_session IS NULL)),
c1 AS (SELECT *, row_number() OVER (PARTITION BY substring(q, 1, 120) ORDER BY session_id, ts, id) AS n FROM c0 WHERE length(q) BETWEEN 25 AND 1200 AND length(a) >= 200
 AND NOT regexp_matches(q, '{_TRIVIAL}') AND regexp_matches(q, '{asking}')),
cands AS (SELECT session_id, id, ts, repo, q AS question, length(q) AS q_len, length(a) AS a_len, (CASE WHEN ends_with(q, '?') THEN 2 ELSE 0 END + 1 + CASE WHEN regexp_matches(q, '{_CONCRETE}') THEN 1 ELSE 0 END
 + CASE WHEN length(a) BETWEEN 400 AND 5000 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(a, '{_CONCRETE}') THEN 2 ELSE 0 END + CASE WHEN answers = 1 THEN 1 ELSE 0 END)::INT AS score FROM c1 WHERE n = 1)"""


_CANDS = _candidates(r"\?|(?i)(what|how|why|que|the|der|le)")
_NEAR = """sp AS (SELECT t.qid, t.rank, t.id AS for_ref, t.session_id, n.idx - 2 AS low, n.idx + 2 AS high, n.idx AS own FROM top t JOIN numbered n ON t.id = n.id AND t.session_id = n.session_id WHERE t.role <> 'title'
 UNION ALL SELECT t.qid, t.rank, t.id, t.session_id, b.k - 2, b.k + 1, -1 FROM top t, LATERAL (SELECT count(*) AS k FROM numbered n WHERE n.session_id = t.session_id AND (n.ts < t.ts OR (n.ts = t.ts AND n.id < t.id))) b WHERE t.role = 'title')"""

_BUNDLES = "bundles AS (SELECT concat(c.session_id, '-', c.ts // 3600000) AS id, c.tool, c.cmd, c.id AS ref, row_number() OVER (PARTITION BY c.session_id, c.ts // 3600000 ORDER BY c.id) - 1 AS call_index FROM calls c)"
_RECORDS = f"tr AS (SELECT *, role = 'assistant' AS a, concat('pi:u', conv_id) AS u, concat('c', conv_id) AS path FROM ({records.TURNS}))"
_CMD = "CASE form WHEN 0 THEN concat('run ', turn) WHEN 1 THEN concat('text ', turn) WHEN 2 THEN concat('pattern: p', turn) WHEN 3 THEN concat('filePath: f', turn) WHEN 4 THEN concat(substring(concat('{\"zeta\":\"', repeat('z', 300)), 1, 197), '...') WHEN 6 THEN concat('query: q', turn) END"
_HALVES = "concat_ws(chr(10) || chr(10), nullif(substring(text, 1, length(text) // 2), ''), nullif(substring(text, length(text) // 2 + 1), ''))"
#: What the rules give for the records of both sources.
_SOURCES = rf"""rel AS (SELECT id, session_id, ts, role, {_HALVES} AS text, CASE WHEN a THEN concat('p/m', conv_id % 5) END AS model, 'build' AS agent, CASE WHEN conv_id % 3 < 2 THEN concat('repo', conv_id % 20) END AS repo,
 CASE WHEN NOT a THEN 0 WHEN conv_id % 3 = 1 THEN 10 ELSE coalesce(length(text), 0) END AS tokens_in, CASE WHEN NOT a OR conv_id % 3 = 1 THEN 0 ELSE turn END AS tokens_out, CASE WHEN a AND conv_id % 3 = 1 THEN 4 ELSE 0 END AS tokens_cacheread, 0 AS tokens_cachewrite,
 CASE WHEN NOT a THEN 0::DOUBLE WHEN conv_id % 3 = 0 THEN 0.25::DOUBLE WHEN conv_id % 3 = 1 THEN 1.5::DOUBLE ELSE 1.75::DOUBLE END AS cost,
 CASE WHEN a THEN concat('bash|', coalesce({_CMD}, '-'), '|', turn % 3, '|', CASE WHEN conv_id % 4 = 3 THEN '-' ELSE concat(id, '-2') END) ELSE '' END AS calls, CASE WHEN a THEN coalesce({_CMD}, '') ELSE '' END AS cmd, 'opencode' AS source FROM tr WHERE role IN ('user', 'assistant')),
pi AS (SELECT concat(u, ':t', turn) AS id, u AS session_id, ts, role, text, CASE WHEN a THEN concat('p/m', conv_id % 5) END AS model, CAST(NULL AS VARCHAR) AS agent, concat('repo', conv_id % 20) AS repo,
 CASE WHEN a THEN coalesce(length(text), 0) ELSE 0 END AS tokens_in, CASE WHEN a THEN turn ELSE 0 END AS tokens_out, CASE WHEN a THEN 7 ELSE 0 END AS tokens_cacheread, CASE WHEN a THEN 6 ELSE 0 END AS tokens_cachewrite, CASE WHEN a THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS cost,
 CASE WHEN NOT a THEN '' ELSE concat('bash|run ', turn, '|', CASE WHEN kind = 'none' THEN '-' ELSE concat(turn % 2) END, '|', CASE kind WHEN 'none' THEN '-' WHEN 'shell' THEN concat(u, ':b', turn) ELSE concat(u, ':r', turn) END,
  CASE WHEN kind = 'two' THEN concat(';bash|also ', turn, '|', turn % 2, '|', u, ':b', turn) ELSE '' END) END AS calls, CASE WHEN NOT a THEN '' WHEN kind = 'two' THEN concat('run ', turn, chr(10), 'also ', turn) ELSE concat('run ', turn) END AS cmd, 'pi' AS source FROM tr WHERE role IN ('user', 'assistant')),
merged AS (SELECT * FROM rel UNION ALL SELECT * FROM pi),
rel_s AS (SELECT session_id AS id, CASE WHEN conv_id % 6 = 0 THEN '' ELSE concat('Session ', conv_id) END AS title, CASE WHEN conv_id % 3 < 2 THEN concat('repo', conv_id % 20) END AS repo, min(ts) AS ts_created, max(ts) AS ts_updated, CASE WHEN conv_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS cost,
 conv_id AS tokens_in, 0 AS tokens_out, CASE WHEN conv_id % 10 = 9 THEN concat('s', lpad(cast(conv_id - 1 AS STRING), 6, '0')) END AS "parentSession" FROM tr GROUP BY session_id, conv_id),
pi_s AS (SELECT u AS id, CASE WHEN conv_id % 3 = 1 THEN concat('Named ', conv_id) ELSE nullif(substring(split_part(arg_min({_trim("text")}, turn) FILTER (role = 'user' AND {_trim("text")} <> ''), chr(10), 1), 1, 60), '') END AS title, concat('repo', conv_id % 20) AS repo, min(ts) AS ts_created,
 CASE WHEN conv_id % 3 = 1 THEN min(ts) ELSE max(ts) END AS ts_updated, sum(CASE WHEN a THEN 0.25::DOUBLE ELSE 0::DOUBLE END) AS cost, sum(CASE WHEN a THEN length(text) ELSE 0 END)::BIGINT AS tokens_in, sum(CASE WHEN a THEN turn ELSE 0 END)::BIGINT AS tokens_out, CAST(NULL AS VARCHAR) AS "parentSession" FROM tr GROUP BY u, conv_id),
rel_o AS (SELECT concat(id, '-2') AS part_id, concat(CASE WHEN conv_id % 4 = 2 THEN 'raw ' ELSE 'out ' END, turn) AS content FROM tr WHERE a AND conv_id % 4 <> 3),
pi_o AS (SELECT concat(u, ':r', turn) AS part_id, concat('out ', turn) AS content, false AS orphan FROM tr WHERE a AND kind IN ('two', 'result') UNION ALL SELECT concat(u, ':b', turn), concat('shell ', turn), false FROM tr WHERE a AND kind IN ('two', 'shell')
 UNION ALL SELECT concat(u, ':o', turn), concat('out ', turn), true FROM tr WHERE a AND conv_id % 5 = 0 UNION ALL SELECT concat(u, ':x', turn), concat('shell ', turn), true FROM tr WHERE a AND conv_id % 6 = 5 AND kind <> 'none'),
refs AS (SELECT concat(id, '-2') AS raw_ref, id AS event_id, session_id, ts, role, 'bash' AS tool, {_CMD} AS cmd FROM tr WHERE a AND conv_id % 4 <> 3 UNION ALL SELECT concat(u, ':r', turn), concat(u, ':t', turn), u, ts, role, 'bash', concat('run ', turn) FROM tr WHERE a AND kind IN ('two', 'result')
 UNION ALL SELECT concat(u, ':b', turn), concat(u, ':t', turn), u, ts, role, 'bash', concat(CASE WHEN kind = 'two' THEN 'also ' ELSE 'run ' END, turn) FROM tr WHERE a AND kind IN ('two', 'shell')),
sdocs AS (SELECT id, session_id, ts, role, agent, repo, model, cmd, coalesce(text, '') AS text, source FROM merged UNION ALL SELECT id, id, ts_created, 'title', NULL, repo, NULL, '', title, 'opencode' FROM rel_s WHERE title <> '' UNION ALL SELECT id, id, ts_created, 'title', NULL, repo, NULL, '', title, 'pi' FROM pi_s WHERE title <> ''),
ignored AS (SELECT 'type:compaction' AS kind, count(*) AS n FROM tr WHERE conv_id % 8 = 0 HAVING n > 0 UNION ALL SELECT 'role:custom', count(*) AS n FROM tr WHERE conv_id % 8 = 0 HAVING n > 0 UNION ALL SELECT concat('role:', role), count(*) FROM tr WHERE role NOT IN ('user', 'assistant') GROUP BY role),
orphans AS (SELECT path, 10 * turn + 5 AS line_no, concat(u, ':o', turn) AS id, 'result' AS kind, concat('out ', turn) AS output FROM tr WHERE a AND conv_id % 5 = 0 UNION ALL SELECT path, 10 * turn + 6, concat(u, ':x', turn), 'bash', concat('shell ', turn) FROM tr WHERE a AND conv_id % 6 = 5 AND kind <> 'none')"""
_EVENT_COLUMNS = "id, session_id, ts, role, md5(coalesce(text, '')) AS md5, model, agent, repo, tokens_in, tokens_out, tokens_cacheread, tokens_cachewrite, cost, calls"
_SESSION_COLUMNS = 'id, title, repo, ts_created, ts_updated, cost, tokens_in, tokens_out, "parentSession"'
_NEIGHBORS = "near AS (SELECT qid, session_id, id, ts, for_ref FROM (SELECT sp.qid, n.session_id, n.id, n.ts, sp.for_ref, row_number() OVER (PARTITION BY sp.qid, n.session_id, n.id ORDER BY sp.rank) AS k FROM sp JOIN numbered n ON n.session_id = sp.session_id AND n.idx BETWEEN sp.low AND sp.high AND n.idx <> sp.own) WHERE k = 1)"
#: Requests of all reading modes; each session's first message has the time of the anchor.
_READ = """ends AS (SELECT session_id, count(*) AS n, min(ts) AS first_ts, count(CASE WHEN ts <= first_ts THEN 1 END) AS seen FROM (SELECT *, min(ts) OVER (PARTITION BY session_id) AS first_ts FROM numbered) GROUP BY session_id, first_ts),
heads AS (SELECT concat('whole-', session_id) AS req_id, session_id, 'ok' AS status, 'all' AS mode, n AS total, n AS visible, 0 AS masked, NULL AS warning, 0 AS low, n - 1 AS high FROM ends
 UNION ALL SELECT concat('around-', session_id), session_id, 'ok', 'around', n, n, 0, NULL, 0, least(n - 1, 1) + 1 FROM ends UNION ALL SELECT concat('unknown-', session_id), session_id, 'ok', 'all', n, n, 0, 'unknown message', 0, n - 1 FROM ends
 UNION ALL SELECT concat('tail-', session_id), session_id, 'ok', CASE WHEN n > 2 THEN 'tail' ELSE 'all' END, n, n, 0, NULL, n - 2, n - 1 FROM ends UNION ALL SELECT concat('tail-at-', session_id), session_id, 'ok', CASE WHEN seen > 1 THEN 'tail' ELSE 'all' END, n, seen, n - seen, NULL, seen - 1, seen - 1 FROM ends
 UNION ALL SELECT concat('masked-', session_id), session_id, 'ok', 'around', n, seen, n - seen, CASE WHEN seen < n THEN 'message after the anchor' END, n - 2, seen - 1 FROM ends UNION ALL SELECT concat('bad-', session_id), session_id, 'invalid', 'all', NULL, NULL, NULL, NULL, 0, -1 FROM ends)"""
_READ = _READ.replace("n - 2, seen - 1 FROM ends UNION ALL SELECT concat('bad-'", "CASE WHEN seen < n THEN 1 ELSE n - 2 END, CASE WHEN seen < n THEN 0 ELSE n - 1 END FROM ends UNION ALL SELECT concat('bad-'")
_SAMPLE = """s0 AS (SELECT *, md5(concat('7:', id)) AS draw FROM cands WHERE score >= 2), s1 AS (SELECT *, row_number() OVER (PARTITION BY coalesce(repo, '(global)') ORDER BY draw, id) AS k FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY draw, id) AS place FROM s1 WHERE k <= 5), sample AS (SELECT *, concat('q', lpad(cast(place AS STRING), 3, '0')) AS qid, place % 11 AS fault FROM s2 WHERE place <= 90)"""
_EVEN = r"regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), ' ([?!;:,.])', '\1', 'g'), '^\s+|\s+$', '', 'g')"
_FORMS = """CASE form WHEN 0 THEN 'cat notes.md | sqlite3 my.db' WHEN 1 THEN 'echo "see the sqlite tables now" && ls' WHEN 2 THEN 'eval $CMD' WHEN 3 THEN 'sudo env A=1 archivist refresh' WHEN 4 THEN 'archivist search "events.jsonl"' WHEN 5 THEN 'archivist read s1 < data/events.jsonl'
 WHEN 6 THEN 'archivist --corpus /tmp/x read s1' WHEN 7 THEN 'for q in a b; do archivist "$q"; done' WHEN 8 THEN 'cat eval/questions.jsonl' WHEN 9 THEN 'archivist search proxy questions.jsonl' WHEN 10 THEN 'grep archivist sessions.jsonl' END"""
#: What an audit must find in each form of a command.
_AUDIT = f"""commands AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS call_index, {_FORMS} AS command, form, turn FROM ({records.COMMANDS})),
expected(form, pattern, invalidating) AS (VALUES (0, 'sql-shell', false), (3, 'change', false), (4, 'raw-lines', false), (5, 'raw-lines', false), (8, 'answers', true), (10, 'raw-lines', false)),
doubts(form, reason) AS (VALUES (2, 'dynamic command'), (6, 'option with a path'), (7, 'variable subcommand')), deviations AS (SELECT id, call_index, pattern, invalidating FROM commands JOIN expected USING (form))"""
#: The same for the whole list of patterns.
_WHOLE_AUDIT = f"""{_AUDIT},
met(form, pattern, invalidating) AS (VALUES (0, 'database-shell', false), (3, 'change', false), (4, 'event-log', false), (5, 'event-log', false), (8, 'test-set', true), (10, 'session-log', false)),
found AS (SELECT id, call_index, pattern, invalidating FROM commands JOIN met USING (form))"""
_MARK = hashlib.sha256("\n".join(f"{n}:{rx}:{bad}" for n, rx, bad in records.WHOLE_AUDIT).encode()).hexdigest()[:16]
_DAY = "ts_created // 86400000"
_SNIPPETS = """sw AS (SELECT qid, id, string_split_regex({trim}, '\\s+') AS words FROM top),
su AS (SELECT qid, id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM sw),
sh AS (SELECT DISTINCT su.qid, su.id, su.pos, q2.term FROM su JOIN q2 ON q2.qid = su.qid AND list_contains({words}, q2.term)),
ss AS (SELECT qid, id, words, unnest(range(1, greatest(len(words) - 13, 1) + 1)) AS i FROM sw),
sc AS (SELECT ss.qid, ss.id, ss.i, count(DISTINCT term) AS n FROM ss LEFT JOIN sh ON sh.qid = ss.qid AND sh.id = ss.id AND sh.pos BETWEEN ss.i AND ss.i + 13 GROUP BY ss.qid, ss.id, ss.i),
sb AS (SELECT qid, id, i, row_number() OVER (PARTITION BY qid, id ORDER BY n DESC, i) AS k FROM sc)""".format(words=_WORDS.format("su.word"), trim=_trim("coalesce(text, '')"))

SQL = {
    "hit_snippets": _sql("""SELECT b.qid, b.id, concat(CASE WHEN i > 1 THEN '...' ELSE '' END, array_to_string(words[i:i + 13], ' '), CASE WHEN i + 14 <= len(words) THEN '...' ELSE '' END) AS snippet, concat(CASE WHEN i > 1 THEN '...' ELSE '' END, marked, CASE WHEN i + 14 <= len(words) THEN '...' ELSE '' END) AS marked
 FROM sb b JOIN sw USING (qid, id) JOIN (SELECT b.qid, b.id, string_agg(CASE WHEN h.pos IS NULL THEN su.word ELSE concat('[', su.word, ']') END, ' ' ORDER BY su.pos) AS marked FROM sb b JOIN su ON su.qid = b.qid AND su.id = b.id AND su.pos BETWEEN b.i AND b.i + 13
 LEFT JOIN (SELECT DISTINCT qid, id, pos FROM sh) h ON h.qid = su.qid AND h.id = su.id AND h.pos = su.pos WHERE b.k = 1 GROUP BY b.qid, b.id) m USING (qid, id) WHERE b.k = 1""", _S, _SNIPPETS),
    "relational_events": _sql(f"SELECT {_EVENT_COLUMNS} FROM rel", _RECORDS, _SOURCES),
    "relational_sessions": _sql(f"SELECT {_SESSION_COLUMNS} FROM rel_s", _RECORDS, _SOURCES),
    "relational_outputs": _sql("SELECT * FROM rel_o", _RECORDS, _SOURCES),
    "source_delta": _sql("SELECT id, CASE WHEN a THEN 4 ELSE 2 END AS n FROM tr WHERE ts > 1767225600000 + 2592000000 UNION ALL SELECT session_id, 0 FROM tr GROUP BY session_id HAVING max(ts) >= 1767225600000 + 2592000000", _RECORDS),
    "line_events": _sql(f"SELECT {_EVENT_COLUMNS} FROM pi", _RECORDS, _SOURCES),
    "line_sessions": _sql(f"SELECT {_SESSION_COLUMNS} FROM pi_s", _RECORDS, _SOURCES),
    "line_orphans": _sql("SELECT * FROM orphans", _RECORDS, _SOURCES),
    "line_unproved": _sql("SELECT path, count(*) AS n FROM tr WHERE a AND kind = 'none' GROUP BY path", _RECORDS),
    "line_ignored": _sql("SELECT * FROM ignored", _RECORDS, _SOURCES),
    "line_outputs": _sql("SELECT * FROM pi_o", _RECORDS, _SOURCES),
    "line_problems": _sql("""SELECT DISTINCT path, 1 AS line_no, CASE WHEN conv_id % 10 = 3 THEN 'no JSON' ELSE 'no session header' END AS problem FROM tr WHERE conv_id % 10 IN (3, 4) UNION ALL SELECT path, 10 * turn + 2, 'unsafe id' FROM tr WHERE conv_id % 10 = 5
 UNION ALL SELECT path, 10 * turn + 9, 'id used twice' FROM tr WHERE conv_id % 10 = 6 UNION ALL SELECT path, 10 * turn + 2, 'no time' FROM tr WHERE conv_id % 10 = 7 AND role IN ('user', 'assistant')""", _RECORDS),
    "changed_files": _sql(f"SELECT id AS path FROM sessions WHERE {_DAY} % 4 <> 3"),
    "file_state": _sql(f"SELECT id AS path, length(id) AS size, concat(CASE WHEN {_DAY} % 4 = 3 THEN 'u-' ELSE 'new-' END, id) AS uuid FROM sessions"),
    "shared_uuids": _sql("SELECT concat('u-', id) AS uuid, 2 AS files FROM sessions WHERE cast(substring(id, 2) AS BIGINT) % 5 = 0"),
    "search_docs": _sql("SELECT id, session_id, ts, role, agent, repo, model, cmd, md5(text) AS md5, source FROM sdocs", _RECORDS, _SOURCES),
    "archive_passes": _sql(f"SELECT {_EVENT_COLUMNS} FROM merged", _RECORDS, _SOURCES),
    "rebuild_equals_passes": _sql("SELECT count(*) AS rows, true AS equal FROM merged", _RECORDS, _SOURCES),
    "session_passes": _sql(f"SELECT {_SESSION_COLUMNS} FROM rel_s UNION ALL SELECT {_SESSION_COLUMNS} FROM pi_s", _RECORDS, _SOURCES),
    "raw_passes": _sql("SELECT part_id, md5(CASE WHEN cast(substring(part_id, 2) AS BIGINT) % 3 = 1 THEN concat(content, '+') ELSE content END) AS md5, source FROM raw"),
    "migrated": _sql("SELECT (SELECT count(*) FROM pi) AS events_before, (SELECT count(*) FROM pi) AS events_after, (SELECT count(*) FROM sessions WHERE ts_created % 11 = 0) AS bad_lines, (SELECT count(*) FROM rel_s) + (SELECT count(*) FROM pi_s WHERE id NOT IN (SELECT session_id FROM pi)) AS empty_sessions, true AS coherent", _RECORDS, _SOURCES),
    "title_upkeep": _sql("SELECT id, id AS session_id, ts_created AS ts, CASE WHEN cast(substring(id, 2) AS BIGINT) % 3 = 0 THEN concat('New ', id) ELSE title END AS text, source FROM sessions WHERE cast(substring(id, 2) AS BIGINT) % 3 = 0 OR (cast(substring(id, 2) AS BIGINT) % 3 = 2 AND title <> '')"),
    "rawrefs": _sql("SELECT * FROM refs", _RECORDS, _SOURCES),
    "rawref_upkeep": _sql("SELECT raw_ref, event_id, cmd FROM refs WHERE event_id NOT IN (SELECT id FROM rel WHERE (ts // 60000) % 4 = 1) UNION ALL SELECT concat('new-', id), id, 'c' FROM rel WHERE (ts // 60000) % 4 = 1", _RECORDS, _SOURCES),
    "raw_scan_refs": _sql(f"""SELECT nid, part_id, 1 AS line_no, content AS line, family FROM (SELECT *, row_number() OVER (PARTITION BY family, nid ORDER BY ts, part_id) AS k FROM (SELECT id AS nid, ['out 1', 'shell 1', 'raw 1'][({_DAY}) % 3 + 1] AS needle FROM sessions WHERE ts_created % 5 = 0)
 JOIN (SELECT o.*, ts FROM (SELECT part_id, content FROM rel_o UNION ALL SELECT part_id, content FROM pi_o) o JOIN refs ON raw_ref = part_id) ON contains(content, needle) JOIN (VALUES ('all'), ('pi')) f(family) ON family = 'all' OR starts_with(part_id, 'pi:')) WHERE k <= 3""", _RECORDS, _SOURCES),
    "raw_scan": _sql(rf"""SELECT nid, part_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY part_id) AS n, substring({_trim("string_split(content, chr(10))[line_no]")}, 1, 200) AS line FROM
 (SELECT nid, part_id, content, len(string_split(substring(lower(content), 1, instr(lower(content), needle)), chr(10))) AS line_no FROM (SELECT qid AS nid, lower(string_split(q, ' ')[2]) AS needle FROM queries) JOIN raw ON contains(lower(content), needle) WHERE needle <> '')) WHERE n <= 10"""),
    "filtered_search": _sql("""SELECT qid, rank, id, score FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS rank FROM hits JOIN docs USING (id)
 WHERE source = 'opencode' AND role = 'assistant' AND model ILIKE '%M_%' AND ts BETWEEN 1767225600000 AND 1767225600000 + 34560000000 AND agent = 'build') WHERE rank <= 10""", _S),
    "repo_search": _sql("SELECT qid, rank, id, score FROM (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), id) AS rank FROM hits JOIN docs USING (id) WHERE repo = 'repo4' AND role = 'title' AND starts_with(lower(session_id), 's0')) WHERE rank <= 10", _S),
    "unknown_source_search": _sql("SELECT id, ts FROM docs WHERE source = 'elsewhere' OR contains(session_id, '%')"),
    "command_hits": _sql(f"""SELECT qid, rank, id, round(score, 6) AS score, md5(substring(body, 1, 80)) AS md5, length(body) AS full_len, length(body) <= 80 AS "full",
 array_to_string(list_transform(string_split_regex(cmd, '\\s+'), lambda w: CASE WHEN list_has_any({_WORDS.format('w')}, asked) THEN concat('[', w, ']') ELSE w END), ' ') AS cmd_marked
 FROM (SELECT *, CASE WHEN text <> '' THEN text ELSE cmd END AS body FROM top WHERE rank <= 5) JOIN (SELECT qid, list(term) AS asked FROM q2 GROUP BY qid) USING (qid)""", _RECORDS, _SOURCES,
        f"asked AS (SELECT concat('c', id) AS qid, concat('run also-', ({_DAY}) % 9) AS q FROM sessions WHERE ts_created % 7 = 3)", _search("asked", "sdocs")),
    "no_terms": _sql("SELECT id AS qid, 'no_terms' AS problem FROM sessions UNION ALL SELECT qid, 'no_terms' FROM queries WHERE qid NOT IN (SELECT qid FROM q2)", _S),
    "neighbor_messages": _sql("SELECT * FROM near", _S, _NEAR, _NEIGHBORS),
    "hit_neighbor_groups": _sql("SELECT t.qid, t.session_id, coalesce(refs, '') AS neighbor_refs FROM (SELECT DISTINCT qid, session_id FROM top) t LEFT JOIN (SELECT qid, session_id, string_agg(id, ',' ORDER BY ts, id) AS refs FROM near WHERE (qid, id) NOT IN (SELECT (qid, id) FROM top) GROUP BY qid, session_id) r USING (qid, session_id)", _S, _NEAR, _NEIGHBORS),
    "index_build": _sql(f"SELECT id, len({_WORDS.format('text')}) AS dl, len(list_distinct({_WORDS.format('text')})) AS terms FROM docs"),
    "eval_topk": _sql("""SELECT count(*) AS questions, count(CASE WHEN best <= 1 THEN 1 END) AS top1, count(CASE WHEN best <= 3 THEN 1 END) AS top3, count(CASE WHEN best <= 5 THEN 1 END) AS top5
 FROM asked LEFT JOIN (SELECT qid, min(rank) AS best FROM top WHERE session_id = qid GROUP BY qid) USING (qid)""", "asked AS (SELECT session_id AS qid, text AS q FROM numbered WHERE idx = 0)", _search("asked")),
    "read_modes": _sql("SELECT req_id, n.session_id, idx, id, ts FROM heads h JOIN numbered n ON n.session_id = h.session_id AND idx BETWEEN low AND high AND idx >= 0", _READ),
    "read_headers": _sql("SELECT req_id, session_id, status, mode, total, visible, masked, warning FROM heads", _READ),
    "anchors": _sql("""SELECT req_id, status, CASE WHEN status = 'ok' THEN t END AS anchor_ts FROM (SELECT concat('own-', session_id) AS req_id, 'ok' AS status, arg_min(ts, id) AS t FROM events_ GROUP BY session_id UNION ALL SELECT concat('other-', s.session_id), CASE WHEN o.id IS NULL THEN 'invalid' WHEN o.session_id = s.session_id THEN 'ok' ELSE 'other_session' END, o.ts
 FROM (SELECT DISTINCT session_id FROM events_) s LEFT JOIN events_ o ON o.id = 'm000000-0001' UNION ALL SELECT concat(kind, '-', session_id), status, t FROM (SELECT DISTINCT session_id FROM events_), (VALUES ('digits', 'ok', 1767225600123), ('day', 'ok', epoch_ms(TIMESTAMP '2026-03-02 00:00:00') - 1),
 ('minute', 'ok', epoch_ms(TIMESTAMP '2026-03-01 10:30:00')), ('second', 'ok', epoch_ms(TIMESTAMP '2026-03-01 10:30:15')), ('no_day', 'invalid', 0), ('blank', 'empty', 0), ('word', 'invalid', 0)) k(kind, status, t) UNION ALL SELECT DISTINCT concat('lost-', session_id), 'not_found', 0 FROM events_)"""),
    "date_bounds": _sql(f"""SELECT id, form, text, epoch_ms(low) AS low, epoch_ms(high) - CASE WHEN form < 3 THEN 1 ELSE 0 END AS high FROM (SELECT id, form, CASE form WHEN 0 THEN printf('%04d', y) WHEN 1 THEN printf('%04d-%02d', y, m) WHEN 2 THEN printf('%04d-%02d-%02d', y, least(m, 12), d) ELSE printf('%04d-%02d-%02dT10:00:00Z', y, least(m, 12), d) END AS text,
 CASE form WHEN 0 THEN make_timestamp(y, 1, 1, 0, 0, 0) WHEN 1 THEN make_timestamp(y, 1, 1, 0, 0, 0) + to_months((m - 1)::INT) WHEN 2 THEN make_timestamp(y, least(m, 12), d, 0, 0, 0) ELSE make_timestamp(y, least(m, 12), d, 10, 0, 0) END AS low,
 CASE form WHEN 0 THEN make_timestamp(y + 1, 1, 1, 0, 0, 0) WHEN 1 THEN make_timestamp(y, 1, 1, 0, 0, 0) + to_months(m::INT) WHEN 2 THEN make_timestamp(y, least(m, 12), d, 0, 0, 0) + INTERVAL 1 DAY ELSE make_timestamp(y, least(m, 12), d, 10, 0, 0) END AS high
 FROM (SELECT id, 2000 + ({_DAY}) % 50 AS y, ({_DAY}) % 13 + 1 AS m, ({_DAY}) % 28 + 1 AS d FROM sessions), (VALUES (0), (1), (2), (3)) f(form))"""),
    "fidelity_flags": _sql("SELECT id, CASE WHEN source = 'pi' THEN 'branches are flattened by time; agents are unknown' END AS limits FROM docs"),
    "pass_summary": _sql("SELECT 'events' AS kind, status, count(*) AS n FROM (SELECT CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'added' WHEN o.text = n.text THEN 'unchanged' ELSE 'updated' END AS status FROM old o FULL JOIN new n ON o.id = n.id) GROUP BY status UNION ALL SELECT 'orphans', kind, count(*) FROM orphans GROUP BY kind UNION ALL SELECT 'ignored', kind, n FROM ignored", _OLD, _RECORDS, _SOURCES),
    "latest_version": _sql("SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 1 ELSE 2 END AS pass, md5(coalesce(n.text, o.text)) AS md5 FROM old o FULL JOIN new n ON o.id = n.id", _OLD),
    "advance_state": _sql("SELECT 'opencode' AS source, max(ts) + 1000000000000 AS watermark FROM old WHERE source = 'opencode' UNION ALL SELECT 'pi', max(ts) FROM docs WHERE source = 'pi'", _OLD),
    "archive_fingerprint": _sql(_FINGERPRINT.replace("{rows}", "docs")),
    "fingerprint_passes": _sql(_FINGERPRINT.replace("{rows}", "ups"), _OLD, _UPSERTED),
    "events_export": _sql("SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS \"index\", id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M') AS date, role, md5(coalesce(text, '')) AS md5, CASE WHEN calls = '' THEN 0 ELSE len(string_split(calls, ';')) END AS n_calls, calls FROM merged", _RECORDS, _SOURCES),
    "merged_model_costs": _sql("SELECT coalesce(split_part(model, '/', 2), '?') AS model, count(*) AS messages, round(sum(cost), 6) AS cost, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM merged GROUP BY 1", _RECORDS, _SOURCES),
    "written_summary": _sql("""SELECT * FROM (SELECT 'events' AS kind, CASE WHEN source = 'opencode' AND (ts // 60000) % 5 < 3 THEN 'updated' ELSE 'added' END AS status, count(*) AS n FROM merged GROUP BY 2
 UNION ALL SELECT 'sessions', CASE WHEN (ts_created // 86400000) % 3 = 0 THEN 'updated' ELSE 'added' END, count(*) FROM (SELECT ts_created FROM rel_s UNION ALL SELECT ts_created FROM pi_s) GROUP BY 2
 UNION ALL SELECT 'raw', CASE cast(substring(part_id, 2) AS BIGINT) % 3 WHEN 1 THEN 'updated' ELSE 'added' END, count(*) FROM raw WHERE cast(substring(part_id, 2) AS BIGINT) % 3 < 2 GROUP BY 2
 UNION ALL SELECT 'orphans', kind, count(*) FROM orphans GROUP BY kind UNION ALL SELECT 'ignored', kind, n FROM ignored) WHERE n > 0""", _RECORDS, _SOURCES),
    "merged_status": _sql("SELECT source, sessions, events, raw_refs, watermark FROM (SELECT source, count(*) AS events, max(ts) AS watermark FROM merged GROUP BY source) JOIN (SELECT 'opencode' AS source, count(*) AS sessions FROM rel_s UNION ALL SELECT 'pi', count(*) FROM pi_s) USING (source) JOIN (SELECT CASE WHEN starts_with(raw_ref, 'pi:') THEN 'pi' ELSE 'opencode' END AS source, count(*) AS raw_refs FROM refs GROUP BY 1) USING (source)", _RECORDS, _SOURCES),
    "part_profile": _sql("""SELECT 'tool' AS type, count(*) AS n, count(*) AS with_state, count(CASE WHEN conv_id % 4 < 2 THEN 1 END) AS with_output, count(*) AS with_exit, string_agg(DISTINCT keys, ';' ORDER BY keys) AS key_sets FROM (SELECT conv_id, array_to_string(list_sort(list_filter(['input', CASE WHEN conv_id % 4 < 2 THEN 'output' WHEN conv_id % 4 = 2 THEN 'raw' END,
 CASE conv_id % 5 WHEN 0 THEN 'metadata' WHEN 1 THEN 'metadata' WHEN 2 THEN 'exitCode' WHEN 3 THEN 'exit' END], lambda x: x IS NOT NULL)), ',') AS keys FROM tr WHERE a) UNION ALL SELECT 'step-finish', count(*), 0, 0, 0, '' FROM tr WHERE a UNION ALL SELECT 'text', 2 * count(*), 0, 0, 0, '' FROM tr""", _RECORDS),
    "role_counts": _sql("SELECT role, count(*) AS n FROM tr GROUP BY role", _RECORDS),
    "busy_messages": _sql("SELECT concat('busy-', conv_id % 50) AS message_id, count(*) AS calls FROM tr WHERE a AND conv_id % 3 = 0 GROUP BY 1 HAVING calls > 1 ORDER BY calls DESC, message_id LIMIT 5", _RECORDS),
    "default_turn_candidates": _sql("SELECT session_id, id, q_len, a_len, score FROM cands", _TURNS.replace("FROM docs", "FROM (SELECT * REPLACE (CASE WHEN role = 'user' AND (ts // 86400000) % 2 = 0 THEN concat(' Pourquoi', chr(9), text) ELSE text END AS text) FROM docs)"), _candidates(_ASKING)),
    "turn_sample": _sql("SELECT qid, id, repo FROM sample", _TURNS, _CANDS, _SAMPLE),
    "blind_export": _sql("SELECT row_number() OVER (ORDER BY md5(concat('3:', qid)), qid) AS place, qid, md5(question) AS md5 FROM sample", _TURNS, _CANDS, _SAMPLE),
    "question_problems": _sql(f"""SELECT concat(CASE WHEN fault = 9 THEN 'x' ELSE '' END, qid) AS qid, CASE fault WHEN 2 THEN 'rewritten from another beginning' WHEN 3 THEN 'fewer than two facts, or a blank one' WHEN 4 THEN 'fewer than two facts, or a blank one' WHEN 5 THEN 'unknown type' WHEN 6 THEN 'unknown specificity' WHEN 7 THEN 'self_contained is missing'
 WHEN 8 THEN 'too short' WHEN 9 THEN 'not in the sample' WHEN 10 THEN 'no such session' WHEN 1 THEN CASE WHEN contains(even, substring(asked, 1, 40)) THEN '' ELSE 'rewritten from another beginning' END ELSE '' END AS problems
 FROM (SELECT *, {_EVEN.format('question')} AS even, {_EVEN.format("concat(substring(question, 1, 60), ' in short?')")} AS asked FROM sample)""", _TURNS, _CANDS, _SAMPLE),
    "question_items": _sql("SELECT 'good' AS part, qid FROM sample WHERE fault = 0", _TURNS, _CANDS, _SAMPLE),
    "call_commands": _sql("SELECT id, call_index, command, CASE WHEN command IS NULL THEN 'unreadable' WHEN turn % 3 = 0 THEN 'field' WHEN turn % 3 = 1 THEN 'salvage' ELSE 'text' END AS origin FROM commands", _AUDIT),
    "audit_deviations": _sql("SELECT * FROM deviations", _AUDIT),
    "audit_review": _sql("SELECT id, call_index, reason FROM commands JOIN doubts USING (form)", _AUDIT),
    "audit_summary": _sql(f"SELECT pattern, count(*) AS calls, count(DISTINCT id) AS questions, max(invalidating) AS invalidating, '{_MARK}' AS patterns FROM found GROUP BY pattern", _WHOLE_AUDIT),
    "audit_status": _sql("SELECT count(DISTINCT id) AS scanned, count(*) AS calls, 0 AS unreadable, count(CASE WHEN form = 11 THEN 1 END) AS unanalysable, count(CASE WHEN form IN (0, 3, 4, 5, 8, 10) THEN 1 END) AS deviating, count(CASE WHEN form = 8 THEN 1 END) AS invalid, CASE WHEN count(CASE WHEN form = 11 THEN 1 END) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM commands", _AUDIT),
    "pattern_audit": _sql("SELECT pattern, count(DISTINCT part_id) AS n, count(DISTINCT part_id) AS questions, max(invalidating) AS invalidating FROM raw JOIN patterns ON contains(content, word) GROUP BY pattern",
        "patterns AS (SELECT * FROM (VALUES ('mit', 'MIT License', false), ('apache', 'Apache License', false), ('gpl', 'GNU General Public', true)) v(pattern, word, invalidating))"),
    "bm25_search": _sql("SELECT qid, rank, top.id, round(score, 6) AS score, session_id, s.title AS session_title FROM top LEFT JOIN sessions s ON s.id = session_id", _S),
    "call_chunks": _sql("SELECT id, call_index, tool, o AS \"offset\", o + length(substring(cmd, o + 1, 3)) AS \"end\", substring(cmd, o + 1, 3) AS part, length(cmd) <= 3 AS complete FROM (SELECT *, unnest(range(0, greatest(length(cmd), 1), 3)) AS o FROM bundles)", _BUNDLES),
    "calls_summary": _sql("SELECT id, count(*) AS n_calls, sum(length(cmd))::BIGINT AS cmd_chars, max(strlen(tool)) AS max_tool_bytes, max(strlen(ref)) AS max_ref_bytes FROM bundles GROUP BY id", _BUNDLES),
    "shown_texts": _sql("SELECT id, md5(shown) AS md5, length(shown) AS shown_len, length(text) AS total, length(shown) < length(text) AS cut FROM (SELECT id, coalesce(text, '') AS text, array_to_string(string_split(substring(coalesce(text, ''), 1, 400), chr(10))[1:4], chr(10)) AS shown FROM docs)"),
    "chrono_search": _sql("SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ts DESC, id DESC) AS rank, id, ts FROM hits JOIN docs USING (id)) WHERE rank <= 10", _S),
    "chrono_search_oldest": _sql("SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY ts, id) AS rank, id, ts FROM hits JOIN docs USING (id)) WHERE rank <= 10", _S),
    "chrono_browse_oldest": _sql("SELECT id, session_id, ts, role FROM docs WHERE role <> 'title' ORDER BY ts, id LIMIT 50"),
    "index_after_upsert": _sql("SELECT part, qid, rank, id, round(score, 6) AS score FROM top, (VALUES ('segments'), ('merged')) p(part)", _OLD, _UPSERTED, _search(docs="ups")),
    "index_lag": _sql("""SELECT coalesce(d.source, o.source) AS source, count(d.id) AS archive_rows, count(o.id) AS index_rows, 'before' AS part,
 CASE WHEN count(d.id) = count(o.id) AND count(CASE WHEN d.text = o.text THEN 1 END) = count(d.id) THEN 'equal' WHEN count(o.id) < count(d.id) THEN 'behind' WHEN count(o.id) > count(d.id) THEN 'ahead' ELSE 'differs' END AS state
 FROM ups d FULL JOIN old o ON d.id = o.id GROUP BY 1 UNION ALL SELECT source, count(*), count(*), 'after', 'equal' FROM ups GROUP BY source""", _OLD, _UPSERTED),
    "chrono_browse": _sql("SELECT id, session_id, ts, role FROM docs WHERE role <> 'title' ORDER BY ts DESC, id DESC LIMIT 50"),
    "hit_groups": _sql("SELECT qid, session_id, min(rank) AS best_rank, string_agg(id, ',' ORDER BY ts, id) AS hit_refs, count(*) AS n_hits FROM top GROUP BY qid, session_id", _S),
    "hit_excerpts": _sql("SELECT qid, id, substring(text, 1, 200) AS excerpt, length(substring(text, 1, 200)) AS excerpt_len, length(text) AS full_len, length(text) <= 200 AS \"full\" FROM top", _S),
    "hit_totals": _sql("SELECT qid, count(*) AS shown, CASE WHEN count(*) < 10 THEN count(*) END AS total, count(CASE WHEN role = 'assistant' AND model IS NULL THEN 1 END) AS missing_models FROM top GROUP BY qid", _S),
    "index_postings": _sql(f"SELECT term, count(DISTINCT id) AS docs, count(*) AS occurrences FROM (SELECT id, unnest({_WORDS.format('text')}) AS term FROM docs) GROUP BY term"),
    "raw_lookup": _sql("SELECT part_id, length(content) AS n_chars, md5(content) AS md5 FROM raw WHERE part_id IN (SELECT concat('d', lpad(cast(doc_id AS STRING), 6, '0')) FROM labels WHERE toxic = 1)"),
    "message_index": _sql("SELECT session_id, idx, id FROM numbered"),
    "read_as_of": _sql("SELECT * FROM read_", _AS_OF),
    "read_counters": _sql("SELECT req_id, session_id, count(*) AS total, count(CASE WHEN visible THEN 1 END) AS visible, count(CASE WHEN NOT visible THEN 1 END) AS masked FROM read_ GROUP BY req_id, session_id", _AS_OF),
    "read_sessions": _sql("SELECT concat('r', session_id) AS req_id, session_id, idx, id, ts FROM numbered WHERE idx <= 2"),
    "session_tail": _sql("SELECT * FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS back FROM numbered) WHERE back <= 3"),
    "keyset_page": _sql("SELECT id, ts, k > 20 AS has_more FROM (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY ts, id) AS n FROM docs WHERE role <> 'title' AND (ts, id) > (1767225600000 + 3 * 86400000, 'm000003-0002')) WHERE n <= 20"),
    "shown_windows": _sql("SELECT req_id, session_id, min(low) AS low, max(high) AS high FROM i2 GROUP BY req_id, session_id, island", _S,
        "i0 AS (SELECT qid AS req_id, t.session_id, greatest(n.idx - 1, 0) AS low, n.idx + 1 AS high FROM top t JOIN numbered n ON n.id = t.id WHERE t.role <> 'title')",
        "i1 AS (SELECT *, max(high) OVER (PARTITION BY req_id, session_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i0)",
        "i2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY req_id, session_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM i1)"),
    "gap_markers": _sql("""SELECT id, idx, idx > coalesce(lag(idx) OVER w, -1) + 1 AS gap_before, lead(idx) OVER w IS NULL AND idx < total - 1 AS gap_after
 FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS total FROM numbered) WHERE (ts // 60000) % 3 <> 1 WINDOW w AS (PARTITION BY session_id ORDER BY idx)"""),
    "text_chunks": _sql("SELECT id, o AS \"offset\", o + length(substring(text, o + 1, 400)) AS \"end\", substring(text, o + 1, 400) AS part, length(text) <= 400 AS complete FROM (SELECT id, text, unnest(range(0, greatest(length(text), 1), 400)) AS o FROM events_)"),
    "messages_export": _sql("SELECT session_id, idx AS \"index\", strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M') AS date, id, role, agent, model, text, cmd FROM numbered"),
    "upsert_events": _sql("SELECT id, ts, md5(text) AS md5 FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new))", _OLD),
    "upsert_status": _sql("SELECT status, count(*) AS n FROM (SELECT CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'added' WHEN o.text = n.text THEN 'unchanged' ELSE 'updated' END AS status FROM old o FULL JOIN new n ON o.id = n.id) GROUP BY status", _OLD),
    "table_lag": _sql("""SELECT source, a AS archive_rows, b AS index_rows, CASE WHEN a = b AND same = a THEN 'equal' WHEN b < a THEN 'behind' WHEN b > a THEN 'ahead' ELSE 'differs' END AS state
 FROM (SELECT coalesce(d.source, o.source) AS source, count(d.id) AS a, count(o.id) AS b, count(CASE WHEN d.text = o.text THEN 1 END) AS same FROM docs d FULL JOIN old o ON d.id = o.id GROUP BY 1)""", _OLD),
    "source_status": _sql("SELECT source, s.n AS sessions, e.n AS events, watermark FROM (SELECT source, count(*) AS n FROM sessions GROUP BY source) s FULL JOIN (SELECT source, count(*) AS n, max(ts) AS watermark FROM docs WHERE role <> 'title' GROUP BY source) e USING (source)"),
    "model_cost_summary": _sql("SELECT tool AS model, count(*) AS messages, round(sum(cost), 6) AS cost, sum(length(cmd))::BIGINT AS tokens_in, sum(length(id))::BIGINT AS tokens_out FROM calls GROUP BY tool"),
    "source_profile": _sql("SELECT tool, count(*) AS n, count(DISTINCT session_id) AS sessions, count(CASE WHEN cmd <> '' THEN 1 END) AS with_cmd FROM calls GROUP BY tool ORDER BY n DESC, tool LIMIT 12"),
    "turns": _sql("SELECT session_id, turn, id, answers, length(answer) AS answer_chars FROM turns", _TURNS),
    "turn_candidates": _sql("SELECT session_id, id, q_len, a_len, score FROM cands", _TURNS, _CANDS),
    "question_rollup": _sql("""SELECT 'repo' AS dimension, repo AS value, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT session_id) AS sessions FROM cands GROUP BY repo
 UNION ALL SELECT 'score', cast(score AS STRING), count(*), min(ts), max(ts), count(DISTINCT session_id) FROM cands GROUP BY score""", _TURNS, _CANDS),
}
