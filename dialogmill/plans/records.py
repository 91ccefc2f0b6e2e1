"""The given conversations as records of the two sources: all of them as relational rows, and all as session files.

The records vary by conversation and turn, so that each rule of the normalisers has rows: inputs of tools of all forms,
exit codes at all places, usage in messages and in steps, calls with results, shell runs, both or neither, lone
results and runs, names of sessions, and lines that are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.functions.columns import format_ts

#: The same text for Spark and DuckDB. form: that of a tool's input; kind: what follows a call in a session file.
TURNS = """SELECT conv_id, turn, role, text, concat('m', lpad(cast(conv_id AS STRING), 6, '0'), '-', lpad(cast(turn AS STRING), 4, '0')) AS id,
 concat('s', lpad(cast(conv_id AS STRING), 6, '0')) AS session_id, 1767225600000 + conv_id * 86400000 + turn * 60000 AS ts,
 concat('/root/repo', cast(conv_id % 20 AS STRING)) AS directory, (conv_id + turn) % 7 AS form,
 CASE WHEN conv_id % 4 = 1 THEN 'two' WHEN conv_id % 3 = 0 THEN 'shell' WHEN conv_id % 7 = 2 THEN 'none' ELSE 'result' END AS kind FROM conversations"""
_MODEL = "concat('m', cast(conv_id % 5 AS STRING))"


def _if_assistant(value: str) -> str:
    return f"CASE WHEN role = 'assistant' THEN {value} END"


def relational(see) -> tuple[DataFrame, DataFrame, DataFrame]:
    """session, message and part rows; a text comes in two parts, an assistant's message also has a call and a finished step."""
    turns = see(TURNS)
    session = turns.groupBy("conv_id", F.col("session_id").alias("id")).agg(F.min("directory").alias("directory"), F.min("ts").alias("time_created"), F.max("ts").alias("time_updated"))
    session = session.selectExpr(
        "id", "CASE WHEN conv_id % 10 = 9 THEN concat('s', lpad(cast(conv_id - 1 AS STRING), 6, '0')) END AS parent_id", "CASE conv_id % 3 WHEN 0 THEN directory WHEN 1 THEN concat(directory, '//') ELSE '/' END AS directory",
        "CASE WHEN conv_id % 6 = 0 THEN '' ELSE concat('Session ', conv_id) END AS title", "time_created", "time_updated", "CASE WHEN conv_id % 2 = 0 THEN 0.5D END AS cost", "conv_id AS tokens_input", "CAST(NULL AS BIGINT) AS tokens_output", "1 AS tokens_reasoning", "2 AS tokens_cache_read", "3 AS tokens_cache_write",
    )
    nested = f"to_json(named_struct('role', role, 'agent', 'build', 'model', {_if_assistant(f'''named_struct('providerID', 'p', 'modelID', {_MODEL})''')}))"
    flat = f"to_json(named_struct('role', role, 'agent', 'build', 'providerID', {_if_assistant(repr('p'))}, 'modelID', {_if_assistant(_MODEL)}, 'cost', {_if_assistant('1.5D')}, 'tokens', {_if_assistant('''named_struct('input', 10, 'cache', named_struct('read', 4))''')}))"
    costly = f"to_json(named_struct('role', role, 'agent', 'build', 'providerID', {_if_assistant(repr('p'))}, 'modelID', {_if_assistant(_MODEL)}, 'cost', {_if_assistant('1.5D')}))"
    message = turns.selectExpr("id", "session_id", "ts AS time_created", "ts AS time_updated", f"CASE conv_id % 3 WHEN 0 THEN {nested} WHEN 1 THEN {flat} ELSE {costly} END AS data")
    texts = [f"to_json(named_struct('type', 'text', 'text', {x}))" for x in ("substring(text, 1, cast(length(text) div 2 AS int))", "substring(text, cast(length(text) div 2 AS int) + 1)")]
    given = """CASE form WHEN 0 THEN to_json(named_struct('command', concat('run ', turn))) WHEN 1 THEN concat('"text ', turn, '"') WHEN 2 THEN to_json(named_struct('pattern', concat('p', turn), 'path', 'x'))
     WHEN 3 THEN to_json(named_struct('path', '', 'filePath', concat('f', turn))) WHEN 4 THEN to_json(named_struct('zeta', repeat('z', 300))) WHEN 5 THEN 'null' ELSE to_json(named_struct('command', '', 'query', concat('q', turn))) END"""
    code = "CASE WHEN turn % 2 = 0 THEN cast(turn % 3 AS STRING) ELSE concat('\"', turn % 3, '\"') END"
    state = f"""concat('"input":', {given}, CASE WHEN conv_id % 4 = 3 THEN '' WHEN conv_id % 4 = 2 THEN concat(',"raw":"raw ', turn, '"') ELSE concat(',"output":"out ', turn, '"') END)"""
    tool = f"""concat('{{"type":"tool","tool":"bash",', CASE conv_id % 5 WHEN 4 THEN concat('"exitCode":', {code}, ',"state":{{', {state}, '}}}}') WHEN 0 THEN concat('"state":{{', {state}, ',"metadata":{{"exitCode":', {code}, '}}}}}}')
     WHEN 1 THEN concat('"state":{{', {state}, ',"metadata":{{"exit":', {code}, '}}}}}}') WHEN 2 THEN concat('"state":{{', {state}, ',"exitCode":', {code}, '}}}}') ELSE concat('"state":{{', {state}, ',"exit":', {code}, '}}}}') END)"""
    step = "to_json(named_struct('type', 'step-finish', 'cost', 0.25D, 'tokens', named_struct('input', length(text), 'output', turn)))"
    rows = f"CASE WHEN role = 'assistant' THEN array({texts[0]}, {texts[1]}, {tool}, {step}, '{{broken') ELSE array({texts[0]}, {texts[1]}) END"
    part = turns.selectExpr("id AS message_id", "session_id", "ts AS time_updated", f"posexplode({rows}) AS (n, data)").selectExpr("concat(message_id, '-', n) AS id", "message_id", "session_id", "time_updated", "data")
    return session, message, part


def lines(see) -> DataFrame:
    """(path, line_no, line) of session files."""
    turns = see(TURNS).withColumns({"path": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "iso": F.concat(F.replace(format_ts(F.col("ts")), F.lit(" "), F.lit("T")), F.lit(":00Z"))})
    heads = turns.groupBy("path", "conv_id", "directory").agg(F.min("iso").alias("iso"))
    head = heads.selectExpr("path", "1 AS line_no", "to_json(named_struct('type', 'session', 'version', 3, 'id', concat('u', conv_id), 'timestamp', iso, 'cwd', directory)) AS line")
    names = heads.where("conv_id % 3 = 1").selectExpr("path", "explode(array(named_struct('n', 1000000, 'name', concat(' Named ', conv_id, ' ')), named_struct('n', 1000001, 'name', '  '))) AS x", "iso").selectExpr("path", "x.n AS line_no", "to_json(named_struct('type', 'session_info', 'timestamp', iso, 'name', x.name)) AS line")
    none = "CAST(NULL AS STRING)"
    text = f"named_struct('type', 'text', 'text', text, 'id', {none}, 'name', {none}, 'arguments', CAST(NULL AS STRUCT<command: STRING>))"
    call = lambda i, word: f"named_struct('type', 'toolCall', 'text', {none}, 'id', concat('{i}', turn), 'name', 'bash', 'arguments', named_struct('command', concat('{word} ', turn)))"
    usage = _if_assistant("named_struct('input', length(text), 'output', turn, 'cacheRead', 7, 'cache', named_struct('read', 5, 'write', 6), 'cost', named_struct('total', 0.25D))")
    content = f"CASE WHEN role <> 'assistant' THEN array({text}) WHEN kind = 'two' THEN array({text}, {call('k', 'run')}, {call('j', 'also')}) ELSE array({text}, {call('k', 'run')}) END"
    said = f"named_struct('role', role, 'content', {content}, 'timestamp', ts, 'provider', {_if_assistant(repr('p'))}, 'model', {_if_assistant(_MODEL)}, 'usage', {usage})"
    result = lambda i: f"named_struct('role', 'toolResult', 'toolCallId', concat('{i}', turn), 'content', array(named_struct('type', 'text', 'text', concat('out ', turn))), 'exitCode', turn % 2)"
    shell = "named_struct('role', 'bashExecution', 'command', concat('run ', turn), 'output', concat('shell ', turn), 'exitCode', turn % 2)"
    other = "named_struct('role', 'custom')"
    entry = lambda i, message: f"to_json(named_struct('type', 'message', 'id', concat('{i}', turn), 'timestamp', iso, 'message', {message}))"
    compaction = "to_json(named_struct('type', 'compaction', 'timestamp', iso))"
    slots = [
        (2, "true", entry("t", said)), (3, "role = 'assistant' AND kind IN ('two', 'shell')", entry("b", shell)), (4, "role = 'assistant' AND kind IN ('two', 'result')", entry("r", result("k"))), (5, "role = 'assistant' AND conv_id % 5 = 0", entry("o", result("none"))),
        (6, "role = 'assistant' AND conv_id % 6 = 5 AND kind <> 'none'", entry("x", shell)), (7, "conv_id % 8 = 0", compaction), (8, "conv_id % 8 = 0", entry("y", other)),
    ]
    found = head.unionByName(names)
    for slot, where, line in slots:
        found = found.unionByName(turns.where(where).selectExpr("path", f"cast(10 * turn + {slot} AS int) AS line_no", f"{line} AS line"))
    return found


#: What the made-up runs may not reach for: an example of a caller's own list.
AUDIT_PATTERNS = [("answers", r"\bquestions\.jsonl\b", True), ("raw-lines", r"\b(?:events|sessions)\.jsonl\b", False), ("sql-shell", r"(?<!['\"])\bsqlite3?\b", False)]
#: The whole list of a caller who tells the source's database, the index, any database, events, sessions, the archive's folder and the answers apart.
WHOLE_AUDIT = [
    ("source-database", r"(?i)\b(?:source|sessions?|history)\.(?:db|sqlite3?)\b", False), ("index-database", r"(?i)\bindex\.(?:db|sqlite3?)\b", False), ("database-shell", r"(?i)(?<!['\"])\bsqlite3?\b", False), ("event-log", r"(?i)\bevents\.jsonl", False),
    ("session-log", r"(?i)\bsessions\.jsonl", False), ("archive-folder", r"(?i)\barchive/(?:corpus|index|raw)\b", False), ("test-set", r"(?i)\bquestions\.(?:jsonl|md)\b|\bcurated\.json\b|\beval/", True),
]
#: Words and the command forms of a run of questions: what an audit must find in each (none, a pattern, or a row for review).
COMMANDS = """SELECT concat('r', lpad(cast(conv_id AS STRING), 6, '0')) AS id, turn, conv_id, (conv_id + turn) % 12 AS form FROM conversations WHERE role = 'assistant'"""


def responses(see) -> DataFrame:
    """(id, toolCalls) of exam responses, a call for each turn of an assistant, with inputs of all forms."""
    command = """CASE form WHEN 0 THEN 'cat notes.md | sqlite3 my.db' WHEN 1 THEN 'echo "see the sqlite tables now" && ls' WHEN 2 THEN 'eval $CMD' WHEN 3 THEN 'sudo env A=1 archivist refresh' WHEN 4 THEN 'archivist search "events.jsonl"'
     WHEN 5 THEN 'archivist read s1 < data/events.jsonl' WHEN 6 THEN 'archivist --corpus /tmp/x read s1' WHEN 7 THEN 'for q in a b; do archivist "$q"; done' WHEN 8 THEN 'cat eval/questions.jsonl' WHEN 9 THEN 'archivist search proxy questions.jsonl' WHEN 10 THEN 'grep archivist sessions.jsonl' ELSE '' END"""
    forms = f"""CASE turn % 3 WHEN 0 THEN to_json(named_struct('input', named_struct('command', {command}))) WHEN 1 THEN concat('{{"input": {{"cmd": "', replace({command}, '"', '\\\\"')) ELSE {command} END"""
    calls = see(COMMANDS).selectExpr("id", "turn", f"{forms} AS input")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "input"))), lambda c: F.struct(F.lit("bash").alias("tool"), c["input"].alias("input")))
    return calls.groupBy("id").agg(listed.alias("toolCalls"))
