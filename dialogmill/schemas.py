"""Canonical schemas of sessions and events; times are epoch milliseconds in UTC."""

TOKENS = "struct<`in`:bigint,out:bigint,reasoning:bigint,cacheRead:bigint,cacheWrite:bigint>"
CALLS = "array<struct<tool:string,cmd:string,exitCode:int,rawRef:string>>"
SESSIONS = f"schemaVersion int, source string, id string, title string, directory string, repo string, tsCreated bigint, tsUpdated bigint, cost double, tokens {TOKENS}, parentSession string"
EVENTS = f"schemaVersion int, source string, id string, sessionId string, ts bigint, role string, text string, model struct<providerID:string,modelID:string>, agent string, repo string, tokens {TOKENS}, cost double, toolCalls {CALLS}"
RAW_OUTPUTS = "part_id string, content string, source string"
