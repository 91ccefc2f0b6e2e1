"""The stream over growing session files gives the batch job's events after each trigger, also after a restart."""

import json
import random

from dialogmill.sources import archive, jsonl
from dialogmill.streaming.sessions import stream_sessions


def entry(i, message):
    return json.dumps({"type": "message", "id": i, "timestamp": "2026-06-10T10:00:00Z", "message": message})


def session(rng, name):
    """Lines of a session with calls, results that come late or never, and shell runs."""
    lines = [json.dumps({"type": "session", "version": 3, "id": name, "timestamp": "2026-06-10T10:00:00Z", "cwd": f"/root/{name}"})]
    calls = []
    for i in range(rng.randrange(5, 40)):
        kind = rng.randrange(5)
        if kind == 0:
            lines.append(entry(f"u{i}", {"role": "user", "timestamp": i, "content": [{"type": "text", "text": f"ask {i} é"}]}))
        elif kind == 1:
            made = [f"c{i}.{k}" for k in range(rng.randrange(1, 3))]
            calls += made
            content = [{"type": "text", "text": "ok"}] + [{"type": "toolCall", "id": c, "name": rng.choice(["bash", "bash", "read"]), "arguments": {"command": c}} for c in made]
            lines.append(entry(f"a{i}", {"role": "assistant", "timestamp": i, "content": content}))
        elif kind == 2 and calls:
            c = calls.pop(rng.randrange(len(calls)))
            lines.append(entry(f"r{i}", {"role": "toolResult", "toolCallId": c, "content": [{"type": "text", "text": f"out {c}"}]}))
        elif kind == 3:
            lines.append(entry(f"b{i}", {"role": "bashExecution", "command": "x", "output": f"shell {i}", "exitCode": i % 2}))
        else:
            lines.append(json.dumps({"type": "compaction", "id": f"k{i}", "timestamp": "2026-06-10T10:00:00Z"}))
    return "\n".join(lines) + "\n"


def shown(df):
    return sorted((r.id, r.sessionId, r.ts, r.role, r.text, r.repo, str(r.toolCalls)) for r in df.collect())


def test_stream_equals_the_batch_job(spark, tmp_path):
    rng = random.Random(8)
    folder, base = tmp_path / "in", str(tmp_path / "out")
    (folder / "deep").mkdir(parents=True)
    whole = {f"{'deep/' if i % 2 else ''}s{i}.jsonl": session(rng, f"s{i}").encode() for i in range(7)}
    cuts = {name: [0, *sorted(rng.randrange(len(data)) for _ in range(2)), len(data)] for name, data in whole.items()}
    for turn in range(3):  # cuts lie anywhere, also within a line or a character
        for i, (name, data) in enumerate(whole.items()):
            if turn or i < 4:
                (folder / name).write_bytes(data[: cuts[name][turn + 1]])
        stream_sessions(spark, str(folder), base, str(tmp_path / "cp"), size=500).awaitTermination()
        want = jsonl.events(jsonl.read_lines(spark, str(folder)))
        assert shown(archive.read_archive(spark, f"{base}/events")) == shown(want)
    # nothing new: nothing changes
    stream_sessions(spark, str(folder), base, str(tmp_path / "cp"), size=500).awaitTermination()
    assert shown(archive.read_archive(spark, f"{base}/events")) == shown(want) and len(shown(want)) > 20
