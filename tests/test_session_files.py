"""Session files by byte ranges, and the matching of shell runs with calls, against plain versions."""

import random

import pytest

from dialogmill.sources import jsonl, ranges


def plain_lines(data: bytes):
    """Terminated lines and the byte after the last line end."""
    ack = data.rfind(b"\n") + 1
    return data[:ack].split(b"\n")[:-1], ack


def listing_of(spark, folder):
    return jsonl.discover(spark, str(folder))


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_ranges_equal_a_plain_reader(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(ranges, "READ", 5)
    files = {"a.jsonl": b"one\r\ntwo\n\n\nthree and more\nopen", "b.jsonl": b"no end", "c.jsonl": b"", "d.jsonl": "é😀\nü\n".encode(), "e 1+%20#é.jsonl": b"\n", "f.jsonl": b"x" * 50 + b"\n" + b"y" * 3}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    lines, state = ranges.new_lines(listing_of(spark, tmp_path), size=size)
    got = {}
    for r in lines.orderBy("path", "line_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line_no, r.line, r.begin))
    acks = {r.path.rsplit("/", 1)[1]: (r.ack, r.lines) for r in state.collect()}
    for name, data in files.items():
        want, ack = plain_lines(data)
        at = [sum(len(w) + 1 for w in want[:i]) for i in range(len(want))]
        assert got.get(name, []) == [(i + 1, w.decode(), b) for i, (w, b) in enumerate(zip(want, at))]
        assert acks.get(name, (0, 0)) == (ack, len(want))  # Spark lists no empty files


def test_a_pass_goes_on_after_the_ack(spark, tmp_path, monkeypatch):
    read = []
    grown, shrunk, gone = tmp_path / "grown.jsonl", tmp_path / "shrunk.jsonl", tmp_path / "gone.jsonl"
    grown.write_bytes(b"one\ntwo\nhal")
    shrunk.write_bytes(b"long enough\n")
    gone.write_bytes(b"x\n")
    state = ranges.new_lines(listing_of(spark, tmp_path), size=4)[1]
    grown.write_bytes(b"one\ntwo\nhalf\nfour\n")
    shrunk.write_bytes(b"new\n")
    gone.unlink()
    listing = listing_of(spark, tmp_path)
    read = ranges.byte_ranges(listing, state, 4).orderBy("path", "low").collect()
    assert [(r.path.rsplit("/", 1)[1], r.low) for r in read] == [("grown.jsonl", 8), ("grown.jsonl", 12), ("grown.jsonl", 16), ("shrunk.jsonl", 0)]
    lines, now = ranges.new_lines(listing, state, size=4)
    assert sorted((r.line_no, r.line) for r in lines.collect()) == [(1, "new"), (3, "half"), (4, "four")]
    assert sorted((r.ack, r.lines) for r in now.collect()) == [(4, 1), (18, 4)]
    # nothing new: no range at all
    assert ranges.byte_ranges(listing, now).count() == 0
    assert sorted((r.ack, r.lines) for r in ranges.new_lines(listing, now)[1].collect()) == [(4, 1), (18, 4)]


def test_a_large_file_is_read_in_several_tasks(spark, tmp_path):
    line = b"z" * 999 + b"\n"
    with open(tmp_path / "large.jsonl", "wb") as f:
        f.write(line * 50_000)
    parts = ranges.byte_ranges(listing_of(spark, tmp_path), size=4 << 20)
    assert parts.count() == 12
    found = ranges.read_ranges(parts)
    assert found.rdd.getNumPartitions() > 1 and found.groupBy("low").count().count() == 12 and found.count() == 50_000


def plain_pairs(steps):
    """(line, kind, call) in order: 0 opens a call, 1 is a result, 2 a run."""
    open_, pairs = [], []
    for line, kind, call in steps:
        if kind == 0:
            open_.append(call)
        elif kind == 1:
            open_ = [c for c in open_ if c != call]
            pairs = [p for p in pairs if p[0] != call]
        elif open_:
            pairs.append((open_.pop(), line))
    return sorted(pairs)


def test_shell_runs_equal_the_fold(spark):
    rng = random.Random(4)
    files = {}
    for f in range(200):
        files[f"f{f}"] = [(line, *rng.choice([(0, f"c{rng.randrange(6)}"), (1, f"c{rng.randrange(7)}"), (2, None)])) for line in range(1, rng.randrange(1, 40))]
    rows = [(f, line, kind, call) for f, steps in files.items() for line, kind, call in steps]
    df = spark.createDataFrame(rows, "path string, line_no int, kind int, call_id string").cache()
    called = df.where("kind = 0").selectExpr("path", "line_no", "0 AS k", "call_id", "'bash' AS tool")
    pairs = jsonl.attach_bash(called, df.where("kind = 2"), df.where("kind = 1"))
    got = {}
    for r in pairs.collect():
        got.setdefault(r.path, []).append((r.call_id, r.bash_line))
    for f, steps in files.items():
        assert sorted(got.get(f, [])) == plain_pairs(steps), steps


def test_shell_runs_of_a_very_long_file(spark):
    """300,000 open calls, then as many runs: a fold over arrays would take hours."""
    n = 300_000
    calls = spark.range(n).selectExpr("'f' AS path", "cast(id + 1 AS int) AS line_no", "0 AS k", "concat('c', id) AS call_id", "'bash' AS tool")
    runs = spark.range(n).selectExpr("'f' AS path", f"cast(id + {n} + 1 AS int) AS line_no")
    none = calls.where("line_no < 0").select("path", "line_no", "call_id")
    pairs = jsonl.attach_bash(calls, runs, none)
    wrong = pairs.where(f"cast(substring(call_id, 2) AS bigint) + bash_line <> {2 * n}").count()
    assert pairs.count() == n and wrong == 0
