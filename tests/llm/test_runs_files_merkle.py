"""Periodic runs, token files and Merkle manifests against plain versions, on the given tables and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialogmill.llm import entries, merkle, runs, token_files

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(None, None, None), (1, "", "a"), (2, " \n\t ", None), (3, "x " * 9, ""), (4, "a b " * 3000 + "end", "a"), (5, "É é\x0bÉ é\x1cQ " * 40, "b")]
    rows += [(10 + i, "one two three four " * (i % 7) + f"tail{i}", "a") for i in range(70)] + 20 * [(10, "same row same row", "a")] + 9 * [(None, "no id", "b")]
    rows += [(200, "A", None), (-3, "<|endoftext|> AB's 12 naïve", "b"), (2**62, "zz " * 3, "é")]
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], FIELDS)
    # names that operators use themselves must not clash
    clash = {c: F.lit(1) for c in ("id", "runs", "collapsed", "ids", "tree", "index", "n", "path", "leaf", "root", "left", "start")}
    df.withColumns(clash).write.parquet(f"{path}/documents.parquet")
    df.limit(0).write.parquet(f"{path}/empty/documents.parquet")
    return path, rows


def rows_of(spark, path):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def plain_runs(x, least=6, times=4):
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            low = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            n = i + q - low
            if n >= max(least, times * q) and not any(x[low : low + n - d] == x[low + d : low + n] for d in range(1, q)):
                out.append((low, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for low, n, q in found for i in range(low + q, low + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_lyndon_groups():
    rng = random.Random(1)
    for _ in range(800):
        x = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 40))]
        ranks = {v: i for i, v in enumerate(sorted(set(x)))}
        x = [ranks[v] for v in x]
        length, group = runs.lyndon_groups(x)
        want = [next((j for j in range(i + 1, len(x)) if x[j:] <= x[i:]), len(x)) - i for i in range(len(x))]
        assert length == want
        roots = [tuple(x[i : i + n]) for i, n in enumerate(length)]
        assert len(set(zip(roots, group))) == len(set(roots)) == len(set(group))


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(1500):
        k = rng.randrange(1, 4)
        x = [b"%d" % rng.randrange(k) for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            a, base = rng.randrange(8), [b"%d" % rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            x[a:a] = [base[i % len(base)] for i in range(rng.randrange(5, 70))]
        for least, times in ((6, 4), (2, 2), (3, 3)):
            assert runs.text_runs([[b"z"], x, x], least, times) == [[], *2 * [plain_runs(x, least, times)]]


@pytest.mark.parametrize("which", ["given", "odd"])
def test_op11(spark, odd_dir, which):
    path = SF if which == "given" else odd_dir[0]
    got = entries.queries()["op11_runs"](spark, path).collect()
    want = [(r[0], *plain_row(r[0], r[1])) for r in rows_of(spark, path) if len(WORD.findall(r[1] or "")) < 7000]
    size = {r[0] for r in want}
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got if r[0] in size)


def plain_files(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for doc, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("which", ["given", "odd"])
def test_op12(spark, odd_dir, which):
    path = SF if which == "given" else odd_dir[0]
    got = sorted((tuple(r) for r in entries.queries()["op12_token_files"](spark, path).collect()), key=lambda r: r[1])
    want = plain_files(rows_of(spark, path))
    assert [r[0] for r in got] == [r[0] for r in want]
    if which == "odd":  # rows that share an id, or have none, are ordered by a digest of the text
        assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want) and [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got)])[:-1])
        want, got = ([r for r in x if r[0] not in (None, 10)] for x in (want, got))
    assert got == want


def test_token_files_give_sequences(spark, tmp_path):
    import public_tokenizers

    path, length = f"{tmp_path}/t", 16
    docs = spark.createDataFrame([(i, "some words of text " * (i % 9)) for i in range(200)], "doc_id bigint, text string")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), length=length, batch=4)
    every = {r.doc_id: (r.start, np.frombuffer(r.ids, dtype="<u4")) for r in token_files.read_tokens(spark, path).collect()}
    stream = np.concatenate([every[i][1] for i in range(200)])
    assert all((stream[s : s + len(x)] == x).all() for s, x in every.values())
    rows = token_files.read_tokens(spark, path, "sequences").orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(len(rows))) and all(len(r.ids) == len(r.mask) == length for r in rows)
    assert [x for r in rows for x, on in zip(r.ids, r.mask) if on] == stream.tolist()
    at = 0
    for part in token_files.read_manifest(path).to_pylist():
        file = token_files.Part(path, part["part"])
        for k in range(-(-part["n_tokens"] // length)):
            before = pa.total_allocated_bytes()
            ids, mask = file.sequence(k)
            assert pa.total_allocated_bytes() == before  # views of the mapped file
            on = mask.to_numpy(zero_copy_only=False)
            assert ids.dtype == np.uint16 and ids[on].tolist() == stream[at : at + int(on.sum())].tolist()
            at += int(on.sum())
    assert at == len(stream)


def test_words_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(6)
    others = "\u0301\u0327\u00a0\u0085\u3000\u1d00Σσς😀日本語Ωﬁ\u200b\x1c\x00"
    signs = [*map(chr, range(0x21, 0x250)), *others, *("etaoinSTRvmdl'.,0123É" * 9)]
    words = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    words = [w for x in words for w in x.encode().split()]
    ids, first = token_files.word_memo(path).gather(words)
    for w, a, b in zip(words, first[:-1], first[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(w.decode(), add_special_tokens=False).ids, w


def test_token_files_of_failed_tasks_are_not_named(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.dataSource.register(token_files.TokenSequences)
    bad = spark.range(10).selectExpr("id AS doc_id", "array(cast(if(id = 7, raise_error('lost'), id) AS int)) AS ids").repartition(5)
    with pytest.raises(Exception, match="lost"):
        bad.write.format(token_files.FORMAT).mode("append").save(path)
    with pytest.raises(FileNotFoundError):
        token_files.read_manifest(path)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout=8):
    """Root, and for each leaf its siblings (left, right) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // fanout * fanout
            path.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + fanout])))
            at[i] //= fanout
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(rows):
    leaf = lambda doc, text, lang, source, n: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))
    groups = {}
    for doc, text, lang, source, n in rows:
        low = None if text is None else text.translate({c: c + 32 for c in range(65, 91)})
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        own = leaf(doc, text, lang, source, n)
        groups.setdefault(lang, []).append((doc is not None, doc or 0, own, doc, leaf(doc, low, lang, source, n) if tampered else own))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([r[2] for r in sorted(groups[g])]) for g in names]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(names, trees, tops):
        for (_, _, own, doc, found), path in zip(sorted(groups[g]), paths):
            for left, right in path + top:
                found = H(left, found, right)
            out.append((doc, own, subroot, root, H(*(a + b for a, b in path + top)), found, found == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("which", ["given", "odd"])
def test_op13(spark, odd_dir, which):
    import duckdb

    path = SF if which == "given" else odd_dir[0]
    got = entries.queries()["op13_merkle"](spark, path)
    found = sorted(str(tuple(r)) for r in got.collect())
    assert found == plain_manifest(rows_of(spark, path))
    con = duckdb.connect()
    con.sql(f"create view documents as select doc_id, text, lang, source, n_chars from '{path}/documents.parquet{'/*.parquet' if which == 'odd' else ''}'")
    assert sorted(map(str, con.sql(entries.oracle_sql()["op13_merkle"]).select(*got.columns).fetchall())) == found


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts(spark, fanout):
    for sizes in ([1], [9], [4, 1, 8]):
        rows = [(g, i, H(f"{g}.{i}")) for g, n in enumerate(sizes) for i in range(n)]
        df = spark.createDataFrame(rows, "g int, i int, leaf string")
        got = {(r.g, r.i): (r.subroot, r.root, [tuple(p) for p in r.path]) for r in merkle.manifest(df, "g", "i", fanout=fanout).collect()}
        trees = [plain_tree([r[2] for r in rows if r[0] == g], fanout) for g in range(len(sizes))]
        root, tops = plain_tree([t[0] for t in trees], fanout)
        assert got == {(g, i): (t[0], root, path + tops[g]) for g, t in enumerate(trees) for i, path in enumerate(t[1])}


@pytest.mark.parametrize("name", ["op11_runs", "op12_token_files", "op13_merkle"])
def test_empty_tables(spark, odd_dir, name):
    assert entries.queries()[name](spark, f"{odd_dir[0]}/empty").count() == 0
