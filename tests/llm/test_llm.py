import hashlib
import zlib

import numpy as np
import pytest

from dialogmill.llm import bpe, entries, fingerprints, langid, license_scan, near_dedup, packing, quality, quality_rules, suffix_dedup, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 700} sentence{i}." for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "fr", None, 4), (4, long, "en", "a", 1), (5, long, None, "b", 1), (6, "é" * 300, "fr", "a", 300), (7, "Licensed under CC BY 4.0.", "en", "a", 25), (7, "Licensed under CC BY 4.0.", "en", "a", 25), (None, "no id at all", "en", None, 12)]
    # names that operators use themselves must not clash
    return spark.createDataFrame([r + (1, "x", 2) for r in rows], FIELDS + ", id int, spans string, score int")


def got(spark, name):
    return {r[0]: r.asDict() for r in entries.queries()[name](spark, SF).collect()}


def test_fingerprints(spark, docs):
    found = got(spark, "op1_fingerprints")
    for i, (text, changed, following) in brute.edited_texts(docs).items():
        a, b, c = map(brute.paragraphs, (text, changed, following))
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(brute.jaccard(a, b)) and r["near_next"] == pytest.approx(brute.jaccard(a, c))


def test_quality_and_language_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in entries.queries()["op2_quality"](spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (brute.held_out(r.doc_id, 5) == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in entries.queries()["op10_langid"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) >= 0.95


def test_bpe(spark, docs):
    found, enc = got(spark, "op3_bpe"), brute.rank_encoding()
    for i, text in docs:
        ids = enc.encode_ordinary(text or "")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_offsets_and_split_characters(spark):
    import public_tokenizers

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "it's 😀 naïve\n\n <|endoftext|>"
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k")], "doc_id int, text string, ids string")
    one, two, three = bpe.decode(bpe.encode(df, path), path).orderBy("doc_id").collect()
    raw = text.encode()
    assert (one.decoded, two.decoded, three.ids) == (text, "", [])
    assert one.ids == brute.rank_encoding().encode_ordinary(text)
    for b, e, c, d in zip(one.byte_start, one.byte_end, one.char_start, one.char_end):
        assert raw[b:e] in text[c:d].encode()


def test_suffix_dedup(spark, docs):
    found = got(spark, "op4_suffix_dedup")
    for i, want in brute.spans_removed(docs).items():
        assert tuple(found[i][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


@pytest.mark.parametrize("hot", [(1, 2048, 50), (64, 3, 7), (64, 2048, 3), (64, 2048, 20_000), (2, 5, 50)])
def test_suffix_dedup_of_hot_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCK", hot[0])
    monkeypatch.setattr(suffix_dedup, "HOT_BUCKET", hot[1])
    monkeypatch.setattr(suffix_dedup, "RUN", hot[2])
    monkeypatch.setattr(suffix_dedup, "FLUSH", 500)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = np.random.default_rng(3)
    common = "".join(rng.choice(list("abcdé "), 400))
    rows = [(i, "".join(rng.choice(list("abc "), 150)) + common[i : 330 - i] + "".join(rng.choice(list("abc "), 90)) + "xy" * (20 * (i % 5))) for i in range(40)]
    spans = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    gone = {r.doc: r.spans for r in spans.collect()}
    for i, want in brute.spans_removed(rows).items():
        raw = np.frombuffer(dict(rows)[i].encode(), dtype=np.uint8)
        low, n = (np.array([s[k] for s in gone.get(i, [])], dtype=np.int64) for k in ("low", "n"))
        kept, runs = suffix_dedup.cut(raw, low, n)
        assert (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept.tobytes()).hexdigest()) == want


@pytest.mark.parametrize("name", ["op5_quality_rules", "op6_license_scan", "op9_warc"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, have = con.sql(entries.oracle_sql()[name]).df(), entries.queries()[name](spark, SF).toPandas()
    columns, key = sorted(want.columns), want.columns[0]
    a, b = (x.sort_values(key).reset_index(drop=True)[columns].astype(object) for x in (want, have))
    assert a.where(a.notna(), None).values.tolist() == b.where(b.notna(), None).values.tolist()


def test_packing(spark, docs):
    found, enc = entries.queries()["op7_packing"](spark, SF).collect(), brute.rank_encoding()
    pieces, windows = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert sum(r.length for r in w) <= 2048 and [r.offset for r in w] == [sum(x.length for x in w[:i]) for i in range(len(w))]
    for i, text in docs:
        ids, at = np.array([*enc.encode_ordinary(text or ""), 1], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_near_dedup(spark, docs):
    found = got(spark, "op8_near_dedup")
    for i, want in brute.components(docs).items():
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (*want, want[1] == i)


def test_odd_rows(spark, odd):
    empty = odd.limit(0)
    labels = spark.createDataFrame([(2, 0), (4, 1), (6, None), (7, 0), (None, 1)], "doc_id bigint, quality int")
    assert fingerprints.with_next(odd.select("doc_id", "text").na.fill(""), "doc_id", "text", "n").count() == 9
    assert fingerprints.with_next(empty.select("doc_id", "text"), "doc_id", "text", "n").count() == 0
    rules = quality_rules.quality_rules(odd)
    assert rules.count() == 9 and quality_rules.quality_rules(empty).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(empty, labels).count() == 0
    assert quality.scored(odd, quality.train(odd, labels)).count() == 9
    network = langid.train(odd)
    found = {r.doc_id: r.lang_pred for r in langid.identified(odd, network).collect()}
    assert found[1] == found[2] == found[3] == "und" and langid.identified(empty, langid.train(empty)).count() == 0
    known = license_scan.known_digests(spark)
    assert [r.license_id for r in license_scan.licensed(odd, known).where("doc_id = 7").collect()] == ["CC-BY-4.0"] * 2
    assert license_scan.licensed(empty, known).count() == 0
    pair = near_dedup.near_duplicates(odd)
    assert {r.id: r.component_id for r in pair.collect() if r.id in (1, 4, 5)} == {1: 1, 4: 4, 5: 4}
    assert near_dedup.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.keep_one(odd).collect()) == [0, 1, 2, 3, 4, 6, 7]
    cut = suffix_dedup.remove_repeats(odd)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == odd.columns and texts[5] == "" and texts[1] is None and texts[6] == "é" and texts[None] == "no id at all"
    assert suffix_dedup.remove_repeats(empty).count() == 0
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(odd, path).select("doc_id").distinct().count() == 8 and packing.pack(empty, path).count() == 0
    assert bpe.encode(odd, path, with_offsets=False).count() == 9


def test_pipeline_stages_of_odd_rows(spark, odd):
    import corpus_pipeline as p

    good = " ".join(f"plain{i} words{i}" for i in range(40))
    more = spark.createDataFrame([(9, good, "en", "a", 1, 1, "x", 2), (9, "bad", "en", "a", 1, 1, "x", 2), (None, good, "en", "a", 1, 1, "x", 2)], odd.schema)
    ruled = p.rules(spark, odd.unionByName(more), SF)
    assert sorted((r.doc_id or 0, r.text[:5]) for r in ruled.collect()) == [(0, "plain"), (4, "word0"), (5, "word0"), (9, "plain")]
    for stage in (p.rules, p.quality, p.near_dedup, p.suffix_dedup):
        assert stage(spark, odd, SF).columns == odd.columns and stage(spark, odd.limit(0), SF).count() == 0
    lengths = {r.doc_id: (r.text, r.n_chars) for r in p.suffix_dedup(spark, odd, SF).collect()}
    assert lengths[1] == (None, None) and lengths[2] == ("", 0) and lengths[5] == ("", 0)
    assert p.packing(spark, odd.limit(0), SF).count() == 0


def test_warc_records(spark, tmp_path):
    body = "<p>" + "é" * 80
    pages = spark.createDataFrame([(3, "http://x/3", body, 1), (1, "http://x/1", body, 1), (2, None, None, 1), (4, "u\r\nv", "short", 1), (5, "u", "short", 1)], "page_id bigint, url string, html string, header int")
    warc.write_archive(pages, str(tmp_path / "w"))
    found = {r.id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert (found[3].record_type, found[3].refers_to, found[3].payload_bytes) == ("revisit", 1, 163)
    head, _, rest = bytes(found[1].record).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest == body.encode() + b"\r\n\r\n"
    assert (found[2].payload_bytes, found[4].record_type, found[5].record_type) == (0, "response", "response")
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ruled = p.rules(spark, docs, SF)
    assert ruled.columns == docs.columns
    kept = {r.doc_id for r in entries.queries()["op5_quality_rules"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == kept
    single = p.near_dedup(spark, ruled, SF)
    want = brute.components([(r.doc_id, r.text) for r in ruled.collect()], size=5)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}
    cut = p.suffix_dedup(spark, single, SF)
    kept = brute.kept_bytes([(r.doc_id, r.text) for r in single.collect()])
    for r in cut.collect():
        assert (r.text, r.n_chars) == (kept[r.doc_id].decode("utf-8", "ignore"), len(r.text))
    # the whole run holds the ids of what the stages leave, each in one piece
    left = docs
    for _, stage in p.STAGES[:-1]:
        left = stage(spark, left, SF)
    enc, pieces = brute.rank_encoding(), {}
    for r in p.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert set(pieces) == set(texts) and set(texts) < set(kept)
    for i, text in texts.items():
        ids, at = np.array([*enc.encode_ordinary(text), 1], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_common_lines_leave_the_texts(spark):
    import corpus_pipeline as p

    body = lambda i: "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(20)) for j in range(4))
    rows = [(i, f"Shared  FOOTER here\n{body(i)}\n\nshared footer\there ", None, "h", 0) for i in range(8)]
    # equal texts of one id in a host where the line is rare, and rows without an id
    rows += [(1, rows[1][1], None, "other", 0), (None, rows[2][1], None, "h", 0), (None, rows[2][1], None, "h", 0), (9, body(9), None, "h", 0)]
    docs = spark.createDataFrame(rows, FIELDS)
    cleaned = p.rules(spark, docs, SF)
    want = sorted((i if i is not None else -1, h, (t if h == "other" or i == 9 else body(2 if i is None else i) + "\n")) for i, t, _, h, _ in rows)
    found = cleaned.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.source, r.text) for r in found) == want
    assert all(r.n_chars == len(r.text) for r in found)
    lost = {r.n_common_words for r in quality_rules.quality_rules(docs).where("doc_id between 2 and 7 or doc_id is null").collect()}
    assert lost == {6}


def test_null_and_shared_ids_in_dedup(spark, tmp_path):
    text = lambda n, size=60: " ".join(f"t{n}w{k}" for k in range(size))
    rows = [(None, text(1)), (None, text(1)), (None, text(1).replace("t1w59", "other")), (1, text(2)), (3, text(2)), (3, text(3, 90)), (3, text(4, 40)), (4, text(5)), (None, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], FIELDS)
    kept = near_dedup.keep_one(docs, size=5).collect()
    assert sorted(((r.doc_id or 0), r.text[:3]) for r in kept) == [(0, "t1w"), (1, "t2w"), (3, "t3w"), (3, "t4w"), (4, "t5w")]
    shared = text(6)
    rows = [(2, text(7) + "@" + shared), (2, "short"), (2, text(8, 30)), (3, shared), (None, text(9) + "#" + shared), (None, text(9) + "#" + shared)]
    want = sorted([(2, text(7) + "@" + shared), (2, "short"), (2, text(8, 30)), (3, ""), (0, text(9) + "#"), (0, "")])
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], FIELDS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id or 0, r.text) for r in suffix_dedup.remove_repeats(docs).collect()) == want
    found = entries.queries()["op4_suffix_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.kept_sha256) for r in found) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def test_common_lines_of_a_hot_host(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    hot = [(i, body(i) + "\nfooter of many" * (i < 35) + "\nline of few" * (i < 30), None, "hot", 0) for i in range(400)]
    small = [(1000 + i, body(1000 + i) + "\nfooter of many" * (i < 6), None, "small", 0) for i in range(50)]
    kept = quality_rules.keep_passing(spark.createDataFrame(hot + small, FIELDS)).collect()
    assert len(kept) == 450 and not any("footer of many" in r.text for r in kept)
    assert sum("line of few" in r.text for r in kept) == 30
