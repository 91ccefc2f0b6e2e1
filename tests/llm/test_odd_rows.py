"""Results on rows that tables have at their edges: nulls, empty texts, repeated rows, shared, wide and missing ids."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dialogmill.llm import entries, fingerprints, langid, license_scan, near_dedup, packing, quality, quality_rules, warc
from tests.llm import brute

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, size=60):
    return " ".join(f"t{n}w{k}" for k in range(size))


def odd_documents():
    lines = "\n".join(f"shared line number {k} of many hosts" for k in range(4))
    rows = [(None, None, None), (1, "", "a"), (2, " \n\t ", None), (3, "Copyright 2020 X\nLicensed under the MIT License.\n" + words(3), "a")]
    rows += [(10 + i, lines + "\n" + words(i), "a") for i in range(9)] + [(30 + i, lines + "\n" + words(30 + i), "b") for i in range(3)]
    rows += 3 * [(12, lines + "\n" + words(2), "a")] + [(12, lines + "\n" + words(2), "b"), (12, words(99), "a")]
    rows += 4 * [(None, lines + "\n" + words(50, 20), "a")] + [(-5, "é" * 300, "a"), (2**62, words(7, 3000), "b"), (13, "a b c " * 40, "a")]
    return [(i, t, None, s, None) for i, t, s in rows]


def stored(spark, path, rows, fields=FIELDS, name="documents"):
    """A folder with this table; further columns have names that operators use themselves."""
    more = {"id": F.lit(1), "spans": F.lit("x"), "digest": F.lit(2), "host": F.lit("h"), "first": F.lit(3), "header": F.lit(4)}
    spark.createDataFrame(rows, fields).withColumns(more).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("odd"), odd_documents())


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = stored(spark, tmp_path_factory.mktemp("empty"), [])
    return stored(spark, path, [], "page_id bigint, url string, html string", "pages")


def same_as_sql(spark, name, path, table):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    want, have = con.sql(entries.oracle_sql()[name]), entries.queries()[name](spark, path)
    columns = sorted(want.columns)
    assert columns == sorted(have.columns)
    assert sorted(map(str, want.select(*(f'"{c}"' for c in columns)).fetchall())) == sorted(str(tuple(r)) for r in have.select(*columns).collect())
    return have.count()


def test_rules_of_repeated_rows(spark, odd_dir):
    have = same_as_sql(spark, "op5_quality_rules", odd_dir, "documents")
    assert have == len(odd_documents())
    # a verdict is the same for one copy, three copies, and copies at two hosts
    body, common = words(1), "\n".join(" ".join(f"c{k}x{j}" for j in range(13)) for k in range(3))
    base = [(i, f"{words(i)}\n{common}", None, "h", None) for i in range(100, 107)]
    verdicts = []
    for copies in ([(1, "h")], 3 * [(1, "h")], [(1, "h"), (1, "other")], 3 * [(None, "h")]):
        rows = [(i, f"{body}\n{common}", None, s, None) for i, s in copies]
        found = quality_rules.quality_rules(spark.createDataFrame(base + rows, FIELDS)).where("doc_id = 1 OR doc_id IS NULL").collect()
        assert len(found) == len(rows)
        verdicts += [(r.n_words, r.n_common_words, r.kept) for r in found if r.n_common_words or len(copies) != 2]
    assert set(verdicts) == {(99, 39, True)}


def test_rules_count_documents_or_texts(spark):
    copies = [(i, "only line of the copies " * 10 + words(1), None, "h", None) for i in range(9)]
    docs = spark.createDataFrame(copies, FIELDS)
    assert {r.n_common_words > 0 for r in quality_rules.quality_rules(docs).collect()} == {True}
    assert {r.n_common_words > 0 for r in quality_rules.quality_rules(docs, count="texts").collect()} == {False}
    assert quality_rules.keep_passing(docs).count() == 9


def key_of(doc, text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return (doc is not None, doc or 0, h - 2**64 if h >= 2**63 else h)


def test_next_texts_of_odd_ids(spark, odd_dir, empty_dir):
    docs = [(i, t or "") for i, t, *_ in odd_documents()]
    order = sorted(docs, key=lambda d: key_of(*d), reverse=True)
    want = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    try:
        fingerprints.RANGE_ROWS, kept = 3, fingerprints.RANGE_ROWS
        found = fingerprints.with_next(df, "doc_id", "text", "n").collect()
    finally:
        fingerprints.RANGE_ROWS = kept
    assert sorted((str(r.doc_id), r.text, r.n) for r in found) == want
    found = entries.queries()["op1_fingerprints"](spark, odd_dir).collect()
    edits = {(str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for i, t, n in [(None if i == "None" else i, t, n) for i, t, n in want]}
    assert {(str(r.doc_id), r.edited_sha256) for r in found} == edits and len(found) == len(docs)
    assert entries.queries()["op1_fingerprints"](spark, empty_dir).count() == 0


def test_next_texts_are_spread_for_any_ids(spark):
    rng = np.random.default_rng(1)
    wide = [int(x) for x in rng.integers(-(2**62), 2**62, 12_000)]
    for ids in (wide, [*range(12_000), 2**60], 6_000 * [7] + list(range(6_000))):
        df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id bigint, text string")
        starts = fingerprints._ranges(df, F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")))
        order = sorted(((i, f"text {k}") for k, i in enumerate(ids)), key=lambda d: key_of(*d), reverse=True)
        want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        found = fingerprints.with_next(df, "doc_id", "text", "n")
        assert {r.text: r.n for r in found.collect()} == want
        marks = [(s["i"], s["h"]) for s in starts]
        counts = np.bincount([sum(m >= key_of(*d)[1:] for m in marks) for d in order])
        assert len(starts) > 8 and counts.max() < 4 * fingerprints.RANGE_ROWS


CHECK = lambda d: xxhash.xxh64_intdigest((d >> 16).to_bytes(8, "little"), 42) & 65535


def peeled(shown):
    """The digests in a printed fingerprint."""
    if shown.startswith("all "):
        return {int(x, 16) for x in shown[4:].split(",")}
    if shown.startswith("["):
        depth, part, parts = 0, "", []
        for c in shown[1:-1]:
            depth += (c == "[") - (c == "]")
            if c == ";" and depth == 0:
                parts.append(part)
                part = ""
            else:
                part += c
        return set().union(*map(peeled, [*parts, part]))
    cells = {int(a): int(b, 16) for a, b in re.findall(r"(\d+)=([0-9A-F]+)", shown)}
    found = set()
    while pure := {x for i, x in cells.items() if x and x & 65535 == CHECK(x) and (x >> (16 + 3 * (i // 8))) & 7 == i % 8}:
        found ^= pure
        for x in pure:
            for t in range(3):
                i = 8 * t + ((x >> (16 + 3 * t)) & 7)
                cells[i] = cells.get(i, 0) ^ x
    assert not any(cells.values())
    return found


def test_likeness_is_that_of_the_printed_fingerprints(spark):
    rows = entries.queries()["op1_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        a, b = peeled(r.fingerprint), peeled(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(brute.jaccard(a, b))
    after = {r.doc_id: r for r in rows}
    for r in rows[:50]:
        follows = after.get(r.doc_id - 1, after[max(after)])
        assert r.near_next == pytest.approx(brute.jaccard(peeled(r.fingerprint), peeled(follows.fingerprint)))


def test_licenses_of_odd_rows(spark, odd_dir, empty_dir):
    assert same_as_sql(spark, "op6_license_scan", odd_dir, "documents") == len(odd_documents())
    assert same_as_sql(spark, "op6_license_scan", empty_dir, "documents") == 0
    rows = [(1, "x\nThis file is in the public domain.", None, None, None), *2 * [(2, "This file is in the PUBLIC domain\ny", None, None, None)], (2, "other", None, None, None), (None, "this file is in the public domain", None, None, None)]
    known = spark.createDataFrame([("own", "This file is in the public domain."), ("none", " -- ")], "license_id string, text string")
    found = license_scan.licensed(spark.createDataFrame(rows, FIELDS), license_scan.known_digests(spark, known, [])).collect()
    assert sorted((str(r.doc_id), r.license_id, r.n_license_lines, r.line_licenses) for r in found if r.n_license_lines) == [("1", None, 1, "own"), ("2", None, 1, "own"), ("2", None, 1, "own"), ("None", "own", 1, "own")]
    assert len(found) == 5
    whole = [("BSD-3-Clause", "Copyright (c) 2001 Us\nAll rights reserved.\n\n" + license_scan._BSD_3.upper()), ("MIT", license_scan._MIT.replace(", free of", " --  free\tof"))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, (_, t) in enumerate(whole)], FIELDS)
    assert sorted((r.doc_id, r.license_id) for r in license_scan.licensed(df, license_scan.known_digests(spark)).collect()) == [(i, x) for i, (x, _) in enumerate(whole)]


def components_by_row(rows, size=4):
    """For each row of (id, text), in order of its id and hash, nulls last: (id, n_shingles, component's id)."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, key_of(0, r[1] or "")[2]))
    found = brute.components([(k, t) for k, (_, t) in enumerate(order)], size)
    return sorted(str((order[k][0], n, order[c][0])) for k, (n, c) in found.items())


def test_near_duplicates_of_odd_rows(spark, odd_dir, empty_dir):
    found = entries.queries()["op8_near_dedup"](spark, odd_dir).collect()
    want = components_by_row([(i, t) for i, t, *_ in odd_documents()])
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert entries.queries()["op8_near_dedup"](spark, empty_dir).count() == 0


def template_texts(n, own=90, seed=5):
    """Texts of 300 words that share a template: similarity of about 0.6 without own copies, and no links but the pairs."""
    common = [f"c{k}" for k in range(300)]
    out = []
    for i in range(n):
        # an own block of words, and of each tenth text a copy with two words changed
        text = common[:105] + [f"o{i}x{k}" for k in range(own)] + common[105:210]
        out.append((2 * i, " ".join(text)))
        if i % 10 == 0:
            out.append((2 * i + 1, " ".join(text[:150] + ["new"] + text[151:])))
    return out


def test_templates_make_no_pairs(spark, monkeypatch):
    rows = template_texts(300)
    joined = []
    plain = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: joined.append((name, plain(df, name))) or joined[-1][1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(docs).collect()}
    assert found == brute.components(rows)
    assert sum(n == "near-rare" for n, _ in joined) == 1
    assert sum(df.count() for n, df in joined if n == "near-rest") <= 40
    exact = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(docs, exact=True).collect()}
    assert exact == found


def test_near_duplicates_of_more_documents(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.components(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in entries.queries()["op8_near_dedup"](spark, path).collect()}
    assert found == want


def test_archive_of_odd_pages(spark, tmp_path, empty_dir):
    body, long = "<p>" + "é" * 80, "x" * 300
    rows = [(5, "http://x/5", body), (3, "u\r\nv w", body), (9, None, body), *2 * [(4, "a", long)], (4, "b", long), (None, "n", body), (None, None, None), (6, "", ""), (6, "", "short"), (7, "z", "short"), (-2, "ü:>", long)]
    path = stored(spark, tmp_path, rows, "page_id bigint, url string, html string", "pages")
    found = entries.queries()["op9_warc"](spark, path).collect()
    got = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in found)
    size = len(body.encode())
    want = [(5, size, "revisit", 3), (3, size, "response", None), (9, size, "revisit", 3), *3 * [(4, 300, "revisit", -2)], (None, size, "response", None), (None, 0, "response", None), (6, 0, "response", None), (6, 5, "response", None), (7, 5, "response", None), (-2, 300, "response", None)]
    assert got == sorted(map(str, want))
    assert entries.queries()["op9_warc"](spark, empty_dir).count() == 0
    target = str(tmp_path / "w")
    warc.write_archive(spark.read.parquet(f"{path}/pages.parquet"), target)
    heads = {bytes(r.record).split(b"\r\n\r\n")[0].decode() for r in warc.read_archive(spark, target).collect()}
    assert any("WARC-Target-URI: u%0D%0Av w\r\n" in h for h in heads)
    ids = [h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads]
    assert len(set(ids)) == len(heads) == 11  # but for the two equal records
    wrong = spark.read.parquet(f"{target}/payloads").withColumn("payload", F.when(F.octet_length("payload") == 300, F.encode(F.lit("y"), "UTF-8")).otherwise(F.col("payload")))
    wrong.write.parquet(f"{tmp_path}/bad/payloads")
    for part in ("large", "other"):
        spark.read.parquet(f"{target}/headers/{part}").write.parquet(f"{tmp_path}/bad/headers/{part}")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archive(spark, f"{tmp_path}/bad").where("record_type = 'revisit'").select("payload_bytes").collect()


def test_training_rows_are_bounded(spark):
    rows = [(i % 3, words(i, 80), "en" if i % 2 else "fr", None, None) for i in range(60)] + [(None, words(1), "de", None, None), (8, None, "es", None, None), (9, "123", None, None, None)]
    docs = spark.createDataFrame(rows, FIELDS)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    scores = quality.scored(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    network = langid.train(docs, per_language=2)
    assert network.languages == ["en", "fr"]
    found = langid.identified(docs, network).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found if r.doc_id in (8, 9)} == {"und"}


def plain_features(text):
    """What quality.features takes from a text, one by one."""
    raw, low = text.encode(), text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    ws = brute.WORD.findall(low)
    chars = max(len(text), 1)
    n = lambda s: sum(text.count(c) for c in s)
    listed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\x0b\x0c\r\n#*$%&|<>~^=+@_{}[]\\/!?.,;:"
    triples = list(zip(ws, ws[1:], ws[2:]))
    top = max(map(ws.count, set(ws)), default=0)
    return [
        np.log1p(len(ws)), (chars - n(" \t\x0b\x0c\r\n")) / max(len(ws), 1), n("#*$%&|<>~^=+@_{}[]\\/") / chars, n("!?") / chars, n(".,;:") / chars, n("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, n("0123456789") / chars,
        sum(c not in listed and ord(c) < 128 for c in text) / chars, text.count("\n") / chars, len(set(ws)) / max(len(ws), 1), (len(set(triples)) / len(triples) if triples else float(bool(ws))), top / max(len(ws), 1), sum(b >= 0xC0 for b in raw) / chars,
    ]


def test_quality_against_a_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in rows] + [(10**6, ""), (10**6 + 1, "One"), (10**6 + 2, "a  b\n\né (x)")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for r in quality.text_features(docs, "text", "doc_id").collect():
        assert r.x == pytest.approx(plain_features(dict(texts)[r.doc_id]))
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for r in quality.scored(docs, model).collect():
        levels = [(np.array(b) < v).sum() for b, v in zip(model.bounds, plain_features(dict(texts)[r.doc_id]))]
        first = np.cumsum([0, *(len(b) + 1 for b in model.bounds[:-1])])
        z = (model.weights[first + levels].sum() - model.threshold) / model.scale
        assert r.score == pytest.approx(0.3 / (0.3 + 0.7 * np.exp(-z)), abs=1e-4)


def test_language_against_plain_convolutions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    network = langid.train(rows, per_language=30)
    texts = [(r.doc_id, r.text) for r in rows.limit(25).collect()]
    found = {r.doc_id: r for r in langid.identified(rows, network).collect()}
    for doc, text in texts:
        raw, logs = text.encode(), np.zeros(len(network.languages))
        for at in range(0, len(raw), 256):
            part = raw[at : at + 256].ljust(256)
            kinds = [b | 32 if chr(b).isascii() and chr(b).isalpha() else b for b in part]
            kinds = [k - 97 if 97 <= k < 123 else 26 if 48 <= k < 58 else 27 if k in b" \t\n\x0b\x0c\r" else 28 if k < 128 else k - 99 for k in kinds]
            pooled = [max(sum(f[j, kinds[i + j], c] for j in range(w)) for i in range(257 - w)) for w, f in network.filters.items() for c in range(f.shape[2])]
            z = np.maximum(np.array(pooled) + network.bias, 0) @ network.last + network.shift
            logs += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * len(raw[at : at + 256])
        mean = logs / len(raw)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert found[doc].lang_pred == network.languages[int(p.argmax())] and found[doc].score == pytest.approx(p.max(), abs=1e-3)
        if doc == texts[4][0]:
            break


def test_packing_of_odd_rows_and_its_padding(spark, odd_dir):
    import public_tokenizers

    found = entries.queries()["op7_packing"](spark, odd_dir).collect()
    enc = brute.rank_encoding()
    want = sorted(str((i, len(enc.encode_ordinary(t or "")) + 1)) for i, t, *_ in odd_documents())
    firsts = sorted(str((r.doc_id, r.doc_tokens)) for r in found if r.start == 0)
    assert firsts == want and sum(r.length for r in found) == sum(len(enc.encode_ordinary(t or "")) + 1 for _, t, *_ in odd_documents())
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    fill = {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and sum(fill.values()) >= 0.98 * 2048 * len(fill)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(2)
    for windows, n in ((1, 5), (2, 2), (4, 3), (8, 200), (64, 700)):
        sizes = rng.integers(1, 513, n).tolist()
        sums = np.bincount(packing.differencing(sizes, windows), weights=sizes, minlength=windows)
        assert sums.sum() == sum(sizes) and len(sums) == windows
        if n >= 10 * windows:
            assert sums.max() - sums.min() <= max(sizes) / 16
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]  # the textbook example


@pytest.mark.parametrize("name, parts", [("op2_quality", 5), ("op10_langid", 3)])
def test_trained_queries_on_odd_and_empty_tables(spark, tmp_path, name, parts):
    labels, fields = [(1, 0, 0), (3, 1, 0), (10, 1, None), (12, None, 1), (None, 1, 0), (11, 0, 0), (11, 1, 0)], "doc_id bigint, quality int, toxic int"
    path = stored(spark, stored(spark, tmp_path / "odd", odd_documents()), labels, fields, "labels")
    none = stored(spark, stored(spark, tmp_path / "none", []), [], fields, "labels")
    found = entries.queries()[name](spark, path).collect()
    assert len(found) == len(odd_documents()) and all(0 <= r.score <= 1 for r in found)
    left_out = 0 if name == "op2_quality" else 1
    assert all(r.held_out == (brute.held_out(r.doc_id, parts) == left_out) for r in found if r.doc_id is not None)
    if name == "op2_quality":
        assert all(r.predicted == int(r.score >= 0.3) for r in found)
    else:
        assert {r.lang_pred for r in found if r.doc_id in (1, 2)} == {"und"}
    assert entries.queries()[name](spark, none).count() == 0


def test_known_digests_are_those_of_entire_texts(spark):
    import pathlib

    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0"}
    here = {f: i for f, i in names.items() if (folder / f).exists()}
    if not here:
        pytest.skip("no licence texts on this machine")
    # spaces, case and copyright lines don't count
    rows = [(f, "Copyright 2024 Somebody\n" + (folder / f).read_text(encoding="utf-8", errors="replace").upper().replace("\n", "  \n")) for f in here] + [(f, (folder / f).read_text(encoding="utf-8", errors="replace")) for f in here]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r.license_id for r in license_scan.licensed(docs, license_scan.known_digests(spark)).collect()}
    assert [found[i] for i in range(len(rows))] == [here[f] for f, _ in rows]


def test_columns_of_the_next_text_come_along(spark):
    from dialogmill.llm.fingerprints import with_next

    docs = spark.createDataFrame([(i, f"t{i}", i * i) for i in range(5)], "doc_id long, text string, square long")
    found = {r.doc_id: (r.following, r.after) for r in with_next(docs, "doc_id", "text", "following", {"square": "after"}).collect()}
    assert found == {i: (f"t{(i - 1) % 5}", ((i - 1) % 5) ** 2) for i in range(5)}


def test_near_dedup_gathers_before_the_shuffle(spark):
    """A shingle leaves a task once for each batch, however many of its sets have it."""
    sets = [(i, list(range(100)) + [1000 + i]) for i in range(50)]
    df = spark.createDataFrame(sets, "id bigint, hashes array<bigint>").coalesce(1)
    found = near_dedup.gathered(df).collect()
    assert len(found) == 150 and {r.shingle: r.ids for r in found} == {**{x: list(range(50)) for x in range(100)}, **{1000 + i: [i] for i in range(50)}}
    assert near_dedup.gathered(df.where("id < 0")).count() == 0
    # room for 21 of 101 in each, one of them its own: 20 that all have in common
    rare = {r.id: len(r.rare) for r in near_dedup.shared_rare(df, 80).collect()}
    assert rare == {i: 20 for i in range(50)}
    # a set with more own shingles than its room can share none of its first ones
    assert near_dedup.shared_rare(spark.createDataFrame([(0, list(range(10)) + [77]), (1, list(range(10)) + [88, 89, 90])], df.schema), 80).where("id = 1").isEmpty()


def test_near_dedup_gathers_once_in_few_tasks(spark, monkeypatch):
    """Few sets that lie in many partitions are gathered together, and what they give on is made once and read again."""
    sets = [(i, list(range(100)) + [1000 + i]) for i in range(50)]
    df = spark.createDataFrame(sets, "id bigint, hashes array<bigint>").repartition(25)
    plain, made = near_dedup.gathered, []
    assert plain(df).count() == 150
    monkeypatch.setattr(near_dedup, "gathered", lambda x: made.append(1) or plain(x))
    assert {r.id: len(r.rare) for r in near_dedup.shared_rare(df, 80).collect()} == {i: 20 for i in range(50)} and made == [1]
    monkeypatch.setattr(near_dedup, "SHINGLES", 1000)
    assert 150 < plain(df).count() <= 6 * 100 + 50


def test_components_of_few_edges_in_many_partitions(spark, monkeypatch):
    """A chain dealt over many partitions is contracted at once, without rounds of stars."""
    plain, names = near_dedup.written, []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: names.append(name) or plain(df, name))
    chain = plain(spark.createDataFrame([(i + 1, i) for i in range(300)], "a bigint, b bigint").repartition(40), "chain")
    assert {(r.id, r.component) for r in near_dedup.components(chain).collect()} == {(i, 0) for i in range(301)}
    assert names == ["components"]
