"""Words and rows that a hash or an id would take for one another."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dialogmill.llm import bpe, bytescan, entries, near_dedup, packing
from tests.llm import brute


def opposite_words(n):
    """A Thue-Morse word of n letters and its complement: any polynomial hash modulo 2**64 has one value for both from 2**10 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("opposite")
    rows, i = [], 0
    for n in (1 << 10, 1 << 11, 1 << 12):
        a, b = opposite_words(n)
        for text in (a, b, f"{a} {b}", f"{a} x y z", f"{b} x y z", f"{a}\n{a} q", f"{b}\n{b} q"):
            rows.append((i, text, None, None, None))
            i += 1
    rows += [(i, None, None, None, None), (i + 1, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, lang string").write.parquet(f"{path}/none/documents.parquet")
    return str(path), [(r[0], r[1]) for r in rows]


def test_ids_of_opposite_words(spark, stored):
    path, docs = stored
    enc = brute.rank_encoding()
    found = {r.doc_id: r for r in entries.queries()["op3_bpe"](spark, path).collect()}
    for i, text in docs:
        ids = enc.encode_ordinary(text or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert entries.queries()["op3_bpe"](spark, f"{path}/none").count() == 0


def test_links_of_opposite_words(spark, stored):
    path, docs = stored
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in entries.queries()["op8_near_dedup"](spark, path).collect()}
    assert found == brute.components(docs)


def test_names_are_of_lower_case_bytes():
    data = np.frombuffer("Straße ABC abc É é\x0b\x1cx".encode(), dtype=np.uint8)
    words, first = near_dedup.word_names(data, np.array([0, len(data)]))
    assert len(words) == 6 and words[1] == words[2] and words[3] != words[4] and first.tolist() == [0, 6]


def test_pieces_of_rows_that_share_an_id():
    rng = np.random.default_rng(5)
    for _ in range(30):
        packer = packing.Packer(64, 4, 8, 1, 0)
        rows = {}
        for doc in range(40):
            for _ in range(2):  # one id, one length, other ids
                ids = rng.integers(0, 1000, 5 + 3 * (doc % 9), dtype=np.int32)
                rows.setdefault(doc, []).append(ids)
                packer.add(doc, ids)
        packer.close()
        covered = {doc: 0 for doc in rows}
        for doc, start, length, crc, total, _, _ in packer.out:
            assert any(zlib.crc32(ids[start : start + length].astype("<u4").tobytes()) == crc for ids in rows[doc]) and total == len(rows[doc][0])
            covered[doc] += length
        assert all(covered[doc] == sum(map(len, r)) for doc, r in rows.items())


def test_distinct_pieces_of_one_hash():
    a, b = (w.encode() for w in opposite_words(1 << 10))
    for words in ([a, b, a, b"x", b], [b"one", b"two", b"one", b""], [b""], [b"x" * n + b"y" for n in (3, 8, 9, 63, 64, 65, 200)] * 2):
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        end = np.cumsum([len(w) for w in words])
        where, back = bytescan.distinct(data, end - [len(w) for w in words], end)
        assert [words[where[k]] for k in back] == words and len(where) == len(set(words))


def test_memo_forgets(monkeypatch):
    from dialogmill.llm import memo

    monkeypatch.setattr(memo, "WORDS", 3)
    asked = memo.Memo(lambda words: [[len(w)] * (len(w) % 3) for w in words])
    for words in ([b"a", b"bb", b"a"], [b"ccc", b"dddd", b"a"], [], [b"eeeee"] * 4):
        ids, first = asked.gather(words)
        assert [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:])] == [[len(w)] * (len(w) % 3) for w in words]
    assert bpe.byte_to_char()[0x20] == "Ġ"


def test_memo_keeps_words_that_came_again(monkeypatch):
    """When there are too many words, those that came again are not encoded anew, and ids stay those of their words."""
    from dialogmill.llm import memo

    monkeypatch.setattr(memo, "WORDS", 100)
    asked = []
    held = memo.Memo(lambda words: asked.extend(words) or [[len(w), *w[:1]][: len(w) % 3] for w in words], keep=True)
    often = [b"x" * n for n in range(1, 20)]
    for turn in range(20):
        words = pa.array([w.decode() for w in often] * 2 + [f"{turn}-{i}" for i in range(40)] + [""], pa.large_string())
        ids, first = held.gather_array(words)
        want = [[len(w), ord(w[0])][: len(w) % 3] if w else [] for w in words.to_pylist()]
        assert ids.tolist() == [x for y in want for x in y] and first.tolist() == np.cumsum([0, *map(len, want)]).tolist()
    assert all(asked.count(w) == 1 for w in often) and len(held.known) <= 100


def test_tokens_of_words_with_marks():
    """Words are cut and lowered as the library does it, also where only the small letter has a composed form."""
    import public_tokenizers

    from dialogmill.llm import token_files
    from dialogmill.llm.bytescan import pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    library, memo = token_files._tokenizer(path), token_files.word_memo.__wrapped__(path)
    for texts in (["T̈ ẗ H̱ J̌ Å", "Ärger STRASSE's"], ["  Hello\x0b\x0cWORLD\x1c\x85 It's \t", "", "İI ΣΟΣ ﬁX a1B2,;C", "\n"]):
        for low, high, data, at in pieces(pa.array(texts)):
            words, places = token_files.split_words(data, at)
            ids, first = memo.gather_array(words)
            ends = first[places]
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts[low:high]]
