import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from fundaflow.llm import packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, Text string, `a.b` int, n_tokens int"


def awkward(rng: random.Random, size: int) -> str:
    parts = ["the", "Thing", "don't", "x", "12", "é", "́a", "ﬁ", "中文", "<|endoftext|>", "<|startoftext|>", "...", "I'll", "ΑΣ", " ", " ", " ", "  ", "\n", "\t", " ", "İ", "😀", " "]
    return "".join(rng.choice(parts) for _ in range(size))


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_splicing_equals_whole_encoding(path):
    t, rng = tokens.Tokenizer(path), random.Random(5)
    for size in (0, 1, 40, 700, 3000):
        for spaced in (True, False):
            text = awkward(rng, size)
            text = text if spaced else "".join(text.split())
            got = tokens.resynchronised(text, t.offsets, chunk=400, overlap=110)
            want = t.offsets(text)
            assert got.ids.tolist() == want.ids.tolist()
            assert got.starts.tolist() == want.starts.tolist()


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_long_runs_do_not_break_the_splice(path):
    """Runs of one letter or of spaces, longer than the overlap and than a chunk, in small chunks."""
    t, rng = tokens.Tokenizer(path), random.Random(11)
    for _ in range(250):
        runs = [rng.choice("x.aé中1 \u00a0\n") * rng.choice([1, 2, 7, 70, 130, 300, 400]) for _ in range(rng.randint(2, 30))]
        text = rng.choice(["", " ", "  "]).join(r + awkward(rng, rng.choice([0, 3, 40])) for r in runs)
        got, want = tokens.resynchronised(text, t.offsets, chunk=256, overlap=64), t.offsets(text)
        assert got.ids.tolist() == want.ids.tolist()


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_given_texts_in_small_chunks(path, spark):
    t = tokens.Tokenizer(path)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        text = row.text or ""
        assert tokens.resynchronised(text, t.offsets, chunk=256, overlap=64).ids.tolist() == t.offsets(text).ids.tolist()


def test_overlap_widens_over_text_without_boundaries():
    t, asked = tokens.Tokenizer(WORDS), []

    def encode(text):
        asked.append(len(text))
        return t.offsets(text)

    text = "word " * 50 + "x" * 3000 + " word" * 200
    assert tokens.resynchronised(text, encode, 300, 120).ids.tolist() == t.offsets(text).ids.tolist()
    assert max(asked) > 3000  # the long word is encoded whole


def test_memo_by_words_equals_library():
    t, rng = tokens.Tokenizer(WORDS), random.Random(8)
    assert t.drops_space and not tokens.Tokenizer(BYTES).drops_space
    texts = [awkward(rng, 60) for _ in range(300)]
    assert t.counts(texts) == [len(x) for x in t.many(texts)]
    assert t.id_bytes(texts) == [np.array(x, np.uint32).tobytes() for x in t.many(texts)]


def test_full_memo_keeps_results(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    t, rng = tokens.Tokenizer(WORDS), random.Random(9)
    texts = [awkward(rng, 60) for _ in range(50)]
    assert t.counts(texts) == [len(x) for x in t.many(texts)]


def test_token_counts_cases(spark):
    rows = [(1, None, "z", 0, 0), (None, "", "z", 0, 0), (2, "two words", "z", 0, 0), (2, "two words", "z", 0, 0), (3, "w " * 30_000, "z", 0, 0)]
    got = tokens.token_counts(spark.createDataFrame(rows, SCHEMA), WORDS).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, 9, 2, False), (2, 9, 2, False), (3, 60_000, 30_000, True)], key=str)
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(0) == []
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    for n in (1, 7, 4095, 4096, 12_345):
        assert sum(packing.piece_lengths(n)) == n
        assert all(x & (x - 1) == 0 and x <= 4096 for x in packing.piece_lengths(n))
    with pytest.raises(ValueError):
        packing.piece_lengths(3, 100)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, awkward(rng, rng.choice([0, 5, 400])), "c", 1, 1) for i in range(30)] + [(99, None, "c", 1, 1), (None, "a b", "c", 1, 1), (98, "word " * 9000, "c", 1, 1), (5, "twice", "c", 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = packing.packed(frame, WORDS, with_ids=True).collect()
    t = tokens.Tokenizer(WORDS)
    whole = {}
    for i, text, *_ in rows:
        whole.setdefault(i, []).append(np.array([*t.many([text or ""])[0], 2], np.uint32).tobytes())
    assert len({r.sequence_id for r in got}) == len(got)
    assert {r.offset for r in got} == {0}
    for r in got:
        assert r.length == 1 << r.bucket and r.length <= 4096 and len(r.ids) == 4 * r.length
        assert r.ids_crc32 == zlib.crc32(r.ids)
        assert any(r.doc_tokens * 4 == len(w) and w[4 * r.start : 4 * (r.start + r.length)] == r.ids for w in whole[r.doc_id])
    assert sum(r.length for r in got) == sum(len(w) // 4 for ws in whole.values() for w in ws)
    assert packing.packed(frame.limit(0), WORDS).count() == 0


def test_buckets_on_disk(spark, tmp_path):
    pieces = packing.packed(spark.createDataFrame([(1, "a b c", "c", 1, 1), (2, "d", "c", 1, 1)], SCHEMA), WORDS, with_ids=True)
    packing.write_sequences(pieces, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.bucket: r.n for r in back.groupBy("bucket").agg({"length": "count"}).withColumnRenamed("count(length)", "n").collect()} == {2: 1, 1: 1}
