import pytest
import numpy as np
import pyarrow.parquet as pq
import zlib

from litspark.llm.elias_fano import EliasFano, read_block, token_files, write_block
from litspark.llm.packing import pack, pack_documents
from litspark.llm.tokens import WordEncoder, vocabulary_path

ODD = [None, "", " \t\n", "It's don't WE'RE, x's, 12,5. a.. b,. ,, . é, É. naïve, ΣΑΣ ς İ, <|endoftext|> <|ENDOFTEXT|> A<|startoftext|>b,  x y, é, ́x word line ǅ, ½, x_y, #tag: ?! a? b! c; d:", "w" * 3000, "The the THE the, the. " * 2000]


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_word_encoder_equals_library():
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for memo in (500_000, 50):
        encoder = WordEncoder(vocabulary_path(), memo_words=memo)
        for part in (texts[:3], texts):
            ids, lengths = encoder.encode(part)
            ends = np.cumsum(lengths)
            assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == _library(part)


def test_elias_fano_selects_every_end():
    rng = np.random.default_rng(1)
    for lengths in ([], [1], [0, 0, 5], [1] * 500, rng.integers(1, 3000, 700).tolist()):
        values = np.cumsum(np.array(lengths, np.int64))
        coded = EliasFano.encode(values)
        assert coded.all().tolist() == values.tolist() == [coded.select(i) for i in range(len(values))]
        ids = np.arange(int(values[-1]) if len(values) else 0, dtype=np.uint32) % 49_000
        got, ends = read_block(write_block(ids, np.array(lengths, np.int64)))
        assert got.tolist() == ids.tolist() and ends.all().tolist() == values.tolist()


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, start string")


def test_token_files_round_trip(spark):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD * 2)] + [(None, "x y"), (5, None)]
    got = token_files(_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = sorted((str(i), len(x), crc(x)) for (i, _), x in zip(rows, _library([t for _, t in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_files(_frame(spark, [])).count() == 0


def test_pack_fills_sequences():
    rng = np.random.default_rng(2)
    for lengths in (np.array([1]), np.array([4096, 4097, 9000]), rng.integers(1, 6000, 300), np.full(50, 7)):
        pieces = pack(lengths)
        for d, n in enumerate(lengths):
            own = sorted((s, k) for x, s, k, _, _ in pieces if x == d)
            assert [s for s, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))] and sum(k for _, k in own) == n
        sequences = {}
        for _, _, k, s, o in pieces:
            sequences.setdefault(s, []).append((o, k))
        for held in sequences.values():
            held.sort()
            assert [o for o, _ in held] == [sum(k for _, k in held[:i]) for i in range(len(held))]
            total = sum(k for _, k in held)
            assert total == 4096 or total & (total - 1) == 0


def test_packing_costs_are_balanced():
    lengths = np.random.default_rng(3).integers(20, 3000, 2000)
    cost = {}
    for _, _, k, s, _ in pack(lengths):
        cost[s] = cost.get(s, 0) + k / 4096 + (k / 4096) ** 2
    full = sorted(cost.values())[20:]
    assert full[-1] < 1.6 * full[0]


def test_pack_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "x")]
    got = pack_documents(_frame(spark, rows)).collect()
    ids = {}
    for (i, _), x in zip(rows, _library([t for _, t in rows]), strict=True):
        ids.setdefault(i, x)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in rows)
    assert pack_documents(_frame(spark, [])).count() == 0


def test_other_tokenizers_are_refused():
    from litspark.llm import tokens

    with pytest.raises(ValueError, match="word"):
        tokens.encoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    assert tokens.encoder(tokens.vocabulary_path()).encode(["a"])[1].tolist() == [2]
