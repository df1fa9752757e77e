"""Encoding, counting and the coder against the library itself."""

import random
import zlib

import numpy as np
import pytest

from quillspark.llm.rans import Block, Table, encode_block
from quillspark.llm.token_counts import count_tokens, counts
from quillspark.llm.token_output import read_blocks, token_output, write_blocks
from quillspark.llm.tokens import PieceEncoder, default_path, encode_whole, load, widths

PARTS = [" ", "  ", "\n", "\n\n", "'s", "<|endoftext|>", "ab", "é1", "!", "\t", "\r", "\xa0", "\x1c", " ", "　", "\x85", "x", "日本", "12", "a.", "1,"]
SCHEMA = "doc_id long, text string, start string"


def texts(n, seed=1, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def lists(encoded):
    return [np.frombuffer(x, "<u2").tolist() for x in encoded]


def test_pieces_equal_whole_texts(monkeypatch):
    from quillspark.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 50)  # generations change again and again
    tokenizer, encoder = load(default_path()), PieceEncoder(default_path())
    for i in range(0, 1500, 50):
        some = [*texts(50, i), None]
        assert lists(encoder.encode(some)) == encode_whole(tokenizer, [t or "" for t in some])


def colliding():
    """Two words that every polynomial hash modulo a power of two takes for one."""
    return ["zzzz" + "".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba")]


def test_words_of_equal_polynomial_hash():
    assert lists(PieceEncoder(default_path()).encode(colliding())) == encode_whole(load(default_path()), colliding())


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 2), (16, 1), (64, 16), (2048, 128)])
def test_chunks_splice_to_the_whole(chunk, overlap):
    tokenizer, some = load(default_path()), texts(600, 9, 120 if chunk < 100 else 9000)[: 600 if chunk < 100 else 20]
    assert counts(tokenizer, widths(default_path()), some, chunk, overlap) == [len(x) for x in encode_whole(tokenizer, some)]


def test_chunks_without_white_space():
    tokenizer = load(default_path())
    some = ["a" * 5000, "ab" * 3000 + " c", " ".join(["word"] * 4000), "x\xa0y" * 900 + " b" * 900, "<|endoftext|>" * 700, *colliding(), "a b" + "c" * 5000 + " d" * 1200]
    assert counts(tokenizer, widths(default_path()), some, 500, 10) == [len(x) for x in encode_whole(tokenizer, some)]


def test_chunks_are_what_is_encoded(monkeypatch):
    from quillspark.llm import token_counts

    longest, whole = [], encode_whole
    monkeypatch.setattr(token_counts, "encode_whole", lambda t, some: longest.extend(map(len, some)) or whole(t, some))
    text = "some words, " * 20_000
    assert token_counts.counts(load(default_path()), widths(default_path()), [text]) == [len(whole(load(default_path()), [text])[0])]
    assert len(longest) > 100 and max(longest) <= token_counts.CHUNK_CHARS + token_counts.OVERLAP_CHARS


def test_count_tokens(spark):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "Hello wörld", "x"), (4, "word " * 600, "x"), (5, "lang text " * 9000, "x")]
    got = sorted(map(tuple, count_tokens(spark.createDataFrame(rows, SCHEMA), chunk=1000, overlap=8).collect()), key=str)
    n = [len(x) for x in encode_whole(load(default_path()), [r[1] or "" for r in rows])]
    assert got == sorted([(r[0], len((r[1] or "").encode()), k, k > 512) for r, k in zip(rows, n, strict=True)], key=str)
    assert count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_000])
def test_coder_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint32)
    table = Table.from_counts(np.bincount(ids, minlength=1000))
    block = Block(encode_block(table, ids, [1, None], [n // 2, n - n // 2], 5))
    assert (block.decode(table) == ids).all() and block.doc_ids == [1, None]
    assert [(d, s, len(x)) for d, s, x in block.documents(ids)] == [(1, 5, n // 2), (None, 5 + n // 2, n - n // 2)]
    parts = [block.decode(table, k) for k in range(len(block.points))]
    assert not n or (np.concatenate(parts) == ids).all()


def test_coder_notices_damage():
    ids = np.arange(500, dtype=np.uint32) % 7
    table = Table.from_counts(np.bincount(ids))
    raw = bytearray(encode_block(table, ids, [1], [500], 0))
    raw[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        Block(bytes(raw))
    with pytest.raises(ValueError, match="no frequency"):
        encode_block(table, np.array([7, 0], np.uint32) % 8, [1], [2], 0) if len(table.freq) > 7 else encode_block(Table.from_counts(np.array([1, 0])), np.array([1]), [1], [1], 0)


def test_skewed_counts_keep_every_id():
    counts = np.ones(50_000, np.int64)
    counts[3] = 10**12
    table = Table.from_counts(counts)
    assert table.freq.min() >= 1 and int(table.freq.sum()) == 1 << 20


def test_token_output_round_trip(spark, tmp_path):
    some = texts(300, 4)
    rows = [(i * 7 % 300, t, "x") for i, t in enumerate(some)] + [(None, "null id", "x"), (900, None, "x"), (901, "", "x"), (5, "twice", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = read_blocks(spark, write_blocks(df, str(tmp_path / "out")), with_ids=True).orderBy("start").collect()
    ids = {}
    for (d, t, _), x in zip(rows, encode_whole(load(default_path()), [r[1] or "" for r in rows]), strict=True):
        ids.setdefault(d, []).append([*x, 2])
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    at = 0
    for r in got:
        assert r["start"] == at and r["ids"] in ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        ids[r["doc_id"]].remove(r["ids"])
        at += r["n_tokens"]
    assert not any(ids.values())


def test_token_output_of_nothing(spark):
    assert token_output(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_ranges_cover_all(spark, monkeypatch, tmp_path, group):
    from quillspark.llm import token_output as module

    monkeypatch.setattr(module, "GROUP", group)
    rows = [(i, f"text {i} " * (i % 5), "x") for i in range(100)]
    path = write_blocks(spark.createDataFrame(rows, SCHEMA).repartition(7), str(tmp_path / "out"), range_bytes=100)
    assert spark.read.parquet(f"{path}/ranges").count() > 10
    got = read_blocks(spark, path).orderBy("doc_id").collect()
    n = [len(x) + 1 for x in encode_whole(load(default_path()), [r[1] for r in rows])]
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(i, sum(n[:i]), n[i]) for i in range(100)]


def test_a_repeated_row_is_dealt_to_many_ranges(spark, tmp_path):
    rows = [(7, "one text " * 30, "x")] * 200 + [(i, "word", "x") for i in range(5)]
    path = write_blocks(spark.createDataFrame(rows, SCHEMA).repartition(6), str(tmp_path / "out"), range_bytes=2000)
    sizes = sorted(r["n"] for r in spark.read.parquet(f"{path}/ranges").join(spark.read.parquet(f"{path}/blocks").groupBy("bucket").count().withColumnRenamed("count", "n"), "bucket").collect())
    got = read_blocks(spark, path).orderBy("start").collect()
    assert len(sizes) > 10 and len(got) == 205 and [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_long_texts_special_strings_and_unusual_white_space(spark):
    some = [*colliding(), "word<|endoftext|>,\xa0 next " * 3000, "x\u3000 " * 2000, "tail \n" * 4000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)], SCHEMA).coalesce(1)
    ids = [[*x, 2] for x in encode_whole(load(default_path()), some)]
    assert [r["n_tokens"] for r in count_tokens(docs).orderBy("doc_id").collect()] == [len(x) - 1 for x in ids]
    assert [r["ids_crc32"] for r in token_output(docs).orderBy("doc_id").collect()] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
