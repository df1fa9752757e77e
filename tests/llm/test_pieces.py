import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quillspark.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def texts():
    rng, alphabet = random.Random(3), "ab e▁ \n\t.,1²0é汉\0<s></s>'-_Ωthing"
    return ["", " ", "  ", "a", "▁", "<s> a </s><0x41>", "x" * 3000, " " * 500, "²." * 50, "²", "1²", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500))]


@pytest.mark.parametrize("check", ["words", "texts", ""])
def test_agenda_equals_library(library, check):
    given = texts()
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.Encoder(pieces.default_path(), check)(given)] == library.encode(given)


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 50)
    given = [" ".join(texts()), "word " * 200, " " * 300, ("ab1.  " * 90).strip()]
    for check in ("words", "texts"):
        assert [np.frombuffer(x, "<u4").tolist() for x in pieces.Encoder(pieces.default_path(), check)(given)] == library.encode(given)


def test_decoding_any_ids(library):
    rng, v = random.Random(4), pieces.vocabulary(pieces.default_path())
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, 259, 260, 28705, rng.randint(3, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 9))]
        assert v.decode(np.array(ids, "<u4")) == library.decode(ids)


def test_a_difference_is_an_error(monkeypatch):
    monkeypatch.setattr(pieces.Vocabulary, "agenda", lambda self, word: [5] * len(word))
    for check in ("words", "texts"):
        with pytest.raises(RuntimeError, match="differ"):
            pieces.Encoder(pieces.default_path(), check)(["some words"])


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x", 0), (1, "", "y", 1), (None, "Some text.", "z", 2), (3, "Some text.", None, 3), (3, "Some text.", None, 3), (4, "long " * 60_000, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encode(docs, decoded=True).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], r["n_tokens"]) for r in got) == sorted((d or 0, t or "", len(library.encode(t or "")) + 2) for d, t, _, _ in rows)
    back = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((d or 0, t or "") for d, t, _, _ in rows)
    assert pieces.encode(docs.limit(0), decoded=True).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()[0]["text"] is None


def test_query_equals_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_sentencepiece(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
