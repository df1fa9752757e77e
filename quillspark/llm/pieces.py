"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text begins as its characters, with a space in front and any U+2581 read as a space. Every pair of neighbours that is a piece of the vocabulary
waits in an agenda; the pair of the best score, the leftmost one among equals, is merged, and what is new beside it joins the agenda. What is
left is a piece or falls back to its bytes.

A merge makes a piece of the vocabulary, so no merge reaches over a place between two characters that no piece has side by side. Such places are found by class
of character (letter, digit, other), proven for each vocabulary when it is loaded; a text is cut there, and a worker remembers the ids of
the words it has met. Each Arrow batch is checked against the library: every word not met before and a whole text of it, or all whole texts; and all that is decoded.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import ship, slices, tidy

#: Words remembered by a worker, some 200 bytes each; the memory is cleared beyond it. Characters of the longest word that is remembered.
MEMO, WORD = 400_000, 64
#: Characters of a text that are encoded, checked and decoded at once.
PART = 1 << 18
_SPACE = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("quillspark-each-byte", _each_byte)


class Vocabulary:
    """A merge-type model without normalization rules and with byte fallback; others raise a ValueError."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, norm = sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is no merge-type vocabulary with byte fallback")
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path} normalizes texts, or has pieces of its user or unused ones")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.cost, self.surface, self.silent, self.spaced = {}, {}, [], set(), set()
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            text = p.piece.replace(_SPACE, " ")
            if p.type == kinds.NORMAL:
                self.ids[text], self.cost[text] = i, -p.score
                self.surface.append(text.encode())
                if text[0] == " ":
                    self.spaced.add(i)
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.CONTROL:
                self.silent.add(i)
                self.surface.append(b"")
            else:
                self.surface.append(model.trainer_spec.unk_surface.encode())
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.words = self._cutter()

    def _cutter(self) -> re.Pattern:
        """Words that a text can be cut into: spaces and then letters, one digit, or others; letters that some piece has before another class count as others."""
        odd: set[str] = set()
        while True:
            no = re.escape("".join(sorted(odd)))
            self.letter = re.compile(rf"[^\W\d_{no}]").match
            letter, other = rf"[^\W\d_{no}]", rf"(?:[^\w ]|[_{no}])"
            kind = re.compile(rf"({letter})|(\d)|( )|{other}")
            classes = {c: kind.fullmatch(c).lastindex or 4 for piece in self.cost for c in piece}
            met = {a for piece in self.cost for a, b in zip(piece, piece[1:], strict=False) if classes[a] != 3 and (classes[a] == 2 or classes[a] != classes[b])}
            if not met:
                return re.compile(rf" *{letter}+| *\d| *{other}+| +")
            if any(classes[a] != 1 for a in met):
                return re.compile(r" *[^ ]+| +") if not any(" " in piece.lstrip(" ") for piece in self.cost) else re.compile(r"(?s).+")
            odd |= met

    def agenda(self, word: str) -> list[int]:
        """Ids of a word, by merging its best neighbours first."""
        symbols, n, known = list(word), len(word), self.cost.get
        waiting = [(c, i, i + 1, 2) for i in range(n - 1) if (c := known(word[i : i + 2])) is not None]
        if waiting:
            heapify(waiting)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while waiting:
                _, i, j, size = heappop(waiting)
                a, b = symbols[i], symbols[j]
                if a is None or b is None or len(a) + len(b) != size:
                    continue  # one of them has been merged with another
                symbols[i], symbols[j] = a + b, None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (c := known(pair := a + b + symbols[k])) is not None:
                        heappush(waiting, (c, i, k, len(pair)))
                if (h := before[i]) >= 0 and (c := known(pair := symbols[h] + a + b)) is not None:
                    heappush(waiting, (c, h, i, len(pair)))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.bytes[x] for x in s.encode()]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are silent, the space in front goes, bytes that are no UTF-8 become U+FFFD one by one."""
        listed, out, first = ids.tolist(), "", True
        while listed and listed[-1] in self.silent:
            listed.pop()
        for part in _split(listed, self.silent):  # a character's bytes don't reach over a control id
            raw = b"".join(map(self.surface.__getitem__, part))
            out += raw[first and part[0] in self.spaced :].decode("utf-8", "quillspark-each-byte")
            first = False
        return out


def _split(ids: list[int], at: set[int]) -> Iterator[list[int]]:
    """The runs of ids that are not in ``at``."""
    cuts = [-1, *(k for k in range(len(ids)) if ids[k] in at), len(ids)] if not at.isdisjoint(ids) else [-1, len(ids)]
    yield from (ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Memo(dict):
    """Ids of words, as bytes of 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.fresh = vocabulary, []

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.vocabulary.agenda(word), "<u4").tobytes()
        if len(word) <= WORD:
            self[word] = ids
            self.fresh.append(word)
        return ids


class Encoder:
    """Ids of whole texts, held against the library batch by batch; a difference is a RuntimeError.

    ``check`` is "words" (each word that the worker meets for the first time, and one whole text of each batch), "texts" (all of them) or "".
    """

    def __init__(self, path: str, check: str = "words"):
        if check not in ("texts", "words", ""):
            raise ValueError(f"check is {check!r}")
        self.v, self.check = vocabulary(path), check
        self.memo = _Memo(self.v)

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some PART characters of them at a time."""
        words, held, size = self.v.words.finditer(text), [], 0
        for m in words:
            held.append(m[0])
            size += m.end() - m.start()
            if size >= PART:
                yield held
                held, size = [], 0
        yield held

    def _hold(self, texts: list[str], ids: list[bytes], what: str) -> None:
        """Compare with the library, which puts a space before each text; what has none follows a stand-in of another class, whose ids are cut off."""
        leads = ["" if t[:1] == " " else "a" if not self.v.letter(t[:1]) else "." for t in texts]
        skip = {x: len(self.v.library.encode(x)) if x else 0 for x in ("", "a", ".")}
        expected = self.v.library.encode([x + t if x else t[1:] for x, t in zip(leads, texts, strict=True)], num_threads=1)
        for x, t, e, own in zip(leads, texts, expected, ids, strict=True):
            if np.array(e[skip[x] :], "<u4").tobytes() != own and t != " ":  # a text of nothing gets no space from the library
                raise RuntimeError(f"the agenda's ids differ from the library's in {what} of {len(t)} characters that begins with {t[:80]!r}")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without begin and end, as little-endian 32-bit numbers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo.fresh.clear()
        out, find, get = [], self.v.words.findall, self.memo.__getitem__
        whole: list[int] = []
        for k, text in enumerate(texts):
            spaced = " " + text.replace(_SPACE, " ") if text else ""
            if len(spaced) <= PART:
                out.append(b"".join(map(get, find(spaced))))
                if text and (not whole or self.check == "texts"):
                    whole.append(k)
                continue
            done = []
            for words in self._parts(spaced):
                done.append(b"".join(map(get, words)))
                if self.check == "texts":
                    self._hold(["".join(words)], done[-1:], "a part of a text")
            out.append(b"".join(done))
        if self.check:
            self._hold([" " + texts[k] for k in whole], [out[k] for k in whole], "a text")
        if self.check == "words":
            self._hold(self.memo.fresh, [self.memo[w] for w in self.memo.fresh], "a word")
        return out


def encode(docs: DataFrame, path: str | None = None, check: str = "words", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids of every row of ``docs`` (doc_id, text): the ids of its whole text between begin and end, as little-endian 32-bit numbers.

    With ``decoded`` also the text that :func:`decode` makes of them. Null and empty texts have begin and end only and decode to the empty text. Rows without
    a doc_id and repeated rows count like any other; other columns are ignored. Texts of any length are encoded in parts of some PART characters, so a
    task holds a long text, its ids and the words of one part; only a run of one class of characters without a space is one word, however
    long, and takes some 300 bytes a character.
    """
    ship(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, check)
        v = encoder.v
        begin, end = (np.array([i], "<u4").tobytes() for i in (v.begin, v.end))
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids = [begin + x + end for x in encoder(texts)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                back = [v.decode(np.frombuffer(x, "<u4")) for x in ids]
                if check:
                    _same_texts(v, ids, back)
                columns.append(pa.array(back, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def _same_texts(v: Vocabulary, ids: list[bytes], texts: list[str]) -> None:
    if ids and v.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1) != texts:
        raise RuntimeError("a decoded text differs from the library's")


def decode(rows: DataFrame, path: str | None = None, check: str = "words") -> DataFrame:
    """doc_id, text of every row of ``rows`` (doc_id, ids: little-endian 32-bit numbers). Null ids have a null text; ids outside of the vocabulary are an error."""
    ship(rows.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, "ids"):
            ids = batch.column("ids").to_pylist()
            texts = [None if x is None else v.decode(np.frombuffer(x, "<u4")) for x in ids]
            if check:
                _same_texts(v, [x for x in ids if x is not None], [t for t in texts if t is not None])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
