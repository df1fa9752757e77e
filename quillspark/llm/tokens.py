"""Tokenizer access and encoding that equals the library's on whole texts.

Stable boundary: a character that is no white space, followed by a space, tab or line break. In a byte-level BPE with the usual split pattern and
no normalizer no pretoken holds such a place inside, as every alternative of the pattern is an optional space and a run without white space, or white
space alone. Special strings hold no white space here, so none lies across it either, and what the library looks at on each side of the place
does not depend on the other side. So the tokens before and after it are those of the two parts encoded alone, whatever else the text holds.
In texts without special strings an ASCII letter followed by an ASCII mark is such a place too: alternatives with letters end where letters end, and
none but those that begin with an apostrophe have a mark in front of letters.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: White space as the split pattern may see it, other than the four characters at which texts are cut. Fixed values.
EXOTIC = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
UNUSUAL = re.compile(f"[{EXOTIC}]")
#: A stable boundary: the white space that follows it.
CUT = re.compile(f"(?<=[^ \t\n\r{EXOTIC}])[ \t\n\r]")
#: Pieces remembered by a worker; beyond it the half met in the most slices of texts stays. About 60 bytes each.
MEMO = 1_000_000
#: Pieces learnt since the last merge that are looked up apart.
FRESH = 60_000
#: Pieces that the library gets as one text; characters that it gets at once of a text that is not cut into pieces, where stable boundaries allow.
TOGETHER, LONG = 64, 1 << 15
#: Odd base of the hash of a piece, modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, once in each worker; one thread, as Spark already uses a task for each core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.normalizer is not None or any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("stable boundaries are proven for tokenizers without a normalizer and with special strings free of white space")
    return tokenizer


@lru_cache(maxsize=2)
def widths(path: str) -> np.ndarray:
    """Bytes of text that each id stands for: a byte-level vocabulary has a character for each."""
    tokenizer = load(path)
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    out[list(vocabulary.values())] = list(map(len, vocabulary))
    for i, t in tokenizer.get_added_tokens_decoder().items():
        out[i] = len(t.content.encode())
    return out


def encode_whole(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_long(tokenizer, text: str) -> list[int]:
    """Ids of a whole text, which the library gets in parts that end at stable boundaries."""
    cuts, last = [0], 0
    for m in CUT.finditer(text):
        if m.start() - last >= LONG:
            cuts.append(last := m.start())
    return [x for one in encode_whole(tokenizer, [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]) for x in one]


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: ASCII marks but the apostrophe, which may begin a contraction.
_MARK = np.array([33 <= b < 127 and b != 39 and not chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of a base and of its inverse modulo 2 ** 64, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class PieceEncoder:
    """Ids of whole texts, as bytes of ``dtype``.

    Texts are cut at stable boundaries and the library encodes each piece the first time a worker meets it. Pieces are found in sorted arrays by a
    64-bit hash, and each that is found is compared with the one remembered, byte by byte: a text with a piece that differs is encoded by itself, and
    so are texts with unusual white space or special strings.
    """

    def __init__(self, path: str, dtype: str = "<u2"):
        self.tokenizer, self.dtype = load(path), np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{dtype} is too narrow for the vocabulary")
        self.widths = widths(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.powers = _Powers(_BASE)
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]  # sorted hashes and rows: merged ones, fresh ones
        self.met = np.zeros(0, np.uint16)  # by row
        self.raw, self.at, self.size, self.filled = np.zeros(1 << 16, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the pieces' bytes
        self.flat, self.first, self.used = np.zeros(1 << 16, self.dtype), np.zeros(1, np.int64), 0

    def _hashes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of each piece's bytes and its length."""
        up, down = self.powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf + np.uint64(1)) * up[: len(buf)], out=total[1:])
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of distinct keys; -1 for those not known."""
        rows = np.full(len(keys), -1, np.int64)
        for hashes, at in self.tables:
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                rows = np.where(hashes[place] == keys, at[place], rows)
        return rows

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order.

        Pieces that begin with white space and don't end with it have stable boundaries among each other, so the library gets many of them as
        one text; the bytes that each id stands for tell where a piece ends.
        """
        joins = [p[0] in " \t\n\r" and p[-1] not in " \t\n\r" for p in pieces]
        order = sorted(range(len(pieces)), key=joins.__getitem__)
        alone = len(pieces) - sum(joins)
        texts = [pieces[k] for k in order[:alone]] + ["".join(pieces[k] for k in order[i : i + TOGETHER]) for i in range(alone, len(pieces), TOGETHER)]
        ids = np.fromiter((x for one in encode_whole(self.tokenizer, texts) for x in one), self.dtype)
        ends = np.cumsum(self.widths[ids])
        last = np.searchsorted(ends, np.cumsum([len(pieces[k].encode()) for k in order])) + 1
        sizes = np.diff(last, prepend=0)
        put = np.empty(len(pieces), np.int64)
        put[order] = np.arange(len(pieces))
        n = sizes[put]
        first = (last - sizes)[put]
        return n, ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Append new pieces, in order of their keys, to the table."""
        start, sizes, ids = len(self.met), *self._encoded([p.decode() for p in pieces])
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end - len(self.flat)), self.dtype)])
        self.flat[self.used : end] = ids
        self.first = np.concatenate([self.first, self.used + np.cumsum(sizes)])
        self.used = end
        self.at, self.size = np.concatenate([self.at, self.filled + np.cumsum([0, *map(len, pieces[:-1])])]), np.concatenate([self.size, list(map(len, pieces))])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        if self.filled + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(self.raw), len(raw)), np.uint8)])
        self.raw[self.filled : self.filled + len(raw)] = raw
        self.filled += len(raw)
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.uint16)])
        (old, rows), (fresh, more) = self.tables
        fresh, more = np.concatenate([fresh, keys]), np.concatenate([more, np.arange(start, len(self.met))])
        order = np.argsort(fresh, kind="stable")
        self.tables[1] = fresh[order], more[order]
        if len(fresh) > FRESH:
            whole, at = np.concatenate([old, self.tables[1][0]]), np.concatenate([rows, self.tables[1][1]])
            order = np.argsort(whole, kind="stable")
            self.tables = [(whole[order], at[order]), (fresh[:0], more[:0])]

    def _purge(self) -> None:
        """Keep the pieces met most often, at most half of what is remembered; the others are learnt anew when met."""
        keep = self.met > max(1, int(np.partition(self.met, -(MEMO // 2))[-(MEMO // 2)]))
        new, n = np.cumsum(keep) - 1, np.diff(self.first)
        self.flat = self.flat[: self.used][np.repeat(keep, n)]
        self.first, self.used = np.concatenate([[0], np.cumsum(n[keep])]), len(self.flat)
        self.raw = self.raw[: self.filled][np.repeat(keep, self.size)]
        self.met, self.size, self.filled = self.met[keep] // 2, self.size[keep], len(self.raw)
        self.at = np.cumsum(self.size) - self.size
        self.tables = [(h[keep[r]], new[r[keep[r]]]) for h, r in self.tables]

    def _differs(self, row: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the pieces that are not what is remembered in their rows."""
        size = end - start
        fits = self.size[row] == size
        place = np.repeat(np.where(fits, self.at[row], 0) - start, size) + np.arange(len(buf))
        place = np.minimum(place, self.filled - 1)  # of those of another size only
        return np.flatnonzero(~fits | ~np.minimum.reduceat(self.raw[place] == buf, start))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.met) > MEMO:
            self._purge()
        whole = {i for i, t in enumerate(texts) if t and (UNUSUAL.search(t) or any(x in t for x in self.special))}
        raws = [b"" if i in whole or not t else t.encode() for i, t in enumerate(texts)]
        edges = np.cumsum([0, *map(len, raws)])
        data = b"".join(raws)
        buf = np.frombuffer(data, np.uint8)
        out = [b""] * len(texts)
        if len(buf):
            space = (buf == 32) | (buf == 9) | (buf == 10) | (buf == 13)
            begins = space.copy()
            begins[1:] &= ~space[:-1]
            begins[1:] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
            begins[edges[:-1][edges[:-1] < len(buf)]] = True
            start = np.flatnonzero(begins)
            end = np.append(start[1:], len(buf))
            keys, at, back = np.unique(self._hashes(buf, start, end), return_index=True, return_inverse=True)
            rows = self._rows(keys)
            new = np.flatnonzero(rows < 0)
            if len(new):
                self._learn([data[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)], keys[new])
                rows[new] = np.arange(len(self.met) - len(new), len(self.met))
            self.met[rows] = np.minimum(self.met[rows], 65_534) + 1
            row = rows[back]
            if (odd := self._differs(row, buf, start, end)).size:
                whole |= set((np.searchsorted(edges, start[odd], side="right") - 1).tolist())
            n = self.first[row + 1] - self.first[row]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.repeat(self.first[row] - total[:-1], n) + np.arange(total[-1])].tobytes()
            cuts = (total[np.searchsorted(start, edges)] * self.dtype.itemsize).tolist()
            out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in whole:
            out[i] = np.array(encode_long(self.tokenizer, texts[i]), self.dtype).tobytes()
        return out


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> PieceEncoder:
    """One for each worker, so that its tasks share what they have learnt; its size is bounded by MEMO."""
    return PieceEncoder(path, dtype)
