"""Token ids of many texts by a public tokenizer, with a bounded memory of words met before.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words one after
the other.  A batch of texts is cut at spaces (vectorised), equal words are found by 64-bit hashes, and only words that
are not in the worker's memory go to the tokenizer.  One sign (. , ; : ! ?) behind an ASCII letter at the end of a word
is a word of its own, since the tokenizer separates it there as well.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from terralith.llm import hashing

_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b".,;:!?")] = True
MEMORY = 400_000  # words
BATCH = 1 << 21  # bytes of text at a time


class WordCoder:
    """For tokenizers of the kind of word_bpe_49k.json: lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = {t.content.encode(): np.array([i], np.uint32).tobytes() for i, t in self.whole.get_added_tokens_decoder().items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in letters]
        self.shown = {b: b for b in letters} | {b: 256 + i for i, b in enumerate(other)}  # how byte-level tokenizers show a byte
        self.memory: dict[int, bytes] = {}

    def word(self, data: bytes) -> bytes:
        w = data.decode()
        if w.isalpha() and max(w) < "ɐ" and "İ" not in w:  # one pre-token of composed letters
            shown = w.lower().encode().decode("latin-1").translate(self.shown)
            return np.array([t.id for t in self.model.tokenize(shown)], np.uint32).tobytes()
        return np.array(self.whole.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit values."""
        data = [(t.as_py() or "").encode() for t in texts]
        parts = [self.cut.split(t) if self.cut and any(x in t for x in self.special) else [t] for t in data]  # text, special string, text, ...
        plain = [p for part in parts for p in part[::2]]
        ids: list[bytes] = []
        for a, b in hashing.batches_by_bytes(plain, BATCH):
            ids += self._encode(plain[a:b])
        given = iter(ids)
        return [b"".join(self.special[p] if k % 2 else next(given) for k, p in enumerate(part)) for part in parts]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join(texts)
        raw = hashing._LOWER[np.frombuffer(joined, np.uint8)] if joined else np.zeros(0, np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        edge = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(length + 1, out=edge[1:])
        start, end = hashing.runs(~_BREAK[raw])
        cut = (end - start >= 2) & _SIGN[raw[end - 1]] & _LETTER[raw[end - 2]] if len(start) else np.zeros(0, bool)
        start, end = np.concatenate((start, end[cut] - 1)), np.concatenate((np.where(cut, end - 1, end), end[cut]))
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        h = np.concatenate([hashing.span_hashes(raw[a:b], start[i:j] - a, end[i:j] - a) for a, b, i, j in self._spans(raw, start)]) if len(start) else np.zeros(0, np.uint64)
        found, first, which = np.unique(h, return_index=True, return_inverse=True)
        parts, memory = [], self.memory
        for k, i in zip(found.tolist(), first.tolist(), strict=True):
            ids = memory.get(k)
            if ids is None:
                ids = self.word(joined[start[i] : end[i]])
                if len(memory) < MEMORY:
                    memory[k] = ids
            parts.append(ids)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        begin = np.cumsum(size) - size
        n = size[which]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])]
        at = total[np.searchsorted(start, edge)]
        return [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    @staticmethod
    def _spans(raw: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
        bounds = hashing.pieces_of(raw)
        at = np.searchsorted(start, [a for a, _ in bounds] + [len(raw)])
        return [(a, b, int(i), int(j)) for (a, b), i, j in zip(bounds, at[:-1], at[1:], strict=True)]
