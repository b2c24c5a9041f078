"""Token ids of whole Arrow columns: each different word is tokenised once per Python worker.

Byte-level vocabularies cut a text at white space before they merge, so a word
with the blank before it has the same ids wherever it stands. Texts are cut into
such items on their bytes, equal items are found by a 64-bit hash, and only new
ones reach the tokenizer; the ids of a text are then gathered by index. Texts with
white space beyond ASCII, where the cut would not be safe, go to the tokenizer
whole. So do texts that hold the content of an added token (``<|endoftext|>``), unless
``literal`` is set: then it is text like any other, else the one id that the library
gives it by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm import text as X

#: how the vocabulary's own pre-tokenizer splits, as its file names it (ByteLevel with its pattern)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: items remembered per worker, some 100 bytes each; beyond it the memory starts anew
REMEMBERED = 1_000_000
#: letters below this code point are classed alike by all engines
_PLAIN = "ɐ"
_LINE = b"\n"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids by a byte-level vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, literal: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._same_merges(spec)
        # with ``literal`` the library still finds added tokens that are not special
        self.added = [t["content"].encode() for t in spec.get("added_tokens", []) if not (literal and t.get("special"))]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(self.line) != 1:
            raise ValueError("a byte-level vocabulary is needed")
        self._forget()

    @staticmethod
    def _same_merges(spec: dict):
        """A quicker engine for the same merges, if the file's ids are in the order of its merges; else None."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            return None
        letters = _byte_letters()
        vocabulary = model["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [vocabulary[m] for m in merged] != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _each(self, items: list[bytes]) -> list[np.ndarray]:
        """Ids of each item. Words are tokenised together: the line feed between them is a token that no word holds."""
        texts = [i.decode("utf-8") for i in items]
        out: list[np.ndarray | None] = [None] * len(texts)
        words = [k for k, t in enumerate(texts) if self.fast and not t[-1].isspace() and max(t) < _PLAIN]
        if words:
            ids = self.fast.encode_to_numpy("\n".join([texts[k] for k in words]), disallowed_special=())
            cuts = np.flatnonzero(ids == self.line[0]).tolist()
            if len(cuts) == len(words) - 1:
                begin = 0
                for k, end in zip(words, [*cuts, len(ids)], strict=True):
                    out[k] = ids[begin:end]
                    begin = end + 1
        return [self.whole(t) if o is None else o for t, o in zip(texts, out, strict=True)]

    def _learn(self, hashes: np.ndarray, items: list[bytes]) -> None:
        ids = self._each(items)
        count = np.array([len(i) for i in ids], np.int64)
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.begin, begin), (self.count, count)))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Chunks of texts: (rows, ids of all of them, where each text ends)."""
        for rows, data, offsets in X.chunks(column):
            starts = _items(data, offsets)
            raw = data.tobytes()
            odd = np.union1d(_odd(data, offsets), _holding(raw, offsets, self.added))
            h = X.span_hashes(data, starts)
            uniq, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
            at, known = self._find(uniq)
            if not known.all():
                if len(self.hashes) + (~known).sum() > REMEMBERED:
                    self._forget()
                    known[:] = False
                ends = np.append(starts[1:], len(data))
                new = sample[~known]
                self._learn(uniq[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
                at, _ = self._find(uniq)
            count, begin = self.count[at][inverse], self.begin[at][inverse]
            total = np.cumsum(count)
            ids = self.ids[np.repeat(begin - total + count, count) + np.arange(total[-1] if len(total) else 0)]
            ends = np.append(0, total)[np.searchsorted(starts, offsets[1:])]
            if len(odd):
                ids, ends = self._replaced(data, offsets, ids, ends, odd)
            yield rows, ids, ends

    def _replaced(self, data, offsets, ids, ends, odd) -> tuple[np.ndarray, np.ndarray]:
        each = np.split(ids, ends[:-1])
        for i in odd.tolist():
            each[i] = self.whole(data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8"))
        return np.concatenate(each), np.cumsum([len(e) for e in each])


def _items(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where items start: words with the blank before them, and white space as the vocabulary's pattern cuts it."""
    n = len(data)
    space = X.IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)  # a word character of the same text stands before
    before[1:] = ~space[:-1]
    after = np.zeros(n, bool)
    after[:-1] = ~space[1:] & ~edge[1:n]
    begins = space & (after | before)
    begins[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    begins |= edge[:n]
    return np.flatnonzero(begins)


def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000 (by their lead bytes)."""
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(lead):
        return lead
    a, b = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)
    return np.unique(np.searchsorted(offsets, lead[hit], "right") - 1)


def _holding(raw: bytes, offsets: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Texts that hold one of ``contents``; a hit across two texts names the first, which does no harm."""
    hits = []
    for c in contents:
        at = raw.find(c)
        while at >= 0:
            hits.append(at)
            at = raw.find(c, at + 1)
    return np.unique(np.searchsorted(offsets, np.array(hits, np.int64), "right") - 1)
