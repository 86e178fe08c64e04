"""Token ids of whole texts from a library tokenizer, with the answers for words kept in a table of fixed size.

Most words of a text were met before. Where a tokenizer lower-cases, drops blanks and splits into runs of letters,
single digits and runs of signs, texts are split and looked up as arrays of code units, many at a time; only words that
the table doesn't hold go to the library's model.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from tallyspark.llm.runs import BLOCK, RunHashes, cut, units

BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
#: Endings that the splitter keeps with their apostrophe.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_PROBES = ("Word,", "Éa1b22!!", "x|y-Z", "3.14", "don't", "L'HOMME'", "''re", "'Llama", "a's't", "ΣΑΣ «Ђя»…")


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower-case form of each code unit.

    A character is OTHER, and its text the library's, if normalisation or lower case may depend on its neighbours or
    make another number of characters of it, or if it is newer than Unicode 3.2, so that libraries may differ.
    """
    kinds, lower = np.full(1 << 16, OTHER, dtype=np.uint8), np.full(1 << 16, ord("?"), dtype=np.uint16)
    named = {"L": LETTER, "N": DIGIT, "P": SIGN, "S": SIGN}
    for i in range(1 << 16):
        c = chr(i)
        small = c.lower()
        kind = named.get(unicodedata.category(c)[0])
        old = unicodedata.ucd_3_2_0.category(c)[0]
        if kind is not None and old == unicodedata.category(c)[0] and len(small) == 1 and ord(small) < 1 << 16 and unicodedata.normalize("NFC", c) == c and not 0x1100 <= i < 0x1200:
            kinds[i], lower[i] = kind, ord(small)
    for c in " \n\r\t":
        kinds[ord(c)], lower[ord(c)] = BLANK, ord(" ")
    return kinds, lower


def vocabulary(path: str) -> tuple[int, np.dtype]:
    """The number of ids, and the type that holds them."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    return size, np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


class WordIds:
    """Ids as ``tokenizer.encode(text, add_special_tokens=False)`` gives them, without truncation or padding.

    Probes tell if the tokenizer splits as described above; if not, every text goes to the library.
    """

    def __init__(self, path: str, slots_log2: int = 19):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.tokenize = self.tokenizer.model.tokenize
        self.spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.kinds, self.lower = alphabet()
        self.hashes = RunHashes()
        self.shift = np.uint64(64 - slots_log2)
        self.keys = np.zeros(1 << slots_log2, dtype=np.uint64)
        self.begins, self.counts = np.zeros(1 << slots_log2, dtype=np.int32), np.zeros(1 << slots_log2, dtype=np.int32)
        self.flat, self.used = np.zeros(6 << slots_log2, dtype=self.dtype), 0
        text = "\n a \r\n".join(_PROBES)
        self.plain = np.array_equal(self._looked_up([text])[0], self._encoded(text))

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.tokenize(word if word.isascii() else self.spelt(word)[0][0])]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.plain:
            return [self._encoded(t) for t in texts]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        group, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for part in cut(text):
                if len(part) > BLOCK or "<|" in part:  # special tokens begin like this
                    part = self._encoded(part)
                    if owners and owners[-1] == i:
                        self._flush(group, owners, found)
                        size = 0
                    found[i].append(part)
                    continue
                group.append(part)
                owners.append(i)
                size += len(part)
                if size > BLOCK:
                    self._flush(group, owners, found)
                    size = 0
        self._flush(group, owners, found)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, dtype=self.dtype) for x in found]

    def _flush(self, group: list[str], owners: list[int], found: list[list[np.ndarray]]) -> None:
        for i, ids in zip(owners, self._looked_up(group), strict=True):
            found[i].append(ids)
        group.clear()
        owners.clear()

    def _looked_up(self, parts: list[str]) -> list[np.ndarray]:
        if not parts:
            return []
        raw = [units(p + "\n") for p in parts]
        every = np.frombuffer(b"".join(raw), dtype="<u2")
        first = np.cumsum([0, *(len(r) // 2 for r in raw)])
        kinds, codes = self.kinds[every], self.lower[every]
        other = set(np.unique(np.searchsorted(first, np.flatnonzero(kinds == OTHER), "right") - 1).tolist())
        begins, ends = _words(every, codes, kinds)
        hashes = self.hashes(codes, begins, ends)
        at, counts = self._entries(hashes, codes, begins, ends)
        last = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(at - last[:-1], counts) + np.arange(last[-1])]
        edges = last[np.searchsorted(begins, first)]
        return [self._encoded(p) if i in other else ids[edges[i] : edges[i + 1]] for i, p in enumerate(parts)]

    def _entries(self, hashes: np.ndarray, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``flat``, and how many there are."""
        if self.used > len(self.flat) * 7 // 8:
            self.keys[:], self.used = 0, 0
        slots = (hashes >> self.shift).astype(np.int64)
        at, counts = self.begins[slots].astype(np.int64), self.counts[slots].astype(np.int64)
        missed = np.flatnonzero(self.keys[slots] != hashes)
        if len(missed):
            new, one, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            small = codes.tobytes().decode("utf-16-le")
            made, sizes = [], []
            for b, e in zip(begins[missed[one]].tolist(), ends[missed[one]].tolist(), strict=True):
                ids = self._word(small[b:e])
                made += ids
                sizes.append(len(ids))
            if self.used + len(made) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * len(made), dtype=self.dtype)])
            sizes = np.array(sizes, dtype=np.int64)
            start = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + len(made)] = made
            self.used += len(made)
            at[missed], counts[missed] = start[which], sizes[which]
            slots = (new >> self.shift).astype(np.int64)
            self.keys[slots], self.begins[slots], self.counts[slots] = new, start, sizes
        return at, counts


def _words(raw: np.ndarray, codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of letters or signs, single digits, endings with their apostrophe."""
    edge = np.empty(len(kinds), dtype=bool)
    edge[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
    edge |= (kinds == DIGIT) | (kinds == BLANK)
    for i in np.flatnonzero(raw == ord("'")).tolist():
        if edge[i] and kinds[i + 1] == LETTER:
            after = "".join(map(chr, codes[i + 1 : i + 3].tolist()))
            n = next((len(x) for x in _ENDINGS if after.startswith(x)), 0)
            if n:
                edge[i + 1], edge[i + 1 + n] = False, True
    at = np.flatnonzero(edge)
    word = kinds[at] != BLANK
    return at[word], np.append(at[1:], len(kinds))[word]
