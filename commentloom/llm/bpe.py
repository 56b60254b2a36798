"""Byte-level BPE on batches of texts.

Pre-tokens are found for a whole batch with array operations, each distinct pre-token of the
batch is merged once, and the ids are put back by position. The ids are those of the
`tokenizers` library for the same vocabulary; the tests compare the two.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
BASE = tuple(int(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Factors of the places in a pre-token; they start anew after so many characters.
PLACES = 1 << 12
#: Pre-tokens and their characters that a worker keeps ids of.
STORE_ENTRIES = 100_000
STORE_CHARS = 4 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The tokenizer of one vocabulary file (`tokenizers` format, byte-level, no normaliser)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        vocabulary = {bytes(map(alphabet.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            vocabulary.pop(content.encode(), None)
        self.bytes_of = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        # Byte-level ranks are the ids here: a token's id is the order of its merge.
        self._merger = tiktoken.Encoding(
            "byte-level", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary, special_tokens={}
        )
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self._class = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()
        with np.errstate(over="ignore"):
            self._factors = [np.cumprod(np.full(PLACES, b, np.uint64), dtype=np.uint64) for b in BASE]

    # ---- pre-tokens

    def _classify(self, code: int) -> int:
        """Class of a character as the library's own splitter sees it."""
        c = chr(code)
        for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._splitter.pre_tokenize_str(before + c)) == 1:
                return kind
        return SPACE

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        found = self._class[codes]
        if (found == UNKNOWN).any():
            for code in np.unique(codes[found == UNKNOWN]):
                self._class[code] = self._classify(int(code))
            found = self._class[codes]
        return found

    def starts(self, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each character of texts laid end to end."""
        n = len(codes)
        kind = self._classes(codes)
        first = np.zeros(n, bool)
        first[text_starts[text_starts < n]] = True
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        begin = run.copy()
        # The last white-space character before a word stands alone, or joins it if a blank.
        followed = np.zeros(n, bool)  # a white-space character directly before a word of its text
        followed[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        begin |= followed
        blank = followed & (codes == 32)
        begin[1:] &= ~blank[:-1]
        # Contractions: a lone apostrophe that starts a match, with fixed endings.
        at = np.flatnonzero((codes == 39) & begin)
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
        if len(at):
            one = codes[at + 1]
            two = np.where((at + 2 < n), codes[np.minimum(at + 2, n - 1)], 0)
            two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], two, 0)
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = np.zeros(len(at), bool)
            for a, b in ("re", "ve", "ll"):
                double |= (one == ord(a)) & (two == ord(b))
            for picked, length in ((single, 2), (double, 3)):
                p = at[picked]
                begin[p + 1] = False
                end = p + length
                end = end[end < n]
                begin[end] = True
                # After the ending a blank or space run keeps its own start; letters start anew.
        return begin

    def _hashes(self, codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of each pre-token's characters and length."""
        length = np.diff(np.append(at, len(codes)))
        place = np.arange(len(codes)) - np.repeat(at, length)
        found = []
        for mix, other, factors in zip(MIX, MIX[::-1], self._factors):
            x = (codes.astype(np.uint64) + np.uint64(1)) * mix
            x ^= x >> np.uint64(29)
            x *= factors[place & (PLACES - 1)]
            far = np.flatnonzero(place >= PLACES)
            x[far] *= ((place[far] // PLACES) * 2 + 1).astype(np.uint64)
            sums = np.add.reduceat(x, at)
            sums ^= sums >> np.uint64(32)
            found.append(sums * other + length.astype(np.uint64))
        return found

    def pretokens(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The texts end to end, the character offsets of all pre-tokens, and of all texts."""
        joined = "".join(texts)
        text_starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if not joined:
            return joined, np.zeros(0, np.int64), text_starts
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return joined, np.flatnonzero(self.starts(codes, text_starts[:-1])), text_starts

    def _forget(self) -> None:
        self._slot: dict[str, int] = {}
        self._chars = 0
        self._flat = np.zeros(1 << 16, np.int32)
        self._ends = np.zeros(1 << 14, np.int64)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """Place of each pre-token's ids in the store of this worker."""
        if len(self._slot) > STORE_ENTRIES or self._chars > STORE_CHARS:
            self._forget()
        slots = [self._slot.get(p, -1) for p in pieces]
        missing = [i for i, s in enumerate(slots) if s < 0]
        if missing:
            used = len(self._slot)
            end = int(self._ends[used])
            new: list[int] = []
            ends: list[int] = []
            for i in missing:
                p = pieces[i]
                if (slot := self._slot.setdefault(p, used + len(ends))) == used + len(ends):
                    new += self._merger.encode_ordinary(p)
                    self._chars += len(p)
                    ends.append(end + len(new))
                slots[i] = slot
            if end + len(new) > len(self._flat):
                self._flat = np.concatenate([self._flat, np.zeros(len(self._flat) + len(new), np.int32)])
            if used + len(ends) + 1 > len(self._ends):
                self._ends = np.concatenate([self._ends, np.zeros(len(self._ends) + len(ends), np.int64)])
            self._flat[end : end + len(new)] = new
            self._ends[used + 1 : used + 1 + len(ends)] = ends
        return np.array(slots, np.int64)

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return self._merger.encode_ordinary(piece)

    def encode_pieces(self, texts: list[str]) -> "Encoded":
        """Ids of texts in which no special token occurs, with their pre-tokens."""
        joined, at, text_starts = self.pretokens(texts)
        if not len(at):
            none = np.zeros(0, np.int64)
            return Encoded(none, np.zeros(len(texts) + 1, np.int64), text_starts, none, none, none, self._flat)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        with np.errstate(over="ignore"):
            one, two = self._hashes(codes, at)
        _, head, member = np.unique(one, return_index=True, return_inverse=True)
        if (two[head][member] != two).any():
            # Two pre-tokens share one hash but not the other: take each by itself.
            head = member = np.arange(len(at))
        ends = np.append(at, len(joined))
        slots = self._slots([joined[s:e] for s, e in zip(at[head].tolist(), ends[head + 1].tolist())])
        start = self._ends[slots]
        sizes = self._ends[slots + 1] - start
        return Encoded(at, np.searchsorted(at, text_starts), text_starts, member, start, sizes, self._flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as arrays, special tokens in the text included."""
        found = self.encode_pieces([t if not self.has_special(t) else "" for t in texts]).ids()
        for i, t in enumerate(texts):
            if self.has_special(t):
                found[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
        return found

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def decode(self, ids) -> str:
        """Text of ids, special tokens kept."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


class Encoded:
    """Pre-tokens and ids of a batch.

    `at`: character offset of each pre-token; `of_text`: index of the first pre-token of each
    text, and one past the last; `text_starts`: the same in characters; `member`: which distinct
    pre-token each one is; `start`, `sizes`: place of their ids in `flat`.
    """

    def __init__(self, at, of_text, text_starts, member, start, sizes, flat):
        self.at, self.of_text, self.text_starts = at, of_text, text_starts
        self.member, self.start, self.sizes, self.flat = member, start, sizes, flat

    def counts(self) -> np.ndarray:
        """Number of ids of each pre-token."""
        return self.sizes[self.member]

    def ids(self) -> list[np.ndarray]:
        """Ids of each text."""
        counts = self.counts()
        ends = np.cumsum(counts)
        shift = np.repeat(self.start[self.member] - (ends - counts), counts)
        shift += np.arange(len(shift))
        every = self.flat[shift]
        cuts = np.concatenate([[0], ends])[self.of_text]
        return [every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The tokenizer of a file, once per worker process."""
    return ByteBpe(path)


def default_path() -> str:
    """The public vocabulary the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
