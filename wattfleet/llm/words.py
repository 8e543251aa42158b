"""Ids of texts by a tokenizer that drops white space, pre-token by pre-token with a bounded table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from wattfleet.llm.bpe import byte_alphabet
from wattfleet.llm.common import held_for_stage
from wattfleet.llm.fragments import FragmentTable, blocks, flat

MARK = "<|endoftext|>"
#: Bytes of text that are cut into fragments at a time.
BLOCK = 1 << 19
# Classes of bytes: white space, letters (all beyond ASCII that isn't odd), digits, all else.
_SPACE, _LETTER, _DIGIT, _ELSE = range(4)
CLASSES = np.full(256, _ELSE, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = _SPACE
CLASSES[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = _LETTER
CLASSES[ord("0") : ord("9") + 1] = _DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes whose words are left to the tokenizer as a whole: apostrophes, and lead bytes of all but U+00C0-U+00FF (of these, so are the signs U+00D7 and U+00F7).
ODD = np.zeros(256, bool)
ODD[[0x27, 0xC2, *range(0xC4, 256)]] = True


def words_and_oddity(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: its class, whether a text starts there, whether a word does, and whether its word is odd."""
    kind = CLASSES[data]
    begins = np.zeros(len(data), bool)
    begins[at[:-1][at[:-1] < len(data)]] = True
    space = kind == _SPACE
    start = ~space
    start[1:] &= space[:-1] | begins[1:]
    odd = ODD[data]
    lead = data[:-1] == 0xC3
    odd[1:] |= lead & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|")) & ~begins[1:]
    word = np.cumsum(start)
    bad = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
    bad[word[odd]] = True
    return kind, begins, start, bad[word] & ~space


class WordEncoder:
    """Encodes as Tokenizer.encode(text, add_special_tokens=False), but each distinct pre-token once.

    Right for vocabularies that lower-case, drop white space and cut texts into runs of letters,
    single digits and runs of all else. Words of ASCII and of the letters from U+00C0 to U+00FF are
    cut so; words with other characters, apostrophes (contractions) or special tokens are encoded
    whole. Many of those are encoded at a time, with a special token between them. special=False
    takes the texts of special tokens as ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        self.tokenizer, self.own = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.own):
            t.no_truncation()
            t.no_padding()
        self.own.encode_special_tokens = not special
        self.mark = self.tokenizer.token_to_id(MARK)
        self.alphabet = byte_alphabet()
        probe = "A  b\n c ÀÖàö12 x$$%.y ß.Ö9é"
        plain = [i for w in probe.lower().split() for p in _pre_tokens(w) for i in self.merged(p.encode())]
        if self.mark is None or self.own.encode(probe, add_special_tokens=False).ids != plain:
            raise ValueError("a vocabulary that lower-cases, drops white space, cuts at letters and digits and has an end-of-text token is needed")
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.table = FragmentTable(self.learn, self.kind)

    def merged(self, fragment: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(fragment.decode("latin-1").translate(self.alphabet))]

    def learn(self, fragments: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(fragments)
        whole = []
        for i, f in enumerate(fragments):
            if f.isalnum():  # of ASCII alone
                out[i] = self.merged(f)
            elif b"<|" in f:
                out[i] = self.own.encode(f.decode(), add_special_tokens=False).ids
            elif f.translate(None, _FAST) or b"\xc3\x97" in f or b"\xc3\xb7" in f:
                whole.append(i)
            else:
                out[i] = self.merged(f)
        for k in range(0, len(whole), 1000):
            some = whole[k : k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([MARK.join([fragments[i].decode() for i in some])], add_special_tokens=False)[0].ids, np.int64)
            for i, x in zip(some, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                out[i] = x[x != self.mark].tolist()
        return out

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, lower-cased but for odd words, and where fragments start and end in them."""
        kind, begins, start, odd = words_and_oddity(data, at)
        low = LOWER[data]
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        low[1:] += (accent * 32).astype(np.uint8)
        low = np.where(odd, data, low)
        first = start.copy()
        first[1:] |= ~odd[1:] & (kind[1:] != _SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        last = kind != _SPACE
        last[:-1] &= first[1:] | (kind[1:] == _SPACE)
        return low, np.flatnonzero(first), np.flatnonzero(last) + 1

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and how many each has; null counts as empty."""
        data, at = flat(texts)
        ids, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for a, b in blocks(at, BLOCK):
            own = at[a : b + 1] - at[a]
            low, starts, ends = self.cut(data[at[a] : at[b]], own)
            found, n = self.table.encode(low, starts, ends)
            sums = np.concatenate([[0], np.cumsum(n)])
            ids.append(found)
            counts.append(np.diff(sums[np.searchsorted(starts, own)]))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """For each text its ids as little-endian bytes of `kind`; null counts as empty."""
        ids, counts = self.encode_flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        data, size = ids.tobytes(), self.kind.itemsize
        ends = (np.cumsum(counts) * size).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _pre_tokens(word: str) -> list[str]:
    """A probe's word in pre-tokens."""
    out: list[str] = []
    for c in word:
        same = out and not c.isdigit() and not out[-1][-1].isdigit() and c.isalpha() == out[-1][-1].isalpha()
        out = [*out[:-1], out[-1] + c] if same else [*out, c]
    return out


#: Bytes of fragments that go straight to the merges, but for the signs U+00D7 and U+00F7.
_FAST = bytes(b for b in range(256) if not ODD[b])


@held_for_stage
def word_encoder(path: str, special: bool = True) -> WordEncoder:
    """One for each worker process, vocabulary and way with special tokens, as long as the stage lasts."""
    return WordEncoder(path, special)
