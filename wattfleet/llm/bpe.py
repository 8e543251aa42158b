"""BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no vocabulary token can't be bridged by any merge, so a cut
between them is certain. Pre-tokens are cut there, the fragments are encoded independently and
their ids are concatenated. Fragments are short and repeat, so each worker keeps a bounded table of
those it has encoded; cuts and look-ups are array work over a block of texts. Work is per row and
per batch: the operator needs no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from wattfleet.llm.fragments import FragmentTable, blocks, flat, ragged

#: The pre-token pattern of byte-level BPE.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PRE_TOKENS)
#: White space beyond ASCII's six: texts with it are split by the pattern alone.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text that are cut into fragments at a time.
BLOCK = 1 << 19
# Classes of bytes: white space, letters (of U+00C0-U+00FF beyond ASCII), digits, all else.
_SPACE, _LETTER, _DIGIT, _ELSE = range(4)
_CLASSES = np.full(256, _ELSE, np.uint8)
_CLASSES[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASSES[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = _LETTER
_CLASSES[ord("0") : ord("9") + 1] = _DIGIT
#: Bytes whose words the pattern splits: apostrophes, and lead bytes of all but U+00C0-U+00FF (of these, so are the signs U+00D7 and U+00F7).
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0xC2, *range(0xC4, 256)]] = True
#: Lead bytes of white space beyond ASCII, and ASCII's separators.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ForcedBoundaryCodec:
    """Encodes and decodes as the vocabulary file's tokenizer does, without its post-processing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        vocab = spec["model"]["vocab"]
        self.model = BPE(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        self.shown = byte_alphabet()
        back = {c: b for b, c in self.shown.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        inside = np.zeros((256, 256), bool)
        for b in self.bytes_of.values():
            for x, y in zip(b, b[1:]):
                inside[x, y] = True
        self.inside = inside
        self.special = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that take white space with them aren't covered")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        ids = max(self.bytes_of) + 1
        self.table = FragmentTable(self.learn, np.dtype("<i4"))
        self.token_n, self.token_at, self.token_pool = _pool([self.bytes_of.get(i, b"") for i in range(ids)])
        self.text_n, self.text_at, self.text_pool = _pool([b"%d," % i for i in range(ids)])

    def merged(self, fragment: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.shown))]

    def fragments(self, pre_token: bytes) -> list[bytes]:
        """A pre-token, cut between every two bytes that no token holds side by side."""
        a = np.frombuffer(pre_token, np.uint8)
        ends = [0, *(np.flatnonzero(~self.inside[a[:-1], a[1:]]) + 1).tolist(), len(a)]
        return [pre_token[x:y] for x, y in zip(ends, ends[1:])]

    def split(self, text: str) -> list[int]:
        """Ids of a text by the pattern, without special tokens."""
        return [i for w in _WORDS.findall(text) for f in self.fragments(w.encode()) for i in self.merged(f)]

    def parts(self, text: str) -> list[int]:
        """Ids of a text by the pattern; texts of special tokens are those tokens."""
        ids, at = [], 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            ids += [*self.split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return ids + self.split(text[at:])

    def learn(self, fragments: list[bytes]) -> list[list[int]]:
        return [self.merged(f) if _simple(f) else self.parts(f.decode()) for f in fragments]

    def cut(self, data: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where fragments start and end: at pre-tokens and forced boundaries. Odd words are one with a blank before them, texts of `whole` altogether."""
        kind = _CLASSES[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        begins = begins[:-1]
        space = kind == _SPACE
        before = np.append(False, space[:-1]) & ~begins
        word = ~space
        word[1:] &= space[:-1] | begins[1:]
        odd = _ODD[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|")) & ~begins[1:]
        number = np.cumsum(word)
        bad = np.zeros(int(number[-1]) + 1 if len(number) else 1, bool)
        bad[number[odd]] = True
        odd = bad[number] & ~space
        # a blank right before a word belongs to it
        joins = np.append(False, data[:-1] == 32) & word & ~begins
        start = word & ~joins
        start[1:] |= ~space[1:] & ~space[:-1] & ~odd[1:] & (kind[1:] != kind[:-1])
        start[1:] |= ~space[1:] & ~odd[1:] & ~self.inside[data[:-1], data[1:]] & ~word[1:]
        # white space: a run starts, and its last character is by itself before a word
        start |= space & ~before
        start[:-1] |= space[:-1] & word[1:] & ~begins[1:]
        start |= begins
        # a cut inside a run of white space, or between a blank and its word
        forced = np.append(False, ~self.inside[data[:-1], data[1:]])
        start |= forced & (space & before)
        start |= forced & joins & ~odd
        if len(whole):
            inner = np.zeros(len(data) + 1, np.int32)
            np.add.at(inner, at[whole], 1)
            np.add.at(inner, at[whole + 1], -1)
            start &= (np.cumsum(inner)[:-1] == 0) | begins
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(data))

    def alone(self, text: str) -> bool:
        """Whether a text is left to the pattern as a whole."""
        return bool(_ODD_SPACE.search(text) or self.split_special and self.split_special.search(text))

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and how many each has; null counts as empty."""
        data, at = flat(texts)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in blocks(at, BLOCK):
            own, part = at[a : b + 1] - at[a], data[at[a] : at[b]]
            hint = _MAYBE_SPACE[part]
            hint[:-1] |= (part[:-1] == ord("<")) & (part[1:] == ord("|"))
            maybe = np.unique(np.searchsorted(own, np.flatnonzero(hint), "right") - 1)
            whole = np.array([i for i in maybe.tolist() if self.alone(part[own[i] : own[i + 1]].tobytes().decode())], np.int64)
            starts, ends = self.cut(part, own, whole)
            found, n = self.table.encode(part, starts, ends)
            sums = np.concatenate([[0], np.cumsum(n)])
            ids.append(found)
            counts.append(np.diff(sums[np.searchsorted(starts, own)]))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, text: str) -> list[int]:
        return self.encode_flat(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: np.ndarray, counts: np.ndarray, n: np.ndarray, at: np.ndarray, pool: np.ndarray) -> list[bytes]:
        """For each text the pool's bytes of its ids, one after another."""
        data = ragged(pool, at[ids], n[ids]).tobytes()
        sums = np.concatenate([[0], np.cumsum(n[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(sums, sums[1:])]


#: Bytes of fragments that go straight to the merges, but for the signs U+00D7 and U+00F7.
_PLAIN = bytes(b for b in range(256) if not _ODD[b] and not 0x1C <= b <= 0x1F)


def _simple(fragment: bytes) -> bool:
    return not fragment.translate(None, _PLAIN) and b"\xc3\x97" not in fragment and b"\xc3\xb7" not in fragment and b"<|" not in fragment


def _pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, places and bytes of values, one after another."""
    n = np.array([len(v) for v in values], np.int64)
    return n, np.cumsum(n) - n, np.frombuffer(b"".join(values), np.uint8)


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One for each worker process and vocabulary."""
    return ForcedBoundaryCodec(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Every text's ids and what they decode to: id, n_tokens, ids (if with_ids), ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8.
    A null text counts as empty: no ids, and the digests of the empty string. A null or repeated
    identifier is carried as it is, one output row per input row. The text of a special token is
    encoded as that token. Very long texts are cut and encoded whole, an empty table gives no rows.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                ids, counts = c.encode_flat(batch.column(1)[k : k + 500])
                ids_text = [hashlib.sha256(x[:-1]).hexdigest() for x in c.joined(ids, counts, c.text_n, c.text_at, c.text_pool)]
                decoded = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in c.joined(ids, counts, c.token_n, c.token_at, c.token_pool)]
                cols = [batch.column(0)[k : k + 500], pa.array(counts, pa.int64())]
                cols += [pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids_text, pa.string()), pa.array(decoded, pa.string())], names)

    slim = docs.select(F.col(id_col), F.col(text_col))
    names = [id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    kinds = [slim.schema[0].dataType.simpleString(), "long", *["array<int>"] * with_ids, "string", "string"]
    return slim.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
