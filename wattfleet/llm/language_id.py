"""Language identification: scripts narrow the candidates, Viterbi labels spans.

Every word has a score per language, from character trigrams learned by counting. Languages that
hardly use the word's script are no candidates for it. The best sequence of labels over a text's
words, where each switch of language costs a penalty, gives the spans of mixed-language text.
Counting is a Spark aggregation over a bounded sample; labelling is a narrow map with whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from wattfleet.llm.common import memory_returned
from wattfleet.llm.fragments import sliced

UNKNOWN = "und"
#: Different words of the sample that are counted before their trigrams are, and code points that are scored at a time.
CACHED, PIECE = 250_000, 1 << 18
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Ranges of code points by script; what lies in none counts as "other".
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


#: Scripts by number, and for every code point where ranges start or end the script from there on.
NAMES = sorted({x[0] for x in SCRIPTS}) + ["other"]
_EDGES = sorted({e for _, a, b in SCRIPTS for e in (a, b + 1)} | {0})
_FROM = np.array([next((NAMES.index(s) for s, a, b in SCRIPTS if a <= e <= b), len(NAMES) - 1) for e in _EDGES])


def scripts_of(words: list[str]) -> np.ndarray:
    """The number of the script of each word's first letter."""
    return _FROM[np.searchsorted(_EDGES, [ord(w[0]) for w in words], "right") - 1]


def grams(word: str) -> list[str]:
    """Trigrams of the word between word ends."""
    w = f"^{word.lower()}$"
    return [a + b + c for a, b, c in zip(w, w[1:], w[2:])]


class Model:
    """Trigram counts by language, and which scripts each language uses."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]], smoothing: float = 0.5, least_script: float = 0.002):
        self.langs = sorted(counts)
        known = sorted(set().union(*counts.values())) if counts else []
        self.row = {g: i for i, g in enumerate(known)}
        self.logp = np.zeros((len(known) + 1, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            below = math.log(sum(counts[lang].values()) + smoothing * (len(known) + 1))
            self.logp[:, j] = math.log(smoothing) - below
            for g, n in counts[lang].items():
                self.logp[self.row[g], j] = math.log(n + smoothing) - below
        #: by script and language: whether the language uses the script
        self.may = np.array([[scripts[lang].get(s, 0) >= max(1, least_script * sum(scripts[lang].values())) for lang in self.langs] for s in NAMES]).reshape(len(NAMES), len(self.langs))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities by word and language, 0 at best; words no candidate could have written say nothing."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        get, each = self.row.get, [grams(w) for w in words]
        rows = np.array([get(g, -1) for gs in each for g in gs])
        return self.narrowed(rows, np.cumsum([0, *map(len, each[:-1])]), scripts_of(words))

    def narrowed(self, rows: np.ndarray, starts: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        """The same from the rows of all words' trigrams, where each word's start, and the words' scripts."""
        s = np.add.reduceat(self.logp[rows], starts, 0)
        may = self.may[scripts]
        s = np.where(may, s, -np.inf)
        best = s.max(1, keepdims=True)
        return np.where(may.any(1, keepdims=True), np.maximum(s - np.where(np.isfinite(best), best, 0), -30), 0).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels [T, B] for scores [T, B, L]; columns end at lengths, what lies beyond is to be ignored."""
    steps, b, n = scores.shape
    by_lang = np.ascontiguousarray(scores.transpose(0, 2, 1))
    stay, best = np.empty((steps, n, b), bool), np.zeros((steps, b), np.int16)
    v, cols = np.zeros((n, b), np.float32), np.arange(b)

    def leading(into: np.ndarray) -> np.ndarray:
        """The largest of each column; into gets its language, the first in ties."""
        top = v[0].copy()
        for j in range(1, n):
            into[v[j] > top] = j
            np.maximum(top, v[j], out=top)
        return top

    for t in range(steps):
        v -= leading(best[t])
        # the best label now counts 0, so a switch to any other starts at the penalty
        np.greater_equal(v, np.float32(-penalty), out=stay[t])
        np.maximum(v, np.float32(-penalty), out=v)
        v += by_lang[t]
    labels, now = np.empty((steps, b), np.int16), np.zeros(b, np.int16)
    leading(now)
    for t in range(steps - 1, -1, -1):
        labels[t] = now
        now = np.where(stay[t, now, cols], now, best[t])
    return labels


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for letters and 2 for marks; its lower case; whether that depends on what stands around it or is several code points."""
    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    all_ = points.tobytes().decode("utf-32-le")
    kind, lower, odd = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for number, runs in ((1, regex.finditer(r"\p{L}+", all_)), (2, regex.finditer(r"\p{M}+", all_))):
        for m in runs:
            kind[points[m.start()] : points[m.end() - 1] + 1] = number
    for c in np.flatnonzero(kind).tolist():
        low = chr(c).lower()
        lower[c], odd[c] = ord(low[0]), len(low) > 1 or low == "\u03c3"
    return kind, lower, odd


class Labeller:
    """Labels batches of texts by array work on their code points; one for each task."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        known = sorted({c for g in model.row for c in g} - {"^", "$"})
        # classes of code points: 0 for what no trigram holds, 1 and 2 for word ends
        self.classes = len(known) + 3
        numbers = {"^": 1, "$": 2, **{c: i for i, c in enumerate(known, 3)}}
        kind, lower, odd = characters()
        by_lower = np.zeros(0x110000, np.int64)
        by_lower[[ord(c) for c in known]] = np.arange(3, self.classes)
        self.kind, self.odd, self.cls = kind, odd, by_lower[lower]
        codes = np.array([(numbers[g[0]] * self.classes + numbers[g[1]]) * self.classes + numbers[g[2]] for g in model.row], np.int64)
        order = np.argsort(codes)
        self.codes, self.rows = codes[order], np.array(list(model.row.values()), np.int64)[order]
        self.dense = None
        if self.classes**3 <= 1 << 22:
            self.dense = np.full(self.classes**3, -1, np.int32)
            self.dense[codes] = list(model.row.values())

    def trigram_rows(self, code: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[code]
        if not len(self.codes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rows[at], -1)

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end: a letter, with the letters and marks that follow."""
        kind = self.kind[codes]
        inside = np.concatenate([[False], kind > 0, [False]])
        begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        letters = np.append(np.flatnonzero(kind == 1), len(codes))
        begin = letters[np.searchsorted(letters, begin)]
        some = begin < end
        return begin[some], end[some]

    def scores(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of words, some PIECE code points at a time."""
        out, a = [np.zeros((0, len(self.model.langs)), np.float32)], 0
        while a < len(begin):
            b = max(a + 1, int(np.searchsorted(end, begin[a] + PIECE, "right")))
            low = int(begin[a])
            start, stop = begin[a:b] - low, end[a:b] - low
            part = codes[low : low + stop[-1]]
            if self.odd[part].any():
                text = part.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                out.append(self.model.scores([text[i:j] for i, j in zip(start.tolist(), stop.tolist())]))
            else:
                now = self.cls[part]
                before, after = np.append(1, now[:-1]), np.append(now[1:], 2)
                before[start], after[stop - 1] = 1, 2
                size = stop - start
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
                rows = self.trigram_rows((before[at] * self.classes + now[at]) * self.classes + after[at])
                out.append(self.model.narrowed(rows, ends - size, _FROM[np.searchsorted(_EDGES, part[start], "right") - 1]))
            a = b
        return np.concatenate(out)

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the label and the letters of every word."""
        # a blank between texts ends their words
        joined = np.frombuffer(" ".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
        begin, end = self.words(joined)
        first = np.searchsorted(begin, at)
        scores, sizes = self.scores(joined, begin, end), end - begin
        each = [(int(a), int(b)) for a, b in zip(first, first[1:])]
        out: list = [(np.zeros(0, np.int16), sizes[a:b]) for a, b in each]
        order = sorted((i for i, (a, b) in enumerate(each) if b > a), key=lambda i: each[i][1] - each[i][0])
        k = 0
        while k < len(order):  # texts of like length together, of some 4 million scores at most
            last = k + 1
            while last < len(order) and (each[order[last]][1] - each[order[last]][0]) * (last + 1 - k) * len(self.model.langs) <= 4_000_000:
                last += 1
            some = order[k:last]
            lengths = np.array([each[i][1] - each[i][0] for i in some])
            dealt = np.zeros((lengths[-1], len(some), len(self.model.langs)), np.float32)
            for j, i in enumerate(some):
                dealt[: lengths[j], j] = scores[slice(*each[i])]
            labels = viterbi(dealt, lengths, self.penalty)
            for j, i in enumerate(some):
                out[i] = labels[: lengths[j], j].copy(), out[i][1]
            k = last
        return out


def by_size(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some `most` characters together; a longer text is by itself."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most and i > a:
            yield a, i
            a, size = i, len(t or "")
    if a < len(texts):
        yield a, len(texts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 20_000) -> Model:
    """Learns from labelled documents: those with a text and a lang.

    Bound: if there are more than max_docs, only those are counted whose hash of identifier and text
    falls into the first max_docs / count of its range, so about max_docs. All of their trigrams
    count (on sf0.1 no language has 3,000 different ones).
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    n = rows.count()
    if n > max_docs:
        rows = rows.filter(F.col("h") < int(-(2**63) + 2**64 * (max_docs / n)))
    rows = rows.repartition(64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                seen.update((lang.as_py(), w) for w in _WORD.findall(text.as_py()))
                if len(seen) > CACHED:
                    yield from flush(n, seen)
        yield from flush(n, seen)

    def flush(n: Counter, seen: Counter) -> Iterator[pa.RecordBatch]:
        for ((lang, w), k), script in zip(seen.items(), scripts_of([w for _, w in seen])):
            n[lang, "script", NAMES[script]] += k * len(w)
            for g in grams(w):
                n[lang, "gram", g] += k
        seen.clear()
        langs, kinds, keys = zip(*n) if n else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (langs, kinds, keys)] + [pa.array(n.values(), pa.int64())], ["lang", "kind", "key", "n"])
        n.clear()

    counted = rows.select("text", "lang").mapInArrow(memory_returned(count), "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    scripts: dict[str, dict[str, int]] = {}
    for r in counted.collect():
        (scripts if r.kind == "script" else counts).setdefault(r.lang, {})[r.key] = r.n
    return Model({lang: counts.get(lang, {}) for lang in scripts}, scripts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 6.0, with_spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score, and spans (start, end, lang) if with_spans; text_col may be a field of a struct.

    lang_pred is the language of most letters, the alphabetically first in ties, score their share.
    A text that is null or without a letter is `und` with score 0, and so is every text if nothing
    was learned. Spans run from their first word to their last. Existing columns of the added
    names are replaced. Only the text enters a prediction, the whole of it however long; rows that
    repeat get the same one, and an empty table gives no rows.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "spans")]
    # a text inside a column that goes along isn't sent twice
    outer, _, inner = text_col.partition(".")
    nested = bool(inner) and outer in names
    slim = docs.select(*names, *([] if nested else [F.col(text_col).alias("__li_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        n = len(model.langs)
        for batch in sliced(batches, 1000):
            all_texts = (pc.struct_field(batch.column(names.index(outer)), inner) if nested else batch.column(len(names))).to_pylist()
            for k, end in by_size(all_texts):
                texts = all_texts[k:end]
                langs, scores, spans = [], [], []
                for text, (labels, letters) in zip(texts, labeller.label(texts) if n else [(np.zeros(0, int), ())] * len(texts)):
                    by = np.bincount(labels, letters, n) if len(labels) else ()
                    langs.append(model.langs[int(np.argmax(by))] if len(by) else UNKNOWN)
                    scores.append(float(by.max() / by.sum()) if len(by) else 0.0)
                    if with_spans:
                        own = []
                        for m, lang in zip(_WORD.finditer(text or ""), labels):
                            if not own or own[-1]["lang"] != model.langs[lang]:
                                own.append({"start": m.start(), "end": m.end(), "lang": model.langs[lang]})
                            own[-1]["end"] = m.end()
                        spans.append(own)
                cols = [batch.column(i)[k:end] for i in range(len(names))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                cols += [pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] if with_spans else []
                yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", *["spans"] * with_spans])

    spans = StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])))
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), *[spans] * with_spans]
    return slim.mapInArrow(memory_returned(run), StructType([*slim.schema.fields[: len(names)], *added]))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of the identifier as text leaves 1 modulo 3 (false for null)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
