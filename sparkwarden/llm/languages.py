"""Language identification of mixed texts: script ranges, scores per word, and Viterbi over the words.

Learned: for each language, how often each character n-gram (hashed into a table of fixed size) occurs in its words,
and which scripts its letters have.  A word's scores are log-probabilities of its n-grams under each language; languages that
don't use the word's script are out.  The best path through a text's words, where each change of language costs a penalty, labels
spans; the language with most letters is the text's.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: n-gram lengths and the size of their table: bounds what is learned by languages * TABLE numbers.
GRAMS = (1, 2, 3, 4)
TABLE = 1 << 16
SMOOTHING = 0.5
#: Cost of changing the language from one word to the next, and of a language without the word's script (in nats).
SWITCH, WRONG_SCRIPT = 12.0, 50.0
#: Share of a language's letters from which on a script is its own.
SCRIPT_SHARE = 0.01
#: Words whose scores a task works on at a time; different words that it keeps.
WORDS_AT_ONCE, KEPT = 1 << 19, 1 << 20

#: First code point of blocks of letters, and the script they belong to.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"),
    (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"), (0x20000, "Han"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])
#: Number characters that regular expressions take for word characters though they are no letters.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_RUN, _WORD = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{_NUMBERS}]+")


def letters_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    words = _RUN.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    # The set with the number characters is slow to look up, so only runs that hold one are split by it.
    return [part for word in words for part in ([word] if word.isalpha() else _WORD.findall(word))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all n-grams of all words (with a mark at both ends), and which word each belongs to."""
    codes = np.frombuffer(("".join(f"\x02{w}\x03" for w in words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place, whose = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = value[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(value)] == owner[n - 1 :]
            h = value[inside] + np.uint64(n)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            place.append((h >> np.uint64(48)).astype(np.int64) % TABLE)
            whose.append(owner[: len(value)][inside])
    return np.concatenate(place), np.concatenate(whose)


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    return _SCRIPT[np.searchsorted(_FIRST, [ord(w[0]) for w in words], side="right") - 1]


@dataclass(frozen=True)
class Model:
    """Languages in order, log-probability of each table place, and whether each script is a language's own."""

    languages: tuple[str, ...]
    table: np.ndarray  # TABLE x languages, float32
    own: np.ndarray  # scripts x languages, bool

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages."""
        place, whose = grams(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = np.argsort(whose, kind="stable")
        starts = np.searchsorted(whose[order], np.arange(len(words)))
        out += np.add.reduceat(self.table[place[order]], starts, axis=0)
        own = self.own[scripts_of(words)]
        own |= ~own.any(axis=1, keepdims=True)  # a script that no language has tells nothing
        return out - np.where(own, 0, np.float32(WRONG_SCRIPT * 10))


def learned(docs: DataFrame) -> Model:
    """A model from all rows of ``docs`` that have a text and a ``lang``; sums are Spark's, the driver holds the tables.

    Without such rows the model has no languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = {}
        tables: dict[str, np.ndarray] = {}
        n = 0

        def add() -> None:
            for lang, counts in found.items():
                table = tables.setdefault(lang, np.zeros(TABLE + len(_NAMES), np.int64))
                words, times = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for s in range(0, len(words), 1 << 16):
                    some, often = words[s : s + (1 << 16)], times[s : s + (1 << 16)]
                    place, whose = grams(some)
                    table[:TABLE] += np.bincount(place, weights=often[whose], minlength=TABLE).astype(np.int64)
                    letters = often * np.array([len(w) for w in some])
                    table[TABLE:] += np.bincount(scripts_of(some), weights=letters, minlength=len(_NAMES)).astype(np.int64)
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(letters_of(text.as_py()))
            n = sum(map(len, found.values()))
            if n > KEPT:
                add()
        add()
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["lang", "place", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, place long, n long")
    sums = rows.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sums["lang"].unique()))
    counts = np.zeros((TABLE + len(_NAMES), len(languages)))
    counts[sums["place"], np.searchsorted(languages, sums["lang"])] = sums["n"]
    seen, letters = counts[:TABLE], counts[TABLE:]
    table = np.log((seen + SMOOTHING) / (seen.sum(axis=0) + SMOOTHING * TABLE)).astype(np.float32)
    return Model(languages, table, letters >= np.maximum(1, SCRIPT_SHARE * letters.sum(axis=0)))


def paths(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word: rows of ``scores`` follow each other, a text's are offsets[i] .. offsets[i + 1] - 1.

    All texts go one word ahead together, the longest first, so that those still going are the first ones.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    back = np.zeros(scores.shape, np.int16)
    value = scores[starts[: going[0]]].astype(np.float64) if longest else np.zeros((0, scores.shape[1]))
    state = np.zeros(len(sizes), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)[None, :]
    for t in range(1, longest):
        k = going[t]
        if k < len(value):
            state[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        best = value.argmax(axis=1)
        top = value[np.arange(k), best][:, None] - switch
        at = starts[:k] + t
        back[at] = np.where(value >= top, own, best[:, None].astype(np.int16))
        value = np.maximum(value, top) + scores[at]
    state[: len(value)] = value.argmax(axis=1)
    out = np.zeros(len(scores), np.int16)
    for t in range(longest - 1, -1, -1):
        k = going[t]
        at = starts[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return out


class _Scores:
    """Scores of words met so far, one row each."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """Row numbers of words, new ones scored together."""
        if len(self.rows) > KEPT:
            self.rows, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *[self.model.scores(new[s : s + (1 << 15)]) for s in range(0, len(new), 1 << 15)]])
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def identified(docs: DataFrame, model: Model, keys: list[str], switch: float = SWITCH) -> DataFrame:
    """``keys`` of every row of ``docs`` with lang_pred, score (share of letters in it) and spans (first word, words, language).

    A null text, or one without letters, is ``und`` with score 0 and no spans, and so is every text if nothing was learned.
    Languages that tie go by name.
    """
    names = model.languages
    fields = [docs.schema[k] for k in keys]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, spans array<struct<first:long,words:long,lang:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scores(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                words, offsets, start = [], [0], at
                while at < batch.num_rows and (at == start or len(words) < WORDS_AT_ONCE):
                    if names:
                        words += letters_of(texts[at].as_py())
                    offsets.append(len(words))
                    at += 1
                yield pa.RecordBatch.from_arrays([*batch.slice(start, at - start).columns[:-1], *answers(scorer, words, np.array(offsets))], [*keys, "lang_pred", "score", "spans"])

    def answers(scorer: _Scores, words: list[str], offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
        if not words:
            return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array([[]] * n, span)]
        rows = scorer.of(words)
        label = paths(scorer.table[rows], offsets, switch)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(n), np.diff(offsets))
        share = np.zeros((n, len(names)))
        np.add.at(share, (doc, label), sizes)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
        pred = [names[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        first = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))))
        length = np.diff(np.concatenate((first, [len(words)])))
        inner = pa.StructArray.from_arrays([pa.array(first - offsets[doc[first]]), pa.array(length), pa.array([names[x] for x in label[first].tolist()])], ["first", "words", "lang"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(n + 1)), pa.int32()), inner)
        return [pa.array(pred), pa.array(score), spans]

    return docs.select(*keys, "text").mapInArrow(run, out_schema)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the crc32 of the number as text leaves ``part`` (false for a null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans: every text judged by a model of the documents that aren't held out."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    return identified(rows.select("doc_id", "held_out", "text"), learned(rows.where("not held_out")), ["doc_id", "held_out"])
