"""The languages of each mail and of its parts, with a confidence.

Words of the sender's own prose are scored for each language (known words by their counts, unknown ones by their
trigrams); the script of a word narrows the candidates first. A Viterbi pass with a penalty for switching, lower between
sentences, labels spans of one language. Mails of a batch are padded and run through the pass together.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.mails import prose_lines
from loglattice.session import materialise, pinned, ship

# The codes and names by which each language may be labelled (ISO 639-1, 639-2/B, 639-2/T, English, native).
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "ger", "deu", "german", "deutsch"),
    "fr": ("fr", "fre", "fra", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "dut", "nld", "dutch", "nederlands"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
}
LANGS = tuple(NAMES)
CYRILLIC = frozenset({"ru"})

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NO_PROSE = re.compile(r"\s*\[|.*\t|.*[{}<>|\\=]{2}|\s*\S+://\S+\s*\Z")
_NO_WORD = re.compile(r"\S*[@/\\_=<>\d]\S*|\S+\.\S+\.\S+")
_END = re.compile(r"[.!?…]\s")


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, with or without country, in any case; null for other labels."""
    low = F.lower(F.trim(label))
    base = F.when(low.rlike(r"\A[a-z]{2,3}[-_][a-z0-9]{2,4}\z"), F.regexp_extract(low, r"\A([a-z]+)", 1)).otherwise(low)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(base.isin(*names), F.lit(code)).otherwise(out)
    return out


def folded(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def script_of(word: str) -> str:
    """latin, cyrillic or other, by the ranges of its first letter."""
    c = ord(word[0])
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin"
    return "cyrillic" if 0x400 <= c < 0x530 else "other"


def own_words(text: str | None) -> tuple[list[str], list[bool]]:
    """Words of the own prose, and whether each begins a sentence or line. Words of no known script are left out."""
    words: list[str] = []
    starts: list[bool] = []
    for line in prose_lines(text):
        if not line.strip() or _NO_PROSE.match(line):
            continue
        for sentence in _END.split(line):
            first = True
            for w in _WORD.findall(_NO_WORD.sub(" ", sentence)):
                if script_of(w) != "other":
                    words.append(w)
                    starts.append(first)
                    first = False
    return words, starts


@dataclass
class Model:
    """Scores of words and trigrams: rows of log probabilities by language, in the order of LANGS."""

    words: dict[str, int]
    word_scores: np.ndarray
    trigrams: dict[str, int]
    trigram_scores: np.ndarray
    floor: float = -6.0

    def __post_init__(self):
        self._rows: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_rows"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._rows = {}

    def row(self, word: str) -> np.ndarray:
        """Log scores of a word by language, the best at 0 and none below the floor."""
        got = self._rows.get(word)
        if got is None:
            low = folded(word)
            k = self.words.get(low)
            if k is not None:
                s = self.word_scores[k]
            else:
                marked = f"^{low}$"
                rows = [self.trigrams[g] for i in range(len(marked) - 2) if (g := marked[i : i + 3]) in self.trigrams]
                s = self.trigram_scores[rows].sum(0) * 0.5 if rows else np.zeros(len(LANGS), np.float32)
            s = np.maximum(s - s.max(), self.floor)
            cyr = script_of(word) == "cyrillic"
            s = np.where([(c in CYRILLIC) == cyr for c in LANGS], s, 2 * self.floor)
            if len(self._rows) > 300_000:
                self._rows.clear()
            got = self._rows[word] = (s - s.max()).astype(np.float32)
        return got


def fitted(counts: dict[tuple[str, str], int], smooth: float = 0.3) -> Model:
    """A model from counts of (folded word, language)."""
    index = {c: i for i, c in enumerate(LANGS)}
    words = {w: i for i, w in enumerate(sorted({w for w, _ in counts}))}
    table = np.zeros((len(words), len(LANGS)))
    grams: Counter = Counter()
    for (w, c), n in counts.items():
        table[words[w], index[c]] += n
        marked = f"^{w}$"
        for i in range(len(marked) - 2):
            grams[marked[i : i + 3], c] += n
    total = table.sum(0) + 1
    scores = np.log((table + smooth) / (total + smooth * max(1, len(words))))
    keys = {g: i for i, g in enumerate(sorted({g for g, _ in grams}))}
    tri = np.zeros((len(keys), len(LANGS)))
    for (g, c), n in grams.items():
        tri[keys[g], index[c]] += n
    tri_scores = np.log((tri + 0.5) / (tri.sum(0) + 1 + 0.5 * max(1, len(keys))))
    return Model(words, scores.astype(np.float32), keys, tri_scores.astype(np.float32))


def viterbi(scores: list[np.ndarray], starts: list[list[bool]], inner: float = 9.0, between: float = 6.0, cells: int = 200_000) -> list[np.ndarray]:
    """The best language index of every word of each document; documents of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
    n_lang, at = len(LANGS), 0
    while at < len(order):
        group = [order[at]]
        while at + len(group) < len(order) and len(scores[order[at + len(group)]]) * (len(group) + 1) <= cells:
            group.append(order[at + len(group)])
        at += len(group)
        n, size = len(group), len(scores[group[-1]])
        e, pen = np.zeros((size, n, n_lang), np.float32), np.full((size, n, 1), 1e9, np.float32)
        for j, k in enumerate(group):
            e[: len(scores[k]), j] = scores[k]
            pen[: len(scores[k]), j, 0] = np.where(starts[k], between, inner)
        back = np.zeros((size, n, n_lang), np.int8)
        own = np.arange(n_lang, dtype=np.int8)[None]
        score = e[0].copy()
        for t in range(1, size):
            best = score.argmax(1)
            jump = np.take_along_axis(score, best[:, None], 1) - pen[t]
            take = jump > score
            back[t] = np.where(take, best[:, None], own)
            score = np.where(take, jump, score) + e[t]
        state = score.argmax(1)
        path = np.zeros((size, n), np.int8)
        rows = np.arange(n)
        for t in range(size - 1, -1, -1):
            path[t] = state
            state = back[t, rows, state]
        for j, k in enumerate(group):
            out[k] = path[: len(scores[k]), j]
    return out


def labelled(texts: list[str | None], model: Model) -> list[list[tuple[str, int, int, float]]]:
    """Segments (language, first word, words, confidence) of each text; [] without own words.

    The confidence is the probability of the segment's language given its words' scores, whose sum is divided by the
    square root of their number, since neighbouring words are not independent evidence.
    """
    parsed = [own_words(t) for t in texts]
    scores = [np.stack([model.row(w) for w in ws]) if ws else np.zeros((0, len(LANGS)), np.float32) for ws, _ in parsed]
    paths = viterbi(scores, [s for _, s in parsed])
    out = []
    for s, path in zip(scores, paths):
        segments = []
        if len(path):
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            for a, b in zip(cuts, cuts[1:]):
                total = s[a:b].sum(0) / (b - a) ** 0.5
                p = np.exp(total - total.max())
                segments.append((LANGS[path[a]], a, b - a, float(p[path[a]] / p.sum())))
        out.append(segments)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for code, words in zip(batch["code"].to_pylist(), batch["words"].to_pylist()):
            for w in words:
                counts[folded(w), code] += 1
    yield pa.RecordBatch.from_pydict({"word": [w for w, _ in counts], "code": [c for _, c in counts], "n": list(counts.values())}, pa.schema([("word", pa.string()), ("code", pa.string()), ("n", pa.int64())]))


def _collected(words: DataFrame) -> dict[tuple[str, str], int]:
    """The counts of all words; no more of them reach the driver than the sample of documents holds."""
    counts = words.mapInArrow(_count_words, "word string, code string, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))
    return {(r["word"], r["code"]): r["n"] for r in counts.collect()}


def fit(documents: DataFrame, sample: int = 6000) -> Model:
    """A model from about ``sample`` labelled documents, chosen by a hash of doc_id, and all of their words.

    ``sample`` is the bound of what reaches the driver and is sent to the executors, whatever the number of documents.

    Labels may be wrong and mails mixed, so the counts are made again after the first model has labelled the sample.
    Documents without text or known label are never chosen. With no labelled documents every score is equal.
    """
    ship(documents.sparkSession)
    known = documents.select("doc_id", "text", named_language(F.col("lang")).alias("code")).where(F.col("code").isNotNull())
    n = documents.select(named_language(F.col("lang")).alias("code")).where(F.col("code").isNotNull()).count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) < int(sample / n * (1 << 20)))

    def split(batches):
        for b in batches:
            pairs = [own_words(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["code"], pa.array([p[0] for p in pairs], pa.list_(pa.string())), pa.array([p[1] for p in pairs], pa.list_(pa.bool_()))], ["code", "words", "starts"])

    words = materialise(known.mapInArrow(split, "code string, words array<string>, starts array<boolean>"), "words")
    first = fitted(_collected(words))
    model = words.sparkSession.sparkContext.broadcast(first)

    def again(batches):
        for b in batches:
            ws, st = b["words"].to_pylist(), b["starts"].to_pylist()
            keep = [i for i, w in enumerate(ws) if w]
            scores = [np.stack([model.value.row(w) for w in ws[i]]) for i in keep]
            code, out = [], []
            for i, path in zip(keep, viterbi(scores, [st[i] for i in keep])):
                for k in set(path.tolist()):
                    code.append(LANGS[k])
                    out.append([w for w, p in zip(ws[i], path) if p == k])
            yield pa.RecordBatch.from_pydict({"code": code, "words": out}, pa.schema([("code", pa.string()), ("words", pa.list_(pa.string()))]))

    return fitted(_collected(words.mapInArrow(again, "code string, words array<string>")))


SEGMENTS = "array<struct<lang: string, start: int, n_words: int, confidence: double>>"


def with_segments(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, label, segments) of each document; no segments for null, empty and blank texts or mails without prose.

    Segments count own words from 0 and cover them all; whole texts are read, however long. Columns of other names are
    not passed on.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("n_words", pa.int32()), ("confidence", pa.float64())]))

    def label(batches):
        for b in batches:
            found = labelled(b["text"].to_pylist(), shared.value)
            rows = [[dict(zip(("lang", "start", "n_words", "confidence"), s)) for s in segments] for segments in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array(rows, kind)], ["doc_id", "label", "segments"])

    rows = documents.select(F.col("doc_id").cast("long"), named_language(F.col("lang")).alias("label"), "text")
    return rows.mapInArrow(label, f"doc_id long, label string, segments {SEGMENTS}")


def _words_in(code: str, weight: str | None = None) -> Column:
    """Words (times a field of their segments) of one language in the segments of a row."""

    def add(total: Column, s: Column) -> Column:
        return total + F.when(s["lang"] == code, s["n_words"] * s[weight] if weight else s["n_words"]).otherwise(F.lit(0.0) if weight else F.lit(0))

    return F.aggregate("segments", F.lit(0.0) if weight else F.lit(0), add)


def _total() -> Column:
    return F.aggregate("segments", F.lit(0), lambda a, s: a + s["n_words"])


def languages(segmented: DataFrame, least_share: float = 0.25) -> DataFrame:
    """(doc_id, label, lang, share, confidence): a row for each language with at least ``least_share`` of a mail's words.

    The words of one mail are summed in its own row, by array expressions: nothing is shuffled.
    """
    each = F.array(*(F.struct(F.lit(c).alias("lang"), _words_in(c).alias("n"), _words_in(c, "confidence").alias("sure")) for c in LANGS))
    rows = segmented.select("doc_id", "label", _total().alias("total"), F.explode(each).alias("x"))
    rows = rows.where((F.col("x.n") > 0) & (F.col("x.n") >= F.col("total") * least_share))
    return rows.select("doc_id", "label", F.col("x.lang").alias("lang"), (F.col("x.n") / F.col("total")).alias("share"), (F.col("x.sure") / F.col("x.n")).alias("confidence"))


def label_cases(segmented: DataFrame, least_share: float = 0.25) -> DataFrame:
    """(doc_id, lang): languages of mails with more than one, or whose label does not name the only one."""
    found = F.array_compact(F.array(*(F.when((_words_in(c) > 0) & (_words_in(c) >= _total() * least_share), F.lit(c)) for c in LANGS)))
    rows = pinned(segmented, "found", found)
    odd = (F.size("found") > 1) | ((F.size("found") == 1) & (F.col("label").isNull() | (F.col("label") != F.col("found")[0])))
    return rows.where(odd).select("doc_id", F.explode("found").alias("lang"))
