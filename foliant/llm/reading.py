"""Reading level of each document (problem 9).

For each level of the labelled samples an interpolated n-gram model (character
n-grams inside a word, word, word pair) gives every sentence a surprisal. How much
less surprising each harder level is than the one below it has a distribution
over a document's sentences; its mean and quantiles give the document's score, with
weights fitted on held-out samples, and isotonic regression on held-out scores
maps scores monotonically to grades.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.labels import trusted, fit_profiles
from foliant.llm.language import LANGUAGES, REMEMBERED, Profiles, clean_sentence, sentences

# The grades of the labelled samples, easiest first.
LEVELS = ("basic", "general", "expert")
#: Weights of character, word and word-pair probability.
CHARACTER, WORD, PAIR = 0.3, 0.4, 0.3
#: Weight of the mean over the levels, so that a word unseen at one level doesn't decide alone.
SHARED = 0.3
#: Words of running English that a document must have.
LEAST_WORDS = 30
#: Largest number of labelled samples that train the models, those of smallest hash.
SAMPLES = 20_000
#: Quantiles of a document's surprisal differences.
QUANTILES = (0.2, 0.35, 0.5, 0.65, 0.8)

_CODE_LINE = re.compile(
    r"\w\([^()\n]*\)\s*(?:[;#.{]|//|$)|^\s*[\w.\[\]]+\s*[:+\-]?=\s*\S|(?:^|\s)--?\w[\w-]*(?:[= ]|$)|[{};]\s*$|^\s*(?:for|if|while|def|class|import|from|return|elif|else)\b[^.!?]*[:({]\s*$|^\s*(?://|#!|\$ |>>> |\.\.\. )"
)
_CODE_SIGN = re.compile(r"[(=;{}$>:]|--|//")
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def running_text(text: str) -> str:
    """The text with code, tables and key lists blanked out line by line (positions stay)."""
    if not any(c in text for c in "(=;|`{$"):
        return text
    out, fenced = [], False
    for line in text.splitlines(keepends=True):
        fence = bool(_FENCE.match(line))
        if fence:
            fenced = not fenced
        if fence or fenced or line.lstrip()[:1] == "|" or line.count("=") > 1 or (_CODE_SIGN.search(line) and line.lstrip()[:2] != "- " and _CODE_LINE.search(line)):
            line = "\n\n" if len(line) > 1 else "\n"
        out.append(line)
    return "".join(out)


class LevelModel:
    """Interpolated n-gram models of one level each, sharing a vocabulary."""

    def __init__(self, samples: list[tuple[list[list[str]], int]], order: int = 4) -> None:
        self.order = order
        self.grams = [Counter() for _ in LEVELS]
        self.contexts = [Counter() for _ in LEVELS]
        self.words = [Counter() for _ in LEVELS]
        self.pairs = [Counter() for _ in LEVELS]
        self.firsts = [Counter() for _ in LEVELS]
        for many, level in samples:
            for s in many:
                for previous, w in zip(["", *s], s):
                    self.words[level][w] += 1
                    self.pairs[level][previous, w] += 1
                    self.firsts[level][previous] += 1
                    for context, c in self._characters(w):
                        for k in range(order):
                            self.grams[level][context[-k:] if k else "", c] += 1
                            self.contexts[level][context[-k:] if k else ""] += 1
        self.total = [max(1, sum(c.values())) for c in self.words]
        self.alone: dict[str, tuple[float, ...]] = {}
        self.spelled: dict[str, tuple[float, ...]] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the table of word pairs; it saves work only."""
        self.joined: dict[tuple[str, str], int] = {}
        self.table = np.empty((1024, len(LEVELS)))

    def __getstate__(self):
        return self.__dict__ | {"alone": {}, "spelled": {}, "joined": {}, "table": np.empty((1024, len(LEVELS)))}

    def _characters(self, word: str) -> Iterator[tuple[str, str]]:
        w = "^" * (self.order - 1) + word + "$"
        for i in range(self.order - 1, len(w)):
            yield w[i - self.order + 1 : i], w[i]

    def _character(self, window: str) -> tuple[float, ...]:
        """Probability of the window's last character after the others, at each level."""
        p = self.spelled.get(window)
        if p is None:
            context, c = window[:-1], window[-1]
            out = []
            for grams, contexts in zip(self.grams, self.contexts, strict=True):
                x = 1 / 60
                for k in range(self.order):
                    h = context[-k:] if k else ""
                    n = contexts[h]
                    if n:
                        x = (grams[h, c] + 2 * x) / (n + 2)
                out.append(x)
            p = self.spelled[window] = tuple(out)
        return p

    def _word(self, word: str) -> tuple[float, ...]:
        """Probabilities of a word without its context: word frequency and its spelling."""
        p = self.alone.get(word)
        if p is None:
            a = b = c = 1.0
            n = self.order
            padded = "^" * (n - 1) + word + "$"
            for i in range(len(padded) - n + 1):
                x, y, z = self._character(padded[i : i + n])
                a, b, c = a * x, b * y, c * z
            p = tuple(CHARACTER * x + WORD * self.words[k][word] / self.total[k] for k, x in enumerate((a, b, c)))
            if len(self.alone) > REMEMBERED:
                self.alone.clear()
                self.spelled.clear()
            self.alone[word] = p
        return p

    def _add(self, key: tuple[str, str]) -> int:
        """Row of the table with the surprisal of a word after another, at each level."""
        previous, word = key
        own = self._word(word)
        if any(key in p for p in self.pairs):
            own = [x + PAIR * self.pairs[k][key] / self.firsts[k][previous] if self.firsts[k][previous] else x for k, x in enumerate(own)]
        shared = SHARED * sum(own) / len(own)
        row = self.joined[key] = len(self.joined)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[row] = [-log(max((1 - SHARED) * x + shared, 1e-40)) for x in own]
        return row

    def surprisals(self, many: list[list[str]]) -> np.ndarray:
        """Nats of each sentence (not empty) under each level's model."""
        if len(self.joined) > REMEMBERED:
            self.forget()
        rows: list[int] = []
        get, take = self.joined.get, rows.append
        for words in many:
            previous = ""
            for w in words:
                row = get((previous, w))
                take(self._add((previous, w)) if row is None else row)
                previous = w
        starts = np.cumsum([0, *map(len, many)])[:-1]
        return np.add.reduceat(self.table[rows], starts, axis=0) if many else np.empty((0, len(LEVELS)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y to x (pool adjacent violators); between knots, interpolate."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, n, low, high = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n), blocks[-1][1] + n, min(blocks[-1][2], low), high]
    return np.array([k for b in blocks for k in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


def sentence_words(text: str) -> list[list[str]]:
    """Clean words of the whole sentences of a running English text."""
    return [w for a, b, whole in sentences(text) if whole and len(w := clean_sentence(text[a:b])) >= 2]


def distributions(nats: np.ndarray, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean and QUANTILES of each document's surprisal differences between neighbouring levels.

    nats: surprisals of sentences; words: their lengths; owner: the number of each one's document
    (ascending, each of the n has one). A difference is taken on the logistic scale, so one odd
    sentence can't outweigh the others; a sentence counts by the root of its words.
    """
    weight = np.sqrt(words)
    total = np.bincount(owner, weight, n)
    first = np.searchsorted(owner, np.arange(n))
    last = np.r_[first[1:], len(owner)] - 1
    out = []
    for k in range(len(LEVELS) - 1):
        d = 1 / (1 + np.exp(-np.clip(nats[:, k] - nats[:, k + 1], -50, 50)))
        out.append(np.bincount(owner, weight * d, n) / total)
        order = np.lexsort((d, owner))
        w = weight[order]
        below = np.cumsum(w) - w / 2
        place = (below - (np.cumsum(total) - total)[owner]) / total[owner]
        for q in QUANTILES:
            at = np.clip(q, place[first], place[last])
            out.append(np.interp(np.arange(n) * 2 + at, owner * 2 + place, d[order]))
    return np.stack(out, axis=1)


def nonnegative_fit(x: np.ndarray, y: np.ndarray, ridge: float = 5.0, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """(weights >= 0, offset) of the least squares of y on x, by coordinate descent; more surprise at the easier level never lowers the score."""
    mean, level = x.mean(axis=0), y.mean()
    g = (x - mean).T @ (x - mean) + ridge * np.eye(x.shape[1])
    c = (x - mean).T @ (y - level)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            w[j] = max(0.0, w[j] - (g[j] @ w - c[j]) / g[j, j])
        if np.abs(w - before).max() < 1e-10:
            break
    return w, float(level - mean @ w)


def sorted_out(samples: list[tuple[list[list[str]], int]], rounds: int = 3, own: float = 0.4) -> LevelModel:
    """Level models on the sentences' own levels.

    A sample of one level holds some sentences of others. Starting from the
    samples' levels, each round gives every sentence the level under which it is
    least surprising, its sample's level counting as ``own`` likely beforehand.
    """
    prior = {k: -np.log(np.where(np.arange(len(LEVELS)) == k, own, (1 - own) / (len(LEVELS) - 1))) for k in range(len(LEVELS))}
    model = LevelModel(samples)
    every = [(s, level) for many, level in samples for s in many]
    beforehand = np.array([prior[level] for _, level in every])
    for _ in range(rounds):
        levels = (model.surprisals([s for s, _ in every]) + beforehand).argmin(axis=1)
        model = LevelModel([([s], int(k)) for (s, _), k in zip(every, levels, strict=True)])
    return model


class Reader:
    """Level models, the score's weights and the isotonic map, fitted on labelled samples with held-out surprisals."""

    def __init__(self, samples: list[tuple[str, str]], folds: int = 5) -> None:
        usable = [(s, LEVELS.index(level)) for text, level in samples if level in LEVELS and (s := sentence_words(text or ""))]
        if not usable:
            raise ValueError("no labelled sample of a known level")
        x = np.zeros((len(usable), (len(LEVELS) - 1) * (1 + len(QUANTILES))))
        y = np.array([level for _, level in usable], float)
        fold = np.arange(len(usable)) % folds
        for f in range(min(folds, len(usable))):
            model = sorted_out([u for u, k in zip(usable, fold, strict=True) if k != f] or usable)
            x[fold == f] = self.features(model, [many for (many, _), k in zip(usable, fold, strict=True) if k == f])[0]
        self._fit(x, y)
        said = []
        for f in set(fold.tolist()):
            if (fold != f).any():
                self._fit(x[fold != f], y[fold != f])
            said += [(LEVELS[int(b)], self.level(g)) for b, g in zip(y[fold == f], self.grade(self.score(x[fold == f])), strict=True)]
        #: Share of samples that come out right when neither models nor map have seen them.
        self.accuracy = float(np.mean([a == b for a, b in said]))
        self._fit(x, y)
        self.model = sorted_out(usable)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights, self.offset = nonnegative_fit(x, y)
        self.knots = isotonic(self.score(x), y)

    @staticmethod
    def features(model: LevelModel, many: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distributions of each document, least surprisal per word and document number of each sentence); no document is empty."""
        flat = [s for doc in many for s in doc]
        owner = np.repeat(np.arange(len(many)), [len(doc) for doc in many])
        nats, words = model.surprisals(flat), np.array([len(s) for s in flat], float)
        return distributions(nats, words, owner, len(many)), nats.min(axis=1) / words, owner

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.offset

    def grade(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, *self.knots)

    def level(self, grade: float) -> str:
        return LEVELS[min(max(int(grade + 0.5), 0), len(LEVELS) - 1)]


RESULT = "doc_id bigint, reading_level string, grade double, score double, surprisal double, surprisal_p90 double, words int, other_language boolean"
_NONE = (None,) * 5


def read_documents(texts: list[str], languages: Profiles, reader: Reader, mixed: bool = True) -> list[tuple]:
    """(level, grade, score, mean and 90 % surprisal, English words, whether a sentence is in another language) of each text.

    Sentences in other languages make no level and no words. With ``mixed`` off a text
    is read until its first such sentence, which leaves it without a level.
    """
    english = LANGUAGES.index("en")
    clear = [running_text(t) for t in texts]
    parts = [sentences(t) for t in clear]
    kept: list[list[list[str]]] = [[] for _ in texts]
    running = [0] * len(texts)
    foreign = [False] * len(texts)
    for first, last in ((0, None),) if mixed else ((0, 2), (2, None)):
        open_ = [i for i, f in enumerate(foreign) if mixed or not f]
        words = [[clean_sentence(clear[i][a:b]) for a, b, _ in parts[i][first:last]] for i in open_]
        said = iter(languages.decide([w for many in words for w in many]))
        for i, many in zip(open_, words, strict=True):
            t = clear[i]
            for (a, b, whole), w in zip(parts[i][first:last], many, strict=True):
                k, _sure = trusted(w, *next(said))
                if whole and k >= 0 and k != english:
                    foreign[i] = True
                elif whole and len(w) >= 2:
                    running[i] += len(t[a:b].split())
                    kept[i].append(w)
    there = [i for i, many in enumerate(kept) if many and (mixed or not foreign[i])]
    out: list[tuple] = [(*_NONE, n, f) for n, f in zip(running, foreign, strict=True)]
    if there:
        x, least, owner = reader.features(reader.model, [kept[i] for i in there])
        size = np.array([len(w) for i in there for w in kept[i]], float)
        mean = np.bincount(owner, least * size) / np.bincount(owner, size)
        high = np.array([np.quantile(part, 0.9) for part in np.split(least, np.flatnonzero(np.diff(owner)) + 1)]) if mixed else mean
        score = reader.score(x)
        for i, g, s, m, h in zip(there, reader.grade(score).tolist(), score.tolist(), mean.tolist(), high.tolist(), strict=True):
            out[i] = (reader.level(g), g, s, m, h if mixed else None, running[i], foreign[i])
    return out


def reading_levels(documents: DataFrame, samples: DataFrame, mixed: bool = True) -> DataFrame:
    """One row per document: level, grade, score, surprisals, running English words, whether it has other languages.

    A narrow Arrow map; the models (a few MB, bounded by SAMPLES and the
    language profiles) go with the task. ``mixed`` off spares the rest of a text after its
    first sentence in another language: its level, scores and words are then not known.

    * null, empty, blank text, text without an English sentence: level and scores null, 0 words.
    * null doc_id: kept. Repeated rows: one row each. Very long texts are read whole.
    * empty documents: no rows. No usable sample: an error, for there is no scale. Extra columns are not read.
    """
    rows = samples.select(F.col("text"), F.lower(F.trim("reading_level")).alias("level")).orderBy(F.xxhash64("text", "level"), "text", "level").limit(SAMPLES).toArrow()
    reader = Reader(list(zip(rows["text"].to_pylist(), rows["level"].to_pylist(), strict=True)))
    languages = fit_profiles(documents)
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = read_documents([t or "" for t in part.column(1).to_pylist()], languages, reader, mixed)
                columns = list(zip(*found, strict=True)) if found else [[] for _ in names[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True)]], names)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)


def graded(levels: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, reading_level) of the documents with enough running English and no sentence in another language."""
    return levels.filter((F.col("words") >= least) & ~F.col("other_language") & F.col("reading_level").isNotNull()).select("doc_id", "reading_level")
