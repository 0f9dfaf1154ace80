"""Language models shared by the text operators: rank-order profiles and character n-gram naive Bayes.

Both are trained on a bounded sample of documents with a language label
(``sample_documents``). Labels may be wrong: a first model relabels the
sample's sentences, and only those on which it agrees with the label train the
model that is used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "uk")

# Other spellings of the language codes (ISO 639-2, engine codes, names).
CODES = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german", "deutsch"], "fr": ["fr", "fra", "fre", "french", "français"],
    "es": ["es", "spa", "spanish", "español", "castellano"], "pt": ["pt", "por", "portuguese", "português"],
    "ru": ["ru", "rus", "russian", "русский"], "uk": ["uk", "ukr", "ua", "ukrainian", "українська"],
}
SPELLINGS = {s: code for code, many in CODES.items() for s in many}

#: Entries of each language's profile; also the penalty for an n-gram that the profile lacks.
PROFILE = 1500
#: Documents per language in the training sample.
SAMPLE = 150
#: Decided sentences that a worker remembers.
REMEMBERED = 1 << 18

_SPLIT = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|`[^`\n]*`")
_MARK = re.compile(r"[“„«\"`]")
_CODED = re.compile(r"(?<!\S)\S*[\d=_/\\<>{}]\S*")
_EITHER = re.compile(r"[“„«\"`\d=_/\\<>{}]")
_END = re.compile(r"(?<=[.!?…])[\"'”»’)\]*_]*(?:\s+(?![a-zß-öø-ÿа-яєіїґ\d])|$)")
_ITEM = re.compile(r"^\s*(?:[-*•–>]|\d{1,3}[.)])\s+")
_FENCE = re.compile(r"^\s*(```|~~~)")


def declared(spelled: str | None) -> set[str]:
    """Language codes in a declaration such as ``ENG + DEU``, ``en,pt``, ``de-DE``; mode names declare none."""
    return {SPELLINGS[w] for w in _SPLIT.findall((spelled or "").lower()) if w in SPELLINGS}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def grams_of(word: str) -> list[str]:
    """The n-grams (1 to 4) of a padded lower-case word."""
    w = f"_{word}_"
    n = len(w)
    return [*word, *[w[i : i + k] for k in (2, 3, 4) for i in range(n - k + 1)]]


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the sentences of a text, in order.

    A sentence ends with its punctuation; line breaks inside it don't count,
    but a list item is a sentence of its own even without a full stop, and an
    empty line ends one. Whole: it begins like a sentence and ends like one.
    """
    out: list[tuple[int, int, bool]] = []
    blocks: list[list[int]] = []
    at, fenced = 0, False
    fresh = True
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        bare = line.strip()
        if _FENCE.match(line):
            fenced, fresh = not fenced, True
            continue
        if fenced or not bare or bare[0] == "|":
            fresh = True
            continue
        item = _ITEM.match(line)
        if item or fresh or bare[0] == "#":
            blocks.append([start + (item.end() if item else 0), at, bool(item)])
        else:
            blocks[-1][1] = at
        fresh = bare[0] == "#"
    for a, b, item in blocks:
        start = a
        for m in _END.finditer(text, a, b):
            out.append((start, m.end(), True))
            start = m.end()
        if start < b and text[start:b].strip():
            out.append((start, b, item and start == a))
    return out


def clean_sentence(text: str) -> list[str]:
    """Lower-case words that speak for a language: no quotations, no words with digits, no capitalised names inside."""
    if _EITHER.search(text):
        if _MARK.search(text):
            text = _QUOTED.sub(" ", text)
        text = _CODED.sub(" ", text)
    words = _WORD.findall(text)
    small = [w for w in words if w.islower()]
    # The first word is capitalised anyway; it may be a name, so it counts only where little else does.
    return small if len(small) >= 5 or not words or words[0].islower() else [words[0].lower(), *small]


class Profiles:
    """Rank-order n-gram profiles: the language with the smallest out-of-place distance."""

    def __init__(self, texts: dict[str, Iterable[list[str]]]) -> None:
        """texts: for each language, sentences as lists of words."""
        ranked: dict[str, list[str]] = {}
        for code in LANGUAGES:
            counts: Counter[str] = Counter()
            for w, n in Counter(w for s in texts.get(code, ()) for w in s).items():
                for g in grams_of(w):
                    counts[g] += n
            ranked[code] = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]
        self.ids = {g: i for i, g in enumerate(sorted({g for r in ranked.values() for g in r}))}
        self.ranks = np.full((len(LANGUAGES), len(self.ids) + 1), PROFILE, np.int32)  # the last column: unknown n-gram
        for k, code in enumerate(LANGUAGES):
            for rank, g in enumerate(ranked[code]):
                self.ranks[k, self.ids[g]] = rank
        self._forget()

    def _forget(self) -> None:
        """Empties the tables of known words and sentences; they save work only."""
        self.numbers: dict[str, int] = {}
        self.pool, self.start = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64)
        self.seen: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {"ids": self.ids, "ranks": self.ranks}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _learn(self, words: Iterable[str]) -> None:
        """Puts the n-grams of new words into the pool, one word after the other."""
        unknown, at = len(self.ids), int(self.start[len(self.numbers)])
        for w in words:
            ids = [self.ids.get(g, unknown) for g in grams_of(w)]
            while at + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[at : at + len(ids)] = ids
            at += len(ids)
            n = self.numbers[w] = len(self.numbers)
            if n + 2 > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.start[n + 1] = at

    def distances(self, many: list[list[str]], block: int = 4096) -> np.ndarray:
        """Mean out-of-place distance per n-gram of each word list to each language; ties of frequency in order of n-gram."""
        out = np.zeros((len(many), len(LANGUAGES)))
        wide, deep = len(self.ids) + 1, 1 << 20
        for at in range(0, len(many), block):
            part = many[at : at + block]
            if len(self.numbers) > REMEMBERED:
                self.numbers.clear()
            self._learn(dict.fromkeys(w for words in part for w in words if w not in self.numbers))
            numbers = np.array([self.numbers[w] for words in part for w in words], np.int64)
            if not len(numbers):
                continue
            first = self.start[numbers]
            size = self.start[numbers + 1] - first
            flat = self.pool[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
            owner = np.repeat(np.repeat(np.arange(len(part)), [len(words) for words in part]), size)
            key = np.sort(owner * wide + flat)
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[begin, len(key)])
            owner, gram = np.divmod(key[begin], wide)
            # In order of n-gram already; by frequency now.
            order = np.argsort(owner * deep + (deep - 1 - np.minimum(count, deep - 1)), kind="stable")
            owner, gram = owner[order], gram[order]
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            kinds = np.diff(np.r_[start, len(owner)])
            place = (np.arange(len(owner)) - np.repeat(start, kinds)).astype(np.int32)
            for k, ranks in enumerate(self.ranks):
                out[at + owner[start], k] = np.add.reduceat(np.abs(ranks[gram] - place), start, dtype=np.int64) / kinds
        return out

    def decide(self, many: list[list[str]]) -> list[tuple[int, float]]:
        """(language index, confidence 0..1) of each word list; (-1, 0) for none. Confidence: lead over the second, against its distance."""
        keys = [" ".join(w) for w in many]
        new = list(dict.fromkeys(k for k in keys if k and k not in self.seen))
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(dict.fromkeys(k for k in keys if k))
        if new:
            d = self.distances([k.split(" ") for k in new])
            order = np.argsort(d, axis=1)
            best, second = (np.take_along_axis(d, order[:, i : i + 1], axis=1)[:, 0] for i in (0, 1))
            sure = np.where(best >= PROFILE, 0, np.clip((second - best) / np.maximum(second, 1) * 4, 0, 1))
            self.seen.update(zip(new, zip(order[:, 0].tolist(), sure.tolist(), strict=True), strict=True))
        return [self.seen[k] if k else (-1, 0.0) for k in keys]


class Bayes:
    """Character n-gram naive Bayes: log posteriors of the languages, uniform prior."""

    def __init__(self, texts: dict[str, Iterable[list[str]]]) -> None:
        counts = []
        for code in LANGUAGES:
            c: Counter[str] = Counter()
            for w, n in Counter(w for s in texts.get(code, ()) for w in s).items():
                for g in grams_of(w):
                    if len(g) > 1:
                        c[g] += n
            counts.append(c)
        vocabulary = set().union(*counts)
        total = np.array([sum(c.values()) for c in counts], float)
        self.unknown = np.log(0.5 / (total + 0.5 * len(vocabulary) + 1))
        table = np.array([[c.get(g, 0) for c in counts] for g in sorted(vocabulary)], float).reshape(-1, len(LANGUAGES))
        logs = np.log((table + 0.5) / (total + 0.5 * len(vocabulary) + 1))
        self.logs = dict(zip(sorted(vocabulary), logs, strict=True))
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"unknown": self.unknown, "logs": self.logs, "known": {}}

    def word(self, w: str) -> np.ndarray:
        v = self.known.get(w)
        if v is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            v = self.known[w] = np.sum([self.logs.get(g, self.unknown) for g in grams_of(w) if len(g) > 1], axis=0) + np.zeros(len(LANGUAGES))
        return v

    def posterior(self, words: list[str]) -> np.ndarray:
        """Posteriors; n-grams overlap, so their evidence is divided by their mean number per character."""
        if not words:
            return np.full(len(LANGUAGES), 1 / len(LANGUAGES))
        s = np.sum([self.word(w) for w in words], axis=0) / 3
        p = np.exp(s - s.max())
        return p / p.sum()


def label_code(c: str = "lang") -> Column:
    """The two-letter code of a language label in any known spelling, null for none."""
    spelled = F.regexp_extract(F.lower(F.trim(c)), r"^[^\W\d_]+", 0)
    return F.element_at(F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv]), spelled)


def sample_texts(documents: DataFrame, per_language: int = SAMPLE) -> dict[str, list[str]]:
    """At most ``per_language`` texts of labelled documents of each language, those of smallest id hash.

    The labels are counted first (a column of its own, a few rows); the scan then
    keeps a text only if its hash is below its language's share, so some
    two times the sample reaches the driver, whatever the size and the tasks.
    """
    labelled = documents.select(label_code().alias("code"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"), "doc_id", "text").filter(F.col("code").isNotNull())
    counts = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}
    if not counts:
        return {code: [] for code in LANGUAGES}
    below = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, min(1 << 40, int(2 * per_language / n * (1 << 40))))])
    rows = labelled.filter((F.col("h") < F.element_at(below, F.col("code"))) & (F.length("text") >= 80)).toArrow().to_pylist()
    texts: dict[str, list[str]] = {code: [] for code in LANGUAGES}
    for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"] or 0, r["text"])):
        if len(texts[r["code"]]) < per_language:
            texts[r["code"]].append(r["text"])
    return texts


def clean_texts(texts: dict[str, list[str]]) -> dict[str, list[list[str]]]:
    """The whole sentences of the texts of each language, as clean words."""
    found = {code: [clean_sentence(t[a:b]) for t in many for a, b, whole in sentences(t) if whole] for code, many in texts.items()}
    return {code: [s for s in many if len(s) >= 3] for code, many in found.items()}


def sample_documents(documents: DataFrame, per_language: int = SAMPLE) -> dict[str, list[list[str]]]:
    """``sample_texts`` as clean sentences."""
    return clean_texts(sample_texts(documents, per_language))


def agreeing(texts: dict[str, list[list[str]]]) -> dict[str, list[list[str]]]:
    """The sentences whose label a first model confirms, so that wrong labels and mixed documents don't train."""
    first = Profiles(texts)
    return {code: [s for s, (k, _) in zip(many, first.decide(many), strict=True) if k >= 0 and LANGUAGES[k] == code] for code, many in texts.items()}
