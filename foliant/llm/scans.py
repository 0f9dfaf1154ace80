"""Repair of text from scanned pages (problem 5).

Lines are labelled body, heading, header, page number or reading by a hidden
Markov model over layout features; words are checked against exact counts of
the whole corpus, which hold every word above a share of it. Words cut by a line end are
joined, misread characters corrected, headers and page numbers removed, and
the remaining lines reassembled into paragraphs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.session import cut

#: Chunks whose lines train the line model.
SAMPLE = 4000
#: Count from which a word is known, and how much more frequent a correction must be than what was read.
KNOWN, RATIO = 4, 12
#: Words of a corpus in which one occurrence counts as one; in a larger one, one among so many words does.
WORDS = 2_500_000
#: Words rarer than this part of a known one are taken as never seen, which bounds the table to WORDS / (KNOWN x SELDOM) entries.
SELDOM = 0.1
#: A running line stands on at least one in PAGES of its document's chunks.
PAGES = 3

# What scanners read, and what stood there.
CONFUSIONS = [
    ("0", "o"), ("0", "о"), ("1", "l"), ("1", "i"), ("1", "і"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("5", "s"), ("$", "s"),
    ("6", "b"), ("6", "б"), ("6", "é"), ("8", "b"), ("9", "g"), ("3", "з"), ("4", "ч"), ("†", "t"), ("€", "e"), ("@", "a"),
    ("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"),
    ("vv", "w"), ("ii", "u"), ("ii", "ü"), ("ii", "n"), ("bl", "ы"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("u", "и"), ("n", "п"), ("п", "л"), ("и", "н"),
]
# Letters of the two scripts that look alike.
LATIN, CYRILLIC = "aceopxyikmtbhACEOPXBHKMTIun", "асеорхуікмтвнАСЕОРХВНКМТІип"
# Digits as scanners misread them.
DIGITS = str.maketrans("OoОоlI|!SsBZzgq", "000011115582299"[:15])
# Words that stand before a page's number.
PAGE_WORDS = r"page|p|pg|seite|s|blatt|sheet|folio|feuille|página|pagina|pág|pag|hoja|folha|fl|стр|страница|с|лист|стор|сторінка|аркуш"

_TO_CYRILLIC, _TO_LATIN = str.maketrans(LATIN, CYRILLIC), str.maketrans(CYRILLIC, LATIN)
_LETTERS = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
_TOKEN = re.compile(r"\S+")
_N = r"[0-9OoОоlI|!SsBZzgq]{1,5}"
_PAGE_FORMS = [
    (2, re.compile(rf"^(?:{PAGE_WORDS})\.?\s*({_N})\s*(?:[(/]\s*{_N}\s*\)?)?$", re.IGNORECASE)),
    (2, re.compile(rf"^({_N})\s*(?:/|\||•|·|of|von|de|из|із|з|sur)\s*({_N})$")),
    (2, re.compile(rf"^[-–—~\[(]\s*({_N})\.?\s*[-–—~\])]$")),
    (2, re.compile(rf"^{_N}[–-]({_N})$")),
    (1, re.compile(rf"^({_N})$")),
]
_ROMAN = re.compile(r"^[-–—~\[(]?\s*(x{0,3}(?:ix|iv|v?i{0,3}))\s*[-–—~\])]?$", re.IGNORECASE)
_BREAK_MARKS = "-‐‑­¬~=_]|†—–"
_HYPHENS = "-‐‑­¬"
_STOP = re.compile(r"[.!?…:;]['\"”»’)\]]*$")


_NO_LETTER = re.compile(r"[\W\d_]+")


def folded(line: str) -> str:
    """Letters of a line in one script and case, for comparing running headers."""
    return _NO_LETTER.sub("", line.casefold().translate(_TO_LATIN))


def two_scripts(word: str) -> bool:
    """Whether a lower-case word mixes Latin and Cyrillic letters."""
    return any("a" <= c <= "z" for c in word) and any("а" <= c <= "ї" for c in word)


def digest(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def interior_words(text: str) -> Iterator[str]:
    """Words and compounds of a text that touch no line end, in lower case."""
    for line in text.splitlines():
        low = line.lower()
        found = _LETTERS.findall(low)
        yield from found[1:-1]
        if "-" in low or "‐" in low:
            yield from (c.replace("‐", "-") for c in _COMPOUND.findall(low))


class Lexicon:
    """Counts of the corpus's words by hash; ``unit`` occurrences in it weigh as much as one in a corpus of WORDS words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.unit = max(1.0, total / WORDS)
        self.seen: dict[str, int] = {}

    @staticmethod
    def of(counts: dict[str, int], total: int | None = None) -> Lexicon:
        return Lexicon(np.array([digest(w) for w in counts], np.int64), np.array(list(counts.values()), np.int64), sum(counts.values()) if total is None else total)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def count(self, word: str) -> int:
        n = self.seen.get(word)
        if n is None:
            if len(self.seen) > 1 << 19:
                self.seen.clear()
            h = digest(word)
            at = int(np.searchsorted(self.hashes, h))
            n = self.seen[word] = int(self.counts[at]) if at < len(self.hashes) and self.hashes[at] == h else 0
        return n

    def known(self, word: str) -> bool:
        return self.count(word) >= KNOWN * self.unit


def fit_lexicon(chunks: DataFrame) -> Lexicon:
    """Word counts over every chunk, summed on the executors; words that are too rare to matter stay there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([digest(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["h", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(interior_words(text))
            if len(counts) > 1 << 20:
                yield flush()
        yield flush()

    words = cut(chunks.filter(F.col("chunk_text").isNotNull()).select("chunk_text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    rows = words.filter(F.col("n") >= KNOWN * SELDOM * max(1.0, total / WORDS)).toArrow()
    return Lexicon(rows["h"].to_numpy(), rows["n"].to_numpy(), total)


class Glyphs:
    """Corrections of misread words by the corpus's counts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.fixed: dict[str, str | None] = {}
        self.tokens: dict[str, tuple[str, str] | None] = {}
        self.inverse: dict[str, list[str]] = {}
        for read, meant in CONFUSIONS:
            self.inverse.setdefault(read, []).append(meant)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "fixed": {}, "tokens": {}, "inverse": self.inverse}

    def misread(self, token: str) -> tuple[str, str] | None:
        """``misread`` of a token, remembered."""
        try:
            return self.tokens[token]
        except KeyError:
            if len(self.tokens) > 1 << 18:
                self.tokens.clear()
            found = self.tokens[token] = misread(token, self)
            return found

    def _variants(self, word: str) -> Iterator[str]:
        for read, meant in self.inverse.items():
            at = word.find(read)
            while at >= 0:
                for m in meant:
                    yield word[:at] + m + word[at + len(read) :]
                at = word.find(read, at + 1)
            if word.count(read) > 1:
                for m in meant:
                    yield word.replace(read, m)

    def correction(self, word: str) -> str | None:
        """What a lower-case word most likely was, or None if it is probably right."""
        if word in self.fixed:
            return self.fixed[word]
        if len(self.fixed) > 1 << 19:
            self.fixed.clear()
        best, most = None, 0
        plain = word.isalpha()
        own = self.lexicon.count(word) if plain else 0
        if len(word) >= 3 or two_scripts(word):
            first = {unicodedata.normalize("NFC", v) for v in (word.translate(_TO_LATIN), word.translate(_TO_CYRILLIC)) if v != word}
            first.update(self._variants(word))
            pool = set(first)
            if not plain or len(word) >= 7:
                for v in first:
                    pool.update(self._variants(v))
            for v in pool:
                # Apostrophes and hyphens join words that are counted apart.
                parts = _LETTERS.findall(v)
                if not parts or "".join(parts) != v.replace("'", "").replace("’", "").replace("-", ""):
                    continue
                n = min(self.lexicon.count(p) for p in parts)
                if n > most:
                    best, most = v, n
            # Short plain words are one confusion from many others; they need more.
            unit = self.lexicon.unit
            need = max(KNOWN * unit, RATIO * (own + unit)) if plain and len(word) < 6 else max(KNOWN * unit, RATIO * own)
            if most < need or best == word:
                best = None
        self.fixed[word] = best
        return best


_SHELL = re.compile(r"^[\"'“”„«»‘’(\[{*_]*(.*?)[\"'“”„«»‘’)\]}*_.,;:?…]*$", re.DOTALL)
_ODD = re.compile(r"[0-9|!$†€@ﬁﬂ]")


def misread(token: str, glyphs: Glyphs) -> tuple[str, str] | None:
    """(read, meant) of a token that is a misread word; codes, numbers, names and addresses are none."""
    word = _SHELL.match(token).group(1)
    low = word.lower()
    if len(word) < (2 if two_scripts(low) else 3) or sum(c.isalpha() for c in word) < 2 or sum(c.isdigit() for c in word) * 2 >= len(word):
        return None
    if word.isalpha():
        pass  # judged by its count against its correction's alone, whatever the size of the corpus
    elif not all(c.isalpha() or c in "'’-" or _ODD.match(c) for c in word) or (word[-1] in "|!" and len(word) < 4):
        return None
    elif not _ODD.search(word):
        # A compound or elision: each part on its own.
        for part in _LETTERS.findall(low):
            if len(part) >= 4 and (meant := glyphs.correction(part)):
                return word, low.replace(part, meant, 1)
        return None
    elif word[-1] == "!" and word[:-1].isalpha() and glyphs.lexicon.known(low[:-1]):
        return None
    meant = glyphs.correction(low)
    if meant is None:
        return None
    return word, meant.capitalize() if word[0].isupper() else meant


@dataclass
class Line:
    """Layout features of a line."""

    text: str
    page: int  # 0 no page number, 1 bare number, page unknown, 2 marked number, page unknown, 3 the page's number, 4 another number
    recurs: bool
    titled: bool
    stop: bool
    small: bool  # begins in lower case
    short: bool
    bare: bool
    place: int = 0  # 0 inside, 1 the first or last line that isn't empty
    beside: bool = False  # next to a bare number
    marked: bool = False  # written as a heading

    def symbol(self) -> int:
        kind = 0 if not self.text else 4 if self.marked else 1 if self.stop else 2 if self.short else 3
        return ((((self.page * 4 + self.recurs * 2 + self.titled) * 5 + kind) * 2 + self.small) * 2 + self.place) * 4 + self.bare * 2 + self.beside


#: Values of each feature of a symbol: page, running, kind, small, place, number.
FEATURES = (5, 4, 5, 2, 2, 4)
SYMBOLS = 5 * 4 * 5 * 2 * 2 * 4
#: Weight of the product of the features' own chances, in lines, where their combination was seldom seen.
APART = 5.0
#: Estimations of the line model at most.
ROUNDS = 20
STATES = ("body", "heading", "header", "pageno", "reading", "break")


def page_mark(text: str, page: int | None) -> int:
    """The ``page`` feature of a line."""
    if any(c.isdigit() for c in text):
        for strength, form in _PAGE_FORMS:
            m = form.match(text)
            if m:
                numbers = [g.translate(DIGITS) for g in m.groups() if g]
                if page is None:
                    return strength
                return 3 if str(page) in [n.lstrip("0") or "0" for n in numbers if n.isdigit()] else 4
    if page is not None and text.translate(DIGITS) == str(page):
        return 3
    n = roman(text)
    return 0 if not n or page not in (None, n) else 1 if page is None else 3


def roman(text: str) -> int:
    """Value of a lone small Roman numeral up to 39, else 0."""
    m = _ROMAN.match(text)
    values = [{"i": 1, "v": 5, "x": 10}[c] for c in m.group(1).lower()] if m else []
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def lines_of(text: str, page: int | None, recurring: set[int], title: str) -> list[Line]:
    raw = text.splitlines()
    width = max((len(r) for r in raw), default=0)
    out = []
    for r in raw:
        bare = r.strip()
        mark = page_mark(bare, page) if bare else 0
        letters = folded(bare) if bare else ""
        known = bool(letters) and len(letters) >= 4
        titled = known and len(title) >= 6 and title in letters and len(letters) <= 3 * len(title) and "(" not in bare
        recurs = known and not bare[0].islower() and digest(letters) in recurring
        number = bool(re.fullmatch(_N, bare)) and any(c.isdigit() for c in bare) or bool(mark and bare.isalpha())
        out.append(Line(bare, mark, recurs, titled, bool(_STOP.search(bare)), bare[:1].islower(), len(bare) < 0.75 * width, number))
    there = [i for i, x in enumerate(out) if x.text]
    for i in there:
        x = out[i]
        x.place = int(i in (there[0], there[-1]))
        x.beside = any(out[j].bare for j in (i - 1, i + 1) if 0 <= j < len(out))
        x.marked = x.text[0] == "#" or x.text[-1] == ":" and x.short
    return out


def seeds(lines: list[Line]) -> list[int | None]:
    """First guesses for the model's training, by rule; None where there is none. Decoding doesn't ask for them."""
    out: list[int | None] = []
    for i, x in enumerate(lines):
        beside = x.beside
        if not x.text:
            out.append(5)
        elif x.page in (2, 3) and not (x.bare and beside and i + 1 < len(lines)):
            out.append(3)
        elif x.bare:
            out.append(4 if beside or x.page == 4 else None)
        elif (x.recurs or x.titled) and not x.stop:
            out.append(2)
        elif x.stop and x.text[-1] == ":" and x.short or x.text[0] == "#" or (x.short and not x.stop and i + 1 < len(lines) and not lines[i + 1].text):
            out.append(1)
        else:
            out.append(0)
    return out


class LineModel:
    """Hidden Markov model of the lines of a page: counts of the rules' states, then estimated again on its own labels until they settle.

    ``hidden``: the same pages as they look without their page number, or None;
    their lines count with the states of the numbered page, so the model learns
    what a number is whose page is unknown.
    """

    def __init__(self, pages: list[list[Line]], hidden: list[list[Line] | None] | None = None) -> None:
        self.paths: dict[tuple, list[int]] = {}
        symbols = [[x.symbol() for x in p] for p in pages]
        blind = [(i, [x.symbol() for x in h]) for i, h in enumerate(hidden or []) if h is not None]
        guesses: list[list[int | None]] = [seeds(p) for p in pages]
        first = guesses
        for _ in range(ROUNDS):
            self._count(symbols + [y for _, y in blind], guesses + [guesses[i] for i, _ in blind])
            before, guesses = guesses, [self.states(p) for p in pages]
            if before == guesses:
                break
        #: How many lines of the sample the model labels otherwise than the rules, and all of them.
        self.changed = sum(a != b for p, q in zip(first, guesses, strict=True) for a, b in zip(p, q, strict=True)), sum(map(len, guesses))
        self.paths = {}

    def __getstate__(self):
        return self.__dict__ | {"paths": {}}

    def states(self, lines: list[Line]) -> list[int]:
        """The decoded state of every line."""
        key = tuple([x.symbol() for x in lines])
        path = self.paths.get(key)
        if path is None:
            if len(self.paths) > 1 << 15:
                self.paths.clear()
            path = self.paths[key] = self.decode(list(key))
        return path

    def _count(self, symbols: list[list[int]], states: list[list[int | None]]) -> None:
        n = len(STATES)
        self.paths.clear()
        emit, move, start = np.zeros((n, SYMBOLS)), np.full((n, n), 0.5), np.full(n, 0.5)
        for ys, ss in zip(symbols, states, strict=True):
            before = None
            for y, s in zip(ys, ss, strict=True):
                if s is not None:
                    emit[s, y] += 1
                    if before is None:
                        start[s] += 1
                    else:
                        move[before, s] += 1
                before = s
        self.start = np.log(start / start.sum()).tolist()
        self.move = np.log(move / move.sum(axis=1, keepdims=True)).T.tolist()
        apart = np.ones((n, SYMBOLS))
        shaped = emit.reshape(n, *FEATURES)
        for k, values in enumerate(FEATURES):
            own = shaped.sum(axis=tuple(a for a in range(1, len(FEATURES) + 1) if a != k + 1)) + 0.05
            wide = [n, *[values if a == k else 1 for a in range(len(FEATURES))]]
            apart *= np.broadcast_to((own / own.sum(axis=1, keepdims=True)).reshape(wide), shaped.shape).reshape(n, SYMBOLS)
        self.emit = np.log((emit + APART * apart) / (emit.sum(axis=1, keepdims=True) + APART)).T.tolist()

    def decode(self, ys: list[int]) -> list[int]:
        """Most probable states (Viterbi)."""
        if not ys:
            return []
        n = range(len(STATES))
        emits = [self.emit[y] for y in ys]
        score = [s + e for s, e in zip(self.start, emits[0], strict=True)]
        back = []
        for emit in emits[1:]:
            step, fresh = [], []
            for k in n:
                move = self.move[k]
                best = max(n, key=lambda j: score[j] + move[j])
                step.append(best)
                fresh.append(score[best] + move[best] + emit[k])
            back.append(step)
            score = fresh
        path = [max(n, key=score.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


_LEFT = re.compile(rf"^(.*?)([^\W\d_]+)(\s?[{re.escape(_BREAK_MARKS)}])?$")
_RIGHT = re.compile(r"^([^\W\d_]+)(.*)$", re.DOTALL)
_STEM = re.compile(rf"^(.*?)[^\W\d_]+\s?[{re.escape(_BREAK_MARKS)}]?$")
_OPENS = re.compile(r"\d{1,3}[.)]\s|\|")
_NO_WORD = re.compile(r"[^\w-]")


def joined_break(left: str, right: str, glyphs: Glyphs) -> str | None:
    """The whole word if a line end cuts one in two (``left`` with its mark), else None."""
    if not right[:1].islower():
        return None
    m, r = _LEFT.match(left), _RIGHT.match(right)
    if not m or not r:
        return None
    a, b, mark = m.group(2).lower(), r.group(1).lower(), (m.group(3) or "").strip()
    lexicon = glyphs.lexicon
    if m.group(1)[-1:] in ("-", "‐") and not mark:
        return None
    n = lexicon.count(a + b)
    if mark:
        pair = lexicon.count(f"{a}-{b}")
        if mark in _HYPHENS and pair and pair >= n:
            return None
        if lexicon.known(a + b) or glyphs.correction(a + b):
            return m.group(2) + r.group(1)
        if mark in _HYPHENS and n >= 0 and not (lexicon.known(a) and lexicon.known(b)):
            # A part of a longer compound is cut as well: its other half is unknown.
            return m.group(2) + r.group(1)
        return None
    fragments = not lexicon.known(a) or not lexicon.known(b)
    if fragments and not lexicon.known(a + b) and (meant := glyphs.correction(a + b)):
        n = lexicon.count(meant)
        return m.group(2) + r.group(1) if n > 4 * min(lexicon.count(a), lexicon.count(b)) else None
    if lexicon.known(a + b) and n > 4 * min(lexicon.count(a), lexicon.count(b)) and fragments:
        return m.group(2) + r.group(1)
    return None


def repair(text: str, page: int | None, recurring: set[int], title: str, glyphs: Glyphs, model: LineModel) -> tuple[set[str], str]:
    """Kinds of noise in a scanned text, and the text as paragraphs without it."""
    lines = lines_of(text, page, recurring, title)
    noise: set[str] = set()
    states = model.states(lines)
    kept: list[tuple[str, int]] = []
    for x, s in zip(lines, states, strict=True):
        if s == 2:
            noise.add("header")
        elif s == 3:
            noise.add("pageno")
        else:
            kept.append((x.text, s))
    paragraphs: list[str] = []
    fresh = True
    for t, s in kept:
        if not t:
            fresh = True
            continue
        if fresh or s in (1, 4) or t[:2] in ("- ", "• ") or _OPENS.match(t):
            paragraphs.append(t)
            fresh = s in (1, 4)
            continue
        before, _, last = paragraphs[-1].rpartition(" ")
        if len(last) == 1 and last in _BREAK_MARKS:
            before, _, tail = before.rpartition(" ")
            last = f"{tail} {last}"
        head, _, rest = t.partition(" ")
        whole = joined_break(last, head, glyphs)
        if whole:
            noise.add("split_word")
            stem = _STEM.match(last).group(1)
            after = head[len(_LETTERS.match(head).group()) :]
            paragraphs[-1] = " ".join(p for p in (before, stem + whole + after, rest) if p)
        else:
            # A compound keeps its hyphen and closes up; a hanging hyphen keeps its space.
            pair = _NO_WORD.sub("", f"{last}{head}").lower()
            glue = "" if last[-1:] in "-‐" and glyphs.lexicon.count(pair.replace("‐", "-")) else " "
            paragraphs[-1] += glue + t
    out = []
    for p in paragraphs:
        changes = {}
        for token in _TOKEN.findall(p):
            if token not in changes and (fix := glyphs.misread(token)):
                changes[token] = token.replace(*fix, 1)
        if changes:
            noise.add("glyph")
            p = _TOKEN.sub(lambda m: changes.get(m.group(), m.group()), p)
        out.append(p)
    return noise, "\n\n".join(out)


def scanned(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Text chunks of notebooks with OCR."""
    ocr = settings.filter(F.col("ocr_enabled")).select("notebook_id").distinct()
    return chunks.filter((F.lower(strip("chunk_type")) == "text") & F.col("chunk_text").isNotNull()).join(ocr, "notebook_id", "left_semi")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([digest(folded(t)) for t in batch.column(0).to_pylist()], pa.int64())], ["h"])


def recurring_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, lines): hashes of a chunk's lines that run through its document, on at least one in PAGES of its chunks.

    How many documents share a line doesn't count: one issuer may hold any part
    of the rows. Page numbers and headings are left out.
    Lines are compared by hash, at most once per chunk; what a chunk gets is
    bounded by its own lines, however many chunks its document has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes, owners = [], [], []
            for doc, chunk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for line in {t.strip() for t in text.splitlines()}:
                    if len(line) >= 4 and not _STOP.search(line) and line[0] not in "#|-•" and not line[0].islower() and line[-1] not in _BREAK_MARKS and not page_mark(line, None):
                        letters = folded(line)
                        if len(letters) >= 4:
                            docs.append(doc)
                            hashes.append(digest(letters))
                            owners.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(owners, pa.string())], ["doc_id", "h", "chunk_id"])

    known = chunks.filter(F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull())
    lines = cut(known.select("doc_id", "chunk_id", "chunk_text").mapInArrow(run, "doc_id bigint, h bigint, chunk_id string"))
    recurring = lines.groupBy("doc_id", "h").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).filter("a <> b").select("doc_id", "h")
    # Headings, whatever their number, are no running headers.
    heads = chunks.select(F.explode(F.array("section_header", "parent_header")).alias("t")).filter(F.col("t").isNotNull()).distinct()
    recurring = recurring.join(heads.mapInArrow(_hashed, "h bigint").distinct(), "h", "left_anti")
    hits = cut(lines.join(recurring, ["doc_id", "h"], "left_semi").distinct())
    size = known.select("doc_id", "chunk_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    running = hits.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).join(size, "doc_id").filter(F.col("n") * PAGES >= F.col("pages"))
    return hits.join(running, ["doc_id", "h"], "left_semi").groupBy("chunk_id").agg(F.collect_set("h").alias("lines"))


def repaired(chunks: DataFrame, settings: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, noise array<string>, text): the scanned text chunks, each kind of noise found and the repaired text.

    * null text, other types, notebooks without OCR or settings: no scanned text, no row.
    * null page number: only marked page numbers are sure; bare numbers are left to the line model.
    * a chunk delivered twice gives two equal rows. Null chunk ids and doc ids are kept.
    * empty texts: no noise. Very long texts are repaired whole. Empty tables: no rows. Extra columns are not read.
    """
    pages = scanned(chunks, settings)
    glyphs = Glyphs(fit_lexicon(chunks))
    titles = documents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("title").alias("title"))
    # What is known of a chunk is gathered beside its text, so that texts are shuffled once and by a key that is never hot.
    named = pages.filter(F.col("chunk_id").isNotNull()).select("chunk_id", "doc_id").join(titles, "doc_id").groupBy("chunk_id").agg(F.max("title").alias("title"))
    about = cut(recurring_lines(pages).join(named, "chunk_id", "full"))
    texts = pages.select("chunk_id", F.col("page_number").cast("int").alias("page_number"), "chunk_text")
    rows = texts.join(about, "chunk_id", "left").select("chunk_id", "page_number", "chunk_text", "lines", "title")
    picked = texts.filter(F.length("chunk_text") > 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE)
    sample = picked.join(about, "chunk_id", "left").orderBy(F.xxhash64("chunk_id"), "chunk_id").toArrow().to_pylist()
    seen = [(r["chunk_text"], r["page_number"], set(r["lines"] or ()), folded(r["title"] or "")) for r in sample]
    model = LineModel([lines_of(*x) for x in seen], [lines_of(t, None, ls, title) if n is not None else None for t, n, ls, title in seen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts, lines, names = (c.to_pylist() for c in batch.columns)
            found = [repair(t, n, set(ls or ()), folded(name or ""), glyphs, model) for n, t, ls, name in zip(numbers, texts, lines, names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([sorted(f[0]) for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.string())], ["chunk_id", "noise", "text"])

    return rows.mapInArrow(run, "chunk_id string, noise array<string>, text string")


def noise_kinds(chunks: DataFrame, settings: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, noise) of each kind of noise found by ``repaired``."""
    return repaired(chunks, settings, documents).select("chunk_id", F.explode("noise").alias("noise")).distinct()
