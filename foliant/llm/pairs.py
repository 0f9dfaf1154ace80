"""Broken prompt and response pairs (problem 1).

Language: posteriors of prompt and response by character n-gram naive Bayes.
Truncation: how likely the last n-grams of a response are to end a text, from
exact counts over all responses; how much a final mark says is learned from the
same responses by expectation maximisation, and both decide together.
Refusals: a naive Bayes model of words and word pairs, trained in the run on the
sentences of all answers and all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.llm.language import LANGUAGES, Bayes, agreeing, clean_sentence, sample_documents, sentences
from foliant.operators.ordering import previous_row
from foliant.session import cut

#: How often the model of refusals is trained on what it said before.
ROUNDS = 3
#: A sentence counts this often at most in its training.
MOST = 50
#: Largest share of refusing features, so that there are odds where all refuse.
SURE = 1 - 1e-9
#: Numbers in the table of the features' weights that every task has (4 MB).
TABLE = 1 << 20
#: Log-odds bins of the end-of-text likelihood: from -EDGE to EDGE in steps of STEP.
EDGE, STEP = 8.0, 0.5
#: Weight of a shorter n-gram's estimate, in observations of the longer one.
BACKOFF = 2.0
#: Share of truncated texts that are taken to be cut inside a word.
INSIDE = 0.5

# What an answer says that says nothing, lower case and without its brackets and stops.
NOTHING = {
    "no answer", "no response", "empty", "n/a", "na", "null", "none", "undefined", "nil", "nan", "blank", "tbd", "todo",
    "keine antwort", "leer", "pas de réponse", "sin respuesta", "sem resposta", "нет ответа", "немає відповіді",
}
# Of each language, words of the speaker, of refusing, and of answering. A sentence with one of each
# is a likely refusal, from which the model learns; it decides by what it learned, not by these.
REFUSALS = {
    "en": (r"i|i'm|i'd|i'll|me|my", r"can't|cannot|can not|could not|couldn't|unable|not able|won't|will not|rather not|decline|refrain|not (?:be )?appropriate|inappropriate|outside|beyond|prevents?|not allowed|not permitted|don't|do not|must not", r"help|assist|answer|answering|comment|discuss\w*|respond|request|questions?|subject|topic|going into|decline|fulfil\w*|comply"),
    "de": (r"ich|mir|mich|meine\w*", r"nicht|kein\w*|übersteigt|ablehnen|untersagt", r"beantwort\w*|antworten|helfen|weiterhelfen|äußern|auskunft|eingehe\w*|bearbeiten|anfrage|behilflich"),
    "fr": (r"je|j|m|me|mes", r"ne|n|pas|aucune?|dépasse|préfère|refuse", r"répondre|aider|traiter|informations?|demande|commenter|sujet"),
    "es": (r"puedo|prefiero|estoy|me|debo|voy|mis?", r"no|más allá|declinar", r"responder|contestar|ayudar\w*|información|tratar|petición|comentar|tema"),
    "pt": (r"posso|prefiro|consigo|tenho|entro|estou|devo|me|minhas?|peço", r"não|além|recusar", r"responder|ajudar\w*|informações|tratar|pedido|comentar|tema|assunto"),
    "ru": (r"я|мне|меня|мои", r"не|нельзя|за рамки|отказ\w*", r"отвечать|ответить|помо\w+|сведени\w+|обсуждать|обработать|просьб\w+|запрос\w*|комментировать"),
    "uk": (r"я|мені|мене|мої", r"не|заборонено|за межі|відмов\w*", r"відповідати|відповісти|допомо\w+|відомост\w+|обговорюва\w+|опрацювати|прохання|запит\w*|коментувати"),
}
# How prompts in the seven languages name each language.
NAMES = {
    "en": r"english|englisch\w*|anglais\w*|inglés|inglesa?|inglês|английск\w*|англійськ\w*",
    "de": r"german|deutsch\w*|allemande?|alemán|alemana|alemão|alemã|немецк\w*|німецьк\w*",
    "fr": r"french|französisch\w*|français\w*|francés|francesa?|francês|французск\w*|французьк\w*",
    "es": r"spanish|spanisch\w*|espagnole?|español\w*|castellano|espanhola?|испанск\w*|іспанськ\w*",
    "pt": r"portuguese|portugiesisch\w*|portugais\w*|portugués|portuguesa?|português|португальск\w*|португальськ\w*",
    "ru": r"russian|russisch\w*|russe|rus[oa]|russ[oa]|русск\w*|російськ\w*",
    "uk": r"ukrainian|ukrainisch\w*|ukrainien\w*|ucranian[oa]|украинск\w*|українськ\w*",
}

_REFUSAL = {k: [re.compile(rf"(?<!\w)(?:{p})(?!\w)") for p in v] for k, v in REFUSALS.items()}
_NAMES = {k: re.compile(rf"(?<!\w)(?:{p})(?!\w)") for k, p in NAMES.items()}
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_TAG = re.compile(r"<[^<>\n]{0,40}>")
_LABEL = re.compile(r"^\W*[^\W\d_]{1,15}\W*:\s*$")
_FRAME = re.compile(r"^\s*(?:[^\W\d_]+\s+){0,3}[^\W\d_]+\s*:\s*")
_CLOSE = "'\"”»’)]}*_`"
_STOP = re.compile(r"[.!?。]['\"”»’)\]}*_`]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.+)['\"”»’)\]}*_`]*$")
_COMMA = re.compile(r"[,;:–—(-]['\"”»’)\]}*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)])\s+\S")
_TOKEN = re.compile(r"\w+(?:['’-]\w+)*", re.UNICODE)


def plain(text: str | None) -> str:
    """Folded letters and digits of a text, single spaces."""
    return " ".join(_TOKEN.findall((text or "").casefold()))


def says_nothing(text: str | None) -> bool:
    if not text:
        return True
    bare = "\n".join(line for line in _TAG.sub(" ", text).splitlines() if not _FENCE.match(line)).strip(" \t\n\r﻿​‌‍⁠\xa0")
    if not any(c.isalnum() for c in bare) or _LABEL.match(bare):
        return True
    inner = re.sub(r"^[\s\[\](){}<>*_.\-\"'`]+|[\s\[\](){}<>*_.\-\"'`]+$", "", bare).lower()
    return inner in NOTHING


def only_repeats(prompt: str | None, response: str) -> bool:
    """The response is the prompt, up to case, punctuation, framing and a changed, missing or added word."""
    asked = plain(prompt).split()
    if not asked:
        return False
    for said in (plain(response).split(), plain(_FRAME.sub("", response, count=1)).split()):
        if not said:
            continue
        whole, again = " ".join(asked), " ".join(said)
        if again == whole or not again.replace(whole, "").strip():
            return True
        if len(asked) >= 4 and abs(len(said) - len(asked)) <= max(1, len(asked) // 5):
            common = sum((Counter(asked) & Counter(said)).values())
            if common >= max(3, len(asked) - max(1, len(asked) // 5)) and common >= len(said) - max(1, len(asked) // 5) and _in_order(asked, said) >= common - 1:
                return True
    return False


def _in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def likely_refusal(sentence: str) -> bool:
    """One word of each of a language's three lists."""
    s = sentence.lower().replace("’", "'")
    split = s.replace("'", " ") if "'" in s else s
    return any(all(p.search(s if code == "en" else split) for p in (limit, act, speaker)) for code, (speaker, limit, act) in _REFUSAL.items())


class Refusals:
    """Naive Bayes over words and word pairs of sentences: refusals against all others.

    Trained on likely refusals among the answers, against the answers' other
    sentences and the sentences of documents, which refuse nothing; the labels of the
    answers' sentences are then estimated again by the model itself. A feature's
    weight shrinks to 0 with its count, so unknown words say nothing. This one is
    for texts in memory; ``refused`` is the same over tables.
    """

    def __init__(self, answers: list[str], documents: Iterable[str], rounds: int = ROUNDS, shrink: float = 1.0) -> None:
        said = Counter(self._normal(t[a:b]) for t in answers for a, b, _ in sentences(t))
        plain_ = Counter(self._normal(t[a:b]) for t in documents for a, b, _ in sentences(t))
        # A sentence that documents hold as often, in proportion, refuses nothing.
        often = sum(said.values()) / max(sum(plain_.values()), 1)
        guess = {s: likely_refusal(s) and n > plain_[s] * often for s, n in said.items()}
        self.weight: dict[str, float] = {}
        self.prior = -30.0
        self.known: dict[str, bool] = {}
        for _ in range(rounds):
            yes, no = Counter(), Counter()
            for s, n in said.items():
                (yes if guess[s] else no).update({f: min(n, MOST) for f in self._features(s)})
            for s, n in plain_.items():
                no.update({f: min(n, MOST) for f in self._features(s)})
            refused, rest = sum(n for s, n in said.items() if guess[s]), sum(n for s, n in said.items() if not guess[s])
            if not refused:
                return
            share = min(sum(yes.values()) / (sum(yes.values()) + sum(no.values())), SURE)
            self.weight = {f: log((yes[f] + shrink * share) / (no[f] + shrink * (1 - share))) - log(share / (1 - share)) for f in yes.keys() | no.keys()}
            self.prior = log(refused / (rest + 1))
            guess = {s: self.odds(s) > 0 for s in said}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @staticmethod
    def _normal(sentence: str) -> str:
        return " ".join(re.sub(r"\d+", "#", w) for w in re.findall(r"\w+(?:['’]\w+)*", sentence.lower().replace("’", "'")))

    @staticmethod
    def _features(normal: str) -> set[str]:
        words = normal.split(" ")
        return {*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]}

    def odds(self, normal: str) -> float:
        """Log-odds that a sentence refuses; words and pairs overlap, so each counts half."""
        return self.prior + 0.5 * sum(self.weight.get(f, 0.0) for f in self._features(normal))

    def declines(self, text: str) -> bool:
        for a, b, _ in sentences(text):
            s = self._normal(text[a:b])
            refuses = self.known.get(s)
            if refuses is None:
                if len(self.known) > 1 << 17:
                    self.known.clear()
                refuses = self.known[s] = self.odds(s) > 0
            if refuses:
                return True
        return False


def _words(text: str) -> list[str]:
    """Words that speak for a language, without code."""
    return [w for a, b, _ in sentences(text) for w in clean_sentence(text[a:b])]


def language_of(model: Bayes, text: str) -> tuple[int, float]:
    p = model.posterior(_words(text))
    k = int(p.argmax())
    return k, float(p[k])


def other_language(model: Bayes, prompt: str | None, response: str, sure: float = 0.99) -> bool:
    """The posteriors put prompt and response into different languages, and the prompt names no such language."""
    said = _words(response)
    if len(said) < 2 or sum(map(len, said)) < 10:
        return False
    asked = _words(prompt or "")
    if len(asked) < 2 or sum(map(len, asked)) < 6:
        return False
    p, q = model.posterior(asked), model.posterior(said)
    i, j = int(p.argmax()), int(q.argmax())
    if i == j or q[j] < sure or p[j] > 1 - sure:
        return False
    return not _NAMES[LANGUAGES[j]].search((prompt or "").lower())


# What stands at the end of an answer.
MARKS = ("stop", "ellipsis", "comma", "item", "value", "bare", "open", "closed", "cell")
#: How often each mark is expected at the end of complete and of truncated answers before any are seen, and for how many answers that counts.
EXPECTED = {
    "stop": (0.6, 0.02), "ellipsis": (0.005, 0.1), "comma": (0.002, 0.2), "item": (0.15, 0.1), "value": (0.05, 0.005),
    "bare": (0.02, 0.45), "open": (0.0005, 0.1), "closed": (0.1, 0.002), "cell": (0.07, 0.003),
}
BELIEF = 20.0
#: Marks that close something themselves; their last words say nothing.
WORDLESS = ("open", "closed", "cell")


def gram_hash(gram: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def ending_of(word: str, end: int | None = None) -> str:
    """The last four characters of a word, or of what stands before ``end``; its beginning counts as one."""
    padded = "^" + (word if end is None else word[:end])
    return padded[-4:]


def folded_tokens(line: str) -> list[re.Match]:
    """Words of a line in which every number reads ``#``."""
    return list(_FOLDED.finditer(line))


_FOLDED = re.compile(r"[\w#]+(?:['’-][\w#]+)*", re.UNICODE)
_NUMBER = re.compile(r"\d+")


def final_mark(text: str) -> tuple[str, str] | None:
    """(mark, last line) of a text; None if nothing is left of it."""
    bare = text.rstrip().rstrip("​﻿")
    lines = [line for line in bare.splitlines() if line.strip()]
    if not lines:
        return None
    last = lines[-1]
    fences = sum(bool(_FENCE.match(line)) for line in lines)
    if fences % 2:
        return "open", last
    if fences and _FENCE.match(last):
        return "closed", last
    if last.lstrip()[:1] in "|>":
        return "cell", last
    if _ELLIPSIS.search(bare):
        return "ellipsis", last
    if _STOP.search(bare):
        return "stop", last
    if _COMMA.search(bare):
        return "comma", last
    if _ITEM.match(last):
        return "item", last
    return ("value" if len(lines) == 1 and len(_TOKEN.findall(last)) <= 3 else "bare"), last


def tail_grams(text: str) -> tuple[str, str | None, str | None, str | None] | None:
    """(mark, last word, last two words, whole text if it is at most three words) of an answer."""
    marked = final_mark(text)
    if marked is None:
        return None
    mark, last = marked
    if mark in WORDLESS:
        return mark, None, None, None
    words = [m.group() for m in folded_tokens(_NUMBER.sub("#", last.casefold()))]
    if not words:
        return mark, None, None, None
    first = last.strip() == text.strip()
    before = words[-2] if len(words) > 1 else "<s>"
    return mark, words[-1], f"{before} {words[-1]}", "<s> " + " ".join(words) if first and len(words) <= 3 else None


def end_events(text: str) -> Iterator[tuple[str, str, str | None, bool]]:
    """(word, with the one before it, whole text up to here if at most three words, whether the text may end there) of every word.

    A word ends before a full stop, before the next item of a list, or with an
    answer of at most three words; of other texts without a stop, and of those
    that end in an ellipsis, the last word tells nothing.
    """
    marked = final_mark(text)
    if marked is None:
        return
    lines = [line for line in text.rstrip().rstrip("​﻿").splitlines() if line.strip()]
    fenced = False
    for k, line in enumerate(lines):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced:
            continue
        item, final = bool(_ITEM.match(line)), k == len(lines) - 1
        line = _NUMBER.sub("#", line.casefold())
        found = folded_tokens(line)
        before, so_far = "<s>", "<s>"
        for i, m in enumerate(found):
            word = m.group()
            rest = line[m.end() : m.end() + 6].lstrip(_CLOSE)
            ends = bool(rest) and rest[0] in ".!?。" and (len(rest) == 1 or rest[1].isspace() or rest[1] in _CLOSE)
            told = True
            if i == len(found) - 1:
                if final:
                    told = marked[0] in ("stop", "value")
                    ends = told
                elif not rest.strip():
                    told = ends = item
            if k == 0 and i < 3:
                so_far += " " + word
            if told:
                yield word, f"{before} {word}", so_far if k == 0 and i < 3 else None, ends
            before = word


def certainty(ended: Column, seen: Column, lower: Column) -> Column:
    return (ended + BACKOFF * lower) / (seen + BACKOFF)


def score_bin(p: Column, base: float) -> Column:
    """Bin of the log-odds of a chance against the chance at a random word."""
    odds = F.log(p / (1 - p)) - log(base / (1 - base))
    return F.floor((F.least(F.greatest(odds, F.lit(-EDGE)), F.lit(EDGE - 1e-6)) + EDGE) / STEP).cast("int")


def fit_marks(answers: dict[tuple[str, int | None], float], ends: dict[int, float], cuts: dict[int, float], rounds: int = 100) -> dict[tuple[str, int | None], float]:
    """P(truncated) of each (mark, score bin) by expectation maximisation.

    answers: how many answers have each; ends, cuts: how the scores of words that
    end a sentence and of words inside one are distributed. Only the share of truncated
    answers and what their marks are is learned; a truncated answer is one cut at any word.
    """
    bins = int(2 * EDGE / STEP)
    # An add-one count spreads over neighbouring bins, so no single bin is a proof.
    smooth = lambda c: {b: (sum(c.get(x, 0) for x in (b - 1, b, b, b + 1)) / 4 + 0.5) / (sum(c.values()) + 0.5 * bins) for b in range(bins)}
    end, cut_ = smooth(ends), smooth(cuts)
    share = 0.05
    marks = {m: np.array(EXPECTED[m]) for m in MARKS}
    total = np.array([sum(v[i] for v in marks.values()) for i in (0, 1)])
    marks = {m: v / total for m, v in marks.items()}
    prior = dict(marks)
    posterior: dict[tuple[str, int | None], float] = {}
    for _ in range(rounds):
        for mark, b in answers:
            whole = (1 - share) * marks[mark][0] * (1 if b is None else end[b])
            broken = share * marks[mark][1] * (1 if b is None else cut_[b])
            posterior[mark, b] = broken / (whole + broken)
        counts = {m: BELIEF * prior[m] for m in MARKS}
        for (mark, b), n in answers.items():
            counts[mark] = counts[mark] + n * np.array([1 - posterior[mark, b], posterior[mark, b]])
        total = sum(counts.values())
        marks = {m: v / total for m, v in counts.items()}
        new = float(total[1] / total.sum())
        if abs(new - share) < 1e-9:
            break
        share = new
    return posterior


def defect_of(prompt: str | None, response: str | None, model: Bayes, refusals: Refusals | None = None) -> str | None:
    """The first that holds of: empty, copy, refusal (by ``refusals``), wrong_language; truncation is decided over all answers."""
    if says_nothing(response):
        return "empty"
    if only_repeats(prompt, response):
        return "copy"
    if refusals is not None and refusals.declines(response):
        return "refusal"
    return "wrong_language" if other_language(model, prompt, response) else None


def messages(chat: DataFrame) -> DataFrame:
    """Each message once (by id, the one with the smallest seq), its role in lower case."""
    row = F.struct(F.col("seq").cast("bigint").alias("seq"), "notebook_id", F.lower(strip("role")).alias("role"), "content")
    return chat.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(row).alias("m")).select("id", "m.*")


def question_answers(chat: DataFrame) -> DataFrame:
    """(id, prompt, response): each user message and the next message of its notebook by seq, if an assistant's."""
    rows = previous_row(messages(chat), "notebook_id", "seq", ["role", "content"])
    return rows.filter("role = 'assistant' AND prev_role = 'user'").select("id", F.col("prev_content").alias("prompt"), F.col("content").alias("response"))


def is_assistant() -> Column:
    return (F.lower(strip("role")) == "assistant") & F.col("content").isNotNull()


def end_counts(chat: DataFrame) -> DataFrame:
    """(kind, h, w, e, n): how often each n-gram of the assistant messages was seen and ended; exact, by hash.

    kind 0: four characters, ended where a word ends; 1: words, 2: word pairs, 3: beginnings of at most
    three words, ended where a text may end. w: the last word; of a word, its last four characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, str]] = Counter()
        ended: Counter[tuple[int, str]] = Counter()

        def flush() -> pa.RecordBatch:
            for kind, word in list(seen):
                if kind == 1:
                    for i in range(1, len(word) + 1):
                        seen[0, ending_of(word, i)] += 1
                    ended[0, ending_of(word)] += 1
            keys = list(seen)
            last = [gram_hash(ending_of(g) if k == 1 else g.rpartition(" ")[2]) for k, g in keys]
            columns = [pa.array([k for k, _ in keys], pa.int8()), pa.array([gram_hash(g) for _, g in keys], pa.int64()), pa.array(last, pa.int64())]
            counts = [pa.array([c[k] for k in keys], pa.int64()) for c in (ended, seen)]
            seen.clear()
            ended.clear()
            return pa.RecordBatch.from_arrays([*columns, *counts], ["kind", "h", "w", "e", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word, pair, whole, end in end_events(text):
                    for key in ((1, word), (2, pair), (3, whole)):
                        if key[1] is not None:
                            seen[key] += 1
                            if end:
                                ended[key] += 1
            if len(seen) > 1 << 19:
                yield flush()
        yield flush()

    rows = chat.filter(is_assistant()).select("content").mapInArrow(run, "kind byte, h bigint, w bigint, e bigint, n bigint")
    return rows.groupBy("kind", "h", "w").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))


def truncated(answers: DataFrame, counts: DataFrame) -> DataFrame:
    """(mark, w, p, g) of the endings of ``answers`` that are more likely cut than complete.

    Endings are counted before they meet the n-gram counts, so an ending that a
    third of the answers share is one row; only histograms reach the driver.
    """
    endings = answers.filter(F.col("mark").isNotNull()).groupBy("mark", "w", "p", "g", "c").agg(F.count(F.lit(1)).alias("answers"))
    of = lambda kind, key, tag: counts.filter(F.col("kind") == kind).select(F.col("h").alias(key), F.col("e").alias(f"e{tag}"), F.col("n").alias(f"n{tag}"))
    # Chances at a random word, and at one never seen: as often as words seen once have ended.
    c = counts.filter("kind = 1").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, F.col("e"))).alias("e1"), F.count_if(F.col("n") == 1).alias("n1")).first()
    base = ((c["e"] or 0) + 1) / ((c["n"] or 0) + 10)
    fresh = ((c["e1"] or 0) + 10 * base) / ((c["n1"] or 0) + 10)

    # A word never seen may be a piece of one: then its last characters seldom end a word.
    whole = lambda e, n: F.lit(fresh) * certainty(F.coalesce(e, F.lit(0)), F.coalesce(n, F.lit(0)), F.lit(0.05))

    def chance(e1: Column, n1: Column, e2: Column, n2: Column, unseen: Column) -> Column:
        return certainty(e2, n2, certainty(e1, n1, unseen))

    # How scores of sentence ends and of other words are distributed, each word judged without itself, and those of pieces of words.
    words = counts.filter("kind = 1").select(F.col("h").alias("w"), F.col("w").alias("c"), F.col("e").alias("e1"), F.col("n").alias("n1")).join(of(0, "c", 0), "c", "left")
    inside = counts.filter("kind = 2").select("w", F.col("e").alias("e2"), F.col("n").alias("n2")).join(words, "w")
    e0, n0, e1, n1, e2, n2 = (F.col(x) for x in ("e0", "n0", "e1", "n1", "e2", "n2"))
    events = F.array(
        F.struct(F.lit("end").alias("at"), score_bin(chance(e1 - 1, n1 - 1, e2 - 1, n2 - 1, whole(e0, n0)), base).alias("bin"), e2.alias("k")),
        F.struct(F.lit("word").alias("at"), score_bin(chance(e1, n1 - 1, e2, n2 - 1, whole(e0, n0)), base).alias("bin"), (n2 - e2).alias("k")),
    )
    pieces = of(0, "c", 0).select(F.lit("piece").alias("at"), score_bin(whole(e0, n0 - 1), base).alias("bin"), (n0 - e0).alias("k"))
    told: dict[str, dict[int, float]] = {"end": {}, "word": {}, "piece": {}}
    for r in inside.select(F.explode(events).alias("x")).select("x.*").unionByName(pieces).filter("k > 0").groupBy("at", "bin").agg(F.sum("k").alias("k")).collect():
        told[r["at"]][r["bin"]] = float(r["k"])
    parts = [(told["word"], 1 - INSIDE), (told["piece"], INSIDE)]
    within = {b: sum(share * c.get(b, 0) / max(sum(c.values()), 1) for c, share in parts) * max(sum(told["word"].values()), 1) for b in told["word"].keys() | told["piece"].keys()}

    own = F.col("mark").isin("stop", "value").cast("int")  # such an ending has been counted itself, once at least
    less = lambda c, mine=own: F.greatest(F.coalesce(F.col(c), F.lit(0)) - mine, F.lit(0))
    joined = endings.join(of(1, "w", 1), "w", "left").join(of(2, "p", 2), "p", "left").join(of(3, "g", 3), "g", "left").join(of(0, "c", 0), "c", "left")
    p = chance(less("e1"), less("n1"), less("e2"), less("n2"), whole(e0, n0))
    p = F.when(F.col("g").isNotNull(), certainty(less("e3"), less("n3"), p)).otherwise(p)
    scored = cut(joined.select("mark", "w", "p", "g", "answers", F.when(F.col("w").isNotNull(), score_bin(p, base)).alias("bin")))
    seen = {(r["mark"], r["bin"]): float(r["k"]) for r in scored.groupBy("mark", "bin").agg(F.sum("answers").alias("k")).collect()}
    cut_here = [x for x, chance_ in fit_marks(seen, told["end"], within).items() if chance_ > 0.5]
    verdict = F.array([F.concat_ws("/", F.lit(m), F.lit("-" if b is None else str(b))) for m, b in cut_here]) if cut_here else F.array().cast("array<string>")
    return scored.filter(F.array_contains(verdict, F.concat_ws("/", "mark", F.coalesce(F.col("bin").cast("string"), F.lit("-"))))).select("mark", "w", "p", "g")


def features_of(s: Column) -> Column:
    """Hashes of the words and word pairs of a sentence in normal form, each once; as ``Refusals`` takes them."""
    words = F.split(s, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.transform(F.concat(words, pairs), lambda f: F.xxhash64(f)))


def sentence_counts(texts: DataFrame) -> DataFrame:
    """(s, n): every sentence of the texts, in normal form, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(Refusals._normal(t[a:b]) for t in batch.column(0).to_pylist() if t for a, b, _ in sentences(t))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["s", "n"])

    return texts.mapInArrow(run, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))


def answer_sentences(chat: DataFrame) -> DataFrame:
    """(h, n, likely, features): the sentences of the assistant messages, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = pa.array([likely_refusal(s) for s in batch.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, likely], ["s", "n", "likely"])

    said = sentence_counts(chat.filter(is_assistant()).select("content")).mapInArrow(run, "s string, n bigint, likely boolean")
    return said.select(F.xxhash64("s").alias("h"), "n", "likely", features_of(F.col("s")).alias("features"))


def document_features(documents: DataFrame) -> DataFrame:
    """(sentence, f, d, n) over the sentences of all documents: those that hold a feature, each MOST times at most, and all of them.

    A sentence counts as a feature of its own (``sentence``), by the same hash as in ``answer_sentences``.
    """
    whole = F.array(F.struct(F.lit(True).alias("sentence"), F.xxhash64("s").alias("f")))
    words = F.transform(features_of(F.col("s")), lambda f: F.struct(F.lit(False).alias("sentence"), f.alias("f")))
    rows = sentence_counts(documents.select("text")).select("n", F.explode(F.concat(words, whole)).alias("x"))
    return rows.groupBy("x.sentence", "x.f").agg(F.sum(F.least("n", F.lit(MOST))).alias("d"), F.sum("n").alias("n"))


def possible(said: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """(h, n, f) of the features of the sentences of ``said`` that may refuse, by the positive weights alone.

    Every task has a table of TABLE numbers: the largest weight of the features that meet in each. A sum over it is
    never below the sum of the weights, so no sentence is lost; the others needn't meet the weights.
    """
    peaks = weights.filter("weight > 0").groupBy(F.pmod("f", F.lit(TABLE)).alias("at")).agg(F.max("weight").alias("weight")).toArrow()
    table = np.zeros(TABLE, np.float32)
    table[peaks["at"].to_numpy()] = np.nextafter(peaks["weight"].to_numpy().astype(np.float32), np.float32(np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column(2)
            flat = features.flatten()
            owner = np.repeat(np.arange(len(batch)), features.value_lengths().to_numpy(zero_copy_only=False))
            most = np.bincount(owner, table[flat.to_numpy() & (TABLE - 1)], len(batch))
            kept = (prior + 0.5 * most > -1e-3)[owner]
            take = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), flat.filter(pa.array(kept))], ["h", "n", "f"])

    return said.select("h", "n", "features").mapInArrow(run, "h bigint, n bigint, f bigint")


def refused(chat: DataFrame, documents: DataFrame, rounds: int = ROUNDS, shrink: float = 1.0) -> DataFrame:
    """(h) of the answers' sentences that refuse: ``Refusals`` trained on all answers and all documents, its counts in tables."""
    said = cut(answer_sentences(chat))
    held = cut(document_features(documents))
    weighed = F.least("n", F.lit(MOST))
    total = said.agg(F.sum("n").alias("n"), F.sum(weighed * F.size("features")).alias("features")).first()
    others = held.groupBy("sentence").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect()
    features = (total["features"] or 0) + sum(r["d"] for r in others if not r["sentence"])
    often = (total["n"] or 0) / max(sum(r["n"] for r in others if r["sentence"]), 1)
    # A feature's weight needs its counts in all sentences and, each round, in those that refuse.
    seen = said.select(F.explode("features").alias("f"), weighed.alias("c")).groupBy("f").agg(F.sum("c").alias("c"))
    seen = cut(seen.join(held.filter("NOT sentence").select("f", "d"), "f", "left").select("f", (F.col("c") + F.coalesce("d", F.lit(0))).alias("c")))
    same = held.filter("sentence").select(F.col("f").alias("h"), F.col("n").alias("there"))
    guess = cut(said.filter("likely").join(same, "h", "left").filter(F.col("n") > F.coalesce("there", F.lit(0)) * often).select("h", "n", "features"))
    for _ in range(rounds):
        t = guess.agg(F.sum("n").alias("n"), F.sum(weighed * F.size("features")).alias("features")).first()
        if not t["n"]:
            break
        share = min(t["features"] / features, SURE)
        prior = log(t["n"] / (total["n"] - t["n"] + 1))
        yes = guess.select(F.explode("features").alias("f"), weighed.alias("y")).groupBy("f").agg(F.sum("y").alias("y"))
        y = F.coalesce("y", F.lit(0))
        weight = F.log((y + shrink * share) / (F.col("c") - y + shrink * (1 - share))) - log(share / (1 - share))
        weights = cut(seen.join(yes, "f", "left").select("f", weight.alias("weight")))
        judged = possible(said, weights, prior).join(weights, "f").groupBy("h", "n").agg(F.sum("weight").alias("weight"), F.collect_list("f").alias("features"))
        guess = cut(judged.filter(prior + 0.5 * F.col("weight") > 0).select("h", "n", "features"))
    return guess.select("h")


def broken_pairs(chat: DataFrame, documents: DataFrame) -> DataFrame:
    """(message_id, defect) of the answers that are none; ``documents`` trains the language models.

    * null or blank content of an answer: ``empty``. A null prompt can be neither copied nor compared.
    * a message delivered twice counts once; messages without id, notebook or seq are in no pair.
    * one defect at most, the first of empty, copy, refusal, wrong_language, truncated.
    * one notebook, and one ending, may hold any share of the messages. Empty table: no rows. Extra columns are ignored.
    """
    model = Bayes(agreeing(sample_documents(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = lambda g: None if g is None else gram_hash(g)
        for batch in batches:
            ids, prompts, responses = (c.to_pylist() for c in batch.columns)
            found = [defect_of(p, r, model) for p, r in zip(prompts, responses, strict=True)]
            said = [[] if d in ("empty", "copy") else list(dict.fromkeys(Refusals._normal(r[a:b]) for a, b, _ in sentences(r))) for d, r in zip(found, responses, strict=True)]
            tails = [(None if d else tail_grams(r)) or (None,) * 4 for d, r in zip(found, responses, strict=True)]
            rest = [pa.array([hashed(t[k]) for t in tails], pa.int64()) for k in (1, 2, 3)] + [pa.array([hashed(t[1] and ending_of(t[1])) for t in tails], pa.int64())]
            columns = [pa.array(ids, pa.string()), pa.array(found, pa.string()), pa.array(said, pa.list_(pa.string())), pa.array([t[0] for t in tails], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *rest], ["message_id", "defect", "said", "mark", "w", "p", "g", "c"])

    judged = question_answers(chat).mapInArrow(run, "message_id string, defect string, said array<string>, mark string, w bigint, p bigint, g bigint, c bigint")
    judged = cut(judged.withColumn("said", F.transform("said", lambda s: F.xxhash64(s))))
    declined = judged.select("message_id", F.explode("said").alias("h")).join(refused(chat, documents), "h", "left_semi").select("message_id", F.lit(True).alias("declined")).distinct()
    declines = F.coalesce("declined", F.lit(False))
    answers = judged.drop("said").join(declined, "message_id", "left")
    answers = cut(answers.withColumns({"defect": F.when(declines, "refusal").otherwise(F.col("defect")), "mark": F.when(~declines, F.col("mark"))}).drop("declined"))
    broken = truncated(answers, cut(end_counts(chat)))
    same = [answers[c].eqNullSafe(broken[c]) for c in ("mark", "w", "p", "g")]
    late = answers.filter(F.col("mark").isNotNull()).join(broken, same, "left_semi").select("message_id", F.lit("truncated").alias("defect"))
    return answers.filter(F.col("defect").isNotNull()).select("message_id", "defect").unionByName(late)
