"""Full-text search: tokenizer, inverted index, query grammar and BM25, in batches of queries.

A batch of questions is parsed into small plans, one row each (``plans``), and evaluated against stored
postings with positions (``answered``): its distinct phrases are found once, starting from
their rarest word; a question is then driven by its rarest required phrase, so a
frequent word never meets all the questions that hold it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from foliant.functions.text import col
from foliant.session import cut, stored

K1, B = 1.2, 0.75
#: Inverse document frequency of a term that more than half of the chunks have.
LEAST_IDF = 1e-6
NO_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


def fold_map() -> tuple[str, str]:
    """Letters of Latin-1 to Latin Extended-B that are one letter with one mark, and those letters; lower case."""
    pairs = []
    for point in range(0x00C0, 0x0250):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and chr(point) == chr(point).lower():
            pairs.append((chr(point), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(c: Column | str) -> Column:
    """Terms of a text: lower case, without diacritics, letters and digits only."""
    plain = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), *fold_map())
    return F.filter(F.split(plain, NO_TOKEN), lambda x: x != "")


def token_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, _t): the terms of each row; behind a generator, so that later steps use them without computing them again."""
    return df.select(*keys, F.explode(F.array(tokens(text))).alias("_t"))


def postings_of(tokenised: DataFrame, group: str = "notebook_id", key: str = "chunk_seq") -> DataFrame:
    """(group, key, term, tf, positions) of tokenised rows; a chunk's words meet in its own row, so nothing is shuffled."""
    kinds = dict(tokenised.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, places = [], [], []
            for i, words in enumerate(batch.column(2).to_pylist()):
                at: dict[str, list[int]] = {}
                for pos, word in enumerate(words or ()):
                    at.setdefault(word, []).append(pos)
                rows += [i] * len(at)
                terms += at
                places += at.values()
            take = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(terms, pa.string()), pa.array([len(p) for p in places], pa.int64()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [group, key, "term", "tf", "positions"])

    return tokenised.select(group, key, "_t").mapInArrow(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, term string, tf bigint, positions array<int>")


def index(chunks: DataFrame, group: str = "notebook_id", key: str = "chunk_seq", text: str = "chunk_text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, stats) of an inverted index whose statistics are per group.

    postings: group, key, term, tf and the term's ``positions``; lengths: group, key, len; stats: group, n,
    avgdl. The texts are read once; postings and lengths are stored.
    """
    tokenised = stored(token_rows(chunks, [group, key], text))
    lengths = stored(tokenised.select(group, key, F.size("_t").cast("bigint").alias("len")))
    return stored(postings_of(tokenised, group, key)), lengths, lengths.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def bm25(tf: Column, length: Column, avgdl: Column, n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


class QueryError(ValueError):
    """The message is no query of the grammar."""


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()^*+:,])|([^\s"()^*+:,]+))')


Node = tuple
#: The only column of the index.
COLUMN = "chunk_text"


class Parser:
    """Recursive-descent parser of full-text queries.

    Implicit AND, ``AND``/``OR``/``NOT`` in capitals, ``"phrases"``, ``a + b``, ``prefix*``, ``^first``, ``NEAR(a b, n)``
    and ``chunk_text : ...``. Anything else is a QueryError. Nodes: ("phrase", words, prefix, first),
    ("near", ((words, prefix), ...), distance), ("and" | "or" | "not", left, right).
    """

    def __init__(self, query: str) -> None:
        self.parts: list[tuple[str, str]] = []
        at = 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise QueryError(query)
            at = m.end()
            if m.group(1) is not None:
                self.parts.append(("phrase", m.group(1).replace('""', '"')))
            elif m.group(2):
                self.parts.append((m.group(2), m.group(2)))
            elif re.fullmatch(r"[\w\u001a]+", m.group(3)):
                self.parts.append(("word", m.group(3)))
            else:
                raise QueryError(query)
        self.at = 0
        if not self.parts:
            raise QueryError("empty")
        self.root = self._or()
        if self.at != len(self.parts):
            raise QueryError(query)

    def _peek(self, kind: str, value: str | None = None) -> bool:
        return self.at < len(self.parts) and self.parts[self.at][0] == kind and value in (None, self.parts[self.at][1])

    def _take(self) -> tuple[str, str]:
        if self.at == len(self.parts):
            raise QueryError("unexpected end")
        self.at += 1
        return self.parts[self.at - 1]

    def _chain(self, word: str, below) -> Node:
        found = below()
        while self._peek("word", word):
            self.at += 1
            found = (word.lower(), found, below())
        return found

    def _or(self) -> Node:
        return self._chain("OR", lambda: self._chain("AND", lambda: self._chain("NOT", self._juxtaposed)))

    def _juxtaposed(self) -> Node:
        found = self._one()
        while self.at < len(self.parts) and (self._peek("phrase") or self._peek("(") or self._peek("^") or (self._peek("word") and self.parts[self.at][1] not in ("AND", "OR", "NOT"))):
            found = ("and", found, self._one())
        return found

    def _one(self) -> Node:
        if self._peek("("):
            self.at += 1
            found = self._or()
            if self._take()[0] != ")":
                raise QueryError("parenthesis")
            return found
        if self.at + 1 < len(self.parts) and self.parts[self.at + 1][0] == ":" and self.parts[self.at][0] in ("word", "phrase"):
            if self._take()[1].lower() != COLUMN:
                raise QueryError("no such column")
            self.at += 1
            return self._one()
        if self._peek("word", "NEAR") and self.at + 1 < len(self.parts) and self.parts[self.at + 1][0] == "(":
            return self._near()
        first = self._peek("^")
        if first:
            self.at += 1
        return ("phrase", *self._phrase(), first)

    def _phrase(self) -> tuple[tuple[str, ...], bool]:
        words: list[str] = []
        while True:
            kind, value = self._take()
            if kind not in ("word", "phrase") or (kind == "word" and value in ("AND", "OR", "NOT")):
                raise QueryError(value)
            words += terms_of(value)
            if not self._peek("+"):
                break
            self.at += 1
        prefix = self._peek("*")
        if prefix:
            self.at += 1
        return tuple(words), prefix

    def _near(self) -> Node:
        self.at += 2
        phrases = []
        distance = 10
        while not self._peek(")"):
            if self._peek(","):
                self.at += 1
                number = self._take()[1]
                if not number.isdigit():
                    raise QueryError("NEAR")
                distance = int(number)
                break
            phrases.append(self._phrase())
        if self._take()[0] != ")" or not phrases:
            raise QueryError("NEAR")
        return ("near", tuple(phrases), distance)


def _starts(terms: Column, words: tuple[str, ...], prefix: bool, i: Column) -> Column:
    def same(k: int) -> Column:
        there = F.get(terms, i + k)
        return there.startswith(words[k]) if prefix and k == len(words) - 1 else there == words[k]

    return reduce(lambda a, b: a & b, [F.coalesce(same(k), F.lit(False)) for k in range(len(words))])


def _places(terms: Column, words: tuple[str, ...], prefix: bool) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(terms) - 1, F.lit(0))), lambda i: _starts(terms, words, prefix, i))


def predicate(node: Node, terms: Column) -> Column:
    """A parsed query as a predicate over a term array; for a query that is a constant of the plan."""
    kind = node[0]
    if kind in ("and", "or", "not"):
        left, right = predicate(node[1], terms), predicate(node[2], terms)
        return left & right if kind == "and" else left | right if kind == "or" else left & ~right
    if kind == "phrase":
        _, words, prefix, first = node
        if not words:
            return F.lit(False)
        if first:
            return _starts(terms, words, prefix, F.lit(0))
        return F.array_contains(terms, words[0]) if len(words) == 1 and not prefix else F.size(_places(terms, words, prefix)) > 0
    _, phrases, distance = node
    if any(not w for w, _ in phrases):
        return F.lit(False)
    starts = [_places(terms, w, p) for w, p in phrases]

    # From each start of the first, the others within the distance on either side.
    def close(i: Column) -> Column:
        def one(k: int) -> Column:
            gap, back = len(phrases[0][0]) + distance, len(phrases[k][0]) + distance
            return F.exists(starts[k], lambda j: (j <= i + gap) & (j >= i - back))

        return reduce(lambda a, b: a & b, [one(k) for k in range(1, len(phrases))], F.lit(True))

    return F.exists(starts[0], close)


_FOLD = str.maketrans(*fold_map())
_TERM = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    """The terms of a query word, as ``tokens`` gives those of a text."""
    return _TERM.findall(text.lower().translate(_FOLD))


def matching(query: str, terms: Column | str, strict: bool = True) -> Column:
    """Predicate of a query over a term array; in lenient mode a message that is no query means all of its words."""
    try:
        return predicate(Parser(query).root, col(terms))
    except QueryError:
        if strict:
            raise
        words = terms_of(query)
        return reduce(lambda a, b: a & b, [F.array_contains(col(terms), w) for w in words]) if words else F.lit(False)


def like_any(text: Column | str, message: Column) -> Column:
    """Whether a text holds any white-space term of the message; ASCII case is ignored, ``%`` and ``_`` are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate(col(text), upper, lower)
    parts = F.filter(F.split(F.translate(message, upper, lower), r"\s+"), lambda x: x != "")
    # A term without wildcards is a plain substring; others are translated to a regular expression.
    def has(t: Column) -> Column:
        body = F.regexp_replace(t, r"([\\.\[\](){}^$|?*+\-])", r"\\$1")
        body = F.replace(F.replace(body, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit("."))
        pattern = F.concat(F.lit("(?s)"), body)
        return F.when(t.rlike("[%_]"), F.regexp_like(plain, pattern)).otherwise(F.contains(plain, t))

    return F.coalesce(F.exists(parts, has), F.lit(False))


# --- batches of questions

AND, OR, NOT = -1, -2, -3
PLAN = "ok boolean, atoms array<struct<id: bigint, phrases: array<struct<words: array<string>, prefix: boolean>>, distance: int, first: boolean>>, program array<int>, must array<int>, scored array<int>"


def plan_of(query: str | None) -> tuple:
    """(ok, atoms, program, must, scored) of a question.

    atoms: its phrases and NEAR groups; program: atom numbers and AND, OR, NOT in postfix order; must: atoms that
    every hit has; scored: the phrases that count, those of NEAR groups one by one.
    """
    try:
        root = Parser(query or "").root
    except QueryError:
        return False, [], [], [], []
    atoms: list[tuple] = []
    program: list[int] = []
    scored: list[int] = []

    def atom(phrases: tuple, distance: int, first: bool) -> int:
        name = repr((phrases, distance, first)).encode("utf-8", "surrogatepass")
        atoms.append((int.from_bytes(blake2b(name, digest_size=8).digest(), "little", signed=True), [(list(w), p) for w, p in phrases], distance, first))
        return len(atoms) - 1

    def walk(node: Node) -> set[int]:
        kind = node[0]
        if kind in ("phrase", "near"):
            if kind == "phrase":
                own = atom(((node[1], node[2]),), -1, node[3])
                scored.append(own)
            else:
                own = atom(node[1], node[2], False)
                scored.extend(atom((p,), -1, False) for p in node[1])
            program.append(own)
            return {own}
        left, right = walk(node[1]), walk(node[2])
        program.append({"and": AND, "or": OR, "not": NOT}[kind])
        return left | right if kind == "and" else left & right if kind == "or" else left

    must = walk(root)
    return True, atoms, program, sorted(must), scored


def plans(queries: DataFrame, text: str = "query") -> DataFrame:
    """``queries`` with the columns of PLAN; a question that is no query of the grammar is not ``ok``."""
    kept = [f for f in queries.schema.fields if f.name != text]
    names = [f.split()[0] for f in ("ok b", "atoms a", "program p", "must m", "scored s")]
    word = pa.struct([("words", pa.list_(pa.string())), ("prefix", pa.bool_())])
    types = [pa.bool_(), pa.list_(pa.struct([("id", pa.int64()), ("phrases", pa.list_(word)), ("distance", pa.int32()), ("first", pa.bool_())])), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query in batch.column(batch.num_columns - 1).to_pylist():
                ok, atoms, *rest = plan_of(query)
                shaped = [{"id": i, "phrases": [{"words": w, "prefix": p} for w, p in phrases], "distance": n, "first": first} for i, phrases, n, first in atoms]
                out.append((ok, shaped, *rest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*[f.name for f in kept], *names])

    schema = StructType([*kept, *_parse_datatype_string(PLAN).fields])
    return queries.select(*[f.name for f in kept], text).mapInArrow(run, schema)


def occurrences(phrases: list, distance: int, first: bool, found: dict[tuple[int, int], list[int]]) -> int:
    """How often an atom occurs in a chunk; found: positions of word j of phrase i."""
    starts = []
    for i, phrase in enumerate(phrases):
        if not phrase["words"]:
            return 0
        at = set(found.get((i, 0), ()))
        for j in range(1, len(phrase["words"])):
            at &= {p - j for p in found.get((i, j), ())}
        starts.append(sorted(p for p in at if not first or p == 0))
        if not starts[-1]:
            return 0
    if distance < 0:
        return len(starts[0])
    size = [len(p["words"]) for p in phrases]
    return sum(all(any(a - size[k] - distance <= b <= a + size[0] + distance for b in starts[k]) for k in range(1, len(starts))) for a in starts[0])


def atom_hits(asked: DataFrame, postings: DataFrame, group: str = "notebook_id", key: str = "chunk_seq") -> DataFrame:
    """(group, atom, key, f): the chunks of each distinct atom and how often it occurs there.

    A single word is its posting. Other atoms start from their rarest word; its chunks are looked up for the other words.
    """
    atoms = asked.select(group, F.explode("atoms").alias("a")).select(group, F.col("a.id").alias("atom"), "a.phrases", "a.distance", "a.first")
    atoms = atoms.groupBy(group, "atom").agg(*[F.first(c).alias(c) for c in ("phrases", "distance", "first")])
    one = F.get("phrases", F.lit(0))
    simple = (F.size("phrases") == 1) & (F.col("distance") < 0) & ~F.col("first") & (F.size(one["words"]) == 1) & ~one["prefix"]
    atoms = cut(atoms)
    alone = atoms.filter(simple).select(group, "atom", F.get(one["words"], F.lit(0)).alias("term"))
    words = atoms.filter(~simple).select(group, "atom", F.size(F.flatten(F.transform("phrases", lambda p: p["words"]))).alias("need"), F.posexplode("phrases").alias("i", "p"))
    words = words.select(group, "atom", "need", "i", F.size("p.words").alias("n"), F.col("p.prefix").alias("open"), F.posexplode("p.words").alias("j", "term"))
    words = words.withColumn("open", F.col("open") & (F.col("j") == F.col("n") - 1))
    # Prefixes meet the vocabulary's beginnings of their own lengths.
    opened = words.filter("open").withColumnRenamed("term", "prefix")
    slots = words.filter(~F.col("open"))
    if not opened.isEmpty():
        lengths = opened.select(group, F.char_length("prefix").alias("l")).distinct()
        begun = postings.select(group, "term").join(lengths, group).filter(F.char_length("term") >= F.col("l")).distinct().withColumn("prefix", F.substring("term", F.lit(1), F.col("l")))
        slots = cut(slots.unionByName(opened.join(begun, [group, "prefix"]).select(*words.columns)))
    # The index is read once; from here on only the postings of words that were asked for.
    wanted = alone.select(group, "term").unionByName(slots.select(group, "term")).distinct()
    postings = cut(postings.join(wanted, [group, "term"], "left_semi"))
    direct = alone.join(postings.select(group, key, "term", "tf"), [group, "term"]).select(group, "atom", key, F.col("tf").alias("f"))
    counted = postings.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    slots = slots.join(counted, [group, "term"])
    width = slots.groupBy(group, "atom", "i", "j").agg(F.sum("df").alias("df"))
    rarest = width.groupBy(group, "atom").agg(F.min(F.struct("df", "i", "j")).alias("r")).select(group, "atom", "r.i", "r.j")
    there = slots.join(rarest, [group, "atom", "i", "j"]).select(group, "atom", "term").join(postings.select(group, key, "term"), [group, "term"]).select(group, "atom", key).distinct()
    found = slots.select(group, "atom", "need", "i", "j", "term").join(there, [group, "atom"]).join(postings.select(group, key, "term", "positions"), [group, key, "term"])
    # The words of one atom in one chunk.
    met = found.groupBy(group, "atom", key).agg(F.collect_list(F.struct("i", "j", "positions")).alias("w"), F.first("need").alias("need"))
    met = met.filter(F.size(F.array_distinct(F.transform("w", lambda x: F.struct(x["i"], x["j"])))) == F.col("need"))
    met = met.join(atoms.select(group, "atom", "phrases", "distance", "first"), [group, "atom"]).select(group, "atom", key, "phrases", "distance", "first", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for phrases, distance, first, w in zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True):
                places: dict[tuple[int, int], list[int]] = {}
                for x in w:
                    places.setdefault((x["i"], x["j"]), []).extend(x["positions"])
                counts.append(occurrences(phrases, distance, first, places))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], [group, "atom", key, "f"])

    schema = StructType([*met.select(group, "atom", key).schema.fields, StructField("f", LongType())])
    return direct.unionByName(met.mapInArrow(run, schema).filter("f > 0"))


def answered(asked: DataFrame, postings: DataFrame, lengths: DataFrame, stats: DataFrame, group: str = "notebook_id", key: str = "chunk_seq") -> DataFrame:
    """(qid, group, key, score): the hits of parsed questions (``plans``), scored by BM25 over their phrases; rounded to 9 digits.

    Statistics are those of all of a group's chunks. A question that is no query has no hits.
    """
    asked = asked.filter("ok")
    hits = cut(atom_hits(asked, postings, group, key))
    counted = hits.groupBy(group, "atom").agg(F.count(F.lit(1)).alias("df"))
    uses = asked.select("qid", group, F.posexplode("atoms").alias("k", "a"), "must", "program", "scored").select("qid", group, "k", F.col("a.id").alias("atom"), "must", "program", "scored")
    uses = uses.join(counted, [group, "atom"], "left").fillna(0, ["df"])
    required, needed = F.array_contains("must", F.col("k")), F.size("must") > 0
    # A required phrase that nobody has ends the question; else its rarest one, or all its phrases, lead to candidates.
    order = F.min(F.when(required, F.struct("df", "atom"))).over(Window.partitionBy("qid"))
    led = uses.withColumn("_lead", order).filter(F.when(needed, F.col("atom") == F.col("_lead.atom")).otherwise(F.col("df") > 0)).select("qid", group, "atom").distinct()
    candidates = led.join(hits.select(group, "atom", key), [group, "atom"]).select("qid", group, key).distinct()
    met = candidates.join(uses.select("qid", "k", "atom", "df"), "qid").join(hits, [group, "atom", key])
    weighed = met.join(lengths.select(group, key, "len"), [group, key]).join(stats, group)
    part = bm25(F.col("f"), F.col("len"), F.col("avgdl"), F.col("n"), F.col("df"))
    rows = weighed.groupBy("qid", group, key).agg(F.collect_list(F.struct("k", part.alias("part"))).alias("x"))  # a question's phrases
    rows = rows.join(asked.select("qid", "program", "scored"), "qid")

    def step(stack: Column, op: Column) -> Column:
        n = F.size(stack)
        left, right = F.get(stack, n - 2), F.get(stack, n - 1)
        both = F.when(op == AND, left & right).when(op == OR, left | right).otherwise(left & ~right)
        return F.when(op >= 0, F.array_append(stack, F.array_contains(F.transform("x", lambda y: y["k"]), op))).otherwise(F.array_append(F.slice(stack, 1, F.greatest(n - 2, F.lit(0))), both))

    holds = F.get(F.aggregate("program", F.array().cast("array<boolean>"), step), F.lit(0))
    score = F.aggregate(F.array_sort(F.filter("x", lambda y: F.array_contains(F.col("scored"), y["k"]))), F.lit(0.0), lambda s, y: s + y["part"])
    return rows.filter(holds).select("qid", group, key, F.round(score, 9).alias("score"))


def search(queries: DataFrame, chunks: DataFrame, group: str = "notebook_id", key: str = "chunk_seq", text: str = "chunk_text") -> DataFrame:
    """(qid, group, key, score): the chunks of each question's group with all of its words, however it is punctuated, by BM25.

    queries: ``qid``, the group and ``query``. A query without words finds nothing.
    """
    words = F.array_distinct(tokens("query"))
    asked = plans(queries.select("qid", group, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ").alias("query")))
    return answered(asked, *index(chunks, group, key, text), group, key)


def like_hits(queries: DataFrame, postings: DataFrame, chunks: DataFrame, group: str = "notebook_id", key: str = "chunk_seq", text: str = "chunk_text") -> DataFrame:
    """(qid, key): chunks of each question's group that hold any of its white-space terms (``like_any``).

    A term's longest run of letters and digits is looked up in the group's vocabulary, as part of a word; the chunks of
    those words are then compared letter by letter. Terms without such a run, which are rare, meet all chunks of their group.
    """
    parts = queries.select("qid", group, F.explode(F.array_distinct(F.filter(F.split("query", r"\s+"), lambda x: x != ""))).alias("like"))
    runs = F.filter(F.split(F.translate(F.lower("like"), *fold_map()), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")
    run = F.array_max(F.transform(runs, lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r"))))["r"]
    parts = parts.withColumn("run", run)
    vocabulary = postings.select(group, "term").distinct()
    asked = parts.filter("run IS NOT NULL").select(group, "run").distinct()
    # Vocabulary against looked-up runs, not rows against questions.
    spelled = asked.join(vocabulary, group).filter(F.contains("term", "run"))
    places = spelled.join(postings.select(group, key, "term"), [group, "term"]).select(group, "run", key).distinct()
    some = parts.join(places, [group, "run"]).select("qid", "like", key)
    all_ = parts.filter("run IS NULL").join(chunks.select(group, key), group).select("qid", "like", key)
    near = some.unionByName(all_).join(chunks.select(key, text), key)
    return near.filter(like_any(text, F.col("like"))).select("qid", key).distinct()
