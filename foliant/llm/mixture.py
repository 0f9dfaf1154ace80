"""Mixing sources to target weights (problem 8).

Iterative proportional fitting rakes the token weights of cells (source,
language, topic) to the wanted marginals: the sources' weights exactly, the
languages and topics as near as the sources' caps on repeats allow. Each
document then gets the whole part of its cell's repeats, and the documents of
smallest hash one more, up to the hash below which they hold the missing
tokens. That hash is found by histograms of fixed size, so no source is ever
sorted or gathered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliant.llm.bpe import ByteBpe, vocabulary_of
from foliant.llm.labels import trusted
from foliant.llm.language import LANGUAGES, Profiles, agreeing, clean_sentence, clean_texts, sample_texts, sentences
from foliant.session import cut

#: Bits of a document's hash that each histogram resolves, and how many histograms follow each other.
BITS, ROUNDS = 12, 3


#: Topics of each language, and hash places of the words that tell them.
TOPICS, PLACES = 4, 1024


class Labeller:
    """Language and topic of a text: the language of most of its words by rank-order profiles, and the
    nearest of that language's word clusters, fitted on a bounded sample of documents.
    """

    def __init__(self, texts: dict[str, list[str]], topics: int = TOPICS, iterations: int = 8, seed: int = 3) -> None:
        self.profiles = Profiles(agreeing(clean_texts(texts)))
        sampled = [t for many in texts.values() for t in many]
        codes, words = self._languages(sampled)
        counts = np.stack([self._places(w) for w in words]) if words else np.zeros((0, PLACES))
        self.weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0)))
        self.centres: dict[str, np.ndarray] = {}
        for code in set(codes):
            x = self._unit(counts[[c == code for c in codes]])
            rng = np.random.default_rng(seed)
            centres = x[rng.choice(len(x), min(topics, len(x)), replace=False)].copy()
            for _ in range(iterations):
                near = (x @ centres.T).argmax(axis=1)
                centres = self._unit(np.stack([x[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))]), 1.0)
            self.centres[code] = centres

    def _languages(self, texts: list[str]) -> tuple[list[str], list[list[str]]]:
        parts = [[w for a, b, _ in sentences(t) if (w := clean_sentence(t[a:b]))] for t in texts]
        said = iter(self.profiles.decide([w for many in parts for w in many]))
        codes = []
        for many in parts:
            size: Counter[str] = Counter()
            for w in many:
                k, _sure = trusted(w, *next(said))
                if k >= 0:
                    size[LANGUAGES[k]] += len(w)
            codes.append(max(size, key=lambda c: (size[c], c)) if size else "und")
        return codes, [[w for s in many for w in s] for many in parts]

    @staticmethod
    def _places(words: list[str]) -> np.ndarray:
        return np.bincount([crc32(w.encode("utf-8", "surrogatepass")) % PLACES for w in words], minlength=PLACES).astype(float)

    def _unit(self, x: np.ndarray, weight: np.ndarray | float | None = None) -> np.ndarray:
        x = np.asarray(x, float) * (self.weight if weight is None else weight)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def labels(self, texts: list[str]) -> list[tuple[str, str]]:
        """(language, topic) of each text; ``und`` for none."""
        codes, words = self._languages(texts)
        out = []
        for code, many in zip(codes, words, strict=True):
            centres = self.centres.get(code)
            k = 0 if centres is None or not many else int((centres @ self._unit(self._places(many)[None])[0]).argmax())
            out.append((code, f"{code}-{k}" if centres is not None and many else "und"))
        return out


#: The marginals that a ``Labeller`` gives.
LABELS = ("language", "topic")


def sized_documents(documents: DataFrame, labeller: Labeller | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, source, [language, topic,] tokens) of every document, each id once; null and empty texts have 0 tokens.

    The texts are read, counted and labelled in one narrow map and not shuffled.
    """
    vocabulary = vocabulary_of(documents.sparkSession, path)
    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    columns = ["source", *(LABELS if labeller else ())]
    schema = StructType([*rows.drop("text").schema.fields, *[StructField(c, StringType()) for c in columns[1:]], StructField("tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(2).to_pylist()]
                counts = pa.array([len(bpe.packed(t)) // 4 for t in texts], pa.int64())
                told = list(zip(*labeller.labels(texts), strict=True)) if labeller and texts else [[] for _ in columns[1:]]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *[pa.array(c, pa.string()) for c in told], counts], ["doc_id", *columns, "tokens"])

    kept = [F.max_by(c, F.struct("tokens", *columns)).alias(c) for c in columns]
    return rows.mapInArrow(run, schema).groupBy("doc_id").agg(*kept, F.max("tokens").alias("tokens"))


def filled_to(w: np.ndarray, cap: np.ndarray, total: float, rounds: int = 60) -> np.ndarray:
    """``w`` scaled so that it sums to ``total``, no entry above its cap; what is cut off goes to the others."""
    total = min(total, float(cap.sum()))
    w = np.where((w <= 0) & (cap > 0), cap * 1e-12, w)
    full = np.zeros(len(w), bool)
    for _ in range(rounds):
        free = ~full
        rest = w[free].sum()
        if rest <= 0:
            break
        w = np.where(full, cap, w * max(total - cap[full].sum(), 0.0) / rest)
        over = free & (w > cap)
        if not over.any():
            break
        full |= over
    return np.minimum(w, cap)


def rake(available: np.ndarray, most: np.ndarray, source: np.ndarray, weights: dict, others: list[tuple[np.ndarray, dict]], rounds: int = 300, close: float = 1e-7) -> np.ndarray:
    """Tokens to take of each cell by iterative proportional fitting.

    available: tokens of each cell; most: repeats allowed; source: each cell's source; weights: source -> share. The
    sources' shares are met exactly, in the largest total that their caps allow; a source without tokens is left out
    and the others share its weight. others: further marginals, as (label of each cell, label -> share); labels
    without tokens or target keep what the other marginals leave them, and a target beyond the caps is met as far as they allow.
    """
    stock = {k: float(available[source == k].sum()) for k in set(source.tolist())}
    wanted = {k: v for k, v in weights.items() if stock.get(k, 0) > 0}
    if not wanted:
        return np.zeros(len(available))
    whole = sum(wanted.values())
    cap = available * most * np.isin(source, list(wanted))
    total = min(cap[source == k].sum() / (v / whole) for k, v in wanted.items())
    rows_of = [(source == k, total * v / whole) for k, v in wanted.items()]
    limits = []
    for label, target in others:
        there = {k: v for k, v in target.items() if cap[label == k].sum() > 0}
        share = sum(there.values())
        limits.append([(label == k, total * v / share) for k, v in there.items()] if share > 0 else [])
    w = cap.astype(float)
    for _ in range(rounds):
        before = w.copy()
        for many in [*limits, rows_of]:
            for rows, goal in many:
                w[rows] = filled_to(w[rows], cap[rows], goal)
        if np.abs(w - before).max(initial=0) <= close * total:
            break
    return w


def hash_edges(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, below, rest): for each key the hash below which its rows hold at most the plan's ``missing`` tokens, and what is then left of it.

    Each of ROUNDS histograms resolves BITS further bits of the hash; keys whose rows hold no more than is missing have no edge.
    """
    edge = plan.select(*keys, "missing", F.lit(0).cast("bigint").alias("low"))
    for r in range(ROUNDS):
        width = 1 << BITS * (ROUNDS - 1 - r)
        inside = rows.join(edge, keys).filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * (1 << BITS)))
        bins = inside.groupBy(*keys, "missing", "low", F.floor((F.col("h") - F.col("low")) / width).alias("bin")).agg(F.sum("tokens").alias("t"))
        bins = bins.withColumn("upto", F.sum("t").over(Window.partitionBy(*keys).orderBy("bin"))).filter(F.col("upto") > F.col("missing"))
        first = F.min(F.struct("bin", (F.col("missing") - F.col("upto") + F.col("t")).alias("missing")))
        crossed = bins.groupBy(*keys, "low").agg(first.alias("x"))
        edge = cut(crossed.select(*keys, F.col("x.missing").alias("missing"), (F.col("low") + F.col("x.bin") * width).alias("low")))
    return edge.select(*keys, F.col("low").alias("below"), F.col("missing").alias("rest"))


def mixture(
    documents: DataFrame, targets: DataFrame, marginals: dict[str, dict[str, float] | None] | None = None, path: str | None = None, seed: int = 7
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, report, marginal report) of the largest mixture with the wanted shares of tokens.

    selection: doc_id, source, language, topic, copies (1 to max_repeats), tokens of one copy.
    report: source, weight, max_repeats, documents, available_tokens,
    taken_tokens, target_share (the weight among sources that have tokens),
    actual_share. marginal report: marginal, label, available_share, target_share, actual_share.
    ``marginals``: targets of ``language`` and ``topic``, label -> share; None (or no entry) stands for the
    shares that the labels have in all mixed sources together, so that weighting the sources doesn't shift them more than it must;
    an empty dict switches a marginal off. Languages are those of the texts, not of the label column. The cells are at most
    (sources of ``targets``) x (languages and topics); only they reach the driver.

    * a source without documents or tokens reaches 0, the others share its weight in proportion.
    * repeated target rows: the largest weight and smallest cap; null or non-positive weight or cap: not mixed.
    * documents of no target source, null source, null id or without tokens: not selected. Rows repeated under one id count once.
    * empty documents or targets: an empty selection. Extra columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    given = {k: (marginals or {}).get(k) for k in LABELS}
    wanted = targets.filter("source IS NOT NULL AND weight > 0 AND max_repeats > 0").groupBy("source").agg(F.max("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    keys = ["source", *LABELS]
    mixed = documents.select("doc_id", "text", F.col("source").cast("string").alias("source")).join(wanted.select("source"), "source", "left_semi")
    labeller = Labeller(sample_texts(documents))
    sized = cut(sized_documents(mixed, labeller, path).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - BITS * ROUNDS)))

    cells = sized.filter("tokens > 0").groupBy(*keys).agg(F.sum("tokens").alias("available")).join(wanted, "source").orderBy(*keys).toPandas()
    available = cells["available"].to_numpy(float)
    most = cells["max_repeats"].to_numpy(float)
    weights = dict(zip(cells["source"], cells["weight"].astype(float), strict=True))
    shares = {k: (cells.groupby(k)["available"].sum() / max(available.sum(), 1)).to_dict() for k in LABELS}
    goals = {k: shares[k] if given[k] is None else given[k] for k in LABELS}
    take = rake(available, most, cells["source"].to_numpy(), weights, [(cells[k].to_numpy(), goals[k]) for k in LABELS if goals[k]]) if len(cells) else available
    repeats = np.minimum(np.divide(take, available, out=np.zeros_like(take), where=available > 0), most)
    base = np.floor(repeats + 1e-9)
    plan_rows = [(*map(str, cells.loc[i, keys]), int(base[i]), float((repeats[i] - base[i]) * available[i])) for i in range(len(cells))]
    schema = ", ".join(f"{k} string" for k in keys) + ", base int, missing double"
    # No wider than the cells; the planner broadcasts it while it is small.
    plan = spark.createDataFrame(plan_rows, schema)

    whole = sized.filter("tokens > 0")
    first = whole.join(plan, keys).join(hash_edges(whole, plan, keys), keys, "left")
    first = cut(first.withColumn("copies", F.col("base") + F.coalesce(F.col("h") < F.col("below"), F.lit(False)).cast("int")).drop("base", "missing", "below", "rest"))
    # What the cells of a source leave over is less than a document each; the source's other documents make it up.
    budgets = cells.assign(take=take).groupby("source").agg(take=("take", "sum"), most=("max_repeats", "max")).reset_index() if len(cells) else cells.assign(take=take, most=most)
    budget = spark.createDataFrame([(str(r.source), float(r.take), int(r.most)) for r in budgets.itertuples()], "source string, take double, most int")
    over = first.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t")).join(budget, "source").select("source", "most", F.greatest(F.col("take") - F.col("t"), F.lit(0.0)).alias("missing"))
    over = cut(over)
    spare = first.join(over.select("source", "most"), "source").filter(F.col("copies") < F.col("most")).drop("most")
    edge = hash_edges(spare, over.drop("most"), ["source"])
    placed = first.join(over, "source").join(edge, "source", "left")
    free = F.col("copies") < F.col("most")
    # What is still missing is less than the next document; the one that fits best closes the source.
    closing = (
        placed.filter(free & (F.col("h") >= F.col("below")) & (F.abs(F.col("tokens") - F.col("rest")) < F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("rest")).alias("off"), "doc_id")).alias("x"))
        .select("source", F.col("x.doc_id").alias("closing"))
    )
    more = free & (F.coalesce(F.col("h") < F.col("below"), F.lit(False)) | F.coalesce(F.col("doc_id") == F.col("closing"), F.lit(False)))
    copies = (F.col("copies") + more.cast("int")).cast("int")
    selection = placed.join(closing, "source", "left").select("doc_id", *keys, copies.alias("copies"), "tokens").filter("copies > 0")
    selection = cut(selection)
    taken = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("taken_tokens"))
    stock = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"))
    zero = ["documents", "available_tokens", "taken_tokens"]
    total = Window.partitionBy()
    report = wanted.join(stock, "source", "left").join(taken, "source", "left").fillna(0, zero)
    has = F.when(F.col("available_tokens") > 0, F.col("weight")).otherwise(0.0)
    share = F.col("taken_tokens") / F.sum("taken_tokens").over(total)
    report = report.withColumns({"target_share": F.coalesce(has / F.sum(has).over(total), F.lit(0.0)), "actual_share": F.coalesce(share, F.lit(0.0))})
    one = [F.struct(F.lit(k).alias("marginal"), F.col(k).alias("label")) for k in LABELS]
    had = sized.filter("tokens > 0").select(F.explode(F.array(*one)).alias("x"), "tokens").groupBy("x").agg(F.sum("tokens").alias("had"))
    got = selection.select(F.explode(F.array(*one)).alias("x"), (F.col("copies") * F.col("tokens")).alias("t")).groupBy("x").agg(F.sum("t").alias("got"))
    goal_rows = [(k, label, float(v) / sum(goals[k].values())) for k in LABELS for label, v in goals[k].items()]
    goal = spark.createDataFrame(goal_rows, "marginal string, label string, target_share double").select(F.struct("marginal", "label").alias("x"), "target_share")
    of = Window.partitionBy("x.marginal")  # some dozens of labels
    part = lambda c: F.coalesce(F.col(c) / F.sum(c).over(of), F.lit(0.0))
    told = had.join(got, "x", "left").join(goal, "x", "left").select("x.marginal", "x.label", part("had").alias("available_share"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), part("got").alias("actual_share"))
    return selection, report.select("source", "weight", "max_repeats", *zero, "target_share", "actual_share"), told


__all__ = ["Labeller", "mixture", "rake", "sized_documents"]
