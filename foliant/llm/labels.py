"""Language of every chunk and of every segment of a mixed one (problem 2).

Sentences are compared with rank-order profiles (``language.Profiles``);
neighbouring sentences of one language form a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.language import LANGUAGES, Profiles, agreeing, clean_sentence, declared, sample_documents, sentences

SEGMENTS = "chunk_id string, notebook_id string, segment int, start int, end int, whole int, lang string, confidence double"

#: A sentence below this confidence, or with fewer words or letters, is joined to its neighbours' language.
SURE, WORDS, LETTERS = 0.06, 3, 9
#: What a sentence of fewer than so many words needs instead.
SHORT, SURE_SHORT = 6, 0.3


def fit_profiles(documents: DataFrame) -> Profiles:
    return Profiles(agreeing(sample_documents(documents)))


Sentence = tuple[int, int, bool, int, float]


def decided(texts: list[str], model: Profiles) -> list[list[Sentence]]:
    """(start, end, whole, language index or -1, confidence) of each sentence of each text."""
    parts = [sentences(t) for t in texts]
    words = [[clean_sentence(t[a:b]) for a, b, _ in p] for t, p in zip(texts, parts, strict=True)]
    said = iter(model.decide([w for many in words for w in many]))
    return [[(a, b, whole, *trusted(w, *next(said))) for (a, b, whole), w in zip(p, many, strict=True)] for p, many in zip(parts, words, strict=True)]


def trusted(words: list[str], language: int, sure: float) -> tuple[int, float]:
    enough = len(words) >= WORDS and sum(map(len, words)) >= LETTERS and sure >= (SURE_SHORT if len(words) < SHORT else SURE)
    return (language if enough else -1), sure


def segments(text: str, parts: list[Sentence]) -> list[tuple[int, int, int, str, float]]:
    """(start, end, whole sentences, language, confidence); a text without a decided sentence is one segment, ``und``."""
    out: list[list] = []
    lead: int | None = None
    for a, b, whole, k, sure in parts:
        if k < 0:
            if out:
                out[-1][1] = b
            elif lead is None:
                lead = a
            continue
        if out and out[-1][3] == k:
            out[-1][1] = b
        else:
            out.append([a if out or lead is None else lead, b, 0, k, 0.0, 0])
        last = out[-1]
        last[2] += whole and text[a : a + 1].strip() != "" and not text[a].islower()
        last[4] += sure * (b - a)
        last[5] += b - a
    if not out:
        return [(0, len(text), 0, "und", 0.0)]
    return [(a, b, n, LANGUAGES[k], round(s / max(size, 1), 4)) for a, b, n, k, s, size in out]


def label_segments(chunks: DataFrame, model: Profiles, types: list[str] | None = None) -> DataFrame:
    """One row per segment of each chunk (of the given types; all if None): place, whole sentences, language, confidence.

    A narrow Arrow map; the model (some 100 KB) goes with the task.

    * null or blank text: one segment ``und`` of confidence 0. No letters or only quoted text: likewise.
    * a chunk delivered twice gives its segments twice; whoever counts chunks drops duplicates.
    * very long texts are labelled whole. Empty table: no rows. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        for batch in batches:
            rows = []
            chunks_, notebooks, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            for chunk, notebook, text, parts in zip(chunks_, notebooks, texts, decided(texts, model), strict=True):
                rows += [(chunk, notebook, i, *s) for i, s in enumerate(segments(text, parts))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    if types:
        chunks = chunks.filter(F.lower(F.trim("chunk_type")).isin(types))
    return chunks.select("chunk_id", "notebook_id", "chunk_text").mapInArrow(run, SEGMENTS)


def declared_languages(settings: DataFrame) -> DataFrame:
    """(notebook_id, declared): the languages of each notebook's ``ocr_language``; of repeated rows the union."""
    words = F.split(F.lower(F.coalesce("ocr_language", F.lit(""))), r"[^\p{L}\p{N}]+")
    from foliant.llm.language import SPELLINGS

    code = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    codes = F.filter(F.transform(words, lambda w: F.element_at(code, w)), lambda c: c.isNotNull())
    return settings.select("notebook_id", F.explode_outer(codes).alias("c")).groupBy("notebook_id").agg(F.collect_set("c").alias("declared"))


def undeclared(chunks: DataFrame, settings: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, lang): languages of at least one whole sentence of a text chunk that its notebook doesn't declare.

    A notebook without settings declares none. ``declared`` holds at most the
    seven codes per notebook; the planner broadcasts it only while it is small.
    """
    rows = label_segments(chunks, fit_profiles(documents), ["text"]).filter("whole > 0 AND lang <> 'und'")
    return (
        rows.join(declared_languages(settings), "notebook_id", "left")
        .filter(~F.coalesce(F.array_contains("declared", F.col("lang")), F.lit(False)))
        .select("chunk_id", "lang")
        .distinct()
    )


__all__ = ["SEGMENTS", "declared", "declared_languages", "decided", "fit_profiles", "label_segments", "segments", "undeclared"]
