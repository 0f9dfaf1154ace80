"""Retrieval in batches: every question is answered, by the grammar, against brute force."""

import math
import random
import types

import pytest
from pyspark.sql import functions as F

from foliant import session
from foliant.operators import embedding, fulltext, retrieval, state
from foliant.sources import files


def test_every_question_of_a_large_batch_is_answered(spark):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)], "chunk_seq bigint, embedding array<float>")
    asked = spark.range(3000).select(F.col("id").alias("qid"), F.array(*[F.sin(F.col("id") + k).cast("float") for k in range(4)]).alias("qvec"))
    got = retrieval.vector_search(asked, vectors, 3, None).groupBy("qid").count().collect()
    assert len(got) == 3000 and all(r["count"] == 3 for r in got)


QUERIES = [
    "red pump", "red OR blue", "pump NOT red", '"red pump"', "red + pump", "pu*", "^the", "NEAR(red pump, 2)", "NEAR(red pump oil, 3)", "(red OR oil) AND pump", "chunk_text : red", '"the red" OR oil NOT blue',
    "red red", "the_red", "nobody", "nobody OR oil", "oil NOT nobody", '"pu*"', '"red pu" *',
]


def test_batches_of_questions_equal_the_predicate_on_every_text(spark):
    rng = random.Random(3)
    words = ["red", "blue", "pump", "pulp", "oil", "the", "valve"]
    texts = [(i, "n" if i % 3 else "m", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(160)] + [(900, "n", None), (901, None, "red pump")]
    chunks = spark.createDataFrame(texts, "chunk_seq bigint, notebook_id string, chunk_text string")
    asked = spark.createDataFrame([(f"{g}{k}", g, q) for k, q in enumerate(QUERIES) for g in "mn"], "qid string, notebook_id string, query string")
    index = fulltext.index(chunks.filter("notebook_id IS NOT NULL"))
    got = {(r["qid"], r["chunk_seq"]) for r in fulltext.answered(fulltext.plans(asked), *index).collect()}
    terms = fulltext.token_rows(chunks, ["chunk_seq", "notebook_id"], "chunk_text")
    hits = F.array(*[F.when(fulltext.matching(q, "_t"), F.lit(k)) for k, q in enumerate(QUERIES)])
    want = {(f"{r['notebook_id']}{k}", r["chunk_seq"]) for r in terms.filter("notebook_id IS NOT NULL").select("chunk_seq", "notebook_id", hits.alias("h")).collect() for k in r["h"] if k is not None}
    assert got == want and len({q for q, _ in want}) > 20


def test_phrases_count_by_their_frequency(spark):
    chunks = spark.createDataFrame([(1, "n", "red pump red pump dry"), (2, "n", "red pump oil oil oil"), (3, "n", "oil"), (4, "n", "dry"), (5, "n", "door"), (6, "n", "lamp")], "chunk_seq bigint, notebook_id string, chunk_text string")
    asked = fulltext.plans(spark.createDataFrame([(1, "n", '"red pump"')], "qid int, notebook_id string, query string"))
    got = {r["chunk_seq"]: r["score"] for r in fulltext.answered(asked, *fulltext.index(chunks)).collect()}
    length, mean = 5, 14 / 6
    idf = math.log((6 - 2 + 0.5) / (2 + 0.5))
    want = {k: idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) for k, f in ((1, 2), (2, 1))}
    assert got == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("query", ["hello?", "a,b", "it's", "AND", "a AND", "b-c", "", " ", '"open', "other : x", "NEAR(a, x)", "(a", None])
def test_what_is_no_query_is_an_error(query):
    assert fulltext.plan_of(query)[0] is False


def test_fallbacks_are_for_the_unanswered(spark):
    rows = spark.createDataFrame([(1, "n", "Red pump"), (2, "n", "a redness"), (3, "n", "100% dry"), (4, "n", "door")], "chunk_seq bigint, notebook_id string, chunk_text string")
    asked = spark.createDataFrame([("full", "n", "red"), ("like", "n", "edn zzz"), ("wild", "n", "1_0 zzz"), ("new", "n", "zzz"), ("bad", "n", "red?"), ("none", "x", "red")], "qid string, notebook_id string, query string")
    got = {(r["qid"], r["chunk_seq"], r["stage"]) for r in retrieval.text_hits(asked, fulltext.index(rows), rows, 2).collect()}
    # "1_0" is a word of the grammar's own; as a substring its underscore is a wildcard.
    assert got == {("full", 1, 0), ("like", 2, 1), ("wild", 3, 1), ("new", 4, 2), ("new", 3, 2)}
    assert retrieval.text_hits(asked.limit(0), fulltext.index(rows), rows, 2).count() == 0
    assert retrieval.text_hits(asked, fulltext.index(rows.limit(0)), rows.limit(0), 2).count() == 0


def test_free_names_count_on_until_a_name_is_free(spark):
    given = ["a.txt", "a.txt", "a_1.txt", "a_1.txt", "a.txt", "b", "b", ".env", "a_1.txt"]
    df = spark.createDataFrame([(i, "n", g, 0) for i, g in enumerate(given)] + [(90, "m", "a.txt", 0), (91, None, "a.txt", 0), (92, None, "a.txt", 0)], "id int, nb string, name string, stored int")
    got = {r["id"]: r["stored_name"] for r in state.free_names(df, "nb", "name", "id").collect()}
    assert [got[i] for i in range(9)] == ["a.txt", "a_1.txt", "a_1_1.txt", "a_1_2.txt", "a_2.txt", "b", "b_1", ".env", "a_1_3.txt"]
    assert (got[90], got[91], got[92]) == ("a.txt", "a.txt", "a_1.txt")


def test_upsert_takes_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 5), (None, "z", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 3), (1, "d", 2), (None, "y", 1), (None, "x", 1), (2, "e", 1), (2, "e", 1)], "k int, v string, at int")
    got = sorted((str(r["k"]), r["v"]) for r in state.upsert(old, new, ["k"], order="at").collect())
    assert got == [("1", "c"), ("2", "e"), ("None", "x"), ("None", "y"), ("None", "z")]


def test_parsed_files_of_every_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "doc_id": "d1",\n  "chunks": [\n    {"text": "one [\\n{", "chunk_type": "text"},\n    {"text": "two"}\n  ]\n}\n')
    (tmp_path / "b.json").write_text('[\n  {"text": "three", "chunk_index": 7}\n]')
    (tmp_path / "c.json").write_text('{"doc_id": "d2", "chunks": [{"text": "four"}]}\n{"doc_id": "d3", "chunks": [{"text": "five"}]}\n')
    (tmp_path / "d.json").write_text("{broken")
    got = sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in files.read_parsed(spark, f"file://{tmp_path}").collect())
    assert got == [("b.json", 7, "three"), ("d1", 0, "one [\n{"), ("d1", 1, "two"), ("d2", 0, "four"), ("d3", 0, "five")]


def test_a_missing_model_is_not_asked_for_again():
    calls = []

    def post(address, payload):
        calls.append(address)
        raise embedding.ModelMissing(address)

    client = embedding.chained_client(post, embedding.targets("http://h"), ["m"], 2)
    assert client(["a", "b"]) == [None, None] and client(["c"]) == [None] and len(calls) == 3
    assert embedding.vectors_of({"data": [{"embedding": [1.0]}, {}]}, 3, 1) == [[1.0], [0.0], [0.0]]
    assert embedding.targets("http://h/api/")[0] == ("http://h/api/embed", "native") and embedding.targets("http://h", "openai") == [("http://h/v1/embeddings", "openai")]
    assert embedding.targets("http://h", endpoint="x/y") == [("http://h/x/y", "native")]


def test_a_cluster_needs_a_shared_checkpoint_folder():
    def fake(master):
        none = types.SimpleNamespace(isDefined=lambda: False)
        context = types.SimpleNamespace(master=master, set=[], _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none)))
        context.setCheckpointDir = context.set.append
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.checkpoint_dir(fake(master))
    assert session.checkpoint_dir(fake("local[4]")).startswith("file://")


def test_first_folder(tmp_path):
    assert files.first_folder([None, "", "/no/such", str(tmp_path)]) == str(tmp_path)
    assert files.first_folder(["/no/such", "/nor/this"]) == "/nor/this" and files.first_folder([]) is None
