"""Edge cases of the engine's operators on small frames."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators import chat, chunkers, embedding, fulltext, ordering, retrieval, state
from foliant.plans import lifecycle
from foliant.sources import files
from foliant.streaming import events


def block_frame(spark, *texts):
    return chunkers.blocks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))


def texts(df):
    return [(r["doc_id"], r["chunk_text"]) for r in df.orderBy("doc_id", "chunk_index").collect()]


def test_word_rules(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \xa0",), ("a b\x1cc",), ("x" * 5,)], "t string")
    got = df.select(T.word_count("t"), T.token_count("t"), F.size(T.words("t"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (3, 3, 3), (1, 1, 1)]


def test_general_drops_lone_headers_and_keeps_the_last_of_several(spark):
    rows = block_frame(spark, "# A\n# B\nbody one\n# C", None, "", "# only")
    got = chunkers.general(rows, 10, 2, 1).collect()
    assert [(r["chunk_text"], r["section_header"]) for r in got] == [("B body one", "B")]


def test_short_window_doubles_without_moving_its_successor(spark):
    rows = block_frame(spark, " ".join(f"w{i}" for i in range(20)))
    got = [len(t.split()) for _, t in texts(chunkers.general(rows, 9, 0, 50))]
    assert got == [18, 11, 2]  # 9 tokens are short; the window grows, the offset still moves by 9
    first = chunkers.general(rows, 9, 0, 50).orderBy("chunk_index").first()
    assert first["prev_chunk_tail"] is None and first["next_chunk_head"] is None


def test_exactly_one_window_and_overlap_columns(spark):
    rows = block_frame(spark, "a b c d", "a b c d e")
    assert [t for _, t in texts(chunkers.general(rows, 4, 1, 1))] == ["a b c d", "a b c d", "e"]
    got = chunkers.general(rows, 4, 1, 1).filter("doc_id = 1").orderBy("chunk_index").collect()
    assert got[0]["next_chunk_head"] == "e" and got[1]["prev_chunk_tail"] == "d"


def test_table_packing_repeats_the_head(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(6))
    df = spark.createDataFrame([(table,), ("one\ntwo",), (None,)], "t string")
    packed = [r[0] for r in df.select(chunkers.packed_table(F.col("t"), F.lit(25))).collect()]
    assert all(p.startswith("| a | b |\n|---|---|\n") for p in packed[0]) and len(packed[0]) > 1
    assert sum(p.count("| x |") for p in packed[0]) == 6
    assert packed[1] == ["one\ntwo"]


def test_hierarchy_resets_lower_levels(spark):
    rows = block_frame(spark, "1.1 One\na\n1.1.1 Deep\nb\n1.2 Two\nc")
    got = chunkers.hierarchy(rows, "technical_manual", 50, 1).orderBy("chunk_index").collect()
    assert [r["section_header"] for r in got] == ["1.1 One", "1.1 One > 1.1.1 Deep", "1.2 Two"]
    assert got[1]["chunk_text"] == "1.1 One > 1.1.1 Deep\n\nb"


def test_symbol_separator_is_literal_and_empty_means_default(spark):
    rows = block_frame(spark, "a .* b .* .* c", "x ---chunk--- y")
    assert [t for d, t in texts(chunkers.by_symbol(rows, ".*")) if d == 0] == ["a", "b", "c"]
    assert [t for d, t in texts(chunkers.by_symbol(rows, "")) if d == 1] == ["x", "y"]


def test_grammar_errors_and_lenient_mode(spark):
    for bad in ("hello?", "can't", "a, b", "", "AND", "a AND", "(a", "b-c"):
        with pytest.raises(fulltext.QueryError):
            fulltext.matching(bad, "ts")
    rows = fulltext.token_rows(spark.createDataFrame([("Café hello",), ("",), (None,)], "t string"), [], "t").withColumnRenamed("_t", "ts")
    hits = lambda q, **k: rows.filter(fulltext.matching(q, "ts", **k)).count()
    assert hits("cafe") == 1 and hits("hello?", strict=False) == 1 and hits("Привет") == 0 and hits("cafe NOT hello") == 0


def test_bm25_equals_its_formula(spark):
    docs = ["a b a", "b c", "c c c d", "d"]
    chunks = spark.createDataFrame([("n", i, t) for i, t in enumerate(docs)], "notebook_id string, chunk_seq bigint, chunk_text string")
    asked = spark.createDataFrame([("q", "n", "a b"), ("none", "n", "zzz"), ("blank", "n", " ")], "qid string, notebook_id string, query string")
    got = {r["chunk_seq"]: r["score"] for r in fulltext.search(asked, chunks).collect()}
    split = [d.split() for d in docs]
    avg = sum(map(len, split)) / 4

    def part(t, d):
        n = sum(t in s for s in split)
        idf = math.log((4 - n + 0.5) / (n + 0.5))
        f = d.count(t)
        return (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg))

    assert got == {0: pytest.approx(part("a", split[0]) + part("b", split[0]), abs=1e-8)}


def test_like_is_ascii_folded_with_wildcards(spark):
    df = spark.createDataFrame([("Hello WORLD",), ("ПРИВЕТ",), (None,), ("50%",)], "t string")
    count = lambda q: df.filter(fulltext.like_any("t", F.lit(q))).count()
    assert count("world") == 1 and count("привет") == 0 and count("h_llo") == 1 and count("5%") == 1 and count("") == 0


def test_vector_search_without_group_answers_every_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rows = [(i, [1.0, i / 10]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "chunk_seq bigint, embedding array<float>")
    asked = vectors.select(F.col("chunk_seq").alias("qid"), F.col("embedding").alias("qvec"))
    got = {r["qid"]: r["chunk_seq"] for r in retrieval.vector_search(asked, vectors, 1, None).collect()}
    assert got == {i: i for i in range(20)}


def test_vector_search_equals_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    data = [("n" if i % 3 else "m", i, [float(x) for x in rng.normal(size=4 if i % 5 else 3)]) for i in range(150)]
    data += [("n", 500, [0.0] * 4), ("n", 501, None), ("n", 502, data[1][2]), ("n", 503, data[1][2])]
    vectors = spark.createDataFrame(data, "notebook_id string, chunk_seq bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, g, v) for g, i, v in data[:12]], "qid bigint, notebook_id string, qvec array<float>")
    got = {}
    for r in retrieval.vector_search(asked, vectors, 4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["chunk_seq"])

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        n = min(len(a), len(b))
        return round(float(a[:n] @ b[:n]) / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)), 9)

    for g, i, v in data[:12]:
        order = sorted((-cosine(v, w), k) for h, k, w in data if h == g and w is not None)
        assert got[i] == [k for _, k in order[:4]]
    assert retrieval.vector_search(asked, vectors.limit(0), 4).count() == 0


def test_fusion_and_normalisation(spark):
    v = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, chunk_seq bigint, rank bigint")
    t = spark.createDataFrame([("q", 1, 1), ("q", 3, 2), ("only", 9, 1)], "qid string, chunk_seq bigint, rank bigint")
    got = {(r["qid"], r["chunk_seq"]): r for r in retrieval.normalized_scores(retrieval.fuse(v, t, 5)).collect()}
    assert got["q", 1]["score"] == 1.0 and got["q", 2]["rank"] == 2 and got["q", 3]["rank"] == 3
    assert got["q", 2]["score"] < 0.5 < 0.75  # one list alone never passes a threshold beside a double first
    assert got["only", 9]["score"] == 1.0  # text only: no fused score, so everything passes


def test_previous_row_over_small_ranges_equals_lag(spark):
    rows = [("k", s, f"m{s}") for s in range(0, 50, 3)] + [("j", 7, "x"), (None, 8, "y"), ("k", None, "z")]
    df = spark.createDataFrame(rows, "k string, s bigint, t string")
    got = {(r["k"], r["s"]): r["prev_t"] for r in ordering.previous_row(df, "k", "s", ["t"], width=10).collect()}
    assert got["k", 0] is None and got["j", 7] is None and all(got["k", s] == f"m{s - 3}" for s in range(3, 50, 3)) and len(got) == 18
    assert ordering.previous_row(df.limit(0), "k", "s", ["t"]).count() == 0


def test_state_operators(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, made bigint, v string")
    new = spark.createDataFrame([("a", 9, "new"), ("c", 4, "w")], "k string, made bigint, v string")
    got = {r["k"]: (r["made"], r["v"]) for r in state.upsert(old, new, ["k"], ["made"]).collect()}
    assert got == {"a": (1, "new"), "b": (2, "y"), "c": (4, "w"), None: (3, "z")}
    tags = spark.createDataFrame([("t", True)], "tag string, is_enabled boolean")
    assert {tuple(r) for r in state.toggled_tag(tags, "u", False).collect()} == {("t", True), ("u", False)}
    one = spark.range(1).select(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("o"))
    assert one.select(state.moved(F.col("o"), F.lit("a"), F.lit(3)), state.toggled(F.col("o"), F.lit("b")), state.toggled(F.col("o"), F.lit("d"))).first()[:] == (["b", "c", "a"], ["a", "c"], ["a", "b", "c", "d"])
    m = spark.createDataFrame([("n", 1), ("o", 1)], "notebook_id string, seq bigint")
    versions = spark.createDataFrame([("o", 2)], "notebook_id string, version int")
    left, v = state.cleared(m, versions, m.filter("notebook_id = 'n'"))
    assert left.count() == 1 and {tuple(r) for r in v.collect()} == {("n", 1), ("o", 2)}
    assert {r["seq"] for r in state.appended_messages(m, m).filter("notebook_id = 'n'").collect()} == {1, 2}
    run = spark.createDataFrame([("a", "indexing"), ("b", "new")], "id string, status string")
    assert {tuple(r) for r in state.recovered(run, run.filter("id = 'b'")).select("id", "status", "has_docs").collect()} == {("a", "failed", False), ("b", "new", True)}


def test_vectors_and_advice(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = df.select(V.cosine("v", F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))), V.normalized("v"), V.all_zero("v")).collect()
    assert got[0][0] == 0.0 and got[0][1] == [0.0, 0.0] and got[0][2] is True
    assert got[1][0] == pytest.approx(1.0) and got[1][1] == pytest.approx([0.6, 0.8])
    advice = spark.createDataFrame([(500, 128, 16), (10_000, 130, 16), (200_000, 130, 16)], "n bigint, d bigint, m bigint")
    assert [tuple(r) for r in advice.select(V.quantization_advice("n"), V.largest_divisor("d", "m")).collect()] == [("none", 16), ("sq", 13), ("pq", 13)]


def test_chat_pieces(spark):
    m = spark.createDataFrame([("n", 1, "a"), ("n", 2, " "), ("n", 3, None), ("n", 4, "d")], "notebook_id string, seq bigint, content string")
    assert [r["seq"] for r in chat.history(m, 3).collect()] == [4]
    df = spark.createDataFrame([(" RAG ", ""), ("qa", "x"), (None, None), ("model", ""), ("agent", "")], "mode string, c string")
    got = df.select(chat.normalized_mode("mode"), chat.prompt("mode", "c"), chat.agent_label("mode", "c")).collect()
    assert [r[0] for r in got] == ["rag", "rag", "rag", "model", "agent"] and got[3][1] == chat.TEMPLATES["model_no_sources"] and "generalist" in got[4][1] and got[2][2] == "agent"


def test_embedding_client_failures_are_zero_vectors(spark):
    def client(batch):
        if any("fail" in t for t in batch):
            raise RuntimeError
        return [[1.0, 2.0, 2.0] for _ in batch]

    rows = spark.createDataFrame([(1, "ok", None), (2, "x", "fail"), (3, None, None)], "chunk_seq bigint, chunk_text string, embedding_text string")
    got = {r["chunk_seq"]: (r["failed"], [round(x, 3) for x in r["embedding"]]) for r in embedding.embed(rows, client, 4, batch=1).collect()}
    assert got[1] == (False, [0.333, 0.667, 0.667, 0.0]) and got[2] == (True, [0.0] * 4) and got[3][0] is False
    assert embedding.hashed_client(8)(["a b", "b a"])[0] == embedding.hashed_client(8)(["b a"])[0]


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "Heading1") + p("item", "ListBullet") + p("plain") + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    path.write_bytes(data.getvalue())


def test_files(spark, tmp_path):
    docx(tmp_path / "a.docx")
    (tmp_path / "b.docx").write_bytes(b"PKjunk")
    (tmp_path / "c.xlsx").write_bytes(b"x")
    (tmp_path / "d.TXT").write_bytes(b"good \xff line")
    (tmp_path / "e.bin").write_bytes(b"1")
    (tmp_path / ".hidden").write_bytes(b"x")
    rows = files.binary_files(spark, str(tmp_path))
    kinds = {r["filename"]: (r["r"], r["t"]) for r in rows.select("filename", files.reader_of("filename").alias("r"), files.file_type("filename").alias("t")).collect()}
    assert kinds == {"a.docx": ("docx", "docx"), "b.docx": ("docx", "docx"), "c.xlsx": ("xlsx", "xlsx"), "d.TXT": ("text", "other"), "e.bin": ("unsupported", "other")}
    got = [(r["text"], r["chunk_type"], r["section_header"]) for r in files.extracted_blocks(rows).filter("doc_id like '%a.docx'").orderBy("pos").collect()]
    assert got == [("Title", "header", "Title"), ("- item", "text", "Title"), ("plain", "text", "Title"), ("| a\\|b | c |\n| --- | --- |\n| 1 | 2 |", "table", "Title")]
    assert files.extracted_blocks(rows).filter("doc_id like '%b.docx'").first()["text"] == "Extracted content from b.docx"
    assert files.decoded_text(rows.filter("filename = 'd.TXT'")).first()["text"] == "good  line"
    assert files.within_limit(rows, 1).filter("filename = 'a.docx'").count() == 0


def test_parsed_json_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "t"), ("d2", "u")], "doc_id string, title string")
    chunks = spark.createDataFrame([("d1", 1, "b", "text", 2, None), ("d1", 0, "a", "text", None, "h")], "doc_id string, chunk_index bigint, text string, chunk_type string, page_number int, section_header string")
    files.write_parsed(docs, chunks, str(tmp_path / "out"))
    assert {tuple(r) for r in files.read_parsed(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in chunks.collect()}
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "x.json").write_text('[{"text": "a", "chunk_type": "text"}]\n')
    assert files.read_parsed(spark, str(bare)).select("doc_id", "chunk_index", "text").first()[:] == ("x.json", 0, "a")


def test_registry_and_json_rows(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"version": 1, "agents": [{"id": " a ", "name": "A", "provider": "OpenAI"}, {"id": "", "name": "B"}]}')
    got = chat.normalized_agents(files.agent_registry(spark, str(tmp_path / "r.json"))).collect()
    assert [(r["id"], r["provider"], r["version"], r["requires"]) for r in got] == [("a", "openai", "0.0.0", ["agent"])]
    rows = tmp_path / "rows"
    rows.mkdir()
    (rows / "1.json").write_text('{"id": "x", "created_at": "2"}')
    (rows / "2.json").write_text('{"id": "y", "created_at": "1"}')
    (rows / "3.json").write_text("{broken")
    assert [r["id"] for r in files.json_rows(spark, str(rows), "id string, created_at string").collect()] == ["y", "x"]


def test_page_lines_in_two_columns(spark):
    lines = [(1, 1, 0.0, 50.0, "Head", 14.0), (1, 1, 10.0, 50.0, "left", 10.0), (1, 1, 0.0, 300.0, "right", 10.0), (1, 1, 99.0, 50.0, "7", 10.0), (1, 2, 0.0, 50.0, "next", 10.0)]
    df = spark.createDataFrame(lines, "doc_id int, page int, y0 double, x0 double, text string, size double")
    got = files.page_lines(df).orderBy("pos").collect()
    assert [(r["text"], r["chunk_type"], r["section_header"]) for r in got] == [("Head", "header", "Head"), ("left", "text", "Head"), ("right", "text", "Head"), ("next", "text", "Head")]


def test_streams(spark, tmp_path):
    landing, seen = tmp_path / "in", []
    landing.mkdir()
    (landing / "a.txt").write_text("hello")
    run = lambda: events.index_stream(events.file_stream(spark, str(landing)), lambda df, i: seen.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    (landing / "b.txt").write_text("more")
    run()
    assert len(seen) == 2 and seen[0].endswith("a.txt") and seen[1].endswith("b.txt")
    rows = spark.createDataFrame([("client.click", 1), ("start", 2), (None, 3)], "event_type string, n int")
    app, client = events.routed(rows)
    assert app.count() == 2 and client.count() == 1


def test_documents_are_streamed_from_a_file_and_from_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(60)], "doc_id bigint, source string, n_chars int")
    docs.repartition(4).write.parquet(str(tmp_path / "many/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one/documents.parquet")
    for d in ("one", "many"):
        got = lifecycle.queries()["index_by_stream"](spark, str(tmp_path / d)).collect()
        assert {tuple(r) for r in got} == {("a", 30, 20), ("b", 30, 20)}


def test_stream_windows_with_late_rows(spark, tmp_path):
    folder = tmp_path / "ev"
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 03:00:00', 2.0D UNION ALL SELECT timestamp'2024-01-01 09:00:00', 4.0D").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(folder))
    q = events.rotation_windows(stream, late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["events"], r["value"]) for r in spark.table("w").collect()) == [(1, 4.0), (2, 3.0)]


def test_names_languages_and_agent_folders(spark, tmp_path):
    df = spark.createDataFrame([("a/../b?.txt",), ("..",), (None,), ("c\\d.pdf",)], "n string")
    assert [r[0] for r in df.select(files.sanitized_name("n")).collect()] == ["b.txt", "upload.bin", "upload.bin", "d.pdf"]

    def detect(t):
        if "!" in t:
            raise ValueError
        return "en"

    docs = spark.createDataFrame([(1, "hello"), (2, " "), (3, None), (4, "!")], "doc_id bigint, text string")
    assert {tuple(r) for r in files.with_language(docs, detect).collect()} == {(1, "en"), (2, "unknown"), (3, "unknown"), (4, "unknown")}
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text('{"id": "%s", "name": "N"}' % name)
    assert [r["id"] for r in files.agents(spark, str(tmp_path)).collect()] == ["a", "b"]
    (tmp_path / "registry.json").write_text('{"agents": [{"id": "r", "name": "R"}]}')
    assert [r["id"] for r in files.agents(spark, str(tmp_path)).collect()] == ["r"]
    assert {r["kind"] for r in files.knowledge_files(spark, str(tmp_path)).collect()} >= {"a", "b"}
