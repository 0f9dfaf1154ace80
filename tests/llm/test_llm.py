"""The training-data operators: edge cases, round trips, brute force and held-out accuracy on small frames."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, labels, language, mixture, neighbours, pairs, pieces, reading, scans, survivors

TOKENS = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
DATA = "/root/testdata/sf0.001"
tokens = pytest.mark.skipif(not os.path.exists(TOKENS), reason="no public vocabulary here")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

ENGLISH = ["The small pump is behind the green door.", "We clean the filter before the night shift begins.", "Please write the reading into the book and close the valve.", "When the lamp is red, nobody opens the cover.", "The storekeeper has ordered new screws for the tank.", "You can see what is left of the oil in the glass."]
GERMAN = ["Die kleine Pumpe steht hinter der grünen Tür.", "Wir reinigen den Filter vor der Nachtschicht.", "Bitte schreiben Sie den Messwert in das Buch und schließen Sie das Ventil.", "Wenn die Lampe rot ist, öffnet niemand den Deckel.", "Der Lagerist hat neue Schrauben für den Behälter bestellt.", "Man sieht im Glas, was vom Öl noch übrig ist."]
RUSSIAN = ["Маленький насос стоит за зелёной дверью.", "Мы промываем фильтр перед ночной сменой.", "Запишите показание в журнал и закройте клапан.", "Когда лампа красная, никто не открывает крышку.", "Кладовщик заказал новые винты для бака."]


def sample(many):
    return [language.clean_sentence(s) for s in many]


@pytest.fixture(scope="module")
def texts():
    return {"en": sample(ENGLISH), "de": sample(GERMAN), "ru": sample(RUSSIAN)}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, " ".join(ENGLISH), "en"), (2, " ".join(GERMAN), "ger"), (3, " ".join(RUSSIAN), "RU-ru"), (4, None, None), (5, "", "und")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


# --- 7: tokenizer


@tokens
def test_bpe_equals_an_independent_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(TOKENS)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = "abcdeéß漢🙂 \n\t ​0123.,'<|>ЖжІї"
    many = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    many += ["", " ", "<|endoftext|>", "a" * 5000, "é " * 50, "it's we'll", "   x", "\r\n\r\n"]
    with pytest.raises(FileNotFoundError):
        bpe.vocabulary_of(spark, "/no/such.file")
    mine = bpe.ByteBpe(TOKENS, cache_entries=50)  # a table so small that it is emptied often
    for t in many:
        assert mine.encode(t) == other.encode_ordinary(t), repr(t)
        assert mine.decode(mine.encode(t)) == t
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "hi", "x"), (3, "hi", "y")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in bpe.encode_column(rows).collect())
    hi = tuple(other.encode_ordinary("hi"))
    assert got == [(0, hi), (1, ()), (2, ()), (2, ()), (3, hi)]
    assert bpe.encode_column(rows.limit(0)).count() == 0


# --- 3: similar vectors


def brute(rows, k, least):
    seen = {}
    for i, v in rows:
        if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i] = np.array(v, np.float32).astype(np.float64)
    ids = sorted(seen)
    x = np.array([seen[i] / np.linalg.norm(seen[i]) for i in ids]).astype(np.float32).astype(np.float64)
    s = np.round(x @ x.T, 9)
    out = set()
    for a, i in enumerate(ids):
        near = sorted((-min(s[a, b], 1.0), j) for b, j in enumerate(ids) if b != a and s[a, b] >= least)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in np.float32(centre[i % 40] + 0.1 * rng.normal(size=8))]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a group of copies larger than k
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "chunk_rowid bigint, embedding array<float>, k1 string")
    p = neighbours.Index(dim=8, list_rows=40, margin=0.2)
    got = {tuple(r) for r in neighbours.similar_pairs(df, params=p).collect()}
    want = brute(rows, 5, 0.9)
    assert not got - want
    assert len(got & want) >= 0.97 * len(want)
    # Copies are each other's most similar, in order of id, not all pairs of the group.
    assert (1000, 1001) in got and len([1 for a, b in got if a >= 1000 and b >= 1000]) <= 60 * 5
    assert neighbours.similar_pairs(df.limit(0), params=p).count() == 0


def test_dense_region_visits_every_list_within_the_margin():
    rng = np.random.default_rng(8)
    x = neighbours._unit(rng.normal(size=64) + 0.22 * rng.normal(size=(3000, 64)))
    p = neighbours.Index(visitors=500)
    centres = neighbours.Centres(x[:60], p, np.where(np.arange(60) % 7, 1, 3))  # some lists are split
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float32())), pa.array(np.arange(3000)), pa.array(np.zeros(3000, np.int64))], ["id", "v", "k1", "k2"])
    routed = pa.Table.from_batches(neighbours._assign(centres, p)([rows])).sort_by([("list", "ascending"), ("home", "descending")])
    best: dict = {}
    for e in neighbours._search(centres, p)(routed.to_batches(max_chunksize=300)):
        for a, b, s in zip(*(e.column(c).to_pylist() for c in ("k1", "to", "sim")), strict=True):
            best.setdefault(a, {})[b] = s
    near = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(near, 0)
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(-near[i])[:5] if near[i, j] >= 0.9}
    got = {(i, j) for i, row in best.items() for j in sorted((j for j in row if j != i), key=lambda j: (-row[j], j))[:5]}
    assert len(want) > 10_000 and len(want & got) >= 0.98 * len(want)


def test_exact_setting_finds_every_pair(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in np.float32(centre + 0.4 * rng.normal(size=8))]) for i in range(500)]
    df = spark.createDataFrame(rows, "chunk_rowid bigint, embedding array<float>")
    exact = neighbours.Index(dim=8, list_rows=20, block=10, margin=4, epsilon=1e9)
    assert {tuple(r) for r in neighbours.similar_pairs(df, params=exact).collect()} == brute(rows, 5, 0.9)


def test_many_centres_are_searched_by_groups():
    rng = np.random.default_rng(9)
    x = neighbours._unit(rng.normal(size=(4000, 16)))
    flat = neighbours.Centres(x[:900], neighbours.Index(dim=16, flat_lists=1000))
    rows, lists, home = flat.visits(x)
    few, all_ = (neighbours.Centres(x[:900], neighbours.Index(dim=16, flat_lists=100, probes=n)) for n in (10, 10**6))
    r, w, h = all_.visits(x)
    assert (h == home).all() and set(zip(r, w, strict=True)) == set(zip(rows, lists, strict=True))
    assert (few.visits(x)[2] == home).mean() > 0.85


def test_estimates_keep_to_their_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn, centre = neighbours.rotation(64, 1), x[:50].mean(axis=0)
    guess, bound = neighbours.estimate(x[:100], neighbours.Codes.of(x, centre, turn), centre, turn, 2.5)
    assert (np.abs(guess - x[:100] @ x.T) <= bound).mean() > 0.98


# --- 4: pieces


def test_pieces_are_whole_within_the_limit_and_local():
    rng = random.Random(1)
    words = [rng.choice(["pump", "valve", "lamp", "door", "oil"]) + rng.choice(["", "", "", ".", ",", ".\n\n"]) for _ in range(900)]
    text = " ".join(words)
    for limit, overlap in ((50, 10), (7, 3), (1, 0), (10, 8), (20, 99)):
        got = pieces.split_text(text, limit, overlap)
        keep = max(0, min(overlap, limit - 1))
        assert all(n <= limit and n == len(t.split()) for t, n, _ in got)
        again = got[0][0].split()
        for t, _, _ in got[1:]:
            shared = min(keep, len(again))
            assert again[len(again) - shared :] == t.split()[:shared]
            again += t.split()[shared:]
        assert again == text.split()
    ends = [k for _, _, k in pieces.split_text(text, 50, 10)]
    assert sum(k in ("paragraph", "line", "sentence") for k in ends) > 0.8 * len(ends)
    # An edit at the start changes only the pieces near it.
    old = {t for t, _, _ in pieces.split_text(text, 50, 10)}
    new = {t for t, _, _ in pieces.split_text("new start here " + text, 50, 10)}
    assert len(old - new) <= 4


def test_oversized_chunks(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [("a", "n", long, None, 3), ("a", "n", long, None, 3), ("b", "n", "w " * 10, None, 99), ("c", "n", long, None, 0), ("d", "n", "short", "c", 1), ("e", "x", long, None, 1), ("f", "n", None, None, 1), ("g", "n", "x" * 999, "g", 1), (None, "n", long, None, 1), ("h", "n", long.replace(" ", "\xa0"), "h", 1)]
    chunks = spark.createDataFrame([(c, n, t, p, k, None, "zz") for c, n, t, p, k in rows], "chunk_id string, notebook_id string, chunk_text string, parent_chunk_id string, token_count int, section_header string, limit string")
    settings = spark.createDataFrame([("n", 10, 2), ("n", 10, 2), ("x", None, None)], "notebook_id string, chunk_size int, chunk_overlap int")
    out = pieces.split_chunks(chunks, settings)
    assert {r[0] for r in pieces.cut_chunks(out).collect()} == {"a", "h"}  # h names only itself
    assert all(r["token_count"] <= 10 for r in out.collect())
    assert pieces.split_chunks(chunks.limit(0), settings).count() == 0 and pieces.split_chunks(chunks, settings.limit(0)).count() == 0


# --- 6: survivors


def records(spark, rows):
    full = [dict(zip(("doc_id", "file_hash", "text", "title", "authors", "year", "is_indexed", "index_error", "indexed_at", "lang"), r)) for r in rows]
    schema = "doc_id bigint, file_hash string, text string, title string, authors array<string>, year int, is_indexed boolean, index_error string, indexed_at timestamp, lang string, g string"
    return spark.createDataFrame([(*r.values(), "clash") for r in full], schema)


H, K = "ab" * 32, "cd" * 32


def test_groups_and_best_records(spark):
    from datetime import datetime as D

    rows = [
        (1, H, "x", "T", ["A"], 2000, True, " ", D(2024, 1, 1), "en"),
        (2, "SHA256:" + H.upper(), "y", "-", [" "], 9999, True, None, D(2025, 1, 1), "en"),  # later, but less filled
        (3, f" {H}\n", "z", "T", ["A"], 2000, True, "failed", D(2026, 1, 1), "en"),  # failed
        (4, None, "Some Text", None, None, None, True, None, None, None),
        (5, "0" * 64, "some  text ", None, None, None, True, None, None, None),  # equal text; tie: smaller id
        (6, K, "SOMETEXT", "T", None, None, False, None, None, None),  # bridged to 4 and 5 by its text
        (7, None, " ", None, None, None, True, None, None, None),
        (8, "unknown", "", None, None, None, True, None, None, None),
        (9, None, None, None, None, None, True, None, None, None),
        (10, "ef" * 32, "q", None, None, None, True, None, None, None),
        (10, "ef" * 32, "q", None, None, None, True, None, None, None),  # delivered twice: one record
        (None, H, "x", None, None, None, True, None, None, None),
    ]
    df = records(spark, rows)
    got = {(r["group_doc_id"], r["best_doc_id"]) for r in survivors.best_records(df).collect()}
    assert got == {(1, 1), (4, 4)}
    assert survivors.best_records(df.limit(0)).count() == 0
    only = df.select("doc_id", "file_hash")
    assert survivors.best_records(only).count() == 1


def test_bridged_hash_classes_are_one_group(spark):
    hashes = [f"{i:02x}" * 32 for i in range(1, 9)]
    rows = []
    for i, h in enumerate(hashes):
        rows += [(10 * i + 1, h, f"t{i}", *[None] * 3, True, None, None, None), (10 * i + 2, h, f"t{i + 1}", *[None] * 3, True, None, None, None)]
        rows.append((10 * i + 3, None, f"t{i}", *[None] * 3, True, None, None, None))
    got = survivors.best_records(records(spark, rows)).collect()
    assert len(got) == 1 and got[0]["records"] == len(rows)


def test_currency_orders_values_without_timestamps(spark):
    from datetime import datetime as D

    rows = []
    for i in range(4):  # de is replaced by en wherever times are known
        h = f"{i + 1:02x}" * 32
        rows += [(2 * i, h, "t", "T", None, None, True, None, D(2024, 1, 1), "de"), (2 * i + 1, h, "t", None, None, 2001, True, None, D(2024, 2, 1), "en")]
    rows += [(100, H, "u", "n/a", None, None, True, None, None, "en"), (101, H, "u", "Real", ["B"], 0, True, None, None, "de"), (102, H, "u", None, None, 1999, True, None, None, "de")]
    got = {r["group_doc_id"]: r for r in survivors.surviving_records(records(spark, rows)).collect()}
    assert got[100]["lang"] == "en" and got[100]["title"] == "Real" and got[100]["year"] == "1999" and got[100]["authors"] == '["B"]'
    assert got[0]["lang"] == "en" and got[0]["title"] == "T" and got[0]["year"] == "2001"


def test_levels_of_chains_and_cycles(spark):
    rng = random.Random(5)
    steps = [("chain", a, b, 5) for a, b in ("ab", "bc", "bd", "ce")] + [("ring", "a", "b", 5), ("ring", "b", "c", 4), ("ring", "c", "a", 2), ("ring", "c", "d", 3)]
    steps += [("dag", f"v{a:02}", f"v{b:02}", rng.randrange(2, 9)) for a, b in {(a, b) for _ in range(60) for a, b in [sorted(rng.sample(range(25), 2))]}]
    got = {(r["field"], r["value"]): r["level"] for r in survivors.levels(spark.createDataFrame(steps, "field string, value string, later string, n int")).collect()}
    assert [got["chain", v] for v in "abcde"] == [0, 1, 2, 2, 3]
    assert [got["ring", v] for v in "abcd"] == [1, 2, 3, 4]  # c to a, the weakest step, was dropped in a round of its own
    want: dict = {}
    for _ in range(25):
        for f, a, b, _n in steps:
            if f == "dag":
                want[a], want[b] = want.get(a, 0), max(want.get(b, 0), want.get(a, 0) + 1)
    assert {v: k for (f, v), k in got.items() if f == "dag"} == want


def test_latest_values_follow_chains_through_missing_links(spark):
    from datetime import datetime as D

    values = [(g, "f", v, t, t, 1) for g, v, t in (("g1", "a", None), ("g1", "c", None), ("g2", "c", None), ("g2", "b", None), ("g2", "d", None), ("g3", "d", D(2024, 1, 1)), ("g3", "a", D(2025, 1, 1)), ("g4", "x", D(2024, 1, 1)), ("g4", "d", None))]
    rows = spark.createDataFrame(values, "g string, field string, value string, first timestamp, last timestamp, n bigint")
    order = survivors.levels(spark.createDataFrame([("f", "a", "b", 3), ("f", "b", "c", 3), ("f", "c", "d", 3)], "field string, value string, later string, n int"))
    assert {tuple(r) for r in survivors.latest_values(rows, order).collect()} == {("g1", "f", "c"), ("g2", "f", "d"), ("g3", "f", "a"), ("g4", "f", "x")}


# --- 2: languages


def test_profiles_and_declarations(texts):
    model = language.Profiles(texts)
    told = model.decide([language.clean_sentence(s) for s in ("The valve behind the door is red.", "Das Ventil hinter der Tür ist rot.", "Клапан за дверью красный.", "12 = 3")])
    assert [language.LANGUAGES[k] if k >= 0 else None for k, _ in told] == ["en", "de", "ru", None]
    assert language.declared("ENG + DEU") == {"en", "de"} and language.declared("en,pt") == {"en", "pt"}
    assert language.declared("auto") == language.declared(None) == language.declared(" ") == language.declared("osd") == set()


def test_segments_of_mixed_texts(texts):
    model = language.Profiles(texts)
    mixed = "The lamp is red and nobody opens the cover. Wir reinigen den Filter vor der Nachtschicht. The sign says “Die kleine Pumpe steht hinter der Tür” in white."
    found = labels.segments(mixed, labels.decided([mixed], model)[0])
    assert [s[3] for s in found] == ["en", "de", "en"] and all(0 < s[4] <= 1 for s in found)
    for t in ("", " ", "17\n18", "“Wir reinigen den Filter vor der Nachtschicht.”"):
        assert [s[3:] for s in labels.segments(t, labels.decided([t], model)[0])] == [("und", 0.0)]


def test_undeclared_languages(spark, documents):
    rows = [("a", "n", "text", GERMAN[0]), ("a", "n", "text", GERMAN[0]), ("b", "n", "text", ENGLISH[0]), ("c", "n", "table", GERMAN[0]), ("d", "m", "TEXT ", ENGLISH[1] + " " + GERMAN[1]), ("e", "z", "text", RUSSIAN[0]), ("f", "n", "text", None), ("g", None, "text", GERMAN[1])]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, notebook_id string, chunk_type string, chunk_text string, lang int")
    settings = spark.createDataFrame([("n", "eng"), ("n", "eng"), ("m", "auto")], "notebook_id string, ocr_language string")
    got = {tuple(r) for r in labels.undeclared(chunks, settings, documents).collect()}
    assert got == {("a", "de"), ("d", "en"), ("d", "de"), ("e", "ru"), ("g", "de")}
    assert labels.undeclared(chunks.limit(0), settings, documents).count() == 0


@tables
def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    even, odd = (docs.filter(F.col("doc_id") % 2 == k) for k in (0, 1))
    model = labels.fit_profiles(even)
    right = total = 0
    for code, many in language.sample_documents(odd).items():
        said = model.decide(many)
        right += sum(language.LANGUAGES[k] == code for k, _ in said)
        total += len(said)
    assert right / total > 0.88  # about a tenth of the labels themselves are wrong or of mixed documents


# --- 1: pairs


REFUSING = ["I'm sorry, but I can't help with that request.", "I am unable to answer this.", "Leider kann ich hierzu keine Auskunft geben.", "Das möchte ich nicht beantworten.", "Я предпочту не отвечать на это.", "Я не могу помочь с этим вопросом."]


@pytest.fixture(scope="module")
def judge(texts):
    model = language.Bayes(texts)
    refusals = pairs.Refusals([*[*ENGLISH, *GERMAN, *RUSSIAN, "Run this."] * 40, *REFUSING * 3], [*ENGLISH, *GERMAN, *RUSSIAN, "Ask me for help if you cannot open the valve."])
    return lambda q, a: pairs.defect_of(q, a, model, refusals)


@pytest.mark.parametrize(
    "prompt, response, defect",
    [
        ("Where is the pump?", None, "empty"), ("Where is the pump?", "​ …", "empty"), ("Where is the pump?", "[no answer]", "empty"), ("Where is the pump?", "Answer:", "empty"), ("Where is the pump?", "```\n```", "empty"),
        ("How many are left?", "280", None), ("Is it open?", "Yes.", None), ("Is it open?", "No.", None),
        ("Where is the small pump now?", "> where is the small pump now", "copy"), ("Where is the small pump now?", "You asked: Where is the small pump now?", "copy"), ("Where is the small pump now?", "Where is small pump now?", "copy"),
        ("Where is the small pump now?", "Where is the small pump now? It is behind the door.", None),
        ("Where is the pump?", "I'm sorry, but I can't help with that request.", "refusal"), ("Wo ist die Pumpe?", "Leider kann ich hierzu keine Auskunft geben.", "refusal"), ("Где насос?", "Я предпочту не отвечать на это.", "refusal"),
        ("Where is the pump?", "The technician declined the delivery because the pump was wet.", None), ("Where is the pump?", "I can't open the book from here, but the pump is behind the door.", None),
        ("When do we clean the filter and close the valve?", GERMAN[1], "wrong_language"), ("Answer in German, please: when do we clean the filter?", GERMAN[1], None), ("When do we clean the filter and close the valve?", "The sign says “Bitte schließen Sie das Ventil” in white.", None),
        ("Where is the pump?", "Ask me for help if you cannot open the valve.", None), ("Where is the pump?", "Unfortunately I am unable to help with this.", "refusal"), ("Where is the pump?", "The small pump is behind the gre", None),
        ("Where is the pump?", "Run this.\n```\nstart --now\n```", None), ("Where is the pump?", "- It is behind the green door\n- We wait until the shift begins", None),
        (None, "The small pump is behind the green door.", None), ("", "It is red.", None),
    ],
)
def test_defects(judge, prompt, response, defect):
    assert judge(prompt, response) == defect


def told(chat, documents):
    return {tuple(r) for r in pairs.broken_pairs(chat, documents).collect()}


def test_likelihood_and_marks_decide_truncation(spark, documents):
    rng = random.Random(7)
    things, states = ["pump", "valve", "lamp", "door", "filter", "cover", "tank"], ["green", "closed", "red", "dry", "small"]
    say = lambda: f"We check the {rng.choice(things)} of the {rng.choice(things)} because it is {rng.choice(states)}"
    rows = [say() + "." for _ in range(300)] + [f"- {say()}\n- {say()}" for _ in range(60)] + [str(rng.randrange(900)) for _ in range(40)] + [say() + ".\n```\nstart\n```" for _ in range(20)]
    broken = {"cut": "We check the door of the", "piece": "We check the door of the pu", "comma": "We check the valve of the tank because,", "dots": "We check the lamp of the...", "item": f"- {say()}\n- We check the", "fence": say() + ".\n```\nstart"}
    whole = {"number": "77", "last": "- " + say(), "stop": "It is dry. " + say() + ".", "tail": say() + "! "}
    named = [*((f"r{i}", t) for i, t in enumerate(rows)), *broken.items(), *whole.items()]
    both = [x for i, (key, t) in enumerate(named) for x in ((f"q{i}", "n", "user", None, 2 * i), (key, "n", "assistant", t, 2 * i + 1))]
    chat = spark.createDataFrame(both, "id string, notebook_id string, role string, content string, seq bigint")
    assert told(chat, documents) == {(k, "truncated") for k in broken}


def test_what_marks_say_is_learned():
    ends, cuts = {28: 90.0, 20: 10.0}, {4: 80.0, 10: 20.0}
    seen = {("stop", 28): 900.0, ("bare", 28): 400.0, ("bare", 4): 10.0}
    p = pairs.fit_marks(seen, ends, cuts)
    assert p["stop", 28] < 0.01 and p["bare", 28] < 0.01 and p["bare", 4] > 0.5  # here most answers have no stop
    p = pairs.fit_marks({("stop", 28): 900.0, ("bare", 28): 1.0, ("bare", 4): 60.0}, ends, cuts)
    assert p["bare", 4] > 0.99


def test_pairs_follow_seq_not_clocks(spark, documents):
    rows = [("u1", "n", " User", "Where is it?", 1), ("a1", "n", "ASSISTANT", "", 2), ("a1", "n", "ASSISTANT", "", 2), ("a2", "n", "assistant", None, 3), ("u2", "n", "user", "Where?", 4), ("u3", "m", "user", "x", 5), ("a3", "n", "assistant", None, 6), (None, "n", "assistant", "", 7), ("u4", None, "user", "x", 8), ("a4", None, "assistant", "", 9)]
    chat = spark.createDataFrame([(*r, "c") for r in rows], "id string, notebook_id string, role string, content string, seq bigint, prompt string")
    got = {tuple(r) for r in pairs.broken_pairs(chat, documents).collect()}
    assert got == {("a1", "empty"), ("a3", "empty")}
    assert pairs.broken_pairs(chat.limit(0), documents).count() == 0


def test_refusals_are_learned_from_every_answer_and_document(spark, documents):
    quoted = "Ask me for help if you cannot open the valve."
    held = documents.unionByName(spark.createDataFrame([(6, quoted, None)], documents.schema))
    # More answers than a sample of 20,000; the only refusal has the id that a sample by hash would take last.
    ids = spark.range(50).select(F.concat(F.lit("r"), "id").alias("id"))
    last = ids.orderBy(F.pmod(F.xxhash64("id"), F.lit(1_000_000)).desc()).first()["id"]
    said = spark.createDataFrame([(last, REFUSING[0]), *((f"q{i}", quoted) for i in range(5))], "id string, content string")
    said = spark.range(24_000).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("It is dry.").alias("content")).unionByName(said)
    both = F.array(F.struct(F.concat(F.lit("u-"), "id").alias("id"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("seq")), F.struct("id", F.lit("assistant").alias("role"), "content", F.lit(1).alias("seq")))
    chat = said.select(F.col("id").alias("notebook_id"), F.explode(both).alias("m")).select("notebook_id", "m.*")
    assert {x for x in told(chat, held) if x[1] == "refusal"} == {(last, "refusal")}


def test_refusals_in_tables_are_those_in_memory(spark):
    answers = [*[*ENGLISH, *GERMAN, *RUSSIAN, "Run this.", "The technician could not answer the question. I see.", "", None] * 60, *REFUSING * 3, "Unfortunately I am unable to help with this."]
    texts = [*ENGLISH, *GERMAN, *RUSSIAN, "Ask me for help if you cannot open the valve.", None]
    chat = spark.createDataFrame([("assistant", t) for t in answers], "role string, content string")
    documents = spark.createDataFrame([(t,) for t in texts], "text string")
    model = pairs.Refusals([t for t in answers if t], [t for t in texts if t])
    each = {model._normal(t[a:b]) for t in answers if t for a, b, _ in language.sentences(t)}
    keys = {r["h"]: r["s"] for r in spark.createDataFrame([(s,) for s in each], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    got = {keys[r["h"]] for r in pairs.refused(chat, documents).collect()}
    assert got == {s for s in each if model.odds(s) > 0} and len(got) == 7
    assert pairs.refused(chat.limit(0), documents).count() == 0
    assert {keys[r["h"]] for r in pairs.refused(chat.filter("content = \"" + REFUSING[1] + "\""), documents.limit(0)).collect()} == {model._normal(REFUSING[1])}


# --- 5: scans


@pytest.fixture(scope="module")
def glyphs():
    words = " ".join(ENGLISH).lower().replace(".", "").replace(",", "").split() + ["although", "self-cleaning", "self", "cleaning", "measured", "reading", "number", "then"]
    return scans.Glyphs(scans.Lexicon.of({w: 100 * words.count(w) for w in words}))


def fixed(text, glyphs, page=None, recurring=(), title=""):
    lines = scans.lines_of(text, page, {scans.digest(scans.folded(r)) for r in recurring}, scans.folded(title))
    return scans.repair(text, page, {scans.digest(scans.folded(r)) for r in recurring}, scans.folded(title), glyphs, scans.LineModel([lines]))


def test_split_words_and_compounds(glyphs):
    assert fixed("it is mea-\nsured now", glyphs) == ({"split_word"}, "it is measured now")
    assert fixed("it is mea ¬\nsured now", glyphs) == ({"split_word"}, "it is measured now")
    assert fixed("alt\nhough the door", glyphs) == ({"split_word"}, "although the door")
    assert fixed("the self-\ncleaning pump", glyphs) == (set(), "the self-cleaning pump")
    assert fixed("the door and\nthe pump", glyphs) == (set(), "the door and the pump")


def test_misread_words_and_codes(glyphs):
    assert fixed("the sma11 purnp is rnea5ured, tlien cleari", glyphs)[0] == {"glyph"}
    assert fixed("the nurnber is rnea5ured", glyphs)[1] == "the number is measured"
    assert fixed("the fi1ter оf the pump", glyphs)[1] == "the filter of the pump"
    for clean in ("the k2bus618.cfg names x2log512", "an M12x124 screw of K19-B", "Stop! The pump is red.", "Telfenne=40373; Thoostze=31626", ""):
        assert fixed(clean, glyphs) == (set(), clean)


def test_misreadings_are_judged_by_ratio_at_every_size():
    for size in (1, 10, 1000):
        counts = {w: n * size for w, n in (("then", 400), ("thcn", 20), ("clear", 100), ("dear", 20), ("number", 2000), ("nurnber", 1), ("whole", 40), ("wh", 1), ("ole", 1))}
        sized = scans.Glyphs(scans.Lexicon.of(counts, scans.WORDS * size))
        assert scans.misread("thcn", sized) == ("thcn", "then") and scans.misread("nurnber", sized) == ("nurnber", "number")
        assert scans.misread("then", sized) is None and scans.misread("dear", sized) is None
        assert scans.joined_break("wh", "ole", sized) == "whole"


def test_long_running_lines_are_headers(glyphs):
    head = "Pump house notes of the northern works and of the main office, first edition with all the additions of the last years"
    assert fixed(f"{head}\nThe small pump is behind the green door.\nWe clean the filter before the night shift begins.", glyphs, 3, [head])[0] == {"header"}


def test_headers_and_page_numbers(glyphs):
    body = "The small pump is behind the green door.\n{}\nWe clean the filter before the night shift begins."
    assert fixed(body.format("- 12 -"), glyphs, 12)[0] == {"pageno"}
    assert fixed(body.format("page l2 (40)"), glyphs, 12)[0] == {"pageno"}
    assert fixed(body.format("Table 12"), glyphs, 12)[0] == fixed(body.format("№ 12"), glyphs, 12)[0] == set()
    assert fixed("Storage:\n281\n12\n320", glyphs, 12)[0] == set()
    assert fixed(body.format("PUMP NOTES | 12"), glyphs, 12, ["Pump notes"])[0] == {"header"}
    assert fixed(body.format("Storage 3"), glyphs, 12)[0] == set()


def test_every_line_is_decided_by_the_model(glyphs, monkeypatch):
    body = "Pump notes\nThe small pump is behind the green door.\nWe clean the filter before the night shift begins.\n{}"
    recurring = {scans.digest(scans.folded("Pump notes"))}
    pages = [(body.format(f"- {n} -" if n % 2 else n), n) for n in range(1, 60)]
    known = [scans.lines_of(t, n, recurring, "") for t, n in pages]
    model = scans.LineModel(known, [scans.lines_of(t, None, recurring, "") for t, _ in pages])
    assert scans.repair(body.format("17"), None, recurring, "", glyphs, model)[0] == {"header", "pageno"}
    assert scans.repair(body.format("viii"), 8, recurring, "", glyphs, model)[0] == {"header", "pageno"}
    assert scans.repair(body.format("ix"), 8, recurring, "", glyphs, model)[0] == {"header"}

    def never(lines):
        raise AssertionError("decoding asks the model alone")

    monkeypatch.setattr(scans, "seeds", never)
    assert scans.repair(body.format("- 8 -"), 8, recurring, "", glyphs, model)[0] == {"header", "pageno"}
    assert "small pump" in scans.repair(body.format("- 9 -"), 9, recurring, "", glyphs, model)[1]
    # Trained on first guesses that take page numbers for text, the same model labels them so.
    monkeypatch.setattr(scans, "seeds", lambda lines: [5 if not x.text else 2 if x.recurs else 0 for x in lines])
    other = scans.LineModel(known)
    assert scans.repair(body.format("- 8 -"), 8, recurring, "", glyphs, other)[0] == {"header"}


def test_scanned_chunks(spark, documents):
    page = "Pump house notes\nThe small pump is mea-\nsured. It was measured here and measured there.\n- {} -"
    rows = [(f"c{i}", 1, "n", "text", None, None, i, page.format(i)) for i in (3, 4)] + [("c3", 1, "n", "text", None, None, 3, page.format(3)), ("x", 1, "m", "text", None, None, 3, page.format(3)), ("y", 2, "n", "table", None, None, 3, page.format(3)), ("z", 2, "n", "text", None, None, None, None), ("w", None, "n", "text", None, None, None, "")]
    rows += [(f"f{i}", 9, "m", "text", None, None, 1, "so it is measured again") for i in range(6)]
    chunks = spark.createDataFrame([(*r, 0) for r in rows], "chunk_id string, doc_id bigint, notebook_id string, chunk_type string, section_header string, parent_header string, page_number int, chunk_text string, noise int")
    settings = spark.createDataFrame([("n", True), ("n", True), ("m", False)], "notebook_id string, ocr_enabled boolean")
    docs = documents.withColumn("title", F.lit(None).cast("string"))
    got = {tuple(r) for r in scans.noise_kinds(chunks, settings, docs).collect()}
    assert got == {(c, k) for c in ("c3", "c4") for k in ("header", "pageno", "split_word")}
    assert scans.noise_kinds(chunks.limit(0), settings, docs).count() == 0


def test_running_lines_of_one_issuer_in_many_documents(spark):
    page = "North Works - Main Office\nThe small pump is behind the door {}.\n{}\nIt is red."
    rows = [(f"{d}-{n}", d, page.format(n, "Table 4" if n < 2 else "It is dry.")) for d in range(30) for n in range(8)]
    chunks = spark.createDataFrame([(c, d, t, None, None) for c, d, t in [*rows, *rows[:40]]], "chunk_id string, doc_id bigint, chunk_text string, section_header string, parent_header string")
    got = {r["chunk_id"]: r["lines"] for r in scans.recurring_lines(chunks).collect()}
    assert got == {c: [scans.digest(scans.folded("North Works - Main Office"))] for c, _, _ in rows}


# --- 8: mixtures


def test_raking_reaches_all_marginals_within_the_caps():
    rng = np.random.default_rng(3)
    source, language = np.repeat(np.array(["a", "b", "c"]), 4), np.tile(np.array(["en", "de", "fr", "und"]), 3)
    have, most = rng.uniform(50, 100, 12), np.repeat([2.0, 3, 1], 4)
    weights = {"a": 0.5, "b": 0.2, "c": 0.1, "none": 0.2}
    w = mixture.rake(have, most, source, weights, [(language, {"en": 0.3, "de": 0.3, "fr": 0.2, "und": 0.2})])
    share = w / w.sum()
    assert [share[source == k].sum() for k in "abc"] == pytest.approx([0.625, 0.25, 0.125], abs=1e-6)
    assert [share[language == k].sum() for k in ("en", "de", "fr", "und")] == pytest.approx([0.3, 0.3, 0.2, 0.2], abs=0.01)
    assert (w <= most * have + 1e-6).all()
    # A marginal beyond the caps is met as far as they allow; the sources' shares stay exact.
    w = mixture.rake(have, most, source, weights, [(language, {"en": 1.0})])
    assert [w[source == k].sum() / w.sum() for k in "abc"] == pytest.approx([0.625, 0.25, 0.125], abs=1e-6) and (w <= most * have + 1e-6).all()
    assert mixture.rake(np.zeros(1), np.ones(1), np.array(["a"]), {"a": 1.0}, [])[0] == 0


@tokens
def test_mixture_shares_caps_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), "word " * rng.randrange(1, 40), "en") for i in range(2000)]
    rows += [(9000, "c", None, "en"), (9001, "c", "", "en"), (9002, None, "word", "en"), (None, "a", "word", "en"), (rows[0]), (9003, "z", "word " * 50, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, source string, text string, lang string, tokens string")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 3), ("b", 0.4, 3), ("c", 0.1, 1), ("d", 0.1, 1), ("e", -1.0, 1), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    selection, report, told = mixture.mixture(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["c"]["actual_share"] == got["d"]["actual_share"] == 0
    assert got["a"]["actual_share"] == pytest.approx(0.5, abs=0.003) and got["b"]["target_share"] == pytest.approx(0.5)
    assert {r["marginal"] for r in told.collect()} == {"language", "topic"}
    chosen = selection.collect()
    assert all(1 <= r["copies"] <= {"a": 2, "b": 3}[r["source"]] for r in chosen) and len({r["doc_id"] for r in chosen}) == len(chosen)
    assert mixture.mixture(docs.limit(0), targets)[0].count() == 0 and mixture.mixture(docs, targets.limit(0))[1].count() == 0


# --- 9: reading levels


def test_distributions_and_their_fit():
    rng = np.random.default_rng(1)
    nats, words, owner = rng.normal(size=(40, 3)) * 4, rng.integers(3, 9, 40).astype(float), np.sort(rng.integers(0, 5, 40))
    got = reading.distributions(nats, words, owner, 5)
    for d in range(5):
        w = np.sqrt(words[owner == d])
        for k in (0, 1):
            v = 1 / (1 + np.exp(nats[owner == d, k + 1] - nats[owner == d, k]))
            order = np.argsort(v)
            place = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
            want = [(w * v).sum() / w.sum(), *np.interp(reading.QUANTILES, place, v[order])]
            assert got[d, k * 6 : k * 6 + 6] == pytest.approx(want)
    x = rng.normal(size=(200, 3))
    w, b = reading.nonnegative_fit(x, x @ np.array([2.0, 0, -1]) + 3, ridge=1e-9)
    assert w[0] == pytest.approx(2, abs=0.2) and (w >= 0).all() and w[2] == 0 and b == pytest.approx(3, abs=0.3)


def test_isotonic_fit_is_monotone_and_pools():
    x, y = reading.isotonic(np.array([3.0, 1, 2, 4]), np.array([1.0, 0, 2, 3]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == pytest.approx(1.5) and np.interp(-9, x, y) == 0


@tables
def test_reading_levels(spark):
    samples = spark.read.parquet(DATA + "/reading_samples.parquet")
    rows = samples.select("text", "reading_level").collect()
    reader = reading.Reader([(r[0], r[1]) for r in rows])
    assert reader.accuracy >= 0.9  # of held-out samples
    docs = spark.createDataFrame([(1, rows[0][0], "en"), (2, None, None), (3, "", None), (4, GERMAN[0], "de"), (5, rows[0][0] + " " + " ".join(GERMAN), "en"), (6, "Keep it dry.", "en"), (7, "a=1; b=2; c=3", "en"), (8, " ".join(ENGLISH * 3), "en"), (9, " ".join(GERMAN * 3), "de")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in reading.reading_levels(docs, samples).collect()}
    assert len(got) == 9 and got[2]["reading_level"] is None and got[5]["other_language"] and got[7]["reading_level"] is None
    # A mixed document has the level and the words of its English part; a foreign one has none.
    assert got[5]["reading_level"] == rows[0][1] and got[5]["words"] == got[1]["words"] > 30 and got[9]["words"] == 0
    kept = {r["doc_id"]: r["reading_level"] for r in reading.graded(reading.reading_levels(docs, samples)).collect()}
    assert kept[1] == rows[0][1] and 5 not in kept and 6 not in kept and 9 not in kept
    assert reading.reading_levels(docs.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        reading.Reader([("no level", "unknown")])
