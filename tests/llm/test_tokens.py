"""Tokens, packing, search, models and transcripts against libraries, brute force and held-out rows."""

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import chat, langid, mtree, packing, queries, tokens, toxicity, words
from sightline.llm.common import table, vocabulary
from sightline.llm.pieces import CountTransducer, PieceFst
from sightline.llm.wordbpe import WordBpe

MODEL, WORDS = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
HARD = ["", " ", "  x", "\n", "a\n\nb  \n c ", " " * 77 + "a" + " " * 33, "x▁y ▁▁z", "<s> </s> <0x0A> <unk>", "日本語 中文 😀\x00\t\r é", "ab" * 3000, "don't e.g. 12345", "Überzu der Übersch ÜÜ Ösch Überall"]
ROWS = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, ""), (4, "word " * 20_000)]


@functools.cache
def word_library():
    return Tokenizer.from_file(WORDS)


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, length string, bucket string, rank string")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n▁abcthe中éÜr.0😀", max_size=60), st.integers(1, 9))
def test_machines_match_the_library(text, chunk):
    ids = LIBRARY.encode(text)
    assert np.frombuffer(PieceFst.at(MODEL).encode(text), "<u4").tolist() == ids
    assert CountTransducer.at(MODEL).count(text, chunk) == CountTransducer.at(MODEL).count(text) == len(ids)
    assert PieceFst.at(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_machines_on_hard_texts_and_random_ids():
    fst, counter, rng = PieceFst.at(MODEL), CountTransducer.at(MODEL), random.Random(2)
    for text in HARD:
        assert np.frombuffer(fst.encode(text), "<u4").tolist() == LIBRARY.encode(text)
        assert counter.count(text) == len(LIBRARY.encode(text))
    for _ in range(200):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(8)]
        assert fst.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n▁abthe中é😀", max_size=30), max_size=8))
def test_batches_match_the_library(texts):
    column, ids = pa.array(texts, pa.string()), [LIBRARY.encode(t) for t in texts]
    assert CountTransducer.at(MODEL).count_all(column).tolist() == [len(x) for x in ids]
    got, sizes, intact = PieceFst.at(MODEL).encode_all(column)
    assert got.tolist() == sum(ids, []) and sizes.tolist() == [len(x) for x in ids]
    assert intact.tolist() == [LIBRARY.decode(x) == t for x, t in zip(ids, texts)]


def test_composition_is_associative():
    counter, rng = CountTransducer.at(MODEL), random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("▁theabcé") for _ in range(24))
        maps = [counter.chunk_map(text[:i], text[i : i + 8]) for i in (0, 8, 16)]
        a, b, c = maps
        assert counter.composed(counter.composed(a, b), c) == counter.composed(a, counter.composed(b, c))
        assert counter.composed(counter.composed(a, b), c)[1][0] == counter.run(text)


def test_long_fragments_by_chunk_maps():
    counter, rng = CountTransducer.at(MODEL), random.Random(6)
    for size in (200, 5000):
        text = "".join(rng.choice(["the", "ing", "er", "x", "q", "é", "中"]) for _ in range(size))
        assert counter.count(text, 7) == counter.count(text, 64) == counter.count(text) == len(LIBRARY.encode(text))


def unigram_model(path):
    """The installed model's pieces as a unigram model, so that weights decide."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    proto = model_pb2.ModelProto()
    proto.ParseFromString(LIBRARY.serialized_model_proto())
    proto.trainer_spec.model_type = model_pb2.TrainerSpec.UNIGRAM
    rng = random.Random(8)
    for p in proto.pieces:
        if p.type == model_pb2.ModelProto.SentencePiece.NORMAL:
            p.score = -rng.uniform(4, 14)
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_shortest_path_of_a_unigram_model(tmp_path):
    path = unigram_model(tmp_path / "unigram.model")
    library, fst, rng = sentencepiece.SentencePieceProcessor(model_file=path), PieceFst(path), random.Random(3)
    for text in ["the quick brown fox", "a  b\n\nc ", "", "中文 é 😀", *(" ".join("".join(rng.choice("thequickérown") for _ in range(9)) for _ in range(12)) for _ in range(60))]:
        ids, expected = np.frombuffer(fst.encode(text), "<u4").tolist(), library.encode(text)
        weight = lambda x: sum(map(library.get_score, x))
        assert ids == expected or abs(weight(ids) - weight(expected)) < 1e-3 and library.decode(ids) == library.decode(expected)  # equal but for ties
        assert fst.encode_all(pa.array([text]))[0].tolist() == ids


def test_memories_can_start_anew(monkeypatch):
    monkeypatch.setattr("sightline.llm.pieces.MEMORY", 50)
    monkeypatch.setattr("sightline.llm.pieces.AT_ONCE", 30)
    monkeypatch.setattr("sightline.llm.words.MEMORY", 50)
    counter = CountTransducer(MODEL)
    text = " ".join(f"w{i}ord{i * 7}" for i in range(400))
    assert counter.count(text) == len(LIBRARY.encode(text)) == len(PieceFst(MODEL).encode(text)) // 4


def test_token_queries(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    ids = {k: LIBRARY.encode(t) for k, t in texts.items()}
    for r in queries.QUERIES["op8_token_counts"](spark, sf_dir).collect():
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), len(ids[r["doc_id"]]), len(ids[r["doc_id"]]) > 4096)
    for r in queries.QUERIES["op7_sentencepiece"](spark, sf_dir).collect():
        assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids[r["doc_id"]]), zlib.crc32(np.array(ids[r["doc_id"]], "<u4").tobytes()), True)


def test_token_edges(spark):
    rows = tokens.token_counts(docs(spark), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows)[:5] == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)] and rows[-1]["over_limit"]
    both = tokens.decoded(tokens.encoded(docs(spark), MODEL), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in both) == sorted((i or 0, t or "") for i, t in ROWS)
    assert tokens.token_counts(docs(spark, []), MODEL).count() == tokens.encode_digests(docs(spark, []), MODEL).count() == 0


def test_word_bpe_matches_the_library():
    library, bpe = word_library(), WordBpe.at(WORDS)
    for text in [*HARD, "I'LL don't <|startoftext|> x<|endoftext|>y İstanbul ΣΑΣ ﬁ é a\x1cb ½² ß ſ ŉ", "ÀÉ çÑ!! $$$ 3.14"]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \nabI'lL.,!é ªßſŉ1½$中ΣÉ\u0301\xa0<|", max_size=40))
def test_word_bpe_on_any_text(text):
    assert np.frombuffer(WordBpe.at(WORDS).encode(text), "<u4").tolist() == word_library().encode(text, add_special_tokens=False).ids


def check_packing(spark, frame, rows):
    library, expected = word_library(), []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(doc_id or -1, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = frame.collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by), -(-sum(e[3] for e in expected) // 2048)


def test_packing(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    used, least = check_packing(spark, queries.QUERIES["op3_packing"](spark, sf_dir), rows)
    assert used <= 1.03 * least + 1
    check_packing(spark, packing.pack(docs(spark), WORDS), [(i, t) for i, t in ROWS])
    assert packing.pack(docs(spark, []), WORDS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=30), st.integers(1, 9))
def test_plan_places_everything_once(histogram, groups):
    seen = {}
    for count, items in packing.plan(histogram, 100, groups):
        assert count > 0 and sum(n * k for n, k in items) <= 100
        for n, k in items:
            seen[n] = seen.get(n, 0) + count * k
    assert seen == histogram


def test_configurations_cover_no_more_than_demand():
    sizes, demand = np.array([60, 45, 30, 20]), np.array([10, 20, 31, 7])
    found = packing.configurations(sizes, demand, 100)
    used = sum(p * t for p, t in found)
    assert (used <= demand).all() and all((p * sizes).sum() <= 100 for p, _ in found)
    assert sum(t for _, t in found) >= (used * sizes).sum() / 100


@pytest.mark.parametrize("scale", [1, 30, 10_000, 1e7])
def test_search_of_clusters_by_brute_force(spark, monkeypatch, scale):
    for name, value in {"ROWS_PER_ROUTING": 16, "NODE_ROWS": 8, "GROUP_BYTES": 512, "BLOCK_BYTES": 256, "HOME_QUERIES": 4}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(int(scale))
    v = np.floor((rng.normal(0, 1, (8, 5))[rng.integers(0, 8, 400)] * 20 + rng.normal(0, 1, (400, 5))) * scale).astype(int)
    ids = list(range(398)) + [3, 3]  # an id that repeats is a candidate for each of its rows
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in zip(ids, v.tolist())], "vec_id long, embedding array<double>")
    got = mtree.top_k(df, F.col("vec_id") % 7 == 0, k=6, scale=1).collect()
    expected = []
    for q in range(0, 398, 7):
        best = sorted((-sum(map(int.__mul__, v[q].tolist(), x)), i) for i, x in zip(ids, v.tolist()) if i != q)[:6]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == expected


def test_search_edges(spark):
    hot = [(i, [0.5, 0.25]) for i in range(3000)]
    rows = [*hot, (5000, None), (5020, [1.0, None]), (5040, [float("nan"), 1.0]), (5060, [float("inf"), 1.0]), (5080, []), (5100, [-1.0]), (None, [1.0, 1.0]), (5120, [1e12, 3.0]), (20, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, node int")
    got = mtree.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()
    best = {}
    for r in got:
        best.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queried = dict((i, v) for i, v in usable if i % 20 == 0)
    assert set(best) == set(queried)
    for i in [0, 20, 40, 5080, 5100, 5120]:
        scores = sorted((-min(2**62, sum(a * b for a, b in zip(queried[i], v))), j) for j, v in usable if j != i)[:3]
        assert sorted(best[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert mtree.top_k(df.limit(0), F.lit(True)).count() == 0
    empty = df.filter("vec_id = 5080").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("vec_id"), "embedding")
    assert sorted(tuple(r) for r in mtree.top_k(empty, F.lit(True)).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert mtree.top_k(df.limit(50), F.lit(False)).count() == 0
    assert mtree.top_k(df.filter("vec_id in (40, 60)"), F.lit(True), k=3).count() == 2


def test_toxicity_on_held_out_rows(spark, sf_dir):
    labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    rows = queries.QUERIES["op1_toxicity"](spark, sf_dir.replace("sf0.001", "sf0.01")).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean([[(x > y) + 0.5 * (x == y) for y in clean] for x in toxic]) > 0.7
    assert sum(y >= 0.5 for y in clean) <= 0.05 * len(clean)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_folding_and_exceptions():
    assert toxicity.fold("ІDI0T, ÉTÉ!").split() == ["idiot", "ete"]
    model = toxicity.Model({" idio": 3.0, " idiot": 5.0}, [" idiomatic "], (0.0, 2.0, 0.0, -4.0))
    assert model.evidence("an 1d1ot")[2] == 5.0 and model.evidence("idiomatic") == (0.0, 0.0, 0.0)
    assert model.score("idiot") > model.score("idiot " + "fine " * 500) > model.score("") and model.score("x " * 50_000) == model.score("")


def test_folding_of_quotes_marks_and_widthless_characters():
    assert toxicity.fold("“idi\u200bot” — e\u0301t\u00ade…").split() == ["idiot", "ete"] and toxicity.fold("हिन्दी 中文").split() == ["हिन्दी", "中文"]


def test_exception_phrases_of_two_words():
    toxic, clean = [{"you", "idiot", "go"}] * 40, [{"village", "idiot", "play"}] * 20 + [{"nice", "play"}] * 60
    couples = [{"you idiot", "idiot go"}] * 40 + [{"village idiot", "idiot play"}] * 20 + [{"nice play"}] * 60
    patterns, exceptions = toxicity.lexicon(toxic + clean, [1] * 40 + [0] * 80, couples)
    assert " idiot " in patterns and " village idiot " in exceptions and " idiot " not in exceptions
    model = toxicity.Model(patterns, exceptions, (0.0, 2.0, 0.0, -4.0))
    assert " idio" in " ".join(patterns) and model.evidence("the village idiot") == (0.0, 0.0, 0.0) and model.evidence("what an idiot")[0] > 0


def slow_evidence(model, text):
    """Every pattern looked for at every place."""
    folded = toxicity.fold(text)
    spared = {i + k for p in model.exceptions for i in range(len(folded)) if folded.startswith(p, i) for k in range(len(p) - 1)}
    best = [max((len(p), w) for p, w in model.patterns.items() if folded.startswith(p, i))[1] for i in range(len(folded)) if i not in spared and any(folded.startswith(p, i) for p in model.patterns)]
    return sum(best), max(best, default=0.0)


def test_matching_against_brute_force(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    rng = random.Random(3)
    words = [p.strip() for p in model.patterns] + [p.strip() for p in model.exceptions] + ["plain", "words", "“quoted”"]
    texts = [r["text"] or "" for r in documents.select("text").limit(20).collect()] + [" ".join(rng.choices(words, k=12)) for _ in range(50)]
    for t in texts:
        total, most = slow_evidence(model, t)
        got = model.evidence(t)
        assert abs(got[0] - np.log1p(total)) < 1e-9 and got[2] == most


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 1")):
        rows = toxicity.scored(docs(spark), toxicity.fit(docs(spark), known)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.Model({" word": 9.0}, [], (5.0, 5.0, 0.0, -9.0))
    kept = toxicity.without_toxic(docs(spark), model)
    assert kept.columns == docs(spark).columns and kept.filter("doc_id = 4").count() == 0 and kept.count() == 5
    assert toxicity.scored(docs(spark, []), model).count() == 0


def test_language_on_held_out_rows(spark, sf_dir):
    rows = queries.QUERIES["op5_language_id"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    df = spark.createDataFrame([(0, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (None, "der", None), (5, None, "en"), (6, "12 ?!", "de"), (7, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    rows = {r["doc_id"]: r for r in langid.predicted(df, model).collect()}
    assert [rows[i]["lang_pred"] for i in (5, 6, 7)] == ["und"] * 3 and rows[0]["lang_pred"] in model.languages
    empty = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predicted(df, empty).collect()} == {"und"}
    clash = df.selectExpr("doc_id", "repeat(text, 40000) as text", "lang", "lang as held_out", "1 as score", "text as lang_pred", "text as id")
    again = langid.predicted(clash.union(clash), langid.fit(clash)).collect()  # very long texts, repeated rows, clashing names
    assert len(again) == 12 and {r["lang_pred"] for r in again if r["doc_id"] in (0, 2)} <= {"en", "de"}
    assert langid.predicted(df.limit(0), model).count() == 0


def test_ngrams_do_not_depend_on_slices(monkeypatch):
    text = "Élan vital, über 12 grün\n" * 50
    places = lambda texts: sorted((int(r), int(g)) for rows, buckets in langid.grams(texts) for r, g in zip(rows, buckets))
    whole = places([text, "", "a", text[:30]])
    monkeypatch.setattr(langid, "SLICE", 37)
    assert places([text, "", "a", text[:30]]) == whole == sorted((i, g) for i, t in enumerate([text, "", "a", text[:30]]) for _, g in places([t]))
    assert places([""]) == [] == places([])


def slow_grams(text):
    """Buckets of the n-grams of one text, hashed one by one."""
    points, out, word = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32], [], 2**32 - 1
    for i in range(len(points)):
        key = points[i] * 0x9E3779B1 & word
        for n in range(2, 5):
            if i + n <= len(points):
                key = ((key ^ key >> 15) * 0x85EBCA6B + points[i + n - 1] * 0xC2B2AE35) & word
                if any(p != 32 for p in points[i : i + n]):
                    out.append(((key ^ key >> 13) * 0x27D4EB2F & word) >> 16)
    return out


def test_language_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = docs.select("doc_id", "text", "lang").collect()
    counts, sizes = {}, {}
    for r in rows:
        if not held(r["doc_id"]) and r["lang"] is not None:
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + 1
            own = counts.setdefault(r["lang"], np.zeros(langid.BUCKETS))
            for g in slow_grams(r["text"] or ""):
                own[g] += 1
    names = sorted(sizes)
    logs = [np.log((counts[k] + 0.5) / (counts[k].sum() + 0.5 * langid.BUCKETS)) for k in names]
    got = {r["doc_id"]: r for r in langid.predicted(docs, langid.fit(docs, sample_per_language=10**9)).collect()}
    assert len(got) == len(rows)
    for r in rows[::3]:
        z = np.array([np.log(sizes[k] / sum(sizes.values())) + m[slow_grams(r["text"])].sum() for k, m in zip(names, logs)])
        assert got[r["doc_id"]]["lang_pred"] == names[int(z.argmax())] and abs(got[r["doc_id"]]["score"] - 1 / np.exp(z - z.max()).sum()) < 1e-3


def test_roles_of_conversations(spark, sf_dir):
    known = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "conversations")
    both = chat.parsed(chat.transcript(known)).withColumnRenamed("role", "found").join(known.select("conv_id", "turn", "role"), ["conv_id", "turn"]).collect()
    assert len(both) == known.count() and np.mean([r["found"] == r["role"] for r in both]) > 0.95
    assert all(r["rendered"].startswith(f"<|{r['found']}|>\n") for r in both if r["n_begun"])


def best_by_force(lines, begins):
    import itertools

    e = [chat.emission(x, b) for x, b in zip(lines, begins)]
    score = lambda p: chat.START[p[0]] + e[0][p[0]] + sum(chat.STEP[p[k - 1], p[k]] + e[k][p[k]] for k in range(1, len(p)))
    return max(score(p) for p in itertools.product(range(6), repeat=len(lines))), score


def test_viterbi_is_the_best_of_all_paths():
    lines = ["System: be kind", "User: hi?", "and more", "Assistant: yes", "no marker"]
    begins = [True, True, False, True, True]
    best, score = best_by_force(lines, begins)
    assert abs(score(tuple(chat.viterbi(lines, begins))) - best) < 1e-9
    assert len(chat.viterbi([], [])) == 0


def test_blocks_agree_with_the_whole(spark):
    rng = random.Random(5)
    marks = ["User: ", "Assistant: ", "", "Human: ", "### System\n"]
    turns = [(c, t, rng.choice(marks) + rng.choice(["hello?", "you are kind", "x\ny", "word " * 60])) for c in range(6) for t in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in turns], "conv_id long, turn long, text string, block string")
    key = lambda r: (r["conv_id"], r["turn"])
    whole = sorted(chat.parsed(df, 1000).collect(), key=key)
    assert whole == sorted(chat.parsed(df, 3).collect(), key=key) and len(whole) == 240


def test_transcript_edges(spark):
    rows = [(1, 0, "User: hi"), (1, 0, "User: hi"), (1, 1, None), (1, None, "x"), (None, 0, "Assistant: y"), (2, 5, ""), (3, 0, "User: " + "long " * 30_000)]
    df = spark.createDataFrame([(*r, "user") for r in rows], "conv_id long, turn long, text string, role string")
    got = chat.parsed(df).collect()
    assert len(got) == 6 and {r["role"] for r in got if r["conv_id"] == 3} == {"user"}
    assert chat.parsed(df.limit(0)).count() == 0
    assert chat.digests(chat.parsed(chat.transcript(df))).count() == 6


def test_packing_remembers_each_part_once(monkeypatch):
    """Words that differ by capitals, commas and hyphens share the memory of their parts, which keeps its bound."""
    monkeypatch.setattr("sightline.llm.words.MEMORY", 400)
    bpe, names = WordBpe(WORDS), ["".join(random.Random(i).choices("abcdefgh", k=7)) for i in range(600)]
    texts = [" ".join([n, n.title(), n.upper() + ",", n + ".", f"{n}-{m}", n + "’s"]) for n, m in zip(names, names[1:])]
    ids, sizes = bpe.encode_all(pa.array(texts))
    want = [word_library().encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    memories = [m for m in vars(bpe).values() if isinstance(m, words.Memory)]
    assert sum(len(m.new) + len(m.old) for m in memories) <= 400
