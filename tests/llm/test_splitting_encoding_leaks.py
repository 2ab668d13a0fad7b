import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemoframe.llm import encoding, leaks, splitting
from mnemoframe.llm.words import words

tokenizers = pytest.importorskip("tokenizers")


def check_pieces(text, max_tokens=160, max_chars=1200, overlap=20):
    spans = splitting.split_spans(text, max_tokens, max_chars, overlap)
    tokens = splitting._TOKEN.findall(text)
    over = len(tokens) > max_tokens or len(text) > max_chars
    assert (len(spans) > 1) <= over and (len(spans) > 1) >= (len(tokens) > max_tokens)
    for a, b, back in spans:
        assert b - a <= max_chars and len(splitting._TOKEN.findall(text[a:b])) <= max_tokens and back <= overlap
    covered = 0
    for a, b, _ in spans:  # nothing but white space is left out
        assert not text[covered:a].strip(" \t\r\n")
        covered = max(covered, b)
    assert not text[covered:].strip(" \t\r\n")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "Ende.", "\n\n", "中文", "x" * 90, " ", "\t", "# Head", "né,"]), max_size=200).map(" ".join), st.integers(3, 30), st.integers(20, 120), st.integers(0, 8))
def test_pieces_keep_all_limits(text, max_tokens, max_chars, overlap):
    check_pieces(text, max_tokens, max_chars, min(overlap, max_tokens - 1))


@pytest.mark.parametrize("text", ["", "  \n", "a" * 50_000, "word " * 20_000, "中" * 20_000, ("Satz. " * 30 + "\n\n") * 40, "x" * 1200, "x" * 1201, " " * 3000])
def test_extreme_texts(text):
    check_pieces(text)


def test_cuts_at_the_strongest_boundary():
    text = " ".join(["w"] * 90) + "\n\n" + " ".join(["v"] * 90)
    spans = splitting.split_spans(text)
    assert len(spans) == 2 and text[spans[0][0] : spans[0][1]].endswith("w") and spans[1][2] == 20
    assert text[spans[1][0] :].startswith("w ")


def test_split_items(spark):
    data = [(1, "a b", 7), (1, "a b", 7), (2, None, 1), (3, "w " * 200, 1), (None, "x", 1), (4, "   ", 0), (5, "a" + " " * 1200, 0)]
    got = splitting.split_items(spark.createDataFrame(data, "chunk_id long, content string, n_pieces int"), "chunk_id", "content").toPandas()
    assert sorted(got[got.piece_index == 0].id) == [1, 2, 3, 4, 5] and set(got[got.oversized].id) == {3, 5}
    assert got[got.id == 1].content.tolist() == ["a b"] and got[got.id == 2].content.tolist() == [""]
    assert splitting.split_items(spark.createDataFrame([], "chunk_id long, content string"), "chunk_id", "content").collect() == []


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{encoding.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoding_equals_the_library(reference):
    rnd = random.Random(5)
    texts = ["", " ", "a" * 5000, "ab" * 999, "<|endoftext|> x", "don't  stop\n\n", "\u0000​", "é̈" * 200, "中文字符" * 300, "🙂🙃" * 50]
    texts += ["".join(rnd.choice("aab cdé\n中.'s9") for _ in range(rnd.randrange(400))) for _ in range(200)]
    assert encoding.Encoder().encode(texts) == reference(texts)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_encoding_of_any_text(reference, text):
    assert encoding.encoder(encoding.VOCABULARIES, "byte_bpe_50k.tiktoken").encode([text]) == reference([text])


def test_encode_corpus(spark):
    data = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")]
    got = encoding.encode_corpus(spark.createDataFrame(data, "doc_id long, text string, ids string")).collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == [(1, [31373, 995]), (2, []), (3, []), (1, [31373, 995])]


def test_words():
    assert words("Ab_c 1é9! 中文x é") == ["ab", "c", "1é9", "中", "文", "x", "e"]
    assert words(None) == [] and words("") == []


def test_wu_manber_against_brute_force():
    rnd = random.Random(2)
    items = [(i, [rnd.choice("abc") for _ in range(rnd.randrange(30))]) for i in range(40)]
    search = leaks.WuManber(items, 5)
    for _ in range(200):
        text = [rnd.choice("abc") for _ in range(rnd.randrange(60))]
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        assert search.find(text) == {k for k, w in items if any(tuple(w[i : i + 5]) in grams for i in range(len(w) - 4))}


@pytest.mark.parametrize("per_block", [1, 100])
def test_leaked(spark, per_block):
    q = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, q, "short", "clash"), (2, "no", q.upper(), "clash"), (3, None, None, None), (None, q, q, "")], "item_id long, question string, passage string, text string")
    docs = spark.createDataFrame([(1, "x, " + q + "!"), (2, q[:30]), (3, None), (4, ""), (1, q)], "doc_id long, text string")
    assert {tuple(r) for r in leaks.leaked(docs, items, per_block=per_block).collect()} == {(1, 1), (1, 2)}
    assert leaks.leaked(docs, items.limit(0)).collect() == [] and leaks.leaked(docs.limit(0), items).collect() == []


def test_long_texts_take_time_in_proportion_and_keep_the_overlap():
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 9))) + "." * (rnd.random() < 0.1) for _ in range(100_000))
    spans = splitting.split_spans(text)
    assert all(back == 20 for _, _, back in spans[1:]) and len(spans) <= 1.15 * 100_000 / 140
