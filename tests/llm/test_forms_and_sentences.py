import random
import time
import unicodedata

import pytest

from lodestrand.llm import forms, looks, sentences, splitting


def spans(text):
    _, a, b = sentences.spans_batch([text])
    return [text[x:y] for x, y in zip(a, b)]


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ａ１，", "A1,"), ("é", "é"), ("ｶﾞ", "ガ"), ("o​k\xa0x", "ok x"), ("РАС", "PAC"), ("Νode", "Node"), ("⼀⻓", "一长"), ("ﬁn", "fin"), ("a‑b", "a-b"), ("x　y", "x y")],
)
def test_equal_looks_get_one_form(a, b):
    assert forms.consistent(a) == forms.consistent(b)


@pytest.mark.parametrize(("a", "b"), [("x²", "x2"), ("½", "1/2"), ("①", "1"), ("A", "a"), ("a  b", "a b"), ("a.", "a,"), ("H₂", "H2"), ("误差σ", "误差o")])
def test_other_differences_stay(a, b):
    assert forms.consistent(a) != forms.consistent(b)


def test_genuine_scripts_stay():
    assert forms.consistent("Москва") == "Москва" and forms.consistent("σ=2") == "σ=2"
    assert forms.consistent("Mосква") == "Москва"


def test_batch_equals_single():
    rng = random.Random(1)
    alphabet = list("aB 1。，…ﬁ①²σοеνéüガ한글นำ้क़ख़​\xa0\n\tＡ１") + ["é", "が", "ﾞｶ", "\ud800"]
    texts = ["", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800))]
    assert forms.decode(*forms.consistent_batch(texts)) == [forms.consistent(t) for t in texts]
    for t, got in zip(texts, forms.decode(*forms.letters_batch(texts))):
        kept = "".join(c for c in forms.consistent(t) if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd")
        assert got == "".join(c.lower() if len(c.lower()) == 1 else c for c in kept)
    assert all(forms.consistent(f := forms.consistent(t)) == f for t in texts)


@pytest.mark.parametrize(
    "parts",
    [
        ["With Dr. Wu, the U.S. office moved.", "It was e.g. done."],
        ["Fell to 3.5.Because", "no"],
        ["“跨来源的问题答得不稳！”某人喊道。", "下一句。。"],
        ["某人说：“先看。再谈。”", "下一句？！"],
        ["他用ONNX……，很快。", "同时ONNX……", "另一句"],
        ["We tried Go ... and then Rust.", "Then Java ...", "Next one."],
        ["Am 2. März kam Go bzw. Docker zum Einsatz.", "Er kam z. B. an."],
        ["यह ठीक है।", "डॉ. Yel आए।"],
        ["ผมดูแลระบบ", "ทีมงานย้าย 22 ไฟล์ไป"],
        ["The note “see x.py. Do not rerun.” was ignored.", "Why?"],
        ["v0.9から、「遅い。」という指摘を受けた。", "次の文！"],
        ["(It was late!)", "We left (see Fig. 3)."],
    ],
)
def test_sentences(parts):
    text = "" if parts[0] == "Fell to 3.5.Because" else ("" if parts[0][0] > "⺀" else " ").join(parts)
    if not text:
        assert spans("It fell to 3.5.Because of x!Now") == ["It fell to 3.5.", "Because of x!", "Now"]
        return
    assert spans(text) == parts


def test_line_ends_and_signs():
    assert spans("## Head\r\n1. One two. Three\n- x.y = 5.1  # RAG\n\n（2）二。三\n") == ["## Head", "1. One two.", "Three", "- x.y = 5.1  # RAG", "（2）二。", "三"]
    assert spans("") == [] and spans(" \n　") == []
    assert [x[:3] for x in spans("甲​。乙。")] == ["甲​。", "乙。"]


def test_sentence_table(spark):
    long = "很长。" * 50_000
    rows = [("a", "One. Two.", 1), ("a", "One. Two.", 2), (None, "x.", 3), ("b", None, 4), ("c", "", 5), ("d", long, 6)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, start_pos int")
    got = sentences.sentences(df).collect()
    assert sorted((r.chunk_id, r.start_pos, r.end_pos) for r in got if r.chunk_id == "a") == [("a", 0, 4), ("a", 5, 9)]
    assert sum(r.chunk_id == "d" for r in got) == 50_000 and {r.chunk_id for r in got} == {"a", "d"}
    assert sentences.sentences(df.limit(0)).count() == 0


def test_pieces_keep_limits_and_text(spark):
    rng = random.Random(2)
    words = ["word", "longer", "今天", "测试。", "End. ", "\n", "\n\n", " ", "，", "x" * 50]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(100, 600))) for _ in range(60)] + ["y" * 5000, " " * 1000, "", "é" * 900]
    df = spark.createDataFrame([(f"c{i}", None if i % 7 == 0 else "p", t, "clash") for i, t in enumerate(texts)] + [("n", "p", None, ""), (None, "p", "z" * 900, "")] + [("c1", "q", texts[1], "")], "chunk_id string, source_path string, text string, piece string")
    got = {}
    for r in splitting.split(df, 420, 60).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {f"c{i}" for i, t in enumerate(texts) if len(t.strip()) > 420}
    for k, rows in got.items():
        t = texts[int(k[1:])]
        assert [r.piece_no for r in rows] == list(range(len(rows))) and all(r.n_pieces == len(rows) for r in rows)
        assert all(0 < r.end_pos - r.start_pos <= 420 and r.piece == t[r.start_pos : r.end_pos] for r in rows)
        assert all(b.start_pos == max(rows[0].start_pos, a.end_pos - 60) for a, b in zip(rows, rows[1:]))
        assert t[rows[0].start_pos : rows[-1].end_pos] == t.strip()
    assert splitting.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split(df, 10, 10)


def test_pieces_end_at_sentences():
    text = "".join(f"This is sentence number {i} of the text, and it goes on. " for i in range(60)).strip()
    _, _, ends = sentences.spans_batch([text])
    for _, b in splitting.pieces(text, 0, len(text), ends.tolist(), 420, 60)[:-1]:
        assert text[b - 1] == "."


def test_same_looks_pairs(spark):
    rows = [("a", "Ａb"), ("b", "Ab"), ("c", "Ab"), ("c", "Ab"), ("d", "x"), ("e", None), (None, "Ab"), ("f", ""), ("g", "​")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "id string, text string, form_key string")
    keys = looks.form_keys(df, "id", "text").selectExpr("'x' as kind", "id", "form_key", "text_key")
    got = {(r.id_a, r.id_b) for r in looks.same_looks(keys, "id", "kind").collect()}
    assert got == {("a", "b"), ("a", "c"), ("f", "g")}
    assert looks.same_looks(keys.limit(0), "id", "kind").count() == 0
    assert {r.id: r.form for r in looks.consistent_forms(df, "id", "text").collect()} == {"a": "Ab", "b": "Ab", "c": "Ab", "d": "x", "f": "", "g": ""}


@pytest.mark.parametrize("line", ["(" * 300_000, '"' * 300_000, "()" * 150_000, "(1.) " * 60_000, "[" * 150_000 + ")" * 150_000, "((" * 80_000 + "]" * 100_000 + ")", "“" * 150_000 + "”" * 150_000, "- " * 100_000 + "a. " * 100_000])
def test_long_lines_take_linear_time(line):
    began = time.perf_counter()
    got = sentences.shape_spans(line)
    assert time.perf_counter() - began < 20 and all(a < b for a, b in got)


def test_list_levels_and_abbreviations():
    assert spans("1. Erster Punkt.\n   a. Unterpunkt. Noch einer.\n2. Zweiter.") == ["1. Erster Punkt.", "a. Unterpunkt.", "Noch einer.", "2. Zweiter."]
    assert spans("Он приехал, т.е. вернулся. Это г. Москва, ул. Ленина.") == ["Он приехал, т.е. вернулся.", "Это г. Москва, ул. Ленина."]
    assert spans("Vive en la Av. Libertad. Ver pág. 5.") == ["Vive en la Av. Libertad.", "Ver pág. 5."]
    assert spans("Il sig. Rossi. Ciao.") == ["Il sig. Rossi.", "Ciao."]


def test_long_texts_are_cut_in_linear_time():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "", ".", ",", "\n", "\n\n"]) for _ in range(170_000))
    _, _, ends = sentences.spans_batch([text])
    began = time.perf_counter()
    got = splitting.pieces(text, 0, len(text), ends.tolist(), 420, 60)
    assert time.perf_counter() - began < 20 and max(b - a for a, b in got) <= 420
    assert len(got) < 1.15 * len(text) / 360
    assert all(b[0] == a[1] - 60 for a, b in zip(got, got[1:]))


def test_text_decides_the_script_of_ambiguous_words():
    assert forms.resolved("Наш ресурс, рост и опыт") == "Наш ресурс, рост и опыт"
    assert forms.resolved("Наш pecypc, рост и опыт") == "Наш ресурс, рост и опыт"  # Latin letters in a Russian text
    assert forms.resolved("Our ресурс and раss") == "Our pecypc and pass"
    assert forms.resolved("Բարի օր") == "Բարի օր" and forms.consistent("Ꭺпtоn") == forms.consistent("Aпton")
    assert forms.resolved_batch(["Наш ресурс", "ascii", "Ｗide", "Оur"]) == ["Наш ресурс", "ascii", "Wide", "Our"]
    assert forms.consistent("کی") == forms.consistent("كى")
    assert forms.confusable_tokens("Наш pecypc") == [("pecypc", "whole_script", "ресурс")]
    assert forms.confusable_tokens("Our раss") == [("раss", "mixed", "pass")]
    assert forms.confusable_tokens("plain text") == forms.confusable_tokens("Наш ресурс") == []


def test_confusables_table(spark):
    rows = [("a", "Our ресурс ресурс", "x"), ("a", "Our ресурс ресурс", "y"), ("b", "plain", ""), ("c", None, ""), (None, "раss", ""), ("d", "", "")]
    df = spark.createDataFrame(rows, "id string, text string, token string")
    assert [tuple(r) for r in looks.confusables(df, "id", "text").collect()] == [("a", "ресурс", "whole_script", "pecypc", 2)]
    assert looks.confusables(df.limit(0), "id", "text").count() == 0


def test_many_records_of_two_spellings(spark):
    rows = [("x", f"a{i}", b"f", b"t1") for i in range(30)] + [("x", f"b{i}", b"f", b"t2") for i in range(20)] + [("x", "c", b"g", b"t3")]
    keys = spark.createDataFrame(rows, "kind string, id string, form_key binary, text_key binary")
    assert looks.spelling_pairs(keys, "kind").count() == 1 and looks.same_looks(keys, "id", "kind").count() == 600
    assert {r.n_spellings for r in looks.look_groups(keys, "id", "kind").collect()} == {2} and looks.look_groups(keys, "id", "kind").count() == 50
