from pyspark.sql import functions as F

from corpusloom.llm.catalog import p10, p4
from corpusloom.llm.language import LANGUAGES, ByteConvNet, languages, plain_code, train, training_windows, windows_of
from corpusloom.llm.mojibake import garbled_fields, garbling_cost, repair
from corpusloom.llm.qa_defects import flag_defects, length_limits, neighbours
from corpusloom.session import read

SF = "/root/testdata/sf0.001"


def test_repair_undoes_every_wrong_decoding():
    for text in ("生成式人工智能赋能课堂教学：机制、风险与对策", "Wie verändern Übungen die Qualität – „Fälle“?", "Як Обучение влияет на результаты учащихся", "学習者の批判的思考に与える影響"):
        for wrong in ("latin-1", "cp1252", "cp1251", "cp437", "gb18030"):
            try:
                garbled = text.encode().decode(wrong)
            except UnicodeDecodeError:
                continue
            if wrong != "gb18030" or " " not in text:  # a run of two letters between spaces is too cheap to stand out
                assert repair(garbled)[0] == text, (wrong, garbled)
            assert repair(garbled)[1] > 0
    deep = "naïve café, más señales"
    for _ in range(6):
        deep = deep.encode().decode("latin-1")
    assert repair(deep)[:2] == ("naïve café, más señales", 6)
    russian = "Как виртуальные лаборатории влияют на качество"
    assert repair(russian.encode().decode("cp1251"))[:2] == (russian, 1)  # a word of sound letters is not read on
    twice = "“naïve” café".encode().decode("latin-1").encode().decode("latin-1")
    assert repair(twice)[:2] == ("“naïve” café", 2)
    assert repair("研究".encode("gbk").decode("latin-1") * 3)[0] == "研究" * 3


def test_legacy_pairs_of_a_field():
    russian, chinese, plain = "Влияние обучения на результаты учащихся", "生成式人工智能赋能课堂教学机制", bytes.decode
    for text, meant, wrong in (
        (russian, "cp1251", "latin-1"), (russian, "koi8-r", "latin-1"), (russian, "cp1251", "cp437"), (chinese, "gbk", "cp437"), (chinese, "gbk", "cp850"), (chinese, "gbk", "mac-roman"), (chinese, "gbk", "koi8-r"),
        ("學習者の批判的思考".replace("學", "学"), "shift_jis", "gb18030"), ("生成式人工智慧對課堂教學的影響", "big5", "gb18030"), ("Wie verändern Übungen die Qualität", "cp1252", "mac-roman"),
    ):
        assert repair(plain(text.encode(meant), wrong)) == (text, 1, False), (text, meant, wrong)
    # short runs follow the field's pair, and nested layers end in a legacy encoding
    assert repair("研究方法与设计 以 a 形".encode("gbk").decode("latin-1"))[0] == "研究方法与设计 以 a 形"
    assert repair(chinese.encode("gbk").decode("latin-1").encode().decode("latin-1")) == (chinese, 2, False)


def test_sound_texts_stay():
    for text in ("", "plain", "AVALIAÇÃO das funções", "¿Qué señal? Él «niño» ¡sí!", "部分文本曾出现“锟斤拷”一类字样", "骆翊、缪璟与霏", "Ελληνικά και русский", "naïve façade—œuvre", "3 × 4 ÷ 2 ± 1°", "猫と犬"):
        assert repair(text) == (text, 0, False), text
    assert garbling_cost("é") < garbling_cost("Ã©")


def test_garbled_fields(spark):
    rows = [(1, "caf" + "é".encode().decode("latin-1"), None, "x"), (2, None, "", "x"), (3, "ok", "鐢熸垚�", "x"), (4, "long " * 50_000 + "é".encode().decode("latin-1"), "ok", "x"), (1, "ok", "ok", "x")]
    frame = spark.createDataFrame(rows, "k bigint, a string, b string, id string")
    got = {(r["id"], r["field"], r["lost"]) for r in garbled_fields(frame, "k", {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {(1, "a", False), (3, "b", True), (4, "a", False)}
    assert garbled_fields(frame.limit(0), "k", {"a": F.col("a")}).count() == 0


def test_defects(spark):
    q = "What did the authors find about adaptive quizzes?"
    whole = "The results show that adaptive quizzes improved the reading of the learners in the second year of the study."
    rows = [
        ("d", 1, q, None), ("d", 2, q, " … "), ("d", 3, q, "Answer:"), ("d", 4, q, "N/A"), ("d", 5, q, "Sorry, but I cannot help with that question."), ("d", 6, q, q.upper().replace("?", "")),
        ("d", 7, q, "Question: " + q), ("d", 8, q, "Die Ergebnisse zeigen, dass die Übungen das Lesen der Lernenden nicht verbessern."), ("d", 9, "请用英文概括：结果是什么？", whole), ("d", 10, q, whole),
        ("d", 11, q, whole[:50]), ("d", 12, q, "adaptive quizzes"), ("d", 13, q, "Three aspects:\n1. reading\n2. writing"), ("d", 14, q, f"{q} {whole}"), ("d", 15, q, whole + " There is (among others,"), ("d", 20, q, "Three aspects: 1. reading; 2."), ("d", 21, q, f"{q} {q}"), ("d", 22, q, "与材料中没有相关信息，因此不予作答。"),
        ("d", 16, None, "是的。"), ("d", 17, q, "5 weeks"), ("d", 18, q, whole + " " + "x" * 100_000 + "."), ("d", 10, q, whole), ("d", 19, q, "The paper says that teachers cannot answer every request alone, so quizzes take over."),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "tab string, pair_id bigint, question string, answer string, defect string")
    got = {r["pair_id"]: r["defect"] for r in flag_defects(frame).collect()}
    assert got == {1: "empty", 2: "empty", 3: "empty", 4: "empty", 5: "refusal", 6: "copy", 7: "copy", 8: "language", 11: "truncated", 15: "truncated", 20: "truncated", 21: "copy", 22: "refusal"}
    assert flag_defects(frame.limit(0)).count() == 0


def test_neighbours_equal_brute_force(spark):
    import os
    import random

    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    wanted = {t: rng.random() < 0.5 for t in texts}
    frame = spark.createDataFrame(list(wanted.items()), "text string, wanted boolean").repartition(3)
    got = {r["text"]: (r["opening"], r["longer"]) for r in neighbours(frame).collect()}

    def expected(t):
        others = [o for o in texts if o != t and not t.startswith(o)]
        return max((len(os.path.commonprefix((o, t))) for o in others), default=0), any(o.startswith(t) for o in others)

    # next to a text that it continues, a text's own opening is that of its other neighbour
    for t, (opening, longer) in got.items():
        assert longer == expected(t)[1] and opening <= expected(t)[0], t
        if t == texts[0] or not t.startswith(texts[texts.index(t) - 1]):
            assert opening == expected(t)[0], t
    assert set(got) == {t for t in texts if wanted[t]}
    assert neighbours(frame.limit(0)).count() == 0


def test_response_cut_at_the_end_of_a_sentence(spark):
    whole = "The results show that quizzes improved the reading of all learners. A second study confirms this. It took nine weeks in two schools."
    rows = [("d", 1, None, whole), ("d", 2, None, whole[: whole.index("It took") - 1]), ("d", 3, None, whole[: whole.index("A second") - 1])]
    got = {r["pair_id"]: r["defect"] for r in flag_defects(spark.createDataFrame(rows, "tab string, pair_id bigint, question string, answer string")).collect()}
    assert got == {2: "truncated"}  # a single complete sentence is a short answer


def test_length_limits(spark):
    lengths = [(n, 4 + n % 3, 1) for n in range(50, 150)] + [(200, 60, 58), (300, 60, 10)]
    assert [r["len"] for r in length_limits(spark.createDataFrame(lengths, "len int, n bigint, cut bigint")).collect()] == [200]


def test_neighbours_find_most_truncations(spark, monkeypatch):
    from corpusloom.llm import qa_defects

    count = lambda: p4.p4_found(spark, "/root/testdata/sf0.01").filter("defect = 'truncated'").count()
    found = count()
    monkeypatch.setattr(qa_defects, "neighbours", lambda texts: texts.limit(0).selectExpr("text", "0 AS opening", "false AS longer"))
    assert count() < found / 2


def test_p4_runs(spark):
    rows = p4.p4_found(spark, SF).collect()
    assert {r["defect"] for r in rows} <= {"empty", "truncated", "refusal", "copy", "language"} and len({(r["tab"], r["pair_id"]) for r in rows}) == len(rows) > 0


def test_network_learns_and_pads():
    assert windows_of("ab").shape == (1, 64) and windows_of("a" * 129).shape == (3, 64)
    net = ByteConvNet()
    import numpy as np

    texts = ["the cat and the dog are here", "das ist nicht der hund und die katze"] * 40
    w = np.concatenate([windows_of(t) for t in texts])
    y = np.array([1, 4] * 40)
    net.fit(w, y, epochs=15)
    assert (net.log_probabilities(w).argmax(axis=1) == y).all()


def test_languages(spark):
    seeds = read(spark, SF, "lang_seed")
    # fitted on every other seed, judged on the rest
    net = train(read(spark, "/root/testdata/sf0.01", "documents"), seeds.filter("seed_no % 2 = 1"))
    held = seeds.filter("seed_no % 2 = 0").collect()
    found = languages(spark.createDataFrame([(i, r["text"], "x") for i, r in enumerate(held)], "doc_id bigint, text string, lang string"), net).filter("seg_no = 0").collect()
    assert sum(r["lang"] == held[r["doc_id"]]["lang"] for r in found) >= len(held) - 1
    en, de = next(r["text"] for r in held if r["lang"] == "en"), next(r["text"] for r in held if r["lang"] == "de")
    rows = [(1, f"{en} {en}\n{de}", None), (2, None, "en"), (3, "", "de"), (4, "— 12 / 48 —", "en"), (5, f"Title: {en}", "EN"), (6, en, "en"), (7, (en + " ") * 3000, "de"), (8, f"{en}\n我们同意。", "en"), (9, f"{en}\n关键词。", "en"), (6, en, "en")]
    documents = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id bigint, text string, lang string, label string, seg_no int")
    got = sorted((r["doc_id"], r["seg_no"], r["lang"], r["label"]) for r in languages(documents, net).collect())
    assert got[:3] == [(1, 0, "en", None), (1, 1, "en", None), (1, 2, "de", None)]
    assert got[3:7] == [(5, 0, "en", "en"), (6, 0, "en", "en"), (6, 0, "en", "en"), (7, 0, "en", "de")]
    assert [r[:3] for r in got[7:10]] == [(8, 0, "en"), (8, 1, "en"), (8, 2, "zh")]
    codes = spark.createDataFrame([("EN",), ("zh_Hans",), ("pt-BR",), ("xx",), (None,), (" ",)], "l string").select(plain_code(F.col("l")).alias("c")).collect()
    assert [r["c"] for r in codes] == ["en", "zh", "pt", None, None, None]
    assert languages(documents.limit(0), net).count() == 0
    assert set(r["lang"] for r in p10.p10_found(spark, SF).collect()) <= set(LANGUAGES)


def test_labelled_texts_without_letters_train_nothing(spark):
    rows = [(1, None, "zh"), (2, "", "zh"), (3, "— 12 —", "en"), (4, "Das ist nicht der Hund.", "de"), (5, "x", None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seeds = spark.createDataFrame([(1, None, "en"), (2, "the cat and the dog", "en"), (3, "", None)], "seed_no int, text string, lang string")
    _, labels, sure = training_windows(documents, seeds)
    assert {(LANGUAGES[i], bool(s)) for i, s in zip(labels, sure)} == {("de", False), ("en", True)}
    assert len(training_windows(documents.limit(0), seeds.limit(0))[0]) == 0
    train(documents.limit(0), seeds.limit(0))
