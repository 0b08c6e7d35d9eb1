from lorespan.llm.sentences import split_sentences

DOCS = "doc_id long, text string, start_at string, end_at string"

TEXTS = {
    1: ["The call starts at 2 p.m.", "Dr. K. Chodatok met J. R. Vasoblent of Foo & Sons Corp. on Sep. 26.", 'He wrote "Is this final? Yes." under it and left.', "It is late, under-priced, etc.", "What happens if it fails?!", "the end came."],
    2: ["Bitte prüfen Sie z. B. die Messwerte.", "„Wir liefern morgen. Das ist sicher“, sagte der Disponent.", "Die Abteilung hat den Vertrag Nr. 961 am 24. März geprüft."],
    3: ["“我们再等等。不着急。”经理说道。", "价格上涨了86.9%，超出预期。", "结算文件已经归档……但是数字不对。"],
    4: ["第3条（例外を除く。）に従って処理してください。", "請求書はもう届きましたか？", "バルブは閉鎖されます！"],
    5: ["टीम ने अनुबंध की जाँच की।", '"हम रुकेंगे। जल्दी नहीं है।" प्रबंधक ने कहा।'],
    6: ["هل دفعت الشركة الفاتورة؟", "لم يوقع أحد على التعديل!"],
}


def corpus():
    # Paragraphs of single sentences teach where sentences end; joined ones are the cases.
    rows, k = [], 1000
    for sentences in TEXTS.values():
        for s in sentences:
            for _ in range(30):
                rows.append((k, s, "", ""))
                k += 1
    for _ in range(8):
        for s in ["The plan is done.", "Dr. Kolp asked on p. 571 and Fig. 22.", "See No. 741 of Inc. and Corp. files.", "Nobody met J. R. Kolp."]:
            rows.append((k, f"{s}", "", ""))
            k += 1
    return rows


def run(spark, cases):
    df = spark.createDataFrame([*corpus(), *[(i, t, "", "") for i, t in cases]], DOCS)
    out = {}
    texts = dict(cases)
    for r in split_sentences(df).where("doc_id < 1000").orderBy("doc_id", "start_at").collect():
        out.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_at : r.end_at])
    return out


def test_languages_and_structure(spark):
    joint = {3: "", 4: ""}
    cases = [(i, joint.get(i, " ").join(s)) for i, s in TEXTS.items()]
    cases += [
        (50, "Summary of the plan\n\nThe plan is done.  Nobody met J. R. Kolp.\n\n- The plan is done. Really.\n- Wait\n\n1. One.\n2. Two"),
        (51, "The plan\nis done. Nobody\nmet J. R. Kolp.\r\n\r\nThe plan is done"),
        (52, ""), (53, " \n\n "), (54, None), (55, "No mark"), (56, "étude 🚩 done. The plan is done."),
    ]
    got = run(spark, cases)
    for i, sentences in TEXTS.items():
        assert got[i] == sentences, i
    assert got[50] == ["Summary of the plan", "The plan is done.", "Nobody met J. R. Kolp.", "- The plan is done. Really.", "- Wait", "1. One.", "2. Two"]
    assert got[51] == ["The plan\nis done.", "Nobody\nmet J. R. Kolp.", "The plan is done"]
    assert not {52, 53, 54} & set(got) and got[55] == ["No mark"] and len(got[56]) == 2


def test_script_without_marks(spark):
    a, b, c = "โครงการต้องรอการอนุมัติจากคณะกรรมการ", "ปริมาณก๊าซวันนี้อยู่ที่ 77.7 ล้านหน่วยต่อวัน", "กรุณาส่งรายงานให้ฝ่ายตรวจสอบ"
    rows = [(k, s, "", "") for k, s in enumerate([a, b, c] * 20)] + [(900, f"{a} {b} {c}", "", "")]
    out = split_sentences(spark.createDataFrame(rows, DOCS)).where("doc_id = 900").orderBy("start_at").collect()
    assert [f"{a} {b} {c}"[r.start_at : r.end_at] for r in out] == [a, b, c]


def test_long_repeated_and_empty(spark):
    got = run(spark, [(1, "The plan is done. " * 3000), (2, '"' * 999 + "(" * 999)])
    assert len(got[1]) == 3000
    assert split_sentences(spark.createDataFrame([], DOCS)).count() == 0


def test_rare_words_before_stops_count_in_full(spark, monkeypatch):
    import lorespan.llm.sentences as module

    rows = [(k, f"We met Zuv{k}. Nobody met Kol{k}. It was late.") for k in range(60)] + [(100 + k, f"They left Zuv{k}.") for k in range(60)] + [(200 + k, "The plan is done.") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(tuple(r) for r in split_sentences(docs).collect())
    whole = found()
    monkeypatch.setattr(module, "MOST_COUNTS", 8)  # as if the corpus were far larger: hardly any word is frequent
    assert found() == whole and sum(1 for d, _, _ in whole if d < 60) == 180


def test_the_chain_decides_beside_the_characters():
    import numpy as np

    from lorespan.llm.sentences import BITS, Model, _EMISSIONS, prior_weights, transition

    weights = prior_weights()
    weights[_EMISSIONS + transition("stop", 6) + BITS + 1] = -20.0  # no sentence of some letters behind another one
    found = [(20, 21, "stop", 1, "a", "B"), (26, 27, "stop", 1, "b", "C"), (60, 61, "stop", 1, "c", "D")]
    counts = {("stop", w): (10, 5, 0) for w in "abc"} | {("word", w): (5, 10, 0) for w in "BCD"}
    total = {"stop": [30, 15, 1], "word": [15, 30, 0]}
    with_chain, without = Model(counts, total, weights), Model(counts, total, prior_weights())
    assert without.decode(0, 90, found, {}) == [0, 1, 2] and with_chain.decode(0, 90, found, {}) == [0, 2]
    assert all(np.dot(without.emission(*x[2:], {}), list(weights[:7])) > 0 for x in found)


def test_weights_are_learned_from_joints():
    from lorespan.llm.sentences import BITS, _EMISSIONS, _PLACE, fit, prior_weights, transition

    boundary, abbreviation = [1.0, 2.0, 0.0, 1.0, 1.0, 0.0, 1.0], [1.0, -4.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    sequence = [(boundary, "stop", 40, 1), (abbreviation, "stop", 3, 0), (boundary, "stop", 50, 1), ([], "stop", 30, 1)]
    w, prior = fit([sequence] * 60), prior_weights()
    assert w[_PLACE["stop"] + 1] > prior[_PLACE["stop"] + 1] and (fit([]) == prior).all()
    short, long = (_EMISSIONS + transition("stop", n) + BITS + 1 for n in (3, 40))
    assert w[long] > w[short]


def test_fitted_weights_change_sentences(spark):
    rows = [(k, f"The desk number {k} is open.\n\nMr. Baker{k} called the desk.\n\nNobody met Mr. Baker{k} today. The plan is done.\n\nIt ends {['today', 'soon'][k % 2]}.", "", "") for k in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {(r.doc_id, r.start_at, r.end_at) for r in split_sentences(docs).collect()}
    assert len(found) == 80 * 5
    assert split_sentences(docs, fitted=False).count() >= 80 * 5
