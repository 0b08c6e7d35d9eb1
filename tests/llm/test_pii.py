from lorespan.llm.pii import personal_items, redact

MAIL = "ord bigint, sender string, `to` array<string>, cc array<string>, body string, kind string, votes int"
CLAIMS = "ord bigint, evidence array<struct<exact_quote:string,author:string>>"

BODY = """Hi Bob,

Call Penelope Distaslit on +49 30 23125 872 x5 after lunch. Write to mei.vatumot at svedrufum.test instead or jo (dot) doe (at) acme (dot) example.
For the badge Svezaspem, Michael gave SSN 929-20-2089 to the front desk. Deal 276-71-5145 is booked under contract 8122166757.
The site office is at 1886 N. Waspiflus Street, Apt 7 now. Ship it to Calle Hanilurd 110, 48715 Villa Kroslispik by Friday.
Prof. Susan Knedrimat works for Krothozut Energy Inc. and for Zevasler Partners Ltd. at the same time. The bill is due and will not grant us more time.
Part no. X849-4576 fits the Jenny pump and the Jack stand. iris keweknos's number is (020) 7946 0852.

Best,
dmitri

Dmitri Misterul
P.O. Box 8061, Chojitix Creek, OR 88427
ph 4025550180
dmitri.misterul@jaspober.example
"""
WANT = {
    ("name", "Bob"), ("name", "Penelope Distaslit"), ("phone", "+49 30 23125 872"), ("email", "mei.vatumot at svedrufum.test"), ("email", "jo (dot) doe (at) acme (dot) example"), ("name", "Svezaspem, Michael"), ("idnum", "929-20-2089"),
    ("street", "1886 N. Waspiflus Street, Apt 7"), ("street", "Calle Hanilurd 110, 48715 Villa Kroslispik"), ("name", "Susan Knedrimat"), ("name", "iris keweknos"), ("phone", "(020) 7946 0852"), ("name", "dmitri"), ("name", "Dmitri Misterul"),
    ("street", "P.O. Box 8061, Chojitix Creek, OR 88427"), ("phone", "4025550180"), ("email", "dmitri.misterul@jaspober.example"),
}


def tables(spark, bodies, quotes=()):
    mail = spark.createDataFrame([(k, "Dmitri Misterul <dmitri.misterul@jaspober.example>" if k else None, None, [None], b, "x", 1) for k, b in enumerate(bodies)], MAIL)
    return mail, spark.createDataFrame([(k, q) for k, q in enumerate(quotes)], CLAIMS)


def test_found_items(spark):
    mail, claims = tables(spark, ["", BODY, None, BODY], [None, [], [("Call Anthony @ 212-555-0157 x11.", None), (None, None)]])
    rows = personal_items(mail, claims).collect()
    assert {(r.kind, r.found_text) for r in rows if r.src == "mail" and r.ord == 1} == WANT
    assert {(r.kind, r.found_text) for r in rows if r.ord == 3} == WANT
    assert {(r.pos, r.kind, r.found_text) for r in rows if r.src == "evidence"} == {(0, "name", "Anthony"), (0, "phone", "212-555-0157")}


def test_redaction_keeps_the_rest(spark):
    mail, claims = tables(spark, [None, BODY])
    clean = redact(mail, claims).collect()[0].clean_text
    assert "Call [NAME] on [PHONE] x5 after lunch." in clean and "Krothozut Energy Inc." in clean and "[NAME], [" not in clean
    assert not any(text in clean for _, text in WANT if len(text) > 8)


def test_long_and_empty(spark):
    mail, claims = tables(spark, ["word " * 40000 + "Call Anthony @ 212-555-0157 now.", "@" * 5000, "1" * 30000])
    assert {r.found_text for r in personal_items(mail, claims).where("ord = 0").collect()} == {"Anthony", "212-555-0157"}
    mail, claims = tables(spark, [])
    assert personal_items(mail, claims).count() == 0 and redact(mail, claims).count() == 0


def test_names_of_the_header_are_candidates(spark):
    from lorespan.llm.pii import candidates

    header = "Chandra Rao <c.rao@x.example> Xiadani Okwu <o@x.example>"
    text = "Dear Chandra,\n\nXiadani Okwu wrote to Rao Energy about the Okwu plan.\n\nRegards,\nOkwu"
    names = [text[s:e] for s, e, kind, _ in candidates(text, header) if kind == "name"]
    assert names == ["Chandra", "Xiadani Okwu", "Okwu"] and not [x for x in candidates(text, None) if x[2] == "name"]
    mail = spark.createDataFrame([(1, "Chandra Rao <c.rao@x.example>", ["Xiadani Okwu <o@x.example>"], None, text, "x", 1)], MAIL)
    found = {r.found_text for r in personal_items(mail, spark.createDataFrame([], CLAIMS)).where("kind = 'name'").collect()}
    assert found == {"Chandra", "Xiadani Okwu", "Okwu"}


def test_expectation_maximisation_can_overturn_the_votes():
    from lorespan.llm.pii import BIT, likelihoods

    bit = BIT["name"]
    clear = {bit["given"] | bit["full"] | bit["header"] | bit["greeting"]: 3000, bit["given"] | bit["header"] | bit["signoff"]: 3000, bit["lower"]: 2000}
    odd = bit["given"] | bit["full"] | bit["header"] | bit["greeting"] | bit["project"]
    doubted = bit["given"] | bit["project"]  # votes for and against, so it starts below a half
    assert likelihoods("name", {doubted: 3})[doubted] < 0.5
    assert likelihoods("name", clear | {odd: 3000, doubted | bit["header"]: 600})[doubted | bit["header"]] > 0.5
    thing = bit["given"] | bit["thing"]  # a given name, but never in a context of names
    assert likelihoods("name", clear | {thing: 500})[thing] < 0.1


def test_the_classifier_sees_the_span():
    from lorespan.llm.pii import BIT, learn, shape

    bit = BIT["idnum"]
    plain, framed = shape("no 123456789 is", 3, 12), shape("#123456789#", 1, 10)
    patterns = [("idnum", bit["form"] | bit["label"] | bit["near"], plain, 400), ("idnum", bit["form"] | bit["figure"], framed, 400), ("idnum", bit["form"], plain, 30), ("idnum", bit["form"], framed, 30)]
    p = learn(patterns)
    assert p["idnum", bit["form"], plain] > p["idnum", bit["form"], framed] + 0.1


def test_given_names_are_learned_from_headers(spark):
    from lorespan.llm.pii import given_names

    people = [f"Oluwaseun Fam{k}li <o{k}@x.example>".replace(f"{k}", "abcdefghij"[k]) for k in range(6)] + ["Gas Desk <desk@x.example>", "Solo <s@x.example>"]
    mail = spark.createDataFrame([(k, p, None, [None], "Hi Oluwaseun,\n\nPlease ask Oluwaseun Marok on Monday.", "x", 1) for k, p in enumerate(people)], MAIL)
    none = spark.createDataFrame([], CLAIMS)
    assert given_names(mail, none) == ["oluwaseun"]
    assert "Oluwaseun Marok" in {r.found_text for r in personal_items(mail, none).where("ord = 6").collect()}
