import random

from lorespan.llm.names import jaro_winkler, link_names, one_edit, parse_firm, parse_person, parse_project, same_entity_pairs

ENTITIES = "ord bigint, id string, name string, entity_type string, aliases array<string>, cluster string, kind int"


def pairs(spark, rows):
    df = spark.createDataFrame([(o, f"e{o}", n, t, a, "x", 1) for o, n, t, a in rows], ENTITIES)
    return {(r.ord_a, r.ord_b) for r in same_entity_pairs(df).collect()}


def test_parsing():
    assert parse_person("Laprihul, Danny") == parse_person("Daniel Laprihul") == parse_person("Laprihul Daniel") == ("strong", "daniel", "laprihul", "")
    assert parse_person("Dmitri H. Homaklom/HOU") == ("strong", "dmitri", "homaklom", "h")
    assert parse_person("Blohaprord ET") == ("weak", "e", "blohaprord", "t")
    assert parse_person("wren.preplatrer@zupewex.example") == ("strong", "wren", "preplatrer", "")
    assert parse_person("Rob") is None and parse_person("...") is None
    assert parse_firm("The Titratil Shipping Corporation")[:3] == parse_firm("Shipping of Titratil")[:3] == parse_firm("titratil-shpg corp")[:3] == ("strong", "shipping", "titratil")
    assert parse_firm("D.S.P.L.")[:3] == ("acronym", "", "dspl")
    assert parse_project("Prj Brusnuskird ph. 3") == parse_project("the Brusnuskird Project Phase III") == ("strong", "3", "brusnuskird", "")


def test_similarity():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert one_edit("abcd", "abdc") and one_edit("abcd", "abcde") and one_edit("abcd", "bcd") and not one_edit("abcd", "badc")
    rng = random.Random(1)

    def brute(a, b):
        letters = "abc"
        out = {a}
        for k in range(len(a) + 1):
            out |= {a[:k] + c + a[k:] for c in letters}
            if k < len(a):
                out |= {a[:k] + a[k + 1 :]} | {a[:k] + c + a[k + 1 :] for c in letters}
            if k + 1 < len(a):
                out.add(a[:k] + a[k + 1] + a[k] + a[k + 2 :])
        return b in out

    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(2))
        assert one_edit(a, b) == brute(a, b), (a, b)


def test_variants_are_linked_and_others_are_not(spark):
    rows = [
        (1, "Daniel Laprihul", "User", None), (2, "Laprihul, Danny", "User", []), (3, "Daneil Laprihul", "User", [None, ""]), (4, "D. Laprihul", "User", None), (5, "Dmitri Laprihul", "Organization", None),
        (6, "Aiko Hanilurd", "User", None), (7, "Anthony Hanilurd", "User", None), (8, "A. Hanilurd", "User", None),
        (9, "Franozet project", "Project", None), (10, "Project Franozet Phase II", "Project", None), (11, "Prj Franozet ph. 2", "Project", None),
        (12, "Drikreblut Legal Associates", "Organization", None), (13, "Drikreblut Energy Services Co.", "Organization", None), (14, "DESC", "Organization", None), (15, "Energy Svcs of Drikreblut", "Organization", None),
        (16, None, "User", None), (17, "Daniel Laprihul", None, None), (18, "Daniel Laprihul", "Topic", None), (19, "x" * 50000, "User", ["y" * 50000]),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (10, 11), (13, 15), (13, 14), (14, 15)}


def test_ties_repeated_rows_and_empty(spark):
    assert pairs(spark, [(1, "Aiko Hanilurd", "User", None), (2, "Aiko Hanilurd", "User", None), (3, "AIKO HANILURD", "User", None)]) == {(1, 2), (1, 3), (2, 3)}
    assert pairs(spark, []) == set()
    assert link_names(spark.createDataFrame([], ENTITIES)).count() == 0


def test_jaro_winkler_accepts_two_slips_and_short_surnames_meet(spark):
    rows = [(1, "Daniel Laprihulster", "User", None), (2, "Daniel Lapirhulstr", "User", None), (3, "Mary Baker", "User", None), (4, "Mary Bader", "User", None), (5, "Danial Kromanter", "User", None), (6, "Daniel Kromantar", "User", None), (7, "Daniel Hanilurd", "User", None), (8, "Daniel Hanbolurd", "User", None)]
    assert pairs(spark, rows) == {(1, 2), (3, 4), (5, 6)}


def test_bearers_of_one_surname_do_not_all_meet(spark):
    from lorespan.llm.names import candidate_pairs

    names = ["".join(chr(97 + (k * p) % 26) for p in (3, 5, 7, 11, 17)) + "io" for k in range(300)]
    keys = spark.createDataFrame([(f"k{k}", "User", q, "hotsurname") for k, q in enumerate(dict.fromkeys(names))], "key string, entity_type string, q string, s string")
    assert candidate_pairs(keys).count() < 30 * keys.count()
