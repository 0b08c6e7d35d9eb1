from lorespan.llm.quoted import new_text, newly_written, winnow, without_span

SENDER = "Ulf Truflohax <ulf.truflohax@dupaflun-mail.example>"
MAIL = "ord bigint, sender string, body string, pos int, src string"
THREADS = "issue_id int, comments array<struct<author:string,text:string>>"


def test_marks_and_closings():
    assert new_text("Hi Bob,\n\nNew words.\n\nCheers, Ulf\n\nUlf Truflohax | Director\n\nSent from my handheld", SENDER) == "Hi Bob, New words."
    assert new_text("On 9 Sep 2003, at 08:20, Al Bee <a@b.example> wrote:\n> old\n>> older\n\nNew one.\n\n> more old\n\nNew two.\n\n- Ulf", SENDER) == "New one. New two."
    assert new_text("fyi -\n\nBegin forwarded message:\n\nFrom: Al Bee\nSubject: x\n\nOld text.", SENDER) == "fyi -"
    assert new_text("New.\n\n-----Ursprüngliche Nachricht-----\nFrom: Al [mailto:a@b.example]\nSubject: x\n\nOld.\n\nStill old.", SENDER) == "New."
    assert new_text("________________________________\nFrom: Bee, Al\nSent: 1/5/02\nSubject: x\n\n> old\n\nNew.", SENDER) == "New."
    assert new_text("New.\n\nFrom: Ostrel hub\nTo: Tarn lateral\nVolume: 4,500\n\nBest,\n\nUlf\n\nP.S. Also new.", SENDER) == "New. From: Ostrel hub To: Tarn lateral Volume: 4,500 P.S. Also new."
    assert new_text("On Tuesday the operator wrote: no cuts.\n\n===\nlow  high\n3.1  4.4\n===\n\nViele Grüße,\nulf", SENDER) == "On Tuesday the operator wrote: no cuts. === low high 3.1 4.4 ==="
    assert new_text("Done.\n\n-- \nUlf Truflohax\nphone 1\n\n=====\nThis e-mail is confidential and intended only\nfor the named recipient.", SENDER) == "Done."
    assert new_text("X wrote:\n> all old", SENDER) == "" == new_text("", None) == new_text(None, None)
    assert new_text("Thanks for the list.", SENDER) == "Thanks for the list."
    assert new_text("New.\n\n- Elizabeth\n\nElizabeth Foo\nPlant Engineer", None) == "New." == new_text("New.\n\nHiro", "")
    assert new_text("Write to\nsomebody or call the one and only person here, that is,\nUlf Truflohax.", SENDER).endswith("Truflohax.")


def test_rows_nulls_and_unmarked_quotation(spark):
    earlier = " ".join(f"word{k} item{k}" for k in range(40)) + "."
    mail = [(1, SENDER, earlier, 9, "z"), (2, "al@b.example", f"I agree with this.\n\n{earlier}", 9, "z"), (3, None, None, 9, "z"), (4, None, "  ", 9, "z"), (5, SENDER, earlier, 9, "z")]
    threads = [(1, [("al", "Hello.\n\n> old"), (None, None), (None, " ")]), (2, None), (3, [])]
    out = {(r.src, r.ord, r.pos): r.new_text for r in newly_written(spark.createDataFrame(mail, MAIL), spark.createDataFrame(threads, THREADS)).collect()}
    assert out == {("mail", 1, 0): earlier, ("mail", 2, 0): "I agree with this.", ("mail", 5, 0): earlier, ("thread", 1, 0): "Hello."}
    assert newly_written(spark.createDataFrame([], MAIL), spark.createDataFrame([], THREADS)).count() == 0


def test_winnowing():
    text = " ".join(f"w{k}" for k in range(200))
    a, b, c, d = winnow([text, "before it " + text + " and after", "", "one two"])
    assert len(set(a) & set(b)) >= 0.9 * len(a) and len(c) == 0 and len(d) == 1
    assert without_span("new " + text, text) == "new" and without_span("a b c", "a b c") is None


def test_recurring_closings(spark):
    closing = "The views in this letter are those of nobody in particular and bind no party at all."
    mail = [(k, f"Ann Bee{k}x <ann.bee{k}x@x.example>", f"Words number {k} are new.\n\nBest,\nAnn\n\n{closing}", 0, "z") for k in range(12)]
    mail.append((99, "al@x.example", f"No name here.\n\n{closing}", 0, "z"))
    out = {r.ord: r.new_text for r in newly_written(spark.createDataFrame(mail, MAIL), spark.createDataFrame([], THREADS)).collect()}
    assert out[99] == "No name here." and out[3] == "Words number 3 are new."


def _words(name, n):
    return " ".join(f"{name}{k}" for k in range(n)) + "."


def _run(spark, mail, threads=()):
    rows = newly_written(spark.createDataFrame([(k, s, b, 0, "z") for k, s, b in mail], MAIL), spark.createDataFrame(list(threads), THREADS)).collect()
    return {(r.src, r.ord): r.new_text for r in rows}


def test_text_below_a_forwarded_body_that_is_in_the_corpus(spark):
    body = f"Hello,\n\n{_words('old', 40)}\n\nCheers,\nAl"
    head = "-----Original Message-----\nFrom: Al [mailto:al@b.example]\nSubject: x\n\n"
    out = _run(spark, [(1, "Al <al@b.example>", body), (2, SENDER, f"Above.\n\n{head}{body}\n\nBelow it is new.\n\nBest,\nUlf"), (3, SENDER, f"Above.\n\n{head}{_words('unknown', 40)}\n\nNot known."), (4, SENDER, f"On 9 Sep 2003 Al wrote:\n\n{body}\n\nAnswer below.")])
    assert out[("mail", 2)] == "Above. Below it is new." and out[("mail", 3)] == "Above." and out[("mail", 4)] == "Answer below."


def test_all_holders_of_a_fingerprint_are_ancestors(spark):
    shared, a, b = _words("shared", 30), _words("a", 30), _words("b", 30)
    mail = [
        (1, "x@x.example", f"{_words('long', 60)} {shared} {_words('end', 60)}"),  # the first holder of the shared words is no ancestor
        (2, "y@x.example", f"{shared} Small rest."),
        (3, "z@x.example", f"New three.\n\n{shared} Small rest."),
        (4, "z@x.example", f"Early answer.\n\n{a}"),  # its ancestor arrives later
        (5, "y@x.example", a),
        (6, "x@x.example", f"Later answer now.\n\n{a}"),
        (7, "y@x.example", f"Both of them.\n\n{a}\n\nand\n\n{b}"),
        (8, "x@x.example", b),
    ]
    out = _run(spark, mail, [(1, [("q", f"In a thread.\n\n{b}")])])
    assert out[("mail", 3)] == "New three." and out[("mail", 4)] == "Early answer." and out[("mail", 6)] == "Later answer now."
    assert out[("mail", 7)] == "Both of them. and" and out[("thread", 1)] == "In a thread."
    assert out[("mail", 1)].startswith("long0") and out[("mail", 5)] == a and out[("mail", 8)] == b


def _brute(mail):
    """New texts by comparing every pair of messages word by word."""
    from lorespan.llm.quoted import BODY, NEW, sender_words, spans_of, without_spans, _kept_words

    parts = []
    for k, s, b in mail:
        _, _, ranges, words, tail, tail_at = _kept_words(b.split("\n"), sender_words(s), 0)
        new = [w for x, y in zip(ranges[::2], ranges[1::2]) for w in words[x:y]]
        parts.append((k, s, words, ranges, new, None if tail is None else "\n".join(b.split("\n")[tail:]), tail_at))
    out = {}
    for k, s, words, ranges, new, tail, at in parts:
        spans = []
        for o, _, other, _, theirs, _, _ in parts:
            if o != k:
                texts = [(other, BODY | NEW)] if len(theirs) == len(other) else [(other, BODY), (theirs, NEW)]
                for text, part in texts:
                    if text != new and len(text) != len(new) and text != words:
                        spans += spans_of(" ".join(words), " ".join(text), o > k, part)
        out["mail", k] = without_spans(" ".join(words), ranges, tail, at, sender_words(s), spans)
    return out


def test_the_index_finds_every_ancestor_that_brute_force_finds(spark):
    import random

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    mail = []
    for k in range(1, 121):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 24, 25, 31, 36, 60, 90])))
        body = own
        for old in rng.sample(mail, min(len(mail), rng.randint(0, 2))):
            words = old[2].split()
            a, z = (0, len(words)) if rng.random() < 0.5 else (len(words) // 12, len(words) - len(words) // 14)
            body += "\n\n" + " ".join(words[a:z])
        mail.append((k, f"p{k % 7}@x.example", body))
    found, want = _run(spark, mail), _brute(mail)
    marks = {("mail", k): " ".join(new_text(b, s).split()) for k, s, b in mail}
    assert found == want and sum(found[k] != marks[k] for k in marks) > 40


def test_a_template_that_a_third_of_the_messages_fill_in_makes_no_pairs(spark):
    from lorespan.llm.quoted import ancestor_index, messages_of, possible_ancestors, posted, segment

    form = _words("form", 70)
    mail = [(k, f"p{k}@x.example", f"Dear{k} {form} name{k}") for k in range(90)] + [(100 + k, "q@x.example", _words(f"free{k}x", 40)) for k in range(60)]
    mail.append((999, "r@x.example", f"Look at this.\n\nDear5 {form} name5"))
    df = messages_of(spark.createDataFrame([(k, s, b, 0, "z") for k, s, b in mail], MAIL), spark.createDataFrame([], THREADS))
    parts = segment(df)
    found = possible_ancestors(parts, ancestor_index(posted(parts))).collect()
    assert sum(len(r.found) for r in found) <= 2 * len(mail)
    out = _run(spark, mail)
    assert out["mail", 999] == "Look at this." and all(out["mail", k] == f"Dear{k} {form} name{k}" for k in range(90))


def test_texts_of_common_sentences_are_candidates_only_where_they_are_quoted(spark):
    import random

    from lorespan.llm.quoted import ancestor_index, messages_of, possible_ancestors, posted, segment

    rng = random.Random(3)
    pool = [" ".join(f"s{k}w{j}" for j in range(14)) for k in range(12)]
    mail = [(k, f"p{k % 7}@x.example", " ".join(rng.choice(pool) for _ in range(rng.choice([3, 4, 6, 9, 14])))) for k in range(1, 181)]
    for k in range(200, 230):  # of all lengths, so that each level of fingerprints has to find some
        words = mail[k - 200][2].split()
        mail.append((k, "q@x.example", f"New words {k}.\n\n{' '.join(words[len(words) // 14 :])}"))
    df = messages_of(spark.createDataFrame([(k, s, b, 0, "z") for k, s, b in mail], MAIL), spark.createDataFrame([], THREADS))
    parts = segment(df)
    found = possible_ancestors(parts, ancestor_index(posted(parts))).collect()
    out = _run(spark, mail)
    assert out == _brute(mail) and sum(out["mail", k] == f"New words {k}." for k in range(200, 230)) > 20
    assert sum(len(r.found) for r in found) <= 2 * len(mail)
