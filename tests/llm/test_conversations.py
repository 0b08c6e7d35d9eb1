from lorespan.llm.conversations import bare_subject, conversations, has_mark, named_ids
from pyspark.sql import functions as F

MAIL = "ord bigint, message_id string, ingested_at timestamp_ntz, sender string, subject string, timestamp string, body string, in_reply_to string, `references` string, filepath string, zone string, component string"
BOXES = "mailbox string, address string, zone string, date_order string"


def run(spark, rows):
    full = [(o, i, None, s, sub, t, b, irt, refs, "m/inbox/1", "clash", "clash") for o, i, s, sub, t, b, irt, refs in rows]
    out = conversations(spark.createDataFrame(full, MAIL), spark.createDataFrame([("m", "m@x", "UTC", "mdy")], BOXES))
    return [(r.conv_id, r.pos, r.message_id, r.role) for r in out.orderBy("conv_id", "pos").collect()]


def test_links_order_and_roles(spark):
    rows = [
        (1, "<A@x>", "Jo <jo@x>", "Plan", "2002-01-01T10:00:00Z", "b", None, None),
        (2, " b@X ", "ed@x", "Re: Plan", "2002-01-01T12:00:00+03:00", "b", 'Your message of "1 Jan" <a@x>', None),
        (3, "c@x", "JO@x", "Re: Plan", "2002-01-01T11:00:00Z", "b", "<gone@x>", "<a@x>\r\n\t<B@x> <lost@x>"),
        (4, "d@x", "al@x", "Antwort: RE[2]:  PLAN ", "2002-01-01T13:00:00Z", "b", "", " "),
        (5, "<a@x>", "jo@x", "Plan", "bad", "", None, None),  # a second delivery does not count
    ]
    want = [("a@x", 1, "b@x", "replier"), ("a@x", 2, "a@x", "opener"), ("a@x", 3, "c@x", "opener"), ("a@x", 4, "d@x", "replier")]
    assert run(spark, rows) == want


def test_what_is_left_out(spark):
    t = "2002-01-01T10:00:00Z"
    rows = [
        (1, "a@x", "jo@x", "s", t, "b", None, None), (2, "a2@x", "jo@x", "re: s", t, "b", "a@x", None),  # one sender
        (3, "b@x", "jo@x", "t", t, " \n", None, None), (4, "b2@x", "ed@x", "t", t, "b", "b@x", None),  # empty message
        (5, "c@x", "jo@x", "u", "no date", "b", None, None), (6, "c2@x", "ed@x", "u", t, "b", "c@x", None),  # no time
        (7, "d@x", "jo@x", "v", t, "b", "e@x", None), (8, "e@x", "ed@x", "v", t, "b", "d@x", None), (9, "f@x", "al@x", "v", t, "b", "d@x", None),  # circle and what hangs on it
        (10, "g@x", "jo@x", "w", t, "b", "gone@x", None), (11, "g2@x", "ed@x", "w", t, "b", "g@x", None),  # broken
        (12, "h@x", "jo@x", "Re: none", t, "b", None, None), (13, "h2@x", "ed@x", "x", t, "b", "h@x", None),  # no opener
        (14, "i@x", "jo@x", "y", t, "b", "i@x", None),  # answers itself
        (15, None, None, None, None, None, None, None),
        (16, "k@x", "jo@x", "New: z", t, "b", None, None), (17, "k2@x", "ed@x", "RV: new: Z", t, "b", None, None),  # kept
    ]
    assert run(spark, rows) == [("k@x", 1, "k@x", "opener"), ("k@x", 2, "k2@x", "replier")]
    assert run(spark, []) == []


def test_a_long_chain_in_one_conversation(spark):
    rows = [(k, f"{k}@x", f"p{k % 3}@x", "s" if not k else "Re: s", f"2002-01-01T00:00:{k:02d}Z", "b", f"{k - 1}@x" if k else None, None) for k in range(50)]
    assert [r[1] for r in run(spark, rows)] == list(range(1, 51))


def test_subjects_and_ids(spark):
    s = spark.createDataFrame([("RE: RE : Fwd:  A  b",), ("回复: A b",), ("New: A",), ("Regards",), (None,)], "s string")
    assert [tuple(r) for r in s.select(bare_subject(F.col("s")), has_mark(F.col("s"))).collect()] == [("a b", True), ("a b", True), ("new: a", False), ("regards", False), (None, False)]
    i = spark.createDataFrame([("<A@x> <b@x>",), ("a@x, b@x",), ("abc",), ("on Monday",), (None,)], "s string")
    assert [r[0] for r in i.select(named_ids(F.col("s"))).collect()] == [["a@x", "b@x"], ["a@x", "b@x"], ["abc"], [], []]


def test_only_a_quotation_links_two_messages(spark):
    t, text = "2002-01-01T10:00:00Z", " ".join(f"word{k}" for k in range(40))
    rows = [
        (1, "a@x", "jo@x", "Gas", t, f"Hello,\n\n{text}", None, None), (2, "b@x", "jo@x", "Gas", t, "Another message of this subject.", None, None),  # the subject alone fits two openers
        (3, "c@x", "ed@x", "Re: Gas", t, "Agreed.\n\n" + "\n".join(f"> {x}" for x in f"Hello,\n\n{text}".split("\n")), None, None),
        (4, "d@x", "al@x", "Re: Gas", t, "Nothing quoted.", None, None),
    ]
    full = [(o, i, None, s, sub, at, b, irt, refs, "m/inbox/1", "clash", "clash") for o, i, s, sub, at, b, irt, refs in rows]
    mail, boxes = spark.createDataFrame(full, MAIL), spark.createDataFrame([("m", "m@x", "UTC", "mdy")], BOXES)
    assert conversations(mail, boxes).count() == 0
    assert [(r.conv_id, r.message_id) for r in conversations(mail, boxes, quotes=True).orderBy("pos", "message_id").collect()] == [("a@x", "a@x"), ("a@x", "c@x")]
