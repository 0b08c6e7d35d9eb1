"""Personal items in free text: found, and replaced by typed placeholders.

Candidate spans of each kind get votes from labelers that look at their form
(regular expressions), at gazetteers (short forms of given names; given names
that many senders of the corpus bear; the names in the headers of
the same message) and at their context.  Only counts of patterns of votes and
shapes over the whole corpus come to the driver; their number is bounded by the
bits they have.  Expectation-maximisation estimates how reliable each group of
labelers is and how likely each combination of votes is an item; a logistic
classifier of votes and shape is trained on these likelihoods and decides every
span.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.names import GIVEN_NAMES, fold
from lorespan.session import stash

KINDS = ("email", "phone", "idnum", "street", "name")
#: Labelers by kind; those after the bar vote against.
LABELERS = {
    "email": "form spelled host | ".split("|"),
    "phone": "form plus call label line | figure digits".split("|"),
    "idnum": "form label near | figure".split("|"),
    "street": "form type unit place | lane".split("|"),
    "name": "given full title header before after greeting signoff | lower thing project".split("|"),
}
VOTES = {k: (pos.split(), neg.split()) for k, (pos, neg) in LABELERS.items()}
BIT = {k: {v: 1 << i for i, v in enumerate(pos + neg)} for k, (pos, neg) in VOTES.items()}
#: Labelers that exclude each other or vote for one reason stand in one group, whose outcome is the set of its votes: a group is
#: one witness.  Those that every candidate of a kind has (its form) are no witnesses.  With a question mark: abstaining says nothing.
GROUPS = {
    "email": ["spelled"],
    "phone": ["call label figure digits", "plus ?", "line ?"],
    "idnum": ["label near figure"],
    "street": ["unit place", "lane"],
    "name": ["given full", "header", "title before after greeting signoff", "lower thing project"],
}
#: Rounds of expectation-maximisation, weight of a group's overall rates in its estimates (in spans), steps of the classifier, least likelihood of an item.
EM_ROUNDS, SMOOTH, FIT_STEPS, THRESHOLD = 60, 2.0, 300, 0.5
#: Most that a span's shape adds to the votes, in logits.
MOST_SHAPE = 1.5
#: The start counts as so many spans of evidence; a corpus with more of them can overturn it.
START_SPANS = 40.0
#: Fields of a shape and their bits: kind of character on either side, words, kind of the first letter, capitals only, length.
SHAPE = {"left": 2, "right": 2, "words": 2, "first": 2, "capitals": 1, "length": 3}
#: A given name joins the gazetteer if this share of the different senders and authors has it, so there are at most the inverse of it; and so many at least.
MIN_NAME_SHARE, MIN_NAME_HOLDERS = 1e-4, 3

_FORMS = {n: full for full, short in GIVEN_NAMES.items() for n in [full, *short.split()]}
# Words that end or begin firms, places and things; words after which a person is named; titles; greetings.
_THING = r"(?:Energy|Partners|Supply|Resources|Services|Trading|Shipping|Storage|Capital|Legal|Gas|Power|Pipeline|Water|Engineering|Inc|Ltd|Corp|Co|GmbH|AG|S\.A|LLC|Group|Holdings|pump|stand|valve|well|station|Falls|Creek|hub|project|Project)\b|&\s+Sons\b"
_BEFORE_THING = r"(?:\b(?:[Pp]roject|[Pp]royecto|[Pp]rojekt|[Dd]ossier|[Kk]noten|[Ff]irma|société|factura de|works for|signed by|material of|and for)\s+$)"
_NAMING = frozenset("call ring page reach contact contact: phone ask tell cc cc: with badge de d'appeler appeler sie by from: to: von: an: de: schrieb attn attn: met".split())
_DATED = re.compile(r"(?i)(?:\d{1,2}:\d{2}(?:\s*[AP]M)?,\s+$|\d{4},\s+$|\d\s*年\d+月\d+日\s+$)")
_AFTER = r"(?i)^(?:['’]s\s+(?:number|fax|phone|address|mobile|line)|,?\s+(?:SSN|soc|passport|ID\b|NI\b|national|driver|ausweis|social)|\s+(?:gave|moved|wrote|writes|schrieb|escribió|a\s+écrit|さん|on\s+\d{1,2}/|@|(?:on|at|unter)\s+[(+\d])|\s+and\s+[A-Z]|\s*(?:\[mailto|<[^<>\s]*@|\x00)|/[A-Z]{2,4}/|\s*\||:\s*(?:\d|P\.?O|Calle|\x00)|,\s+(?:\+|\(?\d{3}))"
_TITLES = r"(?:Mr|Ms|Mrs|Miss|Dr|Prof|Mme|Mlle|Herr|Frau|Herrn|Sr|Sra|Srta|Dra|Señor|Señora|Monsieur|Madame|κ|κα|г-н|г-жа)"
_GREETING = r"(?:hi|hello|dear|hey|hallo|hola|bonjour|cher|chère|liebe|lieber|guten\s+tag|good\s+(?:morning|afternoon|evening)|buenos\s+días|moin|salut|estimad[oa])"
_BYE = r"(?:best|best\s+regards|regards|kind\s+regards|sincerely|cheers|thanks|thank\s+you|many\s+thanks|thx|br|mfg|mit\s+freundlichen\s+grüßen|viele\s+grüße|cordialement|bien\s+à\s+vous|un\s+abrazo|saludos|よろしくお願いいたします。?|此致敬礼)"

_GAP = r"(?:[ \t]+(?:\n[ \t>|]*)?|\n[ \t>|]*)"
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ'’\-]"
_LOCAL = re.compile(r"(?<![\w.+\-])[\w+\-](?:[\w.+\-]*)$")
_HOST = re.compile(r"[A-Za-z0-9](?:[\w\-]*\w)?(?:\.[A-Za-z0-9](?:[\w\-]*\w)?)+")
_SPELLED = re.compile(rf"\b[A-Za-z][\w\-]*(?:(?:\.|\s+[(\[]?dot[)\]]?\s+)[\w\-]+)*\s+[(\[]?at[)\]]?{_GAP}[a-z][\w\-]*(?:(?:\.|\s+[(\[]?dot[)\]]?\s+)[a-z][\w\-]*)*(?:\.|\s+[(\[]?dot[)\]]?\s+)(?:example|test|invalid|com|org|net|edu|gov|info|biz|eu|de|fr|es|it|uk|jp|cn|in|au|sg)\b", re.I)
_URL = re.compile(r"\b(?:https?|ftp)://[^\s>|]+|\bwww\.[^\s>|]+")
_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Square|Sq|Parkway|Pkwy|Highway|Hwy|Circle|Cir)"
_STREET = re.compile(
    rf"(?<![\w./\-])(?:\d{{1,5}}{_GAP}(?:[NSEW]\.?{_GAP})?(?:[A-ZÀ-Þ][\w'’\-]+{_GAP}){{1,3}}?{_TYPE}\b(?:\.(?=\s*,)|(?<=St)\.|(?<=Ave)\.|(?<=Rd)\.|(?<=Blvd)\.|(?<=Ln)\.)?"
    rf"|P\.?\s?O\.?{_GAP}Box{_GAP}\d+"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,{_GAP}(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai){_GAP}(?:de\s+(?:la\s+)?|du\s+|des\s+|d')?[A-ZÀ-Þ][\w'’\-]+"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Via|Viale|Piazza){_GAP}(?:de\s+(?:la\s+)?|del\s+)?[A-ZÀ-Þ][\w'’\-]+,?{_GAP}\d{{1,4}}"
    rf"|[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|gasse|allee|platz|weg){_GAP}\d{{1,4}}\s?[a-z]?(?![\w]))"
    rf"(?:,?{_GAP}(?:Apt|Suite|Ste|Unit|Floor|Fl|Room|Rm|No|Apartment)\.?{_GAP}[\w\-]+|,?{_GAP}#\s?\d+)?"
    rf"(?:,{_GAP}(?:(?:[A-ZÀ-Þ][\w'’\-]+{_GAP}){{0,2}}[A-ZÀ-Þ][\w'’\-]+,{_GAP}[A-Z]{{2}}(?:{_GAP}\d{{5}}(?:-\d{{4}})?)?\b|\d{{4,5}}{_GAP}(?:(?:Villa|Bad|Saint|San|Santa|Los|Las|La|Le|El|New){_GAP})?[A-ZÀ-Þ][\wäöüß'’\-]+))?"
)
_NUMBER = re.compile(r"(?<![\w.,/\-:@$€])(?:\+\d[\d ().\-/]{6,18}\d|\(\d{2,4}\)\s?\d[\d \-.]{4,11}\d|\d[\d \-./]{6,16}\d)(?![\w\-/:%]|[.,]\d)")
_PHONE = re.compile(r"\+1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}|\+\d{1,3}(?:[ .\-]\(?\d{1,5}\)?){2,5}|(?:1[ .\-])?\(?\d{3}\)?[ .\-/]\s?\d{3}[ .\-]\d{4}|\(0\d{2,4}\)\s?\d{3,4}[ \-]?\d{3,4}|0\d{2,4}/\d{4,7}(?:-\d{1,3})?|\d{10}")
_PLUS = re.compile(r"^(?:\+|\(0|0\d+/)")
_ID = re.compile(r"(?<![\w\-/])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{7,8}[A-Z]?|[A-Z]{1,2}\d{6,9}[A-Z]?)(?![\w\-])")
_ID_LABEL = re.compile(r"(?i)(?:\bSSN\b|soc(?:ial)?\.?\s+sec(?:urity)?\.?|passport|reisepass|passeport|pasaporte|\bID\s+card|\bidentity\s+card|ausweis\w*|national\s+insurance|\bNI\s+n|driver(?:'s|’s)?\s+licen[cs]e|führerschein|\bDNI\b|\bNIE\b|tax\s+id|carte\s+d'identité|n°\s+de\s+sécurité)[^.;!?]{0,45}$|(?i:\bsoc\.\s+sec\.\s+no\.\s*(?:[>|]\s?)*$|\b(?:passport|card|licence|license|insurance|number)\s+(?:no\.?|number)\s*:?\s*(?:[>|]\s?)*$)")
_FIGURE = re.compile(r"(?i)\b(?:deal|contract|meter|invoice|ticket|part\s+no\.?|volume|order|account|file|limit|route|notice|no\.|n°|nr\.|núm\.|route|case|ref\.?)\s+(?:[>|]\s?)*(?:X|#)?$")
_CALL = re.compile(r"(?i)(?:@|\b(?:on|at|unter|call|ring|page|dial|number\s+is|fax\s+is|appeler|au|al|to))\s*(?:[>|]\s?)*$")
_PHONE_LABEL = re.compile(r"(?i)(?:\b(?:tel|telephone|phone|ph|office|mobile|cell|fax|t|m|o|direct|pager|voice|contact:[^\n]{0,60},)\.?:?\s*$|\|\s*$)")
_LETTER_RUNS = re.compile(r"[a-z]{2,}")
_INITIALS = re.compile(rf"(?<![\w.])(?:[A-ZÀ-Þ]\.(?:{_GAP})?){{1,3}}[A-ZÀ-Þ][a-zà-ÿ'’]{_LETTERS}*")
_TITLE = re.compile(rf"(?<![\w.])(?:{_TITLES}\.?{_GAP})+((?:[A-ZÀ-Þ]\.\s?)*[A-ZÀ-Þ][a-zà-ÿ]{_LETTERS}*(?:\s[A-ZÀ-Þ]\.)*(?:\s[A-ZÀ-Þ][a-zà-ÿ][\w\-]+)?)")
_FRENCH_M = re.compile(rf"(?<![\w.])M\.{_GAP}((?:[A-ZÀ-Þ]\.\s?)*[A-ZÀ-Þ][a-zà-ÿ]{_LETTERS}*(?:\s[A-ZÀ-Þ][a-zà-ÿ][\w\-]+)?)(?=\s+(?:[>|]\s?)*(?:a|est|sera|reprend|demande|et)\b)")
_SURNAME_AFTER = re.compile(rf"(?:[ \t]|[ \t]*\n(?:[>|]+ ?)*)(?:[A-Z]\.[ \t])?[A-ZÀ-Þ][a-zà-ÿ]{_LETTERS}*")
_LOWER_AFTER = re.compile(r"[ \t][a-zà-ÿ]{4,}(?=,|['’]s\b|\s+(?:on|at|@|unter|gave|moved|and|au)\b|\s*@|[.:](?:\s|$)|\s*$)", re.M)
_UPPER_AFTER = re.compile(r"[ \t][A-ZÀ-Þ]{3,}(?![\w.])")
_SURNAME_BEFORE = re.compile(rf"(?<![\w.])([A-ZÀ-Þ][a-zà-ÿ]{_LETTERS}*),[ \t]$")
_AFTER_RE, _THING_RE, _PROJECT_RE = re.compile(_AFTER), re.compile(rf"^{_GAP}(?:{_THING})"), re.compile(_BEFORE_THING)
_SPOKE = re.compile(r"(?i)\bspoke\s+with\s.{1,60}\band\s+$")
_GREET_RE = re.compile(rf"(?i)^[\s>|]*(?:{_GREETING}\s+)?$")
_BYE_RE = re.compile(rf"(?i)^[\s>|]*(?:{_BYE}[,.!]?\s*|[-–—/~]\s*)?$")


def _span(found: list, kind: str, start: int, end: int, votes: int) -> None:
    found.append((start, end, kind, votes))


_SIDES = {"\n": 0, " ": 1, "\t": 1, "\xa0": 1} | dict.fromkeys(",;:.!?", 2)


def shape(text: str, s: int, e: int) -> int:
    """What a span looks like, packed as in SHAPE."""
    left, right, c = _SIDES.get(text[s - 1], 3) if s else 0, _SIDES.get(text[e], 3) if e < len(text) else 0, text[s]
    first = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
    return left | right << 2 | min(text.count(" ", s, e), 3) << 4 | first << 6 | text[s:e].isupper() << 8 | min((e - s).bit_length(), 7) << 9


def candidates(text: str, header: str | None = None, names: frozenset[str] = frozenset()) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, votes) of every candidate; spans of one text may touch but not overlap within a kind.

    ``names``: given names beside those with known short forms, in small letters without accents.
    """
    found: list[tuple[int, int, str, int]] = []
    work = text
    hits, hint = _scan(text, names)
    taken: list[tuple[int, int]] = []

    def mask(a: int, b: int) -> None:
        taken.append((a, b))

    if "@" in text:
        bit = BIT["email"]
        at = text.find("@")
        while at >= 0:
            local, host = _LOCAL.search(text, max(0, at - 64), at), _HOST.match(text, at + 1)
            if local and host:
                _span(found, "email", local.start(), host.end(), bit["form"] | bit["host"])
                mask(local.start(), host.end())
            at = text.find("@", at + 1)
    if "dot" in text or "(at)" in text or "[at]" in text or _AT_WORD.search(text):
        bit = BIT["email"]
        for m in _SPELLED.finditer(text):
            part = m.group()
            if "." in part.split("at")[0] or "dot" in part.lower() or "(at)" in part.lower():
                if not re.search(r"://", text[m.end() - 1 : m.end() + 3]) and not re.match(r"(?i)(?:are|is|figures|starts?|hub|station)\s", part):
                    _span(found, "email", m.start(), m.end(), bit["form"] | bit["spelled"] | bit["host"])
                    mask(m.start(), m.end())
    if "://" in text or "www." in text:
        for m in _URL.finditer(text):
            mask(m.start(), m.end())
    if taken:
        work = _blank(work, taken)
    if hint:
        bit, spans = BIT["street"], []
        for m in _STREET.finditer(work):
            s = m.group()
            v = bit["form"] | bit["type"]
            if re.search(r"Apt|Suite|Box|Unit", s):
                v |= bit["unit"]
            if "," in s and re.search(r"\d{4,5}", s):
                v |= bit["place"]
            if re.match(r"(?i)\s*,?\s*lane\s+\d", work[m.end() : m.end() + 10]) or re.search(r"\bRoute\s+$", work[max(0, m.start() - 8) : m.start()]):
                v |= bit["lane"]
            _span(found, "street", m.start(), m.end(), v)
            spans.append((m.start(), m.end()))
        if spans:
            work = _blank(work, spans)
    ids: list[tuple[int, int]] = []
    bit = BIT["idnum"]
    for m in _ID.finditer(work):
        left = _flat(work[max(0, m.start() - 60) : m.start()])
        v = bit["form"]
        if _ID_LABEL.search(left):
            v |= bit["label"] | bit["near"]
            ids.append((m.start(), m.end()))
        elif _FIGURE.search(left):
            v |= bit["figure"]
        _span(found, "idnum", m.start(), m.end(), v)
    if ids:
        work = _blank(work, ids)
    bit = BIT["phone"]
    for m in _NUMBER.finditer(work):
        s = m.group()
        p = _PHONE.fullmatch(s) or _PHONE.match(s)
        if not p:
            continue
        end = m.start() + p.end()
        if p.end() < len(s) and (s[p.end()] not in " /" or re.match(r"[ ]?\d", s[p.end() :]) and s[0] != "+"):
            continue
        raw = work[max(0, m.start() - 70) : m.start()]
        left = _flat(raw)
        v = bit["form"]
        if _PLUS.match(s):
            v |= bit["plus"]
        if _PHONE_LABEL.search(left):
            v |= bit["label"]
        elif _FIGURE.search(left) and not re.search(r"(?i)(?:number|fax|phone)\s+is\s+(?:[>|]\s?)*$", left):
            v |= bit["figure"]
        elif _CALL.search(left):
            v |= bit["call"]
        if not raw.rsplit("\n", 1)[-1].strip(" >|") and "\n" in raw and not work[end : end + 1].strip():
            v |= bit["line"]
        if p.group().isdigit() and not v & (bit["label"] | bit["call"] | bit["line"]):
            v |= bit["digits"]
        _span(found, "phone", m.start(), end, v)
    found += _names(work, header, hits, names)
    return found


def _flat(text: str) -> str:
    """Context with line breaks and quote marks as single blanks."""
    return _BREAK.sub(" ", text) if "\n" in text else text


_BREAK = re.compile(r"[ \t]*\n[\s>|]*")


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "\x00" * (b - a)]
            at = b
    return "".join([*out, text[at:]])


def _scan(text: str, names: frozenset[str]) -> tuple[list[tuple[int, int]], bool]:
    """Places of the gazetteer's names as whole words, and whether a word of street addresses occurs."""
    low = text.lower()
    if not low.isascii():
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        low = _ACCENTED.sub(lambda m: _PLAIN.get(m.group(), m.group()), low)
    hits, hint, n = [], False, len(low)
    for end, size in _gazetteer(names).iter(low):
        s, e = end - abs(size) + 1, end + 1
        if size < 0:
            hint = hint or size == -1 or not (end + 1 < n and low[end + 1].isalpha())
        elif not (s and low[s - 1].isalpha()) and not (e < n and low[e].isalpha()):
            hits.append((s, e))
    return hits, hint


@lru_cache(maxsize=4)
def _gazetteer(names: frozenset[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in _STREET_WORDS:
        automaton.add_word(word, -len(word) if word[0] == " " else -1)
        if word[0] == " ":
            automaton.add_word("\n" + word[1:], -len(word))
    for name in {*_FORMS, *names}:
        automaton.add_word(name, len(name))
    automaton.make_automaton()
    return automaton


#: Letters with one accent to the plain letter; the text keeps its length.
_PLAIN = {chr(c): fold(chr(c)) for c in range(0xC0, 0x250) if len(fold(chr(c))) == 1 and fold(chr(c)) != chr(c)}
_ACCENTED = re.compile("[\u00c0-\u024f]")
#: Words of street addresses; those that begin with a blank as whole words.
_STREET_WORDS = " street| st| avenue| ave| road| rd| boulevard| blvd| lane| ln| drive| dr| court| ct| place| pl| way| terrace| square| sq| parkway| pkwy| highway| hwy| circle| cir|box| rue| chemin| impasse| quai|calle|avenida|avda|plaza|paseo|via |viale|piazza|strasse|straße|str.|gasse|platz|allee|weg ".split("|")
_AT_WORD = re.compile(r"\.\w+ at(?: [a-z]|\n)", re.I)


def _names(work: str, header: str | None, found: list[tuple[int, int]], names: frozenset[str]) -> list[tuple[int, int, str, int]]:
    bit = BIT["name"]
    hits = [x for x in found if work[x[0]] != "\x00"]
    spans: list[tuple[int, int, int]] = []
    last = 0
    for s, e in sorted(hits):
        if s < last:
            continue
        s, e, v = _extend(work, s, e, last, names)
        spans.append((s, e, v))
        last = e
    starts = [x[0] for x in spans]

    def over(a: int, z: int) -> int | None:
        k = bisect.bisect_left(starts, z) - 1
        return k if k >= 0 and spans[k][1] > a else None

    extra: list[tuple[int, int, int]] = []
    for m in _INITIALS.finditer(work):
        word = m.group().split(".")[-1].strip()
        if word not in ("Box", "Straße") and not _STOP.match(word) and over(m.start(), m.end()) is None:
            extra.append((m.start(), m.end() - (2 if m.group().endswith(("'s", "’s")) else 0), bit["full"]))
    spans = sorted(spans + extra)
    starts = [x[0] for x in spans]
    titled: list[tuple[int, int, int]] = []
    for pattern, told in ((_TITLE, any(t in work for t in _TITLE_WORDS)), (_FRENCH_M, "M." in work)):
        for m in pattern.finditer(work) if told else ():
            s, e = m.span(1)
            if work[s:e] in _TITLE_WORDS:
                continue
            if work[s:e].endswith(("'s", "’s")):
                e -= 2
            v = bit["title"] | bit["full"]
            if (k := over(s, e)) is not None:
                a, z, old = spans[k]
                s, e, v = (s if pattern is _FRENCH_M or a >= s else a), max(e, z), v | old
                spans[k] = (a, z, -1)
            titled.append((s, e, v))
    spans = sorted((a, z, v) for a, z, v in [*spans, *titled] if v >= 0)
    starts = [x[0] for x in spans]
    headed = [(a, z, bit["full"] if full else 0) for a, z, full in _headed(work, header) if over(a, z) is None]
    lone = {(a, z) for a, z, v in headed if not v}
    spans = sorted({(a, z): v for a, z, v in [*spans, *headed]}.items())
    known = set(_LETTER_RUNS.findall(fold(header).lower())) if header and spans else set()
    out = []
    for (s, e), v in spans:
        begin = work.rfind("\n", 0, s) + 1
        end = work.find("\n", e)
        end = len(work) if end < 0 else end
        # Only short rests of a line can make it a greeting or a sign-off.
        before = work[begin:s] if s - begin < 50 else "." * 50
        behind = work[e:end] if end - e < 50 else work[e : e + 50].lstrip()[:1] + "."
        near = _flat(work[max(0, s - 90) : s])
        close = near[-24:]
        if known and not known.isdisjoint(_LETTER_RUNS.findall(fold(work[s:e]).lower())):
            v |= bit["header"]
        word = close.rsplit(None, 1)[-1].lower() if close[-1:].isspace() and close.strip() else ""
        if word in _NAMING or word[-1:] in ",日" and _DATED.search(close) or (word == "and" and _SPOKE.search(near)):
            v |= bit["before"]
        if _AFTER_RE.match(work[e : e + 40]):
            v |= bit["after"]
        if len(before) < 40 and _GREET_RE.match(before) and re.match(r"\s*(?:,|:|-|–|!)?\s*$", behind) and (before.strip(" >|") or behind.strip()):
            v |= bit["greeting"]
        if len(before) < 50 and _BYE_RE.match(before) and (not behind.strip() or behind.lstrip().startswith("|")):
            v |= bit["signoff"]
        if (s, e) in lone and not v & (bit["before"] | bit["after"] | bit["greeting"] | bit["signoff"]):
            continue  # firms and projects bear surnames, too
        if work[s:e].islower() and not v & (bit["before"] | bit["after"] | bit["greeting"] | bit["signoff"]):
            v = (v | bit["lower"]) & ~bit["full"]  # two words in small letters are no sign of a name
        if _THING_RE.match(work[e : e + 40]):
            v |= bit["thing"]
        if _PROJECT_RE.search(close):
            v |= bit["project"]
        out.append((s, e, "name", v))
    return out


_ADDRESS = re.compile(r"<[^<>]*>|\S+@\S+")
_HEADER_WORD = re.compile(rf"(?<![\w.]){_LETTERS}{{2,}}(?![\w])")
_BETWEEN = re.compile(r"(?:,?[ \t]+|[ \t]+[A-ZÀ-Þ]\.[ \t]+)$")


def _headed(work: str, header: str | None) -> list[tuple[int, int, bool]]:
    """Places of names of sender and recipients that no list of given names holds, and whether they have several words."""
    words = {w for w in _HEADER_WORD.findall(_ADDRESS.sub(" ", header or "")) if w[0].isupper() and not _STOP.match(w) and not _POLITE.match(w)}
    words = {x for w in words for x in ({w, w.capitalize()} if w.isupper() else {w}) if x in work}
    if not words:
        return []
    out: list[tuple[int, int, bool]] = []
    for m in re.finditer(rf"(?<![\w.@\-])(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?![\w@]|-\w)", work):
        if out and _BETWEEN.match(work[out[-1][1] : m.start()]):
            out[-1] = (out[-1][0], m.end(), True)
        else:
            out.append((m.start(), m.end(), False))
    return out


def _extend(work: str, s: int, e: int, last: int, names: frozenset[str]) -> tuple[int, int, int]:
    """Span and first votes of the name around a given name at ``s``: initials, surname behind or before it."""
    bit, g = BIT["name"], work[s:e]
    v = bit["given"] if g[0].isupper() else 0
    if work[s - 2 : s - 1] == "." and (lead := re.search(r"(?:(?<![\w.])[A-ZÀ-Þ]\.\s?)+$", work[max(last, s - 9) : s])):
        s = max(last, s - 9) + lead.start()
    if g.isupper() and len(g) > 2:
        after = _UPPER_AFTER.match(work, e)
    elif g[0].isupper():
        after = _SURNAME_AFTER.match(work, e)
        if after:
            word = after.group().split()[-1]
            narrow = "\n" in after.group() and e - work.rfind("\n", 0, e) < 45
            if narrow or _STOP.match(word) or ((low := fold(word).lower()) in _FORMS or low in names) and "." not in after.group():
                after = None
    else:
        after = _LOWER_AFTER.match(work, e)
        if after and after.group().strip() in _LOWER_STOP:
            after = None
    if after:
        return s, e + len(re.sub(r"['’]s$", "", after.group())), v | bit["full"]
    if g[0].isupper() and work[s - 2 : s] == ", " and (b := _SURNAME_BEFORE.search(work, max(last, s - 40), s)):
        if (low := fold(b[1]).lower()) not in _FORMS and low not in names and not _STOP.match(b[1]) and not _POLITE.match(b[1]):
            return b.start(), e, v | bit["full"]
    return s, e, v


_TITLE_WORDS = frozenset(_TITLES[3:-1].split("|"))
_POLITE = re.compile(rf"(?i)(?:{_GREETING}|{_BYE})$")
_STOP = re.compile(rf"(?:{_THING}|(?:The|Please|Write|Call|Use|Copy|Page|Ring|What|Did|Nobody|Original|Subject|From|Sent|Date|To|Cc|Box|Desk|Manager|Lead|Officer|Counsel|Engineer|Analyst|Director|Specialist|Administrator|Regulatory|Credit|Plant|Senior|Scheduling|Contract|Settlement|Risk)$)")
_LOWER_STOP = frozenset("will would could should shall have that this with from into over there their them they when what which where while after before about again gave moved wrote writes said asked says number".split())


def likelihoods(kind: str, counts: dict[int, float]) -> dict[int, float]:
    """Likelihood of an item for each combination of votes of one kind, by expectation-maximisation.

    Each group of labelers is a witness with as many outcomes as combinations of its votes, abstaining included; how
    often items and other spans have each outcome is estimated in turn with how likely each combination is an item.  Only
    the start is given: votes for count once, votes against twice.  It weighs as much as START_SPANS spans.
    """
    bit, (pos, neg) = BIT[kind], VOTES[kind]
    votes, n = np.array(sorted(counts)), np.array([counts[v] for v in sorted(counts)], float)
    groups = [(sum(bit[x] for x in g.split() if x != "?"), "?" in g) for g in GROUPS[kind]]
    outcomes = [(np.unique(votes & mask, return_inverse=True)[1], votes & mask > 0 if silent else np.ones(len(n), bool)) for mask, silent in groups]
    outcomes = [(o, speaks) for o, speaks in outcomes if o.max()]
    balance = np.array([sum(v & bit[x] > 0 for x in pos if x != "form") - 2 * sum(v & bit[x] > 0 for x in neg) for v in votes], float)
    q = start = 1 / (1 + np.exp(-(2 * balance + 1)))
    believed = [n * s / n.sum() * START_SPANS for s in (start, 1 - start)]
    for _ in range(EM_ROUNDS):
        yes, no = n * q + believed[0], n * (1 - q) + believed[1]
        score = np.full(len(n), np.log((yes.sum() + 1) / (no.sum() + 1)))
        for o, speaks in outcomes:
            overall = np.bincount(o, n) / n.sum()
            p1, p0 = ((np.bincount(o, w) + SMOOTH * overall) / (w.sum() + SMOOTH) for w in (yes, no))
            score += np.where(speaks, np.log(p1 / p0)[o], 0)
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(votes.tolist(), q.tolist()))


def _fields(packed: np.ndarray) -> np.ndarray:
    """One column per value of each field of a shape."""
    out, at = [], 0
    for bits in SHAPE.values():
        value = packed >> at & (1 << bits) - 1
        out.append(value[:, None] == np.arange(1 << bits))
        at += bits
    return np.hstack(out).astype(float)


def learn(patterns: list[tuple[str, int, int, int]]) -> dict[tuple[str, int, int], float]:
    """Probability of an item for each (kind, votes, shape), from the counts of these patterns.

    The span classifier is a logistic regression on the fields of the shape, trained on the likelihoods that
    expectation-maximisation gives the votes, where these are sure.  It adds what the shape says to what the votes say,
    by MOST_SHAPE at most in logits: it decides where the votes leave an item open.
    """
    out: dict[tuple[str, int, int], float] = {}
    for kind in KINDS:
        rows = [(v, s, n) for k, v, s, n in patterns if k == kind]
        if not rows:
            continue
        counts: dict[int, float] = {}
        for v, _, n in rows:
            counts[v] = counts.get(v, 0) + n
        known = likelihoods(kind, counts)
        votes, shapes, n = (np.array(c) for c in zip(*rows))
        q = np.clip(np.array([known[v] for v in votes.tolist()]), 1e-6, 1 - 1e-6)
        z = np.column_stack([np.ones(len(rows)), _fields(shapes)])
        weight = n * (2 * q - 1) ** 2
        weight = weight / max(weight.sum(), 1e-9)
        b = np.zeros(z.shape[1])
        for _ in range(FIT_STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            gradient = z.T @ (weight * (p - q)) + 1e-3 * b
            curvature = (z * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ z + 1e-3 * np.eye(len(b))
            step = np.linalg.solve(curvature, gradient)
            b -= step
            if np.abs(step).max() < 1e-6:
                break
        base = np.clip((weight * q).sum() if weight.sum() else 0.5, 1e-3, 1 - 1e-3)
        seen = np.clip(z @ b - np.log(base / (1 - base)), -MOST_SHAPE, MOST_SHAPE)
        fitted = 1 / (1 + np.exp(-(np.log(q / (1 - q)) + seen)))
        out |= {(kind, v, s): float(p) for (v, s, _), p in zip(rows, fitted)}
    return out


def corpus_texts(mail: DataFrame, claims: DataFrame) -> DataFrame:
    """(src, ord, pos, header, text) of all mail bodies and evidence quotes that are not empty."""
    names = F.concat_ws(" ", "sender", F.array_join(F.coalesce("to", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("cc", F.array().cast("array<string>")), " "))
    m = mail.select(F.lit("mail").alias("src"), F.col("ord").cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("pos"), names.alias("header"), F.col("body").alias("text"))
    e = claims.select(F.col("ord").cast("bigint").alias("ord"), F.posexplode("evidence").alias("pos", "e"))
    e = e.select(F.lit("evidence").alias("src"), "ord", F.col("pos").cast("bigint").alias("pos"), F.col("e.author").alias("header"), F.col("e.exact_quote").alias("text"))
    return m.union(e).where("text is not null and text != ''")


def given_names(mail: DataFrame, claims: DataFrame) -> list[str]:
    """Given names that a share of the different senders and authors has (as written, or in first.last@), in small letters without accents."""
    rows = mail.select(F.col("sender").alias("name")).union(claims.select(F.explode("evidence.author").alias("name"))).distinct()
    shown = F.trim(F.regexp_replace("name", r"<[^>]*>|\S+@\S+|\"", " "))
    written = F.regexp_extract(shown, r"^(?:[^,]+,\s*)?(?:" + _TITLES + r"\.?\s+)?(\p{Lu}\p{Ll}{2,})(?=\s+(?:\p{Lu}\.?\s+)*\p{Lu}\p{Ll}|$)", 1)
    written = F.when(F.regexp_like(shown, F.lit(r"\S[\s,]+\S")), written)
    address = F.initcap(F.regexp_extract(F.lower("name"), r"(?:^|[<\s])(\p{L}{3,})[._](?:\p{L}+[._])*\p{L}{3,}@", 1))
    found = rows.select(F.explode(F.array_distinct(F.array(written, address))).alias("given")).where("given != ''").groupBy("given").count()
    total = found.agg(F.sum("count")).first()[0] or 0
    kept = found.where(F.col("count") >= max(MIN_NAME_HOLDERS, MIN_NAME_SHARE * total)).collect()
    return sorted({fold(r.given).lower() for r in kept if not _STOP.match(r.given) and not _POLITE.match(r.given)})


SPAN = "struct<kind: string, votes: int, shape: int, start: int, found: string>"


def labelled_texts(mail: DataFrame, claims: DataFrame, keep_text: bool = False) -> DataFrame:
    """(src, ord, pos, text, spans) of all texts with their candidates; ``text`` only if asked for."""
    names = frozenset(given_names(mail, claims))

    fields = [("kind", pa.string()), ("votes", pa.int32()), ("shape", pa.int32()), ("start", pa.int32()), ("found", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[list, ...] = ([], [], [], [], [])
            kinds, votes, shapes, starts, texts = found
            ends = [0]
            for h, t in zip(b["header"].to_pylist(), b["text"].to_pylist()):
                for s, e, k, v in candidates(t, h, names):
                    kinds.append(k)
                    votes.append(v)
                    shapes.append(shape(t, s, e))
                    starts.append(s)
                    texts.append(t[s:e])
                ends.append(len(kinds))
            spans = pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(found, fields)], [name for name, _ in fields])
            text = b["text"] if keep_text else pa.nulls(len(b), pa.string())
            yield pa.RecordBatch.from_arrays([b["src"], b["ord"], b["pos"], text, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["src", "ord", "pos", "text", "spans"])

    return corpus_texts(mail, claims).mapInArrow(run, f"src string, ord bigint, pos bigint, text string, spans array<{SPAN}>")


def accepted_patterns(labelled: DataFrame) -> list[tuple[str, int, int]]:
    """The (kind, votes, shape) that the classifier takes for items."""
    counted = labelled.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes", "x.shape").count().collect()
    return [k for k, p in sorted(learn(sorted((r.kind, r.votes, r["shape"], r["count"]) for r in counted)).items()) if p >= THRESHOLD]


def personal_items(mail: DataFrame, claims: DataFrame) -> DataFrame:
    """(src, ord, pos, kind, start_at, found_text) of every personal item.

    Null and empty texts have none; null senders and lists only mean that no
    name is known from the header; whole texts of any length are read, repeated
    rows each give their items, and other columns are not read.
    """
    labelled = stash(labelled_texts(mail, claims).drop("text"), "spans")
    accepted = labelled.sparkSession.createDataFrame(accepted_patterns(labelled) or [("", 0, 0)], "kind string, votes int, shape int")
    spans = labelled.select("src", "ord", "pos", F.explode("spans").alias("x")).select("src", "ord", "pos", "x.kind", "x.votes", "x.shape", F.col("x.start").alias("start_at"), F.col("x.found").alias("found_text"))
    return spans.join(F.broadcast(accepted), ["kind", "votes", "shape"]).select("src", "ord", "pos", "kind", "start_at", "found_text")


def redact(mail: DataFrame, claims: DataFrame) -> DataFrame:
    """(src, ord, pos, clean_text): the texts with each personal item replaced by ``[KIND]``; every text is scanned once."""
    labelled = stash(labelled_texts(mail, claims, keep_text=True), "labelled")
    accepted = frozenset(accepted_patterns(labelled))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clean = []
            for t, spans in zip(b["text"], b["spans"]):
                out, at = [], 0
                for s, k, found in sorted((x["start"], x["kind"], x["found"]) for x in spans if (x["kind"], x["votes"], x["shape"]) in accepted):
                    if s >= at:
                        out += [t[at:s], f"[{k.upper()}]"]
                        at = s + len(found)
                clean.append("".join([*out, t[at:]]))
            yield pd.DataFrame({"src": b["src"], "ord": b["ord"], "pos": b["pos"], "clean_text": clean})

    return labelled.mapInPandas(run, "src string, ord bigint, pos bigint, clean_text string")
