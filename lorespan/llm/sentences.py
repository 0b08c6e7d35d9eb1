"""Sentence boundaries across languages and scripts.

Every character is tagged boundary or inside by a linear-chain model whose
weights are fitted to the corpus, and decoded with Viterbi.  Characters that no
sentence can end at are inside by constraint, so the chain is kept as its other
characters and the distances between them.  Emissions rest on counts over the
whole corpus at paragraph ends and starts, where boundaries are certain: how
often a word or number before a full stop ends a paragraph (abbreviations hardly
ever do), how often the next word begins one.  Transitions rest on the distance
between two such characters: a sentence of three letters is rare after another
one.  The weights maximise the likelihood of what is known of a sample of
paragraphs that were joined: the joints are boundaries, a stop behind a word that
stands before many stops and never at a paragraph's end is none, all other tags
are summed over.  For scripts without sentence
marks the same model tags spaces; its counts and its joined paragraphs are
stripped of punctuation.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import stash

#: Most counts that go to all tasks, the most frequent ones; the others are joined to the texts that need them.
MOST_COUNTS = 200_000
#: Smoothing of the ratios, and letters of context in scripts without marks.
SMOOTH, LETTERS = 1.0, 4
#: Documents whose joined paragraphs fit the weights, most paragraphs of one joint, most tags of one sequence, steps and pace of the fit.
SAMPLE, JOINED, MOST_TAGS, STEPS, PACE = 3000, 3, 32, 80, 0.15
#: Chance of error at which a word is taken for one that no sentence ends with.
SURE = 1e-3
#: Distances between two tags are told apart by their number of bits up to this one.
BITS = 8
#: Where the fit starts and what it is drawn to (with variance 1), by kind of character.
PRIOR = {
    "stop": {"always": 2.0, "ends": 1.0, "goes_on": -1.0, "starts": 1.0, "upper": 1.0, "lower": -3.0, "name": 4.0},
    "strong": {"always": 9.0, "upper": 0.0, "lower": 0.0},
    "quoted": {"always": 1.0, "starts": 1.0, "upper": 3.0, "lower": -9.0},
    "dots": {"always": -2.0, "starts": 1.0, "upper": 2.0, "lower": -6.0},
    "space": {"always": -1.0, "left": 1.0, "right": 1.0},
}
KINDS = list(PRIOR)
_PLACE = {kind: sum(len(PRIOR[k]) for k in KINDS[:i]) for i, kind in enumerate(KINDS)}
_EMISSIONS = sum(map(len, PRIOR.values()))
#: Scores that a worker keeps; the results are the same without it.
MOST_SCORES = 200_000
#: Cost of a boundary right behind another at the start of the fit.
AGAIN = -2.0

# Marks that end sentences, scripts written without them, and pairs of quotes and brackets.
_UNMARKED = "฀-໿ༀ-࿿က-႟ក-៿"
_MARKS = ".!?…。！？｡।॥؟۔።។።։"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "“": "”", "„": "“", "‹": "›", "‚": "‘"}
_CLOSERS = ")]}）］」』》〉】»”›’"
_OPENERS = "\"'([{（［「『《〈【«“„‹¿¡‘"

_END = re.compile(rf"[{re.escape(_MARKS)}]+(?:[ \u00a0\u202f][!?]+)?|(?<=[Ͱ-Ͽἀ-῿0-9]);")
_BLANK = re.compile(r"\r?\n[ \t\r\f\v 　]*(?:\r?\n[ \t\r\f\v 　]*)+")
_ITEM = re.compile(r"[ \t]*(?:([-*•–—·▪◦‣])|\(?(\d{1,3}|[a-zA-Z])[.)、])[ \t]+(?=\S)")
_GAP = re.compile(rf"(?<=[{_UNMARKED}0-9A-Za-z)%])[  ]+(?:\n[ \t]*)?(?=[{_UNMARKED}0-9A-Za-z(])|(?<=[{_UNMARKED}])\n[ \t]*(?=[{_UNMARKED}])")
_HAS_UNMARKED = re.compile(rf"[{_UNMARKED}]")
_LAST_WORD = re.compile(r"[^\s\"'“”«»„()\[\]（）「」,;:—–-]{1,24}$")
_NEXT_WORD = re.compile(r"[\"'“«„(\[（「¿¡‘]*[^\s\"'“”«»„()\[\]（）「」,.;:!?。！？।，、]{1,24}")
_AFTER_WIDE = re.compile(r"[^\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]+$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")


def before_word(text: str, at: int) -> str:
    """The word before a mark at ``at``: with inner stops, figures as #, initials as @."""
    m = _LAST_WORD.search(text, max(0, at - 25), at)
    if not m:
        return ""
    w = m.group()
    if not _CJK.match(w[-1]):  # a word of another script stands right before it
        w = _AFTER_WIDE.search(w).group()
    if len(w) == 1 and w.isupper():
        return "@"
    return "#" if w[0].isdigit() and not w[-1].isalpha() else w[-2:] if _CJK.match(w[-1]) else _composed(w)


def _composed(word: str) -> str:
    """The word with composed accents, so that its counts are one."""
    return word if word.isascii() else unicodedata.normalize("NFC", word)


def next_word(text: str, at: int, stop: int | None = None) -> str:
    """The word behind ``at``, with an opening quote before it; two letters in scripts without spaces."""
    m = _NEXT_WORD.match(text, at, stop if stop is not None else len(text))
    if not m:
        return text[at : at + 1]
    w = m.group()
    bare = w.lstrip(_OPENERS)
    if bare[:1].isdigit():
        return w[: len(w) - len(bare)] + "#"
    return w[: len(w) - len(bare)] + bare[:2] if _CJK.match(bare[:1]) else _composed(w)


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): paragraphs between blank lines, and list items, which are whole units."""
    out, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        out += _items(text, at, end)
        at = m.end() if m else end
    return out


def _follows(a: str, b: str) -> bool:
    """True if item mark ``b`` comes right after ``a``."""
    return int(b) == int(a) + 1 if a.isdigit() and b.isdigit() else len(a) == len(b) == 1 and ord(b) == ord(a) + 1


def _items(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    first = _ITEM.match(text, start, end)
    if not first:
        return [(start, end, False)] if text[start:end].strip() else []
    marks, last, line = [start], first[2], text.find("\n", start, end)
    while line >= 0:
        m = _ITEM.match(text, line + 1, end)
        if m and (m[1] == first[1] if first[1] else m[2] and _follows(last, m[2])):
            marks.append(line + 1)
            last = m[2]
        line = text.find("\n", line + 1, end)
    if first[2] and (not first[2].isdigit() and (len(marks) == 1 or first[2] not in "aA") or first[2].isdigit() and len(marks) == 1 and first[2] != "1"):
        return [(start, end, False)]  # an initial, or a figure that a line break brought to the front
    return [(a, b, True) for a, b in zip(marks, [*marks[1:], end])]


def enclosed(text: str, start: int, end: int) -> tuple[list[int], list[int], set[int]]:
    """Starts and ends of the stretches inside quotes or brackets that are closed within the block, and all closing places."""
    part = text[start:end]
    spans: list[tuple[int, int]] = []
    if not any(c in part for c in _PAIRS) and '"' not in part:
        return [], [], set()
    open_: list[tuple[str, int]] = []
    straight = -1
    for k, c in enumerate(part):
        if open_ and c == open_[-1][0]:
            spans.append((open_.pop()[1], k))
        elif c in _PAIRS:
            open_.append((_PAIRS[c], k))
        elif c == '"':
            if straight >= 0:
                spans.append((straight, k))
                straight = -1
            else:
                straight = k
    spans.sort()
    flat: list[tuple[int, int]] = []
    for a, b in spans:
        if flat and a <= flat[-1][1]:
            flat[-1] = (flat[-1][0], max(flat[-1][1], b))
        else:
            flat.append((a, b))
    return [start + a for a, _ in flat], [start + b for _, b in flat], {start + b for _, b in spans}


#: Counts of each table: words before stops (in how many paragraphs, at their ends, before small letters), words (as the first, anywhere), letters in unmarked scripts (at the end, at the start, anywhere).
TABLES = {"stop": "wel", "word": "sa", "letters": "LRA"}
_TABLE = {c: (t, k) for t, codes in TABLES.items() for k, c in enumerate(codes)}


def stripped(text: str) -> str:
    """Text of an unmarked script without marks, quotes and brackets."""
    return _PUNCTUATION.sub("", text).strip()


_PUNCTUATION = re.compile(rf"[{re.escape(_MARKS + _CLOSERS + _OPENERS)}]")


def count_block(text: str, start: int, end: int, counts: Counter) -> None:
    """Counts of one paragraph but for its words: words before stops and at the end, the first word, letters in unmarked scripts."""
    part = text[start:end].rstrip()
    end = start + len(part)
    start += len(part) - len(part.lstrip())
    if start >= end:
        return
    if _HAS_UNMARKED.search(text, start, end):
        line = stripped(text[start:end])
        if line and _HAS_UNMARKED.match(line[-1]) and _HAS_UNMARKED.match(line[0]):
            counts["L", line[-LETTERS:]] += 1
            counts["R", line[:LETTERS]] += 1
            counts.update(("A", line[k : k + LETTERS]) for k in range(len(line) - LETTERS + 1))
    counts["s", next_word(text, start, end)] += 1
    last, stops = None, set()  # a text that repeats itself counts once
    for m in _END.finditer(text, start, end):
        if text[m.start()] == ".":
            word = before_word(text, m.start())
            stops.add(("w", word))
            last, last_word = m, word
            behind = m.end()
            while behind < end and text[behind].isspace():
                behind += 1
            if m.end() < behind < end and text[behind].islower():
                stops.add(("l", word))
        behind = m.end()
        while behind < end and text[behind] in _AFTER_MARK:
            behind += 1
        if behind < end and not text[behind].isspace():
            counts["a", next_word(text, behind, end)] += 1
    if last is not None and not text[last.end() : end].strip(_AFTER_MARK):
        stops.add(("e", last_word))
    counts.update(stops)


_AFTER_MARK = _CLOSERS + '"“'


def candidates(text: str, start: int, end: int) -> list[tuple[int, int, str, int, str, str]]:
    """(end of the possible sentence, start of the next one, kind, case of the next letter, context before, behind)."""
    opens, closes, shut = enclosed(text, start, end)
    out: list[tuple[int, int, str, int, str, str]] = []
    for m in _END.finditer(text, start, end):
        at, behind = m.span()
        while behind < end and (text[behind] in _CLOSERS or behind in shut):
            behind += 1
        inside = False
        if opens:
            k = bisect.bisect_right(opens, at) - 1
            inside = k >= 0 and closes[k] >= at
            if inside and closes[k] >= behind:
                continue
        nxt = behind
        while nxt < end and text[nxt].isspace():
            nxt += 1
        if nxt >= end:
            continue
        mark, c = m.group().strip(), text[nxt]
        if nxt == behind:
            wide = mark[-1:] in "。！？｡।॥؟۔…" or _CJK.match(c)
            if not (wide and mark.strip(".") or mark[-1:] in "!?" and _CJK.match(c)):
                continue
        if c in ",;:，、；)]）」）»”—–-" or c in "!?" and nxt > behind:
            continue
        plain = mark in (".", "..") and not inside
        kind = "quoted" if inside else "stop" if plain else "dots" if set(mark) <= {".", "…"} else "strong"
        word = next_word(text, nxt, end)
        bare = word.lstrip(_OPENERS)[:1]
        case = 1 if bare.isupper() or c in "¿¡" else -1 if bare.islower() else 0
        out.append((behind, nxt, kind, case, before_word(text, at) if plain else "", word))
    if _HAS_UNMARKED.search(text, start, end):
        for m in _GAP.finditer(text, start, end):
            a, b = m.span()
            k = bisect.bisect_right(opens, a) - 1
            if k >= 0 and closes[k] >= a:
                continue
            if not _HAS_UNMARKED.match(text[a - 1]) or not _HAS_UNMARKED.match(text[b]):
                if not (_HAS_UNMARKED.match(text[a - 1]) and text[b].isalpha()) and not (_HAS_UNMARKED.match(text[b]) and text[a - 1].isalpha()):
                    continue
            out.append((a, b, "space", 0, text[max(start, a - LETTERS) : a], text[b : b + LETTERS]))
        out.sort()
    return out


def keys_of(kind: str, left: str, right: str) -> list[tuple[str, str]]:
    """(table, key) of the counts that a character's emission rests on."""
    if kind == "stop":
        return [("stop", left), ("word", right)]
    return [("letters", left), ("letters", right)] if kind == "space" else [] if kind == "strong" else [("word", right)]


class Model:
    """Emissions from the counts of the corpus, and weights of emissions and transitions."""

    def __init__(self, frequent: dict[tuple[str, str], tuple], total: dict[str, list[int]], weights: np.ndarray | None = None) -> None:
        self.frequent, self.weights = frequent, prior_weights() if weights is None else weights
        self.emitted, self.steps = self.weights[:_EMISSIONS].tolist(), self.weights[_EMISSIONS:].tolist()
        self.scores: dict[tuple, float] = {}  # what was computed before
        w, e, l = total.get("stop", (0, 0, 0))
        s, a = total.get("word", (0, 0))[:2]
        self.end_rate, self.lower_rate, self.start_rate = max(e, 1) / max(w, 1), max(l, 1) / max(w, 1), max(s, 1) / max(a, 1)
        self.ends, self.starts, self.any = (max(x, 1) for x in total.get("letters", (0, 0, 0)))

    def emission(self, kind: str, case: int, left: str, right: str, rare: dict[tuple[str, str], tuple], joint: bool = False) -> list[float]:
        """Values of the kind's fields; ``joint``: without the counts that this place itself added as a paragraph's end and start."""
        own = int(joint)
        get = lambda table, key: self.frequent.get((table, key)) or rare.get((table, key)) or (0, 0, 0)
        upper, lower = float(case > 0), float(case < 0)
        if kind == "strong":
            return [1.0, upper, lower]
        if kind == "space":
            side = lambda n, all_, total: math.log((n + 0.02) / total) - math.log((all_ + 1) / self.any)
            (ends, _, a), (_, starts, b) = get("letters", left), get("letters", right)
            return [1.0, side(max(ends - own, 0), max(a - own, 0), self.ends), side(max(starts - own, 0), max(b - own, 0), self.starts)]
        first, all_, _ = get("word", right)
        first, all_ = max(first - own, 0), max(all_ - own, 0)
        starts = math.log((first + SMOOTH * self.start_rate) / ((max(first, all_) + SMOOTH) * self.start_rate))
        if kind != "stop":
            return [1.0, max(-8.0, min(2.0, starts)), upper, lower]
        all_, ends, small = get("stop", left)
        all_, ends = max(all_ - own, 0), max(ends - own, 0)
        if left == "@" and not all_:
            ending = -4.0
        else:
            ending = math.log((ends + SMOOTH * self.end_rate) / ((max(all_, ends) + SMOOTH) * self.end_rate))
        going = math.log((small + SMOOTH * self.lower_rate) / ((max(all_, small) + SMOOTH) * self.lower_rate)) if lower else 0.0
        # Names begin sentences, but hardly ever paragraphs.
        return [1.0, ending, going, 0.0 if lower else max(-8.0, min(3.0, starts)), upper, lower, float(upper and ending > -1 and left != "#")]

    def never_ends(self, left: str) -> bool:
        """True if a word stands before so many stops that one of them would end a paragraph if any ended a sentence."""
        all_, ends, _ = self.frequent.get(("stop", left), (0, 0, 0))
        return not ends and (1 - min(self.end_rate, 0.5)) ** all_ < SURE

    def sentences(self, text: str, rare: dict[tuple[str, str], tuple]) -> list[tuple[int, int]]:
        """Start and end of each sentence, without surrounding white space."""
        out = []
        for start, end, whole in blocks(text):
            part = text[start:end]
            first, last = end - len(part.lstrip()), start + len(part.rstrip())
            if first >= last:
                continue
            if not whole and (found := candidates(text, start, end)):
                for k in self.decode(first, last, found, rare):
                    out.append((first, found[k][0]))
                    first = found[k][1]
            out.append((first, last))
        return out

    def decode(self, start: int, end: int, found: list, rare: dict[tuple[str, str], tuple]) -> list[int]:
        """Which of the characters are boundaries: Viterbi over inside and boundary, from the block's start to its end."""
        steps, scores = self.steps, self.scores if not rare else {}
        if len(scores) > MOST_SCORES:
            scores.clear()
        inside, boundary, back, previous = -math.inf, 0.0, [], start
        for at, _, *what in found:
            if (score := scores.get(key := tuple(what))) is None:
                kind, values = what[0], self.emission(*what, rare)
                score = scores[key] = sum(v * w for v, w in zip(values, self.emitted[_PLACE[kind] :]))
            base = transition(what[0], at - previous)
            from_i, from_b = inside + steps[base], boundary + steps[base + BITS + 1]
            back.append((boundary > inside, from_b > from_i))
            inside, boundary = max(inside, boundary), max(from_i, from_b) + score
            previous = at
        base = transition(found[-1][2], end - previous) if found else 0
        tag, out = boundary + steps[base + BITS + 1] > inside + steps[base], []
        for k in range(len(found) - 1, -1, -1):
            if tag:
                out.append(k)
            tag = back[k][1] if tag else back[k][0]
        return out[::-1]


def transition(kind: str, distance: int) -> int:
    """Place of the weight of inside before a boundary at this distance; that of boundary before it stands BITS + 1 further on."""
    return (2 * (BITS + 1) if kind == "space" else 0) + min(max(distance, 0).bit_length(), BITS)


def prior_weights() -> np.ndarray:
    """Weights at the start of the fit."""
    steps = np.zeros((2, 2, BITS + 1))
    steps[:, 1, :3] = AGAIN
    return np.concatenate([[v for kind in KINDS for v in PRIOR[kind].values()], steps.ravel()])


def fit(sequences: list[list[tuple[list[float], str, int, int]]]) -> np.ndarray:
    """Weights of the chain from sequences of (emission, kind, distance from the tag before, tag).

    Tag: 1 boundary, 0 inside, -1 unknown; the last element of a sequence is its end, a boundary without emission.  The
    likelihood of the known tags, summed over the unknown ones, is maximised together with a normal prior at
    :func:`prior_weights`, by gradient steps whose pace adapts to each weight; all sequences are worked on at once.
    """
    w = prior = prior_weights()
    if not sequences:
        return w
    length, size = max(map(len, sequences)), len(sequences)
    x, base = np.zeros((length, size, _EMISSIONS), np.float32), np.zeros((length, size), int)
    tags, real = np.full((length, size), -1), np.zeros((length, size), bool)
    for i, sequence in enumerate(sequences):
        for t, (values, kind, distance, tag) in enumerate(sequence):
            x[t, i, _PLACE[kind] : _PLACE[kind] + len(values)] = values
            base[t, i], tags[t, i], real[t, i] = _EMISSIONS + transition(kind, distance), tag, True
    never = -1e9

    def expected(w: np.ndarray, clamp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a boundary at each place, behind an inside and behind a boundary."""
        score = x @ w[:_EMISSIONS]
        from_i, from_b = score + w[base], score + w[base + BITS + 1]
        stay = np.zeros_like(score)
        if clamp:
            from_i, from_b = np.where(tags == 0, never, from_i), np.where(tags == 0, never, from_b)
            stay = np.where(tags == 1, never, stay)
        fi, fb = np.full((length + 1, size), never), np.zeros((length + 1, size))
        for t in range(length):
            i, b = np.logaddexp(fi[t], fb[t]) + stay[t], np.logaddexp(fi[t] + from_i[t], fb[t] + from_b[t])
            fi[t + 1], fb[t + 1] = np.where(real[t], i, fi[t]), np.where(real[t], b, fb[t])
        bi, bb = np.zeros((length + 1, size)), np.zeros((length + 1, size))
        for t in range(length - 1, -1, -1):
            i, b = np.logaddexp(stay[t] + bi[t + 1], from_i[t] + bb[t + 1]), np.logaddexp(stay[t] + bi[t + 1], from_b[t] + bb[t + 1])
            bi[t], bb[t] = np.where(real[t], i, bi[t + 1]), np.where(real[t], b, bb[t + 1])
        total = np.logaddexp(fi[-1], fb[-1])
        p = lambda f, step: np.where(real, np.exp(np.minimum(f[:-1] + step + bb[1:] - total, 0)), 0)
        return p(fi, from_i), p(fb, from_b)

    seen = np.full(len(w), 1e-8)
    w = w.copy()
    for _ in range(STEPS):
        gradient = prior - w
        for sign, clamp in ((1, True), (-1, False)):
            i, b = expected(w, clamp)
            gradient[:_EMISSIONS] += sign * np.einsum("ts,tsf->f", i + b, x, optimize=True)
            gradient += sign * (np.bincount(base.ravel(), i.ravel(), len(w)) + np.bincount(base.ravel() + BITS + 1, b.ravel(), len(w)))
        seen += gradient**2
        w += PACE * gradient / np.sqrt(seen)
    return w


def joined_paragraphs(text: str, model: Model, rare: dict[tuple[str, str], tuple]) -> Iterator[list[tuple[list[float], str, int, int]]]:
    """Sequences for the fit: consecutive paragraphs of a text as one, with what is known of their tags."""
    parts = [text[a:z].strip() for a, z, whole in blocks(text) if not whole]
    for k in range(0, len(parts) - 1, JOINED):
        group = parts[k : k + JOINED]
        unmarked = all(p and _HAS_UNMARKED.match(p[-1]) for p in map(stripped, group))
        if unmarked:
            group = [stripped(p) for p in group]
        elif not all(_END.search(p[-3:]) for p in group):
            continue  # headings and the like have no mark to be tagged
        glue = "" if not unmarked and all(_CJK.match(p[-1]) for p in group) else " "
        line = glue.join(group)
        joints = set(np.cumsum([len(p) + len(glue) for p in group])[:-1].tolist())
        sequence, previous = [], 0
        for at, nxt, kind, case, left, right in candidates(line, 0, len(line)):
            joint = nxt in joints
            tag = 1 if joint else 0 if kind == "stop" and model.never_ends(left) else -1
            sequence.append((model.emission(kind, case, left, right, rare, joint), kind, at - previous, tag))
            previous = at
        if sequence and len(sequence) < MOST_TAGS:
            yield [*sequence, ([], sequence[-1][1], len(line) - previous, 1)]


def corpus_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(table, key, n): the counts of all documents, as in TABLES."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            texts = [t for t in b["text"] if t]
            for t in texts:
                for start, end, whole in blocks(t):
                    if not whole:
                        count_block(t, start, end, counts)
            for w, n in Counter(chain.from_iterable(t.split() for t in texts)).items():
                counts["a", next_word(w, 0)] += n
            rows: dict[tuple[str, str], list[int]] = {}
            for (code, key), n in counts.items():
                table, k = _TABLE[code]
                rows.setdefault((table, key), [0, 0, 0])[k] += n
            yield pd.DataFrame([(t, k, *n) for (t, k), n in rows.items()], columns=["table", "key", "n0", "n1", "n2"])

    rows = documents.select(F.col(text).alias("text")).where("text is not null").mapInPandas(run, "table string, key string, n0 bigint, n1 bigint, n2 bigint")
    return rows.groupBy("table", "key").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])


def _unknown(text: str, frequent: dict[tuple[str, str], tuple]) -> list[tuple[str, str]]:
    """The counts that a text needs and that are not frequent."""
    found = (x for start, end, whole in blocks(text) if not whole for x in candidates(text, start, end))
    return sorted({k for x in found for k in keys_of(x[2], x[4], x[5]) if k not in frequent})


def frequent_counts(counts: DataFrame) -> tuple[dict[tuple[str, str], tuple], int]:
    """The most frequent counts, at most MOST_COUNTS of them, and the sum that each of them reaches."""
    sums = counts.groupBy((F.col("n0") + F.col("n1") + F.col("n2")).alias("n")).count().orderBy(F.desc("n"))
    ahead, floor = 0, 1
    for r in sums.toLocalIterator():
        if ahead + r["count"] > MOST_COUNTS:
            floor = r["n"] + 1
            break
        ahead += r["count"]
    return {(r.table, r.key): (r.n0, r.n1, r.n2) for r in counts.where(F.col("n0") + F.col("n1") + F.col("n2") >= floor).collect()}, floor


def split_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", fitted: bool = True) -> DataFrame:
    """(doc_id, start_at, end_at): code-point offsets of every sentence, end exclusive, without surrounding white space.

    Null and blank texts have none.  A blank line ends a unit, a line break
    does not; headings and list items are one unit each; text in quotes or
    brackets stays in its sentence.  Whole texts of any length are read,
    repeated documents each give their rows, other columns are not read.  All
    counts of the corpus are used, however rare; only the weights are fitted to
    a sample of SAMPLE documents (``fitted=False``: not at all).
    """
    counts = stash(corpus_counts(documents, text), "sentence_counts")
    total = {r.table: [r.n0, r.n1, r.n2] for r in counts.groupBy("table").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)]).collect()}
    frequent, floor = frequent_counts(counts)
    weights = None
    if fitted:
        sample = documents.select(F.col(text).alias("text")).where(F.length(text).between(1, 20_000)).orderBy(F.xxhash64("text")).limit(SAMPLE)
        first = Model(frequent, total)
        weights = fit([x for r in sample.collect() for x in joined_paragraphs(r.text, first, {})])
    model = Model(frequent, total, weights)
    kind = documents.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    chosen = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("text_id")).where("text is not null")

    def split(b: pd.DataFrame, rare_of: Iterator) -> pd.DataFrame:
        rows = []
        for d, t, rare in zip(b["doc_id"], b["text"], rare_of):
            known = {(x["table"], x["key"]): (x["n0"], x["n1"], x["n2"]) for x in rare} if rare is not None else {}
            rows += [(d, s, e) for s, e in model.sentences(t, known)]
        return pd.DataFrame(rows, columns=["doc_id", "start_at", "end_at"])

    out = f"doc_id {kind}, start_at bigint, end_at bigint"
    if floor <= 1:  # all counts go to all tasks

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield split(b, repeat(None))

        return chosen.select("doc_id", "text").mapInPandas(run, out)

    def missed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *key) for i, t in zip(b["text_id"], b["text"]) for key in _unknown(t, frequent)], columns=["text_id", "table", "key"])

    def run_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield split(b, b["rare"])

    needs = chosen.select("text_id", "text").mapInPandas(missed, "text_id string, table string, key string").distinct()
    rare = counts.where(F.col("n0") + F.col("n1") + F.col("n2") < floor)
    by_text = needs.join(rare, ["table", "key"]).groupBy("text_id").agg(F.collect_list(F.struct("table", "key", "n0", "n1", "n2")).alias("rare"))
    return chosen.join(by_text, "text_id", "left").select("doc_id", "text", "rare").mapInPandas(run_with, out)
