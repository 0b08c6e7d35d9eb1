"""Newly written text of e-mails and thread comments.

Marks of quoting, separators and headers, sign-offs and footers cut a message
into what its sender wrote and the rest.  All bodies are winnowed into fingerprints
and looked up in an inverted index of all bodies and all new texts; the spans of
ancestors are verified by digests of all their words.  They cut what stands in a message without
any mark or thread identifier, and tell where a forwarded text without marks
ends; where no ancestor is in the corpus the marks decide.  Closings that recur
below sign-offs are removed where a message has no sign-off.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorespan.functions.text import is_blank
from lorespan.llm.names import GIVEN_NAMES, fold
from lorespan.session import bounded_broadcast, stash

# Verbs of the lines that introduce quoted text, header words, and titles of forwarded parts.
_WROTE = r"(?:wrote|writes|said|schrieb|schreibt|a\s+écrit|écrit|escribió|escribe|ha\s+scritto|scrisse|escreveu|skrev|schreef|napisał(?:a)?|kirjoitti|пишет|написала?|さんは書きました|は書きました|さんのメール|写道|寫道|님이\s*작성|작성|έγραψε|كتب|เขียนว่า|ने\s*लिखा)"
_FROM = r"(?:From|Von|De|Da|Fra|Från|Van|От|差出人|发件人|寄件者|보낸\s*사람|Από|من)"
_KEY = rf"(?:{_FROM}|Sent|Date|To|Cc|Subject|Gesendet|Datum|An|Betreff|Envoyé|À|Objet|Enviado(?:\s+el)?|Para|Asunto|Fecha|Inviato|A|Oggetto|Data|Reply-To|Importance|Sendt|Til|Emne|Дата|Кому|Тема|送信日時|日時|宛先|件名|发送时间|收件人|主题|날짜|받는\s*사람|제목)"
_SUBJECT = r"(?:Subject|Betreff|Objet|Asunto|Oggetto|Emne|Ämne|Тема|件名|主题|제목)"
_ORIGINAL = r"(?:Original\s*Message|Original\s*Appointment|Ursprüngliche\s+Nachricht|Message\s+d'origine|Message\s+original|Mensaje\s+original|Messaggio\s+originale|Mensagem\s+original|Oorspronkelijk\s+bericht|Oprindelig\s+meddelelse|Ursprungligt\s+meddelande|Исходное\s+сообщение|元のメッセージ|原始邮件|원본\s*메시지|Forwarded\s+(?:by|message)|Weitergeleitete\s+Nachricht|Message\s+transféré|Mensaje\s+reenviado)"
# Sign-offs, device lines, and beginnings of footers.
_BYE = r"(?:best(?:\s+(?:regards|wishes))?|br|bgds|brgds|(?:kind|warm|warmest|many)?\s*regards|rgds|sincerely(?:\s+yours)?|yours\s+(?:sincerely|truly|faithfully)|cheers|thanks(?:\s+(?:again|a\s+lot|in\s+advance))?|thank\s+you(?:\s+(?:very\s+much|again|in\s+advance))?|many\s+thanks|thx|tia|ciao|take\s+care|mfg|vg|lg|mit\s+freundlichen\s+grüßen|(?:viele|beste|liebe|schöne|freundliche|herzliche)\s+grüße|gruß|grüße|cordialement|bien\s+(?:à\s+vous|cordialement)|salutations(?:\s+distinguées)?|amicalement|merci(?:\s+d'avance)?|un\s+(?:abrazo|saludo|cordial\s+saludo)|(?:cordiales\s+)?saludos(?:\s+cordiales)?|atentamente|gracias|よろしくお願い(?:いた|致)?します|敬具|此致\s*敬礼|此致|顺颂商祺|谢谢|с\s+уважением|спасибо|всего\s+доброго|감사합니다|με\s+εκτίμηση|ευχαριστώ|χαιρετισμούς|مع\s+(?:أطيب\s+)?(?:التحيات|التحية)|مع\s+الشكر|तहे\s+दिल\s+से|सादर|धन्यवाद|ขอแสดงความนับถือ|ขอบคุณ(?:ครับ|ค่ะ)?)"
_DEVICE = r"(?:sent\s+(?:from|via|by|with)\s+(?:my|an?|the)\b|sent\s+on\s+the\s+go|envoyé\s+(?:de|depuis)\s+mon|von\s+(?:unterwegs|meinem)\b.*\bge(?:sendet|schickt)|(?:gesendet|geschickt)\s+von\s+(?:meinem|unterwegs)|enviado\s+desde\s+mi|inviato\s+da(?:l)?\s+mio|verzonden\s+vanaf\s+mijn|отправлено\s+с|iphoneから送信|(?:携帯|スマートフォン|モバイル)(?:端末)?から送信|从我的.{1,12}发送|发自我的|나의\s+\S+에서\s+보냄)"
_FOOTER = r"(?:confidentiality\s+(?:notice|note)|disclaimer|legal\s+notice|notice\s*:|(?:this|the\s+information(?:\s+contained)?\s+in\s+this)\s+(?:e-?mail|message|communication|transmission)\b.{0,60}\b(?:is|are|may|contains?|and\s+any)\b|the\s+information\s+(?:contained\s+)?in\s+this\s+(?:e-?mail|message|communication|transmission)|if\s+you\s+(?:are\s+not|have\s+received|received)\b|ce\s+(?:message|courriel|mail)\b.{0,40}\bconfidentiel|diese\s+(?:e-?mail|nachricht)\b.{0,40}\bvertraulich|este\s+(?:mensaje|correo)\b.{0,40}\bconfidencial|questo\s+messaggio\b.{0,40}\b(?:riservato|confidenziale)|this\s+is\s+not\s+an?\s+offer|get\s+your\s+(?:free\s+)?\w+|(?:do\s+you\s+yahoo|join\s+the\s+world|to\s+unsubscribe|unsubscribe)|このメール.{0,20}機密|本メール.{0,30}(?:機密|秘密)|本邮件.{0,20}(?:机密|保密)|это\s+(?:письмо|сообщение).{0,40}конфиденциальн)"

_QUOTE = re.compile(r"[ \t]{0,3}(?:[>»]|\|(?!\s*$)|\|\s*$)")
_INTRO = re.compile(rf"(?i)^(?!.*\bthe\s+operator\b).*\b{_WROTE}\b.*[:：]\s*$|^.*(?:さんは書きました|写道|寫道)[:：]?\s*$|^.*{_WROTE}.{{0,60}}[:：]\s*$")
_INTRO_START = re.compile(r"(?i)^(?:on|am|le|el|il|em|den|op|den|в|στις)\b.*\d")
_SEPARATOR = re.compile(rf"(?i)^\s*(?:[-_=*]{{2,}}\s*{_ORIGINAL}\b.*|begin\s+forwarded\s+message\s*:?|{_ORIGINAL}\s*:?\s*[-_=*]{{2,}})\s*$")
_FROM_LINE = re.compile(rf"(?i)^\s*\*?{_FROM}\s*[:：]\*?\s*\S")
_SUBJECT_LINE = re.compile(rf"(?i)^\s*\*?{_SUBJECT}\s*[:：]")
_KEY_LINE = re.compile(rf"(?i)^\s*\*?{_KEY}\s*[:：]")
_LONG_RULE = re.compile(r"^\s*_{10,}\s*$|^\s*-{10,}\s*$")
_RULE = re.compile(r"^\s*([-_=~*#+])\1+\s*$|^\s*--\s*$")
_BYE_LINE = re.compile(rf"(?i)^\s*{_BYE}\s*[,.!。、;]*\s*(?:[-–—]\s*)?(?P<name>.*)$")
_DASH_NAME = re.compile(r"^\s*[-–—/~*]{1,2}\s*(?P<name>[^\W\d_].*)$")
_DEVICE_LINE = re.compile(rf"(?i)^\s*[-*]*\s*{_DEVICE}")
_FOOTER_LINE = re.compile(rf"(?i)^\s*[-*]*\s*{_FOOTER}")
_FOOTER_FIRST = re.compile(r"(?i)[-*\s]*(?:confid|discl|legal|notice|th(?:is|e\s+information)|if\s+you|ce\s|diese|este\s|questo|get\s|do\s+you|join|to\s+unsub|unsub|このメール|本|это|sent|envoy|von|ge(?:sen|schi)|envia|invia|verz|отпр|iphone|携|ス|モ|从|发|나의)")
_POSTSCRIPT = re.compile(r"(?i)^\s*(?:p\.?\s?s\.?|n\.?b\.|ps)\s*[:.,\-–—)]?\s")
_LOTUS = re.compile(r"^\s*\S.*\bon\s+\d{1,2}/\d{1,2}/\d{2,4}.*$")

_SHORT = {n: full for full, short in GIVEN_NAMES.items() for n in [full, *short.split()]}


#: What stands for the words of an unknown sender: any given name.
_ANYONE = frozenset(_SHORT) | {"*"}


@lru_cache(maxsize=65536)
def sender_words(sender: str | None) -> set[str] | frozenset[str]:
    """Folded words by which a sender may sign: names and short forms; of an unknown sender all given names."""
    words = {w for w in re.findall(r"[a-z]+", fold(re.sub(r"@\S*", " ", sender or "")).lower()) if len(w) > 1}
    if not words:
        return _ANYONE
    full = {_SHORT[w] for w in words if w in _SHORT}
    return words | full | {n for n, f in _SHORT.items() if f in full}


def _is_name(text: str, words: set[str]) -> bool:
    """True if ``text`` is a form of the sender's name: at least one of the sender's words, the others initials."""
    parts = re.findall(r"[^\W\d_]+", fold(text).lower())
    if not parts or len(parts) > 5 or len(text) > 60 or re.search(r"[:;?!@]|\d", text):
        return False
    if "*" in words:
        return len(parts) <= 3 and (parts[0] in words or parts[-1] in words) and (len(parts) == 1 or all(w[:1].isupper() for w in text.split()))
    return any(p in words for p in parts) and all(p in words or len(p) == 1 or p in ("mr", "ms", "mrs", "dr", "prof") for p in parts)


def _looks_like_name(text: str) -> bool:
    parts = text.strip(" .,").split()
    return 0 < len(parts) <= 4 and all(re.fullmatch(r"[^\W\d_][^\W\d_.'’\-]*\.?(?:-[^\W\d_]+)*", p) for p in parts) and (parts[0][:1].isupper() or len(parts) == 1)


def _introduces(line: str) -> bool:
    return line.rstrip().endswith((":", "：", "した", "写道", "寫道")) and bool(_INTRO.match(line))


def quoted_lines(lines: list[str]) -> list[bool]:
    """Which lines are quoted, forwarded, or introduce such text."""
    return _quoted(lines)[0]


def _quoted(lines: list[str]) -> tuple[list[bool], int | None]:
    """Quoted lines, and where a text without marks begins that is taken as quoted to the end of the message."""
    n = len(lines)
    gone = [bool(_QUOTE.match(x)) for x in lines]
    k = 0
    while k < n:
        if gone[k]:
            j = k - 1
            while j >= 0 and not lines[j].strip():
                j -= 1
            if j >= 0 and not gone[j]:
                if _introduces(lines[j]):
                    gone[j] = True
                    if j and not gone[j - 1] and lines[j - 1].strip() and _INTRO_START.match(lines[j - 1]):
                        gone[j - 1] = True
                elif re.search(r"[:：]\s*$", lines[j]) and j and lines[j - 1].strip() and _INTRO.match(lines[j - 1].rstrip() + " " + lines[j].lstrip()):
                    gone[j] = gone[j - 1] = True
            while k < n and gone[k]:
                k += 1
            continue
        if not (line := lines[k].strip()):
            k += 1
            continue
        marked = line[0] in "-_=*bB" and bool(_SEPARATOR.match(line))
        if not marked and ":" not in line and "：" not in line and not line.endswith(("した", "写道", "寫道")):
            k += 1
            continue
        start = k if marked else None
        if start is None and (_FROM_LINE.match(lines[k]) and _header_end(lines, k) is not None):
            start = k
        if start is None and _introduces(line):
            j = k + 1
            while j < n and not lines[j].strip():
                j += 1
            if j < n and not gone[j] and re.search(r"\d|@", lines[k]):
                gone[k:] = [True] * (n - k)
                return gone, j
        if start is None:
            k += 1
            continue
        j = start + 1 if marked else _header_end(lines, start)
        while j < n and not lines[j].strip():
            j += 1
        if j < n and marked:
            end = _header_end(lines, j)
            if end is None and _LOTUS.match(lines[j]):
                end = j + 1
                while end < n and _KEY_LINE.match(lines[end]):
                    end += 1
            j = end if end is not None else j
            while j < n and not lines[j].strip():
                j += 1
        first = start - 1 if start and _LONG_RULE.match(lines[start - 1]) else start
        if j < n and gone[j]:  # marked text follows: only the header belongs to it
            gone[first:j] = [True] * (j - first)
            k = j
        else:
            gone[first:] = [True] * (n - first)
            return gone, j if j < n else None
    return gone, None


def _header_end(lines: list[str], k: int) -> int | None:
    """Line after the header block that begins at ``k``; None if it is none (no subject, or no sender)."""
    if not _FROM_LINE.match(lines[k]):
        return None
    j, keys, subject = k, 0, False
    while j < len(lines) and (_KEY_LINE.match(lines[j]) or (j > k and lines[j].startswith((" ", "\t")) and lines[j].strip())):
        keys += bool(_KEY_LINE.match(lines[j]))
        subject |= bool(_SUBJECT_LINE.match(lines[j]))
        j += 1
    return j if subject and keys >= 2 else None


def _paragraphs(lines: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for x in lines:
        if x.strip():
            out[-1].append(x)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def _is_table(paragraph: list[str]) -> bool:
    """A block fenced by the same rule above and below, with figures or words but no prose footer."""
    rule = _RULE.match(paragraph[0])
    return bool(rule) and len(paragraph) > 2 and paragraph[0].strip() == paragraph[-1].strip() and not any(_FOOTER_LINE.match(x) for x in paragraph)


def strip_closing(lines: list[str], words: set[str]) -> list[str]:
    """Lines without sign-off, contact block, device line and footer; postscripts stay."""
    return [*chain.from_iterable(_without_closing(lines, words)[0])]


def _without_closing(lines: list[str], words: set[str]) -> tuple[list[list[str]], list[list[str]]]:
    """The paragraphs that stay, and what was cut of each other one."""
    kept: list[list[str]] = []
    gone: list[list[str]] = []
    closed = False
    paragraphs = _paragraphs(lines)
    for at, p in enumerate(paragraphs):
        if _POSTSCRIPT.match(p[0] + " "):
            kept.append(p)
            continue
        if _is_table(p) and not closed:
            kept.append(p)
            continue
        cut = len(p)
        for k, x in enumerate(p):
            short = len(x) <= 80
            line = x.strip()
            rule = line[0] in "-_=~*#+" and bool(_RULE.match(line))
            if rule:
                if k + 1 < len(p) or at + 1 == len(paragraphs):
                    cut, closed = k, closed or line[0] in "-_~"
                    break
                continue
            if _FOOTER_FIRST.match(line) and (_DEVICE_LINE.match(line) or _FOOTER_LINE.match(line)):
                cut = k
                break
            if not short and "|" not in line:
                continue
            bye = _BYE_LINE.match(line)
            name = bye["name"].strip(" ,.") if bye else ""
            if bye and (not name or _is_name(name, words) or (k + 1 >= len(p) - 1 and _looks_like_name(name) and at)):
                if name or at or len(paragraphs) == 1 or k:
                    cut, closed = k, True
                    break
            if line[0] in "-–—/~*" and (m := _DASH_NAME.match(line)) and _is_name(m["name"], words):
                cut, closed = k, True
                break
            wrapped = k and len(p[k - 1]) >= 45
            if (at or k) and not wrapped and not line.endswith((",", ":", "-", "–")) and _is_name(line.split("|")[0], words):
                cut, closed = k, True
                break
        else:
            if closed:
                cut = 0
        if cut == len(p) and not closed:
            kept.append(p)
            continue
        if cut and (not closed or p[:cut]):
            kept.append(p[:cut])
        else:
            cut = 0
        if cut < len(p):
            gone.append(p[cut:])
    return kept, gone


def new_text(body: str | None, sender: str | None) -> str:
    """Newly written text with single blanks; empty if nothing is new."""
    lines = (body or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    gone = quoted_lines(lines)
    rest = ["" if g else x for g, x in zip(gone, lines)]
    return " ".join(" ".join(strip_closing(rest, sender_words(sender))).split())


#: Words of a shingle and shingles of a winnowing window, by level; a core is posted at the highest one of which a window fits in it, so
#: a fingerprint holds a third of its words at least, and few texts share it without sharing the core (but for the highest one's, all longer).
LEVELS = ((13, 7), (26, 13), (52, 25), (104, 49))
#: Least shared share of an ancestor, least words of an unmarked quotation, least words cut beside a marked one.
MIN_SHARE, MIN_WORDS, MIN_CUT = 0.8, 25, 5
#: A closing recurs with this many senders and stands below sign-offs in this share of its places.
MIN_SENDERS, MIN_CLOSED = 5, 0.9
#: Least characters of a paragraph that is compared as a closing.
MIN_CLOSING = 40
#: Most first texts of a core that are looked up by a broadcast; more of them are joined without a hint.
MAX_FIRSTS = 50_000
#: Bits of a hash that a fingerprint leaves away: 40 are kept, as all words are compared, too.
KEPT_BITS = np.uint64(24)
#: Words of a window of each level.
SPANS = tuple(shingle + window - 1 for shingle, window in LEVELS)
#: Most words of 64 bits, as a power of two, of the filter of posted fingerprints (32 MB); with more texts it lets more through, and nothing is lost.
FILTER_POWER = 22
#: Fingerprints on either side of one that are compared before a text is, as far as they are in its core.
NEAR = 6
#: What an ancestor's text is: its whole body, its new text, or both.
BODY, NEW = 1, 2


_ALL, _BASE = 2**64 - 1, 0x9E3779B97F4A7C15


class _Codes(dict):
    """A hash of each word, regardless of case; each distinct word is hashed once."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return h


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_Codes().__getitem__, words), np.uint64, len(words))


def _run(codes: np.ndarray, size: int, known: dict[int, tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """Polynomial hash of the run of ``size`` words that begins at each word, and the base's power; the last ones run over the end."""
    if size not in known:
        half = size // 2
        hashes, power = _run(codes, half, known)
        mixed, power = hashes * np.uint64(power), power * power & _ALL
        mixed[: max(0, len(codes) - half)] += hashes[half:]
        if size % 2:
            mixed, power = mixed * np.uint64(_BASE), power * _BASE & _ALL
            mixed[: max(0, len(codes) - size + 1)] += codes[size - 1 :]
        known[size] = mixed, power
    return known[size]


def _runs(codes: np.ndarray) -> list[np.ndarray]:
    """By level, the hash of the shingle that begins at each word."""
    known, out = {1: (codes, _BASE)}, []
    for shingle, _ in LEVELS:
        mixed = _run(codes, shingle, known)[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x2545F4914F6CDD1D)
        out.append((mixed ^ (mixed >> np.uint64(32))) >> KEPT_BITS)
    return out


def _level(n: int) -> int:
    """The highest level of which a window fits in ``n`` words."""
    return max(k for k, span in enumerate(SPANS) if span <= n)


def _near(fp: np.ndarray, place: np.ndarray, at: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Of each named fingerprint the set, as bits, of those beside it with their distances: at most ``back`` before and ``ahead`` behind it."""
    bits = np.zeros(len(at), np.uint64)
    for d in range(1, NEAR + 1):
        for step, room in ((-d, back), (d, ahead)):
            i = np.flatnonzero(room >= d)
            there = at[i] + step
            apart = (place[there].astype(np.int64) - place[at[i]]).view(np.uint64)
            bits[i] |= np.uint64(1) << ((fp[there].view(np.uint64) + apart * np.uint64(_BASE)) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(58))
    return bits.view(np.int64)


@dataclass
class Prints:
    """Fingerprints of texts that stand one behind another; by level, those selected with their places, and of the window that begins at each word the number of its one."""

    begins: np.ndarray
    ends: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[list[str]]) -> Prints:
        codes = _codes([*chain.from_iterable(texts)])
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(n)
        at, low = np.arange(len(codes)), (1 << 24) - 1
        left, inside, levels = np.repeat(ends, n) - at, (at - np.repeat(ends - n, n) & low).astype(np.uint64), []
        for hashes, span, (_, window) in zip(_runs(codes), SPANS, LEVELS):
            least, done = hashes << KEPT_BITS | inside, 1
            while done < window:  # the window's first part and its last one, which may overlap
                step = min(done, window - done)
                least[: max(0, len(at) - step)] = np.minimum(least[: max(0, len(at) - step)], least[step:])
                done += step
            whole = left >= span
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
            chosen = whole & new
            shown = np.flatnonzero(chosen)
            place = shown + ((least[shown] - inside[shown]).view(np.int64) & low)
            levels.append(((least[shown] >> KEPT_BITS).view(np.int64), place, np.cumsum(chosen) - 1))
        return cls(ends - n, ends, levels)

    def rarest(self, texts: list[int], parts: list[int]) -> list[tuple[int, int, int]]:
        """Fingerprint, place and neighbours of each named text: the window of its core that is selected least often among all texts."""
        out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(texts)
        extents = [_extent(int(self.ends[k] - self.begins[k]), part) for k, part in zip(texts, parts)]
        levels = [_level(hi - lo) for lo, hi in extents]
        for level, ((fp, place, number), span) in enumerate(zip(self.levels, SPANS)):
            own = [i for i, x in enumerate(levels) if x == level]
            if not own:
                continue
            _, which, n = np.unique(fp, return_inverse=True, return_counts=True)
            often = n[which] << 40 | np.arange(len(fp))
            begins = self.begins[[texts[i] for i in own]]
            first, last = (number[begins + [extents[i][0] for i in own]], number[begins + [extents[i][1] - span for i in own]])
            cuts = np.column_stack([first, last + 1]).ravel()
            at = np.minimum.reduceat(np.append(often, np.iinfo(np.int64).max), cuts)[::2] & (1 << 40) - 1
            for i, *x in zip(own, fp[at].tolist(), place[at].tolist(), _near(fp, place, at, at - first, last - at).tolist()):
                out[i] = tuple(x)
        return out

    def selected(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, fingerprint and place in it of the selected fingerprints of the first ``size`` texts, by text, level and place."""
        found = []
        for fp, place, _ in self.levels:
            shown = np.searchsorted(place, self.ends[size - 1] if size else 0)
            owner = np.searchsorted(self.ends[:size], place[:shown], "right")
            found.append((owner, fp[:shown], place[:shown] - self.begins[owner]))
        owner, fp, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return owner[order], fp[order], place[order]


def winnow(texts: list[str]) -> list[np.ndarray]:
    """Fingerprints of each text; a text shorter than a window has that of all its words."""
    words = [t.split() for t in texts]
    owner, fp, _ = Prints.of(words).selected(len(words))
    out = []
    for k, w in enumerate(words):
        found = np.unique(fp[owner == k])
        if w and not len(found):
            found = (_runs(_codes(w))[0][:1]).view(np.int64)
        out.append(found)
    return out


def _core(n: int) -> tuple[int, int]:
    """Words of an ancestor of ``n`` words that every run long enough for a quotation holds: at least a window."""
    run = max(MIN_WORDS, math.ceil(MIN_SHARE * n))
    return n - run, run


def _digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def _extent(n: int, part: int) -> tuple[int, int]:
    """Begin and end of what a message that quotes the text must hold: all of a body, the core of a new text."""
    return _core(n) if part & NEW else (0, n)


def _paragraph_key(paragraph: list[str]) -> str:
    """Text of a closing without figures and capitalised names, which differ between its copies."""
    return " ".join(re.sub(r"\d+|\b(?<![.!?] )[A-ZÀ-Þ][\w'’]+", "*", " ".join(" ".join(paragraph).split())).split())


_ADDRESS = re.compile(r"^.*<([^<>]*)>\s*$", re.S)


def _message_key(src: Column, ord_: Column, pos: Column) -> Column:
    """One number for (src, ord, pos): even for mail, odd for comments, whose threads are numbered by INT; in their order."""
    return F.when(src == "mail", ord_ * 2).otherwise((ord_ * F.lit(1 << 31) + pos) * 2 + 1)


def _named(df: DataFrame) -> DataFrame:
    """With src, ord and pos instead of their number."""
    half, mail = F.shiftright("mid", 1), F.col("mid") % 2 == 0
    ord_, pos = F.when(mail, half).otherwise(F.shiftright(half, 31)), F.when(mail, F.lit(0).cast("bigint")).otherwise(half.bitwiseAND(F.lit((1 << 31) - 1).cast("bigint")))
    return df.select(F.when(mail, "mail").otherwise("thread").alias("src"), ord_.alias("ord"), pos.alias("pos"), *[c for c in df.columns if c != "mid"])


def messages_of(mail: DataFrame, threads: DataFrame) -> DataFrame:
    """(src, ord, pos, sender, body) of all mail and thread comments that are not blank."""
    m = mail.select(F.lit("mail").alias("src"), F.col("ord").cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("pos"), "sender", "body")
    t = threads.select(F.col("issue_id").cast("bigint").alias("ord"), F.posexplode("comments").alias("pos", "c"))
    t = t.select(F.lit("thread").alias("src"), "ord", F.col("pos").cast("bigint").alias("pos"), F.col("c.author").alias("sender"), F.col("c.text").alias("body"))
    return m.union(t).where(~is_blank(F.col("body")))


_MARKS = re.compile(r"(?:[ \t]{0,3}[>»|])+")


def _plain(line: str) -> str:
    """The line without its marks of quoting."""
    return _MARKS.sub("", line, count=1) if line[:1] in _MARKED and _QUOTE.match(line) else line


_MARKED = frozenset(" \t>»|")


def _kept_words(lines: list[str], words: set[str], first: int) -> tuple[list[list[str]], list[list[str]], list[int], list[str], int | None, int]:
    """Paragraphs of kept lines, paragraphs that were cut as closings, [begin, end, ...] of the kept words if ``first`` is the first word, all words without marks, and the line and the word at which an unmarked tail begins."""
    gone, tail = _quoted(lines)
    rest = ["" if g else x for g, x in zip(gone, lines)]
    kept_, closings = _without_closing(rest, words)
    text = [*chain.from_iterable(kept_)]
    ranges: list[int] = []
    all_: list[str] = []
    k, at, tail_at, kept = 0, first, first, len(text)
    for j, (x, line) in enumerate(zip(rest, lines)):
        if j == tail:
            tail_at = at
        all_ += (x if x[:1] not in _MARKED else _plain(line)).split() if x else _plain(line).split()
        end = first + len(all_)
        if k < kept and x is text[k]:
            k += 1
            if ranges and ranges[-1] == at:
                ranges[-1] = end
            else:
                ranges += [at, end]
        at = end
    return kept_, closings, ranges, all_, tail, tail_at


def _key(paragraph: list[str]) -> int | None:
    """Hash of a closing's text as compared between messages; null for short ones."""
    text = _paragraph_key(paragraph)
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True) if len(text) >= MIN_CLOSING else None


def segment(messages: DataFrame) -> DataFrame:
    """What marks and sign-offs leave and cut of each message, and its fingerprints.

    ``flat``: the whole body without marks; ``sender``: only where it is needed again, with a tail; ``ranges``: begin and end of the kept words in it; ``last_key``, ``last``: key
    and words of the last of several paragraphs; ``closings``: keys of the paragraphs that were cut; ``tail`` and
    ``tail_at``: lines of a forwarded text without marks and its first word; ``prints``, ``places``: fingerprints of the whole
    body, five bytes each, and their places; ``posts``: new text and whole body as possible ancestors.
    """
    columns = ["sender", "sender_id", "last_key", "last", "closings", "flat", "ranges", "tail", "tail_at"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32()]

    def run(batches):
        gc.disable()  # nothing here makes cycles; collections would only walk the lists of a batch
        for b in batches:
            out: dict[str, list] = {c: [] for c in columns}
            flats, news = [], []
            for sender, body in zip(b["sender"].to_pylist(), b["body"].to_pylist()):
                lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                kept, closings, ranges, words, tail, tail_at = _kept_words(lines, sender_words(sender), 0)
                last = kept[-1] if len(kept) > 1 else None
                out["last_key"].append(_key(last) if last else None)
                out["last"].append(sum(len(x.split()) for x in last) if last else 0)
                out["closings"].append([k for q in closings if (k := _key(q)) is not None])
                out["sender_id"].append(_ADDRESS.sub(r"\1", sender or "").strip().lower())
                flats.append(words)
                news.append(words if ranges == [0, len(words)] else [w for x, y in zip(ranges[::2], ranges[1::2]) for w in words[x:y]])
                out["flat"].append(" ".join(words))
                out["ranges"].append(ranges)
                out["tail"].append(None if tail is None else "\n".join(lines[tail:]))
                out["tail_at"].append(tail_at)
                out["sender"].append(None if tail is None else sender)
            size = len(flats)
            texts = [*flats, *(w if len(w) < len(f) else [] for w, f in zip(news, flats))]
            prints = Prints.of(texts)
            chosen = [(k, BODY | NEW if len(news[k]) == len(w) else BODY) if k < size else (k, NEW) for k, w in enumerate(texts) if len(w) >= MIN_WORDS]
            rarest = prints.rarest([k for k, _ in chosen], [part for _, part in chosen])
            posted_ = sorted((k % size, k, part, *x) for (k, part), x in zip(chosen, rarest))
            posts = [_post(texts[k], part, fp, place - int(prints.begins[k]), near) for _, k, part, fp, place, near in posted_]
            owner, fps, places = prints.selected(size)
            long = (prints.ends - prints.begins)[owner] >= MIN_WORDS
            owner, arrays = owner[long], [fps[long].view(np.uint8).reshape(-1, 8)[:, :5], places[long].astype(np.int32).view(np.uint8).reshape(-1, 4)]
            offsets = lambda owners: pa.array(np.searchsorted(owners, np.arange(size + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b["mid"], *[pa.array(out[c], t) for c, t in zip(columns, kinds)], pa.array([len(w) for w in flats], pa.int32()),
                *[pa.BinaryArray.from_buffers(pa.binary(), size, [None, pa.py_buffer(np.searchsorted(owner, np.arange(size + 1)).astype(np.int32) * x.shape[1]), pa.py_buffer(x.tobytes())]) for x in arrays],
                pa.ListArray.from_arrays(offsets(np.array([x[0] for x in posted_], np.int64)), pa.array(posts, _POSTS)),
            ], ["mid", *columns, "n_words", "prints", "places", "posts"])
        gc.enable()

    kind = "mid bigint, sender string, sender_id string, last_key bigint, last int, closings array<bigint>, flat string, ranges array<int>, tail string, tail_at int, n_words int, prints binary, places binary, posts array<struct<part: int, n: int, core: binary, text: binary, fp: bigint, p: int, near: bigint>>"
    return messages.select(_message_key(F.col("src"), F.col("ord"), F.col("pos")).alias("mid"), "sender", "body").mapInArrow(run, kind)


CORE, POST = ["part", "n", "core"], ["fp", "p", "near"]
_POSTS = pa.struct([("part", pa.int32()), ("n", pa.int32()), ("core", pa.binary()), ("text", pa.binary()), ("fp", pa.int64()), ("p", pa.int32()), ("near", pa.int64())])


def _post(words: list[str], part: int, fp: int, p: int, near: int) -> dict:
    """A text as a possible ancestor, posted under the fingerprint of one window of its core."""
    lo, hi = _extent(len(words), part)
    core = _digest(words[lo:hi])
    return {"part": part, "n": len(words), "core": core, "text": core if hi - lo == len(words) else _digest(words), "fp": fp, "p": p, "near": near}


def recurring_closings(parts: DataFrame) -> DataFrame:
    """(key): paragraphs that many senders put below their sign-offs and hardly anyone elsewhere."""
    below = parts.select(F.explode("closings").alias("key"), "sender_id", F.lit(1).alias("closed"))
    last = parts.where("last_key is not null").select(F.col("last_key").alias("key"), "sender_id", F.lit(0).alias("closed"))
    seen = below.union(last).groupBy("key", "sender_id").agg(F.sum("closed").alias("closed"), F.count(F.lit(1)).alias("n"))
    return seen.groupBy("key").agg(F.count(F.lit(1)).alias("senders"), F.sum("closed").alias("closed"), F.sum("n").alias("n")).where((F.col("senders") >= MIN_SENDERS) & (F.col("closed") >= MIN_CLOSED * F.col("n"))).select("key")


def posted(parts: DataFrame) -> DataFrame:
    """(mid, part, n, core, text, fp, ...): every whole body and new text of enough words."""
    return parts.select("mid", F.explode("posts").alias("x")).select("mid", "x.*")


def ancestor_index(posts: DataFrame) -> DataFrame:
    """The inverted index: one fingerprint of each distinct core.

    Texts with one core differ in at most a fifth of their words at either end.  They stand together as one entry, so that
    a template that a third of the messages fill in costs each of them one entry and never all pairs: ``first`` and
    ``text`` are the first of them, ``several`` says that others differ from it.
    """
    first = F.min(F.struct("mid", "text", *POST)).alias("f")
    cores = posts.groupBy(*CORE).agg(first, (F.min("text") != F.max("text")).alias("several"))
    return cores.select(*[f"f.{k}" for k in (*POST, "text")], *CORE, F.col("f.mid").alias("first"), "several")


def _posted_bits(parts: DataFrame) -> np.ndarray:
    """One bit for each posted fingerprint, by its lower bits: what has none is in no entry of the index."""
    n = parts.select(F.sum(F.size("posts"))).first()[0] or 0
    bits = np.zeros(1 << min(FILTER_POWER, max(10, (n // 4).bit_length())), np.int64)
    fp = F.col("fp")
    bit = F.expr(f"shiftleft(1L, cast(shiftright(fp, {FILTER_POWER}) & 63 AS INT))")
    words = parts.select(F.explode("posts.fp").alias("fp")).groupBy(fp.bitwiseAND(F.lit(len(bits) - 1)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits


def _bytes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ``width`` bytes of all rows, and where each row's ones begin and end."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    out = np.zeros(((cuts[-1] - cuts[0]) // width, 8), np.uint8)
    if len(out):
        out[:, :width] = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].reshape(-1, width)
    return out.view(np.int64).ravel(), (cuts - cuts[0]) // width


def _posted_prints(parts: DataFrame) -> DataFrame:
    """(mid, n_words, fp, place, beside): the fingerprints of messages that some text may be posted under."""
    shared = parts.sparkSession.sparkContext.broadcast(_posted_bits(parts))

    def run(batches):
        bits = shared.value
        for b in (b for b in batches if len(b)):
            (fp, cuts), (place, _) = _bytes(b["prints"], 5), _bytes(b["places"], 4)
            hit = np.flatnonzero(bits[fp & (len(bits) - 1)] >> (fp >> FILTER_POWER & 63) & 1)
            owner = np.repeat(np.arange(len(b)), np.diff(cuts))[hit]
            beside = _near(fp, place, hit, hit - cuts[owner], cuts[owner + 1] - 1 - hit)
            yield pa.RecordBatch.from_arrays([b["mid"].take(pa.array(owner)), b["n_words"].take(pa.array(owner)), pa.array(fp[hit]), pa.array(place[hit].astype(np.int32)), pa.array(beside)], ["mid", "n_words", "fp", "place", "beside"])

    return parts.select("mid", "n_words", "prints", "places").mapInArrow(run, "mid bigint, n_words int, fp bigint, place int, beside bigint")


def possible_ancestors(parts: DataFrame, index: DataFrame, named: bool = False) -> DataFrame:
    """(mid, found): the entries of the index whose fingerprint each message holds, without its own texts' if it stands alone.

    ``first`` of an entry is given where only a part of it may stand in the message, or everywhere if ``named``.
    """
    itself = F.col("mid") == F.col("first")
    copy = (F.col("part") != NEW) & (F.col("n") == F.col("n_words"))  # the whole message, so not a quotation in it
    pairs = _posted_prints(parts).join(index, "fp").where((F.col("beside").bitwiseAND(F.col("near")) == F.col("near")) & (F.col("n") * MIN_SHARE <= F.col("n_words")) & ~copy & ~(itself & ~F.col("several")))
    partly = F.col("part").bitwiseAND(F.lit(NEW)) > 0
    one = F.struct((F.col("place") - F.col("p")).alias("at"), *CORE, "text", F.when(partly | F.lit(named), F.col("first")).alias("first"), (partly & F.col("several")).alias("several"))
    return pairs.groupBy("mid").agg(F.collect_list(one).alias("found"))


def verified(words: list[str], new: list[str], found: list[dict]) -> tuple[list[int], list[dict]]:
    """Spans of whole ancestors (begin, end, what; three by three), and the places where only the core of an entry stands.

    The core and the whole text are compared by digests of all their words.  Entries of the message's own new text are
    copies, not quotations.  What a whole ancestor is: BODY if its body ends there, NEW as it is a quotation.
    """
    spans: list[int] = []
    open_: list[dict] = []
    for x in found:
        part, n, core, k = x["part"], x["n"], x["core"], x["at"]
        lo, hi = _extent(n, part)
        if part & NEW and n == len(new) and _digest(new[lo:hi]) == core:
            continue
        whole = _digest(words[k : k + n]) if k >= 0 and k + n <= len(words) else None
        if whole == x["text"]:
            spans += [k, k + n, part & BODY | NEW]
        elif part & NEW and k + lo >= 0 and k + hi <= len(words) and _digest(words[k + lo : k + hi]) == core:
            open_.append({"at": k, "part": part, "n": n, "core": core, "whole": whole, "first": x["first"], "several": x["several"]})
    return spans, open_


def partial_span(words: list[str], at: int, earlier: list[str]) -> list[int]:
    """The run of words around a core that agrees with the ancestor; empty if it is too short for a quotation."""
    n = len(earlier)
    lo, hi = i, j = _core(n)
    while i and at + i and words[at + i - 1] == earlier[i - 1]:
        i -= 1
    while j < n and at + j < len(words) and words[at + j] == earlier[j]:
        j += 1
    return [at + i, at + j, NEW] if j - i >= hi else []


def spans_of(text: str, earlier: str, whole: bool = False, part: int = BODY | NEW) -> list[int]:
    """Runs of words of ``text`` that quote ``earlier``, as in ancestors(); ``whole``: only with all of its words; ``part``: what it is."""
    b = earlier.split()
    n = len(b)
    if n < MIN_WORDS:
        return []
    lo, hi = _core(n) if part & NEW and not whole else (0, n)
    a, inside, core = text.split(), f" {text} ", f" {' '.join(b[lo:hi])} "
    out: list[int] = []
    at = inside.find(core)
    counted, k = 0, 0
    while at >= 0:
        k += inside.count(" ", counted, at)
        counted = at
        i, j = lo, hi
        while i and k - lo + i and a[k - lo + i - 1] == b[i - 1]:
            i -= 1
        while j < n and k - lo + j < len(a) and a[k - lo + j] == b[j]:
            j += 1
        if j - i >= hi:
            out += [k - lo + i, k - lo + j, (part & BODY if j == n else 0) | (NEW if part & NEW or j - i == n else 0)]
        at = inside.find(core, at + 1)
    return out


def without_span(text: str, earlier: str) -> str | None:
    """``text`` without the runs of words it shares with ``earlier``; None if they are too short or nothing else is left."""
    a = text.split()
    spans = spans_of(" ".join(a), earlier)
    rest = without_spans(" ".join(a), [0, len(a)], None, 0, set(), spans)
    return rest if spans and len(rest.split()) < len(a) else None


def without_spans(flat: str, ranges: list[int], tail: str | None, tail_at: int, words: set[str], spans: list[int]) -> str:
    """New text of a message: the kept words and what stands below a whole ancestor at the head of the unmarked tail, both without the spans of ancestors."""
    runs = list(zip(spans[::3], spans[1::3], spans[2::3]))
    quoted = [(b, e) for b, e, what in runs if what & NEW and not (ranges and b <= ranges[0] and ranges[-1] <= e)]  # what covers all new words is a copy
    ranges = list(ranges)
    while tail is not None:
        end = max((e for b, e, what in runs if b == tail_at and what & BODY), default=None)
        if end is None:
            break
        lines = tail.split("\n")
        k, at = 0, tail_at
        while k < len(lines) and at + (n := len(_plain(lines[k]).split())) <= end:
            k, at = k + 1, at + n
        lines = lines[k:]
        if lines and at < end:
            lines[0] = " ".join(_plain(lines[0]).split()[end - at :])
        _, _, more, _, tail_line, tail_at = _kept_words(lines, words, end)
        ranges += more
        tail = None if tail_line is None else "\n".join(lines[tail_line:])
    words, out = flat.split(" "), []
    for x, y in zip(ranges[::2], ranges[1::2]):
        gone = sorted((max(b, x), min(e, y)) for b, e in quoted if min(e, y) - max(b, x) >= min(MIN_CUT, e - b))  # fewer words may agree by chance beside a marked quotation
        for b, e in gone:
            out += words[x:b]
            x = max(x, e)
        out += words[x:y]
    return " ".join(out)


def _shortened(ranges: list[int], n: int) -> list[int]:
    """The ranges without their last ``n`` words."""
    ranges = list(ranges)
    while n and ranges:
        size = min(n, ranges[-1] - ranges[-2])
        n, ranges[-1] = n - size, ranges[-1] - size
        ranges = ranges[:-2] if ranges[-1] == ranges[-2] else ranges
    return ranges


_TEXT = ["flat", "ranges", "last", "tail", "tail_at", "sender"]
_OPEN = "array<struct<at: int, part: int, n: int, core: binary, whole: binary, first: bigint, several: boolean>>"


def _picked(words: list[str], ranges: list[int]) -> list[str]:
    return words if ranges == [0, len(words)] else [w for x, y in zip(ranges[::2], ranges[1::2]) for w in words[x:y]]


def _rest(row: dict, words: list[str], spans: list[int]) -> str:
    ranges = _shortened(row["ranges"], row["last"])
    if spans:
        return without_spans(row["flat"], ranges, row["tail"], row["tail_at"], sender_words(row["sender"]), spans)
    return " ".join(_picked(words, ranges))


def cut_whole_ancestors(rows: DataFrame) -> DataFrame:
    """(mid, new_text, spans, open, left): texts without whole ancestors; where something has to be compared further, ``open`` and the message instead."""

    def run(batches):
        gc.disable()  # as above
        for b in batches:
            new_text, spans, opened, left = [], [], [], []
            found_of = b["found"].to_pylist() if b["found"].null_count < len(b) else [None] * len(b)
            for *message, found in zip(*[b[c].to_pylist() for c in _TEXT], found_of):
                row = dict(zip(_TEXT, message))
                words, cut, open_ = row["flat"].split(" ") if row["flat"] else [], [], []
                if found:
                    cut, open_ = verified(words, _picked(words, row["ranges"]), found)
                new_text.append(None if open_ else _rest(row, words, cut))
                spans.append(cut if open_ else None)
                opened.append(open_ or None)
                left.append(row if open_ else None)
            yield pa.RecordBatch.from_arrays([b["mid"], *[pa.array(x, schema.field(c).type) for c, x in (("new_text", new_text), ("spans", spans), ("open", opened), ("left", left))]], schema=schema)
        gc.enable()

    left = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in _TEXT)
    kind = StructType.fromDDL(f"mid bigint, new_text string, spans array<int>, open {_OPEN}, left struct<{left}>")
    schema = to_arrow_schema(kind)
    return rows.select("mid", *_TEXT, "found").mapInArrow(run, kind)


def cut_partial_ancestors(parts: DataFrame, posts: DataFrame, cut: DataFrame) -> DataFrame:
    """(mid, new_text) of the messages with open places.

    Where several texts have a core, the words around it are looked up among all of them (by equality, so no text is
    lost); if none is there as a whole, they are compared with the first of them if that one is earlier in the same table.
    """
    rows = cut.where("open is not null")
    places = rows.select("mid", F.explode("open").alias("o")).select("mid", "o.*")
    asked = bounded_broadcast(places.where("several").select(*CORE, F.col("whole").alias("text")).distinct(), MAX_FIRSTS)
    known = posts.select(*CORE, "text").join(asked, [*CORE, "text"]).distinct().withColumn("known", F.lit(True)).withColumnRenamed("text", "whole")
    earlier = (F.col("first") % 2 == F.col("mid") % 2) & (F.col("first") < F.col("mid"))
    named = stash(places.join(known, [*CORE, "whole"], "left").withColumn("earlier", F.col("known").isNull() & earlier), "places")
    wanted = bounded_broadcast(named.where("earlier").select("first").distinct(), MAX_FIRSTS)
    firsts = parts.select(F.col("mid").alias("first"), F.struct("flat", "ranges").alias("words")).join(wanted, "first")
    one = F.struct("at", "n", "part", F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("earlier"), F.col("words")).alias("words"))
    by_text = named.join(firsts, "first", "left").groupBy("mid").agg(F.collect_list(one).alias("spots"))

    def run(batches):
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                words, spans = row["flat"].split(" "), list(row["spans"])
                for x in row["spots"]:
                    if x["known"]:
                        spans += [x["at"], x["at"] + x["n"], x["part"] & BODY | NEW]
                    elif (e := x["words"]) is not None:
                        spans += partial_span(words, x["at"], _picked(e["flat"].split(" "), e["ranges"]))
                out.append({"mid": row["mid"], "new_text": _rest(row, words, spans)})
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = StructType.fromDDL("mid bigint, new_text string")
    schema = to_arrow_schema(kind)
    return rows.select("mid", "spans", "left.*").join(by_text, "mid").mapInArrow(run, kind)


def newly_written(mail: DataFrame, threads: DataFrame) -> DataFrame:
    """(src, ord, pos, new_text) of every message that is not blank.

    Marked quotations, forwarded parts and the lines that introduce them are
    cut by their marks, sign-offs and what stands below them by the sender's
    name; the recurring closings of the corpus end texts that have no sign-off.
    Every whole body is then looked up in the index of the corpus: ancestors
    that stand unmarked are cut, and where an ancestor stands as a whole at the
    head of a forwarded text without marks, what is written below it stays.
    Null senders, subjects and lists are allowed; whole texts of any length are
    read; an empty table gives an empty result.
    """
    parts = stash(segment(messages_of(mail, threads)), "segments")
    keyed = parts.where("last_key is not null").select("mid", "last_key").join(recurring_closings(parts).withColumnRenamed("key", "last_key"), "last_key")
    posts = posted(parts)
    found = possible_ancestors(parts, ancestor_index(posts))
    rows = parts.select("mid", *_TEXT).join(found, "mid", "left").join(keyed.select("mid", F.lit(True).alias("closing")), "mid", "left").withColumn("last", F.when(F.col("closing"), F.col("last")).otherwise(0))
    cut = stash(cut_whole_ancestors(rows), "ancestors")
    return _named(cut.where("open is null").select("mid", "new_text").union(cut_partial_ancestors(parts, posts, cut)))


def quoted_messages(messages: DataFrame) -> DataFrame:
    """(mid, parent, n): of each message the first holder of the longest text of the others that it quotes as a whole.

    Found by fingerprints and verified word by word, marked or not; texts of fewer than MIN_WORDS words are no link.
    """
    parts = stash(segment(messages), "segments")
    found = possible_ancestors(parts, ancestor_index(posted(parts)), named=True)

    def run(batches):
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                words = row["flat"].split(" ")
                whole = [(x["n"], x["first"]) for x in row["found"] if x["at"] >= 0 and x["n"] < len(words) and _digest(words[x["at"] : x["at"] + x["n"]]) == x["text"]]
                if whole:
                    n, parent = max(whole, key=lambda x: (x[0], -x[1]))
                    out.append({"mid": row["mid"], "parent": parent, "n": n})
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = StructType.fromDDL("mid bigint, parent bigint, n int")
    schema = to_arrow_schema(kind)
    return parts.select("mid", "flat").join(found, "mid").mapInArrow(run, kind)
