"""Variant spellings of names typed by people, linked to one entity.

Every surface of a row (its name and aliases) is parsed into a key: surname
with given name, family with line of business, or project with phase.  Equal
keys are merged before anything is compared.  Distinct keys are blocked by
phonetic codes of their tokens, compared with Jaro-Winkler and the nickname
table, and accepted pairs are clustered with the rows that carry them as
connected components.  Forms that name an entity only in part (initials,
acronyms, bare families) join afterwards, where exactly one entity fits.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lorespan.operators.components import connected_components
from lorespan.session import stash

TYPES = ("User", "Organization", "Project")

# Given names with their usual short forms.
GIVEN_NAMES = {
    "abigail": "abby gail abbie", "alexander": "alex sasha xander alec", "amara": "", "andrew": "andy drew", "anthony": "tony", "astrid": "", "benjamin": "ben benny benji", "bjorn": "", "bram": "", "charles": "charlie chuck chas",
    "chloe": "", "christopher": "chris kit topher", "cleo": "", "dana": "", "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "edward": "ed eddie ted teddy ned", "ekaterina": "katya", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty lizzie eliza betsy libby",
    "fatima": "", "felix": "", "francisco": "paco pancho", "frederick": "fred freddie freddy", "giuseppe": "pino beppe", "gregory": "greg gregg", "guadalupe": "lupe", "gunnar": "", "helga": "", "hiro": "", "hugo": "", "ida": "", "ines": "", "ingrid": "inga", "iris": "", "jacqueline": "jackie jacqui",
    "james": "jim jimmy jamie", "jarek": "", "jennifer": "jen jenny jenn", "johannes": "hannes hans", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "katherine": "kate kathy katie kat", "kenji": "ken", "kwame": "", "lawrence": "larry", "leila": "", "lucia": "lucy", "marek": "",
    "margaret": "maggie meg peggy marge", "matthew": "matt", "mei": "", "michael": "mike mick mikey", "nicholas": "nick nicky", "noor": "", "olga": "", "omar": "", "oscar": "", "patricia": "pat patty trish tricia", "penelope": "penny", "petra": "", "priya": "", "quentin": "quinn", "ravi": "", "rebecca": "becky becca",
    "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie", "samuel": "sam sammy", "stephen": "steve steven stevie", "susan": "sue susie suzy", "sven": "", "tariq": "", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "toby", "ulf": "", "ursula": "uschi", "valeria": "val", "vera": "",
    "victoria": "vicky tori vicki", "wilhelmina": "mina wilma", "william": "bill will billy liam willy", "wren": "", "xenia": "", "yusuf": "", "zoe": "", "aiko": "", "john": "jack johnny", "david": "dave davey", "peter": "pete", "philip": "phil", "ronald": "ron", "donald": "don", "kenneth": "kenny", "raymond": "ray", "alfred": "alf", "barbara": "barb", "catherine": "cathy cate",
}
# Titles, legal forms and words of business with their abbreviations.
TITLES = set("mr mrs ms miss dr prof professor sir herr frau mme mlle monsieur madame sr sra".split())
LEGAL = set("inc incorporated corp corporation ltd limited co company grp group hldgs holdings holding llc llp lp plc gmbh ag sa spa bv nv".split())
BUSINESS = {
    "associates": "assoc assocs", "capital": "cap", "energy": "engy nrg", "engineering": "engrg eng engr", "gas": "", "legal": "lgl", "management": "mgmt mgt", "marketing": "mktg mkt", "partners": "ptnrs ptrs", "pipeline": "pipln pl ppl", "power": "pwr", "resources": "res rsrcs", "services": "svcs svc srvcs", "shipping": "shpg shpng",
    "storage": "stor stg", "trading": "trdg", "transmission": "trans xmsn", "water": "wtr", "works": "wks", "supply": "sply", "consulting": "conslt", "industries": "ind inds", "international": "intl", "systems": "sys", "technologies": "tech", "logistics": "logs", "solutions": "soln",
}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "one": "1", "two": "2", "three": "3"}

_FULL_GIVEN = {n: full for full, short in GIVEN_NAMES.items() for n in [full, *short.split()]}
_FULL_BUSINESS = {n: full for full, short in BUSINESS.items() for n in [full, *short.split()]}
#: Least Jaro-Winkler similarity of two spellings of a token that differ by one edit (a swap of neighbours counts once), of two
#: longer ones that differ by more, and of both tokens if both are misspelt; letters of a longer token.
ONE_EDIT, MORE_EDITS, BOTH, LONG = 0.85, 0.93, 0.9, 7
#: Most letters of a surname that is blocked less one letter, and largest edit distance (a swap counts twice) of keys that are compared.
SHORT, MAX_DISTANCE = 6, 4


def fold(text: str) -> str:
    """Letters without accents."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in text if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity with a prefix of up to four letters weighing 0.1 each."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, pairs_a = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                pairs_a.append(c)
                break
    m = len(pairs_a)
    if not m:
        return 0.0
    pairs_b = [c for c, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(pairs_a, pairs_b)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def one_edit(a: str, b: str) -> bool:
    """True if one insertion, deletion, replacement or swap of neighbours makes ``b`` of ``a``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _close(a: str, b: str) -> bool:
    """True if two tokens are spellings of one: by Jaro-Winkler similarity, whose bound is higher beyond one edit."""
    bound = ONE_EDIT if one_edit(a, b) else MORE_EDITS if min(len(a), len(b)) >= LONG else 2.0
    return bound <= 1 and jaro_winkler(a, b) >= bound


def _both_close(a: str, b: str, c: str, d: str) -> bool:
    """True if both tokens of two names are misspelt, each by one edit only."""
    return min(map(len, (a, b, c, d))) > 4 and all(one_edit(x, y) and jaro_winkler(x, y) >= BOTH for x, y in ((a, b), (c, d)))


def _near(token: str, words) -> str | None:
    """The word that ``token`` misspells; None if it is too short or far from all."""
    return next((w for w in words if len(w) > 4 and _close(token, w)), None) if len(token) > 4 else None


def parse_person(text: str) -> tuple[str, str, str, str] | None:
    """(kind, given, surname, middle initial); kind strong has a full given name, weak an initial."""
    raw = fold(text).strip()
    if "@" in raw:
        parts = [p for p in re.split(r"[._\-]+", raw.lower().split("@")[0].strip("<> ")) if p.isalpha()]
        if len(parts) >= 2:
            first, last, middle = parts[0], parts[-1], parts[1][0] if len(parts) > 2 else ""
            return ("weak" if len(first) == 1 else "strong", _FULL_GIVEN.get(first, first), last, middle)
        return ("weak", parts[0][0], parts[0][1:], "") if parts and len(parts[0]) > 4 else None
    raw = re.sub(r"/[A-Z]{2,4}(/.*)?$", "", raw)
    if m := re.fullmatch(r"\s*([A-Za-z'\-]+)\s*\(\s*([A-Za-z])\.?\s*\)\s*", raw):
        return ("weak", m[2].lower(), m[1].lower(), "")
    comma = re.match(r"^\s*([^,]+),\s*(.+)$", raw)
    if comma:
        raw = f"{comma[2]} {comma[1]}"
    words = [w for w in re.split(r"[^A-Za-z'\-]+", raw) if w]
    words = [w for w in words if w.lower() not in TITLES]
    if not words:
        return None
    if len(words) == 1:
        w = words[0].lower()
        return ("weak", w[0], w[1:], "") if len(w) > 5 and words[0].islower() and w not in _FULL_GIVEN else None
    if len(words) == 2 and re.fullmatch(r"[A-Z]{1,2}", words[1]) and len(words[0]) > 2 and not comma and not words[0].isupper():
        return ("weak", words[1][0].lower(), words[0].lower(), words[1][1:].lower())
    low = [w.lower() for w in words]
    first, last = low[0], low[-1]
    if re.match(rf"(?i)^\W*(?:[a-z]+\.\s+)?{re.escape(words[0])}\.", raw) and len(first) <= 3:
        return ("weak", first[0], last, "")
    if len(low) == 2 and not comma and first not in _FULL_GIVEN and (last in _FULL_GIVEN or (_near(last, GIVEN_NAMES) and not _near(first, GIVEN_NAMES))):
        first, last = last, first
    middle = next((w[0] for w in low[1:-1] if len(w) <= 2), "")
    if len(last) == 1 and len(first) > 1:
        return ("weak", last, first, "")
    if len(first) == 1:
        return ("weak", first, last, middle)
    return ("strong", _FULL_GIVEN.get(first, first), last, middle)


def parse_firm(text: str) -> tuple[str, str, str, str] | None:
    """(kind, line of business, family, acronym); kind weak has the family or the acronym alone."""
    raw = fold(text).strip()
    plain = raw.replace(".", "")
    if re.fullmatch(r"[A-Z]{2,5}", plain):
        return ("acronym", "", plain.lower(), "")
    if m := re.match(r"(?i)^\s*(.+?)\s+of\s+([A-Za-z]+)\s*$", raw):
        raw = f"{m[2]} {m[1]}"
    elif m := re.match(r"^\s*(.+?),\s*([A-Za-z]+)\s*$", raw):
        if m[2].lower() not in LEGAL and not _near(m[2].lower(), LEGAL):
            raw = f"{m[2]} {m[1]}"
    words = [w for w in re.split(r"[^a-z]+", raw.lower()) if w and w != "the"]
    kept, letters = [], []
    for k, w in enumerate(words):
        legal = w in LEGAL or (k >= 2 and k == len(words) - 1 and _near(w, LEGAL))
        letters.append(w[0])
        if not legal or k == 0:
            kept.append(_FULL_BUSINESS.get(w, w))
    if not kept:
        return None
    family, line = kept[0], "".join(kept[1:])
    acronym = "".join(letters) if len(words) > len(kept) else ""
    return ("strong", line, family, acronym) if line else ("weak", "", family, "")


def parse_project(text: str) -> tuple[str, str, str, str] | None:
    """(strong, phase, name, '')."""
    words = [w for w in re.split(r"[^a-z0-9]+", fold(text).lower()) if w]
    phase, name, k = "", [], 0
    while k < len(words):
        w = words[k]
        if (w in ("phase", "ph") or _near(w, ("phase",))) and k + 1 < len(words):
            phase = ROMAN.get(words[k + 1], words[k + 1])
            k += 1
        elif w not in ("the", "project", "proj", "prj") and not _near(w, ("project",)):
            name.append(w)
        k += 1
    if len(name) == 2 and name[1] in ROMAN and not phase:
        phase = ROMAN[name.pop()]
    return ("strong", phase, "".join(name), "") if name else None


_PARSERS = {"User": parse_person, "Organization": parse_firm, "Project": parse_project}


def parse_surfaces(entities: DataFrame) -> DataFrame:
    """(ord, entity_type, kind, q, s, m): a key of each surface of each row, repeated ones once."""

    def parse(batches):
        for b in batches:
            out = []
            for o, name, kind, aliases in zip(b["ord"], b["name"], b["entity_type"], b["aliases"]):
                surfaces = [name, *(aliases if aliases is not None else [])]
                keys = {_PARSERS[kind](x) for x in surfaces if x is not None and x.strip()}
                out += [(o, kind, *k) for k in keys if k]
            yield pd.DataFrame(out, columns=["ord", "entity_type", "kind", "q", "s", "m"])

    rows = entities.where(F.col("entity_type").isin(*TYPES)).select("ord", "name", "entity_type", "aliases")
    return rows.mapInPandas(parse, "ord bigint, entity_type string, kind string, q string, s string, m string")


@F.pandas_udf(BooleanType())
def same_name(kind: pd.Series, q1: pd.Series, s1: pd.Series, q2: pd.Series, s2: pd.Series) -> pd.Series:
    """True if two keys are spellings of one: one token misspelt and the other equal, or both misspelt slightly."""

    def same(kind: str, qa: str, sa: str, qb: str, sb: str) -> bool:
        if kind == "Project":
            return qa == qb and len(sa) > 3 and _close(sa, sb)
        if kind == "User" and qa in GIVEN_NAMES and qb in GIVEN_NAMES and qa != qb:
            return False
        if sa + qa == sb + qb:
            return True
        if qa != qb and sa != sb:
            return _both_close(sa, sb, qa, qb)
        return (qa == qb and min(len(sa), len(sb)) > 3 and _close(sa, sb)) or (sa == sb and min(len(qa), len(qb)) > 2 and _close(qa, qb))

    return pd.Series([same(*x) for x in zip(kind, q1, s1, q2, s2)])


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """Distinct strong keys that share a block and are near in letters; keys has key, entity_type, q, s.

    Blocks are phonetic codes of the sorted tokens; one token with the
    beginning or end of the other; and, for short surnames, the given name with
    the surname less one letter.  So one misspelling leaves a block intact.  No
    block is one token alone: all bearers of a surname never meet.
    """
    both = F.concat_ws(" ", F.array_sort(F.array(F.soundex("q"), F.soundex("s"))))
    third, none = F.lit(3), F.array().cast("array<string>")
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1))), lambda i: F.concat(F.lit("d"), F.col("q"), F.lit("|"), F.substring(F.col("s"), F.lit(1), i - 1), F.substring(F.col("s"), i + 1, F.length("s"))))
    blocks = F.array_distinct(F.concat(F.array(
        F.concat(F.lit("c"), both),
        F.concat(F.lit("p"), F.col("s"), F.lit("|"), F.left("q", F.lit(2))),
        F.concat(F.lit("e"), F.col("s"), F.lit("|"), F.right("q", F.lit(2))),
        F.concat(F.lit("a"), F.col("q"), F.lit("|"), F.left("s", third)),
        F.concat(F.lit("z"), F.col("q"), F.lit("|"), F.right("s", third)),
        F.concat(F.lit("d"), F.col("q"), F.lit("|"), F.col("s")),
        F.concat(F.lit("w"), F.col("s"), F.col("q")),
    ), F.when(F.length("s") <= SHORT, less).otherwise(none)))
    left = keys.select("entity_type", F.explode(blocks).alias("block"), F.col("key").alias("a"), F.col("q").alias("qa"), F.col("s").alias("sa"))
    right = left.toDF("entity_type", "block", "b", "qb", "sb")
    near = F.levenshtein("sa", "sb") + F.levenshtein("qa", "qb") <= MAX_DISTANCE
    near = near | (F.concat("sa", "qa") == F.concat("sb", "qb"))
    return left.join(right, ["entity_type", "block"]).where("a < b").where(near).select("entity_type", "a", "qa", "sa", "b", "qb", "sb").distinct()


def key_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): distinct strong keys accepted as spellings of one name."""
    return candidate_pairs(keys).where(same_name("entity_type", "qa", "sa", "qb", "sb")).select("a", "b")


def link_names(entities: DataFrame) -> DataFrame:
    """(ord, cluster) of every row of a linked type that shares its entity with another row.

    Rows of other types, null and blank names and aliases are skipped; a name
    that cannot be parsed links nothing; equal rows link to each other.
    """
    parsed = parse_surfaces(entities)
    key = F.concat_ws("|", F.lit("k"), "entity_type", "q", "s")
    surfaces = stash(parsed.withColumn("key", key), "surfaces")
    strong = surfaces.where("kind = 'strong'")
    keys = strong.select("key", "entity_type", "q", "s").distinct()
    carries = strong.select(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("a"), F.col("key").alias("b"))
    parts = stash(connected_components(stash(key_pairs(keys).union(carries), "name_links")), "name_parts")
    by_row = parts.where("node like 'r%'").select(F.substring("node", 2, 20).cast("bigint").alias("ord"), "component")

    # Forms in part: the only entity that fits.
    whole = strong.join(by_row, "ord")
    initial = F.when(F.col("entity_type") == "User", F.left("q", F.lit(1))).otherwise("")
    only = lambda df, *by: df.groupBy(*by).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    fits = only(whole.select("entity_type", initial.alias("i"), "s", "component"), "entity_type", "i", "s")
    fits_middle = only(whole.where("entity_type = 'User' and m != ''").select(initial.alias("i"), "s", "m", "component"), "i", "s", "m")
    fits_acronym = only(whole.where("entity_type = 'Organization' and m != ''").select("m", "component"), "m")
    rest = surfaces.where("kind != 'strong'").join(by_row, "ord", "left_anti").withColumn("i", F.when(F.col("entity_type") == "User", F.col("q")).otherwise(""))
    weak, acronym = rest.where("kind = 'weak'"), rest.where("kind = 'acronym'")
    weak = weak.join(fits, ["entity_type", "i", "s"], "left").join(fits_middle.toDF("i", "s", "m", "low_m", "high_m"), ["i", "s", "m"], "left")
    chosen = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low_m") == F.col("high_m"), F.col("low_m")).when(F.col("low").isNull(), F.concat_ws("|", F.lit("w"), "entity_type", "i", "s"))
    weak = weak.select("ord", chosen.alias("component"))
    acronym = acronym.select("ord", "s").join(fits_acronym.withColumnRenamed("m", "s"), "s", "left")
    acronym = acronym.select("ord", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNull(), F.concat(F.lit("w|acronym|"), "s")).alias("component"))
    partial = weak.union(acronym).where("component is not null").groupBy("ord").agg(F.min("component").alias("component"))
    return by_row.union(partial).select("ord", F.col("component").alias("cluster"))


def same_entity_pairs(entities: DataFrame) -> DataFrame:
    """(ord_a, ord_b): all pairs of rows of one entity, the smaller ``ord`` first."""
    linked = stash(link_names(entities), "named")
    other = linked.toDF("ord_b", "cluster")
    return linked.join(other, "cluster").where("ord < ord_b").select(F.col("ord").alias("ord_a"), "ord_b")


def entity_clusters(entities: DataFrame) -> DataFrame:
    """(ord, cluster, representative): membership of every row of an entity that has several, and the smallest ``ord`` of it.

    The scalable form of :func:`same_entity_pairs`: a row per member instead of all pairs.
    """
    linked = stash(link_names(entities), "named")
    first = linked.groupBy("cluster").agg(F.min("ord").alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return linked.join(first, "cluster").select("ord", "cluster", "representative")
