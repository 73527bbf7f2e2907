"""Readings of free-typed names of organisations, job titles, places and people: pure functions on one value."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

#: Legal forms that may follow a company name.
LEGAL = ["inc", "incorporated", "llc", "ltd", "limited", "plc", "corp", "corporation", "co", "company", "gmbh", "s.a", "sa", "ag", "bv", "llp", "lp", "pty", "srl", "spa", "oy", "ab"]
_LEGAL = re.compile(r"[\s,]+(?:" + "|".join(re.escape(x) for x in LEGAL) + r")\.?$")
_VOWELS = set("aeiou")

#: Abbreviations in job titles that are neither the start nor a subsequence of the full word.
TITLE_SHORT = {"vp": "vice president", "hr": "human resources", "sw": "software", "biz": "business"}
#: Usual abbreviations in job titles, looked up where a typed one shortens no listed word.
ABBREVIATIONS = ["princ", "mktg", "mgr", "mngr", "engr", "eng", "ops", "devt", "dev", "fin", "prod", "recruit", "coord", "spec", "lab", "tech", "admin", "dir", "snr", "jnr", "pres", "des", "biz"]
#: Words of rank; they may stand after what they rank over ("design head").
RANKS = ["head", "director", "vice president", "vp"]
#: Short forms of the first word of a place.
PLACE_SHORT = {"mt": ["mount"], "st": ["saint"], "pt": ["port"], "ft": ["fort"], "no": ["north", "new"], "n": ["north", "new"], "so": ["south"], "s": ["south"], "e": ["east"], "w": ["west"]}

#: Everyday short forms of given names.
NICKNAMES = {
    "alexander": ["alex", "xander", "sandy", "al", "lex"], "abigail": ["abby", "gail", "abbie"], "andrew": ["andy", "drew"],
    "anthony": ["tony"], "benjamin": ["ben", "benny", "benji"], "charles": ["charlie", "chuck", "chas"],
    "christopher": ["chris", "kit", "topher"], "daniel": ["dan", "danny"], "deborah": ["deb", "debbie", "debby"],
    "edward": ["ed", "eddie", "ted", "ned", "teddy"], "elizabeth": ["liz", "beth", "betty", "eliza", "lizzie", "betsy", "libby"],
    "frederick": ["fred", "freddy", "freddie", "rick"], "gregory": ["greg"], "jacqueline": ["jackie", "jacqui"],
    "james": ["jim", "jimmy", "jamie"], "jennifer": ["jen", "jenny", "jenn"], "joseph": ["joe", "joey"],
    "katherine": ["kate", "kathy", "katie", "kit", "kitty", "kat", "kay"], "lawrence": ["larry"],
    "margaret": ["maggie", "meg", "peggy", "marge"], "matthew": ["matt"], "michael": ["mike", "mick", "mickey"],
    "nicholas": ["nick", "nico", "nicky"], "patricia": ["pat", "trish", "patty", "tricia"], "penelope": ["penny", "nell"],
    "rebecca": ["becky", "becca"], "richard": ["rick", "rich", "dick", "ricky", "richie"], "robert": ["rob", "bob", "bobby", "robbie", "bert"],
    "samantha": ["sam", "sammy"], "samuel": ["sam", "sammy"], "stephen": ["steve", "stevie"], "susan": ["sue", "susie", "suzie"],
    "theodore": ["ted", "theo", "teddy"], "thomas": ["tom", "tommy"], "timothy": ["tim", "timmy"],
    "victoria": ["vicky", "tori", "vic", "vicki"], "walter": ["walt", "wally"], "william": ["bill", "will", "liam", "billy", "willy"],
}
_FORMAL: dict[str, list[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short:
        _FORMAL.setdefault(_s, []).append(_full)
#: Titles before and marks after a person's name.
_BEFORE = re.compile(r"^(?:dr|prof|professor|mr|mrs|ms|miss|sir|dame|rev|hon)\.?\s+")
_AFTER = re.compile(r"[,\s]+(?:mba|phd|ph\.d|jd|md|esq|cpa|cfa|pmp|jr|sr|ii|iii|iv|msc|bsc|ma|ba|meng|llm)\.?$")


def fold(s: str) -> str:
    """Lower case, accents off, blanks squeezed."""
    if s.isascii():
        return " ".join(s.split()).lower()
    t = unicodedata.normalize("NFKD", s)
    return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip().lower()


def spelling_key(s: str) -> str:
    """Lower case, outer blanks removed, inner runs of blanks made one."""
    return re.sub(r"\s+", " ", s.strip()).lower()


def subsequence(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(maxsize=200_000)
def _expansions(token: str, vocabulary: frozenset[str]) -> tuple[str, ...]:
    """Words of the vocabulary that `token` may shorten: it starts them or is a subsequence, one swap allowed."""
    t = token.rstrip(".")
    if not t or t in vocabulary:
        return (t,)
    forms = {t} | {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(1, len(t) - 1)}
    hits = [w for w in vocabulary if len(t) < len(w) and w[0] == t[0] and any(f == w[: len(f)] or (len(f) >= 2 and subsequence(f, w) and (f[-1] == w[-1] or token.endswith(".") or sum(c in _VOWELS for c in f) <= 1)) for f in forms)]
    return tuple(sorted(hits, key=lambda w: (not w.startswith(t), len(w), w)))[:4] or (t,)


# ---- organisations


def company_tokens(s: str, sectors: frozenset[str]) -> tuple[list[str], bool]:
    """(words of a company name without article, legal form and conjunctions, in natural order; were words initials?)."""
    t = re.sub(r"\s*[&+]\s*", " and ", fold(s))
    if t.startswith("the "):
        t = t[4:]
    while (u := _LEGAL.sub("", t)) != t and u:
        t = u.strip(" ,")
    if "," in t:
        a, _, b = t.partition(",")
        t = f"{b.strip()} {a.strip()}"
    words = [w for w in re.split(r"[\s\-/_]+", t) if w and w != "and"]
    if len(words) > 1 and words[0] in sectors and words[-1] not in sectors:
        words = words[1:] + words[:1]
    initials = len(words) > 1 and all(len(w.rstrip(".")) == 1 for w in words[1:])
    out = words[:1]
    for w in words[1:]:
        out.append(w.rstrip(".") if initials else _expansions(w, sectors)[0])
    return [re.sub(r"[^\w]", "", w) for w in out if re.sub(r"[^\w]", "", w)], initials


def consonants(s: str) -> str:
    return "".join(c for c in s if c not in _VOWELS)


def company_reading(s: str, sectors: frozenset[str]) -> tuple[str, str]:
    """(kind, key) of a typed name: `i` head and initials, `a` acronym, else `n` the words joined."""
    words, initials = company_tokens(s, sectors)
    if initials:
        return "i", words[0] + "|" + "".join(words[1:])
    if len(words) == 1 and 3 < len(words[0]) < 9 and words[0].isalpha() and not _VOWELS & set(words[0][:-1]):
        return "a", words[0]
    return "n", "".join(words)


def company_forms(s: str, sectors: frozenset[str]) -> dict[str, str]:
    """The keys under which a clean name may be typed: joined words, head with initials, acronym, without its last word, head alone."""
    words, _ = company_tokens(s, sectors)
    if not words:
        return {}
    out = {"n": "".join(words)}
    if len(words) > 1:
        out |= {"i": words[0] + "|" + "".join(w[0] for w in words[1:]), "a": consonants(words[0]) + words[-1][0], "b": "".join(words[:-1]), "h": words[0]}
    return out


# ---- titles


def title_key(words: Iterable[str]) -> str:
    return "".join(w for w in words if w not in ("of", "for"))


def title_words(s: str) -> list[str]:
    t = re.sub(r"\bh\.\s*r\.(?=\s|$)", "hr ", s)
    t = re.sub(r"\bs/w\b", "sw", re.sub(r"\bv\.\s*p\.(?=\s|$)", "vp ", t))
    return [w for w in re.split(r"[\s\-/]+", re.sub(r"[^\w\s.\-/]", " ", t)) if w and w != "."]


@lru_cache(maxsize=200_000)
def _title_choices(w: str, vocabulary: frozenset[str]) -> list[str]:
    """Full words a word of a title may stand for; an abbreviation may itself hold one typing error."""
    w0 = w.rstrip(".")
    found = list(_expansions(w, vocabulary))
    if w0 in vocabulary:
        return found
    if w0 not in ABBREVIATIONS and (found == [w0] or len(w0) < 8):
        for a in ABBREVIATIONS:
            if len(a) > 2 and abs(len(a) - len(w0)) < 2 and a != w0 and _one_edit(a, w0):
                found += [TITLE_SHORT[a]] if a in TITLE_SHORT else [x for x in _expansions(a + ".", vocabulary) if x != a]
    return list(dict.fromkeys([*found, *([] if w.endswith(".") else [w0])]))[:6]


def _one_edit(a: str, b: str) -> bool:
    """At most one letter added, left out, changed or swapped with its neighbour."""
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) < 2 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def title_paths(titles: Iterable[list[str]]) -> dict:
    """The words of listed titles as a tree: each word leads to those that may follow, and None marks an end."""
    top: dict = {}
    for words in titles:
        at = top
        for w in words:
            if w not in ("of", "for"):
                at = at.setdefault(w, {})
        at[None] = {}
    return top


def _walk(choices: list[list[str]], at: dict, k: int = 0, said: str = "") -> Iterable[str]:
    """Keys of all listed titles that take one choice for each word: as many steps as the list has such beginnings."""
    if k == len(choices):
        if None in at and said:
            yield said
        return
    for choice in choices[k]:
        node: dict | None = at
        for w in choice.split():
            node = node.get(w) if node is not None and w not in ("of", "for") else node
        if node is not None:
            yield from _walk(choices, node, k + 1, said + title_key(choice.split()))


def title_readings(s: str, vocabulary: frozenset[str], paths: dict | None = None) -> list[tuple[int, str]]:
    """(rank, key) of the ways to read a typed title: all words in order or turned round first, then without remarks.

    Every listed title (`paths`) that takes one choice for each word is among them; of combinations that are listed
    nowhere and might be one with a typing error, the first 32."""
    t = fold(s)
    parts: list[tuple[int, str]] = [(0, t)]
    m = re.fullmatch(r"(.*?)\s*\(([^)]*)\)\s*", t)
    if m:
        parts.append((0, f"{m[2]} {m[1]}"))
    if "," in t:
        a, _, b = t.rpartition(",")
        parts.append((0, f"{b.strip()} {a.strip()}"))
    for cut in (r"\s+(?:at|@)\s+", r"\s*\|\s*", r"\s*\(", r"\s+-\s+", r"\s*,\s*"):
        pieces = re.split(cut, t)
        if len(pieces) > 1 and pieces[0]:
            parts.append((1, pieces[0]))
            if "," in pieces[0]:
                a, _, b = pieces[0].rpartition(",")
                parts.append((1, f"{b.strip()} {a.strip()}"))
    for rank, p in list(parts):
        for end in RANKS:
            if p.endswith(" " + end):
                parts.append((rank, f"{end} {p[: -len(end) - 1]}"))
    out: dict[str, int] = {}
    for rank, p in parts:
        choices = []
        for w in title_words(p):
            w0 = w.rstrip(".")
            choices.append([TITLE_SHORT[w0]] if w0 in TITLE_SHORT else _title_choices(w, vocabulary))
        for combo in itertools.islice(itertools.product(*choices), 32):
            key = title_key(x for w in combo for x in w.split())
            if key:
                out[key] = min(rank, out.get(key, 9))
        for key in _walk(choices, paths or {}):
            out[key] = min(rank, out.get(key, 9))
    return [(r, k) for k, r in out.items()]


# ---- places


def place_readings(s: str) -> list[tuple[str, tuple[str, ...]]]:
    """(city joined, parts that may name its region or country) for the ways to read a typed place."""
    t = re.sub(r"\bgreater\b|\barea\b|\bmetro(?:politan)?\b", " ", fold(s))
    parts = [re.sub(r"\s+", " ", p).strip(" .") for p in re.split(r"[,/:()|;]|\s-\s", t)]
    parts = [p for p in parts if p]
    out: list[tuple[str, tuple[str, ...]]] = []

    def cities(p: str) -> list[str]:
        words = p.split()
        first = words[0].rstrip(".")
        heads = PLACE_SHORT.get(first, []) if len(words) > 1 else []
        glued = re.fullmatch(r"(mt|st|pt|ft|no|n)\.(\w+)", words[0])
        if glued:
            return [h + glued[2] + "".join(words[1:]) for h in PLACE_SHORT[glued[1]]]
        return [h + "".join(words[1:]) for h in heads] or ["".join(words)]

    for k, p in enumerate(parts):
        rest = tuple(parts[:k] + parts[k + 1 :])
        for c in cities(p):
            out.append((re.sub(r"\W", "", c), rest))
        words = p.split()
        if len(words) > 1 and len(words[-1]) == 2:  # "Port Example PX"
            for c in cities(" ".join(words[:-1])):
                out.append((re.sub(r"\W", "", c), (words[-1], *rest)))
    return list(dict.fromkeys(out))


# ---- people


def respelled(s: str) -> str:
    """One spelling for sounds that are often written differently."""
    for a, b in (("ph", "f"), ("ck", "k"), ("y", "i"), ("qu", "kv"), ("tz", "z")):
        s = s.replace(a, b)
    return s if s.isascii() and s.isalpha() else re.sub(r"[^a-z]", "", s)


_PLAIN = re.compile(r"([a-z]{2,}) ([a-z]{2,})")
_MARKED = re.compile(r"(?:dr|prof|professor|mr|mrs|ms|miss|sir|dame|rev|hon) .*|.* (?:mba|phd|jd|md|esq|cpa|cfa|pmp|jr|sr|ii|iii|iv|msc|bsc|ma|ba|meng|llm)")


def person_parts(s: str) -> tuple[str, str, str] | None:
    """(given name, family name respelled, family name), folded; None if there are not two words. Middle names, titles, marks, maiden and
    second family names are left out; "Family, Given" is turned round."""
    low = s.lower()
    if (m := _PLAIN.fullmatch(low)) and not _MARKED.fullmatch(low):
        return m[1], respelled(m[2]), m[2]
    t = re.sub(r"\([^)]*\)", " ", fold(s))
    t = re.sub(r"\s+", " ", t).strip(" ,")
    while (u := _AFTER.sub("", t)) != t:
        t = u.strip(" ,")
    while (u := _BEFORE.sub("", t)) != t:
        t = u
    turned = "," in t
    if turned:
        a, _, b = t.partition(",")
        t = f"{b.strip()} {a.strip()}"
    words = [w.strip(".'") for w in re.split(r"[\s.]+", t) if w.strip(".'")]
    if len(words) < 2:
        return None
    if len(words[-1]) == 1 and not turned and len(words) == 2:
        words.reverse()
    given, family = words[0], words[-1].split("-")[0]
    return given, respelled(family), re.sub(r"[^a-z]", "", family)


def formal_names(given: str) -> list[str]:
    """The given names a typed one may stand for: itself and, for short forms, the full ones."""
    return [given, *_FORMAL.get(given, [])]
