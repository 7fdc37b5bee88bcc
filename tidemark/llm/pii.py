"""Problem 1: personal information in free text, by offset-preserving deobfuscation.

A text is folded and rewritten (lookalike letters, spelled digits, ``(at)`` and ``DOT`` disguises)
while each character keeps its source offsets; identifiers are detected in the rewritten text and
their spans mapped back to the source, where typed placeholders replace them.

Nulls and blank texts have no mentions and come back as they are; texts are read whole, whatever
their length; repeated rows give the same answer; other columns are passed through untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arrow import map_batches, spread
from tidemark.llm.spans import Spans

TYPES = ("email", "phone", "id_number", "address", "person_name")

#: Common given names in several languages.
GIVEN = """
Adam Ahmed Aiko Alice Amara Amina Amir Andrea Anita Anna Antonio Arjun Astrid Ben Boris Bruno Carla Carlos Carmen
Chen Chloe Clara Daniel Dana Darius David Diego Dmitri Elena Elif Elias Emil Emma Erik Eva Fatima Felix Finn Franz
Freya George Giulia Grace Greta Gustav Hana Hanna Hans Hassan Helena Henrik Hiro Hugo Ibrahim Idris Ines Ingrid Irene
Iris Isabel Ivan Jack James Jan Jana Javier Jean Joel Johan John Jonas Jose Julia Karim Karin Katja Kenji Klara Kofi
Lars Laura Layla Lea Leila Lena Leo Lina Louis Luca Lucia Luis Maja Marco Maria Marie Mario Mark Marta Martin Mary
Mateo Matteo Max Maya Mehmet Mia Milan Mina Miriam Mohammed Nadia Naomi Natalia Nils Nina Noah Nora Olga Oliver Omar
Oskar Otto Pablo Paul Pavel Pedro Peter Petra Pierre Priya Rafael Rahul Ravi Robert Rosa Rose Ruth Samir Samuel Sana
Sara Selma Sofia Sonja Stefan Sven Tariq Tessa Thomas Tomas Ursula Vera Viktor Vlad Wei Will William Yara Yuki Yusuf
Zara Zoe
""".split()

#: Given names that are also everyday words, trusted only before a capitalised surname.
EVERYDAY = set("will mark rose grace iris ruth chen wei jack max ben dana hana sana may jan jean leo finn".split())

#: Titles put before a family name.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Mlle Don Doña Sir Dame".split()

#: Endings by which many family names are known.
SURNAME_ENDINGS = (
    "adze aran akis anger bury berg dottir eford ello escu evik evic fen inder idis ikson marn moor ogawa opoulos ovic "
    "ovitz owski quist sson shvili son stein thorpe uzzi wick wala yan enko ez ini etti"
).split()

#: Words that make a capitalised group a place, firm, club or pub, not a person.
NOT_FAMILY = set(
    """
    street st road rd avenue ave lane ln drive close court way terrace row place square boulevard crescent hill park
    bridge station library council studio garage choir bakery club rowing cup league arms inn tavern pub cafe hotel
    museum school college university hospital church society company bank press shop market gallery theatre festival
    ltd inc gmbh llc and sons brothers partners group foundation trust office department ministry monday tuesday
    wednesday thursday friday saturday sunday january february march april may june july august september october
    november december the a an of to in on at is was has had will would can not day week year i it we you they he she
    """.split()
)

LETTERS = re.compile(r"[a-zà-ÿ]+")
_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0", "null": "0"}
_WORD = "|".join(_DIGITS)
SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:double|triple)[\s-]+)?(?:{_WORD})(?:[\s,.-]+(?:(?:double|triple)[\s-]+)?(?:{_WORD})){{5,}}(?!\w)")
AT = re.compile(r"\s*[\[({<]\s*(?:at|AT|@)\s*[\])}>]\s*")
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|DOT|\.)\s*[\])}>]\s*")
AT_DOT = re.compile(r"(?i)(?<=[\w+])\s+at\s+((?:[a-z0-9-]+)(?:\s+dot\s+[a-z0-9-]+)+)(?!\w)")
AT_PLAIN = re.compile(r"(?i)(?<=[\w+])\s+AT\s+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|edu|io|co|uk|de|fr|es|example|test|invalid)(?![\w-]))")
AT_SPACE = re.compile(r"(?<=[\w+])\s*@\s*(?=[A-Za-z0-9-]+\s*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")


def _spelled(m: re.Match) -> str:
    out, times = "", 1
    for word in re.findall(r"[a-z]+", m[0].lower()):
        if word in ("double", "triple"):
            times = 2 if word == "double" else 3
        else:
            out, times = out + _DIGITS[word] * times, 1
    return out


def deobfuscate(text: str, tokens: list[str] | None = None) -> Spans:
    """The chain of transducers; offsets into ``text`` survive every step.

    ``tokens``: the lower-case words of the text, to skip steps that have nothing to work on.
    """
    s = Spans(text).fold()
    if tokens is None or not text.isascii():
        tokens = LETTERS.findall(s.text.lower())
    if sum(t in _DIGITS for t in tokens) > 5:
        s.rewrite(SPELLED, _spelled)
    if "@" in s.text or "at" in tokens:
        s.rewrite(AT, lambda m: "@")
        if "dot" in tokens or "@" in s.text:
            s.rewrite(DOT, lambda m: ".")
        if "dot" in tokens:
            s.rewrite(AT_DOT, lambda m: "@" + re.sub(r"(?i)\s+dot\s+", ".", m[1]))
        if "AT" in s.text or " at " in s.text and "." in s.text:
            s.rewrite(AT_PLAIN, lambda m: "@")
        if "@" in s.text:
            s.rewrite(AT_SPACE, lambda m: "@")
    return s


EMAIL = re.compile(r"(?<![\w.+@/-])[A-Za-z0-9_](?:[\w.+-]*[\w+])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@])")
#: Top-level domains trusted where a text ends inside or right after an address.
ENDINGS = set("com org net edu gov io co de fr es uk us ca au it nl eu info example test invalid".split())

PHONES = [
    re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){1,6}(?![\w@]|-\d|\.\d)"),
    re.compile(r"(?<![\w+.\-/])(?:\+?1[ .\-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[ .\-]?\d{3}[ .\-]?\d{4}(?![\w@]|-\d|\.\d)"),
    re.compile(r"(?<![\w+.,\-/])0\d{1,4}(?:[ .\-/]\d{2,6}){1,4}(?![\w@]|-\d|\.\d)"),
    re.compile(r"(?<![\w+.,\-/])0[1-9]\d{8,9}(?![\w@]|-\d|\.\d)"),
]
NOT_PHONE = re.compile(r"(?i)(?:order|serial|ticket|isbn|build|invoice|parts?|ref|tracking|version|score is|coordinates)\W{0,3}(?:no\.?|number)?\W*$")
ID_CUE = re.compile(
    r"(?i)\b(?:ssn|social(?: security)?|id|ids|identity|identification|citizen|personal number|tax file|tax id|licen[cs]e|passport|dni|"
    r"ausweis\w*|steuer\w*|insurance|ni number|nino|national|payroll|nie|card)\b"
)
IDS = [
    (re.compile(r"(?<![\w\-])\d{3}([\- ])\d{2}\1\d{4}(?![\w]|-\d)"), False),
    (re.compile(r"(?<![\w\-+])\d{9}(?![\w]|-\d)"), True),
    (re.compile(r"(?i)(?<![\w\-])[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d](?!\w)"), False),
    (re.compile(r"(?i)(?<![\w\-])\d{8}-?[trwagmyfpdxbnjzsqvhlcke](?!\w)"), False),
    (re.compile(r"(?i)(?<![\w\-])[xyz]\d{7}[a-z](?!\w)"), False),
    (re.compile(r"(?i)(?<![\w\-])[a-z]-\d{3}-\d{4}-\d(?!\w|-\d)"), False),
    (re.compile(r"(?i)(?<![\w\-])[a-z]{2}\d{7}(?!\w)"), False),
    (re.compile(r"(?<![\w\-])[CFGHJKLMNPRTVWXYZ][0-9][0-9CFGHJKLMNPRTVWXYZ]{7}(?!\w)"), False),
    (re.compile(r"(?<![\w\-])[cfghjklmnprtvwxyz][0-9][0-9cfghjklmnprtvwxyz]{7}(?!\w)"), True),
]

_KIND = (
    r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Close|Court|Ct|Way|Terrace|Ter|Row|Place|Pl|Square|Sq|Crescent|Gardens|Mews|Parade)"
)
_SIDE = r"(?:(?:North|South|East|West|[NSEW])\.? +)?"
_STOP = (
    r"(?!(?:the|a|an|of|on|in|to|at|by|my|your|his|her|our|their|and|or|for|from|with|past|is|was|it|that|this|than|then|"
    r"days?|weeks?|months?|years?|hours?|nights?|minutes?|seconds?|times|attempts|points|main|people|bad|good|other|more|less|of|is|roads|reasons|tries)\b)"
)
STREETS = [
    re.compile(rf"(?<![\w.\-/#])\d{{1,4}}[a-eA-E]?,? +{_SIDE}(?:[A-ZÀ-Ý][\w'À-ÿ-]* +){{1,3}}{_KIND}\b\.?"),
    re.compile(rf"(?i)(?<![\w.\-/#])\d{{1,4}}[a-e]?,? +{_SIDE}(?:{_STOP}[a-z'][\w']* +){{1,3}}{_KIND}\b\.?"),
    re.compile(r"(?i)(?<![\w.\-/#])\d{1,4}(?: ?(?:bis|ter))?,? +(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours)\s+(?:de la |de l'|des |du |de |d'|la |le |les )?[a-zà-ÿ][\w'À-ÿ-]*(?: [A-ZÀ-Ý][\w'À-ÿ-]*)?"),
    re.compile(r"(?i)(?<!\w)[a-zäöüß][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|pfad|stieg) +\d{1,4} ?[a-e]?(?!\w)"),
    re.compile(r"(?<!\w)(?:Am|An der|An den|Im|Zum|Zur|Auf der|Auf dem|Unter den|Unter der|In der|Hinter der|Vor dem|Alte|Alter|Neue|Neuer|Große|Kleine|Obere|Untere) [A-ZÄÖÜ][\wäöüß-]*(?: [A-ZÄÖÜ][\wäöüß-]*)? \d{1,4} ?[a-e]?(?!\w|\.\d)"),
    re.compile(r"(?<!\w)(?:am|an der|im|zum|zur|unter den|auf der|in der) [a-zäöüß][\wäöüß-]* \d{1,4} ?[a-e]?,? \d{5} [a-zäöüß]"),
    re.compile(r"(?i)(?<!\w)(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|travesía)\s+(?:de la |de los |de las |del |de |la |el )?[a-zà-ÿ][\w'À-ÿ-]*(?: [A-ZÀ-Ý][\w'À-ÿ-]*)?,? *(?:n\.?[ºo°]? ?|núm\.? ?)?\d{1,4}(?![\w]|\.\d)"),
]

#: Endings of German street names.
GERMAN = "straße strasse str. weg gasse platz allee ufer damm pfad stieg".split()

_TITLE = "|".join(TITLES)
_NAME = "|".join(sorted(GIVEN, key=len, reverse=True))
_SURE = "|".join(n.lower() for n in GIVEN if n.lower() not in EVERYDAY)
_FAMILY = r"[A-ZÀ-Ý][a-zà-ÿ'’]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)?"
_ENDS = "|".join(SURNAME_ENDINGS)
NAMES = [
    re.compile(rf"(?<![\w@/.+-])(?:{_NAME}) +(?:[A-Z]\. +)?({_FAMILY})(?![\w@])"),
    re.compile(rf"(?<![\w@/.+-])({_FAMILY}), +(?:{_NAME})(?:,? [A-Z]\.)?(?![\w@])"),
    re.compile(rf"(?<![\w@/.+-])(?:{_TITLE})\.? +(?:(?:{_NAME}) +)?(?:[A-Z]\. +)?({_FAMILY})(?![\w@])"),
]
LOOSE = [
    re.compile(rf"(?i)(?<![\w@/.+-])(?:{_NAME}) +(?:[a-z]\. +)?([a-z]{{2,}}(?:{_ENDS}))(?![\w@])"),
    re.compile(rf"(?i)(?<![\w@/.+-])([a-z]{{2,}}(?:{_ENDS})), +(?:{_NAME})(?![\w@])"),
    re.compile(rf"(?i)(?<![\w@/.+-])(?:{_TITLE})\.? +(?:(?:{_NAME}) +)?(?:[a-z]\. +)?([a-z]{{2,}}(?:{_ENDS}))(?![\w@])"),
    re.compile(rf"(?<![\w@/.+-])(?:{_SURE}) +(?:[a-z]\. +)?([a-z]{{3,}}(?:{_ENDS}))(?![\w@])"),
]
CONTACT = re.compile(r"https?://\S+")
AFTER = re.compile(r" +([A-Z][a-z]+)")


#: Two or three capitalised words, an initial allowed between them.
PAIR = re.compile(rf"(?<![\w@/.+-])({_FAMILY}) +(?:[A-Z]\. +)?(?:({_FAMILY}) +)?({_FAMILY})(?![\w@]|\.\w)")
#: Who a name may be said to be, right before it.
RELATION = re.compile(
    r"(?i)\b(?:neighbou?r|landlord|landlady|boss|manager|friend|mate|colleague|coworker|flatmate|roommate|brother|sister|mother|father|mum|mom|dad|aunt|uncle|cousin|son|daughter|wife|husband|partner|teacher|tutor|coach|doctor|dentist|nurse|lawyer|"
    r"plumber|builder|mentor|supervisor|patient|client|author|owner|named|called|name is|name was|signed by|written by|thanks to|regards|sincerely|contact|dear)[,:]? +$"
)
#: What people do, right after their name; things rarely do.
DOING = re.compile(r"(?i)^(?:,? who|['’]s (?:phone|email|address|house|sister|brother|wife|husband|mother|father|kids?)|,? (?:from next door |from work )?(?:said|says|told|tells|asked|asks|called|phoned|wrote|writes|replied|emailed|texted|lives|thinks|thought|promised|insisted|admitted|laughed|complained|agreed|recommended|taught|helped|lent|offered|married|apologi[sz]ed|knows|knew)\b)")
#: What stands before places, firms and titles rather than before people.
THINGS = re.compile(r"(?i)\b(?:the|a|an|this|that|in|at|near|into|past|via|outside|towards?|visit|of|r) +$")
#: Capitalised words that begin sentences or name days, months and tongues.
STARTERS = set(
    """
    i we you he she it they my our your his her their its this that these those there here what who when where why how which while if so but and or nor
    as at by for from in of on to with about after before since until then than not no yes ok okay well right also just even still only some any every each
    most many much more less all both either neither one two first last next new old same other another is are was were be do does did have has had can could will
    would should may might must let lets please thanks thank sorry hello hi dear hey honestly anyway update edit look nobody everybody somebody someone anyone everyone
    nothing something everything english german french spanish italian dutch monday tuesday wednesday thursday friday saturday sunday january february march april
    june july august september october november december happy good great little big silver golden royal
    """.split()
)
#: Points of the evidence that two capitalised words are a person, and how many are enough.
POINTS = {"given": 3.0, "ending": 1.0, "relation": 2.0, "doing": 2.0, "joined": 1.0, "initial": 1.0, "thing": -3.0, "starter": -4.0, "place": -6.0}
ENOUGH = 3.0
JOINED = re.compile(r"^,? (?:and|&|und|et|y|or) +$")


def name_points(text: str, m: re.Match, beside: bool) -> float:
    """Evidence that a match of ``PAIR`` names a person; ``beside``: it is joined by "and" to another one."""
    first, middle, family = m[1].lower(), (m[2] or "").lower(), m[3].lower()
    follow = AFTER.match(text, m.end())
    p = POINTS
    total = p["given"] * (first in _GIVEN_LOW) + p["ending"] * (family.endswith(_ENDINGS) and family not in COMMON_ENDINGS)
    before, after = text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 32]
    total += p["relation"] * bool(RELATION.search(before)) + p["doing"] * bool(DOING.search(after)) + p["joined"] * beside + p["initial"] * (". " in m[0])
    total += p["thing"] * bool(THINGS.search(before)) + p["starter"] * (first in STARTERS or middle in STARTERS or family in STARTERS)
    return total + p["place"] * bool({first, middle, family} & NOT_FAMILY or (follow and follow[1].lower() in PLACE_WORDS))


def _contextual(text: str):
    """Names told by what stands around them, not by a list alone."""
    at, found = 0, []
    while True:
        m = PAIR.search(text, at)
        if not m:
            break
        if m[1].lower() in STARTERS or m[1].lower() in _TITLE_LOW:  # the pair may begin one word later
            at = m.end(1)
            continue
        found.append(m)
        at = m.end()
    near = [bool(JOINED.match(text[a.end() : b.start()])) for a, b in zip(found, found[1:])]
    for i, m in enumerate(found):
        beside = (i > 0 and near[i - 1]) or (i < len(near) and near[i])
        if name_points(text, m, beside) >= ENOUGH:
            yield m.start(), m.end()


def _person(text: str, tokens: list[str]):
    if any(map(str.isupper, text)):
        yield from _contextual(text)
    if _GIVEN_LOW.isdisjoint(tokens) and _TITLE_LOW.isdisjoint(tokens):
        return
    for k, p in enumerate(NAMES):
        for m in p.finditer(text):
            family = m[1].lower()
            follow = AFTER.match(text, m.end())
            if family in NOT_FAMILY or (follow and follow[1].lower() in PLACE_WORDS) or (k < 2 and THINGS.search(text[max(0, m.start() - 12) : m.start()])):
                continue
            yield m.start(), m.end()
    if any(t.endswith(_ENDINGS) and t not in COMMON_ENDINGS and t not in NOT_FAMILY for t in tokens):
        for p in LOOSE:
            for m in p.finditer(text):
                if m[1].lower() not in NOT_FAMILY and m[1].lower() not in COMMON_ENDINGS:
                    yield m.start(), m.end()


_ENDINGS = tuple(SURNAME_ENDINGS)
_GIVEN_LOW = {n.lower() for n in GIVEN}
_TITLE_LOW = {t.lower() for t in TITLES}
#: The words of NOT_FAMILY that, after a name, make it a place or firm.
PLACE_WORDS = set("street road avenue lane drive close court way terrace row square library council studio garage choir bakery club rowing cup arms inn tavern pub hotel museum school college church ltd inc gmbh brothers".split())
#: Everyday words that end like a family name.
COMMON_ENDINGS = set("person reason season lesson poison prison stranger danger manger kindergarden cinder cylinder binder finder grinder reminder tinder hinder iceberg candlewick mini lini martini zucchini spaghetti confetti jury bury".split())


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Source spans of every mention, longest first where two overlap, in text order.

    No mention crosses an empty line, so the pieces between empty lines are searched one by one.
    """
    if not text or not text.strip():
        return []
    if "\n\n" not in text:
        return _find(text)
    out, at = [], 0
    for piece in text.split("\n\n"):
        out += [(a + at, b + at, kind) for a, b, kind in _find(piece)]
        at += len(piece) + 2
    return out


def _find(text: str) -> list[tuple[int, int, str]]:
    tokens = LETTERS.findall(text.lower())
    s = deobfuscate(text, tokens)
    t, found = s.text, []
    if t is not text:
        tokens = LETTERS.findall(t.lower())
    taken = []
    if "@" in t:
        for m in EMAIL.finditer(t):
            if m.end() < len(t) or m[0].rpartition(".")[2].lower() in ENDINGS:
                found.append((m.start(), m.end(), "email"))
        taken = [(a, b) for a, b, _ in found]
    if "http" in t:
        taken += [m.span() for m in CONTACT.finditer(t)]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    digits = sum(map(str.isdigit, t))
    if digits >= 2:
        for p, cued in IDS:
            for m in p.finditer(t):
                a, b = m.span()
                before, around = t[max(0, a - 70) : a], t[max(0, a - 70) : b + 45]
                if free(a, b) and not NOT_PHONE.search(before) and (not cued or ID_CUE.search(around)):
                    found.append((a, b, "id_number"))
                    taken.append((a, b))
    if digits >= 9:
        for p in PHONES:
            for m in p.finditer(t):
                a, b = m.span()
                n = sum(map(str.isdigit, m[0]))
                if 9 <= n <= 15 and free(a, b) and not NOT_PHONE.search(t[max(0, a - 25) : a]):
                    found.append((a, b, "phone"))
                    taken.append((a, b))
    if digits:
        low = t.lower()
        german = any(x in low for x in GERMAN)
        for i, p in enumerate(STREETS):
            if i == 3 and not german:
                continue
            for m in p.finditer(t):
                if free(*m.span()):
                    found.append((*m.span(), "address"))
    for a, b in _person(t, tokens):
        if free(a, b):
            found.append((a, b, "person_name"))
    if not found:
        return found
    out, last = [], -1
    for a, b, kind in sorted(((*s.source(a, b), kind) for a, b, kind in found), key=lambda x: (x[0], -x[1])):
        if a >= last:
            out.append((a, b, kind))
            last = b
    return out


def redact(text: str | None) -> str | None:
    """The text with ``[TYPE]`` in place of each mention."""
    spans = find(text)
    if not spans:
        return text
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


#: Characters that folding changes in a way that can complete a mention, and digits and letters of other
#: scripts; with any of them a text is always searched.
FOLDED = (
    r"[\x{00A0}\x{00AD}\x{00B2}\x{00B3}\x{00B9}\x{00BC}-\x{00BE}\x{0250}-\x{1CFF}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{218F}\x{2460}-\x{24FF}"
    r"\x{3000}-\x{ABFF}\x{F900}-\x{FDFF}\x{FE00}-\x{FFEF}\x{10000}-\x{1F2FF}]"
)
_DASH = r"\-\x{2010}-\x{2015}\x{2212}"
_SEP = rf"[\s,.…{_DASH}]+(?:(?:double|triple)[\s{_DASH}]+)?"
_RELATED = "|".join(w for w in "neighbour neighbor landlord landlady boss manager friend mate colleague coworker flatmate roommate brother sister mother father mum mom dad aunt uncle cousin son daughter wife husband partner teacher tutor coach doctor dentist nurse lawyer plumber builder mentor supervisor patient client author owner named called is was by to regards sincerely contact dear".split())

#: RE2 patterns, run over whole Arrow columns: a text that matches none of them has no mention. Each
#: detector has an alternative here that is no narrower than it (tests/llm/test_pii.py).
PREFILTER = "|".join(
    [
        "@",
        r"(?i:\bdot\b)",
        r"(?i:[(\[{<]\s*at\s*[)\]}>])",
        r"(?i:\sat\s+[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z])",
        rf"\d[{_DASH[2:]}]|[{_DASH[2:]}]\d",
        r"\d[\d(). /\-]{6,}[\dA-Za-z]",
        r"\d{7}",
        r"(?i:\b[a-z]{2} ?\d\d ?\d\d)",
        r"(?i:\b[a-z]\d[0-9a-z]{7}\b)",
        r"[A-Za-z]-\d{3}-",
        rf"(?i:\b(?:{_WORD}){_SEP}(?:{_WORD}){_SEP}(?:{_WORD})\b)",
        rf"(?i:\d[a-e]?,? +(?:\S+ +){{1,4}}{_KIND}\b)",
        r"(?i:\d(?: ?(?:bis|ter))?,? +(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours)\s)",
        r"(?i:(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|pfad|stieg) +\d)",
        r"\b(?:[Aa]m|[Aa]n de[rn]|[Ii]m|[Zz]u[mr]|[Aa]uf de[rm]|[Uu]nter de[rn]|[Ii]n der|Hinter der|Vor dem|Alter?|Neuer?|Große|Kleine|Obere|Untere) \S+(?: \S+)? \d",
        r"(?i:\b(?:calle|c/|avenida|avda|plaza|paseo|camino|ronda|travesía)[\s.])",
        rf"(?:^|\W)(?:{_NAME}) +(?:[A-Z]\. +)?[A-ZÀ-Ý]",
        rf"[A-ZÀ-Ý][a-zà-ÿ'’-]+, +(?:{_NAME})\b",
        rf"\b(?:{_TITLE})\.? +(?:\S+ +)?(?:[A-Z]\. +)?[A-ZÀ-Ý]",
        rf"(?i:\b(?:{_TITLE})\.? +(?:\S+ +)?(?:[a-z]\. +)?[a-z]+(?:{_ENDS})\b)",
        rf"(?i:(?:{_NAME}) +(?:[a-z]\. +)?[a-z]+(?:{_ENDS})\b)",
        rf"(?i:[a-z]+(?:{_ENDS}), +(?:{_NAME})\b)",
        # contextual names need three points without a listed given name: a relation, an act, or an ending with "and" or an initial
        rf"(?i:\b(?:{_RELATED})),?:? +[A-ZÀ-Ý][a-zà-ÿ'’-]+",
        r"[A-ZÀ-Ý][a-zà-ÿ'’]+(?:,? who|['’]s (?:phone|email|address|house|sister|brother|wife|husband|mother|father|kid)|,? (?:from (?:next door|work) )?(?:said|says|told|tells|asked|asks|called|phoned|wrote|writes|replied|emailed|texted|lives|thinks|thought|promised|insisted|admitted|laughed|complained|agreed|recommended|taught|helped|lent|offered|married|apologi|knows|knew))",
        rf"[A-ZÀ-Ý]\. +[A-ZÀ-Ý]|[A-ZÀ-Ý][a-z]+(?:{_ENDS}) ",
        FOLDED,
    ]
)


def candidates(texts: pa.Array) -> pa.Array:
    """True for each text that may hold a mention; null texts are False."""
    return pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False)


def _pieces(column: pa.Array) -> tuple[list[int], list[str]]:
    """Row numbers and candidate pieces (between empty lines) of the texts of a column."""
    rows, parts = [], []
    for i, text in zip(*(x.to_pylist() for x in (pa.array(range(len(column))), column))):
        if text:
            for part in text.split("\n\n"):
                rows.append(i)
                parts.append(part)
    if not parts:
        return [], []
    keep = candidates(pa.array(parts, pa.large_string())).to_pylist()
    return [r for r, k in zip(rows, keep) if k], [p for p, k in zip(parts, keep) if k]


def mentions(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per text and type of mention in it: ``keys`` and ``pii_type``."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", pii_type string"

    def run(batch: pa.RecordBatch):
        rows, parts = _pieces(batch.column(len(keys)))
        kinds: dict[int, set] = {}
        for i, part in zip(rows, parts):
            kinds.setdefault(i, set()).update(k for _, _, k in _find(part))
        columns = [batch.column(i) for i in range(len(keys))]
        for i, found in kinds.items():
            for kind in sorted(found):
                yield (*(c[i].as_py() for c in columns), kind)

    return map_batches(spread(df.select(*keys, text)), run, schema, [*keys, "pii_type"])


def redacted(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the mentions in column ``text`` replaced; all rows and columns stay."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = names.index(text)

    def run(batch: pa.RecordBatch):
        column = batch.column(at)
        mask = candidates(column).to_pylist()
        new = [redact(v.as_py()) if m else v.as_py() for v, m in zip(column, mask)]
        return pa.RecordBatch.from_arrays(
            [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names
        )

    return map_batches(spread(df), run, schema, names)


def found(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """The types of mention in each item (any of its rows) and each chunk, distinct."""
    a = mentions(items, "body", "item_id").select(F.lit("items").alias("table_name"), F.col("item_id").alias("record_id"), "pii_type")
    b = mentions(chunks, "text", "chunk_id").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), "pii_type")
    return a.unionByName(b).distinct()
