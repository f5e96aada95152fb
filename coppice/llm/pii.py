"""Personal information in free text: finding and replacing it.

Regular expressions propose spans. Validators (checksums modulo 97, 11 and 23, Luhn) confirm numbers,
words nearby raise or lower a span's score, and spans that reach the threshold are kept; of
overlapping spans the better one. Texts are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Score from which a span counts, and the length of text on either side in which context words count.
THRESHOLD, BEFORE, AFTER = 0.6, 42, 34
#: When spans overlap, a type that comes earlier wins over one of equal score.
TYPES = ("email", "address", "id_number", "phone", "name")


@dataclass(frozen=True)
class Span:
    start: int
    stop: int
    kind: str
    score: float


# ---------------------------------------------------------------------------- mailboxes
_LABEL = r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ-]*[A-Za-z0-9À-ÿ])?"
_LOCAL = r"[A-Za-z0-9À-ÿ_](?:[\w.+%'’-]*[\w+-])?"
MAIL = re.compile(rf"(?<![\w.+%@/-]){_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![\w@-])")
_AT_IN = r"[ \t]{0,2}[\[({<][ \t]?(?:at|arroba|arobase|ät|@)[ \t]?[\])}>][ \t]{0,2}"
_DOT_IN = r"(?:[ \t]{0,2}[\[({<][ \t]?(?:dot|punkt|point|punto|\.)[ \t]?[\])}>][ \t]{0,2}|[ \t](?:dot|punkt|point|punto)[ \t]|\.)"
MAIL_MARKED = re.compile(rf"(?<![\w.+%@/-]){_LOCAL}{_AT_IN}(?:{_LABEL}{_DOT_IN})+[A-Za-z]{{2,}}(?![\w@-])", re.I)
MAIL_SPOKEN = re.compile(rf"(?<![\w.+%@/-]){_LOCAL}[ \t](?:at|arroba|arobase|ät)[ \t](?:{_LABEL}[ \t](?:dot|punkt|point|punto)[ \t])+[A-Za-z]{{2,}}(?![\w@-])", re.I)


def _mails(text: str) -> Iterator[Span]:
    if "@" in text:
        for m in MAIL.finditer(text):
            # user@host:path is a place to fetch from, not a mailbox
            if text[m.end() : m.end() + 1] == ":" and re.match(r":[\w~/.-]+/[\w./-]", text[m.end() : m.end() + 80]):
                continue
            yield Span(m.start(), m.end(), "email", 1.0)
    low = text.lower()
    if any(w in low for w in ("at]", "at)", "at}", "at>", "arroba", "arobase", "ät", "@]", "@)", "at ]", "at )")):
        for m in MAIL_MARKED.finditer(text):
            yield Span(m.start(), m.end(), "email", 0.95)
    if any(w in low for w in (" dot ", " punkt ", " point ", " punto ", "\tdot\t")):
        for m in MAIL_SPOKEN.finditer(text):
            yield Span(m.start(), m.end(), "email", 0.9)


# ---------------------------------------------------------------------------- numbers
def luhn(digits: str) -> bool:
    """The check of social insurance and similar numbers."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod_97(number: str) -> bool:
    """The check of French insurance numbers: the last two digits complete the rest modulo 97."""
    body = number[:-2].upper().replace("2A", "19").replace("2B", "18")
    return body.isdigit() and 97 - int(body) % 97 == int(number[-2:])


def mod_11_10(digits: str) -> bool:
    """The check of German tax numbers of eleven digits (ISO 7064), whose first ten repeat a digit."""
    product = 10
    for ch in digits[:-1]:
        total = (int(ch) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def mod_23(number: str) -> bool:
    """The letter of Spanish identity numbers."""
    body = str("XYZ".find(number[0])) + number[1:-1] if number[0] in "XYZ" else number[:-1]
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23] == number[-1].upper()


ID_WORDS = re.compile(
    r"\bssn\b|social[ -]security|social insurance|\bsin\b[:# ]|national insurance|\bni (?:number|no)|\bnino\b|insured person|insurance n|health card|passport|tax(?:payer)?[ -](?:id|number|no)|\btin\b"
    r"|steuer-?(?:id|nummer|identifikationsnummer)|sozialversicherung|reisepass|personalausweis|ausweisnummer|versichert|identit[yé]|sécurité sociale|\bnir\b|carte vitale|passeport|num[eé]ro fiscal|pasaporte|seguridad social|identidad|\bd\.?n\.?i\b|\bn\.?i\.?[ef]\b|driver'?s licen|permit n|\bid (?:card|number|no)\b",
    re.I,
)
NOT_ID = re.compile(r"checksum|\berror\b|\bbuild\b|part number|\brows\b|\bversion\b|\bcommit\b|trace id|\bticket\b #|\bissue\b|\bserial\b|\border\b (?:no|number)|\bport\b|is a code|\bisbn\b", re.I)
_E = r"(?![\w/]|[.:,-]\d|-\w)"
_S = r"(?<![\w./+-])"
ID_FORMS = (
    # form, checksum (None: there is none), score where the checksum holds, score where it fails
    (re.compile(rf"{_S}[12](?P<s>[ .]?)\d\d(?P=s)(?:[02-9]\d|1[0-2])(?P=s)(?:\d\d|2[ABab])(?P=s)\d{{3}}(?P=s)\d{{3}}(?P=s)\d\d{_E}"), mod_97, 0.9, 0.2),
    (re.compile(rf"{_S}\d{{2}}(?P<s>[ ./]?)\d{{3}}(?P=s)\d{{3}}(?P=s)\d{{3}}{_E}"), mod_11_10, 0.45, 0.15),
    (re.compile(rf"{_S}\d{{3}}(?P<s>[- .]?)\d{{2}}(?P=s)\d{{4}}{_E}"), None, 0.25, 0.25),
    (re.compile(rf"{_S}\d{{3}}(?P<s>[- ]?)\d{{3}}(?P=s)\d{{3}}{_E}"), luhn, 0.2, 0.1),
    (re.compile(rf"{_S}[A-CEGHJ-PR-TW-ZQ][A-CEGHJ-NPR-TW-ZQ](?P<s>[ -]?)\d\d(?P=s)\d\d(?P=s)\d\d(?P=s)[A-D]{_E}"), None, 0.7, 0.7),
    (re.compile(rf"{_S}(?:\d{{8}}|[XYZ]\d{{7}})-?[A-HJ-NP-TV-Z]{_E}"), mod_23, 0.7, 0.1),
    (re.compile(rf"{_S}[A-Z]{{1,2}}[ ]?\d{{6,9}}[A-Z]?{_E}"), None, 0.2, 0.2),
    (re.compile(rf"{_S}[A-Z]\d[A-Z0-9]{{7}}\d{_E}"), None, 0.2, 0.2),
)


#: All number forms but the last hold six digits with at most four signs after each; a text without
#: such a run has none of them (tested for every form).
DIGITS = re.compile(r"(?:\d[ .\-/()‑ A-Z]{0,4}){6}")


def _ids(text: str) -> Iterator[Span]:
    for form, valid, good, poor in ID_FORMS if DIGITS.search(text) else ID_FORMS[-1:]:
        for m in form.finditer(text):
            bare = re.sub(r"[ ./-]", "", m[0])
            score = good if valid is None or valid(bare) else poor
            yield Span(m.start(), m.end(), "id_number", _near(text, m.start(), m.end(), score, ID_WORDS, 0.6, NOT_ID, -0.8))


PHONE_WORDS = re.compile(
    r"\btel\b|\btel[.:]|\btél|phone|\bfax|hotline|\bmobile\b|\bcell\b|\bcall\b|\bcalls\b|\bpager\b|on-call|\bring|\bdial\b|\btext me\b|whatsapp|rückruf|anruf|\banrufen\b|\bruf|handy|\bmobil\b|durchwahl|appelez|appeler|joindre|portable|\bllama|\bllame|móvil|teléfono|contact|\bsms\b",
    re.I,
)
NOT_PHONE = re.compile(r"checksum|\berror\b|\bbuild\b|part number|\brows\b|\bversion\b|\bhost\b|\bseen on\b|\bssn\b|social security|health card|insured person|tax(?:payer)? ?(?:id|number)|passport|steuer|\bnir\b|trace id|\bcommit\b|\bisbn\b|\bid\b|national insurance|identidad|pasaporte|sécurité|is a code", re.I)
_P = r"(?<![\w.+/-])(?<![\w]\()"
_PE = r"(?![\w/]|[.,:-]\d|[.-]\w)"
_G = r"[ .\-/ ‑]"
PHONE_FORMS = (
    (re.compile(rf"{_P}(?:\+|00)[1-9]\d{{0,2}}(?:{_G}?\(0\){_G}?|{_G}?\(\d{{1,5}}\){_G}?|{_G}?)\d{{1,12}}(?:{_G}\d{{1,9}}){{0,5}}{_PE}"), 8, 15, 0.7),
    (re.compile(rf"{_P}\(0\d{{1,5}}\){_G}?\d{{2,9}}(?:{_G}\d{{1,8}}){{0,4}}{_PE}"), 8, 13, 0.6),
    (re.compile(rf"{_P}(?:1{_G})?(?:\([2-9]\d\d\){_G}?|[2-9]\d\d(?P<s>{_G}))\d{{3}}{_G}\d{{4}}{_PE}"), 10, 11, 0.55),
    (re.compile(rf"{_P}0\d(?P<s>{_G}?)\d\d(?P=s)\d\d(?P=s)\d\d(?P=s)\d\d{_PE}"), 10, 10, 0.5),
    (re.compile(rf"{_P}0\d{{1,5}}{_G}\d{{2,9}}(?:{_G}\d{{1,8}}){{0,3}}{_PE}"), 8, 13, 0.4),
    (re.compile(rf"{_P}[6-9]\d\d(?P<s>{_G}?)\d{{3}}(?P=s)\d{{3}}{_PE}"), 9, 9, 0.3),
    (re.compile(rf"{_P}[6-9]\d\d(?P<s>{_G}?)\d\d(?P=s)\d\d(?P=s)\d\d{_PE}"), 9, 9, 0.3),
    (re.compile(rf"{_P}\d{{3,5}}{_G}\d{{3,8}}(?:{_G}\d{{2,6}}){{0,2}}{_PE}"), 7, 12, 0.1),
    (re.compile(rf"{_P}0\d{{8,11}}{_PE}"), 9, 12, 0.2),
)


def _phones(text: str) -> Iterator[Span]:
    if not DIGITS.search(text):
        return
    for form, least, most, score in PHONE_FORMS:
        for m in form.finditer(text):
            if least <= sum(c.isdigit() for c in m[0]) <= most:
                yield Span(m.start(), m.end(), "phone", _near(text, m.start(), m.end(), score, PHONE_WORDS, 0.5, NOT_PHONE, -0.8))


def _near(text: str, start: int, stop: int, score: float, good: re.Pattern, plus: float, bad: re.Pattern, minus: float) -> float:
    """The score of a span with its context: the last telling word of the line before it counts, else
    the first after it."""
    before = text[max(0, start - BEFORE) : start]
    before = before[before.rfind("\n") + 1 :]
    last_good = max((m.end() for m in good.finditer(before)), default=-1)
    last_bad = max((m.end() for m in bad.finditer(before)), default=-1)
    if max(last_good, last_bad) < 0:
        after = text[stop : stop + AFTER].split("\n", 1)[0]
        g, b = good.search(after), bad.search(after)
        if g and (not b or g.start() <= b.start()):
            return score + plus / 2
        return score + (minus if b else 0.0)
    return score + (plus if last_good >= last_bad else minus)


# ---------------------------------------------------------------------------- addresses
_C = r"[A-ZÀ-ÖØ-Þ][\w'’à-ÿß-]*"
_JOINED = rf"{_C}(?:(?:-|[ -](?:am|an der|im|sur|sous|la|le|les|de|del|de la|de los|los|las|upon|on|en)[ -]){_C})*"
# First words of the names of towns of several words.
_CITY = rf"(?:(?:Bad|Sankt|Saint|Sainte|St\.?|San|Santa|Santo|La|Le|Les|Los|Las|El|New|Old|North|South|East|West|Great|Little|Upper|Lower|Port|Fort|Mount|Lake|Neu|Alt|Groß|Klein|Villa|Nueva)[ ])?{_JOINED}"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Ste|Room|No)\.? ?#?\d+[A-Za-z]?"
_STREET_EN = r"(?:Street|Road|Lane|Drive|Avenue|Court|Close|Terrace|Row|Square|Crescent|Boulevard|Place|Way|Gardens|Grove|Parkway|Highway|Circle|Trail|Walk|Mews|(?:St|Rd|Ln|Dr|Ave|Ct|Blvd|Sq|Pl|Hwy|Pkwy|Ter)\b\.?(?=,| [A-Z]|[ ]?$|\n|\r|\.|;|\)| [a-z]))"
_POST_EN = r"(?:,? [A-Z]{2},? \d{5}(?:-\d{4})?|,? [A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})"
ADDRESS_EN = re.compile(
    rf"(?<![\w.-])(?:{_UNIT}, )?\d{{1,5}}[A-Za-z]? (?:{_C} ){{1,3}}?{_STREET_EN}(?![\w])(?:, {_UNIT}(?:,? {_CITY}{_POST_EN}|, {_CITY})?|,? (?!Apt|Flat){_CITY}{_POST_EN}|, (?!Apt|Flat){_CITY}(?=[.,;)]|$|\r| [a-z])|{_POST_EN})?(?![\w])",
    re.M,
)
_ZIP = r"(?:[A-Z]{1,2}-)?\d{4,5}"
ADDRESS_DE = re.compile(rf"(?<![\w.-])(?:{_C}[ -]){{0,2}}(?:{_C}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig)|(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm)) \d{{1,4}} ?[a-z]?(?![\w])(?:,? {_ZIP} {_CITY})?|(?<![\w.-])(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der) {_C}(?:[ -]{_C})? \d{{1,4}} ?[a-z]?,? {_ZIP} {_CITY}")
ADDRESS_FR = re.compile(rf"(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter|[A-D]))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|square|passage|sentier) (?:de la |de l['’]|des |du |de |d['’]|l['’])?{_C}(?:[ -](?:(?:de la|des|du|de|et|en|sur|au|aux)[ -])?{_C}){{0,3}}(?:,? {_ZIP} {_CITY})?", re.M)
ADDRESS_ES = re.compile(rf"(?<![\w.-])(?:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Carretera|Ronda|Travesía|Callejón)(?: (?:de la|de los|de las|del|de))? ?{_C}(?: (?:(?:de la|de los|de las|del|de|y) )?{_C}){{0,3}},? (?:n\.?º ?)?\d{{1,4}}(?: ?[A-Za-z]\b)?(?:, ?\d{{1,2}}\.?[ºª](?: ?[A-Za-z])?)?(?![\w])(?:,? {_ZIP} {_CITY})?")


#: What every address of a form contains; only texts that do are searched with the form itself.
ADDRESS_FORMS = (
    (re.compile(r"\d[A-Za-z]? [A-ZÀ-ÖØ-Þ]"), ADDRESS_EN),
    (re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm) \d|\d ?[a-z]?,? (?:[A-Z]{1,2}-)?\d{4,5} [A-ZÀ-ÖØ-Þ]"), ADDRESS_DE),
    (re.compile(r"\d(?: ?(?:bis|ter|[A-D]))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|square|passage|sentier) "), ADDRESS_FR),
    (re.compile(r"Calle|C/|C\.|Avenida|Avda|Av\.|Plaza|Pza|Paseo|P\.º|Camino|Carretera|Ronda|Travesía|Callejón"), ADDRESS_ES),
)


def _addresses(text: str) -> Iterator[Span]:
    for hint, form in ADDRESS_FORMS:
        if hint.search(text):
            for m in form.finditer(text):
                yield Span(m.start(), m.end(), "address", 0.9)


# ---------------------------------------------------------------------------- names
# Given names that are among the most common of their countries (English, German, French,
# Spanish). Other names count where words nearby say that a person is named.
GIVEN_NAMES = frozenset(
    """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret
    Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Ronald Rebecca Timothy Laura Jason Helen Jeffrey Sharon Ryan Cynthia
    Jacob Kathleen Gary Amy Nicholas Shirley Eric Angela Jonathan Anna Stephen Brenda Larry Pamela Justin Emma Scott Nicole Brandon Samantha Benjamin Katherine Samuel Christine Oliver Sophie Harry Olivia Jack Amelia
    Peter Wolfgang Andreas Klaus Jürgen Stefan Markus Hans Uwe Monika Petra Sabine Ursula Renate Karin Brigitte Ingrid Heike Claudia Gabriele Lukas Leon Lena Hannah Werner Martin Frank Bernd Dieter Günther Jan Julia
    Jean Pierre Philippe Alain Nicolas Jacques Julien Louis Antoine Camille Marie Nathalie Isabelle Sylvie Catherine Françoise Chloé Léa Manon Claire Élodie Rémi Luc Hugo Gabriel Céline Aurélie Mathieu
    Antonio José Manuel Francisco Juan Carlos Javier Jesús Miguel Alejandro Pablo Luis María Carmen Ana Isabel Dolores Pilar Teresa Rosa Cristina Lucía Elena Raquel Sofía Marta Pedro Diego Álvaro Beatriz Jorge Ramón""".split()
)
_N = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß]+(?:['’][A-ZÀ-ÖØ-Þ]?[a-zà-öø-ÿ]+)?"
_GIVEN = rf"{_N}(?:-{_N})?"
_PARTICLE = r"(?:(?:van|von|de|der|den|del|di|da|la|le|bin|al|zu|ter) ){0,2}"
_FAMILY = rf"{_PARTICLE}(?:(?:Mc|Mac|O['’]|D['’])?{_N})(?:-{_N})*"
NAME_FORMS = (
    (re.compile(rf"(?<![\w.@/-])(?P<given>{_GIVEN}) (?:[A-ZÀ-ÖØ-Þ]\. ){{1,2}}(?P<family>{_FAMILY})(?![\w@])"), 0.45),
    (re.compile(rf"(?<![\w.@/-])(?P<given>{_GIVEN}) (?P<family>{_FAMILY})(?![\w@])"), 0.0),
    (re.compile(rf"(?<![\w.@/-])(?P<family>{_FAMILY}), (?P<given>{_GIVEN})(?: [A-ZÀ-ÖØ-Þ]\.)?(?![\w@])"), -0.05),
    (re.compile(rf"(?<![\w.@/-])(?P<given>[A-ZÀ-ÖØ-Þ]\.(?: ?[A-ZÀ-ÖØ-Þ]\.)?) (?P<family>{_FAMILY})(?![\w@])"), 0.0),
    (re.compile(rf"(?<![\w.@/-])(?P<family>{_FAMILY}), (?P<given>[A-ZÀ-ÖØ-Þ]\.)(?![\w@])"), 0.0),
)
#: Two capitalised words of which every form of a name has such a pair.
PAIR = re.compile(rf"[A-ZÀ-ÖØ-Þ][\w'’.-]*,? {_PARTICLE}[A-ZÀ-ÖØ-Þ]")
NAME_BEFORE = re.compile(
    r"(?:\b(?:written|reviewed|created|authored|maintained|reported|implemented|designed|fixed|found|signed-off|acked|tested|co-authored|patch|suggested|approved)[ -]by:?|@author:?|\bauthors?:?|\bmaintainers?\s?[:=]|original idea:|\bidea (?:by|of|from):?|copyright(?: \(c\))?(?: ©)? ?(?:\d{4}(?:[-–, ]+\d{4})*)?,?(?: by)?|©(?: ?\d{4})?|\(c\)(?: \d{4})?|todo\(|fixme\(|xxx\(|\bthanks(?: go)? to|\bthank you,?|\bask(?:ed)?|\bcustomer,?|\bclient,?|\bcolleague,?"
    r"|\buser,?|\bcredits?:?(?: to)?|\bfrom:|\bto:|\bcc:|\bcontact(?:o)?:?|\bkontakt:?|\bmet|\btold|\bwith|\bdear|\bhi|\bhello|\bmerci (?:à|a)|\bdanke an|\bdank an|\bgracias a|\bhallo|\bbonjour|\bhola|\b(?:mr|mrs|ms|dr|prof|herr|frau|señora?|sra?|mme|mlle|m)\.?|\bvon|\bpar|\bpor)\s*$",
    re.I,
)
NAME_AFTER = re.compile(
    r"\s*(?:,? (?:found this|reported|wrote|asked|said|noted|fixed|reviewed|suggested|signed|joined|called|replied|sees it|told|pointed)\b|hat den\b|hat (?:das|die|uns|mir)\b|a (?:signalé|trouvé|écrit|corrigé|remarqué)\b|(?:encontró|informó|escribió|corrigió|avisó|notó)\b|\)\s?:|<[\w.+-]+(?:@| ?[\[(]at))",
    re.I,
)
#: Capitalised words that begin sentences or stand in other expressions, not names.
NOT_NAMES = frozenset(
    """The This That These Those There When While Where Which What Why Who How If In On At By For From With Without Our Your My His Her Its We You They It He She Set See Use Run Mail Reply Thanks Thank Please Questions
    Reviewed Seen Error Pinned Copyright Todo Trace Input Output Problem Note Wenn Der Die Das Bitte Meine Danke Dank Kontakt Lieferung Anschrift Les Le La Il Si Merci Mon Votre Contact Adresse Envoyez Appelez Los Las El Primero Hay Mi
    Gracias Escribe Contacto Llama Steuernummer And But Or Not No Yes Also All Any New Old First Last Next Only Each Every Street Road Lane Avenue Flat Apt Update Add Fix Remove Merge Rename Build Test Release Version Monday Tuesday Wednesday
    Thursday Friday Saturday Sunday January February March April June July August September October November December""".split()
)


class Names:
    """Proposes personal names. ``common``: words of the domain, in lower case, that are no names."""

    def __init__(self, common: frozenset[str]):
        self.common = common

    def _no_name(self, word: str) -> bool:
        return word in NOT_NAMES or word.lower() in self.common

    def __call__(self, text: str) -> Iterator[Span]:
        done = 0
        for pair in PAIR.finditer(text):
            if pair.start() >= done:  # names stay within a line, and in a line with such a pair
                start = text.rfind("\n", 0, pair.start()) + 1
                done = text.find("\n", pair.end())
                done = len(text) if done < 0 else done
                yield from self._line(text, start, done)

    def _line(self, text: str, start: int, stop: int) -> Iterator[Span]:
        for form, base in NAME_FORMS:
            at = start
            while m := form.search(text, at, stop):
                # no other match begins before the next word
                at = text.find(" ", m.start(), m.end()) + 1
                given, family = m["given"], m["family"]
                initial = given.endswith(".")
                parts = re.split(r"[ -]", family)
                if not initial and self._no_name(given):
                    # the words after this one may still be a name
                    at = m.start("given") + len(given) if m.start("given") == m.start() else m.end("family")
                    continue
                score, known = 0.2 + base, not initial and (given in GIVEN_NAMES or given.split("-")[0] in GIVEN_NAMES)
                if known:
                    score += 0.5
                if all(self._no_name(p) for p in parts if p[:1].isupper()):
                    score -= 0.2 if known else 0.6
                before = text[max(start, m.start() - BEFORE) : m.start()]
                if NAME_BEFORE.search(before):
                    score += 0.45
                if NAME_AFTER.match(text[m.end() : m.end() + AFTER]):
                    score += 0.45
                if score >= THRESHOLD:
                    at = m.end()
                yield Span(m.start(), m.end(), "name", score)


def spans(text: str, names: Names) -> list[Span]:
    """The spans of personal information of a text, in order and without overlap."""
    found: list[Span] = []
    for f in (_mails, _addresses, _ids, _phones, names):
        # of one type, the longest
        found += _apart(sorted((s for s in f(text) if s.score >= THRESHOLD), key=lambda s: (s.start - s.stop, -s.score, s.start)))
    found.sort(key=lambda s: (TYPES.index(s.kind) > 1, -round(s.score, 2), s.start - s.stop, TYPES.index(s.kind), s.start))
    return _apart(found)


def _apart(ranked: list[Span]) -> list[Span]:
    """The spans, best first, that overlap no better one; in order of their places."""
    kept: list[Span] = []
    for s in ranked:
        k = bisect_left(kept, s.stop, key=lambda x: x.start)  # all after this one begin later
        if not k or kept[k - 1].stop <= s.start:
            kept.insert(k, s)
    return kept


FOUND = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("pii_text", T.StringType()), T.StructField("score", T.DoubleType())]))


def redact(documents: DataFrame, common: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, redacted, found`` of every row: the text with typed placeholders, and what they replace
    (``pii_type, start, stop, pii_text, score``; offsets in code points).

    Everything outside the spans stays as it was. A null text gives null and no finds, an empty text
    an empty one. Repeated keys stay repeated rows. ``common``: domain words that are no names, of a
    vocabulary of fixed size.
    """
    words = frozenset(w.lower() for w in common if w and len(w) > 2)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(words)
        made = pa.list_(pa.struct([("pii_type", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("pii_text", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out, finds = [], []
                for t in part.column(1).to_pylist():
                    if not t:
                        out.append(t)
                        finds.append([])
                        continue
                    pieces, last, listed = [], 0, []
                    for s in spans(t, names):
                        pieces += [t[last : s.start], f"[{s.kind.upper()}]"]
                        last = s.stop
                        listed.append({"pii_type": s.kind, "start": s.start, "stop": s.stop, "pii_text": t[s.start : s.stop], "score": round(min(s.score, 1.0), 6)})
                    out.append("".join([*pieces, t[last:]]))
                    finds.append(listed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array(finds, made)], names=["k", "redacted", "found"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("redacted", T.StringType()), T.StructField("found", FOUND)])
    return documents.select(F.col(key).alias("k"), F.col(text)).mapInArrow(run, schema).select(F.col("k").alias(key), "redacted", "found")
