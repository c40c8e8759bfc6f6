"""Personal information in free text: found, validated, and replaced by typed placeholders.

Validated numbers keep their format: a keyed Feistel permutation maps each number to another one of the same shape, so that equal values stay
linked across documents without being readable. Everything else becomes a plain typed placeholder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: People of a directory that goes to the tasks whole; a larger one is joined with the words of the texts.
KNOWN_PEOPLE = 1_000_000

# --- Feistel ---------------------------------------------------------------------------------------------------------------------------------


def feistel(value: int, size: int, key: bytes, tweak: str = "") -> int:
    """A keyed permutation of 0 .. size - 1: alternating rounds over the two mixed-radix halves, walked on while outside the range."""
    if size < 2:
        return value
    a = int(size**0.5)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            half, other = (right, a) if r % 2 == 0 else (left, b)
            mixed = int.from_bytes(hashlib.blake2b(f"{tweak}:{r}:{half}".encode(), key=key, digest_size=16).digest(), "big")
            if r % 2 == 0:
                left = (left + mixed) % other
            else:
                right = (right + mixed) % other
        value = left * b + right
        if value < size:
            return value


def unfeistel(value: int, size: int, key: bytes, tweak: str = "") -> int:
    """The inverse of :func:`feistel`."""
    if size < 2:
        return value
    a = int(size**0.5)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for r in reversed(range(ROUNDS)):
            half, other = (right, a) if r % 2 == 0 else (left, b)
            mixed = int.from_bytes(hashlib.blake2b(f"{tweak}:{r}:{half}".encode(), key=key, digest_size=16).digest(), "big")
            if r % 2 == 0:
                left = (left - mixed) % other
            else:
                right = (right - mixed) % other
        value = left * b + right
        if value < size:
            return value


def _into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdecimal() else c for c in shape)


def permute_digits(text: str, key: bytes, tweak: str = "", keep: int = 0) -> str:
    """All digits but the first ``keep``, permuted as one number of the same length; every other sign stays in place."""
    digits = "".join(str(int(c)) for c in text if c.isdecimal())
    head, tail = digits[:keep], digits[keep:]
    if not tail:
        return text
    return _into(text, head + str(feistel(int(tail), 10 ** len(tail), key, f"{tweak}{len(tail)}")).zfill(len(tail)))


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def permute_card(text: str, key: bytes) -> str:
    """Another card number of the same format with a valid check digit."""
    digits = "".join(c for c in text if c.isdecimal())
    body = str(feistel(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return _into(text, body + next(c for c in "0123456789" if luhn(body + c)))


def mod97(iban: str) -> int:
    """The remainder of an IBAN (without spaces)."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Digits after the country code, where a country has one length; codes of other countries have as many digits as E.164 says. Fixed values.
NATIONAL = {"1": 10, "7": 10, "31": 9, "32": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "351": 9, "420": 9}
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_EXTENSION = re.compile(r"\s?(?:ext|x|extension|durchwahl|poste|int|app)\.?\s?\d{1,5}$", re.I)


def country_code(digits: str) -> str:
    """The country code that the digits after + or 00 begin with."""
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in _TWO_DIGITS else digits[:3]


def permute_phone(text: str, key: bytes) -> str:
    """Another number in the same format: the country code stays, so +33, 0033 and +33 (0) before one number give one pseudonym. An extension
    is permuted for itself."""
    m = _EXTENSION.search(text)
    body, rest = (text[: m.start()], permute_digits(text[m.start() :], key, "ext")) if m else (text, "")
    at = [i for i, c in enumerate(body) if c.isdecimal()]
    digits = "".join(str(int(body[i])) for i in at)
    skip, code = 0, ""
    plain = body.lstrip(" (")
    if plain.startswith(("+", "00")):
        skip = 0 if plain.startswith("+") else 2
        code = country_code(digits[skip:])
        skip += len(code)
        trunk = re.search(r"\(0\)", body)
        at, digits = at[skip:], digits[skip:]
        if trunk and trunk.start() + 1 in at:
            gone = at.index(trunk.start() + 1)
            at, digits = at[:gone] + at[gone + 1 :], digits[:gone] + digits[gone + 1 :]
    if not digits:
        return text
    new = str(feistel(int(digits), 10 ** len(digits), key, f"phone{code}:{len(digits)}")).zfill(len(digits))
    signs = list(body)
    for i, c in zip(at, new):
        signs[i] = c
    return "".join(signs) + rest


def permute_idnum(text: str, key: bytes) -> str:
    """Another number in the same format. Check letters of DNI and NIE, the key of a French number and the last digit of a German one are right
    again; equal numbers in other spacing give equal digits."""
    plain = re.sub(r"[\s.-]", "", text).upper()
    digits = "".join(c for c in plain if c.isdecimal())
    if re.fullmatch(r"\d{8}[A-Z]", plain) or re.fullmatch(r"[XYZ]\d{7}[A-Z]", plain):
        new = str(feistel(int(digits), 10 ** len(digits), key, f"dni{plain[:1] if plain[0] in 'XYZ' else ''}")).zfill(len(digits))
        letter = _DNI_LETTERS[int((str("XYZ".index(plain[0])) if plain[0] in "XYZ" else "") + new) % 23]
        out = _into(text, new)
        return out[:-1] + (letter if text[-1].isupper() else letter.lower())
    if plain.isdecimal() and len(plain) == 15:
        body = str(feistel(int(plain[1:13]), 10**12, key, "nir")).zfill(12)
        return _into(text, plain[0] + body + f"{97 - int(plain[0] + body) % 97:02d}")
    if plain.isdecimal() and len(plain) == 11:
        body = str(feistel(int(plain[:10]), 10**10, key, "tin")).zfill(10)
        return _into(text, body + _mod11_10(body))
    return permute_digits(text, key, "idnum")


def _mod11_10(body: str) -> str:
    """The check digit by the iterated products of 11 and 10."""
    p = 10
    for d in map(int, body):
        p = (p + d) % 10 or 10
        p = p * 2 % 11
    return str((11 - p) % 10)


def permute_iban(text: str, key: bytes) -> str:
    """Another IBAN of the same country and format with valid check digits; letters stay."""
    plain = re.sub(r"[\s-]", "", text).upper()
    body = permute_digits(plain[4:], key, plain[:2])
    check = f"{98 - mod97(plain[:2] + '00' + body):02d}"
    new = iter(plain[:2] + check + body)
    return "".join(c if c.isspace() or c == "-" else next(new) for c in text)


def permute_date(text: str, key: bytes) -> str:
    """Another date of the years 1900 to 2099 in the same format (year first with '-', or day first with '.' or '/'); else unchanged."""
    import datetime as dt

    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text) or re.fullmatch(r"(\d\d)([./])(\d\d)\2(\d{4})", text)
    if not m:
        return text
    iso = "-" in text
    try:
        day = dt.date(int(m[1]), int(m[2]), int(m[3])) if iso else dt.date(int(m[4]), int(m[3]), int(m[1]))
    except ValueError:
        return text
    first, size = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
    if not 0 <= (day - first).days < size:
        return text
    new = first + dt.timedelta(feistel((day - first).days, size, key, "date"))
    return new.isoformat() if iso else f"{new.day:02d}{m[2]}{new.month:02d}{m[2]}{new.year}"


# --- finding ---------------------------------------------------------------------------------------------------------------------------------

_MAIL = re.compile(r"[\w+%-][\w.+%-]*@(?:[\w-]+\.)+[^\W\d_]{2,}")
_AT = r"(?:[\[({<]\s?(?:at|arroba|ät|@)\s?[\])}>]|\s(?:at|arroba)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punto|punkt|point|\.)\s?[\])}>]\s?|\s(?:dot|punto|punkt|point)\s)"
_MAIL_SAID = re.compile(rf"[\w+%-][\w.+%-]*(?:{_DOT}[\w.+%-]+)*\s?{_AT}\s?[\w-]+(?:(?:{_DOT}|\.)[\w-]+)*{_DOT}[^\W\d_]{{2,}}", re.I)
_MAIL_SAID_SIGNS = (" dot ", "[dot", "(dot", "{dot", " DOT ", "[DOT", "(DOT", "punto", "punkt", "point", " PUNTO ", " Dot ", "(Dot", "[Dot")
_MAIL_SAID_CUE = re.compile(r"(?:dot|punto|punkt|point)[\s\])}>]", re.I)

_IBAN = re.compile(r"(?<![\w])[A-Za-z]{2}\d{2}(?:[ \n-]?[A-Za-z0-9]{4}){2,7}(?:[ \n-]?[A-Za-z0-9]{1,4})?(?![A-Za-z0-9])")
_IBAN_HEAD = re.compile(r"(?<![\w])[A-Za-z]{2}\d{2}[ \n-]?[A-Za-z0-9]{4}[ \n-]?[A-Za-z0-9]{4}")
_CARD = re.compile(r"(?<![\w.,/+-])\d(?:[ \n-]?\d){12,18}(?![\w])")

#: What is numbered in business, not a person's (fixed values, lower case); any of these shortly before a number excludes it.
_THINGS = re.compile(
    r"(?:order|orders|pedido|commande|auftrag|bestellung|part|pièce|pieza|teil|batch|lot|lote|charge|version|form|serial|invoice|rechnung|facture|factura"
    r"|document|dokument|ref|reference|referencia|référence|xx\d\d)(?:\s?(?:no|nr|n°|n\.º|nº|number|numéro|num))?[.:]?\s?#?$",
    re.I,
)
_ID_CUE = re.compile(
    r"\b(?:ssn|social\s+security|steuer-?\s?id\w*|steuernummer|sécurité\s+sociale|seguridad\s+social|dni|nie|nif|tin|tax\s+(?:id|number)|passport|reisepass\w*|pass-?nr"
    r"|passeport|pasaporte|personalausweis\w*|ausweis\w*|carte\s+d.identité|national\s+id\w*|national\s+insurance)\b",
    re.I,
)
_ID_VALUE = re.compile(
    r"(?<![\w-])(?:"
    r"\d{3}[- \n]\d{2}[- \n]\d{4}|\d{9}"
    r"|[12][ \n]?\d\d[ \n]?\d\d[ \n]?\d\d[ \n]?\d{3}[ \n]?\d{3}(?:[ \n]?\d\d)?"
    r"|\d{2}[ \n]?\d{3}[ \n]?\d{3}[ \n]?\d{3}"
    r"|\d{2}\.?\d{3}\.?\d{3}[- ]?[A-Za-z]"
    r"|[XYZxyz][- ]?\d{7}[- ]?[A-Za-z]"
    r"|[A-Za-z]\d{2}[A-Za-z]\d{5}|[A-Za-z]{1,3}\d{6,8}[A-Za-z]?|[CFGHJKLMNPRTVWXYZcfghjklmnprtvwxyz0-9]{9}\d?"
    r")(?![\w])"
)
_PASS_BARE = re.compile(r"(?<![\w-])[A-Z]\d{2}[A-Z]\d{5}(?![\w-])")
_DNI_BARE = re.compile(r"(?<![\w-])(?:\d{8}|\d{2}\.\d{3}\.\d{3})-?[A-Za-z](?![\w])")
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_SEP = r"[ \n.\-/]"
_PHONE = re.compile(
    r"(?<![\w.,/+\-])(?:"
    rf"(?P<abroad>(?:\+|00)[1-9]\d{{0,2}}(?:{_SEP}?\(\d{{1,5}}\))?(?:{_SEP}?\d{{1,8}})(?:{_SEP}?\d{{2,8}}){{0,6}})"
    rf"|\(0?\d{{2,5}}\){_SEP}?\d{{3,8}}(?:{_SEP}\d{{2,6}})*"
    rf"|0\d(?:{_SEP}\d\d){{4}}"
    rf"|0\d{{1,5}}{_SEP}\d{{3,8}}(?:{_SEP}\d{{2,6}}){{0,3}}"
    r"|0\d{9,10}"
    rf"|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}"
    r"|[6-9]\d\d(?:[ .-]\d{3}){2}|[6-9]\d\d(?:[ .-]\d\d){3}"
    r")(?P<more>\s?(?:ext|x|extension|durchwahl|poste|int|app)\.?\s?\d{1,5})?(?![\w]|[.\-/]\d)",
    re.I,
)


def _phone(text: str, m: re.Match) -> tuple[int, int]:
    """Where a number ends. One from abroad ends with the group that fills its country's length, so that what follows a blank isn't taken for
    more of it; where that is unknown, with the last group of up to 15 digits."""
    if not m["abroad"] or m["more"]:
        return m.span()
    start, n, code = m.start(), 0, country_code("".join(c for c in m[0] if c.isdecimal())[0 if m[0][0] == "+" else 2 :])
    skip = len(code) + (0 if m[0][0] == "+" else 2)
    trunk = m[0].find("(0)")
    most, whole = NATIONAL.get(code), m.start()
    for i in range(start, m.end()):
        if not text[i].isdecimal():
            continue
        if skip:
            skip -= 1
            continue
        n += i != start + trunk + 1 or trunk < 0
        if i + 1 == m.end() or not text[i + 1].isdecimal():
            if n + len(code) <= 15:
                whole = i + 1
            if n == most:
                break
    return (start, whole) if whole > start else m.span()


#: Six digits with at most two other signs between any two: what every number looked for has.
_NUMBERS = re.compile(r"\d(?:[ .\-/\n()A-Za-z]{0,2}\d){5}")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_STREETS_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Close|Drive|Way|Place|Square|Terrace|Crescent|Gardens|Boulevard|Blvd)"
#: Plain words of which one must occur, then the pattern of a street with its house number.
_ADDRESS = [
    (("St", "Road", "Rd", "Lane", "Ln", "Ave", "Court", "Ct", "Close", "Drive", "Way", "Place", "Square", "Terrace", "Crescent", "Gardens", "Boulevard", "Blvd"), re.compile(
        rf"(?<![\w/-])\d{{1,4}}[A-Za-z]?\s(?:{_CAP}\s){{1,3}}{_STREETS_EN}\b\.?(?:,\s(?:Apt|Flat|Unit)\.?\s\d+\w?)?")),
    (("traße", "trasse", "str.", "gasse", "weg ", "platz ", "allee ", "ring ", "ufer ", "damm ", "weg\n", "platz\n", "Weg ", "Platz ", "Allee ", "Gasse ", "Ring ", "Damm ", "Ufer "), re.compile(
        rf"(?:{_CAP}er\s(?:Straße|Strasse|Weg|Platz|Allee|Gasse|Ring|Damm|Ufer)|[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm))\s\d{{1,4}}\s?[a-z]?(?![\w])(?:,\s(?:D-)?\d{{5}}\s{_CAP})?")),
    (("rue", "place", "chemin", "allée", "avenue", "boulevard", "impasse", "quai", "cours", "route"), re.compile(
        rf"(?<![\w/-])\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s(?:rue|place|chemin|allée|avenue|boulevard|impasse|quai|cours|route)(?:\s(?:de\sla|de\sl[’']|des|du|de|d[’']))?\s?{_CAP}(?:,\s\d{{5}}\s{_CAP})?")),
    (("alle ", "C/", "c/", "venida ", "vda", "laza ", "aseo ", "amino ", "onda ", "ravesía "), re.compile(
        rf"(?:(?:[Cc]alle|[Aa]venida|[Aa]vda\.?|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía)\s|[Cc]/\s?)(?:(?:de\sla|de\slos|de\slas|del|de)\s)?{_CAP},?\s(?:n\.?º\s?)?\d{{1,4}}(?![\w])(?:,\s\d\.?º\s\w|,\sbajo)?(?:,\s\d{{5}}\s{_CAP})?")),
]

_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Dra|Prof|Mme|Mlle|M|Herrn?|Frau|Sr|Sra|Srta)"
_TITLED = re.compile(rf"(?<![\w.°]){_TITLES}\.?\s(?:Dra?\.?\s)?([A-ZÀ-Þ][a-zß-ÿ'’]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?|[A-ZÀ-Þ]{{3,}})(?![\w@]|[._+-]\w*@)")
_INITIAL = re.compile(r"(?<![\w.°'’/-])(?<!° )(?<!\d )[A-ZÀ-Þ]\.\s?(?:[A-ZÀ-Þ]\.\s?)?([A-ZÀ-Þ][a-zß-ÿ'’]{2,}|[A-ZÀ-Þ]{3,})(?![\w@])")
_CAPS_FIRST = re.compile(r"(?<![\w-])([A-ZÀ-Þ][A-ZÀ-Þ'’-]{2,}),\s([A-ZÀ-Þ][a-zß-ÿ]+)(?![\w@])")
_PAIR = re.compile(r"(?<![\w@.+-])([A-ZÀ-Þ][a-zß-ÿ'’]+|[A-ZÀ-Þ]{3,})(?=\s((?:[A-ZÀ-Þ]\.\s)?([A-ZÀ-Þ][a-zß-ÿ'’]+|[A-ZÀ-Þ]{3,}))(?![\w@]))")
_LOWER_PAIR = re.compile(r"(?<![\w@.+-])([a-zß-ÿ]{3,})(?=\s(([a-zß-ÿ]{3,}))(?![\w@]))")
_TITLE_SIGNS = ("Mr", "Ms", "Miss", "Dr", "Prof", "M. ", "M ", "Mme", "Mlle", "Herr", "Frau", "Sr", "M.\n", "M\n")
_TWO_CAPS = re.compile(r"[A-ZÀ-Þ]\.\s?[A-ZÀ-Þ]")
_NO_SIGNS = str.maketrans(dict.fromkeys(",;:.!?()[]{}<>\"'“”„«»‘’", " "))
#: A word after a name that makes it a building or thing (fixed values).
_THING_AFTER = re.compile(r"[\s-](?:building|valve|bau|ventil|tower|hall|wing|house|street|road|gebäude|trial|unit|line|template|store)\b", re.I)


class Names:
    """The directory of known people: given names decide which pairs of words are names, family names confirm bare ones."""

    def __init__(self, people: list[tuple[str | None, str | None]]):
        self.given = {g.strip().lower() for g, _ in people if g and g.strip()}
        self.family = {f.strip().lower() for _, f in people if f and f.strip()}

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        low = text.lower()
        if not self.given.isdisjoint(low.translate(_NO_SIGNS).split()):
            for m in _PAIR.finditer(text):
                if m[1].lower() in self.given and m[3].lower() not in self.given:
                    yield m.start(), m.end(2)
            for m in _CAPS_FIRST.finditer(text):
                if m[2].lower() in self.given:
                    yield m.span()
            for m in _LOWER_PAIR.finditer(text):
                if m[1] in self.given and m[3] in self.family:
                    yield m.start(), m.end(2)
        if any(x in text for x in _TITLE_SIGNS):
            for m in _TITLED.finditer(text):
                if m[1].lower() not in self.given:
                    yield m.span()
        if _TWO_CAPS.search(text):
            for m in _INITIAL.finditer(text):
                if m[1].lower() in self.family or not _common_start(m[1]):
                    yield m.span()


#: Words that start sentences, so that a capital letter and a full stop before them end one (fixed values).
_STARTS = frozenset(
    "the a an if when where while whenever once until unless after before during in on at by for no not this that these as should provided prior every part order batch"
    " write please prepared subject page was sign download der die das den ein eine wenn falls bei bis ist im am nach vor wo zu sofern solange alle jede nehmen le la les"
    " un une des si en au avant après lorsque dès tant sauf par pour el los las una al si cuando antes tras hasta donde según account version teil pièce pieza lot lote charge"
    " auftrag commande pedido wird fehlt sinkt übersteigt innerhalb außerhalb rückwirkend möglichst spätestens without within outside between under over".split()
)


def _common_start(word: str) -> bool:
    return word.lower() in _STARTS


def _iban(text: str, m: re.Match) -> tuple[int, int] | None:
    """The longest valid IBAN from where the match starts."""
    end = m.end()
    while end - m.start() >= 15:
        plain = re.sub(r"[\s-]", "", text[m.start() : end])
        if 15 <= len(plain) <= 34 and plain.isascii() and plain.isalnum() and plain[2:4].isdecimal() and (end == len(text) or not text[end].isalnum()) and mod97(plain) == 1:
            return m.start(), end
        end -= 1
    return None


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, entity) of what is found, in order and without overlap; what is more certain is taken first."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y, _ in out)

    def take(a: int, b: int, kind: str) -> None:
        if free(a, b):
            out.append((a, b, kind))

    def of_things(at: int) -> bool:
        return bool(_THINGS.search(text[max(0, at - 24) : at]))

    if "@" in text:
        for m in _MAIL.finditer(text):
            take(*m.span(), "email")
    if any(x in text for x in _MAIL_SAID_SIGNS) and _MAIL_SAID_CUE.search(text):
        for m in _MAIL_SAID.finditer(text):
            take(*m.span(), "email")
    if _NUMBERS.search(text):
        if _IBAN_HEAD.search(text):
            for m in _IBAN.finditer(text):
                if m[0][:2].upper() != "XX" and (at := _iban(text, m)):
                    take(*at, "iban")
        for cue in _ID_CUE.finditer(text):
            if (m := _ID_VALUE.search(text, cue.end(), cue.end() + 45)) and sum(c.isdecimal() for c in m[0]) >= 6 and "\n\n" not in text[cue.end() : m.start()]:
                take(*m.span(), "idnum")
        for m in _PASS_BARE.finditer(text):
            if not of_things(m.start()):
                take(*m.span(), "idnum")
        for m in _DNI_BARE.finditer(text):
            digits = "".join(c for c in m[0] if c.isdecimal())
            if _DNI_LETTERS[int(digits) % 23] == m[0][-1].upper() and not of_things(m.start()):
                take(*m.span(), "idnum")
        for m in _CARD.finditer(text):
            digits = "".join(c for c in m[0] if c.isdecimal())
            if luhn(digits) and len(set(digits)) > 1 and not of_things(m.start()):
                take(*m.span(), "card")
        for m in _PHONE.finditer(text):
            if 7 <= sum(c.isdecimal() for c in m[0]) <= 20 and not of_things(m.start()):
                take(*_phone(text, m), "phone")
    for signs, pattern in _ADDRESS:
        if any(x in text for x in signs):
            for m in pattern.finditer(text):
                take(*m.span(), "address")
    for a, b in names.spans(text):
        if not _THING_AFTER.match(text, b):
            take(a, b, "name")
    return sorted(out)


_MARKS = {"email": "[EMAIL]", "address": "[ADDRESS]", "name": "[NAME]"}


def placeholder(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value: numbers carry their pseudonym in the format they had."""
    if kind in _MARKS:
        return _MARKS[kind]
    if kind == "card":
        return f"[CARD {permute_card(value, key)}]"
    if kind == "iban":
        return f"[IBAN {permute_iban(value, key)}]"
    return f"[{kind.upper()} {permute_phone(value, key) if kind == 'phone' else permute_idnum(value, key)}]"


#: A date of birth: the only dates that are a person's.
_BIRTH = re.compile(r"(\b(?:born|date of birth|geboren|geb\.|née?(?: le)?|nacid[oa]|fecha de nacimiento)\b[^\d\n]{0,12})(\d{4}-\d\d-\d\d|\d\d([./])\d\d\3\d{4})", re.I)


def mask(text: str | None, names: Names, key: bytes) -> str | None:
    """The text with placeholders; dates of birth become other dates in their format."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, kind in find(text, names):
        parts += [text[at:a], placeholder(kind, text[a:b], key)]
        at = b
    return _BIRTH.sub(lambda m: m[1] + permute_date(m[2], key), "".join([*parts, text[at:]]))


def people(staff: DataFrame) -> Names | None:
    """The directory, read whole if it has no more than KNOWN_PEOPLE rows; else None."""
    rows = staff.select("given_name", "family_name").distinct().limit(KNOWN_PEOPLE + 1).collect()
    return Names([tuple(r) for r in rows]) if len(rows) <= KNOWN_PEOPLE else None


def records(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """origin, rec_id, text of both tables; rows without id or text have nothing to find."""
    return requests.select(F.lit("request").alias("origin"), F.col("query_id").alias("rec_id"), F.col("query").alias("text")).unionByName(
        chunks.select(F.lit("chunk").alias("origin"), F.col("id").alias("rec_id"), "text")
    )


def with_people(rows: DataFrame, staff: DataFrame) -> DataFrame:
    """``rows`` (origin, rec_id, text) with given and family: the names of the directory that occur in the text as words. For directories
    that are too large for a task: the different words of the texts are joined with it, and come back by text."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}'’]+)"), F.lit(1)))).alias("word")
    words = rows.where("text is not null").select(F.xxhash64("text").alias("of"), word).distinct()
    out = rows.withColumn("of", F.xxhash64("text"))
    for column in ("given_name", "family_name"):
        known = staff.select(F.lower(F.trim(column)).alias("word")).where("word <> ''").distinct()
        out = out.join(words.join(known, "word").groupBy("of").agg(F.collect_list("word").alias(column)), "of", "left")
    return out.select("origin", "rec_id", "text", "given_name", "family_name")


def _each(rows: DataFrame, staff: DataFrame, one, schema: str) -> DataFrame:
    """``one`` (columns of a batch, the names of each row) over all records."""
    names = people(staff)
    if names is None:
        rows = with_people(rows, staff)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origins, ids, texts, *own = (c.to_pylist() for c in batch.columns)
            known = [Names([(g, None) for g in given or []] + [(None, f) for f in family or []]) for given, family in zip(*own)] if own else [names] * len(ids)
            yield pa.RecordBatch.from_arrays(*one(origins, ids, texts, known))

    return rows.mapInArrow(run, schema)


def found(requests: DataFrame, chunks: DataFrame, staff: DataFrame) -> DataFrame:
    """p5_found: origin, rec_id, entity. Null ids and texts give no rows; a record delivered twice gives its rows once."""

    def one(origins, ids, texts, names):
        rows = [(origin, rec, kind) for origin, rec, text, known in zip(origins, ids, texts, names) for kind in {kind for _, _, kind in find(text, known)}]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["origin", "rec_id", "entity"]

    rows = records(requests, chunks).where("rec_id is not null and text is not null and text <> ''")
    return _each(rows, staff, one, "origin string, rec_id bigint, entity string").distinct()


def masked(requests: DataFrame, chunks: DataFrame, staff: DataFrame, key: bytes) -> DataFrame:
    """origin, rec_id, text with placeholders, one row for each row of either table; null and empty texts stay as they are. ``key`` (16 to 64
    bytes) is the deployment's secret: with the same key, equal values stay linked from run to run."""
    if not 16 <= len(key or b"") <= 64:
        raise ValueError("a secret key of 16 to 64 bytes is needed")

    def one(origins, ids, texts, names):
        return [pa.array(origins, pa.string()), pa.array(ids, pa.int64()), pa.array([mask(t, known, key) for t, known in zip(texts, names)], pa.string())], ["origin", "rec_id", "text"]

    return _each(records(requests, chunks), staff, one, "origin string, rec_id bigint, text string")
