"""Personal information in free text: spans, keyed surrogates, and typed placeholders.

Detection is by grammar: e-mail addresses in plain and spelled-out writing, phone numbers and identity numbers by their
national formats and check digits, street addresses by language. People's names: a given name of the list GIVEN in any
case with a family name after it (or before it and a comma), an initial with a family name, and two or three capitalised
words beside something that introduces a person (a title, a role, a verb of speaking, a signature, ...). A name found
once counts wherever it stands again in the text. Spans are resolved by start, kind order and length.

Surrogates: every value is replaced by a keyed stand-in of the same type, script, case and format. A value's variable
characters are a number in the mixed radix of their alphabets (digits; vowels and consonants; a list of given names of
one gender), and a keyed permutation of all numbers of that shape without a fixed point gives the stand-in. So distinct values
have distinct stand-ins and equal ones equal stand-ins, in a text, in a record and in the whole corpus, without any state
or shuffle. The collision check that goes with each record covers values of different shapes. p2_found gives the places
of these replacements. `redact` writes #TYPE_NNN# at the same places, numbered by first appearance of each distinct value (by its
normal form, so spellings of one value share a number).

Results on odd input: null and empty texts give no rows and stay as they are; placeholders are never matched; repeated
rows of a draft_id count once per text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from functools import cache, lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.frames import by_batch, spread

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "USER")
_I = re.IGNORECASE

# --- e-mail ---------------------------------------------------------------------------------------------------------
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![\w.%+'#-])(?P<at>[A-Za-z0-9_](?:[\w.%+'-]*[\w])?)"
_MAIL = re.compile(_LOCAL + rf"(?:@|＠|%40|&#64;)(?P<host>{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}+)(?![\w-]|:[\w~/])")
_SPELT = re.compile(
    _LOCAL
    + rf"(?:\s?[\[({{]\s?at\s?[\])}}]\s?(?P<h1>{_LABEL}(?:(?:\.|\s?[\[({{]\s?dot\s?[\])}}]\s?|\sdot\s){_LABEL})+)"
    + rf"|\s(?:at|@)\s(?P<h2>{_LABEL}(?:(?:\sdot\s|\s?[\[({{]\s?dot\s?[\])}}]\s?){_LABEL})+)"
    + rf"|@(?P<h3>{_LABEL}(?:(?:\sdot\s|\s?[\[({{]\s?dot\s?[\])}}]\s?){_LABEL})+))",
    _I,
)
_URL_BEFORE = re.compile(r"://\S*$")

# --- phone ----------------------------------------------------------------------------------------------------------
_PHONE = re.compile(
    r"(?<![\w.+/#@-])(?<![\d)] )(?:"
    r"\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,5})){2,6}+"
    r"|\(\d{2,4}\) ?\d{3,4}[ .-]\d{4}"
    r"|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}"
    r"|\d{3}([-. ])\d{3}\1\d{4}"
    r"|0\d{4} \d{6}"
    r"|0\d{4} \d{3} \d{3}"
    r"|0\d{2} \d{4} \d{4}"
    r"|0\d([. ])\d\d\2\d\d\2\d\d\2\d\d"
    r"|0\d{2,4}/\d{4,6}-\d{2,4}"
    r")(?:,? ?ext\.? ?\d{1,6})?(?![\w-]|[./]\d| \d{3,})"
)

# --- identity numbers -----------------------------------------------------------------------------------------------
_ID = re.compile(
    r"(?<![\w./+#-])(?<!\d )(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[-+]\d{4}"
    r"|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D]|QQ ?\d\d ?\d\d ?\d\d ?[A-D]"
    r")(?![\w-]|[./]\d| \d)"
)
_PASSPORT = re.compile(r"\bpass\w*t\b(?:\s?(?:no|nr|number|num|#)\b)?[.:]*\s*[\"'(]?(?P<at>[A-Z]{1,2}\d{6,8})(?!\w)", _I)
_CHECKED = re.compile(r"(?<![\w./+#-])(?:(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)|(?P<cpf>\d{3}\.\d{3}\.\d{3}-\d{2})|(?P<dni>[\dXYZ]\d{7}-?[A-Z]))(?![\w-])")
_PASSPORT_BARE = re.compile(r"(?<![\w./+#-])[A-Z]\d{8}(?![\w-]|[./]\d)")

# --- street addresses -----------------------------------------------------------------------------------------------
_TYPES = r"(?:Street|St\b\.?|Avenue|Ave\b\.?|Road|Rd\b\.?|Close|Court|Ct\b\.?|Row|Drive|Boulevard|Blvd\b\.?|Lane|Ln\b\.?|Way|Terrace|Place|Square|Crescent|Grove|Hill|Gardens|Parkway|Alley)"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? #?\w{1,5},?\s+)?"
_W = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_ADDRESS = re.compile(
    rf"(?<![\w#/.-])(?:{_UNIT}\d{{1,5}}[A-Za-z]?,? (?:{_W} ){{1,4}}?{_TYPES}(?![\w'’])(?:(?:, |\n)(?:Flat|Apt|Apartment|Unit|Suite)\.? \w{{1,5}}(?:(?:, |\n){_W}(?: {_W})?)?|, {_W}(?: {_W})?)?"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|cours) (?:(?:de la|de l'|du|des|de|d'|la|le|les) ?)?{_W}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Ronda|Travesía) (?:(?:de|del|la|los|las|el) ){{0,2}}{_W}(?: {_W}){{0,3}} \d{{1,4}}\b(?:, piso \d+)?"
    rf"|(?:(?:Am|An der|Auf dem|Im|Zum|Zur|Alte|Alter|Neue|Große|Kleine|{_W}) )?{_W}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|graben|hof|berg|steig)? \d{{1,4}}[a-z]?, \d{{5}} {_W}(?: {_W})?"
    rf"|{_W}(?:straße|strasse|str\.|gasse|weg|platz|allee|graben) \d{{1,4}}\b)"
)
_ADDRESS_HINT = re.compile(r"\d[\s\w'’]{0,30}(?:St|Ave|Road|Rd|Close|C(?:our)?t|Row|Drive|B(?:ou)?l|L(?:a)?n|Way|Terr|Place|Squ|Cresc|Gr|Hill|Gard|Park|All)|rue |boulevard|avenue|chemin|impasse|quai |Calle|Avenida|Plaza|Paseo|Camino|, \d{5} |straße|strasse|gasse|weg |platz|allee|graben")

# --- names ----------------------------------------------------------------------------------------------------------
#: Given names by gender (fixed values: common names of many languages; none that is an English word as well).
GIVEN = {
    "f": "Agnes Agnieszka Aisha Alice Amina Ana Anita Anna Astrid Barbara Beatrix Camille Carmen Carla Carolina Catherine Celia Charlotte Chiara Clara Dorothy Elena Elif Elizabeth Emma Erika Fatima Freya Gabriela Greta Hana Hannah Helen Imani Ines Ingrid Irene Isabel Jane Jennifer Jessica Julia Karen Katarzyna Katya Laura Layla Leila Linda Linnea Lucía Magdalena Maren Margaret Maria María Mary Mirela Nadia Natalia Nina Odette Olga Patricia Paula Priya Renske Sarah Selma Sofia Susan Svetlana Tamsin Tatiana Ulrike Wanda Xenia Yara Yuki Zofia Zoë".split(),
    "m": "Abdul Ahmed Alejandro Alexander Ali Andrzej Anthony Anton Antonio Arjun Ben Boris Bram Bruno Carlos Casper Charles Christopher Daniel David Desmond Diego Dmitri Edward Emil Erik Fernando François George Giovanni Goran Hans Hassan Henry Hiroshi Igor Ivan James Javier Jean Johannes John Joost José Juan Jürgen Kenji Kwame Lars Leopold Luca Ludwig Luis Marco Mateo Matthew Michael Mohammed Niko Oleg Olaf Omar Oskar Pablo Paul Pedro Peter Philip Pierre Piotr Quentin Rafael Rahul Rashid Richard Robert Sergei Søren Stefan Steven Thomas Tobias Tom Vikram Viktor Vladimir William Wolfgang Yusuf".split(),
    "n": "Alex Andrea Charlie Jamie Kim Leslie Mika Noel Sam Sasha Toni".split(),
}
_GENDER = {name.lower(): (kind, i) for kind, names in GIVEN.items() for i, name in enumerate(names)}
_UP = "".join(chr(n) for n in (*range(0x41, 0x250), *range(0x370, 0x530)) if chr(n).isupper())
_C = rf"[{_UP}][^\W\d_]*(?:['’-][^\W\d_]{{2,}})*"  # a word with a capital
_L = r"[^\W\d_]{2,}(?:['’-][^\W\d_]{2,})*"  # a word in any case
_INITIAL = rf"[{_UP}]\."
_AFTER_GIVEN = re.compile(rf" (?:{_INITIAL} )?(?P<last>{_L}|[^\W\d_]['’][^\W\d_]{{2,}})(?![^\W_])")
_BEFORE_GIVEN = re.compile(rf"(?<![\w#'’/@.-])(?P<at>{_C}), $")
_MIDDLE = re.compile(rf" {_INITIAL}(?!\w)")
_WITH_INITIAL = re.compile(rf"(?<![\w#'’/@.-]){_INITIAL} (?:{_INITIAL} )?(?P<last>{_C})(?![^\W_])")
_CAPITALISED = re.compile(rf"(?<![\w#'’/@.-])(?P<first>{_C})(?: {_INITIAL})?(?: (?:van|von|de|der|den|di|da|del|la|le|bin|al))*(?:,)? (?P<last>{_C})(?![^\W_])")
#: What introduces a person: titles, roles and labels, verbs, signatures, people naming themselves.
_INTRODUCED = re.compile(
    r"(?:\b(?i:mr|mrs|ms|mx|dr|prof|sr|sra|mme|mlle|herr|frau|señora?|monsieur|madame|sir|pan|pani)\.? "
    r"|\b(?i:authors?|owner|assignee|reviewer|maintainer|contact|manager|attn|cc|bcc|client|patient|customer|employee|colleague|name|autor|autorin|auteur|kontakt|contacto|verfasser)[\"']?\s*[:=]\s*[\"']?"
    r"|\b(?i:manager|colleague|teammate|boss|friend|customer|kollege|kollegin|collègue|compañer[oa]) "
    r"|(?i:-by): "
    r"|\b(?i:ask|asked|contact|email|emailed|ping|pinged|met|thank|thanks to|told|tell|cc|spoke with|spoke to|talked to|talk to|belongs to|assigned to|reports to|(?:written|reviewed|approved|reported|signed|sent) by|merci à|danke an|gracias a|frag|fragen sie|contactez|contacter|contacta a|todo\()\s?"
    r"|\b(?i:my name is|i am|i'm|this is|je m'appelle|je suis|ich heiße|ich bin|mein name ist|me llamo|soy|mi chiamo|nazywam się|меня зовут) "
    r"|\b(?i:regards|best|thanks|cheers|sincerely|wishes|grüße|grüßen|cordialement|saludos|atentamente|pozdrawiam),?[ \t]*\n\s*|\b(?i:regards|grüßen), )$"
)
_SPEAKS = re.compile(r"(?:['’]s\b(?! law)| (?:said|says|wrote|told|asked|thinks|works|lives|joined|agreed|replied|reported|explained|owns|leads|manages|sagte|schrieb|arbeitet|meint|a dit|écrit|travaille|dijo|escribió|trabaja|ha scritto|powiedział|napisała?)\b|,? who\b|,? here\b,|,? (?:phone|tel|e-?mail|ssn|born)\b| ?[<(](?:[\w.+-]+@|\+?\d[\d .-]{6,}|#(?:PHONE|EMAIL)_))")
#: Words that no name of unknown given name holds (fixed values): function words, days, months, common heads of titles.
_NOT_NAMES = frozenset("""about after alley alpha also and another any api april august avenue back basic because before best beta big black blue board book box branch buffer build
but can certificate change city class client cloud code commit company content core daily dark data day days december default delta design did does domain done down end error even every february
file final first for friday from full general global good google great green group had has have he hello help her here his hot how i if in into is issue it its january july june just key last later
left level light line linux list log long machine main manager march master memory monday model morning name network never new next night nightly no nobody not note november now october of off on once only open
or our out over page paper part people personal platform please private project public python queue quick random read red refactor release report request right ring robin room round row runtime said saturday science see
september server service she should small social some someone spark spring square state still storage street summer sunday system table task team test than thanks that the their them then there these they this those
thread thursday time to today token tomorrow tree tuesday two under university update us user version view was we wednesday week were what when where which while white who why will windows winter with work world would yes yesterday you your""".split())


def _checked(m: re.Match) -> bool:
    """The check digits of an IBAN, a CPF or a DNI."""
    value = re.sub(r"[ .-]", "", m[0])
    if m["iban"]:
        return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1
    if m["cpf"]:
        digits = [int(c) for c in value]
        return len(set(digits)) > 1 and all(sum(d * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10 % 11 % 10 == digits[n] for n in (9, 10))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(value[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == value[-1]


@cache
def _given():
    machine = ahocorasick.Automaton()
    for name in _GENDER:
        machine.add_word(name, len(name))
    machine.make_automaton()
    return machine


def _names(text: str, low: str) -> list[tuple[int, int]]:
    found: dict[int, int] = {}

    def add(a: int, b: int) -> None:
        found[a] = max(found.get(a, 0), b)

    for end, size in _given().iter(low) if len(low) == len(text) else ():
        a, b = end + 1 - size, end + 1
        if a and (text[a - 1].isalnum() or text[a - 1] in "_#'’/@.-") or text[b : b + 1].isalnum():
            continue
        capital = text[a].isupper()
        if capital and text[a - 2 : a] == ", " and (m := _BEFORE_GIVEN.search(text, max(0, a - 40), a)) and m["at"].lower() not in _NOT_NAMES:
            add(m.start("at"), (_MIDDLE.match(text, b) or re.match("", text)).end() or b)
            continue
        m = _AFTER_GIVEN.match(text, b)
        if m and m["last"].lower() not in _NOT_NAMES and (m["last"][0].isupper() if capital else m["last"].islower() and len(m["last"]) > 3):
            add(a, m.end())
    for m in _WITH_INITIAL.finditer(text):
        if m["last"].lower() not in _NOT_NAMES and len(m["last"]) > 3:
            add(*m.span())
    m = _CAPITALISED.search(text)
    while m:
        a, b = m.span()
        person = a not in found and m["first"].lower() not in _NOT_NAMES and m["last"].lower() not in _NOT_NAMES and len(m["last"]) > 2 and (_INTRODUCED.search(text, max(0, a - 40), a) or _SPEAKS.match(text, b))
        if person:
            add(a, b)
        m = _CAPITALISED.search(text, b if person else m.end("first"))  # "Ask Jane" may hide "Jane Doe"
    for value in {text[a:b] for a, b in found.items()}:
        if len(value) > 5:
            at = text.find(value)
            while at >= 0:
                end = at + len(value)
                if not (at and (text[at - 1].isalnum() or text[at - 1] in "'’-#")) and not text[end : end + 1].isalnum():
                    found.setdefault(at, end)
                at = text.find(value, end)
    return list(found.items())


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every occurrence, in order, without overlaps."""
    if not text:
        return []
    low = text.lower()
    found: list[tuple[int, int, int]] = []
    if "@" in text or "＠" in text or "%40" in text or "&#64;" in text:
        found += [(*m.span(), 0) for m in _MAIL.finditer(text) if not _URL_BEFORE.search(text, max(0, m.start() - 300), m.start())]
    if "dot" in low or "[at]" in low or "(at)" in low:
        found += [(*m.span(), 0) for m in _SPELT.finditer(text) if not _URL_BEFORE.search(text, max(0, m.start() - 300), m.start())]
    found += [(*m.span(), 1) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 16]
    found += [(*m.span(), 2) for m in _ID.finditer(text)]
    if "pass" in low:
        found += [(*m.span("at"), 2) for m in _PASSPORT.finditer(text)]
    found += [(*m.span(), 2) for m in _CHECKED.finditer(text) if _checked(m)]
    found += [(*m.span(), 2) for m in _PASSPORT_BARE.finditer(text)]
    if _ADDRESS_HINT.search(text):
        found += [(*m.span(), 3) for m in _ADDRESS.finditer(text)]
    found += [(a, b, 4) for a, b in _names(text, low)]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda s: (s[2], s[0], -s[1])):
        at = bisect(out, (a, b, ""))  # spans kept so far do not overlap, so only the neighbours matter
        if not (at and out[at - 1][1] > a or at < len(out) and out[at][0] < b):
            out.insert(at, (a, b, KINDS[kind]))
    return out


_PLACEHOLDER = re.compile(r"#([A-Z]+)_(\d+)#")
_SPELLINGS = ((re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\s(?:at|@)\s|＠|%40|&#64;"), "@"), (re.compile(r"\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s"), "."))


def normal(kind: str, value: str) -> str:
    """The form under which two spellings are one value."""
    low = " ".join(value.lower().split())
    if kind == "EMAIL":
        return reduce(lambda x, rule: rule[0].sub(rule[1], x), _SPELLINGS, low)
    if kind in ("PHONE", "ID"):
        return "".join(c for c in low if c.isalnum() or c == "+")
    if kind == "USER" and "," in low:
        last, _, first = low.partition(", ")
        return f"{first} {last}"
    return low


def redact(*texts: str | None) -> list[str | None]:
    """The texts of one record with #TYPE_NNN#; numbers run over all of them and past the ones already there."""
    numbers: dict[str, int] = {}
    for text in texts:
        for kind, n in _PLACEHOLDER.findall(text or ""):
            numbers[kind] = max(numbers.get(kind, 0), int(n))
    names: dict[tuple[str, str], str] = {}
    out: list[str | None] = []
    for text in texts:
        parts, at = [], 0
        for a, b, kind in spans(text):
            key = (kind, normal(kind, text[a:b]))
            if key not in names:
                numbers[kind] = numbers.get(kind, 0) + 1
                names[key] = f"#{kind}_{numbers[kind]:03d}#"
            parts += [text[at:a], names[key]]
            at = b
        out.append("".join([*parts, text[at:]]) if text else text)
    return out


# --- surrogates -------------------------------------------------------------------------------------------------------
_VOWELS, _CONSONANTS, _DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789"
_ALPHABETS = (_VOWELS, _CONSONANTS, "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_OF = {c: x for x in _ALPHABETS for c in x}
_ROUNDS = 6


def _mixed(x: int, bits: int, key: bytes, tag: bytes, back: bool) -> int:
    """A keyed permutation of 2 * bits bits (a balanced Feistel network), or its inverse."""
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for r in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
        known = left if back else right
        noise = int.from_bytes(hashlib.blake2b(bytes([r]) + tag + known.to_bytes(bits // 8 + 1, "big"), key=key, digest_size=min(64, bits // 8 + 1)).digest(), "big") & mask
        left, right = (right ^ noise, left) if back else (right, left ^ noise)
    return left << bits | right


def _permuted(x: int, n: int, key: bytes, tag: bytes) -> int:
    """A keyed permutation of 0 ... n - 1 in one cycle, so without a fixed point; values outside are walked through."""
    if n < 2:
        return x
    bits = max(1, (n - 1).bit_length() + 1 >> 1)
    y = _mixed(x, bits, key, tag, False)
    while y >= n:
        y = _mixed(y, bits, key, tag, False)
    y = _mixed((y + 1) % n, bits, key, tag, True)
    while y >= n:
        y = _mixed(y, bits, key, tag, True)
    return y


def _characters(value: str, take: list[int], key: bytes, kind: str) -> str:
    """The characters at `take` replaced: digits by digits, letters by letters of their script, case and class."""
    low = [value[i].lower() for i in take]
    spaces = []
    for k, (i, c) in enumerate(zip(take, low)):
        # a house number does not begin with 0; elsewhere the same digits may be grouped in many ways
        leading = kind == "ADDRESS" and (k == 0 or take[k - 1] != i - 1 or not low[k - 1].isdigit())
        spaces.append(_DIGITS[1:] if c in _DIGITS[1:] and leading else _DIGITS if c in _DIGITS else _OF.get(c, c))
    rank, size = 0, 1
    for c, space in zip(low, spaces):
        rank, size = rank * len(space) + space.index(c), size * len(space)
    rank = _permuted(rank, size, key, f"{kind}|{'|'.join(x[:1] + str(len(x)) for x in spaces)}".encode())
    out = list(value)
    for i, space in zip(reversed(take), reversed(spaces)):
        rank, at = divmod(rank, len(space))
        out[i] = space[at].upper() if value[i].isupper() else space[at]
    return "".join(out)


def _word(word: str, key: bytes) -> str:
    return _characters(word, list(range(len(word))), key, "name")


def _given_name(word: str, key: bytes) -> str:
    """A listed given name becomes another of its gender; an initial another letter; any other name one that is not listed."""
    known = _GENDER.get(word.lower())
    if known:
        names = GIVEN[known[0]]
        new = names[_permuted(known[1], len(names), key, f"given|{known[0]}".encode())]
        return new.upper() if word.isupper() else new.lower() if word.islower() else new
    if len(word.rstrip(".")) == 1:
        at = ord(word[0].lower()) - 97
        return (chr(97 + _permuted(at, 26, key, b"initial")).upper() if 0 <= at < 26 else word[0]) + word[1:]
    new = _word(word, key)
    while new.lower() in _GENDER:
        new = _word(new, key)
    return new


@lru_cache(100_000)
def stand_in(kind: str, value: str, key: bytes) -> str:
    """The keyed stand-in of a value; spellings of one value give spellings of one stand-in."""
    if kind == "USER":
        if ", " in value:
            last, _, first = value.partition(", ")
            return f"{_word(last, key)}, {' '.join(_given_name(w, key) for w in first.split(' '))}"
        *first, last = value.split(" ")
        return " ".join([*(_given_name(w, key) for w in first), _word(last, key)])
    take = [i for i, c in enumerate(value) if c.isascii() and c.isalnum() or c.lower() in _OF]
    if kind == "EMAIL":
        marks = sorted(m.span() for pattern, _ in _SPELLINGS for m in pattern.finditer(value))
        take = [i for i in take if not any(a <= i < b for a, b in marks)]
        end = max([value.rfind(".") + 1, *(b for _, b in marks)])  # the last label stays
        take = [i for i in take if i < end]
    elif kind == "PHONE":
        take = [i for i in take if value[i].isdigit()]
        take = take[2 if value.lstrip("(").startswith("+") else 1 if value[take[0]] in "01" else 0 :]
    elif kind == "ADDRESS":
        words = {i for m in re.finditer(rf"(?<!\w)(?!{_TYPES}(?!\w)){_C}", value) for i in range(*m.span())}
        take = [i for i in take if value[i].isdigit() or i in words]
    return _characters(value, take, key, kind)


def _keys(key: bytes):
    """The key in a form that the hash takes, then others made from it."""
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    while True:
        yield key
        key = hashlib.blake2b(key).digest()


def replacements(key: bytes, *texts: str | None) -> list[list[tuple[int, int, str, str]]]:
    """(start, end, kind, stand-in) of every occurrence in the texts of one record.

    Values of one shape cannot share a stand-in. Should values of different shapes do so (once in billions), the later one takes
    the next key's stand-in, so that distinct values stay distinct.
    """
    owner: dict[tuple[str, str], str] = {}
    chosen: dict[tuple[str, str], bytes] = {}
    out = []
    for text in texts:
        rows = []
        for a, b, kind in spans(text):
            who = normal(kind, text[a:b])
            if (kind, who) not in chosen:
                chosen[kind, who] = next(k for k in _keys(key) if owner.setdefault((kind, normal(kind, stand_in(kind, text[a:b], k))), who) == who)
            rows.append((a, b, kind, stand_in(kind, text[a:b], chosen[kind, who])))
        out.append(rows)
    return out


def surrogates(key: bytes, *texts: str | None) -> list[str | None]:
    """The texts of one record with keyed stand-ins: equal values stay equal, distinct ones distinct."""
    out: list[str | None] = []
    for text, rows in zip(texts, replacements(key, *texts)):
        parts, at = [], 0
        for a, b, _, new in rows:
            parts += [text[at:a], new]
            at = b
        out.append("".join([*parts, text[at:]]) if text else text)
    return out


_FOUND = "src string, draft_id string, field string, kind string, start_pos int, surrogate string"


def replaced(drafts: DataFrame, tokenised: DataFrame, key: bytes) -> DataFrame:
    """One row per occurrence in drafts.quote, drafts.title and tokenised_entries.body, with its stand-in."""
    out = None
    for df, src, fields in ((drafts, "drafts", ("quote", "title")), (tokenised, "tokenised_entries", ("body",))):

        def run(batch: pa.RecordBatch, src=src, fields=fields) -> dict | None:
            rows = [(src, d, f, kind, a, new) for d, *texts in zip(*(batch[c].to_pylist() for c in ("draft_id", *fields))) for f, found in zip(fields, replacements(key, *texts)) for a, _, kind, new in found]
            return dict(zip(("src", "draft_id", "field", "kind", "start_pos", "surrogate"), map(pa.array, zip(*rows), (*(pa.string(),) * 4, pa.int32(), pa.string())))) if rows else None

        part = by_batch(spread(df.select("draft_id", *fields)), run, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def found(drafts: DataFrame, tokenised: DataFrame, key: bytes) -> DataFrame:
    """The places of all replacements, each once."""
    return replaced(drafts, tokenised, key).drop("surrogate").distinct()


def redacted(drafts: DataFrame, tokenised: DataFrame, key: bytes | None = None) -> DataFrame:
    """(src, draft_id, title, text): placeholders, or surrogates under a key; one row per distinct draft text."""
    out = None
    for df, src, field in ((drafts, "drafts", "quote"), (tokenised, "tokenised_entries", "body")):

        def run(batch: pa.RecordBatch, src=src, field=field) -> dict:
            rows = [surrogates(key, a, b) if key else redact(a, b) for a, b in zip(batch["title"].to_pylist(), batch[field].to_pylist())]
            return {"src": pa.array([src] * batch.num_rows), "draft_id": batch["draft_id"], "title": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())}

        part = by_batch(spread(df.select("draft_id", "title", field)), run, "src string, draft_id string, title string, text string")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
