"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corviq.llm.common import bound_batches, fresh, materialize, release, rows_of, slices, with_fields

MAX_TRIES = 64
#: Types of few forms: keyed permutations, which keep them distinct but may give another real one.
PERMUTED = ("birth", "lan")

#: Given names by (script, gender). Surrogates are drawn from the same list.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Sarah Julia Emma Sophie Claire Elena Carmen Lucia Isabel Katharina Johanna Emily Olivia Charlotte Hannah Alice Camille Margaret Susan Linda Jennifer Patricia Elizabeth Barbara Jessica Karen Nancy Monique Brigitte Ingrid Ursula Pilar Dolores Beatriz Martina Nicole Helene",
    ("latin", "m"): "John James Robert Michael William David Richard Joseph Thomas Charles Peter Paul Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Jacques François Henri Louis Antoine Carlos José Juan Miguel Pedro Javier Diego Fernando Daniel Martin George Edward Henry Frank Walter Lukas",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Дарья Ксения",
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Андрей Михаил Николай Владимир Павел Олег Игорь",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Δήμητρα Ιωάννα Βασιλική Χριστίνα Ευαγγελία",
    ("greek", "m"): "Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Βασίλειος Χρήστος Αθανάσιος Μιχαήλ",
}
GIVEN = {k: tuple(v.split()) for k, v in GIVEN.items()}
WHOSE = {name: who for who, names in GIVEN.items() for name in names}
SYLLABLES = {
    "latin": tuple("bar den fel gor han kel lar mer nor pel ros sten tal ver wil zan mon dal ker lin bry cas dor fen".split()),
    "cyrillic": tuple("бар ден гор кал лам мор нов пет рож сел тар вол зим кор лан мир".split()),
    "greek": tuple("παπ αδ γεωρ κων δημ νικ σταμ καρ μαν θεο λαμ μιχ παν χρι βασ αλε".split()),
}
ENDINGS = {
    ("latin", "n"): ("son", "er", "ford", "mann", "ez", "ier", "ley", "stein"),
    ("cyrillic", "m"): ("ов", "ев", "ин"),
    ("cyrillic", "f"): ("ова", "ева", "ина"),
    ("greek", "m"): ("όπουλος", "άκης", "ίδης"),
    ("greek", "f"): ("οπούλου", "άκη", "ίδου"),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n"}
#: Capitalised words that begin sentences and letters, not names.
STARTS = frozenset(
    "The This That These Those An And But Or If In On At By For From With To Of As He She It We They You His Her Our Their My Your When While After Before Then There Here What Which Who Why How Is Are Was Were Not No Yes "
    "Der Die Das Ein Eine Und Aber Wenn Im Am Von Zu Mit Für Le La Les Un Une Et Mais Si Dans De Du Des El Los Las Pero En Con Para Por Dear Hello Hi Regards Sincerely Liebe Lieber Chère Cher Querido Querida Contact Author Name "
    "Later Today Yesterday Now Also Finally However Meanwhile Perhaps Maybe Soon Once Since Although Because Gestern Heute Dann Später Hoy Ayer Hier Alors Puis Ensuite".split()
)
GENDERED = {"m": ("us", "an", "or", "eo"), "f": ("ina", "elle", "ia", "anne"), "n": ("is", "en", "el")}
GIVEN_ENDINGS = {
    **{("latin", g): e for g, e in GENDERED.items()},
    ("cyrillic", "m"): ("ан", "ир", "слав"), ("cyrillic", "f"): ("ина", "ия", "слава"), ("cyrillic", "n"): ("ен",),
    ("greek", "m"): ("ος", "ιος"), ("greek", "f"): ("ία", "ίνα"), ("greek", "n"): ("ις",),
}

_WORD = r"[^\W\d_]"
_UPPER = r"[^\W\d_a-zа-яёα-ωß-öø-ÿ]"
_CAP = rf"{_UPPER}(?:{_WORD}|['’]{_UPPER}){_WORD}*(?:['’-]{_WORD}+)*"
_TITLE = "|".join(TITLES)
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}")
_GROUP = r"(?! (?:\d{1,3}\.){3}\d)[ .-]?"
NUMERIC = re.compile(
    r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    # digits in groups, none of which begins an address after a blank; numbers of zone 1 have a length of their own
    r"|(?P<phone>(?<![\w.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|\+\d{{1,3}}[ .-]?(?:\(\d{{1,5}}\)[ .-]?)?\d{{2,4}}(?:{_GROUP}\d{{2,5}}){{1,5}}|\(\d{{2,5}}\)[ .-]?\d{{3,4}}(?:{_GROUP}\d{{2,5}}){{1,3}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}})(?![\w]))"
)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)[0-9A-Fa-f:]{1,38}(?![\w:])")
BORN = re.compile(
    r"(?i:\b(?:born(?: on)?|dob|date of birth|birthday|geboren(?: am)?|geb\.|née? le|nacid[oa] el|fecha de nacimiento|дата рождения))[: ]{1,2}"
    r"(?P<birth>\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)"
)
ADDRESS = re.compile(
    rf"(?P<street>(?<![\w.,])\d{{1,5}} (?:{_CAP} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)\b"
    rf"|\b[^\W\d_a-z]{_WORD}*(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}[a-z]?\b"
    rf"|(?<![\w.,])\d{{1,4}},? (?:rue|avenue|boulevard|place) (?:de la |de |du |des )?{_CAP}"
    rf"|\b(?:Calle|Avenida|Plaza) (?:de la |de |del )?{_CAP},? \d{{1,4}}\b)"
)
STREET_WORDS = frozenset("street st avenue ave road rd lane ln drive boulevard blvd court square rue place calle avenida plaza de la du des del".split())
STREET_TAILS = ("straße", "strasse", "weg", "platz", "allee", "gasse")
SECRET = re.compile(
    r"(?P<aws>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|\b(?i:api[_-]?key|secret|token|passwd|password|pwd)\b\s*[=:]\s*[\"']?(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<pat>\b(?:ghp_|sk_live_|sk-|xox[bp]-)[A-Za-z0-9-]{16,})"
)
DIGIT = re.compile(r"[0-9]")
RUN = re.compile(rf"(?<!\w)(?:(?:{_TITLE})\.|{_CAP})(?: (?:(?:{_TITLE})\.|{_CAP}))+")
ONE = re.compile(rf"(?<!\w){_CAP}")
CUE_BEFORE = re.compile(
    r"(?:\b(?:[Bb]y|[Aa]uthors?|[Nn]ames?|named|[Cc]ontact|[Ss]igned|[Dd]ear|[Rr]egards|[Ss]incerely|[Aa]ttn|[Cc]c|[Ff]rom|[Vv]on|[Pp]ar|[Pp]or|[Aa]utor|[Aa]uteur|[Ll]ieber?|[Cc]h[eè]re?|[Qq]uerid[oa]|[Аа]втор)[:,]?[ \n])$"
)
CUE_AFTER = re.compile(
    r",? (?:wrote|said|says|told|asked|replied|added|explained|announced|argued|joined|works|worked|lives|lived|called|emailed|signed|was born|born|schrieb|sagte?|fragte|erklärte|wohnt|arbeitet|écrit|dit|déclare|déclaré|habite|travaille|dijo|dice|escribió|explicó|vive|trabaja|сказала?|написала?)\b"
    r"|,? (?:a|ha|hat) (?:écrit|dit|déclaré|dicho|escrito|gesagt|geschrieben)\b| ?[<(][\w.+-]+@"
)
BETWEEN = frozenset((" and ", " & ", ", ", ", and ", " und ", " et ", " y ", " e ", " и ", " και "))
PREFIXES = ("AKIA", "ASIA", "ghp_", "sk_live_", "sk-", "xox")


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (int(d) * 2 - 9 * (int(d) > 4)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> int:
    """1 for a bank account number whose check digits are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ipv6(text: str) -> str | None:
    try:
        return str(ipaddress.IPv6Address(text)) if text.count(":") > 2 else None
    except ValueError:
        return None


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value to compare) of the entities of a text, in order and without overlap.

    The value is what makes two mentions one entity: emails, names and addresses without regard to case, numbers by
    their digits. Card numbers must have a right check digit: other long numbers are no personal data.
    """
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    emails = [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)] if "@" in text else []
    out += emails
    if DIGIT.search(text):
        for m in NUMERIC.finditer(text):
            kind, value = m.lastgroup, m[0]
            digits = re.sub(r"\D", "", value)
            if kind == "phone" and not 7 <= len(digits) <= 15 or kind == "card" and not luhn(digits):
                continue
            key = re.sub(r"[ ]", "", value) if kind == "iban" else value if kind == "ip" else ("+" if value[0] == "+" else "") + digits
            if kind == "ip" and _suffix_bits(*map(int, value.split(".")[:2])):
                kind = "lan"
            out.append((m.start(), m.end(), kind, key))
        out += [(*m.span("birth"), "birth", m["birth"]) for m in BORN.finditer(text)]
        out += [(m.start(), m.end(), "street", " ".join(m[0].casefold().split())) for m in ADDRESS.finditer(text)]
    if ":" in text:
        out += [(m.start(), m.end(), "ipv6", value) for m in IPV6.finditer(text) if (value := _ipv6(m[0]))]
    if "=" in text or ":" in text or any(p in text for p in PREFIXES):
        for m in SECRET.finditer(text):
            out.append((*m.span(m.lastgroup), m.lastgroup, m[m.lastgroup]))
    out += _persons(text, [e[3] for e in emails])
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


def _persons(text: str, emails: list[str]) -> list[tuple[int, int, str, str]]:
    """Names: a title with a surname, a known given name with a surname, and runs of two or three capitalised words that
    are told as names by what stands around them: a word that names go with, another name beside them, or an email
    address made of them. A given name or surname of such a person that stands alone elsewhere in the text is the
    same entity, whatever its case."""
    runs: list[tuple[int, int, list[tuple[str, int]], str | None]] = []  # start, end, (word, start), title's gender
    for m in RUN.finditer(text):
        words = [(w.group(), m.start() + w.start()) for w in re.finditer(r"\S+", m[0])]
        title = None
        while words and (words[0][0].rstrip(".") in TITLES or words[0][0] in STARTS):
            gender = TITLES.get(words[0][0].rstrip("."))
            title = gender if gender and title in (None, "n") else title
            words = words[1:]
        stop = next((k for k, (w, _) in enumerate(words) if not w[0].isupper() or w.endswith(".")), len(words))
        if words := words[:stop]:
            runs.append((words[0][1], words[-1][1] + len(words[-1][0]), words, title))
    locals_ = [set(re.findall(r"[a-z]{2,}", e.partition("@")[0])) for e in emails]
    found: dict[int, list[tuple[str, int]]] = {}
    for k, (start, end, words, title) in enumerate(runs):
        first = next((n for n, (w, _) in enumerate(words[:-1]) if w in WHOSE), None)
        if title is not None:
            found[k] = words[:3]
        elif first is not None:
            last = first + 1
            while last + 1 < len(words) and words[last][0] in WHOSE:
                last += 1
            found[k] = words[first : last + 1]
        elif 2 <= len(words) <= 3 and words[-1][0] not in WHOSE:
            plain = {w.casefold() for w, _ in words}
            if CUE_BEFORE.search(text, max(0, start - 24), start) or CUE_AFTER.match(text, end) or any(len(plain & parts) > 1 for parts in locals_):
                found[k] = words
    for way in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):  # names beside names, on and back
        for k in way:
            near = k - 1 if way.step > 0 else k + 1
            a, b = min(k, near), max(k, near)
            if k not in found and near in found and 2 <= len(runs[k][2]) <= 3 and text[runs[a][1] : runs[b][0]] in BETWEEN:
                found[k] = runs[k][2]
    out, known = [], {}
    for k, words in found.items():
        title = runs[k][3]
        gender = next((WHOSE[w][1] for w, _ in words if w in WHOSE), title or "n")
        for n, (word, at) in enumerate(words):
            script = _script(word)
            if n < len(words) - 1:
                kind = f"given-{script}-{WHOSE[word][1] if word in WHOSE else gender}"
            else:
                kind = f"name-{script}-{'n' if script == 'latin' else 'm' if gender == 'n' else gender}"
            kind = known.setdefault(word.casefold(), kind)
            out.append((at, at + len(word), kind, word.casefold()))
    if known:
        taken = {e[0] for e in out}
        out += [(m.start(), m.end(), known[w], w) for m in ONE.finditer(text) if m.start() not in taken and m[0] not in STARTS and (w := m[0].casefold()) in known]
    return out


class _Stream:
    """Keyed pseudo-random numbers for one entity and try."""

    def __init__(self, key: bytes, kind: str, value: str, tries: int):
        self.seed, self.n, self.pool = b"\x00".join((kind.encode(), value.encode("utf-8", "surrogatepass"), str(tries).encode())), 0, 0
        self.key, self.left = key, 0

    def below(self, n: int) -> int:
        if self.left < 64:
            digest = hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.pool, self.left, self.n = self.pool << 512 | int.from_bytes(digest, "big"), self.left + 512, self.n + 1
        self.left -= 40
        self.pool, out = divmod(self.pool, 1 << 40)
        return out % n


def _shape(value: str, s: _Stream, lead: bool = True) -> str:
    """Letters become letters of their case, digits digits (a leading one stays above zero), the rest stays."""
    out, start = [], True
    for c in value:
        if c in "0123456789":
            out.append(str(1 + s.below(9)) if start and lead and c != "0" else str(s.below(10)))
            start = False
        elif c.isascii() and c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + s.below(26)))
        else:
            start = True
            out.append(c)
    return "".join(out)


def _suffix_bits(a: int, b: int) -> int:
    """How many bits of an IPv4 address name the host in a network that isn't public; 0 for public addresses."""
    if a in (0, 10, 127):
        return 24
    if (a, b) in ((192, 168), (169, 254)):
        return 16
    return 20 if a == 172 and 16 <= b < 32 else 22 if a == 100 and 64 <= b < 128 else 28 if a >= 224 else 0


def _permuted(key: bytes, label: str, n: int, bits: int) -> int:
    """A keyed permutation of the numbers of an even number of bits (four Feistel rounds)."""
    half = bits // 2
    left, right = n >> half, n & (1 << half) - 1
    for k in range(4):
        digest = hashlib.blake2b(f"{label}/{k}/{right}".encode(), key=key, digest_size=8).digest()
        left, right = right, left ^ int.from_bytes(digest, "big") & (1 << half) - 1
    return left << half | right


def _shifted(key: bytes, value: str) -> str:
    """A date some days later, as many for all dates: distinct ones stay distinct. Dates that don't exist become any."""
    days = 30 + _Stream(key, "birth", "", 0).below(3000)
    sign = next(c for c in value if not c.isdigit())
    parts = value.split(sign)
    year = 0 if len(parts[0]) == 4 else 2
    month = 1 if year == 0 or int(parts[1]) <= 12 else 0
    day = 3 - year - month
    try:
        moved = datetime.date(int(parts[year]), int(parts[month]), int(parts[day])) + datetime.timedelta(days)
    except (ValueError, OverflowError):
        moved = datetime.date(1950, 1, 1) + datetime.timedelta(_Stream(key, "birth", value, 0).below(20000))
    for n, x in ((year, moved.year), (month, moved.month), (day, moved.day)):
        parts[n] = f"{x:0{len(parts[n])}d}"
    return sign.join(parts)


def country_code(digits: str) -> int:
    """How many of the digits after a plus are the country's: one in zones 1 and 7, else two or three."""
    if digits[0] in "17":
        return 1
    two = digits[:2] in ("20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98")
    return 2 if two else 3


def _name(s: _Stream, script: str, endings: tuple[str, ...], tries: int) -> str:
    parts = SYLLABLES[script]
    return "".join(parts[s.below(len(parts))] for _ in range(2 + min(tries, 8) // 2)) + endings[s.below(len(endings))]


@lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, value: str, tries: int) -> str:
    """The surrogate of an entity at the given try, in the form of its comparing value."""
    s = _Stream(key, kind, value, tries)
    longer = "".join(chr(97 + s.below(26)) for _ in range(max(0, tries - 8)))  # where short forms run out
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        host = _Stream(key, "domain", domain, 0)
        return _shape(local, s, False) + longer + "@" + ".".join([*(_shape(x, host, False) for x in labels[:-1]), labels[-1]])
    if kind == "lan":
        bits, n = _suffix_bits(*map(int, value.split(".")[:2])), int(ipaddress.IPv4Address(value))
        low = n & (1 << bits) - 1
        return str(ipaddress.IPv4Address(n - low + _permuted(key, f"lan/{n >> bits}", low, bits)))
    if kind == "ip":
        while True:
            a, b = 1 + s.below(223), s.below(256)
            if not _suffix_bits(a, b):
                return f"{a}.{b}.{s.below(256)}.{1 + s.below(254)}"
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(value).exploded.split(":")
        kept = 2 if groups[0] in ("2001", "0000") or groups[0][:2] in ("fe", "fc", "fd") else 1
        return str(ipaddress.IPv6Address(":".join(g if n < kept or g == "0000" else f"{1 + s.below(65535):04x}" for n, g in enumerate(groups))))
    if kind == "birth":
        return _shifted(key, value)
    if kind == "street":
        out = []
        for word in value.split():
            bare = word.rstrip(",")
            tail = next((t for t in STREET_TAILS if bare.endswith(t)), None)
            if bare[0].isdigit():
                out.append(_shape(word, s))
            elif bare in STREET_WORDS:
                out.append(word)
            elif tail:
                out.append(_name(s, "latin", ("er", "en", "el"), tries) + tail + word[len(bare) :])
            else:
                out.append(_name(s, "latin", ENDINGS["latin", "n"], tries) + word[len(bare) :])
        return " ".join(out)
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "phone":
        head = value[: 1 + country_code(value[1:])] if value[0] == "+" else ""
        return head + _shape(value[len(head) :], s)
    if kind == "iban":
        rest = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in value[4:])
        if mod97(value) != 1:
            return value[:2] + f"{s.below(100):02d}" + rest
        return value[:2] + f"{98 - mod97(value[:2] + '00' + rest):02d}" + rest
    if kind == "aws":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in value[4:])
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    if kind == "pat":
        head = re.match(r"ghp_|sk_live_|sk-|xox[bp]-", value)[0]
        return head + _shape(value[len(head) :], s, False)
    if kind.startswith("given-"):
        _, script, gender = kind.split("-")
        names = GIVEN.get((script, gender), ())
        if names and tries < 4:
            return names[s.below(len(names))].casefold()
        return _name(s, script, GIVEN_ENDINGS[script, gender], tries - 4 * bool(names))
    if kind.startswith("name-"):
        _, script, gender = kind.split("-")
        return _name(s, script, ENDINGS[script, "n" if script == "latin" else gender], tries)
    return _shape(value, s, False) + longer


def _fit(kind: str, mention: str, value: str) -> str:
    """The surrogate value in the format of the mention: its separators and its case."""
    if kind in ("phone", "card", "iban", "ssn"):
        it = iter(c for c in value if c != "+")
        return "".join(next(it) if c.isalnum() else c for c in mention)
    if kind == "email" and mention != mention.lower():
        return value.upper() if mention == mention.upper() else "".join(b.upper() if a.isupper() else b for a, b in zip(mention, value, strict=False)) + value[len(mention) :]
    if kind == "ipv6":
        return value.upper() if mention == mention.upper() else value
    if kind == "street":
        given, lower = mention.split(), value.split()
        return " ".join(b if a == a.lower() else b.upper() if a == a.upper() and len(a) > 1 else b[0].upper() + b[1:] for a, b in zip(given, lower, strict=True))
    if kind.startswith(("given-", "name-")):
        return value.upper() if len(mention) > 1 and mention == mention.upper() else value[0].upper() + value[1:]
    return value


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        seen = {(kind, value) for cell in batch.column(0) for _, _, kind, value in find(cell.as_py())}
        rows = sorted(seen)
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])


def _candidates(batches: Iterator[pa.RecordBatch], key: bytes, tries: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, values = rows_of(batch, "kind", "value")
        yield pa.record_batch([*batch.columns, pa.array([surrogate(key, k, v, tries) for k, v in zip(kinds, values, strict=True)], pa.string())], ["kind", "value", "made"])


def _family(kind: str = "kind"):
    """Types whose surrogates may not meet: all surnames share one space, and all given names."""
    return F.when(F.col(kind).startswith("name-"), "name").when(F.col(kind).startswith("given-"), "given").otherwise(F.col(kind))


def retries(entities: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, value, tries) of the entities whose first surrogate collides with another's or with a real entity.

    A collision keeps the smallest value; the others, and those that met a real entity, try again, until the surrogates
    of all entities are distinct, given names included. None if there was no collision.
    """
    entities_written = entities
    entities = entities.where(~F.col("kind").isin(*PERMUTED)).withColumn("family", _family())
    schema = "kind string, value string, made string"
    pending, settled, out = entities.select("kind", "value"), None, None
    real = entities.select("family", F.col("value").alias("made"))
    for tries in range(MAX_TRIES):
        made = pending.select("kind", "value").mapInArrow(lambda it, n=tries: _candidates(it, key, n), schema).withColumn("family", _family())
        free = made.join(real, ["family", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["family", "made"], "left_anti")
        first = free.groupBy("family", "made").agg(F.min(F.struct("value", "kind")).alias("w"))
        won = materialize(first.select("w.kind", "w.value", "made", "family"), entities_written)
        if tries:
            rows = won.select("kind", "value", F.lit(tries).alias("tries"))
            out = rows if out is None else out.union(rows)
        taken = won.select("family", "made")
        settled = taken if settled is None else settled.union(taken)
        pending = materialize(pending.join(won, ["kind", "value"], "left_anti").select("kind", "value"), entities_written)
        if pending.isEmpty():
            return out
    raise RuntimeError(f"no free surrogates after {MAX_TRIES} tries")


def _replaced(batches: Iterator[pa.RecordBatch], key: bytes, text_col: str, tries_col: str, count: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        names = batch.schema.names
        again = batch.column(names.index(tries_col)).to_pylist() if tries_col in names else [None] * batch.num_rows
        made, counts = [], []
        for cell, tries in zip(batch.column(names.index(text_col)), again, strict=True):
            text = cell.as_py()
            spans = find(text)
            counts.append(len(spans))
            if spans:
                extra = {(t["kind"], t["value"]): t["tries"] for t in tries or ()}
                parts, at = [], 0
                for a, b, kind, value in spans:
                    parts += [text[at:a], _fit(kind, text[a:b], surrogate(key, kind, value, extra.get((kind, value), 0)))]
                    at = b
                text = "".join([*parts, text[at:]])
            made.append(text)
        columns = {n: batch.column(k) for k, n in enumerate(names) if n != tries_col}
        columns[text_col] = pa.array(made, pa.string())
        columns[count] = pa.array(counts, pa.int64())
        yield pa.record_batch(list(columns.values()), list(columns))


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = sorted({(h, kind, value) for h, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for _, _, kind, value in find(cell.as_py())})
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["hash", "kind", "value"])


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with each entity in the text replaced by its surrogate, and n_entities (long).

    Emails, IPv4 and IPv6 addresses, phone, card, social security and bank account numbers, dates of birth, street
    addresses, access keys and passwords, and names (see :func:`_persons`). Equal entities get equal surrogates in all
    documents, distinct ones of a type distinct surrogates, none equal to a real one of that type in the table; given
    names too. (Dates and addresses of private networks have too few forms for the last: they are permuted.) Without the key, a secret of 16 bytes or more, surrogates can't be derived. Check digits that were right
    are right again; country codes and the kind of network stay.

    Null and empty texts stay as they are; rows are never dropped; ids aren't looked at, so null and repeated ones don't
    matter. Distinct entities are aggregated on the map side, so that one that stands in a third of all documents costs
    a row per task. Documents are shuffled only if some first surrogate collided: by a hash of the text, to meet the
    tries that its entities need (a try belongs to the entity, so texts whose hashes collide do no harm). An existing
    n_entities column is replaced.
    """
    if len(key) < 16:
        raise ValueError("the key is a secret of 16 bytes or more")
    bound_batches(docs)
    docs = docs.select(*[c for c in docs.columns if c != "n_entities"])
    tries, retry = fresh("_tries", docs.columns), fresh("_retry_hash", docs.columns)
    texts = docs.select(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    entities = materialize(texts.select("text").mapInArrow(_entities, "kind string, value string").distinct())
    again = retries(entities, key)
    release(entities)
    schema = with_fields(docs.schema, ("n_entities", "long"))
    if again is not None:
        hits = texts.mapInArrow(_mentions, "hash long, kind string, value string").join(again, ["kind", "value"])
        hits = hits.groupBy(F.col("hash").alias(retry)).agg(F.collect_set(F.struct("kind", "value", "tries")).alias(tries))
        docs = docs.join(hits, F.xxhash64(text_col) == F.col(retry), "left").drop(retry)
    return docs.mapInArrow(lambda it: _replaced(it, key, text_col, tries, "n_entities"), schema)
