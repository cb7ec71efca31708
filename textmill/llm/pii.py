"""Surrogates for personal data: keyed, of the same type, gender, script and format.

A surrogate depends on the key and on the entity alone, not on the document, its order or the way
the entity is written: digits and letters are permuted by a keyed Feistel cipher within the
alphabet they are from, a bijection of the texts of one format; a word of a name is permuted as a
number among all words and spelled in syllables, or exchanged for another given name of its list.
So different originals have different surrogates by construction, and equal ones equal surrogates.
The entities of the whole input are checked for that all the same, and those that collide or
stand for themselves are drawn again, by rank, until none does. However many these are, they stay
a table: each text gets the draws of its own entities by a join. An entity of any length takes
linear time.

A person is told by a title, by a given name of the lists with a family name, or by one alone behind
a greeting; each word of the name is then replaced wherever the same text has it. Gender goes by the
name, so that a title doesn't change the surrogate. Not told: a person whom a text never names so
(a given name alone may be any word), and inflected forms (Webers).
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import discard, few, held, map_arrow, materialize, steps

#: Runs of more characters are enciphered as arrays, in linear time, and their surrogates aren't remembered.
LONG = 256
#: Letters of a long name that are spelled in syllables together.
SPELLED = 48
OUTPUT = ("text", "n_entities", "types")

# Given names by gender and script; a known name is replaced by another of its list.
GIVEN = {
    ("f", "latin"): "Anna Maria Sophie Emma Laura Julia Clara Elena Camille Alice Louise Carmen Lucia Ines Sarah Emily Olivia Hannah Charlotte Marta Paula Irene Mary Susan Karen Linda".split(),
    ("m", "latin"): "Paul Peter Thomas Martin Lukas Felix Jonas Hugo Louis Pierre Antoine Carlos Diego Javier Miguel James John Robert William David Henry Oliver Jack Mark Michael Richard".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Άννα Σοφία Ειρήνη".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος".split(),
}
# Titles that announce a person, and the person's gender where they tell it.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Dr": "", "Prof": "", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f", "κύριος": "m", "κυρία": "f", "Κύριος": "m", "Κυρία": "f"}
# Alphabets that letters are permuted in, syllables that unknown names are made of.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
SYLLABLES = {
    "latin": "ba be bi bo bu da de di do du fa fe fi fo ga ge gi go la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo wa we wi za".split(),
    "cyrillic": "ба бе би бо бу ва ве ви во га го да де ди до ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то за зи".split(),
    "greek": "βα βε βι γα γε δα δε δι ζα θα θε κα κε κι λα λε λι μα με μι να νε νι πα πε πι ρα ρε ρι σα σε σι τα τε τι φα φε χα χε".split(),
}
ALPHABET_OF = {c: k for k, alphabet in enumerate(ALPHABETS) for c in alphabet}
#: The letters of a name by script, and the endings of made names by what the name's own ending tells.
LETTERS = {"latin": ALPHABETS[1] + ALPHABETS[3] + "œšžčćěřňťďľőűąęłńśźżğışā", "cyrillic": ALPHABETS[5], "greek": ALPHABETS[7]}
#: The syllables that any block of SPELLED letters has room in, by script.
SYLLABLES_OF_BLOCK = {own: next(m for m in range(1, 999) if len(syllables) ** m >= (len(LETTERS[own]) + 1) ** SPELLED) for own, syllables in SYLLABLES.items()}
FEMALE, ENDINGS = {"latin": "aáà", "cyrillic": "ая", "greek": "αάηή"}, {"latin": ("nn", "nna"), "cyrillic": ("нн", "нна"), "greek": ("ννος", "ννα")}
#: Country calling codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]"
_LOWER = r"[a-zß-öø-ÿа-яёα-ωάέήίόύώς]"
_NAME = rf"{_UPPER}{_LOWER}+(?:-{_UPPER}{_LOWER}+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Gender of each given name of the lists.
GENDER = {name: sex for (sex, _), names in GIVEN.items() for name in names}
#: What a given name alone stands behind: words that are spelled like one are no person.
GREETING = re.compile(r"(?<!\w)(?:[Dd]ear|Hi|Hello|Hey|Liebe|Lieber|Hallo|Chère|Cher|Bonjour|Querida|Querido|Estimada|Estimado|Hola|Дорогая|Дорогой|Уважаемая|Уважаемый|Привет|Αγαπητή|Αγαπητέ),? $")
# Capitalised words that aren't a family name.
COMMON = frozenset("The A An And But Or If In On At To Of For From With By As He She It We They You I This That These Those Then There When Where Who What Why How Not No Yes So Is Was Are Were Has Had Have Will Would Can Could May Must Do Did Der Die Das Den Dem Des Ein Eine Und Oder Aber Wenn Als In Im Am Zu Mit Von Für Auf Aus Bei Nach Er Sie Es Wir Ihr Ich Nicht Ist War Hat Le La Les Un Une Des Et Ou Mais Dans De Du Il Elle Nous Vous Ils El Los Las Y O Pero En Con Por Para Que Se No Su И В На С По Но А Он Она Они Мы Вы Я Это Не Ο Η Το Οι Τα Και Στο Στη Με Για Από Δεν".split())
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_LISTED = "|".join(sorted(GENDER, key=len, reverse=True))
_FAMILY = rf"(?!(?:{'|'.join(sorted(COMMON, key=len, reverse=True))})(?!\w)){_NAME}(?!\w)"
#: A given name of the lists, and what goes with it; not in Santa Maria or St. Paul.
_UNTITLED = rf"(?<!\w)(?={_UPPER})(?<!San )(?<!Santa )(?<!Saint )(?<!St )(?<!St\. )(?:{_LISTED})(?!\w)(?:-{_UPPER}{_LOWER}+(?!\w))?(?: {_FAMILY}){{0,2}}"
#: A word that may be a person's who was named elsewhere in the text.
MENTION = re.compile(rf"(?<!\w){_UPPER}{_LOWER}+(?!\w)")
#: In order: of two that begin at one place the earlier wins.
ENTITY = re.compile(
    "|".join(
        [
            r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})",
            r"(?P<key>(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{30,})(?!\w))",
            r"(?P<hex>(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))",
            r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?!\w))",
            r"(?P<birth>(?:(?<!\w)(?=[BbDdGgNnFf])(?i:born(?: on)?|date of birth|d\.?o\.?b\.?|geboren(?: am)?|geb\.|née?(?: le)?|nacid[oa](?: el)?|fecha de nacimiento|date de naissance)[:,]? )(?:\d{4}-\d\d?-\d\d?|\d\d?[./-]\d\d?[./-]\d{4})(?!\w))",
            r"(?P<passport>(?<!\w)(?=[PpRr])(?i:passport|reisepass|passeport|pasaporte)(?: (?i:no\.?|number|nr\.?|nummer|n°|nº|núm\.?))?:? [A-Z0-9]{1,3}\d{5,8}(?!\w))",
            r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){1,6}[0-9A-Fa-f]{1,4})(?![\w:]|\.\d))",
            rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))",
            r"(?P<phone>(?=[+(\d])(?:(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?\(0\)[ .-]?\d{2,5}(?:[ .-]?\d{2,8}){1,3}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|(?<![\w.-])\d{3}-\d{4}(?![\w-])|(?<![\w.+-])00[1-9]\d{0,2}(?:[ -]\d{2,8}){2,5}(?!\w)|(?<![\w.+-])\(?0[1-9]\d{1,4}\)?[ /-]\d{4,8}(?:[ -]\d{2,4})?(?![\w-])))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))",
            rf"(?P<name>(?<!\w)(?P<title>{_TITLE})\b\.? (?P<person>{_NAME}(?: {_NAME}){{0,2}}))",
            rf"(?P<untitled>{_UNTITLED})",
        ]
    )
)
#: Whatever ENTITY finds holds one of these.
HINT = re.compile(rf"[@\d]|(?<!\w)(?:(?={_UPPER}|гос|κύρ)(?:(?:{_TITLE})\b|(?:{_LISTED})(?!\w)|AKIA|AIza|[A-F]{{32}})|gh[pousr]_|sk-|xox[abprs]-|[a-f]{{32}})")


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def script(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "greek" if re.search("[Α-ώ]", word) else "latin"


class Keyed:
    """The replacement functions under one key. drawn: of the text at hand, the draws of entities whose first one collides."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(b"textmill", key=key[:64], digest_size=32).digest()
        self.drawn: dict[tuple[str, str], int] = {}
        self.known: dict[tuple[str, str, int], str] = {}

    def number(self, *of: object) -> int:
        return int.from_bytes(hashlib.blake2b(repr(of).encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, values: list[int], radix: int, tweak: object) -> list[int]:
        """A bijection of the sequences of a length over range(radix), other than the identity."""
        n = len(values)
        if n < 2:  # a rotation by one at least
            return [(v + 1 + self.number(tweak, radix) % (radix - 1)) % radix for v in values]
        if n > LONG:
            return self.permute_long(np.array(values, np.int16), radix, tweak)
        read = lambda x: functools.reduce(lambda a, v: a * radix + v, x, 0)
        u = n // 2
        a, b = read(values[:u]), read(values[u:])
        for i in range(10):
            m = radix ** (u if i % 2 == 0 else n - u)
            a, b = b, (a + self.number(tweak, radix, n, i, b)) % m
        out = []
        for x, k in ((b, n - u), (a, u)):
            for _ in range(k):
                x, v = divmod(x, radix)
                out.append(v)
        return out[::-1]

    def permute_long(self, values: np.ndarray, radix: int, tweak: object) -> list[int]:
        """The same with each character moved by itself, by a keystream of the other half."""
        u = len(values) // 2
        a, b = values[:u], values[u:]
        head = self.key + hashlib.blake2b(repr((tweak, radix)).encode(), key=self.key, digest_size=32).digest()
        for i in range(10):
            stream = hashlib.shake_256(head + bytes([i]) + b.astype(np.uint8).tobytes()).digest(len(a))
            a, b = b, (a + np.frombuffer(stream, np.uint8)) % radix
        return np.concatenate((a, b)).tolist()

    def formatted(self, text: str, tweak: object) -> str:
        """Each alphabet's characters permuted among themselves, all else in its place."""
        chars, places = list(text), {}
        for i, c in enumerate(text):
            if c in ALPHABET_OF:
                places.setdefault(ALPHABET_OF[c], []).append(i)
        shape = "".join(chr(97 + ALPHABET_OF[c]) if c in ALPHABET_OF else c for c in text)
        for k, own in places.items():
            alphabet = ALPHABETS[k]
            rest = "".join(c for c in text if ALPHABET_OF.get(c) != k)
            # Letters are moved under the digits' influence and digits alone, which can be undone in that order.
            for i, v in zip(own, self.permute([alphabet.index(text[i]) for i in own], len(alphabet), (tweak, shape, rest if k and 0 in places and k == max(places) else "")), strict=True):
                chars[i] = alphabet[v]
        return "".join(chars)

    def digits(self, text: str, first: int, last: int, tweak: object) -> str:
        """The digits of text from number first to before number last permuted, all else in its place."""
        at = [i for i, c in enumerate(text) if c in ALPHABETS[0]][first:last]
        out = list(text)
        for i, v in zip(at, self.permute([int(text[i]) for i in at], 10, (tweak, "".join(c for c in text if c.isdigit())[:first])), strict=True):
            out[i] = str(v)
        return "".join(out)

    def word(self, word: str, epoch: int = 0) -> str:
        """A name for a word of a name, whatever the case it is written in: of its list if it is one, else made of syllables."""
        own, folded = script(word), word.lower()
        listed = GENDER.get(folded.capitalize())
        if listed and not epoch:
            names = GIVEN[listed, own]
            order = sorted(names, key=lambda x: self.number("given", own, x))
            return order[(order.index(folded.capitalize()) + 1) % len(names)]
        letters, syllables = LETTERS[own], SYLLABLES[own]
        known = [letters.index(c) for c in folded if c in letters]
        moved = self.permute(known, len(letters), ("name", own, epoch)) if known else []
        made = []
        blocks = [moved[i : i + SPELLED] for i in range(0, len(moved), SPELLED)]
        for block in blocks[:-1]:  # blocks of one number of syllables; as the last one has no more, no two words are spelled alike
            n = functools.reduce(lambda x, v: x * len(letters) + v, block, 0)
            for _ in range(SYLLABLES_OF_BLOCK[own]):
                n, i = divmod(n, len(syllables))
                made.append(syllables[i])
        # The last block, or all, as a number among all words: those of fewer letters come first.
        n, last = functools.reduce(lambda x, v: x * len(letters) + v + 1, blocks[-1] if blocks else [], 0), []
        while n:
            n, i = divmod(n - 1, len(syllables))
            last.append(syllables[i])
        made += last[::-1]
        rest = "".join(c for c in folded if c not in letters)  # letters of no alphabet here stay
        return ("".join(made) + rest + ENDINGS[own][folded[-1] in FEMALE[own]]).capitalize()

    def person(self, text: str) -> str:
        return "".join(w if w in " -" else self.surrogate("name", w.lower()) for w in re.split(r"([ -])", text))

    def surrogate(self, kind: str, text: str, epoch: int | None = None) -> str:
        """Of a canonical original; the first draw unless the entity was to be drawn again."""
        epoch = self.drawn.get((kind, text), 0) if epoch is None else epoch
        found = self.known.get((kind, text, epoch))
        if found is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self._surrogate(kind, text, epoch)
            if len(text) <= LONG:
                self.known[kind, text, epoch] = found
        return found

    def _surrogate(self, kind: str, text: str, epoch: int) -> str:
        if kind == "name":
            return self.word(text, epoch)
        if kind == "email":
            local, _, domain = text.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.formatted(local, ('local', epoch))}@{self.formatted(host, 'host')}.{top}"
        if kind == "ip":
            return ".".join(map(str, self.permute([int(x) for x in text.split(".")], 256, ("ip", epoch))))
        if kind == "ip6":  # the first group stays: it tells what kind of address it is
            return text[:4] + "".join("0123456789abcdef"[v] for v in self.permute([int(c, 16) for c in text[4:]], 16, ("ip6", epoch)))
        if kind == "hex":
            alphabet = "0123456789ABCDEF" if text.upper() == text else "0123456789abcdef"
            return "".join(alphabet[v] for v in self.permute([int(c, 16) for c in text], 16, ("hex", epoch)))
        if kind == "card":
            own = text
            off = (int(own[-1]) - luhn(own[:-1])) % 10
            out = self.digits(text, 1, len(own) - 1, ("card", epoch))
            return out[:-1] + str((luhn(out[:-1]) + off) % 10)
        if kind == "phone":  # the area's first two digits stay
            return self.digits(text, 2, len(text), ("phone", epoch)) if len(text) > 5 else self.digits(text, 0, len(text), ("phone", epoch))
        if kind == "birth":  # another day of the same ten years
            day = date.fromisoformat(text).toordinal()
            first, x = day // 3652 * 3652, day % 3652
            while True:  # walks the cycle of a permutation of 4096 until it is back among the days, of the calendar too
                a, b = self.permute([x // 64, x % 64], 64, ("birth", first, epoch))
                x = 64 * a + b
                if x < 3652 and 1 <= first + x <= date.max.toordinal():
                    return date.fromordinal(first + x).isoformat()
        if kind == "key":
            prefix = re.match(r"AKIA|gh\w_|sk-|xox\w-|AIza", text)[0]
            return prefix + self.formatted(text[len(prefix) :], ("key", epoch))
        if kind == "iban":
            return text[:2] + self.formatted(text[2:], ("iban", epoch))
        return self.formatted(text, (kind, epoch))

    def written(self, kind: str, text: str) -> tuple[str, str, str] | None:
        """(the mention with its surrogate, canonical original, canonical surrogate) of a mention other than a name."""
        if kind in ("birth", "passport"):
            at = re.search(r"\S+$", text).start()
            head, own = text[:at], text[at:]
            if kind == "passport":
                new = self.surrogate(kind, own)
                return head + new, own, new
            parts = [int(x) for x in re.split(r"\D", own)]
            year_first = own[:4].isdigit()
            month_first = not year_first and "/" in own and parts[1] > 12  # else the day comes first, as most write it
            y, m, d = parts if year_first else (parts[2], parts[0], parts[1]) if month_first else (parts[2], parts[1], parts[0])
            try:
                plain = date(y, m, d).isoformat()
            except ValueError:
                return None
            new = self.surrogate(kind, plain)
            ny, nm, nd = new.split("-")
            order = [ny, nm, nd] if year_first else [nm, nd, ny] if month_first else [nd, nm, ny]
            for a, b in zip(re.findall(r"\d+", own), order, strict=True):
                head += str(int(b)) if len(a) < 2 else b
                head += re.search(r"\D", own)[0]
            return head[:-1], plain, new
        if kind == "ip6":
            try:
                plain = ipaddress.IPv6Address(text).exploded.replace(":", "")
            except ValueError:
                return None
            new = self.surrogate(kind, plain)
            shown = str(ipaddress.IPv6Address(int(new, 16)))
            return shown.upper() if text.upper() == text != text.lower() else shown, plain, new
        if kind == "phone":
            digits = [i for i, c in enumerate(text) if c.isdigit()]
            plain, keep = "".join(text[i] for i in digits), 0
            if text.startswith("+") or plain.startswith("00"):
                keep = 2 * (not text.startswith("+"))
                spelled = re.match(r"(?:\+|00)(\d{1,3})(?=[ .(-])", text)
                keep += len(spelled[1]) if spelled else next((n for n in (1, 2) if plain[keep : keep + n] in SHORT_CODES), 3)
            if plain[keep : keep + 1] == "0":
                keep += 1  # the trunk prefix of national numbers
            # The national number alone decides, so that it is replaced alike with and without the country's.
            own = plain[keep:]
            if not own:
                return None
            new, out = self.surrogate(kind, own), list(text)
            for i, c in zip(digits[keep:], new, strict=True):
                out[i] = c
            return "".join(out), own, new
        if kind in ("card", "iban", "ssn"):
            marks = r"[ -]"
            plain = re.sub(marks, "", text)
            new = self.surrogate(kind, plain)
            chars = iter(new)
            return "".join(c if re.match(marks, c) else next(chars) for c in text), plain, new
        own = text.lower() if kind == "email" else text  # case doesn't tell addresses apart
        new = self.surrogate(kind, own)
        return new, own, new

    def replace(self, text: str, drawn: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (type, canonical original, canonical surrogate) of each mention. drawn: as in the class."""
        self.drawn = drawn or {}
        if not HINT.search(text):
            return text, []
        matches = list(ENTITY.finditer(text))
        found: list[tuple[str, str, str]] = []
        named: dict[str, str] = {}  # the surrogate of each word of a person named in the text
        made: dict[int, str] = {}

        def person(m: re.Match, own: str) -> None:
            # Each word is an entity of its own: Mr Paul Weber and Herr Weber share a surname.
            new = self.person(own)
            for a, b in zip(re.split(r"[ -]", own), re.split(r"[ -]", new), strict=True):
                found.append(("name", a.lower(), b))
                if a not in COMMON:
                    named.setdefault(a, b)
            made[m.start()] = m[0][: len(m[0]) - len(own)] + new

        for m in matches:
            kind = m.lastgroup if m.lastgroup not in ("title", "person") else "name"
            if kind == "name":
                person(m, m["person"])
            elif kind != "untitled" and (own := self.written(kind, m[0])):
                made[m.start()] = own[0]
                found.append((kind, *own[1:]))
        for m in matches:  # with a family name first, as a given name alone is taken as there
            if m.lastgroup == "untitled" and " " in m[0]:
                person(m, m[0])
        for m in matches:
            if m.lastgroup == "untitled" and " " not in m[0] and (GREETING.search(text[max(0, m.start() - 14) : m.start()]) or named.keys() & set(m[0].split("-"))):
                person(m, m[0])

        def mention(m: re.Match) -> str:
            if m[0] not in named:
                return m[0]
            found.append(("name", m[0].lower(), named[m[0]]))
            return named[m[0]]

        out, at = [], 0
        for m in matches:
            if m.start() in made:
                gap = text[at : m.start()]
                out += [MENTION.sub(mention, gap) if named else gap, made[m.start()]]
                at = m.end()
        gap = text[at:]
        out.append(MENTION.sub(mention, gap) if named else gap)
        return "".join(out), found


def entities(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(type, original, surrogate) by the first draw, each once in each step of an Arrow batch.

    Null and empty texts have none, nor has an empty table; repeated rows have the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = held(("surrogates", key), lambda: Keyed(key)).replace
        for batch in steps(batches, "text"):
            own = sorted({e for text in batch.column("text").to_pylist() if text for e in replace(text)[1]})
            yield pa.record_batch([pa.array([e[i] for e in own], pa.string()) for i in range(3)], names=["type", "original", "surrogate"])

    return map_arrow(df.select(F.col(text_col).cast("string").alias("text")), run, "type string, original string, surrogate string")


def mentions(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(digest, type, original) of each entity of each text, named by the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = held(("surrogates", key), lambda: Keyed(key)).replace
        for batch in steps(batches, "text"):
            own = [(d, *e) for d, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for e in sorted({x[:2] for x in replace(text)[1]})]
            yield pa.record_batch([pa.array([e[i] for e in own], pa.string()) for i in range(3)], names=["digest", "type", "original"])

    return map_arrow(df.select(F.sha2(F.col(text_col).cast("string"), 256).alias("digest"), F.col(text_col).cast("string").alias("text")), run, "digest string, type string, original string")


def collisions(found: DataFrame) -> DataFrame:
    """(type, surrogate) that stand for two originals or more, or for themselves."""
    return found.groupBy("type", "surrogate").agg(F.min("original").alias("a"), F.max("original").alias("b")).where("a <> b or lower(a) = lower(surrogate)").select("type", "surrogate")


def redrawn(rows: DataFrame, key: bytes) -> DataFrame:
    """rows (type, original, epoch) with their surrogates by that draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogate = held(("surrogates", key), lambda: Keyed(key)).surrogate
        for batch in batches:
            made = [surrogate(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.record_batch([*batch.columns[:2], pa.array(made, pa.string()), batch.columns[2]], names=["type", "original", "surrogate", "epoch"])

    return map_arrow(rows.select("type", "original", "epoch"), run, "type string, original string, surrogate string, epoch int")


def repairs(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame | None:
    """(type, original, epoch): the draw under which every entity of the whole input has a surrogate of its own, where it isn't the first; None if all first ones are.

    Of those that share one, the first by order keeps it and the others are drawn again, by their
    rank; one that stands for itself is drawn again too. All is checked again until it holds.
    Entities are written, compared and drawn as tables, only if any collide.
    """
    found = entities(df, key, text_col)
    if not collisions(found).take(1):
        return None
    known = materialize(found.distinct().withColumn("epoch", F.lit(0)), "entities")
    while True:
        shared = materialize(collisions(known), "collisions")
        if not shared.take(1):
            break
        rank = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("original")) - 1
        ranked = known.join(few(shared), ["type", "surrogate"]).withColumn("rank", rank).where("rank > 0 or lower(original) = lower(surrogate)")
        again = materialize(redrawn(ranked.withColumn("epoch", F.col("epoch") + F.greatest(F.lit(1), "rank")), key), "redrawn")
        after = materialize(known.join(few(again.select("type", "original")), ["type", "original"], "left_anti").select(*again.columns).unionByName(again), "entities")
        discard(known, shared, again)
        known = after
    discard(shared)
    drawn = materialize(known.where("epoch > 0").select("type", "original", "epoch"), "drawn")
    discard(known)
    return drawn


def pseudonymize(df: DataFrame, key: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of each row, its text with surrogates, n_entities and their types.

    One row out for each row in, in whatever order. A null text stays null, an empty one empty;
    texts without personal data are unchanged. Repeated rows are replaced alike. Only the named
    columns are read, and one that is named as an output gives way to it, so none can clash. An
    empty table gives an empty result. The input is read a first time to check that surrogates are
    distinct; that check groups distinct entities, with partial sums. If any are to be drawn again, each
    text with one of them gets its draws by a join on the text's digest, whatever their number.
    Batches are bounded, a longer text is held whole; entities of any length take linear time.
    """
    keep = tuple(c for c in keep if c not in OUTPUT)
    source = df.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    drawn = repairs(df, key, text_col)
    if drawn is None:
        rows = source.withColumn("_drawn", F.lit(None).cast("array<struct<type:string,original:string,epoch:int>>"))
    else:
        own = mentions(df, key, text_col).distinct().join(few(drawn), ["type", "original"])
        # A text's own entities, so no longer than the text is.
        of_text = materialize(own.groupBy("digest").agg(F.collect_list(F.struct("type", "original", "epoch")).alias("_drawn")), "drawn-by-text")
        size = of_text.select("digest", F.to_json("_drawn").alias("_json"))  # texts, so that few() measures them
        rows = source.withColumn("_digest", F.sha2("text", 256)).join(few(size).withColumnRenamed("digest", "_digest"), "_digest", "left")
        rows = rows.select(*source.columns, F.from_json("_json", "array<struct<type:string,original:string,epoch:int>>").alias("_drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = held(("surrogates", key), lambda: Keyed(key)).replace
        for batch in steps(batches, "text"):
            draws = [x and {(e["type"], e["original"]): e["epoch"] for e in x} for x in batch.column("_drawn").to_pylist()]
            made = [(None, []) if text is None else replace(text, d) for text, d in zip(batch.column("text").to_pylist(), draws, strict=True)]
            own = [batch.column(i) for i in range(len(keep))]
            types = [",".join(sorted({e[0] for e in x[1]})) for x in made]
            yield pa.record_batch([*own, pa.array([x[0] for x in made], pa.string()), pa.array([len(x[1]) for x in made], pa.int64()), pa.array(types, pa.string())], names=[*keep, *OUTPUT])

    kept = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, source.schema.fields, strict=False))
    return map_arrow(rows, run, f"{kept}{', ' if kept else ''}text string, n_entities long, types string")
