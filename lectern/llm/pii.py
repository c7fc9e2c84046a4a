"""Surrogates for personal data: the same entity gets the same replacement of the same kind and format everywhere.

Replacements come from keyed permutations, so different entities of one kind and format never get the same one:
* characters are permuted within their class (digits, lower and upper case letters of a script, vowels and consonants
  in surnames) by a Feistel network over the positions of the string, whose separators stay in place;
* given names are permuted within a pool of one gender and script;
* where a property has to be kept (a valid card number, a public address), the permutation is repeated until it
  holds again, which is a permutation of the strings that have it.
No state is shared between tasks; `collisions` checks distinctness over a whole corpus with one aggregation.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8

# Alphabets of the scripts, given names by gender and script, titles by gender.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "áéíóúàèùâêîôûäëïöü", "ñçß")
HEX = ("0123456789", "abcdef")
GIVEN = {
    "f": ["Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Alice", "Charlotte", "Margaret", "Emma",
          "Olivia", "Sophia", "Julia", "Claudia", "Ursula", "Brigitte", "Gisela", "Monika", "Petra", "Sabine", "Camille", "Chloé", "Élodie", "Juliette",
          "Margaux", "Nathalie", "Sylvie", "Véronique", "Carmen", "Dolores", "Guadalupe", "Isabel", "Lucía", "María", "Pilar", "Rosario"],
    "m": ["James", "Robert", "John", "Michael", "David", "William", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel", "Matthew", "George",
          "Edward", "Peter", "Paul", "Jürgen", "Günther", "Klaus", "Wolfgang", "Heinrich", "Stefan", "Uwe", "Jacques", "Olivier", "Philippe", "François",
          "Gérard", "Guillaume", "Thierry", "Alejandro", "Carlos", "Diego", "Fernando", "Francisco", "Javier", "José", "Miguel", "Pablo"],
    "f-cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана", "Екатерина", "Юлия"],
    "m-cyrillic": ["Александр", "Сергей", "Дмитрий", "Алексей", "Андрей", "Иван", "Михаил", "Николай", "Владимир", "Павел"],
    "f-greek": ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία"],
    "m-greek": ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"],
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Господин", "Госпожа"]

POOL_OF = {name: pool for pool, names in GIVEN.items() for name in names}
SHOUTED_NAMES = {name.upper(): name for name in POOL_OF}
WORD = r"[^\W\d_]"
NUMERIC = re.compile(
    r"""(?P<email>(?u:(?<![\w.%+-])\w[\w.%+-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})
    |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d))
    |(?P<ipv6>(?<![\w:.])(?=[0-9a-fA-F:]{0,32}\d)(?:[0-9a-fA-F]{1,4}:|:(?=:)){1,7}(?::[0-9a-fA-F]{1,4}|:|[0-9a-fA-F]{1,4})(?::?[0-9a-fA-F]{1,4}){0,6}(?![\w:]))
    |(?P<key>(?<![\w])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![\w]))
    |(?P<secret>(?<![\w])(?=[0-9a-fA-F]{0,63}[a-fA-F])(?=[0-9a-fA-F]{0,63}\d)(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![\w]))
    |(?P<iban>(?<![\w])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w]))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w])(?:\d{4}[ -]){3}\d{4}(?![\w])|(?<![\w+])\d{13,19}(?![\w]))
    |(?P<phone>(?<![\w])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?![\w])
       |(?<![\w+.-])0\d{1,4}(?P<gap>[ .-])\d{2,4}(?:(?P=gap)\d{2,4}){1,4}(?![\w]|[.-]\d)
       |(?<![\w])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?![\w])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))""",
    re.VERBOSE | re.ASCII,
)
# What ends an international phone number: other entities, and, if what comes before is a whole number, dates, times and national numbers.
KIND = {m[1]: m[0] for m in re.finditer(r"\(\?P<(\w+)>.*(?:\n {7}.*)*", NUMERIC.pattern)}
ENTITY = re.compile("|".join(KIND[k] for k in ("email", "ip", "ssn", "card")), re.VERBOSE | re.ASCII)
OTHER = re.compile(
    r"""\d{4}([-.])\d{1,2}\1\d{1,2}(?![\w-])|\d{1,2}([-.])\d{1,2}\2\d{4}(?![\w-])|\d{1,2}:\d{2}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])""", re.ASCII
)
NANP = re.compile(r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w|[.-]\d)", re.ASCII)
LEAST_DIGITS, MOST_DIGITS = 7, 15
#: Digits of a national number with its leading 0; fewer are dates.
NATIONAL = range(9, 12)
# What is assigned to a name that says it is secret, if it has letters and digits.
ASSIGNED = re.compile(
    r"""(?i:(?<![a-z])(?:token|password|passwd|secret|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)((?=[^\s"']{0,255}\d)(?=[^\s"']{0,255}[a-zA-Z])[\w+/=.~-]{8,256})(?![\w+/=~-])""", re.ASCII
)
UPPER = "[" + "".join(c for c in map(chr, range(0x10000)) if c.isupper() and c.isalpha()) + "]"
# What is no part of a name although it is capitalised: titles, suffixes and the labels of other entities.
NO_NAME = rf"(?!(?:{'|'.join(TITLES)}|Jr|Sr|II|III|IV|IBAN|SSN|IP|ID|PIN|TOKEN|E-?[Mm]ail|Mail|Tel|Phone)(?!\w))"
PART = rf"{NO_NAME}{UPPER}(?:{WORD}+|(?=['’]{UPPER}))(?:['’-]{UPPER}{WORD}*)*(?!\w)"
INITIAL = rf"{UPPER}\."
PARTICLE = r"(?:(?:van|von|de|del|di|da|du|dos)[ ](?:(?:der|den|dem|la|las|los)[ ])?|d['’])"
# A given name in capitals, which is one only if a single capitalised surname follows: in a text in capitals it tells nothing.
SHOUTED = re.compile(rf"(?<!\w)(?<![^\W\d_a-z][^\w\n])(?:{'|'.join(n.upper() for n in POOL_OF)})[ ]{UPPER}{{2,}}(?:[-'’]{UPPER}{{2,}})?(?!\w)(?![ ]{UPPER}+(?!{WORD}))")
PERSON = re.compile(
    rf"\b(?:(?:{'|'.join(TITLES)})\.?|(?:{'|'.join(POOL_OF)})(?:-{UPPER}{WORD}*)*(?!\w))[ ]"
    rf"(?:{INITIAL}[ -]?|{UPPER}[ ]|{PARTICLE}|{PART}[ ])*(?:{PART}|{INITIAL})"
)
TITLE = re.compile(rf"(?:{'|'.join(TITLES)})\.?[ ]")
NAME_WORD = re.compile(rf"(?<!\w){UPPER}{WORD}*")


@lru_cache(maxsize=200_000)
def _permuted(key: bytes, kind: str, text: str, alphabets: tuple[str, ...]) -> str:
    """One pass of the keyed permutation over the characters that are in an alphabet; case and other characters stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    place = {c: (a, i) for a in alphabets for i, c in enumerate(a)}
    at = [i for i, c in enumerate(low) if c in place]
    form = kind + "\0" + "".join("\1" if c in place else c for c in low) + "\0" + "".join(str(alphabets.index(place[low[i]][0])) for i in at)
    half = len(at) // 2
    for r in range(ROUNDS):
        turn, other = (at[:half], at[half:]) if r % 2 else (at[half:], at[:half])
        seed = f"{r}\0{form}\0{''.join(low[i] for i in other)}".encode()
        noise = b""
        while len(noise) < 4 * len(turn):
            noise += hmac.new(key, seed + len(noise).to_bytes(4, "little"), hashlib.sha256).digest()
        for n, i in enumerate(turn):
            a, x = place[low[i]]
            low[i] = a[(x + int.from_bytes(noise[4 * n : 4 * n + 4], "little")) % len(a)]
    return "".join(c.upper() if old != old.lower() and len(c.upper()) == 1 else c for c, old in zip(low, text, strict=True))


def permuted(key: bytes, kind: str, text: str, alphabets: tuple[str, ...] = ALPHABETS, keep: Callable[[str], bool] = lambda s: True) -> str:
    """The permutation of the strings for which `keep` holds; `text` must be one of them."""
    out = _permuted(key, kind, text, alphabets)
    while not keep(out):
        out = _permuted(key, kind, out, alphabets)
    return out


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _only(text: str) -> str:
    return re.sub(r"\D", "", text)


def _card(key: bytes, text: str) -> str:
    if not luhn(_only(text)):
        return permuted(key, "card", text, ("0123456789",), lambda s: not luhn(_only(s)))
    body = permuted(key, "valid card", text[:-1], ("0123456789",))
    return next(body + d for d in "0123456789" if luhn(_only(body + d)))


def _iban_check(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    if _iban_check(text.replace(" ", "")) != 1:
        return text[:2] + permuted(key, "other iban", text[2:], keep=lambda s: _iban_check((text[:2] + s).replace(" ", "")) != 1)
    body = permuted(key, "iban " + text[:2], text[4:])
    return f"{text[:2]}{98 - _iban_check(text[:2] + '00' + body.replace(' ', '')):02d}{body}"


def _address(key: bytes, text: str) -> str:
    """A 32 bit Feistel network; private, public and special addresses stay among themselves."""
    kind = lambda n: (ipaddress.IPv4Address(n).is_private, ipaddress.IPv4Address(n).is_global, ipaddress.IPv4Address(n).is_multicast)
    n = int(ipaddress.IPv4Address(text))
    same = kind(n)
    while True:
        left, right = n >> 16, n & 0xFFFF
        for r in range(ROUNDS):
            left, right = right, left ^ int.from_bytes(hmac.new(key, b"ip%d %d" % (r, right), hashlib.sha256).digest()[:2], "little")
        n = left << 16 | right
        if kind(n) == same:
            return str(ipaddress.IPv4Address(n))


def _ipv6_kind(text: str) -> tuple[bool, bool, bool] | None:
    try:
        n = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return n.is_private, n.is_global, n.is_multicast


def _ipv6(key: bytes, text: str) -> str:
    """The first group, which tells the kind of network, stays; hexadecimal digits are permuted in the groups after it."""
    first, colon, rest = text.partition(":")
    same = _ipv6_kind(text)
    return first + colon + permuted(key, f"ipv6 {first.lower()} {same}", rest, HEX, lambda s: _ipv6_kind(first + colon + s) == same)


def _key(key: bytes, text: str) -> str:
    known = re.match(r"AKIA|gh[pousr]_|", text)[0]
    return known + permuted(key, "key " + known, text[len(known) :])


def _email(key: bytes, text: str) -> str:
    """Local part and domain are permuted; the top-level domain and the reserved example domains stay."""
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    stay = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    host = ".".join(labels[:-stay])
    new = permuted(key, "local part", local) + "@"
    return new + (permuted(key, "host", host) + "." if host else "") + ".".join(labels[-stay:])


@lru_cache(maxsize=64)
def _pool(key: bytes, pool: str) -> dict[str, str]:
    """Each name of the pool to the next one in keyed order: a permutation without fixed points."""
    names = sorted(GIVEN[pool], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
    return dict(zip(names, names[1:] + names[:1], strict=True))


def given_name(key: bytes, name: str) -> str:
    if name not in POOL_OF and SHOUTED_NAMES.get(name):
        return given_name(key, SHOUTED_NAMES[name]).upper()
    if name in POOL_OF:
        return _pool(key, POOL_OF[name])[name]
    return permuted(key, "given", name, SOUNDS, lambda s: s not in POOL_OF)


def surname(key: bytes, name: str) -> str:
    return permuted(key, "surname", name, SOUNDS, lambda s: s not in POOL_OF)


REPLACE: dict[str, Callable[[bytes, str], str]] = {
    "email": _email,
    "ip": _address,
    "ipv6": _ipv6,
    "key": _key,
    "secret": lambda key, s: permuted(key, "secret", s, HEX),
    "iban": _iban,
    "ssn": lambda key, s: permuted(key, "ssn", s, ("0123456789",)),
    "card": _card,
    "phone": lambda key, s: (m := re.match(r"\+\d{1,3}(?=[ .(-])|0|", s)[0]) + permuted(key, "phone" + m, s[len(m) :], ("0123456789",)),
}


def _entity_at(text: str, at: int) -> bool:
    """Whether another entity begins at a group of digits. One of a card's form only is none if it hides a valid card that begins later."""
    m = None if text[at - 1] == "-" else ENTITY.match(text, at)
    if not m or m.lastgroup != "card" or luhn(_only(m[0])):
        return bool(m)
    return not any(c.lastgroup == "card" and luhn(_only(c[0])) for i in range(at + 1, m.end()) if (c := ENTITY.match(text, i)))


def _phone_end(text: str, start: int, end: int) -> int:
    """Where the international number that begins at `start` and may go on to `end` stops; `start` if another entity has its digits.

    Of the ends of its groups, the last within MOST_DIGITS is taken at which no number goes on after a dot or hyphen.
    """
    plan = NANP.match(text, start)
    if plan:
        return plan.end()
    ends, digits = [], 0
    for group in re.finditer(r"[0-9]+", text[start:end]):
        at = start + group.start()
        if _entity_at(text, at) or digits >= LEAST_DIGITS and OTHER.match(text, at):
            if digits < LEAST_DIGITS:
                return start
            return max((e for e, n, _ in ends if n <= MOST_DIGITS), default=ends[-1][0])
        digits += len(group[0])
        ends.append((start + group.end(), digits, re.match(r"[.-][0-9]", text[start + group.end() :][:2])))
    return max((e for e, n, more in ends if LEAST_DIGITS <= n <= MOST_DIGITS and not more), default=end)


def _numeric(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of all that NUMERIC finds, with phone numbers ended where they end."""
    at = 0
    while m := NUMERIC.search(text, at):
        kind, (start, at) = next(k for k in REPLACE if m[k]), m.span()
        if kind == "phone" and m[0][0] == "+":
            at = _phone_end(text, start, at)
        elif kind == "phone" and m[0][0] == "0" and len(_only(m[0])) not in NATIONAL or kind == "ipv6" and not _ipv6_kind(m[0]):
            at = start
        elif kind == "card" and m[0].isdigit() and not luhn(m[0]):
            continue  # a number of that length is a card only if its check digit says so
        if at > start:
            yield start, at, kind
        else:
            at = start + 1


def entities(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, surrogate) of every entity, in order and without overlaps."""
    found = []
    if re.search(r"[0-9@]", text):
        for start, end, kind in _numeric(text):
            found.append((start, end, kind, REPLACE[kind](key, text[start:end])))
        for m in ASSIGNED.finditer(text):
            found.append((*m.span(1), "secret", REPLACE["secret"](key, m[1]) if NUMERIC.fullmatch(m[1]) else _key(key, m[1])))
    names: set[str] = set()
    for m in [*PERSON.finditer(text), *SHOUTED.finditer(text)]:
        title = TITLE.match(m[0])
        for w in NAME_WORD.finditer(text, m.start() + (title.end() if title else 0), m.end()):
            given = w[0] in POOL_OF or w[0] in SHOUTED_NAMES and w.start() == m.start()
            found.append((*w.span(), "person", (given_name if given else surname)(key, w[0])))
            if not given and len(w[0]) > 1:
                names |= {w[0], w[0].upper(), w[0].capitalize()}
    # A surname that the text has told, wherever it stands alone; a given name alone tells nobody.
    again = "|".join(re.escape(n) for n in sorted(names))
    for m in re.finditer(rf"(?<!\w)(?:{again})(?!\w)", text) if again else ():
        found.append((*m.span(), "person", surname(key, m[0])))
    out: list[tuple[int, int, str, str]] = []
    for e in sorted(found):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


RESULT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("n_entities", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType())),
])


def _rewrite(key: bytes):
    @F.pandas_udf(RESULT)
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                if text is None:
                    rows.append((None, 0, []))
                    continue
                parts, at, found = [], 0, entities(text, key)
                for start, end, _, new in found:
                    parts += [text[at:start], new]
                    at = end
                rows.append(("".join([*parts, text[at:]]) if found else text, len(found), sorted({e[2] for e in found})))
            yield pd.DataFrame(rows, columns=RESULT.names)

    return rewrite


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of `docs` with surrogates in `text`, and `n_entities` and `kinds` (these replace columns of that name).

    Null texts stay null and empty ones empty; a text without entities stays as it is; rows are independent, so
    repeated rows get equal results; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    new = "_surrogate"
    while new in names:
        new += "_"
    done = docs.select(*[F.col(f"`{c}`") for c in names], _rewrite(key.encode())(F.col(f"`{text}`")).alias(new))
    return done.select(
        *[F.col(f"{new}.text").alias(c) if c == text else F.col(f"`{c}`") for c in names], f"{new}.n_entities", f"{new}.kinds"
    )


def entity_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`kind`, `original` and `surrogate` of every occurrence."""

    @F.pandas_udf("array<struct<kind: string, original: string, surrogate: string>>")
    def find(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [{"kind": k, "original": t[a:b].lower(), "surrogate": s.lower()} for a, b, k, s in entities(t or "", key.encode())])

    return docs.select(F.explode(find(F.col(text))).alias("e")).select("e.*")


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Surrogates that stand for more than one original, and originals with more than one surrogate: no rows if all is well."""
    table = entity_table(docs, key, text).distinct()
    many = lambda a, b: table.groupBy("kind", a).agg(F.count("*").alias("n"), F.min(b).alias("example")).where("n > 1").select(
        "kind", F.col(a).alias("value"), F.lit(a).alias("side"), "n"
    )
    return many("surrogate", "original").unionByName(many("original", "surrogate"))
