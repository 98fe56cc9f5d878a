"""Personal data: detection, and keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, read

#: The session setting that holds the key, and the key where it is unset; a production job sets its own secret.
KEY_SETTING, KEY = "spark.blockweft.surrogate.key", b"replace this key in production"
ROUNDS = 8

# Patterns of the entities, in order of precedence.
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])")),
)
#: Titles before a name, by gender where they show one.
TITLES = {
    "man": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "M.", "Señor", "Sr.", "Don"),
    "woman": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Mme", "Mlle", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra.", "Srta.", "Doña"),
    "person": ("Dr", "Doctor", "Doktor", "Docteur", "Dra", "Prof", "Professor", "Professeur", "Profesor", "Profesora"),
}
#: Words that stand within a family name.
PARTICLES = "von|van|der|den|de|del|della|di|da|dos|du|la|le|las|los|zu|zum|zur|ten|ter|y"
#: Given names that show a gender; they replace each other.
GIVEN = {
    "man": ("Adam", "Anton", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Jean", "John", "José", "Juan", "Karl", "Leo", "Louis", "Marc", "Martin", "Max", "Oscar", "Pablo", "Paul", "Peter", "Pierre", "Robert", "Simon", "Thomas", "Tom", "Victor"),
    "woman": ("Alice", "Anna", "Carla", "Clara", "Claire", "Elena", "Ella", "Emma", "Eva", "Greta", "Hanna", "Ida", "Ines", "Irene", "Jane", "Julia", "Laura", "Lea", "Lena", "Lucia", "Marie", "Maria", "Martha", "Mary", "Nina", "Olga", "Paula", "Rosa", "Sara", "Sofia", "Vera"),
}
#: Alphabets whose letters replace each other: in names vowels stand for vowels, so that they can still be spoken.
VOWELS = ("aeiou", "AEIOU", "áàâäãéèêëíìîïóòôöõúùûü", "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ", "аеиоуыэюя", "АЕИОУЫЭЮЯ", "αεηιουω", "ΑΕΗΙΟΥΩ")
CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "çñ", "ÇÑ", "бвгджзйклмнпрстфхцчшщъь", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "βγδζθκλμνξπρστφχψ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
DIGITS = "0123456789"
PLACE = {c: (a, k) for a in (DIGITS, *(v + c for v, c in zip(VOWELS, CONSONANTS, strict=True))) for k, c in enumerate(a)}
SPOKEN = {c: (a, k) for a in (DIGITS, *VOWELS, *CONSONANTS) for k, c in enumerate(a)}
#: Code points in which the alphabet of any other letter is looked for, from near ones to far ones.
REACH = (1 << 7, 1 << 10, 1 << 16)


@lru_cache(maxsize=1 << 16)
def alphabet(c: str) -> tuple[str, int] | None:
    """The alphabet of a letter or digit that PLACE doesn't have, and its place there: the digits of its script, or the
    letters of its case among the code points around it. None for all other characters."""
    if c in PLACE:
        return None
    if (digit := unicodedata.decimal(c, None)) is not None:
        return "".join(chr(ord(c) - digit + k) for k in range(10)), digit
    kind = unicodedata.category(c)
    if not kind.startswith("L"):
        return None
    for reach in REACH:
        first = ord(c) // reach * reach
        found = _alike(first, reach, kind)
        if len(found) > 1:
            return found, found.index(c)
    return None


@lru_cache(maxsize=4096)
def _alike(first: int, reach: int, kind: str) -> str:
    return "".join(x for x in map(chr, range(first, first + reach)) if unicodedata.category(x) == kind and x not in PLACE)


def placed(c: str, place: dict[str, tuple[str, int]]) -> tuple[str, int] | None:
    return place.get(c) or alphabet(c)




def _marks() -> str:
    """A character class of the marks that follow letters in many scripts, as ranges."""
    points = {k for k in range(0x300, 0x10000) if unicodedata.category(chr(k))[0] == "M"}
    starts, ends = sorted(k for k in points if k - 1 not in points), sorted(k for k in points if k + 1 not in points)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


#: Letters with the marks that belong to them.
_RUN = rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*"
_WORD = rf"(?:[^\W\d_]['’])?{_RUN}(?:['’-]{_RUN})*"
#: The same with a capital at its start, or behind a letter and an apostrophe (d'Arc).
_CAPITAL = rf"(?:[^\W\d_]['’])?(?![a-zß-öø-ÿа-яёα-ωά-ώ]){_RUN}(?:['’-]{_RUN})*"
_TITLE = "|".join(re.escape(t) + ("" if t.endswith(".") else r"\.?") for kind in TITLES.values() for t in kind)
#: A title, further titles, and the words of a name behind it, with particles between them.
NAMED = re.compile(rf"(?<![\w.])((?:(?:{_TITLE})\s+)+)((?:(?:{PARTICLES})\s)*{_CAPITAL}(?:\s(?:(?:{PARTICLES})\s)*{_CAPITAL}){{0,3}})")
_BARE = sorted({t.rstrip(".") for kind in TITLES.values() for t in kind})
QUICK = tuple(f"{t}{end}" for t in _BARE for end in (" ", ". "))
OF_TITLE = {t.rstrip("."): kind for kind, titles in TITLES.items() for t in titles}
IN_NAME = re.compile(_WORD)
ANY_DIGIT = re.compile(r"\d")
PARTICLE, OWNED = re.compile(f"(?:{PARTICLES})$"), re.compile(r"['’]s?$")


def permuted(symbols: Sequence[int], sizes: Sequence[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the sequences of these alphabet sizes, of one cycle: with more than one sequence, none stays.

    Rounds of a Feistel network, the next sequence in counting order, and the rounds back.
    """
    x, half = list(symbols), len(symbols) // 2
    if not half:
        return [shuffled(sizes[0], key, tweak)[x[0]]] if x else x
    for r in range(ROUNDS):
        _mixed(x, sizes, r, 1, key, tweak)
    for k, size in enumerate(sizes):
        x[k] = (x[k] + 1) % size
        if x[k]:
            break
    for r in reversed(range(ROUNDS)):
        _mixed(x, sizes, r, -1, key, tweak)
    return x


def _mixed(x: list[int], sizes: Sequence[int], r: int, sign: int, key: bytes, tweak: str) -> None:
    """Add to one half, or take from it, what the other gives."""
    half = len(x) // 2
    mine, other = (range(half), range(half, len(x))) if r % 2 else (range(half, len(x)), range(half))
    said = hashlib.blake2b(f"{tweak}|{r}|{len(x)}|{','.join(str(x[k]) for k in other)}".encode(), key=key[:64], digest_size=64).digest()
    for n, k in enumerate(mine):
        if n % 32 == 0 and n:
            said = hashlib.blake2b(said, key=key[:64], digest_size=64).digest()
        x[k] = (x[k] + sign * int.from_bytes(said[2 * (n % 32) : 2 * (n % 32) + 2], "big")) % sizes[k]


@lru_cache(maxsize=1024)
def shuffled(n: int, key: bytes, tweak: str) -> tuple[int, ...]:
    """A permutation of n things that the key decides: one cycle, so nothing stays, in an order that a few pairs don't tell."""
    order = sorted(range(n), key=lambda k: hashlib.blake2b(f"{tweak}|{n}|{k}".encode(), key=key[:64]).digest())
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    return tuple(after[k] for k in range(n))


def walked(start: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """Apply a permutation until the value is valid: a permutation of the valid values, as the first one is valid."""
    x = step(start)
    while not valid(x) and x != start:
        x = step(x)
    return x


def letters(value: str, key: bytes, tweak: str, place: dict[str, tuple[str, int]] = PLACE) -> str:
    """Letters and digits of any script replaced by others of their alphabet, all else as it is."""
    found = [(k, *p) for k, c in enumerate(value) if (p := placed(c, place))]
    if not found:
        return value
    shape = "".join(a[0] for _, a, _ in found)  # values of different shapes never meet
    new = permuted([n for _, _, n in found], [len(a) for _, a, _ in found], key, f"{tweak}:{shape}")
    out = list(value)
    for (k, a, _), n in zip(found, new, strict=True):
        out[k] = a[n]
    return "".join(out)


def plain_digits(value: str) -> str:
    """The digits of a value, of whatever script, as 0 to 9."""
    return "".join(str(unicodedata.decimal(c)) for c in value if c.isdecimal())


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order, each by one of its own script."""
    it = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(it))) if c.isdecimal() else c for c in value)


def iban_check(country: str, rest: str) -> int:
    """The two check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of an entity: of equal values (in any formatting) equal ones, of different values different ones.

    Kinds of single words of names are man, woman and person (given names) and family.
    """
    digits = plain_digits(value)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        low = letters(local.lower(), key, f"email:{domain.lower()}")
        # letters keep their case where both have one
        local = "".join(n.upper() if o.isupper() and n.upper().lower() == n else n for o, n in zip(local, low, strict=True)) if len(low) == len(local) else low
        return f"{local}@{letters(host.lower(), key, 'host')}.{top}"
    if kind == "card":
        body, check = digits[:-1], int(digits[-1])
        # the issuer's digit stays, the check digit stays as right or wrong as it was
        new = body[0] + letters(body[1:], key, f"card:{len(digits)}:{body[0]}")
        return refill(value, new + str((luhn(new) + check - luhn(body)) % 10))
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        private = lambda o: o[0] == 10 or o[:2] == [192, 168] or (o[0] == 172 and 16 <= o[1] < 32)
        kind_of = lambda o: (private(o), o[0] in (0, 127), o[0] >= 224)
        was = kind_of(octets)
        x = permuted(octets, [256] * 4, key, "ip")
        while kind_of(x) != was:
            x = permuted(x, [256] * 4, key, "ip")
        return ".".join(map(str, x))
    if kind == "phone":
        country = len(re.match(r"\+?(\d{0,3})", value)[1]) if value.startswith("+") else 0
        country = country if len(digits) > country + 3 else 0
        ok = lambda d: (d[:1] < "2") == (digits[country : country + 1] < "2")
        return refill(value, digits[:country] + walked(digits[country:], lambda d: letters(d, key, f"phone:{digits[:country]}:{len(digits)}"), ok))
    if kind == "iban":
        bare = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value if c != " ")
        rest = letters(bare[4:], key, "iban:" + bare[:2])
        was, right, new = int(bare[2:4]), iban_check(bare[:2], bare[4:]), iban_check(bare[:2], rest)
        # check digits stay as right or wrong as they were, apart from what two digits can't show
        moved = f"{bare[:2]}{(was - right + new) % 100:02d}{rest}"
        at = iter(moved)
        return "".join(c if c == " " else n if not c.isdecimal() or not n.isdecimal() else refill(c, n) for c, n in ((c, None if c == " " else next(at)) for c in value))
    if kind == "ssn":
        return refill(value, letters(digits, key, "ssn"))
    if kind in ("man", "woman", "person"):
        for gender, names in GIVEN.items():
            if value in names:
                return names[shuffled(len(names), key, gender)[names.index(value)]]
        known = frozenset(GIVEN["man"] + GIVEN["woman"])
        return walked(value, lambda w: letters(w, key, "given", SPOKEN), lambda w: w not in known)
    return letters(value, key, kind, SPOKEN if kind == "family" else PLACE)


def names_in(text: str) -> dict[str, str]:
    """The words of the names that stand behind titles, with their kinds; a family name behind any title is one."""
    words: dict[str, str] = {}
    for m in NAMED.finditer(text):
        genders = [OF_TITLE.get(t.rstrip("."), "person") for t in m[1].split()]
        gender = next((g for g in genders if g != "person"), "person")
        parts = [OWNED.sub("", w) for w in IN_NAME.findall(m[2]) if not PARTICLE.match(w)]
        for k, w in enumerate(parts):
            kind = "family" if k == len(parts) - 1 else gender
            if words.get(w) != "family":
                words[w] = kind
    return words


def detected(text: str) -> list[tuple[int, int, str]]:
    """Entities as (start, end, kind), in order; of overlapping ones the kind of precedence stays.

    Names are replaced word by word: every whole-word mention, anywhere in the text, of a word of a name that stands
    behind a title somewhere in it.
    """
    found: list[tuple[int, int, str]] = []
    taken: bytearray | None = None
    digits = ANY_DIGIT.search(text) is not None

    def add(a: int, b: int, kind: str) -> None:
        nonlocal taken
        if taken is None:
            taken = bytearray(len(text))
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind))

    for kind, pattern in PATTERNS:
        if (kind == "email" and "@" not in text) or (kind in ("iban", "card", "ssn", "ip", "phone") and not digits):
            continue
        for m in pattern.finditer(text):
            if kind == "card":
                number = plain_digits(m[0])
                if int(number[-1]) != luhn(number[:-1]) and not (len(number) == 16 and number[0] in "3456"):
                    continue
            add(*m.span(), kind)
    # most texts have no title, which a plain search sees quickest
    flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\xa0", " ")
    words = names_in(text) if any(t in flat for t in QUICK) else {}
    if words:
        for m in IN_NAME.finditer(text):
            a, b = m.span()
            if m[0] in words:
                add(a, b, words[m[0]])
            elif (w := OWNED.sub("", m[0])) != m[0] and w in words:
                add(a, a + len(w), words[w])  # Smith's
            elif "-" in m[0]:
                for part in re.finditer(r"[^-]+", m[0]):
                    if part[0] in words:
                        add(a + part.start(), a + part.end(), words[part[0]])
    return sorted(found)


def hidden(kind: str, value: str, key: bytes) -> str:
    """The surrogate of an entity; where nothing in it can be replaced, a mark of its own, so that no entity stays."""
    new = surrogate(kind, value, key)
    return new if new != value else f"[{kind} {hashlib.blake2b(plain(kind, value).encode(), key=key[:64], digest_size=8).hexdigest()}]"


def replaced(text: str, key: bytes, found: list[tuple[int, int, str]] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    found = detected(text) if found is None else found
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], hidden(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]]), found


def plain(kind: str, value: str) -> str:
    """The form that mentions of one entity share."""
    if kind == "card":
        return plain_digits(value)
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


def group_of(kind: str) -> str:
    """Kinds whose surrogates must differ from each other."""
    return "given" if kind in ("man", "woman", "person") else kind


SCHEMA = "kind string, value string, replacement string"


def entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, replacement): the different entities of the corpus in their plain form."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = {(k, plain(k, t[a:b])) for t in pdf["text"].tolist() if t for a, b, k in detected(t)}
            if rows:  # an empty frame has no types
                listed = sorted({(group_of(k), v, plain(k, hidden(k, v, key))) for k, v in rows})
                yield pd.DataFrame(listed, columns=["kind", "value", "replacement"])

    return map_batches(docs.select("text"), run, SCHEMA).distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Replacements that stand for several values of a kind, and values that several replacements stand for."""
    shared = found.groupBy("kind", "replacement").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("replacement").alias("value"), F.lit("distinctness").alias("broken"))
    split = found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "value", F.lit("coreference").alias("broken"))
    return shared.unionByName(split)


def pseudonymise(docs: DataFrame, key: bytes = KEY, check: bool = True) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text, n_entities, entities.

    Every entity is replaced by a surrogate of its kind and format, which always differs from it: digits by digits of
    their script, letters of any script by letters of their alphabet and case (beyond Latin, Cyrillic and Greek: by
    letters of their Unicode class near them), given names by names of the same gender, vowels of names by vowels; check digits and address
    ranges that hold go on to hold. A name is found behind a title (Mr Smith, Dr. Anna Lee, Frau von Berg) and then in
    every mention of its words in the text, with or without the title; names of which no word follows a title anywhere
    in the text are not found, a limit. Surrogates come from keyed permutations, so one entity has one surrogate in all
    documents (coreference) and two never share one (distinctness); ``check`` counts over the whole corpus that both
    hold, and raises if they do not. ``entities`` lists kind:start:end in code points of the old text.

    A null text stays null, without entities; an empty one stays empty; repeated rows are alike, as are rows without
    doc_id; an empty table gives an empty result; texts of any length are read whole, in time linear in their length
    and entities; other columns are ignored.
    """
    if check:
        clash = collisions(cut(entities(docs, key), "entities")).first()
        if clash:
            raise ValueError(f"surrogates of kind {clash['kind']} break {clash['broken']}: use another key")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            done = [(None, []) if t is None else replaced(t, key) for t in pdf["text"].tolist()]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "text": pd.Series([t for t, _ in done], dtype=object, index=pdf.index),
                    "n_entities": [len(f) for _, f in done],
                    "entities": pd.Series([",".join(f"{k}:{a}:{b}" for a, b, k in f) for _, f in done], dtype=object, index=pdf.index),
                }
            )

    rows = docs.select("doc_id", "text")
    return map_batches(rows, run, rows.select("doc_id", "text").schema.add("n_entities", "long").add("entities", "string"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    return pseudonymise(read(spark, sf_dir, "documents"), key.encode() if key else KEY)
