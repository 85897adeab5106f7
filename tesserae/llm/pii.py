"""PII replacement by surrogates.

Detected entities are replaced by keyed surrogates of the same type and format:
a mixed-radix Feistel permutation keeps the class, script and case of every
character, names come from syllables of their gender and script. The same
entity has the same surrogate everywhere. Collision checks over the whole corpus
move a surrogate that another entity has, or that is itself a detected entity,
to its next key until all are distinct. A format whose space is full, or an
entity without a character that can change, is widened after a few keys by a
keyed suffix of its type that grows with every further one, so the search ends.

What counts as a person's name: words after a form of address (``TITLES``) or
an introduction (``INTRODUCED``), a common given name (``GIVEN``) before another
capitalised word, and every other mention of these words in the same text.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, discard, materialise, table

KEY = "tesserae"
#: Keys that are tried within the format of an entity before it is widened.
IN_FORMAT = 4
#: Tasks that the mentions of one entity, or the copies of one text, are dealt over at most.
SALTS = 16
EMAIL = re.compile(r"(?<![\w.+-])[\w.+%-]*[\w+%-]@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w@])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|-\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
SECRET = re.compile(
    r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)gh[pousr]_\w{20,}|(?<!\w)xox[abprs]-[\w-]{10,}|(?<!\w)sk-[\w-]{16,}"
    r"|(?i:(?<!\w)(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)[\"']?\s*[:=]\s*[\"']?)([\w+/=.~-]{8,})"
)
#: Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Don": "m", "Monsieur": "m", "Signor": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Doña": "f", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Dr": "n", "Prof": "n", "Professor": "n", "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f",
}
#: What introduces a person by name.
INTRODUCED = ("My name is", "my name is", "Name:", "name:", "Signed by", "signed by")
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
INTRODUCTION = re.compile("(?<!\\w)(?:" + "|".join(INTRODUCED) + rf") (?=({_WORD}(?: {_WORD}){{0,2}}))")
AFTER_TITLE = re.compile(rf"\.? (?=({_WORD}(?: {_WORD}){{0,2}}))")
#: Common given names that are no common words, by gender.
GIVEN = {
    "m": "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth Kevin Brian "
    "George Edward Ronald Timothy Jason Jeffrey Jacob Nicholas Eric Jonathan Stephen Benjamin Samuel Peter Hans Klaus Jürgen Wolfgang "
    "Pierre Jacques Michel Juan Carlos José Miguel Luis Иван Александр Сергей Дмитрий Андрей Михаил",
    "f": "Mary Anna Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Ashley Emily Michelle Amanda Melissa "
    "Deborah Rebecca Laura Helen Samantha Katherine Christine Maria Julia Ursula Monika Sabine Petra Marie Nathalie Isabelle Sophie "
    "Carmen Ana Lucía Isabel Мария Анна Елена Ольга Наталья Татьяна",
}
GENDER_OF = {name.casefold(): gender for gender, names in GIVEN.items() for name in names.split()}
_UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ"
#: A word that may be a form of address or a given name.
CAPITAL = re.compile(rf"(?<!\w)[{_UPPER}г][^\W\d_]*(?:-[^\W\d_]+)?")
AFTER_GIVEN = re.compile(rf"(?: [{_UPPER}][^\W\d_]*(?:[-'’][^\W\d_]+)*){{1,2}}(?!\w)")
#: What a text must have in lower case for ``SECRET`` to find anything.
SECRET_SIGNS = ("password", "passwd", "pwd", "secret", "api", "access", "token", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-")
KEPT_DOMAINS = re.compile(r"(?:^|\.)(?:example\.(?:com|net|org)|gmail\.com|googlemail\.com|yahoo\.\w+|hotmail\.\w+|outlook\.\w+|icloud\.com|gmx\.\w+|web\.de|aol\.com|protonmail\.com)$")
#: Syllables and endings by script and gender (n: either).
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ha he ja jo ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe po ra re ri ro sa se so ta te ti to va ve vi wa we za zo".split(),
    "greek": "βα βε βι γα γε δα δε δι ζα θα θε κα κο λα λε λι μα με μι να νε νι πα πε πο ρα ρε ρι σα σε σο τα τε τι φα φι χα".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до за зо ка ки ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се со та те ти то фа фе".split(),
}
ENDINGS = {
    ("latin", "m"): "n rt s d k".split(), ("latin", "f"): "na la ria nne ta".split(), ("latin", "n"): "r ll x m ck".split(),
    ("greek", "m"): "ς ος ης".split(), ("greek", "f"): "να η ια".split(), ("greek", "n"): "ν ρ ου".split(),
    ("cyrillic", "m"): "н р л с м".split(), ("cyrillic", "f"): "на ла рия нна та".split(), ("cyrillic", "n"): "ко к ч ж х".split(),
}


def _luhn(digits: list[int]) -> bool:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _may_be_name(word: str) -> bool:
    """Capitalised, or of a script without capitals."""
    return (word[0].isupper() or word[0].upper() == word[0].lower()) and word not in TITLES


def _named(words: str, at: int, gender: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, gender, word) of the names among ``words``, which stand at ``at``."""
    parts = []
    for word in words.split(" "):
        if not _may_be_name(word):
            break
        parts.append(word)
        if not word[0].isupper():
            break  # without capitals nothing says where a name ends
    for k, word in enumerate(parts):
        # the last of several names is a surname, which has no gender of its own
        yield at, at + len(word), gender if k < max(len(parts) - 1, 1) else "n", word
        at += len(word) + 1


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, gender, word) of names that their surroundings tell."""
    for m in CAPITAL.finditer(text):
        word = m[0]
        if word in TITLES:
            if after := AFTER_TITLE.match(text, m.end()):
                yield from _named(after[1], after.start(1), TITLES[word])
        elif (gender := GENDER_OF.get(word.casefold())) is not None and not (word.isupper() and len(word) > 1):
            after = AFTER_GIVEN.match(text, m.end())
            if after is None or after[0].split()[0].casefold() == word.casefold():
                continue
            yield m.start(), m.end(), gender, word
            at = m.end() + 1
            for surname in after[0].split():
                if surname not in TITLES:
                    yield at, at + len(surname), "n", surname
                at += len(surname) + 1
    if any(phrase in text for phrase in INTRODUCED):
        for m in INTRODUCTION.finditer(text):
            yield from _named(m[1], m.start(1), "n")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of all entities, none overlapping; ``entity`` is free of format."""
    found: list[tuple[int, int, int, str, str]] = []

    def add(rank: int, start: int, end: int, kind: str, entity: str) -> None:
        found.append((start, rank, end, kind, entity))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(0, *m.span(), "email", m[0].lower())
    folded = text.lower()
    for m in SECRET.finditer(text) if any(sign in folded for sign in SECRET_SIGNS) else ():
        span = m.span(1) if m[1] else m.span()
        # a value of letters alone is one only if it is set with an equals sign or a quote: prose follows colons too
        if m[1] is None or re.search(r"\d", m[1]) or _secret_head(m[1]) or re.search(r"[=\"']", text[m.start() : span[0]]):
            add(1, *span, "secret", text[slice(*span)])
    if re.search(r"\d", text) is not None:
        for m in IP.finditer(text):
            add(2, *m.span(), "ip", m[0])
        for m in CARD.finditer(text):
            plain = [int(c) for c in m[0] if c.isdigit()]
            if _luhn(plain) or (len(plain) == 16 and plain[0] in (3, 4, 5, 6)):
                add(3, *m.span(), "card", "".join(map(str, plain)))
        for m in IBAN.finditer(text):
            if _iban_ok(plain := m[0].replace(" ", "")):
                add(3, *m.span(), "iban", plain)
        for m in SSN.finditer(text):
            add(4, *m.span(), "ssn", m[0].replace("-", ""))
        for m in PHONE.finditer(text):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                add(5, *m.span(), "phone", re.sub(r"[^\d+]", "", m[0]))
    words: dict[str, str] = {}
    for start, end, gender, word in _names(text):
        if words.get(word, "n") == "n":
            words[word] = gender
        add(6, start, end, "", word)
    if words:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?!\w)", text):
            add(7, *m.span(), "", m[0])
    starts: list[int] = []
    out: list[tuple[int, int, str, str]] = []
    for start, _, end, kind, entity in sorted(found, key=lambda x: (x[1], x[0])):
        at = bisect.bisect_left(starts, start)
        if (at and out[at - 1][1] > start) or (at < len(out) and out[at][0] < end):
            continue
        if not kind:
            kind, entity = f"name:{words[entity]}", entity.casefold()
        starts.insert(at, start)
        out.insert(at, (start, end, kind, entity))
    return out


def _number(key: str, label: str, value: object, size: int) -> int:
    digest = hashlib.blake2b(f"{label}\x00{value}".encode(), key=key.encode()[:64], digest_size=16 + size.bit_length() // 8).digest()
    return int.from_bytes(digest, "big") % size


def permute(key: str, label: str, values: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of the tuples with these radices (an eight-round Feistel network over two halves)."""
    if not values:
        return values
    half = len(values) // 2
    if not half:
        return [(values[0] + 1 + _number(key, label, radices[0], max(radices[0] - 1, 1))) % radices[0]]

    def pack(part: list[int], base: list[int]) -> tuple[int, int]:
        total, size = 0, 1
        for v, r in zip(part, base):
            total, size = total * r + v, size * r
        return total, size

    (a, a_size), (b, b_size) = pack(values[:half], radices[:half]), pack(values[half:], radices[half:])
    for k in range(8):
        if k % 2:
            b = (b + _number(key, f"{label}/{k}/{a_size}/{b_size}", a, b_size)) % b_size
        else:
            a = (a + _number(key, f"{label}/{k}/{a_size}/{b_size}", b, a_size)) % a_size
    out: list[int] = []
    for total, base in ((b, radices[half:]), (a, radices[:half])):
        part = []
        for r in reversed(base):
            total, v = divmod(total, r)
            part.append(v)
        out = part[::-1] + out
    return out


@functools.lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters that may stand for ``c``: digits for a digit, else letters of its case, script and code page."""
    category = unicodedata.category(c)
    if category == "Nd":
        zero = ord(c) - unicodedata.digit(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if category[0] != "L":
        return c
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    script, page = unicodedata.name(c, "").partition(" ")[0], ord(c) & ~0xFF
    near = [x for x in map(chr, range(page, page + 256)) if unicodedata.category(x) == category and unicodedata.name(x, "").partition(" ")[0] == script]
    # what changes its length or letters in another case would not come back the same
    return "".join(x for x in near if x == c or (len(x.upper()) == len(x.lower()) == 1 and x.upper().lower() == x.lower() and x == unicodedata.normalize("NFC", x)))


def _permute_text(key: str, label: str, text: str) -> str:
    """Every letter and digit within its alphabet; other characters stay."""
    if re.fullmatch(r"(?=.*[a-f])[0-9a-f]{12,}", text):
        alphabets = ["0123456789abcdef"] * len(text)
    else:
        alphabets = [_alphabet(c) for c in text]
    # the shape is part of the key; within one shape this is a permutation
    shape = "".join(c if len(a) == 1 else "d" if a[0].isdigit() else "x" for c, a in zip(text, alphabets))
    at = [k for k, a in enumerate(alphabets) if len(a) > 1]
    new = permute(key, f"{label}/{shape}", [alphabets[k].index(text[k]) for k in at], [len(alphabets[k]) for k in at])
    out = list(text)
    for k, v in zip(at, new):
        out[k] = alphabets[k][v]
    return "".join(out)


def _permute_digits(key: str, label: str, digits: str, allowed) -> str:
    """Permuted until it is allowed: a walk along the permutation's cycle, so still a permutation of what is allowed."""
    for _ in range(1000):
        digits = "".join(map(str, permute(key, f"{label}/{len(digits)}", [int(c) for c in digits], [10] * len(digits))))
        if allowed(digits):
            break
    return digits


def script_of(word: str) -> str:
    """Script of a name, by its first letter."""
    name = next((unicodedata.name(c, "") for c in word if c.isalpha()), "LATIN")
    return name.partition(" ")[0].lower()


def default_gender(entity: str) -> str:
    """What a name alone tells: its entry among the given names, or none."""
    return GENDER_OF.get(entity, "n")


def _in_format(key: str, kind: str, entity: str, attempt: int) -> str:
    """A surrogate of exactly the entity's format."""
    label = f"{kind}/{attempt}"
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        if not KEPT_DOMAINS.search(domain):
            labels = domain.split(".")
            domain = ".".join([*(_permute_text(key, f"domain/{attempt}", x) for x in labels[:-1]), labels[-1]])
        return f"{_permute_text(key, label, local)}@{domain}"
    if kind == "secret":
        start = _secret_head(entity)
        return entity[:start] + _permute_text(key, label, entity[start:])
    if kind == "ip":
        octets = [int(x) for x in entity.split(".")]
        private = octets[0] in (10, 127, 0) or octets[:2] == [192, 168] or octets[0] >= 224
        if private:
            return ".".join(map(str, [*octets[:2], *permute(key, label, octets[2:], [256, 256])]))
        new = octets
        for _ in range(1000):
            new = permute(key, label, new, [256] * 4)
            if not (new[0] in (10, 127, 0) or new[:2] == [192, 168] or new[0] >= 224):
                break
        return ".".join(map(str, new))
    if kind == "card":
        valid = _luhn([int(c) for c in entity])
        if valid:
            return _with_check_digit(entity[0] + _permute_digits(key, label, entity[1:-1], lambda _: True))
        return entity[0] + _permute_digits(key, f"{label}/x", entity[1:], lambda d: not _luhn([int(x) for x in entity[0] + d]))
    if kind == "iban":
        return _iban(entity[:2], _permute_text(key, label, entity[4:]))
    if kind in ("ssn", "phone"):
        prefix = (re.match(r"\+(?:1|7|\d{2})", entity) or [""])[0] if entity.startswith("+") else ""
        rest = entity[len(prefix) :]
        return prefix + _permute_digits(key, f"{label}/{prefix}", rest, lambda d: rest[0] in "01" or d[0] not in "01")
    gender, script = kind.partition(":")[2], script_of(entity)
    if script not in SYLLABLES:
        return _permute_text(key, f"name/{attempt}", entity)
    seed = _number(key, f"name/{script}/{gender}/{attempt}", entity, 1 << 96)
    syllables, ends = SYLLABLES[script], ENDINGS[script, gender]
    seed, n = seed // 2, 2 + seed % 2
    return _syllables(seed // len(ends), syllables, n) + ends[seed % len(ends)]


def _secret_head(entity: str) -> int:
    head = re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-", entity)
    return head.end() if head else 0


def _with_check_digit(body: str) -> str:
    return next(body + str(c) for c in range(10) if _luhn([int(x) for x in body] + [c]))


def _iban(country: str, body: str) -> str:
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def _syllables(seed: int, syllables: list[str], n: int) -> str:
    out = ""
    for _ in range(n):
        seed, k = divmod(seed, len(syllables))
        out += syllables[k]
    return out


def _widened(key: str, kind: str, entity: str, base: str, step: int) -> str:
    """A surrogate beyond the entity's format: ``base`` with a keyed suffix of its type, four symbols more for each step.

    An IPv4 address becomes a unique local IPv6 address, of which 112 bits are keyed.
    """
    if kind == "ip":
        digits = f"{_number(key, f'ip/wide/{step}', entity, 1 << 112):028x}"
        return "fd00:" + ":".join(digits[k : k + 4] for k in range(0, 28, 4))
    symbols = "abcdefghijklmnopqrstuvwxyz" if kind == "email" else "0123456789"
    seed = _number(key, f"{kind}/wide/{step}", entity, 1 << (24 * step))
    if kind.startswith("name"):
        syllables = SYLLABLES.get(script_of(entity))
        return base + _syllables(seed, syllables or list(_alphabet(base[-1])), 2 * step)
    suffix = _syllables(seed, list(symbols), 4 * step)
    if kind == "email":
        local, domain = base.rsplit("@", 1)
        return f"{local}{suffix}@{domain}"
    if kind == "iban":
        return _iban(base[:2], base[4:] + suffix)
    if kind == "card" and _luhn([int(c) for c in entity]):
        return _with_check_digit(base[:-1] + suffix)
    return base + suffix


def surrogate(key: str, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of an entity, free of format like the entity itself."""
    if attempt < IN_FORMAT:
        return _in_format(key, kind, entity, attempt)
    return _widened(key, kind, entity, _in_format(key, kind, entity, IN_FORMAT - 1), attempt - IN_FORMAT + 1)


def first_change(key: str, kind: str, entity: str, attempt: int) -> tuple[int, str]:
    """The next attempt, from ``attempt`` on, whose surrogate is not the entity itself, and that surrogate."""
    while (new := surrogate(key, kind, entity, attempt)) == entity:
        # what its format cannot change at all, no key of that format changes
        attempt += 1
    return attempt, new


def render(original: str, kind: str, new: str) -> str:
    """The surrogate in the format of the original: separators, spaces and case; what was widened follows."""
    if kind in ("card", "phone", "ssn", "iban"):
        symbols = iter(new.replace("+", ""))
        return "".join(next(symbols) if c.isalnum() else c for c in original) + "".join(symbols)
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(original, new)) if len(original) == len(new) else new
    if kind.startswith("name"):
        return new.upper() if len(original) > 1 and original.isupper() else new.capitalize()
    return new


def _entity_rows(docs: DataFrame) -> DataFrame:
    """(doc_key, kind, entity): the distinct entities of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, str]] = []
            for doc_key, text in zip(batch.column("doc_key").to_pylist(), batch.column("text")):
                out += sorted({(doc_key, kind, entity) for _, _, kind, entity in find(text.as_py() or "")})
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_key", "kind", "entity"])

    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_key"), "text")
    return keyed.mapInArrow(run, "doc_key long, kind string, entity string")


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """family, entity, kind, attempt, surrogate of the mentions ``entities`` (kind, entity), one row for each entity.

    All surrogates of a family are distinct and none is one of its detected
    entities. The gender of a name is the one that most of its mentions tell
    (``default_gender`` if they tie), so a name has one surrogate whatever its
    mentions. Each round regenerates the losers alone: of several entities with
    one surrogate the one with the fewest attempts, then the smallest, keeps it.
    Rounds end, since past ``IN_FORMAT`` keys the space grows with every attempt.
    """

    @F.pandas_udf("kind string, attempt int, surrogate string")
    def make(family: pd.Series, entity: pd.Series, votes: pd.Series, attempt: pd.Series) -> pd.DataFrame:
        out = []
        for f, e, v, a in zip(family, entity, votes, attempt):
            kind = f if f != "name" else "name:" + ("m" if v > 0 else "f" if v < 0 else default_gender(e))
            out.append((kind, *first_change(key, kind, e, a)))
        return pd.DataFrame(out, columns=["kind", "attempt", "surrogate"])

    family = F.substring_index("kind", ":", 1).alias("family")
    vote = F.when(F.col("kind") == "name:m", 1).when(F.col("kind") == "name:f", -1).otherwise(0)
    state = entities.groupBy(family, "entity").agg(F.sum(vote).alias("votes")).withColumn("attempt", F.lit(0))
    made = make("family", "entity", "votes", "attempt").alias("made")
    state = materialise(state.select("family", "entity", "votes", made).select("family", "entity", "votes", "made.*"), "surrogates")
    real = state.select("family", F.col("entity").alias("surrogate"))
    while True:
        first = state.groupBy("family", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = first.join(real.withColumn("real", F.lit(True)), ["family", "surrogate"], "left").where("n > 1 OR real")
        taken = materialise(taken.select("family", "surrogate", "first", F.coalesce("real", F.lit(False)).alias("real")), "collisions")
        if taken.isEmpty():
            discard(taken)
            return state
        lost = state.join(taken, ["family", "surrogate"], "left")
        moved = F.col("first").isNotNull() & (F.col("real") | (F.struct("attempt", "entity") != F.col("first")))
        after = lost.withColumn("moved", F.coalesce(moved, F.lit(False))).drop("first", "real")
        kept = after.where("NOT moved").select(*state.columns)
        fresh = after.where("moved").withColumn("attempt", F.col("attempt") + 1).select("family", "entity", "votes", made).select("family", "entity", "votes", "made.*")
        # whatever the round, all entities are in the new state, so ``real`` may read them there
        done, state = state, materialise(kept.unionByName(fresh), "surrogates")
        real = state.select("family", F.col("entity").alias("surrogate"))
        discard(taken, done)


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the text of every row rewritten, and n_entities and kinds of what was replaced.

    * Null text stays null and has no entities; a text without entities stays as it is.
    * Whole texts are read, long ones in time that grows with their length;
      repeated rows are kept and change alike.
    * All other columns are kept, whatever their names; n_entities and kinds
      would be replaced. An empty table gives no rows.

    Surrogates are keyed, so texts are rewritten where they are. Only what the
    corpus decides otherwise (a later key, another gender) travels, by text, to
    the texts that a bitmap of fixed size says may have it.
    """
    entities = materialise(_entity_rows(docs), "entities")
    found = surrogate_table(entities, key)

    @F.pandas_udf("string")
    def expected(family: pd.Series, entity: pd.Series) -> pd.Series:
        return pd.Series([f if f != "name" else f"name:{default_gender(e)}" for f, e in zip(family, entity)], dtype=object)

    differ = (F.col("attempt") > 0) | (F.col("kind") != expected("family", "entity"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    decided = materialise(found.where(differ).select("family", "entity", "kind", "attempt"), "decided")
    mentions = entities.select("doc_key", F.substring_index("kind", ":", 1).alias("family"), "entity").distinct()
    mentions = mentions.withColumn("salt", F.pmod(F.xxhash64("doc_key"), F.lit(SALTS)).cast("int"))
    # an entity that very many texts have meets its decision in several tasks
    by_text = mentions.join(decided.select("*", salts), ["family", "entity", "salt"]).groupBy("doc_key").agg(
        F.collect_list(F.struct("family", "entity", "kind", "attempt")).alias("decided")
    )
    by_text = materialise(by_text, "decided-by-text")
    discard(found, entities)
    names = [c for c in docs.columns if c not in ("text", "n_entities", "kinds")]

    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, decisions in batches:
            out = []
            for text, some in zip(texts, decisions):
                if text is None:
                    out.append((None, 0, []))
                    continue
                later = {(d["family"], d["entity"]): (d["kind"], d["attempt"]) for d in some} if some is not None else {}
                here, parts, at = find(text), [], 0
                for start, end, kind, entity in here:
                    family = kind.partition(":")[0]
                    usual = (family if family != "name" else f"name:{default_gender(entity)}", 0)
                    chosen, attempt = later.get((family, entity), usual)
                    new = surrogate(key, chosen, entity, attempt)
                    parts += [text[at:start], render(text[start:end], chosen, new)]
                    at = end
                out.append(("".join([*parts, text[at:]]), len(here), sorted({k.partition(":")[0] for _, _, k, _ in here})))
            yield pd.DataFrame(out, columns=["text", "n_entities", "kinds"])

    rewritten = F.pandas_udf(rewrite, "text string, n_entities long, kinds array<string>")
    doc_key = F.xxhash64(F.coalesce(F.col("row")["text"], F.lit("")))
    rows = docs.select(F.struct("*").alias("row")).withColumn("doc_key", doc_key)
    may_have = bitmap_of(by_text, "doc_key")
    nothing = F.lit(None).cast(by_text.schema["decided"].dataType)
    # copies of one text meet its decisions in several tasks
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    joined = rows.where(may_have("doc_key")).withColumn("salt", salt).join(by_text.select("*", salts), ["doc_key", "salt"], "left")
    both = joined.select("row", "decided").unionAll(rows.where(~may_have("doc_key")).select("row", nothing.alias("decided")))
    out = both.select("row", rewritten(F.col("row")["text"], F.col("decided")).alias("new"))
    return out.select(*[F.col("row")[c].alias(c) for c in names], "new.text", "new.n_entities", "new.kinds")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs).select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
