"""PII: keyed surrogates for detected entities, type-consistent, of the same gender, script and format.

A surrogate is the entity's canonical form under a keyed derangement of its format: the letters and digits that may
vary are the digits of a number in mixed radix (each place has the alphabet of its character's kind). A Feistel network
numbers the format's values in a secret order, and each is replaced by the next one in that order, round in a single
cycle. So different entities of a format get different surrogates, none gets itself, and one entity gets the same
surrogate in every document, whatever else stands there, without any table. Values that a format rules out (a listed
name among unlisted ones, another ending, a private address) are walked over along the cycle, which keeps all three.

Places that make a value valid (card and account check digits, private address ranges, country codes, top-level
domains) are kept or recomputed. Known given names are replaced within the list of their gender and script; other names
keep vowels and consonants apart, so that they can be spoken, and the endings that tell a gender. Titles stay as they
are; unlisted names aren't drawn from a title's list, which has too few for all. Names are found behind titles and as a
listed given name with a capitalised surname.

Each document is checked for distinctness and coreference. What can't vary (a format with a single value, as an address
of signs only) is the one case in which a surrogate would equal its original: letters are put in front of it then.

Cases: null texts stay null with no entities; texts without entities are returned as they are; repeated rows are
treated alike; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomline.llm.common import small_batches, tidy

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles that a name follows, with the gender that they tell.
TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "г-н": "m", "Κύριος": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Señora": "f", "Sra": "f", "г-жа": "f", "Κυρία": "f", "Dr": "", "Prof": ""}
#: Given names by gender and script.
GIVEN = {
    ("m", "LATIN"): "Adam Alan Albert Anton Arthur Ben Carl Daniel David Eric Felix Frank George Hans Henry Hugo Jack James John Joseph Juan Karl Louis Lucas Mark Martin Max Michael Oscar Paul Peter Pierre Robert Samuel Simon Thomas Tobias Victor William Xavier".split(),
    ("f", "LATIN"): "Alice Anna Barbara Carla Carmen Chloe Clara Diana Elena Emma Eva Fiona Greta Hanna Helen Ida Ines Irene Jane Julia Karin Laura Lena Lucy Maria Marta Mary Mia Monica Nina Nora Olivia Paula Petra Rosa Ruth Sara Sofia Susan Vera".split(),
    ("m", "CYRILLIC"): "Андрей Антон Борис Виктор Денис Иван Игорь Максим Михаил Николай Олег Павел Пётр Роман Сергей Юрий".split(),
    ("f", "CYRILLIC"): "Алина Анна Вера Дарья Елена Инна Ирина Лариса Мария Нина Оксана Ольга Светлана Софья Татьяна Юлия".split(),
    ("m", "GREEK"): "Ανδρέας Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
    ("f", "GREEK"): "Άννα Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
#: Endings of names that tell a gender, kept as they are.
ENDINGS = sorted("skaya sky ski ska ová ova eva ov ev a ская ский цкая цкий ова ева ёва ов ев ёв ина ин ына ын ая а я οπούλου όπουλος ου ος ης ας α η".split(), key=len, reverse=True)
#: Lower-case words within names, kept as they are.
PARTICLES = "van von vom der den de het la le du da di do dos das del della ter ten zu zum zur el al bin ibn y".split()
#: Country codes of one and of two digits; all others have three.
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_VOWELS = set("aeiouyáàâäãåéèêëíìîïóòôöõúùûüаеёиоуыэюяαεηιουωάέήίόύώ")

_UPPER = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Lu", "Lt"))
_CASELESS = r"(?:(?![%s])[^\W\d_])" % "".join(c for c in map(chr, range(0x3000)) if c.lower() != c or c.upper() != c)
_WORD = rf"(?:(?:[{_UPPER}]\.)+|[{_UPPER}](?:[^\W\d_]|['’](?!s(?!\w))(?=[^\W\d_]))*)"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
# Capitalised words, initials and particles between them; a lone letter is no name. Without capitals, two words.
_NAME = rf"{_PARTICLES}(?=[{_UPPER}](?:[^\W\d_]|['’][^\W\d_]|\.?[ -]?[{_UPPER}])){_WORD}(?:(?:[ -]|(?<=\.))(?!I(?![\w.'’])){_PARTICLES}{_WORD})*|{_CASELESS}{{2,}}(?:[ -]{_CASELESS}{{2,}})?"

# The order matters: of what begins at one place, the first pattern that fits is taken.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)"
    r"|(?<![A-Za-z])(?i:token|secret|password|passwd|(?:api[_-]?)?key)[\"']? ?[=:] ?[\"']?(?P<secret>(?=[\w\-]*\d)[A-Za-z0-9_\-]{8,})"
    r"|(?P<access>(?<!\w)AKIA[0-9A-Z]{16}(?!\w))"
    r"|(?P<phone>(?<![\w+])\+\d(?:[ .\-/\xa0]?\(?\d\)?){6,14}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
    rf"|(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w))"
    r"|(?P<card>(?<![\w-])(?:\d{4}(?:[ -]?\d{4}){3}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    rf"|(?<!\w)(?:(?:{_TITLE})\.? )+(?P<name>{_NAME})"
)


# The rest of a run of an address's characters, and the address that it may be the begin of.
_RUN, _EMAIL = re.compile(r"[\w.+-]*"), re.compile(r"(?P<email>[\w.+-]++@[\w-]+(?:\.[\w-]+)+)")


def matches(line: str) -> Iterator[re.Match]:
    """The matches of PATTERN, in linear time on runs of any length.

    An address is sought where its run begins, as the places within a run have no other end. Where a match ends within
    a run, the rest of it may be an address too; that is decided once for a run.
    """
    at = run_end = 0
    while True:
        m = None
        if at >= max(run_end, 1):
            run_end = _RUN.match(line, at).end()
            m = _EMAIL.match(line, at) if line.startswith("@", run_end) else None
        if not (m := m or PATTERN.search(line, at)):
            return
        yield m
        at = m.end()


def _stream(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest(), "big")


def _rounds(value: int, half: int, size: int, key: bytes, tweak: str, back: bool) -> int:
    mask = (1 << half) - 1
    left, right = value >> half, value & mask
    for r in reversed(range(8)) if back else range(8):
        if back:
            left, right = right ^ (_stream(key, tweak, size, r, left) & mask), left
        else:
            left, right = right, left ^ (_stream(key, tweak, size, r, right) & mask)
    return left << half | right


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 ... size - 1, or its inverse: Feistel rounds on the next even number of bits, walked until within size."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        value = _rounds(value, half, size, key, tweak, back)
        if value < size:
            return value


def following(value: int, size: int, key: bytes, tweak: str) -> int:
    """The value after this one in the permutation's order, round in one cycle: never itself if there are two."""
    return permute((permute(value, size, key, tweak) + 1) % size, size, key, tweak, True)


@lru_cache(maxsize=4096)
def alphabet(c: str, kind: str) -> str:
    """What a character may become, itself included; kind: 'hex', 'spoken' (vowels and consonants apart) or ''."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    low = c.lower()
    if len(low) != 1 or not c.isalpha():
        return c
    if kind == "hex":
        return "abcdef"
    base = ord(low) // 128 * 128
    letters = [x for x in map(chr, range(base, base + 128)) if unicodedata.category(x) == unicodedata.category(low) and x.lower() == x and len(x.upper()) == 1 and x.isalpha()]
    if kind == "spoken":
        letters = [x for x in letters if (x in _VOWELS) == (low in _VOWELS)]
    return "".join(letters) if low in letters else low


_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")


def redraw(text: str, key: bytes, tweak: str, kind: str = "") -> str:
    """The text of the same format that follows this one; case is kept and doesn't count. Digits in base 16 stay such."""
    if kind == "":
        if _HEX.fullmatch(text):
            return _next(text, key, tweak, "hex")
        new = _next(text, key, tweak, "")
        while _HEX.fullmatch(new):
            new = _next(new, key, tweak, "")
        return new
    return _next(text, key, tweak, kind)


#: Bits of a block's value, at which the next block begins; half a block (and a letter) is less than a digest.
BITS = 448


def _next(text: str, key: bytes, tweak: str, kind: str) -> str:
    """The text that follows this one in its format's order.

    A long text goes block by block, in linear time. A block's order depends on all that stands before it, so the texts
    of a format are still permuted, none follows itself (no block does), and equal blocks don't show.
    """
    places = [alphabet(c, kind) for c in text]
    tweak = f"{tweak}|{''.join(a[0] for a in places if a)}"
    out, start = [], 0
    while start < len(text) or not out:
        value, size, end = 0, 1, start
        while end < len(text) and size.bit_length() <= BITS:
            c, letters = text[end], places[end]
            value, size, end = value * len(letters) + max(0, letters.find(c if c in letters else c.lower())), size * len(letters), end + 1
        new, block = following(value, size, key, tweak), []
        for c, letters in zip(reversed(text[start:end]), reversed(places[start:end]), strict=True):
            new, k = divmod(new, len(letters))
            block.append(c if len(letters) == 1 else letters[k].upper() if c.isupper() else letters[k])
        out.append("".join(reversed(block)))
        tweak, start = f"{_stream(key, tweak, value):x}", end
    return "".join(out)


def _put_digits(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _email(s: str, key: bytes, tweak: str) -> str:
    local, _, domain = s.rpartition("@")
    labels = domain.split(".")
    # reserved example domains name nobody
    fixed = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
    kept = [redraw(x, key, f"{tweak}|label{len(labels)}") for x in labels[:-fixed]] + labels[-fixed:]
    return f"{redraw(local, key, f'{tweak}|{domain.lower()}')}@{'.'.join(kept)}"


def _phone(s: str, key: bytes, tweak: str) -> str:
    """The country code stays, however the number is written, and so does a trunk zero in brackets."""
    code, national = _phone_parts(s)
    new = iter(redraw(national, key, tweak))
    out, skip = [], len(code)
    for i, c in enumerate(s):
        if not c.isdigit() or s[i - 1 : i + 2] == "(0)":
            out.append(c)
        elif skip:
            out.append(c)
            skip -= 1
        else:
            out.append(next(new))
    return "".join(out)


def _phone_parts(s: str) -> tuple[str, str]:
    """(country code, national number), empty and ten digits for a number without +."""
    digits = re.sub(r"\D", "", s.replace("(0)", ""))
    plain = "".join(str(unicodedata.decimal(c)) for c in digits)
    code = next((n for n in (1, 2) if plain[:n] in CODES), 3) if s[0] == "+" else 0
    return digits[:code], digits[code:]


_PRIVATE = ((10, 8), (127, 8), (0xAC1, 12), (0xC0A8, 16))


def _ip(s: str, key: bytes, tweak: str) -> str:
    value = 0
    for part in s.split("."):
        value = value << 8 | int(part)
    for prefix, bits in _PRIVATE:
        if value >> (32 - bits) == prefix:
            rest = 32 - bits
            value = prefix << rest | following(value & ((1 << rest) - 1), 1 << rest, key, f"{tweak}|{prefix}")
            break
    else:
        value = following(value, 1 << 32, key, tweak)
        while any(value >> (32 - bits) == prefix for prefix, bits in _PRIVATE):
            value = following(value, 1 << 32, key, tweak)
    return ".".join(str(value >> k & 255) for k in (24, 16, 8, 0))


def _card(s: str, key: bytes, tweak: str) -> str:
    digits = re.sub(r"\D", "", s)
    if luhn(digits):
        new = redraw(digits[:-1], key, tweak)
        new += next(d for d in "0123456789" if luhn(new + d))
    else:
        new = redraw(digits, key, tweak)
        while luhn(new):
            new = redraw(new, key, tweak)
    return _put_digits(s, new)


def _iban(s: str, key: bytes, tweak: str) -> str:
    bare = s.replace(" ", "")
    new = redraw(bare[4:], key, f"{tweak}|{bare[:2]}")
    number = int("".join(str(int(c, 36)) for c in f"{new}{bare[:2]}00"))
    it = iter(f"{bare[:2]}{98 - number % 97:02d}{new}")
    return "".join(c if c == " " else next(it) for c in s)


def iban_valid(s: str) -> bool:
    bare = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _script(word: str) -> str:
    return unicodedata.name(word[0], "").split(" ")[0]


_GIVEN_PLACE = {n.lower(): (g, script, i) for (g, script), names in GIVEN.items() for i, n in enumerate(names)}


def given_gender(word: str) -> str:
    return _GIVEN_PLACE.get(word.lower(), ("",))[0]


def _ending(word: str) -> str:
    low = word.lower()
    return next((word[len(word) - len(e) :] for e in ENDINGS if len(word) > len(e) + 1 and low.endswith(e)), "")


def _is_particle(word: str) -> bool:
    return word in PARTICLES or len(word) > 1 and word.lower() in PARTICLES


def _spoken(word: str, key: bytes, tweak: str) -> str:
    """Other letters but for the ending; words of one ending follow each other, listed given names and particles left out."""
    end = _ending(word)
    new = word
    while True:
        new = redraw(new[: len(new) - len(end)], key, f"{tweak}|{end.lower()}" if end else tweak, "spoken") + end
        if not given_gender(new) and not _is_particle(new) and _ending(new).lower() == end.lower():
            return new


def _name(s: str, key: bytes, tweak: str) -> str:
    """Given names by list, else and for surnames by spoken letters; each word by itself, so that a surname alone is the same."""
    out = []
    for word in re.split(r"([ -])", s):
        if word in ("", " ", "-") or _is_particle(word):
            out.append(word)
        elif word.lower() in _GIVEN_PLACE:
            gender, script, i = _GIVEN_PLACE[word.lower()]
            names = GIVEN[gender, script]
            new = names[following(i, len(names), key, f"{tweak}|{gender}|{script}")]
            out.append(new.upper() if word.isupper() else new)
        else:
            out.append(_spoken(word, key, tweak))
    return "".join(out)


DRAW: dict[str, Callable[[str, bytes, str], str]] = {"email": _email, "phone": _phone, "ip": _ip, "card": _card, "iban": _iban, "name": _name, "ssn": redraw, "secret": redraw, "access": lambda s, key, tweak: s[:4] + redraw(s[4:], key, tweak)}


def canonical(kind: str, s: str) -> str:
    """The same for all ways to write one entity."""
    if kind == "phone":
        return "+".join(_phone_parts(s)) if s[0] == "+" else f"1+{_phone_parts(s)[1]}"
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"[ -]", "", s)
    if kind == "ip":
        return ".".join(str(int(x)) for x in s.split("."))
    return s.lower() if kind in ("email", "name") else s


#: One of these stands in every entity or before it on its line; no entity spans lines.
_HINT = re.compile("|".join([*"0123456789@", *sorted(TITLES, key=len, reverse=True), *(f(w) for w in ("token", "secret", "passw", "key") for f in (str, str.upper, str.capitalize)), "AKIA"]))


# A given name, more initials or words and a surname; sought where a listed given name stands.
_FULL = re.compile(rf"(?<![\w.'’-])[{_UPPER}][^\W\d_]+(?:[ -][{_UPPER}](?:\.|[^\W\d_]+)){{0,2}} {_PARTICLES}[{_UPPER}](?:['’][{_UPPER}])?[^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)?(?!\w)")
@lru_cache(maxsize=1)
def _given_names() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for names in GIVEN.values():
        for n in names:
            for form in (n, n.upper()):
                found.add_word(f"{form} ", len(form) + 1)
                found.add_word(f"{form}-", len(form) + 1)
    found.make_automaton()
    return found


def _full_names(text: str) -> Iterator[tuple[int, int, str]]:
    for end, n in _given_names().iter(text):
        if m := _FULL.match(text, end + 1 - n):
            yield *m.span(), "name"


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity, in order."""
    found, done = [], 0
    while hint := _HINT.search(text, done):
        start = text.rfind("\n", done, hint.start()) + 1 or done
        done = text.find("\n", hint.end())
        done = len(text) if done < 0 else done
        for m in matches(text[start:done]):
            kind = m.lastgroup
            lo, hi = m.span(kind)
            if kind == "iban" and not iban_valid(m[kind]):
                continue
            found.append((start + lo, start + hi, kind))
    names, at = [], 0
    for start, end, kind in _full_names(text):
        while at < len(found) and found[at][1] <= start:
            at += 1
        if (at == len(found) or found[at][0] >= end) and (not names or names[-1][1] <= start):
            names.append((start, end, kind))
    return sorted(found + names) if names else found


def surrogate(kind: str, s: str, key: bytes) -> str:
    """The same for all ways to write one entity, but for how it is written; never the entity itself."""
    new = DRAW[kind](s, key, kind)
    return new if canonical(kind, new) != canonical(kind, s) else _wider(kind, s, key, 0)


def _wider(kind: str, s: str, key: bytes, attempt: int) -> str:
    """A surrogate of a longer format, for what can't vary in its own."""
    if kind == "email":
        return f"{redraw('xxxx', key, f'{attempt}|{canonical(kind, s)}')}{s}"
    if kind == "name":
        return f"{redraw('Xaxax', key, f'{attempt}|{canonical(kind, s)}', 'spoken')}{s[1:]}"
    raise ValueError(f"an entity of kind {kind} has no surrogate of its own")


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, str]]]:
    """The text with surrogates, and (kind, surrogate) of each entity in order."""
    if not text:
        return text, []
    parts, at, out = [], 0, []
    given: dict[tuple[str, str], str] = {}
    for start, end, kind in entities(text):
        s = text[start:end]
        own, new, attempt = canonical(kind, s), surrogate(kind, s, key), 0
        # The check of distinctness and coreference: to one canonical form belongs one entity's. Only forms that Unicode
        # folds together (of one letter in two spellings) can fail it.
        while given.setdefault((kind, canonical(kind, new)), own) != own:
            attempt += 1
            new = _wider(kind, s, key, attempt)
        parts += [text[at:start], new]
        at = end
        out.append((kind, new))
    return ("".join([*parts, text[at:]]) if out else text), out


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_entities, n_distinct, kinds (sorted "kind:count" list) and text with surrogates, for every row."""
    if not key:
        raise ValueError("surrogates need a key")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [replace(t, key) for t in b["text"]]
            kinds = [sorted(k for k, _ in found) for _, found in rows]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].to_numpy(), "n_entities": np.array([len(f) for _, f in rows], np.int64), "n_distinct": np.array([len({(k, canonical(k, s)) for k, s in f}) for _, f in rows], np.int64),
                "kinds": [",".join(f"{k}:{ks.count(k)}" for k in dict.fromkeys(ks)) for ks in kinds], "text": [t for t, _ in rows],
            })

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_entities long, n_distinct long, kinds string, text string")
