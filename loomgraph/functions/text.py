"""Scalar text functions, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Particles after a final consonant, after a vowel, and where the last letter tells nothing.
PARTICLES = {"object": ("을", "를", "을(를)"), "subject": ("이", "가", "이(가)"), "topic": ("은", "는", "은(는)"), "with": ("과", "와", "과(와)")}
#: Number words of Korean amounts.
UNITS = {"": 1, "만": 10**4, "십만": 10**5, "백만": 10**6, "천만": 10**7, "억": 10**8}
#: How a least age (%s: its digits), a least amount and its unit, and a quoted name are written.
AGE = r"만\s?(\d{%s})세\s?이상"
AMOUNT = r"(?:최소\s?가입\s?금액|최저)[^\d]{0,8}([\d,]+)\s?(만|십만|백만|천만|억)?\s?원\s?이상"
QUOTED = "'([^']+)'"
#: References by qualified name and lines of references, which a compact unit doesn't have.
REFERENCE, REFERENCES = r"(?<=\S)\s?\((?:[a-z]+:)[^\s()]+\)", r"(?m)^- \(역참조\).*$"


def squeezed(x: Column) -> Column:
    """White space of any script as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def slug(x: Column) -> Column:
    """Letters a-z, digits and Hangul; each run of anything else is one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, "[^0-9A-Za-z가-힣]+", "_"), "^_+|_+$", "")


def decimal_of(x: Column) -> Column:
    """An exact decimal; null for null, empty or unreadable text."""
    return F.nullif(x.cast("string"), F.lit("")).try_cast("decimal(38,10)")


def short_number(x: Column) -> Column:
    """A decimal with six significant digits at most and no trailing zeros, as printed by '%g' for usual magnitudes; what
    has more digits is rounded as a decimal, halves up."""
    d = x.cast("decimal(38,10)")
    digits = F.length(F.regexp_extract(F.abs(d).cast("decimal(38,0)").cast("string"), r"^0*(\d*)$", 1))
    rounded = F.coalesce(*[F.when(digits >= k, F.round(d, 6 - k)) for k in range(6, 0, -1)], F.round(d, 6)).cast("string")
    plain = F.when(F.contains(rounded, F.lit(".")), F.regexp_replace(rounded, r"\.?0+$", "")).otherwise(rounded)
    return F.when(plain == "-0", "0").otherwise(plain)


def iso_date(x: Column) -> Column:
    """yyyymmdd as a date; null if it is none."""
    return F.try_to_timestamp(x, F.lit("yyyyMMdd")).cast("date")


def particle(word: Column, role: str) -> Column:
    """The particle that follows a word: by whether its last syllable ends with a consonant."""
    closed, open_, unknown = PARTICLES[role]
    last = F.right(word, F.lit(1))
    offset = F.ascii(last) - 0xAC00
    return F.when((offset < 0) | (offset > 0xD7A3 - 0xAC00) | (F.length(word) == 0), unknown).when(F.pmod(offset, F.lit(28)) > 0, closed).otherwise(open_)


def variant(parts: list[Column], n: int) -> Column:
    """A number from 0 to n - 1 that depends on the parts alone: the CRC-32 of the parts joined by colons."""
    return F.pmod(F.crc32(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), F.lit(n)).cast("int")


def pick(variants: list[str] | list[Column], *parts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in variants]), variant(list(parts), len(variants)) + 1)


def listed(x: Column, universe: list[str] | None = None) -> Column:
    """The parts of a comma-separated text, trimmed, without empty ones; with a universe, those of it in its order."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda x: F.trim(x)), lambda w: F.length(w) > 0)
    return parts if universe is None else F.filter(F.array(*map(F.lit, universe)), lambda c: F.array_contains(parts, c))


def least_age(x: Column, digits: str = "1,3") -> Column:
    """N of 'at least N years old'; null if the text doesn't say so."""
    return F.nullif(F.regexp_extract(x, AGE % digits, 1), F.lit("")).cast("int")


def least_amount(x: Column) -> Column:
    """The least amount to be paid in, in won; null if the text doesn't say so."""
    number = F.nullif(F.regexp_replace(F.regexp_extract(x, AMOUNT, 1), ",", ""), F.lit(""))
    factor = F.lit(1)
    for word, value in UNITS.items():
        factor = F.when(F.regexp_extract(x, AMOUNT, 2) == word, F.lit(value)).otherwise(factor)
    return number.cast("long") * factor


def quoted(x: Column) -> Column:
    """All spans between single quotes."""
    return F.regexp_extract_all(x, F.lit(QUOTED), F.lit(1))


def thousands(x: Column) -> Column:
    """A whole number's digits in groups of three."""
    return F.regexp_replace(x.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")


def compact(unit: Column, preview: int = 160) -> Column:
    """A unit without references by qualified name, without lines of references to it, with long lines of a property's
    uses cut to a preview, and with single spaces and line breaks."""
    x = F.regexp_replace(unit, REFERENCE, "")
    x = F.regexp_replace(x, REFERENCES, "")
    long_line = F.transform(F.split(x, "\n"), lambda l: F.when(l.startswith("- ") & (F.length(l) > preview), F.concat(F.substring(l, 1, preview), F.lit("…"))).otherwise(l))
    x = F.when(x.startswith("[속성]"), F.array_join(long_line, "\n")).otherwise(x)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{2,}", "\n"), r"(?U)^\s+|\s+$", "")


def last_answer(x: Column, marks: str = "정답|답변|답|answer") -> Column:
    """What follows the last answer mark of a line; the whole text where there is none."""
    found = F.regexp_extract_all(x, F.lit(rf"(?im)^\s*(?:{marks})\s*[:：]\s*(.*)$"), F.lit(1))
    return F.trim(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(x))


def bare(x: Column) -> Column:
    """Lower case, without white space and punctuation, for comparing answers."""
    return F.regexp_replace(F.lower(x), r"""(?U)[\s'"“”‘’「」()\[\]{}.,;:!?·~`*_%\-]+""", "")
