"""Format-preserving pseudonyms for personal data.

Numbers, dates, addresses and secrets that pass validation are replaced by values
of the same format, chosen by a keyed Feistel permutation: equal values get equal
pseudonyms in every document, different values different ones, and the holder of
the key can undo it. Only SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feistel rounds; even, so that both halves end where they began.
ROUNDS = 8
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()

_EDGE = r"(?<![0-9A-Za-z_])"
_END = r"(?![0-9A-Za-z_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What is looked for; the first that fits at a place counts.
KINDS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": _EDGE + r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})" + _END,
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + _END,
    "ip": r"(?<![0-9A-Za-z_.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z_]|\.[0-9])",
    "date": _EDGE + r"(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2})" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![0-9A-Za-z_+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _END + r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}" + _END,
    "number": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
}
_ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days that dates are permuted among: 1900-01-01 to 2099-12-31, 319 * 229.
FIRST_DAY, DAY_FACTORS = "1900-01-01", (319, 229)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _round_bytes(key: str, tweak: str, round_: Column, half: Column) -> Column:
    """128 hexadecimal digits from the key, the kind of value, the round and the other half."""
    return F.sha2(F.concat(F.lit(f"{key}\x1f{tweak}\x1f"), round_.cast("string"), F.lit("\x1f"), half), 512)


def _round_number(key: str, tweak: str, round_: Column, half: Column, size: int) -> Column:
    return F.conv(F.substring(_round_bytes(key, tweak, round_, half.cast("string")), 1, 12), 16, 10).cast("long") % size


def _shift(text: Column, digest: Column, alphabets: list[str]) -> Column:
    """Move every character within its alphabet by one byte of the digest; others stay."""

    def one(i: Column, digest: Column) -> Column:
        char = F.substr(text, i, F.lit(1))
        by = F.conv(F.substr(digest, F.pmod((i - 1) * 2, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")
        moved = char
        for alphabet in alphabets:
            place = F.instr(F.lit(alphabet), char)
            moved = F.when(place > 0, F.substr(F.lit(alphabet), F.pmod(place - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(moved)
        return moved

    moved = _let(digest, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: one(i, d)), ""))
    return F.when(F.length(text) > 0, moved).otherwise("")


def permute_text(text: Column, key: str, tweak: str, alphabets: list[str]) -> Column:
    """Feistel permutation of the strings of this length and pattern of alphabets."""
    return _let(text, lambda t: _permute_text(t, key, tweak, alphabets))


def _permute_text(text: Column, key: str, tweak: str, alphabets: list[str]) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))
    ended = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, r: F.struct(s["b"].alias("a"), _shift(s["a"], _round_bytes(key, tweak, r, s["b"]), alphabets).alias("b"))
    )
    return _let(ended, lambda s: F.concat(s["a"], s["b"]))


def _pairs(a: Column, b: Column, key: str, tweak: str, sizes: tuple[int, int]) -> Column:
    """Feistel permutation of pairs of numbers below ``sizes``; both change in a round."""

    def turn(s: Column, r: Column) -> Column:
        left = (s["a"] + _round_number(key, tweak + "a", r, s["b"], sizes[0])) % sizes[0]
        right = (s["b"] + _round_number(key, tweak + "b", r, left, sizes[1])) % sizes[1]
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _refill(value: Column, active: str, chars: Column) -> Column:
    """Put ``chars`` in order at the places of ``value`` that match ``active``."""

    def one(i: Column, chars: Column) -> Column:
        here = F.substr(value, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{active}]", ""))
        return F.when(here.rlike(f"[{active}]"), F.substr(chars, nth, F.lit(1))).otherwise(here)

    return _let(chars, lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: one(i, c)), ""))


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum of all digits; the first doubled one counts from the right end, at 0 or 1."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == doubled_from_right, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _number(value: Column, key: str) -> Column:
    """A number that passes the Luhn test gets one that passes it too."""

    def card(digits: Column) -> Column:
        body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", [DIGITS])
        return _let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string")))

    def any_(digits: Column) -> Column:
        return F.when(_luhn_sum(digits, 1) % 10 == 0, card(digits)).otherwise(permute_text(digits, key, "number", [DIGITS]))

    return _refill(value, "0-9", _let(F.regexp_replace(value, "[^0-9]", ""), any_))


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[^0-9])|\+[0-9])?", 0)
    digits = lambda rest: permute_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone", [DIGITS])
    return F.concat(code, _let(F.substr(value, F.length(code) + 1, F.length(value)), lambda rest: _refill(rest, "0-9", digits(rest))))


def _ip(value: Column, key: str) -> Column:
    part = lambda k: F.split_part(value, F.lit("."), F.lit(k)).cast("long")
    made = _pairs(part(1) * 256 + part(2), part(3) * 256 + part(4), key, "ip", (65536, 65536))
    octets = lambda s: F.concat_ws(".", *[x for h in ("a", "b") for x in (F.floor(s[h] / 256).cast("string"), (s[h] % 256).cast("string"))])
    return _let(made, octets)


def _date(value: Column, key: str) -> Column:
    """A day that the calendar lacks, as 30 February, stays as it is."""
    iso = F.substr(value, F.lit(5), F.lit(1)) == "-"
    sep = F.when(iso, F.lit("-")).otherwise(F.substr(value, F.lit(3), F.lit(1)))
    year = F.when(iso, F.substr(value, F.lit(1), F.lit(4))).otherwise(F.substr(value, F.lit(7), F.lit(4)))
    month = F.when(iso, F.substr(value, F.lit(6), F.lit(2))).otherwise(F.substr(value, F.lit(4), F.lit(2)))
    day = F.when(iso, F.substr(value, F.lit(9), F.lit(2))).otherwise(F.substr(value, F.lit(1), F.lit(2)))
    parsed = F.concat_ws("-", year, month, day).try_cast("date")
    made = _let(F.datediff(parsed, F.lit(FIRST_DAY).cast("date")), lambda n: _pairs(F.floor(n / DAY_FACTORS[1]), n % DAY_FACTORS[1], key, "date", DAY_FACTORS))

    def written(new: Column) -> Column:
        other = F.concat_ws("", F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(other)

    day_of = lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAY_FACTORS[1] + s["b"]).cast("int"))
    return F.when(parsed.isNull(), value).otherwise(_let(_let(made, day_of), written))


def _iban_remainder(value: Column) -> Column:
    """The account number and country as a number modulo 97, digit by digit."""

    def add(total: Column, i: Column) -> Column:
        char = F.substr(value, F.pmod(i + 3, F.length(value)) + 1, F.lit(1))
        return F.when(char.rlike("[0-9]"), (total * 10 + char.try_cast("int")) % 97).otherwise((total * 100 + F.ascii(char) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    """Check digits are made anew; what fails the check is no account number and stays."""
    country = F.substr(value, F.lit(1), F.lit(2))
    body = permute_text(F.substr(value, F.lit(5), F.length(value)), key, "iban", [DIGITS, UPPER])
    whole = lambda b: F.concat(country, F.lpad((F.lit(98) - _iban_remainder(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b)
    return F.when(_iban_remainder(value) == 1, _let(body, whole)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """Local part and domain name are permuted within letters and digits; the top-level domain stays."""
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    chars = lambda rest: permute_text(F.regexp_replace(rest, "[^A-Za-z0-9]", ""), key, "email", [DIGITS, LOWER, UPPER])
    return F.concat(_let(F.substr(value, F.lit(1), F.length(value) - F.length(top)), lambda rest: _refill(rest, "A-Za-z0-9", chars(rest))), top)


def _secret(value: Column, key: str) -> Column:
    lower = permute_text(value, key, "secret", ["0123456789abcdef"])
    return F.when(value.rlike("[a-f]"), lower).otherwise(permute_text(value, key, "secret", ["0123456789ABCDEF"]))


_MAKE: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "secret": _secret,
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "ssn": lambda value, key: _refill(value, "0-9", permute_text(F.regexp_replace(value, "[^0-9]", ""), key, "ssn", [DIGITS])),
    "phone": _phone,
    "number": _number,
}


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    out = value
    for name, make in _MAKE.items():
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", into: str = "pseudonymised", counts: str = "pii_counts") -> DataFrame:
    """Add ``into``, the text with pseudonyms, and ``counts``, a map from kind to how many values were replaced.

    A null text stays null with no counts, an empty one empty. All rows and columns
    stay; names of results that exist already are refused. Values inside longer words
    or numbers are left alone, as are dates that no calendar has and account numbers
    with wrong check digits.
    """
    clash = {into, counts} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; name others with into= and counts=")
    text = F.col(text_col)
    pattern = F.lit(_ANY)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    made = F.transform("_found", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("old"), pseudonym(m["value"], m["kind"], key).alias("new")))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, _ANY, -1), F.col("_made.new"), lambda piece, new: F.array(piece, new))), "")
    own = docs.columns
    # most texts hold neither digit nor @, and need no search
    busy = docs.withColumn("_found", F.when(text.rlike("[0-9@]"), found))
    done = busy.withColumn("_made", F.when(F.size("_found") > 0, made))
    number = lambda kind: F.size(F.filter("_made", lambda m: (m["kind"] == kind) & ~m["old"].eqNullSafe(m["new"])))
    table = F.create_map(*[x for kind in KINDS for x in (F.lit(kind), F.when(F.col("_made").isNull(), F.lit(0)).otherwise(number(kind)))])
    return done.select(*[F.col(f"`{c}`") for c in own], F.when(F.col("_made").isNull(), text).otherwise(joined).alias(into), F.map_filter(table, lambda _, n: n > 0).alias(counts))
