"""PII: format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions alone.

Numbers that pass their own check (card digits by Luhn, IBANs by modulo 97, octets, phone and social-security formats)
and dates that exist are permuted within their format under a key: a valid value becomes another valid value, equal
values become equal pseudonyms in every document, and nobody without the key can turn them back. E-mail names and
hexadecimal secrets have no number to permute; names get keyed digests of 20 to 64 letters, secrets of their own length.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table

#: Characters of an IBAN by country. Lengths keep a capital word or an amount that follows out of it.
IBAN_LENGTHS: dict[int, str] = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """By country; else groups of digits; else, where letters may be words that follow, letters and digits in one piece."""
    forms = []
    for size, countries in IBAN_LENGTHS.items():
        whole, rest = divmod(size - 4, 4)
        last = f"(?: ?[0-9A-Z]{{{rest}}})" if rest else ""
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{whole}}}{last}(?![0-9A-Za-z])")
    forms += ["[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![0-9A-Za-z])"]
    return f"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})"


#: Kinds in the order in which they are tried at a place. Java patterns; none has a capturing group.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])",
    "iban": _iban_pattern(),
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "intl": r"(?<![0-9A-Za-z+])\+[0-9](?:[ .-]?[0-9]){8,14}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|[.-][0-9])",
}
ANY = r"(?<![0-9A-Za-z])(?=[\p{L}\p{N}+(._%-])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Every kind holds one of these.
HINT = r"[0-9]|@|[A-Fa-f]{32}"
ROUNDS = 8


def _part(key: Column, kind: Column, i: Column, half: Column, size: Column) -> Column:
    """A keyed number below size from one half of a value."""
    digest = F.sha2(F.concat_ws("|", key, kind, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def feistel_halves(a: Column, b: Column, left: Column, right: Column, key: Column, kind: str | Column) -> Column:
    """A keyed permutation of the pairs a < left, b < right (structs a, b): alternating rounds add to one half a number from
    the other. `kind` keeps permutations of different formats apart."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def turn(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        new_a = F.when(even, (x["a"] + _part(key, kind, i, x["b"], left)) % left).otherwise(x["a"])
        new_b = F.when(even, x["b"]).otherwise((x["b"] + _part(key, kind, i, x["a"], right)) % right)
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def feistel(value: Column, left: Column, right: Column, key: Column, kind: str | Column) -> Column:
    """A keyed permutation of the numbers below left * right."""
    out = feistel_halves(F.call_function("div", value, right), value % right, left, right, key, kind)
    return _once(out, lambda x: x["a"] * right + x["b"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k) for k in range(19)]), (n + 1).cast("int"))


def _permuted_digits(digits: Column, key: Column, kind: str | Column) -> Column:
    """Another digit string of the same length (at most 36): both halves of at most 18 digits are permuted together."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    half = lambda text: F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).cast("long")
    out = feistel_halves(half(F.substr(digits, F.lit(1), n - low)), half(F.substr(digits, n - low + 1, low)), _power(n - low), _power(low), key, kind)
    spelt = lambda x: F.concat(F.lpad(x["a"].cast("string"), n - low, "0"), F.when(low > 0, F.lpad(x["b"].cast("string"), low, "0")).otherwise(""))
    return F.when(n > 0, _once(out, spelt)).otherwise("")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where a value that is used often, or in a fold, is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _laid_out(m: Column, digits: Column, letters: Column | None = None) -> Column:
    """New digits, and capital letters if given, in the places of the old ones; all other characters stay."""
    chars = F.split(m, "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"), F.lit(1).alias("j"))

    def put(new: Column, x: Column, c: Column) -> Column:
        digit, letter = c.rlike("^[0-9]$"), F.lit(False) if letters is None else c.rlike("^[A-Z]$")
        out = F.when(digit, F.substr(new["digits"], x["i"], F.lit(1))).when(letter, F.substr(new["letters"], x["j"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(x["s"], out).alias("s"), (x["i"] + digit.cast("int")).alias("i"), (x["j"] + letter.cast("int")).alias("j"))

    both = F.struct(digits.alias("digits"), (F.lit("") if letters is None else letters).alias("letters"))
    return _once(both, lambda new: F.aggregate(chars, start, lambda x, c: put(new, x, c), lambda x: x["s"]))


def luhn_sum(digits: Column) -> Column:
    """The sum of a digit string by Luhn, where the last digit isn't doubled."""
    turned = F.split(F.reverse(digits), "")

    def one(d: Column, i: Column) -> Column:
        doubled = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.transform(turned, one), F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    body = _permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, _laid_out(m, F.concat(body, check.cast("string")))).otherwise(m)


def _remainder97(text: Column) -> Column:
    """The remainder by 97 of a number whose letters stand for 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _letters_value(letters: Column) -> Column:
    """Capital letters (at most 13) as a number of base 26; no letters are 0."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 65)


def _letters_power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(26**i) for i in range(14)]), (n + 1).cast("int"))


def _spelt(value: Column, n: Column) -> Column:
    """A number as n capital letters."""
    places = F.filter(F.sequence(n - 1, F.lit(-1)), lambda i: i >= 0)
    return F.array_join(F.transform(places, lambda i: F.char((F.call_function("div", value, _letters_power(i)) % 26 + 65).cast("long"))), "")


def _permuted_letters(letters: Column, key: Column, kind: Column) -> Column:
    """Another string of capital letters of the same length: both halves (of at most 13) are permuted together, and beyond 26
    letters the rest by itself, under the new ones."""

    def two_halves(text: Column, kind: Column) -> Column:
        n = F.length(text)
        low = F.floor(n / 2).cast("int")
        a, b = F.substr(text, F.lit(1), n - low), F.substr(text, n - low + 1, low)
        out = feistel_halves(_letters_value(a), _letters_value(b), _letters_power(n - low), _letters_power(low), key, kind)
        return F.when(n > 0, _once(out, lambda x: F.concat(_spelt(x["a"], n - low), _spelt(x["b"], low)))).otherwise("")

    first, rest = F.substr(letters, F.lit(1), F.lit(26)), F.substr(letters, F.lit(27), F.lit(26))
    return F.when(F.length(letters) > 0, _once(two_halves(first, kind), lambda new: F.concat(new, two_halves(rest, F.concat_ws("|", kind, new))))).otherwise("")


def _iban(m: Column, key: Column) -> Column:
    """The account is permuted as a whole: its digits under its letters and country, its letters under the new digits."""
    joined = F.regexp_replace(m, " ", "")
    country, check = F.substr(joined, F.lit(1), F.lit(2)), F.substr(joined, F.lit(3), F.lit(2))
    account = F.substr(joined, F.lit(5), F.length(joined) - 4)
    digits, letters = _digits(account), F.regexp_replace(account, "[^A-Z]", "")
    new_digits = _permuted_digits(digits, key, F.concat_ws("|", F.lit("iban"), country, letters))
    both = _once(new_digits, lambda d: F.struct(d.alias("digits"), _permuted_letters(letters, key, F.concat_ws("|", F.lit("iban letters"), country, d)).alias("letters")))
    valid = _remainder97(F.concat(account, country, check)) == 1

    def put(new: Column) -> Column:
        laid_out = _laid_out(account, new["digits"], new["letters"])
        new_check = F.lpad((98 - _remainder97(F.concat(laid_out, country, F.lit("00")))).cast("string"), 2, "0")
        return _laid_out(m, F.concat(new_check, new["digits"]), F.concat(country, new["letters"]))

    return F.when(valid, _once(both, put)).otherwise(m)


def _ip(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel(value, F.lit(65536), F.lit(65536), key, "ip")
    text = F.concat_ws(".", *[(F.floor(new / (256**k)) % 256).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.forall(octets, lambda x: x <= 255), text).otherwise(m)


#: Years whose dates are permuted among themselves, with their numbers of days as products. A full cycle of the Gregorian
#: calendar, as from 1798 to 2197, has 146097 days; the ends of the years that four digits can write are shorter.
_ERAS = {(1, 197): (133, 541), (198, 9797): (27, 5411), (9798, 9999): (74, 997)}
#: Of these days the ones from the 13th of a month on: their number as a product.
_LATE_DAYS = {(1, 197): (115, 379), (198, 9797): (9, 9833), (9798, 9999): (205, 218)}


def _first_day(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def _era(year: Column) -> Column:
    """(first year, and factors of its numbers of days and of late days) of the era of a year from 1 to 9999."""
    out = None
    for (low, high), factors in _ERAS.items():
        first = F.lit(low) if high - low < 400 else (low + F.floor((year - low) / 400) * 400).cast("int")
        numbers = zip(("left", "right", "late_left", "late_right"), (*factors, *_LATE_DAYS[low, high]))
        era = F.struct(first.alias("first"), *[F.lit(x).alias(n) for n, x in numbers])
        out = F.when(year.between(low, high), era) if out is None else out.when(year.between(low, high), era)
    return out


def _moved_day(day: Column, key: Column) -> Column:
    """Another day of the same era."""

    def move(e: Column) -> Column:
        n = F.datediff(day, _first_day(e["first"])).cast("long")
        return F.date_add(_first_day(e["first"]), feistel(n, e["left"], e["right"], key, F.concat_ws("|", F.lit("date"), e["first"].cast("string"))).cast("int"))

    return _once(_era(F.year(day)), move)


def _moved_late_day(day: Column, key: Column) -> Column:
    """Another day of the same era, both from the 13th of a month on. Such days are numbered by leaving out twelve days of
    every month; back from a number, the month is guessed from the average and set right."""

    def move(e: Column) -> Column:
        start = _first_day(e["first"])
        months = (F.year(day) - e["first"]) * 12 + F.month(day) - 1
        n = (F.datediff(day, start) - 12 * months - 12).cast("long")
        new = feistel(n, e["late_left"], e["late_right"], key, F.concat_ws("|", F.lit("late date"), e["first"].cast("string")))

        def day_of(x: Column) -> Column:
            guess = F.floor(x / 18.436875).cast("int")
            before = lambda m: F.datediff(F.add_months(start, m), start) - 12 * m
            month = F.array_max(F.filter(F.transform(F.sequence(F.greatest(guess - 1, F.lit(0)), guess + 1), lambda m: F.when(before(m) <= x, m)), lambda m: m.isNotNull()))
            return _once(month, lambda m: F.date_add(F.add_months(start, m), (x - before(m) + 12).cast("int")))

        return _once(new, day_of)

    return _once(_era(F.year(day)), move)


def _date(m: Column, key: Column) -> Column:
    def one(pattern: str, move: Callable[[Column, Column], Column]) -> Column:
        return F.date_format(move(F.try_to_date(m, pattern), key), pattern)

    # a date with slashes is day first where it can be; 02/13/2024 can only be month first, and is permuted among those alone,
    # so that no two dates get one pseudonym
    return F.coalesce(
        F.when(m.rlike("^[0-9]{4}-"), one("yyyy-MM-dd", _moved_day)),
        F.when(m.contains("."), one("dd.MM.yyyy", _moved_day)),
        F.when(m.contains("/"), F.coalesce(one("dd/MM/yyyy", _moved_day), one("MM/dd/yyyy", _moved_late_day))),
        m,
    )


def _ssn(m: Column, key: Column) -> Column:
    digits = _digits(m)
    valid = ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    # areas 001-665 and 667-899, groups 01-99 and serials 0001-9999 are permuted as one number
    area = F.substr(digits, F.lit(1), F.lit(3)).cast("long")
    rank = F.when(area > 666, area - 2).otherwise(area - 1) * (99 * 9999) + (F.substr(digits, F.lit(4), F.lit(2)).cast("long") - 1) * 9999 + F.substr(digits, F.lit(6), F.lit(4)).cast("long") - 1
    new = feistel(rank, F.lit(898 * 99), F.lit(9999), key, "ssn")
    new_area = F.floor(new / (99 * 9999)) + 1
    text = F.concat(
        F.lpad(F.when(new_area >= 666, new_area + 1).otherwise(new_area).cast("string"), 3, "0"),
        F.lit("-"),
        F.lpad((F.floor(new / 9999) % 99 + 1).cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad((new % 9999 + 1).cast("string"), 4, "0"),
    )
    return F.when(valid, text).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    # the country code stays, the last ten digits (seven to ten in other layouts) are permuted
    kept = F.when(m.startswith("+"), F.greatest(n - 10, F.least(n - 7, F.lit(2)))).otherwise(n - 10).cast("int")
    new = _permuted_digits(F.substr(digits, kept + 1, n - kept), key, "phone")
    return F.when(n.between(9, 15), _laid_out(m, F.concat(F.substr(digits, F.lit(1), kept), new))).otherwise(m)


def _email(m: Column, key: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    digest = F.translate(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), "0123456789", "ghijklmnop")
    return F.concat(F.substr(digest, F.lit(1), F.least(F.greatest(F.length(name), F.lit(20)), F.lit(64))), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit("secret"), F.lower(m)), 256)
    more = F.ceil(F.length(m) / F.lit(64)).cast("int")
    long = F.aggregate(  # one digest for every 64 digits, each of the one before
        F.sequence(F.lit(1), more), F.struct(F.lit("").alias("all"), digest.alias("next")), lambda s, _: F.struct(F.concat(s["all"], s["next"]).alias("all"), F.sha2(F.concat_ws("|", key, s["next"]), 256).alias("next")), lambda s: s["all"]
    )
    cut = F.substr(long, F.lit(1), F.length(m))
    return F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(cut)).otherwise(cut)


PSEUDONYMS: dict[str, Callable[[Column, Column], Column]] = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "intl": _phone, "card": _card,
}


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one found value; values that don't pass their check stay."""
    out = None
    for kind, pattern in PATTERNS.items():
        whole = m.rlike(f"^(?:{pattern})$")
        out = F.when(whole, PSEUDONYMS[kind](m, key)) if out is None else out.when(whole, PSEUDONYMS[kind](m, key))
    return out.otherwise(m)


def pseudonymise(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces private values in a text column by pseudonyms and adds n_private, how many were replaced.

    A null text stays null with n_private 0; empty texts and texts without private values stay as they are. Whole texts
    are searched. Other columns, rows and repeated rows stay; a clashing column n_private is replaced.
    """
    columns = [c for c in documents.columns if c != "n_private"]
    secret = F.lit(key)
    some = F.col(text).rlike(HINT)
    cut = documents.select(*columns, F.when(some, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias("_found"))
    cut = cut.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, secret))))
    between = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, "_new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    new = F.when(F.col("_new").isNotNull(), joined).otherwise(F.col(text))
    return cut.select(*[new.alias(c) if c == text else F.col(c) for c in columns], F.when(F.col("_new").isNotNull(), changed).otherwise(0).cast("long").alias("n_private"))


#: For the query, that is for tests and measurements alone.
EXAMPLE_KEY = "an example key"
#: Where a production run puts its key; without one each application makes its own.
KEY_SETTING = "spark.lexspark.pii.key"
_made: dict[str, str] = {}


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in their texts."""
    return pseudonymise(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in their texts; n_chars follows the new text.

    The key is the session's setting spark.lexspark.pii.key. Where that is unset a random key is made once for the
    application, so that nobody can turn the pseudonyms back; its runs link values alike, and those of other applications
    differ. Null and empty texts stay as they are, repeated rows get equal texts, other columns stay.
    """
    columns = docs.columns
    key = spark.conf.get(KEY_SETTING, None) or _made.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    done = pseudonymise(docs, key)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(columns)
