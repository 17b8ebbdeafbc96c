"""Operator 4: format-preserving Feistel pseudonyms for personal data, in SQL functions alone.

Numbers and dates that pass validation are permuted within their own format by a keyed
Feistel network: card numbers stay card numbers of the same length with a right check digit, phone numbers
keep country code and punctuation, addresses stay addresses, dates stay dates. The network
alternates two halves of mixed size a * b, so it permutes exactly the values of the format
and equal values stay linked across documents, whatever their spelling; a national phone number is
linked with the same number after any country code. The round function is a
keyed SHA-256. Mail addresses, which have no numeric format, get keyed digests as names.

Kinds: email; phone (10 to 15 digits with a country code, or a national number of ten digits
with separators); ip (four octets up to 255); date (ISO, or day and month by slashes or dots, 1700 to 2099);
ssn (issued ranges only); card (13 to 19 digits, right check digit). What fails validation stays as it is.

Null texts stay null and count nothing, empty texts stay empty; ids may be null or repeat.
An empty table gives no rows. The working columns have names of their own, so no others clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "ip", "date", "ssn", "card")
ROUNDS = 6

#: What may be personal data, by form; validation follows.
PATTERN = "|".join(
    (
        r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}+)++",  # possessive: the matcher loops and needs no stack
        r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\w])",
        r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
        r"(?<![\w./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w]|-[0-9])",
        r"(?<![\w./-])[0-9]{2}([/.])[0-9]{2}\1[0-9]{4}(?![\w]|[/.-][0-9])",
        r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|-[0-9])",
        r"(?<![\w+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w]|-[0-9])",
        r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[-][0-9])",
    )
)


#: The country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def digest_number(*parts: Column) -> Column:
    """60 bits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, label: str) -> Column:
    """A keyed permutation of the integers from 0 to a * b - 1 (a and b at most 10**10)."""
    start = F.struct(F.call_function("div", value, b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(digest_number(F.lit(key), F.lit(label), i, a, b, s["r"]), a), a)
        right = F.pmod(s["r"] + F.pmod(digest_number(F.lit(key), F.lit(label), i, a, b, s["l"]), b), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)]), start, turn, lambda s: s["l"] * b + s["r"])


def power_of_ten(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute_digits(digits: Column, key: str, label: str) -> Column:
    """A string of up to 18 digits to another of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), power_of_ten(half), power_of_ten(n - half), key, label).cast("string"), n, F.lit("0"))


def digit_sum(digits: Column) -> Column:
    """The check sum of a card number whose last digit is the check digit."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced in turn by `digits`."""

    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        seen = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.between("0", "9"), F.substring(digits, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(x: Column) -> Column:
    """The kind of a match of PATTERN if it is valid, else null."""
    digits = only_digits(x)
    octets = F.forall(F.split(x, r"\."), lambda o: (o.try_cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))
    issued = ~x.rlike("^(000|666|9)") & ~x.rlike("-00-") & ~x.rlike("-0000$")
    day = date_of(x)
    return (
        F.when(x.contains("@"), "email")
        .when(x.startswith("+"), F.when(F.length(digits).between(10, 15), "phone"))
        .when(x.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.when(octets, "ip"))
        .when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$"), F.when(day.between("1700-01-01", "2099-12-31"), "date"))
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(issued, "ssn"))
        .when(F.length(digits) == 10, "phone")
        .when(F.length(digits) >= 13, F.when(F.pmod(digit_sum(digits), F.lit(10)) == 0, "card"))
    )


def date_of(x: Column) -> Column:
    """Day first, month first only where day first is no date."""
    plain = F.regexp_replace(x, r"\.", "/")
    return F.when(x.contains("-"), F.try_to_date(x, "yyyy-MM-dd")).otherwise(F.coalesce(F.try_to_date(plain, "dd/MM/yyyy"), F.try_to_date(plain, "MM/dd/yyyy")))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    digits = only_digits(x)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    payload = permute_digits(body, key, "card")
    check = F.pmod(10 - F.pmod(digit_sum(F.concat(payload, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = refill(x, F.concat(payload, check))

    length = F.when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(TWO_DIGIT_CODES), 2).otherwise(3)
    code = F.when(x.startswith("+"), length).otherwise(0)
    code = F.when(F.length(digits) - code >= 7, code).otherwise(1)
    phone = refill(x, F.concat(F.substring(digits, F.lit(1), code), permute_digits(F.substring(digits, code + 1, F.length(digits)), key, "phone")))

    o = F.transform(F.split(x, r"\."), lambda v: v.try_cast("long"))
    byte = [F.get(o, i) for i in range(4)]
    address = feistel(((byte[0] * 256 + byte[1]) * 256 + byte[2]) * 256 + byte[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    ip = F.array_join(F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda s: F.pmod(F.call_function("shiftright", address, s), F.lit(256)).cast("string")), ".")

    # 146097 days, 1700 to 2099, are 189 * 773
    first = F.lit("1700-01-01").cast("date")
    day = F.date_add(first, feistel(F.datediff(date_of(x), first).cast("long"), F.lit(189).cast("long"), F.lit(773).cast("long"), key, "date").cast("int"))
    spelled = F.when(x.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(x.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))

    # areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999
    area = F.substring(digits, 1, 3).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    number = (area * 99 + F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1
    moved = feistel(number, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")
    site = F.call_function("div", moved, F.lit(9999).cast("long"))
    place = F.call_function("div", site, F.lit(99).cast("long")) + 1
    place = place + F.when(place >= 666, 1).otherwise(0)
    ssn = F.concat_ws(
        "-", F.lpad(place.cast("string"), 3, "0"), F.lpad((F.pmod(site, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(moved, F.lit(9999)) + 1).cast("string"), 4, "0")
    )

    name, host = F.substring_index(F.lower(x), "@", 1), F.substring_index(F.lower(x), "@", -1)
    mail = F.concat(
        F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), name), 256), 1, 12), F.lit("@h"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), host), 256), 1, 8), F.lit(".example")
    )
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "date", spelled).when(kind == "ssn", ssn).when(kind == "email", mail).otherwise(x)


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with its text rewritten and a column n_<kind> for each kind. No shuffle, no Python.

    Columns named n_<kind> or starting with _pii are replaced.
    """
    text = F.col(text_col)
    # few rows hold anything: the costly part is skipped for the others
    may = F.coalesce(text.rlike("[0-9@]") & text.rlike(PATTERN), F.lit(False))
    none = F.array().cast("array<struct<value:string,kind:string>>")
    found = F.when(may, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda x: F.struct(x.alias("value"), kind_of(x).alias("kind")))).otherwise(none)
    step = docs.withColumn("_pii", found)
    hit = F.exists("_pii", lambda x: x["kind"].isNotNull())
    gaps = F.split(text, PATTERN, -1)
    new = F.transform("_pii", lambda x: pseudonym(x["value"], x["kind"], key))
    pieces = F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    step = step.withColumn(text_col, F.when(hit, F.array_join(pieces, "")).otherwise(text))

    def count(kind: str) -> Column:
        return F.size(F.filter("_pii", lambda x: x["kind"] == kind)).cast("long")

    return step.withColumns({f"n_{kind}": count(kind) for kind in KINDS}).drop("_pii")
