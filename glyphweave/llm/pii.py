"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

E-mail addresses, telephone, card, bank account (IBAN) and social security numbers, IPv4 and IPv6 addresses and dates are found by one
pattern, validated, and permuted within their format under a key: digits give digits, letters letters of the same
case, an address four octets or eight groups, a date a date in the same notation, a number that passes the Luhn test or has right check digits another that does.
Each value is put into one canonical form first (the digits of a number, the day of a date), and the permutation works on
that: so equal values get equal pseudonyms in all documents and all notations, unlike values unlike ones. Nothing is
looked up or gathered; every row is rewritten by itself, on DataFrame functions.

A pseudonym is of its value's kind: a social security number's area, group and serial stay ones that are given out, a telephone number that starts with
2 to 9 gets one that does, and a date keeps its notation and order of day and month. Days up to the 12th are permuted among themselves and later
ones likewise, since only those tell day from month where the usual order of a notation is turned round.

Edge cases: null and empty texts stay; text without personal data stays as it is, to the letter; ties and repeated rows get equal pseudonyms;
other columns are kept, but for
those named as the counts. What fails its validation (Luhn test, check digits, calendar, octets) is left as it is, and so is a date outside the MONTHS_IN from DAY_ONE on.
Ten digits in a row are a telephone number unless they start with 0 or 1. Left as they are: the domain of an e-mail address, the country code of a telephone number
and of an account, national telephone numbers with a leading zero, nine digits in a row, accounts in lower case. Of a local part in another script each character stays within its sixteen neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphweave.llm._expr import let

KINDS = ("email", "phone", "ssn", "card", "ip", "date", "iban", "ipv6")
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:" + "|".join([*MONTHS, *[m[:3] for m in MONTHS if len(m) > 3]]) + ")"
_NTH = "(?:st|nd|rd|th)?"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?|(?<!\+)\([0-9]{3}\)[ .-]?|\+[0-9]{1,3}[ .-][0-9]{2,4}[ .-]|[0-9]{3}[.-](?=[0-9]{3}[.-][0-9]{4}(?![0-9]))|[2-9][0-9]{2}[ ](?=[0-9]{3}[ ][0-9]{4}(?![0-9]))|[2-9][0-9]{2}(?=[0-9]{7}(?![0-9A-Za-z]|[.,-][0-9])))[0-9]{3,4}[ .-]?[0-9]{3,4}",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "ip": rf"(?<![0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.[0-9])",
    "date": rf"(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?=T[0-9]{{2}}:|{_END})|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}{_END}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}{_END}|[0-9]{{1,2}}{_NTH} {_MONTH} [0-9]{{4}}{_END}|{_MONTH} [0-9]{{1,2}}{_NTH}, [0-9]{{4}}{_END})",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)",
    "ipv6": rf"(?<![:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![:.]?[0-9A-Fa-f:])",
}
#: In the order of KINDS, but card numbers last: what another kind fits is not taken for one.
PATTERN = "(?:" + "|".join(("" if k in ("email", "phone") else _EDGE) + ("(?<![0-9A-Za-z+(])" if k == "phone" else "") + PATTERNS[k] + ("" if k in ("date", "ipv6") else _END) for k in ("email", "iban", "ipv6", "phone", "ip", "date", "ssn", "card")) + ")"
ROUNDS = 8
#: Dates of this many months from DAY_ONE on: EARLY days up to the 12th, LATE ones after it, each number as the product it is permuted by.
DAY_ONE, MONTHS_IN = "1850-01-01", 3281
EARLY, LATE = (193, 204), (230, 263)
#: Areas, groups and serials of social security numbers: 898 * 99 * 9999 as two factors.
SSNS = (898 * 33, 3 * 9999)


def _prf(key: str, *parts: Column) -> Column:
    """A number below 2^48 from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("long")


def feistel_text(value: Column, key: str) -> Column:
    """Permute a string's digits and letters: ASCII ones each within its class, others of the basic plane within their sixteen neighbours; other characters stay.

    The case of ASCII letters doesn't matter to the permutation.
    """

    def shifted(half: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            move = _prf(key, r, F.lower(other), F.length(half), i)
            out = F.lit(None).cast("string")
            for low, high, start, size in (("0", "9", 48, 10), ("a", "z", 97, 26), ("A", "Z", 65, 26)):
                out = F.when((c >= low) & (c <= high), F.chr((F.ascii(c) - start + move) % size + start)).otherwise(out)
            place = F.ascii(c)
            moved = place - place % 16 + (place + move) % 16
            out = F.when((place >= 0x80) & (place < 0xD800), F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE")).otherwise(out)
            return F.coalesce(out, c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def start(v: Column) -> Column:
        n = F.greatest((F.length(v) / 2).cast("int"), F.lit(1))
        return F.struct(F.substring(v, F.lit(1), n).alias("a"), F.substring(v, n + 1, F.length(v)).alias("b"))

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    step = lambda s, r: F.when(r % 2 == 0, F.struct(shifted(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], r).alias("b")))
    return F.aggregate(rounds, let(value, start), step, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(value: Column, side: int, key: str) -> Column:
    """Permute the whole numbers below side * side."""
    begin = F.struct(F.floor(value / side).cast("long").alias("a"), (value % side).cast("long").alias("b"))
    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, begin, lambda s, r: F.struct(s["b"].alias("a"), ((s["a"] + _prf(key, r, F.lit(side), s["b"])) % side).alias("b")), lambda s: s["a"] * side + s["b"])


def feistel_pair(value: Column, a: Column | int, b: Column | int, key: str) -> Column:
    """Permute the whole numbers below a * b: rounds move the quotient and the remainder by b in turn."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    begin = F.struct(((value - value % b) / b).cast("long").alias("x"), (value % b).cast("long").alias("y"))
    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    moved = lambda at, size, r, other: ((at + _prf(key, r, size, other)) % size).cast("long")
    step = lambda s, r: F.when(r % 2 == 0, F.struct(moved(s["x"], a, r, s["y"]).alias("x"), s["y"].alias("y"))).otherwise(F.struct(s["x"].alias("x"), moved(s["y"], b, r, s["x"]).alias("y")))
    return F.aggregate(rounds, begin, step, lambda s: (s["x"] * b + s["y"]).cast("long"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def each(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(number) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(number, ""), each), F.lit(0), lambda a, x: a + x)


def _refill(form: Column, number: Column) -> Column:
    """form with its digits, in order, replaced by those of number."""
    before = lambda i: F.length(digits(F.substring(form, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when((c >= "0") & (c <= "9"), F.substring(number, before(i), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    """The check digit follows from the others, which are permuted: so Luhn numbers are permuted among themselves."""
    new = lambda d: let(feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), key + "/card"), lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _refill(m, let(digits(m), new))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the rest is permuted, numbers from 2 on among themselves and those from 0 or 1 likewise."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def new(d: Column) -> Column:
        n = F.length(d)
        high = d >= "2"
        low, many = F.when(high, 2).otherwise(0).cast("long") * ten(n - 1), F.when(high, 8).otherwise(2).cast("long")
        half = F.floor((n - 1) / 2)
        moved = feistel_pair(d.cast("long") - low, many * ten(n - 1 - half), ten(half), key + "/phone")
        return F.lpad((moved + low).cast("string"), n, F.lit("0"))

    return F.concat(code, let(rest, lambda r: _refill(r, let(digits(r), new))))


def _ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area = part(1, 3) - 1
    rank = ((area - F.when(area > 665, 1).otherwise(0)) * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1

    def written(r: Column) -> Column:
        serial, group, area = r % 9999 + 1, F.floor(r / 9999) % 99 + 1, F.floor(r / (99 * 9999)) + 1
        filled = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", filled(area + F.when(area > 665, 1).otherwise(0), 3), filled(group, 2), filled(serial, 4))

    return let(feistel_pair(rank, *SSNS, key + "/ssn"), written)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    whole = let(part, lambda p: ((F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1))) * 256 + F.get(p, F.lit(2))) * 256 + F.get(p, F.lit(3)))
    return let(feistel_number(whole, 65536, key + "/ip"), lambda n: F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]))


def feistel_hex(value: Column, key: str) -> Column:
    """Permute strings of 32 lower-case hexadecimal digits."""
    halves = F.struct(F.substring(value, 1, 16).alias("a"), F.substring(value, 17, 16).alias("b"))

    def shifted(half: Column, other: Column, r: Column) -> Column:
        pad = F.substring(F.sha2(F.concat_ws("|", F.lit(key), r.cast("string"), other), 256), 1, 16)
        number = lambda x: F.conv(x, 16, -10).cast("long")
        return F.lower(F.lpad(F.hex(number(half).bitwiseXOR(number(pad))), 16, "0"))

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, halves, lambda s, r: F.struct(s["b"].alias("a"), shifted(s["a"], s["b"], r).alias("b")), lambda s: F.concat(s["a"], s["b"]))


def _ipv6(m: Column, key: str) -> Column:
    """All eight groups in full: an address in whatever notation is one value."""
    groups = lambda x: F.transform(F.filter(F.split(x, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    sides = F.split(m, "::")
    left, right = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    whole = F.array_join(F.concat(left, F.array_repeat(F.lit("0000"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right), "")
    return let(feistel_hex(whole, key + "/ipv6"), lambda x: F.concat_ws(":", *[F.substring(x, 4 * k + 1, 4) for k in range(8)]))


def remainder97(number: Column) -> Column:
    """The remainder by 97 of a string in which letters count 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        return F.when((c >= "A") & (c <= "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(number, ""), F.lit(0), step)


def _account(m: Column) -> Column:
    """What the check digits of an account number are made from: number, country, check digits."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))


def _iban(m: Column, key: str) -> Column:
    """The country stays, the account is permuted, the check digits follow."""

    def new(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        account = feistel_text(F.substring(plain, F.lit(5), F.length(plain)), key + "/iban")
        return let(account, lambda a: F.concat(country, F.lpad((98 - remainder97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))

    spaced = lambda x: F.trim(F.regexp_replace(x, "(.{4})", "$1 "))
    return let(new(F.replace(m, F.lit(" "), F.lit(""))), lambda x: F.when(m.contains(" "), spaced(x)).otherwise(x))


def _parts(m: Column) -> Column:
    """A date with a month's name as numbers: day, month and year, parted by dots."""
    number = lambda name: F.array_position(F.array(*[F.lit(x[:3]) for x in MONTHS]), F.substring(name, 1, 3)).cast("string")
    words = F.split(F.replace(m, F.lit(","), F.lit("")), " ")
    first, second, year = (F.get(words, F.lit(k)) for k in range(3))
    day, month = F.when(m.rlike("^[0-9]"), first).otherwise(second), F.when(m.rlike("^[0-9]"), second).otherwise(first)
    return F.when(m.rlike("[a-z]"), F.concat_ws(".", digits(day), number(month), year)).otherwise(m)


def _read(m: Column) -> Column:
    """(month: its number from DAY_ONE's on, day, turned) of a date; null if it is none or out of range.

    Year first if it stands first, else day first if dots or hyphens part it and month first if strokes do; turned: the other order, where only that is a date.
    """

    def read(p: Column) -> Column:
        num = lambda k: F.get(p, F.lit(k)).cast("int")
        iso, dots = F.length(F.get(p, F.lit(0))) == 4, ~m.contains("/")
        year = F.when(iso, num(0)).otherwise(num(2))
        turned = ~iso & F.when(dots, num(1) > 12).otherwise(num(0) > 12)
        month_first = ~iso & (dots == turned)
        month = F.when(iso, num(1)).when(month_first, num(0)).otherwise(num(1))
        day = F.when(iso, num(2)).when(month_first, num(1)).otherwise(num(0))
        at = (year - 1850) * 12 + month - 1
        ok = month.between(1, 12) & (day >= 1) & at.between(0, MONTHS_IN - 1)
        days = F.when(ok, F.day(F.last_day(F.make_date(year, month, F.lit(1)))))
        return F.when(day <= days, F.struct(at.alias("month"), day.alias("day"), turned.alias("turned")))

    return let(F.split(_parts(m), "[./-]"), read)


def _month_start(month: Column) -> Column:
    """Days from DAY_ONE to a month's first, without the first twelve of each month before it."""
    return F.datediff(F.add_months(F.lit(DAY_ONE).cast("date"), month), F.lit(DAY_ONE).cast("date")) - 12 * month


def _moved(read: Column, key: str) -> Column:
    """The date that a date turns into."""
    early = feistel_pair((read["month"] * 12 + read["day"] - 1).cast("long"), *EARLY, key + "/date")
    late = feistel_pair((_month_start(read["month"]) + read["day"] - 13).cast("long"), *LATE, key + "/date")
    date = lambda month, day: F.date_add(F.add_months(F.lit(DAY_ONE).cast("date"), month.cast("int")), (day - 1).cast("int"))

    def found(rank: Column) -> Column:
        # a month has 18.4 late days on average, and no month is off by more than one
        near = F.floor(rank * MONTHS_IN / (LATE[0] * LATE[1])).cast("int")
        month = F.when(_month_start(near + 1) <= rank, near + 1).when(_month_start(near) <= rank, near).otherwise(near - 1)
        return let(month, lambda k: date(k, rank - _month_start(k) + 13))

    return F.when(read["day"] <= 12, let(early, lambda r: date(F.floor(r / 12), r % 12 + 1))).otherwise(let(late, found))


def _date(m: Column, key: str) -> Column:
    def written(x: Column) -> Column:
        turned, to = x["turned"], x["to"]
        form = lambda f: F.date_format(to, f)
        day = F.day(to)
        nth = F.when(m.rlike("[0-9](?:st|nd|rd|th)"), F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")).otherwise("")
        name = F.when(m.rlike("[A-Za-z]{4}"), form("MMMM")).when(m.contains("May"), form("MMMM")).otherwise(form("MMM"))
        numbers = [(r"^[0-9]{4}-", "yyyy-MM-dd", ""), ("^[0-9]{4}/", "yyyy/MM/dd", ""), (r"\.", "dd.MM.yyyy", "MM.dd.yyyy"), ("-", "dd-MM-yyyy", "MM-dd-yyyy"), ("/", "MM/dd/yyyy", "dd/MM/yyyy")]
        out = F.when(m.rlike("^[0-9]"), F.concat(form("d"), nth, F.lit(" "), name, form(" yyyy"))).otherwise(F.concat(name, form(" d"), nth, form(", yyyy")))
        for pattern, plain, other in reversed(numbers):
            out = F.when(m.rlike(pattern), F.when(turned, form(other)).otherwise(form(plain)) if other else form(plain)).otherwise(out)
        return out

    return let(_read(m), lambda r: let(F.struct(r["turned"].alias("turned"), _moved(r, key).alias("to")), written))


def _kind(m: Column) -> Column:
    """The kind of a match; none where a card number fails the Luhn test, an account its check digits, or a date is no date."""
    valid = {"date": _read(m).isNotNull(), "iban": remainder97(_account(m)) == 1}
    out = F.when(luhn(digits(m)) % 10 == 0, F.lit("card")).otherwise("none")
    for k in ("ssn", "date", "ip", "phone", "ipv6", "iban", "email"):
        out = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.when(valid[k], F.lit(k)).otherwise("none") if k in valid else F.lit(k)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    email = F.concat(feistel_text(F.substring_index(m, "@", 1), key + "/email"), F.lit("@"), F.substring_index(m, "@", -1))
    return F.when(kind == "email", email).when(kind == "phone", _phone(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "date", _date(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "card", _card(m, key)).when(kind == "iban", _iban(m, key)).when(kind == "ipv6", _ipv6(m, key)).otherwise(m)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten, and n_<kind> (long) for each kind found."""
    counts = [f"n_{k}" for k in KINDS]
    found = F.when(F.col("text").rlike(PATTERN), F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    new = F.transform(found, lambda m: let(_kind(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("new"))))
    marked = docs.withColumn("__found", new)
    text = F.zip_with(F.split("text", PATTERN), "__found", lambda piece, m: F.concat(piece, F.coalesce(m["new"], F.lit(""))))
    kept = [F.when(F.size("__found") > 0, F.array_join(text, "")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in counts]
    count = lambda k: F.size(F.filter("__found", lambda x: x["kind"] == k)).cast("long")
    return marked.select(*kept, *[count(k).alias(f"n_{k}") for k in KINDS])
