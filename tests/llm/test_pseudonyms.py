"""Pseudonyms against a plain Feistel network in Python."""

import datetime
import hashlib

import regex

from glyphweave.llm import pii

KEY = "k"
WHOLE = regex.compile(pii.PATTERN)


def prf(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:12], 16)


def lower(x):
    return x.lower()


def feistel_text(value, key):
    n = max(len(value) // 2, 1)
    a, b = value[:n], value[n:]

    def shifted(half, other, r):
        out = ""
        for i, c in enumerate(half):
            move, p = prf(key, r, lower(other), len(half), i), ord(c)
            for low, size in ((48, 10), (97, 26), (65, 26)):
                if low <= p < low + size:
                    c = chr(low + (p - low + move) % size)
            if 0x80 <= p < 0xD800:
                c = chr(p - p % 16 + (p + move) % 16)
            out += c
        return out

    for r in range(pii.ROUNDS):
        a, b = (shifted(a, b, r), b) if r % 2 == 0 else (a, shifted(b, a, r))
    return a + b


def feistel_number(value, side, key):
    a, b = divmod(value, side)
    for r in range(pii.ROUNDS):
        a, b = b, (a + prf(key, r, side, b)) % side
    return a * side + b


def feistel_pair(value, a, b, key):
    x, y = divmod(value, b)
    for r in range(pii.ROUNDS):
        x, y = ((x + prf(key, r, a, y)) % a, y) if r % 2 == 0 else (x, (y + prf(key, r, b, x)) % b)
    return x * b + y


def phone(d):
    n, high = len(d), d[0] >= "2"
    low, many, half = (2 if high else 0) * 10 ** (n - 1), 8 if high else 2, (n - 1) // 2
    return str(feistel_pair(int(d) - low, many * 10 ** (n - 1 - half), 10**half, KEY + "/phone") + low).zfill(n)


AREAS = [a for a in range(1, 900) if a != 666]


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    r = feistel_pair((AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, *pii.SSNS, KEY + "/ssn")
    return f"{AREAS[r // 9999 // 99]:03d}-{r // 9999 % 99 + 1:02d}-{r % 9999 + 1:04d}"


def all_days():
    day, out = datetime.date(1850, 1, 1), []
    while day < datetime.date(2123, 6, 1):
        out.append(day)
        day += datetime.timedelta(1)
    return out


DATES = all_days()
EARLY, LATE = [d for d in DATES if d.day <= 12], [d for d in DATES if d.day > 12]
PLACE = {d: k for days in (EARLY, LATE) for k, d in enumerate(days)}


def moved(day):
    days, sides = (EARLY, pii.EARLY) if day.day <= 12 else (LATE, pii.LATE)
    return days[feistel_pair(PLACE[day], *sides, KEY + "/date")]


def only_digits(x):
    return "".join(c for c in x if c in "0123456789")


def refill(form, number):
    it = iter(number)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x)))


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def named(x):
    return next(k for k, name in enumerate(pii.MONTHS, 1) if name[:3] == x[:3])


def nth(d):
    return "th" if d in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")


def date(m):
    if any(c.isalpha() for c in m):
        words = m.replace(",", "").split()
        first = m[0].isdigit()
        day, name = (words[0], words[1]) if first else (words[1], words[0])
        parts = int(words[2]), named(name), int(only_digits(day))
        month = "{name}" if len(name) > 3 or name == "May" else "{short}"
        day = "{d}{nth}" if not day.isdigit() else "{d}"
        form = f"{day} {month} {{y:04d}}" if first else f"{month} {day}, {{y:04d}}"
    else:
        x, sep = [int(p) for p in regex.split("[./-]", m)], next(c for c in m if c in "./-")
        if m[:4].isdigit():
            parts, form = tuple(x), "{y:04d}" + sep + "{m:02d}" + sep + "{d:02d}"
        else:
            month_first = x[0] <= 12 if sep == "/" else x[1] > 12
            parts = (x[2], x[0], x[1]) if month_first else (x[2], x[1], x[0])
            form = ("{m:02d}" + sep + "{d:02d}" if month_first else "{d:02d}" + sep + "{m:02d}") + sep + "{y:04d}"
    try:
        day = datetime.date(*parts)
    except ValueError:
        return None
    if day not in PLACE:
        return None
    to = moved(day)
    return form.format(y=to.year, m=to.month, d=to.day, name=pii.MONTHS[to.month - 1], short=pii.MONTHS[to.month - 1][:3], nth=nth(to.day))


def ipv6(m):
    left, _, right = m.partition("::")
    a, b = ([g.lower().zfill(4) for g in x.split(":") if g] for x in (left, right))
    x = "".join(a + ["0000"] * (8 - len(a) - len(b)) + b)
    a, b = int(x[:16], 16), int(x[16:], 16)
    for r in range(pii.ROUNDS):
        a, b = b, a ^ int(hashlib.sha256(f"{KEY}/ipv6|{r}|{b:016x}".encode()).hexdigest()[:16], 16)
    x = f"{a:016x}{b:016x}"
    return ":".join(x[k : k + 4] for k in range(0, 32, 4))


def one(match):
    m = match.group()
    is_ = lambda k: regex.fullmatch(pii.PATTERNS[k], m)
    if is_("email"):
        local, domain = m.split("@")
        return feistel_text(local, KEY + "/email") + "@" + domain
    if is_("iban"):
        plain = m.replace(" ", "")
        if mod97(plain[4:] + plain[:4]) != 1:
            return m
        a = feistel_text(plain[4:], KEY + "/iban")
        new = plain[:2] + str(98 - mod97(a + plain[:2] + "00")).zfill(2) + a
        return " ".join(new[k : k + 4] for k in range(0, len(new), 4)) if " " in m else new
    if is_("ipv6"):
        return ipv6(m)
    if is_("phone"):
        code = regex.match(r"(\+[0-9]{1,3})?", m).group()
        return code + refill(m[len(code) :], phone(only_digits(m[len(code) :])))
    if is_("ip"):
        n = feistel_number(int.from_bytes(bytes(map(int, m.split("."))), "big"), 65536, KEY + "/ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if is_("date"):
        return date(m) or m
    if is_("ssn"):
        return ssn(m)
    d = only_digits(m)
    if luhn(d) % 10:
        return m
    b = feistel_text(d[:-1], KEY + "/card")
    return refill(m, b + str(-luhn(b + "0") % 10))


TEXTS = [
    "1980-02-29T10:00:00Z and 1980-02-29 00:00, 29 February 1980, February 29, 1980; 31-12-2020 12-31-2020 02/29/1980 29.02.1980, 31 February 1980",
    "1980/02/29, 29 Feb 1980, 29th February 1980, Feb 29th, 1980 and 1 May 1990, 02.13.2020 13/02/2020 13.02.2020 3/4/1999 2123-05-31 2123-06-01 1850-01-01 1849-12-31",
    "555 123 4567, 5551234567, (555) 123-4567 and +1 555 123 4567 but 1551234567, 155512345678 or 5551234567.89",
    "GB82 WEST 1234 5698 7654 32, GB82WEST12345698765432 not GB83WEST12345698765432, DE89 3704 0044 0532 0130 00.",
    "2001:db8::ff00:42:8329 2001:0db8:0000:0000:0000:ff00:0042:8329 fe80::1 at 10:30:45, 1:2:3:4:5:6:7:8:9 std::vector",
    "мария@example.org müller@example.org Anna.O-1@mail.example.com ANNA.o-1@mail.example.com",
    "card 4111 1111 1111 1111 / 4111111111111111 / 4111111111111112; ssn 123-45-6789; ip 10.0.0.255:80; v1.2.3",
    "nothing here, 12 34 or 2024",
    "",
    None,
]


def test_against_plain_feistel(spark):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    for r, text in zip(rows, TEXTS, strict=True):
        assert r.text == (None if text is None else WHOLE.sub(one, text))
    assert [rows[0].n_date, rows[1].n_date, rows[2].n_phone, rows[3].n_iban, rows[4].n_ipv6, rows[5].n_email, rows[6].n_card] == [8, 11, 4, 3, 3, 4, 2]
    ids = rows[3].text.split(", ")
    assert ids[0].replace(" ", "") == ids[1].split()[0] and mod97(ids[1].split()[0][4:] + ids[1].split()[0][:4]) == 1
    assert rows[4].text.split()[0] == rows[4].text.split()[1] and "10:30:45, 1:2:3:4:5:6:7:8:9 std::vector" in rows[4].text
    assert not set("марию") & set(rows[5].text.split("@")[0]) or rows[5].text.split("@")[0] != "мария"
    digits = [only_digits(x) for x in rows[2].text.split(" but ")[0].replace(" and ", ", ").split(", ")]
    assert digits[0] == digits[1] == digits[2]


def test_sample_tables(spark):
    """Whole texts of the sample table, and what they hold of each kind."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r, old in zip(pii.pseudonymise(docs, KEY).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        assert r.text == WHOLE.sub(one, old.text)


def test_pseudonyms_are_of_their_kind(spark):
    """Each is found again as what it was, in the same notation, and unlike values stay unlike."""
    import random

    r = random.Random(3)
    day = lambda: r.choice(DATES)
    makers = {
        "ssn": lambda: f"{r.choice(AREAS):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}",
        "phone": lambda: f"{r.randrange(2, 10)}{r.randrange(10**9):09d}",
        "turned": lambda: (lambda d: f"{d.month:02d}-{d.day:02d}-{d.year}")(r.choice(LATE)),
        "strokes": lambda: (lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}")(day()),
        "short": lambda: (lambda d: f"{d.day}{nth(d.day)} {pii.MONTHS[d.month - 1][:3]} {d.year}")(r.choice([d for d in DATES[:3000] if d.month != 5])),
    }
    values = [(k, make()) for k, make in makers.items() for _ in range(400)]
    rows = pii.pseudonymise(spark.createDataFrame([(k, v, f"x {v} x") for k, v in values], "kind string, old string, text string"), KEY).collect()
    again = pii.pseudonymise(spark.createDataFrame([(r.kind, r.text) for r in rows], "kind string, text string"), "another").collect()
    for r_, a in zip(rows, again, strict=True):
        n = "n_date" if r_.kind in ("turned", "strokes", "short") else f"n_{r_.kind}"
        assert r_[n] == 1 and a[n] == 1, (r_.old, r_.text)
        new = r_.text.split(" ", 1)[1].rsplit(" ", 1)[0]
        assert new == (date(r_.old) if n == "n_date" else one(regex.fullmatch(".*", r_.old)))
        if r_.kind == "turned":
            assert int(new[3:5]) > 12
    assert all(len({r_.text for r_ in rows if r_.kind == k}) == len({r_.old for r_ in rows if r_.kind == k}) for k in makers)
