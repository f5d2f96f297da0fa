"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their format's own check (Luhn, mod-97, number plan,
calendar, address range) are replaced by a value of the same format, chosen by a
keyed Feistel permutation of that format's values. A value always gets the same
pseudonym and two values of one format never share one, so records stay linked
across documents, while the values can't be had back without the key. The key is
the caller's to keep: there is none in this file.
Of a candidate that fails its check the shorter beginnings are tried, and what is
behind the value found is read again; whatever fails them all is left alone.

Integers are permuted on a grid a x b by adding, in turn, a keyed hash of one
side to the other; where the grid has cells to spare the permutation walks its
cycle back into the format. Strings (mail names, account numbers) are permuted
the same way, half by half, each character within its own class.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.sharding import feistel_sides

#: The setting that names the key for whole sessions.
KEY_SETTING = "spark.factloom.pii.key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
DAYS, MONTHS = 73_049, 2400
#: Days from the 13th of a month on: those that a month-first date tells apart.
LATE_DAYS = DAYS - 12 * MONTHS
_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING. Where it names none, one is
    drawn for the application, so that its runs are linked with each other, and
    with nothing that others have made."""
    named = spark.conf.get(KEY_SETTING, None)
    return named or _keys.setdefault(spark.sparkContext.applicationId, token_hex(32))

# How cards begin and in which groups they are written, longest first: 19, 16, 15, 14 and 13 digits in
# fours, fours, 4-6-5, 4-6-4 and 4-3-3-3, or without any gap, as UnionPay's 17 and 18 are.
FOURS = r"(?:4\d\d|5[0-9]\d|2(?:2(?:2(?=[1-9])|[3-9])|[3-6]\d|7(?:[01]|2(?=0)))|6[0-9]\d|35(?:2(?=[89])|[3-8]))\d(?:[ -]?\d{4}){3}"
CARDS = (
    rf"(?=[46]){FOURS}[ -]?\d{{3}}",
    r"62\d{15,16}",
    FOURS,
    r"3[47]\d\d[ -]?\d{6}[ -]?\d{5}",
    r"3(?:0[0-5]|[689]\d)\d[ -]?\d{6}[ -]?\d{4}",
    r"4\d{3}[ -]?\d{3}[ -]?\d{3}[ -]?\d{3}",
)

#: What a candidate looks like, in order; the checks follow.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "iso_date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?!-?\d)",
    "date": r"(?<![\d./-])(?:\d{1,2}/\d{1,2}/|\d{1,2}\.\d{1,2}\.|\d{1,2}-\d{1,2}-)(?:19|20)\d\d(?![/-]?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "phone_e164": r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)",
    "card": rf"(?<![\d+])(?:{'|'.join(CARDS)})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Candidates lie in runs of such words with one space between.
_WORD = r"(?:[^\s\d@]*+[\d@]\S*+|[A-Z]++(?![a-z])\S*+)"
ISLAND = rf"(?<!\S){_WORD}(?: {_WORD})*+"
#: Kinds of variable length, of which a shorter beginning can be the value, and what they look like.
VARIABLE = ("iban", "phone_e164", "card")
CUTTABLE = r"^(?:[A-Z]{2}\d\d|\+?\d)"
# Lengths of account numbers by country, and of phone numbers (with the country code) where a plan has just one.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
PHONE_LENGTHS = {"1": 11, "7": 11, "30": 12, "31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10, "48": 11, "61": 11, "351": 12, "420": 12}
PHONE_CODES = "^(?:" + "|".join(PHONE_LENGTHS) + ")"
#: Every candidate has one of these; most texts have none and are left at that.
HINT = r"@|\d[\d ./()-]{4}|[A-Z]{2}\d\d"


def _hash(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), half.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1 (below 2**62)."""
    start = F.struct(F.call_function("div", x, F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        side = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(_number(_hash(key, kind, i, s["r"])), side), side).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permute_below(x: Column, n: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. n-1 by cycle walking; at most as many steps
    as the grid has cells to spare, which is exact."""
    a, b = feistel_sides(n)
    once, spare = permute_number(x, a, b, key, kind), a * b - n
    if not spare:
        return once
    return F.aggregate(F.sequence(F.lit(1), F.lit(spare)), once, lambda at, _: F.when(at < n, at).otherwise(permute_number(at, a, b, key, kind)))


def _shifted(char: Column, by: Column) -> Column:
    code = F.ascii(char)

    def within(low: str, size: int) -> Column:
        return F.chr(F.pmod(code - ord(low) + by, F.lit(size)) + ord(low))

    return (
        F.when(char.between("0", "9"), within("0", 10))
        .when(char.between("a", "z"), within("a", 26))
        .when(char.between("A", "Z"), within("A", 26))
        .otherwise(char)
    )


def permute_text(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings whose characters have the same classes
    (digit, small letter, capital, other: unchanged), position by position."""
    half = F.call_function("div", F.length(s), F.lit(2)).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        one = _hash(key, kind, i, acc["r"])
        stream = F.concat(one, F.sha2(one, 256))

        def moved(char: Column, at: Column) -> Column:
            return _shifted(char, F.conv(F.substring(stream, F.pmod(at, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"))

        chars = F.filter(F.split(acc["l"], ""), lambda c: c != "")
        return F.struct(acc["r"].alias("l"), F.array_join(F.transform(chars, moved), "").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits, in order, replaced by ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.aggregate(chars, start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    back = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.transform(back, worth), F.lit(0), lambda s, x: s + x)


def _mod97(letters: Column) -> Column:
    """Remainder by 97 of a string with A as 10 .. Z as 35."""
    chars = F.filter(F.split(letters, ""), lambda c: c != "")

    def step(r: Column, c: Column) -> Column:
        d = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(r * F.when(d > 9, F.lit(100)).otherwise(F.lit(10)) + d, F.lit(97)).cast("int")

    return F.aggregate(chars, F.lit(0), step)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    n = F.length(d)
    # the digits that tell the issuer stay, one or four; the last is the check digit
    own = F.when(d.startswith("4"), F.lit(1)).otherwise(F.lit(4))
    moved = F.concat(F.substring(d, F.lit(1), own), permute_text(F.substring(d, own + 1, n - own - 1), key, "card"))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(moved, F.lit("0"))), F.lit(10)), F.lit(10))
    return (F.pmod(luhn_sum(d), F.lit(10)) == 0) & ~d.rlike(r"^(\d)\1*$"), _refill(m, F.concat(moved, check.cast("string")))


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    s = F.regexp_replace(m, " ", "")
    valid = (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1) & F.length(s).between(15, 34)
    moved = permute_text(F.substring(s, F.lit(5), F.length(s)), key, "iban")
    country = F.substring(s, 1, 2)
    check = _padded(98 - _mod97(F.concat(moved, country, F.lit("00"))), 2)
    plain = F.concat(country, check, moved)
    return valid, F.when(m.contains(" "), F.trim(F.regexp_replace(plain, "(.{4})", "$1 "))).otherwise(plain)


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    fine = m.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & F.forall(parts, lambda x: x < 256)
    moved = permute_number(F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x), 1 << 16, 1 << 16, key, "ip")
    # the permuted address is computed once and then taken apart
    octets = F.transform(F.array(moved), lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, by), F.lit(256)).cast("string") for by in (24, 16, 8, 0))))
    return fine, F.get(octets, F.lit(0))


def _day(m: Column, pattern: str) -> Column:
    return F.try_to_timestamp(m, F.lit(pattern)).cast("date")


def _moved_day(day: Column, key: str) -> Column:
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.date_add(F.lit(FIRST_DAY).cast("date"), permute_below(number, DAYS, key, "date").cast("int"))


def _iso_date(m: Column, key: str) -> tuple[Column, Column]:
    day = _day(m, "yyyy-MM-dd")
    return day.isNotNull(), F.date_format(_moved_day(day, key), "yyyy-MM-dd")


def _late_rank(day: Column) -> Column:
    """Number of a day among the days from the 13th of their months on."""
    first = F.trunc(day, "month")
    months = (F.year(day) - 1900) * 12 + F.month(day) - 1
    return (F.date_diff(first, F.lit(FIRST_DAY).cast("date")) - 12 * months + F.dayofmonth(day) - 13).cast("long")


def _late_day(rank: Column) -> Column:
    """The day with that number; months differ by few days, so its month is near
    the one that months of equal length would give."""
    start = lambda k: F.add_months(F.lit(FIRST_DAY).cast("date"), k)
    before = lambda k: F.date_diff(start(k), F.lit(FIRST_DAY).cast("date")) - 12 * k
    guess = F.floor(rank * F.lit(MONTHS / LATE_DAYS)).cast("int")
    near = F.sequence(F.greatest(guess - 3, F.lit(0)), F.least(guess + 3, F.lit(MONTHS - 1)))
    month = F.array_max(F.filter(near, lambda k: before(k) <= rank))
    return F.get(F.transform(F.array(month), lambda k: F.date_add(start(k), (rank - before(k) + 12).cast("int"))), F.lit(0))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    """Day-first if that is a date, month-first else. The days that a month-first
    date can name are permuted among themselves: what is written so stays so, and
    never meets a day-first one."""
    plain = F.regexp_replace(m, "[./-]", "/")
    wide = plain.rlike(r"^\d\d/\d\d/")
    first, second = _day(plain, "d/M/yyyy"), _day(plain, "M/d/yyyy")
    early = F.get(F.transform(F.array(_late_rank(second)), lambda r: _late_day(permute_below(r, LATE_DAYS, key, "month-first"))), F.lit(0))
    moved = F.when(first.isNotNull(), _moved_day(first, key)).otherwise(early)

    def written(d: str) -> Column:
        return F.when(wide, F.date_format(moved, d)).otherwise(F.date_format(moved, d.replace("dd", "d").replace("MM", "M")))

    text = F.when(first.isNotNull(), written("dd/MM/yyyy")).otherwise(written("MM/dd/yyyy"))
    return first.isNotNull() | second.isNotNull(), F.regexp_replace(text, "/", F.regexp_extract(m, r"([./-])", 1))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1) * 9999 + serial - 1
    moved = permute_number(rank, 898 * 99, 9999, key, "ssn")
    out = F.transform(
        F.array(moved),
        lambda x: F.concat_ws(
            "-",
            _padded(F.call_function("div", x, F.lit(99 * 9999)) + 1 + (F.call_function("div", x, F.lit(99 * 9999)) >= 665).cast("int"), 3),
            _padded(F.pmod(F.call_function("div", x, F.lit(9999)), F.lit(99)) + 1, 2),
            _padded(F.pmod(x, F.lit(9999)) + 1, 4),
        ),
    )
    return valid, F.get(out, F.lit(0))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    ten = F.substring(d, F.length(d) - 9, F.lit(10))
    area, exchange, line = (F.substring(ten, *at).cast("long") for at in ((1, 3), (4, 3), (7, 4)))
    moved = permute_number(((area - 200) * 800 + exchange - 200) * 10_000 + line, 640_000, 10_000, key, "phone")
    new = F.get(
        F.transform(
            F.array(moved),
            lambda x: F.concat(
                (F.call_function("div", x, F.lit(8_000_000)) + 200).cast("string"),
                (F.pmod(F.call_function("div", x, F.lit(10_000)), F.lit(800)) + 200).cast("string"),
                _padded(F.pmod(x, F.lit(10_000)), 4),
            ),
        ),
        F.lit(0),
    )
    return (area >= 200) & (exchange >= 200), _refill(m, F.concat(F.when(F.length(d) == 11, F.lit("1")).otherwise(F.lit("")), new))


def _phone_e164(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    # numbers of country code 1 have one plan, however they are written
    fine, national = _phone(m, key)
    ours = d.startswith("1")
    # other country codes have three digits at most, which stay
    moved = F.concat(F.substring(d, 1, 3), permute_text(F.substring(d, F.lit(4), F.length(d)), key, "phone"))
    return F.when(ours, fine & (F.length(d) == 11)).otherwise(F.length(d).between(8, 15)), F.when(ours, national).otherwise(_refill(m, moved))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    name = F.substring_index(m, "@", 1)
    return F.lit(True), F.concat(permute_text(name, key, "email"), F.substring(m, F.length(name) + 1, F.length(m)))


_KINDS = {"email": _email, "iban": _iban, "ip": _ip, "iso_date": _iso_date, "date": _date, "ssn": _ssn, "phone": _phone, "phone_e164": _phone_e164, "card": _card}


def _replaced(m: Column, key: str, kinds: tuple[str, ...] = tuple(_KINDS)) -> Column:
    """kind and pseudonym of a candidate; null kind and the text itself if no check holds."""
    found, text = F.lit(None).cast("string"), m
    for kind in reversed(kinds):
        valid, new = _KINDS[kind](m, key)
        fits = m.rlike(f"^(?:{PATTERNS[kind]})$") & F.coalesce(valid, F.lit(False))
        found = F.when(fits, F.lit(kind)).otherwise(found)
        text = F.when(fits, new).otherwise(text)
    return F.struct(found.alias("kind"), text.alias("value"))


def _planned(p: Column) -> Column:
    """Whether a string has the very length that its country's accounts or phones have."""
    lengths = lambda known: F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    account = p.rlike(r"^[A-Z]{2}\d\d") & (F.try_element_at(lengths(IBAN_LENGTHS), F.substring(p, 1, 2)) == F.length(F.regexp_replace(p, " ", "")))
    code = F.regexp_extract(_digits(p), PHONE_CODES, 0)
    return F.coalesce(account | (p.startswith("+") & (F.try_element_at(lengths(PHONE_LENGTHS), code) == F.length(_digits(p)))), F.lit(False))


def _longest(m: Column, key: str) -> Column:
    """kind and pseudonym of the longest beginning of a candidate that holds its
    check, and the tail behind it; one of its country's length goes first. If none
    holds, the first run of letters and digits is text and the rest is the tail."""
    ends = F.filter(F.sequence(F.length(m) - 1, F.lit(1), F.lit(-1)), lambda i: F.substring(m, i, F.lit(2)).rlike(r"^[A-Za-z0-9)][^A-Za-z0-9)]"))
    # the check and the pattern's end both hold before what is neither letter nor digit
    shorter = F.when(m.rlike(CUTTABLE), F.transform(ends, lambda i: F.substring(m, F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("value"), F.lit("").alias("tail"))

    def tried(best: Column, p: Column, kinds: tuple[str, ...]) -> Column:
        one = F.get(F.transform(F.array(_replaced(p, key, kinds)), lambda r: F.struct(r["kind"].alias("kind"), r["value"].alias("value"), F.substring(m, F.length(p) + 1, F.length(m)).alias("tail"))), F.lit(0))
        return F.when(best["kind"].isNotNull(), best).otherwise(one)

    first = F.aggregate(F.filter(shorter, _planned), none, lambda best, p: tried(best, p, VARIABLE))
    whole = F.aggregate(F.array(m), first, lambda best, p: tried(best, p, tuple(_KINDS)))
    any_ = F.aggregate(shorter, whole, lambda best, p: tried(best, p, VARIABLE))
    head = F.regexp_extract(m, r"^[^A-Za-z0-9]*[A-Za-z0-9]*", 0)
    failed = F.struct(F.lit(None).cast("string").alias("kind"), head.alias("value"), F.substring(m, F.length(head) + 1, F.length(m)).alias("tail"))
    return F.get(F.transform(F.array(any_), lambda x: F.when(x["kind"].isNotNull(), x).otherwise(failed)), F.lit(0))


def _scanned(island: Column, key: str) -> Column:
    """An island as pieces with their kinds, from left to right; tails are read again."""
    start = F.struct(F.array().cast("array<struct<kind: string, value: string>>").alias("out"), island.alias("rest"))
    piece = lambda kind, value: F.struct(kind.cast("string").alias("kind"), value.alias("value"))

    def step(s: Column, _: Column) -> Column:
        parts = F.split(s["rest"], ANY, 2)
        now = F.struct(F.get(parts, F.lit(0)).alias("gap"), F.get(parts, F.lit(1)).alias("behind"), _longest(F.regexp_extract(s["rest"], ANY, 0), key).alias("at"))
        moved = F.transform(
            F.array(now),
            lambda x: F.struct(
                F.concat(s["out"], F.array(piece(F.lit(None), x["gap"]), piece(x["at"]["kind"], x["at"]["value"]))).alias("out"),
                F.concat(x["at"]["tail"], x["behind"]).alias("rest"),
            ),
        )
        last = F.struct(F.concat(s["out"], F.array(piece(F.lit(None), s["rest"]))).alias("out"), F.lit("").alias("rest"))
        return F.when(s["rest"] == "", s).when(s["rest"].rlike(ANY), F.get(moved, F.lit(0))).otherwise(last)

    # a step uses up a run of letters and digits at least, and the last one the end
    steps = F.sequence(F.lit(0), F.size(F.split(island, "[^A-Za-z0-9]+")))
    return F.when(island.rlike(ANY), F.aggregate(steps, start, step, lambda s: s["out"])).otherwise(F.array(piece(F.lit(None), island)))


def _pieces(text: Column, key: str) -> tuple[Column, Column]:
    """Text between islands, and the islands as pieces."""
    return F.split(text, ISLAND, -1), F.transform(F.regexp_extract_all(text, F.lit(ISLAND), 0), lambda m: _scanned(m, key))


def _joined(gaps: Column, found: Column) -> Column:
    ends = F.concat(F.transform(found, lambda x: F.array_join(F.transform(x, lambda p: p["value"]), "")), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, ends, lambda g, v: F.concat(g, v)), "")


def pseudonymize(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text with pseudonyms, n_replaced, and kinds (one entry
    for each replacement, in text order).

    A null text stays null and an empty one empty, with no replacement; a long text
    is read whole. Only the two columns are read, so other columns may have any
    name; null and repeated ids are kept as they are, a row each. An empty table
    gives an empty result. ``key`` is a secret: with it the values can be had back.
    """
    text = F.col("text")
    none = F.from_json(F.lit("[]"), "array<array<struct<kind: string, value: string>>>")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _pieces(text, key)[1]
    # in two steps, so that the replacements are made once
    cut = rows.select("doc_id", "text", F.when(text.rlike(HINT), found).otherwise(none).alias("found"))
    done = F.filter(F.flatten("found"), lambda x: x["kind"].isNotNull())
    return cut.select(
        "doc_id",
        F.when(F.size(done) > 0, _joined(F.split(text, ISLAND, -1), F.col("found"))).otherwise(text).alias("text"),
        F.coalesce(F.size(done), F.lit(0)).alias("n_replaced"),
        F.coalesce(F.transform(done, lambda x: x["kind"]), F.array().cast("array<string>")).alias("kinds"),
    )


def pseudonymize_text(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts; all else is as it was.

    Null and empty texts stay; a long text is read whole. Rows are never dropped or
    merged, whether ids are null or repeated; other columns may have any name. An
    empty table stays empty. ``key`` is a secret, as in ``pseudonymize``.
    """
    text = F.col(text_col)
    gaps, found = _pieces(text, key)
    return documents.withColumn(text_col, F.when(text.rlike(HINT), _joined(gaps, found)).otherwise(text))
