import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from factloom.llm import pii
from factloom.llm.sharding import feistel_sides

KEY = "a key for tests"


def one(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for r in pii.pseudonymize(df, KEY).orderBy("doc_id").collect()]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def with_check(d):
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_formats_are_kept(spark):
    cases = [
        ("email", "ann.lee+x9@mail3.example.com", r"[a-z]{3}\.[a-z]{3}\+[a-z]\d@mail3\.example\.com"),
        ("card", with_check("411111111111112"), r"4\d{15}"),
        ("card", "4012-8888 8888-1881", r"4\d{3}-\d{4} \d{4}-\d{4}"),
        ("phone", "+1 (408) 555-7800", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}"),
        ("phone", "408-555-7800", r"[2-9]\d\d-[2-9]\d\d-\d{4}"),
        ("phone_e164", "+44 20 7946 0958", r"\+44 \d\d \d{4} \d{4}"),
        ("ip", "42.179.73.104", r"\d+\.\d+\.\d+\.\d+"),
        ("ssn", "123-45-6789", r"\d{3}-\d\d-\d{4}"),
        ("iso_date", "1984-02-29", r"(19|20)\d\d-\d\d-\d\d"),
        ("date", "3.4.2021", r"\d{1,2}\.\d{1,2}\.(19|20)\d\d"),
        ("date", "12/31/1999", r"\d\d/\d\d/(19|20)\d\d"),
        ("iban", "DE89 3704 0044 0532 0130 00", r"DE\d\d( \d{4}){4} \d\d"),
        ("iban", "GB82WEST12345698765432", r"GB\d\d[A-Z]{4}\d{14}"),
    ]
    rows = one(spark, [f"see {v}, and {v}." for _, v, _ in cases])
    for (kind, v, shape), r in zip(cases, rows):
        assert r.kinds == [kind, kind], (v, r)
        m = re.fullmatch(r"see (.*), and (.*)\.", r.text)
        assert m[1] == m[2] != v and re.fullmatch(shape, m[1]), (v, r.text)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", m[1]))
        if kind == "iban":
            assert iban_ok(m[1])
        if kind == "ip":
            assert all(int(x) < 256 for x in m[1].split("."))
        if kind == "iso_date":
            date.fromisoformat(m[1])


def test_what_fails_its_check_stays(spark):
    texts = ["4111111111111112", "1.2.3.999", "01.2.3.4", "2021-02-30", "000-12-3456", "666-12-3456", "(123) 555-1234", "GB00WEST12345698765432", "32/13/2020", "nobody @ home", "", "no numbers", "1111111111111111111", "v1.2.3", "12345"]
    rows = one(spark, [*texts, None])
    assert [r.text for r in rows] == [*texts, None]
    assert {r.n_replaced for r in rows} == {0}


def test_what_stands_behind_a_value_does_not_hide_it(spark):
    card, iban, phone = "4111 1111 1111 1111", "BE68 5390 0754 7034", "+44 20 7946 0958"
    cases = [
        ("", card, " 12/27", ["card"]), ("", card, " 123", ["card"]), ("12 ", card, " 12/27", ["card"]), ("", card.replace(" ", "-"), " 12 27", ["card"]),
        ("", iban, " BIC", ["iban"]), ("", iban, " 1332 EUR", ["iban"]), ("", iban.replace(" ", ""), " EUR", ["iban"]), ("x ", "AT61 1904 3002 3457 3201", " EUR 12", ["iban"]),
        ("", phone, " 2024", ["phone_e164"]), ("", phone, " 10", ["phone_e164"]), ("call ", phone, " 1234 5678", ["phone_e164"]), ("", "408-555-7800", "", ["phone"]),
        ("13 34 56 ", "408-555-7800", "", ["phone"]),
    ]
    rows = one(spark, [a + v + b for a, v, b, _ in cases])
    alone = one(spark, [v for _, v, _, _ in cases])
    for (a, v, b, kinds), r, lone in zip(cases, rows, alone):
        assert (r.text, r.kinds) == (a + lone.text + b, kinds) and lone.text != v, (v, r)
    both, = one(spark, [f"{card} 43.179.73.104 and {iban} BIC {card} 12/27 1984-02-29"])
    assert both.kinds == ["card", "ip", "iban", "card", "iso_date"] and card not in both.text and "43.179" not in both.text


def test_permutations(spark):
    df = spark.range(1000)
    got = df.select(pii.permute_below(F.col("id"), 1000, "k", "t").alias("x"), pii.permute_number(F.col("id"), 25, 40, "k", "t").alias("y")).collect()
    assert sorted(r.x for r in got) == sorted(r.y for r in got) == list(range(1000))
    names = [(f"{a}{b}{c}",) for a in "ab" for b in range(10) for c in "xyz"] + [("",), ("é",), ("ab" * 40,)]
    out = [r[0] for r in spark.createDataFrame(names, "s string").select(pii.permute_text(F.col("s"), "k", "t")).collect()]
    assert len(set(out)) == len(names)
    assert all(len(a) == len(b[0]) for a, b in zip(out, names))
    days = spark.range(0, pii.DAYS, 7).select(F.expr("date_add(date'1900-01-01', cast(id as int))").alias("d"))
    moved = days.select(pii._moved_day(F.col("d"), "k").alias("d"))
    assert moved.distinct().count() == days.count()
    assert moved.agg(F.min("d") >= F.lit("1900-01-01"), F.max("d") <= F.lit("2099-12-31")).first() == (True, True)


def test_equal_values_stay_linked_and_texts_whole(spark):
    rng = random.Random(1)
    values = ["a.b@c.org", "42.179.73.104", "+1 (408) 555-7800", with_check("555555555555444")]
    filler = ["word ", "\n", "É漢 ", "x", ". ", "12 ", "@"]
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choice(filler) for _ in range(rng.randrange(5))) + "".join(f" {rng.choice(values)} " + "".join(rng.choice(filler[:3]) for _ in range(3)) for _ in range(rng.randrange(4))))
    texts.append("w " * 100_000 + values[1] + " w" * 100_000)
    names = {}
    for t, r in zip(texts, one(spark, texts)):
        found = re.split("(" + "|".join(map(re.escape, values)) + ")", t)
        rest = r.text
        for k, piece in enumerate(found):
            if k % 2:
                nxt = found[k + 1]
                new = rest[: rest.index(nxt, 5)] if nxt else rest
                assert names.setdefault(piece, new) == new
                rest = rest[len(new) :]
            else:
                assert rest.startswith(piece)
                rest = rest[len(piece) :]
        assert not any(v in r.text for v in values)
        assert r.n_replaced == len(found) // 2
    other = pii.pseudonymize(spark.createDataFrame([(1, values[0])], "doc_id long, text string"), key="other").first()
    assert other.text != names[values[0]]


def test_stage_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x 42.179.73.104", "en", 9), (None, None, None, None), (1, "", "en", 0)], "doc_id long, text string, found string, kinds int")
    out = pii.pseudonymize_text(df, KEY)
    assert out.schema == df.schema
    rows = out.collect()
    assert rows[0].text.startswith("x ") and rows[0].text != "x 42.179.73.104" and rows[1].text is None and rows[2].text == ""
    assert pii.pseudonymize(df.limit(0), KEY).collect() == []


# A plain version of the ciphers, forwards and backwards.

def digest(key, kind, i, half):
    return hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()


def number(x, a, b, kind, back=False, key=KEY):
    left, right = divmod(x, b)
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        side = a if i % 2 == 0 else b
        if back:
            left, right = (right - int(digest(key, kind, i, left)[:15], 16)) % side, left
        else:
            left, right = right, (left + int(digest(key, kind, i, right)[:15], 16)) % side
    return left * b + right


def below(x, n, kind, back=False):
    a, b = feistel_sides(n)
    x = number(x, a, b, kind, back)
    while x >= n:
        x = number(x, a, b, kind, back)
    return x


def shift(c, by):
    for low, n in (("0", 10), ("a", 26), ("A", 26)):
        if 0 <= ord(c) - ord(low) < n:
            return chr((ord(c) - ord(low) + by) % n + ord(low))
    return c


def text(s, kind, back=False, key=KEY):
    half = len(s) // 2
    left, right = s[:half], s[half:]
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        kept = left if back else right
        one = digest(key, kind, i, kept)
        stream = one + hashlib.sha256(one.encode()).hexdigest()
        by = [int(stream[4 * (k % 32) : 4 * (k % 32) + 4], 16) for k in range(max(len(left), len(right)))]
        if back:
            left, right = "".join(shift(c, -d) for c, d in zip(right, by)), left
        else:
            left, right = right, "".join(shift(c, d) for c, d in zip(left, by))
    return left + right


def days(y, m, d):
    return (date(y, m, d) - date(1900, 1, 1)).days


def test_independent_ciphers_and_their_inverse(spark):
    rng = random.Random(4)
    # all that follows from the key is undone with the key
    for _ in range(200):
        x, s = rng.randrange(10**6), "".join(rng.choice("aZ9.-é") for _ in range(rng.randrange(90)))
        assert number(number(x, 1000, 1000, "k"), 1000, 1000, "k", True) == x and below(below(x % 997, 997, "k"), 997, "k", True) == x % 997 and text(text(s, "k"), "k", True) == s
    values = []
    for _ in range(25):
        ip = rng.randrange(1 << 32)
        new = number(ip, 1 << 16, 1 << 16, "ip")
        values.append((".".join(str(ip >> k & 255) for k in (24, 16, 8, 0)), ".".join(str(new >> k & 255) for k in (24, 16, 8, 0))))
        day = rng.randrange(pii.DAYS)
        values.append((str(date(1900, 1, 1) + timedelta(day)), str(date(1900, 1, 1) + timedelta(below(day, pii.DAYS, "date")))))
        name = "".join(rng.choice("abXY019._") for _ in range(rng.randrange(1, 20))) + "q"
        values.append((f"{name}@mail.example.org", f"{text(name, 'email')}@mail.example.org"))
        ten = f"{rng.randrange(200, 1000)}{rng.randrange(200, 1000)}{rng.randrange(10**4):04d}"
        p = number(((int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200) * 10_000 + int(ten[6:]), 640_000, 10_000, "phone")
        new = f"{p // 8_000_000 + 200}{p // 10_000 % 800 + 200}{p % 10_000:04d}"
        for shape in ("{}-{}-{}", "+1 {}-{}-{}", "+1{}{}{}", "({}) {}-{}", "1 {} {} {}"):
            values.append(tuple(shape.format(t[:3], t[3:6], t[6:]) for t in (ten, new)))
        inner = "".join(rng.choice("0123456789") for _ in range(14))
        values.append((with_check("4" + inner), with_check("4" + text(inner, "card"))))
        area, group, serial = rng.choice([*range(1, 666), *range(667, 900)]), rng.randrange(1, 100), rng.randrange(1, 10**4)
        p = number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        new = p // (99 * 9999) + 1 + (p // (99 * 9999) >= 665)
        values.append((f"{area:03d}-{group:02d}-{serial:04d}", f"{new:03d}-{p // 9999 % 99 + 1:02d}-{p % 9999 + 1:04d}"))
        n = "".join(rng.choice("0123456789") for _ in range(10))
        values.append((f"+44{n}", f"+44{n[0]}{text(n[1:], 'phone')}"))
    late = [d for k in range(pii.DAYS) if (d := date(1900, 1, 1) + timedelta(k)).day > 12]
    assert len(late) == pii.LATE_DAYS
    for r in rng.sample(range(len(late)), 40) + [0, len(late) - 1]:
        old, new = late[r], late[below(r, len(late), "month-first")]
        values.append((old.strftime("%m/%d/%Y"), new.strftime("%m/%d/%Y")))
    for (_, want), r in zip(values, one(spark, [v for v, _ in values])):
        assert r.text == want and r.n_replaced == 1, r


def test_dates_of_one_notation_never_meet(spark):
    rng = random.Random(9)
    some = [date(1900, 1, 1) + timedelta(k) for k in rng.sample(range(pii.DAYS), 1500)]
    first = [d.strftime("%d/%m/%Y") for d in some]
    second = [d.strftime("%m/%d/%Y") for d in some if d.day > 12]
    made = [r.text for r in one(spark, first + second)]
    assert len(set(made)) == len(set(first + second))
    assert all(int(t[3:5]) <= 12 for t in made[: len(first)]) and all(int(t[3:5]) > 12 for t in made[len(first) :])


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(None, "a.b@c.org"), (None, "a.b@c.org"), (3, None)], "doc_id long, text string")
    drawn = pii.session_key(spark)
    assert len(drawn) == 64 and pii.session_key(spark) == drawn
    spark.conf.set(pii.KEY_SETTING, "given")
    assert pii.session_key(spark) == "given"
    spark.conf.unset(pii.KEY_SETTING)
    rows = pii.pseudonymize(df, "given").collect()
    assert [r.doc_id for r in rows] == [None, None, 3] and rows[0].text == rows[1].text == text("a.b", "email", key="given") + "@c.org"
    # a number that its plan doesn't know is no phone number
    assert one(spark, ["+1 108 155 7800"])[0].n_replaced == 0


def test_plain_numbers_are_no_cards(spark):
    rng = random.Random(7)
    lines = [" ".join(str(rng.randrange(10 ** (k - 1), 10**k)) for _ in range(4000)) for k in (3, 5, 6, 7)]
    lines += ["-".join(str(rng.randrange(10**5)) for _ in range(500)), " ".join(f"{rng.randrange(1, 4)}{rng.randrange(10**11, 10**12)}" for _ in range(300))]
    rows = one(spark, lines)
    assert [r.text for r in rows] == lines and {r.n_replaced for r in rows} == {0}


CARD_FORMS = [
    ("4", 16, (4, 4, 4, 4)), ("4", 13, (4, 3, 3, 3)), ("4", 19, (4, 4, 4, 4, 3)), ("51", 16, (4, 4, 4, 4)), ("2221", 16, (4, 4, 4, 4)), ("2720", 16, (4, 4, 4, 4)), ("34", 15, (4, 6, 5)), ("37", 15, (4, 6, 5)),
    ("6011", 16, (4, 4, 4, 4)), ("36", 14, (4, 6, 4)), ("3528", 16, (4, 4, 4, 4)), ("62", 17, None), ("62", 19, (4, 4, 4, 4, 3)), ("50", 16, (4, 4, 4, 4)),
]


def test_cards_of_all_issuers_in_their_groups(spark):
    rng, texts, shapes = random.Random(8), [], []
    for begin, n, groups in CARD_FORMS:
        digits = with_check(begin + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(begin))))
        for gap in ("", " ", "-") if groups else ("",):
            at, parts = 0, []
            for g in groups or (n,):
                parts.append(digits[at : at + g])
                at += g
            texts.append(f"pay {gap.join(parts)} now")
            shapes.append((begin, gap))
    rows = one(spark, texts)
    for (begin, gap), t, r in zip(shapes, texts, rows):
        assert r.kinds == ["card"], (t, r)
        new = r.text.removeprefix("pay ").removesuffix(" now")
        plain = new.replace(gap, "") if gap else new
        assert plain == with_check(plain[:-1]) and plain.startswith(begin) and r.text != t and [c in " -" for c in r.text] == [c in " -" for c in t]
