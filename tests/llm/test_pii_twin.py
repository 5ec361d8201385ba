"""The pseudonyms against plain Python networks and their inverses."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from linkengine.llm import pii

KEY = "twin key"
LOW, UP, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def digest(kind, turn, value):
    return hashlib.sha256(f"{KEY}|{kind}|{turn}|{value}".encode()).digest()


def shift(c, by, hexadecimal):
    for cls in ([HEX] if hexadecimal else []) + ["0123456789", LOW, UP]:
        if c in cls:
            return cls[(cls.index(c) + by) % len(cls)]
    return c


def text_net(value, kind, hexadecimal=False, back=False):
    m = len(value) // 2
    a, b = value[:m], value[m:]
    for turn in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        half, other = (a, b) if turn % 2 == 0 else (b, a)
        d = digest(kind, turn, other)
        half = "".join(shift(c, -d[i % 32] if back else d[i % 32], hexadecimal) for i, c in enumerate(half))
        a, b = (half, b) if turn % 2 == 0 else (a, half)
    return a + b


def pair_net(x, y, p, q, kind, back=False):
    drawn = lambda v, t: int(digest(kind, t, v).hex()[:12], 16) * (-1 if back else 1)
    for turn in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        if turn % 2 == 0:
            x = (x + drawn(y, turn)) % p
        else:
            y = (y + drawn(x, turn)) % q
    return x, y


def date_net(day, back=False):
    month = (day.year - 1700) * 12 + day.month - 1
    if day.day <= 12:
        month, d = pair_net(month, day.day - 1, 4800, 12, "date early", back)
        return dt.date(1700 + month // 12, month % 12 + 1, d + 1)
    x, y = divmod(INDEX[day], 9833)
    x, y = pair_net(x, y, 9, 9833, "date late", back)
    return dt.date(*LATE[x * 9833 + y])


def _late():
    day, out = dt.date(1700, 1, 1), []
    while day < dt.date(2100, 1, 1):
        if day.day > 12:
            out.append((day.year, day.month, day.day))
        day += dt.timedelta(1)
    return out


LATE = _late()
INDEX = {dt.date(*x): i for i, x in enumerate(LATE)}


def luhn_digit(body):
    s = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(body)))
    return str(-s % 10)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def spark_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pii_scan(df, key=KEY).collect(), key=lambda r: r.doc_id)]


def test_number_of_late_days():
    assert len(LATE) == 9 * 9833


def test_text_kinds_and_their_inverses(spark):
    rng = random.Random(9)
    word = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    hexes = [word(HEX, n) for n in (32, 40, 64) for _ in range(10)]
    mails = [f"{word(LOW, 5)}.{word(LOW + '0123456789', 4)}@{word(LOW, 6)}.com" for _ in range(20)]
    keys = ["sk-" + word(LOW + UP + "0123456789", n) for n in range(16, 36)] + ["ghp_" + word(LOW, 24), "AKIA" + word(UP, 16)]
    for values, head, kind, tail, own in ((hexes, "", "hex", "", True), (mails, "", "email", ".com", False), (keys[:20], "sk-", "secret", "", False), (keys[20:21], "ghp_", "secret", "", False), (keys[21:], "AKIA", "secret", "", False)):
        got = spark_of(spark, values)
        for v, g in zip(values, got, strict=True):
            body = v[len(head) : len(v) - len(tail)]
            assert g == head + text_net(body, kind, own) + tail
            assert text_net(g[len(head) : len(g) - len(tail)], kind, own, True) == body


def test_numbers_and_their_inverses(spark):
    rng = random.Random(10)
    octets = [[rng.randrange(256) for _ in range(4)] for _ in range(60)]
    for o, g in zip(octets, spark_of(spark, ["at " + ".".join(map(str, o)) for o in octets]), strict=True):
        x, y = pair_net(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        new = [x >> 8, x & 255, y >> 8, y & 255]
        assert g == "at " + ".".join(map(str, new))
        assert pair_net(x, y, 65536, 65536, "ip", True) == (o[0] * 256 + o[1], o[2] * 256 + o[3])
    cards = []
    for _ in range(40):
        body = "".join(rng.choice("0123456789") for _ in range(rng.choice((12, 14, 15, 18))))
        cards.append(body + luhn_digit(body))
    for c, g in zip(cards, spark_of(spark, cards), strict=True):
        inner = text_net(c[1:-1], "card")
        assert g == c[0] + inner + luhn_digit(c[0] + inner) and text_net(inner, "card", back=True) == c[1:-1]


def test_dates_and_their_inverses(spark):
    days = [dt.date(1990, 1, 1) + dt.timedelta(i) for i in range(30 * 365 + 8)]
    own = pii.pseudonym(F.col("m"), F.lit("date"), KEY)
    forms = {"%Y-%m-%d": days, "%d.%m.%Y": days, "%m/%d/%Y": days, "%d/%m/%Y": [d for d in days if d.day > 12]}
    texts = [(d.strftime(f), d.isoformat(), f) for f, some in forms.items() for d in some]
    rows = spark.createDataFrame(texts, "m string, day string, form string").withColumn("p", own).collect()
    slash = [r.p for r in rows if "/" in r.m]
    assert len(set(slash)) == len(slash)  # written both ways, no two dates share a pseudonym
    for r in rows:
        day = dt.date.fromisoformat(r.day)
        new = date_net(day)
        assert r.p == new.strftime(r.form), r
        if r.form == "%Y-%m-%d":
            assert date_net(new, True) == day
    ends = spark.createDataFrame([("1700-01-01",), ("1700-01-13",), ("2099-12-31",), ("2100-01-01",), ("1699-12-31",), ("00/05/2000",), ("31/02/2000",)], "m string").withColumn("p", own).collect()
    assert [r.p is not None for r in ends] == [True] * 3 + [False] * 4


@pytest.mark.parametrize("spaced", [False, True])
def test_iban(spark, spaced):
    valid = ["GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606"]
    show = lambda v: " ".join(v[i : i + 4] for i in range(0, len(v), 4)) if spaced else v
    for v, g in zip(valid, spark_of(spark, [f"to {show(x)}." for x in valid]), strict=True):
        new = text_net(v[4:], "iban")
        check = f"{98 - mod97(new + v[:2] + '00'):02d}"
        assert g == f"to {show(v[:2] + check + new)}." and mod97(new + v[:2] + check) == 1 and new != v[4:]
    wrong = ["GB83WEST12345698765432", "DE88370400440532013000"]
    assert spark_of(spark, wrong) == wrong


def test_ipv6_and_phones(spark):
    plain = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "2001:DB8::FF00:42:8329"]
    for v, g in zip(plain, spark_of(spark, [f"host {x} up" for x in plain]), strict=True):
        low = text_net(v.lower().replace(":", ""), "ipv6", True)
        it = iter(low)
        want = "".join(c if c == ":" else next(it) for c in v.lower())
        assert g == f"host {want.upper() if v == v.upper() else want} up"
    rest = ["at 12:30:45 or a::b or std::x", "1:2:3 is a ratio"]
    assert spark_of(spark, rest) == rest
    phones = {"+49 30 901820": "49", "+44 (20) 7946 0958": "44", "+353 1 234 5678": "353", "+7 495 123-45-67": "7"}
    for (v, code), g in zip(phones.items(), spark_of(spark, list(phones)), strict=True):
        digits = [c for c in v if c.isdigit()]
        want = iter(code + text_net("".join(digits)[len(code) :], "intl"))
        assert g == "".join(next(want) if c.isdigit() else c for c in v) != v
    assert spark_of(spark, ["+49 12"]) == ["+49 12"]


def test_columns_keep_their_names_and_values(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.example.com", [1], "x")], "doc_id long, text string, spans array<int>, spans_ string")
    out = pii.pseudonymise(docs, key=KEY)
    row = out.first()
    assert out.columns == docs.columns and row.spans == [1] and row.spans_ == "x" and "a.b" not in row.text
    with pytest.raises(ValueError):
        pii.find_spans(docs)


def test_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.example.com")], "doc_id long, text string")
    plain = pii.pii_scan(docs).first().text
    spark.conf.set("spark.linkengine.pii.key", KEY)
    try:
        assert pii.pii_scan(docs).first().text == spark_of(spark, ["mail a.b@c.example.com"])[0] != plain
    finally:
        spark.conf.unset("spark.linkengine.pii.key")


def test_long_and_repeated(spark):
    texts = ["word " * 200_000 + "call 415-555-2671", "", None, "same 415-555-2671", "same 415-555-2671"]
    out = spark_of(spark, texts)
    assert out[0].startswith("word word") and not out[0].endswith("2671") and out[1:3] == ["", None] and out[3] == out[4] != texts[3]
