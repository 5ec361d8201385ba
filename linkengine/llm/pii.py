"""PII: format-preserving keyed pseudonyms, on built-in functions only.

Spans are found by one pattern, validated by kind (Luhn for cards, the remainder modulo 97 for IBANs, octets and groups of
addresses, areas and groups of social security numbers, calendar dates), and replaced by a keyed permutation of their own
format, so that equal values get equal pseudonyms in every document and different ones stay different.  The permutations are
Feistel networks of ``ROUNDS`` rounds whose round function is a keyed SHA-256:

* text networks split a string of characters in two halves and shift each character of one within its class (digit, small
  letter, capital, or a hexadecimal digit) by bytes drawn from the other half; other characters stay;
* number networks act on pairs (a mod A, b mod B) with modular addition, for values whose range is not a power of ten.

A card keeps its first digit and gets a new check digit, an IBAN its country and new check digits, a phone number its layout,
its country code and which area and exchange digits may come first, an address stays an address, an e-mail keeps its top-level
domain.  A date of the years 1700 to 2099 stays one.  Days 1 to 12 of a month and later days are permuted apart, the same way
for every layout: a slash date that can be read month first is read so, any other is a later day written day first, and so are
their pseudonyms, so that no two slash dates meet in one.  Whatever does not validate stays as it is.

The key is the argument, else the setting ``spark.linkengine.pii.key``, else ``KEY``, which is no secret and meant for tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "linkengine-demo-key"
ROUNDS = 6

# The shapes of the spans.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9\-]++\.)++[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9\-]{16,}",
    "login": r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|api[_-]?key|token) ?[=:] ?)[\"']?(?=[A-Za-z0-9_\-+/]*[0-9])[A-Za-z0-9_\-+/]{6,}+[\"']?",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{32}|[0-9a-f]{64})(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+1[ .\-]?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-]?)\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w.\-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.\-])[2-9]\d{2}[.\-]\d{4}(?![\d\-])",
    "date": r"(?<![\w\-/.])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w\-/])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "intl": r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .\-]?(?:\(\d{1,4}\)|\d{1,4})){2,5}(?![\d(])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<!\w)(?<!\d-)\d(?:[ \-]?\d){12,18}(?!\w|-\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
}
#: Country codes of one and of two digits; all others have three.
CODES_1, CODES_2 = ["7"], "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())
#: Every span that validates has a digit, an @, the head of a secret or 32 hexadecimal letters in a row.
GATE = "[0-9@]|AKIA|ASIA|gh[po]_|sk-|xox[abp]-|[a-f]{32}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str, kind: Column, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|"), kind, F.lit("|"), turn.cast("string"), F.lit("|"), value), 256)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = "0123456789abcdef"


def _shift(c: Column, by: Column, hexadecimal: Column) -> Column:
    """A character moved within its class; any other stays."""
    own = F.when(hexadecimal & F.lit(_HEX).contains(c), F.lit(_HEX))
    for abc in _CLASSES:
        own = own.when(F.lit(abc).contains(c), F.lit(abc))
    return F.coalesce(_let(own, lambda abc: F.substring(abc, F.pmod(F.instr(abc, c) - 1 + by, F.length(abc)) + 1, F.lit(1))), c)


def permute_text(value: Column, kind: Column, key: str, hexadecimal: Column) -> Column:
    """The text network.  A single character has an empty other half and is shifted by the key alone."""

    def mixed(half: Column, other: Column, turn: Column) -> Column:
        place = lambda d: F.transform(F.sequence(F.lit(1), F.length(half)), lambda i: _shift(F.substring(half, i, F.lit(1)), _byte(d, i), hexadecimal))
        return F.when(F.length(half) > 0, F.array_join(_let(_digest(key, kind, turn, other), place), "")).otherwise("")

    def turned(s: Column, turn: Column) -> Column:
        """The two halves change places in each turn; after an even number of turns they are back."""
        return F.struct(s["other"].alias("half"), mixed(s["half"], s["other"], turn).alias("other"))

    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("half"), F.substring(value, middle + 1, F.length(value)).alias("other"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda s: F.concat(s["half"], s["other"]))


def permute_pair(a: Column, b: Column, size_a: Column, size_b: Column, kind: Column, key: str) -> Column:
    """The number network on (a mod size_a, b mod size_b): a struct of the permuted half and other."""

    def turned(s: Column, turn: Column) -> Column:
        drawn = F.conv(F.substring(_digest(key, kind, turn, s["other"].cast("string")), 1, 12), 16, 10).cast("long")
        size = F.when(turn % 2 == 0, size_a).otherwise(size_b)
        return F.struct(s["other"].alias("half"), F.pmod(s["half"] + drawn, size).alias("other"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("half"), b.cast("long").alias("other")), turned)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _laid_out(m: Column, new: Column, place: Column) -> Column:
    """``m`` with its characters of the class ``place`` replaced by those of ``new`` in order."""

    def put(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        return F.when(F.rlike(c, place), F.substring(new, F.regexp_count(F.substring(m, F.lit(1), i), place), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), put), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit included."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda s, x: s + x)


_START = "1700-01-01"
#: Months of 400 years and the days 1 to 12 of each; the later days of those years are 146,097 - 12 * 4,800 = 9 * 9,833.
_EARLY, _LATE = (4800, 12), (9, 9833)
#: Mean number of later days of a month.
_MEAN = 9 * 9833 / 4800


def _first(month: Column) -> Column:
    """First day of the month of a number counted from 1700 on."""
    return F.add_months(F.lit(_START).cast("date"), month.cast("int"))


def _later_before(month: Column) -> Column:
    """Days above 12 of all months before this one."""
    return F.datediff(_first(month), F.lit(_START).cast("date")) - month * 12


def _late_day(n: Column) -> Column:
    """The n-th day above 12; its month is next to the mean's guess."""
    guess = F.floor(n / _MEAN)
    near = F.filter(F.sequence(F.greatest(guess - 1, F.lit(0)), F.least(guess + 1, F.lit(_EARLY[0] - 1))), lambda k: _later_before(k) <= n)
    return _let(F.array_max(near), lambda k: F.date_add(_first(k), (n - _later_before(k) + 12).cast("int")))


def _form(m: Column) -> Column:
    """Layout of a date; a slash date is read month first where its first number may be a month."""
    return F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").when(F.substring(m, 1, 2) <= "12", "MM/dd/yyyy").otherwise("dd/MM/yyyy")


def _pair(a: Column, b: Column, size_a: int, size_b: int, label: str) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(size_a).cast("long").alias("p"), F.lit(size_b).cast("long").alias("q"), F.lit(label).alias("label"))


def _numbers(m: Column, kind: Column) -> Column:
    """What the number network takes of an address, a social security number or a date; null where it does not validate."""

    def ip(o: Column) -> Column:
        return F.when(F.forall(o, lambda x: x <= 255), _pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip"))

    def ssn(p: Column) -> Column:
        valid = (p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        return F.when(valid, _pair(p[0] - 1 - (p[0] > 666).cast("long"), (p[1] - 1) * 9999 + p[2] - 1, 898, 99 * 9999, "ssn"))

    def date(day: Column) -> Column:
        month = (F.year(day) - 1700) * 12 + F.month(day) - 1
        later = F.dayofmonth(day) - 13 + _later_before(month)
        early = _pair(month, F.dayofmonth(day) - 1, *_EARLY, "date early")
        return F.when(F.year(day).between(1700, 2099), F.when(F.dayofmonth(day) <= 12, early).otherwise(_pair(F.floor(later / _LATE[1]), later % _LATE[1], *_LATE, "date late")))

    numbers = F.transform(F.split(m, r"[.\-]"), lambda x: x.try_cast("long"))
    day = F.try_to_timestamp(m, _form(m)).cast("date")
    return F.when(kind == "ip", _let(numbers, ip)).when(kind == "ssn", _let(numbers, ssn)).when(kind == "date", _let(day, date))


def _written(m: Column, label: Column, x: Column, y: Column) -> Column:
    """A pair of the number network in the layout of ``m``."""
    octets = lambda n: F.concat_ws(".", F.shiftright(n, 8).cast("string"), (n % 256).cast("string"))
    area = x + 1 + (x >= 665).cast("long")
    ssn = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(y / 9999) + 1).cast("string"), 2, "0"), F.lpad((y % 9999 + 1).cast("string"), 4, "0"))
    day = F.when(label == "date early", F.date_add(_first(x), y.cast("int"))).otherwise(_late_day(x * _LATE[1] + y))
    date = F.call_function("date_format", day, _form(m))
    return F.when(label == "ip", F.concat_ws(".", octets(x), octets(y))).when(label == "ssn", ssn).otherwise(date)


def _rest97(text: Column) -> Column:
    """Remainder modulo 97 of a text whose letters are read as 10 to 35."""
    worth = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: _let(F.ascii(F.substring(text, i, F.lit(1))), lambda c: c - F.when(c < 65, 48).otherwise(55)))
    return F.aggregate(worth, F.lit(0), lambda s, x: (s * F.when(x < 10, 10).otherwise(100) + x) % 97)


_HEADS = "^(?:(?:AKIA|ASIA|gh[po]_|sk-|xox[abp]-)|[A-Za-z_\\-]+ ?[=:] ?[\"']?)"


def _code_length(d: Column) -> Column:
    return F.when(F.substring(d, 1, 1).isin(CODES_1), 1).when(F.substring(d, 1, 2).isin(CODES_2), 2).otherwise(3)


def _body(m: Column, kind: Column, d: Column) -> Column:
    """What the text network permutes of a span with the digits ``d``; null where the span does not validate."""
    top = F.length(F.substring_index(m, ".", -1)) + 1
    after = F.length(F.regexp_extract(m, _HEADS, 0))
    ten = F.length(d) - 9
    iban = F.replace(m, F.lit(" "), F.lit(""))
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    return (
        F.when(kind == "email", F.substring(m, F.lit(1), F.length(m) - top))
        .when(kind.isin("secret", "login"), F.substring(m, after + 1, F.length(m)))
        .when(kind == "hex", m)
        .when(kind == "card", F.when(_luhn(d) % 10 == 0, F.substring(d, F.lit(2), F.length(d) - 2)))
        .when(kind == "phone", F.concat(F.substring(d, ten + 1, F.lit(2)), F.substring(d, ten + 4, F.lit(6))))
        .when(kind == "intl", F.when(F.length(d).between(8, 15), F.substring(d, _code_length(d) + 1, F.length(d))))
        .when(kind == "iban", _let(iban, lambda v: F.when(F.length(v).between(15, 34) & F.substring(v, 3, 2).between("02", "98") & (_rest97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1), F.substring(v, F.lit(5), F.length(v)))))
        .when(kind == "ipv6", F.when(m.rlike("[0-9]") & F.when(m.contains("::"), groups.between(2, 7)).otherwise(groups == 8), F.lower(F.replace(m, F.lit(":"), F.lit("")))))
    )


def _finished(m: Column, kind: Column, d: Column, new: Column, key: str) -> Column:
    """The span with its permuted part: what precedes it, new check digits, what follows it."""

    def leading(at: Column, turn: int) -> Column:
        """A first digit 2-9 of area and exchange stays 2-9, another stays 0-1."""
        c = F.substring(d, at, F.lit(1)).cast("int")
        by = _byte(_digest(key, kind, F.lit(turn), new), F.lit(1))
        return F.when(c >= 2, F.pmod(c - 2 + by, F.lit(8)) + 2).otherwise(F.pmod(c + by, F.lit(2))).cast("string")

    ten = F.length(d) - 9
    phone = F.concat(F.substring(d, F.lit(1), ten - 1), leading(ten, 1), F.substring(new, 1, 2), leading(ten + 3, 4), F.substring(new, 3, 6))
    card = _let(F.concat(F.substring(d, 1, 1), new), lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    land = F.substring(m, 1, 2)
    iban = F.concat(land, F.lpad((98 - _rest97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0"), new)
    laid = F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "intl", F.concat(F.substring(d, F.lit(1), _code_length(d)), new)).when(kind == "iban", iban).when(kind == "ipv6", new)
    place = F.when(kind == "iban", "[^ ]").when(kind == "ipv6", "[0-9A-Fa-f]").otherwise("[0-9]")
    head = F.when(kind.isin("secret", "login"), F.regexp_extract(m, _HEADS, 0)).otherwise("")
    tail = F.when(kind == "email", F.concat(F.lit("."), F.substring_index(m, ".", -1))).otherwise("")
    out = _let(laid, lambda n: F.when(n.isNull(), F.concat(head, new, tail)).otherwise(_laid_out(m, n, place)))
    return F.when((kind == "ipv6") & (m == F.upper(m)), F.upper(out)).otherwise(out)


def kind_of(m: Column) -> Column:
    out = None
    for kind, shape in SHAPES.items():
        is_it = m.rlike(f"^(?:{shape})$")
        out = F.when(is_it, F.lit(kind)) if out is None else out.when(is_it, F.lit(kind))
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a span of a kind; null where it does not validate."""
    number = lambda n: F.when(n.isNotNull(), _let(permute_pair(n["a"], n["b"], n["p"], n["q"], n["label"], key), lambda s: _written(m, n["label"], s["half"], s["other"])))
    text = lambda d: _let(_body(m, kind, d), lambda b: F.when(b.isNotNull(), _let(permute_text(b, kind, key, kind.isin("hex", "ipv6")), lambda new: _finished(m, kind, d, new, key))))
    return F.when(kind.isin("ip", "ssn", "date"), _let(_numbers(m, kind), number)).otherwise(_let(_digits(m), text))


def chosen_key(spark: SparkSession, key: str | None) -> str:
    return key or spark.conf.get("spark.linkengine.pii.key", KEY)


def find_spans(docs: DataFrame, text: str = "text", key: str | None = None, spans: str = "spans") -> DataFrame:
    """``docs`` with a column ``spans``, an array of (value, kind, pseudonym) in text order; null where the text has none.

    ``spans`` must not be a column of ``docs`` yet.
    """
    if spans in docs.columns:
        raise ValueError(f"{spans} is a column already")
    own = chosen_key(docs.sparkSession, key)
    found = F.when(F.col(text).rlike(GATE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    one = lambda m: _let(kind_of(m), lambda k: F.struct(m.alias("value"), k.alias("kind"), pseudonym(m, k, own).alias("pseudonym")))
    return docs.withColumn(spans, F.when(F.size(found) > 0, F.transform(found, one)))


def replaced(text: str, spans: str) -> Column:
    """The text with its validated spans replaced."""
    between = F.split(F.col(text), PATTERN, -1)
    put = F.zip_with(between, spans, lambda t, s: F.concat(t, F.coalesce(s["pseudonym"], s["value"], F.lit(""))))
    return F.when(F.col(spans).isNotNull(), F.array_join(put, "")).otherwise(F.col(text))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced; all columns stay, in place, whatever their names.

    A null text stays null, an empty one empty, and a text of any length is read whole.  Rows are independent, so null and
    repeated ids, ties and repeated rows need no rule.  An empty table gives an empty result.
    """
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    out = find_spans(docs, text, key, spans)
    return out.select(*[replaced(text, spans).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def pii_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, n_found (validated spans), kinds (how many of each, as text) and the replaced text of every row.

    Null texts stay null with none found; texts of any length are read whole.  Rows are independent, so null and repeated ids,
    ties and repeated rows need no rule.  An empty table gives an empty result; extra columns are ignored.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    valid = F.filter("spans", lambda s: s["pseudonym"].isNotNull())
    kinds = F.array_sort(F.transform(valid, lambda s: s["kind"]))
    return find_spans(own, "text", key).select(
        "doc_id", F.coalesce(F.size(valid), F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("kinds"), replaced("text", "spans").alias("text"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
