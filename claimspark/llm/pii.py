"""Format-preserving pseudonyms for personal data, in column expressions only.

Numbers and dates that pass their own check are permuted within their format by a keyed Feistel network, so a
pseudonym is as valid as the value was and equal values stay equal across documents; the key's holder can turn them
back. A value is read as a pair (l, r) of two residues; each round adds a keyed digest of one to the other, which
is a permutation whatever the two moduli are, so no value has to be walked back into its format.

| kind | check | permuted |
|-|-|-|
| card | 13 to 19 digits, perhaps grouped, the first from 2 to 6, with a Luhn check digit, wherever they are in a run of groups | all digits but the first and last; the check digit is renewed |
| iban | two letters, two digits and the country's number of letters or digits, or 11 to 30 in groups of four; the remainder by 97 | the digits of the account; the check digits are renewed |
| phone | North American: three, three and four digits, perhaps after a 1 and in brackets, or +1 and ten digits | all three; an issued number (area and exchange begin with 2 to 9) stays one |
| world_phone | + or 00 and 8 to 15 digits, perhaps parted, that do not begin with 0 or 1 | all digits after the first three |
| ip | four numbers up to 255 without leading zeros | all four |
| ipv6 | eight groups, or fewer about one ::, three at least and one of them a number | all groups after the first |
| ssn | three, two and four digits in the issued ranges | all three |
| date | a day from 1700 to 2099: year-month-day, day.month.year, month/day/year, or day/month/year where no month is above 12 | the day, among those that read the same way |

Mail addresses, access keys and assigned secrets have no number to permute: their secret part is replaced by as many
characters of a keyed digest, so that equal values stay equal too. A bare run of ten digits has no check and stays.

Groups of digits beside a card number (its expiry, its code, a count before it) don't hide it: from each group of a run on, every length is tried, 16 digits
first, as most numbers have. A run with such neighbours can by chance, one in ten for each other reading, be read otherwise after the change; it is then
hidden all the same but doesn't turn back.

No pattern repeats a group without bound in a way that Java's matcher recurses on (possessive repeats), and each alternative starts with a
test of one character, so a text of any length and alphabet takes one linear scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import place, plain_names, restored
from claimspark.session import table

ROUNDS = 8
#: The key of the registered query; a deployment passes its own.
DEMO_KEY = "demonstration key, not a secret"

#: The number of characters of a bank account's number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20, "YE": 30,
}
#: Lengths of card numbers in the order in which they are tried.
CARD_LENGTHS = (16, 15, 14, 19, 18, 17, 13)
#: A group of digits of a run, and one that begins a run of 13 digits at least.
GROUP_ON = r"\d{3,19}+(?!\w)"
GROUP = r"(?=(?:[ -]?\d){13})" + GROUP_ON


def _of_countries() -> str:
    """One alternative for each length, so that words behind an account's number are not taken for part of it."""
    lengths = sorted(set(IBAN_LENGTHS.values()))
    return "|".join(rf"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == length)})\d{{2}}(?: ?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])" for length in lengths)


KINDS: dict[str, str] = {
    "email": r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++",
    "secret": r"(?i:password|passwd|token|secret|api_?key)\s*+[=:]\s*+\"?[A-Za-z0-9+/_-]{6,}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{_of_countries()}|[A-Z]{{2}}\d{{2}}(?:(?: (?![A-Z]{{2}}\d{{2}}))?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:.])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:.])",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10})(?![\w-])",
    "world_phone": r"(?<![\w+])(?:\+|00)[2-9](?:[ .-]?\(?\d\)?){7,14}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})(?!\w|\.\d)",
    "date": r"(?<![\w/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!(?!T\d\d:)[\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": rf"(?<![\w.]){GROUP}(?:[ -](?!\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|\d{{4}}-\d\d-\d\d|\d{{3}}-\d\d-\d{{4}}){GROUP_ON})*+(?:[ -]\d{{1,2}}(?!\w))?+|(?<![\w.-])[2-6](?:(?:[ -](?!{GROUP}))?\d){{12,18}}(?![\w-])",
}
#: The characters that a kind can begin with; others fail after one test.
BEGINS = {
    "[(+0-9]": ["phone", "world_phone", "ip", "date", "ssn", "card"],
    "[A-Z]": ["access_key", "iban"],
    "[PpTtSsAa]": ["secret"],
    "[0-9A-Fa-f]": ["ipv6"],
    "[\\w.+-]": ["email"],
}
PATTERN = "|".join(f"(?={first})(?:{'|'.join(KINDS[k] for k in kinds)})" for first, kinds in BEGINS.items())


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest_number(key: str, kind: str | Column, step: Column, value: Column) -> Column:
    """48 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), step.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: int | Column, b: int | Column, key: str, kind: str | Column, reverse: bool, use: Callable[[Column, Column], Column]) -> Column:
    """use(l, r) of the keyed permutation of pairs of a residue of a and one of b."""
    sign = -1 if reverse else 1
    steps = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if reverse else range(ROUNDS))])
    named = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), named(a).alias("a"), named(b).alias("b"))

    def turn(pair: Column, step: Column) -> Column:
        """The half to change comes first, and the halves change places after each round."""
        change, other = ("r", "l") if reverse else ("l", "r")
        m, o = ("b", "a") if reverse else ("a", "b")
        new = F.pmod(pair[change] + sign * F.pmod(digest_number(key, kind, step, pair[other]), pair[m]), pair[m])
        return F.struct(pair[other].alias("l"), new.alias("r"), pair[o].alias("a"), pair[m].alias("b")) if not reverse else F.struct(new.alias("l"), pair[other].alias("r"), pair[m].alias("a"), pair[o].alias("b"))

    return bind(F.aggregate(steps, start, turn), lambda pair: use(pair["l"], pair["r"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def number(value: Column, start: int, length: int) -> Column:
    return F.substring(value, start, length).cast("long")


def padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def refilled(template: Column, digits: Column, what: str = "[0-9]") -> Column:
    """The template with its digits (or what else matches `what`) replaced in order."""

    def put(done: Column, i: Column) -> Column:
        c = F.substring(template, i, F.lit(1))
        new = c.rlike(what)
        return F.struct(F.concat(done["out"], F.when(new, F.substring(digits, done["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), F.when(new, done["k"] + 1).otherwise(done["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(template)), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put)["out"]


def luhn_sum(digits: Column, last_weight: int) -> Column:
    """The Luhn sum of a string of digits whose last digit weighs `last_weight` (1 or 2)."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, last_weight).otherwise(3 - last_weight)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def permuted_digits(digits: Column, kind: str, key: str, reverse: bool, use: Callable[[Column], Column]) -> Column:
    """use() of a permutation of the strings of digits of this length (2 to 30), in two halves of up to 15."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    part = lambda start, n: F.substring(digits, start, n).cast("long")
    joined = lambda l, r: use(F.concat(F.lpad(l.cast("string"), a, "0"), F.lpad(r.cast("string"), b, "0")))  # noqa: E731, E741
    return feistel(part(F.lit(1), a), part(a + 1, b), power(a), power(b), key, F.concat(F.lit(kind), F.length(digits).cast("string")), reverse, joined)


def card(value: Column, key: str, reverse: bool) -> Column:
    """A number that is known to be one."""
    digits = digits_of(value)

    def renewed(inner: Column) -> Column:
        return bind(F.concat(F.substring(digits, 1, 1), inner), lambda new: refilled(value, F.concat(new, F.pmod(10 - F.pmod(luhn_sum(new, 2), F.lit(10)), F.lit(10)).cast("string"))))

    return permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), "card", key, reverse, renewed)


def cards(run: Column, key: str, reverse: bool) -> Column:
    """A struct (text, n) of a run of groups of digits: its n card numbers replaced, from the left.

    Each group begins at most one number, found by itself; numbers are then taken from left to right. A block of text is handed on whole, so a run
    of any length takes time in proportion.
    """
    groups = F.regexp_extract_all(run, F.lit("([ -]?[0-9]+)"), F.lit(1))
    few = F.when(F.length(run) <= 40, 19).otherwise(6)  # groups of three digits at least, but for short runs

    def found(t: Column, i: Column) -> Column:
        """(length, groups) of the number that begins with group i, both 0 without."""
        part = F.slice(t, i + 1, few)
        ends = F.transform(F.sequence(F.lit(1), F.size(part)), lambda k: F.length(digits_of(F.array_join(F.slice(part, F.lit(1), k), ""))))
        none = F.struct(F.lit(0).alias("length"), F.lit(0).alias("groups"))

        def tried(x: Column) -> Column:
            fits = lambda n: F.array_contains(x["ends"], n) & (F.pmod(luhn_sum(F.substring(x["digits"], F.lit(1), n), 1), F.lit(10)) == 0)
            return bind(F.get(F.filter(F.array(*[F.lit(n) for n in CARD_LENGTHS]), fits), 0), lambda n: F.when(n.isNull(), none).otherwise(F.struct(n.alias("length"), F.array_position(x["ends"], n).cast("int").alias("groups"))))

        begins = F.get(t, i).rlike("^[ -]?[2-6]")
        return F.when(begins, bind(F.struct(ends.alias("ends"), digits_of(F.array_join(part, "")).alias("digits")), tried)).otherwise(none)

    def take(t: Column, numbers: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            here = F.get(numbers, i)["groups"]
            free = i >= s["next"]
            new = F.when(free & (here > 0), card(F.array_join(F.slice(t, i + 1, here), ""), key, reverse)).when(free, F.get(t, i)).otherwise("")
            return bind(F.concat(s["block"], new), lambda block: F.struct(
                F.when(F.length(block) > 400, F.concat(s["done"], F.array(block))).otherwise(s["done"]).alias("done"), F.when(F.length(block) > 400, "").otherwise(block).alias("block"),
                F.when(free & (here > 0), i + here).otherwise(s["next"]).alias("next"), (s["n"] + F.when(free & (here > 0), 1).otherwise(0)).alias("n"),
            ))

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("block"), F.lit(0).alias("next"), F.lit(0).alias("n"))
        end = lambda s: F.struct(F.concat(F.array_join(s["done"], ""), s["block"]).alias("text"), s["n"].alias("n"))
        any_ = F.exists(numbers, lambda x: x["groups"] > 0)
        return F.when(any_, F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, end)).otherwise(F.struct(run.alias("text"), F.lit(0).alias("n")))

    return bind(groups, lambda t: bind(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: found(t, i)), lambda numbers: take(t, numbers)))


def world_phone(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    digits = digits_of(value)
    new = permuted_digits(F.substring(digits, F.lit(4), F.length(digits) - 3), "phone", key, reverse, lambda rest: refilled(value, F.concat(F.substring(digits, 1, 3), rest)))
    return F.length(digits).between(8, 15), new


def phone(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    digits = digits_of(value)
    ten = F.substring(digits, F.length(digits) - 9, F.lit(10))
    area, exchange = number(ten, 1, 3), number(ten, 4, 3)
    # 800 * 800 pairs are issued; the others are 200 areas with 1000 exchanges, then 800 areas with 200.
    issued = (area >= 200) & (exchange >= 200)
    other = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    l = F.when(issued, (area - 200) * 800 + exchange - 200).otherwise(other)  # noqa: E741

    def renewed(at: Column, line: Column) -> Column:
        new_area = F.when(issued, (at / 800).cast("long") + 200).when(at < 200_000, (at / 1000).cast("long")).otherwise(((at - 200_000) / 200).cast("long") + 200)
        new_exchange = F.when(issued, F.pmod(at, F.lit(800)) + 200).when(at < 200_000, F.pmod(at, F.lit(1000))).otherwise(F.pmod(at, F.lit(200)))
        return refilled(value, F.concat(F.when(F.length(digits) == 11, "1").otherwise(""), padded(new_area, 3), padded(new_exchange, 3), padded(line, 4)))

    return F.length(digits).between(10, 11), feistel(l, number(ten, 7, 4), F.when(issued, 640_000).otherwise(360_000), 10_000, key, "phone", reverse, renewed)


def ip(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    valid = F.forall(parts, lambda p: p <= 255)
    at = lambda i: F.get(parts, F.lit(i))
    of = lambda x: [F.shiftright(x, 8).cast("string"), F.pmod(x, F.lit(256)).cast("string")]
    return valid, feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), 65_536, 65_536, key, "ip", reverse, lambda l, r: F.concat_ws(".", *of(l), *of(r)))


def remainder_97(letters: Column) -> Column:
    """The remainder by 97 of a string of digits and capital letters, A being 10."""

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(letters, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0), add)


def iban(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    squeezed = F.regexp_replace(value, " ", "")
    country, check, account = F.substring(squeezed, 1, 2), F.substring(squeezed, 3, 2), F.substring(squeezed, F.lit(5), F.length(squeezed))
    checked = lambda acc: padded(98 - remainder_97(F.concat(acc, country, F.lit("00"))), 2)
    digits = digits_of(account)

    def renewed(new: Column) -> Column:
        return bind(refilled(account, new), lambda acc: refilled(value, F.concat(F.lit(""), checked(acc), digits_of(acc))))

    valid = F.length(squeezed).between(15, 34) & F.length(digits).between(4, 30) & (checked(account) == check)
    return valid, permuted_digits(digits, "iban", key, reverse, renewed)


def ipv6(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    groups = F.filter(F.split(F.lower(value), ":"), lambda g: g != "")
    head, tail = F.get(groups, F.lit(0)), F.array_join(F.slice(groups, F.lit(2), F.size(groups) - 1), "")
    n = F.length(tail)
    a = F.floor(n / 2).cast("int")
    part = lambda start, many: F.conv(F.substring(tail, start, many), 16, 10).cast("long")
    size = lambda k: F.pow(F.lit(16.0), k).cast("long")
    back = lambda half, k: F.lpad(F.lower(F.conv(half.cast("string"), 10, 16)), k, "0")

    def renewed(l: Column, r: Column) -> Column:  # noqa: E741
        return bind(F.concat(head, back(l, a), back(r, n - a)), lambda new: bind(refilled(value, new, "[^:]"), lambda out: F.when(value.rlike("[A-F]"), F.upper(out)).otherwise(out)))

    valid = F.size(groups).between(3, 8) & ((F.size(groups) == 8) == ~value.contains("::")) & value.rlike("[0-9]") & (n >= 2)
    return valid, feistel(part(F.lit(1), a), part(a + 1, n - a), size(a), size(n - a), key, F.concat(F.lit("ipv6-"), n.cast("string")), reverse, renewed)


def ssn(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    area, group, serial = number(value, 1, 3), number(value, 5, 2), number(value, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    def renewed(l: Column, r: Column) -> Column:  # noqa: E741
        new = (l / 99).cast("long") + 1
        return F.concat_ws("-", padded(new + F.when(new >= 666, 1).otherwise(0), 3), padded(F.pmod(l, F.lit(99)) + 1, 2), padded(r + 1, 4))

    return valid, feistel((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn", reverse, renewed)


#: The last days of months other than February, whose number only a day can be.
LATE_DAYS = [(month, day) for month in range(1, 13) if month != 2 for day in (29, 30, 31) if day < 31 or month not in (4, 6, 9, 11)]


def date(value: Column, key: str, reverse: bool) -> tuple[Column, Column]:
    """Days from 1700 to 2099, read as year-month-day, day.month.year, month/day/year or else day/month/year. The last are
    permuted among themselves, so that they turn back: days up to 28 by month and day, the 29th to 31st of other months than February
    by year and place in a list, 29 February by leap year."""
    forms = {"yyyy-MM-dd": value.contains("-"), "dd.MM.yyyy": value.contains("."), "MM/dd/yyyy": value.contains("/")}
    first = F.to_date(F.lit("1700-01-01"))
    day = F.coalesce(*[F.try_to_timestamp(value, F.lit(form)) for form in forms]).cast("date")
    other = F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).cast("date")

    def renew(day: Column, other: Column) -> Column:
        index = F.date_diff(day, first)
        y, m, d = F.year(other), F.month(other), F.dayofmonth(other)
        late = F.array(*[F.lit(a * 100 + b) for a, b in LATE_DAYS])
        plain, usual, leap = day.isNotNull(), d <= 28, m == 2
        pick = lambda *x: F.when(plain, x[0]).when(usual, x[1]).when(leap, x[2]).otherwise(x[3])
        # 400 years are 189 * 773 days. Of the years from 1704 on that 4 divides, 1800 and 1900 are no leap years.
        left = pick((index / 773).cast("int"), (y - 1700) * 12 + m - 1, ((y - 1704) / 4).cast("int") - F.when(y > 1900, 2).when(y > 1800, 1).otherwise(0), y - 1700)
        right = pick(F.pmod(index, F.lit(773)), d - 13, F.lit(0), (F.array_position(late, m * 100 + d) - 1).cast("int"))

        def renewed(l: Column, r: Column) -> Column:  # noqa: E741
            new = F.date_add(first, (l * 773 + r).cast("int"))
            end = F.get(late, r.cast("int"))
            written = lambda d, m, y: F.concat_ws("/", padded(d, 2), padded(m, 2), y.cast("string"))
            return pick(
                F.coalesce(*[F.when(test, F.date_format(new, form)) for form, test in forms.items()]),
                written(r + 13, F.pmod(l, F.lit(12)) + 1, F.floor(l / 12) + 1700),
                written(F.lit(29), F.lit(2), 1704 + 4 * (l + F.when(l >= 48, 2).when(l >= 24, 1).otherwise(0))),
                written(F.pmod(end, F.lit(100)), F.floor(end / 100), l + 1700),
            )

        kind = F.when(plain, "date").otherwise("day")
        return feistel(left, right, pick(F.lit(189), F.lit(4800), F.lit(97), F.lit(400)), pick(F.lit(773), F.lit(16), F.lit(1), F.lit(len(LATE_DAYS))), key, kind, reverse, renewed)

    valid = F.coalesce(F.year(F.coalesce(day, other)).between(1700, 2099), F.lit(False))
    return valid, bind(F.struct(day.alias("day"), other.alias("other")), lambda x: renew(x["day"], x["other"]))


def digest_like(value: Column, key: str, kind: str) -> Column:
    """As many hexadecimal characters of keyed digests as the value is long."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int"))
    text = F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value), 256)), "")
    return F.substring(text, F.lit(1), F.length(value))


def email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    return F.concat(digest_like(F.lower(name), key, "email"), F.substring(value, F.length(name) + 1, F.length(value)))


def secret(value: Column, key: str) -> Column:
    hidden = F.regexp_extract(value, r"([A-Za-z0-9+/_-]+)$", 1)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(hidden)), digest_like(hidden, key, "secret"))


def access_key(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), F.upper(digest_like(F.substring(value, 5, 16), key, "access_key")))


PERMUTED: dict[str, Callable] = {"iban": iban, "ipv6": ipv6, "phone": phone, "world_phone": world_phone, "ip": ip, "date": date, "ssn": ssn}


def replacement(value: Column, key: str, reverse: bool = False) -> Column:
    """A struct (kind, text, n) for a match of PATTERN: kind is null and text the value itself if its check fails; n is how many values of the kind it holds."""
    found = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"), F.lit(0).alias("n"))
    for kind in reversed(KINDS):
        test, is_kind = value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind).alias("kind")
        if kind == "card":
            run = bind(cards(value, key, reverse), lambda x: F.struct(F.when(x["n"] > 0, F.lit("card")).alias("kind"), x["text"].alias("text"), x["n"].alias("n")))
            found = F.when(test, run).otherwise(found)
            continue
        if kind in PERMUTED:
            valid, new = PERMUTED[kind](value, key, reverse)
        else:
            valid, new = F.lit(not reverse), {"email": email, "secret": secret, "access_key": access_key}[kind](value, key)
        found = F.when(test & valid, F.struct(is_kind, F.coalesce(new, value).alias("text"), F.lit(1).alias("n"))).otherwise(found)
    return found


def pseudonymize(docs: DataFrame, key: str, *, text_col: str = "text", reverse: bool = False) -> DataFrame:
    """docs with `text_col` pseudonymised and pii_kinds, the array of the kinds replaced in order.

    A null text stays null with no kinds, an empty one empty. A column of docs called pii_kinds is replaced;
    rows are neither dropped nor merged. With reverse, numbers and dates turn back under the same key.
    """
    mine, at = plain_names(docs), place(docs, text_col)
    text = F.col(at).cast("string")
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    made = F.transform(matches, lambda m: replacement(m, key, reverse))
    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.transform(F.col("made"), lambda m: m["text"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = F.exists("made", lambda m: m["kind"].isNotNull())
    kinds = F.flatten(F.transform(F.filter("made", lambda m: m["kind"].isNotNull()), lambda m: F.array_repeat(m["kind"], m["n"])))
    none = F.array().cast("array<struct<kind:string,text:string,n:int>>")
    found = mine.withColumn("made", F.when(text.rlike(PATTERN), made).otherwise(none))
    return restored(found.withColumn(at, F.when(changed, joined).otherwise(text)).withColumn("pii_kinds", kinds), docs, "pii_kinds")


def hide(docs: DataFrame, key: str, *, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the text pseudonymised and its number of characters, where it is known, counted anew; all else as it was."""
    out = restored(pseudonymize(plain_names(docs), key, text_col=place(docs, text_col)), docs)
    known = [f for f in docs.schema.fields if f.name.lower() == chars_col.lower()]
    return out.withColumns({f.name: F.when(F.col(f.name).isNotNull(), F.length(text_col)).cast(f.dataType) for f in known}) if known else out


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).alias(f"n_{kind}")
    return pseudonymize(docs, DEMO_KEY).select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), *[count(k) for k in KINDS])
