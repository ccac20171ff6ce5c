"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass their kind's validation are permuted, under a secret key, within the set of valid values
of the same format, by an alternating Feistel network over decimal halves.  Equal values get equal pseudonyms in every
document, so records stay linked; the layout (separators, length) stays.  E-mail addresses keep their domain, and
their local part becomes a keyed digest.

Null text: null stays null, with counts 0.  Empty text stays.  Rows repeated: each by itself.  Very long texts are
handled whole.  Values that fail validation stay.  Columns of the input named as a count (``n_card`` and so on) are
replaced by the count; all others stay.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "card", "phone", "ssn", "ip", "date")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: Cards as they are written: unbroken, 4-4-4-4, 4-6-5 and 4-6-4 digits; found at every place, overlaps too.
GROUPED = r"(?<![0-9])(?=([0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9]))"
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
N_DAYS = 73_049


def bind(value: Column, function) -> Column:
    """``function(value)`` with ``value`` computed once, however often the function names it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def round_value(key: Column, width: Column, number: Column, half: Column) -> Column:
    """A keyed pseudo-random long below 16**15 for one round."""
    said = F.concat_ws("|", key, width.cast("string"), number.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def power10(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**k).cast("long") for k in range(10))), (n + 1).cast("int"))


def permuted_digits(text: Column, tweak: str, key: Column) -> Column:
    """A string of 2 to 18 digits permuted among the strings of its length."""
    return bind(text, lambda t: _permuted(t, tweak, key))


def _permuted(text: Column, tweak: str, key: Column) -> Column:
    n = F.length(text)
    left = F.floor(n / 2).cast("int")
    label = F.concat(F.lit(f"{tweak}:"), n.cast("string"))
    start = F.struct(F.substr(text, F.lit(1), left).cast("long").alias("a"), F.substr(text, left + 1, n).cast("long").alias("b"))

    def step(s: Column, k: Column) -> Column:
        a = F.when(k % 2 == 0, (s["a"] + round_value(key, label, k, s["b"])) % power10(left)).otherwise(s["a"])
        b = F.when(k % 2 == 1, (s["b"] + round_value(key, label, k, s["a"])) % power10(n - left)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return bind(done, lambda d: F.concat(F.lpad(d["a"].cast("string"), left, "0"), F.lpad(d["b"].cast("string"), n - left, "0")))


def permuted_below(value: Column, size: int, tweak: str, key: Column, also=lambda x: F.lit(True)) -> Column:
    """A number in [0, ``size``) permuted there: the digit permutation is repeated until it falls into the range.

    With ``also``, the range is the numbers in it for which ``also`` holds.

    Cycle walking ends at a value in range, for the starting value is in range itself and permutations are cycles.
    The ranges used here fill at least 0.4 of their power of ten, so the odds of more than 64 steps are below 1e-14.
    """
    width = len(str(size - 1))
    pad = lambda x: F.lpad(x.cast("string"), width, "0")
    first = permuted_digits(pad(value), tweak, key).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda x, _: F.when((x < size) & also(x), x).otherwise(permuted_digits(pad(x), tweak, key).cast("long")))


def luhn_sum(text: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    return bind(text, _luhn)


def _luhn(text: Column) -> Column:
    n = F.length(text)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(text, n - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def relaid(value: Column, new_digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``new_digits``."""
    return bind(new_digits, lambda d: _relaid(value, d))


def _relaid(value: Column, new_digits: Column) -> Column:
    chars = F.split(value, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(new_digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(chars, start, step)["out"]


def iso_date(value: Column) -> Column:
    """A match of ``DATE`` as yyyy-MM-dd, day first unless only month first is a date; null where neither is."""
    first, second, year = value.substr(1, 2), value.substr(4, 2), value.substr(7, 4)
    said = F.when(value.substr(5, 1) == "-", F.array(value)).otherwise(F.array(F.concat_ws("-", year, second, first), F.concat_ws("-", year, first, second)))
    return F.get(F.filter(said, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull()), F.lit(0))


def kind_of(value: Column) -> Column:
    """The kind of a match of ``any_value`` that passes validation, else null."""
    plain = digits(value)
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(whole(IP), F.lit("ip"))
        .when(whole(DATE), F.when(iso_date(value).isNotNull(), F.lit("date")))
        .when(whole(SSN), F.when(~plain.rlike("^(000|666|9..)|^...00|0000$"), F.lit("ssn")))
        .when(whole(PHONE), F.lit("phone"))
        .when(whole(CARD), F.when(luhn_sum(plain) % 10 == 0, F.lit("card")))
    )


def last_of_overlapping(text: Column, cards: Column) -> Column:
    """``cards`` without those of 4-4-4-4 digits in which, somewhere in ``text``, another one begins: the later one is taken."""
    starts_inside = lambda c, d, k: F.startswith(d, F.substr(c, k + 1)) & F.contains(text, F.concat(F.substr(c, F.lit(1), k), d))
    inside = lambda c: F.exists(cards, lambda d: (c != d) & F.exists(F.array(*map(F.lit, (5, 10, 15))), lambda k: starts_inside(c, d, k)))
    return F.filter(cards, lambda c: ~((F.length(c) == 19) & inside(c)))


def any_value(text: str) -> Column:
    """The pattern of all kinds for a row's text; earlier kinds win where two could begin at one place.

    Grouped cards that pass Luhn are named in the pattern itself.  No phone, social security number or free run of
    digits may reach into one of these, nor a free run into a value of another kind, so neighbouring digits hide none.
    """
    grouped = F.array_distinct(F.regexp_extract_all(text, F.lit(GROUPED), F.lit(1)))
    valid = bind(F.filter(grouped, lambda c: luhn_sum(digits(c)) % 10 == 0), lambda v: F.when(F.size(v) > 1, last_of_overlapping(F.col(text), v)).otherwise(v))
    valid = F.array_join(valid, "|")
    # (?!) matches nowhere
    cards = F.concat(F.lit("(?<![0-9])(?:"), F.when(valid == "", F.lit("(?!)")).otherwise(valid), F.lit(")(?![0-9])"))
    last_four = "[0-9]{4}(?!"
    ssn, phone = ([F.lit(x) for x in p.rsplit(last_four, 1)] for p in (SSN, PHONE))
    free = [F.lit(f"(?<![0-9])[0-9](?:[0-9]|[ -](?!{IP}|{DATE}|{SSN}|{PHONE}|"), cards, F.lit(")[0-9]){12,18}(?![0-9])")]
    guard = [F.lit("(?!"), cards, F.lit(f"){last_four}")]
    return F.concat(F.lit(f"{EMAIL}|{IP}|{DATE}|"), cards, F.lit("|"), ssn[0], *guard, ssn[1], F.lit("|"), phone[0], *guard, phone[1], F.lit("|"), *free)


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a match; a match that fails validation stays as it is."""
    return bind(F.struct(kind_of(value).alias("kind"), digits(value).alias("plain")), lambda s: _pseudonym(value, s["kind"], s["plain"], key))


def _pseudonym(value: Column, kind: Column, plain: Column, key: Column) -> Column:
    body = permuted_digits(F.substr(plain, F.lit(1), F.length(plain) - 1), "card", key)
    card = bind(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    # area and exchange begin with 2 to 9: their first digits are permuted among eight, the other eight among 10**8
    ten = F.substr(plain, F.length(plain) - 9, F.lit(10))
    lead = permuted_below((F.substr(ten, F.lit(1), F.lit(1)).cast("int") - 2) * 8 + F.substr(ten, F.lit(4), F.lit(1)).cast("int") - 2, 64, "lead", key)
    rest = permuted_digits(F.concat(F.substr(ten, F.lit(2), F.lit(2)), F.substr(ten, F.lit(5), F.lit(6))), "phone", key)
    new_ten = F.concat((F.floor(lead / 8) + 2).cast("string"), F.substr(rest, F.lit(1), F.lit(2)), (lead % 8 + 2).cast("string"), F.substr(rest, F.lit(3), F.lit(6)))
    phone = F.concat(F.substr(plain, F.lit(1), F.length(plain) - 10), new_ten)
    area = permuted_below(F.substr(plain, F.lit(1), F.lit(3)).cast("int") - 1 - F.when(F.substr(plain, F.lit(1), F.lit(3)).cast("int") > 666, 1).otherwise(0), 898, "area", key)
    area = area + 1 + F.when(area + 1 >= 666, 1).otherwise(0)
    group = permuted_below(F.substr(plain, F.lit(4), F.lit(2)).cast("int") - 1, 99, "group", key) + 1
    serial = permuted_below(F.substr(plain, F.lit(6), F.lit(4)).cast("int") - 1, 9999, "serial", key) + 1
    ssn = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))
    parts = F.split(value, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    address = permuted_below(number, 2**32, "ip", key)
    ip = F.concat_ws(".", *(F.floor(address / 256**k).cast("long").bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)))
    is_iso = value.substr(5, 1) == "-"
    start = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(F.to_date(iso_date(value), "yyyy-MM-dd"), start)
    # dates that can only be month first are permuted among themselves, so no two values get one pseudonym
    month_first = ~is_iso & (value.substr(4, 2).cast("int") > 12)
    day = F.when(month_first, permuted_below(number, N_DAYS, "month first", key, lambda x: F.dayofmonth(F.date_add(start, x.cast("int"))) > 12)).otherwise(permuted_below(number, N_DAYS, "date", key))
    new_day = F.date_add(start, day.cast("int"))
    date = F.when(is_iso, F.date_format(new_day, "yyyy-MM-dd")).otherwise(relaid(value, F.when(month_first, F.date_format(new_day, "MMddyyyy")).otherwise(F.date_format(new_day, "ddMMyyyy"))))
    local = F.concat(F.lit("p"), F.substring(F.sha2(F.concat(key, F.lit("|email|"), F.lower(F.split_part(value, F.lit("@"), F.lit(1)))), 256), 1, 24))
    email = F.concat(local, F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))
    return (
        F.when(kind == "email", email)
        .when(kind == "card", relaid(value, card))
        .when(kind == "phone", relaid(value, phone))
        .when(kind == "ssn", ssn)
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .otherwise(value)
    )


def count_of(kinds: str, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda x: x == kind)).cast("long")


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymised and the number of replaced values by kind in ``n_email``, ``n_card``, ..."""
    if not key:
        raise ValueError("pseudonyms need a key")
    secret = F.lit(key)
    # the document's own columns lie in ``doc``, so that none of them can clash with those used here
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("whole"))
    rows = rows.withColumn("any", F.when(F.col("whole").rlike("[0-9@]"), any_value("whole")))
    rows = rows.withColumn("hits", F.coalesce(F.regexp_extract_all("whole", F.col("any"), F.lit(0)), F.array().cast("array<string>")))
    pieces = F.split("whole", F.col("any"), -1)
    new = F.transform("hits", lambda v: pseudonym(v, secret))
    joined = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, v: F.array(F.coalesce(p, F.lit("")), F.coalesce(v, F.lit(""))))), "")
    rows = rows.withColumn("kinds", F.transform("hits", kind_of)).withColumn("whole", F.when(F.size("hits") > 0, joined).otherwise(F.col("whole")))
    made = {text: F.col("whole")} | {f"n_{k}": count_of("kinds", k) for k in KINDS}
    return rows.select(*(made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns), *(made[c].alias(c) for c in made if c not in docs.columns))
