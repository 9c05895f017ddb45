"""Personal data replaced by format-preserving pseudonyms, with built-in functions only.

Numbers, addresses and dates that pass their validation are permuted within their
format by a keyed Feistel network whose round function is a keyed SHA-256 digest:
equal values get equal pseudonyms in all documents, different values different
ones.  Mail addresses and secrets, which have no numeric format, get keyed
digests in their own shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, quoted

#: The key of tests; give your own to ``pseudonymise``.
KEY = "quillnet"
ROUNDS = 10

# What counts as a candidate; validation follows.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?=[0-9A-Fa-f]{32})(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
DATE = r"(?<![\d.\-/])(?:(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]\d\.[01]\d\.(?:19|20)\d\d|[0-3]\d/[0-3]\d/(?:19|20)\d\d)(?![\d\-/]|\.\d)"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<!\d)(?<!\d[.-])\d{3}([ .-])\d{3}\1\d{4}(?![\d]|[.-]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
NUMBER = r"(?<!\d)(?<!\d[.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\d]|[.-]\d)"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
# all but three begin with one of these letters, which spares most places the rest of the tests
ANY = f"{EMAIL}|{SECRET}|(?=[A-Z][A-Z][0-9]){IBAN}|(?=[0-9+(])(?:" + "|".join((DATE, ADDRESS, PHONE, SOCIAL, NUMBER)) + ")"
# what a candidate must be: cards by their issuers' first digits and lengths, social and phone numbers by the ranges that are given out
CARD = r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|6\d{15,18}"
SOCIAL_RANGE = r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}"
PHONE_RANGE = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+(?!1[ .(-]|1\d{10}$)[1-9](?:[ .()-]*\d){7,14}|\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]\d{4}"
HINT = r"[0-9@]|[A-Fa-f]{32}"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(kind: str, *parts: Column) -> Column:
    """A digest of a kind, which begins with the key, and of parts."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]), 256)


def _noise(kind: str, size: Column, *parts: Column) -> Column:
    """A keyed number from 0 to size - 1, from 60 bits of a digest."""
    return F.pmod(F.conv(F.substring(_digest(kind, *parts), 1, 15), 16, 10).cast("long"), size)


def feistel(kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Struct (a, b): the pair permuted among 0..left_size-1 x 0..right_size-1 by ROUNDS (even) rounds."""

    def step(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        return F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + _noise(kind, size, left_size, right_size, i, acc["b"]), size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""

    def whole(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        return let(F.struct(d.alias("d"), u.alias("u"), (n - u).alias("v"), _power(u).alias("p"), _power(n - u).alias("q")), halves)

    def halves(x: Column) -> Column:
        pair = feistel(kind, F.substring(x["d"], F.lit(1), x["u"]), F.substring(x["d"], x["u"] + 1, x["v"]), x["p"], x["q"])
        return let(pair, lambda y: F.concat(F.lpad(y["a"].cast("string"), x["u"], "0"), F.lpad(y["b"].cast("string"), x["v"], "0")))

    return let(digits, whole)


def luhn(digits: Column) -> Column:
    """The check digit that the Luhn rule gives to a string of digits."""

    def whole(d: Column) -> Column:
        n = F.length(d)

        def step(acc: Column, i: Column) -> Column:
            value = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
            return acc + let(value, lambda v: F.when(v > 9, v - 9).otherwise(v))

        return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step), F.lit(10))

    return let(digits, whole)


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by those given."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column, d: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(d, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))

    return let(digits, lambda d: F.aggregate(F.split(template, ""), start, lambda acc, c: step(acc, c, d))["s"])


def _number(m: Column, key: str) -> Column:
    """A card number of a known issuer whose check digit is right: its first digits stay, the last is the check digit, those between are permuted; other numbers stay."""

    def parts(d: Column) -> Column:
        head = F.when(d.startswith("2"), 4).when(d.startswith("30"), 3).when(d.rlike("^[35]"), 2).otherwise(1)
        good = d.rlike(f"^(?:{CARD})$") & (luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1).cast("int"))
        return F.struct(d.alias("d"), F.substring(d, F.lit(1), head).alias("head"), F.substring(d, head + 1, F.length(d) - head - 1).alias("body"), good.alias("good"))

    def new(x: Column) -> Column:
        made = let(F.concat(x["head"], permute_digits(f"{key}|number", x["body"])), lambda n: F.concat(n, luhn(n).cast("string")))
        return F.when(x["good"], refill(m, made)).otherwise(m)

    return let(let(F.regexp_replace(m, "[^0-9]", ""), parts), new)


def _social(m: Column, key: str) -> Column:
    """A social number of the ranges given out; its digits are permuted until they lie in them again."""

    def step(acc: Column, i: Column) -> Column:
        done = (i > 1) & acc.rlike(f"^(?:{SOCIAL_RANGE})$")
        return F.when(done, acc).otherwise(refill(acc, permute_digits(f"{key}|social", F.regexp_replace(acc, "[^0-9]", ""))))

    return F.when(~m.rlike(f"^(?:{SOCIAL_RANGE})$"), m).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(12)), m, step))


def _remainder(text: Column) -> Column:
    """Remainder modulo 97 of letters and digits, letters as the numbers from 10 on."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _account(m: Column, key: str) -> Column:
    """An account number whose check digits are right: country and letters stay, digits are permuted, check digits follow; others stay."""

    def new(plain: Column) -> Column:
        country, tail = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        digits = F.regexp_replace(tail, "[^0-9]", "")
        good = (_remainder(F.concat(tail, country, F.substring(plain, 3, 2))) == 1) & F.length(digits).between(2, 36)
        made = let(F.when(good, refill(tail, permute_digits(f"{key}|account", digits))), lambda t: F.concat(F.lpad((98 - _remainder(F.concat(t, country, F.lit("00")))).cast("string"), 2, "0"), F.regexp_replace(t, "[^0-9]", "")))
        return F.when(good, refill(m, made)).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), new)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted.  Numbers that no plan gives out stay."""

    def parts(head: Column) -> Column:
        rest = F.substring(m, F.length(head) + 1, F.length(m))
        return let(rest, lambda tail: F.concat(head, refill(tail, permute_digits(f"{key}|phone", F.regexp_replace(tail, "[^0-9]", "")))))

    return F.when(~m.rlike(f"^(?:{PHONE_RANGE})$"), m).otherwise(let(F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-]))?", 0), parts))


def _address(m: Column, key: str) -> Column:
    """An address of four octets is permuted among all addresses; other dotted numbers stay."""

    def octets(part: Column) -> Column:
        pair = feistel(f"{key}|address", part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536))
        new = let(pair, lambda y: F.concat_ws(".", *[x.cast("string") for x in (F.floor(y["a"] / 256), y["a"] % 256, F.floor(y["b"] / 256), y["b"] % 256)]))
        return F.when(F.exists(part, lambda x: x > 255), m).otherwise(new)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), octets)


#: Days from 1900-01-01 to 2099-12-31, and a product of two sizes that covers them.
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73049, 271


def _date(m: Column, key: str = KEY) -> Column:
    """A real date from 1900 to 2099 is permuted among these dates (the network is walked until it lands on one) and shown as it was.

    Parted by slashes, the month stands first where that makes a date.
    """
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]
    read = F.array(*[F.datediff(F.when(m.contains(f[2] if f[2] in "./" else "-"), F.try_to_date(m, f)), F.lit(FIRST_DAY).cast("date")) for f in forms])

    def walk(acc: Column, i: Column) -> Column:
        pair = feistel(f"{key}|date", F.floor(acc / SIDE), acc % SIDE, F.lit(SIDE), F.lit(SIDE))
        return F.when((i > 1) & (acc < DAYS), acc).otherwise(let(pair, lambda y: y["a"] * SIDE + y["b"]))

    def shown(days: Column) -> Column:
        day = F.coalesce(*[days[k] for k in range(len(forms))])
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(40)), day.cast("long"), walk)
        new = let(F.date_add(F.lit(FIRST_DAY).cast("date"), steps.cast("int")), lambda x: F.coalesce(*[F.when(days[k].isNotNull(), F.date_format(x, f)) for k, f in enumerate(forms)]))
        return F.when(day.isNull() | (day < 0) | (day >= DAYS), m).otherwise(new)

    return let(read, shown)


def _email(m: Column, key: str) -> Column:
    return let(_digest(f"{key}|mail", F.lower(m)), lambda d: F.concat(F.lit("u"), F.substring(d, 1, 12), F.lit("@m"), F.substring(d, 13, 8), F.lit(".invalid")))


def _secret(m: Column, key: str) -> Column:
    d = _digest(f"{key}|secret", F.lower(m))
    long = F.substring(F.concat(d, d), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(long)).otherwise(long)


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one candidate; a candidate that fails its validation stays as it is."""
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(full(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}"), _secret(m, key))
        .when(full(r"[A-Z]{2}\d\d[ 0-9A-Z]+"), _account(m, key))
        .when(full(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}"), _date(m, key))
        .when(full(r"\d{1,3}(?:\.\d{1,3}){3}"), _address(m, key))
        .when(full(r"\d{3}-\d{2}-\d{4}"), _social(m, key))
        .when(full(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5}"), _number(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The input's rows and columns with text pseudonymised, and n_replaced (in place of a column of that name).

    Null text stays null, with 0 replaced; empty text and text without candidates
    stay as they are; texts of any length are read whole.  Of candidates that
    overlap the first counts.  Equal values get equal pseudonyms under one key,
    so repeated rows give equal rows.  An empty table gives no rows; other columns
    stay as they are, whatever their names.
    """
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    rest = others(docs, "n_replaced")
    own = quoted(rest)
    step = docs.select(*own, found.alias("_qn_found"))
    step = step.select(*own, "_qn_found", F.when(F.size("_qn_found") > 0, F.transform("_qn_found", lambda m: pseudonym(m, key))).alias("_qn_new"))
    pieces = F.split("text", ANY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(pieces, "_qn_new", lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))))
    text = F.when(F.col("_qn_new").isNull(), F.col("text")).otherwise(joined)
    changed = F.coalesce(F.size(F.filter(F.arrays_zip("_qn_found", "_qn_new"), lambda x: x["_qn_found"] != x["_qn_new"])), F.lit(0))
    return step.select(*[text.alias(c) if c.lower() == "text" else col for c, col in zip(rest, own, strict=True)], F.greatest(F.when(F.col("_qn_new").isNull(), 0).otherwise(changed), F.lit(0)).cast("long").alias("n_replaced"))
