r"""Operator 7: personal data replaced by format-preserving Feistel pseudonyms.

Found are e-mail addresses (letters of any script), phone numbers (national, and international ones after a plus sign),
payment-card numbers (13 to 19 digits that pass the Luhn test, also as whole groups of a longer run), social-security numbers,
IBANs (mod-97 test), IPv4 addresses (octets to 255), IPv6 addresses and dates (that exist, years 1 to 9600). A value is permuted
by a keyed Feistel network within its format: strings keep the class of every character (digit, lower, upper, other), card
numbers and IBANs keep valid check digits, addresses stay addresses, dates stay dates of the same notation within their 400
years. Being permutations under one key, equal values get equal pseudonyms in all documents, and different values different ones.
A phone number is its country code and the digits after it, in whatever notation: numbers written without a code have that of
North America; ten digits without any sign between them are taken for no phone number, as most such numbers are none.

The key is the setting ``tessella.pii.secret`` of the session. Where it is unset, one is drawn at random for the session, so that
pseudonyms are linked within it only. Rounds are SHA-256 digests of key, round and half; no plan holds the key.

Defined results: null text stays null; text without findings stays as it is; values that fail their test stay; repeated rows
are treated alike; texts may be of any length; other columns of docs are kept, whatever their names (``pseudonymised``).
Expressions are built-in SQL functions only.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, only, whole_rows

KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:.])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "international": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,5}){2,5}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
ANY = "|".join(KINDS.values())
#: 400 Gregorian years have 189 x 773 days; dates are permuted within the 400 years they are in, counted from FIRST, for CYCLES of them.
DAYS, FIRST, CYCLES = (189, 773), "0001-01-01", 24
ROUNDS = 8
#: The setting of the key; its name is one that Spark's own redaction covers.
SETTING = "tessella.pii.secret"
#: Country codes of one and two digits (all others have three), and the code of numbers written without one.
COUNTRY, HOME = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})", "1"
#: Kinds that are one value in several notations share a key.
SAME = {"international": "phone"}


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _round(key: Column, *parts: Column) -> Column:
    """The keyed function of a round: a digest that gives neither the key nor its other values away."""
    return F.sha2(F.concat_ws("/", key, *(p.cast("string") for p in parts)).cast("binary"), 256)


def _shifted(s: Column, mask: Column) -> Column:
    """Each letter and digit of s moved within its class by an amount that (mask, place) decides."""

    def one(c: Column, i: Column) -> Column:
        move = lambda first, n: F.chr(F.ascii(F.lit(first)) + (F.ascii(c) - F.ascii(F.lit(first)) + F.pmod(F.xxhash64(mask, i), F.lit(n))) % n)
        return F.when(c.between("0", "9"), move("0", 10)).when(c.between("a", "z"), move("a", 26)).when(c.between("A", "Z"), move("A", 26)).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def feistel(s: Column, key: Column) -> Column:
    """A permutation of the ASCII strings with the same class of character in each place."""
    return let(s, lambda v: _feistel(v, key))


def _feistel(s: Column, key: Column) -> Column:
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    turn = lambda x, r: F.struct(x["b"].alias("a"), let(_round(key, r, F.length(s), x["b"]), lambda mask: _shifted(x["a"], mask)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: F.concat(x["a"], x["b"]))


def feistel_number(n: Column, left: int, right: int, key: Column) -> Column:
    """A permutation of 0 .. left x right - 1."""
    start = F.struct(F.floor(n / right).cast("long").alias("a"), F.pmod(n, F.lit(right)).cast("long").alias("b"))

    def turn(x: Column, r: Column) -> Column:
        return let(F.pmod(x["a"] + F.pmod(F.xxhash64(_round(key, r, x["b"])), F.lit(left)), F.lit(left)), lambda a: second(x, r, a))

    def second(x: Column, r: Column, a: Column) -> Column:
        return F.struct(a.cast("long").alias("a"), F.pmod(x["b"] + F.pmod(F.xxhash64(_round(key, -r, a.cast("long"))), F.lit(right)), F.lit(right)).cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, lambda x: x["a"] * right + x["b"])


def _luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum of a string of digits; odd: 1 if the last digit is doubled."""
    return let(digits, lambda v: _luhn(v, odd))


def _luhn(digits: Column, odd: int) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        two = d * 2
        return acc + F.when((n - i) % 2 == 1 - odd, F.when(two > 9, two - 9).otherwise(two)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(s: Column) -> Column:
    return let(s, _mod97_of)


def _mod97_of(s: Column) -> Column:
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)

    return F.aggregate(_chars(turned), F.lit(0), add)


def _refilled(shape: Column, chars: Column) -> Column:
    """shape with its letters and digits replaced in order by those of chars."""
    return let(chars, lambda v: _refilled_by(shape, v))


def _refilled_by(shape: Column, chars: Column) -> Column:
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(x: Column, c: Column) -> Column:
        hit = F.regexp_like(c, F.lit("[A-Za-z0-9]"))
        return F.struct((x["i"] + hit.cast("int")).alias("i"), F.concat(x["out"], F.when(hit, F.substring(chars, x["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(_chars(shape), start, put, lambda x: x["out"])


def _card(m: Column, key: Column) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - _luhn_sum(body, 1) % 10, F.lit(10)).cast("string"))

    return let(F.regexp_replace(m, "[^0-9]", ""), lambda digits: _refilled(m, let(feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), key), checked)))


def _card_run(m: Column) -> Column:
    """struct<before, run, after>: the longest run of m's digit groups, the first of equals, that has 13 to 19 digits and passes the Luhn test, else null."""
    part = lambda before, run, after: F.struct(before.alias("before"), run.alias("run"), after.alias("after"))
    passes = lambda s: let(F.regexp_replace(s, "[^0-9]", ""), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d, 0) % 10 == 0))

    def runs(groups: Column) -> Column:
        wide = lambda first, n: F.length(F.array_join(F.slice(groups, first, n), " "))
        # start: characters before the run; size: its characters; digits, negated, sorts the longest first
        one = lambda i, j: F.struct((-F.length(F.array_join(F.slice(groups, i, j - i + 1), ""))).alias("digits"), F.when(i > 1, wide(F.lit(1), i - 1) + 1).otherwise(0).alias("start"), wide(i, j - i + 1).alias("size"))
        each = F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.transform(F.sequence(i, F.size(groups)), lambda j: one(i, j))))
        good = F.filter(each, lambda r: r["digits"].between(-19, -13) & passes(F.substring(m, r["start"] + 1, r["size"])))
        cut = lambda r: part(F.substring(m, F.lit(1), r["start"]), F.substring(m, r["start"] + 1, r["size"]), F.substring(m, r["start"] + r["size"] + 1, F.length(m)))
        return F.try_element_at(F.transform(F.array_sort(good), cut), F.lit(1))

    return F.when(passes(m), part(F.lit(""), m, F.lit(""))).otherwise(let(F.split(m, "[ -]"), runs))


def _iban(m: Column, key: Column) -> Column:
    def made(plain: Column) -> Column:
        land = F.substring(plain, 1, 2)
        checked = lambda body: F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body)
        return F.when((F.length(plain) >= 15) & (_mod97(plain) == 1), _refilled(m, let(feistel(F.substring(plain, F.lit(5), F.length(plain)), key), checked)))

    return let(F.regexp_replace(m, " ", ""), made)


def _ip(m: Column, key: Column) -> Column:
    dotted = lambda n: F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("long").cast("string") for k in (3, 2, 1, 0)])

    def made(octets: Column) -> Column:
        number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
        return F.when(~F.exists(octets, lambda o: o > 255), let(feistel_number(number, 65536, 65536, key), dotted))

    return let(F.transform(F.split(m, r"\."), lambda o: o.cast("long")), made)


def _date(m: Column, key: Column) -> Column:
    iso = F.regexp_like(m, F.lit("^[0-9]{4}-"))
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.regexp_replace(m, r"\.", "/"), "dd/MM/yyyy"))
    first, sep, n = F.lit(FIRST).cast("date"), F.substring(m, 3, 1), DAYS[0] * DAYS[1]
    written = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy")))
    moved = lambda at: F.date_add(first, ((at - F.pmod(at, F.lit(n))) + feistel_number(F.pmod(at, F.lit(n)).cast("long"), *DAYS, key)).cast("int"))
    made = lambda at: F.when((at >= 0) & (at < CYCLES * n), let(moved(at), written))
    return let(F.datediff(day, first), made)


def _phone(m: Column, key: Column) -> Column:
    """Country code and national digits are one number in every notation; the digits after the code are permuted. A trunk zero in brackets stays."""
    plus = F.startswith(m, F.lit("+"))
    # the trunk zero is no digit of the number: a sign that no text of a match holds stands for it
    shape = F.regexp_replace(m, r"^(\+[0-9]{1,3}[ .-]?)\(0\)", "$1(~)")

    def made(digits: Column) -> Column:
        code = F.when(plus, F.regexp_extract(digits, COUNTRY, 0)).otherwise(F.lit(HOME))
        return let(code, lambda c: F.translate(_refilled(shape, F.when(plus, F.concat(c, new(F.substring(digits, F.length(c) + 1, F.length(digits)), c))).otherwise(new(digits, c))), "~", "0"))

    new = lambda rest, c: feistel(rest, F.concat_ws("/", key, c))
    return let(F.regexp_replace(shape, "[^0-9]", ""), made)


def _email(m: Column, key: Column) -> Column:
    top = F.regexp_extract(m, r"\.[^.@]*$", 0)
    rest = F.substring(m, F.lit(1), F.length(m) - F.length(top))
    return F.concat(_refilled(rest, feistel(F.regexp_replace(rest, "[^A-Za-z0-9]", ""), key)), top)


def _ssn(m: Column, key: Column) -> Column:
    """Permuted among the numbers that can be given out: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    part = lambda first, n: F.substring(m, first, n).cast("long")
    area = part(1, 3) - 1 - (part(1, 3) > 666).cast("long")
    number = area * (99 * 9999) + (part(5, 2) - 1) * 9999 + part(8, 4) - 1

    def shown(n: Column) -> Column:
        low, rest = F.floor(n / (99 * 9999)) + 1, F.pmod(n, F.lit(99 * 9999))
        return F.format_string("%03d-%02d-%04d", (low + (low >= 666).cast("long")).cast("long"), (F.floor(rest / 9999) + 1).cast("long"), (F.pmod(rest, F.lit(9999)) + 1).cast("long"))

    return let(feistel_number(number, 898, 99 * 9999, key), shown)


def _ipv6(m: Column, key: Column) -> Column:
    """Each hexadecimal digit is moved among its like; the shape stays."""
    return _refilled(m, feistel_hex(F.regexp_replace(m, ":", ""), key))


def feistel_hex(s: Column, key: Column) -> Column:
    """A permutation of the strings of hexadecimal digits of a length; letters keep their case, as upper or lower of the whole."""
    upper = F.regexp_like(s, F.lit("[A-F]"))
    # digits 0-f as the letters a-p, moved there, and back
    as_letters = F.translate(F.lower(s), "0123456789abcdef", "abcdefghijklmnop")

    def half(x: Column, mask: Column) -> Column:
        one = lambda c, i: F.chr(F.lit(97) + F.pmod(F.ascii(c) - 97 + F.pmod(F.xxhash64(mask, i), F.lit(16)), F.lit(16)))
        return F.array_join(F.transform(_chars(x), one), "")

    def permuted(v: Column) -> Column:
        middle = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), middle).alias("a"), F.substring(v, middle + 1, F.length(v)).alias("b"))
        turn = lambda x, r: F.struct(x["b"].alias("a"), let(_round(key, r, F.length(v), x["b"]), lambda mask: half(x["a"], mask)).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: F.concat(x["a"], x["b"]))

    back = F.translate(let(as_letters, permuted), "abcdefghijklmnop", "0123456789abcdef")
    return F.when(upper, F.upper(back)).otherwise(back)


MAKERS = {"email": _email, "ipv6": _ipv6, "international": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}


def _replacement(m: Column, key: Column) -> Column:
    """struct<kind, value, before, after> for a match: the first kind whose whole pattern it is and whose test it passes, else null. before and after: what of the match stays."""

    def made(kind: str, pattern: str) -> Column:
        as_kind = lambda v, before, after: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"), before.alias("before"), after.alias("after")))
        make = lambda x: MAKERS[kind](x, F.concat_ws("/", key, F.lit(SAME.get(kind, kind))))
        if kind == "card":
            new = let(_card_run(m), lambda r: F.when(r.isNotNull(), let(make(r["run"]), lambda v: as_kind(v, r["before"], r["after"]))))
        else:
            new = let(make(m), lambda v: as_kind(v, F.lit(""), F.lit("")))
        return F.when(F.regexp_like(m, F.lit(f"^(?:{pattern})$")), new)

    return F.coalesce(*[made(k, p) for k, p in KINDS.items()])


def session_key(spark: SparkSession) -> str:
    """The setting ``tessella.pii.secret`` of the session; where it is unset, a random key is drawn and set there."""
    key = spark.conf.get(SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(SETTING, key)
    return key


def _key_row(spark: SparkSession, key: str) -> DataFrame:
    """pii_key: one row, held by the JVM as a local table, so that no Python worker deals it out."""
    jvm = spark._jvm
    one = jvm.java.util.ArrayList()
    one.add(key)
    return DataFrame(spark._jsparkSession.createDataset(one, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark).toDF("pii_key")


NEW = "array<struct<kind:string,value:string,before:string,after:string>>"


def found(texts: DataFrame, key: str) -> DataFrame:
    """texts (text and others) with pieces (texts between matches), hits (matches) and new (their kind and pseudonym, or null)."""
    # every kind but e-mail has several digits, or digits and colons; texts without either are passed over by cheap scans
    possible = F.regexp_like("text", F.lit("[0-9][^0-9]{0,4}[0-9]")) | F.contains("text", F.lit("@")) | F.contains("text", F.lit("::"))
    hits = F.when(possible, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    hits = F.when(F.size(hits) > 0, hits)
    # the key comes as a row of a one-row table, as plans, the UI and event logs print literals
    cut = texts.crossJoin(F.broadcast(_key_row(texts.sparkSession, key))).select("*", hits.alias("hits")).select("*", F.when(F.col("hits").isNotNull(), F.split("text", ANY, -1)).alias("pieces"))
    return cut.select("*", F.transform("hits", lambda m: _replacement(m, F.col("pii_key"))).alias("new")).drop("pii_key")


def _text() -> Column:
    new = lambda x: F.concat(x["before"], x["value"], x["after"])
    put = F.transform("hits", lambda m, i: F.concat(F.element_at("pieces", i + 1), F.coalesce(new(F.element_at("new", i + 1)), m)))
    return F.when(F.col("hits").isNull(), F.col("text")).otherwise(F.concat(F.array_join(put, ""), F.element_at("pieces", -1)))


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the texts' personal data replaced; n_chars, where present, follows the text."""
    marked = found(whole_rows(docs, F.col("text").alias("text")), key or session_key(docs.sparkSession))
    out = marked.select("row", _text().alias("said"), F.col("hits").isNull().alias("same"))
    row = F.col("row").withField("text", F.col("said"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("same"), F.col("row")["n_chars"]).otherwise(F.length("said")).cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text (with pseudonyms), n_found, a count for each kind, and pseudonyms: kind:pseudonym of each value in order, comma-joined."""
    marked = found(only(docs, "doc_id", "text"), key or session_key(docs.sparkSession))
    good = F.coalesce(F.array_compact("new"), F.array().cast(NEW))
    count = lambda k: F.size(F.filter(good, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return marked.select("doc_id", _text().alias("text"), F.size(good).cast("long").alias("n_found"), *[count(k) for k in KINDS], F.array_join(F.transform(good, lambda x: F.concat_ws(":", x["kind"], x["value"])), ",").alias("pseudonyms"))
