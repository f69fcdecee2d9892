"""Format-preserving pseudonyms for personal data, by Feistel networks in SQL functions.

Addresses of e-mail, IPv4 and IPv6 addresses, telephone, card, account (IBAN)
and social security numbers and dates are found by one pattern, validated, and
permuted with a key inside their format: letters stay letters of their case,
digits stay digits, a card number satisfies the Luhn check and an account number
its check digits, an address stays one, a date stays a date of 1900 to 2099 in the
same notation. The permutation depends on the key and the format alone, so equal
values stay linked across documents, and ``reverse`` undoes it. A name of one
character goes by a keyed table. Only DataFrame functions are used.

Query plans, and with them event logs, hold a digest of the key for each format and
never the key itself. Such a digest is enough to undo its own format, so logs need the
care that the key does. The setting's name holds ``secret``, which Spark redacts.

What stays as it is: the domain of an e-mail address, the first digit of a card
number, country codes, and the first digits of telephone numbers by which their
kind is told. Not found: national telephone numbers of other countries than the
North American ones without ``+``, names, and dates in other notations (months
are those of English; of ``3/4/2021`` one part is below 10 and the other below 29).

Defined cases: a null text stays null and counts nothing; an empty text stays
empty; values that don't validate (octets over 255, impossible dates, numbers of
13 to 19 digits or accounts that fail their check) stay and count nothing;
repeated rows give repeated rows; an empty table gives an empty result; other
columns are ignored by ``pseudonyms`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import secrets
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.llm.common import let
from tallyworks.sources.staging import shared_dir
from tallyworks.sources.store import Conflict, Store

ROUNDS = 8
KEY_SETTING = "spark.tallyworks.pii.secret"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
PHONE = r"(?<![\d+])\+?1?[ .-]?\(?[2-9]\d\d\)?[ .-][2-9]\d\d[ .-]\d{4}(?!\d)"
#: What ends an international number even after a single space: a card number, a date or an IPv4 address. Told by shape, which pseudonyms keep.
OTHER = r"(?:(?:\d{4}[ -]){3}\d{4}|\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4}|\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
#: A plus sign, a country code that isn't 1, and 8 to 15 digits in all.
ABROAD = rf"(?<![\d+])\+(?!{OTHER})[2-9](?:(?! {OTHER}| \d{{13}})\)?[ ./-]?\(?\d){{7,14}}(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{5}))(?!\d)"
DATE = r"(?<![\d/.-])(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[/.](?:0[1-9]|1[0-2])[/.](?:19|20)\d\d)(?!\d|[/-]\d)"
SHORT = r"(?<![\d/.-])(?:[1-9]/(?:[1-9]|1\d|2[0-8])|(?:1\d|2[0-8])/[1-9])/(?:19|20)\d\d(?!\d|[/-]\d)"
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DAY = r"(?:[1-9]|[12]\d|3[01])"
LONG = rf"(?<![A-Za-z\d])(?:{MONTHS} {DAY}, (?:19|20)\d\d|{DAY} {MONTHS} (?:19|20)\d\d)(?!\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{0,2}\d)?)(?![A-Za-z0-9])"
HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f:]*\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![0-9A-Za-z:])"
ANY = "|".join((EMAIL, IPV4, IPV6, IBAN, PHONE, ABROAD, CARD, SSN, DATE, SHORT, LONG))
KINDS = ("email", "ip", "phone", "card", "date", "ssn", "iban")
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DAYS_A, DAYS_B = 17, 4297


def key_of(spark: SparkSession) -> str:
    """The key of the permutations: that of the setting. Without one, one made at random once and kept in the shared folder, so that later jobs link with earlier ones.

    On a cluster that is the folder of ``spark.checkpoint.dir``; who can read it can undo the pseudonyms. It is published whole or not at all: a job that was killed leaves nothing that later
    ones read, and of two jobs at once both take the key that was first.
    """
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    kept = Store(spark, f"{shared_dir(spark)}/pii-secret", T.StructType([T.StructField("value", T.StringType())]))
    if not kept.version():
        try:
            kept.publish(spark.createDataFrame([(secrets.token_hex(16),)], kept.schema), 0)
        except Conflict:
            pass
    return kept.read(1).first()[0]


def format_key(key: str, label: str) -> str:
    """What a plan may show: a digest of the key and the format."""
    return hashlib.sha256(f"{key}|{label}".encode()).hexdigest()


def _word(key: str, label: str, r: Column, other: Column) -> Column:
    """The round function: 64 hex digits from the format's key, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(format_key(key, label)), r.cast("string"), other), 256)


def table_of(key: str, label: str, hexadecimal: bool) -> tuple[str, str]:
    """The characters of each class, and what each becomes where it stands alone."""
    mixed = lambda signs: "".join(sorted(signs, key=lambda c: hashlib.sha256(f"{format_key(key, label)}|{c}".encode()).digest()))
    kinds = ("0123456789abcdef",) if hexadecimal else (string.ascii_lowercase, string.ascii_uppercase, string.digits)
    return "".join(kinds), "".join(map(mixed, kinds))


def _number(digest: Column, at: int, width: int = 8) -> Column:
    return F.conv(F.substring(digest, at, width), 16, 10).cast("long")


def _moved(c: Column, n: Column, sign: int, hexadecimal: bool = False) -> Column:
    """One character moved inside its class; others stay."""
    if hexadecimal:
        digits = F.lit("0123456789abcdef")
        return F.substr(digits, F.pmod(F.position(c, digits) - 1 + sign * n, F.lit(16)) + 1, F.lit(1))
    out = c
    for low, size, kind in ((97, 26, "[a-z]"), (65, 26, "[A-Z]"), (48, 10, "[0-9]")):
        out = F.when(c.rlike(kind), F.char(F.pmod(F.ascii(c) - low + sign * n, F.lit(size)) + low)).otherwise(out)
    return out


def permuted_text(value: Column, key: str, label: str, reverse: bool = False, hexadecimal: bool = False) -> Column:
    """Feistel network over the two halves of a string: each round moves every character of one half by the digest of the other."""

    def shifted(half: Column, digest: Column, sign: int) -> Column:
        at = lambda i: F.conv(F.substr(digest, i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), lambda c, i: _moved(c, at(i), sign, hexadecimal)), ""))

    def halves(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        return F.struct(F.substr(v, F.lit(1), cut).alias("a"), F.substr(v, cut + 1, F.length(v)).alias("b"))

    if reverse:
        step = lambda s, r: F.struct(shifted(s["b"], _word(key, label, F.lit(ROUNDS - 1) - r, s["a"]), -1).alias("a"), s["a"].alias("b"))
    else:
        step = lambda s, r: F.struct(s["b"].alias("a"), shifted(s["a"], _word(key, label, r, s["b"]), 1).alias("b"))
    signs, become = table_of(key, label, hexadecimal)[:: -1 if reverse else 1]
    rounds = lambda v: let(halves(v), lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), h, step, lambda s: F.concat(s["a"], s["b"])))
    return let(value, lambda v: F.when(F.length(v) == 1, F.translate(v, signs, become)).otherwise(rounds(v)))


def permuted_number(value: Column, size_a: int, size_b: int, key: str, label: str, reverse: bool = False) -> Column:
    """Feistel network over a number below size_a * size_b by sums modulo the two sizes."""
    start = let(value.cast("long"), lambda v: F.struct(F.floor(v / size_b).cast("long").alias("a"), (v % size_b).alias("b")))
    sign = -1 if reverse else 1

    def step(s: Column, k: Column) -> Column:
        r = F.lit(ROUNDS - 1) - k if reverse else k
        by_b = F.pmod(s["a"] + sign * _number(_word(key, label, r, s["b"].cast("string")), 1), F.lit(size_a))
        by_a = F.pmod(s["b"] + sign * _number(_word(key, label, r, s["a"].cast("string")), 1), F.lit(size_b))
        even = r % 2 == 0
        return F.struct(F.when(even, by_b).otherwise(s["a"]).cast("long").alias("a"), F.when(even, s["b"]).otherwise(by_a).cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * size_b + s["b"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    each = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), each), F.lit(0), lambda a, d: a + d)


def account_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number: 98 less the number modulo 97, letters counting 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _day(match: Column) -> Column:
    """The date that a notation with four digits a year gives; null if there is none."""
    return F.coalesce(*[F.try_to_timestamp(F.translate(match, ".", "/"), F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy")]).cast("date")


def kind_of(match: Column) -> Column:
    """The kind of a found value; null if it doesn't validate."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    account = let(plain, lambda m: F.substr(m, F.lit(3), F.lit(2)) == account_check(F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5), F.length(m))))
    digits = F.regexp_replace(match, r"\D", "")
    return (
        F.when(match.contains("@"), "email")
        .when(match.contains(":"), F.when(F.size(F.split(match, ":+")) <= 8, "ip"))
        .when(match.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(match.rlike(r"^[A-Z]{2}\d\d"), F.when(account, "iban"))
        .when(match.rlike(f"^{SHORT}$"), "date")
        .when(match.rlike(rf"[a-z]|^\d{{4}}-\d\d-\d\d$|^\d\d[/.]\d\d[/.]\d{{4}}$"), F.when(_day(match).isNotNull(), "date"))
        .when(match.startswith("+"), "phone")
        .when(match.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .when(F.length(digits) >= 13, F.when(luhn_sum(digits) % 10 == 0, "card"))
        .otherwise("phone")
    )


def _refilled(shape: Column, signs: Column, slot: str = "[0-9]") -> Column:
    """``shape`` with the characters that are a ``slot`` replaced by ``signs``, one after another."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        here = c.rlike(slot)
        return F.struct(F.concat(s["out"], F.when(here, F.substr(signs, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + here.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def pseudonym(match: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    """The pseudonym of a value of a kind; the value itself if the kind is null."""

    def card(m: Column) -> Column:
        def number(d: Column) -> Column:
            body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", reverse))
            return let(body, lambda b: F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

        return let(F.regexp_replace(m, r"\D", ""), lambda d: _refilled(m, let(d, number)))

    def phone(m: Column) -> Column:
        def number(d: Column) -> Column:  # the country code and the first digits of area and exchange stay, so the number stays valid
            n = F.length(d)
            area, exchange, line = F.substr(d, n - 9, F.lit(3)), F.substr(d, n - 6, F.lit(3)), F.substr(d, n - 3, F.lit(4))
            free = permuted_text(F.concat(F.substr(area, F.lit(2), F.lit(2)), F.substr(exchange, F.lit(2), F.lit(2)), line), key, "phone", reverse)
            return let(free, lambda f: F.concat(F.substr(d, F.lit(1), n - 10), F.substr(area, F.lit(1), F.lit(1)), F.substr(f, F.lit(1), F.lit(2)), F.substr(exchange, F.lit(1), F.lit(1)), F.substr(f, F.lit(3), F.lit(6))))

        # abroad the country code of up to three digits stays, and the fourth digit, by which a number could turn North American
        abroad = lambda d: F.concat(F.substr(d, F.lit(1), F.lit(4)), permuted_text(F.substr(d, F.lit(5), F.length(d)), key, "abroad", reverse))
        return let(F.regexp_replace(m, r"\D", ""), lambda d: _refilled(m, F.when(m.rlike(f"^{PHONE}$"), let(d, number)).otherwise(let(d, abroad))))

    def ip(m: Column) -> Column:
        value = let(F.split(m, r"\."), lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")))
        octets = lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
        signs = permuted_text(F.lower(F.replace(m, F.lit(":"), F.lit(""))), key, "ip6", reverse, hexadecimal=True)
        long = let(F.when(m.rlike("[A-F]"), F.upper(signs)).otherwise(signs), lambda s: _refilled(m, s, "[0-9A-Fa-f]"))
        return F.when(m.contains(":"), long).otherwise(let(permuted_number(value, 65536, 65536, key, "ip", reverse), octets))

    def date(m: Column) -> Column:
        since = F.datediff(_day(m), F.lit("1900-01-01").cast("date"))
        moved = F.date_add(F.lit("1900-01-01").cast("date"), permuted_number(since, DAYS_A, DAYS_B, key, "date", reverse).cast("int"))
        notations = [(r"^\d{4}-", "yyyy-MM-dd"), ("^[A-Z]", "MMMM d, yyyy"), (r"^\d+ [A-Z]", "d MMMM yyyy"), (r"/", "dd/MM/yyyy")]
        written = lambda d: F.coalesce(*[F.when(m.rlike(p), F.date_format(d, f)) for p, f in notations], F.date_format(d, "dd.MM.yyyy"))
        return F.when(m.rlike(f"^{SHORT}$"), let(F.split(m, "/"), short)).otherwise(let(moved, written))

    def short(p: Column) -> Column:
        """``3/4/2021`` among dates whose parts have the same widths; a part of two digits stays below 29, so it may be a day beside any month."""
        a, b, year = (p[i].cast("int") for i in range(3))
        both, first = (a < 10) & (b < 10), a < 10
        small, other = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
        ones = permuted_number(((a - 1) * 9 + b - 1) * 200 + year - 1900, 81, 200, key, "date11", reverse)
        tens = permuted_number(((small - 1) * 19 + other - 10) * 200 + year - 1900, 171, 200, key, "date12", reverse)
        part = lambda v, n, low: (F.floor(v / 200) / n, F.floor(v / 200) % n + low)
        text = lambda *xs: F.concat_ws("/", *[F.floor(x).cast("int").cast("string") for x in xs])
        year_of = lambda v: v % 200 + 1900
        with_ones = let(ones, lambda v: text(part(v, 9, 1)[0] + 1, part(v, 9, 1)[1], year_of(v)))
        with_tens = let(tens, lambda v: F.when(first, text(part(v, 19, 10)[0] + 1, part(v, 19, 10)[1], year_of(v))).otherwise(text(part(v, 19, 10)[1], part(v, 19, 10)[0] + 1, year_of(v))))
        return F.when(both, with_ones).otherwise(with_tens)

    def email(m: Column) -> Column:
        return let(F.split(m, "@"), lambda p: F.concat(permuted_text(p[0], key, "email", reverse), F.lit("@"), p[1]))

    def ssn(m: Column) -> Column:
        """Among all numbers whose three parts are valid: areas 001 to 899 but 666, groups from 01, serials from 0001."""

        def number(p: Column) -> Column:
            area, group, serial = (p[i].cast("int") for i in range(3))
            n = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1).cast("long") * 9999 + serial - 1
            return permuted_number(n, 898 * 99, 9999, key, "ssn", reverse)

        def written(v: Column) -> Column:
            index = F.floor(v / (99 * 9999))
            area = index + 1 + (index >= 665).cast("int")
            return F.concat_ws("-", *[F.lpad(x.cast("int").cast("string"), w, "0") for x, w in ((area, 3), (F.floor(v / 9999) % 99 + 1, 2), (v % 9999 + 1, 4))])

        return let(let(F.split(m, "-"), number), written)

    def iban(m: Column) -> Column:
        country = F.substr(m, F.lit(1), F.lit(2))
        body = permuted_text(F.substr(F.replace(m, F.lit(" "), F.lit("")), F.lit(5), F.lit(30)), key, "iban", reverse)
        return let(let(body, lambda b: F.concat(country, account_check(country, b), b)), lambda s: _refilled(m, s, "[^ ]"))

    of = {"email": email, "ip": ip, "phone": phone, "card": card, "date": date, "ssn": ssn, "iban": iban}
    return F.coalesce(*[F.when(kind == k, f(match)) for k, f in of.items()], match)


def treated(text: Column, key: str, reverse: bool = False) -> Column:
    """A struct of the text with pseudonyms and the number of values of each kind."""
    found = lambda m: F.transform(m, lambda x: let(kind_of(x), lambda k: F.struct(k.alias("kind"), pseudonym(x, k, key, reverse).alias("to"))))
    pieces = lambda p: F.array_join(F.flatten(F.zip_with(F.split(text, F.lit(ANY), F.lit(-1)), p, lambda gap, x: F.array(F.coalesce(gap, F.lit("")), F.coalesce(x["to"], F.lit(""))))), "")
    counts = lambda p: [F.size(F.filter(p, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    nothing = F.struct(text.alias("text"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    whole = let(found(F.regexp_extract_all(text, F.lit(ANY), 0)), lambda p: F.struct(pieces(p).alias("text"), *counts(p)))
    return F.when(text.rlike(r"[0-9]|@"), whole).otherwise(nothing)


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and the number of values of each kind."""
    return docs.select("doc_id", treated(F.col("text"), key).alias("t")).select("doc_id", "t.*")


def masked(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in their texts, and all their other columns."""
    return docs.withColumn("text", treated(F.col("text"), key)["text"])
