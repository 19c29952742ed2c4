"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers that pass their kind's validation (card checksum, IBAN remainder, octet and calendar ranges) are replaced by a
keyed Feistel permutation of their digits within the same format, so equal values stay equal, different ones stay
different, and checksums stay valid. Dates are permuted as day numbers, the halves of IPv6 addresses as pairs of 32 bits,
the letters of accounts as strings. E-mail addresses and secrets get keyed digests.

Whoever has the key can undo the permutations, so it is never in the code. Plans hold only what is derived from it: a plan in
the web interface or an event log tells nothing of the key itself, but whoever reads the derived key there can undo these
pseudonyms, so such logs are to be kept as safe as the texts.
"""

from __future__ import annotations

import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
#: A name and what is assigned to it: tokens and keys may have dots, passwords any signs, but neither ends in punctuation.
TOKEN_NAME = r"(?i:(?<![a-z])(?:token|secret|api[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?"
PASSWORD_NAME = r"(?i:(?<![a-z])(?:password|passwd|pwd))\s{0,3}[=:]\s{0,3}[\"']?"
ASSIGNED = rf"(?:{TOKEN_NAME}[A-Za-z0-9_+/.=-]{{7,}}[A-Za-z0-9_+/=-]|{PASSWORD_NAME}[^\s\"'<>]{{5,}}[^\s\"'<>.,;:!?()#*$%&|])"
#: What follows the word bearer, and keys that their first letters tell; both have a digit.
BEARER_NAME = r"(?i:(?<![a-z])bearer) {1,3}"
BEARER = rf"{BEARER_NAME}(?=[A-Za-z_+/.=-]*+[0-9])[A-Za-z0-9_+/.=-]{{15,}}[A-Za-z0-9_+/=-]"
KEY_NAME = r"(?<![0-9A-Za-z_-])(?:AKIA|ASIA|sk-|gh[opsu]_)"
KEY = r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|sk-(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+|gh[opsu]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"
HEX = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{8,31}|(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])"
#: Names of months in full and by three letters; the first letters in order give a month's number.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
NAMED_DATE = rf"(?<![0-9A-Za-z./-])(?:[0-9]{{1,2}} {MONTH} [0-9]{{4}}|{MONTH} [0-9]{{1,2}},? [0-9]{{4}})(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: No address follows a name of versions.
IP = rf"(?<![0-9.])(?<!(?i:\b(?:v|ver|version|release|build))[.: ]{{0,2}})(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])"
#: Numbers written as at home: a leading 0, in groups of digits or none, 10 or 11 in all.
HOME = r"(?<![0-9A-Za-z.])0[1-9][0-9]{8,9}(?![0-9A-Za-z]|\.[0-9])"
NATIONAL = r"(?<![0-9A-Za-z])0[1-9][0-9]{0,3}(?:[ .-][0-9]{2,6}){1,4}(?![ .-]?[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
    r"|(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])"
)
#: Tried in this order at each place.
PRIVATE = "|".join((EMAIL, ASSIGNED, BEARER, KEY, HEX, IP6, IBAN, CARD, SSN, DATE, NAMED_DATE, IP, PHONE, HOME, NATIONAL))

#: The session setting that holds the key.
KEY_SETTING = "tmengine.pii.key"

#: Dates from 1800-01-01 on are permuted among DAYS_A * DAYS_B days, to 2199-09-25.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 400, 365
ROUNDS = 8


def derived(key: str) -> str:
    """The key that expressions hold, a keyed digest of ``key``."""
    return hmac.new(key.encode(), b"pseudonyms", "sha256").hexdigest()


def keyed(key: str, *parts) -> Column:
    """A keyed number below 16**15 from columns and constants."""
    said = F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permute pairs (left below left_size, right below right_size) by alternating keyed additions; a struct (l, r)."""

    def turn(s: Column, i: Column) -> Column:
        on_left = F.struct(F.pmod(s["l"] + F.pmod(keyed(key, kind, left_size, right_size, i, s["r"]), left_size), left_size).alias("l"), s["r"].alias("r"))
        on_right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(keyed(key, kind, left_size, right_size, i, s["l"]), right_size), right_size).alias("r"))
        return F.when(i % 2 == 1, on_left).otherwise(on_right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def power_of_ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("bigint") for k in range(19)]), (n + 1).cast("int"))


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """The digits (up to 36 of them) permuted among all strings of as many digits; none stay none."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")  # of one digit the left half is empty and counts as 0
    l, r = (F.concat(F.lit("0"), F.substring(digits, *span)).cast("bigint") for span in ((F.lit(1), a), (a + 1, n - a)))
    out = feistel(key, kind, l, r, power_of_ten(a), power_of_ten(n - a))
    half = lambda x, size: F.substring(F.lpad(x.cast("string"), 18, F.lit("0")), F.lit(19) - size, size)
    joined = F.transform(F.array(out), lambda s: F.concat(half(s["l"], a), half(s["r"], n - a)))
    return F.element_at(joined, 1)


def permuted_letters(key: str, kind: str, letters: Column, beside: Column) -> Column:
    """Letters A to Z permuted among all strings of as many: halves take turns at shifting each other's letters.

    ``beside`` is what else tells a value apart, so that a single letter changes with it.
    """
    a = F.floor(F.length(letters) / 2).cast("int")

    def shifted(target: Column, other: Column, i: Column) -> Column:
        by = lambda c, j: F.pmod(F.ascii(c) - 65 + F.pmod(keyed(key, kind, beside, i, j, other), F.lit(26)), F.lit(26))
        made = F.array_join(F.transform(F.split(target, ""), lambda c, j: F.char(by(c, j) + 65)), "")
        return F.when(target == "", target).otherwise(made)

    def turn(s: Column, i: Column) -> Column:
        on_left = F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        on_right = F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r"))
        return F.when(i % 2 == 1, on_left).otherwise(on_right)

    halves = F.struct(F.substring(letters, F.lit(1), a).alias("l"), F.substring(letters, a + 1, F.length(letters)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, turn, lambda s: F.concat(s["l"], s["r"]))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(shape: Column, signs: Column, kind: str = "0-9") -> Column:
    """``shape`` with its digits (or signs of another class) replaced, one by one, by ``signs``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{kind}]", ""))
    filled = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(f"[{kind}]"), F.substring(signs, place(i), F.lit(1))).otherwise(c))
    return F.array_join(filled, "")


def card_remainder(digits: Column) -> Column:
    """The sum of a number's digits, every second one from the right doubled, modulo 10; 0 for a valid card."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10


def iban_remainder(compact: Column) -> Column:
    """An account number with its first four characters moved to the end, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def new_card(key: str, value: Column) -> Column:
    digits = only_digits(value)
    body = permuted_digits(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    made = F.transform(F.array(body), lambda b: F.concat(b, ((F.lit(10) - card_remainder(F.concat(b, F.lit("0")))) % 10).cast("string")))
    return refill(value, F.element_at(made, 1))


def new_iban(key: str, value: Column) -> Column:
    """The account's digits and letters permuted in their places, spaces and country kept, check digits computed anew."""
    rest = F.substring(value, F.lit(5), F.length(value))
    letters = F.regexp_replace(rest, "[^A-Z]", "")
    fresh = permuted_letters(key, "iban-letters", letters, only_digits(rest))
    changed = F.element_at(F.transform(F.array(refill(rest, permuted_digits(key, "iban", only_digits(rest)))), lambda x: refill(x, fresh, "A-Z")), 1)
    country = F.substring(value, F.lit(1), F.lit(2))

    def checked(body: Column) -> Column:
        zero = F.concat(country, F.lit("00"), F.regexp_replace(body, " ", ""))
        return F.concat(country, F.lpad((F.lit(98) - iban_remainder(zero)).cast("string"), 2, "0"), body)

    return F.element_at(F.transform(F.array(changed), checked), 1)


def new_ip(key: str, value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    size = F.lit(65536).cast("bigint")
    out = feistel(key, "ip", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], size, size)
    said = lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string"))
    return F.element_at(F.transform(F.array(out), said), 1)


def new_ip6(key: str, value: Column) -> Column:
    """Both halves of the address permuted, written as eight groups."""
    sides = F.split(F.lower(value), "::")
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(sides[0]), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    full = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    numbers = F.transform(full, lambda g: F.conv(g, 16, 10).cast("bigint"))
    size = F.lit(1 << 32)

    def said(n: Column) -> Column:
        parts = [feistel(key, f"ip6-{k}", n[k] * 65536 + n[k + 1], n[k + 2] * 65536 + n[k + 3], size, size) for k in (0, 4)]
        return F.flatten(F.transform(F.array(*parts), lambda s: F.array(F.floor(s["l"] / 65536), s["l"] % 65536, F.floor(s["r"] / 65536), s["r"] % 65536)))

    made = F.flatten(F.transform(F.array(numbers), said))
    return F.array_join(F.transform(made, lambda x: F.lower(F.hex(x.cast("bigint")))), ":")


def day_of(value: Column, month_first: bool = False) -> Column:
    """The calendar day of a date in one of the shapes, null if there is none."""
    n = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    date = lambda y, m, d: F.concat_ws("-", F.get(n, F.lit(y)), F.lpad(m, 2, "0"), F.lpad(F.get(n, F.lit(d)), 2, "0"))
    name = F.regexp_extract(value, "[A-Z][a-z]{2}", 0)
    month = F.floor((F.position(name, F.lit(MONTHS)) + 2) / 3).cast("string")
    other = date(2, F.get(n, F.lit(0 if month_first else 1)), 1 if month_first else 0)
    return F.when(value.contains("-"), date(0, F.get(n, F.lit(1)), 2)).when(name != "", date(1, month, 0)).otherwise(other).try_cast("date")


def any_day_of(value: Column) -> Column:
    """The day read with the day before the month or, where that is none, after it."""
    return F.coalesce(day_of(value), day_of(value, month_first=True))


def new_date(key: str, value: Column) -> Column:
    n = F.datediff(any_day_of(value), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    out = feistel(key, "date", F.floor(n / DAYS_B).cast("bigint"), n % DAYS_B, F.lit(DAYS_A).cast("bigint"), F.lit(DAYS_B).cast("bigint"))
    day = lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS_B + s["r"]).cast("int"))

    def shape(d: Column) -> Column:
        part = lambda short, long, when: F.when(when, F.date_format(d, long)).otherwise(F.date_format(d, short))
        full = ~value.rlike("(?<![0-9])[0-9](?![0-9])")  # with a leading 0 where it had one or needed none
        days, months = part("d", "dd", full), part("M", "MM", full)
        first, second = (F.when(day_of(value).isNull(), x).otherwise(y) for x, y in ((months, days), (days, months)))
        mark, year = F.regexp_extract(value, "[./]", 0), F.date_format(d, "yyyy")
        name = part("MMM", "MMMM", value.rlike("[A-Za-z]{4}"))
        gap = F.when(value.contains(","), ", ").otherwise(" ")
        named = F.when(value.rlike("^[0-9]"), F.concat_ws(" ", days, name, year)).otherwise(F.concat(name, F.lit(" "), days, gap, year))
        plain = F.when(value.rlike("[A-Z]"), named).otherwise(F.concat(first, mark, second, mark, year))
        return F.when(value.contains("-"), F.date_format(d, "yyyy-MM-dd")).otherwise(plain)

    return F.element_at(F.transform(F.array(out), lambda s: shape(day(s))), 1)


def new_phone(key: str, value: Column) -> Column:
    """The last ten digits (all, if fewer) permuted; country digits before them and a leading 0 are kept."""
    digits = only_digits(value)
    kept = F.greatest(F.length(digits) - 10, digits.startswith("0").cast("int"))
    fresh = permuted_digits(key, "phone", F.substring(digits, kept + 1, F.length(digits)))
    return refill(value, F.concat(F.substring(digits, F.lit(1), kept), fresh))


def new_secret(key: str, value: Column) -> Column:
    """The secret itself replaced by keyed hexadecimal digits of the same length; a name before it or a kind of key that its first letters tell stays.

    Secrets that differ in case differ, but for hexadecimal numbers, which stay linked and keep their case.
    """
    name = F.regexp_extract(value, f"^(?:{TOKEN_NAME}|{PASSWORD_NAME}|{BEARER_NAME}|{KEY_NAME})", 0)
    secret = F.substring(value, F.length(name) + 1, F.length(value))
    same = F.when(secret.rlike("^[0-9a-fA-F]{32,64}$"), F.lower(secret)).otherwise(secret)
    long = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"secret{k}"), same), 256) for k in range(4)])
    fresh = F.rpad(F.substring(long, F.lit(1), F.length(secret)), F.length(secret), "0")
    return F.concat(name, F.when(secret == F.upper(secret), F.upper(fresh)).otherwise(fresh))


def new_email(key: str, value: Column) -> Column:
    mark = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16)
    return F.concat(F.lit("person-"), mark, F.lit("@mail.invalid"))


def kind_of(value: Column) -> Column:
    """The kind of a match whose validation it passes, or null."""
    digits = only_digits(value)
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    ssn = whole(SSN) & ~value.rlike("^(000|666|9)|-00-|-0000$")
    day = F.datediff(any_day_of(value), F.lit(FIRST_DAY).cast("date"))
    ip6 = ~value.contains("::") | ((F.regexp_count(value, F.lit("[0-9A-Fa-f]+")).between(2, 7)) & value.rlike("[0-9]") & value.rlike("[0-9]{3}|[A-Fa-f]"))  # a shortened one of one or two decimal digits a group is a time
    return (
        F.when(whole(ASSIGNED) | whole(BEARER) | whole(KEY) | whole(HEX), "secret")
        .when(value.contains("@"), "email")
        .when(whole(IP6), F.when(ip6, "ip6"))
        .when(whole(NAMED_DATE), F.when((day >= 0) & (day < DAYS_A * DAYS_B), "date"))
        .when(value.rlike("^[A-Z]{2}"), F.when(value.rlike("^.{4}.*[0-9]") & (iban_remainder(F.regexp_replace(value, " ", "")) == 1), "iban"))
        .when(whole(CARD), F.when(card_remainder(digits) == 0, "card"))
        .when(whole(SSN), F.when(ssn, "ssn"))
        .when(whole(DATE), F.when((day >= 0) & (day < DAYS_A * DAYS_B), "date"))
        .when(whole(IP), "ip")
        .when(whole(PHONE) | F.length(digits).between(10, 11), "phone")
    )


def replaced(key: str, kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "email", new_email(key, value))
        .when(kind == "secret", new_secret(key, value))
        .when(kind == "iban", new_iban(key, value))
        .when(kind == "card", new_card(key, value))
        .when(kind == "ssn", refill(value, permuted_digits(key, "ssn", only_digits(value))))
        .when(kind == "date", new_date(key, value))
        .when(kind == "ip", new_ip(key, value))
        .when(kind == "ip6", new_ip6(key, value))
        .when(kind == "phone", new_phone(key, value))
        .otherwise(value)
    )


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting; where none is set, a random one that this session keeps."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replace the column text's personal data; adds n_private (long) and private_kinds (sorted, comma-joined).

    A date with slashes or dots is read with the day first, or the month first where no such day exists; months may be named.
    Pseudonyms of dates are days of 1800 to 2199. Four numbers after the name of a version are no address.
    An account number without a digit after its check digits is no match.
    Matches that fail their validation stay as they are. Null text stays null with 0 found; empty texts,
    ties and repeated rows are judged alone; an empty table gives no rows; other columns pass through unless
    they carry a result's name, in which case the result replaces them. Row by row: nothing is shuffled.
    """
    rows, key = docs.drop("n_private", "private_kinds", "_found"), derived(key)
    may = F.col("text").rlike("[0-9@]|(?i:token|secret|passw|key)")
    found = F.transform(F.regexp_extract_all("text", F.lit(PRIVATE), F.lit(0)), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    rows = rows.withColumn("_found", F.when(may, found))
    made = F.transform("_found", lambda x: replaced(key, x["kind"], x["value"]))
    filled = F.zip_with(F.split("text", PRIVATE, -1), made, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))))
    valid = F.filter("_found", lambda x: x["kind"].isNotNull())
    rows = rows.withColumn("text", F.when(F.size("_found") > 0, F.array_join(filled, "")).otherwise(F.col("text")))
    rows = rows.withColumn("n_private", F.coalesce(F.greatest(F.size(valid), F.lit(0)), F.lit(0)).cast("long"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["kind"]))), ",")
    return rows.withColumn("private_kinds", F.coalesce(kinds, F.lit(""))).drop("_found")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text", "n_private", "private_kinds")
