"""Scalar functions as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tmengine import schemas

#: Separates the parts of a pair's name.
UNIT = "\x1f"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_cell(c: Column) -> Column:
    """A cell as text: null and the word nan become empty, ends are trimmed."""
    out = stripped(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(out) == "nan", "").otherwise(out)


def memory_text(c: Column) -> Column:
    """Segment text of a memory: no-break spaces and runs of blanks become one space, ends are trimmed."""
    return stripped(F.regexp_replace(F.regexp_replace(c, "\\u00a0", " "), r"[ \t\r\n]+", " "))


def status_rank(c: Column) -> Column:
    ranks = {label: rank for label, rank, _ in schemas.STATUSES}
    return F.coalesce(schemas.lookup(ranks, stripped(F.coalesce(c, F.lit("")))), F.lit(schemas.UNKNOWN_RANK))


def status_weight(c: Column) -> Column:
    weights = {label: weight for label, _, weight in schemas.STATUSES}
    return F.coalesce(schemas.lookup(weights, stripped(F.coalesce(c, F.lit("")))), F.lit(schemas.UNKNOWN_WEIGHT))


def status_from_file(path: Column, default: Column | None = None) -> Column:
    """The review label a file's name stands for, else ``default``, else null (for quarantine)."""
    name = F.lower(F.regexp_extract(path, r"[^/\\]+$", 0))
    return (
        F.when(name.contains("designer"), "Designer Reviewed")
        .when(name.contains("cqa"), "CQA_Done")
        .when(name.contains("lqa"), "Done_LQA edited")
        .when(name.contains("gt") | name.contains("st"), "Done")
        .otherwise(default if default is not None else F.lit(None))
    )


def pair_id(source: Column, target: Column, status: Column, namespace: uuid.UUID) -> Column:
    """The version-5 UUID of a pair with its status in a namespace."""
    name = F.concat_ws(UNIT, source, target, F.coalesce(status, F.lit("")))
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def cache_key(query: Column, prefix: Column | None = None) -> Column:
    """md5 of a query without regard to case and white space; a prefix is put before it."""
    full = F.concat_ws(" ", prefix, query) if prefix is not None else query
    return F.md5(F.lower(F.regexp_replace(F.trim(F.regexp_replace(full, r"\s+", " ")), r"\s+", " ")).cast("binary"))


def language_codes(pair: Column) -> tuple[Column, Column]:
    """First and last part of a pair such as zh-en or zh>en, in lower case; null if there is one part only."""
    parts = F.filter(F.split(pair, r"[-_>/→]+"), lambda x: F.trim(x) != "")
    has = F.size(parts) >= 2
    return F.when(has, F.lower(F.trim(F.element_at(parts, 1)))), F.when(has, F.lower(F.trim(F.element_at(parts, -1))))


def language_name(code: Column) -> Column:
    """A code's language, or the code itself."""
    key = F.upper(F.regexp_replace(code, "[^A-Za-z-]", ""))
    return F.coalesce(schemas.lookup(schemas.LANGUAGES, key), code)


def lenient_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, and the pairs of neighbouring Han characters (a lone one alone)."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z]+"), F.lit(0))
    runs = F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.coalesce(F.concat(words, pairs), F.array().cast("array<string>"))


def token_hash(token: Column) -> Column:
    """The first four bytes of a token's md5 as an unsigned number."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")


def common_prefix(a: Column, b: Column) -> Column:
    """Length in characters of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def affix_similarity(a: Column, b: Column) -> Column:
    """(common prefix + common suffix) / longer length, the two not overlapping in the shorter text."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    ahead = common_prefix(a, b)
    behind = F.least(common_prefix(F.reverse(a), F.reverse(b)), short - ahead)
    return F.when((short == 0) | (long == 0), F.lit(0.0)).otherwise((ahead + behind) / long)


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own only gram, an empty one has none."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    none = F.array().cast("array<string>")
    return F.when(F.length(c) == 0, none).when(F.length(c) <= n, F.array(c)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def content_type(hint: Column) -> Column:
    """A known content type equal to the hint, else the first in order that it contains, else null."""
    names = F.array(*[F.lit(v) for v, _ in schemas.CONTENT_TYPES])
    trimmed = stripped(hint)
    known = F.array_contains(F.array(*[F.lit(v) for v, _ in schemas.CONTENT_TYPES], F.lit(schemas.UNKNOWN_TYPE)), trimmed)
    held = F.filter(names, lambda v: F.contains(trimmed, v))
    return F.when(known, trimmed).when(F.length(trimmed) > 0, F.try_element_at(held, F.lit(1)))


def rule_class(kind: Column) -> Column:
    return F.coalesce(schemas.lookup(dict(schemas.CONTENT_TYPES), F.coalesce(kind, F.lit(""))), F.lit("other"))


def parsed_answer(raw: Column) -> Column:
    """struct(translation, reason) of a model's answer: a JSON object, else the fields found by pattern, else the text."""
    text = stripped(raw)
    data = F.from_json(text, "map<string,string>")
    whole = text.rlike(r"(?s)^\{.*\}$") & F.map_contains_key(data, "translation")
    blank_is_null = lambda c: F.when(F.length(stripped(c)) > 0, stripped(c))
    # fixed values: how a field is found in a broken object
    said, why = r'"translation"\s*:\s*"([^"]*)"', r'(?s)"reason"\s*:\s*"(.*)"[\s\n]*\}'
    rescued = F.struct(stripped(F.regexp_extract(text, said, 1)).alias("translation"), F.when(text.rlike(why), blank_is_null(F.regexp_extract(text, why, 1))).alias("reason"))
    exact = F.struct(stripped(F.element_at(data, "translation")).alias("translation"), blank_is_null(F.try_element_at(data, F.lit("reason"))).alias("reason"))
    plain = F.struct(text.alias("translation"), F.lit(None).cast("string").alias("reason"))
    return F.when(F.coalesce(whole, F.lit(False)), exact).when(text.rlike(said), rescued).otherwise(plain)


# Fixed value: a numbered line, with the separators that answers use.
NUMBERED = r"^\s*(\d+)\s*[.\)）。、:：]\s*(.+?)\s*$"


def segment_text(xml: Column) -> Column:
    """The visible text of a segment: its Text elements' Value text, or their own where they have none."""
    path = '//*[local-name()="Text"][*[local-name()="Value"]]/*[local-name()="Value"]//text()|//*[local-name()="Text"][not(*[local-name()="Value"])]//text()'
    return memory_text(F.array_join(F.xpath(xml, F.lit(path)), ""))
