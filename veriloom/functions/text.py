"""Text functions: tokens, lengths, normal forms, ids. Columns in, columns out, inside code generation where possible."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: white space as ECMAScript's \s has it; Java's and RE2's \s are ASCII only.
SPACE = r"\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SCANNER_TOKEN = rf"[가-힣A-Za-z0-9]+|[^{SPACE}]"
SURFACE_TOKEN = r"[가-힣A-Za-z0-9_-]+"


def scanner_tokens(text: Column) -> Column:
    """Runs of letters and digits, or any other single character that isn't white space."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SCANNER_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def surface_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(composed(text)), F.lit(SURFACE_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def surface_norm(text: Column) -> Column:
    """The text in NFC and lower case, without anything but Hangul, Latin letters and digits."""
    return F.regexp_replace(F.lower(composed(text)), "[^가-힣a-z0-9]+", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def sentences(text: Column) -> Column:
    parts = F.split(text, r"[.!?。！？\n]+")
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    parts = F.split(text, rf"\n[{SPACE}]*\n")
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def is_dialogue(paragraph: Column) -> Column:
    return trimmed(paragraph).rlike("^[“「『\"'‘—]")


def dense_length(text: Column) -> Column:
    """Code points other than white space."""
    return F.length(F.regexp_replace(text, rf"[{SPACE}]+", ""))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero, and the product is what gets rounded."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def deterministic_id(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts, a null character between them."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def selector_id(source: Column, start: Column, end: Column, slice_sha256: Column) -> Column:
    """Id of a byte selector: a part of the source's id and of the digest of source, range and content."""
    whole = F.concat_ws(":", source, start.cast("string"), end.cast("string"), slice_sha256)
    return F.concat(F.lit("sel-"), F.substring(source, 8, 12), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 20))


def mechanism_form(text: Column) -> Column:
    """In NFC, trimmed, with single blanks."""
    return F.regexp_replace(trimmed(composed(text)), rf"[{SPACE}]+", " ")


#: The fields of a mechanism in their order, and the schema versions that its signatures name.
MECHANISM = ("protagonistRepeatedVerb", "pressure", "activeChoice", "resistance", "payoff", "recognition")
MECHANISM_SCHEMA, ENGINE_SCHEMA = "genre-soul-commercial-mechanism-signature/v1", "genre-soul-commercial-engine-signature/v1"


def _json_text(value: Column) -> Column:
    """A text as JSON writes it, with its quotes."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def mechanism_signature(fields: list[Column], source: Column | None = None) -> Column:
    """SHA-256 of the JSON of a mechanism's fields, with the source's id where the signature is an engine's."""
    parts = [F.concat(F.lit(f'"{name}":'), _json_text(mechanism_form(value))) for name, value in zip(MECHANISM, fields)]
    body = F.concat(F.lit('"mechanism":{'), F.concat_ws(",", *parts), F.lit("}}"))
    if source is None:
        return F.sha2(F.concat(F.lit(f'{{"schemaVersion":"{MECHANISM_SCHEMA}",'), body), 256)
    return F.sha2(F.concat(F.lit(f'{{"schemaVersion":"{ENGINE_SCHEMA}","sourceId":'), _json_text(source), F.lit(","), body), 256)


def without_fences(text: Column) -> Column:
    """A JSON answer without the code fence around it."""
    bare = trimmed(text)
    open_ = F.regexp_replace(bare, rf"^```(?:json)?[{SPACE}]*", "")
    return F.when(bare.startswith("```"), F.regexp_replace(open_, rf"[{SPACE}]*```\z", "")).otherwise(bare)


def tolerant_json(text: Column) -> Column:
    """The JSON value of an answer with or without a code fence; null where it doesn't parse."""
    return F.try_parse_json(without_fences(text))


def without_line_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![^\n])[0-9]+\|", "")


def install_form(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, at most one empty line, trimmed."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def text_checks(text: Column, least_bytes: int, points: tuple[int, int], markers: list[str]) -> dict[str, Column]:
    """Whether a text has enough bytes, a number of code points within bounds, and each of the markers; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    found = {"long_enough": F.octet_length(body) >= least_bytes, "sized": F.length(body).between(*points)}
    return found | {f"has:{m}": F.contains(body, F.lit(m)) for m in markers}


def is_safe_path(path: Column) -> Column:
    """Relative, with forward slashes, and no part that is empty or leads upwards."""
    return (F.length(path) > 0) & ~path.rlike(r"^/|\\|\x00|//|/$") & ~path.rlike(r"(^|/)\.\.?(/|$)")


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def strict_timestamp(value: Column) -> Column:
    """The time of an ISO text with milliseconds and Z, null for any other form."""
    exact = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")
    return F.when(exact, F.try_to_timestamp(F.substring(value, 1, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")))


def strict_number(value: Column) -> Column:
    """A plain decimal number; anything else, such as 5d or an empty text, is null."""
    return F.when(trimmed(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed(value).cast("double"))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Spark has no normal forms."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Texts of these characters alone are in NFC: Latin, Greek without marks, punctuation, CJK, composed Hangul.
_ALWAYS_COMPOSED = r"^[\x{0}-\x{2ff}\x{400}-\x{482}\x{2010}-\x{2027}\x{24b6}-\x{24e9}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff01}-\x{ff5e}]*\z"


def composed(text: Column) -> Column:
    """The text in NFC. Only texts with characters that composition may change go through Python."""
    fixed = F.when(~text.rlike(_ALWAYS_COMPOSED), text)
    return F.coalesce(nfc(fixed), text)


@F.pandas_udf(StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON text as two-space indented JSON with a line feed at its end, nulls kept, keys in their order."""
    return value.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2) + "\n")


@F.pandas_udf(StringType())
def sorted_json(value: pd.Series) -> pd.Series:
    """JSON text as compact JSON with sorted keys."""
    return value.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
