"""Where a term stands in a text, and bounded context around it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import korean as K
from ..functions.text import deterministic_id

CONTEXT_UNITS, MOST_BYTES, PER_SIDE = 160, 768, 8
_TOKEN = re.compile(r"[가-힣A-Za-z0-9_-]+")
_DROP = re.compile(r"[^가-힣a-z0-9]+")
_ENDING = re.compile(rf"^(.{{2,}}?){K._any(K.ENDINGS)}$", re.S)
_ANCHOR = re.compile(rf"^([가-힣]{{2,4}}?){K._any([*K.ROLES, *K.HONORIFICS])}$")
_COMPANY = re.compile(rf"^(.*?)({K._any(K.ORGANIZATIONS)})$", re.S)
_STEM = re.compile(r"[가-힣a-z0-9_-]{2,20}")


def token_forms(token: str) -> set[str]:
    """Every normal form by which a token can stand for a term."""
    plain = _DROP.sub("", token.lower())
    base = _ENDING.sub(r"\1", plain)
    forms = {plain, base}
    if base.endswith("이"):
        forms.add(base[:-1])
    if m := _ANCHOR.match(base):
        forms.add(m[1])
    if (m := _COMPANY.match(base)) and _STEM.fullmatch(m[1]):
        forms |= {m[1], base}
    return forms


def term_ranges(text: str, term: str) -> list[tuple[int, int]]:
    """Ranges of tokens that stand for the term; without any, all places of it in the text's normal form."""
    found = [m.span() for m in _TOKEN.finditer(text) if term in token_forms(m[0])]
    if found:
        return found
    kept = [(c, i) for i, raw in enumerate(text) for c in _DROP.sub("", raw.lower())]
    norm = "".join(c for c, _ in kept)
    return [(kept[m.start()][1], kept[m.start() + len(term) - 1][1] + 1) for m in re.finditer(f"(?={re.escape(term)})", norm)] if term else []


def _units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def context(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points around a range: up to CONTEXT_UNITS UTF-16 units a side, then less until MOST_BYTES hold it.

    The longer side gives way first, the right one when both are equal.
    """
    sides = []
    for part in (text[:start][::-1], text[end:]):
        units = n = 0
        while n < len(part) and units < CONTEXT_UNITS:
            units += _units(part[n])
            n += 1
        sides.append(n)
    left, right = sides
    while (left or right) and len(text[start - left : end + right].encode()) > MOST_BYTES:
        if right and _units(text[end : end + right]) >= _units(text[start - left : start]):
            right -= 1
        elif left:
            left -= 1
        else:
            right -= 1
    return start - left, end + right


def term_windows(rows: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """The first and last four windows of each row's term: byte ranges, text, and whether that is all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, raw, word in zip(batch["k"], batch["t"], batch["w"]):
                value = unicodedata.normalize("NFC", raw or "")
                ranges = term_ranges(value, word or "")
                half = PER_SIDE // 2
                for a, b in ranges if len(ranges) <= PER_SIDE else ranges[:half] + ranges[-half:]:
                    s, e = context(value, a, b)
                    at = len(value[:s].encode())
                    piece = value[s:e]
                    out.append((name, word, at, at + len(piece.encode()), len(value[s:a].encode()), len(value[s:b].encode()), piece, len(ranges) <= PER_SIDE))
            yield pd.DataFrame(out, columns=["key", "term", "start_byte", "end_byte", "match_start", "match_end", "window", "complete"])

    narrow = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(term).alias("w"))
    found = narrow.mapInPandas(run, "key string, term string, start_byte long, end_byte long, match_start long, match_end long, window string, complete boolean")
    return found.withColumn("window_id", deterministic_id("surface-window-", 24, F.col("key"), F.col("term"), F.col("start_byte").cast("string"), F.col("end_byte").cast("string"), F.sha2("window", 256)))
