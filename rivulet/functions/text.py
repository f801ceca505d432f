"""Cells of filings: markup, codes, amounts, dates, hashes, and labels for display."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .names import looks_like_person, strip

# Code tables.
CONTRIBUTOR_TYPES = {"I": "individual", "B": "business", "C": "committee", "P": "party", "O": "other", "S": "self"}
HINT_KINDS = {"committee": "committee", "party": "party", "business": "organization", "individual": "individual", "self": "individual"}
OCCUPATIONS = r"(?i)\b(RETIRED|HOMEMAKER|ATTORNEY|PHYSICIAN|SELF[- ]EMPLOYED)\b"
COMMITTEE_LABELS = {
    "PAC": "Political Committee", "CCE": "Committee of Continuous Existence", "ECO": "Electioneering Comm. Org.", "ECI": "Electioneering Comm. Individual",
    "IXO": "Independent Expenditure Org.", "PAP": "Affiliated Party Committee", "PTY": "Party Executive Committee",
}
KIND_LABELS = {"committee": "Committee", "candidate": "Candidate", "individual": "Individual", "organization": "Organization", "party": "Party", "unknown": "Unknown"}
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def lookup(codes: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), c) if codes else F.lit(None)


def contributor_kind(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CONTRIBUTOR_TYPES.items() for x in p]), F.upper(strip(code))), F.lit("unknown"))


def kind_from_hint(hint: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in HINT_KINDS.items() for x in p]), hint)


def classify_contributor(name: Column, occupation: Column) -> Column:
    return F.when(looks_like_person(name) | F.coalesce(occupation.rlike(OCCUPATIONS), F.lit(False)), "individual").otherwise("organization")


def direction(code: Column) -> Column:
    return F.when(F.upper(strip(F.coalesce(code, F.lit("")))) == "E", "expenditure").otherwise("contribution")


def directed_ends(filer: Column, counterparty: Column, flow: Column) -> tuple[Column, Column]:
    """From and to: money of a contribution goes to the filer, money of an expenditure comes from it."""
    out = flow == "expenditure"
    return F.when(out, filer).otherwise(counterparty), F.when(out, counterparty).otherwise(filer)


def clean_amount(raw: Column) -> Column:
    """decimal(16,2), half up; null where it is no number."""
    plain = strip(F.regexp_replace(raw, "[$,]", ""))
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?\z"), plain.try_cast("decimal(38,18)")).cast("decimal(16,2)")


def normalize_date(raw: Column) -> Column:
    """ISO or m/d/yyyy, a real day of the years 1800 to 2200; else null."""
    s = strip(raw)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    us = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}\z"), F.try_to_date(s, "M/d/yyyy"))
    day = F.coalesce(iso, us)
    return F.when(F.year(day).between(1800, 2200), day)


def row_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def join_address(a: Column, b: Column) -> Column:
    return blank_to_null(F.concat_ws(" ", blank_to_null(a), blank_to_null(b)))


def _safe(code: int) -> str:
    return " " if code < 32 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


_MARKUP = re.compile(r"(<br\s*/?>)|<[^>]+>", re.I)
_NUMBER = re.compile(r"&#(?:x([0-9a-f]+)|(\d+));", re.I)
_NAME = re.compile(r"&([a-z]+);", re.I)


def decode_cell(x: str) -> str:
    """Text of a piece of markup: tags go, breaks become blanks, numbers and then names are decoded, once each."""
    x = _MARKUP.sub(lambda m: " " if m[1] else "", x)
    x = _NUMBER.sub(lambda m: _safe(int(m[1], 16) if m[1] else int(m[2])), x)
    x = _NAME.sub(lambda m: "&" if m[1] == "amp" else _NAMED.get(m[1].lower(), m[0]), x)
    return " ".join(x.split())


@F.pandas_udf(StringType())
def decode_markup(s: pd.Series) -> pd.Series:
    """``decode_cell`` for any entity; ``decode_plain`` serves text without numeric ones."""
    return s.map(lambda x: None if x is None else decode_cell(x))


def decode_plain(c: Column) -> Column:
    """The same in generated code, but for numeric entities."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), "<[^>]+>", "")
    for name, letter in _NAMED.items():
        c = F.regexp_replace(c, f"(?i)&{name};", letter)
    return F.trim(F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def year_of_label(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b(19|20)\d{2}\b", 0), F.lit("")).try_cast("int")


def is_error_page(body: Column) -> Column:
    """A script failure served as a normal page."""
    return F.contains(body, F.lit("Error in /cgi-bin/")) | (body.rlike("(?i)internal server error") & (F.length(body) < 4000))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")


def county_slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def fit_label(c: Column, most: int = 38) -> Column:
    s = strip(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…")))


def kind_label(kind: Column, committee_type: Column) -> Column:
    of = lambda codes, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in codes.items() for x in p]), c), c)
    return F.when(committee_type.isNotNull(), of(COMMITTEE_LABELS, committee_type)).otherwise(of(KIND_LABELS, kind))


def _whole(x: Column) -> Column:
    """Half up towards plus infinity."""
    return F.floor(x + 0.5).cast("string")


def format_money(amount: Column) -> Column:
    """$1.2M, $450K, $900."""
    x = amount.cast("double")
    size = F.abs(x)
    scaled = lambda by, digits, unit: F.concat(F.lit("$"), F.format_string(f"%.{digits}f", x / by), F.lit(unit))
    return (
        F.when(x.isNull() | F.isnan(x) | (size == float("inf")) | (x == 0), "$0").when(size >= 1e9, scaled(1e9, 1, "B")).when(size >= 1e7, scaled(1e6, 0, "M"))
        .when(size >= 1e6, scaled(1e6, 1, "M")).when(size >= 1e3, F.concat(F.lit("$"), _whole(x / 1e3), F.lit("K"))).otherwise(F.concat(F.lit("$"), _whole(x)))
    )


def format_money_full(amount: Column) -> Column:
    """Whole dollars with thousands separators, sign before the currency."""
    size = F.format_number(F.round(F.abs(amount.cast("decimal(38,2)")), 0).cast("decimal(38,0)"), 0)
    return F.concat(F.when((amount < 0) & (size != "0"), "-").otherwise(""), F.lit("$"), size)


def money_line(received: Column, given: Column) -> Column:
    """in and out, what is above zero."""
    parts = F.array(F.when(received > 0, F.concat(F.lit("in "), format_money(received))), F.when(given > 0, F.concat(F.lit("out "), format_money(given))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ")


def tile_label(name: Column, received: Column, given: Column) -> Column:
    return F.concat_ws("\n", blank_to_null(fit_label(name)), blank_to_null(money_line(received, given)))


def edge_width(amount: Column, largest: Column) -> Column:
    """1 to 8 by the logarithm of the amount; 1 where that is undefined."""
    w = 1 + 7 * F.log10(amount.cast("double") + 1) / F.log10(F.nullif(largest.cast("double"), F.lit(0.0)) + 1)
    return F.coalesce(F.nanvl(w, F.lit(1.0)), F.lit(1.0))


def source_subtitle(kind: Column, count: Column, last: Column) -> Column:
    return F.concat_ws(" · ", kind, F.when(count > 1, F.concat(count.cast("string"), F.lit(" transactions"))), last.cast("string"))


def transaction_subtitle(day: Column, code: Column, occupation: Column, city: Column) -> Column:
    return F.concat_ws(" · ", *[blank_to_null(c.cast("string")) for c in (day, code, occupation, city)])
