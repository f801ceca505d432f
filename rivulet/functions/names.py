"""Party names: normal forms, blocking keys, person and truncation tests, similarities and the match score.

All are Column expressions, so they stay in generated code. ``fold_tail`` alone needs Python: full compatibility
decomposition for characters that come to several and are no Latin ligatures (fractions, squared words).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Width of a truncated name column, words without identity, and committee type tags.
TRUNCATED = 40
CORPORATE = ["INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "CORP", "CORPORATION", "CO", "COMPANY", "PA", "PC", "PLLC", "TRUST", "HOLDINGS", "GROUP", "ENTERPRISES"]
POLITICAL = ["PAC", "PACS", "CCE", "ECO", "ECI", "IXO", "PAP", "PTY", "COMMITTEE", "POLITICAL", "CAMPAIGN", "FUND", "FOR"]
STOPWORDS = ["THE", "OF", "AND", "A", "AN"]
TAGS = "PAC|CCE|ECO|ECI|IXO|PAP|PTY"
ORGANIZATION = r"(?i)\b(INC|LLC|CORP|COMPANY|PAC|COMMITTEE|ASSOCIATION|UNION|FUND|TRUST|LP|LLP)\b"
PERSON = r"^[A-Za-z'.\- ]+,\s*[A-Za-z][A-Za-z'.\- ]*\z"
# Thresholds and weights of the match score.
AUTO_LINK, REVIEW_FLOOR, SHORTEST_PREFIX = 0.88, 0.62, 12
TRIGRAM_WEIGHT, OVERLAP_WEIGHT, BLOCK_SCORE, PREFIX_SCORE, MOST = 0.55, 0.45, 0.80, 0.95, 0.99
ZIP5_BONUS, ZIP3_BONUS, CITY_BONUS, SIMILAR = 0.08, 0.04, 0.03, 0.3


def _plain(c: str) -> str:
    """Full compatibility decomposition, in upper case, without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).upper()) if not 0x300 <= ord(x) <= 0x36F)


def _single() -> tuple[str, str]:
    """Characters of the basic plane that come to one plain ASCII character, such as accented and full-width ones, and those characters."""
    pairs = [(chr(c), p) for c in range(0xA1, 0xFFFF) if not 0xD800 <= c < 0xE000 and len(p := _plain(chr(c))) == 1 and p.isascii() and p != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _single()
#: Ligatures of Latin letters, which come to several.
LIGATURES = {chr(c): _plain(chr(c)) for c in (0xDF, 0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3, *range(0xFB00, 0xFB07))}


def squeeze(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{00A0}]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+\z", "")


def split_type_tag(raw: Column) -> tuple[Column, Column]:
    """Name without a closing committee tag, and the tag in upper case or null."""
    pattern = rf"(?i)^(.*?)\s*\(({TAGS})\)\s*\z"
    tag = F.upper(F.nullif(F.regexp_extract(raw, pattern, 2), F.lit("")))
    return strip(F.when(tag.isNotNull(), F.regexp_extract(raw, pattern, 1)).otherwise(raw)), tag


def fold(c: Column) -> Column:
    """Upper case without accents, full-width forms and other variants as plain letters, Latin ligatures spelled out."""
    spelled = c
    for a, b in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    c = F.when(c.rlike(f"[{''.join(LIGATURES)}]"), spelled).otherwise(c)
    return F.translate(F.regexp_replace(F.upper(c), r"[\x{0300}-\x{036F}]", ""), ACCENTED, PLAIN)


def _normal_from(folded: Column) -> Column:
    spelled = F.regexp_replace(F.replace(folded, F.lit("&"), F.lit(" AND ")), r"'S(?![A-Za-z0-9_])", "S")
    return F.trim(F.regexp_replace(spelled, r"[^A-Z0-9]+", " "))


def normalize_name(raw: Column) -> Column:
    """Upper case, no accents, & as AND, possessives closed up, other punctuation as spaces."""
    return _normal_from(fold(split_type_tag(raw)[0]))


@F.pandas_udf(StringType())
def fold_tail(s: pd.Series) -> pd.Series:
    """Upper case and full compatibility decomposition without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x.upper()) if not 0x300 <= ord(c) <= 0x36F))


def with_normalized(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the normal form for any script: rows beyond Latin take the Python way, all others stay in generated code."""
    far = F.coalesce(F.col(column), F.lit("")).rlike(r"[^\x{0000}-\x{024F}]")
    near = df.filter(~far).withColumn(to, normalize_name(F.col(column)))
    return near.unionByName(df.filter(far).withColumn(to, _normal_from(fold_tail(split_type_tag(F.col(column))[0]))))


def _words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def _is_in(t: Column, words: list[str]) -> Column:
    return t.isin(words)


def blocking_key(raw: Column) -> Column:
    """Sorted tokens without noise words and suffixes; all tokens, sorted, if none is left."""
    return _key_from(normalize_name(raw))


def _key_from(normal: Column) -> Column:
    tokens = _words(normal)
    bare = F.filter(tokens, lambda t: ~_is_in(t, STOPWORDS + CORPORATE + POLITICAL))
    return F.array_join(F.array_sort(F.when(F.size(bare) > 0, bare).otherwise(tokens)), " ")


def significant_tokens(raw: Column) -> Column:
    return _tokens_from(normalize_name(raw))


def _tokens_from(normal: Column) -> Column:
    return F.array_distinct(F.filter(_words(normal), lambda t: (F.length(t) > 1) & ~_is_in(t, STOPWORDS)))


def looks_truncated(raw: Column, width: int = TRUNCATED) -> Column:
    return F.length(split_type_tag(raw)[0]) >= width


def looks_like_person(raw: Column) -> Column:
    s = strip(raw)
    return ~s.rlike(ORGANIZATION) & s.rlike(PERSON)


def display_name(raw: Column) -> Column:
    """LAST, FIRST as FIRST LAST for persons."""
    s, pattern = strip(raw), r"^([^,]+),\s*(.+)\z"
    turned = F.concat(strip(F.regexp_extract(s, pattern, 2)), F.lit(" "), strip(F.regexp_extract(s, pattern, 1)))
    return F.when(looks_like_person(raw) & s.rlike(pattern), squeeze(turned)).otherwise(s)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the whole string, two blanks before and one after."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, each padded on its own."""
    return F.array_distinct(F.flatten(F.transform(_words(text), trigrams)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))


def string_similarity(a: Column, b: Column) -> Column:
    """Jaccard over whole-string trigrams; equal strings 1, an empty one 0."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(jaccard(trigrams(a), trigrams(b)))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard over word trigrams, as the trigram index of a database has it."""
    return F.coalesce(jaccard(word_trigrams(a), word_trigrams(b)), F.lit(0.0))


def _overlap(x: Column, y: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared significant tokens over the smaller set; 0 if either is empty."""
    return _overlap(significant_tokens(a), significant_tokens(b))


def profile(raw: Column) -> Column:
    """What matching needs of a name, to be computed once a name before pairs are formed: normal form, trigrams, tokens, key."""
    return profile_from(normalize_name(raw))


def profile_from(n: Column) -> Column:
    """``profile`` of a name whose normal form is at hand."""
    return F.struct(n.alias("normal"), F.when(n != "", trigrams(n)).alias("grams"), _tokens_from(n).alias("tokens"), _key_from(n).alias("key"))


def score_match(a: Column, b: Column, truncated: Column | bool = False, zip_a: Column | None = None, zip_b: Column | None = None, city_a: Column | None = None, city_b: Column | None = None, strict_prefix: bool = False) -> Column:
    """``score_profiles`` of two raw names; where a name is in many pairs, make its ``profile`` first."""
    return score_profiles(profile(a), profile(b), truncated, zip_a, zip_b, city_a, city_b, strict_prefix)


def score_profiles(a: Column, b: Column, truncated: Column | bool = False, zip_a: Column | None = None, zip_b: Column | None = None, city_a: Column | None = None, city_b: Column | None = None, strict_prefix: bool = False) -> Column:
    """struct(score, reasons): equal normal forms 1; a prefix of a truncated name .95; else trigrams and tokens, at least .80
    with equal blocking keys, raised by equal ZIP and city, .99 at most. ``strict_prefix``: only ``a`` may be the shorter."""
    none = F.lit(None).cast("string")
    zip_a, zip_b, city_a, city_b = (none if x is None else x for x in (zip_a, zip_b, city_a, city_b))
    truncated = F.lit(truncated) if isinstance(truncated, bool) else truncated
    na, nb = a["normal"], b["normal"]
    short, long = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    cut = truncated & (F.length(short) >= SHORTEST_PREFIX) & F.startswith(long, short)
    if strict_prefix:
        cut = cut & (F.length(na) <= F.length(nb))
    tri = F.when(na == nb, 1.0).when((na == "") | (nb == ""), 0.0).otherwise(jaccard(a["grams"], b["grams"]))
    over = _overlap(a["tokens"], b["tokens"])
    blended = F.lit(TRIGRAM_WEIGHT) * tri + F.lit(OVERLAP_WEIGHT) * over
    same_key = a["key"] == b["key"]
    base = F.when(same_key, F.greatest(blended, F.lit(BLOCK_SCORE))).otherwise(blended)
    za, zb = F.substring(zip_a, 1, 5), F.substring(zip_b, 1, 5)
    given = (za != "") & (zb != "")
    zip5 = F.coalesce(given & (za == zb), F.lit(False))
    zip3 = F.coalesce(given & (za != zb) & (F.length(za) == 5) & (F.length(zb) == 5) & (F.substring(za, 1, 3) == F.substring(zb, 1, 3)), F.lit(False))
    ca, cb = F.upper(strip(city_a)), F.upper(strip(city_b))
    city = F.coalesce((ca == cb) & (ca != ""), F.lit(False))
    raised = base + F.when(zip5, ZIP5_BONUS).when(zip3, ZIP3_BONUS).otherwise(0.0) + F.when(city, CITY_BONUS).otherwise(0.0)
    score = F.when(na == nb, 1.0).when(cut, PREFIX_SCORE).otherwise(F.least(raised, F.lit(MOST)))
    why = F.filter(
        F.array(
            F.when(same_key, "same-blocking-key"), F.format_string("trigram=%.2f", tri), F.format_string("overlap=%.2f", over),
            F.when(zip5, "zip-match").when(zip3, "zip3-match"), F.when(city, "city-match"),
        ),
        lambda r: r.isNotNull(),
    )
    reasons = F.when(na == nb, F.array(F.lit("exact-normalized"))).when(cut, F.array(F.lit("truncated-prefix"))).otherwise(why)
    return F.struct(score.alias("score"), reasons.alias("reasons"))


def verdict(score: Column) -> Column:
    return F.when(score >= AUTO_LINK, "LINK").when(score >= REVIEW_FLOOR, "review").otherwise("-")
