"""String functions with Unicode white space, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII punctuation, the articles, and the option letters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
OPTIONS = ("A", "B", "C", "D", "E")
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, " ")


def light_normalise(c: Column) -> Column:
    """Lower case, outer white space off, inner white space collapsed; null counts as empty."""
    return collapse(strip(F.lower(F.coalesce(c, F.lit("")))))


def remove_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def split_words(c: Column) -> Column:
    """Words between white space; none for an empty string."""
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def answer_tokens(c: Column) -> Column:
    """Lower case, no punctuation, no articles."""
    words = split_words(remove_punctuation(F.lower(F.coalesce(c, F.lit("")))))
    return F.filter(words, lambda x: ~x.isin(*ARTICLES))


def light_tokens(c: Column) -> Column:
    return split_words(light_normalise(c))


def alnum_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lightly normalised string."""
    return F.regexp_extract_all(light_normalise(c), F.lit("[a-z0-9]+"), 0)


def strip_image_token(c: Column) -> Column:
    return strip(F.replace(c, F.lit("[IMAGE]"), F.lit("")))


def first_words(c: Column, n: int = 60) -> Column:
    return F.array_join(F.slice(split_words(c), 1, n), " ")


def first_non_blank(*cols: Column) -> Column:
    """First value that is neither null nor blank, else the empty string."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cols], F.lit(""))


def drop_articles_anywhere(c: Column) -> Column:
    """The lenient answer form: article and blank removed wherever the letters occur."""
    out = strip(F.lower(c))
    for word in ("a ", "an ", "the "):
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


# The two forms of a generated answer.
ANSWER, LOOSE_ANSWER = r"The answer is ([A-Z]).", r"\b(?:The answer is|Answer:)\s*([A-Z])\b"


def extract_letter(c: Column, loose: bool = False) -> Column:
    """Option letter of a generated answer; FAILED unless exactly one (or, loosely, the first) is found."""
    if loose:
        found = F.regexp_extract_all(c, F.lit(LOOSE_ANSWER), 1)
        return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.lit("FAILED"))
    found = F.regexp_extract_all(c, F.lit(ANSWER), 1)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.lit("FAILED"))


def letter_index(letter: Column, n_choices: Column, seed_parts: Column) -> Column:
    """0-based option index; an unusable letter gets a hash of ``seed_parts`` modulo the choices."""
    at = F.array_position(F.slice(F.array(*map(F.lit, OPTIONS)), F.lit(1), n_choices), letter) - 1
    return F.when(at >= 0, at).otherwise(F.pmod(F.xxhash64(seed_parts), n_choices)).cast("int")


def file_name_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def short_path(c: Column, keep: int = 2) -> Column:
    """Last ``keep`` non-empty path components; null and blank paths are unchanged."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), F.lit(keep)), "/")
    return F.when(c.isNull() | (strip(c) == ""), c).otherwise(tail)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r".(\.[^.]*)$", 1))


def join_path(root: Column, c: Column) -> Column:
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), c))


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def seed_u32(c: Column) -> Column:
    """First eight hex digits of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("long")


def seed_mod(c: Column, modulus: int = 2**31 - 1) -> Column:
    """SHA-1 modulo a number, digit by digit (160 bits fit no numeric type)."""
    digits = F.filter(F.split(F.sha1(c), ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % modulus)
