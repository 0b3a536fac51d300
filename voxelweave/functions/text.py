"""Text expressions: slugs, span deletion, attribution markers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Token patterns ((?U) gives \s the Unicode meaning).
LATIN_TOKENS = r"(?U)\p{L}+(?:['’-]\p{L}+)*|\p{N}+|[^\p{L}\p{N}\s]"
ZH_TOKENS = r"(?U)\p{IsHan}|[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
PUNCTUATION = r"^\p{P}+$"
WHITESPACE = r"(?U)\s+"

# Function words, in the order they are listed for the study.
EN_FUNCTION_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "to", "of", "in", "on", "at", "for", "from", "with",
    "by", "as", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "have", "has", "had", "will", "would", "can", "could",
    "should", "may", "might", "must", "not", "no", "nor", "it", "its", "they", "them", "their", "he", "she", "we", "you", "i", "me", "my", "our",
    "your",
)
FR_FUNCTION_WORDS = (
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "mais", "donc", "or", "ni", "car", "a", "au", "aux", "en", "dans", "sur", "sous",
    "pour", "par", "avec", "sans", "ce", "cet", "cette", "ces", "je", "tu", "il", "elle", "nous", "vous", "ils", "elles", "me", "te", "se", "ne",
    "pas", "est", "sont", "etait", "etre", "avoir", "ont", "que", "qui", "quoi", "dont",
)

# Marker thresholds relative to the largest positive score of the sentence.
MARKERS = ((0.75, "+++"), (0.40, "++"))


def slug(value: Column) -> Column:
    body = F.lower(F.btrim(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(body == "", F.lit("na")).otherwise(body)


def roi_stem(roi: Column) -> Column:
    return F.regexp_replace(roi, r"^[LR]_", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def delete_span(text: Column, start: Column, end: Column, language: Column) -> Column:
    """Cut [start, end); EN and FR collapse whitespace and trim afterwards."""
    rest = F.concat(F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text)))
    return F.when(language.isin("EN", "FR"), collapsed(rest)).otherwise(rest)


def delete_spans(text: Column, spans: Column, language: Column) -> Column:
    """Cut several spans right to left; EN and FR text is collapsed after every cut, as each cut would be."""
    return F.aggregate(
        F.reverse(F.array_sort(spans)),
        text,
        lambda acc, span: delete_span(acc, span["start"], span["end"], language),
    )


def marker(score: Column, top: Column) -> Column:
    magnitude = F.greatest(score, F.lit(0.0))
    out = F.when((top <= 0) | (magnitude <= 0), F.lit("-"))
    for share, symbol in MARKERS:
        out = out.when(magnitude >= F.lit(share) * top, F.lit(symbol))
    return out.otherwise(F.lit("+"))


def id_range_json(first: Column, last: Column) -> Column:
    """Inclusive integer range as JSON text with ", " separators."""
    body = F.array_join(F.sequence(first, last).cast("array<string>"), ", ")
    return F.when(last >= first, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.lit("[]"))
