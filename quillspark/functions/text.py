"""Text functions: normalisation, tokens, n-grams, feature maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The contractions that are written out, in this order.
CONTRACTIONS = (
    ("wont", "won't"),
    ("dont", "don't"),
    ("wasnt", "wasn't"),
    ("werent", "weren't"),
    ("aint", "am not"),
    ("arent", "are not"),
    ("cant", "can not"),
    ("didnt", "did not"),
    ("havent", "have not"),
    ("ive", "I have"),
    ("isnt", "is not"),
    ("theyll", "they will"),
    ("thats", "that's"),
    ("whats", "what's"),
    ("wouldnt", "would not"),
    ("im", "I am"),
    ("youre", "you are"),
    ("youve", "you have"),
    ("ill", "i will"),
)
TOKEN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]"
SENTENCE_END = "(?<=[.!?])\\s+"


def normalized(text: Column, lower: bool = True) -> Column:
    """lower case (optional), trim, one space for any white space, then the contractions."""
    out = F.lower(text) if lower else text
    out = F.regexp_replace(F.trim(out), "[\\n\\t ]+", " ")
    for short, full in CONTRACTIONS:
        out = F.regexp_replace(out, f"(?i)\\b{short}\\b", full)
    return out


def length_feature(text: Column) -> Column:
    """ceil(log2(length)) in integer arithmetic; an empty text has none."""
    n = F.length(text)
    return F.when(n == 1, 0).when(n > 1, F.length(F.bin(n - 1)))


def sentences(text: Column) -> Column:
    """sentence texts."""
    return F.split(F.trim(text), SENTENCE_END)


def tokens(text: Column) -> Column:
    """words, and signs one by one."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentence_tokens(text: Column) -> Column:
    """the tokens of each sentence."""
    return F.transform(sentences(text), lambda s: tokens(s))


def spaces_collapsed(text: Column) -> Column:
    """Line-break tags and white space become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<br>", " "), "\\s+", " "))


def number(text: Column, kind: str = "bigint") -> Column:
    """A number written with commas; null if it is none."""
    return F.regexp_replace(text, ",", "").try_cast(kind)


def ascii_only(text: Column) -> Column:
    """Characters outside ASCII dropped."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "")


def arff_text(text: Column) -> Column:
    """T4: lower case, without quotes and backslashes."""
    return F.translate(F.lower(text), "'\"\\", "")


def underscores_to_spaces(text: Column) -> Column:
    return F.translate(text, "_", " ")


def joined_from(parts: Column, start: int = 4, sep: str = " ") -> Column:
    """The parts from index ``start`` on, joined."""
    return F.array_join(F.slice(parts, start + 1, F.greatest(F.size(parts) - start, F.lit(0))), sep)
