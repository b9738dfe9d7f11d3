"""Text expressions: trimming, tokens, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that carry no ranking signal.
STOPWORDS = (
    "a an and are as at be but by for from has have in into is it its of on or that the their this to was were which with"
).split()
#: What trimming takes as blank (ECMAScript's white space and line ends).
BLANK = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SEPARATOR = r"[^\p{L}\p{N}]+"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, without stopwords; null gives no tokens."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    return F.filter(words, lambda t: (t != "") & ~t.isin(STOPWORDS))


def snippet(text: Column, length: int = 200) -> Column:
    """The first characters, blank runs made one space."""
    return F.regexp_replace(F.substring(text, 1, length), f"[{BLANK}]+", " ")


def body_of(title: Column, text: Column) -> Column:
    """Title and text as one document; an empty title adds nothing."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(source.cast("string"), F.lit("#"), index.cast("string"))


def document_of(chunk: Column) -> Column:
    """What stands before the last #; without one the id loses its last character."""
    cut = F.length(chunk) - F.instr(F.reverse(chunk), "#")
    return F.when(F.instr(chunk, "#") > 0, chunk.substr(F.lit(1), cut)).otherwise(chunk.substr(F.lit(1), F.greatest(F.length(chunk) - 1, F.lit(0))))
