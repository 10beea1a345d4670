"""Text expressions: tokens, sentences, chunks, keyword matches, set similarity.

All of them are column expressions that stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TOKEN = r"[a-z0-9_\-\.]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s\-.]?)?\(?\d{3,5}\)?[\s\-.]?\d{3,5}[\s\-.]?\d{3,5}"
URL = r"https?://[^\s,)>\]]+"
GITHUB = r"github\.com/[A-Za-z0-9_-]+"
LINKEDIN = r"linkedin\.com/in/[A-Za-z0-9_-]+"


def tokens(text: Column) -> Column:
    """ASCII words of the lower-cased text; null reads as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """The non-blank sentences of a text, trimmed."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))), lambda s: s != "")


def pack_chunks(text: Column, most: int = 512) -> Column:
    """Sentences packed greedily into chunks of about ``most`` characters.

    A chunk is closed before the sentence that would take it past ``most``; the
    running length counts one more for each sentence.  A longer sentence stays whole.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("size"))

    def step(acc: Column, s: Column) -> Column:
        n = F.length(s)
        full = (acc["size"] + n > most) & (acc["held"] != "")
        joined = F.when(acc["held"] == "", s).otherwise(F.concat_ws(" ", acc["held"], s))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, s).otherwise(joined).alias("held"),
            F.when(full, n + 1).otherwise(acc["size"] + n + 1).alias("size"),
        )

    return F.aggregate(
        sentences(text), empty, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"])))
    )


def words_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def matched(lower_text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that are substrings of an already lower-cased text, in their order.

    Substrings, not tokens: "ann" matches "planning".
    """
    return F.filter(words_array([k.lower() for k in keywords]), lambda k: F.contains(lower_text, k))


def any_of(lower_text: Column, keywords: Sequence[str]) -> Column:
    return F.exists(words_array([k.lower() for k in keywords]), lambda k: F.contains(lower_text, k))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are unlike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def contacts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def joined(parts: Column, by: str = " ") -> Column:
    """Non-empty strings of an array, joined."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), by)


def drive_folder_id(url: Column) -> Column:
    """The folder id in a shared-drive address, or null."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(url, r"/folders/([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit("")),
    )
    return found
