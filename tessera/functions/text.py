"""Column expressions over text: folding, tokens, snippets, vectors."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
SNIPPET_BYTES = 800


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Accented letters and their base letters; combining marks, which come last, have none and go."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn")
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def fold(x: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(x), *fold_table())


def fold_text(s: str) -> str:
    old, new = fold_table()
    return s.lower().translate({ord(c): (new[i] if i < len(new) else None) for i, c in enumerate(old)})


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(TOKEN), F.lit(0))


def phrases(query: str) -> list[list[str]]:
    """Query words, each a phrase of folded tokens of which the last is a prefix; repeats stay, empty ones go.

    Words are runs of ASCII letters, digits and underscores; the tokeniser splits them at underscores.
    """
    out = [[t for t in re.split(r"_+", fold_text(w)) if t] for w in re.findall(r"[A-Za-z0-9_]+", query)]
    return [p for p in out if p]


def truncate_runes(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def snippet(x: Column, limit: int = SNIPPET_BYTES) -> Column:
    """At most ``limit`` bytes, cut between code points, and an ellipsis where cut."""
    raw = F.substring(F.encode(x, "UTF-8"), 1, limit)
    # A cut inside a code point leaves a lead byte and fewer continuation bytes than it asks for.
    last = lambda k: F.conv(F.hex(F.substring(F.encode(x, "UTF-8"), limit + 1 - k, 1)), 16, 10).cast("int")
    starts = lambda k: ~last(k).between(128, 191)
    keep = F.when(starts(0), limit).when(starts(1), limit - 1).when(starts(2), limit - 2).otherwise(limit - 3)
    cut = F.decode(F.substring(raw, F.lit(1), keep), "UTF-8")
    return F.when(F.octet_length(x) <= limit, x).otherwise(F.concat(cut, F.lit("…")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def hash_embedding(words: Column, dim: int) -> Column:
    """Feature hashing: counts of tokens by the first 32 bits of their md5, modulo ``dim``."""
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    # What is left without a bucket's hits: one built-in pass for each bucket, where a filter would call a lambda for each word.
    count = lambda hits: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(hits) - F.size(F.array_remove(hits, i))).cast("float"))
    # Bound to a variable of an outer lambda, so that words are hashed once and not once for each bucket.
    return F.get(F.transform(F.array(F.transform(words, bucket)), count), F.lit(0))
