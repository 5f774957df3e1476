"""Text expressions: normalisation, signatures, truncation and token estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the compatibility check takes as one family of primitive types.
PRIMITIVES = ("object", "string", "int", "long", "double", "float", "bool", "decimal")

# Beginnings of method names and what they are for.
RESPONSIBILITIES = {
    "Data Access": ("Get", "Set"),
    "Validation": ("Validate", "Check"),
    "Calculation": ("Calculate", "Compute"),
    "Persistence": ("Save", "Load", "Delete"),
    "Rendering": ("Render", "Draw"),
    "Communication": ("Send", "Receive"),
    "Data Processing": ("Parse", "Format"),
}


def normalise_code(source: Column) -> Column:
    """Comments out, white space squeezed, identifiers to one word."""
    out = F.regexp_replace(source, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"(?m)//.*$", "")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", "IDENTIFIER"))


def sha256_base64(text: Column) -> Column:
    return F.base64(F.unhex(F.sha2(text, 256)))


def checksum(content: Column, algorithm: str) -> Column:
    """Hex digest by name: SHA256, SHA512, SHA1 or MD5."""
    made = {"SHA256": lambda c: F.sha2(c, 256), "SHA512": lambda c: F.sha2(c, 512), "SHA1": F.sha1, "MD5": F.md5}
    return made[algorithm.upper()](content)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty strings are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def token_types(source: Column) -> Column:
    """One sign a token: ``q`` quoted, ``i`` identifier or keyword, ``0`` number, others as they are; no white space."""
    out = F.regexp_replace(source, r'"[^"]*"', "\u0001")
    out = F.regexp_replace(F.regexp_replace(out, r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*", "i"), "[0-9]+", "0")
    return F.regexp_replace(F.regexp_replace(out, "[ \t\n\x0b\f\r]+", ""), "\u0001", "q")


def token_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of two sequences of token types: 1 where both are empty, 0 where one is."""
    return similarity(token_types(a), token_types(b))


def semantic_similarity(kind: tuple[Column, Column], container: tuple[Column, Column], namespace: tuple[Column, Column]) -> Column:
    """By what two blocks share: 0 where kinds differ, 0.9 in one type, 0.7 in one namespace, 0.5 otherwise."""
    shared = F.when(container[0].eqNullSafe(container[1]), 0.9).when(namespace[0].eqNullSafe(namespace[1]), 0.7).otherwise(0.5)
    return F.when(kind[0].eqNullSafe(kind[1]), shared).otherwise(0.0)


def structural_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of two arrays of one length; 0 where lengths differ, 1 where both are empty."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(equal / F.size(a))


def type_compatible(a: Column, b: Column) -> Column:
    """Equal, both primitive, or the same generic head."""
    head = F.substring_index(a, "<", 1) == F.substring_index(b, "<", 1)
    primitive = a.isin(list(PRIMITIVES)) & b.isin(list(PRIMITIVES))
    return (a == b) | primitive | (a.contains("<") & b.contains("<") & head)


def responsibility(name: Column) -> Column:
    """What a method is for, by how its name begins."""
    return F.coalesce(*(F.when(name.rlike(f"^({'|'.join(starts)})"), group) for group, starts in RESPONSIBILITIES.items()), F.lit("Other"))


def valid_identifier(name: Column, keywords: tuple = ()) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~name.isin(list(keywords) or [""])


def pascal_case(text: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(text, r"[-_\s]+", " ")), " ", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(text) * 0.25).cast("long")


def truncate(text: Column, limit: int, ellipsis: str = "... [truncated]") -> Column:
    """At most ``limit`` characters, ellipsis included; cut at the last space if that keeps over 80 %."""
    room = max(0, limit - len(ellipsis))
    cut = F.substring(text, 1, room)
    words = F.regexp_replace(cut, "(?s) [^ ]*$", "")
    short = F.when(cut.contains(" ") & (F.length(words) > 0.8 * room), words).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(short, F.lit(ellipsis)))


def truncate_units(text: Column, limit: int, separator: str) -> Column:
    """As many whole paragraphs or lines from the start as fit into ``limit`` characters, at least one."""
    parts = F.split(text, re.escape(separator), -1)
    step = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("k"), F.lit(True).alias("open")),
        lambda s, x: F.struct(
            F.when(s["open"] & (s["n"] + F.length(x) <= limit), s["n"] + F.length(x) + len(separator)).otherwise(s["n"]).cast("int").alias("n"),
            F.when(s["open"] & (s["n"] + F.length(x) <= limit), s["k"] + 1).otherwise(s["k"]).cast("int").alias("k"),
            (s["open"] & (s["n"] + F.length(x) <= limit)).alias("open"),
        ),
    )
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(step["k"], F.lit(1))), separator)
