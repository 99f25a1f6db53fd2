"""Column functions on text: invisible characters, normal forms, escapes. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The invisible characters, their names and the marks that show them.
INVISIBLE = {
    "\u200b": ("ZERO WIDTH SPACE", "ZWSP"),
    "\u200c": ("ZERO WIDTH NON-JOINER", "ZWNJ"),
    "\u200d": ("ZERO WIDTH JOINER", "ZWJ"),
    "\u2060": ("WORD JOINER", "WJ"),
    "\ufeff": ("ZERO WIDTH NO-BREAK SPACE", "BOM"),
    "\u00ad": ("SOFT HYPHEN", "SHY"),
}
TAG_NAME = "UNICODE TAG CHARACTERS"
#: Tag characters mirror ASCII from here on.
TAG_BASE = 0xE0000
IN_INVISIBLE = "".join(INVISIBLE)
IN_TAGS = r"\x{E0000}-\x{E007F}"
#: White space as Python's str.isspace knows it.
SPACE = r"\s\x1c-\x1f\x85"
MAX_SNIPPET = 1000


def count_invisible(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{IN_INVISIBLE}{IN_TAGS}]"))


def count_tags(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{IN_TAGS}]"))


def decode_tags(text: Column) -> Column:
    """The ASCII message of the printable tag characters."""
    plain = "".join(map(chr, range(0x20, 0x7F)))
    hidden = "".join(chr(TAG_BASE + ord(c)) for c in plain)
    return F.translate(F.regexp_replace(text, r"[^\x{E0020}-\x{E007E}]", ""), hidden, plain)


def tag_encode(message: str) -> str:
    return "".join(chr(TAG_BASE + ord(c)) for c in message)


def lone_artifact_free(char: str) -> str:
    """A pattern for an occurrence of char that hides something: beside another invisible one, or inside a word."""
    return rf"(?U)(?<=[{IN_INVISIBLE}]){char}|{char}(?=[{IN_INVISIBLE}])|(?<=[^{SPACE}]){char}(?=[^{SPACE}])"


def invisible_names(text: Column) -> Column:
    """Sorted names of the invisible characters that are no layout artifacts, then the tag characters' name if any."""
    found = [F.when(F.contains(text, F.lit(c)) & text.rlike(lone_artifact_free(c)), F.lit(name)) for c, (name, _) in sorted(INVISIBLE.items(), key=lambda x: x[1][0])]
    return F.array_compact(F.array(*found, F.when(count_tags(text) > 0, F.lit(TAG_NAME))))


def reveal(text: Column) -> Column:
    for char, (_, mark) in INVISIBLE.items():
        text = F.replace(text, F.lit(char), F.lit(f"⟦{mark}⟧"))
    return text


def code_point(char: str) -> str:
    return f"U+{ord(char):04X}"


def annotate(text: Column) -> Column:
    """The text with every invisible character shown, under a note with their counts and the decoded tag text."""
    order = sorted(INVISIBLE, key=code_point)
    counts = [F.when(F.contains(text, F.lit(c)), F.concat(F.lit(f"{code_point(c)} x"), F.regexp_count(text, F.lit(c)).cast("string"))) for c in order]
    tags = count_tags(text)
    parts = F.array_compact(F.array(*counts, F.when(tags > 0, F.concat(F.lit("tag chars x"), tags.cast("string")))))
    listed = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.lit("none"))
    decoded = decode_tags(text)
    note = F.concat(F.lit("[scanner note: "), count_invisible(text).cast("string"), F.lit(" invisible characters ("), listed, F.lit(")"), F.when(decoded != "", F.concat(F.lit('; decoded hidden tag-character text: "'), decoded, F.lit('"'))).otherwise(F.lit("")), F.lit("]\n"))
    # Runs of tag characters and the stretches between them alternate.
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)[{IN_TAGS}]+|[^{IN_TAGS}]+"), F.lit(0))
    shown = F.array_join(F.transform(pieces, lambda p: F.when(count_tags(p) > 0, F.concat(F.lit("⟦"), F.char_length(p).cast("string"), F.lit(" TAG CHARS⟧"))).otherwise(p)), "")
    for c in INVISIBLE:
        shown = F.replace(shown, F.lit(c), F.lit(f"⟦{code_point(c)}⟧"))
    return F.concat(note, shown)


def normalize(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def words(text: Column) -> Column:
    """The normalised words between white space, without empty ones."""
    parts = F.split(text, rf"(?U)[{SPACE}]+")
    return F.filter(F.transform(parts, normalize), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def has_invisible(text: Column) -> Column:
    return text.rlike(f"[{IN_INVISIBLE}{IN_TAGS}]")


def is_transparent(text: Column) -> Column:
    """Blank, or nothing but invisible characters between white space at the ends."""
    return text.rlike(rf"(?U)^[{SPACE}]*[{IN_INVISIBLE}\x{{E0000}}-\x{{10FFFF}}]*[{SPACE}]*$")


def has_letters(text: Column, least: int) -> Column:
    """Whether at least so many letters and digits are in the text; stops at the last one needed."""
    return text.rlike(rf"(?s)(?:[\p{{L}}\p{{N}}].*?){{{least}}}")


def ascii_words(text: Column) -> Column:
    """How many runs of two or more ASCII letters there are."""
    return F.regexp_count(text, F.lit("[a-zA-Z]{2,}"))


def escape_snippet(text: Column, tag: str) -> Column:
    """At most MAX_SNIPPET characters, then &, < and > escaped, then the delimiter's own name removed."""
    cut = F.substring(text, 1, MAX_SNIPPET)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        cut = F.replace(cut, F.lit(raw), F.lit(safe))
    return F.regexp_replace(cut, f"(?i){re.escape(tag)}", "[removed]")


def collapsed(text: Column) -> Column:
    """Lower case, white space runs to one space, none at the ends."""
    return F.regexp_replace(strip(F.lower(text)), rf"(?U)[{SPACE}]+", " ")


def cache_key(normal_form: Column) -> Column:
    """The key of a text given in NFKC form (udfs.nfkc; ASCII texts are in it as they are)."""
    return F.sha2(collapsed(normal_form).cast("binary"), 256)


def is_true(value: Column) -> Column:
    """Truth of a setting's text: unset or empty is not decided here (null), these four words are false."""
    v = F.lower(F.trim(value))
    return F.when(v != "", ~v.isin("0", "false", "no", "off"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def base_name(filename: Column) -> Column:
    """The file name without its suffix; upload where there is none."""
    return F.regexp_replace(F.coalesce(F.nullif(filename, F.lit("")), F.lit("upload.pdf")), r"\.pdf$", "")
