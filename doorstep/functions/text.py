"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


# Everything that counts as white space at the ends of a text.
WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def stripped(value: Column) -> Column:
    """Text without white space at either end; empty rather than NULL when nothing is left."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(value: Column) -> Column:
    """NULL for both NULL and the empty string; the value otherwise."""
    return F.nullif(value, F.lit(""))


def first_present(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[present(value) for value in values])


def trimmed(value: Column) -> Column:
    """Trimmed text; NULL when nothing but white space is left."""
    return present(stripped(value))


def squeezed(value: Column) -> Column:
    """Trimmed text with inner white space collapsed; empty rather than NULL."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def compact(value: Column) -> Column:
    """Comparison key: lower case, ASCII letters and digits only; empty for NULL."""
    return F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def folded(value: Column) -> Column:
    """Case-insensitive sort key. `lower` leaves the sharp s alone, case folding does not."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition of the basic plane, derived from the Unicode database.

    Returns (from, to, dropped, expanding): characters that become one ASCII character,
    combining marks that vanish, and characters that become several ASCII characters.
    """
    source, target, dropped, expanding = [], [], [], {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            dropped.append(char)
            continue
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char or not any(c.isascii() and c.isalnum() for c in plain):
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            expanding[char] = "".join(c if c.isascii() else " " for c in plain)
    return "".join(source), "".join(target), "".join(dropped), expanding


def unaccented(value: Column) -> Column:
    """Compatibility-decomposed text without combining marks, as far as ASCII goes.

    One `translate` covers every character with a one-character base letter. Characters
    that expand to several ("½", "ﬁ") take a second step that only runs on rows holding one;
    a row that is ASCII by then is not searched for them.
    """
    source, target, dropped, expanding = _decompositions()
    table = F.create_map(*[F.lit(part) for pair in expanding.items() for part in pair])
    other = r"[^\x00-\x7f]"
    wide = f"(?={other})[{_ranges(expanding)}]"

    def spelled(single: Column) -> Column:
        return F.array_join(
            F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
        )

    def expanded(single: Column) -> Column:
        return (
            F.when(~single.rlike(other), single)
            .when(single.rlike(wide), spelled(single))
            .otherwise(single)
        )

    return F.when(~value.rlike(other), value).otherwise(
        let(F.translate(value, source + dropped, target), expanded)
    )


def _ranges(chars: Iterable[str]) -> str:
    """Characters as the ranges of a character class in Java's dialect."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def slug(label: Column) -> Column:
    """Machine id of a display label: `Café bar` -> `cafe_bar`. Empty for no letters."""
    plain = F.lower(unaccented(F.coalesce(label, F.lit(""))))
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))


def slugs(category: Column, labels: Column) -> Column:
    """Distinct slugs of a head category and its further labels, in first-seen order."""
    every = F.concat(
        F.array(category), F.coalesce(labels, F.array().cast("array<string>"))
    )
    return F.array_distinct(F.filter(F.transform(every, slug), lambda s: s != ""))


def words(value: Column) -> Column:
    """Lower-case ASCII words of a text, in order."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)
    )


def any_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether any marker occurs in `text`. Plain substring tests stay inside codegen."""
    found = F.lit(False)
    for marker in markers:
        found = found | text.contains(marker)
    return found


def literal_pattern(words_: tuple[str, ...]) -> str:
    """A regular-expression alternation of literal words, for Java's dialect."""
    return "|".join("".join(c if c.isalnum() else "\\" + c for c in word) for word in words_)

