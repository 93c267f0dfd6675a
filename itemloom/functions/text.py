"""Text expressions. All of them stay JVM-side; no UDF is used."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

# Words dropped from a normalised description.
STOPWORDS = [
    "A", "AS", "O", "OS", "DE", "DA", "DO", "DAS", "DOS", "COM", "PARA", "POR",
    "E", "EM", "NA", "NO", "NAS", "NOS", "UM", "UMA",
]

# Standard unit and the spellings that stand for it. A spelling
# that is not listed is kept as it is.
UNIT_SPELLINGS = {
    "UN": ["UND", "UNID", "UNIDADE"],
    "PC": ["PCA", "PCE", "PECA", "PEC"],
    "KG": ["QUILO", "KILO"],
    "G": ["GR", "GRAMA"],
    "LT": ["L", "LITRO"],
    "CX": ["CAIXA"],
    "FD": ["FARDO"],
    "SC": ["SACO"],
    "JG": ["JOGO"],
}

#: Everything ``str.strip`` removes.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

PIPELINE = "pipeline"
APP = "app"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode whitespace; an empty text stays empty."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_column(name: str) -> Column:
    """:func:`strip` of a text column, which most values leave as they are.

    The built-in function looks at every character and each that it may remove;
    a text that begins and ends with a visible ASCII character has none of them.
    """
    c = F.col(name)
    last = F.substring(c, -1, 1)
    return F.when((c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f"), c).otherwise(strip(c))


def without_accents(text: str) -> str:
    """Driver-side accent removal for names (columns, not data)."""
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


class FoldTable(NamedTuple):
    """How non-ASCII characters turn into ``A-Z0-9``."""

    source: str  # characters that become one character, then those to delete
    target: str  # the replacements; shorter than ``source``
    several: dict[str, str]  # characters that become more than one character


def _upper_folded(char: str, variant: str) -> str:
    if variant == PIPELINE:
        return without_accents(char.upper())
    return without_accents(char).upper()


def _common_symbol(char: str) -> bool:
    """Latin letters and general punctuation, which most texts draw from."""
    return char < "\u0300" or "\u2000" <= char < "\u2070"


@lru_cache(maxsize=None)
def fold_table(variant: str = PIPELINE) -> FoldTable:
    """Derive the table from the Unicode database.

    The two variants differ in the order of upper-casing and accent removal:
    ``º`` folds to ``O`` only when accents are removed first. A frequent
    character without any fold becomes a space, as it would later anyway, so
    that most texts are pure ASCII after one pass.
    """
    one: list[tuple[str, str]] = []
    gone: list[str] = []
    several: dict[str, str] = {}
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        changes = unicodedata.decomposition(char) or unicodedata.combining(char) or char.upper() != char
        if not changes and not _common_symbol(char):
            continue
        folded = _upper_folded(char, variant)
        kept = re.sub("[^A-Z0-9]", " ", folded)
        if folded == "":
            gone.append(char)
        elif not kept.strip():
            if _common_symbol(char):
                one.append((char, " "))
        elif len(kept) == 1:
            one.append((char, kept))
        else:
            several[char] = kept
    return FoldTable(
        "".join(a for a, _ in one) + "".join(gone),
        "".join(b for _, b in one),
        several,
    )


def _char_class(chars: Iterable[str]) -> str:
    """A regular expression class, with neighbours joined to ranges."""
    ranges: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def _is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _fold(c: Column, variant: str) -> Column:
    table = fold_table(variant)
    several = dict(table.several)
    # The one frequent expansion gets a plain replace. The others share a lookup
    # that only rows still holding such a character evaluate.
    c = F.translate(F.replace(c, F.lit("ß"), F.lit(several.pop("ß"))), table.source, table.target)
    lookup = F.map_from_arrays(
        F.split(F.lit("\n".join(several)), "\n"), F.split(F.lit("\n".join(several.values())), "\n")
    )
    spelled_out = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(lookup, ch), ch)), ""
    )
    return F.when(_is_ascii(c), c).when(c.rlike(_char_class(several)), spelled_out).otherwise(c)


def fold_upper(c: Column, variant: str = PIPELINE) -> Column:
    """Upper case without accents. Characters outside ``A-Z0-9`` that have no
    such fold are left for the caller to drop."""
    c = c.cast("string")
    return F.upper(F.when(_is_ascii(c), c).otherwise(_fold(c, variant)))


def normalize_description(c: Column, variant: str = PIPELINE) -> Column:
    """Upper case, no accents, only ``A-Z0-9`` words, no stopwords.

    A description without any word left is NULL in the pipeline variant and
    empty in the app variant.
    """
    words = F.regexp_replace(fold_upper(c, variant), "[^A-Z0-9]+", " ")
    kept = F.trim(F.regexp_replace(words, r"\b(?:" + "|".join(STOPWORDS) + r")\b ?", ""))
    if variant == PIPELINE:
        # nullif works its argument out once; a CASE would do so twice.
        return F.nullif(kept, F.lit(""))
    return F.coalesce(kept, F.lit(""))


def normalize_unit(c: Column) -> Column:
    """Standard spelling of a unit; unknown units are kept, empty is NULL."""
    u = F.regexp_replace(fold_upper(c), "[^A-Z0-9]", "")
    spelled = reduce(
        lambda chain, item: chain.when(u.isin(item[1]), F.lit(item[0])),
        UNIT_SPELLINGS.items(),
        F.when(u == "", F.lit(None).cast("string")),
    )
    return spelled.otherwise(u)


def natural_key(c: Column) -> Column:
    """Sort key that compares runs of digits as numbers and the rest in lower
    case. Numbers of any length compare exactly: first by their number of
    significant digits, then digit by digit."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit("([^0-9]*)([0-9]*)"), F.lit(0))

    def part(run: Column) -> Column:
        digits = F.regexp_extract(run, "([0-9]*)$", 1)
        significant = F.regexp_replace(digits, "^0+", "")
        has_digits = digits != ""
        return F.struct(
            F.lower(F.regexp_replace(run, "[0-9]*$", "")).alias("text"),
            F.when(has_digits, F.length(significant)).alias("magnitude"),
            F.when(has_digits, significant).alias("digits"),
        )

    # A number is one run and the empty one at the end; most keys are numbers, and need no search for runs.
    only_digits = F.ltrim(text, F.lit("0"))
    number = F.array(
        F.struct(F.lit("").alias("text"), F.length(only_digits).alias("magnitude"), only_digits.alias("digits")),
        F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("magnitude"), F.lit(None).cast("string").alias("digits")),
    )
    return F.when(text.rlike("^[0-9]+\\z"), number).otherwise(F.transform(runs, part))


def natural_sorted(values: Column) -> Column:
    """A text array in natural order; the raw text breaks ties."""
    keyed = F.transform(values, lambda v: F.struct(natural_key(v).alias("key"), v.alias("raw")))
    return F.transform(F.array_sort(keyed), lambda e: e["raw"])


def word_count(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\s+")))


def html_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c
