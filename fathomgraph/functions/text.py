"""Column expressions for paper texts, dictionary words and entity names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered literal replacements, applied one after the other.
REPLACE_FULL = [
    ("\n", " "), ("-", " "), (' " a', "oa"), ('" a', "ae"), ('"a', "ae"), (' " o', "oe"), ('" o', "oe"),
    ('"o', "oe"), (' " u', "ue"), ('" u', "ue"), ('"u', "ue"), (" ' a", "a"), (" ' e", "e"), (" ' o", "o"),
    ("' ", ""), ("'", ""), ("  ", " "), ("  ", " "),
]
REPLACE_SHORT = [
    ("\n", " "), ("-", " "), ('"a', "ae"), ('"o', "oe"), ('"u', "ue"), ("' ", ""), ("'", ""), ("  ", " "), ("  ", " "),
]
REPLACE_THREE = [("\n", " "), ("-", " "), ("  ", " ")]

# Characters that may stand next to a whole-word match.
BOUNDARY_CHARS = " ,.;:!?()[]{}\"'-\n\t\r"

# Characters removed from entity names.
ENTITY_NOISE = '~"$%\\/'

# Escaped bracket tokens and the brackets they stand for.
BRACKET_TOKENS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def replace_in_order(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def abstract_from_index(index: Column) -> Column:
    """Text of a word -> positions map, ordered by (position, word)."""
    placed = F.transform(
        F.map_entries(index),
        lambda e: F.transform(
            F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p.isNotNull()),
            lambda p: F.struct(p.alias("pos"), e["key"].alias("word")),
        ),
    )
    return F.array_join(F.transform(F.array_sort(F.flatten(placed)), lambda s: s["word"]), " ")


def paper_abstract(index: Column, abstract: Column) -> Column:
    """Abstract from the inverted index, the plain abstract where there is no index, else ''."""
    return F.when(F.size(index) > 0, abstract_from_index(index)).otherwise(F.coalesce(abstract, F.lit("")))


def paper_text(title: Column, abstract: Column, pairs: Sequence[tuple[str, str]] = REPLACE_FULL, strip: bool = False) -> Column:
    """lower(title + ' ' + abstract), missing parts as '', then the ordered replacements."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))
    if strip:
        text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return replace_in_order(text, pairs)


def is_boundary(char: Column) -> Column:
    """True for a boundary character; the padding at the ends of a text is a blank."""
    return char.isin(*BOUNDARY_CHARS)


def strip_parentheses(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), r"\s*\([^)]*\)", ""))


def strip_noise(name: Column) -> Column:
    kept = F.translate(name, ENTITY_NOISE, "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def is_plural(name: Column) -> Column:
    """Ends in one s, and either has an all-upper stem or no digit; the order of the tests matters."""
    stem = F.regexp_replace(name, "s$", "")
    upper_stem = (F.upper(stem) == stem) & (F.lower(stem) != stem)
    return (
        F.when(~name.endswith("s"), False)
        .when(name.endswith("ss"), False)
        .when(upper_stem, True)
        .when(name.rlike("[0-9]"), False)
        .otherwise(True)
    )


def singular(name: Column) -> Column:
    """ies -> y, else es dropped, else s dropped; names that are not plural stay."""
    return (
        F.when(~is_plural(name), name)
        .when(name.endswith("ies"), F.regexp_replace(name, "ies$", "y"))
        .when(name.endswith("es"), F.regexp_replace(name, "es$", ""))
        .otherwise(F.regexp_replace(name, "s$", ""))
    )


def unescape_brackets(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BRACKET_TOKENS.items() for x in pair])
    # Most sentences hold no code and stay as they are.
    coded = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in BRACKET_TOKENS]))
    return F.when(coded, F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))).otherwise(tokens)
