"""Text statistics as SQL expressions: no Python on the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space between words, and the symbols counted
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between white space, in order; an empty array for text without any."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def without(text: Column, chars: str) -> Column:
    """Code points of text that are not among chars."""
    return F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return without(text, WHITE).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - without(text, SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words in windows of three words that the text holds twice or more, the first occurrence included.

    Windows are hashed; only where two are equal are they sorted, so the cost is n log n."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i) ["h"] == x["h"]) & F.get(s, i).isNotNull()
        hits = F.filter(s, lambda x, i: F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
        return let(F.array_sort(F.transform(hits, lambda x: x["p"])), covered)

    def windows(v: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
        return let(
            h,
            lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(x, lambda y, i: F.struct(y.alias("h"), i.alias("p")))), repeated)
            ),
        )

    return let(w, lambda v: F.when(F.size(v) < 4, F.lit(0).cast("long")).otherwise(windows(v)))
