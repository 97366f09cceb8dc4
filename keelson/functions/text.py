"""Text expressions: tokens, names, dates, similarity."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from keelson.functions.lexicons import COMPANY_SUFFIXES, DAYS_PER_UNIT, NEGATIONS, RISK_TERMS

# A word character, spelled out because \b and \w differ between Java versions.
WORD = r"[\p{L}\p{N}_]"
# All white space of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    A plain expression would be copied into every use, and again when filters are pushed down.
    """
    return F.get(F.transform(F.array(value), body), 0)


def whole_word(pattern: str) -> str:
    return f"(?<!{WORD})(?:{pattern})(?!{WORD})"


def token_set(column: Column) -> Column:
    """Distinct runs of ``[a-z0-9]`` of the lower-cased text; empty for null."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(blank(column)), F.lit("[a-z0-9]+"), F.lit(0))
    )


def article_text(title: Column, snippet: Column, full_text: Column) -> Column:
    joined = F.concat(blank(title), F.lit(" "), blank(snippet), F.lit(" "), blank(full_text))
    return F.trim(joined, F.lit(WHITE_SPACE))


def without_negated_risk(text: Column, negations: Sequence[str] = NEGATIONS) -> Column:
    """Lower-cased text with the denials blanked, one pattern after the other.

    Texts that hold none of the patterns, word limits aside, skip the costly replacements.
    """

    def blanked(lowered: Column) -> Column:
        result = lowered
        for pattern in negations:
            result = F.regexp_replace(result, whole_word(pattern), " ")
        any_ = "|".join(f"(?:{p})" for p in negations)
        return F.when(lowered.rlike(any_), result).otherwise(lowered)

    lowered = F.lower(blank(text))
    return bind(lowered, blanked) if negations else lowered


def has_token(lowered: Column, terms: Sequence[str]) -> Column:
    """Is one of the terms a token (a full run of ``[a-z0-9]``) of the lower-cased text?"""
    usable = [t for t in terms if re.fullmatch("[a-z0-9]+", t)]
    if not usable:
        return F.lit(False)
    return lowered.rlike(f"(?<![a-z0-9])(?:{'|'.join(usable)})(?![a-z0-9])")


def has_risk_signal(
    text: Column, terms: Sequence[str] = RISK_TERMS, negations: Sequence[str] = NEGATIONS
) -> Column:
    """Does the text, denials taken out, hold one of the terms as a token?

    Blanking whole words makes no new tokens, so texts without any term skip it.
    """
    return bind(
        F.lower(blank(text)),
        lambda lowered: F.when(
            has_token(lowered, terms), has_token(without_negated_risk(lowered, negations), terms)
        ).otherwise(F.lit(False)),
    )


_PLAIN_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
)
_ANY_ISO = (
    r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})"
    r"(?:[T ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"
)
_ISO_WEEK = r"^([0-9]{4})(-?)W([0-9]{2})(?:\2([1-7]))?$"


def parse_instant(column: Column) -> Column:
    """ISO-8601 text to an instant; no offset means UTC, anything else than ISO gives null."""
    has_zone = column.rlike(r"[T ].*(Z|[+-][0-9]{2}:[0-9]{2})$")
    plain = F.when(has_zone, column).otherwise(
        F.concat(
            F.when(F.length(column) > 10, column).otherwise(F.concat(column, F.lit("T00:00:00"))),
            F.lit("+00:00"),
        )
    )

    def part(i: int, default: str) -> Column:
        found = F.regexp_extract(column, _ANY_ISO, i)
        return F.when(found == "", F.lit(default)).otherwise(found)

    offset = F.regexp_replace(part(9, "Z"), r"^([+-][0-9]{2}):?([0-9]{2})?$", "$1:$2")
    offset = F.when(F.endswith(offset, F.lit(":")), F.concat(offset, F.lit("00"))).otherwise(offset)
    pieces = [part(1, ""), "-", part(3, ""), "-", part(4, ""), "T", part(5, "00"), ":"]
    pieces += [part(6, "00"), ":", part(7, "00"), ".", part(8, "0"), offset]
    rebuilt = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    def week(i: int) -> Column:
        found = F.regexp_extract(column, _ISO_WEEK, i)
        return F.when(found == "", F.lit("1")).otherwise(found).cast("int")

    first_monday = F.date_trunc("week", F.make_date(week(1), F.lit(1), F.lit(4))).cast("date")
    by_week = F.date_add(first_monday, (week(3) - 1) * 7 + week(4) - 1).cast("string")
    return (
        F.when(column.rlike(_PLAIN_ISO), F.try_to_timestamp(plain))
        .when(column.rlike(_ANY_ISO), F.try_to_timestamp(rebuilt))
        .when(
            column.rlike(_ISO_WEEK) & week(3).between(1, 53),
            F.try_to_timestamp(F.concat(by_week, F.lit("T00:00:00+00:00"))),
        )
    )


def name_tokens(column: Column, suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    """Lower-case words of a company name in order, legal suffixes left out."""
    words = F.split(F.regexp_replace(F.lower(blank(column)), "[^a-z0-9 ]", " "), " +")
    dropped = text_array(["", *suffixes])
    return F.filter(words, lambda w: ~F.array_contains(dropped, w))


def normalized_name(column: Column, suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    return F.array_join(name_tokens(column, suffixes), " ")


#: Pairs of strings whose blocks are searched at once.
PAIRS_AT_ONCE = 256
#: From this length on, letters of the second string that are more frequent than one in a hundred
#: start no block (fixed values of the ratio).
POPULAR_LENGTH, POPULAR_SHARE = 200, 100


def _codes(texts: Sequence[str], filler: int) -> np.ndarray:
    """Code points, one row per text, padded with ``filler``."""
    table = np.full((len(texts), max(map(len, texts), default=0) or 1), filler, np.int32)
    for row, text in zip(table, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<i4")
    return table


def _longest_blocks(a: np.ndarray, b: np.ndarray, starts: np.ndarray):
    """Size, row and column of the longest common run of each pair of rows.

    Of equal runs the first in ``a`` counts, then the first in ``b``. ``starts`` says which places
    of ``b`` may be part of a run.
    """
    pairs, width = b.shape
    size, at_a, at_b = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    run = np.zeros((pairs, width + 1), np.int32)
    for i in range(a.shape[1]):
        ahead = np.zeros_like(run)
        ahead[:, 1:] = np.where((a[:, i : i + 1] == b) & starts, run[:, :-1] + 1, 0)
        run = ahead
        end = run.argmax(1)
        found = run[np.arange(pairs), end]
        longer = found > size
        size[longer], at_a[longer], at_b[longer] = found[longer], (i + 1 - found)[longer], (end - found)[longer]
    return size, at_a, at_b


def _matched_letters(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Letters in the matching blocks of each pair: the longest block, then left and right of it.

    All pairs go on together: every round takes one block out of every open stretch.
    """
    a, b = _codes(left, -1), _codes(right, -2)
    startable = np.ones(b.shape, bool)
    for row, text, codes in zip(startable, right, b, strict=True):
        if len(text) >= POPULAR_LENGTH:
            letters, place, count = np.unique(codes[: len(text)], return_inverse=True, return_counts=True)
            row[: len(text)] = (count <= len(text) // POPULAR_SHARE + 1)[place]
    total = np.zeros(len(left), np.int64)
    pair = np.arange(len(left))
    a_from, b_from = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    a_to, b_to = (np.array([len(t) for t in texts], np.int64) for texts in (left, right))
    while True:
        some = (a_from < a_to) & (b_from < b_to)
        pair, a_from, a_to, b_from, b_to = (x[some] for x in (pair, a_from, a_to, b_from, b_to))
        if not len(pair):
            return total
        rows = a_from[:, None] + np.arange((a_to - a_from).max())
        columns = b_from[:, None] + np.arange((b_to - b_from).max())
        in_a, in_b = rows < a_to[:, None], columns < b_to[:, None]
        rows, columns = np.minimum(rows, a.shape[1] - 1), np.minimum(columns, b.shape[1] - 1)
        own_a = np.where(in_a, a[pair[:, None], rows], -1)
        own_b = np.where(in_b, b[pair[:, None], columns], -2)
        size, at_a, at_b = _longest_blocks(own_a, own_b, startable[pair[:, None], columns])
        at_a, at_b = at_a + a_from, at_b + b_from
        while True:  # frequent letters start no block but may lengthen one
            before = (at_a > a_from) & (at_b > b_from)
            before &= a[pair, np.maximum(at_a - 1, 0)] == b[pair, np.maximum(at_b - 1, 0)]
            at_a, at_b, size = at_a - before, at_b - before, size + before
            after = (at_a + size < a_to) & (at_b + size < b_to)
            ends_a, ends_b = np.minimum(at_a + size, a.shape[1] - 1), np.minimum(at_b + size, b.shape[1] - 1)
            after &= a[pair, ends_a] == b[pair, ends_b]
            size = size + after
            if not (before.any() or after.any()):
                break
        np.add.at(total, pair, size)
        hit = size > 0
        pair = np.concatenate((pair[hit], pair[hit]))
        a_from, a_to = (
            np.concatenate((a_from[hit], (at_a + size)[hit])),
            np.concatenate((at_a[hit], a_to[hit])),
        )
        b_from, b_to = (
            np.concatenate((b_from[hit], (at_b + size)[hit])),
            np.concatenate((at_b[hit], b_to[hit])),
        )


def block_ratios(left: Sequence[str], right: Sequence[str]) -> list[float]:
    """Twice the letters in matching blocks, over all letters; 1 for two empty strings."""
    ratios: list[float] = []
    for at in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
        for x, y, matched in zip(a, b, _matched_letters(a, b).tolist(), strict=True):
            ratios.append(2.0 * matched / (len(x) + len(y)) if x or y else 1.0)
    return ratios


@pandas_udf(ArrayType(DoubleType()))
def _matching_ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    rows = [None if a is None or b is None else list(zip(a, b, strict=True)) for a, b in zip(left, right, strict=True)]
    # Equal strings need no search.
    todo = [(a, b) for row in rows if row is not None for a, b in row if a != b]
    found = iter(block_ratios([a for a, _ in todo], [b for _, b in todo]))
    return pd.Series(
        [None if row is None else [1.0 if a == b else next(found) for a, b in row] for row in rows],
        dtype="object",
    )


def ratio_bound(left: Column, right: Column) -> Column:
    """The largest ratio that two strings of these lengths can reach."""
    a, b = F.length(left), F.length(right)
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2.0 * F.least(a, b) / F.greatest(a + b, F.lit(1)))


def matching_ratios(left: Column, right: Column, needed: Column | None = None) -> Column:
    """Ratcliff-Obershelp ratios of two arrays of strings, element by element.

    The order of the arguments matters. Spark runs a Python function on every row, also below a
    ``when``, so rows where ``needed`` is false are passed as null and skipped.
    """
    return _matching_ratios(left if needed is None else F.when(needed, left), right)


def normalized_similarity(left: Column, right: Column) -> Column:
    ratio = matching_ratios(F.array(left), F.array(right), left != right)
    return F.when(left == right, F.lit(1.0)).otherwise(F.get(ratio, 0))


def name_similarity(left: Column, right: Column) -> Column:
    return normalized_similarity(normalized_name(left), normalized_name(right))


def name_variants(name: Column, aliases: Column) -> Column:
    """The name itself, then the non-blank parts of a ``a|b|c`` alias text."""
    parts = F.transform(F.split(blank(aliases), r"\|"), lambda a: F.trim(a))
    return F.concat(F.array(blank(name)), F.filter(parts, lambda a: a != ""))


def leading_words(words: Column, n: int = 12) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def location_overlap(candidate: Column, context: Column) -> Column:
    """Share of the context's location tokens that the candidate's location has."""
    wanted = F.array_distinct(name_tokens(context))
    shared = F.size(F.array_intersect(name_tokens(candidate), wanted))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        shared / F.greatest(F.size(wanted), F.lit(1))
    )


def contains_all(needles: Column, haystack: Column) -> Column:
    return (F.size(needles) > 0) & (F.size(F.array_except(needles, haystack)) == 0)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets; two empty sets are equal."""
    sizes = F.size(left) + F.size(right)
    return bind(
        F.size(F.array_intersect(left, right)),
        lambda both: F.when(sizes == 0, F.lit(1.0)).otherwise(
            both / F.greatest(sizes - both, F.lit(1))
        ),
    )


def duration_share(lowered: Column) -> Column:
    """First ``<n> day|week|month`` of the text as a share of 30 days, at most 1; 0 if none."""
    pattern = r"([0-9]+)\s*(" + "|".join(DAYS_PER_UNIT) + ")"
    number = F.regexp_extract(lowered, pattern, 1).try_cast("double")
    unit = F.regexp_extract(lowered, pattern, 2)
    days = F.lit(None).cast("double")
    for name, factor in DAYS_PER_UNIT.items():
        days = F.when(unit == name, number * factor / 30).otherwise(days)
    return F.least(F.coalesce(days, F.lit(0.0)), F.lit(1.0))


def model_text(title: Column, text: Column) -> Column:
    return F.concat(blank(title), F.lit(". "), blank(text))


def dollars(column: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(column, 0))


def exact_round(column: Column, digits: int) -> Column:
    """Round like Python: by the exact binary value, halves to even.

    ``round`` and ``bround`` work on the shortest decimal text and so differ where that text
    ends in a 5 that the binary value only approaches. The product with a power of ten is split
    into its rounded part and its exact error; their sum tells on which side of the half the
    value lies.
    """
    return bind(column.cast("double"), lambda x: _rounded(x, digits))


def _rounded(x: Column, digits: int) -> Column:
    scale = float(10 ** (digits + 1))
    product = x * scale
    nearest = F.rint(product)
    split = x * 134217729.0
    high = split - (split - x)
    error = (high * scale - product) + (x - high) * scale
    side = (product - nearest) + error
    units = F.pmod(F.abs(nearest), F.lit(10.0))
    near_half = (units == 5.0) & (F.abs(product - nearest) < 1e-3) & (F.abs(product) < 1e14)
    up, down = (nearest + 5.0) / 10.0, (nearest - 5.0) / 10.0
    even = F.when(F.pmod(up, F.lit(2.0)) == 0.0, up).otherwise(down)
    chosen = F.when(side > 0, up).when(side < 0, down).otherwise(even)
    return F.when(near_half, chosen / float(10**digits)).otherwise(F.round(x, digits))
