"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.runtime import WHITE, WORD

#: The white-space characters of Unicode, but for the space itself.
_SPACES = "".join(map(chr, [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Words that carry no meaning in a question.
STOP_WORDS = ("the", "is", "are", "what", "how", "where", "when", "who", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for")


def words(text: Column) -> Column:
    """The runs of characters without Unicode white space; null for null. Cheaper than matching each run by a pattern."""
    return F.filter(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def normalize_numbers(text: Column) -> Column:
    """One pass each: decimal comma to point, spaces within thousands dropped, commas within thousands dropped."""
    text = F.regexp_replace(text, "([0-9]+),([0-9]{1,2})(?![\\p{L}0-9_])", "$1.$2")
    text = F.regexp_replace(text, f"([0-9])[{WHITE}]+([0-9]{{3}})", "$1$2")
    return F.regexp_replace(text, "([0-9]+),([0-9]{3})", "$1$2")


def citation(text: Column, document: Column, page: Column, index: Column) -> Column:
    """The text, a blank line and its source; a blank document is an error, an unknown page N/A."""
    blank = document.isNull() | (stripped(document) == "")
    source = F.when(blank, F.raise_error(F.lit("a result without source document cannot be cited"))).otherwise(document)
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n(Source: "), source, F.lit(", page "), F.coalesce(page.cast("string"), F.lit("N/A")), F.lit(", chunk "), F.coalesce(index.cast("string"), F.lit("N/A")), F.lit(")"))


def query_keywords(question: Column) -> Column:
    """Lower-cased words that are no stop words, then the pairs of neighbours of which neither is one."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    w = F.regexp_extract_all(F.lower(question), F.lit("([\\p{L}\\p{N}_]+)"), 1)
    keep = F.filter(w, lambda x: ~F.array_contains(stop, x))
    n = F.size(w)
    pairs = F.when(n > 1, F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.when(~F.array_contains(stop, a) & ~F.array_contains(stop, b), F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))
    return F.concat(keep, F.filter(pairs, lambda x: x.isNotNull()))


def fiscal_period(label: Column) -> Column:
    """'Q3 FY24', 'Q3 2024' and 'Third Quarter 2024' -> 2024-Q3, 'H1 2026' -> 2026-H1, 'May-21' and '2021-05' -> 2021-05; else null."""
    months = F.create_map(*[x for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(label, pattern, group)

    nth = F.create_map(*[x for i, w in enumerate(("first", "second", "third", "fourth"), 1) for x in (F.lit(w), F.lit(f"-Q{i}"))])
    full, spelt = "^(Q[1-4]) (?:FY)?([0-9]{4})$", "(?i)^(first|second|third|fourth) quarter (?:of )?(?:FY)?([0-9]{4})$"
    quarter, half, month, plain = "^(Q[1-4]) FY([0-9]{2})$", "^(H[12]) ([0-9]{4})$", "^([A-Z][a-z]{2})-([0-9]{2})$", "^([0-9]{4})-([0-9]{2})$"
    return (
        F.when(label.rlike(quarter), F.concat(F.lit("20"), part(quarter, 2), F.lit("-"), part(quarter, 1)))
        .when(label.rlike(full), F.concat(part(full, 2), F.lit("-"), part(full, 1)))
        .when(label.rlike(spelt), F.concat(part(spelt, 2), nth[F.lower(part(spelt, 1))]))
        .when(label.rlike(half), F.concat(part(half, 2), F.lit("-"), part(half, 1)))
        .when(label.rlike(month), F.concat(F.lit("20"), part(month, 2), F.lit("-"), months[part(month, 1)]))
        .when(label.rlike(plain), label)
    )
