"""Text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a judge reads a text only up to this phrase.
SENTINEL = "Now that you've seen the example"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def until(text: Column, phrase: str = SENTINEL) -> Column:
    """The text before ``phrase``, stripped; a text without it unchanged."""
    return F.when(F.contains(text, F.lit(phrase)), strip(F.substring_index(text, phrase, 1))).otherwise(text)


def shortened(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def first_digit(completion: Column) -> Column:
    """The first digit behind the last ``[`` as an int; null without one."""
    tail = F.element_at(F.split(completion, r"\["), -1)
    return F.nullif(F.regexp_extract(tail, r"(\d)", 1), F.lit("")).cast("int")


def words(text: Column) -> Column:
    """White-space separated words; none for empty and null texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: bound by a lambda.  Written out it would be computed wherever it stands, in a lambda's body for each element."""
    return F.transform(F.array(value), use)[0]


def slices(items: Column, size: int) -> Column:
    """An array cut into consecutive arrays of ``size``, the last one shorter; none for an empty array.

    ``items`` should be a plain column: a longer expression would be computed again for each slice.
    """
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    """Plain replacements, one after another."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decimals(value: Column, places: int = 2) -> Column:
    """A number with a fixed number of decimals, as in ``{:.2f}``; halves go to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(value.cast("double"), places))


def exponent(value: Column, places: int = 0) -> Column:
    """A number in scientific notation, as in ``{:.0e}``; halves go to the even digit."""
    x = value.cast("double")
    power = F.pow(F.lit(10.0), F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))))
    return F.format_string(f"%.{places}e", F.bround(x / power, places) * power)


def ceil_div(a: Column, b: int) -> Column:
    """How many parts of ``b`` hold ``a``: the quotient rounded up, in whole numbers."""
    return (F.floor((a.cast("bigint") - 1) / b) + 1).cast("bigint")


def article(title: Column, abstract: Column, text: Column) -> Column:
    """Title, abstract and text with blank lines between; null if any is null."""
    return F.concat(title, F.lit("\n\n"), abstract, F.lit("\n\n"), text)


def mcq_prompt(question: Column, choices: Column, description: str = "") -> Column:
    """``description``, the question, choices lettered A to D and ``Answer:``."""
    lettered = F.transform(choices, lambda c, i: F.concat(F.element_at(F.array(*map(F.lit, "ABCDEFGHIJ")), i + 1), F.lit(". "), c))
    return F.concat(F.lit(description), strip(question), F.lit("\n"), F.array_join(lettered, "\n"), F.lit("\nAnswer:"))


def cloze_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def percent_label(split: str, start: Column, stop: Column, n: Column) -> Column:
    """``split[a%:b%]`` with percents cut to whole numbers."""
    return F.concat(F.lit(f"{split}["), F.floor(100 * start / n).cast("string"), F.lit("%:"), F.floor(100 * stop / n).cast("string"), F.lit("%]"))


def choice_list(text: Column) -> Column:
    """A list written as Python or JSON text -> array<string> (null if it isn't one)."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
