"""English from specifications, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatefold.functions.specs import on_rows

#: Word lists and templates.
SWITCHES = ("switch", "lever", "input", "button")
LIGHTS = ("lamp", "light", "output", "bulb")
VAGUE = (
    "a {n}-{sw} safety interlock",
    "a little control panel with {n} {sws}",
    "something that decides when the {lt} should come on, from {n} {sws}",
    "a {n}-way check before the {lt} lights",
    "the logic for a {n}-{sw} door control",
)


def plural(word: Column, n: Column) -> Column:
    return F.when(n == 1, word).when(word.rlike("(s|x|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def listed(items: Column) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(F.concat(F.concat_ws(", ", F.slice(items, 1, F.greatest(n - 1, F.lit(0)))), F.lit(" and "), F.element_at(items, -1)))


def assignment(names: Column, m: Column) -> Column:
    """Which inputs are on and which are off."""
    def some(bit: int, word: str) -> Column:
        own = F.filter(names, lambda _, k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1)) == bit)
        return F.when(F.size(own) > 0, F.concat(listed(own), F.when(F.size(own) == 1, " is ").otherwise(" are "), F.lit(word)))

    return F.concat_ws(" and ", some(1, "on"), some(0, "off"))


def functional(names: Column, rows: Column, switch: Column, light: Column) -> Column:
    """What one sees: four cases by how many rows are on."""
    ons, total = on_rows(rows), F.size(rows)
    offs = F.filter(F.sequence(F.lit(0), total - 1), lambda m: ~F.array_contains(ons, m))
    few = F.concat_ws(" or when ", F.transform(ons, lambda m: assignment(names, m)))
    return (
        F.when(F.size(ons) == 1, F.concat(F.lit("the "), light, F.lit(" turns on only when "), assignment(names, F.get(ons, F.lit(0)))))
        .when(F.size(ons) == total - 1, F.concat(F.lit("the "), light, F.lit(" stays on except when "), assignment(names, F.get(offs, F.lit(0)))))
        .when(F.size(ons) <= 2, F.concat(F.lit("the "), light, F.lit(" lights when "), few))
        .otherwise(F.concat(F.size(names).cast("string"), F.lit(" "), plural(switch, F.size(names)), F.lit(" control one "), light, F.lit("; it is on for "), F.size(ons).cast("string"), F.lit(" of the "), total.cast("string"), F.lit(" combinations")))
    )


def vague(n: Column, pick: Column, switch: Column, light: Column) -> Column:
    text = F.get(F.array(*map(F.lit, VAGUE)), pick % len(VAGUE))
    for mark, value in (("{n}", n.cast("string")), ("{sws}", plural(switch, n)), ("{sw}", switch), ("{lt}", light)):
        text = F.replace(text, F.lit(mark), value)
    return text


def pick(words: tuple[str, ...], seed: Column) -> Column:
    """A word chosen by a hash of the seed: the same for the same seed wherever it runs."""
    return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(seed), F.lit(len(words))).cast("int"))
