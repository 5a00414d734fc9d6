"""Folds over the pieces of one document.

A document is one row, so these run inside the scan task and need no shuffle. The time of a document grows
with its pieces, not with their square (see :func:`collected`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters the running position of a flat chunk moves over.
_GAP = " \n\t"
_BLOCK_CHARS = 1024
#: Items of a segment: a step copies at most so many values.
SEGMENT = 256

State = dict[str, Column]
Step = Callable[[Column, Column], tuple[State, Column, Column | None]]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collected(items: Column, state: State, step: Step, kind: str = "int") -> Column:
    """The values that a fold over ``items`` yields, in order, in time linear in the items.

    A fold copies its whole state in every step, so an array in it would cost the square of its length. Here one fold,
    over segments, finds the state at the beginning of each; then every segment is folded on its own. ``step`` takes the state
    and an item and gives the next state, a value, and whether the value counts (None: always).
    """
    names = list(state)

    def cut(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / SEGMENT).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(xs, j * SEGMENT + 1, F.lit(SEGMENT)))
        return F.when(F.size(xs) > 0, parts).when(F.size(xs) == 0, F.slice(F.array(xs), 1, 0))

    def plain(acc: Column, item: Column) -> Column:
        following, _, _ = step(acc, item)
        return F.struct(*[following[name].alias(name) for name in names])

    def collecting(acc: Column, item: Column) -> Column:
        following, value, counts = step(acc, item)
        run = F.array_append(acc["run"], value.cast(kind))
        run = run if counts is None else F.when(counts, run).otherwise(acc["run"])
        return F.struct(*[following[name].alias(name) for name in names], run.alias("run"))

    def pass_segment(acc: Column, segment: Column) -> Column:
        return F.struct(F.aggregate(segment, acc["now"], plain).alias("now"), F.array_append(acc["entries"], acc["now"]).alias("entries"))

    first = F.struct(*[state[name].alias(name) for name in names])
    none = F.filter(F.array(first), lambda _: F.lit(False))
    values = F.array().cast(f"array<{kind}>")

    def fold(segments: Column) -> Column:
        entries = F.aggregate(segments, F.struct(first.alias("now"), none.alias("entries")), pass_segment, lambda acc: acc["entries"])
        begun = lambda entry: F.struct(*[entry[name].alias(name) for name in names], values.alias("run"))
        return F.flatten(F.zip_with(segments, entries, lambda segment, entry: F.aggregate(segment, begun(entry), collecting, lambda acc: acc["run"])))

    return bound(bound(items, cut), fold)


def pack(sizes: Column, limit: int) -> Column:
    """0-based first positions of greedy groups: a group closes before it would pass ``limit``."""

    def step(acc: Column, size: Column):
        opens = (acc["i"] == 0) | (acc["filled"] + size > limit)
        return {"i": acc["i"] + 1, "filled": F.when(opens, size).otherwise(acc["filled"] + size)}, acc["i"], opens

    return collected(sizes, {"i": F.lit(0), "filled": F.lit(0)}, step)


def group_slice(items: Column, firsts: Column, first: Column, k: Column) -> Column:
    """Items of the ``k``-th group, whose first position is ``first``."""
    stop = F.coalesce(F.get(firsts, k + 1), F.size(items))
    return F.slice(items, first + 1, stop - first)


def prefix_sums(items: Column, size: Callable[[Column], Column] = lambda s: s) -> Column:
    """``[0, s0, s0+s1, ...]`` of the items' sizes: one entry more than ``items``."""

    def step(acc: Column, item: Column):
        return {"sum": acc["sum"] + size(item)}, acc["sum"] + size(item), None

    sums = collected(items, {"sum": F.lit(0)}, step)
    return F.concat(F.array(F.lit(0)), sums)


def _gap_length(c: Column) -> Column:
    return F.length(c) - F.length(F.ltrim(c, F.lit(_GAP)))


def text_blocks(text: Column) -> Column:
    """The text cut into fixed-size blocks, so a character is found without scanning the whole text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK_CHARS}}}"), F.lit(0))


def blocks_length(blocks: Column) -> Column:
    """Characters of a text cut into blocks: only the last block is measured, so a lambda may ask for every chunk."""
    return (F.size(blocks) - 1) * _BLOCK_CHARS + F.length(F.element_at(blocks, -1))


def block_gaps(backward: Column) -> Column:
    """Per block: gap characters from its start on, running into the following blocks. Ends with 0.

    ``backward`` has the blocks, the last one first.
    """

    def step(acc: Column, block: Column):
        gap = _gap_length(block) + F.when(_gap_length(block) == F.length(block), acc["next"]).otherwise(0)
        return {"next": gap}, gap, None

    return F.concat(F.reverse(collected(backward, {"next": F.lit(0)}, step)), F.array(F.lit(0)))


def running_starts(texts: Column, blocks: Column, gaps: Column) -> Column:
    """Start position of each flat chunk: the end of the one before, moved over gap characters."""

    def of(blocks: Column, gaps: Column) -> Column:
        def gap_at(pos: Column) -> Column:
            b = F.floor(pos / _BLOCK_CHARS).cast("int")
            rest = F.substring(F.get(blocks, b), pos % _BLOCK_CHARS + 1, F.lit(_BLOCK_CHARS))
            spill = F.when(_gap_length(rest) == F.length(rest), F.get(gaps, b + 1)).otherwise(0)
            return F.coalesce(_gap_length(rest) + spill, F.lit(0))

        def step(acc: Column, t: Column):
            end = acc["pos"] + F.length(t)
            return {"pos": end + gap_at(end)}, acc["pos"], None

        return collected(texts, {"pos": F.lit(0)}, step)

    return bound(blocks, lambda b: bound(gaps, lambda g: of(b, g)))


def nearest_macro(levels: Column) -> Column:
    """For each section the position of the latest level-2 section before it, where it is level 3."""

    def step(acc: Column, level: Column):
        macro = F.when(level == 2, acc["i"]).otherwise(acc["macro"])
        return {"i": acc["i"] + 1, "macro": macro}, F.when(level == 3, acc["macro"]), None

    return collected(levels, {"i": F.lit(0), "macro": F.lit(None).cast("int")}, step)
