"""Regex columns: literal pre-filters and match offsets, all inside the JVM."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, flags: str = "", unicode: bool = True) -> str:
    """Inline flags: ``d`` makes only \\n a line end, ``U`` gives Unicode classes."""
    return f"(?d{'U' if unicode else ''}{flags}){pattern}"


def fold(text: Column) -> Column:
    """Lower-case copy in which every letter a caseless regex accepts is its ASCII form."""
    for odd, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match contains at least one, or None."""
    plain = re.sub(
        r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), pattern
    )
    try:
        best = _best(sre_parse.parse(plain))
    except re.error:
        return None
    return sorted(best) if best else None


def _best(items) -> set[str] | None:
    found: list[set[str]] = []
    run = ""

    def close():
        nonlocal run
        if len(run) > 1 or run == "#" or (run and ord(run) > 127):
            found.append({run.lower()})
        run = ""

    for op, arg in items:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        repeat = op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1
        if repeat and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
            run += chr(arg[2][0][1]) * arg[0]
            close()
            continue
        close()
        inner = None
        if op is sre.SUBPATTERN:
            inner = _best(arg[3])
        elif op is sre.BRANCH:
            sides = [_best(b) for b in arg[1]]
            inner = set().union(*sides) if all(sides) else None
        elif repeat:
            inner = _best(arg[2])
        elif op is sre.ASSERT and arg[0] == 1:
            inner = _best(arg[1])
        if inner:
            found.append(inner)
    close()
    if not found:
        return None
    return max(found, key=lambda s: (min(map(len, s)), -len(s)))


# Matches a fold appends to one array before it starts the next.
CHUNK = 256


def match_offsets(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,line,column,text>>, 0-based offsets, 1-based line and column.

    Pieces between matches and the matches themselves alternate; one fold walks them and
    carries position, line number and the start of the current line. Its rows gather in
    chunks that are joined at the end, so the work stays linear in the page and its matches.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    row_type = "struct<start:int,end:int,line:int,column:int,text:string>"

    def bind(value: Column, use) -> Column:
        """``use(value)``, with the value computed once."""
        return F.get(F.transform(F.array(value), use), 0)

    def newlines(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def tail(s: Column) -> Column:
        return F.length(F.substring_index(s, "\n", -1))

    def advance(pos: Column, line: Column, bol: Column, s: Column):
        nl = newlines(s)
        end = pos + F.length(s)
        return end, line + nl, F.when(nl > 0, end - tail(s)).otherwise(bol)

    def state(pos, line, bol, out) -> Column:
        return F.struct(pos.alias("pos"), line.alias("line"), bol.alias("bol"), out.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start, line, bol = advance(acc["pos"], acc["line"], acc["bol"], p["gap"])
        end, line2, bol2 = advance(start, line, bol, p["hit"])
        row = F.struct(
            start.alias("start"),
            end.alias("end"),
            line.alias("line"),
            (start - bol + 1).alias("column"),
            p["hit"].alias("text"),
        )
        return state(end, line2, bol2, F.concat(acc["out"], F.array(row)))

    def walk(all_pairs: Column) -> Column:
        n = F.size(all_pairs)
        empty = F.array().cast(f"array<{row_type}>")

        def chunk(done: Column, k: Column) -> Column:
            before = F.element_at(done, -1)
            at = F.sequence(k * CHUNK, F.least(k * CHUNK + CHUNK, n) - 1)
            part = F.aggregate(
                F.when(n > 0, at).otherwise(F.array().cast("array<int>")),
                state(before["pos"], before["line"], before["bol"], empty),
                lambda acc, i: step(acc, F.get(all_pairs, i)),
            )
            return F.concat(done, F.array(part))

        last = F.floor((F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.array(state(F.lit(0), F.lit(1), F.lit(0), empty)),
            chunk,
            lambda done: F.flatten(F.transform(done, lambda part: part["out"])),
        )

    return bind(pairs, walk)


def line_text(text: Column, line: Column) -> Column:
    """Trimmed text of a 1-based line."""
    return F.trim(F.coalesce(F.get(F.split(text, "\n", -1), line - 1), F.lit("")))
