"""Pattern matches with their places, from built-in functions alone.

Places are code points, the end exclusive.  ``regexp_extract_all`` gives the matches and
``split`` on the same pattern the text between them; running sums of both lengths are the
places.  The sums run in blocks of about sqrt(n) matches, as an array that grows by one
copies itself each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast(NO_SPANS)


def _placed(steps: Column) -> Column:
    """steps: (step, text) of each match, step the length from the end of the last match to the end of this."""
    many = F.size(steps)
    block = F.ceil(F.sqrt(many)).cast("int")

    def one(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["step"]
        span = F.struct((end - F.length(s["text"])).cast("bigint").alias("start"), end.alias("end"), s["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def many_of(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(steps, b * block + 1, block), F.struct(acc["at"].alias("at"), _none().alias("out")), one)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{NO_SPANS}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(many / block).cast("int") - 1), start, many_of, lambda acc: F.flatten(acc["out"]))


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of (start, end, text)."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(between, found, lambda gap, x: F.struct((F.length(gap) + F.length(x)).cast("bigint").alias("step"), x.alias("text")))
        return F.when(F.size(found) == 0, _none()).otherwise(let(steps, _placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def described(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def joined(parts: list[Column]) -> Column:
    return F.array_join(F.concat(*parts), ",")
