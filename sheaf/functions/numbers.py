"""Numbers, units, colours and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
COLOUR_NAMES = {"black": "000000", "white": "FFFFFF", "red": "FF0000", "blue": "0000FF", "green": "008000"}


def roman(n: Column) -> Column:
    """1 to 3999 in Roman numerals, other numbers in decimal."""
    places = []
    for unit, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        digits = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        places.append(F.element_at(F.array(*map(F.lit, digits)), (F.floor(n / unit) % 10 + 1).cast("int")))
    return F.when(n.between(1, 3999), F.concat(*places)).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """1 as A, 26 as Z, 27 as AA; 0 stays 0."""

    def step(acc: Column, _: Column) -> Column:
        digit = F.char((acc["left"] - 1) % 26 + 65)
        more = F.struct(F.floor((acc["left"] - 1) / 26).cast("long").alias("left"), F.concat(digit, acc["out"]).alias("out"))
        return F.when(acc["left"] > 0, more).otherwise(acc)

    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    return F.when(n <= 0, n.cast("string")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"]))


def number_format(n: Column, kind: Column) -> Column:
    text = n.cast("string")
    return (
        F.when(kind == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text))
        .when(kind == "lowerRoman", F.lower(roman(n)))
        .when(kind == "upperRoman", roman(n))
        .when(kind == "lowerLetter", F.lower(letters(n)))
        .when(kind == "upperLetter", letters(n))
        .when(kind == "bullet", "•")
        .when(kind == "none", "")
        .otherwise(text)
    )


def human_size(n: Column) -> Column:
    """Steps of 1024, one decimal above bytes; halves go to the even digit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(SIZE_UNITS[1:], 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1))).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    """Thin spaces between thousands."""
    return F.reverse(F.regexp_replace(F.reverse(n.cast("string")), "([0-9]{3})(?=[0-9])", "$1\u2009"))


def nice_step(raw: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten, the least that is at least ``raw``."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    step = F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0) * power
    return F.when(raw.isNull() | (raw <= 0) | F.isnan(raw) | (raw == float("inf")), 1.0).otherwise(step)


def nice_scale(low: Column, high: Column) -> Column:
    """(lo, hi, step) with about five steps; a flat range reaches to zero."""
    flat = low == high
    a = F.when(flat & (low > 0), 0.0).otherwise(low)
    z = F.when(flat & (low == 0), 1.0).when(flat & (low < 0), 0.0).otherwise(high)
    step = nice_step((z - a) / 5)
    lo = F.floor(a / step) * step
    hi = F.greatest(F.ceil(z / step) * step, lo + step)
    return F.struct(lo.alias("lo"), hi.alias("hi"), step.alias("step"))


def ticks(scale: Column) -> Column:
    """At most twelve ticks from lo to hi."""
    many = F.least(F.lit(12), F.floor((scale["hi"] - scale["lo"]) / scale["step"] + 0.5).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), many - 1), lambda k: scale["lo"] + k * scale["step"])


def axis_fraction(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def twips(points: Column) -> Column:
    """Twentieths of a point within 32 bits; 0 where not finite."""
    return F.when(_finite(points), F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), F.round(points * 20)))).otherwise(0).cast("long")


def half_points(points: Column) -> Column:
    return F.when(_finite(points), F.greatest(F.lit(2), F.least(F.lit(1638), F.round(points * 2)))).otherwise(0).cast("long")


def twips_measure(text: Column) -> Column:
    """Whole twips as points with up to two decimals and a unit; null for other text."""
    n = F.when(F.regexp_like(text, F.lit("^-?[0-9]+$")), text).try_cast("bigint")
    hundredths = F.abs(n) * 5
    rest = F.lpad((hundredths % 100).cast("string"), 2, "0")
    decimals = F.when(hundredths % 100 == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(rest, F.lit("0"))))
    return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(hundredths / 100).cast("string"), decimals, F.lit("pt"))


def percent_text(text: Column) -> Column:
    return F.concat(F.when(F.regexp_like(text, F.lit("^-?[0-9]+$")), text).try_cast("bigint").cast("string"), F.lit("%"))


def css_points(text: Column) -> Column:
    """A length in pt, px or cm as points; null for other text."""
    number = F.trim(F.regexp_extract(text, r"^\s*([^\s]*?)\s*(pt|px|cm)$", 1)).try_cast("double")
    unit = F.regexp_extract(text, "(pt|px|cm)$", 1)
    return number * F.when(unit == "pt", 1.0).when(unit == "px", 0.75).when(unit == "cm", 72.0 / 2.54)


def css_colour(text: Column) -> Column:
    """``#rgb``, ``#rrggbb``, ``rgb(r,g,b)`` or one of five names as six hex digits; else null."""
    v = F.trim(text)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in COLOUR_NAMES.items() for x in pair]), v)
    parts = F.transform(F.split(F.regexp_extract(v, r"^rgb\((.*)\)$", 1), ","), lambda p: F.when(F.regexp_like(F.trim(p), F.lit("^[0-9]{1,3}$")), F.trim(p)).try_cast("int"))
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    rgb = F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p), 2, "0")), "")
    return (
        F.when(F.regexp_like(v, F.lit("^#[0-9A-Fa-f]{6}$")), F.substring(v, 2, 6))
        .when(F.regexp_like(v, F.lit("^#[0-9A-Fa-f]{3}$")), F.regexp_replace(F.substring(v, 2, 3), "(.)", "$1$1"))
        .when(v.startswith("rgb("), F.when(good, rgb))
        .otherwise(named)
    )


def channels(hex6: Column) -> Column:
    part = lambda at: F.conv(F.substring(hex6, at, 2), 16, 10).cast("int")
    return F.array(part(1), part(3), part(5))


def blended(base: Column, top: Column, per_mille: Column) -> Column:
    """``per_mille`` thousandths of ``top`` over ``base``, both six hex digits."""
    amount = F.least(per_mille, F.lit(1000))
    mix = F.zip_with(channels(base), channels(top), lambda b, t: F.floor((b * (1000 - amount) + t * amount + 500) / 1000).cast("long"))
    return F.concat(F.lit("#"), F.array_join(F.transform(mix, lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), ""))


def is_dark(hex6: Column) -> Column:
    """Luminance 0.299 R + 0.587 G + 0.114 B under 128, in whole thousandths: sums of doubles miss 128 by their rounding."""
    c = channels(hex6)
    return 299 * c[0] + 587 * c[1] + 114 * c[2] < 128000


def civil_stamp(text: Column) -> Column:
    """Digit runs as year to second, missing ones 0; null unless year > 0, month 1-12 and day 1-31."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    at = lambda k: F.coalesce(F.get(runs, F.lit(k)).try_cast("int"), F.lit(0))
    good = (at(0) > 0) & at(1).between(1, 12) & at(2).between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *[at(k) for k in range(6)]))


def grade(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= 90, "A").when(score >= 75, "B").when(score >= 50, "C").otherwise("D")


def context_fit(memory: Column, weight: Column, reserve: Column, per_token: Column, native: Column, fallback: int = 4096) -> Column:
    """Tokens that memory holds: at most the native length, in whole 1024s; 512 when none fits."""
    room = F.floor((memory - weight - reserve) / per_token).cast("long")
    fit = F.least(room, native)
    whole = F.when(fit >= 1024, fit - fit % 1024).when(fit > 0, fit).otherwise(512)
    return F.when(memory.isNull() | (per_token <= 0), fallback).otherwise(whole).cast("long")
