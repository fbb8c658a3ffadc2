"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space other than the no-break space, as code points.
SPACES = r"\t\n\x0B\f\r \x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def collapse_spaces(text: Column) -> Column:
    """Runs of white space, but not no-break spaces, become one space."""
    return F.regexp_replace(text, f"[{SPACES}]+", " ")


def digit_mask(text: Column) -> Column:
    """White space normalised, each run of digits as ``#``: what repeats from page to page."""
    return F.regexp_replace(F.trim(collapse_spaces(text)), "[0-9]+", "#")


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def cleaned(text: Column) -> Column:
    """One paragraph tidied: no soft hyphens or zero-width marks, no trailing blanks, two or more leading
    spaces as a tab, no space before closing punctuation, single spaces after the prefix."""
    plain = F.translate(text, "\u00ad\u200b\ufeff", "")
    plain = F.regexp_replace(plain, "[ \t]+$", "")
    plain = F.regexp_replace(plain, "^ {2,}", "\t")
    plain = F.regexp_replace(plain, r" +([,.;:!?)\]])", "$1")
    prefix = F.regexp_extract(plain, r"^([ \t]*)", 1)
    rest = F.substring(plain, F.length(prefix) + 1, F.length(plain))
    return F.concat(prefix, F.regexp_replace(rest, r"([ \t])[ \t]+", "$1"))


def paragraphs(text: Column) -> Column:
    """The non-empty lines, tabs as spaces, other control characters dropped, trimmed."""
    one = lambda x: F.trim(F.regexp_replace(F.translate(x, "\t", " "), r"[\x00-\x1f\x7f]", ""))
    return F.filter(F.transform(F.split(text, "\n"), one), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters and combining marks with apostrophes inside; one letter, capitals alone and runs
    that touch a digit are left out."""
    plain = F.replace(text, F.lit("’"), F.lit("'"))
    found = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{M}0-9]+(?:'[\p{L}\p{M}0-9]+)*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.regexp_like(w, F.lit("[0-9]")) & (w != F.upper(w)))


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def whole_word(word: str) -> str:
    """A pattern for ``word`` that touches no letter or digit."""
    import re

    return rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])"


def replace_word(text: Column, word: str, by: str) -> Column:
    return F.regexp_replace(text, whole_word(word), by.replace("\\", r"\\").replace("$", r"\$"))


def script_of(word: Column) -> Column:
    """``latin``, ``cyrillic`` or null for anything mixed."""
    return F.when(F.regexp_like(word, F.lit("^[A-Za-zÀ-ɏ]+$")), "latin").when(F.regexp_like(word, F.lit("^[Ѐ-ӿ]+$")), "cyrillic")


def skeleton(word: Column) -> Column:
    return F.translate(F.lower(word), "čćšžđ", "ccszd")


def case_like(model: Column, word: Column) -> Column:
    """``word`` in the case pattern of ``model``: capitals where all of its two or more letters are, capitalised or lower."""
    first = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))
    letters = F.regexp_replace(model, r"\P{L}", "")
    return F.when(F.regexp_like(letters, F.lit(r"^\p{Lu}{2,}$")), F.upper(word)).when(F.regexp_like(model, F.lit(r"^\p{Lu}")), first).otherwise(F.lower(word))


def list_marker(line: Column) -> Column:
    """Whether a token is a bullet, or a short number, letter or Roman numeral closed by ``.`` or ``)``."""
    return F.regexp_like(line, F.lit(r"^(?:[•‣▪●◦–*-]|(?:[0-9]{1,3}|[A-Za-z]|[ivxlcdmIVXLCDM]{1,5})[.)])$"))


def xml_escaped(text: Column) -> Column:
    """Markup characters as entities, carriage returns as references, disallowed characters dropped."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    for raw, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        plain = F.replace(plain, F.lit(raw), F.lit(said))
    return plain


def invalid_xml_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"))


def percent_decoded(text: Column) -> Column:
    """``%XX`` as UTF-8 bytes, ``+`` kept; null where an escape or the bytes are malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def resolved_path(path: Column) -> Column:
    """A rooted path without ``.`` and ``..`` segments; null when they climb past the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("good"))

    def step(acc: Column, part: Column) -> Column:
        up = F.struct(F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0))).alias("kept"), (acc["good"] & (F.size(acc["kept"]) > 0)).alias("good"))
        down = F.struct(F.concat(acc["kept"], F.array(part)).alias("kept"), acc["good"].alias("good"))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(down)

    done = lambda acc: F.when(acc["good"] & (F.size(acc["kept"]) > 0), F.concat(F.lit("/"), F.array_join(acc["kept"], "/")))
    return F.aggregate(F.split(path, "/"), start, step, done)


def safe_file_name(name: Column) -> Column:
    """Illegal characters as ``_``, dots and blanks trimmed from the ends, device names prefixed."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
    device = F.regexp_like(F.upper(plain), F.lit(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)"))
    return F.when(device, F.concat(F.lit("_"), plain)).otherwise(plain)


def natural_key(name: Column) -> Column:
    """Sorts names as people read them: digit runs by value, other characters without case.

    An array of structs that compare alike: text before digits never meets text, as digit runs start with
    a lower rank than the characters that may follow.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]"), F.lit(0))

    def one(p: Column) -> Column:
        digits = F.regexp_like(p, F.lit("^[0-9]+$"))
        value = F.regexp_replace(p, "^0+", "")
        return F.struct(
            F.when(digits, F.lit("0")).otherwise(p).alias("char"),
            F.when(digits, F.length(value)).otherwise(0).alias("size"),
            F.when(digits, value).otherwise("").alias("value"),
            F.when(digits, F.length(p)).otherwise(0).alias("run"),
        )

    return F.transform(parts, one)
