"""Deterministic text cleaning as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are not seen, and spaces that are not the plain one.
INVISIBLE = (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, 0x00AD, 0x180E, 0x061C, 0x034F)
EXOTIC_SPACES = (0x00A0, 0x202F, 0x2007, 0x2009, 0x200A, 0x3000, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2008, 0x205F, 0x1680)
#: Typographic characters and their plain form.
TYPOGRAPHY = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "‑": "-", "‐": "-"}
ELLIPSIS = "…"

char_class = lambda codes: "[" + "".join(f"\\x{{{c:04X}}}" for c in codes) + "]"
INVISIBLE_CLASS, SPACE_CLASS = char_class(INVISIBLE), char_class(EXOTIC_SPACES)
#: A variation selector counts unless the character before it is in the range of emoji.
SELECTOR = r"(?<![\x{2600}-\x{10FFFF}])[\x{FE00}-\x{FE0F}]"
FENCE = r"(?s)```.*?```"


def targets(text: Column) -> Column:
    """array<string> of the invisible and exotic characters."""
    return F.regexp_extract_all(text, F.lit(f"{INVISIBLE_CLASS}|{SPACE_CLASS}|{SELECTOR}"), F.lit(0))


def character_name(ch: Column) -> Column:
    known = {c: unicodedata.name(chr(c), f"U+{c:04X}") for c in (*INVISIBLE, *EXOTIC_SPACES, *range(0xFE00, 0xFE10))}
    return F.element_at(F.create_map(*[F.lit(x) for c, n in known.items() for x in (chr(c), n)]), ch)


def outside(text: Column, pattern: str, fn) -> Column:
    """fn applied to the pieces of text between the matches of pattern, which stay as they are."""
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), fn)
    return F.array_join(F.flatten(F.zip_with(pieces, kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def plain_characters(text: Column) -> Column:
    """Invisible characters dropped and exotic spaces made plain, but for fenced code."""
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, f"{INVISIBLE_CLASS}|{SELECTOR}", ""), SPACE_CLASS, " ")
    return F.when(text.contains("```"), outside(text, FENCE, clean)).otherwise(clean(text))


def edits(text: Column) -> Column:
    """How many characters plain_characters() changes."""
    count = lambda s: F.size(targets(s))
    pieces = F.split(text, FENCE, -1)
    return F.aggregate(F.transform(pieces, count), F.lit(0), lambda a, n: a + n).cast("long")


def typography(text: Column) -> Column:
    return F.replace(F.translate(text, "".join(TYPOGRAPHY), "".join(TYPOGRAPHY.values())), F.lit(ELLIPSIS), F.lit("..."))


# Where a dash parts a sentence, a list of three, percentages and grouped digits.
_W = r"[\p{L}\p{N}_]"
DASH = r"(?<=[^\s\d,;:(\[])[ \t]*[\x{2014}\x{2013}][ \t]*(?=[^\s\d,;:)\]])"
SERIAL = rf"(?<!{_W})({_W}+), ({_W}+), (and|or) ({_W}+)(?!{_W})"
PERCENT = rf"(?<!{_W})([0-9]+(?:\.[0-9]+)?) percent(?!{_W})"
GROUPED = r"(?<![0-9.,:/])[0-9]{1,3}(?:,[0-9]{3})+(?![0-9,:/])"
TYPED = "[" + "".join(TYPOGRAPHY) + ELLIPSIS + "]"


def literal(c: str) -> str:
    """A character as a pattern that means itself."""
    return c if c.isalnum() or c in " ',_" else f"\\{c}"


def dashes(text: Column) -> Column:
    """A long dash between words becomes a comma."""
    return F.regexp_replace(text, DASH, ", ")


def serial_comma(text: Column) -> Column:
    return F.regexp_replace(text, SERIAL, r"$1, $2 $3 $4")


def without_commas(text: Column) -> Column:
    """Every comma between digit groups of a number that is nothing but groups goes."""
    return F.regexp_replace(text, r"(?:(?<![0-9.,:/])(?=[0-9]{1,3}(?:,[0-9]{3})+(?![0-9,:/]))|(?<!^)\G(?<=,))([0-9]{1,3}),(?=[0-9]{3})", "$1")


def numbers(text: Column) -> Column:
    """"5 percent" to "5%", and thousands without commas."""
    return without_commas(F.regexp_replace(text, PERCENT, "$1%"))


# The patterns of tidy(), detokenize() and prose() are fixed values: results depend on them.


def tidy(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?m)^\s*(#+\s.*|\*\*[^*]+\*\*\s*)$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\*\*(.+?)\*\*", "$1"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def detokenize(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?U)\s+([,.;:!?)»%])", "$1")
    out = F.regexp_replace(out, r"(?U)([(«])\s+", "$1")
    out = F.regexp_replace(out, r"(?U)([\p{L}\p{N}_])\s+'\s*([\p{L}\p{N}_])", "$1'$2")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def prose(text: Column, least_words: int = 6) -> Column:
    """The lines of running prose: no tables, lists, short lines or lines that don't end a sentence."""
    from textloom.functions.tokens import word_count

    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    keep = F.filter(lines, lambda s: (s != "") & ~s.contains("|") & ~s.rlike(r"^([-*•·]|[0-9]+[.)])\s") & (word_count(s) >= least_words) & s.rlike("[.!?…»\"”'’)]$"))
    return F.array_join(keep, "\n")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs_as_they_are(text: Column) -> Column:
    """With their own white space around them, empty ones too, so that joined by what parts() gives they are the text again."""
    return F.split(text, r"\n[ \t]*\n\s*", -1)


def paragraph_parts(text: Column) -> Column:
    """What stands between them."""
    return F.regexp_extract_all(text, F.lit(r"\n[ \t]*\n\s*"), F.lit(0))


def paragraphs_on_blank_lines(text: Column) -> Column:
    """Split by runs of two line ends or more alone."""
    return F.filter(F.split(text, r"\n{2,}", -1), lambda s: F.trim(s) != "")


def name_key(word: Column) -> Column:
    """Case, a possessive and a plural s do not make another name."""
    k = F.regexp_replace(F.lower(word), "'s?$", "")
    return F.when((F.length(k) > 3) & k.endswith("s") & ~k.endswith("ss"), F.substring(k, F.lit(1), F.length(k) - 1)).otherwise(k)


# What announces a rewrite, echoes its instruction, or follows it.
ANNOUNCES = r"(?i)\b(here|version|rewrit|revised|paraphras|reworded|text)\w*"
ECHOES = r"(?i)previous attempt|negation.{0,40}quantifier|quantifier.{0,40}negation|^\s*TEXT:\s*$"
CLOSES = r"(?i)^\s*(\*\*)?(i hope|hope this|let me know|would you like|do you want|feel free|note:|this version|this rewrite|i've|i have)"
RULE_LINE = r"^\s*(-{3,}|\*{3,})\s*$"


def clean_reply(text: Column) -> Column:
    """A model's reply without its thinking blocks, an opening line that announces it, lines that echo the instruction, remarks and rules at its end, and outer quotes."""
    bind = lambda value, fn: F.transform(F.array(value), fn)[0]
    ends = r"(?U)^\s+|\s+$"
    blank = lambda s: ~s.rlike(r"(?U)\S")
    told = F.split(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), "\n", -1)

    def from_first(lines: Column) -> Column:
        """Behind the blank lines in front and an announcement."""
        at = F.array_position(F.transform(lines, lambda s: ~blank(s)), F.lit(True)).cast("int")
        first = F.get(lines, at - 1)
        announced = first.rlike(r"(?U):\s*$") & first.rlike(ANNOUNCES) & (F.length(first) < 200) & (F.size(lines) > at)
        return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.when(announced, at + 1).otherwise(at), F.size(lines)))

    def up_to_last(lines: Column) -> Column:
        """Up to the last line that is neither blank nor a remark or a rule; the first line stays whatever it is."""
        ends_there = lambda s: blank(s) | s.rlike(CLOSES) | s.rlike(RULE_LINE)
        last = F.array_max(F.transform(lines, lambda s, k: F.when((k == 0) | ~ends_there(s), k + 1)))
        return F.slice(lines, F.lit(1), F.coalesce(last, F.lit(0)))

    kept = bind(bind(told, from_first), lambda lines: bind(F.filter(lines, lambda s: ~s.rlike(ECHOES)), up_to_last))
    body = F.regexp_replace(F.array_join(kept, "\n"), ends, "")
    return F.regexp_replace(F.regexp_replace(body, r'(?s)^["\x{201C}]([^"\x{201C}\x{201D}]*)["\x{201D}]$', "$1"), ends, "")
