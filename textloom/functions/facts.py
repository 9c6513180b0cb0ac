"""Numbers, names, negations and quantifiers of a text, and their multiset difference between two texts.

The facts of a text are read in one pass, in Arrow batches, into a struct of maps; differences, counts and rates are column expressions over these maps.
Counts that need no context (digits, negations, single phrases) have expressions of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions import lexicon, numerals
from textloom.functions.cleaning import name_key

#: Fixed value: a number in digits or a word.
TOKEN = r"[0-9]+(?:[.,'\x{A0}\x{202F}][0-9]{3})*(?:[.,][0-9]+)?%?|[\p{L}\p{Nl}\p{No}]+(?:['’-][\p{L}\p{Nl}\p{No}]+)*"
NEGATIONS = lexicon.NEGATIONS
QUANTIFIERS = lexicon.QUANTIFIERS["en"]

# What a word is, what ends a clause, what may stand between its end and its first word, what follows a list's number.
WORD = r"[0-9]+(?:[.,'\u00a0\u202f][0-9]{3})*(?:[.,][0-9]+)?%?|[^\W\d_]+(?:['’-][^\W\d_]+)*"
CLAUSE_END = r"[.!?…:]+[\"'”»)\]]*\s+|\n"
OPENERS = " \t\r\n\"'“‘«([-–—*#>•"
LIST_NUMBER = re.compile(r"[.)](?:\s|$)")
SHORT_NOT = re.compile(r"n['’]t\b", re.IGNORECASE)
BOLD = re.compile(r"\*\*[^*\n]+\*\*")
LONG_WORD = re.compile(r"[^\W\d_]{4,}")

SCAN = re.compile(f"(?P<end>{CLAUSE_END})|(?P<word>{WORD})|(?P<ink>[^{re.escape(OPENERS)}])")


def scan(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, word, opening) of each word or number: opening, if nothing but openers stands between it and the start of its clause."""
    fresh = True
    for m in SCAN.finditer(text):
        if m.lastgroup == "end":
            fresh = True
        else:
            if m.lastgroup == "word":
                yield m.start(), m.end(), m[0].replace("’", "'"), fresh
            fresh = False


def is_heading(line: str) -> bool:
    """A line marked by #, all in bold, or in title case: at most 12 words without closing punctuation, of at least two long ones three of five capitalised."""
    t = line.strip()
    if not t or t.startswith("#") or (len(t) > 4 and t.startswith("**") and t.endswith("**")):
        return bool(t)
    if t[-1] in ".!?:;," or len(t.split(None, 12)) > 12:
        return False
    long_ones = LONG_WORD.findall(t)
    return len(long_ones) >= 2 and sum(w[0].isupper() for w in long_ones) >= 0.6 * len(long_ones)


def heading_spans(text: str) -> list[tuple[int, int]]:
    """Heading lines and bold labels, in order of their start."""
    lines = [m.span() for m in re.finditer(r"[^\n]+", text) if is_heading(m[0])]
    return sorted(lines + [m.span() for m in BOLD.finditer(text)])


def key_of(word: str) -> str:
    """As cleaning.name_key."""
    k = re.sub("'s?$", "", word.lower())
    return k[:-1] if len(k) > 3 and k[-1] == "s" and k[-2] != "s" else k


def number_of(token: str, lang: str) -> float | None:
    """As digit_value."""
    t = re.sub("[%'\u00a0\u202f]", "", token)
    if lang == "en":
        t = t.replace(",", "")
    elif "," in t or re.search(r"\.[0-9]{3}(?![0-9])", t):
        t = t.replace(".", "").replace(",", ".")
    return float(t) if t.count(".") < 2 and "," not in t else None


QUANTIFIER_ORDER = {lang: sorted(table, key=lambda p: (-len(p), p)) for lang, table in lexicon.QUANTIFIERS.items()}


def read_facts(text: str, lang: str) -> dict:
    """numbers, names and quantifiers are counted; keys holds every word as names are compared; words leaves numbers out."""
    numbers: Counter = Counter()
    names: Counter = Counter()
    keys: set[str] = set()
    found = list(scan(text))
    scales, function = lexicon.SCALES[lang], set(lexicon.FUNCTION_WORDS[lang])
    heads = iter(heading_spans(text))
    head, styled_to = next(heads, None), -1
    plain: list[str] = []  # words in lower case, cut at hyphens
    words = 0
    for k, (start, end, token, opening) in enumerate(found):
        while head is not None and head[0] <= start:
            styled_to, head = max(styled_to, head[1]), next(heads, None)
        parts = token.split("-")
        keys.update(map(key_of, parts))
        if token[0] in "0123456789":
            value = None if opening and LIST_NUMBER.match(text, end) else number_of(token, lang)
            if value is not None:
                after = found[k + 1][2].lower() if k + 1 < len(found) else ""
                numbers[value * scales.get(after, 1)] += 1
            continue
        words += 1
        plain += token.lower().split("-")
        if not token[0].isupper() or len(token) < 2 or opening or start < styled_to:
            continue
        if lang == "en" and (token.startswith("I'") or (len(token) > 5 and token.endswith("ing"))):
            continue
        names.update(p for p in parts if len(p) > 1 and p[0].isupper() and p.lower() not in function)
    numbers.update(numerals.values(plain, lang))
    negative = set(NEGATIONS[lang])
    negations = sum(w in negative for w in plain) + (len(SHORT_NOT.findall(text)) if lang == "en" else 0)
    quantifiers: Counter = Counter()
    left = f" {' '.join(plain)} "
    for phrase in QUANTIFIER_ORDER[lang]:  # the words of a counted phrase are used up
        if n := left.count(f" {phrase} "):
            quantifiers[lexicon.QUANTIFIERS[lang][phrase]] += n
            left = left.replace(f" {phrase} ", " | ")
    return {"numbers": list(numbers.items()), "names": list(names.items()), "keys": sorted(keys), "negations": negations, "quantifiers": list(quantifiers.items()), "words": words}


COUNTS = T.MapType(T.StringType(), T.IntegerType())
FACTS = (
    T.StructType().add("numbers", T.MapType(T.DoubleType(), T.IntegerType())).add("names", COUNTS).add("keys", T.ArrayType(T.StringType()))
    .add("negations", T.LongType()).add("quantifiers", COUNTS).add("words", T.LongType())
)


@F.arrow_udf(FACTS)
def facts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The facts of a text in a language; null for a null text and for languages without a lexicon."""
    for texts, langs in batches:
        yield pa.array([read_facts(t, lang) if t is not None and lang in lexicon.LANGUAGES else None for t, lang in zip(texts.to_pylist(), langs.to_pylist())], to_arrow_type(FACTS))


def fact_spans_of(text: str, lang: str) -> list[tuple[int, int]]:
    """Where the words stand that a rewriter must leave alone: names, number words, negations, quantifiers of one word."""
    kept = set(NEGATIONS[lang]) | {p for p in lexicon.QUANTIFIERS[lang] if " " not in p}
    numeric = lambda w: numerals.kind_of(w, lang)[0] in "UDTCHSMN"
    return [
        (a, b) for a, b, w, opening in scan(text)
        if w.lower() in kept or (w[0] not in "0123456789" and (numeric(w.lower()) or SHORT_NOT.search(w) or (len(w) > 1 and w[0].isupper() and not opening)))
    ]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def digit_value(token: Column, lang: str = "en") -> Column:
    """The number that a token of digits writes. English groups with commas; elsewhere commas are decimal, and points are groups if a comma or three digits follow."""
    t = F.regexp_replace(token, r"[%'\x{A0}\x{202F}]", "")
    if lang == "en":
        return F.regexp_replace(t, ",", "").try_cast("double")
    grouped = t.contains(",") | t.rlike(r"\.[0-9]{3}(?![0-9])")
    return F.when(grouped, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")).otherwise(t).try_cast("double")


def counted(items: Column) -> Column:
    """map<value, count> of an array: a multiset."""
    distinct = F.array_sort(F.array_distinct(items))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda v: F.size(F.filter(items, lambda x: x == v))))


def digit_numbers(text: Column, lang: str = "en") -> Column:
    found = F.filter(tokens(text), lambda t: t.rlike("^[0-9]"))
    return F.filter(F.transform(found, lambda t: digit_value(t, lang)), lambda v: v.isNotNull())


def negations(text: Column, lang: str = "en") -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    plain = F.size(F.filter(words, lambda w: w.isin(NEGATIONS[lang])))
    short = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"n['’]t(?![\p{L}\p{N}_])"), F.lit(0)))
    return (plain + (short if lang == "en" else F.lit(0))).cast("long")


def quantifier_counts(text: Column, lang: str = "en") -> dict[str, Column]:
    """By phrase, the longest phrases first: words of a counted phrase are used up."""
    left = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0)), " "), F.lit(" "))
    out = {}
    for phrase in QUANTIFIER_ORDER[lang]:
        mark = f" {phrase} "
        after = F.replace(left, F.lit(mark), F.lit(" | "))
        out[phrase] = ((F.length(left) - F.length(after)) / (len(mark) - 3)).cast("long")
        left = after
    return out


def surplus(a: Column, b: Column) -> Column:
    """The multiset a - b of two map<value, count>, its positive part."""
    kept = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    return F.map_filter(kept, lambda k, n: n > 0)


def elements(multiset: Column, show=lambda v: v.cast("string")) -> Column:
    """The values of a multiset as text, sorted as text, repeats included."""
    return F.array_sort(F.flatten(F.transform(F.map_entries(multiset), lambda e: F.array_repeat(show(e["key"]), e["value"]))))


def shown_number(v: Column) -> Column:
    """Whole numbers without a point, others to six significant digits without trailing zeros."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(v)))).cast("int")
    short = F.rtrim(F.format_string("%.6f", v), F.lit("0"))
    exact = F.rtrim(F.format_string("%.12f", F.round(v * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)), F.lit("0"))
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.coalesce(F.rtrim(exact, F.lit(".")), short))


def size_of(multiset: Column) -> Column:
    return F.aggregate(F.map_values(multiset), F.lit(0), lambda a, n: a + n).cast("long")


def forgiven(names_: Column, other_keys: Column) -> Column:
    """Of a multiset of names, those whose key is none of the other text's."""
    return F.map_filter(names_, lambda k, n: ~F.array_contains(other_keys, name_key(k)))


def diff(rows: DataFrame, a: str, b: str, lang: str | Column = "en") -> DataFrame:
    """rows with what b lost of a and what it added (numbers, names, quantifiers), negations before and after, altered (without negations) and its rate per
    1,000 words of a, half up. All null where a text is null or its language has no lexicon."""
    language = F.lit(lang) if isinstance(lang, str) else lang
    step = rows.withColumns({"_facts_a": facts(F.col(a), language), "_facts_b": facts(F.col(b), language)})
    x, y = F.col("_facts_a"), F.col("_facts_b")
    found = {
        "numbers_missing": surplus(x["numbers"], y["numbers"]), "numbers_added": surplus(y["numbers"], x["numbers"]),
        "names_missing": forgiven(surplus(x["names"], y["names"]), y["keys"]), "names_added": forgiven(surplus(y["names"], x["names"]), x["keys"]),
        "quantifiers_missing": surplus(x["quantifiers"], y["quantifiers"]), "quantifiers_added": surplus(y["quantifiers"], x["quantifiers"]),
    }
    step = step.withColumns(found | {"negations_before": x["negations"], "negations_after": y["negations"], "words": x["words"]}).drop("_facts_a", "_facts_b")
    step = step.withColumn("altered", sum((size_of(F.col(k)) for k in found), F.lit(0)).cast("long"))
    rate = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.floor(F.try_divide(F.col("altered") * 10000, "words") + 0.5) / 10)
    return step.withColumn("per_1000_words", rate).withColumns({k: elements(F.col(k), shown_number) if k.startswith("numbers") else elements(F.col(k)) for k in found})


def sentences(rows: DataFrame) -> Column:
    """array<string>: a diff's row in plain words, a head line and then one line for each kind that changed."""

    def part(label: str, kind: str, show=lambda x: x) -> Column:
        gone, new = F.col(f"{kind}_missing"), F.col(f"{kind}_added")
        said = lambda word, items: F.when(F.size(items) > 0, F.concat(F.lit(word), F.array_join(F.transform(items, show), ", ")))
        body = F.concat_ws("; ", said("gone ", gone), said("new ", new))
        return F.when(body != "", F.concat(F.lit(f"{label}: "), body, F.lit(".")))

    rate = F.regexp_replace(F.format_string("%.1f", "per_1000_words"), r"\.0$", "")
    head = F.when(F.col("altered") > 0, F.concat(F.col("altered").cast("string"), F.lit(" facts changed ("), rate, F.lit(" per 1,000 words)."))).otherwise(F.lit("No number, name or quantifier changed."))
    before, after = F.col("negations_before"), F.col("negations_after")
    note = F.when(before != after, F.concat(F.lit("Negation words: "), before.cast("string"), F.lit(" before, "), after.cast("string"), F.lit(" after; not counted above, worth a look.")))
    spaced = lambda q: F.replace(q, F.lit("_"), F.lit(" "))
    return F.when(F.col("altered").isNotNull(), F.array_compact(F.array(head, part("Numbers", "numbers"), part("Names", "names"), note, part("Quantifiers", "quantifiers", spaced))))
