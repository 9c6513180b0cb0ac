"""Words, sentences, languages and length buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. A word with inner apostrophes; a run of letters and letter-like numbers. Python's \w and Java's differ, hence the explicit classes.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
#: Fixed value: where a sentence ends.
SENTENCE = r"[.!?…]+[\"'”’»)\]]*(?=\s|$)"

#: Other places at which texts are cut, for facts and for rewriters. Results depend on their differences.
OTHER_SPLITS = {
    "clauses": r"[.!?…:]+[\"'”»)\]]*\s+|\n",
    "after_stops": r"(?<=[.!?…])\s+",
    "with_quotes": r"[.!?…]+[\"'”’)\]]*(?=\s|$)|\n",
}

#: The stop words that vote for a language, in the order in which ties are decided.
LANGUAGE_VOTES = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "as", "on", "are", "this", "be", "by", "have", "not", "but", "from", "at", "which"],
    "it": ["il", "di", "che", "per", "un", "una", "non", "sono", "del", "della", "con", "gli", "nel", "alla", "anche", "come", "più", "dei", "delle", "questo"],
    "es": ["el", "que", "los", "las", "del", "por", "una", "con", "es", "para", "al", "su", "se", "como", "pero", "más", "sus", "este", "entre", "fue"],
}
#: Words of each bucket, both ends included.
BUCKETS = (("short", 40, 99), ("medium", 100, 300), ("long", 301, 600))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(letter_words(text)).cast("long")


def corpus_bucket(n: Column) -> Column:
    """Null under the shortest and over the longest."""
    out = F.lit(None).cast("string")
    for name, low, high in BUCKETS:
        out = F.when(n.between(low, high), F.lit(name)).otherwise(out)
    return out


def assess_bucket(n: Column) -> Column:
    """What is over the longest counts as long."""
    return F.when(n > BUCKETS[-1][2], F.lit(BUCKETS[-1][0])).otherwise(corpus_bucket(n))


def learner_bucket(n: Column) -> Column:
    return F.when(n >= BUCKETS[0][1], corpus_bucket(F.least(n, F.lit(BUCKETS[-1][2]))))


def language_votes(text: Column) -> dict[str, Column]:
    found = letter_words(F.lower(text))
    return {lang: _votes(found, lang) for lang in LANGUAGE_VOTES}


def _votes(found: Column, lang: str) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(LANGUAGE_VOTES[lang]))).cast("long")


def best_vote(votes: dict[str, Column]) -> tuple[Column, Column]:
    """(language, share of the votes); null and 0 without votes. Ties go to the language listed first."""
    total, top = sum(votes.values(), F.lit(0)), F.greatest(*votes.values())
    out = F.lit(None).cast("string")
    for lang in reversed(votes):
        out = F.when(votes[lang] == top, F.lit(lang)).otherwise(out)
    return F.when(total > 0, out), F.when(total > 0, top / F.nullif(total, F.lit(0))).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Trimmed sentences without empty ones; the tail after the last stop is one."""
    marked = F.regexp_replace(text, f"({SENTENCE})", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: s != "")


def estimated_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def head(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def file_name(label: Column) -> Column:
    """With an underscore for each run of characters that file names should not have, and none at its ends."""
    return F.regexp_replace(F.regexp_replace(label, r"[^\p{L}\p{N}_.@-]+", "_"), "^_+|_+$", "")


def gigabytes(size: Column) -> Column:
    return F.concat(F.format_number(size / (1 << 30), 1), F.lit(" GB"))


# Words that carry no content.
STOP_WORDS = (
    "a an the and or but nor so yet of to in on at for with by from as is are was were be been being it its this that these those he she they we you i me him her them us his their our your my not no do does did done "
    "have has had having will would can could should shall may might must than then if when while where which who whom whose what how why there here also just very too only own same such into onto over under up down "
    "out off again further once all any both each few more most other some because until about above below between through during before after per via "
    "il lo la i gli le un uno una di da con su tra fra e o ma se che chi cui non più anche come dove quando mentre questo questa questi queste quello quella quelli quelle sono è era erano essere avere ha hanno "
    "del della dei delle dal dalla nel nella nei nelle al alla ai alle sul sulla sui sulle"
).split()


def content_score(word: Column) -> Column:
    """How much a word says: 0 if it is a stop word or not all letters, 1 from four letters on, else 0.3. From 1 on it is a content word."""
    w = F.lower(word)
    return F.when(~w.rlike(r"^\p{L}+$") | w.isin(STOP_WORDS), 0.0).when(F.length(w) >= 4, 1.0).otherwise(0.3)
