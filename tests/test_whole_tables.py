"""Queries over whole tables against brute force on a small fixture of odd rows."""

import hashlib
import re

import pytest

from textloom.plans.catalogue import QUERIES

TEXTS = [
    "", None, "plain the words of it", "rouge, vert, and bleu café the été, élan, or œuvre", "a the b the c the d", "one — two – three, 1–2 (— x) the 5 — y", "## Own heading\n\n\n\nsome **bold the text** here\n**A whole line**\n\n end ",
    "l ' eau , it ' s ( here ) « là » .", '"quoted whole"', 'He said "no".\nThen left.', "- item\n  > quote\n3. third\n\nlast line", "word " * 35 + "\n\n" + "more " * 31, "other " * 40 + "\n \n" + "few words", "single " * 33,
]
W, S = r"\w", r"[ \t\n\x0b\f\r]"
MARK = r"^[ \t]*(?:[-*+]|[0-9]+[.)]|#{1,6}|>)[ \t]+"


def serial_comma(t):
    return re.sub(rf"(?<!{W})({W}+), ({W}+), (and|or) ({W}+)(?!{W})", r"\1, \2 \3 \4", t.replace(" the ", ", and "))


def dashes(t):
    left, right = r"(?<=[^ \t\n\x0b\f\r0-9,;:(\[])", r"(?=[^ \t\n\x0b\f\r0-9,;:)\]])"
    return re.sub(rf"{left}[ \t]*[—–][ \t]*{right}", ", ", t.replace(" the ", " — "))


def tidy(t):
    t = "# A heading\n\n\n\n" + t.replace(" the ", " **the** ")
    t = re.sub(rf"(?m)^{S}*(#+{S}.*|\*\*[^*]+\*\*{S}*)$", "", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\*\*(.+?)\*\*", r"\1", t)).strip()


def detokenize(t):
    t = re.sub(r"\s+([,.;:!?)»%])", r"\1", t.replace(",", " ,").replace(".", " ."))
    t = re.sub(r"(\w)\s+'\s*(\w)", r"\1'\2", re.sub(r"([(«])\s+", r"\1", t))
    return re.sub(r"\s+", " ", t).strip(" ")


def clean_reply(t):
    """Of the text between an announcement and a closing remark."""
    lines = ["Here is the text:", "", *t.split("\n")]
    lines = lines[1:]
    echo = re.compile(r"previous attempt|negation.{0,40}quantifier|quantifier.{0,40}negation|^\s*TEXT:\s*$", re.I)
    lines = [s for s in lines if not echo.search(s)]
    coda = re.compile(r"^\s*(\*\*)?(i hope|hope this|let me know|would you like|do you want|feel free|note:|this version|this rewrite|i've|i have)|^\s*(-{3,}|\*{3,})\s*$", re.I)
    while len(lines) > 1 and (not lines[-1].strip() or coda.search(lines[-1])):
        lines.pop()
    t = "\n".join(lines).strip()
    return t[1:-1].strip() if len(t) > 1 and t[0] == t[-1] == '"' and '"' not in t[1:-1] else t


def layout(t):
    return "\n".join("- " + re.sub("^[ \t]+", "", re.sub(MARK, "", s)) for s in ("# " + t).split("\n"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, k, t) for k, t in enumerate(TEXTS)], "conv_id long, turn int, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name,rule", [("rule_serial_comma", serial_comma), ("rule_dashes", dashes), ("tidy_text", tidy), ("detokenize_text", detokenize), ("clean_reply", clean_reply), ("layout_kept", layout)])
def test_every_row_by_brute_force(spark, folder, name, rule):
    key, digest, kind = ("doc_id", "digest", "sha256") if "conv_id" not in (df := QUERIES[name](spark, folder)).columns else ("turn", df.columns[-1], "md5" if name == "layout_kept" else "sha256")
    got = {r[key]: r[digest] for r in df.collect()}
    assert got == {k: None if t is None else hashlib.new(kind, rule(t).encode()).hexdigest() for k, t in enumerate(TEXTS)}


def test_paragraphs_of_all_turns(spark, folder):
    got = sorted((r["turn"], r["paragraph"], r["words"]) for r in QUERIES["paragraph_pairs"](spark, folder).collect())
    assert got == [(12, 0, 35), (12, 1, 31)]
