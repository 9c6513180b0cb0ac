"""Personal data by weak supervision. DataFrame operations only.

Candidate spans come from patterns: the four base kinds in their strict form, which are always reported; looser
forms (a bracketed or spelled-out address, national and 00-prefixed telephone numbers, a full IPv6 address), which are reported only if
the final classifier accepts them; and long matches of a base pattern that fail its check, which are never reported but are the negative examples that any corpus
has. Labelling functions vote for or against every candidate: checksums and structure, gazetteers (top-level domains, telephone prefixes), the words
around the span, its edges and how it is written. Expectation-maximisation over the
counts of vote patterns, which are at most 3**labellers a kind, estimates each labeller's reliability without labels.
Its posteriors then train a logistic span classifier on features of the span and its context, again over counts
of feature patterns. Counts cover all documents; only they reach the driver.

Spans are found natively with offsets in code points: split() around the same pattern that regexp_extract_all() finds gives the
gaps, whose lengths add up to the offsets.

Defined cases: null equals empty; an empty table gives an empty result; repeated rows give repeated results; other columns are
ignored, or carried as they are; failing matches of a base pattern are dropped and not retried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import store

#: Strict patterns. The possessive quantifiers and the look-behinds, which admit the end of the last match, find the same spans as the
#: plain forms in time linear in the text.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that must hold where the pattern has a match.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
EXTRA = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,4}+"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ at [A-Za-z0-9-]{2,63}+ dot [A-Za-z]{2,10}+(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:.])",
    "phone": r"(?<![0-9+.(-])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?<![0-9+.-] ?)(?<![0-9])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"
    r"|(?<![0-9+.-])00[1-9][0-9]{0,2}(?:[ /-][0-9]{2,8}){2,4}(?![0-9])|(?<![0-9+.-])0[1-9][0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}(?![0-9-])",
}
#: Digits from which on a match that fails its check is an example of what is no personal data.
FAILED_DIGITS = 9
KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40

#: Gazetteers and context words, fixed values.
TOP_LEVEL = "com org net edu gov info io de fr es it uk eu us ch at nl be pt mx ar co".split()
CONTEXT_WORDS = {
    "email": "mail|e-mail|email|contact|write|correo|courriel|kontakt",
    "ip": "ip|address|host|server|login|from|adresse|direcci",
    "card": "card|visa|mastercard|amex|credit|pay|karte|carte|tarjeta|iban|account",
    "phone": "phone|tel|call|fax|mobile|cell|ruf|appel|llam",
}
CODE_WORDS = r"version|isbn|issn|sku|order|serial|build|invoice|article|part|reference|ref|v\.|no\.|nr\.|section|chapter|\$|€|#"
#: Telephone prefixes of the countries of the gazetteer's domains.
CALLING_CODES = "1 7 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 54 55 56 57 61 81 86 91 351 353 358".split()


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, m>> of the matches, start in code points."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    ends = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("out")),
        lambda acc, k: F.struct(
            (acc["at"] + F.length(F.element_at(gaps, k)) + F.length(F.element_at(found, k))).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(F.element_at(gaps, k))).cast("int").alias("start"), F.element_at(found, k).alias("m")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, ends).otherwise(F.array().cast("array<struct<start:int,m:string>>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The checksum over digits, from the right."""
    value = lambda k: F.substring(F.reverse(number), k, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)), F.lit(0),
        lambda acc, k: acc + F.when(k % 2 == 1, value(k)).otherwise(F.when(value(k) > 4, value(k) * 2 - 9).otherwise(value(k) * 2)),
    )
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def hint(kind: str, text: Column) -> Column:
    if kind == "card":
        return text.rlike("[0-9][ -]?[0-9]")
    return F.contains(text, F.lit(HINT[kind]))


LOCATED = "array<struct<start:int,m:string>>"
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,able:boolean,m:string,left:string,right:string>>"


def with_candidates(rows: DataFrame, text: Column) -> DataFrame:
    """rows with found, all candidate spans of the text with their context. Each step is a column of its own, computed once."""
    none = F.array().cast(SPAN)

    def spans(kind: str, found: Column, base: bool, able: bool = True) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["m"])).cast("int").alias("end"), F.lit(base).alias("base"), F.lit(able).alias("able"), s["m"].alias("m"),
                F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))).alias("left"),
                F.substring(text, s["start"] + F.length(s["m"]) + 1, F.lit(CONTEXT)).alias("right"),
            ),
        ).cast(SPAN)

    def passing(kind: str) -> Column:
        return F.filter(f"_b_{kind}", lambda s: passes(kind, s["m"]))

    def failing(kind: str) -> Column:
        return F.filter(f"_b_{kind}", lambda s: (F.length(digits(s["m"])) >= FAILED_DIGITS) & ~passes(kind, s["m"]))

    loose = {
        "email": F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit(" dot ")), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
        "phone": text.rlike(r"[0-9]{3}[ .-][0-9]{4}|[0-9][ /-][0-9]{2}"),
    }
    nothing = F.array().cast(LOCATED)
    rows = rows.withColumns({f"_b_{k}": F.when(hint(k, text), located(text, BASE[k])).otherwise(nothing) for k in KINDS} | {f"_x_{k}": F.when(loose[k], located(text, EXTRA[k])).otherwise(nothing) for k in EXTRA})
    rows = rows.withColumn("_strict", F.concat(*[F.when(F.size(f"_b_{k}") > 0, spans(k, passing(k), True)).otherwise(none) for k in KINDS]))
    rows = rows.withColumn("_failed", F.concat(*[F.when(F.size(f"_b_{k}") > 0, spans(k, failing(k), False, False)).otherwise(none) for k in KINDS if k != "email"]))
    rows = rows.withColumn("_extra", F.concat(*[F.when(F.size(f"_x_{k}") > 0, spans(k, F.col(f"_x_{k}"), False)).otherwise(none) for k in EXTRA]))
    touches = lambda others: lambda e: ~F.exists(others, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))
    # A loose candidate that touches a strict span is that span, and a failed match that touches a candidate is no example of its own.
    apart = F.when(F.size("_extra") > 0, F.filter("_extra", touches("_strict"))).otherwise(none)
    rows = rows.withColumn("_extra", apart).withColumn("_failed", F.when(F.size("_failed") > 0, F.filter(F.filter("_failed", touches("_strict")), touches("_extra"))).otherwise(none))
    return rows.withColumn("found", F.concat("_strict", "_extra", "_failed"))


def votes(s: Column) -> list[Column]:
    """Each labeller's vote on a span: 1 for personal data, -1 against, 0 none."""
    kind, m = s["kind"], s["m"]
    number, n = digits(m), F.length(digits(m))
    say = lambda yes, no: F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))
    near = F.lower(F.concat(s["left"], F.lit(" "), s["right"]))
    context = F.lit(False)
    for k in KINDS:
        context = context | ((kind == k) & near.rlike(CONTEXT_WORDS[k]))
    code = F.lower(s["left"]).rlike(rf"(?:{CODE_WORDS})[\s:.#]*(?:no|nr|number)?[\s:.#]*$")
    tld = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[\])]?$", 1))
    same = number.rlike(r"^([0-9])\1*$")  # one digit over and over
    bare = m.rlike("^[0-9]+$")
    sound = F.when(kind == "card", passes("card", m)).when(kind == "ip", m.contains(":") | passes("ip", m)).when(kind == "phone", n.between(9, 15) & ~same).otherwise(m.rlike(r"^[^@]*[A-Za-z]"))
    calling = F.when(m.startswith("+") | m.startswith("00"), F.regexp_replace(number, "^00", "").rlike(f"^(?:{'|'.join(CALLING_CODES)})")).otherwise(F.lit(None))
    return [
        say(sound, ~sound),  # checksum and structure
        F.when(kind == "email", say(tld.isin(TOP_LEVEL), ~tld.isin(TOP_LEVEL))).when((kind == "phone") & calling.isNotNull(), say(calling, ~calling)).when(kind == "card", say(m.rlike("^[3-6]"), ~m.rlike("^[2-6]"))).otherwise(F.lit(0)),  # gazetteers
        say(context, code),  # the words around it
        say(s["left"].rlike(r"(?:^|[\s(\[<:,;])$") & s["right"].rlike(r"^(?:$|[\s.,;:!?)\]>])"), s["left"].rlike(r"[\p{L}\p{N}_/#=-]$") | s["right"].rlike(r"^[\p{L}\p{N}_/=]")),  # a token of its own
        say(m.rlike(r"[A-Za-z]\.?[0-9]|[A-Za-z]{3}") | m.contains("(") | m.contains("+") | m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){2,3}"), same | bare & (kind != "card") | bare & ~passes("card", m)),  # how people write it
        say(s["base"], ~s["able"]),  # the strict pattern
    ]


def features(s: Column) -> list[Column]:
    """What the classifier sees. Which pattern found a span is not among it, as that would tell the examples apart without a look at them."""
    m, n = s["m"], F.length(digits(s["m"]))
    return [
        s["left"].rlike(r"(?:^|\s)$"), s["right"].rlike(r"^(?:$|[\s.,;:!?)])"), n.between(10, 16), m.rlike("[A-Za-z]"), m.rlike("[ ()/-]"),
        F.lower(F.concat(s["left"], s["right"])).rlike("|".join(CONTEXT_WORDS.values())), F.lower(s["left"]).rlike(rf"(?:{CODE_WORDS})[\s:.#]*(?:no|nr|number)?[\s:.#]*$"),
        s["left"].rlike(r"[\p{L}\p{N}_/#=-]$") | s["right"].rlike(r"^[\p{L}\p{N}_/=]"), digits(m).rlike(r"^([0-9])\1*$"),
    ]


def bits(flags: list[Column]) -> Column:
    total = F.lit(0)
    for k, f in enumerate(flags):
        total = total + F.when(f, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def code(of: list[Column]) -> Column:
    total = F.lit(0)
    for k, v in enumerate(of):
        total = total + (v + 1) * 3**k
    return total


#: By the last character of a group, what share of it is taken for personal data at first: loose forms and failed matches have groups of their own.
LOOSE, FAILED = "~", "!"
PRIOR = {LOOSE: 0.5, FAILED: 0.2}


def group_of(s: Column) -> Column:
    return F.concat(s["kind"], F.when(s["base"], "").when(s["able"], LOOSE).otherwise(FAILED))


def expectation_maximisation(counts: dict[tuple[str, tuple[int, ...]], int], labellers: int, rounds: int = 30) -> tuple[dict[tuple[str, tuple[int, ...]], float], list[float]]:
    """Posterior of each vote pattern and each labeller's accuracy, where it votes. Priors are those of groups, a kind and how its spans were found; accuracies start at 0.75 and stay in [0.05, 0.97],
    a labeller being taken to be better than chance at first, which fixes which side is which."""
    accuracy, prior = [0.75] * labellers, {group: PRIOR.get(group[-1], 0.8) for group, _ in counts}
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for key in counts:
            kind, pattern = key
            score = math.log(prior[kind] / (1 - prior[kind]))
            for vote, a in zip(pattern, accuracy):
                score += vote * math.log(a / (1 - a))
            posterior[key] = 1 / (1 + math.exp(-max(-30, min(30, score))))
        for j in range(labellers):
            right = sum(n * (posterior[key] if key[1][j] > 0 else 1 - posterior[key]) for key, n in counts.items() if key[1][j])
            cast = sum(n for key, n in counts.items() if key[1][j])
            accuracy[j] = min(0.97, max(0.05, (right + 3.0) / (cast + 4.0)))
        for kind in prior:
            mass = sum(n * posterior[key] for key, n in counts.items() if key[0] == kind)
            total = sum(n for key, n in counts.items() if key[0] == kind)
            prior[kind] = min(0.99, max(0.01, (mass + 1) / (total + 2)))
    return posterior, accuracy


def logistic(rows: list[tuple[list[float], float, float]], ridge: float = 1.0, rounds: int = 400) -> list[float]:
    """Weights, the last for the constant, of a logistic model for (features, target in [0, 1], weight) by gradient steps on the mean loss."""
    if not rows:
        return []
    width, total = len(rows[0][0]), sum(r[2] for r in rows)
    w, step = [0.0] * (width + 1), 4.0 / (width + 1)
    for _ in range(rounds):
        slope = [ridge / total * x for x in w[:-1]] + [0.0]
        for x, y, n in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, x))
            gap = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) * n / total
            for k, v in enumerate(x):
                slope[k] += gap * v
            slope[-1] += gap
        w = [a - step * g for a, g in zip(w, slope)]
    return w


def train(spans: DataFrame) -> tuple[list[float], list[float]]:
    """(classifier weights over features + kinds + constant, labeller accuracies) from a DataFrame with a column s of candidate spans."""
    s = F.col("s")
    labellers, width = len(votes(s)), len(features(s))
    found = spans.select(group_of(s).alias("group"), code(votes(s)).alias("votes"), bits(features(s)).alias("features")).groupBy("group", "votes", "features").count().collect()
    # At most 3 * kinds * 3**labellers * 2**features rows, whatever the corpus; in practice some dozens.
    unpack = lambda v: tuple(v // 3**k % 3 - 1 for k in range(labellers))
    counts: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in found:
        key = (r["group"], unpack(r["votes"]))
        counts[key] = counts.get(key, 0) + r["count"]
    posterior, accuracy = expectation_maximisation(counts, labellers)
    rows = [([float(r["features"] >> k & 1) for k in range(width)] + [float(r["group"].rstrip(LOOSE + FAILED) == k) for k in KINDS], posterior[r["group"], unpack(r["votes"])], float(r["count"])) for r in sorted(found, key=str)]
    return logistic(rows), accuracy


def accepted(s: Column, weights: list[float]) -> Column:
    """Base spans stay; others need the classifier's consent."""
    if not weights:  # nothing was found
        return s["base"]
    terms = features(s) + [s["kind"] == k for k in KINDS]
    score = F.lit(weights[-1])
    for w, t in zip(weights, terms):
        score = score + F.when(t, F.lit(w)).otherwise(F.lit(0.0))
    return s["base"] | s["able"] & (score > 0)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, spans[, _carried]) of every row; spans: array<struct<start, rank, end, kind, base>> in the order of the text."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_carried")] if carry else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *carried)
    rows = store(with_candidates(slim, F.col("_text")).select("doc_id", "found", *(["_carried"] if carry else [])), "pii")
    weights, _ = train(rows.where(F.size("found") > 0).select(F.explode("found").alias("s")))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int")
    kept = F.transform(
        F.filter("found", lambda s: accepted(s, weights)),
        lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
    )
    return rows.select("doc_id", F.array_sort(kept).alias("spans"), *(["_carried"] if carry else []))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans are replaced as one. Null texts stay null."""
    found = detect(docs, id_col, text_col, carry=True)
    text = F.col(f"_carried.`{text_col}`")
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size("spans") > 0, done).otherwise(text)
    return found.select(*[(clean if c == text_col else F.col(f"_carried.`{c}`")).alias(c) for c in docs.columns])
