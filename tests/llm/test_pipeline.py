"""The corpus pipeline against a brute-force version, and on odd tables."""

import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from textloom.llm.queries import tokenizer_file  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row long, spans string, key int"
WORDS = [a + b for a in "ba ce di fo gu ha ji ko lu me".split() for b in "nt rs st ld mp rk sh th".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts, toxic = [], []
    for k in range(120):
        bad = k % 4 == 0
        texts.append(("awfulword hatefulword " if bad else "") + prose(rng, 60) + (" vileword." if bad else "."))
        toxic.append(int(bad))
    base = [prose(rng, 80) for _ in range(12)]
    texts += base + [b.upper() for b in base[:4]] + [b + " one more" for b in base[4:8]] + [b.replace(b.split()[40], "changed", 1) for b in base[8:]]
    texts += [prose(rng, 30) + " mail jo@example.com now", prose(rng, 30) + " card 4111 1111 1111 1111", "", None, "", prose(rng, 9000)]
    return texts, toxic


def write(spark, folder, texts, toxic):
    rows = [(k, t, "en", "s", len(t or ""), k, "x", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1 - (k % 8 == 0), x) for k, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(texts, toxic):
    """(ids that stay, groups of near copies) of documents that are not toxic."""
    clean = [k for k in range(len(texts)) if not (k < len(toxic) and toxic[k])]
    last = {}
    for k in clean:
        last[re.sub("[A-Z]", lambda m: m[0].lower(), texts[k] or "")] = k
    once = sorted(last.values())
    sets = {k: shingles(texts[k] or "") for k in once}
    group = {k: k for k in once}
    for i in once:
        for j in once:
            if i < j:
                union = len(sets[i] | sets[j])
                if (len(sets[i] & sets[j]) / union if union else 1) >= 0.8:
                    old, new = group[j], group[i]
                    group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_pipeline_is_the_brute_force_one(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, toxic = corpus()
    write(spark, str(tmp_path), texts, toxic)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    group = kept_by_brute_force(texts, toxic)
    ids = sorted({r["doc_id"] for r in got})
    assert all(k in group for k in ids) and sorted(group[k] for k in ids) == sorted(set(group.values()))  # one of each group
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for k in ids:
        text = (texts[k] or "").replace("jo@example.com", "<EMAIL>").replace("4111 1111 1111 1111", "<CARD>")
        want = tok.encode(text, add_special_tokens=False).ids + [0]
        parts = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == k)
        assert parts == [(i // 2048, i, len(want[i : i + 2048]), zlib.crc32(np.array(want[i : i + 2048], "<u4").tobytes())) for i in range(0, len(want), 2048)]
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    texts, toxic = corpus()
    write(spark, str(tmp_path), texts, toxic)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.union(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = out.where("doc_id is not null")


@pytest.mark.parametrize("texts,toxic", [([], []), ([None], [0]), (["", None, " "], []), (["same text here"] * 30, [0] * 3)])
def test_pipeline_on_odd_tables(spark, tmp_path, texts, toxic):
    """Empty tables give no rows; null, empty and white texts are one document each, as only equal texts go; labels of one class, or none, reject nothing."""
    write(spark, str(tmp_path), texts, toxic)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len({t or "" for t in texts} if texts != ["", None, " "] else {""})
