"""The prefix trie, the suffix tree and vector codes against brute force, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import common, prefix_trie, suffix_tree, vector_codes

TURNS = "conv_id long, turn long, role string, text string, pos int, n int, k1 string"


def trie_by_hand(rows, rebuild=True):
    """rows: (conv_id, turn, role, text), turns of a conversation being distinct or equal in all."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = convs
    if rebuild:
        paths = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 9
            paths[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = collections.Counter(node[:-1] for node in members if node)
    saved, leaves = collections.Counter(), collections.Counter()
    for node, of in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not kids[node]
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(frame, rebuild=True):
    turns = prefix_trie.numbered_turns(frame)
    if rebuild:
        found = prefix_trie.trie(*prefix_trie.branched(turns))
    else:
        found = prefix_trie.of_conversations(frame)
    return sorted((tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def random_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), 45):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, None if turn == 0 and rng.random() < 0.3 else turn, rng.choice(["user", "bot", None]), rng.choice(["hi", "é", "", None, "long " * 50]), 1, 2, "x"))
    return rows + rows[:7] + [(None, 1, "user", "no conversation", 1, 2, "x")]


@pytest.mark.parametrize("rebuild", [True, False])
def test_the_trie_is_that_of_all_prefixes(spark, rebuild):
    rows = random_turns(3)
    assert trie_of(spark.createDataFrame(rows, TURNS).repartition(7), rebuild) == trie_by_hand([r[:4] for r in rows], rebuild)


def test_long_conversations_go_by_cells_and_tries_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL", 4)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(common, "SENT_GROUPS", 3)
    monkeypatch.setattr(common, "GROUP_ROWS", 5)
    rows = random_turns(4) + [(c, t, "user", f"turn {t % 3}", 1, 2, "x") for c in (100, 101, 102) for t in range(90 - c % 5)]
    rows += [(103, None, "user", f"same turn {t}", 1, 2, "x") for t in (0, 0, 0)]  # repeated rows of one turn
    assert trie_of(spark.createDataFrame(rows, TURNS).repartition(9)) == trie_by_hand([r[:4] for r in rows])


def test_equal_turns_are_ordered_alike_in_all_conversations(spark):
    rows = [(c, 1, "user", text) for c in (0, 5) for text in ("a", "b", "c")]
    got = trie_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), False)
    assert [(r[0], r[1], r[3]) for r in got] == [(0, d, 2) for d in range(4)]


def test_the_trie_of_no_conversation_is_empty(spark):
    assert trie_of(spark.createDataFrame([], TURNS)) == []


def test_texts_are_not_shuffled_for_the_trie(spark):
    turns = prefix_trie.numbered_turns(spark.createDataFrame(random_turns(1), TURNS))
    assert "text" not in turns.columns and "role" not in turns.columns


def scores_by_hand(docs, folds=10, depth=2, least=8, gain=4.0, prior=16.0):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, i is None or zlib.crc32(str(i).encode()) % folds == 0, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), ""]) for i, t in docs]
    single, after = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for _, held, ws in words:
        for k, w in enumerate(ws if not held else []):
            single[w] += 1
            for size in range(1, min(k, depth) + 1):
                after[size][tuple(ws[k - size : k])][w] += 1
    n, v, kept = sum(single.values()), len(single), {}
    base = lambda w: (single[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(context, w):
        out = base(w)
        for size in range(1, len(context) + 1):
            if (counts := kept.get(context[-size:])) is not None:
                out = (counts[w] + prior * out) / (sum(counts.values()) + prior)
        return out

    for size in range(1, depth + 1):
        new = {}
        for context, counts in after[size].items():
            total = sum(counts.values())
            rounded = lambda w, c=context: 10 ** (-round(-100 * math.log10(p(c[1:], w))) / 100)
            if total >= least and sum(k * math.log((k - 1 + prior * rounded(w)) / ((total - 1 + prior) * rounded(w))) for w, k in counts.items()) > gain:
                new[context] = counts
        kept |= new
    return [
        (i, held, len(ws), sum(single[w] > 0 for w in ws), n, sum(math.log10(base(w)) for w in ws), sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), w)) for k, w in enumerate(ws)))
        for i, held, ws in words
    ], kept


DOCS = "doc_id long, text string, part int, chunk string, score int"


def made_texts(seed, n=150):
    rng = random.Random(seed)
    pairs = {w: [rng.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    out = []
    for k in range(n):
        w, text = "a", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(pairs[w]) if w in pairs and rng.random() < 0.7 else rng.choice("abcdefghijKLMNOP")
            text.append(w)
        out.append((k, rng.choice([" ", "\t", "\n ", "\x0b\x0c"]).join(text)))
    odd = ["", None, " \r\n ", "É é É", "x\xa0y", "tail ", "a b c " * 900, "\x1c sep \x85"]
    return out + [(n + k, t) for k, t in enumerate(odd)] + out[:5] + [(None, "a b c d"), (None, None)]


@pytest.mark.parametrize("options", [{}, {"chunk_words": 300, "bucket_words": 700, "split": 20}, {"depth": 3, "least": 2, "gain": 0.0, "chunk_words": 1000}])
def test_scores_are_those_of_the_tree_by_hand(spark, options):
    rows = made_texts(5)
    own = {k: v for k, v in options.items() if k in ("depth", "least", "gain")}
    want, kept = scores_by_hand(rows, **own)
    assert len(kept) > 10 and any(len(c) == own.get("depth", 2) for c in kept)
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], DOCS).repartition(5)
    got = [tuple(r) for r in suffix_tree.score(frame, **options).collect()]
    rounded = lambda rs: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs), key=str)
    assert rounded(got) == rounded(want)


def test_the_tree_scores_held_out_texts_better_than_single_words(spark):
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in made_texts(6, 400)], DOCS)
    held = suffix_tree.score(frame).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert held["s"] / held["n"] > held["b"] / held["n"] + 0.1


def test_no_texts_and_no_training_texts(spark):
    assert suffix_tree.score(spark.createDataFrame([], DOCS)).collect() == []
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    (r,) = suffix_tree.score(spark.createDataFrame([(held, "a b", 1, "c", 2)], DOCS)).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_blobs_round_trip():
    import numpy as np

    arrays = [np.array([1, -(2**40), 5], "<i8"), np.array([], "<u8"), np.array([3, 9], "<i2")]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, suffix_tree.thawed(suffix_tree.frozen(*arrays), "<i8", "<u8", "<i2")))


VECTORS = "vec_id long, embedding array<double>, label string, code string, dim int"


def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**40 else int(x) * scale for x in v], label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(q) for _, q, _, _ in kept}:
        same = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        cut = [dim * p // parts for p in range(parts + 1)]
        books = [[r[1][cut[p] : cut[p + 1]] for r in same[:entries]] for p in range(parts)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        find = lambda q, books=books, cut=cut: [min((far(q[cut[p] : cut[p + 1]], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
        for _ in range(rounds):
            found = [[k for _, k in find(r[1])] for r in same]
            for p in range(parts):
                for k in range(len(books[p])):
                    if own := [r[1][cut[p] : cut[p + 1]] for r, f in zip(same, found) if f[p] == k]:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, q, label, _ in same:
            best = find(q)
            out.append([i, "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1), label, sha])
    total = collections.Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted(((r[0], r[1], r[2], min(total[r[3]], 2**63 - 1), r[4]) for r in out), key=str)


def coded(frame):
    found, _ = vector_codes.compress(frame)
    return sorted((tuple(r) for r in vector_codes.with_label_error(found).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def made_vectors(seed, n=120, dim=16):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([rng.gauss(0, 1), 0.25, -0.5]) for _ in range(dim)], rng.choice(["x", "y", None])) for k in range(n)]
    return rows + rows[:6] + [(3, [0.5] * dim, "x"), (None, [0.125] * dim, None)]


def test_codes_are_those_of_the_rounds_by_hand(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*made_vectors(1), (500, None, "x"), (501, [nan] * 16, "x"), (502, [inf] + [0.0] * 15, "y"), (503, [None] + [0.0] * 15, "y")]
    assert coded(spark.createDataFrame([(*r, "c", 3) for r in rows], VECTORS).repartition(6)) == codes_by_hand(rows)


def test_few_odd_and_large_vectors(spark):
    rows = [(k, [k / 7 + j for j in range(11)], "x") for k in range(5)] + [(k, [], "y") for k in range(3)] + [(k, [float(k), -1.5, 2.0], "y") for k in range(20)]
    assert coded(spark.createDataFrame([(*r, "c", 3) for r in rows], VECTORS)) == codes_by_hand(rows)
    rows = [(k, [10.0 ** (k % 9 + 4), -(3.0 ** (k % 30)), 0.1, 1e-300, 5.5e5, 7.0, 8.0, 1e17 * (k % 2)], "x") for k in range(40)] + [(99, [1e300] * 8, "x")]
    assert coded(spark.createDataFrame([(*r, "c", 3) for r in rows], VECTORS).repartition(3)) == codes_by_hand(rows)
    assert coded(spark.createDataFrame([], VECTORS)) == []


def test_labels_of_any_size_are_summed_without_meeting_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT_GROUPS", 1)
    monkeypatch.setattr(common, "GROUP_ROWS", 7)
    rows = made_vectors(2)
    assert coded(spark.createDataFrame([(*r, "c", 3) for r in rows], VECTORS)) == codes_by_hand(rows)


def test_a_code_stands_for_its_entries(spark):
    rows = made_vectors(3)
    found, books = vector_codes.compress(spark.createDataFrame([(*r, "c", 3) for r in rows], VECTORS))
    whole = {r[0]: [math.floor(4096 * x) for x in r[1]] for r in rows[6:120]}
    for r in found.where("vec_id between 6 and 119 and vec_id != 3").collect():
        back = vector_codes.decode(r["code"], books[16])
        assert sum((int(x) - y) ** 2 for x, y in zip(back, whole[r["vec_id"]])) == r["error"]


def test_a_chunk_takes_few_bytes_a_word_and_goes_before_the_next(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rng, each = np.random.default_rng(3), 100_000
    rows, told = [], {}
    for k in range(2):
        codes = (rng.zipf(1.3, each) % 20_000).astype("<i4")
        hashes, counts = suffix_tree.mixed(np.arange(20_000)), np.bincount(codes, minlength=20_000).astype("<i8")
        frozen = suffix_tree.frozen
        rows.append({"part": k, "chunk": k, "ids": pa.array(range(each // 100)), "docs": frozen(np.full(each // 100, 100, "<i8"), np.zeros(each // 100, "u1")), "words": frozen(hashes, counts), "codes": frozen(codes)})
    model = {"least": 8, "gain": 4.0, "prior": 16.0, "n": 2 * each, "v": 20_000, "split": 200_000, "buckets": 2, "word_buckets": 2, "retained": []}
    monkeypatch.setattr(suffix_tree.Chunk, "told", lambda self, path: [a for _, a in sorted(told[path, self.chunk])])

    def answered(path, asked, answer):
        for b in range(2):
            for r in answer(pa.Table.from_batches(asked).filter(pc.field("bucket") == b)).to_pylist():
                if r["part"] >= 0:
                    told.setdefault((path, r["chunk"]), []).append((r["bucket"], r["answer"]))

    words = pa.RecordBatch.from_pylist([{"part": r["part"], "chunk": r["chunk"], "words": r["words"]} for r in rows])
    answered("0", list(suffix_tree.ask_words(2)(iter([words]))), suffix_tree.answer_words())
    for k in (1, 2):
        asked = [suffix_tree.batch_of(suffix_tree.Chunk(r, [str(x) for x in range(k)], model).questions(), suffix_tree.ASKED) for r in rows]
        answered(str(k), asked, suffix_tree.answer_pairs(model, k))
        model = {**model, "retained": [*model["retained"], np.array([], np.uint64)]}
    monkeypatch.setattr(suffix_tree, "rows_of", lambda batches: iter(rows))
    tracemalloc.start()
    assert sum(b.num_rows for b in suffix_tree.scorer(["0", "1", "2"], model)([])) == 2 * each // 100
    most = tracemalloc.get_traced_memory()[1] / each
    tracemalloc.stop()
    assert most < 90


def test_texts_are_cut_into_words_by_runs_of_few_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": ["aa", None, "b" * 9, "", "ccc", "dd"]})
    runs = list(suffix_tree.by_bytes(batch, 1, 5))
    assert [r.column(0).to_pylist() for r in runs] == [[0, 1], [2], [3, 4, 5]]
    assert list(suffix_tree.by_bytes(batch.slice(0, 0), 1, 5)) == []
