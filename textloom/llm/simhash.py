"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints meet first, so only distinct ones are compared. They are grouped into cells by bands of the bit counts of
their two halves and cut into tiles. The bit counts of two fingerprints differ by no more than their distance does,
so only tiles of cells whose counts differ by the radius at most, summed over both halves, are compared: numpy's
exclusive-or and bit counts over whole tiles. A tile pair returns a spanning forest of its links, which keeps
every connection and at most one row per fingerprint. Components come from alternating star contractions over
stored tables until nothing changes.

With a similarity, fingerprints only admit pairs. A link of the Jaccard similarity asked for lies within a component of admitted pairs,
so the texts of these are brought together, large components cut into parts that meet pair by pair, and each
link is confirmed on the sets of shingles before components are formed again. Fingerprints are then those of the
sets, and equal sets meet first.

Defined cases: null equals empty; a text without words has fingerprint zero and is linked like any other; texts with
fewer words than a shingle are one shingle; repeated rows are linked to each other; ids that repeat with other texts are
other documents; null ids take part and name no component unless it holds nothing else; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import sent, store

#: Near-duplicates proper: a similarity of 0.8 of the sets of five-word shingles turns 9.7 of 64 bits and 39 of 256 on average. The radii
#: only admit pairs to the comparison of the sets, so they are wide: 22 and 64 are more than four deviations above these means, and
#: 64 is eight below that of unrelated texts.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 22
LANES = 4
WIDE_RADIUS = 64
SEED = 42
#: Rows and bytes of text of a part of a component whose sets are compared in one task with those of another part.
PART_ROWS = 1024
PART_BYTES = 8 << 20
#: Rows of a tile, 40 bytes each with four lanes. Copies of tiles grow with rows / TILE.
TILE = 65536
#: Rows of a key from which on it may be hot.
HOT_ROWS = 1000
#: Pairs that numpy compares at once.
BLOCK = 1 << 20


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of the shingles, in order. White space is the six ASCII characters at which bytes.split() splits."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxh64_intdigest(b" ".join(parts), SEED)]
    line = b" ".join(parts)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *stops[:-1].tolist()]
    ends = (stops - 1).tolist()
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def shingle_set(text: bytes, words: int):
    """Their sorted distinct hashes."""
    import numpy as np

    return np.unique(np.array(shingle_hashes(text, words), "<u8"))


def fold(h, lanes: int) -> list[int]:
    """`lanes` signed 64-bit fingerprints. The first is of the hashes, the others of bijective mixes of them."""
    import numpy as np

    if not len(h):
        return [0] * lanes
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.array(h[at : at + (1 << 15)], "<u8")
        for lane in range(lanes):
            x = part
            if lane:  # an odd product and a shift carry every bit of the hash on
                x = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            counts[lane] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprint(text: bytes, words: int, lanes: int = 1) -> list[int]:
    """Of the shingles as often as they occur."""
    return fold(shingle_hashes(text, words), lanes)


def set_fingerprint(text: bytes, words: int, lanes: int) -> list[int]:
    """Of the set of shingles, and behind it a hash of the whole set."""
    import numpy as np
    from xxhash import xxh64_intdigest

    h = shingle_set(text, words)
    return [*fold(h, lanes), int(np.uint64(xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))]


def fingerprint_column(text, words: int, lanes: int, of_set: bool = False):
    make = set_fingerprint if of_set else fingerprint

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([make(t or b"", words, lanes) for t in batch.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def half_counts(fp):
    return F.bit_count(F.shiftrightunsigned(fp, 32)).cast("int"), F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")


def forest(a, b, same: bool, radius: int, wide_radius: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of rows, of the links between two tiles of (rows, lanes) fingerprints, or within one. Rows are
    taken by bit count, and only the stretch of the other tile whose counts are within the radius is compared."""
    import numpy as np

    shift = 0 if same else len(a)
    parent = np.arange(shift + len(b))

    def roots(x):
        found = parent[x]
        while not np.array_equal(found, above := parent[found]):
            found = above
        return found

    links = []
    count_a, count_b = np.bitwise_count(a[:, 0]).astype(int), np.bitwise_count(b[:, 0]).astype(int)
    order_a, order_b = np.argsort(count_a, kind="stable"), np.argsort(count_b, kind="stable")
    sorted_a, sorted_b, count_a, count_b = a[order_a, 0], b[order_b, 0], count_a[order_a], count_b[order_b]
    step = min(64, max(1, BLOCK // max(1, len(b))))
    dense = False
    for at in range(0, len(a), step):
        low, high = np.searchsorted(count_b, [count_a[at] - radius, count_a[min(at + step, len(a)) - 1] + radius + 1])
        if dense:  # among near copies most pairs are joined already: they need no link, and no loop
            tops_a, tops_b = roots(order_a[at : at + step]), roots(order_b[low:high] + shift)
            if (tops_b == tops_a[0]).all() and (tops_a == tops_a[0]).all():
                continue
        near = np.bitwise_count(sorted_a[at : at + step, None] ^ sorted_b[None, low:high]) <= radius
        many = 8 * np.count_nonzero(near) > near.size
        if dense:
            near &= tops_a[:, None] != tops_b[None, :]
        dense = many
        rows, cols = np.nonzero(near)
        rows, cols = order_a[rows + at], order_b[cols + low]
        if same:
            ahead = rows < cols
            rows, cols = rows[ahead], cols[ahead]
        if wide_radius is not None and len(rows):
            fits = np.bitwise_count(a[rows] ^ b[cols]).sum(axis=1, dtype=int) <= wide_radius
            rows, cols = rows[fits], cols[fits]
        apart = roots(rows) != roots(cols + shift)
        rows, cols = rows[apart], cols[apart]
        for i in np.unique(rows).tolist():
            others = cols[rows == i]
            tops, first = np.unique(roots(others + shift), return_index=True)
            own = int(roots(np.array([i]))[0])
            new = tops != own
            parent[tops[new]] = own
            links += [(i, j) for j in others[first[new]].tolist()]
    return links


def links(prints: DataFrame, radius: int, wide_radius: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b) of nodes of prints (node, fps): their graph has the components that all links have. A link is a distance of at most radius
    in the first lane and, if wide_radius is given, of at most that over all lanes."""
    width = max(1, radius // 2)  # of a band of bit counts
    gap = lambda i: max(0, (abs(i) - 1) * width + 1)
    high, low = half_counts(F.col("fps")[0])
    band = lambda c: F.floor(c / width).cast("int")
    cells = prints.select("node", "fps", band(high).alias("high"), band(low).alias("low"), (high + low).alias("bits"))
    sizes = cells.groupBy("high", "low").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # at most 33 * 33 rows
    cut = cells.join(F.broadcast(sizes), ["high", "low"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = cut.groupBy("high", "low", "part").agg(F.sort_array(F.collect_list(F.struct("node", "fps"))).alias("t"))
    tiles = store(tiles.withColumn("tile", F.monotonically_increasing_id()), "simhash-tiles")
    # Each unordered pair of cells that may hold links once: offsets in the upper half plane, and the cell itself.
    far = range(-radius - 1, radius + 2)
    offsets = [(i, j) for i in far for j in far if (i, j) >= (0, 0) and gap(i) + gap(j) <= radius]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    # Pairs are made of tiles' numbers, so that a cell of many tiles deals out rows of 17 bytes, and meet their arrays tile by tile.
    numbers = tiles.select("high", "low", "part", "tile")
    left = numbers.select("high", "low", F.col("part").alias("part_a"), F.col("tile").alias("a"), near.alias("o")).select(
        (F.col("high") + F.col("o.i")).alias("high"), (F.col("low") + F.col("o.j")).alias("low"), "part_a", "a", ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("home")
    )
    pairs = left.join(numbers.select("high", "low", F.col("part").alias("part_b"), F.col("tile").alias("b")), ["high", "low"]).where(~F.col("home") | (F.col("part_a") <= F.col("part_b")))
    pairs = pairs.select("a", "b").repartition("a", "b")
    arrays = lambda name, t: tiles.select(F.col("tile").alias(name), F.col("t").alias(t))
    met_a = pairs.join(arrays("a", "ta"), "a")
    dealt = met_a.where("a <> b").join(arrays("b", "tb"), "b").select("ta", "tb", F.lit(False).alias("same"))
    dealt = dealt.unionByName(met_a.where("a = b").select("ta", F.lit(None).cast(tiles.schema["t"].dataType).alias("tb"), F.lit(True).alias("same")))
    dealt = dealt.repartition(F.xxhash64(F.col("ta")[0]["node"], F.col("tb")[0]["node"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(column, k):
            t = column[k].values
            return t.field("node").to_numpy(zero_copy_only=False), t.field("fps").flatten().to_numpy(zero_copy_only=False).view("<u8").reshape(len(t), -1)

        for batch in batches:
            for k in range(batch.num_rows):
                alike = batch.column(2)[k].as_py()
                node_a, a = side(batch.column(0), k)
                node_b, b = (node_a, a) if alike else side(batch.column(1), k)
                found = forest(a, b, alike, radius, wide_radius)
                rows, cols = ([i for i, _ in found], [j for _, j in found])
                yield pa.RecordBatch.from_arrays([pa.array(node_a[rows], pa.int64()), pa.array(node_b[cols], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def jaccard(x, y) -> float:
    """Of two sorted arrays of distinct hashes."""
    import numpy as np

    if not len(x) or not len(y):
        return float(len(x) == len(y))
    x, y = (x, y) if len(x) < len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def confirmed_forest(sets, prints, parts, radius: int, wide_radius: int | None, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of rows, of the links of at least the similarity among admitted pairs: those within the part if all rows
    are of one, else those across the two. Close pairs come first, so that few of a group of near copies are compared."""
    import numpy as np

    one = bool((parts == parts[0]).all())
    left = np.arange(len(sets)) if one else np.nonzero(parts == parts.min())[0]
    right = left if one else np.nonzero(parts != parts.min())[0]
    sizes = np.array([len(x) for x in sets])
    found = []
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if one else right
        # No two sets are more alike than the smaller is in size to the larger.
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-6]
        bits = np.bitwise_count(prints[others] ^ prints[i])
        far = bits.sum(axis=1, dtype=np.int32)
        near = (bits[:, 0] <= radius) & (far <= (wide_radius if wide_radius is not None else 64 * prints.shape[1]))
        found.append(np.stack([np.full(int(near.sum()), i), others[near], far[near]], axis=1))
    pairs = np.concatenate(found)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j, _ in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist():
        if (p := root(i)) != (q := root(j)) and jaccard(sets[i], sets[j]) >= similarity:
            parent[p] = q
            links.append((i, j))
    return links


def confirmed(
    texts: DataFrame, prints: DataFrame, roots: DataFrame, words: int, radius: int, wide_radius: int | None, similarity: float, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(a, b) of nodes: links of the similarity within the components of admitted pairs, as forests. texts: (_row, text)."""
    members = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    members = store(members.join(prints, "node").select("node", "fps", "root", F.col("first._row").alias("_row")), "simhash-members")
    # Texts of the members alone are moved while their row numbers are few enough to be sent; beyond that both sides are dealt by row number, of which there is one a text.
    held = texts.join(sent(members.select("_row", "node", "root"), members.count()), "_row").select("node", "root", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    held = store(held.join(members.select("node", "fps"), "node"), "simhash-members")
    parts = F.ceil(F.greatest(F.count("*") / part_rows, F.sum(F.octet_length("text")) / part_bytes)).cast("int")
    large = held.groupBy("root").agg(parts.alias("parts")).where("parts > 1")  # one row for part_bytes or part_rows at most
    cut = held.join(F.broadcast(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = cut.groupBy("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("node", "part", "fps", "text")).alias("t")).where(F.size("t") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for k in range(batch.num_rows):
                t = batch.column(0)[k].values
                node, part = (t.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part"))
                prints = t.field("fps").flatten().to_numpy(zero_copy_only=False).view("<u8").reshape(len(t), -1)
                sets = [shingle_set(x.as_py(), words) for x in t.field("text")]
                found = np.array(confirmed_forest(sets, prints, part, radius, wide_radius, similarity), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]], pa.int64()), pa.array(node[found[:, 1]], pa.int64())], names=["a", "b"])

    return met.select("t").mapInArrow(compare, "a long, b long")


def hot_rows(total: int) -> int:
    """A key with more rows than this is hot: at least a hundred-thousandth of all, so that there are at most 100,000 such keys."""
    return max(HOT_ROWS, total // 100_000)


def met(rows: DataFrame, table: DataFrame, key: str, hot: int) -> DataFrame:
    """rows with the columns of table, which has one row a key and in n how many rows have it. Rows of hot keys stay where they are: their
    keys are sent to them."""
    large, rest = table.where(F.col("n") > hot).drop("n"), table.where(F.col("n") <= hot).drop("n")
    if large.isEmpty():
        return rows.join(rest, key)
    return rows.join(F.broadcast(large), key).unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(rest, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component. Large and small star by turns; each round is stored, so that a
    lost executor costs one round at most. A star with a third of all nodes is summed before it is joined."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = store(edges, "components")
    hot = hot_rows(2 * edges.count())
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "components")
        large = store(met(both, least, "a", hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "components")
        least = store(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "components")
        small = met(large, least, "a", hot).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after = store(small, "components")
        if same_rows(edges, after):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def same_rows(x: DataFrame, y: DataFrame) -> bool:
    """By count and two order-free sums of hashes over distinct rows."""
    one = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    return one(x) == one(y)


def near_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, lanes: int = LANES, wide_radius: int | None = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
    similarity: float | None = None, part_rows: int = PART_ROWS,
) -> DataFrame:
    """(_row, doc_id, fp, component, component_id, keeper[, _carried]) of every row: component names the group,
    component_id is its smallest id and keeper the _row of one document with that id. Links are those of the fingerprints or, with a
    similarity, those admitted pairs whose sets of shingles have at least that Jaccard similarity."""
    exact = similarity is not None
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_carried")] if carry else [F.col(text_col).alias("_text")] if exact else []
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), fingerprint_column(F.col(text_col), words, lanes, exact).alias("fps"), *carried)
    rows = store(rows, "simhash")
    if exact:
        rows = rows.withColumn("node", F.element_at("fps", -1)).withColumn("fps", F.slice("fps", 1, lanes))
    else:
        rows = rows.withColumn("node", F.col("fps")[0] if lanes == 1 else F.xxhash64("fps"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("_row"))).alias("first")
    prints = store(rows.groupBy("node", "fps").agg(first, F.count("*").alias("n")), "simhash-prints")
    roots = components(links(prints.select("node", "fps"), radius, wide_radius))
    if exact:
        texts = rows.select("_row", (F.col("_carried").getField(text_col) if carry else F.col("_text")).alias("text"))
        roots = components(confirmed(texts, prints, roots, words, radius, wide_radius, similarity, part_rows))
    # Components of one node name themselves; those of more are named by the least id among their nodes.
    hot = hot_rows(prints.agg(F.sum("n")).first()[0] or 0)
    leads = roots.select(F.col("root").alias("node")).distinct().withColumn("leads", F.lit(True))
    named = prints.join(roots, "node", "left").join(leads, "node", "left").select("node", "n", "first", F.coalesce("root", "node").alias("component"), F.coalesce(F.col("root").isNotNull() | F.col("leads"), F.lit(False)).alias("joint"))
    named = store(named, "simhash-named")
    joint = named.where("joint").drop("joint", "first")
    best = store(named.where("joint").groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("n")), "simhash-best")
    names = named.where("not joint").select("node", "n", "component", F.col("first").alias("best")).unionByName(met(joint, best, "component", hot).select("node", "n", "component", "best"))
    names = store(names.select("node", "n", "component", F.col("best.doc_id").alias("component_id"), F.col("best._row").alias("keeper")), "simhash-names")
    return met(rows.drop("_text"), names, "node", hot).withColumn("fp", F.col("fps")[0]).drop("node", "fps")


def unsigned_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, with its own columns."""
    return near_groups(docs, id_col=id_col, text_col=text_col, carry=True, similarity=SIMILARITY).where(F.col("_row") == F.col("keeper")).select("_carried.*")
