"""One query per operator over its whole table, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, html_text, packing, pieces, pii, prefix_trie, sharding, simhash, suffix_tree, topk, toxicity, vector_codes, warc


def tokenizer_file(name: str) -> str:
    """The folder of the tokenizers is a parameter: TOKENIZERS_DIR, or where the public package has them."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", "hops")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents`, encoded whole and decoded again."""
    return pieces_of(table(spark, sf_dir, "documents"), "doc_id")


def op5_sentencepiece_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every turn of `conversations`."""
    return pieces_of(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def pieces_of(rows: DataFrame, *keys: str) -> DataFrame:
    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    coded = pieces.encode(rows, model, keep=keys, stored=True, check=True)
    return coded.select(*keys, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=2, lanes=1, wide_radius=None)
    return found.select("doc_id", simhash.unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability per category, and toxic: whether the document is rejected."""
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    named = [F.col("_p")[k].alias(f"p_{name}") for k, (name, _, _) in enumerate(toxicity.CHAIN)]
    toxic = F.element_at("_p", -1) >= toxicity.THRESHOLD
    return scored.select("doc_id", *named, toxic.alias("toxic"), (~toxic).alias("kept"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.branched(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    nodes = prefix_trie.trie(turns, convs)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ring_sharding, op3_html_main_text, op4_pii_weak_supervision, op5_sentencepiece, op5_sentencepiece_turns, op6_warc_index, op7_exact_dedup, op8_exact_top_k, op9_simhash, op10_toxicity_chain, op11_prefix_trie, op12_suffix_tree, op13_vector_codes)}



def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text, byte by byte and bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ord(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295)"


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of training, written out one after the other."""
    width = f"(dim // {parts})"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, len(embedding) AS dim FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS MATERIALIZED (SELECT vec_id, (j - 1) // {width} AS p, (j - 1) % {width} AS i, q[j] AS x FROM (SELECT vec_id, q, dim, unnest(range(1, dim + 1)) AS j FROM v)),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM v) USING (vec_id) WHERE r <= {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT c.vec_id, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS far FROM c JOIN b{k} b USING (p, i) GROUP BY ALL)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, far * 256 + e) AS e, min(far) AS far FROM d{k} GROUP BY ALL)")
        steps.append(f"m{k} AS (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM c JOIN a{k} USING (vec_id, p) GROUP BY ALL)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, i, CASE WHEN m.n IS NULL THEN b.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e, i))")
    return f"""WITH {", ".join(steps)},
        f AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} JOIN v USING (vec_id) GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256 FROM f"""


ORACLE_SQL = {
    "op6_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY 1, 2)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN g.n > 1 AND d.page_id <> g.first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.n > 1 AND d.page_id <> g.first THEN g.first END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest, payload_bytes)""",
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY n)""",
    "op8_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
    "op11_prefix_trie": f"""
        WITH c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS a FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h, a FROM c),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.a[1:h.h], []), h.a[h.h + 1:]) AS a FROM h LEFT JOIN c b ON b.conv_id = h.base),
        p AS (SELECT conv_id, d, a[1:d] AS k, d = len(a) AS e FROM (SELECT conv_id, a, unnest(range(0, len(a) + 1)) AS d FROM r)),
        n AS (SELECT d, k, k[1:d - 1] AS up, count(*) AS n, min(conv_id) AS conv_id, CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].t) END AS bytes,
                     coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends FROM p GROUP BY d, k),
        kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
        f AS (SELECT n.*, coalesce(kids.n, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
        s AS (SELECT j AS d, k[1:j] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) GROUP BY ALL)
        SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN s USING (d, k) LEFT JOIN n u ON f.d > 0 AND u.d = f.d - 1 AND u.k = f.up""",
    "op13_vector_codes": vector_codes_sql(),
}
