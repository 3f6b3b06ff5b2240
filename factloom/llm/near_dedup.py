"""MinHash near-duplicate detection by a multi-index Hamming join.

1. Every text becomes its set of five-word shingles; equal sets collapse into one node.
2. A node's signature has ``HASHES`` minima cut to 16 bits. The first ``CHUNKS * CHUNK_SYMBOLS`` of
   them are split into chunks. Two signatures that differ in at most
   ``CHUNKS * (CHUNK_ERRORS + 1) - 1`` of these symbols agree, by the pigeonhole principle, in some
   chunk but for ``CHUNK_ERRORS`` symbols; every chunk is therefore indexed once for each choice of
   symbols to ignore, and such a pair is certain to share a key.
3. Each bucket first compares all its members with one of them only, the one that shares most keys
   with others (a star, not all pairs). Pairs within the guaranteed distance over the indexed
   symbols, and those within ``MAX_DISTANCE`` over the whole signature besides, are confirmed on the
   full sets, and links give components. Most of a large group of near copies
   falls into one component here, at linear cost.
4. Members of a bucket that are still in different components are then compared with each other, in
   blocks of bounded size, by signature and, where that passes, on the full sets, each pair under
   its first shared key only. Pairs inside a component can't change it, so no link that joins two
   components is missed, and only such links leave a task.
5. Components come from alternating stars over the links, in tables, never on the driver.

A pair of similarity 0.75 differs in 12 of 48 indexed symbols on average; more than 23, the bound of
the guarantee, has a chance below 3e-4, and even then a shared key is likely: the chance of none is
0.262 ** 12, about 1e-7. More than ``MAX_DISTANCE`` of 128 has a chance below 1e-6.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; fewer
than five words form one shingle; equal texts are linked; rows that repeat an id are nodes by their
text and all get a row; null ids count as larger than any id; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
HASHES = 128
CHUNKS = 12
CHUNK_SYMBOLS = 4
CHUNK_ERRORS = 1
MAX_DISTANCE = 58
#: Every pair that differs in at most so many indexed symbols shares a key.
GUARANTEED = CHUNKS * (CHUNK_ERRORS + 1) - 1
BLOCK_ROWS = 1500
BLOCK_SHINGLES = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    split = [(t or "").encode("utf-8").lower().split() for t in texts]  # bytes.lower and split know ASCII only
    sizes = [len(w) for w in split]
    words = [w for s in split for w in s]
    if not words:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    hashed = pd.util.hash_array(flat, categorize=False)
    rolled = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled = rolled * _MIX + hashed[i : i + len(rolled)]
    rolled = _finish(rolled)
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            whole = np.uint64(n)
            for h in hashed[at : at + n]:
                whole = np.uint64((int(whole) * int(_MIX) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_finish(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, size=(2, HASHES), dtype=np.uint64)
    return made[0] | np.uint64(1), made[1]


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum under each hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256, None] * mult + add
        np.minimum(least, part.min(axis=0), out=least)
    return _finish(least).astype(np.uint16)


def _batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if empty) and signature of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _coefficients()
        for batch in (part for whole in batches for part in _batches(whole)):
            sets = shingle_sets(batch.column(1).to_pylist())
            nodes = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signs = [signature(s, mult, add).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "node", "sig"],
            )

    return docs.select("doc_id", text).mapInArrow(work, f"doc_id {kind}, n_shingles long, node binary, sig binary")


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): one key for every chunk and every choice of symbols to ignore in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(combinations(range(CHUNK_SYMBOLS), CHUNK_SYMBOLS - CHUNK_ERRORS))
        for batch in (part for whole in batches for part in _batches(whole, 2048)):
            if not batch.num_rows:
                continue
            signs = _matrix(batch.column(1))[:, : CHUNKS * CHUNK_SYMBOLS].reshape(batch.num_rows, CHUNKS, CHUNK_SYMBOLS).astype(np.uint64)
            keys = np.empty((batch.num_rows, CHUNKS, len(kept)), dtype=np.uint64)
            for m, symbols in enumerate(kept):
                key = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(len(kept)) + np.uint64(m)
                for s in symbols:
                    key = (key << np.uint64(16)) | signs[:, :, s]
                keys[:, :, m] = key
            n = CHUNKS * len(kept)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(owner)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(work, "key long, node binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), HASHES)


def _close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing symbols of each row of signatures, and whether they are few enough to look at the sets."""
    differ = a != b
    apart = differ.sum(axis=1)
    return apart, (differ[:, : CHUNKS * CHUNK_SYMBOLS].sum(axis=1) <= GUARANTEED) | (apart <= MAX_DISTANCE)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of close signatures whose set sizes allow the similarity asked for."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _batches(whole, 4096)):
            if batch.num_rows:
                yield batch.filter(pa.array(_close(_matrix(batch.column(2)), _matrix(batch.column(3)))[1])).select(["a", "b"])

    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILARITY_PERCENT
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(work, "a binary, b binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(node, shingles) recomputed from the whole text of each wanted node's first row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _batches(whole)):
            sets = shingle_sets(batch.column(1).to_pylist())
            nodes = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            arrays = [s.view(np.int64) for s in sets]
            ends = np.zeros(len(arrays) + 1, dtype=np.int32)
            np.cumsum([len(a) for a in arrays], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), lists], names=["want", "node", "shingles"])

    texts = docs.select("doc_id", F.col(text).alias("text")).join(wanted, "doc_id").select(F.col("node").alias("want"), "text")
    found = texts.mapInArrow(work, "want binary, node binary, shingles array<long>").filter("want = node")
    return found.select("node", "shingles").dropDuplicates(["node"])  # an id may repeat with the same text


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b): pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    linked = both * 100 >= (F.size("s_a") + F.size("s_b") - both) * SIMILARITY_PERCENT
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(linked).select("a", "b")


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of every node with a link; comp is the least node of its component.

    Large-star and small-star turns until the links no longer change; each turn is written out.
    """
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    links = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) < len(b):
        a, b = b, a
    at = np.minimum(a.searchsorted(b), len(a) - 1)
    return int((a[at] == b).sum())


def _cross_links(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (a, b) between rows of one bucket but different components, block against block.

    members: key, node, comp, sig, shingles; sizes: key, blocks. A row meets each block of its bucket
    once, in a task that holds two blocks at most. A pair that shares several keys is compared under
    its first key only, and one whose components a link of the task has joined is not compared any
    more, so a task returns fewer links than it has rows.
    """
    dealt = members.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.select(
        "key", "node", "comp", "sig", "shingles", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tag = int(pdf["key"].iloc[0]) >> (16 * (CHUNK_SYMBOLS - CHUNK_ERRORS))
        chunk, mask = divmod(tag, comb(CHUNK_SYMBOLS, CHUNK_ERRORS))
        signs = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), HASHES)
        indexed = signs[:, : CHUNKS * CHUNK_SYMBOLS]
        roots, block = pd.factorize(pdf["comp"])[0], pdf["mine"].to_numpy()
        sets, nodes, single = pdf["shingles"].to_list(), pdf["node"].to_list(), pdf["i"].iloc[0] == pdf["j"].iloc[0]
        sizes = np.array([len(s) for s in sets])
        # Rows of the most frequent component can't meet each other; the rest meet every row.
        lead = roots == np.bincount(roots).argmax()
        links = []
        for x in np.flatnonzero(~lead):
            rows = (roots != roots[x]) & (np.minimum(sizes, sizes[x]) * 100 >= np.maximum(sizes, sizes[x]) * SIMILARITY_PERCENT)
            if not single:
                rows &= block != block[x]
            rows[: x + 1] &= lead[: x + 1]
            at = np.flatnonzero(rows)
            agree = (indexed[at] == indexed[x]).reshape(len(at), CHUNKS, CHUNK_SYMBOLS).sum(axis=2)
            first = (agree >= CHUNK_SYMBOLS - CHUNK_ERRORS).argmax(axis=1) == chunk
            at = at[first & ((agree[:, chunk] == CHUNK_SYMBOLS - CHUNK_ERRORS) | (mask == 0))] if len(at) else at
            apart, near = _close(signs[at], signs[x])
            for y in at[near][np.argsort(apart[near], kind="stable")]:
                if roots[x] != roots[y]:
                    both = _overlap(sets[x], sets[y])
                    if both * 100 >= (sizes[x] + sizes[y] - both) * SIMILARITY_PERCENT:
                        links.append((nodes[x], nodes[y]))
                        roots[roots == roots[y]] = roots[x]
        return pd.DataFrame(links, columns=["a", "b"])

    return tasks.groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    rows = materialise(signatures(docs, text), "dedup-signatures")
    nodes = materialise(
        rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")),
        "dedup-nodes",
    )
    keys = index_keys(nodes)
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialise(buckets, "dedup-buckets")
    shared = materialise(keys.join(buckets.filter("n > 2").select("key", "n"), "key"), "dedup-members")
    # The centre of a group of copies shares more keys than its copies do with each other.
    busy = shared.groupBy("node").agg(F.sum("n").alias("busy"))
    pivots = shared.join(busy, "node").groupBy("key").agg(F.max(F.struct("busy", "node")).alias("top")).select("key", F.col("top.node").alias("pivot"))
    spokes = shared.join(pivots, "key").filter("node != pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    star = buckets.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(spokes).distinct()
    star = materialise(_near(star, nodes), "dedup-star")

    used = shared.select("node").unionByName(star.select(F.col("a").alias("node"))).unionByName(star.select(F.col("b").alias("node"))).distinct()
    sets = materialise(_sets_of(docs, nodes.select("node", "doc_id").join(used, "node", "left_semi"), text), "dedup-sets")
    links = materialise(_confirm(star, sets), "dedup-links")
    comps = materialise(connected_components(links, "dedup-stars"), "dedup-comps")
    placed = shared.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = placed.join(nodes.select("node", "sig", "n_shingles"), "node")
    mixed = placed.groupBy("key").agg(
        F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n"), F.sum("n_shingles").alias("held")
    ).filter("c1 != c2")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("held") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    mixed = materialise(mixed.select("key", blocks.alias("blocks")), "dedup-mixed")
    members = placed.drop("n_shingles").join(mixed.select("key"), "key").join(sets, "node")
    cross = materialise(_cross_links(members, mixed), "dedup-cross")
    if not cross.isEmpty():
        comps = materialise(connected_components(links.unionByName(cross), "dedup-stars"), "dedup-comps")
    named = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    component = named.join(least, "comp").select("node", "component_id")
    found = rows.select("doc_id", "n_shingles", "node").join(component, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", "n_shingles", component_id.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
