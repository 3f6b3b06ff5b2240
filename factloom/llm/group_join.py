"""N-gram Jaccard join over a token-group matrix.

1. Every text becomes its set of five-word shingles, its tokens; equal sets are one node.
2. Nodes are partitioned into groups of similar ones: a node has ``BANDS`` keys of ``BAND_ROWS``
   minima each and joins the group of the key that most nodes have, or is a group of its own. Groups of more than
   ``GROUP_ROWS`` nodes or ``GROUP_TOKENS`` tokens are split by hash; one node of such a key is a
   guest in all its parts, so that they become linked.
3. Inside a group, sets are compared exactly through the group's postings. Nodes already connected
   with the group's busiest one are not asked again, as a link between them changes no component.
4. The matrix has a cell for each token and group. Of two sets with Jaccard similarity t the larger
   can miss at most a share of 1 - t of its tokens in the other, so both hold one of the first
   n - ceil(t n) + 1 tokens of the other in any order all sets share: only those cells are kept and
   looked up. Frequent tokens come last in that order. The places of the shared ones bound what the
   rest can add.
5. A node asks the groups that hold a looked-up token and a node of a larger component than its own
   (of equal ones the later), so two components are asked about once and parts of one never. First
   one node of a component asks one group of another, that with most tokens shared; then the rest
   ask for members that are in a component other than theirs still.
6. Each set has a bitmap of the parities of its tokens per bucket. Two bitmaps differ in no more bits
   than the sets differ in tokens, so pairs whose bitmaps differ in too many need no look at the sets. Askers and a group's members
   are compared so inside a task.
7. In a task, a group's whole token union bounds each query: fewer than t |Q| of Q's tokens in the
   union and the group stays shut; otherwise it is opened and its members are compared exactly.
   Queries of a group are dealt in chunks.

Frequent tokens are told from a ``SAMPLE`` th of the distinct texts and at most ``MOST_FREQUENT`` of
them are kept; the order decides how many cells are looked up, never which links are found.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; fewer
than five words are one token; rows that repeat an id are nodes by their text and all get a row; null
ids count as larger than any id; an empty table gives an empty result; columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table
from factloom.llm.near_dedup import connected_components, shingle_sets

SIMILARITY_PERCENT = 80
BANDS, BAND_ROWS = 8, 4
GROUP_ROWS, GROUP_TOKENS = 1000, 500_000
QUERY_ROWS, QUERY_TOKENS = 2000, 1_000_000
SAMPLE, SEEN_IN_SAMPLE, MOST_FREQUENT = 16, 3, 1 << 18
#: Wanted nodes up to this number are sent to the scans of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _sets(batches: Iterator[pa.RecordBatch], text: str, rows: int = 128) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, shingle_sets(part.column(text).to_pylist())


def _digest(tokens: np.ndarray) -> bytes | None:
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (ascending) that a sample of the distinct texts holds several times, and how often; bounded by ``MOST_FREQUENT``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    seen = some.mapInArrow(work, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN_IN_SAMPLE)
    top = seen.orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT).toPandas()
    tokens, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def needed(size: int) -> int:
    """Least overlap that a set of this size has with any similar enough one."""
    return (size * SIMILARITY_PERCENT + 99) // 100


def first_tokens(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens of a set of which a similar enough one holds at least one of its own first: rare before frequent, then by hash."""
    count = len(tokens) - needed(len(tokens)) + 1
    if not len(frequent):
        return tokens[:count]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = np.where(frequent[at] == tokens, counts[at], 0)
    return tokens[np.argsort(often, kind="stable")[:count]]  # tokens come sorted by hash


def parities(tokens: np.ndarray) -> bytes:
    """A bit for each bucket of hashes: whether the set has an odd number of tokens in it; about half as many buckets as tokens."""
    power = max(6, int(len(tokens)).bit_length() - 1)
    return np.packbits((np.bincount((tokens >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ, on the scale of the coarser one; at most the tokens in which the sets differ."""
    x, y = (np.unpackbits(np.frombuffer(t, np.uint8)) for t in (a, b))
    if len(x) < len(y):
        x, y = y, x
    return int(((x.reshape(len(y), -1).sum(axis=1) & 1) != y).sum())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), band keys and parities of every row."""
    made = np.random.Generator(np.random.PCG64(20250511)).integers(0, 2**64, size=(2, BANDS * BAND_ROWS), dtype=np.uint64)
    mult, add = made[0] | np.uint64(1), made[1]

    def keys(tokens: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(tokens), 1024):
            np.minimum(least, (tokens[at : at + 1024, None] * mult + add).min(axis=0), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, BAND_ROWS).T:
            key = (key ^ row) * _MIX
            key ^= key >> np.uint64(31)
        return key

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, "text"):
            digests = pa.array([_digest(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), digests, _lists([keys(s) if len(s) else s for s in sets]), pa.array([parities(s) for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "keys", "bits"],
            )

    return docs.mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest binary, keys array<long>, bits binary")


def grouped(nodes: DataFrame) -> DataFrame:
    """(node, n, grp, key, parts) of every node: the group of its most frequent key; parts counts the key's groups."""
    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    best = each.join(often, "key").groupBy("node").agg(F.max(F.struct("often", "key")).alias("best")).select("node", F.col("best.key").alias("key"))
    chosen = nodes.select("node", "n").join(best, "node", "left")
    share = F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int")
    sizes = chosen.filter("key IS NOT NULL").groupBy("key").agg(share.alias("parts"), F.min("node").alias("guest"))
    part = F.pmod(F.xxhash64("node", F.lit(3)), "parts")
    shared = chosen.join(sizes, "key").select("node", "n", F.xxhash64("key", part, F.lit(2)).alias("grp"), "key", "parts", "guest")
    kinds = dict(shared.dtypes)
    alone = [F.lit(None).cast(kinds[c]).alias(c) for c in ("key", "parts", "guest")]
    # Nodes without a shared key, which are most, take no part in the join: they would all meet under null.
    return shared.unionByName(chosen.filter("key IS NULL").select("node", "n", F.xxhash64("node", F.lit(1)).alias("grp"), *alone))


def members_with_guests(groups: DataFrame) -> DataFrame:
    """(grp, node) of all nodes, and of the guest of every key that has several parts in each of them."""
    own = groups.select("grp", "node")
    parts = groups.filter("parts > 1").select("key", "guest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    guests = parts.select(F.xxhash64("key", F.col("part").cast("long"), F.lit(2)).alias("grp"), F.col("guest").alias("node"))
    return own.unionByName(guests).distinct()


def sets_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(grp, chunk, node, comp, tokens) of the wanted places of nodes, made again from the whole text of a row of theirs.

    wanted: node, doc_id, digest, comp, places (array of grp and chunk). A set is made once and copied to its
    places; it is nowhere stored. Rows that repeat an id and a text give a set again, which does no harm.
    """
    place = "array<struct<grp:long,chunk:int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, "text"):
            same = pa.array([_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "comp", "places")), _lists(sets)], names=["node", "comp", "places", "tokens"]).filter(same)

    side = wanted.select("node", F.col("doc_id").alias("__id"), "digest", "comp", F.col("places").cast(place).alias("places"))
    side = F.broadcast(side) if wanted.count() <= BROADCAST_ROWS else side
    texts = docs.join(side, docs["doc_id"].eqNullSafe(F.col("__id"))).select("node", "digest", "comp", "places", "text")
    made = texts.mapInArrow(work, f"node long, comp long, places {place}, tokens array<long>")
    return made.select("node", "comp", "tokens", F.explode("places").alias("p")).select("p.grp", "p.chunk", "node", "comp", "tokens")


def placed_at(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Wanted nodes of ``sets_at`` from (node, grp, chunk); names: node, doc_id, digest, comp."""
    listed = rows.groupBy("node").agg(F.collect_set(F.struct("grp", "chunk")).alias("places"))
    return materialise(listed.join(names, "node"), "groups-wanted")


class Postings:
    """Which rows of a group hold a token."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.starts, self.held = np.unique(flat[order], return_index=True, return_counts=True)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the tokens that the union holds."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        return at[self.union[at] == tokens]

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        """Shared tokens with every row, for tokens at these places of the union."""
        held = self.held[at]
        jumps = np.repeat(self.starts[at] - np.concatenate(([0], np.cumsum(held)[:-1])), held) if len(at) else np.zeros(0, np.int64)
        return np.bincount(self.owners[jumps + np.arange(held.sum())], minlength=len(self.sizes))

    def similar(self, size: int, shared: np.ndarray) -> np.ndarray:
        return np.flatnonzero(100 * shared >= SIMILARITY_PERCENT * (size + self.sizes - shared))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    values, ends = flat.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(flat).to_numpy())
    return np.split(values, ends[:-1])


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def links_inside(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is similar within each group; members: grp, node, tokens."""

    def work(group):
        nodes, sets = group.column("node").to_pylist(), _arrays(group.column("tokens"))
        if len(nodes) < 2:
            return _links([])
        index = Postings(sets)
        places = [index.find(s) for s in sets]
        busy = np.array([index.held[p].sum() / len(p) for p in places])
        roots, links = np.arange(len(nodes)), []
        lead = int(busy.argmax())
        for x in [lead, *(i for i in range(len(nodes)) if i != lead)]:
            if x != lead and roots[x] == roots[lead]:
                continue
            for y in index.similar(len(sets[x]), index.overlaps(places[x])):
                if roots[y] != roots[x]:
                    if nodes[x] != nodes[y]:
                        links.append((nodes[x], nodes[y]))
                    roots[roots == roots[y]] = roots[x]
        return _links(links)

    return members.groupBy("grp").applyInArrow(work, "a long, b long")


def cells_of(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, doc_id, at) of the first tokens of every row; at is the token's place in the order all sets share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, "text"):
            first = [first_tokens(s, frequent, counts) if len(s) else s for s in sets]
            owner = pa.array(np.repeat(np.arange(len(first)), [len(f) for f in first]))
            places = np.concatenate([np.arange(len(f), dtype=np.int32) for f in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), part.column("doc_id").take(owner), pa.array(places)], names=["token", "doc_id", "at"])

    return docs.mapInArrow(work, f"token long, doc_id {dict(docs.dtypes)['doc_id']}, at int")


def candidates(cells: DataFrame, places: DataFrame) -> DataFrame:
    """(node, grp) to look into: groups of larger components whose looked-up tokens leave room for enough overlap.

    places: doc_id, node, n, grp, members (of the group), rank (size and name of the node's component),
    top (the greatest rank of its group). With a set of m tokens an overlap of p (n + m) / (100 + p) is
    needed. Of a group of one, all shared tokens after the last shared one of the first tokens come
    after it in both sets; in larger groups, all others come after the end of one set's first tokens.
    """
    held = cells.withColumn("held", F.count("*").over(W.partitionBy("token"))).filter("held > 1").drop("held")
    known = held.join(places.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id"))).drop("doc_id", "__id")
    of_token = W.partitionBy("token")
    known = known.withColumn("most", F.max("rank").over(of_token)).withColumn("least", F.min("rank").over(of_token)).filter("most != least")
    known = materialise(known, "groups-cells")
    asking = known.filter("rank < most").select("token", "node", "n", "at", "rank").distinct()
    matrix = known.filter("rank > least").groupBy("token", "grp").agg(
        F.max("top").alias("top"), F.max("members").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at") - 1).alias("rest")
    )
    fits = (F.col("n") * 100 >= F.col("low") * SIMILARITY_PERCENT) & (F.col("n") * SIMILARITY_PERCENT <= F.col("high") * 100)
    met = asking.join(matrix, "token").filter(fits & (F.col("rank") < F.col("top")))
    pairs = met.groupBy("node", "grp").agg(
        F.count("*").alias("shared"), F.max(F.struct("at", "rest")).alias("last"), F.first("n").alias("n"), F.first("members").alias("members"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    after = lambda n: F.floor((n * SIMILARITY_PERCENT + 99) / 100) - 1
    more = F.when(F.col("members") == 1, F.least(F.col("n") - F.col("last.at") - 1, F.col("last.rest"))).otherwise(F.greatest(after(F.col("n")), after(F.col("high"))))
    enough = (F.col("shared") + more) * (100 + SIMILARITY_PERCENT) >= (F.col("n") + F.col("low")) * SIMILARITY_PERCENT
    return pairs.filter(enough).select("node", "grp", "shared")


class Bitmaps:
    """Parity bitmaps of a group's sets: by their length in bytes, and folded to the length of the one that asks."""

    def __init__(self, bits: list[bytes]):
        lengths = np.array([len(b) for b in bits], np.int64)
        rows = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
        self.levels = {n: (at, np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(-1, n)) for n, at in rows.items()}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def fold(bits: np.ndarray, length: int) -> np.ndarray:
        """Bitmaps on a coarser scale: a bucket's parity is that of the buckets it is made of."""
        return np.packbits(np.unpackbits(bits, axis=1).reshape(len(bits), 8 * length, -1).sum(axis=2).astype(np.uint8) & 1, axis=1)

    def near(self, bits: bytes, most: np.ndarray) -> bool:
        """Whether a set differs from this one in at most ``most`` (of every set, negative: not asked) bits."""
        own = np.frombuffer(bits, np.uint8)[None]
        for length, (at, held) in self.levels.items():
            at, few = at[most[at] >= 0], held[most[at] >= 0]
            if not len(at):
                continue
            if length > len(bits):
                if (length, len(bits)) not in self.folded:
                    self.folded[length, len(bits)] = self.fold(held, len(bits))
                few = self.folded[length, len(bits)][most[self.levels[length][0]] >= 0]
            asked = self.fold(own, length) if length < len(bits) else own
            if (np.bitwise_count(few ^ asked).sum(axis=1, dtype=np.int64) <= most[at]).any():
                return True
        return False


def near_enough(pairs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (node, grp, n) whose group has a member of another component that the sizes and parities leave possible.

    members: grp, node; nodes: node, n, bits, comp. Askers are dealt in chunks of a group and meet its
    members as bitmaps inside a task: what is no link of any asker is never a row.
    """

    def work(asking, group):
        if not asking.num_rows or not group.num_rows:
            return asking.select(["node", "grp", "n"]).slice(0, 0)
        m, comps, held = group.column("n").to_numpy(), group.column("comp").to_numpy(), Bitmaps(group.column("bits").to_pylist())
        kept = []
        for n, comp, bits in zip(*(asking.column(c).to_pylist() for c in ("n", "comp", "bits")), strict=True):
            fits = (np.minimum(n, m) * 100 >= np.maximum(n, m) * SIMILARITY_PERCENT) & (comps != comp)
            most = n + m - 2 * -(-(n + m) * SIMILARITY_PERCENT // (100 + SIMILARITY_PERCENT))
            kept.append(held.near(bits, np.where(fits, most, -1)))
        return asking.select(["node", "grp", "n"]).filter(pa.array(kept, pa.bool_()))

    known = nodes.select("node", "n", "bits", "comp")
    sizes = pairs.groupBy("grp").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    asked = pairs.select("node", "grp").join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), "chunks").cast("int")).join(known, "node")
    opened = members.join(sizes, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(known, "node")
    side = lambda rows: rows.select(*[F.col(c).alias(c) for c in ("grp", "chunk", "node", "n", "bits", "comp")]).groupBy("grp", "chunk")
    return side(asked).cogroup(side(opened)).applyInArrow(work, "node long, grp long, n long")


def links_across(docs: DataFrame, pairs: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """Links (a, b) of nodes with members of the groups they ask; pairs: node, grp, n; members: grp, node; names: node, doc_id, digest, comp."""
    share = F.greatest(F.ceil(F.count("*") / QUERY_ROWS), F.ceil(F.sum("n") / QUERY_TOKENS)).cast("int")
    sizes = materialise(pairs.groupBy("grp").agg(share.alias("chunks")), "groups-chunks")
    asked = pairs.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), "chunks").cast("int")).select("node", "grp", "chunk")
    opened = members.join(sizes, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", "grp", "chunk")
    queries, held = sets_at(docs, placed_at(asked, names)), sets_at(docs, placed_at(opened, names))

    def work(queries, group):
        if not queries.num_rows or not group.num_rows:
            return _links([])
        nodes, index = group.column("node").to_pylist(), Postings(_arrays(group.column("tokens")))
        components, links = group.column("comp").to_numpy(), []
        for node, tokens in zip(queries.column("node").to_pylist(), _arrays(queries.column("tokens")), strict=True):
            at = index.find(tokens)
            if 100 * len(at) < SIMILARITY_PERCENT * len(tokens):
                continue  # the union's bound
            found = index.similar(len(tokens), index.overlaps(at))
            for y in found[np.unique(components[found], return_index=True)[1]]:
                if nodes[y] != node:
                    links.append((node, nodes[y]))
        return _links(links)

    return queries.groupBy("grp", "chunk").cogroup(held.groupBy("grp", "chunk")).applyInArrow(work, "a long, b long")


def jaccard_components(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    rows = materialise(sketches(docs), "groups-rows")
    nodes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "groups-nodes")
    groups = materialise(grouped(nodes), "groups-groups")

    members = members_with_guests(groups.filter("key IS NOT NULL")).withColumn("chunk", F.lit(0))
    names = nodes.select("node", "doc_id", "digest")
    links = materialise(links_inside(sets_at(docs, placed_at(members, names.withColumn("comp", F.col("node"))))), "groups-links")

    comps = _components(groups, links)
    ranked = comps.join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("node", "comp", F.struct("size", "comp").alias("rank"))
    placed = groups.select("node", "n", "grp").join(ranked, "node")
    placed = placed.join(placed.groupBy("grp").agg(F.max("rank").alias("top"), F.count("*").alias("members")), "grp")
    placed = materialise(placed, "groups-placed")
    where = rows.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").drop("digest").distinct().join(placed.drop("comp"), "node")
    asking = materialise(candidates(cells_of(docs, *frequent_tokens(docs)), materialise(where, "groups-where")), "groups-asking")
    tops = placed.select("grp", F.col("top.comp").alias("other")).distinct()
    best = F.max(F.struct("shared", "node", "grp")).alias("best")
    first = asking.join(placed.select("node", "comp"), "node").join(tops, "grp").groupBy("comp", "other").agg(best).select("best.node", "best.grp")
    first = materialise(first, "groups-first")
    for pairs in (first, asking.join(first, ["node", "grp"], "left_anti")):
        found = _asked(docs, pairs, placed.select("grp", "node"), nodes, comps)
        if found is not None:
            links = links.unionByName(found)
            comps = _components(groups, links)

    named = comps.join(nodes.select("node", "digest", "doc_id"), "node")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    component = named.join(least, "comp").select("digest", "component_id")
    found = rows.select("doc_id", "n_shingles", "digest").join(component, "digest", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _asked(docs: DataFrame, pairs: DataFrame, members: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Links that the pairs (node, grp) lead to, written out; None without any pair worth a look."""
    known = nodes.select("node", "doc_id", "digest", "n", "bits").join(comps, "node")
    opened = members.join(pairs.select("grp").distinct(), "grp", "left_semi")
    near = materialise(near_enough(pairs, opened, known.select("node", "n", "bits", "comp")), "groups-pairs")
    if near.isEmpty():
        return None
    opened = members.join(near.select("grp").distinct(), "grp", "left_semi")
    return materialise(links_across(docs, near, opened, known.select("node", "doc_id", "digest", "comp")), "groups-links")


def _components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) of every node, written out."""
    found = connected_components(links, "groups-stars")
    return materialise(groups.select("node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "groups-comps")


def op11_group_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def components_sql(percent: int) -> str:
    """DuckDB SQL of documents linked at a similarity over five-word shingles, each with its least reachable id."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 e AS (SELECT doc_id, unnest(s) AS t FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
 o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= {percent} * (a.n + b.n - o)),
 d AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT d.y AS doc_id, r.root FROM r JOIN d ON d.x = r.doc_id),
 c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)"""


OP11_SQL = components_sql(SIMILARITY_PERCENT) + " SELECT doc_id, n AS n_shingles, component_id FROM n JOIN c USING (doc_id)"
OP7_SQL = components_sql(75) + " SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"
