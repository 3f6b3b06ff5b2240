"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only near edits.

The tokenizer's pattern splits a text into pre-tokens from left to right; the ids of a text are the
ids of its pre-tokens in turn. A document's pre-tokens lie in leaves of at most ``2 * LEAF``; a
binary tree over the leaves holds sums of characters and of tokens. Trees are kept as columns beside
the text: lengths and counts of pre-tokens, and sums of leaves. A later edit starts from those,
unpacks only the leaves it touches and counts nothing else anew. An edit finds its place by
character sums, goes back to the last pre-token that could not see the edited text (matching looks
less than ``CONTEXT`` characters past what it takes), splits from there until it meets an old
boundary behind the edit, and re-encodes only what lies between; sums are then updated along the
paths to the root, or, where a leaf has outgrown its size and is split, over the leaves' sums. From a boundary on, splitting depends on nothing before it, so what follows stays.

Workers keep the counts of pre-tokens they have met, at most ``CACHE_PIECES``, then start afresh.

Defined cases: a null text counts as empty; positions beyond the text's end count as its end, and an
edit whose end lies before its start inserts at its start; null edits, and edits with a null
position, change nothing; null replacement text deletes; repeated rows get repeated results; an
empty table gives an empty result; only id, text and edits are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, table

LEAF = 128
CONTEXT = 4
CACHE_PIECES = 400_000
#: The split pattern of the vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceCounter:
    """Number of ids of single pre-tokens, for one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN, cache_pieces: int = CACHE_PIECES):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern).findall
        self.match = regex.compile(pattern).match
        self.known: dict[str, int] = {}
        self.cache_pieces = cache_pieces

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            new = {p for p in pieces if p not in known}
        if len(known) + len(new) > self.cache_pieces:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = len(self.encoding.encode_ordinary(p))  # a pre-token by itself is one pre-token
        return [known[p] for p in pieces]


class CountTree:
    """One document's pre-tokens with sums of characters and tokens over them."""

    def __init__(self, text: str, counter: PieceCounter):
        pieces = counter.pieces(text)
        sizes, counts = list(map(len, pieces)), counter.counts(pieces)
        self._start(text, counter, [[sizes[i : i + LEAF], counts[i : i + LEAF]] for i in range(0, len(sizes), LEAF)] or [[[], []]])
        self.sums = [(sum(a), sum(b)) for a, b in self.leaves]
        self._plant()

    @classmethod
    def kept(cls, text: str, sizes: np.ndarray, counts: np.ndarray, ends: np.ndarray, chars: np.ndarray, tokens: np.ndarray, counter: PieceCounter) -> CountTree:
        """A tree as it was kept: its leaves stay packed until an edit touches them."""
        tree = cls.__new__(cls)
        starts = [0, *ends[:-1].tolist()]
        tree._start(text, counter, list(zip(starts, ends.tolist(), strict=True)))
        tree.packed = (sizes, counts)
        tree.sums = list(zip(chars.tolist(), tokens.tolist(), strict=True))
        tree._plant()
        return tree

    def _start(self, text: str, counter: PieceCounter, leaves: list) -> None:
        self.text, self.counter, self.encoded, self.leaves = text, counter, 0, leaves

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and counts of all pre-tokens, ends of the leaves among them, and the leaves' characters and tokens."""
        held = [[self.packed[k][x[0] : x[1]] if isinstance(x, tuple) else np.array(x[k], dtype=np.int32) for x in self.leaves] for k in (0, 1)]
        ends = np.cumsum([len(x) for x in held[0]])
        sums = np.array(self.sums, dtype=np.int32).reshape(-1, 2)
        return np.concatenate(held[0]), np.concatenate(held[1]), ends, sums[:, 0], sums[:, 1]

    def _leaf(self, i: int) -> list[list[int]]:
        """Lengths and counts of one leaf's pre-tokens."""
        leaf = self.leaves[i]
        if isinstance(leaf, tuple):
            leaf = self.leaves[i] = [part[leaf[0] : leaf[1]].tolist() for part in self.packed]
        return leaf

    def _plant(self) -> None:
        """Build the sums over all leaves; node i has children 2 i and 2 i + 1, leaves start at ``base``."""
        self.base = 1 << max(len(self.leaves) - 1, 0).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (chars, tokens) in enumerate(self.sums):
            self.chars[self.base + i], self.tokens[self.base + i] = chars, tokens
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def pre_tokens(self) -> int:
        return sum(leaf[1] - leaf[0] if isinstance(leaf, tuple) else len(leaf[0]) for leaf in self.leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at`` (the last one at the end), and where it starts."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.base, len(self.leaves) - 1), before

    def _sum_up(self, leaf: int) -> None:
        node = self.base + leaf
        self.sums[leaf] = self.chars[node], self.tokens[node] = tuple(map(sum, self._leaf(leaf)))
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace text[start:end]; positions count in the text as it is now."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        first, at = self._leaf_at(max(start - CONTEXT, 0))
        sizes = self._leaf(first)[0]
        keep = 0
        while keep < len(sizes) and at + sizes[keep] <= start - CONTEXT:
            at += sizes[keep]
            keep += 1
        self.text = self.text[:start] + replacement + self.text[end:]
        moved, edited = len(replacement) - (end - start), start + len(replacement)
        # Old boundaries behind the edit, in the new text's positions, leaf after leaf.
        leaf, index, old = first, keep, at
        position, fresh = at, []
        while True:
            while leaf < len(self.leaves) and (old < end or old + moved < position):
                if index >= len(self._leaf(leaf)[0]):
                    leaf, index = leaf + 1, 0
                    continue
                old += self._leaf(leaf)[0][index]
                index += 1
            if position >= edited and (old + moved == position and old >= end) or position >= len(self.text):
                break
            found = self.counter.match(self.text, position)
            fresh.append(found[0])
            position = found.end()
        if position >= len(self.text) and old + moved != position:
            leaf, index = len(self.leaves), 0
        self._replace(first, keep, leaf, index, fresh)

    def _replace(self, first: int, keep: int, last: int, index: int, fresh: list[str]) -> None:
        """Put fresh pre-tokens between (first, keep) and (last, index)."""
        counts = self.counter.counts(fresh)
        self.encoded += len(fresh)
        rest, begun = self._leaf(last) if last < len(self.leaves) else [[], []], self._leaf(first)
        sizes = begun[0][:keep] + list(map(len, fresh)) + rest[0][index:]
        tokens = begun[1][:keep] + counts + rest[1][index:]
        if last <= first + 1 and len(sizes) <= 2 * LEAF:
            self.leaves[first] = [sizes, tokens]
            if last == first + 1 and last < len(self.leaves):
                self.leaves[last] = [[], []]
                self._sum_up(last)
            self._sum_up(first)
        else:
            parts = [[sizes[i : i + LEAF], tokens[i : i + LEAF]] for i in range(0, len(sizes), LEAF)] or [[[], []]]
            self.leaves[first : last + 1] = parts
            self.sums[first : last + 1] = [(sum(a), sum(b)) for a, b in parts]
            self._plant()


_TREE = "sizes array<int>, counts array<int>, leaf_ends array<int>, leaf_chars array<int>, leaf_tokens array<int>"
_COLUMNS = ("sizes", "counts", "leaf_ends", "leaf_chars", "leaf_tokens")


def _packed(trees: list[CountTree]) -> list[pa.Array]:
    """The trees' states as list columns."""
    states = [tree.state() for tree in trees]
    columns = []
    for k in range(len(_COLUMNS)):
        ends = np.zeros(len(states) + 1, dtype=np.int32)
        np.cumsum([len(x[k]) for x in states], out=ends[1:])
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *[x[k] for x in states]]).astype(np.int32))))
    return columns


def _unpacked(part: pa.RecordBatch, first: int, counter: PieceCounter) -> list[CountTree]:
    """The trees of a batch whose columns from ``first`` on are text and state."""
    lists = []
    for k in range(len(_COLUMNS)):
        column = part.column(first + 1 + k)
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        lists.append([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return [CountTree.kept(text or "", *state, counter) for text, *state in zip(part.column(first).to_pylist(), *lists, strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def build_trees(docs: DataFrame, *, ranks: str, text: str = "text") -> DataFrame:
    """doc_id, text, n_tokens, n_pretokens and the tree's columns of every row: what later edits start from."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks)
        for part in _slices(batches):
            trees = [CountTree(body or "", counter) for body in part.column(1).to_pylist()]
            numbers = [pa.array([t.total() for t in trees], pa.int64()), pa.array([t.pre_tokens() for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, *_packed(trees)], names=["doc_id", "text", "n_tokens", "n_pretokens", *_COLUMNS])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, text string, n_tokens long, n_pretokens long, {_TREE}")


def edit_trees(trees: DataFrame, edits: Column, *, ranks: str) -> DataFrame:
    """The same rows with text and tree after the edits, the token counts before and after, and n_reencoded.

    ``edits`` is an array of (start, stop, text), applied in order, each to the text that the ones
    before it left.
    """
    kind = dict(trees.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks)
        for part in _slices(batches):
            found = _unpacked(part, 3, counter)
            for tree, changes in zip(found, part.column(1).to_pylist(), strict=True):
                for e in changes or ():
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        tree.edit(e["start"], e["stop"], e["text"] or "")
            numbers = [pa.array(c, pa.int64()) for c in ([t.total() for t in found], [t.pre_tokens() for t in found], [t.encoded for t in found])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([t.text for t in found], pa.string()), part.column(2), *numbers, *_packed(found)],
                names=["doc_id", "text", "n_tokens", "n_edited_tokens", "n_pretokens", "n_reencoded", *_COLUMNS],
            )

    schema = f"doc_id {kind}, text string, n_tokens long, n_edited_tokens long, n_pretokens long, n_reencoded long, {_TREE}"
    return trees.select("doc_id", edits.alias("edits"), "n_tokens", "text", *_COLUMNS).mapInArrow(work, schema)


def revision(text: Column, key: Column) -> Column:
    """Three edits at places that a hash of the id picks: an insertion, a deletion, a replacement."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    place = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), (size + 1).cast("long")).cast("int")
    edit = lambda start, length, new: F.struct(start.alias("start"), (start + length).alias("stop"), F.lit(new).alias("text"))
    return F.array(edit(place(1), 0, " (revised 2nd edition)"), edit(place(2), 9, ""), edit(place(3), 5, "Zürich's 42"))


def op4_edit_counts(spark, sf_dir: str) -> DataFrame:
    """Keeps the trees of all documents in a table, then edits them from there."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = materialise(build_trees(table(spark, sf_dir, "documents"), ranks=ranks), "count-trees")
    return edit_trees(kept, revision(F.col("text"), F.col("doc_id")), ranks=ranks).select("doc_id", "n_tokens", "n_edited_tokens", "n_pretokens", "n_reencoded")
