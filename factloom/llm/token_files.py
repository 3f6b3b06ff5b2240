"""Token-id output: Parquet list columns, written in id order and read back selectively.

Texts are encoded with a public tokenizer whose pre-tokenizer never joins text across white space,
so a text's ids are the ids of its white-space words in turn. A batch of texts is cut into words and
its distinct words are found by Arrow; below U+0300 a word is lower-cased and parted from the marks
that close it, as the tokenizer itself would part them. Each worker keeps the ids of these units in
flat arrays (at most ``CACHE_UNITS``, then only those met again stay) and asks the library for new
ones only. Rows are dealt by ranges of id, so that file i holds smaller ids than file
i + 1; ties and repeated rows are ordered by a hash of the text. The number of files follows from the
bytes of the texts. Row groups, pages and encodings are set by options; page indexes are always
written, and readers that select columns or ranges of ids skip the rest.

Defined cases: a null or empty text has only the end id; a null id sorts first; repeated rows are
all written; an empty table gives an empty folder with a schema; only the named columns are kept.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import scratch_dir, table

CACHE_UNITS = 3_000_000
END_ID = 2
FILE_BYTES = 128 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 5_000
#: Texts are encoded in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Words that only the library may take apart: above U+02FF normal form C acts across letters, the
#: dotted capital I becomes two characters, and a special token's text may stand inside a word.
WHOLE = r"[^\x00-\x{012F}\x{0131}-\x{02FF}]|<\|"
_loaded: dict = {}


def _marks() -> str:
    """Characters below U+0300 that are neither letters, numbers nor white space."""
    import regex

    return "".join(c for c in map(chr, range(0x300)) if regex.match(r"[^\s\p{L}\p{N}]", c))


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: itself if it can be printed, else one above U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of every entry, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


class WordEncoder:
    """Ids of texts by way of their words' units, kept in flat arrays."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelling = _byte_letters()
        self.marks = _marks()
        self.cache_units = cache_units
        self.salts = np.zeros((2, 0), dtype=np.uint64)
        none = np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1024, dtype=np.int32), 0
        self.starts = self.sizes = self.met = none
        # Known units by a sorted hash: a second hash tells those with the same first one apart.
        self.keys, self.proofs, self.order = none.view(np.uint64), none.view(np.uint64), none

    def _hashes(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each string: sums of its bytes times random numbers by position."""
        ends, data = _bytes_of(units)
        sizes = np.diff(ends)
        longest = int(sizes.max(initial=0))
        if longest > self.salts.shape[1]:
            self.salts = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, size=(max(64, 2 * longest), 2), dtype=np.uint64).T.copy()
        held = data[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(held)) - np.repeat(ends[:-1] - ends[0], sizes)
        out = []
        for salt in self.salts:
            total = np.zeros(len(held) + 1, dtype=np.uint64)
            np.cumsum(held * salt[place], out=total[1:])
            sums = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
            sums ^= sums >> np.uint64(31)
            out.append(sums * np.uint64(0x9E3779B97F4A7C15))
        return out[0], out[1]

    def _forget(self, keep: np.ndarray) -> None:
        """Keep only these units."""
        place = np.full(len(self.sizes), -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        stay = place[self.order] >= 0
        self.keys, self.proofs, self.order = self.keys[stay], self.proofs[stay], place[self.order[stay]]
        self.flat = _gather(self.flat, self.starts[keep], self.sizes[keep])
        self.used, self.sizes = len(self.flat), self.sizes[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.met = np.zeros(len(keep), dtype=np.int64)

    def _ids(self, units: list[str], single: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new units, in turn; single ones are one pre-token each."""
        sizes, flat = np.zeros(len(units), dtype=np.int64), array("i")
        tokenize, spelling = self.model.tokenize, self.spelling
        for i, (unit, one) in enumerate(zip(units, single, strict=True)):
            if one:  # normal already: the model alone
                spelt = unit if unit.isascii() and unit.isprintable() else unit.encode("utf-8").decode("latin-1").translate(spelling)
                ids = [t.id for t in tokenize(spelt)]
            else:
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            sizes[i] = len(ids)
            flat.extend(ids)
        return sizes, np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, dtype=np.int32)

    def _places(self, units: pa.Array, single: pa.Array) -> np.ndarray:
        """Index of every unit; new ones are learnt."""
        keys, proofs = self._hashes(units)
        by_key = np.argsort(keys)
        at = np.zeros(len(keys), dtype=np.int64)
        at[by_key] = np.searchsorted(self.keys, keys[by_key])
        inside = np.minimum(at, max(len(self.keys) - 1, 0))
        places = np.full(len(keys), -1, dtype=np.int64)
        if len(self.keys):
            met = (self.keys[inside] == keys) & (self.proofs[inside] == proofs)
            places[met] = self.order[inside[met]]
        fresh = by_key[places[by_key] < 0]
        if len(fresh):
            chosen = pa.array(fresh)
            sizes, ids = self._ids(units.take(chosen).to_pylist(), single.take(chosen).to_pylist())
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), dtype=np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            places[fresh] = len(self.sizes) + np.arange(len(fresh))
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.zeros(len(fresh), dtype=np.int64)])
            self.used += len(ids)
            self.keys, self.proofs, self.order = (
                np.insert(old, at[fresh], new) for old, new in ((self.keys, keys[fresh]), (self.proofs, proofs[fresh]), (self.order, places[fresh]))
            )
        self.met[places] += 1
        return places

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with ``end_id`` after every text's, and where each text's ids start and end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        if len(self.sizes) + 2 * len(words) > self.cache_units:
            again = np.flatnonzero(self.met > 1)
            self._forget(again if len(again) < self.cache_units // 2 else again[:0])
        # Distinct words of this batch to pairs of units, units to ids, then both back again.
        whole = pc.match_substring_regex(words, WHOLE)
        lower = pc.if_else(whole, words, pc.utf8_lower(words))
        core = pc.if_else(whole, words, pc.utf8_rtrim(lower, characters=self.marks))
        tail = _tails(lower, core)
        units = pa.concat_arrays([core, tail]).dictionary_encode()
        single = pc.match_substring_regex(units.dictionary, r"^(?:\p{L}+|[^\s\x0B\x{85}\x{A0}\p{L}\p{N}]+)$")
        single = pc.and_(single, pc.invert(pc.match_substring_regex(units.dictionary, WHOLE)))
        pair = self._places(units.dictionary, single)[units.indices.to_numpy()].reshape(2, len(words))
        sizes = self.sizes[pair]
        of_words = _gather(self.flat, self.starts[pair].T.reshape(-1), sizes.T.reshape(-1))
        word_sizes = sizes.sum(axis=0)
        word_starts = np.cumsum(word_sizes) - word_sizes
        if end_id is not None:
            of_words = np.append(of_words, np.int32(end_id))
            word_sizes, word_starts = np.append(word_sizes, 1), np.append(word_starts, len(of_words) - 1)
            codes = np.insert(codes, ends[1:], len(words))
            ends = ends + np.arange(len(ends))
        sizes = word_sizes[codes]
        total = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=total[1:])
        return _gather(of_words, word_starts[codes], sizes), total[ends]


def _tails(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What follows each word's core."""
    ends, held = _bytes_of(words)
    core_sizes = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(ends) - core_sizes
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = _gather(held, ends[:-1] + core_sizes, sizes) if len(sizes) else held[:0]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large string array."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return ends, np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)


def _slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > limit:
            yield at, i
            at, held = i, 0
        held += size
    if len(sizes):
        yield at, len(sizes)


def _encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str,
    end_id: int | None = END_ID,
    text: str = "text",
    key: str = "doc_id",
    metadata: tuple[str, ...] = (),
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
    files: int | None = None,
) -> None:
    """Write (key, metadata..., ids, n_tokens, shard, before) in ascending order of key.

    ``encoding`` is "dictionary" or "delta"; ``shard`` numbers the files in order of key and
    ``before`` is the number of ids that stand before a row in its file. Files hold about
    ``FILE_BYTES`` of text, but there are no fewer than the session has shuffle partitions.
    """
    spark = docs.sparkSession
    kept = [key, *metadata]
    if files is None:
        held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))
    source = docs.select(*kept, F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__tie"))
    ordered = source.repartitionByRange(files, key, "__tie").sortWithinPartitions(key, "__tie").drop("__tie")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column(len(kept))
            for at, to in _slices(column):
                ids, ends = encoder.encode(column.slice(at, to - at), end_id)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(at, to - at) for i in range(len(kept))],
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(np.diff(ends)),
                     pa.array(np.full(to - at, shard, dtype=np.int32)), pa.array(before + ends[:-1])],
                    names=[*kept, "ids", "n_tokens", "shard", "before"],
                )
                before += int(ends[-1])

    encoded = ordered.mapInArrow(encode, f"{fields}, ids array<int>, n_tokens long, shard int, before long")
    encoded.write.options(
        **{
            "parquet.block.size": row_group_bytes,
            "parquet.page.size": page_bytes,
            "parquet.page.row.count.limit": page_rows,
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        }
    ).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = (), low=None, high=None, key: str = "doc_id") -> DataFrame:
    """Rows with low <= key < high and only the columns asked for; both reach the Parquet scan."""
    found = spark.read.parquet(path)
    if low is not None:
        found = found.filter(F.col(key) >= low)
    if high is not None:
        found = found.filter(F.col(key) < high)
    return found.select(*columns) if columns else found


def token_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids in all rows before: those of the files before, and ``before`` in its own.

    rows holds whole files. Totals are one row of two numbers a file: they are summed up in one task
    and sent to all others. A file holds about ``FILE_BYTES`` of text, so 100 TB make under a million
    of them, 16 MB.
    """
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("shard_tokens").over(earlier), F.lit(0)).alias("__offset"))
    placed = rows.join(F.broadcast(offsets), F.col("shard") == F.col("__shard"))
    return placed.withColumn("start", F.col("__offset") + F.col("before")).drop("__shard", "__offset")


def id_checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32; the last two are taken from the ids themselves."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "start", "ids").mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return id_checksums(token_starts(read_token_files(spark, path)))
