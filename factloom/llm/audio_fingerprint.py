"""Chroma audio fingerprints: integral-image filters over pitch-class frames, aligned by offsets.

1. Samples are cut into overlapping windowed frames; each frame's spectrum from ``LOW_HZ`` on, where
   neighbouring semitones lie in different bins, is folded into twelve pitch classes, smoothed over
   time and normalised.
2. Rectangles over the pitch-class image are compared by differences of sums, which an integral
   image gives in constant time; each of ``FILTERS`` comparisons is cut into four levels, coded so
   that neighbouring levels differ in one bit, and sixteen of them make one 32-bit integer a frame.
3. Recordings with equal fingerprints form a class; matches are between classes, so that copies are
   not multiplied. The index holds every integer of every class. A query is fingerprinted at
   ``PHASES`` shifts within a hop, so that one of them meets the frames of any recording it was cut
   from, at whatever sample.
4. A query and a class that share an integer are a pair, if of its neighbours ``BESIDE`` and twice as
   many integers away two in turn hardly differ: any run of the least length that holds the integer
   holds two such. All positions of shared integers then vote for their offset, a histogram for each
   shift. Offsets are aligned in turn, most votes first, until the pair matches or none is left: a
   run of at least ``MIN_OVERLAP`` integers must have at most ``MAX_ERROR_RATE`` of its bits
   different. A pair's row tells the best run at that offset.
5. For that, classes are dealt in parts, and a query goes once to each part that it asks: neither side's
   integers travel by the pair. A task holds its part's classes and reads the queries past them.

The index sees no pair without an equal integer: recall against every shift and offset is measured
in the tests (at least 0.9). Neither buckets, offsets nor partners are capped. An integer that many
recordings share is a join on a skewed key, which adaptive execution splits.

The tables hold no sound, so the query takes each document's UTF-8 bytes as an 8-bit mono recording
of ``RATE`` samples a second. Copies then sound alike, and so do long passages that texts share; a
word put in shifts what follows it, which makes a second run at another offset.

Defined cases: null, empty and short recordings have no integers, form classes of one and match
nothing; integers of silence or constant sound agree with nothing; repeated ids are members by their
sound; an empty table gives an empty result; only the id and the samples are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialise, remove_scratch, scratch_mark, table

RATE = 8000
FRAME = 256
HOP = 32
LOW_HZ, HIGH_HZ = 530.0, 3800.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
FILTERS = 16
WIDTH = 16
#: Shifts of a query within a hop.
PHASES = 8
#: Distance of an indexed integer's neighbours, and how many of two neighbours' 32 low bits may differ.
BESIDE = 8
BESIDE_BITS = 9
MAX_ERROR_RATE = 0.15
MIN_OVERLAP = 24
QUERY_EVERY = 50
#: Bytes of integers of the classes, over the square of the parts that they are dealt in.
PART_BYTES = 1 << 20
#: Stands for an integer of silence.
SILENT = np.uint32(0xFFFFFFFF)
CHUNK_FRAMES = 8192
#: The image in whole numbers: sums over it are exact, whatever stands before a recording in a batch.
SCALE = 1 << 20


@cache
def _fold() -> np.ndarray:
    """Matrix from spectrum bins to pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for k, f in enumerate(hz):
        if LOW_HZ <= f <= HIGH_HZ:
            out[k, int(round(12 * np.log2(f / 440.0))) % 12] = 1.0
    return out


@cache
def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of each filter: kinds, heights and widths in rotation."""
    return [(i % 6, (5 * i) % 9, 2 + i % 3 if i % 6 != 1 else 4, (2, 4, 8, 12, 16)[i % 5]) for i in range(FILTERS)]


def chroma(frames: np.ndarray) -> np.ndarray:
    """Pitch-class energies of windowed frames, one row a frame."""
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1))
    return (spectrum * spectrum).astype(np.float64) @ _fold()


def _responses(image: np.ndarray) -> np.ndarray:
    """Every filter's response at every start frame of a smoothed, normalised image."""
    total = np.zeros((13, len(image) + 1), dtype=np.int64).T
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    n = max(len(image) - WIDTH + 1, 0)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        """Sums over frames t0 to t1 after every start and classes y0 to y1."""
        return total[t1 : t1 + n, y1] - total[t0 : t0 + n, y1] - total[t1 : t1 + n, y0] + total[t0 : t0 + n, y0]

    out = np.empty((n, FILTERS))
    for i, (kind, y, h, w) in enumerate(_filters()):
        y = min(y, 12 - h)
        t0, mid, t1, ym = 0, w // 2, w, y + h // 2
        third, yt = max(w // 3, 1), y + max(h // 3, 1)
        whole = area(t0, t1, y, y + h)
        if kind == 0:  # level against its own mean over all classes
            a, b = whole, area(t0, t1, 0, 12) * (h / 12)
        elif kind == 1:  # upper against lower classes
            a = area(t0, t1, ym, y + h)
            b = whole - a
        elif kind == 2:  # later against earlier frames
            a = area(mid, t1, y, y + h)
            b = whole - a
        elif kind == 3:  # diagonal quarters
            a = area(mid, t1, ym, y + h) + area(t0, mid, y, ym)
            b = whole - a
        elif kind == 4:  # inner against outer frames
            a = area(t0 + third, t1 - third, y, y + h)
            b = whole - a
        else:  # inner against outer classes
            a = area(t0, t1, yt, y + h - (yt - y)) if h > 2 else area(t0, t1, y, y + 1)
            b = whole - a
        out[:, i] = np.log1p(np.maximum(a, 0) / SCALE) - np.log1p(np.maximum(b, 0) / SCALE)
    return out


def _image(classes: np.ndarray) -> np.ndarray:
    n = len(classes) - len(SMOOTH) + 1
    smooth = sum(s * classes[i : i + n] for i, s in enumerate(SMOOTH))
    norm = np.sqrt((smooth * smooth).sum(axis=1, keepdims=True))
    return np.rint(np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-6) * SCALE).astype(np.int64)


@cache
def _levels() -> np.ndarray:
    """Quartiles of each filter's responses to noise: they cut responses into four levels."""
    noise = np.random.Generator(np.random.PCG64(5)).normal(0, 30, HOP * 6000 + FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(noise, FRAME)[::HOP]
    return np.quantile(_responses(_image(chroma(frames))), [0.25, 0.5, 0.75], axis=0)


def fingerprints(recordings: list[bytes | None]) -> list[np.ndarray]:
    """32-bit integers of every recording of 8-bit samples; none for one that is too short."""
    out = [np.zeros(0, dtype=np.uint32) for _ in recordings]
    least = len(SMOOTH) + WIDTH - 1
    held, rows = [], 0

    def flush() -> None:
        nonlocal held, rows
        if held:
            image_of = np.concatenate([frames for _, frames in held])
            classes = np.concatenate([chroma(image_of[at : at + CHUNK_FRAMES]) for at in range(0, len(image_of), CHUNK_FRAMES)])
            image = _image(classes)
            level = (_responses(image)[:, None, :] > _levels()[None]).sum(axis=1)
            gray = (level ^ (level >> 1)).astype(np.uint32)
            codes = (gray << (2 * np.arange(FILTERS, dtype=np.uint32))).sum(axis=1, dtype=np.uint32)
            codes[codes == SILENT] ^= np.uint32(1)
            quiet = np.concatenate([[0], np.cumsum(~image.any(axis=1))])
            codes[quiet[WIDTH:] - quiet[:-WIDTH] == WIDTH] = SILENT
            at = 0
            for i, frames in held:
                out[i] = codes[at : at + len(frames) - least + 1].copy()  # windows across two recordings are left out
                at += len(frames)
            held, rows = [], 0

    for i, recording in enumerate(recordings):
        if recording is not None and len(recording) >= FRAME + HOP * (least - 1):
            samples = np.frombuffer(recording, dtype=np.uint8).astype(np.float32) - 128
            frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
            held.append((i, frames))
            rows += len(frames)
            if rows >= CHUNK_FRAMES:
                flush()
    flush()
    return out


def shifts(recording: bytes | None) -> list[np.ndarray]:
    """Integers of a query at every shift within a hop."""
    return fingerprints([None if recording is None else recording[HOP * k // PHASES :] for k in range(PHASES)])


def best_run(a: np.ndarray, b: np.ndarray, offset: int, max_error_rate: float = MAX_ERROR_RATE, min_overlap: int = MIN_OVERLAP) -> tuple[float, int, int, int] | None:
    """(gain, start in a, length, differing bits) of the best run of aligned integers.

    b's position p lies at a's p + offset. A run's gain is what its differing bits leave of what
    ``max_error_rate`` allows; the best has the greatest, and the first of equals is taken.
    """
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high - low < min_overlap:
        return None
    left, right = a[low:high], b[low - offset : high - offset]
    errors = np.bitwise_count(left ^ right).astype(np.int64)
    errors[(left == SILENT) | (right == SILENT)] = 32
    wrong = np.concatenate([[0], np.cumsum(errors)])
    gain = 32 * max_error_rate * np.arange(len(wrong)) - wrong
    least = np.minimum.accumulate(gain[: len(gain) - min_overlap])
    best = gain[min_overlap:] - least
    end = int(best.argmax())
    if best[end] < -1e-9:
        return None
    start = int((gain[: end + 1] == least[end]).argmax())
    length = end + min_overlap - start
    return float(best[end]), low + start, length, int(wrong[start + length] - wrong[start])


def voted_offsets(phases: list[np.ndarray], b: np.ndarray) -> list[tuple[int, int]]:
    """(shift, offset) of b against a at which integers other than silence are equal: most votes first, then the least."""
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    a = np.concatenate(phases)
    phase = np.repeat(np.arange(len(phases)), [len(p) for p in phases])
    at = np.concatenate([np.arange(len(p)) for p in phases])
    low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    hits = np.where(a == SILENT, 0, high - low)
    total = int(hits.sum())
    if not total:
        return []
    places = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(total)
    keys = (np.repeat(at, hits) - order[places]) * len(phases) + np.repeat(phase, hits)
    found, votes = np.unique(keys, return_counts=True)
    found = found[np.argsort(-votes, kind="stable")]
    return list(zip((found % len(phases)).tolist(), (found // len(phases)).tolist(), strict=True))


def best_alignment(phases: list[np.ndarray], b: np.ndarray, max_error_rate: float = MAX_ERROR_RATE, min_overlap: int = MIN_OVERLAP) -> tuple[int, int, int] | None:
    """(offset in samples, length, bit errors) of the best run at the first of ``voted_offsets`` that has one."""
    for phase, offset in voted_offsets(phases, b):
        run = best_run(phases[phase], b, offset, max_error_rate, min_overlap)
        if run:
            return offset * HOP + HOP * phase // PHASES, run[2], run[3]
    return None


def fingerprint_table(media: DataFrame, column: str, is_query) -> DataFrame:
    """doc_id, asked, sound (digest of the integers; null if none), codes, and a query's codes at every shift."""
    kind = dict(media.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sounds = part.column(1).to_pylist()
                codes = [c.astype("<u4").tobytes() for c in fingerprints(sounds)]
                digests = [blake2b(c, digest_size=16).digest() if c else None for c in codes]
                phases = [[p.astype("<u4").tobytes() for p in shifts(s)] if asked and c else None for s, asked, c in zip(sounds, part.column(2).to_pylist(), codes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(codes, pa.binary()), pa.array(phases, pa.list_(pa.binary()))],
                    names=["doc_id", "asked", "sound", "codes", "phases"],
                )

    sounds = media.select("doc_id", F.col(column).cast("binary").alias("samples"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return sounds.mapInArrow(work, f"doc_id {kind}, asked boolean, sound binary, codes binary, phases array<binary>")


def neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low halves of the four neighbours of every integer in one number each, and bits for those there are."""
    near, there = np.zeros(len(codes), dtype=np.uint64), np.zeros(len(codes), dtype=np.int32)
    at = np.arange(len(codes))
    for k, step in enumerate((-2 * BESIDE, -BESIDE, BESIDE, 2 * BESIDE)):
        inside = (at + step >= 0) & (at + step < len(codes))
        near[inside] |= (codes[at[inside] + step] & np.uint32(0xFFFF)).astype(np.uint64) << np.uint64(16 * k)
        there[inside] |= 1 << k
    return near.view(np.int64), there


#: Two neighbours in turn, of some place on either side of a join, that hardly differ.
_BESIDE = " OR ".join(
    f"(h.there & a.there & {3 << k} = {3 << k} AND bit_count(shiftrightunsigned(h.near ^ a.near, {16 * k}) & {0xFFFFFFFF}L) <= {BESIDE_BITS})" for k in range(3)
)


def _postings(classes: DataFrame, codes: str) -> DataFrame:
    """(code, class_id, seen) of every integer of every class, with the neighbours of all its places; ``codes`` is an array of packed integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [(i, c, *neighbours(c)) for i, packed in enumerate(part.column(1).to_pylist()) for c in (np.frombuffer(x, dtype="<u4") for x in packed)]
                owner = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), [len(r[1]) for r in rows])
                code, near, there = (np.concatenate([*[r[k] for r in rows], np.zeros(0, kind)]).astype(kind, copy=False) for k, kind in ((1, np.uint32), (2, np.int64), (3, np.int32)))
                order = np.lexsort((there, near, code, owner))
                order = order[code[order] != SILENT]
                owner, code, near, there = owner[order], code[order], near[order], there[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
                fresh = new.copy()
                fresh[1:] |= (near[1:] != near[:-1]) | (there[1:] != there[:-1])
                ends = np.append(np.flatnonzero(new[fresh]), int(fresh.sum())).astype(np.int32)
                seen = pa.StructArray.from_arrays([pa.array(near[fresh]), pa.array(there[fresh])], names=["near", "there"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[new].view(np.int32)), part.column(0).take(pa.array(owner[new])), pa.ListArray.from_arrays(pa.array(ends), seen)], names=["code", "class_id", "seen"]
                )

    kind = dict(classes.dtypes)["class_id"]
    return classes.select("class_id", F.expr(codes).alias("packed")).mapInArrow(work, f"code int, class_id {kind}, seen array<struct<near:long,there:int>>")


def _dealt(pairs: DataFrame, asked: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes in parts, and behind each part's classes the queries that ask some of them, with those they ask.

    A class goes to its part once and a query to a part once, whatever the number of their pairs. The
    parts' number is the root of what their classes' integers hold, so that with the input both grow
    less than it does: the parts that a query goes to, and the integers that a task holds.
    """
    held = classes.agg(F.sum(F.length("codes"))).first()[0] or 0
    parts = math.ceil(math.sqrt(held / PART_BYTES)) or 1
    part = lambda: F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("int").alias("part")
    wanted = pairs.groupBy("query_id", part()).agg(F.collect_list("class_id").alias("wanted")).join(asked, "query_id")
    rows = classes.select(part(), F.col("class_id").alias("id"), "codes").unionByName(
        wanted.select("part", F.col("query_id").alias("id"), "phases", "wanted"), allowMissingColumns=True
    )
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("wanted").isNotNull())


def _measure(max_error_rate: float, min_overlap: int):
    """The matches of ``_dealt`` rows: a task holds its part's classes, and the queries pass by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, here = {}, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                ids, found = rows.column("id"), []
                for part, own, codes, phases, wanted in zip(*[rows.column(c).to_pylist() for c in ("part", "id", "codes", "phases", "wanted")], strict=True):
                    if part != here:
                        held, here = {}, part
                    if wanted is None:
                        held.setdefault(own, []).append(codes)  # ids that repeat have several sounds
                        continue
                    views = [np.frombuffer(p, dtype="<u4") for p in phases]
                    for other, packed in ((other, packed) for other in wanted for packed in held[other]):
                        run = best_alignment(views, np.frombuffer(packed, dtype="<u4"), max_error_rate, min_overlap)
                        if run:
                            found.append((own, other, *run))
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = [ids.type, ids.type, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "class_id", "offset", "overlap", "bit_errors"])

    return work


def match_recordings(media: DataFrame, column: str, is_query, *, max_error_rate: float = MAX_ERROR_RATE, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Members and matches in one table.

    A row without query_id says which class a recording belongs to; class_id is the least id with
    the same integers. A row with query_id says that this class matches the class of a query: at
    ``offset`` samples of the query's, with ``bit_errors`` over a run of ``overlap`` integers.
    """
    since = scratch_mark()
    prints = materialise(fingerprint_table(media, column, is_query), "fingerprints")
    until = scratch_mark()
    known = prints.filter("sound is not null")
    # The queries' own rows have shifts: of equal sounds, those of the least id are taken.
    phases = F.min_by("phases", F.when(F.col("asked"), F.struct("doc_id", "phases"))).alias("phases")
    classes = known.groupBy("sound").agg(F.min("doc_id").alias("class_id"), F.first("codes").alias("codes"), phases)
    classes = materialise(classes, "fingerprint-classes")
    members = prints.join(classes.select("sound", "class_id"), "sound", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    members = materialise(members, "fingerprint-members")
    remove_scratch(media.sparkSession, since, until)  # the classes have the integers, the members the ids
    asked = classes.filter("phases is not null").select(F.col("class_id").alias("query_id"), "phases")
    probes = _postings(asked.withColumnRenamed("query_id", "class_id"), "phases").toDF("code", "query_id", "asked_seen")
    beside = F.expr(f"exists(asked_seen, a -> exists(seen, h -> {_BESIDE}))")
    shared = probes.join(_postings(classes, "array(codes)"), "code").filter((F.col("query_id") != F.col("class_id")) & beside)
    pairs = materialise(shared.select("query_id", "class_id").distinct(), "fingerprint-pairs")
    kind = dict(classes.dtypes)["class_id"]
    dealt = _dealt(pairs, asked, classes.select("class_id", "codes"))
    good = dealt.mapInArrow(_measure(max_error_rate, min_overlap), f"query_id {kind}, class_id {kind}, offset int, overlap int, bit_errors int")
    matches = good.select(F.col("class_id").alias("doc_id"), "class_id", "query_id", "offset", "overlap", "bit_errors")
    members = members.select("*", F.lit(None).cast(kind).alias("query_id"), *[F.lit(None).cast("int").alias(c) for c in ("offset", "overlap", "bit_errors")])
    return members.unionByName(matches)


def op1_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    return match_recordings(table(spark, sf_dir, "documents"), "text", F.col("doc_id") % QUERY_EVERY == 0)
