"""Operators that SQL can't express against plain versions of the same definition."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import audio_fingerprint as af
from factloom.llm import edit_counts, near_dedup, quality_rules, rule_ensemble, token_files, unigram_pieces

P = pytest.importorskip("public_tokenizers")


def copies(rng, n=160):
    """Texts with exact copies, near copies of several strengths, chains, shared passages and a hot group."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = lambda k: [rng.choice(words) for _ in range(k)]
    texts = [" ".join(base(rng.randint(1, 90))) for _ in range(n)]
    passage = base(60)
    texts += [" ".join(base(20) + passage + base(15)) for _ in range(25)]
    hot = base(100)
    for _ in range(120):
        w = list(hot)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    chain = base(80)
    for _ in range(25):
        chain = list(chain)
        chain[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(chain).upper())
    return [*texts, texts[3], texts[-60], None, "", "one two", "one two"]


def test_near_dedup_equals_all_pairs(spark):
    texts = copies(random.Random(5))
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    least = list(range(len(texts)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_blocks_of_a_bucket_miss_no_link(spark, monkeypatch):
    texts = copies(random.Random(8), 20)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 20)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame).collect()} == whole


def test_every_pair_within_the_signature_bound_shares_a_key(spark):
    rng = np.random.default_rng(2)
    indexed = near_dedup.CHUNKS * near_dedup.CHUNK_SYMBOLS
    bound = near_dedup.CHUNKS * (near_dedup.CHUNK_ERRORS + 1) - 1
    rows = []
    for i in range(60):
        a = rng.integers(0, 2**16, near_dedup.HASHES, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(indexed, bound, replace=False)
        b[at] ^= 1
        rows += [(f"a{i}".encode(), a.tobytes()), (f"b{i}".encode(), b.tobytes())]
    keys = near_dedup.index_keys(spark.createDataFrame(rows, "node binary, sig binary")).collect()
    held = {}
    for r in keys:
        held.setdefault(bytes(r.node), set()).add(r.key)
    assert all(held[f"a{i}".encode()] & held[f"b{i}".encode()] for i in range(60))


def brute_matches(queries, recordings):
    """Pairs of classes with a run at any shift and offset; least ids stand for classes."""
    least, prints = {}, {}
    for i, c in zip(recordings, af.fingerprints(list(recordings.values())), strict=True):
        prints[least.setdefault(c.tobytes(), i)] = c
    want = set()
    for q in queries:
        phases = af.shifts(recordings[q])
        own = least[phases[0].tobytes()]
        for d, codes in prints.items():
            tries = ((a, o) for a in phases for o in range(af.MIN_OVERLAP - len(codes), len(a) - af.MIN_OVERLAP + 1))
            if d != own and any(af.best_run(a, codes, o) for a, o in tries):
                want.add((own, d))
    return want


def test_best_run_equals_every_run():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a = rng.integers(0, 2**32, rng.integers(1, 60), dtype=np.uint32)
        b = np.concatenate([rng.integers(0, 2**32, 5, dtype=np.uint32), a ^ (np.uint32(1) << rng.integers(0, 32, len(a), dtype=np.uint32)) * (rng.random(len(a)) < 0.9)])
        b[rng.integers(0, len(b), len(b) // 4)] = rng.integers(0, 2**32)
        for offset in (-5, 0, 3):
            best = None
            for i in range(len(a)):
                for j in range(i + af.MIN_OVERLAP, len(a) + 1):
                    if 0 <= i - offset and j - offset <= len(b):
                        errors = int(np.bitwise_count(a[i:j] ^ b[i - offset : j - offset]).sum())
                        gain = 32 * af.MAX_ERROR_RATE * (j - i) - errors
                        best = gain if gain >= -1e-9 and (best is None or gain > best) else best
            run = af.best_run(a, b, offset)
            assert (run is None) == (best is None) and (run is None or abs(run[0] - best) < 1e-6)


def test_audio_recall_on_recordings_cut_at_any_sample(spark):
    rng = np.random.default_rng(4)

    def melody(seed):
        notes = np.random.default_rng(seed).integers(0, 24, 12)
        hz = 660.0 * 2 ** (np.repeat(notes, 2000) / 12)
        return 90 * np.sin(2 * np.pi * np.cumsum(hz) / af.RATE)

    def as_bytes(x):
        return bytes(np.clip(x + 128, 0, 255).astype(np.uint8))

    recordings = {}
    for k in range(5):
        clean = melody(k)
        recordings[50 * k] = as_bytes(clean)
        recordings[50 * k + 1] = as_bytes(clean + rng.normal(0, 4, len(clean)))
        recordings[50 * k + 2] = as_bytes(clean[32 * 100 + 7 * k + 1 : 20_000])
        recordings[50 * k + 3] = as_bytes(clean)
    recordings |= {1001: None, 1002: b"", 1003: b"\x80" * 5000, 1050: b"\x80" * 9000}
    frame = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in recordings.items()], "doc_id long, pcm binary")
    got = {(r.query_id, r.class_id): r for r in af.match_recordings(frame, "pcm", F.col("doc_id") % 50 == 0).collect() if r.query_id is not None}
    want = brute_matches([50 * k for k in range(5)], {i: recordings[i] for i in recordings if i < 200 or i % 50 == 0})
    inside = {p for p in got if p[1] < 200 or p[1] % 50 == 0}
    assert inside <= want and len(inside) >= 0.9 * len(want) >= 4
    for k in range(5):
        assert abs(got[50 * k, 50 * k + 2].offset - (3200 + 7 * k + 1)) <= af.HOP // af.PHASES
    assert not any(1003 in p or 1050 in p for p in got)


def test_audio_partial_overlaps_and_repeats(spark):
    """Documents' bytes: a third shared at any place, and repeats whose first places mislead."""
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    shared, part = noise(2048), noise(1024)
    recordings = {
        0: noise(4096) + shared, 1: shared + noise(4096), 2: noise(1003) + shared + noise(777),
        50: noise(2048) + 8 * part, 51: 2 * part + noise(6400),
        100: noise(4096), 101: noise(4096),
    }
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in recordings.items()], "doc_id long, pcm binary")
    got = {(r.query_id, r.class_id): r for r in af.match_recordings(frame, "pcm", F.col("doc_id") % 50 == 0).collect() if r.query_id is not None}
    assert got[0, 1].offset == 4096 and got[0, 1].bit_errors == 0
    assert abs(got[0, 2].offset - (4096 - 1003)) <= af.HOP // af.PHASES
    want = brute_matches([0, 50, 100], recordings)
    assert want == got.keys() and want == {(0, 1), (0, 2), (50, 51)}


def test_audio_recall_on_the_table(spark):
    """Texts that share a long passage with a query, in the smallest table, at every shift and offset."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode()[:12_000] for r in docs.select("doc_id", "text").collect()}
    grams = lambda t: {t[i : i + 40] for i in range(0, len(t) - 39)}
    queries = [i for i in sorted(texts) if i % 50 == 0][:6]
    asked = set().union(*[grams(texts[i]) for i in queries])
    some = {i: t for i, t in texts.items() if i in queries or any(t[k : k + 40] in asked for k in range(0, len(t) - 39, 7))}
    frame = spark.createDataFrame([(i, bytearray(t)) for i, t in some.items()], "doc_id long, pcm binary")
    got = {(r.query_id, r.class_id) for r in af.match_recordings(frame, "pcm", F.col("doc_id").isin(queries)).collect() if r.query_id is not None}
    want = brute_matches(queries, some)
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_edits_equal_recounting():
    counter = edit_counts.PieceCounter(P.path("byte_bpe_50k.tiktoken"))
    assert edit_counts.PATTERN == P.PATTERN
    rng = random.Random(2)
    letters = [*"ab  \n\t'sltrdvem12.,é一 ", " the", " 're", "'ll", "  \n "]
    draw = lambda k: "".join(rng.choice(letters) for _ in range(k))
    for leaf in (4, 128):
        edit_counts.LEAF = leaf
        for _ in range(400):
            text = draw(rng.choice([0, 1, 5, 40, 300]))
            tree = edit_counts.CountTree(text, counter)
            for _ in range(5):
                start = rng.randint(0, len(text) + 2)
                stop, new = start + rng.choice([-3, 0, 1, 3, 30]), draw(rng.choice([0, 1, 2, 8]))
                tree.edit(start, stop, new)
                low = min(start, len(text))
                text = text[:low] + new + text[min(max(stop, low), len(text)) :]
                assert tree.text == text and tree.total() == len(counter.encoding.encode_ordinary(text))
                if rng.random() < 0.5:  # kept and taken up again
                    encoded = tree.encoded
                    tree = edit_counts.CountTree.kept(tree.text, *tree.state(), counter)
                    tree.encoded = encoded
    long = edit_counts.CountTree("many words here " * 2000, counter)
    long.edit(16_000, 16_004, "new")
    assert long.encoded < 12  # of six thousand pre-tokens
    edit_counts.LEAF = 128


def test_kept_trees_take_edits_without_recounting(spark, tmp_path):
    ranks = P.path("byte_bpe_50k.tiktoken")
    counter = edit_counts.PieceCounter(ranks)
    texts = ["many words here " * 3000, "short one", None, "", "don't  stop\n\n now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edit_counts.build_trees(docs, ranks=ranks).write.parquet(str(tmp_path / "first"))
    one = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("stop"), F.lit("new é").alias("text")))
    edit_counts.edit_trees(spark.read.parquet(str(tmp_path / "first")), one, ranks=ranks).write.parquet(str(tmp_path / "second"))
    again = edit_counts.edit_trees(spark.read.parquet(str(tmp_path / "second")).withColumn("n_tokens", F.col("n_edited_tokens")), one, ranks=ranks)
    for r in again.collect():
        text = texts[r.doc_id] or ""
        for _ in range(2):
            text = text[:5] + "new é" + text[9:]
        assert r.text == text and r.n_edited_tokens == len(counter.encoding.encode_ordinary(text)) and r.n_reencoded < 12
        assert sum(r.sizes) == len(text) and sum(r.counts) == r.n_edited_tokens == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(text)


def segmentations(text, model, coder):
    """Best score over every segmentation, by trying all."""
    score = {p: coder.score[i] for i, p in enumerate(model.pieces) if model.types[i] == unigram_pieces.NORMAL}
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = score.get(text[start:end], coder.low if end - start == 1 and text[start:end] not in score else None)
            if piece is not None and best[start] is not None and (best[end] is None or best[start] + piece > best[end]):
                best[end] = best[start] + piece
    return best[len(text)]


def test_pieces_are_the_best_path_and_round_trip():
    model = unigram_pieces.PieceModel.load(unigram_pieces.default_model())
    coder = unigram_pieces.PieceCoder(model, cache_units=50)
    rng = random.Random(1)
    letters = [*"ab thing the e é一😀\n\t1 .,", "▁", " and", "ß"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert coder.decode(ids) == text.replace("▁", " ")
        if text:
            assert ids == coder.viterbi(coder.escape(text))
            scores = [coder.score[i] for i in ids if model.types[i] != unigram_pieces.BYTE]
            unknown = sum(1 for c in coder.escape(text) if c not in set(model.pieces))
            assert abs(sum(scores) + unknown * coder.low - segmentations(coder.escape(text), model, coder)) < 1e-3 * (1 + unknown * 1e5)


def test_pieces_against_the_library():
    """The public model read as a unigram model: the library never finds a better path.

    It can find a worse one: it adds in single precision, and this model's scores reach -1e9.
    """
    import sentencepiece

    with open(unigram_pieces.default_model(), "rb") as f:
        raw = f.read()
    trainer = bytes([0x18, 0x02])  # model_type in the trainer's settings: 2 is BPE, 1 is unigram
    at = raw.index(trainer, raw.rindex(b"shuffled.txt"))
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + bytes([0x18, 0x01]) + raw[at + 2 :])
    coder = unigram_pieces.PieceCoder(unigram_pieces.PieceModel.load(unigram_pieces.default_model()))
    total = lambda ids: sum(coder.score[i] for i in ids)
    rng = random.Random(3)
    common = "the of and in was information token segmentation normal words are here".split()
    rare = [*common, *"über naïve 2024 don't e.g. (x) a-b".split()]
    for words in (common, rare):
        for _ in range(200):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
            ours, theirs = np.frombuffer(coder.encode(text), "<u4").tolist(), library.encode(text)
            assert total(ours) >= total(theirs), text


def test_decoding_on_spark(spark):
    coder = unigram_pieces.PieceCoder(unigram_pieces.PieceModel.load(unigram_pieces.default_model()))
    texts = ["plain words", " two  spaces ", "é一😀\n", ""]
    rows = [(i, np.frombuffer(coder.encode(t), "<u4").tolist()) for i, t in enumerate(texts)] + [(9, None)]
    got = {r.doc_id: r.text for r in unigram_pieces.decode_pieces(spark.createDataFrame(rows, "doc_id long, ids array<int>"), unigram_pieces.default_model()).collect()}
    assert got == {**dict(enumerate(texts)), 9: ""}


def test_models_that_rewrite_text_are_refused(tmp_path):
    with open(unigram_pieces.default_model(), "rb") as f:
        raw = f.read()
    for settings in (b"\x12\x01x\x20\x00", b"\x20\x01", b""):  # a character map; white space dropped; the same by default
        path = tmp_path / f"{len(settings)}.model"
        path.write_bytes(raw + b"\x1a" + bytes([len(settings)]) + settings)
        with pytest.raises(ValueError, match="not supported"):
            unigram_pieces.PieceModel.load(str(path))


def test_word_cache_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encoder = token_files.WordEncoder(P.path("word_bpe_49k.json"), cache_units=60)
    rng = random.Random(3)
    letters = [*"aB \t\n\x0b\x1c\x1f\x85\xa0 　İßΣς'sst12ñ一\U0001f600ÉȺǅ²»¿-_.", "é", "̈", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "가", "***", "?!", "H̱", "J̌"]
    for _ in range(2000):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(3)]
        ids, ends = encoder.encode(pa.array([*texts, None, ""]), 2)
        for text, start, end in zip([*texts, "", ""], ends[:-1], ends[1:], strict=True):
            assert ids[start:end].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], repr(text)


def plain_statistics(text):
    """The statistics of one text in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    n, chars, rows = max(len(words), 1), max(sum(map(len, words)), 1), max(len(lines), 1)
    share = lambda letters: sum(text.count(c) for c in letters)
    return {
        "n_words": len(words), "word_len": sum(map(len, words)) / n, "symbols": share("#*$%&|<>") / chars, "dup_lines": (len(lines) - len(set(lines))) / rows,
        "repeats": len(covered) / n, "upper": share(rule_ensemble.UPPER) / chars, "digits": share("0123456789") / chars, "marks": share("!?") / chars,
        "distinct": len(set(words)) / n, "line_words": len(words) / rows, "bare": sum(len(w) == 1 for w in words) / n,
    }


def plain_score(model, values):
    z = model.intercept + sum(w for conditions, w in model.rules if all((values[c.feature] > c.threshold) == c.above for c in conditions))
    return 1 / (1 + np.exp(-z))


def test_scores_on_spark_equal_plain_ones(spark):
    rng = random.Random(6)
    pieces = ["word ", "Word! ", "a ", "12 ", "#$ ", "same line here\n", "x y z x y z ", "é漢 ", "\t", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", " \n ", "word " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("#" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    measured = docs.select("doc_id", rule_ensemble.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    model = rule_ensemble.fit_from(measured, labels)
    assert model.rules
    for r in measured.select("*", model.column().alias("score")).collect():
        want = plain_statistics(texts[r.doc_id])
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items()), (r, want)
        assert abs(r.score - plain_score(model, want)) < 1e-9
    got = {r.doc_id: r.score for r in rule_ensemble.score_quality(docs, labels).collect()}
    assert all(abs(got[i] - plain_score(model, plain_statistics(t))) < 1e-9 for i, t in enumerate(texts))


def test_bounded_sample_is_the_first_by_hash(spark):
    frame = spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("label", F.lit(1.0))
    plain = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id")).limit(300).collect()]
    assert [r.doc_id for r in rule_ensemble._first(frame, 300).collect()] == plain
    same = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"))
    assert rule_ensemble._first(same, 100).count() == 100


def test_thresholds_differ_between_groups_and_resist_junk(spark):
    """A source of code keeps its symbols; junk, a fifth of one source, moves no bounds."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda marks: " ".join(rng.choice(vocabulary) + (rng.choice("#$%&") * 2 if rng.random() < marks else "") for _ in range(60))
    rows = [(i, prose(0.0), "en", "books") for i in range(2200)] + [(20_000 + i, prose(0.8), "en", "books") for i in range(60)]
    rows += [(10_000 + i, prose(rng.uniform(0.4, 0.7)), "en", "code") for i in range(120)]
    rows += [(11_000 + i, prose(0.0), "de", "books" if i < 150 else "news") for i in range(198)] + [(21_000 + i, prose(0.8), "de", "news") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.apply_quality_rules(frame).filter("kept").collect()} == {r[0] for r in rows if r[0] < 20_000}
    stats = frame.select("doc_id", "lang", "source", quality_rules.text_statistics(F.col("text")).alias("s")).select("doc_id", "lang", "source", "s.*")
    bounds = {(r.lang, r.source): r.symbols_high for r in quality_rules.thresholds(quality_rules.build_sketches(stats)).collect()}
    assert bounds["en", "code"] > 100_000 and bounds["en", "books"] == bounds["de", "books"] == bounds["de", "news"] == 0


def test_sketches_merge_in_any_order(spark):
    rows = [(i, "en" if i % 3 else "de", f"s{i % 5}", 60 + i, 300 + 7 * i, i % 9, i % 4, i % 30, 5 + i % 6) for i in range(400)]
    names = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    build = lambda part: quality_rules.build_sketches(spark.createDataFrame(part, names))
    halves = build(rows[250:]).unionByName(build(rows[:250]))
    key = lambda r: (r.lang, r.source)
    assert sorted(quality_rules.thresholds(halves).collect(), key=key) == sorted(quality_rules.thresholds(build(rows)).collect(), key=key)


def test_rule_ensemble_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(rule_ensemble.FEATURES)))
    y = ((x[:, 2] < 0.8) & ~((x[:, 4] > 0.7) & (x[:, 8] < 0.5))).astype(float)
    model = rule_ensemble.fit_rules(x[:2000], y[:2000])
    assert model == rule_ensemble.fit_rules(x[:2000], y[:2000])

    def score(row):
        z = model.intercept
        values = dict(zip(rule_ensemble.FEATURES, row, strict=True))
        for conditions, weight in model.rules:
            if all((values[c.feature] > c.threshold) == c.above for c in conditions):
                z += weight
        return 1 / (1 + np.exp(-z))

    got = np.array([score(r) for r in x[2000:]])
    assert ((got >= 0.5) == (y[2000:] == 1)).mean() > 0.97 and 0 < len(model.rules) < 200
    assert rule_ensemble.fit_rules(x[:5], np.ones(5)).rules == ()
