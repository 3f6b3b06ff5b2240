"""Conversation repair against a search over all edits, and its defined cases."""

import hashlib
import heapq
import random
import re
import zlib

from factloom.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def damage(rows):
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        yield from [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def search(rows):
    """(cost, audit, repaired) of one conversation's rows: cheapest first, then least audit."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        said = text.strip(WHITE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if not re.fullmatch("s?(ua)*u?", initials) or len(audit) > 3 * len(rows) + 4:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return faults, cost, audit, "\n".join(out)
        state = (i, initials[-1:] or "-", audit)
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*out, f"{role}:")))
        if i == len(rows):
            continue
        _, _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, out))
        if faults[i] not in ("blank", "duplicate"):
            more = 5 if faults[i] else 0
            if role[:1] in ("s", "u", "a"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + role[0], (*out, f"{role}:{text}")))
            for other in ("user", "assistant"):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, initials + other[0], (*out, f"{other}:{text}")))


def expected(rows):
    out, held = {}, list(damage(rows))
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in held if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
        faults, cost, audit, text = search(own)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def test_repair_equals_a_search_over_all_edits(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(160), None]:
        for turn in range(rng.randint(1, 6)):
            at = rng.choice([turn, turn, turn, turn + 2, None, 1])
            rows.append((conv, at, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None]), rng.choice(["Hi.", "Hi", "Yes!", " \n", "", None, f"t{turn}?", f"u{turn}. "])))
    rng.shuffle(rows)
    made = C.repair_reports(C.damaged(spark.createDataFrame(rows, SCHEMA)))
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in made.collect()}
    want = expected(rows)
    assert len(got) == len(want) and {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_long_conversations_over_many_batches(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(3000)] + [(2, 0, "user", "a.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.conv_id: r for r in C.repair_reports(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got[1].cost, got[1].audit) == (4, "D" + "K" * 2998 + "D")
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (2, "D", hashlib.sha256(b"").hexdigest())
    edits = C.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = sorted((r.place, r.role, r.text) for r in edits if r.conv_id == 1 and r.place)
    assert [r[1][0] for r in kept] == list("ua" * (len(kept) // 2)) and len(kept) % 2 == 0
    joined = "\n".join(f"{r[1]}:{r[2]}" for r in kept)
    assert got[1].repaired_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_empty_and_foreign_columns(spark):
    from pyspark.sql import functions as F

    assert C.repair_reports(C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    more = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA).withColumn("gone", F.lit(7)).withColumn("nth", F.lit(0)).withColumn("c0", F.lit("x"))
    row = C.repair_reports(C.damaged(more)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
