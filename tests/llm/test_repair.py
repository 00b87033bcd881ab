"""Conversation repair against a search over all edits, on short conversations, and against itself on long ones."""

import hashlib
import random
import re
import zlib

from caseloom.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, gone boolean, kind int, conv string"


def slow_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def slow(rows):
    """All edits, breadth first by row, without merging of states: (cost, letters) and the rows they give."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        core = re.sub("[\x20\x09-\x0d]", "", text)
        kinds.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = sorted({r[0] for r in rows if r[0] is not None})
    ways = [(0, "", ())]

    def inserted(ways):
        for _ in range(2):
            ways = list({*ways, *((c + 3, a + "I", (*out, (x, ""))) for c, a, out in ways for x in ("user", "assistant"))})
        return ways

    for (_, role, text), kind in zip(rows, kinds):
        more = []
        for c, a, out in inserted(ways):
            more.append((c + 4, a + "D", out))
            if kind not in ("blank", "duplicate"):
                extra = 3 * (kind == "truncated")
                more.append((c + extra, a + "K", (*out, (role, text))))
                more += [(c + extra + 3, a + "R", (*out, (x, text))) for x in ("user", "assistant")]
        ways = [w for w in set(more) if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in w[2]))]
    ends = [w for w in set(inserted(ways)) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in w[2]))]
    cost, audit, out = min(ends)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, list(out)


def cases():
    rnd = random.Random(12)
    rows = [(None, None, None, None), (None, 3, "user", "No id."), (1, 1, "assistant", "x" * 200_000), (2, None, "", ""), (2, None, "system", "a b\x0b"), (3, -4, "tool", "é?")]
    for conv in range(10, 150):
        turn = rnd.randint(-2, 3)
        for _ in range(rnd.randint(1, 4)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None])
            rows.append((conv, None if rnd.random() < 0.08 else turn, role, rnd.choice(["Yes.", "No!", "cut off", "", " \t", "Why? \n", None, "a", "𝒳."])))
            turn += rnd.choice([0, 1, 1, 1, 2, 5])
    return rows


def test_repairs_against_all_edits(spark):
    rows = cases()
    table = spark.createDataFrame([(*r, None, 7, "clash") for r in rows], SCHEMA)
    harmed = repair.damaged(table.repartition(5))
    want = {conv: slow(kept) for conv, kept in slow_damage(rows).items()}
    got = {r["conv_id"]: r for r in repair.repairs(harmed).collect()}
    assert got.keys() == want.keys()
    for conv, (report, _) in want.items():
        assert {k: got[conv][k] for k in report} == report, conv
    out = {}
    for r in repair.repaired(harmed).orderBy("place").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert out == {conv: x for conv, (_, x) in want.items() if x}


def test_long_conversations_spill_and_cross_batches(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["user", "assistant", "system"]), rnd.choice(["Fine.", f"cut {i}", "", f"Say {i}."]), rnd.choice([0, 0, 3, 1])) for i in range(5000)]
    told = []
    for spill in (7, 10_000):
        r = repair.Repair(spill)
        for i, (role, text, kind) in enumerate(rows):
            r.add(i, role, text, kind)
        told.append(r.finish())
    assert told[0] == told[1] and len(told[0][6]) >= 5000
    table = spark.createDataFrame([(1, i, role, text) for i, (role, text, _) in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string")
    reports = []
    try:
        for n in ("100", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            reports.append(repair.repairs(table).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert reports[0] == reports[1] and len(reports[0]) == 1
    back = "\n".join(f"{r['role']}:{r['text']}" for r in repair.repaired(table).orderBy("place").collect())
    assert hashlib.sha256(back.encode()).hexdigest() == reports[0][0]["repaired_sha256"]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repairs(none).count() == 0 and repair.repairs(repair.damaged(none)).count() == 0
