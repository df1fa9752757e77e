import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillspark.llm import conversations as c
from quillspark.llm import queries

SF = "/root/testdata/sf0.01"
ENDS = {0: "", 1: "II", 2: "I", 3: ""}


def hurt(rows):
    """(conv_id, turn, role, text) after damage, by conversation, with conversations that lose all rows."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        made = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Dynamic programming over whole (cost, audit) pairs, without a heuristic."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, blank, dup, cut = set(), [], 0, 0, 0
    for _, role, text in rows:
        b = not re.search(r"[^\x20\x09-\x0D]", text)
        d = not b and (role, text) in seen
        t = not b and not d and re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?"
        seen.add((role, text))
        blank, dup, cut = blank + b, dup + d, cut + t
        faults.append((role[:1], b or d, t))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    state = {0: (0, "", ())}

    def put(to, q, v):
        if q not in to or v[:2] < to[q][:2]:
            to[q] = v

    def inserts(now):
        for _ in range(3):
            for q, (g, a, done) in list(now.items()):
                for r in "ua":
                    if (q, r) in step:
                        put(now, step[q, r], (g + 2, a + "I", (*done, ({"u": "user", "a": "assistant"}[r], ""))))
        return now

    for (initial, must, t), (_, role, text) in zip(faults, rows, strict=True):
        new = {}
        for q, (g, a, done) in inserts(state).items():
            put(new, q, (g + 3, a + "D", done))
            if not must:
                if (q, initial) in step:
                    put(new, step[q, initial], (g + t, a + "K", (*done, (role, text))))
                for r in "ua":
                    if (q, r) in step:
                        put(new, step[q, r], (g + 2 + t, a + "R", (*done, ({"u": "user", "a": "assistant"}[r], text))))
        state = new
    cost, audit, done = min(v for q, v in inserts(state).items() if q in (0, 3))
    turns = [r[0] for r in rows if r[0] is not None]
    bad = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(faults, faults[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, dup, cut, bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()


def made(seed, convs, turns):
    rng = random.Random(seed)
    texts = [None, "", " \n", "Yes.", "No", "Why? ", "a.b", "so!\n", "x"]
    return [(rng.choice(convs), rng.choice([None, *range(turns)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for _ in range(turns * len(convs))]


def rows_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long", [c.LONG, 7, 1])
def test_equals_brute_force(spark, long):
    rows = [*made(5, [None, *range(60)], 9), *made(6, [100, 101], 60), (7, 1, "user", "Hi."), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", gaps int, at string").repartition(3)
    assert rows_of(c.repair(c.damaged(df), long)) == {k: brute(v) for k, v in hurt(rows).items()}


def test_lines_hash_to_the_report(spark):
    rows = [*made(8, list(range(20)), 8), *made(9, [50], 80)]
    df = c.damaged(spark.createDataFrame(rows, SCHEMA))
    report = rows_of(c.repair(df))
    for long in (c.LONG, 10):
        lines = defaultdict(list)
        for r in sorted(c.repaired(df, long).collect(), key=lambda r: (r["conv_id"], r["at"], r["k"])):
            lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
        assert {k: hashlib.sha256("\n".join(lines[k]).encode()).hexdigest() for k in report} == {k: v[-1] for k, v in report.items()}


def test_heuristic_and_ties():
    rng = random.Random(1)
    for _ in range(400):
        faults = [(rng.choice("suaa u"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        rows = [(k, i, "" if must else f"{k}" + "." * (not cut)) for k, (i, must, cut) in enumerate(faults)]
        (cost, audit), = c.cheapest(faults and [(i, m, t and not m) for i, m, t in faults]).values()
        assert (cost, audit) == brute(rows)[5:7]


def test_empty_and_undamaged(spark):
    assert c.repair(c.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    one = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "y" * 2_000_000 + ".")], SCHEMA)
    r = c.repair(one).collect()[0]
    assert (r["audit"], r["cost"], r["illegal"]) == ("KK", 0, 0)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_conversation_repair(spark, SF)) == {k: brute(v) for k, v in hurt(rows).items()}
