"""Conversation structure repair: the cheapest edits that give roles of the form ``(s?(ua)+)?``, by A* on the edit lattice.

A node is (rows read, state of the role automaton, edits so far). Keep costs 0, Rerole 2, Insert 2, Delete 3; rows that are blank or repeat an earlier one
have to go, and truncated rows that stay add 1. The heuristic is the sum over the rows still to come of 3 for those that have to go and 1 for truncated ones, which is paid
whatever happens; it falls by no more than an edit costs, so nodes leave the agenda, keyed by (cost plus heuristic, audit), at their least cost and
with the ASCII-least audit: of two audits of the same rows, state and cost neither begins the other, so the order of the shorter ones lasts.

Conversations of at most LONG rows are repaired by one task each. Longer ones, however many rows they have, are cut into blocks: each block's cheapest edits
from every state to every state are found apart, only their costs are chained, and the edits chosen are joined back. Audits of a block end with a row, so none begins another and
the first block in which two cheapest ways differ settles their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspark.llm.common import forget, ship, slices, tidy, written

#: Rows of a conversation that one task repairs at once, and of a block of a longer one.
LONG = 2048
_SPACE = r"\x20\x09-\x0D"
#: States of the automaton: nothing yet, after s, after u, after a; what each may read, the role that an edit gives there, and what still ends it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVES, ENDS = ("u", "u", "a", "u"), ("", "II", "I", "")
ROLES = {"u": "user", "a": "assistant"}
#: initial, has to go, truncated
Row = tuple[str, bool, bool]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of rows (conv_id, turn, role, text) with the faults that crc32(``conv_id:turn``) modulo 20 stands for.

    0 drops a row (it stays with ``gone`` true, and only names its conversation), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role
    user. Nulls read as one space; a null turn stays null.
    """

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(known("conv_id"), F.lit(":"), known("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).when(kind == 0, "").otherwise(known("text"))
    once = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return once.drop("_copy")


def cheapest(rows: list[Row], start: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits from ``start`` by the state in which they end: of the one best accepted way, or of all ways that end with a row."""
    ahead = [0]
    for _, must, cut in reversed(rows):
        ahead.append(ahead[-1] + (3 if must else 1 if cut else 0))
    ahead.reverse()
    n, done, found = len(rows), set(), {}
    agenda = [(ahead[0], "", 0, start)]
    while agenda:
        f, audit, i, q = heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and (not whole or not ENDS[q]):
            found[q] = f, audit
            if whole:
                break
            continue
        g = f - ahead[i]
        given = NEXT[q][GIVES[q]]
        heappush(agenda, (g + 2 + ahead[i], audit + "I", i, given))
        if i < n:
            initial, must, cut = rows[i]
            rest = g + ahead[i + 1]
            heappush(agenda, (rest + 3, audit + "D", i + 1, q))
            if not must:
                if (to := NEXT[q].get(initial)) is not None:
                    heappush(agenda, (rest + cut, audit + "K", i + 1, to))
                heappush(agenda, (rest + 2 + cut, audit + "R", i + 1, given))
    return found


def applied(audit: str, rows: Iterable[tuple[str, str]], q: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves of rows (role, text); deleted rows have no line."""
    rows = iter(rows)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        symbol = role[:1] if edit == "K" else GIVES[q]
        q = NEXT[q][symbol]
        yield edit, role if edit == "K" else ROLES[symbol], text


def illegal(initials: Iterable[str]) -> int:
    initials = list(initials)
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _seen(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, blank, cut of rows (conv_id, turn, role, text and perhaps gone); nulls of role and text as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    return out.withColumns({"blank": ~F.col("text").rlike(f"[^{_SPACE}]"), "cut": ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")})


#: Ascending, so nulls come first.
_ORDER = ("turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations of a stream in their order: id and rows (turn, role, text, blank, cut), without those that are gone."""
    now, held, open_ = None, [], False
    for batch in slices(batches):
        for conv, gone, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "blank", "cut")), strict=True):
            if open_ and conv != now:
                yield now, held
                held = []
            now, open_ = conv, True
            if not gone:
                held.append(tuple(row))
    if open_:
        yield now, held


def _short(part: DataFrame, each: Callable[[object, list[tuple], list[Row], int, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Repair conversations that fit a task; ``each`` makes rows of (id, rows, their faults, cost, audit)."""
    kind = part.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in _conversations(batches):
            seen: set[tuple[str, str]] = set()
            faults: list[Row] = []
            for _, role, text, blank, cut in rows:
                again = (role, text) in seen
                seen.add((role, text))
                faults.append((role[:1], blank or again, cut and not blank and not again))
            (cost, audit), = cheapest(faults).values()
            out += each(conv, rows, faults, cost, audit)
            if len(out) >= 512:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    fields, names, types = _shape(f"conv_id {kind}, {schema}")
    columns = part.select("conv_id", "turn", "role", "text", "gone", "blank", "cut")
    return columns.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).mapInArrow(tidy(run), fields)


def _shape(fields: str) -> tuple[StructType, list[str], list[pa.DataType]]:
    schema = StructType.fromDDL(fields)
    shape = to_arrow_schema(schema)
    return schema, shape.names, shape.types


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(conv: object, rows: list[tuple], faults: list[Row], cost: int, audit: str) -> Iterator[tuple]:
    turns = [t for t, *_ in rows if t is not None]
    blank = sum(r[3] for r in rows)
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in applied(audit, (r[1:3] for r in rows))).encode()).hexdigest()
    yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, sum(m for _, m, _ in faults) - blank, sum(c for *_, c in faults), illegal(i for i, *_ in faults), cost, audit, digest


def _lines(conv: object, rows: list[tuple], faults: list[Row], cost: int, audit: str) -> Iterator[tuple]:
    for k, line in enumerate(applied(audit, (r[1:3] for r in rows))):
        yield conv, 0, k, *line


def _split(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations of at most ``long`` rows, and those of longer ones; None without any."""
    seen = _seen(rows)
    large = written(seen.groupBy("conv_id").count().filter(F.col("count") > long).select(F.col("conv_id").alias("_conv")), "long-conversations")
    if large.isEmpty():
        forget(large)
        return seen, None
    # at most a row in ``long`` names a long conversation, and they are named once
    same = seen["conv_id"].eqNullSafe(large["_conv"])
    return seen.join(large, same, "left_anti"), seen.join(large, same, "left_semi")


def _placed(rows: DataFrame, long: int) -> DataFrame:
    """Rows of long conversations with pos, which grows along each, block (at most ``long`` rows of one conversation) and again: whether role and text came before.

    Rows are dealt by range, so a conversation lies in as many partitions as its rows ask for, even where all of them are equal.
    """
    kept = rows.filter(~F.col("gone")).withColumn("_id", F.monotonically_increasing_id())
    order = ("conv_id", *_ORDER, "_id")
    sorted_ = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    block = F.to_json(F.struct("conv_id", F.floor(F.col("pos") / long).alias("b")))
    same = F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)
    return written(sorted_.select("conv_id", "turn", "role", "text", "blank", "cut", "pos", block.alias("block"), same.alias("same")), "conversation-places")


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    now, held = None, []
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(tuple(row))
    if held:
        yield now, held


def _blocks(placed: DataFrame) -> DataFrame:
    """conv_id, block, at (its first place), edges (first and last initial), counts of faults and ways: structs (q, to, cost, rank, audit), rank orders the audits of one q."""
    first = placed.groupBy("same").agg(F.min("pos").alias("first"))
    light = placed.select("conv_id", "block", "pos", "same", F.substring("role", 1, 1).alias("initial"), "blank", "cut").join(first, "same")
    light = light.select("conv_id", "block", "pos", "initial", "blank", "cut", (F.col("pos") > F.col("first")).alias("again")).repartition("block").sortWithinPartitions("block", "pos")
    kind = placed.schema["conv_id"].dataType.simpleString()
    fields, names, types = _shape(f"conv_id {kind}, block string, at long, edges array<string>, blank long, duplicate long, truncated long, illegal long, ways array<struct<q:int,to:int,cost:long,rank:int,audit:string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _groups(batches, "block", ["conv_id", "pos", "initial", "blank", "cut", "again"]):
            faults = [(i, b or a, c and not b and not a) for _, _, i, b, c, a in held]
            ways = []
            for q in range(4):
                ends = cheapest(faults, q, whole=False)
                ranks = {audit: k for k, audit in enumerate(sorted(a for _, a in ends.values()))}
                ways += [{"q": q, "to": to, "cost": cost, "rank": ranks[audit], "audit": audit} for to, (cost, audit) in ends.items()]
            blank = sum(b for _, _, _, b, _, _ in held)
            yield _batch([(held[0][0], block, held[0][1], [faults[0][0], faults[-1][0]], blank, sum(m for _, m, _ in faults) - blank, sum(c for *_, c in faults), illegal(i for i, *_ in faults), ways)], names, types)

    return written(light.mapInArrow(tidy(run), fields), "conversation-blocks")


def chained(blocks: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost, and (q, to) of each block, of the cheapest chain of the blocks' ways (q, to, cost, rank) with the ASCII-least audit."""
    best: list[dict[int, int]] = [{q: 2 * len(e) for q, e in enumerate(ENDS)}]
    for ways in reversed(blocks):
        here: dict[int, int] = {}
        for q, to, cost, _ in ways:
            if to in best[-1]:
                here[q] = min(here.get(q, cost + best[-1][to]), cost + best[-1][to])
        best.append(here)
    best.reverse()
    q, out = 0, []
    for ways, here, after in zip(blocks, best, best[1:], strict=False):
        _, to = min((rank, to) for p, to, cost, rank in ways if p == q and to in after and cost + after[to] == here[q])
        out.append((q, to))
        q = to
    return best[0][0], out


def _chains(blocks: DataFrame) -> DataFrame:
    """conv_id, block, at, q, audit, cost, borders of every block; cost and borders (illegal pairs between blocks) are its conversation's.

    A task holds 16 costs, not the audits, of each block of a conversation.
    """
    costs = F.transform("ways", lambda w: F.struct(w["q"].alias("q"), w["to"].alias("to"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    lists = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "block", "edges", costs.alias("ways")))).alias("blocks")).select("blocks")
    fields, names, types = _shape("block string, q int, to int, last boolean, cost long, borders long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("blocks"):
                blocks = one.as_py()
                cost, path = chained([[(w["q"], w["to"], w["cost"], w["rank"]) for w in b["ways"]] for b in blocks])
                borders = sum(illegal((x["edges"][1], y["edges"][0])) for x, y in zip(blocks, blocks[1:], strict=False))
                yield _batch([(b["block"], q, to, b is blocks[-1], cost, borders) for b, (q, to) in zip(blocks, path, strict=True)], names, types)

    path = lists.mapInArrow(tidy(run), fields)
    ways = blocks.select("conv_id", "block", "at", F.explode("ways").alias("w")).select("conv_id", "block", "at", "w.q", "w.to", "w.audit")
    ends = F.when(F.col("last"), F.element_at(F.array(*map(F.lit, ENDS)), F.col("to") + 1)).otherwise("")
    return ways.join(path, ["block", "q", "to"]).select("conv_id", "block", "at", "q", F.concat("audit", ends).alias("audit"), "cost", "borders")


def _long_lines(placed: DataFrame, chains: DataFrame) -> DataFrame:
    """conv_id, at, k, edit, role, text: what is left of long conversations, in the order of at and k; a task holds a block."""
    marks = chains.select("conv_id", "block", "at", F.lit(-1).cast("long").alias("pos"), F.col("q").cast("string").alias("role"), F.col("audit").alias("text"))
    rows = placed.select("conv_id", "block", F.lit(None).cast("long").alias("at"), "pos", "role", "text").unionByName(marks)
    kind = placed.schema["conv_id"].dataType.simpleString()
    fields, names, types = _shape(f"conv_id {kind}, at long, k int, edit string, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ((conv, at, q, audit), *held) in _groups(batches, "block", ["conv_id", "at", "role", "text"]):
            lines = [(conv, at, k, *line) for k, line in enumerate(applied(audit, (r[2:] for r in held), int(q)))]
            if lines:
                yield _batch(lines, names, types)

    return rows.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(tidy(run), fields)


def _long_digests(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: a hash runs through its text in order, so a conversation's lines stream through one task, a batch at a time."""
    kind = lines.schema["conv_id"].dataType.simpleString()
    fields, names, types = _shape(f"conv_id {kind}, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        yield _batch([(now, digest.hexdigest())], names, types)
                    now, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
        if digest is not None:
            yield _batch([(now, digest.hexdigest())], names, types)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").mapInArrow(tidy(run), fields)


def _long_report(rows: DataFrame, long: int) -> DataFrame:
    placed = _placed(rows, long)
    blocks = _blocks(placed)
    chains = written(_chains(blocks), "conversation-chains")
    turns = placed.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "")
    parts = [
        rows.select("conv_id").distinct(),
        turns,
        blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal"))),
        chains.groupBy("conv_id").agg(audits.alias("audit"), F.max("cost").alias("cost"), F.max("borders").alias("borders")),
        _long_digests(_long_lines(placed, chains)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = written(whole.groupBy("conv_id").agg(*counts, (F.coalesce(F.max("illegal"), F.lit(0)) + F.coalesce(F.max("borders"), F.lit(0))).alias("illegal"), F.coalesce(F.max("cost"), F.lit(0)).alias("cost"), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), nothing).alias("repaired_sha256")), "conversation-report")
    forget(placed, blocks, chains)
    return out


def repair(rows: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows`` (conv_id, turn, role, text and perhaps gone).

    Rows are taken by turn, nulls first, and by role and text where turns are equal. A row's first fault counts: blank, duplicate (role and text came before in the
    conversation), truncated (it does not end with ``.!?``). gaps is the number of turns between the least and the largest that are not there, illegal the number of neighbours
    whose roles' initials are not su, ua or au. audit has the initials of the cheapest edits, the ASCII-least of them; the hash is that of the
    repaired ``role:text`` joined by newlines. Null roles and texts read as one space; rows without a conv_id are a conversation; rows with ``gone`` true only name
    theirs, and without other rows it has zeros, an empty audit and the empty text's hash. Other columns are ignored. A task holds ``long`` rows at most.
    """
    ship(rows.sparkSession)
    short, longer = _split(rows, long)
    out = _short(short, _report, _REPORT)
    return out if longer is None else out.unionByName(_long_report(longer, long))


def repaired(rows: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, at, k, edit, role, text: the rows that :func:`repair` leaves or inserts, in the order of at and k within a conversation."""
    ship(rows.sparkSession)
    short, longer = _split(rows, long)
    out = _short(short, _lines, "at long, k int, edit string, role string, text string")
    if longer is None:
        return out
    placed = _placed(longer, long)
    return out.unionByName(_long_lines(placed, written(_chains(_blocks(placed)), "conversation-chains")))
