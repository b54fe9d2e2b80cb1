"""Conversation structure repair: the cheapest edits that leave turns in order, by a retained-subsequence DP."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.common import checkpoint

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Role initial that was kept last, "" at the start.
STATES = ("", "s", "u", "a")
_NEVER = 1 << 60
#: Turns to insert between what was kept last (row) and what is kept next (s, u, a).
_BETWEEN = {"": {"s": 0, "u": 0, "a": 1}, "s": {"u": 0, "a": 1}, "u": {"u": 1, "a": 0}, "a": {"u": 0, "a": 1}}
#: Turns to insert after the last one kept.
_AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
#: Rows of a result that are handed on at once.
BATCH = 1024
_ROLES = {"u": "user", "a": "assistant"}

EDITS = "edit string, times bigint, role string, text string, fault string, cost bigint, illegal bigint"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of what is left of a conversation's rows: some are dropped, emptied, cut, repeated or given another role, by a checksum of their place. Nulls are one space."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(given("conv_id"), F.lit(":"), given("turn")), "UTF-8")) % 20
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = rows.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), kind.alias("k")).filter("k <> 0")
    hit = hit.select("conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
    return hit.drop("copy")


def prices(row: tuple) -> dict[str, int]:
    """What it costs to keep a row, or give it another role, by the role initial that it then has. ``row``: initial, fault, times."""
    initial, fault, _ = row
    if fault in ("blank", "duplicate"):
        return {}
    extra = TRUNCATED if fault == "truncated" else 0
    out = {r: REROLE + extra for r in _ROLES}
    if initial in ("s", "u", "a"):
        out[initial] = extra
    return out


def suffix_costs(block: list[tuple], end: dict[str, int]) -> list[dict[str, int]]:
    """The cheapest way through the rest of a block, from each row and with each role kept last, and then on at ``end``.

    From the last row to the first: a row that is kept next closes the gap behind the row kept before it. The gap's deletions are a difference of
    two prefix sums, so one running minimum for each role of the row kept next prices all gaps; the two roles at its ends say how
    many turns are inserted.
    """
    deleted = [0]
    for row in block:
        deleted.append(deleted[-1] + DELETE * row[2])
    best = {r: _NEVER for r in STATES[1:]}
    out = [end]
    for i in range(len(block) - 1, -1, -1):
        for r, price in prices(block[i]).items():
            best[r] = min(best[r], deleted[i] + price + out[-1][r])
        out.append({s: min(deleted[-1] + end[s], *(best[r] + INSERT * n for r, n in _BETWEEN[s].items())) - deleted[i] for s in STATES})
    return out[::-1]


def walk(block: list[tuple], costs: list[dict[str, int]], state: str) -> tuple[list[tuple[int, str, str]], str]:
    """([(inserts before the row, its edit, its role initial)], the state at the end): of the cheapest edits those whose initials are least.

    D stands before I, K and R, so a row goes where that costs nothing more; of rows kept, one behind inserts is less than one without.
    """
    out = []
    for i, row in enumerate(block):
        left = costs[i][state]
        if DELETE * row[2] + costs[i + 1][state] == left:
            out.append((0, "D", ""))
            continue
        ways = ((n, "K" if r == row[0] else "R", r) for r, price in prices(row).items() if (n := _BETWEEN[state].get(r)) is not None and price + INSERT * n + costs[i + 1][r] == left)
        n, edit, state = min(ways, key=lambda w: (w[0] == 0, w[1]))
        out.append((n, edit, state))
    return out, state


def next_role(state: str) -> str:
    return "a" if state == "u" else "u"


def _illegal(pair: str) -> bool:
    return pair not in ("su", "ua", "au")


def facts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, n, initial, fault: each distinct row once, with its number and first fault. What is repeated within a turn is counted before it is shuffled."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    each = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), given(role).alias("role"), given(text).alias("text"))
    each = checkpoint(each.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.sha2("text", 256)))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = each.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    joined = each.join(again, each["conv"].eqNullSafe(again["c"]) & (each["role"] == again["r"]) & (each["digest"] == again["d"]), "left")
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(core == "", "blank").when(F.col("first").isNotNull() & (F.col("first") != order), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
    return joined.select("conv", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _items(rows: list[dict]) -> list[tuple[tuple, dict]]:
    """((initial, fault, times), row) of a block: of rows repeated within a turn, all but the first are duplicates."""
    out = []
    for r in rows:
        gone = r["fault"] in ("blank", "duplicate")
        out.append(((r["initial"], r["fault"], r["n"] if gone else 1), r))
        if r["n"] > 1 and not gone:
            out.append(((r["initial"], "duplicate", r["n"] - 1), r))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[dict]]]:
    """(conv, partition, its rows there) in the order of sorted batches."""
    rows = (r for b in batches for r in b.to_pylist())
    for (conv, part), own in groupby(rows, key=lambda r: (r["conv"], r["part"])):
        yield conv, part, list(own)


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(df: DataFrame, column: str) -> pa.Field:
    return pa.field(column, to_arrow_type(df.schema[column].dataType))


def _passages(spanning: DataFrame) -> dict[tuple[object, int], tuple[str, dict[str, int], str | None, bool]]:
    """For conversations that several partitions hold, by conversation and partition: the state at the entry, the costs behind the end, the initial before, and whether it is the last.

    A piece first tells for each state at its entry what it costs to leave it in each state, and then, once the costs behind each piece are known, in which
    state its edits leave it. A partition holds pieces of at most two such conversations, so the driver gets two short rows a partition, whatever their length.
    """
    conv = _arrow(spanning, "conv")
    kind = spanning.schema["conv"].dataType.simpleString()

    def ask(ends: dict | None) -> list[list]:
        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for key, part, rows in _blocks(batches):
                block = [i for i, _ in _items(rows)]
                if ends is None:
                    tables = {q: suffix_costs(block, {s: 0 if s == q else _NEVER for s in STATES})[0] for q in STATES}
                    through = [tables[q][s] for s in STATES for q in STATES]
                else:
                    costs = suffix_costs(block, ends[key, part])
                    through = [STATES.index(walk(block, costs, s)[1]) for s in STATES]
                yield {"conv": key, "part": part, "through": through, "last": block[-1][0]}

        schema = pa.schema([conv, ("part", pa.int32()), ("through", pa.list_(pa.int64())), ("last", pa.string())])
        found = spanning.select("conv", "part", "initial", "fault", "n").mapInArrow(lambda b: _batched(told(b), schema), f"conv {kind}, part int, through array<bigint>, last string").collect()
        ordered = sorted(found, key=lambda r: (r["conv"] is not None, r["conv"], r["part"]))
        return [list(own) for _, own in groupby(ordered, key=lambda r: r["conv"])]

    ends = {}
    for pieces in ask(None):
        behind = {s: INSERT * _AFTER[s] for s in STATES}
        for p in reversed(pieces):
            ends[p["conv"], p["part"]] = behind
            behind = {s: min(p["through"][i * len(STATES) + k] + behind[q] for k, q in enumerate(STATES)) for i, s in enumerate(STATES)}
    out = {}
    for pieces in ask(ends):
        state, before = "", None
        for p in pieces:
            out[p["conv"], p["part"]] = (state, ends[p["conv"], p["part"]], before, p is pieces[-1])
            state, before = STATES[p["through"][STATES.index(state)]], p["last"]
    return out


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits that repair each conversation, in order: conv, turn, ``part``, ``place``, ``edit``, ``times``, ``role``, ``text``, ``fault``, ``cost``, ``illegal``.

    Rows are taken by turn, nulls first, those of one turn by role and text. A row's first fault counts: blank (white space only), duplicate (role and text seen
    before), truncated (it does not end a sentence). Edits are K(eep), R(erole) to user or assistant, D(elete), which
    blank and duplicate rows need, and I(nsert) of an empty turn; what is left has the role initials ``(s?(ua)+)?``. Of the cheapest edits those
    count whose initials come first. A row of the result stands for ``times`` equal edits; role and text are those after the edit. ``illegal`` counts the row's
    pairs with the one before it, and among its repetitions, that are no su, ua or au.

    Null roles and texts are one space; an empty role fits nowhere; a null conversation is one of its own; empty tables give empty results; further columns are ignored.

    Rows are sorted over all partitions by conversation and place, so that a conversation of any length is cut into pieces: pieces are priced for every state at their
    entry, the driver joins the prices of those that share a conversation, and each piece is edited by itself. A lone row that is repeated is one item
    with a number. What a task holds is bounded by its partition.
    """
    found = facts(rows, conv, turn, role, text)
    order = ["conv", "turn", "role", "text"]
    placed = found.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    placed = checkpoint(placed.withColumn("part", F.spark_partition_id()))
    spans = [r["conv"] for r in placed.groupBy("conv").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").collect()]
    passages = {}
    if spans:
        # at most one conversation runs over each border of two partitions
        named = [s for s in spans if s is not None]
        among = F.col("conv").isin(*named) if named else F.lit(False)
        passages = _passages(placed.filter(among | F.col("conv").isNull() if len(named) < len(spans) else among))
    schema = pa.schema([_arrow(placed, "conv"), ("turn", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("times", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
    kind = placed.schema["conv"].dataType.simpleString()
    edits = placed.mapInArrow(lambda b: _batched(_edits(b, passages), schema), f"conv {kind}, turn bigint, part int, place bigint, {EDITS}")
    return edits.withColumnRenamed("conv", conv)


def _edits(batches: Iterator[pa.RecordBatch], passages: dict) -> Iterator[dict]:
    """The edits of the pieces of sorted batches."""
    ends = {s: INSERT * _AFTER[s] for s in STATES}
    for conv, part, rows in _blocks(batches):
        state, end, last, final = passages.get((conv, part), ("", ends, None, True))
        items = _items(rows)
        block = [i for i, _ in items]
        out: list[tuple] = []

        def insert(n: int, after: str, out: list = out) -> None:
            for _ in range(n):
                after = next_role(after)
                out.append((None, "I", 1, _ROLES[after], "", None, INSERT, 0))

        edits, left = walk(block, suffix_costs(block, end), state)
        for ((initial, fault, times), row), (n, edit, kept) in zip(items, edits, strict=True):
            illegal = int(last is not None and _illegal(last + initial)) + times - 1
            last = initial
            insert(n, state)
            if edit == "D":
                out.append((row["turn"], "D", times, row["role"], row["text"], fault, DELETE * times, illegal))
            else:
                out.append((row["turn"], edit, 1, row["role"] if edit == "K" else _ROLES[kept], row["text"], fault, prices((initial, fault, 1))[kept], illegal))
                state = kept
        if final:
            insert(_AFTER[left], left)
        for place, values in enumerate(out):
            yield dict(zip(("turn", "edit", "times", "role", "text", "fault", "cost", "illegal"), values, strict=True), conv=conv, part=part, place=place)


def summaries(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of ``repair``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Edits are read in order, one after the other; a digest over a whole conversation can't be taken otherwise, but nothing of it is held save the
    initials of its edits.
    """
    ordered = edits.withColumnRenamed(conv, "conv").repartition("conv").sortWithinPartitions("conv", "part", "place")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([_arrow(ordered, "conv"), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    kind = ordered.schema["conv"].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for r in b.to_pylist())
        for key, own in groupby(rows, key=lambda r: r["conv"]):
            out = {"conv": key, **dict.fromkeys(counts, 0)}
            low = high = None
            audit, digest, first = [], hashlib.sha256(), True
            for r in own:
                audit.append(r["edit"] * r["times"])
                out["illegal"] += r["illegal"]
                out["cost"] += r["cost"]
                if r["fault"]:
                    out[r["fault"]] += r["times"]
                if r["turn"] is not None:
                    out["gaps"] -= r["turn"] != high
                    low, high = r["turn"] if low is None else low, r["turn"]
                if r["edit"] != "D":
                    digest.update(f"{'' if first else chr(10)}{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
                    first = False
            out["gaps"] += high - low + 1 if low is not None else 0
            yield out | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    named = ordered.select("conv", "turn", "edit", "times", "role", "text", "fault", "cost", "illegal")
    columns = f"conv {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    return named.mapInArrow(lambda b: _batched(told(b), schema), columns).withColumnRenamed("conv", conv)


def repair_summaries(rows: DataFrame, kept: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``summaries`` of the repaired ``rows`` for every conversation of ``kept``: those without rows have zeros and an empty audit."""
    found = summaries(repair(rows, conv), conv).withColumnRenamed(conv, "_own")
    every = kept.select(conv).distinct()
    joined = every.join(found, every[conv].eqNullSafe(found["_own"]), "left").drop("_own")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": empty})
