"""Repair of conversations at the least cost, by divide and conquer over cost vectors of four states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, cut, shared_folder, written

# Fixed values of the repair: what each edit costs, and the marks that end a whole turn.
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
ENDINGS = [".", "!", "?"]

#: States of a conversation read so far: empty, after system, after user, after assistant.
STATES = 4
#: Kinds of rows by the role's initial, and faults: none, one that requires deletion, cut off.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, REMOVED, TRUNCATED = range(3)
#: What an inserted turn leads to from each state, and its role.
INSERTED = (2, 2, 3, 2)
#: What may happen at a row, inserts before it included, in the order of ASCII.
WORDS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
NEVER = 1 << 40
#: Rows of a segment: a conversation of more rows consists of several segments.
SEGMENT_BITS = 14


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """For each row type (kind + 4 * fault), from and to state: the least cost, and the number of its least word."""
    cost, word = np.full((12, STATES, STATES), NEVER), np.zeros((12, STATES, STATES), np.int64)
    for kind in range(4):
        for fault in range(3):
            for start in range(STATES):
                at = start
                for inserts in range(3):
                    options = [("D", at, DELETE)]
                    if fault != REMOVED:
                        more = CUT_OFF if fault == TRUNCATED else 0
                        options.append(("R", INSERTED[at], REROLE + more))
                        if (kind, at) == (SYSTEM, 0):
                            options.append(("K", 1, more))
                        elif kind in (USER, ASSISTANT) and INSERTED[at] == kind + 1:
                            options.append(("K", INSERTED[at], more))
                    for edit, to, price in options:
                        new = (inserts * INSERT + price, WORDS.index("I" * inserts + edit))
                        old = cost[kind + 4 * fault, start, to], word[kind + 4 * fault, start, to]
                        if new < old:
                            cost[kind + 4 * fault, start, to], word[kind + 4 * fault, start, to] = new
                    at = INSERTED[at]
    return cost, word


STEP_COST, STEP_WORD = _steps()
#: Inserts that end a conversation, by state, and their cost.
LAST_INSERTS = (0, 2, 1, 0)
LAST_COST = np.array([INSERT * n for n in LAST_INSERTS])


class Items(NamedTuple):
    """A line of items. costs[kind[i]][from][to] is what item i costs; orders says for one `from` which way's
    edits come first in ASCII. Ways from one state are never prefixes of one another."""

    kind: np.ndarray
    costs: np.ndarray
    orders: np.ndarray


def forward(items: Items, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch [low, high) of items from state entry: the cost of the cheapest way to each state, and the
    rank of the ASCII-least of them. All stretches move on together, an item at a time."""
    by_length = np.argsort(low - high, kind="stable")
    low, lengths = low[by_length], (high - low)[by_length]
    cost, rank = np.full((len(low), STATES), NEVER), np.zeros((len(low), STATES), np.int64)
    cost[np.arange(len(low)), entry[by_length]] = 0
    radix, backwards = int(items.orders.max(initial=0)) + 1, -lengths
    for step in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(backwards, -step))  # stretches longer than step
        kind = items.kind[low[:n] + step]
        ways = (cost[:n, :, None] + items.costs[kind]) * STATES + rank[:n, :, None]
        via = ways.argmin(axis=1)
        cost[:n] = np.minimum(np.take_along_axis(ways, via[:, None, :], axis=1)[:, 0] // STATES, NEVER)
        own = np.take_along_axis(items.orders[kind], via[:, None, :], axis=1)[:, 0]
        order = np.take_along_axis(rank[:n], via, axis=1) * radix + own
        rank[:n] = order.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    out_cost, out_rank = np.empty_like(cost), np.empty_like(rank)
    out_cost[by_length], out_rank[by_length] = cost, rank
    return out_cost, out_rank


def backward(items: Items, low: np.ndarray, high: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """For each stretch [low, high): the least cost from each state to state leave behind it."""
    by_length = np.argsort(low - high, kind="stable")
    high, lengths = high[by_length], (high - low)[by_length]
    cost = np.full((len(high), STATES), NEVER)
    cost[np.arange(len(high)), leave[by_length]] = 0
    backwards = -lengths
    for step in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(backwards, -step))
        ways = items.costs[items.kind[high[:n] - step - 1]] + cost[:n, None, :]
        cost[:n] = np.minimum(ways.min(axis=2), NEVER)
    out = np.empty_like(cost)
    out[by_length] = cost
    return out


def crossings(items: Items, low: np.ndarray, high: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The state behind each item on the cheapest way of its stretch, the ASCII-least of these: forward and
    backward vectors meet in the middle; of the optimal crossings that with the least edits before it is
    taken, and both halves follow. Only vectors are kept, no table of all items and states."""
    behind = np.zeros(len(items.kind), np.int8)
    behind[high - 1] = leave
    while True:
        long = high - low > 1
        low, high, entry, leave = low[long], high[long], entry[long], leave[long]
        if not len(low):
            return behind
        middle = (low + high) // 2
        cost, rank = forward(items, low, middle, entry)
        total = (cost + backward(items, middle, high, leave)) * STATES + rank
        state = total.argmin(axis=1)
        behind[middle - 1] = state
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        entry, leave = np.concatenate([entry, state]), np.concatenate([state, leave])


def _line(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def _before(behind: np.ndarray, low: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The state before each item, from those behind them and the entries of the stretches."""
    out = np.empty_like(behind)
    out[1:] = behind[:-1]
    out[low] = entry
    return out


def _legal(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return (first == SYSTEM) & (then == USER) | (first == USER) & (then == ASSISTANT) | (first == ASSISTANT) & (then == USER)


# The steps of a row as one number: 5 * (deleted, kept, user, assistant) + (the inserts before it).
_GONE, _KEPT = 0, 1
_INSERTS = ((), ("user",), ("user", "assistant"), ("assistant",), ("assistant", "user"))


def _inserts(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number in _INSERTS of n turns inserted from a state."""
    return np.where(n == 0, 0, np.where(np.asarray(state) == 2, 2 + n, n))


def _weighed(segments: DataFrame) -> DataFrame:
    """segments(conv, segment, first_at, kinds) with each one's cheapest ways between states."""
    added = "costs array<long>, ranks array<tinyint>, illegal long, head tinyint, tail tinyint"
    schema = T.StructType([*segments.schema.fields, *T.StructType.fromDDL(added).fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind, (low, high) = _kinds(batch.column(3))
            n = len(low)
            items = Items(kind, STEP_COST, STEP_WORD)
            cost, rank = forward(items, np.repeat(low, STATES), np.repeat(high, STATES), np.tile(np.arange(STATES), n))
            role = kind % 4
            bad = np.concatenate([[0], np.cumsum(~_legal(role[:-1], role[1:]))]) if len(role) else np.zeros(1)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * STATES * STATES)
            columns = [
                pa.ListArray.from_arrays(ends, pa.array(cost.ravel())), pa.ListArray.from_arrays(ends, pa.array(rank.ravel().astype(np.int8))),
                pa.array((bad[high - 1] - bad[low]).astype(np.int64)), pa.array(role[low].astype(np.int8)), pa.array(role[high - 1].astype(np.int8)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return segments.mapInArrow(run, schema)


def _kinds(column) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Row types of strings of a letter a row, and where each string's rows lie."""
    texts = column.to_pylist()
    return np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64) - ord("a"), _line(np.fromiter(map(len, texts), np.int64, len(texts)))


def _joined(conversations: DataFrame) -> DataFrame:
    """conversations(conv, parts: array of first_at, costs, ranks, illegal, head, tail, in order) to a row for
    each part: (conv, first_at, entry, leave, last, cost, illegal), the latter two of the conversation."""
    fields = [conversations.schema.fields[0], *T.StructType.fromDDL("first_at long, entry tinyint, leave tinyint, last boolean, cost long, illegal long").fields]
    schema = T.StructType(fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = batch.column(1)
            low, high = _line(np.diff(parts.offsets.to_numpy()).astype(np.int64))
            flat = parts.flatten()
            column = lambda name: flat.field(name)
            table = lambda name: column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATES, STATES).astype(np.int64)
            items = Items(np.arange(len(flat)), table("costs"), table("ranks"))
            start = np.zeros(len(low), np.int64)
            cost, rank = forward(items, low, high, start)
            total = (cost + LAST_COST) * STATES + rank
            leave = total.argmin(axis=1)
            behind = crossings(items, low, high, start, leave)
            head, tail, inside = (column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("head", "tail", "illegal"))
            bad = inside.copy()
            bad[1:] += ~_legal(tail[:-1], head[1:])
            bad[low] = inside[low]
            owner, last = np.repeat(np.arange(len(low)), high - low), np.zeros(len(flat), bool)
            last[high - 1] = True
            illegal = np.bincount(owner, bad, len(low)).astype(np.int64)
            columns = [
                column("first_at"), pa.array(_before(behind, low, start)), pa.array(behind), pa.array(last),
                pa.array(total.min(axis=1)[owner] // STATES), pa.array(illegal[owner]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], schema.names)

    return conversations.mapInArrow(run, schema)


def _solved(segments: DataFrame) -> DataFrame:
    """segments(conv, first_at, entry, leave, last, cost, illegal, kinds) to (conv, first_at, cost, illegal, audit,
    steps, after): after is the number of the inserts that end the conversation."""
    schema = T.StructType([*[segments.schema[c] for c in ("conv", "first_at", "cost", "illegal")], *T.StructType.fromDDL("audit string, steps array<tinyint>, after tinyint").fields])
    words = np.array(WORDS)
    inserts, edit = np.array([len(w) - 1 for w in WORDS]), np.array([w[-1] for w in WORDS])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind, (low, high) = _kinds(batch.column("kinds"))
            entry, leave = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entry", "leave"))
            last = batch.column("last").to_numpy(zero_copy_only=False)
            behind = crossings(Items(kind, STEP_COST, STEP_WORD), low, high, entry, leave)
            before = _before(behind, low, entry)
            word = STEP_WORD[kind, before, behind]
            step = np.where(edit[word] == "D", _GONE, np.where(edit[word] == "K", _KEPT, behind)) * 5 + _inserts(before, inserts[word])
            ending = np.where(last, np.array(LAST_INSERTS)[leave], 0)
            audits = ["".join(words[word[a:b]]) + "I" * int(e) for a, b, e in zip(low, high, ending, strict=True)]
            ends = pa.array(np.concatenate([[0], high]).astype(np.int32))
            steps = pa.ListArray.from_arrays(ends, pa.array(step.astype(np.int8)))
            kept = [batch.column(c) for c in ("conv", "first_at", "cost", "illegal")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(audits, pa.string()), steps, pa.array(_inserts(leave, ending).astype(np.int8))], schema.names)

    return segments.mapInArrow(run, schema)


class Repaired(NamedTuple):
    #: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit)
    reports: DataFrame
    #: (conv, place, turn, role, text, edit): the turns that stay, reroled ones and inserted ones; place orders them.
    turns: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Conversations whose roles become (system)? (user assistant)+, or nothing, by the cheapest edits.

    Edits are Keep, Rerole, Delete and Insert; blank turns and repeats of an earlier role and text are
    deleted, a turn cut off before its end costs more if it stays. Of equally cheap edits those whose
    initials come first in ASCII are made.

    Turns go in order of turn, nulls first, then role and text; rows equal in all of these are repeats. A
    null role or text counts as one space, a null conversation is one like others, roles are told by their
    initial, of which only s, u and a can be kept. Texts of any length are read whole; rows are told equal by
    SHA-256. Other columns are ignored, whatever their names; of an empty table there is no report.

    Rows are dealt by ranges of conversation, turn, role and text, so that a conversation of any length is
    spread over tasks. Each segment of at most 2 ** SEGMENT_BITS rows is weighed from each state to each
    other; the states between a conversation's segments, then those between its rows, are found by crossings.
    A conversation's segments, about 200 bytes each, are the most that one task gathers.
    """
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    told = told.withColumn("tie", F.monotonically_increasing_id())  # spreads equal rows
    dealt = told.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 40), "tie").sortWithinPartitions("conv", "turn", "role", "text").drop("tie")
    ended = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256))
    marked = dealt.withColumns({"at": F.monotonically_increasing_id(), "kind": kind, "blank": ended == "", "open": ~F.substring(ended, -1, 1).isin(ENDINGS), "digest": digest})
    stored = written(marked)  # in order of at

    first = stored.where("not blank").groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    light = stored.select("conv", "turn", "at", "kind", "blank", "open").join(first, "at", "left")
    repeated = ~F.col("blank") & F.col("new").isNull()
    fault = F.when(F.col("blank") | repeated, REMOVED).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    light = light.select("conv", "turn", "at", "blank", repeated.alias("repeated"), (fault == TRUNCATED).alias("truncated"), F.char(F.lit(ord("a")) + F.col("kind") + 4 * fault).alias("letter"))
    light = cut(light)

    counts = light.groupBy("conv", "turn").agg(*[F.count_if(c).alias(c) for c in ("blank", "repeated", "truncated")])
    counts = counts.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(n) for c, n in (("blank", "blank"), ("repeated", "duplicate"), ("truncated", "truncated"))],
    )
    segment = F.shiftright("at", SEGMENT_BITS).alias("segment")
    gathered = light.groupBy("conv", segment).agg(F.sort_array(F.collect_list(F.struct("at", "letter"))).alias("rows"))
    segments = gathered.select("conv", "segment", F.col("rows")[0]["at"].alias("first_at"), F.array_join(F.col("rows.letter"), "").alias("kinds"))
    weighed = written(_weighed(segments))
    parts = F.sort_array(F.collect_list(F.struct("first_at", "costs", "ranks", "illegal", "head", "tail"))).alias("parts")
    joined = _joined(weighed.groupBy("conv").agg(parts))
    solved = written(_solved(joined.join(weighed.select("first_at", "kinds"), "first_at")))

    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_at", "audit"))), lambda x: x["audit"]), "")
    audits = solved.groupBy("conv").agg(F.first("illegal").alias("illegal"), F.first("cost").alias("cost"), pieces.alias("audit"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    both = counts.unionByName(audits, allowMissingColumns=True).groupBy("conv").agg(*[F.max(c).alias(c) for c in names])

    steps = solved.select("first_at", "after", F.size("steps").alias("n"), F.posexplode("steps").alias("i", "step"))
    steps = steps.select((F.col("first_at") + F.col("i")).alias("at"), F.col("step").cast("int").alias("step"), F.when(F.col("i") == F.col("n") - 1, F.col("after")).otherwise(0).cast("int").alias("after"))
    turns = _edited(stored.select("conv", "turn", "at", "role", "text").join(steps, "at"))
    return Repaired(both.select(F.col("conv").alias(conv), *names), turns.withColumnRenamed("conv", conv))


def _edited(rows: DataFrame) -> DataFrame:
    """The turns that rows(conv, turn, at, role, text, step, after) become."""
    turn_type = rows.schema["turn"].dataType
    line = lambda turn, role, text, edit: F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))

    def inserts(number: Column) -> Column:
        said = [F.array(*[line(F.lit(None).cast(turn_type), F.lit(r), F.lit(""), "Insert") for r in roles]) for roles in _INSERTS[1:]]
        none = F.slice(said[0], 1, 0)
        return F.when(number == 0, none).when(number == 1, said[0]).when(number == 2, said[1]).when(number == 3, said[2]).otherwise(said[3])

    done = F.floor(F.col("step") / 5)
    new_role = F.when(done == 2, F.lit("user")).otherwise(F.lit("assistant"))
    kept, reroled = line(F.col("turn"), F.col("role"), F.col("text"), "Keep"), line(F.col("turn"), new_role, F.col("text"), "Rerole")
    own = F.when(done == _GONE, F.slice(F.array(kept), 1, 0)).when(done == _KEPT, F.array(kept)).otherwise(F.array(reroled))
    lines = F.concat(inserts(F.pmod(F.col("step"), F.lit(5))), own, inserts(F.col("after")))
    # Five turns at most come of a row, so that eight places a row are enough.
    out = rows.select("conv", "at", F.posexplode(lines).alias("k", "line"))
    return out.select("conv", (F.col("at") * 8 + F.col("k")).alias("place"), "line.turn", "line.role", "line.text", "line.edit")


def digests(turns: DataFrame, conv: str = "conv_id", out: str = "repaired_sha256") -> DataFrame:
    """SHA-256 of each conversation's `role:text`, joined by newlines. A conversation is read in order and hashed
    turn by turn: its texts pass through one task, as the hash demands, but never lie there together."""
    lines = turns.select(conv, "place", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition(conv).sortWithinPartitions(conv, "place")
    schema = T.StructType([turns.schema[conv], T.StructField(out, T.StringType())])

    def run(batches) -> Iterator:
        import pyarrow as pa

        kind, now, state, begun = None, None, None, False
        for batch in batches:
            kind, names, said = batch.column(0).type, [], []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if begun and name == now:
                    state.update(b"\n")
                else:
                    if begun:
                        names.append(now)
                        said.append(state.hexdigest())
                    now, state, begun = name, hashlib.sha256(), True
                state.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(said, pa.string())], schema.names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], schema.names)

    return ordered.mapInArrow(run, schema)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows with faults of known kinds, by crc32(`conv:turn`) modulo 20: 0 drops a row, 1 empties its text, 2 takes
    its `.!?`, 3 repeats it, 4 makes its role user. Nulls count as one space, but in the ids and turns returned."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    new_text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(known(text), "".join(ENDINGS), "")).otherwise(known(text))
    new_role = F.when(fate == 4, F.lit("user")).otherwise(known(role))
    copies = F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select(F.col(conv), F.col(turn), new_role.alias(role), new_text.alias(text), F.explode(copies).alias("__copy"))
    return out.drop("__copy")
