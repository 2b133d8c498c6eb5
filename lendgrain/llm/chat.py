"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation once for every turn it had so far. For each turn a rolling hash (128 bits) of all
turns up to it is formed; a conversation whose whole hash is another's hash at an earlier turn than its last is a
snapshot of that longer one and goes, as do all but the smallest id of equal conversations. What is left is rendered.

The hash is a sum over turns of the turn's hash times a power of an odd base, modulo 2**64, so it can be taken in
parts: turns are sorted over tasks by conversation and turn, a task begins with what the tasks before it have of the
conversation it starts in (one row per task goes through the driver), and a conversation may be as long as it likes.
Both sides of the two anti-joins have one row per hash. Rendered text comes in parts of part_turns turns, so that
no conversation is gathered in one row or task.

Defined cases: turns without a conversation id belong to none and are left out; a null turn number sorts first,
turns with equal numbers go by their hashes; null roles and texts are empty; a marker's opening inside a text is
broken up by a blank; rows that repeat a turn are turns of their own; an empty table gives an empty result; other
columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.llm.hilbert import IN_TASK
from lendgrain.llm.shared import cut, new_folder, staged
from lendgrain.llm.words import WORD_BASES

PART_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
WORD = (1 << 64) - 1


def powers_at(base: int, k: np.ndarray) -> np.ndarray:
    """base**k modulo 2**64, bit by bit of k."""
    out, square = np.ones(len(k), np.uint64), base
    for bit in range(int(k.max(initial=0)).bit_length()):
        out = np.where(k >> bit & 1, out * np.uint64(square), out)
        square = square * square & WORD
    return out


def sorted_turns(turns: DataFrame, folder: str) -> DataFrame:
    """conv_id, role, text, two hashes of each turn, the task it was sorted into and its place there."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}).where("conv_id is not null")
    rows = rows.withColumns({"one": F.xxhash64("role", "text"), "two": F.xxhash64("text", F.lit("turn"), "role")})
    keys = ["conv_id", "turn", "one", "two"]
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("mark", F.monotonically_increasing_id())
    return staged(rows.select("conv_id", "role", "text", "one", "two", "mark"), folder).withColumns({"task": F.shiftright("mark", 33), "place": F.col("mark").bitwiseAND(F.lit(IN_TASK))})


def each_task(rows: DataFrame, tasks: int) -> DataFrame:
    """The hashes of the turns, every sorting task's again together and in order."""
    return rows.select("task", "place", "conv_id", "one", "two").repartition(tasks, "task").sortWithinPartitions("task", "place")


def rolling(conv, one, two, at_conv, at_count, at_sums):
    """Turn numbers and rolling sums of sorted turns, going on from a conversation that was begun before."""
    new = np.r_[len(conv) > 0 and conv[0] != at_conv if at_conv is not None else True, conv[1:] != conv[:-1]]
    start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    k = np.arange(len(conv)) - np.repeat(start, np.diff(np.r_[start, len(conv)]))
    goes_on = len(conv) and not new[0]
    first = int(start[1]) if len(start) > 1 else len(conv)
    if goes_on:
        k[:first] += at_count
    sums = []
    for values, base, before in zip((one, two), WORD_BASES, at_sums):
        total = np.cumsum(values * powers_at(base, k), dtype=np.uint64)
        total = total - np.repeat(np.r_[np.uint64(0), total[start[1:] - 1]], np.diff(np.r_[start, len(conv)]))
        if goes_on:
            total[:first] += np.uint64(before)
        sums.append(total)
    return k, sums


def task_ends(rows: DataFrame, tasks: int) -> DataFrame:
    """For each task its first conversation, and of its last one the number of turns and the sums within the task."""
    def run(batches):
        task = None
        for b in batches:
            numbers = [c.to_numpy() for c in b.columns]
            for t in np.unique(numbers[0]).tolist():
                some = numbers[0] == t
                conv, one, two = numbers[2][some], numbers[3][some].view(np.uint64), numbers[4][some].view(np.uint64)
                if t != task:
                    if task is not None:
                        yield row(task, first, state)
                    task, first, state = t, int(conv[0]), (None, 0, (0, 0))
                k, sums = rolling(conv, one, two, *state)
                state = int(conv[-1]), int(k[-1]) + 1, (int(sums[0][-1]), int(sums[1][-1]))
        if task is not None:
            yield row(task, first, state)

    def row(task, first, state):
        values = [task, first, state[0], state[1], *[x - (1 << 64) if x >> 63 else x for x in state[2]]]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], ["task", "first", "last", "n", "one", "two"])

    return each_task(rows, tasks).mapInArrow(run, "task long, first long, last long, n long, one long, two long")


def carried(ends: list) -> tuple[dict, set]:
    """What each task starts with, and the tasks whose last conversation goes on in the next."""
    start, goes_on, state, before = {}, set(), (None, 0, (0, 0)), None
    for e in sorted(ends, key=lambda e: e.task):
        start[e.task] = state
        if before is not None and state[0] == e.first:
            goes_on.add(before)
        one, two = e.one & WORD, e.two & WORD
        if e.first == e.last == state[0]:  # one conversation from end to end: its turns come after those before
            sums = tuple((s + x * pow(b, state[1], 1 << 64)) & WORD for s, x, b in zip(state[2], (one, two), WORD_BASES))
            state = e.last, state[1] + e.n, sums
        else:
            state = e.last, e.n, (one, two)
        before = e.task
    return start, goes_on


def prefixes(rows: DataFrame, tasks: int, start: dict, goes_on: set) -> DataFrame:
    """For each turn (conv_id, n, one, two, whole): the hash of the first n turns, and whether these are all."""
    def run(batches):
        task, state, held = None, None, None
        for b in batches:
            numbers = [c.to_numpy() for c in b.columns]
            for t in np.unique(numbers[0]).tolist():
                some = numbers[0] == t
                conv = numbers[2][some]
                if t != task:
                    if held is not None:
                        yield out(*held, task not in goes_on)
                    task, state, held = t, start[t], None
                elif held is not None:
                    yield out(*held, held[0][-1] != conv[0])
                k, sums = rolling(conv, numbers[3][some].view(np.uint64), numbers[4][some].view(np.uint64), *state)
                state = int(conv[-1]), int(k[-1]) + 1, (int(sums[0][-1]), int(sums[1][-1]))
                held = conv, k + 1, sums
        if held is not None:
            yield out(*held, task not in goes_on)

    def out(conv, n, sums, ends):
        whole = np.r_[conv[1:] != conv[:-1], ends]
        return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(whole.astype(bool))], ["conv_id", "n", "one", "two", "whole"])

    return each_task(rows, tasks).mapInArrow(run, "conv_id long, n long, one long, two long, whole boolean")


def maximal(rows: DataFrame, folder: str) -> DataFrame:
    """conv_id of the conversations that are no snapshot of another."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start, goes_on = carried(task_ends(rows, tasks).collect())  # one row per task
    found = staged(prefixes(rows, tasks, start, goes_on), f"{folder}/prefixes")
    keys = ["n", "one", "two"]
    # one row for each hash on either side, formed before the shuffle
    whole = found.where("whole").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"))
    inner = found.where("not whole").select(*keys).distinct()
    return whole.join(inner, keys, "left_anti").select("conv_id")


def chats(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", part_turns=PART_TURNS, folder=None) -> DataFrame:
    """conv_id, part (from 0), n_turns and the rendered text of each part of a maximal conversation."""
    folder = folder or new_folder(conversations.sparkSession, "chats")
    c = lambda name, kind: F.col(f"`{name}`").cast(kind)
    rows = sorted_turns(conversations.select(c(conv_col, "long").alias("conv_id"), c(turn_col, "long").alias("turn"), c(role_col, "string").alias("role"), c(text_col, "string").alias("text")), f"{folder}/turns")
    kept = cut(maximal(rows, folder))
    # a turn's number: its place in the task, after the turns of the conversation in earlier tasks
    segments = rows.groupBy("conv_id", "task").agg(F.min("place").alias("first"), F.count("*").alias("n")).join(kept, "conv_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = cut(segments.select("conv_id", "task", "first", before.alias("before")))
    safe = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    turn = F.concat(F.lit(OPEN), F.replace(F.col("role"), F.lit("<|"), F.lit("< |")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))
    numbered = rows.join(segments, ["conv_id", "task"]).select("conv_id", (F.col("before") + F.col("place") - F.col("first")).alias("k"), turn.alias("turn"))
    return numbered.groupBy("conv_id", F.expr(f"k div {part_turns}").alias("part")).agg(
        F.count("*").alias("n_turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "turn"))), lambda x: x["turn"]), "").alias("text"))
