"""Operator 11: repair of a conversation's role structure by Hirschberg's divide and conquer.

Rows of a conversation are kept (K), given another role (R), deleted (D), and rows without text are
inserted (I), at the least cost, so that the role initials spell ``(s?(ua)+)?``. Four states say what
came last: nothing, system, user, assistant. What R and I write follows from the state, so an audit,
the string of edit letters, is the whole repair.

A forward vector holds for each state the least cost of arriving there with the rows so far used up,
and the rank of its audit among those of the four states: two such audits are never prefixes of each
other, so ranks alone say which is less in ASCII after any further edits. A backward vector holds the
least cost of ending well from each state. They meet in the middle; of the states with the least sum
the one of the least rank is crossed, and both halves recurse with vectors alone in memory.

Conversations come in pieces of at most PIECE rows. A piece is summed up by the costs and ranks from
each state to each state; pieces of one long conversation are crossed by the same recursion, with
such summaries in the place of rows, and then each piece is repaired by itself between its two
states. So a conversation of any length spreads over tasks. Only the rows' texts pass through one
sorted stream per conversation at the end, in bounded memory, because a reader wants them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import materialize

PIECE = 65536
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What a row must or may cost beside its edit.
PLAIN, DOOMED, CUT = range(3)
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FAR = 1 << 60
#: Any state's best end is within 10 of any other's, so what is this far behind is never on a cheapest path.
BEHIND = 64

Vector = tuple[tuple[int, int], ...]


class Costs(NamedTuple):
    """From each state to each state: least cost and what orders audits that leave one state."""

    cost: tuple[tuple[int, ...], ...]
    order: tuple[tuple, ...]


def after(state: int, initial: int | None) -> int | None:
    """State after a row with this initial (0 s, 1 u, 2 a, other), or after R or I (None)."""
    if initial is None:
        return ASSISTANT if state == USER else USER
    if initial == 0:
        return SYSTEM if state == NONE else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def _row_costs(initial: int, fate: int) -> Costs:
    found: list[list[tuple[int, str]]] = [[(FAR, "")] * 4 for _ in range(4)]
    extra = TRUNCATED if fate == CUT else 0
    for entry in range(4):
        state, word, cost = entry, "", 0
        for _ in range(3):  # two insertions reach whatever more would
            ways = [(DELETE, "D", state)]
            if fate != DOOMED:
                ways += [(KEEP + extra, "K", after(state, initial)), (REROLE + extra, "R", after(state, None))]
            for price, letter, end in ways:
                if end is not None:
                    found[entry][end] = min(found[entry][end], (cost + price, word + letter))
            state, word, cost = after(state, None), word + "I", cost + INSERT
    return Costs(tuple(tuple(c for c, _ in r) for r in found), tuple(tuple(w for _, w in r) for r in found))


ROWS = [_row_costs(kind % 4, kind // 4) for kind in range(12)]
#: Cost of ending the conversation in a state, by insertions.
ENDS = (0, 2 * INSERT, INSERT, 0)


def at(state: int) -> Vector:
    return tuple((0, 0) if s == state else (FAR, 0) for s in range(4))


def only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else FAR for s in range(4))


def advance(vector: Vector, element: Costs) -> tuple[Vector, int]:
    """Forward vector behind one more element, less its smallest cost, and that cost."""
    best = []
    for t in range(4):
        ways = [(c + element.cost[s][t], rank, element.order[s][t])
                for s, (c, rank) in enumerate(vector) if c < FAR and element.cost[s][t] < FAR]
        best.append(min(ways, default=None))
    low = min(b[0] for b in best if b)
    best = [b if b and b[0] - low <= BEHIND else None for b in best]
    ranks = {key: k for k, key in enumerate(sorted({b[1:] for b in best if b}))}
    return tuple((b[0] - low, ranks[b[1:]]) if b else (FAR, 0) for b in best), low


def retreat(ends: tuple[int, ...], element: Costs) -> tuple[tuple[int, ...], int]:
    """Backward vector before one more element, less its smallest cost, and that cost."""
    out = [min(min(c + e, FAR) for c, e in zip(element.cost[s], ends, strict=True)) for s in range(4)]
    low = min(out)
    return (tuple(c - low if c < FAR else FAR for c in out), low) if low < FAR else (tuple(out), 0)


class Repairer:
    """Hirschberg's recursion over elements; of rows, few vectors occur and steps are remembered."""

    def __init__(self, elements, remember: bool):
        self.elements = elements
        self.forward = lambda vector, code: advance(vector, elements[code])
        self.backward = lambda ends, code: retreat(ends, elements[code])
        if remember:
            self.forward, self.backward = lru_cache(65536)(self.forward), lru_cache(65536)(self.backward)

    def ahead(self, codes, state: int) -> tuple[Vector, int]:
        vector, total = at(state), 0
        for code in codes:
            vector, cost = self.forward(vector, code)
            total += cost
        return vector, total

    def behind(self, codes, ends: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        total = 0
        for code in reversed(codes):
            ends, cost = self.backward(ends, code)
            total += cost
        return ends, total

    def crossings(self, codes: list[int], state: int, ends: tuple[int, ...]) -> list[int]:
        """State behind each element on the cheapest path, of those the one of the least audit."""
        states = [0] * len(codes)
        pending = [(0, len(codes), state, ends)]
        while pending:
            lo, hi, entry, ends = pending.pop()
            if hi - lo == 1:
                element = self.elements[codes[lo]]
                states[lo] = min(range(4), key=lambda t: (
                    min(element.cost[entry][t] + ends[t], FAR), element.order[entry][t]))
                continue
            mid = (lo + hi) // 2
            front, _ = self.ahead(codes[lo:mid], entry)
            back, _ = self.behind(codes[mid:hi], ends)
            cross = min((s for s in range(4) if front[s][0] < FAR and back[s] < FAR),
                        key=lambda s: (front[s][0] + back[s], front[s][1]))
            pending += [(lo, mid, entry, only(cross)), (mid, hi, cross, ends)]
        return states

    def summary(self, codes: list[int]) -> tuple[list[int], list[int]]:
        """Costs and audit ranks from each state to each state, row by row."""
        cost, rank = [], []
        for entry in range(4):
            vector, total = self.ahead(codes, entry)
            cost += [total + c if c < FAR else FAR for c, _ in vector]
            rank += [r for _, r in vector]
        return cost, rank


@lru_cache(1)
def of_rows() -> Repairer:
    return Repairer(ROWS, remember=True)


def edits(codes: list[int], entry: int, ends: tuple[int, ...], last: bool) -> tuple[str, int]:
    """Audit of rows between two states, with the closing insertions if they are the last; its cost."""
    words, cost, state = [], 0, entry
    for code, end in zip(codes, of_rows().crossings(codes, entry, ends), strict=True):
        words.append(ROWS[code].order[state][end])
        cost += ROWS[code].cost[state][end]
        state = end
    if last:
        words.append("I" * (ENDS[state] // INSERT))
        cost += ENDS[state]
    return "".join(words), cost


def ordered_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest; null roles and texts become one space."""
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def marks(rows: DataFrame, piece: int) -> DataFrame:
    """conv_id, piece, position, turn and code (initial and fault) of every row; no texts."""
    bare = f"trim(TRAILING '{SPACE}' FROM text)"
    slim = rows.selectExpr(
        "conv_id", "turn", "role", "digest",
        "CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial",
        f"{bare} = '' AS blank", f"right({bare}, 1) NOT IN ('.', '!', '?') AS truncated")
    placed = number_rows(
        slim, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")],
        partition_by=["conv_id"], name="position")
    placed = materialize(placed, "turns")
    # the first of its kind by its position: a unique key, so no text that repeats is a hot one
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("position").alias("position"))
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("position").alias("first"), F.lit(True).alias("new"))
    same = placed["conv_id"].eqNullSafe(firsts["of"]) & (placed["position"] == firsts["first"])
    return placed.join(firsts, same, "left").selectExpr(
        "conv_id", f"(position - 1) div {piece} AS piece", "position", "turn", "initial",
        "CASE WHEN blank THEN 1 WHEN new IS NULL THEN 2 WHEN truncated THEN 3 ELSE 0 END AS fault")


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        starts = [0] + [k for k in range(1, len(rows)) if rows[k] != rows[k - 1]] + [len(rows)]
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            if held and rows[begin] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = rows[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


PIECES = ("conv_id bigint, piece bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, "
          "illegal bigint, first_initial int, last_initial int, turns bigint, first_turn bigint, "
          "last_turn bigint, audit string, cost bigint, costs array<bigint>, ranks array<bigint>")


def legal(left, right):
    return ((left == 0) | (left == 2)) & (right == 1) | (left == 1) & (right == 2)


def sum_up(piece: int):
    """Figures of every piece; the audit too where the piece is the whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in grouped(batches, "conv_id", "piece"):
            initial = rows.column("initial").to_numpy()
            fault = rows.column("fault").to_numpy()
            codes = codes_of(initial, fault)
            turns = rows.column("turn").drop_null().to_numpy()
            number = rows.column("piece")[0].as_py()
            whole = number == 0 and len(codes) < piece
            audit, cost, costs, ranks = None, None, None, None
            if whole:
                audit, cost = edits(codes, NONE, ENDS, last=True)
            else:
                costs, ranks = of_rows().summary(codes)
            out.append((
                rows.column("conv_id")[0].as_py(), number, len(codes), *[int((fault == k).sum()) for k in (1, 2, 3)],
                int((~legal(initial[:-1], initial[1:])).sum()), int(initial[0]), int(initial[-1]),
                int((turns[1:] != turns[:-1]).sum() + 1) if len(turns) else 0,
                int(turns[0]) if len(turns) else None, int(turns[-1]) if len(turns) else None,
                audit, cost, costs, ranks))
            if len(out) == 1024:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


_PIECE_TYPES = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()] * 3 + [
    pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_PIECE_TYPES)
    names = [part.split()[0] for part in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], names)


def codes_of(initial: np.ndarray, fault: np.ndarray) -> list[int]:
    fate = np.array([PLAIN, DOOMED, DOOMED, CUT])[fault]
    return (initial + 4 * fate).tolist()


def cross_pieces(table: pa.Table) -> pa.Table:
    """Entry and exit state of every piece of one conversation."""
    table = table.sort_by("piece")
    square = [np.array(c).reshape(-1, 4, 4).tolist() for c in (
        table.column("costs").to_pylist(), table.column("ranks").to_pylist())]
    elements = [Costs(cost, rank) for cost, rank in zip(*square, strict=True)]
    states = Repairer(elements, remember=False).crossings(list(range(len(elements))), NONE, ENDS)
    last = [False] * (len(states) - 1) + [True]
    return pa.table({
        "conv_id": table.column("conv_id"), "piece": table.column("piece"),
        "entry": pa.array([NONE, *states[:-1]], pa.int32()), "exit": pa.array(states, pa.int32()),
        "last": pa.array(last, pa.bool_())})


def repair_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "conv_id", "piece"):
        entry, end, last = (rows.column(c)[0].as_py() for c in ("entry", "exit", "last"))
        codes = codes_of(rows.column("initial").to_numpy(), rows.column("fault").to_numpy())
        audit, cost = edits(codes, entry, only(end), last)
        yield pa.RecordBatch.from_pydict({
            "of": pa.array([rows.column("conv_id")[0].as_py()], pa.int64()),
            "of_piece": pa.array([rows.column("piece")[0].as_py()], pa.int64()),
            "own_audit": pa.array([audit], pa.string()), "own_cost": pa.array([cost], pa.int64())})


def in_pieces(rows: DataFrame) -> DataFrame:
    # rows are small and the work on them is not: a number of tasks that is not put together by size
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "position")


def report(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation."""
    marked = materialize(marks(rows, piece), "marks")
    pieces = materialize(in_pieces(marked).mapInArrow(sum_up(piece), PIECES), "pieces")
    parts = pieces.drop("costs", "ranks")
    pending = pieces.where("audit IS NULL")
    if not pending.isEmpty():
        states = pending.select("conv_id", "piece", "costs", "ranks").groupBy("conv_id").applyInArrow(
            cross_pieces, "conv_id bigint, piece bigint, entry int, exit int, last boolean")
        states = materialize(states, "crossings").withColumnsRenamed({"conv_id": "of", "piece": "of_piece"})
        of = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("of_piece"))
        solved = in_pieces(marked.join(states, of).drop("of", "of_piece")).mapInArrow(
            repair_pieces, "of bigint, of_piece bigint, own_audit string, own_cost bigint")
        parts = parts.join(solved, of, "left").withColumns({
            "audit": F.coalesce("audit", "own_audit"), "cost": F.coalesce("cost", "own_cost")})
    # one row per PIECE rows of a conversation, put together in order
    listed = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "piece", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turns",
        "first_turn", "last_turn", "audit", "cost"))).alias("p"))
    borders = ("CASE WHEN size(p) > 1 THEN aggregate(transform(sequence(1, size(p) - 1), k -> {}), "
               "0L, (n, x) -> n + x) ELSE 0L END")
    legal_pair = ("((p[k - 1].last_initial IN (0, 2) AND p[k].first_initial = 1) OR "
                  "(p[k - 1].last_initial = 1 AND p[k].first_initial = 2))")
    total = "aggregate(p, 0L, (n, x) -> n + x.{})"
    return listed.selectExpr(
        "conv_id",
        "coalesce(array_max(p.last_turn) - array_min(p.first_turn) + 1 - (" + total.format("turns") + " - "
        + borders.format("CAST(coalesce(p[k - 1].last_turn = p[k].first_turn, false) AS bigint)")
        + "), 0L) AS gaps",
        *[total.format(c) + f" AS {c}" for c in ("blank", "duplicate", "truncated")],
        total.format("illegal") + " + " + borders.format(f"CAST(NOT {legal_pair} AS bigint)") + " AS illegal",
        total.format("cost") + " AS cost", "array_join(p.audit, '') AS audit")


REPAIRED = "conv_id bigint, place bigint, edit string, role string, text string"


def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repaired conversations: of each, its audit comes first and then its rows in order."""
    audit, used, rest, place, state = "", 0, 0, 0, NONE
    for batch in batches:
        out: list[tuple] = []

        def emit(conv, letter, role, text):
            nonlocal place
            place += 1
            out.append((conv, place, letter, role, text))

        conv_ids, plans, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))
        for conv, plan, role, text in zip(conv_ids, plans, roles, texts, strict=True):
            if plan is not None:
                # what follows the last letter for a row is inserted after the last row
                audit, used, rest, place, state = plan, 0, len(plan.rstrip("I")), 0, NONE
                continue
            while True:
                letter = audit[used]
                used += 1
                if letter == "K":
                    state = after(state, "sua".find(role[0]))
                    emit(conv, letter, role, text)
                elif letter != "D":
                    state = after(state, None)
                    emit(conv, letter, WRITTEN[state], text if letter == "R" else "")
                if letter != "I":
                    break
            if used == rest:
                for letter in audit[rest:]:
                    state = after(state, None)
                    emit(conv, letter, WRITTEN[state], "")
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "role", "text"])


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the repaired conversations, each conversation in order within one partition."""
    empty = "CAST(NULL AS bigint) AS turn, CAST(NULL AS string) AS role, CAST(NULL AS string) AS text"
    plans = found.selectExpr("conv_id", "0 AS part", "audit", *empty.split(", "), "CAST(NULL AS binary) AS digest")
    turns = rows.selectExpr("conv_id", "1 AS part", "CAST(NULL AS string) AS audit", "turn", "role", "text", "digest")
    order = ["conv_id", "part", F.asc_nulls_first("turn"), "role", "digest"]
    stream = plans.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order)
    return stream.select("conv_id", "audit", "role", "text").mapInArrow(write_out, REPAIRED)


class Repair(NamedTuple):
    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, piece: int = PIECE) -> Repair:
    """Report and rows of repaired conversations.

    Rows go by turn, null turns first; rows of one turn by role, then by the SHA-256 of the text, so
    repeated rows are neighbours. A row is blank without a character that is not ASCII white space,
    else a duplicate if its role and text came before in its conversation, else truncated if its last
    such character is none of ``.!?``. Null roles and texts count as one space; rows of a null
    conv_id are one conversation. An empty table gives empty tables. Texts may be of any length: each
    is held alone, and the order of a conversation's rows never needs them together. Only conv_id,
    turn, role and text are read.
    """
    rows = ordered_rows(rows)
    found = materialize(report(rows, piece), "repairs")
    return Repair(found, repaired_rows(rows, found))


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, from rows as ``repair`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, conv = None, None
        for batch in batches:
            done = []
            for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in (
                    "conv_id", "place", "role", "text")), strict=True):
                if place == 1:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    digest, conv = hashlib.sha256(), c
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _hashes(done)
        yield _hashes([] if digest is None else [(conv, digest.hexdigest())])

    return repaired.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())],
        ["conv_id", "repaired_sha256"])


def damage(rows: DataFrame) -> DataFrame:
    """Rows with one of five faults, chosen by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    cells = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = "concat_ws(':', coalesce(CAST(conv_id AS string), ' '), coalesce(CAST(turn AS string), ' '))"
    drawn = cells.withColumn("draw", F.expr(f"crc32({key}) % 20")).where("draw <> 0")
    return drawn.selectExpr(
        "conv_id", "turn", "CASE WHEN draw = 4 THEN 'user' ELSE role END AS role",
        "CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(CASE WHEN draw = 3 THEN array(1, 2) ELSE array(1) END) AS copy").drop("copy")


def repair_damaged(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The report on the damaged rows and each repaired conversation's hash, for every conv_id of ``rows``.

    A conversation that lost all its rows has zeros, an empty audit and the hash of the empty string.
    """
    fixed = repair(damage(rows), piece)
    hashes = conversation_hashes(fixed.rows).withColumnRenamed("conv_id", "hashed")
    ids = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found = fixed.report.withColumnRenamed("conv_id", "found")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")) & F.col("audit").isNotNull(), "left")
    joined = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed")) & F.col("repaired_sha256").isNotNull(), "left")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in figures],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
