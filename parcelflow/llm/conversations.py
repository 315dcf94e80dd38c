"""Conversation structure repair by weighted CYK interval parsing.

Edits (keep, rerole, delete, insert) turn a conversation's roles into an optional system turn and then
pairs of user and assistant turns, or into nothing.  The repair grammar in Chomsky normal form has a
nonterminal [p q] for each pair of states of that pattern: [p q] -> [p r] [r q] joins neighbouring spans,
and a row derives [p q] by what is done with it.  A cell holds the least (cost, audit) of each nonterminal
over a span of rows; cells of single rows are closed under insertions on both sides, so rows may be put in
anywhere.  Cells are combined bottom-up by span length.  As every derivation of [p q] can be cut at every
row, all split points of a span give the same cell: one is enough, and only spans of 1, 2, 4, ... rows are
filled.  Audits of equal cost are never prefixes of each other (what one has more would be insertions), so
the least audit of a span is made of the least ones of its parts.

Rows are put in order by ranges of (conversation, turn), so a conversation of any size lies in as many
tasks as it needs; each packs its rows in blocks with the block's cell.  Only cells and edits of blocks meet
by conversation, and the edits go back to the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import partitions, small_batches, stored

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
START, SYSTEM, ASKED, ANSWERED = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
_ENDS = (START, ANSWERED)
_LEGAL = {"su", "ua", "au"}
#: Rows and characters of a block at most; one longer row is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 20
_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans together."""
    out: Cell = {}
    for (p, r), (cost, audit) in a.items():
        for (s, q), (more, rest) in b.items():
            if r == s and ((p, q) not in out or cost + more <= out[p, q][0]):
                new = (cost + more, audit + rest)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _insertions() -> Cell:
    """The least insertions of user and assistant turns that lead from one state to another."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(out.items()):
            for role in "ua":
                if (q := _NEXT.get((r, role))) is not None:
                    out[p, q] = min(out.get((p, q), (1 << 60, "")), (cost + INSERT, audit + "I"))
    return out


EMPTY = _insertions()


@lru_cache(maxsize=None)
def row_cell(code: str) -> Cell:
    """The cell of one row: "f" has to go; else the initial of its role (x: another), in upper case if its text is truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "f":
        extra = TRUNCATED if code.isupper() else 0
        for role, cost, mark in ((code.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            for p in range(4):
                if (q := _NEXT.get((p, role))) is not None:
                    cell[p, q] = min(cell.get((p, q), (1 << 60, "")), (cost + extra, mark))
    return combine(combine(EMPTY, cell), EMPTY)


def join_cells(cells: list[Cell]) -> Cell:
    """The cell of all spans together, by doubling lengths."""
    while len(cells) > 1:
        cells = [combine(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


@lru_cache(maxsize=1 << 14)
def _short(codes: str) -> Cell:
    return join_cells([row_cell(c) for c in codes])


def span_cell(codes: str) -> Cell:
    return join_cells([_short(codes[i : i + 8]) for i in range(0, len(codes), 8)])


def best(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of all rows of a cell."""
    return min(cell[START, q] for q in _ENDS if (START, q) in cell)


def repaired(codes: str, edits: str, roles: list[str], texts: list[str], position: int, system: bool) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that ``edits`` leave of a block; ``roles`` and ``texts`` are of the rows that may stay.

    ``position`` counts the rows left before the block; ``system`` says that the first of all is a system turn.
    """
    out, row, at = [], 0, 0
    for edit in edits:
        turn = "user" if (position + len(out) - system) % 2 == 0 else "assistant"
        if edit == "I":
            out.append((edit, turn, ""))
            continue
        if edit != "D":
            out.append((edit, roles[at] if edit == "K" else turn, texts[at]))
        at += codes[row] != "f"
        row += 1
    return out


def marked(conversations: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, copies) with blank, repeated and truncated; null roles and texts are one space.

    ``repeated`` has the same role and text in an earlier turn.  Of equal rows all but the first are repeated
    too; ``copies`` counts them.  Nothing is ordered: first turns are least ones by group.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"blank": ~F.col("text").rlike(_BLANK), "when": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")), "digest": F.sha2(F.col("text"), 256)})
    first = rows.where("not blank").groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest")).agg(F.min("when").alias("f_when"), F.count("*").alias("f_many")).where("f_many > 1")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    out = rows.join(first, same, "left").withColumn("repeated", ~F.col("blank") & F.col("f_when").isNotNull() & ~F.col("when").eqNullSafe(F.col("f_when")))
    cut = ~F.col("blank") & ~F.col("repeated") & ~F.col("text").rlike(_ENDED)
    return out.withColumn("truncated", cut).select("conv_id", "turn", "role", "text", "copies", "blank", "repeated", "truncated")


_BLOCKS = "conv_id bigint, block int, number bigint, codes string, illegal bigint, first_initial string, last_initial string, roles array<string>, texts array<string>, states array<int>, costs array<bigint>, audits array<string>"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``marked`` in order, packed: a block's codes, the roles and texts of rows that may stay, and its cell.

    A conversation's blocks come by (block, number).  Turns ascend, nulls first; ties go by role and text.
    """
    small_batches(rows.sparkSession)
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    ordered = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text", F.col("copies").cast("bigint").alias("copies"), code.alias("initial"),
        F.when(F.col("blank") | F.col("repeated"), "f").when(F.col("truncated"), F.upper(code)).otherwise(code).alias("code"),
    )
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    ordered = ordered.repartitionByRange(partitions(rows.sparkSession), *keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [c.split()[0] for c in _BLOCKS.split(", ")]
        schema = pa.schema([pa.field("conv_id", pa.int64()), pa.field("block", pa.int32()), pa.field("number", pa.int64()), pa.field("codes", pa.string()), pa.field("illegal", pa.int64()), pa.field("first_initial", pa.string()), pa.field("last_initial", pa.string()),
                            *(pa.field(c, pa.list_(pa.string())) for c in ("roles", "texts")), pa.field("states", pa.list_(pa.int32())), pa.field("costs", pa.list_(pa.int64())), pa.field("audits", pa.list_(pa.string()))])
        number, conv, codes, initials, roles, texts, size = 0, None, [], [], [], [], 0

        def block() -> dict:
            cell = span_cell(line := "".join(codes))
            shape = "".join(initials)
            illegal = sum(a + b not in _LEGAL for a, b in pairwise(shape))
            return dict(zip(names, (conv, part, number, line, illegal, shape[0], shape[-1], list(roles), list(texts), [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()])))

        done, held = [], 0
        for batch in batches:
            for c, role, text, copies, initial, code in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if codes and (c != conv or len(codes) >= BLOCK_ROWS or size + len(text) > BLOCK_CHARS):
                    done.append(block())
                    number, held = number + 1, held + size
                    codes, initials, roles, texts, size = [], [], [], [], 0
                    if len(done) >= 1000 or held > BLOCK_CHARS:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, held = [], 0
                conv = c
                codes.append(code + "f" * (copies - 1))
                initials.append(initial * copies)
                if code != "f":
                    roles.append(role), texts.append(text)
                    size += len(text)
        if codes:
            done.append(block())
        yield pa.RecordBatch.from_pylist(done, schema)

    return ordered.select("conv_id", "role", "text", "copies", "initial", "code").mapInArrow(pack, _BLOCKS)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block", "number")


_EDITS = "conv_id bigint, block int, number bigint, edits string, position bigint, has_system boolean, cost bigint, illegal bigint"


def edits(packed: DataFrame) -> DataFrame:
    """What is done with each block's rows: (conv_id, block, number, edits, position, has_system); cost and illegal are the conversation's, with its first block."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _EDITS.split(", ")]
        schema = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))])

        def conversation(own: list[dict]) -> Iterator[dict]:
            cells = [{divmod(s, 4): (c, a) for s, c, a in zip(b["states"], b["costs"], b["audits"])} for b in own]
            cost, audit = best(join_cells(cells))
            illegal = sum(b["illegal"] for b in own) + sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in pairwise(own))
            marks = np.frombuffer(audit.encode(), np.uint8)
            row_ends = np.flatnonzero(marks != ord("I")) + 1  # a block ends with its last row's edit, the last one with the audit
            stops = row_ends[np.cumsum([len(b["codes"]) for b in own]) - 1]
            stops[-1] = len(audit)
            left = np.concatenate([[0], np.cumsum(marks != ord("D"))])
            head = len(audit) - len(audit.lstrip("D"))  # the first edit that leaves something; so many rows come before it
            system = audit[head : head + 1] == "K" and "".join(b["codes"] for b in own)[head].lower() == "s"
            begin = 0
            for k, (b, stop) in enumerate(zip(own, stops.tolist())):
                yield dict(zip(names, (b["conv_id"], b["block"], b["number"], audit[begin:stop], int(left[begin]), system, cost if k == 0 else None, illegal if k == 0 else None)))
                begin = stop

        own, done = [], []
        for batch in batches:
            for b in batch.to_pylist():
                if own and own[0]["conv_id"] != b["conv_id"]:
                    done += conversation(own)
                    own = []
                own.append(b)
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
        yield pa.RecordBatch.from_pylist(list(conversation(own)) if own else [], schema)

    return _by_conversation(packed.drop("roles", "texts")).mapInArrow(choose, _EDITS)


_PIECES = "conv_id bigint, block int, number bigint, edits string, cost bigint, illegal bigint, position bigint, marks string, roles array<string>, texts array<string>"


def pieces(packed: DataFrame) -> DataFrame:
    """Every block with its edits and the rows they leave: position of the first, one mark each, roles and texts."""
    small_batches(packed.sparkSession)
    e = edits(packed).select(F.col("conv_id").alias("e_conv"), F.col("block").alias("e_block"), F.col("number").alias("e_number"), "edits", "cost", F.col("illegal").alias("all_illegal"), "position", "has_system")
    both = packed.join(e, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("block") == F.col("e_block")) & (F.col("number") == F.col("e_number")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [repaired(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("codes", "edits", "roles", "texts", "position", "has_system")))]
            rows = [batch.column(c) for c in ("conv_id", "block", "number", "edits", "cost", "all_illegal", "position")]
            yield pa.record_batch([*rows, pa.array(["".join(x[0] for x in p) for p in left], pa.string()), *(pa.array([[x[k] for x in p] for p in left], pa.list_(pa.string())) for k in (1, 2))], names=[c.split()[0] for c in _PIECES.split(", ")])

    return both.select("conv_id", "block", "number", "codes", "edits", "cost", "all_illegal", "position", "has_system", "roles", "texts").mapInArrow(apply, _PIECES)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations, one row per turn left or put in: conv_id, position (from 0), edit (K, R or I), role, text.

    Blank turns (no other character than blanks), turns whose role and text came before, and whatever else
    the cheapest repair deletes are gone; a conversation of which nothing is left has no rows.  Turns are
    taken in ascending order, nulls first, ties by role and text.  Null roles and texts count as one space,
    rows with a null conv_id are one conversation; other columns are not read.
    """
    left = pieces(stored(blocks(marked(conversations)), "conversation_blocks"))
    each = left.select("conv_id", "position", "marks", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "turn"))
    return each.select("conv_id", (F.col("position") + F.col("i")).alias("position"), F.substring("marks", F.col("i") + 1, F.lit(1)).alias("edit"), F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def _digests(left: DataFrame) -> DataFrame:
    """Per conversation: cost, audit, illegal and the digest of its repaired rows; its pieces pass one task in order, as a digest needs them."""
    keys = ["conv_id", "cost", "audit", "illegal", "repaired_sha256"]
    schema = pa.schema([pa.field(n, t) for n, t in zip(keys, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for p in batch.to_pylist():
                if now is None or now[0] != p["conv_id"]:
                    if now:
                        done.append(dict(zip(keys, (*now[:2], "".join(now[2]), now[3], now[4].hexdigest()))))
                    now, empty = (p["conv_id"], p["cost"], [], p["illegal"], hashlib.sha256()), True
                now[2].append(p["edits"])
                if p["roles"]:
                    now[4].update(("\n" * (not empty) + "\n".join(f"{r}:{t}" for r, t in zip(p["roles"], p["texts"]))).encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(done, schema)
        yield pa.RecordBatch.from_pylist([dict(zip(keys, (*now[:2], "".join(now[2]), now[3], now[4].hexdigest())))] if now else [], schema)

    return _by_conversation(left.drop("marks", "position")).mapInArrow(digest, "conv_id bigint, cost bigint, audit string, illegal bigint, repaired_sha256 string")


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``ids`` (default: of the rows): gaps, faults, illegal neighbours, cost, audit and digest of its repair.

    ``gaps`` counts numbers missing between the least and the greatest turn.  Each row counts under its
    first fault of blank, duplicate and truncated.  A conversation without rows has zeros, an empty audit
    and the digest of an empty text.  As ``repair`` for the rest.
    """
    rows = marked(conversations)
    mine = F.col("conv_id").cast("bigint").alias("conv_id")
    every = (conversations if ids is None else ids).select(mine).distinct()
    count = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("bigint")
    again = F.when(F.col("repeated"), F.col("copies")).when(~F.col("blank"), F.col("copies") - 1)
    faults = rows.groupBy(mine).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        count(F.when(F.col("blank"), F.col("copies"))).alias("blank"), count(again).alias("duplicate"), count(F.col("truncated").cast("int")).alias("truncated"),
    )
    parsed = _digests(pieces(stored(blocks(rows), "conversation_blocks")))
    out = every
    for table, name in ((faults, "f_id"), (parsed, "p_id")):
        out = out.join(table.withColumnRenamed("conv_id", name), F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of "conv_id:turn" modulo 20, a test of the repair.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks out, 3 repeats
    it, 4 makes its role user.  Nulls count as one space in the key, in roles and in texts.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("one")).drop("one")
