"""Conversation structure repair: the cheapest edits that make roles alternate, by whole-number shortest paths.

A path's weight is one integer. Its high digits are the cost; its low digits are the audit, three bits a letter (D 1, I 2, K 3, R 4: as ASCII
sorts them), the first letter highest, zeros behind the last. A letter's place is fixed by the number of letters before it, and all
paths to one node cover the same rows, so none of two equally dear ones begins the other; the smallest integer is
therefore the cheapest path, and of those the one whose letters sort first. Nodes are (rows done, state): nothing yet, after a system
row, after a user's, after an assistant's. Two inserts in a row are never cheapest, so each gap has one at most.

Rows are sorted by ranges of (conversation, turn, role, text), so a long conversation, or one with many equal rows, lies in many
tasks. Each cuts its part into blocks of bounded size. A conversation inside one block is done there. Of the others each block becomes a
layer of edges (state before, state after) with a weight each, layers are composed 64 at a time in rounds, and the chosen audit goes back to the
blocks, which write their repaired text; only these texts' hash, a chain by its nature, is taken in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stored

#: Rows and characters that one block holds at most (a longer row is a block of its own), and layers that are composed at once.
BLOCK_ROWS, BLOCK_CHARS, AT_ONCE = 2_000, 4_000_000, 64
#: What an edit costs, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to, and the role that an insert or a changed row has, by state.
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
ROW_FAULTS = ("", "blank", "duplicate", "truncated")

Edge = tuple[int, int, int, int, int]  # from, to, cost, letters as digits, number of letters


def _edges(initial: str, fault: str) -> list[Edge]:
    """What can be done with one row, with or without an insert before it."""
    out = []
    for state in (START, SYSTEM, USER, ASSISTANT):
        for lead in ("", "I"):
            at = NEXT[WANTED[state][0], state] if lead else state
            ways = [("D", at, DELETE)]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                ways.append(("R", NEXT[WANTED[at][0], at], REROLE + extra))
                if (initial, at) in NEXT:
                    ways.append(("K", NEXT[initial, at], KEEP + extra))
            out += [(state, to, cost + INSERT * len(lead), digits(lead + way), len(lead) + 1) for way, to, cost in ways]
    return out


def digits(letters: str) -> int:
    return int("0" + "".join(str(DIGIT[c]) for c in letters), 8)


EDGES = {(i, f): _edges(i, f) for i in ("s", "u", "a", "") for f in ROW_FAULTS}
#: After the last row: nothing, or an insert.
TAIL: list[Edge] = [(s, s, 0, 0, 0) for s in WANTED] + [(s, NEXT[WANTED[s][0], s], INSERT, DIGIT["I"], 1) for s in WANTED]


def shortest(layers: Iterable[list[Edge]], start: int, width: int, trails: bool = False) -> dict[int, tuple[int, int, tuple]]:
    """By last state: the least weight of the paths through all ``layers``, its number of letters, and (if asked for) the edges'
    numbers, last first, as nested pairs. ``width`` letters have a place."""
    best: dict[int, tuple[int, int, tuple]] = {start: (0, 0, ())}
    high = 3 * width
    for layer in layers:
        new: dict[int, tuple[int, int, tuple]] = {}
        for k, (a, b, cost, letters, n) in enumerate(layer):
            before = best.get(a)
            if before is not None:
                used = before[1] + n
                weight = before[0] + (cost << high) + (letters << (high - 3 * used))
                if b not in new or weight < new[b][0]:
                    new[b] = weight, used, (before[2], k) if trails else ()
        best = new
    return best


def read_weight(weight: int, used: int, width: int) -> tuple[int, str]:
    """Cost and audit."""
    low = (weight & ((1 << 3 * width) - 1)) >> 3 * (width - used)
    return weight >> 3 * width, oct(low)[2:].translate({49: "D", 50: "I", 51: "K", 52: "R"}) if used else ""


def accepted(best: dict[int, tuple[int, int, tuple]]) -> tuple[int, int, tuple]:
    """The best of the paths that end with an assistant's row, or without any."""
    return min(best[s] for s in (START, ASSISTANT) if s in best)


def repair(rows: list[tuple[str, str]], faults: list[str]) -> tuple[int, str]:
    """Cost and audit of one whole conversation."""
    width = 2 * len(rows) + 1
    weight, used, _ = accepted(shortest([*(EDGES[_initial(r), f] for (r, _), f in zip(rows, faults)), TAIL], START, width))
    return read_weight(weight, used, width)


def _initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else ""


def apply(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """The repaired ``role:text`` of rows that begin in ``state``."""
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = WANTED[state]
        state = NEXT[role[0], state]
        out.append(f"{role}:{text}")
    return out


class Facts:
    """What adjacent rows have between them: gaps in turns and illegal pairs, of a block or of blocks in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, other: Facts) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.first_initial is not None:
            self.illegal += self.last_initial is not None and self.last_initial + other.first_initial not in ("su", "ua", "au")
            self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
            self.last_initial = other.last_initial
        if other.first_turn is not None:
            self.turns -= self.last_turn == other.first_turn
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def facts_of(turns: list[int | None], roles: list[str], faults: list[str]) -> Facts:
    out = Facts()
    for turn, role, fault in zip(turns, roles, faults):
        one = Facts()
        one.first_turn = one.last_turn = turn
        one.turns = turn is not None
        one.first_initial = one.last_initial = role[:1]
        if fault:
            setattr(one, fault, 1)
        out.add(one)
    return out


def faults_of(rows: list[tuple[str, str]], truncated: list[bool], repeated: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """First fault of each row; ``repeated`` are rows whose like is in an earlier block."""
    seen, out = set(), []
    for k, (row, cut) in enumerate(zip(rows, truncated)):
        blank = not row[1].strip(BLANKS)
        out.append("blank" if blank else "duplicate" if k in repeated or row in seen else "truncated" if cut else "")
        seen.add(row)
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as damaged by ``crc32(conv_id:turn) % 20``, ``times`` (0 to 2) and ``cut`` (truncated). Nulls of role
    and text, and in the hashed key, are one space."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    shown = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))
    return shown.withColumn("cut", ~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Sorted by ranges of (conv_id, turn, role, text); texts of equal first 64 characters by their MD5, equal rows by an arbitrary salt."""
    keys = ["conv_id", "turn", "role", "head", "md5", "salt"]
    keyed = rows.withColumns({"head": F.substring("text", 1, 64), "md5": F.md5(F.col("text").cast("binary")), "salt": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "times", "cut")


ROW = "struct<turn: bigint, role: string, text: string, cut: boolean>"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _closed(rows: list[tuple]) -> tuple:
    pairs = [(r[1], r[2]) for r in rows]
    faults = faults_of(pairs, [r[3] for r in rows])
    facts = facts_of([r[0] for r in rows], [r[1] for r in rows], faults)
    cost, audit = repair(pairs, faults)
    return facts.gaps, facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, hashlib.sha256("\n".join(apply(pairs, audit, START)).encode()).hexdigest()


def _cut_blocks(schema: pa.Schema):
    """Streams sorted rows into finished conversations, and into blocks of those that may go on in another block or task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        out: list[tuple] = []
        held: list[tuple] = []
        conv, size, alone, began = None, 0, False, False  # alone: the conversation began here, and not as the task's first

        def finish(last: bool) -> None:
            nonlocal number, held, size, alone
            if began:
                whole = alone and last
                out.append((conv, None, None, *_closed(held)) if whole else (conv, base + number, [dict(zip(("turn", "role", "text", "cut"), r)) for r in held], *[None] * 8))
                number += 1
            held, size, alone = [], 0, False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for c, turn, role, text, times, cut in zip(*(batch[k].to_pylist() for k in range(6))):
                if not began or c != conv:
                    first = not began
                    finish(last=True)
                    conv, alone, began = c, not first, True
                for _ in range(times):
                    if held and (len(held) >= BLOCK_ROWS or size + len(text) > BLOCK_CHARS):
                        finish(last=False)
                    held.append((turn, role, text, cut))
                    size += len(text)
            if out:
                yield batch_of(out)
                out = []
        finish(last=False)  # the task's last conversation may go on in the next one
        if out:
            yield batch_of(out)

    return run


SOLVED = (
    "conv_id {kind}, ck string, block long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string,"
    " edges array<struct<a: int, b: int, cost: long, audit: string, exits: array<int>, lengths: array<int>>>"
)
_FACTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")


def _solve(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block's facts and edges."""
    for batch in rows:
        out = []
        for conv, ck, block, own, repeated in zip(batch["conv_id"], batch["ck"], batch["block"], batch["rows"], batch["repeated"]):
            pairs = [(r["role"], r["text"]) for r in own]
            faults = faults_of(pairs, [r["cut"] for r in own], set() if repeated is None else set(repeated))
            facts = facts_of([None if pd.isna(r["turn"]) else int(r["turn"]) for r in own], [r["role"] for r in own], faults)
            width, edges = 2 * len(pairs), []
            for start in WANTED:
                for end, (weight, used, _) in shortest((EDGES[_initial(r), f] for (r, _), f in zip(pairs, faults)), start, width).items():
                    cost, audit = read_weight(weight, used, width)
                    edges.append({"a": start, "b": end, "cost": cost, "audit": audit, "exits": [end], "lengths": [used]})
            out.append((conv, ck, block, *(getattr(facts, f) for f in _FACTS), edges))
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["conv_id", "ck", "block", *_FACTS, "edges"], dtype=object)
    return df


def compose(layers: list[list[dict]]) -> list[dict]:
    """One layer of edges for successive ones."""
    width = sum(max((len(e["audit"]) for e in layer), default=0) for layer in layers)
    weights = [[(e["a"], e["b"], e["cost"], digits(e["audit"]), len(e["audit"])) for e in layer] for layer in layers]
    out = []
    for start in WANTED:
        for end, (weight, used, trail) in shortest(weights, start, width, trails=True).items():
            cost, audit = read_weight(weight, used, width)
            chosen: list[dict] = []
            while trail:
                trail, k = trail
                chosen.append(layers[len(layers) - 1 - len(chosen)][k])
            chosen.reverse()
            out.append({"a": start, "b": end, "cost": cost, "audit": audit, "exits": [int(x) for e in chosen for x in e["exits"]], "lengths": [int(x) for e in chosen for x in e["lengths"]]})
    return out


def _compose_group(group: pd.DataFrame) -> pd.DataFrame:
    group, facts = group.sort_values("block"), Facts()
    for row in group.itertuples():
        one = Facts()
        for f in _FACTS:
            value = getattr(row, f)
            setattr(one, f, None if pd.isna(value) else value if isinstance(value, str) else int(value))
        facts.add(one)
    edges = compose([list(e) for e in group["edges"]])
    first = group.iloc[0]
    return _frame([(None if pd.isna(first["conv_id"]) else first["conv_id"], first["ck"], int(first["block"]) // AT_ONCE, *(getattr(facts, f) for f in _FACTS), edges)])


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The whole conversation's result, and each block's share of its audit."""
    for batch in batches:
        out = []
        for row in batch.itertuples():
            facts = Facts()
            for f in ("first_turn", "last_turn", "turns"):
                value = getattr(row, f)
                setattr(facts, f, None if pd.isna(value) else int(value))
            edges = [e for e in row.edges if e["a"] == START]
            ends = [(e["b"], NEXT[WANTED[e["b"]][0], e["b"]], INSERT, DIGIT["I"], 1) for e in edges] + [(e["b"], e["b"], 0, 0, 0) for e in edges]
            width = max(len(e["audit"]) for e in edges) + 1
            weight, used, trail = accepted(shortest([[(e["a"], e["b"], e["cost"], digits(e["audit"]), len(e["audit"])) for e in edges], ends], START, width, trails=True))
            cost, audit = read_weight(weight, used, width)
            chosen, at, state, parts = edges[trail[0][1]], 0, START, []
            for k, (leave, length) in enumerate(zip(chosen["exits"], chosen["lengths"])):
                end = used if k + 1 == len(chosen["exits"]) else at + int(length)
                parts.append({"rank": k, "state": state, "audit": audit[at:end]})
                at, state = end, int(leave)
            out.append((row.conv_id, row.ck, facts.gaps, row.blank, row.duplicate, row.truncated, row.illegal, cost, audit, parts))
        yield pd.DataFrame(out, columns=["conv_id", "ck", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"], dtype=object)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = ["\n".join(apply([(r["role"], r["text"]) for r in own], audit, state)) for own, audit, state in zip(batch["rows"], batch["audit"], batch["state"])]
        lines = [len(a) - a.count("D") for a in batch["audit"]]
        yield pd.DataFrame({"ck": batch["ck"], "rank": batch["rank"], "lines": lines, "text": texts})


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over texts in order; a conversation's state is its hash alone."""
    now, digest, begun = None, None, False
    for batch in batches:
        done = []
        for ck, lines, text in zip(batch["ck"], batch["lines"], batch["text"]):
            if ck != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest, begun = ck, hashlib.sha256(), False
            if lines:
                digest.update(("\n" if begun else "").encode() + text.encode())
                begun = True
        yield pd.DataFrame(done, columns=["ck", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["ck", "repaired_sha256"])


def _open_results(blocks: DataFrame, kind: str) -> DataFrame:
    """Results of the conversations that lie in more than one block, or may do so."""
    own = Window.partitionBy("ck", "key")
    key = F.sha2(F.concat_ws("\0", "row.role", "row.text").cast("binary"), 256)
    rows = blocks.select("ck", "block", F.posexplode("rows").alias("at", "row")).where(F.rtrim("row.text", F.lit(BLANKS)) != "").select("ck", "block", "at", key.alias("key"))
    firsts = rows.groupBy("ck", "block", "key").agg(F.min("at").alias("at"))  # one for each block, however often it is there
    again = firsts.withColumn("first", F.min("block").over(own)).where("block > first").groupBy("ck", "block").agg(F.collect_list("at").alias("repeated"))
    ranked = blocks.select("ck", "block", (F.row_number().over(Window.partitionBy("ck").orderBy("block")) - 1).cast("long").alias("rank"))
    blocks = stored(blocks.join(ranked, ["ck", "block"]).join(again, ["ck", "block"], "left").select("conv_id", "ck", F.col("rank").alias("block"), "rows", "repeated"), "blocks")
    schema = SOLVED.format(kind=kind)
    layers = blocks.mapInPandas(_solve, schema)
    number = blocks.agg(F.max("block").alias("n")).first().n or 0
    while True:
        layers = layers.groupBy("ck", F.floor(F.col("block") / AT_ONCE)).applyInPandas(_compose_group, schema)
        number //= AT_ONCE
        if not number:
            break
        layers = stored(layers, "layers")
    part = "array<struct<rank: long, state: int, audit: string>>"
    chosen = stored(layers.mapInPandas(_choose, f"conv_id {kind}, ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts {part}"), "chosen")
    parts = chosen.select("ck", F.explode("parts").alias("p")).select("ck", F.col("p.rank").alias("block"), "p.state", "p.audit")
    texts = blocks.select("ck", "block", "rows").join(parts, ["ck", "block"]).withColumnRenamed("block", "rank").mapInPandas(_write, "ck string, rank long, lines long, text string")
    hashes = texts.repartition("ck").sortWithinPartitions("ck", "rank").mapInPandas(_hash, "ck string, repaired_sha256 string")
    return chosen.drop("parts").join(hashes, "ck").drop("ck")


def repair_conversations(conversations: DataFrame, damaged: bool = True) -> DataFrame:
    """One row for each conv_id of ``conversations (conv_id, turn, role, text)``: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of the repaired ``role:text``, newline-joined).

    ``damaged``: damage the rows first (see ``damage``); else they are repaired as they are. A null conv_id is a conversation as any
    other, null turns come first, null roles and texts are one space. Rows of one turn go by role, then text (code points; beyond 64
    equal characters by MD5); repeated rows are duplicates. A role whose initial is none of s, u, a (or that is empty) can't
    be kept. Long texts are only hashed; other columns are not read; an empty table gives no rows.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damage(conversations)
    if not damaged:
        spaced = lambda name: F.coalesce(F.col(name), F.lit(" ")).alias(name)
        rows = conversations.select("conv_id", "turn", spaced("role"), spaced("text"), F.lit(1).alias("times")).withColumn("cut", ~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?"))
    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    schema = f"conv_id {kind}, block long, rows array<{ROW}>, {RESULT}"
    empty = conversations.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    cut = stored(small_batches(_ordered(rows)).mapInArrow(_cut_blocks(to_arrow_schema(empty.schema)), schema), "cut")
    name: Column = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    opened = _open_results(cut.where("rows is not null").select("conv_id", name.alias("ck"), "block", "rows"), kind)
    return cut.where("rows is null").drop("rows", "block").unionByName(opened)
