"""Cheapest structural repair of conversations by Knuth's lightest-derivation agenda.

A conversation is repaired row by row. An item (i, state) says that the first i rows have been edited into a role
sequence that ends in ``state``. Deductions lead from an item and a row to the next item and weigh (cost, audit
letter). Weights are compared by cost, then by audit text. A step adds to the cost and lengthens the audit, so no
conclusion weighs less than its premises; two audits of one item at one cost never begin one another, because
both hold one letter per row and end in one, so a lighter premise never gives a heavier conclusion. An item is therefore
final when the agenda pops it.

Long conversations are cut into pieces of bounded size. A piece keeps, for every state before and after it, the
lightest derivation; a conversation then chooses one state at every border.
"""
from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfline.session import settle

PIECE_ROWS = 256
PIECE_CHARS = 1_000_000     # of texts; a longer text is a piece of its own
BLANKS = " \t\n\x0b\x0c\r"
RETYPE, DROP, ADD, CUT_SHORT = 1, 2, 5, 5
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
CLOSING = {START: (0, ""), SYSTEM: (2 * ADD, "II"), USER: (ADD, "I"), ASSISTANT: (0, "")}
FULL = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


# --- one piece ---------------------------------------------------------------------------------------------------
def deductions(state: int, initial: str, fault: int):
    """(rows consumed, next state, cost, letter) of every rule whose premises are the state and the row."""
    yield 1, state, DROP, "D"
    for x in "ua":
        if x in STEP[state]:
            yield 0, STEP[state][x], ADD, "I"
    if fault in (NONE, TRUNCATED):
        more = CUT_SHORT if fault == TRUNCATED else 0
        if initial in STEP[state]:
            yield 1, STEP[state][initial], more, "K"
        for x in "ua":
            if x in STEP[state]:
                yield 1, STEP[state][x], RETYPE + more, "R"


def lightest(rows: list[tuple[str, int]], begin: int, close: bool) -> dict[int, tuple[int, str]]:
    """state: (cost, audit) of the lightest derivations over ``rows`` (initial, fault) from state ``begin``.

    With ``close`` the only result is that of the goal, under the key -1: the rows consumed and the sequence
    completed. Rows are only inserted before a row or at the very end, which leaves no audit out.
    """
    agenda, final, found, n = [(0, "", 0, begin)], set(), {}, len(rows)
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i > n:
            return {-1: (cost, audit)}
        if i == n:
            if close:
                more, letters = CLOSING[state]
                heapq.heappush(agenda, (cost + more, audit + letters, n + 1, -1))
            else:
                found[state] = cost, audit
                if len(found) == len(STEP):
                    break
            continue
        for used, then, more, letter in deductions(state, *rows[i]):
            if (i + used, then) not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, i + used, then))
    return found


def edited(audit: str, begin: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the repaired rows. The state decides what role a retyped or inserted row takes."""
    out, state, i = [], begin, 0
    for letter in audit:
        if letter in "RI":
            x = "a" if state == USER else "u"
            out.append((FULL[x], texts[i] if letter == "R" else ""))
        elif letter == "K":
            x = roles[i][:1]
            out.append((roles[i], texts[i]))
        if letter != "D":
            state = STEP[state][x]
        i += letter != "I"
    return out


def table_of(rows: list[tuple[str, int]]) -> tuple[list, list, list]:
    """Cost, rank of the audit and audit for every (state before, state after), 16 each; cost -1 where there is no way."""
    ways = [lightest(rows, begin, False) for begin in range(4)]
    audits = sorted({a for w in ways for _, a in w.values()})
    rank = {a: k for k, a in enumerate(audits)}
    flat = [ways[b].get(e, (-1, "")) for b in range(4) for e in range(4)]
    return [c for c, _ in flat], [rank.get(a, 0) for _, a in flat], [a for _, a in flat]


def borders(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Total cost and the (state before, state after) of every piece of a conversation.

    Prefixes of different states never begin one another, so their order is that of the ranks piece by piece;
    it is renumbered after every piece.
    """
    now, back = {START: (0, 0)}, []
    for cost, rank in zip(costs, ranks):
        best = {}
        for begin, (c, r) in now.items():
            for end in range(4):
                if cost[4 * begin + end] >= 0:
                    way = (c + cost[4 * begin + end], r, rank[4 * begin + end], begin)
                    best[end] = min(best.get(end, way), way)
        place = {k: p for p, k in enumerate(sorted({w[1:3] for w in best.values()}))}
        back.append(bytes(best[e][3] if e in best else 255 for e in range(4)))
        now = {e: (w[0], place[w[1:3]]) for e, w in best.items()}
    total, _, end = min((c + CLOSING[e][0], r, e) for e, (c, r) in now.items())
    path = []
    for step in reversed(back):
        path.append((step[end], end))
        end = step[end]
    return total, path[::-1]


# --- pieces in order -----------------------------------------------------------------------------------------------
_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()
STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn"]
_PIECE = [T.StructField("_part", _I), T.StructField("_seq", _L), T.StructField("_whole", T.BooleanType()),
          *[T.StructField(n, _L) for n in STATS], T.StructField("first_initial", _S), T.StructField("last_initial", _S),
          T.StructField("costs", T.ArrayType(_I)), T.StructField("ranks", T.ArrayType(_I)), T.StructField("audits", T.ArrayType(_S)),
          T.StructField("roles", T.ArrayType(_S)), T.StructField("texts", T.ArrayType(_S))]
REPAIRED = "array<struct<role:string,text:string>>"


class _Piece:
    """Rows of one conversation that follow each other."""

    def __init__(self):
        self.roles, self.texts, self.rows, self.turns, self.chars = [], [], [], [], 0

    def add(self, role, text, turn, fault):
        self.roles.append(role)
        self.texts.append(text)
        self.rows.append((role[:1], fault))
        self.turns.append(turn)
        self.chars += len(text)

    def row(self, whole: bool) -> tuple:
        faults = [f for _, f in self.rows]
        initials = [x for x, _ in self.rows]
        turns = [t for t in self.turns if t is not None]
        stats = (len(faults), *[faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)],
                 sum(p not in LEGAL for p in zip(initials, initials[1:])), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
                 initials[0] if initials else None, initials[-1] if initials else None)
        if whole:
            cost, audit = lightest(self.rows, START, True)[-1]
            return (*stats, [cost], [0], [audit], self.roles, self.texts)
        return (*stats, *table_of(self.rows), self.roles, self.texts)


def _cut(batches, schema: pa.Schema):
    """Pieces of the conversations of one sorted partition. A conversation that may go on in a neighbouring
    partition, or that has several pieces, is left open."""
    part, seq, out = TaskContext.get().partitionId(), 0, []
    conv, piece, number, n_convs, last = None, None, 0, 0, None

    def close(whole: bool):
        nonlocal seq
        out.append((conv, part, seq, whole, *piece.row(whole)))
        seq += 1

    def batch():
        columns = [pa.array([r[j] for r in out], schema.field(j).type) for j in range(len(schema))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            for c, turn, role, text, present, fault, digest in zip(*[col.to_pylist() for col in b.slice(lo, 1000).columns]):
                if piece is None or c != conv:
                    if piece is not None:
                        close(number == 0 and n_convs > 1)
                    conv, piece, number, n_convs, last = c, _Piece(), 0, n_convs + 1, None
                if not present:
                    continue
                if len(piece.rows) >= PIECE_ROWS or (piece.rows and piece.chars + len(text) > PIECE_CHARS):
                    close(False)
                    piece, number = _Piece(), number + 1
                piece.add(role, text, turn, DUPLICATE if fault != BLANK and last == (turn, digest) else fault)
                last = turn, digest
            if len(out) >= 64:
                yield batch()
    if piece is not None:
        close(False)
    if out:
        yield batch()


def _choose(key, group):
    """The states at the borders of one conversation's pieces. Its audit fits into one value, so at most
    2^31 / PIECE_ROWS short rows are read here, and never a text."""
    group = group.sort_by([("_part", "ascending"), ("_seq", "ascending")])
    total, path = borders(group.column("costs").to_pylist(), group.column("ranks").to_pylist())
    n = group.num_rows
    return pa.table({"_part": group.column("_part"), "_seq": group.column("_seq"), "_begin": pa.array([b for b, _ in path], pa.int32()),
                     "_end": pa.array([e for _, e in path], pa.int32()), "_last": pa.array([k == n - 1 for k in range(n)]),
                     "_total": pa.array([total] * n, pa.int64())})


def repaired_pieces(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row per piece of a conversation, in order of (_part, _seq): counts, cost, audit and the repaired rows.

    ``rows``: conv_id, turn, role, text; other columns are ignored. Rows of a conversation are taken by turn, nulls
    first; rows of one turn by role and text. Null roles and texts are one blank. Rows whose column ``present`` is
    not true only make their conversation known. ``cost`` is that of the whole conversation.
    """
    here = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), here.alias("_here"))
    digest = F.when(F.col("_here"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    base = base.withColumn("_digest", digest)
    # Earlier rows with the same role and text: only those that recur are joined back.
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    recurring = (base.where("_here").groupBy(F.col("conv_id").alias("_c"), F.col("_digest").alias("_d"))
                 .agg(F.min(when).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    marked = base.join(recurring, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_digest") == F.col("_d")), "left")
    earlier = F.col("_first").isNotNull() & ~F.col("_first.turn").eqNullSafe(F.col("turn"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(bare == "", BLANK).when(earlier, DUPLICATE)
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE))
    order = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("_digest")]
    sorted_ = (marked.select("conv_id", "turn", "role", "text", "_here", fault.alias("_fault"), "_digest")
               .repartitionByRange(*order).sortWithinPartitions(*order))
    schema = T.StructType([rows.schema["conv_id"], *_PIECE])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    pieces = settle(sorted_.mapInArrow(lambda batches: _cut(batches, arrow), schema), "pieces")
    open_ = pieces.where("not _whole")
    path = (open_.select("conv_id", "_part", "_seq", "costs", "ranks").groupBy("conv_id")
            .applyInArrow(_choose, "_part int, _seq long, _begin int, _end int, _last boolean, _total long"))
    chosen = pieces.join(settle(path, "borders"), ["_part", "_seq"], "left")
    kept = ["_part", "_seq", "_whole", *STATS, "first_initial", "last_initial"]
    out = T.StructType([rows.schema["conv_id"], *[f for f in _PIECE if f.name in kept], T.StructField("cost", _L), T.StructField("audit", _S),
                        T.StructField("repaired", T._parse_datatype_string(REPAIRED))])
    target = to_arrow_schema(out)

    def apply(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                made = []
                for r in part.select(["_whole", "_begin", "_end", "_last", "_total", "costs", "audits", "roles", "texts"]).to_pylist():
                    begin = START if r["_whole"] else r["_begin"]
                    audit = r["audits"][0 if r["_whole"] else 4 * begin + r["_end"]] + (CLOSING[r["_end"]][1] if r["_last"] else "")
                    rows_ = [{"role": x, "text": t} for x, t in edited(audit, begin, r["roles"], r["texts"])]
                    made.append((r["costs"][0] if r["_whole"] else r["_total"], audit, rows_))
                held = [part.column(n) for n in ["conv_id", *kept]]
                yield pa.RecordBatch.from_arrays([*held, *[pa.array([m[j] for m in made], target.field(len(held) + j).type) for j in range(3)]], schema=target)
    return chosen.select("conv_id", *kept, "costs", "audits", "roles", "texts", "_begin", "_end", "_last", "_total").mapInArrow(apply, out)


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _line(r: Column) -> Column:
    return F.concat(r["role"], F.lit(":"), r["text"])


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the sha256 of its repaired rows (role:text, one a line).

    Conversations of one piece need no shuffle. The pieces of others are streamed in order, so a conversation
    of any length is hashed in bounded memory.
    """
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    text = F.array_join(F.transform("repaired", _line), "\n")
    pieces = settle(pieces, "repaired")
    short = pieces.where("_whole").withColumn("gaps", gaps).withColumn("repaired_sha256", F.sha2(text, 256)).select("conv_id", *REPORT)
    rest = pieces.where("not _whole").withColumn("_lines", F.transform("repaired", _line)).select(
        "conv_id", "_part", "_seq", *STATS, "first_initial", "last_initial", "cost", "audit", "_lines")
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(short.schema)

    def stream(batches):
        conv, held = None, None

        def finish():
            lo, hi = held["first_turn"], held["last_turn"]
            row = [conv, 0 if lo is None else hi - lo + 1 - held["turns"], *[held[n] for n in REPORT[1:6]], "".join(held["audits"]), held["hash"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)
        for b in batches:
            for lo in range(0, b.num_rows, 20):
                for r in b.slice(lo, 20).to_pylist():
                    if held is None or r["conv_id"] != conv:
                        if held is not None:
                            yield finish()
                        conv, held = r["conv_id"], {**{n: 0 for n in STATS}, "first_turn": None, "last_turn": None, "initial": None,
                                                    "cost": r["cost"], "audits": [], "hash": hashlib.sha256(), "lines": 0}
                    held["illegal"] += held["initial"] is not None and r["first_initial"] is not None and (held["initial"], r["first_initial"]) not in LEGAL
                    held["turns"] -= r["first_turn"] is not None and r["first_turn"] == held["last_turn"]
                    for n in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        held[n] += r[n]
                    held["initial"] = r["last_initial"] if r["rows"] else held["initial"]
                    if r["first_turn"] is not None:
                        held["first_turn"] = r["first_turn"] if held["first_turn"] is None else held["first_turn"]
                        held["last_turn"] = r["last_turn"]
                    held["audits"].append(r["audit"])
                    for line in r["_lines"]:
                        held["hash"].update(("\n" if held["lines"] else "").encode() + line.encode("utf-8"))
                        held["lines"] += 1
        if held is not None:
            yield finish()
    long = rest.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_seq").mapInArrow(stream, short.schema)
    return short.unionByName(long)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by the crc32 of ``conv_id:turn`` modulo 20 (nulls read as one blank).

    0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes its role user. Dropped rows
    stay, with false in ``present``, so that their conversation is known.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("_code"))
            .select("conv_id", "turn", F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (F.col("_code") != 0).alias("present"), F.explode(times).alias("_copy")).drop("_copy"))
