"""Cheapest repair of a conversation's role order, by depth-first branch and bound.

The rows of a conversation are kept, given the other role, deleted, or joined by inserted ones until their role initials read
`(s?(ua)+)?`. Costs: keep 0, rerole 1, delete 2, insert 5; keeping or reroling a truncated row 5 more; blank and repeated
rows must go. Of the cheapest edits the one whose audit (initials of the edits in order) is least in ASCII is taken.

The search (`search`) walks edits with an explicit stack, in ASCII order of their audits. A node is a row and one of four states: nothing
kept, a system row kept, a user's row last, an assistant's row last. A suffix bound, from backward sums that take a kept
system row for no change and forget where it may stand, prunes against the incumbent; the first incumbent comes from a descent
along the bounds. A table holds the least cost each node was reached with: since prefixes come in ASCII order, a later one must be
strictly cheaper to go on. With the stack empty the incumbent is proved.

Spark side. Rows shrink to (turn, role, digest of role and text, count), are put in order by a global sort, and cut into
segments of at most `SEGMENT` rows, so a conversation of any size is many rows in many tasks. Each segment is searched for every
state it may be entered and left in. A conversation then chooses states from a few numbers per segment, and its segments
are searched once more for the lines that stay. Texts move twice: to meet the lines kept of them, and to their digest, which
is sequential: the lines of one conversation stream through one task, one at a time. The audit is one text per
conversation by its contract.

Order: by turn, nulls first; rows of one turn by role, then by digest. Null role or text: one space. Null conv_id: a conversation
of its own. A role counts by its first character; an empty role can't be kept. Repeated rows are faults as defined. An empty table
gives no rows; other columns are ignored. A gap count beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import dense_number, saved

SPACE = " \t\n\x0b\f\r"
SEGMENT = 2048

#: Edits in ASCII order; costs, and the surcharge of a truncated row that stays.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
_DELETE_COST, _INSERT_COST, _REROLE_COST, _TRUNCATED_COST = 2, 5, 1, 5

#: States: nothing kept, a system row kept, a user's row last, an assistant's row last.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = 4
_NEVER = 1 << 60
#: The state after a row of the expected speaker, and that speaker.
_NEXT = (USER, USER, ASSISTANT, USER)
_EXPECTED = ("u", "u", "a", "u")
_LEAVES = ((START, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))
#: What closes a conversation that ends in a state.
_TAIL = ("", "II", "I", "")


def _bounds(codes: str, leave: int) -> list[list[int]]:
    """[i][state]: a cost that the rows from i on take at least, to end in `leave`."""
    n = len(codes)
    if leave in (START, SYSTEM):  # all rows from here on go, but for one that may stay as the system row
        left = [_DELETE_COST * (n - i) for i in range(n + 1)]
        one = [max(0, x - _DELETE_COST) if leave == SYSTEM else x for x in left]
        out = [[one[i], left[i] if leave == SYSTEM else _NEVER, _NEVER, _NEVER] for i in range(n + 1)]
        out[n] = [0 if leave == q else _NEVER for q in range(_STATES)]
        return out
    ends = (0, _NEVER) if leave == ASSISTANT else (_NEVER, 0)  # next is a user, an assistant
    sums = [ends]
    for code in reversed(codes):
        user_next, assistant_next = sums[-1]
        if code == "x":
            go = (_DELETE_COST + user_next, _DELETE_COST + assistant_next)
        else:
            more = _TRUNCATED_COST if code in "SUA!" else 0
            role = code.lower()
            go = (
                min(_DELETE_COST + user_next, more + (0 if role == "u" else _REROLE_COST) + assistant_next),
                min(_DELETE_COST + assistant_next, more + (0 if role == "a" else _REROLE_COST) + user_next),
            )
        sums.append((min(go[0], _INSERT_COST + go[1]), min(go[1], _INSERT_COST + go[0])))
    out = [[max(0, u - _DELETE_COST), u, a, u] for u, a in reversed(sums)]
    out[n] = [0 if leave == q else _NEVER for q in range(_STATES)]
    return out


def _edits(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows passed, next state) of each edit at a row, in ASCII order."""
    out = [(DELETE, _DELETE_COST, 1, state), (INSERT, _INSERT_COST, 0, _NEXT[state])]
    if code != "x":
        more = _TRUNCATED_COST if code in "SUA!" else 0
        role = code.lower()
        if role == _EXPECTED[state]:
            out.append((KEEP, more, 1, _NEXT[state]))
        elif role == "s" and state == START:
            out.append((KEEP, more, 1, SYSTEM))
        out.append((REROLE, more + _REROLE_COST, 1, _NEXT[state]))
    return out


_EDITS = {(c, q): _edits(c, q) for c in "xsua?SUA!" for q in range(_STATES)}


def search(codes: str, enter: int, leave: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest, ASCII-least edits of rows `codes` from one state to another; None if there are none.

    A code is a role initial (s, u, a, ? for others), a capital (! for ?) if the row is truncated, x if it must go.
    """
    n = len(codes)
    bounds = _bounds(codes, leave)
    if bounds[0][enter] >= _NEVER:
        return None
    best_cost, best = _NEVER, None
    i, q, cost, path = 0, enter, 0, []
    while i < n and len(path) <= 2 * n:  # the first incumbent: down along the bounds, deleting last
        letter, c, step, q = min(reversed(_EDITS[codes[i], q]), key=lambda e: e[1] + bounds[i + e[2]][e[3]])
        cost, i = cost + c, i + step
        path.append(letter)
    if i == n and q == leave:
        best_cost, best = cost, "".join(path)
    reached = [_NEVER] * ((n + 1) * _STATES)
    first = True  # the descent's audit may not be the least of its cost
    path, stack = [], [(0, enter, 0, 0, "")]
    while stack:
        i, q, cost, depth, letter = stack.pop()
        bound = cost + bounds[i][q]
        if bound >= _NEVER or bound > best_cost or (bound == best_cost and not first) or cost >= reached[i * _STATES + q]:
            continue
        reached[i * _STATES + q] = cost
        del path[max(0, depth - 1):]
        if letter:
            path.append(letter)
        if i == n:
            if q == leave:
                best_cost, best, first = cost, "".join(path), False
            continue
        for letter, c, step, to in reversed(_EDITS[codes[i], q]):
            stack.append((i + step, to, cost + c, depth + 1, letter))
    return None if best is None else (best_cost, best)


@lru_cache(maxsize=2000)
def between_states(codes: str) -> dict[tuple[int, int], tuple[int, str]]:
    """`search` from each state to each that can follow it."""
    found = {(a, b): search(codes, a, b) for a in range(_STATES) for b in _LEAVES[a]}
    return {k: v for k, v in found.items() if v is not None}


def lines_kept(codes: str, enter: int, audit: str) -> list[tuple[int | None, str | None]]:
    """(row, new role) of each line after the edits: no row for an inserted line, no role for one that keeps its own."""
    out, i, q = [], 0, enter
    for letter in audit:
        role = "assistant" if q == USER else "user"
        if letter == DELETE:
            i += 1
        elif letter == INSERT:
            out.append((None, role))
            q = _NEXT[q]
        else:
            out.append((i, role if letter == REROLE else None))
            q = SYSTEM if letter == KEEP and q == START and codes[i].lower() == "s" else _NEXT[q]
            i += 1
    return out


def chosen(segments: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, (enter, leave) of each segment, closing inserts) from each segment's costs and audit ranks, by state pair (-1: none)."""
    ahead = [[0, 2 * _INSERT_COST, _INSERT_COST, 0]]
    for costs, _ in reversed(segments):
        nxt = ahead[-1]
        ahead.append([min((costs[_STATES * a + b] + nxt[b] for b in range(_STATES) if costs[_STATES * a + b] >= 0), default=_NEVER) for a in range(_STATES)])
    ahead.reverse()
    state, pairs = START, []
    for k, (costs, ranks) in enumerate(segments):
        # audits of one segment have equally many edits of rows and end in one, so none is a prefix of another: the least decides
        fits = [b for b in range(_STATES) if costs[_STATES * state + b] >= 0 and costs[_STATES * state + b] + ahead[k + 1][b] == ahead[k][state]]
        leave = min(fits, key=lambda b: ranks[_STATES * state + b])
        pairs.append((state, leave))
        state = leave
    return ahead[0][START], pairs, _TAIL[state]


# ---- Spark ------------------------------------------------------------------------------------------------------


def _key(conv_id: Column) -> Column:
    """A conversation's key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def facts_of(rows: DataFrame) -> DataFrame:
    """(_c, conv_id, turn, role, key, blank, open, n): distinct rows; `open` ends without a mark, `key` is the digest of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = rows.select(_key(F.col("conv_id")).alias("_c"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    return named.groupBy(
        "_c", "conv_id", "turn", "role", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    ).agg(F.count(F.lit(1)).alias("n"))


def segments_of(facts: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(_c, seg, codes, initials, keys): runs of a conversation's rows in order; `keys` of the rows that may stay."""
    firsts = facts.where(~F.col("blank")).groupBy("_c", "key").agg(
        F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("_first"), F.count(F.lit(1)).alias("_turns"))
    again = firsts.where("_turns > 1").select("_c", "key", F.col("_first.turn").alias("_first_turn"), F.lit(True).alias("_several"))
    marked = facts.join(again, ["_c", "key"], "left").withColumn(
        "must_go", F.col("blank") | (F.coalesce("_several", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_first_turn"))))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    code = F.when(F.col("must_go"), "x").when(~F.col("open"), known).otherwise(F.when(known == "?", "!").otherwise(F.upper(known)))
    named = marked.select(
        "_c", "turn", "role", "key", code.alias("code"), F.repeat(known, F.col("n").cast("int")).alias("initials"),
        F.concat(code, F.repeat(F.lit("x"), (F.col("n") - 1).cast("int"))).alias("codes"))
    placed = dense_number(named, ["_c", "turn", "role", "key"], "_at")
    runs = placed.groupBy("_c", F.floor(F.col("_at") / size).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("_at", "code", "codes", "initials", "key"))).alias("r"))
    return runs.select(
        "_c", "seg", F.array_join("r.codes", "").alias("codes"), F.array_join("r.initials", "").alias("initials"),
        F.transform(F.filter("r", lambda x: x["code"] != "x"), lambda x: x["key"]).alias("keys"))


def counts_of(facts: DataFrame) -> DataFrame:
    """(_c, conv_id, gaps, blank, duplicate, truncated) of each conversation."""
    seen = facts.groupBy("_c", "key").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    faults = seen.groupBy("_c").agg(
        F.first("conv_id").alias("conv_id"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("open"), 1).otherwise(0)).cast("bigint").alias("truncated"))
    turns = facts.groupBy("_c", "turn").agg(F.lit(1).alias("_one")).groupBy("_c").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("t"))
    wide = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1 - F.col("t")
    gaps = F.when(F.col("lo").isNull(), F.lit(0).cast("bigint")).otherwise(wide.try_cast("bigint"))
    return faults.join(turns, "_c").select("_c", "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs, audit ranks and illegal neighbours of each segment."""
    legal = {"su", "ua", "au"}
    for batch in batches:
        rows = []
        for c, seg, codes, initials in zip(*(batch.column(k).to_pylist() for k in ("_c", "seg", "codes", "initials"))):
            table = between_states(codes)
            ranked = {k: r for r, k in enumerate(sorted(table, key=lambda k: table[k][1]))}
            pairs = [(a, b) for a in range(_STATES) for b in range(_STATES)]
            illegal = sum(x + y not in legal for x, y in zip(initials, initials[1:]))
            rows.append((c, seg, [table[p][0] if p in table else -1 for p in pairs], [ranked.get(p, -1) for p in pairs], illegal, initials[0], initials[-1]))
        yield pa.RecordBatch.from_pylist([dict(zip(_TABLE.names, r)) for r in rows], schema=_TABLE)


_TABLE = pa.schema([("_c", pa.string()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])
_CHOSEN = pa.schema([
    ("_c", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
    ("picks", pa.list_(pa.struct([("seg", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("tail", pa.string())])))])
_PIECE = pa.schema([
    ("_c", pa.string()), ("seg", pa.int64()), ("audit", pa.string()),
    ("lines", pa.list_(pa.struct([("at", pa.int32()), ("key", pa.string()), ("role", pa.string())])))])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's cost, illegal neighbours, and the states its segments go through."""
    legal = {"su", "ua", "au"}
    for batch in batches:
        rows = []
        for c, parts in zip(batch.column("_c").to_pylist(), batch.column("parts").to_pylist()):
            cost, pairs, tail = chosen([(p["costs"], p["ranks"]) for p in parts])
            joints = sum(a["last"] + b["first"] not in legal for a, b in zip(parts, parts[1:]))
            picks = [{"seg": p["seg"], "enter": a, "leave": b, "tail": ""} for p, (a, b) in zip(parts, pairs)]
            picks[-1]["tail"] = tail
            rows.append({"_c": c, "cost": cost, "illegal": joints + sum(p["illegal"] for p in parts), "picks": picks})
        yield pa.RecordBatch.from_pylist(rows, schema=_CHOSEN)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's audit and the lines that stand after it."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            audit = between_states(r["codes"])[r["enter"], r["leave"]][1]
            stay, keys = [k for k, code in enumerate(r["codes"]) if code != "x"], r["keys"]
            key_of = dict(zip(stay, keys))
            lines = [(None if i is None else key_of[i], role) for i, role in lines_kept(r["codes"], r["enter"], audit)]
            state = r["leave"]
            for _ in r["tail"]:
                lines.append((None, "assistant" if state == USER else "user"))
                state = _NEXT[state]
            rows.append({"_c": r["_c"], "seg": r["seg"], "audit": audit + r["tail"], "lines": [{"at": i, "key": k, "role": role} for i, (k, role) in enumerate(lines)]})
        yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which arrive in order; a conversation may go on over batches."""
    current, state = None, hashlib.sha256()
    names = ["_c", "repaired_sha256"]
    for batch in batches:
        done, digests = [], []
        for c, line in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist()):
            if c != current:
                if current is not None:
                    done.append(current), digests.append(state.hexdigest())
                current, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(digests, pa.string())], names=names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=names)


def repaired_lines(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(_c, seg, at, role, text): the lines of the repaired conversations."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = rows.select(_key(F.col("conv_id")).alias("_c"), role.alias("_role"), text.alias("text")).withColumn("key", F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "text"), 256))
    lines = pieces.select("_c", "seg", F.explode("lines").alias("l")).select("_c", "seg", "l.at", "l.key", "l.role")
    met = lines.where("key is not null").join(named.dropDuplicates(["_c", "key"]), ["_c", "key"])
    inserted = lines.where("key is null").select("_c", "seg", "at", "role", F.lit("").alias("text"))
    return met.select("_c", "seg", "at", F.coalesce("role", "_role").alias("role"), "text").unionByName(inserted)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    `rows` = (conv_id, turn, role, text).
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    facts = saved(facts_of(rows))
    runs = saved(segments_of(facts, segment))
    tables = runs.select("_c", "seg", "codes", "initials").mapInArrow(_tables, "_c string, seg bigint, costs array<bigint>, ranks array<int>, illegal bigint, first string, last string")
    gathered = tables.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("seg", "costs", "ranks", "illegal", "first", "last"))).alias("parts"))
    decided = saved(gathered.mapInArrow(_choices, "_c string, cost bigint, illegal bigint, picks array<struct<seg: bigint, enter: int, leave: int, tail: string>>"))
    picks = decided.select("_c", F.explode("picks").alias("p")).select("_c", "p.seg", "p.enter", "p.leave", "p.tail")
    pieces = saved(runs.select("_c", "seg", "codes", "keys").join(picks, ["_c", "seg"]).mapInArrow(
        _pieces, "_c string, seg bigint, audit string, lines array<struct<at: int, key: string, role: string>>"))
    audits = pieces.groupBy("_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = repaired_lines(rows, pieces).select("_c", "seg", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition(tasks, "_c").sortWithinPartitions("_c", "seg", "at").select("_c", "line")
    digests = ordered.mapInArrow(_digests, "_c string, repaired_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        counts_of(facts).join(decided.drop("picks"), "_c").join(audits, "_c").join(digests, "_c", "left")
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))


# ---- the damage of the contract ---------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) after the contract's damage, chosen by crc32 of `conv_id:turn` modulo 20 (null: one space)."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("_kind"),
    ).where("_kind != 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")
