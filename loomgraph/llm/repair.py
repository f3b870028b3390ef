"""Conversation structure repair (op13): error-correcting Earley parsing of role sequences.

A conversation is to give the role initials `(s?(ua)+)?`. The grammar is left-linear, so every nonterminal begins where the
conversation does and a chart has a few items a row, whatever the conversation's length:

    C -> N | A        S -> N s        U -> N u | S u | A u        A -> U a        X -> X d   (X any of N S U A)

N is nothing yet. `s`, `u` and `a` are a row of that initial (Keep, 0); `u` and `a` are also any row (Rerole, 2) or no row (Insert,
2), and `d` is any row (Delete, 3). A truncated row that isn't deleted costs 1 more. An item keeps the least (cost, audit), where the
audit is the edits' initials in order, ties to the ASCII-least. Two audits of one stretch of rows have as many K, R and D as it has
rows and end in one of them, so neither begins the other, and only their order is kept: a rank. So a chart's column is four pairs
(cost over the least, rank); of these there are few, and what a row does to one is worked out once and looked up later.

Rows are placed in one order by ranges and cut into segments of bounded size, so a long conversation is parsed by many tasks: the
segments at its borders give least (cost, rank) from each nonterminal to each other, a small job over these finds where the parse
passes, and each segment then reads off its edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, buckets_for, join_counted, materialise, table

SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
RULES = (("S", "N", "s"), ("U", "N", "u"), ("U", "S", "u"), ("U", "A", "u"), ("A", "U", "a"), *((x, x, "d") for x in "NSUA"))
STATES, ENDS = "NSUA", ("N", "A")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: From any nonterminal the rest of a conversation costs at most 7 more than from another: two inserts lead to A, and a kept system
#: row costs one Delete. So what is dearer than the least by more than this is never part of the cheapest parse.
DEARER = 8
#: Rows of a segment.
SEGMENT = 50_000

Column4 = tuple[tuple[int, int] | None, ...]


def start_column(state: str = "N") -> Column4:
    return tuple((0, 0) if x == state else None for x in STATES)


def _better(chart: dict, item: str, weight: tuple) -> bool:
    if item in chart and chart[item] <= weight:
        return False
    chart[item] = weight
    return True


def _inserted(column: Column4) -> dict:
    """The chart set before a row: completed nonterminals with weights (cost, rank of the item it comes from, edits since)."""
    done = {x: (*w, "") for x, w in zip(STATES, column, strict=True) if w}
    agenda = list(done)
    while agenda:
        x = agenda.pop()
        for lhs, left, symbol in RULES:  # predict what follows x, and complete it by a production that takes no row
            if left == x and symbol in NAMES:
                cost, rank, audit = done[x]
                if _better(done, lhs, (cost + INSERT, rank, audit + "I")):
                    agenda.append(lhs)
    return done


@lru_cache(1 << 16)
def step(column: Column4, initial: str, lost: bool, truncated: bool) -> tuple[int, Column4, tuple]:
    """(cost to add, next column, for each nonterminal where it comes from and by which edits) of one row."""
    here, there = _inserted(column), {}
    for lhs, left, symbol in RULES:
        if left not in here:
            continue
        cost, rank, audit = here[left]
        if symbol == "d":
            _better(there, lhs, (cost + DELETE, rank, audit + "D"))
        elif not lost:
            more = TRUNCATED if truncated else 0
            if symbol == initial:
                _better(there, lhs, (cost + more, rank, audit + "K"))
            elif symbol in NAMES:
                _better(there, lhs, (cost + REROLE + more, rank, audit + "R"))
    least = min(w[0] for w in there.values())
    there = {x: w for x, w in there.items() if w[0] - least <= DEARER}
    order = {w[1:]: i for i, w in enumerate(sorted(there.values(), key=lambda w: w[1:]))}
    source = {w[1]: x for x, w in zip(STATES, column, strict=True) if w}
    following = tuple((there[x][0] - least, order[there[x][1:]]) if x in there else None for x in STATES)
    return least, following, tuple((source[there[x][1]], there[x][2]) if x in there else None for x in STATES)


@lru_cache(1 << 16)
def close(column: Column4) -> tuple[int, str, str]:
    """(cost, the nonterminal before the last inserts, the inserts) of the cheapest complete parse."""
    done = _inserted(column)
    cost, rank, audit = min(done[x] for x in ENDS if x in done)
    return cost, next(x for x, w in zip(STATES, column, strict=True) if w and w[1] == rank), audit


def parse(rows: list[tuple[str, bool, bool]], start: str = "N") -> tuple[int, Column4, list]:
    """(cost, last column, where each row's items come from) of rows (initial, must go, truncated) from a nonterminal."""
    column, total, back = start_column(start), 0, []
    for row in rows:
        cost, column, way = step(column, *row)
        total += cost
        back.append(way)
    return total, column, back


def edits_of(back: list, end: str) -> list[tuple[str, str, str | None]]:
    """(initials inserted before, edit, initial given or None) of each row, for the parse that ends in `end`."""
    out, x = [], end
    for way in reversed(back):
        before, audit = way[STATES.index(x)]
        added, y = insertions(before, len(audit) - 1)
        out.append((added, audit[-1], None if audit[-1] == "D" else x.lower()))
        x = before
    return out[::-1]


def insertions(state: str, n: int) -> tuple[str, str]:
    """The initials of n inserts from a nonterminal, and the one they lead to."""
    added = ""
    for _ in range(n):
        state = "A" if state == "U" else "U"
        added += state.lower()
    return added, state


def runs(keys: list) -> Iterator[tuple[int, int]]:
    """(first, after the last) of stretches of one conversation."""
    i = 0
    while i < len(keys):
        j = i + 1
        while j < len(keys) and keys[j] == keys[i]:
            j += 1
        yield i, j
        i = j


def _rows(t: pa.Table) -> dict[str, list]:
    return t.sort_by("at").to_pydict() if t.num_rows else {c: [] for c in t.column_names}


EDGE = "conv string, seg long, n_rows long, costs array<long>, ranks array<int>, last string, last_turn long"


def edge_tables(t: pa.Table) -> pa.Table:
    """Of the first and the last conversation of a segment: least (cost, rank) from each nonterminal to each other; -1: dearer."""
    r, found = _rows(t), []
    spans = list(runs(r["conv"]))
    for i, j in dict.fromkeys([spans[0], spans[-1]]):
        rows = list(zip(r["initial"][i:j], r["lost"][i:j], r["truncated"][i:j], strict=True))
        costs, ranks = [], []
        for x in STATES:
            total, column, _ = parse(rows, x)
            costs += [total + w[0] if w else -1 for w in column]
            ranks += [w[1] if w else -1 for w in column]
        found.append((r["conv"][i], r["seg"][i], j - i, costs, ranks, r["initial"][j - 1], r["turn"][j - 1]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.int64()]
    return _table(EDGE, kinds, found)


CHOICE = "conv string, seg long, start string, end string, before string, before_turn long, added string"


def stitch(t: pa.Table) -> pa.Table:
    """Where the cheapest parse of a conversation enters and leaves each of its segments: one small row a segment comes in."""
    segments = t.sort_by("seg").to_pylist()
    column, back = start_column(), []
    for s in segments:
        there, way = {}, {}
        for x, w in zip(STATES, column, strict=True):
            for y in STATES if w else "":
                k = STATES.index(x) * 4 + STATES.index(y)
                if s["costs"][k] >= 0 and _better(there, y, (w[0] + s["costs"][k], w[1], s["ranks"][k])):
                    way[y] = x
        order = {w[1:]: i for i, w in enumerate(sorted(there.values(), key=lambda w: w[1:]))}
        least = min(w[0] for w in there.values())
        column = tuple((there[x][0] - least, order[there[x][1:]]) if x in there else None for x in STATES)
        back.append(way)
    _, x, audit = close(column)
    added, out = insertions(x, len(audit))[0], []
    for i in range(len(segments) - 1, -1, -1):
        s, p = segments[i], segments[i - 1] if i else {"last": None, "last_turn": None}
        out.append((s["conv"], s["seg"], back[i][x], x, p["last"], p["last_turn"], added if i == len(segments) - 1 else ""))
        x = back[i][x]
    return _table(CHOICE, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()], out)


EDIT = "hash binary, turn long, at long, edit string, to string, before array<string>, after array<string>, illegal long, fresh long"


def segment_edits(t: pa.Table, choices: pa.Table) -> pa.Table:
    """The edits of each row of a segment; conversations that cross its borders enter and leave it where `choices` says."""
    r, told = _rows(t), {c["conv"]: c for c in choices.to_pylist()}
    out = []
    for i, j in runs(r["conv"]):
        c = told.get(r["conv"][i])
        rows = list(zip(r["initial"][i:j], r["lost"][i:j], r["truncated"][i:j], strict=True))
        _, column, back = parse(rows, c["start"] if c else "N")
        if c:
            end, after = c["end"], c["added"]
        else:
            _, end, audit = close(column)
            after = insertions(end, len(audit))[0]
        last, last_turn = (c["before"], c["before_turn"]) if c else (None, None)
        for k, (added, edit, to) in enumerate(edits_of(back, end), i):
            initial, turn, n = r["initial"][k], r["turn"][k], r["n"][k]
            odd = (last is not None and last + initial not in ("su", "ua", "au")) + n - 1
            tail = [NAMES[x] for x in after] if k == j - 1 else []
            out.append((r["hash"][k], turn, r["at"][k], edit, NAMES.get(to) if edit == "R" else None, [NAMES[x] for x in added], tail, odd, int(turn is not None and turn != last_turn)))
            last, last_turn = initial, turn
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64()]
    return _table(EDIT, kinds, out)


def _table(schema: str, kinds: list, rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)


def _digest(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def edits(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row for all equal turns (conv, turn, role, text) with their number n, their faults and the edits that repair structure.

    Columns: conv_id, turn, role, text, n, blank, seen, truncated, at (the order of all rows), edit (K, R or D of the first of the
    n; the others are deleted as duplicates), to (the role a rerole gives), before and after (roles of empty turns inserted; after
    only in a conversation's last row), illegal (neighbours that may not follow each other, with the row before), fresh (1 where
    a turn number comes first). Null roles and texts are one space; null turns come first; a null conv is a conversation of its
    own. Rows of one turn are in the order of role, then of the text's first 64
    characters, then of a hash. Other columns of turns are ignored. No rows: none.
    A role's initial is its first character; an empty role has none and is never kept.
    """
    own = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    shown = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    name = F.concat(F.isnull("conv_id").cast("string"), F.length(shown).cast("string"), F.lit(":"), shown, F.length("role").cast("string"), F.lit(":"), "role", "text")
    folded = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    end = F.right(F.btrim("text", F.lit(SPACE)), F.lit(1))
    folded = materialise(folded.withColumns({"hash": _digest(name), "head": F.left("text", F.lit(64)), "blank": end == "", "truncated": ~end.isin(".", "!", "?", "")}), "turns")
    # a turn was seen if its role and text came before in its conversation: in an earlier turn, as equal rows are one here
    repeats = folded.groupBy("hash").agg(F.count("*").alias("rows"), F.min(F.struct("turn")).alias("first")).filter("rows > 1")
    slim = folded.select(F.col("conv_id").alias("conv"), "turn", "role", "head", "hash", "n", "blank", "truncated")
    slim = join_counted(slim, materialise(repeats, "repeats"), "hash", "rows", F.struct("hash", "turn"), 64, broadcast_bytes, keep=True)
    seen = ~F.col("blank") & F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    parts = buckets_for(folded.count(), segment, 1 << 20)
    order = ["conv", "turn", "role", "head", "hash"]
    placed = slim.withColumn("seen", seen).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.select(
        F.when(F.col("conv").isNotNull(), F.concat(F.lit("="), F.col("conv").cast("string"))).alias("conv"), "turn", "hash", "n", "seen",
        F.left("role", F.lit(1)).alias("initial"), (F.col("blank") | F.col("seen")).alias("lost"), "truncated", F.monotonically_increasing_id().alias("at"),
    )
    placed = materialise(placed.withColumn("seg", F.shiftright("at", 33)), "placed")
    # which conversation a segment begins and ends with is a few rows a segment
    crossing = materialise(placed.groupBy("seg").applyInArrow(edge_tables, EDGE), "edges")
    choices = materialise(crossing.groupBy("conv").applyInArrow(stitch, CHOICE), "choices")
    done = placed.groupBy("seg").cogroup(choices.groupBy("seg")).applyInArrow(segment_edits, EDIT)
    flags = placed.select("at", "seen")
    done = materialise(done, "edits").join(flags, "at")
    same = (F.col("f.hash") == F.col("d.hash")) & F.col("f.turn").eqNullSafe(F.col("d.turn"))
    kept = ["f.conv_id", "f.turn", "f.role", "f.text", "f.n", "f.blank", "d.seen"]
    return folded.alias("f").join(done.alias("d"), same).select(
        *kept, (F.col("f.truncated") & ~F.col("d.seen")).alias("truncated"), "d.at", "d.edit", "d.to", "d.before", "d.after", "d.illegal", "d.fresh"
    )


def repaired_rows() -> Column:
    """array<struct<edit, role, text>> of what a row of `edits` leaves, with the turns inserted around it."""
    def inserted(c):
        return F.transform(c, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))

    one = F.array(F.struct(F.col("edit"), F.coalesce("to", "role").alias("role"), F.col("text")))
    return F.concat(inserted("before"), F.when(F.col("edit") != "D", one).otherwise(F.slice(one, 1, 0)), inserted("after"))


def repaired(turns: DataFrame, **names) -> DataFrame:
    """The turns of the repaired conversations: conv_id, at, place (together their order), turn (null if inserted), edit, role, text."""
    rows = edits(turns, **names).select("conv_id", "at", "turn", F.posexplode(repaired_rows()).alias("place", "r"))
    return rows.select("conv_id", "at", "place", F.when(F.col("r.edit") != "I", F.col("turn")).alias("turn"), "r.edit", "r.role", "r.text")


def summary(found: DataFrame) -> DataFrame:
    """One row a conversation of `edits`: its faults, cost, audit and the digest of its repaired turns.

    The audit and the digest are one value over a whole conversation, so its repaired turns meet in one task here; nothing else does.
    """
    flag = lambda c, n: F.sum(F.when(c, n).otherwise(0))
    n, k = F.col("n"), F.col("edit") != "D"
    cost = INSERT * (F.size("before") + F.size("after")) + F.when(F.col("edit") == "R", REROLE).when(F.col("edit") == "D", DELETE).otherwise(0)
    cost = cost + F.when(k & F.col("truncated"), TRUNCATED).otherwise(0) + DELETE * (n - 1)
    audit = F.concat(F.repeat(F.lit("I"), F.size("before")), "edit", F.repeat(F.lit("D"), (n - 1).cast("int")), F.repeat(F.lit("I"), F.size("after")))
    one = F.struct("at", audit.alias("audit"), F.transform(repaired_rows(), lambda r: F.concat(r["role"], F.lit(":"), r["text"])).alias("turns"))
    by = found.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.sum("fresh")).alias("gaps"), flag(F.col("blank"), n).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(n - 1 + F.col("seen").cast("long"))).alias("duplicate"),
        flag(F.col("truncated") & ~F.col("blank"), 1).alias("truncated"), F.sum("illegal").alias("illegal"), F.sum(cost).alias("cost"),
        F.array_sort(F.collect_list(one)).alias("all"),
    )
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return by.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in longs], F.array_join(F.transform("all", lambda x: x["audit"]), "").alias("audit"),
        F.sha2(F.array_join(F.flatten(F.transform("all", lambda x: x["turns"])), "\n"), 256).alias("repaired_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults put in by the remainder of crc32("conv_id:turn") by 20; nulls are one space."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    k = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", k.alias("k"), shown["role"].alias("role"), shown["text"].alias("text")).filter("k != 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = summary(edits(damaged(turns))).withColumnRenamed("conv_id", "own")
    all_ids = turns.select("conv_id").distinct()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_ids.join(done, F.col("conv_id").eqNullSafe(F.col("own")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: crc32 by its polynomial, bit by bit; edits as a recursion over the rows of all conversations, four states each.
ORACLE_SQL = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations
), crc as (
  select name, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: case when x & 1 = 1 then xor(3988292384::bigint, x >> 1) else x >> 1 end))) % 20 as k
  from (select distinct name from src)
), hurt as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from src join crc using (name) where k <> 0
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as initial
  from hurt
), f as (
  select *, case when body = '' then 'blank' when seen then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by i) || initial as pair
  from o
), faults as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from f group by conv_id
), added(x, y, names) as (
  values ('N', 'N', []), ('S', 'S', []), ('U', 'U', []), ('A', 'A', []), ('N', 'U', ['user:']), ('S', 'U', ['user:']), ('A', 'U', ['user:']),
         ('U', 'A', ['assistant:']), ('N', 'A', ['user:', 'assistant:']), ('S', 'A', ['user:', 'assistant:'])
), move(x, y, edit, cost) as (
  values ('N', 'S', 'K', 0), ('N', 'U', 'K', 0), ('S', 'U', 'K', 0), ('A', 'U', 'K', 0), ('U', 'A', 'K', 0), ('N', 'U', 'R', 2), ('S', 'U', 'R', 2),
         ('A', 'U', 'R', 2), ('U', 'A', 'R', 2), ('N', 'N', 'D', 3), ('S', 'S', 'D', 3), ('U', 'U', 'D', 3), ('A', 'A', 'D', 3)
), walk(conv_id, i, state, best) as (
  select conv_id, 0::bigint, 'N', {'cost': 0, 'audit': '', 'turns': []::varchar[]} from faults
  union all
  select w.conv_id, w.i + 1, m.y, min({
           'cost': w.best.cost + 2 * len(a.names) + m.cost + case when m.edit <> 'D' and f.fault = 'truncated' then 1 else 0 end,
           'audit': w.best.audit || repeat('I', len(a.names)) || m.edit,
           'turns': w.best.turns || a.names || case m.edit when 'D' then [] when 'K' then [f.role || ':' || f.text]
                    else [case m.y when 'U' then 'user:' else 'assistant:' end || f.text] end})
  from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join added a on a.x = w.state
  join move m on m.x = a.y and (m.edit <> 'K' or lower(m.y) = f.initial) and (m.edit = 'D' or f.fault not in ('blank', 'duplicate'))
  group by w.conv_id, w.i, m.y
), ended as (
  select w.conv_id, min({'cost': w.best.cost + 2 * len(a.names), 'audit': w.best.audit || repeat('I', len(a.names)), 'turns': w.best.turns || a.names}) as best
  from walk w join faults t on t.conv_id is not distinct from w.conv_id and t.n = w.i join added a on a.x = w.state and a.y in ('N', 'A')
  group by w.conv_id
), done as (
  select t.*, best.cost, best.audit, sha256(array_to_string(best.turns, chr(10))) as repaired_sha256 from faults t join ended e on e.conv_id is not distinct from t.conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join done d on d.conv_id is not distinct from c.conv_id
"""
