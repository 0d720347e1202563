"""Repair of the structure of conversations by cheapest edits.

A conversation's roles shall read `(s?(ua)+)?` by their initials: perhaps a system row, then user and assistant in turn. Each row is
kept (K, free), given the role user or assistant (R, 3) or deleted (D, 4; blank and duplicate rows must be), and empty rows of those
roles may be inserted anywhere (I, 3); a truncated row that stays costs 3 more. Of the cheapest edits the first in ASCII order counts.

1. Rows are dealt by range of (conversation, turn, ...), written with their place in that order, and cut into blocks of BLOCK places,
   so a conversation of any length spreads over tasks. Duplicates are found by counting digests of (conversation, role, text).
2. In a block DuckDB runs a recursive query over all its conversations at once: each recursion advances one row of each and keeps, for
   every state of the grammar that it began in and every one that it is in, the least (cost, edits). Pieces are CUT rows long at most.
   All edits of a piece end with a row's own letter, so of two for the same rows neither begins with the other, and the least prefix
   stays the least.
3. The same query, a piece for a row, joins the pieces of each conversation; only costs and letters travel. A long conversation is
   joined in portions, each the first piece of the next.
4. The letters go back to the blocks, where each row gets its edit.

At most one insertion before a row is tried, and two at the end: two before a row lead back to the same state, or from a lone
system row to where the next may be user, as it could be anyway.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import give_back, spool
from .spelling import CRC_TABLE, crc_sql

#: Places in a block, rows in a piece, and pieces joined at a time.
BLOCK, CUT, PORTION = 1 << 13, 64, 1 << 14
SPACES = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row; where each initial leads from each.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Cost and letters that lead from a state to an end of the grammar.
ENDS = {0: (0, ""), 3: (0, ""), 2: (INSERT, "I"), 1: (2 * INSERT, "II")}


def given(state: int) -> str:
    """The initial of the row that an R or I makes in a state."""
    return "a" if state == 2 else "u"


def moves() -> list[tuple[int, int, int, str, str | None]]:
    """What can be done with a row in a state: (from, to, cost, letters, initial that the row must have to be kept or null)."""
    out = []
    for start in range(4):
        for before, state, cost in (("", start, 0), ("I", AFTER[given(start)][start], INSERT)):
            out.append((start, state, cost + DELETE, before + "D", None))
            out.append((start, AFTER[given(state)][state], cost + REROLE, before + "R", None))
            out += [(start, to[state], cost + KEEP, before + "K", initial) for initial, to in AFTER.items() if state in to]
    return out


MOVES = ", ".join(f"({a}, {b}, {c}, '{e}', {f"'{i}'" if i else 'NULL'})" for a, b, c, e, i in moves())
#: Edges (piece, idx, start, stop, cost, audit) of rows (piece, idx, initial, must, truncated).
ROW_EDGES = f"""
SELECT piece, idx, m.start, m.stop, m.cost + CASE WHEN truncated AND NOT suffix(m.edit, 'D') THEN {TRUNCATED} ELSE 0 END AS cost, m.edit AS audit
FROM given JOIN (VALUES {MOVES}) m(start, stop, cost, edit, initial) ON (m.initial IS NULL OR m.initial = given.initial) AND (suffix(m.edit, 'D') OR NOT must)"""
#: The least (cost, audit) from each origin of a piece to each state after its last row.
WALK = """
WITH RECURSIVE edges AS MATERIALIZED ({edges}),
walk(piece, origin, state, idx, cost, audit) USING KEY (piece, origin, state) AS (
  SELECT piece, origin, origin, 0, 0, '' FROM origins
  UNION
  SELECT piece, origin, stop, any_value(idx) + 1, min(best).cost, min(best).audit
  FROM (SELECT w.piece, w.origin, e.stop, w.idx, struct_pack(cost := w.cost + e.cost, audit := w.audit || e.audit) AS best FROM walk w JOIN edges e ON e.piece = w.piece AND e.idx = w.idx AND e.start = w.state)
  GROUP BY piece, origin, stop)
SELECT walk.piece, origin, state, cost, audit FROM walk JOIN (SELECT piece, max(idx) + 1 AS n FROM edges GROUP BY piece) USING (piece) WHERE idx = n ORDER BY ALL"""


def damage(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) damaged by crc32(`conv_id:turn`) % 20: 0 drops a row (it stays as a mark of its
    conversation, gone), 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 makes its role user. Null roles, texts and parts
    of that key are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), mark.alias("mark"))
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("mark") == 0).alias("gone"), "mark")
    twice = rows.withColumn("copy", F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.drop("mark", "copy")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows with their place in the order of all, and their fault as far as a row alone shows it. Gone rows come first in their
    conversation, so that the others of a block have places in turn."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = df.withColumn("id", F.monotonically_increasing_id())
    order = (F.asc_nulls_first("conv_id"), F.desc("gone"), F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("id"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return spool(rows.select(F.monotonically_increasing_id().alias("place"), "conv_id", "turn", "role", "text", "gone", fault.alias("fault")), "conversation-rows")


def _duplicates(dealt: DataFrame) -> DataFrame:
    """Places of rows whose role and text their conversation has had before; blank ones are left out."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    known = dealt.filter("NOT gone AND fault IS DISTINCT FROM 'blank'").select("place", key.alias("key"))
    first = known.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return known.join(first, "key").filter("place > first").select("place")


def _database():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def least_walks(con, edges: str, rows: dict[str, list], origins: list[tuple[int, int]]) -> list[tuple]:
    """(piece, origin, state, cost, audit) of the pieces of `rows`, columns of the table `given`, by the recursive query."""
    import pyarrow as pa

    con.register("given", pa.table({k: pa.array(v, pa.string() if k in ("initial", "audit") else pa.bool_() if k in ("must", "truncated") else pa.int64()) for k, v in rows.items()}))
    con.register("origins", pa.table({"piece": pa.array([p for p, _ in origins], pa.int64()), "origin": pa.array([o for _, o in origins], pa.int64())}))
    found = con.execute(WALK.format(edges=edges)).fetchall()
    con.unregister("given")
    con.unregister("origins")
    return found


PIECE = "conv_id long, first long, n int, origin int, state int, cost long, audit string"
EDIT = "place long, before string, edit string, given string, after string"


def _pieces(dealt: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The least (cost, audit) of each piece of at most CUT rows, from each state that it can begin in to each that it can end in."""
    initial = F.substring("role", 1, 1)
    rows = dealt.filter("NOT gone").select("place", "conv_id", initial.alias("initial"), F.col("fault").eqNullSafe("blank").alias("must"), F.col("fault").eqNullSafe("truncated").alias("truncated"), F.lit(False).alias("mark"))
    marks = duplicates.select("place", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(True), F.lit(False), F.lit(True)).toDF(*rows.columns)
    both = rows.union(marks).withColumn("block", F.floor(F.col("place") / BLOCK))
    both = both.repartition("block").sortWithinPartitions("place", "mark").select("block", *rows.columns)

    def run(batches: Iterator) -> Iterator:
        con = _database()

        def blocks():
            """Rows of a block: [place, conv_id, initial, must, truncated]."""
            now, held = None, []
            for batch in batches:
                for block, *row, mark in zip(*(c.to_pylist() for c in batch.columns)):
                    if block != now:
                        if held:
                            yield held
                        now, held = block, []
                    if mark:
                        held[-1][3], held[-1][4] = True, False  # the row before it, of the same place
                    else:
                        held.append(row)
            if held:
                yield held

        for held in blocks():
            pieces, given_rows, origins = [], {k: [] for k in ("piece", "idx", "initial", "must", "truncated")}, []
            for conv_id, group in itertools.groupby(held, key=lambda r: r[1]):
                group = list(group)
                for at in range(0, len(group), CUT):
                    part = group[at : at + CUT]
                    # what begins inside a block is a conversation's first piece, unless more than CUT rows of it were before
                    origins += [(len(pieces), o) for o in ((0,) if at == 0 and pieces else range(4))]
                    for idx, (_, _, *row) in enumerate(part):
                        for k, v in zip(given_rows, (len(pieces), idx, *row)):
                            given_rows[k].append(v)
                    pieces.append((conv_id, part[0][0], len(part)))
            found = least_walks(con, ROW_EDGES, given_rows, origins)
            yield _arrow([(*pieces[p], *rest) for p, *rest in found], PIECE)
        con.close()
        give_back()

    return both.mapInArrow(run, PIECE)


def told(audit: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
    """Rows of EDIT for a conversation's letters and its spans of places (first, how many). Only a system row makes the number of rows
    that are left odd, so it tells where user and assistant are."""
    made = sum(audit.count(c) for c in "KRI")
    places = (p for first, n in spans for p in range(first, first + n))
    at, before, row = -(made % 2), "", None
    for letter in audit:
        initial = "ua"[at % 2]
        at += letter != "D"
        if letter == "I":
            before += initial
            continue
        if row:
            yield (*row, "")
        row, before = (next(places), before, letter, initial if letter == "R" else None), ""
    if row:
        yield (*row, before)


def _edits(pieces: DataFrame) -> DataFrame:
    """Each row's edit (EDIT): initials of rows inserted before it, its letter, the initial it is given (R) and, at the end of a
    conversation, initials of rows inserted after it."""

    def run(batches: Iterator) -> Iterator:
        con = _database()
        held: list[tuple[int | None, list, list]] = []  # conversation, spans, edges (idx, start, stop, cost, audit)
        count = 0

        def joined(whole: bool) -> Iterator[tuple]:
            """Edits of the conversations held; the last one, if it may go on, stays as one piece."""
            rows = [(i, *edge) for i, (_, _, edges) in enumerate(held) for edge in edges]
            columns = dict(zip(("piece", "idx", "start", "stop", "cost", "audit"), zip(*rows)))
            found = least_walks(con, "SELECT * FROM given", columns, [(i, 0) for i in range(len(held))])
            walks: list[list] = [[] for _ in held]
            for i, _, state, cost, audit in found:
                walks[i].append((0, 0, state, cost, audit))
            rest = [] if whole else [(held[-1][0], held[-1][1], walks.pop())]
            for (_, spans, _), walk in zip(held, walks):
                yield from told(min((cost + ENDS[state][0], audit + ENDS[state][1]) for _, _, state, cost, audit in walk)[1], spans)
            held[:] = rest

        def edits():
            nonlocal count
            idx, now = 0, None
            for batch in batches:
                for conv_id, first, n, *edge in zip(*(c.to_pylist() for c in batch.columns)):
                    if not held or held[-1][0] != conv_id:
                        if count >= PORTION:
                            yield from joined(True)
                            count = 0
                        held.append((conv_id, [], []))
                        idx, now = -1, None
                    if first != now:
                        if count >= PORTION:
                            yield from joined(False)
                            idx = count = 0
                        idx, now, count = idx + 1, first, count + 1
                        held[-1][1].append((first, n))
                    held[-1][2].append((idx, *edge))
            if held:
                yield from joined(True)

        out = []
        for row in edits():
            out.append(row)
            if len(out) == 10_000:
                yield _arrow(out, EDIT)
                out = []
        yield _arrow(out, EDIT)
        con.close()
        give_back()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(run, EDIT)


REPAIRED = "conv_id long, place long, slot int, turn long, role string, text string, gone boolean, fault string, edit string, repaired_role string"


def repair(df: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text, and perhaps gone: only a mark of its conversation) with their repair, in the
    order of (conv_id, place, slot): their fault (blank, duplicate, truncated or null), edit (K, R, D, or I for rows put in, which
    have a slot other than 0) and repaired_role, null for what is not left. The repaired conversation is the rows with a repaired_role.

    A conversation's rows are taken by turn, null turns first, rows of one turn by role, the first 64 letters of their text, and the
    order they come in. Null roles and texts are one space; rows without a conv_id are one conversation; a role counts by its first
    letter, and one that is none of s, u, a can't be kept. Equal rows are duplicates. An empty table gives no rows.
    """
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone"))
    dealt = _dealt(rows)
    duplicates = spool(_duplicates(dealt), "conversation-duplicates")
    edits = _edits(spool(_pieces(dealt, duplicates), "conversation-pieces"))
    names = ("kind", "conv_id", "turn", "role", "text", "gone", "fault", "before", "edit", "given", "after")
    parts = [duplicates.select("place", F.lit(0).alias("kind")), edits.withColumn("kind", F.lit(1)), dealt.withColumn("kind", F.lit(2))]
    all_rows = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).select("place", *names).withColumn("block", F.floor(F.col("place") / BLOCK))
    all_rows = all_rows.repartition("block").sortWithinPartitions("place", "kind").select("place", *names)

    def run(batches: Iterator) -> Iterator:
        duplicate, edit = False, ("", None, None, "")
        for batch in batches:
            out = []
            for place, kind, conv_id, turn, role, text, gone, fault, *marks in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    duplicate = True
                elif kind == 1:
                    edit = marks
                else:
                    before, letter, given_initial, after = edit
                    made = role if letter == "K" else ROLE[given_initial] if letter == "R" else None
                    put = lambda slot, i: (conv_id, place, slot, None, None, "", False, None, "I", ROLE[i])  # noqa: B023, E731
                    out += [put(i - len(before), c) for i, c in enumerate(before)]
                    out.append((conv_id, place, 0, turn, role, text, gone, "duplicate" if duplicate else fault, letter, made))
                    out += [put(i + 1, c) for i, c in enumerate(after)]
                    duplicate, edit = False, ("", None, None, "")
            yield _arrow(out, REPAIRED)

    return all_rows.mapInArrow(run, REPAIRED)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of repair()'s rows: gaps in its turns, faults, illegal neighbours, cost, letters of all edits and the
    hash of its repaired rows `role:text`, line by line. A task reads conversations row by row and holds one row and one's letters."""

    def run(batches: Iterator) -> Iterator:
        names = ("conv_id", "turn", "role", "text", "gone", "fault", "edit", "repaired_role")
        now, out = None, []

        def done(c):
            gaps = c["last"] - c["first"] + 1 - c["turns"] if c["turns"] else 0
            return (c["conv_id"], gaps, *(c[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(c["audit"]), c["sha"].hexdigest())

        for batch in batches:
            for conv_id, turn, role, text, gone, fault, edit, made in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now["conv_id"] != conv_id:
                    if now is not None:
                        out.append(done(now))
                    now = {"conv_id": conv_id, "turns": 0, "first": None, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "role": None, "lines": 0}
                if gone:
                    continue
                now["audit"].append(edit)
                now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "I":
                    if turn is not None and turn != now["last"]:
                        now["turns"] += 1
                        now["first"], now["last"] = turn if now["first"] is None else now["first"], turn
                    if fault:
                        now[fault] += 1
                    if now["role"] is not None and now["role"][:1] + role[:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["role"] = role
                if made is not None:
                    now["sha"].update(f"{chr(10) if now['lines'] else ''}{made}:{text}".encode("utf-8", "surrogatepass"))
                    now["lines"] += 1
            yield _arrow(out, SUMMARY)
            out = []
        if now is not None:
            yield _arrow([done(now)], SUMMARY)

    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place", "slot")
    return dealt.select("conv_id", "turn", "role", "text", "gone", "fault", "edit", "repaired_role").mapInArrow(run, SUMMARY)


def _arrow(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[name for name, _ in fields])


#: The repair in one query over whole conversations, without blocks and pieces: each step carries the repaired text along.
SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
orig AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS mark FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role, CASE WHEN mark = 1 THEN '' WHEN mark = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN mark = 3 THEN 2 ELSE 1 END)) AS copy FROM orig WHERE mark <> 0),
numbered AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS idx FROM damaged),
judged AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY idx) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY idx) AS previous FROM numbered),
moves(start, stop, cost, edit, initial) AS (VALUES {MOVES}),
edges AS MATERIALIZED (SELECT conv_id, idx, start, stop, cost + CASE WHEN fault = 'truncated' AND NOT suffix(edit, 'D') THEN {TRUNCATED} ELSE 0 END AS cost, edit,
  CASE WHEN prefix(edit, 'I') THEN chr(10) || CASE start WHEN 2 THEN 'assistant:' ELSE 'user:' END ELSE '' END || CASE right(edit, 1) WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE stop WHEN 3 THEN 'assistant:' ELSE 'user:' END || text END AS lines
  FROM judged JOIN moves ON (moves.initial IS NULL OR moves.initial = judged.initial) AND (suffix(edit, 'D') OR fault IS NULL OR fault = 'truncated')),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS idx, 0 AS state, struct_pack(cost := 0, audit := '', lines := '') AS best FROM orig UNION ALL
  SELECT conv_id, any_value(idx) + 1, stop, min(best) FROM (SELECT w.conv_id, w.idx, e.stop, struct_pack(cost := w.best.cost + e.cost, audit := w.best.audit || e.edit, lines := w.best.lines || e.lines) AS best
    FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.idx = w.idx AND e.start = w.state) GROUP BY conv_id, stop),
ends(state, cost, edit, lines) AS (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, {INSERT}, 'I', chr(10) || 'assistant:'), (1, {2 * INSERT}, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
chosen AS (SELECT w.conv_id, min(struct_pack(cost := w.best.cost + ends.cost, audit := w.best.audit || ends.edit, lines := w.best.lines || ends.lines)) AS b
  FROM walk w JOIN ends USING (state) LEFT JOIN stats USING (conv_id) WHERE w.idx = coalesce(n, 0) GROUP BY w.conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.cost::BIGINT AS cost, b.audit AS audit, sha256(substr(b.lines, 2)) AS repaired_sha256 FROM chosen LEFT JOIN stats USING (conv_id)
"""
