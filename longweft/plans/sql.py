"""The same results in ANSI SQL (DuckDB): named steps, put together as common table expressions."""

from __future__ import annotations

import re

from ..operators.sketch import FACTORS, HALVES, PRIME, WORD
from .fixture import CONTIG, K, MOST, OVERLAP_STEP, READ, READ_STEP, STEP, W, Z

STEPS: dict[str, str] = {}
RECURSIVE: set[str] = set()


def query(select: str) -> str:
    """A select over named steps, with the steps that it needs before it."""
    order: list[str] = []
    open_steps: list[str] = []

    def need(text: str):
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in STEPS and name not in order:
                if name not in open_steps:
                    open_steps.append(name)
                    need(STEPS[name])
                    open_steps.pop()
                    if name not in order:
                        order.append(name)

    need(select)
    steps = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({STEPS[n]})" for n in order)
    return f"WITH RECURSIVE {steps}\n{select}" if steps else select


def renamed(end: str, steps: list[str], other: dict[str, str]) -> None:
    """The same steps over other tables, under their names and `end`."""
    names = {**{n: n + end for n in steps}, **other}
    for n in steps:
        STEPS[n + end] = re.sub(r"\b[a-z_0-9]+\b", lambda m: names.get(m[0], m[0]), STEPS[n])


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def flip(x: str) -> str:
    return f"translate({x}, '+-', '-+')"


def pieces(size: int, step: int, letter: str, odd: str) -> str:
    part = f"substr(seq, {step} * i + 1, {size})"
    count = f"greatest((length - {max(0, size - step)} + {step - 1}) // {step}, 1)"
    return f"SELECT '{letter}' || lpad(doc_id::VARCHAR, 8, '0') || '_' || lpad(i::VARCHAR, 4, '0') AS id, CASE WHEN {odd} THEN {rc(part)} ELSE {part} END AS seq FROM (SELECT doc_id, seq, unnest(range(0, {count})) AS i FROM s_dna WHERE length > 0)"


def kmers(table: str, id_col: str, k: int = K) -> str:
    """K-mers (of 21 bases at most) with the hash of sketch.hashes()."""
    bits = "least(f, r)"
    for base, two in zip("ACGT", ("00", "01", "10", "11")):
        bits = f"replace({bits}, '{base}', '{two}')"
    rows = f"SELECT {id_col} AS id, pos, substr(seq, pos + 1, {k}) AS f FROM (SELECT {id_col}, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM {table} WHERE length(seq) >= {k})"
    code = f"SELECT id, pos, CASE WHEN f <= r THEN '+' ELSE '-' END AS strand, {bits}::BIT::BIGINT AS c FROM (SELECT *, {rc('f')} AS r FROM ({rows}))"
    linear = f"SELECT id, pos, strand, ((c & {(1 << WORD) - 1}) * {FACTORS[0]} + (c >> {WORD}) * {FACTORS[1]}) % {PRIME} AS h FROM ({code})"
    return f"SELECT id, pos, ((xor(h, h >> 29) >> 31) * {HALVES[0]} + (xor(h, h >> 29) & {(1 << 31) - 1}) * {HALVES[1]}) % {PRIME} AS hash, strand FROM ({linear})"


def minimizers(table: str, w: int = W) -> str:
    return f"""SELECT DISTINCT s.id, s.pos, s.hash, s.strand FROM {table} s JOIN (
SELECT id, min(hash::HUGEINT * 1048576 + pos) OVER win AS m, count(*) OVER win AS n FROM {table} WINDOW win AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)
) x ON x.id = s.id AND x.n = {w} AND s.pos = x.m % 1048576"""


def runs(hits: str) -> str:
    return f"SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY hit_idx)::INT AS run_idx FROM (SELECT *, CASE WHEN contig <> lag(contig) OVER (PARTITION BY read_id ORDER BY hit_idx) THEN 1 ELSE 0 END AS new FROM {hits})"


STEPS["s_dna"] = "SELECT doc_id, seq, length(seq) AS length FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents WHERE text IS NOT NULL)"
STEPS["contigs"] = f"SELECT id AS contig, seq, length(seq)::INT AS length FROM ({pieces(CONTIG, STEP, 'c', 'i % 2 = 1')})"
STEPS["contigs_ov"] = f"SELECT id AS contig, seq, length(seq)::INT AS length FROM ({pieces(CONTIG, OVERLAP_STEP, 'c', 'i % 2 = 1')})"
STEPS["reads"] = f"SELECT id AS read_id, seq, length(seq)::INT AS read_len FROM ({pieces(READ, READ_STEP, 'r', '(doc_id + i) % 2 = 1')})"
STEPS["read_kmers"] = kmers("reads", "read_id")
STEPS["read_mx"] = minimizers("read_kmers")
for _o in ("", "_ov"):
    STEPS[f"target_kmers{_o}"] = kmers(f"contigs{_o}", "contig")
    STEPS[f"target_mx{_o}"] = minimizers(f"target_kmers{_o}")
    STEPS[f"target_index{_o}"] = f"SELECT hash, min(id) AS contig, min(pos)::INT AS cpos, min(strand) AS cstrand FROM target_mx{_o} GROUP BY hash HAVING count(*) = 1"
    STEPS[f"hits{_o}"] = f"""SELECT m.id AS read_id, (row_number() OVER (PARTITION BY m.id ORDER BY m.pos) - 1)::INT AS hit_idx, hash, m.pos::INT AS rpos, m.strand AS rstrand, contig, cpos, cstrand, length, read_len
FROM read_mx m JOIN target_index{_o} USING (hash) JOIN contigs{_o} c USING (contig) JOIN reads r ON r.read_id = m.id WHERE length >= {Z}"""
    STEPS[f"noisy{_o}"] = f"SELECT read_id, contig, count(*) AS n, max(cpos) - min(cpos) AS span FROM hits{_o} GROUP BY read_id, contig HAVING count(*) >= 2 AND max(cpos) - min(cpos) > min(read_len) + {K}"
    STEPS[f"run_hits{_o}"] = runs(f"(SELECT * FROM hits{_o} ANTI JOIN noisy{_o} USING (read_id, contig))")
    STEPS[f"bounds{_o}"] = f"SELECT *, min(run_idx) OVER (PARTITION BY read_id, contig) AS first, max(run_idx) OVER (PARTITION BY read_id, contig) AS last FROM (SELECT read_id, run_idx, contig, count(*)::INT AS hit_count FROM run_hits{_o} GROUP BY ALL)"
    STEPS[f"specific{_o}"] = f"SELECT DISTINCT b.read_id, b.contig FROM bounds{_o} b JOIN bounds{_o} c ON b.read_id = c.read_id AND c.first < b.run_idx AND b.run_idx < c.last"
    STEPS[f"accepted{_o}"] = f"SELECT * FROM run_hits{_o} ANTI JOIN specific{_o} USING (read_id, contig)"
    STEPS[f"mapped{_o}"] = f"""SELECT *, (row_number() OVER (PARTITION BY read_id ORDER BY seen) - 1)::INT AS map_idx FROM (SELECT read_id, contig, min(hit_idx) AS seen, count(*)::INT AS hit_count, min(read_len) AS read_len, min(length) AS length,
arg_min(cpos, hit_idx) AS hc, arg_min(cstrand, hit_idx) AS hcs, arg_min(rpos, hit_idx) AS hr, arg_min(rstrand, hit_idx) AS hrs, arg_max(cpos, hit_idx) AS tc, arg_max(cstrand, hit_idx) AS tcs, arg_max(rpos, hit_idx) AS tr, arg_max(rstrand, hit_idx) AS trs,
string_agg(cpos || ':' || cstrand || '_' || rpos || ':' || rstrand, ' ' ORDER BY hit_idx) AS hit_text FROM accepted{_o} GROUP BY read_id, contig)"""


def pair_rows(mapped: str, f: int) -> str:
    return f"""SELECT a.read_id, {{cols}} FROM (SELECT *, count(*) OVER (PARTITION BY read_id) AS total, CASE WHEN hit_count > 1 THEN sum((hit_count > 1)::INT) OVER (PARTITION BY read_id ORDER BY map_idx) END AS strong FROM {mapped}) a
JOIN (SELECT *, CASE WHEN hit_count > 1 THEN sum((hit_count > 1)::INT) OVER (PARTITION BY read_id ORDER BY map_idx) END AS strong FROM {mapped}) b ON a.read_id = b.read_id AND a.map_idx < b.map_idx
AND (total <= {f} OR b.map_idx = a.map_idx + 1 OR b.strong = a.strong + 1)"""


def estimates(mapped: str, f: int = MOST, read_len: str = "a.read_len", k: int = K) -> str:
    cols = f"""a.contig AS ac, b.contig AS bc, CASE WHEN a.tcs = a.trs THEN '+' ELSE '-' END AS so, CASE WHEN b.hcs = b.hrs THEN '+' ELSE '-' END AS tto, {read_len} AS read_len,
b.hr - a.tr - (CASE WHEN a.tcs = a.trs THEN a.length - a.tc - {k} ELSE a.tc END) - (CASE WHEN b.hcs = b.hrs THEN b.hc ELSE b.length - b.hc - {k} END) AS gap, a.hit_count > 1 AND b.hit_count > 1 AS anchored"""
    return f"""SELECT read_id, CASE WHEN ac < bc THEN ac ELSE bc END AS source, CASE WHEN ac < bc THEN so ELSE {flip('tto')} END AS source_ori, CASE WHEN ac < bc THEN bc ELSE ac END AS target,
CASE WHEN ac < bc THEN tto ELSE {flip('so')} END AS target_ori, gap::INT AS gap, anchored, read_len FROM ({pair_rows(mapped, f).format(cols=cols)}) WHERE abs(gap) <= read_len"""


TALLY = "SELECT source, source_ori, target, target_ori, count(*) AS n, trunc(median(gap))::INT AS d, count(*) FILTER (WHERE anchored) AS anchor FROM {} GROUP BY ALL"
for _o in ("", "_ov"):
    STEPS[f"estimates{_o}"] = estimates(f"mapped{_o}")
    STEPS[f"tally{_o}"] = TALLY.format(f"estimates{_o}")
    STEPS[f"edges{_o}"] = f"SELECT t.* FROM tally{_o} t JOIN contigs{_o} s ON s.contig = source JOIN contigs{_o} u ON u.contig = target WHERE anchor >= 1 AND n >= 1 AND d > -s.length AND d > -u.length"
    STEPS[f"graph{_o}"] = f"SELECT source || source_ori AS src, target || target_ori AS dst, d, 100 AS e, n FROM edges{_o} UNION ALL SELECT target || {flip('target_ori')}, source || {flip('source_ori')}, d, 100, n FROM edges{_o}"


def layout_steps(o: str, graph: str, by: str = "") -> None:
    """Steps from a graph to named paths, for each value of the column `by` if there is one."""
    b, same = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    using = f"{b}src, dst"
    ab = f"a.{by}, " if by else ""
    STEPS[f"hop1{o}"] = f"SELECT DISTINCT {b}src, dst FROM {graph}"
    # open edges and all that their sources' other ways out lead to, however far
    STEPS[f"open{o}"] = f"SELECT * FROM hop1{o} WHERE src <> dst QUALIFY count(*) OVER (PARTITION BY {b}src) > 1 AND count(*) OVER (PARTITION BY {b}dst) > 1"
    STEPS[f"walk{o}"] = f"""SELECT {ab}a.src, a.dst, b.dst AS met FROM open{o} a JOIN hop1{o} b ON {same}a.src = b.src WHERE b.dst <> a.dst AND b.dst <> a.src
UNION SELECT {ab}a.src, a.dst, b.dst FROM walk{o} a JOIN hop1{o} b ON {same}a.met = b.src WHERE b.dst <> a.src AND a.met <> a.dst"""
    RECURSIVE.add(f"walk{o}")
    STEPS[f"reduced{o}"] = f"SELECT * FROM {graph} ANTI JOIN (SELECT * FROM walk{o} WHERE met = dst) USING ({using})"
    top = f"SELECT *, max(n) OVER (PARTITION BY {b}src) AS ts, max(n) OVER (PARTITION BY {b}dst) AS td FROM reduced{o}"
    ties = f"SELECT *, count(*) FILTER (WHERE n = ts) OVER (PARTITION BY {b}src) AS cs, count(*) FILTER (WHERE n = td) OVER (PARTITION BY {b}dst) AS cd FROM ({top})"
    STEPS[f"best{o}"] = f"SELECT {b}src, dst, d, n FROM ({ties}) WHERE n = ts AND n = td AND cs = 1 AND cd = 1"
    STEPS[f"chain{o}"] = f"""SELECT {b}src AS start, 0 AS step, src AS node FROM best{o} ANTI JOIN (SELECT DISTINCT {b}dst AS src FROM best{o}) USING ({b}src)
UNION ALL SELECT {ab}a.start, a.step + 1, b.dst FROM chain{o} a JOIN best{o} b ON {same}b.src = a.node"""
    RECURSIVE.add(f"chain{o}")
    w = f"(PARTITION BY {b}start)"
    STEPS[f"paths{o}"] = f"""SELECT {b}start, step::BIGINT AS step, left(node, length(node) - 1) AS contig, right(node, 1) AS ori, CASE WHEN d IS NOT NULL THEN (greatest(d, 20) + 1)::INT END AS gap, d FROM (
SELECT a.*, b.d, arg_min(left(node, length(node) - 1), step) OVER {w.replace('(PARTITION BY ', '(PARTITION BY a.')} AS first, arg_max(left(node, length(node) - 1), step) OVER {w.replace('(PARTITION BY ', '(PARTITION BY a.')} AS last FROM chain{o} a LEFT JOIN best{o} b ON {same}b.src = a.node) WHERE first < last"""
    if not by:
        STEPS[f"named{o}"] = f"""SELECT path_id, step, contig, ori, gap, d FROM paths{o} JOIN (SELECT start, 'scaffold_' || (row_number() OVER (ORDER BY nodes DESC, head DESC) - 1) AS path_id
FROM (SELECT start, 2 * count(*) - 1 AS nodes, arg_min(contig || ori, step) AS head FROM paths{o} GROUP BY start)) USING (start)"""


STEPS["graph_w"] = "SELECT src, dst, d, n, unnest(range(1, least(10, n) + 1))::INT AS w FROM graph"
layout_steps("", "graph")
layout_steps("_ov", "graph_ov")
layout_steps("_w", "graph_w", "w")
STEPS["made_w"] = "SELECT w, sum(length) + sum(coalesce(gap - 1, 0)) AS length FROM paths_w JOIN contigs USING (contig) GROUP BY w, start"
STEPS["lengths_w"] = "SELECT w, length FROM made_w UNION ALL SELECT w, length FROM (SELECT DISTINCT w FROM paths_w), contigs WHERE (w, contig) NOT IN (SELECT (w, contig) FROM paths_w)"
STEPS["n50_w"] = "SELECT w, max(length)::BIGINT AS n50 FROM (SELECT w, length, sum(length) OVER (PARTITION BY w ORDER BY length DESC) AS s, sum(length) OVER (PARTITION BY w) AS t FROM lengths_w) WHERE s >= t * 0.5 GROUP BY w"

# overlaps, with the fine sketch (k 15, w 5)
FINE_K, FINE_W = 15, 5
for _n, _t in (("fine", "contigs"), ("fine_ov", "contigs_ov")):
    STEPS[f"{_n}_kmers"] = kmers(_t, "contig", FINE_K)
    STEPS[f"{_n}_mx"] = minimizers(f"{_n}_kmers", FINE_W)
STEPS["next_ov"] = "SELECT path_id, step, contig AS source, ori AS source_ori, gap, d, lead(contig) OVER w AS target, lead(ori) OVER w AS target_ori FROM named_ov WINDOW w AS (PARTITION BY path_id ORDER BY step)"
STEPS["sides_ov"] = """SELECT path_id, step, -d AS o, 'source' AS side, source AS contig, source_ori AS ori FROM next_ov WHERE target IS NOT NULL AND d < 0 AND gap <= 21
UNION ALL SELECT path_id, step, -d, 'target', target, target_ori FROM next_ov WHERE target IS NOT NULL AND d < 0 AND gap <= 21"""
STEPS["regions_ov"] = f"""SELECT path_id, step, side, contig, ori, length, CASE WHEN tail THEN length - o - {FINE_K} - floor(o * 0.5)::INT ELSE 0 END AS start, CASE WHEN tail THEN length ELSE floor(o * 1.5)::INT END AS stop
FROM (SELECT *, (side = 'source') = (ori = '+') AS tail FROM sides_ov JOIN contigs_ov USING (contig))"""
STEPS["inside_ov"] = "SELECT contig, hash, pos FROM (SELECT DISTINCT m.id AS contig, m.hash, m.pos FROM fine_ov_mx m JOIN regions_ov r ON r.contig = m.id AND m.pos BETWEEN r.start AND r.stop) QUALIFY count(*) OVER (PARTITION BY contig, hash) = 1"
STEPS["shared_ov"] = """SELECT s.path_id, s.step, a.hash, a.pos::INT AS spos, b.pos::INT AS tpos, s.ori AS sori, t.ori AS tori, s.length AS slen, t.length AS tlen FROM regions_ov s JOIN regions_ov t ON s.path_id = t.path_id AND s.step = t.step AND s.side = 'source' AND t.side = 'target'
JOIN inside_ov a ON a.contig = s.contig AND a.pos BETWEEN s.start AND s.stop JOIN inside_ov b ON b.contig = t.contig AND b.hash = a.hash AND b.pos BETWEEN t.start AND t.stop"""
STEPS["ranked_ov"] = "SELECT *, row_number() OVER (PARTITION BY path_id, step ORDER BY spos) AS rs, row_number() OVER (PARTITION BY path_id, step ORDER BY tpos) AS rt FROM shared_ov"
STEPS["islands_ov"] = "SELECT *, sum(new) OVER (PARTITION BY path_id, step ORDER BY rs)::INT AS island FROM (SELECT *, CASE WHEN abs(rt - lag(rt) OVER (PARTITION BY path_id, step ORDER BY rs)) <> 1 THEN 1 ELSE 0 END AS new FROM ranked_ov)"
STEPS["whole_islands"] = """SELECT path_id, step, island, count(*) AS c, list(hash ORDER BY rs) AS hs, list(spos ORDER BY rs) AS ss, list(tpos ORDER BY rs) AS tt, min(sori) AS sori, min(tori) AS tori, min(slen) AS slen, min(tlen) AS tlen FROM islands_ov GROUP BY ALL"""
STEPS["mid_islands"] = """SELECT *, CASE WHEN hs[1]::VARCHAR > hs[c]::VARCHAR THEN c - c // 2 ELSE c // 2 + 1 END AS m, CASE WHEN c = 1 THEN 1.0 ELSE (abs(ss[1] - ss[c]) + abs(tt[1] - tt[c])) / 2 END AS size FROM whole_islands"""
STEPS["cuts_ov"] = """SELECT path_id, step, ss[m] AS spos, tt[m] AS tpos, hs[m] AS hash FROM mid_islands
QUALIFY row_number() OVER (PARTITION BY path_id, step ORDER BY size DESC, (CASE WHEN sori = '+' THEN ss[m] - slen ELSE -ss[m] END + CASE WHEN tori = '-' THEN tt[m] - tlen ELSE -tt[m] END) / 2 DESC, hs[m]::VARCHAR DESC) = 1"""
STEPS["cut_paths"] = "SELECT p.*, c.spos AS source_cut, lag(c.tpos) OVER (PARTITION BY p.path_id ORDER BY p.step) AS target_cut, c.spos IS NOT NULL AS found FROM named_ov p LEFT JOIN cuts_ov c ON c.path_id = p.path_id AND c.step = p.step"
STEPS["trims_ov"] = f"""SELECT contig, ori, source_cut, target_cut, start, stop, source_cut IS NOT NULL AND target_cut IS NOT NULL AND start >= stop AS omitted FROM (
SELECT contig, ori, source_cut, target_cut, CASE ori WHEN '+' THEN coalesce(target_cut, 0) WHEN '-' THEN coalesce(source_cut + {FINE_K}, 0) ELSE 0 END AS start, CASE ori WHEN '+' THEN coalesce(source_cut, length) WHEN '-' THEN coalesce(target_cut + {FINE_K}, length) ELSE length END AS stop
FROM (SELECT c.contig, length, source_cut, target_cut, CASE WHEN source_cut IS NOT NULL OR target_cut IS NOT NULL THEN p.ori END AS ori FROM contigs_ov c LEFT JOIN cut_paths p ON p.contig = c.contig))"""
STEPS["trimmed_ov"] = """SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY step) - 1 AS step, contig, ori, gap, d FROM (SELECT path_id, step, contig, ori, d, omitted, CASE WHEN gap IS NULL THEN NULL WHEN lead(omitted) OVER (PARTITION BY path_id ORDER BY step) THEN 21 WHEN found THEN 1 ELSE gap END AS gap
FROM (SELECT p.*, t.omitted FROM cut_paths p JOIN trims_ov t ON t.contig = p.contig)) WHERE NOT omitted"""
STEPS["agp_parts"] = """SELECT path_id, step, 0 AS second, 'W' AS kind, stop - start AS size, contig AS component, (start + 1)::VARCHAR AS "from", stop::VARCHAR AS "to", p.ori FROM trimmed_ov p JOIN trims_ov t USING (contig)
UNION ALL SELECT path_id, step, 1, 'N', gap - 1, (gap - 1)::VARCHAR, 'scaffold', 'yes', 'paired-ends' FROM trimmed_ov WHERE gap > 1"""
STEPS["agp_ov"] = """SELECT path_id AS object, (stop0 - size + 1)::BIGINT AS start, stop0::BIGINT AS stop, part::INT AS part, kind, component, "from", "to", ori FROM (SELECT *, sum(size) OVER w AS stop0, row_number() OVER w AS part FROM agp_parts WINDOW w AS (PARTITION BY path_id ORDER BY step, second))
UNION ALL SELECT contig, 1, stop - start, 1, 'W', contig, (start + 1)::VARCHAR, stop::VARCHAR, '+' FROM trims_ov WHERE NOT omitted AND contig NOT IN (SELECT contig FROM trimmed_ov)"""


def oriented(seq: str, ori: str) -> str:
    return f"CASE WHEN {ori} = '-' THEN reverse(translate({seq}, 'ACGTacgt', 'TGCAtgca')) ELSE {seq} END"


STEPS["cut_seqs"] = "SELECT contig, contig || ' ' || coalesce(source_cut::VARCHAR, 'None') || '-' || coalesce(target_cut::VARCHAR, 'None') AS header, CASE WHEN stop <= start THEN 'N' ELSE substr(seq, start + 1, stop - start) END AS seq FROM contigs_ov JOIN trims_ov USING (contig) WHERE NOT omitted"
STEPS["merge_pieces"] = f"SELECT path_id, step, contig, p.ori, gap, {oriented('seq', 'p.ori')} AS piece, lag(gap) OVER (PARTITION BY path_id ORDER BY step) = 1 AS joined FROM trimmed_ov p JOIN cut_seqs USING (contig)"
STEPS["merged"] = """SELECT path_id AS id, string_agg(contig || ori || CASE WHEN gap IS NULL THEN '' ELSE ',' || (gap - 1) || 'N' END, ',' ORDER BY step) AS members,
string_agg((CASE WHEN joined THEN lower(left(piece, 1)) || substr(piece, 2) ELSE piece END) || repeat('N', (coalesce(gap, 1) - 1)::INT), '' ORDER BY step) AS seq FROM merge_pieces GROUP BY path_id
UNION ALL SELECT contig, contig, seq FROM cut_seqs WHERE contig NOT IN (SELECT contig FROM trimmed_ov)"""


def stats(table: str) -> str:
    return f"""SELECT n, n_500, l50, min, n75, n50, n25, e_size, max, sum FROM (SELECT count(*) AS n FROM {table}), (SELECT count(*) AS n_500, min(k) FILTER (WHERE s >= t * 0.5) AS l50, min(l) AS min, max(l) FILTER (WHERE s >= t * 0.75) AS n75, max(l) FILTER (WHERE s >= t * 0.5) AS n50,
max(l) FILTER (WHERE s >= t * 0.25) AS n25, floor(sum(l::DOUBLE * l) / sum(l))::BIGINT AS e_size, max(l) AS max, sum(l)::BIGINT AS sum FROM (SELECT l, sum(l) OVER (ORDER BY l DESC, id) AS s, sum(l) OVER () AS t, row_number() OVER (ORDER BY l DESC, id) AS k
FROM (SELECT id, length(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) AS l FROM {table}) WHERE l >= 500))"""


# PAF
STEPS["paf_sorted"] = """SELECT *, row_number() OVER (PARTITION BY read_id, contig ORDER BY cpos, rpos, same) - 1 AS i, count(*) OVER (PARTITION BY read_id, contig) AS n, count(*) OVER (PARTITION BY read_id, contig, cpos) > 1 AS dup FROM (SELECT read_id, read_len, contig, length, hit_idx, cpos, rpos, cstrand = rstrand AS same FROM accepted)"""
STEPS["paf_flags"] = """SELECT *, count(*) FILTER (WHERE rpos <= r1) OVER m AS ups, count(*) FILTER (WHERE rpos >= r1) OVER m AS downs, bool_and(h1 IS NULL OR h1 > hit_idx) OVER m OR bool_and(h1 IS NULL OR h1 < hit_idx) OVER m AS untouched FROM (
SELECT *, lead(rpos) OVER w AS r1, lead(rpos, 2) OVER w AS r2, lag(rpos) OVER w AS r0, lead(dup) OVER w AS d1, lead(dup, 2) OVER w AS d2, lag(dup) OVER w AS d0, lead(hit_idx) OVER w AS h1 FROM paf_sorted WINDOW w AS (PARTITION BY read_id, contig ORDER BY i)) WINDOW m AS (PARTITION BY read_id, contig)"""
STEPS["paf_mode"] = "SELECT *, CASE WHEN untouched OR ups = n - 1 OR downs = n - 1 THEN 'all' WHEN ups / (n - 1) >= 0.75 THEN 'up' WHEN (n - 1 - ups) / (n - 1) >= 0.75 THEN 'down' END AS mode FROM paf_flags"
STEPS["paf_act"] = """SELECT *, CASE WHEN mode = 'all' OR r1 IS NULL OR (CASE WHEN mode = 'up' THEN rpos <= r1 ELSE rpos >= r1 END) OR dup OR d1 THEN NULL WHEN i + 2 >= n - 1 THEN 'break next' WHEN dup OR d2 OR (CASE WHEN mode = 'up' THEN rpos <= r2 ELSE rpos >= r2 END) THEN 'drop next'
WHEN i > 0 AND (d0 OR d1 OR (CASE WHEN mode = 'up' THEN r0 <= r1 ELSE r0 >= r1 END)) THEN 'drop this' ELSE 'break next' END AS act FROM paf_mode WHERE mode IS NOT NULL"""
STEPS["paf_left"] = "SELECT * FROM (SELECT *, lag(act) OVER (PARTITION BY read_id, contig ORDER BY i) AS prev FROM paf_act) WHERE coalesce(act <> 'drop this', true) AND coalesce(prev <> 'drop next', true)"
STEPS["paf_blocks"] = "SELECT *, sum((coalesce(prev = 'break next', false))::INT) OVER (PARTITION BY read_id, contig ORDER BY i)::BIGINT AS block FROM paf_left"
PAF = f"""SELECT read_id AS q, min(read_len) AS qlen, least(arg_min(rpos, i), arg_max(rpos, i)) AS qs, greatest(arg_min(rpos, i), arg_max(rpos, i)) + {K} AS qe, CASE WHEN avg(same::INT) >= 0.5 THEN '+' ELSE '-' END AS strand, contig AS t, min(length) AS tlen,
least(arg_min(cpos, i), arg_max(cpos, i)) AS ts, greatest(arg_min(cpos, i), arg_max(cpos, i)) + {K} AS te, count(*) AS hits, abs(arg_min(cpos, i) - arg_max(cpos, i)) + {K} AS span, 255 AS mapq FROM paf_blocks GROUP BY read_id, contig, block"""


# gaps filled by reads
STEPS["gap_pairs"] = "SELECT path_id, step, source, source_ori, target, target_ori, gap - 1 AS gap_size FROM nexts WHERE gap > 2"
STEPS["good"] = """SELECT m.*, CASE WHEN allsame THEN '+' ELSE '-' END AS ori FROM mapped m JOIN (SELECT read_id, contig, bool_and(same) AS allsame, bool_or(same) AS anysame, bool_and(coalesce(step > 0, true)) OR bool_and(coalesce(step < 0, true)) AS mono FROM (
SELECT read_id, contig, cstrand = rstrand AS same, cpos - lag(cpos) OVER (PARTITION BY read_id, contig ORDER BY hit_idx) AS step FROM accepted) GROUP BY ALL) USING (read_id, contig) WHERE mono AND (allsame OR NOT anysame)"""
STEPS["supports"] = """SELECT g.*, a.read_id, a.ori AS ao, b.ori AS bo, a.map_idx AS ai, b.map_idx AS bi, a.hit_count AS an, b.hit_count AS bn, a.length AS al, b.length AS bl, a.hc AS ahc, a.hr AS ahr, a.tc AS atc, a.tr AS atr, b.hc AS bhc, b.hr AS bhr, b.tc AS btc, b.tr AS btr,
(SELECT arg_max(x.tr, x.map_idx) FROM good x WHERE x.read_id = a.read_id) AS read_span FROM gap_pairs g JOIN good a ON a.contig = source JOIN good b ON b.contig = target AND b.read_id = a.read_id
WHERE (a.map_idx < b.map_idx AND a.ori = source_ori AND b.ori = target_ori) OR (a.map_idx > b.map_idx AND a.ori = translate(source_ori, '+-', '-+') AND b.ori = translate(target_ori, '+-', '-+'))"""


def gap_of(tc: str, tr: str, l1: str, o1: str, hc: str, hr: str, l2: str, o2: str) -> str:
    return f"{hr} - {tr} - CASE WHEN {o1} = '+' THEN {l1} - {tc} - {K} ELSE {tc} END - CASE WHEN {o2} = '+' THEN {hc} ELSE {l2} - {hc} - {K} END"


STEPS["gap_est"] = f"""SELECT *, (CASE WHEN ai < bi THEN {gap_of('atc', 'atr', 'al', 'source_ori', 'bhc', 'bhr', 'bl', 'target_ori')} ELSE {gap_of('btc', 'btr', 'bl', flip('target_ori'), 'ahc', 'ahr', 'al', flip('source_ori'))} END)::INT AS est, (an + bn) / 2 AS mean_hits FROM supports"""
STEPS["best_reads"] = "SELECT * FROM gap_est WHERE abs(est) <= read_span QUALIFY row_number() OVER (PARTITION BY path_id, step ORDER BY mean_hits DESC, read_id DESC) = 1"
STEPS["gap_cuts"] = f"""SELECT path_id, step, source, source_ori, target, target_ori, gap_size, read_id, ao AS read_ori, CASE WHEN ao = source_ori THEN atc ELSE ahc END + CASE WHEN ao = source_ori AND source_ori = '-' THEN {K} ELSE 0 END AS source_ctg_cut,
CASE WHEN ao = source_ori THEN atr ELSE ahr END + CASE WHEN ao <> source_ori AND source_ori = '+' THEN {K} ELSE 0 END AS source_read_cut, CASE WHEN bo = target_ori THEN bhc ELSE btc END + CASE WHEN bo = target_ori AND target_ori = '-' THEN {K} ELSE 0 END AS target_ctg_cut,
CASE WHEN bo = target_ori THEN bhr ELSE btr END + CASE WHEN bo <> target_ori AND target_ori = '+' THEN {K} ELSE 0 END AS target_read_cut FROM best_reads"""


def keep_span(start: str, stop: str) -> str:
    return f"repeat('N', {start}) || substr(seq, {start} + 1, greatest({stop} - {start}, 0)) || repeat('N', greatest(length(seq) - greatest({stop}, {start}), 0))"


STEPS["masked"] = f"""SELECT path_id, step, 'source' AS role, source AS name, CASE WHEN source_ori = '+' THEN {keep_span('source_ctg_cut', 'length(seq)')} ELSE {keep_span('0', 'source_ctg_cut')} END AS seq FROM gap_cuts JOIN contigs ON contig = source
UNION ALL SELECT path_id, step, 'target', target, CASE WHEN target_ori = '+' THEN {keep_span('0', 'target_ctg_cut')} ELSE {keep_span('target_ctg_cut', 'length(seq)')} END FROM gap_cuts JOIN contigs ON contig = target
UNION ALL SELECT path_id, step, 'read', read_id, {keep_span('least(source_read_cut, target_read_cut)', 'greatest(source_read_cut, target_read_cut)')} FROM gap_cuts JOIN reads USING (read_id)"""
STEPS["gap_ends"] = """SELECT contig, max(five) AS five, min(three) AS three FROM (SELECT source AS contig, CASE WHEN source_ori = '-' THEN source_ctg_cut END AS five, CASE WHEN source_ori = '+' THEN source_ctg_cut END AS three FROM gap_cuts
UNION ALL SELECT target, CASE WHEN target_ori = '+' THEN target_ctg_cut END, CASE WHEN target_ori = '-' THEN target_ctg_cut END FROM gap_cuts) GROUP BY contig"""
STEPS["gap_spans"] = "SELECT contig, coalesce(five, 0) AS start, coalesce(three, length) AS stop FROM contigs LEFT JOIN gap_ends USING (contig)"
STEPS["placed"] = """SELECT *, CASE WHEN read_id IS NULL THEN coalesce(gap, 1) - 1 ELSE 0 END AS n_left FROM (SELECT p.path_id, p.step, p.contig, p.ori, p.gap, s.start, s.stop, c.read_id, CASE WHEN read_ori = source_ori THEN '+' ELSE '-' END AS read_strand, least(source_read_cut, target_read_cut) AS r0,
CASE WHEN (read_ori = source_ori) = (source_read_cut > target_read_cut) AND source_read_cut <> target_read_cut THEN least(source_read_cut, target_read_cut) ELSE greatest(source_read_cut, target_read_cut) END AS r1
FROM named p JOIN gap_spans s USING (contig) LEFT JOIN gap_cuts c ON c.path_id = p.path_id AND c.step = p.step)"""
STEPS["fill_pieces"] = f"""SELECT path_id, step, lag(gap) OVER (PARTITION BY path_id ORDER BY step) = 1 AS joined, {oriented('substr(c.seq, start + 1, greatest(stop - start, 0))', 'ori')} AS piece,
CASE WHEN p.read_id IS NULL THEN repeat('N', n_left) ELSE {oriented('substr(r.seq, r0 + 1, greatest(r1 - r0, 0))', 'read_strand')} END AS after FROM placed p JOIN contigs c USING (contig) LEFT JOIN reads r ON r.read_id = p.read_id"""
STEPS["filled"] = """SELECT path_id AS id, string_agg(CASE WHEN joined THEN lower(left(piece, 1)) || substr(piece, 2) ELSE piece END || after, '' ORDER BY step) AS seq FROM fill_pieces GROUP BY path_id
UNION ALL SELECT contig, seq FROM contigs WHERE contig NOT IN (SELECT contig FROM named)"""
STEPS["fill_parts"] = """SELECT path_id, step, 0 AS second, 'W' AS kind, stop - start AS size, contig AS component, (start + 1)::VARCHAR AS "from", stop::VARCHAR AS "to", ori FROM placed
UNION ALL SELECT path_id, step, 1, 'P', r1 - r0, read_id, (r0 + 1)::VARCHAR, r1::VARCHAR, read_strand FROM placed WHERE read_id IS NOT NULL UNION ALL SELECT path_id, step, 2, 'N', n_left, n_left::VARCHAR, 'scaffold', 'yes', 'paired-ends' FROM placed"""
STEPS["fill_agp"] = """SELECT path_id AS object, (stop0 - size + 1)::BIGINT AS start, stop0::BIGINT AS stop, part::INT AS part, kind, component, "from", "to", ori FROM (SELECT *, sum(size) OVER w AS stop0, row_number() OVER w AS part FROM fill_parts WHERE size > 0 WINDOW w AS (PARTITION BY path_id ORDER BY step, second))
UNION ALL SELECT contig, 1, stop - start, 1, 'W', contig, (start + 1)::VARCHAR, stop::VARCHAR, '+' FROM gap_spans WHERE contig NOT IN (SELECT contig FROM named)"""

# liftover to the scaffolds of the plain paths
STEPS["plain_parts"] = """SELECT path_id, step, contig, ori, gap, length, sum(length + coalesce(gap - 1, 0)) OVER (PARTITION BY path_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM named JOIN contigs USING (contig)"""
STEPS["plain_agp"] = "SELECT path_id AS object, coalesce(before, 0) + 1 AS s0, contig, 1 AS c0, length AS c1, ori AS o FROM plain_parts UNION ALL SELECT contig, 1, contig, 1, length, '+' FROM contigs WHERE contig NOT IN (SELECT contig FROM named)"
STEPS["lifted"] = f"""SELECT read_id, read_len, map_idx, object AS contig, (row_number() OVER (PARTITION BY read_id, map_idx ORDER BY hit_idx) - 1)::INT AS j, (CASE WHEN object = a.contig THEN cpos WHEN o = '+' THEN s0 - 1 + cpos ELSE s0 - 1 + (c1 - cpos) - {K} END)::INT AS cpos,
CASE WHEN object <> a.contig AND o = '-' THEN translate(cstrand, '+-', '-+') ELSE cstrand END AS cstrand, rpos, rstrand FROM (SELECT a.*, m.map_idx FROM accepted a JOIN mapped m USING (read_id, contig)) a JOIN plain_agp p ON p.contig = a.contig WHERE cpos <= c1 - {K}"""
STEPS["lift_runs"] = runs("(SELECT read_id, map_idx AS hit_idx, contig FROM (SELECT DISTINCT read_id, map_idx, contig FROM lifted))")
STEPS["lift_bounds"] = STEPS["bounds"].replace("run_hits", "lift_runs")
STEPS["lift_gone"] = STEPS["specific"].replace("bounds", "lift_bounds")
STEPS["lift_left"] = "SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY map_idx, j) - 1 AS hit_idx FROM lifted ANTI JOIN lift_gone USING (read_id, contig)"
STEPS["lift_mono"] = "SELECT read_id, contig FROM (SELECT *, cpos - lag(cpos) OVER (PARTITION BY read_id, contig ORDER BY hit_idx) AS s FROM lift_left) GROUP BY ALL HAVING bool_and(coalesce(s > 0, true)) OR bool_and(coalesce(s < 0, true))"
STEPS["lift_mapped"] = """SELECT *, (row_number() OVER (PARTITION BY read_id ORDER BY seen) - 1)::INT AS map_idx FROM (SELECT read_id, contig, min(hit_idx) AS seen, count(*)::INT AS hit_count, string_agg(cpos || ':' || cstrand || '_' || rpos || ':' || rstrand, ' ' ORDER BY hit_idx) AS hits FROM lift_left GROUP BY read_id, contig)"""
