"""Text formats between stages: sketches, mappings, PAF, pairs, DOT graphs, paths, AGP, trims.

Writers make a folder of part files which, in order, are the file; readers take such a folder or a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import layout, mapping, sketch

HIT = r"^(\d+):([+-])_(\d+):([+-])$"


def _tsv(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns)).alias("value")).write.text(path)


def _read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).select(F.size(parts).alias("fields"), *(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))


def write_sketch(sketched: DataFrame, path: str, lengths: DataFrame | None = None) -> None:
    _tsv(sketch.as_line(sketched, lengths), path)


def read_sketch(spark: SparkSession, path: str, with_length: bool = False, strands: bool = True) -> DataFrame:
    """Rows id, (length,) pos, hash, strand. Files have unsigned 64-bit hashes; here the same bits are a signed number, as in sketches.
    Lines with fewer fields than the format has are left out."""
    names = ["id", "length", "minimizers"] if with_length else ["id", "minimizers"]
    rows = _read(spark, path, *names).filter(F.col("fields") >= len(names))
    mx = rows.select("id", *([F.col("length").cast("int").alias("length")] if with_length else []), F.explode(F.split("minimizers", " ")).alias("m")).withColumn("p", F.split("m", ":"))
    bits = F.get("p", F.lit(0)).cast("decimal(21,0)")
    signed = F.when(bits >= F.lit(str(1 << 63)).cast("decimal(21,0)"), bits - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(bits).cast("long")
    out = [F.get("p", F.lit(1)).cast("int").alias("pos"), signed.alias("hash")] + ([F.get("p", F.lit(2)).alias("strand")] if strands else [])
    return mx.select("id", *(["length"] if with_length else []), *out).filter("pos IS NOT NULL")


def write_mappings(mapped: DataFrame, path: str) -> None:
    """read, contig, hits, `cpos:cstrand_rpos:rstrand ...`, rows of a read together and in order."""
    rows = mapped.select("read_id", "map_idx", "contig", "hit_count", mapping.hit_text().alias("hits"))
    _tsv(rows.repartition("read_id").sortWithinPartitions("read_id", "map_idx").drop("map_idx"), path)


def read_mappings(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
    """Mappings as written, with map_idx by the first hit's read position, and contig lengths. The format has no read length."""
    rows = _read(spark, path, "read_id", "contig", "hit_count", "hits").filter("fields >= 4")
    one = lambda t: F.struct(F.regexp_extract(t, HIT, 1).cast("int").alias("cpos"), F.regexp_extract(t, HIT, 2).alias("cstrand"), F.regexp_extract(t, HIT, 3).cast("int").alias("rpos"), F.regexp_extract(t, HIT, 4).alias("rstrand"))
    out = rows.select("read_id", "contig", F.col("hit_count").cast("int").alias("hit_count"), F.transform(F.split("hits", " "), one).alias("hits")).join(lengths.select("contig", "length"), "contig")
    first = F.element_at("hits", 1)["rpos"]
    return out.withColumn("map_idx", F.row_number().over(Window.partitionBy("read_id").orderBy(first)) - 1).withColumn("read_len", F.lit(None).cast("int"))


def write_paf(rows: DataFrame, path: str) -> None:
    _tsv(rows, path)


def write_pairs(estimates: DataFrame, path: str) -> None:
    """source, target, `n=.., gap_estimates=[..], anchor=..`."""
    one = estimates.groupBy("source", "source_ori", "target", "target_ori").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("gap")).alias("gaps"), F.count_if("anchored").alias("anchor"))
    info = F.concat(F.lit("n="), "n", F.lit(", gap_estimates=["), F.array_join(F.transform("gaps", lambda g: g.cast("string")), ", "), F.lit("], anchor="), "anchor")
    _tsv(one.select(F.concat("source", "source_ori").alias("s"), F.concat("target", "target_ori").alias("t"), info.alias("info")), path)


def write_dot(vertices: DataFrame, edges: DataFrame, path: str, scaf_num: int | None = None) -> None:
    """A directed graph: `"v" [l=..]` and `"a" -> "b" [d=.. e=.. n=..]`."""
    spark = vertices.sparkSession
    head = ["digraph G {"] + ([f"graph [scaf_num={scaf_num}]"] if scaf_num is not None else [])
    lines = spark.createDataFrame([(0, x) for x in head] + [(3, "}")], "part int, value string")
    lines = lines.union(vertices.select(F.lit(1), F.format_string('"%s" [l=%d]', "v", F.col("length").cast("long"))))
    lines = lines.union(edges.select(F.lit(2), F.format_string('"%s" -> "%s" [d=%d e=%d n=%d]', "src", "dst", F.col("d").cast("long"), F.col("e").cast("long"), F.col("n").cast("long"))))
    lines.orderBy("part", F.when(F.col("part").isin(1, 2), F.col("value"))).select("value").write.text(path)


def read_dot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, length) and edges (src, dst, d, e, n). A line that is neither, nor the frame of the graph, is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("x")).filter("x <> ''")
    edge, node = r'^"([^"]+)" -> "([^"]+)" \[d=(-?\d+) e=(\d+) n=(\d+)\]$', r'^"([^"]+)" \[l=(\d+)\]$'
    frame = F.col("x").rlike(r"^(strict )?(di)?graph\b") | F.col("x").isin("{", "}")
    known = frame | F.col("x").rlike(edge) | F.col("x").rlike(node)
    lines = lines.select(F.when(known, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("unexpected line in graph: "), "x"))).alias("x"))
    at = lambda p, i: F.regexp_extract("x", p, i)
    vertices = lines.filter(F.col("x").rlike(node)).select(at(node, 1).alias("v"), at(node, 2).cast("int").alias("length"))
    return vertices, lines.filter(F.col("x").rlike(edge)).select(at(edge, 1).alias("src"), at(edge, 2).alias("dst"), at(edge, 3).cast("int").alias("d"), at(edge, 4).cast("int").alias("e"), at(edge, 5).cast("long").alias("n"))


def write_paths(paths: DataFrame, path: str) -> None:
    _tsv(layout.path_lines(paths), path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return layout.parse_path_lines(_read(spark, path, "path_id", "path").filter("fields >= 2"))


def write_agp(rows: DataFrame, path: str) -> None:
    _tsv(rows.repartition("object").sortWithinPartitions("object", "part"), path)


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind W; of a component's several rows the last in the object's order counts."""
    names = ("object", "start", "stop", "part", "kind", "component", "from", "to", "ori")
    rows = _read(spark, path, *names).filter("kind = 'W'").drop("fields")
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("start", "stop", "part")})
    w = Window.partitionBy("component").orderBy(F.desc("object"), F.desc("start"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def write_trims(trimmed: DataFrame, path: str) -> None:
    _tsv(trimmed.filter("NOT omitted").select("contig", "start", "stop"), path)


def read_trims(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "contig", "start", "stop").select("contig", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def largest_number(contigs: DataFrame, prefix: str = layout.PREFIX) -> int | None:
    """The largest N of contig ids `<prefix>N`, None if there is none."""
    return contigs.agg(F.max(F.regexp_extract("contig", rf"^{prefix}(\d+)$", 1).try_cast("long"))).first()[0]
