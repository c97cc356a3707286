"""Survey lines of two-column text: parsing, flags, depths, outliers, aggregation at exact places, line lengths.

Raw lines are (file, line_no, text). Files are parsed by windows over their own lines; everything else is row-wise or
one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.operators.errors import GeoError

MSVC = r"^[+-]?1\.#(QNAN|SNAN|IND|INF)\d*$"


LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e]"
MISFIT = "\ufffd"  # stands for a byte that isn't ASCII


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, size, sha256, encoding, nul, text) of every file below ``path``: the whole path and its last part, what
    was read, ascii or ascii_with_replacement (each other byte is MISFIT), the number of trailing NULs, and the text
    without these and the line ends around them. A file is one row, as survey files are small; Spark
    doesn't list files without a byte, which ``inventory`` reports as missing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = F.decode("content", "ISO-8859-1")  # one character a byte
    body = F.regexp_replace(whole, "[\r\n]+$", "")
    kept = F.regexp_replace(F.regexp_replace(body, "\u0000+$", ""), "[\r\n]+$", "")
    rows = raw.select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.length(body) - F.length(F.regexp_replace(body, "\u0000+$", ""))).cast("bigint").alias("nul"), kept.alias("kept"))
    plain = F.regexp_replace("kept", "[\u0080-\u00ff]", MISFIT)
    return rows.select("file", "name", "size", "sha256", F.when(plain == F.col("kept"), "ascii").otherwise("ascii_with_replacement").alias("encoding"), "nul", plain.alias("text"))


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line_no, text) of ``read_files``; files of one name in two folders stay apart. An empty file has no line."""
    lines = F.when(F.col("text") != "", F.split("text", LINE_END))
    return files.select("file", F.posexplode(lines).alias("i", "text")).select("file", (F.col("i") + 1).alias("line_no"), "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(read_files(spark, path))


def manifest(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """A row for each file: what it is, how many records it has and how many are valid, and its issues: SOURCE_NUL_TERMINATOR,
    ENCODING_FALLBACK, and each kind of flag of its records, in the order of their names."""
    flags = parsed.select("file", F.explode(F.split("flags", ";")).alias("flag")).where("flag <> ''").groupBy("file").agg(F.array_sort(F.collect_set("flag")).alias("flags"))  # a dozen kinds
    counts = parsed.groupBy("file").agg(F.count("*").alias("records"), F.count_if("is_valid").alias("valid"))
    out = files.drop("text").join(counts, "file", "left").join(flags, "file", "left")
    issues = F.concat(F.array_compact(F.array(F.when(F.col("nul") > 0, "SOURCE_NUL_TERMINATOR"), F.when(F.col("encoding") != "ascii", "ENCODING_FALLBACK"))), F.coalesce("flags", F.array().cast("array<string>")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("file", "name", "size", "sha256", "encoding", "nul", zero("records"), zero("valid"), issues.alias("issues"))


def hash_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, before, after, state): the hashes of two snapshots (file, sha256); unchanged, changed, gone or new."""
    a, b = before.select("file", F.col("sha256").alias("before")), after.select("file", F.col("sha256").alias("after"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    return a.join(b, "file", "full_outer").withColumn("state", state)


def token_flag(token: Column) -> Column:
    """empty, msvc_special, not_numeric, nan, infinite, or null for a number."""
    n = token.try_cast("double")
    return F.when(F.coalesce(F.trim(token), F.lit("")) == "", "empty").when(token.rlike(MSVC), "msvc_special").when(n.isNull(), "not_numeric").when(F.isnan(n), "nan").when(F.abs(n) == float("inf"), "infinite")


def parse(lines: DataFrame) -> DataFrame:
    """(file, line_no, wl_raw, v_raw, wl, v, flags, is_valid): the first line that isn't blank is the header."""
    filled = lines.where(F.trim("text") != "")
    first = filled.groupBy("file").agg(F.min("line_no").alias("header"))
    rows = filled.join(first, "file").where(F.col("line_no") > F.col("header"))
    t = F.split(F.trim("text"), r"\s+")
    rows = rows.select("file", "line_no", F.size(t).alias("n"), F.get(t, F.lit(0)).alias("wl_raw"), F.get(t, F.lit(1)).alias("v_raw"))
    a, b = token_flag(F.col("wl_raw")), token_flag(F.col("v_raw"))
    flags = F.array_compact(F.array(F.when(F.col("n") != 2, "column_count"), F.concat(F.lit("wl_"), a), F.concat(F.lit("v_"), b)))
    number = lambda c, f: F.when(f.isNull(), F.col(c).try_cast("double"))
    return rows.select("file", "line_no", "wl_raw", "v_raw", number("wl_raw", a).alias("wl"), number("v_raw", b).alias("v"), F.array_join(flags, ";").alias("flags"), (F.size(flags) == 0).alias("is_valid"))


def with_depth(parsed: DataFrame, places: DataFrame) -> DataFrame:
    """Depth is the half wavelength in metres (given in km), z its negative; places (file, line_id, point_id, x, y)."""
    return parsed.where("is_valid").join(places, "file").withColumn("depth", F.col("wl") * 1000).withColumn("z", -F.col("depth"))


def three_sigma(rows: DataFrame, columns: list[str], threshold: float = 3.0, ddof: int = 1) -> DataFrame:
    """``rows`` with ``reasons`` (columns whose value is strictly farther than ``threshold`` deviations from the mean of
    all rows) and ``accepted``. One aggregate, joined back as one row."""
    dev = F.stddev_samp if ddof else F.stddev_pop
    s = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", dev)))).first()
    if s["n"] <= ddof:
        raise GeoError("SIGMA_TOO_FEW_ROWS", rows=s["n"])
    why = F.array_join(F.array_compact(F.array(*(F.when(F.abs(F.col(c) - F.lit(s[f"{c}_m"])) > threshold * s[f"{c}_s"], F.lit(f"{c}_beyond")) for c in columns))), ";")
    return rows.withColumn("reasons", why).withColumn("accepted", F.col("reasons") == "")


def aggregate_places(rows: DataFrame, seq: str, sample_id: str, group: str | None = None) -> DataFrame:
    """One row per exact (x, y, z): mean, extremes, sample deviation, number, spread, ordered sample ids, and the order
    of first appearance. With ``group``, places that two groups share are a failure."""
    if group and rows.groupBy("x", "y", "z").agg(F.count_distinct(group).alias("n")).where("n > 1").limit(1).count():
        raise GeoError("PLACE_IDENTITY_CONFLICT")
    found = rows.groupBy("x", "y", "z").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(sample_id).alias("sample")))), lambda s: s["sample"].cast("string")), ";").alias("sample_ids"), F.min(seq).alias("first_seq"),
    )
    return found.withColumn("is_conflict", (F.col("n") > 1) & (F.col("spread") > 0))


def line_distances(places: DataFrame) -> DataFrame:
    """Distance along each line to every point: places (line_id, seq, x, y)."""
    w = Window.partitionBy("line_id").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return places.withColumn("step", step).withColumn("distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def inventory(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, status): present, missing or unexpected."""
    both = expected.select("file").distinct().withColumn("e", F.lit(1)).join(found.select("file").distinct().withColumn("f", F.lit(1)), "file", "full_outer")
    return both.select("file", F.when(F.col("e").isNull(), "unexpected").when(F.col("f").isNull(), "missing").otherwise("present").alias("status"))


def line_checks(distances: DataFrame) -> DataFrame:
    """(line_id, points, length, monotone): distances must not fall along a line."""
    w = Window.partitionBy("line_id").orderBy("seq")
    rows = distances.withColumn("_up", F.coalesce(F.col("distance") >= F.lag("distance").over(w), F.lit(True)))
    return rows.groupBy("line_id").agg(F.count("*").alias("points"), F.max("distance").alias("length"), F.bool_and("_up").alias("monotone"))


def line_totals(points: DataFrame, files: DataFrame) -> DataFrame:
    """(line_id, points, source_records, valid, invalid) of the registered points (line_id, point_id); points and lines
    without a file count 0. ``files``: point_id, source_records, valid."""
    per = files.groupBy("point_id").agg(F.sum("source_records").alias("s"), F.sum("valid").alias("v"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return points.join(per, "point_id", "left").groupBy("line_id").agg(F.count("*").alias("points"), zero("s").alias("source_records"), zero("v").alias("valid"), (zero("s") - zero("v")).alias("invalid"))


def contract_report(expected: dict, files: DataFrame, samples: DataFrame, points: DataFrame, hashes: DataFrame) -> DataFrame:
    """(check, passed, found): the fifteen checks of an import, all listed; each is one aggregate.

    ``expected``: files, line_points, source_records, valid (by line), invalid, special_point, special_token, nul,
    excluded. ``files``: file, point_id, source_records, valid, nul. ``samples``: sample_id, file, line_no, point_id,
    wl_raw, v_raw, v, flags, z. ``points``: line_id, point_id, seq, interval, distance, formal, x, y. ``hashes``: file,
    before, after.
    """
    spark, formal = files.sparkSession, points.where("formal")
    lines = {r["line_id"]: r for r in line_totals(formal, files).collect()}  # a row for each survey line
    by_line = lambda c: {k: r[c] for k, r in lines.items()}
    f = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("nul"), F.lit(0)).alias("nul"), F.count_distinct("point_id").alias("points"), F.count_distinct("file").alias("names")).first()
    missing = formal.join(files, "point_id", "left_anti").count()
    unexpected = files.join(formal, "point_id", "left_anti").count()
    special = F.col("flags").contains("v_msvc_special")
    traced = special & (F.col("point_id") == expected["special_point"]) & (F.col("v_raw") == expected["special_token"]) & F.col("v").isNull()
    s = samples.agg(
        F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"), F.count_distinct("file", "line_no").alias("places"), F.count_if(special).alias("special"), F.count_if(traced).alias("traced"),
        F.count_if(F.col("wl_raw").isNull() & F.col("v_raw").isNull()).alias("blank"), F.count_if(F.col("z").isNotNull()).alias("z"),
    ).first()
    out = spark.createDataFrame([(p,) for p in expected["excluded"]], "point_id string")
    leaked = samples.join(out, "point_id", "left_semi").limit(1).count() + formal.join(out, "point_id", "left_semi").limit(1).count()
    w = Window.partitionBy("line_id").orderBy("seq")
    walk = formal.withColumn("_first", F.row_number().over(w) == 1).withColumn("_sum", F.sum(F.coalesce("interval", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.lag("distance").over(w))
    off = F.when(F.col("_first"), (F.col("distance") != 0) | F.col("interval").isNotNull()).otherwise((F.abs(F.col("distance") - F.col("_sum")) > 1e-9) | (F.col("distance") <= F.col("_before")))
    bad_walk = walk.where(F.coalesce(off, F.lit(True))).count()
    place = points.agg(F.count_if(F.col("formal") & (F.col("x").isNull() | F.col("y").isNull())).alias("no"), F.count_if(~F.col("formal") & (F.col("x").isNotNull() | F.col("y").isNotNull())).alias("odd")).first()
    h = hashes.agg(F.count("*").alias("n"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed")).first()
    checks = [
        ("formal_dat_file_count", f["n"] == expected["files"] and not missing, f["n"]), ("no_unexpected_dat_files", not unexpected, unexpected), ("line_point_counts", by_line("points") == expected["line_points"], sum(by_line("points").values())),
        ("source_record_counts_per_line", by_line("source_records") == expected["source_records"], sum(by_line("source_records").values())), ("valid_numeric_counts_per_line", by_line("valid") == expected["valid"], sum(by_line("valid").values())),
        ("invalid_numeric_total", sum(by_line("invalid").values()) == expected["invalid"], sum(by_line("invalid").values())), ("special_nan_traceable", s["special"] == s["traced"] == 1, s["special"]), ("nul_terminators_excluded", f["nul"] == expected["nul"] and not s["blank"], f["nul"]),
        ("one_dat_per_formal_point", f["points"] == f["names"] == f["n"] == expected["files"], f["points"]), ("source_file_line_unique", s["places"] == s["n"], s["n"] - s["places"]), ("sample_id_unique", s["ids"] == s["n"], s["n"] - s["ids"]),
        ("excluded_points_not_in_formal_set", not leaked, leaked), ("cumulative_distance_monotonic_traceable", not bad_walk, bad_walk), ("confirmed_local_coordinates", not (place["no"] or place["odd"] or s["z"]), place["no"] + place["odd"]),
        ("source_sha256_unchanged", not h["changed"] and h["n"] == f["n"], h["changed"]),
    ]
    return spark.createDataFrame([(n, bool(p), int(v)) for n, p, v in checks], "check string, passed boolean, found bigint")


def golden_gate(filtered: DataFrame, aggregated: DataFrame, expected: dict) -> DataFrame:
    """(check, passed, found): a derivation against its pinned counts and hashes; all checks are listed, none raises.
    ``filtered``: rows of ``three_sigma`` with line_id and sample; ``aggregated``: rows of ``aggregate_places``."""
    from terralith.operators.experiments import rows_fingerprint

    ok = F.col("accepted")
    s = filtered.agg(F.count_if(ok).alias("a"), F.count_if(~ok).alias("r"), F.count_if(~ok & (F.col("reasons") == "")).alias("unsaid")).first()
    lines = {r["line_id"]: r["n"] for r in filtered.where(ok).groupBy("line_id").agg(F.count("*").alias("n")).collect()}  # a row for each survey line
    g = aggregated.agg(F.count("*").alias("n"), F.count_if("is_conflict").alias("groups"), F.coalesce(F.sum(F.when(F.col("is_conflict"), F.col("n"))), F.lit(0)).alias("rows")).first()
    found = [("accepted_count", s["a"]), ("rejected_count", s["r"]), ("per_line_accepted_counts", lines), ("rejection_reasons", s["unsaid"]), ("conflict_group_count", g["groups"]), ("conflict_row_count", g["rows"]), ("modeling_node_count", g["n"])]
    found += [(f"{k}_sha256", rows_fingerprint(filtered.where(c).drop("accepted"), ["sample"])) for k, c in (("accepted", ok), ("rejected", ~ok)) if f"{k}_sha256" in expected]
    want = expected | {"rejection_reasons": 0}
    return filtered.sparkSession.createDataFrame([(k, v == want.get(k), v if isinstance(v, str) else str(sum(v.values()) if isinstance(v, dict) else v)) for k, v in found], "check string, passed boolean, found string")
