"""Files of an observing archive as DataFrames, and what is written back.

Measurements come as one CSV for each frame; the frame's id is the file's name. Schemas are given, never inferred: a scan
reads the columns that a query uses and no more.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.expr import exact_id, flag, magnitude, magnitude_error
from skylattice.operators.archive import resolved_files
from skylattice.operators.shared import cut
from skylattice.operators.store import append_absent

NUMBERS = ("dao_flux", "flux", "psf_flux", "psf_flux_err", "aperture_flux", "mag", "bp_rp", "b_v", "x", "y", "ra_deg", "dec_deg", "bjd_tdb_mid", "hjd_mid", "jd_mid", "airmass", "peak_max_adu", "fwhm_estimate_px", "psf_chi2")
FLAGS = ("photometry_ok", "edge_safe_10px", "edge_fail", "snr50_ok", "is_saturated", "likely_saturated", "is_usable", "vsx_known_variable")
TEXTS = ("catalog_id", "name", "zone", "source_type", "source_file")


def frames(spark: SparkSession, path: str, columns: list[str], pattern: str = "proc_*.csv", *, names: Column | None = None) -> DataFrame:
    """Per-frame CSVs under path: frame_id and the typed columns asked for; a column that a file doesn't have is NULL.

    Each file is read once: its own header says where the columns are, and only those asked for are parsed. names is a
    condition on `_metadata` (file_name, file_path, file_size, file_modification_time); files that don't meet it aren't opened.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return frame_rows(raw.where(names) if names is not None else raw, columns)


def frame_rows(texts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of whole CSV files (`value`, of a table or a stream of files); see frames(). Spark packs small files into tasks."""
    named = texts.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("frame_id"), F.col("value").alias("_text"))

    def run(batches):
        for batch in batches:
            for frame, text in zip(batch.column("frame_id").to_pylist(), batch.column("_text"), strict=True):
                found = _parsed(text.as_py() or "", columns)
                n = len(found[0]) if found else 0
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([frame] * n, pa.string()), *found], names=["frame_id", *columns])

    schema = ", ".join(f"`{c}` string" for c in ["frame_id", *columns])
    return named.mapInArrow(run, schema).select("frame_id", *[typed(c, F.col(c)).alias(c) for c in columns])


def _parsed(text: str, columns: list[str]) -> list[pa.Array]:
    """The columns of a CSV text as strings, one array each. Rows with too few fields are filled up with NULL, blank lines
    left out; of columns with one name the first counts."""
    head, _, body = text.removeprefix("\ufeff").lstrip("\r\n").partition("\n")
    header = [x.strip() for x in next(csv.reader([head.rstrip("\r")]), [])]
    at = [header.index(c) if c in header else -1 for c in columns]
    if not body.strip() or max(at, default=-1) < 0:
        n = sum(1 for line in body.splitlines() if line.strip())
        return [pa.nulls(n, pa.string()) for _ in columns]
    names = [str(i) for i in range(len(header))]
    wanted = sorted({i for i in at if i >= 0})
    try:
        options = pacsv.ConvertOptions(include_columns=[names[i] for i in wanted], column_types={names[i]: pa.string() for i in wanted}, strings_can_be_null=False)
        got = pacsv.read_csv(io.BytesIO(body.encode()), pacsv.ReadOptions(column_names=names, use_threads=False), pacsv.ParseOptions(newlines_in_values=True), options)
        found = {i: got.column(names[i]).combine_chunks() for i in wanted}
    except pa.ArrowInvalid:  # ragged lines
        rows = [r for r in csv.reader(io.StringIO(body)) if any(x.strip() for x in r)]
        found = {i: pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in wanted}
    n = len(found[wanted[0]])
    return [found[i] if i >= 0 else pa.nulls(n, pa.string()) for i in at]


# Tables of an archive that lie beside the frames' and aren't measurements.
NOT_FRAMES = ("per_frame_catalog_index.csv", "field_catalog_cone.csv", "comparison_stars.csv", "variable_targets.csv")


def measurement_tables(files: DataFrame) -> DataFrame:
    """Of files (path, name), the CSVs that are a frame's measurements: those named as catalogues, and those with an image
    of the same name beside them; known other tables are skipped."""
    t = files.withColumn("_folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("_stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    images = t.where(F.lower("name").rlike(r"\.fits?$")).select(F.col("_folder").alias("_f"), F.col("_stem").alias("_s")).distinct()
    csv = t.where(F.lower("name").endswith(".csv") & ~F.col("name").isin(*NOT_FRAMES) & ~(F.lower("name").contains("masterstars") & F.lower("path").contains("platesolve")))
    met = csv.join(images.withColumn("_image", F.lit(True)), (F.col("_folder") == F.col("_f")) & (F.col("_stem") == F.col("_s")), "left")
    return met.where(F.col("name").endswith("_catalog.csv") | F.coalesce("_image", F.lit(False))).select(*files.columns)


def first_existing(spark: SparkSession, roots: list[str]) -> str | None:
    """The first of the folders that is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return root
    return None


def typed(name: str, x: Column) -> Column:
    if name in NUMBERS:
        value = x.try_cast("double")
        return F.when(~F.isnan(value), value)
    if name in FLAGS:
        return flag(x)
    return exact_id(x) if name == "catalog_id" else F.trim(x)


def normalised(df: DataFrame) -> DataFrame:
    """df with flux, mag_inst, mag_err and jd: the first source of each that has a value."""
    have = set(df.columns)
    first = lambda *names: F.coalesce(*[F.col(c) for c in names if c in have], F.lit(None).cast("double"))
    out = df.withColumn("flux", first("psf_flux", "aperture_flux", "dao_flux", "flux"))
    out = out.withColumn("mag_inst", magnitude(F.col("flux"))).withColumn("jd", first("bjd_tdb_mid", "hjd_mid", "jd_mid"))
    return out.withColumn("mag_err", magnitude_error(F.col("flux"), F.col("psf_flux_err")) if "psf_flux_err" in have else F.lit(None).cast("double"))


def quality(df: DataFrame, zones: tuple[str, ...] = ("linear", "noisy1")) -> DataFrame:
    """Rows that pass every flag the table has: what should be true is, what should be false isn't; zone by name."""
    have = set(df.columns)
    keep = F.col("catalog_id").isNotNull()
    for c in ("photometry_ok", "edge_safe_10px", "snr50_ok"):
        keep = keep & F.coalesce(F.col(c), F.lit(False)) if c in have else keep
    for c in ("is_saturated", "likely_saturated", "edge_fail"):
        keep = keep & ~F.coalesce(F.col(c), F.lit(False)) if c in have else keep
    return df.where(keep & F.trim("zone").isin(*zones)) if "zone" in have else df.where(keep)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Schema check: names that are required and absent."""
    return sorted(set(required) - set(df.columns))


def schema_reason(df: DataFrame | None, required: list[str]) -> str:
    """Why a table can't be used: no_table, missing_columns with their names, or ok."""
    if df is None:
        return "no_table"
    lost = missing_columns(df, required)
    return "missing_columns:" + ",".join(lost) if lost else "ok"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under path: path, name, size, modified, and what kind of frame the name tells (light, dark, flat, unknown)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.lower(name).contains("dark"), "dark").when(F.lower(name).contains("flat"), "flat").when(F.lower(name).rlike("light|proc|obj"), "light").otherwise("unknown")
    return resolved_files(raw.select("path", name.alias("name"), "size", "modified", kind.alias("kind")))


def fresh(files: DataFrame, cache: DataFrame, tolerance_s: float = 2.0) -> DataFrame:
    """files whose cached header still holds: same size, modified within the tolerance."""
    c = cache.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("modified").alias("_m"), "header")
    near = F.abs(F.col("modified").cast("double") - F.col("_m").cast("double")) <= tolerance_s
    return files.join(c, (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & near).drop("_p", "_s", "_m")


# The columns of a light-curve table and the places its numbers are rounded to.
CURVE_COLUMNS = {
    "bjd": "double", "hjd": "double", "jd": "double", "airmass": "double", "is_flipped": "boolean", "mag_inst": "double", "mag_calib_raw": "double", "mag_calib": "double", "mag_calib_ct": "double", "ct_correction": "double", "ct_c1": "double",
    "ct_bp_rp_target": "double", "ct_bp_rp_comp_med": "double", "ct_n_comp": "int", "ct_ok": "boolean", "delta_mag": "double", "err": "double", "aperture_r_px": "double", "flag": "string", "method": "string", "source_file": "string",
}
SIX_PLACES = ("mag_inst", "mag_calib_raw", "mag_calib", "mag_calib_ct", "ct_correction", "ct_c1", "ct_bp_rp_target", "ct_bp_rp_comp_med", "delta_mag", "err")


def curve_rows(curves: DataFrame, *, method: str = "aperture") -> DataFrame:
    """curves (catalog_id and what there is of the columns) as light-curve tables: all columns in order, rounded half to
    even; without a colour-corrected magnitude the calibrated one stands for it."""
    have = set(curves.columns)
    default = {"is_flipped": F.lit(False), "ct_n_comp": F.lit(-1), "ct_ok": F.lit(False), "method": F.lit(method), "mag_calib_ct": F.col("mag_calib") if "mag_calib" in have else F.lit(None)}
    out = []
    for name, kind in CURVE_COLUMNS.items():
        x = F.coalesce(F.col(name), default[name]) if name in have and name in default else F.col(name) if name in have else default.get(name, F.lit(None))
        x = x.cast(kind)
        out.append((F.bround(x, 6) if name in SIX_PLACES else F.bround(x, 3) if name == "aperture_r_px" else x).alias(name))
    return curves.select("catalog_id", *out)


def write_curves(curves: DataFrame, path: str, *, method: str = "aperture") -> None:
    """Light curves as CSV, one folder for each star."""
    curve_rows(curves, method=method).write.mode("overwrite").partitionBy("catalog_id").option("header", True).csv(path)


def write_phases(path: str, *, active: DataFrame, comparisons: DataFrame, suspects: DataFrame, summary: DataFrame) -> None:
    """A session's tables, each as CSV with a header in a folder of its own."""
    for name, t in (("active_targets", active), ("comparison_stars_per_target", comparisons), ("suspected_variables", suspects), ("photometry_summary", summary)):
        t.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def append_rows(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append to a CSV table under path the rows of new whose keys it doesn't have yet; the first call makes the table."""
    spark = new.sparkSession
    if first_existing(spark, [path]) is not None:
        old = spark.read.option("header", True).schema(new.schema).csv(path)
        new = cut(append_absent(old, new, keys))
    new.write.mode("append").option("header", True).csv(path)


def write_sidecars(df: DataFrame, path: str) -> None:
    """One JSON object in a line for each row; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)
