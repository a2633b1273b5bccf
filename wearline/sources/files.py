"""Readers and writers of the files around an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import config_from_file
from ..operators.metrics import run_manifest
from ..operators.ordering import match, positions, running_total
from ..session import shared

TRACE_SCHEMA = (
    "engine_id bigint, true_rul double, pred_rul double, reasoning string, arm string, "
    "condition string, seed bigint, k bigint, n bigint, parse_ok boolean, raw string, model string"
)


def trajectory_columns(settings: int = 3, sensors: int = 21) -> list[str]:
    return ["unit", "cycle", *[f"setting{i}" for i in range(1, settings + 1)], *[f"s{i}" for i in range(1, sensors + 1)]]


def read_trajectories(spark: SparkSession, path: str, columns: Sequence[str] | None = None, drop_empty: bool = True) -> DataFrame:
    """Headerless, whitespace-separated trajectories; the dataset name comes from the folder
    (`dataset=…`) or the file name.

    Columns without any value are dropped after one counting pass.
    """
    columns = list(columns or trajectory_columns())
    parts = F.split(F.trim("value"), r"\s+")
    kinds = {"unit": "bigint", "cycle": "bigint"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    named = F.regexp_extract("_metadata.file_name", r"([A-Za-z]+\d+)\.txt$", 1)
    dataset = (F.col("dataset") if "dataset" in lines.columns else named).alias("dataset")
    cells = [F.try_element_at(parts, F.lit(i + 1)).try_cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(columns)]
    df = lines.select(dataset, *cells)
    # NaN marks a missing reading
    df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns if c not in kinds})
    if not drop_empty:
        return df
    seen = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.select("dataset", *[c for c in columns if seen[c] > 0])


def read_terminal_labels(spark: SparkSession, path: str) -> DataFrame:
    """One label per line; `pos` is the line number within the dataset's file (or folder `dataset=…` with one file).

    Lines are numbered per file block in parallel and the blocks are put in order by their offset.
    """
    lines = spark.read.text(path)
    named = F.regexp_extract("_metadata.file_name", r"([A-Za-z]+\d+)\.txt$", 1)
    raw = lines.select(
        (F.col("dataset") if "dataset" in lines.columns else named).alias("dataset"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.trim("value").alias("v"),
    )
    rows = raw.where(F.col("v") != "")
    numbered = positions(rows, ["dataset"], ["block", "line"], F.col("block"), "pos")
    return numbered.select("dataset", "pos", F.col("v").cast("double").alias("rul"))


def record_path() -> Column:
    """Path of a record's file; for a folder that holds one file's parts, the folder's."""
    return F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]+$", "")


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): every object of files that hold JSON arrays, one or one after the other, as text.

    A file is read in parallel byte ranges, cut at closing braces. Whether a piece
    begins inside a string follows from the quotes before it, how deep it is nested
    from the braces outside strings before it, and which record it belongs to from the
    records that are complete before it: three running totals over the pieces of a
    file, whose order is that of byte ranges and of the pieces in them. They run on
    counts, without the texts; a piece that is a record of its own stays where it was
    read, and only the pieces of one record are put together in one place. A byte range
    must fit a task, a file need not; compressed files are one range.
    """
    pieces = shared(
        spark.read.option("lineSep", "}").text(path).select(
            record_path().alias("path"),
            F.col("_metadata.file_path").alias("part"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )
    by, place = ["path", "part"], ["path", "part", "block", "line"]
    plain = F.replace(F.replace(F.col("value"), F.lit("\\\\")), F.lit('\\"'))  # without escaped backslashes and quotes
    count = lambda c, mark: (F.length(c) - F.length(F.replace(c, F.lit(mark)))).cast("long")
    # every other stretch between quotes is outside strings, from the first or from the second on
    stretches = pieces.select(*place, F.split(plain, '"', -1).alias("_s"))
    first = F.array_join(F.filter("_s", lambda _, i: i % 2 == 0), "")
    counts = stretches.select(
        *place,
        (F.size("_s") - 1).cast("long").alias("quotes"),
        count(first, "{").alias("first"),
        count(F.array_join("_s", ""), "{").alias("braces"),
    )
    quoted = running_total(shared(counts), by, "block", ["line"], F.col("quotes"), "_before")
    outside = F.when(F.col("_before") % 2 == 0, F.col("first")).otherwise(F.col("braces") - F.col("first"))
    closes = ((F.col("_before") + F.col("quotes")) % 2 == 0).cast("long")
    nested = shared(quoted.select(*place, closes.alias("closes"), (outside - closes).alias("step")))
    nested = running_total(nested, by, "block", ["line"], F.col("step"), "_depth")
    whole = ((F.col("closes") == 1) & (F.col("_depth") + F.col("step") == 0)).cast("long")
    numbered = running_total(nested.select(*place, whole.alias("whole")), by, "block", ["line"], F.col("whole"), "record")
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "record"))
    torn = shared(numbered.select(*place, "record", size.alias("_n")).where(F.col("_n") > 1).drop("_n"))
    torn.count()  # its size decides how the texts meet it
    alone = pieces.join(torn.select(*place), place, "left_anti").select("path", "value")
    joined = pieces.join(torn, place).groupBy(*by, "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("_p"))
    joined = joined.select("path", F.array_join(F.transform("_p", lambda x: x["value"]), "}").alias("value"))
    text = F.concat("value", F.lit("}"))
    records = alone.unionByName(joined).select("path", F.regexp_replace(text, r"^[\s,\[\]]+", "").alias("value"))
    return records.where(F.col("value").startswith("{"))


def read_traces(spark: SparkSession, path: str, array_files: bool = True) -> DataFrame:
    """Prediction records with the run configuration from the file name.

    The usual files hold one JSON array each, `array_files=False` reads one record per
    line; both are split by byte ranges.
    """
    if array_files:
        records = array_records(spark, path)
        # a row of its own, so that a record is parsed once and not once per column
        df = records.select("path", F.inline(F.array(F.from_json("value", TRACE_SCHEMA))))
    else:
        df = spark.read.schema(TRACE_SCHEMA).json(path).select(record_path().alias("path"), "*")
    whole = F.col("path")
    file = F.regexp_extract(whole, r"([^/=]+)$", 1)
    config = {name: c for name, c in config_from_file(file).items()}
    own = {"k": F.coalesce(F.col("k"), config["k"]), "seed": F.coalesce(F.col("seed"), config["seed"])}
    return df.select(
        "path",
        file.alias("file"),
        config["dataset"].alias("dataset"),
        config["mode"].alias("mode"),
        own["k"].alias("k"),
        F.coalesce(F.col("n"), config["n_cycles"]).alias("n_cycles"),
        config["run"].alias("run"),
        own["seed"].alias("seed"),
        F.coalesce(F.col("arm"), F.col("condition"), config["variant"]).alias("variant"),
        F.col("engine_id").alias("unit"),
        F.col("true_rul").alias("truth"),
        F.col("pred_rul").alias("pred"),
        F.coalesce("reasoning", F.lit("")).alias("text"),
        "raw",
        "parse_ok",
        "model",
    )


READING = "case bigint, sensor string, first_label string, first_at string, revealed boolean, note string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human readings from an export: a list of records, or one under either root key; records may be wrapped in 'data'."""
    record = f"struct<{READING.replace(' ', ':').replace(',:', ',')},data:struct<{READING.replace(' ', ':').replace(',:', ',')}>>"
    schema = f"{READING}, data struct<{READING.replace(' ', ':').replace(',:', ',')}>, readings array<{record}>, letture array<{record}>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    names = [part.split(" ")[0] for part in READING.split(", ")]
    itself = F.array(F.struct(*names, "data"))
    rows = raw.select(F.explode(F.coalesce("readings", "letture", itself)).alias("r"))
    wrapped = F.col("r.data").isNotNull()
    flat = rows.select(*[F.when(wrapped, F.col(f"r.data.{n}")).otherwise(F.col(f"r.{n}")).alias(n) for n in names])
    return flat.select(
        "case",
        "sensor",
        F.lower(F.trim(F.coalesce("first_label", F.lit("")))).alias("label"),
        F.coalesce("revealed", F.lit(False)).alias("revealed"),
        F.to_timestamp("first_at").alias("first_at"),
        F.coalesce("note", F.lit("")).alias("note"),
    )


def read_summary(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Summary table with header; empty cells and NaN are null."""
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def write_trajectories(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The same layout, one folder per dataset; a missing reading is written as NaN."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in columns]
    df.select("dataset", F.concat_ws(" ", *cells).alias("value")).write.partitionBy("dataset").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary tables are small results; they leave as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_claims(df: DataFrame, path: str) -> None:
    """The claims table feeds many analyses: columnar, one folder per dataset."""
    df.write.mode("overwrite").partitionBy("dataset").parquet(path)


def file_manifest(
    spark: SparkSession, path: str, classes: Sequence[tuple[str, str]] = (), otherwise: str = "other", root: str = ""
) -> DataFrame:
    """Path below `root`, size, SHA-256 and experiment class of every file.

    `classes` are (name, pattern) pairs tried on the path in order. The file source
    hands a file over whole, so files are limited to what one row can hold (2 GB). A file
    that is a folder of parts is one row: the hash of its parts' hashes, in the order of their names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = files.select(
        record_path().alias("path"), F.col("_metadata.file_path").alias("part"), "length", F.sha2("content", 256).alias("hash")
    )
    whole = parts.groupBy("path").agg(
        F.sum("length").alias("bytes"), F.array_sort(F.collect_list(F.struct("part", "hash"))).alias("_p")
    )
    place, kind = F.col("path"), F.lit(otherwise)
    for label, pattern in reversed(list(classes)):
        kind = F.when(place.rlike(pattern), F.lit(label)).otherwise(kind)
    joined = F.array_join(F.transform("_p", lambda x: x["hash"]), "")
    return whole.select(
        "path",
        F.replace(place, F.lit(root), F.lit("")).alias("below_root") if root else place.alias("below_root"),
        "bytes",
        F.when(F.size("_p") == 1, joined).otherwise(F.sha2(joined, 256)).alias("sha256"),
        kind.alias("experiment"),
    )


def trace_manifest(
    spark: SparkSession, path: str, classes: Sequence[tuple[str, str]] = (), array_files: bool = True, default_model: str | None = None
) -> DataFrame:
    """The file manifest with each file's configuration, model and run statistics, keyed by path.

    The model is the record's own, else the variant in the file name, else the default.
    """
    by = ["path", "file", "dataset", "mode", "k", "n_cycles", "run", "seed", "model"]
    traces = read_traces(spark, path, array_files).where(F.col("pred").isNotNull())
    traces = traces.withColumn("model", F.coalesce("model", "variant", F.lit(default_model)))
    stats = run_manifest(traces, by, "text")
    return match(file_manifest(spark, path, classes), stats, ["path"], "left")


def write_label_lines(df: DataFrame, path: str, label: str = "rul", pos: str = "pos") -> None:
    """One label per line in the order of `pos`, a folder with one file per dataset."""
    rows = df.select("dataset", pos, F.col(label).cast("string").alias("value"))
    ordered = rows.repartition("dataset").sortWithinPartitions("dataset", pos)
    ordered.select("dataset", "value").write.partitionBy("dataset").text(path)


#: Records of a part.
PART_ROWS = 20_000


def write_traces(df: DataFrame, path: str, file: str = "file") -> None:
    """Records as JSON lines, a folder of parts of at most PART_ROWS records with the name of each file; rows stay spread over tasks."""
    df.write.option("maxRecordsPerFile", PART_ROWS).partitionBy(file).json(path)


#: Records of an array.
ARRAY_ROWS = 1_000


def write_array_traces(df: DataFrame, path: str, file: str = "file") -> None:
    """Records as JSON arrays of at most ARRAY_ROWS records, a folder with the name of each file; rows stay spread over tasks."""
    records = F.collect_list(F.struct(*[c for c in df.columns if c != file]))
    some = df.withColumn("_some", F.floor(F.monotonically_increasing_id() / ARRAY_ROWS))
    some.groupBy(file, "_some").agg(F.to_json(records).alias("value")).drop("_some").write.partitionBy(file).text(path)
