"""Sources: sparse matrix folders, tissue positions, feature tables, wide count tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwire.operators.ranking import running

# Fixed column order of position files without a header.
POSITION_COLUMNS = [
    "barcode",
    "in_tissue",
    "array_row",
    "array_col",
    "pxl_row_in_fullres",
    "pxl_col_in_fullres",
]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file split and their order inside it; files of a folder follow each other by name."""
    return spark.read.text(path).select(
        "value", F.format_string("%s|%020d", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("_split"),
        F.monotonically_increasing_id().alias("_order"))


def _head_and_body(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first line of the first split and all others; one pair of values comes to the driver."""
    first = lines.agg(F.min(F.struct("_split", "_order")).alias("f")).select("f.*").first()
    if first is None or first["_split"] is None:
        return lines.limit(0), lines
    is_head = (F.col("_split") == first["_split"]) & (F.col("_order") == first["_order"])
    return lines.where(is_head), lines.where(~is_head)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 1-based number in file order, counted inside splits and over splits."""
    return running(_lines(spark, path), [], [F.col("_order")], F.lit(1), "line", "_split").select("line", "value")


def _first_existing(spark: SparkSession, folder: str, names: list[str]) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {names} in {folder}")


def _feature_columns(value):
    part = F.split(value, "\t")
    return (
        part[0].alias("feature_id"), F.coalesce(F.try_element_at(part, F.lit(2)), part[0]).alias("feature_name"),
        F.coalesce(F.try_element_at(part, F.lit(3)), F.lit("Gene Expression")).alias("feature_type"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature id, name (default: id), type (default: Gene Expression) and matrix row."""
    return numbered_lines(spark, path).select(F.col("line").alias("row"), *_feature_columns(F.col("value")))


def duplicate_features(features: DataFrame) -> DataFrame:
    return features.groupBy("feature_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def read_mex(spark: SparkSession, folder: str, gene_column: int = 2, keep_ids: DataFrame | None = None) -> DataFrame:
    """Counts of a sparse matrix folder: barcode, feature_id, gene, n.

    Only gene expression features are kept, optionally those of ``keep_ids(feature_id)``. The header's
    rows, columns and entries must agree with the dictionaries and the body, and feature ids must be
    unique; otherwise it is an error, so a cut file cannot pass for a smaller one.
    """
    body = _lines(spark, _first_existing(spark, folder, ["matrix.mtx.gz", "matrix.mtx"])).where(~F.col("value").startswith("%"))
    head, body = _head_and_body(body)
    part = F.split(F.trim("value"), r"\s+")
    entries = body.select(
        part[0].cast("long").alias("row"), part[1].cast("long").alias("col"), part[2].cast("long").alias("n"))
    listed = read_features(spark, _first_existing(
        spark, folder, ["features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv"]))
    if not duplicate_features(listed).isEmpty():
        raise ValueError("feature ids of the matrix are not unique")
    features = listed.where("feature_type = 'Gene Expression'")
    if keep_ids is not None:
        lost = keep_ids.select("feature_id").join(features, "feature_id", "left_anti")
        if not lost.isEmpty():
            raise ValueError("the matrix lacks ids of the requested feature universe")
        features = features.join(keep_ids.select("feature_id").distinct(), "feature_id", "left_semi")
    barcodes = numbered_lines(spark, _first_existing(spark, folder, ["barcodes.tsv.gz", "barcodes.tsv"])).select(
        F.col("line").alias("col"), F.split("value", "\t")[0].alias("barcode"))
    header = head.select(
        *(part[k].cast("long").alias(c) for k, c in enumerate(["rows", "cols", "entries"])))
    found = entries.agg(
        F.count(F.lit(1)).alias("entries"), F.min("row").alias("low_row"), F.max("row").alias("high_row"),
        F.min("col").alias("low_col"), F.max("col").alias("high_col")).first()
    want = header.first()
    given = (listed.count(), barcodes.count(), found["entries"])
    if want is None or tuple(want) != given:
        raise ValueError(f"the matrix header says {want and tuple(want)}, the files hold {given}")
    if given[2] and not (found["low_row"] >= 1 and found["high_row"] <= given[0] and found["low_col"] >= 1 and found["high_col"] <= given[1]):
        raise ValueError("the matrix has indices outside its dictionaries")
    name = "feature_id" if gene_column == 1 else "feature_name"
    return entries.join(features, "row").join(barcodes, "col").where("n > 0").select(
        "barcode", "feature_id", F.col(name).alias("gene"), "n")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Tissue positions from Parquet, CSV with a header, or the six-column CSV without one."""
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    first = spark.read.text(path).first()[0]
    header = "barcode" in [c.strip('"') for c in first.split(",")]
    if not header and len(first.split(",")) != len(POSITION_COLUMNS):
        raise ValueError("a position file without a header needs six columns")
    columns = [c.strip('"') for c in first.split(",")] if header else POSITION_COLUMNS
    kinds = {"barcode": "string", "in_tissue": "int", "array_row": "long", "array_col": "long"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns)
    return spark.read.csv(path, header=header, schema=schema, enforceSchema=True)


def read_wide_counts(spark: SparkSession, path: str) -> DataFrame:
    """Gene rows by spot columns (tab separated, spot names in the first line) to long counts.

    Lines are split and exploded, so the number of spots never becomes a number of columns.
    Fields that are no integers come back as null counts, for the count validation to report.
    """
    lines = _lines(spark, path)
    head, body = _head_and_body(lines)
    clean = lambda c: F.regexp_replace(c, '"', "")
    names = head.select(F.posexplode(F.split(clean("value"), "\t")).alias("_i", "spot_id"))
    # The first field may be empty or absent; counting from the right aligns both forms.
    width = head.select(F.size(F.split("value", "\t"))).scalar()
    names = names.withColumn("_from_right", width - F.col("_i")).drop("_i")
    part = F.split("value", "\t")
    long = body.select(clean(part[0]).alias("gene"), F.size(part).alias("_w"), F.posexplode(part).alias("_i", "_v")).where("_i > 0")
    return long.withColumn("_from_right", F.col("_w") - F.col("_i")).withColumn("n", F.col("_v").try_cast("long")).where(
        "n > 0 OR n IS NULL").join(names, "_from_right").select("spot_id", "gene", "n")
