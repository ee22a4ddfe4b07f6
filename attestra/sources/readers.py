"""Reading tables as they are: text cells, nothing inferred, nothing silently dropped."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.claims import OBSERVATION


def row_order() -> list:
    """Where a row stands in its input: file, start of the split in the file, place in the split."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]


def _text_cells(df: DataFrame) -> DataFrame:
    """Missing cells are empty text."""
    return df.na.fill("")


def csv_table(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, row_ids: bool = True, multi_line: bool = True,
              ordered: bool = False) -> DataFrame:
    """Any CSV or CSV.gz with every column as text.  Bytes that are not UTF-8 are replaced, a byte-order
    mark is dropped, a quoted line break stays inside its cell.  ``multi_line=False`` lets Spark split
    large plain files; a file with quoted line breaks, or a gzip file, is one task.

    ``row_id`` tells rows apart and follows the order within a split; Spark deals splits out by size, so across files only
    ``row_order`` (file, block, place; with ``ordered``) says which row comes first."""
    df = (spark.read.option("header", header).option("sep", sep).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
          .option("mode", "PERMISSIVE").option("inferSchema", False).option("encoding", "UTF-8").csv(path))
    if ordered:
        df = df.select("*", F.struct(*row_order()).alias("row_order"))
    df = _text_cells(df)
    return df.select(F.monotonically_increasing_id().alias("row_id"), "*") if row_ids else df


def in_order(df: DataFrame, number: str) -> DataFrame:
    """Rows with their number in the order of files and of rows in them: places within a split, after the rows of the splits
    before it.  Only one count per split is brought together."""
    split = F.spark_partition_id()
    w = Window.orderBy("file", "block", "split")
    keyed = df.withColumns({"file": F.col("row_order.file"), "block": F.col("row_order.block"), "split": split, "place": F.col("row_order.place")})
    sizes = keyed.groupBy("file", "block", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "block", "split", "first", "base")
    rest = [c for c in df.columns if c not in ("row_order", "row_id", number)]
    return (keyed.join(base, ["file", "block", "split"])
            .select((F.col("base") + F.col("place") - F.col("first")).alias(number), *[F.col(f"`{c}`") for c in rest]))


def observations(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """An observation table; ``claim_seq`` is the order of files and of the rows in them."""
    df = in_order(csv_table(spark, path, multi_line=multi_line, ordered=True), "claim_seq")
    missing = [c for c in OBSERVATION if c not in df.columns]
    if missing:
        raise ValueError(f"not an observation table: no column {', '.join(missing)}")
    return df


def revenue(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """address, dataset, usd DOUBLE (a bad number is 0), family, src_letters."""
    df = in_order(csv_table(spark, path, multi_line=multi_line, ordered=True), "claim_seq")
    return df.withColumn("usd", F.coalesce(F.col("usd").try_cast("double"), F.lit(0.0)))


def anchors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One address per line, trimmed, blank lines skipped, distinct."""
    return spark.read.text(path).select(strip(F.col("value")).alias("address")).where("address <> ''").distinct()


def ground_truth(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """address, label, root; the last row of an address wins, in the order of files and of the rows in them."""
    df = csv_table(spark, path, multi_line=multi_line, ordered=True)
    last = df.groupBy("address").agg(F.max_by(F.struct(F.col("ground_truth_label").alias("label"),
                                                       F.col("ground_truth_source").alias("root")), "row_order").alias("r"))
    return last.select("address", "r.label", "r.root")


def table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A whole table as text cells with row ids, from files or a JDBC partitioned read (the partition
    is the chunk)."""
    df = spark.read.format(fmt).options(**options).load(path) if path else spark.read.format(fmt).options(**options).load()
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    return df.select(F.monotonically_increasing_id().alias("row_id"), *cells)


def seeded_rows(rows: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """``n`` rows drawn uniformly and reproducibly, however the table is sorted or split.  Only keys are sorted; the rows follow by a join."""
    drawn = rows.select(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
    return rows.join(drawn, key, "left_semi")


def sample_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows spread over the whole table, never its first ones."""
    return seeded_rows(rows, n, seed)


def reference_observations(spark: SparkSession, full_build: str | None = None, sample: str | None = None,
                           as_of: str | None = None, manifest_as_of: str | None = None) -> tuple[DataFrame, str | None]:
    """The corpus to compare against and its declared day: a full build when one is named (dated by
    ``as_of``), else the sample (dated by its manifest)."""
    if full_build:
        return observations(spark, full_build), as_of
    if sample:
        return observations(spark, sample), manifest_as_of
    raise FileNotFoundError("no reference corpus: name a full build or a sample")


def sampled_column(rows: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """Seeded uniform sample of a column's non-empty values with their row ids, in row order."""
    v = F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    return seeded_rows(rows.select("row_id", v.alias("value")).where("value <> ''"), n, seed).orderBy("row_id")


def sampled_columns(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(column, row_id, value): for every column at once, the ``n`` non-empty cells whose seeded hash is smallest.

    The cells are counted by the first four digits of their hash; only those up to the class in which the ``n``-th lies are ordered, so neither
    what is sorted nor what moves grows with the table but by the few cells of that class.  No order or split of the rows changes the sample."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value")) for c in rows.columns if c != "row_id"))
    long = rows.select("row_id", F.inline(cells)).where("value <> ''").withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), "column", F.col("row_id").cast("string")).cast("binary")))
    long = long.withColumn("head", F.substring("draw", 1, 4))
    counts = long.groupBy("column", "head").agg(F.count("*").alias("here"))                                           # at most 65,536 rows a column
    before = F.sum("here").over(Window.partitionBy("column").orderBy("head")) - F.col("here")
    enough = counts.withColumn("before", before).where(F.col("before") < n).groupBy("column").agg(F.max("head").alias("end"))
    long = long.join(F.broadcast(enough), "column").where(F.col("head") <= F.col("end"))                              # a row per column
    place = F.row_number().over(Window.partitionBy("column").orderBy("draw", "row_id"))
    return long.withColumn("place", place).where(F.col("place") <= n).select("column", "row_id", "value")


def sampled_pairs(rows: DataFrame, first: str, second: str, n: int, seed: int = 0) -> DataFrame:
    """(row_id, first, second) of ``n`` rows in which both cells are filled, drawn by a seeded hash of the row."""
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    both = rows.select("row_id", cell(first).alias("first"), cell(second).alias("second")).where("first <> '' AND second <> ''")
    return both.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")).cast("binary")), "row_id").limit(n)
