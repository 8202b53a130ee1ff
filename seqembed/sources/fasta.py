"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.lookup import lookup_join
from ..session import stage
from .corpus import numbered_id


def read_fasta(spark: SparkSession, path: str, n: int = 0, max_len: int | None = 1024,
               prefix: str = "sp_") -> DataFrame:
    """FASTA files, plain or gzip, to `(seq_id, sequence)`.

    A line that starts with `>` opens a record; the lines after it, right-stripped and joined, are
    the sequence, cut at `max_len`, or whole when that is None. The id is the second `|` field of the header. A header without
    one is named after the number of records before it, in file order. Text before the first header
    of a file and records without a body are dropped. `n` keeps the first `n` records, 0 all.

    The text source cuts the files at line breaks followed by `>`, so each row is one record, and
    plain files are read by many tasks. The parsed records are staged, because a gzip file, read by
    one task, should be read once. A task writes the records of a block of a file in their order, so the
    position of a record is the number of records in the blocks before, from a table with one row per block,
    and its place in the staged rows of its block. No record moves.
    """
    raw = (spark.read.option("lineSep", "\n>").text(path)
           .select("value", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row")))
    marked = F.col("value").startswith(">")
    header = F.regexp_replace(F.substring_index("value", "\n", 1), r"\s+$", "")
    lines = F.when(F.instr("value", "\n") > 0, F.expr("substr(value, instr(value, '\n') + 1)"))
    # Trailing white space of a line, its line break, and at the end the last line's.
    body = F.regexp_replace(F.coalesce(lines, F.lit("")), r"\s*\n|\s+$", "")
    parsed = raw.select("file", "block", "row", marked.alias("marked"), header.alias("header"),
                        (F.substring(body, 1, max_len) if max_len else body).alias("sequence"))
    # Records without a body go, but for those of a first block, where the first row of the file is looked for.
    records = stage(parsed.filter((F.length("sequence") > 0) | (F.col("block") == 0)), "fasta")

    # Only the first row of a file keeps its marker; where that row has none, it is no record.
    placed, blocks = _placed(records)
    leads = F.col("leading") & (F.col("index") == F.col("first_index"))
    kept = (F.length("sequence") > 0) & (~leads | F.col("marked"))
    title = F.when(leads, F.expr("substr(header, 2)")).otherwise(F.col("header"))
    named = F.get(F.split(title, r"\|"), F.lit(1)).alias("seq_id")
    if blocks.filter("gaps > 0").isEmpty():
        number = F.col("before") + F.col("index") - F.col("first_index") - F.col("lead_goes").cast("int")
        numbered = placed.filter(kept).select(named, "sequence", number.alias("number"))
    else:  # dropped ones between the others of a first block: positions come from a copy without them
        rest = stage(placed.filter(kept).select("file", "block", "row", named, "sequence"), "fasta-kept")
        number = F.col("before") + F.col("index") - F.col("first_index")
        again, _ = _placed(rest.withColumn("marked", F.lit(True)))
        numbered = again.select("seq_id", "sequence", number.alias("number"))
    if n > 0:
        numbered = numbered.filter(F.col("number") < n)
    return numbered.select(F.coalesce("seq_id", numbered_id(F.col("number"), prefix)).alias("seq_id"), "sequence")


def _placed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged records with their `index` in the staged file and what is known of their block, and that table of blocks.

    A block has `before` it so many records, from the `first_index` on; `leading` marks the block with the first row
    of a file, `lead_goes` whether that row is no record, `gaps` how many others of the block are none.
    """
    indexed = records.select("*", F.col("_metadata.file_path").alias("staged"), F.col("_metadata.row_index").alias("index"))
    bare = F.length("sequence") == 0
    blocks = indexed.groupBy("file", "block", "staged").agg(
        F.min("index").alias("first_index"), F.min("row").alias("first_row"), F.count("*").alias("n"),
        F.count_if(bare).alias("bare"), F.min_by(F.struct("marked", bare.alias("bare")), "index").alias("lead"))
    of_file = Window.partitionBy("file")
    leading = (F.col("block") == 0) & (F.col("first_row") == F.min(F.when(F.col("block") == 0, F.col("first_row"))).over(of_file))
    goes = F.col("leading") & (~F.col("lead.marked") | F.col("lead.bare"))
    gaps = F.col("bare") - (F.col("leading") & F.col("lead.bare")).cast("int")
    blocks = blocks.withColumn("leading", leading).withColumn("lead_goes", goes).withColumn("gaps", gaps)
    held = F.col("n") - F.col("lead_goes").cast("int") - F.col("gaps")
    earlier = Window.orderBy("file", "block", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stage(blocks.withColumn("before", F.coalesce(F.sum(held).over(earlier), F.lit(0))).select(
        "file", "block", "staged", "first_index", "leading", "lead_goes", "gaps", "before"), "fasta-blocks")
    return lookup_join(indexed, blocks, ["file", "block", "staged"]), blocks
