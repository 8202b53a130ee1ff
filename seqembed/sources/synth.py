"""Seeded synthetic sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .corpus import numbered_id

# Residues and their shares in thousandths; the shares sum to 1002.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
SHARES = (82, 14, 54, 67, 39, 71, 23, 60, 58, 97, 24, 40, 47, 40, 57, 66, 54, 69, 11, 29)
# Fixed value: standard deviation of the length.
LENGTH_SPREAD = 80


def synth_sequences(spark: SparkSession, n: int, **options) -> DataFrame:
    """`n` synthetic sequences, see `synth_for`."""
    return synth_for(spark.range(n), "id", **options)


def synth_for(df: DataFrame, index: str, min_len: int = 50, max_len: int = 1024,
              mean_len: int = 200, seed: int = 42) -> DataFrame:
    """One synthetic sequence per row of `df`, drawn from its integer `index`.

    Lengths follow a normal law around `mean_len`, clipped to the bounds; residues follow the fixed
    shares. Every draw is a slice of an md5 of seed, index and position, so the result does not
    depend on partitioning and rows can be made anywhere.
    """
    i = F.col(index).cast("string")
    wheel = F.array(*[F.lit(r) for r, share in zip(RESIDUES, SHARES) for _ in range(share)])

    def digest(*parts) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), i, *parts))

    lengths = [digest(F.lit("length"), F.lit(str(j))) for j in range(3)]
    uniforms = sum((_word(h, k) for h in lengths for k in range(4)), F.lit(0).cast("long"))
    # Twelve uniforms have mean 6 and variance 1.
    normal = (uniforms - F.lit(6 << 32)) / F.lit(float(1 << 32))
    drawn = (F.lit(float(mean_len)) + normal * LENGTH_SPREAD).cast("int")
    length = F.greatest(F.lit(min_len), F.least(F.lit(max_len), drawn))

    sized = df.select(F.col(index), numbered_id(F.col(index), "synth_").alias("seq_id"),
                      length.alias("length"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / 4).cast("int")),
                         lambda j: digest(F.lit("residue"), j.cast("string")))
    letters = F.transform(groups, lambda h: F.concat(
        *[F.get(wheel, (_word(h, k) % sum(SHARES)).cast("int")) for k in range(4)]))
    text = F.expr("substring(letters, 1, length)")
    return (sized.withColumn("letters", F.array_join(letters, ""))
            .select("seq_id", text.alias("sequence")))


def _word(digest: Column, k: int) -> Column:
    """The k-th 32-bit word of an md5 in hexadecimal."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
