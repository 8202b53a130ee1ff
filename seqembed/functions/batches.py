"""Apply a stateful function to batches of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package
from .models import resident

Columns = dict[str, np.ndarray]


def map_batches(df: DataFrame, factory: Callable[[], Callable[[Columns], Columns]],
                schema: T.StructType, batch_size: int = 32, workers: int | None = None,
                profile: ResourceProfile | None = None) -> DataFrame:
    """Run `factory()` once per worker and call the result on every batch of numpy columns.

    A batch has at most `batch_size` rows and never spans partitions. `workers` repartitions the
    input, which shuffles it; leave it out to keep the partitions of the scan. `profile` asks for
    task resources such as an accelerator and needs a cluster manager that grants them.
    """
    ship_package(df.sparkSession)
    if workers:
        df = df.repartition(workers)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = resident(factory)
        for batch in batches:
            results = []
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                columns = {name: part.column(name).to_numpy(zero_copy_only=False)
                           for name in part.schema.names}
                results.append(apply(columns))
            arrays = [
                pa.array(np.concatenate([r[field.name] for r in results]), type=field.type)
                if results else pa.array([], type=field.type)
                for field in target
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema, profile=profile)


@dataclass(frozen=True)
class Doubler:
    """Factory for the smoke job: doubles `value` and names the device it ran on."""

    device: str = "cpu"

    def __call__(self):
        def double(columns: Columns) -> Columns:
            return {
                "id": columns["id"],
                "doubled": columns["value"] * 2,
                "device": np.full(len(columns["id"]), self.device, dtype=object),
            }

        return double
