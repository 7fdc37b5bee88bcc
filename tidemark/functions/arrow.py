"""Arrow batch plumbing: vectorised prefilters and per-batch maps without pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import ship


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Repartition a scan that has fewer tasks than the cluster has cores, else leave it as it is.

    One small row group per file would otherwise put all Python work on a few cores. Rows are
    dealt round-robin, so no key can make a partition heavy.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() * 2 <= want else df


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], "pa.Table | pa.RecordBatch | Iterable[Sequence] | None"],
    schema: str,
    names: Sequence[str],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """``df.mapInArrow`` with ``fn`` called on each batch.

    ``fn`` returns rows (tuples in the order of ``names``), a table, or None for none. ``setup`` is
    run once per task and its result handed to ``fn`` as second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)

    target = to_arrow_schema(StructType.fromDDL(schema))
    if target.names != list(names):
        raise ValueError(f"schema {target.names} does not match names {list(names)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch, state) if setup else fn(batch)
            if out is None:
                continue
            if isinstance(out, (pa.Table, pa.RecordBatch)):
                table = out if isinstance(out, pa.Table) else pa.Table.from_batches([out])
                yield from table.select(target.names).cast(target).to_batches()
                continue
            rows = list(out)
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target
                )

    return df.mapInArrow(run, schema)
