"""Table functions for SQL: Arrow batches of one partition at a time, in its order.

    register(spark)
    SELECT * FROM run_lengths(TABLE(SELECT asset_id, date, state FROM t) PARTITION BY asset_id ORDER BY date)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

_RUNS = pa.schema([("key", pa.string()), ("state", pa.string()), ("first", pa.date32()), ("last", pa.date32()), ("n", pa.int64())])


@arrow_udtf(returnType="key string, state string, first date, last date, n long")
class RunLengths:
    """Runs of equal state of a key's rows (key, date, state): a row a run. Null is a state. Only the open run is held between batches."""

    def __init__(self):
        self.open = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if not batch.num_rows:
            return
        key, date, state = batch.columns
        codes = state.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        ends = np.append(starts[1:], len(codes)) - 1
        runs = [[str(key[i]) if key[i].is_valid else None, state[i].as_py(), date[i].as_py(), date[j].as_py(), int(j - i + 1)] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        if self.open is not None:
            if self.open[1] == runs[0][1]:
                runs[0][2], runs[0][4] = self.open[2], runs[0][4] + self.open[4]
            else:
                runs.insert(0, self.open)
        self.open = runs.pop()
        if runs:
            yield self._table(runs)

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield self._table([self.open])

    @staticmethod
    def _table(runs: list) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*runs, strict=True), _RUNS, strict=True)], schema=_RUNS)


def register(spark: SparkSession) -> None:
    spark.udtf.register("run_lengths", RunLengths)
