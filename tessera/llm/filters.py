"""Row filters that pass whole rows through a batch function: no join, no shuffle, every column kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.arrays import slices


def keep_where(docs: DataFrame, mask: Callable[[np.ndarray, np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows for whose texts mask(bytes, offsets) is true; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mask(data, offsets) for _, _, data, offsets in slices(batch.column(text_col))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found)))

    return docs.mapInArrow(run, docs.schema)
