"""Examples dealt to blocks, each of which one task packs into sequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.tokens import named
from treeline.session import cut_lineage

#: Examples packed together. A block wastes about its last sequence.
EXAMPLES_PER_BLOCK = 16_384

#: From the costs of a block's examples, largest first, to (sequence, turn in it) of each.
Place = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed_in_blocks(
    examples: DataFrame, costs: list[Column], place: Place, order: tuple[str, ...], length: str, per_block: int
) -> DataFrame:
    """``examples`` with sequence_id and offset, as ``place`` has it for each block.

    Null costs and lengths count as 0. Offsets within a sequence follow each other from 0 by
    ``length``. Columns stay as they are, whatever their names; columns named sequence_id or
    offset are replaced. Rows that repeat ``order`` are dealt over the blocks like any others,
    so no block grows with them. An empty table gives an empty result.
    """
    kept = [c for c in examples.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[named(c) for c in kept]).alias("row")
    asked = F.array(*[F.coalesce(c, F.lit(0)).cast("bigint") for c in (named(length), *costs)]).alias("asked")
    held = cut_lineage(examples.select(row, asked, F.monotonically_increasing_id().alias("tag")))
    blocks = max(1, -(-held.count() // per_block))
    ordered = F.struct(*[F.col("row").getField(c) for c in order], "tag")
    width = len(costs) + 1
    dealt = held.select("row", "asked", ordered.alias("by"), F.pmod(F.xxhash64("by"), F.lit(blocks)).alias("block"))
    schema = T.StructType([
        held.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        # costs, then the columns of ``order`` and the tag make the result repeatable
        asked = np.asarray(group.column("asked").combine_chunks().flatten()).reshape(-1, width)
        sizes = {f"cost{i}": -asked[:, i] for i in range(1, width)}
        by = {f"by{i}": c for i, c in enumerate(group.column("by").combine_chunks().flatten())}
        table = pa.table(sizes | by)
        first = np.asarray(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names]))
        sequence, turn = place(asked[first, 1:])
        last = np.lexsort((turn, sequence))
        rows, sequence = first[last], sequence[last]
        starts = np.cumsum(asked[rows, 0]) - asked[rows, 0]
        opens = np.concatenate([[True], sequence[1:] != sequence[:-1]])
        offset = starts - starts[opens][np.cumsum(opens) - 1]
        number = (group.column("block")[0].as_py() << 32) + sequence
        return pa.table({"row": group.column("row").take(pa.array(rows)), "sequence_id": pa.array(number), "offset": pa.array(offset)})

    found = dealt.groupBy("block").applyInArrow(run, schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], "sequence_id", "offset")
