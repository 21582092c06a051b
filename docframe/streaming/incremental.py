"""Live queries that only filter, kept up to date without running them again.

The state of a document is the version that the result holds. Each micro-batch touches the documents it changes and
no others, so the cost follows the changes, not the collection. Sorted or limited queries need the whole result:
for those see live.LiveQuery.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.filters import Filter

_OUT = T.StructType([T.StructField("_change", T.StringType()), T.StructField("_key", T.LongType()), T.StructField("_doc", T.StringType())])
_STATE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("doc", T.StringType())])


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest version of a document against what the result holds; doc is null where it doesn't match."""
    seq, old = state.get if state.exists else (-1, None)
    new = old
    for rows in parts:
        last = rows.loc[rows["_seq"].idxmax()]
        if last["_seq"] > seq:
            seq, new = int(last["_seq"]), last["_doc"]
            new = new if isinstance(new, str) else None
    state.update((seq, new))
    if new != old:
        change = "added" if old is None else "removed" if new is None else "updated"
        yield pd.DataFrame({"_change": [change], "_key": [key[0]], "_doc": [new if new is not None else old]})


def filtered_changes(changes: DataFrame, where: Filter, key: str = "doc_id", seq: str = "seq", deleted: str = "is_tombstone") -> DataFrame:
    """_change (added, updated, removed), key and the document, for a stream of versions of documents.

    changes has the documents' columns, a sequence number and whether the version is a deletion. Late versions with
    smaller numbers than one seen are left out. A removed document is given as the result held it.
    """
    columns = [f for f in changes.schema.fields if f.name not in (seq, deleted)]
    whole = F.to_json(F.struct(*(F.col(f.name) for f in columns)), {"ignoreNullFields": "false"})
    matches = F.coalesce(where.compile(changes.schema), F.lit(False)) & ~F.col(deleted)
    rows = changes.select(F.col(key).cast("long").alias("_key"), F.col(seq).cast("long").alias("_seq"), F.when(matches, whole).alias("_doc"))
    out = rows.groupBy("_key").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    out = out.withColumn("_doc", F.from_json("_doc", T.StructType(columns)))
    return out.select("_change", *(F.col("_doc").getField(f.name).alias(f.name) for f in columns))
