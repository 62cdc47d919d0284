"""Sequence operators on a stream: what each well has drilled, worn and lost so far, kept as state per well.

The rows of a well are taken in the order of the batches and, within a batch, of the ordering columns. The state is a
few numbers per well in the state store, so a start with the same checkpoint goes on where the last one stopped. A
well's rows of one batch are held together to sort them; limit the files of a batch accordingly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellspring.functions.nulls import lookup, number
from wellspring.operators import ordered

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULTS = {"depth": "double", "changed": "boolean", "bit_wear": "double", "contamination": "double", "efficiency": "double"}
MEASURES = ["_metres", "_step", "_kept", "_dirt", "_lost"]
STATE = "layer string, seen boolean, depth double, wear double, contamination double, loss double"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store on disk; a provider chosen by the session's owner stays."""
    if spark.conf.get(STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


class WellWalk(StatefulProcessor):
    """Depth, layer change, bit wear, contamination and efficiency of each row from those before it."""

    def __init__(self, order: Sequence[str], layer: str, names: Sequence[str], cap: float, floor: float, moment: str | None, idle_ms: int):
        self.order, self.layer, self.names = list(order), layer, list(names)
        self.cap, self.floor, self.moment, self.idle_ms = cap, floor, moment, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("well", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch.columns = [*self.names, *MEASURES, "_well"]  # names that are no Python names come changed
        batch = batch.sort_values(self.order, kind="stable", na_position="first", ignore_index=True)
        layer, seen, depth, wear, contamination, loss = self.state.get() if self.state.exists() else (None, False, 0.0, 0.0, 0.0, 0.0)
        out = []
        for own, metres, step, kept, dirt, lost in batch[[self.layer, *MEASURES]].itertuples(index=False, name=None):
            own = None if pd.isna(own) else own
            changed = bool(seen and own != layer)
            depth += metres
            wear *= kept if changed else 1.0
            out.append((depth, changed, wear, min(self.cap, contamination), max(self.floor, 1.0 - loss)))
            wear = min(self.cap, wear + step)
            contamination, loss, layer, seen = contamination + dirt, loss + lost, own, True
        self.state.update((layer, seen, depth, wear, contamination, loss))
        if self.moment is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(batch[self.moment].max().timestamp() * 1000) + self.idle_ms)
        results = pd.DataFrame(out, columns=list(RESULTS), index=batch.index)
        yield pd.concat([batch[self.names], results], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A well without rows for the idle time is finished; its state goes."""
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def walk_wells(stream: DataFrame, keys: Sequence[str], order: Sequence[str], layer: str, formation: str, rop: str,
               additives: Column | None = None, wear_scale: float = 1.0, contamination_scale: float = 1.0,
               efficiency_step: float = ordered.EFFICIENCY_STEP, cap: float = 1.0, floor: float = 0.5,
               moment: str | None = None, lateness: str = "5 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """The stream's rows with ``depth`` (own row included), ``changed`` layer, and the ``bit_wear``, ``contamination``
    and ``efficiency`` before each row, as the batch operators in ``ordered`` give them.

    With ``moment``, a timestamp column, the state of a well is dropped when the other wells' time is ``idle_ms`` and
    ``lateness`` beyond its last row, so that finished wells do not fill the store; rows later than ``lateness`` are
    left out then. An unknown rate of penetration adds no depth. Rows that come in a later batch than their successors
    are taken as they come.
    """
    use_state_store(stream.sparkSession)
    clash = [c for c in (*RESULTS, *MEASURES, "_well") if c in stream.columns]
    if clash:
        raise ValueError(f"the stream already has {', '.join(clash)}")
    kind = F.col(formation)
    measured = stream.withColumns({
        "_metres": F.coalesce(number(F.col(rop)) / 3600, F.lit(0.0)),
        "_step": lookup(kind, ordered.WEAR_STEP, ordered.WEAR_STEP_DEFAULT) * wear_scale,
        "_kept": lookup(kind, ordered.WEAR_KEPT, ordered.WEAR_KEPT_DEFAULT),
        "_dirt": ordered.contamination_step(kind, additives) * contamination_scale,
        "_lost": F.lit(float(efficiency_step)),
        "_well": F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys])),  # rows without a key are one well, as null alone would not be
    })
    schema = T.StructType([*stream.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in RESULTS.items()]])
    walk = WellWalk(order, layer, stream.columns, cap, floor, moment, idle_ms)
    if moment is None:
        return measured.groupBy("_well").transformWithStateInPandas(walk, schema, "Append", "None")
    timed = measured.withWatermark(moment, lateness)
    return timed.groupBy("_well").transformWithStateInPandas(walk, schema, "Append", "EventTime", eventTimeColumnName=moment)
