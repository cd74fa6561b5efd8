"""A full-text index that takes inserts and deletes: sorted segments, tombstones, merges; no rebuild.

At `path` lie postings and lengths by segment, tombstones (id, upto: what segments before it hold of the id is dead), sums
(rows and tokens that each change adds or takes) and the list of live segments by version. A change writes its own rows only; of
earlier segments it reads the lengths of the ids that it replaces. One writer at a time; a reader keeps the version it opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.search import Index, build_index
from shelfspark.shared import small_side, stored

POSTINGS = "token string, id {id}, col string, tf long, segment long"
#: Live segments from which the smaller half is merged.
MOST_SEGMENTS = 8


@dataclass
class State:
    """A version: live segments with their rows, and the number of the next change."""

    version: int
    segments: dict[int, int]
    next: int


class GrowingIndex:
    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", most_segments: int = MOST_SEGMENTS):
        self.spark, self.path, self.kind, self.most = spark, path, id_type, most_segments

    def _there(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _read(self, name: str, schema: str) -> DataFrame:
        found = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(found) if self._there(name) else self.spark.createDataFrame([], schema)

    def state(self) -> State:
        last = self._read("versions", "segments map<long, long>, next long, version long").orderBy(F.desc("version")).limit(1).collect()
        return State(last[0]["version"], dict(last[0]["segments"]), last[0]["next"]) if last else State(0, {}, 1)

    def _commit(self, state: State) -> None:
        row = self.spark.createDataFrame([(state.segments, state.next)], "segments map<long, long>, next long").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/versions/version={state.version + 1}")

    def _alive(self, name: str, schema: str, state: State) -> DataFrame:
        """Rows of the live segments that no tombstone has killed."""
        rows = self._read(name, schema).where(F.col("segment").isin(*state.segments)) if state.segments else self.spark.createDataFrame([], schema)
        dead = self._read("dead", f"id {self.kind}, upto long").where(F.col("upto") < state.next)
        if state.segments:
            dead = dead.where(F.col("upto") > min(state.segments))  # older ones have been merged away
        killed = small_side(stored(dead.groupBy("id").agg(F.max("upto").alias("upto")), "tombstones"))
        return rows.join(killed.withColumnRenamed("id", "__id"), (F.col("id") == F.col("__id")) & (F.col("segment") < F.col("upto")), "left_anti")

    def _lengths(self, state: State) -> DataFrame:
        return self._alive("lengths", f"id {self.kind}, len long, segment long", state)

    def open(self) -> Index:
        """The index as `search` takes it."""
        state = self.state()
        sums = self._read("sums", "rows long, tokens long, change long").where(F.col("change") < state.next)
        totals = sums.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.try_divide(F.sum("tokens"), F.sum("rows")).alias("avg"))
        return Index(self._alive("postings", POSTINGS.format(id=self.kind), state).drop("segment"), self._lengths(state).drop("segment"), totals)

    def insert(self, books: DataFrame, columns: list[str]) -> None:
        """Adds books (unique ids); those that the index holds are replaced."""
        state = self.state()
        n = state.next
        postings = stored(build_index(books, columns), "new-postings")
        postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/postings/segment={n}")
        lengths = stored(postings.groupBy("id").agg(F.sum("tf").alias("len")), "new-lengths")
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/segment={n}")
        self._change(state, books.select("id"), lengths)
        self._commit(State(state.version, {**state.segments, n: lengths.count()}, n + 1))
        if len(state.segments) + 1 > self.most:
            self.merge()

    def delete(self, ids: DataFrame) -> None:
        """Takes ids out."""
        state = self.state()
        self._change(state, ids.select("id"), None)
        self._commit(State(state.version, state.segments, state.next + 1))

    def _change(self, state: State, ids: DataFrame, new: DataFrame | None) -> None:
        """Tombstones for those of ids that are held, and the sums of what comes and goes."""
        n = state.next
        gone = stored(self._lengths(state).join(ids.distinct(), "id", "left_semi").select("id", "len"), "gone")
        gone.select("id", F.lit(n).cast("long").alias("upto")).write.mode("overwrite").parquet(f"{self.path}/dead/change={n}")
        out = gone.select(F.lit(-1).cast("long").alias("rows"), (-F.col("len")).alias("tokens"))
        both = out if new is None else out.unionByName(new.select(F.lit(1).cast("long").alias("rows"), F.col("len").alias("tokens")))
        both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/sums/change={n}")

    def merge(self, segments: list[int] | None = None) -> None:
        """Makes one segment of some (of the smaller half by rows if none are given), without what is dead in them."""
        state = self.state()
        chosen = segments or sorted(state.segments, key=state.segments.get)[: max(2, len(state.segments) // 2)]
        n, part = state.next, State(state.version, {s: state.segments[s] for s in chosen}, state.next)
        kept = self._alive("postings", POSTINGS.format(id=self.kind), part).drop("segment")
        kept.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/postings/segment={n}")
        lengths = stored(self._lengths(part).drop("segment"), "merged-lengths")
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/segment={n}")
        # Tombstones of changes before the merge are applied in it and do not reach the new, higher number.
        left = {s: r for s, r in state.segments.items() if s not in chosen}
        self._commit(State(state.version, {**left, n: lengths.count()}, n + 1))
