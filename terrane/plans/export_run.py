"""One export from registration to finished file, with its run log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terrane.functions.files import Folder
from terrane.operators.catalog import TableSet
from terrane.operators.duration import DurationModel
from terrane.plans.assemble import assemble
from terrane.sinks.write import output_path, write_features
from terrane.sources.tables import table_set_metrics

# Export and performance fields of a run; an event sets some of them.
FIELDS = {
    "group_key": "string",
    "primary_table_name": "string",
    "geography_table": "string",
    "name_table": "string",
    "ndm_table": "string",
    "sf_query_ids": "array<string>",
    "sf_database": "string",
    "sf_schema": "string",
    "sf_data_timestamp": "timestamp",
    "fetch_timestamp": "timestamp",
    "export_timestamp": "timestamp",
    "output_path": "string",
    "status": "string",
    "rows_fetched": "bigint",
    "columns_fetched": "bigint",
    "duration": "double",
    "predicted_duration": "double",
    "predicted_method": "string",
    "is_spatial": "boolean",
    "joined_tables": "map<string,string>",
    "table_shapes": "array<struct<rows:bigint,cols:bigint>>",
    "prediction_model_id": "bigint",
}
EVENT_SCHEMA = "id bigint, step bigint, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())
PERFORMANCE = [
    "rows_fetched",
    "columns_fetched",
    "duration",
    "predicted_duration",
    "predicted_method",
    "is_spatial",
    "joined_tables",
    "table_shapes",
    "prediction_model_id",
]


_STEPS = "array<struct<step:bigint,status:string>>"
STATE_SCHEMA = f"id bigint, last_step bigint, steps {_STEPS}, " + ", ".join(
    f"{n} struct<step:bigint,value:{t}>" for n, t in FIELDS.items()
)
#: A log object folds its tail into a snapshot after so many events of its own.
COMPACT_AFTER = 1000


def _json(value: object) -> str:
    if isinstance(value, datetime):
        return value.astimezone(UTC).isoformat()
    raise TypeError(f"a run event cannot hold a {type(value).__name__}")


def state_of(events: DataFrame) -> DataFrame:
    """Events as states that :func:`fold` can bring together: each field with the step that set it."""
    step = F.col("step")
    return events.select(
        "id",
        step.alias("last_step"),
        F.when(F.col("status").isNotNull(), F.array(F.struct(step, F.col("status")))).otherwise(F.array()).cast(_STEPS).alias("steps"),
        *[F.when(F.col(n).isNotNull(), F.struct(step.alias("step"), F.col(n).alias("value"))).alias(n) for n in FIELDS],
    )


def fold(settled: DataFrame | None, fresh: DataFrame, fields: Collection[str] = tuple(FIELDS)) -> DataFrame:
    """One state a run: each field from the greatest step that set it, and all status steps.

    Folding may happen in any order and more than once. Where a step is there twice, as after a repeated append, what
    is settled stays. ``fresh`` sets no fields but ``fields``; the others come from the one settled row of a run, together.
    """
    both = fresh.withColumn("__settled", F.lit(False))
    if settled is not None:
        both = both.unionByName(settled.withColumn("__settled", F.lit(True)))

    def newest(name: str) -> Column:
        order = F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.step"), F.col("__settled")))
        return F.max_by(name, order).alias(name)

    # A step's status from a snapshot comes first among equals, and later ones of the same step go.
    listed = F.array_sort(F.flatten(F.collect_list(F.transform("steps", lambda s: F.struct(s["step"].alias("step"), (~F.col("__settled")).alias("fresh"), s["status"].alias("status"))))))
    once = F.filter(listed, lambda s, i: (i == 0) | (s["step"] != F.element_at(listed, F.greatest(i, F.lit(1)))["step"]))
    steps = F.transform(once, lambda s: F.struct(s["step"].alias("step"), s["status"].alias("status")))
    others = [n for n in FIELDS if n not in fields]
    kept = [F.max_by(F.struct(*others), F.when(F.col("__settled"), F.lit(1))).alias("__kept")] if others else []
    folded = both.groupBy("id").agg(F.max("last_step").alias("last_step"), steps.alias("steps"), *[newest(n) for n in FIELDS if n in fields], *kept)
    return folded.select("id", "last_step", "steps", *[n if n in fields else F.col(f"__kept.{n}") for n in FIELDS])


class RunLog:
    """Run events, kept as a snapshot of all runs and a tail of the events since.

    An event sets some fields of a run and is named by the run and its step, a number that the run's exporter counts up
    from 1; no clock orders events. The tail holds one small file an event, written without a job. ``compact`` folds
    the tail into a new snapshot, sorted by id, with a list of the files it took in; a reader takes the newest snapshot
    whose list stands, and the files that are not in it. A repeated append changes nothing, before or after compaction.

    Files are deleted one compaction after they were folded, so a reader may be overtaken by one compaction.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER) -> None:
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self._folder = Folder(spark, self.path)
        self._next: dict[int, int] = {}
        self._appended = 0

    def append(self, run_id: int, step: int | None = None, **fields: object) -> int:
        """Record an event; returns its step, by default the one after the run's last. A step that is there stays as it is."""
        unknown = sorted(set(fields) - set(FIELDS))
        if unknown:
            raise ValueError(f"A run has no field {', '.join(unknown)}.")
        if step is None:
            step = self._next.get(run_id) or self._last_step(run_id) + 1
        event = {"id": run_id, "step": step, **{k: v for k, v in fields.items() if v is not None}}
        self._folder.put(f"tail/{run_id}-{step}.json", json.dumps(event, default=_json))
        self._next[run_id] = max(step + 1, self._next.get(run_id, 0))
        self._appended += 1
        if self._appended >= self.compact_after:
            self.compact()
        return step

    def _last_step(self, run_id: int) -> int:
        held = self.state(run_id).select("last_step").head()
        return held[0] if held else 0

    def register(self, table_set: TableSet, run_id: int | None = None) -> int:
        """Record a new run with status UNKNOWN as step 1; returns its id, by default a random one."""
        if table_set.territory_table is None:
            raise ValueError("A run needs a territory table.")
        run_id = uuid.uuid4().int >> 65 if run_id is None else run_id
        now = datetime.now(UTC)
        self.append(
            run_id,
            step=1,
            group_key=table_set.group_key,
            primary_table_name=table_set.territory_table,
            geography_table=table_set.geometry_table,
            name_table=table_set.name_table,
            ndm_table=table_set.ndm_table,
            sf_data_timestamp=now,
            fetch_timestamp=now,
            status="UNKNOWN",
        )
        return run_id

    def _base(self) -> tuple[str | None, list[str]]:
        """The newest snapshot that stands, and the files of the tail that it took in."""
        standing = self._folder.names("snapshots/*.json")
        if not standing:
            return None, []
        return standing[-1].removesuffix(".json"), json.loads(self._folder.read(f"snapshots/{standing[-1]}"))

    def _tail(self, folded: list[str], pattern: str = "*") -> list[str]:
        return sorted(set(self._folder.names(f"tail/{pattern}.json")) - set(folded))

    def _events(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).json([self._folder.full(f"tail/{n}") for n in names])

    def _snapshot(self, name: str | None) -> DataFrame | None:
        return None if name is None else self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/snapshots/{name}")

    def events(self) -> DataFrame:
        """Events that no snapshot has taken in yet."""
        return self._events(self._tail(self._base()[1]))

    def state(self, run_id: int | None = None) -> DataFrame:
        """Folded state of every run, or of one: that reads the part of the snapshot with its id, and its own events."""
        base, folded = self._base()
        settled = self._snapshot(base)
        if run_id is not None and settled is not None:
            settled = settled.filter(F.col("id") == F.lit(run_id).cast("long"))
        names = self._tail(folded, "*" if run_id is None else f"{run_id}-*")
        # Without events since, the snapshot is the state: it has one row a run.
        return settled if settled is not None and not names else fold(settled, state_of(self._events(names)))

    def compact(self) -> str | None:
        """Fold the tail into a new snapshot; returns its name, or None where there is nothing to fold.

        A compaction that fails half way leaves files that nobody reads. Of two at once both are right by themselves, and
        the later name is read.
        """
        self._appended = 0
        base, folded = self._base()
        names = self._tail(folded)
        return self._settle(base, folded, names, state_of(self._events(names))) if names else None

    def load(self, events: DataFrame) -> str:
        """Take in a table of events (columns of ``EVENT_SCHEMA``, absent ones null) by one job, as a new snapshot."""
        given = {c.lower() for c in events.columns}
        types = {"id": "bigint", "step": "bigint", **FIELDS}
        shaped = events.select(*[(F.col(n) if n in given else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
        base, folded = self._base()
        names = self._tail(folded)
        fresh = state_of(shaped)
        if not names:
            return self._settle(base, folded, names, fresh, [n for n in FIELDS if n in given])
        return self._settle(base, folded, names, fresh.unionByName(state_of(self._events(names))))

    def _settle(self, base: str | None, folded: list[str], names: list[str], fresh: DataFrame, fields: Collection[str] = tuple(FIELDS)) -> str:
        version = 1 if base is None else int(base.split("-")[0]) + 1
        name = f"{version:012d}-{uuid.uuid4().hex}"
        state = fold(self._snapshot(base), fresh, fields)
        state.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/snapshots/{name}")
        for gone in folded:
            self._folder.delete(f"tail/{gone}")
        self._folder.put(f"snapshots/{name}.json", json.dumps(names))
        for old in self._folder.names("snapshots/*.json"):
            older = old.removesuffix(".json")
            if base is not None and older < base and int(older.split("-")[0]) < version - 1:
                self._folder.delete(f"snapshots/{old}")
                self._folder.delete(f"snapshots/{older}")
        return name

    def runs(self) -> DataFrame:
        """Current state of every run, in one aggregation."""
        return _shown(self.state())

    def run(self, run_id: int) -> Row | None:
        """Current state of one run."""
        return _shown(self.state(run_id)).head()

    def status_steps(self) -> DataFrame:
        """(id, step, status): the statuses each run went through."""
        return self.state().select("id", F.inline("steps"))

    def exports(self) -> DataFrame:
        return self.runs().drop(*PERFORMANCE)

    def performance(self) -> DataFrame:
        """Performance records; a run has one from the time its tables were measured."""
        runs = self.runs().filter("rows_fetched is not null")
        return runs.selectExpr("id", "id as export_id", *PERFORMANCE)


def _shown(state: DataFrame) -> DataFrame:
    return state.select("id", *[F.col(f"{n}.value").alias(n) for n in FIELDS])


def export_table_set(
    log: RunLog,
    table_set: TableSet,
    load: Callable[[str], DataFrame],
    directory: str,
    model: DurationModel | None = None,
    model_id: int | None = None,
    format: str = "gpkg",
    on_status: Callable[[str], None] = lambda status: None,
    **assembly: object,
) -> int:
    """Measure, predict, assemble and write one table set; returns the run's id.

    Every status is an event of the run and goes to ``on_status``: one for each table that is there, joining, writing,
    finalizing and the end. Any failure is recorded as FAILED and raised. Without a model the run has no prediction.
    """
    run_id = log.register(table_set)

    def enter(status: str, **fields: object) -> None:
        log.append(run_id, status=status, **fields)
        on_status(status)

    def fetch(status: str, table: str | None) -> DataFrame | None:
        if table is None:
            return None
        enter(status)
        return load(table)

    try:
        enter("FETCHING_TABLES")
        territory = fetch("FETCHING_TERRITORY", table_set.territory_table)
        name = fetch("FETCHING_NAMES", table_set.name_table)
        geometry = fetch("FETCHING_GEOMETRY", table_set.geometry_table)
        ndm = fetch("FETCHING_NDM", table_set.ndm_table)
        metrics = table_set_metrics(territory, name, geometry, ndm)
        started = datetime.now(UTC)
        measured = (metrics if model is None else model.predict(metrics)).head().asDict(recursive=True)
        predicted = measured.pop("predicted_seconds", None)
        measured.pop("missing_fields", None)
        log.append(
            run_id,
            status="IN_PROGRESS",
            fetch_timestamp=started,
            predicted_duration=predicted,
            predicted_method=None if model is None else "ridge",
            prediction_model_id=model_id,
            **measured,
        )
        enter("JOINING_TABLES")
        result = assemble(territory, name, geometry, ndm, **assembly)
        if result.is_spatial:
            enter("CONVERTING_GEOMETRY")
        enter("EXPORTING_FILE")
        path = output_path(directory, table_set.territory_table, format)
        write_features(result.dataframe, path, format=format, layer=table_set.territory_table)
        enter("FINALIZING")
        finished = datetime.now(UTC)
        enter(
            "COMPLETED",
            export_timestamp=finished,
            output_path=path,
            duration=(finished - started).total_seconds(),
            is_spatial=result.is_spatial,
        )
    except Exception:
        enter("FAILED")
        raise
    return run_id
