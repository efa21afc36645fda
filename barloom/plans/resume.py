"""A walk-forward test that is kept and carried on: only what new or changed bars touch is run again.

Scores and fits lie in a table by ticker, each origin with a fingerprint: of the settings, and of all
prepared rows up to its outcome. A run takes the calendar of all origins, leaves out those that the table
has with the same fingerprint, and runs the others alone. A range of refits that is carried on
starts from the fits that the table holds of the origin before, so that the result equals that of a
full run number by number. A changed old bar changes the fingerprints from there on, new settings change
all; rows whose fingerprint no longer holds stay in the table unread, until `compacted`.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .walkforward import RANGE, candidates, engine, record_schema, test_origins

C = F.col
#: What no forecast depends on.
APART = ("output", "data")
KEY = ["ticker", "refit", "position", "print"]


def settings_print(settings: dict) -> str:
    told = {k: v for k, v in settings.items() if k not in APART}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:16]


def keys(prepared: DataFrame, settings: dict, columns: list[str]) -> DataFrame:
    """The calendar (ticker, refit, position, print). The print of an origin covers `columns` of all rows up
    to its outcome: an exclusive or of row hashes, each with its position, over one window."""
    w = Window.partitionBy("ticker").orderBy("position").rowsBetween(Window.unboundedPreceding, settings["forecast"]["horizon_days"])
    one = F.xxhash64("position", "date", *columns)
    told = prepared.select("ticker", C("position").cast("int").alias("position"), F.concat_ws("-", F.lit(settings_print(settings)), F.hex(F.bit_xor(one).over(w))).alias("print"))
    each = test_origins(prepared, settings).select("ticker", C("refit").cast("long").alias("refit"), F.explode(C("positions").cast("array<int>")).alias("position"))
    return each.join(told, ["ticker", "position"]).select(*KEY)


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; without rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def work_left(todo: DataFrame, held: DataFrame) -> DataFrame:
    """The missing origins as ranges of refits (WORK), each with the fits and the kept indicators of the
    origin before, where the table has it. `todo` and `held` share the calendar's prints; what is held
    of a ticker is always a first part of its calendar."""
    own = held.where("model = 'engine'")
    refits = todo.groupBy("ticker", "refit").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    begun = own.groupBy("ticker", "refit").agg(F.max_by("suite", "position").alias("suite"), F.max(F.from_json("note", "kept array<string>")["kept"]).alias("names"))
    same = refits.join(begun, ["ticker", "refit"], "left")
    before = begun.select("ticker", (C("refit") + 1).alias("refit"), C("suite").alias("suite_before"))
    both = same.join(before, ["ticker", "refit"], "left").withColumn("range", F.floor(C("refit") / RANGE).cast("long"))
    inside = C("refit") % RANGE != 0
    start = F.coalesce(C("suite"), F.when(inside, C("suite_before")))
    ranges = both.groupBy("ticker", "range").agg(F.array_sort(F.collect_list(F.struct("refit", "positions", C("names").isNotNull().alias("fitted")))).alias("todo"), F.min_by(F.struct(start.alias("warm"), C("names").alias("kept")), "refit").alias("first"))
    return ranges.select("ticker", "range", "todo", C("first.warm").alias("warm"), C("first.kept").alias("kept"))


@dataclass
class Resumed:
    """Records and refit log as of a full run, and how many origins this run scored."""

    records: DataFrame
    refits: DataFrame
    origins_run: int


def resumed_walk_forward(prepared: DataFrame, settings: dict, folder: str) -> Resumed:
    """The walk-forward test of `prepared`, carried on from what `folder` holds and kept there. `folder` must
    be one that the driver and all executors share. One run at a time writes to a folder; a run that broke
    off is carried on by the next, since Spark commits each table's new rows at once."""
    spark = prepared.sparkSession
    levels, names = settings["forecast"]["interval_levels"], settings["redundancy"]["priority"]
    scores, records = f"{folder}/scores", f"{folder}/engine"
    scored_schema, engine_schema = record_schema(levels) + ", print string", record_schema(levels) + ", chosen string, print string"
    prepared = prepared.withColumn("position", C("position").cast("int"))
    calendar = keys(prepared, settings, ["x", "trending", "reaction", *names]).checkpoint()
    valid = lambda table: table.join(F.broadcast(calendar) if calendar.count() <= 200_000 else calendar, KEY, "left_semi")

    held = valid(kept(spark, scores, scored_schema))
    todo = calendar.join(held.where("model = 'engine'").select(*KEY), KEY, "left_anti").checkpoint()
    count = todo.count()
    if count:
        new = candidates(prepared, settings, work=work_left(todo, held))
        new.join(todo.select("ticker", "position", "print"), ["ticker", "position"]).write.partitionBy("ticker").mode("append").parquet(scores)
    scored = valid(kept(spark, scores, scored_schema))
    done = valid(kept(spark, records, engine_schema))
    left = calendar.join(done.select(*KEY), KEY, "left_anti")
    if left.limit(1).count():
        # A choice looks at all scores before it; only missing origins are simulated.
        engine(scored, settings, left).join(left.select("ticker", "position", "print"), ["ticker", "position"]).write.partitionBy("ticker").mode("append").parquet(records)
    done = valid(kept(spark, records, engine_schema))
    apart = ("suite", "note", "scale", "print")
    out = scored.where("model != 'engine'").drop(*apart).withColumn("chosen", F.lit(None).cast("string")).unionByName(done.drop(*apart))
    log = scored.where("note IS NOT NULL").select("ticker", "date", "refit", F.from_json("note", "kept array<string>, dropped map<string,array<string>>, adf_statistic double, adf_rejects_unit_root boolean, multiplier double, garch_persistence double, garch_tail_dof double").alias("n")).select("ticker", "date", "refit", "n.*")
    return Resumed(out, log, count)


def compacted(prepared: DataFrame, settings: dict, folder: str, target: str) -> None:
    """Writes what still holds of `folder` to `target`, a new folder, by whole files for each ticker."""
    levels = settings["forecast"]["interval_levels"]
    prepared = prepared.withColumn("position", C("position").cast("int"))
    calendar = keys(prepared, settings, ["x", "trending", "reaction", *settings["redundancy"]["priority"]])
    for part, schema in (("scores", record_schema(levels) + ", print string"), ("engine", record_schema(levels) + ", chosen string, print string")):
        table = kept(prepared.sparkSession, f"{folder}/{part}", schema).join(calendar, KEY, "left_semi")
        table.repartition("ticker").write.partitionBy("ticker").parquet(f"{target}/{part}")
