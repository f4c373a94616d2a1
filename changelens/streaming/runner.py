"""Restartable runs: new case files in, result log out.

The stream's checkpoint remembers which input files were taken and which cases were seen, so a case is
recorded once, and a batch that is replayed after a failure replaces what it had written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from changelens import schemas
from changelens.operators.sampling import unfinished
from changelens.sources import logs
from changelens.sources.cases import normalize
from changelens.sources.paths import exists

Predict = Callable[[dict, list], list]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # keys on disk, not in memory


def evaluate(cases: DataFrame, predict: Predict, types: str = "refactoring_types") -> DataFrame:
    """Run a prediction function per case: adds ``final_types``, ``status`` and ``error``.

    A failing case becomes an ERROR row and the run goes on. The function may
    return a list of labels or a dict with ``final_types``.
    """
    keep = cases.select("case_id", "url", types, F.to_json(F.struct(
        "commit_diff", "code_before", "code_after", "url")).alias("_case"), F.to_json("java_examples").alias("_examples"))
    out = f"case_id string, url string, {types} array<string>, final_types array<string>, status string, error string"

    def run(batches):
        import json

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    got = predict(json.loads(r[3]), json.loads(r[4] or "[]"))
                    final = got["final_types"] if isinstance(got, dict) else got
                    rows.append((*r[:3], list(final), "OK", None))
                except Exception as exc:  # the injected function may raise anything
                    rows.append((*r[:3], [], "ERROR", str(exc)[:500]))
            yield pd.DataFrame(rows, columns=["case_id", "url", types, "final_types", "status", "error"])

    return keep.mapInPandas(run, out)


def first_of_case(cases: DataFrame) -> DataFrame:
    """A stream of cases without those whose key was seen before, in this batch or an earlier one.

    The keys are the stream's state, so a batch looks up its own keys only, however many are finished. Of several rows
    of a case in one batch the one with the smallest digest of its diff and labels is taken.
    """
    order = F.md5(F.concat_ws("|", F.coalesce("commit_diff", F.lit("")), F.to_json("refactoring_types"), "url"))
    rows = cases.select("case_id", order.alias("digest"), F.to_json(F.struct(*cases.columns)).alias("row"))

    def pick(key, batches, state):
        best = None
        for pdf in batches:
            for found in zip(pdf["digest"], pdf["row"], strict=True):
                best = found if best is None or found < best else best
        if not state.exists:
            state.update((1,))
            yield pd.DataFrame({"row": [best[1]]})

    new = rows.groupBy("case_id").applyInPandasWithState(pick, "row string", "seen int", "append", GroupStateTimeout.NoTimeout)
    return new.select(F.from_json("row", cases.schema).alias("_c")).select("_c.*")


def run_incremental(spark: SparkSession, source: str, log_path: str, checkpoint: str,
                    process: Callable[[DataFrame], DataFrame], max_files: int = 64) -> int:
    """Process every case file that has not been processed yet; returns the number of batches.

    ``source`` holds JSON lines of case records. ``process`` turns cases into rows
    with ``final_types``.

    The checkpoint remembers the files taken and, as keyed state, the cases seen; a batch costs what it holds. Each batch writes
    a folder of its own in the log, so a batch that is repeated after a failure replaces its rows, and one that was written whole
    is not processed again. Only a log that other runs have written before this checkpoint was made
    is read: its keys are stored beside the checkpoint once, and each batch leaves them out.
    """
    stream = (spark.readStream.schema(schemas.RAW_CASE).option("maxFilesPerTrigger", max_files).json(source))
    before = f"{checkpoint}-before"
    if not exists(spark, checkpoint) and exists(spark, log_path):
        logs.finished_cases(logs.read_log(spark, log_path)).write.mode("overwrite").parquet(before)
    run_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    ran: set[int] = set()

    def one_batch(batch: DataFrame, epoch: int) -> None:
        out = f"{log_path}/batch-{run_id}-{epoch:08d}"
        if not exists(batch.sparkSession, f"{out}/_SUCCESS"):
            if exists(batch.sparkSession, before):
                batch = unfinished(batch, batch.sparkSession.read.schema("case_id string").parquet(before))
            logs.write_batch(logs.case_record(process(batch)), out)
        ran.add(epoch)

    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}):
        query = (first_of_case(normalize(stream)).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return len(ran)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a run."""
    held = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
