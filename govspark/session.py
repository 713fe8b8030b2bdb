"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this library expects.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles methods above this size. Wide projections run several times
    # faster as split functions than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Temporary folder of a local-mode session, by application id.
_local_scratch: dict[str, str] = {}


def build_session(app: str = "govspark", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. ``cores`` picks local mode; leave it out on a cluster."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made.

    They stay set, the time zone included, because queries run after this returns. The number of
    shuffle partitions is left to the owner of the session.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_scratch.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="govspark-")
        _local_scratch[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


class RunFolder:
    """The written steps of one run, in a folder named after it under ``spark.checkpoint.dir``.

    The manifest is a marker per finished step, made after all of the step's files are there. A run
    started again under the same name, on another driver too, reads finished steps and writes the
    others anew. The folder stays until its owner calls ``close``. A name belongs to one input: the
    owner picks another one for other data.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{_base(spark)}/run-{name}"

    def _files(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _marker(self, step: str) -> str:
        return f"{self.path}/manifest/{step}"

    def done(self, step: str) -> bool:
        files, marker = self._files(self._marker(step))
        return files.exists(marker)

    def written(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The step's rows, read from its folder; made and written first if the step is not done."""
        path = f"{self.path}/{step}"
        if not self.done(step):
            make().write.mode("overwrite").parquet(path)
            files, marker = self._files(self._marker(step))
            files.create(marker, True).close()
        return self.spark.read.parquet(path)

    def close(self) -> None:
        """Removes the folder with all that the run has written."""
        files, folder = self._files(self.path)
        files.delete(folder, True)


_owner: ContextVar[RunFolder | None] = ContextVar("owner", default=None)


@contextmanager
def owned_scratch(spark: SparkSession, name: str) -> Iterator[RunFolder]:
    """Intermediates written inside go to the run's folder, so that its owner can remove them.

    Results are often read from these files later, so leaving the block removes nothing: call
    ``close`` on the run when its results are not needed any more.
    """
    run = RunFolder(spark, name)
    token = _owner.set(run)
    try:
        yield run
    finally:
        _owner.reset(token)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediates, under ``spark.checkpoint.dir`` or the run that owns them.

    Executors on every machine must see the folder, so on a cluster the setting is required.
    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    owner = _owner.get()
    return f"{owner.path if owner else _base(spark)}/{purpose}-{uuid.uuid4().hex}"
