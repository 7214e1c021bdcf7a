"""Session factory and the few engine settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

HOT_GROUP_ROWS = "spark.busloom.hotGroupRows"
SMALL_INPUT_BYTES = "spark.busloom.smallInputBytes"
DENSE_WINDOW_ROWS = "spark.busloom.denseWindowRows"

STORED_PARTITIONS = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"

DEFAULTS = {
    HOT_GROUP_ROWS: 4_000_000,  # a group above this is split into slices
    SMALL_INPUT_BYTES: 256 << 20,  # below this no group can be hot: skip the check
    DENSE_WINDOW_ROWS: 50,  # rows per look-back above which frames are too slow: each row reads all of its frame
}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(DEFAULTS[name])))


def make_session(app: str = "busloom", master: str | None = None, shuffle: int | None = None):
    """A session with UTC clocks and adaptive execution.

    On a cluster the master, memory and checkpoint folder come from spark-submit.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a local one only if unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="busloom-ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df):
    """`cut_lineage` for steps that follow each other: the result is known by its real size.

    A checkpoint keeps the size estimated for its plan, a product at each join, so a loop of joins multiplies the digits of
    that number round by round. A stored plan is measured while it is written. It keeps one partition for each of the shuffle
    unless told otherwise, however few its rows are, and so do the rounds after it.
    """
    conf = df.sparkSession.conf
    before = conf.get(STORED_PARTITIONS, None)
    conf.set(STORED_PARTITIONS, "true")
    try:
        df = df.persist()
    finally:
        conf.unset(STORED_PARTITIONS) if before is None else conf.set(STORED_PARTITIONS, before)
    out = cut_lineage(df)
    df.unpersist()
    return out
