"""Session helpers: shared scratch space, lineage cuts, skew-proof joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A key that holds at least this share of a join side counts as hot. At most
#: ``1 / HOT_SHARE`` keys can be hot, which bounds what a hot-key broadcast holds.
HOT_SHARE = 0.01
#: A key with fewer rows than this never unbalances anything.
HOT_ROWS = 20_000


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("symtide")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints and written intermediates.

    ``spark.checkpoint.dir`` of the session wins, then a directory set on the context. Where both are
    unset a folder of our own is made: a temporary one in local mode, else one on the cluster's default
    file system; if that is the machine's own, nobody but the cluster's owner knows a shared folder, and it is an error.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if sc.master.startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="symtide-")
    elif sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        own = f"symtide-checkpoints/{sc.applicationId}"
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/symtide-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


_written: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                remove_path(spark, path)
        except Exception:
            pass


def materialize(df: DataFrame, tag: str = "cut", told: dict[str, Column] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table survives the loss of any executor and carries true sizes for the
    planner. It goes away at the end of the application, or with ``release``. The aggregates in ``told``
    are worked out while it is written, and come in ``_symtide_told``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    seen = Observation() if told else None
    (df.observe(seen, *(c.alias(k) for k, c in told.items())) if told else df).write.parquet(path)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._symtide_path = path
    back._symtide_told = seen.get if told else {}
    return back


_kept: dict[tuple, tuple[str, StructType]] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Length and time of every file of a table: what tells that it has changed."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def maintained(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` that ``build`` derives from ``sources`` of ``sf_dir``, kept in the shared folder.

    It is written when it is first asked for, and anew as soon as a file of a source has changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, *(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in sources))
    if key not in _kept or not path_exists(spark, _kept[key][0]):
        df = build()
        path = scratch_path(spark, name)
        df.write.parquet(path)
        _written[path] = spark
        for old in [k for k in _kept if k[:3] == key[:3] and k != key]:
            del _kept[old]
        _kept[key] = (path, df.schema)
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_symtide_path", None)
    if path:
        remove_path(df.sparkSession, path)
        _written.pop(path, None)


def hot_keys(df: DataFrame, key: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Keys of ``df`` that hold at least ``share`` of ``total`` rows: at most ``1/share`` of them."""
    floor = max(HOT_ROWS, int(share * total))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= floor).select(key)


def hot_list(df: DataFrame, key: str, total: int, share: float = HOT_SHARE) -> list:
    """The hot keys of ``df``, at most ``1/share``; small inputs have none."""
    return [] if total < HOT_ROWS else [r[0] for r in hot_keys(df, key, total, share).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "left", share: float = HOT_SHARE, hot: list | None = None) -> DataFrame:
    """Equi-join of ``left`` with ``right`` (unique by ``key``) that no hot key of ``left`` unbalances.

    The hot keys, at most ``1/share`` by counting, take their partner rows from a
    broadcast of just those rows; all other rows meet in an ordinary shuffle join.
    ``left`` is read twice and should be a table or a cheap scan. ``hot`` gives keys that
    ``hot_list`` has found already. Null keys find no
    partner: they stay with ``how='left'`` and go with ``'inner'``.
    """
    if hot is None:
        hot = hot_list(left, key, total, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    partners = F.broadcast(right.filter(is_hot))
    many = left.filter(is_hot).join(partners, key, how)
    rest = left.filter(F.col(key).isNull() | ~is_hot).join(right, key, how)
    return many.unionByName(rest)


def blank(c: Column) -> Column:
    """True where a text is null, empty or only white space."""
    return c.isNull() | (F.length(F.regexp_replace(c, r"\s+", "")) == 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
