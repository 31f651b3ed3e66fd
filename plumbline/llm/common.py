"""Helpers that the training-data operators share: scratch tables, shipping of code, hashing."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys with a number (16 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 19

#: Words are runs of anything but ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on a single machine, as in tests, one is made and set where none is named; on a cluster, whose executors wouldn't see it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut a plan's lineage.

    A written table outlives any executor; a later read never recomputes what made it.
    Tables go when ``drop`` is called, at the end of an ``only_for`` around, or when the driver ends."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        Scratch.live.append(self)
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, **options) -> DataFrame:
        """options: of the Parquet writer, by name with _ for points."""
        schema = df.schema
        df.write.mode("overwrite").options(compression="zstd", **{k.replace("_", "."): v for k, v in options.items()}).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        atexit.unregister(self.clear)
        if self in Scratch.live:
            Scratch.live.remove(self)
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session may be gone when the driver ends
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def only_for() -> Iterator[None]:
    """Scratch tables that are made inside go at the end: for results that are written before it."""
    before = list(Scratch.live)
    yield
    for made in [s for s in Scratch.live if s not in before]:
        made.clear()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="plumbline-")), "plumbline_llm.zip")
    with zipfile.ZipFile(target, "w") as out:
        out.writestr(f"{top.name}/__init__.py", "")  # workers need nothing of the rest of the package
        for path in sorted((top / "llm").glob("*.py")):
            out.write(path, f"{top.name}/{path.relative_to(top)}")
    context.addPyFile(target)
    context._plumbline_shipped = True


def set_aside(df: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """df with its columns that have the name of an added one renamed: _input is put behind the name."""
    taken = {c.lower() for c in (*df.columns, *added)}
    names = []
    for c in df.columns:
        name = c
        if c.lower() in {a.lower() for a in added}:
            while name.lower() in taken:
                name += "_input"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names) if names != df.columns else df


def running_base(sums: DataFrame, key: str, n: str) -> DataFrame:
    """key (numbers, each once) and base: the sum of n over smaller keys; first within blocks of 1024 keys, then over blocks."""
    blocks = sums.select(key, n, F.floor(F.col(key) / 1024).alias("block"))
    inner = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.groupBy("block").agg(F.sum(n).alias("m")).select("block", F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("start"))
    return blocks.withColumn("within", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(ahead, "block").select(key, (F.col("start") + F.col("within")).alias("base"))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once for each row, also if body's lambdas use it often."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that are worked on at a time; a batch of Spark's has ten times as many, or 64 MB.
AT_A_TIME = 1000


def map_texts(df: DataFrame, make, schema: str, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Run ``make()(ids, texts, *extra) -> arrays`` over parts of Arrow batches of id and text.

    ``make`` is called once for each task and returns the function for batches; what that returns
    are the columns after the id. ``schema`` is theirs; the id keeps its type. Only these columns are
    read, so other columns of the input may have any name."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in extra))
    out = StructType([rows.schema["doc_id"], *StructType.fromDDL(schema).fields])
    fields = to_arrow_schema(out)

    def run(batches):
        work = make()
        for whole in batches:
            for batch in (whole.slice(k, AT_A_TIME) for k in range(0, whole.num_rows, AT_A_TIME)):
                columns = work(batch.column(0), *(batch.column(k).to_pylist() for k in range(1, batch.num_columns)))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(fields.field(0).type), *(c if isinstance(c, pa.Array) else pa.array(c, type=fields.field(k + 1).type) for k, c in enumerate(columns))], schema=fields)

    return rows.mapInArrow(run, out)
