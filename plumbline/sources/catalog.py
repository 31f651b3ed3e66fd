"""Entities, their keys and relations, and the catalog that binds them to a Spark session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType

from ..errors import FieldNotFound


#: Spark's setting for the rows (offset and limit) up to which a sorted page is kept in memory, and the most that a catalog leaves it at.
TOP_K, MOST_TOP_K = "spark.sql.execution.topKSortFallbackThreshold", 100_000


@dataclass(frozen=True)
class Relation:
    """An equi-join to another entity: pairs of (own column, its column); ``many``: it may have several rows for one."""

    target: str
    on: tuple[tuple[str, str], ...]
    many: bool


@dataclass(frozen=True)
class Entity:
    """A table. ``load`` gives its DataFrame, whose columns in their order are the fields.

    ``unique``: the key is known to be unique and not null, so that counts of keys are counts of rows."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    pk: tuple[str, ...]
    relations: dict[str, Relation] = field(default_factory=dict)
    unique: bool = True


class Catalog:
    """Entities by name, read in one session. It takes the place of a database session in every run."""

    def __init__(self, spark: SparkSession, *entities: Entity):
        self.spark, self.entities = spark, {e.name: e for e in entities}
        self._frames: dict[str, DataFrame] = {}
        # A page far down a result is sorted on disk instead of held, offset and all, in memory.
        if int(spark.conf.get(TOP_K)) > MOST_TOP_K:
            spark.conf.set(TOP_K, str(MOST_TOP_K))

    def entity(self, entity: str | Entity) -> Entity:
        name = entity if isinstance(entity, str) else entity.name
        if isinstance(entity, Entity):
            self.entities.setdefault(name, entity)
        if name not in self.entities:
            raise FieldNotFound(f"Entity {name} not found")
        return self.entities[name]

    def frame(self, entity: str | Entity) -> DataFrame:
        own = self.entity(entity)
        if own.name not in self._frames:
            self._frames[own.name] = own.load(self.spark)
        return self._frames[own.name]

    def fields(self, entity: str | Entity) -> list[str]:
        return self.frame(entity).columns

    def type_of(self, entity: str | Entity, name: str) -> DataType:
        return self.frame(entity).schema[name].dataType

    def related(self, entity: str | Entity, name: str) -> tuple[Relation, Entity]:
        own = self.entity(entity)
        if name not in own.relations:
            raise FieldNotFound(f"Relation {name} not found in {own.name}")
        return own.relations[name], self.entity(own.relations[name].target)

    def resolve(self, entity: str | Entity, path: str) -> tuple[tuple[str, ...], Entity, str]:
        """A dotted path's relations, the entity that they lead to, and the field there."""
        *steps, name = path.split(".")
        own = self.entity(entity)
        for step in steps:
            _, own = self.related(own, step)
        if name not in self.fields(own):
            raise FieldNotFound(f"Field {name} not found in {own.name}")
        return tuple(steps), own, name


def parquet(path: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.read.parquet(path)


def jdbc(url: str, table: str, partition_column: str | None = None, partitions: int = 32, **options: str) -> Callable[[SparkSession], DataFrame]:
    """A database's table; predicates and columns are pushed down to it.

    With a ``partition_column`` (a number, date or time) it is read in so many parts, whose bounds the database is asked for; without
    one, or for a table that has no value in it, by a single task."""

    def load(spark: SparkSession) -> DataFrame:
        read = spark.read.format("jdbc").options(url=url, **options)
        if partition_column and "lowerBound" not in options:
            column = f"{partition_column}"
            low, high = read.option("dbtable", f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) bounds").load().first()
            if low is not None:
                read = read.options(partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
        return read.option("dbtable", table).load()

    return load


def dataframe(df: DataFrame) -> Callable[[SparkSession], DataFrame]:
    return lambda _: df
