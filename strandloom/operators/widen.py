"""Attribute-value rows brought into one row per entity with typed columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import pick

#: What joins several distinct values of one string attribute.
JOINER = "__"
WHOLE_NUMBER = r"\A\+?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.0+)?\z"


def attribute_name(name: Column) -> Column:
    """The name without case and outer blanks, with ``_`` for ``-`` and inner blanks."""
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def usable_value(value: Column) -> Column:
    """The value without outer blanks and a pair of double quotes; null for ``''``, ``.`` and ``NA``."""
    v = F.trim(value)
    v = F.when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.when(~v.isin("", ".", "NA"), v)


def whole_number(value: Column) -> Column:
    """The value as a whole number, null if it isn't one or doesn't fit into 64 bits."""
    digits = F.translate(F.regexp_replace(value, r"\..*", ""), "+,", "")
    return F.when(value.rlike(WHOLE_NUMBER), digits.try_cast("bigint"))


def _column(kind: str, ordinal: np.ndarray, values: pa.Array, first: int, count: int) -> pa.Array:
    """One attribute as a typed column of the ordinals first..first + count - 1, from its values and the ascending ordinals of their entities."""
    if kind == "bigint":
        leads = np.ones(len(ordinal), bool)
        leads[1:] = ordinal[1:] != ordinal[:-1]
        column = np.full(count, -1, np.int64)
        column[ordinal[leads] - first] = values.filter(pa.array(leads)).cast(pa.int64()).to_numpy(zero_copy_only=False)
        return pa.array(column)
    offsets = np.searchsorted(ordinal, np.arange(first, first + count + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), JOINER)


class _Stitcher:
    """Rows sorted by entity, attribute and order, taken batch by batch: each entity gets the next ordinal, each attribute is kept apart as (ordinal, value), and
    whole ranges of ordinals are assembled from the columns by position, without a join. The last entity of a batch may go on in the next one, its ordinal too."""

    def __init__(self, columns: list[tuple[str, str]], base: int, names: list[str]):
        self.columns, self.names = columns, names
        self.first = self.next = base
        self.last: pa.Scalar | None = None
        self.entities: list[pa.Array] = []
        self.parts: list[list[tuple[np.ndarray, pa.Array]]] = [[] for _ in columns]

    def add(self, batch: pa.RecordBatch) -> None:
        entity, code, values = batch.column("k"), batch.column("a").to_numpy(), batch.column("v")
        new = np.ones(len(entity), bool)
        new[1:] = pc.not_equal(entity.slice(1), entity.slice(0, len(entity) - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.last is None or not entity[0].equals(self.last)
        ordinal = self.next - 1 + np.cumsum(new)
        self.next, self.last = int(ordinal[-1]) + 1, entity[len(entity) - 1]
        self.entities.append(entity.filter(pa.array(new)))
        for i, parts in enumerate(self.parts, 1):
            at = np.flatnonzero(code == i)
            if len(at):
                parts.append((ordinal[at], values.take(pa.array(at))))

    def take(self, upto: int) -> pa.RecordBatch | None:
        """The rows of the ordinals before ``upto``."""
        count = upto - self.first
        if count <= 0:
            return None
        entities = pa.chunked_array(self.entities).combine_chunks()
        done = [pa.array(np.arange(self.first, upto)), entities.slice(0, count)]
        self.entities = [entities.slice(count)]
        for i, (_, kind) in enumerate(self.columns):
            parts = self.parts[i]
            ordinal = np.concatenate([o for o, _ in parts]) if parts else np.zeros(0, np.int64)
            values = pa.chunked_array([v for _, v in parts], pa.string()).combine_chunks() if parts else pa.array([], pa.string())
            cut = int(np.searchsorted(ordinal, upto))
            done.append(_column(kind, ordinal[:cut], values.slice(0, cut), self.first, count))
            self.parts[i] = [(ordinal[cut:], values.slice(cut))] if cut < len(ordinal) else []
        self.first = upto
        return pa.RecordBatch.from_arrays(done, self.names)


def attributes_to_columns(
    df: DataFrame, columns: dict[str, str], entity: str = "index", attribute: str = "attribute", value: str = "value", order: str = "ord", ordinal: str | None = None
) -> DataFrame:
    """One row per entity: the entity and, of each attribute in ``columns`` (name -> ``bigint`` or ``string``), a typed column.

    Names are compared by ``attribute_name`` and values cleaned by ``usable_value``. A bigint column holds the first whole
    number by order, or -1; a string column the distinct values in order of their first appearance, joined by ``__``, or ''.
    Rows with a null entity or attribute are not used; an entity whose rows hold no usable value still has its row. Rows
    with a null order come last, ties are broken by value, repeated rows change nothing, an empty table gives no rows. With ``ordinal`` the
    entities' global ordinals come along, in a column of that name.

    Equal values of an entity's attribute are collapsed before the first shuffle, so that an entity with very many rows
    costs what its result holds. Entities are spread by hash and sorted; a partition owns the ordinals from partition << 33 on and gives them
    out in turn, so they are unique over the table and dense in each partition without a count beforehand. Every attribute is written as (ordinal, value) of its own, typed
    and aligned to a range of ordinals, and the columns of a range stand side by side by position.
    """
    spec = list(columns.items())
    rows = pick(df, k=entity, name=attribute, value=value, o=order).where("k is not null and name is not null")
    id_type = rows.schema["k"].dataType
    v = usable_value(F.col("value").cast("string"))
    code = F.array_position(F.array(*[F.lit(c) for c, _ in spec]), attribute_name(F.col("name"))).cast("int")
    numbers = [i for i, (_, kind) in enumerate(spec, 1) if kind == "bigint"]
    rows = rows.select("k", code.alias("a"), v.alias("v"), F.coalesce(F.col("o").cast("bigint"), F.lit((1 << 63) - 1)).alias("o"))
    rows = rows.withColumn("v", F.when(F.col("a").isin(numbers), whole_number(F.col("v")).cast("string")).when(F.col("a") > 0, F.col("v")))
    rows = rows.withColumn("a", F.when(F.col("v").isNull(), 0).otherwise(F.col("a")))
    rows = rows.groupBy("k", "a", "v").agg(F.min("o").alias("o"))
    rows = rows.repartition("k").sortWithinPartitions("k", "a", "o", "v").select("k", "a", "v")
    names = ["_ordinal", "_entity", *[f"_c{i}" for i in range(len(spec))]]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stitcher = _Stitcher(spec, TaskContext.get().partitionId() << 33, names)
        for batch in batches:
            if batch.num_rows:
                stitcher.add(batch)
                done = stitcher.take(stitcher.next - 1)
                if done is not None:
                    yield done
        done = stitcher.take(stitcher.next)
        if done is not None:
            yield done

    schema = T.StructType([T.StructField("_ordinal", T.LongType()), T.StructField("_entity", id_type), *[T.StructField(f"_c{i}", T.LongType() if kind == "bigint" else T.StringType()) for i, (_, kind) in enumerate(spec)]])
    out = rows.mapInArrow(stitch, schema)
    return out.select(*([F.col("_ordinal").alias(ordinal)] if ordinal else []), F.col("_entity").alias(entity), *[F.col(f"_c{i}").alias(c) for i, (c, _) in enumerate(spec)])
