"""Changes of tables as functions from snapshots to snapshots; Parquet tables are rewritten, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def insert_if_absent(table: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """table and the rows of new whose key isn't there yet; of new rows with one key the first, as if they came one by one."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return table.unionByName(first.join(table.select(*key).distinct(), key, "left_anti"))


def partial_update(table: DataFrame, change: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns that a change sets take its value, null included. change has key, and for each column c also c_set."""
    c = change.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_new_{x}") for x in columns], *[F.col(f"{x}_set").alias(f"_set_{x}") for x in columns])
    both = table.join(c, table[key] == c["_key"], "left")
    return both.withColumns({x: F.when(F.coalesce(F.col(f"_set_{x}"), F.lit(False)), F.col(f"_new_{x}")).otherwise(F.col(x)) for x in columns}).select(*table.columns)


def delete_where_in(table: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """table without the rows whose key is in gone; null keys stay."""
    return table.join(gone.select(F.col(gone_key).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")


def keep_least(table: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the one with the least `order`."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def renumbered(table: DataFrame, parent: str, order: list[Column], name: str = "position") -> DataFrame:
    """Positions from 0 within each parent."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)


def floored_decrement(column: str, by: Column) -> Column:
    """The counter less `by`, not under zero."""
    return F.greatest(F.col(column) - by, F.lit(0))


def insert_with_defaults(table: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """table and the rows of new; columns that new doesn't give take their default, else null."""
    for name, value in defaults.items():
        new = new if name in new.columns else new.withColumn(name, F.lit(value))
    return table.unionByName(new, allowMissingColumns=True)


def new_edges(edges: DataFrame, asked: DataFrame, own: DataFrame, key: list[str], owned: str) -> DataFrame:
    """The asked edges whose end `owned` is one's own, and that aren't there yet."""
    return asked.join(own, owned, "left_semi").join(edges.select(*key), key, "left_anti")


def first_conflict(new: DataFrame, old: DataFrame, columns: list[str]) -> DataFrame:
    """new with outcome: <column>_taken of the first column whose value old has, else ok."""
    outcome = F.lit("ok")
    for c in reversed(columns):
        new = new.join(old.select(c).distinct().withColumn(f"_{c}", F.lit(True)), c, "left")
        outcome = F.when(F.col(f"_{c}"), f"{c}_taken").otherwise(outcome)
    return new.withColumn("outcome", outcome)


def registered(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """new with outcome, as if its rows came one by one in the order of key: <column>_taken of the first column whose value an old
    row or an earlier accepted one has, else ok, and the row is accepted.

    A row that comes before all undecided ones with any of its values is accepted, and the rows with its values are refused; a round does
    so for all such rows, and there are as many rounds as rows wait for one another in turn. Nulls are equal to nothing. Keys are
    unique, and not null.
    """
    values = [f"_{c}" for c in columns]
    names = new.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(v) for c, v in zip(columns, values, strict=True)])
    for c, v in zip(columns, values, strict=True):
        names = names.join(old.select(F.col(c).cast("string").alias(v)).distinct().withColumn(f"{v}_old", F.lit(True)), v, "left")
    names = written(names)
    seen = F.lit(False)
    for v in values:
        seen = seen | F.coalesce(f"{v}_old", F.lit(False))
    left, accepted = written(names.where(~seen).select("_key", *values)), None
    while not left.isEmpty():
        first = left
        for v in values:
            first = first.join(left.where(F.col(v).isNotNull()).groupBy(v).agg(F.min("_key").alias(f"{v}_first")), v, "left")
        least = F.lit(True)
        for v in values:
            least = least & F.coalesce(F.col(f"{v}_first") == F.col("_key"), F.lit(True))
        now = written(first.where(least).select("_key", *values))
        accepted = now if accepted is None else accepted.union(now)
        left = left.join(now.select("_key"), "_key", "left_anti")
        for v in values:
            left = left.join(now.where(F.col(v).isNotNull()).select(v), v, "left_anti")
        left = written(left.select("_key", *values))
    outcome = F.lit("ok")
    for c, v in reversed(list(zip(columns, values, strict=True))):
        taken = F.coalesce(f"{v}_old", F.lit(False))
        if accepted is not None:
            by = accepted.where(F.col(v).isNotNull()).select(v, F.col("_key").alias(f"{v}_by"))
            names = names.join(by, v, "left")
            taken = taken | F.coalesce(F.col(f"{v}_by") < F.col("_key"), F.lit(False))
        outcome = F.when(taken, f"{c}_taken").otherwise(outcome)
    return new.join(names.select(F.col("_key").alias(key), outcome.alias("outcome")), key)


def with_changes(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table after changes (its columns, and change: create, update or delete): a full join on the key. At most one update or delete a key; a create adds its row, whether or not its key is there."""
    new = changes.where("change in ('create', 'update', 'delete')").select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in table.columns if c != key], "change")
    both = table.join(new, (F.col(key) == F.col("_key")) & (F.col("change") != "create"), "full").where("change is null or change = 'create' or (change = 'update' and " + key + " is not null)")
    pick = lambda c: F.when(F.col("change").isNull(), F.col(c)).otherwise(F.col(f"_new_{c}"))
    return both.select(*[F.coalesce(F.col(key), F.col("_key")).alias(key) if c == key else pick(c).alias(c) for c in table.columns])
