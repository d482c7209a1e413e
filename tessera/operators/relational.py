"""Relational operators of a document library: filters, joins, ranks and pages, as functions on DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with this key, or one of them if there are several; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def contains_any(pattern: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ in the pattern stay wildcards, null columns don't match."""
    return reduce(or_, [F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False)) for c in columns])


def all_given(*conditions: Column | None) -> Column:
    """The conditions that were supplied, all of which must hold."""
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else F.lit(True)


def not_expired(column: str, now: Column) -> Column:
    """Null, or later than now."""
    return F.col(column).isNull() | (F.col(column) > now)


def paginate(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """A page in the given order (end it with a unique column); skip from 0, limit from 1 to most."""
    if skip < 0 or not 1 <= limit <= most:
        raise ValueError(f"skip must not be negative and limit must be from 1 to {most}")
    return df.orderBy(*order).offset(skip).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], skip: int, limit: int, most: int = 100) -> DataFrame:
    """A page whose rows carry the number of all rows: an aggregate of one row, joined to the page."""
    return paginate(df, order, skip, limit, most).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def sort_by_name(df: DataFrame, column: str, direction: str, allowed: list[str], default: str, tie: str) -> DataFrame:
    """By an allowed column, else the default; any direction but desc ascends. Nulls come first when descending, last when ascending."""
    c = F.col(column if column in allowed else default)
    return df.orderBy(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last(), tie)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group, numbered in `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def counts_for(df: DataFrame, key: str, facts: DataFrame, fact_key: str, name: str) -> DataFrame:
    """df with the number of facts for its key, 0 where there are none."""
    n = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
    return df.join(n, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_k")


def display_name(full: str, user: str) -> Column:
    """The full name, or where it is null or empty the user's."""
    return F.coalesce(F.nullif(F.col(full), F.lit("")), F.col(user))


def visible_shares(shares: DataFrame, principals: DataFrame) -> DataFrame:
    """Shares that some principal (kind, id) of a user is named in; each once. shares has share_id, to_kind, to_id, owner_id.

    principals holds the user, the user's groups, and as all_students the mentors whose students the user belongs to.
    """
    named = F.when(F.col("to_kind") == "all_students", F.col("owner_id")).otherwise(F.col("to_id"))
    return shares.withColumn("_id", named).join(principals, (F.col("to_kind") == F.col("kind")) & (F.col("_id") == F.col("id")), "left_semi").drop("_id")


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which the condition holds, and all others."""
    holds = F.coalesce(condition, F.lit(False))
    return df.where(holds), df.where(~holds)


def capped(df: DataFrame, key: str, order: Column, most: int = 100, keep: int = 50) -> DataFrame:
    """Histories of more than `most` rows cut to their last `keep`."""
    w = Window.partitionBy(key)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(order.desc())))
    return rows.where((F.col("_n") <= most) | (F.col("_r") <= keep)).drop("_n", "_r")


def box(rows: DataFrame, key: str, value: str, reach: float = 1.5) -> DataFrame:
    """key, n, given (values that aren't null), q1, middle, q3 (exact, between neighbours in proportion), low, high (whiskers) and outliers.

    A group without values has nulls and no outliers. Exact percentiles count values before they are shuffled, so a group is as large as its different values.
    """
    v = F.col(value)
    q = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("given"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    wide = (F.col("_q")[2] - F.col("_q")[0]) * reach
    q = q.select(F.col(key).alias("_key"), "n", "given", "_q", (F.col("_q")[0] - wide).alias("_lo"), (F.col("_q")[2] + wide).alias("_hi"))
    both = rows.select(key, v.alias("_v")).join(q, F.col(key).eqNullSafe(F.col("_key")))
    low, high = F.col("_v") >= F.col("_lo"), F.col("_v") <= F.col("_hi")
    out = both.groupBy(key).agg(*[F.first(c).alias(c) for c in ("n", "given", "_q")], F.min(F.when(low, F.col("_v"))).alias("low"), F.max(F.when(high, F.col("_v"))).alias("high"), F.count_if(~low | ~high).alias("outliers"))
    return out.select(key, "n", "given", *[F.round(F.col("_q")[k], 6).alias(x) for k, x in enumerate(("q1", "middle", "q3"))], "low", "high", "outliers")


def shape(df: DataFrame, name: str) -> DataFrame:
    """name, n_rows, n_columns and kinds (names and types) of a table: one count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(", ".join(f"{c} {k}" for c, k in df.dtypes)).alias("kinds"))


def named_references(rows: DataFrame, kind: str, id_: str, targets: dict[str, DataFrame]) -> DataFrame:
    """rows with name and detail (a map) of what (kind, id_) refers to; rows whose target is gone, has no name or is of no known kind drop out.

    targets: a table (id, name, detail) for each kind. They are joined as one table, so rows are shuffled once however many kinds there are.
    """
    every = None
    for k, t in targets.items():
        part = t.select(F.lit(k).alias("_kind"), F.col("id").cast("long").alias("_id"), F.col("name").alias("name"), F.col("detail").cast("map<string,string>").alias("detail"))
        every = part if every is None else every.union(part)
    every = every.where("coalesce(name, '') <> ''")
    return rows.join(every, (F.col(kind) == F.col("_kind")) & (F.col(id_) == F.col("_id"))).drop("_kind", "_id")


def answered(invitations: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """invitations (id, from_user, to_user, status, expires_at) with the status after answers (id, user, action), one each, and outcome.

    accept and reject are the receiver's, cancel is the sender's; any other answer, one to an invitation that isn't pending, and one to
    none at all is `not_found`. An accepted invitation that has expired is cancelled, and the outcome is `expired`.
    """
    a = answers.select(F.col("id").alias("_id"), F.col("user").alias("_user"), F.col("action").alias("_action"))
    both = invitations.join(a, F.col("id") == F.col("_id"), "left")
    mine = F.when(F.col("_action") == "cancel", F.col("_user") == F.col("from_user")).when(F.col("_action").isin("accept", "reject"), F.col("_user") == F.col("to_user"))
    allowed = F.coalesce(mine & (F.col("status") == "pending"), F.lit(False))
    late = (F.col("_action") == "accept") & F.coalesce(F.col("expires_at") < now, F.lit(False))
    outcome = F.when(F.col("_id").isNull(), F.lit(None)).when(~allowed, "not_found").when(late, "expired").otherwise("done")
    done = F.when(late, "cancelled").when(F.col("_action") == "accept", "accepted").when(F.col("_action") == "reject", "rejected").otherwise("cancelled")
    return both.select(*[F.when(allowed, done).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in invitations.columns], outcome.alias("outcome"))


def bounded(rounds: DataFrame, key: str, place: str, done: Column, most: int) -> DataFrame:
    """key, rounds, answered and answer_place: rounds are taken in their order until one is done, `most` at the most.

    answered is false where none of these is done: then a summary is asked for. answer_place is the place of the round that is done.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(place))
    first = rounds.select(key, F.col(place).alias("_p"), F.coalesce(done, F.lit(False)).alias("_d"), nth.alias("_n")).where(F.col("_n") <= most)
    end = F.min(F.when(F.col("_d"), F.struct("_n", "_p")))
    by = first.groupBy(key).agg(F.max("_n").alias("_m"), end.alias("_e"))
    return by.select(key, F.coalesce("_e._n", "_m").cast("long").alias("rounds"), F.col("_e").isNotNull().alias("answered"), F.col("_e._p").alias("answer_place"))
