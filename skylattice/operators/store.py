"""Writes to keyed tables as set operations: each returns the table's new content, to be written as a whole or by part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.shared import cut, numbered


def last_of(new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of new for each key: the last by order, or by all its columns where no order is given."""
    by = order or [c for c in new.columns if c not in keys]
    return deduplicated(new, keys, *[F.col(c).desc_nulls_last() for c in by]) if by else new.dropDuplicates(keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, order: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old by key in all columns that new has, NULL values too, and others are added.

    Of several rows of one key in new the last by `order` counts. Columns that new lacks keep their value.
    """
    o, n = old.alias("o"), last_of(new, keys, order).withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    return both.select(*[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that new names go; new's rows come."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], *, order: list[str] | None = None) -> DataFrame:
    """Rows of new, the last of each key, and those of old whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(last_of(new, keys, order).select(*old.columns))


def append_absent(old: DataFrame, new: DataFrame, keys: list[str], *, order: list[str] | None = None) -> DataFrame:
    """The rows of new to append: the last of each key that old doesn't have."""
    return last_of(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def pooled_nights(new: DataFrame, key: str) -> DataFrame:
    """One row for each star of several nights' statistics (key, rms, n_frames, median_mag, suspect), with `nights`: rms
    weighted by frames (1 at least), median_mag by nights; unknown values weigh nothing."""
    w = F.when(F.col("rms").isNotNull(), F.greatest(F.lit(1), F.coalesce("n_frames", F.lit(0))))
    return new.groupBy(key).agg(
        F.sqrt(F.sum(w * F.col("rms") * F.col("rms")) / F.sum(w)).alias("rms"), F.sum(F.coalesce("n_frames", F.lit(0))).alias("n_frames"), F.count("*").alias("nights"),
        F.avg("median_mag").alias("median_mag"), F.bool_or(F.coalesce("suspect", F.lit(False))).alias("suspect"),
    )


def merge_pooled(old: DataFrame, new: DataFrame, key: str, *, nights: str | None = None) -> DataFrame:
    """Library of comparison stars (key, rms, n_frames, n_obs, median_mag, suspect) with new nights pooled in.

    rms: root of the mean square, weighted by frames (by nights where a row has no frames), 1 at least. median_mag: mean
    weighted by nights. Counters add up, flags stay once set. A row of new is one night, or as many as its column `nights`
    says; a key comes once in new (see pooled_nights).
    """
    o, n = old.alias("o"), new.alias("n")
    t = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    more = F.col(f"n.{nights}") if nights else F.lit(1)
    wo = F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("o.n_frames"), F.lit(0)), F.col("o.n_obs")))
    wn = F.greatest(F.lit(1), F.col("n.n_frames"))
    pooled = F.sqrt((wo * F.pow("o.rms", 2) + wn * F.pow("n.rms", 2)) / (wo + wn))
    mag = (F.col("o.median_mag") * F.col("o.n_obs") + F.col("n.median_mag") * more) / (F.col("o.n_obs") + more)
    return t.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), F.coalesce(pooled, "o.rms", "n.rms").alias("rms"), (F.coalesce("o.n_frames", F.lit(0)) + F.coalesce("n.n_frames", F.lit(0))).alias("n_frames"),
        (F.coalesce("o.n_obs", F.lit(0)) + F.when(F.col(f"n.{key}").isNotNull(), more).otherwise(0)).alias("n_obs"), F.coalesce(mag, "o.median_mag", "n.median_mag").alias("median_mag"),
        (F.coalesce("o.suspect", F.lit(False)) | F.coalesce("n.suspect", F.lit(False))).alias("suspect"),
    )


def lowest_near(old: DataFrame, new: DataFrame, equal: list[str], near: str, tolerance: float) -> DataFrame:
    """new with _id: one to a few rows for each that old (_id, equal, near) has something equal and near enough for; the least
    _id is the lowest of all those.

    In cells as wide as the tolerance what is near enough is the end of one cell, whole cells, and the beginning of another:
    running minima say all. Where the difference is the tolerance but for rounding, pairs are tested.
    """
    key, little = [f"_equal_{c}" for c in equal], max(tolerance * 1e-6, 1e-9)
    o = old.groupBy(*[F.col(c).alias(f"_equal_{c}") for c in equal], F.col(near).cast("double").alias("_v")).agg(F.min("_id").alias("_id")).where("_v is not null and not isnan(_v)")
    asks = new.where(F.col(near).isNotNull() & ~F.isnan(F.col(near).cast("double"))).select(*new.columns, *[F.col(c).alias(f"_equal_{c}") for c in equal], F.col(near).cast("double").alias("_t"))
    fine = lambda x: F.floor(x / (4 * little))
    edge = asks.withColumn("_e", F.explode(F.array(F.col("_t") - tolerance, F.col("_t") + tolerance))).withColumn("_f", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: fine(F.col("_e")) + i)))
    parts = [edge.join(o.withColumn("_g", fine(F.col("_v"))), [*[o[k].eqNullSafe(edge[k]) for k in key], F.col("_f") == F.col("_g")]).where(F.abs(F.col("_t") - F.col("_v")) <= tolerance)]
    if tolerance > 4 * little:
        cell = lambda x: F.floor(x / tolerance)
        own = o.withColumn("_cell", cell(F.col("_v"))).withColumn("_asks", F.lit(0))
        for sign in (-1, 1):  # from the lower end up, and up to the upper end
            at = F.col("_t") + sign * (tolerance - little)
            both = own.unionByName(asks.withColumn("_v", at).withColumn("_cell", cell(at)).withColumn("_asks", F.lit(1)), allowMissingColumns=True)
            w = Window.partitionBy(*key, "_cell").orderBy(F.col("_v") if sign > 0 else F.desc("_v"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
            parts.append(both.withColumn("_id", F.min("_id").over(w)).where("_asks = 1"))
        whole = own.groupBy(*key, "_cell").agg(F.min("_id").alias("_id"))
        first, last = cell(F.col("_t") - (tolerance - little)) + 1, cell(F.col("_t") + (tolerance - little)) - 1
        between = asks.where(first <= last).withColumn("_c", F.explode(F.sequence(first, last)))
        parts.append(between.join(whole, [*[whole[k].eqNullSafe(between[k]) for k in key], F.col("_c") == F.col("_cell")]))
    out = [x.where("_id is not null").select(*new.columns, "_id") for x in parts]
    return reduce(DataFrame.unionByName, out)


def find_or_create(old: DataFrame, new: DataFrame, id_column: str, equal: list[str], near: str, tolerance: float) -> DataFrame:
    """new with the lowest id of an old row that is equal and near enough, or a fresh id after the highest, and created.

    Fresh ids follow the order of new's columns; they are numbered range by range.
    """
    found = lowest_near(old.select(F.col(id_column).alias("_id"), *equal, near), new, equal, near, tolerance)
    t = new.withColumn("_id", F.lit(None).cast(dict(old.dtypes)[id_column])).unionByName(found).groupBy(*new.columns).agg(F.min("_id").alias("_id"))
    top = old.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    known = t.where("_id is not null").select(*new.columns, F.col("_id").alias(id_column), F.lit(False).alias("created"))
    fresh = numbered(t.where("_id is null").select(*new.columns), "_nth", list(new.columns))
    made = fresh.crossJoin(F.broadcast(top)).select(*new.columns, (F.col("_top") + F.col("_nth")).alias(id_column), F.lit(True).alias("created"))
    return known.unionByName(made)


def update_where(old: DataFrame, changes: DataFrame, key: str, guard: Column | None = None, *, order: list[str] | None = None) -> DataFrame:
    """old with the columns of changes set by key, the last of several changes; guard keeps rows as they are where it is
    false."""
    c = last_of(changes, [key], order).select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    t = old.join(c, F.col(key) == F.col("_k"), "left")
    on = F.coalesce(F.col("_hit"), F.lit(False)) & (guard if guard is not None else F.lit(True))
    return t.select(*[F.when(on, F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in changes.columns and x != key else F.col(x) for x in old.columns])


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti").select(*old.columns)


def edits(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """after and deleted rows of before with `change`: insert, update, delete; rows that are the same are left out."""
    columns = before.columns
    b, a = before.alias("b"), after.select(*columns).alias("a")
    t = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    change = F.when(F.col(f"b.{key}").isNull(), "insert").when(F.col(f"a.{key}").isNull(), "delete").otherwise("update")
    gone = F.col(f"a.{key}").isNull()
    return t.where(~same).select(*[F.when(gone, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns], change.alias("change"))


def editor_save(before: DataFrame, after: DataFrame, key: str, references: dict[str, tuple[DataFrame, str]], *, active: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What saving an edited table gives: the new table, and the deletions refused (key, table, n).

    Edited rows are set, new ones added. A row that is gone is deleted if nothing refers to it; one that other tables name
    (references: table name -> rows and the column that names the key) stays, marked inactive where `active` names a flag.
    """
    change = cut(edits(before, after, key))
    gone = change.where("change = 'delete'").select(key)
    refused = None
    for table, (rows, column) in references.items():
        own = rows.join(gone, rows[column] == gone[key], "left_semi").groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n")).withColumn("table", F.lit(table))
        refused = own if refused is None else refused.unionByName(own)
    refused = cut(refused.select(key, "table", "n")) if refused is not None else before.sparkSession.createDataFrame([], f"`{key}` {dict(before.dtypes)[key]}, table string, n long")
    kept = before.join(refused.select(key).distinct(), key, "left_semi").select(*before.columns)
    if active:
        kept = kept.withColumn(active, F.lit(False).cast(dict(before.dtypes)[active]))
    return after.select(*before.columns).unionByName(kept), refused


def cascade_purge(tables: dict[str, DataFrame], gone: DataFrame, key: str, children: dict[str, list[tuple[str, str, str]]], root: str, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All tables after the keys of gone are deleted from root and whatever refers to deleted rows goes too.

    children: table -> (child table, child's column, this table's column). Tables named in keep lose nothing, and nothing
    is followed through them.
    """
    out, todo = dict(tables), [(root, gone.select(key).distinct(), key)]
    while todo:
        table, keys, column = todo.pop()
        if table in keep:
            continue
        rows = out[table]
        lost = rows.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")
        out[table] = rows.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_anti").select(*rows.columns)
        todo += [(child, lost.select(own).distinct(), theirs) for child, theirs, own in children.get(table, [])]
    return out


def rekey(children: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """children whose key the mapping (key, new_key) names get the new one."""
    m = mapping.select(F.col(key).alias("_k"), "new_key")
    return children.join(m, F.col(key) == F.col("_k"), "left").select(*[F.coalesce("new_key", key).alias(key) if c == key else F.col(c) for c in children.columns])


def deduplicated(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
