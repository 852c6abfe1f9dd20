"""An observing archive: calibration masters for lights, observation groups, the registry of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions import expr
from skylattice.operators.neighbours import nearest_offers
from skylattice.operators.shared import cut, numbered
from skylattice.operators.spatial import nearest_of, sky_pairs


def best_masters(lights: DataFrame, library: DataFrame, *, tolerance: float = 0.5, prefer_unbinned: bool = True, now: Column | None = None, validity_days: float | None = None) -> DataFrame:
    """lights with the calibration master for each: master, dt, expired; NULL where the library has none.

    lights: light_id, kind (dark or flat), xbinning, exptime, gain, filter_name, ccd_temp, id_equipments, id_telescope.
    library: path, kind, xbinning, exptime, gain, filter_name, ccd_temp, id_equipments, id_telescope, modified.

    Kind, exposure and gain are equal (no gain counts as 0), a flat's filter too, a dark's is empty. Temperatures differ by
    `tolerance` at most, or the master has none. A light that names its equipment and telescope takes masters of that pair
    or of neither. For binned lights an unbinned master comes before one of the same binning; then the nearest temperature,
    then the newest file. With validity_days, what is fresh at `now` comes before what has expired or has no date.
    """
    light = lights.select(*lights.columns, F.when(F.col("kind") == "dark", "").otherwise(F.trim(F.coalesce("filter_name", F.lit("")))).alias("_filter"))
    own = library.select(
        F.col("path").alias("master"), F.lower("kind").alias("_kind"), F.col("xbinning").alias("_bin"), F.col("exptime").alias("_exp"), F.coalesce("gain", F.lit(0)).alias("_gain"),
        F.when(F.lower("kind") == "dark", F.coalesce("filter_name", F.lit(""))).otherwise(F.col("filter_name")).alias("_flt"), F.col("ccd_temp").alias("_temp"), F.col("id_equipments").alias("_eq"), F.col("id_telescope").alias("_tel"), F.col("modified").alias("_modified"),
    )
    # lights that ask for the same have the same answer; what is equal in a pair becomes a key, what is tried in turn a row
    what = ["kind", "exptime", "gain", "_filter", "xbinning", "id_equipments", "id_telescope", "ccd_temp"]
    asks = light.select(*what).distinct()
    scoped = F.col("id_equipments").isNotNull() & F.col("id_telescope").isNotNull()
    scope = lambda how, e, t: F.struct(F.lit(how).alias("how"), e.alias("e"), t.alias("t"))
    none = F.lit(None)
    bins = F.when(F.lit(prefer_unbinned) & (F.col("xbinning") > 1), F.array(F.col("xbinning"), F.lit(1).cast(dict(lights.dtypes)["xbinning"]))).otherwise(F.array("xbinning"))
    tried = asks.withColumn("_scope", F.explode(F.when(scoped, F.array(scope("pair", F.col("id_equipments").cast("string"), F.col("id_telescope").cast("string")), scope("none", none.cast("string"), none.cast("string")))).otherwise(F.array(scope("any", none.cast("string"), none.cast("string"))))))
    tried = tried.withColumn("_bin", F.explode(bins)).withColumn("_expired", F.explode(F.array(F.lit(False), F.lit(True))))
    tried = tried.select("*", F.lower("kind").alias("_kind"), F.col("exptime").alias("_exp"), F.coalesce("gain", F.lit(0)).alias("_gain"), F.col("_filter").alias("_flt"), F.col("ccd_temp").alias("_temp"))
    expired = F.coalesce(expr.age_days(now, F.col("_modified")) > validity_days, F.lit(True)) if validity_days is not None and now is not None else F.lit(False)
    wide = F.array_compact(F.array(
        scope("any", none.cast("string"), none.cast("string")), F.when(F.col("_eq").isNull() & F.col("_tel").isNull(), scope("none", none.cast("string"), none.cast("string"))),
        F.when(F.col("_eq").isNotNull() & F.col("_tel").isNotNull(), scope("pair", F.col("_eq").cast("string"), F.col("_tel").cast("string"))),
    ))
    keys = ["_kind", "_exp", "_gain", "_flt", "_bin", "_scope", "_expired"]
    own = own.withColumn("_expired", expired).withColumn("_scope", F.explode(wide))
    first = F.min(F.struct((-F.col("_modified").cast("timestamp").cast("double")).alias("m"), F.col("master").alias("p"))).alias("_file")
    own = own.groupBy(*keys, "_temp").agg(first)
    near = nearest_offers(tried, own.where("_temp is not null"), keys, "_temp", "_file", tolerance)
    near = near.select(*what, "_bin", "_expired", F.explode("_offers").alias("_o")).select(*what, "_bin", "_expired", F.abs(F.col("_o._temp") - F.col("ccd_temp")).alias("dt"), F.col("_o._file").alias("_file")).where(F.col("dt") <= tolerance)
    plain = own.where("_temp is null").select(*[F.col(k).alias(f"{k}_o") for k in keys], "_file")
    met = tried.join(plain, [*[F.col(k) == F.col(f"{k}_o") for k in keys if k != "_scope"], F.col("_scope").eqNullSafe(F.col("_scope_o"))])
    met = near.unionByName(met.select(*what, "_bin", "_expired", F.lit(None).cast("double").alias("dt"), "_file"))
    met = met.where("_bin is not null and kind is not null and exptime is not null and _filter is not null")  # nulls equal nothing
    unbinned = F.lit(prefer_unbinned) & (F.col("xbinning") > 1) & (F.col("_bin") == 1)
    rank = F.struct(F.col("_expired").alias("e"), (~unbinned).alias("u"), F.coalesce("dt", F.lit(1e9)).alias("d"), F.col("_file.m").alias("m"), F.col("_file.p").alias("p"))
    best = met.groupBy(*what).agg(F.min_by(F.struct(F.col("_file.p").alias("master"), "dt", F.col("_expired").alias("expired")), rank).alias("_best"))
    best = best.select(*[F.col(c).alias(f"_{c}_b") for c in what], "_best")
    told = light.join(best, [F.col(c).eqNullSafe(F.col(f"_{c}_b")) for c in what], "left")
    return told.select(*lights.columns, "_best.master", "_best.dt", "_best.expired")


def library_tags(library: DataFrame, equipment: DataFrame, telescopes: DataFrame) -> DataFrame:
    """path and tag of each master: the names of its equipment and telescope, or that it serves all."""
    e, t = equipment.select(F.col("id").alias("id_equipments"), F.col("name").alias("_e")), telescopes.select(F.col("id").alias("id_telescope"), F.col("name").alias("_t"))
    named = library.join(e, "id_equipments", "left").join(t, "id_telescope", "left")
    return named.select("path", F.when(F.col("id_equipments").isNull() & F.col("id_telescope").isNull(), "all").otherwise(F.concat_ws(" / ", "_e", "_t")).alias("tag"))


def observation_groups(lights: DataFrame) -> DataFrame:
    """One row for each filter, exposure and binning of lights (path, filter_name, exptime, binning, gain, ccd_temp): its
    key, the first light by path with what it says, and all paths in order."""
    key = expr.group_key(F.col("filter_name"), F.col("exptime"), F.col("binning"))
    name = F.split_part(F.col("group_key"), F.lit("|"), F.lit(1))
    return lights.withColumn("group_key", key).groupBy("group_key").agg(
        F.min("path").alias("representative"), F.min_by(F.greatest(F.lit(1), F.coalesce("binning", F.lit(1))), "path").alias("binning"), F.min_by(F.coalesce("exptime", F.lit(0.0)), "path").alias("exptime"),
        F.min_by("gain", "path").alias("gain"), F.min_by("ccd_temp", "path").alias("ccd_temp"), F.array_sort(F.collect_list("path")).alias("paths"),
    ).withColumn("filter_name", name)


def masters_by_filter(groups: DataFrame) -> DataFrame:
    """filter_name and the first master, in the order of group keys, of groups (group_key, filter_name, master)."""
    return groups.groupBy("filter_name").agg(F.expr("min_by(master, group_key) filter (where master is not null)").alias("master"))


def flat_fallbacks(groups: DataFrame) -> DataFrame:
    """For each group without a flat (group_key, filter_name, exptime, binning, master): the groups of another filter, of
    the same binning and exposure, that have one, in order."""
    missing = groups.where("master is null").select("group_key", "filter_name", "exptime", "binning")
    other = groups.where("master is not null").select(F.col("group_key").alias("_k"), F.col("filter_name").alias("_f"), F.col("exptime").alias("_e"), "binning")
    met = missing.join(other, "binning").where((F.abs(F.col("exptime") - F.col("_e")) <= 1e-6) & (F.col("filter_name") != F.col("_f")))
    found = met.groupBy("group_key").agg(F.array_sort(F.collect_list("_k")).alias("alternatives"))
    return missing.select("group_key").join(found, "group_key", "left").select("group_key", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"))


def register_fields(registry: DataFrame, observations: DataFrame, *, radius_deg: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The registry after observations, in the order of their ids, and the field of each observation.

    registry: id, ra_deg, dec_deg, object_name, first_observation, last_observation, n_observations. observations:
    observation_id, ra_deg, dec_deg, object_name. An observation belongs to the nearest field nearer than radius_deg that
    is there when it comes; without one it becomes a field. Counters add up; the name is the last one given.

    Which observations become fields is settled in rounds: an observation without an earlier undecided one nearby is
    decided, as a field unless an earlier field is near it.
    """
    known = registry.select(F.col("id"), "ra_deg", "dec_deg")
    seen = observations.select("observation_id", "ra_deg", "dec_deg")
    near_known = nearest_of(seen, known, "observation_id", "id", radius_deg, inside=F.col("distance") < radius_deg)
    open_ = cut(seen.join(near_known, "observation_id", "left_anti"))
    links = cut(sky_pairs(open_, open_, radius_deg).where((F.col("distance") < radius_deg) & (F.col("r_observation_id") < F.col("l_observation_id"))).select(F.col("l_observation_id").alias("later"), F.col("r_observation_id").alias("earlier")))
    centres, todo = None, open_.select("observation_id")
    while True:
        waiting = links.join(todo.withColumnRenamed("observation_id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("observation_id"))
        new = cut(todo.join(waiting, "observation_id", "left_anti"))
        if new.isEmpty():
            break
        centres = new if centres is None else centres.unionByName(new)
        taken = links.join(new.withColumnRenamed("observation_id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("observation_id"))
        todo = cut(todo.join(new, "observation_id", "left_anti").join(taken, "observation_id", "left_anti"))
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    if centres is None:
        centres = open_.select("observation_id").limit(0)
    made = numbered(centres, "_nth", ["observation_id"]).crossJoin(F.broadcast(top)).select("observation_id", (F.col("_top") + F.col("_nth")).cast("long").alias("id"))
    made = cut(made.join(seen, "observation_id"))
    # new fields are radius_deg apart, so few are near an observation; of the known ones only the nearest counts
    pairs = sky_pairs(seen, made.withColumnRenamed("observation_id", "since"), radius_deg).where((F.col("distance") < radius_deg) & (F.col("r_since") <= F.col("l_observation_id")))
    offers = pairs.select(F.col("l_observation_id").alias("observation_id"), (F.col("r_since") != F.col("l_observation_id")).alias("new"), "distance", F.col("r_id").alias("id"))
    offers = offers.unionByName(near_known.select("observation_id", F.lit(True).alias("new"), "distance", F.col("id").cast("long").alias("id")))
    field = cut(offers.groupBy("observation_id").agg(F.min_by("id", F.struct("new", "distance", "id")).alias("field_id")))
    told = observations.join(field, "observation_id").groupBy("field_id").agg(
        F.count("*").alias("_n"), F.min("observation_id").alias("_first"), F.max("observation_id").alias("_last"), F.expr("max_by(object_name, observation_id) filter (where object_name is not null)").alias("_name")
    )
    every = registry.select("id", "ra_deg", "dec_deg", "object_name", "first_observation", "last_observation", "n_observations").unionByName(
        made.select("id", "ra_deg", "dec_deg", F.lit(None).cast("string").alias("object_name"), F.lit(None).cast("long").alias("first_observation"), F.lit(None).cast("long").alias("last_observation"), F.lit(0).cast("long").alias("n_observations"))
    )
    after = every.join(told, every["id"] == told["field_id"], "left").select(
        "id", "ra_deg", "dec_deg", F.coalesce("_name", "object_name").alias("object_name"), F.coalesce("first_observation", "_first").alias("first_observation"), F.coalesce("_last", "last_observation").alias("last_observation"),
        (F.col("n_observations") + F.coalesce("_n", F.lit(0))).alias("n_observations"),
    )
    return after, field


def resolved_files(files: DataFrame) -> DataFrame:
    """files (path, …) once for each path that means the same: without "." and "..", case and doubled slashes ignored."""
    plain = F.regexp_replace(F.regexp_replace("path", r"/(\./)+", "/"), r"/{2,}", "/")
    step = F.regexp_replace(plain, r"/[^/]+/\.\./", "/")
    key = F.lower(F.regexp_replace(step, r"/[^/]+/\.\./", "/"))
    return files.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("path"))).where("_r = 1").drop("_key", "_r")


def frame_kind(imagetyp: Column, light_names: tuple[str, ...] = ("light", "light frame", "lights", "object", "science")) -> Column:
    """What a header's image type says: dark and flat by part of the name, light by name or part, else unknown."""
    t = F.lower(F.trim(F.coalesce(imagetyp, F.lit(""))))
    return F.when(t.contains("dark"), "dark").when(t.contains("flat"), "flat").when(t.isin(*light_names) | t.contains("light"), "light").otherwise("unknown")


def lights_to_use(files: DataFrame, scope: DataFrame | None = None, *, key: str = "path") -> DataFrame:
    """Light frames that aren't rejected; with a scope, only its paths, or all where the scope has no rows."""
    t = files.where((F.lower(F.coalesce("imagetyp", F.lit(""))) == "light") & (F.coalesce("is_rejected", F.lit(0)) == 0))
    if scope is None:
        return t
    size = scope.agg(F.count("*").alias("_n"))
    marked = t.join(scope.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").crossJoin(F.broadcast(size))
    return marked.where(F.col("_in") | (F.col("_n") == 0)).select(*t.columns)
