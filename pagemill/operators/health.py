"""Coverage, system checks and capacity: what the catalog's tables say together, one scan a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Frames of one row each, side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts, from what was registered to what is published; a table that isn't there counts nothing.

    tables: documents (doc_id), revisions (rev_id, is_active, sha256), archive (sha256), runs (run_id, rev_id, state),
    units (route, ocr_state), chunks (rev_id), batches (run_id), generations (rev_id, state, point_count), publications
    (doc_id, state, expected_points), points (active) or none, if the index can't be opened: then its counts are null.
    """
    t = tables
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    of = lambda c, v, key: F.countDistinct(F.when(F.col(c) == v, F.col(key)))
    archived = t["revisions"].join(t["archive"].select("sha256", F.lit(True).alias("__kept")).distinct(), "sha256", "left")
    embedded = t["batches"].select("run_id").distinct().join(t["runs"].select("run_id", "rev_id"), "run_id")
    points = t["points"].agg(F.count_if("active").alias("points_active"), F.count("*").alias("points_total")) if "points" in t else t["documents"].agg(F.lit(None).cast("long").alias("points_active"), F.lit(None).cast("long").alias("points_total"))
    return _one_row([
        t["documents"].agg(F.count("*").alias("documents")),
        archived.agg(F.count("*").alias("revisions"), F.count_if("is_active").alias("active_revisions"), F.count("__kept").alias("archived"), F.count_if(F.col("__kept").isNull()).alias("archive_missing")),
        t["runs"].agg(of("state", "succeeded", "rev_id").alias("extracted"), is_("state", "failed").alias("failed_extractions")),
        t["units"].agg(is_("route", "ocr").alias("ocr_routed"), *(is_("ocr_state", s).alias(f"ocr_{s}") for s in ("done", "pending", "failed"))),
        t["chunks"].agg(F.countDistinct("rev_id").alias("chunked")),
        embedded.agg(F.countDistinct("rev_id").alias("embedded")),
        t["generations"].agg(of("state", "ready", "rev_id").alias("indexed"), _total(F.when(F.col("state") == "ready", F.col("point_count"))).alias("indexed_points")),
        t["publications"].agg(
            is_("state", "active").alias("published"), is_("state", "staged").alias("staged"), is_("state", "superseded").alias("superseded"), of("state", "active", "doc_id").alias("published_docs"),
            _total(F.when(F.col("state") == "active", F.col("expected_points"))).alias("points_expected"),
        ),
        points,
    ])


def _links(name: str, wanted: DataFrame, found: DataFrame, keys: list[str], show: str, few: int) -> DataFrame:
    """(name, ok, checked, missing, first): references without an object, the first few by name."""
    kept = found.select(*keys).distinct().withColumn("__there", F.lit(True))
    met = wanted.join(kept, keys, "left")
    counted = met.agg(F.count("*").alias("checked"), F.count_if(F.col("__there").isNull()).alias("missing"))
    first = met.filter("__there IS NULL").select(F.col(show).cast("string").alias("one")).orderBy("one").limit(few).agg(F.array_sort(F.collect_list("one")).alias("first"))
    return counted.crossJoin(first).select(F.lit(name).alias("name"), (F.col("missing") == 0).alias("ok"), "checked", "missing", "first")


def system_checks(tables: dict[str, DataFrame], hits: DataFrame | None = None, problems: DataFrame | None = None, few: int = 5) -> DataFrame:
    """(name, ok, checked, missing, first) of each check.

    archive.links: every revision (rev_id, sha256, size) has an object (sha256, size) of its size; artifacts.links: every
    artifact (path) that units or batches name is stored (path); catalog.keys: every row of a relation (table, key, other
    table) refers to a row; index.points: as many active points as active publications expect (all is well if none are);
    search.smoke: a search gave hits without an error, however many; backup.files: a backup has no problems (path).
    """
    out = _links("archive.links", tables["revisions"].select("rev_id", "sha256", "size"), tables["archive"], ["sha256", "size"], "rev_id", few)
    out = out.unionByName(_links("artifacts.links", tables["named_artifacts"].filter("path IS NOT NULL"), tables["artifacts"], ["path"], "path", few))
    for child, key, parent in (("publications", "rev_id", "revisions"), ("chunks", "rev_id", "revisions")):
        out = out.unionByName(_links(f"catalog.keys {child}.{key}", tables[child].filter(F.col(key).isNotNull()).select(key), tables[parent], [key], key, few))
    expected = tables["publications"].agg(_total(F.when(F.col("state") == "active", F.col("expected_points"))).alias("checked"))
    active = tables["points"].agg(F.count_if("active").alias("active"))
    none = F.array().cast("array<string>").alias("first")
    out = out.unionByName(expected.crossJoin(active).select(F.lit("index.points").alias("name"), ((F.col("checked") == 0) | (F.col("checked") == F.col("active"))).alias("ok"), "checked", F.greatest(F.col("checked") - F.col("active"), F.lit(0).cast("long")).alias("missing"), none))
    if hits is not None:
        out = out.unionByName(hits.agg(F.count("*").alias("checked")).select(F.lit("search.smoke").alias("name"), F.lit(True).alias("ok"), "checked", F.lit(0).cast("long").alias("missing"), none))
    if problems is not None:
        first = problems.select("path").orderBy("path").limit(few).agg(F.array_sort(F.collect_list("path")).alias("first"))
        counted = problems.agg(F.count("*").alias("missing"))
        out = out.unionByName(counted.crossJoin(first).select(F.lit("backup.files").alias("name"), (F.col("missing") == 0).alias("ok"), F.col("missing").alias("checked"), "missing", "first"))
    return out


def migration_plan(rechunk: DataFrame, reembed: DataFrame, publications: DataFrame, storage_bytes: int | None, free_bytes: int | None) -> DataFrame:
    """One row: how much a migration makes anew, and whether the new generation fits beside the present one.

    rechunk and reembed (rev_id): revisions to be made again. The second generation takes its share of the store by
    points. fits is null where the store's size or the free space isn't known and something has to move; anything but a
    fit needs a maintenance window.
    """
    moving = rechunk.select("rev_id").union(reembed.select("rev_id")).distinct().withColumn("__moves", F.lit(True))
    active = publications.filter("state = 'active'").join(moving, "rev_id", "left")
    summed = active.agg(F.count("__moves").alias("superseded"), _total(F.when(F.col("__moves"), F.col("expected_points"))).alias("migrating_points"), _total("expected_points").alias("active_points"))
    sizes = _one_row([rechunk.agg(F.countDistinct("rev_id").alias("rechunk")), reembed.agg(F.countDistinct("rev_id").alias("reembed")), summed])
    known = storage_bytes is not None and free_bytes is not None
    storage, free = (F.lit(x).cast("decimal(38,0)") for x in (storage_bytes, free_bytes))
    second = F.floor(storage * F.col("migrating_points") / F.greatest(F.col("active_points"), F.lit(1).cast("long"))).cast("long")
    nothing = F.col("migrating_points") == 0
    second = F.when(~nothing, second) if known else F.lit(None).cast("long")
    fits = F.when(nothing, True).otherwise((storage + second <= free) if known else F.lit(None).cast("boolean"))
    return sizes.select("*", second.alias("second_generation_bytes"), fits.alias("fits"), (~F.coalesce(fits, F.lit(False))).alias("window_required"))
