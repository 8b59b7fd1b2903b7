"""Catalog operators: registration, scan differences, merges, publication snapshots, reconciliation, clean-up.

Tables are snapshots: an operator returns the new snapshot or the rows to change, and a writer swaps it in; visibility
is a join, so one swap is atomic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import ids


def condition(key: str, op: str, value) -> Column:
    """eq, ne or in over a payload column; a missing value equals null, and is in no list."""
    c = F.col(key)
    if op == "eq":
        return c.eqNullSafe(F.lit(value))
    if op == "ne":
        return ~c.eqNullSafe(F.lit(value))
    if op == "in":
        return F.coalesce(c.isin(list(value)), F.lit(False))
    raise ValueError(f"unknown condition {op}")


def all_of(conditions: list[tuple], empty_matches: bool = True) -> Column:
    """The conjunction of (key, op, value); an empty one matches all, or is refused."""
    if not conditions and not empty_matches:
        raise ValueError("an empty filter would change every point")
    out = F.lit(True)
    for c in conditions:
        out = out & condition(*c)
    return out


def under(path: Column, root: str) -> Column:
    """Below a folder; a plain prefix, so _ and % in names mean themselves."""
    return path.startswith(root.rstrip("/") + "/")


def resolve(files: DataFrame, aliases: DataFrame, revisions: DataFrame) -> DataFrame:
    """register(), and event: the path whose registration a new content rests on (its own, or that of an earlier path)."""
    known = aliases.join(revisions.select("rev_id", F.col("sha256").alias("known_sha")), "rev_id", "left").select("path", F.col("doc_id").alias("known_doc"), F.col("rev_id").alias("known_rev"), "known_sha")
    # A content's document is the first that holds it.
    by_sha = revisions.groupBy("sha256").agg(F.min(F.struct("doc_id", "rev_id")).alias("holder"))
    seen = files.join(known, "path", "left").join(by_sha, "sha256", "left")
    changed = F.col("known_doc").isNotNull() & ~F.col("known_sha").eqNullSafe(F.col("sha256"))
    fresh = F.col("known_doc").isNull() & F.col("holder").isNull()
    # Paths register in order, so what comes first with a new content, a document's new bytes or a new document, has it.
    first = seen.filter(changed | fresh).groupBy("sha256").agg(F.min(F.struct("path", "known_doc")).alias("first"))
    seen = seen.join(first, "sha256", "left")
    own = F.col("first.path").isNull() | (F.col("first.path") == F.col("path"))
    status = F.when(changed, "new_revision").when(F.col("known_doc").isNotNull(), "unchanged").when(~fresh, "alias").when(own, "new_document").otherwise("alias")
    doc = F.coalesce("known_doc", "holder.doc_id", F.when(fresh, F.col("first.known_doc")), ids.document_id(F.col("sha256")))
    rev = F.when(status == "unchanged", F.col("known_rev")).when(F.col("known_doc").isNull() & F.col("holder").isNotNull(), F.col("holder.rev_id"))
    event = F.when(changed, F.col("path")).when(fresh, F.coalesce("first.path", "path"))
    return seen.select("path", "sha256", doc.alias("doc_id"), F.coalesce(rev, ids.revision_id(doc, F.col("sha256"))).alias("rev_id"), status.alias("status"), event.alias("event"))


def register(files: DataFrame, aliases: DataFrame, revisions: DataFrame) -> DataFrame:
    """(path, sha256, doc_id, rev_id, status) of files (path, sha256), distinct paths, against the catalog.

    aliases (path, doc_id, rev_id), revisions (rev_id, doc_id, sha256). A known path with the same bytes is
    unchanged, with others a new revision; an unknown path with known bytes is an alias; of unknown bytes the first
    path by name makes the document and the others are its aliases, as they are of a new revision on an earlier path.
    """
    return resolve(files, aliases, revisions).drop("event")


def scan_diff(visible: DataFrame, state: DataFrame, max_new: int | None = None) -> DataFrame:
    """(path, outcome): visible (path, size, mtime, sha256) against the last scan (same columns).

    unchanged by size and time; new, changed or touched by content; missing if no longer visible; beyond max_new new
    or changed files, by path, deferred.
    """
    old = state.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha256").alias("old_sha"))
    both = visible.join(old, "path", "full")
    outcome = (
        F.when(F.col("size").isNull(), "missing").when(F.col("old_size").isNull(), "new")
        .when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")) & F.col("old_sha").isNotNull(), "unchanged")
        .when(F.col("sha256").eqNullSafe(F.col("old_sha")), "touched").otherwise("changed")
    )
    found = both.select("path", outcome.alias("outcome"))
    if max_new is None:
        return found
    # The budget is for the whole run: the max_new first paths are found by a limit, not by a global window.
    wanted = F.col("outcome").isin("new", "changed")
    first = found.filter(wanted).orderBy("path").limit(max_new).select("path", F.lit(True).alias("taken"))
    return found.join(first, "path", "left").select("path", F.when(wanted & F.col("taken").isNull(), "deferred").otherwise(F.col("outcome")).alias("outcome"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: rows of new replace those of old with the same keys; columns in keep hold on to an old value over null."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("__o"), F.lit(True).alias("__old"))
    n = new.select(*keys, F.struct(*rest).alias("__n"), F.lit(True).alias("__new"))
    value = lambda c: F.coalesce(f"__n.{c}", f"__o.{c}") if c in keep else F.when(F.col("__new"), F.col(f"__n.{c}")).otherwise(F.col(f"__o.{c}"))
    return o.join(n, keys, "full").select(*keys, *(value(c).alias(c) for c in rest))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks, the first by order of each key."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_runs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: every row of a run that new holds is replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points by id, those of new in place of old ones."""
    return replace_runs(points, new, "point_id")


def set_active(points: DataFrame, conditions: list[tuple], active: bool) -> DataFrame:
    return points.withColumn("active", F.when(all_of(conditions, empty_matches=False), F.lit(active)).otherwise(F.col("active")))


def delete_points(points: DataFrame, conditions: list[tuple]) -> DataFrame:
    return points.filter(~all_of(conditions, empty_matches=False))


def publish(publications: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after publishing new (pub_id, rev_id, doc_id): they are active, their documents' others superseded.

    publications: pub_id, rev_id, doc_id, state. Staged publications of the same revisions are superseded too.
    """
    docs, revs = new.select("doc_id", F.lit(True).alias("__doc")).distinct(), new.select("rev_id", F.lit(True).alias("__rev")).distinct()
    rest = publications.join(new.select("pub_id"), "pub_id", "left_anti").join(docs, "doc_id", "left").join(revs, "rev_id", "left")
    over = ((F.col("state") == "active") & F.col("__doc").isNotNull()) | ((F.col("state") == "staged") & F.col("__rev").isNotNull())
    rest = rest.select("pub_id", "rev_id", "doc_id", F.when(over, "superseded").otherwise(F.col("state")).alias("state"))
    return rest.unionByName(new.select("pub_id", "rev_id", "doc_id", F.lit("active").alias("state")))


def reconcile(staged: DataFrame, expected: DataFrame, points: DataFrame, open_jobs: DataFrame) -> DataFrame:
    """(pub_id, action) of staged publications: promote, delete or leave.

    staged (pub_id, rev_id, expected_points), expected and points (pub_id, point_id[, active]), open_jobs (rev_id).
    All points there and some active: promote; all there, none active, no job open: delete; else leave.
    """
    # Counted side by side and by key, so that no task sorts two sides of a join; the counts are those of the full join.
    e = expected.select("pub_id", "point_id", F.lit(1).alias("want"), F.lit(0).alias("got"), F.lit(None).cast("int").alias("on"))
    g = points.select("pub_id", "point_id", F.lit(0).alias("want"), F.lit(1).alias("got"), F.col("active").cast("int").alias("on"))
    keyed = e.unionAll(g).groupBy("pub_id", "point_id").agg(F.sum("want").alias("w"), F.sum("got").alias("g"), F.coalesce(F.sum("on"), F.lit(0)).alias("on"))
    met = F.col("point_id").isNotNull() & (F.col("w") > 0) & (F.col("g") > 0)
    pairs = lambda own, other: F.sum(F.when(met, F.col(own) * F.col(other)).otherwise(F.col(own)))
    compared = keyed.groupBy("pub_id").agg(pairs("w", "g").alias("wanted"), pairs("g", "w").alias("got"), F.sum(F.when(met, F.col("w") * F.col("g")).otherwise(0)).alias("both"), pairs("on", "w").alias("on"))
    seen = staged.join(compared, "pub_id", "left").join(open_jobs.select("rev_id", F.lit(True).alias("open")).distinct(), "rev_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    complete = (n("wanted") == F.col("expected_points")) & (n("got") == n("wanted")) & (n("both") == n("wanted"))
    return seen.select("pub_id", F.when(complete & (n("on") > 0), "promote").when(complete & F.col("open").isNull(), "delete").otherwise("leave").alias("action"))


def epoch_fanout(publications: DataFrame, generations: DataFrame, stats_sha: Column, embedding_sha: Column) -> DataFrame:
    """(rev_id) of active publications of the same encoding under other statistics: they are published anew."""
    other = generations.filter((F.col("stats_sha") != stats_sha) & (F.col("embedding_sha") == embedding_sha))
    return publications.filter("state = 'active'").join(other.select("gen_id"), "gen_id", "left_semi").select("rev_id").distinct()


def unreferenced(stored: DataFrame, referenced: DataFrame, key: str, now: float, grace_s: float = 600.0) -> DataFrame:
    """Stored objects (key, mtime) that nothing refers to and that are older than the grace window."""
    return stored.filter(F.col("mtime") <= now - grace_s).join(referenced.select(key).distinct(), key, "left_anti")


def missing(referenced: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """References (key) without a stored object."""
    return referenced.select(key).distinct().join(stored.select(key), key, "left_anti")


def prune_aliases(aliases: DataFrame, visible: DataFrame, mounts: DataFrame) -> DataFrame:
    """Aliases (path) below a mount (root, present) that is present, whose path is no longer visible."""
    roots = mounts.filter("present").select(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")).alias("__root"))
    below = aliases.join(F.broadcast(roots), F.col("path").startswith(F.col("__root")), "left_semi")
    return below.join(visible.select("path"), "path", "left_anti")


def drift(runs: DataFrame, parser: str, settings: str) -> DataFrame:
    """Runs (rev_id, parser, settings, state) of active revisions to be made again under the present versions."""
    good = runs.filter((F.col("parser") == parser) & (F.col("settings") == settings) & (F.col("state") == "succeeded"))
    return runs.select("rev_id").distinct().join(good.select("rev_id"), "rev_id", "left_anti")


def embedding_gaps(chunks: DataFrame, batches: DataFrame, batch: int = 8) -> DataFrame:
    """(run_id, chunks, expected, found) of runs whose batches don't cover their chunks."""
    n = chunks.groupBy("run_id").agg(F.count("*").alias("chunks"))
    b = batches.groupBy("run_id").agg(F.countDistinct("batch_index").alias("found"))
    joined = n.join(b, "run_id", "left").select("run_id", "chunks", F.ceil(F.col("chunks") / batch).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return joined.filter("expected <> found")


Relation = tuple[str, str, str, str]


def removal_order(relations: list[Relation], root: str) -> list[str]:
    """The tables that depend on root, children before their parents, by relations (child, its column, parent, its column)."""
    children: dict[str, set[str]] = {}
    for child, _, parent, _ in relations:
        children.setdefault(parent, set()).add(child)
    order: list[str] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in open_:
            raise ValueError("tables that depend on one another: " + " > ".join([*open_, name]))
        if name not in order:
            open_.append(name)
            for c in sorted(children.get(name, ())):
                visit(c)
            open_.pop()
            order.append(name)

    visit(root)
    return order


def cascade(tables: dict[str, DataFrame], relations: list[Relation], root: str, doomed: Column) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By table, in the order of removal: the rows that go with the doomed rows of root, and those that stay.

    A row goes if any row that it refers to goes. Rows are told by joins on the declared keys, parents first; no key is
    brought to the driver.
    """
    order = removal_order(relations, root)
    parted = {root: (tables[root].filter(F.coalesce(doomed, F.lit(False))), tables[root].filter(~F.coalesce(doomed, F.lit(False))))}
    for name in reversed(order[:-1]):
        rows, flags = tables[name], []
        for i, (child, column, parent, parent_column) in enumerate(relations):
            if child == name and parent in order:
                gone = parted[parent][0].select(F.col(parent_column).alias(f"__key{i}"), F.lit(True).alias(f"__gone{i}")).filter(f"__key{i} IS NOT NULL").distinct()
                rows = rows.join(gone, F.col(column) == F.col(f"__key{i}"), "left").drop(f"__key{i}")
                flags.append(f"__gone{i}")
        goes = F.coalesce(*flags, F.lit(False))
        parted[name] = (rows.filter(goes).drop(*flags), rows.filter(~goes).drop(*flags))
    return {name: parted[name] for name in order}


def removal_report(tables: dict[str, DataFrame], relations: list[Relation], root: str, doomed: Column) -> DataFrame:
    """(place, name, removed, kept, dangling) of a cascade; dangling counts kept rows that refer to a removed one."""
    parted = cascade(tables, relations, root, doomed)
    out = None
    for place, (name, (gone, kept)) in enumerate(parted.items(), 1):
        left = F.lit(0).cast("long")
        one = gone.agg(F.count("*").alias("removed")).crossJoin(kept.agg(F.count("*").alias("kept")))
        for i, (child, column, parent, parent_column) in enumerate(relations):
            if child == name and parent in parted:
                removed = parted[parent][0].select(F.col(parent_column).alias("__key")).distinct()
                one = one.crossJoin(kept.join(removed, kept[column] == removed["__key"], "left_semi").agg(F.count("*").alias(f"__left{i}")))
                left = left + F.col(f"__left{i}")
        one = one.select(F.lit(place).alias("place"), F.lit(name).alias("name"), "removed", "kept", left.alias("dangling"))
        out = one if out is None else out.unionAll(one)
    return out


def orphans(gone: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """(key) of objects that only removed rows refer to; shared ones stay."""
    return gone.select(key).distinct().join(kept.select(key), key, "left_anti")


def write_runs(frame: DataFrame, path: str, key: str) -> None:
    """Write the runs (values of key) that frame holds in place of theirs below path; all other runs' files stay as they are.

    A run's folder is replaced when the job commits, so a task that fails or a job that is tried again leaves either the
    old rows or the new ones, once.
    """
    frame.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def removal_counts(tables: dict[str, DataFrame], key: str, value) -> DataFrame:
    """(name, rows) that removing one key would delete from each table."""
    out = None
    for name, t in tables.items():
        one = t.filter(F.col(key) == value).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


def rekey(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """jobs (job_id, task_key, ...) with the task keys of wanted (job_id, task_key), but for keys that another job holds.

    Of several jobs that want one key, the first by id gets it.
    """
    first = W.partitionBy("new_key").orderBy("job_id")
    new = wanted.select("job_id", F.col("task_key").alias("new_key")).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    held = jobs.select(F.col("task_key").alias("new_key"))
    free = new.join(held, "new_key", "left_anti")
    return jobs.join(free, "job_id", "left").withColumn("task_key", F.coalesce("new_key", "task_key")).select(*jobs.columns)


def without(rows: DataFrame, other: DataFrame, key: str, publications: DataFrame) -> DataFrame:
    """(key) of rows with an active publication for which other has nothing yet."""
    live = publications.filter("state = 'active'").select(key).distinct()
    return rows.select(key).distinct().join(live, key, "left_semi").join(other.select(key), key, "left_anti")
