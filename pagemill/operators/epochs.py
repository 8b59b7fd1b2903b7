"""Corpus statistics that are kept and changed by what joins and leaves, instead of being counted anew.

An epoch is a table (term, df) and a record: n, the total length, the settings' identity, and stats_id, an identity of all
of it. Chunks are immutable, so a publication that joins adds what its own chunks count, and one that is superseded
takes the same away: only the chunks of revisions that changed are read. Counts of zero drop out, so the result is
the same as a recount.

stats_id hashes n, the length, the settings and two sums over hashes of all (term, df). Sums are the same in any order, so
no list of terms is ever sorted or sent anywhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import catalog
from pagemill.operators.bm25 import counted
from pagemill.operators.snapshots import Store, Transaction
from pagemill.session import durable
from pagemill.settings import Bm25

#: The tables of a store: epochs' terms, publications and the index's points.
TERMS, PUBLICATIONS, POINTS = "terms", "publications", "points"


def changed(terms: DataFrame | None, joined: DataFrame | None, left: DataFrame | None) -> DataFrame:
    """terms (term, df, total), as the one before and the chunks (text) that join and leave make them; the sizes' row too."""
    parts = [p for p in (terms, joined and counted(joined), left and counted(left, sign=-1)) if p is not None]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter("df <> 0 OR term IS NULL")


def identity(terms: DataFrame, settings: Bm25 = Bm25()) -> dict:
    """The record of an epoch's terms (term, df, total): n, total, avgdl, bm25 and stats_id."""
    sums = [F.sum(F.when(F.col("term").isNotNull(), F.xxhash64(F.lit(salt), "term", "df").cast("decimal(38,0)"))) for salt in (1, 2)]
    size = [F.sum(F.when(F.col("term").isNull(), F.col(c))) for c in ("df", "total")]
    one, two, n, total = (int(x or 0) for x in terms.agg(*sums, *size).first())
    facts = {"n": n, "total": total, "terms": [one, two], "bm25": settings.sha()}
    stats_id = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
    return {"stats_id": stats_id, "bm25": settings.sha(), "n": n, "total": total, "avgdl": total / n if n else 0.0}


def _text(frame: DataFrame, chunks: DataFrame, few: int = 1000) -> DataFrame:
    """The texts of some revisions; the names of a few go to the scan, which skips what can't hold them."""
    wanted = frame.select("rev_id").distinct()
    names = [r[0] for r in wanted.limit(few + 1).collect()]
    if len(names) <= few:
        return chunks.filter(F.col("rev_id").isin(names)).select("text")
    return chunks.join(wanted, "rev_id", "left_semi").select("text")


def publish(store: Store, new: DataFrame, points: DataFrame, chunks: DataFrame, settings: Bm25 = Bm25(), frozen: bool = False, hook: Callable[[str], None] = lambda boundary: None) -> dict:
    """Publish new (pub_id, rev_id, doc_id) with their points; publications, points, terms and record change together.

    points (pub_id, doc_id, point_id, ...), one for each chunk; chunks (chunk_id, rev_id, text) of all revisions, of which
    only those of revisions that join or leave are counted. frozen keeps the epoch as it is, where there is one. The
    publications' other ones of the same documents are superseded, and the points of those are inactive. Returns the
    record. A retry with the same publications changes nothing.
    """
    tx: Transaction = store.begin(hook)
    durable(store.spark)
    buckets = tx.touched(new, "doc_id")
    known = tx.read(PUBLICATIONS, buckets)
    before = (known if known is not None else new.withColumn("state", F.lit("active")).limit(0)).select("pub_id", "rev_id", "doc_id", "state")
    record = tx.base["record"]
    fresh = new.select("pub_id", "rev_id", "doc_id").join(before.filter("state IN ('active', 'superseded')").select("pub_id"), "pub_id", "left_anti").checkpoint()
    if fresh.isEmpty():
        return record
    after = tx.write(PUBLICATIONS, catalog.publish(before, fresh), "doc_id", buckets)
    live = after.filter("state = 'active'")
    staged = points.join(fresh.select("pub_id"), "pub_id", "left_semi").withColumn("active", F.lit(True))
    rest = tx.read(POINTS, buckets)
    if rest is not None:
        on = live.select("pub_id", F.lit(True).alias("__on"))
        rest = rest.join(fresh.select("pub_id"), "pub_id", "left_anti").drop("active").join(on, "pub_id", "left").withColumn("active", F.coalesce("__on", F.lit(False))).drop("__on")
        staged = rest.select(*staged.columns).unionByName(staged)
    written = tx.write(POINTS, staged, "doc_id", buckets)
    wanted = chunks.join(fresh.select("rev_id", "pub_id"), "rev_id").groupBy("pub_id").agg(F.count("*").alias("wanted"))
    got = written.groupBy("pub_id").agg(F.count("*").alias("got"), F.countDistinct("point_id").alias("distinct"))
    short = fresh.join(wanted, "pub_id", "left").join(got, "pub_id", "left").fillna(0, ["wanted", "got", "distinct"]).filter("wanted <> got OR got <> distinct")
    if not short.isEmpty():
        tx.abort()
        raise ValueError("a publication has more or fewer points than chunks")
    usable = record.get("bm25") == settings.sha()
    if not (frozen and usable):
        was = before.filter("state = 'active'").select("rev_id").distinct()
        now = live.select("rev_id").distinct()
        if usable:
            terms = changed(tx.read(TERMS), _text(now.join(was, "rev_id", "left_anti"), chunks), _text(was.join(now, "rev_id", "left_anti"), chunks))
        else:  # the first epoch, or one of other settings: all active ones are counted
            others = tx.read(PUBLICATIONS)
            active = live.select("rev_id")
            if others is not None:
                active = active.union(others.filter("state = 'active'").join(live.select("doc_id"), "doc_id", "left_anti").join(fresh.select("doc_id"), "doc_id", "left_anti").select("rev_id"))
            terms = changed(None, chunks.join(active.distinct(), "rev_id", "left_semi"), None)
        record = identity(tx.write(TERMS, terms, "term"), settings)
        tx.set_record(record)
    tx.commit()
    return record


def statistics(store: Store) -> tuple[DataFrame, dict]:
    """The present epoch: (term, df), and its record with n and avgdl."""
    return store.read(TERMS).filter("term IS NOT NULL").select("term", "df"), store.record()


def visible(store: Store, chunks: DataFrame) -> DataFrame:
    """The chunks (rev_id, ...) that a search may return: those of publications active in the present snapshot."""
    return chunks.join(store.read(PUBLICATIONS).filter("state = 'active'").select("rev_id").distinct(), "rev_id", "left_semi")
