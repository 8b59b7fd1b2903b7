"""Cited evidence: locations of passages in their sources, anchors, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paragraph_bounds(paragraphs: DataFrame, gap: int = 2) -> DataFrame:
    """(unit_id, anchor, start, end) of paragraphs (unit_id, position, anchor, text) laid end to end with a gap."""
    before = W.partitionBy("unit_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0))
    return paragraphs.select("unit_id", "anchor", start.alias("start"), (start + F.length("text")).alias("end"))


def anchors(offsets: DataFrame, paragraphs: DataFrame, gap: int = 2) -> DataFrame:
    """offsets (unit_id, offset, ...) with the anchor of the paragraph that holds each; none in a gap.

    A range join inside an equal unit: Spark shuffles on the unit and never compares two units' rows.
    """
    b = paragraph_bounds(paragraphs, gap).withColumnRenamed("unit_id", "__unit")
    met = (F.col("unit_id") == F.col("__unit")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    return offsets.join(b, met, "left").drop("__unit", "start", "end")


def overlaps(left: DataFrame, right: DataFrame, by: str, width: int = 512) -> DataFrame:
    """Pairs of left (by, start, end, ...) and right (by, r_start, r_end, ...) whose half-open intervals overlap.

    An interval is entered in every bin of that width that it touches, and rows meet in an equi-join on by and the bin, so a
    unit with many intervals on both sides is split; a pair that shares several bins is kept in the first of them.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(a) + 1, F.col(b)) - 1) / width)))
    one = left.withColumn("__bin", bins("start", "end"))
    other = right.withColumnRenamed(by, "__by").withColumn("__other", bins("r_start", "r_end"))
    first = F.col("__bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    met = (F.col(by) == F.col("__by")) & (F.col("__bin") == F.col("__other")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & first
    return one.join(other, met).drop("__bin", "__other", "__by")


def span_boxes(spans: DataFrame, words: DataFrame, width: int = 512) -> DataFrame:
    """spans (unit_id, start, end, ...) with bbox [x0, y0, x1, y1] around the words (unit_id, r_start, r_end, box) they overlap.

    box is [x, y, w, h]; a span without words has none.
    """
    keys = spans.columns
    at = lambda i: F.col("box")[i]
    united = overlaps(spans, words, "unit_id", width).groupBy(*keys).agg(F.min(at(0)).alias("x0"), F.min(at(1)).alias("y0"), F.max(at(0) + at(2)).alias("x1"), F.max(at(1) + at(3)).alias("y1"))
    found = united.select(*(F.col(k).alias(f"__{k}") for k in keys), F.array("x0", "y0", "x1", "y1").alias("bbox"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return spans.join(found, same, "left").select(*keys, "bbox")


def resolve_anchor(paragraphs: Column, anchor: Column) -> Column:
    """The text of an anchor in a unit's paragraphs, null if there is none."""
    return F.try_element_at(F.filter(paragraphs, lambda p: p["anchor"] == anchor), F.lit(1))["text"]


def manifest(passages: DataFrame, units: DataFrame, revisions: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence_id, chunk_id, title, kind, pages, labels, flags, offset, unit_id, boxes, anchor, section) of selected passages.

    passages (query_id, place, chunk_id, rev_id, spans array<struct<unit_id, source_start[, bbox]>>), units (unit_id, kind,
    position, ref, flags[, section]), revisions (rev_id, title), paragraphs (unit_id, position, anchor, text) of sections.
    The first known unit decides the kind; pages count from one; flags are the sorted union over a passage's units; boxes
    are those of spans that have one, with their pages (none in sections). A section's anchor is that of the paragraph at
    the first span's begin; section is its title.
    """
    kind_of = passages.schema["spans"].dataType.elementType
    bbox = F.col("span.bbox") if "bbox" in kind_of.names else F.lit(None).cast("array<double>")
    section = F.col("section") if "section" in units.columns else F.lit(None).cast("string")
    spans = passages.select("query_id", "place", F.posexplode_outer("spans").alias("at", "span")).select("query_id", "place", "at", "span.unit_id", "span.source_start", bbox.cast("array<double>").alias("bbox"))
    known = spans.join(units.withColumn("section", section), "unit_id")
    item = F.struct("at", "kind", "position", "ref", "unit_id", "source_start", "bbox", "section")
    found = known.groupBy("query_id", "place").agg(F.array_sort(F.collect_list(item)).alias("u"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"))
    kind = F.coalesce(F.col("u")[0]["kind"], F.lit("unknown"))
    page = lambda x: F.when(x["kind"] == "page", x["position"] + 1)
    pages = F.when(kind == "page", F.array_distinct(F.transform("u", lambda x: x["position"] + 1)))
    boxed = F.transform(F.filter("u", lambda x: F.size(x["bbox"]) == 4), lambda x: F.struct(x["unit_id"].alias("unit_id"), page(x).alias("page"), x["bbox"].alias("bbox")))
    out = passages.select("query_id", "place", "chunk_id", "rev_id").join(found, ["query_id", "place"], "left").join(revisions, "rev_id", "left")
    out = out.select(
        "query_id", F.concat(F.lit("E"), F.col("place").cast("string")).alias("evidence_id"), "chunk_id", "title", kind.alias("kind"), pages.alias("pages"),
        F.transform("u", lambda x: x["ref"]).alias("labels"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.col("u")[0]["source_start"].alias("offset"), F.col("u")[0]["unit_id"].alias("unit_id"),
        F.coalesce(boxed, F.array().cast(boxed_type(units))).alias("boxes"), F.when(kind == "section", F.col("u")[0]["section"]).alias("section"),
    )
    if paragraphs is None:
        return out.withColumn("anchor", F.lit(None).cast("string"))
    return anchors(out.withColumn("offset", F.col("offset").cast("long")), paragraphs).withColumn("anchor", F.when((F.col("kind") == "section") & (F.col("anchor") != ""), F.col("anchor")))


def boxed_type(units: DataFrame) -> str:
    return f"array<struct<unit_id: {units.schema['unit_id'].dataType.simpleString()}, page: {units.schema['position'].dataType.simpleString()}, bbox: array<double>>>"


def prompt(evidence: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, prompt): evidence blocks in order, one labelled paragraph each."""
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    label = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.coalesce(F.col("title"), F.lit("untitled")), F.lit("\n"), F.col(text))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), label.alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))


def resolve(citations: DataFrame, evidence: DataFrame, revisions: DataFrame) -> DataFrame:
    """Citations (query_id, evidence_id) with their frozen evidence, and whether its revision still is active."""
    live = revisions.select("rev_id", F.col("is_active").alias("live"))
    return citations.join(evidence, ["query_id", "evidence_id"], "left").join(live, "rev_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
