"""Upserts, reanalysis, upload outcomes, reviews, status and purge as table transforms.

Every function returns new DataFrames; ``sources.store`` writes them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .aggregates import accumulate_reports
from .joins import new_documents
from .sets import soft_delete_missing
from .windows import keep_first, reuse_target


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed merge: incoming values replace, created_at is kept, repeats change nothing.

    Rows of one key are ordered by updated_at and seq, as far as the tables have them, and last by their content as
    JSON, which any column can be written as; the last row wins. A union and one map-side combined aggregation, so
    retries and duplicate keys inside ``incoming`` are harmless.
    """
    rest = [c for c in current.columns if c not in (*keys, "created_at")]
    both = (current.withColumn("__new", F.lit(0))
            .unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True))
    stated = [c for c in ("updated_at", "seq") if c in rest]
    order = F.struct("__new", *stated, F.to_json(F.struct(*rest)).alias("content") if rest else F.lit(""))
    kept = [F.min("created_at").alias("created_at")] if "created_at" in current.columns else []
    merged = both.groupBy(*keys).agg(F.max_by(F.struct("__new", *rest), order).alias("__r"), *kept)
    return merged.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest],
                         *(["created_at"] if kept else [])).select(*current.columns)


def reanalyze(tables: dict[str, DataFrame], result: dict[str, DataFrame], complete: DataFrame) -> dict[str, DataFrame]:
    """Replace the findings of reports with a new run.

    tables/result: relationships and mentions keyed by (report_id, id), sightings
    (case_id, id, report_id), entities (case_id, id, …, active).  ``complete`` is
    (report_id, status): only reports whose run is complete change.  Superseded
    edges and mentions stay, inactive; an entity without reports is deactivated.
    """
    done = complete.filter(F.col("status") == "complete").select("report_id")
    out = {}
    for name in ("relationships", "mentions"):
        fresh = result[name].join(done, "report_id", "left_semi")
        touched = tables[name].join(done, "report_id", "left_semi")
        untouched = tables[name].join(done, "report_id", "left_anti")
        retired = soft_delete_missing(touched, fresh, ["report_id", "id"])
        out[name] = untouched.unionByName(upsert(retired, fresh.withColumn("active", F.lit(True)),
                                                 ["report_id", "id"]))
    fresh_seen = result["sightings"].join(done, "report_id", "left_semi")
    kept_seen = tables["sightings"].join(done, "report_id", "left_anti")
    out["sightings"] = accumulate_reports(kept_seen, fresh_seen)
    known = upsert(tables["entities"], result["entities"].join(
        fresh_seen, ["case_id", "id"], "left_semi"), ["case_id", "id"])
    was_seen = tables["sightings"].select("case_id", "id").distinct().withColumn("__was", F.lit(True))
    seen = out["sightings"].select("case_id", "id").distinct().withColumn("__seen", F.lit(True))
    out["entities"] = (known.join(was_seen, ["case_id", "id"], "left").join(seen, ["case_id", "id"], "left")
                       .withColumn("active", F.when(F.col("__seen"), F.lit(True))
                                   .when(F.col("__was"), F.lit(False)).otherwise(F.col("active")))
                       .drop("__was", "__seen"))
    return out


def classify_upload(incoming: DataFrame, docs: DataFrame, version: str) -> DataFrame:
    """Outcome of each upload: new, reuse, reanalyze or conflict, with the stored document it meets."""
    stored = reuse_target(docs).select("case_id", "sha256", F.col("document_id").alias("stored_id"),
                                       F.col("report_id").alias("stored_report"), "processing_status",
                                       "extraction_version")
    done = (F.col("processing_status") == "completed") & F.col("stored_report").isNotNull()
    outcome = (F.when(F.col("stored_id").isNull(), "new").when(~done, "conflict")
               .when(F.col("extraction_version").eqNullSafe(F.lit(version)), "reuse").otherwise("reanalyze"))
    return (incoming.join(stored, ["case_id", "sha256"], "left").withColumn("outcome", outcome)
            .drop("processing_status", "extraction_version", "stored_report"))


def first_of_batch(incoming: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Uploads that become documents: not stored yet, and the first with their bytes in this batch."""
    return keep_first(new_documents(incoming, known), ["case_id", "sha256"], [F.col(order)])


def apply_reviews(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Set each edge's latest review status. An edge is named by case, report and id where reviews name the report:
    row ids repeat over the documents of a case."""
    keys = ["case_id", "report_id", "id"] if "report_id" in reviews.columns else ["case_id", "id"]
    latest = (reviews.filter(F.col("review_status").isin("accepted", "rejected", "pending"))
              .groupBy(*keys).agg(F.max_by("review_status", F.struct("updated_at", "review_status")).alias("__s")))
    return (edges.join(latest, keys, "left")
            .withColumn("review_status", F.coalesce("__s", "review_status")).drop("__s"))


def latest_status(log: DataFrame) -> DataFrame:
    """Current status per document from an append-only log."""
    return log.groupBy("case_id", "document_id").agg(
        F.max_by("status", "position").alias("status"), F.max("position").alias("position"))


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures of a batch; a failure never stops the rest."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return results.filter(~failed), results.filter(failed)


def append_queue(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append selections; a file already queued (name, size, modified, type) is skipped and
    the first source type of a repeated selection is kept.  ``position`` orders selections."""
    key = ["name", "size", "last_modified", "content_type"]
    fresh = keep_first(incoming.join(queue, key, "left_anti"), key, [F.col("position")])
    return queue.unionByName(fresh, allowMissingColumns=True)


CASE_TABLES = ("documents", "entities", "mentions", "relationships", "reports")
#: Tables that a case may have besides; they go with it.
SIDE_TABLES = ("sightings", "files")


def purge_blockers(tables: dict[str, DataFrame], case_id) -> DataFrame:
    """Reasons a purge must not start: documents still processing, or a stored file whose
    recorded owner is another case."""
    docs = tables["documents"].filter(F.col("case_id") == case_id)
    busy = docs.filter(F.col("processing_status").isin(*V.BUSY_STATUSES)).select(
        "document_id", F.lit("busy").alias("reason"))
    if "files" not in tables:
        return busy
    files = tables["files"].select(F.col("document_id"), F.col("case_id").alias("owner"))
    foreign = docs.join(files, "document_id").filter(F.col("owner") != case_id).select(
        "document_id", F.lit("ownership mismatch").alias("reason"))
    return busy.unionByName(foreign)


def purge_case(tables: dict[str, DataFrame], case_id, drop_case: bool = False):
    """(remaining tables, removed counts per table).  Callers check ``purge_blockers`` first.

    The case row stays unless ``drop_case`` says otherwise; a case that is known by its documents only gets one.
    """
    mine = F.col("case_id").eqNullSafe(F.lit(case_id))
    names = [n for n in (*CASE_TABLES, *SIDE_TABLES) if n in CASE_TABLES or n in tables]
    remaining = {name: tables[name].filter(~mine) for name in names}
    if "cases" in tables:
        this = F.col("id") == case_id
        others = tables["cases"].filter(~this)
        if drop_case:
            remaining["cases"] = others
        else:
            discovered = tables["documents"].filter(mine).agg(F.count("*").alias("n")).filter("n > 0").select(
                F.lit(case_id).cast(tables["cases"].schema["id"].dataType).alias("id"))
            known = tables["cases"].filter(this)
            remaining["cases"] = others.unionByName(known).unionByName(
                discovered.join(known.select("id"), "id", "left_anti"), allowMissingColumns=True)
    removed = reduce(lambda a, b: a.unionByName(b), [
        tables[name].filter(mine).agg(F.count("*").alias("removed")).select(
            F.lit(name).alias("table_name"), "removed") for name in names])
    return remaining, removed
