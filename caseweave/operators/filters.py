"""Row predicates.  All are plain expressions, so they reach the Parquet scan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY_TYPE = "All"


def active_in_case(df: DataFrame, case_id=None) -> DataFrame:
    """Rows of one case (all cases when None); a missing flag counts as active."""
    live = df.filter(F.coalesce(F.col("active"), F.lit(True)))
    return live if case_id is None else live.filter(F.col("case_id") == case_id)


def min_confidence(edges: DataFrame, threshold: float) -> DataFrame:
    """NULL and 0 confidence count as 1.0; a threshold of 0 filters nothing."""
    if threshold <= 0:
        return edges
    return edges.filter(F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) >= threshold)


def layer(edges: DataFrame, name: str | None) -> DataFrame:
    return edges if not name else edges.filter((F.col("method") == name) | (F.col("type") == name))


def time_range(edges: DataFrame, start: str | None = None, end: str | None = None,
               column: str = "timestamp") -> DataFrame:
    """Inclusive string comparison; rows without a timestamp pass."""
    ts = F.col(column)
    missing = ts.isNull() | (ts == "")
    if start:
        edges = edges.filter(missing | (ts >= start))
    if end:
        edges = edges.filter(missing | (ts <= end))
    return edges


def time_range_typed(edges: DataFrame, start: str | None = None, end: str | None = None,
                     column: str = "timestamp") -> DataFrame:
    """As time_range, comparing parsed timestamps; unparseable values pass."""
    ts = F.try_to_timestamp(F.col(column))
    if start:
        edges = edges.filter(ts.isNull() | (ts >= F.lit(start).cast("timestamp")))
    if end:
        edges = edges.filter(ts.isNull() | (ts <= F.lit(end).cast("timestamp")))
    return edges


def endpoints(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys, id) of both edge ends."""
    ends = F.explode(F.array("source", "target")).alias("id")
    return edges.select(*keys, ends).distinct()


def _contains(column: str, query: str) -> Column:
    return F.lower(F.col(column)).contains(query.lower())


def _visible(nodes, edges, matches: Column, connected_only: bool, kind: str):
    keys = [c for c in ("case_id",) if c in nodes.columns and c in edges.columns]
    kept = nodes.filter(matches)
    if kind not in (ANY_TYPE, "All Entities"):
        kept = kept.filter(F.col("type") == kind)
    if connected_only:
        kept = kept.join(endpoints(edges, *keys), [*keys, "id"], "left_semi")
    ids = kept.select(*keys, "id")
    shown = edges
    for end in ("source", "target"):
        shown = shown.join(ids.withColumnRenamed("id", end), [*keys, end], "left_semi")
    hidden = nodes.agg(F.count("*").alias("n_all")).crossJoin(kept.agg(F.count("*").alias("n_kept")))
    return kept, shown, hidden.select((F.col("n_all") - F.col("n_kept")).alias("hidden_count"))


def visible_graph(nodes: DataFrame, edges: DataFrame, connected_only=False, search="", kind=ANY_TYPE):
    """Label search and type filter; edges keep both visible ends; hidden count (one row)."""
    return _visible(nodes, edges, _contains_or_id(search), connected_only, kind)


def _contains_or_id(search: str) -> Column:
    return F.lower(F.coalesce(F.col("label"), F.col("id"))).contains(search.lower())


def visible_graph_any(nodes: DataFrame, edges: DataFrame, search="", kind=ANY_TYPE, show_isolated=True):
    """Search over label or type, with a toggle for isolated nodes."""
    return _visible(nodes, edges, _contains("label", search) | _contains("type", search),
                    not show_isolated, kind)


def search_reference(nodes: DataFrame, edges: DataFrame, search="", kind=ANY_TYPE):
    """Search over label or id."""
    return _visible(nodes, edges, _contains("label", search) | _contains("id", search), False, kind)


def term_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label or type contains any query word longer than two characters."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    hit = F.lit(False)
    for term in terms:
        hit = hit | _contains("label", term) | _contains("type", term)
    return nodes.filter(hit)


def admit_edges(edges: DataFrame) -> DataFrame:
    """Both ends present and different."""
    s, t = F.col("source"), F.col("target")
    return edges.filter((s != "") & (t != "") & (s != t))


def search_cases(cases: DataFrame, query: str) -> DataFrame:
    return cases.filter(F.lower(F.concat_ws(" ", "title", "id")).contains(query.lower()))


def leads_by_severity(leads: DataFrame, severity: str) -> DataFrame:
    return leads.filter(F.lower("severity") == severity.lower())


def unhandled(units: DataFrame, handled: DataFrame) -> DataFrame:
    """Units that no structured mapper consumed."""
    return units.join(handled, ["doc_id", "unit_index"], "left_anti")


def pending(files: DataFrame) -> DataFrame:
    no_error = F.coalesce(F.col("validation_error"), F.lit("")) == ""
    return files.filter(no_error & F.col("status").isin("queued", "failed"))


def split_calls(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows; NULL verdicts are quarantined."""
    verdict = F.coalesce(valid, F.lit(False))
    return rows.filter(verdict), rows.filter(~verdict)
