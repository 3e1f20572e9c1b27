"""Queries of format routes, selections and batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.operators import aggregates, sets
from loomgate.plans import registry, routing
from loomgate.plans.q_text import _case
from loomgate.plans.tables import table

_EXTS = ["json", "csv", "xlsx", "md", "srt", "png"]


def _files(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    named = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("f."), ext).alias("name"))
    return registry.identified(named)


def allowed_targets(spark, d):
    return _files(spark, d).join(F.broadcast(registry.routes(spark)), ["kind", "ext"]).select("doc_id", "ext", "target", "place")


def common_targets(spark, d):
    """Of each kind the targets that all its files have."""
    return sets.common_values(_files(spark, d).join(F.broadcast(registry.routes(spark)), ["kind", "ext"]), "doc_id", "target", ["kind"])


def targets_except_self(spark, d):
    listed = F.array(*map(F.lit, registry.WRITES["data"].split()))
    return _files(spark, d).where("kind = 'data'").select("doc_id", F.array_join(F.array_except(listed, F.array("ext")), " ").alias("targets"), F.array_contains(listed, F.col("ext")).alias("writes_own"))


def batch_status_counts(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "done").otherwise("pending")
    return sets.status_counts(table(spark, d, "events").withColumn("status", status), ["user_id"], "status", ["failed", "done", "pending"])


def selection_state(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(aggregates.tri_state(F.col("event_type") == "click").alias("state"))


def route_table(spark, d):
    return registry.routes(spark)


_FAR = ["srt", "mobi", "csv", "sqlite", "docx", "zip", "png"]


def route_plans(spark, d):
    """The way of each document, by its extension, to Markdown, a workbook and a WebVTT file, where there is one."""
    ext = F.element_at(F.array(*map(F.lit, _FAR)), (F.col("doc_id") % len(_FAR) + 1).cast("int"))
    plans = routing.shortest(routing.edges(spark)).where(F.col("target").isin("md", "xlsx", "vtt"))
    files = table(spark, d, "documents").select("doc_id", ext.alias("source"))
    return files.join(F.broadcast(plans), "source").select("doc_id", "source", "target", F.array_join("stages", " ").alias("stages"), F.size("stages").alias("n"))


QUERIES = {f.__name__: f for f in (allowed_targets, common_targets, targets_except_self, batch_status_counts, selection_state, route_table, route_plans)}

_ROUTES = "(VALUES " + ", ".join(f"('{k}', '{e}', '{t}', {i})" for k, e in sorted({(k, registry.canonical(e)) for e, k in registry.KIND.items()}) for i, t in enumerate(registry.targets(k, e))) + ") r(kind, ext, target, place)"
_FILES = f"(SELECT doc_id, ext, {_case({e: registry.KIND[e] for e in _EXTS}, 'ext', 'NULL')} AS kind FROM (SELECT doc_id, [{', '.join(repr(e) for e in _EXTS)}][doc_id % {len(_EXTS)} + 1] AS ext FROM documents))"
_EDGES = "(VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in routing.edge_list()) + ") e(source, target)"
SQL = {
    "route_plans": f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), walk AS (SELECT source, target, [target] AS path FROM e WHERE source <> target
        UNION ALL SELECT w.source, e.target, list_append(w.path, e.target) FROM walk w JOIN e ON e.source = w.target WHERE len(w.path) < 4 AND e.target <> w.source AND NOT list_contains(w.path, e.target)),
        best AS (SELECT source, target, min({{'n': len(path), 'rank': list_transform(path, lambda x: CASE x WHEN 'html' THEN 0 WHEN 'json' THEN 1 WHEN 'csv' THEN 2 ELSE 3 END), 'path': path}}) AS b FROM walk WHERE target IN ('md', 'xlsx', 'vtt') GROUP BY source, target),
        f AS (SELECT doc_id, {_FAR}[doc_id % {len(_FAR)} + 1] AS source FROM documents)
        SELECT doc_id, source, target, array_to_string(b.path, ' ') AS stages, b.n::INT AS n FROM f JOIN best USING (source)""",
    "allowed_targets": f"SELECT doc_id, ext, target, place FROM {_FILES} f JOIN {_ROUTES} USING (kind, ext)",
    "common_targets": f"WITH f AS (SELECT * FROM {_FILES}), n AS (SELECT kind, count(*) AS n FROM f GROUP BY kind) SELECT kind, target FROM f JOIN {_ROUTES} USING (kind, ext) JOIN n USING (kind) GROUP BY kind, target, n.n HAVING count(DISTINCT doc_id) = n.n",
    "targets_except_self": f"SELECT doc_id, array_to_string(list_filter(string_split('{registry.WRITES['data']}', ' '), lambda t: t <> ext), ' ') AS targets, list_contains(string_split('{registry.WRITES['data']}', ' '), ext) AS writes_own FROM {_FILES} WHERE kind = 'data'",
    "batch_status_counts": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS n_failed, count(*) FILTER (event_type <> 'error' AND value > 50) AS n_done, count(*) FILTER (event_type <> 'error' AND NOT value > 50) AS n_pending FROM events GROUP BY user_id",
    "selection_state": "SELECT user_id, CASE WHEN bool_and(event_type = 'click') THEN 'all' WHEN NOT bool_or(event_type = 'click') THEN 'none' ELSE 'some' END AS state FROM events GROUP BY user_id",
    "route_table": f"SELECT * FROM {_ROUTES}",
}
