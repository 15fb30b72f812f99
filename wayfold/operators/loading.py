"""Loading the fixes of many files for fusion, and what became of each file."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.aggregates import top_reason
from wayfold.operators.sequences import best_row, micros, table_rank
from wayfold.operators.thinning import places_apart, thin_all
from wayfold.sources.shared import saved

# How far hints and times reach beyond the window, and what is between two fixes at least.
PADDING_H, APART_S, APART_M = 24.0, 15.0, 10.0
# End of fixed values.


def loaded_fixes(files: DataFrame, rows: DataFrame, window: tuple[datetime, datetime] | None = None, hint_filter: bool = True, padding_h: float = PADDING_H) -> tuple[DataFrame, DataFrame]:
    """The fixes that are loaded, numbered by time (fix_id from 0), and a report with a row for each file.

    ``files`` has source_file, source_name, context_match (whether its name's hints fit the window) and error (why it can't
    be read, or null); ``rows`` has source_file, pos, ts, lat and lon, whatever can be read of them, and what else is to be
    kept.  A file goes through these states in order: left out by its hints (unless no file's hints fit: then all are
    taken), unreadable, without any place (times alone count if they are in the window), outside the window, loaded,
    and at last dropped, if none of its fixes outlives the removal of equal and of close ones over all files.
    """
    any_match = files.agg(F.coalesce(F.max("context_match"), F.lit(False)).alias("__any"))
    fallback = ~F.col("__any") if hint_filter else F.lit(True)
    f = files.join(F.broadcast(any_match))  # one row
    f = f.withColumn("context_match", F.coalesce("context_match", F.lit(False))).withColumn("__fallback", fallback).withColumn("selected_for_loading", F.col("context_match") | F.col("__fallback"))
    inside = F.lit(True)
    if window is not None:
        pad = timedelta(hours=padding_h)
        inside = F.col("ts").between(F.lit(window[0] - pad), F.lit(window[1] + pad))
    timed, placed = F.col("ts").isNotNull(), F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    counts = rows.groupBy("source_file").agg(
        F.count_if(placed).alias("__placed"), F.count_if(timed).alias("__timed"), F.count_if(placed & inside).alias("__placed_in"), F.count_if(timed & inside).alias("__timed_in"))
    readable = f.where("selected_for_loading AND error IS NULL").select("source_file", "source_name")
    found = best_row(rows.where(placed & inside).join(readable, "source_file"), ["ts", "lat", "lon", "source_name"], ["source_file", "pos"])
    found = found.withColumn("__t", micros(F.col("ts")))
    others = [c for c in found.columns if c not in ("__t", "source_file", "pos", "lat", "lon")]
    thin = thin_all(found, "__t", ["source_file", "pos"], ["lat", "lon"], places_apart(APART_M), APART_S * 1e6, others)
    fixes = table_rank(thin, ["__t", "source_file", "pos"], "fix_id").withColumn("fix_id", F.col("fix_id").cast("long") - 1).drop("__n", "__t")
    fixes = saved(fixes, "fixes")
    loaded = fixes.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_loaded"))
    r = f.join(counts, "source_file", "left").join(loaded, "source_file", "left")
    r = r.fillna(0, ["__placed", "__timed", "__placed_in", "__timed_in", "rows_loaded"])
    tried = F.col("selected_for_loading") & F.col("error").isNull()
    bare, only_times = F.col("__placed") == 0, F.col("__timed_in") > 0
    reason = (F.when(~F.col("selected_for_loading"), "excluded_by_filename_time_hints").when(F.col("error").isNotNull(), "parse_error")
              .when(bare & only_times, "loaded_time_only_no_valid_gps_points").when(bare, "no_valid_timestamp_or_latlon_rows")
              .when(F.col("__placed_in") == 0, "outside_google_time_window").when(F.col("rows_loaded") == 0, "dropped_during_global_deduplication")
              .when(F.col("__fallback") & ~F.col("context_match"), "loaded_via_context_fallback").otherwise("loaded_for_fusion"))
    status = F.when(F.startswith("reason", F.lit("loaded")), "loaded_for_fusion").otherwise("sorted_out")
    report = r.withColumn("reason", reason).select(
        "source_file", "source_name", "context_match", "selected_for_loading", status.alias("status"), "reason", F.when(F.col("selected_for_loading"), F.col("error")).alias("detail"),
        F.when(tried, F.col("__placed")).otherwise(0).cast("long").alias("rows_parsed"), F.when(tried, F.when(bare, F.col("__timed_in")).otherwise(F.col("__placed_in"))).otherwise(0).cast("long").alias("rows_after_time_window"), "rows_loaded")
    return fixes, report


def file_audit(report: DataFrame, fixes: DataFrame, require_accepted: bool = False) -> DataFrame:
    """The report of :func:`loaded_fixes` with what became of each file's fixes, and its final status.

    ``fixes`` has source_file, status and reason of every fix that was held against a trip (see ``fusion.judged_fixes``).  If
    accepted fixes are required, a loaded file without any is sorted out, and told why.
    """
    judged = fixes.where(F.col("source_file").isNotNull()).select("source_file", (F.coalesce("status", F.lit("")) == "accepted").alias("__used"), "reason")
    stats = top_reason(judged, ["source_file"], "__used", "reason")
    out = report.join(stats, "source_file", "left").fillna(0, ["considered", "accepted", "rejected"]).withColumn("top_rejection_reason", F.coalesce("top_reason", F.lit("")))
    loaded = F.col("status") == "loaded_for_fusion"
    status, reason = F.when(loaded, "processed").otherwise("sorted_out"), F.when(loaded, "loaded_for_fusion_used_for_route_interpolation").otherwise(F.col("reason"))
    if require_accepted:
        told = F.when(F.col("top_rejection_reason") == "", "unknown").otherwise(F.col("top_rejection_reason"))
        status = F.when(loaded & (F.col("accepted") > 0), "processed").otherwise("sorted_out")
        reason = (F.when(~loaded, F.col("reason")).when(F.col("considered") == 0, "no_fix_rows_reached_segment_evaluation")
                  .when(F.col("accepted") == 0, F.concat(F.lit("all_fixes_rejected::"), told)).otherwise("accepted_fixes_used_in_fusion"))
    return out.select(
        *report.columns, F.col("considered").cast("long").alias("fixes_considered_n"), F.col("accepted").cast("long").alias("accepted_fixes_n"), F.col("rejected").cast("long").alias("rejected_fixes_n"),
        "top_rejection_reason", status.alias("final_status"), reason.alias("final_reason"))
