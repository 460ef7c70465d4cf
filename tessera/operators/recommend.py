"""Recommendations: by segment, by activity (fallback), combined, and the
per-customer homepage configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators.customers import feature_usage, top_segment
from tessera.operators.merge import dense_ranks


def segment_recommendations(user_segments: DataFrame, segments: DataFrame,
                            recommendations: DataFrame) -> DataFrame:
    """Recommendations of every segment a customer is assigned to
    (user_segments ⋈ segments ⋈ recommendations). Listing order per customer
    is (confidence desc, priority asc, id asc)."""
    seg = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("segment"))
    rec = recommendations.select(
        "segment_id", F.col("id").alias("rec_id"), F.coalesce("feature", F.lit("")).alias("feature"),
        F.coalesce("reason", F.lit("")).alias("reason"), "priority")
    us = user_segments.select(F.col("customer_id").alias("customer_pk"), "segment_id", "confidence")
    out = us.join(seg, "segment_id").join(rec, "segment_id")
    return out.select("customer_pk", "rec_id", "feature", "reason", "priority", "segment", "confidence",
                      F.lit("segment").alias("source"))


def ranked_features(user_activities: DataFrame, n: int = 5) -> DataFrame:
    """Top-``n`` features per customer by (usage desc, last use desc,
    feature asc). Usage is aggregated per (customer, feature) first; the
    ranking window then plans with a WindowGroupLimit, so only n rows per
    customer and partition cross the shuffle."""
    usage = feature_usage(user_activities)
    w = Window.partitionBy("customer_id").orderBy(F.desc("usage_count"), F.desc("last_used_at"), F.asc("feature"))
    return usage.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def activity_recommendations(user_activities: DataFrame, n: int = 5) -> DataFrame:
    r = ranked_features(user_activities, n)
    return r.select(F.col("customer_id").alias("customer_pk"), "feature",
                    F.lit(S.ACTIVITY_REASON).alias("reason"), F.col("rank").alias("priority"),
                    F.lit("activity").alias("source"), "usage_count")


def recommendations(customers: DataFrame, user_segments: DataFrame, segments: DataFrame,
                    recommendations_: DataFrame, user_activities: DataFrame, n: int = 5) -> DataFrame:
    """Segment recommendations; customers with none (no segment, or only
    segments without recommendations) get their activity ranking instead.
    Only existing customers are served."""
    c = customers.select(F.col("id").alias("customer_pk"), "customer_id")
    seg = segment_recommendations(user_segments, segments, recommendations_).join(c, "customer_pk")
    act = (activity_recommendations(user_activities, n).join(c, "customer_pk")
           .join(seg.select("customer_pk"), "customer_pk", "left_anti"))
    seg = seg.select("customer_id", "rec_id", "feature", "reason", "priority", "source", "segment",
                     F.lit(None).cast("bigint").alias("usage_count"), "confidence")
    act = act.select("customer_id", F.lit(None).cast("int").alias("rec_id"), "feature", "reason",
                     "priority", "source", F.lit(None).cast("string").alias("segment"), "usage_count",
                     F.lit(None).cast("double").alias("confidence"))
    return seg.unionByName(act)


def section_positions(recommendations_: DataFrame) -> DataFrame:
    """``segment_id``, ``position`` (1, 2, ... by priority, then id), ``rec_id``, ``feature``, ``reason``, ``priority``.

    The recommendations are ranked once over all segments, and a segment's first rank is taken off, so a
    segment that holds most of them is not sorted in one task."""
    ranks = dense_ranks(recommendations_, ["segment_id", "priority", "id"])
    first = ranks.groupBy("segment_id").agg(F.min("_rank").alias("_first"))
    named = recommendations_.select("segment_id", F.col("id").alias("rec_id"), F.coalesce("feature", F.lit("")).alias("feature"),
                                    F.coalesce("reason", F.lit("")).alias("reason"), "priority")
    placed = ranks.join(first, "segment_id").select(F.col("id").alias("rec_id"), (F.col("_rank") - F.col("_first") + 1)
                                                    .cast("bigint").alias("position"))
    return named.join(placed, "rec_id").select("segment_id", "position", "rec_id", "feature", "reason", "priority")


def personalization_sections(customers: DataFrame, user_segments: DataFrame, segments: DataFrame,
                             recommendations_: DataFrame) -> DataFrame:
    """The recommended sections of every homepage as rows: ``customer_id``, ``segment_id`` (the best assignment),
    ``position``, ``rec_id``, ``feature``, ``reason``, ``priority``. No row holds a list."""
    top = top_segment(user_segments, segments, join_first=True).select(F.col("customer_id").alias("id"), "segment_id")
    mine = customers.select("id", "customer_id").join(top, "id").select("customer_id", "segment_id")
    return mine.join(section_positions(recommendations_), "segment_id").select(
        "customer_id", "segment_id", "position", "rec_id", "feature", "reason", "priority")


def personalization(customers: DataFrame, user_segments: DataFrame, segments: DataFrame,
                    recommendations_: DataFrame, user_activities: DataFrame, n: int = 5,
                    listed: int | None = None) -> DataFrame:
    """Homepage configuration of every customer, flattened.

    quick actions: the customer's top-``n`` features (comma-joined, ranked);
    segment: the best assignment among existing segments; recommended
    sections: that segment's recommendations by (priority, id);
    primary_feature: the first non-empty quick action, else the first
    recommended feature, else ''. The per-customer lists hold at most ``n``
    items. ``recommended_features`` lists a segment's recommendations, the first ``listed`` of them if that is given
    (``recommended_count`` counts all); :func:`personalization_sections` has each as a row.
    """
    shown = recommendations_
    if listed is not None:
        few = section_positions(recommendations_).filter(F.col("position") <= max(listed, 1)).select(F.col("rec_id").alias("id"))
        shown = recommendations_.join(few, "id", "left_semi")
    top = top_segment(user_segments, segments, join_first=True).select(
        F.col("customer_id").alias("customer_pk"), "segment_id", "segment_name",
        F.col("confidence").alias("segment_confidence"))
    qa = (ranked_features(user_activities, n)
          .groupBy(F.col("customer_id").alias("customer_pk"))
          .agg(F.count(F.lit(1)).alias("quick_action_count"),
               F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("qa")))
    qa = qa.select("customer_pk", "quick_action_count",
                   F.transform("qa", lambda x: x["feature"]).alias("qa_features"))
    qa = qa.select("customer_pk", "quick_action_count",
                   F.concat_ws(",", "qa_features").alias("quick_actions"),
                   F.try_element_at(F.filter("qa_features", lambda f: f != ""), F.lit(1)).alias("first_action"))
    rec = (shown
           .groupBy("segment_id")
           .agg(F.count(F.lit(1)).alias("recommended_count"),
                F.array_sort(F.collect_list(F.struct("priority", "id", F.coalesce("feature", F.lit("")).alias("f"))))
                .alias("recs")))
    rec = rec.select("segment_id", "recommended_count",
                     F.concat_ws(",", F.transform("recs", lambda x: x["f"])).alias("recommended_features"),
                     F.try_element_at(F.transform("recs", lambda x: x["f"]), F.lit(1)).alias("first_rec"))
    if listed is not None:
        counts = recommendations_.groupBy("segment_id").agg(F.count(F.lit(1)).alias("recommended_count"))
        rec = rec.drop("recommended_count").join(counts, "segment_id")
        if listed < 1:
            rec = rec.withColumn("recommended_features", F.lit(""))
    c = customers.select(F.col("id").alias("customer_pk"), "customer_id")
    out = (c.join(top, "customer_pk", "left").join(qa, "customer_pk", "left")
           .join(rec, "segment_id", "left"))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "customer_id",
        F.coalesce("first_action", "first_rec", F.lit("")).alias("primary_feature"),
        "segment_id", "segment_name", "segment_confidence",
        F.coalesce("quick_action_count", zero).alias("quick_action_count"),
        F.coalesce("quick_actions", F.lit("")).alias("quick_actions"),
        F.coalesce("recommended_count", zero).alias("recommended_count"),
        F.coalesce("recommended_features", F.lit("")).alias("recommended_features"),
    )


def personalization_nested(customers: DataFrame, user_segments: DataFrame, segments: DataFrame,
                           recommendations_: DataFrame, user_activities: DataFrame, n: int = 5) -> DataFrame:
    """The homepage object of every customer as nested columns
    (``to_json`` / ``write.json`` give the API shape). Lists are bounded: at
    most ``n`` quick actions, and one segment's rows of the small
    recommendations table."""
    top = top_segment(user_segments, segments, join_first=True).select(
        F.col("customer_id").alias("customer_pk"), "segment_id",
        F.struct(F.col("segment_id").alias("id"), F.col("segment_name").alias("name"), "confidence").alias("segment"))
    qa = (ranked_features(user_activities, n)
          .groupBy(F.col("customer_id").alias("customer_pk"))
          .agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "usage_count",
                                                    F.col("last_used_at"))).alias("qa")).alias("qa")))
    qa = qa.select("customer_pk", F.transform("qa", lambda x: x.dropFields("rank")).alias("quick_actions"))
    rec = (recommendations_.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct(
        "priority", "id", F.coalesce("feature", F.lit("")).alias("feature"),
        F.coalesce("reason", F.lit("")).alias("reason")))).alias("recs")))
    rec = rec.select("segment_id", F.transform("recs", lambda x: F.struct(
        x["id"].alias("id"), x["feature"].alias("feature"), x["reason"].alias("reason"),
        x["priority"].alias("priority"))).alias("recommended_sections"))
    flat = personalization(customers, user_segments, segments, recommendations_, user_activities, n)
    c = customers.select(F.col("id").alias("customer_pk"), "customer_id")
    out = (c.join(top, "customer_pk", "left").join(qa, "customer_pk", "left").join(rec, "segment_id", "left")
           .join(flat.select("customer_id", "primary_feature"), "customer_id"))
    empty = F.array()
    return out.select("customer_id", F.struct(
        "primary_feature",
        F.coalesce("segment", F.struct(F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("name"),
                                       F.lit(None).cast("double").alias("confidence"))).alias("segment"),
        F.coalesce("quick_actions", empty.cast(qa.schema["quick_actions"].dataType)).alias("quick_actions"),
        F.coalesce("recommended_sections", empty.cast(rec.schema["recommended_sections"].dataType))
        .alias("recommended_sections")).alias("homepage"))
