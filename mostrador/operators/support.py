"""Support conversations and phone calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as tx
from ..functions.dates import day, in_range, maybe_range, ts_literal
from ..functions.exprs import count_where, exact_avg, js_round, micros, pct0, safe_div
from .joins import identified


def support_kpis(conversations: DataFrame, d0=None, d1=None) -> DataFrame:
    """Conversations, resolved ones, mean rating (1 decimal, 0 without ratings), resolved share."""
    return (
        maybe_range(conversations, "created_at", d0, d1)
        .agg(
            F.count("session_id").alias("total_conversations"),
            count_where(F.col("status") == "resolved").alias("resolved_conversations"),
            F.coalesce(js_round(F.avg("rating_value"), 1), F.lit(0.0)).alias("avg_csat"),
        )
        .withColumn("resolution_rate", pct0("resolved_conversations", "total_conversations"))
    )


def reply_sla(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """First user message, first operator message at or after it, and the whole minutes between.

    Two aggregates instead of a window per session, so a hot session is pre-summed in every
    map task. The operator is the greatest name among the replies. A table without comments on ratings gives null ones.
    """
    if "rating_comment" not in conversations.columns:
        conversations = conversations.withColumn("rating_comment", F.lit(None).cast("string"))
    asked = messages.where("sender_type = 'user'").groupBy("session_id").agg(F.min("created_at").alias("first_user_msg_at"))
    replies = messages.where("sender_type = 'operator'").groupBy("session_id", "created_at").agg(
        F.max("operator_name").alias("operator_name")
    )
    answered = (
        replies.join(asked, "session_id")
        .where(F.col("created_at") >= F.col("first_user_msg_at"))
        .groupBy("session_id")
        .agg(F.min("created_at").alias("first_operator_msg_at"), F.max("operator_name").alias("operator_name"))
    )
    return (
        conversations.join(asked, "session_id", "left")
        .join(answered, "session_id", "left")
        .select(
            "session_id", F.col("created_at").alias("ticket_created_at"), "status",
            F.col("rating_value").alias("csat_score"), "rating_comment",
            "first_user_msg_at", "first_operator_msg_at", "operator_name",
            F.timestamp_diff("MINUTE", F.col("first_user_msg_at"), F.col("first_operator_msg_at")).alias("ttfr_minutes"),
        )
    )


def agent_stats(sla: DataFrame, d0=None, d1=None) -> DataFrame:
    return (
        maybe_range(sla.where(F.col("operator_name").isNotNull()), "ticket_created_at", d0, d1)
        .groupBy("operator_name")
        .agg(
            F.count("session_id").alias("total_tickets"),
            count_where(F.col("status") == "resolved").alias("resolved_tickets"),
            F.avg("ttfr_minutes").alias("avg_ttfr"), F.avg("csat_score").alias("avg_csat"),
        )
        .withColumn("resolved_pct", pct0("resolved_tickets", "total_tickets"))
        .orderBy(F.desc("total_tickets"), "operator_name")
    )


def _by_hour(df: DataFrame, hour, name: str) -> DataFrame:
    """Counts for the hours 0 to 23, zero where there are none."""
    spark = df.sparkSession
    counts = df.groupBy(hour.cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias(name))
    return spark.range(24).withColumnRenamed("id", "hour").join(counts, "hour", "left").fillna(0, subset=[name])


def peak_hours(conversations: DataFrame, d0=None, d1=None) -> DataFrame:
    return _by_hour(maybe_range(conversations, "created_at", d0, d1), F.hour("created_at"), "total_tickets")


def effort(messages: DataFrame, conversations: DataFrame, d0=None, d1=None) -> DataFrame:
    """Messages per ticket, 1 decimal, 0 without tickets."""
    kept = maybe_range(conversations, "created_at", d0, d1).groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    per_session = messages.groupBy("session_id").agg(F.count("message_id").alias("messages"))
    return per_session.join(kept, "session_id").agg(
        F.coalesce(
            js_round(safe_div(F.sum(F.col("messages") * F.col("_n")), F.count("session_id")), 1), F.lit(0.0)
        ).alias("avg_messages")
    )


def resolution_daily(conversations: DataFrame, d0=None, d1=None) -> DataFrame:
    """Resolved, unresolved (a null status is neither) and all conversations per day."""
    return maybe_range(conversations, "created_at", d0, d1).groupBy(day("created_at").alias("date")).agg(
        count_where(F.col("status") == "resolved").alias("resolved_count"),
        count_where(F.col("status") != "resolved").alias("unresolved_count"),
        F.count("session_id").alias("total_count"),
    )


NEUTRAL = 0.2


def sentiment_daily(messages: DataFrame, d0=None, d1=None) -> DataFrame:
    """Mean score and messages per band, of scored user messages."""
    score = F.col("sentiment_score")
    scored = messages.where((F.col("sender_type") == "user") & score.isNotNull())
    return maybe_range(scored, "created_at", d0, d1).groupBy(day("created_at").alias("date")).agg(
        exact_avg("sentiment_score").alias("avg_score"),
        count_where(score < -NEUTRAL).alias("negative_tickets"),
        count_where(score.between(-NEUTRAL, NEUTRAL)).alias("neutral_tickets"),
        count_where(score > NEUTRAL).alias("positive_tickets"),
    )


def omnichannel_duplicates(conversations: DataFrame, hours: int = 72) -> DataFrame:
    """Visitors who wrote on several channels within ``hours`` whole hours, one row each.

    The report is defined over pairs (a, b) of one identity on different channels with
    a.session_id < b.session_id: first contact is the earliest start of an "a", last contact
    the latest start of a "b". It only asks, for each conversation, whether a partner with a
    greater and one with a smaller id exists nearby, so no pairs are formed. Time is cut into
    blocks as wide as the window; the window of a conversation is its own block, the start of
    the next and the end of the previous one, and running extremes inside a block answer
    each part. Work is linear, and a hot identity is split by block.
    """
    width = (hours + 1) * 3_600_000_000
    rows = identified(conversations).withColumn("_at", micros("created_at")).withColumn(
        "_block", F.floor(F.col("_at") / width)
    )
    # Only identities on two or more channels matter; their channels are a short list.
    channels = (
        rows.groupBy("identity_key").agg(F.collect_set("channel_origin").alias("_channels"))
        .where(F.size("_channels") > 1)
    )
    rows = rows.join(channels, "identity_key")
    payload = F.struct("session_id", "created_at", "channel_origin", "people_id", "visitor_nickname", "visitor_email")

    def entry(target: Column, block: Column, at: Column, kind: int, offer: Column, row: Column) -> Column:
        names = ("target", "block", "at", "kind", "offer", "row")
        return F.struct(*[c.alias(n) for c, n in zip((target, block, at, F.lit(kind), offer, row), names)])

    # A conversation offers its id to probes of every other channel of its visitor.
    others = F.filter("_channels", lambda c: c != F.col("channel_origin"))
    nobody = F.when(F.lit(False), payload)
    offers = F.transform(others, lambda c: entry(c, F.col("_block"), F.col("_at"), 9, F.col("session_id"), nobody))
    # kind 1: start of the next block, before at + width; 2: end of the previous; 10: own block.
    probes = F.array(*[
        entry(F.col("channel_origin"), F.col("_block") + step, F.col("_at") + step * width, kind, F.lit(None).cast("string"), payload)
        for kind, step in ((1, 1), (2, -1), (10, 0))
    ])
    # The rows arrive clustered by visitor; without this shuffle by block the windows would
    # accept that and keep a hot visitor in one task.
    entries = (
        rows.select("identity_key", F.explode(F.concat(offers, probes)).alias("e")).select("identity_key", "e.*")
        .repartition("identity_key", "target", "block")
    )
    part = Window.partitionBy("identity_key", "target", "block")
    # Next and previous are strict, so those probes sort before the offers (kind 9) of the same
    # time; the probe of the own block sorts after them, so that equal times count.
    up = part.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        entries.withColumn("_up_max", F.max("offer").over(up)).withColumn("_up_min", F.min("offer").over(up))
        .withColumn("_down_max", F.max("offer").over(down)).withColumn("_down_min", F.min("offer").over(down))
        .where("kind <> 9")
    )
    hi = F.when(F.col("kind") == 1, F.col("_up_max")).when(F.col("kind") == 2, F.col("_down_max")).otherwise(
        F.greatest("_up_max", "_down_max"))
    lo = F.when(F.col("kind") == 1, F.col("_up_min")).when(F.col("kind") == 2, F.col("_down_min")).otherwise(
        F.least("_up_min", "_down_min"))
    is_a, is_b = F.col("_hi") > F.col("row.session_id"), F.col("_lo") < F.col("row.session_id")
    found = seen.withColumn("_hi", hi).withColumn("_lo", lo).where(is_a | is_b)
    start = F.col("row.created_at")
    return found.groupBy("identity_key").agg(
        F.min(F.when(is_a, F.col("row.people_id"))).alias("people_id"),
        F.min(F.when(is_a, F.col("row.visitor_nickname"))).alias("visitor_nickname"),
        F.min(F.when(is_a, F.col("row.visitor_email"))).alias("visitor_email"),
        F.sort_array(F.collect_set("row.channel_origin")).alias("channels_used"),
        F.min(F.when(is_a, start)).alias("first_contact"),
        F.max(F.when(is_b, start)).alias("last_contact"),
        F.max(F.struct("row.created_at", "row.session_id"))["session_id"].alias("latest_session_id"),
    ).withColumn("distinct_channels", F.size("channels_used").cast("bigint"))


def _within(dups: DataFrame, d0, d1) -> DataFrame:
    if not (d0 and d1):
        return dups
    return dups.where((F.col("first_contact") >= ts_literal(d0)) & (F.col("last_contact") <= ts_literal(d1)))


def duplicity_kpi(conversations: DataFrame, dups: DataFrame, d0=None, d1=None) -> DataFrame:
    """Identified users, those on several channels, and their share in percent (null on none)."""
    users = maybe_range(conversations, "created_at", d0, d1).where(F.col("channel_origin").isNotNull()).agg(
        F.count_distinct(tx.identity_key("people_id", "visitor_email", "visitor_phone"))
    ).scalar()
    return (
        _within(dups, d0, d1).agg(F.count(F.lit(1)).alias("duplicated_users"))
        .withColumn("total_identified_users", users)
        .withColumn("duplicity_rate_pct", safe_div("duplicated_users", "total_identified_users") * 100)
    )


def duplicity_top(dups: DataFrame, d0=None, d1=None, k: int = 50) -> DataFrame:
    return (
        _within(dups, d0, d1)
        .orderBy(F.desc("distinct_channels"), F.desc("last_contact"), "identity_key").limit(k)
        .select("people_id", "visitor_nickname", "visitor_email", "channels_used", "distinct_channels",
                "first_contact", "last_contact", "latest_session_id")
    )


def source_audit(conversations: DataFrame, t) -> DataFrame:
    """Rows by state, and of each how many changed since ``t`` and the oldest start."""
    changed = (F.col("created_at") >= ts_literal(t)) | (F.col("updated_at") >= ts_literal(t))
    return conversations.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), count_where(changed).alias("since"), F.min("created_at").alias("oldest")
    )


# --- calls ----------------------------------------------------------------------------

ANSWERED, MISSED = "Call connected", "Missed"
NO_AGENT = "Sin asignar"


def dedupe_calls(calls: DataFrame) -> DataFrame:
    """One row per call session: the first extension in list order, then record order."""
    order = [F.asc_nulls_first("extension_id"), F.col("seq")] if "ext_pos" not in calls.columns else [F.col("ext_pos"), F.col("seq")]
    return skew.top_per_key(calls, ["session_id"], order, 1).drop("rn")


def _call_measures():
    done = F.col("result") == ANSWERED
    return [
        F.count(F.lit(1)).alias("total"),
        count_where(done).alias("answered"),
        count_where(F.col("result") == MISSED).alias("missed"),
        F.sum(F.when(done, F.coalesce("duration", F.lit(0))).otherwise(F.lit(0))).alias("_seconds"),
    ]


def _call_rates(df: DataFrame) -> DataFrame:
    mean = F.when(F.col("answered") > 0, F.col("_seconds") / F.col("answered") / 60).otherwise(F.lit(0.0))
    return (
        df.withColumn("answer_rate", js_round(pct0("answered", "total")))
        .withColumn("avg_duration_min", js_round(mean, 1))
        .drop("_seconds")
    )


def call_kpis(calls: DataFrame) -> DataFrame:
    """Measures over de-duplicated calls."""
    return _call_rates(calls.agg(
        count_where(F.col("direction") == "Inbound").alias("inbound"),
        count_where(F.col("direction") == "Outbound").alias("outbound"), *_call_measures(),
    ))


def call_agents(calls: DataFrame) -> DataFrame:
    """Measures per extension, most calls first."""
    per = calls.groupBy("extension_id").agg(
        F.coalesce(F.min("extension_name"), F.lit(NO_AGENT)).alias("name"), *_call_measures()
    )
    return _call_rates(per).orderBy(F.desc("total"), F.asc_nulls_first("extension_id"))


def call_hours(calls: DataFrame, zone: str = "UTC") -> DataFrame:
    """Calls per hour of the day in ``zone``; times are stored in UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("start_time"))
    return _by_hour(calls, F.hour(local), "calls")


def call_daily(calls: DataFrame) -> DataFrame:
    return (
        calls.where(F.col("start_time").isNotNull()).groupBy(day("start_time").alias("date"))
        .agg(*_call_measures()).drop("_seconds")
    )


def calls_in_range(calls: DataFrame, d0, d1) -> DataFrame:
    return in_range(calls, "start_time", d0, d1)
