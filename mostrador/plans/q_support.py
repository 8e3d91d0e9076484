"""Support conversations and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, support
from .registry import count_if, js, pct0, query, safe

S0, S1 = "2023-12-01", "2024-02-28"
IN = f"created_at >= TIMESTAMP '{S0}' AND created_at <= TIMESTAMP '{S1}'"
IDENTITY = "COALESCE(people_id, 'email:' || NULLIF(NULLIF(visitor_email, ''), 'user@example.com'), 'phone:' || NULLIF(visitor_phone, ''))"
IDENT = f"ident AS (SELECT *, {IDENTITY} AS identity_key FROM crisp_conversations WHERE channel_origin IS NOT NULL)"
NEAR = "a.identity_key = b.identity_key AND a.channel_origin <> b.channel_origin AND abs(datesub('hour', a.created_at, b.created_at)) <= 72"
PAIRS = f"""SELECT a.identity_key, a.session_id AS session_a, b.session_id AS session_b, a.channel_origin AS channel_a, b.channel_origin AS channel_b,
  a.created_at AS created_at_a, b.created_at AS created_at_b, a.visitor_nickname, a.visitor_email, a.people_id
FROM ident a JOIN ident b ON {NEAR} WHERE a.session_id < b.session_id"""
# Each conversation with a partner nearby: is it the smaller (a) or the greater (b) id of some pair?
DUPS = f"""{IDENT}, near AS (SELECT a.session_id, bool_or(a.session_id < b.session_id) AS is_a, bool_or(a.session_id > b.session_id) AS is_b FROM ident a JOIN ident b ON {NEAR} GROUP BY 1),
dups AS (SELECT identity_key, MIN(people_id) FILTER (WHERE is_a) AS people_id, MIN(visitor_nickname) FILTER (WHERE is_a) AS visitor_nickname, MIN(visitor_email) FILTER (WHERE is_a) AS visitor_email,
  string_agg(DISTINCT channel_origin, ',' ORDER BY channel_origin) AS channels_used, COUNT(DISTINCT channel_origin) AS distinct_channels, MIN(created_at) FILTER (WHERE is_a) AS first_contact,
  MAX(created_at) FILTER (WHERE is_b) AS last_contact, max_by(session_id, concat(CAST(epoch_us(created_at) AS VARCHAR), session_id)) AS latest_session_id
 FROM ident JOIN near USING (session_id) GROUP BY identity_key)"""


def _flat(df):
    return df.withColumn("channels_used", F.array_join("channels_used", ","))


@query("sup_01_support_kpis", f"""
SELECT COUNT(session_id) AS total_conversations, {count_if("status = 'resolved'")} AS resolved_conversations, COALESCE({js('AVG(rating_value)', 1)}, 0e0) AS avg_csat,
  {pct0(count_if("status = 'resolved'"), 'COUNT(session_id)')} AS resolution_rate FROM crisp_conversations WHERE {IN}""")
def _(t):
    return support.support_kpis(t.crisp_conversations, S0, S1)


SLA = """WITH asked AS (SELECT *, MIN(CASE WHEN sender_type = 'user' THEN created_at END) OVER (PARTITION BY session_id) AS first_at FROM crisp_messages),
replied AS (SELECT session_id, MIN(first_at) AS first_user_msg_at, MIN(created_at) FILTER (WHERE sender_type = 'operator' AND created_at >= first_at) AS first_operator_msg_at,
  MAX(operator_name) FILTER (WHERE sender_type = 'operator' AND created_at >= first_at) AS operator_name FROM asked GROUP BY 1),
sla AS (SELECT session_id, c.created_at AS ticket_created_at, status, rating_value AS csat_score, first_user_msg_at, first_operator_msg_at, operator_name,
  datesub('minute', first_user_msg_at, first_operator_msg_at) AS ttfr_minutes FROM crisp_conversations c LEFT JOIN replied USING (session_id))"""


@query("sup_02_reply_sla", f"""{SLA} SELECT *, CASE WHEN csat_score <= 3 THEN concat('slow: ', session_id) END AS rating_comment FROM sla""",
       ["ticket_created_at", "first_user_msg_at", "first_operator_msg_at"])
def _(t):
    comment = F.when(F.col("rating_value") <= 3, F.concat(F.lit("slow: "), "session_id"))
    return support.reply_sla(t.crisp_conversations.withColumn("rating_comment", comment), t.crisp_messages)


@query("sup_03_agent_stats", f"""{SLA} SELECT operator_name, COUNT(session_id) AS total_tickets, {count_if("status = 'resolved'")} AS resolved_tickets,
  AVG(ttfr_minutes) AS avg_ttfr, AVG(csat_score) AS avg_csat, {pct0(count_if("status = 'resolved'"), 'COUNT(session_id)')} AS resolved_pct
FROM sla WHERE operator_name IS NOT NULL AND ticket_{IN.replace('AND created_at', 'AND ticket_created_at')} GROUP BY 1""")
def _(t):
    return support.agent_stats(support.reply_sla(t.crisp_conversations, t.crisp_messages), S0, S1)


def hours_sql(source, column, name):
    return f"""SELECT h.hour, COALESCE(n, 0) AS {name} FROM (SELECT unnest(range(24)) AS hour) h
LEFT JOIN (SELECT extract('hour' FROM {column}) AS hour, COUNT(*) AS n FROM {source} GROUP BY 1) c ON h.hour = c.hour"""


@query("sup_04_peak_hours", hours_sql("crisp_conversations", "created_at", "total_tickets"))
def _(t):
    return support.peak_hours(t.crisp_conversations, S0, S1)


@query("sup_05_effort", f"""SELECT {js(safe('COUNT(m.message_id)', 'COUNT(DISTINCT m.session_id)'), 1)} AS avg_messages
FROM crisp_messages m JOIN crisp_conversations c ON m.session_id = c.session_id""")
def _(t):
    return support.effort(t.crisp_messages, t.crisp_conversations, S0, S1)


@query("sup_06_resolution_daily", f"""
SELECT CAST(created_at AS DATE) AS date, {count_if("status = 'resolved'")} AS resolved_count, {count_if("status <> 'resolved'")} AS unresolved_count,
  COUNT(session_id) AS total_count FROM crisp_conversations GROUP BY 1""", ["date"])
def _(t):
    return support.resolution_daily(t.crisp_conversations, S0, S1)


@query("sup_07_sentiment_daily", f"""
SELECT CAST(created_at AS DATE) AS date, round(AVG(sentiment_score), 9) AS avg_score, {count_if('sentiment_score < -0.2e0')} AS negative_tickets,
  {count_if('sentiment_score >= -0.2e0 AND sentiment_score <= 0.2e0')} AS neutral_tickets, {count_if('sentiment_score > 0.2e0')} AS positive_tickets
FROM crisp_messages WHERE sender_type = 'user' AND sentiment_score IS NOT NULL GROUP BY 1""", ["date"])
def _(t):
    return support.sentiment_daily(t.crisp_messages, S0, S1).withColumn("avg_score", F.round("avg_score", 9))


TIMES = ["first_contact", "last_contact"]


@query("sup_08_omnichannel_duplicates", f"WITH {DUPS} SELECT * FROM dups", TIMES)
def _(t):
    return _flat(support.omnichannel_duplicates(t.crisp_conversations))


@query("sup_09_duplicity_kpi", f"""
WITH {DUPS}, n AS (SELECT COUNT(DISTINCT identity_key) AS total_identified_users FROM ident WHERE {IN})
SELECT COUNT(*) AS duplicated_users, MAX(n.total_identified_users) AS total_identified_users, {safe('COUNT(*)', 'MAX(n.total_identified_users)')} * 100e0 AS duplicity_rate_pct
FROM dups, n WHERE first_contact >= TIMESTAMP '{S0}' AND last_contact <= TIMESTAMP '{S1}'""")
def _(t):
    return support.duplicity_kpi(t.crisp_conversations, support.omnichannel_duplicates(t.crisp_conversations), S0, S1)


@query("sup_10_duplicity_top", f"""
WITH {DUPS} SELECT people_id, visitor_nickname, visitor_email, channels_used, distinct_channels, first_contact, last_contact, latest_session_id FROM dups
ORDER BY distinct_channels DESC, last_contact DESC, identity_key LIMIT 50""", TIMES)
def _(t):
    return _flat(support.duplicity_top(support.omnichannel_duplicates(t.crisp_conversations), S0, S1))


@query("sup_11_source_audit", f"""
SELECT COALESCE(status, 'unknown') AS status, COUNT(*) AS rows, {count_if("created_at >= TIMESTAMP '2024-01-10' OR updated_at >= TIMESTAMP '2024-01-10'")} AS since,
  MIN(created_at) AS oldest FROM crisp_conversations GROUP BY 1""", ["oldest"])
def _(t):
    return support.source_audit(t.crisp_conversations, "2024-01-10")


@query("jn_04_duplicate_pairs", f"WITH {IDENT} {PAIRS}", ["created_at_a", "created_at_b"])
def _(t):
    return joins.duplicate_pairs(t.crisp_conversations)


def partner(side, earlier):
    order = "DESC" if earlier else "ASC"
    sign = "<" if earlier else ">"
    return f"""SELECT a.session_id, b.session_id AS {side}_session, b.channel_origin AS {side}_channel, b.created_at AS {side}_at FROM ident a JOIN ident b ON {NEAR}
 AND (b.created_at {sign} a.created_at OR (b.created_at = a.created_at AND b.session_id {sign} a.session_id))
 QUALIFY row_number() OVER (PARTITION BY a.session_id ORDER BY b.created_at {order}, b.session_id {order}) = 1"""


@query("jn_04_nearest_partners", f"""WITH {IDENT}, e AS ({partner('before', True)}), l AS ({partner('after', False)})
SELECT identity_key, session_id, channel_origin, created_at, before_session, before_channel, before_at, after_session, after_channel, after_at
FROM ident LEFT JOIN e USING (session_id) LEFT JOIN l USING (session_id) WHERE identity_key IS NOT NULL""", ["created_at", "before_at", "after_at"])
def _(t):
    return joins.nearest_partners(t.crisp_conversations)


@query("jn_21_message_conversations", """
SELECT m.message_id, m.session_id, m.sender_type, c.created_at AS ticket_created_at, c.status FROM crisp_messages m
JOIN crisp_conversations c ON m.session_id = c.session_id""", ["ticket_created_at"])
def _(t):
    return joins.message_conversations(t.crisp_messages, t.crisp_conversations).select(
        "message_id", "session_id", "sender_type", "ticket_created_at", "status")


@query("alg_13_identity_key", f"SELECT session_id, {IDENTITY} AS identity_key FROM crisp_conversations")
def _(t):
    from ..functions.text import identity_key

    return t.crisp_conversations.select("session_id", identity_key("people_id", "visitor_email", "visitor_phone").alias("identity_key"))


# --- calls ----------------------------------------------------------------------------

CALLS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY extension_id NULLS FIRST, seq) AS rn FROM call_log) x WHERE rn = 1)"""
DONE = "result = 'Call connected'"
MEAN = f"CASE WHEN {count_if(DONE)} > 0 THEN CAST(SUM(CASE WHEN {DONE} THEN COALESCE(duration, 0) ELSE 0 END) AS DOUBLE) / {count_if(DONE)} / 60 ELSE 0e0 END"
CALL_SUMS = f"""COUNT(*) AS total, {count_if(DONE)} AS answered, {count_if("result = 'Missed'")} AS missed"""
CALL_RATES = f"{js(pct0(count_if(DONE), 'COUNT(*)'))} AS answer_rate, {js(MEAN, 1)} AS avg_duration_min"


@query("cal_01_dedupe_calls", f"SELECT session_id, extension_id, extension_name, seq, result FROM {CALLS} c")
def _(t):
    return support.dedupe_calls(t.call_log).select("session_id", "extension_id", "extension_name", "seq", "result")


@query("cal_02_call_kpis", f"""SELECT {count_if("direction = 'Inbound'")} AS inbound, {count_if("direction = 'Outbound'")} AS outbound, {CALL_SUMS}, {CALL_RATES} FROM {CALLS} c""")
def _(t):
    return support.call_kpis(support.dedupe_calls(t.call_log))


@query("cal_03_call_agents", f"SELECT extension_id, COALESCE(MIN(extension_name), 'Sin asignar') AS name, {CALL_SUMS}, {CALL_RATES} FROM {CALLS} c GROUP BY extension_id")
def _(t):
    return support.call_agents(support.dedupe_calls(t.call_log))


@query("cal_04_call_hours", hours_sql(f"{CALLS} c", "start_time", "calls"))
def _(t):
    return support.call_hours(support.dedupe_calls(t.call_log))


@query("cal_04_call_hours_zone", hours_sql(f"{CALLS} c", "(start_time - INTERVAL 5 HOUR)", "calls"))
def _(t):
    return support.call_hours(support.dedupe_calls(t.call_log), "America/Bogota")


@query("cal_05_call_daily", f"SELECT CAST(start_time AS DATE) AS date, {CALL_SUMS} FROM {CALLS} c GROUP BY 1", ["date"])
def _(t):
    return support.call_daily(support.dedupe_calls(t.call_log))



