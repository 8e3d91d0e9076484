"""Joins between the shop tables.

No side is broadcast by hint unless a constant bounds its rows; otherwise the size
statistics and adaptive execution choose, and split skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew
from ..functions import text as tx
from ..functions.dates import day, in_dates, in_range
from ..functions.exprs import SOLD_NET, micros, money_sum, not_empty, sold, sum_where, wavg, weighted_sum, whole_hours_apart
from ..session import cut_lineage, store_parts


def sold_lines(orders: DataFrame, lines: DataFrame, d0, d1, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    """Order lines of sold orders inside the range."""
    kept = in_range(orders, "created_at", d0, d1).where(sold("financial_status", statuses))
    return lines.join(kept.select(F.col("id").alias("order_id")), "order_id")


def full_name(first="first_name", last="last_name") -> Column:
    return F.concat(F.coalesce(F.col(first), F.lit("")), F.lit(" "), F.coalesce(F.col(last), F.lit("")))


def audit_enriched(audit: DataFrame, staff: DataFrame) -> DataFrame:
    """Audit events with the staff member's code, e-mail and name; unknown staff is 'unknown'."""
    who = staff.select(
        "staff_id", "employee_code", F.col("email").alias("_email"), F.col("first_name").alias("_first"),
        F.col("last_name").alias("_last"),
    )
    return audit.join(who, "staff_id", "left").select(
        *[c for c in audit.columns if c != "staff_email"],
        F.coalesce("employee_code", F.lit("unknown")).alias("employee_code"),
        F.coalesce("_email", "staff_email").alias("staff_email"),
        full_name("_first", "_last").alias("staff_full_name"),
    )


def activity_with_team(activity: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every activity with the primary assignment valid on its day; overlaps give one row each."""
    primary = assignments.where("is_primary").select(
        F.col("employee_code").alias("_code"), "team", "role", "is_primary", "allocation_pct", "valid_from", "valid_to"
    )
    on = (
        (F.col("employee_code") == F.col("_code"))
        & (day("occurred_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (day("occurred_at") <= F.col("valid_to")))
    )
    return activity.join(primary, on, "left").drop("_code", "valid_from", "valid_to")


def identified(conversations: DataFrame) -> DataFrame:
    """Conversations with a channel and an identity key."""
    return (
        conversations.where(F.col("channel_origin").isNotNull())
        .withColumn("identity_key", tx.identity_key("people_id", "visitor_email", "visitor_phone"))
        .where(F.col("identity_key").isNotNull())
    )


def duplicate_pairs(conversations: DataFrame, hours: int = 72) -> DataFrame:
    """Pairs of one identity on different channels at most ``hours`` whole hours apart.

    A pair is less than ``hours`` + 1 hours apart, so with time cut into buckets of that
    width its buckets are equal or adjacent: one side offers its bucket, the other its own
    and both neighbours, and each pair meets exactly once. Duplicate *users* do not need
    the pairs, see ``support.omnichannel_duplicates``.
    """
    width = (hours + 1) * 3_600_000_000
    rows = identified(conversations).withColumn("_bucket", F.floor(micros("created_at") / width))
    a = rows.select(
        "identity_key", "_bucket", F.col("session_id").alias("session_a"), F.col("channel_origin").alias("channel_a"),
        F.col("created_at").alias("created_at_a"), "visitor_nickname", "visitor_email", "people_id",
    )
    b = rows.select(
        "identity_key", F.explode(F.array(*[F.col("_bucket") + i for i in (-1, 0, 1)])).alias("_bucket"),
        F.col("session_id").alias("session_b"), F.col("channel_origin").alias("channel_b"),
        F.col("created_at").alias("created_at_b"),
    )
    near = (
        (F.col("channel_a") != F.col("channel_b"))
        & (F.col("session_a") < F.col("session_b"))
        & (whole_hours_apart("created_at_a", "created_at_b") <= hours)
    )
    return a.join(b, ["identity_key", "_bucket"]).where(near).drop("_bucket")


def nearest_partners(conversations: DataFrame, hours: int = 72) -> DataFrame:
    """One row per identified conversation with the nearest earlier and later one of the same identity on another channel, at
    most ``hours`` whole hours away (else null). Of equal times the smaller session id counts as earlier.

    No pairs are formed. Time is cut into blocks as wide as the window, which bounds what a hot identity brings to a task.
    Inside a block the conversation before the present run of one channel is the partner; where the run began the block, the
    last conversation per channel of the block before answers. Later partners mirror this. Repeated rows answer each.
    """
    width = (hours + 1) * 3_600_000_000
    at = F.struct("created_at", "session_id", F.col("channel_origin").alias("channel"))
    rows = identified(conversations).withColumn("_block", F.floor(micros("created_at") / width)).withColumn("_me", at)
    ends = rows.groupBy("identity_key", "_block", "channel_origin").agg(F.min("_me").alias("_first"), F.max("_me").alias("_last"))
    ends = ends.groupBy("identity_key", "_block").agg(
        F.collect_list("_first").alias("_firsts"), F.collect_list("_last").alias("_lasts"))

    own = Window.partitionBy("identity_key", "_block")
    up, down = own.orderBy("_me"), own.orderBy(F.desc("_me"))

    def other(w):
        before = F.lag("_me").over(w)
        return F.when(before["channel"] != F.col("channel_origin"), before)

    # The rows arrive clustered by identity; the shuffle by block keeps a hot one from staying in one task.
    marked = rows.repartition("identity_key", "_block").withColumn("_up", other(up)).withColumn("_down", other(down))
    inside = marked.withColumn("_before", F.last("_up", ignorenulls=True).over(up)).withColumn(
        "_after", F.last("_down", ignorenulls=True).over(down))
    keys = [F.col("identity_key"), F.col("_block")]
    previous = ends.select(keys[0], (keys[1] + 1).alias("_block"), "_lasts")
    following = ends.select(keys[0], (keys[1] - 1).alias("_block"), "_firsts")
    foreign = lambda c: F.filter(c, lambda p: p["channel"] != F.col("channel_origin"))
    near = (
        inside.join(previous, ["identity_key", "_block"], "left").join(following, ["identity_key", "_block"], "left")
        .withColumn("_before", F.coalesce("_before", F.array_max(foreign("_lasts"))))
        .withColumn("_after", F.coalesce("_after", F.array_min(foreign("_firsts"))))
    )

    def fields(c, name):
        ok = whole_hours_apart(F.col(c)["created_at"], F.col("created_at")) <= hours
        return [F.when(ok, F.col(c)[f]).alias(f"{name}_{short}") for f, short in (("session_id", "session"), ("channel", "channel"), ("created_at", "at"))]

    return near.select("identity_key", "session_id", "channel_origin", "created_at", *fields("_before", "before"), *fields("_after", "after"))


def traffic_with_orders(traffic: DataFrame, orders: DataFrame, d0, d1, statuses: Sequence[str] = SOLD_NET) -> DataFrame:
    """Daily traffic with the number of sold orders; days without orders count 0.

    Orders are counted per day first, so the join meets one row per day.
    """
    days = traffic.where(F.col("date").between(F.lit(str(d0)[:10]).cast("date"), F.lit(str(d1)[:10]).cast("date")))
    per_day = (
        in_range(orders, "created_at", d0, d1).where(sold("financial_status", statuses))
        .groupBy(day("created_at").alias("date"))
        .agg(F.count("id").alias("orders"))
    )
    return days.join(per_day, "date", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


def marketing_traffic(ga4: DataFrame, email: DataFrame, channel: str = "Email") -> DataFrame:
    """Daily channel sums; the day's e-mail measures only on rows of the e-mail channel."""
    keys = ["date", "channel", "source_medium", "campaign_name"]
    daily = ga4.groupBy(
        "date", F.col("session_default_channel_group").alias("channel"),
        F.col("session_source_medium").alias("source_medium"), "campaign_name",
    ).agg(
        F.sum("sessions").alias("sessions"), F.sum("conversions").alias("conversions"),
        money_sum("purchase_revenue").alias("ga4_revenue"),
    )
    metric = F.col("metric_name")
    mails = email.groupBy(day("date").alias("_day")).agg(
        F.sum(F.when(metric == "Opened Email", F.col("count")).otherwise(0)).alias("related_emails_opened"),
        F.sum(F.when(metric == "Clicked Email", F.col("count")).otherwise(0)).alias("related_emails_clicked"),
        sum_where(metric == "Placed Order", "sum_value").alias("related_klaviyo_revenue"),
    )
    on = (F.col("date") == F.col("_day")) & (F.col("channel") == channel)
    return daily.join(mails, on, "left").select(
        *keys, "sessions", "conversions", "ga4_revenue", "related_emails_opened", "related_emails_clicked",
        "related_klaviyo_revenue",
    )


def page_handles(pages: DataFrame, page: str = "page") -> DataFrame:
    """Product handles named in a page address, one row each ('/', '?' or the end closes one)."""
    found = F.array_distinct(F.regexp_extract_all(F.col(page), F.lit(r"(?=/products/([^/?]+))"), F.lit(1)))
    return pages.withColumn("handle", F.explode(found))


def seo_position(products: DataFrame, gsc: DataFrame, d0, d1) -> DataFrame:
    """Impression-weighted search position per product handle; products without pages get null.

    The handle is cut out of the address, so pages and products meet in an equi-join, and
    search rows are summed per handle before it.
    """
    per_handle = handle_positions(page_weights(in_dates(gsc, "date", d0, d1)))
    return products.join(per_handle, "handle", "left")


def page_weights(gsc: DataFrame) -> DataFrame:
    """Sums behind the weighted position per page, with the page's handles; summing first
    leaves one address per page to be cut."""
    sums = gsc.groupBy("page").agg(
        weighted_sum("position", "impressions").alias("weighted"), F.sum("impressions").alias("impressions"))
    return page_handles(sums)


def handle_positions(weights: DataFrame) -> DataFrame:
    total = F.sum("impressions").cast("double")
    return weights.groupBy("handle").agg(F.try_divide(F.sum("weighted").cast("double"), total).alias("seo_position"))


def product_pages(gsc: DataFrame, products: DataFrame, product_id: int) -> DataFrame:
    """Search rows of pages whose address contains /products/<handle> (a prefix match: the
    handle 'mini' also takes 'mini-pro'). The handle is a scalar subquery, not a join."""
    handle = products.where(F.col("id") == product_id).limit(1).select("handle").scalar()
    return gsc.where(F.col("page").contains(F.concat(F.lit("/products/"), handle)))


def product_pages_all(gsc: DataFrame, products: DataFrame) -> DataFrame:
    """The same match for every product: each distinct address offers the prefixes after
    /products/ of the lengths that handles have, and handles meet them in an equi-join."""
    lengths = products.where(F.length("handle") > 0).agg(F.sort_array(F.collect_set(F.length("handle")))).scalar()
    tails = (
        gsc.select("page").where(F.col("page").contains("/products/")).distinct()
        .select("page", F.explode(F.regexp_extract_all("page", F.lit(r"(?s)(?=/products/(.+))"), F.lit(1))).alias("tail"))
    )
    prefixes = tails.withColumn("lengths", lengths).select(
        "page", F.explode(F.transform(
            F.filter("lengths", lambda n: n <= F.length("tail")), lambda n: F.substring(F.col("tail"), 1, n))).alias("handle")
    )
    return prefixes.join(products.select(F.col("id").alias("product_id"), "handle"), "handle").distinct()


def product_seo_card(products: DataFrame, gsc: DataFrame, product_id: int, d0, d1) -> DataFrame:
    """One product row beside its search totals; the totals are one-row scalar subqueries."""
    rows = product_pages(in_dates(gsc, "date", d0, d1), products, product_id)
    totals = rows.agg(
        F.struct(
            F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
            wavg("position", "impressions").alias("avg_position"),
        ).alias("t")
    ).scalar()
    one = products.where(F.col("id") == product_id).limit(1)
    return one.select("title", "handle", "vendor", totals.alias("t")).select("title", "handle", "vendor", "t.*")


def mark_synced(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Set the flag on conversations that have messages; others keep theirs."""
    seen = messages.select("session_id").distinct().withColumn("_seen", F.lit(True))
    return (
        conversations.join(seen, "session_id", "left")
        .withColumn("messages_synced", F.coalesce("_seen", "messages_synced"))
        .drop("_seen")
    )


def new_rows(source: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key is not known yet."""
    return source.join(known.select(*keys), list(keys), "left_anti")


def unassigned_staff(staff: DataFrame, assignments: DataFrame) -> DataFrame:
    """Staff without an open assignment."""
    return staff.join(assignments.where(F.col("valid_to").isNull()), "employee_code", "left_anti").select("employee_code")


def known_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def latest_signal(trends: DataFrame) -> DataFrame:
    """Rows on the newest brand date of each keyword.

    Ties stay, and so do rows of another keyword type on that date, as in the report this
    reproduces. The date is an aggregate joined back, so a hot keyword is not one sort.
    """
    newest = trends.where(F.col("keyword_type") == "brand").groupBy("keyword").agg(F.max("trend_date").alias("trend_date"))
    return trends.join(newest, ["keyword", "trend_date"], "left_semi")


# Launch states.
EXISTING, NEW_LAUNCH = "EXISTENTE", "NUEVO LANZAMIENTO"


def match_launches(candidates: DataFrame, products: DataFrame, name="producto", brand="marca") -> DataFrame:
    """State of each launch: existing when some product's title contains its name or brand
    and the vendor contains the brand or the brand the vendor, ignoring case. An empty name
    or brand is contained in everything.

    Containment is answered by exact substring equi-joins over distinct titles, vendors,
    names and brands; launches and products never meet as pairs. Products without a vendor
    (loaded as null) match nothing.
    """
    low = candidates.select(
        "*", F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name"),
        F.lower(F.coalesce(F.col(brand), F.lit(""))).alias("_brand"),
    )
    shelf = products.select(F.lower("title").alias("title"), F.lower("vendor").alias("vendor")).distinct()
    shelf = shelf.where(F.col("title").isNotNull() & (F.col("vendor") != ""))
    vendors = shelf.select("vendor").distinct()
    brands = low.select(F.col("_brand").alias("brand")).distinct()
    names = low.select(F.col("_name").alias("name"), F.col("_brand").alias("brand")).distinct()

    # (brand, vendor): the vendor contains the brand, or the brand the vendor.
    related = (
        skew.contains_matches(vendors, ["vendor"], "vendor", brands, "brand")
        .select(F.col("needle").alias("brand"), "vendor")
        .unionByName(
            skew.contains_matches(brands, ["brand"], "brand", vendors, "vendor").select(
                "brand", F.col("needle").alias("vendor")
            )
        )
        .distinct()
    )
    titles = shelf.select("title").distinct()
    words = brands.select(F.col("brand").alias("word")).unionAll(names.select("name")).distinct()
    found = skew.contains_matches(titles, ["title"], "title", words, "word")
    has_brand = found.withColumnRenamed("needle", "brand").join(brands, "brand", "left_semi")
    has_name = found.withColumnRenamed("needle", "name").join(names, "name", "left_semi")

    by_brand = (
        has_brand.join(shelf, "title").join(related, ["brand", "vendor"], "left_semi").select("brand").distinct()
    )
    by_name = (
        has_name.join(shelf, "title").select("name", "vendor").distinct()
        .join(names.where("name != ''"), "name")
        .join(related, ["brand", "vendor"], "left_semi")
        .select("name", "brand").distinct()
    )
    # An empty name is in every title of a related vendor; an empty brand in everything.
    related_brands = related.select("brand").distinct()
    stocked = F.coalesce(shelf.agg(F.count(F.lit(1)) > 0).scalar(), F.lit(False))
    hit = (
        F.coalesce("_by_brand", "_by_name", F.lit(False))
        | ((F.col("_brand") == "") & stocked)
        | ((F.col("_name") == "") & F.coalesce("_related", F.lit(False)))
    )
    return (
        low.join(by_brand.select(F.col("brand").alias("_brand"), F.lit(True).alias("_by_brand")), "_brand", "left")
        .join(related_brands.select(F.col("brand").alias("_brand"), F.lit(True).alias("_related")), "_brand", "left")
        .join(
            by_name.select(F.col("name").alias("_name"), F.col("brand").alias("_brand"), F.lit(True).alias("_by_name")),
            ["_name", "_brand"], "left",
        )
        .withColumn("estado_db", F.when(hit, F.lit(EXISTING)).otherwise(F.lit(NEW_LAUNCH)))
        .select(*candidates.columns, "estado_db")
    )


def attribute_names(rows: DataFrame, flows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Flow and campaign names of message ids: a flow wins; an unknown id shows as (ID: x)."""

    def named(known, key):
        return F.coalesce(known, F.concat(F.lit("(ID: "), F.col(key), F.lit(")")))

    flow = F.col("flow_id") != ""
    campaign = ~flow & (F.col("message_id") != "")
    return (
        rows.join(flows.select(F.col("id").alias("flow_id"), F.col("name").alias("_flow")), "flow_id", "left")
        .join(campaigns.select(F.col("id").alias("message_id"), F.col("name").alias("_campaign")), "message_id", "left")
        .withColumn("flow_name", F.when(flow, named(F.col("_flow"), "flow_id")).otherwise(""))
        .withColumn("campaign_name", F.when(campaign, named(F.col("_campaign"), "message_id")).otherwise(""))
        .drop("_flow", "_campaign")
    )


def attribute_staff(events: DataFrame, staff: DataFrame, position: str = "list_pos") -> DataFrame:
    """Author of each audit event.

    An explicit author id wins, then a staff id inside the event id. Otherwise names in the
    message decide: the full name anywhere; first and last name inside one link text; both
    as whole words; a first name of four or more letters as a word of the first link. Among
    all staff that any rule accepts, the first in list order is taken.

    Names meet texts by equi-joins and stay long rows: as runs of whole words, and inside links as substrings. A rule on two
    names is joined by the one that fewer rules hold and then, within the same text, by the other, so that neither a name that
    a large part of the staff shares nor a message of many names forms pairs. Only what may be such a name is shuffled.
    """
    spark = events.sparkSession
    gid = F.regexp_extract("id", r"staff_member_id=(\d+)", 1)
    fixed = F.coalesce(not_empty(tx.clean_gid(F.col("author")["id"])), not_empty(gid))
    links = F.transform(
        F.regexp_extract_all("message", F.lit(r"<a[^>]*>(.*?)</a>"), F.lit(1)), lambda x: tx.normalize_text(x)
    )
    open_events = cut_lineage(spark, events.where(fixed.isNull() & not_empty("message").isNotNull()).select(
        F.col("id").alias("event"), tx.normalize_text("message").alias("text"), links.alias("links")
    ), "open-events")
    # The message is unit -1, its links are units 0, 1, ...
    linked = open_events.select("event", F.posexplode("links").alias("unit", "text"))
    messages = open_events.select("event", F.lit(-1).alias("unit"), "text")

    named = staff.where(not_empty("first_name").isNotNull() & not_empty("last_name").isNotNull()).select(
        F.struct(F.col(position).alias("pos"), "staff_id").alias("who"),
        tx.normalize_text("first_name").alias("fn"),
        tx.normalize_text("last_name").alias("ln"),
        tx.normalize_text(F.concat_ws(" ", "first_name", "last_name")).alias("full"),
    )
    # What each rule looks up, and the first staff member it leads to. The full name covers staff of whom only one name has
    # letters or digits; what stands in a link stands in the message too.
    first_who = F.min("who").alias("who")
    full_names = cut_lineage(spark, named.where("full != ''").groupBy(F.col("full").alias("needle")).agg(first_who), "full-names")
    first_names = cut_lineage(spark, named.where("length(fn) >= 4").groupBy(F.col("fn").alias("needle")).agg(first_who), "first-names")
    pairs = named.where("fn != '' AND ln != ''").groupBy("fn", "ln").agg(first_who)
    by_first, by_last = (pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"_{c}s")) for c in ("fn", "ln"))
    rarer = F.col("_fns") <= F.col("_lns")
    pair_rules = cut_lineage(spark, pairs.join(by_first, "fn").join(by_last, "ln").select(
        F.when(rarer, F.col("fn")).otherwise(F.col("ln")).alias("needle"), F.when(rarer, F.col("ln")).otherwise(F.col("fn")).alias("other"), "who"),
        "pair-rules")

    full = skew.contained(open_events, ["event"], "text", full_names, "needle").join(full_names, "needle").select("event", "who")
    first = skew.contained_words(linked.where("unit = 0"), ["event"], "text", first_names, "needle").join(first_names, "needle").select("event", "who")

    def pairs_in(texts: DataFrame, names: Callable[..., DataFrame]) -> DataFrame:
        begun = names(texts, ["event", "unit"], "text", pair_rules, "needle").join(pair_rules, "needle")
        begun = begun.select("event", "unit", F.col("other").alias("needle"), "who")
        return begun.join(names(texts, ["event", "unit"], "text", pair_rules, "other"), ["event", "unit", "needle"], "left_semi").select("event", "who")

    # Inside a link a pair may stand anywhere, in the message as whole words. One rule at a time, the last in the plan returned:
    # tasks get what bits its names have, and those of all rules together fill the memory of driver and tasks.
    ruled = store_parts(spark, [full, first, pairs_in(messages, skew.contained_words)], "ruled")
    both = pairs_in(linked, skew.contained)
    # A name that normalises to '' is contained in every text that has a letter or digit.
    nameless = named.where("fn = '' AND ln = ''").agg(F.min("who")).scalar()
    any_text = open_events.where("text != '' OR size(links) > 0").select("event", nameless.alias("who")).where(F.col("who").isNotNull())
    best = (
        ruled.unionByName(both).unionByName(any_text)
        .groupBy(F.col("event").alias("id")).agg(F.min("who")["staff_id"].alias("_matched"))
    )
    return events.join(best, "id", "left").withColumn("staff_id", F.coalesce(fixed, "_matched")).drop("_matched")


# Currency per country of the price search; any other country uses USD.
COUNTRY_CURRENCY = {"us": "USD", "cl": "CLP", "mx": "MXN", "ar": "ARS", "co": "COP", "es": "EUR"}


def convert_price(df: DataFrame, rates: DataFrame, price: str = "our_price", country: str = "country") -> DataFrame:
    """Price in the country's currency; an unknown rate leaves it as it is."""
    pairs = F.create_map(*[F.lit(x) for kv in COUNTRY_CURRENCY.items() for x in kv])
    currency = F.coalesce(F.try_element_at(pairs, F.col(country)), F.lit("USD"))
    rate = F.when(F.col("target_currency") == "USD", F.lit(1.0)).otherwise(F.coalesce("_rate", F.lit(1.0)))
    return (
        df.withColumn("target_currency", currency)
        .join(rates.select(F.col("currency").alias("target_currency"), F.col("rate").alias("_rate")), "target_currency", "left")
        .withColumn("exchange_rate", rate)
        .withColumn("converted_price", F.col(price) * rate)
        .drop("_rate")
    )


def join_as_string(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key whose type differs between the sides."""
    return a.withColumn(key, F.col(key).cast("string")).join(b.withColumn(key, F.col(key).cast("string")), key, how)


def overlay(base: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved series beside the base series by date label, in long form.

    ``base`` has (label), ``saved`` (label, term, saved_on, value). Saved labels that the
    base lacks are dropped; a missing value is 0.
    """
    series = F.concat("term", F.lit(" ("), F.date_format("saved_on", "yyyy-MM-dd"), F.lit(")"))
    return saved.join(base.select("label").distinct(), "label", "left_semi").select(
        "label", series.alias("series"), F.coalesce("value", F.lit(0)).alias("value")
    )


def attach_volumes(products: DataFrame, volumes: DataFrame) -> DataFrame:
    """Search volumes by lower-cased keyword; 0 where there are none."""
    v = volumes.withColumnRenamed("keyword", "_kw")
    return (
        products.join(v, F.lower("keyword") == F.col("_kw"), "left")
        .drop("_kw")
        .fillna(0, subset=["avg_monthly_searches", "last_month_searches"])
    )


def attach_positions(items: DataFrame, scans: DataFrame) -> DataFrame:
    """Scan results by keyword; items without a result are dropped."""
    return items.join(scans.drop("product_id") if "product_id" in scans.columns else scans, "keyword")


def message_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with their conversation's start and status."""
    c = conversations.select("session_id", F.col("created_at").alias("ticket_created_at"), "status")
    return messages.join(c, "session_id")


# --- searches -------------------------------------------------------------------------

def product_search(products: DataFrame, q: str, k: int = 20) -> DataFrame:
    """Products whose title or handle contains ``q``, ignoring case, newest first; a search of
    fewer than two characters finds nothing. ``%`` and ``_`` are plain characters."""
    needle = q.strip().lower()
    if len(needle) < 2:
        return products.where(F.lit(False))
    hit = F.lower("title").contains(needle) | F.lower("handle").contains(needle)
    return products.where(hit).orderBy(F.desc("created_at"), "id").limit(k)


def product_prefix(products: DataFrame, q: str, k: int = 10) -> DataFrame:
    """Products whose title starts with ``q``."""
    return products.where(F.col("title").startswith(q)).orderBy("title", "id").limit(k)


def payload_search(audit: DataFrame, needle: str, k: int = 10) -> DataFrame:
    """Newest events whose payload text contains ``needle``, ignoring case."""
    return audit.where(F.lower("raw_payload").contains(needle.lower())).orderBy(F.desc("occurred_at"), "audit_id").limit(k)


def staff_search(staff: DataFrame, q: str) -> DataFrame:
    """Staff whose first or last name contains ``q``, ignoring case."""
    low = q.lower()
    return staff.where(F.lower("first_name").contains(low) | F.lower("last_name").contains(low))
