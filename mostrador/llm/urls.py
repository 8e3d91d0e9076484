"""URL filter: host and path rules, and a ratio of two character models where no rule fits.

URLs that rules allow or block are examples. Two variable-order Markov models of their characters, one for each verdict,
are counted over all examples: after each context of up to ORDER characters, how often each character follows. A
probability mixes a context's counts with the probability after the context without its first character (Witten-Bell:
the lower order weighs as much as the context has different followers; a context never seen passes on the lower order),
down to equal shares of all characters. A URL's score is the mean over its characters and its end of the difference of both
log-probabilities. The limit from which it is allowed is calibrated on the examples of CALIBRATING hexadecimal first
digits of a URL's MD5, which are not counted: the one of the highest balanced accuracy.

The models are tables. Each distinct run of characters that is asked for is worked out once; runs that occur in more than
one of 2**16 places are few, and sent to every task, all others are joined. Log-probabilities are summed as whole millionths,
so that scores do not depend on the order of rows.

A null URL is an empty one; host and path are empty where there is no ``://``, and no rule fits. Rows that repeat, also
with the same page id, are judged each. Without examples of both verdicts among those kept for it, the limit is 0. Very
long URLs are read whole. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut_lineage

Rule = tuple[str, str]  # verdict and host with path
ORDER = 4
CALIBRATING = "012"
START, END = "\x02", "\x03"
MILLION = 1_000_000
# Scores are held against limits of this many to a nat, within so many nats.
STEPS, WIDEST = 100, 32
# Runs of characters that are sent to every task occur in more than one of so many places, and more than RARE times.
SENT, RARE = 1 << 16, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, in lower case; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null: its host or a subdomain, and a path that starts with its own."""
    rule = verdict = F.lit(None).cast("string")
    for is_for, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = pattern.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(is_for)).otherwise(verdict)
    return rule, verdict


def characters(url: Column) -> Column:
    return F.filter(F.split(url, ""), lambda c: c != "")


def runs(url: Column) -> Column:
    """For each character and the end: the ORDER characters before it and itself."""
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), characters(url), F.array(F.lit(END)))
    # The text beside itself, one place further each time, so that the work is linear in a URL's length.
    shifted = [F.slice(padded, k + 1, F.size(padded) - ORDER) for k in range(ORDER + 1)]
    return reduce(lambda left, right: F.zip_with(left, right, lambda a, b: F.concat(a, b)), shifted)


def _ratios(counted: DataFrame) -> DataFrame:
    """(run, ratio) of the runs wanted: millionths of the log-ratio of both models. ``counted`` has run, allowed, blocked and
    wanted."""
    alphabet = 1 + counted.filter("allowed + blocked > 0").select(F.substring("run", -1, 1)).distinct().count()
    lower = None
    for order in range(ORDER + 1):
        level = counted.groupBy(F.expr(f"right(run, {order + 1})").alias("run")).agg(*(F.sum(c).alias(c) for c in ("allowed", "blocked", "wanted")))
        level = level.withColumn("context", F.expr(f"left(run, {order})"))
        contexts = level.filter("allowed + blocked > 0").groupBy("context").agg(*(
            f(F.when(F.col(c) > 0, F.col(c))).alias(f"{name}_{c}") for c in ("allowed", "blocked") for name, f in (("all", F.sum), ("kinds", F.count))))
        asked = level.filter("wanted > 0").join(contexts, "context", "left")
        if lower is None:
            asked = asked.withColumns({f"below_{c}": F.lit(1.0 / alphabet) for c in ("allowed", "blocked")})
        else:
            below = lower.select(F.col("run").alias("shorter"), *(F.col(f"p_{c}").alias(f"below_{c}") for c in ("allowed", "blocked")))
            asked = asked.withColumn("shorter", F.expr(f"right(run, {order})")).join(below, "shorter")
        chance = {f"p_{c}": F.expr(f"CASE WHEN all_{c} > 0 THEN ({c} + kinds_{c} * below_{c}) / (all_{c} + kinds_{c}) ELSE below_{c} END") for c in ("allowed", "blocked")}
        lower = asked.withColumns(chance).select("run", "wanted", *chance)
    return lower.select("run", "wanted", F.round(MILLION * (F.ln("p_allowed") - F.ln("p_blocked"))).cast("long").alias("ratio"))


def best_limit(bins: Sequence[Row]) -> float:
    """The limit of the highest balanced accuracy over rows (step, allowed, blocked); of equal ones the nearest to 0, then
    the lower."""
    allowed, blocked = sum(r["allowed"] for r in bins), sum(r["blocked"] for r in bins)
    if not allowed or not blocked:
        return 0.0
    at = {r["step"]: r for r in bins}
    right_allowed, right_blocked, found = allowed, 0, []
    for step in range(-STEPS * WIDEST, STEPS * WIDEST + 1):
        found.append((-(right_allowed * blocked + right_blocked * allowed), abs(step), step))
        if step in at:
            right_allowed -= at[step]["allowed"]
            right_blocked += at[step]["blocked"]
    return min(found)[2] / STEPS


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per row: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_column).alias("page_id"), url.alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("kept_back", F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*CALIBRATING))
    rows = cut_lineage(spark, rows.withColumn("row", F.monotonically_increasing_id()), "urls")

    asked = rows.filter("verdict IS NULL OR kept_back").select("row", F.explode(runs(F.col("url"))).alias("run"))
    learnt = rows.filter("verdict IS NOT NULL AND NOT kept_back").select("verdict", F.explode(runs(F.col("url"))).alias("run"))
    counted = (learnt.groupBy("run").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.lit(0).cast("long").alias("wanted"))
               .unionByName(asked.groupBy("run").agg(F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"), F.count("*").alias("wanted"))))
    counted = cut_lineage(spark, counted.groupBy("run").agg(*(F.sum(c).alias(c) for c in ("allowed", "blocked", "wanted"))), "runs")
    ratios = cut_lineage(spark, _ratios(counted), "ratios")
    places = counted.agg(F.sum("wanted")).first()[0] or 0
    often = F.col("wanted") > max(RARE, places // SENT)
    known = F.broadcast(ratios.filter(often).select("run", "ratio"))
    sums = (asked.join(known, "run").unionByName(asked.join(known.select("run"), "run", "left_anti").join(ratios.filter(~often).select("run", "ratio"), "run"))
            .groupBy("row").agg(F.sum("ratio").alias("ratio")))
    length = F.size(characters(F.col("url"))) + 1
    scored = rows.join(sums, "row", "left").withColumn("score", F.col("ratio") / length / MILLION)
    scored = cut_lineage(spark, scored.select("page_id", "host", "path", "rule", "verdict", "score"), "scored-urls")
    step = F.least(F.greatest(F.floor(F.col("score") * STEPS), F.lit(-STEPS * WIDEST)), F.lit(STEPS * WIDEST))
    bins = (scored.filter("verdict IS NOT NULL AND score IS NOT NULL").groupBy(step.alias("step"))
            .agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")).collect())
    limit = best_limit(bins)
    decided = F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
