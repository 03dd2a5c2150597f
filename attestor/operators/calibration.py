"""Confidence: raw signals, semantic buckets, empirical Bayes, isotonic fit and ridge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.functions.text import canonical_feature, is_unknown

# Reasons that make a denial a hard one.
HARD_PREFIXES = ["barred_sponsor:", "disqualifying_flag:", "embargoed_home_world:", "stay_limit_exceeded:"]
HARD_REASONS = ["biohazard_red", "required_sponsor_absent", "stale_application", "transit_work_authorization", "unpaid_without_valid_waiver"]


def some(array: str, *starts: str) -> Column:
    return F.exists(array, lambda r: reduce(lambda a, b: a | b, [r.startswith(s) for s in starts]))


def support() -> Column:
    return F.size(F.array_remove("approval_facts", "strict_approval_bar_cleared"))


def raw_signal() -> Column:
    """Signal of a decision trace before calibration: a base by its kind and a little for each further reason."""
    hard = some("denial_reasons", *HARD_PREFIXES) | (F.size(F.array_intersect("denial_reasons", F.array(*[F.lit(x) for x in HARD_REASONS]))) > 0)
    denied = F.when(hard, 0.93).otherwise(0.84) + F.least(F.lit(0.05), F.greatest(F.lit(0), F.size("denial_reasons") - 1) * 0.015)
    base = F.when(some("review_reasons", "contested_field:"), 0.94).when(some("review_reasons", "unresolved_linkage:"), 0.92).when(some("review_reasons", "review_flag:"), 0.88).when(F.exists("review_reasons", lambda r: r.contains("not_visible")), 0.83).otherwise(0.74)
    review = base + F.least(F.lit(0.06), F.greatest(F.lit(0), F.size("review_reasons") - 1) * 0.01)
    approved = 0.78 + F.least(F.lit(6), support()) * 0.025
    return (
        F.when(F.col("authoritative"), 0.98)
        .when(F.col("decision") == "DENIED", F.least(F.lit(0.99), denied))
        .when(F.col("decision") == "NEEDS_REVIEW", F.least(F.lit(0.98), review))
        .when(F.col("decision") == "APPROVED", F.least(F.lit(0.93), approved))
    )


#: Categories of a denial, first match wins.
DENIAL_CATEGORIES = ["disqualifying_flag:", "barred_sponsor:", "embargoed_home_world:", "transit_work_authorization", "biohazard_red", "unpaid_without_valid_waiver", "stale_application", "stay_limit_exceeded:", "required_sponsor_absent", "validated_generalizable_exception"]


def bucket() -> Column:
    """Parent bucket of a trace."""
    denial = reduce(lambda c, k: c.when(some("denial_reasons", k), f"reason={k.rstrip(':')}"), DENIAL_CATEGORIES[1:], F.when(some("denial_reasons", DENIAL_CATEGORIES[0]), f"reason={DENIAL_CATEGORIES[0].rstrip(':')}")).otherwise("reason=other")
    gap = some("review_reasons", "required_output_", "visa_class_", "risk_flags_", "fee_status_", "arrival_date_", "required_sponsor_") | F.exists("review_reasons", lambda r: r.contains("not_visible"))
    review = F.when(some("review_reasons", "review_flag:"), "class=review_flag").when(some("review_reasons", "contested_field:", "unresolved_linkage:", "conflicting_generalizable_exceptions"), "class=conflict").when(gap, "class=core_gap").otherwise("class=policy_only")
    approved = F.concat(F.lit("support="), F.least(F.lit(6), support()).cast("string"))
    rest = F.when(F.col("authoritative"), "authoritative").when(F.col("decision") == "DENIED", denial).when(F.col("decision") == "APPROVED", approved).otherwise(review)
    return F.concat_ws("|", "decision", rest)


def signature() -> Column:
    """Exact signature of a trace without what names the case."""
    part = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, canonical_feature))), ",")
    source = F.when(F.col("authoritative"), "authoritative").otherwise("rules")
    return F.concat(F.col("decision"), F.lit("|source="), source, F.lit("|denial="), part("denial_reasons"), F.lit("|review="), part("review_reasons"), F.lit("|approval="), part("approval_facts"))


LEVELS = ("decision", "bucket", "signature")


def fit_semantic(samples: DataFrame) -> DataFrame:
    """(level, key, correct, total) of samples (decision, bucket, signature, correct): all four levels by grouping sets, over counts of the distinct traces."""
    sets = [[], *[[c] for c in LEVELS]]
    traces = samples.groupBy(*LEVELS).agg(F.sum(F.col("correct").cast("long")).alias("correct"), F.count("*").alias("total"))
    out = traces.groupingSets(sets, *LEVELS).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.grouping_id(*LEVELS).alias("_g"))
    level = F.when(F.col("_g") == 7, "global").when(F.col("_g") == 3, "decision").when(F.col("_g") == 5, "bucket").otherwise("signature")
    return out.select(level.alias("level"), F.coalesce(*LEVELS, F.lit("")).alias("key"), "correct", "total")


def apply_semantic(traces: DataFrame, stats: DataFrame, strengths=(8.0, 2.0, 2.0), clip=(0.02, 0.98)) -> DataFrame:
    """traces with probability: each level's rate drawn to its parent's by the strength; a level without the key keeps the parent's.

    Broadcast joins are left to Catalyst, which knows the size of stats: signatures grow with the samples.
    """
    out = traces.crossJoin(F.broadcast(stats.filter("level = 'global'").select((F.col("correct") / F.col("total")).alias("_p"))))  # one row
    for level, s in zip(LEVELS, strengths, strict=True):
        mine = stats.filter(F.col("level") == level).select(F.col("key").alias("_k"), F.col("correct").alias("_c"), F.col("total").alias("_n"))
        out = out.join(mine, F.col(level) == F.col("_k"), "left").withColumn("_p", F.when(F.col("_n").isNull(), F.col("_p")).otherwise((F.col("_c") + s * F.col("_p")) / (F.col("_n") + s))).drop("_k", "_c", "_n")
    return out.withColumn("probability", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("_p")))).drop("_p")


def fit_isotonic(samples: DataFrame, signal: str = "raw_signal", correct: str = "correct") -> DataFrame:
    """(breakpoint, probability): steps of the monotone least-squares fit, in [0, 1].

    Neighbours are pooled while the one before has the greater mean; equal ones
    stay steps of their own.  Breakpoints 0 and 1 are added with the first and
    last probability.  Only distinct signals are gathered, with their counts;
    they are few, as signals are rounded.  Signals that are null or outside of
    [0, 1] raise ValueError; none give no steps.
    """
    points = samples.groupBy(F.col(signal).alias("x")).agg(F.sum(F.col(correct).cast("long")).alias("c"), F.count(correct).alias("n"))
    rows = sorted(points.collect(), key=lambda r: (r["x"] is not None, r["x"]))
    if rows and (rows[0]["x"] is None or not 0 <= rows[0]["x"] <= rows[-1]["x"] <= 1):
        raise ValueError("raw signals must be in [0, 1]")
    blocks: list[list] = []
    for r in (r for r in rows if r["n"]):
        blocks.append([float(r["x"]), r["c"], r["n"]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] > blocks[-1][1] * blocks[-2][2]:
            _, c, n = blocks.pop()
            blocks[-1][1] += c
            blocks[-1][2] += n
    steps = [(x, c / n) for x, c, n in blocks]
    if steps and steps[0][0] > 0:
        steps.insert(0, (0.0, steps[0][1]))
    if steps and steps[-1][0] < 1:
        steps.append((1.0, steps[-1][1]))
    return samples.sparkSession.createDataFrame(steps, "breakpoint double, probability double")


def apply_isotonic(rows: DataFrame, steps: DataFrame, signal: str = "raw_signal") -> DataFrame:
    """rows with probability: that of the last breakpoint not above the signal, the first one's below all.  Steps are one small array."""
    packed = steps.agg(F.array_sort(F.collect_list(F.struct("breakpoint", "probability"))).alias("_s"))
    found = F.try_element_at(F.filter("_s", lambda s: s["breakpoint"] <= F.col(signal)), F.lit(-1))
    return rows.crossJoin(F.broadcast(packed)).withColumn("probability", F.coalesce(found["probability"], F.try_element_at("_s", F.lit(1))["probability"])).drop("_s")


def ridge() -> Column:
    """Recalibrated confidence of an output row: reviews below the guard only, others keep theirs."""
    p = F.col("confidence")
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    unknown = {f: one(is_unknown(f, F.col(f))) for f in vocab.OUTPUT_FIELDS}
    fee = F.lower(F.trim(F.coalesce("fee_status", F.lit(""))))
    values = {"bias": F.lit(1.0), "p": p, "p2": p * p, "unknown_count": reduce(lambda a, b: a + b, unknown.values()) / len(unknown)}
    values |= {f"output={d}": one(F.col("adjudication") == d) for d in vocab.DECISIONS} | {f"p_output={d}": one(F.col("adjudication") == d) * p for d in vocab.DECISIONS}
    values |= {f"unknown={f}": u for f, u in unknown.items()} | {f"fee_{x}": one(fee == x) for x in vocab.FEES}
    values["risk_non_none"] = one(~F.lower(F.trim(F.coalesce("risk_flags", F.lit("")))).isin("", "none", "unknown", "null"))
    total = reduce(lambda a, b: a + b, [values[f] * w for f, w in vocab.RIDGE.items()])
    guarded = (F.col("adjudication") == vocab.RIDGE_GUARD[0]) & (p < vocab.RIDGE_GUARD[1])
    return F.when(guarded, F.greatest(F.lit(vocab.RIDGE_CLIP[0]), F.least(F.lit(vocab.RIDGE_CLIP[1]), total))).otherwise(p)
