"""Policy adjudication of resolved cases, as arrays of reasons.

A case is a wide row: for each field f a struct f(state, value, visible, type),
value set only where state is resolved, and linkage (array of reasons),
rescinded (boolean).  prepared() turns a field into plain columns once; each
reason is one conditional expression over them, and the arrays are compacted in
the same projection, so a decision costs no shuffle.  No lambda stands around
the conditions, as Spark evaluates what is in one without generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import vocab
from attestor.functions.text import iso_date, split_flags

FIELDS = [*vocab.OUTPUT_FIELDS, "adjudication", "hardship_waiver", "diplomatic_note", "packet_receipt_date", "stay_duration_days", "biohazard_check"]


def value(f: str) -> Column:
    """Of a case as it is given; after prepared() the column _v_f has it."""
    return F.when(F.col(f)["state"] == "resolved", F.col(f)["value"])


def visible(f: str) -> Column:
    """Resolved by visible, legible evidence other than the text layer; after prepared() the column _s_f has it."""
    return F.coalesce((F.col(f)["state"] == "resolved") & F.col(f)["visible"] & (F.col(f)["type"] != "text_layer"), F.lit(False))


def _v(f: str) -> Column:
    return F.col(f"_v_{f}")


def _s(f: str) -> Column:
    return F.col(f"_s_{f}")


def _state(f: str) -> Column:
    return F.col(f"_k_{f}")


def _marked(f: str) -> Column:
    return F.coalesce(_v(f) == "valid", F.lit(False)) & _s(f)


def prepared(cases: DataFrame) -> DataFrame:
    """cases with value (_v_f), visibility (_s_f) and state (_k_f, unknown for null) of each field, and the flags as an array.  All are referred to more than once, so Catalyst computes them once."""
    cols = {}
    for f in FIELDS:
        cols |= {f"_v_{f}": value(f), f"_s_{f}": visible(f), f"_k_{f}": F.coalesce(F.col(f)["state"], F.lit("unknown"))}
    return cases.withColumns(cols).withColumn("_flags", F.coalesce(split_flags(_v("risk_flags")), F.array().cast("array<string>")))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _listed(reasons: list[tuple[Column, Column]], *arrays: Column) -> Column:
    """Sorted distinct names whose condition holds, and those of the arrays."""
    own = F.array_except(F.array(*[F.when(true(c), name) for c, name in reasons]), F.array(F.lit(None).cast("string")))
    return F.sort_array(F.array_distinct(reduce(F.concat, arrays, own)))


def adjudicate(cases: DataFrame, carry: tuple = ()) -> DataFrame:
    """case_id, decision, authoritative, denial_reasons, review_reasons, approval_facts, and the columns of carry, expressions over prepared cases.

    A visible stamp or signed note decides alone.  Else any denial reason
    denies, any review reason asks for review, and only a case without either
    is approved.  Missing values are null; unparsable dates and numbers count
    as unknown.  Contested fields are all of FIELDS.
    """
    lit, any_of = F.lit, lambda xs: F.array(*[F.lit(x) for x in xs])
    visa, visa_seen, world, sponsor, fee = _v("visa_class"), _s("visa_class"), _v("home_world"), _v("sponsor_id"), _v("fee_status")
    diplomatic = visa_seen & true(visa == "DIP-1")
    flags = F.col("_flags")
    seen_flags = _s("risk_flags")
    arrival, receipt = iso_date(_v("arrival_date")), iso_date(_v("packet_receipt_date"))
    arrived = arrival.isNotNull() & _s("arrival_date")
    since = F.when(_s("packet_receipt_date") & receipt.isNotNull(), receipt).otherwise(lit(vocab.SNAPSHOT_DATE).cast("date"))
    stale = arrived & (F.datediff(since, arrival) > vocab.STALE_AFTER_DAYS)
    waiver, note = _marked("hardship_waiver"), _marked("diplomatic_note")
    fee_seen = _s("fee_status")
    needs_sponsor = visa_seen & true(visa != "DIP-1")
    sponsor_ok = needs_sponsor & sponsor.isNotNull() & _s("sponsor_id")
    stay = F.when(_v("stay_duration_days").try_cast("int") > 0, _v("stay_duration_days").try_cast("int"))
    limit = F.when(visa_seen, reduce(lambda c, k: c.when(visa == k, vocab.STAY_LIMITS[k]), list(vocab.STAY_LIMITS)[1:], F.when(visa == next(iter(vocab.STAY_LIMITS)), next(iter(vocab.STAY_LIMITS.values())))))
    stay_seen = _s("stay_duration_days") & stay.isNotNull() & limit.isNotNull()
    medical = visa_seen & true(visa == "MED-3")
    check, check_seen = _v("biohazard_check"), _s("biohazard_check")
    red, clean = medical & check_seen & true(check == "red"), medical & check_seen & true(check == "clean")
    slip = medical & ~red & ~clean & seen_flags & (F.size(flags) == 0) & true(F.col("risk_flags")["type"] == "biometric_slip")
    denial = _listed(
        [
            (_s("home_world") & (world.isin(vocab.EMBARGOED_WORLDS) | world.isin(vocab.NON_DIPLOMATIC_EMBARGOED_WORLDS) & visa_seen & (visa != "DIP-1")), F.concat(lit("embargoed_home_world:"), world)),
            (visa_seen & (visa == "TRANSIT-7"), lit("transit_work_authorization")),
            (fee_seen & (fee == "unpaid") & ~waiver, lit("unpaid_without_valid_waiver")),
            (sponsor_ok & sponsor.isin(vocab.BARRED_SPONSORS), F.concat(lit("barred_sponsor:"), sponsor)),
            (stale & ~diplomatic, lit("stale_application")),
            (stay_seen & (stay > limit), F.concat(lit("stay_limit_exceeded:"), visa)),
            (red, lit("biohazard_red")),
        ],
        F.when(seen_flags, F.transform(F.array_intersect(flags, any_of(vocab.DISQUALIFYING_FLAGS)), lambda x: F.concat(lit("disqualifying_flag:"), x))).otherwise(F.array().cast("array<string>")),
    )
    unknown = [(_state(f) != "resolved") & (lit(True) if f != "sponsor_id" else ~true(visa == "DIP-1")) for f in vocab.OUTPUT_FIELDS]
    review = _listed(
        [
            (fee_seen & (fee == "waived") & ~diplomatic & ~waiver, lit("unsupported_fee_waiver")),
            (fee.isNull() | (~(fee_seen & fee.isin("unpaid", "paid", "waived")) & (fee == "unknown")), lit("fee_status_unknown")),
            (~visa_seen, lit("visa_class_not_visible")),
            (needs_sponsor & sponsor.isNull(), lit("required_sponsor_unknown")),
            (needs_sponsor & sponsor.isNotNull() & ~_s("sponsor_id"), lit("required_sponsor_not_visible")),
            (arrival.isNull(), lit("arrival_date_unknown")),
            (arrival.isNotNull() & ~_s("arrival_date"), lit("arrival_date_not_visible")),
            (stale & diplomatic & ~note, lit("stale_diplomatic_note_missing")),
            (medical & ~red & ~clean & ~slip, lit("clean_biohazard_check_missing")),
            (~true(visa.isin(vocab.VISA_CLASSES)), lit("visa_class_unknown")),
            (true(F.col("rescinded")) & ~F.array_contains(flags, "rescinded_denial"), lit("review_flag:rescinded_denial")),
            (~(_state("risk_flags") == "resolved"), lit("risk_flags_unknown")),
            ((_state("risk_flags") == "resolved") & ~seen_flags, lit("risk_flags_not_visible")),
            *[(_state(f) == "contested", lit(f"contested_field:{f}")) for f in FIELDS],
            *[(u, lit(f"required_output_unknown:{f}")) for f, u in zip(vocab.OUTPUT_FIELDS, unknown, strict=True)],
            *[((_state(f) == "resolved") & ~_s(f), lit(f"required_output_not_visible:{f}")) for f in vocab.OUTPUT_FIELDS],
        ],
        F.transform(F.array_intersect(flags, any_of(vocab.REVIEW_FLAGS)), lambda x: F.concat(lit("review_flag:"), x)),
        F.transform(F.coalesce(F.col("linkage"), F.array().cast("array<string>")), lambda x: F.concat(lit("unresolved_linkage:"), x)),
    )
    facts = _listed(
        [
            (fee_seen & (fee == "paid"), lit("fee_paid")),
            (fee_seen & (fee == "waived") & (diplomatic | waiver), lit("valid_fee_waiver")),
            (sponsor_ok & ~sponsor.isin(vocab.BARRED_SPONSORS), lit("sponsor_present_and_not_publicly_barred")),
            (diplomatic, lit("diplomatic_sponsor_exemption")),
            (stale & diplomatic & note, lit("stale_diplomatic_note_exemption")),
            (arrived & ~stale, lit("application_date_current_or_exempt")),
            (stay_seen & (stay <= limit), lit("stay_within_visa_limit")),
            (clean, lit("clean_biohazard_check")),
            (slip, lit("no_visible_biohazard_risk")),
        ]
    )
    stamped = F.when(_s("adjudication") & F.col("adjudication")["type"].isin("adjudicator_stamp", "signed_manual_note"), _v("adjudication"))
    more = [c.alias(f"_carry{i}") for i, (_, c) in enumerate(carry)]
    out = prepared(cases).select("case_id", *more, stamped.alias("_stamp"), denial.alias("_denial"), review.alias("_review"), facts.alias("_facts"))
    decided = F.coalesce("_stamp", F.when(F.size("_denial") > 0, "DENIED").when(F.size("_review") > 0, "NEEDS_REVIEW").otherwise("APPROVED"))
    alone = F.array(lit("authoritative_visible_decision"))
    none = F.array().cast("array<string>")

    def told(name: str, of: str) -> Column:
        own = F.col(name)
        if of == "APPROVED":
            own = F.when(decided == "APPROVED", F.sort_array(F.array_append(own, "strict_approval_bar_cleared"))).otherwise(own)
        return F.when(F.col("_stamp").isNull(), own).when(F.col("_stamp") == of, alone).otherwise(none)

    return out.select(
        "case_id",
        decided.alias("decision"),
        F.col("_stamp").isNotNull().alias("authoritative"),
        told("_denial", "DENIED").alias("denial_reasons"),
        told("_review", "NEEDS_REVIEW").alias("review_reasons"),
        told("_facts", "APPROVED").alias("approval_facts"),
        *[F.col(f"_carry{i}").alias(name) for i, (name, _) in enumerate(carry)],
    )


def outputs() -> tuple:
    """(name, expression over prepared cases) of the output fields and their states: resolved values, priors and sentinels where unresolved."""
    cols = []
    for f in vocab.OUTPUT_FIELDS:
        spare = vocab.PRIORS.get(f) or vocab.SENTINELS.get(f) or ("none" if f == "risk_flags" else "unknown")
        v = F.coalesce(_v(f), F.lit(spare))
        if f == "risk_flags":
            absolute = _s("home_world") & true(_v("home_world").isin(vocab.EMBARGOED_WORLDS))
            every = F.sort_array(F.when(absolute, F.array_union(F.col("_flags"), F.array(F.lit("planetary_embargo")))).otherwise(F.col("_flags")))
            v = F.when(F.size(every) == 0, "none").otherwise(F.array_join(every, "|"))
        cols += [(f, v), (f"{f}_state", _state(f))]
    return tuple(cols)


def assemble(cases: DataFrame, *more: str, carry: tuple = ()) -> DataFrame:
    """Output rows of cases: fields, the state of each next to it, and the decision; further columns of adjudicate() by name.  One projection of the cases, without a join."""
    names = [n for n, _ in (*outputs(), *carry)]
    return adjudicate(cases, (*outputs(), *carry)).select("case_id", *names, F.col("decision").alias("adjudication"), *more)
