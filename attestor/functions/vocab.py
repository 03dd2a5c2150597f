"""Fixed values of the domain: field lists, policy constants and weights."""

# Outputs in order, decisions, fees and visas.
OUTPUT_FIELDS = ["applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "risk_flags", "fee_status"]
DECISIONS = ["APPROVED", "DENIED", "NEEDS_REVIEW"]
FEES = ["paid", "waived", "unpaid", "unknown"]
VISA_CLASSES = ["XW-1", "XW-2", "DIP-1", "MED-3", "TRANSIT-7"]

# Policy.
BARRED_SPONSORS = ["SPN-0007", "SPN-0139", "SPN-2718", "SPN-4040", "SPN-7331", "SPN-9090"]
EMBARGOED_WORLDS = ["Eris Relay", "TRAPPIST-1e"]
NON_DIPLOMATIC_EMBARGOED_WORLDS = ["Wolf-1061c"]
DISQUALIFYING_FLAGS = ["memory_tampering", "planetary_embargo", "active_warrant", "biohazard_red"]
REVIEW_FLAGS = ["identity_conflict", "sponsor_mismatch", "illegible_biometrics", "rescinded_denial"]
STAY_LIMITS = {"XW-1": 30, "XW-2": 180}
STALE_AFTER_DAYS = 180
SNAPSHOT_DATE = "2026-07-07"

# Points of the fields in scoring.
FIELD_WEIGHTS = {
    "applicant_name": 5,
    "species_code": 6,
    "home_world": 5,
    "visa_class": 5,
    "sponsor_id": 5,
    "arrival_date": 4,
    "declared_purpose": 3,
    "risk_flags": 8,
    "fee_status": 4,
}

# What stands for a field that stays unresolved.
PRIORS = {"species_code": "TRIANGULAN", "home_world": "Wolf-1061c", "visa_class": "MED-3", "declared_purpose": "reactor maintenance", "fee_status": "paid"}
SENTINELS = {"sponsor_id": "SPN-0000", "arrival_date": "1900-01-01"}

# Source precedence, best first.
EVIDENCE_RANK = {"adjudicator_stamp": 1, "signed_manual_note": 1, "intake_form": 2, "biometric_slip": 3, "sponsor_attestation": 4, "registry_extract": 5, "text_layer": 6}

# Features that calibration knows.
SAFE_SUFFIX_PREFIXES = ["contested_field", "disqualifying_flag", "required_output_not_visible", "required_output_unknown", "review_flag"]
KNOWN_FEATURES = [
    "application_date_current_or_exempt",
    "arrival_date_not_visible",
    "arrival_date_unknown",
    "authoritative_visible_decision",
    "biohazard_red",
    "clean_biohazard_check",
    "clean_biohazard_check_missing",
    "conflicting_generalizable_exceptions",
    "diplomatic_sponsor_exemption",
    "fee_paid",
    "fee_status_unknown",
    "no_visible_biohazard_risk",
    "packet_receipt_date_unknown",
    "required_sponsor_absent",
    "required_sponsor_not_visible",
    "required_sponsor_unknown",
    "risk_flags_not_visible",
    "risk_flags_unknown",
    "sponsor_present_and_not_publicly_barred",
    "stale_application",
    "stale_diplomatic_note_exemption",
    "stale_diplomatic_note_missing",
    "stay_duration_unknown",
    "stay_within_visa_limit",
    "strict_approval_bar_cleared",
    "transit_work_authorization",
    "unpaid_without_valid_waiver",
    "unsupported_fee_waiver",
    "valid_fee_waiver",
    "validated_generalizable_exception",
    "visa_class_not_visible",
    "visa_class_unknown",
]

# Output ridge, by feature in order.
RIDGE = {
    "bias": 0.13903222479136218,
    "p": 0.8981349771563721,
    "p2": -0.2909134823332467,
    "output=APPROVED": 0.4136909689555733,
    "output=DENIED": -0.21344825389735364,
    "output=NEEDS_REVIEW": -0.20024271504648142,
    "p_output=APPROVED": -0.13687921630225658,
    "p_output=DENIED": 0.5151889043484748,
    "p_output=NEEDS_REVIEW": 0.5198252891097424,
    "unknown=applicant_name": -0.0716261111966837,
    "unknown=species_code": 0.0,
    "unknown=home_world": 0.0,
    "unknown=visa_class": 0.0,
    "unknown=sponsor_id": -0.058110394219331465,
    "unknown=arrival_date": 0.03434731010064963,
    "unknown=declared_purpose": 0.0,
    "unknown=risk_flags": 0.0,
    "unknown=fee_status": 0.07923183413989741,
    "unknown_count": -0.0017952623528308652,
    "risk_non_none": -0.024530228664862604,
    "fee_paid": -0.01626187083638472,
    "fee_waived": -0.037362338560018714,
    "fee_unpaid": -0.025607624737578306,
    "fee_unknown": 0.07923183413991697,
}
RIDGE_CLIP, RIDGE_GUARD = (0.02, 0.98), ("NEEDS_REVIEW", 0.9)

# Risk flags, and patterns of phrases that stand for one.
RISK_FLAGS = [*DISQUALIFYING_FLAGS, *REVIEW_FLAGS]
RISK_PHRASES = {"identity_conflict": r"(?i)identity.*(mismatch|conflict|failed)", "illegible_biometrics": r"(?i)biometric.*(illegible|unreadable|failed)"}

# Label before a list of risk flags, how similar an item must be to a flag, and items that are none.
RISK_LABEL, RISK_CUTOFF, RISK_FILLERS = r"(?i)(?:risk\s+flags?|observed\s+flags?)\s*(?::|=|-)?\s*(.*)$", 0.72, ["none", "reason", "disqualifying"]

# What a sponsor's sentence says, by field (first group).
SPONSOR_SENTENCE = {
    "sponsor_id": r"(?i)\bsponsor\s+(SP[NM]\s*[-:]?\s*[0-9OQCDILSB\s]{4,10})\b",
    "applicant_name": r"(?i)\battests?\s+that\s+([A-Za-z]+\s+[A-Za-z]+)\s+is\s+expected\b",
    "declared_purpose": r"(?i)\bis\s+expected\s+on\s+earth\s+for\s+(.+?)(?:\.\s+the\s+sponsor|\.\s+this\s+attestation|$)",
    "visa_class": r"(?i)\bclass\s+([A-Za-z0-9._-]+)\s+compliance\b",
}
# Explicit fee facts of a note.
FEE_PHRASES = {"unpaid": r"(?i)\bmandatory\s+fee\s+(is\s+)?unpaid\b", "unknown": r"(?i)\bfee\s+status\s*(:|=|-)?\s*(is\s+)?unknown\b"}
