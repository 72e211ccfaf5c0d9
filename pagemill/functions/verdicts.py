"""Model answers: from raw text to typed columns, as Catalyst expressions.

Divergence kept on purpose: an answer that a strict reader would abort on (a word
as confidence, a broken object) becomes null here and takes its kind's default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals by the side of the boundary on which they stand.
START_SIGNALS = ["titled_id_header", "fresh_letterhead", "header_block_reset", "appendix_heading", "blank_form", "page_number_reset", "stamp_change"]
END_SIGNALS = ["signature_block", "project_signoff", "table_end"]
SIGNOFF_SIGNALS = ["signature_block", "project_signoff"]
CAPPED_SIGNALS = ["table_end", "page_number_reset", "stamp_change"]
NEVER_END = ["table_continuation", "blank_signature_fields", "same_letterhead", "none"]
UNCONFIRMED_OK = ["fresh_letterhead", "header_block_reset", "titled_id_header"]
CONFIRM_BELOW, REVIEW_BELOW, CAP = 0.75, 0.80, 0.60


def clean_response(raw: Column) -> Column:
    """Without thinking blocks and code fences, trimmed."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), "(?s)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, "(?s)```(?:json)?\\s*(.*?)\\s*```", "$1")
    return F.regexp_replace(bare, "^(?U:\\s)+|(?U:\\s)+$", "")


def json_object(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``; null where there is none."""
    found = F.regexp_extract(clean_response(raw), "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def _parsed(raw: Column) -> Column:
    """The object inside an array: the parser alone would stop behind it and accept what follows."""
    return F.try_parse_json(F.concat(F.lit("["), json_object(raw), F.lit("]")))


def json_value(raw: Column, name: str) -> Column:
    """One top-level field as a variant; null when absent, or when the object as a whole doesn't parse."""
    return F.try_variant_get(_parsed(raw), f"$[0].{name}", "variant")


def json_field(raw: Column, name: str) -> Column:
    """One top-level field as text; null when absent, null itself or in a broken object."""
    return F.try_variant_get(_parsed(raw), f"$[0].{name}", "string")


def truthy_field(raw: Column, name: str, default: bool) -> Column:
    """JSON truth of a top-level field: null, false, 0 and empty ones are false, so "false" in quotes is true."""
    value, text = json_value(raw, name), json_field(raw, name)
    kind = F.schema_of_variant(value)
    true = F.when(kind == "VOID", F.lit(False)).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(F.rlike(kind, F.lit("^(ARRAY|OBJECT)")), ~text.isin("[]", "{}")).otherwise(text.try_cast("double") != 0)
    return F.when(value.isNull(), F.lit(default)).otherwise(F.coalesce(true, F.lit(False)))


def confidence(value: Column, default: float = 50.0) -> Column:
    """0..1 from a 0..100 answer, clamped."""
    x = F.coalesce(value.try_cast("double"), F.lit(default))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)) / 100.0


def leading_int(value: Column, default: int = 19999) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(value.cast("string")), "^\\d+", 0).try_cast("int"), F.lit(default))


def real_end(is_end: Column, signal: Column) -> Column:
    """An end whose signal says the opposite is none."""
    return is_end & ~signal.isin(NEVER_END)


def grounded(value: Column) -> Column:
    return ~F.lower(F.coalesce(value, F.lit(""))).isin("", "none")


def style_break(letterhead_match: Column, layout_prev: Column, layout_curr: Column) -> Column:
    """A changed letterhead or layout; an unknown letterhead is no change, equal or missing layouts are none."""
    return (letterhead_match.eqNullSafe(F.lit(False))) | ~layout_prev.eqNullSafe(layout_curr)


def needs_confirmation(is_end: Column, conf: Column, signal: Column) -> Column:
    return is_end & (conf < CONFIRM_BELOW) & ~signal.isin(UNCONFIRMED_OK)


def review_flag(conf: Column, page: Column) -> Column:
    return (conf < REVIEW_BELOW) & (page != 1)


def osd_degrees(orientation: Column, orientation_conf: Column, least: float = 3.0) -> Column:
    """Counter-clockwise degrees of an orientation detector; null (abstains) below ``least``."""
    deg = F.when(orientation.isin(0, 90, 180, 270), orientation).otherwise(0)
    return F.when(orientation_conf >= least, deg)


def osd_confidence(orientation_conf: Column) -> Column:
    return F.least(F.lit(0.95), orientation_conf / 10.0)


def model_rotation(rotation: Column, conf: Column, threshold: int = 95) -> Column:
    """The model's own answer, believed only when it is sure."""
    return F.when(~rotation.isin(0, 90, 180, 270) | rotation.isNull(), 0).when((rotation != 0) & (conf < threshold), 0).otherwise(rotation)


def corroborated_rotation(rotation: Column, corr_rotated: Column, corr_deg: Column) -> Column:
    """Model and corroborator together: both rotated, the model's angle; only the corroborator, its angle (90 unknown); else 0."""
    valid = F.when(rotation.isin(0, 90, 180, 270), rotation).otherwise(F.lit(None))
    return (
        F.when(valid.isNull() | corr_rotated.isNull() | ~corr_rotated, 0)
        .when(valid != 0, valid)
        .otherwise(F.coalesce(corr_deg, F.lit(90)))
    )


def aspect_rotation(width: Column, height: Column, ratio: float = 1.15) -> Column:
    return F.when(width > height * ratio, 90).otherwise(0)


def ccw(original: Column, split: Column) -> Column:
    """Counter-clockwise degrees that undo the clockwise change of page metadata."""
    return F.pmod(360 - F.pmod(split - original, F.lit(360)), F.lit(360))
