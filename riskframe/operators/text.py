"""Text and structured-reply operators (H1-H4, H11, L1-L6) over whole text columns.

All are narrow projections (no exchange); whole texts are processed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capitalize, map_lookup
from ..functions.maps import (CRISIS_HIT, CRISIS_KEYWORDS, CRISIS_MISS, ELEVATED_LEVELS, INSIGHT_ACTIONS,
                              INSIGHT_ACTIONS_ELEVATED, INSIGHT_ENCOURAGEMENT, INSIGHT_SAFETY_NOTE, JOURNAL_FALLBACK,
                              TONE_BY_LEVEL, TONE_DEFAULT)


def normalise_text(c: Column) -> Column:
    """H1: lower + strip."""
    return F.lower(F.trim(c))


def keyword_hit(text: Column, keywords: Sequence[str] = CRISIS_KEYWORDS, word_boundary: bool = False) -> Column:
    """H2: any keyword as a substring of lower(text) ('die' matches 'studied').

    ``word_boundary=True`` requires whole words instead.
    """
    low = F.lower(text)
    if word_boundary:
        import re
        pattern = r"\b(" + "|".join(re.escape(k) for k in keywords) + r")\b"
        return F.coalesce(low.rlike(pattern), F.lit(False))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.coalesce(low.contains(k), F.lit(False))
    return hit


def crisis_flag(df: DataFrame, text: str = "text", word_boundary: bool = False) -> DataFrame:
    """L1: keyword fallback classifier with the fixed replies."""
    hit = keyword_hit(F.col(text), word_boundary=word_boundary)

    def pick(field):
        a, b = CRISIS_HIT[field], CRISIS_MISS[field]
        if isinstance(a, list):
            return F.when(hit, F.array(*[F.lit(x) for x in a])).otherwise(F.array(*[F.lit(x) for x in b]))
        return F.when(hit, F.lit(a)).otherwise(F.lit(b))
    return df.withColumns({"crisis": hit, "riskLevel": pick("riskLevel"), "category": pick("category"),
                           "analysis": pick("analysis"), "suggestions": pick("suggestions")})


def tone(level: Column) -> Column:
    """L3: tone by risk level, default 'supportive'."""
    return map_lookup(TONE_BY_LEVEL, level, TONE_DEFAULT)


def insight_text(df: DataFrame, kind: str = "predictionType", level: str = "riskLevel", score: str = "score",
                 contributors: str = "contributors") -> DataFrame:
    """L2: rule-based insight (title, summary, why, actions, encouragement, safety note)."""
    risk = F.upper(F.coalesce(F.col(level), F.lit("MODERATE")))
    sc = F.coalesce(F.col(score).cast("string"), F.lit("50"))
    contrib = F.coalesce(F.col(contributors), F.array(F.lit("recent patterns")))
    k = F.col(kind)
    elevated = risk.isin(ELEVATED_LEVELS)
    return df.withColumns({
        "title": F.when(elevated, F.concat(F.lit("Elevated "), capitalize(k), F.lit(" Signals Detected")))
        .otherwise(F.concat(capitalize(k), F.lit(" Check-in"))),
        "summary": F.concat(F.lit("Your current score of "), sc, F.lit(" indicates a "), F.lower(risk),
                            F.lit(" level of "), F.lower(k), F.lit(".")),
        "why": F.concat(F.lit("This result is primarily influenced by: "), F.array_join(contrib, ", "), F.lit(".")),
        "actions": F.when(elevated, F.array(*[F.lit(a) for a in INSIGHT_ACTIONS_ELEVATED]))
        .otherwise(F.array(*[F.lit(a) for a in INSIGHT_ACTIONS])),
        "encouragement": F.lit(INSIGHT_ENCOURAGEMENT),
        "safetyNote": F.when(elevated, F.lit(INSIGHT_SAFETY_NOTE)),
        "tone": tone(risk),
    })


WEEKLY_SCHEMA = "title STRING, summary STRING, whatHelped STRING, challenges STRING, " \
                "recommendations ARRAY<STRING>, encouragement STRING"
WEEKLY_DEFAULTS = {"title": "Your Weekly Insight", "summary": "", "whatHelped": "", "challenges": "",
                   "encouragement": "Keep going! \U0001F31F"}
WEEKLY_FALLBACK = {"title": "Your Weekly Check-in", "summary": "We've analyzed your data for the week.",
                   "whatHelped": "Consistent check-ins helped track your patterns.",
                   "challenges": "Stay mindful of your stress levels.",
                   "recommendations": ["Log your mood daily", "Try a meditation"],
                   "encouragement": "You're doing great! \U0001F31F"}


def json_valid(text: Column) -> Column:
    """True when the whole text is exactly one JSON object.

    Spark's JSON readers ignore trailing characters (``{"k": 1}}`` parses);
    wrapping the text in ``[ ]`` makes any trailing garbage a syntax error.
    """
    one_value = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(one_value & F.ltrim(text).startswith("{"), F.lit(False))


def parse_with_defaults(df: DataFrame, text: str, schema: str, defaults: dict, fallback: dict | None = None,
                        list_heads: dict | None = None, out: str = "reply") -> DataFrame:
    """Parse a JSON reply; missing fields take defaults; lists cut to
    their first n; an unparseable text gives the whole-row fallback."""
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    ok = json_valid(F.col(text))
    fields = {}
    for f in [x.strip().split(" ")[0] for x in schema.split(",")]:
        v = parsed[f]
        if defaults and f in defaults:
            v = F.coalesce(v, F.lit(defaults[f]))
        if list_heads and f in list_heads:
            v = F.slice(F.coalesce(v, F.array().cast("array<string>")), 1, list_heads[f])
        if fallback is not None:
            fb = fallback.get(f)
            if isinstance(fb, list):
                fbv = F.array(*[F.lit(x) for x in fb]).cast("array<string>")
            else:
                fbv = F.lit(fb)
            v = F.when(ok, v).otherwise(fbv)
        fields[f] = v
    return df.withColumns({**{f"{out}_{k}": v for k, v in fields.items()}, f"{out}_valid": ok})


def fallback_flag(text: Column) -> Column:
    """AI available unless the reply carries the SYSTEM_FALLBACK marker."""
    return ~F.coalesce(text.contains("SYSTEM_FALLBACK"), F.lit(False))


# ------------------------------------------------------------------ typed replies over VARIANT
# --- fixed values: reply forms (field, type, default) and whole-reply fallbacks ---
REPLY_FORMS = {
    "weekly": [("title", "string", "Your Weekly Insight"), ("summary", "string", ""), ("whatHelped", "string", ""),
               ("challenges", "string", ""), ("recommendations", "array<string>", []), ("encouragement", "string", "Keep going! \U0001F31F")],
    "journal": [("tone", "string", None), ("emotionalScore", "double", None), ("summary", "string", None),
                ("suggestedAction", "string", None), ("detectedTriggers", "array<string>", None)],
    "tone": [("safe", "boolean", None), ("label", "string", None), ("action", "string", None), ("reason", "string", None)],
}
TONE_FALLBACK = {"safe": True, "label": "SAFE", "action": "ALLOW", "reason": "Fallback"}
REPLY_FALLBACKS = {"weekly": WEEKLY_FALLBACK, "journal": JOURNAL_FALLBACK, "tone": TONE_FALLBACK}
REPLY_LIST_HEADS = {"weekly": {"recommendations": 3}}
#: How ``schema_of_variant`` names the types that a field may have.
_VARIANT_KINDS = {"string": r"STRING", "double": r"BIGINT|DOUBLE|DECIMAL\(.*", "boolean": r"BOOLEAN", "array<string>": r"ARRAY<.*"}


def _plain(value, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def typed_reply(df: DataFrame, text: str, form: str, out: str = "reply") -> DataFrame:
    """The fields of a reply form out of a JSON text, as ``<out>_<field>``, and ``<out>_valid``.

    A text that is not exactly one JSON object gives the form's whole fallback.  In an object, an absent field or one of
    another type takes the form's default, an explicit null stays NULL, and lists are cut to their first entries where
    the form says so (entries that are no text become their JSON text)."""
    parsed = F.try_parse_json(F.col(text))
    # the parser stops after the first value; json_valid sees what follows it
    valid = json_valid(F.col(text)) & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    fields = {}
    for name, kind, default in REPLY_FORMS[form]:
        node = F.try_variant_get(parsed, f"$.{name}", "variant")
        fits = F.coalesce(F.regexp_like(F.schema_of_variant(node), F.lit(f"^({_VARIANT_KINDS[kind]})$")), F.lit(False))
        value = F.when(F.coalesce(F.is_variant_null(node), F.lit(False)), F.lit(None).cast(kind)).when(
            fits, F.try_variant_get(parsed, f"$.{name}", kind)).otherwise(_plain(default, kind))
        if head := REPLY_LIST_HEADS.get(form, {}).get(name):
            value = F.slice(value, 1, head)
        fields[f"{out}_{name}"] = F.when(valid, value).otherwise(_plain(REPLY_FALLBACKS[form][name], kind))
    return df.withColumns({**fields, f"{out}_valid": valid})
