"""Routing of questions by policy: topics, personal advice, disclaimers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.masks import with_masked

# Fixed values.
LEGAL = ("attorney", "clause", "contract", "court", "lawsuit", "legal", "liability", "settlement", "sue", "trial")
MEDICAL = ("diagnosis", "doctor", "dosage", "medical", "medication", "prescription", "symptom", "treatment")
CUES = ("advice", "allowed", "case", "condition", "guidance", "help", "need", "situation")
FIRST_PERSON = r"(?iU)\b(i|me|my|mine|we|us|our|ours)\b"
PERSONAL = r"(?iU)^\s*(should|can|could|would|do|am)\s+(?:i|we)\b"
DISCLAIMERS = {
    "legal": "Note: this is general information, not legal advice. Consult a qualified attorney for advice specific to your situation.",
    "medical": "Note: this is general information, not medical advice. Consult a qualified healthcare professional.",
}
GREETING = "Hello! Ask me anything about your uploaded documents."


def topic(text: Column) -> Column:
    """medical, else legal, else null; keywords count inside words too."""
    low = F.lower(text)
    return F.when(low.rlike("|".join(MEDICAL)), F.lit("medical")).when(low.rlike("|".join(LEGAL)), F.lit("legal"))


def asks_for_advice(text: Column) -> Column:
    """A question for advice about the asker, on one of the topics."""
    return topic(text).isNotNull() & text.rlike(PERSONAL)


def is_ambiguous(text: Column) -> Column:
    """Speaks of the asker and has a cue: the cases that the fallback classifier sees."""
    return text.rlike(FIRST_PERSON) & F.lower(text).rlike("|".join(CUES))


def apply_policy(requests: DataFrame, text: str = "query", verdict: str | None = None) -> DataFrame:
    """``requests`` with masked, entities, disclaimer, refuse_reason, ask_fallback.

    ``verdict`` names a column with the fallback's answer for ambiguous questions (SAFE, DISCLAIMER, REFUSE); only REFUSE has an effect.
    """
    df = with_masked(requests.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text)
    df = df.withColumn("disclaimer", topic(F.col("masked"))).withColumn("personal", asks_for_advice(F.col("masked")))
    df = df.withColumn("ask_fallback", ~F.col("personal") & F.col("disclaimer").isNotNull() & is_ambiguous(F.col("masked")))
    refuse = F.when(F.col("personal"), F.lit("personalized_advice"))
    if verdict:
        refuse = refuse.when(F.col("ask_fallback") & (F.upper(F.trim(F.col(verdict))) == "REFUSE"), F.lit("personalized_advice"))
    return df.withColumn("refuse_reason", refuse).drop("personal")


def with_disclaimer(answer: Column, disclaimer: Column) -> Column:
    """The disclaimer before the stripped answer, once; an empty answer is the disclaimer alone. Without one the answer stays as it is."""
    from lodestrata.functions.text import strip

    out, bare = answer, strip(answer)
    for kind, text in DISCLAIMERS.items():
        put = F.when(bare.startswith(text), bare).when(bare == "", F.lit(text)).otherwise(F.concat(F.lit(text + "\n\n"), bare))
        out = F.when(disclaimer == kind, put).otherwise(out)
    return out


def exempt_sentences(answer: Column) -> Column:
    """How many leading sentences are a disclaimer's."""
    from lodestrata.functions.text import squeeze

    plain, out = squeeze(answer), F.lit(0)
    for text in DISCLAIMERS.values():
        out = F.when(plain.startswith(text), F.lit(text.count(". ") + 1)).otherwise(out)
    return out
