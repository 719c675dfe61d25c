"""Prompt texts around metric documents, chat history and parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The texts put around a metric document.
SUMMARY_LEAD = (
    "Write a concise (3-4 sentence) executive summary of this service's "
    "performance based on the metrics below. Reference specific numbers.\n\n"
    "Metrics JSON:\n"
)
INCIDENT_LEAD = (
    "Given this incident's metrics, respond ONLY with JSON in the form "
    '{"potential_causes": [".."], "recommended_investigation": [".."]}. '
    "List 2-5 potential causes and 2-5 concrete investigation steps. "
    "Do not include any text outside the JSON object.\n\n"
    "Incident metrics JSON:\n"
)
SERVICE_LEAD = (
    "Given this service's current performance metrics, respond ONLY "
    'with JSON in the form {"potential_issues": [".."], '
    '"recommended_investigation": [".."]}. List 2-5 potential issues '
    "(only ones the metrics actually support) and 2-5 concrete "
    "investigation steps. If nothing in the metrics looks concerning, "
    "return two empty lists. Do not include any text outside the JSON "
    "object.\n\n"
    "Service metrics JSON:\n"
)
CHAT_LEAD = "Relevant metrics JSON:\n"
CHAT_QUESTION = "\n\nQuestion: "
CHAT_TAIL = (
    "\nAnswer using only the metrics above. Structure your answer as: "
    "1) a short direct answer citing specific numbers from the JSON, "
    "2) if relevant, a 'Potential areas to investigate' list, "
    "3) end with a line reading exactly 'Confidence: Based on computed "
    "metrics.' If the metrics don't contain enough information to "
    "answer, say so explicitly instead of guessing."
)


def summary_prompt(context: Column) -> Column:
    return F.concat(F.lit(SUMMARY_LEAD), context)


def incident_prompt(context: Column) -> Column:
    return F.concat(F.lit(INCIDENT_LEAD), context)


def service_prompt(context: Column) -> Column:
    return F.concat(F.lit(SERVICE_LEAD), context)


def chat_prompt(question: Column, context: Column, history: Column | None = None) -> Column:
    """Optional history, the document, the question and the answering rules."""
    text = F.concat(F.lit(CHAT_LEAD), context, F.lit(CHAT_QUESTION), question, F.lit(CHAT_TAIL))
    if history is None:
        return text
    return F.concat(F.coalesce(F.concat(history, F.lit("\n")), F.lit("")), text)


def _lines() -> Column:
    """All turns of a group in order, as (turn, line). They go into one text, so their size is the conversation's own."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line")
    return F.array_sort(F.collect_list(F.struct("turn", line)))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def history(conversations: DataFrame) -> DataFrame:
    """``role: text`` lines of each conversation in turn order, joined by newlines."""
    return conversations.groupBy("conv_id").agg(_joined(_lines()).alias("history"))


def questions_with_history(conversations: DataFrame) -> DataFrame:
    """The last user turn of each conversation (turn, question) and all turns before it (history, null if there are none)."""
    asked = F.col("role") == "user"
    last = conversations.groupBy("conv_id").agg(
        F.max(F.when(asked, F.col("turn"))).alias("turn"),
        F.max_by(F.when(asked, F.col("text")), F.when(asked, F.col("turn"))).alias("question"),
        _lines().alias("lines"),
    )
    before = F.filter("lines", lambda x: x["turn"] < F.col("turn"))
    some = F.when(F.size(before) > 0, _joined(before))
    return last.where("turn IS NOT NULL").select("conv_id", "turn", "question", some.alias("history"))


def with_preface(preface: str, prompt: Column) -> Column:
    """A fixed text before a prompt, with an empty line between."""
    return F.concat(F.lit(preface), F.lit("\n\n"), prompt)


def parse_answer(raw: Column, list_name: str = "potential_causes") -> Column:
    """Struct of two text lists from a model's answer.

    Surrounding white space and back-ticks and a leading ``json`` are removed. The
    rest has to be exactly one JSON object; missing lists are empty. Anything else
    gives the raw answer as the only item of the first list.
    """
    bare = F.btrim(strip(raw), F.lit("`"))
    body = F.when(F.lower(F.left(bare, F.lit(4))) == "json", F.substr(bare, F.lit(5))).otherwise(bare)
    # Inside brackets, text after the object makes the JSON invalid or a second item.
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    kind = F.schema_of_variant(F.try_variant_get(wrapped, "$[0]", "variant"))
    single = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    is_object = F.coalesce(kind.startswith("OBJECT") & single, F.lit(False))
    empty = F.array().cast("array<string>")

    def items(name: str) -> Column:
        return F.coalesce(F.try_variant_get(wrapped, f"$[0].{name}", "array<string>"), empty)

    return F.struct(
        F.when(is_object, items(list_name)).otherwise(F.array(raw)).alias(list_name),
        F.when(is_object, items("recommended_investigation")).otherwise(empty).alias("recommended_investigation"),
    )
