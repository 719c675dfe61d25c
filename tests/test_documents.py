import json

import pytest
from pyspark.sql import functions as F

from weirlog.operators import incidents, metrics
from weirlog.plans import contexts, prompts


def test_summary_documents(logs):
    rows = {(r.service, r.release): json.loads(r.context) for r in contexts.summary_contexts(logs).collect()}
    assert len(rows) == 4 * 3 + 4 + 3 + 1
    everything = json.loads(contexts.summary_context(logs).first().context)
    assert rows["all services", "all releases"] == everything
    one = json.loads(contexts.summary_context(logs, "user-service", "v2.0").first().context)
    assert rows["user-service", "v2.0"] == one and one["active_services"] == 1
    assert list(everything) == [*metrics.KPI_COLUMNS, "service", "release"]


def test_incident_document_of_a_service_without_logs(make_logs):
    table = incidents.as_incidents(incidents.detect(make_logs({"status_code": 500})), F.lit("2024-01-01"))
    document = json.loads(contexts.incident_contexts(table, make_logs({"service_name": "other"})).first().context)
    assert document["current_metrics"] == {
        **dict.fromkeys(metrics.KPI_COLUMNS, 0), "availability_percent": 100.0,
    }
    assert document["incident_title"] == "High Error Rate — auth-service"


def test_service_and_chat_documents(logs):
    services = {r.service: json.loads(r.context) for r in contexts.service_contexts(logs).collect()}
    check = services["order-service"]["regression_check"]
    assert [c["release_version"] for c in check] == ["v1.0", "v1.1", "v2.0"]
    assert check[0]["previous_release_version"] is None
    chat = json.loads(contexts.chat_context(logs).first().context)
    assert list(chat) == ["overview", "services", "slowest_endpoints", "releases", "regions"]
    slow = [e["p95_latency_ms"] for e in chat["slowest_endpoints"]]
    assert slow == sorted(slow, reverse=True) and len(slow) == 10
    assert [s["service_name"] for s in chat["services"]] == sorted(services)


def test_history_is_whole_and_in_turn_order(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t}") for t in range(2500)]
    turns += [(2, 0, "user", "hi"), (3, 0, "assistant", "no question")]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    lines = [f"{r}: {x}" for _, _, r, x in turns[:2500]]
    whole = {r.conv_id: r.history for r in prompts.history(table).collect()}
    assert whole == {1: "\n".join(lines), 2: "user: hi", 3: "assistant: no question"}
    asked = {r.conv_id: (r.turn, r.question, r.history) for r in prompts.questions_with_history(table).collect()}
    assert asked == {1: (2498, "line 2498", "\n".join(lines[:2498])), 2: (0, "hi", None)}
    assert spark.range(1).select(prompts.with_preface("Be brief.", F.lit("x"))).first()[0] == "Be brief.\n\nx"


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.chat_prompt(F.lit("why?"), F.lit("{}"), F.lit("user: hi")).alias("with_history"),
        prompts.chat_prompt(F.lit("why?"), F.lit("{}")).alias("without"),
        prompts.summary_prompt(F.lit("{}")).alias("summary"),
    ).first()
    assert row.with_history == "user: hi\n" + row.without
    assert row.without.startswith("Relevant metrics JSON:\n{}\n\nQuestion: why?\nAnswer using only")
    assert row.summary.endswith("Metrics JSON:\n{}")


RAW = "raw answer kept"


@pytest.mark.parametrize(
    "answer, causes, steps",
    [
        ('```json\n{"potential_causes": ["a", "b"], "recommended_investigation": ["c"]}\n```', ["a", "b"], ["c"]),
        (' {"potential_causes": ["a"]} ', ["a"], []),
        ("{}", [], []),
        ('JSON{"recommended_investigation": ["x"]}', [], ["x"]),
        ("plain text", RAW, []),
        ("[1]", RAW, []),
        ("", RAW, []),
        ("3", RAW, []),
        ('{"potential_causes": ["a"]} and more', RAW, []),
        ('{"potential_causes": ["a"]},{"b": 1}', RAW, []),
        ('{"potential_causes": ["a"', RAW, []),
    ],
)
def test_answers(spark, answer, causes, steps):
    table = spark.createDataFrame([(answer,)], "answer string")
    parsed = table.select(prompts.parse_answer(F.col("answer")).alias("p")).select("p.*").first()
    assert parsed.potential_causes == ([answer] if causes is RAW else causes)
    assert parsed.recommended_investigation == steps


def test_answers_about_services(spark):
    table = spark.createDataFrame([('{"potential_issues": ["i"]}',)], "answer string")
    parsed = table.select(prompts.parse_answer(F.col("answer"), "potential_issues").alias("p")).select("p.*").first()
    assert (parsed.potential_issues, parsed.recommended_investigation) == (["i"], [])
