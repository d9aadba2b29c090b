"""The enhanced answer plan: history, stages of dependent answers, routes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellumine.plans import enhanced as P
from vellumine.workload import load
from vellumine.workload.enhanced import digest_answer

FOLDER = "/root/testdata/sf0.01"


def test_session_context(spark):
    """Entities of the assistant's messages among the last six before the query, in a conversation of any length."""
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"word{t} common{t}") for t in range(9000)]
    messages = spark.createDataFrame([*turns, (2, 0, "user", "hello there")], "conv_id int, turn int, role string, text string")
    asked = [("a", 1, 8998), ("b", 1, 0), ("c", 1, 99_999), ("d", 2, 0), ("e", 3, 4), ("f", None, None), ("g", 1, 4097)]
    found = {r["query_id"]: r for r in P.session_context(spark.createDataFrame(asked, "query_id string, conv_id int, turn int"), messages).collect()}
    assert {k: r["has_history"] for k, r in found.items()} == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": False, "g": True}
    turns_of = lambda k: sorted({e["timestamp"] for e in found[k]["entities"] or []})
    assert turns_of("a") == [8993, 8995, 8997] and turns_of("c") == [8995, 8997, 8999] and turns_of("g") == [4091, 4093, 4095]
    assert turns_of("b") == turns_of("d") == turns_of("e") == []
    assert {e["name"] for e in found["a"]["entities"]} == {f"{w}{t}" for w in ("word", "common") for t in (8993, 8995, 8997)}


def slow_answers(subs, context):
    out = {}
    for id_, text, deps in subs:
        known = "\n".join(f"Q: {t}\nA: {out[i]}" for i, t, _ in subs if i in deps)
        prompt = P.SUB_PROMPT % (text, context) + (P.KNOWN_ANSWERS % known if known else "")
        out[id_] = hashlib.md5(prompt.encode()).hexdigest()[:8]
    return out


def test_answers_in_stages(spark, monkeypatch):
    cases = {
        "x": [("sub_0", "one", []), ("sub_1", "of that", ["sub_0"]), ("sub_2", "two", []), ("sub_3", "of those", ["sub_0", "sub_1", "sub_2"])],
        "y": [("comp_0", "a", []), ("comp_1", "b", []), ("comp_analysis", "a and b", ["comp_0", "comp_1"])],
        "z": [("sub_0", "alone", [])],
    }
    stage = {"sub_1": 1, "sub_3": 2, "comp_analysis": 1}
    rows = [(q, n, i, t, d, stage.get(i, 0)) for q, subs in cases.items() for n, (i, t, d) in enumerate(subs)]
    subs = spark.createDataFrame(rows, "query_id string, no int, id string, text string, dependencies array<string>, stage int").repartition(4)
    contexts = spark.createDataFrame([("x", "facts"), ("y", "more facts")], "query_id string, context string")
    cuts = []
    cut = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    found = {(r["query_id"], r["id"]): r["answer"] for r in P.staged_answers(subs, contexts, digest_answer).collect()}
    assert len(cuts) == 3  # one a stage
    assert found == {(q, i): a for q, s in cases.items() for i, a in slow_answers(s, {"x": "facts", "y": "more facts"}.get(q, "")).items()}
    assert P.staged_answers(subs.where("false"), contexts, digest_answer).count() == 0


@pytest.mark.parametrize("name", ["enhanced_plan"])
def test_every_route_has_rows(spark, name):
    routes = {r["route"] for r in load()[0][name](spark, FOLDER).select("route").distinct().collect()}
    assert routes >= {"direct_generation", "multi_question_decomposition", "comparative_analysis", "hyde_multi_hypothesis", "contextual_rewrite", "temporal_boost", "standard_rag"}


def test_awkward_queries(spark):
    """Empty and null texts, no chunks: every query keeps one row, and those without hits ask back."""
    asked = spark.createDataFrame([(1, ""), (2, None), (3, "What is the price of the long train ride to the north?")], "query_id int, query string")
    chunks = spark.createDataFrame([], "doc_id int, text string")
    out = {r["query_id"]: r for r in P.enhanced_answers(chunks, asked, answer=digest_answer).collect()}
    assert out[1]["route"] == "direct_generation" and out[3]["route"] == "clarify" and out[3]["tier"] == "low" and "no_results" in out[3]["prompt"]
    assert set(out) == {1, 2, 3}


def test_model_as_pandas_udf(spark):
    @F.pandas_udf("string")
    def loud(prompts):
        return prompts.str.upper()

    subs = spark.createDataFrame([(1, 0, "sub_0", "one", [], 0), (1, 1, "sub_1", "that", ["sub_0"], 1)], "query_id int, no int, id string, text string, dependencies array<string>, stage int")
    out = {r["id"]: r["answer"] for r in P.staged_answers(subs, spark.createDataFrame([(1, "c")], "query_id int, context string"), loud).collect()}
    assert out["sub_1"].endswith(f"A: {out['sub_0']}".upper())
