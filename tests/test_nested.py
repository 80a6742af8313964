"""Nested events: each rule decides at least one field."""

import json

from siftlog.operators.nested import event_facts, event_fields


def found(spark, *events):
    df = spark.createDataFrame([(i, e if isinstance(e, str) or e is None else json.dumps(e)) for i, e in enumerate(events)], "id long, text string")
    fields = {}
    for r in event_fields(df, "id", "text").collect():
        assert r.field not in fields.get(r.id, {})
        fields.setdefault(r.id, {})[r.field] = r.value
    return fields, {r.id: r for r in event_facts(df, "id", "text").collect()}


SYSTEM = {"Provider": {"#attributes": {"Name": "MSSQL"}}, "Channel": "Application", "EventID": {"#attributes": {"Q": 1}, "#text": 15457}, "Computer": "db1", "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00Z"}}, "EventRecordID": 9}


def test_fields_of_every_depth(spark):
    fields, facts = found(
        spark,
        {"Event": {"System": SYSTEM, "EventData": {"Data": ["xp_cmdshell", "0", 5, "1", "User=ann\r\nUser= bob \tUserName=x"]}}},
        {"System": {"Channel": 3, "EventID": 7}, "EventData": {"Data": {"TargetUserName": "eve", "N": 4, "#text": "one 'acct' 'two words' SOME_STATE_CONST AND_TWO 8.8.8.8 10.0.0.1 08.8.8.8", "#x": "y"}}},
        {"System": {}, "EventData": {"Data": "lone " + "z" * 130}},
    )
    assert fields[0] == {"provider": "MSSQL", "channel": "Application", "event_id": "15457", "computer": "db1", "data[0]": "xp_cmdshell", "data[1]": "0", "data[2]": "1", "data[3]": "User=ann\r\nUser= bob \tUserName=x", "kv.User": "bob", "kv.UserName": "x"}
    assert fields[1] == {"event_id": "7", "data.TargetUserName": "eve", "data[0]": "one 'acct' 'two words' SOME_STATE_CONST AND_TWO 8.8.8.8 10.0.0.1 08.8.8.8"}
    assert 2 not in fields
    assert (facts[0].at, facts[0].record, facts[0].strings, facts[0].accounts) == ("2024-01-01T00:00:00Z", "9", 4, ["bob", "x"])
    assert (facts[1].constants, facts[1].accounts, facts[1].peers) == (["SOME_STATE_CONST"], ["acct", "eve"], ["8.8.8.8"])
    assert facts[2].strings == 1


def test_records_that_are_none(spark):
    fields, facts = found(spark, None, "", "not json", "[1, 2]", '"text"', "{}", '{"Event": null}', '{"a": 1, "a": 2}', {"Event": {"EventData": {"Data": [None, {"x": 1}, []]}}})
    assert fields == {}
    assert len(facts) == 9
    assert all((r.strings, r.constants, r.at) == (0, [], None) for r in facts.values())


def test_pairs_keep_the_last_of_many(spark):
    text = "\n".join(f"key{i % 50}={i}" for i in range(5000))
    fields, _ = found(spark, {"EventData": {"Data": [text]}})
    assert fields[0] == {f"kv.key{i % 50}": str(i) for i in range(4950, 5000)}


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"System": {"EventID": 7}}')], "id long, text string")
    plan = event_fields(df, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
