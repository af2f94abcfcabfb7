import pytest
from pyspark.sql import functions as F

from weft import config
from weft.functions import stems
from weft.plans import results

GOOD = {"url": "https://chat.example.com/", "routes": [{"alias": "pay", "kind": "channel", "name": "payments", "scopes": ["x"]}], "concepts": {"outage": ["down", "not reachable"]}}


def test_config():
    c = config.load(GOOD)
    assert c.url == "https://chat.example.com" and c.routes[0].scopes == ("x",) and len(c.fingerprint()) == 64
    bad = [{**GOOD, "url": "http://chat.example.com"}, {**GOOD, "routes": GOOD["routes"] * 2}, {**GOOD, "budgets": {"max_characters": 1}}, {**GOOD, "other": 1}, {"url": "https://x"}, {**GOOD, "routes": [{"alias": "a", "kind": "mail", "name": "b"}]}]
    for raw in bad:
        with pytest.raises(config.InvalidConfig):
            config.load(raw)


# Vectors of the published algorithm.
@pytest.mark.parametrize("word, want", [("вавиловка", "вавиловк"), ("важная", "важн"), ("важнее", "важн"), ("валяется", "валя"), ("важничал", "важнича"), ("падаль", "падал"), ("паническое", "паническ"), ("сильнейшего", "сильн"), ("решили", "реш"), ("в", "в")])
def test_stems(word, want):
    assert stems.stem(word) == want


def test_stem_columns(spark):
    df = spark.createDataFrame([("Важная задача API",), ("plain text",), (None,)], "t string")
    assert [r["s"] for r in df.select(stems.stems(F.col("t")).alias("s")).collect()] == [["важн", "задач", "api"], ["plain", "text"], None]
    got = df.select(stems.concept_tokens(F.col("t"), {"text": ["plain text"], "no": ["none"]}).alias("c")).collect()
    assert got[1]["c"] == ["zzconcept74657874"] and got[0]["c"] == []


def test_envelopes(spark, tmp_path):
    ok = results.success("search", [1], ["w"])
    assert results.write_report(ok, str(tmp_path / "r.json"))["bytes"] > 10
    bad = results.failure("search", ValueError("x"), {"a": [{"apiToken": "s"}]})
    assert bad["error"]["details"] == {"a": [{"apiToken": "[REDACTED]"}]} and not bad["success"]
    assert results.as_json(spark.range(1)).first()["json"] == '{"id":0}'
    assert results.human([], "Threads").endswith("nothing found")
