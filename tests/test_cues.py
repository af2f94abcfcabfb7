"""Cues, decisions, questions and acknowledgements on small messages."""

import pytest
from pyspark.sql import functions as F

from weft.functions import cues as C
from weft.operators import brief

POSTS = "id string, thread_id string, user_id string, create_at long, delete_at long, message string"


def read(spark, messages, users=None):
    rows = [(f"p{i}", "p0", (users or "ab" * len(messages))[i], i, 0, m) for i, m in enumerate(messages)]
    return brief.read(spark.createDataFrame(rows, POSTS))


@pytest.mark.parametrize(
    "message, kind",
    [
        ("Решили: фиксируем вариант B.", "approved_decision"),
        ("maybe going with B", "proposal"),
        ("Approved. Maybe we celebrate", "approved_decision"),
        ("We keep it on the backend", "proposal"),
        ("Я сделаю завтра", "implementation_intent"),
        ("обсудили вчера", "discussion_outcome"),
        ("They said approved?", None),
        ("this was not approved", None),
        ("какое решение утвердили", None),
        ("пересделаю", None),
    ],
)
def test_decisions(spark, message, kind):
    said = read(spark, [message])
    got = [r["decision_kind"] for r in brief.candidate_spans(said).where("kind = 'decision_candidate'").collect()]
    assert got == ([] if kind is None else [kind])


def test_an_agreeing_acknowledgement_promotes_an_intent(spark):
    said = read(spark, ["i'll go with B", "note", "aside", "Ok, do", "later"], "aabba")
    row = brief.candidate_spans(said).where("id = 'p0'").first()
    assert (row["decision_kind"], row["ack_id"], row["confidence"]) == ("approved_decision", "p3", 0.8)


def test_the_third_post_by_others_is_too_late(spark):
    said = read(spark, ["going to remove it", "one", "two", "ok"], "abcb")
    assert brief.acknowledgements(said).where("id = 'p0'").count() == 0


@pytest.mark.parametrize("message, kind", [("Это непонятно", "question"), ("tbd", "follow_up"), ("see https://x/?q=1 tbd", "follow_up"), ("готово?", "question")])
def test_questions(spark, message, kind):
    rows = brief.candidate_spans(read(spark, [message])).where("kind = 'open_question_candidate'").collect()
    assert [r["question_kind"] for r in rows] == [kind]


@pytest.mark.parametrize("message, token", [("Ок, делай", "ок"), ("окно", None), ("sounds good!", "sounds good"), ("+1", None), ("+ да", "+"), ("ok " + "x" * 40, None), ("  ", None)])
def test_acknowledgement_tokens(spark, message, token):
    df = spark.createDataFrame([(message,)], "m string").select(C.ack_token(F.col("m")).alias("t"))
    assert df.first()["t"] == token


def test_a_late_acknowledgement_needs_posts_between(spark):
    said = read(spark, ["going to remove it", "b1", "c1", "b2", "ok, sounds good"], "abcbc")
    made = brief.brief_decisions(brief.candidate_spans(said))
    assert [(r["decision_id"], r["ack_id"], r["confidence"]) for r in brief.late_acknowledgements(said, made).collect()] == [("p0", "p4", 0.57)]
    assert brief.late_acknowledgements(read(spark, ["going to remove it", "b1", "ok"], "abc"), made).count() == 0


def test_refinements_stop_at_the_next_decision(spark):
    said = read(spark, ["approved", "only for admins", "решили иначе", "to be clear, later"], "abab")
    made = brief.brief_decisions(brief.candidate_spans(said))
    got = sorted((r["decision_id"], r["id"]) for r in brief.refinements(said, made).collect())
    assert got == [("p0", "p1"), ("p2", "p3")]


def test_short_agreements_name_what_was_floated_before(spark):
    said = read(spark, ["maybe going with B", "hm", "можно делать"], "aba")
    made = brief.brief_decisions(brief.candidate_spans(said))
    assert [(r["decision_id"], r["id"]) for r in brief.antecedents(said, made).collect()] == [("p2", "p0")]


def test_no_posts(spark):
    said = brief.read(spark.createDataFrame([], POSTS))
    spans = brief.candidate_spans(said)
    assert spans.count() == 0 and brief.role_hints(said).count() == 0 and brief.brief_decisions(spans).count() == 0
