"""Every code of the audits of banks and papers on a record, header or note that breaks just that rule."""

import json

import pytest

from quillon.operators import audits

OPTIONS = [{"id": x, "text": f"choice {x}"} for x in "ABCD"]
BANK = {
    "external_id": "q-1", "question": "Which of the trees is balanced?", "options": OPTIONS, "course": "DS", "topic": "Trees", "correct_answer": "B", "question_type": "mcq", "difficulty": "easy", "marks": 1,
    "explanation": "It is the one whose heights agree.", "numerical_tolerance": None, "source_kind": "previous_year", "source_year": 2020, "source_paper": "CS-2020", "source_question_number": 7, "source_url": "u", "answer_key_url": "k", "topic_slug": "trees",
}
PAPER = BANK | {"safe_for_quiz": True, "status": "verified", "review_flags": []}
NAT = {"question_type": "nat", "options": []}
REVIEW = {"safe_for_quiz": False, "status": "review", "review_flags": ["checked"]}

#: What is changed (a text is the record itself, None takes a field away) and the codes that follow.
ANSWERS = [
    ({"options": OPTIONS[::-1]}, ["option_labels"]), ({"options": OPTIONS[:3] + ["D"], "correct_answer": "A"}, ["option_labels"]),
    ({"correct_answer": "E"}, ["mcq_answer"]), ({"correct_answer": ["B"]}, ["mcq_answer"]), ({"question_type": "msq", "correct_answer": ["A", "E"]}, ["msq_answer"]), ({"question_type": "msq", "correct_answer": []}, ["msq_answer"]),
    ({"question_type": "msq", "correct_answer": "A"}, ["msq_answer"]), ({"question_type": "msq", "correct_answer": ["A", "C"]}, []), (NAT | {"correct_answer": 2.5}, []), (NAT | {"correct_answer": {"min": 1, "max": 1.5}}, []),
    (NAT | {"correct_answer": {"min": 2, "max": 1}}, ["nat_answer"]), (NAT | {"correct_answer": "2"}, ["nat_answer"]), (NAT | {"correct_answer": True}, ["nat_answer"]), (NAT | {"correct_answer": {"min": 1, "max": 2, "unit": "m"}}, ["nat_answer"]),
    (NAT | {"options": OPTIONS, "correct_answer": 1}, ["nat_options"]),
]
BANK_CASES = ANSWERS + [
    ({"options": OPTIONS[:3]}, ["not_four_options"]), ({"options": "ABCD"}, ["not_four_options"]),
    ({}, []), ('"text"', ["not_an_object"]), ("{broken", ["not_an_object"]), (None, ["not_an_object"]), ({"marks": None, "difficulty": "odd"}, ["missing_fields"]),
    ({"external_id": "Q 1"}, ["external_id"]), ({"external_id": 12}, ["external_id"]), ({"external_id": "q-1\n"}, ["external_id"]), ({"question_type": "essay"}, ["question_type"]), ({"difficulty": "odd"}, ["difficulty"]), ({"source_kind": "web"}, ["source_kind"]), ({"marks": 3}, ["marks"]), ({"marks": "1"}, ["marks"]),
    ({"question": "  ", "source_kind": "original"}, ["empty_question"]), ({"explanation": "short"}, ["short_explanation"]), ({"source_url": ""}, ["provenance"]), ({"source_url": "", "source_kind": "original"}, []), ({"source_question_number": 8}, ["forced_review"]),
    ({"source_question_number": 9}, ["topic_override"]), ({"source_question_number": 9, "topic": "Heaps", "topic_slug": "heaps"}, []), ({"question": "Which holds? Q.1 - Q.5 carry one"}, ["boilerplate"]), ({"question": "Whichoneof the trees is balanced?"}, ["quality_gate"]),
    ({"question": "Question Number :7 Which is balanced?"}, ["number_prefix"]), ({"options": OPTIONS[:3], "source_url": ""}, ["not_four_options"]),
    ({"question_type": "msq", "correct_answer": ["A", "A"]}, ["msq_answer"]),
]
PAPER_CASES = ANSWERS + [
    ({"options": OPTIONS[:3]}, ["not_four_options", "option_labels"]), ({"options": "ABCD"}, ["mcq_answer", "not_four_options", "option_labels"]),
    ({}, []), ("[]", ["not_an_object"]), ({"course": None}, ["missing_fields", "unknown_topic"]), ({"source_paper": "CS-1999"}, ["unknown_paper"]), ({"source_question_number": 66}, ["number"]), ({"source_question_number": "7"}, ["number"]), ({"source_year": 2016}, ["year"]),
    ({"source_question_number": 9}, ["topic_override"]), ({"source_question_number": 8, "review_flags": ["figure"]}, ["forced_is_safe"]), (REVIEW | {"source_question_number": 8}, ["forced_reason_missing"]), (REVIEW | {"source_question_number": 8, "review_flags": ["figure"]}, []),
    ({"status": "review"}, ["safe_differs"]), (REVIEW | {"status": "verified"}, ["safe_differs"]), ({"safe_for_quiz": "true"}, ["review_flags_missing", "safe_differs"]), (REVIEW | {"review_flags": []}, ["review_flags_missing"]), (REVIEW | {"review_flags": "x"}, ["review_flags_missing"]),
    ({"question": "Which is it?"}, ["incomplete_text"]), ({"question": "Which holds? Q.1 - Q.5 carry one"}, ["boilerplate"]), ({"question": "Whichoneof the trees is balanced?"}, ["quality_gate"]), ({"question": "Question Number :7 Which is balanced?"}, ["number_prefix"]),
    ({"topic": "Bushes"}, ["unknown_topic"]), ({"question_type": "essay"}, ["question_type"]), (REVIEW | {"question_type": "essay", "question": "?"}, []), ({"question_type": "msq", "correct_answer": ["A", "A"]}, []),
]
FLAGS_TOO = {"number_prefix", "boilerplate"}


def text_of(base, change):
    if isinstance(change, dict):
        # marks and course are the fields that a case takes away; numerical_tolerance may be null
        return json.dumps({k: v for k, v in (base | change).items() if v is not None or k == "numerical_tolerance"})
    return change


@pytest.fixture(scope="module")
def reviews(spark):
    forced = spark.createDataFrame([("CS-2020", 8, "figure"), ("CS-2020", 8, "blur")], "paper string, number long, reason string")
    overrides = spark.createDataFrame([("CS-2020", 9, "DS", "Heaps", "heaps")], "paper string, number long, course string, topic string, topic_slug string")
    return forced, overrides


def found_of(df, scope):
    out = {}
    for r in df.where(df.scope == scope).collect():
        out.setdefault(r["key"], []).append(r["code"])
    return {k: sorted(v) for k, v in out.items()}


def records_of(spark, base, cases):
    return spark.createDataFrame([("b", k, text_of(base, change)) for k, (change, _) in enumerate(cases)], "bank string, position long, record string")


def check(got, cases):
    for k, (change, wanted) in enumerate(cases):
        codes = got.get(str(k), [])
        if FLAGS_TOO & set(wanted):
            codes = [c for c in codes if c != "quality_gate"]
        assert codes == wanted, (change, codes)


def test_bank_records(spark, reviews):
    rows = records_of(spark, BANK, BANK_CASES)
    header = spark.createDataFrame([("b", True, "1.0", "v", "t", True, True)], "bank string, is_object boolean, schema_version string, bank_version string, generated_at string, has_questions boolean, has_notes boolean")
    none = spark.createDataFrame([], "bank string, course string, topic string")
    notes = spark.createDataFrame([], "bank string, position long, record string")
    found = audits.bank_audit(header, rows, notes, none, *reviews, audits.BankPolicy(("DS", "OS"), 10, 5, 3))
    check(found_of(found, "question"), BANK_CASES)
    assert found_of(found, "course")["OS"] == sorted(["questions", "mcq", "msq", "nat", "marks_1", "marks_2", "variants"])
    assert found_of(found, "external_id") == {"q-1": ["repeated"]} and "bank" not in found_of(found, "bank")


def test_paper_records(spark, reviews):
    rows = records_of(spark, PAPER, PAPER_CASES)
    syllabus = spark.createDataFrame([("DS", "Trees", "trees")] * 2, "course string, topic string, topic_slug string")
    found = audits.paper_audit(rows, syllabus, *reviews, audits.PaperPolicy(("CS-2020", "CS-2021"), 65)).cache()
    check(found_of(found, "question"), PAPER_CASES)
    assert found_of(found, "paper") == {"CS-2020": ["size"], "CS-2021": ["absent", "size"], "CS-1999": ["unexpected"]}
    numbers = found_of(found, "number")
    assert len(numbers) == 130 - 3 and not {"CS-2020#7", "CS-2020#8", "CS-2020#9"} & set(numbers)
    assert [(r["found"], r["required"]) for r in found.where("scope = 'bank'").collect()] == [(len(PAPER_CASES), 130)]


def test_documents_and_notes(spark, reviews):
    note = {"course": " DS ", "topic": "Trees", "title": "t", "summary": "s", "reasoning_pattern": "r", "key_points": ["a", "b", "c"], "common_traps": ["a", "b", "c"]}
    broken = [note | {"title": " "}, note | {"summary": None}, note | {"key_points": ["a", "a ", "b"]}, note | {"common_traps": "abc"}, "text", note | {"topic": "Bushes", "title": ""}]
    whole = {"schema_version": "1.0", "bank_version": "v", "generated_at": "t", "questions": [], "revision_notes": [note]}
    documents = {
        "good": whole, "list": [], "other": {"schema_version": "2"}, "notes": whole | {"revision_notes": broken}, "empty": whole | {"bank_version": "", "generated_at": 0, "revision_notes": {}},
    }
    rows = [(k, json.dumps(d)) for k, d in documents.items()] + [("junk", "{"), ("null", None)]
    header, records, notes = audits.opened(spark.createDataFrame(rows, "bank string, document string"))
    topics = spark.createDataFrame([(b, "DS", "Trees") for b in ("good", "notes", "empty")], "bank string, course string, topic string")
    found = audits.bank_audit(header, records, notes, topics, *reviews, audits.BankPolicy((), 0, 0, 0)).cache()
    assert found_of(found, "bank") == {
        "list": ["not_an_object"], "junk": ["not_an_object"], "null": ["not_an_object"], "other": ["bank_version", "generated_at", "notes_not_a_list", "questions_not_a_list", "schema_version"], "empty": ["bank_version", "generated_at", "notes_not_a_list"],
    }
    assert found_of(found, "note") == {"0": ["title"], "1": ["summary"], "2": ["key_points"], "3": ["common_traps"], "4": ["not_an_object"]}
    per_topic = {(r["bank"], r["key"], r["code"], r["found"]) for r in found.where("scope = 'note_topic'").collect()}
    assert per_topic == {("notes", "DS/Trees", "repeated", 4), ("notes", "DS/Bushes", "unexpected", 1), ("empty", "DS/Trees", "missing", 0)}
