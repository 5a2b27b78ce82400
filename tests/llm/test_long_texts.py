"""Long texts without white space and long runs of each pattern's parts, in the operators that search for spans, and links against brute force."""

import random

import pytest

from strandline.llm import credential_links, line_rules, pii_labels, simhash_gray
from strandline.llm.spans import find, located

N = 100_000
PARTS = ["a@b" + ".c" * N, "a." * N + "@b.c", "1." * N + "1", "1-" * N + "1", "1 " * N + "1", "+1" + " 1" * N, "+1" * N, "A1" * N, "a1B" * N, "password=" * N, "user=" * N, "ab" * N, "AKIA" * N, "http://" + "a/" * N, "Mr. " * N, "Name: A" + "a" * N, "GB11" + "1111" * N, "x" * 5_000_000]


@pytest.mark.parametrize("operator", [pii_labels.personal_data, credential_links.secrets])
def test_no_pattern_overflows(spark, operator):
    docs = spark.createDataFrame(list(enumerate(PARTS)), "doc_id LONG, text STRING")
    rows = {r.doc_id: r for r in operator(docs).collect()}
    assert len(rows) == len(PARTS)
    if operator is pii_labels.personal_data:
        assert rows[0].n_email == 1 and f"email:0:{len(PARTS[0])}" in rows[0].spans


def test_other_operators_take_a_text_without_white_space():
    text = "aGVsbG8gd29ybGQ" * 333_334
    assert line_rules.judge(text, line_rules.LineRules())[0] == 1
    assert simhash_gray.fingerprint(text) == simhash_gray.fingerprint(text.lower())


@pytest.mark.parametrize("reach", [40, 300])
def test_links_are_those_of_all_pairs(spark, reach):
    pick = random.Random(reach)
    bits = ["user=admin7", "AB12CD34EF56GH78", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1", "postgres://db.example.com:5432/x", "password=hunter22", "deadbeefdeadbeefdeadbeef", "https://a.example.org/" + "x" * 400]
    texts = [" ".join(x for _ in range(12) for x in (pick.choice(bits), "w " * pick.randint(0, 60))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    found = located(find(docs, [*credential_links.STRONG, *credential_links.WEAK], "doc_id", "text")).select("_rid", "kind", "start", "end").distinct().collect()
    got = {tuple(r) for r in credential_links.links(spark.createDataFrame(found), reach).collect()}
    role = credential_links.ROLE
    want = {
        (a._rid, a.kind, a.start, a.end, b.kind, b.start, b.end)
        for a in found for b in found
        if a._rid == b._rid and (role[a.kind], role[b.kind]) in credential_links.NEEDS and 0 <= max(b.start - a.end, a.start - b.end) <= reach
    }
    assert got == want and want


def test_names_by_gazetteer_and_cues(spark):
    texts = ["Dear Mary Jones, we met.", "so Mary Jones wrote", "the accounts 12345678, 87654321 are", "numbers 12345678 here", "He saw Zed Quux there"]
    # Spans that teach what the labelers are worth.
    teach = [f"mail x{i}@example.com or call +1 (555) 010-{1000 + i}, 10.0.0.{i}; not 4111 1111 1111 1112" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + teach)), "doc_id LONG, text STRING")
    spans = {r.doc_id: r.spans for r in pii_labels.personal_data(docs).collect()}
    assert "name" in spans[0] and "name" in spans[1] and spans[3] == "" and spans[4] == ""
    assert spans[2].count("account") == 2
    more = {r.doc_id: r.spans for r in pii_labels.personal_data(docs, given=["Zed"]).collect()}
    assert "name" in more[4]
