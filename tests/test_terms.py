"""Words looked up by an automaton: the same as asking for each, and what regular expressions need."""

import random
import re

import pyarrow as pa
import pytest

from lexsieve.functions import rules as R
from lexsieve.functions import terms
from lexsieve.functions.dialect import SPARK
from lexsieve.plans import clauses
from lexsieve.plans.queries import PLANS, bound


def test_seen_is_what_each_text_holds():
    draw = random.Random(1)
    words = tuple(dict.fromkeys("".join(draw.choice("abé ") for _ in range(draw.randint(1, 5))) for _ in range(150)))
    texts = [None, "", "é" * 9, "a" * (terms.LONG + 5) + " b", *("".join(draw.choice("abcé ") for _ in range(draw.randint(0, 60))) for _ in range(400)), None]
    group = ((0, 7), (1, 3))
    for part in (pa.array(texts), pa.array(texts)[3:200], pa.array([], pa.string())):
        for text, bits in zip(part.to_pylist(), terms.seen(part, words, (group,)).to_pylist()):
            if text is None:
                assert bits is None
                continue
            *bits, count = bits
            held = [w for n, w in enumerate(words) if bits[n // terms.BITS] >> n % terms.BITS & 1]
            assert held == [w for w in words if w in text]
            assert count == sum(w in text for n, w in enumerate(words) if n in (0, 1, 2, 62, 63))


@pytest.mark.parametrize("text", ["Within six  hours", "by the FEMA 12/2020-RB", "Foreign\nExchange Management Act, 1999", "submit or file", "x"])
def test_needed_words_are_in_every_match(text):
    forms = [p for _, _, p in R.deadlines()] + R.references() + [p for _, p in R.effective_rules()] + [r"(?:submit|file)\b", r"(?:ab)?x", "ſ", "(?<a>b)"]
    for form in forms:
        sets = terms.needed(form)
        if "(?<a>" in form:
            assert sets == ()
        elif re.search(form, text):
            assert all(any(w in text.lower() for w in s) for s in sets)
    assert {"within"} in terms.needed(R.deadlines()[5][2]) and {"hours"} in terms.needed(R.deadlines()[5][2])


def test_rules_ask_no_text_word_by_word(spark):
    """Fails before: each of some 1200 words was searched for by itself, so that a clause took about a millisecond."""
    text = bound(spark, PLANS["confidence"])
    assert text.count("contains(") < 400 < SPARK.any_of("low", map(str, range(900))).count("contains(") and terms.Seeing.GROUP not in text
    before = clauses.PLANS["confidence"](SPARK)
    assert before.count("contains(") > 1000


def test_odd_clauses_have_the_findings_of_plain_sql(spark):
    odd = [(1, 1, "RBI", None), (1, 2, None, ""), (1, 3, "RBI", "Banks  shall\n submit reports  Within\t SIX\nHOURS; see the Companies\n Act, 2013"), (1, 3, "RBI", "Banks  shall\n submit"), (2, 4, "SEBI", "x" * 9000 + " the bank must not pay. Penalty of Rs. 5,000 and KYC İi")]
    odd.append((2, 5, "IRDAI", "These directions shall come\ninto force on 01.04.2026, effective  from the financial year"))
    spark.createDataFrame(odd, "doc_id bigint, section_id bigint, source string, clause_text string").createOrReplaceTempView("odd_clauses")
    base = "SELECT * FROM odd_clauses WHERE clause_text IS NOT NULL"
    got, want = (sorted(map(repr, spark.sql(t).drop("seen").collect())) for t in (bound(spark, clauses.resolved, base), clauses.resolved(SPARK, base)))
    assert got == want and len(got) == 5
    null = spark.sql(bound(spark, clauses.resolved, "SELECT * FROM odd_clauses WHERE clause_text IS NULL")).collect()
    assert len(null) == 1 and null[0].own_domain == "Other" and null[0].trigger_id is None


def test_clauses_are_spread_by_their_number(spark):
    text = bound(spark, PLANS["trigger_match"])
    assert f"REPARTITION({SPARK.TASKS}, o_custkey, k)" in text
