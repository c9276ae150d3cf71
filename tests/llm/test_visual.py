"""Forms, tries and pairs of texts that look the same."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointgate.llm.lookalikes import skeleton
from pointgate.llm.visual import Trie, canonical, visual_forms, visual_pairs


@pytest.mark.parametrize(
    ("a", "b"),
    [("caf\u00e9", "cafe\u0301"), ("\uff37ide \uff11\uff12", "Wide 12"), ("zero\u200bwidth", "zerowidth"), ("no\u00a0break", "no break"), ("\u0420aul", "Paul"), ("\ufb01n", "fin"), ("soft\u00adhyphen", "softhyphen"), ("thin\u2009", "thin ")],
)
def test_same_look(a, b):
    assert skeleton(a) == skeleton(b) and a != b


@pytest.mark.parametrize(("a", "b"), [("cafe", "caf\u00e9"), ("Paul", "paul"), ("a1", "al"), ("two  blanks", "two blanks"), ("a\nb", "a b"), ("O", "0"), ("word", "words"), ("a.", "a")])
def test_other_look(a, b):
    assert skeleton(a) != skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_its_own_form(text):
    assert skeleton(skeleton(text)) == skeleton(text)


def test_trie_walks_at_no_cost_only_over_look_alikes():
    trie = Trie()
    for w, n in (("Paul", 5), ("Pauls", 2), ("\u0421\u0430\u0440\u0430", 9), ("\u00e9clair", 1)):
        trie.add(w, n)
    assert canonical("\u03a1\u0430ul", trie) == "Paul" and canonical("Pa\u200bul", trie) == "Paul"
    assert canonical("Capa", trie) == "\u0421\u0430\u0440\u0430" and canonical("e\u0301clair", trie) == "\u00e9clair" and canonical("eclair", trie) == "eclair"
    assert canonical("\u0420\u0430ulz", trie) == "Paulz"
    assert {s for _, s, _ in trie.walk("Paul", budget=1)} == {"Paul", "Pauls"}
    trie.add("Capa", 1)
    assert canonical("\u0421\u0430\u0440\u0430", trie) == "Capa"


DOCS = [
    (1, "The Paul ran."), (2, "The \u0420aul ran."), (3, "The Paul ran."), (4, "The Pa\u200bul ran\uff0e"), (5, "the Paul ran."), (6, None), (7, ""), (8, "\u00a0\n"), (9, "\u200b"), (10, "\u041f\u0451\u0442\u0440 \u0431\u0435\u0436\u0430\u043b"), (11, "\u041f\u0435\u0308\u0442\u0440 \u0431\u0435\u0436\u0430\u043b"), (12, "\u041f\u0435\u0442\u0440 \u0431\u0435\u0436\u0430\u043b"), (1, "The Paul ran."),
]


def test_pairs(spark):
    df = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id int, text string, form string")
    got = visual_pairs(df, document="doc_id").collect()
    assert {tuple(r) for r in got} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)} and len(got) == 6
    forms = {r["doc_id"]: r["form"] for r in visual_forms(df, document="doc_id").collect()}
    assert forms[1] == forms[2] == forms[4] == "The Paul ran." and forms[10] == forms[11] != forms[12] and 6 not in forms and forms[7] == ""


def test_many_tries_give_the_same(spark):
    from pointgate.llm.visual import canonical_spellings

    texts = spark.createDataFrame([(t,) for _, t in DOCS if t] + [("Pauls \u0420aulz",)], "_text string")
    for budget in (0.0, 1.0):
        one, many = (sorted(map(tuple, canonical_spellings(texts, budget=budget, trie_words=n).collect())) for n in (1000, 2))
        assert one == many and ("\u0420aulz", "Paul") in one if budget else ("\u0420aulz", "Paulz") not in one


def test_the_vocabulary_decides_what_a_letter_is(spark):
    """The palochka looks like I and like l; only the words of the corpus tell which, the table alone does not."""
    rows = [(1, "full Illness"), (2, "fu\u04cfl \u04c0llness"), (3, "fu\u04c0\u04c0 I\u04cflness"), (4, "\u04c0van"), (5, "lvan"), (6, "huII lllnezz")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert skeleton("fu\u04c0\u04c0") == "fuII" != "full"
    for broadcast in (1000, -1):
        forms = {r["doc_id"]: r["form"] for r in visual_forms(df, document="doc_id", broadcast_spellings=broadcast).collect()}
        assert forms[1] == forms[2] == forms[3] == "full Illness" and forms[4] == "lvan" and forms[6] == "huII lllnezz"
    assert {tuple(r) for r in visual_pairs(df, document="doc_id").collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_ligatures_and_invisible_letters_in_the_walk():
    trie = Trie()
    for w in ("fine", "\uac00\ub098", "na\u00efve"):
        trie.add(w, 1)
    for seen, want in (("\ufb01ne", "fine"), ("f\u200bi\u00adn\u0435", "fine"), ("\u1100\u1161\ub098", "\uac00\ub098"), ("nai\u200d\u0308ve", "na\u00efve"), ("fjne", "fjne")):
        assert canonical(seen, trie) == want
    assert canonical("fjne", trie, budget=1) == "fine" and canonical("fnie", trie, budget=1) == "fnie"


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "\u0430" * 50_000), (2, "a" * 50_000)], "doc_id int, text string")
    assert [tuple(r) for r in visual_pairs(df, document="doc_id").collect()] == [(1, 2)]
    assert visual_pairs(df.where("false"), document="doc_id").count() == 0
