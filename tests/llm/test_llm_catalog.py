"""Every query of the subpackage runs over the smallest tables; what is found is what plain code finds."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from trapflow.llm import catalog, mixing
from trapflow.llm.mail import mail_text
from trapflow.llm.words import words
from trapflow.sources.tables import table


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_leaks_are_those_of_plain_code(spark):
    got = {tuple(r) for r in entry.queries()["p6_found"](spark, DATA).collect()}
    docs = {r.doc_id: words(mail_text(r.text)) for r in table(spark, DATA, "documents").collect()}
    grams = {d: {tuple(w[i : i + 8]) for i in range(len(w) - 7)} for d, w in docs.items()}
    for item in table(spark, DATA, "eval_item").collect():
        own = words(item.text)
        for d, g in grams.items():
            hits = [j for j in range(len(own) - 7) if tuple(own[j : j + 8]) in g]
            covered = len({k for j in hits for k in range(j, j + 8)})
            assert ((d, item.item_id) in got) <= (covered * 2 >= len(own))
            assert ((d, item.item_id) in got) or covered * 2 < len(own) or sorted(hits) != list(range(hits[0], hits[-1] + 1))
    changed = {tuple(r) for r in entry.queries()["p6_changed"](spark, DATA).collect()}
    assert got <= changed


def test_short_sources_are_those_of_the_rule(spark):
    sizes = {(r.doc_id): (r.source, r.n) for r in mixing.measured(table(spark, DATA, "documents"), "doc_id", "text", "source").collect()}
    every = sum(n for _, n in sizes.values())
    targets = mixing.read_targets(table(spark, DATA, "mix_target"))
    want = {s for s, (share, cap) in targets.items() if cap * sum(n for x, n in sizes.values() if x == s) < share * every}
    assert {r.source for r in entry.queries()["p7_found"](spark, DATA).collect()} == want
