import pytest

from callscope.operators import facts, identity
from callscope.settings import Settings
from tests.helpers import BILLING, SUPPORT, call, frame


def grouped(spark, rows, **settings):
    return identity.group(facts.fingerprints(frame(spark, rows)), Settings(**settings))


def nodes(found):
    return sorted((r.size, r.node_id) for r in found.nodes.where("is_node").collect())


def test_identical_and_noise_lines(spark):
    rows = [call(k, [("system", SUPPORT), ("user", f"question {k}")]) for k in range(20)]
    rows += [call(100 + k, [("system", f"{BILLING}\ntrace {k}-{k * 7}"), ("user", f"invoice {k}")], app="noisy") for k in range(30)]
    found = grouped(spark, rows)
    assert [n for n, _ in nodes(found)] == [20, 30]
    template = found.nodes.where("app_id = 'noisy'").first().template
    assert template[:7] == BILLING.split("\n") and not any("trace" in line for line in template)


def test_two_jobs_one_app_and_stable_ids(spark):
    make = lambda shift: [call(k, [("system", SUPPORT if k % 2 else BILLING), ("user", f"q{k + shift}")]) for k in range(40)]
    a, b = nodes(grouped(spark, make(0))), nodes(grouped(spark, make(900)[::-1]))
    assert [n for n, _ in a] == [20, 20] and a == b
    edited = [call(k, [("system", SUPPORT + "\nOne more rule."), ("user", "x")]) for k in range(20)]
    assert nodes(grouped(spark, edited))[0][1] not in {i for _, i in a}


def test_tools_split_and_overlap(spark):
    rows = [call(k, [("system", SUPPORT), ("user", f"q{k}")], tools=["search", "read"] if k % 2 else ["pay", "ship"]) for k in range(24)]
    assert [n for n, _ in nodes(grouped(spark, rows))] == [12, 12]
    rows = [call(k, [("system", SUPPORT), ("user", f"q{k}")], tools=["search", f"extra{k % 4}"]) for k in range(24)]
    assert [n for n, _ in nodes(grouped(spark, rows))] == [24]


def test_user_template_joins_the_template_but_not_the_id(spark):
    rows = [call(k, [("system", SUPPORT), ("user", f"Format: json\nLocale: de\nticket {k}")]) for k in range(20)]
    found = grouped(spark, rows).nodes.first()
    assert found.template[-3:] == ["[user turn]", "Format: json", "Locale: de"]
    plain = [call(k, [("system", SUPPORT), ("user", f"ticket {k}")]) for k in range(20)]
    assert grouped(spark, plain).nodes.first().node_id == found.node_id


def test_band_of_ambiguity_and_membership(spark):
    shared = [f"shared rule {k}" for k in range(5)]
    one, two = "\n".join(shared + [f"first own {k}" for k in range(5)]), "\n".join(shared + [f"second own {k}" for k in range(5)])
    rows = [call(k, [("system", one if k % 2 else two), ("user", f"q{k}")]) for k in range(40)]
    found = grouped(spark, rows)
    assert len(nodes(found)) == 2
    assert all(0.45 <= r.score < 0.6 for r in found.ambiguous.collect()) and found.ambiguous.count() == 1
    assert found.membership.count() == 40 and found.membership.where("node_id IS NULL").count() == 0


@pytest.mark.parametrize("n, least", [(6, 3), (50, 3), (1000, 20), (5000, 25)])
def test_floor(spark, n, least):
    from pyspark.sql import functions as F

    assert spark.range(1).select(identity.adaptive_floor(F.lit(n))).first()[0] == least


def test_merge_and_promote(spark):
    member = spark.createDataFrame([("a", "r1", "n1"), ("a", "r2", "n2")], "app_id string, request_id string, node_id string")
    merged = identity.merge_nodes(member, spark.createDataFrame([("n1", "n2")], "keep string, gone string"))
    assert {r.node_id for r in merged.collect()} == {"n1"}
    kept = identity.promote(spark.createDataFrame([("c", "small", False)], "cluster string, confidence string, is_node boolean"), spark.createDataFrame([("c",)], "cluster string")).first()
    assert kept.confidence == "weak" and kept.is_node
