from callscope.operators import match, registry
from tests.helpers import BILLING, SUPPORT

KNOWN = "node_id string, app_id string, template array<string>, tools array<string>, shape string"


def known(spark, rows):
    return spark.createDataFrame([(n, "app", t.split("\n"), tools, "SU") for n, t, tools in rows], KNOWN)


def ask(spark, table, text, tools=(), app="app", **more):
    request = spark.createDataFrame([("q", app, text.split("\n"), list(tools), "SU")], "request_id string, app_id string, lines array<string>, tools array<string>, shape string")
    return match.lookup(request, table, **more).first()


def test_lookup(spark):
    table = known(spark, [("support", SUPPORT, []), ("billing", BILLING, []), ("agent", "Run tools.", ["go", "stop"])])
    assert ask(spark, table, SUPPORT).node_id == "support"
    long = ask(spark, table, SUPPORT + "\n" + "\n".join(f"payload {k}" for k in range(400)))
    assert (long.status, long.contained) == ("matched", 1.0)
    one_edit = ask(spark, table, SUPPORT.replace("Be brief.", "Be short."))
    assert one_edit.status == "matched" and one_edit.contained < 1.0
    assert ask(spark, table, "Nothing of this is known.").status == "unknown" and ask(spark, table, BILLING.split("\n")[0]).node_id is None
    assert ask(spark, table, "Run tools.", ["go", "stop"]).node_id == "agent" and ask(spark, table, "Run tools.", ["other"]).status == "unknown"
    assert ask(spark, table, SUPPORT, app="elsewhere").status == "matched" and ask(spark, table, SUPPORT, app="elsewhere", scope_to_app=True).status == "unknown"
    assert ask(spark, known(spark, []), SUPPORT).status == "unknown"


def test_ambiguous_boilerplate_and_pruning(spark):
    both = known(spark, [("base", SUPPORT, []), ("more", SUPPORT + "\nOne rule more.", [])])
    found = ask(spark, both, SUPPORT + "\nOne rule more.")
    assert found.status == "ambiguous" and found.runner_up in ("base", "more")
    assert ask(spark, known(spark, [(f"n{k}", "You help people.", []) for k in range(30)]), "You help people.").status == "unknown"
    many = known(spark, [(f"n{k}", "\n".join(f"rule {k}.{j}" for j in range(6)) + "\nYou help people.", []) for k in range(200)])
    text = "\n".join(f"rule 137.{j}" for j in range(6)) + "\nYou help people."
    assert ask(spark, many, text).node_id == ask(spark, many, text, prune=True).node_id == "n137"


OBSERVED = KNOWN + ", name string, purpose string, calls long, avg_tokens long, cacheable_now long, recoverable long, cached_mean double, verdict string"


def observed(spark, rows):
    return spark.createDataFrame([(n, "app", t.split("\n"), [], "SU", None, None, 10, 5, 1, 1, None, None) for n, t in rows], OBSERVED)


def test_registry_over_runs(spark, tmp_path):
    store = registry.Store(spark, f"file://{tmp_path}/registry")

    def run(name, rows):
        now = store.load()
        found = registry.update(now["callsites"], now["observations"], now["versions"], observed(spark, rows), name, f"2024-05-0{name[-1]}")
        store.save(found)
        return {(r.status, r.node_id): r for r in found.history.collect()}

    assert set(run("run1", [("a", SUPPORT), ("b", BILLING)])) == {("new", "a"), ("new", "b")}
    assert set(run("run2", [("a", SUPPORT), ("b", BILLING)])) == {("seen", "a"), ("seen", "b")}
    third = run("run3", [("a2", SUPPORT + "\nOne rule more."), ("c", "Unrelated.\nQuite.\nTruly.")])
    assert set(third) == {("changed", "a2"), ("new", "c"), ("retired", None)}
    assert (third["changed", "a2"].lines_added, third["changed", "a2"].lines_removed) == (1, 0)
    tables = store.load()
    sites = {r.node_id: r for r in tables["callsites"].collect()}
    assert set(sites) == {"a2", "b", "c"} and (sites["a2"].version, sites["a2"].runs_seen, sites["a2"].calls_total, sites["a2"].first_seen) == (2, 3, 30, "2024-05-01")
    assert registry.observations_of(tables["observations"], "a2").count() == 3
    assert tables["versions"].first().prior_node_id == "a"


def test_one_ancestor_is_claimed_once_and_exact_comes_first(spark):
    before = observed(spark, [("a", SUPPORT)]).select(*KNOWN.replace(",", " ").split()[0::2]) if False else known(spark, [("a", SUPPORT, [])])
    split = registry.reconcile(before, observed(spark, [("x", SUPPORT + "\nOne."), ("y", SUPPORT + "\nTwo.")])).collect()
    assert sorted(r.status for r in split) == ["changed", "new"]
    exact = registry.reconcile(before, observed(spark, [("0", SUPPORT + "\nOne."), ("a", SUPPORT)])).collect()
    assert {(r.node_id, r.status) for r in exact} == {("0", "new"), ("a", "seen")}
