"""Value templates of large keys."""

import random

from callscope.operators import segment


def test_fields_of_a_large_key(spark):
    """No task reads all lines of a key, neither to learn nor to match; fields are those of plain code, examples too, however lines are dealt."""
    rng = random.Random(5)
    line = lambda: f"{rng.choice(['order', 'parcel', 'note'])} {rng.randrange(10**6)} {rng.choice(['shipped to', 'came from'])} town{rng.randrange(99)}{rng.choice(['', '', ' late'])}"
    rows = [(key, (doc, k), line()) for key, docs in (("a", 5000), ("b", 30), (None, 10)) for doc in range(docs) for k in range(4)] + [("a", (4990, 9), "no template has so many words, as it comes late")]
    want = {}
    for key in ("a", "b", None):
        own = [x for _, x in sorted((pos, x) for k, pos, x in rows if k == key)]
        miner, found = segment.TemplateMiner(), {}
        for x in own[:1500]:
            miner.add(x)
        for x in own:
            template = miner.match(x)
            found.setdefault(template, []).append([] if template is None else segment.wildcard_values(template, x))
        for template, values in found.items():
            flat = [v for x in values for v in x]
            want[key, template] = (len(values), flat[:3], sum(map(len, flat)) // len(flat) if flat else 0)
    assert ("a", None) in want and len(want) > 9
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, pos struct<doc:long,k:int>, line string").repartition(8)
    sc, coalesce, before = spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled", segment.MATCHED_LINES
    segment.MATCHED_LINES = 500
    spark.conf.set(coalesce, "false")  # else one task reads a small shuffle
    sc.setJobGroup("fields", "fields")
    try:
        got = {(r.key, r.template): (r.occurrences, r.examples, r.avg_value_chars) for r in segment.mine_fields(df, train_lines=1500).collect()}
    finally:
        segment.MATCHED_LINES = before
        spark.conf.unset(coalesce)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == want
    sc._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    store, status = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for job in status.getJobIdsForGroup("fields") for s in status.getJobInfo(job).stageIds}
    tasks = [found.apply(k).taskMetrics().get() for s in stages for found in [store.taskList(s, 0, 1000)] for k in range(found.size())]
    read = [t.shuffleReadMetrics().recordsRead() for t in tasks]
    assert len(read) > 20 and max(read) < len(rows) / 2
