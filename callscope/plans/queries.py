"""Registered queries of the profiler's operators over the driver's tables, and their DuckDB SQL.

Each entry of QUERIES is (spark, sf_dir) -> DataFrame; ORACLE_SQL has the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.text import common_prefix_length, containment, jaccard, line_delta, lines, role_sequence, role_shape, tokens
from callscope.operators import chain, facts, identity, match, metrics, registry, scoring, segment
from callscope.operators.components import connected_components
from callscope.settings import Settings
from callscope.sources import gateway, testdata
from callscope.sources.testdata import calls, prompts, table
from callscope.streaming.lookup import windowed_counts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL of shared views.
LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
DOCS = f"d AS (SELECT source AS app_id, doc_id AS request_id, text, {LINES} AS lines FROM documents)"
CALLS = """turns AS (
  SELECT conv_id, turn, role, text, list({'role': role, 'content': text}) OVER w AS messages,
         CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS response_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
calls AS (
  SELECT conv_id || '-' || turn AS request_id, 'app_' || (conv_id % 5) AS app_id, conv_id * 3600 + turn * 10 AS sec, 'model_' || (conv_id % 3) AS model, conv_id, turn, messages, response_text
  FROM turns WHERE role = 'user')"""
#: Texts of a call's messages by role, in SQL.
OF = "list_transform(list_filter(messages, lambda m: m.role IN ({})), lambda m: coalesce(m.content, ''))"
SYSTEM, USER, REST = OF.format("'system', 'developer'"), OF.format("'user'"), OF.format("'assistant', 'tool'")
CHARS = "coalesce(list_sum(list_transform({}, lambda t: length(t))), 0)"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).withColumn("lines", lines(F.col("text")))


# ---------------------------------------------------------------- lines and document frequency


@query(f"WITH {DOCS} SELECT app_id, line, count(*) AS df FROM (SELECT app_id, unnest(list_distinct(lines)) AS line FROM d) GROUP BY ALL")
def doc_frequency(spark, d):
    """Calls of an app that hold a line."""
    return identity.doc_frequency(_docs(spark, d))


@query(f"""WITH {DOCS}, f AS (SELECT app_id, line, count(*) AS df FROM (SELECT app_id, unnest(list_distinct(lines)) AS line FROM d) GROUP BY ALL),
n AS (SELECT app_id, count(*) AS n FROM d GROUP BY 1)
SELECT app_id, CASE WHEN df = 1 THEN 'singleton' WHEN df / n < 0.1 THEN '<10%' WHEN df / n < 0.4 THEN '10-40%' WHEN df / n < 0.9 THEN '40-90%' ELSE '>=90%' END AS band, count(*) AS lines
FROM f JOIN n USING (app_id) GROUP BY 1, 2""")
def df_histogram(spark, d):
    """A5: document frequencies by band."""
    docs = _docs(spark, d)
    return identity.frequency_bands(identity.doc_frequency(docs), docs.groupBy("app_id").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH d AS (SELECT lang AS app_id, doc_id, {LINES} AS lines FROM documents), n AS (SELECT app_id, count(*) AS calls FROM d GROUP BY 1),
f AS (SELECT app_id, line, count(*) AS doc_frequency FROM (SELECT app_id, unnest(list_distinct(lines)) AS line FROM d) GROUP BY ALL)
SELECT app_id, line, doc_frequency, calls, CASE WHEN doc_frequency >= 0.02 * calls THEN 'static' ELSE 'dynamic' END AS kind FROM f JOIN n USING (app_id)""")
def static_dynamic_lines(spark, d):
    """Lines of a group by the share of its prompts that hold them."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("app_id"), "text")
    return segment.line_split(docs, ["app_id"], fraction=0.02).select("app_id", "line", "doc_frequency", "calls", "kind")


@query("""SELECT app_id, text, count FROM (SELECT source AS app_id, text, count(*) AS count, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS n FROM documents GROUP BY 1, 2) WHERE n = 1""")
def modal_text(spark, d):
    """Each group's most common text, the first seen on a tie."""
    return segment.modal_text(prompts(spark, d), ["app_id"], pos="request_id")


@query("SELECT app_id, text FROM (SELECT source AS app_id, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM documents) WHERE n = 1")
def longest_text(spark, d):
    """Each group's longest text."""
    return segment.longest_text(prompts(spark, d), ["app_id"], pos="request_id")


@query("""WITH g AS (SELECT lang, min(text) AS a, max(text) AS b, count(*) AS calls, sum(length(text)) AS chars FROM documents GROUP BY 1),
p AS (SELECT *, coalesce(list_max(list_transform(range(1, least(length(a), length(b)) + 1), lambda k: CASE WHEN a[1:k] = b[1:k] THEN k ELSE 0 END)), 0) AS prefix_chars FROM g)
SELECT lang AS app_id, calls, prefix_chars::BIGINT AS prefix_chars, (prefix_chars // 4)::BIGINT AS cacheable_now, ((chars // calls) // 4)::BIGINT AS avg_request_tokens FROM p""")
def common_prefix(spark, d):
    """What all texts of a group begin with."""
    return metrics.cache_prefix(table(spark, d, "documents").select(F.col("lang").alias("app_id"), "text"), ["app_id"])


@query("WITH m AS (SELECT conv_id, min(text) AS a, max(text) AS b FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, coalesce(list_max(list_transform(range(1, least(length(a), length(b)) + 1), lambda k: CASE WHEN a[1:k] = b[1:k] THEN k ELSE 0 END)), 0)::BIGINT AS n FROM m")
def prefix_of_turns(spark, d):
    """P21 on the user turns of a conversation."""
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return turns.select("conv_id", common_prefix_length(F.col("a"), F.col("b")).alias("n"))


# ---------------------------------------------------------------- callsites of calls with tools, by the library's own stages

#: Calls of `events` (testdata.event_calls), their views, and the lines that identity keeps.
EVENTS = """ev AS (SELECT 'svc_' || (user_id % 4) AS app_id, 'e' || event_id AS request_id, ts, event_id, value, props, event_type AS kind,
  ['Answer with one JSON object.', 'Stay brief.', 'Never guess.', 'You handle ' || event_type || ' events.', 'Rule 1 of ' || event_type || '.', 'Rule 2 of ' || event_type || '.', 'Rule 3 of ' || event_type || '.', 'Trace ' || event_id] AS plines,
  ['Kind: ' || event_type, 'Locale: ' || (user_id % 3), props] AS ulines,
  list_sort(CASE WHEN user_id % 2 = 0 THEN ['find_' || event_type, 'read_' || event_type, 'audit'] ELSE ['find_' || event_type, 'read_' || event_type] END) AS tools,
  CASE WHEN user_id % 5 = 0 THEN 'json_object' END AS form, row_number() OVER (PARTITION BY 'svc_' || (user_id % 4) ORDER BY ts, 'e' || event_id) AS pos FROM events),
n AS (SELECT app_id, count(*) AS n FROM ev GROUP BY 1),
pe AS (SELECT app_id, request_id, unnest(plines) AS line FROM ev), ue AS (SELECT app_id, request_id, unnest(ulines) AS line FROM ev),
pf AS (SELECT app_id, line FROM pe GROUP BY 1, 2 HAVING count(*) >= 2),
uf AS (SELECT app_id, line FROM (SELECT app_id, line, count(*) AS df FROM ue GROUP BY 1, 2) JOIN n USING (app_id) WHERE df >= greatest(2, ceil(0.05 * n))),
pk AS (SELECT app_id, request_id, list_sort(list(line)) AS pk FROM pe JOIN pf USING (app_id, line) GROUP BY 1, 2),
uk AS (SELECT app_id, request_id, list_sort(list(line)) AS uk FROM ue JOIN uf USING (app_id, line) GROUP BY 1, 2),
fp AS (SELECT ev.*, coalesce(pk, []) AS pk, coalesce(uk, []) AS uk FROM ev LEFT JOIN pk USING (app_id, request_id) LEFT JOIN uk USING (app_id, request_id))"""

#: Points by rank, and the similarity of an app's pairs of points; every call has the shape SU.
POINTS = f"""{EVENTS}, g AS (SELECT app_id, pk, uk, tools, form, count(*) AS calls, min(pos) AS pos, arg_min(request_id, pos) AS first FROM fp GROUP BY 1, 2, 3, 4, 5),
pt AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY calls DESC, pos) - 1 AS rank FROM g),
pn AS (SELECT *, app_id || '#' || lpad(rank::VARCHAR, 9, '0') AS point FROM pt),
jj AS (SELECT x.app_id, x.point AS a, y.point AS b, len(list_intersect(x.pk, y.pk)) / len(list_distinct(list_concat(x.pk, y.pk))) AS jp,
  len(list_intersect(x.uk, y.uk)) / len(list_distinct(list_concat(x.uk, y.uk))) AS ju, len(list_intersect(x.tools, y.tools)) / len(list_distinct(list_concat(x.tools, y.tools))) AS jt,
  CASE WHEN x.form IS NOT DISTINCT FROM y.form THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS jf FROM pn x JOIN pn y ON x.app_id = y.app_id AND x.rank < y.rank WHERE y.rank < 4000),
pp AS (SELECT app_id, a, b, CASE WHEN jt = 0 OR ju = 0 THEN least(0.5, w) ELSE w END AS score FROM (SELECT *, (0.6::DOUBLE * jp + 0.2::DOUBLE * ju + 0.25::DOUBLE * jt + 0.1::DOUBLE + 0.05::DOUBLE * jf) / 1.2::DOUBLE AS w FROM jj))"""
LINKED = f"""{POINTS}, s AS (SELECT a, b FROM pp WHERE score >= 0.6 UNION SELECT b, a FROM pp WHERE score >= 0.6),
r(node, to_node) AS (SELECT a, b FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.to_node = s.a),
cc AS (SELECT node, least(node, min(to_node)) AS component FROM r GROUP BY node),
lb AS (SELECT pn.*, coalesce(component, point) AS cluster FROM pn LEFT JOIN cc ON node = point)"""


def _points(spark, d):
    return identity.distinct_points(identity.noise_filter(facts.fingerprints(testdata.event_calls(spark, d))))[0]


def _pairs(spark, d):
    return identity.pair_scores(_points(spark, d))


@query(f"WITH {EVENTS} SELECT app_id, request_id, array_to_string(pk, chr(10)) AS prompt, array_to_string(uk, chr(10)) AS user_part, array_to_string(tools, ',') AS tools FROM fp")
def noise_filter(spark, d):
    """The lines of a call that more than chance shares, and its tools."""
    kept = identity.noise_filter(facts.fingerprints(testdata.event_calls(spark, d)))
    of = lambda lines, key: F.array_join(F.array_sort(F.filter(lines, lambda x: F.array_contains(F.col(key), F.xxhash64(x)))), "\n")
    return kept.select("app_id", "request_id", of("prompt_lines", "prompt_key").alias("prompt"), of("user_lines", "user_key").alias("user_part"), F.array_join("tools", ",").alias("tools"))


@query(f"WITH {POINTS} SELECT app_id, point, first, calls, rank FROM pn")
def distinct_points(spark, d):
    """Calls with equal views are one point, ranked by size."""
    return _points(spark, d).select("app_id", "point", F.col("first.request_id").alias("first"), "calls", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POINTS} SELECT app_id, a, b, round(score, 6) AS score FROM pp")
def pair_similarity(spark, d):
    """Weighted similarity of an app's points."""
    return _pairs(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {POINTS} SELECT app_id, a, b, round(score, 4) AS score FROM pp WHERE score >= 0.3 AND score < 0.9")
def ambiguous_pairs(spark, d):
    """Pairs that just miss linkage, in a band where these calls have pairs."""
    return identity.ambiguous_pairs(_pairs(spark, d), Settings(tau=0.95, ambiguous_low=0.3, ambiguous_high=0.9)).select("app_id", "a", "b", "score")


@query(f"WITH RECURSIVE {LINKED} SELECT node, component FROM cc")
def components(spark, d):
    """Single linkage of the pairs at tau."""
    return connected_components(_pairs(spark, d).where("score >= 0.6").select("a", "b"))


#: Each cluster's calls, quality and template. A template's lines are stable, in the order of the first call.
NODES = f"""{LINKED}, q AS (SELECT x.cluster AS ca, y.cluster AS cb, score FROM pp JOIN lb x ON x.point = a JOIN lb y ON y.point = b),
i AS (SELECT ca AS cluster, min(score) AS lo, avg(score) AS mean FROM q WHERE ca = cb GROUP BY 1),
o AS (SELECT cluster, max(score) AS hi FROM (SELECT ca AS cluster, score FROM q WHERE ca <> cb UNION ALL SELECT cb, score FROM q WHERE ca <> cb) GROUP BY 1),
m AS (SELECT lb.cluster, fp.app_id, fp.request_id, fp.pos, fp.plines, fp.ulines, fp.tools, fp.pk, fp.uk FROM fp JOIN lb ON lb.app_id = fp.app_id AND lb.pk = fp.pk AND lb.uk = fp.uk AND lb.tools = fp.tools AND lb.form IS NOT DISTINCT FROM fp.form),
z AS (SELECT app_id, cluster, count(*) AS size, count(DISTINCT [pk, uk]) AS distinct_prompts, arg_min(request_id, pos) AS medoid, arg_min(tools, pos) AS tools, arg_min(plines, pos) AS pl, arg_min(ulines, pos) AS ul FROM m GROUP BY 1, 2),
sl AS (SELECT cluster, line FROM (SELECT cluster, unnest(pk) AS line FROM m) JOIN z USING (cluster) GROUP BY cluster, line, size HAVING count(*) >= 0.9 * size),
vl AS (SELECT cluster, line FROM (SELECT cluster, unnest(uk) AS line FROM m) JOIN z USING (cluster) GROUP BY cluster, line, size HAVING count(*) >= 0.9 * size),
st AS (SELECT z.cluster, list(line ORDER BY list_position(pl, line)) AS system FROM z JOIN sl USING (cluster) WHERE list_contains(pl, line) GROUP BY 1),
vt AS (SELECT z.cluster, list(line ORDER BY list_position(ul, line)) AS own FROM z JOIN vl USING (cluster) WHERE list_contains(ul, line) GROUP BY 1),
nd AS (SELECT z.*, coalesce(lo, 1) AS lo, coalesce(mean, 1) AS mean, coalesce(hi, 0) AS hi, coalesce(system, []) AS system, CASE WHEN own IS NULL THEN coalesce(system, []) ELSE list_concat(coalesce(system, []), ['[user turn]'], own) END AS template, n,
  app_id || ':' || md5(array_to_string(coalesce(system, []), chr(10)) || ' ' || array_to_string(tools, ',') || ' SU')[1:12] AS base FROM z JOIN n USING (app_id) LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster) LEFT JOIN st USING (cluster) LEFT JOIN vt USING (cluster)),
nx AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY size DESC, cluster) AS k FROM nd)"""


@query(f"""WITH RECURSIVE {NODES} SELECT app_id, CASE WHEN k > 1 THEN base || '#' || k ELSE base END AS node_id, size, distinct_prompts, medoid, array_to_string(template, chr(10)) AS template,
round(lo, 6) AS min_internal, round(mean, 6) AS mean_internal, round(hi, 6) AS max_external, round(lo - hi, 6) AS margin,
CASE WHEN len(template) <= 2 OR (distinct_prompts / size > 0.95 AND size > 5) THEN 'suspect' WHEN lo - hi < 0.05 OR lo < 0.35 OR size < 5 THEN 'weak' ELSE 'ok' END AS quality,
size >= greatest(3, least(ceil(0.02 * n), 25)) OR (len(template) >= 3 AND distinct_prompts / size <= 0.95 AND size >= 3) AS is_node FROM nx""")
def callsite_nodes(spark, d):
    """Callsites with their templates, ids and quality."""
    found = identity.group(facts.fingerprints(testdata.event_calls(spark, d))).nodes
    return found.select("app_id", "node_id", "size", "distinct_prompts", "medoid", F.array_join("template", "\n").alias("template"), *(F.round(c, 6).alias(c) for c in ("min_internal", "mean_internal", "max_external", "margin")), "quality", "is_node")


@query(f"""WITH RECURSIVE {NODES} SELECT m.app_id, m.request_id, CASE WHEN k > 1 THEN base || '#' || k ELSE base END AS node_id FROM m JOIN nx USING (cluster)
WHERE size >= greatest(3, least(ceil(0.02 * n), 25)) OR (len(template) >= 3 AND distinct_prompts / size <= 0.95 AND size >= 3)""")
def callsite_membership(spark, d):
    """Every call with its callsite."""
    return identity.group(facts.fingerprints(testdata.event_calls(spark, d))).membership.where("node_id IS NOT NULL").select("app_id", "request_id", "node_id")


@query(f"""WITH {POINTS}, q AS (SELECT pp.app_id, score, x.tools = y.tools AS same FROM pp JOIN pn x ON x.point = a JOIN pn y ON y.point = b),
gg AS (SELECT app_id, list_sort(list(score) FILTER (same)) AS w, list_sort(list(score) FILTER (NOT same)) AS v FROM q GROUP BY 1)
SELECT app_id, round(w[round_even(0.1 * (len(w) - 1), 0)::INT + 1] - v[round_even(0.9 * (len(v) - 1), 0)::INT + 1], 6) AS gap, round(w[1] - v[len(v)], 6) AS worst FROM gg""")
def separation_gap(spark, d):
    """How far scores within and across groups of equal tools lie apart."""
    points = _points(spark, d)
    named = identity.pair_scores(points).join(points.select(F.col("point").alias("a"), F.col("tools").alias("ta")), "a").join(points.select(F.col("point").alias("b"), F.col("tools").alias("tb")), "b")
    return scoring.separation(named.withColumn("same", F.col("ta") == F.col("tb")), ["app_id"]).select("app_id", F.round("gap", 6).alias("gap"), F.round("worst", 6).alias("worst"))


@query(f"WITH {POINTS} SELECT app_id, least(19, greatest(0, floor(round(score, 9) * 20)))::BIGINT AS bin, count(*) AS n FROM pp GROUP BY 1, 2")
def score_histogram(spark, d):
    """Pair scores by bin."""
    return scoring.histogram(_pairs(spark, d).withColumn("score", F.round("score", 9)), "score", ["app_id"]).withColumn("bin", F.col("bin").cast("long"))


@query(f"""WITH {EVENTS} SELECT app_id, count(*) AS with_system_prompt, count(*) AS with_user_template, 0::BIGINT AS weak_prompts, 8::BIGINT AS median_prompt_lines, count(DISTINCT tools) AS distinct_tool_sets,
count(DISTINCT coalesce(form, '')) AS distinct_formats, 'SU' AS shape, 1::BIGINT AS distinct_shapes FROM ev GROUP BY 1""")
def identity_signature(spark, d):
    """What identity had to work with."""
    return identity.identity_signature(facts.fingerprints(testdata.event_calls(spark, d)), ["app_id"]).select("app_id", "with_system_prompt", "with_user_template", "weak_prompts", "median_prompt_lines", "distinct_tool_sets", "distinct_formats", "shape", "distinct_shapes")


@query("""WITH c AS (SELECT 'svc_' || (user_id % 4) AS app_id, floor(value)::BIGINT AS v, event_id FROM events), g AS (SELECT app_id, list_sort(list(v)) AS vs, count(*) AS calls,
count(*) FILTER (event_id % 10 = 0) AS truncated, count(*) FILTER (event_id % 10 <> 0 AND event_id % 7 = 0) AS unknown, round(avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), 3) AS tool_call_rate, count(*) FILTER (event_id % 2 = 0) AS model_0 FROM c GROUP BY 1)
SELECT app_id, calls, vs[round_even(0.5 * (len(vs) - 1), 0)::INT + 1] AS completion_p50, vs[round_even(0.95 * (len(vs) - 1), 0)::INT + 1] AS completion_p95, truncated, unknown, tool_call_rate, model_0 FROM g""")
def response_anatomy(spark, d):
    """Sizes of the answers, models, finish reasons, tool calls."""
    found = metrics.response_anatomy(testdata.event_calls(spark, d), ["app_id"])
    of = lambda c, value: F.filter(c, lambda x: x["value"] == value)[0]["calls"]
    return found.select("app_id", "calls", "completion_p50", "completion_p95", "truncated", of("finish_reasons", "unknown").alias("unknown"), "tool_call_rate", of("models", "model_0").alias("model_0"))


@query(f"""WITH {EVENTS} SELECT request_id, len(tools)::BIGINT AS n_tools, (list_sum([length('{{"function":{{"name":"' || t || '"}}}}') FOR t IN tools]) // 4)::BIGINT AS schema_tokens,
array_to_string(list_filter([CASE WHEN event_id % 5 = 0 AND 1000 + event_id % 200 >= 1024 THEN 'no cache hit on a prompt large enough to cache' END, CASE WHEN event_id % 10 = 0 THEN 'response truncated by max_tokens' END], lambda x: x IS NOT NULL), ';') AS flags FROM ev""")
def tool_call_facts(spark, d):
    """Sizes and flags of calls with tools and known sizes."""
    return facts.call_facts(testdata.event_calls(spark, d)).select("request_id", F.col("n_tools").cast("long").alias("n_tools"), "schema_tokens", F.array_join("flags", ";").alias("flags"))


#: Two windows of documents as two exports, each source one callsite: lines that enough of its documents hold.
WINDOWS = f"""{DOCS}, w AS (SELECT *, (request_id // 20) % 2 AS win FROM d), wn AS (SELECT app_id, win, count(*) AS n FROM w GROUP BY 1, 2),
wl AS (SELECT app_id, win, line, count(*) AS df FROM (SELECT app_id, win, unnest(list_distinct(lines)) AS line FROM w) GROUP BY ALL),
t AS (SELECT app_id, win, list_sort(list(line)) AS template, md5(array_to_string(list_sort(list(md5(line))), ',')) AS id FROM wl JOIN wn USING (app_id, win) WHERE df >= 0.02 * n AND df >= 2 GROUP BY 1, 2)"""


def _windows(spark, d):
    """(app_id, win, template, id) of each source in the even and the odd documents."""
    docs = _docs(spark, d).withColumn("win", F.floor(F.col("request_id") / 20) % 2)
    found = segment.line_split(docs, ["app_id", "win"], fraction=0.02).where("kind = 'static' AND doc_frequency >= 2")
    found = found.groupBy("app_id", "win").agg(F.array_sort(F.collect_list("line")).alias("template"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("line"))), ",")).alias("id"))
    return found


@query(f"WITH {WINDOWS} SELECT app_id, win, len(template)::BIGINT AS n_lines, id AS node_id FROM t")
def template_ids(spark, d):
    """A group's stable lines and its id."""
    return _windows(spark, d).select("app_id", "win", F.size("template").cast("long").alias("n_lines"), F.col("id").alias("node_id"))


@query(f"""WITH {WINDOWS} SELECT a.app_id, len(list_filter(b.template, lambda x: NOT list_contains(a.template, x)))::BIGINT AS added,
len(list_filter(a.template, lambda x: NOT list_contains(b.template, x)))::BIGINT AS removed FROM t a JOIN t b ON a.app_id = b.app_id AND a.win = 0 AND b.win = 1""")
def template_delta(spark, d):
    """Lines added and removed between two exports."""
    both = _windows(spark, d)
    old, new = both.where("win = 0").select("app_id", F.col("template").alias("o")), both.where("win = 1").select("app_id", F.col("template").alias("n"))
    added, removed = line_delta(F.col("o"), F.col("n"))
    return old.join(new, "app_id").select("app_id", added.alias("added"), removed.alias("removed"))


@query(f"""WITH {WINDOWS}, k AS (SELECT app_id, id, template FROM t WHERE win = 0), o AS (SELECT app_id, id, template FROM t WHERE win = 1),
j AS (SELECT o.app_id, o.id, k.id AS prior, k.template AS pt, o.template AS nt,
  len(list_filter(o.template, lambda x: list_contains(k.template, x))) / len(list_distinct(list_concat(o.template, k.template))) AS jac FROM o LEFT JOIN k USING (app_id))
SELECT app_id, CASE WHEN id = prior THEN 'seen' WHEN (0.60 * jac + 0.15) / 0.75 >= 0.70 THEN 'changed' ELSE 'new' END AS status FROM j
UNION ALL SELECT k.app_id, 'retired' FROM k LEFT JOIN j USING (app_id) WHERE j.id IS NULL OR (j.id <> j.prior AND (0.60 * jac + 0.15) / 0.75 < 0.70)""")
def registry_reconcile(spark, d):
    """Callsites of one export against those of the one before."""
    both = _windows(spark, d).select(F.col("id").alias("node_id"), "app_id", "win", "template", F.array().cast("array<string>").alias("tools"), F.lit("U").alias("shape"))
    return registry.reconcile(both.where("win = 0"), both.where("win = 1")).select("app_id", "status")


# ---------------------------------------------------------------- calls


@query(f"""WITH {CALLS}, s AS (SELECT request_id, array_to_string(list_transform(messages, lambda m: CASE WHEN m.role IN ('system', 'developer') THEN 'S' WHEN m.role = 'user' THEN 'U' WHEN m.role = 'assistant' THEN 'A' WHEN m.role = 'tool' THEN 'T' ELSE '?' END), '') AS seq FROM calls)
SELECT request_id, seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, '(AT)+', '(AT)', 'g'), '(UA)+', '(UA)', 'g'), 'A{{2,}}', 'A', 'g'), 'T{{2,}}', 'T', 'g') AS shape FROM s""")
def role_shapes(spark, d):
    """Role sequence and folded shape of each call."""
    seq = role_sequence(F.col("messages"))
    return calls(spark, d).select("request_id", seq.alias("seq"), role_shape(seq).alias("shape"))


FACTS = f"""{CALLS}, b AS (SELECT *, {CHARS.format(SYSTEM)} AS sc, {CHARS.format(USER)} AS uc, list_filter(messages, lambda m: m.role NOT IN ('system', 'developer', 'user')) AS other FROM calls),
c AS (SELECT *, coalesce(list_sum(list_transform(other, lambda m: length(coalesce(m.content, '')) + 2)), 0) AS hc,
  list_filter(list_transform(list_concat(string_split(array_to_string({SYSTEM}, chr(10)), chr(10)), string_split(array_to_string({USER}, chr(10)), chr(10))), lambda x: trim(x)), lambda x: x <> '') AS lines FROM b),
f AS (SELECT app_id, request_id, len(messages)::BIGINT AS n_messages, len(other)::BIGINT AS history_depth, (sc // 4)::BIGINT AS system_tokens, (uc // 4)::BIGINT AS user_tokens, (hc // 4)::BIGINT AS history_tokens,
  len(lines)::BIGINT AS n_lines, coalesce(list_max(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS longest_line,
  ((coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0)) // 4)::BIGINT AS repeated_tokens,
  ((sc + uc + hc) // 4)::BIGINT AS prompt_tokens FROM c)"""


@query(f"WITH {FACTS} SELECT * FROM f")
def call_facts(spark, d):
    """Sizes by part and counts of each call."""
    big = lambda c: F.col(c).cast("long").alias(c)
    return facts.call_facts(calls(spark, d)).select("app_id", "request_id", big("n_messages"), big("history_depth"), "system_tokens", "user_tokens", "history_tokens", big("n_lines"), big("longest_line"), "repeated_tokens", F.col("prompt_tokens_used").alias("prompt_tokens"))


@query(f"""WITH {FACTS} SELECT request_id, array_to_string(list_filter([CASE WHEN repeated_tokens > 50 THEN 'duplicated lines within a single prompt' END, CASE WHEN history_tokens > 4 * greatest(system_tokens + user_tokens, 1) THEN 'history dominates the payload' END], lambda x: x IS NOT NULL), ';') AS flags FROM f""")
def call_flags(spark, d):
    """The flags of each call."""
    return facts.call_facts(calls(spark, d)).select("request_id", F.array_join("flags", ";").alias("flags"))


@query(f"""WITH {FACTS} SELECT app_id, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, round(avg(history_depth), 6) AS mean_history, sum(system_tokens)::BIGINT AS system_tokens, sum(user_tokens)::BIGINT AS user_tokens, sum(history_tokens)::BIGINT AS history_tokens FROM f GROUP BY 1""")
def app_rollup(spark, d):
    """A3: rollup of an app's calls."""
    return facts.app_rollup(facts.call_facts(calls(spark, d))).select("app_id", "calls", "prompt_tokens", F.round("mean_history", 6).alias("mean_history"), "system_tokens", "user_tokens", "history_tokens")


REGIONS = f"""{CALLS}, r AS (SELECT app_id, request_id, unnest(['instructions', 'the user turn', 'conversation history']) AS region,
  unnest([array_to_string({SYSTEM}, chr(10)), array_to_string({USER}, chr(10)), array_to_string({REST}, chr(10))]) AS text FROM calls),
s AS (SELECT app_id, region, length(text) // 4 AS t FROM r),
g AS (SELECT app_id, region, floor(avg(t))::BIGINT AS mean_tokens, list_sort(list(t)) AS ts FROM s GROUP BY 1, 2 HAVING floor(avg(t)) >= 1)"""


@query(f"""WITH {REGIONS} SELECT app_id, region, mean_tokens, round(mean_tokens / sum(mean_tokens) OVER (PARTITION BY app_id), 4) AS share,
ts[round_even(0.1 * (len(ts) - 1), 0)::INT + 1]::BIGINT AS p10, ts[round_even(0.9 * (len(ts) - 1), 0)::INT + 1]::BIGINT AS p90 FROM g""")
def region_anatomy(spark, d):
    """Tokens of each region, with nearest-rank percentiles."""
    return metrics.region_anatomy(calls(spark, d), ["app_id"]).select("app_id", "region", "mean_tokens", "share", "p10", "p90")


@query(f"""WITH {REGIONS} SELECT app_id, region, min(t)::BIGINT AS least, list_sort(list(t))[(count(*) // 2 + 1)::INT]::BIGINT AS median, max(t)::BIGINT AS most, max(t) >= 10 * greatest(min(t), 1) AS wide FROM s GROUP BY 1, 2""")
def payload_spread(spark, d):
    """Least, upper median and greatest size."""
    sizes = metrics.region_texts(calls(spark, d), "app_id").where(F.col("region") != "tool schemas").withColumn("dynamic_tokens", tokens(F.length("text")))
    return metrics.payload_spread(sizes, ["app_id", "region"])


# ---------------------------------------------------------------- runs

#: A call's key is the md5 of its messages; its prefixes are those of its first messages.
KEYS = f"""{CALLS}, h AS (SELECT app_id, request_id, sec, messages, row_number() OVER (PARTITION BY app_id ORDER BY sec, request_id) - 1 AS pos, list_transform(messages, lambda m: md5(m.role || '|' || coalesce(m.content, '') || '|')) AS hs FROM calls),
k AS (SELECT *, md5(array_to_string(hs, ',')) AS key FROM h),
x AS (SELECT k.*, md5(array_to_string(hs[1:n], ',')) AS prefix FROM k, range(1, 400) g(n) WHERE n < len(hs)),
l AS (SELECT c.app_id, c.request_id, arg_max(p.request_id, p.pos) AS parent FROM x c JOIN k p ON p.app_id = c.app_id AND p.key = c.prefix AND p.pos < c.pos AND c.sec - p.sec <= 1800 GROUP BY 1, 2),
y AS (SELECT app_id, request_id, lag(request_id) OVER w AS parent, sec - lag(sec) OVER w AS gap FROM k WINDOW w AS (PARTITION BY app_id, key ORDER BY pos)),
z AS (SELECT app_id, request_id, parent, true AS retry FROM y WHERE gap <= 5 UNION ALL SELECT app_id, request_id, parent, false FROM l WHERE request_id NOT IN (SELECT request_id FROM y WHERE gap <= 5))"""


@query(f"WITH {KEYS} SELECT app_id, request_id, parent FROM l")
def prefix_links(spark, d):
    """The latest earlier call whose messages this one begins with."""
    return chain.prefix_links(chain.requests(calls(spark, d)))


@query(f"WITH RECURSIVE {KEYS}, f AS (SELECT k.app_id, k.request_id, k.request_id AS root, 0 AS step FROM k WHERE request_id NOT IN (SELECT request_id FROM z) UNION ALL SELECT z.app_id, z.request_id, f.root, f.step + 1 FROM z JOIN f ON z.parent = f.request_id) SELECT app_id, request_id, root, step FROM f")
def run_roots(spark, d):
    """Each call's run and depth."""
    reqs = chain.requests(calls(spark, d))
    return chain.forest(reqs, chain.links(reqs)).select("app_id", "request_id", "root", "step")


@query(f"""WITH RECURSIVE {KEYS}, f AS (SELECT k.app_id, k.request_id, k.request_id AS root, 0 AS step FROM k WHERE request_id NOT IN (SELECT request_id FROM z) UNION ALL SELECT z.app_id, z.request_id, f.root, f.step + 1 FROM z JOIN f ON z.parent = f.request_id)
SELECT f.app_id, root AS run_id, count(*) AS steps, (max(sec) - min(sec))::DOUBLE AS duration_s FROM f JOIN k USING (request_id) GROUP BY 1, 2""")
def run_rollup(spark, d):
    """Steps and duration of each run."""
    reqs = chain.requests(calls(spark, d))
    return chain.runs(reqs, chain.forest(reqs, chain.links(reqs))).select("app_id", "run_id", "steps", "duration_s")


@query(f"""WITH {KEYS}, c AS (SELECT k.app_id, count(*) AS requests, count(z.request_id) AS linked, count(*) FILTER (len(messages) >= 3) AS continuations, count(*) FILTER (len(messages) >= 3 AND z.request_id IS NULL) AS orphans FROM k LEFT JOIN z USING (request_id) GROUP BY 1)
SELECT *, CASE WHEN continuations = 0 THEN 'single_step' WHEN orphans / continuations > 0.3 THEN 'unusable' WHEN orphans / continuations > 0.05 THEN 'partial' ELSE 'reliable' END AS verdict FROM c""")
def chain_verdict(spark, d):
    """Whether an app's runs can be trusted."""
    reqs = chain.requests(calls(spark, d))
    linked = chain.links(reqs)
    return chain.chain_report(reqs, linked, chain.runs(reqs, chain.forest(reqs, linked))).select("app_id", "requests", "linked", "continuations", "orphans", "verdict")


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, lag(event_id) OVER w AS parent, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id AS request_id, parent FROM e WHERE epoch_us(ts) - epoch_us(before) <= 1800000000""")
def retry_links(spark, d):
    """The latest earlier event of the same key within a span."""
    events = table(spark, d, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    reqs = events.select(F.col("user_id").alias("app_id"), F.col("event_id").alias("request_id"), "ts", pos.alias("pos"), F.col("event_type").alias("key"))
    return chain.retry_links(reqs, Settings(retry_seconds=1800)).select("request_id", "parent")


# ---------------------------------------------------------------- samples, caps, JSON


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def per_app_cap(spark, d):
    """The earliest rows of each key (the cap is the operator)."""
    return gateway.cap(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 20")
def stratified_sample(spark, d):
    """So many rows of each stratum."""
    return gateway.cap(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 20).select("o_orderkey", "o_orderpriority")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, greatest(1, count(*) OVER (PARTITION BY event_type) // 20) AS step FROM events) WHERE n % step = 0 AND n // step < 20""")
def systematic_sample(spark, d):
    """Rows spread evenly over each key."""
    return gateway.systematic_sample(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 20).select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_array_length(json_keys(props))::BIGINT END AS n_keys FROM events")
def json_object_keys(spark, d):
    """JSON objects, everything else null."""
    keys = F.json_object_keys(F.when(gateway.json_object(F.col("props")).isNotNull(), F.col("props")))
    return table(spark, d, "events").select("event_id", F.when(keys.isNotNull(), F.size(keys).cast("long")).alias("n_keys"))


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l USING (doc_id)")
def residual_anti(spark, d):
    """Rows in no group."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.source AS app_id, l.quality::VARCHAR AS node_id, count(*) AS calls, sum(d.n_chars)::BIGINT AS chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def assigned_left(spark, d):
    """Every call with its node, or none."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy(F.col("source").alias("app_id"), F.col("quality").cast("string").alias("node_id")).agg(F.count(F.lit(1)).alias("calls"), F.sum("n_chars").alias("chars"))


# ---------------------------------------------------------------- lookup and scores

ANCHORS = """s AS (SELECT item_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS lines FROM benchmark),
e AS (SELECT item_id, unnest(lines) AS line FROM s), p AS (SELECT line, count(*) AS postings FROM e GROUP BY 1),
a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY postings, line) AS place FROM e JOIN p USING (line) WHERE postings <= (SELECT greatest(2, ceil(count(*) * 0.02)) FROM s))"""


def _known(spark, d):
    items = table(spark, d, "benchmark")
    none = F.array().cast("array<string>")
    return items.select(F.col("item_id").alias("node_id"), F.lit("bench").alias("app_id"), lines(F.col("text")).alias("template"), none.alias("tools"), F.lit("U").alias("shape"))


@query(f"WITH {ANCHORS} SELECT item_id AS node_id, line, postings, place FROM a WHERE place <= 6")
def anchors(spark, d):
    """The rarest lines of each known template."""
    return match.anchors(_known(spark, d)).select("node_id", "line", "postings", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ANCHORS}, {DOCS}, de AS (SELECT request_id, unnest(list_distinct(lines)) AS line FROM d),
h AS (SELECT request_id, item_id, count(*) AS n FROM de JOIN e USING (line) GROUP BY 1, 2),
c AS (SELECT request_id, item_id, n / len(lines) AS contained FROM h JOIN s USING (item_id) WHERE item_id IN (SELECT item_id FROM a)),
b AS (SELECT *, (3 * contained + 1) / 4 AS score, row_number() OVER (PARTITION BY request_id ORDER BY contained DESC, item_id DESC) AS k FROM c),
t AS (SELECT x.request_id, x.item_id, x.contained, x.score, y.score AS next FROM b x LEFT JOIN b y ON x.request_id = y.request_id AND y.k = 2 WHERE x.k = 1)
SELECT request_id, CASE WHEN contained < 0.8 THEN 'unknown' WHEN score - coalesce(next, -1) < 0.1 THEN 'ambiguous' ELSE 'matched' END AS status,
CASE WHEN contained >= 0.8 THEN item_id END AS node_id, round(score, 6) AS score, round(contained, 6) AS contained FROM t
UNION ALL SELECT request_id, 'unknown', NULL, NULL, NULL FROM d WHERE request_id NOT IN (SELECT request_id FROM t)""")
def containment_match(spark, d):
    """Every document looked up among the benchmark passages."""
    requests = _docs(spark, d).select("request_id", "app_id", "lines", F.array().cast("array<string>").alias("tools"), F.lit("U").alias("shape"))
    return match.lookup(requests, _known(spark, d)).select("request_id", "status", "node_id", F.round("score", 6).alias("score"), F.round("contained", 6).alias("contained"))


@query(f"""WITH {ANCHORS} SELECT x.item_id AS a, y.item_id AS b, round(len(list_filter(x.lines, lambda q: list_contains(y.lines, q))) / len(x.lines), 6) AS contained,
round(len(list_filter(x.lines, lambda q: list_contains(y.lines, q))) / len(list_distinct(list_concat(x.lines, y.lines))), 6) AS jac FROM s x JOIN s y ON x.item_id = y.item_id - 1""")
def containment_of_neighbours(spark, d):
    """Containment and Jaccard index of neighbouring templates."""
    known = _known(spark, d).select(F.col("node_id").alias("a"), F.array_distinct("template").alias("x"))
    other = known.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return known.join(other, "a").select("a", "b", F.round(containment(F.col("x"), F.col("y")), 6).alias("contained"), F.round(jaccard(F.col("x"), F.col("y")), 6).alias("jac"))


@query("""WITH k AS (SELECT d.source AS node_id, l.quality AS callsite, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2)
SELECT 'all' AS app_id, (SELECT sum(n) FROM k)::BIGINT AS scored, round((SELECT sum(m) FROM (SELECT max(n) AS m FROM k GROUP BY node_id)) / (SELECT sum(n) FROM k), 3) AS purity,
round((SELECT sum(m) FROM (SELECT max(n) AS m FROM k GROUP BY callsite)) / (SELECT sum(n) FROM k), 3) AS completeness""")
def purity(spark, d):
    """Groups against labels."""
    assigned = table(spark, d, "documents").select(F.lit("all").alias("app_id"), F.col("doc_id").alias("request_id"), F.col("source").alias("node_id"))
    truth = table(spark, d, "labels").select(F.col("doc_id").alias("request_id"), F.col("quality").alias("callsite"))
    return scoring.truth_scores(assigned, truth).select("app_id", "scored", "purity", "completeness")


# ---------------------------------------------------------------- rollups at scale


@query("""SELECT c_mktsegment AS app_id, count(DISTINCT o_orderkey) AS nodes, count(*) AS calls, round(sum(l_extendedprice * (1 - l_discount)), 2) AS recoverable
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def store_rollup(spark, d):
    """A rollup over joined tables."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("app_id")).agg(F.count_distinct("o_orderkey").alias("nodes"), F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("recoverable"))


@query("SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY doc_id LIMIT 1 OFFSET 7")
def page_offset(spark, d):
    """One member of a group by its place."""
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("source").alias("source"))
    return docs.join(F.broadcast(first), "source").orderBy("doc_id").offset(7).limit(1).select("doc_id")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    """Extension: tumbling windows, the batch form of the stream."""
    return windowed_counts(table(spark, d, "events"))


# ---------------------------------------------------------------- whole stages, without SQL


@query()
def drain_fields(spark, d):
    """Value templates of the lines of each language, learned from its first lines (segment.MINER_LINES) and matched with all."""
    rows = table(spark, d, "documents").select(F.col("lang").alias("key"), "doc_id", F.posexplode(lines(F.col("text"))).alias("k", "line"))
    return segment.mine_fields(rows.select("key", F.struct("doc_id", "k").alias("pos"), "line"))


@query()
def callsites(spark, d):
    """Callsites of the conversations, with quality."""
    found = identity.group(facts.fingerprints(calls(spark, d)))
    return found.nodes.select("app_id", "node_id", "size", "distinct_prompts", "confidence", "quality", "is_node", "min_internal", "max_external", "margin")


@query()
def node_metrics(spark, d):
    """Cache metrics and findings of each app's calls."""
    return metrics.node_metrics(calls(spark, d), "app_id").drop("static_lines", "dynamic_lines")


@query()
def chain_reconstruct(spark, d):
    """Runs of all apps, strict or relaxed."""
    return chain.reconstruct(calls(spark, d))[0]


__all__ = ["ORACLE_SQL", "QUERIES", "testdata"]
