"""Packets over documents: one context a source, its documents as candidates in rank order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, packet, ranking
from ..registry import query
from ..sources import corpus
from ..storage import checkpoint
from . import graph as graph_plans
from . import ranking as ranks
from .identity import table

#: Contract cost by the rule below; body cost 0.55 a character; documents 0 modulo 3 ask for their source; risk by doc_id.
BASE = f"""{ranks.CANDIDATES},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, input_ord) AS BIGINT) AS ord FROM scored),
c AS (SELECT r.source AS context_id, CAST(r.doc_id AS VARCHAR) AS id, r.ord, 40 + r.doc_id % 25 AS contract_tokens, CAST(greatest(1, ceil(length(d.text) * 0.55::DOUBLE)) AS BIGINT) AS body_tokens, r.doc_id % 3 = 0 AS escalates, r.doc_id % 4 AS risk,
  r.ord = 3 AS is_target, ['safe', 'balanced', 'aggressive'][CAST(1 + CAST(substr(r.source, 4) AS BIGINT) % 3 AS INTEGER)] AS mode FROM ranked r JOIN documents d ON d.doc_id = r.doc_id),
costed AS (SELECT *, is_target OR escalates OR (mode = 'safe' AND risk >= 2) AS with_source FROM c),
costs AS (SELECT *, contract_tokens + CASE WHEN with_source THEN body_tokens ELSE 0 END AS cost FROM costed),
tasks AS (SELECT DISTINCT context_id, mode, CAST(4000 + CAST(substr(context_id, 4) AS BIGINT) * 100 AS BIGINT) AS budget, CASE CAST(substr(context_id, 4) AS BIGINT) % 2 WHEN 0 THEN 0.95 ELSE 0.7 END::DOUBLE AS quality_floor,
  CASE CAST(substr(context_id, 4) AS BIGINT) % 4 WHEN 0 THEN 'bugfix' ELSE 'refactor' END AS task_type, 25 AS project_tokens, 10 AS evidence_tokens, CAST(substr(context_id, 4) AS BIGINT) % 5 = 0 AS has_tests FROM c)
"""


def pick(factor: str, name: str = "") -> str:
    """SQL of the fold for budgets times ``factor``: chosen rows of each context."""
    return f"""
target{name} AS (SELECT x.context_id, x.id, x.body_tokens, least(x.body_tokens, CAST(trunc(t.budget * {factor} * CASE x.mode WHEN 'safe' THEN 0.45 WHEN 'aggressive' THEN 0.35 ELSE 0.40 END::DOUBLE) AS BIGINT)) AS cost FROM costs x JOIN tasks t ON t.context_id = x.context_id WHERE x.is_target),
lists{name} AS (SELECT t.context_id, CAST(t.budget * {factor} AS BIGINT) AS cap, CAST(t.project_tokens + COALESCE(max(g.cost), 0) AS BIGINT) AS used, list({{'used': x.cost, 'picked': [x.id]}} ORDER BY x.ord) FILTER (WHERE x.id IS NOT NULL) AS todo
  FROM tasks t LEFT JOIN target{name} g ON g.context_id = t.context_id LEFT JOIN costs x ON x.context_id = t.context_id AND NOT x.is_target GROUP BY t.context_id, t.budget, t.project_tokens),
folds{name} AS (SELECT context_id, list_reduce(list_prepend({{'used': used, 'picked': CAST([] AS VARCHAR[])}}, COALESCE(todo, [])), lambda a, x: CASE WHEN a.used + x.used <= cap THEN {{'used': a.used + x.used, 'picked': list_concat(a.picked, x.picked)}} ELSE a END).picked AS ids FROM lists{name}),
chosen{name} AS (SELECT f.context_id, u.id, x.cost FROM folds{name} f, unnest(f.ids) AS u(id) JOIN costs x ON x.id = u.id AND x.context_id = f.context_id UNION ALL SELECT context_id, id, cost FROM target{name}),
sums{name} AS (SELECT h.context_id, CAST(sum(h.cost) AS BIGINT) AS spent, count(*) AS contracts, count(*) FILTER (WHERE x.with_source AND x.body_tokens > 0) AS sources, bool_or(x.is_target AND x.with_source) AS has_target FROM chosen{name} h JOIN costs x ON x.context_id = h.context_id AND x.id = h.id GROUP BY h.context_id),
base{name} AS (SELECT t.*, n.total, COALESCE(s.spent, 0) AS spent, COALESCE(s.contracts, 0) AS contracts, COALESCE(s.sources, 0) AS sources, COALESCE(s.has_target, false) AS has_target, n.total - COALESCE(s.contracts, 0) AS removed, t.project_tokens + COALESCE(s.spent, 0) + t.evidence_tokens AS tokens
  FROM tasks t JOIN (SELECT context_id, count(*) AS total FROM costs GROUP BY context_id) n ON n.context_id = t.context_id LEFT JOIN sums{name} s ON s.context_id = t.context_id),
scoredp{name} AS (SELECT *, 0.5::DOUBLE + CASE WHEN has_target THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN contracts > 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN has_tests THEN 0.15 ELSE 0 END::DOUBLE AS q FROM base{name}),
quality{name} AS (SELECT * EXCLUDE (q), floor(CASE WHEN removed < total * 0.3::DOUBLE THEN least(1.0::DOUBLE, q + 0.1::DOUBLE) ELSE q END * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS quality FROM scoredp{name}),
packets{name} AS (SELECT *, quality >= quality_floor AS satisfied, CASE WHEN quality < quality_floor THEN 'high' ELSE 'low' END AS risk,
  CASE WHEN quality < quality_floor THEN array_to_string([x FOR x IN [CASE WHEN sources = 0 THEN 'add_target_source' END, CASE WHEN contracts = 0 THEN 'add_contracts' END, CASE WHEN NOT has_tests AND task_type = 'bugfix' THEN 'add_tests' END, CASE WHEN removed > sources * 2 THEN 'reduce_omissions' END] IF x IS NOT NULL], ',') END AS hints,
  CASE WHEN quality < quality_floor THEN CASE WHEN quality < 0.85 THEN 'missing_critical_sources' ELSE 'quality_below_floor' END END AS reason FROM quality{name})
"""


ONE = f"WITH {BASE}, {pick('1')}"


def inputs(spark, sf_dir):
    ranked = ranking.ranked(ranking.scored(ranks.candidates(spark, sf_dir), ranks.KEYWORDS), ["source"])
    text = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.ceil(F.length("text") * 0.55)).cast("long").alias("body_tokens"))
    i = F.col("doc_id")
    c = ranked.join(text, "doc_id").select(
        F.col("source").alias("context_id"), i.cast("string").alias("id"), F.col("rank").cast("long").alias("ord"), (F.lit(40) + i % 25).alias("contract_tokens"), "body_tokens", (i % 3 == 0).alias("escalates"), (i % 4).alias("risk"),
        (F.col("rank") == 3).alias("is_target"),
    )
    n = F.substring("source", 4, 10).cast("long")
    mode = F.element_at(F.array(F.lit("safe"), F.lit("balanced"), F.lit("aggressive")), (n % 3 + 1).cast("int"))
    t = table(spark, sf_dir, "documents").select("source").distinct().select(
        F.col("source").alias("context_id"), mode.alias("mode"), (n * 100 + 4000).alias("budget"), F.when(n % 2 == 0, 0.95).otherwise(0.7).alias("quality_floor"), F.when(n % 4 == 0, "bugfix").otherwise("refactor").alias("task_type"),
        F.lit(25).alias("project_tokens"), F.lit(10).alias("evidence_tokens"), (n % 5 == 0).alias("has_tests"),
    )
    return checkpoint(c), t


def built(spark, sf_dir, factor: float = 1.0):
    c, t = inputs(spark, sf_dir)
    return packet.build(c, t.withColumn("budget", (F.col("budget") * factor).cast("long")), checkpoint)


_SHOWN = "context_id, mode, budget, total, contracts, sources, removed, tokens, has_target, quality, satisfied, risk, hints, reason"


def shown(p):
    names = _SHOWN.split(", ")
    return p.withColumn("hints", F.array_join("hints", ",")).withColumns({c: F.col(c).cast("long") for c in ("budget", "total", "contracts", "sources", "removed", "tokens")}).select(*names)


@query("packet_build", f"{ONE} SELECT {_SHOWN} FROM packets")
def packet_build(spark, sf_dir):
    return shown(built(spark, sf_dir)["packets"])


@query("pack_first_fit", f"{ONE} SELECT context_id, id, CAST(cost AS BIGINT) AS cost FROM chosen")
def pack_first_fit(spark, sf_dir):
    return built(spark, sf_dir)["selected"].select("context_id", "id", F.col("cost").cast("long").alias("cost"))


@query("omitted", f"{ONE} SELECT x.context_id, x.id, 'token_budget' AS reason, x.cost AS estimated_tokens FROM costs x WHERE NOT EXISTS (SELECT 1 FROM chosen h WHERE h.context_id = x.context_id AND h.id = x.id)")
def omitted(spark, sf_dir):
    return built(spark, sf_dir)["omitted"]


@query("packet_layers", f"{ONE} SELECT context_id, total AS contracts_layer, sources AS sources_layer, CAST(CASE WHEN has_tests THEN 1 ELSE 0 END AS BIGINT) AS evidence_layer FROM packets")
def packet_layers(spark, sf_dir):
    p = built(spark, sf_dir)["packets"]
    return p.select("context_id", F.col("total").alias("contracts_layer"), F.col("sources").alias("sources_layer"), F.col("has_tests").cast("long").alias("evidence_layer"))


@query("packet_tokens", f"{ONE} SELECT context_id, CAST(tokens AS BIGINT) AS tokens, CAST(tokens > budget AS BOOLEAN) AS over_budget FROM packets")
def packet_tokens(spark, sf_dir):
    return built(spark, sf_dir)["packets"].select("context_id", F.col("tokens").cast("long").alias("tokens"), (F.col("tokens") > F.col("budget")).alias("over_budget"))


@query("packet_quality", f"{ONE} SELECT context_id, quality, satisfied FROM packets")
def packet_quality(spark, sf_dir):
    return built(spark, sf_dir)["packets"].select("context_id", "quality", "satisfied")


@query("packet_risk", f"{ONE} SELECT context_id, risk FROM packets")
def packet_risk(spark, sf_dir):
    return built(spark, sf_dir)["packets"].select("context_id", "risk")


@query("recovery_hints", f"{ONE} SELECT context_id, hints, reason FROM packets WHERE NOT satisfied")
def recovery_hints(spark, sf_dir):
    return shown(built(spark, sf_dir)["packets"]).filter("not satisfied").select("context_id", "hints", "reason")


@query(
    "packet_retry",
    f"""WITH {BASE}, {pick('1')}, {pick('1.5', '2')}, j AS (SELECT a.*, b.quality AS q2, b.satisfied AS s2, b.tokens AS t2, NOT a.satisfied AND COALESCE(a.hints, '') <> '' AS attempted FROM packets a JOIN packets2 b ON b.context_id = a.context_id)
      SELECT context_id, attempted, attempted AND s2 AND q2 > quality AS succeeded, quality AS quality_before, CASE WHEN attempted AND s2 AND q2 > quality THEN q2 ELSE quality END AS quality,
        CAST(CASE WHEN attempted AND s2 AND q2 > quality THEN t2 ELSE tokens END AS BIGINT) AS tokens FROM j""",
)
def packet_retry(spark, sf_dir):
    out = packet.better_of(built(spark, sf_dir)["packets"], built(spark, sf_dir, 1.5)["packets"])
    return out.select("context_id", "attempted", "succeeded", "quality_before", "quality", F.col("tokens").cast("long").alias("tokens"))


@query("evidence_layer", """SELECT concat(conv_id, '/', turn // 3) AS context_id, CAST(turn % 3 AS INTEGER) AS ord, ['tests', 'stackTrace', 'diagnostics'][CAST(1 + turn % 3 AS INTEGER)] AS type, text AS data FROM conversations WHERE text <> ''""")
def evidence_layer(spark, sf_dir):
    """Every three turns are the evidence of one context."""
    c = table(spark, sf_dir, "conversations").withColumn("context_id", F.concat("conv_id", F.lit("/"), F.floor(F.col("turn") / 3)))
    first = lambda k: F.max(F.when(F.col("turn") % 3 == k, F.col("text")))
    tasks = c.groupBy("context_id").agg(first(0).alias("tests"), first(1).alias("stack_trace"), first(2).alias("diagnostics"))
    return packet.evidence_layer(tasks)


_COVER = """
SELECT source AS context_id, 'exact_source' AS kind, concat(source, '/', doc_id) AS file_path, concat('d', doc_id) AS symbol_id, 'r1' AS revision, sha256(text) AS content_hash, CAST(greatest(1, ceil(length(text) * 0.40::DOUBLE)) AS BIGINT) AS token_count FROM documents
UNION ALL SELECT source, 'contract', concat(source, '/', doc_id), concat('d', doc_id), 'r1', sha256(concat('{"id":"d', doc_id, '"}')), CAST(greatest(1, ceil(length(concat('{"id":"d', doc_id, '"}')) * 0.55::DOUBLE)) AS BIGINT) FROM documents
UNION ALL SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'diagnostic' END, NULL, NULL, NULL, sha256(lang), CAST(greatest(1, ceil(length(lang) * 0.65::DOUBLE)) AS BIGINT) FROM documents"""


def covered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"context_id": F.col("source"), "file_path": F.concat("source", F.lit("/"), "doc_id"), "symbol_id": F.concat(F.lit("d"), "doc_id"), "revision": F.lit("r1")})
    base = ["context_id", "file_path", "symbol_id", "revision"]
    sources = d.select(*base, F.col("text").alias("source"))
    contracts = d.select(*base, F.concat(F.lit('{"id":"'), "symbol_id", F.lit('"}')).alias("contract"))
    evidence = d.select("context_id", F.when(F.col("doc_id") % 2 == 0, "tests").otherwise("diagnostics").alias("type"), F.col("lang").alias("data"))
    return packet.coverage(sources, contracts, evidence)


@query("coverage_manifest", _COVER)
def coverage_manifest(spark, sf_dir):
    return covered(spark, sf_dir)


@query("coverage_dedup", f"WITH c AS ({_COVER}), d AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN concat(text, '?') ELSE text END) AS content_hash FROM documents) SELECT doc_id, content_hash FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.content_hash = d.content_hash)")
def coverage_dedup(spark, sf_dir):
    """Every document is claimed, every fourth with a text that has changed since."""
    now = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    claims = table(spark, sf_dir, "documents").select("doc_id", F.sha2(now.cast("binary"), 256).alias("content_hash"))
    return packet.not_covered(claims, covered(spark, sf_dir)).select("doc_id", "content_hash")


_PRESENT = "SELECT DISTINCT source AS context_id, concat('d', doc_id // 2 * 2) AS id FROM documents"
_REQUEST = "SELECT DISTINCT source AS context_id, concat('d', doc_id // 3 * 3) AS id FROM documents"


def overlays(spark, sf_dir):
    """What packets hold and what is asked for: every document names one id of either kind."""
    d = table(spark, sf_dir, "documents")
    ids = lambda k: d.select(F.col("source").alias("context_id"), F.concat(F.lit("d"), F.expr(f"doc_id div {k} * {k}")).alias("id")).distinct()
    return ids(2), ids(3)


@query("packet_expand", f"WITH p AS ({_PRESENT}), r AS ({_REQUEST}) SELECT context_id, id, false AS added FROM p UNION ALL SELECT context_id, id, true FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.context_id = r.context_id AND p.id = r.id)")
def packet_expand(spark, sf_dir):
    return packet.overlay(*overlays(spark, sf_dir))


@query("restored_ids", f"WITH p AS ({_PRESENT}), r AS ({_REQUEST}) SELECT context_id, id FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE p.context_id = r.context_id AND p.id = r.id)")
def restored_ids(spark, sf_dir):
    return packet.restored(*overlays(spark, sf_dir))


_EXPANDED = "0.5::DOUBLE + CASE WHEN has_target THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN contracts > 0 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN has_tests THEN 0.10 ELSE 0 END::DOUBLE"


@query("expand_quality", f"{ONE} SELECT context_id, floor(CASE WHEN removed = 0 THEN least(1.0::DOUBLE, {_EXPANDED} + 0.05::DOUBLE) ELSE {_EXPANDED} END * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS quality, CASE WHEN NOT has_target THEN 'high' WHEN removed > contracts * 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS risk FROM packets")
def expand_quality(spark, sf_dir):
    p = built(spark, sf_dir)["packets"]
    return p.select("context_id", packet.expanded_quality(F.col("has_target"), F.col("contracts") > 0, F.col("has_tests"), F.col("removed")).alias("quality"), packet.expanded_risk(F.col("has_target"), F.col("removed"), F.col("contracts")).alias("risk"))


@query("packet_inspect", f"{ONE} SELECT context_id, CAST(1 AS INTEGER) AS revision, satisfied, quality, removed, risk FROM packets WHERE context_id = 'src3'")
def packet_inspect(spark, sf_dir):
    p = built(spark, sf_dir)["packets"].filter("context_id = 'src3'")
    return p.select("context_id", F.lit(1).alias("revision"), "satisfied", "quality", F.col("removed").cast("long").alias("removed"), "risk")


@query(
    "packet_enrich",
    f"""{graph_plans.WITH}, {graph_plans._WANTED}, px AS (SELECT concat('ctx_', w.path, '#', w.symbol) AS context_id, s.symbol_id AS target_id FROM w JOIN ids s ON s.path = w.path AND s.name = w.symbol)
      SELECT context_id, target_id, CAST((SELECT count(*) FROM edges e WHERE e.dst_id = px.target_id) AS BIGINT) AS callers, CAST((SELECT count(*) FROM typed e WHERE e.type = 'tests' AND e.dst_id = px.target_id) AS BIGINT) AS related_tests FROM px""",
)
def packet_enrich(spark, sf_dir):
    s, i = graph_plans.parts(spark, sf_dir)
    p = graph_plans.wanted(s).join(s.select("path", F.col("name").alias("symbol"), F.col("symbol_id").alias("target_id")), ["path", "symbol"]).select(F.concat(F.lit("ctx_"), "path", F.lit("#"), "symbol").alias("context_id"), "target_id")
    callers = graph.call_edges(s, i).select(F.col("dst_id").alias("target_id"))
    tests = graph.typed_edges(s).filter("type = 'tests'").select(F.col("dst_id").alias("target_id"))
    return packet.enriched(p, callers, tests).select("context_id", "target_id", "callers", "related_tests")


@query(
    "benchmark_savings",
    f"""{ONE}, f AS (SELECT source AS context_id, sum(length(text)) AS chars FROM documents GROUP BY source), s AS (SELECT p.context_id, p.risk, floor((1 - p.tokens / ceil(f.chars / 1.25::DOUBLE)) * 100 + 0.5::DOUBLE) AS pct FROM packets p JOIN f ON f.context_id = p.context_id)
      SELECT count(*) AS packets, floor(avg(pct) + 0.5::DOUBLE) AS average_savings, count(*) FILTER (WHERE risk = 'low') AS low_risk FROM s""",
)
def benchmark_savings(spark, sf_dir):
    """Share of tokens that packets save against whole texts."""
    p = built(spark, sf_dir)["packets"].select("context_id", "risk", "tokens")
    f = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("context_id")).agg(F.sum(F.length("text")).alias("chars"))
    pct = F.floor((F.lit(1) - F.col("tokens") / F.ceil(F.col("chars") / 1.25)) * 100 + 0.5).cast("double")
    out = p.join(f, "context_id").withColumn("pct", pct)
    return out.agg(F.count("*").alias("packets"), F.floor(F.avg("pct") + 0.5).cast("double").alias("average_savings"), F.count_if(F.col("risk") == "low").alias("low_risk"))
