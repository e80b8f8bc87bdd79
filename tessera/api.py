"""One object for a session's projects, contexts, patches and artifacts.

Every answer is a DataFrame or a dict of them. Tables of a project are written once a scan
and renewed by snapshot differences; contexts and patches keep their rows under an id made
from their content, so the same call gives the same id. Errors are raised with a code first.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import contracts, paths, tokens
from .operators import artifacts, graph, packet, parse, patches, ranking
from .sources import tree
from .storage import checkpoint
from .streaming import incremental

# Fixed values.
BUDGET, FLOOR, MODE = 8000, 0.95, "safe"
POLL_MS = 5000
DEBOUNCE_S = 2.0
ENTRYPOINTS = 20


class Rejected(ValueError):
    """A request that a guard turned down; the message starts with its code."""


def _short(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


class Workspace:
    """Projects under allowed roots. ``roots``: folders that requests may name."""

    def __init__(self, spark: SparkSession, roots: list[str]):
        self.spark, self.roots = spark, [os.path.realpath(r) for r in roots]
        self.projects: dict[str, dict] = {}
        self.contexts: dict[str, dict] = {}
        self.proposed: dict[str, dict] = {}
        self.store: DataFrame | None = None
        self.puts = 0

    # ---- guards

    def _inside_roots(self, path: str) -> str:
        if not self.roots:
            raise Rejected("NO_ALLOWED_ROOT_CONFIGURED")
        real = os.path.realpath(path)
        if not any(real == r or real.startswith(r + os.sep) for r in self.roots):
            raise Rejected(f"PATH_OUTSIDE_ROOT: {real}")
        return real

    def _project(self, repository_id: str) -> dict:
        if not (repository_id or "").strip():
            raise Rejected("REPOSITORY_ID_REQUIRED")
        if repository_id not in self.projects:
            raise Rejected(f"NO_INDEX: {repository_id}")
        return self.projects[repository_id]

    def _file(self, project: dict, path: str) -> str:
        """A path within the project, from a path inside it or relative to it."""
        real = self._inside_roots(path if os.path.isabs(path) else os.path.join(project["root"], path))
        if not real.startswith(project["root"] + os.sep):
            raise Rejected(f"PATH_OUTSIDE_REPOSITORY: {path}")
        return posixpath.join(*os.path.relpath(real, project["root"]).split(os.sep))

    # ---- projects

    def project_scan(self, repository_id: str, path: str, exclude: list[str] | None = None) -> DataFrame:
        """Index a project; its numbers of files, symbols and edges, and the files that failed."""
        if not (repository_id or "").strip():
            raise Rejected("REPOSITORY_ID_REQUIRED")
        root = self._inside_roots(path)
        bound = self.projects.get(repository_id)
        if bound and bound["root"] != root:
            raise Rejected(f"REPOSITORY_ROOT_MISMATCH: {repository_id} is bound to {bound['root']}")
        options = {"exclude": exclude} if exclude else {}
        files = checkpoint(parse.with_file_facts(tree.read_tree(self.spark, root, repo_id=repository_id, **options)))
        symbols = checkpoint(contracts.add_contract(parse.parse_symbols(files)))
        self.projects[repository_id] = {"root": root, "options": options, "files": files, "symbols": symbols, "log": bound["log"] if bound else None, "batches": bound["batches"] if bound else 0, "watch": None, "pending": None}
        self._relink(repository_id)
        return self.project_stats(repository_id)

    def _relink(self, repository_id: str) -> None:
        p = self.projects[repository_id]
        good = p["symbols"].filter("error is null")
        p["imports"] = checkpoint(graph.resolve_imports(parse.parse_imports(p["files"]), p["files"].select("repo_id", "path")))
        p["edges"] = checkpoint(graph.call_edges(good, p["imports"]))
        p["typed"] = checkpoint(graph.typed_edges(good))

    def project_stats(self, repository_id: str) -> DataFrame:
        p, key = self._project(repository_id), F.lit(repository_id).alias("repository_id")
        a = p["files"].agg(key, F.count("*").alias("files"), F.count_if("is_entrypoint").alias("entrypoints"))
        b = p["symbols"].agg(key, F.count_distinct("symbol_id").alias("symbols"), F.count("error").alias("diagnostics"))
        c = p["edges"].agg(key, F.count("*").alias("edges"))
        return a.join(b, "repository_id").join(c, "repository_id")

    def project_map(self, repository_id: str, path: str = ".", depth: int = 1) -> dict[str, DataFrame]:
        """Symbols of the focus files (50 at most) and of what they import, and the first entrypoints."""
        p = self._project(repository_id)
        real = self._inside_roots(path if os.path.isabs(path) else os.path.join(p["root"], path))
        focus = p["files"] if real == p["root"] else p["files"].filter(paths.inside(F.lit(self._file(p, path)), F.col("path")))
        start = focus.orderBy("file_ord", "path").limit(50).select(F.col("path").alias("node"))
        good = p["symbols"].filter("error is null")
        return {
            "symbols": graph.context_slice(start, graph.import_links(p["imports"]), p["edges"], good, depth),
            "entrypoints": p["files"].filter("is_entrypoint").orderBy("file_ord").limit(ENTRYPOINTS).select("path"),
        }

    # ---- watching

    def project_refresh(self, repository_id: str) -> DataFrame:
        """Look at the tree again: renew what changed; the changes of this look, by file.

        Times are listed first; only files that changed are read and parsed.
        """
        p = self._project(repository_id)
        diff = checkpoint(self._changes(p))
        p["batches"] += 1
        if diff.isEmpty():
            return diff.select(F.lit(p["batches"]).cast("long").alias("batch_ts"), "path", "change", F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
        paths_now = [r["path"] for r in diff.filter("change <> 'deleted'").select("path").collect()]  # as many as files changed since the last look
        read = tree.read_tree(self.spark, p["root"], repo_id=repository_id, only=json.dumps(paths_now))
        order = p["files"].select("path", F.col("file_ord").alias("old_ord"))
        last = p["files"].agg(F.coalesce(F.max("file_ord"), F.lit(-1))).first()[0]
        read = read.join(order, "path", "left").withColumn("file_ord", F.coalesce("old_ord", F.col("file_ord") + (last + 1))).drop("old_ord")
        now = checkpoint(parse.with_file_facts(read))
        files = checkpoint(incremental.apply_changes(p["files"], diff, now))
        fresh = contracts.add_contract(parse.parse_symbols(now))
        symbols = checkpoint(incremental.apply_changes(p["symbols"], diff, fresh))
        touched = lambda s: s.join(diff, "path", "left_semi")
        counts = incremental.change_counts(incremental.symbol_diff(touched(p["symbols"]), touched(symbols)))
        rows = diff.join(counts, "path", "left").na.fill(0, ["added", "deleted"]).select(F.lit(p["batches"]).cast("long").alias("batch_ts"), "path", "change", "added", "deleted")
        rows = checkpoint(rows)
        p |= {"files": files, "symbols": symbols, "log": checkpoint(incremental.retained(rows if p["log"] is None else p["log"].unionByName(rows)))}
        self._relink(repository_id)
        return rows

    def _changes(self, p: dict) -> DataFrame:
        """(path, change) of files since the last look, from their times alone."""
        listed = tree.list_tree(p["root"], exclude=p["options"].get("exclude"))
        now = self.spark.createDataFrame([x[:2] for x in listed], "path string, mtime_ms long")
        return incremental.listing_diff(incremental.snapshot(p["files"]), now)

    def _tick(self, repository_id: str) -> None:
        """One look of a watch. Changes wait until two seconds have passed since they were seen; meanwhile nothing is looked at."""
        p = self._project(repository_id)
        if p["pending"] is None:
            if not self._changes(p).isEmpty():
                p["pending"] = time.monotonic()
        elif time.monotonic() - p["pending"] >= DEBOUNCE_S:
            p["pending"] = None
            self.project_refresh(repository_id)

    def project_watch_start(self, repository_id: str, path: str, interval: int = POLL_MS, exclude: list[str] | None = None) -> StreamingQuery:
        """Scan, then look again every ``interval`` milliseconds until stopped."""
        if repository_id not in self.projects:
            self.project_scan(repository_id, path, exclude)
        p = self._project(repository_id)
        if p["watch"] and p["watch"].isActive:
            return p["watch"]
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        p["watch"] = ticks.writeStream.foreachBatch(lambda _, n: self._tick(repository_id)).trigger(processingTime=f"{interval} milliseconds").start()
        return p["watch"]

    def project_watch_stop(self, repository_id: str) -> bool:
        p = self._project(repository_id)
        if p["watch"]:
            p["watch"].stop()
        p["watch"] = None
        return False

    def project_watch_status(self, repository_id: str) -> DataFrame:
        p = self._project(repository_id)
        log = p["log"] if p["log"] is not None else self.spark.createDataFrame([], "batch_ts long, path string")
        active = bool(p["watch"] and p["watch"].isActive)
        return incremental.status(p["files"], p["symbols"].filter("error is null"), log).withColumn("watching", F.lit(active))

    def project_changed_symbols(self, repository_id: str, limit: int = incremental.RECENT) -> DataFrame | None:
        log = self._project(repository_id)["log"]
        return None if log is None else incremental.log_tail(log, limit)

    # ---- symbols

    def file_contracts(self, repository_id: str, file_path: str) -> DataFrame:
        p = self._project(repository_id)
        return parse.file_contracts(p["symbols"].filter(F.col("path") == self._file(p, file_path)))

    def symbol_source(self, repository_id: str, file_path: str, symbol: str, view: str = "source") -> DataFrame:
        """One symbol as source, contract or reference."""
        p = self._project(repository_id)
        if view not in ("source", "contract", "reference"):
            raise Rejected(f"UNKNOWN_VIEW: {view}")
        s = p["symbols"].filter(F.col("path") == self._file(p, file_path))
        found = s.filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol)).orderBy("sym_ord").limit(1)
        return parse.source_view(found, view)

    def symbol_context(self, repository_id: str, file_path: str, symbol: str, what: list[str]) -> dict[str, DataFrame]:
        """Any of callers, callees, tests and sideEffects of a symbol."""
        p = self._project(repository_id)
        good, at = p["symbols"].filter("error is null"), self._file(p, file_path)
        wanted = self.spark.createDataFrame([(at, symbol)], "path string, symbol string")
        out = {w: graph.neighbours(p["edges"], good, wanted, w) for w in ("callers", "callees") if w in what}
        ids = parse.lookup(good, wanted).select(F.col("symbol_id").alias("src_id"))
        if "tests" in what:
            out["tests"] = graph.test_links(good).join(ids, "src_id", "left_semi").select("test_path", "test_symbol")
        if "sideEffects" in what:
            out["sideEffects"] = good.join(ids.withColumnRenamed("src_id", "symbol_id"), "symbol_id", "left_semi").select("symbol_id", F.explode("effects").alias("effect"))
        return out

    # ---- contexts

    def _candidates(self, p: dict, at: str, task: dict, evidence: dict) -> DataFrame:
        s = p["symbols"].filter((F.col("path") == at) & F.col("error").isNull())
        target = F.lit(task.get("target") or "")
        shape = F.to_json(F.struct("symbol_id", "symbol_revision", "kind", "qualified_name", "signature", "visibility", "effects", "throws", "calls", "properties", "confidence", "start_line", "end_line"))
        text = lambda k: F.lit(json.dumps(evidence[k]) if evidence.get(k) else "")
        named = (target != "") & (F.col("qualified_name").contains(target) | F.col("name").contains(target))
        s = s.withColumns({"contract": shape, "escalates": contracts.escalates(target, text("stackTrace"), text("tests")), "risk": contracts.risk_score(), "named": named})
        none = F.lit(None).cast("int")
        s = s.withColumns({"tokens": tokens.rank_tokens(F.col("signature"), F.col("body"), F.col("effects"), F.size("calls"), F.size("throws")), "callers": none, "callees": none, "input_ord": F.col("sym_ord")})
        s = ranking.scored(s.withColumn("confidence", F.col("confidence.effects")), task.get("keywords"))
        first = s.filter("named").agg(F.min("sym_ord")).first()[0]
        s = ranking.ranked(s.withColumn("context_id", F.lit("c")), ["context_id"])
        return s.withColumns({"id": F.col("symbol_id"), "ord": F.col("rank"), "contract_tokens": tokens.packet_tokens(F.col("contract"), "json"), "body_tokens": tokens.packet_tokens(F.col("body"), "json"), "is_target": F.col("sym_ord") == F.lit(-1 if first is None else first)})

    def context_create(self, repository_id: str, task: dict, target_file: str, token_budget: int = BUDGET, quality_floor: float = FLOOR, mode: str = MODE, evidence: dict | None = None, allow_recovery: bool = True) -> str:
        """Pack the symbols of a file for a task; the id of the context. One more try with half as much budget again if that is better."""
        p, evidence = self._project(repository_id), evidence or {}
        own = str(task.get("repositoryId") or "").strip()
        if own and own != repository_id:
            raise Rejected(f"REPOSITORY_ID_MISMATCH: {repository_id} and {own}")
        at = self._file(p, target_file)
        cand = checkpoint(self._candidates(p, at, task, evidence))
        revision = p["files"].filter(F.col("path") == at).select("file_revision", "language").first()
        if revision is None:
            raise Rejected(f"TARGET_NOT_INDEXED: {target_file}")
        layer = packet.evidence_layer(self.spark.createDataFrame([("c", *[json.dumps(evidence[k]) if evidence.get(k) else "" for k in ("tests", "stackTrace", "diagnostics")])], "context_id string, tests string, stack_trace string, diagnostics string"))
        costs = layer.agg(tokens.packet_tokens(F.to_json(F.collect_list(F.struct("type", "data"))), "json").alias("t")).first()["t"]
        project = json.dumps({"project": p["root"], "language": revision["language"], "modules": []}, separators=(",", ":"))

        def once(budget: int) -> dict:
            row = ("c", int(budget), mode, float(quality_floor), task.get("taskType") or "", max(1, -(-len(project) * 55 // 100)), costs, bool(evidence.get("tests")))
            tasks = self.spark.createDataFrame([row], "context_id string, budget long, mode string, quality_floor double, task_type string, project_tokens long, evidence_tokens long, has_tests boolean")
            out = packet.build(cand.select("context_id", "id", "ord", "contract_tokens", "body_tokens", "escalates", "risk", "is_target"), tasks, checkpoint)
            return out | {"row": out["packets"].first().asDict()}

        best = first = once(token_budget)
        if allow_recovery and not first["row"]["satisfied"] and first["row"]["hints"]:
            again = once(token_budget * 3 // 2)
            if again["row"]["satisfied"] and again["row"]["quality"] > first["row"]["quality"]:
                best = again
        context_id = "ctx_" + _short(repository_id, at, revision["file_revision"], task, token_budget, quality_floor, mode, evidence)
        chosen = checkpoint(best["selected"].select("id", "with_source", "is_target").join(cand.drop("is_target"), "id"))
        self.contexts[context_id] = {
            "repository_id": repository_id, "root": p["root"], "file": at, "file_revision": revision["file_revision"], "revision": 1, "task": task, "floor": quality_floor, "evidence": layer, "chosen": chosen, "omitted": checkpoint(best["omitted"]),
            "row": best["row"], "recovery": {"attempted": best is not first or not first["row"]["satisfied"], "succeeded": best is not first, "quality_before": first["row"]["quality"]},
        }
        return context_id

    def _context(self, context_id: str) -> dict:
        if context_id not in self.contexts:
            raise Rejected(f"CONTEXT_NOT_FOUND: {context_id}")
        return self.contexts[context_id]

    def context_tables(self, context_id: str) -> dict[str, DataFrame]:
        """A context's contracts, sources, evidence, omitted symbols, coverage, callers and tests of its target."""
        c = self._context(context_id)
        key = F.lit(context_id).alias("context_id")
        held = c["chosen"].select(key, F.col("path").alias("file_path"), "symbol_id", F.col("symbol_revision").alias("revision"), "contract", F.col("body").alias("source"), "with_source")
        sources = held.filter("with_source and source <> ''")
        evidence = c["evidence"].withColumn("context_id", key)
        out = {
            "contracts": held.drop("source", "with_source"), "sources": sources.drop("contract", "with_source"), "evidence": evidence, "omitted": c["omitted"],
            "coverage": packet.coverage(sources.drop("contract", "with_source"), held.drop("source", "with_source"), evidence),
        }
        if c["task"].get("target"):
            out |= self.symbol_context(c["repository_id"], c["file"], c["task"]["target"], ["callers", "tests"])
        return out

    def context_expand(self, context_id: str, requests: list[dict]) -> DataFrame:
        """Add symbols (symbol, filePath, view) to a context; one row a request with its status and tokens added."""
        c = self._context(context_id)
        p = self._project(c["repository_id"])
        rows = [(k, self._file(p, r.get("filePath") or c["file"]), r["symbol"], r.get("view") or "contract") for k, r in enumerate(requests)]
        wanted = self.spark.createDataFrame(rows, "ord int, path string, symbol string, view string")
        found = parse.lookup(p["symbols"].filter("error is null"), wanted.select("path", "symbol").distinct()).select("path", "symbol", F.col("symbol_id").alias("id"))
        held = c["chosen"].select("id", F.col("with_source").alias("had"))
        detail = p["symbols"].filter("error is null").select(F.col("symbol_id").alias("id"), tokens.server_tokens(F.col("body")).alias("body_tokens"))
        asked = wanted.join(found, ["path", "symbol"], "left").join(held, "id", "left").join(detail, "id", "left")
        new_source = (F.col("view") == "source") & F.col("id").isNotNull() & ~F.coalesce("had", F.lit(False)) & (F.col("body_tokens") > 0)
        asked = asked.withColumns({"status": F.when(F.col("id").isNull(), "not_found").otherwise("loaded"), "tokens": F.when(new_source, F.col("body_tokens")).otherwise(0)})
        asked = checkpoint(asked.dropDuplicates(["ord"]))
        loaded = asked.filter("status = 'loaded'").groupBy("id").agg(F.max(F.col("view") == "source").alias("source"))
        fresh = None
        for path in {r[1] for r in rows}:
            part = self._candidates(p, path, c["task"], {}).join(loaded, "id").withColumn("with_source", F.col("source")).drop("source")
            fresh = part if fresh is None else fresh.unionByName(part)
        old = c["chosen"].join(loaded.withColumnRenamed("source", "s"), "id", "left").withColumn("with_source", F.col("with_source") | F.coalesce("s", F.lit(False))).drop("s")
        shape = c["chosen"].columns
        chosen = old.select(*shape) if fresh is None else old.select(*shape).unionByName(fresh.join(old.select("id"), "id", "left_anti").select(*shape))
        chosen = checkpoint(chosen)
        omitted = checkpoint(c["omitted"].join(loaded, "id", "left_anti"))
        n = chosen.agg(F.count("*").alias("contracts"), F.count_if("with_source").alias("sources"), F.max(F.col("is_target") & F.col("with_source")).alias("t")).first()
        left = omitted.count()
        has_target = n["sources"] > 0 and (bool(n["t"]) or not c["task"].get("target"))
        made = self.spark.range(1).select(
            packet.expanded_quality(F.lit(has_target), F.lit(n["contracts"] > 0), F.lit(not c["evidence"].isEmpty()), F.lit(left)).alias("q"), packet.expanded_risk(F.lit(has_target), F.lit(left), F.lit(n["contracts"])).alias("r")
        ).first()
        added = asked.agg(F.sum("tokens")).first()[0] or 0
        c["row"] = c["row"] | {"contracts": n["contracts"], "sources": n["sources"], "removed": left, "quality": made["q"], "satisfied": made["q"] >= c["floor"], "risk": made["r"], "tokens": c["row"]["tokens"] + added}
        c |= {"chosen": chosen, "omitted": omitted, "revision": c["revision"] + 1}
        return asked.orderBy("ord").select("ord", "symbol", "view", "id", "status", "tokens")

    def context_inspect(self, context_id: str) -> dict:
        """Revision, quality, risk and counts of a context."""
        c = self._context(context_id)
        return {"context_id": context_id, "revision": c["revision"], "recovery": c["recovery"]} | {k: c["row"][k] for k in ("quality", "satisfied", "risk", "tokens", "contracts", "sources", "removed", "hints", "reason")}

    # ---- patches

    def patch_propose(self, context_id: str, edits: list[dict]) -> str:
        """Resolve edits (operation, symbol, startLine, endLine, code) against a context; the id of the patch."""
        c = self._context(context_id)
        rows = [(k, e["operation"], e.get("symbol"), e.get("startLine"), e.get("endLine"), e.get("code")) for k, e in enumerate(edits)]
        patch_id = "patch_" + _short(context_id, c["revision"], rows)
        e = self.spark.createDataFrame([(patch_id, *r, c["file"]) for r in rows], "patch_id string, ord int, operation string, symbol string, start_line int, end_line int, code string, target_file string")
        keys = F.array_distinct(F.array("symbol_id", F.concat(F.lit("@"), "qualified_name"), F.concat(F.lit("@"), "name")))
        known = c["chosen"].select(F.explode(keys).alias("key"), F.struct("sym_ord", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("path").alias("file")).alias("s"))
        symbols = known.groupBy("key").agg(F.min("s").alias("s")).select("key", "s.start", "s.end", "s.file")
        resolved = checkpoint(patches.resolve_edits(e, symbols))
        wrong = resolved.filter("error is not null").orderBy("ord").select("error").first()
        if wrong:
            raise Rejected(wrong["error"])
        self.proposed[patch_id] = {"context_id": context_id, "revision": c["revision"], "edits": resolved, "hash": self._edits_hash(resolved)}
        return patch_id

    def _edits_hash(self, edits: DataFrame) -> str:
        entry = F.struct("ord", "operation", "start_line", "end_line", "code")
        return edits.agg(patches.edits_hash(F.array_sort(F.collect_list(entry))).alias("h")).first()["h"]

    def _code(self, c: dict) -> str:
        with open(os.path.join(c["root"], c["file"]), encoding="utf-8", newline="") as f:
            return f.read()

    def patch_validate(self, patch_id: str, tools: dict | None = None) -> dict:
        """Judge a patch; ``tools``: results of parse, typecheck, lint and tests (passed, failed or skipped)."""
        if patch_id not in self.proposed:
            raise Rejected("UNKNOWN_PATCH_ID")
        x = self.proposed[patch_id]
        c = self.contexts.get(x["context_id"])
        code = self._code(c) if c else ""
        now = hashlib.sha256(code.encode()).hexdigest()[:12]
        facts = [(True, x["revision"], c and c["revision"], x["hash"], self._edits_hash(x["edits"]), c and c["root"], c and self.projects[c["repository_id"]]["root"], c and os.path.join(c["root"], c["file"]), c and c["file_revision"], now)]
        names = "known boolean, context_revision int, current_revision int, edits_hash string, current_hash string, root string, current_root string, file string, expected_file string, current_file string"
        why = self.spark.createDataFrame(facts, names).select(patches.decision().alias("d")).first()["d"]
        if why:
            raise Rejected(why)
        p = self.spark.createDataFrame([(patch_id, c["root"], os.path.join(c["root"], c["file"]), code, now)], "patch_id string, root string, file string, code string, expected_revision string")
        t = self.spark.createDataFrame([(patch_id, *[(tools or {}).get(k, "skipped") for k in patches.CRITICAL])], "patch_id string, parse string, typecheck string, lint string, tests string")
        x["result"] = patches.validate(p, x["edits"], t).first().asDict() | {"original_revision": now}
        return x["result"]

    def patch_apply(self, patch_id: str) -> dict:
        """Write a validated patch to its file; the backup's path."""
        if patch_id not in self.proposed:
            raise Rejected("UNKNOWN_PATCH_ID")
        x = self.proposed[patch_id]
        c, r = self.contexts[x["context_id"]], x.get("result") or {}
        code = self._code(c)
        out = patches.applied(self.spark.createDataFrame([(patch_id, code)], "patch_id string, code string"), x["edits"]).first()
        path = os.path.join(c["root"], c["file"])
        made = hashlib.sha256(out["code_after"].encode()).hexdigest()[:12]
        now = hashlib.sha256(code.encode()).hexdigest()[:12]
        facts = [(r.get("status"), c["root"], path, r.get("original_revision"), now, made, r.get("patched_revision"))]
        why = self.spark.createDataFrame(facts, "status string, root string, file string, original_revision string, current_revision string, sandbox_revision string, validated_revision string").select(patches.apply_decision().alias("d")).first()["d"]
        if why:
            return {"status": "rejected", "reason": why}
        return {"status": "applied", "file": c["file"], "old_revision": now, "new_revision": made, "backup": patches.write_file(path, patch_id, out["code_after"])}

    # ---- artifacts

    def artifact_put(self, content: str | bytes, mime: str | None = None, ttl: int = 0, pin: bool = False, tags: list[str] | None = None, now=None) -> str:
        """Store a content; its id. A content that is there already only gets one more reference."""
        data = content.encode() if isinstance(content, str) else content
        if len(data) > artifacts.MAX_BYTES:
            raise Rejected(f"ARTIFACT_TOO_LARGE: {len(data)}")
        mime = mime or ("text/plain" if isinstance(content, str) else "application/octet-stream")
        row = self.spark.createDataFrame([(self.puts, data, mime, ttl, pin, tags or [])], "put_ord long, content binary, mime string, ttl long, pinned boolean, tags array<string>")
        one = artifacts.put(row.withColumn("created", F.lit(now).cast("timestamp") if now else F.current_timestamp()))
        self.puts += 1
        if self.store is None:
            self.store = checkpoint(one)
        else:
            both = self.store.join(one.select("artifact_id", F.lit(1).alias("more")), "artifact_id", "left")
            kept = both.withColumn("refs", F.col("refs") + F.coalesce("more", F.lit(0))).select(*self.store.columns)
            self.store = checkpoint(kept.unionByName(one.join(self.store.select("artifact_id"), "artifact_id", "left_anti").select(*self.store.columns)))
        return hashlib.sha256(data).hexdigest()

    def _stored(self) -> DataFrame:
        if self.store is None:
            self.artifact_put(b"")
            self.store = checkpoint(self.store.limit(0))
        return self.store

    def artifact_get(self, artifact_id: str, as_text: bool = False):
        """A content, or None."""
        row = artifacts.get(self._stored(), self.spark.createDataFrame([(artifact_id,)], "artifact_id string")).first()
        data = None if row["content"] is None else bytes(row["content"])
        return data.decode() if as_text and data is not None else data

    def artifact_get_chunk(self, artifact_id: str, index: int):
        row = artifacts.chunks(self._stored().filter(F.col("artifact_id") == artifact_id)).filter(F.col("chunk_index") == index).first()
        return None if row is None else {"chunk_index": index, "data": bytes(row["data"]), "total_chunks": row["chunk_count"]}

    def artifact_copy_text(self, artifact_id: str) -> str | None:
        row = artifacts.copy_text(self._stored().filter(F.col("artifact_id") == artifact_id)).first()
        return row and row["copy"]

    def artifact_pin(self, artifact_id: str, pin: bool = True) -> bool:
        event = self.spark.createDataFrame([(artifact_id, 0, pin)], "artifact_id string, ord int, pin boolean")
        known = not self._stored().filter(F.col("artifact_id") == artifact_id).isEmpty()
        self.store = checkpoint(artifacts.pin(self.store, event).select(*self.store.columns))
        return known

    def artifact_delete(self, artifact_id: str) -> str:
        """``deleted`` or ``unknown``; a pinned artifact is refused."""
        left, outcome = artifacts.delete(self._stored(), self.spark.createDataFrame([(artifact_id,)], "artifact_id string"))
        what = outcome.first()["outcome"]
        if what not in ("deleted", "unknown"):
            raise Rejected(what)
        self.store = checkpoint(left)
        return what

    def artifact_list(self, pinned: bool = False, tag: str | None = None, limit: int = artifacts.LIST_LIMIT) -> DataFrame:
        return artifacts.listed(self._stored(), pinned, tag, limit or artifacts.LIST_LIMIT)

    def artifact_stats(self) -> DataFrame:
        return artifacts.stats(self._stored(), F.octet_length(artifacts.deflate("content")))

    def artifact_gc(self, now=None) -> list[str]:
        """Ids removed because their time is up."""
        left, gone = artifacts.collect_garbage(self._stored(), F.lit(now).cast("timestamp") if now else F.current_timestamp())
        ids = [r["artifact_id"] for r in gone.collect()]
        self.store = checkpoint(left)
        return ids
