"""Retain, recall and consolidate over a store of versioned tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, vector
from mnemospark.functions.constants import DIMENSIONS, GATE, MAX_RESULTS, MAX_TOKENS, RERANK_FLOOR, SIMILARITY_THRESHOLD, STRENGTH_FLOOR
from mnemospark.functions.providers import DateAnalyzer, Embedder, HashingEmbedder, Hooks, OverlapReranker, Registry, Reranker, rerank_text
from mnemospark.operators import consolidation, entities, graph, hyper, lifecycle, links, ranking, retrieval, texts
from mnemospark.sources.store import KEYS, Store, trace, tracked_documents


#: Banks that a recall names in a filter, so that only their folders are listed; more are joined.
MOST_BANKS = 1000


def _node(bank: str, id_: str) -> Column:
    """A unit's name in a graph of many banks; the bank's length keeps two pairs from having one name."""
    return F.concat(F.length(bank).cast("string"), F.lit(":"), F.col(bank), F.col(id_))


class Memory:
    """The engine's user operations. Rows of many banks and queries are worked on at once."""

    def __init__(self, store: Store, embedder: Embedder | None = None, reranker: Reranker | None = None, analyzer: DateAnalyzer | None = None, hooks: Hooks | None = None):
        self.store, self.spark = store, store.spark
        self.embedder, self.reranker = embedder or HashingEmbedder(), reranker or OverlapReranker()
        self.analyzer, self.hooks = analyzer or DateAnalyzer(), hooks or Hooks()
        self.graphs = Registry()
        self.graphs.add("push", lambda seeds, edges, mode: graph.pattern_search(seeds, None, edges, mode))
        self.graphs.add("spread", lambda seeds, edges, mode: graph.spread(seeds, edges).withColumnRenamed("activation", "score"))
        self.graphs.add("depth", lambda seeds, edges, mode: graph.engram_search(seeds, edges, mode).withColumnRenamed("activation", "score"))

    def retain(self, items: DataFrame, mode: str = "exploration", now: datetime | None = None) -> int:
        """Store contents (bank_id, document_id, content, event_date, tags): chunks, facts, entities and links.

        Returns the new version. Facts are named by a digest of their content,
        so storing the same twice adds nothing.
        """
        return self.hooks.run("retain", {"mode": mode}, lambda: self._retain(items, mode, now or datetime.now(timezone.utc)))

    def _retain(self, items: DataFrame, mode: str, now: datetime) -> int:
        base = self.store.version()
        docs = items.withColumn("document_id", F.coalesce("document_id", F.sha2("content", 256)))
        chunks = texts.chunks(docs, "bank_id", "document_id", "content")
        facts = texts.extract_facts(chunks).join(chunks.select("chunk_id", "bank_id", "document_id", "chunk_index"), "chunk_id")
        facts = facts.join(docs.select("bank_id", "document_id", "event_date", "tags"), ["bank_id", "document_id"])
        facts = facts.withColumn("unit_id", F.sha2(F.concat_ws("␟", "bank_id", "document_id", "fact"), 256)).dropDuplicates(["unit_id"])
        facts = facts.join(self.store.read("units").select("unit_id"), "unit_id", "left_anti")
        facts = facts.withColumn("place", F.col("chunk_index") * 100_000 + F.col("fact_index"))
        facts = texts.offset_times(facts, ["bank_id", "document_id"], "place", ["event_date"])
        facts = facts.withColumn("fact", text.sanitise(F.col("fact"))).withColumn("embedding", self.embedder.column(text.augmented(F.col("fact"), F.col("event_date")))).checkpoint()
        near = self._nearest(facts)
        facts = facts.join(near, "unit_id", "left").select(*facts.columns, scoring.novelty(F.col("nearest")).alias("novelty"))
        facts = facts.withColumns({"surprise": F.lit(0.5), "task_relevance": F.lit(0.5), "emotional_valence": F.lit(0.3)})
        facts = facts.withColumn("overall", scoring.overall(mode, *(F.col(d) for d in DIMENSIONS))).filter(F.col("overall") >= GATE[mode]).checkpoint()
        units = facts.select("unit_id", "bank_id", "document_id", "chunk_id", F.col("fact").alias("text"), "embedding", F.lit("world").alias("fact_type"), "event_date", F.lit(now).cast("timestamp").alias("mentioned_at"))
        dictionary = facts.select(F.col("unit_id").alias("engram_id"), "bank_id", F.col("overall").alias("strength"), F.lit("working").alias("layer"), F.lit("active").alias("status"), "tags", *DIMENSIONS, "overall", F.lit(0).alias("access_count"), F.lit(0).alias("created_session"))
        names = facts.select("unit_id", "bank_id", "event_date", F.explode(F.array_distinct(F.regexp_extract_all("fact", F.lit(r"\b\p{Lu}[\p{L}\p{N}_-]{2,}"), F.lit(0)))).alias("name"))
        said = names.withColumn("name_key", F.lower("name")).withColumn("entity_id", F.sha2(F.concat_ws("␟", "bank_id", "name_key"), 256))
        known = entities.mention_counts(names, "bank_id", "name", "event_date").select("bank_id", F.col("key").alias("name_key"), F.col("name").alias("canonical_name"), "mention_count", "last_seen", F.sha2(F.concat_ws("␟", "bank_id", "key"), 256).alias("entity_id"))
        edges = self._new_links(units, said)
        old = self.store.read("entities")
        both = old.unionByName(known).groupBy("entity_id", "bank_id", "name_key").agg(F.max_by("canonical_name", "last_seen").alias("canonical_name"), F.sum("mention_count").alias("mention_count"), F.max("last_seen").alias("last_seen"))
        tracked = tracked_documents(docs, "bank_id", "document_id", "content")
        kept = self.store.read("documents").join(tracked.select("document_id", "bank_id"), ["document_id", "bank_id"], "left_anti").unionByName(tracked, allowMissingColumns=True)
        old_chunks = self.store.read("chunks").join(chunks.select("chunk_id"), "chunk_id", "left_anti").unionByName(chunks)
        added = {t: self.store._put(t, df) for t, df in (("units", units), ("dictionary", dictionary), ("unit_entities", said.select("unit_id", "entity_id", "bank_id").distinct()), ("links", edges))}
        written = {t: [self.store._put(t, df)] for t, df in (("documents", kept), ("chunks", old_chunks), ("entities", both))}
        version = self.store.commit(written, added, base)
        return self.store.compact() or version

    def _nearest(self, facts: DataFrame) -> DataFrame:
        """Greatest similarity of each new fact to the stored ones of its bank (unit_id, nearest)."""
        stored = self.store.read("units").select("unit_id", "bank_id", "embedding")
        if stored.isEmpty():
            return self.spark.createDataFrame([], "unit_id string, nearest double")
        found = retrieval.vector_search(stored, facts.select("unit_id", "bank_id", "embedding"), "unit_id", "embedding", 1, bank="bank_id")
        return found.select(F.col("query_id").alias("unit_id"), F.col("score").alias("nearest"))

    def _new_links(self, units: DataFrame, said: DataFrame) -> DataFrame:
        """Links of new units as rows of the links table: time and similarity to all of their bank, entity links to the latest ones."""
        all_units = self.store.read("units").select("unit_id", "bank_id", "event_date").unionByName(units.select("unit_id", "bank_id", "event_date"))
        t = links.temporal_links(units, all_units, "bank_id", "unit_id", "event_date")
        vectors = self.store.read("units").select("unit_id", "bank_id", "embedding").unionByName(units.select("unit_id", "bank_id", "embedding"))
        t = t.unionByName(links.semantic_links(units, vectors, "bank_id", "unit_id", "embedding")).withColumn("entity", F.lit(None).cast("string"))
        # The latest units of an entity are those mentioned last, then those of the latest date.
        latest = [F.desc_nulls_last("mentioned_at"), F.desc_nulls_last("event_date"), F.col("unit_id")]
        dated = lambda names, rows: names.select("unit_id", "entity_id").join(rows.select("unit_id", "mentioned_at", "event_date"), "unit_id")
        e = links.new_entity_links(dated(said, units), dated(self.store.read("unit_entities"), self.store.read("units")), "unit_id", "entity_id", latest)
        both = links.valid_links(t.unionByName(e.select("a", "b", "type", "weight", "entity")))
        return both.join(all_units.select(F.col("unit_id").alias("a"), "bank_id"), "a").select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", "weight", "entity", "bank_id")

    def recall(self, queries: DataFrame, mode: str = "exploration", budget: int = 100, now: datetime | None = None) -> DataFrame:
        """Ranked facts for queries (query_id long, bank_id, query): query_id, unit_id, text, score, rank."""
        return self.hooks.run("recall", {"mode": mode, "budget": budget}, lambda: self._recall(queries, mode, budget, now or datetime.now(timezone.utc)))

    def _recall(self, queries: DataFrame, mode: str, budget: int, now: datetime) -> DataFrame:
        asked = queries.withColumn("embedding", self.embedder.column(F.col("query"))).checkpoint()
        # Only the folders of the banks that are asked are read. A unit is known by its bank and its id.
        banks = [r["bank_id"] for r in asked.select("bank_id").distinct().filter("bank_id is not null").limit(MOST_BANKS + 1).collect()]

        def of_banks(name: str) -> DataFrame:
            rows = self.store.read(name)
            return rows.filter(F.col("bank_id").isin(banks)) if len(banks) <= MOST_BANKS else rows.join(asked.select("bank_id").distinct(), "bank_id", "left_semi")

        key = of_banks("units").select("unit_id", "bank_id", "text", "embedding", "event_date", _node("bank_id", "unit_id").alias("n"))

        def best(found: DataFrame) -> DataFrame:
            return ranking.top_per(found, ["query_id"], [F.desc("score"), F.col("n")], budget).select("query_id", "n", "score", "rank")

        # Every channel counts hits of the query's own bank only.
        v = retrieval.vector_search(key, asked, "n", "embedding", budget, SIMILARITY_THRESHOLD[mode] / 2, "query_id", exclude_same=False, bank="bank_id")
        v = best(v.select(F.col("query_id").cast("long").alias("query_id"), F.col("item_id").alias("n"), "score")).checkpoint()
        w = best(retrieval.keyword_search(key, asked, budget, "n", "text", "query_id", "query", bank="bank_id").select("query_id", F.col("doc_id").alias("n"), "score"))
        window = self.analyzer.window(F.col("query"), F.lit(now).cast("timestamp"))
        dated = asked.select("query_id", "bank_id", window.alias("w")).filter("w is not null").select("query_id", "bank_id", F.col("w.start").cast("timestamp").alias("low"), (F.col("w.end").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("high"))
        none = F.lit(None).cast("timestamp")
        t = retrieval.temporal_entries(key.withColumns({"s": none, "e": none}), dated, 10, "n", "s", "e", "event_date", bank="bank_id")
        t = best(t.select("query_id", F.col("unit_id").alias("n"), F.col("proximity").alias("score"))).checkpoint()
        edges = of_banks("links").select(_node("bank_id", "src").alias("src"), _node("bank_id", "dst").alias("dst"), "type", "weight")
        g = best(self.graphs.strategies[self.graphs.default](v.select("query_id", F.col("n").alias("node"), "score"), edges, mode).select("query_id", F.col("node").alias("n"), "score"))
        fused = ranking.normalise(ranking.rrf([v, w, g, t], ["query_id"], "n"), ["query_id"], "rrf", "rrf_norm")
        rows = fused.join(key.drop("embedding"), "n").join(asked.select("query_id", "query"), "query_id")
        rows = rows.join(of_banks("dictionary").filter("status = 'active'").select("bank_id", F.col("engram_id").alias("unit_id"), "strength", "tags", *DIMENSIONS), ["bank_id", "unit_id"], "left")
        rows = rows.join(t.select("query_id", "n", F.col("score").alias("near")), ["query_id", "n"], "left").filter(F.coalesce("strength", F.lit(0.5)) >= STRENGTH_FLOOR[mode])
        rows = rows.withColumn("rerank", scoring.sigmoid(self.reranker.column(F.col("query"), rerank_text(F.col("text"), F.lit(""), F.col("event_date")))))
        strength = F.coalesce("strength", F.lit(0.5))
        days = (scoring.seconds(F.lit(now).cast("timestamp")) - scoring.seconds(F.col("event_date"))) / 86400
        overlap = text.jaccard(text.query_tags(F.col("query")), F.coalesce("tags", F.array().cast("array<string>")))
        score = scoring.combined(mode, rerank=F.col("rerank"), rrf=F.col("rrf_norm"), temporal=F.coalesce("near", F.lit(0.5)), recency=scoring.recency(days, strength), strength=scoring.strength_weight(strength), thalamus=scoring.thalamus_weight(mode, *(F.col(d) for d in DIMENSIONS)), tags=overlap)
        rows = rows.withColumn("score", score).withColumn("tokens", text.n_tokens(F.col("text"))).withColumn("hits", (F.col("source") == 1).cast("int"))
        rows = retrieval.floor_with_fallback(rows, ["query_id"], "rerank", RERANK_FLOOR[mode], "hits")
        order = [F.desc("score"), F.col("unit_id")]
        rows = ranking.token_budget(rows, ["query_id"], order, "tokens", MAX_TOKENS[mode])
        return ranking.top_per(rows, ["query_id"], order, MAX_RESULTS[mode]).select("query_id", "unit_id", "text", "score", "rank")

    def reflect(self, queries: DataFrame, mode: str = "exploration") -> DataFrame:
        """The facts that an answer rests on, as one prompt a query; text is made by a replaceable model."""
        found = self.recall(queries, mode).join(queries.select("query_id", "query"), "query_id")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: F.concat(F.lit("- "), r["text"])), "\n")
        return found.groupBy("query_id", "query").agg(lines.alias("facts"), F.avg("score").alias("confidence"))

    def consolidate(self, phases: tuple[str, ...] = ("promote", "decay", "cluster"), mode: str | None = None, now: datetime | None = None) -> dict[str, object]:
        """Run phases in order, each on the version the one before wrote; a failed phase is reported, later ones still run."""
        work = {"promote": self._promote, "decay": self._decay, "cluster": lambda m: self._cluster(now or datetime.now(timezone.utc)), "restructure": lambda m: self._restructure(now or datetime.now(timezone.utc))}
        report: dict[str, object] = {}
        for p in phases:
            try:
                report[p] = work[p](mode)
            except Exception as error:  # noqa: BLE001  a phase's failure is a result of the run
                report[p] = f"failed: {error}"
        return report

    def _rated(self) -> DataFrame:
        counts = self.store.read("access_events").groupBy(F.col("unit_id").alias("engram_id")).agg(F.count(F.lit(1)).alias("_more"))
        sessions = self.store.read("banks").select("bank_id", "session_count")
        rows = self.store.read("dictionary").join(counts, "engram_id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_more", F.lit(0))).drop("_more")
        return lifecycle.with_sizes(rows.join(sessions, "bank_id", "left").withColumn("session_count", F.coalesce("session_count", F.lit(0))))

    def _promote(self, mode: str | None) -> int:
        base, rows = self.store.version(), self._rated()
        open_ = (F.coalesce("layer", F.lit("working")) == "working") & (F.col("status") == "active")
        done = lifecycle.promote(rows.filter(open_), mode)
        done = done.withColumns({"layer": F.col("new_layer"), "status": F.col("new_status"), "strength": F.col("new_strength")})
        old = self.store.read("dictionary")
        return self.store.replace({"dictionary": old.filter(~open_).unionByName(done.join(old.select("engram_id", F.col("access_count").alias("_own")), "engram_id").withColumn("access_count", F.col("_own")).select(old.columns))}, base)

    def _decay(self, mode: str | None) -> int:
        base, rows = self.store.version(), self._rated()
        old = self.store.read("dictionary")
        done = lifecycle.decay_sweep(rows.filter("status = 'active'")).select("engram_id", "new_status", "new_strength")
        new = old.join(done, "engram_id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("strength", F.coalesce("new_strength", "strength"))
        banks = self.store.read("banks")
        return self.store.replace({"dictionary": new.select(old.columns), "banks": banks.withColumn("session_count", F.col("session_count") + 1)}, base)

    def _cluster(self, now: datetime) -> int:
        """One cycle of schema emergence, all in one version.

        Clusters of the active buffer meet the fingerprints of earlier cycles.
        Those met in a second cycle reinforce the schema that they are nearest to
        or become one. A member counts as evidence of a schema once, whatever the
        number of cycles: it is linked to it, and only members without a link add
        evidence and move the centroid.
        """
        base, at = self.store.version(), now.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        buffer = self.store.read("dictionary").filter("layer = 'buffer' and status = 'active'").select("bank_id", F.col("engram_id").alias("unit_id"))
        rows = self.store.read("units").join(buffer, ["bank_id", "unit_id"], "left_semi").select("bank_id", "unit_id", "embedding", F.monotonically_increasing_id().alias("n")).checkpoint()
        found = consolidation.clusters(rows, "bank_id", "n", "embedding").select(F.col("id").alias("n"), F.col("cluster").alias("c"))
        members = found.join(rows, "n")
        # A cluster is known by its bank and its smallest unit.
        names = members.groupBy("c").agg(F.min("unit_id").alias("name"))
        members = members.join(names, "c").select("bank_id", "unit_id", "embedding", _node("bank_id", "name").alias("cluster"), "name").checkpoint()
        c = consolidation.centroids(members, ["bank_id", "cluster", "name"], "embedding").checkpoint()
        prints, schemas = self.store.read("fingerprints"), self.store.read("schemas")
        met = consolidation.match(c, prints, "cluster", "id", bank="bank_id").checkpoint()
        seen = consolidation.mature(met, prints, at, by=("bank_id",)).checkpoint()
        ready = met.join(seen.filter("ready").select("bank_id", F.col("id").alias("match")), ["bank_id", "match"], "left_semi").drop("match", "similarity")
        known = consolidation.match(ready, schemas.filter("status = 'active'"), "cluster", "schema_id", bank="bank_id").select("bank_id", "cluster", "name", "match")
        own = F.coalesce("match", F.concat(F.lit("schema-"), F.col("cluster")))
        evidence = members.drop("name").join(known, ["bank_id", "cluster"]).select("bank_id", "cluster", "match", "unit_id", "embedding", own.alias("dst"))
        linked = self.store.read("links").filter("type = 'schema'").select("bank_id", F.col("src").alias("unit_id"), "dst")
        fresh = evidence.join(linked, ["bank_id", "unit_id", "dst"], "left_anti").checkpoint()
        moved = consolidation.centroids(fresh, ["bank_id", "cluster", "match"], "embedding")
        after = consolidation.reinforce(moved, schemas, at, by=("bank_id",))
        after = after.join(schemas.select("bank_id", "schema_id", "properties", "status"), ["bank_id", "schema_id"], "left").withColumn("status", F.coalesce("status", F.lit("active")))
        edges = fresh.select(F.col("unit_id").alias("src"), "dst", F.lit("schema").alias("type"), F.lit(1.0).alias("weight"), "bank_id")
        changes = {t: [self.store._put(t, df)] for t, df in (("fingerprints", seen), ("schemas", after))}
        return self.store.commit(changes, {"links": self.store._put("links", edges)}, base)

    def _restructure(self, now: datetime) -> int:
        """Active schemas that are alike but differ in a property get a parent, a schema of its own.

        Parents are active schemas themselves (ids ``hyper-...``) and are not
        paired again; nor is a schema that has one. Links to the parent are edges
        of type ``specializes``. Properties are texts, sets of values joined by ``|``.
        """
        base, schemas = self.store.version(), self.store.read("schemas")
        has = self.store.read("schema_edges").filter("type = 'specializes'").select("bank_id", F.col("src").alias("schema_id"))
        open_ = schemas.filter("status = 'active' and schema_id not like 'hyper-%'").join(has, ["bank_id", "schema_id"], "left_anti")
        rows = open_.select(F.col("bank_id").alias("of"), F.col("schema_id").alias("id"), "centroid", "evidence", text.describe(F.coalesce("properties", F.create_map().cast("map<string,string>"))).alias("description"), "properties").checkpoint()
        empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in hyper.PROPERTY.split(", ")}
        each = rows.select("of", "id", F.explode("properties").alias("key", "value"))
        each = each.select("of", "id", *(c.alias(n) for n, c in (empty | {"key": F.col("key"), "type": F.lit("categorical"), "value": F.col("value")}).items()))
        parents, properties = hyper.hyper_schemas(rows.drop("properties"), each)
        maps = properties.groupBy("of", "hyper_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("value", F.lit(""))))).alias("properties"))
        new = parents.join(maps, ["of", "hyper_id"], "left").select(F.col("hyper_id").alias("schema_id"), F.col("of").alias("bank_id"), "centroid", "properties", "evidence", F.lit("active").alias("status"), F.lit(now.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp").alias("last_reinforced"))
        edges = parents.select(F.explode(F.array("a", "b")).alias("src"), F.col("hyper_id").alias("dst"), F.lit("specializes").alias("type"), F.col("of").alias("bank_id"))
        return self.store.replace({"schemas": schemas.unionByName(new), "schema_edges": self.store.read("schema_edges").unionByName(edges)}, base)

    def record_access(self, found: DataFrame, now: datetime) -> int:
        """Append access events of results near the top."""
        top = ranking.access_bump(found, ["query_id"], "score")
        banks = self.store.read("units").select("unit_id", "bank_id")
        return self.store.append({"access_events": top.select("unit_id").join(banks, "unit_id").withColumn("at", F.lit(now).cast("timestamp"))})

    def stats(self) -> DataFrame:
        """Units, links and strength by bank."""
        u = self.store.read("units").groupBy("bank_id").agg(F.count(F.lit(1)).alias("units"))
        l = self.store.read("links").groupBy("bank_id").agg(F.count(F.lit(1)).alias("links"))
        d = self.store.read("dictionary").groupBy("bank_id").agg(F.avg("strength").alias("strength"), F.count_if(F.col("status") == "active").alias("active"))
        return u.join(l, "bank_id", "left").join(d, "bank_id", "left").fillna(0)

    def list_units(self, bank: str, needle: str = "", fact_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of a bank's units, newest first, without a date last."""
        rows = self.store.read("units", bank)
        rows = rows if fact_type is None else rows.filter(F.col("fact_type") == fact_type)
        rows = retrieval.search_text(rows, needle, ["text"]) if needle else rows
        return rows.orderBy(F.desc_nulls_last("event_date"), "unit_id").offset(offset).limit(limit)

    def list_entities(self, bank: str, limit: int = 100) -> DataFrame:
        return self.store.read("entities", bank).orderBy(F.desc("mention_count"), F.desc("last_seen"), "entity_id").limit(limit)

    def list_documents(self, bank: str, needle: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of a bank's documents with the number of their units."""
        docs = self.store.read("documents", bank)
        docs = retrieval.search_text(docs, needle, ["document_id"]) if needle else docs
        n = self.store.read("units", bank).groupBy("document_id").agg(F.count(F.lit(1)).alias("units"))
        return docs.join(n, "document_id", "left").fillna(0, ["units"]).orderBy("document_id").offset(offset).limit(limit)

    def list_schemas(self, bank: str, limit: int = 100) -> DataFrame:
        """Active schemas, latest first, with their maturity by share of the bank's evidence."""
        rows = self.store.read("schemas", bank).filter("status = 'active'")
        share = F.col("evidence") / F.sum("evidence").over(Window.partitionBy("bank_id"))
        return rows.withColumn("maturity", scoring.maturity(share, F.col("evidence"))).orderBy(F.desc("last_reinforced"), "schema_id").limit(limit)

    def update_schema(self, bank: str, schema: str, **fields: object) -> int:
        """Set some fields of a schema; its keys cannot be changed. Returns the new version."""
        base, rows = self.store.version(), self.store.read("schemas")
        if fixed := sorted(set(KEYS["schemas"]) & set(fields)):
            raise ValueError(f"fields that cannot change: {', '.join(fixed)}")
        if unknown := sorted(set(fields) - set(rows.columns)):
            raise ValueError(f"no such fields: {', '.join(unknown)}")
        this = F.col("bank_id").eqNullSafe(F.lit(bank)) & F.col("schema_id").eqNullSafe(F.lit(schema))
        return self.store.replace({"schemas": rows.withColumns({c: F.when(this, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in fields.items()})}, base)

    def archive_schema(self, bank: str, schema: str) -> int:
        """Take a schema off the list of active ones."""
        return self.update_schema(bank, schema, status="archived")

    def describe_schemas(self, bank: str) -> DataFrame:
        return self.store.read("schemas", bank).select("schema_id", text.describe(F.coalesce("properties", F.create_map().cast("map<string,string>"))).alias("description"))

    def graph(self, bank: str, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a bank for display."""
        units = self.store.read("units", bank).orderBy(F.desc_nulls_last("event_date"), "unit_id").limit(limit).select(F.col("unit_id").alias("id"), "text")
        strength = self.store.read("dictionary", bank).select(F.col("engram_id").alias("id"), "strength")
        return graph.view(units, self.store.read("links", bank), strength)

    def advance_session(self, bank: str) -> int:
        base, banks = self.store.version(), self.store.read("banks")
        return self.store.replace({"banks": banks.withColumn("session_count", F.col("session_count") + (F.col("bank_id") == bank).cast("int"))}, base)

    def get(self, table: str, **keys: str) -> DataFrame:
        """The rows of a table with the given key values: a document, chunk, entity, schema, profile or trace."""
        rows = self.store.read(table)
        for column, value in keys.items():
            rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def put(self, table: str, rows: DataFrame) -> int:
        """Insert or replace rows by key: banks and profiles, model settings, working memory, operations."""
        return self.store.upsert(table, rows)

    def operations(self, bank: str, status: str | None = None) -> DataFrame:
        """Jobs of a bank, by kind and id; a cancelled one is removed with ``cancel``."""
        rows = self.store.read("operations", bank)
        return (rows if status is None else rows.filter(F.col("status") == status)).orderBy("type", "operation_id")

    def cancel(self, bank: str, operation: str) -> int:
        base, rows = self.store.version(), self.store.read("operations")
        return self.store.replace({"operations": rows.filter(~((F.col("bank_id") == bank) & (F.col("operation_id") == operation)))}, base)

    def record(self, kind: str, rows: DataFrame, bank: str = "bank_id") -> int:
        """Append trace rows (of a retain or consolidation run) as JSON."""
        return self.store.append({"traces": trace(rows, kind, bank)})

    def traces(self, bank: str, kind: str, limit: int = 100) -> DataFrame:
        """The latest traces of a bank and the length of their bodies."""
        rows = self.store.read("traces", bank).filter(F.col("kind") == kind)
        return rows.orderBy(F.desc("at"), "trace_id").limit(limit).select("trace_id", "at", F.length("body").alias("length"), "body")

    def entity(self, bank: str, entity: str, limit: int = 50) -> DataFrame:
        """The latest facts that name an entity."""
        units = self.store.read("unit_entities", bank).filter(F.col("entity_id") == entity).select("unit_id")
        return self.store.read("units", bank).join(units, "unit_id", "left_semi").orderBy(F.desc_nulls_last("event_date"), "unit_id").limit(limit)

    def layers(self) -> DataFrame:
        """Engrams and mean strength by bank and layer."""
        return self.store.read("dictionary").groupBy("bank_id", F.coalesce("layer", F.lit("working")).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.avg("strength").alias("strength"))

    def similar_schemas(self, bank: str, least: float = 0.7) -> DataFrame:
        """Pairs of a bank's schemas that may become hyper-schemas."""
        rows = self.store.read("schemas", bank).withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
        return hyper.pair_up(rows, "bank_id", "schema_id", least, 0)

    def similarity(self, a: str, b: str) -> DataFrame:
        """Cosine of two units' vectors."""
        u = self.store.read("units")
        x, y = u.filter(F.col("unit_id") == a).select(F.col("embedding").alias("x")), u.filter(F.col("unit_id") == b).select(F.col("embedding").alias("y"))
        return x.withColumn("k", F.lit(1)).join(y.withColumn("k", F.lit(1)), "k").select(vector.cosine(F.col("x"), F.col("y")).alias("similarity"))
