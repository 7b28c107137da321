"""The engine as an object: the verbs build, ask, place, dossier, unit_map, converge, fronts, report, partition, stability, grow, provenance; and a command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom import catalogue
from fieldloom.functions import text as T, vectors as V
from fieldloom.operators import graph, knn, lexical as L, partitions as P, series as S, tape
from fieldloom.session import materialise


class Engine:
    """Over chunks (chunk_id, doc_id, lane, body, day, vec array<double> of length 1) and documents (doc_id, lane, text, when_s)."""

    def __init__(self, documents: DataFrame, chunks: DataFrame, near: float = 0.60, duplicate: float = 0.97, bridge: float = 0.62):
        self.documents, self.chunks = documents, chunks
        self.near, self.duplicate, self.bridge = near, duplicate, bridge
        self.spark: SparkSession = chunks.sparkSession

    def rows(self) -> DataFrame:
        """(id, grp, pos, v) of the chunks in arrival order of their documents."""
        order = S.arrival(self.documents.select("doc_id", "when_s"), "when_s", "doc_id").select("doc_id", "pos")
        return self.chunks.join(order, "doc_id").select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("grp"), F.col("pos").cast("bigint").alias("pos"), F.col("vec").alias("v"))

    def build(self) -> DataFrame:
        """(src_kind, a, b, slice, w): semantic, duplicate, document, containment and succession links."""
        r = self.rows()
        sem = knn.either_lists(knn.block_topk(r, r, 3, self.near)).select(F.lit("chunk").alias("src_kind"), "a", "b", F.when(F.col("w") >= self.duplicate, "dup").otherwise("sem").alias("slice"), "w")
        d = P.mean_vectors(r, "grp", "v").select(F.col("grp").alias("id"), "grp", F.lit(0).cast("bigint").alias("pos"), F.col("centroid").alias("v"))
        doc = knn.either_lists(knn.block_topk(d, d, 4, 0.50)).select(F.lit("doc").alias("src_kind"), "a", "b", F.lit("doc").alias("slice"), "w")
        con = self.chunks.select(F.lit("doc").alias("src_kind"), F.col("doc_id").alias("a"), F.col("chunk_id").alias("b"), F.lit("con").alias("slice"), F.lit(1.0).alias("w"))
        suc = graph.lead_lag(self.documents.where("when_s is not null"), "lane", ["when_s", "doc_id"], "doc_id").select(F.lit("doc").alias("src_kind"), "a", "b", F.lit("suc").alias("slice"), F.lit(0.5).alias("w"))
        return sem.unionByName(doc).unionByName(con).unionByName(suc)

    def ask(self, question: str, vector: list[float], k: int = 8) -> DataFrame:
        """(chunk_id, rrf, needs, absent, span): spans to read, never an answer."""
        q = self.spark.createDataFrame([(vector,)], "query array<double>")
        scored = knn.scan(self.chunks.select("chunk_id", "vec"), q, F.round(V.dot(F.col("vec"), F.col("query")), 6), 30, "chunk_id")
        words = [w for w in self.spark.createDataFrame([(question,)], "q string").select(T.ascii_words(F.col("q"))).first()[0]]
        lists = [scored]
        if words:
            lists.append(L.bm25(self.chunks, "chunk_id", "body", words).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(30))
        r = self.rows()
        edges = knn.either_lists(knn.block_topk(r, r, 3, self.near))
        top = L.fire(L.reciprocal_ranks(lists, "chunk_id"), edges, "chunk_id").orderBy(F.desc("rrf"), "chunk_id").limit(k)
        rung = F.when(T.asks_for_all(F.lit(question)), "R3").otherwise("R1")
        spans = self.chunks.join(q).select("chunk_id", T.snippet(F.col("body")).alias("span"), V.dot(F.col("vec"), F.col("query")).alias("cos"))
        best = F.max_by("cos", "rrf").over(_all())
        return top.join(spans, "chunk_id").select("chunk_id", "rrf", rung.alias("needs"), (best < 0.5).alias("absent"), "span")

    def place(self, new: DataFrame) -> DataFrame:
        """(chunk_id, nbr, residual, bridging, verdict) of new chunks (chunk_id, vec) against the field."""
        side = lambda d, g: d.select(F.col("chunk_id").alias("id"), F.lit(g).cast("bigint").alias("grp"), F.lit(0).cast("bigint").alias("pos"), F.col("vec").alias("v"))
        best = knn.block_topk(side(new, -1), side(self.chunks, -2), 5)
        community = self.chunks.select(F.col("chunk_id").alias("nbr"), "lane")
        per = best.join(community, "nbr").groupBy("q").agg(F.max("w").alias("w"), F.max_by("nbr", F.struct("w", -F.col("nbr"))).alias("nbr"), F.count_distinct(F.when(F.col("w") >= self.bridge, F.col("lane"))).alias("lanes"))
        residual = 1 - F.col("w")
        return per.select(F.col("q").alias("chunk_id"), "nbr", F.round(residual, 6).alias("residual"), (F.col("lanes") > 1).alias("bridging"), tape.verdict(residual, F.col("lanes") > 1).alias("verdict"))

    def converge(self, shuffles: int = 3) -> DataFrame:
        """(decile, residual, shuffled, advantage) of arrival order against shuffled ones."""
        from pyspark.sql import Window

        r = materialise(self.rows(), "converge")
        timed, out = S.deciles(S.residual_curve(r, self.duplicate)), None
        for s in range(shuffles):
            order = r.select("grp").distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{s}-"), F.col("grp").cast("string"))), "grp")).cast("bigint"))
            one = S.deciles(S.residual_curve(r.drop("pos").join(order, "grp").select("id", "grp", "pos", "v"), self.duplicate))
            out = one if out is None else out.unionByName(one)
        mean = out.groupBy("decile").agg(F.avg("residual").alias("shuffled"))
        return timed.join(mean, "decile").select("decile", "residual", "shuffled", F.try_divide(F.col("shuffled") - F.col("residual"), F.col("shuffled")).alias("advantage"))

    def fronts(self, window: int = 8, trailing: int = 40) -> DataFrame:
        from pyspark.sql import Window

        curve = S.residual_curve(self.rows(), self.duplicate).withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1)
        return S.fronts(S.front_z(curve, window, trailing))

    def partition(self, seeds: int = 3, k: int = 10, floor: float = 0.50) -> DataFrame:
        """(id, community): consensus of runs with other seeds on the mutual neighbour graph, small communities folded."""
        r = materialise(self.rows(), "partition")
        links = materialise(knn.both_list(knn.block_topk(r, r, k, floor)), "mutual")
        nodes, runs = r.select(F.col("id").alias("node")), None
        for s in range(seeds):
            one = graph.louvain(nodes, links, seed=s).withColumn("run", F.lit(s))
            runs = one if runs is None else runs.unionByName(one)
        labels = graph.consensus(nodes, links, runs).select(F.col("node").alias("id"), F.col("component").alias("community"))
        return P.fold_small(r, labels, "id", "v")

    def grow(self, base_fraction: float = 0.8) -> DataFrame:
        """One row: chunks that join the frozen communities of the earlier documents, overflow, and drift after growth."""
        r = materialise(self.rows(), "grow")
        n = r.select("grp").distinct().count()
        base = r.where(F.col("pos") < int(n * base_fraction))
        early = Engine(self.documents.join(base.select(F.col("grp").alias("doc_id")).distinct(), "doc_id"), self.chunks, self.near, self.duplicate, self.bridge)
        frozen = materialise(early.partition(), "frozen")
        cents = materialise(P.mean_vectors(base.join(frozen, "id"), "community", "v"), "cents")
        new = P.assign_capped(r.where(F.col("pos") >= int(n * base_fraction)), cents)
        after = frozen.unionByName(new)
        moved = P.drift(after, P.nearest_centroid(r, cents, "id"), "id")
        return new.agg(F.count("*").alias("n_new"), F.count_if(F.col("community") < 0).alias("overflow")).join(moved)

    def dossier(self, topic: str) -> DataFrame:
        """(month, documents): when the corpus speaks of a topic."""
        return self.documents.where(T.mentions(F.col("text"), topic)).groupBy(F.date_format(F.timestamp_seconds("when_s"), "yyyy-MM").alias("month")).agg(F.count("*").alias("documents"))

    def dossier_documents(self, topic: str) -> DataFrame:
        """(doc_id, when_s, month, chunks, share): the documents that speak of a topic, with how many of their chunks do."""
        hit = self.chunks.where(T.mentions(F.col("body"), topic)).groupBy("doc_id").agg(F.count("*").alias("chunks"))
        every = self.chunks.groupBy("doc_id").agg(F.count("*").alias("all"))
        dated = self.documents.select("doc_id", "when_s", F.date_format(F.timestamp_seconds("when_s"), "yyyy-MM").alias("month"))
        return hit.join(every, "doc_id").join(dated, "doc_id").select("doc_id", "when_s", "month", "chunks", F.round(F.col("chunks") / F.col("all"), 2).alias("share"))

    def place_documents(self, new: DataFrame, lanes: DataFrame) -> DataFrame:
        """(doc_id, residual, bridges, verdict, priority, ema_after) of new chunks (chunk_id, doc_id, lane, vec); lanes: (lane, ema)."""
        per = self.place(new).join(new.select("chunk_id", "doc_id", F.col("lane").alias("sent")), "chunk_id")
        d = per.groupBy("doc_id", F.col("sent").alias("lane")).agg(F.avg("residual").alias("r"), F.avg(F.col("residual") * F.col("residual")).alias("r2"), F.count_if(F.col("bridging")).alias("bridges")).join(lanes, "lane", "left")
        after = F.when(F.col("ema").isNull(), F.col("r2")).otherwise(0.9 * F.col("ema") + 0.1 * F.col("r2"))
        return d.select("doc_id", "lane", F.round("r", 6).alias("residual"), "bridges", tape.verdict(F.col("r"), F.col("bridges") > 0).alias("verdict"), F.when(F.col("ema") > 0, F.col("r") / F.sqrt("ema")).alias("priority"), after.alias("ema_after"))

    def unit_map(self, labels: DataFrame, central: int = 6) -> DataFrame:
        """(community, chunk_id, w, r, span) of the most central chunks of each community. labels: (id, community)."""
        from pyspark.sql import Window

        r = self.chunks.select(F.col("chunk_id").alias("id"), F.col("vec").alias("v"), "body").join(labels, "id")
        scored = r.join(P.mean_vectors(r, "community", "v").select("community", "centroid"), "community").withColumn("w", F.round(V.dot(F.col("v"), F.col("centroid")), 6))
        rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("w"), "id"))
        return scored.withColumn("r", rank).where(F.col("r") <= central).select("community", F.col("id").alias("chunk_id"), "w", "r", T.snippet(F.col("body")).alias("span"))

    def report(self) -> DataFrame:
        """One row: documents, chunks, quantiles of the residuals and the number of fronts."""
        curve = materialise(S.residual_curve(self.rows(), self.duplicate), "report")
        q = lambda p: F.round(F.percentile("residual", F.lit(p)), 4)
        fronts = S.fronts(S.front_z(S.running(curve, ["pos"], "i"))).agg(F.count("*").alias("fronts"))
        sizes = self.documents.where("when_s is not null").agg(F.count("*").alias("documents")).join(self.chunks.agg(F.count("*").alias("chunks")))
        return sizes.join(curve.agg(q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"))).join(fronts)  # one-row tables

    def stability(self, seeds: int = 3) -> DataFrame:
        """One row: mean and worst ARI of partitions by other seeds against the first."""
        r = materialise(self.rows(), "stability")
        nodes, links = r.select(F.col("id").alias("node")), materialise(knn.both_list(knn.block_topk(r, r, 10, 0.50)), "mutual")
        first = graph.louvain(nodes, links, seed=0).select("node", F.col("community").alias("x"))
        out = None
        for s in range(1, seeds):
            one = P.adjusted_rand(first.join(graph.louvain(nodes, links, seed=s).select("node", F.col("community").alias("y")), "node"))
            out = one if out is None else out.unionByName(one)
        return out.agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("worst_ari"))

    def provenance(self, messages: DataFrame, n: int = 12) -> DataFrame:
        """(chunk, message, shared) by exact runs of n words. messages: (message, body)."""
        return L.shared_grams(self.chunks.select(F.col("chunk_id").alias("chunk"), "body"), messages, "chunk", "message", "body", n)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


#: Verbs of the command line and the queries that answer them.
VERBS = {"build": "passage_links", "ask": "ask_plan", "place": "place_documents", "dossier": "dossier_documents", "codex": "unit_central", "converge": "advantage", "fronts": "fronts", "report": "report", "partition": "partition_consensus", "stability": "seed_stability", "grow": "grow", "provenance": "provenance_links", "what_changed": "typed_deltas", "selftest": "selftest_digest"}


def main(argv: list[str] | None = None) -> None:
    """python -m fieldloom.plans.engine VERB|QUERY FOLDER: show a query of the catalogue over a folder of tables; `about` lists them."""
    import sys

    from fieldloom.session import get_session

    args = sys.argv[1:] if argv is None else argv
    names = catalogue.queries()
    name = VERBS.get(args[0], args[0]) if args else ""
    if len(args) != 2 or name not in names:
        print("usage: engine VERB|QUERY FOLDER\nverbs:", *(f"{v} ({q})" for v, q in VERBS.items()), "queries:", *sorted(names), sep="\n  ")
        return
    names[name](get_session(), args[1]).show(40, truncate=80)


if __name__ == "__main__":
    main()
