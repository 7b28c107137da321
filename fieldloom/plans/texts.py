"""Queries over documents and the record tape: intake, lexical joins, retrieval, provenance, dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions import text as T
from fieldloom.operators import lexical as L, series as S, tape
from fieldloom.plans.registry import query
from fieldloom.session import materialise
from fieldloom.sources.tables import table

# the reference's lower-casing makes two characters of the dotted capital I
W = "regexp_extract_all(lower(replace({}, 'İ', 'i' || chr(775))), '[\\p{{L}}\\p{{N}}_]+')"
QUESTION = ["the", "sealed", "archive", "ledger", "ledger", "threshold"]


def docs(spark, sf):
    return table(spark, sf, "documents")


def tape_rows(spark, sf):
    return table(spark, sf, "tape_records")


@query("eligible_documents", "SELECT doc_id, source, octet_length(encode(text)) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) BETWEEN 800 AND 320000 AND NOT regexp_matches(doc_name, '(REDACTION_LOG|_manifest|INDEX\\.md$|^chunk-\\d+\\.md$|INTELLECT_FULL|_REDACTED|_lineage_|BUILD_LOG)')) WHERE r = 1")
def eligible_documents(spark, sf):
    """Documents of an admissible size and name; of a repeated path the first."""
    d = docs(spark, sf).where(F.octet_length("text").between(800, 320000) & ~F.col("doc_name").rlike(T.SKIPPED_NAMES))
    first = F.row_number().over(Window.partitionBy(F.lower("file_path")).orderBy("doc_id"))
    return d.withColumn("r", first).where("r = 1").select("doc_id", "source", F.octet_length("text").alias("bytes"))


@query("document_dates", "SELECT doc_id, CASE WHEN n IS NOT NULL THEN strftime(n, '%Y-%m-%d') ELSE strftime(make_timestamp((when_s * 1000000)::BIGINT), '%Y-%m-%d') END AS day, CASE WHEN n IS NOT NULL THEN 'name' WHEN when_s IS NOT NULL THEN 'mtime' ELSE 'absent' END AS origin FROM (SELECT *, try_cast(nullif(regexp_extract(doc_name, '(20[0-9]{2}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) AS n FROM documents)")
def document_dates(spark, sf):
    """The date in the name if it is a real day, else the time stamp's, with its origin kept apart."""
    named = F.expr(f"try_cast(nullif(regexp_extract(doc_name, '{T.DATE_IN_NAME}', 1), '') AS date)")
    stamp = F.to_date(F.timestamp_micros((F.col("when_s") * 1000000).cast("bigint")))
    origin = F.when(named.isNotNull(), "name").when(F.col("when_s").isNotNull(), "mtime").otherwise("absent")
    return docs(spark, sf).select("doc_id", F.date_format(F.coalesce(named, stamp), "yyyy-MM-dd").alias("day"), origin.alias("origin"))


@query("passages", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS body, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS seq FROM documents WHERE text IS NOT NULL) SELECT doc_id, (seq - 1)::INT AS seq, length(body) AS chars, greatest(1, length(body) // 4)::INT AS tokens, substr(body, 1, 40) AS snippet FROM p WHERE length(body) > 200")
def passages(spark, sf):
    """Paragraphs of more than 200 characters, with size and snippet."""
    p = docs(spark, sf).where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("seq", "body")).where(F.length("body") > 200)
    return p.select("doc_id", "seq", F.length("body").alias("chars"), T.token_estimate(F.col("body")).alias("tokens"), T.snippet(F.col("body"), 40).alias("snippet"))


@query("embedding_misses", "WITH k AS (SELECT md5(text) AS key, min(batch_no) AS first_batch FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT key FROM k WHERE first_batch = 8")
def embedding_misses(spark, sf):
    """Texts of the last batch that no earlier batch has in the cache: an anti join on the content hash."""
    d = docs(spark, sf).where(F.col("text").isNotNull()).select(F.md5("text").alias("key"), "batch_no")
    return d.where("batch_no = 8").select("key").distinct().join(d.where("batch_no < 8"), "key", "left_anti")


@query("hash_embedding", f"WITH w AS (SELECT doc_id, unnest({W.format('text')}) AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, md5(w) AS h FROM w), x AS (SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 256)::INT AS dim, CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT < 8 THEN 1 ELSE -1 END AS s FROM h) SELECT doc_id, dim, sum(s)::BIGINT AS x FROM x GROUP BY ALL HAVING sum(s) <> 0")
def hash_embedding(spark, sf):
    """Signed word counts in 256 dimensions by md5, sparse: the offline stand-in for an embedding server."""
    w = docs(spark, sf).select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    h = w.select("doc_id", "n", F.md5("w").alias("h"))
    sign = F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") < 8, F.col("n")).otherwise(-F.col("n"))
    dim = (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % 256).cast("int")
    return h.select("doc_id", dim.alias("dim"), sign.alias("s")).groupBy("doc_id", "dim").agg(F.sum("s").alias("x")).where("x <> 0")


@query("transcripts", "SELECT record_id, session_uuid, CASE origin WHEN 'transcript_operator' THEN 'user' ELSE 'assistant' END AS role, substr(body, 1, 60) AS snippet FROM tape_records WHERE origin LIKE 'transcript%' AND length(body) >= 120")
def transcripts(spark, sf):
    t = tape_rows(spark, sf).where(F.col("origin").startswith("transcript") & (F.length("body") >= 120))
    return t.select("record_id", "session_uuid", F.when(F.col("origin") == "transcript_operator", "user").otherwise("assistant").alias("role"), T.snippet(F.col("body"), 60).alias("snippet"))


@query("load_report", "SELECT count(*) FILTER (WHERE c.doc_id IS NOT NULL AND when_s IS NOT NULL) AS kept, count(*) FILTER (WHERE c.doc_id IS NULL) AS without_chunks, count(*) FILTER (WHERE c.doc_id IS NOT NULL AND when_s IS NULL) AS undated FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM chunks) c USING (doc_id)")
def load_report(spark, sf):
    """Documents that enter the corpus, and those dropped for want of chunks or of a date."""
    c = table(spark, sf, "chunks").select("doc_id", F.lit(True).alias("has")).distinct()
    d = docs(spark, sf).select("doc_id", "when_s").join(c, "doc_id", "left")
    return d.agg(F.count_if(F.expr("has and when_s is not null")).alias("kept"), F.count_if(F.expr("has is null")).alias("without_chunks"), F.count_if(F.expr("has and when_s is null")).alias("undated"))


@query("dense_ids", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS i FROM documents WHERE length(text) > 0")
def dense_ids(spark, sf):
    """Ids without gaps after empty documents are dropped."""
    return docs(spark, sf).where(F.length("text") > 0).select("doc_id").transform(lambda d: S.running(d, ["doc_id"], "i"))


@query("visible_pairs", "WITH v AS (SELECT doc_id FROM documents WHERE when_s <= 1748736000 AND source NOT IN ('inbox', 'drafts')), s AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY when_s, doc_id) AS b FROM documents WHERE when_s IS NOT NULL) SELECT a, b FROM s WHERE a IN (FROM v) AND b IN (FROM v)")
def visible_pairs(spark, sf):
    """Links both of whose ends pass the time and scope filters."""
    d = docs(spark, sf)
    v = d.where((F.col("when_s") <= 1748736000) & ~F.col("source").isin("inbox", "drafts")).select("doc_id")
    links = succession_rows(spark, sf).select("a", "b")
    return links.join(v.select(F.col("doc_id").alias("a")), "a", "left_semi").join(v.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")


@query("substring_search", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(coalesce(doc_name, '')), 'rado') OR contains(lower(coalesce(text, '')), 'sealed clause') UNION ALL SELECT doc_id FROM chunks WHERE contains(lower(heading), 'sealed'))")
def substring_search(spark, sf):
    """Documents by name, text, or heading of a passage."""
    d = docs(spark, sf).where(F.contains(F.lower("doc_name"), F.lit("rado")) | F.contains(F.lower("text"), F.lit("sealed clause"))).select("doc_id")
    c = table(spark, sf, "chunks").where(F.contains(F.lower("heading"), F.lit("sealed"))).select("doc_id")
    return d.unionAll(c).distinct()


@query("insufficient_rung", "SELECT record_id, CASE WHEN regexp_matches(body, '(?i)\\b(every|all|none|count|how many|how often|distribution|always|never)\\b') THEN 'R3' ELSE 'R1' END AS needs FROM tape_records WHERE contains(body, '?')")
def insufficient_rung(spark, sf):
    """Records with a question: those that quantify need a sweep (R3), the rest a ranked reading (R1)."""
    q = tape_rows(spark, sf).where(F.contains("body", F.lit("?")))
    return q.select("record_id", F.when(T.asks_for_all(F.col("body")), "R3").otherwise("R1").alias("needs"))


def succession_rows(spark, sf) -> DataFrame:
    w = Window.partitionBy("source").orderBy("when_s", "doc_id")
    return docs(spark, sf).where("when_s is not null").select(F.col("doc_id").alias("a"), F.lead("doc_id").over(w).alias("b"), F.lit(0.5).alias("w")).where("b is not null")


@query("succession", "SELECT a, b, 0.5::DOUBLE AS w FROM (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY when_s, doc_id) AS b FROM documents WHERE when_s IS NOT NULL) WHERE b IS NOT NULL")
def succession(spark, sf):
    """Consecutive documents of a lane."""
    return succession_rows(spark, sf)


@query("containment", "SELECT d.doc_id AS a, c.chunk_id AS b, 1.0::DOUBLE AS w FROM documents d JOIN chunks c USING (doc_id)")
def containment(spark, sf):
    return docs(spark, sf).select("doc_id").join(table(spark, sf, "chunks").select("doc_id", "chunk_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("chunk_id").alias("b"), F.lit(1.0).alias("w"))


@query("slice_counts", "SELECT coalesce(source, '(all)') AS lane, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(when_s) AS first_s, max(when_s) AS last_s FROM documents GROUP BY ROLLUP (source)")
def slice_counts(spark, sf):
    """Counts, characters and date span of each lane and of all."""
    return docs(spark, sf).rollup("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("when_s").alias("first_s"), F.max("when_s").alias("last_s")).select(F.coalesce("source", F.lit("(all)")).alias("lane"), "n", "chars", "first_s", "last_s")


@query("arrival_order", "SELECT doc_id, (row_number() OVER (ORDER BY when_s, doc_id) - 1)::INT AS pos FROM documents WHERE when_s IS NOT NULL")
def arrival_order(spark, sf):
    return S.arrival(docs(spark, sf).select("doc_id", "when_s"), "when_s", "doc_id").select("doc_id", "pos")


@query("replay", "SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS so_far FROM (SELECT doc_date AS day, count(*) AS n FROM chunks WHERE doc_date IS NOT NULL GROUP BY 1)")
def replay(spark, sf):
    """How many passages stand at each day."""
    d = table(spark, sf, "chunks").where("doc_date is not null").groupBy(F.col("doc_date").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("so_far", F.sum("n").over(Window.orderBy("day")))


@query("eras", "SELECT substr(doc_date, 1, 7) AS month, lane, count(*) AS n FROM chunks WHERE doc_date IS NOT NULL GROUP BY ALL")
def eras(spark, sf):
    return table(spark, sf, "chunks").where("doc_date is not null").groupBy(F.substring("doc_date", 1, 7).alias("month"), "lane").agg(F.count("*").alias("n"))


@query("token_counts", f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len({W.format('text')}) END AS words, greatest(1, length(text) // 4)::INT AS estimate FROM documents WHERE text IS NOT NULL")
def token_counts(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).alias("words"), T.token_estimate(F.col("text")).alias("estimate"))


@query("topic_match", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bledger\\b')")
def topic_match(spark, sf):
    return docs(spark, sf).where(T.mentions(F.col("text"), "ledger")).select("doc_id")


GR = f"""WITH t AS (SELECT record_id, origin, session_uuid, {W.format('body')} AS w FROM tape_records WHERE body IS NOT NULL AND kind = 'text'),
g AS (SELECT DISTINCT record_id, origin, session_uuid, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12)),
m AS (SELECT * FROM g WHERE origin LIKE 'transcript%'), nm AS (SELECT greatest(3, count(*) // 200) AS cut FROM tape_records WHERE kind = 'text' AND body IS NOT NULL AND origin LIKE 'transcript%'),
rare AS (SELECT g FROM m GROUP BY 1 HAVING count(*) <= (SELECT cut FROM nm)),
e AS (SELECT c.record_id AS chunk, m.record_id AS message, count(*) AS shared FROM g c JOIN rare USING (g) JOIN m USING (g) WHERE c.origin NOT LIKE 'transcript%' GROUP BY ALL)"""


def provenance(spark, sf) -> DataFrame:
    t = tape_rows(spark, sf).where("kind = 'text' and body is not null").select("record_id", "origin", "body")
    said = F.col("origin").startswith("transcript")
    left, right = t.where(~said).select(F.col("record_id").alias("chunk"), "body"), t.where(said).select(F.col("record_id").alias("message"), "body")
    return L.shared_grams(left, right, "chunk", "message", "body", 12)


@query("provenance_links", GR + " SELECT chunk, message, shared FROM e")
def provenance_links(spark, sf):
    """Document-side records and transcript messages that share runs of twelve words."""
    return provenance(spark, sf)


@query("provenance_sessions", GR + " SELECT r.doc_id, x.session_uuid AS session, sum(shared)::BIGINT AS weight FROM e JOIN tape_records r ON r.record_id = chunk JOIN tape_records x ON x.record_id = message GROUP BY ALL")
def provenance_sessions(spark, sf):
    """Of each document the sessions it came out of, weighted."""
    r = tape_rows(spark, sf)
    e = provenance(spark, sf).join(r.select(F.col("record_id").alias("chunk"), "doc_id"), "chunk").join(r.select(F.col("record_id").alias("message"), F.col("session_uuid").alias("session")), "message")
    return e.groupBy("doc_id", "session").agg(F.sum("shared").alias("weight"))


@query("provenance_audit", GR + " SELECT coalesce(e.chunk, p.chunk) AS chunk, coalesce(e.message, p.message) AS message, CASE WHEN p.chunk IS NULL THEN 'missing' WHEN e.chunk IS NULL THEN 'unfounded' WHEN e.shared <> p.shared THEN 'stale' ELSE 'right' END AS state FROM e FULL OUTER JOIN (SELECT chunk, message, max(shared) AS shared FROM provenance_edges GROUP BY ALL) p ON p.chunk = e.chunk AND p.message = e.message")
def provenance_audit(spark, sf):
    """The stored edges against recomputed ones."""
    old = table(spark, sf, "provenance_edges").groupBy("chunk", "message").agg(F.max("shared").alias("before"))
    both = provenance(spark, sf).join(old, ["chunk", "message"], "full_outer")
    state = F.when(F.col("before").isNull(), "missing").when(F.col("shared").isNull(), "unfounded").when(F.col("before") != F.col("shared"), "stale").otherwise("right")
    return both.select("chunk", "message", state.alias("state"))


TF = f"""WITH t AS (SELECT doc_id, lane, lower(heading) AS w FROM chunks WHERE heading IS NOT NULL), tok AS (SELECT chunk_id, lane, unnest(regexp_extract_all(lower(heading), '[a-z0-9_]+')) AS term FROM chunks WHERE heading IS NOT NULL),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 GROUP BY ALL), nd AS (SELECT count(*)::DOUBLE AS n FROM chunks WHERE heading IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.85::DOUBLE * (SELECT n FROM nd)),
raw AS (SELECT chunk_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nd), nrm AS (SELECT chunk_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1),
x AS (SELECT chunk_id, term, w / l AS w FROM raw JOIN nrm USING (chunk_id))"""


def heading_tfidf(spark, sf) -> DataFrame:
    c = table(spark, sf, "chunks").where("heading is not null").select("chunk_id", "heading")
    counts = L.term_counts(c, "chunk_id", F.filter(T.ascii_words(F.col("heading")), lambda w: F.length(w) >= 2))
    return L.tfidf(counts, c.count(), "chunk_id")


@query("tfidf_headings", TF + " SELECT chunk_id, term, round(w, 6) AS w FROM x")
def tfidf_headings(spark, sf):
    """TF-IDF of the passages' headings, each scaled to length 1."""
    return heading_tfidf(spark, sf).select("chunk_id", "term", F.round("w", 6).alias("w"))


@query("lexical_knn", TF + ", s AS (SELECT a.chunk_id AS q, b.chunk_id AS nbr, round(sum(a.w * b.w), 6) AS w FROM x a JOIN x b USING (term) WHERE a.chunk_id % 50 = 0 AND a.chunk_id <> b.chunk_id GROUP BY ALL) SELECT q, nbr, w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, nbr) AS r FROM s WHERE w >= 0.22::DOUBLE) WHERE r <= 3")
def lexical_knn(spark, sf):
    """Lexical neighbours, k = 3 at .22: every fiftieth passage against all."""
    x = L.packed(heading_tfidf(spark, sf), "chunk_id")
    return L.packed_topk(x.where("chunk_id % 50 = 0"), x, "chunk_id", 3, 0.22)


@query("label_terms", TF + ", m AS (SELECT lane, term, round(sum(x.w) / n, 9) AS w FROM x JOIN chunks USING (chunk_id) JOIN (SELECT lane, count(*) AS n FROM chunks WHERE heading IS NOT NULL GROUP BY 1) USING (lane) GROUP BY lane, term, n), r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY w DESC, term) AS r FROM m) SELECT lane, string_agg(term, ' · ' ORDER BY r) AS label FROM r WHERE r <= 4 GROUP BY 1")
def label_terms(spark, sf):
    """The four heaviest terms of each lane, as its label."""
    c = table(spark, sf, "chunks").where("heading is not null").select("chunk_id", "lane")
    n = c.groupBy("lane").agg(F.count("*").alias("n"))
    m = heading_tfidf(spark, sf).join(c, "chunk_id").groupBy("lane", "term").agg(F.sum("w").alias("s")).join(n, "lane").select("lane", "term", F.round(F.col("s") / F.col("n"), 9).alias("w"))
    top = m.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("w"), "term"))).where("r <= 4")
    return top.groupBy("lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x.term), " · ").alias("label"))


def document_weights(spark, sf) -> tuple[DataFrame, list[str]]:
    """TF-IDF of the whole texts as the reference's vectoriser has it: terms and pairs, 60,000 features. Null texts take no part."""
    x, names = L.text_weights(docs(spark, sf), "doc_id", "text")
    return materialise(x, "tfidf"), names


def named_weights(spark, sf) -> DataFrame:
    x, names = document_weights(spark, sf)
    known = spark.createDataFrame(list(enumerate(names)), "k int, term string")
    return x.select("doc_id", F.explode(F.arrays_zip("terms", "ws")).alias("x")).select("doc_id", F.col("x.terms").alias("k"), F.col("x.ws").alias("w")).join(F.broadcast(known), "k").select("doc_id", "term", "w")


@query("tfidf_documents")
def tfidf_documents(spark, sf):
    """TF-IDF of the documents' texts, each scaled to length 1."""
    return named_weights(spark, sf).select("doc_id", "term", F.round("w", 6).alias("w"))


@query("lexical_knn_documents")
def lexical_knn_documents(spark, sf):
    """Lexical neighbours by whole texts, k = 3 at .22: every fiftieth document against all."""
    x, _ = document_weights(spark, sf)
    return L.packed_topk(x.where("doc_id % 50 = 0"), x, "doc_id", 3, 0.22)


@query("label_terms_documents")
def label_terms_documents(spark, sf):
    """The four heaviest terms of each lane's texts, as its label."""
    d = docs(spark, sf).where("text is not null").select("doc_id", F.col("source").alias("lane"))
    n = d.groupBy("lane").agg(F.count("*").alias("n"))
    m = named_weights(spark, sf).join(d, "doc_id").groupBy("lane", "term").agg(F.sum("w").alias("s")).join(n, "lane").select("lane", "term", F.round(F.col("s") / F.col("n"), 9).alias("w"))
    top = m.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("w"), "term"))).where("r <= 4")
    return top.groupBy("lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x.term), " · ").alias("label"))


QS = ", ".join(f"'{w}'" for w in QUESTION)
BM = f"""WITH b AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS toks FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM b),
df AS (SELECT term, count(*)::DOUBLE AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM b) GROUP BY 1), i0 AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st), mi AS (SELECT avg(idf) AS mean FROM i0),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END AS idf FROM i0, mi), asked AS (SELECT term, count(*) AS times FROM (SELECT unnest([{QS}]) AS term) GROUP BY 1),
tf AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM b) JOIN asked USING (term) GROUP BY ALL),
bm AS (SELECT doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN asked USING (term), st GROUP BY 1)"""


def bm(spark, sf) -> DataFrame:
    return L.bm25(docs(spark, sf), "doc_id", "text", QUESTION)


@query("bm25_topk", BM + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30")
def bm25_topk(spark, sf):
    return bm(spark, sf).orderBy(F.desc("score"), "doc_id").limit(30)


RRF = BM + ", l1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM bm QUALIFY r < 30), l2 AS (SELECT doc_id, row_number() OVER (ORDER BY residual DESC, doc_id) - 1 AS r FROM (SELECT doc_id, max(residual) AS residual FROM doc_scores WHERE residual IS NOT NULL GROUP BY 1) QUALIFY r < 30), rrf AS (SELECT doc_id, round(sum(1 / (60::DOUBLE + r)), 9) AS rrf FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1)"


def fused(spark, sf) -> DataFrame:
    top = lambda d: d.orderBy(F.desc("score"), "doc_id").limit(30)
    novel = table(spark, sf, "doc_scores").where("residual is not null").groupBy("doc_id").agg(F.max("residual").alias("score"))
    return L.reciprocal_ranks([top(bm(spark, sf)), top(novel)], "doc_id")


@query("rrf_fusion", RRF + " SELECT doc_id, rrf FROM rrf")
def rrf_fusion(spark, sf):
    """The lexical ranking and the ranking by novelty, fused by reciprocal ranks."""
    return fused(spark, sf)


@query("cc_fusion", BM + ", ca AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 0.7::DOUBLE AS x FROM bm), n AS (SELECT doc_id, max(residual) AS score FROM doc_scores WHERE residual IS NOT NULL GROUP BY 1), cb AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 0.3::DOUBLE AS x FROM n) SELECT doc_id, round(sum(x), 6) AS score FROM (FROM ca UNION ALL FROM cb) GROUP BY 1")
def cc_fusion(spark, sf):
    """Convex combination of min-max scaled lists."""
    novel = table(spark, sf, "doc_scores").where("residual is not null").groupBy("doc_id").agg(F.max("residual").alias("score"))
    return L.convex_fusion([(bm(spark, sf), 0.7), (novel, 0.3)], "doc_id")


FIRED = RRF + ", lk AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY when_s, doc_id) AS b FROM documents WHERE when_s IS NOT NULL), el AS (SELECT a AS x, b AS y FROM lk WHERE b IS NOT NULL UNION ALL SELECT b, a FROM lk WHERE b IS NOT NULL), sd AS (SELECT doc_id, row_number() OVER (ORDER BY rrf DESC, doc_id) AS k FROM rrf QUALIFY k <= 6), f0 AS (SELECT doc_id, rrf FROM rrf)"
for _k in range(1, 7):  # seed after seed
    FIRED += f", f{_k} AS (SELECT doc_id, sum(rrf) AS rrf FROM (SELECT * FROM f{_k - 1} UNION ALL SELECT y, 0.35::DOUBLE * own.rrf * 0.5::DOUBLE FROM sd JOIN f{_k - 1} own ON own.doc_id = sd.doc_id JOIN el ON x = sd.doc_id WHERE sd.k = {_k}) GROUP BY 1)"


@query("ask_plan", FIRED + ", top AS (SELECT doc_id, round(rrf, 9) AS rrf FROM f6 ORDER BY 2 DESC, doc_id LIMIT 8) SELECT doc_id, rrf, source, substr(text, 1, 120) AS span FROM top LEFT JOIN documents USING (doc_id)")
def ask_plan(spark, sf):
    """The read plan: fused list, six seeds fired over succession links one after another, the best eight with their text."""
    fired = L.fire(fused(spark, sf), succession_rows(spark, sf), "doc_id")
    top = fired.orderBy(F.desc("rrf"), "doc_id").limit(8)
    return top.join(docs(spark, sf).select("doc_id", "source", T.snippet(F.col("text"), 120).alias("span")), "doc_id", "left")


LANES = "WITH p AS (SELECT DISTINCT chunk_id, lane, residual, placed_at FROM placements WHERE residual IS NOT NULL AND lane IS NOT NULL AND placed_at IS NOT NULL), l AS (SELECT lane, list((residual::DOUBLE) * (residual::DOUBLE) ORDER BY placed_at, chunk_id, residual) AS xs FROM p GROUP BY 1), ema AS (SELECT lane, list_reduce(xs, lambda s, x: 0.9::DOUBLE * s + 0.1::DOUBLE * x) AS ema, len(xs) AS n FROM l)"


def placed(spark, sf) -> DataFrame:
    return table(spark, sf, "placements").where("residual is not null and lane is not null and placed_at is not null").select("chunk_id", "lane", "residual", "placed_at").distinct()


def lane_state(spark, sf) -> DataFrame:
    r = F.col("residual").cast("double")
    return S.moving_average(placed(spark, sf), "lane", ["placed_at", "chunk_id", "residual"], r * r)


@query("lane_ema", LANES + " SELECT lane, round(ema, 6) AS ema_r2, n::INT AS n FROM ema")
def lane_ema(spark, sf):
    """Volatility of each lane: the moving average of squared residuals."""
    return lane_state(spark, sf).select("lane", F.round("ema", 6).alias("ema_r2"), "n")


@query("lane_priorities", "WITH p AS (SELECT DISTINCT chunk_id, lane, residual, placed_at FROM placements WHERE residual IS NOT NULL AND lane IS NOT NULL AND placed_at IS NOT NULL), l AS (SELECT *, list((residual::DOUBLE) * (residual::DOUBLE)) OVER (PARTITION BY lane ORDER BY placed_at, chunk_id, residual ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS xs FROM p), e AS (SELECT *, CASE WHEN len(xs) > 0 THEN list_reduce(xs, lambda s, x: 0.9::DOUBLE * s + 0.1::DOUBLE * x) END AS ema FROM l) SELECT chunk_id, placed_at, residual, CASE WHEN ema > 0 THEN round(residual::DOUBLE / sqrt(ema), 4) END AS priority FROM e")
def lane_priorities(spark, sf):
    """Residual of every placement over its lane's volatility before it; null where the lane has none yet."""
    p = placed(spark, sf).withColumn("r2", F.col("residual").cast("double") * F.col("residual").cast("double"))
    e = S.average_before(p, "lane", ["placed_at", "chunk_id", "residual"], "r2")
    return e.select("chunk_id", "placed_at", "residual", F.when(F.col("ema") > 0, F.round(F.col("residual").cast("double") / F.sqrt("ema"), 4)).alias("priority"))


@query("place_verdicts", "SELECT chunk_id, placed_at, CASE WHEN residual < 0.05::FLOAT THEN 'RETELLING' WHEN residual > 0.45::FLOAT THEN 'NOVEL' WHEN entropy > 1 THEN 'BRIDGING' WHEN residual < 0.30::FLOAT THEN 'ROUTINE' ELSE 'RELATED' END AS verdict FROM placements WHERE residual IS NOT NULL AND entropy IS NOT NULL")
def place_verdicts(spark, sf):
    p = table(spark, sf, "placements").where("residual is not null and entropy is not null")
    f = lambda x: F.lit(x).cast("float")
    return p.select("chunk_id", "placed_at", tape.verdict(F.col("residual"), F.col("entropy") > 1, f(0.05), f(0.45), f(0.30)).alias("verdict"))


@query("dossier_census", "WITH d AS (SELECT doc_id, source, n_chars, when_s FROM documents WHERE regexp_matches(text, '(?i)\\bledger\\b')), c AS (SELECT doc_id, count(*) AS n, sum(n_tokens) AS tk FROM chunks WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY 1) SELECT count(*) AS documents, count(DISTINCT source) AS lanes, sum(n)::BIGINT AS passages, sum(tk)::BIGINT AS tokens, min(when_s) AS first_s, max(when_s) AS last_s, round(count(*) / (SELECT count(*) FROM documents), 2) AS share FROM d LEFT JOIN c USING (doc_id)")
def dossier_census(spark, sf):
    """What the corpus holds on a topic."""
    all_ = docs(spark, sf)
    d = all_.where(T.mentions(F.col("text"), "ledger")).select("doc_id", "source", "when_s")
    c = table(spark, sf, "chunks").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tk"))
    total = all_.agg(F.count("*").alias("total"))
    agg = d.join(c, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("lanes"), F.sum("n").alias("passages"), F.sum("tk").alias("tokens"), F.min("when_s").alias("first_s"), F.max("when_s").alias("last_s"))
    return agg.join(total).withColumn("share", F.round(F.col("documents") / F.col("total"), 2)).drop("total")


@query("retelling_collapse", "SELECT md5(text) AS key, min_by(doc_id, (coalesce(when_s, 1e18::DOUBLE), doc_id)) AS kept, count(*) AS copies FROM documents WHERE text IS NOT NULL AND length(text) > 0 GROUP BY 1 HAVING count(*) > 1")
def retelling_collapse(spark, sf):
    """Of equal texts the earliest is kept, with their number."""
    d = docs(spark, sf).where(F.length("text") > 0)
    return d.groupBy(F.md5("text").alias("key")).agg(F.min_by("doc_id", F.struct(F.coalesce("when_s", F.lit(1e18)), "doc_id")).alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@query("set_operations", "WITH a AS (SELECT doc_id FROM documents WHERE source = 'inbox'), b AS (SELECT doc_id FROM chunks WHERE n_tokens > 300) SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)")
def set_operations(spark, sf):
    a = docs(spark, sf).where("source = 'inbox'").select("doc_id")
    b = table(spark, sf, "chunks").where("n_tokens > 300").select("doc_id")
    n = lambda op, d: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n("union", a.union(b).distinct()).unionAll(n("intersect", a.intersect(b))).unionAll(n("except", a.subtract(b)))


@query("metering", "WITH c AS (SELECT chunk_id, (n_tokens * 0.14::DOUBLE + 200 * 0.28::DOUBLE) / 1000000 AS cost FROM chunks WHERE n_tokens IS NOT NULL), r AS (SELECT chunk_id, cost, coalesce(sum(cost) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c) SELECT chunk_id, round(cost, 9) AS cost FROM r WHERE spent < 0.05::DOUBLE")
def metering(spark, sf):
    """Calls made in order while the money spent so far stays below the cap."""
    c = table(spark, sf, "chunks").where("n_tokens is not null").select("chunk_id", ((F.col("n_tokens") * 0.14 + 200 * 0.28) / 1000000).alias("cost"))
    return S.running(c, ["chunk_id"], "spent", F.col("cost")).where("spent < 0.05").select("chunk_id", F.round("cost", 9).alias("cost"))


STREAM = "CASE WHEN kind = 'text' AND session_uuid IS NOT NULL THEN session_uuid ELSE doc_id::VARCHAR END"


@query("tape_verify", f"SELECT record_id, coalesce(prev_hash = coalesce(lag(hash_hex) OVER (PARTITION BY {STREAM} ORDER BY record_id), repeat('0', 32)), false) AS ok FROM tape_records")
def tape_verify(spark, sf):
    """Whether each record's link to the one before it in its document or session holds."""
    stream = F.when((F.col("kind") == "text") & F.col("session_uuid").isNotNull(), F.col("session_uuid")).otherwise(F.col("doc_id").cast("string"))
    t = tape_rows(spark, sf).select("record_id", "prev_hash", "hash_hex", stream.alias("stream"))
    return tape.verify_chain(t, F.col("stream"), ["record_id"]).select("record_id", "ok")


@query("tape_fold", "SELECT min(record_id) AS first, count(*) AS n FROM tape_records WHERE body IS NOT NULL GROUP BY body")
def tape_fold(spark, sf):
    return tape.fold_duplicates(tape_rows(spark, sf), "body", "record_id")


@query("trust_levels", "SELECT kind, CASE WHEN origin IN ('operator_doc', 'transcript_operator') THEN 'operator' WHEN origin = 'transcript_assistant' THEN 'assistant' ELSE 'untrusted' END AS trust, count(*) AS n FROM tape_records GROUP BY ALL")
def trust_levels(spark, sf):
    return tape_rows(spark, sf).groupBy("kind", tape.trust(F.col("origin")).alias("trust")).agg(F.count("*").alias("n"))


@query("chunk_headers", "SELECT chunk_id, concat_ws(' › ', lane, heading) || ' · ' || coalesce(substr(doc_date, 1, 7), 'undated') AS header FROM chunks")
def chunk_headers(spark, sf):
    """Contextual header: lane, heading and era."""
    era = F.coalesce(F.substring("doc_date", 1, 7), F.lit("undated"))
    return table(spark, sf, "chunks").select("chunk_id", F.concat(F.concat_ws(" › ", "lane", "heading"), F.lit(" · "), era).alias("header"))


@query("position_ledger", "WITH p AS (SELECT DISTINCT chunk_id, residual, placed_at FROM placements WHERE residual IS NOT NULL AND placed_at IS NOT NULL), l AS (SELECT *, lead(placed_at) OVER (PARTITION BY chunk_id ORDER BY placed_at, residual) AS valid_to FROM p) SELECT chunk_id, residual, placed_at, valid_to FROM l WHERE valid_to IS NOT NULL")
def position_ledger(spark, sf):
    """Placements that a later one superseded, with the window in which they held."""
    p = table(spark, sf, "placements").where("residual is not null and placed_at is not null").select("chunk_id", "residual", "placed_at").distinct()
    return tape.supersede(p, ["chunk_id"], "placed_at", "residual").where("valid_to is not null").select("chunk_id", "residual", "placed_at", "valid_to")


@query("typed_deltas", "WITH m AS (SELECT partition_version AS v, chunk_id, min(community_of) AS c FROM memberships WHERE community_of IS NOT NULL GROUP BY ALL), o AS (SELECT chunk_id, c FROM m WHERE v = 1), n AS (SELECT chunk_id, c FROM m WHERE v = 2) SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(o.c, -9) AS before, coalesce(n.c, -9) AS after, CASE WHEN o.c IS NULL THEN 'introduced' WHEN n.c IS NULL THEN 'dropped' WHEN o.c <> n.c THEN 'changed' ELSE 'reinforced' END AS delta FROM o FULL OUTER JOIN n ON o.chunk_id = n.chunk_id")
def typed_deltas(spark, sf):
    m = table(spark, sf, "memberships").where("community_of is not null").groupBy("partition_version", "chunk_id").agg(F.min("community_of").alias("c"))
    return tape.deltas(m.where("partition_version = 1"), m.where("partition_version = 2"), "chunk_id", "c").fillna(-9, ["before", "after"])


@query("learned_thresholds", "WITH d AS (SELECT doc_id, avg(residual) AS r FROM doc_scores WHERE residual IS NOT NULL GROUP BY 1) SELECT round(quantile_cont(r, 0.9), 6) AS novel, round(quantile_cont(r, 0.4), 6) AS routine FROM d")
def learned_thresholds(spark, sf):
    """Novel and routine as the 90th and 40th percentile of the residuals."""
    d = table(spark, sf, "doc_scores").where("residual is not null").groupBy("doc_id").agg(F.avg("residual").alias("r"))
    q = lambda p: F.round(F.percentile("r", F.lit(p)), 6)
    return d.agg(q(0.9).alias("novel"), q(0.4).alias("routine"))


@query("support_gate", "WITH e AS (SELECT DISTINCT p.chunk, p.message, p.shared, r.doc_id, r.origin FROM provenance_edges p JOIN tape_records r ON r.record_id = p.chunk), s AS (SELECT message, count(DISTINCT doc_id) AS docs, count(*) AS n, max(shared) AS shared, bool_or(origin = 'operator_doc') AS trusted FROM e GROUP BY 1) SELECT message, docs, round(shared * n / (n + 3::DOUBLE), 6) AS w FROM s WHERE trusted OR docs >= 2")
def support_gate(spark, sf):
    """Messages whose links rest on a trusted document or on two independent ones, with shrunken weights."""
    r = tape_rows(spark, sf).select(F.col("record_id").alias("chunk"), "doc_id", "origin")
    e = table(spark, sf, "provenance_edges").select("chunk", "message", "shared").join(r, "chunk").distinct()
    s = e.groupBy("message").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("n"), F.max("shared").alias("shared"), F.bool_or(F.col("origin") == "operator_doc").alias("trusted"))
    return s.where("trusted or docs >= 2").select("message", "docs", F.round(F.col("shared") * F.col("n") / (F.col("n") + 3.0), 6).alias("w"))


@query("unit_map", "WITH c AS (SELECT lane, heading, count(*) AS n FROM chunks WHERE heading IS NOT NULL GROUP BY ALL) SELECT lane, string_agg(heading, ' | ' ORDER BY r) AS unit FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY n DESC, heading) AS r FROM c) WHERE r <= 6 GROUP BY 1")
def unit_map(spark, sf):
    """What each lane is about, extractively: its six commonest headings."""
    c = table(spark, sf, "chunks").where("heading is not null").groupBy("lane", "heading").agg(F.count("*").alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("n"), "heading"))).where("r <= 6")
    return top.groupBy("lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "heading"))), lambda x: x.heading), " | ").alias("unit"))
