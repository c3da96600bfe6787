"""The queries over the given tables and, where SQL has the same rows, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import text as tx
from topicspark.functions import vectors as vx
from topicspark.operators import assign, charts, cluster, ctfidf, distribution, dynamic, embed, hierarchy, lineage, merge_models, outliers, topics, tuners
from topicspark.sources.readers import table, texts
from topicspark.sources.shared import written
from topicspark.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "with", "der", "die", "und", "la", "le", "les", "el", "que")
SEEDS = {"the": 2.0, "and": 1.2, "that": 1.2}
CUSTOM = {0: "First topic", 2: "Third topic"}
#: A skewed topic from -1 to 3 for documents that have none.
NUMBER = "least(doc_id % 7, doc_id % 5) - 1"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _docs(spark: SparkSession, d: str, topic: str = "source") -> DataFrame:
    """``doc_id, text, topic, lang, slot`` with a given column, or a skewed number, as topic."""
    rows = texts(spark, d, "documents")
    of = F.expr(f"cast({NUMBER} as int)") if topic == "number" else F.col(topic)
    return rows.select("doc_id", "text", of.alias("topic"), "lang", (F.col("doc_id") % 10).alias("slot"))


def _counts(docs: DataFrame, **options) -> DataFrame:
    """``topic, word, n``, written: the texts are read once, all that follows comes from the counts."""
    counts = ctfidf.term_counts(docs, **options)
    return written(counts, "counts") if "min_df" in options or "max_features" in options else counts


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, embedding, label`` of the documents that have a vector."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("int").alias("topic"))
    return rows.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # the source takes folders, and of this one the file or folder of the table
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _r(c: str, n: int = 8) -> Column:
    return F.round(c, n).alias(c)


# SQL that several queries begin with

WORDS = r"regexp_extract_all(lower(regexp_replace(replace(replace(coalesce(text, ''), chr(10), ' '), chr(9), ' '), '[^A-Za-z0-9 ]+', '', 'g')), '[a-z0-9]{2,}')"


def _cte(topic: str = "source", where: str = "") -> str:
    """d, tok (with positions), cnt, tot, a, w: documents to weights."""
    of = f"CAST({NUMBER} AS INTEGER)" if topic == "number" else topic
    return f"""
d AS (SELECT doc_id, {of} AS topic, lang, doc_id % 10 AS slot, {WORDS} AS ws FROM documents),
tok AS (SELECT doc_id, topic, lang, slot, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
cnt AS (SELECT topic, word, count(*) AS n FROM tok {where} GROUP BY ALL),
tot AS (SELECT topic, sum(n)::DOUBLE AS s FROM cnt GROUP BY 1),
a AS (SELECT floor(avg(s)) AS a FROM tot),
dfs AS (SELECT word, sum(n)::DOUBLE AS df FROM cnt GROUP BY 1),
idf AS (SELECT word, df, ln(1 + a.a / df) AS idf FROM dfs, a),
w AS (SELECT c.topic, c.word, c.n, i.df, c.n / t.s * i.idf AS weight FROM cnt c JOIN tot t USING (topic) JOIN idf i USING (word))"""


def _top(of: str = "w", n: int = 10, score: str = "weight") -> str:
    return f"""
SELECT topic, CAST(rank AS INTEGER) AS rank, word, round({score}, 8) AS score FROM
  (SELECT topic, word, {score}, row_number() OVER (PARTITION BY topic ORDER BY {score} DESC, word) AS rank FROM {of}) WHERE rank <= {n}"""


def _ranked(weighted: DataFrame, n: int = 10) -> DataFrame:
    # equal weights differ in the last bits between engines
    return ctfidf.top_words(weighted.withColumn("weight", F.round("weight", 12)), n).select("topic", "rank", "word", _r("score"))


W12 = ", w12 AS (SELECT topic, word, n, round(weight, 12) AS weight FROM w)"


@query("preprocess_tokens", f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS n_tokens, array_to_string({WORDS}, ' ') AS words FROM documents")
def preprocess_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = tx.words(F.col("text"))
    return texts(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("words"))


@query("ctfidf_top_words", f"WITH {_cte()}{W12} {_top('w12')}")
def ctfidf_top_words(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d))))


@query("ctfidf_bm25", f"WITH {_cte()}, v AS (SELECT topic, word, round(n / s * ln(1 + (a - df + 0.5) / (df + 0.5)), 12) AS weight FROM w JOIN tot USING (topic), a) {_top('v')}")
def ctfidf_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d)), bm25=True))


@query("ctfidf_sqrt", f"WITH {_cte()}, v AS (SELECT topic, word, round(sqrt(n / s) * ln(1 + a / df), 12) AS weight FROM w JOIN tot USING (topic), a) {_top('v')}")
def ctfidf_sqrt(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d)), reduce_frequent_words=True))


_CASE = "CASE word " + " ".join(f"WHEN '{w}' THEN {x}" for w, x in SEEDS.items()) + " ELSE 1 END"


@query("ctfidf_seeded", f"WITH {_cte()}, v AS (SELECT topic, word, round(weight * {_CASE}, 12) AS weight FROM w) {_top('v')}")
def ctfidf_seeded(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d)), seeds=ctfidf.seed_factors(["the"], 2.0, [["and", "that"]])))


def _restricted(keep: str) -> str:
    sql = _cte().replace("cnt AS (", "cnt0 AS (").replace("tot AS (", f"cnt AS (SELECT * FROM cnt0 WHERE word IN ({keep})),\ntot AS (", 1)
    return f"WITH {sql}{W12} {_top('w12')}"


@query("ctfidf_min_df", _restricted("SELECT word FROM cnt0 GROUP BY word HAVING count(*) >= 3"))
def ctfidf_min_df(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d), min_df=3)))


@query("ctfidf_max_features", _restricted("SELECT word FROM (SELECT word, sum(n) AS s FROM cnt0 GROUP BY word ORDER BY s DESC, word LIMIT 500)"))
def ctfidf_max_features(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d), max_features=500)))


@query("ctfidf_stop_words", f"WITH {_cte(where='WHERE word NOT IN ' + str(STOP_WORDS))}{W12} {_top('w12')}")
def ctfidf_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d), stop_words=STOP_WORDS)))


_BI = _cte().replace(
    "cnt AS (SELECT topic, word, count(*) AS n FROM tok  GROUP BY ALL)",
    """nxt AS (SELECT topic, word, lead(word) OVER (PARTITION BY topic ORDER BY doc_id, pos) AS b FROM tok),
grams AS (SELECT topic, word FROM nxt UNION ALL SELECT topic, word || ' ' || b FROM nxt WHERE b IS NOT NULL),
cnt AS (SELECT topic, word, count(*) AS n FROM grams GROUP BY ALL)""",
)


@query("ctfidf_bigrams", f"WITH {_BI}{W12} {_top('w12')}")
def ctfidf_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(ctfidf.weights(_counts(_docs(spark, d), ngram_range=(1, 2))))


# sizes, labels, information

_SIZES = f"sizes AS (SELECT CAST({NUMBER} AS INTEGER) AS topic, count(*) AS count FROM documents GROUP BY 1)"
_N = f"WITH {_cte('number')}{W12}, top AS ({_top('w12')}), {_SIZES}, lists AS (SELECT topic, string_agg(word, '|' ORDER BY rank) AS words, list(word ORDER BY rank) AS ws FROM top GROUP BY 1)"


def _described(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = _docs(spark, d, "number")
    counts = _counts(docs)
    weighted = written(ctfidf.weights(counts), "weights")
    words = written(ctfidf.word_lists(_ranked(weighted)), "words")
    return {"docs": docs, "counts": counts, "weights": weighted, "words": words, "labels": topics.labels(words), "sizes": topics.sizes(docs)}


@query("topic_freq", f"WITH {_SIZES} SELECT topic, count FROM sizes ORDER BY count DESC, topic")
def topic_freq(spark: SparkSession, d: str) -> DataFrame:
    return topics.sizes(_docs(spark, d, "number")).orderBy(F.desc("count"), "topic")


@query("topic_info", f"{_N} SELECT topic, count, topic || '_' || array_to_string(ws[1:4], '_') AS name, words FROM sizes JOIN lists USING (topic)")
def topic_info(spark: SparkSession, d: str) -> DataFrame:
    t = _described(spark, d)
    return topics.topic_info(t["sizes"], t["words"], t["labels"]).select("topic", "count", "name", F.array_join("words", "|").alias("words"))


@query("topic_labels", f"{_N} SELECT topic, topic || '_' || array_to_string(ws[1:4], '_') AS label FROM lists")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d)["labels"]


@query("generated_labels", f"{_N} SELECT topic, array_to_string(list_transform(ws[1:3], lambda x: x[1:5]), '-') AS label FROM lists")
def generated_labels(spark: SparkSession, d: str) -> DataFrame:
    return topics.labels(_described(spark, d)["words"], 3, False, "-", 5)


@query("custom_labels", f"{_N} SELECT topic, CASE topic WHEN 0 THEN 'First topic' WHEN 2 THEN 'Third topic' ELSE topic || '_' || array_to_string(ws[1:4], '_') END AS label FROM lists")
def custom_labels(spark: SparkSession, d: str) -> DataFrame:
    return topics.custom_labels(_described(spark, d)["labels"], CUSTOM)


_REPR = f"""WITH {_cte('number')},
x AS (SELECT doc_id, topic, word, count(*) * any_value(idf) AS x FROM tok JOIN idf USING (word)
      WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY topic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM d) WHERE r <= 500) GROUP BY ALL),
l AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM w GROUP BY 1),
s AS (SELECT x.doc_id, x.topic, sum(x.x * w.weight) / (sqrt(sum(x.x * x.x)) * any_value(l.l)) AS similarity FROM x JOIN w USING (topic, word) JOIN l USING (topic) GROUP BY ALL),
rep AS (SELECT topic, CAST(rank AS INTEGER) AS rank, doc_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 3)"""


@query("representative_docs", f"{_REPR} SELECT topic, rank, doc_id, round(similarity, 8) AS similarity FROM rep")
def representative_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "number")
    counts = _counts(docs)
    return topics.representative_docs(docs, written(ctfidf.weights(counts), "weights"), ctfidf.idf(counts)).select("topic", "rank", "doc_id", _r("similarity"))


@query("document_info", f"""{_REPR}{W12}, top AS ({_top('w12')}), lists AS (SELECT topic, list(word ORDER BY rank) AS ws FROM top GROUP BY 1)
SELECT d.doc_id, d.topic, d.topic || '_' || array_to_string(lists.ws[1:4], '_') AS name, array_to_string(lists.ws, ' - ') AS top_n_words, rep.doc_id IS NOT NULL AS representative_document
FROM d LEFT JOIN lists USING (topic) LEFT JOIN rep ON rep.doc_id = d.doc_id""")
def document_info(spark: SparkSession, d: str) -> DataFrame:
    t = _described(spark, d)
    found = topics.representative_docs(t["docs"], t["weights"], ctfidf.idf(t["counts"]))
    info = topics.topic_info(t["sizes"], t["words"], t["labels"])
    return topics.document_info(t["docs"].select("doc_id", "topic"), info, found).select("doc_id", "topic", "name", "top_n_words", "representative_document")


# lineage


@query("rerank_by_size", f"WITH {_SIZES} SELECT topic, CAST(CASE WHEN topic = -1 THEN -1 ELSE row_number() OVER (ORDER BY topic = -1, count DESC, topic) - 1 END AS INTEGER) AS new_topic FROM sizes")
def rerank_by_size(spark: SparkSession, d: str) -> DataFrame:
    return lineage.ranked(topics.sizes(_docs(spark, d, "number")))


def _moved(mapping: str) -> str:
    return f"""WITH m AS (SELECT doc_id, CAST(CASE t {mapping} ELSE t END AS INTEGER) AS topic FROM (SELECT doc_id, {NUMBER} AS t FROM documents)),
s AS (SELECT topic, count(*) AS count FROM m GROUP BY 1),
r AS (SELECT topic, CAST(CASE WHEN topic = -1 THEN -1 ELSE row_number() OVER (ORDER BY topic = -1, count DESC, topic) - 1 END AS INTEGER) AS new_topic FROM s)
SELECT doc_id, new_topic AS topic FROM m JOIN r USING (topic)"""


def _move(spark: SparkSession, d: str, mapping: dict[int, int]) -> DataFrame:
    moved = lineage.apply(_docs(spark, d, "number").select("doc_id", "topic"), mapping)
    # a row a topic
    return moved.join(F.broadcast(lineage.ranked(topics.sizes(moved))), "topic").select("doc_id", F.col("new_topic").alias("topic"))


@query("merge_topics", _moved("WHEN 2 THEN 1"))
def merge_topics(spark: SparkSession, d: str) -> DataFrame:
    return _move(spark, d, lineage.merge_mapping([[1, 2]]))


@query("delete_topics", _moved("WHEN 0 THEN -1"))
def delete_topics(spark: SparkSession, d: str) -> DataFrame:
    return _move(spark, d, lineage.delete_mapping([0]))


_STEPS = [(0, -1, -1), (0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 0), (1, -1, -1), (1, 0, 0), (1, 1, -1), (1, 2, 3), (2, -1, -1), (2, 0, 1), (2, 3, 0)]


@query("lineage_compose", f"""WITH e AS (SELECT * FROM (VALUES {', '.join(map(str, _STEPS))}) v(step, f, t))
SELECT CAST(a.f AS INTEGER) AS from_topic, CAST(coalesce(c.t, -1) AS INTEGER) AS to_topic FROM (SELECT * FROM e WHERE step = 0) a
LEFT JOIN (SELECT * FROM e WHERE step = 1) b ON b.f = a.t LEFT JOIN (SELECT * FROM e WHERE step = 2) c ON c.f = coalesce(b.t, -1)""")
def lineage_compose(spark: SparkSession, d: str) -> DataFrame:
    return lineage.composed(spark.createDataFrame(_STEPS, lineage.EDGES), 3)


_PROB = "p AS (SELECT doc_id, CAST(unnest(range(0, 4)) AS INTEGER) AS topic FROM documents), q AS (SELECT doc_id, topic, (1 + (doc_id * 7 + topic * 13) % 11) / 40.0::DOUBLE AS probability FROM p)"


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("topic"))
    return rows.select("doc_id", "topic", ((1 + (F.col("doc_id") * 7 + F.col("topic") * 13) % 11) / F.lit(40.0)).alias("probability"))


@query("map_probabilities", f"WITH {_PROB} SELECT doc_id, CAST(CASE topic WHEN 2 THEN 1 ELSE topic END AS INTEGER) AS topic, round(sum(probability), 8) AS probability FROM q WHERE topic <> 3 GROUP BY 1, 2")
def map_probabilities(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, -1)], "from_topic int, to_topic int")
    return lineage.map_probabilities(_probabilities(spark, d), mapping).select("doc_id", "topic", _r("probability"))


# vectors

_V = """v AS (SELECT vec_id AS doc_id, CAST(label AS INTEGER) AS topic, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
long AS (SELECT doc_id, topic, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
cen AS (SELECT topic, list(x ORDER BY i) AS c, any_value(n) AS n FROM (SELECT topic, i, avg(x) AS x, count(*) AS n FROM long GROUP BY ALL) GROUP BY 1)"""


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return vx.means(_vectors(spark, d), "topic", "embedding")


@query("topic_centroids", f"WITH {_V} SELECT topic, CAST(i AS INTEGER) AS dim, round(avg(x), 8) AS x FROM long GROUP BY ALL")
def topic_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(spark, d).select("topic", F.posexplode("embedding").alias("dim", "x")).select("topic", (F.col("dim") + 1).alias("dim"), _r("x"))


@query("merged_centroids", f"WITH {_V} SELECT CAST(least(topic, 6) AS INTEGER) AS topic, CAST(i AS INTEGER) AS dim, round(avg(x), 8) AS x FROM long GROUP BY ALL")
def merged_centroids(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([(i, min(i, 6)) for i in range(10)], "from_topic int, to_topic int")
    merged = assign.merged_vectors(_centroids(spark, d), mapping)
    return merged.select("topic", F.posexplode("embedding").alias("dim", "x")).select("topic", (F.col("dim") + 1).alias("dim"), _r("x"))


_NEAR = "SELECT doc_id, topic, round(s, 8) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 11) DESC, topic) AS r FROM near) WHERE r = 1"


@query("nearest_topic", f"WITH {_V}, near AS (SELECT v.doc_id, cen.topic, list_cosine_similarity(v.e, cen.c) AS s FROM v, cen) {_NEAR}")
def nearest_topic(spark: SparkSession, d: str) -> DataFrame:
    return assign.nearest_topic(_vectors(spark, d), _centroids(spark, d)).select("doc_id", "topic", _r("similarity"))


@query("find_topics", f"WITH {_V} SELECT topic, round(list_cosine_similarity(c, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 8) AS similarity FROM cen ORDER BY similarity DESC, topic LIMIT 5")
def find_topics(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return assign.find_topics(_centroids(spark, d), list(asked), 5).select("topic", _r("similarity"))


@query("topic_similarity", f"WITH {_V} SELECT a.topic AS topic_a, b.topic AS topic_b, round(list_cosine_similarity(a.c, b.c), 8) AS similarity FROM cen a, cen b")
def topic_similarity(spark: SparkSession, d: str) -> DataFrame:
    return assign.topic_similarity(_centroids(spark, d)).select("topic_a", "topic_b", _r("similarity"))




def _three(dim: int = 64) -> np.ndarray:
    """Three fixed directions: every third dimension."""
    return np.array([[1.0 if (i + 1) % 3 == k else 0.0 for i in range(dim)] for k in range(3)])


_THREE = f"three AS (SELECT CAST(k AS INTEGER) AS topic, list(CASE WHEN i % 3 = k THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY i) AS c FROM range(3) t(k), range(1, 65) u(i) GROUP BY 1)"


@query("zero_shot_assign", f"WITH {_V}, {_THREE}, near AS (SELECT v.doc_id, three.topic, list_cosine_similarity(v.e, three.c) AS s FROM v, three), best AS ({_NEAR}) SELECT doc_id, CASE WHEN similarity >= 0.1 THEN topic END AS topic, similarity FROM best")
def zero_shot_assign(spark: SparkSession, d: str) -> DataFrame:
    found = assign.zero_shot(_vectors(spark, d), _three(), 0.1)
    return found.select("doc_id", "topic", _r("similarity"))


@query("guided_topics", f"""WITH {_V}, {_THREE}, mean AS (SELECT -1 AS topic, list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM long GROUP BY 1)),
seeds AS (SELECT * FROM three UNION ALL SELECT * FROM mean),
near AS (SELECT v.doc_id, seeds.topic, list_cosine_similarity(v.e, seeds.c) AS s FROM v, seeds),
best AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 11) DESC, CASE topic WHEN -1 THEN 9 ELSE topic END) AS r FROM near) WHERE r = 1)
SELECT doc_id, CAST(best.topic AS INTEGER) AS topic, round(v.e[1] * CASE WHEN best.topic >= 0 THEN 0.75 ELSE 1 END + CASE WHEN best.topic >= 0 THEN 0.25 * (SELECT c[1] FROM three t WHERE t.topic = best.topic) ELSE 0 END, 8) AS first_number
FROM best JOIN v USING (doc_id)""")
def guided_topics(spark: SparkSession, d: str) -> DataFrame:
    found = assign.guided(_vectors(spark, d), _three())
    return found.select("doc_id", "topic", F.round(F.col("embedding")[0], 8).alias("first_number"))


@query("merge_models", f"""WITH {_V}, half AS (SELECT doc_id % 2 AS model, topic, i, avg(x) AS x, count(*) AS n FROM long GROUP BY ALL),
m AS (SELECT model, topic, list(x ORDER BY i) AS c, any_value(n) AS n FROM half GROUP BY ALL),
s AS (SELECT b.topic, a.topic AS known, list_cosine_similarity(b.c, a.c) AS s FROM m a JOIN m b ON a.model = 0 AND b.model = 1),
best AS (SELECT topic, known, round(s, 9) >= 0.4 AS same FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(s, 11) DESC, known) AS r FROM s) WHERE r = 1),
moved AS (SELECT 0 AS model, topic AS f, topic AS t FROM m WHERE model = 0 UNION ALL
  SELECT 1, topic, CASE WHEN same THEN known ELSE (SELECT max(topic) FROM m WHERE model = 0) + row_number() OVER (PARTITION BY same ORDER BY topic) END FROM best),
sized AS (SELECT t, sum(n)::DOUBLE AS size FROM moved JOIN m ON m.model = moved.model AND m.topic = moved.f GROUP BY 1)
SELECT CAST(model AS INTEGER) AS model, CAST(f AS INTEGER) AS from_topic, CAST(t AS INTEGER) AS to_topic, size FROM moved JOIN sized USING (t)""")
def merge_two_models(spark: SparkSession, d: str) -> DataFrame:
    """Two models of the even and the odd documents; the second one's topics that are unlike all of the first get new numbers."""
    rows = _vectors(spark, d)
    halves = [vx.means(rows.where(F.col("doc_id") % 2 == k), "topic", "embedding") for k in (0, 1)]
    mappings, vectors = merge_models.merge(halves, 0.4)
    moved = spark.createDataFrame([(k, a, b) for k, m in enumerate(mappings) for a, b in sorted(m.items())], "model int, from_topic int, to_topic int")
    return moved.join(vectors.select(F.col("topic").alias("to_topic"), "size"), "to_topic").select("model", "from_topic", "to_topic", "size")


# over time and by class

_SLICED = """sl AS (SELECT {by} AS slice, topic, word, count(*) AS n FROM tok GROUP BY ALL),
st AS (SELECT slice, topic, sum(n)::DOUBLE AS s FROM sl GROUP BY ALL),
raw AS (SELECT sl.slice, sl.topic, sl.word, sl.n / st.s * idf.idf AS weight FROM sl JOIN st USING (slice, topic) JOIN idf USING (word)),
nrm AS (SELECT slice, topic, word, weight / sum(weight) OVER (PARTITION BY slice, topic) AS weight FROM raw),
glo AS (SELECT topic, word, weight / sum(weight) OVER (PARTITION BY topic) AS weight FROM w),
mix AS (SELECT slice, topic, word, sum(weight) / 2 AS weight FROM (SELECT * FROM nrm UNION ALL SELECT p.slice, p.topic, g.word, g.weight FROM (SELECT DISTINCT slice, topic FROM nrm) p JOIN glo g USING (topic)) GROUP BY ALL)"""
_DONE = """top AS (SELECT slice, topic, string_agg(word, ', ' ORDER BY r) AS words FROM (SELECT *, row_number() OVER (PARTITION BY slice, topic ORDER BY round(weight, 12) DESC, word) AS r FROM {of}) WHERE r <= 5 GROUP BY ALL),
f AS (SELECT {by} AS slice, topic, count(*) AS frequency FROM d GROUP BY ALL)
SELECT f.topic, coalesce(top.words, '') AS words, f.frequency, f.slice AS {name} FROM f LEFT JOIN top USING (slice, topic)"""


def _time_sql(of: str, by: str = "slot", name: str = "timestamp") -> str:
    return f"WITH RECURSIVE {_cte('number')}, {_SLICED.format(by=by)}, {_DONE.format(of=of, by=by, name=name)}"


def _over_time(spark: SparkSession, d: str, **options: bool) -> DataFrame:
    docs = _docs(spark, d, "number")
    sliced = dynamic.slice_counts(docs, "slot")
    counts = ctfidf.summed(sliced, docs)
    return dynamic.topics_over_time(docs, ctfidf.weights(counts), ctfidf.idf(counts), "slot", sliced=sliced, **options)


@query("topics_over_time", _time_sql("mix"))
def topics_over_time(spark: SparkSession, d: str) -> DataFrame:
    return _over_time(spark, d)


@query("topics_over_time_local", _time_sql("nrm"))
def topics_over_time_local(spark: SparkSession, d: str) -> DataFrame:
    return _over_time(spark, d, global_tuning=False)


_EVOLVED = """pr AS (SELECT DISTINCT slice, topic FROM nrm),
tm AS (SELECT slice, row_number() OVER (ORDER BY slice) AS t FROM (SELECT DISTINCT slice FROM pr)),
voc AS (SELECT DISTINCT topic, word FROM glo),
grid AS (SELECT tm.t, pr.slice, pr.topic, g.word, coalesce(nrm.weight, 0) AS own, g.weight AS g FROM pr JOIN tm USING (slice) JOIN glo g USING (topic) LEFT JOIN nrm ON nrm.slice = pr.slice AND nrm.topic = pr.topic AND nrm.word = g.word),
ev AS (SELECT t, slice, topic, word, (own + g) / 2 AS weight FROM grid q WHERE NOT EXISTS (SELECT 1 FROM pr JOIN tm USING (slice) WHERE pr.topic = q.topic AND tm.t = q.t - 1)
  UNION ALL SELECT q.t, q.slice, q.topic, q.word, ((q.own + ev.weight) / 2 + q.g) / 2 FROM ev JOIN grid q ON q.t = ev.t + 1 AND q.topic = ev.topic AND q.word = ev.word)"""


@query("topics_over_time_evolution", _time_sql("ev").replace("top AS (SELECT slice", _EVOLVED + ",\ntop AS (SELECT slice", 1))
def topics_over_time_evolution(spark: SparkSession, d: str) -> DataFrame:
    return _over_time(spark, d, evolution_tuning=True)


_BINS = """b AS (SELECT doc_id, CASE WHEN k = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + k * (hi - lo) / 4 END AS edge FROM
  (SELECT doc_id, lo, hi, greatest(ceil((t - lo) / ((hi - lo) / 4)) - 1, 0) AS k FROM (SELECT doc_id, (doc_id % 10)::DOUBLE AS t, min(doc_id % 10) OVER ()::DOUBLE AS lo, max(doc_id % 10) OVER ()::DOUBLE AS hi FROM documents)))"""


@query("topics_over_time_binned", f"WITH {_BINS} SELECT CAST({NUMBER} AS INTEGER) AS topic, round(edge, 9) AS timestamp, count(*) AS frequency FROM documents JOIN b USING (doc_id) GROUP BY ALL")
def topics_over_time_binned(spark: SparkSession, d: str) -> DataFrame:
    docs = dynamic.equal_bins(_docs(spark, d, "number"), "slot", 4)
    sliced = dynamic.slice_counts(docs, "bin")
    counts = ctfidf.summed(sliced, docs)
    found = dynamic.topics_over_time(docs, ctfidf.weights(counts), ctfidf.idf(counts), "bin", global_tuning=False, sliced=sliced)
    return found.select("topic", "timestamp", "frequency")


@query("topics_per_class", _time_sql("mix", "lang", "class"))
def topics_per_class(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "number")
    sliced = dynamic.slice_counts(docs, "lang")
    counts = ctfidf.summed(sliced, docs)
    return dynamic.topics_per_class(docs, ctfidf.weights(counts), ctfidf.idf(counts), "lang", sliced=sliced)


@query("topics_per_class_local", _time_sql("raw", "lang", "class"))
def topics_per_class_local(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "number")
    sliced = dynamic.slice_counts(docs, "lang")
    counts = ctfidf.summed(sliced, docs)
    return dynamic.topics_per_class(docs, ctfidf.weights(counts), ctfidf.idf(counts), "lang", global_tuning=False, sliced=sliced)


# windows of tokens


@query("token_windows", f"WITH {_cte('number')} SELECT doc_id, CAST(i - 1 AS INTEGER) AS window, array_to_string(ws[i:i + 3], ' ') AS tokens FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    return distribution.token_windows(_docs(spark, d, "number"))


_WIN = f"""WITH {_cte('lang')},
nw AS (SELECT doc_id, unnest(range(0, greatest(len(ws) - 4, 0) + 1)) AS i FROM d WHERE len(ws) > 0),
wt AS (SELECT nw.doc_id, nw.i, t.word, count(*) * any_value(idf.idf) AS x FROM nw JOIN tok t ON t.doc_id = nw.doc_id AND t.pos >= nw.i AND t.pos < nw.i + 4 JOIN idf ON idf.word = t.word GROUP BY ALL),
wl AS (SELECT doc_id, i, sqrt(sum(x * x)) AS l FROM wt GROUP BY ALL),
tl AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM w GROUP BY 1),
sim AS (SELECT wt.doc_id, wt.i, w.topic, sum(wt.x * w.weight) / (any_value(wl.l) * any_value(tl.l)) AS s FROM wt JOIN w ON w.word = wt.word JOIN wl ON wl.doc_id = wt.doc_id AND wl.i = wt.i JOIN tl ON tl.topic = w.topic GROUP BY ALL HAVING s >= 0.1)"""


def _by_language(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _docs(spark, d, "lang")
    counts = _counts(docs)
    return docs, ctfidf.weights(counts), ctfidf.idf(counts)


@query("approx_distribution", f"{_WIN} SELECT doc_id, topic, round(sum(s) / sum(sum(s)) OVER (PARTITION BY doc_id), 6) AS weight FROM sim GROUP BY doc_id, topic")
def approx_distribution(spark: SparkSession, d: str) -> DataFrame:
    return distribution.approximate_distribution(*_by_language(spark, d)).select("doc_id", "topic", _r("weight", 6))


@query("token_distribution", f"{_WIN} SELECT sim.doc_id, CAST(t.pos AS INTEGER) AS pos, any_value(t.word) AS token, sim.topic, round(sum(s), 6) AS weight FROM sim JOIN tok t ON t.doc_id = sim.doc_id AND t.pos >= sim.i AND t.pos < sim.i + 4 GROUP BY sim.doc_id, t.pos, sim.topic")
def token_distribution(spark: SparkSession, d: str) -> DataFrame:
    return distribution.approximate_distribution(*_by_language(spark, d), by_token=True).select("doc_id", "pos", "token", "topic", _r("weight", 6))


# outliers

_NEW = "SELECT d.doc_id, d.topic, CAST(CASE WHEN d.topic = -1 THEN coalesce(b.topic, -1) ELSE d.topic END AS INTEGER) AS new_topic FROM {d} d LEFT JOIN (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, topic) AS r FROM sc WHERE round(s, 9) > 0 AND round(s, 9) >= {least}) WHERE r = 1) b ON b.doc_id = d.doc_id"


@query("outliers_probabilities", f"WITH dd AS (SELECT doc_id, CAST({NUMBER} AS INTEGER) AS topic FROM documents), {_PROB}, sc AS (SELECT doc_id, topic, probability AS s FROM q) {_NEW.format(d='dd', least=0.2)}")
def outliers_probabilities(spark: SparkSession, d: str) -> DataFrame:
    return outliers.by_probabilities(_docs(spark, d, "number"), _probabilities(spark, d), 0.2)


@query("outliers_ctfidf", f"""WITH {_cte('number')},
x AS (SELECT doc_id, word, count(*) * any_value(idf) AS x FROM tok JOIN idf USING (word) WHERE topic = -1 GROUP BY ALL),
xl AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM x GROUP BY 1), tl AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM w WHERE topic <> -1 GROUP BY 1),
sc AS (SELECT x.doc_id, w.topic, sum(x.x * w.weight) / (any_value(xl.l) * any_value(tl.l)) AS s FROM x JOIN w USING (word) JOIN xl ON xl.doc_id = x.doc_id JOIN tl ON tl.topic = w.topic GROUP BY ALL) {_NEW.format(d='d', least=0.1)}""")
def outliers_ctfidf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "number")
    counts = _counts(docs)
    return outliers.by_ctfidf(docs, ctfidf.weights(counts), ctfidf.idf(counts), 0.1)


_WIN_NUMBER = _WIN.replace(_cte("lang"), _cte("number")).replace("FROM d WHERE len(ws) > 0", "FROM d WHERE len(ws) > 0 AND topic = -1").replace("JOIN w ON w.word = wt.word", "JOIN w ON w.word = wt.word AND w.topic <> -1")


@query("outliers_distributions", f"{_WIN_NUMBER}, sc AS (SELECT doc_id, topic, sum(s) / sum(sum(s)) OVER (PARTITION BY doc_id) AS s FROM sim GROUP BY doc_id, topic) {_NEW.format(d='d', least=0.0)}")
def outliers_distributions(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "number")
    counts = _counts(docs)
    return outliers.by_distributions(docs, ctfidf.weights(counts), ctfidf.idf(counts))


@query("outliers_embeddings", f"""WITH {_V}, dd AS (SELECT doc_id, CAST({NUMBER} AS INTEGER) AS topic FROM documents),
sc AS (SELECT v.doc_id, cen.topic, list_cosine_similarity(v.e, cen.c) AS s FROM v JOIN dd ON dd.doc_id = v.doc_id AND dd.topic = -1, cen) {_NEW.format(d='dd', least=0.1)}""")
def outliers_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return outliers.by_embeddings(_docs(spark, d, "number"), _centroids(spark, d), _vectors(spark, d), 0.1)


# incremental and streaming


@query("online_decay", f"WITH {_cte('source')} SELECT topic, word, round(sum(n * pow(0.9, 9 - slot)), 8) AS n FROM (SELECT topic, slot, word, count(*) AS n FROM tok GROUP BY ALL) GROUP BY ALL")
def online_decay(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("topic", F.col("slot").alias("batch"), F.explode(tx.words(F.col("text"))).alias("word"))
    found = online.closed_form(rows.groupBy("batch", "topic", "word").agg(F.count("*").alias("n")), 9, 0.1)
    return found.select("topic", "word", _r("n"))


@query("stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows that a stream of the events ends with."""
    found = online.settled(online.frequency_windows(_stream(spark, d, "events"), "event_type", "ts"), "windows")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = online.settled(online.session_windows(_stream(spark, d, "events"), "user_id", "ts"), "sessions")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


# trees, clusters, tuners, charts


def _numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, idf and weights with the sources as topics 0, 1, ..."""
    docs = _docs(spark, d).withColumn("topic", F.regexp_extract("topic", r"(\d+)$", 1).cast("int"))
    counts = _counts(docs)
    return counts, ctfidf.idf(counts), written(ctfidf.weights(counts), "weights")


@query("hierarchical_topics")
def hierarchical_topics(spark: SparkSession, d: str) -> DataFrame:
    counts, idf, weighted = _numbered(spark, d)
    return hierarchy.hierarchical_topics(counts, idf, hierarchy.ctfidf_similarity(weighted))


@query("reduce_topics")
def reduce_topics(spark: SparkSession, d: str) -> DataFrame:
    """``from_topic, to_topic``: twenty sources to eight topics."""
    _, _, weighted = _numbered(spark, d)
    numbers = sorted(r[0] for r in weighted.select("topic").distinct().collect())
    mapping = hierarchy.reduce_mapping(hierarchy.ctfidf_similarity(weighted), numbers, 8)
    return spark.createDataFrame(sorted(mapping.items()), "from_topic int, to_topic int")


@query("ctfidf_similarity", f"""WITH {_cte()}, l AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM w GROUP BY 1)
SELECT a.topic AS topic_a, b.topic AS topic_b, round(sum(a.weight * b.weight) / (any_value(x.l) * any_value(y.l)), 8) AS similarity
FROM w a JOIN w b USING (word) JOIN l x ON x.topic = a.topic JOIN l y ON y.topic = b.topic GROUP BY ALL""")
def ctfidf_similarity(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ctfidf_similarity(written(ctfidf.weights(_counts(_docs(spark, d))), "weights")).select("topic_a", "topic_b", _r("similarity"))


@query("kmeans_topics")
def kmeans_topics(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster(_vectors(spark, d), 10)


@query("pca_vectors")
def pca_vectors(spark: SparkSession, d: str) -> DataFrame:
    return cluster.reduce_dimensions(_vectors(spark, d), 5)


@query("supervised_topics")
def supervised_topics(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return cluster.classify(rows.select("doc_id", "embedding"), rows.select("doc_id", "topic"))


@query("term_embeddings")
def term_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embed.TermEmbedder(16, 256).embed(_docs(spark, d))


@query("mmr_words")
def mmr_words(spark: SparkSession, d: str) -> DataFrame:
    """Ten of each source's thirty best words, by vectors of the sources they are in."""
    _, _, weighted = _numbered(spark, d)
    ranked = ctfidf.top_words(weighted.withColumn("weight", F.round("weight", 12)), 30)
    used = weighted.join(ranked.select("word").distinct(), "word", "left_semi")
    numbers = sorted(r[0] for r in weighted.select("topic").distinct().collect())
    vectors = used.groupBy("word").pivot("topic", numbers).agg(F.sum("weight")).fillna(0.0)
    vectors = vectors.select("word", F.array(*[F.col(str(i)) for i in numbers]).alias("embedding"))
    return tuners.maximal_marginal_relevance(ranked, vectors, diversity=0.3)


@query("term_rank", f"WITH {_cte('number')}{W12}, top AS ({_top('w12')}) SELECT topic, rank, round(log10(score), 6) AS score FROM top WHERE topic <> -1 AND score > 0")
def term_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(ctfidf.weights(_counts(_docs(spark, d, "number"))))
    return charts.term_rank(ranked, True).select("topic", "rank", _r("score", 6))


@query("barchart", f"WITH {_cte('number')}{W12}, {_SIZES}, top AS ({_top('w12')}) SELECT topic, rank, word, score FROM top WHERE rank <= 5 AND topic IN (SELECT topic FROM sizes WHERE topic <> -1 ORDER BY count DESC, topic LIMIT 3)")
def barchart(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d, "number")
    return charts.barchart(_ranked(ctfidf.weights(_counts(docs))), topics.sizes(docs), 3)


@query("heatmap", f"WITH {_V} SELECT a.topic AS topic_a, b.topic AS topic_b, 'topic ' || a.topic AS label_a, 'topic ' || b.topic AS label_b, round(list_cosine_similarity(a.c, b.c), 8) AS similarity FROM cen a, cen b")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    vectors = _centroids(spark, d)
    labels = vectors.select("topic", F.concat(F.lit("topic "), F.col("topic")).alias("label"))
    return charts.heatmap(vectors, labels).select("topic_a", "topic_b", "label_a", "label_b", _r("similarity"))


@query("distribution_chart", f"{_WIN}, z AS (SELECT doc_id, topic, sum(s) / sum(sum(s)) OVER (PARTITION BY doc_id) AS weight FROM sim GROUP BY doc_id, topic) SELECT doc_id, topic, 'language ' || topic AS label, round(weight, 6) AS weight FROM z WHERE weight >= 0.015")
def distribution_chart(spark: SparkSession, d: str) -> DataFrame:
    docs, weighted, idf = _by_language(spark, d)
    labels = docs.select("topic").distinct().select("topic", F.concat(F.lit("language "), F.col("topic")).alias("label"))
    return charts.distribution(distribution.approximate_distribution(docs, weighted, idf), labels).select("doc_id", "topic", "label", _r("weight", 6))


@query("frequency_chart", f"WITH f AS (SELECT CAST({NUMBER} AS INTEGER) AS topic, doc_id % 10 AS timestamp, count(*) AS n FROM documents GROUP BY ALL) SELECT topic, round(n / sqrt(sum(n * n) OVER (PARTITION BY topic)), 8) AS frequency, timestamp FROM f WHERE topic <> -1")
def frequency_chart(spark: SparkSession, d: str) -> DataFrame:
    return dynamic.chart(_over_time(spark, d, global_tuning=False), "timestamp", True).select("topic", _r("frequency"), "timestamp")
