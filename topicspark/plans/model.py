"""The topic model: one object over tables of documents, topics and words."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import vectors as vx
from topicspark.operators import assign, charts, cluster, ctfidf, distribution, dynamic, embed, hierarchy, lineage, merge_models, outliers, topics, tuners
from topicspark.sources import readers, store
from topicspark.sources.shared import written

Part = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """What a model is fitted with."""

    top_n_words: int = 10
    ngram_range: tuple[int, int] = (1, 1)
    stop_words: tuple[str, ...] = ()
    min_df: int = 1
    max_features: int | None = None
    bm25: bool = False
    reduce_frequent_words: bool = False
    seed_words: tuple[str, ...] = ()
    seed_multiplier: float = 2.0
    seed_topics: tuple[tuple[str, ...], ...] = ()
    english: bool = True
    method: str = "kmeans"
    n_clusters: int = 10
    min_topic_size: int = 10
    n_components: int | None = 5
    nr_topics: int | str | None = None
    zero_shot_topics: tuple[str, ...] = ()
    zero_shot_min_similarity: float = 0.7
    n_representative: int = 3
    n_samples: int = 500


class TopicModel:
    """Fits topics to documents (``doc_id, text``) and answers questions about them. Tables that are asked for more than once
    are written to ``folder``, or else to the shared folder of the session, so that no answer computes them again.

    Parts can be replaced by functions of DataFrames: ``reducer`` and ``clusterer`` take ``doc_id, embedding`` and give
    ``doc_id, embedding`` and ``doc_id, topic`` (and ``probability``, if it has one); ``vectorizer`` takes the documents with
    their ``topic`` and gives ``topic, word, n``; ``weighting`` takes these counts and gives ``topic, word, n, weight``.
    """

    def __init__(
        self, settings: Settings | None = None, embedder: Any = None, tuner: Any = None, folder: str | None = None,
        reducer: Part | None = None, clusterer: Part | None = None, vectorizer: Part | None = None, weighting: Part | None = None, **options: Any,
    ):
        self.settings = replace(settings or Settings(), **options)
        self.embedder, self.tuner, self.folder = embedder, tuner, folder
        self.reducer, self.clusterer, self.vectorizer, self.weighting = reducer, clusterer, vectorizer, weighting
        self.vectors: DataFrame | None = None
        self.assignments: DataFrame | None = None
        self.tables: dict[str, DataFrame] = {}
        self.steps: list[dict[int, int]] = []
        self.custom: dict[int, str] = {}
        self._writes = 0

    def get_params(self) -> dict[str, Any]:
        return asdict(self.settings)

    def __str__(self) -> str:
        return "TopicModel(" + ", ".join(f"{k}={v!r}" for k, v in self.get_params().items()) + ")"

    # fitting

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written to the model's folder or to the shared one."""
        if not self.folder:
            return written(df, name)
        self._writes += 1
        at = f"{self.folder.rstrip('/')}/{name}-{self._writes}"
        df.write.mode("overwrite").parquet(at)
        return df.sparkSession.read.parquet(at)

    def fit(self, docs: DataFrame, embeddings: DataFrame | None = None, y: DataFrame | None = None) -> TopicModel:
        """``embeddings``: ``doc_id, embedding``; ``y``: ``doc_id, topic``, given topics (with method "given") or the classes a
        classifier learns (with method "classify"). With ``seed_topics`` and vectors, documents near a seed topic move towards
        it before they are clustered."""
        readers.check_documents(docs)
        s = self.settings
        docs = docs.drop("topic")
        if embeddings is None and s.method != "given":
            embeddings = embed.select_embedder(self.embedder).embed(docs)
        if embeddings is not None:
            embeddings = self.vectors = self._kept(embeddings, "embeddings")
        self.tables.pop("centers", None)
        self.assignments = self._kept(self._assign(docs, embeddings, y), "assignments")
        if s.method != "given" and not s.zero_shot_topics and s.nr_topics is None:
            self._rank()
        self._represent(docs, embeddings)
        if s.nr_topics is not None:
            self.reduce_topics(docs, s.nr_topics)
        return self

    def _assign(self, docs: DataFrame, vectors: DataFrame | None, y: DataFrame | None) -> DataFrame:
        s = self.settings
        if s.method == "given":
            if y is None:
                raise ValueError("method given needs y")
            return cluster.given(docs, y)
        fixed = None
        rows = vectors
        if s.zero_shot_topics:
            spark = docs.sparkSession
            names = spark.createDataFrame([(i, t) for i, t in enumerate(s.zero_shot_topics)], "doc_id bigint, text string")
            _, x = vx.matrix(embed.select_embedder(self.embedder).embed(names), "doc_id", "embedding")
            fixed = self._kept(assign.zero_shot(vectors, x, s.zero_shot_min_similarity), "zero-shot")
            rows = vectors.join(fixed.where("topic IS NULL").select("doc_id"), "doc_id", "left_semi")
        if s.seed_topics and rows is not None:
            seeds = docs.sparkSession.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(s.seed_topics)], "doc_id bigint, text string")
            _, x = vx.matrix(embed.select_embedder(self.embedder).embed(seeds), "doc_id", "embedding")
            rows = assign.guided(rows, x).select("doc_id", "embedding")
        if self.reducer is not None:
            rows = self.reducer(rows)
        elif s.n_components:
            rows = cluster.reduce_dimensions(rows, s.n_components, name="embedding")
        if self.clusterer is not None:
            found = self.clusterer(rows)
        elif s.method == "classify":
            if y is None:
                raise ValueError("method classify needs y")
            found = cluster.classify(rows, y)
        elif s.method == "density":
            found = cluster.density(rows, s.min_topic_size)
        else:
            found, centers = cluster.cluster_and_centers(rows, s.n_clusters, s.method)
            # centers of vectors that were moved before, or of a part of them, are no topics of other documents
            if centers and rows is vectors:
                made = vectors.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centers)], "topic int, embedding array<double>")
                self.tables["centers"] = made
            if "probabilities" in found.columns:
                found = found.withColumn("probability", F.array_max("probabilities"))
        own = F.col("probability").cast("double") if "probability" in found.columns else F.lit(None).cast("double")
        found = found.select("doc_id", F.col("topic").cast("int").alias("topic"), own.alias("probability"))
        if fixed is None:
            return found
        certain = fixed.where("topic IS NOT NULL").select("doc_id", F.col("similarity").alias("probability"))
        both = certain.unionByName(found.select("doc_id", "probability"))
        return assign.combine_zero_shot(fixed, found, len(s.zero_shot_topics)).join(both, "doc_id")

    def _with_topics(self, docs: DataFrame) -> DataFrame:
        if self.assignments is None:
            raise ValueError("fit the model first")
        return docs.drop("topic").join(self.assignments.select("doc_id", "topic"), "doc_id")

    def _sizes(self) -> dict[int, int]:
        return {r["topic"]: r["count"] for r in topics.sizes(self.assignments).collect()}

    def _move(self, mapping: Mapping[int, int]) -> dict[int, int]:
        """Applies a mapping and then numbers topics by size; gives both as one."""
        sizes = self._sizes()
        after: dict[int, int] = {}
        for t, n in sizes.items():
            after[mapping.get(t, t)] = after.get(mapping.get(t, t), 0) + n
        order = lineage.rank_mapping(after)
        whole = {t: order[mapping.get(t, t)] for t in sizes}
        self.assignments = self._kept(lineage.apply(self.assignments, whole), "assignments")
        self.steps.append(whole)
        return whole

    def _rank(self) -> None:
        whole = self._move({})
        if "centers" in self.tables:
            # a center without rows is no topic
            self.tables["centers"] = self._kept(lineage.apply(self.tables["centers"].where(F.col("topic").isin(*whole)), whole), "centers")

    def _represent(self, docs: DataFrame, vectors: DataFrame | None = None) -> None:
        s = self.settings
        rows = self._with_topics(docs)
        options = {"english": s.english, "ngram_range": s.ngram_range, "stop_words": s.stop_words, "min_df": s.min_df, "max_features": s.max_features}
        counts = self._kept(self.vectorizer(rows) if self.vectorizer is not None else ctfidf.term_counts(rows, **options), "counts")
        seeds = ctfidf.seed_factors(s.seed_words, s.seed_multiplier, s.seed_topics)
        self.tables["counts"] = counts
        self.tables["idf"] = self._kept(ctfidf.idf(counts, s.bm25, seeds), "idf")
        weighted = self.weighting(counts) if self.weighting is not None else ctfidf.weights(counts, s.bm25, s.reduce_frequent_words, seeds)
        self.tables["weights"] = self._kept(weighted, "weights")
        ranked = ctfidf.top_words(self.tables["weights"].where("weight > 0"), max(s.top_n_words, 30))
        self.tables["topic_words"] = self._kept(tuners.run(ranked, self.tuner, s.top_n_words), "words")
        self.tables["sizes"] = self._kept(topics.sizes(self.assignments), "sizes")
        if vectors is not None:
            self.tables["topic_vectors"] = self._kept(vx.means(self.assignments.join(vectors, "doc_id"), "topic", "embedding"), "vectors")
        found = topics.representative_docs(rows, self.tables["weights"], self.tables["idf"], s.n_representative, s.n_samples, english=s.english)
        self.tables["representative"] = self._kept(found, "representative")

    # reading

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"the model has no {name}; fit it first" + (" with vectors" if name == "topic_vectors" else ""))
        return self.tables[name]

    def _words(self, aspect: str = "Main") -> DataFrame:
        return ctfidf.word_lists(self._table("topic_words").where(F.col("aspect") == aspect))

    def labels(self) -> DataFrame:
        return topics.custom_labels(topics.labels(self._words()), self.custom)

    def generate_topic_labels(self, n: int = 3, prefix: bool = True, word_length: int | None = None, separator: str = "_", aspect: str = "Main") -> DataFrame:
        return topics.labels(self._words(aspect), n, prefix, separator, word_length)

    def set_topic_labels(self, given: Mapping[int, str] | Sequence[str]) -> None:
        if not isinstance(given, Mapping):
            numbers = sorted(self._sizes())
            if len(numbers) != len(given):
                raise ValueError("there must be a label for each topic")
            given = dict(zip(numbers, given))
        self.custom |= dict(given)

    def get_topics(self, aspect: str | None = "Main") -> DataFrame:
        """``topic, aspect, rank, word, score``; all aspects if ``aspect`` is None."""
        rows = self._table("topic_words")
        return rows if aspect is None else rows.where(F.col("aspect") == aspect)

    def get_topic(self, topic: int, aspect: str = "Main") -> DataFrame:
        return self.get_topics(aspect).where(F.col("topic") == topic).orderBy("rank")

    def get_topic_freq(self) -> DataFrame:
        return self._table("sizes").orderBy(F.desc("count"), "topic")

    def get_topic_info(self) -> DataFrame:
        return topics.topic_info(self._table("sizes"), self._words(), self.labels(), self._table("representative"))

    def get_document_info(self, docs: DataFrame) -> DataFrame:
        """With the probability of the document's topic where the clusters have one, else null."""
        info, rows = self.get_topic_info(), self._with_topics(docs)
        if "probability" in self.assignments.columns:
            rows = rows.drop("probability").join(self.assignments.select("doc_id", "probability"), "doc_id")
        return topics.document_info(rows, info, self._table("representative"))

    def get_representative_docs(self, topic: int | None = None) -> DataFrame:
        rows = self._table("representative")
        return rows if topic is None else rows.where(F.col("topic") == topic)

    def has_outliers(self) -> bool:
        return bool(self._table("sizes").where("topic = -1").count())

    # asking

    def transform(self, docs: DataFrame, embeddings: DataFrame | None = None, keep_outlier: bool = True) -> DataFrame:
        """``doc_id, topic, similarity`` of other documents, by the topics' vectors; of a model of k-means on the vectors as
        they are, whose topics haven't been changed since, by the distance to its centers, as it was fitted."""
        vectors = embeddings if embeddings is not None else embed.select_embedder(self.embedder).embed(docs)
        if "centers" in self.tables:
            return assign.nearest_center(vectors, self.tables["centers"], self._table("topic_vectors"))
        return assign.nearest_topic(vectors, self._table("topic_vectors"), keep_outlier=keep_outlier)

    def find_topics(self, query: str | Sequence[float], n: int = 5) -> DataFrame:
        vectors = self._table("topic_vectors").where("topic <> -1")
        if isinstance(query, str):
            one = vectors.sparkSession.createDataFrame([(0, query)], "doc_id bigint, text string")
            query = embed.select_embedder(self.embedder).embed(one).first()["embedding"]
        return assign.find_topics(vectors, list(query), n)

    def topics_over_time(self, docs: DataFrame, time: str, bins: int | None = None, datetime_format: str | None = None, evolution_tuning: bool = False, global_tuning: bool = True) -> DataFrame:
        rows = self._with_topics(docs).withColumn("_time", dynamic.parse_times(docs, time, datetime_format))
        name = "_time"
        if bins:
            rows, name = dynamic.equal_bins(rows.withColumn("_time", F.col("_time").cast("double")), "_time", bins, "_bin"), "_bin"
        return dynamic.topics_over_time(rows, self._table("weights"), self._table("idf"), name, evolution_tuning=evolution_tuning, global_tuning=global_tuning, english=self.settings.english)

    def topics_per_class(self, docs: DataFrame, by: str, global_tuning: bool = True) -> DataFrame:
        return dynamic.topics_per_class(self._with_topics(docs), self._table("weights"), self._table("idf"), by, global_tuning=global_tuning, english=self.settings.english)

    def hierarchical_topics(self, method: str = "ward", use_ctfidf: bool = True) -> DataFrame:
        return hierarchy.hierarchical_topics(self._table("counts"), self._table("idf"), self._similarity(use_ctfidf), method)

    def hierarchical_documents(self, docs: DataFrame, hierarchy_rows: DataFrame, n: int = 10) -> DataFrame:
        """``level, doc_id, topic, ancestor`` of the documents at ``n`` levels of a hierarchy."""
        return hierarchy.document_levels(hierarchy_rows, self._with_topics(docs), n)

    def _similarity(self, use_ctfidf: bool) -> DataFrame:
        if use_ctfidf or "topic_vectors" not in self.tables:
            return hierarchy.ctfidf_similarity(self._table("weights"))
        return assign.topic_similarity(self.tables["topic_vectors"])

    def approximate_distribution(self, docs: DataFrame, use_embedding: bool = False, **options: Any) -> DataFrame:
        """By the topics' words or, with ``use_embedding``, by vectors of the windows' texts and of the topics."""
        if use_embedding:
            return distribution.embedded_distribution(docs, self._table("topic_vectors"), embed.select_embedder(self.embedder), english=self.settings.english, **options)
        return distribution.approximate_distribution(docs, self._table("weights"), self._table("idf"), english=self.settings.english, **options)

    def reduce_outliers(self, docs: DataFrame, strategy: str = "distributions", threshold: float = 0.0, embeddings: DataFrame | None = None, probabilities: DataFrame | None = None) -> DataFrame:
        """``doc_id, topic, new_topic``; the model stays as it is until update_topics()."""
        if not self.has_outliers():
            raise ValueError("there are no outliers")
        rows = self._with_topics(docs)
        if strategy == "probabilities":
            return outliers.by_probabilities(rows, probabilities, threshold)
        if strategy == "embeddings":
            vectors = embeddings if embeddings is not None else embed.select_embedder(self.embedder).embed(docs)
            return outliers.by_embeddings(rows, self._table("topic_vectors"), vectors, threshold)
        by = {"distributions": outliers.by_distributions, "c-tf-idf": outliers.by_ctfidf}.get(strategy)
        if by is None:
            raise ValueError(f"unknown strategy {strategy}")
        return by(rows, self._table("weights"), self._table("idf"), threshold, english=self.settings.english)

    def chart(self, kind: str, **options: Any) -> DataFrame:
        """The rows of a chart: barchart, term_rank, heatmap, topics."""
        sizes, ranked = self._table("sizes"), self.get_topics()
        if kind == "barchart":
            return charts.barchart(ranked, sizes, **options)
        if kind == "term_rank":
            return charts.term_rank(ranked, **options)
        if kind == "heatmap":
            return charts.heatmap(self._table("topic_vectors"), self.labels())
        if kind == "topics":
            return charts.topics_map(self._table("topic_vectors"), sizes, self.labels())
        raise ValueError(f"unknown chart {kind}")

    # changing

    def update_topics(self, docs: DataFrame, new_topics: DataFrame | None = None, embeddings: DataFrame | None = None, **options: Any) -> None:
        """Counts and words again, with other settings or under given topics: ``doc_id, topic``, or what reduce_outliers()
        gives, whose ``new_topic`` counts. Topic vectors follow, from ``embeddings`` or those the model was fitted with;
        without any there are none."""
        self.settings = replace(self.settings, **options)
        if new_topics is not None:
            name = "new_topic" if "new_topic" in new_topics.columns else "topic"
            self.assignments = self._kept(new_topics.select("doc_id", F.col(name).cast("int").alias("topic")), "assignments")
            self.tables.pop("topic_vectors", None)
            self.tables.pop("centers", None)
        self._represent(docs, embeddings if embeddings is not None else self.vectors)

    def _change(self, docs: DataFrame, mapping: Mapping[int, int]) -> None:
        old = self.tables.get("topic_vectors")
        self.tables.pop("centers", None)
        whole = self._move(mapping)
        self.custom = {whole[t]: name for t, name in self.custom.items() if t in whole and mapping.get(t, t) == t}
        self._represent(docs)
        if old is not None:
            pairs = old.sparkSession.createDataFrame(list(whole.items()), "from_topic int, to_topic int")
            self.tables["topic_vectors"] = self._kept(assign.merged_vectors(old, pairs), "vectors")

    def merge_topics(self, docs: DataFrame, groups: Sequence[int] | Sequence[Sequence[int]]) -> None:
        self._change(docs, lineage.merge_mapping(groups))

    def delete_topics(self, docs: DataFrame, gone: Sequence[int]) -> None:
        self._change(docs, lineage.delete_mapping(gone))

    def reduce_topics(self, docs: DataFrame, n: int | str = 20, use_ctfidf: bool = True) -> None:
        numbers = sorted(self._sizes())
        if n == "auto":
            names, x = vx.matrix(self._table("topic_vectors").where("topic <> -1"), "topic", "embedding")
            self._change(docs, hierarchy.auto_reduce_mapping(x, numbers) if names else {})
        else:
            self._change(docs, hierarchy.reduce_mapping(self._similarity(use_ctfidf), numbers, int(n)))

    def lineage(self) -> DataFrame:
        """``step, from_topic, to_topic``."""
        rows = [(k, a, b) for k, step in enumerate(self.steps) for a, b in sorted(step.items())]
        return self.assignments.sparkSession.createDataFrame(rows, lineage.EDGES)

    # keeping

    def save(self, path: str) -> None:
        spark = self.assignments.sparkSession
        meta = {"settings": self.get_params(), "steps": [sorted(s.items()) for s in self.steps], "custom": sorted(self.custom.items())}
        store.save(spark, path, self.tables | {"assignments": self.assignments}, meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Any = None) -> TopicModel:
        tables, meta = store.load(spark, path)
        given = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in meta["settings"].items()}
        model = cls(Settings(**given), embedder)
        model.assignments = tables.pop("assignments")
        model.tables, model.steps, model.custom = tables, [dict(s) for s in meta["steps"]], dict(meta["custom"])
        return model

    @classmethod
    def merge_models(cls, models: Sequence[TopicModel], min_similarity: float = 0.7) -> TopicModel:
        """Words and vectors of all; assignments of all, under the merged numbers."""
        mappings, vectors = merge_models.merge([m._table("topic_vectors") for m in models], min_similarity)
        out = cls(models[0].settings, models[0].embedder)
        known: set[int] = set()
        words, assigned = [], []
        for model, mapping in zip(models, mappings):
            assigned.append(lineage.apply(model.assignments.select("doc_id", "topic"), mapping))
            fresh = {a: b for a, b in mapping.items() if b not in known}
            known |= set(mapping.values())
            words.append(lineage.apply(model.get_topics(None).where(F.col("topic").isin(*fresh)), fresh) if fresh else None)
        every = [w for w in words if w is not None]
        out.assignments, out.tables["topic_words"], out.tables["topic_vectors"] = assigned[0], every[0], vectors
        for a in assigned[1:]:
            out.assignments = out.assignments.unionByName(a)
        for w in every[1:]:
            out.tables["topic_words"] = out.tables["topic_words"].unionByName(w)
        out.tables["sizes"] = topics.sizes(out.assignments)
        return out
