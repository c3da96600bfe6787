"""Other representations of topics than their best terms. A tuner takes and gives ``topic, rank, word, score``."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.functions import text as tx
from topicspark.functions import vectors as vx

RANKED = "topic int, rank int, word string, score double"
Tuner = Callable[[DataFrame], DataFrame]


def mmr(doc: np.ndarray, words: np.ndarray, diversity: float, n: int) -> list[int]:
    """Rows of ``words`` chosen one by one: the nearest to ``doc`` first, then those of the best balance between nearness to
    it and distance from what is chosen; the first of equals."""
    near = vx.unit(words) @ vx.unit(doc[None])[0]
    between = vx.unit(words) @ vx.unit(words).T
    chosen = [int(near.argmax())] if len(words) else []
    while len(chosen) < min(n, len(words)):
        score = (1 - diversity) * near - diversity * between[:, chosen].max(axis=1)
        score[chosen] = -np.inf
        chosen.append(int(np.round(score, 12).argmax()))
    return chosen


def maximal_marginal_relevance(ranked: DataFrame, word_vectors: DataFrame, topic_vectors: DataFrame | None = None, diversity: float = 0.1, n: int = 10) -> DataFrame:
    """Keeps ``n`` diverse words of each topic, in their order and with their scores. A topic's vector is given, or the mean
    of its words'. Each topic is a group of some tens of words."""
    rows = ranked.join(word_vectors.select("word", F.col("embedding").alias("v")), "word")
    rows = rows.join(topic_vectors.select("topic", F.col("embedding").alias("t")), "topic", "left") if topic_vectors is not None else rows.withColumn("t", F.lit(None).cast("array<double>"))

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", ignore_index=True)
        x = np.array(group["v"].tolist(), dtype=float)
        doc = np.array(group["t"][0], dtype=float) if group["t"][0] is not None else vx.unit(x).mean(axis=0)
        return group.loc[sorted(mmr(doc, x, diversity, n)), ["topic", "rank", "word", "score"]]

    kept = rows.groupBy("topic").applyInPandas(keep, f"topic {dict(ranked.dtypes)['topic']}, rank int, word string, score double")
    rank = F.row_number().over(W.partitionBy("topic").orderBy("rank"))
    return kept.withColumn("rank", rank).select("topic", "rank", "word", "score")


def keyword_similarity(ranked: DataFrame, word_vectors: DataFrame, document_vectors: DataFrame, representative: DataFrame, n: int = 10) -> DataFrame:
    """Ranks each topic's candidate words by the cosine with the mean vector of its representative documents, by doc_id."""
    means = vx.means(representative.select("doc_id", "topic").join(document_vectors, "doc_id"), "topic", "embedding").select("topic", F.col("embedding").alias("t"))
    rows = ranked.join(word_vectors.select("word", F.col("embedding").alias("v")), "word").join(means, "topic")
    scored = rows.select("topic", "word", F.round(vx.cosine(F.col("v"), F.col("t")), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("topic", "rank", "word", "score")


def part_of_speech(ranked: DataFrame, docs: DataFrame, tagger: Callable[[str], Sequence[tuple[str, str]]], patterns: Sequence[Sequence[str]] = (("ADJ", "NOUN"), ("NOUN",), ("ADJ",)), n: int = 10) -> DataFrame:
    """Keeps the words of each topic that occur in a run of tags in ``patterns`` in its documents (``topic, text``: the
    representative ones). ``tagger`` gives (token, tag) pairs of a text and runs on the executors."""
    wanted = {tuple(p) for p in patterns}

    def runs(batches):
        for batch in batches:
            out = []
            for topic, text in zip(batch["topic"], batch["text"]):
                tags = list(tagger(text or ""))
                out += [(topic, " ".join(t for t, _ in tags[i : i + len(p)]).lower()) for p in wanted for i in range(len(tags) - len(p) + 1) if tuple(x for _, x in tags[i : i + len(p)]) == p]
            yield pd.DataFrame(out, columns=["topic", "word"])

    kind = dict(docs.dtypes)["topic"]
    found = docs.select("topic", "text").mapInPandas(runs, f"topic {kind}, word string").distinct()
    kept = ranked.join(found, ["topic", "word"], "left_semi")
    rank = F.row_number().over(W.partitionBy("topic").orderBy("rank"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select("topic", "rank", "word", "score")


def zero_shot_labels(ranked: DataFrame, classifier: Callable[[str, Sequence[str]], tuple[str, float]], candidates: Sequence[str], least: float = 0.8) -> DataFrame:
    """One row with the label in place of a topic's words, where the classifier is surer than ``least``; else the words."""
    words = ranked.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("w"))
    given = list(candidates)

    def label(batches):
        for batch in batches:
            got = [classifier(w, given) for w in batch["w"]]
            yield pd.DataFrame({"topic": batch["topic"], "label": [a for a, _ in got], "p": [float(b) for _, b in got]})

    kind = dict(ranked.dtypes)["topic"]
    labels = words.mapInPandas(label, f"topic {kind}, label string, p double").where(F.col("p") > least)
    named = labels.select("topic", F.lit(1).alias("rank"), F.col("label").alias("word"), F.lit(1.0).alias("score"))
    return ranked.join(labels, "topic", "left_anti").select("topic", "rank", "word", "score").unionByName(named)


def fill_prompt(prompt: str, words: Sequence[str], documents: Sequence[str]) -> str:
    """[KEYWORDS] and [DOCUMENTS] stand for the words and the documents, one a line."""
    return prompt.replace("[KEYWORDS]", ", ".join(words)).replace("[DOCUMENTS]", "\n".join(f"- {d}" for d in documents))


def with_retries(call: Callable[[str], str], times: int = 5, first: float = 1.0, factor: float = 2.0, errors: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """``call``, tried again after growing pauses; the last error is raised."""

    def again(prompt: str) -> str:
        pause = first
        for left in range(times - 1, -1, -1):
            try:
                return call(prompt)
            except errors:
                if not left:
                    raise
                sleep(pause)
                pause *= factor
        raise AssertionError

    return again


def generated_labels(
    ranked: DataFrame, representative: DataFrame, generate: Callable[[str], str], prompt: str = "Name the topic of [KEYWORDS]. Texts:\n[DOCUMENTS]\nName:",
    n_words: int = 10, doc_length: int | None = None, unit: str = "whitespace", pad: int = 1,
) -> DataFrame:
    """``topic, rank, word, score``: a generated label, filled up to ``pad`` rows with empty words of score 0.

    ``generate`` takes a prompt and gives a label (a local or remote language model, a chain, any callable); it runs on the
    executors once for each topic. ``representative`` has ``topic, rank, text``; texts are cut to ``doc_length`` units.
    """
    words = ranked.where(F.col("rank") <= n_words).groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))
    text = tx.truncate_words(F.col("text"), doc_length, unit) if doc_length else F.col("text")
    texts = representative.select("topic", "rank", text.alias("text")).groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))

    def label(batches):
        for batch in batches:
            out = []
            for topic, own, docs in zip(batch["topic"], batch["words"], batch["texts"]):
                name = generate(fill_prompt(prompt, list(own), [d for d in (docs if docs is not None else [])]))
                out += [(topic, 1, name.strip(), 1.0)] + [(topic, r, "", 0.0) for r in range(2, pad + 1)]
            yield pd.DataFrame(out, columns=["topic", "rank", "word", "score"])

    return words.join(texts, "topic", "left").mapInPandas(label, f"topic {dict(ranked.dtypes)['topic']}, rank int, word string, score double")


def run(ranked: DataFrame, tuner: Tuner | Sequence[Tuner] | Mapping[str, Tuner | Sequence[Tuner]] | None, n: int = 10) -> DataFrame:
    """``topic, aspect, rank, word, score``: no tuner, one, a chain of them, or a mapping of aspects, of which "Main" is the
    main one."""

    def chain(t: Tuner | Sequence[Tuner] | None) -> DataFrame:
        out = ranked
        for one in [] if t is None else t if isinstance(t, Sequence) else [t]:
            out = one(out)
        return out.where(F.col("rank") <= n)

    aspects = dict(tuner) if isinstance(tuner, Mapping) else {"Main": tuner}
    aspects = {"Main": aspects.get("Main")} | aspects
    parts = [chain(t).select("topic", F.lit(a).alias("aspect"), "rank", "word", "score") for a, t in aspects.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
