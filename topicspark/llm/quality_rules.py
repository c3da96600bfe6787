"""Robust multivariate outliers: minimum covariance determinant estimates per language and source.

The estimate of a group of any size comes from concentration steps over all its rows: a step takes the distances of the
rows from the last estimate, counts them on a grid to find the nearest SUPPORT of them, and sums the moments of those. Only
where the steps start from is read off a bounded sample. No task ever holds a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicspark.llm import docstats
from topicspark.llm import textvec as tv
from topicspark.llm.common import fresh, table, wider, write_table

P = len(docstats.NAMES)
#: Share of the rows of a group that the estimate rests on, at least.
SUPPORT = 0.7
#: Rows of a group from which the start of its steps is computed, about; steps at most; what the logarithm of the determinant must fall by.
START_ROWS, STEPS, FALL = 2_000, 30, 1e-4
#: Distances are counted on a grid of this width in their logarithm, so fine that a cell seldom has two rows but equal ones; those in the cell where the nearest end count in part.
GRID, NEAREST = 0.001, 1e-9
#: Estimates of small groups lean on their language, and those of small languages on all, as if by so many rows.
PRIOR_ROWS = 100.0
#: Fewer rows can't tell their own outliers (mcd must rest on more than SUPPORT of them): what they lean on decides alone.
LEAST_ROWS = 20
#: No statistic counts as steadier than this standard deviation, in the order of docstats.NAMES.
FLOOR = np.array([0.06, 0.03, 0.03, 0.02, 0.05, 0.03, 0.08])
#: Squared distance from which a document goes: the chi-squared quantile whose tail is this share.
TAIL = 1e-9
ESTIMATE = "lang string, source string, n double, center array<double>, cov array<double>"
#: Groups up to here are sent to every task, 0.6 KB each; more are joined.
SENT_GROUPS = 50_000
#: Rejected texts up to here are sent to every task, 16 bytes each; with more, the statistics are taken from the texts again.
SENT = 2_000_000
_UP = np.triu_indices(P)
SUMS = [f"m{i}" for i in range(1 + P + len(_UP[0]))]


def chi2_cdf(x: float, k: float) -> float:
    """By the series of the lower incomplete gamma function, or the continued fraction of the upper one."""
    return 1.0 - chi2_tail(x, k)


def chi2_tail(x: float, k: float) -> float:
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1 - total * scale
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_quantile(tail: float, k: float) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, k) > tail else (lo, mid)
    return hi


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    center = x.mean(axis=0)
    return center, (x - center).T @ (x - center) / max(len(x), 1)


def distances(x: np.ndarray, center: np.ndarray, cov: np.ndarray) -> np.ndarray:
    root = np.linalg.cholesky(cov)
    return (np.linalg.solve(root, (x - center).T) ** 2).sum(axis=0)


def n_nearest(n: int, p: int, support: float = SUPPORT) -> int:
    return min(n, max(math.ceil(support * n), (n + p + 1) // 2))


def scaled(raw: np.ndarray, n: int, support: float = SUPPORT) -> np.ndarray:
    """The covariance of the nearest of n rows scaled for normal data, with the floor added."""
    p = len(raw)
    share = n_nearest(n, p, support) / max(n, 1)
    factor = 1.0 if share >= 1 or n < 2 else share / chi2_cdf(chi2_quantile(1 - share, p), p + 2)
    return raw * factor + np.diag(FLOOR[:p] ** 2)


def concentrated(x: np.ndarray, support: float = SUPPORT, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Center and unscaled covariance of the rows with the least covariance determinant, by concentration steps.

    Three deterministic starts (median and MAD; spatial signs; correlation of hyperbolic tangents) are each followed
    until the determinant stays. FLOOR squared is added to the diagonal, so ties and repeated rows do no harm.
    """
    n, p = x.shape
    floor = np.diag(FLOOR[:p] ** 2)
    if n < 2:
        return (x.mean(axis=0) if n else np.zeros(p)), np.zeros((p, p))
    h = n_nearest(n, p, support)
    middle = np.median(x, axis=0)
    mad = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), FLOOR[:p])
    z = (x - middle) / mad
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for start in (np.eye(p), unit.T @ unit / n * p + 0.05 * np.eye(p), np.cov(np.tanh(z), rowvar=False).reshape(p, p) + 0.05 * np.eye(p)):
        center, cov, last = middle, start * np.outer(mad, mad) + floor, math.inf
        for _ in range(steps):
            kept = np.argpartition(distances(x, center, cov), h - 1)[:h]
            center, raw = _moments(x[kept])
            cov = raw + floor
            now = np.linalg.slogdet(cov)[1]
            if now >= last - 1e-9:
                break
            last = now
        if best is None or now < best[0]:
            best = (now, center, raw)
    return best[1], best[2]


def mcd(x: np.ndarray, support: float = SUPPORT) -> tuple[np.ndarray, np.ndarray]:
    """Center and scaled covariance, all rows at hand at once."""
    center, raw = concentrated(x, support)
    return center, scaled(raw, len(x), support)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, P)


def _on_groups(rows: DataFrame, current: DataFrame, out: str, step) -> DataFrame:
    """What ``step(groups)`` yields for each task: ``groups`` gives (lang, source, rows, estimate) again and again, for the
    groups of ``current`` (``lang, source, e``: an estimate as one binary value) only."""
    few = current.count() <= SENT_GROUPS
    if few:
        sent = rows.sparkSession.sparkContext.broadcast({(r["lang"], r["source"]): np.frombuffer(r["e"]) for r in current.collect()})
    else:
        rows = rows.join(current, ["lang", "source"])

    def groups(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _flat(batch.column("_x"))
            keys = [batch.column(c).to_pylist() for c in ("lang", "source")]
            for key, own in pd.Series(range(len(x))).groupby(keys).indices.items():
                if not few:
                    yield *key, x[own], np.frombuffer(batch.column("e")[int(own[0])].as_py())
                elif key in sent.value:
                    yield *key, x[own], sent.value[key]

    return rows.mapInArrow(lambda batches: step(groups(batches)), out)


def _cells(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The cell of the grid in which the distance of each row lies."""
    d = distances(x, e[2 : 2 + P], e[2 + P :].reshape(P, P) + np.diag(FLOOR**2))
    return np.floor(np.log(d + NEAREST) / GRID).astype(np.int64)


def _count(groups):
    """How many rows of each group are in each cell."""
    seen: dict[tuple[str, str], dict[int, int]] = {}
    for lang, source, x, e in groups:
        own = seen.setdefault((lang, source), {})
        for cell, n in zip(*(v.tolist() for v in np.unique(_cells(x, e), return_counts=True))):
            own[cell] = own.get(cell, 0) + n
    flat = [(*k, cell, n) for k, own in seen.items() for cell, n in own.items()]
    yield from pa.table(dict(zip(("lang", "source", "cell", "n"), map(list, zip(*flat)) if flat else [[]] * 4)), pa.schema([("lang", pa.string()), ("source", pa.string()), ("cell", pa.int64()), ("n", pa.int64())])).to_batches()


def _sum(groups):
    """Weight, sums and sums of products of the rows of each group; its estimate ends with the cell and the part of it."""
    seen: dict[tuple[str, str], np.ndarray] = {}
    for lang, source, x, e in groups:
        cell = _cells(x, e[:-2])
        w = np.where(cell < e[-2], 1.0, np.where(cell == e[-2], e[-1], 0.0))
        # about the last center, so that nothing cancels
        y = x - e[2 : 2 + P]
        own = np.concatenate(([w.sum()], w @ y, ((y * w[:, None]).T @ y)[_UP]))
        seen[lang, source] = seen.get((lang, source), 0.0) + own
    m = np.array(list(seen.values())).reshape(-1, len(SUMS))
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), *map(pa.array, m.T)], names=["lang", "source", *SUMS])


def _moved(batches):
    """The next estimate of each group, ``on`` while its determinant falls: from the sums, and the estimate before."""
    for batch in batches:
        rows = []
        for e, sums in zip(batch["e"], batch[SUMS].to_numpy()):
            e = np.frombuffer(e)[:-2]
            mean = sums[1 : 1 + P] / sums[0]
            raw = np.zeros((P, P))
            raw[_UP] = sums[1 + P :] / sums[0]
            raw = np.triu(raw) + np.triu(raw, 1).T - np.outer(mean, mean)
            now = np.linalg.slogdet(raw + np.diag(FLOOR**2))[1]
            fell = now < e[1] - FALL
            new = np.concatenate(([e[0], now], e[2 : 2 + P] + mean, raw.ravel())) if now < e[1] else e
            rows.append((new.tobytes(), bool(fell)))
        yield batch[["lang", "source"]].assign(e=[r[0] for r in rows], on=[r[1] for r in rows])


def estimates(stats: DataFrame, start_rows: int = START_ROWS) -> DataFrame:
    """``lang, source, n, center, cov`` for each group of ``stats`` (``lang, source, _id, _x``), all rows taking part.

    An estimate in the making is one binary value: rows, logarithm of the determinant (infinite before the first step),
    center, unscaled covariance.
    """
    keys = ["lang", "source"]
    sizes = write_table(stats.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * start_rows / F.col("n")
    chosen = stats.join(F.broadcast(sizes) if sizes.count() <= SENT_GROUPS else sizes, keys).where(drawn | (F.col("n") <= start_rows))

    def start(key, part):
        center, raw = concentrated(_flat(part.column("_x")))
        e = np.concatenate(([part.column("n")[0].as_py(), math.inf], center, raw.ravel()))
        return pa.table({"lang": [key[0].as_py()], "source": [key[1].as_py()], "e": [e.tobytes()]})

    began = chosen.groupBy(*keys).applyInArrow(start, "lang string, source string, e binary")
    # a group of which the sample has no row starts from the typical text
    plain = np.concatenate(([0.0, math.inf], docstats.typical(), np.diag(FLOOR**2).ravel() * 25)).tobytes()
    now = write_table(sizes.join(began, keys, "left").select(*keys, F.coalesce("e", F.lit(plain)).alias("e"), F.lit(True).alias("on"), "n"), "estimates")
    n = F.col("n")
    nearest = F.least(n, F.greatest(F.ceil(F.round(F.lit(SUPPORT) * n, 6)).cast("bigint"), F.floor((n + P + 1) / 2).cast("bigint")))
    for _ in range(STEPS):
        at_work = now.where("on").select(*keys, "e")
        if not at_work.take(1):
            break
        counts = _on_groups(stats.select(*keys, "_x"), at_work, "lang string, source string, cell bigint, n bigint", _count).groupBy(*keys, "cell").agg(F.sum("n").alias("c"))
        # a group has some ten thousand cells at most
        upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(*keys).orderBy("cell"))).join(now.where("on").select(*keys, nearest.alias("h")), keys)
        ends = upto.where("upto >= h").groupBy(*keys).agg(F.min(F.struct("cell", ((F.col("h") - F.col("upto") + F.col("c")) / F.col("c")).alias("part"))).alias("end"))
        pack = F.pandas_udf(_appended, "binary")
        at_work = write_table(at_work.join(ends, keys).select(*keys, pack("e", "end.cell", "end.part").alias("e")), "ends")
        sums = _on_groups(stats.select(*keys, "_x"), at_work, f"lang string, source string, {', '.join(f'{m} double' for m in SUMS)}", _sum)
        sums = sums.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in SUMS))
        moved = at_work.join(sums, keys).mapInPandas(_moved, "lang string, source string, e binary, on boolean")
        still = now.where("NOT on").select(*keys, "e", "on")
        now = write_table(moved.unionByName(still).join(sizes, keys), "estimates")

    def final(batches):
        for batch in batches:
            e = [np.frombuffer(x) for x in batch["e"]]
            cov = [scaled(x[2 + P :].reshape(P, P), int(n)).ravel().tolist() for x, n in zip(e, batch["n"])]
            yield batch[["lang", "source", "n"]].assign(center=[x[2 : 2 + P].tolist() for x in e], cov=cov)

    return now.mapInPandas(final, "lang string, source string, n bigint, center array<double>, cov array<double>")


def _appended(e: pd.Series, cell: pd.Series, part: pd.Series) -> pd.Series:
    return pd.Series([np.concatenate((np.frombuffer(x), [float(c), p])).tobytes() for x, c, p in zip(e, cell, part)], dtype=object)


def _pooled(part: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    n = part["n"].to_numpy(float)
    w = n / n.sum()
    return n.sum(), w @ np.stack(part["center"]), (w @ np.stack(part["cov"])).reshape(P, P)


def _keys(lang: str, source: str) -> list:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]


def _statistics(column: pa.Array) -> np.ndarray:
    out = [docstats.statistics(data, offsets) for _, _, data, offsets in tv.chunks(column)]
    return np.concatenate(out) if out else np.zeros((0, P))


def statistics_table(docs: DataFrame, carried: list, key: str, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, _id, _x`` (keys of the group, number of the row, statistics) and the columns ``carried``, written to
    the shared folder; nulls of language or source count as the empty string."""
    own = F.coalesce(F.xxhash64(key), F.xxhash64(F.monotonically_increasing_id())) if key in docs.columns else F.xxhash64(F.monotonically_increasing_id())
    rows = docs.select(*_keys(lang, source), own.alias("_id"), *carried, F.col(f"`{text}`").alias("_text"))
    names = [*rows.columns[:-1], "_x"]

    def only(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(_statistics(batch.column(len(names) - 1)))], names=names)

    return write_table(rows.mapInArrow(only, wider(rows.drop("_text"), "_x array<double>")), "stats")


def fit(stats: DataFrame) -> DataFrame:
    """``lang, source, center, cov`` of every language and source of ``stats``."""
    groups = write_table(estimates(stats).select("lang", "source", F.col("n").cast("double").alias("n"), "center", "cov"), "groups")
    # over at most 64 rows a language at the end, however many sources it has
    parts = groups.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(64))).groupBy("lang", "part").applyInPandas(_pool, ESTIMATE)
    langs = parts.groupBy("lang").applyInPandas(_pool, ESTIMATE)
    # over at most 64 rows at the end, however many languages there are
    parts = langs.withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(64))).groupBy("part").applyInPandas(_pool_apart, ESTIMATE)
    everything = parts.groupBy().applyInPandas(_pool_apart, ESTIMATE).select(F.col("center").alias("prior_center"), F.col("cov").alias("prior_cov"))
    langs = langs.crossJoin(F.broadcast(everything)).mapInPandas(_lean, ESTIMATE)
    prior = langs.select("lang", F.col("center").alias("prior_center"), F.col("cov").alias("prior_cov"))
    return write_table(groups.join(prior, "lang").mapInPandas(_lean, ESTIMATE), "fitted")


def _pool(cells: pd.DataFrame) -> pd.DataFrame:
    n, center, cov = _pooled(cells)
    return cells.head(1)[["lang", "source"]].assign(n=[n], center=[center.tolist()], cov=[cov.ravel().tolist()])


def _pool_apart(langs: pd.DataFrame) -> pd.DataFrame:
    """Pools languages, or pools of them; how far their centers lie apart counts as covariance, as one may be like any."""
    n, center, cov = _pooled(langs)
    away = np.stack(langs["center"]) - center
    cov = cov + (away * (langs["n"].to_numpy(float) / n)[:, None]).T @ away
    return pd.DataFrame({"lang": [""], "source": [""], "n": [n], "center": [center.tolist()], "cov": [cov.ravel().tolist()]})


def _lean(batches):
    """Draws the estimate of each group towards that of its language, or of each language towards that of all."""
    for batch in batches:
        w = (batch["n"] / (batch["n"] + PRIOR_ROWS)).where(batch["n"] >= LEAST_ROWS, 0.0).to_numpy()[:, None]
        if len(batch):
            for own in ("center", "cov"):
                batch[own] = list(w * np.stack(batch[own]) + (1 - w) * np.stack(batch[f"prior_{own}"]))
        yield batch[["lang", "source", "n", "center", "cov"]]


def score(rows: DataFrame, fitted: DataFrame, lang: str, source: str, measured, kept: list[str], more: str) -> DataFrame:
    """The columns ``kept`` of ``rows``, and the squared distance of each row from its group: ``measured(batch)`` gives the
    statistics; ``lang`` and ``source`` are the columns of the group's keys. ``more``: the name of the column added."""
    few = fitted.count() <= SENT_GROUPS
    schema = wider(rows.select(*(F.col(f"`{c}`") for c in kept)), f"`{more}` double")
    if few:
        got = {(r["lang"], r["source"]): (np.array(r["center"]), np.array(r["cov"]).reshape(P, P)) for r in fitted.collect()}
        sent = rows.sparkSession.sparkContext.broadcast(got)
    else:
        k_center, k_cov = fresh("center_key", rows.columns), fresh("cov_key", rows.columns)
        mine = fitted.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("center").alias(k_center), F.col("cov").alias(k_cov))
        rows = rows.join(mine, [lang, source]).select(*(F.col(f"`{c}`") for c in rows.columns), k_center, k_cov)

    def measure(batches):
        for batch in batches:
            x = measured(batch)
            d = np.zeros(len(x))
            groups = pd.Series(range(len(x))).groupby([batch.column(lang).to_pylist(), batch.column(source).to_pylist()]).indices if len(x) else {}
            for key, own in groups.items():
                if few:
                    center, cov = sent.value[key]
                else:
                    center, cov = (np.array(batch.column(c)[int(own[0])].as_py()) for c in (k_center, k_cov))
                    cov = cov.reshape(P, P)
                d[own] = distances(x[own], center, cov)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(d)], names=[*kept, more])

    return rows.mapInArrow(measure, schema)


def reject_outliers(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``doc_id, lang, source, outlier_distance, keep`` of every document.

    The statistics of the form of a text (docstats.NAMES), whole however long it is, are compared with the robust estimate
    of its language and source, which leans on the language when there are few rows, and that on all languages. A null or
    empty text has typical statistics and stays. Repeated rows are judged alike and each counts; at equal distances rows
    count alike in the estimate. Null languages or sources form groups of their own. An empty table gives no rows. Other
    columns are ignored.
    """
    carried = [F.col("doc_id"), F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    stats = statistics_table(docs.select("doc_id", "text", "lang", "source"), carried, "doc_id", "text", "lang", "source")
    scored = score(stats, fit(stats), "lang", "source", lambda batch: _flat(batch.column("_x")), ["doc_id", "_lang", "_source"], "d")
    return scored.select(
        "doc_id", F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.round("d", 6).alias("outlier_distance"), (F.col("d") <= chi2_quantile(tail, P)).alias("keep")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_outliers(table(spark, sf_dir, "documents"))


def _marks() -> list:
    """Two hashes that name a text with its language and source, nulls apart from all values."""
    parts = [x for c in ("text", "lang", "source") for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are no outliers, with the columns they came with, whatever their names.

    Decided as by reject_outliers: null, empty and very long texts, repeated rows, ties, null languages and sources and
    empty tables as there.
    """
    cut = chi2_quantile(TAIL, P)
    one, two = _marks()
    stats = statistics_table(docs, [one.alias("_one"), two.alias("_two")], "doc_id", "text", "lang", "source")
    fitted = fit(stats)
    scored = score(stats, fitted, "lang", "source", lambda batch: _flat(batch.column("_x")), ["_one", "_two"], "d")
    gone = write_table(scored.where(F.col("d") > cut).select("_one", "_two").distinct(), "rejected")
    if gone.count() <= SENT:
        return _without(docs, gone)
    lang, source, d = fresh("lang_key", docs.columns), fresh("source_key", docs.columns), fresh("outlier_distance", docs.columns)
    keys = [k.alias(name) for k, name in zip(_keys("lang", "source"), (lang, source))]
    at = docs.columns.index("text")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *keys)
    scored = score(rows, fitted, lang, source, lambda batch: _statistics(batch.column(at)), docs.columns, d)
    return scored.where(F.col(d) <= cut).select(*(F.col(f"`{c}`") for c in docs.columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose marks are not in ``gone``, which is sent to every task."""
    marks = gone.toPandas().sort_values(["_one", "_two"]).to_numpy(np.int64).reshape(-1, 2)
    sent = docs.sparkSession.sparkContext.broadcast(marks)
    names = docs.columns
    n = len(names)
    rows = docs.select(*(F.col(f"`{c}`") for c in names), *(m.alias(fresh(f"mark{i}", docs.columns)) for i, m in enumerate(_marks())))

    def keep(batches):
        marks = sent.value
        for batch in batches:
            one, two = (np.asarray(batch.column(n + i)) for i in (0, 1))
            there = np.zeros(len(one), dtype=bool)
            if len(marks):
                at = np.searchsorted(marks[:, 0], one)
                # of several marks with one first half, each is tried
                while True:
                    live = (at < len(marks)) & ~there
                    live[live] = marks[at[live], 0] == one[live]
                    if not live.any():
                        break
                    there[live] = marks[at[live], 1] == two[live]
                    at = at + 1
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=names).filter(pa.array(~there))

    return rows.mapInArrow(keep, docs.schema)
