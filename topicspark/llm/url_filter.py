"""URL filters by association rules: FP-growth mines combinations of URL tokens, pruned rules match by an inverted index.

Transactions are the token sets of URLs labelled bad. Frequent combinations of any length are counted over all labelled
URLs, good and bad; those become rules whose confidence is high enough even at the lower end of its interval. Nothing but
the labels says what is bad. A rule is filed under its rarest token, so a URL meets only the rules one of whose tokens it has.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm.common import table, write_table

#: Share of the bad URLs that a combination must be in.
SUPPORT = 0.01
#: Least lower end of the confidence, and the standard deviations it lies below the share.
CONFIDENCE, Z = 0.6, 1.96
#: Rules up to here are broadcast, about 200 bytes each; the number depends on SUPPORT, not on the rows.
SENT_RULES = 200_000


def _words(text: Column, prefix: str, cut: str) -> Column:
    """The distinct words of a text with a prefix, those of digits only left out."""
    return F.transform(F.filter(F.split(text, cut), lambda w: (w != "") & ~w.rlike("^[0-9]+$")), lambda w: F.concat(F.lit(prefix), w))


def host(url: Column) -> Column:
    """The host in lower case, without user, port and ``www.``; what stands before the first slash if there is no scheme."""
    low = F.lower(F.trim(url))
    name = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?([^/?#\s]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.|\.$", "")


def tokens(url: Column) -> Column:
    """Distinct tokens: ``host:`` whole host, ``h:`` its words, ``t:`` its last label, ``p:`` words of the path, ``e:`` the
    file's ending, ``q:`` names and ``v:`` words of the values in the query, ``f:`` words of the fragment."""
    low, name = F.lower(F.trim(url)), host(url)
    rest = F.regexp_replace(low, r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?[^/?#\s]*", "")
    path, query = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"\?([^#]*)", 1)
    ending = F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)
    whole = F.filter(F.array(F.concat(F.lit("host:"), name), F.concat(F.lit("t:"), F.substring_index(name, ".", -1)), F.concat(F.lit("e:"), ending)), lambda w: ~w.rlike("^[a-z]+:$"))
    pairs = F.split(query, "[&;]")
    names = F.transform(F.filter(pairs, lambda w: w != ""), lambda w: F.concat(F.lit("q:"), F.substring_index(w, "=", 1)))
    values = F.flatten(F.transform(F.filter(pairs, lambda w: F.contains(w, F.lit("="))), lambda w: _words(F.regexp_replace(w, "^[^=]*=", ""), "v:", r"[^\p{L}0-9]+")))
    return F.array_distinct(
        F.concat(
            whole, _words(name, "h:", r"[.\-_]+"), _words(F.regexp_replace(path, r"\.[a-z0-9]{1,5}$", ""), "p:", r"[^\p{L}0-9]+"), names, values,
            _words(F.regexp_extract(rest, r"#(.*)$", 1), "f:", r"[^\p{L}0-9]+"),
        )
    )


def _all_in(few: str, many: str) -> Column:
    return F.size(F.array_intersect(few, many)) == F.size(few)


def _lower_end(bad: Column, n: Column) -> Column:
    """Wilson's interval of a share."""
    p = bad / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``rows`` (with ``toks``) and ``rules`` (``anchor, items``, ...) such that the URL has all the rule's tokens:
    the inverted index joins on the anchor, the rest is compared where it matches."""
    return rows.withColumn("anchor", F.explode("toks")).join(rules, "anchor").where(_all_in("items", "toks"))


def _sent(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.count() <= SENT_RULES else rules


def _one_of_each(batches):
    """All sets with one member of each class of a set of classes, and all the members."""
    for batch in batches:
        out: list[tuple[list[str], list[str]]] = []
        for members in batch["members"]:
            every = sorted(tok for own in members for tok in own)
            for some in itertools.product(*members):
                out.append((sorted(some), every))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=["items", "every"])
                    out = []
        yield pd.DataFrame(out, columns=["items", "every"])


def _counted(rows: DataFrame, sets: DataFrame, items: DataFrame, least: int, confidence: float) -> DataFrame:
    """``anchor, items, n_bad, n_all, strong`` of the sets (``items``), over all rows. The anchor is the rarest token, the first by name of equals."""
    ranked = sets.withColumn("tok", F.explode("items")).join(items.select("tok", "n"), "tok")
    anchored = write_table(ranked.groupBy("items").agg(F.min(F.struct("n", "tok")).getField("tok").alias("anchor")), "url-sets")
    counted = hits(rows, _sent(anchored)).groupBy("anchor", "items").agg(F.sum("bad").alias("n_bad"), F.count("*").alias("n_all"))
    strong = (F.col("n_bad") >= least) & (_lower_end(F.col("n_bad"), F.col("n_all")) >= confidence)
    return write_table(counted.withColumn("strong", strong), "url-counts")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``anchor, items, n_bad, n_all, confidence`` of the rules learnt from ``labelled`` (``url, bad``), written to the
    shared folder. Rules that hold a smaller rule are left out. Tokens that always occur together, in good URLs as in bad
    ones, count as one, the first by name. Null URLs or labels are left out; repeated rows count each; an empty URL has no
    tokens. Without bad URLs there are no rules."""
    rows = write_table(labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("toks"), F.col("bad").cast("int").alias("bad")), "labelled-urls")
    bad = rows.where("bad = 1")
    n_bad = bad.count()
    least = max(1, round(support * n_bad))
    h, is_bad = F.xxhash64("toks").cast("decimal(38,0)"), F.col("bad") == 1
    each = rows.select(h.alias("h"), is_bad.alias("is_bad"), F.explode("toks").alias("tok"))
    covers = each.groupBy("tok").agg(
        F.count("*").alias("n"), F.sum("h").alias("cover"), F.count_if("is_bad").alias("in_bad"), F.sum(F.when(F.col("is_bad"), F.col("h"))).alias("bad_cover")
    ).where(F.col("in_bad") >= least)
    # tokens of the same rows, good and bad, are one item
    items = write_table(covers.groupBy("n", "cover", "in_bad", "bad_cover").agg(F.min("tok").alias("tok")), "url-items")
    # items of the same bad rows are mined as one, which is exact, and told apart again afterwards: good rows may part them
    classes = write_table(items.groupBy("in_bad", "bad_cover").agg(F.min("tok").alias("tok"), F.sort_array(F.collect_list("tok")).alias("members")).select("tok", "members"), "url-classes")
    numbered = bad.select(F.monotonically_increasing_id().alias("row"), "toks")
    known = numbered.select("row", F.explode("toks").alias("tok")).join(classes.select("tok"), "tok").groupBy("row").agg(F.collect_set("tok").alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=max(support * n_bad / max(known.count(), 1), 1e-9), minConfidence=0.0)
    sets = growth.fit(known).freqItemsets if n_bad else known.select("items").limit(0)
    apart = sets.select(F.sort_array("items").alias("set")).withColumn("tok", F.explode("set")).join(classes, "tok").groupBy("set").agg(F.collect_list("members").alias("members"))
    apart = write_table(apart.select("members", F.sort_array(F.flatten("members")).alias("items")), "url-closed")
    # all members together are in the fewest good rows: where even they are no rule, no choice among them is one
    whole = _counted(rows, apart.select("items"), items, least, confidence)
    hopeful = apart.join(whole.where("strong").select("items"), "items")
    front = write_table(hopeful.select("members").mapInPandas(_one_of_each, "items array<string>, every array<string>").distinct(), "url-front")
    found = []
    # a set that is no rule yet is tried with one more member of its classes; there are as many rounds as members at most
    while front.take(1):
        counted = _counted(rows, front.select("items"), items, least, confidence)
        found.append(counted.where("strong").drop("strong"))
        weak = front.join(counted.where("NOT strong").select("items"), "items").where(F.size("items") < F.size("every"))
        longer = weak.select(F.explode(F.array_except("every", "items")).alias("one"), "items", "every").select(F.sort_array(F.concat("items", F.array("one"))).alias("items"), "every")
        front = write_table(longer.distinct(), "url-front")
    strong = found[0] if found else whole.where("strong").drop("strong")
    for more in found[1:]:
        strong = strong.unionByName(more)
    strong = write_table(strong, "url-strong")
    small = _sent(strong.select(F.col("anchor").alias("a2"), F.col("items").alias("i2")))
    wide = strong.join(small, (F.array_contains("items", F.col("a2"))) & (F.size("i2") < F.size("items")) & _all_in("i2", "items"), "left_anti")
    return write_table(wide.withColumn("confidence", F.round(F.col("n_bad") / F.col("n_all"), 6)), "url-rules")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, url, n_rules, confidence, rule, keep`` of every page: how many rules match, the highest confidence among
    them, the rule that has it (the first by name of equals), and whether none matches.

    A null, empty or unparsable URL matches nothing and stays; a URL of any length is read whole. Repeated URLs are judged
    once and alike; each row stays a row. Of rules of equal confidence the first by name is given. An empty table gives no
    rows. Other columns are ignored.
    """
    urls = pages.where("url IS NOT NULL").select("url").distinct().withColumn("toks", tokens(F.col("url")))
    found = hits(urls, _sent(rules)).groupBy("url").agg(
        F.count("*").alias("n_rules"), F.min(F.struct(-F.col("confidence"), F.array_join("items", " ").alias("rule"))).alias("best")
    )
    found = found.select("url", "n_rules", (-F.col("best.col1")).alias("confidence"), F.col("best.rule").alias("rule"))
    joined = pages.select("page_id", "url").join(found, "url", "left")
    return joined.select("page_id", "url", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence", "rule", F.col("n_rules").isNull().alias("keep"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of the pages with a label: a page's URL ends in the number of its document, whose label says whether it
    is of low quality or toxic; of several labels the worst counts. Pages without a number or a label are left out."""
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[/.?#]|$)", 1).try_cast("bigint")
    poor = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(poor).alias("bad"))
    return pages.where("url IS NOT NULL").select("url", number.alias("doc_id")).join(judged, "doc_id").select("url", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, mine(labelled_urls(pages, table(spark, sf_dir, "labels"))))
