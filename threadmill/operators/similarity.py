"""Duplicates and clusters of comments, and similarity by words and vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.numbers import rounded
from threadmill.functions.text import cosine, words
from threadmill.operators import neardup, setjoin, vectors
from threadmill.session import forget, written


def exact(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """The first of each text, in lower case and trimmed, with the number of its repeats."""
    key = F.lower(F.trim("text"))
    return df.groupBy(key.alias("key")).agg(F.min(id_col).alias(id_col), (F.count("*") - 1).alias("duplicate_count"))


def jaccard_pairs(df: DataFrame, threshold: float, id_col: str = "seq") -> DataFrame:
    """Pairs of distinct word sets of at least this similarity, all of them, by ``setjoin``. Rows with equal sets count once, under the smallest id."""
    return setjoin.pairs(df.select(F.col(id_col).alias("id"), "text"), threshold)


def word_set_members(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """Every row with words, and ``set_id``: the smallest id of those with the same word set, by which ``jaccard_pairs`` names it. Rows of one set have similarity 1."""
    sets = df.select(id_col, F.array_sort(words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    return sets.join(sets.groupBy("w").agg(F.min(id_col).alias("set_id")), "w").select(id_col, "set_id")


def minhash_pairs(df: DataFrame, threshold: float = 0.7, bands: int = 16, rows: int = 4, id_col: str = "seq") -> DataFrame:
    """Approximate pairs by MinHash in bands of several hashes, verified by exact Jaccard similarity. Rows with equal word sets are each paired with the smallest id of their set, and sets with each other by that id, so that a large group of copies gives as many rows as it has, not their square. With 16 bands of 4, 98.8 % of sets with similarity 0.7 meet in a band, and 0.2 % of those with 0.1."""
    return setjoin.minhash(df.select(F.col(id_col).alias("id"), F.array_sort(words(F.col("text"))).alias("w")).where(F.size("w") > 0), threshold, bands, rows)


def minhash_groups(df: DataFrame, threshold: float = 0.7, bands: int = 25, rows: int = 5, id_col: str = "seq") -> DataFrame:
    """Every row with words, and ``group``: the smallest id of those that its word set is linked with at this similarity or more, directly or through others. MinHash bands find most links - with 25 bands of 5, 99 % of sets with similarity 0.7 meet in a band -, an exact join of the sets of different groups the others. Ids are whole numbers."""
    sets = setjoin.texts(df.select(F.col(id_col).cast("long").alias("id"), "text"))
    found = neardup.linked(sets.marked(bands, rows), lambda ids: sets.of(ids).select("id", F.col("h").alias("s")), threshold)
    return setjoin.whole(found, sets, threshold).withColumnRenamed("id", id_col)


def similar_to(df: DataFrame, probes: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors whose cosine with a probe is at least the threshold, by blocked products. probes: a stated set, as the result may hold every row for each."""
    return vectors.similar(df, probes, threshold, id_col, vec_col).withColumn("similarity", F.round("similarity", 6))


def centroid(rows: Column) -> Column:
    """The mean of an array of vectors."""
    n = F.size(rows)
    zero = F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(rows, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double"))), lambda x: x / n)


def centroids(df: DataFrame, group: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector of each group, component by component, so that a large group is split over tasks."""
    parts = df.select(group, F.posexplode(vec_col).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centroid"))


def representatives(df: DataFrame, group: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Of each group the member closest to the centroid by cosine; ties go to the smaller id."""
    scored = df.join(centroids(df, group, vec_col), group).select(group, id_col, F.round(cosine(F.col(vec_col), F.col("centroid")), 9).alias("s"))
    return scored.groupBy(group).agg(F.max_by(id_col, F.struct("s", -F.col(id_col))).alias(id_col))


def kmeans(df: DataFrame, k: int = 10, features: int = 1000, language: str = "spanish", seed: int = 42) -> DataFrame:
    """Clusters of texts by TF-IDF of words and word pairs; results differ from other libraries' by design."""
    tokens = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2), StopWordsRemover(inputCol="raw", outputCol="w", stopWords=StopWordsRemover.loadDefaultStopWords(language)), NGram(n=2, inputCol="w", outputCol="ww")])
    d = df.where("text is not null")
    d = tokens.fit(d).transform(d).withColumn("terms", F.concat("w", "ww"))
    counter = CountVectorizerModel.from_vocabulary(frequent_terms(d, features), inputCol="terms", outputCol="tf")
    counted = written(counter.transform(d).select("tf"), "counts")
    model = Pipeline(stages=[IDF(inputCol="tf", outputCol="features"), KMeans(k=k, seed=seed, predictionCol="cluster")]).fit(counted)
    forget(counted)
    out = model.transform(counter.transform(d)).drop("raw", "w", "ww", "terms", "tf")
    out.vocabulary = counter.vocabulary
    return out


def frequent_terms(d: DataFrame, features: int) -> list[str]:
    """The most frequent of the words ``w`` and word pairs ``ww`` of all rows, ties in alphabetical order. A pair is no more frequent than its words, so only pairs of two words that may be listed themselves are counted."""
    count = lambda terms: terms.groupBy("term").agg(F.count("*").alias("n"))
    top = lambda terms: terms.orderBy(F.desc("n"), "term").limit(features)
    single = written(count(d.select(F.explode("w").alias("term"))), "words")
    best = top(single).collect()
    held = written(single.where(F.col("n") >= (best[-1].n if len(best) == features else 1)).select("term"), "frequent")
    pairs = d.select(F.explode("ww").alias("term")).withColumns({"x": F.substring_index("term", " ", 1), "y": F.substring_index("term", " ", -1)})
    pairs = pairs.join(held.withColumnRenamed("term", "x"), "x", "left_semi").join(held.withColumnRenamed("term", "y"), "y", "left_semi")
    found = [r.term for r in top(single.unionByName(count(pairs.select("term")))).collect()]
    forget(single, held)
    return found


def silhouette(df: DataFrame, cluster: str = "cluster", noise: int = -1) -> float:
    return ClusteringEvaluator(predictionCol=cluster, distanceMeasure="cosine").evaluate(df.where(F.col(cluster) != noise))


def group_report(df: DataFrame, group: str) -> DataFrame:
    """Per group: rows, percentage and platforms."""
    per = df.groupBy(group, "platform").agg(F.count("*").alias("n"))
    total = df.count()
    platforms = per.groupBy(group).agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("platforms"))
    return platforms.withColumn("percentage", rounded(100.0 * F.col("count") / F.lit(max(total, 1)), 2))


def group_details(df: DataFrame, group: str, top: int = 5, author: str = "author_id") -> DataFrame:
    """Per group: distinct authors, first and last time, and the ``top`` most frequent words of three letters or more, ties in alphabetical order. df: text, published_at and the author."""
    base = df.groupBy(group, author).agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    base = base.groupBy(group).agg(F.count(author).alias("unique_authors"), F.min("a").alias("first_date"), F.max("b").alias("last_date"))
    counted = df.select(group, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).where(F.length("word") >= 3).groupBy(group, "word").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word"))
    words_ = counted.withColumn("k", k).where(F.col("k") <= top).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x.word).alias("keywords"))
    return base.join(words_, group, "left")


def group_peaks(df: DataFrame, group: str, top: int = 3, at: str = "published_at") -> DataFrame:
    """Per group the days with most rows: ``rank``, ``day`` and ``n``; the earlier day first among equals."""
    n = df.groupBy(group, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "day"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def group_samples(df: DataFrame, group: str, order: str, first: int = 3) -> DataFrame:
    """The first rows of each group. Spark drops all others within each partition before it shuffles."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("k", k).where(F.col("k") <= first)


def cluster_terms(clustered: DataFrame, cluster: str = "cluster", top: int = 10) -> DataFrame:
    """The ``top`` terms of each cluster by mean weight: ``rank``, ``term`` and ``weight``; ties in alphabetical order. clustered: what ``kmeans`` returns, whose vocabulary has some thousand terms at most."""
    names = F.broadcast(clustered.sparkSession.createDataFrame([*enumerate(clustered.vocabulary)], "at int, term string"))
    means = clustered.groupBy(cluster).agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m"))
    mean = means.select(cluster, F.posexplode("m").alias("at", "weight")).where("weight > 0").join(names, "at").select(cluster, "term", "weight")
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("weight"), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= top)


condense = vectors.condense
dbscan = vectors.dbscan
