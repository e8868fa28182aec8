"""Text features, text lookup and text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.scalars import literal_count
from ripplegraph.plans.ordering import position
from ripplegraph.plans.skew import hot_keys, salted_join
from ripplegraph.session import materialise

# Fixed character classes in the sense of Unicode: white space (as characters and as a class) and word characters.
BLANKS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"

# Fixed patterns of the writing-style score.
STYLE_TOKENS = {"exclaims": "!", "questions": "?", "ellipses": "..."}
STYLE_PATTERNS = {
    "caps": "[A-Z]{2,}",
    "urls": f"http[^{SPACE}]+",
    "mentions": f"@[{WORD}]+",
    "hashtags": f"#[{WORD}]+",
}
STYLE_STARTS = {"urls": "http", "mentions": "@", "hashtags": "#"}
CAPITAL = r"\p{IsUppercase}"
MAX_TWEET = 280
PREAMBLE = 50
QUOTED = 200
DIMENSIONS = 384


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _pattern_count(text: Column, pattern: str, start: str | None) -> Column:
    """Matches of a pattern; texts without the pattern's literal start skip the regular expression."""
    found = F.regexp_count(text, F.lit(pattern)).cast("long")
    if start is None:
        return found
    return F.when(F.contains(text, F.lit(start)), found).otherwise(F.lit(0).cast("long"))


def style_counts(name: str) -> dict[str, Column]:
    """The seven style counts of one text. They add up over texts: no pattern spans the joining blank."""
    tokens = {k: literal_count(_text(name), t) for k, t in STYLE_TOKENS.items()}
    patterns = {k: _pattern_count(_text(name), p, STYLE_STARTS.get(k)) for k, p in STYLE_PATTERNS.items()}
    return tokens | patterns


def writing_style(tweets: DataFrame) -> DataFrame:
    """The style counts and their mean per (cascade, user)."""
    counted = tweets.select("news_id", "user_id", *[c.alias(n) for n, c in style_counts("text").items()])
    names = [*STYLE_TOKENS, *STYLE_PATTERNS]
    summed = counted.groupBy("news_id", "user_id").agg(*[F.sum(n).alias(n) for n in names])
    return summed.withColumn("style", sum((F.col(n) for n in names), F.lit(0)) / F.lit(float(len(names))))


def _words(name: str) -> Column:
    """Lower-cased words; runs of white space leave empty strings between them."""
    return F.split(F.translate(F.lower(_text(name)), BLANKS, " " * len(BLANKS)), " ")


def text_diversity(tweets: DataFrame) -> DataFrame:
    """Distinct lower-cased words over all words plus one, per cascade.

    Each text gives its distinct words once, with its number of words beside the first of them; they are grouped by
    (cascade, word) with partial results before the shuffle. No cascade's text is ever put together.
    """
    real = F.filter(_words("text"), lambda w: w != "")
    worded = tweets.where(F.col("news_id").isNotNull()).select("news_id", real.alias("_words"))
    listed = worded.select(
        "news_id", F.size("_words").cast("long").alias("_size"), F.posexplode_outer(F.array_distinct("_words")).alias("_at", "word")
    )
    counted = listed.groupBy("news_id", "word").agg(
        F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_size")).otherwise(0)).alias("_size")
    )
    per_news = counted.groupBy("news_id").agg(F.count("word").alias("unique_words"), F.sum("_size").alias("total_words"))
    return per_news.withColumn("diversity", F.col("unique_words") / (F.col("total_words") + 1))


def excitement(name: str = "text") -> Column:
    """Exclamation and question marks, plus the share of capitals."""
    text = _text(name)
    capitals = F.regexp_count(text, F.lit(CAPITAL)) / (F.length(text) + 1)
    return literal_count(text, "!") + literal_count(text, "?") + capitals


def sentiment_variance(tweets: DataFrame) -> DataFrame:
    """Population variance of the excitement of a cascade's texts."""
    return (
        tweets.where(F.col("news_id").isNotNull())
        .select("news_id", excitement().alias("_e"))
        .groupBy("news_id")
        .agg(F.var_pop("_e").alias("variance"))
    )


def news_text_stats(tweets: DataFrame) -> DataFrame:
    """Eight figures per cascade; means pass over unknown values.

    One scan and one split of the texts: every text gives a row with its user and figures, and a row for each of its distinct words.
    These are grouped by (cascade, user or word) with partial sums before the shuffle, then by cascade. The variance is put
    together from the groups' own variances and means.
    """
    words = F.filter(_words("text"), lambda w: w != "")
    rows = tweets.where(F.col("news_id").isNotNull()).select("news_id", "user_id", "likes", "retweets", words.alias("_words"), excitement().alias("_e"))
    listed = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_words"))
    items = rows.select("*", F.size("_words").cast("long").alias("_size"), F.posexplode(listed).alias("_at", "_word"))
    own = F.col("_at") == 0
    figures = {"_e": "_e", "_likes": "likes", "_retweets": "retweets"}
    grained = items.select(
        "news_id",
        own.alias("_own"),
        F.when(own, F.col("user_id").cast("string")).otherwise(F.col("_word")).alias("_item"),
        F.when(own, F.col("_size")).alias("_size"),
        *[F.when(own, F.col(c).cast("double")).alias(n) for n, c in figures.items()],
    )
    partial = grained.groupBy("news_id", "_own", "_item").agg(
        F.sum("_size").alias("_size"),
        *[F.count(n).alias(f"{n}_n") for n in figures],
        *[F.sum(n).alias(f"{n}_sum") for n in figures],
        (F.var_pop("_e") * F.count("_e") + F.avg("_e") * F.sum("_e")).alias("_e_squares"),
    )
    total = {n: F.coalesce(F.sum(f"{n}_sum"), F.lit(0.0)) for n in figures}
    number = {n: F.sum(f"{n}_n") for n in figures}
    mean = {n: F.when(number[n] > 0, total[n] / number[n]) for n in figures}
    total_words, unique_words = F.sum("_size"), F.count(F.when(~F.col("_own"), F.col("_item")))
    return partial.groupBy("news_id").agg(
        number["_e"].alias("n_tweets"),
        F.count(F.when(F.col("_own"), F.col("_item"))).alias("n_users"),
        total["_likes"].alias("sum_likes"),
        total["_retweets"].alias("sum_retweets"),
        mean["_likes"].alias("mean_likes"),
        mean["_retweets"].alias("mean_retweets"),
        F.greatest(F.sum("_e_squares") / number["_e"] - mean["_e"] * mean["_e"], F.lit(0.0)).alias("variance"),
        (unique_words / (total_words + 1)).alias("diversity"),
    )


def tweet_text_clean(df: DataFrame, name: str = "text") -> DataFrame:
    """Trim, put on one line, drop a preamble up to a colon near the start, cut to tweet length."""
    ends = f"^[{SPACE}]+|[{SPACE}]+$"
    flat = F.replace(F.regexp_replace(F.col(name), ends, ""), F.lit("\n"), F.lit(" "))
    rows = df.withColumn("_flat", flat).withColumn("_colon", F.instr("_flat", ":"))
    body = F.expr("substring(_flat, _colon + 1)")
    cleaned = F.when(F.col("_colon").between(1, PREAMBLE), F.regexp_replace(body, ends, "")).otherwise(F.col("_flat"))
    return rows.withColumn("clean_text", F.substring(cleaned, 1, MAX_TWEET)).drop("_flat", "_colon")


def retweet_text(tweets: DataFrame, edges: DataFrame) -> DataFrame:
    """The text a repost of the source would have, for each (source, target) edge."""
    parents = tweets.select(F.col("tweet_id").alias("source"), "user_id", "text")
    quoted = F.concat(
        F.lit("RT @"), F.col("user_id"), F.lit(": "), F.substring(_text("text"), 1, QUOTED), F.lit("...")
    )
    joined = salted_join(edges.select("source", "target"), parents, ["source"], hot_keys(edges, ["source"]), ["target"])
    return joined.select("source", "target", quoted.alias("text"))


def text_lookup(nodes: DataFrame, tweets: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """A text per node: the tweet's own (null as ''), ``Tweet {id}`` for an unknown id, ``News article {i}`` for news.

    ``i`` is the 0-based rank of the news id among the kept cascades. Columns ``kept`` of the nodes come along.
    """
    kept = kept or []
    news = position(nodes.where(F.col("node_type") == 0).select("news_id", "node_idx", *kept), [], ["news_id"], "_i")
    articles = news.select(
        "news_id", "node_idx", F.lit(None).cast("string").alias("tweet_id"),
        F.concat(F.lit("News article "), F.col("_i")).alias("text"), *kept,
    )
    texts = tweets.select(F.col("tweet_id").cast("string"), _text("text").alias("text"))
    own = nodes.where(F.col("node_type") == 1).select("news_id", "node_idx", "tweet_id", *kept).join(texts, "tweet_id", "left")
    named = own.withColumn("text", F.coalesce("text", F.concat(F.lit("Tweet "), F.col("tweet_id"))))
    return articles.unionByName(named.select(*articles.columns))


# --- text vectors -----------------------------------------------------------------------------


def _term_counts(df: DataFrame, dimensions: int) -> DataFrame:
    worded = df.withColumn("_words", F.filter(_words("text"), lambda w: w != ""))
    return HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf").transform(worded).drop("_words")


def fit_idf(df: DataFrame, dimensions: int = DIMENSIONS) -> IDFModel:
    """Inverse document frequencies of hashed words over all texts."""
    return IDF(inputCol="_tf", outputCol="_tfidf").fit(_term_counts(df, dimensions))


def text_embedding(
    df: DataFrame, model: IDFModel, keys: list[str], per_row: bool = True, dimensions: int = DIMENSIONS
) -> DataFrame:
    """A unit vector per text, or per group of texts (``per_row=False``) as if they were joined.

    Word counts add up, so a group's vector is the sum of its texts' counts: no text is put together.
    """
    counts = _term_counts(df, dimensions)
    if not per_row:
        counts = counts.groupBy(*keys).agg(Summarizer.sum(F.col("_tf")).alias("_tf"))
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(model.transform(counts))
    return unit.select(*keys, vector_to_array("_unit", "float32").alias("embedding"))


def encode_texts(
    df: DataFrame, keys: list[str], encoder: Callable[[list[str]], object], key_schema: str
) -> DataFrame:
    """Vectors from a caller's batch encoder (a list of texts in, a 2-D array out), one Arrow batch at a time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.ascontiguousarray(encoder(batch["text"].to_pylist()), np.float32)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
                vectors = pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], vectors], names=[*keys, "embedding"])

    rows = df.select(*keys, _text("text").alias("text"))
    return rows.mapInArrow(encode, f"{key_schema}, embedding array<float>")


def node_vectors(
    nodes: DataFrame, tweets: DataFrame, names: list[str], dimensions: int = DIMENSIONS, sparse: bool = False
) -> DataFrame:
    """Every node's ``state``: its columns ``names`` followed by the vector of its text.

    Texts are looked up by tweet id; the news node's text names the article. Inverse document frequencies are those of these texts.
    The state is an array or, with ``sparse``, an ML vector without its zeros, for which texts are split once and nodes joined once.
    """
    key = ["news_id", "node_idx"]
    if sparse:
        found = _term_counts(text_lookup(nodes, tweets, names), dimensions)
        counts = materialise(found.select(*key, *[F.col(n).cast("double").alias(n) for n in names], "_tf"), "words")
        weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts).transform(counts)
        unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(weighted)
        both = VectorAssembler(inputCols=[*names, "_unit"], outputCol="state", handleInvalid="keep")
        return both.transform(unit).select(*key, "state")
    texts = materialise(text_lookup(nodes, tweets), "texts")
    vectors = text_embedding(texts, fit_idf(texts, dimensions), key, dimensions=dimensions)
    return feature_concat(nodes, vectors, key, names).select(*key, F.col("features").alias("state"))


def user_vectors(
    nodes: DataFrame, users: DataFrame, tweets: DataFrame, names: list[str], dimensions: int = DIMENSIONS
) -> DataFrame:
    """The ``state`` of every node of the graphs of users: the unit vector of its texts, as if joined, then its columns ``names``.

    Texts are read once. Their word counts are summed per (cascade, user), a missing user id being one user; the news node's counts
    are the sum of its users'. Inverse document frequencies are those of the users' joined texts. A node without words has a
    vector of zeros.
    """
    rows = tweets.where(F.col("news_id").isNotNull()).select(F.col("news_id").alias("_news"), F.col("user_id").alias("_user"), "text")
    summed = Summarizer.sum(F.col("_tf")).alias("_tf")
    counts = _term_counts(rows, dimensions).groupBy("_news", "_user").agg(summed)
    same = (F.col("news_id") == F.col("_news")) & F.col("user_id").eqNullSafe(F.col("_user"))
    own = materialise(users.join(counts, same).select("news_id", F.col("user_idx").alias("node_idx"), "_tf"), "words")
    news = own.groupBy("news_id").agg(summed).select("news_id", F.lit(0).cast("long").alias("node_idx"), "_tf")
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(own).transform(news.unionByName(own))
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(weighted)
    key = ["news_id", "node_idx"]
    figures = F.array(*[F.col(n).cast("double") for n in names])
    joined = nodes.select(*key, *names).join(unit.select(*key, vector_to_array("_unit").alias("_vector")), key)
    return joined.select(*key, F.concat("_vector", figures).alias("state"))


def feature_concat(structural: DataFrame, vectors: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """Structural columns followed by the node's vector, as one array."""
    both = structural.join(vectors, on)
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    return both.withColumn("features", F.concat(F.array(*[F.col(n).cast("double") for n in names]), numbers))
