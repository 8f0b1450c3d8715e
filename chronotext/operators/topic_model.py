"""Topic models by expectation maximisation over tables: training, topic shares, dating of texts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from chronotext.functions.text import TOPIC_STOPWORDS, is_number, word_tokens
from chronotext.operators import blocks
from chronotext.operators.nearest import nearest_document
from chronotext.operators.words import frequency_rank, not_stopword
from chronotext.session import materialize

# Topics of the model and the sum of its document prior.
TOPICS = 50
ALPHA_SUM = 1.0
LISTED_WORDS = 19
# What each word has in each topic before any count.
BETA = 0.01
# The row that names a saved version. A version of before priors were learned has none.
VERSION = "version long, folder string, alpha_sum double, prior array<double>"
# Start values repeat after this many words; the step spreads neighbours.
START_PERIOD = 10007
START_STEP = 7919
# A document whose topic shares all move by no more in a pass is left as it is then.
TOLERANCE = 1e-4
# Decimals to which topic shares are compared, so that equal documents tie whatever the order of sums.
THETA_DECIMALS = 6


def document_words(docs: DataFrame, doc_id: str = "doc_id", with_words: bool = True) -> blocks.WordBlocks:
    """The topic tokens of the documents, counted by document in blocks."""
    counted = blocks.word_blocks(docs, word_tokens("text"), doc_id, with_words=with_words)
    # Filtered once for each word of a block.
    counted.words = counted.words.where(not_stopword(TOPIC_STOPWORDS) & ~is_number("token"))
    return counted


def start_mass(k: int) -> Column:
    """Start values of a word's topics from its rank and count, the same on every cluster."""
    place = F.col("idx") % START_PERIOD + 1
    return F.array(
        *[F.col("total") * (0.1 + place * (2 * i + 1) * START_STEP % START_PERIOD / START_PERIOD) for i in range(k)]
    )


class TopicModel:
    """All words of the training texts as a table (idx, token, total, mass).

    ``mass`` is the expected number of occurrences in each topic. Only its sums per topic, one
    number each, are ever on the driver. ``prior`` is what each topic has in a document before any
    count; the parts add up to ``alpha_sum`` and are equal until they are learned.
    """

    def __init__(self, words: DataFrame, alpha_sum: float = ALPHA_SUM, prior: list[float] | None = None):
        self.words = words
        self.alpha_sum = alpha_sum
        self.k = words.select(F.size("mass")).head(1)[0][0] if words.head(1) else 0
        sums = words.agg(F.count(F.lit(1)), *[F.sum(F.col("mass")[i]) for i in range(self.k)]).first()
        self.vocabulary_size, self.topic_mass = sums[0], [float(s) for s in sums[1:]]
        self.prior = list(prior) if prior else [alpha_sum / max(self.k, 1)] * self.k
        self.counted: blocks.WordBlocks | None = None  # the documents that it was trained on, if it was just now

    def save(self, path: str) -> None:
        """Add a version at ``path``: first its words in a folder of their own, then one row that names it.

        Until that row is there, the version before is the one that is loaded.
        """
        spark = self.words.sparkSession
        last = _versions(spark, path)
        version = (last[0]["version"] if last else 0) + 1
        folder = f"words-{version}-{uuid.uuid4().hex}"
        self.words.write.parquet(_part(path, folder))
        row = spark.createDataFrame([(version, folder, self.alpha_sum, self.prior)], VERSION)
        row.coalesce(1).write.mode("append").parquet(_part(path, "versions"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        """The model of the last version that was saved whole."""
        last = _versions(spark, path)
        if not last:
            raise FileNotFoundError(f"no topic model at {path}")
        return cls(spark.read.parquet(_part(path, last[0]["folder"])), last[0]["alpha_sum"], last[0]["prior"])

    def expected(self, counted: blocks.WordBlocks, thetas: DataFrame | None, doc_id: str) -> DataFrame:
        """(block, doc, doc_id, idx, mass): each count dealt out over the topics, summed up by document and by block and word.

        A count is split by the topic's share of the document times the word's share of the
        topic. Without ``thetas`` (block, doc, doc_id, theta) all topics are alike in a document. Shares of words are looked
        up once for each block of documents. Rows of documents have no ``idx``.
        """
        found = self.looked_up(counted) if counted.found is None else counted.found
        if thetas is not None:
            # An id that is null names no document.
            shares = thetas.where(F.col(doc_id).isNotNull()).select("block", "doc", "theta", F.lit(True).alias("has_theta"))
            found = found.unionByName(shares, allowMissingColumns=True)
        kind = counted.documents.schema[doc_id].dataType.simpleString()
        work = blocks.dealt(doc_id, self.k, counted.with_words)
        return blocks.in_blocks(counted.documents, found, work, f"block long, doc int, `{doc_id}` {kind}, idx long, mass array<double>")

    def looked_up(self, counted: blocks.WordBlocks) -> DataFrame:
        """(block, at, idx, share): each word's share of the topics."""
        whole = [mass + BETA * self.vocabulary_size for mass in self.topic_mass]
        share = F.array(*[(F.col("mass")[i] + BETA) / whole[i] for i in range(self.k)]).alias("share")
        return counted.words.select("block", "at", "token").join(self.words.select("idx", "token", share), "token").drop("token")

    def document_shares(self, expected: DataFrame, doc_id: str) -> DataFrame:
        """(block, doc, doc_id, theta), written to the shared folder."""
        tokens = sum((F.col("mass")[i] for i in range(1, self.k)), F.col("mass")[0])
        shares = [(F.col("mass")[i] + self.prior[i]) / (tokens + self.alpha_sum) for i in range(self.k)]
        return materialize(expected.where("idx IS NULL").select("block", "doc", doc_id, F.array(*shares).alias("theta")))

    def learned_prior(self, shares: DataFrame) -> list[float]:
        """The prior divided as the topics' mean shares of the documents are.

        Repeated in each iteration this comes to rest where the prior is the mean of the shares that it
        leads to. Its sum stays, so short documents are drawn to common topics as strongly as before.
        """
        means = shares.agg(*[F.avg(F.col("theta")[i]) for i in range(self.k)]).first()
        return self.prior if means[0] is None else [self.alpha_sum * mean for mean in means]

    def improved(self, expected: DataFrame, prior: list[float]) -> TopicModel:
        """The model with the word masses that ``expected`` adds up to."""
        sums = expected.where("idx IS NOT NULL").groupBy("idx").agg(*[F.sum(F.col("mass")[i]).alias(f"m{i}") for i in range(self.k)])
        mass = F.array(*[F.col(f"m{i}") for i in range(self.k)]).alias("mass")
        words = self.words.select("idx", "token", "total").join(sums, "idx").select("idx", "token", "total", mass)
        return TopicModel(materialize(words), self.alpha_sum, prior)

    def thetas(
        self, docs: DataFrame, doc_id: str = "doc_id", passes: int = 20, tolerance: float = TOLERANCE, counted: blocks.WordBlocks | None = None
    ) -> DataFrame:
        """The documents without their text but with their topic shares; the words stay as trained.

        Tokens unseen in training are ignored. A document without any known token gets the zero
        vector. After each pass the documents none of whose shares moved by more than ``tolerance``
        keep the new ones; only the others go on, until none or no pass is left. Their counts are
        written anew whenever half of the documents have come to rest, so a pass costs about what
        the documents still moving do. The words' shares do not change, so they are looked up once for all passes.
        ``counted`` are the documents' counts where they are known.
        """
        zero = F.array_repeat(F.lit(0.0), self.k)
        if not self.k:
            return docs.drop("text").withColumn("theta", zero)
        if counted is None:
            counted = document_words(docs, doc_id, with_words=False)
        if passes > 0:
            counted = blocks.WordBlocks(counted.documents, counted.words, False, blocks.packed(self.looked_up(counted)))
        shares, rested, before = None, [], None
        for _ in range(passes):
            new = self.document_shares(self.expected(counted, shares, doc_id), doc_id)
            if shares is None:
                shares, before = new, new.count()
                continue
            steps = F.zip_with("theta", "_last", lambda now, last: F.abs(now - last))
            compared = materialize(
                new.join(shares.select("block", "doc", F.col("theta").alias("_last")), ["block", "doc"]).select(
                    "block", "doc", doc_id, "theta", (F.array_max(steps) > tolerance).alias("_moves")
                )
            )
            rested.append(compared.where("NOT _moves").select("block", "doc", doc_id, "theta"))
            shares = compared.where("_moves").select("block", "doc", doc_id, "theta")
            moving = shares.count()
            if not moving:
                break
            if 2 * moving <= before:
                counted, before = counted.only(shares), moving
        every = reduce(DataFrame.unionByName, rested, shares) if shares is not None else None
        if every is None:
            return docs.drop("text").withColumn("theta", zero)
        return docs.drop("text").join(every.drop("block", "doc"), doc_id, "left").withColumn("theta", F.coalesce("theta", zero))

    def listing(self, words: int = LISTED_WORDS) -> DataFrame:
        """(topic, weight, words): the prior's part for each topic and the topic's top words.

        Equal masses go by token.
        """
        masses = self.words.select("token", F.posexplode("mass").alias("topic", "mass"))
        # So short a limit is applied in the scan tasks, before the topics meet.
        order = Window.partitionBy("topic").orderBy(F.desc(F.round("mass", 6)), "token")
        top = masses.withColumn("place", F.row_number().over(order)).where(F.col("place") <= words)
        weights = F.array(*[F.lit(part) for part in self.prior])
        return top.groupBy("topic").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("place", "token")))["token"], " ").alias("words")
        ).select("topic", F.get(weights, F.col("topic")).alias("weight"), "words")


def _part(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def train(
    docs: DataFrame, doc_id: str = "doc_id", k: int = TOPICS, alpha_sum: float = ALPHA_SUM, iterations: int = 20
) -> TopicModel:
    """Fit a topic model to (doc_id, text): all words of all documents in every iteration.

    The counts are written once, in blocks of documents. An iteration brings the documents' topics and the
    words' topics to each block, and adds up both sides; both are written to the shared folder,
    so a plan never spans iterations. ``doc_id`` is unique.
    """
    counted = document_words(docs, doc_id)
    ranked = frequency_rank(counted.words.groupBy("token").agg(F.sum("n").alias("n")))
    words = ranked.withColumnRenamed("n", "total").withColumn("mass", start_mass(k))
    model, shares = TopicModel(materialize(words), alpha_sum), None
    if not model.k:
        return model
    for last in range(iterations):
        expected = materialize(model.expected(counted, shares, doc_id))
        prior = model.prior
        if last < iterations - 1:
            shares = model.document_shares(expected, doc_id)
            prior = model.learned_prior(shares)
        model = model.improved(expected, prior)
    model.counted = counted
    return model


def load_or_train(docs: DataFrame, path: str, reset: bool = False, **options) -> TopicModel:
    """The model saved at ``path``; trained and saved when there is none or on ``reset``."""
    if not reset and _versions(docs.sparkSession, path):
        return TopicModel.load(docs.sparkSession, path)
    model = train(docs, **options)
    model.save(path)
    return model


def _versions(spark: SparkSession, path: str) -> list[Row]:
    """The last version saved at ``path``; none where nothing is."""
    try:
        rows = spark.read.schema(VERSION).parquet(_part(path, "versions"))
        return rows.orderBy(F.desc("version"), F.desc("folder")).limit(1).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def date_documents(
    model: TopicModel, unseen: DataFrame, training: DataFrame, passes: int = 20, counted: blocks.WordBlocks | None = None
) -> DataFrame:
    """(doc_id, actual_year, train_id, nearest_year, js) for all documents of (doc_id, year, text).

    ``counted`` are the counts of ``training`` where it is what the model was just trained on.

    Documents without a token known to the model cannot be dated: their last three columns are
    NULL. Topic shares are compared to six decimals.
    """
    rounded = F.transform("theta", lambda share: F.round(share, THETA_DECIMALS)).alias("theta")
    known = model.thetas(training, passes=passes, counted=counted).select(F.col("doc_id").alias("id"), "year", rounded)
    asked = materialize(model.thetas(unseen, passes=passes).select(F.col("doc_id").alias("id"), "year", rounded))
    nearest = nearest_document(asked.select("id", "theta"), known).withColumnRenamed("year", "nearest_year")
    return asked.select("id", F.col("year").alias("actual_year")).join(nearest, "id", "left").select(
        F.col("id").alias("doc_id"), "actual_year", "train_id", "nearest_year", "js"
    )
