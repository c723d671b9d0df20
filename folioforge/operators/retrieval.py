"""Retrieval by TF-IDF, and answers that quote what was retrieved.

The weights are relational: terms are counted per chunk, inverse document
frequencies come from all chunks, rows are scaled to length one. Questions are a
stated set against all chunks; they meet on shared terms only. Terms don't move:
each task counts those of its chunks, only the frequencies are added up, and the
tasks that score read them and the questions' weights from the shared folder
(`scoring`), and hand on the best chunks of each question. Where these tables
are larger than a task should hold, or the vocabulary is limited, the weights
are relational, and a question limited to a document meets only its chunks.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioforge.functions.textops import excerpt, sentences, word_set
from folioforge.operators.scoring import counted, listed, scored
from folioforge.session import scratch, stored

LEAST_SCORE, GROUNDED, TOP = 0.001, 0.15, 4
ASKED_TO_SEND = 500_000  # terms of questions, so many at most are sent to every task
TERMS_TO_HOLD = 16_000_000  # terms that two chunks or more hold, so many at most are read by every task
ASKED_TO_HOLD = 4_000_000  # terms of questions, likewise
FEATURES = 10_000  # most frequent terms that count in the assistant's retrieval
NO_QUESTION = "Please provide a valid question."
NO_ANSWER = "The documents hold no sufficient information on this question."
# A short list of English words that carry no subject; the long list comes from Spark.
SHORT_STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()


# Spark's English stop words, those of letters only.
ENGLISH = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now cannot could ought would""".split()


def stop_words(df: DataFrame) -> list[str]:
    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()]


def told_words(text: Column, stops: list[str]) -> Column:
    """Words of at least two characters without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]{2,})"), F.lit(1)), lambda w: ~w.isin(stops))


def ngrams(text: Column, stops: list[str], longest: int = 3) -> Column:
    """Words of at least two characters without stop words, and their sequences up to the longest."""
    words = told_words(text, stops)

    def sequences(n: int) -> Column:
        size = F.size(words) - (n - 1)
        made = F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(size > 0, made).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *(sequences(n) for n in range(2, longest + 1)))


def term_counts(df: DataFrame, key: str, text: str, stops: list[str], longest: int = 3) -> DataFrame:
    """(key, term, tf) with tf = 1 + ln(count)."""
    t = df.select(key, F.explode(ngrams(F.col(text), stops, longest)).alias("term"))
    return t.groupBy(key, "term").agg((1 + F.ln(F.count("*"))).alias("tf"))


def idf(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1 over all documents."""
    n = documents.agg(F.count("*").alias("n"))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, inverse: DataFrame, key: str) -> DataFrame:
    """(key, term, w), each key's weights of length one; terms without an idf are left out."""
    raw = counts.join(inverse, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("v"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("v") / F.col("norm")).alias("w"))


def vocabulary(counts: DataFrame, features: int) -> DataFrame:
    """The terms that occur most often over all chunks, as many as features; ties by the term."""
    uses = F.round(F.sum(F.exp(F.col("tf") - 1)))  # tf is 1 + ln(uses)
    return counts.groupBy("term").agg(uses.alias("uses")).orderBy(F.desc("uses"), "term").limit(features).select("term")


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    qkey: str,
    qtext: str,
    ckey: str,
    ctext: str,
    k: int = TOP,
    longest: int = 3,
    stops: list[str] | None = None,
    features: int | None = None,
    scope: str | None = None,
) -> DataFrame:
    """(qkey, ckey, score, place): of each question the k chunks of highest cosine, ties by chunk.

    features: only so many of the most frequent terms count. scope: a column of both, as the document that a
    question is limited to; a question in which it is null looks into all chunks. Frequencies come from all chunks either way.
    Rows of one key are one question or chunk, with the least of their scopes.
    """
    stops = stops if stops is not None else stop_words(chunks)
    if features is None:
        found = scored_in_batches(questions, chunks, qkey, qtext, ckey, ctext, k, longest, stops, scope)
        if found is not None:
            return found
    return scored_by_joins(questions, chunks, qkey, qtext, ckey, ctext, k, longest, stops, features, scope)


def _worded(df: DataFrame, key: str, text: str, stops: list[str], scope: str | None) -> DataFrame:
    """(key, words, scope, rows): the words of each key's texts, an empty word between two texts."""
    told = F.array_join(told_words(F.col(text), stops), " ")
    within = F.col(scope) if scope is not None else F.lit(None).cast("string")
    return df.groupBy(F.col(key).alias("key")).agg(F.array_join(F.collect_list(told), "  ").alias("words"), F.min(within).alias("scope"), F.count("*").alias("rows"))


def scored_in_batches(
    questions: DataFrame, chunks: DataFrame, qkey: str, qtext: str, ckey: str, ctext: str, k: int, longest: int, stops: list[str], scope: str | None
) -> DataFrame | None:
    """As retrieve(), with all terms; nothing where there are more of them than a task should hold."""
    spark = chunks.sparkSession
    worded = stored(_worded(chunks, ckey, ctext, stops, scope), "words")
    n = worded.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    counts = worded.select("words").mapInArrow(counted(longest), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counts = stored(counts, "terms")
    # a term that isn't listed is in one chunk
    frequent = counts.filter("df > 1")
    if frequent.count() > TERMS_TO_HOLD:
        return None
    ask = _worded(questions, qkey, qtext, stops, scope).filter("key IS NOT NULL")
    ask = stored(ask, "questions")
    qtype, ctype = ask.schema["key"].dataType, worded.schema["key"].dataType
    fields = T.StructType([T.StructField("key", qtype), T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])
    q = ask.select("key", "words").mapInArrow(listed(longest, to_arrow_type(qtype)), fields).select("key", "term", (1 + F.ln("n")).alias("tf"))
    inverse = counts.select("term", (F.ln((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1).alias("idf"))
    asked = q.join(inverse, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("v"), "idf")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("key")))
    asked = asked.select("key", "term", (F.col("v") / norm * F.col("idf")).alias("qw")).join(ask.select("key", "scope"), "key")
    at = {name: scratch(spark, name) for name in ("frequent", "asked")}
    asked.select(F.col("key").alias("q"), "term", "qw", "scope").write.parquet(at["asked"])
    if spark.read.parquet(at["asked"]).count() > ASKED_TO_HOLD:
        return None
    frequent.orderBy("term").write.parquet(at["frequent"])
    fields = T.StructType([T.StructField("q", qtype), T.StructField("key", ctype), T.StructField("score", T.DoubleType())])
    led = worded.select("key", "words", "scope").mapInArrow(
        scored(longest, k, n, LEAST_SCORE / 2, at["frequent"], at["asked"], to_arrow_type(qtype), to_arrow_type(ctype)), fields
    )
    score = led.select(F.col("q").alias(qkey), F.col("key").alias(ckey), F.bround("score", 4).alias("score")).filter(F.col("score") > LEAST_SCORE)
    return best(score, [qkey], [F.desc("score"), F.asc(ckey)], k)


def scored_by_joins(
    questions: DataFrame, chunks: DataFrame, qkey: str, qtext: str, ckey: str, ctext: str, k: int, longest: int, stops: list[str], features: int | None, scope: str | None
) -> DataFrame:
    """As retrieve(), by joins on terms."""
    q = term_counts(questions, qkey, qtext, stops, longest)
    # the chunk-term table serves counts, lengths and scores; it is written once
    counts = stored(term_counts(chunks, ckey, ctext, stops, longest), "terms")
    if features is not None:
        counts = stored(counts.join(vocabulary(counts, features), "term", "left_semi"), "features")
    inverse = stored(idf(counts, chunks), "idf")
    squares = counts.join(inverse, "term").groupBy(ckey).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    qw = weights(q, inverse, qkey)
    asked = stored(qw.join(inverse, "term").select(qkey, "term", (F.col("w") * F.col("idf")).alias("qw")), "asked")
    few = asked.count() <= ASKED_TO_SEND  # else both sides are shuffled
    send = F.broadcast if few else lambda df: df
    if scope is None:
        met = counts.join(send(asked), "term")
    else:
        # a question limited to a document meets the terms of its chunks only
        wants = asked.join(questions.groupBy(qkey).agg(F.min(scope).alias("_scope")), qkey)
        own = counts.join(chunks.groupBy(ckey).agg(F.min(scope).alias("_scope")), ckey)
        met = own.join(send(wants.filter("_scope IS NOT NULL")), ["_scope", "term"]).select(qkey, ckey, "qw", "tf")
        met = met.unionByName(counts.join(send(wants.filter("_scope IS NULL")), "term").select(qkey, ckey, "qw", "tf"))
    dots = met.groupBy(qkey, ckey).agg(F.sum(F.col("qw") * F.col("tf")).alias("dot"))
    score = dots.join(squares, ckey).select(qkey, ckey, F.bround(F.col("dot") / F.col("norm"), 4).alias("score")).filter(F.col("score") > LEAST_SCORE)
    return best(score, [qkey], [F.desc("score"), F.asc(ckey)], k)


def best(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def top_terms(counts: DataFrame, inverse: DataFrame, labels: DataFrame, key: str, label: str, k: int = 10) -> DataFrame:
    """(label, term, mean_weight, place): terms of greatest mean weight of each class."""
    w = weights(counts, inverse, key).join(labels.select(key, label), key)
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    mean = w.groupBy(label, "term").agg(F.sum("w").alias("s")).join(sizes, label).select(label, "term", F.bround(F.col("s") / F.col("n"), 6).alias("mean_weight"))
    return best(mean, [label], [F.desc("mean_weight"), F.asc("term")], k)


def best_sentences(hits: DataFrame, questions: DataFrame, chunks: DataFrame, qkey: str, qtext: str, ckey: str, ctext: str) -> DataFrame:
    """Of each retrieved chunk the sentence that shares most words with the question; the earliest of equals."""
    j = hits.join(questions.select(qkey, word_set(F.col(qtext)).alias("_qw")), qkey).join(chunks.select(ckey, ctext), ckey)
    s = j.select(qkey, ckey, "score", "place", "_qw", F.posexplode(sentences(F.col(ctext))).alias("position", "sentence"))
    s = s.withColumn("shared", F.size(F.array_intersect("_qw", word_set(F.col("sentence")))))
    pick = s.groupBy(qkey, ckey, "score", "place").agg(F.max_by(F.struct("sentence", "shared"), F.struct("shared", -F.col("position"))).alias("x"))
    return pick.select(qkey, ckey, "score", "place", "x.sentence", "x.shared")


def answers(sentences_: DataFrame, documents: DataFrame, qkey: str, ckey: str, document: str = "document_id") -> DataFrame:
    """Of each question: answer, citations (one for each document, best first), max_similarity, is_grounded.

    documents: (ckey, document). Below the grounding score the fixed sentence is the answer.
    """
    j = sentences_.join(documents.select(ckey, document), ckey)
    cited = best(j, [qkey, document], [F.asc("place")], 1).withColumn(
        "c", F.struct(F.col("place"), F.col(document).alias("document"), F.col(ckey).alias("chunk"), F.bround(F.col("score") * 100, 1).alias("relevance"), excerpt(F.col("sentence")).alias("excerpt"))
    )
    cites = cited.groupBy(qkey).agg(F.array_sort(F.collect_list("c")).alias("citations"))
    spoken = j.groupBy(qkey).agg(F.max("score").alias("max_similarity"), F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s")).withColumn(
        "lines", F.array_distinct(F.transform("s", lambda x: F.trim(x["sentence"])))
    )
    out = spoken.join(cites, qkey)
    many = F.concat(F.lit("- "), F.array_join("lines", "\n- "))
    answer = F.when(F.size("citations") > 1, many).otherwise(F.array_join(F.slice("lines", 1, 3), " "))
    grounded = F.col("max_similarity") >= GROUNDED
    return out.select(qkey, F.when(grounded, answer).otherwise(NO_ANSWER).alias("answer"), F.when(grounded, F.col("citations")).otherwise(F.array().cast(out.schema["citations"].dataType)).alias("citations"), "max_similarity", grounded.alias("is_grounded"))


def every_answer(found: DataFrame, questions: DataFrame, qkey: str, qtext: str) -> DataFrame:
    """The answers of all questions: those of `answers`, the fixed sentence where nothing was retrieved, and the request for a question where it is null or blank.

    Adds success and reason: EMPTY_QUERY, INSUFFICIENT_CONTEXT or null.
    """
    j = questions.select(qkey, qtext).join(found, qkey, "left")
    blank = F.coalesce(F.trim(F.regexp_replace(qtext, r"\s+", " ")), F.lit("")) == ""
    grounded = F.coalesce("is_grounded", F.lit(False)) & ~blank
    none = F.array().cast(found.schema["citations"].dataType)
    return j.select(
        qkey,
        F.when(blank, NO_QUESTION).otherwise(F.coalesce("answer", F.lit(NO_ANSWER))).alias("answer"),
        F.when(grounded, F.col("citations")).otherwise(none).alias("citations"),
        F.when(~blank, F.coalesce("max_similarity", F.lit(0.0))).otherwise(0.0).alias("max_similarity"),
        grounded.alias("is_grounded"),
        (~blank).alias("success"),
        F.when(blank, "EMPTY_QUERY").when(~grounded, "INSUFFICIENT_CONTEXT").alias("reason"),
    )
