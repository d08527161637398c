"""Query-focused snippets of retrieved chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatloom.operators.normalize import SENT, STATED, segment

#: Words that a query is searched without.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "with", "is", "are", "was", "were", "it", "this", "that", "of", "by",
    "as", "be", "from", "i", "my", "we", "you", "he", "she", "they",
    "me", "him", "her", "us", "do", "did", "have", "had", "not", "so",
    "if", "can", "will", "just", "about", "up", "out", "its",
)
EXACT, PARTIAL, LINE_CAP = 10, 2, 8
PAIR = ("question_id", "text_id")


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else x)


def preprocess(question: Column, normal_form: bool = True) -> Column:
    """Composed characters, one line, single blanks, trimmed; null if nothing is left. ASCII texts skip the Python step."""
    composed = F.when(question.rlike(r"^\p{ASCII}*$"), question).otherwise(_nfc(question)) if normal_form else question
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(composed, r"[\r\n]+", " ")), r"[ \t]+", " "), F.lit(""))


def query_terms(question: Column) -> Column:
    """The words of a query in order, repeats kept, without stop words and single characters."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.char_length(w) > 1))


def content_tokens(message: Column) -> Column:
    """Words of three letters or more of a message's body, as a set without stop words."""
    first_only = F.regexp_replace(message, r"\n", " ")
    sent, stated = SENT.replace("(.*)$", "(.*)$").replace("^(", "(?s)^("), STATED.replace("^(", "(?s)^(")
    one_line = ~message.contains("\n")
    body = F.when(one_line & message.rlike(sent), F.regexp_extract(message, sent, 3)).when(one_line & message.rlike(stated), F.regexp_extract(message, stated, 2)).otherwise(message)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))), stop)


def text_id(text: Column) -> Column:
    """What tells texts and questions apart; a null question is an empty one, a null text has no id."""
    return F.sha2(text, 256)


def question_id(question: Column) -> Column:
    return text_id(F.coalesce(question, F.lit("")))


def _named(pairs: DataFrame, keys: list[str], question: str, text: str, parts: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs by ids, and the distinct questions and texts that those name."""
    if parts is None:
        named = pairs.select(*keys, question_id(F.col(question)).alias("question_id"), text_id(F.col(text)).alias("text_id"))
        return named, pairs.select(F.col(question).alias("question")).distinct(), pairs.select(F.col(text).alias("text")).distinct()
    return pairs.select(*keys, "question_id", "text_id"), parts[0].select(F.col(question).alias("question")).distinct(), parts[1].select(F.col(text).alias("text")).distinct()


def _cut(texts: DataFrame) -> DataFrame:
    """Each of these distinct texts with its messages in order: text, words in lower case, content tokens, lines."""
    one = texts.where(F.col("text").isNotNull()).withColumn("text_id", text_id(F.col("text")))
    m = segment(one, "text_id", "text").withColumn("low", F.lower("message"))
    words = F.regexp_extract_all("low", F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    m = m.select("text_id", "fallback_split", F.struct("message_no", F.col("message").alias("text"), "low", words.alias("words"), content_tokens(F.col("message")).alias("tokens"), F.greatest("n_lines", F.lit(1)).alias("lines")).alias("m"))
    return m.groupBy("text_id").agg(F.array_sort(F.collect_list("m")).alias("messages"), F.first("fallback_split").alias("fallback_split"))


def _scored(named: DataFrame, questions: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each distinct question and text that meet: their ids, ``terms``, and ``scored``, its messages with exact and partial scores.

    A term is first looked for anywhere in a message, which costs no pattern, and only one that is there is counted among its words.
    """
    asked = questions.select(question_id(F.col("question")).alias("question_id"), F.coalesce(query_terms(preprocess(F.col("question"))), F.array().cast("array<string>")).alias("terms")).dropDuplicates(["question_id"])
    met = named.select(*PAIR).where(F.col("text_id").isNotNull()).distinct().join(asked, "question_id").join(_cut(texts), "text_id")
    there = lambda m: F.filter("terms", lambda t: F.contains(m["low"], t))
    counts = lambda m: F.transform(there(m), lambda t: F.size(F.filter(m["words"], lambda w: w == t)))
    kept = lambda m: [m[c].alias(c) for c in ("no", "text", "lines", "tokens")]
    met = met.withColumn("counted", F.transform("messages", lambda m: F.struct(m["message_no"].alias("no"), m["text"].alias("text"), m["lines"].alias("lines"), m["tokens"].alias("tokens"), counts(m).alias("counts"))))
    exact = lambda m: F.aggregate(m["counts"], F.lit(0), lambda s, n: s + n)
    partial = lambda m: F.size(F.filter(m["counts"], lambda n: n == 0))
    met = met.withColumn("counted", F.transform("counted", lambda m: F.struct(*kept(m), exact(m).alias("exact"), partial(m).alias("partial"))))
    score = lambda m: m["exact"] * EXACT + m["partial"] * PARTIAL
    return met.withColumn("scored", F.transform("counted", lambda m: F.struct(*kept(m), m["exact"].alias("exact"), m["partial"].alias("partial"), score(m).alias("score"))))


def scored_messages(pairs: DataFrame, keys: list[str], question: str = "question", text: str = "text", parts: tuple[DataFrame, DataFrame] | None = None, message: bool = True) -> DataFrame:
    """Each message of each chunk with its exact and partial score for the query: one row a message.

    ``pairs`` has one row for each query and chunk. Equal chunks are cut into messages once and scored once for equal questions, whatever the number of
    pairs. ``parts``: the tables of questions and of texts, if ``pairs`` has only ``question_id`` and ``text_id``. The messages themselves are
    left out without ``message``.
    """
    named, questions, texts = _named(pairs, keys, question, text, parts)
    kept = ["no", *(["text"] if message else []), "exact", "partial", "score"]
    per = _scored(named, questions, texts).select(*PAIR, F.transform("scored", lambda m: F.struct(*(m[c].alias(c) for c in kept))).alias("scored"))
    rows = named.join(per, list(PAIR)).select(*keys, F.explode("scored").alias("m"))
    return rows.select(*keys, F.col("m.no").alias("message_no"), *([F.col("m.text").alias("message")] if message else []), "m.exact", "m.partial", "m.score")


def snippets(pairs: DataFrame, keys: list[str], question: str = "question", text: str = "text", parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The snippet of each query and chunk: the best messages, with neighbours that share a word, in at most eight lines.

    Made once for each distinct question and text that meet, ``parts`` as for ``scored_messages``. Messages lie in an array, in order, and what is
    asked of neighbours is asked of the array.
    """
    named, questions, texts = _named(pairs, keys, question, text, parts)
    per = _scored(named, questions, texts)

    def shares(m: Column, other: Column) -> Column:
        return F.coalesce((other["score"] > 0) & F.arrays_overlap(m["tokens"], other["tokens"]), F.lit(False))

    taken = F.filter("scored", lambda m, i: (m["score"] > 0) | shares(m, F.get("scored", i - 1)) | shares(m, F.get("scored", i + 1)))
    one = lambda m: F.struct((-m["score"]).alias("rank"), *(m[c].alias(c) for c in ("no", "text", "lines", "exact", "partial", "score")))
    per = per.withColumn("candidates", F.array_sort(F.transform(taken, one)))
    kind = "array<struct<rank:int,no:bigint,text:string,lines:int,exact:int,partial:int,score:int>>"
    start = F.struct(F.lit(0).alias("used"), F.expr(f"CAST(array() AS {kind})").alias("own"))

    def add(acc: Column, x: Column) -> Column:
        first_long = (acc["used"] == 0) & (x["lines"] > LINE_CAP)
        fits = (acc["used"] + x["lines"] <= LINE_CAP) | first_long
        return F.struct(F.when(fits, acc["used"] + x["lines"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["own"], F.array(x))).otherwise(acc["own"]).alias("own"))

    per = per.withColumn("candidates", F.col("candidates").cast(kind)).withColumn("picked", F.aggregate("candidates", start, add)["own"])
    per = per.withColumn("picked", F.array_sort(F.transform("picked", lambda x: F.struct(x["no"].alias("no"), x["text"].alias("text"), x["exact"].alias("exact"), x["partial"].alias("partial"), x["score"].alias("score")))))
    per = per.withColumn("matched_terms", F.array_distinct(F.filter("terms", lambda t: F.exists("messages", lambda m: F.contains(m["low"], t)))))
    lines = F.slice(F.flatten(F.transform("picked", lambda x: F.split(x["text"], "\n"))), 1, LINE_CAP)
    found = F.size("picked") > 0
    total = lambda field, only=None: F.aggregate(F.filter("picked", lambda x: x["score"] > 0) if only else F.col("picked"), F.lit(0), lambda s, x: s + x[field])
    count = total("exact")
    times = lambda n: F.concat(F.lit("("), n.cast("string"), F.lit(" occurrence"), F.when(n != 1, "s").otherwise(""), F.lit(")"))
    quoted = lambda t: F.concat(F.lit("'"), t, F.lit("'"))
    reason = F.concat_ws(
        "; ",
        F.when((F.size("matched_terms") > 0) & (count > 0), F.concat(F.lit("Matched keyword: "), quoted(F.get("matched_terms", F.lit(0))), F.lit(" "), times(count))),
        F.when(F.size("matched_terms") > 1, F.concat(F.lit("also matched: "), F.array_join(F.transform(F.slice("matched_terms", F.lit(2), F.size("matched_terms")), quoted), ", "))),
        F.when((total("partial", True) > 0) & (total("exact", True) == 0), F.concat(F.lit("Substring match "), times(total("partial", True)))),
    )
    out = per.select(
        *PAIR, F.when(found, F.array_join(lines, "\n")).alias("focused_snippet"), F.when(found, F.array_join("matched_terms", ",")).alias("matched_terms"), F.when(found, F.nullif(reason, F.lit(""))).alias("relevance_reason"),
        F.when(found, F.array_join(F.transform(F.filter("picked", lambda x: x["score"] > 0), lambda x: x["no"].cast("string")), ",")).alias("matched_messages"), (~found).alias("no_strong_passage"), "fallback_split",
    )
    return named.join(out, list(PAIR), "left").drop(*PAIR).fillna({"no_strong_passage": True, "fallback_split": False})
