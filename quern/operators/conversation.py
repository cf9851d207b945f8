"""Conversation windows: budgets, eviction, tie repair, neighbours, entities, terms. Messages have (conv, pos, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import EDGE, ENTITY_PATTERNS, STOPWORDS, TERM, token_estimate, trim_to_tokens


def _newest(conv: str, pos: str):
    return Window.partitionBy(conv).orderBy(F.desc(pos))


def buffer_window(messages: DataFrame, n: int, conv: str = "conv_id", pos: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation."""
    return messages.withColumn("_r", F.row_number().over(_newest(conv, pos))).filter(F.col("_r") <= n).drop("_r")


def token_buffer(messages: DataFrame, budget: int, conv: str = "conv_id", pos: str = "turn") -> DataFrame:
    """The newest messages whose estimates fit the budget together; the newest always stays. Adds tokens and kept_tokens."""
    newest = _newest(conv, pos)
    sized = messages.withColumn("tokens", token_estimate(F.col("text")))
    sized = sized.withColumn("kept_tokens", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(newest))
    return sized.filter((F.col("kept_tokens") <= budget) | (F.col("_r") == 1)).drop("_r")


def history_window(messages: DataFrame, budget: int, step: int = 10, most: int = 20, share: float = 0.95, floor: int = 2, conv: str = "conv_id", pos: str = "turn") -> DataFrame:
    """What of a history goes into a prompt.

    The start moves in steps of ``step`` once there are more than ``most`` messages; of the rest the newest stay
    while characters / 4 + 4 fit ``share`` of the budget (at least ``floor`` of them); then messages before
    the first user message go.
    """
    whole, oldest, newest = Window.partitionBy(conv), Window.partitionBy(conv).orderBy(pos), _newest(conv, pos)
    placed = messages.withColumn("_n", F.count("*").over(whole)).withColumn("_at", F.row_number().over(oldest))
    anchored = placed.filter(F.col("_at") > F.floor(F.greatest(F.lit(0), F.col("_n") - most) / step) * step)
    cost = F.ceil(F.length("text") / 4) + 4
    fit = anchored.withColumn("_sum", F.sum(cost).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(newest))
    fit = fit.filter((F.col("_sum") <= share * budget) | (F.col("_r") <= floor))
    first_user = F.min(F.when(F.col("role") == "user", F.col(pos))).over(whole)
    return fit.withColumn("_u", first_user).filter(F.col(pos) >= F.col("_u")).select(*messages.columns)


def window_memory(messages: DataFrame, n: int, conv: str = "conv_id", pos: str = "turn") -> DataFrame:
    """By conversation: the last ``n`` messages kept, the others folded into an extract (the first sentence of each)."""
    ranked = messages.withColumn("_r", F.row_number().over(_newest(conv, pos)))
    sentence = F.regexp_extract("text", r"^([^.!?]*[.!?]?)", 1)
    extract = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") > n, F.struct(F.col(pos).alias("p"), sentence.alias("s"))))), lambda x: x["s"]), " ")
    return ranked.groupBy(conv).agg(F.count_if(F.col("_r") <= n).alias("kept"), F.count_if(F.col("_r") > n).alias("folded"), extract.alias("summary"))


def repair_ties(messages: DataFrame, conv: str = "conv_id", at: str = "created_at") -> DataFrame:
    """Where one user and one assistant message share a time, the assistant's moves on by a millisecond."""
    tie = Window.partitionBy(conv, at)
    count = lambda role: F.count_if(F.col("role") == role).over(tie)
    tied = (F.count("*").over(tie) == 2) & (count("user") == 1) & (count("assistant") == 1) & (F.col("role") == "assistant")
    return messages.withColumn("_t", tied).withColumn(at, F.when(F.col("_t"), F.col(at) + F.expr("interval 1 millisecond")).otherwise(F.col(at))).withColumnRenamed("_t", "moved")


def neighbours(chunks: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Each chunk with its parent window: the texts of the one before, itself and the one after."""
    order = Window.partitionBy(doc).orderBy(pos)
    return chunks.withColumn("parent", F.concat_ws("\n\n", F.lag(text).over(order), F.col(text), F.lead(text).over(order)))


def entity_mentions(messages: DataFrame) -> DataFrame:
    """(kind, entity, messages): in how many messages each person, date or number is found."""
    def found(kind: str, pattern: str):
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern.replace(r"\b", EDGE)), F.lit(0))), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("entity")))

    kinds = [found(k, p) for k, p in ENTITY_PATTERNS.items()]
    return messages.select(F.explode(F.concat(*kinds)).alias("e")).groupBy("e.kind", "e.entity").agg(F.count("*").alias("messages"))


def important_terms(messages: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The commonest terms of each group, longer ones first among ties, then by text."""
    terms = messages.select(by, F.explode(F.regexp_extract_all("text", F.lit(TERM.replace(r"\b", EDGE)), F.lit(0))).alias("term")).filter(~F.lower("term").isin(STOPWORDS))
    counted = terms.groupBy(by, "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), F.desc(F.length("term")), "term")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def embedding_text(chunks: DataFrame, title: str, section: str, text: str) -> DataFrame:
    """Adds embed_text: title and section before the text, the section only if the text doesn't open with it."""
    echoed = F.expr(f"locate({section}, substring({text}, 1, 200))")
    head = F.concat_ws(" > ", F.when(F.col(title) != "", F.col(title)), F.when((F.col(section) != "") & (echoed == 0), F.col(section)))
    return chunks.withColumn("embed_text", F.when(head != "", F.concat(head, F.lit("\n\n"), F.col(text))).otherwise(F.col(text)))


def fit_prompt(messages: DataFrame, ceiling: int, low: float = 0.85, floor: int = 4, least_query: int = 512, conv: str = "conv_id", pos: str = "turn") -> DataFrame:
    """What of each conversation fits a prompt of ``ceiling`` tokens; adds tokens and trimmed.

    A conversation that fits stays whole. From another the oldest messages between the leading system messages and the
    last message go until it fits ``low`` of the ceiling or ``floor`` of them are left; then those before the first that
    isn't an assistant's go. Where the rest still doesn't fit, a last message of the user is cut, if ``least_query`` tokens
    or more are left for it. Empty texts count 4 tokens as all do.
    """
    whole, oldest = Window.partitionBy(conv), Window.partitionBy(conv).orderBy(pos)
    sized = messages.withColumn("tokens", token_estimate(F.col("text")) + 4).withColumn("_all", F.sum("tokens").over(whole))
    spoken = F.coalesce(F.col("role") != "system", F.lit(True))
    placed = sized.withColumn("_last", F.col(pos) == F.max(pos).over(whole)).withColumn("_spoke", F.coalesce(F.max(spoken).over(oldest.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    history = placed.withColumn("_h", F.col("_spoke") & ~F.col("_last"))
    counts = F.when(F.col("_h"), 1).otherwise(0)
    counted = history.withColumn("_left", F.sum(counts).over(oldest.rowsBetween(0, Window.unboundedFollowing)))
    before = F.coalesce(F.sum(F.when(F.col("_h"), F.col("tokens"))).over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.col("_all") > ceiling
    gone = over & F.col("_h") & (F.col("_all") - before > int(ceiling * low)) & (F.col("_left") > floor)
    evicted = counted.withColumn("_gone", gone).filter(~F.col("_gone"))
    opening = F.min(F.when(F.col("_h") & ~F.col("role").eqNullSafe("assistant"), F.col(pos))).over(whole)
    opened = evicted.withColumn("_first", opening).filter(~over | ~F.col("_h") | F.coalesce(F.col(pos) >= F.col("_first"), F.lit(False)))
    rest = opened.withColumn("_kept", F.sum("tokens").over(whole)).withColumn("_room", ceiling - (F.col("_kept") - F.col("tokens")) - 8)
    trimmed = (F.col("_kept") > ceiling) & F.col("_last") & F.col("role").eqNullSafe("user") & (F.col("_room") >= least_query)
    cut = rest.withColumn("trimmed", trimmed).withColumn("text", F.when(trimmed, trim_to_tokens(F.col("text"), F.col("_room"))).otherwise(F.col("text")))
    return cut.withColumn("tokens", F.when(F.col("trimmed"), token_estimate(F.col("text")) + 4).otherwise(F.col("tokens"))).select(*messages.columns, "tokens", "trimmed")
