"""Personal data: base rules, and contexts that they teach.

Every base match is a seed. The word before a seed and the word after it are lexical patterns. A graph joins patterns to the
instances beside them: seeds, matches that fail a base rule's check, and other tokens shaped like identifiers. A pattern's confidence
is the mean score of its distinct instances; an unseen instance takes the best confidence of its patterns, and so may support further
patterns in the next round. Patterns whose word stands beside identifiers hardly more often than any word are not trusted. Tokens
beside a pattern of high confidence are reported as spans of kind `context`.

Native: DataFrame functions only. Counts cover all documents.

Defined results: a null text counts as the empty text and has no spans. Texts of any length are searched whole, in time linear in their
length. A text is one instance for each token, however many rows have it. Rows are never merged: repeated rows, and rows with null or
repeated ids, each get a result. What fails a base rule's check, or touches what does, is never a context span. An empty table gives
an empty result. Other columns are kept, whatever their names, but for base and context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.llm.common import let, matches, running_sums, spaced, split_words, table

# The patterns of the contract. `(?<!x)|\G` lets a search start only where a run of x or the search itself
# starts, and runs are possessive: the same matches without trying each place of a long run again.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?|)(?:\.|$)){4}$"
#: A token that may be an identifier: it has a digit or an @. After stripping, five digits or an @ inside.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
IDENTIFIER = r"^[^0-9]*+(?:[0-9][^0-9]*+){5}|[^@]@[^@]"
EDGES = "\"'`()[]{}<>,;:.!?|"
#: Rounds of scores; the least confidence of a trusted pattern; the instances of score 1 that one needs; how many times as often as
#: any word its own word must stand beside an identifier (half of its occurrences always do).
ROUNDS, CONFIDENT, SUPPORT, LIFT = 3, 0.6, 3, 20


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of digits."""

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def holds(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]+", "")
    if kind == "ip":
        return word.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_matches(text: Column) -> Column:
    """Array of (place of the kind, start, kind, end, matched text, good), by kind and start; good: it passes the kind's check."""

    def of(i: int, kind: str) -> Column:
        return F.transform(matches(text, KINDS[kind]), lambda m: F.struct(F.lit(i).alias("at"), m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["word"].alias("word"), holds(kind, m["word"]).alias("good")))

    return F.concat(*(of(i, k) for i, k in enumerate(KINDS)))


def tokens(text: Column) -> Column:
    """Array of (start, end, token, left, right): tokens with a digit or an @, and the words beside them, in lower case ('': none, or a token of that kind)."""

    def places(t: Column) -> Column:
        def each(found: Column) -> Column:
            def with_gaps(gaps: Column) -> Column:
                ends = running_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint")))
                left = lambda i: F.lower(F.substring_index(F.rtrim(spaced(F.get(gaps, i))), " ", -1))
                right = lambda i: F.lower(F.substring_index(F.ltrim(spaced(F.get(gaps, i + 1))), " ", 1))
                return let(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("token"), left(i).alias("left"), right(i).alias("right"))))

            return let(F.split(t, TOKEN), with_gaps)

        return let(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), each)

    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string,left:string,right:string>>")
    return F.when(F.coalesce(text.rlike("[0-9@]"), F.lit(False)), places(text)).otherwise(none)


def annotate(documents: DataFrame) -> DataFrame:
    """(row, blob, base, tokens): the rows' own columns but text as a struct; one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    keep = [c for c in documents.columns if c.lower() not in ("text", "base", "context")]
    return documents.select(F.struct(*keep).alias("row"), F.sha2(text, 256).alias("blob"), base_matches(text).alias("base"), tokens(text).alias("tokens"))


def occurrences(annotated: DataFrame) -> DataFrame:
    """(blob, side, neighbour, word, seed, bad, start, end): base matches and identifier-shaped tokens with the words beside them, once for each blob.

    Tokens and matches of a blob are merged by place: a match takes the left word of the token that it starts in and the right
    word of the one that it ends in; a token that touches a match is no instance of its own. bad: a match that fails its check."""
    once = table(annotated.where((F.size("base") > 0) | (F.size("tokens") > 0)).groupBy("blob").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens")), "personal-blobs")
    null = lambda kind: F.lit(None).cast(kind)
    match = once.select("blob", F.explode("base").alias("b"))
    token = once.select("blob", F.explode("tokens").alias("t"))

    def event(rows: DataFrame, x: str, order: int, pos: Column, is_match: bool) -> DataFrame:
        own = [F.col(f"{x}.word") if is_match else F.col(f"{x}.token"), F.col(f"{x}.good") if is_match else null("boolean")]
        sides = [null("string")] * 2 if is_match else [F.col(f"{x}.left"), F.col(f"{x}.right")]
        return rows.select("blob", pos.alias("pos"), F.lit(order).alias("order"), F.col(f"{x}.start").alias("start"), F.col(f"{x}.end").alias("end"), own[0].alias("word"), own[1].alias("good"), sides[0].alias("left"), sides[1].alias("right"))

    opens, begins, ends, closes = 0, 1, 2, 3
    events = event(token, "t", opens, F.col("t.start"), False).unionByName(event(match, "b", begins, F.col("b.start"), True))
    events = events.unionByName(event(match, "b", ends, F.col("b.end") - 1, True)).unionByName(event(token, "t", closes, F.col("t.end") - 1, False))
    so_far = Window.partitionBy("blob").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.max(F.when(F.col("order") == begins, F.col("end"))).over(so_far)
    beside = lambda side: F.last(F.when(F.col("order") == opens, F.col(side)), ignorenulls=True).over(so_far)
    merged = events.withColumns({"upto": upto, "l": beside("left"), "r": beside("right")})
    word = F.rtrim(F.ltrim("word", F.lit(EDGES)), F.lit(EDGES))
    head = F.length("word") - F.length(F.ltrim("word", F.lit(EDGES)))
    lone = merged.where((F.col("order") == closes) & (F.coalesce("upto", F.lit(0)) <= F.col("start")) & word.rlike(IDENTIFIER))
    seed = F.col("good").cast("int")

    def edges(rows: DataFrame, side: str, neighbour: str, instance: Column, start: Column, seed: Column, bad: Column) -> DataFrame:
        return rows.select("blob", F.lit(side).alias("side"), F.col(neighbour).alias("neighbour"), instance.alias("word"), seed.alias("seed"), bad.alias("bad"), start.alias("start"), (start + F.length(instance)).alias("end"))

    zero = F.lit(0)
    out = edges(merged.where(F.col("order") == begins), "left", "l", F.col("word"), F.col("start"), seed, 1 - seed)
    out = out.unionByName(edges(merged.where(F.col("order") == ends), "right", "r", F.col("word"), F.col("start"), seed, 1 - seed))
    for side in ("left", "right"):
        out = out.unionByName(edges(lone, side, side, word, F.col("start") + head, zero, zero))
    return table(out.where("neighbour != ''"), "personal-graph")


def patterns(found: DataFrame, documents: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, lift: float = LIFT) -> DataFrame:
    """(side, neighbour, confidence): iterative scores over the graph of patterns and instances, from occurrences().

    Seeds have score 1 and what fails a check 0, always; any other instance the best confidence of its patterns in the round before. A
    pattern's confidence is the mean score of its distinct instances; 0 if these scores come to less than support, or if its word stands
    beside identifiers in less than half of its occurrences and less than lift times as often as words do on the whole."""
    graph = found.groupBy("side", "neighbour", "word").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.max("bad").alias("bad"))
    kinds = graph.groupBy("word").agg(F.max("seed").alias("seed"), F.max("bad").alias("bad"))
    graph = table(graph.drop("seed", "bad").join(kinds, "word"), "pattern-graph")
    # Words are counted before the join, so that no task sees more of a word than one count from each other task.
    every = documents.select(F.explode(split_words(F.lower("text"))).alias("neighbour")).groupBy("neighbour").agg(F.count(F.lit(1)).alias("total"))
    every = table(every, "word-counts")
    beside = table(graph.groupBy("side", "neighbour").agg(F.sum("n").alias("n")).join(every, "neighbour"), "pattern-totals")
    n_words, n_found = every.agg(F.sum("total")).first()[0] or 1, graph.where("side = 'left'").agg(F.sum("n")).first()[0] or 0
    often = beside.where(F.col("n") >= F.col("total") * min(0.5, lift * n_found / n_words)).select("side", "neighbour")
    often = table(often, "pattern-words")
    graph = table(graph.join(often, ["side", "neighbour"]), "pattern-edges")
    score = graph.select("word", F.col("seed").cast("double").alias("score")).distinct()
    for k in range(rounds):
        each = graph.select("side", "neighbour", "word").join(score, "word")
        known = each.groupBy("side", "neighbour").agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("size"))
        known = table(known.select("side", "neighbour", F.when(F.col("good") >= support, F.col("good") / F.col("size")).otherwise(0.0).alias("confidence")), f"pattern-round{k}")
        best = graph.join(known, ["side", "neighbour"]).groupBy("word").agg(F.max("seed").alias("seed"), F.max("bad").alias("bad"), F.max("confidence").alias("confidence"))
        score = best.select("word", F.when(F.col("seed") == 1, 1.0).when(F.col("bad") == 1, 0.0).otherwise(F.col("confidence")).alias("score"))
    return known


def extract(documents: DataFrame, confident: float = CONFIDENT, support: float = SUPPORT, lift: float = LIFT) -> DataFrame:
    """Rows of documents without text, with base (array of spans) and context (array of start, kind, end)."""
    rows = table(annotate(documents), "personal")
    found = occurrences(rows)
    trusted = patterns(found, documents, support=support, lift=lift).where(F.col("confidence") >= confident).select("side", "neighbour")
    more = found.where("seed = 0 and bad = 0").join(trusted, ["side", "neighbour"], "left_semi")
    span = F.struct(F.col("start"), F.lit("context").alias("kind"), F.col("end"))
    # A written table: the join reads both sides by shuffles that Spark can split, however many rows share a text.
    more = table(more.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("context")), "context-spans")
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    base = F.filter("base", lambda b: b["good"])
    return rows.join(more, "blob", "left").select("row.*", base.alias("base"), F.coalesce("context", none).alias("context"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = spans_text(F.col("base"))
    every = F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("context") > 0, spans_text(F.col("context"))))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
