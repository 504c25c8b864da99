"""Personal data in texts: four base patterns, and identifiers that their contexts give away.

Base spans are leftmost, non-overlapping matches; one whose digits don't fit is dropped. They are the seeds of a
bootstrap. The two words before a seed, with its kind, are a lexical pattern; what stands behind a pattern and looks like
a number or an address is an instance. Patterns and instances form a graph that is scored in rounds: a pattern by the share
of its instances that are known, weighed by the instances, against a prior that asks for several; an instance by the most reliable
pattern that has it. Patterns that stay reliable, with enough different seeds, then turn their other instances, if those have the
form of their kind, into further spans.

DataFrame functions only. A text is split by a pattern, and the running sum of the lengths of pieces and matches gives the
positions. The patterns never back off over more than a bounded piece, so very long texts and words cost linear time, and
repetition is possessive, which Java runs without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, read_table, stash, unused

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns in a form that Java matches in linear time: a run is entered at its start, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier behind a reliable pattern: numbers with separators, and addresses written around the @.
CANDIDATES = {
    "number": r"(?<![A-Za-z0-9])[0-9(][0-9().\x20-]{5,38}[0-9](?![A-Za-z0-9])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?\((?:at|AT)\)\x20?|\x20?\[(?:at|AT)\]\x20?)[A-Za-z0-9._-]{2,64}+",
}
#: A cheap test that a text can have a match at all.
MAY = {
    "email": "@",
    "phone": "+",
}
ROUNDS = 3
#: A pattern is reliable from this score and this many different seeds on.
RELIABLE, SEEDS = 0.8, 5
#: Unknown instances that a pattern is taken to have beside its own.
PRIOR = 1.0


def _split(docs: DataFrame, kind: str, pattern: str) -> DataFrame:
    """(row_id, doc_id, kind, start, end, value, before): matches in code points, end exclusive; before: the last words before the
    match, with the two matches before it and theirs."""
    may = F.col("text").contains(MAY[kind]) if kind in MAY else F.col("text").rlike(pattern)
    pieces = docs.where(may).select("row_id", "doc_id", F.split("text", pattern, -1).alias("pieces"), F.expr(f"regexp_extract_all(text, r'{pattern}', 0)").alias("found"))
    each = pieces.where(F.size("found") > 0).select("row_id", "doc_id", F.posexplode(F.arrays_zip(F.slice("pieces", 1, F.size("found")).alias("before"), F.col("found").alias("value"))).alias("k", "m")).select("row_id", "doc_id", "k", "m.*")
    # only texts with matches come here, and of them only the matches and their lengths
    length = F.length("before") + F.length("value")
    in_row = Window.partitionBy("row_id").orderBy("k")
    end = F.sum("step").over(in_row)
    # a piece may have fewer than two words, and a word may begin before it
    earlier = [F.coalesce(F.lag(c, n).over(in_row), F.lit("")) for n in (2, 1) for c in ("tail", "value")]
    return (
        each.select("row_id", "doc_id", "k", "value", _tail(F.col("before")).alias("tail"), length.cast("long").alias("step"))
        # repeated rows share row_id and k: the sum must see each match once
        .repartition("row_id")
        .distinct()
        .select("*", end.alias("end"), F.concat(*earlier, "tail").alias("before"))
        .select("row_id", "doc_id", F.lit(kind).alias("kind"), (F.col("end") - F.length("value")).alias("start"), "end", "value", "before")
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 3) | ((F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255"))
    card = F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.when(kind == "ip", F.forall(F.split(value, r"\."), part)).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True))


def _tail(text: Column) -> Column:
    """The last two words of a text and the white space behind them; of a text with fewer words, all of it. Read from the end, so that
    what is before costs nothing but its reversal."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++)?+)?+", 0))


def _context(before: Column) -> Column:
    """The last two words before a match, lower-cased, without punctuation around; null if there are fewer."""
    plain = F.lower(F.trim(F.regexp_replace(_tail(before), r"[^\p{L}\p{N}]+", " ")))
    return F.when(plain.contains(" "), plain)


def _form(value: Column) -> Column:
    """The kind whose form a candidate has: an address, four numbers with dots, a card's or a phone's count of digits."""
    n = F.length(_digits(value))
    return F.when(value.rlike("[A-Za-z]"), "email").when(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(n.between(13, 19), "card").when(n.between(7, 15), "phone")


def reliable_patterns(seeds: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """seeds and others (kind, context, value) -> (kind, context): iterative scores over the pattern-instance graph.

    The graph has an edge for every distinct context and value of a kind. All sums are aggregates by key."""
    edges = stash(
        seeds.select("kind", "context", F.lower("value").alias("value"), F.lit(1.0).alias("seed")).union(others.select("kind", "context", F.lower("value").alias("value"), F.lit(0.0).alias("seed"))).where("context is not null").groupBy("kind", "context", "value").agg(F.max("seed").alias("seed")),
        "edges",
    )
    known, done, patterns = edges.groupBy("kind", "value").agg(F.max("seed").alias("score")), [], None
    for _ in range(rounds):
        scored = edges.join(known, ["kind", "value"])
        patterns = scored.groupBy("kind", "context").agg((F.sum("score") / (F.count("*") + F.lit(PRIOR))).alias("reliability"), F.sum("seed").alias("seeds"))
        patterns = stash(patterns, "patterns")
        for df in done:
            forget(df)
        reached = edges.join(patterns.where("seeds > 0"), ["kind", "context"]).groupBy("kind", "value").agg(F.greatest(F.max("seed"), F.max("reliability")).alias("score"))
        known = stash(reached, "known")
        done = [patterns, known]
    forget(known)
    forget(edges)
    return patterns.where((F.col("reliability") >= RELIABLE) & (F.col("seeds") >= SEEDS)).select("kind", "context")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, kind, start, end, value, base): base spans, and those that contexts give away (base false)."""
    rows = _rows(docs, id_col, text_col)
    found = None
    for kind in KINDS:
        one = _split(rows, kind, PATTERNS[kind])
        found = one if found is None else found.union(one)
    base = stash(found.where(_valid(F.col("kind"), F.col("value"))).withColumn("context", _context(F.col("before"))).drop("before"), "base")
    maybe = None
    for kind, pattern in CANDIDATES.items():
        one = _split(rows, kind, pattern)
        maybe = one if maybe is None else maybe.union(one)
    maybe = maybe.withColumn("context", _context(F.col("before"))).withColumn("kind", _form(F.col("value"))).drop("before").where("context is not null and kind is not null")
    taken = base.select(F.col("row_id").alias("row"), F.col("start").alias("s"), F.col("end").alias("e"))
    others = stash(maybe.join(taken, (F.col("row_id") == F.col("row")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti"), "candidates")
    patterns = reliable_patterns(base, others)
    new = others.join(patterns, ["kind", "context"], "left_semi")
    columns = ["row_id", "doc_id", "kind", "start", "end", "value"]
    return base.select(*columns, F.lit(True).alias("base")).union(new.select(*columns, F.lit(False).alias("base")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row is known by its doc_id and a 128-bit digest of its text: equal rows have equal spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(F.struct("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")).alias("row_id"), "doc_id", "text")


def per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base (kind:start:end, comma-joined), spans
    (with those that contexts give away), n_context.

    Null texts count as empty and have no spans. Repeated rows get the same result each. A null doc_id stays null. Other
    columns are ignored. An empty table gives no rows."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # rows that are repeated found their spans several times
    all_spans = spans(docs, id_col, text_col).select("row_id", order.alias("o"), "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "base").distinct()
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_row = all_spans.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("o", "start", "end", "kind", "base"))).alias("all"))
    rows = _rows(docs, id_col, text_col).select("row_id", "doc_id").join(of_row, "row_id", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<o: bigint, start: bigint, end: bigint, kind: string, base: boolean>>)")))
    base = F.filter("all", lambda x: x["base"])
    counts = [F.size(F.filter("all", _base_of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, text(base).alias("base"), text(F.col("all")).alias("spans"), F.size(F.filter("all", lambda x: ~x["base"])).cast("long").alias("n_context"))


def _base_of(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns and rows, whatever their names; in its texts every span is replaced by [kind]. Of overlapping spans
    the one that starts first, the longer one at a tie, stands for all that it overlaps. Null texts stay null, repeated rows are
    each masked alike, an empty table stays empty."""
    row, found = unused(docs.columns, "row_id", "found")
    of_row = spans(docs, id_col, text_col).select(F.col("row_id").alias(row), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind").distinct().groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("minus"), "kind"))).alias(found))
    text = F.col(text_col)
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h1"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1)).alias("h2"))
    state = F.aggregate(
        F.col(found),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], -x["minus"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
            F.struct((-x["minus"]).alias("at"), F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("parts"))
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))),
    )
    # the spans grow with the documents, so they are never broadcast, however few they may be here
    joined = docs.withColumn(row, key).join(of_row.hint("merge"), row, "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(state)).select(*docs.columns)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = per_document(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_context")
