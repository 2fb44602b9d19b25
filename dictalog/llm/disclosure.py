"""Operator 4: personal data, and the terms that give it away by the corpus's own statistics.

Base spans come from fixed patterns. For every word of a document that holds such a value (an entity), the corpus says how often the word comes with
the entity and how often at all. A word discloses an entity when their pointwise mutual information reaches a share of the entity's own information:
log2(co * N / (n_word * n_entity)) >= share * log2(N / n_entity). At a share of one the word never comes without the entity and is
removed; from ``hint`` on it is generalised. Counts are of documents. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictalog.llm.rows import fields_of, numbered, struct_of
from dictalog.session import materialize

#: Kinds in order, and their patterns. Possessive quantifiers and the borders in front match the same
#: strings as the plain patterns, but in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term", "hint"]
WHITE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Settings:
    support: int = 3
    """Documents in which a word must come with an entity."""
    contexts: int = 2
    """Different texts among them (copies are no further evidence)."""
    hint: float = 0.8
    """Share of the entity's information from which a word is generalised; from 1 on it is removed."""
    broadcast: int = 100_000
    """Rows of a table of values, terms or pairs that may be sent to all executors."""
    hot: int = 1000
    """Documents from which on a key is sent to its rows instead."""


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = lambda x: F.regexp_replace(x, "^0+", "")
    small = F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == 1, small)
        .when(kind == 2, F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
        .when(kind == 3, F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def entities(texts: DataFrame) -> DataFrame:
    """(rid, kind, value, start, end): every base span, from rows of rid and text."""
    found = []
    for kind, p in enumerate(PATTERNS.values()):
        hit = F.col("text").contains("@") & F.col("text").rlike(p) if kind == 0 else F.col("text").rlike(p)
        gaps = F.when(hit, F.transform(F.split("text", p, -1), F.length))
        found.append(F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.when(hit, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("matches")))
    rows = texts.select("rid", F.inline(F.filter(F.array(*found), lambda x: x["gaps"].isNotNull())))
    at = F.transform("matches", lambda x, i: F.struct(x.alias("value"), F.get("gaps", i).alias("n")))
    rows = rows.select("rid", "kind", F.posexplode(at).alias("i", "x")).select("rid", "kind", "i", "x.*")
    order = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("n") + F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return rows.filter(_valid(F.col("kind"), F.col("value"))).select("rid", "kind", "value", "start", "end")


def _term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", ""))


def _candidate(word: Column) -> Column:
    """The term of a whole word, or null where it can't disclose: without letters, with digits, or part of a value.

    Every word that a value touches has digits, or is an e-mail in whole or in part.
    """
    term = _term(word)
    return F.when((term != "") & ~term.rlike("[0-9@+]") & ~(word.contains("@") & word.rlike(PATTERNS["email"])), term)


def _meet(many: DataFrame, counted: DataFrame, keys: list[str], n: str, hot: int, s: Settings) -> DataFrame:
    """Inner join with rows unique by key, whose ``n`` is at least the number of documents behind a key. A short table is sent to
    ``many``; of a long one only the keys of more than ``hot`` documents, so that no key fills a task."""
    if counted.limit(s.broadcast + 1).count() <= s.broadcast:
        return many.join(F.broadcast(counted), keys)
    frequent = many.join(F.broadcast(counted.filter(F.col(n) > hot)), keys)
    return frequent.unionByName(many.join(counted.filter(F.col(n) <= hot), keys))


def disclosing(carriers: DataFrame, texts: DataFrame, total: int, hot: int, s: Settings) -> DataFrame:
    """(value, term, both, strength): pairs whose mutual information reaches the share ``hint`` of the entity's information."""
    terms = F.array_distinct(F.filter(F.transform(F.split("text", WHITE + "+"), _candidate), lambda x: x.isNotNull()))
    rows = carriers.select("values", F.xxhash64("text").alias("whole"), F.explode(terms).alias("term"))
    rows = rows.select("term", "whole", F.inline("values"))
    # two different texts show without a list of them
    different = F.when(F.min("whole") == F.max("whole"), 1).otherwise(2) if s.contexts <= 2 else F.countDistinct("whole")
    pairs = rows.groupBy("value", "with_value", "term").agg(F.count(F.lit(1)).alias("both"), different.alias("different"))
    pairs = materialize(pairs.filter((F.col("both") >= s.support) & (F.col("different") >= s.contexts)).drop("different"), "pairs")
    words = texts.select(F.explode(F.array_distinct(F.transform(F.split("text", WHITE + "+"), _term))).alias("term"))
    of_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).filter(F.col("with_term") >= s.support)
    out = _meet(pairs, materialize(of_term, "terms"), ["term"], "with_term", hot, s)
    own = F.log2(F.lit(total) / F.col("with_value"))
    mutual = F.log2(F.col("both") * F.lit(total) / (F.col("with_term") * F.col("with_value")))
    return out.select("value", "term", "both", F.when(own > 0, mutual / own).otherwise(F.lit(0.0)).alias("strength")).filter(F.col("strength") >= s.hint)


def _marked(carriers: DataFrame, told: DataFrame, hot: int, s: Settings) -> DataFrame:
    """(rid, start, end, strength): every occurrence of a disclosing term in the documents that hold its value."""
    words = F.transform(F.split("text", WHITE, -1), _candidate)
    rows = carriers.select("rid", F.transform("values", lambda v: v["value"]).alias("values"), F.posexplode(words).alias("i", "term")).filter("term is not null")
    rows = _meet(rows.select("rid", "i", "term", F.explode("values").alias("value")), told, ["value", "term"], "both", hot, s)
    rows = rows.groupBy("rid", "i").agg(F.max("strength").alias("strength"))
    lists = rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "strength"))).alias("marks"))
    # a generator keeps the split out of the lambda
    split = carriers.select("rid", "text").join(lists, "rid").select("rid", "marks", F.explode(F.array(F.split("text", WHITE, -1))).alias("words"))
    before = lambda i: F.when(i > 0, F.get("marks", i - 1)["i"]).otherwise(F.lit(0))
    gap = lambda x, i: F.when(x["i"] > before(i), F.length(F.array_join(F.slice("words", before(i) + 1, x["i"] - before(i)), " ")) + 1).otherwise(F.lit(0))
    at = F.transform("marks", lambda x, i: F.struct(gap(x, i).cast("long").alias("gap"), F.length(F.get("words", x["i"])).alias("n"), x["strength"].alias("strength")))
    out = split.select("rid", F.posexplode(at).alias("k", "x")).select("rid", "k", "x.*")
    start = F.sum("gap").over(Window.partitionBy("rid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("start", start).select("rid", "start", (F.col("start") + F.col("n")).alias("end"), "strength")


def spans(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(rid, kind, start, end): base spans and the words that disclose an entity, wherever they stand in a document that holds it.

    ``texts`` has rid (unique) and text (null counts as empty) and is read more than once. kind is a place in KINDS.
    """
    texts = texts.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.count()
    hot = max(s.hot, total // 10_000)
    found = materialize(entities(texts), "entities")
    held = found.select("rid", "value").distinct()
    of_value = held.groupBy("value").agg(F.count(F.lit(1)).alias("with_value"))
    of_value = materialize(of_value.filter(F.col("with_value") >= s.support), "values")  # rarer ones can't have a term
    values = _meet(held, of_value, ["value"], "with_value", hot, s).groupBy("rid").agg(F.collect_list(F.struct("value", "with_value")).alias("values"))
    carriers = materialize(texts.join(values, "rid"), "carriers")
    told = materialize(disclosing(carriers, texts, total, hot, s), "told")
    marked = _marked(carriers, told, hot, s)
    marked = marked.select("rid", F.when(F.col("strength") >= 1 - 1e-9, 4).otherwise(5).alias("kind"), "start", "end")
    return found.select("rid", "kind", "start", "end").unionByName(marked)


def span_lists(docs: DataFrame, s: Settings = Settings(), text: str = "text", rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: rid and spans, an array of (start, kind, end) by start, then kind (empty where there are none).

    rid is the column of that name (see ``rows.numbered``), or a new number.
    """
    docs, rid = numbered(docs, rid)
    base = docs.select(F.col(rid).alias("rid"), F.col(f"`{text}`").alias("text"))
    lists = spans(base, s).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    rows = docs.select(F.col(rid).alias("rid"))
    return rows.join(lists, "rid", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")))


def written(kinds_below: int | None = None) -> Column:
    """The spans as kind:start:end, comma-joined; only kinds before the given place."""
    own = F.col("spans") if kinds_below is None else F.filter("spans", lambda x: x["kind"] < kinds_below)
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs``, all columns, with the spans taken out of the text: values become their kind in brackets, disclosing terms go
    (kind term) or become [word] (kind hint). Of overlapping spans the first counts, up to its end. Null texts stay null."""
    placed, rid = numbered(docs)
    lists = span_lists(placed, s, text, rid).filter("size(spans) > 0")
    rows = placed.select(F.col(rid).alias("rid"), struct_of(docs, docs.columns).alias("row")).join(lists, "rid", "left")
    whole, marks = F.col("row").getField(text), F.col("spans")
    names = F.array(*[F.lit(x) for x in ("[email]", "[ip]", "[card]", "[phone]", "", "[word]")])
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(marks, 1, i), lambda x: x["end"])), F.lit(0))
    cut = lambda i, to: F.substring(whole, (reach(i) + 1).cast("int"), F.greatest(to - reach(i), F.lit(0)).cast("int"))
    part = F.transform(marks, lambda x, i: F.concat(cut(i, x["start"]), F.when(x["start"] >= reach(i), F.get(names, x["kind"])).otherwise(F.lit(""))))
    new = F.concat(F.array_join(part, ""), cut(F.size(marks), F.length(whole)))
    text_now = F.when(marks.isNull(), whole).otherwise(new).alias(text)
    return rows.select(*[text_now if c == text else x for c, x in zip(docs.columns, fields_of("row", docs.columns))])
