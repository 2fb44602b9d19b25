"""The operators applied to their whole tables: one query each, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictalog.llm import collocations, disclosure, exact_dedup, fm_index, licenses, mixing, negatives, parity, pieces, postings, ring, subwords, suffixes
from dictalog.llm.rows import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


N_SHARDS = 24


@_query("op1_ring_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring.ring_shards(docs, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffixes.remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op3_fm_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fm_index.remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_OP6 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


@_query("op6_exact_dedup", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@_query("op7_parity_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = parity.link_documents(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@_query("op8_posting_ann")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


_OP9 = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM g),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
      FROM w WINDOW before AS (ORDER BY source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size < level * weight THEN CAST(3 * source_size AS DOUBLE)
             ELSE max(CASE WHEN 3 * source_size >= level * weight THEN level END) OVER () * weight END AS target FROM l),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'none')) AS digest, s.source,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
             CAST(('0x' || substr(md5('mix:' || coalesce(s.source, 'none')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), substr(digest, 1, 1), size, digest) AS place FROM r)
SELECT doc_id, size, source_size, target, CAST(floor(place * each + u) - floor((place - 1) * each + u) AS BIGINT) * size AS taken FROM n
"""


@_query("op9_systematic_mix", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(_table(spark, sf_dir, "documents"), mixing.n_words(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@_query("op4_disclosure_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed, rid = numbered(docs)
    lists = disclosure.span_lists(placed, rid=rid)
    ids = placed.select("doc_id", F.col(rid).alias("rid"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(disclosure.PATTERNS)]
    base = F.sha2(disclosure.written(len(disclosure.PATTERNS)).cast("binary"), 256)
    return ids.join(lists, "rid").select("doc_id", *counts, base.alias("base_sha256"), disclosure.written().alias("spans"))


@_query("op5_nbest_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "digest.*")


#: Rows with this remainder of crc32(doc_id as text) modulo 3 are held out.
HELD_OUT = 1


def quality_model(docs: DataFrame, labels: DataFrame) -> subwords.Model:
    return subwords.fit(docs, labels, "quality", _fold(F.col("doc_id")) != HELD_OUT)


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


@_query("op10_subword_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    out = subwords.score(docs, model)
    held_out = F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op11_license_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("licenses.found")
    base = F.filter(found, lambda x: x["base"])
    places = F.transform(base, lambda x: x["first"])
    listed = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    return out.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(found).alias("labels"),
        F.col("licenses.score").alias("score"),
    )


_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
      FROM v a JOIN v r ON len(a.q) = len(r.q) AND a.vec_id IS DISTINCT FROM r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


@_query("op12_gnat_negatives", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


_OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?
-
]')), '[^ 	]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT c.*, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < words),
s AS (SELECT x.lang, x.phrase, words, a, x.k, h.n AS l, t.n AS r, CAST((1000000::HUGEINT * a * a) // (h.n::HUGEINT * t.n) AS BIGINT) AS score
      FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL)
SELECT b.lang, CAST(row_number() OVER o AS INTEGER) AS rank, b.phrase, a, l, r, n.n, score
FROM b JOIN n USING (lang) LEFT JOIN around u ON u.lang = b.lang AND u.phrase = b.phrase
WHERE u.longer IS NULL OR 100 * u.longer < 50 * a
WINDOW o AS (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) QUALIFY row_number() OVER o <= 2000
"""


@_query("op13_toivonen_phrases", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))
