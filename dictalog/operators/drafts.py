"""Queries on the draft table and validated appends to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictalog.functions.times import format_timestamp
from dictalog.operators.matching import indel_ratio_from
from dictalog.session import materialize

MAX_LIMIT = 1000
DEEP_PAGE = 10_000


def drafts_since(drafts: DataFrame, since: float) -> DataFrame:
    """Drafts at or after a time."""
    kept = drafts.filter(F.col("timestamp") >= since)
    if "dt" in drafts.columns:  # partition column of the stored table
        kept = kept.filter(F.col("dt") >= F.to_date(F.timestamp_seconds(F.lit(since))))
    return kept


def draft_count(drafts: DataFrame) -> DataFrame:
    return drafts.agg(F.count(F.lit(1)).alias("total"))


def order_drafts(drafts: DataFrame, order: str = "desc") -> DataFrame:
    return drafts.orderBy(*_order(order))


def _order(order: str) -> list[Column]:
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be 'asc' or 'desc', not {order!r}")
    names = ["timestamp", "draft_id"]
    return [F.col(c).asc() if order == "asc" else F.col(c).desc() for c in names]


def page_drafts(
    drafts: DataFrame,
    limit: int = 100,
    offset: int = 0,
    order: str = "desc",
    since: float | None = None,
    summary: bool = False,
    deep_page: int = DEEP_PAGE,
) -> DataFrame:
    """One page in timestamp order. At most 1000 rows.

    A shallow page is a top-k. For a deep one, a quantile sketch gives a time just before the page; the exact count of
    the rows before it is taken off the offset, so no task has to hold the skipped rows.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    rows = drafts if since is None else drafts_since(drafts, since)
    if offset + limit > deep_page:
        rows, offset = _skip_to(rows, offset, order)
    rows = rows.orderBy(*_order(order)).offset(offset).limit(limit)
    return draft_summary(rows) if summary else rows


def _skip_to(rows: DataFrame, offset: int, order: str) -> tuple[DataFrame, int]:
    """The rows from just before the page on. Null times stand first in rising order and last in falling order."""
    total = rows.count()
    if offset >= total:
        return rows.limit(0), 0
    share = max(0.0, offset / total - 1e-3)
    share = share if order == "asc" else 1 - share
    bound = rows.agg(F.percentile_approx("timestamp", share, 10_000)).first()[0]
    if bound is None:  # no times at all
        return rows, offset
    ts = F.col("timestamp")
    ahead = ts.isNull() | (ts < bound) if order == "asc" else F.coalesce(ts > bound, F.lit(False))
    skipped = rows.filter(ahead).count()
    if skipped > offset:  # the sketch went too far: keep the plain plan
        return rows, offset
    return rows.filter(~ahead), offset - skipped


def page_after(
    drafts: DataFrame, after: tuple[float, str] | None, limit: int = 100, order: str = "desc"
) -> DataFrame:
    """Keyset page: rows after the last (timestamp, draft_id) of the page before. Cost does not grow with depth."""
    rows = drafts
    if after is not None:
        t, i = after
        ts, ident = F.col("timestamp"), F.col("draft_id")
        beyond = (ts > t) | ((ts == t) & (ident > i)) if order == "asc" else (ts < t) | ((ts == t) & (ident < i))
        rows = rows.filter(beyond)
    return rows.orderBy(*_order(order)).limit(limit)


def page_envelope(total: DataFrame, page: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, limit, offset, returned rows, and whether there are more."""
    none = F.lit(None).cast("long")
    both = total.select("total", none.alias("returned")).unionByName(
        page.agg(none.alias("total"), F.count(F.lit(1)).alias("returned"))
    )
    return both.agg(F.max("total").alias("total"), F.max("returned").alias("returned")).select(
        "total",
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        "returned",
        (F.col("returned") + offset < F.col("total")).alias("has_more"),
    )


def draft_summary(drafts: DataFrame) -> DataFrame:
    return drafts.select("draft_id", "timestamp", "parent_draft_id")


def draft_row(drafts: DataFrame) -> DataFrame:
    """Full projection with ``created_at`` as an ISO string. A table without class names or folders gets the defaults."""
    stored = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in drafts.columns else F.lit(default)
    return drafts.select(
        "draft_id",
        "timestamp",
        "full_text",
        stored("classname", "Draft").alias("classname"),
        stored("directory_path", "").alias("directory_path"),
        "parent_draft_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def draft_by_uuid(drafts: DataFrame, draft_id: str) -> DataFrame:
    return drafts.filter(F.col("draft_id") == draft_id)


def latest_draft(drafts: DataFrame, by: str = "created_at") -> DataFrame:
    """The last inserted draft; ids break ties."""
    newest = F.max_by(F.struct(*drafts.columns), F.struct(by, "draft_id"))
    return drafts.agg(newest.alias("d")).filter(F.col("d").isNotNull()).select("d.*")


def _parent_key() -> Column:
    """Join key for the parent. Drafts without one get a key of their own that matches nothing: left as null, they
    would all land in one shuffle partition."""
    return F.coalesce(F.col("parent_draft_id"), F.concat(F.lit("\u0000"), F.col("draft_id")))


def with_parent(drafts: DataFrame, carry: list[str]) -> DataFrame:
    """Each draft with the chosen columns of its parent (as ``parent_<name>``), null if it has none."""
    parents = drafts.select(F.col("draft_id").alias("_pk"), *[F.col(c).alias(f"parent_{c}") for c in carry])
    return drafts.withColumn("_pk", _parent_key()).join(parents, "_pk", "left").drop("_pk")


def with_children(drafts: DataFrame) -> DataFrame:
    """One row per draft and child; a draft without children has one row with null child columns.

    An inner join plus the childless drafts, instead of one outer join: AQE can then split the children of a draft that has
    very many.
    """
    kids = drafts.filter(F.col("parent_draft_id").isNotNull()).select(
        F.col("parent_draft_id").alias("draft_id"),
        F.col("draft_id").alias("child_draft_id"),
        F.col("timestamp").alias("child_timestamp"),
    )
    childless = drafts.join(kids.select("draft_id").distinct(), "draft_id", "left_anti")
    return drafts.join(kids, "draft_id").unionByName(childless, allowMissingColumns=True)


def draft_family(
    drafts: DataFrame,
    draft_id: str | None = None,
    include_parent: bool = True,
    include_children: bool = True,
) -> DataFrame:
    """Rows (draft_id, role, member_id, member_timestamp) with role draft, parent or child.

    For all drafts, or for one id: then the filter reaches every scan. An unknown id gives no rows. Children are rows,
    not an array, so a draft with very many revisions stays spread out.
    """
    own = drafts if draft_id is None else draft_by_uuid(drafts, draft_id)

    def member(df: DataFrame, role: str, ident: str, ts: str) -> DataFrame:
        return df.select(
            "draft_id", F.lit(role).alias("role"), F.col(ident).alias("member_id"), F.col(ts).alias("member_timestamp")
        )

    rows = member(own, "draft", "draft_id", "timestamp")
    if include_parent:
        ids = own.filter(F.col("parent_draft_id").isNotNull()).select("draft_id", "parent_draft_id")
        parents = drafts.select(F.col("draft_id").alias("parent_draft_id"), F.col("timestamp").alias("_t"))
        rows = rows.unionByName(member(ids.join(parents, "parent_draft_id"), "parent", "parent_draft_id", "_t"))
    if include_children:
        kids = drafts.filter(F.col("parent_draft_id").isNotNull())
        if draft_id is not None:
            kids = kids.filter(F.col("parent_draft_id") == draft_id)
        kids = kids.select(F.col("parent_draft_id").alias("draft_id"), F.col("draft_id").alias("_c"), "timestamp")
        kids = kids.join(own.select("draft_id"), "draft_id", "left_semi")
        rows = rows.unionByName(member(kids, "child", "_c", "timestamp"))
    return rows


def validate_ids(incoming: DataFrame, stored: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``reason``: null (accepted), 'duplicate' or 'unknown_parent'.

    The first row of an id within the batch counts; all others are duplicates, also those with the same place in the order. First rows are
    found by an aggregate that folds copies before the shuffle. A parent must be in the store already. A draft that comes in
    parts has one row for each ``part_no``; an id with another part number is not a duplicate.
    """
    numbered, reasons = judge_ids(incoming, stored, order_by)
    return numbered.join(reasons.select("_row", "reason"), "_row").select(*incoming.columns, "reason")


def judge_ids(incoming: DataFrame, stored: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The drafts with a row number ``_row``, written once, and for each number its ids, order and ``reason``: what decides is
    shuffled without the texts."""
    parts = [c for c in ("part_no",) if c in incoming.columns and c in stored.columns]
    ident = ["draft_id", *parts]
    numbered = materialize(incoming.withColumn("_row", F.monotonically_increasing_id()), "incoming")
    keys = dict.fromkeys([*ident, "parent_draft_id", *order_by, "_row"])
    thin = numbered.select(*keys, F.xxhash64(*incoming.columns).alias("_hash"))
    known = stored.select("draft_id").distinct()
    firsts = thin.groupBy(*ident).agg(F.min(F.struct(*order_by, "_hash", "_row"))["_row"].alias("_first"))
    marked = (
        thin.join(firsts, ident)
        .withColumn("_copy", F.col("_row") != F.col("_first"))
        .join(stored.select(*ident).distinct().withColumn("_stored", F.lit(True)), ident, "left")
    )
    parents = known.select(F.col("draft_id").alias("_pk"), F.lit(True).alias("_has_parent"))
    marked = marked.withColumn("_pk", _parent_key()).join(parents, "_pk", "left")
    reason = F.when(F.col("_stored").isNotNull() | F.col("_copy"), "duplicate").when(
        F.col("parent_draft_id").isNotNull() & F.col("_has_parent").isNull(), "unknown_parent"
    )
    return numbered, marked.select(*keys, reason.alias("reason"))


def import_revision(incoming: DataFrame) -> DataFrame:
    """Rescan events for external drafts; those without a parent are ignored."""
    return incoming.filter(F.col("parent_draft_id").isNotNull()).withColumns(
        {"kind": F.lit("rescan"), "original_draft_id": F.col("parent_draft_id")}
    )


def pair_rescans(drafts: DataFrame) -> DataFrame:
    """Each original with its latest revision. The latest is folded per original before the shuffle."""
    revisions = drafts.filter(F.col("parent_draft_id").isNotNull())
    latest = revisions.groupBy(F.col("parent_draft_id").alias("draft_id")).agg(
        F.max(F.struct("timestamp", F.col("draft_id").alias("id"), F.col("full_text").alias("text"))).alias("r"),
        F.count(F.lit(1)).alias("n_revisions"),
    )
    return drafts.join(latest, "draft_id").select(
        "draft_id",
        F.col("r.id").alias("revision_id"),
        F.col("r.timestamp").alias("revision_timestamp"),
        "n_revisions",
        "full_text",
        F.col("r.text").alias("revision_text"),
    )


def revision_similarity(pairs: DataFrame, minimum: float = 75.0) -> DataFrame:
    """Indel ratio of original and revised text, kept where it reaches ``minimum``.

    A pair whose lengths alone rule it out never reaches Python.
    """
    n, m = F.length("full_text"), F.length("revision_text")
    reachable = 200.0 * F.least(n, m) >= minimum * (n + m)
    same = F.col("full_text") == F.col("revision_text")
    score = F.when(same, F.lit(100.0)).otherwise(
        indel_ratio_from(minimum)(F.when(~same, F.col("full_text")), F.when(~same, F.col("revision_text")))
    )
    return pairs.filter(reachable).withColumn("score", score).filter(F.col("score") >= minimum)


def list_revisions(drafts: DataFrame, parent: str | None = None, preview: int = 40) -> DataFrame:
    """Revisions of each draft, newest first, with a preview of the text."""
    rows = drafts.filter(F.col("parent_draft_id").isNotNull())
    if parent is not None:
        rows = rows.filter(F.col("parent_draft_id") == parent)
    return rows.select(
        F.col("parent_draft_id").alias("original_draft_id"),
        F.col("draft_id").alias("revision_id"),
        format_timestamp(F.col("timestamp")).alias("created_at"),
        F.col("author_uri").alias("source"),
        F.when(F.length("full_text") > preview, F.concat(F.substring("full_text", 1, preview), F.lit("...")))
        .otherwise(F.col("full_text"))
        .alias("text_preview"),
    ).orderBy("original_draft_id", F.col("created_at").desc(), F.col("revision_id").desc())


# Who wins when a draft has several revisions.
REVISION_PRIORITY = {"HUMAN": 0, "LLM": 1, "WHISPER_REPROCESS": 2, "UNKNOWN": 3}


def resolve_revision(drafts: DataFrame, source: Column) -> DataFrame:
    """The revision to keep per draft: highest source priority, then newest, then id."""
    rank = F.lit(REVISION_PRIORITY["UNKNOWN"])
    for name, value in REVISION_PRIORITY.items():
        rank = F.when(source == name, F.lit(value)).otherwise(rank)
    choice = F.min_by(
        F.struct("draft_id", source.alias("kind"), "timestamp"),
        F.struct(rank.alias("rank"), (-F.col("timestamp")).alias("age"), "draft_id"),
    )
    return (
        drafts.filter(F.col("parent_draft_id").isNotNull())
        .groupBy(F.col("parent_draft_id").alias("original_draft_id"))
        .agg(choice.alias("c"))
        .select(
            "original_draft_id",
            F.col("c.draft_id").alias("revision_id"),
            F.col("c.kind").alias("revision_source"),
            F.col("c.timestamp").alias("timestamp"),
        )
    )
