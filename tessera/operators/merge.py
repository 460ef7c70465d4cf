"""Keyed merges over snapshot tables: sequence ids, upsert, segment and
user-segment upserts, tracking-flag update, constraint and cascade reports.

Parquet tables cannot be updated in place, so every merge returns the next
snapshot of the target as a DataFrame (full outer join of target and the
reduced batch); :func:`tessera.sources.sinks.publish_snapshot` writes it to
a new version folder and only then moves the pointer.

Batches are reduced to one row per key with ``max(struct(pos, ...))``
aggregates (partial aggregation, no per-key sort), so a key that holds a
large share of a batch never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import customer_aliases, spread_key, stored_aliases, unique_aliases
from tessera.session import ensure_checkpoint_dir


# -- K4: dense sequence ids ------------------------------------------------------
def sequence_ids(df: DataFrame, order_by: list[str], start: Column | int = 0,
                 name: str = "id") -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in ``order_by`` order
    (``order_by`` must be unique), without moving all rows to one task.

    Only the order key is ranked (:func:`dense_ranks`); the rank is joined back to the rows, so what is
    written does not grow with their width.
    """
    ranks = dense_ranks(df, order_by)
    start_col = start if isinstance(start, Column) else F.lit(start)
    ranked = ranks.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], "_rank")
    on = None
    for i, c in enumerate(order_by):  # a missing part of the key is a value too
        same = F.col(c).eqNullSafe(F.col(f"_o{i}"))
        on = same if on is None else on & same
    out = df.drop(name).join(ranked, on) if name in df.columns else df.join(ranked, on)
    return out.withColumn(name, (start_col + F.col("_rank")).cast("bigint")).drop(
        "_rank", *[f"_o{i}" for i in range(len(order_by))])


def dense_ranks(df: DataFrame, order_by: list[str]) -> DataFrame:
    """``order_by`` and ``_rank`` (1, 2, ...) of every row; ``order_by`` must be unique.

    Keys are range-partitioned and sorted, tagged with (partition, position in partition), and
    checkpointed so that partition membership is fixed. Per-partition counts (one row per
    partition) give each partition's offset; that small table is broadcast back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.select(*order_by).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    # lower 33 bits of monotonically_increasing_id = position inside the partition
    tagged = tagged.withColumn("_pos", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")  # one row per partition
    return out.select(*order_by, (F.col("_off") + F.col("_pos") + 1).alias("_rank"))


def max_id(df: DataFrame, c: str = "id") -> Column:
    """``COALESCE(MAX(id), 0)`` of a table as a scalar subquery column."""
    return F.coalesce(df.agg(F.max(c).cast("bigint")).scalar(), F.lit(0).cast("bigint"))


def last_per_key(df: DataFrame, keys: list[str], order_col: str, cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_col`` per key (last writer wins)."""
    agg = df.groupBy(*keys).agg(F.max(F.struct(order_col, *cols)).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


# -- A2: generic upsert ----------------------------------------------------------
def upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str],
           order_col: str | None = None, id_col: str | None = "id") -> DataFrame:
    """``INSERT .. ON CONFLICT (keys) DO UPDATE SET update_cols = EXCLUDED..``.

    Source rows are reduced to the last one per key (``order_col``), then
    full-outer-joined with the target. Matched rows take the update
    columns from the source; new keys are inserted, with ``id_col`` drawn
    from the sequence after the target's largest id when the source has none.
    """
    cols = [c for c in target.columns]
    src_cols = [c for c in source.columns if c not in keys and c != order_col]
    if order_col:
        source = last_per_key(source, keys, order_col, src_cols)
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in src_cols], F.lit(True).alias("_src"))
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in cols if c not in keys], F.lit(True).alias("_tgt"))
    j = t.join(s, keys, "full_outer")
    new_rows = F.col("_tgt").isNull()
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
            continue
        tv = F.col(f"_t_{c}")
        sv = F.col(f"_s_{c}") if c in src_cols else F.lit(None).cast(target.schema[c].dataType)
        if c in update_cols:
            out.append(F.when(F.col("_src").isNotNull(), sv).otherwise(tv).alias(c))
        else:
            out.append(F.when(new_rows, sv).otherwise(tv).alias(c))
    if not id_col or id_col in src_cols:
        return j.select(*out)
    # the new keys alone are ranked, and meet the merged rows with their number
    ranks = dense_ranks(source.select(*keys).distinct().join(target.select(*keys), keys, "left_anti"), keys)
    drawn = F.coalesce(F.col(f"_t_{id_col}"), (max_id(target, id_col) + F.col("_rank"))).cast(target.schema[id_col].dataType)
    return j.join(ranks, keys, "left").select(*[drawn.alias(c) if c == id_col else o for c, o in zip(cols, out, strict=True)])


# -- B10 (segment rows), K1, K2, L28 ---------------------------------------------
def validate_segment_batch(batch: DataFrame, customers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Per batch row (``pos``, ``customer_id`` key, ``segment_name``,
    ``description``, ``confidence``): the first failing rule, or NULL.
    Adds ``cid`` / ``customer_code`` of the resolved customer. A column
    ``request_error`` (a request that the reader refuses as a whole) comes
    first; ``aliases`` may pass a :func:`stored_aliases` table."""
    aliases = aliases if aliases is not None else unique_aliases(customers)
    j = batch.join(aliases, spread_key(batch["customer_id"], batch["pos"]) == aliases["alias"], "left")
    key, name = F.col("customer_id"), F.col("segment_name")
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    error = (F.when(key.isNull() | (key == "") | name.isNull() | (name == ""),
                    "customer_id and segment_name are required")
             .when((conf < 0) | (conf > 1), "confidence must be between 0 and 1")
             .when(F.col("resolved_id").isNull(), "user not found"))
    if "request_error" in batch.columns:
        error = F.coalesce(F.col("request_error"), error)
    return j.select(*batch.columns, F.col("resolved_id").alias("cid"),
                    F.col("resolved_customer_id").alias("customer_code"), error.alias("error"))


def segment_changes(segments: DataFrame, batch: DataFrame, last_id: Column | None = None) -> DataFrame:
    """The ``segments`` rows that upserting every batch row by name in batch order
    changes or adds: a name's description becomes its last non-empty description
    (existing names keep theirs when none); new names get ids after
    ``last_id`` (default: the greatest of ``segments``) in order of first appearance."""
    desc = F.coalesce(F.col("description"), F.lit(""))
    per_name = batch.groupBy(F.col("segment_name").alias("name")).agg(
        F.min("pos").alias("first_pos"),
        F.max(F.when(desc != "", F.struct(F.col("pos"), desc.alias("d")))).alias("_ne"),
        F.min(F.struct(F.col("pos"), desc.alias("d"))).alias("_first"),
    )
    t = segments.select(F.col("id").alias("t_id"), "name", F.col("description").alias("t_desc"))
    j = per_name.join(t, "name", "left").select(
        "t_id", "name", "first_pos",
        F.coalesce(F.col("_ne.d"), F.when(F.col("t_id").isNull(), F.col("_first.d")).otherwise(F.col("t_desc"))).alias(
            "description"))
    ranks = dense_ranks(j.filter(F.col("t_id").isNull()), ["first_pos"])
    last = last_id if last_id is not None else max_id(segments)
    return j.join(ranks, "first_pos", "left").select(
        F.coalesce(F.col("t_id").cast("bigint"), last + F.col("_rank")).cast("int").alias("id"), "name", "description")


def segment_upsert(segments: DataFrame, batch: DataFrame) -> DataFrame:
    """Next ``segments`` snapshot: the rows of :func:`segment_changes` in place of those of their name."""
    changes = segment_changes(segments, batch).checkpoint(eager=True)
    return segments.join(changes, "name", "left_anti").select("id", "name", "description").unionByName(changes)


def _per_customer(resolved: DataFrame) -> DataFrame:
    """Last segment and first position of every customer of a batch."""
    return resolved.groupBy("cid").agg(
        F.max(F.struct("pos", "segment_name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))).alias("_last"),
        F.min("pos").alias("first_pos"))


def user_segment_actions(user_segments: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per batch row: ``inserted`` only for a customer's first row when the
    customer had no assignment, else ``updated`` (later rows update the row
    the first one inserted). The rows are joined on their position, which
    no two share, not on the customer, who may hold many."""
    had = user_segments.select(F.col("customer_id").alias("cid"))
    inserted = _per_customer(resolved).join(had, "cid", "left_anti").select(
        F.col("first_pos").alias("pos"), F.lit("inserted").alias("_action"))
    return resolved.join(inserted, "pos", "left").select(
        "pos", "cid", "customer_code", "segment_name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_action", F.lit("updated")).alias("action"))


def user_segment_changes(held: DataFrame, resolved: DataFrame, segment_ids: DataFrame, as_of,
                         last_id: Column | None = None) -> DataFrame:
    """The ``user_segments`` rows that applying resolved batch rows (``pos``, ``cid``, ``segment_name``,
    ``confidence``) in order changes or adds: the last row of a customer wins and stamps ``created_at
    = as_of``; customers without an assignment in ``held`` get one, with ids after
    ``last_id`` (default: the greatest of ``held``) in order of their first row."""
    from tessera.functions.expr import ntz

    # one row per customer first, so that ids are looked up for the winners only
    seg_ids = segment_ids.select(F.col("id").alias("segment_id"), F.col("name").alias("segment_name"))
    per_customer = (_per_customer(resolved).withColumn("segment_name", F.col("_last.segment_name"))
                    .join(seg_ids, "segment_name").drop("segment_name"))
    had = held.select(F.col("customer_id").alias("cid"), F.col("id").alias("t_id"))
    j = per_customer.join(had, "cid", "left")
    ranks = dense_ranks(j.filter(F.col("t_id").isNull()), ["first_pos"])
    last = last_id if last_id is not None else max_id(held)
    return j.join(ranks, "first_pos", "left").select(
        F.coalesce(F.col("t_id"), last + F.col("_rank")).cast("bigint").alias("id"), F.col("cid").alias("customer_id"),
        "segment_id", F.col("_last.confidence").alias("confidence"), ntz(as_of).alias("created_at"))


def user_segment_upsert(user_segments: DataFrame, resolved: DataFrame, new_segments: DataFrame,
                        as_of) -> DataFrame:
    """Next ``user_segments`` snapshot: the rows of :func:`user_segment_changes` in place of those of their customer."""
    changes = user_segment_changes(user_segments, resolved, new_segments, as_of).checkpoint(eager=True)
    cols = ["id", "customer_id", "segment_id", "confidence", "created_at"]
    return user_segments.join(changes, "customer_id", "left_anti").select(*cols).unionByName(changes.select(*cols))


class LazyOutputs(dict):
    """Outputs of a job, each built on first access (building some of them
    runs jobs, e.g. id allocation, that other outputs do not need)."""

    def __init__(self, **factories):
        super().__init__()
        self._factories = factories

    def __getitem__(self, key):
        if not dict.__contains__(self, key):
            dict.__setitem__(self, key, self._factories[key]())
        return dict.__getitem__(self, key)

    def __contains__(self, key):
        return key in self._factories

    def keys(self):
        return self._factories.keys()


def admitted(checked: DataFrame) -> DataFrame:
    """The rows of the requests without a failing row. With a column ``request``
    every request stands for itself, so a bad one costs no other its rows,
    however requests are batched; without it the whole batch is one request.
    A missing request id counts as one request named ''."""
    good = checked.filter(F.col("error").isNull())
    bad = checked.filter(F.col("error").isNotNull())
    if "request" not in checked.columns:
        return good.filter(F.coalesce(bad.agg(F.count(F.lit(1))).scalar(), F.lit(0)) == 0)
    name = F.coalesce(F.col("request").cast("string"), F.lit(""))
    # written, so that the join with a request holding most rows can be split
    bad = bad.select(name.alias("_r")).distinct().checkpoint(eager=True)
    return good.join(bad, name == bad["_r"], "left_anti")


def apply_segment_updates(batch: DataFrame, customers: DataFrame, segments: DataFrame,
                          user_segments: DataFrame, as_of) -> dict[str, DataFrame]:
    """Validate the batch and apply the requests whose rows all pass
    (:func:`admitted`); ``rejected`` holds the failing rows of the others.
    Returns the next ``segments`` / ``user_segments`` snapshots and the
    per-row results. The gate stays inside the plan. Outputs are built on
    first access, so asking only for ``results`` skips the id allocation of
    new rows."""
    ensure_checkpoint_dir(batch.sparkSession)
    # The validated batch feeds the gate, both upserts and the results; it is
    # written once (reliable checkpoint) so each of them reads that copy
    # instead of re-running the validation joins inside its own plan.
    checked = validate_segment_batch(batch, customers, stored_aliases(customers)).checkpoint(eager=True)
    valid = admitted(checked)
    kept = []

    def new_segments() -> DataFrame:
        if not kept:
            kept.append(segment_upsert(segments, valid))
        return kept[0]

    return LazyOutputs(
        segments=new_segments,
        user_segments=lambda: user_segment_upsert(user_segments, valid, new_segments(), as_of),
        results=lambda: user_segment_actions(user_segments, valid).select(
            "pos", F.col("customer_code").alias("customer_id"), "segment_name", "confidence", "action"),
        rejected=lambda: checked.filter(F.col("error").isNotNull()).select(
            "pos", "customer_id", "segment_name", "error"),
    )


# -- K3 / L33 ----------------------------------------------------------------------
def set_tracking(updates: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Tracking-flag updates (``seq``, ``key``, ``is_activity_tracking_enabled``).

    ``report``: one row per update with the number of customers it matched
    and a status (``invalid`` when the flag is missing, ``not_found`` when
    the key names nobody). ``customers``: the next snapshot, the last valid
    update per customer winning.
    """
    aliases = customer_aliases(customers)
    flag = F.col("is_activity_tracking_enabled")
    j = updates.join(aliases, updates["key"] == aliases["alias"], "left")
    report = j.groupBy("seq", "key", "is_activity_tracking_enabled").agg(
        F.count("resolved_id").alias("matched"))
    report = report.select(
        "seq", "key", "is_activity_tracking_enabled",
        F.when(flag.isNull(), F.lit(0).cast("bigint")).otherwise(F.col("matched")).alias("rows_affected"),
        F.when(flag.isNull(), "invalid").when(F.col("matched") == 0, "not_found").otherwise("updated").alias("status"))
    valid = j.filter(flag.isNotNull() & F.col("resolved_id").isNotNull())
    last = last_per_key(valid.select(F.col("resolved_id").alias("id"), "seq", "is_activity_tracking_enabled"),
                        ["id"], "seq", ["is_activity_tracking_enabled"]).withColumnRenamed(
                            "is_activity_tracking_enabled", "_new_flag")
    snap = customers.join(last, "id", "left")
    snap = snap.select(*[F.coalesce("_new_flag", "is_activity_tracking_enabled").alias(c)
                         if c == "is_activity_tracking_enabled" else F.col(c) for c in customers.columns])
    return {"report": report, "customers": snap}


# -- K5 ------------------------------------------------------------------------------
def _orphans(child: DataFrame, table: str, fk: str, parent: DataFrame, pk: str, parent_name: str) -> DataFrame:
    """One foreign key alone, as a row of :func:`constraint_report` (which checks all of them together)."""
    # one row per foreign key before the join, so a hot key meets it once
    c = child.groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    p = parent.select(F.col(pk).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    return c.join(p, "_k", "left").agg(
        F.lit(table).alias("table_name"), F.lit(f"fk({fk})->{parent_name}").alias("constraint_name"),
        total("_n").alias("checked_rows"),
        total(F.when(F.col("_k").isNotNull() & F.col("_hit").isNull(), F.col("_n"))).alias("violations"))


def _entry(constraint: int, key: Column, parent: bool = False) -> Column:
    return F.struct(F.lit(constraint).alias("c"), key.alias("k"), F.lit(parent).alias("p"))


def _emit(df: DataFrame, *entries: Column) -> DataFrame:
    """(constraint, key, whether the row is the parent) entries of every row; one scan of the table."""
    return df.select(F.inline(F.array(*entries)))


# Entries that one task combines before the shuffle of _report: nearly all keys differ, so its hash map holds them all
# (about 200 MB).
ENTRIES_PER_TASK = 1_000_000


def _task_rows(tables: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """(rows, most rows in one task) of every table that has rows; one job, one row per table to the driver."""
    tasks = None
    for table, df in tables.items():
        part = df.select(F.lit(table).alias("t"), F.spark_partition_id().alias("task"))
        tasks = part if tasks is None else tasks.unionByName(part)
    per_task = tasks.groupBy("t", "task").agg(F.count(F.lit(1)).alias("n"))
    return {r.t: (r.n, r.most) for r in per_task.groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}


def _dealt(df: DataFrame, columns: list[str], entries: int, n: int, most: int) -> DataFrame:
    """``df``, dealt to more tasks if one of its tasks would emit more than ``ENTRIES_PER_TASK`` entries. Only
    ``columns`` and the id are moved, before they become entries; the id spreads the rows of a hot key."""
    if most * entries <= ENTRIES_PER_TASK:
        return df
    narrow = df.select(*dict.fromkeys([c for c in ["id"] if c in df.columns] + columns))
    return narrow.repartition(-(-n * entries // ENTRIES_PER_TASK), *narrow.columns)


def _report(rows: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """Counts per (constraint, key), then per constraint. The first aggregation combines before the shuffle, so a
    hot key is one row per task; constraints without rows are reported with zeros."""
    child, parent = F.count(F.when(~F.col("p"), 1)).alias("n"), F.max("p").alias("held")
    per_key = rows.groupBy("c", "k").agg(child, parent)
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
    kinds = F.array(*[F.lit(name.split("(")[0]) for _, name in names])
    kind = F.get(kinds, F.col("c"))
    bad = (F.when(kind == "unique", F.col("k").isNotNull() & (F.col("n") > 1))
           .when(kind == "fk", F.col("k").isNotNull() & ~F.col("held"))
           .otherwise(F.coalesce(F.col("k"), F.lit("")) != "true"))
    found = per_key.select("c", "n", bad.alias("bad"))
    zeros = found.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("c"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("bad"))
    out = found.unionByName(zeros).groupBy("c").agg(total("n").alias("checked_rows"),
                                                    total(F.when(F.col("bad"), F.col("n"))).alias("violations"))
    label = lambda i: F.get(F.array(*[F.lit(x[i]) for x in names]), F.col("c"))
    return out.select(label(0).alias("table_name"), label(1).alias("constraint_name"), "checked_rows", "violations")


# (table, unique column sets, foreign keys (column, parent table), checks (name, column, condition))
CONSTRAINTS = [
    ("customers", [["id"], ["customer_id"], ["email"]], [], []),
    ("customer_profiles", [["customer_id"]], [("customer_id", "customers")], []),
    ("accounts", [["account_no"]], [("customer_id", "customers")], []),
    ("transactions", [["trx_id"]], [("account_id", "accounts")], []),
    ("user_activities", [], [("customer_id", "customers")], []),
    ("analytics_events", [], [("customer_id", "customers")], []),
    ("segments", [["name"]], [], []),
    ("user_segments", [["customer_id"]], [("customer_id", "customers"), ("segment_id", "segments")],
     [("check(0<=confidence<=1)", "confidence", "confidence >= 0 AND confidence <= 1")]),
    ("recommendations", [], [("segment_id", "segments")], []),
    ("ab_tests", [], [], []),
    ("ab_test_assignments", [["customer_id", "ab_test_id"]], [("customer_id", "customers"), ("ab_test_id", "ab_tests")], []),
]


def constraint_report(t) -> DataFrame:
    """Unique, foreign-key and CHECK constraints of the schema, one row per
    constraint with the rows checked and the rows violating it.

    Every table emits, per row, its key for each of its constraints and for each foreign key that points to it; all
    tables share the two aggregations of :func:`_report`. A table whose tasks would hold too many keys at once is dealt
    to more tasks first (:func:`_dealt`), by a count of the rows. Rows sharing a unique
    key with another row violate it (NULL keys never conflict, as in SQL); a NULL foreign key violates nothing.
    """
    names: list[tuple[str, str]] = []
    entries: dict[str, list[Column]] = {table: [] for table, *_ in CONSTRAINTS}
    used: dict[str, list[str]] = {table: [] for table, *_ in CONSTRAINTS}
    for table, unique, foreign, checks in CONSTRAINTS:
        for cols in unique:
            whole = F.lit(True)
            for c in cols:
                whole = whole & F.col(c).isNotNull()
            # the separator occurs in no id; concat_ws would skip a missing part
            key = F.when(whole, F.concat_ws("\0", *[F.col(c).cast("string") for c in cols]))
            entries[table].append(_entry(len(names), key))
            used[table] += cols
            names.append((table, f"unique({','.join(cols)})"))
        for fk, parent in foreign:
            entries[table].append(_entry(len(names), F.col(fk).cast("string")))
            entries[parent].append(_entry(len(names), F.col("id").cast("string"), parent=True))
            used[table].append(fk)
            names.append((table, f"fk({fk})->{parent}"))
        for name, column, condition in checks:
            entries[table].append(_entry(len(names), F.expr(condition).cast("string")))
            used[table].append(column)
            names.append((table, name))
    tables = {table: getattr(t, table) for table, own in entries.items() if own}
    sizes = _task_rows(tables)
    rows = None
    for table, df in tables.items():
        own = entries[table]
        part = _emit(_dealt(df, used[table], len(own), *sizes.get(table, (0, 0))), *own)
        rows = part if rows is None else rows.unionByName(part)
    return _report(rows, names)


# -- K6 ------------------------------------------------------------------------------
CASCADE_CHILDREN = [  # (table, column referencing customers.id)
    ("customer_profiles", "customer_id"),
    ("accounts", "customer_id"),
    ("user_activities", "customer_id"),
    ("analytics_events", "customer_id"),
    ("user_segments", "customer_id"),
    ("ab_test_assignments", "customer_id"),
]


def cascade_delete(t, doomed: DataFrame) -> dict[str, DataFrame]:
    """Delete the customers in ``doomed`` (column ``id``) and, as ON DELETE
    CASCADE does, their rows in every child table (transactions through their
    accounts). Returns the next snapshot of each table."""
    gone = doomed.select("id").distinct()
    out = {"customers": t.customers.join(gone, "id", "left_anti")}
    for table, fk in CASCADE_CHILDREN:
        child = getattr(t, table)
        out[table] = child.join(gone.withColumnRenamed("id", fk), fk, "left_anti")
    gone_accounts = t.accounts.join(gone.withColumnRenamed("id", "customer_id"), "customer_id", "left_semi")
    out["transactions"] = t.transactions.join(
        gone_accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti")
    return out


def cascade_summary(t, doomed: DataFrame) -> DataFrame:
    """Rows of every table before and after :func:`cascade_delete`; each table is read once."""
    gone = doomed.select("id").distinct()

    def counted(table: str, fk: str, keys: DataFrame) -> DataFrame:
        per_key = getattr(t, table).groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        hit = keys.select(F.col("id").alias("_k"), F.lit(True).alias("_gone"))
        total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
        return per_key.join(hit, "_k", "left").agg(
            F.lit(table).alias("table_name"), total("_n").alias("rows_before"),
            total(F.when(F.col("_gone"), F.col("_n"))).alias("rows_deleted"))

    out = counted("customers", "id", gone)
    for table, fk in CASCADE_CHILDREN:
        out = out.unionByName(counted(table, fk, gone))
    accounts = t.accounts.join(gone.withColumnRenamed("id", "customer_id"), "customer_id", "left_semi")
    out = out.unionByName(counted("transactions", "account_id", accounts.select("id").distinct()))
    return out.withColumn("rows_after", F.col("rows_before") - F.col("rows_deleted"))
