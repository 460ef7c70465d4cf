"""Validated ingestion: analytics events and customer registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.functions.joins import spread_key, stored_aliases, unique_aliases
from tessera.operators.merge import max_id, sequence_ids


def validate_events(raw: DataFrame, customers: DataFrame, principal_role: str = "admin",
                    principal_code: str | None = None, respect_tracking: bool = False,
                    aliases: DataFrame | None = None) -> DataFrame:
    """Check raw events (``raw_id``, ``customer_id`` key, ``event_type``,
    ``feature``, ``metadata`` text, ``received_at``); the first failing rule
    wins: event_type required, feature required, actor allowed, customer
    exists, metadata valid JSON. A missing key means the principal itself;
    missing metadata means ``{}``. Adds the resolved ``cid`` /
    ``customer_code``, the stored ``metadata`` text and ``error``.

    The reference stores the tracking flag but never checks it at ingest;
    ``respect_tracking=True`` additionally rejects events of customers who
    turned tracking off.

    ``aliases`` may pass a prepared :func:`unique_aliases` table (e.g. one
    checkpointed when a stream starts), so a stream-static join does not
    rebuild the index in every micro-batch.
    """
    own = F.coalesce(F.col("customer_id"), F.lit("")) == ""
    r = raw.withColumn("_own", own).withColumn(
        "_key", F.when(own, F.lit(principal_code)).otherwise(F.col("customer_id")))
    aliases = aliases if aliases is not None else unique_aliases(customers)
    if respect_tracking:
        flags = customers.select(F.col("id").alias("resolved_id"),
                                 F.coalesce("is_activity_tracking_enabled", F.lit(True)).alias("_tracking"))
        aliases = aliases.join(flags, "resolved_id", "left")
    else:
        aliases = aliases.withColumn("_tracking", F.lit(True))
    j = r.join(aliases, spread_key(r["customer_id"], r["raw_id"]) == aliases["alias"], "left")
    # rows without a key all mean the principal: one row, looked up once
    me = aliases.filter(F.col("alias") == F.lit(principal_code)).agg(
        F.first(F.struct("resolved_id", "resolved_customer_id", "_tracking")))
    for c in ("resolved_id", "resolved_customer_id", "_tracking"):
        j = j.withColumn(c, F.when(F.col("_own"), me.scalar()[c]).otherwise(F.col(c)))
    meta = F.when(F.coalesce(F.col("metadata"), F.lit("")) == "", F.lit("{}")).otherwise(F.col("metadata"))
    forbidden = F.lit(principal_role != "admin") & (F.coalesce(F.col("_key"), F.lit("")) != F.lit(principal_code or ""))
    error = (F.when(~X.non_empty("event_type"), "event_type is required")
             .when(~X.non_empty("feature"), "feature is required")
             .when(forbidden, "forbidden")
             .when(F.col("resolved_id").isNull(), "user not found")
             .when(~X.valid_json(meta), "metadata must be valid JSON")
             .when(~F.coalesce(F.col("_tracking"), F.lit(True)), "activity tracking disabled"))
    return j.select("raw_id", "customer_id", "event_type", "feature", meta.alias("metadata"), "received_at",
                    F.col("resolved_id").alias("cid"), F.col("resolved_customer_id").alias("customer_code"),
                    error.alias("error"))


def ingest_events(raw: DataFrame, customers: DataFrame, existing_events: DataFrame,
                  principal_role: str = "admin", principal_code: str | None = None,
                  respect_tracking: bool = False) -> dict[str, DataFrame]:
    """Validate, then give accepted events ids after the current maximum, in
    arrival order (``received_at``, ``raw_id``). ``created_at`` is the
    arrival time. Returns ``accepted`` rows in the ``analytics_events``
    shape and ``rejected`` rows with their error (dead letters)."""
    # written once: the numbering and both outputs read that copy
    checked = validate_events(raw, customers, principal_role, principal_code, respect_tracking,
                              stored_aliases(customers)).checkpoint(eager=True)
    ok = checked.filter(F.col("error").isNull())
    numbered = sequence_ids(ok, ["received_at", "raw_id"], max_id(existing_events), "id")
    accepted = numbered.select("id", F.col("cid").alias("customer_id"), "event_type", "feature", "metadata",
                               F.col("received_at").alias("created_at"))
    rejected = checked.filter(F.col("error").isNotNull()).select(
        "raw_id", "customer_id", "event_type", "feature", "received_at", "error")
    return {"accepted": accepted, "rejected": rejected}


def validate_registrations(regs: DataFrame, customers: DataFrame) -> DataFrame:
    """Registration rows (``pos``, ``full_name``, ``username``, ``email``):
    missing fields become empty texts; the email must not exist yet, neither
    among customers nor earlier in the batch (the unique constraint the
    insert would hit, also for an empty email)."""
    filled = regs.select("pos", *[F.coalesce(c, F.lit("")).alias(c) for c in ("full_name", "username", "email")])
    # first position per email, so that repeats of one email join the customers once
    first = filled.groupBy("email").agg(F.min("pos").alias("pos"))
    free = first.join(customers.select("email"), "email", "left_anti").select("pos", F.lit(True).alias("_free"))
    j = filled.join(free, "pos", "left")
    error = F.when(F.col("_free").isNull(), TAKEN)
    return j.select("pos", "full_name", "username", "email", error.alias("error"))


def onboard_customers(regs: DataFrame, customers: DataFrame, as_of) -> dict[str, DataFrame]:
    """Register the accounts of one request in input order: ids continue the
    customers sequence, ``customer_id`` is ``CUS-%06d``, role is always
    ``customer``, tracking on. One customers row and one profile row per
    account. Any invalid row rejects the whole request (the gate is a scalar
    subquery); a request without accounts is rejected with one row.

    With a column ``request`` (in the order of arrival) ``regs`` holds several requests: see :func:`onboard_requests`."""
    if "request" in regs.columns:
        return onboard_requests(regs, customers, as_of)
    checked = validate_registrations(regs, customers)
    none = checked.groupBy().agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 0).select(
        *[F.lit(None).cast(checked.schema[c].dataType).alias(c) for c in checked.columns[:-1]],
        F.lit(NO_ACCOUNT).alias("error"))
    failed = checked.filter(F.col("error").isNotNull())
    rejected = failed.unionByName(none)
    ok = F.coalesce(failed.agg(F.count(F.lit(1))).scalar(), F.lit(0)) == 0
    valid = checked.filter(F.col("error").isNull() & ok)
    return {**_registered(valid, ["pos"], customers, as_of), "rejected": rejected}


NO_ACCOUNT, TAKEN = "at least one account is required", "email already registered"


def _registered(valid: DataFrame, order: list[str], customers: DataFrame, as_of) -> dict[str, DataFrame]:
    """The customers and profiles rows of admitted accounts, numbered in ``order``."""
    numbered = sequence_ids(valid, order, max_id(customers), "id")
    now = X.ntz(as_of)
    new_customers = numbered.select(
        "id", X.customer_code("id").alias("customer_id"), "username", "email",
        F.lit("customer").alias("role"), F.lit(True).alias("is_activity_tracking_enabled"), now.alias("created_at"))
    new_profiles = numbered.select(F.col("id").alias("customer_id"), "full_name", now.alias("created_at"))
    registered = new_customers.select("id", "customer_id", "email", "role")
    return {"registered": registered, "customers": new_customers, "profiles": new_profiles}


def onboard_requests(regs: DataFrame, customers: DataFrame, as_of) -> dict[str, DataFrame]:
    """Register the accounts of several requests, as if they came one after the other in the order of ``request``.

    ``regs``: ``request``, ``pos`` (unique in a request; null in the one row of a request without accounts),
    ``full_name``, ``username``, ``email``. A request is admitted whole or not at all; its emails are taken for later
    ones only if it is admitted itself. Returns ``registered``, ``customers`` and ``profiles`` of the admitted
    accounts, numbered by (request, pos), and the failing rows of the others as ``rejected``.
    """
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("full_name", "username", "email")]
    rows = regs.select("request", "pos", *text).checkpoint(eager=True)
    # what fails whatever the other requests do: no account, an email twice in the request, an email in use
    own = rows.filter("pos IS NOT NULL").groupBy("request", "email").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    own = own.join(customers.select("email", F.lit(True).alias("used")).distinct(), "email", "left").checkpoint(eager=True)
    bad = own.filter("used OR first < last").select("request").unionByName(rows.filter("pos IS NULL").select("request"))
    open_emails = own.select("request", "email").join(bad.distinct().checkpoint(eager=True), "request", "left_anti")
    admitted = admit_in_order(open_emails).checkpoint(eager=True)
    valid = rows.join(admitted, "request", "left_semi")
    return {**_registered(valid, ["request", "pos"], customers, as_of),
            "rejected": _refused(rows, own, admitted)}


def _refused(rows: DataFrame, own: DataFrame, admitted: DataFrame) -> DataFrame:
    """The failing rows of the requests that were not admitted: those whose email is in use, comes earlier in the
    request, or belongs to an earlier admitted request; and requests without accounts."""
    others = rows.join(admitted, "request", "left_anti")
    # one row per email: at most one admitted request holds it
    holder = own.join(admitted, "request", "left_semi").select("email", F.col("request").alias("holder"))
    clash = own.join(holder.checkpoint(eager=True), "email", "left").join(admitted, "request", "left_anti").select(
        F.col("request").alias("_r"), F.col("email").alias("_e"), F.col("first").alias("_first"),
        F.coalesce("used", F.lit(False)).alias("_used"), (F.col("holder") < F.col("request")).alias("_held"))
    j = others.join(clash, others["request"].eqNullSafe(clash["_r"]) & (others["email"] == clash["_e"]), "left")
    error = (F.when(F.col("pos").isNull(), NO_ACCOUNT)
             .when(F.col("_used") | F.coalesce("_held", F.lit(False)) | (F.col("pos") > F.col("_first")), TAKEN))
    return j.select("request", "pos", "full_name", "username", "email", error.alias("error")).filter("error IS NOT NULL")


def admit_in_order(emails: DataFrame) -> DataFrame:
    """``request`` of the requests (``request``, ``email``; distinct rows) that are admitted one after the other: each
    whose emails no earlier admitted one holds.

    Requests that share no email are admitted at once. Of the others, every round admits those that come first for
    all their emails among the ones still open, and refuses those that share an email with them; the rest go on. The
    rounds follow the longest chain of clashes, their work only the open ones. The first request of an email is kept in a
    stored table, so that an email held by very many requests can be split in the join.
    """
    firsts = emails.groupBy("email").agg(F.min("request").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = emails.join(firsts.filter("n > 1").select("email").checkpoint(eager=True), "email", "left_semi")
    clashing = shared.select("request").distinct().checkpoint(eager=True)
    out = emails.select("request").distinct().join(clashing, "request", "left_anti")
    # emails that only one request holds decide nothing
    left = shared.checkpoint(eager=True)
    while not left.isEmpty():
        firsts = left.groupBy("email").agg(F.min("request").alias("first")).checkpoint(eager=True)
        ahead = left.join(firsts, "email")
        won = ahead.groupBy("request").agg(F.bool_and(F.col("request") == F.col("first")).alias("won")).filter("won") \
                   .select("request").checkpoint(eager=True)
        # a winner is first for every email it holds
        taken = firsts.join(won.withColumnRenamed("request", "first"), "first", "left_semi").select("email").checkpoint(eager=True)
        decided = left.join(taken, "email", "left_semi").select("request").distinct().checkpoint(eager=True)
        out = out.unionByName(won)
        left = left.join(decided, "request", "left_anti").checkpoint(eager=True)
    return out


DEFAULT_PRINCIPAL = "CUS-000049"  # an admin of the fixture tables


def raw_event_feed(events: DataFrame) -> DataFrame:
    """Raw event submissions derived from the input ``events`` table: keys as
    internal id text, public id, empty (the principal) or unknown; missing
    event types for errors; metadata sometimes missing, literal ``null``, a
    plain text, with a repeated key, followed by text, or broken JSON."""
    eid = F.col("id")
    key = (F.when(eid % 13 == 0, F.concat(F.lit("CUS-X"), F.col("customer_id").cast("string")))
           .when(eid % 5 == 0, F.col("customer_id").cast("string"))
           .when(eid % 5 == 1, F.lit(""))
           .otherwise(X.customer_code("customer_id")))
    etype = F.when((F.col("event_type") == "recommendation_generated") & (eid % 4 == 0), F.lit(None).cast("string")) \
             .otherwise(F.col("event_type"))
    meta = (F.when(eid % 17 == 0, F.lit("{broken"))
            .when(eid % 29 == 0, F.lit('{"a": 1, "a": 2}'))
            .when(eid % 31 == 0, F.lit("{} x"))
            .when(eid % 37 == 0, F.lit('"text"'))
            .when(eid % 41 == 0, F.lit("1],[2"))
            .when(eid % 43 == 0, F.lit("{'a': 1}"))
            .when(eid % 19 == 0, F.lit(None).cast("string"))
            .when(eid % 23 == 0, F.lit("null"))
            .otherwise(F.col("metadata")))
    return events.select(eid.alias("raw_id"), key.alias("customer_id"), etype.alias("event_type"), "feature",
                         meta.alias("metadata"), F.col("created_at").alias("received_at"))
