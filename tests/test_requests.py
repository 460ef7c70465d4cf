"""Sign-up requests that depend on each other."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import ingest as I

AS_OF = "2024-01-31 00:00:00"
SCHEMA = "request long, pos long, full_name string, username string, email string"


def one_by_one(rows, used):
    """The requests in their order, each against what the ones before have left."""
    used, out, bad = set(used), [], []
    for r in sorted({x[0] for x in rows}):
        own = sorted((x for x in rows if x[0] == r), key=lambda x: (x[1] is None, x[1] or 0))
        errors, seen = [], set()
        for _, pos, *_, email in own:
            if pos is None:
                errors.append((r, None, I.NO_ACCOUNT))
                continue
            if (email or "") in used or (email or "") in seen:
                errors.append((r, pos, I.TAKEN))
            seen.add(email or "")
        bad += errors
        if not errors:
            used |= seen
            out += [(r, x[1], x[4] or "") for x in own]
    return out, bad


def check(spark, t, rows):
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = I.onboard_customers(d, t.customers, AS_OF)
    want, bad = one_by_one(rows, {r.email for r in t.customers.collect()})
    top = t.customers.agg(F.max("id")).first()[0]
    assert [(r.id, r.email) for r in got["registered"].orderBy("id").collect()] == [
        (top + k, e) for k, (_, _, e) in enumerate(want, 1)]
    assert got["profiles"].count() == len(want)
    key = lambda x: (x[0], x[1] is None, x[1] or 0)
    assert sorted(((r.request, r.pos, r.error) for r in got["rejected"].collect()), key=key) == sorted(bad, key=key)


def test_chain_of_three_and_edges(spark, t001):
    used = t001.customers.first().email
    check(spark, t001, [
        (1, 1, "a", "a", "x"), (2, 1, "b", "b", "x"), (2, 2, "b", "b", "y"), (3, 1, "c", "c", "y"),  # the third is free again
        (4, 1, "d", None, "z"), (4, 2, "d", "d", "z"), (5, 1, "e", "e", "z"),  # a request that fails by itself blocks nobody
        (6, 1, "f", "f", used), (6, 2, "f", "f", "w"), (7, 1, "g", "g", "w"), (8, None, None, None, None),
        (9, 1, None, None, None), (10, 1, "h", "h", ""), (11, 1, "i", "i", "w"), (11, 2, "i", "i", "v"), (12, 1, "j", "j", "v")])


def test_random_requests(spark, t001):
    rng = random.Random(4)
    check(spark, t001, [(r, p, "n", "u", f"m{rng.randrange(12 if r % 2 else 60)}") for r in range(40)
                        for p in range(rng.randrange(1, 4))])


def test_an_email_of_many_requests(spark):
    d = spark.range(3000).select(F.col("id").alias("request"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("m"), F.col("id") % 7)).alias("email"))
    assert sorted(r.request for r in I.admit_in_order(d).collect()) == sorted(
        {0} | {min(i for i in range(3000) if i % 3 and i % 7 == k) for k in range(7)})
