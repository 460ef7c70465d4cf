"""Secret scans with an incremental blob ledger.

Every version of a text is content-addressed (SHA-256). The ledger holds, per
(blob, rule version), the spans found; a scan reads only pairs that are not in
it yet, appends them, and joins the findings back to every row (path) that has
the blob. A blob with thousands of copies is scanned once.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, shared_table
from tessera.session import ensure_checkpoint_dir

# The base rules, in the order in which kinds are listed
# (name, pattern, flags, group whose length counts, least length).
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     re.IGNORECASE | re.ASCII, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
]
# What may stand between the parts of a key: white space, ends of line written as \n, quotes and marks of code.
GAP = r"""(?:[\s>#*"'+,;|]|\\[rn])*"""
LINE_END = r"""["'\s]*(?:\n|\\n|\Z)"""
# A key without END: its headers, its lines of base64, and a last, short one that stands alone.
OPEN_KEY = (r"(?:[\x20\t>]*(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*[A-Za-z][A-Za-z0-9-]*:[\x20\t](?:(?!\\n)[^\r\n])*)*"
            rf"(?:{GAP}[A-Za-z0-9+/=]{{16,}})*(?:{GAP}=?[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={LINE_END}))?")
# Well-known token shapes that the base rules miss or cut.
MORE_RULES = [
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?"
     rf"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|{OPEN_KEY})", 0, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, 1),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}", 0, 0, 1),
    ("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*:[^\s/@]{3,}@", re.IGNORECASE | re.ASCII, 0, 1),
]
RULES = BASE_RULES + MORE_RULES

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])
FOUND = T.StructType([T.StructField("blob", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])
# The unseen blobs of a run are broadcast up to so many (their addresses have 64 characters).
BROADCAST = 200_000


def rule_version(rules=RULES) -> str:
    """Changes whenever a rule does, so that blobs are scanned again then."""
    return hashlib.sha256(json.dumps([[str(x) for x in r] for r in rules]).encode()).hexdigest()[:16]


TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")


def _jwt_spans(text: str) -> list[tuple[int, int]]:
    """The matches of the jwt rule, run by run: where a run of its characters fails, every later start in it does."""
    out, at = [], text.find("eyJ")
    while at >= 0:
        part, end = [at], at
        for least, after in ((11, "."), (8, "."), (1, "")):
            run = TOKEN_RUN.match(text, end)
            end = run.end() if run else end
            if not run or end - run.start() < least or not text.startswith(after, end):
                break
            end += len(after)
            part.append(end)
        else:
            out.append((at, end))
        # the next start lies beyond the run that failed, or beyond the match
        skip = end if len(part) == 4 else TOKEN_RUN.match(text, at).end()
        at = text.find("eyJ", skip)
    return out


def find_spans(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` in code points, by start, then by rule order.
    Leftmost matches that do not overlap are taken per kind, and those
    whose group is too short are dropped afterwards."""
    out = []
    for k, (kind, pattern, flags, group, least) in enumerate(rules):
        if (kind, pattern) == MORE_RULES[1][:2]:
            out += [(start, k, kind, end) for start, end in _jwt_spans(text)]
            continue
        if (kind, pattern) == ("hex", BASE_RULES[2][1]):
            pattern, least = f"[0-9a-f]{{{least},}}", 0  # whole runs, so the short ones need no match
        for m in re.finditer(pattern, text, flags):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def scan(docs: DataFrame, ledger: str | None = None, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``blob`` (SHA-256 of the text) and ``spans``.

    ``ledger`` is the folder of a ledger kept over runs (made when absent; null:
    a fresh one in the shared checkpoint folder), with a folder of its own per rule version.
    Only (blob, rule version) pairs that it lacks are scanned, and their findings,
    none included, are appended. Runs on one ledger follow each other; a run that is repeated
    after a failure may append a pair again, which changes no result.

    A null text counts as empty; an empty text has no spans; repeated rows are
    all returned; an empty table gives no rows. Columns of ``docs`` named like
    a result column are replaced in it.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    own = f"{ledger}/rules={rule_version(rules)}"
    docs = docs.drop("blob", "spans")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = docs.withColumn("blob", F.sha2(body, 256))
    content = addressed.select("blob", body.alias("body"))

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        seen = spark.read.schema(FOUND).parquet(own).select("blob")
        # no text moves to find the unseen blobs, nor to pick their texts where they are few
        unseen = shared_table(content.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
        if unseen.count() <= BROADCAST:
            todo = content.join(F.broadcast(unseen), "blob", "left_semi").dropDuplicates(["blob"])
        else:
            todo = content.dropDuplicates(["blob"]).join(unseen, "blob", "left_semi")
    else:
        todo = content.dropDuplicates(["blob"])

    def rows(blob, content):
        yield blob, [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(content, rules)]

    map_batches(todo, rows, FOUND).write.mode("append").parquet(own)
    found = spark.read.schema(FOUND).parquet(own).filter(F.size("spans") > 0).dropDuplicates(["blob"])
    found = shared_table(found, "findings")
    none = F.array().cast(T.ArrayType(SPAN))
    return addressed.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def cut_spans(text: str, spans) -> str:
    """``text`` with ``[kind]`` for each of the ``spans`` (by start); one that begins inside those before it adds no mark."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _cut_texts(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return texts.combine(spans, lambda t, s: None if t is None else cut_spans(t, s))


def redact(docs: DataFrame, ledger: str | None = None, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[kind]``; spans that
    overlap become one. ``n_chars``, where it is a column, is counted again for
    changed texts. Clean rows stay as they are; no row goes."""
    cols = docs.columns
    found = scan(docs, ledger, text, rules)
    changed = F.size("spans") > 0
    cut = F.pandas_udf(_cut_texts, "string")(F.when(changed, F.col(text)), F.col("spans"))
    new = F.when(changed, cut).otherwise(F.col(text))
    out = [F.when(changed, F.length("__new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
           if c == "n_chars" else F.col("__new").alias(c) if c == text else F.col(f"`{c}`") for c in cols]
    return found.withColumn("__new", new).select(*out)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per row of :func:`scan`: counts of the base kinds, ``base_sha256`` and ``spans`` as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r[0] for r in BASE_RULES]
    counts = [count(kind) for kind in base]
    return found.select(doc_id, *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256)
                        .alias("base_sha256"), joined(F.col("spans")).alias("spans"))
