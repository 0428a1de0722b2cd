"""Operator 8: secret scan with multipart credential linking (DataFrame functions only).

Strong parts are found by three base patterns: ``assign`` (a named secret
given a value of 8 or more characters), ``access`` (an access key id) and
``hex`` (a run of 32 or more lower-case hex digits).  Weak parts say little
alone: ``ident`` (a user or client name given a value), ``weak`` (a named
secret with a short value, or a bearer token) and ``endpoint`` (an URL).

A weak part is reported only when a complementary part stands in its scope,
at most ``reach`` code points away in the same document:

* ``ident`` and ``endpoint`` need a secret (assign, hex or weak);
* ``weak`` needs an identifier (access, ident) or an endpoint.

This is an interval semi-join that gives the nearest partner as the link.  It
is done by running over a document's parts in order and keeping the last end
and next start of each class, so its cost is that of a sort and no pairs
arise.  Positions are code points, ends exclusive.
Texts are read once, on the map side; only positions are shuffled, by row.

Defined results: null text is empty; rows that repeat are reported once each;
null ids stay null; texts without parts have empty arrays; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the contract: kinds in the order in which they are listed, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

IDENT = r"""(?i)\b(user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
BEARER = r"""(?i)\b(bearer)\x20+([A-Za-z0-9+/_.=~-]{8,})"""
ENDPOINT = r"""\b(https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb)://([^\s"'<>]+)"""

KINDS = ["assign", "access", "hex", "endpoint", "ident", "weak"]


def _parts(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Matches as (kind, i, gap before, length, length of the group); one cheap test spares most texts the rest."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.transform(
        F.arrays_zip(found.alias("m"), inner.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("inner")
        ),
    )
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,inner:int>>"))


def scan_secrets(docs: DataFrame, reach: int = 256) -> DataFrame:
    """One row per document: doc_id, base and linked spans and links (span, partner), in order of start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(
        _parts(text, "assign", ASSIGN, 2),
        _parts(text, "access", ACCESS, 0),
        _parts(text, "hex", HEX, 0),
        _parts(text, "endpoint", ENDPOINT, 2),
        _parts(text, "ident", IDENT, 2),
        _parts(text, "bearer", BEARER, 2),
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts.alias("parts"))
    flat = rows.select("row", "doc_id", F.explode_outer("parts").alias("p")).select("row", "doc_id", "p.*").repartition("row")
    by_kind = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(by_kind)
    kind = (
        F.when((F.col("kind") == "assign") & (F.col("inner") < LEAST_ASSIGN), "weak")
        .when((F.col("kind") == "access") & (F.col("inner") < LEAST_ACCESS), None)
        .when(F.col("kind") == "bearer", "weak")
        .otherwise(F.col("kind"))
    )
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("kind", kind)
    order = W.partitionBy("row").orderBy("start", "end", "kind")
    back = W.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), back.rowsBetween(W.unboundedPreceding, -1)

    def nearest(*kinds: str) -> Column:
        """The nearest part of these kinds within reach; the one before if both are as near."""
        of = F.col("kind").isin(*kinds)
        last = F.max(F.when(of, F.struct("end", "start", "kind"))).over(before)
        first = F.min(F.when(of, F.struct("start", "end", "kind"))).over(after)
        back, ahead = F.col("start") - last["end"], first["start"] - F.col("end")
        as_link = [F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")) for x in (last, first)]
        is_back = (back <= reach) & (ahead.isNull() | (back <= ahead))
        return F.when(is_back, as_link[0]).when(ahead <= reach, as_link[1])

    secret, other = nearest("assign", "hex", "weak"), nearest("access", "ident", "endpoint")
    partner = F.when(F.col("kind").isin("ident", "endpoint"), secret).when(F.col("kind") == "weak", other)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"))
    shown = placed.withColumn("partner", partner).select(
        "row", "doc_id", F.when(rank <= 3, span).alias("base"),
        F.when(F.col("partner").isNotNull(), span).alias("linked"), F.when(F.col("partner").isNotNull(), F.struct(span.alias("span"), "partner")).alias("link"),
    )
    listed = [F.sort_array(F.collect_list(c)).alias(n) for c, n in (("base", "base"), ("linked", "linked"), ("link", "links"))]
    return shown.groupBy("row", "doc_id").agg(*listed).drop("row")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans and links as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    def shown(x: Column) -> Column:
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, shown))

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "linked"))).alias("spans"),
        F.concat_ws(",", F.transform("links", lambda x: F.concat(shown(x["span"]), F.lit(">"), shown(x["partner"])))).alias("links"),
    )
