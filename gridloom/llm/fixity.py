"""Merkle fixity audit of WARC replicas.

A page is a WARC resource record; records stand in archives one after another, and the manifest of
the archive gives each record's offset. An archive's tree has a leaf per range of `range_bytes` of
manifest offsets (the digest of the records that start in it, in order of offset) and above it nodes
over `fan` children each, up to one root. Two replicas are compared from the roots down: only the
children of nodes that differ are compared, and only records in differing ranges are compared one by
one. A record that is altered or missing therefore is located by its offset range, and an archive
that is whole is settled by its root.

On Spark every level is a stored table of (archive, node, digest); a level is grouped from the one
below with at most `fan` rows a group, and descending is an equi-join with the differing parents.
Bytes are hashed once, where they are read.

Defined results: a null html is an empty payload, a null url an empty target; a page without page_id
stands in archive -1 - k by a hash of its content; records of equal page_id (repeated rows) are
ordered by digest; empty tables give no damage; a record found only in the second replica is `extra`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.workspace import stored

PER_ARCHIVE, RANGE_BYTES, FAN = 1000, 64 << 10, 8
UNNAMED_ARCHIVES = 1000


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The record's bytes: header fields, an empty line, payload, two line ends."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    return F.concat(head, body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """archive, page_id, length, digest of each record; the bytes are read once and not kept."""
    made = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("bytes"))
    unnamed = -1 - F.pmod(F.xxhash64("bytes"), F.lit(UNNAMED_ARCHIVES))
    return made.select(
        F.coalesce(F.floor(F.col("page_id") / per_archive), unnamed).alias("archive"),
        "page_id",
        F.octet_length("bytes").cast("long").alias("length"),
        F.sha2("bytes", 256).alias("digest"),
    )


def manifest(rows: DataFrame) -> DataFrame:
    """Adds nth (among records of equal page_id) and the record's offset in its archive."""
    same = Window.partitionBy("archive", "page_id").orderBy("digest")
    before = Window.partitionBy("archive").orderBy("page_id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("nth", F.row_number().over(same)).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def leaves(rows: DataFrame, range_bytes: int) -> DataFrame:
    """archive, node, digest per offset range; a range holds a bounded number of records."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "digest")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["offset"], x["length"], x["digest"])), ",")
    return rows.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("node")).agg(F.sha2(text, 256).alias("digest"))


def parents(level: DataFrame, fan: int) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("node", "digest")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["node"], x["digest"])), ",")
    return level.groupBy("archive", F.floor(F.col("node") / fan).alias("node")).agg(F.sha2(text, 256).alias("digest"))


def tree(rows: DataFrame, heights: int, range_bytes: int, fan: int) -> list[DataFrame]:
    """The levels from the leaves up; the last has one node per archive."""
    levels = [stored(leaves(rows, range_bytes), "leaves")]
    for _ in range(heights):
        levels.append(stored(parents(levels[-1], fan), "nodes"))
    return levels


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(archive, node) whose digests differ or that one side lacks."""
    joined = ours.select("archive", "node", F.col("digest").alias("a")).join(
        theirs.select("archive", "node", F.col("digest").alias("b")), ["archive", "node"], "full"
    )
    return joined.where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "node")


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Damage: archive, page_id, offset, length, kind (altered, missing, extra).

    `first` and `second` have archive, page_id, nth, offset, length, digest; offsets are the manifest's,
    so a replica that lost a record still has the others where they were.
    """
    longest = max(x.agg(F.max("offset")).first()[0] or 0 for x in (first, second)) // range_bytes + 1
    heights = 0
    while fan**heights < longest:
        heights += 1
    ours, theirs = (tree(x, heights, range_bytes, fan) for x in (first, second))
    bad = differing(ours[heights], theirs[heights])
    for height in range(heights - 1, -1, -1):
        suspects = bad.withColumnRenamed("node", "parent")
        below = [
            level[height].withColumn("parent", F.floor(F.col("node") / fan)).join(suspects, ["archive", "parent"], "left_semi")
            for level in (ours, theirs)
        ]
        bad = stored(differing(*below), "differing")
    inside = [
        x.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["archive", "node"], "left_semi") for x in (first, second)
    ]
    a = inside[0].select("archive", "offset", F.col("page_id").alias("page_a"), F.col("length").alias("length_a"), F.col("digest").alias("a"))
    b = inside[1].select("archive", "offset", F.col("page_id").alias("page_b"), F.col("length").alias("length_b"), F.col("digest").alias("b"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    return (
        a.join(b, ["archive", "offset"], "full")
        .where(~F.col("a").eqNullSafe(F.col("b")))
        .select(
            "archive",
            F.coalesce("page_a", "page_b").alias("page_id"),
            "offset",
            F.coalesce("length_a", "length_b").alias("length"),
            kind.alias("kind"),
        )
    )
