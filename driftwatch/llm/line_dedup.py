"""Line dedup over levelled sorted runs.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z
lower-cased; keys of at least ``min_chars`` code points count. A key belongs to
the smallest ``doc_id`` that holds it; all other documents lose their lines of
that key, if at least two documents hold it.

Batches come in ascending order of ``doc_id``. The runs hold one row for each
key seen so far, with its owner. A new batch reduces its lines to one row for a
key (pre-aggregated before the shuffle, so a line that every document holds is a
few rows), is dealt out by key once, merge-anti-joins the runs one after the other and adds what is left as a run of level 0. Once a
level holds ``fan_in`` runs they are merged to one run of the next level, so
a batch joins only about ``log(batches)`` runs. Runs are tables bucketed and sorted by key, so they are never
dealt out again, neither for a join nor for a merge. A key is its 128-bit digest.

What a document keeps are the run rows that it owns, so no join has a hot key:
documents and runs meet by ``doc_id``.

Buckets and batches follow the bytes of the texts: a bucket holds the keys of about 2 GiB of text, some hundreds of MB before equal lines are one, and a
batch at most 4 TiB. Smaller inputs have as many buckets as the session has shuffle partitions, and four batches. The number of either changes no result.
Spark takes 100,000 buckets unless ``spark.sql.sources.bucketing.maxBuckets`` is raised, so beyond some 200 TB raise it.

Nulls and empty texts are one empty line. A null ``doc_id`` owns nothing and
loses nothing. Rows of equal ``doc_id`` are one document. Ties can't arise, as
the smallest ``doc_id`` is unique. Extra columns pass through; ``n_lines`` and
``n_dropped`` replace columns of these names. An empty table stays empty.
"""

from __future__ import annotations

import functools
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.session import fresh_path, remove

WHITE = b" \t\n\x0b\x0c\r"
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RUN = "key binary, owner long"
#: Bytes of text whose keys one bucket takes, and bytes of text in a batch.
BUCKET_BYTES, BATCH_BYTES = 2 << 30, 4 << 40


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key; None for a key of under ``min_chars`` code points. Lines are UTF-8, 1 to 4 bytes a code point."""
    key = line.strip(WHITE).translate(LOWERED)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return md5(key).digest()


def line_digests(text: Column, min_chars: int) -> Column:
    """The distinct digests of a text's keys."""

    @F.arrow_udf("array<binary>")
    def digests(texts: pa.Array) -> pa.Array:
        lines = ((x or "").encode().split(b"\n") for x in texts.to_pylist())
        return pa.array([list({line_digest(x, min_chars) for x in own} - {None}) for own in lines], pa.list_(pa.binary()))

    return digests(text)


class LineRuns:
    """Levels of runs of ``(key, owner)``: tables of ``buckets`` buckets by key, sorted within, each of keys that no other run holds.

    The files lie in the shared folder; their names are in the session's catalog until ``close``. What was merged is deleted at once, so
    a DataFrame of ``rows`` holds until the next batch is added.
    """

    def __init__(self, spark, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        """The names of all runs' tables, the largest first."""
        return [name for level in reversed(self.levels) for name in level]

    def rows(self) -> DataFrame:
        """All rows of all runs, read from their files, so also after ``close``."""
        paths = [self.paths[name] for name in self.runs()]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def close(self) -> None:
        """Takes the runs' names out of the catalog; the files stay. Nothing can be added afterwards."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"line-run-{level}")
        name = "line_run_" + path.rpartition("-")[2]
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.paths[name] = path

    def add(self, batch: DataFrame) -> None:
        """Adds the keys of ``batch`` (one row each: key, owner) that no run holds."""
        batch = batch.select("key", "owner")
        if not any(self.levels):
            batch = batch.repartition(self.buckets, "key")
        for run in self.runs():
            batch = batch.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            level += 1
            self._write(functools.reduce(self._merged, map(self.spark.table, full)), level)
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")
                remove(self.spark, self.paths.pop(name))

    @staticmethod
    def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
        """Both runs; they have no key in common."""
        two = two.select(F.col("key").alias("_key"), F.col("owner").alias("_owner")).hint("merge")
        both = one.join(two, F.col("key") == F.col("_key"), "full_outer")
        return both.select(F.coalesce("key", "_key").alias("key"), F.coalesce("owner", "_owner").alias("owner"))


def sizes(docs: DataFrame, text: str = "text", buckets: int = 1, batches: int = 4) -> tuple[int, int]:
    """Buckets and batches for the bytes of all texts, at least as many as given."""
    n_bytes = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(buckets, -(-n_bytes // BUCKET_BYTES)), max(batches, -(-n_bytes // BATCH_BYTES))


def add_documents(
    runs: LineRuns, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4
) -> LineRuns:
    """Adds the lines of ``docs``, whose ids lie above all earlier ones, in ``batches`` batches of about equal size.

    The bounds of batches are quantiles of the ids; they decide what is done when, not the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("owner"), F.col(text).alias("text"))
    shares = [i / batches for i in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx("owner", shares, 1000)).first()[0] if shares else None) or []
    batch = sum((F.when(F.col("owner") > bound, 1).otherwise(0) for bound in sorted({*bounds})), F.lit(0))
    path = fresh_path(spark, "line-batches")
    (
        docs.where(F.col("owner").isNotNull())
        .select("owner", batch.alias("batch"), line_digests(F.col("text"), min_chars).alias("keys"))
        .select("owner", "batch", F.explode("keys").alias("key"))
        .groupBy("batch", "key")
        .agg(F.min("owner").alias("owner"))
        .write.partitionBy("batch").parquet(path)
    )
    lines = spark.read.schema(f"{RUN}, batch int").parquet(path)
    for i in range(len({*bounds}) + 1):
        runs.add(lines.where(F.col("batch") == i).drop("batch"))
    remove(spark, path)
    return runs


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fan_in: int = 2,
) -> DataFrame:
    """``docs`` with the lines that an earlier document owns cut from ``text``, with ``n_lines`` and ``n_dropped``. ``batches`` is the least number of batches."""
    spark = docs.sparkSession
    buckets, batches = sizes(docs, text, int(spark.conf.get("spark.sql.shuffle.partitions")), batches)
    runs = add_documents(LineRuns(spark, fan_in, buckets), docs, doc_id, text, min_chars, batches)
    runs.close()
    owned = runs.rows().groupBy(F.col("owner").alias("_owner")).agg(F.collect_list("key").alias("_keys"))
    names = ["_kept", "n_lines", "n_dropped"]

    @F.arrow_udf("_kept string, n_lines long, n_dropped long")
    def kept(ids: pa.Array, texts: pa.Array, keys: pa.Array) -> pa.Array:
        out: list[tuple[str, int, int]] = []
        for owner, value, own in zip(ids, texts.to_pylist(), keys.to_pylist(), strict=True):
            lines, have = (value or "").encode().split(b"\n"), {None, *(own or ())}
            keep = [x for x in lines if line_digest(x, min_chars) in have] if owner.is_valid else lines
            out.append((b"\n".join(keep).decode(), len(lines), len(lines) - len(keep)))
        columns = zip(*out, strict=True) if out else ((), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    joined = docs.join(owned, F.col(doc_id) == F.col("_owner"), "left")
    out = joined.withColumn("_done", kept(F.col(doc_id), F.col(text), F.col("_keys")))
    out = out.withColumns({text: F.col("_done._kept"), "n_lines": F.col("_done.n_lines"), "n_dropped": F.col("_done.n_dropped")})
    return out.drop("_owner", "_keys", "_done")
