"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

Documents come in batches. A run is a table of line keys with the number of documents and the
largest document that hold each, bucketed and sorted by key. Each new batch merge-anti-joins the
runs: a key is settled, and goes no further, where a run already counts enough documents for it and
a document no smaller than the batch's. The keys left become the batch's own run. Batches go from
the largest documents down, so a widespread line settles in the first ones. Runs of a level are
compacted into one of the next when `fanout` of them have gathered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoweave.session import delete_folder, materialize, release, scratch_dir, tidy_shuffles

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Levelled runs of line keys. A document belongs to one batch only; batches may come in any order.

    n_docs of a key is exact below `enough` and a lower bound of at least `enough` from there on,
    as settled keys are counted no further; max_doc is always exact.
    """

    def __init__(self, spark: SparkSession, enough: int = 3, fanout: int = 2):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _written(self, run: DataFrame) -> str:
        """A table of a file for each bucket, sorted: joins with it by key deal and sort the other side only."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = run.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet")
        with tidy_shuffles(self.spark):
            rows.option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._written(run))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete_folder(self.spark, f"{scratch_dir(self.spark)}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """A merge join of sorted runs, bucket by bucket. (A union of bucketed tables is not dealt by bucket.)"""
        out = self.spark.table(names[0])
        for name in names[1:]:
            run = self.spark.table(name).select(*[F.col(c).alias(f"_{c}") for c in ("h", "n_docs", "max_doc")])
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n_docs", F.lit(0))
            out = out.join(run.hint("merge"), F.col("h") == F.col("_h"), "full").select(
                F.coalesce("h", "_h").alias("h"), n_docs.cast("bigint").alias("n_docs"), F.greatest("max_doc", "_max_doc").alias("max_doc")
            )
        return out

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """Rows (h, n_docs, max_doc) that could still change what the runs say of their key."""
        for name in (n for level in self.levels for n in level):
            run = self.spark.table(name).where(F.col("n_docs") >= self.enough).select(F.col("h").alias("_h"), F.col("max_doc").alias("_top"))
            keys = keys.join(run.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("max_doc") <= F.col("_top")), "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch: rows (h, doc_id), repeats allowed. Documents without an id do not count.

        The distinct pairs are dealt by key and document, and counts are summed per task before
        the keys meet, so a line of very many documents never gathers its rows in one task.
        """
        pairs = keys.where(F.col("doc_id").isNotNull()).select("h", "doc_id").distinct()
        counted = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        self._put(self.unsettled(counted), 0)

    def stats(self) -> DataFrame:
        """h, n_docs, max_doc over all runs."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h binary, n_docs bigint, max_doc bigint")
        return self._merged(names)

    def close(self) -> None:
        """Drop all runs."""
        self._drop([n for level in self.levels for n in level])
        self.levels = []


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop the lines of widespread keys from all documents but the one with the largest id.

    Returns one row for each row of docs: doc_id, text as given, row (the other columns as given),
    lines (array), drops (sorted 1-based positions of dropped lines, null if none) and kept (array).

    Null or empty text is one empty line. A key counts once in a document however often it is
    there, and rows with one doc_id are one document. Rows without an id count for no key and keep
    all lines. Repeated rows get equal results. Keys are compared by 128-bit hashes.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text"]
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.struct(*others).alias("row"))
    # ranges of documents, the largest ids first
    bounds = base.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else None
    batch = sum((F.col("doc_id") < b).cast("int") for b in bounds) if bounds else F.lit(0)
    long = base.where(F.length("text") >= min_chars).select("doc_id", "text", F.xxhash64("text").alias("t"))  # once a text, not once a line
    keyed = (
        long.select("doc_id", "t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "t", (F.col("pos") + 1).alias("pos"), line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select("doc_id", "t", "pos", F.unhex(F.md5("k")).alias("h"), F.coalesce(batch, F.lit(0)).alias("batch"))
    )
    staged = materialize(keyed, partition_by="batch")
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(staged.where(F.col("batch") == b))
    # written, so that the join below deals both its sides anew and can split a widespread line's rows
    wide = materialize(runs.stats().where(F.col("n_docs") >= min_docs).select("h", "max_doc"))
    runs.close()
    hits = staged.join(wide, "h").where("doc_id < max_doc")
    drops = materialize(hits.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("pos")).alias("drops")))
    release(staged)
    release(wide)
    out = base.withColumn("t", F.xxhash64("text")).join(drops, ["doc_id", "t"], "left")
    lines, edges = F.col("lines"), F.col("edges")
    between = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(edges) - 2),
            lambda i: F.slice(lines, F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i) - 1),
        )
    )
    return (
        out.select("doc_id", "text", "row", lines_of(F.col("text")).alias("lines"), "drops")
        .withColumn("edges", F.concat(F.array(F.lit(0)), F.col("drops"), F.array(F.size("lines") + 1)))
        .withColumn("kept", F.when(F.col("drops").isNull(), lines).otherwise(between))
        .drop("edges")
    )


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with all their columns; text (and n_chars) without the dropped lines. Texts that lose none stay, null included."""
    out = dedup_lines(docs, **options)
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    row = out.select("row", "drops", text.alias("new_text"))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("drops").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text").cast("bigint"))
    return row.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of dedup_lines()."""
    return dedup_lines(docs, **options).select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


#: DuckDB text of line_digest() over documents.
LINE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
w AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id < top, false) AS gone FROM k LEFT JOIN w ON k.key = w.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
