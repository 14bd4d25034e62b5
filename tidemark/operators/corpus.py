"""A stored corpus that takes each text once: documents, an index of content hashes in buckets, and a Bloom filter beside it.

An ingestion hashes its texts and asks the filter. Only hashes that may be there are looked up, in the buckets where they would
be: the index is read in place and meets the few possible repeats by broadcast; neither it nor the documents are shuffled.
What is new is appended as one batch, which readers see once the ledger names it, so an ingestion that broke off leaves nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.storage import small, written

BUCKETS = 64
#: Blocks of 256 bits: 16 bits a text up to a million texts. Beyond, more texts are looked up in vain, none is taken twice.
BLOCKS = 65_536


class Corpus:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, blocks: int = BLOCKS) -> None:
        self.spark, self.root, self.buckets, self.blocks = spark, root.rstrip("/"), buckets, blocks

    def batches(self) -> list[str]:
        """Names of the whole batches, one for each ingestion that added something."""
        try:
            return sorted(r["batch"] for r in self.spark.read.parquet(f"{self.root}/ledger").distinct().collect())
        except AnalysisException:
            return []

    def table(self, name: str) -> DataFrame | None:
        paths = [self._at(name, b) for b in self.batches()]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).drop("corpus_batch") if paths else None

    def _at(self, name: str, batch: str) -> str:
        return f"{self.root}/{name}/corpus_batch={batch}"

    def _known(self, possible: DataFrame) -> DataFrame | None:
        """(content_hash, known) of the possible hashes that the index holds, from their buckets alone."""
        index = self.table("index")
        if index is None:
            return None
        buckets = [r["bucket"] for r in possible.select("bucket").distinct().collect()]  # BUCKETS at most
        return index.filter(F.col("bucket").isin(buckets)).join(small(possible.select("content_hash").distinct()), "content_hash").select("content_hash", F.col("doc_id").alias("known"))

    def ingest(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Appends the documents (doc_id, text, others) whose texts are new; (doc_id, content_hash, status, held_by) of all of them: ingested,
        repeated (held_by: the document of this batch with the least id that has the text) or already_ingested (held_by: the stored one).

        A null text counts as an empty one. Repeated rows get equal answers. No documents give none and add nothing.
        """
        h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        rows = docs.withColumn("content_hash", F.substring(h, 1, 32))
        keyed = written(rows.select("doc_id", "content_hash", F.pmod(F.xxhash64("content_hash"), F.lit(self.buckets)).cast("int").alias("bucket")))
        first = keyed.groupBy("content_hash", "bucket").agg(F.min("doc_id").alias("doc_id"))
        held = self.table("filter")
        if held is not None:
            asked = written(bloom.may_hold(first, small(written(bloom.together(held.select("block", *[f"w{i}" for i in range(bloom.WORDS)])))), "content_hash", self.blocks))
            known = self._known(asked.filter("possible"))
            first = written(asked.join(small(written(known)), "content_hash", "left"))
        else:
            first = written(first.withColumn("known", F.lit(None).cast(dict(docs.dtypes)["doc_id"])))
        fresh = first.filter("known IS NULL").select("content_hash", "bucket", "doc_id")
        if not fresh.isEmpty():
            self._append(rows, fresh)
        status = F.when(F.col("known").isNotNull(), "already_ingested").when(F.col("doc_id") == F.col("first_id"), "ingested").otherwise("repeated")
        out = keyed.join(first.select("content_hash", F.col("doc_id").alias("first_id"), "known"), "content_hash")
        return out.select("doc_id", "content_hash", status.alias("status"), F.coalesce("known", F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id"))).alias("held_by"))

    def _append(self, rows: DataFrame, fresh: DataFrame) -> None:
        # The batch is named by what it holds: doing it again writes the same folder.
        mark = fresh.agg(F.sum(F.xxhash64("content_hash").cast("decimal(38,0)")).cast("string"), F.count("*")).first()
        name = f"{mark[1]}-{mark[0].replace('-', 'm')}"
        kept = rows.join(small(fresh.select("content_hash", "doc_id")), ["content_hash", "doc_id"], "left_semi").dropDuplicates(["content_hash"])
        kept.write.mode("overwrite").parquet(self._at("documents", name))
        fresh.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("index", name))
        bloom.filter_of(fresh, "content_hash", self.blocks).write.mode("overwrite").parquet(self._at("filter", name))
        self.spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def documents(self) -> DataFrame | None:
        return self.table("documents")
