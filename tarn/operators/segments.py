"""An index that grows: each batch of spans is one segment, and counts of segments add up.

A segment holds the spans and the term counts of its batch and is never written again. Its entry in the manifest
comes last, so a batch that failed half-way is not seen and may be written anew under the same number.
Weights depend on the whole collection; they are derived from counts over all segments when the index
is searched, so any number of batches equals one build, to the last digit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import Settings
from . import debate, search

MANIFEST = "segment long, n long, total long"


@dataclass
class Segments:
    """An index under `path`; span ids are of the type that `id_type` names."""

    spark: SparkSession
    path: str
    id_type: str = "long"

    def manifest(self) -> DataFrame:
        """segment, n spans, total tokens of each segment that counts."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not at.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")

    def _table(self, name: str, schema: str) -> DataFrame:
        """Rows of one kind of all segments in the manifest."""
        known = [r.segment for r in self.manifest().select("segment").collect()]  # a number a batch
        if not known:
            return self.spark.createDataFrame([], f"{schema}, segment long")
        fields = StructType.fromDDL(schema).fields
        rows = self.spark.read.schema(StructType([*fields, StructField("segment", LongType())])).option("basePath", f"{self.path}/{name}")
        return rows.parquet(*(f"{self.path}/{name}/segment={i}" for i in known))

    def append(self, spans: DataFrame) -> int:
        """Add a batch of span_id, text as a segment; ids must be new. Returns the number of its spans."""
        number = (self.manifest().agg(F.max("segment")).first()[0] or 0) + 1

        def write(rows: DataFrame, name: str) -> DataFrame:
            at = f"{self.path}/{name}/segment={number}"
            rows.write.mode("overwrite").parquet(at)
            return self.spark.read.schema(rows.schema).parquet(at)

        own = write(spans.select(F.col("span_id").cast(self.id_type).alias("span_id"), F.coalesce("text", F.lit("")).alias("text")), "spans")
        counts = write(search.term_counts(own), "terms")
        n, total = own.count(), counts.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        if n:
            self.spark.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/segment={number}")
        return n

    def stats(self) -> DataFrame:
        """n, avgdl over all segments: one row."""
        total = self.manifest().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"))
        return total.select("n", (F.col("total") / F.nullif("n", F.lit(0))).alias("avgdl"))

    def spans(self) -> DataFrame:
        return self._table("spans", f"span_id {self.id_type}, text string").drop("segment")

    def find(self, span_ids: DataFrame) -> DataFrame:
        """The spans of the ids, with their segment."""
        return self._table("spans", f"span_id {self.id_type}, text string").join(span_ids.select("span_id").distinct(), "span_id", "left_semi")

    def terms(self) -> DataFrame:
        """term, df, tf over all segments."""
        return self._table("terms", "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))

    def bm25(self) -> search.BM25:
        spans, stats = self.spans(), self.stats()
        return search.BM25(spans, search.keys.blocks(spans), search.weigh_terms(self.terms(), stats), stats)

    def open(self, settings: Settings = Settings()) -> debate.Corpus:
        """The corpus of all segments, for retrieve and run."""
        return debate.Corpus(self.spans(), settings, terms=self.terms())
