"""A store of fingerprints that grows batch by batch and survives reruns.

Under its path lie ``fingerprints/batch=<id>/model=<model>``, ``moments/batch=<id>``
and ``commits/batch=<id>``.  A batch counts once its commit is there, which is
written last; what a broken run has left is written over, and a batch that is
committed is not added again.  Readers see committed batches only, as partitions.
Profiles are merged from one row of counts, means and co-moments a model and
batch; no fingerprint is read again for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import moments as M
from lexiprint.operators.profiles import family

#: Rows of ``fingerprints``: the text is known by its digest alone.
COLUMNS = ["fingerprint_id", "model", "vec", "text_hash", "text_sha256", "text_length", "prompt", "category"]


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """``batch, added, at``: a row for each batch that counts."""
        return self._table("commits", "added long, at timestamp, batch string")

    def _committed(self, name: str, schema: str) -> DataFrame:
        """Rows of committed batches, by a filter on the partition column, so others are not even listed for reading."""
        batches = [r["batch"] for r in self.commits().select("batch").collect()]
        return self._table(name, f"{schema}, batch string").filter(F.col("batch").isin(batches) if batches else F.lit(False))

    def fingerprints(self) -> DataFrame:
        return self._committed("fingerprints", "fingerprint_id string, vec array<double>, text_hash string, text_sha256 string, text_length long, prompt string, category string, model string").select(*COLUMNS, "batch")

    def add(self, batch: str, samples: DataFrame, extract: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Adds ``model, text, prompt, category`` with their vectors as batch ``batch``; the rows added, 0 if it was there.

        ``samples`` has a column ``vec``, or ``extract`` puts one beside the
        rows; it is asked only for texts that are new to their model.  Texts
        that the model has, or that come twice, are left out; they are compared
        by their whole SHA-256.  Rows without a model are left out.
        """
        if self.commits().filter(F.col("batch") == batch).limit(1).count():
            return 0
        sha = F.sha2(T.text_of("text").cast("binary"), 256)
        named = samples.filter("model is not null").withColumn("text_sha256", sha).dropDuplicates(["model", "text_sha256"])
        fresh = named.join(self.fingerprints().select("model", "text_sha256"), ["model", "text_sha256"], "left_anti")
        rows = extract(fresh) if extract else fresh
        optional = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
        shaped = rows.select(
            F.concat_ws("_", "model", F.substring("text_sha256", 1, 16)).alias("fingerprint_id"), "model", F.col("vec").cast("array<double>").alias("vec"),
            F.substring("text_sha256", 1, 16).alias("text_hash"), "text_sha256", F.length(T.text_of("text")).cast("long").alias("text_length"), optional("prompt").alias("prompt"), optional("category").alias("category"),
        )
        place = f"fingerprints/batch={batch}"
        shaped.write.mode("overwrite").partitionBy("model").parquet(f"{self.path}/{place}")
        written = self.spark.read.schema(shaped.schema).parquet(f"{self.path}/{place}")
        M.moments(written.select("model", "vec")).write.mode("overwrite").parquet(f"{self.path}/moments/batch={batch}")
        added = written.count()
        self.spark.range(1).select(F.lit(added).cast("long").alias("added"), F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return added

    def moments(self) -> DataFrame:
        """``model, n, mean, comoment`` of all committed batches."""
        return M.merged(self._committed("moments", "model string, n long, mean array<double>, comoment array<double>"))

    def profiles(self, rules: list[tuple[str, str]] | None = None) -> DataFrame:
        """``model, family, n, centroid, sd``: deviations of samples, 0 for a single one."""
        found = self.moments()
        d = F.size("mean")
        spread = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.sqrt(F.greatest(F.get("comoment", i * (d + 1)), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))))
        return found.select("model", family(F.col("model"), rules or []).alias("family"), "n", F.col("mean").alias("centroid"), spread.alias("sd"))

    def status(self) -> DataFrame:
        """``model, n, ready``: whether a model has the samples a covariance needs."""
        return self.moments().groupBy("model").agg(F.sum("n").alias("n")).select("model", "n", (F.col("n") >= 10).alias("ready"))
