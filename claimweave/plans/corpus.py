"""Building the searchable corpus: chunk table, global ids, postings, term statistics, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backends import Embedder, HashedEmbedder
from ..functions.text import embedding_text
from ..operators.relational import global_ids, pending, upsert
from ..operators.retrieval import corpus_stats, dense, postings, term_counts, term_stats, top_k
from ..sources.filings import chunk_filings
from ..sources.transcripts import chunk_transcripts
from ..storage import exists

CORPORA = {"filings": ("10-K", "10-Q"), "transcripts": ("transcript",), "master": ("10-K", "10-Q", "transcript")}
TABLES = ("chunks", "postings", "terms", "vectors", "manifest")
MANIFEST = "corpus string, n_chunks long, n_vectors long, dim int, embedder string, mean_length double, mean_idf double, doc_types string"
_KEYS = ["ticker", "fiscal_year", "fiscal_period", "doc_type"]


def chunk_corpus(filings: DataFrame | None, calls: DataFrame | None) -> DataFrame:
    parts = [f(x) for f, x in ((chunk_filings, filings), (chunk_transcripts, calls)) if x is not None]
    if not parts:
        raise ValueError("neither filings nor transcripts")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def merged(chunks: DataFrame, corpus: str = "master") -> DataFrame:
    """The chunks of one corpus with dense global ids."""
    return global_ids(chunks.where(F.col("doc_type").isin(list(CORPORA[corpus]))), ["ticker", "fiscal_year", "doc_type", "fiscal_period", "chunk_id"])


def build(chunks: DataFrame, path: str, corpus: str = "master", embedder: Embedder | None = None, force: bool = True, max_chunks: int | None = None) -> dict[str, DataFrame]:
    """Writes ``chunks``, ``postings``, ``terms``, ``vectors`` and ``manifest`` of one corpus under ``path`` and reads them back.

    The manifest comes last, once the vectors are found to be in order; a corpus without one is not built.
    Without ``force`` a finished corpus is read as it is; ``max_chunks`` embeds only the first ones (a trial run).  Chunks are laid out by year and ticker, so filters
    on a period prune folders.
    """
    spark = chunks.sparkSession
    embedder = embedder or HashedEmbedder()
    if force or not _finished(spark, path_of(path, corpus, "manifest")):
        at = {name: path_of(path, corpus, name) for name in TABLES}
        merged(chunks, corpus).write.mode("overwrite").partitionBy("fiscal_year", "ticker").parquet(at["chunks"])
        rows = spark.read.parquet(at["chunks"])
        postings(rows, keep=_KEYS).write.mode("overwrite").parquet(at["postings"])
        index = spark.read.parquet(at["postings"])
        n, counts = rows.count(), term_counts(index)
        length, mean = corpus_stats(counts, n)
        term_stats(counts, n, mean).write.mode("overwrite").parquet(at["terms"])
        need = {c for c in ("company_name", "section", "filing_date", "report_date", "quarter_period_label", "speaker_name", "speaker_role", "call_date")} - set(rows.columns)
        whole = rows.withColumns({c: F.lit(None).cast("string") for c in need} | ({} if "quarter_months" in rows.columns else {"quarter_months": F.lit(None).cast("array<string>")}))
        if max_chunks is not None:
            whole = whole.where(F.col("global_id") < max_chunks)
        whole.select("global_id", "chunk_id", *_KEYS, embedder.embed(embedding_text()).alias("embedding")).write.mode("overwrite").parquet(at["vectors"])
        vectors = n if max_chunks is None else min(n, max_chunks)
        check_order(spark.read.parquet(at["vectors"]), vectors, embedder.dim)
        facts = [(corpus, n, vectors, embedder.dim, type(embedder).__name__, float(length), float(mean), ",".join(CORPORA[corpus]))]
        spark.createDataFrame(facts, MANIFEST).coalesce(1).write.mode("overwrite").parquet(at["manifest"])
    return load(spark, path, corpus)


def _finished(spark: SparkSession, path: str) -> bool:
    return exists(spark, path + "/_SUCCESS")


def path_of(path: str, corpus: str, name: str) -> str:
    """Folder of one table of a corpus."""
    if corpus not in CORPORA or name not in TABLES:
        raise ValueError(f"no table {name} of a corpus {corpus}")
    return f"{path}/{corpus}/{name}"


def is_ready(spark: SparkSession, path: str, corpus: str) -> bool:
    """Whether a corpus is written to its end and holds a row."""
    return _finished(spark, path_of(path, corpus, "manifest")) and load(spark, path, corpus)["chunks"].limit(1).count() == 1


def load(spark: SparkSession, path: str, corpus: str = "master") -> dict[str, DataFrame]:
    """The tables of a finished corpus."""
    if not _finished(spark, path_of(path, corpus, "manifest")):
        raise FileNotFoundError(f"corpus {corpus} is not built under {path}")
    return {name: spark.read.parquet(path_of(path, corpus, name)) for name in TABLES}


def check_order(vectors: DataFrame, n_chunks: int, dim: int) -> None:
    """Vectors are numbered 0..n-1 without gaps or repeats, and all have the stated length; else an error."""
    width = F.coalesce(F.size("embedding"), F.lit(-1))
    found = vectors.agg(F.count("*"), F.countDistinct("global_id"), F.coalesce(F.min("global_id"), F.lit(0)), F.coalesce(F.max("global_id"), F.lit(-1)), F.count_if(width != dim)).first()
    if tuple(found) != (n_chunks, n_chunks, 0, n_chunks - 1, 0):
        raise ValueError(f"vectors do not match their chunks: rows, ids, least, greatest, of another length = {tuple(found)}, chunks = {n_chunks}, length = {dim}")


def build_all(chunks: DataFrame, path: str, corpora: Sequence[str] = ("filings", "transcripts"), **options) -> dict[str, dict[str, DataFrame]]:
    return {name: build(chunks, path, name, **options) for name in corpora}


class Collection:
    """A named set of points ``(global_id, payload..., embedding)`` with upsert and filtered search.

    The points are a Parquet table under ``root``; an upsert writes the next version beside the last one and then names
    it, so a reader never meets half of one.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, dim: int):
        self.spark, self.path, self.dim = spark, f"{root}/{name}", dim

    def _versions(self) -> list[int]:
        if not exists(self.spark, f"{self.path}/versions"):
            return []
        return sorted(r["n"] for r in self.spark.read.json(f"{self.path}/versions", schema="n long").collect())  # one row an upsert

    def is_ready(self) -> bool:
        return bool(self._versions()) and self.points().limit(1).count() == 1

    def points(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no points under {self.path}")
        return self.spark.read.parquet(f"{self.path}/points-{versions[-1]}")

    def upsert(self, points: DataFrame) -> int:
        """Adds points or replaces those with the same id; returns the number of points.  Shapes are checked first."""
        wrong = points.where(F.col("global_id").isNull() | (F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim)).limit(1).count()
        if wrong:
            raise ValueError(f"a point without an id or with a vector of another length than {self.dim}")
        if points.groupBy("global_id").count().where("count > 1").limit(1).count():
            raise ValueError("a point stands twice in one upsert")
        versions = self._versions()
        whole = upsert(self.points(), points, ["global_id"]) if versions else points
        following = versions[-1] + 1 if versions else 0
        whole.write.mode("overwrite").parquet(f"{self.path}/points-{following}")
        self.spark.createDataFrame([(following,)], "n long").coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return self.points().count()

    def search(self, queries: DataFrame, k: int, on: Sequence[str] = (), query: str = "claim_id") -> DataFrame:
        """The ``k`` nearest points of every query, among those that agree in the columns ``on``."""
        return top_k(dense(self.points(), queries, "global_id", query, on=on), k, query, "global_id")


def add_new(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks of periods that the table at ``path`` does not have yet; appends them.  Only the years at hand are looked up."""
    spark = chunks.sparkSession
    fresh = chunks
    if _finished(spark, path):
        years = [r[0] for r in chunks.select("fiscal_year").distinct().collect()]  # one a year
        fresh = pending(chunks, spark.read.parquet(path).where(F.col("fiscal_year").isin(years)), _KEYS)
    fresh.write.mode("append").partitionBy("fiscal_year").parquet(path)
    return spark.read.parquet(path)
