"""The stages of a corpus over whole tables of pages, each stored before the next one reads it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, corpus, postings, structure, vectors
from corpusloom.plans.pipeline import Pipeline
from corpusloom.plans.registry import query
from corpusloom.session import materialize, table


@dataclass
class Corpus:
    """Runs the stages over ``pages`` (file, page, text, has_images, language); ``made`` holds what each has stored."""

    pages: DataFrame
    made: dict[str, DataFrame] = field(default_factory=dict)

    def _keep(self, stage: str, df: DataFrame) -> DataFrame:
        self.made[stage] = materialize(df)
        return self.made[stage]

    def inspect(self, _: DataFrame) -> DataFrame:
        return self._keep("inspect", corpus.inspect_pages(self.pages))

    def extract(self, _: DataFrame) -> DataFrame:
        return self._keep("extract", self.pages.withColumn("quality", tx.extract_quality(F.col("text"))))

    def ocr(self, _: DataFrame) -> DataFrame:
        """The plan of pages to recognise; engines are plug-ins (``corpus.recognise``)."""
        pages = self.made["extract"]
        inspected = pages.withColumn("scanned", F.coalesce("has_images", F.lit(False)) & (F.length(F.coalesce("text", F.lit(""))) < 30))
        return self._keep("ocr", corpus.plan_ocr(inspected, pages, pages.limit(0)))

    def metadata(self, _: DataFrame) -> DataFrame:
        pages = self.made["extract"].filter("quality = 'ok' and page is not null")
        marked = corpus.marked_facts(pages).select("file", "field", "value", "confidence", F.lit("first_pages").alias("source"))
        found = corpus.year_facts(pages).unionByName(corpus.isbn_facts(pages)).unionByName(corpus.title_guess(pages)).withColumn("source", F.lit("title_page"))
        facts = marked.unionByName(found).distinct().withColumnRenamed("file", "source_file_id")
        facts = facts.withColumn("id", F.sha2(F.concat_ws(":", "source_file_id", "field", "source", "value"), 256)).withColumn("status", F.lit("review")).withColumn("created_at", F.lit(None).cast("timestamp"))
        return self._keep("metadata", corpus.merge_candidates(facts))

    def publish(self, _: DataFrame) -> DataFrame:
        """As reviewed by hand: every best fact approved."""
        return self._keep("publish", corpus.publish(self.made["metadata"].withColumn("status", F.lit("approved"))))

    def structure(self, _: DataFrame) -> DataFrame:
        good = self.made["extract"].filter("quality = 'ok'").join(self.made["publish"].select(F.col("source_file_id").alias("file")), "file", "left_semi")
        return self._keep("structure", structure.structure_books(good.select("file", "page", "text"), "file"))

    def _languages(self) -> DataFrame:
        return self.pages.groupBy("file").agg(F.mode("language", True).alias("language"))

    def normalize(self, _: DataFrame) -> DataFrame:
        blocks = structure.tables(self.made["structure"], "file")["paragraphs"].join(self._languages(), "file", "left")
        return self._keep("normalize", blocks.select(F.col("id").alias("block_id"), "file", tx.normalize_text(F.col("text"), tx.language_code(F.col("language"))).alias("normalized_text")))

    def chunk(self, _: DataFrame) -> DataFrame:
        blocks = structure.tables(self.made["structure"], "file")["blocks"].join(self._languages(), "file", "left").withColumnsRenamed({"id": "block_id", "file": "source"})
        return self._keep("chunk", chunking.build_chunks(chunking.units_of_blocks(blocks, self.made["normalize"])))

    def index(self, _: DataFrame) -> DataFrame:
        chunks = self.made["chunk"].join(self._languages().withColumnRenamed("file", "source"), "source", "left")
        return self._keep("index", postings.postings(chunks, key="chunk_id", text=F.col("text"), language=tx.language_code(F.col("language"))))

    def embed(self, _: DataFrame) -> DataFrame:
        return self._keep("embed", vectors.embed(self.made["chunk"].select("chunk_id", "text"), text="text"))

    def pipeline(self) -> Pipeline:
        names = ("inspect", "extract", "ocr", "metadata", "publish", "structure", "normalize", "chunk", "index", "embed")
        return Pipeline({n: getattr(self, n) for n in names})


@query("""WITH p AS (SELECT book_id AS file, text FROM documents WHERE book_id IS NOT NULL)
    SELECT unnest(['inspect', 'extract', 'ocr', 'metadata', 'publish', 'structure', 'normalize', 'chunk', 'index', 'embed']) AS stage, 'succeeded' AS status, unnest([(SELECT count(DISTINCT file) FROM p), (SELECT count(*) FROM p), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS rows, true AS consistent""")
def corpus_stages(spark, sf):
    """Every stage over all pages: its outcome, how many rows the first two stored, and whether what the later ones
    stored fits what they read: a normalised text for each paragraph, a vector for each chunk, postings of chunks."""
    pages = table(spark, sf, "documents").filter("book_id is not null").select(F.col("book_id").alias("file"), F.col("page_number").alias("page"), "text", (F.col("doc_id") % 3 == 0).alias("has_images"), F.col("lang").alias("language"))
    run = Corpus(pages)
    outcomes = run.pipeline().run(pages)
    n = {stage: df.count() for stage, df in run.made.items()}
    made = run.made
    fits = dict.fromkeys(n, True)
    if "embed" in n:
        fits["normalize"] = n["normalize"] == made["structure"].filter("type = 'paragraph'").count()
        fits["chunk"] = made["chunk"].select("chunk_id").distinct().count() == n["chunk"] and made["chunk"].filter("text is null").count() == 0
        fits["index"] = made["index"].join(made["chunk"].select(F.col("chunk_id").alias("key")), "key", "left_anti").count() == 0
        fits["embed"] = n["embed"] == n["chunk"]
    shown = {"inspect", "extract"}
    return spark.createDataFrame([(o.stage, o.status, n.get(o.stage) if o.stage in shown else None, fits.get(o.stage, False)) for o in outcomes], "stage string, status string, rows long, consistent boolean")
