"""Structure-aware chunks of consecutive paragraphs, never across a section, with stable ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_COST = 2  # tokens of the blank line between two paragraphs


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 512
    overlap_tokens: int = 64


def group_units(units: Iterable[tuple], config: ChunkConfig) -> Iterator[list[tuple]]:
    """Chunks as lists of the units ``(section, tokens, ...)``, which come in book order.

    A chunk takes units of one section while they fit. The next one of the section begins with the longest
    tail of the last chunk within the overlap, if the unit still fits behind it. A unit above the limit
    stands alone. Only the open chunk is held.
    """
    now: list[tuple] = []
    total = 0
    for unit in units:
        size = unit[1]
        if now and unit[0] != now[-1][0]:
            yield now
            now, total = [], 0
        elif now and (size > config.max_tokens or total + size + JOIN_COST > config.max_tokens):
            yield now
            tail: list[tuple] = []
            spent = 0
            for u in reversed(now):
                if spent + u[1] > config.overlap_tokens:
                    break
                tail.insert(0, u)
                spent += u[1]
            fits = size <= config.max_tokens and spent + size + JOIN_COST * len(tail) <= config.max_tokens
            now, total = (tail, spent + JOIN_COST * max(0, len(tail) - 1)) if fits else ([], 0)
        total += size + (JOIN_COST if now else 0)
        now = [*now, unit]
    if now:
        yield now


def group_paragraphs(sizes: list[int], config: ChunkConfig) -> list[list[int]]:
    """Positions of the paragraphs of each chunk of one section."""
    return [[u[2] for u in group] for group in group_units(((0, n, i) for i, n in enumerate(sizes)), config)]


def chunk_id(source: Column, chapter: Column, section: Column, page: Column, index: Column) -> Column:
    """A digest of the place in the book, the same on every run."""
    zero = F.lit(0)
    return F.sha2(F.concat_ws(":", source, F.coalesce(chapter, zero).cast("string"), F.coalesce(section, zero).cast("string"), F.coalesce(page, zero).cast("string"), index.cast("string")), 256)


def build_chunks(units: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of paragraph rows ``(source, block_id, chapter_no, section_no, page, sequence, text, tokens)``.

    One shuffle by source and a sort; a task streams through its sources in book order and holds the open
    chunk only, so neither a large book nor a large section has to fit in memory. A change of chapter or
    section ends a chunk, and the index runs through the book.
    """
    schema = "source string, chapter_no int, section_no int, page_start int, page_end int, token_count long, block_ids array<string>, text string, chunk_index long"
    names = ["source", "chapter_no", "section_no", "page", "block_id", "tokens", "text"]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for source, chapter, section, page, block, tokens, text in zip(*(b.column(i).to_pylist() for i in range(len(names)))):
                yield (source, chapter, section), tokens, source, page, block, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        source, index = None, 0
        for group in group_units(stream(batches), config):
            index = index + 1 if group[0][2] == source else 0
            (source, chapter, section), pages = group[0][0], [u[3] for u in group if u[3] is not None]
            size = sum(u[1] for u in group) + JOIN_COST * (len(group) - 1)
            rows.append((source, chapter, section, min(pages, default=None), max(pages, default=None), size, [u[4] for u in group], "\n\n".join(u[5] for u in group), index))
            if len(rows) == 1000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    ordered = units.filter(F.col("source").isNotNull()).repartition("source").sortWithinPartitions("source", "sequence", "block_id").select(*names)
    made = ordered.mapInArrow(run, schema)
    return made.withColumn("chunk_id", chunk_id(F.col("source"), F.col("chapter_no"), F.col("section_no"), F.col("page_start"), F.col("chunk_index")))


def units_of_blocks(blocks: DataFrame, normalized: DataFrame | None = None) -> DataFrame:
    """Paragraph rows of blocks ``(source, block_id, type, chapter_no, section_no, page, sequence, text, language)``.

    Only paragraphs are chunked. With ``normalized`` (block_id, normalized_text) a block's normalised text takes
    the place of its own, and ``is_normalized`` says so. Sequences count within a page, so both order the book.
    """
    from corpusloom.functions.text import token_estimate

    rows = blocks.filter("type = 'paragraph'")
    if normalized is not None:
        rows = rows.join(normalized.select("block_id", "normalized_text"), "block_id", "left")
    else:
        rows = rows.withColumn("normalized_text", F.lit(None).cast("string"))
    text = F.coalesce("normalized_text", "text")
    order = F.coalesce(F.col("page"), F.lit(0)).cast("long") * 1_000_000 + F.col("sequence")
    return rows.select("source", "block_id", "chapter_no", "section_no", "page", order.alias("sequence"), text.alias("text"), token_estimate(text, F.col("language")).alias("tokens"), F.col("normalized_text").isNotNull().alias("is_normalized"))


def with_places(chunks: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the ids of their chapter and section: by number of the chapter in the book, and of the section in
    that chapter; unknown numbers have none."""
    c = chapters.select("source", "chapter_no", "chapter_id").distinct()
    out = chunks.join(c, ["source", "chapter_no"], "left")
    s = sections.select("source", "chapter_no", "section_no", "section_id").distinct()
    return out.join(s, ["source", "chapter_no", "section_no"], "left")


def paragraphs(df: DataFrame, *, source: str, text: str, language: str, page: str | None = None) -> DataFrame:
    """Paragraph rows of whole texts: the lines that are not blank, in order."""
    from corpusloom.functions.text import token_estimate

    lines = df.select(F.col(source).cast("string").alias("source"), F.col(language).alias("_lang"), (F.col(page) if page else F.lit(None)).cast("int").alias("page"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_at", "text"))
    lines = lines.filter(F.trim("text") != "").withColumn("sequence", F.col("_at") + 1)
    null = F.lit(None).cast("int")
    return lines.select("source", F.concat_ws("-", "source", "sequence").alias("block_id"), null.alias("chapter_no"), null.alias("section_no"), "page", "sequence", "text", token_estimate(F.col("text"), F.col("_lang")).alias("tokens"))
