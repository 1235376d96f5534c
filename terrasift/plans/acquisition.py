"""The acquisition ladder: cheap readings of all documents first, dearer ones only of those that need them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators import corpus, index
from terrasift.plans import pipeline
from terrasift.session import stored
from terrasift.sources.corpus import hybrid, limited, subset

#: Pages of the text layer that are read before any page is chosen by its score.
FIRST_PAGES = 150


@dataclass
class Ladder:
    """ORC-02, ORC-03: what each stage gave for each document it read, and the best of them."""

    attempts: DataFrame
    best: DataFrame


def stages(text_pages: DataFrame, ocr_pages: DataFrame) -> list[tuple[str, DataFrame]]:
    """The stages in their order: pages that the index names, the first pages, the best pages by OCR, the
    whole text layer, and page by page whichever of both is usable."""
    planned = index.plan(text_pages)
    named = planned.where("reason = 'INDEX'").select("doc_id", "page_no")
    scored = planned.where("reason = 'SCORE'").select("doc_id", "page_no")
    return [
        ("INDEX", subset(text_pages, named)[0]),
        ("FIRST_PAGES", limited(text_pages, FIRST_PAGES)),
        ("SCORED_OCR", subset(ocr_pages, scored)[0]),
        ("FULL_TEXT", text_pages),
        ("HYBRID", hybrid(text_pages, ocr_pages)),
    ]


def climb(steps: list[tuple[str, DataFrame]], defer: bool = False) -> Ladder:
    """Run the stages until each document is complete, or with ``defer`` of any use.

    A later stage reads only the documents that are left.  An earlier result stays when a later
    one is no better.
    """
    attempts, pending = None, None
    for k, (name, pages) in enumerate(steps):
        own = pages if pending is None else pages.join(pending, "doc_id", "left_semi")
        project = pipeline.run(own)
        state = corpus.completeness(project.rings, project.documents)
        found = project.counts().join(state, "doc_id").select("doc_id", F.lit(k).alias("attempt"), F.lit(name).alias("stage"), F.col("rings").alias("polygons"), F.col("points").alias("coordinates"), "tables", "completeness")
        found = stored(found)
        attempts = found if attempts is None else attempts.unionByName(found)
        enough = ("COMPLETE", "USEFUL_PARTIAL") if defer else ("COMPLETE",)
        done = found.where(F.col("completeness").isin(*enough)).select("doc_id")
        everyone = pages.select(F.col("doc_id").cast("string").alias("doc_id")).distinct() if pending is None else pending
        for _, later in steps[k + 1 :] if pending is None else ():
            everyone = everyone.union(later.select(F.col("doc_id").cast("string").alias("doc_id"))).distinct()
        pending = stored(everyone.join(done, "doc_id", "left_anti"))
        if pending.isEmpty():
            break
    return Ladder(attempts, corpus.best_attempt(attempts))
