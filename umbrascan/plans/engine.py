"""The whole scan as one lazy plan over the tables of the contract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import detect, report, review, visual
from .timing import Stages


@dataclass
class HiddenTextEngine:
    """Scans over span, metadata, trace and line tables; every method gives a DataFrame and runs nothing.

    Instead of ocr_lines there may be `reads`, the raw reads of pages with their errors: a document's pages count up to the first one that failed.

    What is small beside the spans and read more than once, style flags and hidden spans, is persisted until `release`.
    """

    spans: DataFrame
    metadata: DataFrame
    traces: DataFrame | None = None
    ocr_lines: DataFrame | None = None
    crops: DataFrame | None = None
    reads: DataFrame | None = None
    fuzzy: bool = True
    kept: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame) -> DataFrame:
        """df persisted until `release`: memory first, then disk; a lost part is computed again."""
        self.kept.append(df.persist())
        return df

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def flags(self) -> DataFrame:
        """Labelled flags of all detectors; without read lines the visual difference is left out of the plan."""
        return self._flags(lambda name, df: self.keep(df))

    def _flags(self, stage: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
        """stage(name, frame) gives each intermediate frame back, kept for its several readers."""
        style = detect.numbered(detect.style_flags(self.spans, self.metadata, self.traces))
        spans, lines = self.spans, self.ocr_lines
        if self.reads is not None:
            read = stage("read", visual.before_failure(self.reads))
            spans, lines = spans.join(read.select(*detect.PAGE_KEY), detect.PAGE_KEY, "left_semi"), visual.decoded_lines(read)
        if lines is None:
            return detect.label(stage("detect", style))
        seen = visual.visible_fraction(spans, lines, self.crops, self.fuzzy)
        return detect.label(visual.add_visual(stage("detect", style), stage("visual_diff", visual.hidden_runs(seen))))

    def measured(self, docs: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, Stages]:
        """Reports that say how long the stages took, and the stages with their rows. Unlike the other methods this one runs the scan, a stage after the other."""
        stages = Stages()
        flags = stages.run("rule_classify", self._flags(stages.run))
        stages.run("report", self.reports(docs, pages, flags))
        return self.reports(docs, pages, flags, stages.timings()), stages

    def visual_status(self, docs: DataFrame) -> DataFrame:
        """doc_id, status, error and pages_ocrd of the visual difference."""
        if self.reads is not None:
            return visual.read_status(self.reads, docs)
        return visual.ocr_status(visual.pages_to_read(self.spans), docs, self.ocr_lines is not None)

    def review(self, reviewer: review.Reviewer | None, cache: DataFrame | None = None) -> DataFrame:
        return review.review(self.flags(), reviewer, cache)

    def reports(self, docs: DataFrame, pages: DataFrame | None = None, flags: DataFrame | None = None, timings: dict[str, float] | None = None) -> DataFrame:
        """doc_id and report of every document. pages: sizes of all pages, those of the spans if not given; flags: reviewed ones, if there are any."""
        sizes = report.page_sizes(self.spans) if pages is None else pages
        visual_ = self.visual_status(docs) if self.reads is not None or self.ocr_lines is not None else None
        return report.reports(docs, self.flags() if flags is None else flags, sizes, visual_, timings)
