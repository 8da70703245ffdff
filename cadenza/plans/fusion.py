"""The whole segmentation as one plan: grid, rules, boundaries, classes, smoothing, documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from cadenza.config import DEFAULT, Config
from cadenza.operators import align, boundaries, classify, export, rules, smooth
from cadenza.sources.tables import Measures, kept


@dataclass
class Fusion:
    """Each step of the segmentation, worked out when it is asked for.

    What several steps read is kept as a table, dealt out by recording: the text, the scene labels, the grid, the boundaries and
    the classified segments. Everything after the grid then works within recordings, without another shuffle of seconds.
    """

    durations: DataFrame
    audio: DataFrame
    visual: DataFrame
    text_features: DataFrame
    vectors: DataFrame | None = None
    config: Config = DEFAULT
    #: What is said, if not as in the text features: (video_id, pos, id, start, end, text) of the transcripts.
    transcript: DataFrame | None = None
    #: Rows and ends of each stage that has run.
    measures: Measures = field(default_factory=Measures)

    def _kept(self, df: DataFrame, *by: str, stage: str, of: tuple[str, ...]) -> DataFrame:
        return kept(df, *by, stage=stage, measures=self.measures, of=of, fixed=True)

    @cached_property
    def text(self) -> DataFrame:
        _ = self.parts
        return self._kept(self.text_features, "video_id", "pos", stage="text", of=("start", "end"))

    @cached_property
    def sentences(self) -> DataFrame:
        """What summaries and titles are chosen from."""
        return self.text if self.transcript is None else self._kept(self.transcript, "video_id", "pos", stage="transcript", of=("start", "end"))

    @cached_property
    def grid(self) -> DataFrame:
        return self._kept(self.seconds.sortWithinPartitions("video_id", "t"), stage="grid", of=("t", "size(scene)"))

    @property
    def seconds(self) -> DataFrame:
        """The grid as a plan: seconds that a source has rows for, and the stretches between them."""
        return align.build_stretches(self.durations, self.audio, self.visual, self.text, self.parts, self.labels)

    @cached_property
    def parts(self) -> int:
        """Partitions of every table that is kept, by the number of seconds."""
        return align.room(self.durations, self.audio, self.visual)

    @property
    def scenes(self) -> int:
        """How many scenes the longest vector of the grid has, as told when it was kept."""
        _ = self.grid
        return max(self.measures["grid"]["greatest_size(scene)"] or 0, 0)

    @property
    def ends(self) -> DataFrame:
        return align.ends(self.durations)

    @cached_property
    def labels(self) -> DataFrame:
        _ = self.parts
        return self._kept(align.scene_labels(self.visual), "video_id", stage="labels", of=())

    @cached_property
    def hits(self) -> DataFrame:
        return rules.all_rules(self.grid, self.text, self.config, self.ends)

    @cached_property
    def candidates(self) -> DataFrame:
        return boundaries.candidates(self.grid, self.config, self.scenes)

    @cached_property
    def boundaries(self) -> DataFrame:
        return self._kept(boundaries.boundaries(self.candidates, self.config), "video_id", stage="boundaries", of=())

    @cached_property
    def classified(self) -> DataFrame:
        return self._kept(classify.classify(self.grid, self.boundaries, self.hits, self.sentences, self.labels, self.config, self.scenes), "video_id", "start_sec", stage="classified", of=("start_sec", "end_sec", "confidence"))

    @cached_property
    def smoothed(self) -> DataFrame:
        return self._kept(smooth.smooth(self.classified, self.config), "video_id", "start_sec", stage="smoothed", of=("start_sec", "end_sec", "confidence"))

    def documents(self, info: DataFrame) -> DataFrame:
        """``info``: (video_id, filename, duration_sec, fps, width, height)."""
        segments = export.attach_summaries(self.smoothed, self.sentences, self.vectors, self.config)
        return export.documents(info, segments, export.chapters(self.smoothed, self.sentences, self.vectors, self.config), self.config)
