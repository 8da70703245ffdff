"""Declared schemas of the documents and tables; nothing is inferred."""

from __future__ import annotations

#: The columns and nesting of the documents.
META_RAW = "filename string, duration_sec double, fps double, width int, height int, video_codec string, audio_codec string, has_audio boolean, ingested_at string"
SEGMENT_TEXT = "struct<id int, start double, end double, text string>"
TRANSCRIPT = f"language string, duration_sec double, model string, full_text string, segments array<{SEGMENT_TEXT}>"
AUDIO_SEGMENT = (
    "struct<start double, end double, is_speech boolean, rms_energy double, spectral_centroid double, spectral_bandwidth double, zero_crossing_rate double, spectral_entropy double, audio_class string>"
)
VISUAL_FRAME = (
    "struct<frame_index int, timestamp_sec double, hist_diff_to_previous double, is_hard_cut boolean, clip_labels map<string,double>, mean_luminance double, luminance_variance double, "
    "is_black_frame boolean, motion_intensity double, chroma_diff double, dct_hf_energy double>"
)
TEXT_SEGMENT = "struct<id int, start double, end double, text string, similarity_to_next double, is_potential_boundary boolean, matched_keywords array<string>>"
AUDIO_FEATURES = f"model_used string, segments array<{AUDIO_SEGMENT}>"
VISUAL_FEATURES = f"model_used string, frames array<{VISUAL_FRAME}>"
TEXT_FEATURES = f"model_used string, segments array<{TEXT_SEGMENT}>"
SPEECH = "segments array<struct<start double, end double>>"
EVIDENCE = "struct<visual_score double, audio_score double, text_score double, triggered_rules array<string>>"
SEGMENT = f"struct<segment_id int, start_sec double, end_sec double, label string, confidence double, evidence {EVIDENCE}, summary string, user_corrected boolean>"
CHAPTER = "struct<chapter_id int, start_sec double, end_sec double, title string>"
VIDEO_INFO = "struct<filename string, duration_sec double, fps double, width int, height int, analysis_version string, verified_by_human boolean>"
METADATA = f"struct<video_info {VIDEO_INFO}, segments array<{SEGMENT}>, chapters array<{CHAPTER}>, skip_suggestions array<int>>"

#: The keys that each level of a metadata document may have.
METADATA_KEYS = {
    "": ["video_info", "segments", "chapters", "skip_suggestions"],
    "video_info": ["filename", "duration_sec", "fps", "width", "height", "analysis_version", "verified_by_human"],
    "segments": ["segment_id", "start_sec", "end_sec", "label", "confidence", "evidence", "summary", "user_corrected"],
    "chapters": ["chapter_id", "start_sec", "end_sec", "title"],
}
