"""Constants of the segmentation rules, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Phrases by group, in match order; the first phrase of a group that a text contains wins.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "sponsor": (
        "sponsored by",
        "today's video is brought to you by",
        "brought to you by",
        "thanks to our sponsor",
        "this video is sponsored",
        "use code",
        "promo code",
        "the link in the description",
    ),
    "intro": ("welcome back", "welcome to", "in today's video", "in this video", "what's up everyone", "hey guys", "hello and welcome"),
    "outro": (
        "thanks for watching",
        "see you next time",
        "see you in the next video",
        "don't forget to subscribe",
        "hit the like button",
        "smash that like",
        "leave a comment below",
        "like and subscribe",
    ),
    "self_promo": ("subscribe to my channel", "follow me on", "join my discord", "patreon", "merchandise", "my new course"),
    "recap": ("last time", "previously on", "in the previous video", "as we saw before", "to recap"),
}

#: What a scene label contains, and the segment label it stands for; the first match wins.
SCENES: tuple[tuple[str, str], ...] = (
    ("presentation slide", "core_content"),
    ("person talking", "core_content"),
    ("screen recording", "core_content"),
    ("video game", "core_content"),
    ("animated scene", "core_content"),
    ("blank screen", "transition"),
    ("end credits", "outro"),
    ("title card", "intro"),
    ("advertisement", "sponsorship"),
    ("sponsor logo", "sponsorship"),
)

#: The labels that a segment may have.
LABELS = ("core_content", "intro", "outro", "sponsorship", "self_promotion", "recap", "transition", "dead_air", "holding_screen", "filler")


@dataclass(frozen=True)
class Config:
    """Thresholds; the defaults are the fixed values of the rules."""

    silence_rms: float = 0.001
    speech_zcr: float = 0.10
    music_rms: float = 0.01
    similarity: float = 0.35
    hard_cut: float = 0.6
    black_mean: float = 10.0
    black_variance: float = 50.0
    dead_air_rms: float = 0.01
    dead_air_run: int = 5
    holding_diff: float = 0.05
    holding_run: int = 8
    intro_window: int = 90
    outro_window: int = 90
    ad_run: int = 15
    ad_gap: int = 3
    scene_shift: float = 0.3
    min_gap: int = 3
    coverage: float = 0.25
    little_speech: float = 0.1
    min_segment: float = 2.0
    bridge: float = 12.0
    summary_chars: int = 200
    title_chars: int = 80
    version: str = "0.4.0"
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: KEYWORDS)
    scenes: tuple[tuple[str, str], ...] = SCENES


DEFAULT = Config()
