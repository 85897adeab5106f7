"""Run settings: defaults, presets by mode, immutable overrides."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Recipe:
    """``fit``, ``smoothing``, ``boundary``, ``colours`` and ``max_faces`` shape the label field; the rest the stack."""

    mode: str = "illustration"
    fit: str = "contain"
    smoothing: str = "medium"
    boundary: str = "curve_fit"
    assets: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    angles: tuple[float, ...] = ()
    effects: bool = True
    canvas: int = 320
    colours: int = 6
    max_faces: int = 24
    max_layers: int = 40
    stamps_per_face: int = 5
    min_cover: float = 0.90
    recall: int = 48
    particles: int = 384

    def __post_init__(self) -> None:
        if self.fit not in ("contain", "cover") or self.boundary not in ("curve_fit", "dense"):
            raise ValueError("unknown fit or boundary policy")
        if self.smoothing not in ("off", "weak", "medium", "strong") or self.max_faces < 1:
            raise ValueError("unknown smoothing policy or no faces")
        if not 1 <= self.max_layers <= 40 or self.colours < 1 or self.canvas < 1:
            raise ValueError("a limit is out of range")

    def override(self, **changes) -> Recipe:
        return replace(self, **changes)


PRESETS = {
    "logo": Recipe(mode="logo", smoothing="weak"),
    "illustration": Recipe(),
    "photo_portrait": Recipe(mode="photo_portrait", fit="cover", smoothing="strong"),
    "photo_general": Recipe(mode="photo_general", fit="cover", smoothing="strong"),
    "silhouette": Recipe(mode="silhouette"),
    "pixel": Recipe(mode="pixel", smoothing="off", boundary="dense", assets=("Square",), angles=(0.0, 90.0), effects=False),
}


def recipe(mode: str = "illustration", **changes) -> Recipe:
    if mode not in PRESETS:
        raise ValueError(f"unknown mode {mode}")
    return PRESETS[mode].override(**changes)
